"""Key-based operators: duplicates, lost rows, key sets, orphans.

Every operator is a grouped aggregation or an anti join on whole keys. Aggregations
combine on the map side first, so one key that holds a large share of the rows
shrinks to one record per input task before anything is shuffled; where rows of two
layers are compared, they are counted per key in one union-and-aggregate instead of
being joined, which no hot key can skew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.key_filter import BLOCKS, key_filter, shared_columns, with_membership
from plumbline.plans.lineage import cut_lineage
from plumbline.specs import PipelineSpec, ticked

#: Parts that the rows of one lost key are dealt to if it has more than so many.
SALTS = 8
HOT = 10_000


def _zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0)).cast("long")


def key_counts(df: DataFrame, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows per key; NULL keys form one group."""
    names = [*by, *[k for k in key if k not in by]]
    return df.groupBy(*[F.col(ticked(n)) for n in names]).agg(F.count(F.lit(1)).alias("copies"))


def duplicate_excess(
    df: DataFrame, key: Sequence[str], by: Sequence[str] = (), name: str = "excess"
) -> DataFrame:
    """Rows beyond the first of each key."""
    return (
        key_counts(df, key, by)
        .groupBy(*by)
        .agg(_zero(F.sum(F.col("copies") - 1)).alias(name))
    )


def duplicated_keys(
    df: DataFrame, key: Sequence[str], by: Sequence[str] = (), name: str = "duplicated"
) -> DataFrame:
    """Number of distinct keys that occur more than once."""
    return (
        key_counts(df, key, by)
        .groupBy(*by)
        .agg(F.count_if(F.col("copies") > 1).alias(name))
    )


def distinct_count(
    df: DataFrame, column: str, by: Sequence[str] = (), name: str = "distinct"
) -> DataFrame:
    """Exact count of distinct non-null values."""
    return (
        key_counts(df, [column], by)
        .groupBy(*by)
        .agg(F.count(F.col(ticked(column))).alias(name))
    )


def _groupable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _groupable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_groupable(f.dataType) for f in dtype.fields)
    return not isinstance(dtype, T.MapType | T.VariantType)


def _canonical(value: Column, dtype: T.DataType) -> Column:
    """A value that can be grouped and is equal where the original means the same.

    A map becomes its entries by ascending key, a VARIANT its JSON text, in arrays and structs too.
    """
    if _groupable(dtype):
        return value
    if isinstance(dtype, T.MapType):
        entry = lambda e: F.struct(
            _canonical(e["key"], dtype.keyType).alias("key"), _canonical(e["value"], dtype.valueType).alias("value")
        )
        return F.array_sort(F.transform(F.map_entries(value), entry))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda e: _canonical(e, dtype.elementType))
    if isinstance(dtype, T.StructType):
        fields = [_canonical(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return F.to_json(value)


def _comparable(df: DataFrame) -> DataFrame:
    """The rows with every column in a form that can be grouped."""
    return df.select(*[_canonical(F.col(ticked(f.name)), f.dataType).alias(f.name) for f in df.schema.fields])


def full_row_duplicates(
    df: DataFrame, by: Sequence[str] = (), name: str = "excess"
) -> DataFrame:
    """Rows minus distinct rows, as one lazy aggregation over all columns."""
    rows = _comparable(df)
    return duplicate_excess(rows, rows.columns, by, name)


def repeated_rows(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All rows that repeat another in the columns, which can be grouped, and maybe a few that don't.

    64-bit hashes are counted, and a filter of those that occur twice says of most rows that they are
    unique. Text under a collation is left out of the hash, so equal rows always have equal hashes.
    """
    kinds = {f.name: f.dataType.simpleString().lower() for f in rows.schema.fields}
    plain = [F.col(ticked(c)) for c in columns if "collate" not in kinds[c]]
    hashed = rows.withColumn("_h", F.xxhash64(*plain) if plain else F.lit(0).cast("long"))
    repeated = key_counts(hashed, ["_h"]).filter(F.col("copies") > 1)
    return with_membership(hashed, key_filter(repeated, ["_h"]), ["_h"]).filter("_maybe").drop("_h", "_maybe")


def full_row_duplicates_two_pass(
    df: DataFrame, by: Sequence[str] = (), name: str = "excess"
) -> DataFrame:
    """Same count, for wide tables: only row hashes are shuffled when rows are unique.

    Rows that ``repeated_rows`` keeps back are certainly unique, so pass two groups the others only, by
    all columns; neither a hash collision nor a false pass of its filter can therefore change the result.
    """
    rows = _comparable(df)
    excess = duplicate_excess(repeated_rows(rows, rows.columns), rows.columns, by, name)
    if not by:
        return excess
    groups = rows.groupBy(*by).agg(F.lit(0).cast("long").alias(name))
    return groups.unionByName(excess).groupBy(*by).agg(F.sum(name).alias(name))


def fk_orphans(
    child: DataFrame,
    column: str,
    ref: DataFrame,
    ref_column: str,
    by: Sequence[str] = (),
    name: str = "orphans",
) -> DataFrame:
    """Child rows whose non-null reference matches no row of ``ref``.

    A reference table that carries the group columns is matched within the group; one that
    does not serves all groups. The child is first reduced to a count per referenced value, so the anti join sees
    each value once per group and a popular value costs no more than a rare one.
    """
    counts = key_counts(child.filter(F.col(ticked(column)).isNotNull()), [column], by)
    # Groups without any reference still report zero.
    within = [c for c in by if c in ref.columns]
    known = ref.select(*within, F.col(ticked(ref_column)).alias(column)).filter(F.col(ticked(column)).isNotNull())
    orphans = counts.join(known.distinct(), [*within, column], "left_anti")
    total = orphans.groupBy(*by).agg(_zero(F.sum("copies")).alias(name))
    if not by:
        return total
    groups = child.groupBy(*by).agg(F.lit(0).cast("long").alias(name))
    return groups.unionByName(total).groupBy(*by).agg(F.sum(name).alias(name))


def fk_orphans_filtered(
    child: DataFrame,
    column: str,
    ref: DataFrame,
    ref_column: str,
    by: Sequence[str] = (),
    name: str = "orphans",
    blocks: int = BLOCKS,
) -> DataFrame:
    """The counts of ``fk_orphans``, for children many of whose references match nothing.

    A filter of the reference's keys settles most orphans where they lie: they are counted as one
    group without a key, so the shuffle and the anti join see the keys that may match, and false
    passes of the filter among them. It costs one more aggregation over the reference.
    """
    within = [c for c in by if c in ref.columns]
    rows = child.filter(F.col(ticked(column)).isNotNull())
    known = ref.select(*within, F.col(ticked(ref_column)).alias(column)).filter(F.col(ticked(column)).isNotNull())
    asked = shared_columns(rows, known, [*within, column])
    marked = with_membership(rows, key_filter(known, asked, blocks), asked, blocks)
    # A NULL matches nothing, so the settled orphans stay in the anti join's result.
    settled = marked.withColumn(column, F.when(F.col("_maybe"), F.col(ticked(column))))
    orphans = key_counts(settled, [column], by).join(known.distinct(), [*within, column], "left_anti")
    total = orphans.groupBy(*by).agg(_zero(F.sum("copies")).alias(name))
    if not by:
        return total
    groups = child.groupBy(*by).agg(F.lit(0).cast("long").alias(name))
    return groups.unionByName(total).groupBy(*by).agg(F.sum(name).alias(name))


def lost_valid_rows(
    bronze: DataFrame, silver: DataFrame, spec: PipelineSpec, by: Sequence[str] = ()
) -> DataFrame:
    """The valid Bronze rows with no Silver row on the null-safe business key."""
    keys = [*by, *spec.business_key]
    kept = silver.select(*[F.col(k).alias(f"_s_{k}") for k in keys]).distinct()
    valid = bronze.filter(spec.valid_row())
    match = [valid[k].eqNullSafe(kept[f"_s_{k}"]) for k in keys]
    return valid.join(kept, match, "left_anti")


def lost_valid_rows_counted(
    bronze: DataFrame, silver: DataFrame, spec: PipelineSpec, by: Sequence[str] = (), blocks: int = BLOCKS
) -> DataFrame:
    """The rows of ``lost_valid_rows``, for layers with hot keys or little loss.

    Lost keys are found by counting, so a hot key is one record per task, and stored, so that counting is
    done once. A filter of them then keeps back the rows whose key is certainly not lost; only the others
    are shuffled to the exact match, those of a key with more than HOT rows to SALTS parts.
    """
    keys = [*by, *spec.business_key]
    valid = bronze.filter(spec.valid_row())
    columns = [F.col(ticked(k)) for k in keys]
    tagged = valid.select(*columns, F.lit(0).alias("_kept")).unionByName(silver.select(*columns, F.lit(1).alias("_kept")))
    counted = tagged.groupBy(*columns).agg(F.max("_kept").alias("_kept"), F.count(F.lit(1)).alias("_n"))
    lost = cut_lineage(counted.filter(F.col("_kept") == 0).drop("_kept"))
    asked = shared_columns(valid, lost, keys)
    found = with_membership(valid, key_filter(lost, asked, blocks), asked, blocks).filter("_maybe").drop("_maybe")
    hot = key_filter(lost.filter(F.col("_n") > HOT), asked, blocks)
    # A key gets the same answer on either side, so its rows and its parts agree.
    salt = F.when(F.col("_hot"), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(F.lit(0))
    found = with_membership(found, hot, asked, blocks, "_hot").withColumn("_salt", salt).drop("_hot")
    salts = F.explode(F.sequence(F.lit(0), F.when(F.col("_hot"), F.lit(SALTS - 1)).otherwise(F.lit(0)))).alias("_s_salt")
    marked = with_membership(lost, hot, asked, blocks, "_hot")
    parts = marked.select(*[F.col(ticked(k)).alias(f"_s_{k}") for k in keys], salts)
    match = [F.col(ticked(k)).eqNullSafe(F.col(ticked(f"_s_{k}"))) for k in keys]
    return found.join(parts, [*match, F.col("_salt") == F.col("_s_salt")], "left_semi").drop("_salt")


def key_census(
    bronze: DataFrame, silver: DataFrame, spec: PipelineSpec, by: Sequence[str] = ()
) -> DataFrame:
    """One row per group with every count that compares Bronze and Silver by key.

    Rows of both layers are tagged, unioned and counted per business key; the key
    counts are then summed per document and finally per group. GROUP BY treats NULLs
    as equal, which is exactly the null-safe match the loss checks need. A plain
    ``=`` match on the document never matches NULL, hence the isNull branches.

    Loss, duplicates on the business key, the range of lost quantities, document
    duplicates, distinct documents and both document-level anti-join counts come from
    these two shuffles; a join per check would take one or two each.
    """
    key = list(spec.business_key)
    document = spec.document
    quantity = F.col(spec.quantity).cast("double")
    yes, no = F.lit(1).cast("long"), F.lit(0).cast("long")
    is_valid = F.expr(spec.valid_row())
    valid = F.when(is_valid, yes).otherwise(no)

    left = bronze.select(
        *by,
        *key,
        yes.alias("_bronze"),
        no.alias("_silver"),
        valid.alias("_valid"),
        F.when(is_valid, quantity).alias("_qty"),
    )
    right = silver.select(
        *by,
        *key,
        no.alias("_bronze"),
        yes.alias("_silver"),
        no.alias("_valid"),
        F.lit(None).cast("double").alias("_qty"),
    )
    per_key = (
        left.unionByName(right)
        .groupBy(*by, *key)
        .agg(
            F.sum("_bronze").alias("_bronze"),
            F.sum("_silver").alias("_silver"),
            F.sum("_valid").alias("_valid"),
            F.min("_qty").alias("_min"),
            F.max("_qty").alias("_max"),
        )
    )
    lost = F.col("_silver") == 0
    per_document = per_key.groupBy(*by, document).agg(
        F.sum("_bronze").alias("_bronze"),
        F.sum("_silver").alias("_silver"),
        F.sum("_valid").alias("_valid"),
        F.sum(F.when(lost, F.col("_valid")).otherwise(0)).alias("_lost"),
        F.min(F.when(lost, F.col("_min"))).alias("_min"),
        F.max(F.when(lost, F.col("_max"))).alias("_max"),
        F.sum(F.greatest(F.col("_bronze") - 1, F.lit(0))).alias("_bronze_dup"),
        F.sum(F.greatest(F.col("_silver") - 1, F.lit(0))).alias("_silver_dup"),
    )
    doc = F.col(document)
    no_silver = (F.col("_silver") == 0) | doc.isNull()
    no_bronze = (F.col("_bronze") == 0) | doc.isNull()
    return per_document.groupBy(*by).agg(
        _zero(F.sum("_lost")).alias("lost_rows"),
        F.min("_min").alias("lost_min_quantity"),
        F.max("_max").alias("lost_max_quantity"),
        _zero(F.sum("_bronze_dup")).alias("bronze_key_excess"),
        _zero(F.sum("_silver_dup")).alias("silver_key_excess"),
        _zero(F.sum(F.when(no_silver, F.col("_valid")))).alias("lost_document_rows"),
        _zero(F.sum(F.when(no_bronze, F.col("_silver")))).alias("silver_rows_unknown"),
        _zero(F.sum(F.greatest(F.col("_bronze") - 1, F.lit(0)))).alias("bronze_document_excess"),
        _zero(F.sum(F.greatest(F.col("_silver") - 1, F.lit(0)))).alias("silver_document_excess"),
        F.count(F.when(F.col("_silver") > 0, doc)).alias("silver_documents"),
    )


def segment_loss(
    bronze: DataFrame,
    silver: DataFrame,
    segment: Column,
    spec: PipelineSpec,
    by: Sequence[str] = (),
) -> DataFrame:
    """Loss per segment: valid Bronze rows against all Silver rows, worst first.

    Segments are counted in one union-and-aggregate; those absent from valid Bronze
    are left out. Loss may be negative when Silver holds more rows than valid Bronze.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    left = bronze.filter(spec.valid_row()).select(
        *by, segment.alias("segment"), one.alias("b"), zero.alias("s")
    )
    right = silver.select(*by, segment.alias("segment"), zero.alias("b"), one.alias("s"))
    counts = (
        left.unionByName(right)
        .groupBy(*by, "segment")
        .agg(F.sum("b").alias("bronze_valid"), F.sum("s").alias("silver_count"))
        .filter(F.col("bronze_valid") > 0)
    )
    kept = F.try_divide(F.col("silver_count").cast("double"), F.col("bronze_valid"))
    loss = F.round((F.lit(1.0) - kept) * 100, 2)
    return counts.withColumn("loss_pct", loss).orderBy(
        *by, F.col("loss_pct").desc(), F.col("segment")
    )


def country_mismatches(
    gold_country: DataFrame,
    silver: DataFrame,
    spec: PipelineSpec,
    by: Sequence[str] = (),
) -> DataFrame:
    """Countries whose Gold revenue differs from Silver, missing ones included.

    Silver is summed per country before the join, so both inputs hold about one row
    per country. NULL countries never match and count once per side.
    """
    on = [*by, spec.country]
    gold = gold_country.select(*on, F.col("revenue").cast("double").alias("_gold"))
    fresh = silver.groupBy(*on).agg(F.sum(spec.revenue).cast("double").alias("_fresh"))
    both = gold.join(fresh, on, "full_outer")
    gap = F.abs(F.coalesce("_gold", F.lit(0.0)) - F.coalesce("_fresh", F.lit(0.0)))
    off = gap > F.lit(spec.thresholds.revenue_tolerance)
    return both.groupBy(*by).agg(F.count_if(off).alias("country_mismatches"))
