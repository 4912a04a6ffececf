"""Several versions of one table, counted together.

A version is the table with a change: rows left out, values replaced, rows added. Instead of a copy of
the table per version, keyed aggregations carry one number per version beside each key, so that what is
shuffled has as many rows as one table, and versions with the same rows share a number. Profiles copy
rows inside the scan only; each task sends one row per version.

A change of values in the key itself can't be counted beside the unchanged key: such a version takes part
with rows of its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.sql import text
from plumbline.model import PIPELINE
from plumbline.operators.keys import _comparable, repeated_rows
from plumbline.specs import PipelineSpec, ticked


@dataclass(frozen=True)
class Change:
    """Base rows for which ``keep`` holds, with ``values`` (SQL text by column) replaced, and ``added`` rows."""

    keep: str = "TRUE"
    values: Mapping[str, str] = field(default_factory=dict)
    added: DataFrame | None = None

    def key(self) -> tuple:
        """Equal for changes that surely make the same table."""
        return self.keep, tuple(sorted(self.values.items())), id(self.added) if self.added is not None else None


def _values(df: DataFrame, values: Mapping[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{values[c]} AS {ticked(c)}" if c in values else ticked(c) for c in df.columns])


@dataclass(frozen=True)
class Versions:
    """A stored table and its changes by case."""

    base: DataFrame
    changes: Mapping[str, Change]

    def rows(self, case: str) -> DataFrame:
        """One version as a table."""
        change = self.changes[case]
        rows = _values(self.base.where(change.keep), change.values)
        return rows if change.added is None else rows.unionByName(change.added)

    def touches(self, case: str, columns: Sequence[str]) -> bool:
        return bool(set(self.changes[case].values) & set(columns))


@dataclass(frozen=True)
class Counted:
    """Rows with the columns of a key and, per set of rows, a column that is 1 where the row is in it."""

    rows: DataFrame
    counters: Mapping[str, str]  # case -> column

    @property
    def names(self) -> list[str]:
        return list(dict.fromkeys(self.counters.values()))


def counted(versions: Versions, columns: Sequence[str], prefix: str = "_n", comparable: bool = False) -> Counted:
    """All versions as one set of rows with a counter per distinct version."""
    counters: dict[str, str] = {}
    known: dict[tuple, str] = {}
    flags: dict[str, str] = {}
    more: list[tuple[str, DataFrame]] = []
    for case, change in versions.changes.items():
        own = versions.touches(case, columns)
        key = change.key() if own else Change(change.keep, {}, change.added).key()
        if key not in known:
            name = known[key] = f"{prefix}{len(known)}"
            if own:
                flags[name] = "FALSE"
                more.append((name, versions.rows(case)))
            else:
                flags[name] = change.keep
                if change.added is not None:
                    more.append((name, change.added))
        counters[case] = known[key]

    def picked(df: DataFrame, flag: Mapping[str, str]) -> DataFrame:
        cells = [F.expr(f"CASE WHEN {flag[n]} THEN 1L ELSE 0L END AS {n}") for n in flags]
        if not comparable:
            return df.select(*[F.col(ticked(c)) for c in columns], *cells)
        # Conditions read the row as it is, so they are evaluated before it takes its comparable form.
        return _comparable(df.select(*[F.col(ticked(c)) for c in columns], *cells))

    parts = [picked(versions.base, flags)]
    parts += [picked(df, {n: "TRUE" if n == name else "FALSE" for n in flags}) for name, df in more]
    return Counted(reduce(lambda a, b: a.unionByName(b), parts), counters)


def _per_case(one: DataFrame, cases: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """A row of totals as one row per case, each with its SQL texts by name."""
    structs = [
        f"struct({text(case)} AS {PIPELINE}, {', '.join(f'{sql} AS {ticked(n)}' for n, sql in found.items())})"
        for case, found in cases.items()
    ]
    return one.selectExpr(f"inline(array({', '.join(structs)}))")


def _totals(per_key: DataFrame, found: Counted, sql: str, name: str) -> DataFrame:
    """Sum one expression over keys for every case; ``{n}`` stands for the rows of the key in that case."""
    sums = [F.expr(f"coalesce(sum({sql.format(n=n)}), 0L) AS {n}") for n in found.names]
    return _per_case(per_key.agg(*sums), {case: {name: n} for case, n in found.counters.items()})


def _summed(found: Counted, key: Sequence[str]) -> DataFrame:
    return found.rows.groupBy(*[F.col(ticked(k)) for k in key]).agg(*[F.sum(n).alias(n) for n in found.names])


def profile(versions: Versions, metrics: Mapping[str, str]) -> DataFrame:
    """One row per case with every metric, from one scan; only totals are shuffled."""
    known: dict[tuple, list[str]] = {}
    for case, change in versions.changes.items():
        known.setdefault(change.key(), []).append(case)
    base = versions.base
    structs, more = [], []
    for cases in known.values():
        change = versions.changes[cases[0]]
        cells = [f"{change.values.get(c, ticked(c))} AS {ticked(c)}" for c in base.columns]
        structs.append(f"struct({text(cases[0])} AS _case, ({change.keep}) AS _keep, {', '.join(cells)})")
        if change.added is not None:
            more.append(change.added.selectExpr(f"{text(cases[0])} AS _case", *map(ticked, base.columns)))
    rows = base.selectExpr(f"inline(array({', '.join(structs)}))").where("_keep").drop("_keep")
    rows = reduce(lambda a, b: a.unionByName(b), more, rows)
    found = rows.groupBy("_case").agg(*[F.expr(f"{sql} AS {ticked(n)}") for n, sql in metrics.items()])
    # A case without any row has its row of metrics, too.
    pairs = [f"struct({text(cs[0])} AS _case, {text(c)} AS {PIPELINE})" for cs in known.values() for c in cs]
    cases = base.sparkSession.range(1).selectExpr(f"inline(array({', '.join(pairs)}))")
    return F.broadcast(cases).join(found, "_case", "left").drop("_case")


def duplicate_excess(versions: Versions, key: Sequence[str], name: str = "excess") -> DataFrame:
    """Rows beyond the first of each key, per case."""
    found = counted(versions, key)
    return _totals(_summed(found, key), found, "greatest({n} - 1L, 0L)", name)


def full_row_duplicates(versions: Versions, name: str = "excess") -> DataFrame:
    """Rows minus distinct rows, per case; a row that no other is equal to adds nothing and isn't shuffled."""
    key = versions.base.columns
    found = counted(versions, key, comparable=True)
    found = replace(found, rows=repeated_rows(found.rows, key))
    return _totals(_summed(found, key), found, "greatest({n} - 1L, 0L)", name)


def distinct_count(versions: Versions, column: str, name: str = "distinct") -> DataFrame:
    """Distinct non-null values, per case."""
    found = counted(versions, [column])
    here = f"CASE WHEN {{n}} > 0 AND {ticked(column)} IS NOT NULL THEN 1L ELSE 0L END"
    return _totals(_summed(found, [column]), found, here, name)


def fk_orphans(
    child: Versions, column: str, ref: Versions, ref_column: str, name: str = "orphans"
) -> DataFrame:
    """Child rows whose non-null reference matches no row of ``ref``, per case.

    Both sides are counted per value in one union-and-aggregate: no join, one record per value and task.
    """
    mine = counted(child, [column])
    theirs = counted(ref, [ref_column], "_r")
    theirs_rows = theirs.rows.withColumnRenamed(ref_column, column)
    both = mine.rows.unionByName(theirs_rows, allowMissingColumns=True).where(f"{ticked(column)} IS NOT NULL")
    sums = [F.expr(f"coalesce(sum({n}), 0L) AS {n}") for n in (*mine.names, *theirs.names)]
    per_value = both.groupBy(F.col(ticked(column))).agg(*sums)
    pairs = dict.fromkeys((mine.counters[c], theirs.counters[c]) for c in child.changes)
    totals = per_value.agg(
        *[F.expr(f"coalesce(sum({n}) FILTER (WHERE {r} = 0), 0L) AS {n}{r}") for n, r in pairs]
    )
    return _per_case(totals, {c: {name: mine.counters[c] + theirs.counters[c]} for c in child.changes})


def key_census(bronze: DataFrame, silver: Versions, spec: PipelineSpec) -> DataFrame:
    """What ``keys.key_census`` counts, for every version of Silver against one Bronze.

    Bronze and Silver are read once each; the two shuffles carry one row per key and per document, however
    many cases there are.
    """
    key = list(spec.business_key)
    found = counted(silver, key)
    n = found.names
    valid = spec.valid_row()
    quantity = f"CAST({ticked(spec.quantity)} AS DOUBLE)"
    left = bronze.selectExpr(
        *map(ticked, key), "1L AS _b", f"CASE WHEN {valid} THEN 1L ELSE 0L END AS _v",
        f"CASE WHEN {valid} THEN {quantity} END AS _q", *[f"0L AS {x}" for x in n],
    )
    right = found.rows.selectExpr(*map(ticked, key), "0L AS _b", "0L AS _v", "CAST(NULL AS DOUBLE) AS _q", *n)
    per_key = left.unionByName(right).groupBy(*[F.col(ticked(k)) for k in key]).agg(
        *[F.expr(f"sum({x}) AS {x}") for x in ("_b", "_v", *n)], F.expr("min(_q) AS _min"), F.expr("max(_q) AS _max")
    )
    document = ticked(spec.document)
    sums = ["sum(_b) AS _b", "sum(_v) AS _v", "sum(greatest(_b - 1L, 0L)) AS _b_dup"]
    for x in n:
        sums += [
            f"sum({x}) AS {x}", f"sum(greatest({x} - 1L, 0L)) AS {x}_dup",
            f"coalesce(sum(_v) FILTER (WHERE {x} = 0), 0L) AS {x}_lost",
            f"min(_min) FILTER (WHERE {x} = 0) AS {x}_min", f"max(_max) FILTER (WHERE {x} = 0) AS {x}_max",
        ]
    per_document = per_key.groupBy(F.col(document)).agg(*map(F.expr, sums))
    total = lambda sql, where="TRUE": f"coalesce(sum({sql}) FILTER (WHERE {where}), 0L)"
    totals = [f"{total('_b_dup')} AS _b_dup", f"{total('greatest(_b - 1L, 0L)')} AS _b_doc"]
    for x in n:
        totals += [
            f"{total(f'{x}_lost')} AS {x}_lost", f"min({x}_min) AS {x}_min", f"max({x}_max) AS {x}_max",
            f"{total(f'{x}_dup')} AS {x}_dup",
            f"{total('_v', f'{x} = 0 OR {document} IS NULL')} AS {x}_lost_doc",
            f"{total(x, f'_b = 0 OR {document} IS NULL')} AS {x}_unknown",
            f"{total(f'greatest({x} - 1L, 0L)')} AS {x}_doc",
            f"count({document}) FILTER (WHERE {x} > 0) AS {x}_docs",
        ]
    one = per_document.agg(*map(F.expr, totals))
    return _per_case(one, {
        case: {
            "lost_rows": f"{x}_lost", "lost_min_quantity": f"{x}_min", "lost_max_quantity": f"{x}_max",
            "bronze_key_excess": "_b_dup", "silver_key_excess": f"{x}_dup",
            "lost_document_rows": f"{x}_lost_doc", "silver_rows_unknown": f"{x}_unknown",
            "bronze_document_excess": "_b_doc", "silver_document_excess": f"{x}_doc",
            "silver_documents": f"{x}_docs",
        }
        for case, x in found.counters.items()
    })
