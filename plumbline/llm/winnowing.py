"""Document fingerprints by winnowing, in DataFrame functions only.

A text's words are hashed, every run of ``GRAM`` words gets a hash, and of every ``WINDOW`` consecutive
ones the least is selected, the rightmost of equal ones. So any ``GRAM + WINDOW - 1`` words that two
texts share give them a common fingerprint, and each keeps the position it was selected at. Texts
of few words are fingerprinted by their characters as well, in runs of ``CHAR_GRAM``; two texts are
compared by their characters only if both are.

A selected hash is one number: its upper 40 bits, and below them what is left of 2**24 - 1 when the
position (modulo 2**24) is taken away. The least number is then the rightmost of the least hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GRAM, WINDOW = 4, 12
CHAR_GRAM, CHAR_WINDOW = 4, 4
#: Texts of fewer words are fingerprinted by characters too.
FEW_WORDS = 40
#: Intervals of the ids' distribution, documents aimed at in a bucket, and most buckets of an interval.
KNOTS, BUCKET_ROWS, MOST_PARTS = 64, 2000, 1024
PLACES = 0xFFFFFF


def let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once and names it in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def winnowed(units: str, gram: int, window: int, seed: int) -> str:
    """SQL for the selected numbers of an array of units (empty for none), in order of position."""
    run = ", ".join(f"get(h, i + {k})" for k in range(gram))
    least = ", ".join(f"get(g, i + {k})" for k in range(window))
    grams = (
        f"transform(sequence(0, greatest(size(h) - {gram}, 0)), i -> "
        f"(xxhash64({seed}, {run}) & ~{PLACES}L) | ({PLACES}L - (i & {PLACES})))"
    )
    chosen = f"array_distinct(transform(sequence(0, greatest(size(g) - {window}, 0)), i -> least({least})))"
    hashes = f"transform({units}, u -> xxhash64(u))"
    return let("h", hashes, f"if(size(h) = 0, array_repeat(0L, 0), {let('g', grams, chosen)})")


def units(text: str) -> Column:
    """The selected numbers of a text column's words, and of its characters (null if it isn't short)."""
    words = f"filter(split({text}, '[\\\\x00-\\\\x20]+'), u -> u <> '')"
    by_word = winnowed("w", GRAM, WINDOW, 1)
    by_char = winnowed(f"filter(split({text}, ''), u -> u <> '')", CHAR_GRAM, CHAR_WINDOW, 2)
    return F.expr(let("w", words, f"named_struct('words', {by_word}, 'chars', if(size(w) < {FEW_WORDS}, {by_char}, null))"))


def whole(fp: str) -> str:
    """SQL for all numbers of ``units``."""
    return f"concat({fp}.words, coalesce({fp}.chars, array_repeat(0L, 0)))"


def fingerprint(text: str) -> Column:
    """The selected numbers of a text column: those of its words, and of its characters if it is short."""
    return F.transform(F.array(units(text)), lambda fp: F.concat(fp["words"], F.coalesce(fp["chars"], F.expr("array_repeat(0L, 0)"))))[0]


def written(fp: str) -> Column:
    """The numbers of ``units`` as text: hash@position, comma-joined, by position."""
    return F.expr(
        f"array_join(transform({whole(fp)}, x -> concat(lower(hex(shiftrightunsigned(x, 24))), '@', {PLACES}L - (x & {PLACES}L))), ',')"
    )


def likeness(a: str, b: str) -> Column:
    """The share of common hashes among the distinct ones of the ``units`` both have; 1 for two empty ones."""
    both = lambda x: f"if({a}.chars IS NULL OR {b}.chars IS NULL, {x}.words, {whole(x)})"
    hashes = lambda x: f"array_distinct(transform({x}, v -> shiftright(v, 24)))"
    share = "if(size(p) + size(q) = 0, 1D, size(array_intersect(p, q)) / (size(p) + size(q) - size(array_intersect(p, q))))"
    return F.expr(let("p", hashes(both(a)), let("q", hashes(both(b)), f"cast({share} as double)")))


def buckets(rows: DataFrame) -> Column:
    """Numbers buckets of neighbouring ids: id order is bucket order, and no bucket is large.

    The ids' distribution is cut at its quantiles, and each interval evenly. Rows without an id come
    before all others, dealt by their text.
    """
    probe = rows.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", [k / KNOTS for k in range(KNOTS + 1)], 1000).alias("q"))
    n, knots = probe.first()
    knots = sorted(set(knots or []))
    parts = min(MOST_PARTS, max(1, n // (KNOTS * BUCKET_ROWS)))
    place = F.pmod(F.col("text_hash"), F.lit(parts)) - parts
    number = F.when(F.col("doc_id").isNull(), place)
    for k in range(len(knots) - 1, -1, -1):
        low, high = knots[k], knots[k + 1] if k + 1 < len(knots) else knots[k] + 1
        share = (F.col("doc_id").cast("double") - float(low)) / max(float(high) - float(low), 1.0)
        inner = F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor(share * parts)))
        number = number.when(F.col("doc_id") >= low, k * parts + inner)
    return number.otherwise(F.lit(0)).cast("long")


def with_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Adds ``next_<column>`` from the document that follows in descending doc_id, the first after the last.

    Of equal ids the greater text hash comes first; rows without an id come last. Every bucket's
    first row is also dealt to the end of the bucket before, so one shuffle of the rows and windows
    inside buckets suffice. The table of first rows has one row per bucket, at most
    KNOTS * MOST_PARTS and some, and is broadcast.
    """
    rows = rows.withColumn("bucket", buckets(rows))
    key = F.struct("doc_id", "text_hash")
    around = Window.orderBy(F.col("bucket").desc())
    firsts = (
        rows.groupBy("bucket")
        .agg(F.max(key).alias("first"))
        .select(
            "bucket",
            "first",
            F.coalesce(F.lag("bucket").over(around), F.min("bucket").over(Window.partitionBy())).alias("before"),
        )
    )
    dealt = rows.join(F.broadcast(firsts), "bucket").select(
        *rows.columns,
        F.explode(
            F.when(
                key.eqNullSafe(F.col("first")),
                F.array(
                    F.struct(F.col("bucket").alias("to"), F.lit(False).alias("copy")),
                    F.struct(F.col("before").alias("to"), F.lit(True).alias("copy")),
                ),
            ).otherwise(F.array(F.struct(F.col("bucket").alias("to"), F.lit(False).alias("copy"))))
        ).alias("deal"),
    )
    order = Window.partitionBy("deal.to").orderBy("deal.copy", F.col("doc_id").desc_nulls_last(), F.col("text_hash").desc())
    follow = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
    return follow.where("NOT deal.copy").drop("deal", "bucket")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third replaced by the start of the next document (descending id).
    Likenesses are of the units that both texts have. Null texts count as empty; an empty text has an empty fingerprint, and two empty ones are alike (1).
    Every row gives a row, repeated ones too; a lone row is its own next. An empty table gives none;
    other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.withColumn("text_hash", F.xxhash64("text")).withColumn("fp", units("text"))
    rows = with_next(rows, ["text", "fp"])
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.left("text", (F.col("n_chars") - third).cast("int")), F.left("next_text", third))
    rows = rows.select("doc_id", "n_chars", "fp", "next_fp", edited.alias("edited"))
    rows = rows.withColumn("edited_fp", units("edited"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written("fp").alias("fingerprint"),
        written("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
    )
