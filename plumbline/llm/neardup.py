"""Near-duplicate documents by HyperMinHash.

A document's words are cut into shingles of five and each shingle is hashed to 64 bits. The first 7
bits choose one of 128 buckets. Of the least remaining value in a bucket, the register keeps the
number of leading zeros and the 10 bits behind the first one: 2 bytes instead of 8, and more
precise the smaller the value. An empty bucket takes the register of another one, found along a
fixed order that every document shares. Registers are banded by fours: 32 bands, so a pair at 0.85
misses all of them with a probability below 1e-10. Candidates are estimated from the share of equal
registers, corrected for registers that are equal by chance, and what can reach the threshold is
confirmed on the whole shingle sets.

Equal sets are one class from the start, so copies never meet each other. In a small bucket of a
band all classes meet; in a large one each meets two pivots, which are others in every band. Links
are confirmed first for each class's likeliest partners, which joins most of a group. Classes of
large buckets that still hold more than one component then meet by their rarest shingles, first the
class that has fewest of its own, then, exactly and without the pairs inside a component, all others
(``prefix_pairs``). So groups of thousands of near copies
cost a few pairs per member, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import landed, pieces
from plumbline.llm.components import connected_components

#: Words of a shingle, and the least similarity of a link in percent.
SHINGLE, PERCENT = 5, 85
BUCKET_BITS, MANTISSA_BITS, BAND = 7, 10, 4
BUCKETS = 1 << BUCKET_BITS
#: Classes in a band's bucket up to which all meet.
ALL_MEET = 24
#: How many standard errors an estimate may lie under the threshold.
ERRORS = 5
#: Sets up to this size are confirmed without an estimate, which few shingles make uncertain.
SURE_SIZE = 40
#: Characters of words that a worker remembers.
MEMO_CHARS = 4_000_000

STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    chars = 0

    def __missing__(self, word: bytes) -> int:
        if self.chars > MEMO_CHARS:
            self.clear()
            self.chars = 0
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        self.chars += len(word)
        return h


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; all words are one if they are fewer."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII space count
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(words))
    mixed = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        mixed = (mixed ^ h[k : k + len(mixed)]) * STEP
        mixed ^= mixed >> np.uint64(29)
    mixed *= MIX
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


@lru_cache(maxsize=1)
def fallbacks() -> np.ndarray:
    """For each bucket, the order in which it looks for a register elsewhere."""
    rng = np.random.default_rng(1)
    return np.stack([np.concatenate([[b], rng.permutation(np.delete(np.arange(BUCKETS), b))]) for b in range(BUCKETS)])


def registers(hashes: np.ndarray) -> np.ndarray:
    """The compressed registers of a set that isn't empty, given as sorted hashes."""
    bounds = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
    first = np.searchsorted(hashes, bounds)
    filled = np.append(first[1:], len(hashes)) > first
    rest = (hashes[np.minimum(first, len(hashes) - 1)] << np.uint64(BUCKET_BITS)) | np.uint64(1 << BUCKET_BITS - 1)
    # frexp of the upper half: leading zeros and the bits behind the first one.
    part, exponent = np.frexp((rest >> np.uint64(11)).astype(np.float64))
    out = ((53 - exponent) << MANTISSA_BITS) | ((part * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.int64)
    if not filled.all():
        order = fallbacks()
        out = out[order[np.arange(BUCKETS), filled[order].argmax(axis=1)]]
    return out.astype("<u2")


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """How likely two different least values of sets of these sizes get the same register."""
    edges = np.append(0.5 ** np.arange(24), 0.0)

    def zeros(n):
        return np.diff((1 - edges[None, :]) ** (np.maximum(n, 1) / BUCKETS)[:, None], axis=1)

    return np.minimum((zeros(n_a) * zeros(n_b)).sum(axis=1) / (1 << MANTISSA_BITS), 0.5)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity from registers (rows of BUCKETS), without the equal ones due to chance."""
    c = chance(n_a, n_b)
    return ((a == b).mean(axis=1) - c) / (1 - c)


def sketches(docs: DataFrame, text_hash: bool = False) -> DataFrame:
    """doc_id, n (shingles), class (hash of the set) and registers of every text, and its own hash if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches):
            sets = [shingles(t, hashes) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    **{name: batch.column(name) for name in own},
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "class": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    "registers": pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                }
            )

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    own = ["doc_id"]
    if text_hash:
        own, read = [*own, "text_hash"], read.withColumn("text_hash", F.xxhash64("text"))
    return read.mapInArrow(run, ", ".join(f"{name} long" for name in own) + ", n long, class binary, registers binary")


def bands(classes: DataFrame) -> DataFrame:
    """node and key for every band of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, BUCKETS // BAND, BAND)
            key = np.broadcast_to(np.arange(1, BUCKETS // BAND + 1, dtype=np.uint64), regs.shape[:2]) * MIX
            for k in range(BAND):
                key = (key ^ regs[:, :, k]) * STEP
                key ^= key >> np.uint64(31)
            node = np.repeat(batch.column(0).to_numpy(), BUCKETS // BAND)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(key.ravel().view(np.int64))], ["node", "key"])

    return classes.select("node", "registers").mapInArrow(run, "node long, key long")


def in_order(pairs: DataFrame) -> DataFrame:
    """Each pair once, the smaller node first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that can reach the threshold, with their estimate."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            regs = [np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, BUCKETS) for i in (4, 5)]
            value = estimate(*regs, n_a, n_b)
            least = np.minimum(n_a, n_b)
            error = np.sqrt(percent * (100 - percent) / np.minimum(least, BUCKETS)) / 100
            keep = (value >= percent / 100 - ERRORS * error) | (least <= SURE_SIZE)
            arrays = [batch.column(0), batch.column(1), pa.array(value)]
            yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "similar"]).filter(pa.array(keep))

    return both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long, similar double")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("set_b"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def labelled(rows: DataFrame, node: str, comps: DataFrame, name: str = "comp") -> DataFrame:
    """Adds the component of a node, which is its own one if ``comps`` doesn't have it."""
    known = comps.select(F.col("node").alias(node), F.col("comp").alias(name))
    return rows.join(known, node, "left").withColumn(name, F.coalesce(name, node))


def early_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """h, node, n and place: the shingles by which a set (node and hashes) meets similar ones.

    A set's shingles are put in one order for all, the rarest first. If two sets are similar enough,
    their first common shingle comes early in both: what stands before it is in one of them only. So
    shingles whose place leaves too few behind them for any partner are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 20):
            found = [np.frombuffer(x.as_buffer(), "<i8") for x in batch.column(1)]
            sizes = list(map(len, found))
            node, n = np.repeat(batch.column(0).to_numpy(), sizes), np.repeat(sizes, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n), pa.array(np.concatenate(found))], ["node", "n", "h"])

    each = landed(sets.select("node", "hashes").mapInArrow(run, "node long, n long, h long"), "shingles")
    holders = F.bit_xor(F.xxhash64("node")).alias("holders")
    often = each.groupBy("h").agg(F.count("*").alias("often"), holders).where("often > 1")
    # Shingles of one set only come first for it and meet nobody: their number is all that counts.
    shared = each.join(often, "h")
    order = Window.partitionBy("node").orderBy("often", "h")
    placed = shared.withColumn("place", F.row_number().over(order)).join(
        shared.groupBy("node").agg(F.count("*").alias("in_common")), "node"
    )
    placed = placed.withColumn("place", F.col("place") + F.col("n") - F.col("in_common"))
    early = placed.where(100 * (F.col("n") - F.col("place") + 1) >= percent * F.col("n"))
    # Shingles that the same sets hold bring the same pairs: the first of them is enough.
    same = early.groupBy(F.xxhash64("often", "holders").alias("h"), "node", "n")
    return landed(same.agg(F.min("place").alias("place")), "early")


def least_own(early: DataFrame) -> DataFrame:
    """Pairs (a, b) of each node and, per shingle, the node that has it earliest."""
    first = early.groupBy("h").agg(F.min_by("node", F.struct("place", "node")).alias("b"))
    return early.join(first, "h").select(F.col("node").alias("a"), "b")


def prefix_pairs(early: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of different components that may be similar enough.

    Sets meet by their early shingles, and only where the two places leave room for enough common
    ones. Shingles that a group shares come late for all who differ much from it. Of a shingle's
    sets, those of its main component don't meet each other.
    """
    early = labelled(early, "node", comps)
    main = (
        early.groupBy("h", "comp")
        .agg(F.count("*").alias("m"))
        .groupBy("h")
        .agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count("*").alias("comps"))
        .where("comps > 1")
        .select("h", "main")
    )
    rows = landed(early.join(main, "h"), "meeting")
    side = lambda x: rows.select("h", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "comp", "n", "place", "main")])
    room = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1
    meets = (
        (F.col("comp_a") != F.col("comp_b"))
        & ((F.col("comp_b") == F.col("main_b")) | (F.col("node_a") < F.col("node_b")))
        & (100 * room >= percent * (F.col("n_a") + F.col("n_b") - room))
    )
    return side("a").where("comp_a <> main_a").join(side("b"), "h").where(meets).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def whole_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and hashes (the whole shingle set) of the nodes given, from one document of each class."""
    wanted = classes.join(nodes, "node").select("node", "class", F.col("rep").alias("wanted"))
    read = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # The wanted side is the small one: hashing it spares sorting the texts.
    read = read.join(wanted.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("wanted")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches):
            sets = [shingles(t, hashes).tobytes() for t in batch.column(0).to_pylist()]
            # An id may be repeated with another text.
            keep = [xxhash.xxh3_128_digest(s) == c for s, c in zip(sets, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sets, pa.binary())], ["node", "hashes"]).filter(pa.array(keep, pa.bool_()))

    found = read.select("text", "node", "class").mapInArrow(run, "node long, hashes binary")
    return found


def crossing(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components as far as known."""
    out = labelled(labelled(pairs, "a", comps, "comp_a"), "b", comps, "comp_b")
    return out.where("comp_a <> comp_b").select(pairs.columns)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, by_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept; ``by_text`` adds text_hash and component.

    ``component`` numbers the components, which may share a component_id if ids repeat with other
    texts; it is null for texts without shingles.

    Null, empty and blank texts have no shingles and are components of their own. Rows that repeat a
    text are in one component; rows that repeat an id with another text count as documents of their
    own under that id, and repeated rows each give a row. A null id is no candidate for the
    component's smallest one. Other columns are not read; an empty table gives none.
    """
    rows = landed(sketches(docs, by_text), "sketches")
    classes = landed(
        rows.where("n > 0")
        .groupBy("class")
        .agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("registers").alias("registers"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    banded = landed(bands(classes), "bands")
    # Pivots: the ends of an order of the nodes that is another one for every bucket.
    mixed = F.col("node").bitwiseXOR(F.shiftrightunsigned("key", 1))
    buckets = (
        banded.groupBy("key")
        .agg(F.count("*").alias("size"), F.min(mixed).alias("low"), F.max(mixed).alias("high"))
        .where("size > 1")
    )
    members = landed(banded.join(buckets, "key"), "members")
    small = members.where(F.col("size") <= ALL_MEET).select("key", "node")
    large = members.where(F.col("size") > ALL_MEET)
    meet = small.select("key", F.col("node").alias("a")).join(small.select("key", F.col("node").alias("b")), "key").where("a < b")
    pivot = lambda c: F.col(c).bitwiseXOR(F.shiftrightunsigned("key", 1))
    stars = large.select(F.col("node").alias("a"), F.explode(F.array(pivot("low"), pivot("high"))).alias("b"))
    met = landed(likely(in_order(meet.select("a", "b")), classes, percent), "pairs")
    starred = landed(likely(in_order(stars), classes, percent), "pairs")
    pairs = met.union(starred)

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(large.select("node")).distinct()
    sets = landed(whole_sets(docs, classes, nodes).dropDuplicates(["node"]), "sets")
    # Of each class its likeliest partner, and of its likely ones the partner with most partners.
    both = pairs.union(pairs.select("b", "a", "similar"))
    degree = both.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("degree"))
    chosen = both.join(degree, "b").groupBy("a").agg(
        F.max_by("b", F.struct("similar", "degree", -F.col("b"))).alias("near"),
        F.max_by("b", F.struct(F.col("similar") >= percent / 100, "degree", -F.col("b"))).alias("hub"),
    )
    first = in_order(chosen.select("a", F.explode(F.array("near", "hub")).alias("b")))
    links = landed(confirmed(first, sets, percent), "links")
    comps = connected_components(links)

    held = labelled(large.select("key", "node"), "node", comps)
    mixed_keys = held.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most")
    open_nodes = held.join(mixed_keys.select("key"), "key", "left_semi").select("node").distinct()
    early = early_shingles(sets.join(open_nodes, "node", "left_semi"), percent)
    near = crossing(in_order(least_own(early)), comps)
    links = links.union(landed(confirmed(likely(near, classes, percent), sets, percent), "links"))
    comps = connected_components(links)
    across = prefix_pairs(early, comps, percent)
    rest = crossing(met, comps).select("a", "b").union(likely(in_order(across), classes, percent).select("a", "b"))
    more = landed(confirmed(in_order(rest), sets, percent), "links")
    if more.limit(1).count():
        comps = connected_components(links.union(more))

    named = classes.join(comps, "node", "left").select("class", "rep", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_class = named.join(least, "comp").select("class", "component_id", F.col("comp").alias("component"))
    added = ["text_hash", "component"] if by_text else []
    out = rows.select("doc_id", "n", "class", *added[:1]).join(of_class, "class", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
        *added,
    )
