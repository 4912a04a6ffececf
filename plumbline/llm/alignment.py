"""Alignment of two tokenizers on the bytes of every text, each distinct text once.

1. Texts are grouped by the whole text; a group is a distinct text and its multiplicity. Copies
   merge before the shuffle, so a text that a third of all documents share is one row per task.
2. Each distinct text is encoded by both tokenizers and aligned: byte offsets where a token of
   either ends cut it into groups, and the two tokens that end there are linked. Its measures and
   its links are stored.
3. A pair's count is its links times the multiplicity of their texts, added up. What is common is
   held by the workers as arrays: at most ``COMMON`` pairs, each with at least one link in that
   many. The links of all other pairs go to their counts by a shuffle; no pair among them has
   more than one link in ``COMMON``.
4. Measures go back to the documents by the digest of their text. Those of texts with at least one
   document in ``FREQUENT`` are few and sent to all tasks; the others are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import frame_of, landed, pieces
from plumbline.llm.encoders import byte_pairs, piece_model, unpacked

#: A pair with one link in so many is common; so there are at most as many common pairs.
COMMON = 100_000
#: A text of one document in so many is frequent; so there are at most as many frequent texts.
FREQUENT = 1_000
#: A pair is one number: the id of A times this, plus the id of B.
STRIDE = 1 << 32

MEASURES_DDL = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class Aligner:
    """Both tokenizers, the bytes their ids stand for, and the ids as text."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = byte_pairs(path_a, plain=True), piece_model(path_b)
        self.bytes_a, self.bytes_b = self.a.token_bytes(), self.b.token_bytes()
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        written = lambda table, marks: np.array([f"{i}{m}" for i in range(len(table)) for m in marks], object)
        # An id inside its side of a group, and the last one of it.
        self.text_a, self.text_b = written(self.bytes_a, ",|"), written(self.bytes_b, ",;")

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides; None where either side's bytes are not those of a space and the text."""
        out = []
        for text, a, b in zip(texts, self.a.ids(texts, spaced=True), self.b.ids(texts), strict=True):
            a, b, whole = unpacked(a), unpacked(b), b" " + text.encode()
            same = all(
                b"".join(map(table.__getitem__, ids.tolist())) == whole
                for ids, table in ((a, self.bytes_a), (b, self.bytes_b))
            )
            out.append((a, b) if text and same else None)
        return out

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
        """Places of the linked tokens of both sides, and the groups written out.

        No token is empty, so a common end is the end of one token of either side: one link a group.
        """
        _, at_a, at_b = np.intersect1d(np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b]), assume_unique=True, return_indices=True)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[at_a], last_b[at_b] = 1, 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # A token of A stands after the tokens of B of earlier groups, one of B after those of A of its own.
        ends_a, ends_b = np.concatenate([[0], at_a + 1]), np.concatenate([[0], at_b + 1])
        line = np.empty(len(a) + len(b), object)
        line[np.arange(len(a)) + ends_b[group_a]] = self.text_a[2 * a.astype(np.int64) + last_a]
        line[np.arange(len(b)) + ends_a[group_b + 1]] = self.text_b[2 * b.astype(np.int64) + last_b]
        return at_a, at_b, "".join(line.tolist())[:-1]


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def aligned(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Distinct texts with their multiplicity to digest, copies, measures, and distinct pairs with their links."""
    schema = pa.schema(
        [("digest", pa.binary()), ("copies", pa.int64())]
        + [(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
        + [("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("links", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in pieces(batches, 1 << 20):
            rows = []
            lines = batch.column(0).to_pylist()
            for text, copies, ids in zip(lines, batch.column(1).to_pylist(), both.encode(lines), strict=True):
                digest = hashlib.sha256(text.encode()).digest()
                if ids is None:
                    rows.append((digest, copies, 0, 0, 0, 0, "", [], []))
                    continue
                a, b = ids
                at_a, at_b, groups = both.align(a, b)
                pairs, links = np.unique(a[at_a].astype(np.int64) * STRIDE + b[at_b], return_counts=True)
                sha = hashlib.sha256(groups.encode()).hexdigest()
                rows.append((digest, copies, len(a), len(b), len(at_a), len(at_a), sha, pairs, links))
            yield frame_of(schema, dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    return texts.mapInArrow(run, f"digest binary, copies long, {MEASURES_DDL}, pairs array<long>, links array<long>")


def pair_counts(found: DataFrame) -> DataFrame:
    """Every linked pair with its count and whether no pair of the same id of B has more: pair, count, best."""
    schema = pa.schema([("pair", pa.int64()), ("count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, pairs, links = batch.columns
            times = np.repeat(copies.to_numpy(), pairs.value_lengths().to_numpy(zero_copy_only=False))
            known, of = np.unique(pairs.flatten().to_numpy(), return_inverse=True)
            sums = np.zeros(len(known), np.int64)
            np.add.at(sums, of, links.flatten().to_numpy() * times)
            yield frame_of(schema, {"pair": known, "count": sums})

    summed = found.select("copies", "pairs", "links").mapInArrow(run, "pair long, count long")
    counts = landed(summed.groupBy("pair").agg(F.sum("count").alias("count")), "pairs")
    # At most one row per id of B.
    of_b = F.pmod("pair", F.lit(STRIDE)).alias("b")
    most = counts.groupBy(of_b).agg(F.max("count").alias("most"))
    return counts.withColumn("b", of_b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def pair_measures(found: DataFrame, counts: DataFrame, common: int = COMMON) -> DataFrame:
    """Of each distinct text: digest, n_best, count_sum."""
    total = counts.agg(F.sum("count").alias("n")).first()["n"] or 0
    # Proven bound: each has total / common links, so there are at most `common` of them.
    is_common = F.col("count") * common >= F.lit(total)
    held = np.array([tuple(r) for r in counts.where(is_common).collect()], np.int64).reshape(-1, 3)
    held = held[held[:, 0].argsort()]
    schema = pa.schema(
        [("digest", pa.binary()), ("n_best", pa.int64()), ("count_sum", pa.int64())]
        + [("pairs", pa.list_(pa.int64())), ("links", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            lists = (batch.column(i).to_pylist() for i in (1, 2))
            for digest, pairs, links in zip(batch.column(0).to_pylist(), *lists, strict=True):
                pairs, links = np.array(pairs, np.int64), np.array(links, np.int64)
                at = np.minimum(np.searchsorted(held[:, 0], pairs), max(len(held) - 1, 0))
                hit = held[at, 0] == pairs if len(held) else np.zeros(len(pairs), bool)
                of, n = held[at[hit]], links[hit]
                rows.append((digest, int(of[:, 2] @ n), int(of[:, 1] @ n), pairs[~hit], links[~hit]))
            yield frame_of(schema, dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    ddl = "digest binary, n_best long, count_sum long, pairs array<long>, links array<long>"
    here = landed(found.select("digest", "pairs", "links").mapInArrow(run, ddl), "common")
    rare = here.select("digest", F.explode(F.arrays_zip("pairs", "links")).alias("p"))
    rare = rare.select("digest", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))
    there = rare.join(counts.where(~is_common).hint("shuffle_hash"), "pair").select(
        "digest", (F.col("best").cast("long") * F.col("links")).alias("n_best"), (F.col("count") * F.col("links")).alias("count_sum")
    )
    both = here.select("digest", "n_best", "count_sum").unionByName(there)
    return both.groupBy("digest").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def with_measures(docs: DataFrame, measures: DataFrame, total: int, frequent: int = FREQUENT) -> DataFrame:
    """doc_id with the measures of its text; zeros and an empty groups_sha256 without one."""
    names = [c for c in measures.columns if c not in ("digest", "copies")]
    often = F.col("copies") * frequent >= F.lit(total)
    # Proven bound: each stands for total / frequent documents, so there are at most `frequent` of them.
    few = F.broadcast(measures.where(often).select("digest", F.struct(*names).alias("here")))
    rest = measures.where(~often).select("digest", F.struct(*names).alias("there")).hint("shuffle_hash")
    met = docs.join(few, "digest", "left")
    # Documents that have met theirs, or have no text, take no part in the shuffle by digest.
    open_ = met.where("here IS NULL AND digest IS NOT NULL").drop("here").join(rest, "digest", "left")
    done = met.where("here IS NOT NULL OR digest IS NULL").select("doc_id", F.col("here").alias("found"))
    both = done.unionByName(open_.select("doc_id", F.col("there").alias("found")))
    zero = [F.coalesce(F.col(f"found.{n}"), F.lit("" if n == "groups_sha256" else 0)).alias(n) for n in names]
    return both.select("doc_id", *zero)


def align_texts(docs: DataFrame, path_a: str, path_b: str, common: int = COMMON, frequent: int = FREQUENT) -> DataFrame:
    """How the tokens of two tokenizers agree on each text.

    ``path_a`` is a byte-level BPE file, given a space and the text, ``path_b`` a piece model that puts the
    space itself; both must exist on every worker. Returns doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256, one row per row of ``docs``. A null or empty text, and one whose bytes either
    side doesn't give back, has zeros and ''. Equal texts have equal measures; every one of their rows counts
    in the pairs. Of pairs with equal counts all are best. Rows that repeat an id, or have none, stay rows of
    their own. An empty table gives no rows. Other columns are not read. A text is encoded whole.
    """
    text = F.col("text").cast("string").alias("text")
    read = docs.select(F.col("doc_id").cast("long"), text)
    texts = read.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    found = landed(aligned(texts, path_a, path_b), "aligned")
    counts = landed(pair_counts(found), "counts")
    sums = landed(pair_measures(found, counts, common), "sums")
    measures = found.drop("pairs", "links").join(sums, "digest").select(
        "digest", "copies", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
    total = found.agg(F.sum("copies").alias("n")).first()["n"] or 0
    digest = F.when(F.col("text") != "", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    ids = landed(read.select("doc_id", digest.alias("digest")), "digests")
    return with_measures(ids, landed(measures, "measures"), total, frequent)
