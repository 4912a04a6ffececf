"""Benchmark decontamination over a distributed positional inverted index.

The training texts are indexed in segments, as search engines shard an index: a segment holds a few
MB of texts, and for every term of the test set the ascending positions at which it occurs. The
index is written to the shared folder, so no lost executor rebuilds it. Each block of the test set
has an index of its own terms, for which all texts are read anew, and all blocks are in the driver. A
test window is looked up from its rarest term: that list, shifted by the term's place in the window, is intersected with the shifted list of the next rarer term, and so on; what is left are the
exact occurrences. A proximity match asks the same lists for every term of the window within
``reach`` words of the rarest one. Postings never leave their segment, so there is no shuffle and
no hot term or document.

Test sets are read in blocks of bounded bytes; a block is all that a task holds of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import landed, pieces

#: Consecutive words of a test window.
WINDOW = 13
#: Bytes of test text a task holds at once.
BLOCK_BYTES = 16 << 20
#: Bytes of training text in a segment.
SEGMENT_BYTES = 4 << 20

#: ASCII bytes that are no word byte become spaces, A-Z become a-z, all others stay.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

INDEX = (
    "segment long, doc_ids array<long>, starts array<int>, n_words array<int>, "
    "terms array<int>, postings array<binary>"
)
FOUND = (
    "segment long, row int, doc_id long, n_words long, items array<string>, near_items array<string>, "
    "spans array<struct<start:int,end:int>>"
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def packed(positions: np.ndarray) -> bytes:
    """Ascending positions as gaps, in the narrowest of 1, 2 or 4 bytes (told by the first byte)."""
    gaps = np.diff(positions, prepend=np.uint32(0))
    width = 1 if (top := gaps.max()) < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([width]) + gaps.astype(f"<u{width}").tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, f"<u{blob[0]}", offset=1), dtype=np.int64)


def occurrences(lists: list[np.ndarray]) -> np.ndarray:
    """Starts at which each of the lists holds its own place: lists[i] holds start + i."""
    order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
    starts = lists[order[0]] - order[0]
    for i in order[1:]:
        if not len(starts):
            break
        at = np.searchsorted(lists[i], starts + i)
        at[at == len(lists[i])] = 0
        starts = starts[lists[i][at] == starts + i]
    return starts


def neighbours(lists: list[np.ndarray], reach: int) -> np.ndarray:
    """Positions of the shortest list that have one of every other list within ``reach``."""
    lists = sorted(lists, key=len)
    anchors = lists[0]
    for other in lists[1:]:
        if not len(anchors):
            break
        anchors = anchors[np.searchsorted(other, anchors + reach, "right") > np.searchsorted(other, anchors - reach)]
    return anchors


class Block:
    """The windows of some test items as rows of term numbers, -1 past the end of a short item."""

    def __init__(self, items: list[tuple[str, str | None]], vocabulary: dict[bytes, int], window: int):
        rows, owners = {}, []
        for item, text in items:
            ids = [vocabulary[w] for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                key = (*ids[i : i + window], *[-1] * (window - len(ids)))
                if key not in rows:
                    rows[key] = len(owners)
                    owners.append([])
                if item not in owners[rows[key]]:
                    owners[rows[key]].append(item)
        self.windows = np.array(list(rows), np.int64).reshape(-1, window)
        self.owners = owners

    def search(self, row: dict, reach: int) -> list[tuple]:
        """Per document of a segment: items found, items with near words, spans hit."""
        starts = np.array(row["starts"], np.int64)
        found = [(set(), set(), []) for _ in starts]
        lists = dict(zip(row["terms"], row["postings"], strict=True))
        known = np.zeros(max([*lists, self.windows.max(initial=0)], default=0) + 2, bool)
        known[[*lists, -1]] = True  # the last place stands for -1
        opened: dict[int, np.ndarray] = {}

        def postings(term):
            if term not in opened:
                opened[term] = unpacked(lists[term])
            return opened[term]

        for w in np.flatnonzero(known[self.windows].all(axis=1)):
            terms = [t for t in self.windows[w].tolist() if t >= 0]
            exact = occurrences([postings(t) for t in terms])
            for d, at in zip(np.searchsorted(starts, exact, "right") - 1, exact, strict=True):
                begin = int(at - starts[d])
                found[d][0].update(self.owners[w])
                found[d][2].append((begin, begin + len(terms)))
            near = neighbours([postings(t) for t in set(terms)], reach)
            for d in np.unique(np.searchsorted(starts, near, "right") - 1):
                found[d][1].update(self.owners[w])
        return found


def joined(spans: list[tuple[int, int]]) -> list[dict]:
    """Overlapping and touching spans as one."""
    out: list[dict] = []
    for start, end in sorted(set(spans)):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def positional_index(docs: DataFrame, terms: dict[bytes, int], gap: int) -> DataFrame:
    """Segments of the positional index over every text; ``terms`` numbers the terms to keep.

    ``gap`` unused positions between documents keep matches inside them. One narrow pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, n = shared.value.get, 0
        task = TaskContext.get().partitionId()
        for batch in pieces(batches, SEGMENT_BYTES):
            starts, lengths, ids, at = [], [], [], 1
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                starts.append(at)
                lengths.append(len(words))
                ids.append(np.fromiter(map(number, words, repeat(-1)), np.int32, len(words)))
                at += len(words) + gap
            flat = np.concatenate(ids)
            place = np.arange(len(flat), dtype=np.uint32) + np.repeat(
                np.array(starts) - np.cumsum([0, *lengths[:-1]]), lengths
            ).astype(np.uint32)
            kept = flat >= 0
            flat, place = flat[kept], place[kept]
            order = np.argsort(flat, kind="stable")
            found, first = np.unique(flat[order], return_index=True)
            parts = np.split(place[order], first[1:]) if len(found) else []
            yield pa.RecordBatch.from_pydict(
                {
                    "segment": pa.array([(task << 32) + n], pa.int64()),
                    "doc_ids": pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                    "starts": pa.array([starts], pa.list_(pa.int32())),
                    "n_words": pa.array([lengths], pa.list_(pa.int32())),
                    "terms": pa.array([found.tolist()], pa.list_(pa.int32())),
                    "postings": pa.array([[packed(p) for p in parts]], pa.list_(pa.binary())),
                }
            )
            n += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, INDEX)


def lookup(index: DataFrame, block: Block, reach: int) -> DataFrame:
    """What a block of test windows matches: one row per indexed document."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                found = shared.value.search(row, reach)
                n = len(found)
                columns = {
                    "segment": pa.array([row["segment"]] * n, pa.int64()),
                    "row": pa.array(range(n), pa.int32()),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "n_words": pa.array(row["n_words"], pa.int64()),
                    "items": pa.array([sorted(f[0]) for f in found], pa.list_(pa.string())),
                    "near_items": pa.array([sorted(f[1]) for f in found], pa.list_(pa.string())),
                    "spans": pa.array(
                        [joined(f[2]) for f in found],
                        pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
                    ),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return index.mapInArrow(run, FOUND)


def test_blocks(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[str, str | None]]]:
    """The test items by block; each is of bounded size, but all are in the driver.

    A null item id is the id ``null``; items without words are left out.
    """
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"),
        F.col("text").cast("string").alias("text"),
    ).where("length(text) > 0")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    if n == 1:
        return [[tuple(r) for r in items.collect()]]
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [[tuple(r) for r in items.where(part == i).collect()] for i in range(n)]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    reach: int = 2 * WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items, spans, n_near_items, contaminated.

    ``spans`` are the hit word ranges; an item with fewer words than ``window`` is one window.
    ``contaminated`` holds from one hit word and a twentieth of the words on. Null and empty texts
    have no words and no hits; so has everything if the test set is empty. Every row gives a row,
    repeated ids too. Items with the same id count once. Other columns are not read.
    """
    blocks = test_blocks(benchmark, block_bytes)
    found = None
    for items in blocks:
        vocabulary: dict[bytes, int] = {}
        for _, text in items:
            for word in words_of(text):
                vocabulary.setdefault(word, len(vocabulary))
        index = landed(positional_index(docs, vocabulary, gap=window + reach), "positions")
        part = lookup(index, Block(items, vocabulary, window), reach)
        found = part if found is None else found.unionByName(part)
    if len(blocks) > 1:
        many = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731  one entry per block
        found = found.groupBy("segment", "row", "doc_id", "n_words").agg(
            many("items"), many("near_items"), many("spans")
        )
    # Spans of different blocks may overlap: count each word once.
    n_hit = F.expr(
        "aggregate(array_sort(spans), named_struct('upto', 0, 'n', 0L), (a, s) -> named_struct("
        "'upto', greatest(a.upto, s.end), 'n', a.n + greatest(0, s.end - greatest(a.upto, s.start))), a -> a.n)"
    )
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.array_sort(F.array_distinct("items")).alias("items"),
        "spans",
        F.size(F.array_distinct("near_items")).cast("long").alias("n_near_items"),
    ).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        "spans",
        "n_near_items",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
