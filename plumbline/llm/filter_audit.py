"""How document filters interact, from sorted posting lists of the ids that fail each of them.

Every filter keeps, per part and id range, the ascending list of the ids that fail it; so do the
good and the toxic documents. The number of documents a chain of filters has removed is the size of
the union of their lists, found by a k-way merge that gallops: from the list with the smallest head
all ids before the next head are counted at once, their end found by doubling steps. Sizes of ranges
add up to those of the part, and all that is asked of any order of the filters follows from the 32
sizes: a removal is the difference of two unions.

A range holds at most ``RANGE_ROWS`` documents of one part, and a part has as many ranges as it needs.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import frame_of, landed, pieces

#: The filters, one letter each: the bits of a mask, in this order.
FILTERS = "ABCDE"
FULL = (1 << len(FILTERS)) - 1
#: Documents of one id range, at most.
RANGE_ROWS = 1 << 15

UPPER = bytes(range(65, 91))
SYMBOL = re.compile(rb"[#$%&*|]")

FAILING = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("digest", pa.binary())])
LISTS = [*FILTERS, "good", "toxic"]
POSTINGS_DDL = "part string, first_id long, copies long, n long, " + ", ".join(f"`{name}` array<long>" for name in LISTS)
POSTINGS = pa.schema(
    [("part", pa.string()), ("first_id", pa.int64()), ("copies", pa.int64()), ("n", pa.int64())]
    + [(name, pa.list_(pa.int64())) for name in LISTS]
)


def own_failures(text: bytes) -> int:
    """Mask of the filters A to D that a text fails."""
    words = text.split()
    few = len(words) < 200
    same = 100 * len(set(words)) < 50 * len(words)
    # Code points are the bytes that don't continue one.
    points = len(text) if text.isascii() else len(text.decode())
    loud = 100 * (len(text) - len(text.translate(None, UPPER))) > 3 * points
    return few | same << 1 | loud << 2 | (SYMBOL.search(text) is not None) << 3


def failing(docs: DataFrame) -> DataFrame:
    """Which filters documents fail: doc_id, part, mask, and how many rows are alike in that.

    A document fails E if a smaller id has its text. Firsts are one row per distinct text, merged before
    the shuffle; documents meet them by text and id together, so copies of one text spread over all tasks.
    Rows that repeat an id and a text, or have no id, are merged before they meet anything.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield frame_of(
                FAILING,
                {
                    "doc_id": batch.column(0),
                    "part": batch.column(1),
                    "mask": [own_failures(t) for t in texts],
                    "digest": [hashlib.sha256(t).digest() for t in texts],
                },
            )

    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    read = docs.select(F.col("doc_id").cast("long"), part, F.col("text").cast("string"))
    found = landed(read.mapInArrow(run, "doc_id long, part string, mask int, digest binary"), "failing")
    merged = found.groupBy("digest", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("copies"))
    firsts = found.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL")
    firsts = firsts.withColumn("is_first", F.lit(True))
    met = merged.join(firsts.hint("shuffle_hash"), ["digest", "doc_id"], "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("is_first").isNull(), FULL + 1 >> 1).otherwise(0)
    failed = met.select("doc_id", "part", F.col("mask").bitwiseOR(copy).cast("int").alias("mask"), "copies")
    return failed.groupBy("part", "doc_id", "mask").agg(F.sum("copies").alias("copies"))


def postings(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """The sorted lists: one row per part and id range.

    Ids are distinct within a range. Rows that repeat an id within a part, and rows without one, get a
    range of their own, with ``copies`` for equal ones.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    no = F.lit(False)
    rows = failed.join(marks, "doc_id", "left").select(
        "part", "doc_id", "mask", "copies", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")
    )
    rows = landed(rows, "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, lists = None, 0, [[] for _ in LISTS]
        out: list[tuple] = []

        def close() -> None:
            nonlocal n, lists
            if n:
                out.append((part, first, 1, n, *lists))
            n, lists = 0, [[] for _ in LISTS]

        first = last = None
        for batch in batches:
            for p, doc_id, mask, copies, good, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                marks = mask | good << len(FILTERS) | toxic << len(FILTERS) + 1
                if doc_id is None or copies > 1 or (p == part and doc_id == last):
                    own = [[doc_id or 0] if marks >> k & 1 else [] for k in range(len(LISTS))]
                    out.append((p, doc_id, copies, 1, *own))
                    continue
                if p != part or n == RANGE_ROWS:
                    close()
                    part, first = p, doc_id
                last, n = doc_id, n + 1
                for k, ids in enumerate(lists):
                    if marks >> k & 1:
                        ids.append(doc_id)
            if out:
                yield frame_of(POSTINGS, dict(zip(POSTINGS.names, zip(*out, strict=True), strict=True)))
                out.clear()
        close()
        if out:
            yield frame_of(POSTINGS, dict(zip(POSTINGS.names, zip(*out, strict=True), strict=True)))

    # Ranges of (part, id) of equal size; equal ones among them differ in their mask.
    dealt = rows.repartitionByRange("part", "doc_id", "mask").sortWithinPartitions("part", "doc_id", "mask")
    return dealt.mapInArrow(run, POSTINGS_DDL)


def gallop(ids: list[int], target: int, start: int) -> int:
    """First place from ``start`` on whose id is not below the target, by doubling steps."""
    step, end = 1, len(ids)
    while start + step < end and ids[start + step] < target:
        start += step
        step *= 2
    return bisect_left(ids, target, start, min(start + step + 1, end))


def union_size(lists: list[list[int]]) -> int:
    """Distinct ids of some ascending lists, merged all at once."""
    heads = [(ids[0], k, 0) for k, ids in enumerate(lists) if ids]
    heapify(heads)
    n, seen = 0, None
    while len(heads) > 1:
        head, k, at = heads[0]
        n += head != seen
        ids = lists[k]
        # The smallest of the other heads stands in one of the two places below the top.
        rival = min(heads[1][0], heads[2][0]) if len(heads) > 2 else heads[1][0]
        to = max(gallop(ids, rival, at), at + 1)
        n += to - at - 1
        seen = ids[to - 1]
        if to < len(ids):
            heapreplace(heads, (ids[to], k, to))
        else:
            heappop(heads)
    for head, k, at in heads:
        n += len(lists[k]) - at - (head == seen)
    return n


def common(ids: list[int], others: list[int]) -> list[int]:
    """Ids of two ascending lists that are in both; the shorter one gallops through the longer."""
    if len(ids) > len(others):
        ids, others = others, ids
    out, at = [], 0
    for i in ids:
        at = gallop(others, i, at) if at < len(others) else at
        if at == len(others):
            break
        if others[at] == i:
            out.append(i)
    return out


def union_sizes(lists: list[list[int]]) -> list[int]:
    """Sizes of the unions of all subsets of the filters' lists, by mask."""
    return [union_size([ids for k, ids in enumerate(lists) if mask >> k & 1]) for mask in range(FULL + 1)]


def part_sizes(lists: DataFrame) -> DataFrame:
    """Per part: documents, and by mask of filters the documents, good and toxic ones that any of them removes."""
    names = ["removed", "good", "toxic"]
    ddl = "part string, n long, " + ", ".join(f"{name} array<long>" for name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = [c[i].as_py() for c in batch.columns]
                part, copies, n, ids, marked = row[0], row[2], row[3], row[4 : 4 + len(FILTERS)], row[-2:]
                kinds = [union_sizes(ids), *[union_sizes([common(x, y) for x in ids]) for y in marked]]
                total = sums.setdefault(part, [0, *[[0] * (FULL + 1) for _ in names]])
                total[0] += n * copies
                for have, new in zip(total[1:], kinds, strict=True):
                    have[:] = [a + b * copies for a, b in zip(have, new, strict=True)]
        if sums:
            columns = [list(sums), *zip(*sums.values(), strict=True)]
            schema = pa.schema([("part", pa.string()), ("n", pa.int64())] + [(name, pa.list_(pa.int64())) for name in names])
            yield frame_of(schema, dict(zip(["part", "n", *names], columns, strict=True)))

    # Every task has added up its ranges; here one row per part and task is added.
    sums = [F.array(*[F.sum(F.col(name)[k]) for k in range(FULL + 1)]).alias(name) for name in names]
    return lists.mapInArrow(run, ddl).groupBy("part").agg(F.sum("n").alias("n"), *sums)


def chains() -> list[tuple[str, int, int, int]]:
    """Every order of the filters and step: order, step, mask of the earlier filters, place of this one."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            k = FILTERS.index(letter)
            out.append(("".join(order), step, before, k))
            before |= 1 << k
    return out


def audit_of(n: int, removed: list[int], good: list[int], toxic: list[int]) -> list[tuple]:
    """The rows of a part, from its union sizes."""
    gain = lambda sizes, before, k: sizes[before | 1 << k] - sizes[before]
    others, most = [FULL & ~(1 << k) for k in range(len(FILTERS))], len(FILTERS) - 1
    shapley = [0] * len(FILTERS)
    for k, rest in enumerate(others):
        for before in range(FULL + 1):
            if before & ~rest == 0:
                earlier = before.bit_count()
                shapley[k] += factorial(earlier) * factorial(most - earlier) * gain(removed, before, k)
    rows = []
    for order, step, before, k in chains():
        now = gain(removed, before, k)
        rows.append(
            (order, step, n - removed[before | 1 << k], now, removed[1 << k] - now, gain(removed, others[k], k))
            + (gain(good, before, k), gain(toxic, before, k), shapley[k])
        )
    return rows


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
AUDIT = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())] + [(c, pa.int64()) for c in COUNTS])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes at each step of each order, per part.

    Returns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley: one row per part, order and step. A null language is the part named by the empty string, a
    null text is empty. A document without an id has no smaller id beside it, so it never fails E, nor has
    it labels; rows that repeat an id count each. An id with several labels is good or toxic if one of them
    says so. Ids without a document are ignored. An empty table gives no rows. Other columns aren't read.
    """
    sizes = part_sizes(landed(postings(failing(docs), labels), "postings"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, *counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [(part, *row) for row in audit_of(*counts)]
                yield frame_of(AUDIT, dict(zip(AUDIT.names, zip(*rows, strict=True), strict=True)))

    ddl = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return sizes.mapInArrow(run, ddl)
