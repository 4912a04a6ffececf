"""Best-fit packing of token sequences by linear grouping.

Lengths are whole numbers up to the capacity, so all that the plan needs is how many pieces of each
length there are: at most ``capacity`` numbers, however many documents. On them the driver

1. sorts the large lengths and cuts them into groups of equal cardinality, each rounded up to its
   largest length,
2. finds configurations of those few sizes that use the fewest sequences: the linear programme over
   all configurations, solved by column generation, rounded down,
3. puts the actual lengths in the place of the rounded ones, the longest first,
4. fills what is left over, large ones from the rounding and all small ones, by best fit from the
   longest down. Equal sequences are handled together as one class,
5. takes apart the sequences in which rounding has left more than ``MOST_ROOM`` and packs what they
   held by best fit, where that takes fewer.

The plan is a list of blocks: ranks ``first`` to ``first + n`` of a length go to consecutive
sequences at one offset. Its size depends on the capacity alone. Pieces get their ranks within
their length in Spark, by hashed buckets of about ``BUCKET_ROWS`` rows and the sums before them.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import frame_of, landed, pieces
from plumbline.llm.encoders import IDS, byte_pairs

#: A length above this share of the capacity is large.
LARGE = 1 / 3
#: Groups of equal cardinality, and so sizes of the linear programme.
GROUPS = 256
#: Most pivots of the linear programme; every one of its tableaus is a usable plan.
PIVOTS = 20_000
#: Sequences left with more room than this are packed anew.
MOST_ROOM = 4
#: Pieces of one length are ranked in buckets of about this many.
BUCKET_ROWS = 1_000

PIECE = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass
class Sequences:
    """A number of sequences that hold the same lengths: (length, how many of it) in order of offset."""

    count: int
    room: int
    slots: list[tuple[int, int]]

    def take(self, count: int) -> Sequences:
        """Split off some of the sequences."""
        self.count -= count
        return Sequences(count, self.room, list(self.slots))

    def add(self, length: int, times: int) -> Sequences:
        self.slots.append((length, times))
        self.room -= length * times
        return self


def grouped(large: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Runs (length, count), longest first, cut into groups of equal cardinality."""
    total = sum(n for _, n in large)
    most = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = [[]]
    free = most
    for length, n in large:
        while n:
            if not free:
                out.append([])
                free = most
            part = min(n, free)
            out[-1].append((length, part))
            n, free = n - part, free - part
    # Groups rounded up to the same size are one.
    merged: list[list[tuple[int, int]]] = []
    for group in out:
        if merged and group and merged[-1][0][0] == group[0][0]:
            merged[-1] += group
        elif group:
            merged.append(group)
    return merged


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size, within the capacity, are worth most together. Sizes ascend.

    Each is above a third of the capacity, so a configuration is one size or two.
    """
    partners = np.searchsorted(sizes, capacity - sizes, side="right")
    best = np.concatenate([[-1], np.maximum.accumulate(worth)])
    both = worth + np.maximum(best[partners], 0)
    first = int(both.argmax())
    times = np.zeros(len(sizes))
    times[first] = 1
    if partners[first] and best[partners[first]] > 0:
        times[int(worth[: partners[first]].argmax())] += 1
    return times


def configurations(sizes: np.ndarray, demands: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (columns) and how often each is used, for the fewest sequences in total.

    The simplex method over columns made on demand; it starts with one size per sequence.
    """
    fit = capacity // sizes
    columns, inverse = np.diag(fit.astype(float)), np.diag(1.0 / fit)
    amounts = demands / fit
    for _ in range(PIVOTS):
        worth = inverse.sum(axis=0)
        column = best_configuration(sizes, worth, capacity)
        if column @ worth <= 1 + 1e-9:
            break
        direction = inverse @ column
        usable = direction > 1e-10
        ratios = np.where(usable, amounts / np.where(usable, direction, 1), np.inf)
        out = int(ratios.argmin())
        step = ratios[out]
        amounts -= step * direction
        amounts[out] = step
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        columns[:, out] = column
    return columns.astype(int), np.maximum(amounts, 0)


def substituted(groups: list[list[tuple[int, int]]], capacity: int) -> tuple[list[Sequences], dict[int, int]]:
    """Sequences of the rounded-down programme with actual lengths, and the lengths left over."""
    if not groups:
        return [], {}
    groups = groups[::-1]  # ascending sizes
    sizes = np.array([g[0][0] for g in groups])
    demands = np.array([sum(n for _, n in g) for g in groups], float)
    columns, amounts = configurations(sizes, demands, capacity)
    runs = [list(g) for g in groups]  # each longest first
    left = [sum(n for _, n in g) for g in groups]

    def next_of(group: int, n: int) -> list[tuple[int, int]]:
        """The next n actual lengths of a group, as runs."""
        taken = []
        while n:
            length, have = runs[group][0]
            part = min(n, have)
            taken.append((length, part))
            n -= part
            if part == have:
                runs[group].pop(0)
            else:
                runs[group][0] = (length, have - part)
        return taken

    made: list[Sequences] = []
    for column, amount in zip(columns.T, amounts, strict=True):
        uses = [(g, int(k)) for g, k in enumerate(column) if k]
        count = int(amount + 1e-6)
        count = min([count, *[left[g] // k for g, k in uses]])
        if not count:
            continue
        lanes = []
        for g, k in uses:
            left[g] -= k * count
            lanes += [next_of(g, count) for _ in range(k)]
        # Along the count sequences each lane changes its length now and then: cut there.
        places = sorted({0, count} | {int(p) for lane in lanes for p in np.cumsum([n for _, n in lane])})
        ends = [np.cumsum([n for _, n in lane]).tolist() for lane in lanes]
        for a, b in zip(places, places[1:], strict=False):
            lengths = [lane[bisect_left(end, a + 1)][0] for lane, end in zip(lanes, ends, strict=True)]
            made.append(Sequences(b - a, capacity - sum(lengths), [(x, 1) for x in lengths]))
    rest: dict[int, int] = {}
    for lengths in runs:
        for length, n in lengths:
            rest[length] = rest.get(length, 0) + n
    return made, rest


def best_fit(made: list[Sequences], counts: dict[int, int], capacity: int) -> list[Sequences]:
    """Add lengths from the longest down, each where the least room is left that holds it.

    All sequences with the same contents are filled at once: with equal pieces, best fit goes on in the
    sequence it has begun until that is full.
    """
    by_room: dict[int, list[Sequences]] = {}
    for s in made:
        by_room.setdefault(s.room, []).append(s)
    rooms = sorted(by_room)

    def file(s: Sequences) -> None:
        if s.room not in by_room:
            by_room[s.room] = []
            rooms.insert(bisect_left(rooms, s.room), s.room)
        by_room[s.room].append(s)

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                file(Sequences(max(1, n // (capacity // length)), capacity, []))
                continue
            room = rooms[at]
            s = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            each = room // length
            full = min(s.count, n // each)
            filled, one = s.take(full), None
            n -= full * each
            if s.count and n:
                # Fewer are left than one sequence holds.
                one = s.take(1).add(length, n)
                n = 0
            for part in (filled.add(length, each) if full else None, one, s):
                if part is not None and part.count:
                    file(part)
    return [s for kept in by_room.values() for s in kept]


def tightened(made: list[Sequences], capacity: int) -> list[Sequences]:
    """The same lengths in fewer sequences, if taking apart those with room helps; else as they were."""
    loose: dict[int, int] = {}
    for s in made:
        if s.room > MOST_ROOM:
            for length, each in s.slots:
                loose[length] = loose.get(length, 0) + each * s.count
    anew = [s for s in made if s.room <= MOST_ROOM] + best_fit([], loose, capacity)
    return min(anew, made, key=lambda found: sum(s.count for s in found))


def packing_plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Blocks by length and first rank: n ranks, ``each`` of them in a sequence, from ``sequence``, ``offset`` on."""
    whole = counts.get(capacity, 0)
    made = [Sequences(whole, 0, [(capacity, 1)])] if whole else []
    large = sorted(((x, n) for x, n in counts.items() if LARGE * capacity < x < capacity and n), reverse=True)
    placed, rest = substituted(grouped(large, GROUPS), capacity)
    for x, n in counts.items():
        if x <= LARGE * capacity and n:
            rest[x] = rest.get(x, 0) + n
    blocks, sequence, ranks = [], 0, dict.fromkeys(counts, 0)
    for s in [*made, *tightened(best_fit(placed, rest, capacity), capacity)]:
        offset = 0
        for length, each in s.slots:
            blocks.append((length, ranks[length], each, sequence, offset))
            ranks[length] += s.count * each
            offset += length * each
        sequence += s.count
    if ranks != counts:
        raise ValueError("the plan doesn't hold every piece once")
    table = np.array(sorted(blocks), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "offset"), table.T, strict=True))


def tokenized(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_pairs(tokenizer_path, plain=False)
        end = np.array([end_id], IDS).tobytes()
        for batch in pieces(batches):
            rows = []
            found = model.ids([t or "" for t in batch.column(1).to_pylist()])
            for doc_id, ids in zip(batch.column(0).to_pylist(), found, strict=True):
                ids = memoryview(ids + end)
                total = len(ids) // IDS.itemsize
                starts = [0, *range(total % capacity or capacity, total, capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], total], strict=True)):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a * IDS.itemsize : b * IDS.itemsize])))
            yield frame_of(PIECE, dict(zip(PIECE.names, zip(*rows, strict=True), strict=True)))

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return read.mapInArrow(run, PIECE_DDL)


def ranked(parts: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Number the pieces of each length from 0, in ``rank``. ``parts`` is a stored table with distinct ``row``.

    A length with many pieces is ranked in many buckets, so no length lands in one task.
    """
    buckets = [max(1, -(-counts.get(i, 0) // BUCKET_ROWS)) for i in range(max(counts, default=0) + 1)]
    of_length = F.element_at(F.lit(np.array(buckets, np.int64)), F.col("length").cast("int") + 1)
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("row"), of_length))
    # One row per bucket: the largest length has as many as its pieces / BUCKET_ROWS.
    so_far = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy("length", "bucket").count().select(
        "length", "bucket", F.coalesce(F.sum("count").over(so_far), F.lit(0)).alias("before")
    )
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row"))
    return parts.join(before.hint("shuffle_hash"), ["length", "bucket"]).withColumn("rank", F.col("before") + inside - 1)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Put all documents into few sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document
    is its ids and ``end_id``; only one of more than ``capacity`` ids is cut, into pieces of that length
    after a first one that may be shorter. A null or empty text is the end id alone. Rows that repeat an
    id, or have none, are documents of their own; pieces of equal length are interchangeable, so which of
    them meet is arbitrary. An empty table gives no rows. Other columns are not read, whatever they are
    called. ``tokenizer_path`` must exist on every worker.
    """
    found = tokenized(docs, tokenizer_path, capacity, end_id)
    # Numbered as they are written: the stored numbers never change.
    parts = landed(found.withColumn("row", F.monotonically_increasing_id()), "pieces")
    # At most one number per possible length.
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    plan = packing_plan(counts, capacity)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Length and first rank as one ascending number.
        span = 1 + max(counts.values(), default=0)
        keys = plan["length"] * span + plan["first"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            along, again = np.divmod(rank - plan["first"][at], plan["each"][at])
            sequence = pa.array(plan["sequence"][at] + along)
            offset = pa.array(plan["offset"][at] + again * length)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], sequence, offset], names=names)

    numbered = ranked(parts, counts).select(*names[:5], F.col("rank").cast("long"))
    return numbered.mapInArrow(place, f"{PIECE_DDL}, sequence_id long, offset long")
