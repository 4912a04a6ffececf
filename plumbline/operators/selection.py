"""The first n rows of a table by any order, chosen by refined histograms.

Order columns and row hashes become whole numbers that sort alike. The number of the n-th row is
found from counts: one histogram over all rows, then the distinct numbers of the one bin that holds
it, which are stored and narrowed until the number is exact. Rows that tie go on to the next number.
No step sorts a table, relies on how rows lie in files, or collects more than ``BINS`` numbers; equal
rows are counted, not told apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.plans.lineage import cut_lineage
from plumbline.specs import quoted

BINS = 1 << 16
#: Copies of one row that a task makes at a time.
COPIES = 100_000
#: Bytes of a text that one number holds.
CHUNK = 7

# Fixed values of the double format: least normal number, its exponent, bits of the fraction.
_LEAST, _BIAS, _FRACTION = "2.2250738585072014E-308D", 1023, 52


def double_order(value: str) -> str:
    """SQL text: a DOUBLE as a BIGINT that sorts alike: -inf to inf, then NaN; both zeros are 0."""
    size = f"abs({value})"
    guess = f"CAST(floor(log2({size})) AS INT)"
    # The logarithm may be off by one next to a power of two; halves and powers are exact.
    exponent = (
        f"(CASE WHEN {size} < pow(2D, {guess}) THEN {guess} - 1 "
        f"WHEN {size} / 2 >= pow(2D, {guess}) THEN {guess} + 1 ELSE {guess} END)"
    )
    unit = f"{1 << _FRACTION}L"
    normal = f"({exponent} + {_BIAS}) * {unit} + CAST(({size} / pow(2D, {exponent}) - 1) * {unit} AS BIGINT)"
    small = f"CAST({size} * pow(2D, 600) * pow(2D, {_BIAS - 1 + _FRACTION - 600}) AS BIGINT)"
    infinite = (2 * _BIAS + 1) << _FRACTION
    order = f"(CASE WHEN {size} = double('Infinity') THEN {infinite}L WHEN {size} < {_LEAST} THEN {small} ELSE {normal} END)"
    return f"(CASE WHEN isnan({value}) THEN {infinite + 1}L WHEN {value} < 0 THEN -{order} ELSE {order} END)"


def sort_numbers(df: DataFrame, column: str) -> Iterator[str]:
    """SQL texts of BIGINTs that sort, one after the other, as the column does: nulls first."""
    dtype, name = df.schema[column].dataType, quoted(column)
    yield f"CASE WHEN {name} IS NULL THEN 0L ELSE 1L END"
    if isinstance(dtype, T.StringType | T.BinaryType):
        data = f"CAST({name} AS BINARY)"
        piece = lambda k: f"CAST(conv(hex(rpad(substring({data}, {k * CHUNK + 1}, {CHUNK}), {CHUNK}, X'00')), 16, 10) AS BIGINT)"
        yield piece(0)
        longest = df.agg(F.max(F.expr(f"octet_length({name})"))).first()[0] or 0
        yield from (piece(k) for k in range(1, -(-longest // CHUNK)))
        yield f"CAST(octet_length({name}) AS BIGINT)"
    elif isinstance(dtype, T.FloatType | T.DoubleType):
        yield double_order(f"CAST({name} AS DOUBLE)")
    elif isinstance(dtype, T.DecimalType):
        whole = f"floor({name})"
        # 38 digits before the point fit in three numbers, those behind it in three more.
        for shift in (10**30, 10**15, 1):
            yield f"CAST(floor({whole} / {shift}BD) % {10**15}BD AS BIGINT)"
        rest = f"({name} - {whole})"
        for digits in range(15, dtype.scale + 15, 15):
            yield f"CAST(floor({rest} * CAST({10**digits}BD AS DECIMAL({min(38, digits + 1)}, 0))) % {10**15}BD AS BIGINT)"
    elif isinstance(dtype, T.DateType):
        yield f"CAST(unix_date({name}) AS BIGINT)"
    elif isinstance(dtype, T.TimestampType | T.TimestampNTZType):
        yield f"unix_micros(CAST({name} AS TIMESTAMP))"
    elif isinstance(dtype, T.IntegralType | T.BooleanType):
        yield f"CAST({name} AS BIGINT)"
    else:
        raise TypeError(f"rows can't be ordered by '{column}' of type {dtype.simpleString()}")


def hash_numbers(df: DataFrame, seed: int = 42) -> Iterator[str]:
    """A pseudo-random order of rows: two hashes of the whole row, so that only equal rows tie."""
    names = ", ".join(map(quoted, df.columns))
    for again in range(2):
        yield f"shiftrightunsigned(xxhash64({seed + again}, {names}), 1)"


@dataclass(frozen=True)
class Selection:
    """``n`` rows of ``df``: all for which ``inside`` holds, and ``quota`` of the ``ties`` equal ones at the edge."""

    df: DataFrame
    inside: str
    edge: str
    quota: int
    ties: int

    def rows(self) -> DataFrame:
        """The rows that are selected."""
        return self._with(self.df.where(self.inside), self.quota)

    def others(self) -> DataFrame:
        """The rows that aren't."""
        return self._with(self.df.where(f"NOT ({self.inside}) AND NOT ({self.edge})"), self.ties - self.quota)

    def condition(self) -> str:
        """SQL text that holds for the selected rows, but for equal rows of which only some are (``split``)."""
        return f"({self.inside}) OR ({self.edge})" if self.quota and self.quota == self.ties else self.inside

    @property
    def split(self) -> bool:
        """Whether only some of the equal rows at the edge are selected."""
        return 0 < self.quota < self.ties

    def some(self, others: bool = False) -> DataFrame | None:
        """The equal rows at the edge that are selected, or the others, where they are split."""
        return self._copies(self.ties - self.quota if others else self.quota) if self.split else None

    def _with(self, rows: DataFrame, copies: int) -> DataFrame:
        if not copies:
            return rows
        if copies == self.ties:
            return rows.unionByName(self.df.where(self.edge))
        return rows.unionByName(self._copies(copies))

    def _copies(self, copies: int) -> DataFrame:
        # Equal rows: as many copies of one of them, made in pieces by many tasks.
        one = self.df.where(self.edge).limit(1)
        spark = self.df.sparkSession
        parts = spark.range(-(-copies // COPIES)).select(
            F.explode(F.expr(f"sequence(1L, least({COPIES}L, {copies}L - id * {COPIES}L))")).alias("_copy")
        )
        return parts.join(F.broadcast(one)).select(*[one[c] for c in self.df.columns])


def first_rows(df: DataFrame, n: int | None, numbers: Iterator[str], share: float | None = None) -> Selection:
    """Select the first ``n`` rows in the order of ``numbers``, or a ``share`` of them, one at least.

    ``df`` should read a stored table; each number that decides costs two scans of the columns it needs.
    """
    inside, edge = "FALSE", "TRUE"
    ties = None
    for number in numbers:
        number = f"coalesce({number}, 0L)"  # among nulls all other numbers tie
        span = df.where(edge).agg(F.expr(f"min({number}) AS low"), F.expr(f"max({number}) AS high"), F.expr("count(*) AS n")).first()
        if ties is None:
            ties = span["n"]
            n = max(1, int(ties * share)) if n is None else n
            if n >= ties:
                return Selection(df, "TRUE", "FALSE", 0, 0)
        if n <= 0:
            return Selection(df, inside, "FALSE", 0, 0)
        if n == ties:
            break
        value, below, ties = _kth(df.where(edge), number, n, span["low"], span["high"])
        inside = f"({inside}) OR (({edge}) AND ({number}) < {_literal(value)})"
        edge = f"({edge}) AND ({number}) = {_literal(value)}"
        n -= below
    return Selection(df, inside, edge, n, ties or 0)


def _literal(value: int) -> str:
    return f"CAST('{value}' AS BIGINT)"


def _kth(df: DataFrame, number: str, k: int, low: int, high: int) -> tuple[int, int, int]:
    """The k-th smallest number, how many are below it, and how many equal it."""
    if low == high:
        return low, 0, df.count()
    # Doubles round alike at every row and never turn two numbers round, so bins keep the order.
    width = (float(high) - float(low)) / BINS or 1.0
    place = f"CAST(floor((CAST({number} AS DOUBLE) - {float(low)!r}D) / {width!r}D) AS BIGINT)"
    found = {r["bin"]: r["n"] for r in df.groupBy(F.expr(place).alias("bin")).agg(F.expr("count(*) AS n")).collect()}
    chosen, below = _bin(found, k)
    kept = df.where(f"{place} = {chosen}").groupBy(F.expr(number).alias("number")).agg(F.expr("count(*) AS n"))
    kept = cut_lineage(kept)
    while True:
        head = kept.limit(BINS + 1).collect()
        if len(head) <= BINS:
            value, before = _bin({r["number"]: r["n"] for r in head}, k - below)
            return value, below + before, next(r["n"] for r in head if r["number"] == value)
        low, high = kept.agg(F.min("number"), F.max("number")).first()
        step = (high - low) // BINS + 1
        place = f"(number - {_literal(low)}) DIV {step}L"
        found = {r["bin"]: r["n"] for r in kept.groupBy(F.expr(place).alias("bin")).agg(F.sum("n").alias("n")).collect()}
        chosen, before = _bin(found, k - below)
        below += before
        kept = kept.where(f"{place} = {chosen}")


def _bin(counts: dict[int, int], k: int) -> tuple[int, int]:
    """The bin that holds the k-th, and how many are in those before it."""
    before = 0
    for place in sorted(counts):
        if before + counts[place] >= k:
            return place, before
        before += counts[place]
    raise ValueError(f"fewer than {k} rows")


def by_columns(df: DataFrame, order: Sequence[str]) -> Iterator[str]:
    """The numbers of an order by columns; what it leaves open is settled by the rows' hashes."""
    for column in order:
        yield from sort_numbers(df, column)
    yield from hash_numbers(df)
