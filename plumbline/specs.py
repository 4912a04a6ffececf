"""Declarative table and pipeline specifications.

A spec is plain driver-side configuration; operators compile it to Column
expressions. Adding a table to the rule library means adding a ``TableSpec``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from plumbline.model import BRONZE, GOLD, SILVER


def quoted(column: str) -> str:
    """A column name as SQL text, in backticks where it is no plain word."""
    plain = column.isidentifier() and column.isascii()
    return column if plain else "`" + column.replace("`", "``") + "`"


def ticked(column: str) -> str:
    """Any column name as SQL text, always in backticks."""
    return "`" + column.replace("`", "``") + "`"


def bound(value: float | Decimal) -> str:
    """A bound as exact SQL text: whole numbers and decimals as such, others as doubles with all their digits."""
    if isinstance(value, int) and not isinstance(value, bool):
        return str(value)
    if isinstance(value, Decimal) and value.is_finite():
        return f"{value:f}BD"
    return str(int(value)) if float(value).is_integer() and abs(value) < 1e15 else f"{float(value)!r}D"


@dataclass(frozen=True)
class RangeRule:
    """Lower (and optionally upper) bound of a column. NULL never violates it."""

    column: str
    min: float | None = None
    strict_min: bool = False
    max: float | None = None

    @property
    def active(self) -> bool:
        return self.min is not None or self.max is not None

    def sql(self) -> str:
        """Condition of an offending row."""
        parts = []
        if self.min is not None:
            parts.append(f"{quoted(self.column)} {'<=' if self.strict_min else '<'} {bound(self.min)}")
        if self.max is not None:
            parts.append(f"{quoted(self.column)} > {bound(self.max)}")
        return " OR ".join(parts)

    @property
    def key(self) -> str:
        """Tells the rule from others on the same column."""
        low = "" if self.min is None else f"{'>' if self.strict_min else '>='} {bound(self.min)}"
        high = "" if self.max is None else f"<= {bound(self.max)}"
        return " and ".join(p for p in (low, high) if p)


@dataclass(frozen=True)
class ForeignKey:
    column: str
    ref_table: str | None = None
    ref_column: str | None = None

    def frame(self, table: str) -> str:
        """Name of the metric frame that counts this key's orphans."""
        return f"{table}_fk_{self.column}_{self.ref_table}_{self.ref_column}"


@dataclass(frozen=True)
class TableSpec:
    name: str
    layer: str
    primary_key: tuple[str, ...] = ()
    mandatory: tuple[str, ...] = ()
    ranges: tuple[RangeRule, ...] = ()
    date_columns: tuple[str, ...] = ()
    freshness_column: str | None = None
    max_future_days: int | None = None
    freshness_days: int | None = None
    span_days: int | None = None
    source_table: str | None = None
    foreign_keys: tuple[ForeignKey, ...] = ()

    @property
    def tag(self) -> str:
        """Three-letter table tag used in check ids."""
        return self.name[:3].upper()

    @property
    def fresh_date(self) -> str | None:
        if self.max_future_days is None and self.freshness_days is None:
            return None
        if self.freshness_column:
            return self.freshness_column
        return self.date_columns[0] if self.date_columns else None


@dataclass(frozen=True)
class Thresholds:
    """Limits used by the catalogue checks (fixed values of the check catalogue)."""

    min_rows: int = 50_000
    max_rows: int = 150_000
    sigma_pass: float = 3.0
    sigma_warn: float = 5.0
    min_drop: float = 2.0
    max_drop: float = 10.0
    drop_slack: float = 1.5
    duplicate_pct_fail: float = 5.0
    loss_pct_fail: float = 1.0
    segment_pct_warn: float = 5.0
    segment_pct_fail: float = 50.0
    revenue_tolerance: float = 1.0
    order_value_tolerance: float = 0.01
    min_history: int = 4
    fence_factor: float = 1.5
    z_scale: float = 0.6745
    z_fail: float = 3.5


# The column lists of the order-lines domain.
ORDER_COLUMNS = (
    "invoice_no",
    "stock_code",
    "description",
    "quantity",
    "invoice_date",
    "unit_price",
    "customer_id",
    "country",
)
_ORDER_MANDATORY = (
    "invoice_no",
    "stock_code",
    "quantity",
    "unit_price",
    "invoice_date",
    "customer_id",
    "country",
)
_ORDER_DATES = dict(
    date_columns=("invoice_date",),
    freshness_column="invoice_date",
    max_future_days=0,
    freshness_days=365,
    span_days=365,
)


def order_table_specs() -> tuple[TableSpec, ...]:
    """Rule-library specs of the retail-orders pipeline, in report order."""
    return (
        TableSpec(
            name="raw_orders",
            layer=BRONZE,
            primary_key=("invoice_no",),
            mandatory=_ORDER_MANDATORY,
            ranges=(RangeRule("unit_price", 0, strict_min=True),),
            **_ORDER_DATES,
        ),
        TableSpec(
            name="bronze_orders",
            layer=BRONZE,
            primary_key=("invoice_no",),
            mandatory=_ORDER_MANDATORY,
            ranges=(RangeRule("quantity"), RangeRule("unit_price", 0)),
            source_table="raw_orders",
            **_ORDER_DATES,
        ),
        TableSpec(
            name="silver_orders",
            layer=SILVER,
            primary_key=("invoice_no",),
            mandatory=_ORDER_MANDATORY,
            ranges=(
                RangeRule("quantity", 0, strict_min=True),
                RangeRule("unit_price", 0, strict_min=True),
            ),
            foreign_keys=(ForeignKey("customer_id", "customers", "customer_id"),),
            **_ORDER_DATES,
        ),
        TableSpec(
            name="gold_metrics",
            layer=GOLD,
            mandatory=(
                "total_revenue",
                "total_orders",
                "total_customers",
                "average_order_value",
            ),
            ranges=(
                RangeRule("total_revenue", 0),
                RangeRule("total_orders", 0),
                RangeRule("total_customers", 0),
            ),
        ),
        TableSpec(
            name="order_payments",
            layer=BRONZE,
            primary_key=("payment_id",),
            mandatory=("payment_id", "invoice_no", "amount"),
            ranges=(RangeRule("amount", 0, strict_min=True),),
            foreign_keys=(ForeignKey("invoice_no", "bronze_orders", "invoice_no"),),
        ),
    )


@dataclass(frozen=True)
class PipelineSpec:
    """Table roles, column roles and thresholds of one medallion pipeline."""

    source: str = "raw_orders"
    bronze: str = "bronze_orders"
    silver: str = "silver_orders"
    gold: str = "gold_metrics"
    gold_country: str = "gold_country_revenue"
    history: str = "historical_runs"

    document: str = "invoice_no"
    item: str = "stock_code"
    customer: str = "customer_id"
    country: str = "country"
    quantity: str = "quantity"
    price: str = "unit_price"
    revenue: str = "net_revenue"

    business_key: tuple[str, ...] = ("invoice_no", "stock_code", "customer_id", "invoice_date")
    required_columns: tuple[str, ...] = ORDER_COLUMNS
    bronze_mandatory: tuple[str, ...] = (
        "invoice_no",
        "quantity",
        "invoice_date",
        "unit_price",
        "country",
    )
    silver_mandatory: tuple[str, ...] = (
        "invoice_no",
        "stock_code",
        "quantity",
        "unit_price",
        "invoice_date",
        "country",
    )
    # Quantities above this form the high-quantity loss segment.
    segment_quantity: int = 20
    thresholds: Thresholds = field(default_factory=Thresholds)
    tables: tuple[TableSpec, ...] = field(default_factory=order_table_specs)

    def valid_row(self) -> str:
        """SQL text: a business-valid row that must survive into Silver (keys present)."""
        return f"{self.sellable_row()} AND {quoted(self.document)} IS NOT NULL AND {quoted(self.item)} IS NOT NULL"

    def sellable_row(self) -> str:
        """SQL text: the looser predicate of expected revenue, without key conditions."""
        return f"{quoted(self.quantity)} > 0 AND {quoted(self.price)} > 0"

    @property
    def high_segment(self) -> str:
        return f"{quoted(self.quantity)} > {self.segment_quantity}"

    @property
    def low_segment(self) -> str:
        return f"{quoted(self.quantity)} <= {self.segment_quantity}"
