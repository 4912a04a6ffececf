"""DuckDB SQL with the result of each registered query."""

from __future__ import annotations

# --- the layer tables ---------------------------------------------------------

_LINE_SELECT = """
  SELECT o_orderpriority AS pipeline,
    CASE WHEN l_linenumber = 7 AND l_partkey % 10 = 0 THEN NULL ELSE l_orderkey END AS invoice_no,
    l_partkey AS stock_code,
    l_returnflag || '-' || l_linestatus AS description,
    CASE WHEN l_linenumber = 6 AND l_suppkey % 20 = 0 THEN -CAST(l_quantity AS BIGINT)
         WHEN l_linenumber = 5 AND l_suppkey % 25 = 0 THEN 0
         ELSE CAST(l_quantity AS BIGINT) END AS quantity,
    CASE WHEN l_linenumber = 7 AND l_suppkey % 3 = 0 THEN 'bad-date'
         ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS invoice_date,
    floor(l_extendedprice * 100 / l_quantity) / 100 AS unit_price,
    CASE WHEN l_linenumber = 4 AND l_suppkey % 50 = 0 THEN NULL
         WHEN l_linenumber = 3 AND l_partkey % 20 = 0 THEN -o_custkey ELSE o_custkey END AS customer_id,
    n_name AS country
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""
_RUN = "CASE WHEN try_cast(invoice_date AS DATE) IS NULL THEN 'undated' ELSE substr(invoice_date, 1, 7) END"
_BASE = f"""
WITH lines AS MATERIALIZED (
  {_LINE_SELECT}
  UNION ALL
  {_LINE_SELECT} WHERE l_linenumber = 1 AND l_suppkey % 40 = 0
),
silver AS MATERIALIZED (
  SELECT *, quantity * unit_price AS net_revenue FROM lines
  WHERE quantity > 0 AND unit_price > 0 AND quantity <= 40
),
fresh AS (
  SELECT pipeline, sum(net_revenue) AS revenue, count(DISTINCT invoice_no) AS orders,
         count(DISTINCT customer_id) AS customers FROM silver GROUP BY pipeline
),
gold AS (
  SELECT pipeline,
    revenue * CASE WHEN pipeline = '2-HIGH' THEN 2 ELSE 1 END AS total_revenue,
    orders + CASE WHEN pipeline = '1-URGENT' THEN 5 ELSE 0 END AS total_orders,
    customers AS total_customers,
    CASE WHEN orders = 0 THEN 0 ELSE revenue / orders END AS average_order_value
  FROM fresh
),
gold_country AS (
  SELECT pipeline, country, sum(net_revenue)
    + CASE WHEN pipeline = '3-MEDIUM' AND country = 'NATION_6' THEN 100 ELSE 0 END AS revenue
  FROM silver GROUP BY pipeline, country
),
per_month AS (
  SELECT pipeline, {_RUN} AS run_id, count(*) AS b FROM lines GROUP BY 1, 2
),
silver_month AS (
  SELECT pipeline, {_RUN} AS run_id, count(*) AS s, sum(net_revenue) AS r
  FROM silver GROUP BY 1, 2
),
history AS (
  SELECT pipeline, run_id, b * 84 AS bronze_count, coalesce(s, 0) * 84 AS silver_count,
    (1 - coalesce(s, 0) / b) * 100 AS drop_pct, coalesce(r, 0) * 84 AS gold_revenue
  FROM per_month LEFT JOIN silver_month USING (pipeline, run_id)
),
customers AS (SELECT c_custkey AS customer_id FROM customer)
"""
_VALID = "quantity > 0 AND unit_price > 0 AND invoice_no IS NOT NULL AND stock_code IS NOT NULL"
_DAY = "CASE WHEN regexp_matches(invoice_date, '^\\d{4}-\\d{1,2}-\\d{1,2}$') THEN TRY_CAST(invoice_date AS DATE) END"
_KEY = ("invoice_no", "stock_code", "customer_id", "invoice_date")
_SAME_KEY = " AND ".join(f"s.{k} IS NOT DISTINCT FROM b.{k}" for k in ("pipeline", *_KEY))
_LOST = f"""
lost AS (
  SELECT b.* FROM (SELECT * FROM lines WHERE {_VALID}) b ANTI JOIN silver s ON {_SAME_KEY}
)
"""
_FIVE = "(SELECT DISTINCT pipeline FROM lines)"


def _excess(table: str, key: str, name: str) -> str:
    return (
        f"SELECT pipeline, CAST(sum(n - 1) AS BIGINT) AS {name} FROM "
        f"(SELECT pipeline, count(*) AS n FROM {table} GROUP BY pipeline, {key}) GROUP BY pipeline"
    )


ORACLES: dict[str, str] = {}

ORACLES["build_silver"] = _BASE + "SELECT * FROM silver"
ORACLES["build_gold_metrics"] = _BASE + """
SELECT pipeline, round(revenue, 2) AS total_revenue, orders AS total_orders, customers AS total_customers,
  round(CASE WHEN orders = 0 THEN 0 ELSE revenue / orders END, 2) AS average_order_value FROM fresh"""
ORACLES["build_gold_country"] = _BASE + """
SELECT pipeline, country, round(sum(net_revenue), 2) AS revenue FROM silver GROUP BY ALL"""
ORACLES["build_gold_product"] = _BASE + """
SELECT pipeline, stock_code, CAST(sum(quantity) AS BIGINT) AS total_quantity,
  round(sum(net_revenue), 2) AS revenue FROM silver GROUP BY pipeline, stock_code"""

_MANDATORY = ("invoice_no", "stock_code", "quantity", "unit_price", "invoice_date", "customer_id", "country")
ORACLES["completeness_nulls"] = (
    _BASE
    + "SELECT *, CASE WHEN "
    + " + ".join(f"null_{c}" for c in _MANDATORY)
    + " = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT pipeline, "
    + ", ".join(f"count(*) FILTER ({c} IS NULL) AS null_{c}" for c in _MANDATORY)
    + " FROM lines GROUP BY pipeline)"
)
ORACLES["range_violations"] = _BASE + f"""
SELECT pipeline, count(*) FILTER (quantity <= 0) AS range_quantity,
  count(*) FILTER (unit_price < 1000) AS range_unit_price,
  count(*) FILTER (quantity < 0) AS negative_quantity, count(*) FILTER (unit_price < 0) AS negative_price,
  count(*) FILTER ({_VALID}) AS valid_rows,
  count(*) FILTER (quantity <= 0 OR unit_price <= 0) AS explained FROM lines GROUP BY pipeline"""
ORACLES["date_parse_validity"] = _BASE + f"""
SELECT pipeline, count(*) FILTER (invoice_date IS NOT NULL AND {_DAY} IS NULL) AS unparsed
FROM lines GROUP BY pipeline"""
ORACLES["freshness"] = _BASE + f"""
SELECT pipeline, max_date,
  CASE WHEN max_date > DATE '2001-12-31' THEN 'FAIL' WHEN max_date < DATE '2001-12-31' - 365 THEN 'WARN'
    ELSE 'PASS' END AS year_status,
  CASE WHEN max_date > DATE '2001-12-31' THEN 'FAIL' WHEN max_date < DATE '2001-12-31' - 30 THEN 'WARN'
    ELSE 'PASS' END AS month_status
FROM (SELECT pipeline, max({_DAY}) AS max_date FROM lines GROUP BY pipeline)"""
ORACLES["timeliness"] = _BASE + f"""
SELECT pipeline, CAST(max_date - min_date AS INTEGER) AS span_days,
  CASE WHEN max_date - min_date <= 365 THEN 'PASS' ELSE 'WARN' END AS status
FROM (SELECT pipeline, min({_DAY}) AS min_date, max({_DAY}) AS max_date FROM silver GROUP BY pipeline)"""
ORACLES["empty_and_source_count"] = _BASE + """
SELECT *, CASE WHEN table_rows > 0 THEN 'PASS' ELSE 'FAIL' END AS empty_status,
  CASE WHEN table_rows = source_rows THEN 'PASS' ELSE 'FAIL' END AS source_status
FROM (SELECT pipeline, count(*) AS source_rows FROM lines GROUP BY pipeline)
JOIN (SELECT pipeline, count(*) AS table_rows FROM silver GROUP BY pipeline) USING (pipeline)"""

_KEY_COLS = ", ".join(_KEY)
ORACLES["dup_business_key"] = _BASE + f"""
SELECT * FROM ({_excess('lines', _KEY_COLS, 'bronze_excess')})
JOIN ({_excess('silver', _KEY_COLS, 'silver_excess')}) USING (pipeline)"""
ORACLES["dup_primary_key"] = """
SELECT l_returnflag, CAST(sum(n - 1) AS BIGINT) AS excess FROM
  (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_orderkey, l_linenumber)
GROUP BY l_returnflag"""
ORACLES["dup_full_row"] = _BASE + """
SELECT pipeline, all_rows - distinct_rows AS excess FROM
  (SELECT pipeline, count(*) AS all_rows FROM lines GROUP BY pipeline)
  JOIN (SELECT pipeline, count(*) AS distinct_rows FROM (SELECT DISTINCT * FROM lines) GROUP BY pipeline)
  USING (pipeline)"""
ORACLES["dup_full_row_two_pass"] = ORACLES["dup_full_row"]
ORACLES["dup_distinct_keys"] = """
SELECT l_returnflag, count(*) FILTER (n > 1) AS duplicated FROM
  (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_orderkey, l_linenumber)
GROUP BY l_returnflag"""


def _learned(value: str, mean: str = "mean", std: str = "std") -> str:
    return (
        f"CASE WHEN {value} BETWEEN {mean} - 3 * {std} AND {mean} + 3 * {std} THEN 'PASS' "
        f"WHEN {value} BETWEEN {mean} - 5 * {std} AND {mean} + 5 * {std} THEN 'WARN' ELSE 'FAIL' END"
    )


def _window(value: str) -> str:
    return f"CASE WHEN {value} BETWEEN 2 AND 10 THEN 'PASS' WHEN {value} <= 15 THEN 'WARN' ELSE 'FAIL' END"


ORACLES["drop_pct_band"] = _BASE + f"""
SELECT pipeline, bronze, silver, round(d, 4) AS drop_pct, {_learned('d')} AS learned_status,
  {_window('d')} AS window_status FROM (
  SELECT pipeline, bronze, silver, mean, std, (1 - silver / bronze) * 100 AS d
  FROM (SELECT pipeline, count(*) AS bronze FROM lines GROUP BY pipeline)
  JOIN (SELECT pipeline, count(*) AS silver FROM silver GROUP BY pipeline) USING (pipeline)
  JOIN (SELECT pipeline, avg(drop_pct) AS mean, stddev_pop(drop_pct) AS std FROM history GROUP BY pipeline)
  USING (pipeline))"""

_CENSUS = f""",
{_LOST},
kc AS (
  SELECT pipeline,
    coalesce(lost_rows, 0) AS lost_rows, lost_min_quantity, lost_max_quantity,
    bronze_key_excess, silver_key_excess, coalesce(lost_document_rows, 0) AS lost_document_rows,
    coalesce(silver_rows_unknown, 0) AS silver_rows_unknown, bronze_document_excess, silver_document_excess,
    silver_documents
  FROM {_FIVE}
  LEFT JOIN (SELECT pipeline, count(*) AS lost_rows, CAST(min(quantity) AS DOUBLE) AS lost_min_quantity,
    CAST(max(quantity) AS DOUBLE) AS lost_max_quantity FROM lost GROUP BY pipeline) USING (pipeline)
  LEFT JOIN ({_excess('lines', _KEY_COLS, 'bronze_key_excess')}) USING (pipeline)
  LEFT JOIN ({_excess('silver', _KEY_COLS, 'silver_key_excess')}) USING (pipeline)
  LEFT JOIN (SELECT pipeline, count(*) AS lost_document_rows FROM
    (SELECT b.pipeline FROM (SELECT * FROM lines WHERE {_VALID}) b
     ANTI JOIN silver s ON s.pipeline = b.pipeline AND s.invoice_no = b.invoice_no) GROUP BY pipeline) USING (pipeline)
  LEFT JOIN (SELECT pipeline, count(*) AS silver_rows_unknown FROM
    (SELECT s.pipeline FROM silver s
     ANTI JOIN lines b ON s.pipeline = b.pipeline AND s.invoice_no = b.invoice_no) GROUP BY pipeline) USING (pipeline)
  LEFT JOIN ({_excess('lines', 'invoice_no', 'bronze_document_excess')}) USING (pipeline)
  LEFT JOIN ({_excess('silver', 'invoice_no', 'silver_document_excess')}) USING (pipeline)
  LEFT JOIN (SELECT pipeline, count(DISTINCT invoice_no) AS silver_documents FROM silver GROUP BY pipeline)
    USING (pipeline)
)
"""
ORACLES["key_census"] = _BASE + _CENSUS + "SELECT * FROM kc"
ORACLES["valid_rows_lost"] = _BASE + "," + _LOST + """
SELECT pipeline, invoice_no, stock_code, customer_id, invoice_date, quantity FROM lost"""
ORACLES["valid_rows_lost_counted"] = ORACLES["valid_rows_lost"]
ORACLES["valid_loss_status"] = _BASE + _CENSUS + f"""
SELECT pipeline, valid_rows, lost_rows, round(lost_rows / valid_rows * 100, 2) AS loss_pct,
  CASE WHEN lost_rows = 0 THEN 'PASS' WHEN lost_rows / valid_rows * 100 < 1 THEN 'WARN' ELSE 'FAIL' END AS status
FROM kc JOIN (SELECT pipeline, count(*) AS valid_rows FROM lines WHERE {_VALID} GROUP BY pipeline) USING (pipeline)"""
_SEGMENT = "CASE WHEN quantity > 40 THEN 'quantity > 40' ELSE 'quantity <= 40' END"
_SEGMENTS = f"""
  SELECT pipeline, segment, bronze_valid, coalesce(silver_count, 0) AS silver_count,
    round((1 - coalesce(silver_count, 0) / bronze_valid) * 100, 2) AS loss_pct
  FROM (SELECT pipeline, {_SEGMENT} AS segment, count(*) AS bronze_valid FROM lines WHERE {_VALID} GROUP BY 1, 2)
  LEFT JOIN (SELECT pipeline, {_SEGMENT} AS segment, count(*) AS silver_count FROM silver GROUP BY 1, 2)
  USING (pipeline, segment)
"""
ORACLES["segment_loss"] = _BASE + f"""
SELECT *, CASE WHEN loss_pct < 5 THEN 'PASS' WHEN loss_pct < 50 THEN 'WARN' ELSE 'FAIL' END AS status
FROM ({_SEGMENTS})"""
_SUSPECT = (
    "CASE WHEN lost_min_quantity > 40 THEN 'quantity > 40 records are being filtered out' "
    "ELSE 'unclear filter (missing records span multiple quantity ranges)' END"
)
ORACLES["wrong_filter"] = _BASE + _CENSUS + f"""
SELECT pipeline, lost_rows, lost_min_quantity, lost_max_quantity, {_SUSPECT} AS suspected_filter FROM kc"""
ORACLES["unexplained_loss"] = _BASE + _CENSUS + f"""
SELECT pipeline, bronze_total, bronze_valid, explained, silver_count, lost_document_rows AS unexplained FROM kc
JOIN (SELECT pipeline, count(*) AS bronze_total, count(*) FILTER ({_VALID}) AS bronze_valid,
  count(*) FILTER (quantity <= 0 OR unit_price <= 0) AS explained FROM lines GROUP BY pipeline) USING (pipeline)
JOIN (SELECT pipeline, count(*) AS silver_count FROM silver GROUP BY pipeline) USING (pipeline)"""
ORACLES["key_set"] = _BASE + _CENSUS + """
SELECT *, CASE WHEN silver_rows_unknown + gold_excess = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
  SELECT pipeline, silver_rows_unknown, silver_documents, total_orders,
    greatest(0, total_orders - silver_documents) AS gold_excess FROM kc JOIN gold USING (pipeline))"""
_ORPHANS = """SELECT pipeline, count(*) FILTER (customer_id IS NOT NULL AND c IS NULL) AS orphans FROM
  (SELECT s.pipeline, s.customer_id, c.customer_id AS c FROM silver s
   LEFT JOIN customers c ON s.customer_id = c.customer_id) GROUP BY pipeline"""
ORACLES["fk_orphans"] = _BASE + _ORPHANS
ORACLES["fk_orphans_filtered"] = """
SELECT l_returnflag, count(*) FILTER (p_partkey IS NULL AND l_partkey IS NOT NULL) AS orphans
FROM lineitem LEFT JOIN (SELECT DISTINCT p_partkey FROM part WHERE p_size > 40) ON l_partkey = p_partkey
GROUP BY l_returnflag"""

ORACLES["gold_reconcile"] = _BASE + """
SELECT pipeline, round(revenue, 2) AS silver_revenue, round(total_revenue, 2) AS gold_revenue,
  CASE WHEN abs(revenue - total_revenue) <= 1 THEN 'PASS' ELSE 'FAIL' END AS revenue_status,
  CASE WHEN orders = total_orders THEN 'PASS' ELSE 'FAIL' END AS order_status,
  CASE WHEN customers = total_customers THEN 'PASS' ELSE 'FAIL' END AS customer_status,
  CASE WHEN abs(total_revenue / total_orders - average_order_value) <= 0.01 THEN 'PASS' ELSE 'FAIL' END
    AS order_value_status,
  concat_ws(',', CASE WHEN abs(revenue - total_revenue) > 1 THEN 'total_revenue' END,
    CASE WHEN orders <> total_orders THEN 'total_orders' END,
    CASE WHEN customers <> total_customers THEN 'total_customers' END) AS mismatched
FROM fresh JOIN gold USING (pipeline)"""
_COUNTRY = """SELECT pipeline, count(*) FILTER (abs(coalesce(g, 0) - coalesce(s, 0)) > 1) AS country_mismatches FROM (
  SELECT coalesce(a.pipeline, b.pipeline) AS pipeline, a.revenue AS g, b.revenue AS s FROM gold_country a
  FULL OUTER JOIN (SELECT pipeline, country, sum(net_revenue) AS revenue FROM silver GROUP BY 1, 2) b
  ON a.pipeline = b.pipeline AND a.country = b.country) GROUP BY pipeline"""
ORACLES["country_reconcile"] = _BASE + _COUNTRY


def _g5(gold: str, gap: str, upstream: str) -> str:
    return (
        f"CASE WHEN NOT coalesce(std > 0, false) THEN 'WARN' "
        f"WHEN {gold} BETWEEN mean - 3 * std AND mean + 3 * std THEN 'PASS' WHEN {gap} > 1 THEN 'FAIL' "
        f"WHEN {gold} < mean - 3 * std AND {upstream} IN ('FAIL', 'IMPACTED', 'WARN') THEN 'IMPACTED' "
        f"ELSE 'WARN' END"
    )


_UP = "CASE WHEN pipeline = '3-MEDIUM' THEN 'PASS' ELSE 'FAIL' END"
ORACLES["revenue_vs_baseline"] = _BASE + f"""
SELECT pipeline, round(total_revenue, 2) AS gold_revenue, round(mean, 2) AS expected_revenue,
  {_g5('total_revenue', 'abs(revenue - total_revenue)', _UP)} AS status,
  {_g5('total_revenue * 0.2', '0', _UP)} AS low_status
FROM fresh JOIN gold USING (pipeline) JOIN (SELECT pipeline, avg(gold_revenue) AS mean,
  stddev_pop(gold_revenue) AS std FROM history GROUP BY pipeline) USING (pipeline)"""
ORACLES["business_impact"] = _BASE + """
SELECT pipeline, round(e, 2) AS expected_revenue, round(a, 2) AS actual_revenue, round(e - a, 2) AS estimated_loss,
  round(CASE WHEN e = 0 THEN 0 ELSE (e - a) / e * 100 END, 2) AS loss_percent, 'AVAILABLE' AS status
FROM (SELECT pipeline, sum(quantity * unit_price) AS e FROM lines
      WHERE quantity > 0 AND unit_price > 0 GROUP BY pipeline)
JOIN (SELECT pipeline, total_revenue AS a FROM gold) USING (pipeline)"""

# --- run history --------------------------------------------------------------

_MONTH = """CASE WHEN try_cast(invoice_date AS DATE) IS NULL THEN country || '/undated' ELSE country END AS country,
    substr(invoice_date, 1, 7) AS month"""
_SERIES = f""",
monthly AS (
  SELECT country, month, b AS bronze_count, coalesce(s, 0) AS silver_count,
    round((1 - coalesce(s, 0) / b) * 100, 3) AS drop_pct, round(coalesce(r, 0), 2) AS gold_revenue
  FROM (SELECT {_MONTH}, count(*) AS b FROM lines GROUP BY 1, 2)
  LEFT JOIN (SELECT {_MONTH}, count(*) AS s, sum(net_revenue) AS r FROM silver GROUP BY 1, 2) USING (country, month)
),
series AS (
  SELECT country, month, 'bronze_count' AS metric, CAST(bronze_count AS DOUBLE) AS x FROM monthly
  UNION ALL SELECT country, month, 'silver_count', CAST(silver_count AS DOUBLE) FROM monthly
  UNION ALL SELECT country, month, 'drop_pct', drop_pct FROM monthly
  UNION ALL SELECT country, month, 'gold_revenue', gold_revenue FROM monthly
)
"""


def _robust(series: str, keys: str) -> str:
    return f"""
  SELECT {keys}, n, q1, median, q3, quantile_cont(abs(x - median), 0.5) AS mad FROM {series} JOIN (
    SELECT {keys}, count(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
      quantile_cont(x, 0.75) AS q3 FROM {series} GROUP BY {keys}) USING ({keys})
  GROUP BY {keys}, n, q1, median, q3"""


def _classify(value: str) -> str:
    return f"""CASE WHEN {value} IS NULL OR n < 4 THEN 'SKIPPED'
    WHEN q3 - q1 = 0 OR mad = 0 THEN CASE WHEN {value} = median THEN 'PASS' ELSE 'WARN' END
    WHEN {value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 'PASS'
    WHEN abs(0.6745 * ({value} - median) / mad) > 3.5 THEN 'FAIL' ELSE 'WARN' END"""


ORACLES["history_stats"] = _BASE + _SERIES + """
SELECT country, metric, n, round(mean, 4) AS mean, round(std, 4) AS std, round(mean - 3 * std, 3) AS lower,
  round(mean + 3 * std, 3) AS upper
FROM (SELECT country, metric, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std FROM series GROUP BY 1, 2)"""
ORACLES["robust_band"] = _BASE + _SERIES + """
SELECT country, metric, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(q3 - q1, 6) AS iqr, round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper
FROM (SELECT country, metric, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
  quantile_cont(x, 0.75) AS q3 FROM series GROUP BY 1, 2)"""
_SCORED = _SERIES + f""",
ranked AS (SELECT *, max(month) OVER (PARTITION BY country, metric) AS last FROM series),
past AS (SELECT * FROM ranked WHERE month < last),
scored AS (SELECT * FROM ({_robust('past', 'country, metric')})
  JOIN (SELECT country, metric, x AS value FROM ranked WHERE month = last) USING (country, metric))
"""
ORACLES["modified_z"] = _BASE + _SCORED + """
SELECT country, metric, round(value, 3) AS value, round(mad, 4) AS mad,
  round(CASE WHEN mad = 0 THEN CASE WHEN value = median THEN 0 ELSE CAST('inf' AS DOUBLE) END
    ELSE 0.6745 * (value - median) / mad END, 2) AS z FROM scored"""
ORACLES["anomaly_status"] = _BASE + _SCORED + f"""
SELECT country, metric, n, {_classify('value')} AS status FROM scored"""

# --- results of a whole run -----------------------------------------------------

_HIST_METRICS = ("bronze_count", "silver_count", "drop_pct", "gold_revenue")


def _history_cte() -> str:
    parts = []
    for m in _HIST_METRICS:
        rows = f"(SELECT pipeline, CAST({m} AS DOUBLE) AS x FROM history)"
        parts.append(
            f"h_{m} AS (SELECT * FROM ({_robust(rows, 'pipeline')}) JOIN (SELECT pipeline, avg(x) AS mean, "
            f"stddev_pop(x) AS std FROM {rows} GROUP BY pipeline) USING (pipeline))"
        )
    return ",\n".join(parts)


def _nulls(columns) -> str:
    return ", ".join(f"count(*) FILTER ({c} IS NULL) AS null_{c}" for c in columns)


_M = _CENSUS + f""",
{_history_cte()},
bm AS (SELECT pipeline, count(*) AS n, {_nulls(_MANDATORY)}, count(*) FILTER (quantity < 0) AS negq,
  count(*) FILTER (unit_price < 0) AS negp, count(*) FILTER (unit_price <= 0) AS nonp,
  count(*) FILTER ({_VALID}) AS valid_rows, count(*) FILTER ({_DAY} IS NULL) AS bad_date,
  min({_DAY}) AS d0, max({_DAY}) AS d1 FROM lines GROUP BY pipeline),
sm AS (SELECT pipeline, count(*) AS n, {_nulls(_MANDATORY)}, count(*) FILTER (quantity <= 0) AS nonq,
  count(*) FILTER (unit_price <= 0) AS nonp, count(*) FILTER (net_revenue < 0) AS negr, sum(net_revenue) AS revenue,
  count(*) FILTER ({_DAY} IS NULL) AS bad_date, min({_DAY}) AS d0, max({_DAY}) AS d1 FROM silver GROUP BY pipeline),
m AS MATERIALIZED (
  SELECT kc.*, bm.n AS b_n, {", ".join(f"bm.null_{c} AS b_null_{c}, sm.null_{c} AS s_null_{c}" for c in _MANDATORY)},
    bm.negq, bm.negp, bm.nonp AS b_nonp, bm.valid_rows, bm.bad_date AS b_bad, bm.d0 AS b_d0, bm.d1 AS b_d1,
    sm.n AS s_n, sm.nonq, sm.nonp AS s_nonp, sm.negr, sm.revenue, sm.bad_date AS s_bad, sm.d0 AS s_d0, sm.d1 AS s_d1,
    (1 - sm.n / bm.n) * 100 AS d, total_revenue, total_orders, total_customers, average_order_value, customers,
    abs(sm.revenue - total_revenue) AS gap, country_mismatches, orphans, b_row, s_row, worst
  FROM kc JOIN bm USING (pipeline) JOIN sm USING (pipeline) JOIN gold USING (pipeline)
  JOIN (SELECT pipeline, customers FROM fresh) USING (pipeline)
  JOIN ({_COUNTRY}) USING (pipeline) JOIN ({_ORPHANS}) USING (pipeline)
  JOIN ({_excess('lines', _KEY_COLS + ', description, quantity, unit_price, country', 'b_row')})
    USING (pipeline)
  JOIN ({_excess('silver', _KEY_COLS + ', description, quantity, unit_price, country, net_revenue', 's_row')})
    USING (pipeline)
  JOIN (SELECT pipeline, max(loss_pct) AS worst FROM ({_SEGMENTS}) GROUP BY pipeline) USING (pipeline)
)
"""
_SIX = ("invoice_no", "stock_code", "quantity", "unit_price", "invoice_date", "country")
_FIVE_COLS = ("invoice_no", "quantity", "invoice_date", "unit_price", "country")


def _zero(value: str, bad: str = "FAIL") -> tuple[str, str]:
    return f"CASE WHEN {value} = 0 THEN 'PASS' ELSE '{bad}' END", value


def _plus(prefix: str, columns) -> str:
    return "(" + " + ".join(f"{prefix}_null_{c}" for c in columns) + ")"


def _fresh(prefix: str) -> tuple[str, str]:
    latest = f"{prefix}_d1"
    return (
        f"CASE WHEN {latest} > DATE '2001-12-31' THEN 'FAIL' WHEN {latest} < DATE '2001-12-31' - 365 "
        f"THEN 'WARN' ELSE 'PASS' END",
        f"DATE '2001-12-31' - {latest}",
    )


def _span(prefix: str) -> tuple[str, str]:
    days = f"{prefix}_d1 - {prefix}_d0"
    return f"CASE WHEN {days} <= 365 THEN 'PASS' ELSE 'WARN' END", days


def _l3(metric: str, value: str) -> tuple[str, str]:
    status = f"(SELECT {_classify('m.' + value)} FROM h_{metric} h WHERE h.pipeline = m.pipeline)"
    return status, value


def _hist(template: str, metric: str) -> str:
    return f"(SELECT {template} FROM h_{metric} h WHERE h.pipeline = m.pipeline)"


_CONST_PASS = "'PASS'"
_RULE = ("layer_1_rules",)
# (id, name, layer, status SQL, value SQL, dimension, detection layer, table)
_ROWS: list[tuple] = []


def _add(layer: str, check_id: str, name: str, status_value: tuple[str, str], *tags: str) -> None:
    dimension, detection, table = (*tags, None, None, None)[:3]
    _ROWS.append((check_id, name, layer, *status_value, dimension, detection, table))


_CAT_BRONZE = (
    ("B1", "Source to Bronze Row Count", ("'PASS'", "b_n")),
    ("B2", "Low / High / Normal Count", (_hist(_learned("m.b_n"), "bronze_count"), "b_n")),
    ("B3", "Empty Table Check", ("CASE WHEN b_n > 0 THEN 'PASS' ELSE 'FAIL' END", "b_n")),
    ("B4", "Required Columns Present", ("'PASS'", "0")),
    ("B5", "Extra / Missing Columns", ("'PASS'", "0")),
    ("B6", "Null Count per Mandatory Column", _zero(_plus("b", _FIVE_COLS))),
    ("B7", "Negative Value Profiling", _zero("(negq + negp)", "WARN")),
    ("B8", "Duplicate Check", (
        "CASE WHEN bronze_key_excess = 0 THEN 'PASS' WHEN bronze_key_excess / b_n * 100 < 5 THEN 'WARN' ELSE 'FAIL' END",
        "bronze_key_excess")),
)
_CAT_SILVER = (
    ("S1", "Bronze to Silver Drop Percentage", (_hist(_learned("m.d"), "drop_pct"), "d")),
    ("S2", "Expected Drop Check", (_window("d"), "d")),
    ("S3", "Deduplication Count Check", _zero("silver_key_excess", "WARN")),
    ("S4", "Mandatory Columns Not Null", _zero(_plus("s", _SIX))),
    ("S5", "Quantity > 0", _zero("nonq")),
    ("S6", "Unit Price > 0", _zero("s_nonp")),
    ("S7", "Revenue Not Negative", _zero("negr")),
    ("S8", "Valid Record Wrongly Removed", (
        "CASE WHEN lost_rows = 0 THEN 'PASS' WHEN lost_rows / valid_rows * 100 < 1 THEN 'WARN' ELSE 'FAIL' END",
        "lost_rows")),
    ("S9", "Record-Loss by Segment", (
        "CASE WHEN worst < 5 THEN 'PASS' WHEN worst < 50 THEN 'WARN' ELSE 'FAIL' END", "worst")),
    ("S10", "Wrong Filter Detection", _zero("lost_rows")),
)
_CAT_GOLD = (
    ("G1", "Revenue Reconciliation (within rounding tolerance)", (
        "CASE WHEN gap <= 1 THEN 'PASS' ELSE 'FAIL' END", "gap")),
    ("G2", "Order Count Reconciliation", (
        "CASE WHEN total_orders = silver_documents THEN 'PASS' ELSE 'FAIL' END", "total_orders")),
    ("G3", "Customer Count Reconciliation", (
        "CASE WHEN total_customers = customers THEN 'PASS' ELSE 'FAIL' END", "total_customers")),
    ("G4", "Average Order Value Check", (
        "CASE WHEN abs(total_revenue / total_orders - average_order_value) <= 0.01 THEN 'PASS' ELSE 'FAIL' END",
        "average_order_value")),
    ("G5", "Revenue vs Expected Baseline", (
        # Silver fails in every pipeline (S8), so the upstream status is FAIL.
        _hist(_g5("m.total_revenue", "m.gap", "'FAIL'"), "gold_revenue"), "total_revenue")),
    ("G6", "Country-wise Revenue Reconciliation", _zero("country_mismatches")),
)


def _rules_for(tag: str, table: str, p: str, layer: str) -> list[tuple]:
    name = {"b": "bronze_document_excess", "s": "silver_document_excess"}[p]
    rows = [
        (f"L1-{tag}-COMP-EMPTY", "Empty Table Check",
         (f"CASE WHEN {p}_n > 0 THEN 'PASS' ELSE 'FAIL' END", f"{p}_n"), "completeness"),
        (f"L1-{tag}-COMP-NULL", "Mandatory Column Null Check", _zero(_plus(p, _MANDATORY)), "completeness"),
    ]
    if tag == "BRO":
        rows.append((f"L1-{tag}-COMP-SRC", "Source to Table Row Count", ("'PASS'", "b_n"), "completeness"))
    if tag == "SIL":
        rows.append((f"L1-{tag}-VAL-QUAN", "Range Check: quantity", _zero("nonq"), "validity"))
    price = {"RAW": "b_nonp", "BRO": "negp", "SIL": "s_nonp"}[tag]
    rows += [
        (f"L1-{tag}-VAL-UNIT", "Range Check: unit_price", _zero(price), "validity"),
        (f"L1-{tag}-VAL-DATE", "Date Parse Validity: invoice_date", _zero(f"{p}_bad"), "validity"),
        (f"L1-{tag}-UNIQ-PK", "Primary Key Duplicate Check", _zero(name), "uniqueness"),
        (f"L1-{tag}-UNIQ-FULL", "Full Row Duplicate Check", _zero(f"{p}_row", "WARN"), "uniqueness"),
    ]
    if tag == "SIL":
        rows.append((
            "L1-SIL-CONS-FK-CUST", "Foreign Key Integrity: customer_id -> customers.customer_id",
            _zero("orphans"), "consistency"))
    rows += [
        (f"L1-{tag}-TIME-FRESH", "Date Freshness: invoice_date", _fresh(p), "timeliness"),
        (f"L1-{tag}-TIME", "Timeliness Window: invoice_date", _span(p), "timeliness"),
    ]
    return [(layer, *r, "layer_1_rules", table) for r in rows]


_DETECTED = [
    *_rules_for("RAW", "raw_orders", "b", "Bronze"),
    *_rules_for("BRO", "bronze_orders", "b", "Bronze"),
    *_rules_for("SIL", "silver_orders", "s", "Silver"),
    ("Gold", "L1-GOL-COMP-EMPTY", "Empty Table Check", ("'PASS'", "1"), "completeness", "layer_1_rules", "gold_metrics"),
    ("Gold", "L1-GOL-COMP-NULL", "Mandatory Column Null Check", ("'PASS'", "0"), "completeness", "layer_1_rules",
     "gold_metrics"),
    *[("Gold", "L1-GOL-VAL-TOTA", f"Range Check: {c}", _zero(f"(CASE WHEN {c} < 0 THEN 1 ELSE 0 END)"), "validity",
       "layer_1_rules", "gold_metrics") for c in ("total_revenue", "total_orders", "total_customers")],
    ("Gold", "L1-GOL-UNIQ-FULL", "Full Row Duplicate Check", ("'PASS'", "0"), "uniqueness", "layer_1_rules",
     "gold_metrics"),
    ("Silver", "L2-REC-COUNT", "Count Reconciliation: Unexplained Valid Row Loss", _zero("lost_document_rows"),
     "completeness", "layer_2_reconciliation"),
    ("Silver", "L2-REC-KEY", "Key-Set Reconciliation: Bronze ⊇ Silver, Silver ⊇ Gold keys",
     _zero("(silver_rows_unknown + greatest(0, total_orders - silver_documents))"), "consistency",
     "layer_2_reconciliation"),
    ("Gold", "L2-REC-REV", "Revenue Reconciliation: Silver SUM vs Gold (within rounding tolerance)",
     ("CASE WHEN gap <= 1 THEN 'PASS' ELSE 'FAIL' END", "gap"), "accuracy", "layer_2_reconciliation", "gold_metrics"),
    ("Gold", "L2-REC-AGG", "Aggregate Cross-Check: Recompute Gold from Silver",
     _zero("(CASE WHEN gap > 1 THEN 1 ELSE 0 END + CASE WHEN total_orders <> silver_documents THEN 1 ELSE 0 END "
           "+ CASE WHEN total_customers <> customers THEN 1 ELSE 0 END)"),
     "accuracy", "layer_2_reconciliation", "gold_metrics"),
    ("Bronze", "L3-ANO-BRONZE", "Robust Anomaly: Bronze Row Count", _l3("bronze_count", "b_n"), "completeness",
     "layer_3_robust_anomaly"),
    ("Silver", "L3-ANO-SILVER", "Robust Anomaly: Silver Row Count", _l3("silver_count", "s_n"), "completeness",
     "layer_3_robust_anomaly"),
    ("Silver", "L3-ANO-DROP_P", "Robust Anomaly: Bronze-to-Silver Drop %", _l3("drop_pct", "d"), "completeness",
     "layer_3_robust_anomaly"),
    ("Gold", "L3-ANO-GOLD_R", "Robust Anomaly: Gold Revenue", _l3("gold_revenue", "total_revenue"), "accuracy",
     "layer_3_robust_anomaly"),
]


def _quote(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else f"'{value}'"


def _select(seq: int, layer: str, check_id: str, name: str, status_value, *tags: str | None) -> str:
    status, value = status_value
    dimension, detection, table = (*tags, None, None, None)[:3]
    return (
        f"SELECT pipeline, {seq} AS seq, '{check_id}' AS check_id, {_quote(name)} AS check_name, '{layer}' AS layer, "
        f"{status} AS detected, CAST({value} AS DOUBLE) AS observed, {_quote(dimension)} AS dimension, "
        f"{_quote(detection)} AS detection_layer, {_quote(table)} AS table_name FROM m"
    )


_SELECTS = [
    *[_select(i, "Bronze", *row) for i, row in enumerate(_CAT_BRONZE)],
    *[_select(i, "Silver", *row) for i, row in enumerate(_CAT_SILVER)],
    *[_select(i, "Gold", *row) for i, row in enumerate(_CAT_GOLD)],
    *[_select(1000 + i, *row) for i, row in enumerate(_DETECTED)],
]
_RANK = "CASE {0} WHEN 'PASS' THEN 1 WHEN 'WARN' THEN 2 WHEN 'IMPACTED' THEN 3 WHEN 'FAIL' THEN 4 END"
_NAME = "CASE coalesce({0}, 1) WHEN 1 THEN 'PASS' WHEN 2 THEN 'WARN' WHEN 3 THEN 'IMPACTED' ELSE 'FAIL' END"


def _worst(condition: str) -> str:
    return _NAME.format(f"max({_RANK.format('status')}) FILTER ({condition})")


_BLAME = """CASE WHEN bronze = 'FAIL' THEN 'Source → Bronze' WHEN silver = 'FAIL' THEN 'Bronze → Silver'
  WHEN gold = 'FAIL' THEN 'Silver → Gold' WHEN gold = 'IMPACTED' AND silver <> 'PASS' THEN 'Bronze → Silver' END"""
_RES = _BASE + _M + ",\nfound AS MATERIALIZED (" + "\nUNION ALL ".join(_SELECTS) + f"""),
silver_state AS (
  SELECT pipeline, {_NAME.format('max(' + _RANK.format('detected') + ')')} AS up FROM found
  WHERE layer = 'Silver' GROUP BY pipeline
),
core AS (
  SELECT found.* EXCLUDE (detected), detected AS detected_status,
    CASE WHEN layer = 'Gold' AND detection_layer = 'layer_3_robust_anomaly' AND up = 'FAIL' AND detected = 'FAIL'
      THEN 'IMPACTED' ELSE detected END AS status
  FROM found JOIN silver_state USING (pipeline)
),
states AS (
  SELECT pipeline, {_worst("layer = 'Bronze'")} AS bronze, {_worst("layer = 'Silver'")} AS silver,
    {_worst("layer = 'Gold'")} AS gold,
    {_worst("check_id IN ('B1', 'B3')")} AS x1, {_worst("check_id IN ('S1', 'S8', 'S9', 'S10')")} AS x2,
    {_worst("check_id IN ('G1', 'G2', 'G3', 'G4', 'G6')")} AS x3
  FROM core GROUP BY pipeline
),
blamed AS (SELECT *, {_BLAME} AS blame FROM states),
cross_rows AS (
  SELECT pipeline, 0 AS seq, 'X1' AS check_id, 'Source to Bronze Completeness' AS check_name, x1 AS status,
    '"' || x1 || '"' AS shown FROM blamed
  UNION ALL SELECT pipeline, 1, 'X2', 'Bronze to Silver Transformation Quality', x2, '"' || x2 || '"' FROM blamed
  UNION ALL SELECT pipeline, 2, 'X3', 'Silver to Gold Metric Correctness', x3, '"' || x3 || '"' FROM blamed
  UNION ALL SELECT pipeline, 3, 'X4', 'First Failed Layer Locator',
    CASE WHEN blame IS NULL THEN 'PASS' ELSE 'FAIL' END, '"' || blame || '"' FROM blamed
),
res AS MATERIALIZED (
  SELECT pipeline, 'r1' AS run_id, seq, check_id, check_name, layer, status, observed, dimension, detection_layer,
    table_name, detected_status FROM core
  UNION ALL
  SELECT pipeline, 'r1', seq, check_id, check_name, 'Cross-Layer', status, NULL, NULL, NULL, NULL, status
  FROM cross_rows
)
"""
ORACLES["check_results"] = _RES + """
SELECT pipeline, run_id, seq, check_id, check_name, layer, status, round(observed, 2) AS observed_value,
  dimension, detection_layer, table_name FROM res"""
ORACLES["detection_stack"] = _RES + """
SELECT pipeline, detection_layer, detected_status AS status, count(*) AS checks FROM res
WHERE detection_layer IS NOT NULL GROUP BY 1, 2, 3"""
ORACLES["cross_layer_checks"] = _RES + """
SELECT pipeline, 'r1' AS run_id, check_id, status, shown AS observed FROM cross_rows"""
ORACLES["layer_status"] = _RES + """
SELECT pipeline, 'r1' AS run_id, 'bronze' AS layer, bronze AS status FROM states
UNION ALL SELECT pipeline, 'r1', 'silver', silver FROM states
UNION ALL SELECT pipeline, 'r1', 'gold', gold FROM states"""
_ANY = "('{0}' IN (bronze, silver, gold))"
_VERDICT = f"""CASE WHEN {_ANY.format('FAIL')} THEN 'NOT TRUSTED'
  WHEN {_ANY.format('IMPACTED')} OR {_ANY.format('WARN')} THEN 'WARNING' ELSE 'TRUSTED' END"""
_LEVEL = f"""CASE WHEN {_ANY.format('FAIL')} THEN 'HIGH'
  WHEN {_ANY.format('IMPACTED')} OR {_ANY.format('WARN')} THEN 'MEDIUM' ELSE 'LOW' END"""
ORACLES["final_verdict"] = _RES + f"""
SELECT pipeline, 'r1' AS run_id, bronze, silver, gold, {_VERDICT} AS final_verdict, {_LEVEL} AS severity FROM states"""
ORACLES["first_failed_layer"] = _RES + "SELECT pipeline, 'r1' AS run_id, blame AS first_failed_layer FROM blamed"
ORACLES["downstream_impact"] = _RES + """
SELECT pipeline, check_id, detected_status, status,
  CASE WHEN status <> detected_status THEN 'true' ELSE 'false' END AS adjusted
FROM res WHERE layer = 'Gold' AND detection_layer = 'layer_3_robust_anomaly'"""
ORACLES["coverage"] = _RES + """
SELECT pipeline, run_id, count(*) AS total_checks, count(*) FILTER (status = 'PASS') AS passed,
  count(*) FILTER (status = 'WARN') AS warned, count(*) FILTER (status = 'FAIL') AS failed,
  count(*) FILTER (status = 'IMPACTED') AS impacted, count(*) FILTER (status = 'SKIPPED') AS skipped,
  count(*) FILTER (status = 'SKIPPED') = 0 AS full_coverage FROM res GROUP BY pipeline, run_id"""
_CAUSES = f""",
causes AS (
  SELECT pipeline, string_agg(check_id, ',' ORDER BY seq) AS ids, count(*) AS k,
    count(*) FILTER (check_id = 'S8') AS s8 FROM res WHERE layer = 'Silver' AND status = 'FAIL' GROUP BY pipeline
),
suspects AS (SELECT pipeline, CASE WHEN lost_rows > 0 THEN {_SUSPECT} END AS suspect FROM kc)
"""
ORACLES["root_cause"] = _RES + _CAUSES + """
SELECT pipeline, 'r1' AS run_id,
  CASE WHEN s8 > 0 THEN 'Valid high-quantity orders were wrongly removed during the Silver transformation.'
    ELSE 'Silver transformation failed checks ' || replace(ids, ',', ', ') || '.' END AS summary,
  ids AS failed_check_ids, suspect AS suspected_filter, CAST(k AS INTEGER) AS evidence_rows
FROM causes JOIN suspects USING (pipeline)"""
ORACLES["run_summary"] = _RES + _CAUSES + f"""
SELECT pipeline, {_VERDICT} AS final_verdict, {_LEVEL} AS severity, CAST(NULL AS VARCHAR) AS verdict_caveat,
  blame AS first_failed_layer,
  CASE WHEN silver = 'FAIL' THEN 'Fix the Silver transformation rule (' || suspect || ') and rerun the ETL.'
    ELSE 'other' END AS suggested_action
FROM blamed JOIN suspects USING (pipeline)"""
ORACLES["report_document"] = _RES + f"""
SELECT pipeline, {_VERDICT} AS verdict, silver, failed, lost_rows AS lost, round(e, 2) AS expected_revenue
FROM states JOIN (SELECT pipeline, count(*) FILTER (status = 'FAIL') AS failed FROM res GROUP BY pipeline)
USING (pipeline) JOIN kc USING (pipeline)
JOIN (SELECT pipeline, sum(quantity * unit_price) AS e FROM lines WHERE quantity > 0 AND unit_price > 0
  GROUP BY pipeline) USING (pipeline)"""
_SECTION = "CASE layer WHEN 'Bronze' THEN 1 WHEN 'Silver' THEN 2 WHEN 'Gold' THEN 3 ELSE 4 END"
_FAILED = f"""
  SELECT *, {_SECTION} AS section FROM res WHERE status IN ('FAIL', 'WARN', 'IMPACTED')
  QUALIFY row_number() OVER (PARTITION BY pipeline, check_id ORDER BY {_SECTION}, seq) = 1
"""
ORACLES["failed_checks"] = _RES + f"SELECT pipeline, run_id, check_id, layer, status FROM ({_FAILED})"
ORACLES["hard_failures"] = _RES + """
SELECT pipeline, run_id, check_id, layer, status FROM res WHERE status IN ('FAIL', 'IMPACTED')"""
ORACLES["top_failures"] = _RES + f"""
SELECT pipeline, run_id, CAST(rank AS INTEGER) AS rank, check_id, status FROM (
  SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY section, seq) AS rank FROM ({_FAILED}))
WHERE rank <= 12"""
ORACLES["caught_by"] = _RES + """
SELECT pipeline, caught_by, count(*) AS checks FROM (
  SELECT pipeline, CASE detection_layer WHEN 'layer_1_rules' THEN 'Rule Library'
    WHEN 'layer_2_reconciliation' THEN 'Reconciliation' WHEN 'layer_3_robust_anomaly' THEN 'Robust Anomaly'
    ELSE CASE WHEN check_id LIKE 'X%' THEN 'Reconciliation' ELSE 'Rule Library' END END AS caught_by FROM res)
GROUP BY 1, 2"""
ORACLES["evidence_for_check"] = _RES + f"""
SELECT pipeline, check_id, layer <> 'Cross-Layer' AS has_sql FROM ({_FAILED})"""
ORACLES["layer_metrics"] = _RES + """
SELECT pipeline, 'r1' AS run_id, 'bronze' AS layer, b_n AS row_count, CAST(NULL AS DOUBLE) AS drop_pct FROM m
UNION ALL SELECT pipeline, 'r1', 'silver', s_n, round(d, 4) FROM m
UNION ALL SELECT pipeline, 'r1', 'gold', total_orders, round((1 - total_orders / s_n) * 100, 4) FROM m"""
ORACLES["layer_metrics_fallback"] = ORACLES["layer_metrics"]
ORACLES["flagged_checks"] = _RES + """
SELECT pipeline, check_id, detected_status FROM res WHERE detection_layer = 'layer_1_rules'
  AND dimension = 'validity' AND starts_with(check_id, 'L1-SIL') AND detected_status IN ('FAIL', 'WARN', 'IMPACTED')"""

# --- release gate ---------------------------------------------------------------

_GATE = """
WITH bronze AS (
  SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'north' ELSE 'south' END AS pipeline, o_orderkey AS order_id,
    CASE WHEN o_orderstatus = 'P' THEN 'INVALID' ELSE 'VALID' END AS status,
    o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0 AS has_discount, o_totalprice AS net_amount,
    strftime(o_orderdate, '%Y-%m') AS run_id FROM orders
),
correct AS (SELECT * FROM bronze WHERE status = 'VALID'),
buggy AS (SELECT * FROM correct WHERE NOT has_discount),
past AS (
  SELECT pipeline, run_id, count(*) AS bronze_count, count(*) FILTER (status = 'VALID') AS silver_count
  FROM bronze GROUP BY 1, 2
),
profile AS (
  SELECT *, round((bronze_count - silver_count) / bronze_count * 100, 2) AS drop_pct
  FROM (SELECT pipeline, count(*) AS bronze_count FROM bronze GROUP BY 1)
  JOIN (SELECT pipeline, count(*) AS silver_count FROM buggy GROUP BY 1) USING (pipeline)
),
baseline AS (
  SELECT pipeline, round(m, 2) AS normal_drop_pct, round(s, 3) AS std_dev, round(m - 3 * s, 2) AS lower_bound,
    round(m + 3 * s, 2) AS upper_bound, 'mean +/- 3 std' AS method
  FROM (SELECT pipeline, avg(x) AS m, stddev_pop(x) AS s FROM
    (SELECT pipeline, (bronze_count - silver_count) / bronze_count * 100 AS x FROM past) GROUP BY 1)
),
anomaly AS (
  SELECT pipeline, NOT inside AS is_anomaly, round(drop_pct, 2) AS drop_today, sigma AS deviation_sigma,
    CASE WHEN sigma >= 10 THEN 'CRITICAL' WHEN sigma >= 3 THEN 'HIGH' WHEN NOT inside THEN 'MEDIUM' ELSE 'LOW' END
      AS severity
  FROM (SELECT *, drop_pct BETWEEN lower_bound AND upper_bound AS inside,
    round(CASE WHEN std_dev = 0 THEN 0 ELSE abs(drop_pct - normal_drop_pct) / std_dev END, 1) AS sigma
    FROM profile JOIN baseline USING (pipeline))
),
cause AS (
  SELECT pipeline, count(*) FILTER (has_discount AND missing) AS dropped_rows FROM (
    SELECT c.pipeline, c.has_discount, b.order_id IS NULL AS missing FROM correct c
    LEFT JOIN buggy b ON c.pipeline = b.pipeline AND c.order_id = b.order_id) GROUP BY 1
),
impact AS (
  SELECT pipeline, round(e, 2) AS expected_revenue_cr, round(a, 2) AS actual_revenue_cr, round(e - a, 2) AS impact_cr,
    CASE WHEN e - a >= 0.25 THEN 'HIGH' WHEN e - a >= 0.05 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
  FROM (SELECT pipeline, sum(net_amount) / 10000000 AS e FROM correct GROUP BY 1)
  JOIN (SELECT pipeline, sum(net_amount) / 10000000 AS a FROM buggy GROUP BY 1) USING (pipeline)
)
"""
ORACLES["gate_profile"] = _GATE + "SELECT * FROM profile"
ORACLES["gate_quality"] = """
SELECT pipeline, CAST(sum(CASE WHEN order_id IS NULL THEN n ELSE 0 END) AS BIGINT) AS bronze_null_order_ids,
  count(*) FILTER (n > 1) AS bronze_duplicate_order_ids FROM (
  SELECT l_returnflag AS pipeline, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END AS order_id,
    count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1"""
ORACLES["gate_baseline"] = _GATE + "SELECT * FROM baseline"
ORACLES["gate_anomaly"] = _GATE + "SELECT * FROM anomaly"
ORACLES["gate_root_cause"] = _GATE + """
SELECT pipeline, 'Silver transformation wrongly filtered valid discounted orders' AS cause, dropped_rows,
  'missing_discounted_orders' AS evidence_ref FROM cause"""
ORACLES["gate_crosscheck"] = _GATE + """
SELECT pipeline, dropped_rows, n AS independent_count, dropped_rows = n AS agrees FROM cause JOIN (
  SELECT pipeline, count(*) FILTER (hit) AS n FROM (SELECT c.pipeline, c.has_discount AND NOT EXISTS (
    SELECT 1 FROM buggy b WHERE b.pipeline = c.pipeline AND b.order_id = c.order_id) AS hit FROM correct c)
  GROUP BY 1) USING (pipeline)"""
ORACLES["gate_impact"] = _GATE + "SELECT * FROM impact"
ORACLES["gate_evidence"] = _GATE + """
SELECT pipeline, 'Bronze order count' AS name, format('{:,} rows', bronze_count) AS result FROM profile
UNION ALL SELECT pipeline, 'Silver valid count (today)', format('{:,} rows', silver_count) FROM profile
UNION ALL SELECT pipeline, 'Gold revenue delta', format('Rs {:.2f} Cr', actual_revenue_cr) FROM impact"""
ORACLES["gate_report"] = _GATE + """
SELECT pipeline,
  CASE WHEN severity = 'CRITICAL' OR risk_level = 'HIGH' THEN 'BLOCK PUBLISH'
    WHEN is_anomaly OR risk_level = 'MEDIUM' THEN 'WARN' ELSE 'ALLOW PUBLISH' END AS decision,
  concat_ws('; ',
    CASE WHEN is_anomaly THEN format('Bronze->Silver drop {:.0f}% vs learned normal {:.2f}% (+/- 3 std)',
      drop_pct, normal_drop_pct) END,
    CASE WHEN impact_cr > 0 THEN format('Gold revenue Rs {:.2f} Cr below expected', impact_cr) END,
    CASE WHEN dropped_rows > 0 THEN 'Finance Board Dashboard impacted' END) AS reasons,
  severity, risk_level, 3 AS evidence_rows,
  'Review the Silver transformation filter. The likely issue is that valid discounted orders are being excluded by the condition is_discounted == 0.' AS suggested_action
FROM profile JOIN baseline USING (pipeline) JOIN anomaly USING (pipeline) JOIN cause USING (pipeline)
JOIN impact USING (pipeline)"""

# --- result store -----------------------------------------------------------------

_STORED = _GATE + ", stored AS (SELECT pipeline, run_id, bronze_count, silver_count FROM past)"
ORACLES["latest_report"] = _STORED + """
SELECT * FROM stored QUALIFY row_number() OVER (PARTITION BY pipeline ORDER BY run_id DESC) = 1"""
ORACLES["report_by_id"] = _STORED + """
SELECT pipeline, run_id, bronze_count, silver_count + 1 AS silver_count FROM stored WHERE run_id = '1995-06'"""
ORACLES["stored_runs"] = _STORED + """
SELECT pipeline, run_id, CAST(1 AS BIGINT) AS stored_rows,
  CASE WHEN run_id < '1997' THEN '2001-01-01' ELSE '2001-01-02' END AS stamped FROM stored"""
ORACLES["stored_results"] = _STORED + """
SELECT pipeline, left(run_id, 4) AS year, CAST(sum(bronze_count) AS BIGINT) AS bronze_count,
  CAST(sum(silver_count + CASE WHEN run_id = '1995-06' THEN 1 ELSE 0 END) AS BIGINT) AS silver_count
FROM stored GROUP BY 1, 2"""

# --- sources ----------------------------------------------------------------------

_CSV_LINES = """
WITH t AS (SELECT l_partkey % 20 AS part, l_partkey % 40 = 2 AS nobody, CAST(l_quantity AS BIGINT) AS q FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""
ORACLES["read_csv_quarantine"] = _CSV_LINES + """
SELECT CASE WHEN part < 2 THEN 'not 8 well-formed fields' WHEN part > 2 THEN 'good'
    WHEN nobody THEN 'quantity is no bigint; customer_id is no bigint' ELSE 'quantity is no bigint' END AS reason,
  count(*) AS lines, CAST(sum(q) FILTER (part > 2) AS BIGINT) AS quantity, count(*) FILTER (part = 3) AS quoted
FROM t GROUP BY 1"""
ORACLES["quarantine_checks"] = _CSV_LINES + """
SELECT 'B1' AS check_id, 'FAIL' AS status, count(*) AS lines, count(*) FILTER (part <= 2) AS bad_lines FROM t"""
ORACLES["read_gate_files"] = _GATE + """
SELECT 'bronze_orders' AS table_name, count(*) AS lines, count(*) FILTER (order_id % 10 = 0) AS bad_lines FROM bronze
UNION ALL SELECT 'silver_orders_correct', count(*), count(*) FILTER (order_id % 10 = 0) FROM correct
UNION ALL SELECT 'silver_orders_buggy', count(*), count(*) FILTER (order_id % 10 = 0) FROM buggy
UNION ALL SELECT 'historical_runs', count(*), 0 FROM past"""
ORACLES["frames_as_layers"] = """
SELECT count(*) FILTER (n_regionkey = 0) AS orphans, (SELECT CAST(sum(r_regionkey) AS BIGINT) FROM region) AS codes FROM nation"""
ORACLES["bronze_stop"] = _BASE + """
SELECT pipeline, check_id, CASE WHEN check_id = 'B3' OR check_id = 'B1' AND n = even THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT pipeline, count(*) AS n, count(*) FILTER (stock_code % 2 = 0) AS even FROM lines GROUP BY pipeline),
  (VALUES ('B1'), ('B3'), ('B4')) AS c(check_id)"""

ORACLES["order_statistics"] = """
SELECT l_returnflag, count(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1,
  round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3,
  round(mad(l_extendedprice), 6) AS mad FROM lineitem GROUP BY l_returnflag"""

# --- outcomes ---------------------------------------------------------------------

ORACLES["verdict_outcomes"] = _RES + _CAUSES + f""",
told AS (
  SELECT pipeline, v, layer, check_id, CASE
    WHEN v = 'skips' AND check_id = 'S9' THEN 'SKIPPED' WHEN v IN ('healthy', 'skips') THEN 'PASS'
    WHEN v = 'ingestion' THEN CASE WHEN layer = 'Bronze' THEN status ELSE 'PASS' END
    WHEN v = 'warned' THEN CASE WHEN status = 'FAIL' THEN 'WARN' ELSE status END
    WHEN v = 'metrics' THEN CASE WHEN layer = 'Gold' THEN status ELSE 'PASS' END
    WHEN layer = 'Bronze' THEN 'PASS' WHEN layer = 'Gold' AND status = 'FAIL' THEN 'IMPACTED' ELSE status END AS status
  FROM core, (VALUES ('healthy'), ('skips'), ('ingestion'), ('warned'), ('loss'), ('metrics')) AS versions(v)
),
layered AS (
  SELECT pipeline, v, {_worst("layer = 'Bronze'")} AS bronze, {_worst("layer = 'Silver'")} AS silver,
    {_worst("layer = 'Gold'")} AS gold, count(*) FILTER (status = 'SKIPPED') AS skipped FROM told GROUP BY 1, 2
),
judged AS (SELECT *, {_VERDICT} AS verdict, {_LEVEL} AS level, {_BLAME} AS blame FROM layered),
final AS (SELECT *, verdict = 'TRUSTED' AND skipped > 0 AS lowered FROM judged)
SELECT pipeline || '/' || v AS pipeline, bronze, silver, gold, skipped,
  CASE WHEN lowered THEN 'WARNING' ELSE verdict END AS final_verdict, CASE WHEN lowered THEN 'MEDIUM' ELSE level END AS severity,
  CASE WHEN lowered THEN 'Coverage incomplete: ' || skipped || ' check(s) skipped; verdict downgraded from TRUSTED.' END
    AS verdict_caveat,
  blame AS first_failed_layer,
  CASE WHEN verdict = 'TRUSTED' AND NOT lowered THEN 'No action required. Pipeline output is trustworthy.'
    WHEN silver = 'FAIL' THEN 'Fix the Silver transformation rule (' || suspect || ') and rerun the ETL.'
    WHEN bronze = 'FAIL' THEN 'Fix ingestion into Bronze and rerun the pipeline.'
    WHEN gold = 'FAIL' THEN 'Fix the Gold aggregation logic and recompute metrics.'
    ELSE 'Review flagged layers before publishing Gold outputs.' END AS suggested_action
FROM final JOIN suspects USING (pipeline)"""

# --- isolation ------------------------------------------------------------------

ORACLES["isolated_metrics"] = """
WITH t AS (SELECT count(*)::DOUBLE AS n, sum(l_quantity) AS q, max(l_partkey)::DOUBLE AS p, max(l_discount) AS d,
  sum(l_linenumber)::DOUBLE AS l FROM lineitem)
SELECT * FROM (SELECT unnest(['rows', 'quantity', 'parts', 'discount', 'lines', 'flag', 'inverse']) AS metric,
  unnest([n, q, p, d, l, NULL, NULL]) AS value FROM t)"""
ORACLES["gold_reconcile_rows"] = _BASE + """
SELECT pipeline, CAST(CASE WHEN orders % 2 = 1 THEN 0 ELSE 6 END AS BIGINT) AS passed,
  CAST(CASE WHEN orders % 2 = 1 THEN 6 ELSE 0 END AS BIGINT) AS failed FROM fresh"""

# --- fault injection ----------------------------------------------------------

_HEALTHY_LINES = """
  SELECT l_orderkey * 10 + l_linenumber AS invoice_no, l_partkey AS stock_code,
    l_returnflag || '-' || l_linestatus AS description, CAST(l_quantity AS BIGINT) AS quantity,
    CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS invoice_date,
    floor(l_extendedprice * 100 / l_quantity) / 100 AS unit_price, o_custkey AS customer_id, n_name AS country
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey"""
# Of rows that repeat a line key the least row stays.
_LEAST = """QUALIFY row_number() OVER (PARTITION BY invoice_no ORDER BY stock_code NULLS FIRST, description NULLS FIRST,
    quantity NULLS FIRST, invoice_date NULLS FIRST, unit_price NULLS FIRST, customer_id NULLS FIRST, country NULLS FIRST) = 1"""
_HEALTHY = f"""
WITH rows_ AS ({_HEALTHY_LINES}
),
silver AS (
  SELECT *, quantity * unit_price AS net_revenue FROM (
    SELECT invoice_no, quantity, unit_price FROM rows_ {_LEAST})
  WHERE quantity > 0 AND unit_price > 0
)
"""
_SUMS = """count(*) AS row_count, count(invoice_no) AS documents, CAST(sum(quantity) AS BIGINT) AS quantity,
  round(sum(net_revenue), 2) AS revenue"""
ORACLES["inject_row_drop"] = _HEALTHY + """
SELECT CAST(greatest(1, floor(count(*) * 0.75)) AS BIGINT) AS kept_rows, count(*) AS all_rows,
  CAST(0 AS BIGINT) AS foreign_rows FROM silver"""
ORACLES["inject_duplicates"] = _HEALTHY + f"""
SELECT {_SUMS} FROM (SELECT * FROM silver UNION ALL SELECT * FROM (SELECT * FROM silver ORDER BY invoice_no LIMIT 10))"""
ORACLES["inject_orphans"] = _HEALTHY + """
, payments AS (SELECT DISTINCT invoice_no FROM rows_ UNION ALL SELECT -1)
SELECT count(*) AS orphans FROM payments p WHERE NOT EXISTS (SELECT 1 FROM rows_ r WHERE r.invoice_no = p.invoice_no)"""
ORACLES["inject_price_inflation"] = _HEALTHY + f"""
SELECT {_SUMS} FROM (SELECT invoice_no, quantity, quantity * (unit_price * 2) AS net_revenue FROM silver)"""
ORACLES["inject_scale_quantity"] = _HEALTHY + f"""
SELECT {_SUMS} FROM (SELECT invoice_no, q AS quantity, q * unit_price AS net_revenue FROM
  (SELECT *, CAST(floor(quantity * 1.5) AS BIGINT) AS q FROM silver))"""
ORACLES["inject_null_keys"] = _HEALTHY + f"""
SELECT {_SUMS} FROM (SELECT CASE WHEN rank <= 5 THEN NULL ELSE invoice_no END AS invoice_no, quantity, net_revenue
  FROM (SELECT *, row_number() OVER (ORDER BY invoice_no) AS rank FROM silver))"""

_MATRIX = f"""
WITH bronze AS MATERIALIZED (
  SELECT * FROM ({_HEALTHY_LINES}) {_LEAST}
),
hs AS MATERIALIZED (
  SELECT *, quantity * unit_price AS net_revenue, row_number() OVER (ORDER BY invoice_no) AS rn FROM bronze
  WHERE quantity > 0 AND unit_price > 0
),
size AS (SELECT count(*) AS n, sum(net_revenue) AS revenue FROM hs),
sil AS MATERIALIZED (
  SELECT 'healthy' AS pipeline, * FROM hs
  UNION ALL SELECT 'orphans', * FROM hs
  UNION ALL SELECT 'row_drop', * FROM hs WHERE rn <= (SELECT floor(n * 0.7) FROM size)
  UNION ALL SELECT 'duplicates', * FROM hs
  UNION ALL SELECT 'duplicates', * FROM hs WHERE rn <= 10
  UNION ALL SELECT 'price_inflation', * REPLACE (unit_price * 2 AS unit_price, net_revenue * 2 AS net_revenue) FROM hs
  UNION ALL SELECT 'null_keys', * REPLACE (CASE WHEN rn > 5 THEN invoice_no END AS invoice_no) FROM hs
  UNION ALL SELECT 'scale_quantity', * REPLACE (quantity * 2 AS quantity, net_revenue * 2 AS net_revenue) FROM hs
),
fresh AS (SELECT pipeline, count(*) AS n, sum(net_revenue) AS revenue, count(DISTINCT invoice_no) AS orders,
  count(DISTINCT customer_id) AS customers FROM sil GROUP BY pipeline),
gold AS (SELECT f.pipeline, CASE WHEN f.pipeline = 'price_inflation' THEN size.revenue ELSE f.revenue END AS revenue,
  f.orders, f.customers FROM fresh f, size),
nulls AS (SELECT pipeline, bool_or({" OR ".join(f"{c} IS NULL" for c in _MANDATORY)}) AS hit,
  bool_or(quantity <= 0) AS quan, bool_or(unit_price <= 0) AS unit, bool_or({_DAY} IS NULL) AS days,
  max({_DAY}) > DATE '2001-12-31' OR max({_DAY}) < DATE '2001-12-31' - 365 AS old,
  max({_DAY}) - min({_DAY}) > 365 AS span FROM sil GROUP BY pipeline),
bronze_flags AS (SELECT CAST(bool_or({" OR ".join(f"{c} IS NULL" for c in _MANDATORY)}) AS INT)
  + CAST(bool_or(unit_price < 0) AS INT) + CAST(bool_or({_DAY} IS NULL) AS INT)
  + CAST(max({_DAY}) > DATE '2001-12-31' OR max({_DAY}) < DATE '2001-12-31' - 365 AS INT)
  + CAST(max({_DAY}) - min({_DAY}) > 365 AS INT) AS k FROM bronze),
dups AS (SELECT pipeline, max(n) > 1 AS pk FROM (SELECT pipeline, invoice_no, count(*) AS n FROM sil GROUP BY 1, 2)
  GROUP BY 1),
row_dups AS (SELECT pipeline, max(n) > 1 AS whole FROM
  (SELECT pipeline, invoice_no, stock_code, quantity, unit_price, net_revenue, country, customer_id, invoice_date,
    description, count(*) AS n FROM sil GROUP BY ALL) GROUP BY 1),
missing AS (SELECT p.pipeline, count(*) AS k FROM (SELECT DISTINCT pipeline FROM sil) p, bronze b
  WHERE NOT EXISTS (SELECT 1 FROM sil s WHERE s.pipeline = p.pipeline AND s.invoice_no = b.invoice_no)
  AND quantity > 0 AND unit_price > 0 GROUP BY 1),
unknown AS (SELECT pipeline, count(*) AS k FROM sil s
  WHERE NOT EXISTS (SELECT 1 FROM bronze b WHERE b.invoice_no = s.invoice_no) GROUP BY 1),
past AS (SELECT i, n + i AS c, i * 0.05 AS d, revenue * (1 + i * 0.001) AS r
  FROM size, (SELECT unnest(range(-7, 8)) AS i)),
points AS (SELECT 'c' AS metric, CAST(c AS DOUBLE) AS x FROM past UNION ALL SELECT 'd', d FROM past
  UNION ALL SELECT 'r', r FROM past),
stats AS ({_robust('points', 'metric')}),
now_ AS (
  SELECT pipeline, 'c' AS metric, CAST(size.n AS DOUBLE) AS v FROM fresh, size
  UNION ALL SELECT pipeline, 'c', CAST(fresh.n AS DOUBLE) FROM fresh
  UNION ALL SELECT pipeline, 'd', (1 - fresh.n / size.n) * 100 FROM fresh, size
  UNION ALL SELECT pipeline, 'r', revenue FROM gold
)
SELECT pipeline, 'layer_1_rules' AS detection_layer, CAST(bronze_flags.k + hit + quan + unit + days + old + span + pk + whole
  + CASE WHEN pipeline = 'orphans' THEN 1 ELSE 0 END AS BIGINT) AS flagged
FROM (SELECT pipeline, CAST(hit AS INT) AS hit, CAST(quan AS INT) AS quan, CAST(unit AS INT) AS unit,
  CAST(days AS INT) AS days, CAST(old AS INT) AS old, CAST(span AS INT) AS span, CAST(pk AS INT) AS pk,
  CAST(whole AS INT) AS whole FROM nulls JOIN dups USING (pipeline) JOIN row_dups USING (pipeline)), bronze_flags
UNION ALL
SELECT pipeline, 'layer_2_reconciliation', CAST(CASE WHEN missing.k > 0 THEN 1 ELSE 0 END
  + CASE WHEN coalesce(unknown.k, 0) > 0 OR g.orders > f.orders THEN 1 ELSE 0 END
  + CASE WHEN abs(f.revenue - g.revenue) > 1 THEN 1 ELSE 0 END
  + CASE WHEN abs(f.revenue - g.revenue) > 1 OR f.orders <> g.orders OR f.customers <> g.customers THEN 1 ELSE 0 END
  AS BIGINT)
FROM fresh f JOIN gold g USING (pipeline) LEFT JOIN missing USING (pipeline) LEFT JOIN unknown USING (pipeline)
UNION ALL
SELECT pipeline, 'layer_3_robust_anomaly', count(*) FILTER ({_classify('v')} IN ('FAIL', 'WARN')) FROM now_
JOIN stats USING (metric) GROUP BY pipeline
"""
ORACLES["detection_matrix"] = _MATRIX

# --- text -----------------------------------------------------------------------

_CLEAN = (
    "trim(regexp_replace(regexp_replace(regexp_replace(text, "
    "'(password|pwd|secret|token|key)\\s*=\\s*[^\\s]+', '\\1=***', 'gi'), "
    "'\\b[a-z]+://[^\\s]+', '***', 'gi'), '\\s+', ' ', 'g'))"
)
ORACLES["redact_documents"] = f"""
SELECT doc_id, CAST(length(clean) AS INTEGER) AS clean_chars, md5(clean) AS digest
FROM (SELECT doc_id, {_CLEAN} AS clean FROM documents)"""
ORACLES["redact_conversations"] = f"SELECT conv_id, turn, {_CLEAN} AS clean FROM conversations"
