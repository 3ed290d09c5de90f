"""What each query must return, as SQL for DuckDB over the same tables.

Written independently of the DataFrame code: plain windows and built-in aggregates instead of the
distributed operators.
"""

from __future__ import annotations

from checks.testbed import COUNTRIES, HOME
from tillpath.fixed_values import (
    AGE_SHARES,
    CHANNEL_SHARES,
    COUNTRY_REGION,
    NON_PRODUCT_CODES,
    NUMERIC_FEATURES,
    SEGMENT_NAMES,
)

ORACLES: dict[str, str] = {}


def rounded(x: str, digits: int = 2) -> str:
    scale = f"1e{digits}"
    return f"(sign({x}) * floor(abs({x}) * {scale} + 0.5) / {scale})"


def ratio(top: str, bottom: str, digits: int = 2, times: str = "1e0") -> str:
    value = f"(CAST({top} AS DOUBLE) * {times} / nullif(CAST({bottom} AS DOUBLE), 0))"
    return rounded(value, digits)


def percent(top: str, bottom: str, digits: int = 2) -> str:
    return ratio(top, bottom, digits, "1e2")


def hash32(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT)"


def draw(key: str, salt: str, shares: dict[str, float]) -> str:
    number = f"({hash32(f'CAST({key} AS VARCHAR) || ' + repr('|' + salt))} / 4294967296e0)"
    cases, reached = [], 0.0
    for name in list(shares)[:-1]:
        reached = round(reached + shares[name], 10)
        cases.append(f"WHEN {number} < {reached}e0 THEN '{name}'")
    return f"CASE {' '.join(cases)} ELSE '{list(shares)[-1]}' END"


TENURE = """CASE WHEN {d} = 0 THEN 'Single Purchase' WHEN {d} <= 90 THEN '1-3 Months'
WHEN {d} <= 180 THEN '3-6 Months' WHEN {d} <= 365 THEN '6-12 Months' ELSE '12+ Months' END"""

# ---- the star ---------------------------------------------------------------------------------

LINES = """
sale_lines AS (
  SELECT l.*, o.o_custkey, CAST(o.o_orderdate AS DATE) AS day, l_returnflag = 'R' AS is_return,
         CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || CAST(l_orderkey AS VARCHAR) AS invoice_no,
         floor(l_extendedprice * 1e2 / l_quantity + 0.5) / 1e2 AS unit_price
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey)"""

STAR = f"""{LINES},
dates AS (
  SELECT CAST(d AS DATE) AS full_date,
         CAST(date_diff('day', (SELECT min(CAST(o_orderdate AS DATE)) FROM orders), CAST(d AS DATE)) + 1
              AS INTEGER) AS date_id,
         CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
         CAST(quarter(d) AS INTEGER) AS quarter
  FROM (SELECT unnest(generate_series(min(CAST(o_orderdate AS DATE))::TIMESTAMP,
                                      max(CAST(o_orderdate AS DATE))::TIMESTAMP,
                                      INTERVAL 1 DAY)) AS d FROM orders)),
fact AS (
  SELECT invoice_no, o_custkey AS customer_id, l_partkey AS product_id,
         CAST(date_diff('day', (SELECT min(CAST(o_orderdate AS DATE)) FROM orders), day) + 1
              AS INTEGER) AS date_id,
         CAST(CASE WHEN is_return THEN -l_quantity ELSE l_quantity END AS INTEGER) AS quantity,
         CAST(unit_price AS DECIMAL(10,2)) AS unit_price,
         CAST(CASE WHEN is_return THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(12,2))
           AS total_amount,
         is_return
  FROM sale_lines),
customers AS (
  SELECT s.customer_id, n_name AS country, r_name AS region, first_purchase, last_purchase,
         {draw('s.customer_id', 'channel', CHANNEL_SHARES)} AS acquisition_channel,
         {draw('s.customer_id', 'age', AGE_SHARES)} AS age_group
  FROM (SELECT o_custkey AS customer_id, min(day) AS first_purchase, max(day) AS last_purchase
        FROM sale_lines GROUP BY 1) s
  JOIN customer ON c_custkey = s.customer_id
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
products AS (
  SELECT p_partkey AS product_id, CAST(p_partkey AS VARCHAR) AS stock_code, p_name AS description
  FROM part),
dated AS (SELECT f.*, d.full_date, d.year, d.month, d.quarter FROM fact f JOIN dates d USING (date_id))"""


def star(select: str, *more: str) -> str:
    return "WITH " + ",\n".join([STAR, *more]) + "\n" + select


# ---- the raw feed -----------------------------------------------------------------------------

RAW = f"""{LINES},
feed AS (
  SELECT invoice_no AS "Invoice",
         CASE WHEN l_partkey % 97 = 0 THEN 'POST' WHEN l_partkey % 101 = 0 THEN 'M'
              ELSE CAST(l_partkey AS VARCHAR) END AS "StockCode",
         CASE WHEN l_partkey % 5 = 0 THEN '  ' || p_name || ' ' ELSE p_name END AS "Description",
         CAST(CASE WHEN is_return THEN -1 ELSE 1 END * CASE WHEN l_quantity = 7 THEN 0
              WHEN l_quantity = 50 AND l_partkey % 7 = 0 THEN 5000 ELSE l_quantity END AS INTEGER)
           AS "Quantity",
         day AS "InvoiceDate",
         CASE WHEN l_orderkey % 53 = 0 THEN 0e0 WHEN l_partkey % 89 = 0 THEN 0.004e0
              WHEN l_partkey % 83 = 0 THEN 0.015e0 ELSE unit_price END AS "Price",
         CASE WHEN l_orderkey % 9 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS "Customer ID",
         ({COUNTRIES!r})[c_nationkey + 1] AS "Country"
  FROM sale_lines JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey),
raw AS (
  SELECT * FROM feed WHERE "InvoiceDate" < DATE '1999-01-01'
  UNION ALL SELECT * FROM feed WHERE "InvoiceDate" >= DATE '1998-12-01'),
renamed AS (
  SELECT "Invoice" AS invoice, "StockCode" AS stock_code, "Description" AS description,
         "Quantity" AS quantity, "InvoiceDate" AS invoice_date, "Price" AS price,
         "Customer ID" AS customer_id, "Country" AS country FROM raw),
stripped AS (
  SELECT * REPLACE (trim(invoice) AS invoice, trim(stock_code) AS stock_code,
                    trim(description) AS description, trim(country) AS country) FROM renamed),
deduped AS (SELECT DISTINCT * FROM stripped),
flagged AS (SELECT *, coalesce(invoice LIKE 'C%', false) AS is_return FROM deduped),
products_only AS (
  SELECT * FROM flagged WHERE NOT (stock_code IN ({', '.join(repr(c) for c in NON_PRODUCT_CODES)})
    OR (length(stock_code) = 1 AND regexp_matches(stock_code, '^[A-Za-z]$')))),
priced AS (SELECT * FROM products_only WHERE NOT (price <= 0.001e0 AND NOT is_return)),
moved AS (SELECT * FROM priced WHERE quantity <> 0),
bounds AS (
  SELECT CAST(trunc(quantile_cont(quantity, 0.01)) AS INTEGER) AS lo,
         CAST(trunc(quantile_cont(quantity, 0.99)) AS INTEGER) AS hi FROM moved),
capped AS (
  SELECT moved.* REPLACE (CAST(greatest(least(quantity, hi), lo) AS INTEGER) AS quantity)
  FROM moved, bounds),
totalled AS (
  SELECT * REPLACE (CAST(price AS DECIMAL(18,6)) AS price),
         CAST(quantity * CAST(price AS DECIMAL(18,6)) AS DECIMAL(12,2)) AS total_amount FROM capped),
cleaned AS (SELECT * REPLACE (CAST(customer_id AS BIGINT) AS customer_id) FROM totalled)"""

BUILT = f"""{RAW},
span AS (SELECT min(invoice_date) AS lo, max(invoice_date) AS hi FROM cleaned),
dim_dates AS (
  SELECT CAST(date_diff('day', lo, CAST(d AS DATE)) + 1 AS INTEGER) AS date_id,
         CAST(d AS DATE) AS full_date, CAST(isodow(d) - 1 AS INTEGER) AS day_of_week,
         dayname(d) AS day_name, CAST(month(d) AS INTEGER) AS month, monthname(d) AS month_name,
         CAST(quarter(d) AS INTEGER) AS quarter, CAST(year(d) AS INTEGER) AS year,
         false AS is_holiday, isodow(d) >= 6 AS is_weekend
  FROM (SELECT lo, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM span)),
spellings AS (
  SELECT stock_code, description, count(*) AS n FROM cleaned WHERE NOT is_return GROUP BY 1, 2),
named AS (
  SELECT stock_code, description FROM spellings
  QUALIFY row_number() OVER (PARTITION BY stock_code ORDER BY n DESC, description) = 1),
dim_products AS (
  SELECT row_number() OVER (ORDER BY stock_code COLLATE "C") AS product_id, stock_code, description,
         CAST(NULL AS VARCHAR) AS category, avg_unit_price
  FROM named JOIN (SELECT stock_code, (2 * CAST(sum(price) * 1000000 AS HUGEINT) + 10000 * count(price))
                          // (20000 * count(price)) / 1e2 AS avg_unit_price
                   FROM cleaned WHERE NOT is_return GROUP BY 1) USING (stock_code)),
regions AS (
  SELECT unnest({list(COUNTRY_REGION)!r}) AS country, unnest({list(COUNTRY_REGION.values())!r}) AS region),
seen AS (
  SELECT customer_id, first(country ORDER BY invoice_date, invoice, country) AS country,
         min(invoice_date) AS first_purchase, max(invoice_date) AS last_purchase
  FROM cleaned WHERE customer_id IS NOT NULL GROUP BY 1),
dim_customers AS (
  SELECT customer_id, seen.country, first_purchase, last_purchase,
         {draw('customer_id', 'age', AGE_SHARES)} AS age_group,
         coalesce(region, 'Other') AS region,
         {draw('customer_id', 'channel', CHANNEL_SHARES)} AS acquisition_channel
  FROM seen LEFT JOIN regions ON seen.country = regions.country)"""


def raw(select: str, *more: str) -> str:
    return "WITH " + ",\n".join([RAW, *more]) + "\n" + select


def built(select: str, *more: str) -> str:
    return "WITH " + ",\n".join([BUILT, *more]) + "\n" + select


FEED = '"Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country"'
ORACLES["scan_parts_union"] = raw(
    f"""SELECT * REPLACE ("Description" || ' 16" X 24", RED' AS "Description") FROM (SELECT {FEED} FROM raw)"""
)
ORACLES["required_columns"] = raw(
    """SELECT "Country", count(*) AS n_lines, CAST(sum("Quantity") AS BIGINT) AS quantity,
              count("Customer ID") AS n_known, 'missing columns [''Price'']' AS refusal
       FROM feed WHERE "InvoiceDate" < DATE '1999-01-01' GROUP BY 1"""
)
ORACLES["clean_rename"] = raw("SELECT * FROM renamed")
ORACLES["clean_strip"] = raw("SELECT * FROM stripped")
ORACLES["clean_dedup"] = raw("SELECT * FROM deduped")
ORACLES["clean_flag_returns"] = raw("SELECT * FROM flagged")
ORACLES["clean_non_products"] = raw("SELECT * FROM products_only")
ORACLES["clean_prices"] = raw("SELECT * FROM priced")
ORACLES["clean_zero_qty"] = raw("SELECT * FROM moved")
ORACLES["clean_cap_qty"] = raw("SELECT * FROM capped")
ORACLES["clean_total"] = raw(
    "SELECT * REPLACE (CAST(price AS DOUBLE) AS price, CAST(total_amount AS DOUBLE) AS total_amount)"
    " FROM totalled"
)
ORACLES["clean_cast_customer"] = raw(
    "SELECT * REPLACE (CAST(price AS DOUBLE) AS price, CAST(total_amount AS DOUBLE) AS total_amount)"
    " FROM cleaned"
)
_STEP = "SELECT {n} AS step_no, '{step}' AS step, {a} AS rows_before, {b} AS rows_after, {a} - {b} AS rows_removed, '{reason}' AS reason"
_STEPS = [
    (1, "drop_duplicates", "n_raw", "n_distinct", "overlap of parts and exact copies"),
    (2, "filter_non_products", "n_distinct", "n_products", "service and fee codes"),
    (3, "filter_invalid_prices", "n_products", "n_priced", "price too low on a sale"),
    (4, "filter_zero_quantity", "n_priced", "n_moved", "quantity is zero"),
]
ORACLES["cleaning_report"] = raw(
    f"""SELECT s.*, n_raw AS initial_rows, n_moved AS final_rows,
       (SELECT count(*) FROM flagged WHERE is_return) AS returns_flagged,
       (SELECT count(*) FROM moved, bounds WHERE quantity < lo OR quantity > hi) AS quantity_capped,
       (SELECT lo FROM bounds) AS cap_low, (SELECT hi FROM bounds) AS cap_high,
       (SELECT count(customer_id) FROM moved) AS rows_with_customer_id,
       (SELECT count(*) - count(customer_id) FROM moved) AS rows_without_customer_id,
       {percent('(n_raw - n_moved)', 'n_raw')} AS pct_dropped
FROM counts, (""" + " UNION ALL ".join(
        _STEP.format(n=n, step=s, a=a, b=b, reason=r) + " FROM counts" for n, s, a, b, r in _STEPS
    ) + ") s",
    """counts AS (SELECT (SELECT count(*) FROM raw) AS n_raw, (SELECT count(*) FROM deduped) AS n_distinct,
       (SELECT count(*) FROM products_only) AS n_products, (SELECT count(*) FROM priced) AS n_priced,
       (SELECT count(*) FROM moved) AS n_moved)""",
)
ORACLES["dim_dates"] = built("SELECT * FROM dim_dates")
ORACLES["dim_products"] = built("SELECT * FROM dim_products")
ORACLES["dim_customers"] = built("SELECT * FROM dim_customers")
ORACLES["region_map"] = built(
    "SELECT c.country, coalesce(region, 'Other') AS region, count(*) AS line_count "
    "FROM cleaned c LEFT JOIN regions r ON c.country = r.country GROUP BY 1, 2"
)
_CONTENT = " || '|' || ".join(
    f"coalesce(CAST({c} AS VARCHAR), '')"
    for c in [
        "c.invoice", "c.stock_code", "c.description", "c.quantity", "CAST(c.invoice_date AS TIMESTAMP)",
        "c.price", "c.customer_id", "c.country", "c.is_return", "c.total_amount",
    ]
)
ORACLES["fact_transactions"] = built(
    f"""SELECT row_number() OVER (ORDER BY date_id, bucket, digest) AS transaction_id,
       invoice AS invoice_no, customer_id, product_id, date_id, quantity,
       CAST(CAST(price AS DECIMAL(10,2)) AS DOUBLE) AS unit_price, CAST(total_amount AS DOUBLE) AS total_amount, is_return
FROM (SELECT *, {hash32('content')} % 64 AS bucket, md5(content) AS digest
      FROM (SELECT c.*, p.product_id, d.date_id, {_CONTENT} AS content
            FROM cleaned c JOIN dim_products p ON c.stock_code = p.stock_code
            JOIN dim_dates d ON c.invoice_date = d.full_date
            WHERE c.customer_id IN (SELECT customer_id FROM dim_customers)))"""
)
ORACLES["weighted_choice"] = (
    f"SELECT c_custkey AS customer_id, {draw('c_custkey', 'channel', CHANNEL_SHARES)} AS "
    f"acquisition_channel, {draw('c_custkey', 'age', AGE_SHARES)} AS age_group FROM customer"
)
ORACLES["dense_key"] = (
    "SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_partkey) AS name_id FROM part"
)
ORACLES["full_refresh"] = star(
    "SELECT year, month, (SELECT count(*) FROM dated) AS rows_written, count(*) AS rows_read, "
    "CAST(sum(total_amount) AS DOUBLE) AS amount FROM dated GROUP BY 1, 2"
)
ORACLES["star_scan"] = star(
    "SELECT region, year, count(*) AS line_count, CAST(sum(total_amount) AS DOUBLE) AS amount "
    "FROM dated JOIN customers USING (customer_id) WHERE year >= 1995 GROUP BY 1, 2"
)

ORACLES["star_pruned"] = star("""
SELECT region, year, count(*) AS line_count, CAST(sum(total_amount) AS DOUBLE) AS amount
FROM dated JOIN customers USING (customer_id) WHERE quarter = 2 GROUP BY region, year""")

ORACLES["feed_account"] = f"""WITH {RAW},
first_part AS (SELECT ("Quantity" % 13 = 0)::INTEGER AS broken FROM feed WHERE "InvoiceDate" < DATE '1999-01-01')
SELECT 'lines' AS reading, count(*) + sum(broken)::BIGINT AS lines_read, count(*) - sum(broken)::BIGINT AS lines_kept,
       2 * sum(broken)::BIGINT AS lines_refused FROM first_part
UNION ALL SELECT 'quoted', count(*), count(*), 0 FROM first_part"""

# ---- validation -------------------------------------------------------------------------------

_COUNTS = [
    ("dim_dates", "(SELECT count(*) FROM dates)", "(SELECT count(*) FROM dates)"),
    ("dim_products", "(SELECT count(*) FROM products)",
     "(SELECT count(*) FROM products WHERE product_id % 16 <> 0)"),
    ("dim_customers", "(SELECT count(*) FROM customers)",
     "(SELECT count(*) FROM customers WHERE customer_id % 10 <> 0)"),
    ("fact_transactions", "(SELECT count(*) FROM fact)", "(SELECT count(*) FROM fact)"),
]
_COUNT_ROWS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {a} AS expected, {b} AS actual, {a} = {b} AS passed"
    for t, a, b in _COUNTS
)
_ORPHANS = [
    ("dim_customers", "count_if(customer_id % 10 = 0)"),
    ("dim_products", "count_if(product_id % 16 = 0)"),
    ("dim_dates", "count_if(date_id NOT IN (SELECT date_id FROM dates))"),
]
_ORPHAN_ROWS = " UNION ALL ".join(
    f"SELECT '{t}' AS dimension, CAST({e} AS BIGINT) AS orphan_rows, {e} = 0 AS passed FROM fact"
    for t, e in _ORPHANS
)
ORACLES["check_row_counts"] = star(_COUNT_ROWS)
ORACLES["check_orphans"] = star(_ORPHAN_ROWS)
ORACLES["check_null_keys"] = star(
    "SELECT CAST(count_if(customer_id % 7 = 0) AS BIGINT) AS null_rows, "
    "count_if(customer_id % 7 = 0) = 0 AS passed FROM fact"
)
ORACLES["validation_report"] = star(
    f"""SELECT 'row_count:' || table_name AS check, passed,
       'expected=' || expected || ', actual=' || actual AS details FROM ({_COUNT_ROWS})
UNION ALL SELECT 'fk_integrity:' || dimension, passed, 'orphan_rows=' || orphan_rows FROM ({_ORPHAN_ROWS})
UNION ALL SELECT 'no_null_customer_id_in_fact', true, 'null_customer_rows=0'"""
)

# ---- revenue over time ------------------------------------------------------------------------


def periods(*by: str) -> str:
    keys = ", ".join(by)
    return f"""(SELECT {keys}, CAST(sum(total_amount) AS DOUBLE) AS revenue,
        count(DISTINCT customer_id) AS active_customers, count(DISTINCT invoice_no) AS order_count,
        sum(total_amount) AS exact FROM dated WHERE NOT is_return GROUP BY {keys})"""


def change(lag: int, order: str = "year, month") -> str:
    earlier = f"lag(exact, {lag}) OVER (ORDER BY {order})"
    return percent(f"(exact - {earlier})", earlier)


ORACLES["revenue_monthly"] = star(f"""
SELECT year, month, revenue, active_customers, order_count, CAST(0 AS BIGINT) AS return_count,
       CAST(sum(exact) OVER (ORDER BY year, month) AS DOUBLE) AS cumulative_revenue,
       lag(revenue) OVER (ORDER BY year, month) AS prev_month_revenue, {change(1)} AS mom_growth_pct,
       lag(revenue, 12) OVER (ORDER BY year, month) AS yoy_revenue, {change(12)} AS yoy_growth_pct
FROM {periods('year', 'month')}""")
ORACLES["revenue_quarterly"] = star(f"""
SELECT year, quarter, revenue, active_customers, order_count,
       {ratio('exact', 'active_customers')} AS revenue_per_customer
FROM {periods('year', 'quarter')}""")
_MONTHLY_TREND = f"""
SELECT year, month, revenue, active_customers, order_count, {change(1)} AS mom_growth_pct
FROM {periods('year', 'month')}"""
_QUARTERLY_TREND = f"""
SELECT year, quarter AS month, revenue, active_customers, order_count,
       {change(1, 'year, quarter')} AS mom_growth_pct FROM {periods('year', 'quarter')}"""
ORACLES["revenue_trend"] = star(
    f"SELECT 'monthly' AS granularity, * FROM ({_MONTHLY_TREND}) "
    f"UNION ALL SELECT 'quarterly', * FROM ({_QUARTERLY_TREND})"
)
ORACLES["report_csv"] = star(_MONTHLY_TREND)
_HISTORY = """SELECT strftime(full_date, '%Y-%m') AS date, CAST(sum(total_amount) AS DOUBLE) AS revenue
FROM dated WHERE NOT is_return GROUP BY 1"""
ORACLES["revenue_history"] = star(_HISTORY)

# ---- cohorts ----------------------------------------------------------------------------------

RETENTION = f"""
retention AS (
  SELECT strftime(cohort_month, '%Y-%m') AS cohort, cohort_customers, period_number, retained,
         {percent('retained', 'cohort_customers')} AS retention_pct
  FROM (SELECT date_trunc('month', first_purchase) AS cohort_month,
               CAST(date_diff('month', date_trunc('month', first_purchase), date_trunc('month', full_date))
                    AS INTEGER) AS period_number,
               count(DISTINCT d.customer_id) AS retained
        FROM dated d JOIN customers c ON d.customer_id = c.customer_id
        WHERE NOT is_return GROUP BY 1, 2)
  JOIN (SELECT date_trunc('month', first_purchase) AS cohort_month, count(*) AS cohort_customers
        FROM customers GROUP BY 1) USING (cohort_month)
  WHERE period_number BETWEEN 0 AND 12)"""
ORACLES["cohort_retention"] = star("SELECT * FROM retention", RETENTION)
_OFFSETS = ", ".join(
    f"max(retention_pct) FILTER (period_number = {o}) AS m{o}" for o in range(13)
)
ORACLES["cohort_matrix"] = star(f"SELECT cohort, {_OFFSETS} FROM retention GROUP BY 1", RETENTION)

# ---- concentration ----------------------------------------------------------------------------

PARETO = f"""
product_sales AS (
  SELECT product_id, stock_code, description, sum(total_amount) AS exact, sum(quantity) AS units,
         count(DISTINCT customer_id) AS buyers
  FROM fact JOIN products USING (product_id) WHERE NOT is_return GROUP BY 1, 2, 3),
pareto AS (
  SELECT row_number() OVER (ORDER BY exact DESC, product_id) AS rank, stock_code, description,
         CAST(exact AS DOUBLE) AS revenue, CAST(units AS BIGINT) AS units_sold,
         buyers AS unique_buyers,
         CAST(sum(exact) OVER (ORDER BY exact DESC) AS DOUBLE) AS cumulative_revenue,
         {percent('sum(exact) OVER (ORDER BY exact DESC)', 'sum(exact) OVER ()')} AS cumulative_pct,
         {percent('row_number() OVER (ORDER BY exact DESC, product_id)', 'count(*) OVER ()')}
           AS product_pct
  FROM product_sales),
point AS (
  SELECT count(*) AS products, min(rank) FILTER (cumulative_pct >= 80) AS rank_at_level,
         {percent('min(rank) FILTER (cumulative_pct >= 80)', 'count(*)')} AS pct_by_rank,
         {percent('(min(rank) FILTER (cumulative_pct >= 80) - 1)', 'count(*)')} AS pct_by_index
  FROM pareto)"""
ORACLES["pareto_products"] = star("SELECT * FROM pareto", PARETO)
ORACLES["top_products"] = star("SELECT * FROM pareto WHERE rank <= 50", PARETO)
ORACLES["pareto_point"] = star("SELECT * FROM point", PARETO)
ORACLES["pareto_customers"] = star(f"""
SELECT * FROM (
  SELECT row_number() OVER (ORDER BY exact DESC, customer_id) AS rank, customer_id,
         CAST(exact AS DOUBLE) AS revenue,
         {percent('sum(exact) OVER (ORDER BY exact DESC)', 'sum(exact) OVER ()')} AS cumulative_pct,
         {percent('row_number() OVER (ORDER BY exact DESC, customer_id)', 'count(*) OVER ()')}
           AS customer_pct
  FROM (SELECT customer_id, sum(total_amount) AS exact FROM fact WHERE NOT is_return GROUP BY 1))
WHERE customer_pct <= 25 OR rank <= 20""")
ORACLES["global_cumsum"] = """
SELECT o_orderkey, row_number() OVER w AS position,
       CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) OVER w AS DOUBLE) AS running_price,
       count(*) OVER () AS n_rows,
       CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) OVER () AS DOUBLE) AS all_price
FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)"""

# ---- geography --------------------------------------------------------------------------------

GEO = """
places AS (
  SELECT country, region, count(DISTINCT customer_id) AS customers,
         count(DISTINCT invoice_no) AS orders,
         sum(CASE WHEN is_return THEN 0 ELSE total_amount END) AS exact
  FROM fact JOIN customers USING (customer_id) GROUP BY 1, 2)"""
ORACLES["geo_breakdown"] = star(
    f"SELECT country, region, customers, orders, CAST(exact AS DOUBLE) AS revenue, "
    f"{ratio('exact', 'customers')} AS revenue_per_customer FROM places", GEO
)
ORACLES["region_rollup"] = star(
    "SELECT region, CAST(sum(exact) AS DOUBLE) AS revenue, CAST(sum(customers) AS BIGINT) AS customers "
    "FROM places GROUP BY 1", GEO
)
_SHARE = (
    f"SELECT '{HOME}' AS country, "
    f"{percent(f'sum(exact) FILTER (country = {HOME!r})', 'sum(exact)')} AS share_pct, "
    "count(*) AS countries FROM places"
)
ORACLES["country_share"] = star(_SHARE, GEO)

# ---- customers --------------------------------------------------------------------------------

ORACLES["customer_ltv"] = star(f"""
SELECT customer_id, country, region, acquisition_channel, first_purchase, last_purchase,
       CAST(last_purchase - first_purchase AS INTEGER) AS tenure_days,
       CAST(gross AS DOUBLE) AS gross_revenue, CAST(back AS DOUBLE) AS return_value,
       CAST(net AS DOUBLE) AS net_revenue, total_orders, return_orders, active_days,
       {ratio('gross', 'sale_orders')} AS avg_order_value,
       CASE WHEN last_purchase - first_purchase > 30
            THEN {rounded('(CAST(net AS DOUBLE) * 3e1 / (last_purchase - first_purchase))')}
            ELSE CAST(net AS DOUBLE) END AS monthly_revenue_rate,
       {TENURE.format(d='(last_purchase - first_purchase)')} AS tenure_bucket
FROM (SELECT customer_id, sum(CASE WHEN is_return THEN 0 ELSE total_amount END) AS gross,
             sum(CASE WHEN is_return THEN total_amount ELSE 0 END) AS back, sum(total_amount) AS net,
             count(DISTINCT invoice_no) AS total_orders,
             count(DISTINCT invoice_no) FILTER (is_return) AS return_orders,
             count(DISTINCT invoice_no) FILTER (NOT is_return) AS sale_orders,
             count(DISTINCT full_date) AS active_days
      FROM dated GROUP BY 1) JOIN customers USING (customer_id)""")
ORACLES["tenure_summary"] = star(f"""
SELECT tenure_bucket, count(*) AS customer_count, {ratio('sum(net)', 'count(*)')} AS avg_clv,
       {rounded('quantile_cont(CAST(net AS DOUBLE), 0.5)')} AS median_clv,
       CAST(sum(net) AS DOUBLE) AS total_revenue, {ratio('sum(orders)', 'count(*)', 1)} AS avg_orders
FROM (SELECT {TENURE.format(d='(last_purchase - first_purchase)')} AS tenure_bucket, net, orders
      FROM (SELECT customer_id, sum(total_amount) AS net, count(DISTINCT invoice_no) AS orders
            FROM fact GROUP BY 1) JOIN customers USING (customer_id))
GROUP BY 1""")

RFM = """
rfm AS (
  SELECT customer_id,
         CAST((SELECT max(full_date) FROM dates) - max(full_date) AS INTEGER) AS recency_days,
         count(DISTINCT invoice_no) FILTER (NOT is_return) AS frequency,
         sum(CASE WHEN is_return THEN 0 ELSE total_amount END) AS exact
  FROM dated GROUP BY 1
  HAVING count(DISTINCT invoice_no) FILTER (NOT is_return) > 0
     AND sum(CASE WHEN is_return THEN 0 ELSE total_amount END) > 0),
scored AS (
  SELECT *, CAST(exact AS DOUBLE) AS monetary,
         CAST(ntile(5) OVER (ORDER BY recency_days DESC, customer_id) AS INTEGER) AS r_score,
         CAST(ntile(5) OVER (ORDER BY frequency, customer_id) AS INTEGER) AS f_score,
         CAST(ntile(5) OVER (ORDER BY exact, customer_id) AS INTEGER) AS m_score
  FROM rfm),
scores AS (
  SELECT *, r_score || '-' || f_score || '-' || m_score AS rfm_segment,
         r_score + f_score + m_score AS rfm_total FROM scored)"""
ORACLES["rfm_scores"] = star("SELECT * EXCLUDE (exact) FROM scores", RFM)
ORACLES["rfm_summary"] = star(f"""
SELECT rfm_total, count(*) AS customer_count, {ratio('sum(recency_days)', 'count(*)')} AS avg_recency,
       {ratio('sum(frequency)', 'count(*)')} AS avg_frequency,
       {ratio('sum(exact)', 'count(*)')} AS avg_monetary
FROM scores GROUP BY 1""", RFM)
_EXTREME = "customer_id, recency_days, frequency, monetary, rfm_segment, rfm_total"
ORACLES["rfm_top_bottom"] = star(f"""
SELECT 'top' AS side, * FROM (SELECT {_EXTREME} FROM scores ORDER BY rfm_total DESC, customer_id LIMIT 10)
UNION ALL
SELECT 'bottom', * FROM (SELECT {_EXTREME} FROM scores ORDER BY rfm_total, customer_id LIMIT 10)""", RFM)

CHURN = """
churn AS (
  SELECT customer_id, last_purchase,
         CAST((SELECT max(full_date) FROM dates) - last_purchase AS INTEGER) AS days_since_last,
         order_count, CAST(exact AS DOUBLE) AS revenue,
         CAST(exact AS DOUBLE) / nullif(CAST(sold_lines AS DOUBLE), 0) AS avg_txn_value,
         CAST(return_orders AS DOUBLE) / CAST(order_count AS DOUBLE) AS return_rate,
         (SELECT max(full_date) FROM dates) - last_purchase > 90 AS is_churned
  FROM (SELECT customer_id, count(DISTINCT invoice_no) AS order_count,
               count(DISTINCT invoice_no) FILTER (is_return) AS return_orders,
               sum(CASE WHEN is_return THEN 0 ELSE total_amount END) AS exact,
               count_if(NOT is_return) AS sold_lines
        FROM fact GROUP BY 1) JOIN customers USING (customer_id)),
split AS (
  SELECT CAST(count_if(is_churned) AS BIGINT) AS churned,
         CAST(count(*) - count_if(is_churned) AS BIGINT) AS retained, count(*) AS total,
         """ + percent("count_if(is_churned)", "count(*)") + """ AS churn_pct FROM churn)"""
ORACLES["churn_metrics"] = star("SELECT * FROM churn", CHURN)
ORACLES["churn_split"] = star("SELECT * FROM split", CHURN)
_WELCH = """
welch AS (
  SELECT metric, count(v) FILTER (NOT is_churned) AS rn, count(v) FILTER (is_churned) AS cn,
         avg(v) FILTER (NOT is_churned) AS ra, avg(v) FILTER (is_churned) AS ca,
         var_samp(v) FILTER (NOT is_churned) / (count(v) FILTER (NOT is_churned)) AS rv,
         var_samp(v) FILTER (is_churned) / (count(v) FILTER (is_churned)) AS cv
  FROM (""" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, is_churned, CAST({m} AS DOUBLE) AS v FROM churn"
    for m in ("order_count", "revenue", "avg_txn_value", "return_rate")
) + ") GROUP BY 1)"
ORACLES["welch_statistics"] = star(f"""
SELECT metric, rn AS retained_n, cn AS churned_n, {rounded('ra')} AS retained_mean,
       {rounded('ca')} AS churned_mean, {rounded('((ra - ca) / sqrt(rv + cv))', 4)} AS t_statistic,
       {rounded('((rv + cv) * (rv + cv) / (rv * rv / (rn - 1) + cv * cv / (cn - 1)))', 4)} AS df
FROM welch""", CHURN, _WELCH)
_SUMMARY = f"""
SELECT (SELECT CAST(sum(exact) AS DOUBLE) FROM {periods('year', 'month')}) AS total_revenue,
       (SELECT year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') FROM {periods('year', 'month')}
        ORDER BY exact DESC, year, month LIMIT 1) AS peak_month,
       (SELECT {ratio('sum(CAST(g AS DECIMAL(18,2)))', 'count(g)')}
        FROM (SELECT {change(1)} AS g FROM {periods('year', 'month')})) AS avg_mom_growth,
       (SELECT {ratio('sum(CAST(retention_pct AS DECIMAL(18,2)))', 'count(*)')} FROM retention
        WHERE period_number = 3) AS avg_3month_retention,
       (SELECT pct_by_index FROM point) AS pareto_pct_products_for_80_revenue,
       (SELECT share_pct FROM ({_SHARE})) AS home_revenue_share,
       (SELECT churn_pct FROM split) AS churn_rate"""
ORACLES["eda_summary"] = star(_SUMMARY, RETENTION, PARETO, GEO, CHURN)
ORACLES["report_json"] = ORACLES["eda_summary"]

# ---- customer feature table and serving -------------------------------------------------------

_KEY = hash32("CAST(customer_id AS VARCHAR)")
TABLE = f"""
features AS (
  SELECT customer_id, recency_days, frequency, exact, CAST(exact AS DOUBLE) AS monetary,
         CASE WHEN {_KEY} % 11 <> 0 THEN CAST({_KEY} % 4 AS INTEGER) END AS cluster_id,
         CASE WHEN {_KEY} % 11 <> 0 THEN 'Segment ' || ({_KEY} % 4) END AS segment_name,
         recency_days > 90 AS churn_label,
         CASE WHEN {_KEY} % 13 <> 0 THEN ({_KEY} % 10000) / 1e4 END AS churn_probability
  FROM rfm)"""


def served(select: str, *more: str) -> str:
    return star(select, RFM, TABLE, *more)


_OPEN = """CAST(NULL AS DOUBLE) AS avg_order_value, CAST(NULL AS DOUBLE) AS return_rate,
CAST(NULL AS BIGINT) AS product_diversity, CAST(NULL AS INTEGER) AS days_active,
CAST(NULL AS DOUBLE) AS purchase_trend"""
_FRESH = "customer_id % 3 <> 0"
_OLD = "customer_id % 2 = 0"
ORACLES["merge_segments"] = served(f"""
SELECT customer_id, CASE WHEN {_FRESH} THEN recency_days + 1 ELSE recency_days END AS recency_days,
       frequency, monetary, {_OPEN},
       CASE WHEN {_FRESH} THEN '5-5-5' END AS rfm_segment,
       CASE WHEN {_FRESH} THEN 9 ELSE cluster_id END AS cluster_id,
       CASE WHEN {_FRESH} THEN 'Fresh' ELSE segment_name END AS segment_name,
       CASE WHEN {_OLD} THEN churn_label ELSE false END AS churn_label,
       CASE WHEN {_OLD} THEN churn_probability END AS churn_probability
FROM features WHERE {_FRESH} OR {_OLD}""")
_NEW_P = f"(({_KEY} % 1000) / 1e3)"
ORACLES["merge_scores"] = served(f"""
SELECT customer_id, recency_days, frequency, monetary, {_OPEN}, CAST(NULL AS VARCHAR) AS rfm_segment,
       cluster_id, segment_name,
       CASE WHEN {_FRESH} THEN {_NEW_P} >= 0.5 ELSE churn_label END AS churn_label,
       CASE WHEN {_FRESH} THEN {_NEW_P} ELSE churn_probability END AS churn_probability
FROM features WHERE {_OLD}""")
ORACLES["kpi_summary"] = served(f"""
SELECT CAST(sum(CASE WHEN is_return THEN 0 ELSE total_amount END) AS DOUBLE) AS total_revenue,
       count(DISTINCT customer_id) AS active_customers, count(DISTINCT invoice_no) AS total_orders,
       {ratio('sum(CASE WHEN is_return THEN 0 ELSE total_amount END)',
              'count(DISTINCT invoice_no) FILTER (NOT is_return)')} AS avg_order_value,
       (SELECT {percent('count_if(churn_label)', 'count(churn_label)')} FROM features) AS churn_rate
FROM fact""")
SEGMENTS = f"""
segments AS (
  SELECT cluster_id, segment_name, count(*) AS customer_count,
         {ratio('sum(recency_days)', 'count(*)')} AS avg_recency,
         {ratio('sum(frequency)', 'count(*)')} AS avg_frequency,
         {ratio('sum(exact)', 'count(*)')} AS avg_monetary,
         {percent('count_if(churn_label)', 'count(*)')} AS churn_rate
  FROM features WHERE segment_name IS NOT NULL GROUP BY 1, 2)"""
ORACLES["segment_summary"] = served("SELECT * FROM segments", SEGMENTS)
ORACLES["segment_share"] = served(
    "SELECT segment_name, customer_count, avg_monetary, "
    f"{percent('customer_count', 'sum(customer_count) OVER ()', 1)} AS share_pct FROM segments",
    SEGMENTS,
)
ORACLES["churn_risk_page"] = served("""
SELECT customer_id, churn_probability, 'medium' AS risk_tier, segment_name, recency_days, frequency,
       monetary, count(*) OVER () AS total
FROM features WHERE churn_probability >= 0.4 AND churn_probability < 0.7 AND segment_name = 'Segment 1'
ORDER BY churn_probability DESC, customer_id LIMIT 20 OFFSET 20""")

# ---- segmentation -----------------------------------------------------------------------------


def _z(column: str) -> str:
    x = f"ln(1 + CAST({column} AS DOUBLE))"
    return rounded(f"(({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER ())", 6)


ORACLES["rfm_features"] = star(
    f"SELECT customer_id, {_z('recency_days')} AS recency_days_z, {_z('frequency')} AS frequency_z, "
    f"{_z('exact')} AS monetary_z FROM rfm", RFM
)
PROFILES = f"""
profiles AS (
  SELECT cluster_id, count(*) AS customer_count,
         {ratio('sum(recency_days)', 'count(*)')} AS avg_recency,
         {ratio('sum(frequency)', 'count(*)')} AS avg_frequency,
         {ratio('sum(exact)', 'count(*)')} AS avg_monetary,
         {rounded('quantile_cont(monetary, 0.5)')} AS median_monetary,
         {ratio('sum(rfm_total)', 'count(*)')} AS avg_rfm_total
  FROM (SELECT *, CAST({_KEY} % 4 AS INTEGER) AS cluster_id FROM scores) GROUP BY 1),
labelled AS (
  SELECT *, CASE {' '.join(
      f"WHEN (avg_recency < mr) = {r} AND (avg_frequency > mf) = {f} AND (avg_monetary > mm) = {m} THEN '{n}'"
      for (r, f, m), n in SEGMENT_NAMES.items())} END AS label
  FROM profiles, (SELECT quantile_cont(avg_recency, 0.5) AS mr, quantile_cont(avg_frequency, 0.5) AS mf,
                         quantile_cont(avg_monetary, 0.5) AS mm FROM profiles)),
names AS (
  SELECT * EXCLUDE (label, mr, mf, mm),
         CASE WHEN row_number() OVER (PARTITION BY label ORDER BY avg_rfm_total DESC, cluster_id) > 1
              THEN label || ' (' || cluster_id || ')' ELSE label END AS segment_name
  FROM labelled)"""
ORACLES["segment_profiles"] = star("SELECT * FROM profiles", RFM, PROFILES)
ORACLES["segment_names"] = star("SELECT * FROM names", RFM, PROFILES)
ORACLES["assign_segments"] = star("""
SELECT customer_id, s.cluster_id, coalesce(segment_name, 'Segment ' || s.cluster_id) AS segment_name,
       rfm_total
FROM (SELECT *, CAST(""" + _KEY + """ % 4 AS INTEGER) AS cluster_id FROM scores) s
LEFT JOIN (SELECT * FROM names WHERE cluster_id <> 3) n ON s.cluster_id = n.cluster_id""", RFM, PROFILES)

# ---- churn features and metrics ---------------------------------------------------------------

_MID = "first_purchase + CAST((last_purchase - first_purchase) // 2 AS INTEGER)"
FEATURES = f"""
model_rows AS (
  SELECT d.customer_id,
         CAST((SELECT max(full_date) FROM dates) - max(full_date) AS INTEGER) AS recency_days,
         count(DISTINCT invoice_no) FILTER (NOT is_return) AS frequency,
         CAST(sum(CASE WHEN is_return THEN 0 ELSE total_amount END) AS DOUBLE) AS monetary,
         CAST(sum(CASE WHEN is_return THEN 0 ELSE total_amount END) AS DOUBLE)
           / CAST(count(DISTINCT invoice_no) FILTER (NOT is_return) AS DOUBLE) AS avg_order_value,
         CAST(count(DISTINCT invoice_no) FILTER (is_return) AS DOUBLE)
           / CAST(count(DISTINCT invoice_no) AS DOUBLE) AS return_rate,
         count(DISTINCT invoice_no) FILTER (NOT is_return) AS order_count,
         CAST(max(full_date) - min(full_date) AS INTEGER) AS days_active,
         CAST((SELECT max(full_date) FROM dates) - min(first_purchase) AS INTEGER) AS tenure_days,
         CAST(sum(abs(quantity)) FILTER (NOT is_return) AS DOUBLE)
           / CAST(count(quantity) FILTER (NOT is_return) AS DOUBLE) AS avg_items_per_order,
         count(DISTINCT invoice_no) FILTER (NOT is_return AND full_date >= {_MID})
           - count(DISTINCT invoice_no) FILTER (NOT is_return AND full_date < {_MID}) AS purchase_trend,
         min(region) AS region, min(acquisition_channel) AS acquisition_channel,
         min(age_group) AS age_group,
         (SELECT max(full_date) FROM dates) - max(full_date) > 90 AS churn_label
  FROM dated d JOIN customers c ON d.customer_id = c.customer_id GROUP BY 1),
model_customers AS (SELECT * FROM model_rows WHERE frequency > 0 AND monetary > 0),
gappy AS (
  SELECT * REPLACE (CASE WHEN customer_id % 5 <> 0 THEN avg_items_per_order END AS avg_items_per_order,
                    CASE WHEN customer_id % 7 <> 0 THEN region END AS region) FROM model_customers),
complete AS (
  SELECT * REPLACE (coalesce(avg_items_per_order, 0e0) AS avg_items_per_order,
                    coalesce(region, 'Unknown') AS region) FROM gappy)"""


def modelled(select: str, *more: str) -> str:
    return star(select, FEATURES, *more)


ORACLES["churn_features"] = star(
    "SELECT m.*, f.segment_name, f.cluster_id FROM model_customers m "
    "LEFT JOIN features f ON m.customer_id = f.customer_id", RFM, TABLE, FEATURES
)
ORACLES["purchase_trend"] = modelled("SELECT customer_id, purchase_trend FROM model_rows")
ORACLES["churn_label"] = star(
    "SELECT customer_id, recency_days > 90 AS churned_90, recency_days > 30 AS churned_30 FROM rfm", RFM
)
_NUMBERS = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC_FEATURES)
ORACLES["impute"] = modelled(
    f"SELECT customer_id, {_NUMBERS}, region, acquisition_channel, age_group FROM complete"
)
ORACLES["encode_categories"] = modelled("SELECT customer_id, " + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS {c}_enc"
    for c in ("region", "acquisition_channel", "age_group")
) + " FROM complete")
SPLIT = f"""
placed AS (
  SELECT *, row_number() OVER (
           PARTITION BY churn_label
           ORDER BY {hash32("CAST(customer_id AS VARCHAR) || '|split42'")}, customer_id) AS place,
         count(*) OVER (PARTITION BY churn_label) AS class_rows
  FROM model_customers),
halves AS (SELECT *, place <= floor(class_rows * 0.2e0 + 0.5e0) AS is_test FROM placed)"""
ORACLES["stratified_split"] = modelled("SELECT customer_id, churn_label, is_test FROM halves", SPLIT)
ORACLES["scale_features"] = modelled("SELECT customer_id, is_test, " + ", ".join(
    rounded(
        f"((CAST({c} AS DOUBLE) - (SELECT avg(CAST({c} AS DOUBLE)) FROM halves WHERE NOT is_test)) / "
        f"(SELECT stddev_pop(CAST({c} AS DOUBLE)) FROM halves WHERE NOT is_test))", 6
    ) + f" AS {c}"
    for c in NUMERIC_FEATURES
) + " FROM halves", SPLIT)
_SPREAD = " UNION ALL ".join(
    f"SELECT '{c}_enc' AS feature, count(DISTINCT {c}) / 1e4 AS importance FROM model_customers"
    for c in NUMERIC_FEATURES
)
ORACLES["top_features"] = modelled(f"""
SELECT feature, {rounded('importance', 4)} AS importance,
       array_to_string(list_transform(string_split(replace(feature, '_enc', ''), '_'),
         lambda w: upper(w[1]) || substr(w, 2)), ' ') AS display_name
FROM ({_SPREAD}) ORDER BY importance DESC, feature LIMIT 5""")

SCORED = f"""
bases AS (SELECT customer_id, CAST(churn_label AS INTEGER) AS label, ({_KEY} % 10000) / 1e4 AS base
          FROM model_customers),
scored AS (
  SELECT customer_id, label, 'hash' AS model, base AS score FROM bases
  UNION ALL SELECT customer_id, label, 'informed', floor((base + label) * 5e3) / 1e4 FROM bases
  UNION ALL SELECT customer_id, label, 'coarse', floor(base * 2e1) / 2e1 FROM bases)"""


def judged(select: str, *more: str) -> str:
    return modelled(select, SCORED, *more)


def share(top: str, bottom: str, digits: int = 4) -> str:
    return f"coalesce({ratio(top, bottom, digits)}, 0e0)"


ORACLES["evaluate_models"] = judged(f"""
SELECT model, {share('tp', '(tp + fp)')} AS precision, {share('tp', '(tp + fn)')} AS recall,
       {share('2 * tp', '(2 * tp + fp + fn)')} AS f1, auc_roc,
       {share('(tp + tn)', '(tp + fp + fn + tn)')} AS accuracy
FROM (SELECT model, count_if(score >= 0.5 AND label = 1) AS tp, count_if(score >= 0.5 AND label = 0) AS fp,
             count_if(score < 0.5 AND label = 1) AS fn, count_if(score < 0.5 AND label = 0) AS tn
      FROM scored GROUP BY 1)
JOIN (SELECT model, {rounded('((sum(mean_rank) FILTER (label = 1) - p * (p + 1) / 2e0) / (CAST(p AS DOUBLE) * n))', 4)} AS auc_roc
      FROM (SELECT *, rank() OVER (PARTITION BY model ORDER BY score)
                      + (count(*) OVER (PARTITION BY model, score) - 1) / 2e0 AS mean_rank,
                   sum(label) OVER (PARTITION BY model) AS p,
                   count(*) OVER (PARTITION BY model) - sum(label) OVER (PARTITION BY model) AS n
            FROM scored) GROUP BY model, p, n) USING (model)""")
ORACLES["report_scan"] = ORACLES["evaluate_models"]
ORACLES["model_metrics"] = ORACLES["evaluate_models"].replace("SELECT model, ", "SELECT model AS model_name, ", 1).replace(
    f",\n       {share('(tp + tn)', '(tp + fp + fn + tn)')} AS accuracy", "", 1
)
_SWEEP = """
sweep AS (
  SELECT model, i / 1e2 AS threshold, count_if(hit AND label = 1) AS tp, count_if(hit AND label = 0) AS fp,
         count_if(NOT hit AND label = 1) AS fn
  FROM (SELECT *, score >= i / 1e2 AS hit
        FROM scored, (SELECT unnest(generate_series(10, 89)) AS i)) GROUP BY 1, 2)"""
ORACLES["threshold_sweep"] = judged(f"""
SELECT model, threshold, cost, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, precision, recall, f1
FROM (SELECT model, threshold, fp * 1e1 + fn * 1e2 AS cost, fp, fn,
             {share('tp', '(tp + fp)')} AS precision, {share('tp', '(tp + fn)')} AS recall,
             {share('2 * tp', '(2 * tp + fp + fn)')} AS f1 FROM sweep)
QUALIFY row_number() OVER (PARTITION BY model ORDER BY cost, threshold) = 1""", _SWEEP)
ORACLES["risk_tiers"] = judged("""
SELECT model, customer_id,
       CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS risk_tier,
       CASE WHEN score > 0.7 THEN 'high' WHEN score > 0.4 THEN 'medium' ELSE 'low' END
         AS risk_tier_right_closed
FROM scored""")
ORACLES["roc_points"] = judged("""
SELECT DISTINCT model, score AS threshold,
       CAST(count_if(label = 0) OVER w AS DOUBLE)
         / CAST(count_if(label = 0) OVER (PARTITION BY model) AS DOUBLE) AS fpr,
       CAST(count_if(label = 1) OVER w AS DOUBLE)
         / CAST(count_if(label = 1) OVER (PARTITION BY model) AS DOUBLE) AS tpr
FROM scored WINDOW w AS (PARTITION BY model ORDER BY score DESC)""")
ORACLES["confusion_matrix"] = judged("""
SELECT model, label AS actual, CAST(count_if(score < 0.5) AS BIGINT) AS predicted_0,
       CAST(count_if(score >= 0.5) AS BIGINT) AS predicted_1 FROM scored GROUP BY 1, 2""")

# ---- time series ------------------------------------------------------------------------------

SERIES = """
country_series AS (
  SELECT country AS series_key, CAST(date_trunc('month', full_date) AS DATE) AS month,
         sum(total_amount) AS exact
  FROM dated JOIN customers USING (customer_id) WHERE NOT is_return GROUP BY 1, 2),
total_series AS (
  SELECT 'all' AS series_key, CAST(date_trunc('month', full_date) AS DATE) AS month,
         sum(total_amount) AS exact FROM dated WHERE NOT is_return GROUP BY 1, 2),
all_series AS (SELECT * FROM country_series UNION ALL SELECT * FROM total_series),
marked AS (
  SELECT *, month = max(month) OVER (PARTITION BY series_key) AS is_last FROM all_series),
judged_months AS (
  SELECT *, CAST(sum(exact) FILTER (NOT is_last) OVER (PARTITION BY series_key) AS DOUBLE)
            / CAST(count(*) FILTER (NOT is_last) OVER (PARTITION BY series_key) AS DOUBLE) AS others
  FROM marked),
untruncated AS (
  SELECT series_key, month, exact FROM judged_months
  WHERE NOT coalesce(is_last AND CAST(exact AS DOUBLE) < others * 0.5, false)),
months AS (
  SELECT series_key, CAST(unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE)
           AS month
  FROM (SELECT series_key, min(month) AS lo, max(month) AS hi FROM untruncated GROUP BY 1)),
grid AS (SELECT series_key, month, exact FROM months LEFT JOIN untruncated USING (series_key, month))"""


def timed(select: str, *more: str) -> str:
    return star(select, SERIES, *more)


ORACLES["monthly_series"] = timed(
    "SELECT series_key, month, CAST(exact AS DOUBLE) AS value FROM all_series"
)
ORACLES["drop_truncated_month"] = timed(
    "SELECT series_key, month, CAST(exact AS DOUBLE) AS value FROM untruncated WHERE series_key <> 'all'"
)
ORACLES["regular_grid"] = timed("""
SELECT series_key, month, CAST(exact AS DOUBLE) AS value, exact IS NULL AS is_gap
FROM (SELECT series_key, CAST(unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 MONTH))
             AS DATE) AS month
      FROM (SELECT series_key, min(month) AS lo, max(month) AS hi FROM holed GROUP BY 1))
LEFT JOIN holed USING (series_key, month)""", """
holed AS (SELECT * FROM country_series WHERE NOT (year(month) % 3 = 0 AND month(month) IN (4, 5)))""")
DECOMPOSED = """
trended AS (
  SELECT series_key, month, CAST(exact AS DOUBLE) AS observed,
         CASE WHEN count(exact) OVER near = 11 THEN CAST(2 * sum(exact) OVER near
           + lag(exact, 6) OVER o + lead(exact, 6) OVER o AS DOUBLE) / 24e0 END AS trend
  FROM grid WHERE series_key <> 'all'
  WINDOW o AS (PARTITION BY series_key ORDER BY month),
         near AS (PARTITION BY series_key ORDER BY month ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
  QUALIFY count(exact) OVER (PARTITION BY series_key) >= 24),
phases AS (
  SELECT series_key, month(month) AS phase, avg(observed - trend) AS phase_mean FROM trended GROUP BY 1, 2),
levels AS (SELECT series_key, avg(phase_mean) AS level FROM phases GROUP BY 1),
parts AS (
  SELECT t.series_key, t.month, observed, trend, phase_mean - level AS seasonal,
         observed - trend - (phase_mean - level) AS residual
  FROM trended t JOIN phases p ON t.series_key = p.series_key AND month(t.month) = p.phase
  JOIN levels l ON t.series_key = l.series_key)"""
ORACLES["decompose"] = timed("SELECT series_key, month, " + ", ".join(
    f"{rounded(c)} AS {c}" for c in ("observed", "trend", "seasonal", "residual")
) + " FROM parts", DECOMPOSED)
ORACLES["anomalies"] = timed("""
SELECT p.series_key, month, observed AS value, coalesce(residual > q3 + 1.5 * (q3 - q1)
         OR residual < q1 - 1.5 * (q3 - q1), false) AS is_anomaly,
       CASE WHEN residual > q3 + 1.5 * (q3 - q1) THEN 'spike'
            WHEN residual < q1 - 1.5 * (q3 - q1) THEN 'drop' ELSE 'normal' END AS anomaly_type
FROM parts p JOIN (SELECT series_key, quantile_cont(residual, 0.25) AS q1,
                          quantile_cont(residual, 0.75) AS q3 FROM parts GROUP BY 1) USING (series_key)""",
    DECOMPOSED)
ORACLES["walk_forward_folds"] = timed("""
SELECT series_key, CAST(fold AS INTEGER) AS fold, month, CAST(exact AS DOUBLE) AS value,
       pos = n - 6 + fold AS is_test
FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY month) - 1 AS pos,
             count(*) OVER (PARTITION BY series_key) AS n FROM grid WHERE series_key <> 'all'),
     (SELECT unnest(generate_series(0, 5)) AS fold)
WHERE pos <= n - 6 + fold AND n - 6 + fold > 0""")
BASELINES = f"""
steps AS (
  SELECT series_key, month, CAST(exact AS DOUBLE) AS actual,
         row_number() OVER o - 1 AS pos, count(*) OVER (PARTITION BY series_key) AS n,
         CAST(lag(exact) OVER o AS DOUBLE) AS naive, CAST(lag(exact, 12) OVER o AS DOUBLE) AS seasonal_naive,
         CAST(first(exact) OVER o AS DOUBLE) AS first_value
  FROM grid WHERE series_key <> 'all' WINDOW o AS (PARTITION BY series_key ORDER BY month)),
guesses AS (
  SELECT series_key, 'naive' AS model, actual, naive AS predicted FROM steps WHERE pos >= n - 6 AND pos > 0
  UNION ALL SELECT series_key, 'seasonal_naive', actual, seasonal_naive FROM steps
    WHERE pos >= n - 6 AND pos > 0
  UNION ALL SELECT series_key, 'drift', actual,
    naive + coalesce((naive - first_value) / nullif(CAST(pos - 1 AS DOUBLE), 0), 0) FROM steps
    WHERE pos >= n - 6 AND pos > 0),
baseline_scores AS (
  SELECT series_key, model, {rounded('(avg(abs(predicted - actual) / nullif(abs(actual), 0)) * 1e2)')} AS mape,
         {rounded('sqrt(avg((predicted - actual) * (predicted - actual)))')} AS rmse,
         count(*) AS folds_scored -- folds of one month
  FROM guesses WHERE predicted IS NOT NULL GROUP BY 1, 2),
best AS (
  SELECT series_key, model, mape FROM baseline_scores
  QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY folds_scored DESC, mape, model) = 1)"""
ORACLES["forecast_scores"] = timed("SELECT * FROM baseline_scores", BASELINES)
ORACLES["best_forecaster"] = timed("SELECT * FROM best", BASELINES)
NAIVE = """
changes AS (
  SELECT *, CAST(exact AS DOUBLE) - CAST(lag(exact, 12) OVER (PARTITION BY series_key ORDER BY month) AS DOUBLE)
           AS change FROM grid),
spreads AS (
  SELECT series_key, max(month) AS last_month, sqrt(avg(change * change)) AS spread FROM changes GROUP BY 1),
next_months AS (
  SELECT series_key, CAST(month + INTERVAL 12 MONTH AS DATE) AS date, CAST(exact AS DOUBLE) AS forecast,
         CAST(exact AS DOUBLE) - 1.959963984540054e0 * spread AS lower_bound,
         CAST(exact AS DOUBLE) + 1.959963984540054e0 * spread AS upper_bound
  FROM grid JOIN spreads USING (series_key)
  WHERE date_diff('month', last_month, CAST(month + INTERVAL 12 MONTH AS DATE)) BETWEEN 1 AND 6)"""
_BOUNDS = ", ".join(f"{rounded(c)} AS {c}" for c in ("forecast", "lower_bound", "upper_bound"))
ORACLES["seasonal_naive_forecast"] = timed(
    f"SELECT series_key, date, {_BOUNDS} FROM next_months WHERE series_key <> 'all'", NAIVE
)
ORACLES["forecast_totals"] = timed(f"""
SELECT series_key, CAST(sum(CAST(forecast AS DECIMAL(22,2))) AS DOUBLE) AS total_forecast,
       {ratio('sum(CAST(forecast AS DECIMAL(22,2)))', 'count(*)')} AS mean_forecast,
       {rounded('(1e2 - min(mape))')} AS accuracy_pct
FROM next_months JOIN best USING (series_key) GROUP BY 1""", BASELINES, NAIVE)
ORACLES["history_plus_forecast"] = timed(f"""
SELECT date, max(revenue) AS revenue, max(forecast) AS forecast, max(lower_bound) AS lower_bound,
       max(upper_bound) AS upper_bound
FROM (SELECT date, revenue, CASE WHEN is_end THEN revenue END AS forecast,
             CASE WHEN is_end THEN revenue END AS lower_bound, CASE WHEN is_end THEN revenue END AS upper_bound
      FROM (SELECT date, revenue, date = max(date) OVER () AS is_end
            FROM (SELECT *, date = max(date) OVER () AND revenue < 0.5 * avg(revenue) OVER () AS cut
                  FROM ({_HISTORY})) WHERE NOT cut)
      UNION ALL SELECT strftime(date, '%Y-%m'), NULL, {rounded('forecast')}, {rounded('lower_bound')},
             {rounded('upper_bound')} FROM next_months WHERE series_key = 'all')
GROUP BY 1""", NAIVE)
