"""Oracle SQL (DuckDB dialect) for the correctness gate.

``VIEWS`` re-derives the conformed tables of ``sources.catalog`` from the raw
input views as a CTE prefix; each entry of ``QUERIES`` is a full statement
over them. The SQL is written independently of the DataFrame code (row-level
joins where the Spark plan pre-aggregates), so agreement is evidence.
"""

from __future__ import annotations

VIEWS = """
WITH
products AS (
  SELECT p_partkey AS id,
         p_name || ' #' || CAST(p_partkey AS VARCHAR) AS name,
         CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'end_product'
              WHEN p_type = 'SMALL' THEN 'component'
              WHEN p_type = 'PROMO' THEN 'raw_material'
              ELSE 'end_product' END AS category,
         p_type, p_name
  FROM part
),
regions AS (
  SELECT n_nationkey AS id, n_name AS state, r_name AS region
  FROM nation JOIN region ON n_regionkey = r_regionkey
),
sales AS (
  SELECT CAST(o_orderdate AS DATE) AS date,
         l_orderkey AS order_id,
         l_partkey AS product_id,
         CAST(c_nationkey AS BIGINT) AS region_id,
         CAST(l_quantity AS DECIMAL(18,4)) AS quantity,
         l_extendedprice / NULLIF(l_quantity, 0) AS unit_price,
         CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(18,4))) AS DECIMAL(18,4)) AS revenue,
         CASE WHEN l_returnflag = 'R' THEN NULL
              ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(l_tax AS DECIMAL(18,4)) AS DECIMAL(18,4)) END AS profit,
         CASE WHEN l_linestatus = 'O' THEN 'ecommerce' ELSE 'updated_sales' END AS source
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
),
holidays AS (
  SELECT t.name,
         make_date(CAST(y.year AS INTEGER), t.m, t.d) AS date,
         CAST(t.is_public AS INTEGER) AS is_public,
         'India' AS country,
         dayname(make_date(CAST(y.year AS INTEGER), t.m, t.d)) AS weekday
  FROM (VALUES (1, 1, 'New Year', 1), (8, 15, 'Independence Day', 1),
               (11, 12, 'Diwali (Deepavali)', 0), (12, 25, 'Christmas Day', 1)) t(m, d, name, is_public)
  CROSS JOIN (SELECT unnest(generate_series(year(min(o_orderdate)), year(CAST(max(o_orderdate) AS DATE) + 365))) AS year FROM orders) y
),
stock_prices AS (
  SELECT CAST(l_shipdate AS DATE) AS date,
         CASE p_brand WHEN 'Brand#1' THEN 'NVDA' WHEN 'Brand#2' THEN 'SAMSUNG' ELSE 'SONY' END AS ticker,
         min(l_extendedprice) AS open, max(l_extendedprice) AS high,
         min(l_extendedprice) AS low, max(l_extendedprice) AS close,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DECIMAL(38,4)) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')
  GROUP BY 1, 2
),
commodity_monthly AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, p_type,
         CAST(round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE)
                    / CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE), 4) AS DECIMAL(18,4)) AS price_usd
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2
),
commodity_prices AS (
  SELECT date,
         CASE p_type WHEN 'ECONOMY' THEN 'Aluminum' WHEN 'LARGE' THEN 'Copper'
                     WHEN 'MEDIUM' THEN 'Nickel' WHEN 'PROMO' THEN 'Crude oil, Brent'
                     WHEN 'SMALL' THEN 'Natural gas, US' WHEN 'STANDARD' THEN 'Tin' END AS commodity_name,
         price_usd,
         round(100.0 * (CAST(price_usd AS DOUBLE) / CAST(lag(price_usd, 1) OVER w AS DOUBLE) - 1.0), 4) AS price_mom_pct,
         round(100.0 * (CAST(price_usd AS DOUBLE) / CAST(lag(price_usd, 12) OVER w AS DOUBLE) - 1.0), 4) AS price_yoy_pct,
         'C_' || p_type AS commodity_code
  FROM commodity_monthly
  WINDOW w AS (PARTITION BY p_type ORDER BY date)
),
annual AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(count(*) AS DECIMAL(18,4)) AS inflation,
         CAST(count_if(o_orderstatus = 'F') AS DECIMAL(18,4)) AS interest,
         CAST(round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) / (count(*) * 1000), 2) AS DECIMAL(18,4)) AS lithium
  FROM orders GROUP BY 1
),
annual_inflation AS (SELECT year, inflation AS value FROM annual),
annual_interest AS (SELECT year, interest AS value FROM annual),
horizon AS (SELECT CAST(year(CAST(max(o_orderdate) AS DATE) + 365) AS INTEGER) AS year FROM orders),
macro_daily AS (
  SELECT CAST(o_orderdate AS DATE) AS date, CAST(max(o_totalprice) AS DECIMAL(18,2)) AS usd_inr
  FROM orders GROUP BY 1
),
macro_indicators AS (
  SELECT m.date, m.usd_inr, i.value AS inflation_india, r.value AS interest_india
  FROM macro_daily m
  LEFT JOIN annual_inflation i ON year(m.date) = i.year
  LEFT JOIN annual_interest r ON year(m.date) = r.year
),
daily AS (
  SELECT date, count(*) AS n_lines,
         CAST(sum(quantity) AS DECIMAL(38,4)) AS quantity,
         CAST(sum(revenue) AS DECIMAL(38,4)) AS revenue,
         CAST(sum(profit) AS DECIMAL(38,4)) AS profit
  FROM sales GROUP BY date
)
"""

QUERIES: dict[str, str] = {}


def q(name: str, sql: str) -> None:
    QUERIES[name] = VIEWS + sql


def _holiday(pattern: str = "") -> str:
    """Holidays next to the finished day totals; days without a sale keep NULL sums."""
    keep = f"WHERE contains(lower(name), '{pattern}')" if pattern else ""
    return f"""
, wanted AS (SELECT name, date, is_public FROM holidays {keep})
SELECT wanted.name AS holiday, wanted.date, wanted.is_public, coalesce(daily.n_lines, 0) AS num_transactions,
       daily.quantity AS total_quantity, daily.revenue AS total_revenue, daily.profit AS total_profit
FROM wanted LEFT JOIN daily USING (date)
"""


q("holiday_sales_summary", _holiday())
q("holiday_sales_filtered", _holiday("diwali"))

q("daily_sales", """
SELECT date, n_lines AS num_transactions, quantity AS total_quantity,
       revenue AS total_revenue, profit AS total_profit
FROM daily ORDER BY date
""")

q("monthly_sales", """
SELECT strftime(date, '%Y-%m') AS month,
       CAST(sum(revenue) AS DECIMAL(38,4)) AS total_revenue,
       count(*) AS num_transactions
FROM sales GROUP BY 1 ORDER BY 1
""")

q("stock_sales_daily", """
SELECT s.date, CAST(sum(s.revenue) AS DECIMAL(38,4)) AS total_revenue,
       max(sp.close) AS stock_close, max(sp.volume) AS stock_volume
FROM sales s LEFT JOIN stock_prices sp ON s.date = sp.date AND sp.ticker = 'NVDA'
GROUP BY s.date ORDER BY s.date
""")

q("stock_sales_corr", """
SELECT 'NVDA' AS ticker, count(*) AS n_pairs,
       round(corr(CAST(d.revenue AS DOUBLE), sp.close), 6) AS pearson_r
FROM daily d JOIN stock_prices sp ON d.date = sp.date AND sp.ticker = 'NVDA'
""")

_IMPACT = """
, chosen AS (SELECT min(commodity_code) AS code FROM commodity_prices WHERE contains(lower(commodity_name), 'copper'))
, price AS (
  SELECT date, CAST(price_usd AS DOUBLE) AS usd, price_yoy_pct
  FROM commodity_prices JOIN chosen ON commodity_code = code
)
, earned AS (
  SELECT CAST(date_trunc('month', date) AS DATE) AS m, CAST(sum(revenue) AS DECIMAL(38,4)) AS revenue
  FROM sales WHERE product_id IN (SELECT id FROM products WHERE category = 'end_product')
  GROUP BY m
)
"""

q("commodity_impact", _IMPACT + """
SELECT strftime(m, '%Y-%m') AS month, 'end_product' AS category, revenue AS total_revenue,
       round(usd, 4) AS avg_commodity_price, round(price_yoy_pct, 4) AS commodity_yoy_pct
FROM earned LEFT JOIN price ON price.date = m
""")

# Day totals and macro values meet as two month tables: every macro day has
# sales, so neither side loses rows to the other.
_TREND = """
, earned AS (SELECT strftime(date, '%Y-%m') AS month, CAST(sum(revenue) AS DECIMAL(38,4)) AS revenue FROM daily GROUP BY month)
, rates AS (
  SELECT strftime(date, '%Y-%m') AS month, CAST(sum(usd_inr) AS DOUBLE) / count(usd_inr) AS fx,
         CAST(sum(inflation_india) AS DOUBLE) / count(inflation_india) AS inflation,
         CAST(sum(interest_india) AS DOUBLE) / count(interest_india) AS interest
  FROM macro_indicators WHERE date IN (SELECT date FROM daily) GROUP BY month
)
"""

q("macro_sales_trend", _TREND + """
SELECT month, revenue AS total_revenue, round(fx, 4) AS avg_usd_inr, round(inflation, 4) AS inflation, round(interest, 4) AS interest_rate
FROM earned LEFT JOIN rates USING (month)
""")


# ---------------------------------------------------------------------------
# Smart query: one statement per registered case. Filters come first, as
# tables of their own; lookups meet the remaining lines after that.
# ---------------------------------------------------------------------------
SMART_CASES = {
    "smart_base": {},
    "smart_holiday": {"holiday": "Diwali"},
    "smart_stock": {"category": "end_product", "ticker": "nvda", "year": 1998},
    "smart_commodity": {"commodity": "al"},
    "smart_macro": {"date_start": "1997-01-01", "date_end": "1998-12-31", "include_macro": True},
    "smart_state": {"state": "NATION_3"},
    "smart_all": {"state": "NATION_7", "holiday": "new year", "ticker": "SAMSUNG",
                  "commodity": "copper", "category": "end_product", "year": 1999,
                  "date_start": "1999-01-01", "date_end": "1999-06-30", "include_macro": True},
}

_LINE = """lines.date, goods.name AS product, goods.category AS product_category, lines.quantity,
       lines.unit_price, lines.revenue, lines.profit, lines.source"""

q("smart_base", f"""
SELECT {_LINE} FROM sales AS lines, products AS goods WHERE goods.id = lines.product_id
""")

q("smart_holiday", f"""
, feast AS (SELECT date, name AS holiday_name, is_public FROM holidays WHERE contains(lower(name), 'diwali'))
, lines AS (SELECT * FROM sales WHERE date IN (SELECT date FROM feast))
SELECT {_LINE}, feast.holiday_name, feast.is_public
FROM feast, lines, products AS goods WHERE lines.date = feast.date AND goods.id = lines.product_id
""")

q("smart_stock", f"""
, goods AS (SELECT * FROM products WHERE category = 'end_product')
, lines AS (SELECT * FROM sales WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31')
, quote AS (SELECT date, close, volume FROM stock_prices WHERE ticker = 'NVDA')
SELECT {_LINE}, quote.close AS stock_close, quote.volume AS stock_volume
FROM goods JOIN lines ON goods.id = lines.product_id LEFT JOIN quote USING (date)
""")

q("smart_commodity", f"""
, price AS (SELECT * FROM commodity_prices WHERE contains(lower(commodity_name), 'al'))
, lines AS (SELECT *, CAST(date_trunc('month', date) AS DATE) AS m FROM sales)
SELECT {_LINE}, price.commodity_name, price.price_usd AS commodity_price_usd, price.price_yoy_pct AS commodity_yoy_change
FROM products AS goods JOIN lines ON goods.id = lines.product_id LEFT JOIN price ON price.date = lines.m
""")

q("smart_macro", f"""
, lines AS (SELECT * FROM sales WHERE year(date) IN (1997, 1998))
SELECT {_LINE}, macro.usd_inr, macro.inflation_india, macro.interest_india
FROM products AS goods JOIN lines ON goods.id = lines.product_id LEFT JOIN macro_indicators AS macro USING (date)
""")

q("smart_state", f"""
, home AS (SELECT id, state FROM regions WHERE state = 'NATION_3')
, lines AS (SELECT * FROM sales WHERE region_id IN (SELECT id FROM home))
SELECT {_LINE}, home.state FROM home, lines, products AS goods WHERE goods.id = lines.product_id
""")

q("smart_all", f"""
, home AS (SELECT id, state FROM regions WHERE state = 'NATION_7')
, feast AS (SELECT date, name AS holiday_name, is_public FROM holidays
            WHERE contains(lower(name), 'new year') AND date BETWEEN DATE '1999-01-01' AND DATE '1999-06-30')
, goods AS (SELECT * FROM products WHERE category = 'end_product')
, lines AS (SELECT *, CAST(date_trunc('month', date) AS DATE) AS m FROM sales
            WHERE region_id IN (SELECT id FROM home) AND date IN (SELECT date FROM feast))
, quote AS (SELECT date, close, volume FROM stock_prices WHERE ticker = 'SAMSUNG')
, price AS (SELECT * FROM commodity_prices WHERE contains(lower(commodity_name), 'copper'))
SELECT {_LINE}, home.state, feast.holiday_name, feast.is_public, quote.close AS stock_close, quote.volume AS stock_volume,
       price.commodity_name, price.price_usd AS commodity_price_usd, price.price_yoy_pct AS commodity_yoy_change,
       macro.usd_inr, macro.inflation_india, macro.interest_india
FROM home CROSS JOIN feast JOIN lines ON lines.date = feast.date JOIN goods ON goods.id = lines.product_id
LEFT JOIN quote ON quote.date = lines.date LEFT JOIN price ON price.date = lines.m
LEFT JOIN macro_indicators AS macro ON macro.date = lines.date
""")


# ---------------------------------------------------------------------------
# Time series
# ---------------------------------------------------------------------------
q("calendar_features", """
SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS date,
       CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
       CAST(weekofyear(o_orderdate) AS INTEGER) AS week,
       CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week,
       CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
       strftime(o_orderdate, '%Y-%m') AS month_key,
       CASE WHEN h.date IS NULL THEN 0 ELSE 1 END AS is_holiday
FROM orders LEFT JOIN (SELECT DISTINCT date FROM holidays) h ON CAST(o_orderdate AS DATE) = h.date
""")

_LAG_ROLL = """
       lag(sales, 7) OVER w AS sales_lag_7,
       lag(sales, 30) OVER w AS sales_lag_30,
       CASE WHEN count(sales) OVER w7 = 7
            THEN round(CAST(sum(sales) OVER w7 AS DOUBLE) / 7.0, 4) END AS sales_rolling_7_mean
"""

q("lag_rolling_features", f"""
SELECT date, sales, {_LAG_ROLL}
FROM (SELECT date, revenue AS sales FROM daily)
WINDOW w AS (ORDER BY date), w7 AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
""")

q("lag_rolling_by_region", f"""
SELECT region, date, sales, {_LAG_ROLL}
FROM (SELECT r.region, s.date, CAST(sum(s.revenue) AS DECIMAL(38,4)) AS sales
      FROM sales s LEFT JOIN regions r ON s.region_id = r.id GROUP BY 1, 2)
WINDOW w AS (PARTITION BY region ORDER BY date),
       w7 AS (PARTITION BY region ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
""")

q("ffill_stock_daily", """
SELECT d.date, d.revenue AS total_revenue,
       last_value(n.close IGNORE NULLS) OVER w AS nvidia_close,
       last_value(sm.close IGNORE NULLS) OVER w AS samsung_close
FROM daily d
LEFT JOIN stock_prices n ON d.date = n.date AND n.ticker = 'NVDA'
LEFT JOIN stock_prices sm ON d.date = sm.date AND sm.ticker = 'SAMSUNG'
WINDOW w AS (ORDER BY d.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")

_CAL = """
, cal AS (
  SELECT CAST(unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS DATE) AS date
  FROM orders
)
"""
# the same up to the horizon
_CAL_LONG = _CAL.replace("max(CAST(o_orderdate AS DATE))", "max(CAST(o_orderdate AS DATE)) + 365")

_COMMODITY_COLS = [("Aluminum", "price_aluminum"), ("Copper", "price_copper"), ("Nickel", "price_nickel"),
                   ("Crude oil, Brent", "price_crude_oil"), ("Natural gas, US", "price_natural_gas")]


def _pivot_mean(alias=""):
    return ",\n".join(
        f"round(CAST(sum(CASE WHEN commodity_name = '{n}' THEN price_usd END) AS DOUBLE) / "
        f"count(CASE WHEN commodity_name = '{n}' THEN price_usd END), 4) AS {c}"
        for n, c in _COMMODITY_COLS)


_CWIDE = f"""
, cwide AS (
  SELECT date, {_pivot_mean()}
  FROM commodity_prices
  WHERE commodity_name IN ({", ".join("'" + n + "'" for n, _ in _COMMODITY_COLS)})
  GROUP BY date
)
"""

q("gapfill_commodity_daily", _CAL + _CWIDE + f"""
SELECT cal.date, {", ".join(f"last_value(cw.{c} IGNORE NULLS) OVER w AS {c}" for _, c in _COMMODITY_COLS)}
FROM cal LEFT JOIN cwide cw ON cal.date = cw.date
WINDOW w AS (ORDER BY cal.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")

q("commodity_pivot", _CWIDE + """
SELECT * FROM cwide
""")

q("annual_to_daily", _CAL + """
SELECT cal.date, CAST(year(cal.date) AS INTEGER) AS year, a.value AS inflation_india
FROM cal LEFT JOIN annual_inflation a ON year(cal.date) = a.year
""")

q("annual_extend", """
, ext AS (
  SELECT CAST(unnest(generate_series((SELECT max(year) FROM annual_interest) + 1,
                                     (SELECT year FROM horizon))) AS INTEGER) AS year
)
SELECT year, last_value(value IGNORE NULLS) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS interest_rate,
       is_extended
FROM (SELECT year, value, 0 AS is_extended FROM annual_interest
      UNION ALL SELECT year, NULL, 1 FROM ext)
""")

q("linear_extrapolate", """
, fit AS (
  SELECT regr_slope(CAST(value AS DOUBLE), year - 2000.0) AS slope,
         regr_intercept(CAST(value AS DOUBLE), year - 2000.0) AS intercept
  FROM annual_inflation WHERE value IS NOT NULL
), ext AS (
  SELECT CAST(unnest(generate_series((SELECT max(year) FROM annual_inflation) + 1,
                                     (SELECT year FROM horizon))) AS INTEGER) AS year
)
SELECT year, round(CAST(value AS DOUBLE), 2) AS value, 0 AS is_extrapolated FROM annual_inflation
UNION ALL
SELECT ext.year, round(fit.slope * (ext.year - 2000.0) + fit.intercept, 2), 1 FROM ext, fit
""")


q("unpivot_years", """
SELECT 'India' AS country, year, inflation AS inflation_india, interest AS interest_india FROM annual
""")


# ---------------------------------------------------------------------------
# Shaped outputs
# ---------------------------------------------------------------------------
_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

q("region_month_pivot", f"""
SELECT r.region, {", ".join(f"CAST(sum(CASE WHEN month(s.date) = {i + 1} THEN s.revenue END) AS DECIMAL(38,4)) AS {m}" for i, m in enumerate(_MONTHS))}
FROM sales s LEFT JOIN regions r ON s.region_id = r.id
GROUP BY r.region ORDER BY r.region
""")

_BOX = """
, vals AS (SELECT p.category, s.date, s.order_id, s.product_id, s.revenue, CAST(s.revenue AS DOUBLE) AS v
           FROM sales s JOIN products p ON s.product_id = p.id)
, qs AS (SELECT category, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med,
                quantile_cont(v, 0.75) AS q3
         FROM vals GROUP BY category)
, fences AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM qs)
"""

q("category_distribution", _BOX + """
SELECT f.category, f.n, round(f.q1, 4) AS q1, round(f.med, 4) AS median, round(f.q3, 4) AS q3,
       round(f.iqr, 4) AS iqr, round(f.lf, 4) AS lower_fence, round(f.uf, 4) AS upper_fence,
       round(min(CASE WHEN v >= f.lf THEN v END), 4) AS whisker_low,
       round(max(CASE WHEN v <= f.uf THEN v END), 4) AS whisker_high,
       CAST(count_if(v < f.lf OR v > f.uf) AS BIGINT) AS n_outliers
FROM fences f JOIN vals USING (category)
GROUP BY f.category, f.n, f.q1, f.med, f.q3, f.iqr, f.lf, f.uf
""")

q("category_outliers", """
, earned AS (SELECT p.category, s.date, s.order_id, s.product_id, s.profit, CAST(s.profit AS DOUBLE) AS v
             FROM sales s JOIN products p ON s.product_id = p.id WHERE s.profit IS NOT NULL)
, spread AS (SELECT category, quantile_cont(v, 0.25) AS low, quantile_cont(v, 0.75) AS high FROM earned GROUP BY category)
SELECT category, date, order_id, product_id, profit
FROM earned JOIN spread USING (category)
WHERE v < low - 1.5 * (high - low) OR v > high + 1.5 * (high - low)
""")

q("latest_100", """
SELECT s.date, s.order_id, s.product_id, s.quantity, s.revenue, s.profit,
       mi.usd_inr, mi.inflation_india, mi.interest_india
FROM sales s LEFT JOIN macro_indicators mi ON s.date = mi.date
ORDER BY s.date DESC, s.order_id DESC, s.product_id DESC, s.quantity DESC, s.revenue DESC,
         s.profit DESC NULLS LAST
LIMIT 100
""")

q("first_15", """
SELECT date, n_lines AS num_transactions, quantity AS total_quantity,
       revenue AS total_revenue, profit AS total_profit
FROM daily ORDER BY date LIMIT 15
""")

q("latest_per_ticker", """
SELECT ticker, max(date) AS date, arg_max(close, date) AS close, arg_max(volume, date) AS volume
FROM stock_prices GROUP BY ticker ORDER BY ticker
""")

q("null_to_zero_rounded", """
SELECT d.date, CAST(round(d.revenue, 2) AS DECIMAL(38,2)) AS total_revenue,
       CAST(round(CAST(coalesce(sp.close, 0) AS DECIMAL(18,4)), 2) AS DECIMAL(38,2)) AS stock_close,
       CAST(coalesce(sp.volume, 0) AS DECIMAL(38,4)) AS stock_volume
FROM daily d LEFT JOIN stock_prices sp ON d.date = sp.date AND sp.ticker = 'NVDA'
""")


# ---------------------------------------------------------------------------
# Ingestion / cleaning
# ---------------------------------------------------------------------------
_RAW_UPDATED = """
, lop AS (
  SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)
, raw_updated AS (
  SELECT
    CASE WHEN o_orderpriority = '5-LOW' AND l_returnflag = 'R' THEN 'Order Date'
         WHEN o_orderpriority = '2-HIGH' THEN strftime(o_orderdate, '%m/%d/%Y %H:%M')
         WHEN o_orderpriority = '3-MEDIUM' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '+05:30'
         WHEN o_orderpriority = '4-NOT SPECIFIED' AND l_returnflag = 'N' THEN NULL
         WHEN o_orderpriority = '4-NOT SPECIFIED' AND l_returnflag = 'A' THEN 'not a date'
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
    CASE WHEN o_orderpriority = '5-LOW' AND l_returnflag = 'R' THEN 'Product' ELSE p_name END AS product,
    CASE WHEN o_orderpriority = '5-LOW' AND l_returnflag = 'R' THEN 'Quantity Ordered'
         WHEN o_orderpriority = '1-URGENT' AND l_returnflag = 'R' THEN 'abc'
         ELSE CAST(l_quantity AS VARCHAR) END AS quantity_ordered,
    CASE WHEN o_orderpriority = '5-LOW' AND l_returnflag = 'R' THEN 'Price Each'
         WHEN o_orderpriority = '1-URGENT' AND l_returnflag = 'N' THEN ''
         ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) END AS price_each
  FROM lop WHERE l_linestatus = 'F'
)
, parsed AS (
  SELECT coalesce(CAST(try_strptime(order_date, '%Y-%m-%d') AS DATE),
                  CAST(try_strptime(order_date, '%m/%d/%Y %H:%M') AS DATE),
                  CAST(timezone('UTC', try_strptime(order_date, '%Y-%m-%d %H:%M:%S%z')) AS DATE)) AS date,
         product,
         TRY_CAST(quantity_ordered AS DECIMAL(18,4)) AS quantity,
         TRY_CAST(price_each AS DECIMAL(18,4)) AS unit_price,
         CAST(TRY_CAST(quantity_ordered AS DECIMAL(18,4)) * TRY_CAST(price_each AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS revenue
  FROM raw_updated
  WHERE order_date IS NULL OR order_date <> 'Order Date'
)
"""

q("sales_clean", _RAW_UPDATED + """
SELECT date, product, 'end_product' AS category, quantity, unit_price, revenue,
       CAST(NULL AS DECIMAL(18,4)) AS profit, CAST(NULL AS BIGINT) AS region_id, 'updated_sales' AS source
FROM parsed WHERE date IS NOT NULL
""")

q("null_profile", _RAW_UPDATED + """
, counts AS (
  SELECT count(*) AS total_rows,
         CAST(count_if(date IS NULL) AS BIGINT) AS date, CAST(count_if(product IS NULL) AS BIGINT) AS product,
         CAST(count_if(quantity IS NULL) AS BIGINT) AS quantity,
         CAST(count_if(unit_price IS NULL) AS BIGINT) AS unit_price,
         CAST(count_if(revenue IS NULL) AS BIGINT) AS revenue
  FROM parsed
)
SELECT column_name, (SELECT replace(lower(CASE column_name WHEN 'date' THEN typeof(date) WHEN 'product' THEN typeof(product) WHEN 'quantity' THEN typeof(quantity)
                             WHEN 'unit_price' THEN typeof(unit_price) ELSE typeof(revenue) END), 'varchar', 'string') FROM parsed LIMIT 1) AS data_type,
       null_count, total_rows, total_rows - null_count AS non_null_count
FROM counts UNPIVOT (null_count FOR column_name IN (date, product, quantity, unit_price, revenue))
""")

q("product_catalog", _RAW_UPDATED + """
, ec AS (
  SELECT DISTINCT p_name AS name,
         CASE p_type WHEN 'ECONOMY' THEN 'Electronics' WHEN 'STANDARD' THEN 'ELECTRONICS'
                     WHEN 'SMALL' THEN 'accessories' WHEN 'MEDIUM' THEN 'Office'
                     WHEN 'LARGE' THEN 'Furniture' WHEN 'PROMO' THEN 'Toys' END AS raw_category
  FROM lop WHERE l_linestatus = 'O'
)
, allp AS (
  SELECT name, coalesce(CASE lower(trim(raw_category)) WHEN 'electronics' THEN 'end_product'
                             WHEN 'accessories' THEN 'component' WHEN 'office' THEN 'end_product' END,
                        'end_product') AS category, 0 AS src FROM ec
  UNION ALL
  SELECT DISTINCT product AS name, 'end_product' AS category, 1 AS src FROM parsed WHERE date IS NOT NULL
)
, firsts AS (
  SELECT name, category FROM (
    SELECT *, row_number() OVER (PARTITION BY name ORDER BY src, category) AS rn FROM allp WHERE name IS NOT NULL)
  WHERE rn = 1
)
, ids AS (SELECT row_number() OVER (ORDER BY name) AS id, name, category FROM firsts)
, per_name AS (SELECT p_name AS name, count(*) AS n_lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT ids.id, ids.name, ids.category, coalesce(per_name.n_lines, 0) AS n_lines
FROM ids LEFT JOIN per_name USING (name)
""")

QUERIES["nation_orders"] = """
WITH wanted AS (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000),
home AS (SELECT c_custkey, n_name FROM customer, nation WHERE c_nationkey = n_nationkey)
SELECT n_name AS state, CAST(extract(year FROM o_orderdate) AS INTEGER) AS year, count(*) AS n_orders,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DECIMAL(38,4)) AS total
FROM wanted, home WHERE o_custkey = c_custkey GROUP BY ALL
"""

q("sales_loaded", _RAW_UPDATED + """
, names AS (
  SELECT p_name AS name FROM lop WHERE l_linestatus = 'O' AND p_type IN ('ECONOMY', 'STANDARD', 'SMALL', 'MEDIUM', 'LARGE', 'PROMO')
  UNION SELECT product FROM parsed WHERE date IS NOT NULL AND product IS NOT NULL
)
, numbered AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM names)
, both_files AS (
  SELECT CAST(o_orderdate AS DATE) AS date, p_name AS name, CAST(l_quantity AS DECIMAL(18,4)) AS quantity,
         CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(18,4))) AS DECIMAL(18,4)) AS revenue,
         CASE WHEN l_returnflag <> 'R' THEN CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(l_tax AS DECIMAL(18,4)) AS DECIMAL(18,4)) END AS profit,
         l_quantity AS q, NULL AS listed, 'ecommerce' AS source
  FROM lop WHERE l_linestatus = 'O'
  UNION ALL
  SELECT date, product, quantity, revenue, NULL, NULL, unit_price, 'updated_sales' FROM parsed WHERE date IS NOT NULL
)
SELECT date, id AS product_id, quantity,
       CASE source WHEN 'ecommerce' THEN CAST(revenue AS DOUBLE) / nullif(q, 0) ELSE CAST(listed AS DOUBLE) END AS unit_price,
       revenue, profit, source
FROM both_files LEFT JOIN numbered USING (name)
""")

q("commodity_tagging", """
, tagged AS (
  SELECT *, CASE WHEN commodity_name IN ('Aluminum', 'Copper', 'Nickel', 'Tin', 'Silver', 'Gold', 'Platinum', 'Lithium')
                 THEN 'electronics_raw_material'
                 WHEN commodity_name IN ('Crude oil, Brent', 'Crude oil, WTI', 'Natural gas, US', 'Coal, Australian')
                 THEN 'energy_cost' ELSE 'other' END AS relevant_for
  FROM commodity_prices
)
SELECT relevant_for, count(*) AS n_rows, count(DISTINCT commodity_name) AS n_commodities,
       min(date) AS first_date, max(date) AS last_date
FROM tagged GROUP BY relevant_for
""")

# ---------------------------------------------------------------------------
# Data quality
# ---------------------------------------------------------------------------
q("duplicate_keys", """
SELECT l_orderkey AS order_id, l_linenumber AS line_number, count(*) AS n_copies
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
""")

q("orphan_keys", """
SELECT 'lineitem.l_partkey -> part' AS "check",
       (SELECT count(*) FROM lineitem WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey IS NOT NULL)) AS n_violations
UNION ALL SELECT 'lineitem.l_orderkey -> orders',
       (SELECT count(*) FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL))
UNION ALL SELECT 'orders.o_custkey -> customer',
       (SELECT count(*) FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL))
UNION ALL SELECT 'customer.c_nationkey -> nation',
       (SELECT count(*) FROM customer WHERE c_nationkey IS NOT NULL AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey IS NOT NULL))
UNION ALL SELECT 'sales not null (date, product_id, revenue)',
       (SELECT count(*) FROM sales WHERE date IS NULL OR product_id IS NULL OR revenue IS NULL)
UNION ALL SELECT 'lineitem unique (order, line)',
       (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1))
UNION ALL SELECT 'part unique (name)', (SELECT count(*) FROM (SELECT p_name FROM part GROUP BY ALL HAVING count(*) > 1))
UNION ALL SELECT 'events.user_id -> customer',
       (SELECT count(*) FROM events WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id))
""")

_REQUESTS = """
, req_raw AS (
  SELECT o_orderkey AS request_id, '' AS state,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'North' WHEN 'BUILDING' THEN 'East'
              WHEN 'FURNITURE' THEN 'South' WHEN 'MACHINERY' THEN 'West' ELSE 'Central' END AS region,
         CASE month(o_orderdate) WHEN 11 THEN 'Diwali' WHEN 1 THEN 'new year' WHEN 12 THEN 'Christmas' ELSE '' END AS holiday,
         CASE WHEN o_orderstatus = 'F' THEN 'nvda' WHEN o_orderstatus = 'O' THEN 'SAMSUNG'
              WHEN o_orderpriority = '5-LOW' THEN 'xyz' ELSE 'sony' END AS ticker,
         CASE o_orderstatus WHEN 'O' THEN 'copper' WHEN 'P' THEN 'oil' ELSE '' END AS commodity,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Electronics' WHEN '2-HIGH' THEN 'Accessories'
              WHEN '3-MEDIUM' THEN 'Office' WHEN '4-NOT SPECIFIED' THEN '' ELSE 'Toys' END AS category,
         CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL
              ELSE CAST(year(o_orderdate) + CASE WHEN o_orderpriority = '5-LOW' OR o_orderstatus = 'P' THEN 1 ELSE 0 END AS INTEGER) END AS year,
         CASE WHEN o_orderpriority = '2-HIGH' THEN ''
              WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'not-a-date'
              WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN strftime(CAST(o_orderdate AS DATE) + INTERVAL 400 DAY, '%-d %b %Y')
              WHEN o_orderstatus = 'O' THEN strftime(CAST(o_orderdate AS DATE) + INTERVAL 90 DAY, '%m/%d/%Y')
              WHEN o_orderstatus = 'P' THEN strftime(CAST(o_orderdate AS DATE) + INTERVAL 90 DAY, '%-d %b %Y')
              ELSE strftime(CAST(o_orderdate AS DATE) + INTERVAL 90 DAY, '%Y-%m-%d') END AS date
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
)
, req_clean AS (
  SELECT request_id, nullif(trim(region), '') AS region, nullif(trim(holiday), '') AS holiday,
         upper(nullif(trim(ticker), '')) AS ticker, nullif(trim(commodity), '') AS commodity,
         nullif(trim(category), '') AS category, year, nullif(trim(date), '') AS date,
         CAST(try_strptime(nullif(trim(date), ''), ['%Y-%m-%d', '%m/%d/%Y', '%d %b %Y']) AS DATE) AS req_date
  FROM req_raw
)
, req_checked AS (
  SELECT *, concat_ws(';',
           CASE WHEN category IS NOT NULL AND category NOT IN ('Electronics', 'Accessories', 'Office') THEN 'category' END,
           CASE WHEN region IS NOT NULL AND region NOT IN ('North', 'East', 'South', 'West') THEN 'region' END,
           CASE WHEN ticker IS NOT NULL AND ticker NOT IN ('NVDA', 'SAMSUNG', 'SONY') THEN 'ticker' END,
           CASE WHEN date IS NOT NULL AND req_date IS NULL THEN 'date_format' END,
           CASE WHEN req_date IS NOT NULL AND req_date > (SELECT CAST(max(o_orderdate) AS DATE) + 90 FROM orders) THEN 'date_range' END,
           CASE WHEN year IS NOT NULL AND (year < (SELECT year(min(o_orderdate)) FROM orders) OR year > (SELECT year FROM horizon)) THEN 'year' END) AS err
  FROM req_clean
)
"""

q("request_validation", _REQUESTS + """
SELECT request_id, CASE WHEN err = '' THEN 1 ELSE 0 END AS is_valid,
       CAST(CASE WHEN err = '' THEN 0 ELSE length(err) - length(replace(err, ';', '')) + 1 END AS INTEGER) AS n_errors,
       nullif(err, '') AS errors
FROM req_checked
""")

_CONTEXT = """
, vreq AS (
  SELECT *, CASE lower(category) WHEN 'electronics' THEN 'end_product' WHEN 'accessories' THEN 'component'
                 WHEN 'office' THEN 'end_product' END AS cat_stored
  FROM req_checked WHERE err = ''
)
, rows_ AS (
  SELECT s.date, s.order_id, s.product_id, s.quantity, s.revenue, p.category, CAST(year(s.date) AS INTEGER) AS yr
  FROM sales s JOIN products p ON s.product_id = p.id
)
, keys AS (SELECT DISTINCT holiday, ticker, commodity, cat_stored, year FROM vreq)
, kr AS (
  SELECT k.*, r.* FROM keys k JOIN rows_ r ON r.category = k.cat_stored AND r.yr = k.year
  UNION ALL
  SELECT k.*, r.* FROM keys k JOIN rows_ r ON r.category = k.cat_stored WHERE k.year IS NULL
  UNION ALL
  SELECT k.*, r.* FROM keys k JOIN rows_ r ON r.yr = k.year WHERE k.cat_stored IS NULL
  UNION ALL
  SELECT k.*, r.* FROM keys k CROSS JOIN rows_ r WHERE k.cat_stored IS NULL AND k.year IS NULL
)
, l1rows AS (
  SELECT kr.* FROM kr
  LEFT JOIN holidays h ON kr.holiday IS NOT NULL AND h.date = kr.date AND h.name ILIKE '%' || kr.holiday || '%'
  LEFT JOIN commodity_prices c ON kr.commodity IS NOT NULL AND c.date = CAST(date_trunc('month', kr.date) AS DATE)
                               AND c.commodity_name ILIKE '%' || kr.commodity || '%'
  WHERE kr.holiday IS NULL OR h.name IS NOT NULL
)
, l1 AS (
  SELECT holiday, ticker, commodity, cat_stored, year, count(*) AS n1,
         max(date) AS d1
  FROM l1rows GROUP BY ALL
)
, l1last AS (
  SELECT holiday, ticker, commodity, cat_stored, year, revenue AS rev1 FROM (
    SELECT *, row_number() OVER (PARTITION BY holiday, ticker, commodity, cat_stored, year
                                 ORDER BY date DESC, order_id DESC, product_id DESC, quantity DESC, revenue DESC) AS rn
    FROM l1rows) WHERE rn = 1
)
, l2 AS (
  SELECT category, yr, count(*) AS n2, max(date) AS d2 FROM rows_ GROUP BY ALL
)
, l2last AS (
  SELECT category, yr, revenue AS rev2 FROM (
    SELECT *, row_number() OVER (PARTITION BY category, yr ORDER BY date DESC, order_id DESC, product_id DESC,
                                 quantity DESC, revenue DESC) AS rn FROM rows_) WHERE rn = 1
)
, l3 AS (
  SELECT category, count(*) AS n3, max(date) AS d3 FROM rows_ GROUP BY ALL
)
, l3last AS (
  SELECT category, revenue AS rev3 FROM (
    SELECT *, row_number() OVER (PARTITION BY category ORDER BY date DESC, order_id DESC, product_id DESC,
                                 quantity DESC, revenue DESC) AS rn FROM rows_) WHERE rn = 1
)
, l2any AS (SELECT yr, count(*) AS n2, max(date) AS d2 FROM rows_ GROUP BY ALL)
, l2anylast AS (
  SELECT yr, revenue AS rev2 FROM (
    SELECT *, row_number() OVER (PARTITION BY yr ORDER BY date DESC, order_id DESC, product_id DESC,
                                 quantity DESC, revenue DESC) AS rn FROM rows_) WHERE rn = 1
)
, l4 AS (
  SELECT least(count(*), 100) AS n4, max(date) AS d4 FROM rows_
)
, l4last AS (
  SELECT revenue AS rev4 FROM rows_ ORDER BY date DESC, order_id DESC, product_id DESC, quantity DESC, revenue DESC LIMIT 1
)
, joined AS (
  SELECT v.request_id, v.cat_stored, v.req_date, v.ticker,
         l1.n1, l1.d1, l1last.rev1,
         CASE WHEN v.cat_stored IS NULL AND v.year IS NULL THEN (SELECT count(*) FROM rows_)
              WHEN v.cat_stored IS NULL THEN l2any.n2
              WHEN v.year IS NULL THEN l3.n3 ELSE l2.n2 END AS n2,
         CASE WHEN v.cat_stored IS NULL AND v.year IS NULL THEN (SELECT d4 FROM l4)
              WHEN v.cat_stored IS NULL THEN l2any.d2
              WHEN v.year IS NULL THEN l3.d3 ELSE l2.d2 END AS d2,
         CASE WHEN v.cat_stored IS NULL AND v.year IS NULL THEN (SELECT rev4 FROM l4last)
              WHEN v.cat_stored IS NULL THEN l2anylast.rev2
              WHEN v.year IS NULL THEN l3last.rev3 ELSE l2last.rev2 END AS rev2,
         l3.n3, l3.d3, l3last.rev3,
         (SELECT n4 FROM l4) AS n4, (SELECT d4 FROM l4) AS d4, (SELECT rev4 FROM l4last) AS rev4
  FROM vreq v
  LEFT JOIN l1 ON l1.holiday IS NOT DISTINCT FROM v.holiday AND l1.ticker IS NOT DISTINCT FROM v.ticker
              AND l1.commodity IS NOT DISTINCT FROM v.commodity AND l1.cat_stored IS NOT DISTINCT FROM v.cat_stored
              AND l1.year IS NOT DISTINCT FROM v.year
  LEFT JOIN l1last ON l1last.holiday IS NOT DISTINCT FROM v.holiday AND l1last.ticker IS NOT DISTINCT FROM v.ticker
              AND l1last.commodity IS NOT DISTINCT FROM v.commodity AND l1last.cat_stored IS NOT DISTINCT FROM v.cat_stored
              AND l1last.year IS NOT DISTINCT FROM v.year
  LEFT JOIN l2 ON l2.category = v.cat_stored AND l2.yr = v.year
  LEFT JOIN l2last ON l2last.category = v.cat_stored AND l2last.yr = v.year
  LEFT JOIN l2any ON v.cat_stored IS NULL AND l2any.yr = v.year
  LEFT JOIN l2anylast ON v.cat_stored IS NULL AND l2anylast.yr = v.year
  LEFT JOIN l3 ON l3.category = v.cat_stored
  LEFT JOIN l3last ON l3last.category = v.cat_stored
)
, pick AS (
  SELECT request_id, req_date, ticker,
         CASE WHEN coalesce(n1, 0) > 0 THEN 1 WHEN coalesce(n2, 0) > 0 THEN 2
              WHEN cat_stored IS NOT NULL AND coalesce(n3, 0) > 0 THEN 3 ELSE 4 END AS level_used,
         n1, d1, rev1, n2, d2, rev2, n3, d3, rev3, n4, d4, rev4
  FROM joined
)
, ctx AS (
SELECT p.request_id, p.level_used,
       CAST(CASE level_used WHEN 1 THEN n1 WHEN 2 THEN n2 WHEN 3 THEN n3 ELSE n4 END AS BIGINT) AS sample_size,
       CASE level_used WHEN 1 THEN d1 WHEN 2 THEN d2 WHEN 3 THEN d3 ELSE d4 END AS context_date,
       CASE level_used WHEN 1 THEN rev1 WHEN 2 THEN rev2 WHEN 3 THEN rev3 ELSE rev4 END AS context_revenue,
       CASE WHEN level_used = 1 THEN sp.close END AS stock_close,
       coalesce(p.req_date, CASE level_used WHEN 1 THEN d1 WHEN 2 THEN d2 WHEN 3 THEN d3 ELSE d4 END) AS basis_date
FROM pick p LEFT JOIN stock_prices sp ON p.level_used = 1 AND sp.date = p.d1 AND sp.ticker = p.ticker
)
"""

q("context_fallback", _REQUESTS + _CONTEXT + "SELECT * FROM ctx")


# ---------------------------------------------------------------------------
# Feature table (M1), one-hots (G5), ordered split
# ---------------------------------------------------------------------------
_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_CATS = ["component", "end_product", "raw_material"]


def _lvl(v):
    return "".join(ch if ch.isalnum() else "_" for ch in v)


_ONE_HOTS = ",\n".join(
    [f"CASE WHEN p.category = '{c}' THEN 1 ELSE 0 END AS Category_{_lvl(c)}" for c in _CATS]
    + [f"CASE WHEN r.region = '{g}' THEN 1 ELSE 0 END AS Region_{_lvl(g)}" for g in _REGIONS])

q("one_hot", f"""
SELECT s.order_id, s.product_id, s.revenue, {_ONE_HOTS}
FROM sales s LEFT JOIN products p ON s.product_id = p.id LEFT JOIN regions r ON s.region_id = r.id
""")

q("train_test_split", """
, ranked AS (
  SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS date,
         row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_rank, count(*) OVER () AS n
  FROM orders
)
SELECT order_id, date, row_rank, CASE WHEN row_rank > n - CAST(ceil(0.2 * n) AS BIGINT) THEN 1 ELSE 0 END AS is_test
FROM ranked
""")

_FEATURES = ["month", "week", "day_of_week", "quarter", "is_holiday", "sales_lag_7", "sales_lag_30",
             "sales_rolling_7_mean", "nvidia_close", "samsung_close", "inflation_india", "interest_rate",
             "lithium_price_usd", "price_aluminum", "price_copper", "price_crude_oil"]

_DAYS = _CWIDE + """
, lr AS (
  SELECT date, CAST(lag(revenue, 7) OVER w AS DOUBLE) AS sales_lag_7,
         CAST(lag(revenue, 30) OVER w AS DOUBLE) AS sales_lag_30,
         CASE WHEN count(revenue) OVER w7 = 7 THEN round(CAST(sum(revenue) OVER w7 AS DOUBLE) / 7.0, 4) END
           AS sales_rolling_7_mean
  FROM daily
  WINDOW w AS (ORDER BY date), w7 AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
)
, st AS (
  SELECT d.date,
         last_value(n.close IGNORE NULLS) OVER w AS nvidia_close,
         last_value(sm.close IGNORE NULLS) OVER w AS samsung_close
  FROM daily d
  LEFT JOIN stock_prices n ON d.date = n.date AND n.ticker = 'NVDA'
  LEFT JOIN stock_prices sm ON d.date = sm.date AND sm.ticker = 'SAMSUNG'
  WINDOW w AS (ORDER BY d.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
, gf AS (
  SELECT cal.date,
         last_value(cw.price_aluminum IGNORE NULLS) OVER w AS price_aluminum,
         last_value(cw.price_copper IGNORE NULLS) OVER w AS price_copper,
         last_value(cw.price_crude_oil IGNORE NULLS) OVER w AS price_crude_oil
  FROM cal LEFT JOIN cwide cw ON cal.date = cw.date
  WINDOW w AS (ORDER BY cal.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
, ext AS (
  SELECT CAST(unnest(generate_series((SELECT max(year) FROM annual_interest) + 1,
                                     (SELECT year FROM horizon))) AS INTEGER) AS year
)
, intr AS (
  SELECT year, CAST(last_value(value IGNORE NULLS) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                    AS DOUBLE) AS interest_rate
  FROM (SELECT year, value FROM annual_interest UNION ALL SELECT year, NULL FROM ext)
)
, fit AS (
  SELECT regr_slope(CAST(value AS DOUBLE), year - 2000.0) AS slope,
         regr_intercept(CAST(value AS DOUBLE), year - 2000.0) AS intercept
  FROM (SELECT year, lithium AS value FROM annual)
)
, lext AS (
  SELECT CAST(unnest(generate_series((SELECT max(year) FROM annual) + 1, (SELECT year FROM horizon))) AS INTEGER) AS year
)
, lith AS (
  SELECT year, round(CAST(lithium AS DOUBLE), 2) AS lithium_price_usd FROM annual
  UNION ALL
  SELECT lext.year, round(fit.slope * (lext.year - 2000.0) + fit.intercept, 2) FROM lext, fit
)
, dfe AS (
  SELECT cal.date,
         CAST(month(cal.date) AS INTEGER) AS month, CAST(weekofyear(cal.date) AS INTEGER) AS week,
         CAST(isodow(cal.date) - 1 AS INTEGER) AS day_of_week, CAST(quarter(cal.date) AS INTEGER) AS quarter,
         CASE WHEN hd.date IS NULL THEN 0 ELSE 1 END AS is_holiday,
         lr.sales_lag_7, lr.sales_lag_30, lr.sales_rolling_7_mean,
         st.nvidia_close, st.samsung_close,
         CAST(ai.value AS DOUBLE) AS inflation_india, intr.interest_rate, lith.lithium_price_usd,
         gf.price_aluminum, gf.price_copper, gf.price_crude_oil
  FROM cal
  LEFT JOIN (SELECT DISTINCT date FROM holidays) hd ON cal.date = hd.date
  LEFT JOIN lr ON cal.date = lr.date
  LEFT JOIN st ON cal.date = st.date
  LEFT JOIN gf ON cal.date = gf.date
  LEFT JOIN annual_inflation ai ON year(cal.date) = ai.year
  LEFT JOIN intr ON year(cal.date) = intr.year
  LEFT JOIN lith ON year(cal.date) = lith.year
)
"""

_FEATURE_TABLE = f"""
SELECT s.date, s.order_id, s.product_id, s.revenue AS sales,
       {", ".join("dfe." + f for f in _FEATURES)},
       {_ONE_HOTS}
FROM sales s
LEFT JOIN products p ON s.product_id = p.id
LEFT JOIN regions r ON s.region_id = r.id
LEFT JOIN dfe ON s.date = dfe.date
WHERE {" AND ".join("dfe." + f + " IS NOT NULL" for f in _FEATURES)}
"""

q("feature_table", _CAL + _DAYS + _FEATURE_TABLE)

q("split_sizes", _CAL + _DAYS + f"""
, ft AS ({_FEATURE_TABLE})
, ranked AS (SELECT sales, row_number() OVER (ORDER BY date, order_id, product_id, sales) AS r, count(*) OVER () AS n FROM ft)
, marked AS (SELECT sales, r > n - CAST(ceil(round(0.2 * n, 9)) AS BIGINT) AS test FROM ranked)
SELECT count(*) FILTER (NOT test) AS n_train, count(*) FILTER (test) AS n_test,
       CAST(sum(sales) FILTER (NOT test) AS DECIMAL(38,4)) AS sales_train, CAST(sum(sales) FILTER (test) AS DECIMAL(38,4)) AS sales_test
FROM marked
""")

_INPUTS = _FEATURES + [f"Category_{_lvl(c)}" for c in _CATS] + [f"Region_{_lvl(g)}" for g in _REGIONS]

q("ols_optimality", "SELECT unnest([" + ", ".join(f"'{c}'" for c in [*_INPUTS, "intercept"]) + "]) AS input, CAST(0 AS DOUBLE) AS slope")

# The fit in SQL: centred products, scaled to correlations, swept pivot by pivot
# (a pivot below 1e-9 is a collinear column and stays out).
_P = len(_INPUTS)

q("ols_mae", _CAL + _DAYS + f"""
, ft AS ({_FEATURE_TABLE})
, ranked AS (SELECT *, row_number() OVER (ORDER BY date, order_id, product_id, sales) AS r, count(*) OVER () AS n FROM ft)
, marked AS (
  SELECT r > n - CAST(ceil(round(0.2 * n, 9)) AS BIGINT) AS test,
         [{", ".join(f"CAST({c} AS DOUBLE)" for c in [*_INPUTS, "sales"])}] AS x
  FROM ranked
)
, places AS (SELECT unnest(range(1, {_P + 2})) AS i)
, means AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x[i]) AS m FROM marked, places WHERE NOT test GROUP BY i))
, centred AS (SELECT test, list_transform(list_zip(x, m), lambda v: v[1] - v[2]) AS z FROM marked, means)
, cells AS (SELECT z[:{_P}] AS z, count(*) AS w, sum(z[{_P + 1}]) AS t FROM centred WHERE NOT test GROUP BY ALL)
, gram AS (
  SELECT a.i, b.i AS j, sum(CASE WHEN b.i = {_P + 1} THEN z[a.i] * t ELSE w * z[a.i] * z[b.i] END) AS v
  FROM cells, places a, places b WHERE a.i <= {_P} GROUP BY ALL
)
, scales AS (SELECT i, CASE WHEN v > 0 THEN sqrt(v) ELSE 1 END AS d FROM gram WHERE i = j)
, matrix AS (
  SELECT list(line ORDER BY i) AS m FROM (
    SELECT p.i, list(v / a.d / coalesce(b.d, 1) ORDER BY j) AS line
    FROM gram p JOIN scales a ON p.i = a.i LEFT JOIN scales b ON p.j = b.i GROUP BY p.i)
)
, solved AS (
  WITH RECURSIVE swept AS (
    SELECT 1 AS k, m, CAST([] AS INTEGER[]) AS taken FROM matrix
    UNION ALL
    SELECT k + 1,
           CASE WHEN m[k][k] < 1e-9 THEN m ELSE list_transform(m, lambda line, i:
             list_transform(line, lambda v, j: CASE WHEN i = k THEN v / m[k][k] ELSE v - line[k] * m[k][j] / m[k][k] END)) END,
           CASE WHEN m[k][k] < 1e-9 THEN taken ELSE list_append(taken, k) END
    FROM swept WHERE k <= {_P}
  )
  SELECT m, taken FROM swept WHERE k = {_P + 1}
)
, slopes AS (
  SELECT list(CASE WHEN list_contains(taken, CAST(i AS INTEGER)) THEN m[i][{_P + 1}] / d ELSE 0 END ORDER BY i) AS b FROM solved, scales
)
SELECT count(*) FILTER (NOT test) AS n_train, count(*) FILTER (test) AS n_test,
       round(avg(abs(z[{_P + 1}] - list_dot_product(z[:{_P}], b))) FILTER (test), 4) AS mae
FROM centred, slopes
""")

_MARKET = ["inflation_india", "interest_rate", "lithium_price_usd", "price_aluminum", "price_copper", "price_crude_oil"]

q("score_features", _REQUESTS + _CONTEXT + _CAL_LONG + _DAYS + f"""
, filled AS (
  SELECT date, {", ".join(f"last_value({m} IGNORE NULLS) OVER w AS {m}" for m in _MARKET)}
  FROM dfe WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
, asked AS (
  SELECT ctx.*, v.holiday, v.ticker, v.cat_stored,
         CASE lower(v.region) WHEN 'north' THEN 'EUROPE' WHEN 'east' THEN 'ASIA' WHEN 'south' THEN 'AFRICA' WHEN 'west' THEN 'AMERICA' END AS home,
         coalesce(CAST(context_revenue AS DOUBLE), 0) AS rev,
         least(basis_date, (SELECT max(date) FROM cal)) AS known_day
  FROM ctx JOIN vreq v USING (request_id)
)
SELECT request_id, sample_size, level_used, basis_date,
       CAST(month(basis_date) AS DOUBLE) AS month, CAST(weekofyear(basis_date) AS DOUBLE) AS week,
       CAST(isodow(basis_date) - 1 AS DOUBLE) AS day_of_week, CAST(quarter(basis_date) AS DOUBLE) AS quarter,
       CAST(holiday IS NOT NULL AS DOUBLE) AS is_holiday,
       rev * 0.95 AS sales_lag_7, rev * 0.90 AS sales_lag_30, rev AS sales_rolling_7_mean,
       CASE WHEN ticker = 'NVDA' THEN coalesce(stock_close, 0) ELSE 0 END AS nvidia_close,
       CASE WHEN ticker = 'SAMSUNG' THEN coalesce(stock_close, 0) ELSE 0 END AS samsung_close,
       {", ".join(f"coalesce(CAST(filled.{m} AS DOUBLE), 0) AS {m}" for m in _MARKET)},
       {", ".join(f"CAST(coalesce(cat_stored = '{c}', false) AS DOUBLE) AS Category_{_lvl(c)}" for c in _CATS)},
       {", ".join(f"CAST(coalesce(home = '{g}', false) AS DOUBLE) AS Region_{_lvl(g)}" for g in _REGIONS)}
FROM asked LEFT JOIN filled ON filled.date = known_day
""")

q("forecast_frame", """
, ends AS (SELECT min(date) AS a, max(date) AS b FROM daily)
, days AS (
  SELECT date AS ds, 0 AS is_future FROM daily
  UNION ALL SELECT b + CAST(k AS INTEGER), 1 FROM ends, generate_series(1, 90) g(k)
)
SELECT ds, is_future, (ds - (SELECT a FROM ends)) / 365.25::DOUBLE AS trend,
       CAST(month(ds) = 1 AND day(ds) = 1 AS DOUBLE) AS hol_new_year,
       CAST(month(ds) = 8 AND day(ds) = 15 AS DOUBLE) AS hol_independence_day,
       CAST(month(ds) = 11 AND day(ds) = 12 AS DOUBLE) AS "hol_diwali__deepavali_",
       CAST(month(ds) = 12 AND day(ds) = 25 AS DOUBLE) AS hol_christmas_day
FROM days
""")

q("forecast_balance", """
, inputs AS (
  SELECT 'trend' AS input UNION ALL SELECT 'intercept'
  UNION ALL SELECT 'yearly_' || f || k FROM (SELECT unnest(['s', 'c']) AS f), (SELECT unnest(range(1, 11)) AS k)
  UNION ALL SELECT 'weekly_' || f || k FROM (SELECT unnest(['s', 'c']) AS f), (SELECT unnest(range(1, 4)) AS k)
  UNION ALL SELECT DISTINCT 'hol_' || regexp_replace(lower(name), '[^a-z0-9]', '_', 'g') FROM holidays
)
SELECT n_days, total, input, CAST(0 AS DOUBLE) AS slope
FROM inputs, (SELECT count(*) AS n_days, round(CAST(sum(revenue) AS DOUBLE), 2) AS total FROM daily)
""")

q("price_at_sale", """
, lines AS (
  SELECT s.order_id, s.product_id, s.date, CASE p_brand WHEN 'Brand#1' THEN 'NVDA' WHEN 'Brand#2' THEN 'SAMSUNG' ELSE 'SONY' END AS ticker
  FROM sales s JOIN part ON s.product_id = p_partkey WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')
)
SELECT l.order_id, l.product_id, l.date, l.ticker, q.date AS quote_date, q.close
FROM lines l ASOF LEFT JOIN stock_prices q ON l.ticker = q.ticker AND l.date >= q.date
""")


# ---------------------------------------------------------------------------
# Analytics endpoints: the same results with numeric NULL -> 0
# ---------------------------------------------------------------------------
q("holiday_analytics", """
SELECT name AS holiday, date, is_public, coalesce(n_lines, 0) AS num_transactions, coalesce(quantity, 0) AS total_quantity,
       coalesce(revenue, 0) AS total_revenue, coalesce(profit, 0) AS total_profit
FROM holidays LEFT JOIN daily USING (date)
""")

q("commodity_analytics", _IMPACT + """
SELECT strftime(m, '%Y-%m') AS month, 'end_product' AS category, coalesce(revenue, 0) AS total_revenue,
       coalesce(round(usd, 4), 0) AS avg_commodity_price, coalesce(round(price_yoy_pct, 4), 0) AS commodity_yoy_pct
FROM earned LEFT JOIN price ON price.date = m
""")

q("macro_analytics", _TREND + """
SELECT month, coalesce(revenue, 0) AS total_revenue, coalesce(round(fx, 4), 0) AS avg_usd_inr,
       coalesce(round(inflation, 4), 0) AS inflation, coalesce(round(interest, 4), 0) AS interest_rate
FROM earned LEFT JOIN rates USING (month)
""")

q("stock_analytics", """
SELECT d.date, d.revenue AS total_revenue,
       coalesce(sp.close, 0) AS stock_close, coalesce(sp.volume, 0) AS stock_volume
FROM daily d LEFT JOIN stock_prices sp ON d.date = sp.date AND sp.ticker = 'NVDA'
""")
