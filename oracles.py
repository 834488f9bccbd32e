"""DuckDB SQL for the queries of ``__spark_entry__``.

Written from the definitions, on the supplied tables, independently of how the
Spark side gets there: window functions, grouped subqueries and list folds.
"""

from __future__ import annotations

_BRONZE = """
bronze AS (
  SELECT concat('IN', lpad(CAST(p_partkey AS VARCHAR), 8, '0')) AS isin,
         concat(upper(split_part(p_name, ' ', 2)), p_partkey) AS code,
         concat(p_name, ' ', p_partkey) AS name,
         CAST(l_shipdate AS DATE) AS d,
         CASE l_returnflag WHEN 'A' THEN 'EQ' WHEN 'N' THEN 'SM' ELSE 'BE' END AS series,
         l_extendedprice / l_quantity AS c,
         l_extendedprice / l_quantity * (1 - l_discount) AS o,
         l_extendedprice / l_quantity * (1 + l_tax) AS h,
         p_retailprice AS p,
         CAST(l_quantity AS BIGINT) AS volume,
         l_extendedprice AS turnover,
         CAST(l_linenumber AS BIGINT) AS trades
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

_UNIQUE = """
uniq AS (
  SELECT * FROM bronze
  QUALIFY row_number() OVER (PARTITION BY isin, d
    ORDER BY CASE series WHEN 'EQ' THEN 0 WHEN 'SM' THEN 1 ELSE 2 END, turnover DESC) = 1)"""

_SILVER = """
silver AS (
  SELECT *, (c - p) / nullif(p, 0) * 100 AS pnl,
         sha256(concat_ws('|', 'SYN', isin, code, CAST(d AS VARCHAR))) AS k
  FROM uniq WHERE series IN ('EQ', 'SM'))"""

_GOLD = """
mean AS (SELECT isin, code, avg(pnl) AS m FROM silver GROUP BY isin, code),
gold AS (SELECT silver.*, m FROM silver LEFT JOIN mean USING (isin, code))"""

# e(0) = x(0), e(t) = 0.25 x(t) + 0.75 e(t-1), folded over the whole series up to each row
_SERIES = """
series AS (
  SELECT k, isin, d, c,
         list_reduce(list(c) OVER (PARTITION BY isin ORDER BY d, k ROWS UNBOUNDED PRECEDING),
                     lambda a, v: 0.25::DOUBLE * v + 0.75::DOUBLE * a) AS e
  FROM silver)"""

_BRONZE_WITH = "WITH" + _BRONZE
_UNIQUE_WITH = _BRONZE_WITH + "," + _UNIQUE
_SILVER_WITH = _UNIQUE_WITH + "," + _SILVER
_GOLD_WITH = _SILVER_WITH + "," + _GOLD
_EMA_WITH = _GOLD_WITH + "," + _SERIES


def _micro(expression: str) -> str:
    return f"floor(({expression}) * 1e6 + 0.5) / 1e6"


_SUMMARY = f"""code AS stock_code, name AS stock_name, isin, d AS business_date, c AS closing_price,
  pnl AS pnl_percentage, {_micro('m')} AS avg_pnl_percentage"""

_MOVERS = _GOLD_WITH + f""",
daily AS (
  SELECT isin, code, name, d, sum(c) AS c, sum(pnl) AS pnl, sum(m) AS m
  FROM gold GROUP BY isin, code, name, d)
SELECT {_SUMMARY} FROM daily
WHERE m IS NOT NULL AND d = (SELECT max(d) FROM gold)"""

_CATALOG = _GOLD_WITH + """,
catalog AS (
  SELECT DISTINCT ON (code) code AS stock_code, name AS stock_name, isin
  FROM gold WHERE code IS NOT NULL ORDER BY code, d DESC NULLS FIRST, k)"""


def _suggest(text: str, limit: int) -> str:
    return _CATALOG + f"""
SELECT * FROM catalog
WHERE contains(upper(stock_code), '{text}') OR contains(upper(stock_name), '{text}')
ORDER BY CASE WHEN upper(stock_code) = '{text}' THEN 0
              WHEN starts_with(upper(stock_code), '{text}') THEN 1
              WHEN starts_with(upper(stock_name), '{text}') THEN 2 ELSE 3 END,
         upper(stock_name), upper(stock_code), isin
LIMIT {limit}"""


def _dedup_stream() -> str:
    """Five batches one after the other, each looking at what those before it kept."""
    parts = ["""
WITH dealt AS (
  SELECT *, least((day(ts) - 1) // 8, 3) + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS batch FROM events),
marked AS (SELECT *, (SELECT max(h.ts) FROM dealt h WHERE h.batch < d.batch) - INTERVAL 7 DAY AS mark FROM dealt d),
first AS (
  SELECT * FROM marked WHERE mark IS NULL OR ts >= mark
  QUALIFY row_number() OVER (PARTITION BY batch, user_id, event_type ORDER BY ts, event_id) = 1),
kept0 AS (SELECT * FROM first WHERE batch = 0)"""]
    for n in range(1, 5):
        parts.append(f"""kept{n} AS (
  SELECT * FROM kept{n - 1} UNION ALL
  SELECT * FROM first f WHERE batch = {n} AND NOT EXISTS (
    SELECT 1 FROM kept{n - 1} k WHERE k.user_id = f.user_id AND k.event_type = f.event_type AND k.ts >= f.mark))""")
    return ",\n".join(parts) + """
SELECT event_id, CASE WHEN event_id IN (SELECT event_id FROM kept4) THEN 'kept' WHEN ts < mark THEN 'late' ELSE 'repeat' END AS fate
FROM marked"""


def oracle_sql() -> dict[str, str]:
    return {
        "dedup_quotes": _UNIQUE_WITH + """
SELECT isin AS ISIN, CAST(d AS VARCHAR) AS BizDt, series AS SctySrs, turnover FROM uniq""",
        "series_filter": _BRONZE_WITH + """
SELECT isin AS ISIN, CAST(d AS VARCHAR) AS BizDt, series AS SctySrs, volume
FROM bronze WHERE series IN ('EQ', 'SM')""",
        "hash_key": _BRONZE_WITH + """
SELECT isin AS ISIN, d AS business_date,
       sha256(concat_ws('|', 'SYN', isin, code, CAST(d AS VARCHAR))) AS hash_key
FROM bronze""",
        "daily_return": _BRONZE_WITH + """
SELECT isin AS ISIN, d AS business_date, turnover AS total_turnover_value,
       (c - p) / nullif(p, 0) * 100 AS pnl_percentage
FROM bronze""",
        "typed_text": _BRONZE_WITH + """
SELECT d AS trading_date, d AS business_date, 'SYN' AS data_source_code, isin AS ISIN, code AS ticker_symbol,
       series AS security_series, name AS financial_instrument_name, o AS open_price, h AS high_price,
       o AS low_price, c AS closing_price, c AS last_price, p AS previous_closing_price,
       volume AS total_trading_volume, turnover AS total_turnover_value,
       trades AS total_number_of_transactions_executed
FROM bronze""",
        "silver": _SILVER_WITH + """
SELECT d AS trading_date, d AS business_date, 'SYN' AS data_source_code, isin AS ISIN, code AS ticker_symbol,
       series AS security_series, name AS financial_instrument_name, o AS open_price, h AS high_price,
       o AS low_price, c AS closing_price, c AS last_price, p AS previous_closing_price,
       volume AS total_trading_volume, turnover AS total_turnover_value,
       trades AS total_number_of_transactions_executed, k AS hash_key, pnl AS pnl_percentage
FROM silver""",
        "load_silver": _BRONZE_WITH + """,
raw AS (
  SELECT CASE WHEN volume <> 8 THEN isin END AS isin, date_trunc('month', d)::DATE AS d, code, series, turnover, c, volume FROM bronze
  WHERE series IN ('EQ', 'SM')),
marked AS (
  SELECT *, CASE WHEN isin IS NULL OR volume = 7 THEN 'incomplete' WHEN d < DATE '1995-01-01' THEN 'late' END AS reason FROM raw),
loaded AS (
  SELECT * FROM marked WHERE reason IS NULL
  QUALIFY row_number() OVER (PARTITION BY isin, code, d ORDER BY series, turnover DESC, c) = 1)
SELECT 'loaded' AS outcome, isin AS ISIN, CAST(d AS VARCHAR) AS day, turnover FROM loaded
UNION ALL SELECT reason, isin, CASE WHEN volume = 7 THEN strftime(d, '%d/%m/%Y') ELSE CAST(d AS VARCHAR) END, turnover
FROM marked WHERE reason IS NOT NULL""",
        "load_touched": _BRONZE_WITH + """,
monthly AS (SELECT * REPLACE (date_trunc('month', d)::DATE AS d) FROM bronze),
raw AS (
  SELECT * FROM monthly QUALIFY row_number() OVER (PARTITION BY isin, d
    ORDER BY CASE series WHEN 'EQ' THEN 0 WHEN 'SM' THEN 1 ELSE 2 END, turnover DESC) = 1),
equity AS (SELECT isin AS ISIN, CAST(d AS VARCHAR) AS day, series AS security_series, turnover, d FROM raw WHERE series IN ('EQ', 'SM'))
SELECT 'loaded' AS outcome, ISIN, day, security_series, turnover FROM equity
WHERE d >= DATE '1997-01-01' OR d IN (DATE '1995-08-01', DATE '1996-07-01')
UNION ALL SELECT 'late', ISIN, day, security_series, turnover FROM equity WHERE d < DATE '1997-01-01'""",
        "load_gold": _BRONZE_WITH + """,
silver AS (
  SELECT *, (c - p) / nullif(p, 0) * 100 AS pnl, sha256(concat_ws('|', 'SYN', isin, code, CAST(d AS VARCHAR))) AS k
  FROM (SELECT * REPLACE (date_trunc('month', d)::DATE AS d) FROM bronze WHERE series IN ('EQ', 'SM'))
  QUALIFY row_number() OVER (PARTITION BY isin, code, d ORDER BY series, turnover DESC, c) = 1),""" + _GOLD + "," + _SERIES + f"""
SELECT isin AS ISIN, code AS stock_code, d AS business_date, series AS security_series, gold.c AS closing_price,
       turnover AS total_turnover_value, k AS hash_key, pnl AS pnl_percentage, {_micro('m')} AS avg_pnl_percentage, ema_7
FROM gold LEFT JOIN (SELECT k, e AS ema_7 FROM series) USING (k)""",
        "late_reprocess": _BRONZE_WITH + """,
silver AS (
  SELECT *, (c - p) / nullif(p, 0) * 100 AS pnl, sha256(concat_ws('|', 'SYN', isin, code, CAST(d AS VARCHAR))) AS k
  FROM (SELECT * REPLACE (date_trunc('month', d)::DATE AS d) FROM bronze WHERE series IN ('EQ', 'SM'))
  QUALIFY row_number() OVER (PARTITION BY isin, code, d ORDER BY series, turnover DESC, c) = 1),""" + _GOLD + "," + _SERIES + f"""
SELECT isin AS ISIN, code AS stock_code, d AS business_date, series AS security_series, gold.c AS closing_price,
       turnover AS total_turnover_value, k AS hash_key, pnl AS pnl_percentage, {_micro('m')} AS avg_pnl_percentage, {_micro('ema_7')} AS ema_7
FROM gold LEFT JOIN (SELECT k, e AS ema_7 FROM series) USING (k)""",
        "load_daily": _BRONZE_WITH + """,
raw AS (
  SELECT isin, date_trunc('month', d)::DATE AS month, series FROM bronze
  QUALIFY row_number() OVER (PARTITION BY isin, month ORDER BY CASE series WHEN 'EQ' THEN 0 WHEN 'SM' THEN 1 ELSE 2 END, turnover DESC) = 1),
n AS (SELECT count(*) AS raw_rows, count(*) FILTER (series IN ('EQ', 'SM')) AS equity FROM raw),
steps AS (SELECT unnest(['bronze', 'silver', 'gold', 'checks']) AS step)
SELECT 1 AS run, step, 'succeeded' AS status, CASE step WHEN 'bronze' THEN raw_rows WHEN 'checks' THEN 0 ELSE equity END AS rows_written FROM steps, n
UNION ALL SELECT 2, step, 'succeeded', 0 FROM steps
UNION ALL SELECT 0, concat('up to: ', t), CAST((SELECT max(month) FROM raw WHERE t = 'bronze' OR series IN ('EQ', 'SM')) AS VARCHAR), 0
FROM (SELECT unnest(['bronze', 'silver', 'gold']) AS t)""",
        "reporting_views": _GOLD_WITH + """
SELECT 'stock_daily_summary' AS stage, count(DISTINCT (isin, code, name, d)) AS row_count FROM gold
UNION ALL SELECT 'stock_performance', count(DISTINCT (isin, code)) FROM gold
UNION ALL SELECT 'stock_technical_indicators', count(*) FROM gold
UNION ALL SELECT 'market_overview', 1
UNION ALL SELECT s, least(20, (SELECT count(DISTINCT (isin, code, name)) FROM gold WHERE d = (SELECT max(d) FROM gold) AND m IS NOT NULL))
FROM (SELECT unnest(['top_gainers', 'top_losers']) AS s)""",
        "align_schema": """
SELECT l_orderkey,
       CASE WHEN l_returnflag <> 'R' THEN CAST(l_shipdate AS DATE) END AS day,
       TRY_CAST(nullif(trim(concat('  ', CAST(l_quantity AS BIGINT), ' ')), '') AS BIGINT) AS volume,
       l_extendedprice AS price,
       TRY_CAST(nullif(trim(l_linestatus), '') AS DOUBLE) AS wrong,
       CAST(NULL AS VARCHAR) AS absent
FROM lineitem""",
        "union_batches": _BRONZE_WITH + """
SELECT isin AS ISIN, CAST(d AS VARCHAR) AS BizDt, nullif(series, 'BE') AS SctySrs,
       CAST(volume AS VARCHAR) AS TtlTradgVol
FROM bronze""",
        "anti_join_new_rows": _BRONZE_WITH + """,
unkeyed AS (SELECT CASE WHEN series <> 'BE' THEN isin END AS isin, d, turnover FROM bronze),
batch AS (
  SELECT * FROM unkeyed QUALIFY row_number() OVER (PARTITION BY isin, d ORDER BY turnover DESC) = 1)
SELECT isin AS ISIN, CAST(d AS VARCHAR) AS BizDt, turnover FROM batch
WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT DISTINCT isin, d FROM unkeyed WHERE d < DATE '1998-07-01') AS held
  WHERE held.isin IS NOT DISTINCT FROM batch.isin AND held.d IS NOT DISTINCT FROM batch.d)""",
        "hash_dedup_append": _BRONZE_WITH + """,
hashed AS (
  SELECT *, sha256(concat_ws('|', 'SYN', isin, code, CAST(d AS VARCHAR))) AS k
  FROM bronze WHERE series IN ('EQ', 'SM'))
SELECT k AS hash_key, series AS security_series, turnover AS total_turnover_value
FROM (SELECT * FROM hashed
      QUALIFY row_number() OVER (PARTITION BY k ORDER BY series, turnover DESC, c) = 1)
WHERE k NOT IN (SELECT k FROM hashed WHERE d <= DATE '1999-01-01')""",
        "incremental_files": """
WITH files AS (
  SELECT DISTINCT concat('file:/landing/', l_linestatus, '/',
           CASE l_returnflag WHEN 'A' THEN concat('quotes_0_', strftime(l_shipdate, '%Y%m%d'), '.zip')
                             WHEN 'N' THEN 'quotes_20261399.zip' ELSE 'quotes_latest.ZIP' END) AS path,
         l_shipdate AS modified
  FROM lineitem),
dated AS (
  SELECT path, split_part(path, '/', -1) AS file_name,
         coalesce(CAST(try_strptime(regexp_extract(path, '(\\d{8})', 1), '%Y%m%d') AS DATE),
                  CAST(modified AS DATE)) AS file_date
  FROM files)
SELECT * FROM dated WHERE file_date > DATE '1999-01-01'""",
        "incremental_scan": _BRONZE_WITH + """
SELECT isin AS ISIN, CAST(d AS VARCHAR) AS BizDt, c AS closing_price FROM bronze WHERE d > DATE '1999-01-01'""",
        "high_water_mark": _BRONZE_WITH + """
SELECT max(d) AS ingest_partition FROM bronze WHERE series IN ('EQ', 'SM')""",
        "watermark_upsert": """
WITH held AS (
  SELECT l_returnflag AS a, l_suppkey AS b, l_linestatus AS e, max(CAST(l_shipdate AS DATE)) AS d
  FROM lineitem WHERE l_shipdate < DATE '1999-01-01' GROUP BY ALL),
written AS (
  SELECT l_returnflag AS a, l_suppkey AS b, l_linestatus AS e, min(CAST(l_shipdate AS DATE)) AS d
  FROM lineitem GROUP BY ALL)
SELECT coalesce(held.a, written.a) AS table_layer, CAST(coalesce(held.b, written.b) AS VARCHAR) AS table_name,
       coalesce(held.e, written.e) AS cycle, greatest(held.d, written.d) AS ingest_partition
FROM held FULL JOIN written ON held.a = written.a AND held.b = written.b AND held.e = written.e""",
        "row_counts": _SILVER_WITH + """
SELECT 'bronze' AS stage, count(*) AS row_count FROM bronze
UNION ALL SELECT 'deduplicated', count(*) FROM uniq
UNION ALL SELECT 'silver', count(*) FROM silver""",
        "avg_return": _GOLD_WITH + f"""
SELECT isin AS ISIN, code AS stock_code, {_micro('m')} AS avg_pnl_percentage FROM mean""",
        "avg_return_increment": _GOLD_WITH + f"""
SELECT isin AS ISIN, code AS stock_code, {_micro('m')} AS avg_pnl_percentage FROM mean""",
        "avg_return_joinback": _GOLD_WITH + f"""
SELECT isin AS ISIN, code AS stock_code, d AS business_date, pnl AS pnl_percentage,
       {_micro('m')} AS avg_pnl_percentage
FROM gold""",
        "ema_series": _EMA_WITH + """
SELECT k AS hash_key, isin AS ISIN, d AS business_date, c AS closing_price, e AS ema_7 FROM series""",
        "ema_final": _SILVER_WITH + """,
final AS (
  SELECT isin, list_reduce(list(c ORDER BY d, k), lambda a, v: 0.25::DOUBLE * v + 0.75::DOUBLE * a) AS e
  FROM silver GROUP BY isin)
SELECT k AS hash_key, isin AS ISIN, d AS business_date, c AS closing_price, e AS ema_7
FROM silver JOIN final USING (isin)""",
        "ema_resumed": _EMA_WITH + """
SELECT k AS hash_key, e AS ema_7 FROM series""",
        "gold": _EMA_WITH + f"""
SELECT d AS trading_date, d AS business_date, 'SYN' AS data_source_code, isin AS ISIN, code AS stock_code,
       series AS security_series, name AS stock_name, o AS open_price, h AS high_price,
       o AS low_price, gold.c AS closing_price, gold.c AS last_price, p AS previous_closing_price,
       volume AS total_trading_volume, turnover AS total_turnover_value,
       trades AS total_number_of_transactions_executed, k AS hash_key, pnl AS pnl_percentage,
       {_micro('m')} AS avg_pnl_percentage, ema_7
FROM gold LEFT JOIN (SELECT k, e AS ema_7 FROM series) USING (k)""",
        "stock_catalog": _CATALOG + " SELECT * FROM catalog",
        "suggest": _suggest("ROD193", 10),
        "suggest_by_name": _suggest("HOT ROD", 20),
        "search": _GOLD_WITH + f""",
newest AS (
  SELECT DISTINCT ON (code) * FROM gold WHERE upper(coalesce(name, '')) LIKE '%RED G%'
  ORDER BY code, d DESC NULLS FIRST, k)
SELECT {_SUMMARY} FROM newest ORDER BY code NULLS LAST LIMIT 100""",
        "search_indexed": _GOLD_WITH + f""",
newest AS (
  SELECT DISTINCT ON (code) * FROM gold WHERE upper(coalesce(name, '')) LIKE '%RED G%'
  ORDER BY code, d DESC NULLS FIRST, k)
SELECT {_SUMMARY} FROM newest ORDER BY code NULLS LAST LIMIT 100""",
        "suggest_indexed": _suggest("HOT ROD", 20),
        "latest": _GOLD_WITH + f"""
SELECT {_SUMMARY} FROM gold WHERE upper(code) = upper('rod193') ORDER BY d DESC NULLS FIRST, k LIMIT 1""",
        "history": _GOLD_WITH + """
SELECT d AS business_date, o AS open_price, h AS high_price, o AS low_price, c AS closing_price, c AS last_price,
       p AS previous_closing_price, pnl AS pnl_percentage, volume AS total_trading_volume
FROM gold
WHERE upper(code) = upper('rod193') AND d >= DATE '1996-01-01' AND d <= DATE '2000-12-31'
ORDER BY d DESC NULLS FIRST, k LIMIT 14""",
        "indicators": _EMA_WITH + """
SELECT gold.d AS business_date, gold.c AS closing_price, e AS ema_7
FROM gold LEFT JOIN series ON series.k = gold.k
WHERE upper(code) = upper('rod193') ORDER BY gold.d DESC NULLS FIRST, gold.k LIMIT 10""",
        "details": _EMA_WITH + """,
wanted AS (
  SELECT gold.*, e FROM gold LEFT JOIN series ON series.k = gold.k WHERE upper(code) = upper('rod193'))
SELECT (SELECT name FROM wanted ORDER BY d DESC NULLS FIRST, k LIMIT 1) AS stock_name,
       (SELECT max(d) FROM wanted) AS latest_date,
       d AS business_date, c AS closing_price, volume AS total_trading_volume, e AS ema_7
FROM wanted ORDER BY d DESC NULLS FIRST, k LIMIT 30""",
        "gainers": _MOVERS + " ORDER BY m DESC, code, isin LIMIT 20",
        "losers": _MOVERS + " ORDER BY m, code, isin LIMIT 20",
        "gainers_of_the_day": _MOVERS + " ORDER BY pnl DESC, code, isin LIMIT 50",
        "daily_rollup": _GOLD_WITH + f"""
SELECT isin, code AS stock_code, name AS stock_name, d AS business_date, sum(o) AS open_price,
       sum(c) AS closing_price, sum(p) AS previous_closing_price, CAST(sum(volume) AS BIGINT) AS total_trading_volume,
       sum(pnl) AS pnl_percentage, {_micro('sum(m)')} AS avg_pnl_percentage
FROM gold GROUP BY isin, code, name, d""",
        "overview": _GOLD_WITH + f""",
last_day AS (SELECT * FROM gold WHERE d = (SELECT max(d) FROM gold) AND m IS NOT NULL),
ranked AS (
  SELECT 'gainers' AS side, row_number() OVER (ORDER BY m DESC, code, isin) - 1 AS pos, code FROM last_day
  UNION ALL
  SELECT 'losers', row_number() OVER (ORDER BY m, code, isin) - 1, code FROM last_day)
SELECT (SELECT max(d) FROM gold) AS latest_business_date,
       (SELECT count(DISTINCT code) FROM gold) AS tracked_stocks,
       (SELECT {_micro('coalesce(avg(pnl), 0)')} FROM gold) AS average_pnl_percentage,
       side, CAST(pos AS INTEGER) AS position, code AS stock_code
FROM ranked WHERE pos < 5""",
        "overview_from_states": _GOLD_WITH + f""",
last_day AS (SELECT * FROM gold WHERE d = (SELECT max(d) FROM gold) AND m IS NOT NULL),
ranked AS (
  SELECT 'gainers' AS side, row_number() OVER (ORDER BY m DESC, code, isin) - 1 AS pos, code FROM last_day
  UNION ALL
  SELECT 'losers', row_number() OVER (ORDER BY m, code, isin) - 1, code FROM last_day)
SELECT (SELECT max(d) FROM gold) AS latest_business_date,
       (SELECT count(DISTINCT code) FROM gold) AS tracked_stocks,
       (SELECT {_micro('coalesce(avg(pnl), 0)')} FROM gold) AS average_pnl_percentage, true AS sketch_is_close,
       side, CAST(pos AS INTEGER) AS position, code AS stock_code
FROM ranked WHERE pos < 5""",
        "latest_date": _SILVER_WITH + " SELECT max(d) AS latest_business_date FROM silver",
        "tracked_stocks": _SILVER_WITH + " SELECT count(DISTINCT code) AS tracked_stocks FROM silver",
        "market_average": _SILVER_WITH + f"""
SELECT {_micro('coalesce(avg(pnl), 0)')} AS average_pnl_percentage FROM silver""",
        "load_status": _SILVER_WITH + """
SELECT true AS database_reachable, true AS gold_table_available, max(d) AS latest_business_date FROM silver""",
        "flatten_json": "SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS props_k FROM events",
        "snapshot": """
SELECT p_name AS stock_name, p_retailprice AS last_traded_price, p_brand AS company_name, p_type AS industry,
       concat('IN', p_partkey) AS ISIN, 'run01' AS pipeline_run_id, 'SYN' AS source_system, 'parts.json' AS file_name
FROM part""",
        "html_items": """
WITH found AS (
  SELECT page_id, regexp_extract_all(html, '(?is)<li(?:\\s[^>]*)?>(.*?)</li\\s*>', 1) AS items FROM pages),
one AS (
  SELECT page_id, CAST(unnest(range(len(items))) AS INTEGER) AS position, unnest(items) AS item FROM found)
SELECT page_id, position,
  regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(item, '(?s)<[^>]*>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
    '^\\s+|\\s+$', '', 'g') AS text
FROM one""",
        "html_nested": """
WITH rows AS (SELECT *, unnest(generate_series(1, (page_id % 3 + 1)::INTEGER)) AS n FROM pages)
SELECT page_id, 1 AS table_number, 1 AS depth, n::INTEGER AS row_number, 1 AS cell_number, false AS header, concat(url, ' after') AS text FROM rows
UNION ALL SELECT page_id, 1, 1, n::INTEGER, 2, false, concat('é', length(html)) FROM rows
UNION ALL SELECT page_id, 2 * n::INTEGER, 2, 1, 1, true, concat('n', page_id, ' ', chr((page_id % 26 + 97)::INTEGER)) FROM rows
UNION ALL SELECT page_id, 2 * n::INTEGER, 2, 1, 2, false, '<b>tail' FROM rows
UNION ALL SELECT page_id, 2 * n::INTEGER + 1, 3, 1, 1, false, 'deep A&' FROM rows""",
        "html_table": """
WITH found AS (
  SELECT page_id, regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1) AS items FROM pages),
one AS (
  SELECT page_id, CAST(unnest(range(len(items))) AS INTEGER) AS row_number, unnest(items) AS item FROM found)
SELECT page_id, row_number,
  regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(item, '(?s)<[^>]*>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
    '^\\s+|\\s+$', '', 'g') AS cell,
  'Market Cap' AS header
FROM one""",
        "csv_scan": _BRONZE_WITH + """
SELECT isin AS ISIN, CAST(d AS VARCHAR) AS BizDt, series AS SctySrs, name AS FinInstrmNm,
       CAST(volume AS VARCHAR) AS TtlTradgVol
FROM bronze""",
        "zip_scan": _BRONZE_WITH + """
SELECT isin AS ISIN, CAST(d AS VARCHAR) AS BizDt, series AS SctySrs, name AS FinInstrmNm,
       CAST(volume AS VARCHAR) AS TtlTradgVol
FROM bronze""",
        "load_bronze_zip": _BRONZE_WITH + """,
monthly AS (SELECT * REPLACE (date_trunc('month', d)::DATE AS d) FROM bronze)
SELECT isin AS ISIN, CAST(d AS VARCHAR) AS BizDt, series AS SctySrs, turnover FROM monthly
QUALIFY row_number() OVER (PARTITION BY isin, d
  ORDER BY CASE series WHEN 'EQ' THEN 0 WHEN 'SM' THEN 1 ELSE 2 END, turnover DESC) = 1""",
        "load_files": _BRONZE_WITH + """,
monthly AS (SELECT isin, date_trunc('month', d)::DATE AS d FROM bronze),
files AS (SELECT d, count(DISTINCT isin) AS quotes, d = DATE '1996-07-01' AS skipped FROM monthly GROUP BY d)
SELECT concat('quotes_', strftime(d, '%Y%m%d'), '.zip') AS file_name, d AS file_date,
       CASE WHEN skipped THEN 'skipped' ELSE 'loaded' END AS outcome,
       CASE WHEN skipped THEN concat('dated ', d, ', loaded up to ', (SELECT max(d) FROM files WHERE d < DATE '1998-06-01')) END AS reason,
       CASE WHEN skipped THEN 0 ELSE quotes END AS quotes
FROM files""",
        "parquet_scan": _BRONZE_WITH + """
SELECT isin AS ISIN, CAST(d AS VARCHAR) AS BizDt, series AS SctySrs, CAST(volume AS VARCHAR) AS TtlTradgVol
FROM bronze WHERE series IN ('EQ', 'SM')""",
        "ema_stream": """
SELECT event_id, user_id, value,
       list_reduce(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),
                   lambda a, v: 0.25::DOUBLE * v + 0.75::DOUBLE * a) AS ema_7
FROM events""",
        "ema_state": """
SELECT event_id, user_id, value,
       list_reduce(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),
                   lambda a, v: 0.25::DOUBLE * v + 0.75::DOUBLE * a) AS ema_7, false AS late
FROM events""",
        "dq_types": _BRONZE_WITH + """,
n AS (SELECT count(*) AS every, count(*) FILTER (volume <> 7) AS even FROM bronze),
kinds AS (
  SELECT unnest(['TradDt', 'BizDt', 'Src', 'ISIN', 'TckrSymb', 'SctySrs', 'FinInstrmNm', 'OpnPric', 'HghPric', 'LwPric', 'ClsPric', 'LastPric',
                 'PrvsClsgPric', 'TtlTradgVol', 'TtlTrfVal', 'TtlNbOfTxsExctd', 'XpryDt']) AS column_name,
         unnest(['odd date', 'date', 'text', 'text', 'text', 'text', 'text', 'double', 'double', 'double', 'double', 'odd double',
                 'double', 'long', 'double', 'long', 'none']) AS kind)
SELECT column_name, CASE WHEN kind = 'none' THEN 0 ELSE every END AS filled,
       CASE WHEN kind = 'long' THEN every ELSE 0 END AS as_bigint,
       CASE kind WHEN 'long' THEN every WHEN 'double' THEN every WHEN 'odd double' THEN even ELSE 0 END AS as_double,
       CASE kind WHEN 'date' THEN every WHEN 'odd date' THEN even ELSE 0 END AS as_date,
       CASE kind WHEN 'long' THEN 'bigint' WHEN 'none' THEN 'void' WHEN 'double' THEN 'double' WHEN 'date' THEN 'date' ELSE 'string' END AS narrowest
FROM kinds, n""",
        "dedup_stream": _dedup_stream(),
        "dedup_events": "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events",
        "sma": _SILVER_WITH + f"""
SELECT k AS hash_key,
       {_micro('avg(c) OVER (PARTITION BY isin ORDER BY d, k ROWS 6 PRECEDING)')} AS sma_7
FROM silver""",
        "volatility": _SILVER_WITH + f"""
SELECT k AS hash_key,
       {_micro('stddev_samp(pnl) OVER (PARTITION BY isin ORDER BY d, k ROWS 6 PRECEDING)')} AS volatility_7
FROM silver""",
        "price_change": _SILVER_WITH + """,
paired AS (SELECT k, c, lag(c) OVER (PARTITION BY isin ORDER BY d, k) AS b FROM silver)
SELECT k AS hash_key, c - b AS price_change, (c - b) / nullif(b, 0) * 100 AS price_change_percentage FROM paired""",
        "normalised_price": _SILVER_WITH + f""",
scale AS (
  SELECT isin, avg(c) AS m, stddev_samp(c) AS s, min(c) AS lo, max(c) AS hi FROM silver GROUP BY isin)
SELECT k AS hash_key, {_micro('(c - m) / nullif(s, 0)')} AS price_zscore,
       (c - lo) / nullif(hi - lo, 0) AS price_minmax
FROM silver JOIN scale USING (isin)""",
        "stock_performance": _SILVER_WITH + f"""
SELECT isin AS ISIN, code AS stock_code, min(d) AS first_date, max(d) AS last_date, count(*) AS trading_days,
       {_micro('avg(pnl)')} AS avg_pnl_percentage
FROM silver GROUP BY isin, code""",
        "dq_duplicates": _BRONZE_WITH + """
SELECT isin AS ISIN, d AS business_date, count(*) AS row_count FROM bronze GROUP BY isin, d HAVING count(*) > 1""",
        "dq_missing_codes": _BRONZE_WITH + """
SELECT count(*) AS row_count, count(*) FILTER (isin IS NULL) AS missing_isin,
       count(*) FILTER (series = 'BE') AS missing_stock_code,
       count(*) FILTER (series = 'SM') AS missing_stock_name
FROM bronze""",
        "dq_invalid_prices": _BRONZE_WITH + """,
odd AS (
  SELECT CASE WHEN volume = 8 THEN 0 ELSE o END AS op, CASE WHEN volume = 7 THEN o / 2 ELSE h END AS hi, o AS lo,
         CASE WHEN volume <> 9 THEN c END AS cl
  FROM bronze),
problems AS (
  SELECT 'not_positive' AS problem FROM odd WHERE op <= 0 OR hi <= 0 OR lo <= 0 OR cl <= 0
  UNION ALL SELECT 'high_below_low' FROM odd WHERE hi < lo
  UNION ALL SELECT 'close_outside_range' FROM odd WHERE cl < lo OR cl > hi
  UNION ALL SELECT 'close_missing' FROM odd WHERE cl IS NULL)
SELECT problem, count(*) AS row_count FROM problems GROUP BY problem""",
        "dq_missing_dates": _SILVER_WITH + """,
calendar AS (SELECT d, row_number() OVER (ORDER BY d) AS n FROM (SELECT DISTINCT d FROM silver)),
absent AS (
  SELECT s.isin, c.n FROM (SELECT DISTINCT isin FROM silver) s CROSS JOIN calendar c
  ANTI JOIN silver p ON p.isin = s.isin AND p.d = c.d),
runs AS (
  SELECT isin, min(n) AS low, max(n) AS high, count(*) AS days
  FROM (SELECT isin, n, n - row_number() OVER (PARTITION BY isin ORDER BY n) AS run FROM absent) GROUP BY isin, run)
SELECT isin AS ISIN, a.d AS gap_after, b.d AS gap_before, days AS missing_days
FROM runs LEFT JOIN calendar a ON a.n = low - 1 LEFT JOIN calendar b ON b.n = high + 1""",
        "dq_row_counts": _SILVER_WITH + f""",
counts AS (SELECT d AS business_date, count(*) AS row_count FROM silver GROUP BY d),
expected AS (
  SELECT *, avg(row_count) OVER (ORDER BY business_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS e FROM counts)
SELECT business_date, row_count, {_micro('e')} AS expected_count,
       coalesce(abs(row_count - e) > 0.5 * e, false) AS unexpected
FROM expected""",
        "dq_findings": _SILVER_WITH + """,
calendar AS (SELECT d, row_number() OVER (ORDER BY d) AS n FROM (SELECT DISTINCT d FROM silver)),
present AS (SELECT DISTINCT isin, d FROM silver WHERE isin IS NOT NULL),
counts AS (SELECT d, count(*) AS r FROM silver GROUP BY d),
expected AS (SELECT r, avg(r) OVER (ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS e FROM counts)
SELECT 'duplicate_rows' AS "check",
       (SELECT count(*) FROM (SELECT 1 FROM silver GROUP BY isin, d HAVING count(*) > 1)) AS findings
UNION ALL SELECT 'duplicate_hashes', (SELECT count(*) FROM (SELECT 1 FROM silver GROUP BY k HAVING count(*) > 1))
UNION ALL SELECT 'missing_isin', (SELECT count(*) FROM silver WHERE coalesce(trim(isin), '') = '')
UNION ALL SELECT 'missing_stock_code', (SELECT count(*) FROM silver WHERE coalesce(trim(code), '') = '')
UNION ALL SELECT 'missing_stock_name', (SELECT count(*) FROM silver WHERE coalesce(trim(name), '') = '')
UNION ALL SELECT 'invalid_prices',
       (SELECT count(*) FROM silver WHERE o <= 0 OR h <= 0 OR c <= 0 OR h < o OR c < o OR c > h OR c IS NULL)
UNION ALL SELECT 'missing_days', (SELECT count(DISTINCT isin) FROM present) * (SELECT count(*) FROM calendar) - (SELECT count(*) FROM present)
UNION ALL SELECT 'unexpected_row_counts', (SELECT count(*) FROM expected WHERE abs(r - e) > 0.5 * e)""",
    }
