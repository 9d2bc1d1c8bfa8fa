"""SQL twins of the queries, written from the definitions and run by another engine.

``{x}`` in a text is replaced by a shared piece from ``PIECES``.
"""

from __future__ import annotations

PIECES: dict[str, str] = {}

PIECES["trades"] = """trades AS (
  SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS scheme_code,
         p_brand || '/' || p_type AS company_id, p_brand, p_type, l_orderkey,
         CAST(l_shipdate AS DATE) AS ship_date,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_quantity AS DECIMAL(18,2)) AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

PIECES["holdings"] = PIECES["trades"] + """, grouped AS (
  SELECT scheme_code, CAST(date_trunc('month', ship_date) AS DATE) AS disclosure_month,
         company_id, p_brand, p_type, sum(price) AS mv, sum(qty) AS qty
  FROM trades GROUP BY ALL), holdings AS (
  SELECT scheme_code, disclosure_month, company_id, p_brand, p_type,
         p_type || ' ' || p_brand AS instrument_name_raw,
         CASE p_type WHEN 'PROMO' THEN 'cash' WHEN 'ECONOMY' THEN 'debt' ELSE 'equity' END AS asset_class,
         CAST(qty AS DOUBLE) AS quantity, CAST(mv AS DOUBLE) AS market_value, mv,
         CAST(CAST(100.0 AS DOUBLE) * CAST(mv AS DOUBLE) / CAST(sum(mv) OVER (
           PARTITION BY scheme_code, disclosure_month) AS DOUBLE) AS DECIMAL(18,6)) AS weight_pct
  FROM grouped)"""

PIECES["equity"] = PIECES["holdings"] + """, equity AS (
  SELECT * FROM holdings WHERE asset_class = 'equity' AND company_id IS NOT NULL), latest AS (
  SELECT * FROM equity WHERE disclosure_month = (SELECT max(disclosure_month) FROM equity))"""

PIECES["companies"] = """companies AS (
  SELECT p_brand || '/' || p_type AS isin, p_type || ' ' || p_brand AS company_name,
         upper(p_brand || '_' || p_type) AS nse_symbol, p_brand, p_type,
         CASE p_type WHEN 'LARGE' THEN 'large' WHEN 'MEDIUM' THEN 'mid' WHEN 'SMALL' THEN 'small' END AS cap_bucket,
         p_brand AS sector, CAST(sum(p_size) AS DOUBLE) AS free_float_shares_cr
  FROM part GROUP BY p_brand, p_type)"""

PIECES["schemes"] = """schemes AS (
  SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS scheme_code, s_name AS scheme_name,
         n_name AS amc_name, 'CATEGORY_' || n_regionkey AS category,
         'LARGE EQUAL WEIGHT' AS benchmark,
         CAST(s_suppkey % 150 + 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS ter_regular_pct,
         CAST(s_suppkey % 150 + 40 AS DOUBLE) / CAST(100 AS DOUBLE) AS ter_direct_pct,
         greatest(s_acctbal, 0) AS aum_cr
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

PIECES["prices"] = """daily AS (
  SELECT company_id AS isin, p_brand, p_type, ship_date, sum(price) AS price, sum(qty) AS qty
  FROM trades GROUP BY ALL), prices AS (
  SELECT isin, upper(p_brand || '_' || p_type) AS nse_symbol,
         CAST(sum(price) AS DOUBLE) / CAST(sum(qty) AS DOUBLE) AS close,
         CAST(sum(qty) AS DOUBLE) / count(*) AS adv_shares_30d
  FROM daily GROUP BY ALL)"""

PIECES["candles"] = """candles AS (
  SELECT company_id AS isin, ship_date AS ts,
         CAST(sum(price) AS DOUBLE) / CAST(sum(qty) AS DOUBLE) AS close, sum(qty) AS vol
  FROM trades GROUP BY ALL), index_candles AS (
  SELECT ship_date AS ts, CAST(sum(price) AS DOUBLE) / CAST(sum(qty) AS DOUBLE) AS close
  FROM trades GROUP BY ALL), returns AS (
  SELECT isin, ts, r FROM (SELECT isin, ts, ln(close / lag(close) OVER (
    PARTITION BY isin ORDER BY ts)) AS r FROM candles) WHERE r IS NOT NULL), index_returns AS (
  SELECT ts, r FROM (SELECT ts, ln(close / lag(close) OVER (ORDER BY ts)) AS r FROM index_candles)
  WHERE r IS NOT NULL), vols AS (
  SELECT isin, CASE WHEN count(r) >= 20 THEN stddev_samp(r) * sqrt(252) * 100 END AS volatility_pct
  FROM (SELECT DISTINCT isin FROM candles) LEFT JOIN returns USING (isin) GROUP BY isin), betas AS (
  SELECT c.isin, CASE WHEN count(i.r) >= 30 THEN covar_samp(a.r, i.r) / nullif(var_samp(i.r), 0) END AS beta
  FROM (SELECT DISTINCT isin FROM candles) c LEFT JOIN (returns a JOIN index_returns i ON a.ts = i.ts)
    ON c.isin = a.isin GROUP BY c.isin), drawdowns AS (
  SELECT isin, CASE WHEN count(*) >= 2 THEN min(close / peak - 1) * 100 END AS max_drawdown_pct
  FROM (SELECT isin, close, max(close) OVER (PARTITION BY isin ORDER BY ts) AS peak FROM candles)
  GROUP BY isin)"""

PIECES["positions"] = """positions AS (
  SELECT 'P' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS portfolio_id,
         'S' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS scheme_code,
         sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""

PIECES["look"] = PIECES["holdings"] + ", " + PIECES["positions"] + """, look AS (
  SELECT portfolio_id, company_id, asset_class, min(instrument_name_raw) AS instrument_name_raw,
         CAST(sum(v * CAST(weight_pct AS DECIMAL(18,6))) AS DOUBLE) AS vw, max(total) AS total
  FROM positions JOIN (SELECT portfolio_id, sum(v) AS total FROM positions GROUP BY 1) USING (portfolio_id)
    JOIN holdings USING (scheme_code)
  WHERE disclosure_month = (SELECT max(disclosure_month) FROM holdings) GROUP BY ALL), look_through AS (
  SELECT portfolio_id, company_id, asset_class, instrument_name_raw,
         vw / CAST(total AS DOUBLE) AS weight_pct, vw / 100 AS value FROM look WHERE total > 0)"""

_CROWD = """crowd AS (
  SELECT company_id, isin, company_name, cap_bucket, free_float_shares_cr,
         CAST(sum(weight_pct * coalesce(CAST(aum_cr AS DECIMAL(18,2)), 0)) / 100 AS DECIMAL(28,10)) AS v
  FROM (SELECT * FROM holdings WHERE asset_class = 'equity'
        AND disclosure_month = (SELECT max(disclosure_month) FROM holdings WHERE asset_class = 'equity')) h
    LEFT JOIN schemes USING (scheme_code) JOIN companies ON company_id = isin
  GROUP BY ALL)"""

# Products are kept as integers, as a decimal division would lose digits.
PIECES["crowd"] = ", ".join([PIECES["holdings"], PIECES["companies"], PIECES["schemes"],
                             _CROWD.replace("CAST(sum(weight_pct * coalesce(CAST(aum_cr AS DECIMAL(18,2)), 0)) / 100 AS DECIMAL(28,10))",
                                            "CAST(CAST(sum(CAST(weight_pct AS DECIMAL(18,6)) * coalesce(CAST(aum_cr AS DECIMAL(18,2)), 0)) AS DECIMAL(36,8)) * 0.01 AS DECIMAL(28,10))")])

PIECES["dtl"] = PIECES["crowd"] + ", " + PIECES["prices"] + """, dtl AS (
  SELECT isin, company_name, prices.nse_symbol, cap_bucket,
         CAST(round(v, 1) AS DOUBLE) AS mf_holding_cr,
         CAST(round(CAST((CAST(v AS DOUBLE) * 1e7 / nullif(close, 0)) / nullif(free_float_shares_cr * 1e7, 0) * 100
           AS DECIMAL(24,6)), 2) AS DOUBLE) AS mf_pct_of_free_float, adv_shares_30d,
         CAST(round(CAST((CAST(v AS DOUBLE) * 1e7 / nullif(close, 0)) / nullif(CAST(0.2 AS DOUBLE) * adv_shares_30d, 0)
           AS DECIMAL(24,6)), 1) AS DOUBLE) AS days_to_liquidate,
         CAST(0.2 AS DOUBLE) AS participation_assumption
  FROM crowd JOIN prices USING (isin))"""

PIECES["direct"] = """direct AS (
  SELECT 'P' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS portfolio_id, company_id AS isin,
         p_type || ' ' || p_brand AS symbol, sum(qty) AS q, sum(price) AS cost,
         max(CAST(round(CAST(CAST(price AS DOUBLE) / CAST(qty AS DOUBLE) AS DECIMAL(18,6)), 2) AS DECIMAL(18,2))) AS ltp
  FROM trades JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), direct_values AS (
  SELECT portfolio_id, isin, symbol, CAST(round(CAST(q AS DECIMAL(18,2)) * ltp, 2) AS DECIMAL(18,2)) AS v,
         CAST(round(CAST(q AS DECIMAL(18,2)) * CAST(CAST(cost AS DOUBLE) / CAST(q AS DOUBLE) AS DECIMAL(18,6)), 2) AS DECIMAL(18,2)) AS c
  FROM direct), direct_weights AS (
  SELECT portfolio_id, isin AS company_id, 'equity' AS asset_class, symbol AS instrument_name_raw,
         CAST(v AS DOUBLE) / CAST(total AS DOUBLE) * 100 AS weight_pct
  FROM direct_values JOIN (SELECT portfolio_id, sum(v) AS total FROM direct_values GROUP BY 1) USING (portfolio_id)
  WHERE total > 0)"""


def _concentration(source: str) -> str:
    return f"""SELECT portfolio_id, max(instrument_name_raw) FILTER (rn = 1) AS top_holding,
  coalesce(CAST(round(CAST(sum(w) FILTER (rn = 1) AS DECIMAL(18,6)), 2) AS DOUBLE), 0) AS top_holding_pct,
  coalesce(CAST(round(CAST(sum(w) FILTER (rn <= 5) AS DECIMAL(18,6)), 2) AS DOUBLE), 0) AS top_5_pct,
  coalesce(CAST(round(CAST(sum(w) FILTER (rn <= 10) AS DECIMAL(18,6)), 2) AS DOUBLE), 0) AS top_10_pct,
  count(w) AS unique_companies,
  coalesce(CAST(round(sum(CAST(CAST(CAST(w AS DECIMAL(14,8)) AS DECIMAL(19,8)) * CAST(CAST(w AS DECIMAL(14,8)) AS DECIMAL(19,8)) AS DECIMAL(24,10))), 1) AS DOUBLE), 0) AS hhi
FROM (SELECT portfolio_id,
        CASE WHEN asset_class = 'equity' THEN instrument_name_raw END AS instrument_name_raw,
        CASE WHEN asset_class = 'equity' THEN CAST(weight_pct AS DECIMAL(18,10)) END AS w,
        CASE WHEN asset_class = 'equity' THEN row_number() OVER (
          PARTITION BY portfolio_id, asset_class ORDER BY weight_pct DESC, company_id) END AS rn
      FROM {source})
GROUP BY portfolio_id"""


def _luhn(isin: str) -> str:
    """Check sum of a well-formed identifier, as SQL over a text expression."""
    digits = (f"list_reverse(string_split(array_to_string(list_transform(string_split({isin}, ''), "
              "lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), ''), ''))")
    return (f"list_sum(list_transform({digits}, lambda d, i: CASE WHEN i % 2 = 1 THEN CAST(d AS INT) "
            "WHEN CAST(d AS INT) > 4 THEN 2 * CAST(d AS INT) - 9 ELSE 2 * CAST(d AS INT) END))")


def _with_check(body: str) -> str:
    return f"({body}) || CAST((10 - {_luhn('(' + body + chr(41) + ' || ' + chr(39) + '0' + chr(39))} % 10) % 10 AS VARCHAR)"


def _name(raw: str) -> str:
    """Normalised company name."""
    s = f"regexp_replace(lower({raw}), '\\b(equity|shares?|holdings? of|listed|unlisted)\\b', ' ', 'g')"
    s = f"regexp_replace({s}, '[^\\w\\s]', ' ', 'g')"
    words = "['limited','ltd','private','pvt','public','plc','corporation','corp','company','co','incorporated','inc','the']"
    return (f"array_to_string(list_filter(regexp_split_to_array({s}, '\\s+'), "
            f"lambda w: w <> '' AND NOT list_contains({words}, w)), ' ')")


def _canonical(raw: str) -> str:
    s = _name(raw)
    for w in ("direct plan", "regular plan", "direct", "regular", "growth option", "growth", "idcw",
              "dividend", "payout", "reinvestment", "bonus option", "daily", "weekly", "monthly",
              "quarterly", "option", "plan"):
        s = f"replace({s}, '{w}', ' ')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def _sorted_words(name: str) -> str:
    return f"array_to_string(list_sort(string_split({name}, ' ')), ' ')"


def _lcs(a: str, b: str) -> str:
    """Longest common subsequence by bit vectors over a HUGEINT."""
    full = f"((CAST(1 AS HUGEINT) << length({a})) - 1)"
    masks = (f"list_transform(string_split({b}, ''), lambda c: CAST(coalesce(list_sum(list_transform("
             f"range(0, length({a})), lambda i: CASE WHEN substr({a}, CAST(i + 1 AS BIGINT), 1) = c "
             f"THEN CAST(1 AS HUGEINT) << CAST(i AS INT) ELSE CAST(0 AS HUGEINT) END)), 0) AS HUGEINT))")
    walked = f"list_reduce({masks}, lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}, {full})"
    return f"(length({a}) - bit_count({walked}))"


PIECES["isins"] = """type_no(p_type, n) AS (VALUES ('ECONOMY', 1), ('LARGE', 2), ('MEDIUM', 3), ('PROMO', 4),
  ('SMALL', 5), ('STANDARD', 6)), isins AS (
  SELECT p_brand || '/' || p_type AS company_id, p_brand, p_type, """ + _with_check(
    "'INE' || lpad(CAST(CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) * 10 + n AS VARCHAR), 6, '0') || '01'") + """ AS isin
  FROM (SELECT DISTINCT p_brand, p_type FROM part) JOIN type_no USING (p_type))"""

PIECES["bronze"] = PIECES["holdings"] + ", " + PIECES["isins"] + """, turned AS (
  SELECT h.*, isin AS own, (CAST(substr(scheme_code, 2) AS INT) + month(disclosure_month)
    + CAST(regexp_extract(h.p_brand, '(\\d+)$', 1) AS INT)) % 7 AS turn
  FROM holdings h JOIN isins USING (company_id)), bronze AS (
  SELECT 'Scheme ' || scheme_code || ' Fund' AS scheme_name, scheme_code || '.csv' AS source_file,
    CASE turn WHEN 0 THEN instrument_name_raw || ' Ltd.'
      WHEN 1 THEN upper(instrument_name_raw || ' Limited')
      WHEN 2 THEN substr(instrument_name_raw, 1, 1) || substr(instrument_name_raw, 3)
      WHEN 3 THEN instrument_name_raw || 'x - equity shares' ELSE instrument_name_raw END AS instrument_name_raw,
    CASE WHEN turn >= 4 THEN own WHEN turn = 3 THEN 'INE000000000' END AS isin,
    CASE WHEN turn >= 5 THEN own WHEN turn = 4 THEN ' ' || lower(own) WHEN turn = 3 THEN 'INE000000000' ELSE '-' END AS raw_isin,
    CASE asset_class WHEN 'debt' THEN 'equity' ELSE asset_class END AS asset_class,
    CAST(weight_pct AS DOUBLE) AS weight_pct, disclosure_month, scheme_code, 'run-' || copy AS ingestion_run_id, copy
  FROM turned, (VALUES (1), (2)) c(copy) WHERE copy = 1 OR turn = 6)"""

PIECES["resolved"] = PIECES["bronze"] + ", " + PIECES["companies"] + """, listed AS (
  SELECT i.isin, company_name FROM companies c JOIN isins i ON c.isin = i.company_id
  WHERE c.p_type NOT IN ('PROMO', 'ECONOMY')), choices AS (
  SELECT n, min(isin) AS isin, substr(n, 1, 4) AS block FROM (
    SELECT """ + _name("company_name") + """ AS n, isin FROM listed) WHERE n <> '' GROUP BY n), named AS (
  SELECT *, """ + _name("instrument_name_raw") + """ AS n,
    CASE WHEN isin IS NOT NULL AND """ + _luhn("isin") + """ % 10 = 0 THEN isin END AS good
  FROM bronze), names AS (
  SELECT DISTINCT n FROM named WHERE n <> ''), compared AS (
  SELECT names.n, c.n AS match, c.isin, CAST(2 * """ + _lcs("_a", "_b") + """ AS DOUBLE) / (length(_a) + length(_b)) AS score
  FROM (SELECT n, """ + _sorted_words("n") + """ AS _a, substr(n, 1, 4) AS block FROM names) names
  JOIN (SELECT *, """ + _sorted_words("n") + """ AS _b FROM choices) c
    ON c.block = names.block OR names.block NOT IN (SELECT block FROM choices)), fuzzy AS (
  SELECT n, isin AS fuzzy_isin, score FROM compared WHERE score * 100 >= 88 - 1e-9
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, match) = 1), resolved AS (
  SELECT b.*, coalesce(good, CASE WHEN good IS NULL THEN fuzzy_isin END) AS company_id,
    CASE WHEN l.isin IS NOT NULL THEN 'isin' WHEN good IS NOT NULL THEN 'isin_unmapped'
      WHEN fuzzy_isin IS NOT NULL THEN 'fuzzy_name' ELSE 'unresolved' END AS resolution_method,
    CAST(CASE WHEN l.isin IS NOT NULL THEN 1.0 WHEN good IS NOT NULL THEN 0.9
      ELSE coalesce(score, 0) END AS DOUBLE) AS resolution_confidence
  FROM named b LEFT JOIN listed l ON b.good = l.isin LEFT JOIN fuzzy ON b.n = fuzzy.n)"""

PIECES["sheets"] = PIECES["holdings"] + ", " + PIECES["isins"] + """, layout(k, stem, unit, mult) AS (
  VALUES (0, 'bluewater', '(Rs. in Lakhs)', 1e5), (1, 'northstar', '', 1), (2, 'meridian', '', 1),
  (3, 'kaveri', '(Rs. in Crores)', 1e7), (4, 'sentinel', '', 1), (5, 'zenith', '(Rs Lakhs)', 1e5),
  (6, 'harbour', '', 1), (7, 'memo', '', 1)), filed AS (
  SELECT h.*, k, unit, mult, stem, isin AS own, CAST(substr(scheme_code, 2) AS INT) // 8 % 13 AS pages,
    stem || '_' || scheme_code || '_' || strftime(disclosure_month, '%Y%m') || '.csv' AS source_file
  FROM holdings h JOIN isins USING (company_id) JOIN layout ON CAST(substr(scheme_code, 2) AS INT) % 8 = k), sheet AS (
  SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY company_id) AS r, count(*) OVER (PARTITION BY source_file) AS n,
    (count(*) OVER (PARTITION BY source_file) + 1) // 2 AS upper_n FROM filed)"""

PIECES["nav"] = """plans(i, plan) AS (VALUES (0, ' Fund - Direct Plan - Growth'), (1, ' Fund - Regular Plan - Growth'),
  (2, ' Fund - Direct Plan - IDCW'), (3, ' Fund - Regular - Dividend')), raw AS (
  SELECT *, s_suppkey AS k, CASE WHEN (s_suppkey + i) % 11 = 0 THEN 'N.A.' WHEN (s_suppkey + i) % 13 = 0 THEN ''
      ELSE CAST(CAST(greatest(s_acctbal, 1) AS DECIMAL(18,2)) AS VARCHAR) END AS nav_text,
    CASE s_suppkey % 5 WHEN 0 THEN '-' WHEN 1 THEN 'INVALIDISIN' ELSE """ + _with_check(
    "'INF' || lpad(CAST(s_suppkey % 1000000 AS VARCHAR), 6, '0') || '01'") + """ END AS isin_text,
    CASE WHEN s_suppkey % 17 = 0 THEN '31-Foo-2001' ELSE '20-Jul-2001' END AS day_text,
    n_name || ' Mutual Fund' AS amc_name, 'Open Ended Schemes(Equity Scheme - ' || r_name || ')' AS scheme_type
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, plans), lines AS (
  SELECT *, CASE WHEN k % 19 = 0 THEN k || ';' || s_name ELSE concat_ws(';', k * 4 + i, isin_text, '-', s_name || plan, nav_text, day_text) END AS line,
    CASE WHEN k % 19 = 0 THEN 'fewer than 6 fields' WHEN nav_text IN ('N.A.', '') THEN 'no NAV'
      WHEN k % 17 = 0 THEN 'no date' END AS reason FROM raw), nav AS (
  SELECT CAST(k * 4 + i AS VARCHAR) AS scheme_code, nullif(isin_text, '-') AS isin_growth,
    CAST(NULL AS VARCHAR) AS isin_reinvest, s_name || plan AS scheme_name, CAST(nav_text AS DOUBLE) AS nav,
    DATE '2001-07-20' AS nav_date, amc_name, scheme_type, k % 5 > 1 AS isin_growth_valid,
    false AS isin_reinvest_valid, CASE WHEN i IN (0, 2) THEN 'direct' ELSE 'regular' END AS plan_type,
    i < 2 AS is_growth, substr(scheme_type, 20, length(scheme_type) - 20) AS category
  FROM lines WHERE reason IS NULL), master AS (
  SELECT canonical_name, arg_min(scheme_code, key) AS scheme_code, arg_min(scheme_name, key) AS scheme_name,
    arg_min(amc_name, key) AS amc_name, arg_min(category, key) AS category, count(*) AS plans
  FROM (SELECT *, """ + _canonical("scheme_name") + """ AS canonical_name,
    (CASE WHEN is_growth THEN '0' ELSE '1' END) || scheme_code AS key FROM nav) GROUP BY 1)"""

PIECES["actions"] = """act AS (
  SELECT p_brand || '/' || p_type AS isin, p_brand, p_type, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) AS b
  FROM (SELECT DISTINCT p_brand, p_type FROM part)), actions AS (
  SELECT isin, DATE '1997-06-15' + b AS ex_date, 'split' AS action_type, CAST(2 AS DOUBLE) AS ratio, NULL AS new_isin FROM act WHERE b % 3 = 0
  UNION ALL SELECT isin, DATE '1999-03-10' + b, 'bonus', 4, NULL FROM act WHERE b % 4 = 0
  UNION ALL SELECT isin, DATE '2000-01-20' + b, 'merger', 1, p_brand || '/MEDIUM' FROM act WHERE b % 5 = 0 AND p_type = 'SMALL'
  UNION ALL SELECT isin, DATE '2005-01-01' + b, 'split', 8, NULL FROM act WHERE b % 6 = 0)"""

PIECES["filed"] = PIECES["holdings"] + """, filed AS (
  SELECT h.* REPLACE (CASE WHEN instrument_name_raw <> 'LARGE Brand#7' THEN company_id END AS company_id)
  FROM holdings h, (VALUES (1), (2)) c(copy)
  WHERE copy = 1 OR (CAST(substr(scheme_code, 2) AS INT) + month(disclosure_month)) % 9 = 0), judged AS (
  SELECT scheme_code, disclosure_month, sum(weight_pct) AS t, abs(sum(weight_pct) - 100) AS off,
    abs(sum(weight_pct) - 100) <= 0.5 AS passed FROM filed GROUP BY 1, 2)"""

PIECES["ticks"] = """ticks AS (
  SELECT 'E' || event_id AS event_id, 'Brand#' || (user_id % 25 + 1) || '/' || (['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'])[user_id % 6 + 1] AS isin,
    CAST(user_id AS VARCHAR) AS token, value AS ltp, CAST(event_id % 1000000000 AS INT) AS seq,
    ts, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS event_time FROM events)"""

_GATES = {
    "weights": "SELECT 'scheme_month_weight_reconciliation' AS metric, CAST(round(CAST(r AS DECIMAL(18,6)), 4) AS DOUBLE) AS value, "
               "CAST(0.99 AS DOUBLE) AS threshold, r >= 0.99 AS passed, CAST(0 AS BIGINT) AS unresolved_rows FROM ("
               "SELECT CAST(count(*) FILTER (passed) AS DOUBLE) / count(*) AS r FROM judged)",
    "resolution": "SELECT 'equity_isin_resolution_rate' AS metric, CAST(round(CAST(r AS DECIMAL(18,6)), 4) AS DOUBLE) AS value, "
                  "CAST(0.95 AS DOUBLE) AS threshold, r >= 0.95 AS passed, CAST(x AS BIGINT) AS unresolved_rows FROM ("
                  "SELECT CAST(count(company_id) AS DOUBLE) / count(*) AS r, count(*) - count(company_id) AS x FROM filed WHERE asset_class = 'equity')",
    "duplicates": "SELECT 'duplicate_holdings' AS metric, CAST(x AS DOUBLE) AS value, CAST(0 AS DOUBLE) AS threshold, x = 0 AS passed, "
                  "CAST(0 AS BIGINT) AS unresolved_rows FROM (SELECT sum(n - 1) AS x FROM (SELECT count(*) AS n FROM filed "
                  "GROUP BY scheme_code, disclosure_month, company_id, instrument_name_raw))",
    "freshness": "SELECT 'disclosure_age_days' AS metric, CAST(a AS DOUBLE) AS value, CAST(75 AS DOUBLE) AS threshold, a <= 75 AS passed, "
                 "CAST(0 AS BIGINT) AS unresolved_rows FROM (SELECT date_diff('day', max(disclosure_month), DATE '2001-12-01') AS a FROM filed)",
    "free_float": "SELECT 'mf_ownership_within_free_float' AS metric, CAST(x AS DOUBLE) AS value, CAST(0 AS DOUBLE) AS threshold, x = 0 AS passed, "
                  "CAST(0 AS BIGINT) AS unresolved_rows FROM (SELECT count(*) FILTER (mf_pct_of_free_float > 100) AS x FROM dtl)",
}

_PAIRS = """SELECT {by}a.scheme_code AS s1, b.scheme_code AS s2,
  CAST(sum(least(a.weight_pct, b.weight_pct)) AS DOUBLE) AS overlap_pct
FROM {source} a JOIN {source} b ON a.company_id = b.company_id AND a.disclosure_month = b.disclosure_month
  AND a.scheme_code < b.scheme_code GROUP BY ALL"""

_TWO = "CAST(round(CAST({x} AS DECIMAL(18,6)), 2) AS DOUBLE)"


def _two(x: str) -> str:
    return _TWO.format(x=x)


def _drift(caps: str) -> str:
    parts = ", ".join(
        _two(f"CAST(coalesce(sum(weight_pct) FILTER (cap_bucket = '{b}'), 0) AS DOUBLE) * 100 / CAST(sum(weight_pct) AS DOUBLE)")
        + f" AS {b}_pct" for b in ("large", "mid", "small"))
    return (f"SELECT scheme_code, disclosure_month, {parts} FROM equity JOIN {caps} "
            "WHERE cap_bucket IN ('large', 'mid', 'small') GROUP BY ALL HAVING sum(weight_pct) <> 0")


_TURNOVER_FULL = """, months AS (
  SELECT scheme_code, disclosure_month AS m, lag(disclosure_month) OVER (PARTITION BY scheme_code ORDER BY disclosure_month) AS pm
  FROM (SELECT DISTINCT scheme_code, disclosure_month FROM equity)), moves AS (
  SELECT scheme_code, m, company_id, sum(d) AS d FROM (
    SELECT e.scheme_code, m, company_id, weight_pct AS d FROM months JOIN equity e
      ON e.scheme_code = months.scheme_code AND e.disclosure_month = m WHERE pm IS NOT NULL
    UNION ALL SELECT e.scheme_code, m, company_id, -weight_pct FROM months JOIN equity e
      ON e.scheme_code = months.scheme_code AND e.disclosure_month = pm) GROUP BY ALL)
SELECT scheme_code, m AS disclosure_month, """ + _two("sum(abs(d)) * 6") + """ AS inferred_turnover_pct
FROM moves GROUP BY ALL"""

_ORACLE: dict[str, str] = {
    "conform_schema": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate, CAST(NULL AS DOUBLE) AS gap_pct, "
                      "CAST(NULL AS VARCHAR) AS remark, 'double' AS gap_type, 'string' AS remark_type FROM orders",
    "cell_grid": "WITH {sheets}, files AS (SELECT DISTINCT source_file, k, scheme_code, n, upper_n, pages, k = 1 AND n > upper_n AS two FROM sheet), "
                 "every AS (SELECT source_file, pages + 3 + r + CASE WHEN k = 1 AND r > upper_n THEN 2 ELSE 0 END AS line_no, 5 AS width, "
                 "CASE WHEN k = 5 THEN CAST(weight_pct AS VARCHAR) ELSE instrument_name_raw END AS a, CASE WHEN k = 5 THEN own ELSE format('{{:,}}', CAST(quantity AS BIGINT)) END AS b FROM sheet "
                 "UNION ALL SELECT source_file, 0, 1, 'Monthly portfolio statement', NULL FROM files "
                 "UNION ALL SELECT source_file, i, 1, 'Legal text page ' || i, NULL FROM (SELECT source_file, unnest(range(1, pages + 1)) AS i FROM files) "
                 "UNION ALL SELECT source_file, pages + 1, CASE WHEN k IN (3, 5) THEN 1 ELSE 5 END, CASE WHEN k IN (3, 5) THEN 'Position list' ELSE 'Scheme ' || scheme_code || '  Fund' END, "
                 "CASE WHEN k NOT IN (3, 5) THEN '' END FROM files "
                 "UNION ALL SELECT source_file, pages + 2, 1, 'As on month end', NULL FROM files "
                 "UNION ALL SELECT source_file, pages + 3, CASE WHEN k = 7 THEN 2 ELSE 5 END, CASE k WHEN 7 THEN 'hello' WHEN 5 THEN '% to NAV' ELSE 'Name of the Instrument' END, "
                 "CASE WHEN k = 5 THEN 'ISIN Code' WHEN k <> 7 THEN 'Quantity' END FROM files "
                 "UNION ALL SELECT source_file, pages + 4 + upper_n, 5, 'Scheme ' || scheme_code || ' B  Fund', '' FROM files WHERE two "
                 "UNION ALL SELECT source_file, pages + 5 + upper_n, 5, 'Name of the Instrument', 'Quantity' FROM files WHERE two "
                 "UNION ALL SELECT source_file, pages + 4 + n + CASE WHEN two THEN 2 ELSE 0 END, 5, 'Grand Total', '' FROM files "
                 "UNION ALL SELECT source_file, pages + 5 + n + CASE WHEN two THEN 2 ELSE 0 END, 5, 'Notes: figures are rounded', '' FROM files) "
                 "SELECT source_file, CAST(line_no AS INT) AS row_idx, CAST(width AS INT) AS width, a AS first_cell, b AS third_cell FROM every",
    "header_rows": "WITH {sheets}, heads AS (SELECT DISTINCT source_file, k, mult, pages + 3 AS line_no FROM sheet WHERE k <> 7 "
                   "UNION ALL SELECT DISTINCT source_file, k, mult, pages + 5 + upper_n FROM sheet WHERE k = 1 AND n > upper_n) "
                   "SELECT source_file, CAST(line_no AS INT) AS row_idx, CASE WHEN k = 5 THEN 1 ELSE 0 END AS c_name, CASE k WHEN 4 THEN NULL WHEN 5 THEN 2 ELSE 1 END AS c_isin, "
                   "CASE WHEN k = 5 THEN 4 ELSE 2 END AS c_qty, 3 AS c_val, CASE WHEN k = 5 THEN 0 ELSE 4 END AS c_wt, CAST(mult AS DOUBLE) AS mult, 5 AS width FROM heads",
    "adapter_score": "WITH {sheets} SELECT DISTINCT source_file, CASE WHEN k < 6 THEN upper(stem) WHEN k = 6 THEN 'GENERIC' END AS amc_code, "
                     "CASE WHEN k < 6 THEN stem WHEN k = 6 THEN 'generic-tabular' END AS adapter, "
                     "CAST(CASE WHEN k = 6 THEN 0.55 WHEN k = 7 THEN 0 ELSE 1 END AS DOUBLE) AS score, "
                     "CASE WHEN k = 7 THEN 'quarantined' ELSE 'parsed' END AS status, "
                     "CASE WHEN k = 7 THEN 'no adapter matched' END AS reason FROM sheet",
    "disclosure_parse": "WITH {sheets} SELECT source_file, CASE WHEN k IN (3, 5) THEN replace(source_file, '.csv', '') "
                        "ELSE 'Scheme ' || scheme_code || CASE WHEN k = 1 AND r > upper_n THEN ' B' ELSE '' END || ' Fund' END AS scheme_name, instrument_name_raw, "
                        "CASE WHEN k <> 4 THEN own END AS isin, quantity, market_value * CAST(mult AS DOUBLE) AS market_value, "
                        "CAST(weight_pct AS DOUBLE) AS weight_pct, 'equity' AS asset_class, "
                        "CASE WHEN k < 6 THEN upper(stem) ELSE 'GENERIC' END AS amc_code, CASE WHEN k < 6 THEN stem ELSE 'generic-tabular' END AS adapter, "
                        "DATE '2001-11-01' AS disclosure_month, 'run-1' AS ingestion_run_id FROM sheet WHERE k <> 7",
    "ingest_quarantine": "WITH {sheets} SELECT DISTINCT source_file AS file, 'no adapter matched' AS reason, 'run-1' AS run_id FROM sheet WHERE k = 7",
    "mapping_validate": "WITH {sheets}, files AS (SELECT DISTINCT source_file, k FROM sheet) "
                        "SELECT source_file, 'instrument_name' AS field, 'Name of the Instrument' AS \"column\", k NOT IN (5, 7) AS kept FROM files "
                        "UNION ALL SELECT source_file, 'isin', 'ISIN', k NOT IN (4, 5, 7) FROM files "
                        "UNION ALL SELECT source_file, 'quantity', 'Units Held', false FROM files "
                        "UNION ALL SELECT source_file, 'market_value', NULL, true FROM files",
    "nav_parse": "WITH {nav} SELECT * FROM nav",
    "nav_quarantine": "WITH {nav} SELECT line, amc_name, scheme_type, reason FROM lines WHERE reason IS NOT NULL",
    "month_spine": "WITH {trades} SELECT scheme_code, CAST(unnest(generate_series(date_trunc('month', min(ship_date)), "
                   "date_trunc('month', max(ship_date)), INTERVAL 1 MONTH)) AS DATE) AS month FROM trades GROUP BY scheme_code",
    "instrument_dim": "WITH {companies}, t AS (SELECT upper(p_brand || '_' || p_type) AS nse_symbol, min(CAST(p_partkey AS VARCHAR)) AS smartapi_token "
                      "FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 7 <> 0 GROUP BY 1) "
                      "SELECT isin, nse_symbol, company_name, smartapi_token FROM companies LEFT JOIN t USING (nse_symbol)",
    "candle_conform": "SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS isin, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, "
                      "p AS open, p AS high, p AS low, p AS close, CASE WHEN l_orderkey % 10 <> 0 THEN l_quantity END AS volume "
                      "FROM (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS p FROM lineitem)",
    "page_links": "WITH found AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS site, regexp_extract(url, '^[a-z]+:') AS scheme, regexp_replace(url, '[?#].*$', '') AS bare, "
                  "regexp_replace(url, '#.*$', '') AS whole, unnest(list_distinct(regexp_extract_all(html, '(?i)href=[\"'']([^\"'']+)[\"'']', 1))) AS href FROM pages) "
                  "SELECT DISTINCT page_id, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN scheme || href "
                  "WHEN starts_with(href, '#') THEN whole || href WHEN starts_with(href, '?') THEN bare || href WHEN starts_with(href, '/') THEN site || href "
                  "ELSE regexp_replace(bare, '[^/]*$', '') || href END AS link FROM found",
    "file_manifest": "WITH l AS (SELECT CAST(page_id AS VARCHAR) AS file, sha256(html) AS sha256, CAST(octet_length(encode(html)) AS BIGINT) AS bytes FROM pages) "
                     "SELECT file, 'landed' AS status, sha256, bytes, count(*) OVER (PARTITION BY sha256) AS copies FROM l "
                     "UNION ALL SELECT CAST(page_id + 1000000000 AS VARCHAR), 'failed', NULL, 0, 0 FROM pages WHERE page_id % 10 = 0",
    "snapshot_read": "WITH r AS (SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) - (SELECT min(year(o_orderdate)) FROM orders) + 1 AS INT) AS snapshot_id FROM orders) "
                     "SELECT * FROM r WHERE snapshot_id BETWEEN (CASE WHEN EXISTS (SELECT 1 FROM r WHERE snapshot_id = 4) THEN 4 ELSE 0 END) AND 6",
    "isin_validate": "WITH b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'USA' ELSE 'INE' END || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || (c_custkey % 10) AS s FROM customer), "
                     "n AS (SELECT k, CASE WHEN k % 7 <> 0 THEN s END AS isin FROM b), v AS (SELECT k, isin, coalesce(regexp_matches(isin, '^[A-Z]{{2}}[A-Z0-9]{{9}}[0-9]$') AND "
                     + _luhn("isin").replace("{", "{{").replace("}", "}}") + " % 10 = 0, false) AS valid FROM n) "
                     "SELECT k AS c_custkey, isin, valid, valid AND starts_with(isin, 'INE') AS is_equity FROM v",
    "name_normalise": "WITH r AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'The ' || c_mktsegment || ' & ' || c_name || ' Co. Ltd.' "
                      "WHEN 1 THEN c_name || '  Private LIMITED - Equity Shares' WHEN 2 THEN 'Holdings of ' || c_mktsegment || ' Corp, Unlisted' "
                      "ELSE c_name END AS raw FROM customer) SELECT c_custkey, n AS name, substr(n, 1, 4) AS block FROM (SELECT c_custkey, "
                      + _name("raw") + " AS n FROM r)",
    "to_num": "SELECT l_orderkey, l_linenumber, CASE WHEN k NOT IN (3, 5) THEN p END AS value, CASE WHEN k = 2 THEN -p WHEN k NOT IN (3, 5) THEN p END AS signed_value "
              "FROM (SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 6 AS k, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS p FROM lineitem)",
    "asset_classify": "SELECT p_partkey, CASE k WHEN 0 THEN 'debt' WHEN 1 THEN 'cash' WHEN 2 THEN 'derivative' WHEN 4 THEN 'debt' WHEN 5 THEN 'equity' WHEN 6 THEN 'debt' "
                      "ELSE CASE WHEN p_size > 10 THEN 'equity' ELSE 'other' END END AS asset_class FROM (SELECT p_partkey, p_size, p_partkey % 8 AS k FROM part)",
    "pii_redact": "SELECT doc_id, CAST(length(t) AS INT) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, "
                  "regexp_replace(regexp_replace(regexp_replace(text || CASE doc_id % 3 WHEN 0 THEN chr(10) || 'PAN ABCDE1234F, Folio No: 55/7 ' WHEN 1 THEN chr(10) || 'mail a.b+c@d-e.example!' ELSE '' END, "
                  "'\\b[A-Z]{{5}}[0-9]{{4}}[A-Z]\\b', '[PAN REDACTED]', 'g'), "
                  "'[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_.+-]*@[\\p{{L}}\\p{{N}}_-]+\\.[\\p{{L}}\\p{{N}}_.]*[\\p{{L}}\\p{{N}}_]', '[EMAIL REDACTED]', 'g'), "
                  "'(?i)\\bFolio No[:.]?\\s*([\\p{{L}}\\p{{N}}_/\\- ]+)', 'Folio No: [REDACTED]', 'g') AS t FROM documents)",
    "scheme_code": "SELECT s_suppkey, 'S' || upper(substr(sha1(lower(trim(s_name))), 1, 9)) AS scheme_code FROM supplier",
    "statement_holdings": "SELECT 'P' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS statement_id, 'IN' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS isin, "
                          "'Scheme ' || l_suppkey || ' Growth' AS scheme_name, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) + count(*) AS DOUBLE) AS units, "
                          "CAST(arg_max(10.5 + l_linenumber, l_orderkey * 10 + l_linenumber) AS DOUBLE) AS nav, "
                          "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) + 100 * count(*) AS DOUBLE) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
                          "WHERE l_extendedprice > 0 GROUP BY o_custkey, l_suppkey",
    "silver_resolve": "WITH {resolved} SELECT source_file, disclosure_month, instrument_name_raw, ingestion_run_id, "
                      "CASE WHEN asset_class = 'equity' AND (company_id IS NULL OR company_id NOT IN (SELECT isin FROM listed)) THEN 'other' ELSE asset_class END AS asset_class, "
                      "company_id, resolution_method, resolution_confidence FROM resolved",
    "fuzzy_resolve": "WITH {resolved} SELECT n, fuzzy_isin, score FROM fuzzy",
    "silver_dedup": "WITH {bronze} SELECT scheme_code, disclosure_month, raw_isin AS company_id, instrument_name_raw, weight_pct, ingestion_run_id FROM bronze "
                    "QUALIFY row_number() OVER (PARTITION BY scheme_code, disclosure_month, raw_isin, instrument_name_raw ORDER BY copy DESC) = 1",
    "silver_refile": "WITH {bronze}, one AS (SELECT scheme_code, disclosure_month, raw_isin AS company_id, instrument_name_raw, weight_pct, "
                     "'run-1' AS run FROM bronze WHERE copy = 1), two AS (SELECT * FROM one UNION ALL SELECT scheme_code, disclosure_month, company_id, "
                     "instrument_name_raw, weight_pct + 1, 'run-9' FROM one WHERE CAST(substr(scheme_code, 2, 10) AS INT) % 3 = 0) "
                     "SELECT scheme_code, disclosure_month, company_id, instrument_name_raw, weight_pct, run AS ingestion_run_id FROM two "
                     "QUALIFY row_number() OVER (PARTITION BY scheme_code, disclosure_month, company_id, instrument_name_raw ORDER BY run DESC) = 1",
    "ingest_stats": "WITH {resolved} SELECT ingestion_run_id, count(DISTINCT source_file) AS files_parsed, count(DISTINCT scheme_name) AS schemes, count(*) AS silver_rows, "
                    "count(*) FILTER (asset_class = 'equity') AS equity_rows, coalesce(CAST(round(CAST(CAST(count(company_id) FILTER (asset_class = 'equity') AS DOUBLE) "
                    "/ count(*) FILTER (asset_class = 'equity') AS DECIMAL(18,10)), 4) AS DOUBLE), 0) AS resolution_rate FROM resolved GROUP BY 1",
    "resolution_methods": "WITH {resolved} SELECT ingestion_run_id, resolution_method, count(*) AS rows FROM resolved GROUP BY ALL",
    "scheme_master": "WITH {nav} SELECT * FROM master",
    "scheme_match": "WITH {nav}, asked AS (SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN s_name || ' Fund - Direct Plan - Growth' "
                    "WHEN 1 THEN substr(s_name, 1, 4) || substr(s_name, 6) || ' Fnd' WHEN 2 THEN 'Fund ' || s_name || ' (Regular)' "
                    "ELSE 'Zzz Unknown ' || s_suppkey END AS raw FROM supplier), canon AS (SELECT raw, " + _canonical("raw") + " AS n FROM asked), "
                    "compared AS (SELECT raw, canonical_name AS match, scheme_code, CAST(2 * " + _lcs("_a", "_b") + " AS DOUBLE) / (length(_a) + length(_b)) AS score "
                    "FROM (SELECT raw, " + _sorted_words("n") + " AS _a FROM canon WHERE n <> ''), (SELECT *, " + _sorted_words("canonical_name") + " AS _b FROM master WHERE canonical_name <> '')), "
                    "best AS (SELECT *, score * 100 >= 82 - 1e-9 AS hit FROM compared QUALIFY row_number() OVER (PARTITION BY raw ORDER BY score DESC, match) = 1) "
                    "SELECT canon.raw AS disclosure_scheme_name, n AS canonical_name, CASE WHEN hit THEN scheme_code END AS scheme_code, coalesce(score, 0) AS match_score, "
                    "coalesce(hit, false) AS matched FROM canon LEFT JOIN best USING (raw)",
    "corp_factors": "WITH {actions}, a AS (SELECT * FROM actions WHERE ex_date <= DATE '2001-12-01') SELECT isin, ex_date, action_type, ratio, "
                    "product(ratio) OVER (PARTITION BY isin ORDER BY ex_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS cumulative_factor FROM a",
    "corp_adjust": "WITH {holdings}, {actions}, a AS (SELECT * FROM actions WHERE ex_date <= DATE '2001-12-01'), f AS ("
                   "SELECT h.*, (SELECT product(ratio) FROM a WHERE a.isin = h.company_id AND h.disclosure_month < ex_date) AS pf, "
                   "(SELECT max(new_isin) FROM a WHERE a.isin = h.company_id AND action_type = 'merger') AS successor FROM holdings h) "
                   "SELECT scheme_code, disclosure_month, coalesce(successor, company_id) AS company_id, company_id AS company_id_original, quantity, "
                   "coalesce(pf, 1) AS qty_adjustment_factor, quantity * coalesce(pf, 1) AS quantity_adjusted FROM f",
    "equity_resolved": "WITH {equity} SELECT scheme_code, disclosure_month, company_id, CAST(weight_pct AS DOUBLE) AS weight_pct FROM equity",
    "latest_holdings": "WITH {equity} SELECT scheme_code, disclosure_month, company_id, CAST(weight_pct AS DOUBLE) AS weight_pct FROM latest",
    "overlap_latest": "WITH {equity} " + _PAIRS.format(by="", source="latest"),
    "overlap_pairs": "WITH {equity} " + _PAIRS.format(by="a.disclosure_month, ", source="equity"),
    "overlap_salted": "WITH {equity} " + _PAIRS.format(by="a.disclosure_month, ", source="equity"),
    "overlap_full": "WITH {equity}, {schemes}, p AS (" + _PAIRS.format(by="", source="latest") + ") SELECT a.scheme_code AS scheme_a, b.scheme_code AS scheme_b, "
                    "CASE WHEN a.scheme_code = b.scheme_code THEN 100 ELSE coalesce(" + _two("overlap_pct") + ", 0) END AS overlap_pct "
                    "FROM schemes a CROSS JOIN schemes b LEFT JOIN p ON s1 = least(a.scheme_code, b.scheme_code) AND s2 = greatest(a.scheme_code, b.scheme_code)",
    "active_share": "WITH {equity}, {companies}, {schemes}, bench AS (SELECT isin AS company_id, CAST(CAST(100 AS DOUBLE) / count(*) OVER () AS DECIMAL(18,6)) AS b FROM companies WHERE cap_bucket = 'large'), "
                    "spine AS (SELECT DISTINCT scheme_code, b.company_id, b.b FROM latest, bench b), "
                    "fund AS (SELECT scheme_code, company_id, sum(weight_pct) AS f FROM latest GROUP BY ALL), "
                    "diff AS (SELECT coalesce(spine.scheme_code, fund.scheme_code) AS scheme_code, CAST(sum(abs(coalesce(f, 0) - coalesce(b, 0))) AS DECIMAL(30,6)) * 0.5 AS x "
                    "FROM fund FULL JOIN spine ON fund.scheme_code = spine.scheme_code AND fund.company_id = spine.company_id GROUP BY 1) "
                    "SELECT scheme_code, scheme_name, category, benchmark, CAST(round(CAST(x AS DECIMAL(18,6)), 2) AS DOUBLE) AS active_share_pct, ter_regular_pct, ter_direct_pct, "
                    "x < 40 AS closet_index_flag FROM diff JOIN schemes USING (scheme_code)",
    "style_drift": "WITH {equity}, {companies} " + _drift("companies ON company_id = isin"),
    "style_drift_asof": "WITH {equity}, {companies}, lists AS (SELECT isin, DATE '1990-01-01' AS valid_from, DATE '1998-07-01' AS valid_to, cap_bucket FROM companies "
                        "UNION ALL SELECT isin, DATE '1998-07-01', DATE '9999-01-01', CASE WHEN cap_bucket = 'large' AND CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) % 2 = 0 THEN 'mid' ELSE cap_bucket END FROM companies) "
                        + _drift("lists ON company_id = isin AND valid_from <= disclosure_month AND disclosure_month < valid_to"),
    "turnover_lag": "WITH {equity}, d AS (SELECT scheme_code, disclosure_month, abs(weight_pct - lag(weight_pct) OVER (PARTITION BY scheme_code, company_id ORDER BY disclosure_month)) AS d FROM equity) "
                    "SELECT scheme_code, disclosure_month, " + _two("sum(d) * 6") + " AS inferred_turnover_pct FROM d WHERE d IS NOT NULL GROUP BY ALL",
    "turnover_full": "WITH {equity}" + _TURNOVER_FULL,
    "crowding": "WITH {crowd} SELECT company_id, isin, company_name, cap_bucket, free_float_shares_cr, CAST(v AS DOUBLE) AS value_cr, CAST(round(v, 1) AS DOUBLE) AS mf_holding_cr FROM crowd",
    "dtl": "WITH {dtl} SELECT * FROM dtl",
    "dtl_topn": "WITH {dtl} SELECT * FROM dtl ORDER BY days_to_liquidate DESC NULLS LAST, isin LIMIT 25",
    "fee_drag_grid": "WITH {schemes}, g AS (SELECT scheme_code, ter_direct_pct, ter_regular_pct, CAST(c AS DOUBLE) AS contribution, y AS years, CAST(g AS DOUBLE) AS gross, c * y * 12 AS invested, "
                     "(g - ter_direct_pct) / CAST(100 AS DOUBLE) / CAST(12 AS DOUBLE) AS ra, (g - ter_regular_pct) / CAST(100 AS DOUBLE) / CAST(12 AS DOUBLE) AS rb "
                     "FROM schemes, (VALUES (5000), (10000)) a(c), (VALUES (10), (20)) b(y), (VALUES (CAST(8 AS DOUBLE)), (10), (12)) d(g)), "
                     "f AS (SELECT *, CASE WHEN ra = 0 THEN invested ELSE contribution * ((pow(1 + ra, years * 12) - 1) / ra) END AS a, "
                     "CASE WHEN rb = 0 THEN invested ELSE contribution * ((pow(1 + rb, years * 12) - 1) / rb) END AS b FROM g) "
                     "SELECT scheme_code, contribution, CAST(years AS INT) AS years, gross AS gross_return_pct, CAST(invested AS DOUBLE) AS invested, ter_direct_pct, ter_regular_pct, "
                     "CAST(round(CAST(a AS DECIMAL(24,6)), 2) AS DOUBLE) AS terminal_value_direct, CAST(round(CAST(b AS DECIMAL(24,6)), 2) AS DOUBLE) AS terminal_value_regular, "
                     "CAST(round(CAST(a - b AS DECIMAL(24,6)), 2) AS DOUBLE) AS difference FROM f",
    "key_skew": "WITH {holdings} SELECT company_id, count(*) AS rows FROM holdings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "portfolio_valid": "WITH {holdings}, {positions}, known AS (SELECT DISTINCT scheme_code FROM holdings WHERE disclosure_month = (SELECT max(disclosure_month) FROM holdings)) "
                       "SELECT portfolio_id, coalesce(CAST(sum(v) FILTER (k.scheme_code IS NOT NULL AND v > 0) AS DOUBLE), 0) AS total_value, count(k.scheme_code) FILTER (v > 0) AS fund_count, "
                       "count(k.scheme_code) FILTER (v > 0) > 0 AS valid FROM positions LEFT JOIN known k USING (scheme_code) GROUP BY 1",
    "look_through": "WITH {look} SELECT * FROM look_through",
    "concentration": "WITH {look} " + _concentration("look_through"),
    "xray_top": "WITH {look} SELECT portfolio_id, CAST(row_number() OVER (PARTITION BY portfolio_id ORDER BY weight_pct DESC, company_id) AS INT) AS rank, company_id, instrument_name_raw, "
                + _two("weight_pct") + " AS weight_pct, CAST(round(CAST(value AS DECIMAL(18,6)), 0) AS DOUBLE) AS value FROM look_through WHERE asset_class = 'equity' "
                "QUALIFY row_number() OVER (PARTITION BY portfolio_id ORDER BY look_through.weight_pct DESC, company_id) <= 15",
    "xray_sectors": "WITH {look}, {companies}, e AS (SELECT portfolio_id, CAST(weight_pct AS DECIMAL(18,10)) AS w, sector, cap_bucket FROM look_through JOIN companies ON company_id = isin WHERE asset_class = 'equity') "
                    "SELECT portfolio_id, 'sector' AS kind, sector AS name, " + _two("sum(w)") + " AS weight_pct FROM e WHERE sector IS NOT NULL GROUP BY ALL "
                    "UNION ALL SELECT portfolio_id, 'cap_bucket', cap_bucket, " + _two("sum(w)") + " FROM e WHERE cap_bucket IS NOT NULL GROUP BY ALL",
    "xray_overlaps": "WITH {equity}, {schemes}, {positions}, p AS (" + _PAIRS.format(by="", source="latest") + ") "
                     "SELECT a.portfolio_id, a.scheme_code AS scheme_a, b.scheme_code AS scheme_b, coalesce(" + _two("overlap_pct") + ", 0) AS overlap_pct, "
                     "na.scheme_name AS scheme_a_name, nb.scheme_name AS scheme_b_name FROM positions a JOIN positions b ON a.portfolio_id = b.portfolio_id AND a.scheme_code < b.scheme_code "
                     "LEFT JOIN p ON s1 = a.scheme_code AND s2 = b.scheme_code LEFT JOIN schemes na ON na.scheme_code = a.scheme_code LEFT JOIN schemes nb ON nb.scheme_code = b.scheme_code "
                     "WHERE a.v > 0 AND b.v > 0",
    "weighted_ter": "WITH {positions}, {schemes}, g AS (SELECT portfolio_id, CAST(sum(v) AS DOUBLE) AS total, sum(v * CAST(ter_regular_pct AS DECIMAL(9,4))) AS r, sum(v * CAST(ter_direct_pct AS DECIMAL(9,4))) AS d "
                    "FROM positions JOIN schemes USING (scheme_code) GROUP BY 1) SELECT portfolio_id, total AS total_value, "
                    "CAST(round(CAST(CAST(r AS DOUBLE) / total AS DECIMAL(18,10)), 3) AS DOUBLE) AS weighted_ter_regular_pct, CAST(round(CAST(CAST(d AS DOUBLE) / total AS DECIMAL(18,10)), 3) AS DOUBLE) AS weighted_ter_direct_pct, "
                    "CAST(round(r * 0.01, 0) AS DOUBLE) AS annual_fee_regular, CAST(round(d * 0.01, 0) AS DOUBLE) AS annual_fee_direct FROM g",
    "direct_xray": "WITH {trades}, {direct} " + _concentration("direct_weights"),
    "direct_totals": "WITH {trades}, {direct}, g AS (SELECT portfolio_id, sum(v) AS v, sum(c) AS c FROM direct_values GROUP BY 1) SELECT portfolio_id, CAST(v AS DOUBLE) AS total_value, "
                     "CAST(c AS DOUBLE) AS total_invested, CAST(v - c AS DOUBLE) AS total_pnl, " + _two("CAST(v - c AS DOUBLE) * 100 / nullif(CAST(c AS DOUBLE), 0)") + " AS total_pnl_pct FROM g",
    "direct_crowding": "WITH {dtl}, {direct} SELECT DISTINCT isin, portfolio_id, company_name, days_to_liquidate, mf_pct_of_free_float FROM (SELECT portfolio_id, company_id AS isin FROM direct_weights) JOIN dtl USING (isin)",
    "adv_30": "WITH {trades}, {candles} SELECT isin, CAST(sum(vol) AS DOUBLE) / count(vol) AS adv_shares_30d FROM (SELECT * FROM candles QUALIFY row_number() OVER (PARTITION BY isin ORDER BY ts DESC) <= 30) GROUP BY 1",
    "price_refresh": "WITH {trades}, {candles}, {companies}, t AS (SELECT upper(p_brand || '_' || p_type) AS nse_symbol, min(CAST(p_partkey AS VARCHAR)) AS smartapi_token "
                     "FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 7 <> 0 GROUP BY 1), "
                     "a AS (SELECT isin, CAST(sum(vol) AS DOUBLE) / count(vol) AS adv_shares_30d, arg_max(close, ts) AS close FROM (SELECT * FROM candles QUALIFY row_number() OVER (PARTITION BY isin ORDER BY ts DESC) <= 30) GROUP BY 1) "
                     "SELECT isin, nse_symbol, smartapi_token, close, adv_shares_30d, 'candles' AS source FROM companies JOIN t USING (nse_symbol) JOIN a USING (isin)",
    "volatility": "WITH {trades}, {candles} SELECT isin, round(volatility_pct, 6) AS volatility_pct FROM vols",
    "beta": "WITH {trades}, {candles} SELECT isin, round(beta, 6) AS beta FROM betas",
    "max_drawdown": "WITH {trades}, {candles} SELECT isin, round(max_drawdown_pct, 6) AS max_drawdown_pct FROM drawdowns",
    "portfolio_risk": "WITH {look}, {candles}, j AS (SELECT portfolio_id, CAST(weight_pct AS DECIMAL(18,10)) AS w, volatility_pct AS v, max_drawdown_pct AS m, beta FROM look_through l "
                      "LEFT JOIN vols ON l.company_id = vols.isin LEFT JOIN drawdowns d ON l.company_id = d.isin LEFT JOIN betas ON l.company_id = betas.isin WHERE asset_class = 'equity') "
                      "SELECT portfolio_id, coalesce(" + _two("CAST(sum(w) FILTER (v IS NOT NULL) AS DOUBLE) * 100 / CAST(sum(w) AS DOUBLE)") + ", 0) AS coverage_pct, "
                      + _two("sum(CAST(w AS DOUBLE) * v) / CAST(sum(w) FILTER (v IS NOT NULL) AS DOUBLE)") + " AS weighted_volatility_pct, "
                      + _two("sum(CAST(w AS DOUBLE) * m) FILTER (v IS NOT NULL) / CAST(sum(w) FILTER (v IS NOT NULL) AS DOUBLE)") + " AS weighted_max_drawdown_pct, "
                      "CAST(round(CAST(sum(CAST(w AS DOUBLE) * beta) FILTER (v IS NOT NULL) / CAST(sum(w) FILTER (v IS NOT NULL AND beta IS NOT NULL) AS DOUBLE) AS DECIMAL(18,6)), 3) AS DOUBLE) AS weighted_beta, "
                      "count(v) AS constituents_priced FROM j GROUP BY 1",
    "dq_weights": "WITH {filed} SELECT scheme_code, disclosure_month, CAST(t AS DOUBLE) AS total_weight, CAST(off AS DOUBLE) AS deviation, passed FROM judged",
    "dq_resolution": "WITH {filed} " + _GATES["resolution"],
    "dq_duplicates": "WITH {filed} " + _GATES["duplicates"],
    "dq_freshness": "WITH {filed} " + _GATES["freshness"],
    "dq_free_float": "WITH {dtl} " + _GATES["free_float"],
    "dq_report": "WITH {filed}, {dtl_rest} " + " UNION ALL ".join(_GATES[g] for g in ("weights", "resolution", "duplicates", "freshness", "free_float")),
    "promotion_gate": "WITH {filed} SELECT scheme_code, disclosure_month, CASE WHEN passed THEN 'publish' ELSE 'quarantine' END AS gate, count(*) AS rows FROM filed JOIN judged USING (scheme_code, disclosure_month) GROUP BY ALL",
    "meta": "SELECT CAST(date_trunc('month', max(l_shipdate)) AS DATE) AS disclosure_month, DATE '2001-12-01' AS built_at, CAST(0.2 AS DOUBLE) AS participation_rate FROM lineitem JOIN part ON l_partkey = p_partkey",
    "tick_good": "WITH {ticks} SELECT event_id, isin, token, ltp, seq, event_time FROM ticks UNION ALL SELECT event_id, isin, token, ltp, seq, event_time FROM ticks WHERE seq % 20 = 0",
    "tick_dlq": "WITH {ticks} SELECT '{{\"isin\":\"' || isin || '\",\"ltp\":\"NOT_A_NUMBER\",\"seq\":' || seq || '}}' AS json FROM ticks WHERE seq % 50 = 0",
    "tick_dedup": "WITH {ticks} SELECT event_id, isin, token, ltp, seq, event_time FROM ticks",
    "recovery_diff": "WITH {ticks}, t AS (SELECT seq, CAST(substr(event_id, 2) AS BIGINT) AS n FROM ticks) SELECT count(*) FILTER (n % 13 <> 0) AS total_rows, "
                     "count(*) FILTER (n % 13 <> 0) AS distinct_ids, count(*) FILTER (n % 11 <> 0) AS expected_ids, CAST(0 AS BIGINT) AS duplicates, "
                     "count(*) FILTER (n % 11 <> 0 AND n % 13 = 0) AS missing, count(*) FILTER (n % 11 = 0 AND n % 13 <> 0) AS unexpected, "
                     "count(*) FILTER (seq % 50 = 0) AS dead_letters FROM t",
    "live_mark": "WITH {look}, {prices}, {ticks}, newest AS (SELECT isin, arg_max(ltp, ts) AS ltp FROM ticks GROUP BY 1) SELECT portfolio_id, company_id, asset_class, value, n.ltp, "
                 "value * coalesce(n.ltp / nullif(close, 0), 1) AS live_value FROM look_through LEFT JOIN (newest n JOIN prices p ON n.isin = p.isin) ON company_id = n.isin",
}

# The report joins two pieces that both start from the holdings.
PIECES["dtl_rest"] = PIECES["dtl"].split(PIECES["holdings"] + ", ", 1)[1]

_ORACLE["silver_promoted"] = (
    "WITH s AS (" + _ORACLE["silver_refile"] + "), ok AS (SELECT scheme_code, disclosure_month FROM s GROUP BY ALL "
    "HAVING abs(coalesce(sum(CAST(weight_pct AS DECIMAL(18,6))), 0) - 100) <= 0.5) SELECT s.* FROM s JOIN ok USING (scheme_code, disclosure_month)")

# Links to files: the pages of the query, and the pattern with the endings.
_ORACLE["file_links"] = (
    _ORACLE["page_links"].replace("(?i)href=[\"'']([^\"'']+)[\"'']", "(?i)href=[\"'']([^\"'']+\\.(?:xlsx|xls|csv|zip|pdf))[\"'']").replace(
        "FROM pages)", "FROM (SELECT page_id, url, regexp_replace(html, '(href=[\"''][^\"'']*t)([\"''])', '\\1.XLSX\\2', 'g') AS html FROM pages))"))

ORACLE = {name: sql.format(**PIECES) for name, sql in _ORACLE.items()}
