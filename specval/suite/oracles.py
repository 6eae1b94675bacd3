"""The registered queries as SQL over the given tables."""

from __future__ import annotations

from specval import config as C
from specval.fixtures import ITEM_FEATURES, ITEM_FLAGS, PLANS_SQL, PRICED_ITEMS_SQL
from specval.suite.inputs import GIVEN_INTERCEPT, GIVEN_RATES
from specval.suite.queries import B_COLUMNS, BREAKS, CORE, FIVE, TWO_PLAN

CONTINUOUS = C.continuous(C.BASIC_FEATURES, C.UNLIMITED_FLAGS)
PLAN_VIEW = "id, plan_name, network, basic_data, CAST(daily_data AS VARCHAR) AS daily_data, voice, agreement, fee, original_fee"
ITEM_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def r(expr: str, name: str | None = None, digits: int = 4) -> str:
    return f"ROUND({expr}, {digits}) + 0.0 AS {name or expr}"


def rs(names, digits: int = 4) -> str:
    return ", ".join(r(n, digits=digits) for n in names)


# --- shared tables ------------------------------------------------------------------------------------

PLANS = f"plans AS ({PLANS_SQL})"
ITEMS = f"items AS ({PRICED_ITEMS_SQL})"

DERIVED = f"""{PLANS},
typed AS (
  SELECT * REPLACE (COALESCE(TRY_CAST(basic_data AS DOUBLE), 0) AS basic_data),
    CASE WHEN network = '5G' THEN 1 ELSE 0 END AS is_5g,
    CASE WHEN data_exhaustion LIKE '%Mbps%' THEN COALESCE(TRY_CAST(TRIM(REPLACE(data_exhaustion, 'Mbps', '')) AS DOUBLE), 0) ELSE 0.0 END AS speed_when_exhausted,
    CASE WHEN CAST(voice AS VARCHAR) LIKE '%999%' THEN 1 ELSE 0 END AS voice_unlimited, CASE WHEN voice = -1 THEN 1 ELSE 0 END AS voice_na,
    CASE WHEN CAST(message AS VARCHAR) LIKE '%999%' THEN 1 ELSE 0 END AS message_unlimited, CASE WHEN message = -1 THEN 1 ELSE 0 END AS message_na,
    CASE WHEN usim_delivery_fee_status = 'UNSUPPORTED' THEN 0 ELSE 1 END AS usim_supported,
    CASE WHEN usim_delivery_fee_status IN ('FREE', 'FREE_ON_ACTIVATION') THEN 1 ELSE 0 END AS usim_is_free
  FROM plans),
quotas AS (
  SELECT *, CASE WHEN speed_when_exhausted > 0 THEN 1 ELSE 0 END AS has_throttled_data,
    CASE WHEN basic_data IN (999, 9999) THEN 1 ELSE 0 END AS basic_data_unlimited,
    CASE WHEN daily_data IN (999, 9999) THEN 1 ELSE 0 END AS daily_data_unlimited,
    CASE WHEN basic_data IN (999, 9999, -1) THEN 0 ELSE basic_data END AS basic_data_clean,
    CASE WHEN daily_data IS NULL OR daily_data IN (999, 9999, -1) THEN 0 ELSE daily_data END AS daily_data_clean,
    CASE WHEN voice_unlimited = 1 OR voice_na = 1 THEN 0.0 ELSE CAST(voice AS DOUBLE) END AS voice_clean,
    CASE WHEN message_unlimited = 1 OR message_na = 1 THEN 0.0 ELSE CAST(message AS DOUBLE) END AS message_clean
  FROM typed),
maxima AS (
  SELECT COALESCE(MAX(CASE WHEN basic_data NOT IN (999, 9999) THEN basic_data END), 100) AS max_basic_data,
    COALESCE(MAX(CASE WHEN daily_data NOT IN (999, 9999) THEN daily_data END), 10) AS max_daily_data FROM typed),
kinds AS (
  SELECT *, CASE WHEN daily_data_clean > 0 THEN 1 ELSE 0 END AS has_daily_allocation,
    CASE WHEN basic_data_unlimited = 1 THEN (SELECT max_basic_data FROM maxima) ELSE basic_data_clean + 30 * daily_data_clean END AS total_data,
    GREATEST(basic_data_unlimited, daily_data_unlimited) AS has_unlimited_data,
    CASE WHEN GREATEST(basic_data_unlimited, daily_data_unlimited) = 1 AND speed_when_exhausted = 0 THEN 1 ELSE 0 END AS has_unlimited_speed,
    GREATEST(basic_data_unlimited, daily_data_unlimited, has_throttled_data) AS any_unlimited_data
  FROM quotas),
typed_kinds AS (
  SELECT *, CASE WHEN has_unlimited_speed = 1 THEN 3 WHEN has_throttled_data = 1 THEN 2 WHEN has_unlimited_data = 1 THEN 1 ELSE 0 END AS unlimited_type_numeric
  FROM kinds),
derived AS (
  SELECT * REPLACE (CASE WHEN COALESCE(discount_period, -1) = 0 OR original_fee <= 0 THEN fee ELSE original_fee END AS original_fee),
    ['limited', 'unlimited_with_throttling', 'throttled_unlimited', 'unlimited_speed'][unlimited_type_numeric + 1] AS unlimited_type,
    CASE WHEN unlimited_type_numeric = 0 THEN 1 ELSE 0 END AS data_stops_after_quota,
    CASE WHEN unlimited_type_numeric = 2 THEN 1 ELSE 0 END AS data_throttled_after_quota,
    CASE WHEN unlimited_type_numeric = 3 THEN 1 ELSE 0 END AS data_unlimited_speed,
    CASE WHEN has_throttled_data = 1 THEN LEAST(speed_when_exhausted / 10, 1.0) WHEN has_unlimited_speed = 1 THEN 1.0 ELSE 0.0 END AS throttle_speed_normalized,
    CASE WHEN total_data > 0 AND any_unlimited_data = 0 THEN fee / total_data END AS price_per_gb,
    CASE unlimited_type_numeric WHEN 3 THEN fee * 0.7::DOUBLE WHEN 2 THEN fee * 0.8::DOUBLE WHEN 1 THEN fee * 0.9::DOUBLE END AS price_unlimited_adjusted,
    fee AS monthly_price, CASE WHEN agreement THEN 1 ELSE 0 END AS has_agreement
  FROM typed_kinds)"""

FEATURES = f"""{DERIVED},
features AS (
  SELECT * REPLACE (
    COALESCE(daily_data, (SELECT MEDIAN(daily_data) FROM derived)) AS daily_data,
    COALESCE(CAST(discount_period AS DOUBLE), (SELECT MEDIAN(discount_period) FROM derived)) AS discount_period,
    COALESCE(price_per_gb, (SELECT MEDIAN(price_per_gb) FROM derived)) AS price_per_gb,
    COALESCE(price_unlimited_adjusted, (SELECT MEDIAN(price_unlimited_adjusted) FROM derived)) AS price_unlimited_adjusted)
  FROM derived)"""


def long_rows(table: str, key: str, features, flags: dict[str, str], cost: str = "original_fee") -> str:
    """(key, feature, value, unlimited, cost) for every feature of every row."""
    return " UNION ALL ".join(
        f"SELECT {key}, '{f}' AS feature, CAST({f} AS DOUBLE) AS value, "
        + (f"{flags[f]} = 1" if f in flags else "FALSE") + f" AS unlimited, {cost} AS cost FROM {table}" for f in features)


def frontier(table: str, key: str, features, flags: dict[str, str]) -> str:
    """Candidates, kept points, and cheapest unlimited rows of a table."""
    return f"""
lng AS ({long_rows(table, key, features, flags)}),
per_cost AS (SELECT feature, cost, MAX(value) AS value FROM lng WHERE NOT unlimited AND cost IS NOT NULL GROUP BY feature, cost),
cands AS (SELECT feature, value, MIN(cost) AS cost FROM per_cost GROUP BY feature, value),
front AS (SELECT feature, value, cost FROM (
  SELECT *, MIN(cost - value) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM cands)
  WHERE later IS NULL OR cost - value <= later),
flat AS (SELECT feature, MIN(cost) AS cost FROM lng WHERE unlimited AND cost IS NOT NULL GROUP BY feature),
seg AS (SELECT feature, value AS x1, cost AS y1, LEAD(value) OVER w AS x2, LEAD(cost) OVER w AS y2, LAG(value) OVER w AS x0, LAG(cost) OVER w AS y0
  FROM front WINDOW w AS (PARTITION BY feature ORDER BY value))"""


PLAN_FRONTIER = f"{FEATURES},{frontier('features', 'id', CONTINUOUS, C.UNLIMITED_FLAGS)}"
CORE_FRONTIER = f"{FEATURES},{frontier('features', 'id', CORE, C.UNLIMITED_FLAGS)}"
ITEM_FRONTIER = f"{ITEMS},{frontier('items', ITEM_KEY, ITEM_FEATURES, ITEM_FLAGS)}"

CLAMPED = """CASE WHEN v <= x1 THEN y1 WHEN x2 IS NULL THEN y1 ELSE y1 + (v - x1) * (y2 - y1) / (x2 - x1) END"""
EXTENDED = """CASE WHEN v = x1 THEN y1
  WHEN x2 IS NOT NULL THEN y1 + (v - x1) * (y2 - y1) / (x2 - x1)
  WHEN x0 IS NOT NULL THEN y0 + (v - x0) * (y1 - y0) / (x1 - x0) ELSE y1 END"""
IN_SEGMENT = "((v >= x1 AND (x2 IS NULL OR v < x2)) OR (v < x1 AND x0 IS NULL))"

SCORED = f"""{PLAN_FRONTIER},
parts AS (
  SELECT l.id, l.feature, COALESCE(CASE WHEN l.unlimited THEN (SELECT f.cost FROM flat f WHERE f.feature = l.feature) ELSE {CLAMPED.replace('v ', 'l.value ').replace('(v', '(l.value')} END, 0) AS part
  FROM lng l LEFT JOIN seg s ON s.feature = l.feature AND {IN_SEGMENT.replace('v >', 'l.value >').replace('v <', 'l.value <')}),
bases AS (SELECT id, SUM(part) AS B FROM parts GROUP BY id),
scored AS (
  SELECT f.*, b.B, CASE WHEN f.fee <> 0 THEN b.B / f.fee WHEN b.B > 0 THEN CAST('Infinity' AS DOUBLE) WHEN b.B < 0 THEN CAST('-Infinity' AS DOUBLE) END AS CS
  FROM features f JOIN bases b USING (id))"""


def ratio_of(expr: str) -> str:
    return f"CASE WHEN fee <> 0 THEN {expr} / fee WHEN {expr} > 0 THEN CAST('Infinity' AS DOUBLE) WHEN {expr} < 0 THEN CAST('-Infinity' AS DOUBLE) END"


LINEAR = " + ".join([f"{GIVEN_INTERCEPT}::DOUBLE", *[f"{v}::DOUBLE * {f}" for f, v in GIVEN_RATES.items()]])
MULTI = " + ".join([
    f"{GIVEN_RATES[f]}::DOUBLE * "
    + (f"(CASE WHEN {C.UNLIMITED_FLAGS[f]} = 1 THEN 2 * (SELECT MAX({f}) FROM features) ELSE {f} END)" if f in C.UNLIMITED_FLAGS else f)
    for f in CONTINUOUS])

RANKED = "ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY CS DESC NULLS LAST, id) AS rank_number FROM scored)"


def levels(table_long: str = "lng") -> str:
    return f"levels AS (SELECT feature, value, MIN(cost) AS cost FROM {table_long} WHERE NOT unlimited AND cost IS NOT NULL GROUP BY feature, value)"


CORE_LEVELS = f"{FEATURES}, lng AS ({long_rows('features', 'id', CORE, C.UNLIMITED_FLAGS)}), {levels()}"
ITEM_LEVELS = f"{ITEMS}, lng AS ({long_rows('items', ITEM_KEY, ITEM_FEATURES, ITEM_FLAGS)}), {levels()}"

# change points: candidates first, then the minimum gap of three positions applied in order
CHAIN = """
placed AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY value) - 1 AS idx, COUNT(*) OVER (PARTITION BY feature) AS n FROM levels),
steps AS (
  SELECT *, (LEAD(cost) OVER w - cost) / (LEAD(value) OVER w - value) AS slope FROM placed WINDOW w AS (PARTITION BY feature ORDER BY value)),
means AS (
  SELECT *, (LAG(slope, 2) OVER w + LAG(slope, 1) OVER w) / 2 AS before, (slope + LEAD(slope, 1) OVER w) / 2 AS after
  FROM steps WINDOW w AS (PARTITION BY feature ORDER BY value)),
sharp AS (
  SELECT feature, idx FROM means WHERE n >= 6 AND idx >= 2 AND idx < n - 3 AND ABS(before) > 0 AND ABS(after - before) > 0.2::DOUBLE * ABS(before)),
kept AS (
  SELECT feature, MIN(idx) AS idx FROM sharp GROUP BY feature
  UNION ALL
  SELECT k.feature, (SELECT MIN(s.idx) FROM sharp s WHERE s.feature = k.feature AND s.idx >= k.idx + 3) AS idx
  FROM kept k WHERE EXISTS (SELECT 1 FROM sharp s WHERE s.feature = k.feature AND s.idx >= k.idx + 3)),
segmented AS (
  SELECT p.feature, p.value, p.cost, p.idx, (SELECT COUNT(*) FROM kept k WHERE k.feature = p.feature AND k.idx <= p.idx) AS segment FROM placed p),
lines AS (
  SELECT feature, segment, COUNT(*) AS points, MIN(value) AS start_feature, MAX(value) AS end_feature, ARG_MIN(cost, idx) AS start_cost,
    ARG_MAX(cost, idx) AS end_cost, REGR_SLOPE(cost, value) AS slope, REGR_INTERCEPT(cost, value) AS intercept
  FROM segmented GROUP BY feature, segment HAVING COUNT(*) >= 2),
simple AS (SELECT *, (end_cost - start_cost) / (end_feature - start_feature) AS ends FROM lines),
rated AS (
  SELECT *, points >= 3 AND ABS(ends) < 100000 AND ABS(slope) < 100000 AND ABS(slope - ends) / GREATEST(ABS(ends), 1.0) < 2 AS agree FROM simple),
robust AS (
  SELECT feature, segment, start_feature, end_feature, points AS data_points, start_cost, end_cost,
    CASE WHEN (CASE WHEN agree THEN slope ELSE ends END) < 0 THEN 0 WHEN (CASE WHEN agree THEN slope ELSE ends END) > 50000 THEN 10000
         ELSE (CASE WHEN agree THEN slope ELSE ends END) END AS marginal_rate,
    CASE WHEN agree THEN intercept ELSE start_cost - ends * start_feature END AS intercept
  FROM rated)"""

CHANGES = f"WITH RECURSIVE {CORE_LEVELS}, {CHAIN}"

GRANULAR = f"""{CORE_LEVELS},
kept AS (SELECT feature, value, cost FROM (
  SELECT *, MAX(cost) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM levels)
  WHERE highest IS NULL OR cost >= highest),
pairs AS (
  SELECT feature, ROW_NUMBER() OVER w - 1 AS segment_id, value AS start_feature, LEAD(value) OVER w AS end_feature, cost AS start_cost, LEAD(cost) OVER w AS end_cost
  FROM kept WINDOW w AS (PARTITION BY feature ORDER BY value)),
segments AS (SELECT *, (end_cost - start_cost) / (end_feature - start_feature) AS marginal_rate FROM pairs WHERE end_feature IS NOT NULL),
tops AS (SELECT feature, MAX(value) AS top FROM kept GROUP BY feature),
premiums AS (
  SELECT l.feature, AVG(cost) FILTER (unlimited) AS unlimited_avg_cost, AVG(cost) FILTER (NOT unlimited AND value >= 0.8::DOUBLE * top) AS limited_avg_cost,
    COUNT(cost) FILTER (unlimited) AS unlimited_count
  FROM lng l JOIN tops USING (feature) GROUP BY l.feature HAVING COUNT(cost) FILTER (unlimited) > 0)"""

FLAG_ROWS = ", ".join(f"('{f}', '{m}')" for f, m in C.UNLIMITED_FLAGS.items())
FLAGS_TABLE = f"flags AS (SELECT * FROM (VALUES {FLAG_ROWS}) AS t(feature, flag))"

ORACLES: dict[str, str] = {}

# --- A -------------------------------------------------------------------------------------------------
ORACLES["A1_tolerant_source"] = f"""WITH {PLANS} SELECT id, CAST(voice AS BIGINT) AS voice, id % 2 = 0 AS is_esim, 'c' || (id % 5) AS colour,
  CASE WHEN (id // 100) % 2 = 0 THEN 'frontier' ELSE 'fixed_rates' END AS method FROM plans"""
ORACLES["A1_batch_source"] = f"WITH {PLANS} SELECT {PLAN_VIEW}, 'frontier' AS method FROM plans"
SCENARIOS = """
part_base AS (SELECT * FROM part WHERE p_partkey = (SELECT MIN(p_partkey) FROM part)),
variants AS (
  SELECT CASE WHEN p.p_partkey = b.p_partkey THEN 'base' ELSE CAST(p.p_partkey AS VARCHAR) END AS id, p.p_name AS name,
    CASE WHEN p.p_partkey <> b.p_partkey AND p.p_partkey % 3 = 1 THEN 1.0::DOUBLE END AS extra, 17000.0::DOUBLE AS fee,
    CASE WHEN p.p_partkey % 3 = 1 THEN p.p_retailprice ELSE b.p_retailprice END AS price,
    CAST(CASE WHEN p.p_partkey % 3 = 0 THEN p.p_size ELSE b.p_size END AS DOUBLE) AS size
  FROM part p CROSS JOIN part_base b)"""
ORACLES["A2_variant_expansion"] = f"WITH {SCENARIOS} SELECT * FROM variants"
ORACLES["A2_variant_maps"] = f"""WITH {SCENARIOS} """ + " UNION ALL ".join(
    f"SELECT id, name, '{k}' AS feature, CAST({k} AS DOUBLE) AS value FROM variants WHERE {k} IS NOT NULL" for k in ("extra", "fee", "price", "size"))
ORACLES["C6_base_variants"] = ORACLES["A2_variant_expansion"]
ORACLES["A3_type_normalisation"] = """
SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS is_5g, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS has_usim,
  CASE WHEN p_size = 47 THEN 0.0 ELSE CAST(p_size AS DOUBLE) END AS basic_data_clean, p_retailprice AS fee, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END AS is_esim_numeric
FROM part"""
ORACLES["A4_csv_source"] = f"WITH {PLANS} SELECT id, plan_name, COALESCE(network, '0') AS network, COALESCE(daily_data, 0) AS daily_data, voice, fee FROM plans"
ORACLES["A5_format_dispatch"] = f"""WITH {PLANS}, {SCENARIOS}
SELECT 'csv' AS format, COUNT(*) AS n, SUM(fee) AS total FROM plans UNION ALL SELECT 'parquet', COUNT(*), SUM(fee) FROM plans
UNION ALL SELECT 'json', COUNT(*), SUM(size) FROM variants"""
ORACLES["A6_fill_missing"] = f"""WITH {PLANS} SELECT id, COALESCE(network, '0') AS network, COALESCE(daily_data, 0) AS daily_data,
  COALESCE(data_exhaustion, '0') AS data_exhaustion, COALESCE(agreement, FALSE) AS agreement, COALESCE(discount_period, 0) AS discount_period FROM plans"""
ORACLES["A7_raw_snapshot"] = f"WITH {PLANS} SELECT {PLAN_VIEW} FROM plans"
ORACLES["A8_processed_snapshot"] = f"WITH {FEATURES} SELECT id, {rs(['total_data', 'price_per_gb'])}, unlimited_type FROM features"
ORACLES["A9_ranking_store"] = f"WITH {SCORED}, {RANKED} SELECT id, rank_number, CAST(rank_number AS VARCHAR) AS rank_display, {rs(['B', 'CS'])} FROM ranked"
MARGINAL = f"""marginal AS (
  SELECT f.feature, CASE WHEN p.points IS NULL THEN NULL WHEN p.points = 1 THEN p.y1 ELSE (p.y2 - p.y1) / (p.x2 - p.x1) END AS coefficient,
    u.cost AS unlimited_cost, COALESCE(p.points, 0) AS points
  FROM (SELECT DISTINCT feature FROM lng) f
  LEFT JOIN (SELECT feature, ARG_MIN(y1, x1) AS y1, MIN(x1) AS x1, ARG_MIN(y2, x1) AS y2, ARG_MIN(x2, x1) AS x2, COUNT(*) AS points FROM seg GROUP BY feature) p USING (feature)
  LEFT JOIN flat u USING (feature))"""
ORACLES["A10_stored_cost_structure"] = f"WITH {PLAN_FRONTIER}, {MARGINAL} SELECT feature, {rs(['coefficient', 'unlimited_cost'])}, points FROM marginal"
ORACLES["A11_run_metadata"] = "SELECT 'frontier' AS method, TRUE AS has_data, COUNT(*) AS num_plans, TRUE AS has_charts FROM part"
SAFE_CS = "COALESCE(CASE WHEN isinf(CS) THEN 1.7976931348623157e308 ELSE CS END, 0)"
ORACLES["A12_response"] = f"""WITH {SCORED}, {RANKED} SELECT id, plan_name, mvno, {rs(['fee', 'original_fee'])}, rank_number AS rank, {r('B')},
  CASE WHEN isinf(CS) THEN 1.7976931348623157e308 ELSE ROUND(COALESCE(CS, 0), 4) + 0.0 END AS CS,
  CASE WHEN isinf(CS) THEN 1.7976931348623157e308 ELSE ROUND(COALESCE(CS, 0), 4) + 0.0 END AS value_ratio FROM ranked"""

# --- B -------------------------------------------------------------------------------------------------
DOUBLES = {"basic_data", "daily_data", "tethering_gb", "speed_when_exhausted", "basic_data_clean", "daily_data_clean", "total_data", "throttle_speed_normalized",
           "voice_clean", "message_clean", "price_per_gb", "price_unlimited_adjusted", "monthly_price", "original_fee"}
for _name, _columns in B_COLUMNS.items():
    ORACLES[_name] = f"WITH {DERIVED} SELECT id, " + ", ".join(r(c, digits=6) if c in DOUBLES else c for c in _columns) + " FROM derived"
ORACLES["B5_finite_maxima"] = f"WITH {DERIVED} SELECT * FROM maxima"
ORACLES["B12_boolean_flags"] = """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS data_sharing_numeric,
  CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS roaming_support_numeric, CASE WHEN p_partkey % 7 > 0 AND p_size > 25 THEN 1 ELSE 0 END AS is_esim_numeric FROM part"""
ORACLES["B18_median_imputation"] = f"WITH {FEATURES} SELECT id, {rs(['daily_data', 'discount_period', 'price_per_gb', 'price_unlimited_adjusted'], 6)} FROM features"
ORACLES["B19_key_statistics"] = f"WITH {FEATURES} " + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, ROUND(MIN({f})::DOUBLE, 4) + 0.0 AS min, ROUND(MAX({f})::DOUBLE, 4) + 0.0 AS max, ROUND(AVG({f}), 4) + 0.0 AS mean, ROUND(MEDIAN({f}), 4) + 0.0 AS median FROM features"
    for f in C.KEY_FEATURES)
ORACLES["B20_feature_selection"] = f"WITH {FEATURES} SELECT id, {rs(['basic_data_clean', 'voice_clean'])}, is_5g, basic_data_unlimited, voice_unlimited FROM features"
ORACLES["B21_upstream_columns"] = """SELECT p_partkey AS id,
  ROUND(CASE WHEN p_partkey % 9 = 0 THEN 0.0 WHEN p_partkey % 2 = 0 THEN p_size * 100 / 1000.0::DOUBLE ELSE CAST(p_size * 100 AS DOUBLE) END, 4) + 0.0 AS tethering_gb,
  CASE WHEN p_partkey % 10 > 0 THEN ROUND((1 - CAST(p_size * 100 AS DOUBLE) / ((p_partkey % 10) * 500)) * 100, 4) + 0.0 END AS discount_percentage FROM part"""

# --- C -------------------------------------------------------------------------------------------------
BETTER = " AND ".join(f"o.{f} >= v.{f}" for f in ITEM_FEATURES)
STRICT = " OR ".join(f"o.{f} > v.{f}" for f in ITEM_FEATURES)
# only the cheapest row of a feature vector can be efficient, which keeps the anti-join small on the whole table
EFFICIENT = f"""{ITEMS},
vectors AS (SELECT {', '.join(ITEM_FEATURES)}, MIN(original_fee) AS original_fee FROM items GROUP BY {', '.join(ITEM_FEATURES)}),
best AS (SELECT * FROM vectors v WHERE NOT EXISTS (
  SELECT 1 FROM vectors o WHERE {BETTER} AND o.original_fee <= v.original_fee AND ({STRICT} OR o.original_fee < v.original_fee))),
efficient AS (SELECT i.* FROM items i SEMI JOIN best USING ({', '.join(ITEM_FEATURES)}, original_fee))"""
ORACLES["C1_efficient_rows"] = f"WITH {EFFICIENT} SELECT {ITEM_KEY}, {', '.join(ITEM_FEATURES)}, original_fee FROM efficient"
ORACLES["C1_efficient_rows_five_features"] = f"""WITH items AS (SELECT {ITEM_KEY}, {', '.join(f'{e} AS {f}' for f, e in FIVE.items())}, l_extendedprice AS price FROM lineitem),
vectors AS (SELECT {', '.join(FIVE)}, MIN(price) AS price FROM items GROUP BY ALL),
best AS (SELECT * FROM vectors v WHERE NOT EXISTS (SELECT 1 FROM vectors o WHERE {' AND '.join(f'o.{f} >= v.{f}' for f in FIVE)} AND o.price <= v.price
  AND (o.price < v.price OR {' OR '.join(f'o.{f} > v.{f}' for f in FIVE)})))
SELECT i.* FROM items i SEMI JOIN best USING ({', '.join(FIVE)}, price)"""
ORACLES["C1_efficiency_ratio"] = f"""WITH {EFFICIENT} SELECT (SELECT COUNT(*) FROM items) AS complete_rows, COUNT(*) AS efficient_rows,
  ROUND(COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM items), 8) + 0.0 AS efficiency_ratio FROM efficient"""


def _curve_query(shift: str, formula: str) -> str:
    # priced once per distinct value, then joined back
    costs = ", ".join(
        f"c{i} AS (SELECT d.{f}, {formula} AS cost FROM (SELECT DISTINCT {f}, {f} * {shift}::DOUBLE AS v FROM items) d JOIN seg ON seg.feature = '{f}' AND {IN_SEGMENT})"
        for i, f in enumerate(ITEM_FEATURES))
    joins = " ".join(f"LEFT JOIN c{i} USING ({f})" for i, f in enumerate(ITEM_FEATURES))
    return (f"WITH {ITEM_FRONTIER}, {costs} SELECT {ITEM_KEY}, {rs(ITEM_FEATURES)}, "
            + ", ".join(r(f"c{i}.cost", f"cost_{f}") for i, f in enumerate(ITEM_FEATURES)) + f" FROM items {joins}")


ORACLES["C2_interpolation"] = _curve_query("1.07", CLAMPED)
ORACLES["C3_extrapolation"] = _curve_query("1.3", f"CASE WHEN v < x1 AND x2 IS NOT NULL THEN y1 + (v - x1) * (y2 - y1) / (x2 - x1) ELSE {EXTENDED} END")
_on = {f: f"EXISTS (SELECT 1 FROM front WHERE front.feature = '{f}' AND front.value = i.{f} AND front.cost = i.original_fee)"
       + (f" AND {ITEM_FLAGS[f]} = 0" if f in ITEM_FLAGS else "") for f in ITEM_FEATURES}
ORACLES["C4_frontier_semi_join"] = f"""WITH {ITEM_FRONTIER}, marked AS (SELECT {ITEM_KEY}, original_fee, {', '.join(f'({e}) AS on_{f}' for f, e in _on.items())} FROM items i)
SELECT * FROM marked WHERE {' OR '.join(f'on_{f}' for f in ITEM_FEATURES)}"""
for _name in ("C2_interpolation", "C3_extrapolation", "C4_frontier_semi_join"):
    ORACLES[f"{_name}_joined"] = ORACLES[_name]
ORACLES["C5_method_columns"] = f"""WITH {SCORED}, multi AS (SELECT *, {MULTI} AS bm FROM scored)
SELECT id, {r('bm', 'B')}, {r(ratio_of('bm'), 'CS')}, {r('B', 'B_frontier')}, {r('CS', 'CS_frontier')} FROM multi"""

# --- D -------------------------------------------------------------------------------------------------
ORACLES["D1_frontier_candidates"] = f"WITH {ITEM_FRONTIER} SELECT * FROM cands"
ORACLES["D2_cheapest_unlimited"] = f"WITH {ITEM_FRONTIER} SELECT 'quantity_unlimited' AS feature, cost FROM flat"
ORACLES["D3_cheapest_unlimited_named"] = f"""WITH {PLAN_FRONTIER}, {FLAGS_TABLE},
firsts AS (SELECT feature, MIN(cost) AS min_cost, ARG_MIN(id, (cost, id)) AS id, COUNT(*) AS plan_count FROM lng WHERE unlimited AND cost IS NOT NULL GROUP BY feature)
SELECT feature, flag, min_cost, id, plan_name, plan_count FROM firsts JOIN flags USING (feature) JOIN features USING (id)"""
ORACLES["D4_level_table"] = f"""WITH {ITEM_FRONTIER} SELECT feature, {r('value')}, {r('MIN(cost)', 'min_cost')}, {r('AVG(cost)', 'avg_cost')}, COUNT(*) AS plan_count
FROM lng WHERE NOT unlimited AND cost IS NOT NULL GROUP BY feature, value"""
ORACLES["D5_min_increment"] = f"""WITH {ITEM_FRONTIER} SELECT feature, {r('COALESCE(MIN(step), 1.0)', 'min_increment', 8)} FROM (
  SELECT feature, value - LAG(value) OVER (PARTITION BY feature ORDER BY value) AS step FROM (SELECT DISTINCT feature, value FROM lng)) GROUP BY feature"""
ORACLES["D6_ranking_statistics"] = f"""WITH {SCORED} SELECT COUNT(*) AS total_plans, {r('AVG(CS)', 'avg_ratio')}, COUNT(*) FILTER (CS >= 1) AS good_value_count,
  COUNT(*) FILTER (CS < 1) AS poor_value_count, ARG_MIN(plan_name, (CS IS NULL, -CS, id)) AS best_value_plan, ARG_MAX(plan_name, (CS IS NULL, -CS, id)) AS worst_value_plan FROM scored"""
ORACLES["D7_ratio_summary"] = f"""WITH {SCORED} SELECT COUNT(*) AS total_plans, {r('AVG(CS)', 'avg_cs')}, COUNT(*) FILTER (CS >= 1) AS high_cs_count, COUNT(*) FILTER (CS < 1) AS low_cs_count,
  {r('COUNT(*) FILTER (CS >= 1)::DOUBLE / COUNT(*)', 'high_cs_pct')}, {r('COUNT(*) FILTER (CS < 1)::DOUBLE / COUNT(*)', 'low_cs_pct')} FROM scored"""
KEPT = f"""{ITEMS}, moments AS (SELECT AVG(original_fee) AS m, STDDEV_SAMP(original_fee) AS s FROM items),
kept AS (SELECT items.* FROM items, moments WHERE ABS((original_fee - m) / s) <= 2)"""
ORACLES["D8_outlier_filter"] = f"WITH {KEPT} SELECT {ITEM_KEY}, original_fee FROM kept"
ORACLES["D8_outlier_counts"] = f"WITH {KEPT} SELECT (SELECT COUNT(*) FROM items) AS total_rows, COUNT(*) AS kept_rows, (SELECT COUNT(*) FROM items) - COUNT(*) AS outliers_removed FROM kept"
_names = [*ITEM_FEATURES, "original_fee"]
_pairs = [("1", "1"), *[("1", c) for c in _names], *[(a, b) for i, a in enumerate(_names) for b in _names[i:]]]
ORACLES["D9_sufficient_statistics"] = f"WITH {ITEMS} " + " UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, ROUND(CAST(SUM(CAST({a} AS DOUBLE) * {b}) AS DOUBLE), {-3 if a == b == 'original_fee' else 0}) + 0.0 AS sum_product FROM items" for a, b in _pairs)
_basic_pairs = [(a, b) for i, a in enumerate(C.BASIC_FEATURES) for b in C.BASIC_FEATURES[i + 1:]]
_corr = " UNION ALL ".join(f"SELECT '{a}' AS f1, '{b}' AS f2, CORR({a}, {b}) AS corr FROM features" for a, b in _basic_pairs)
ORACLES["D10_correlations"] = f"WITH {FEATURES}, c AS ({_corr}) SELECT f1, f2, {r('CASE WHEN isnan(corr) THEN NULL ELSE corr END', 'corr', 8)} FROM c"
ORACLES["D10_high_correlations"] = f"WITH {FEATURES}, c AS ({_corr}) SELECT f1, f2, {r('corr', digits=8)} FROM c WHERE ABS(corr) > 0.8 AND NOT isnan(corr)"
ORACLES["D11_breakpoints"] = f"WITH {FEATURES}, q AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, QUANTILE_CONT({f}::DOUBLE, 0.33) AS a, QUANTILE_CONT({f}::DOUBLE, 0.67) AS b, (MAX({f}) - MIN({f})) * 0.1::DOUBLE AS gap, COUNT(DISTINCT {f}) AS n FROM features" for f in CORE
) + f""") SELECT feature, 0 AS position, {r('a', 'breakpoint', 6)} FROM q WHERE n >= 3 UNION ALL SELECT feature, 1, {r('b', 'breakpoint', 6)} FROM q WHERE n >= 3 AND ABS(b - a) > gap"""
ORACLES["D12_feature_profile"] = f"""WITH {ITEM_FRONTIER} SELECT feature, COUNT(*) AS total_plans, COUNT(DISTINCT value) AS unique_values, {r('MIN(value)', 'min_value')},
  {r('MAX(value)', 'max_value')}, {r('AVG(value)', 'avg_value')} FROM lng GROUP BY feature"""
ORACLES["D13_diagonal_range"] = f"WITH {SCORED} SELECT {r('LEAST(MIN(B), MIN(fee))', 'min_value')}, {r('GREATEST(MAX(B), MAX(fee))', 'max_value')} FROM scored"
_plan_columns = ["id", "plan_name", "mvno", "mno", "network", "basic_data", "daily_data", "data_exhaustion", "voice", "message", "additional_call", "tethering_gb",
                 "agreement", "usim_delivery_fee_status", "discount_period", "original_fee", "fee"]
ORACLES["D14_column_profile"] = f"WITH {PLANS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count, COUNT(DISTINCT {c}) AS unique_count FROM plans" for c in _plan_columns)
_on_plan = " OR ".join(
    f"(EXISTS (SELECT 1 FROM front WHERE front.feature = '{f}' AND front.value = p.{f} AND front.cost = p.original_fee)"
    + (f" AND {C.UNLIMITED_FLAGS[f]} = 0" if f in C.UNLIMITED_FLAGS else "") + ")" for f in CONTINUOUS)
FRONTIER_ROWS = f"""{PLAN_FRONTIER},
chosen AS (SELECT ARG_MIN(id, (cost, id)) AS id FROM lng WHERE unlimited AND cost IS NOT NULL GROUP BY feature),
frows AS (SELECT p.* FROM features p WHERE {_on_plan} OR p.id IN (SELECT id FROM chosen))"""
ORACLES["D15_frontier_summary"] = f"WITH {FRONTIER_ROWS} SELECT feature, COUNT(*) AS frontier_points, (SELECT COUNT(*) FROM frows) AS total_frontier_rows FROM front GROUP BY feature"

# --- E -------------------------------------------------------------------------------------------------
ORACLES["E1_monotone_frontier"] = f"WITH {ITEM_FRONTIER} SELECT * FROM front"
ORACLES["E2_rank_by_cs"] = f"WITH {SCORED}, {RANKED} SELECT id, {r('CS')}, rank_number, CAST(rank_number AS VARCHAR) AS rank_display FROM ranked"
ORACLES["E3_rank_with_ties"] = f"""WITH {SCORED}, coarse AS (SELECT id, ROUND(CS, 1) + 0.0 AS CS FROM scored),
t AS (SELECT *, RANK() OVER (ORDER BY CS DESC NULLS LAST) AS ranking, COUNT(*) OVER (PARTITION BY CS) AS ties FROM coarse)
SELECT id, {r('CS')}, ranking, CASE WHEN ties > 1 THEN '공동 ' ELSE '' END || ranking || '위' AS display_ranking FROM t"""
ORACLES["E4_top_k"] = f"WITH {SCORED}, {RANKED} SELECT id, {r('CS')}, rank_number FROM ranked WHERE rank_number <= 50"
ORACLES["E5_change_points"] = f"{CHANGES} SELECT feature, idx, value, cost FROM kept JOIN placed USING (feature, idx)"
ORACLES["E6_running_max_filter"] = f"""WITH {ITEM_LEVELS} SELECT feature, value, cost FROM (
  SELECT *, MAX(cost) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM levels) WHERE highest IS NULL OR cost >= highest"""
_rate_rows = ", ".join(f"('{f}', {GIVEN_RATES[f]}::DOUBLE)" for f in CORE)
PLAUSIBLE = f"""rates AS (SELECT * FROM (VALUES {_rate_rows}) AS t(feature, rate)),
plausible AS (
  SELECT feature, MIN(value) AS value, ARG_MIN(cost, value) AS cost FROM LEVELS_OF GROUP BY feature
  UNION ALL
  SELECT n.feature, n.value, n.cost FROM (
    SELECT l.feature, l.value, l.cost, ROW_NUMBER() OVER (PARTITION BY l.feature ORDER BY l.value) AS rn
    FROM plausible k JOIN LEVELS_OF l ON l.feature = k.feature AND l.value > k.value JOIN rates t ON t.feature = k.feature
    WHERE NOT (l.cost < k.cost * 0.8::DOUBLE) AND NOT ((l.cost - k.cost) / (l.value - k.value) > 10 * t.rate)) n WHERE rn = 1)"""
ORACLES["E7_light_outlier_filter"] = f"WITH RECURSIVE {CORE_LEVELS}, {PLAUSIBLE.replace('LEVELS_OF', 'levels')} SELECT feature, value, cost FROM plausible"
ORACLES["E8_granular_segments"] = f"WITH {GRANULAR} SELECT feature, segment_id, {rs(['start_feature', 'end_feature', 'start_cost', 'end_cost', 'marginal_rate'])} FROM segments"
ORACLES["E8_unlimited_premium"] = f"""WITH {GRANULAR}, {FLAGS_TABLE} SELECT feature, flag AS flag_name, {r('unlimited_avg_cost - limited_avg_cost', 'coefficient')},
  {rs(['unlimited_avg_cost', 'limited_avg_cost'])}, unlimited_count FROM premiums JOIN flags USING (feature)"""

# --- F, G ----------------------------------------------------------------------------------------------
ORACLES["F1_frontier_rows"] = f"WITH {FRONTIER_ROWS} SELECT id, original_fee FROM frows"
ORACLES["F2_point_classes"] = f"""WITH {CORE_FRONTIER} SELECT l.id, l.feature, l.value, l.cost,
  CASE WHEN f.feature IS NOT NULL THEN 'frontier' WHEN c.feature IS NOT NULL THEN 'excluded' ELSE 'other' END AS point_class
FROM lng l LEFT JOIN front f ON f.feature = l.feature AND f.value = l.value AND f.cost = l.cost
LEFT JOIN cands c ON c.feature = l.feature AND c.value = l.value AND c.cost = l.cost WHERE NOT l.unlimited AND l.cost IS NOT NULL"""
ORACLES["F3_dummy_columns"] = f"""WITH {PLANS} SELECT id, CASE WHEN mno = 'M1' THEN 1 ELSE 0 END AS mno_M1, CASE WHEN mno = 'M2' THEN 1 ELSE 0 END AS mno_M2,
  CASE WHEN network = 'LTE' THEN 1 ELSE 0 END AS network_LTE FROM plans"""
ORACLES["J10_dummy_encoding"] = ORACLES["F3_dummy_columns"]
ORACLES["J10_dummy_entries"] = f"WITH {PLANS} " + " UNION ALL ".join(
    f"SELECT id, '{c}' AS \"column\", {c} AS level FROM plans WHERE {c} > (SELECT MIN({c}) FROM plans)" for c in ("mno", "network", "mvno"))


def commas(expr: str) -> str:
    return f"CASE WHEN {expr} IS NULL THEN 'N/A' WHEN {expr} = FLOOR({expr}) THEN format('{{:,}}', CAST({expr} AS BIGINT)) ELSE format('{{:,.2f}}', CAST({expr} AS DOUBLE)) END"


def decimal1(expr: str) -> str:
    return f"format('{{:.1f}}', CAST({expr} AS DOUBLE))"


ORACLES["G1_number_text"] = f"WITH {FEATURES} SELECT id, {commas('original_fee')} AS whole_fee, {commas('(fee / 8)')} AS part_fee, {commas('(CASE WHEN id % 2 = 0 THEN fee END)')} AS gap_fee FROM features"
ORACLES["G2_short_names"] = f"WITH {PLANS} SELECT id, CASE WHEN LENGTH(plan_name) <= 12 THEN plan_name ELSE SUBSTRING(plan_name, 1, 9) || '...' END AS short_name FROM plans"
_rich = " + ".join(
    (f"CASE WHEN {C.UNLIMITED_FLAGS[f]} = 1 THEN 100 WHEN {f} > 0 THEN 10 ELSE 1 END" if f in C.UNLIMITED_FLAGS else f"CASE WHEN {f} > 0 THEN 10 ELSE 1 END") for f in CORE)
ORACLES["G3_richness"] = f"WITH {FEATURES} SELECT id, CAST({_rich} AS INTEGER) AS richness FROM features"


def plain_text(f: str) -> str:
    return "CAST(additional_call AS VARCHAR)" if f == "additional_call" else decimal1(f)


def spec_cell(f: str, keep_value: bool = False) -> str:
    unit = C.FEATURE_UNITS[f]
    value = f"{plain_text(f)} || ' {unit}'"
    return f"CASE WHEN {C.UNLIMITED_FLAGS[f]} = 1 THEN 'Unlimited {unit}' ELSE {value} END" if f in C.UNLIMITED_FLAGS else value


SPECS = " || '; ' || ".join(f"'{C.CORE_CONTINUOUS[f]}: ' || {spec_cell(f)}" for f in CORE)
ORACLES["G4_spec_text"] = f"WITH {FEATURES} SELECT id, {SPECS} AS specs FROM features"
_others = " || ' + ' || ".join(f"({spec_cell(f)})" for f in CORE if f != "basic_data_clean")
ORACLES["G5_other_spec_text"] = f"WITH {FEATURES} SELECT id, {_others} || ' = ' || format('{{:,}}', CAST(original_fee AS BIGINT)) || ' KRW' AS other_specs FROM features"


def gb_cell(f: str, flag: str | None, dash: bool, unit: str) -> str:
    head = f"WHEN {flag} = 1 THEN '무제한' " if flag else ""
    tail = f"WHEN {f} = 0 THEN '-' " if dash else ""
    body = f"({commas(f)}) || '{unit}'"
    return f"CASE {head}{tail}ELSE {body} END" if head or tail else body


_speed = f"{decimal1('throttle_speed_normalized * 10')} || 'Mbps'"
ORACLES["G6_plan_table"] = f"""WITH {SCORED}, {RANKED} SELECT id, CAST(rank_number AS VARCHAR) AS rank_cell,
  CASE WHEN LENGTH(plan_name) <= 30 THEN plan_name ELSE SUBSTRING(plan_name, 1, 27) || '...' END || ' (' || id || ')' AS plan_cell, mvno AS mvno_cell,
  ({commas('original_fee')}) || '원' AS original_fee_cell, ({commas('fee')}) || '원' AS fee_cell,
  ({commas('B')}) || '원 (' || CASE WHEN isinf(CS) THEN '∞' ELSE format('{{:.2f}}', COALESCE(CS, 0)) END || '배 ' || CASE WHEN COALESCE(CS, 0) > 1 THEN '↑' WHEN COALESCE(CS, 0) < 1 THEN '↓' ELSE '→' END || ')' AS cs_cell,
  CASE WHEN is_5g = 1 THEN '5G' ELSE 'LTE' END AS network_cell, {gb_cell('basic_data_clean', 'basic_data_unlimited', False, 'GB')} AS basic_data_clean_cell,
  {gb_cell('daily_data_clean', 'daily_data_unlimited', True, 'GB')} AS daily_data_clean_cell, {gb_cell('tethering_gb', None, True, 'GB')} AS tethering_gb_cell,
  {gb_cell('message_clean', 'message_unlimited', False, '건')} AS message_clean_cell,
  {gb_cell('voice_clean', 'voice_unlimited', False, '분')} || CASE WHEN additional_call > 0 THEN ' (부가: ' || format('{{:,}}', additional_call) || '분)' ELSE '' END AS voice_clean_cell,
  CASE unlimited_type_numeric WHEN 2 THEN '소진시 ' || {_speed} WHEN 1 THEN '항상 ' || {_speed} WHEN 3 THEN '무제한' ELSE '소진시 종료' END AS throttle_cell FROM ranked"""
ORACLES["G7_storable"] = f"""WITH {SCORED} SELECT id, {r('B')}, CASE WHEN isinf(CS) THEN 1.7976931348623157e308 ELSE ROUND(COALESCE(CS, 0), 4) + 0.0 END AS CS,
  CASE WHEN id % 2 = 1 THEN 0.0 WHEN isinf(CS) THEN 1.7976931348623157e308 ELSE ROUND(COALESCE(CS, 0), 4) + 0.0 END AS gap FROM scored"""

# --- H -------------------------------------------------------------------------------------------------
ORACLES["H1_feature_frontiers"] = f"""WITH {PLAN_FRONTIER}, {FLAGS_TABLE} SELECT 'limited' AS kind, feature, value, cost FROM front
UNION ALL SELECT 'unlimited', flag, NULL, cost FROM flat JOIN flags USING (feature)"""
ORACLES["H2_contributions"] = f"WITH {SCORED} SELECT id, " + ", ".join(
    r(f"SUM(CASE WHEN feature = '{f}' THEN part END)", f"contribution_{f}") for f in CONTINUOUS) + " FROM parts GROUP BY id"
ORACLES["H3_baseline"] = f"WITH {SCORED} SELECT id, {r('B')} FROM scored"
ORACLES["H4_cs_ratio"] = f"WITH {SCORED} SELECT id, {rs(['B', 'CS'])} FROM scored"
ORACLES["H6_frontier"] = ORACLES["H4_cs_ratio"]
ORACLES["H5_marginal_costs"] = ORACLES["A10_stored_cost_structure"]
ORACLES["H7_given_rates"] = f"""WITH {FEATURES}, b AS (SELECT id, fee, {LINEAR} AS b FROM features), c AS (SELECT *, {ratio_of('b')} AS cs FROM b)
SELECT id, {r('b', 'B_fixed_rates')}, {r('cs', 'CS_fixed_rates')}, {r('b', 'B')}, {r('cs', 'CS')} FROM c"""
ORACLES["H8_given_multi_rates"] = f"""WITH {FEATURES}, b AS (SELECT id, fee, {MULTI} AS b FROM features)
SELECT id, {r('b', 'B_multi_frontier')}, {r(ratio_of('b'), 'CS_multi_frontier')} FROM b"""
ORACLES["H9_efficiency_quadrants"] = f"""WITH {SCORED} SELECT id, {r('B', 'baseline')}, {r('fee', 'actual')}, {r('COALESCE(CS, 0)', 'cs_ratio')},
  {r('basic_data_clean + voice_clean + message_clean + tethering_gb', 'feature_total')}, plan_name, mvno, COALESCE(CS, 0) >= 1 AS is_good_value FROM scored"""

# --- I -------------------------------------------------------------------------------------------------
SUMS = """s AS (SELECT COUNT(*) AS n, AVG(l_quantity) AS m1, AVG(l_discount) AS m2, AVG(original_fee) AS my,
  VAR_POP(l_quantity) * COUNT(*) AS s11, VAR_POP(l_discount) * COUNT(*) AS s22, COVAR_POP(l_quantity, l_discount) * COUNT(*) AS s12,
  COVAR_POP(l_quantity, original_fee) * COUNT(*) AS s1y, COVAR_POP(l_discount, original_fee) * COUNT(*) AS s2y, VAR_POP(original_fee) * COUNT(*) AS syy FROM {source})"""
ORACLES["I2_projected_ridge"] = f"""WITH {EFFICIENT}, {SUMS.format(source='efficient')},
b AS (SELECT *, ((s22 + 1) * s1y - s12 * s2y) / ((s11 + 1) * (s22 + 1) - s12 * s12) AS b1, ((s11 + 1) * s2y - s12 * s1y) / ((s11 + 1) * (s22 + 1) - s12 * s12) AS b2 FROM s)
SELECT '1' AS feature, {r('my - m1 * b1 - m2 * b2', 'coefficient')} FROM b UNION ALL SELECT 'l_quantity', {r('GREATEST(b1, 0.1::DOUBLE)', 'coefficient')} FROM b
UNION ALL SELECT 'l_discount', {r('GREATEST(b2, 0.1::DOUBLE)', 'coefficient')} FROM b"""
ORACLES["I3_equal_weights"] = f"""WITH {EFFICIENT}, b AS (SELECT LEAST(GREATEST(AVG(original_fee) / 2, 1.0), 20000.0) AS b FROM efficient)
SELECT '1' AS feature, 0.0::DOUBLE AS coefficient UNION ALL SELECT 'l_quantity', {r('b', 'coefficient')} FROM b UNION ALL SELECT 'l_discount', {r('b', 'coefficient')} FROM b"""
ORACLES["I5_unconstrained"] = f"""WITH {ITEMS}, q AS (SELECT SUM(l_quantity * l_quantity) AS a, SUM(l_quantity * l_discount) AS b, SUM(l_discount * l_discount) AS c,
  SUM(l_quantity * original_fee) AS y1, SUM(l_discount * original_fee) AS y2 FROM items)
SELECT '1' AS feature, 0.0::DOUBLE AS coefficient UNION ALL SELECT 'l_quantity', {r('(c * y1 - b * y2) / (a * c - b * b)', 'coefficient')} FROM q
UNION ALL SELECT 'l_discount', {r('(a * y2 - b * y1) / (a * c - b * b)', 'coefficient')} FROM q"""


def two_bounded(low1: str, low2: str) -> str:
    """The best feasible of the four ways to hold two coefficients at their lower bounds or leave them free."""
    return f"""ways AS (
  SELECT *, (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS b1, (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS b2 FROM h
  UNION ALL SELECT *, {low1}, (g2 - h12 * {low1}) / h22 FROM h UNION ALL SELECT *, (g1 - h12 * {low2}) / h11, {low2} FROM h UNION ALL SELECT *, {low1}, {low2} FROM h),
best_way AS (
  SELECT ARG_MIN(b1, f) AS b1, ARG_MIN(b2, f) AS b2 FROM (
    SELECT b1, b2, b1 * b1 * h11 + 2 * b1 * b2 * h12 + b2 * b2 * h22 - 2 * b1 * g1 - 2 * b2 * g2 AS f FROM ways WHERE b1 >= {low1} AND b2 >= {low2}))"""


ORACLES["I1_bounded_ridge_items"] = f"""WITH {EFFICIENT}, {SUMS.format(source='efficient')}, h AS (SELECT s11 + 1 AS h11, s12 AS h12, s22 + 1 AS h22, s1y AS g1, s2y AS g2 FROM s),
{two_bounded('0.1::DOUBLE', '0.1::DOUBLE')}
SELECT '1' AS feature, {r('my - m1 * b1 - m2 * b2', 'coefficient')} FROM s, best_way UNION ALL SELECT 'l_quantity', {r('b1', 'coefficient')} FROM best_way
UNION ALL SELECT 'l_discount', {r('b2', 'coefficient')} FROM best_way"""
ORACLES["I4_whole_table_items"] = f"""WITH {ITEMS}, moments AS (SELECT AVG(original_fee) AS m, STDDEV_SAMP(original_fee) AS sd FROM items),
h AS (SELECT SUM(l_quantity * l_quantity) AS h11, SUM(l_quantity * l_discount) AS h12, SUM(l_discount * l_discount) AS h22, SUM(l_quantity * fee) AS g1, SUM(l_discount * fee) AS g2
  FROM items, moments WHERE ABS((original_fee - m) / sd) <= 3 AND fee > 0),
{two_bounded('0.0::DOUBLE', '0.0::DOUBLE')}
SELECT '1' AS feature, 0.0::DOUBLE AS coefficient UNION ALL SELECT 'l_quantity', {r('b1', 'coefficient')} FROM best_way UNION ALL SELECT 'l_discount', {r('b2', 'coefficient')} FROM best_way"""
EFFICIENT_TWO = f"""{ITEMS},
vectors AS (SELECT l_quantity, l_discount, MIN(original_fee) AS original_fee FROM items GROUP BY ALL),
best AS (SELECT * FROM vectors v WHERE NOT EXISTS (SELECT 1 FROM vectors o WHERE o.l_quantity >= v.l_quantity AND o.l_discount >= v.l_discount
  AND o.original_fee <= v.original_fee AND (o.l_quantity > v.l_quantity OR o.l_discount > v.l_discount OR o.original_fee < v.original_fee))),
efficient AS (SELECT i.* FROM items i SEMI JOIN best USING (l_quantity, l_discount, original_fee))"""
RIDGE_TWO = f"""{EFFICIENT_TWO}, {SUMS.format(source='efficient')}, h AS (SELECT s11 + 1 AS h11, s12 AS h12, s22 + 1 AS h22, s1y AS g1, s2y AS g2 FROM s),
{two_bounded('0.1::DOUBLE', '0.1::DOUBLE')},
free AS (SELECT (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS u1, (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS u2 FROM h),
line AS (SELECT my - m1 * b1 - m2 * b2 AS b0, * FROM s, best_way, free)"""


def _fit_row(feature: str, b: str, u: str, low: str, base: str, used: str, rows: str, method: str, source: str) -> str:
    return f"""SELECT '{feature}' AS feature, {r(b, 'coefficient')}, {low}::DOUBLE AS lower, true AS within_bounds, {r(u, 'unconstrained')},
  {r(f'{b} - {u}', 'adjustment')}, {r(base, 'base_cost')}, {used} AS rows_used, {rows} AS rows_total, '{method}' AS method FROM {source}"""


_on_two = " OR ".join(
    f"(EXISTS (SELECT 1 FROM front WHERE front.feature = '{f}' AND front.value = p.{f} AND front.cost = p.original_fee)"
    + (f" AND {C.UNLIMITED_FLAGS[f]} = 0" if f in C.UNLIMITED_FLAGS else "") + ")" for f in TWO_PLAN)
FRONTIER_TWO = f"""{FEATURES},{frontier('features', 'id', TWO_PLAN, C.UNLIMITED_FLAGS)},
chosen AS (SELECT ARG_MIN(id, (cost, id)) AS id FROM lng WHERE unlimited AND cost IS NOT NULL GROUP BY feature),
valued AS (SELECT *, COALESCE(CASE WHEN voice_unlimited = 1 THEN 2 * (SELECT MAX(voice_clean) FROM features) ELSE voice_clean END, 0) AS x1, COALESCE(tethering_gb, 0) AS x2 FROM features),
frows AS (SELECT p.* FROM valued p WHERE {_on_two} OR p.id IN (SELECT id FROM chosen)),
h AS (SELECT COUNT(*) AS n, SUM(x1 * x1) AS h11, SUM(x1 * x2) AS h12, SUM(x2 * x2) AS h22, SUM(x1 * original_fee) AS g1, SUM(x2 * original_fee) AS g2,
  ABS(CORR(x1, x2)) > 0.8 AS alike FROM frows WHERE original_fee IS NOT NULL),
{two_bounded('0.1::DOUBLE', '0.1::DOUBLE')},
rates AS (SELECT n, CASE WHEN alike THEN (b1 + b2) / 2 ELSE b1 END AS c1, CASE WHEN alike THEN (b1 + b2) / 2 ELSE b2 END AS c2 FROM h, best_way)"""
ORACLES["I6_frontier_row_fit_items"] = f"""WITH {FRONTIER_TWO} SELECT 'voice_clean' AS feature, {r('c1', 'coefficient')}, n AS rows_used FROM rates
UNION ALL SELECT 'tethering_gb', {r('c2', 'coefficient')}, n FROM rates"""
ORACLES["H6_multi_frontier_items"] = f"""WITH {FRONTIER_TWO}, based AS (SELECT id, fee, c1 * x1 + c2 * x2 AS B FROM valued, rates)
SELECT id, {r('B')}, {r("CASE WHEN fee <> 0 THEN B / fee WHEN B > 0 THEN CAST('Infinity' AS DOUBLE) WHEN B < 0 THEN CAST('-Infinity' AS DOUBLE) END", 'CS')} FROM based"""
ORACLES["H6_fixed_rates_items"] = f"""WITH {RIDGE_TWO}
SELECT {ITEM_KEY}, {r('fee')}, {r('b0 + b1 * l_quantity + b2 * l_discount', 'B')}, {r('(b0 + b1 * l_quantity + b2 * l_discount) / fee', 'CS')} FROM items, line"""
ORACLES["I7_price_fit_items"] = f"""WITH {RIDGE_TWO} """ + " UNION ALL ".join(
    _fit_row(f, b, u, "0.1", "b0", "n", "(SELECT COUNT(*) FROM items)", "efficient_bounded", "line") for f, b, u in (("l_quantity", "b1", "u1"), ("l_discount", "b2", "u2")))
ORACLES["I8_coefficient_table_items"] = f"""WITH {ITEMS}, moments AS (SELECT AVG(original_fee) AS m, STDDEV_SAMP(original_fee) AS sd FROM items),
h AS (SELECT COUNT(*) AS n, SUM(l_quantity * l_quantity) AS h11, SUM(l_quantity * l_discount) AS h12, SUM(l_discount * l_discount) AS h22, SUM(l_quantity * fee) AS g1,
  SUM(l_discount * fee) AS g2 FROM items, moments WHERE ABS((original_fee - m) / sd) <= 3 AND fee > 0),
{two_bounded('0.0::DOUBLE', '0.0::DOUBLE')},
line AS (SELECT *, (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS u1, (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS u2 FROM h, best_way)
""" + " UNION ALL ".join(_fit_row(f, b, u, "0.0", "0.0::DOUBLE", "n", "n", "whole_table_bounded", "line") for f, b, u in (("l_quantity", "b1", "u1"), ("l_discount", "b2", "u2")))
_loss = "syy - 2 * ({b1} * s1y + {b2} * s2y) + {b1} * {b1} * s11 + 2 * {b1} * {b2} * s12 + {b2} * {b2} * s22 + {b1} * {b1} + {b2} * {b2} + n * POWER({b0} - (my - m1 * {b1} - m2 * {b2}), 2)"
ORACLES["L1_objective_items"] = f"""WITH {RIDGE_TWO}, fits AS (
  SELECT *, b0 AS c0, b1 AS c1, b2 AS c2, 'bounded' AS solver FROM line UNION ALL SELECT *, b0, b1, b2, 'from_upper' FROM line
  UNION ALL SELECT *, my - m1 * u1 - m2 * u2, GREATEST(u1, 0.1::DOUBLE), GREATEST(u2, 0.1::DOUBLE), 'projected' FROM line)
SELECT solver, {r('c0', 'intercept', 2)}, {r('c1', 'l_quantity', 2)}, {r('c2', 'l_discount', 2)}, {r(_loss.format(b0='c0', b1='c1', b2='c2'), 'objective', 2)} FROM fits"""
ORACLES["I9_simple_redistribution"] = f"""WITH {FEATURES}, c AS ({_corr}), given AS (SELECT * FROM (VALUES {', '.join(f"('{f}', {v}::DOUBLE)" for f, v in GIVEN_RATES.items())}) AS t(feature, value)),
pairs AS (SELECT f1, f2, ABS(corr) AS corr FROM c WHERE NOT isnan(corr) AND ABS(corr) > 0.8), both_ways AS (SELECT * FROM pairs UNION ALL SELECT f2, f1, corr FROM pairs)
SELECT f1 AS feature, f2 AS paired_with, {r('corr', 'correlation', 6)}, {r('a.value', 'original_value', 6)}, {r('b.value', 'partner_original_value', 6)}, {r('a.value + b.value', 'total_value', 6)},
  {r('(a.value + b.value) / 2', 'redistributed_value', 6)}, 'simple_averaging' AS method FROM both_ways JOIN given a ON a.feature = f1 JOIN given b ON b.feature = f2"""
_given = ", ".join(f"('{f}', {v}::DOUBLE)" for f, v in GIVEN_RATES.items())
ORACLES["I14_collinearity_report"] = f"""WITH {FEATURES}, c AS ({_corr}), given AS (SELECT * FROM (VALUES {_given}) AS t(feature, value))
SELECT f1, f2, {r('corr', digits=6)}, a.value AS coefficient1, b.value AS coefficient2, {r('(a.value + b.value) / 2', 'shared', 6)}
FROM c JOIN given a ON a.feature = f1 JOIN given b ON b.feature = f2 WHERE NOT isnan(corr) AND ABS(corr) > 0.8"""
_means_long = " UNION ALL ".join(f"SELECT '{f}' AS feature, AVG({f}) AS coefficient FROM features" for f in C.BASIC_FEATURES)
ORACLES["I14_economic_clip"] = f"""WITH {FEATURES}, m AS ({_means_long}) SELECT feature, {r('coefficient')}, ROUND(CASE WHEN feature LIKE '%unlimited%' THEN LEAST(GREATEST(coefficient, 100.0), 20000.0)
  WHEN feature LIKE '%5g%' OR feature LIKE '%tethering%' THEN LEAST(GREATEST(coefficient, 100.0), 10000.0) ELSE GREATEST(coefficient, 0.1) END, 4) + 0.0 AS clipped FROM m"""
ORACLES["I11_subset_r2_items"] = f"""WITH {ITEMS}, k AS (SELECT CORR(l_quantity, l_discount) AS a, CORR(l_quantity, l_tax) AS b, CORR(l_discount, l_tax) AS c,
  CORR(l_quantity, original_fee) AS x, CORR(l_discount, original_fee) AS y, CORR(l_tax, original_fee) AS z FROM items),
f AS (SELECT 1 AS mask, x * x AS r2 FROM k UNION ALL SELECT 2, y * y FROM k UNION ALL SELECT 4, z * z FROM k
  UNION ALL SELECT 3, (x * x + y * y - 2 * x * y * a) / (1 - a * a) FROM k UNION ALL SELECT 5, (x * x + z * z - 2 * x * z * b) / (1 - b * b) FROM k
  UNION ALL SELECT 6, (y * y + z * z - 2 * y * z * c) / (1 - c * c) FROM k
  UNION ALL SELECT 7, (x * x * (1 - c * c) + y * y * (1 - b * b) + z * z * (1 - a * a) + 2 * x * y * (b * c - a) + 2 * x * z * (a * c - b) + 2 * y * z * (a * b - c))
    / (1 + 2 * a * b * c - a * a - b * b - c * c) FROM k)
SELECT CAST(mask AS BIGINT) AS mask, {r('r2', digits=8)}, CAST(bit_count(mask) AS INTEGER) AS size FROM f"""
R2 = f"""{ITEMS}, k AS (SELECT CORR(l_quantity, original_fee) AS ra, CORR(l_discount, original_fee) AS rb, CORR(l_quantity, l_discount) AS rab FROM items),
e AS (SELECT ra * ra AS r1, rb * rb AS r2, (ra * ra + rb * rb - 2 * ra * rb * rab) / (1 - rab * rab) AS r12 FROM k)"""
EFFECTS = f"""{R2}, eff AS (
  SELECT 'unique' AS type, 'l_quantity' AS f1, NULL AS f2, GREATEST(0.0, r12 - r2) AS value, r12 FROM e
  UNION ALL SELECT 'unique', 'l_discount', NULL, GREATEST(0.0, r12 - r1), r12 FROM e
  UNION ALL SELECT 'common', 'l_quantity', 'l_discount', r12 - r1 - r2, r12 FROM e)"""
ORACLES["I12_effects"] = f"WITH {EFFECTS} SELECT type, f1, f2, {r('value', digits=8)} FROM eff"
ORACLES["I14_commonality_report"] = f"WITH {EFFECTS} SELECT type, f1, f2, {r('value', digits=6)}, {r('value / r12 * 100', 'percentage', 6)} FROM eff"
ORACLES["I13_variance_decomposition"] = f"""WITH {R2}, p AS (SELECT 'l_quantity' AS feature, r1 AS own, GREATEST(0.0, r12 - r1 - r2) / 2 AS common, r12 FROM e
  UNION ALL SELECT 'l_discount', r2, GREATEST(0.0, r12 - r1 - r2) / 2, r12 FROM e)
SELECT feature, {r('own', 'unique_variance', 6)}, {r('common', 'common_variance', 6)}, {r('own + common', 'total_contribution', 6)},
  {r('own / r12 * 100', 'unique_percentage', 6)}, {r('common / r12 * 100', 'common_percentage', 6)} FROM p"""

ORACLES["I10_redistribution_items"] = f"""WITH {EFFECTS}, u AS (SELECT f1 AS feature, value AS unique_effect FROM eff WHERE type = 'unique'),
w AS (SELECT u.feature, CASE u.feature WHEN 'l_quantity' THEN 'l_discount' ELSE 'l_quantity' END AS paired_with, CASE u.feature WHEN 'l_quantity' THEN 300.0::DOUBLE ELSE 40.0::DOUBLE END AS original_value,
  unique_effect, GREATEST(0.0, (SELECT value FROM eff WHERE type = 'common')) AS common_effect FROM u)
SELECT feature, paired_with, original_value, {rs(['unique_effect', 'common_effect'], 6)}, {r('unique_effect + common_effect', 'total_variance_effect', 6)},
  {r('GREATEST(0.1::DOUBLE, 340 * unique_effect / (unique_effect + common_effect))', 'redistributed_value', 6)} FROM w"""

# --- J -------------------------------------------------------------------------------------------------
ORACLES["J1_segment_lines"] = f"{CHANGES} SELECT feature, {rs(['start_feature', 'end_feature', 'slope', 'intercept'])}, points FROM lines"
ORACLES["J2_robust_segments"] = f"{CHANGES} SELECT feature, {rs(['start_feature', 'end_feature', 'marginal_rate', 'intercept', 'start_cost', 'end_cost'])}, data_points FROM robust"


def cumulative(base: float, extra: str = "", join: str = "") -> str:
    cost = r(f"""{base} + CASE WHEN EXISTS (SELECT 1 FROM robust x WHERE x.feature = p.feature) THEN
    COALESCE((SELECT SUM(GREATEST(0, LEAST(x.end_feature, p.value) - GREATEST(x.start_feature, 0)) * x.marginal_rate) FROM robust x WHERE x.feature = p.feature), 0)
    ELSE p.value * t.rate END""", "cumulative_cost")
    return f"""numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY segment) AS number FROM robust)
SELECT p.feature, {r('p.value', 'value')}, {r('p.cost', 'actual_market_cost')}, {cost}, {r('COALESCE(o.marginal_rate, t.rate)', 'marginal_cost')},
  CASE WHEN o.number IS NULL THEN 'linear' ELSE 'Segment ' || o.number || ': ' || {decimal1('o.start_feature')} || '-' || {decimal1('o.end_feature')} END AS segment_label{extra}
FROM segmented p JOIN rates t USING (feature) LEFT JOIN numbered o ON o.feature = p.feature AND o.segment = p.segment {join}"""


RATES_TABLE = f"rates AS (SELECT * FROM (VALUES {_rate_rows}) AS t(feature, rate))"
ORACLES["J6_cumulative_cost"] = f"{CHANGES}, {RATES_TABLE}, {cumulative(1000)}"
ORACLES["J7_marginal_frontier"] = f"""WITH RECURSIVE {CORE_LEVELS.replace('levels AS', 'raw_levels AS')}, {PLAUSIBLE.replace('LEVELS_OF', 'raw_levels')},
levels AS (SELECT feature, value, cost FROM plausible), {CHAIN}, {cumulative(GIVEN_INTERCEPT)}"""
ORACLES["J8_given_rates"] = f"""WITH RECURSIVE {FEATURES}, lng AS ({long_rows('features', 'id', CORE, {})}),
stats AS (SELECT feature, value, MIN(cost) AS cost, AVG(cost) AS avg_cost, COUNT(*) AS plan_count FROM lng GROUP BY feature, value),
levels AS (SELECT feature, value, cost FROM stats), {CHAIN}, {RATES_TABLE}, {cumulative(GIVEN_INTERCEPT, ", " + r("q.avg_cost", "avg_cost") + ", q.plan_count", "JOIN stats q ON q.feature = p.feature AND q.value = p.value")}"""
_b, _v = BREAKS["basic_data_clean"], BREAKS["voice_clean"]
ORACLES["J3_segment_features"] = f"""WITH {FEATURES} SELECT id, {r(f'LEAST(basic_data_clean, {_b[0]})', 'basic_data_clean_seg_0')},
  {r(f'GREATEST(0, LEAST(basic_data_clean - {_b[0]}, {_b[1] - _b[0]}))', 'basic_data_clean_seg_1')}, {r(f'GREATEST(0, basic_data_clean - {_b[1]})', 'basic_data_clean_seg_2')},
  {r(f'LEAST(voice_clean, {_v[0]})', 'voice_clean_seg_0')}, {r(f'GREATEST(0, voice_clean - {_v[0]})', 'voice_clean_seg_1')} FROM features"""
ORACLES["J5_marginal_lookup"] = f"""WITH {FEATURES} SELECT id, CASE WHEN basic_data_clean <= 10 THEN 100.0::DOUBLE WHEN basic_data_clean <= 30 THEN 50.0::DOUBLE ELSE 25.0::DOUBLE END AS data_rate,
  CASE WHEN voice_clean <= 200 THEN 9.0::DOUBLE ELSE 4.0::DOUBLE END AS voice_rate FROM features"""
ORACLES["J4_two_segments"] = f"""WITH {FEATURES}, x AS (SELECT id, LEAST(voice_clean, 200) AS a, GREATEST(0, voice_clean - 200) AS b, original_fee AS y FROM features),
s AS (SELECT AVG(a) AS ma, AVG(b) AS mb, AVG(y) AS my, VAR_POP(a) AS aa, VAR_POP(b) AS bb, COVAR_POP(a, b) AS ab, COVAR_POP(a, y) AS ay, COVAR_POP(b, y) AS yb FROM x),
w AS (SELECT *, (bb * ay - ab * yb) / (aa * bb - ab * ab) AS c1, (aa * yb - ab * ay) / (aa * bb - ab * ab) AS c2 FROM s)
SELECT id, {r('my + c1 * (a - ma) + c2 * (b - mb)', 'predicted_cost')} FROM x, w"""
_flag_cost = " + ".join(
    f"(CASE WHEN {m} = 1 THEN COALESCE((SELECT unlimited_avg_cost - limited_avg_cost FROM premiums WHERE feature = '{f}'), 0) ELSE 0 END)" for f, m in C.UNLIMITED_FLAGS.items())
ORACLES["J9_bundle_cost"] = f"""WITH {GRANULAR},
used AS (SELECT l.id, l.feature, SUM(GREATEST(0, LEAST(s.end_feature, l.value) - s.start_feature) * s.marginal_rate) AS cost
  FROM lng l JOIN segments s ON s.feature = l.feature AND l.value > s.start_feature WHERE l.value > 0 GROUP BY l.id, l.feature),
wide AS (SELECT f.id, {', '.join(f"COALESCE(SUM(CASE WHEN u.feature = '{c}' THEN u.cost END), 0) AS segment_cost_{c}" for c in CORE)} FROM features f LEFT JOIN used u ON u.id = f.id GROUP BY f.id),
flat AS (SELECT id, {_flag_cost} AS intercept_cost FROM features)
SELECT id, {rs([f'segment_cost_{c}' for c in CORE])}, {r('intercept_cost')}, {r(' + '.join(f'segment_cost_{c}' for c in CORE) + ' + intercept_cost', 'total_cost')} FROM wide JOIN flat USING (id)"""


def _premium(f: str, m: str) -> str:
    return (f"(SELECT AVG(CASE WHEN {m} = 1 THEN original_fee END) - AVG(CASE WHEN {m} = 0 AND {f} BETWEEN 0.8::DOUBLE * med AND 1.2::DOUBLE * med THEN original_fee END) "
            f"FROM features, (SELECT MEDIAN({f}) AS med FROM features WHERE {m} = 0))")


ORACLES["J11_premium_encoding"] = f"WITH {FEATURES} SELECT id, " + ", ".join(
    r(f"{f.replace('_clean', '_unlimited')} * {_premium(f, f.replace('_clean', '_unlimited'))}", f"{f}_unlimited_premium") for f in ("voice_clean", "message_clean")) + " FROM features"
ORACLES["J12_mixed_encoding"] = f"""WITH {FEATURES} SELECT id, CASE WHEN voice_unlimited = 1 THEN 2 * (SELECT MAX(voice_clean) FROM features WHERE voice_unlimited = 0) ELSE voice_clean END AS voice_clean_mixed,
  voice_unlimited AS voice_clean_is_synthetic FROM features"""
ORACLES["J13_segments"] = f"WITH {FEATURES} SELECT id, CASE WHEN voice_unlimited = 1 THEN 'unlimited' ELSE 'limited' END AS segment, voice_clean FROM features"
ORACLES["J14_categorical_costs"] = f"""WITH {FEATURES} SELECT 'voice_clean' AS feature, {GIVEN_RATES['voice_clean']}::DOUBLE AS limited,
  {r('(AVG(original_fee) FILTER (voice_unlimited = 1) - AVG(original_fee) FILTER (voice_unlimited = 0)) / (2 * MAX(voice_clean) FILTER (voice_unlimited = 0) - AVG(voice_clean) FILTER (voice_unlimited = 0))', 'unlimited')} FROM features"""
ORACLES["J15_encoding_dispatch"] = f"""WITH {FEATURES} SELECT id, basic_data_unlimited AS basic_data_unlimited_1, daily_data_unlimited AS daily_data_unlimited_1,
  voice_unlimited AS voice_unlimited_1, message_unlimited AS message_unlimited_1 FROM features"""

# --- K, L ----------------------------------------------------------------------------------------------
ORACLES["K1_frontier_points"] = f"""WITH {CORE_FRONTIER},
named AS (SELECT l.feature, l.value, l.cost, ARG_MIN(p.plan_name, l.id) AS plan_name, BOOL_OR(f.feature IS NOT NULL) AS kept
  FROM lng l JOIN cands c ON c.feature = l.feature AND c.value = l.value AND c.cost = l.cost JOIN features p ON p.id = l.id
  LEFT JOIN front f ON f.feature = l.feature AND f.value = l.value WHERE NOT l.unlimited GROUP BY l.feature, l.value, l.cost)
SELECT feature, value, cost, plan_name, CASE WHEN kept THEN 'frontier' ELSE 'excluded' END AS point_class FROM named
UNION ALL SELECT feature, 0.0, 0.0, 'Free Baseline', 'frontier' FROM front GROUP BY feature HAVING MIN(value) > 0
UNION ALL SELECT l.feature, NULL, MIN(l.cost), ARG_MIN(p.plan_name, (l.cost, l.id)), 'unlimited' FROM lng l JOIN features p ON p.id = l.id WHERE l.unlimited AND l.cost IS NOT NULL GROUP BY l.feature"""
_extended = f"CASE WHEN v < x1 AND x2 IS NOT NULL THEN y1 + (v - x1) * (y2 - y1) / (x2 - x1) ELSE {EXTENDED} END"
ORACLES["K2_residual_table"] = f"""WITH {CORE_FRONTIER},
lows AS (SELECT feature, MIN(value) AS value, ARG_MIN(cost, value) AS cost FROM front GROUP BY feature),
rich AS (SELECT id, plan_name, {SPECS} AS plan_specs, {_rich} AS score FROM features),
targets AS (
  SELECT feature, cost, id FROM (
    SELECT w.feature, w.cost, l.id, ROW_NUMBER() OVER (PARTITION BY w.feature ORDER BY g.score - (CASE WHEN l.value > 0 THEN 10 ELSE 1 END) DESC, l.id) AS rn
    FROM lows w JOIN lng l ON l.feature = w.feature AND l.value = w.value AND l.cost = w.cost AND NOT l.unlimited JOIN rich g ON g.id = l.id) WHERE rn = 1),
others AS (SELECT t.feature, {_extended} AS est FROM targets t JOIN (SELECT id, feature AS other, value AS v FROM lng) l ON l.id = t.id AND l.other <> t.feature
  LEFT JOIN seg ON seg.feature = l.other AND {IN_SEGMENT}),
sums AS (SELECT feature, CASE WHEN COUNT(*) = COUNT(est) THEN SUM(est) END AS others FROM others GROUP BY feature)
SELECT t.feature AS feature_analyzed, g.plan_name AS target_plan_name, g.plan_specs, {r('t.cost', 'cost_of_analyzed_feature')}, {r('s.others', 'combined_cost_others')},
  {r('t.cost - s.others', 'residual_cost')}, s.others IS NOT NULL AS residual_cost_valid FROM targets t JOIN rich g USING (id) JOIN sums s ON s.feature = t.feature"""
_label_rows = ", ".join(f"('{f}', '{C.CORE_CONTINUOUS[f]}', '{C.FEATURE_UNITS[f]}', {GIVEN_RATES[f]}::DOUBLE)" for f in CORE)
ORACLES["K3_coefficient_chart"] = f"""WITH {FEATURES}, lng AS ({long_rows('features', 'id', CORE, {})}), labels AS (SELECT * FROM (VALUES {_label_rows}) AS t(feature, display_name, unit, coefficient))
SELECT feature, ANY_VALUE(coefficient) AS coefficient, ANY_VALUE(display_name) AS display_name, ANY_VALUE(unit) AS unit, COUNT(*) AS total_plans, COUNT(DISTINCT value) AS unique_values,
  {r('MIN(value)', 'min_value')}, {r('MAX(value)', 'max_value')}, {r('AVG(value)', 'avg_value')} FROM lng JOIN labels USING (feature) GROUP BY feature"""
_given_rows = ", ".join(f"('{f}', {GIVEN_RATES[f]}::DOUBLE)" for f in CONTINUOUS)
ORACLES["K3_method_comparison"] = f"""WITH {SCORED}, {MARGINAL}, given AS (SELECT * FROM (VALUES {_given_rows}) AS t(feature, pure_cost)),
e AS (SELECT AVG(ABS(B - fee)) AS a, AVG(ABS(({MULTI}) - fee)) AS b FROM scored)
SELECT g.feature, g.pure_cost, {r('m.coefficient', 'traditional_cost')}, {r('(SELECT a FROM e)', 'traditional_mae')}, {r('(SELECT b FROM e)', 'multi_frontier_mae')},
  {r('(SELECT (a - b) / a * 100 FROM e)', 'improvement_percentage')} FROM given g LEFT JOIN marginal m USING (feature)"""
ORACLES["K4_frontier_matrix"] = f"WITH {FRONTIER_ROWS} SELECT id, plan_name, {', '.join(CONTINUOUS)}, original_fee FROM frows"
_range_features = ["basic_data_clean", "voice_clean", "message_clean", "tethering_gb"]
ORACLES["K4_matrix_ranges"] = f"WITH {FRONTIER_ROWS} " + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {r(f'MIN({f})', 'min_value')}, {r(f'MAX({f})', 'max_value')}, COUNT(*) AS total_plans FROM frows" for f in _range_features)
_means = ", ".join(f"AVG({f}) AS {f}" for f in C.BASIC_FEATURES)
ORACLES["L2_economic_checks"] = f"""WITH {FEATURES}, m AS (SELECT {_means} FROM features) SELECT {r('basic_data_clean', 'data_per_gb')}, {r('is_5g', 'fiveg_premium')},
  {r('voice_clean', 'voice_per_min')}, {r('tethering_gb', 'tethering_per_gb')}, CAST({' + '.join(f'({f} < 0)::INT' for f in C.BASIC_FEATURES)} AS BIGINT) AS negative_count,
  CAST({' + '.join(f'({f} = 0)::INT' for f in C.BASIC_FEATURES)} AS BIGINT) AS zero_count, is_5g > basic_data_clean * 10 AS scale_ok, tethering_gb > voice_clean AS premium_ok,
  ({' AND '.join(f'{f} > 0' for f in C.BASIC_FEATURES)}) AS positive_ok FROM m"""
ORACLES["L3_one_feature"] = f"""WITH {FEATURES}, t AS (SELECT id % 5 AS k, tethering_gb AS x, fee AS y FROM features),
s AS (SELECT k, SUM(x * y) AS xy, SUM(x * x) AS xx, COUNT(*) AS n FROM t GROUP BY k),
b AS (SELECT k, GREATEST(0.1::DOUBLE, ((SELECT SUM(xy) FROM s) - xy) / ((SELECT SUM(xx) FROM s) - xx)) AS b, (SELECT SUM(n) FROM s) - n AS train_size, n AS test_size FROM s)
SELECT CAST(t.k + 1 AS INTEGER) AS fold, {r('1 - SUM(POWER(y - b * x, 2)) / (VAR_POP(y) * COUNT(*))', 'r2_score', 6)}, {r('AVG(ABS(y - b * x))', 'mae', 6)},
  CAST(ANY_VALUE(train_size) AS BIGINT) AS train_size, ANY_VALUE(test_size) AS test_size FROM t JOIN b USING (k) GROUP BY t.k"""
RESIDUALS = f"""{FEATURES}, res AS (SELECT fee AS y, fee - ({LINEAR}) AS d FROM features),
cuts AS (SELECT QUANTILE_CONT(y, 0.25) AS q1, QUANTILE_CONT(y, 0.5) AS q2, QUANTILE_CONT(y, 0.75) AS q3 FROM res),
quarters AS (SELECT CASE WHEN y <= q1 THEN 1 WHEN y <= q2 THEN 2 WHEN y <= q3 THEN 3 ELSE 4 END AS quartile, COUNT(*) AS n, VAR_POP(d) AS residual_variance, AVG(d) AS mean_residual
  FROM res, cuts GROUP BY 1),
centre AS (SELECT AVG(d) AS m, STDDEV_POP(d) AS s, COUNT(*) AS n FROM res),
shape AS (SELECT ANY_VALUE(n) AS n, ANY_VALUE(m) AS m, ANY_VALUE(s) AS s, AVG(POWER((d - m) / s, 3)) AS skew, AVG(POWER((d - m) / s, 4)) - 3 AS kurt, COUNT(*) FILTER (ABS(d) > 3 * s) AS beyond FROM res, centre),
jb AS (SELECT *, n / 6.0::DOUBLE * (skew * skew + kurt * kurt / 4) AS jb, (SELECT STDDEV_POP(residual_variance) / AVG(residual_variance) FROM quarters) AS h FROM shape)"""
ORACLES["L4_residual_checks"] = f"""WITH {RESIDUALS} SELECT n, {r('m', 'mean_residual', 6)}, {r('s', 'residual_std', 6)}, {r('jb', 'jb_statistic', 6)}, {r('EXP(-jb / 2)', 'jb_p_value', 6)},
  EXP(-jb / 2) > 0.05 AS is_normal, {r('h', 'heteroscedasticity', 6)}, h < 0.5 AS is_homoscedastic, beyond AS outlier_count, {r('beyond::DOUBLE / n * 100', 'outlier_percentage', 6)} FROM jb"""
ORACLES["L4_residual_quartiles"] = f"WITH {RESIDUALS} SELECT quartile, n, {rs(['residual_variance', 'mean_residual'])} FROM quarters"
ORACLES["L5_score"] = f"""WITH {RESIDUALS}, q AS (SELECT EXP(-jb / 2) > 0.05 AS normal, h < 0.5 AS even, beyond::DOUBLE / n * 100 AS pct FROM jb),
z AS (SELECT CASE normal::INT + even::INT + (pct < 5)::INT WHEN 3 THEN 20 WHEN 2 THEN 12 ELSE CASE WHEN normal OR even OR pct < 10 THEN 6 ELSE 0 END END AS res FROM q)
SELECT 25 AS optimization_score, 17 AS economic_score, 22 AS prediction_score, res AS residual_score, 64 + res AS total_score,
  CASE WHEN 64 + res >= 85 THEN 'A' WHEN 64 + res >= 70 THEN 'B' WHEN 64 + res >= 55 THEN 'C' WHEN 64 + res >= 40 THEN 'D' ELSE 'F' END AS grade FROM z"""

# --- M and the whole ranking ---------------------------------------------------------------------------
ORACLES["M1_snapshot_stream"] = f"WITH {SCORED}, {RANKED} SELECT id, {rs(['B', 'CS'])}, rank_number FROM ranked"
ORACLES["Z1_flagship_top10"] = f"""WITH {SCORED}, {RANKED} SELECT id, plan_name, mvno, {rs(['fee', 'original_fee', 'B', 'CS'])}, rank_number, CAST(rank_number AS VARCHAR) AS rank_display
FROM ranked WHERE rank_number <= 10"""
