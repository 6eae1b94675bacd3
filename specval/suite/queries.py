"""One entry per work item: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import functions as F

from specval import config as C
from specval.fixtures import ITEM_FEATURES, ITEM_FLAGS
from specval.functions import text
from specval.functions.numeric import known
from specval.operators import commonality, encode, features as B, piecewise as P, redistribute, solve, stats, validate
from specval.operators.curves import CLAMP, CURVE_POINTS, EXTEND, price_values
from specval.operators.frontier import LIMITED, UNLIMITED, candidates, feature_frontiers, min_increments
from specval.operators.frontier_rows import cheapest_unlimited, frontier_rows, frontier_summary, on_frontier
from specval.operators.gram import correlations, gram, high_correlations, sufficient_statistics
from specval.operators.levels import level_table
from specval.operators.skyline import efficiency, efficient_rows
from specval.plans import explain, regression as R
from specval.plans.cost_spec import (
    cs_ratio, fixed_rate_scores, frontier_scores, multi_frontier_scores, rank_by_cs, rank_rows,
)
from specval.plans.marginal import marginal_frontier, whole_table_marginal_frontier
from specval.session import materialize
from specval.sources import plans as sources, store
from specval.streaming.market import announce, rank_stream
from specval.suite.inputs import GIVEN_INTERCEPT, GIVEN_RATES, GivenFit, features, folder_for, items, once, plans, rounded, scored

CORE = list(C.CORE_CONTINUOUS)
ITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
PRICE = "original_fee"
GIVEN = GivenFit(GIVEN_INTERCEPT, GIVEN_RATES)
GIVEN_MULTI = GivenFit(0.0, {f: GIVEN_RATES[f] for f in C.continuous(C.BASIC_FEATURES, C.UNLIMITED_FLAGS)})

B_COLUMNS = {
    "B1_mixed_to_number": ["basic_data", "daily_data", "tethering_gb"],
    "B2_network_flag": ["is_5g"],
    "B3_throttle_speed": ["speed_when_exhausted", "has_throttled_data"],
    "B4_unlimited_data_flags": ["basic_data_unlimited", "daily_data_unlimited"],
    "B6_clean_data_quota": ["basic_data_clean", "daily_data_clean"],
    "B7_monthly_total": ["has_daily_allocation", "total_data"],
    "B8_unlimited_flags": ["has_unlimited_data", "has_unlimited_speed", "any_unlimited_data"],
    "B9_unlimited_type": ["unlimited_type", "unlimited_type_numeric"],
    "B10_type_flags": ["data_stops_after_quota", "data_throttled_after_quota", "data_unlimited_speed"],
    "B11_throttle_normalized": ["throttle_speed_normalized"],
    "B13_voice_message": ["voice_unlimited", "voice_na", "voice_clean", "message_unlimited", "message_na", "message_clean"],
    "B14_sim_status": ["usim_supported", "usim_is_free"],
    "B15_prices": ["price_per_gb", "price_unlimited_adjusted", "monthly_price"],
    "B16_list_price": ["original_fee"],
    "B17_agreement": ["has_agreement"],
}


def item_frontier(spark, d):
    return once(spark, "item_frontier", d, lambda: materialize(feature_frontiers(items(spark, d), ITEM_FEATURES, ITEM_FLAGS, PRICE), "item-frontier"))


def item_levels(spark, d):
    """(feature, value, least cost) of the scale fixture."""
    build = lambda: materialize(
        level_table(items(spark, d), ITEM_FEATURES, ITEM_FLAGS, PRICE).select("feature", "value", F.col("min_cost").alias("cost")), "item-levels")
    return once(spark, "item_levels", d, build)


def plan_levels(spark, d):
    build = lambda: materialize(
        level_table(features(spark, d), CORE, C.UNLIMITED_FLAGS, PRICE).select("feature", "value", F.col("min_cost").alias("cost")), "plan-levels")
    return once(spark, "plan_levels", d, build)


def plan_segments(spark, d):
    def build():
        placed = P.positions(plan_levels(spark, d))
        return materialize(P.with_segments(placed, P.change_points(placed)), "plan-segments")

    return once(spark, "plan_segments", d, build)


def skyline_items(spark, d):
    return once(spark, "skyline_items", d, lambda: materialize(efficient_rows(items(spark, d), ITEM_FEATURES, PRICE), "skyline-items"))


def derived(spark, d):
    return once(spark, "derived", d, lambda: materialize(B.without_infinities(B.derive(plans(spark, d))), "derived"))


# --- sources and sinks ----------------------------------------------------------------------------

PLAN_VIEW = ["id", "plan_name", "network", "basic_data", "daily_data", "voice", "agreement", "fee", "original_fee"]


def a1(spark, d):
    raw = plans(spark, d)
    folder = folder_for(spark, "envelopes")
    # envelopes of up to 100 plans each, as a client would post them
    batches = raw.withColumn("batch", F.floor(F.col("id") / 100)).groupBy("batch").agg(F.collect_list(F.struct(*raw.columns)).alias("data"))
    batches.select(F.struct(F.lit("frontier").alias("method")).alias("options"), "data").write.json(folder)
    batch = sources.read_batch(spark, folder, lines=True)
    return batch.rows.select(*PLAN_VIEW, F.lit(batch.options["method"]).alias("method"))


def a1_tolerant(spark, d):
    """Numbers as text, fractions, 0/1 flags and unknown fields, in envelopes with different options."""
    folder = folder_for(spark, "mixed-envelopes")
    one = F.concat(
        F.lit('{"id": '), F.col("id").cast("string"), F.lit(', "voice": '),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit('"'), F.col("voice").cast("string"), F.lit('"'))).when(F.col("id") % 3 == 1, F.concat(F.col("voice").cast("string"), F.lit(".5")))
        .otherwise(F.col("voice").cast("string")), F.lit(', "is_esim": '), F.when(F.col("id") % 2 == 0, F.lit("1")).otherwise(F.lit("false")),
        F.lit(', "colour": "c'), (F.col("id") % 5).cast("string"), F.lit('"}'))
    batches = plans(spark, d).withColumn("batch", F.floor(F.col("id") / 100)).groupBy("batch").agg(F.array_join(F.collect_list(one), ", ").alias("list"))
    method = F.when(F.col("batch") % 2 == 0, "frontier").otherwise("fixed_rates")
    batches.select(F.concat(F.lit('{"options": {"method": "'), method, F.lit('"}, "data": ['), F.col("list"), F.lit("]}")).alias("value")).write.text(folder)
    out = None
    for batch in sources.read_batches(spark, folder):
        rows = batch.rows.select("id", "voice", "is_esim", F.col("extra")["colour"].alias("colour"), F.lit(batch.options["method"]).alias("method"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _scenarios(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    first = part.agg(F.min("p_partkey")).scalar()
    is_base = F.col("p_partkey") == first
    return part.select(
        F.when(is_base, "base").otherwise(F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"),
        F.when(is_base, F.create_map(F.lit("size"), F.col("p_size").cast("double"), F.lit("price"), F.col("p_retailprice"), F.lit("fee"), F.lit(17000.0)))
        .alias("features"),
        F.when(~is_base & (F.col("p_partkey") % 3 == 0), F.create_map(F.lit("size"), F.col("p_size").cast("double")))
        .when(~is_base & (F.col("p_partkey") % 3 == 1), F.create_map(F.lit("price"), F.col("p_retailprice"), F.lit("extra"), F.lit(1.0)))
        .alias("changed_features"))


def a2(spark, d):
    return sources.expand_variants(_scenarios(spark, d))


def a2_maps(spark, d):
    """Map form, for any number of features."""
    maps = sources.variant_maps(_scenarios(spark, d))
    return maps.select("id", "name", F.explode("features").alias("feature", "value"))


def a3(spark, d):
    raw = spark.read.parquet(f"{d}/part.parquet").selectExpr(
        "p_partkey AS id", "CASE p_partkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'False' END AS is_5g", "CASE WHEN p_partkey % 2 = 0 THEN true END AS has_usim",
        "CASE WHEN p_size = 47 THEN 'n/a' ELSE CAST(p_size AS STRING) END AS basic_data_clean", "CAST(p_retailprice AS STRING) AS fee",
        "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 1 END AS is_esim_numeric")
    return sources.normalise_types(raw)


def a4(spark, d):
    folder = folder_for(spark, "plans-csv")
    plans(spark, d).select("id", "plan_name", "network", "daily_data", "voice", "fee").write.option("header", True).csv(folder)
    return sources.read_csv(spark, folder, "id bigint, plan_name string, network string, daily_data double, voice bigint, fee double")


def a5(spark, d):
    base = folder_for(spark, "dispatch")
    few = plans(spark, d).select("id", "plan_name", "fee")
    few.write.option("header", True).csv(f"{base}.csv")
    few.write.parquet(f"{base}.parquet")
    _scenarios(spark, d).write.json(f"{base}.json")
    parts = [
        sources.load(spark, f"{base}.csv").groupBy().agg(F.lit("csv").alias("format"), F.count("*").alias("n"), F.sum(F.col("fee").cast("double")).alias("total")),
        sources.load(spark, f"{base}.parquet").groupBy().agg(F.lit("parquet").alias("format"), F.count("*").alias("n"), F.sum("fee").alias("total")),
        sources.load(spark, f"{base}.json", lines=True).groupBy().agg(F.lit("json").alias("format"), F.count("*").alias("n"), F.sum("size").alias("total")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def a6(spark, d):
    return sources.fill_missing(plans(spark, d)).select("id", "network", "daily_data", "data_exhaustion", "agreement", "discount_period")


def a7(spark, d):
    path = store.save_raw(plans(spark, d), folder_for(spark, "raw"), "t0")
    return spark.read.schema(C.PLAN_SCHEMA).json(path).select(*PLAN_VIEW)


def a8(spark, d):
    _, latest = store.save_processed(features(spark, d), folder_for(spark, "processed"), "t0")
    return rounded(spark.read.schema(features(spark, d).schema).option("header", True).csv(latest).select("id", "total_data", "price_per_gb", "unlimited_type"))


def _stored(spark, d):
    def build():
        root = folder_for(spark, "store")
        ranked = rank_rows(scored(spark, d).select("id", "plan_name", "mvno", "fee", "original_fee", "B", "CS"))
        charts = explain.frontier_points(features(spark, d), CORE)
        store.save_rankings(ranked, frontier_scores(features(spark, d)).cost_structure, root, "frontier", charts)
        return root

    return once(spark, "stored", d, build)


def a9(spark, d):
    return rounded(store.load_rankings(spark, _stored(spark, d)).rankings.select("id", "rank_number", "rank_display", "B", "CS"))


def a10(spark, d):
    kept = store.load_rankings(spark, _stored(spark, d))
    return rounded(kept.cost_structure)


def a11(spark, d):
    store.store_info(spark, _stored(spark, d))
    return store.run_metadata(spark, _stored(spark, d)).select("method", "has_data", "num_plans", "has_charts")


def a12(spark, d):
    ranked = rank_rows(scored(spark, d))
    return rounded(store.response(ranked).select("id", "plan_name", "mvno", "fee", "original_fee", "rank", "B", "CS", "value_ratio"))


# --- feature columns --------------------------------------------------------------------------------

def _b(columns):
    return lambda spark, d: rounded(derived(spark, d).select("id" if "id" not in columns else columns[0], *columns), 6)


def b12(spark, d):
    raw = spark.read.parquet(f"{d}/part.parquet").selectExpr(
        "p_partkey AS id", "CASE p_partkey % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'False' END AS data_sharing", "p_partkey % 2 = 0 AS roaming_support",
        "CASE WHEN p_partkey % 7 > 0 THEN p_size > 25 END AS is_esim")
    return B.with_boolean_flags(raw).select("id", "data_sharing_numeric", "roaming_support_numeric", "is_esim_numeric")


def b18(spark, d):
    return rounded(B.impute_medians(derived(spark, d), exclude=["id"]).select("id", "daily_data", "discount_period", "price_per_gb", "price_unlimited_adjusted"), 6)


def b20(spark, d):
    f = features(spark, d)
    return rounded(f.select("id", *B.present_features(f, ["basic_data_clean", "voice_clean", "not_there", "is_5g"], C.UNLIMITED_FLAGS)))


def b21(spark, d):
    raw = spark.read.parquet(f"{d}/part.parquet").selectExpr(
        "p_partkey AS id", "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_size * 100 AS STRING) END AS tethering_data",
        "CASE WHEN p_partkey % 2 = 0 THEN 'MB' ELSE 'GB' END AS tethering_data_unit",
        "CAST(p_size * 100 AS DOUBLE) AS fee", "CAST((p_partkey % 10) * 500 AS DOUBLE) AS original_fee")
    return rounded(B.upstream_columns(raw).select("id", "tethering_gb", "discount_percentage"))


# --- joins --------------------------------------------------------------------------------------------

def c1(spark, d):
    return efficient_rows(items(spark, d), ITEM_FEATURES, PRICE).select(*ITEM_KEY, *ITEM_FEATURES, PRICE)


def c1_ratio(spark, d):
    return rounded(efficiency(items(spark, d), ITEM_FEATURES, PRICE, skyline_items(spark, d)), 8)


FIVE = {"tens": "CAST(floor(l_quantity / 10) AS DOUBLE)", "l_discount": "l_discount", "l_tax": "l_tax", "line": "CAST(l_linenumber AS DOUBLE)", "rest": "CAST(l_suppkey % 4 AS DOUBLE)"}


def c1_blocks(spark, d):
    """Five features and small boxes, so that many of them are compared."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(*ITEM_KEY, *[f"{e} AS {f}" for f, e in FIVE.items()], "l_extendedprice AS price")
    return efficient_rows(rows, list(FIVE), "price", 100).select(*ITEM_KEY, *FIVE, "price")


def _interpolated(mode, shift, limit=CURVE_POINTS):
    def run(spark, d):
        df = items(spark, d)
        curve = item_frontier(spark, d).filter(F.col("kind") == LIMITED)
        out = price_values(df, curve, {f: known(df, f) * shift for f in ITEM_FEATURES}, mode, limit=limit)
        return rounded(out.select(*ITEM_KEY, *ITEM_FEATURES, *[f"cost_{f}" for f in ITEM_FEATURES]))

    return run


def c4(spark, d, limit=CURVE_POINTS):
    curve = item_frontier(spark, d).filter(F.col("kind") == LIMITED)
    marked = on_frontier(items(spark, d), curve, ITEM_FEATURES, ITEM_FLAGS, PRICE, limit)
    return marked.filter("on_l_quantity OR on_l_discount OR on_l_tax").select(*ITEM_KEY, PRICE, "on_l_quantity", "on_l_discount", "on_l_tax")


def c5(spark, d):
    rows = multi_frontier_scores(features(spark, d), GIVEN_MULTI)
    return rounded(rows.select("id", "B", "CS", "B_frontier", "CS_frontier"))


# --- aggregates -------------------------------------------------------------------------------------

def d1(spark, d):
    return candidates(items(spark, d), ITEM_FEATURES, ITEM_FLAGS, PRICE).filter(F.col("kind") == LIMITED).select("feature", "value", "cost")


def d2(spark, d):
    return candidates(items(spark, d), ITEM_FEATURES, ITEM_FLAGS, PRICE).filter(F.col("kind") == UNLIMITED).select("feature", "cost")


def d3(spark, d):
    return cheapest_unlimited(features(spark, d), C.BASIC_FEATURES)


def d4(spark, d):
    return rounded(level_table(items(spark, d), ITEM_FEATURES, ITEM_FLAGS, PRICE))


def d5(spark, d):
    return rounded(min_increments(items(spark, d), ITEM_FEATURES), 8)


def d9(spark, d):
    # the sum of squared prices has more digits than the order of additions leaves certain in a double
    out, total = sufficient_statistics(items(spark, d), ITEM_FEATURES, PRICE), F.col("sum_product")
    return rounded(out.withColumn("sum_product", F.when((F.col("f1") == PRICE) & (F.col("f2") == PRICE), F.round(total, -3)).otherwise(total)), 0)


def d10(spark, d):
    return rounded(correlations(features(spark, d), C.BASIC_FEATURES), 8)


def d10_high(spark, d):
    return rounded(high_correlations(features(spark, d), C.BASIC_FEATURES), 8)


def d11(spark, d):
    found = P.detect_breakpoints(features(spark, d), CORE)
    rows = [(f, i, float(b)) for f, bps in found.items() for i, b in enumerate(bps)]
    return rounded(spark.createDataFrame(rows, "feature string, position int, breakpoint double"), 6)


def d14(spark, d):
    return stats.column_profile(plans(spark, d)).select("column_name", "null_count", "unique_count")


# --- windows ------------------------------------------------------------------------------------------

def e1(spark, d):
    return item_frontier(spark, d).filter(F.col("kind") == LIMITED).select("feature", "value", "cost")


def e2(spark, d):
    return rounded(rank_rows(scored(spark, d)).select("id", "CS", "rank_number", "rank_display"))


def e3(spark, d):
    whole = scored(spark, d).withColumn("CS", F.round("CS", 1))  # coarse, so that many plans tie
    return rounded(explain.ranks_with_ties(whole).select("id", "CS", "ranking", "display_ranking"))


def e4(spark, d):
    return rounded(rank_rows(scored(spark, d), top_n=50).select("id", "CS", "rank_number"))


def e5(spark, d):
    return P.change_points(P.positions(plan_levels(spark, d))).select("feature", F.col("idx").cast("bigint").alias("idx"), "value", "cost")


def e6(spark, d):
    return P.without_cost_drops(item_levels(spark, d))


def e7(spark, d):
    rates = {f: GIVEN_RATES[f] for f in CORE}
    return P.without_price_jumps(P.positions(plan_levels(spark, d)), rates).select("feature", "value", "cost")


def e8(spark, d):
    points = P.granular_points(features(spark, d), CORE)
    return rounded(P.granular_segments(points))


def e8_premium(spark, d):
    f = features(spark, d)
    return rounded(P.unlimited_intercepts(f, P.granular_points(f, CORE), {c: m for c, m in C.UNLIMITED_FLAGS.items() if c in CORE}))


# --- sets and texts -----------------------------------------------------------------------------------

def f1(spark, d):
    return frontier_rows(features(spark, d), C.BASIC_FEATURES).select("id", "original_fee")


def g1(spark, d):
    f = features(spark, d)
    return f.select("id", text.with_commas(F.col("original_fee")).alias("whole_fee"), text.with_commas(F.col("fee") / 8).alias("part_fee"),
                    text.with_commas(F.when(F.col("id") % 2 == 0, F.col("fee"))).alias("gap_fee"))


def g2(spark, d):
    return plans(spark, d).select("id", text.shortened(F.col("plan_name"), 12).alias("short_name"))


def g3(spark, d):
    f = features(spark, d)
    return f.select("id", text.richness(f, CORE).alias("richness"))


def g4(spark, d):
    f = features(spark, d)
    return f.select("id", text.spec_text(f, CORE).alias("specs"))


def g5(spark, d):
    f = features(spark, d)
    return f.select("id", text.other_spec_text(f, CORE, "basic_data_clean").alias("other_specs"))


def g6(spark, d):
    return text.plan_table(rank_rows(scored(spark, d)))


def g7(spark, d):
    return rounded(text.storable(scored(spark, d).select("id", "B", "CS", F.when(F.col("id") % 2 == 0, F.col("CS")).alias("gap"))))


# --- scores -------------------------------------------------------------------------------------------

def h1(spark, d):
    return feature_frontiers(features(spark, d), C.BASIC_FEATURES).select("kind", "feature", F.when(F.col("kind") == LIMITED, F.col("value")).alias("value"), "cost")


def h2(spark, d):
    return rounded(scored(spark, d).select("id", *[c for c in scored(spark, d).columns if c.startswith("contribution_")]))


def h4(spark, d):
    return rounded(frontier_scores(features(spark, d)).rows.select("id", "B", "CS"))


def h5(spark, d):
    return rounded(frontier_scores(features(spark, d)).cost_structure)


def h6(method):
    return lambda spark, d: rounded(cs_ratio(features(spark, d), method, on_failure="raise").rows.select("id", "B", "CS"))


def h7(spark, d):
    return rounded(fixed_rate_scores(features(spark, d), GIVEN).select("id", "B_fixed_rates", "CS_fixed_rates", "B", "CS"))


def h8(spark, d):
    return rounded(multi_frontier_scores(features(spark, d), GIVEN_MULTI).select("id", "B_multi_frontier", "CS_multi_frontier"))


# --- regressions -----------------------------------------------------------------------------------

TWO = ["l_quantity", "l_discount"]


def _fit(name, build):
    return lambda spark, d: rounded(once(spark, f"fit-{name}", d, lambda: build(spark, d)).table(spark), 6)


def i1_fit(spark, d):
    return once(spark, "fit-efficient", d, lambda: R.fit_efficient(features(spark, d), B.present_features(features(spark, d), C.BASIC_FEATURES)))


def _line(spark, b0, beta, names):
    rows = [("1", float(b0))] + [(f, float(b)) for f, b in zip(names, beta)]
    return rounded(spark.createDataFrame(rows, "feature string, coefficient double"), 4)


def i2(spark, d):
    g = gram(skyline_items(spark, d).filter(F.col(PRICE) > 0), TWO, PRICE)
    return _line(spark, *solve.projected(g, [C.efficiency_bounds(f) for f in TWO], 1.0), TWO)


def i3(spark, d):
    g = gram(skyline_items(spark, d).filter(F.col(PRICE) > 0), TWO, PRICE)
    return _line(spark, *solve.equal_weights(g, [(1.0, 20000.0)] * 2), TWO)


def i5(spark, d):
    return _line(spark, *solve.unconstrained(gram(items(spark, d), TWO, PRICE), 0.0, False), TWO)


def i4_fit(spark, d):
    return once(spark, "fit-whole", d, lambda: R.fit_whole_table(features(spark, d), C.BASIC_FEATURES))


def i6_fit(spark, d):
    return once(spark, "fit-frontier", d, lambda: R.fit_frontier_rows(features(spark, d), C.BASIC_FEATURES))


def i9(spark, d):
    g = gram(features(spark, d), C.BASIC_FEATURES, "original_fee")
    _, audit = redistribute.average_collinear(C.BASIC_FEATURES, [GIVEN_RATES[f] for f in C.BASIC_FEATURES], g.correlation())
    return rounded(redistribute.audit_table(spark, audit), 6)


def i1_items(spark, d):
    g = gram(skyline_items(spark, d).filter(F.col(PRICE) > 0), TWO, PRICE)
    return _line(spark, *solve.bounded(g, [C.efficiency_bounds(f) for f in TWO], 1.0, True), TWO)


def i4_items(spark, d):
    fit = R.fit_whole_table(items(spark, d), TWO)
    return _line(spark, fit.intercept, fit.beta, TWO)


def h6_items(spark, d):
    """The default method from the rows to the score: efficient rows, bounded ridge, B and CS."""
    return rounded(cs_ratio(items(spark, d), "fixed_rates", features=TWO).rows.select(*ITEM_KEY, "fee", "B", "CS"))


FIT_COLUMNS = ["feature", "coefficient", "lower", "within_bounds", "unconstrained", "adjustment", "base_cost", "rows_used", "rows_total", "method"]


def i7_items(spark, d):
    return rounded(R.fit_prices(items(spark, d), TWO).table(spark).select(*FIT_COLUMNS))


def i8_items(spark, d):
    return rounded(R.fit_whole_table(items(spark, d), TWO).table(spark).select(*FIT_COLUMNS))


TWO_PLAN = ["voice_clean", "tethering_gb"]  # one with an unlimited flag


def i6_items(spark, d):
    return rounded(R.fit_frontier_rows(features(spark, d), TWO_PLAN).table(spark).select("feature", "coefficient", "rows_used"))


def h6_multi_items(spark, d):
    return rounded(cs_ratio(features(spark, d), "multi_frontier", features=TWO_PLAN).rows.select("id", "B", "CS"))


def l1_items(spark, d):
    """The objective that all solvers of the efficient-row fit should reach, and that of the clipped solution."""
    g = gram(efficient_rows(items(spark, d), TWO, PRICE), TWO, PRICE)
    bounds = [C.efficiency_bounds(f) for f in TWO]
    rows = [(name, *(lambda b0, b: (float(b0), *map(float, b), solve.objective(g, b, b0, 1.0)))(*fit)) for name, fit in (
        ("bounded", solve.bounded(g, bounds, 1.0, True)), ("from_upper", solve.bounded(g, bounds, 1.0, True, start=[1e6, 1e6])), ("projected", solve.projected(g, bounds, 1.0)))]
    return rounded(spark.createDataFrame(rows, "solver string, intercept double, l_quantity double, l_discount double, objective double"), 2)


def i10_items(spark, d):
    g = gram(items(spark, d), TWO, PRICE)
    out = commonality.redistribute(_two_fits(spark, d), TWO, [300.0, 40.0], g.correlation(), partner="first")
    return rounded(out.drop("correlation"), 6)


def i11_items(spark, d):
    return rounded(commonality.subset_fits(spark, gram(items(spark, d), ITEM_FEATURES, PRICE)), 8)


def _fits(spark, d):
    def build():
        return materialize(commonality.subset_fits(spark, gram(features(spark, d), CORE, "original_fee")), "subset-fits")

    return once(spark, "subset_fits", d, build)


def i10(spark, d):
    g = gram(features(spark, d), CORE, "original_fee")
    return rounded(commonality.redistribute(_fits(spark, d), CORE, [GIVEN_RATES[f] for f in CORE], g.correlation(), partner="first"), 6)


def i11(spark, d):
    return rounded(_fits(spark, d), 8)


def _two_fits(spark, d):
    return commonality.subset_fits(spark, gram(items(spark, d), TWO, PRICE))


def i12(spark, d):
    return rounded(commonality.effects(_two_fits(spark, d), TWO), 8)


def i13(spark, d):
    return rounded(commonality.variance_decomposition(_two_fits(spark, d), TWO), 6)


def i14(spark, d):
    return rounded(commonality.commonality_report(_two_fits(spark, d), TWO), 6)


def i14_clip(spark, d):
    # the means of the features serve as coefficients, so that the result depends on the data
    f = features(spark, d)
    means = f.agg(*[F.avg(c).alias(c) for c in C.BASIC_FEATURES]).unpivot([], C.BASIC_FEATURES, "feature", "coefficient")
    return rounded(commonality.economic_clips(means), 4)


def i14_pairs(spark, d):
    return rounded(redistribute.collinearity_report(features(spark, d), C.BASIC_FEATURES, GIVEN_RATES), 6)


# --- piecewise and encodings ------------------------------------------------------------------------

BREAKS = {"basic_data_clean": [10.0, 30.0], "voice_clean": [200.0], "tethering_gb": []}


def j1(spark, d):
    return rounded(P.segment_lines(plan_segments(spark, d)).select("feature", "start_feature", "end_feature", "slope", "intercept", "points"))


def j2(spark, d):
    return rounded(P.robust_segments(plan_segments(spark, d)).drop("segment"))


def j3(spark, d):
    f = P.segment_features(features(spark, d), list(BREAKS), BREAKS)
    return rounded(f.select("id", "basic_data_clean_seg_0", "basic_data_clean_seg_1", "basic_data_clean_seg_2", "voice_clean_seg_0", "voice_clean_seg_1"))


def j4(spark, d):
    f = features(spark, d)
    model = P.PiecewiseModel().fit(f, ["basic_data_clean", "voice_clean", "tethering_gb"])
    return rounded(model.predict(f).select("id", "predicted_cost"))


def j4_two(spark, d):
    f = features(spark, d)
    model = P.PiecewiseModel({"voice_clean": [200.0]}).fit(f, ["voice_clean"])
    return rounded(model.predict(f).select("id", "predicted_cost"))


def j5(spark, d):
    f = features(spark, d)
    return f.select("id", P.marginal_cost(F.col("basic_data_clean"), [10.0, 30.0], [100.0, 50.0, 25.0]).alias("data_rate"),
                    P.marginal_cost(F.col("voice_clean"), [200.0], [9.0, 4.0]).alias("voice_rate"))


def j6(spark, d):
    segmented = plan_segments(spark, d)
    points = P.cumulative_costs(segmented, P.robust_segments(segmented), 1000.0, {f: GIVEN_RATES[f] for f in CORE})
    return rounded(points)


def j7(spark, d):
    out = marginal_frontier(features(spark, d), GIVEN_RATES, GIVEN_INTERCEPT, CORE)
    return rounded(out.points)


def j8_given(spark, d):
    return rounded(whole_table_marginal_frontier(features(spark, d), CORE, fit=GIVEN).points)


def j8(spark, d):
    return rounded(whole_table_marginal_frontier(features(spark, d), CORE, fit=R.fit_prices(features(spark, d), CORE)).points)


def j9(spark, d):
    f = features(spark, d)
    points = P.granular_points(f, CORE)
    flags = {c: m for c, m in C.UNLIMITED_FLAGS.items() if c in CORE}
    out = P.bundle_costs(f, points, P.unlimited_intercepts(f, points, flags), CORE, flags)
    return rounded(out.select("id", *[f"segment_cost_{c}" for c in CORE], "intercept_cost", "total_cost"))


def j10_entries(spark, d):
    """Long form, for any number of levels."""
    return encode.dummy_entries(plans(spark, d).select("id", "mno", "network", "mvno"), ["mno", "network", "mvno"], "id")


def j10(spark, d):
    out = encode.dummy_columns(plans(spark, d).select("id", "mno", "network"), ["mno", "network"])
    return out.select("id", "mno_M1", "mno_M2", "network_LTE")


def j11(spark, d):
    f = features(spark, d)
    out = encode.premium_columns(f, {"voice_clean": "voice_unlimited", "message_clean": "message_unlimited"})
    return rounded(out.select("id", "voice_clean_unlimited_premium", "message_clean_unlimited_premium"))


def j12(spark, d):
    return encode.mixed_column(features(spark, d), "voice_clean", "voice_unlimited").select("id", "voice_clean_mixed", "voice_clean_is_synthetic")


def j13(spark, d):
    return encode.with_segment(features(spark, d), "voice_unlimited").select("id", "segment", "voice_clean")


def j14(spark, d):
    return rounded(encode.categorical_marginal_costs(features(spark, d), "voice_clean", "voice_unlimited", GIVEN_RATES["voice_clean"]))


def j15(spark, d):
    out = encode.apply_encoding(features(spark, d), "dummy_variables")
    return out.select("id", *[c for c in out.columns if c.endswith("unlimited_1")])


# --- explanations and checks --------------------------------------------------------------------------

def k3(spark, d):
    f = features(spark, d)
    given = spark.createDataFrame([(c, GIVEN_RATES[c]) for c in CORE], "feature string, coefficient double")
    return rounded(explain.coefficient_chart(f, given))


def k3_compare(spark, d):
    f = features(spark, d)
    rows = multi_frontier_scores(f, GIVEN_MULTI)
    given = spark.createDataFrame(list(GIVEN_MULTI.coefficients.items()), "feature string, coefficient double")
    return rounded(explain.method_comparison(rows, frontier_scores(f).cost_structure, given))


def k4_ranges(spark, d):
    f = features(spark, d)
    return rounded(explain.matrix_ranges(explain.frontier_matrix(f, C.BASIC_FEATURES), ["basic_data_clean", "voice_clean", "message_clean", "tethering_gb"]))


def l1(spark, d):
    fit = i4_fit(spark, d)
    return validate.optimiser_consistency(spark, fit.gram, fit.bounds).select("is_consistent", "successful_optimizations", "is_optimal")


def l2(spark, d):
    # coefficients are the means of the features, so that the checks depend on the data
    f = features(spark, d)
    means = f.agg(*[F.avg(c).alias(c) for c in C.BASIC_FEATURES]).unpivot([], C.BASIC_FEATURES, "feature", "coefficient")
    return rounded(validate.economic_checks(means))


def l3(spark, d):
    return rounded(validate.cross_validation(features(spark, d), CORE), 6)


def l3_one(spark, d):
    f = features(spark, d)
    return rounded(validate.cross_validation(f, ["tethering_gb"], fold=F.col("id") % 5), 6)


def l4(spark, d):
    rows = fixed_rate_scores(features(spark, d), GIVEN)
    return rounded(validate.residual_checks(rows, "B", "fee"), 6)


def l4_quartiles(spark, d):
    rows = fixed_rate_scores(features(spark, d), GIVEN)
    return rounded(validate.residual_quartiles(rows, "B", "fee").withColumn("quartile", F.col("quartile").cast("int")))


def l5(spark, d):
    rows = fixed_rate_scores(features(spark, d), GIVEN)
    residual = validate.residual_checks(rows, "B", "fee").select("is_normal", "is_homoscedastic", "outlier_percentage")
    checks = residual.withColumns({
        "is_consistent": F.lit(True), "successful_optimizations": F.lit(5), "scale_ok": F.lit(True), "premium_ok": F.lit(True), "positive_ok": F.lit(False),
        "mean_r2": F.lit(0.65), "is_stable": F.lit(True)})
    return validate.overall_score(checks).select("optimization_score", "economic_score", "prediction_score", "residual_score", "total_score", "grade")


def l6(spark, d):
    return rounded(validate.full_report(features(spark, d), i4_fit(spark, d), CORE))


def m1(spark, d):
    source, root = folder_for(spark, "snapshots"), folder_for(spark, "market")
    market = folder_for(spark, "market-files")
    plans(spark, d).repartition(3).write.json(market)  # the stand-in market as a snapshot of several files
    announce(spark, source, "stand-in", market)
    query = rank_stream(spark, source, root, folder_for(spark, "stream"), "frontier")
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return rounded(store.load_rankings(spark, root).rankings.select("id", "B", "CS", "rank_number"))


QUERIES = {
    "A1_batch_source": a1, "A1_tolerant_source": a1_tolerant, "A2_variant_expansion": a2, "A2_variant_maps": a2_maps, "A3_type_normalisation": a3, "A4_csv_source": a4, "A5_format_dispatch": a5,
    "A6_fill_missing": a6, "A7_raw_snapshot": a7, "A8_processed_snapshot": a8, "A9_ranking_store": a9, "A10_stored_cost_structure": a10,
    "A11_run_metadata": a11, "A12_response": a12,
    **{name: _b(columns) for name, columns in B_COLUMNS.items()},
    "B5_finite_maxima": lambda s, d: B.finite_maxima(B.coerce_mixed(plans(s, d))),
    "B12_boolean_flags": b12, "B18_median_imputation": b18, "B19_key_statistics": lambda s, d: rounded(B.key_statistics(features(s, d))),
    "B20_feature_selection": b20, "B21_upstream_columns": b21,
    "C1_efficient_rows": c1, "C1_efficient_rows_five_features": c1_blocks, "C1_efficiency_ratio": c1_ratio, "C2_interpolation": _interpolated(CLAMP, 1.07), "C3_extrapolation": _interpolated(EXTEND, 1.3),
    "C2_interpolation_joined": _interpolated(CLAMP, 1.07, 1), "C3_extrapolation_joined": _interpolated(EXTEND, 1.3, 1),
    "C4_frontier_semi_join": c4, "C4_frontier_semi_join_joined": lambda s, d: c4(s, d, 1), "C5_method_columns": c5, "C6_base_variants": a2,
    "D1_frontier_candidates": d1, "D2_cheapest_unlimited": d2, "D3_cheapest_unlimited_named": d3, "D4_level_table": d4, "D5_min_increment": d5,
    "D6_ranking_statistics": lambda s, d: rounded(stats.ranking_statistics(scored(s, d))),
    "D7_ratio_summary": lambda s, d: rounded(stats.ratio_summary(scored(s, d))),
    "D8_outlier_filter": lambda s, d: stats.without_outliers(items(s, d), PRICE, 2.0).select(*ITEM_KEY, PRICE),
    "D8_outlier_counts": lambda s, d: stats.outlier_counts(items(s, d), PRICE, 2.0),
    "D9_sufficient_statistics": d9, "D10_correlations": d10, "D10_high_correlations": d10_high, "D11_breakpoints": d11,
    "D12_feature_profile": lambda s, d: rounded(stats.feature_profile(items(s, d), ITEM_FEATURES)),
    "D13_diagonal_range": lambda s, d: rounded(stats.diagonal_range(scored(s, d))),
    "D14_column_profile": d14, "D15_frontier_summary": lambda s, d: frontier_summary(features(s, d), C.BASIC_FEATURES),
    "E1_monotone_frontier": e1, "E2_rank_by_cs": e2, "E3_rank_with_ties": e3, "E4_top_k": e4, "E5_change_points": e5, "E6_running_max_filter": e6,
    "E7_light_outlier_filter": e7, "E8_granular_segments": e8, "E8_unlimited_premium": e8_premium,
    "F1_frontier_rows": f1, "F2_point_classes": lambda s, d: explain.point_classes(features(s, d), CORE), "F3_dummy_columns": j10,
    "G1_number_text": g1, "G2_short_names": g2, "G3_richness": g3, "G4_spec_text": g4, "G5_other_spec_text": g5, "G6_plan_table": g6, "G7_storable": g7,
    "H1_feature_frontiers": h1, "H2_contributions": h2, "H3_baseline": lambda s, d: rounded(scored(s, d).select("id", "B")), "H4_cs_ratio": h4,
    "H5_marginal_costs": h5, "H6_fixed_rates": h6("fixed_rates"), "H6_multi_frontier": h6("multi_frontier"), "H6_frontier": h6("frontier"),
    "H7_given_rates": h7, "H8_given_multi_rates": h8, "H9_efficiency_quadrants": lambda s, d: rounded(explain.efficiency_quadrants(scored(s, d))),
    "I1_bounded_ridge": lambda s, d: rounded(i1_fit(s, d).table(s), 6), "I2_projected_ridge": i2, "I3_equal_weights": i3,
    "I4_whole_table": lambda s, d: rounded(i4_fit(s, d).table(s), 6), "I5_unconstrained": i5, "I6_frontier_row_fit": lambda s, d: rounded(i6_fit(s, d).table(s), 6),
    "I7_price_fit": lambda s, d: rounded(R.fit_prices(features(s, d), CORE).table(s), 6), "I8_coefficient_table": lambda s, d: rounded(i1_fit(s, d).table(s), 6),
    "I9_simple_redistribution": i9, "I10_commonality_redistribution": i10, "I11_subset_r2": i11, "I12_effects": i12, "I13_variance_decomposition": i13,
    "I14_commonality_report": i14, "I14_economic_clip": i14_clip,
    "J1_segment_lines": j1, "J2_robust_segments": j2, "J3_segment_features": j3, "J4_piecewise_prediction": j4, "J5_marginal_lookup": j5,
    "J6_cumulative_cost": j6, "J7_marginal_frontier": j7, "J8_whole_table_frontier": j8, "J9_bundle_cost": j9, "J10_dummy_encoding": j10, "J10_dummy_entries": j10_entries,
    "J11_premium_encoding": j11, "J12_mixed_encoding": j12, "J13_segments": j13, "J14_categorical_costs": j14, "J15_encoding_dispatch": j15,
    "K1_frontier_points": lambda s, d: explain.frontier_points(features(s, d), CORE),
    "K2_residual_table": lambda s, d: rounded(explain.residual_table(features(s, d), CORE)),
    "K3_coefficient_chart": k3, "K3_method_comparison": k3_compare, "K4_frontier_matrix": lambda s, d: explain.frontier_matrix(features(s, d), C.BASIC_FEATURES),
    "K4_matrix_ranges": k4_ranges,
    "L1_optimiser_consistency": l1, "L2_economic_checks": l2, "L3_cross_validation": l3, "L4_residual_checks": l4, "L4_residual_quartiles": l4_quartiles,
    "L5_score": l5, "L6_full_report": l6,
    "H6_fixed_rates_items": h6_items, "H6_multi_frontier_items": h6_multi_items, "I6_frontier_row_fit_items": i6_items, "I7_price_fit_items": i7_items, "I8_coefficient_table_items": i8_items, "L1_objective_items": l1_items,
    "I1_bounded_ridge_items": i1_items, "I4_whole_table_items": i4_items, "I10_redistribution_items": i10_items, "I11_subset_r2_items": i11_items,
    "J4_two_segments": j4_two, "J8_given_rates": j8_given, "L3_one_feature": l3_one,
    "I14_collinearity_report": i14_pairs, "M1_snapshot_stream": m1,
}


def flagship(spark, d):
    """Features, frontiers, contributions, ratio and the ten best plans."""
    table = B.prepare_features(plans(spark, d), exclude=["id"])
    return rank_by_cs(table, "frontier", top_n=10).select("id", "plan_name", "mvno", "fee", "original_fee", "B", "CS", "rank_number", "rank_display")


QUERIES["Z1_flagship_top10"] = lambda s, d: rounded(flagship(s, d))
