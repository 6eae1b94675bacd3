import pytest
from pyspark.sql import functions as F

from specval.operators import encode
from specval.operators.features import derive, finite_maxima, impute_medians, prepare_features
from specval.plans.cost_spec import cs_ratio, frontier_scores, rank_by_cs, rank_rows
from specval.plans.explain import ranks_with_ties

COLUMNS = ("id bigint, plan_name string, network string, basic_data string, daily_data string, data_exhaustion string, voice bigint, message string, "
           "fee double, original_fee double, discount_period bigint, agreement boolean, agreement_period bigint, esim_fee_status string, data_sharing boolean")


def plan(spark, **values):
    base = dict(id=1, plan_name="p", network="LTE", basic_data="5", daily_data="0", data_exhaustion=None, voice=100, message="50", fee=100.0,
                original_fee=200.0, discount_period=6, agreement=None, agreement_period=None, esim_fee_status=None, data_sharing=None)
    base.update(values)
    return derive(spark.createDataFrame([tuple(base.values())], COLUMNS)).first()


@pytest.mark.parametrize("value, unlimited, clean", [("999", 1, 0), ("9999", 1, 0), ("-1", 0, 0), ("n/a", 0, 0), ("12.5", 0, 12.5), (None, 0, 0)])
def test_basic_data(spark, value, unlimited, clean):
    r = plan(spark, basic_data=value)
    assert (r["basic_data_unlimited"], r["basic_data_clean"]) == (unlimited, clean)


@pytest.mark.parametrize("value, unlimited, missing, clean", [
    (999, 1, 0, 0), (9996, 1, 0, 0), (19990, 1, 0, 0), (99, 0, 0, 99), (990, 0, 0, 990), (-1, 0, 1, 0)])
def test_voice_marker(spark, value, unlimited, missing, clean):
    r = plan(spark, voice=value, message=str(value))
    assert (r["voice_unlimited"], r["voice_na"], r["voice_clean"]) == (unlimited, missing, clean)
    assert (r["message_unlimited"], r["message_na"], r["message_clean"]) == (unlimited, missing, clean)


@pytest.mark.parametrize("text, speed", [("1Mbps", 1), ("0.4 Mbps", 0.4), ("400Kbps", 0), ("fast Mbps", 0), (None, 0)])
def test_throttle_speed(spark, text, speed):
    assert plan(spark, data_exhaustion=text)["speed_when_exhausted"] == speed


@pytest.mark.parametrize("basic, exhaustion, kind, number", [
    ("999", None, "unlimited_speed", 3), ("999", "1Mbps", "throttled_unlimited", 2), ("5", "1Mbps", "throttled_unlimited", 2), ("5", None, "limited", 0)])
def test_unlimited_type(spark, basic, exhaustion, kind, number):
    r = plan(spark, basic_data=basic, data_exhaustion=exhaustion)
    assert (r["unlimited_type"], r["unlimited_type_numeric"]) == (kind, number)
    assert r["data_stops_after_quota"] + r["data_throttled_after_quota"] + r["data_unlimited_speed"] == 1


@pytest.mark.parametrize("period, listed, want", [(0, 200.0, 100.0), (6, 200.0, 200.0), (6, 0.0, 100.0), (None, 200.0, 200.0), (None, -5.0, 100.0), (6, None, None)])
def test_list_price(spark, period, listed, want):
    assert plan(spark, discount_period=period, original_fee=listed)["original_fee"] == want


def test_flags_and_defaults(spark):
    r = plan(spark, esim_fee_status=None, data_sharing=True, agreement=True)
    assert r["esim_supported"] == 1 and r["esim_is_free"] == 0 and r["data_sharing_numeric"] == 1
    assert r["has_agreement"] == 1 and r["agreement_period"] == 0 and r["is_5g"] == 0
    assert plan(spark, esim_fee_status="UNSUPPORTED")["esim_supported"] == 0
    assert plan(spark, esim_fee_status="FREE_ON_ACTIVATION")["esim_is_free"] == 1
    bare = derive(spark.createDataFrame([(1, 5.0, 6.0)], "id int, fee double, original_fee double")).first()
    assert bare["is_5g"] == 0 and bare["voice_clean"] == 0 and bare["total_data"] == 0 and bare["unlimited_type"] == "limited"


def test_processed_columns_are_kept(spark):
    df = spark.createDataFrame([(1, 7.0, 0, 3.0, 9.0, 9.0)], "id int, basic_data_clean double, basic_data_unlimited int, voice_clean double, fee double, original_fee double")
    r = derive(df).first()
    assert r["basic_data_clean"] == 7 and r["voice_clean"] == 3 and r["total_data"] == 7
    assert finite_maxima(spark.createDataFrame([(1,)], "id int")).first().asDict() == {"max_basic_data": 100.0, "max_daily_data": 10.0}


def test_median_imputation(spark):
    rows = [(i, float(v) if v is not None else None, int(v) if v is not None else None) for i, v in enumerate([1, 2, 3, 10, None])]
    df = spark.createDataFrame(rows, "id int, a double, b int")
    for limit in (1000, 2):
        out = impute_medians(df, exact_rows=limit).filter("id = 4").first()
        assert out["a"] == 2.5 and out["b"] == 2.5
    assert impute_medians(df, exclude=["b"]).filter("id = 4").first()["b"] is None


def test_zero_fee_ranks_first_and_methods(spark, folder):
    from specval.fixtures import plans

    table = prepare_features(plans(spark, folder), exclude=["id"])
    with pytest.raises(ValueError):
        cs_ratio(table, "nope")
    with pytest.raises(ValueError):
        cs_ratio(table, "frontier", "nope")
    scored = frontier_scores(table).rows
    parts = [c for c in scored.columns if c.startswith("contribution_")]
    total = sum((F.col(c) for c in parts), F.lit(0.0))
    assert scored.filter(F.abs(total - F.col("B")) > 1e-6).count() == 0
    top = rank_by_cs(table, "frontier", top_n=3).orderBy("rank_number").collect()
    assert [r["rank_number"] for r in top] == [1, 2, 3] and top[0]["CS"] == float("inf")
    whole = rank_rows(scored).select("id", "rank_number")
    assert {tuple(r) for r in rank_rows(scored, rows_per_bucket=25).select("id", "rank_number").collect()} == {tuple(r) for r in whole.collect()}
    alias, fixed = cs_ratio(table, "linear_decomposition"), cs_ratio(table, "fixed_rates")
    assert alias.method == fixed.method == "fixed_rates"
    assert alias.rows.select(F.sum("B")).first() == fixed.rows.select(F.sum("B")).first()
    # too few rows for the fit: raised, or scored by frontier on request
    few = table.limit(3)
    assert cs_ratio(few, "multi_frontier", on_failure="frontier").method == "frontier_after_failed_multi_frontier"
    with pytest.raises(ValueError):
        cs_ratio(few, "multi_frontier")


def test_more_quantity_never_lowers_the_frontier_baseline(spark, folder):
    from specval.fixtures import plans

    table = prepare_features(plans(spark, folder), exclude=["id"])
    scored = frontier_scores(table, ["voice_clean", "voice_unlimited"]).rows.filter("voice_unlimited = 0")
    rows = scored.select("voice_clean", "B").distinct().orderBy("voice_clean").collect()
    assert all(a["B"] <= b["B"] for a, b in zip(rows, rows[1:]))


def test_tie_ranks(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 2.0), (4, 1.0)], "id int, CS double")
    out = {r["id"]: (r["ranking"], r["display_ranking"]) for r in ranks_with_ties(df).collect()}
    assert out == {1: (1, "1위"), 2: (2, "공동 2위"), 3: (2, "공동 2위"), 4: (4, "4위")}
    up = {r["id"]: r["ranking"] for r in ranks_with_ties(df, ascending=True).collect()}
    assert up == {4: 1, 2: 2, 3: 2, 1: 4}


def test_encodings(spark):
    rows = [(1, 0, 10.0, 100.0), (2, 0, 11.0, 200.0), (3, 0, 50.0, 900.0), (4, 1, 0.0, 1000.0)]
    df = spark.createDataFrame(rows, "id int, voice_unlimited int, voice_clean double, original_fee double")
    flags = {"voice_clean": "voice_unlimited"}
    assert encode.unlimited_premiums(df, flags) == {"voice_clean": 1000.0 - 150.0}
    mixed = {r["id"]: (r["voice_clean_mixed"], r["voice_clean_is_synthetic"]) for r in encode.mixed_column(df, "voice_clean", "voice_unlimited").collect()}
    assert mixed[4] == (100.0, 1) and mixed[2] == (11.0, 0)
    assert encode.mixed_column(df, "voice_clean", "voice_unlimited", 77.0).filter("id = 4").first()["voice_clean_mixed"] == 77.0
    assert set(encode.split_segments(df, "voice_clean", "voice_unlimited")) == {"limited", "unlimited"}
    assert encode.split_segments(df, "voice_clean", "nope") == {}
    cost = encode.categorical_marginal_costs(df, "voice_clean", "voice_unlimited", 5.0).first()
    assert cost["unlimited"] == pytest.approx((1000 - 400) / (100 - 71 / 3)) and cost["limited"] == 5.0
    assert encode.apply_encoding(df).columns == df.columns
    assert "voice_unlimited_1" in encode.apply_encoding(df, "dummy_variables", flags).columns
    assert "voice_clean_unlimited_premium" in encode.apply_encoding(df, "premium_encoding", flags).columns
    with pytest.raises(ValueError):
        encode.apply_encoding(df, "nope")


def test_plans_of_a_file_with_one_row_group_go_to_many_tasks(spark, tmp_path, folder, monkeypatch):
    from specval import fixtures

    rows = spark.read.parquet(f"{folder}/part.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    want = sorted(map(str, fixtures.plans(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(fixtures, "ROWS_PER_TASK", 30)
    dealt = fixtures.plans(spark, str(tmp_path))
    sizes = [len(p) for p in dealt.select("id").rdd.glom().collect()]
    assert len(sizes) == -(-rows.count() // 30) and max(sizes) <= 40
    assert sorted(map(str, dealt.collect())) == want
