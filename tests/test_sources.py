import json

import pytest
from pyspark.sql import functions as F

from specval import config as C
from specval.fixtures import plans
from specval.functions import text
from specval.operators.features import prepare_features
from specval.plans import explain
from specval.plans.process import process
from specval.sources import plans as sources, store
from specval.streaming.market import announce, rank_stream


def write(path, value):
    path.write_text(json.dumps(value))
    return str(path)


PLANS = [{"id": i, "plan_name": f"p{i}", "network": "5G" if i % 2 else "LTE", "mvno": "m", "basic_data": str(i), "voice": 100 + i, "message": 10, "fee": 1000.0 + 10 * i,
          "original_fee": 2000.0 + 7 * i, "discount_period": 6, "agreement": False, "agreement_period": 0} for i in range(1, 40)]


def test_batch_array_and_envelope(spark, tmp_path):
    batch = sources.read_batch(spark, write(tmp_path / "a.json", PLANS), lines=False)
    assert batch.rows.count() == 39 and batch.options == C.DEFAULT_OPTIONS
    envelope = sources.read_batch(spark, write(tmp_path / "b.json", {"options": {"method": "frontier", "includeComparison": True}, "data": PLANS[:5]}))
    assert envelope.rows.count() == 5 and envelope.options["method"] == "frontier" and envelope.options["feeColumn"] == "fee"
    mixed = sources.read_batch(spark, write(tmp_path / "c.json", [{"id": 1, "basic_data": 5}, {"id": 2, "basic_data": "999"}])).rows
    assert [r["basic_data"] for r in mixed.orderBy("id").collect()] == ["5", "999"]


def test_tolerant_batches(spark, tmp_path):
    path = tmp_path / "m.json"
    lines = [{"options": {"method": "frontier"}, "data": [{"id": 1, "voice": "200", "is_esim": 1, "color": "red"}, {"id": "2", "voice": 100.5, "is_esim": "false"}]},
             {"options": {"method": "fixed_rates"}, "data": [{"id": 3, "voice": None, "is_esim": 0, "deep": {"a": [1]}}]}, {"id": 4, "voice": "n/a"}, {"foo": 1}, {"data": []}]
    path.write_text("\n".join([*map(json.dumps, lines), "not json", ""]))
    found = {b.options["method"]: b for b in sources.read_batches(spark, str(path))}
    assert C.DEFAULT_OPTIONS["method"] == "fixed_rates"
    assert {m: sorted(r["id"] for r in b.rows.collect()) for m, b in found.items()} == {"frontier": [1, 2], "fixed_rates": [3, 4]}
    rows = {r["id"]: r for b in sources.read_batches(spark, str(path)) for r in b.rows.collect()}
    assert [rows[i]["voice"] for i in (1, 2, 3, 4)] == [200, 100, None, None] and [rows[i]["is_esim"] for i in (1, 2, 3, 4)] == [True, False, False, None]
    assert rows[1]["extra"] == {"color": "red"} and rows[3]["extra"] == {"deep": '{"a":[1]}'}
    assert sorted(r["reason"] for r in found["frontier"].rejects.collect()) == ["no plans in it", "not a plan"]
    with pytest.raises(ValueError):
        sources.read_batch(spark, str(path))


@pytest.mark.parametrize("content", ["[]", '{"foo": 1}', "not json", '{"options": {}, "data": []}'])
def test_batch_rejects(spark, tmp_path, content):
    path = tmp_path / "bad.json"
    path.write_text(content)
    with pytest.raises(ValueError):
        sources.read_batch(spark, str(path))


def test_scenarios(spark, tmp_path):
    items = [{"id": "base", "name": "b", "features": {"fee": 10, "voice_clean": 3, "is_5g": 0}},
             {"id": "v1", "name": "n", "changed_features": {"voice_clean": 9}}, {"id": "v2", "name": "m", "features": {"fee": 1, "extra": 2}}, {"id": "v3", "name": "same"}]
    out = {r["id"]: r for r in sources.load(spark, write(tmp_path / "s.json", items)).collect()}
    assert out["v1"]["voice_clean"] == 9 and out["v1"]["fee"] == 10 and out["v2"]["fee"] == 1 and out["v2"]["voice_clean"] == 3
    assert out["v2"]["extra"] == 2 and out["v3"]["fee"] == 10 and out["base"]["is_5g"] == 0
    plain = sources.expand_variants(spark.createDataFrame([("a", "x", {"k": 1.0}, None)], "id string, name string, features map<string,double>, changed_features map<string,double>"))
    assert plain.first()["k"] == 1.0


def test_csv_and_dispatch(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,voice_clean,name\n1,,x\n2,5.5,\n")
    rows = {r["id"]: r for r in sources.load(spark, str(tmp_path / "t.csv")).collect()}
    assert rows[1]["voice_clean"] == 0 and rows[2]["name"] == "0"
    assert sources.looks_processed(sources.read_csv(spark, str(tmp_path / "t.csv")))
    with pytest.raises(ValueError):
        sources.load(spark, "x.xml")
    gaps = sources.missing_columns(spark.createDataFrame([(1, None), (2, "a")], "a int, b string")).collect()
    assert [(r["column_name"], r["missing"]) for r in gaps] == [("b", 1)]


def test_store_round_trip(spark, tmp_path):
    root = str(tmp_path / "store")
    assert store.load_rankings(spark, root) is None and not store.has_rankings(spark, root)
    ranked = spark.createDataFrame([(1, float("inf")), (2, None)], "id bigint, CS double").withColumn("rank_number", F.col("id"))
    costs = spark.createDataFrame([("f", 1.0)], "feature string, coefficient double")
    store.save_rankings(ranked, costs, root, "frontier")
    store.save_rankings(ranked.limit(1), costs, root, "fixed_rates", charts=costs)
    kept = store.load_rankings(spark, root)
    assert kept.metadata["method"] == "fixed_rates" and kept.rankings.count() == 1 and kept.charts.count() == 1
    rows = {r["id"]: r for r in store.response(ranked).collect()}
    assert rows[1]["CS"] == 1.7976931348623157e308 and rows[2]["value_ratio"] == 0.0 and rows[1]["rank"] == 1
    one, latest = store.save_processed(costs, root, "t1")
    assert spark.read.option("header", True).csv(latest).count() == 1 and store.save_processed(costs, root, "t2", latest=False)[1] is None


def test_process_and_stream(spark, tmp_path):
    result = process(spark, write(tmp_path / "in.json", {"options": {"method": "fixed_rates"}, "data": PLANS}), str(tmp_path / "out"))
    assert result.ranked.count() == 39 and result.top.count() == 10 and store.has_rankings(spark, str(tmp_path / "out"))
    source, root = tmp_path / "snapshots", str(tmp_path / "market")
    source.mkdir()
    for name, rows in (("1", PLANS[:20]), ("2", PLANS)):
        files = tmp_path / f"files-{name}"
        files.mkdir()
        for k in range(3):
            (files / f"{k}.json").write_text("\n".join(json.dumps(p) for p in rows[k::3]))
        announce(spark, str(source), name, str(files))
        query = rank_stream(spark, str(source), root, str(tmp_path / "checkpoint"), "frontier")
        query.awaitTermination()
        assert query.exception() is None and store.load_rankings(spark, root).rankings.count() == len(rows)


def test_texts(spark):
    df = spark.createDataFrame([(1234567.0, 1234.5, None, 0.125)], "a double, b double, c double, d double")
    row = df.select(*[text.with_commas(F.col(c)).alias(c) for c in df.columns]).first()
    assert tuple(row) == ("1,234,567", "1,234.50", "N/A", "0.12")
    names = spark.createDataFrame([("x" * 50,), ("short",), (None,)], "n string")
    assert [r[0] for r in names.select(text.shortened(F.col("n"), 10)).collect()] == ["xxxxxxx...", "short", ""]


def test_frontier_points_and_residuals(spark, folder):
    table = prepare_features(plans(spark, folder), exclude=["id"])
    features = ["voice_clean", "tethering_gb", "basic_data_clean"]
    points = explain.frontier_points(table, features)
    assert points.filter("point_class = 'unlimited'").count() == 2
    classes = explain.point_classes(table, features)
    limited = sum(table.filter(f"{C.UNLIMITED_FLAGS[f]} = 0").count() if f in C.UNLIMITED_FLAGS else table.count() for f in features)
    assert classes.count() == limited
    residual = explain.residual_table(table, features).collect()
    assert {r["feature_analyzed"] for r in residual} == set(features)
    for r in residual:
        assert r["residual_cost"] == pytest.approx(r["cost_of_analyzed_feature"] - r["combined_cost_others"])


def test_registered_queries_have_matching_names():
    from specval.suite.oracles import ORACLES
    from specval.suite.queries import QUERIES

    assert set(ORACLES) <= set(QUERIES)
