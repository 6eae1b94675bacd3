"""Long JSON arrays: cut into byte ranges anywhere, they give the objects of the plain parser."""

import json
import random

import pytest

from specval.sources import arrays, plans as sources


def objects(n, seed=1):
    rng = random.Random(seed)
    odd = ['plain', 'a "quoted" word', 'brace } in text', '{[', '\\', '\\"}', 'ü 日本 🎉', '', '},{"id": 9}', "line\nbreak", '\\\\"}]']
    return [{"id": i, "plan_name": "".join(rng.choices(odd, k=rng.randint(1, 4))), "deep": {"a": [1, {"b": odd[i % len(odd)]}], "e": {}}, "voice": i} for i in range(n)]


def values(spark, path, whole_bytes=0):
    return [x for r in arrays.read_json_values(spark, str(path), whole_bytes).collect() for x in json.loads(r["value"])]


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


@pytest.mark.parametrize("layout", [{}, {"indent": 3}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_ranges_cut_anywhere(spark, tmp_path, small_ranges, layout):
    made = objects(600)
    path = tmp_path / "with space" / "a.json"
    path.parent.mkdir()
    path.write_text("  \n" + json.dumps(made, **layout) + "\n", encoding="utf-8")
    assert path.stat().st_size > 20 * 2000
    found = values(spark, path.parent)
    assert sorted(found, key=lambda o: o["id"]) == made


def test_object_longer_than_ranges(spark, tmp_path, small_ranges):
    made = [{"id": 0, "t": "x" * 9000}, {"id": 1, "t": ["}" * 50 for _ in range(200)]}, {"id": 2}, {"id": 3, "o": [{"k": "{" * 3000}] * 3}]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(made))
    assert sorted(values(spark, path), key=lambda o: o["id"]) == made


def test_mixed_folder_and_odd_arrays(spark, tmp_path, small_ranges):
    made = objects(100, 2)
    (tmp_path / "long.json").write_text(json.dumps(made))
    (tmp_path / "envelope.json").write_text(json.dumps({"data": made}))
    (tmp_path / "tiny.json").write_text('[{"id": 7}]')
    (tmp_path / "scalars.json").write_text("[1, 2]")
    (tmp_path / "none.json").write_text(" [ ] ")
    (tmp_path / "cut.json").write_text('[{"id": 1}, {"id": 2}, {"id"')
    (tmp_path / "blank.json").write_text("")
    rows = [r["value"] for r in arrays.read_json_values(spark, str(tmp_path), 5).collect()]
    assert json.dumps({"data": made}) in rows and "[1, 2]" in rows and '[{"id": 7}]' in rows
    assert rows.count('[{"id": 1}]') == 1 and rows.count('[{"id": 2}]') == 1 and '[{"id"]' in rows
    assert sum(r.startswith("[{") for r in rows) == 100 + 1 + 2 + 1
    assert "spark.sql.files.minPartitionNum" not in [r["key"] for r in spark.sql("SET").collect()]


def test_many_tasks_read_one_array(spark, tmp_path, small_ranges):
    path = tmp_path / "a.json"
    path.write_text(json.dumps(objects(200)))
    pieces = spark.read.option("lineSep", "}").text(str(path))
    assert pieces.rdd.getNumPartitions() >= 10
    parsed = sources.parse_records(arrays.read_json_values(spark, str(path), 0))
    assert parsed.filter("reason IS NULL").count() == 200 and parsed.agg({"voice": "sum"}).first()[0] == sum(range(200))


def test_batch_of_a_long_array(spark, tmp_path, small_ranges, monkeypatch):
    path = tmp_path / "a.json"
    made = objects(60)
    path.write_text(json.dumps([*made, 5, "x"]))
    monkeypatch.setattr(sources, "read_json_values", lambda s, p: arrays.read_json_values(s, p, 0))
    batch = sources.read_batch(spark, str(path), lines=False)
    assert sorted(r["id"] for r in batch.rows.collect()) == list(range(60))
    assert batch.rejects.count() >= 1
