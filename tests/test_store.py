"""Which run is the newest, whoever wrote it: batch jobs, streams, restarted streams, repeated batches."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from specval.sources import store
from specval.sources.commits import CommitLog
from specval.streaming.market import announce, rank_stream
from test_sources import PLANS


@pytest.fixture
def tables(spark):
    ranked = spark.createDataFrame([(1, 2.0), (2, 1.0)], "id bigint, CS double").withColumn("rank_number", F.col("id"))
    return ranked, spark.createDataFrame([("f", 1.0)], "feature string, coefficient double")


def market(tmp_path, name, rows):
    folder = tmp_path / f"market-{name}"
    folder.mkdir()
    (folder / "part.json").write_text("\n".join(json.dumps(p) for p in rows))
    return str(folder)


def run(spark, source, root, checkpoint):
    query = rank_stream(spark, str(source), root, str(checkpoint), "frontier")
    query.awaitTermination()
    assert query.exception() is None


def newest(spark, root):
    return store.load_rankings(spark, root).rankings.count()


def test_numbers_are_taken_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda k: CommitLog(spark, str(tmp_path / "log")).add({"k": k}), range(40)))
    assert sorted(numbers) == list(range(1, 41)) == log.numbers()
    assert sorted(entry["k"] for _, entry in log.newest_first()) == list(range(40))
    assert [log.read(n)["k"] for n in numbers] == list(range(40))


def test_a_rename_never_replaces_an_entry(spark, tmp_path, monkeypatch):
    """The form for shared file systems, on the local one."""
    from specval.sources import commits

    monkeypatch.setattr(commits, "LINKED", ())
    log = CommitLog(spark, str(tmp_path / "log"))
    assert [log.add({"k": k}) for k in (5, 6)] == [1, 2]
    monkeypatch.setattr(log, "numbers", lambda: [1])  # as if another writer came first
    assert log.add({"k": 7}) == 3
    assert [log.read(n)["k"] for n in (1, 2, 3)] == [5, 6, 7]


def test_newest_is_the_last_complete_run(spark, tmp_path, tables):
    root, (ranked, costs) = str(tmp_path / "store"), tables
    assert store.store_info(spark, root) == {"has_data": False} and store.run_metadata(spark, root) is None
    for name in ("z-first", "batch-00000007-old", "20260101_000000", "a-last"):  # no order of names matters
        store.save_rankings(ranked, costs, root, run_id=name)
        assert store.store_info(spark, root)["run_id"] == name
    # a run that is written again keeps its place, and readers of the run keep their tables
    before = store.load_rankings(spark, root, "z-first").rankings
    store.save_rankings(ranked.limit(1), costs, root, run_id="z-first")
    assert store.store_info(spark, root)["run_id"] == "a-last"
    assert before.count() == 2 and store.load_rankings(spark, root, "z-first").rankings.count() == 1
    store.save_rankings(ranked.limit(1), costs, root, "frontier", run_id="a-last")
    info = store.store_info(spark, root)
    assert (info["run_id"], info["num_plans"], info["method"], info["place"]) == ("a-last", 1, "frontier", 4) and newest(spark, root) == 1
    rows = {r["run_id"]: (r["place"], r["num_plans"]) for r in store.run_metadata(spark, root).collect()}
    assert rows == {"z-first": (1, 1), "batch-00000007-old": (2, 2), "20260101_000000": (3, 2), "a-last": (4, 1)}
    # an interrupted run has tables and no entry
    ranked.write.parquet(f"{root}/runs/zzz/attempt/rankings")
    assert store.store_info(spark, root)["run_id"] == "a-last" and store.committed(spark, root, "zzz") is None


def test_streams_and_batch_jobs_in_one_store(spark, tmp_path, tables):
    source, root = tmp_path / "announced", str(tmp_path / "store")
    source.mkdir()
    announce(spark, str(source), "s1", market(tmp_path, "1", PLANS[:10]))
    run(spark, source, root, tmp_path / "checkpoint")
    assert newest(spark, root) == 10
    store.save_rankings(*tables, root)  # a batch job
    assert newest(spark, root) == 2
    announce(spark, str(source), "s2", market(tmp_path, "2", PLANS[:20]))
    run(spark, source, root, tmp_path / "checkpoint")  # the stream goes on
    assert newest(spark, root) == 20
    store.save_rankings(*tables, root)
    assert newest(spark, root) == 2
    # a new stream without the old checkpoint starts at batch 0 again and reads all announcements
    run(spark, source, root, tmp_path / "other")
    ids = {r["run_id"]: r["num_plans"] for r in store.run_metadata(spark, root).collect()}
    assert len(ids) == 6 and sorted(ids.values()) == [2, 2, 10, 10, 20, 20]
    assert newest(spark, root) in (10, 20)  # of its two files the one it read last
    last = max(store.run_metadata(spark, root).collect(), key=lambda r: r["place"])
    assert store.store_info(spark, root)["run_id"] == last["run_id"]


def test_announcements_in_one_file_keep_their_order(spark, tmp_path):
    source, root = tmp_path / "announced", str(tmp_path / "store")
    source.mkdir()
    named = [("zz", market(tmp_path, "a", PLANS[:30])), ("a/b c", market(tmp_path, "b", PLANS[:10])), ("m", market(tmp_path, "c", PLANS[:20]))]
    (source / "all.json").write_text("\n".join(json.dumps({"snapshot_id": n, "path": p}) for n, p in named))
    run(spark, source, root, tmp_path / "checkpoint")
    places = [r["num_plans"] for r in store.run_metadata(spark, root).orderBy("place").collect()]
    assert places == [30, 10, 20] and newest(spark, root) == 20


def test_a_repeated_batch_is_left_alone(spark, tmp_path, tables):
    source, root = tmp_path / "announced", str(tmp_path / "store")
    source.mkdir()
    announce(spark, str(source), "s1", market(tmp_path, "1", PLANS[:10]))
    run(spark, source, root, tmp_path / "checkpoint")
    store.save_rankings(*tables, root)
    commit = tmp_path / "checkpoint" / "commits" / "0"
    commit.unlink()  # as if the stream had stopped after the store's commit and before its own
    (tmp_path / "checkpoint" / "commits" / ".0.crc").unlink(missing_ok=True)
    run(spark, source, root, tmp_path / "checkpoint")
    assert newest(spark, root) == 2 and store.run_metadata(spark, root).count() == 2
