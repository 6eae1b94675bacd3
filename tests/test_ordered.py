"""The bucketed forms against plain Python, with limits small enough to force them."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from specval.operators import ordered
from specval.operators.ordered import layout, min_ranks, neighbours, row_numbers, running, sequential
from specval.operators.quantiles import exact_quantiles


def table(n=3000, hot=0.35, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        v = 7.5 if draw.random() < hot else round(draw.uniform(-50, 50), 2)
        if draw.random() < 0.02:
            v = None
        elif draw.random() < 0.02:
            v = float("inf")
        rows.append((i, f"g{draw.randrange(3)}", v))
    return pd.DataFrame(rows, columns=["id", "grp", "v"], dtype=object)


def frame(spark, pdf):
    rows = [(int(a), b, None if c is None else float(c)) for a, b, c in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "id bigint, grp string, v double")


def sort_key(descending):
    def key(row):
        v = row[1]
        return (v is None, 0 if v is None else (-v if descending else v), row[0])

    return key


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("bucket", [10_000, 100, 20])
def test_row_numbers_split_a_hot_value_by_the_tie_break(spark, descending, bucket):
    pdf = table()
    order = ["-v" if descending else "v", "id"]
    got = {r["id"]: r["n"] for r in row_numbers(frame(spark, pdf), order, "n", rows_per_bucket=bucket).collect()}
    want = {i: p + 1 for p, (i, _) in enumerate(sorted(zip(pdf.id, pdf.v), key=sort_key(descending)))}
    assert got == want


def test_no_bucket_keeps_a_hot_value_whole(spark):
    df = frame(spark, table())
    plan = layout(df, [], ["-v", "id"], 100)
    assert plan.df.groupBy(*plan.buckets).count().agg(F.max("count")).first()[0] < 300


def test_row_numbers_with_text_tie_break(spark):
    rows = [(1.0, f"name-{i % 700:04d}-{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "v double, name string")
    got = [r["name"] for r in row_numbers(df, ["-v", "name"], "n", rows_per_bucket=50).orderBy("n").collect()]
    assert got == sorted(n for _, n in rows)


@pytest.mark.parametrize("bucket", [10_000, 60])
@pytest.mark.parametrize("descending", [True, False])
def test_min_ranks(spark, bucket, descending):
    pdf = table(1500)
    shifted = [None if v is None else v + (1e-12 if i % 2 and v == 7.5 else 0.0) for i, v in zip(pdf.id, pdf.v)]
    pdf["v"] = pd.Series(shifted, dtype=object)
    out = min_ranks(frame(spark, pdf), "v", descending, "raw", "shown", "ties", rows_per_bucket=bucket).collect()
    assert len(out) == len(pdf)
    def before(values, v):
        if v is None:
            return sum(x is not None for x in values)
        return sum(x is not None and (x > v if descending else x < v) for x in values)
    values = list(pdf.v)
    coarse = [None if v is None else (v if v == float("inf") else round(v, 10)) for v in values]
    by_id = dict(zip(pdf.id, values))
    by_coarse = dict(zip(pdf.id, coarse))
    for row in out[::7]:
        assert row["raw"] == 1 + before(values, by_id[row["id"]])
        assert row["shown"] == 1 + before(coarse, by_coarse[row["id"]])
        assert row["ties"] == coarse.count(by_coarse[row["id"]])


@pytest.mark.parametrize("side", ["before", "after"])
@pytest.mark.parametrize("bucket", [10_000, 40])
def test_running(spark, side, bucket):
    draw = random.Random(3)
    rows = [(g, float(i), float(draw.randrange(1000))) for g in ("a", "b") for i in draw.sample(range(5000), 400)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    out = running(df, ["g"], ["x"], {"lo": ("min", F.col("y")), "hi": ("max", F.col("y")), "s": ("sum", F.col("y"))}, side, bucket)
    for r in out.collect():
        ys = [y for g, x, y in rows if g == r["g"] and (x < r["x"] if side == "before" else x > r["x"])]
        assert (r["lo"], r["hi"], r["s"]) == ((min(ys), max(ys), sum(ys)) if ys else (None, None, None))


@pytest.mark.parametrize("chunk", [10_000, 5, 3])
def test_neighbours(spark, chunk):
    rows = [(g, i + 1, float(i * i)) for g in ("a", "b") for i in range(57)]
    df = spark.createDataFrame(rows, "g string, pos bigint, y double")
    out = neighbours(df, ["g"], "pos", {"p2": ("y", -2), "n1": ("y", 1), "n2": ("y", 2)}, chunk).collect()
    assert len(out) == len(rows)
    known = {(g, p): y for g, p, y in rows}
    for r in out:
        assert (r["p2"], r["n1"], r["n2"]) == tuple(known.get((r["g"], r["pos"] + o)) for o in (-2, 1, 2))


@pytest.mark.parametrize("chunk", [10_000, 9, 2])
def test_sequential_equals_one_pass(spark, chunk):
    draw = random.Random(5)
    rows = [(g, i + 1, float(draw.randrange(100))) for g in ("a", "b", "c") for i in range(90)]
    df = spark.createDataFrame(rows, "g string, pos bigint, y double")

    def kernel(pdf, state):
        mask = np.zeros(len(pdf), dtype=bool)
        for i, y in enumerate(pdf["y"].to_numpy()):
            if state is None or abs(y - state[0]) > 20:
                mask[i], state = True, (float(y),)
        return mask, state

    got = {(r["g"], r["pos"]) for r in sequential(df, "g", "pos", kernel, ["y"], chunk).collect()}
    want = set()
    for g in ("a", "b", "c"):
        last = None
        for gg, p, y in rows:
            if gg == g and (last is None or abs(y - last) > 20):
                last = y
                want.add((g, p))
    assert got == want


def test_buckets_stay_small_with_ties_and_shared_prefixes(spark):
    df = spark.range(40_000).select(
        F.lit(1.0).alias("v"), F.concat(F.lit("Customer#0000"), F.lpad(((F.col("id") * 7919) % 40_000).cast("string"), 9, "0")).alias("name"))
    plan = layout(df, [], ["-v", "name"], 1000)
    counts = [r["count"] for r in plan.df.groupBy(*plan.buckets).count().collect()]
    assert sum(counts) == 40_000 and max(counts) <= 2000
    out = row_numbers(df, ["-v", "name"], "n", rows_per_bucket=1000)
    assert out.filter(F.col("n") - 1 != F.substring("name", 14, 9).cast("int")).count() == 0


@pytest.mark.parametrize("chunk", [1, 2, 3, 5])
def test_sequential_with_gaps_and_empty_chunks(spark, chunk):
    rows = [("a", p, 0.0) for p in (1, 2, 8, 9, 12, 40, 47, 48, 56)] + [("b", p, 0.0) for p in (3, 30)]
    df = spark.createDataFrame(rows, "g string, pos bigint, y double")

    def kernel(pdf, state):
        mask = np.zeros(len(pdf), dtype=bool)
        for i, p in enumerate(pdf["pos"].to_numpy()):
            if state is None or p - state[0] >= 8:
                mask[i], state = True, (float(p),)
        return mask, state

    got = {(r["g"], r["pos"]) for r in sequential(df, "g", "pos", kernel, [], chunk).collect()}
    assert got == {("a", 1), ("a", 9), ("a", 40), ("a", 48), ("a", 56), ("b", 3), ("b", 30)}


def test_scans_do_not_grow_with_the_columns(spark):
    jobs = []
    for n in (1, 12):
        df = spark.range(3000).select(*[((F.col("id") * (7 + i)) % 2999).cast("double").alias(f"c{i}") for i in range(n)])
        spark.sparkContext.setJobGroup(f"quantiles{n}", "")
        got = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in df.columns}, 500)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"quantiles{n}")))
        table_ = df.toPandas()
        assert all(np.allclose(got[c], np.quantile(table_[c], [0.25, 0.5, 0.75])) for c in df.columns)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 4


@pytest.mark.parametrize("limit", [10_000_000, 200, 20])
def test_exact_quantiles(spark, limit):
    pdf = table(4000)
    probs = [0.0, 0.25, 0.33, 0.5, 0.67, 1.0]
    df = frame(spark, pdf).filter("v < 1000 OR v IS NULL")
    values = np.array([v for v in pdf.v if v is not None and v < 1000], dtype=float)
    got = exact_quantiles(df, {"v": probs}, limit)["v"]
    assert np.allclose(got, np.quantile(values, probs), rtol=0, atol=1e-9)
    assert exact_quantiles(df.filter("id < 0"), {"v": [0.5]}, limit) == {"v": [None]}


@pytest.mark.parametrize("value", [3.0, None, float("nan"), float("-inf")])
def test_one_value_in_many_buckets(spark, value):
    rows = [(i, value) for i in range(300)] + [(300 + i, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "id bigint, v double")
    plan = layout(df, [], ["v"], 40)
    assert plan.df.groupBy(*plan.buckets).count().agg(F.max("count")).first()[0] < 120  # the other column divides the tie
    for descending in (True, False):
        one = {r["id"]: r[2:] for r in min_ranks(df, "v", descending, "a", "b", "c").select("id", "v", "a", "b", "c").collect()}
        many = {r["id"]: r[2:] for r in min_ranks(df, "v", descending, "a", "b", "c", rows_per_bucket=40).select("id", "v", "a", "b", "c").collect()}
        assert many == one


def test_numbers_within_many_groups_join_their_totals_by_shuffle(spark, monkeypatch):
    from specval.operators import ordered

    monkeypatch.setattr(ordered, "BROADCAST_TOTALS", 0)
    df = spark.range(3000).select("id", F.when(F.col("id") % 7 > 0, (F.col("id") % 40).cast("string")).alias("g"), (F.col("id") * 37 % 1009).alias("v"))
    got = {(r["g"], r["id"]): r["n"] for r in row_numbers(df, ["-v", "id"], "n", ["g"], rows_per_bucket=100).collect()}
    pdf = df.toPandas().sort_values(["v", "id"], ascending=[False, True])
    pdf["n"] = pdf.groupby("g", dropna=False).cumcount() + 1
    assert got == {(None if pd.isna(g) else g, i): n for g, i, n in zip(pdf.g, pdf.id, pdf.n)}


def test_the_range_exchange_is_sparks_own(spark):
    jobs = "ordered-jobs"
    spark.sparkContext.setJobGroup(jobs, "")
    plan = layout(spark.range(5000), [], ["-id"], 1000)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    counts = sorted((r[plan.buckets[0]], r["n"], r["hi"]) for r in plan.df.groupBy(*plan.buckets).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("hi")).collect())
    assert len(counts) == 5 and sum(n for _, n, _ in counts) == 5000 and max(n for _, n, _ in counts) < 2000
    assert [hi for _, _, hi in counts] == sorted((hi for _, _, hi in counts), reverse=True)


def test_wide_rows_go_to_more_buckets(spark, monkeypatch):
    pdf = table(2000)
    wide = frame(spark, pdf).withColumns({f"c{i}": F.col("id") * i for i in range(37)})  # 40 columns
    monkeypatch.setattr(ordered, "CELLS_PER_BUCKET", 10_000)
    plan = layout(wide, [], ["-v", "id"])
    sizes = [r["count"] for r in plan.df.groupBy(*plan.buckets).count().collect()]
    assert not plan.single and sum(sizes) == 2000 and max(sizes) <= 500 and layout(wide.select("id", "v"), [], ["v"]).single
    got = {r["id"]: r["pos"] for r in row_numbers(wide, ["-v", "id"], "pos").collect()}
    order = sorted(((i, v) for i, _, v in pdf.itertuples(index=False)), key=sort_key(True))
    assert got == {i: k + 1 for k, (i, _) in enumerate(order)}
    ranked = min_ranks(wide, "v", True, "r", "d", "ties")
    assert ranked.columns == [*wide.columns, "r", "d", "ties"] and ranked.count() == 2000
