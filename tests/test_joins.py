import pytest

from specval.operators.joins import join_measured


@pytest.mark.parametrize("limit", [1000, 0])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_equals_plain_join(spark, how, limit):
    # key 7 holds a third of the rows, all of them copies
    rows = spark.createDataFrame([(7, "x")] * 300 + [(i, "y") for i in range(600)], "k int, t string").repartition(5)
    lookup = spark.createDataFrame([(i, i * 10) for i in range(0, 600, 7)], "k int, v int")
    got = join_measured(rows, lookup, ["k"], how, broadcast_rows=limit)
    plain = rows.join(lookup, ["k"], how)
    assert sorted(map(tuple, got.select(*sorted(got.columns)).collect()), key=str) == sorted(map(tuple, plain.select(*sorted(plain.columns)).collect()), key=str)
