"""The rule on the level kept last: the same levels as one ordered pass, in few passes."""

import random

import pytest

from specval.operators import ordered
from specval.operators import piecewise as P

RATES = {"a": 3.0, "b": 0.5, "c": 8.0}


def one_pass(rows):
    kept, state = set(), {}
    for f, v, c in sorted(rows):
        if f not in RATES:
            continue
        last = state.get(f)
        if last is None or not (c < 0.8 * last[1] or (c - last[1]) / (v - last[0]) > 10 * RATES[f]):
            kept.add((f, v, c))
            state[f] = (v, c)
    return kept


def noisy(n):
    draw = random.Random(2)
    return [(f, float(i), float(draw.randrange(50, 200) + i * draw.choice([1, 5, 40]))) for f in ("a", "b", "c", "other") for i in draw.sample(range(5 * n), n)]


def one_high_cost(n):
    """A dear level at the start outbids all that follow, but for a few near the end."""
    draw = random.Random(3)
    rows = [("a", float(i), float(draw.randrange(10, 900))) for i in range(2, n)]
    return rows + [("a", 1.0, 5000.0), ("a", n + 1.0, 4800.0), ("a", n + 2.0, 100.0), ("a", n + 3.0, 5100.0), ("b", 1.0, 5.0)]


def rising(n):
    draw, cost, rows = random.Random(4), 10.0, []
    for i in range(n):
        cost += draw.choice([0, 0, 1, 2, 30, 300])
        rows.append(("a", float(i), cost))
    return rows


@pytest.mark.parametrize("make", [noisy, one_high_cost, rising])
@pytest.mark.parametrize("chunk", [10_000, 90, 12])
def test_equals_one_ordered_pass(spark, monkeypatch, make, chunk):
    passes, original = [], ordered._chunk_states

    def counted(*args):
        passes.append(1)
        return original(*args)

    monkeypatch.setattr(ordered, "_chunk_states", counted)
    rows = make(600)
    levels = spark.createDataFrame(rows, "feature string, value double, cost double")
    got = {tuple(r) for r in P.without_price_jumps(P.positions(levels, chunk), RATES, chunk).select("feature", "value", "cost").collect()}
    assert got == one_pass(rows)
    if make is rising:
        assert not passes  # a running minimum
    if make is one_high_cost:
        assert len(passes) <= 4  # fifty chunks, none of which takes part but the first and the last
