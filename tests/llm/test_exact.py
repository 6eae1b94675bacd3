"""Exact duplicates: both forms of the prefix join, clashing names, and what is moved between tasks."""

import pytest

from specval.llm import exact

NAMES = ["__n", "__p", "__row", "__hit", "__text", "__sha", "__doc", "__first", "__size", "__id", "a.b"]


@pytest.fixture(scope="module")
def clashing(spark):
    texts = ["a b", "a  b", None, "", "x" * 300 + "1", "x" * 300 + "2", "a\nb", "alone"]
    rows = [(i if i != 6 else None, t, *[i * 10 + k for k in range(len(NAMES))]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in NAMES)), rows


def test_any_column_names(clashing):
    docs, rows = clashing
    out = exact.drop_exact_copies(docs)
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == sorted(rows[i] for i in (0, 2, 4, 5, 7))


@pytest.mark.parametrize("digest", [False, True])
def test_exchange_form_hashes_before_it(clashing, digest):
    docs, _ = clashing
    found = []
    for limit in (1_000_000, 0):
        rows, placed = exact._refined(docs, "doc_id", "text", ["doc_id", "text"], digest, exact.PREFIX, limit=limit)
        found.append(sorted((r["__first"]["id"], r["__size"], r["__sha"]) for r in placed.collect()))
        assert rows.count() == 8
    assert found[0] == found[1] and [(i, n) for i, n, _ in found[0]] == [(0, 3), (0, 3), (0, 3), (2, 2), (2, 2)]


def test_texts_stay_where_they_are(clashing, monkeypatch):
    """The lookup isn't broadcast: no table written on the way but the numbered rows holds a text."""
    docs, _ = clashing
    written = {}
    real = exact.materialize

    def noted(df, label):
        written[label] = set(df.columns)
        return real(df, label)

    monkeypatch.setattr(exact, "materialize", noted)
    exact._refined(docs, "doc_id", "text", ["doc_id", "text"], False, exact.PREFIX, limit=0)
    assert written["exact-hits"] == {"__id", "__row", "__sha"} and "__doc" in written["exact-rows"]


def test_groups_equal_plain_grouping(spark, docs, rows):
    out = exact.exact_copies(docs, carry=["doc_id"], digest=False).collect()
    sizes = sorted(r["__group_size"] for r in out)
    whole = sorted(r["__group_size"] for r in exact.exact_copies(docs, digest=True).collect())
    assert sizes == whole and len(out) == len(rows)
