from collections import Counter

import corpus_pipeline
from specval.llm import packing


def brute_force_duplicates(rows):
    from test_documents import WHITE, shingle_set  # noqa: PLC0415

    first = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        first.setdefault(WHITE.sub(" ", r["text"] or ""), r)
    return list(first.values()), shingle_set


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), f"test-{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == spark.read.parquet(f"{folder}/documents.parquet").columns
        if name == "quality_classifier":
            kept = {r["doc_id"] for r in docs.collect()}
            wrong = [i for i, q in labels.items() if (i in kept) != (q == 1)]
            assert len(wrong) <= 0.05 * len(labels)
        if name == "exact_dedup":
            unique, _ = brute_force_duplicates(before.collect())
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in unique}
        if name == "near_dedup":
            _, shingle_set = brute_force_duplicates([])
            rows = before.orderBy("doc_id").collect()
            sets, group = [shingle_set(r["text"]) for r in rows], list(range(len(rows)))
            for i in range(len(rows)):
                for j in range(i):
                    c = len(sets[i] & sets[j])
                    if c and 5 * c >= 4 * (len(sets[i]) + len(sets[j]) - c) and group[i] != group[j]:
                        a, b = sorted((group[i], group[j]))
                        group = [a if g == b else g for g in group]
            assert {r["doc_id"] for r in docs.collect()} == {rows[g]["doc_id"] for g in set(group)}
    mixed = Counter(r["doc_id"] for r in seen["source_mix"].collect())
    assert mixed == Counter(r["doc_id"] for r in docs.filter("start = 0").collect()) and set(mixed.values()) <= {1, 2, 3}
    assert docs.agg({"length": "sum"}).first()[0] == packing.pack(seen["source_mix"]).agg({"length": "sum"}).first()[0]


def test_run_and_registration(spark, folder):
    import __spark_entry__

    queries = __spark_entry__.queries()
    assert "pipeline" in queries and sum(q.startswith("op") for q in queries) == 13
    assert corpus_pipeline.run(spark, folder).count() > 0
