"""Bands of the quality rules when a text is copied many times."""

from pyspark.sql import functions as F

from specval.llm import rules


def test_copies_of_one_text_leave_the_bands_alone(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").filter("lang = 'en'")
    alone = {r["doc_id"]: r["kept"] for r in rules.quality_rules(docs).collect()}
    good = sorted(i for i, kept in alone.items() if kept)
    for chosen in good[:3]:
        copies = docs.filter(F.col("doc_id") == chosen).withColumn("doc_id", F.explode(F.sequence(F.lit(10**9), F.lit(10**9 + 2 * len(alone)))))
        out = rules.quality_rules(docs.unionByName(copies.select(*docs.columns))).collect()
        assert {r["doc_id"]: r["kept"] for r in out if r["doc_id"] < 10**9} == alone
        assert all(r["kept"] for r in out if r["doc_id"] >= 10**9)
