"""Scores of texts that are longer than any labelled one."""

import random

import numpy as np

from specval.llm import quality
from specval.llm.text import split_words


def test_long_text_scores_like_its_parts(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(documents, labels)
    good = [r["text"] for r in documents.join(labels, "doc_id").filter("quality = 1").orderBy("doc_id").limit(40).collect()]
    words = [w for t in good for w in split_words(t)]
    rng, parts = random.Random(3), []
    while sum(map(len, parts)) < 200_000:  # runs of ten passages from anywhere in the good texts
        at = rng.randrange(len(words) - 640)
        parts.append(words[at:at + 640])
    texts = [" ".join(p) for p in parts]  # joined, the last word of a part is followed by a space instead of the end
    scored = quality.score(spark.createDataFrame(list(enumerate([" ".join(texts), *texts])), "doc_id long, text string"), model, carry=["doc_id"])
    whole, *apart = (r["__score"] for r in scored.orderBy("doc_id").collect())
    assert min(apart) - 1e-6 <= whole <= max(apart) + 1e-6
    x = np.concatenate(list(quality.passage_slices(" ".join(texts))))
    assert len(x) == 10 * len(texts) and np.isclose(whole, model.score(np.array([len(x)]), x)[0], rtol=1e-9)


def test_passage_slices_equal_one_pass(monkeypatch):
    text = " \n" + " ".join(f"W{k % 97}é{k}" + "\n" * (k % 11 == 0) for k in range(5000)) + " " + "x" * 5000 + " \t end  "
    once = quality.encode_passages([text])[1]
    monkeypatch.setattr(quality, "SLICE", 3000)
    assert np.array_equal(np.concatenate(list(quality.passage_slices(text))), once)
    monkeypatch.undo()
    words = [f"w{k % 997}" for k in range(100_000)]
    assert np.concatenate(list(quality.passage_slices(" ".join(words)))).shape == (-(-100_000 // 64), quality.WIDTH)
    assert [len(x) for x in quality.passage_slices(None)] == [1] and [len(x) for x in quality.passage_slices(" " * 9000)] == [1]
