"""Phrases and their scores against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from specval.llm import collocations as col

SCHEMA = "doc_id long, text string, lang string, source string, rank int, phrase string, w0 long, a long, score double, n long, word string, key string"


def brute(rows, max_words=3, least=10, top=2000):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    frequent = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    held = defaultdict(int)
    for p, a in frequent.items():
        for size in range(2, len(p) - 1):
            for at in range(1, len(p) - size + 1):
                inner = (p[0], *p[at:at + size])
                held[inner] = max(held[inner], a)
    found = defaultdict(list)
    for p, a in frequent.items():
        if 100 * held[p] >= 50 * a:
            continue
        cuts = [(1_000_000 * a * a // (f[p[:k + 1]] * f[(p[0], *p[k + 1:])]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        found[p[0]].append((-score, -a, " ".join(p[1:]).encode(), f[p[:k + 1]], f[(p[0], *p[k + 1:])]))
    return sorted((lang, i + 1, phrase.decode(), -a, left, right, n[lang], -score)
                  for lang, rows in found.items() for i, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top]))


def answer(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def phrase_rows():
    rng = random.Random(3)
    words = ["the", "of", "New", "York", "City", "Élan", "日本", "🎉", "x\xa0y", "a", "b", "c", "very", "rare"] + [f"w{i}" for i in range(9)] + ["the", "of", "New", "a"] * 8
    rows = []
    for i in range(240):
        parts = [rng.choice(words) for _ in range(rng.randint(1, 90))]
        parts += ["New York City"] * rng.randint(0, 2) + ["a a a a"] * (i % 3)
        text = "".join(p + rng.choice([" ", "  ", "\t", ". ", ", ", "\n", "\r\n", " \x0b", "! "] if rng.random() < 0.2 else [" "]) for p in parts)
        rows.append((i, text, rng.choice(["en", "en", "de", None, ""]), "s", 1, "p", 2, 3, 1.0, 5, "w", "k"))
    rows += [(500 + i, t, "en", None, None, None, None, None, None, None, None, None) for i, t in enumerate([None, "", " \t\n", ".,;", "one"])]
    rows += [rows[0]] * 4 + [(None, None, None, *[None] * 9)]
    rows += [(600, "new york " * 40_000 + "end", "en", None, *[None] * 8), (601, "word" * 50_000, "en", None, *[None] * 8)]
    return rows


@pytest.mark.parametrize("max_words", [2, 3, 4])
def test_phrases_equal_brute_force(spark, max_words):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows, max_words, top=200)
    assert len(want) > 30 * max_words and answer(col.collocations(docs, max_words=max_words, top=200)) == want


def test_many_tries_and_short_runs_give_the_same(spark):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    # short runs also cut the long texts; so few flags are shared by many
    assert answer(col.collocations(docs, trie_phrases=400, flag_bits=12, run_bytes=2000)) == brute(rows)


def test_a_level_reads_the_text_once_however_many_phrases(spark, monkeypatch):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    read = spark.sparkContext.accumulator(0)

    def counted(batches, runs=col._runs):
        for keys in runs(batches):
            read.add(len(keys))
            yield keys

    monkeypatch.setattr(col, "_runs", counted)
    passes = []
    for tries in (400, 500_000):
        before = read.value
        assert answer(col.collocations(docs, trie_phrases=tries, part_words=10_000)) == brute(rows)
        passes.append(read.value - before)
    words = sum(len(re.findall("[^\x20\x09-\x0d.,;:!?]+", r[1] or "")) for r in rows)
    assert passes[0] == passes[1] and words < passes[0] / 2 < 2 * words  # words and ends of pieces, at two levels


def test_sums_of_phrases_seen_several_times():
    rng = np.random.default_rng(2)
    words = rng.integers(1, 2**63, 300, dtype=np.uint64)
    rows = words[rng.integers(0, 300, (20_000, 2))]
    seen = rng.integers(1, 2**40, len(rows))
    made = col.Phrases(np.unique(rows[:9000], axis=0))
    keys = np.unique(rows[:9000], axis=0)[made.order]
    want = Counter()
    for row, n in zip(map(tuple, rows.tolist()), seen.tolist()):
        want[row] += n
    assert made.sums(list(rows.T), seen).tolist() == [want[tuple(k)] for k in keys.tolist()]


def test_texts_of_several_slices_stay_apart(spark):
    docs = spark.createDataFrame([(i, "alpha beta " * 2000, "en" if i % 2 else "fr") for i in range(60)], "doc_id long, text string, lang string").coalesce(1)
    got = {(r["lang"], r["phrase"]): r["a"] for r in col.collocations(docs, max_words=2).collect()}
    assert got == {(lang, phrase): 30 * n for lang in ("en", "fr") for phrase, n in (("alpha beta", 2000), ("beta alpha", 1999))}


def test_no_text_no_phrases(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert col.collocations(none).collect() == []
    assert col.collocations(spark.createDataFrame([(1, "too few words", "en", *["1"] * 0, None, *[None] * 8)], SCHEMA)).collect() == []


def test_trie_holds_its_phrases_and_no_other():
    rng = np.random.default_rng(1)
    for n, words in ((1, 1), (50, 5), (3000, 300), (40_000, 70_000)):
        names = rng.integers(1, 2**63, words, dtype=np.uint64)
        keys = np.unique(names[np.minimum(rng.zipf(1.3, (n, 2)) - 1, words - 1)], axis=0)
        made = col.Phrases(keys)
        keys = keys[made.order]
        run = np.concatenate([np.concatenate((k, [np.uint64(0)])) for k in keys])
        assert (made.counts(run) == 1).all()
        text = names[rng.integers(0, words, 5000)]
        places = {tuple(k): i for i, k in enumerate(keys.tolist())}
        want = np.zeros(len(keys), int)
        for pair in zip(text.tolist(), text[1:].tolist()):
            if pair in places:
                want[places[pair]] += 1
        assert made.counts(text).tolist() == want.tolist()


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000
    levels = {1: spark.createDataFrame([(1, big), (2, big)], "w0 long, a long"), 2: spark.createDataFrame([(1, 2, big)], "w0 long, w1 long, a long")}
    row = col._scored(levels, 2).first()
    assert (row["score"], row["l"], row["r"]) == (1_000_000, big, big)
