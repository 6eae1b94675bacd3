"""Operators on documents against brute force, over awkward rows and empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from specval.llm import exact, licenses, mixing, ngram_join, packing, quality, rules, sharding, substring
from specval.llm.text import hash_words, split_words

WHITE, WORD = re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def key(value):
    return (value is None, value)


def test_split_words_and_hashes(rows):
    texts = [r[1] for r in rows]
    assert [split_words(t) for t in texts] == [words(t) for t in texts]
    counts, hashes = hash_words(texts)
    assert counts.tolist() == [len(words(t)) for t in texts]
    everything = [w for t in texts for w in words(t)]
    assert len(set(zip(everything, hashes.tolist()))) == len(set(everything)) == len(set(hashes.tolist()))


def test_exact_copies(docs, rows, no_docs):
    out = exact.exact_copies(docs, carry=docs.columns, digest=True).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[WHITE.sub(" ", r[1] or "")].append(r[0])
    assert len(out) == len(rows)
    kept = Counter()
    for r in out:
        norm = WHITE.sub(" ", r["text"] or "")
        assert r["__keep_id"] == min(groups[norm], key=key) and r["__group_size"] == len(groups[norm])
        assert r["__sha"] == hashlib.sha256(norm.encode()).hexdigest()
        kept[norm] += r["__kept"]
    assert set(kept.values()) == {1}
    assert exact.drop_exact_copies(docs).count() == len(groups)
    assert exact.drop_exact_copies(docs).columns == docs.columns
    assert exact.exact_copies(no_docs).count() == 0


def test_mixing(docs, rows, no_docs):
    narrow, plan = mixing.mix_sources(docs)
    plan = {r["__source"]: r for r in plan.collect()}
    sizes, sources = Counter(), sorted({r[3] for r in rows}, key=key)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    weight = {s: 1 + k % 3 for k, s in enumerate(sources)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in sources if s not in capped)
        more = {s for s in sources if s not in capped and weight[s] * left / open_ > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    for s in sources:
        target = 3 * sizes[s] if s in capped else weight[s] * left / open_
        assert plan["2" if s is None else "1" + s]["__target"] == pytest.approx(target)
    taken = narrow.join(plan_frame(narrow, plan), "__source").withColumn("t", mixing.times_taken()).collect()
    assert len(taken) == len(rows) and max(r["t"] for r in taken) <= 3
    by = Counter()
    for r in taken:
        by[r["__source"]] += r["t"] * r["__size"]
    largest = Counter()
    for r in taken:
        largest[r["__source"], r["__hash"]] += r["__size"]
    for s, p in plan.items():
        assert abs(by[s] - p["__target"]) <= max(n for (x, _), n in largest.items() if x == s) / 2 + 1e-9
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["t"] for r in taken)
    assert mixing.mixed(no_docs).count() == 0


def plan_frame(df, plan):
    return df.sparkSession.createDataFrame(list(plan.values()))


def test_smaller_budget_takes_a_subset(docs):
    take = lambda budget: {r["__hash"]: r["t"] for r in (lambda n, p: n.join(p, "__source").withColumn("t", mixing.times_taken()).collect())(
        *mixing.mix_sources(docs, budget=budget))}
    small, large = take(0.2), take(0.6)
    assert all(large[h] >= n for h, n in small.items()) and sum(large.values()) > sum(small.values())


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_similarity_join(docs, rows, no_docs):
    sets = [shingle_set(r[1]) for r in rows]
    n = len(rows)
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or common and 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    wanted = Counter()
    for i, r in enumerate(rows):
        group = min((rows[j][0] for j in range(n) if root(j) == root(i)), key=key)
        same = min((rows[j][0] for j in range(n) if sets[j] == sets[i]), key=key)
        wanted[r[0], hashlib.md5((r[1] or "").encode()).hexdigest(), same, group, links[i]] += 1
    for settings in ({}, {"tile_rows": 2}):
        out = ngram_join.similar_groups(docs, **settings).collect()
        assert Counter((r["__id"], r["__key"], r["__class"]["id"], r["__group"]["id"], r["__n_links"]) for r in out) == wanted
    kept = ngram_join.drop_similar(docs)
    assert kept.columns == docs.columns
    assert len({(r["doc_id"], r["text"]) for r in kept.collect()}) == len({root(i) for i in range(n)})
    assert ngram_join.similar_groups(no_docs).count() == 0


def test_prefix_is_shortened_until_recall():
    length = ngram_join.prefix_length(0.8, 0.999, 16, 8)
    assert 1 - (1 - 0.8**length) ** 16 >= 0.999 > 1 - (1 - 0.8 ** (length + 1)) ** 16


def test_hot_group_of_near_copies_makes_no_pairs(spark):
    base = [f"w{k}" for k in range(120)]
    texts = [(i, " ".join([f"own{i}", *base, f"last{i}"])) for i in range(400)]
    out = ngram_join.similar_groups(spark.createDataFrame(texts, "doc_id long, text string"), tile_rows=64).collect()
    assert {(r["__group"]["id"], r["__n_links"]) for r in out} == {(0, 399)}


def test_licenses(docs, rows, no_docs):
    wanted = Counter()
    for r in rows:
        w = licenses.words_of(r[1] or "")
        for name, text in licenses.TEMPLATES.items():
            t = licenses.words_of(text)
            width, got, first = min(5, len(t)), set(), None
            total = len(licenses.shingles(t, width))
            for s in range(0, len(w), licenses.STRIDE):
                window = set(licenses.shingles(w[s:s + licenses.WINDOW], width))
                for piece in licenses.pieces_of(t):
                    p = set(licenses.shingles(piece, width))
                    if p and len(p & window) >= 0.8 * len(p):
                        got |= p & window
                        first = s if first is None else first
            if got and len(got) >= 0.8 * total:
                wanted[r[0], name, len(got) / total, first] += 1
    out = Counter((r["doc_id"], r["license"], r["containment"], r["first_word"]) for r in licenses.scan(docs).collect())
    assert out == wanted and len(wanted) >= 2
    assert licenses.scan(no_docs).count() == 0


def test_bands_guarantee_collisions():
    bands = licenses.bands_needed(0.999, 16, 5)
    assert 1 - (11 / 12) ** bands >= 0.999 > 1 - (11 / 12) ** (bands - 1)


def test_base_rules(docs, rows, no_docs):
    out = rules.quality_rules(docs)
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out.collect())
    wanted = Counter()
    for r in rows:
        text, w = r[1] or "", words(r[1])
        runs = Counter(zip(w, w[1:], w[2:]))
        covered = {k + d for k, t in enumerate(zip(w, w[1:], w[2:])) if runs[t] > 1 for d in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        wanted[r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)] += 1
    assert got == wanted
    assert all(not r["kept"] for r in out.filter("base_failed").collect())
    assert rules.quality_rules(no_docs).count() == 0


def test_fertility_measures_and_bands(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    judged = rules.quality_rules(docs).join(labels, "doc_id")
    clean = judged.filter("quality = 1 AND NOT base_failed")
    assert clean.filter("NOT kept").count() <= 0.01 * clean.count()
    odd = spark.createDataFrame([(0, "  " * 60)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    both = rules.quality_rules(docs.select("doc_id", "text", "lang").filter("lang = 'en'").unionByName(odd.withColumn("doc_id", F.lit(-1).cast("long"))))
    row = both.filter("doc_id = -1").first()
    assert row["byte_share"] > 0.5 and not row["kept"]


def test_script_of():
    assert [rules.script_of(t) for t in ("abc", "привет a", "日本語", "١٢٣ العربية", "!!!")] == ["Latin", "Cyrillic", "Han", "Arabic", "Latin"]


def test_packing_round_trip(docs, rows, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    tokenizer.encode_special_tokens = True
    length = 512
    pieces = packing.pack(docs, length=length).collect()
    stream, at = defaultdict(list), {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == at.get(p["sequence_id"], 0)
        at[p["sequence_id"]] = p["offset"] + p["length"]
        ids = np.frombuffer(p["ids"], "<u2").astype("<u4")
        assert len(ids) == p["length"] and zlib.crc32(ids.tobytes()) == p["ids_crc32"]
        stream[p["sequence_id"]] += ids.tolist()
    assert sorted(stream) == list(range(len(stream))) and all(n == length for s, n in at.items() if s < len(at) - 1)
    flat, got, now = [x for s in sorted(stream) for x in stream[s]], Counter(), []
    for x in flat:
        now.append(x)
        if x == packing.END_ID:  # no text of the fixture has this id
            got[tuple(now)] += 1
            now = []
    assert got == Counter(tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows)
    assert Counter(p["doc_id"] for p in pieces if p["start"] == 0) == Counter(r[0] for r in rows)
    assert packing.pack(no_docs).count() == 0


def test_no_padding_at_a_power_of_two(spark):
    for n, padded in ((63, 64), (62, 4096)):  # 64 and 63 ids with the end id
        df = spark.createDataFrame([(1, " ".join(["the"] * n))], "doc_id long, text string")
        assert [r["padded_length"] for r in packing.pack(df).collect()] == [padded]


def test_substring_dedup(docs, rows, no_docs):
    holders = defaultdict(set)
    for r in rows:
        w = words(r[1])
        for k in range(len(w) - 49):
            holders[tuple(w[k:k + 50])].add(key(r[0]))
    wanted = Counter()
    for r in rows:
        w = words(r[1])
        gone = set()
        for k in range(len(w) - 49):
            if min(holders[tuple(w[k:k + 50])]) < key(r[0]):
                gone |= set(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        wanted[r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    out = substring.drop_repeats(docs, texts=True)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect()) == wanted
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in out.collect())
    assert sum(k[2] > 0 for k in wanted) > 20
    assert substring.drop_repeats(no_docs).count() == 0


def test_lists_are_joined_alike_when_too_many_to_broadcast(docs, monkeypatch):
    first = Counter(map(tuple, substring.drop_repeats(docs).collect()))
    monkeypatch.setattr(substring, "RANGE_ROWS", 0)
    assert Counter(map(tuple, substring.drop_repeats(docs).collect())) == first


def test_sharding(docs, rows, no_docs):
    out = sharding.shard_documents(docs, shards=4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    for shard in range(4):
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))
    assert sharding.shard_documents(no_docs).count() == 0


def test_shards_are_even_and_keep_copies_together(spark):
    rows = [(i, f"text {i} " + "x" * (i % 97)) for i in range(3000)] + [(5000 + i, f"copy {i // 3} " * 4) for i in range(600)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    load, groups = Counter(), defaultdict(set)
    for r in out:
        load[r["shard"]] += r["size"]
        if r["doc_id"] >= 5000:
            groups[(r["doc_id"] - 5000) // 3].add(r["shard"])
    assert max(load.values()) - min(load.values()) < 0.01 * sum(load.values()) / 16
    assert sum(len(g) == 1 for g in groups.values()) > 0.9 * len(groups)


def test_one_group_larger_than_a_shard_is_split(spark):
    rows = [(i, "the same text") for i in range(2000)] + [(10_000 + i, f"another text {i}") for i in range(2000)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()
    load = Counter()
    for r in out:
        load[r["shard"]] += r["size"]
    assert max(load.values()) < 1.02 * sum(load.values()) / 4


def test_classifier_on_held_out_documents(spark, docs, no_docs):
    folder = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify(documents, labels)
    assert out.count() == documents.count()
    tested = out.filter("__held_out").join(labels, "doc_id").collect()
    assert len(tested) > 50 and sum(r["__predicted"] == r["quality"] for r in tested) >= 0.97 * len(tested)
    held = {r["doc_id"]: r["__held_out"] for r in out.collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in held.items())
    awkward = quality.classify(docs, labels, carry=docs.columns)
    assert awkward.count() == docs.count() and awkward.filter("__score BETWEEN 0 AND 1").count() == docs.count()
    assert quality.classify(no_docs, labels).count() == 0
    no_labels = quality.classify(docs, labels.limit(0)).select("__score").distinct().collect()
    assert [r[0] for r in no_labels] == [0.5]


def test_passages_cover_the_whole_text():
    texts = [None, "", " ".join(f"w{k}" for k in range(100_000)), "ein Wort"]
    counts, x = quality.encode_passages(texts)
    assert counts.tolist() == [1, 1, 256, 1] and x.shape == (259, quality.WIDTH)
    again = quality.encode_passages(texts[2:3])[1]
    assert np.array_equal(x[2:258], again) and not x[:2].any()
    spaced = quality.encode_passages(["\n \n", " \n ein Wort", " \n\n", "  ein Wort"])[1]
    assert np.array_equal(spaced[1], spaced[3]) and np.array_equal(spaced[1], x[258])


def test_attention_gradient():
    rng = np.random.default_rng(1)
    counts = np.array([1, 3, 2, 5] * 20)
    x = rng.normal(size=(counts.sum(), quality.WIDTH))
    at = np.cumsum(counts) - counts
    y = np.array([float(x[a:a + n, 0].max() > 0.8) for a, n in zip(at, counts)])
    model = quality.fit(counts, x, y, epochs=150)
    assert np.mean((model.score(counts, x) > 0.5) == (y > 0.5)) > 0.95
