"""Frequent phrases and how strongly their parts belong together.

Level by level: a phrase can only be frequent if its parts are, so the text is read once a level and its phrases whose parts are frequent are dealt
to parts by their hash. A part makes double-array tries of bounded size of the phrases that may be frequent. Numpy moves the states of all
phrases dealt to the part through a trie at once, one symbol at a time, and adds up what reaches the accepting states.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specval.llm.common import text_of
from specval.llm.text import _BYTE_VALUE, mix, powers, slices
from specval.session import materialize

MAX_WORDS = 3
LEAST = 10
TOP = 2000
RUN_BYTES = 3_000_000  # text whose words a task holds at a time, about half a million
SLICE_BYTES = 250_000  # text whose bytes are treated at a time
RUN_WORDS = 30_000  # keys of a row, or more up to the next end of a piece; values below half a megabyte are light on the JVM's collector
HELD_KEYS = 400_000  # keys that are sorted and counted together
PART_WORDS = 500_000  # words of the text for each part that its phrases are dealt to
STEP_POSITIONS = 250_000  # phrases whose states move together
SUM_BITS = 20  # sums by hash that say which phrases of a part may be frequent
TRIE_PHRASES = 500_000  # of one trie, some 25 MB
BROADCAST_KEYS = 4_000_000  # of 8 bytes
FLAG_BITS = 27  # 16 MB

_SPACE, _BREAK, _LOWER = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_SPACE[[0x20, 0x09]] = True
_MARKS = [bytes([b]) for b in b".,;:!?\x0a\x0b\x0c\x0d"]
_BREAK[[ord(b) for b in _MARKS]] = True
_LOWER[65:91] += 32
_VALUE = _BYTE_VALUE.copy()
_VALUE[[0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x09]] = 0


# --- words


def words_of(texts: list[bytes], langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, starts, ends, texts, bytes): the words of all texts in order as 64-bit hashes of language and word, 0 where a piece ends, with
    their places in the lower-cased bytes and the numbers of their texts. The hash 0 is never a word's."""
    raw = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    gap = _SPACE[raw] | _BREAK[raw]
    inside = ~gap
    starts = np.flatnonzero(inside & np.concatenate(([True], gap[:-1])))
    ends = np.flatnonzero(gap & np.concatenate(([False], inside[:-1])))
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, raw
    reach = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, reach)
    values = np.where(gap[starts[0]:], np.uint64(0), _VALUE[raw[starts[0]:]] * powers(int(reach.max()))[place])
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    hashes = mix(np.add.reduceat(values, starts - starts[0]) + (ends - starts).astype(np.uint64))
    keys = np.maximum(mix(hashes ^ langs[text]), np.uint64(1))
    pieces = np.cumsum(_BREAK[raw])[starts]
    cut = np.flatnonzero(np.diff(pieces)) + 1
    spaced, first, last, own = (np.insert(x, cut, 0) for x in (keys, starts, ends, text))
    return spaced, first, last, own, raw


def _cut(text: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """A long text in parts that end where a piece ends, so that no phrase is cut."""
    at = 0
    while len(text) - at > size:
        end = max(text.rfind(mark, at, at + size) for mark in _MARKS)
        if end < 0:
            later = [e for mark in _MARKS if (e := text.find(mark, at + size)) >= 0]
            end = min(later, default=len(text) - 1)
        yield text[at:end + 1]
        at = end + 1
    yield text[at:]


def _strings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    body = raw[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)]
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body.tobytes()))


def _lang_hash(lang: str, seed: int) -> int:
    raw = np.frombuffer(f"{seed}:{lang}".encode(), np.uint8)
    return int(mix(np.array([(_VALUE[raw] * powers(len(raw))).sum() + np.uint64(len(raw))], np.uint64))[0])


def _tokens(docs: DataFrame, text_col: str, lang_col: str, seed: int, run_bytes: int) -> DataFrame:
    """Some texts at a time: rows with ``run`` (their words as keys, 8 bytes each, 0 where a piece ends), then a row for each different word among
    them (``key``, ``lang``, ``word``, ``count``)."""
    kinds = [("run", pa.binary()), ("key", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("count", pa.int64())]

    def batch(size: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(n, pa.nulls(size, t)) for n, t in kinds], names=[n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, tuple[int, int]] = {}
        parts: list[tuple] = []
        texts: list[bytes] = []
        langs: list[str] = []
        size = held = 0

        def hash_slice() -> None:
            names, which = np.unique(np.array(langs, object), return_inverse=True)
            for name in names:
                codes.setdefault(name, (len(codes), _lang_hash(name, seed)))
            keys, starts, ends, own, raw = words_of(texts, np.array([codes[name][1] for name in names], np.uint64)[which])
            offset = sum(len(p[4]) for p in parts)
            places = np.array([codes[name][0] for name in names])[which]
            # a slice ends where a piece ends
            parts.append((np.append(keys, np.uint64(0)), np.append(starts + offset, 0), np.append(ends + offset, 0), np.append(places[own], 0), raw))
            texts.clear(), langs.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            keys, starts, ends, own, raw = (np.concatenate(p) for p in zip(*parts))
            parts.clear()
            ends_of_pieces = np.flatnonzero(keys == 0) + 1
            cuts = np.unique(ends_of_pieces[np.searchsorted(ends_of_pieces, np.arange(RUN_WORDS, len(keys), RUN_WORDS))])
            runs = [r.tobytes() for r in np.split(keys, cuts) if len(r)]
            yield batch(len(runs), run=pa.array(runs, pa.binary()))
            full = np.flatnonzero(keys)
            different, first, counts = np.unique(keys[full], return_index=True, return_counts=True)
            first = full[first]
            words = _strings(raw, starts[first], ends[first])
            lang = pa.array(list(codes), pa.string()).take(pa.array(own[first]))
            codes.clear()
            for at in range(0, len(different), 50_000):
                piece = slice(at, at + 50_000)
                yield batch(len(different[piece]), key=pa.array(different[piece].astype(np.int64)), lang=lang[piece], word=words[piece],
                            count=pa.array(counts[piece]))

        for part in slices(batches):
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for body in _cut(text.encode("utf-8", "surrogatepass")):
                    texts.append(body)
                    langs.append(lang)
                    size += len(body) + 1
                    if size >= min(SLICE_BYTES, run_bytes):
                        hash_slice()
                        held, size = held + size, 0
                    if held >= run_bytes:
                        yield from flush()
                        held = 0
        if texts:
            hash_slice()
        if parts:
            yield from flush()

    read = docs.select(text_of(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    return read.mapInArrow(run, "run binary, key long, lang string, word string, count long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for blob in batch.column(0):
            yield np.frombuffer(blob.as_buffer(), np.uint64)


def _together(arrays: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Short arrays joined to some of ``HELD_KEYS`` rows, so that what repeats is found together."""
    held: list[np.ndarray] = []
    for array in arrays:
        held.append(array)
        if sum(map(len, held)) >= HELD_KEYS:
            yield np.concatenate(held)
            held.clear()
    if held:
        yield np.concatenate(held)


# --- flags: which keys may be frequent


def fold(keys: list[np.ndarray]) -> np.ndarray:
    """One key of the words of a phrase."""
    out = keys[0]
    for k in keys[1:]:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + k)
    return out


class Flags:
    """One bit per value of the upper bits of a 64-bit hash."""

    def __init__(self, bits: int, words: np.ndarray):
        self.shift, self.bytes = np.uint64(64 - bits), words.view(np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes >> self.shift
        return (self.bytes[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _flags(hashes: DataFrame, column: str, bits: int) -> Flags:
    """Flags of all hashes in the column. A bit that several share lets candidates through, never keeps one out.

    Aggregated to words of 64 bits, of which there are at most 2 ** (bits - 6), before they reach the driver.
    """
    bit = F.shiftrightunsigned(F.col(column), 64 - bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    rows = hashes.groupBy(F.shiftrightunsigned(bit, 6).alias("at")).agg(F.bit_or(one).alias("bits"))
    table = rows.toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[table.column("at").to_numpy()] = table.column("bits").to_numpy().astype(np.uint64)
    return Flags(bits, out)


def _windows(run: np.ndarray, length: int, flags: Flags) -> np.ndarray:
    """Starts of the phrases of ``length`` words whose two parts of ``length - 1`` words are flagged."""
    n = len(run) - length + 1
    if n < 1:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    for k in range(length):
        ok &= run[k:k + n] != 0
    part = fold([run[k:len(run) - length + 2 + k] for k in range(length - 1)])
    safe = flags.has(mix(part))
    return np.flatnonzero(ok & safe[:n] & safe[1:n + 1])


# --- tries


class Trie:
    """Double array of phrases. A phrase is a row of symbols 0 to 255; ``leaf`` of the state that ends it is its row number.

    The children of a state stand at ``base[state] + symbol``, where ``check`` names the state. Placed in bulk: groups of many children
    get blocks of their own, smaller ones try random places together and the free ones win, single children fill what is left.
    """

    def __init__(self, rows: np.ndarray):
        self.phrases, depth = len(rows), rows.shape[1]
        size = 1024
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.check[0] = 0
        rng = np.random.default_rng(3)
        state = np.zeros(len(rows), np.int32)  # of each phrase so far; rows are sorted, so equal prefixes are neighbours
        for level in range(depth):
            symbol = rows[:, level].astype(np.int32)
            new = np.ones(len(rows), bool)
            new[1:] = (state[1:] != state[:-1]) | (symbol[1:] != symbol[:-1])
            parents, symbols = state[new], symbol[new]
            first = np.concatenate(([True], parents[1:] != parents[:-1]))
            starts = np.flatnonzero(first)
            bases = self._place(np.diff(np.append(starts, len(parents))), starts, symbols, parents[starts], rng)
            self.base[parents[starts]] = bases
            child = bases[np.cumsum(first) - 1] + symbols
            state = child[np.cumsum(new) - 1].astype(np.int32)
        self.leaf = np.full(len(self.check), -1, np.int32)
        self.leaf[state] = np.arange(len(rows))

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, int(1.3 * len(self.check))) - len(self.check)
            self.base = np.concatenate((self.base, np.zeros(more, np.int32)))
            self.check = np.concatenate((self.check, np.full(more, -1, np.int32)))

    def _place(self, sizes, starts, symbols, parents, rng) -> np.ndarray:
        bases = np.full(len(sizes), -1, np.int64)
        large = np.flatnonzero(sizes > 24)
        end = len(self.check)
        bases[large] = end + 256 * np.arange(len(large))
        self._grow(end + 256 * len(large))
        self._take(large, bases, sizes, starts, symbols, parents)
        for low, high in ((9, 24), (4, 8), (2, 3)):
            left = np.flatnonzero((sizes >= low) & (sizes <= high))
            turn = 0
            while len(left):
                self._grow(int(1.5 * ((self.check >= 0).sum() + sizes[left].sum())) + 512)
                if turn % 8 == 7:
                    self._grow(len(self.check) + 512 + 2 * int(sizes[left].sum()))
                tried = rng.integers(0, len(self.check) - 256, len(left))
                group = np.repeat(np.arange(len(left)), sizes[left])
                within = np.arange(len(group)) - np.repeat(np.cumsum(sizes[left]) - sizes[left], sizes[left])
                slot = tried[group] + symbols[starts[left][group] + within]
                bad = self.check[slot] >= 0
                claim = np.full(len(self.check), len(left), np.int32)
                np.minimum.at(claim, slot[~bad], group[~bad].astype(np.int32))
                bad |= claim[slot] != group
                failed = np.zeros(len(left), bool)
                failed[group[bad]] = True
                won = left[~failed]
                bases[won] = tried[~failed]
                self._take(won, bases, sizes, starts, symbols, parents)
                left = left[failed]
                turn += 1
        single = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(self.check[256:] < 0) + 256
        if len(free) < len(single):
            end = len(self.check)
            self._grow(end + len(single) - len(free) + 1)
            free = np.concatenate((free, np.arange(end, len(self.check))))
        bases[single] = free[:len(single)] - symbols[starts[single]]
        self._take(single, bases, sizes, starts, symbols, parents)
        return bases

    def _take(self, groups, bases, sizes, starts, symbols, parents) -> None:
        group = np.repeat(groups, sizes[groups])
        within = np.arange(len(group)) - np.repeat(np.cumsum(sizes[groups]) - sizes[groups], sizes[groups])
        self.check[bases[group] + symbols[starts[group] + within]] = parents[group]

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none."""
        at = self.base[states] + symbols
        inside = at < len(self.check)
        at[~inside] = 0
        return np.where(inside & (self.check[at] == states) & (at > 0), at, -1)


class Phrases:
    """A trie of phrases given by their words' keys, with the small alphabet it needs."""

    def __init__(self, keys: np.ndarray):
        self.words = np.unique(keys)
        self.digits = 1 if len(self.words) <= 256 else 2 if len(self.words) <= 65536 else 3
        ids = np.searchsorted(self.words, keys)
        self.length = keys.shape[1]
        symbols = np.concatenate([self._symbols(ids[:, k]) for k in range(self.length)], axis=1)
        self.order = np.lexsort(symbols.T[::-1])  # the rows of ``keys`` in the order of the counts
        self.trie = Trie(symbols[self.order])

    def _symbols(self, ids: np.ndarray) -> np.ndarray:
        return np.stack([(ids >> (8 * d)) & 255 for d in reversed(range(self.digits))], axis=1).astype(np.uint8)

    def counts(self, run: np.ndarray) -> np.ndarray:
        """Occurrences of each phrase in a text."""
        n = max(0, len(run) - self.length + 1)
        return self.sums([run[k:k + n] for k in range(self.length)], np.ones(n, np.int64))

    def sums(self, words: list[np.ndarray], seen: np.ndarray) -> np.ndarray:
        """How often each phrase is there, given phrases by their first, second, ... words and how often each of them was seen."""
        total = np.zeros(self.trie.phrases, np.int64)
        for at in range(0, len(seen), STEP_POSITIONS):
            step = slice(at, at + STEP_POSITIONS)
            rows, leaf = self._leaves([w[step] for w in words])
            np.add.at(total, leaf, seen[step][rows])
        return total

    def _leaves(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The rows that are phrases of the trie, and which ones. The states of all rows go down together."""
        at = np.arange(len(words[0]))
        states = np.zeros(len(at), np.int32)
        for word in words:
            here = np.searchsorted(self.words, word[at])
            here[here == len(self.words)] = 0
            known = self.words[here] == word[at]
            at, states, here = at[known], states[known], here[known]
            for d in reversed(range(self.digits)):
                states = self.trie.step(states, ((here >> (8 * d)) & 255).astype(np.int32))
                alive = states >= 0
                at, states, here = at[alive], states[alive], here[alive]
        leaf = self.trie.leaf[states]
        return at[leaf >= 0], leaf[leaf >= 0]


# --- levels


def _phrase_columns(length: int) -> list[str]:
    return [f"w{k}" for k in range(length)]


def _dealt(tokens: DataFrame, length: int, flags, parts: int) -> DataFrame:
    """The phrases in the text whose parts are flagged, dealt to ``parts`` by their hash: rows of ``part`` and ``rows``, in which the first words
    of some phrases are followed by their second words, ..., and by how often each was seen, 8 bytes each.

    A task sends each phrase of some of its text once, with how often it is there, so a phrase that a third of all texts hold is
    a few bytes for some of its text.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def phrases() -> Iterator[np.ndarray]:
            for run in _runs(batches):
                at = _windows(run, length, flags.value)
                yield np.stack([run[at + k] for k in range(length)], axis=1)

        for seen in _together(phrases()):
            hashes, first, counts = np.unique(mix(fold(list(seen.T))), return_index=True, return_counts=True)
            part = _part(hashes, parts)  # in order, as the hashes are
            table = np.column_stack((seen[first], counts.astype(np.uint64)))
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))[:len(part)]
            rows = [table[a:b].T.tobytes() for a, b in zip(starts, [*starts[1:], len(part)])]
            yield pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array(rows, pa.binary())], names=["part", "rows"])

    return tokens.mapInArrow(tally, "part int, rows binary").repartitionById(parts, F.col("part"))


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of a phrase, by the upper half of its hash."""
    return (hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def _counted(tokens: DataFrame, length: int, flags, least: int, parts: int, trie_phrases: int) -> DataFrame:
    """The phrases whose parts are flagged, with their exact number of occurrences, as far as that is ``least`` or more."""
    names = _phrase_columns(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(blob.as_buffer(), np.uint64).reshape(length + 1, -1) for batch in batches for blob in batch.column(1)]
        if not held:
            return
        table = np.concatenate(held, axis=1)
        held.clear()
        words, seen = list(table[:length]), table[length].astype(np.int64)
        hashes = mix(fold(words))
        bucket = (hashes & np.uint64((1 << SUM_BITS) - 1)).astype(np.int64)
        enough = np.zeros(1 << SUM_BITS, np.int64)
        np.add.at(enough, bucket, seen)
        may = np.flatnonzero(enough[bucket] >= least)  # phrases that share a sum may come along, none is kept out
        words, seen = [w[may] for w in words], seen[may]
        _, first = np.unique(hashes[may], return_index=True)
        for at in range(0, len(first), trie_phrases):
            keys = np.stack([w[first[at:at + trie_phrases]] for w in words], axis=1)
            phrases = Phrases(keys)
            total = phrases.sums(words, seen)
            often = np.flatnonzero(total >= least)
            own = keys[phrases.order[often]].astype(np.int64)
            yield pa.RecordBatch.from_arrays([*[pa.array(own[:, k]) for k in range(length)], pa.array(total[often])], names=[*names, "a"])

    found = _dealt(tokens, length, flags, parts).mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", a long")
    return materialize(found, f"phrases{length}")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST, top: int = TOP,
                 trie_phrases: int = TRIE_PHRASES, flag_bits: int = FLAG_BITS, run_bytes: int = RUN_BYTES, part_words: int = PART_WORDS) -> DataFrame:
    """Each language's best phrases of 2 to ``max_words`` words: ``lang``, ``rank``, ``phrase``, ``a`` (occurrences), ``l``, ``r`` (those of
    the two parts of its weakest cut), ``n`` (words of the language) and ``score`` (floor of 1000000 a a / (l r)).

    Texts are lower-cased in A to Z, cut at ``. , ; : ! ?`` and line ends, and split at spaces and tabs. A phrase that a longer frequent phrase holds, with at
    least half its occurrences, is left out. A missing text is empty, a missing language is ``und``; repeated rows count again. Empty
    tables and tables without a frequent phrase give an empty result; other columns are not read, so their names can't clash.

    Words are told apart by 64-bit hashes; should two words of a language share one, another seed is taken.
    """
    spark = docs.sparkSession
    seed = 0
    while True:
        table = materialize(_tokens(docs, text_col, lang_col, seed, run_bytes), "phrases-text")
        words, tokens = table.filter("key IS NOT NULL"), table.filter("run IS NOT NULL").select("run")
        frequent = words.groupBy(F.col("key").alias("w0")).agg(F.sum("count").alias("a")).filter(F.col("a") >= least)
        frequent = materialize(frequent, "phrases-words")
        keys = frequent.select(F.col("w0").alias("key"))
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
        names = materialize(words.join(keys, "key", "left_semi").select("key", "lang", "word").distinct(), "phrases-names")
        if names.groupBy("key").count().filter("count > 1").isEmpty():
            break
        seed += 1
    sizes = words.groupBy("lang").agg(F.sum("count").alias("n"))
    parts = max(1, -(-(words.agg(F.sum("count")).first()[0] or 0) // part_words))
    levels = {1: frequent}
    for length in range(2, max_words + 1):
        flags = spark.sparkContext.broadcast(_flags(_with_fold(levels[length - 1], length - 1), "fold", flag_bits))
        levels[length] = _counted(tokens, length, flags, least, parts, trie_phrases)
        flags.destroy()
    scored = [_scored(levels, length) for length in range(2, max_words + 1)]
    kept = []
    for length, rows in zip(range(2, max_words + 1), scored):
        longer = [levels[m].select(*[F.col(f"w{k + at}").alias(f"w{k}") for k in range(length)], F.col("a").alias("b"))
                  for m in range(length + 1, max_words + 1) for at in range(m - length + 1)]
        phrase = _phrase_columns(length)
        if longer:
            held = longer[0]
            for more in longer[1:]:
                held = held.union(more)
            held = held.groupBy(*phrase).agg(F.max("b").alias("b"))
            rows = rows.join(held, phrase, "left").filter("b IS NULL OR 2 * b < a").drop("b")
        kept.append(rows.select(F.array(*phrase).alias("words"), "a", "l", "r", "score"))
    all_rows = kept[0]
    for more in kept[1:]:
        all_rows = all_rows.union(more)
    spelled = materialize(all_rows.withColumn("id", F.monotonically_increasing_id()), "phrases-scored")
    text = spelled.select("id", F.posexplode("words").alias("k", "key")).join(names, "key").groupBy("id").agg(
        F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda p: p["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = spelled.join(text, "id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(sizes) if sizes.count() < 100_000 else sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _with_fold(rows: DataFrame, length: int) -> DataFrame:
    """The keys of phrases as ``fold`` and ``mix`` make them for the positions of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k).to_numpy().astype(np.uint64) for k in range(length)]
            yield pa.RecordBatch.from_arrays([pa.array(mix(fold(keys)).astype(np.int64))], names=["fold"])

    return rows.select(*_phrase_columns(length)).mapInArrow(run, "fold long")


def _scored(levels: dict[int, DataFrame], length: int) -> DataFrame:
    """The phrases of one length with the counts of their weakest cut. All parts are frequent, so their counts are known."""
    rows = levels[length]
    wide = "decimal(19,0)"
    best = None
    for k in range(1, length):
        left = levels[k].select(*[F.col(c) for c in _phrase_columns(k)], F.col("a").alias(f"l{k}"))
        right = levels[length - k].select(*[F.col(f"w{j}").alias(f"w{j + k}") for j in range(length - k)], F.col("a").alias(f"r{k}"))
        rows = rows.join(left, _phrase_columns(k)).join(right, [f"w{j}" for j in range(k, length)])
        floor = F.expr(f"(1000000 * CAST(a AS {wide}) * CAST(a AS {wide})) DIV (CAST(l{k} AS {wide}) * CAST(r{k} AS {wide}))")
        cut = F.struct(floor.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
        best = cut if best is None else F.least(best, cut)
    return rows.withColumn("best", best).select(*_phrase_columns(length), "a", "best.l", "best.r", "best.score")
