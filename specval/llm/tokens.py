"""Token ids by public vocabularies, word by word: each different word is tokenized once per Python worker."""

from __future__ import annotations

import os
import re

import numpy as np

#: Latin letters and then ASCII punctuation (no apostrophe): the tokenizer cuts between the two and treats both alone.
PLAIN = re.compile(r"([a-zA-ZÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")
CACHED_WORDS = 600_000
GROUP = 1000


class Recent:
    """What was asked for of late: about ``limit`` entries and those of the batch at hand. The older half goes when the newer is full."""

    def __init__(self, limit: int):
        self.half, self.new, self.old = limit // 2, {}, {}

    def missing(self, keys: list) -> list:
        """The keys it doesn't hold; those of the older half move to the newer one."""
        if len(self.new) > self.half:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        absent = [k for k in keys if k not in new]
        known = [k for k in absent if k in old]
        new.update(zip(known, map(old.__getitem__, known)))
        return [k for k in absent if k not in old] if known else absent

    def add(self, keys, values) -> None:
        self.new.update(zip(keys, values))

    def all(self, keys) -> list:
        """Values of keys that ``missing`` was asked for and that were added since."""
        return list(map(self.new.__getitem__, keys))


class WordBpe:
    """Ids of a ``tokenizers`` vocabulary that drops white space and marks word ends, as ``encode`` gives them.

    As white space separates tokens for sure, the ids of a text are those of its words one after the other. Words made
    of Latin letters go to the vocabulary's model in groups, as normalising and splitting would leave them as they are in lower case;
    all others go through the whole tokenizer. Words seen of late are kept.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.whole, self.model):
            t.encode_special_tokens = True
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        for token, number in self.whole.get_vocab().items():
            self.ends[number] = token.endswith("</w>")
        if self._whole(["a b c"])[0] != b"".join(self._whole(["a", "b", "c"])):
            raise ValueError("the vocabulary doesn't tokenize word by word")
        self.words, self.cores, self.marks = Recent(CACHED_WORDS), Recent(CACHED_WORDS // 2), Recent(CACHED_WORDS // 10)

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]

    def _core_ids(self, cores: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(cores), GROUP):
            group = cores[at:at + GROUP]
            ids = np.array(self.model.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, "<u2")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group):
                raise ValueError("the vocabulary doesn't mark the ends of words")
            raw = ids.tobytes()
            out += [raw[2 * a:2 * b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())]
        return out

    def streams(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of ids of each word, ids of all of them one after the other) of different words."""
        new = self.words.missing(words)
        parts = list(map(PLAIN.match, new))
        plain = [w for w, m in zip(new, parts) if m]
        other = [w for w, m in zip(new, parts) if not m]
        cores = [m[1].lower() for m in parts if m]
        marks = [m[2] for m in parts if m]
        del parts
        for cache, keys, make in ((self.cores, cores, self._core_ids), (self.marks, marks, self._whole)):
            fresh = cache.missing(list(dict.fromkeys(keys)))
            cache.add(fresh, make(fresh))
        self.words.add(plain, map(bytes.__add__, self.cores.all(cores), self.marks.all(marks)))
        self.words.add(other, self._whole(other))
        found = self.words.all(words)
        return np.fromiter(map(len, found), np.int64, len(found)) // 2, np.frombuffer(b"".join(found), "<u2")


class WordPieces:
    """Ids of a ``sentencepiece`` vocabulary, every word on its own; the cache is emptied when it is full."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(k) for k in range(self.model.vocab_size())])
        self.words: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        if len(self.words) > CACHED_WORDS:
            self.words = {}
        new = list(set(words).difference(self.words))
        if new:
            self.words.update(zip(new, (np.array(x, "<u2").tobytes() for x in self.model.encode(new, num_threads=1))))

    def ids(self, words: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<u2")


_LOADED: dict[tuple[type, str], object] = {}


def loaded(kind: type, path: str):
    """One tokenizer per Python worker."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]
