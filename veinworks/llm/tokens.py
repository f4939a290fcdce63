"""Encoding of Arrow text columns with the tokenizers library.

A tokenizer whose pre-tokenizer drops white space encodes every white-space
separated chunk by itself. For such a file the distinct chunks of a batch are
encoded once, and the ids are gathered by numpy; the ids are those that
``Tokenizer.encode`` gives for the whole text. Other files are encoded text by text.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: the splitting rule of tokenizer files whose words can be encoded one by one.
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Most distinct words that a Python worker remembers, and the longest remembered.
MEMORY_WORDS, MEMORY_LENGTH = 1_000_000, 64
#: Texts of more bytes in all are encoded in turns, to bound memory.
TURN_BYTES = 4_000_000


class Encoder:
    """Encodes texts with the tokenizer file at ``path``; null texts count as empty ones."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocabulary = self.whole.get_vocab_size(with_added_tokens=True)
        self.special = tuple(t["content"] for t in spec.get("added_tokens", []))
        self.by_word = self._words_stand_alone(spec)
        self.known: dict[str, bytes] = {}
        if self.by_word:
            self.words = Tokenizer.from_file(path)
            self.words.normalizer = None
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(self.vocabulary, bool)
            for token, i in self.whole.get_vocab().items():
                self.ends[i] = token.endswith("</w>")
            self.rule = regex.compile(WORD_RULE + r"|\n")

    @staticmethod
    def _words_stand_alone(spec: dict) -> bool:
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        normal = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        return (
            len(steps) == 2
            and steps[0].get("pattern") == {"Regex": WORD_RULE}
            and steps[0].get("behavior") == "Removed"
            and steps[0].get("invert") is True
            and normal == ["NFC", "Replace", "Lowercase"]
            and spec["model"].get("end_of_word_suffix") == "</w>"
            and not any(t["normalized"] or t["single_word"] for t in spec.get("added_tokens", []))
        )

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (uint32), and where each text's ids begin and the last ones end."""
        texts = pc.fill_null(texts, "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        turns, at = [], 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), TURN_BYTES, side="right")) + at)
            turns.append(self._turn(texts.slice(at, upto - at)))
            at = upto
        ids = np.concatenate([t[0] for t in turns]) if turns else np.zeros(0, np.uint32)
        counts = np.concatenate([t[1] for t in turns]) if turns else np.zeros(0, np.int64)
        return ids, np.concatenate([[0], np.cumsum(counts)])

    def _turn(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            found = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate(found), np.array([len(x) for x in found], np.int64)
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        edges = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(edges[0], edges[-1] - edges[0]).dictionary_encode()
        flat, start, length = self._chunks(coded.dictionary)
        ids, per_word = gathered(flat, start, length, coded.indices.to_numpy(zero_copy_only=False))
        return ids, np.diff(np.concatenate([[0], np.cumsum(per_word)])[edges - edges[0]])

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks: all in a row, where those of each chunk start, and how many it has."""
        texts = chunks.to_numpy(zero_copy_only=False)
        plain = pc.and_(pc.match_substring_regex(chunks, r"^[\x21-\x7e\x{a1}-\x{24f}]*$"), pc.invert(pc.match_substring_regex(chunks, "|".join(map(regex.escape, self.special)) or "^\\b$"))).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(plain & ~pc.string_is_ascii(chunks).to_numpy(zero_copy_only=False))
        plain[other] = [unicodedata.is_normalized("NFC", t) for t in texts[other].tolist()]
        apart = np.flatnonzero(~plain)
        # the words of all plain chunks, each chunk's followed by a line break
        words = self.rule.findall("\n".join(texts[plain].tolist()).lower() + "\n")
        each = self._words(words)
        ids = np.frombuffer(b"".join(each), "<u4")
        per_word = np.fromiter(map(len, each), np.int64, len(each)) // 4
        breaks = np.flatnonzero(per_word == 0)
        upto = np.concatenate([[0], np.cumsum(per_word)])[breaks][: int(plain.sum())]
        length, start = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        start[plain] = np.concatenate([[0], upto])[: len(upto)]
        length[plain] = upto - start[plain]
        more = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast(texts[apart].tolist(), add_special_tokens=False)]
        length[apart] = [len(x) for x in more]
        start[apart] = len(ids) + np.concatenate([[0], np.cumsum(length[apart])])[: len(apart)]
        return np.concatenate([ids, *more]), start, length

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as bytes; none for a line break."""
        distinct = set(words)
        distinct.discard("\n")
        new = distinct.difference(self.known)
        if len(self.known) + len(new) > MEMORY_WORDS:
            self.known = {}
            new = distinct
        self.known.update(self._new_words(list(new)))
        self.known["\n"] = b""
        out = list(map(self.known.__getitem__, words))
        for w in new:
            if len(w) > MEMORY_LENGTH:
                del self.known[w]
        return out

    def _new_words(self, words: list[str]) -> dict[str, bytes]:
        met = {}
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            ids = np.array(self.words.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(cuts) == len(some) and cuts[-1] == 4 * len(ids):
                raw, start = ids.tobytes(), 0
                for w, end in zip(some, cuts.tolist(), strict=True):
                    met[w] = raw[start:end]
                    start = end
            else:
                met.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(some, self.whole.encode_batch_fast(some, add_special_tokens=False), strict=True))
        return met


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[start[c] : start[c] + length[c]]`` of all codes c, one after the other, and the length of each."""
    runs = length[code] if len(code) else np.zeros(0, np.int64)
    before = np.cumsum(runs) - runs
    return flat[np.repeat(start[code] - before, runs) + np.arange(int(runs.sum()))] if len(code) else flat[:0], runs


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    return Encoder(path)
