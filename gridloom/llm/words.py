"""Word-wise encoding by a lower-casing BPE tokenizer with word ends.

Such a tokenizer drops white space, so a text's ids are the ids of its
white-space-separated words put end to end, and each distinct word needs encoding
once. Arrow splits a chunk of texts and numbers its distinct words; those are looked
up among the known ones, the rest encoded, and the ids of all words gathered by
number, without a Python object for a word that is known. Words of Latin letters,
which make up the bulk, are split and merged here in numpy matrices from the
vocabulary and merges of the tokenizer file; all others go through the tokenizers
library itself. Both give the library's ids.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .memo import Known
from .merging import PairTable, merge_flat

#: Distinct words and parts of words that a worker knows at most (about 40 bytes each).
MAX_WORDS, MAX_PARTS = 600_000, 300_000
#: Bytes of text whose words are looked up together.
CHUNK_BYTES = 1 << 23
#: Words with a character from here on go through the library: its Unicode tables decide.
FIRST_OTHER = "ɐ"

_ENCODERS: dict[str, WordEncoder] = {}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others follow from U+0100 in order.
    """
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return [chr(b) if b in set(kept) else chr(256 + rest.index(b)) for b in range(256)]


class WordEncoder:
    """encode(texts): the ids of all texts end to end, and how many each has."""

    def __init__(self, path: str):
        import regex

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        rules = [x["pattern"]["Regex"] for x in held["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split" and x["invert"]]
        normal = [x["type"] for x in held["normalizer"]["normalizers"]]
        model = held["model"]
        if len(rules) != 1 or normal != ["NFC", "Replace", "Lowercase"] or not model["end_of_word_suffix"]:
            raise ValueError(f"{path} is not a lower-casing word BPE")
        self.special = [x["content"].encode() for x in held["added_tokens"]]
        vocab, end, letters = model["vocab"], model["end_of_word_suffix"], byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int32)
        self.last = np.array([vocab[x + end] for x in letters], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs = PairTable(np.array([vocab[a] for a, _ in merges]), np.array([vocab[b] for _, b in merges]), np.arange(len(merges), dtype=np.int32))
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.findall = regex.compile(rules[0] + r"|\n").findall
        self.words = Known(self._encode_words, MAX_WORDS)
        self.parts = Known(self._encode_parts, MAX_PARTS)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Null and empty texts give no ids."""
        texts = texts.cast(pa.string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(1 + np.flatnonzero(np.diff(ends // CHUNK_BYTES))).tolist(), len(texts)]
        ids, count = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            lists = pc.ascii_split_whitespace(texts.slice(a, b - a))
            if not len(lists):
                continue
            found, each = self.words.encode(lists.flatten())
            upto = np.concatenate([[0], np.cumsum(each)])
            bounds = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            ids.append(found)
            count.append(np.diff(upto[bounds - bounds[0]]))
        return np.concatenate(ids), np.concatenate(count)

    def documents(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts with end_id after each, and the bounds of the texts therein."""
        ids, count = self.encode(texts)
        bounds = np.concatenate([[0], np.cumsum(count + 1)])
        out = np.full(len(ids) + len(count), end_id, np.uint32)
        inside = np.ones(len(out), bool)
        inside[bounds[1:] - 1] = False
        out[inside] = ids
        return out, bounds

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # Latin letters alone are lower-cased and composed alike here and there.
        other = pc.match_substring_regex(words, f"[^\\x00-{chr(ord(FIRST_OTHER) - 1)}]").to_numpy(zero_copy_only=False)
        for special in self.special:
            other = other | pc.match_substring(words, special.decode()).to_numpy(zero_copy_only=False)
        plain = words.filter(pa.array(~other))
        parts = pa.array(self.findall("\n".join(plain.to_pylist()).lower() + "\n") if len(plain) else [], pa.string())
        stop = pc.equal(parts, "\n").to_numpy(zero_copy_only=False)
        ids, each = self.parts.encode(parts.filter(pa.array(~stop)))
        if not other.any():
            return ids, self._by_word(each, stop)
        count = np.zeros(len(words), np.int64)
        count[~other] = self._by_word(each, stop)
        foreign = [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32) for w in words.filter(pa.array(other)).to_pylist()]
        count[other] = [len(x) for x in foreign]
        out, is_other = np.empty(int(count.sum()), np.uint32), np.repeat(other, count)
        out[~is_other], out[is_other] = ids, np.concatenate(foreign)
        return out, count

    @staticmethod
    def _by_word(each: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Counts of ids of parts put together to words, which end at the stops."""
        of_part = np.zeros(len(stop), np.int64)
        of_part[~stop] = each
        return np.diff(np.cumsum(of_part)[stop], prepend=0)

    def _encode_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1].astype(np.int64)
        raw = np.frombuffer(parts.buffers()[2] or b"", np.uint8)
        return merge_flat(raw, bounds[:-1], np.diff(bounds), self._start, self.pairs, self.merged)

    def _start(self, raw: np.ndarray, size: np.ndarray) -> np.ndarray:
        ids = self.inner[raw]
        at = np.arange(len(raw))
        ids[at, size - 1] = self.last[raw[at, size - 1]]
        return ids


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for the tokenizer file at path."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def cut(bounds: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches between bounds cut every ``most`` from their start: (number of the stretch, number of the piece therein, first place), by place."""
    each = -(-np.diff(bounds) // most)
    stretch = np.repeat(np.arange(len(each)), each)
    piece = np.arange(len(stretch)) - np.repeat(np.cumsum(each) - each, each)
    return stretch, piece, bounds[stretch] + piece * most
