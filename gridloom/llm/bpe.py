"""Byte-level BPE encoding and decoding with numpy matrices.

Texts are cut by the tokenizer's pattern. Arrow numbers the distinct cuts of a chunk of
texts; those that a worker has not seen yet are dealt by length into matrices padded to the bucket's width; in each
round every row merges its leftmost pair of least rank, ranks coming from an
open-addressing hash table of pairs, the row closes up, and rows without a
mergeable pair leave the matrix. Cuts beyond MATRIX_BYTES, where a round per merge
would take quadratic time, are merged in the same order with a heap.

Defined results: null texts count as empty; an empty text has no ids and the
digests of nothing; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .memo import Known, gathered
from .merging import PairTable, merge_flat

#: Distinct cuts that a worker knows at most.
MAX_CACHED = 600_000
#: Characters of text cut together.
CHUNK_CHARS = 1 << 22

_ENCODERS: dict[tuple[str, str], ByteBpe] = {}


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        import regex

        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        # White space as Unicode defines it; Python's own class also takes the separators 1C to 1F.
        space = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        own = pattern.replace(r"[^\s\p{L}", rf"[^{space}\p{{L}}").replace(r"(?!\S)", rf"(?![^{space}])").replace(r"\s", f"[{space}]")
        if "\\s" in own or "\\S" in own:
            raise ValueError(f"a pattern whose white space is not spelled out: {pattern}")
        self.findall = regex.compile(own).findall
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        rows = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, merged = np.array(rows, np.int64).T
        self.pairs = PairTable(left, right, merged.astype(np.int32))
        self.identity = np.arange(len(self.tokens), dtype=np.int32)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.cuts = Known(self._encode_cuts, MAX_CACHED)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has."""
        ids, count, held, size, ends = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [], 0, []

        def done() -> None:
            found, each = self.cuts.encode(pa.array(held, pa.string()))
            upto = np.concatenate([[0], np.cumsum(each)])
            ids.append(found)
            count.append(np.diff(upto[ends], prepend=0))

        for text in texts:
            if text:
                held += self.findall(text)
                size += len(text)
            ends.append(len(held))
            if size >= CHUNK_CHARS:
                done()
                held, size, ends = [], 0, []
        if ends:
            done()
        return np.concatenate(ids), np.concatenate(count)

    def _encode_cuts(self, cuts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = [x.encode() for x in cuts.to_pylist()]
        whole = np.fromiter((self.ranks.get(x, -1) for x in raw), np.int64, len(raw))
        rest = np.flatnonzero(whole < 0)
        joined = [raw[k] for k in rest.tolist()]
        size = np.fromiter(map(len, joined), np.int64, len(joined))
        merged, each = merge_flat(np.frombuffer(b"".join(joined), np.uint8), np.cumsum(size) - size, size, lambda matrix, _: self.byte_ids[matrix], self.pairs, self.identity)
        count = np.ones(len(raw), np.int64)
        count[rest] = each
        out, by_merges = np.empty(int(count.sum()), np.uint32), np.repeat(whole < 0, count)
        out[by_merges], out[~by_merges] = merged, whole[whole >= 0]
        return out, count

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids end to end, and how many each id has."""
        count = self.lengths[ids]
        return gathered(self.flat, self.first[ids], count), count


def encoder(path: str, pattern: str) -> ByteBpe:
    """The worker's encoder."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = ByteBpe(path, pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) to (doc_id, ids array<int>)."""

    def run(batches):
        own = encoder(path, pattern)
        for batch in batches:
            ids, count = own.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *count]).astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) to (doc_id, decoded binary); null ids decode to nothing."""

    def run(batches):
        own = encoder(path, pattern)
        for batch in batches:
            out = [own.decode(np.array(x or [], np.int64))[0].tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    ship(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(raw: bytes, bounds: np.ndarray) -> list[str]:
    """SHA-256 of each stretch of bytes between bounds."""
    view, at = memoryview(raw), bounds.tolist()
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes each whole text; token count and digests of ids and decoded bytes."""

    def run(batches):
        own = encoder(path, pattern)
        for batch in batches:
            ids, count = own.encode(batch.column(1).to_pylist())
            bounds = np.concatenate([[0], np.cumsum(count)])
            raw, lengths = own.decode(ids)
            places = np.concatenate([[0], np.cumsum(lengths)])[bounds]
            columns = [batch.column(0), pa.array(count), pa.array(digests(ids.astype("<u4").tobytes(), 4 * bounds), pa.string()), pa.array(digests(raw.tobytes(), places), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
