"""Training-order materialisation: a keyed permutation deals sequences to fixed-stride shards.

Documents are tokenized and cut into sequences of at most ``stride`` tokens, written
once as a table. A sequence's index is its place in that table (rows before its file
plus its row there), so indices are dense without a sort. A Feistel network keyed by
``key`` permutes the least power of two that holds all indices; an index that lands
beyond the count walks on along its cycle until it falls inside, which keeps the map
a bijection of the indices. The slot gives shard and row by division. A task
sorts what it has read by shard and compresses each shard's part as one block; blocks
are dealt by ranges of whole shards, and a shard is laid out in memory when its blocks
have come together. Every row of a shard file takes ``stride`` token ids of two bytes,
padded, so a reader resumes at any slot by a seek.

Which index a sequence has follows from how the input was split into tasks when it was
tokenized; the written table fixes it from then on, so lost tasks are repeated alike.

A shard file appears under its name only when complete, and a repeated task writes
the same bytes. An id beyond 65535 is an error. Defined results: null and empty texts hold the end token alone;
repeated rows and null ids are sequences like any others; an empty table writes no
shard; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import ensure_checkpoint_dir, partitions_for, scratch_dir
from .words import cut, encoder

STRIDE = 512
ROWS_PER_SHARD = 4096
PAD = 0
END_ID = 1
ROUNDS = 6
#: Bytes of sequences that a task sorts into blocks at a time, and the blocks' compression.
BLOCK_BYTES, BLOCK_LEVEL = 1 << 25, 5
#: Compression of the sequences' table, which stays on disk beside the blocks and the shards.
TABLE_LEVEL = 9
KEY = 0x5EED


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit mixing of each value."""
    z = x + np.uint64((key * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def permuted(index: np.ndarray, count: int, key: int = KEY) -> np.ndarray:
    """Slots of indices below count: a bijection of range(count) for every key."""
    bits = max(2, (count - 1).bit_length())
    low = bits // 2
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x, right_bits = out[todo], low
        for k in range(ROUNDS):  # the halves swap, and with odd bits their widths too
            left, right = x >> np.uint64(right_bits), x & np.uint64((1 << right_bits) - 1)
            left_bits = bits - right_bits
            left ^= mixed(right, key * ROUNDS + k) & np.uint64((1 << left_bits) - 1)
            x, right_bits = (right << np.uint64(left_bits)) | left, left_bits
        out[todo] = x
        todo = todo[x >= np.uint64(count)]
    return out.astype(np.int64)


def sequences(docs: DataFrame, tokenizer_path: str, stride: int = STRIDE) -> DataFrame:
    """(doc_id, piece, n_tokens, payload): each document's ids and the end token, cut every ``stride`` ids."""

    def run(batches):
        own = encoder(tokenizer_path)
        for batch in batches:
            ids, bounds = own.documents(batch.column(1), END_ID)
            if len(ids) and ids.max() > 0xFFFF:
                raise ValueError("ids beyond 65535 do not fit the shards' two bytes")
            doc, piece, first = cut(bounds, stride)
            places = np.append(first, bounds[-1])
            payload = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((2 * places).astype(np.int32)), pa.py_buffer(ids.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(np.diff(places).astype(np.int32)), payload], names=["doc_id", "piece", "n_tokens", "payload"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, n_tokens int, payload binary")


def in_blocks(table: DataFrame, key: int = KEY, rows: int = ROWS_PER_SHARD) -> tuple[DataFrame, int]:
    """A written table of sequences as blocks (shard, doc_id, piece, n_tokens, row: arrays; payload: zstd); also the count of sequences."""
    placed = table.select("doc_id", "piece", "n_tokens", "payload", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    # One row per file of the table.
    sizes = sorted((r["file"], r["n"]) for r in placed.groupBy("file").agg(F.count("*").alias("n")).collect())
    before = dict(zip([f for f, _ in sizes], np.concatenate([[0], np.cumsum([n for _, n in sizes])])[:-1].tolist(), strict=True)) if sizes else {}
    count = sum(n for _, n in sizes)

    def run(batches):
        packer = zstandard.ZstdCompressor(level=BLOCK_LEVEL)
        for held in gathered(batches, BLOCK_BYTES):
            files = held.column("file").dictionary_encode()
            starts = np.array([before[f] for f in files.dictionary.to_pylist()], np.int64)
            slot = permuted(starts[files.indices.to_numpy()] + held.column("row").to_numpy(), count, key)
            order = np.argsort(slot // rows, kind="stable")
            slot, held = slot[order], held.take(pa.array(order))
            shard, first = np.unique(slot // rows, return_index=True)
            ends = np.append(first, len(slot)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, held.column(c)) for c in ("doc_id", "piece", "n_tokens")]
            lists.append(pa.ListArray.from_arrays(ends, pa.array((slot % rows).astype(np.int32))))
            at = 2 * np.concatenate([[0], np.cumsum(held.column("n_tokens").to_numpy(), dtype=np.int64)])[ends]
            tokens = memoryview(b"".join(held.column("payload").to_pylist()))
            blocks = pa.array([packer.compress(tokens[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(shard), *lists, blocks], names=["shard", "doc_id", "piece", "n_tokens", "row", "payload"])

    return placed.mapInArrow(run, "shard long, doc_id array<long>, piece array<int>, n_tokens array<int>, row array<int>, payload binary"), count


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches put together until they reach ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held and size:
        yield pa.concat_batches(held)


def shard_path(folder: str, shard: int) -> str:
    return os.path.join(folder, f"shard-{shard:08d}.bin")


def write_shards(blocks: DataFrame, count: int, folder: str, stride: int = STRIDE, rows: int = ROWS_PER_SHARD) -> DataFrame:
    """Writes the shards of ``count`` slots to a folder that all executors share; (doc_id, piece, n_tokens, slot, shard, row, crc32). Lazy."""
    target = urlparse(folder).path if ":" in folder else folder
    if urlparse(folder).scheme not in ("", "file"):
        raise ValueError("shards go to a mounted folder")
    kept = ["doc_id", "piece", "n_tokens", "row"]

    def one(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        """Writes a shard of which parts are all the blocks."""
        unpacker = zstandard.ZstdDecompressor()
        column = {c: pa.concat_arrays([x.column(c).flatten() for x in parts]) for c in kept}
        flat = np.frombuffer(b"".join(unpacker.decompress(x) for part in parts for x in part.column("payload").to_pylist()), "<u2")
        n, row = column["n_tokens"].to_numpy().astype(np.int64), column["row"].to_numpy().astype(np.int64)
        ends = np.cumsum(n)
        grid = np.full((len(n), stride), PAD, "<u2")
        grid.reshape(-1)[np.repeat(row * stride - ends + n, n) + np.arange(len(flat))] = flat
        os.makedirs(target, exist_ok=True)
        part = f"{shard_path(target, shard)}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(grid)
        os.replace(part, shard_path(target, shard))
        order = np.argsort(row)
        crc = [zlib.crc32(grid[r, :k]) for r, k in zip(row[order].tolist(), n[order].tolist(), strict=True)]
        taken = [column[c].take(pa.array(order)) for c in kept]
        row = row[order]
        return pa.RecordBatch.from_arrays([*taken[:3], pa.array(shard * rows + row), pa.array(np.full(len(row), shard)), pa.array(row), pa.array(crc, pa.int64())], names=["doc_id", "piece", "n_tokens", "slot", "shard", "row", "crc32"])

    def run(batches):
        shard, parts = -1, []
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b and numbers[a] != shard:
                    if parts:
                        yield one(shard, parts)
                    shard, parts = int(numbers[a]), []
                if a < b:
                    parts.append(batch.slice(a, b - a))
        if parts:
            yield one(shard, parts)

    # Slots are dense, so ranges of whole shards follow from their count, without a sample.
    shards = max(1, -(-count // rows))
    n = min(partitions_for(blocks.sparkSession), shards)
    dealt = blocks.repartitionById(n, F.expr(f"cast((shard * {n}) div {shards} as int)")).sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "doc_id long, piece int, n_tokens int, slot long, shard long, row long, crc32 long")


def read_from(folder: str, slot: int, stride: int = STRIDE, rows: int = ROWS_PER_SHARD) -> Iterator[np.ndarray]:
    """Sequences in training order from a slot on."""
    while os.path.exists(path := shard_path(folder, slot // rows)):
        with open(path, "rb") as f:
            f.seek(slot % rows * stride * 2)
            while raw := f.read(stride * 2):
                yield np.frombuffer(raw, "<u2")
                slot += 1
        if slot % rows:
            return


def materialise(docs: DataFrame, tokenizer_path: str, folder: str | None = None, stride: int = STRIDE, rows: int = ROWS_PER_SHARD, key: int = KEY) -> DataFrame:
    """Tokenizes, permutes and writes the shards; one row per sequence with its place."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_dir(spark, "sequences")
    sequences(docs, tokenizer_path, stride).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(TABLE_LEVEL)).parquet(path)
    blocks, count = in_blocks(spark.read.parquet(path), key, rows)
    return write_shards(blocks, count, folder or scratch_dir(spark, "shards"), stride, rows)
