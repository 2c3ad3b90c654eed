"""Best-fit packing of documents into fixed-size sequences, in bulk-synchronous steps.

Documents are tokenized, cut into pieces of at most ``capacity`` tokens, and
range-sorted by length. Pieces of one length form a class, and so do open
sequences with one gap: both kinds are interchangeable, and there are never more
classes than token slots in a sequence. A step takes the longest class left,
finds its successor among the gap classes (the smallest gap that holds it),
resolves competition by rank (the r-th piece of the class takes the r-th place
in the gap class), updates the gaps and repeats; new sequences open only when
no gap holds the class. The result is what best-fit decreasing gives one piece
at a time.

The sweep sees a histogram of at most ``capacity`` lengths, whatever the corpus
size, so it runs on the driver; every piece then finds its place from its rank
in the distributed sort, without a join. A length shared by a third of all
pieces is split over partitions because the sort continues by id and piece.

Defined results: null and empty texts are one piece holding the end token alone;
repeated rows and null ids are packed like any others; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .tables import ensure_checkpoint_dir, partitions_for
from .words import cut, encoder

CAPACITY = 4096
END_ID = 1

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each document's ids and end_id, cut every ``capacity`` ids."""

    def run(batches):
        own = encoder(tokenizer_path)
        for batch in batches:
            ids, bounds = own.documents(batch.column(1), end_id)
            doc, piece, first = cut(bounds, capacity)
            last = np.append(first[1:], bounds[-1])
            raw = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(first - bounds[doc]), pa.array(last - first), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Places for classes of pieces (length to count), longest first.

    Returns rows (first rank, first sequence, gap, pieces per sequence, length),
    ranks counting through the classes in the order in which they are taken.
    """
    gaps: list[int] = []  # sorted gap classes
    held: dict[int, deque] = defaultdict(deque)  # gap: runs of (first sequence, count)
    plan, rank, opened = [], 0, 0

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            if not held[gap]:
                insort(gaps, gap)
            held[gap].append((first, count))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, count = held[gap].popleft()
                if not held[gap]:
                    gaps.pop(at)
            else:
                gap, first = capacity, opened
                count = -(-left // (capacity // length))
                opened += count
            each = gap // length
            plan.append((rank, first, gap, each, length))
            taken = min(left, count * each)
            full, rest = divmod(taken, each)
            leave(gap - each * length, first, full)
            if rest:
                leave(gap - rest * length, first + full, 1)
            leave(gap, first + full + bool(rest), count - full - bool(rest))
            rank += taken
            left -= taken
    return np.array(plan, np.int64).reshape(-1, 5)


def pack(cuts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces. Offsets of a sequence leave no gap from 0."""
    spark = cuts.sparkSession
    ensure_checkpoint_dir(spark)
    cuts = cuts.checkpoint()
    order = [F.col("length").desc(), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    ranked = cuts.repartitionByRange(partitions_for(spark), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).checkpoint()
    # At most one row for each length and one more for each partition.
    found = ranked.groupBy(F.shiftright("at", 33).alias("part"), "length").agg(F.count("*").alias("n")).collect()
    lengths: dict[int, int] = defaultdict(int)
    parts: dict[int, int] = defaultdict(int)
    for r in found:
        lengths[r["length"]] += r["n"]
        parts[r["part"]] += r["n"]
    plan = sweep(lengths, capacity)
    part_ids = np.array(sorted(parts), np.int64)
    before = np.concatenate([[0], np.cumsum([parts[p] for p in part_ids.tolist()])[:-1]]).astype(np.int64) if parts else np.zeros(0, np.int64)

    def place(batches):
        for batch in batches:
            at = batch.column("at").to_numpy()
            rank = before[np.searchsorted(part_ids, at >> 33)] + (at & ((1 << 33) - 1))
            row = plan[np.searchsorted(plan[:, 0], rank, "right") - 1]
            k = rank - row[:, 0]
            sequence = row[:, 1] + k // row[:, 3]
            offset = capacity - row[:, 2] + (k % row[:, 3]) * row[:, 4]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PLACED)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize, cut and pack documents (doc_id, text); one row per piece."""
    return pack(pieces(docs, tokenizer_path, capacity, end_id), capacity)
