"""Near-duplicates by SimHash, linked within a Hamming radius by meet-in-the-middle balls.

Two fingerprints within radius 4 both lie within 2 of some common point, so
variants within half the radius meet. All 2081 variants of 64 bits weigh about 33
kB a fingerprint, so the main pass takes balls on projections: the bits form three
blocks, and of 4 differing bits at most 2 fall in the best two blocks, so in one
of three projections on about 43 bits the variants within 1 meet (131 variants a
fingerprint). Distinct fingerprints are shuffled on variants, each pair that meets
is verified on all 64 bits, and a bucket emits a spanning forest of its links.
Buckets beyond ``most`` members, which pairwise checks would make quadratic, are
handed to the full balls: whatever shares a full variant lies within the radius,
so a star per variant holds all their links without checking a pair. (At an odd radius
one of the two balls is a bit wider, and a star's centre comes from the narrower ones.)

Copies collapse before any of this: one row per distinct fingerprint is hashed.

Defined results: null and empty texts have fingerprint 0, linked like any other;
repeated rows are returned as often as they come; a null doc_id keeps its row and
is never a component_id unless nothing else is reachable; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from . import resemblance
from .components import connected_components
from .tables import ensure_checkpoint_dir, partitions_for

SHINGLE_WORDS = 4
SEED = 42
#: Bits of the three blocks.
BLOCKS = ((0, 21), (21, 42), (42, 64))
MOST = 1024
#: Shingles whose bits are counted together.
CHUNK = 1 << 14


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    split = (text or "").encode("utf-8", "replace").lower().split()
    if not split:
        return 0
    joined = b" ".join(split)
    at = np.zeros(len(split) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in split], out=at[1:])
    n = max(1, len(split) - words + 1)
    starts, ends = at[:n].tolist(), (at[min(words, len(split)) :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[k : k + CHUNK], ends[k : k + CHUNK], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text) to (doc_id, fp), fp the fingerprint's bits as a signed long."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def projected_variants(fp: Column) -> Column:
    """Keys of the three projections: each without its block, as it is and with each bit flipped; the block holds the projection's mark."""
    keys = []
    for low, high in BLOCKS:
        block = ((1 << high) - 1) ^ ((1 << low) - 1)
        kept = ((1 << 64) - 1) ^ block
        base = fp.bitwiseAND(F.lit(signed(kept))).bitwiseOR(F.lit(signed(1 << low)))
        keys += [base, *(base.bitwiseXOR(F.lit(signed(1 << b))) for b in range(64) if kept >> b & 1)]
    return F.array(*keys)


def full_variants(radius: int):
    """Every variant of each fp within half the radius: (key, outer, fp). At an odd radius, those one bit farther too, marked as outer."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    a, b = np.triu_indices(64, 1)
    shells = [np.zeros(1, np.uint64), one, one[a] | one[b]]
    inner, outer = np.concatenate(shells[: radius // 2 + 1]), shells[radius // 2 + 1] if radius % 2 else shells[0][:0]
    ball, is_outer = np.concatenate([inner, outer]), np.repeat([False, True], [len(inner), len(outer)])

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 64):
                part = fps[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ ball).ravel().view(np.int64)), pa.array(np.tile(is_outer, len(part))), pa.array(np.repeat(part, len(ball)).view(np.int64))], names=["key", "outer", "fp"])

    return run


def runs(batches, most: int):
    """Rows sorted by key, as (keys, fps, run starts); a run beyond ``most`` comes in parts of at least that size, marked as such."""
    held_key, held_fp, long_key = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in batches:
        key = np.concatenate([held_key, batch.column("key").to_numpy(zero_copy_only=False)])
        fp = np.concatenate([held_fp, batch.column("fp").to_numpy(zero_copy_only=False)])
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))
        if last == 0 and len(key) <= most:
            held_key, held_fp = key, fp
            continue
        if len(key) - last > most:  # the last run is long already: let it go in parts
            yield key, fp, long_key
            held_key, held_fp, long_key = key[:0], fp[:0], key[-1]
        else:
            yield key[:last], fp[:last], long_key
            held_key, held_fp, long_key = key[last:], fp[last:], long_key if long_key is not None and last == 0 else None
    if len(held_key):
        yield held_key, held_fp, long_key


def local_forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a bucket's least spanning stars: (member, least member reached)."""
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
    label = np.arange(len(fp))
    while True:
        least = np.where(near, label[None, :], len(fp)).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    on = np.flatnonzero(label != np.arange(len(fp)))
    return fp[on], fp[label[on]]


def links_of_buckets(radius: int, most: int):
    """Sorted (key, fp) to edges (a, b, hot): verified links, or members of buckets beyond ``most`` with hot set."""

    def run(batches):
        for key, fp, long_key in runs(batches, most):
            bits = fp.view(np.uint64)
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            a, b, hot = [], [], []
            run_of = np.repeat(np.arange(len(start)), size)
            small = (size > 1) & (size <= 8)
            if long_key is not None and key[0] == long_key:
                small[0] = False
            for lag in range(1, 8):
                left = np.flatnonzero((run_of[:-lag] == run_of[lag:]) & small[run_of[:-lag]]) if len(key) > lag else np.zeros(0, np.int64)
                left = left[np.bitwise_count(bits[left] ^ bits[left + lag]) <= radius]
                a.append(bits[left + lag])
                b.append(bits[left])
            for k in np.flatnonzero((size > 8) | ((np.arange(len(size)) == 0) & (long_key is not None and key[0] == long_key))):
                part = bits[start[k] : start[k] + size[k]]
                if size[k] > most or (k == 0 and long_key is not None and key[0] == long_key):
                    hot.append(part)
                else:
                    x, y = local_forest(part, radius)
                    a.append(x)
                    b.append(y)
            x = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
            h = np.unique(np.concatenate(hot)) if hot else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[:, 0], h]).view(np.int64)), pa.array(np.concatenate([x[:, 1], h]).view(np.int64)), pa.array(np.concatenate([np.zeros(len(x), bool), np.ones(len(h), bool)]))], names=["a", "b", "hot"])

    return run


def stars(batches):
    """Full variants sorted by key, inner ones first, to edges from each member to its key's first, which is an inner one where there is any; keys of outer ones alone have none."""
    held_key, held_fp, held_outer = None, None, True
    for batch in batches:
        key, fp, outer = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "outer"))
        if not len(key):
            continue
        new = np.concatenate([[held_key is None or key[0] != held_key], key[1:] != key[:-1]])
        place = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        first, far = fp[place], outer[place]
        if not new[0]:
            first, far = np.where(place == 0, held_fp, first), np.where(place == 0, held_outer, far)
        on = np.flatnonzero((first != fp) & ~far)
        x = np.unique(np.stack([fp[on], first[on]], axis=1), axis=0)
        held_key, held_fp, held_outer = key[-1], first[-1], far[-1]
        yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])


def fingerprint_links(distinct: DataFrame, radius: int = 4, most: int = MOST) -> DataFrame:
    """Edges (a, b) between distinct fps whose components are those of all links within the radius (4 at most)."""
    if not 0 <= radius <= 4:
        raise ValueError("the balls are laid out for a radius of 4 or less")
    n = partitions_for(distinct.sparkSession)
    distinct = distinct.select("fp").repartition(n, "fp")  # few rows become many
    met = distinct.select(F.explode(projected_variants(F.col("fp"))).alias("key"), "fp").repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(links_of_buckets(radius, most), "a long, b long, hot boolean").distinct().checkpoint()
    links = met.where("not hot").select("a", "b")
    hot = met.where("hot").select(F.col("a").alias("fp")).distinct()
    if hot.isEmpty() or not radius:
        return links
    balls = hot.repartition(n, "fp").mapInArrow(full_variants(radius), "key long, outer boolean, fp long").repartition(n, "key").sortWithinPartitions("key", "outer", "fp")
    return links.union(balls.mapInArrow(stars, "a long, b long").distinct())


def near_duplicate_components(docs: DataFrame, radius: int = 4, words: int = SHINGLE_WORDS, most: int = MOST) -> DataFrame:
    """(doc_id, text) to (doc_id, fingerprint, component_id)."""
    ensure_checkpoint_dir(docs.sparkSession)
    each = fingerprints(docs, words).checkpoint()
    distinct = each.groupBy("fp").agg(F.min("doc_id").alias("least")).checkpoint()
    roots = connected_components(fingerprint_links(distinct.select("fp"), radius, most))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id").checkpoint()
    return each.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, similarity: float = resemblance.SIMILARITY, words: int = resemblance.SHINGLE_WORDS, radius: int = 4) -> DataFrame:
    """The documents, with all their columns, that have the least id of their group; of rows with one id, one.

    Fingerprints of all documents are linked within the radius by the balls above, and each such link
    is verified on whole shingle sets. What is as similar but farther apart in bits, as most pairs at
    that similarity are, is then found in the blocks of resemblance and verified alike.
    A row with a null id is never dropped: no id names it.
    """
    kept = resemblance.similar_components(docs, similarity, words, lambda fps: fingerprint_links(fps, radius)).groupBy("root").agg(F.min("doc_id").alias("key")).select("key").where("key is not null").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("key"))
    named = rows.where("key is not null").join(kept, "key", "left_semi").groupBy("key").agg(F.first("doc").alias("doc"))
    return named.select("doc.*").union(rows.where("key is null").select("doc.*"))
