"""Near-duplicates by the Jaccard similarity of word shingles, met by SimHash and in min-hash blocks.

A pair at similarity 0.8 differs in about 10 of 64 SimHash bits, out of reach of balls
of any affordable size. So each distinct set of shingles takes BANDS blocks of ROWS
min-hashes; a pair at similarity s misses all of them with probability
(1 - s**ROWS)**BANDS, 5e-7 at 0.8 and less above. Whatever meets in a block is
verified on the whole sets, so every link is exact.

SimHash comes first: units whose fingerprints link within a radius are verified as well. Then
each member of a block meets the block's least one, which joins a crowd of near
copies in as many pairs as it has members; last, members of a block that are still in
different components meet where they share one of their rarest shingles, early enough for
what is left of both sets to reach the similarity (prefixes of sets, an exact condition).
Pairs within one component need no check, as only components are asked for.

Defined results: texts of the same shingles are one unit; a text shorter than a shingle is
one shingle; null and empty texts have no shingles and are alike; ASCII case and white
space do not count.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .tables import ensure_checkpoint_dir, settled, tidy

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 48, 6
SEED = 42
#: Shingles min-hashed together, and those whose bits are counted together.
CHUNK, BITS_CHUNK = 1 << 11, 1 << 14

_RNG = np.random.default_rng(SEED)
FACTOR = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
SHIFT = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) | np.uint64(1)


def hashes(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit hashes of a text's word shingles in their order, repeats included."""
    from xxhash import xxh64_intdigest

    split = (text or "").encode("utf-8", "replace").lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    joined = b" ".join(split)
    at = np.zeros(len(split) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in split], out=at[1:])
    n = max(1, len(split) - words + 1)
    starts, ends = at[:n].tolist(), (at[min(words, len(split)) :] - 1).tolist()
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    return np.unique(hashes(text, words))


def majority(h: np.ndarray) -> int:
    """SimHash of shingle hashes: each bit that over half of them have set."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), BITS_CHUNK):
        counts += np.unpackbits(h[k : k + BITS_CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def block_keys(held: np.ndarray) -> np.ndarray:
    """The set's BANDS block keys; none for an empty set."""
    if not len(held):
        return np.zeros(0, np.int64)
    high = (held >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(high), CHUNK):
        np.minimum(least, (high[k : k + CHUNK] * FACTOR + SHIFT).min(axis=1), out=least)
    return (least.reshape(BANDS, ROWS).astype(np.uint64) * MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text) to (doc_id, th, u, n, fp, keys): the text's hash, its set's hash and size, its SimHash and its blocks."""

    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            every = [hashes(t, words) for t in batch.column("text").to_pylist()]
            fp = np.array([majority(h) for h in every], np.uint64).view(np.int64)
            sets = [np.unique(h) for h in every]
            u = np.array([xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            n = np.array([len(x) for x in sets], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(u), pa.array(n), pa.array(fp), pa.array([block_keys(x) for x in sets], pa.list_(pa.int64()))], names=["doc_id", "th", "u", "n", "fp", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), "text").mapInArrow(run, "doc_id long, th long, u long, n int, fp long, keys array<long>")


def text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sets_of(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """(u, shingles) of the texts whose hashes th are in needed (th, u)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("u"), pa.array([shingles(t, words).view(np.int64) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))], names=["u", "shingles"])

    # Empty texts, which many rows may share, have no shingles.
    texts = docs.where("trim(text) <> ''").select(text_hash().alias("th"), "text").join(needed, "th").groupBy("th").agg(F.any_value("u").alias("u"), F.any_value("text").alias("text"))
    return texts.select("u", "text").mapInArrow(run, "u long, shingles array<long>")


def simhash_pairs(units: DataFrame, near: Callable[[DataFrame], DataFrame], count: int) -> DataFrame:
    """Pairs (a, b) of units that SimHash links, a < b: of each fingerprint's units the least with the others, and the least ones of linked fingerprints."""
    least = units.groupBy("fp").agg(F.min("u").alias("least")).checkpoint()
    same = units.select("u", "fp").join(least, "fp").where("u <> least").select(F.col("least").alias("a"), F.col("u").alias("b"))
    links = near(least.select("fp"))
    linked = links.join(least.toDF("a", "la"), "a").join(least.toDF("b", "lb"), "b").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
    pairs = settled(same.union(linked).distinct(), count)
    tidy(units.sparkSession)
    return pairs


def rare_pairs(units: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of units (u, n, root, shingles) with different roots: all at that similarity or above, and few others.

    With the shingles of each set in one order, the rarest first, the first one that two similar
    sets share stands early enough in both that what follows can still make up their overlap.
    """
    each = units.select("u", F.explode("shingles").alias("s"))
    shared = each.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    ordered = each.join(shared, "s").groupBy("u").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("ts"))
    # A set's shingles that no other set has come before all these. At least so many of n must be shared.
    least = F.ceil(F.lit(similarity) * F.col("n") - 1e-6)
    placed = ordered.join(units.select("u", "n", "root"), "u").select("u", "n", "root", F.expr("n - size(ts)").alias("own"), F.slice("ts", 1, F.greatest(F.lit(0), F.expr("size(ts)") - least + 1).cast("int")).alias("ts"))
    early = placed.select("u", "n", "root", "own", F.posexplode("ts").alias("p", "t")).select(F.col("t.s").alias("s"), "u", "n", "root", (F.col("n") - F.col("own") - F.col("p")).alias("left")).checkpoint()
    both = early.toDF("s", "a", "na", "ra", "la").join(early.toDF("s", "b", "nb", "rb", "lb"), "s")
    enough = F.least("la", "lb") >= F.lit(similarity / (1 + similarity)) * (F.col("na") + F.col("nb")) - 1e-6
    return both.where("a < b and ra <> rb").where(enough).select("a", "b").distinct()


def similar_components(docs: DataFrame, similarity: float = SIMILARITY, words: int = SHINGLE_WORDS, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, text) to (doc_id, th, root): rows with one root are linked by pairs at that similarity or above.

    ``near`` gives the links (a, b) of a table of distinct SimHashes (fp).
    """
    ensure_checkpoint_dir(docs.sparkSession)
    each = sketches(docs, words).checkpoint()
    units = each.where("n > 0").groupBy("u").agg(F.min("n").alias("n"), F.min("th").alias("th"), F.min("fp").alias("fp"), F.any_value("keys").alias("keys")).checkpoint()
    count = units.count()
    tidy(docs.sparkSession)
    by_bits = simhash_pairs(units, near, count) if near else None
    cells = units.select("u", "n", F.explode("keys").alias("key"))
    heads = cells.groupBy("key").agg(F.min(F.struct("u", "n")).alias("head"), F.count("*").alias("members")).where("members > 1").select("key", "head")
    met = cells.join(heads, "key").select("key", "u", "n", "head").checkpoint()
    wanted = met.select("u").union(by_bits.select("a")).union(by_bits.select("b")) if near else met.select("u")
    sets = sets_of(docs, units.join(wanted.distinct(), "u", "left_semi").select("th", "u"), words).checkpoint()
    alike = F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb") - 1e-6

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return settled(both.where(common / (F.size("sa") + F.size("sb") - common) >= similarity).select("a", "b"), count)

    links = linked(by_bits) if near else None
    stars = met.where("u <> head.u").select(F.col("head.u").alias("a"), F.col("u").alias("b"), F.col("head.n").alias("na"), F.col("n").alias("nb")).where(alike).select("a", "b").distinct().checkpoint()
    tidy(docs.sparkSession)
    stars = stars.join(by_bits, ["a", "b"], "left_anti") if near else stars
    links = links.union(linked(stars)) if near else linked(stars)
    roots = connected_components(links).withColumnRenamed("node", "u")
    placed = met.select("key", "u", "n").join(roots, "u", "left").select("key", "u", "n", F.coalesce("root", "u").alias("root"))
    split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    apart = placed.join(split, "key").select("u", "n", "root").distinct().join(sets, "u").checkpoint()
    tidy(docs.sparkSession)
    crossed = settled(rare_pairs(apart, similarity), count)
    more = linked(crossed.join(stars, ["a", "b"], "left_anti"))
    roots = connected_components(links.union(more)).withColumnRenamed("node", "u")
    return each.join(roots, "u", "left").select("doc_id", "th", F.coalesce("root", "u").alias("root"))
