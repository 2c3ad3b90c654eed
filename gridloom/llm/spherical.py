"""Near-duplicate vectors by spherical-cap filters.

Vectors are rotated by a fixed orthogonal matrix and cut into BLOCKS blocks, each with
a code of random unit directions; a filter is one direction from every block, so a
few hundred block scores stand for billions of filter scores. Each vector's cap is as
wide as holds its FILTERS best filters, and it is list-decoded to all of them. Every
filter among the k best has ranks in its blocks whose product is at most k, so only such
combinations are formed, and the work for a vector is the same for any size of code.
The code grows with the table, SPARSE filters for each vector, so unrelated vectors
seldom meet.

Vectors are joined on filters by id; only those that meet another take their components
along. They are verified by cosine in double precision, each pair in its least common
filter only, and a bucket returns sums and spanning stars rather than pairs. Which
pairs share an earlier filter is one product of the members' incidence matrix with
itself. Buckets beyond SIDE members are cut into sides by id and every two sides meet in
a task of their own, so no task holds more than two sides.

Identical vectors collapse first and are counted by weight. Distinct near copies are
not: counting the links of m of them takes m * m / 2 cosines, in blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and those without a label, link with nothing and keep their own id;
rows with one vec_id and one vector count as links of each other; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .components import connected_components
from .tables import ensure_checkpoint_dir

BLOCKS = 4
#: Filters that a vector is decoded to, and filters in all for each vector of the table.
FILTERS, SPARSE = 32, 1024
SIDE = 512
SEED = 20
#: Vectors scored together.
CHUNK = 1024
#: Rows and columns of the combinations of ranks, from 0, that the FILTERS best sums of two falling lists can take.
RANKS = np.array([(i, j) for i in range(FILTERS) for j in range(FILTERS) if (i + 1) * (j + 1) <= FILTERS]).T


class CapCode:
    """A product code of ``size`` directions in each of BLOCKS blocks of a rotated space."""

    def __init__(self, length: int, size: int):
        rng = np.random.default_rng([SEED, length])
        self.rotation = np.linalg.qr(rng.standard_normal((length, length)))[0]
        edges = np.linspace(0, length, BLOCKS + 1).astype(int)
        self.cuts, self.codes, self.size = list(zip(edges[:-1], edges[1:], strict=True)), [], size
        for a, b in self.cuts:
            code = rng.standard_normal((size, b - a))
            norms = np.linalg.norm(code, axis=1, keepdims=True)
            self.codes.append(code / np.where(norms == 0, 1, norms))

    def decode(self, unit: np.ndarray) -> np.ndarray:
        """The numbers of each unit vector's FILTERS best filters, the best first."""
        turned = unit @ self.rotation
        tops = [best(turned[:, a:b] @ code.T) for (a, b), code in zip(self.cuts, self.codes, strict=True)]
        return combined(combined(tops[0], tops[1], self.size), combined(tops[2], tops[3], self.size), self.size**2)[1]


def best(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The FILTERS greatest of each row, falling, and their places."""
    count, row = min(FILTERS, scores.shape[1]), np.arange(len(scores))[:, None]
    place = np.argpartition(-scores, count - 1, axis=1)[:, :count]
    place = place[row, np.argsort(-scores[row, place], axis=1, kind="stable")]
    return scores[row, place], place.astype(np.int64)


def combined(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], base: int) -> tuple[np.ndarray, np.ndarray]:
    """The FILTERS best sums of one from each falling list, falling, and their numbers left * base + right."""
    p, q = RANKS[:, (RANKS[0] < left[0].shape[1]) & (RANKS[1] < right[0].shape[1])]
    sums, row = left[0][:, p] + right[0][:, q], np.arange(len(left[0]))[:, None]
    order = np.argsort(-sums, axis=1, kind="stable")[:, :FILTERS]
    return sums[row, order], left[1][row, p[order]] * base + right[1][row, q[order]]


def code_size(rows: int) -> int:
    """Directions per block."""
    return max(8, math.ceil((SPARSE * max(rows, 1)) ** (1 / BLOCKS)))


_CODES: dict[tuple[int, int], CapCode] = {}


def cap_code(length: int, size: int) -> CapCode:
    if (length, size) not in _CODES:
        _CODES[length, size] = CapCode(length, size)
    return _CODES[length, size]


def normalized(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def decoded(units: DataFrame, size: int) -> DataFrame:
    """(id, label, embedding) to (id, label, length, filters)."""

    def run(batches):
        for batch in batches:
            vectors = batch.column("embedding")
            values, bounds = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *vectors.value_lengths().to_pylist()])
            lengths = np.diff(bounds)
            filters, count = np.zeros((len(lengths), FILTERS), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths).tolist():
                members, code = np.flatnonzero(lengths == length), cap_code(length, size)
                for at in range(0, len(members), CHUNK):
                    part = members[at : at + CHUNK]
                    found = code.decode(normalized(values[bounds[part][:, None] + np.arange(length)]))
                    filters[part, : found.shape[1]], count[part] = found, found.shape[1]
            flat = filters[np.arange(FILTERS) < count[:, None]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(lengths), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *count]).astype(np.int32)), pa.array(flat))], names=["id", "label", "length", "filters"])

    ship(units.sparkSession)
    return units.select("id", "label", "embedding").mapInArrow(run, "id long, label long, length long, filters array<long>")


def verified(threshold: float):
    """One bucket, or two sides of one, to (id, links, root): weights of verified partners and the least id reached."""

    def run(key, bucket):
        this, i, j = key[0].as_py(), key[1].as_py(), key[2].as_py()
        bucket = bucket.sort_by("id").combine_chunks()
        column = lambda name: bucket.column(name).combine_chunks()
        ids, weight, side = (column(c).to_numpy(zero_copy_only=False) for c in ("id", "weight", "side"))
        unit = normalized(column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
        near = np.triu(unit @ unit.T >= threshold, 1)
        if i != j:
            near &= side[:, None] != side[None, :]
        a, b = np.nonzero(near)
        met = np.unique(np.concatenate([a, b]))
        if len(met):  # pairs that share an earlier bucket have been counted there
            shared = column("shared")
            of, keys = np.repeat(np.arange(len(ids)), shared.value_lengths().to_numpy(zero_copy_only=False)), shared.flatten().to_numpy(zero_copy_only=False)
            on = (keys < this) & np.isin(of, met)
            if on.any():
                names, column_of = np.unique(keys[on], return_inverse=True)
                incidence = np.zeros((len(met), len(names)), np.float32)
                incidence[np.searchsorted(met, of[on]), column_of] = 1
                again = (incidence @ incidence.T)[np.searchsorted(met, a), np.searchsorted(met, b)] > 0
                a, b = a[~again], b[~again]
        links = np.bincount(a, weight[b], len(ids)).astype(np.int64) + np.bincount(b, weight[a], len(ids)).astype(np.int64)
        root = np.arange(len(ids))
        while True:
            least = root.copy()
            np.minimum.at(least, a, root[b])
            np.minimum.at(least, b, root[a])
            least = least[least]
            if (least == root).all():
                break
            root = least
        on = links > 0
        return pa.table({"id": ids[on], "links": links[on], "root": ids[root[on]]})

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, embedding, label) to (vec_id, n_links, component_id, kept)."""
    ensure_checkpoint_dir(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("same", F.when(fit, F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.col("embedding").cast("string")), 256)))
    units = rows.where("same is not null").groupBy("same").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"))
    # Different vectors may have one vec_id: a unit goes by its own hash.
    units = units.select("same", F.col("id").alias("least"), F.xxhash64("same").alias("id"), "weight", "label", "embedding").checkpoint()
    filters = decoded(units, code_size(units.count()))
    cells = filters.select("id", F.explode(F.transform("filters", lambda f: F.xxhash64("label", "length", f))).alias("key")).checkpoint()
    counts = cells.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / SIDE).cast("int").alias("sides"))
    alive = cells.join(counts, "key").groupBy("id").agg(F.collect_list(F.struct("key", "sides")).alias("xs"))  # FILTERS at most
    members = units.join(alive, "id").select("id", "weight", "label", "embedding", F.size("embedding").alias("length"), F.transform("xs", lambda x: x["key"]).alias("shared"), F.explode("xs").alias("x"))
    sided = members.select("*", "x.key", F.pmod("id", "x.sides").cast("int").alias("side"))
    meeting = F.transform(F.sequence(F.lit(0), F.col("x.sides") - 1), lambda k: F.struct(F.least("side", k).alias("i"), F.greatest("side", k).alias("j")))
    met = sided.withColumn("meet", F.explode(meeting)).select("id", "weight", "embedding", "shared", "side", "key", "label", "length", "meet.i", "meet.j")
    found = met.groupBy("key", "i", "j", "label", "length").applyInArrow(verified(threshold), "id long, links long, root long").checkpoint()
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    # Components go by the least vec_id of each unit, since that names them.
    names = units.select("id", "least")
    edges = found.select("id", "root").distinct().join(names.withColumnRenamed("least", "a"), "id").join(names.toDF("root", "b"), "root")
    roots = connected_components(edges.select("a", "b")).toDF("least", "root")
    of_unit = units.select("same", "id", "least", "weight").join(links, "id", "left").join(roots, "least", "left")
    of_unit = of_unit.select("same", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "least").alias("component_id"))
    out = rows.select("vec_id", "same").join(of_unit, "same", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
