"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Text statistics, the minimum-covariance-determinant fit and the distances are all
DataFrame expressions. Each group's fit has three deterministic starts: medians and
quartile ranges, means and covariances of values clipped about them, and of all values.
From each it takes PROBES concentration steps: distances under the current centre and
covariance, the nearest 75 % of the group's documents, their centre and covariance again.
The start whose covariance then has the least determinant goes on for STEPS more, which
never raise it. Ranks
come from histograms of quantized values and sums from integers, so a group is
always pre-aggregated before it is shuffled, however many rows it holds, and the
result does not depend on how rows are dealt. Groups under MIN_GROUP documents are
pooled by language, then all together; a pool still too small rejects nothing.

Defined results: null and empty texts have no words and fail the base rules; null
languages and sources form groups of their own; repeated rows each count and give
a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import ensure_checkpoint_dir

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW_WORDS = 8
MIN_GROUP = 50
#: Share of a group that the estimates rest on.
SUBSET = 0.75
PROBES, STEPS = 2, 3
#: Deviations from the median beyond which values are clipped in the second start.
CLIP = 2.5
#: Squared distance beyond which a document goes: the 0.9999999 quantile of chi-square with 5 degrees.
CUTOFF = 40.86
#: What a fit on the nearest 75 % of a normal cloud in 5 dimensions is scaled up by.
CONSISTENCY = 1.46
#: Features, and the standard deviation below which differences in each mean nothing.
FEATURES = {"f_words": 0.25, "f_chars": 0.08, "f_symbols": 0.04, "f_lines": 0.08, "f_repeat": 0.06}
NAMES = list(FEATURES)
UNIT = 4096.0
#: Groups up to this many are broadcast (about 300 bytes each).
BROADCAST_GROUPS = 20_000
SEPARATORS = r"[\\x20\\x09-\\x0D]+"


def let(value: str, name: str, body: str) -> str:
    """body with value evaluated once and bound to name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeated_words(words: str) -> str:
    """Words inside windows of eight that occur twice or more in the array ``words``."""
    doubled = "zip_with({a}, slice({a}, {k} + 1, greatest(size({a}) - {k}, 0)), (x, y) -> xxhash64(x, y))"
    windows = let(f"transform({words}, w -> xxhash64(w))", "h1", let(doubled.format(a="h1", k=1), "h2", let(doubled.format(a="h2", k=2), "h4", f"slice({doubled.format(a='h4', k=4)}, 1, size(h1) - {WINDOW_WORDS - 1})")))
    alike = "(k > 0 and s[k - 1].h = x.h) or (k < size(s) - 1 and s[k + 1].h = x.h)"
    places = let("sort_array(transform(w8, (h, i) -> struct(h as h, i as i)))", "s", f"sort_array(transform(filter(s, (x, k) -> {alike}), x -> x.i))")
    covered = let(places, "p", f"aggregate(zip_with(p, slice(p, 2, size(p) - 1), (a, b) -> least({WINDOW_WORDS}, coalesce(b - a, {WINDOW_WORDS}))), 0, (n, x) -> n + x)")
    return f"if(size({words}) < {WINDOW_WORDS}, 0, {let(windows, 'w8', f'if(size(array_distinct(w8)) = size(w8), 0, {covered})')})"


def statistics(text: str = "text") -> Column:
    """A struct of the counts of the text in the named column."""
    words = let(
        f"array_remove(split(t, '{SEPARATORS}'), '')",
        "ws",
        f"struct(cast(size(ws) as bigint) as n_words, cast(length(concat_ws('', ws)) as bigint) as word_chars, cast({repeated_words('ws')} as bigint) as n_repeat_words)",
    )
    lines = let("filter(split(t, '\\\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')", "ls", "struct(cast(size(ls) as bigint) as n_lines, cast(size(ls) - size(array_distinct(ls)) as bigint) as n_dup_lines)")
    joined = "struct(a.n_words, a.word_chars, cast(regexp_count(t, '[#*$%&|<>]') as bigint) as n_symbols, b.n_dup_lines, a.n_repeat_words, b.n_lines)"
    return F.expr(let(f"coalesce(`{text}`, '')", "t", let(words, "a", let(lines, "b", joined))))


def with_features(docs: DataFrame) -> DataFrame:
    """Adds the struct ``qr`` (counts, base_failed) and the features, zero where the base rules failed."""
    out = docs.withColumn("qr", statistics())
    n = F.greatest(F.col("qr.n_words"), F.lit(1)).cast("double")
    failed = (F.col("qr.n_words") < MIN_WORDS) | (100 * F.col("qr.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("qr.n_words"))
    values = {
        "f_words": F.log(n),
        "f_chars": F.log(F.greatest(F.col("qr.word_chars"), F.lit(1)) / n),
        "f_symbols": F.col("qr.n_symbols") / n,
        "f_lines": F.col("qr.n_dup_lines") / F.greatest(F.col("qr.n_lines"), F.lit(1)),
        "f_repeat": F.col("qr.n_repeat_words") / n,
    }
    fields = [F.col(f"qr.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    scaled = [F.round(v * UNIT).cast("long").alias(k) for k, v in values.items()]
    return out.withColumn("qr", F.struct(*fields, failed.alias("base_failed"), *scaled))


def small(df: DataFrame) -> DataFrame:
    """The checkpointed df, marked for broadcast while it has few rows; beyond that Spark joins it by key."""
    return F.broadcast(df) if df.count() <= BROADCAST_GROUPS else df


def with_pool(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds the group that a row's estimates come from: (rows with pool, (lang, source) to pool)."""
    sizes = rows.where("not qr.base_failed").groupBy("lang", "source").count()
    by_lang = Window.partitionBy("lang", F.col("count") >= MIN_GROUP)
    pooled = sizes.withColumn("in_lang", F.sum("count").over(by_lang))
    pool = (
        F.when(F.col("count") >= MIN_GROUP, F.struct(F.lit(2).alias("level"), "lang", "source"))
        .when(F.col("in_lang") >= MIN_GROUP, F.struct(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source")))
        .otherwise(F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")))
    )
    pools = pooled.select("lang", "source", F.to_json(pool).alias("pool")).checkpoint()
    return attach_pool(rows, pools), pools


def attach_pool(rows: DataFrame, pools: DataFrame) -> DataFrame:
    side = small(pools.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "pool"))
    return rows.join(side, rows["lang"].eqNullSafe(side["_l"]) & rows["source"].eqNullSafe(side["_s"]), "left").drop("_l", "_s")


def distance(rows: DataFrame, prefix: str = "") -> Column:
    """Squared Mahalanobis distance of a row's features under the Cholesky factor in its columns m_i, l_i_j."""
    solved: list[Column] = []
    for i, name in enumerate(NAMES):
        y = F.col(f"{prefix}{name}") / UNIT - F.col(f"m_{i}")
        for j in range(i):
            y = y - F.col(f"l_{i}_{j}") * solved[j]
        solved.append(y / F.col(f"l_{i}_{i}"))
    return sum((y * y for y in solved[1:]), solved[0] * solved[0])


def factored(estimates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, m_i, c_i_j) to (keys, m_i, l_i_j), each variance raised by its feature's floor."""
    out = estimates
    for i, floor in enumerate(FEATURES.values()):
        for j in range(i + 1):
            left = F.col(f"c_{i}_{j}") + (floor * floor if i == j else 0.0)
            for k in range(j):
                left = left - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(left) if i == j else left / F.col(f"l_{j}_{j}"))
    return out.select(*keys, *[f"m_{i}" for i in range(5)], *[f"l_{i}_{j}" for i in range(5) for j in range(i + 1)])


def exact(c: Column) -> Column:
    """A sum of whole numbers that no order of rows changes."""
    return F.sum(c.cast("decimal(20,0)")).cast("double")


def moments(rows: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """(keys, m_i, l_i_j) from the features of the rows of each key, covariances scaled."""
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[exact(F.col(x)).alias(f"s_{i}") for i, x in enumerate(NAMES)],
        *[exact(F.col(x) * F.col(NAMES[j])).alias(f"s_{i}_{j}") for i, x in enumerate(NAMES) for j in range(i + 1)],
    )
    means = {f"m_{i}": F.col(f"s_{i}") / F.col("n") / UNIT for i in range(5)}
    covariances = {f"c_{i}_{j}": (F.col(f"s_{i}_{j}") / F.col("n") - F.col(f"s_{i}") / F.col("n") * (F.col(f"s_{j}") / F.col("n"))) / UNIT / UNIT * scale for i in range(5) for j in range(i + 1)}
    return factored(sums.withColumns(means | covariances), keys)


def starts(rows: DataFrame) -> DataFrame:
    """(pool, start, m_i, l_i_j): the three starts of each pool."""
    cells = rows.select("pool", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.expr(f"{name} div 32").alias("bin")) for i, name in enumerate(NAMES)])).alias("x")).groupBy("pool", "x.i", "x.bin").count()
    order = Window.partitionBy("pool", "i").orderBy("bin")
    share = cells.withColumn("upto", F.sum("count").over(order) / F.sum("count").over(Window.partitionBy("pool", "i")))
    at = lambda q: F.min(F.when(F.col("upto") >= q, F.col("bin"))) * 32.0 / UNIT
    found = share.groupBy("pool", "i").agg(at(0.5).alias("mid"), ((at(0.75) - at(0.25)) / 1.349).alias("sd"))
    flat = found.groupBy("pool").agg(*[F.max(F.when(F.col("i") == i, F.col("mid"))).alias(f"m_{i}") for i in range(5)], *[F.max(F.when(F.col("i") == i, F.col("sd"))).alias(f"sd_{i}") for i in range(5)]).checkpoint()
    diagonal = factored(flat.withColumns({f"c_{i}_{j}": F.col(f"sd_{i}") * F.col(f"sd_{i}") if i == j else F.lit(0.0) for i in range(5) for j in range(i + 1)}), ["pool"])
    ranged = rows.join(small(flat), "pool")
    reach = [CLIP * F.greatest(F.col(f"sd_{i}"), F.lit(floor)) * UNIT for i, floor in enumerate(FEATURES.values())]
    clipped = ranged.select("pool", *[F.round(F.least(F.greatest(F.col(x).cast("double"), F.col(f"m_{i}") * UNIT - reach[i]), F.col(f"m_{i}") * UNIT + reach[i])).cast("long").alias(x) for i, x in enumerate(NAMES)])
    every = [diagonal, moments(clipped, ["pool"], 1.0), moments(rows, ["pool"], 1.0)]
    return reduce(DataFrame.unionByName, [x.withColumn("start", F.lit(k)) for k, x in enumerate(every)])


def concentrated(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step for each (pool, start) of the checkpointed estimates."""
    near = rows.join(small(estimates), "pool").withColumn("bin", F.floor(F.log(distance(rows) + 1e-6) * 64))
    order = Window.partitionBy("pool", "start").orderBy("bin")
    cut = near.groupBy("pool", "start", "bin").count().withColumn("upto", F.sum("count").over(order)).withColumn("all", F.sum("count").over(Window.partitionBy("pool", "start")))
    cut = cut.where(F.col("upto") >= SUBSET * F.col("all")).groupBy("pool", "start").agg(F.min("bin").alias("last")).checkpoint()
    kept = near.join(small(cut), ["pool", "start"]).where("bin <= last")
    return moments(kept, ["pool", "start"], CONSISTENCY).checkpoint()


def fit(rows: DataFrame) -> DataFrame:
    """Centre and Cholesky factor of each pool of at least MIN_GROUP rows (pool, features), from the start of least determinant."""
    enough = small(rows.groupBy("pool").count().where(F.col("count") >= MIN_GROUP).select("pool").checkpoint())
    rows = rows.join(enough, "pool").checkpoint()
    estimates = starts(rows).checkpoint()
    for _ in range(PROBES):
        estimates = concentrated(rows, estimates)
    least = estimates.groupBy("pool").agg(F.min(F.struct(log_determinant().alias("det"), "start"))["start"].alias("start"))
    estimates = estimates.join(least, ["pool", "start"]).checkpoint()
    for _ in range(STEPS):
        estimates = concentrated(rows, estimates)
    return estimates.drop("start")


def log_determinant() -> Column:
    """Half the logarithm of the covariance's determinant, from the factor's diagonal."""
    return reduce(lambda a, b: a + b, [F.log(f"l_{i}_{i}") for i in range(5)])


def judged(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Adds distance (null without an estimate) and kept to rows with qr and pool."""
    flat = rows.join(small(estimates), "pool", "left").withColumn("distance", distance(rows, "qr."))
    return flat.withColumn("kept", ~F.col("qr.base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF))


def learn(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(checkpointed rows with qr and pool, pools, estimates) of documents (doc_id, text, lang, source)."""
    ensure_checkpoint_dir(docs.sparkSession)
    key = F.xxhash64(F.col("doc_id").cast("long"), "text", "lang", "source")
    rows = with_features(docs.select(F.col("doc_id").cast("long"), "text", "lang", "source", key.alias("key"))).drop("text").checkpoint()
    pooled, pools = with_pool(rows)
    return pooled, pools, fit(pooled.where("not qr.base_failed").select("pool", *[F.col(f"qr.{x}").alias(x) for x in NAMES]))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: counts, base_failed, distance and kept."""
    rows, _, estimates = learn(docs)
    out = judged(rows, estimates)
    return out.select("doc_id", *[F.col(f"qr.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], "kept", "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, that the rules keep. Counts are taken once: a document finds its verdict by a hash of what it rests on."""
    key = F.xxhash64(F.col("doc_id").cast("long"), "text", "lang", "source")
    rows, _, estimates = learn(docs)
    kept = judged(rows, estimates).where("kept").select(F.col("key").alias("_key"), F.col("doc_id").alias("_id")).distinct()
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key.alias("_key"), F.col("doc_id").cast("long").alias("doc_id"))
    return held.join(kept, (held["_key"] == kept["_key"]) & held["doc_id"].eqNullSafe(kept["_id"]), "left_semi").select("doc.*")
