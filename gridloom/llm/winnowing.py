"""Line dedup by winnowing: repeated runs of lines are found by fingerprints and deleted where they come later.

A line is hashed in pieces, cut after a full stop, exclamation or question mark that
white space follows, so that a passage set into a longer line is found as well; a short
line is one piece. A gram is a piece of GRAM_WORDS words or more, or else the least of 2, 3, 4 or
8 pieces in a row that hold as many (8 also where they hold fewer). Of the grams that begin within each gram, the one with the least hash
is a fingerprint, the leftmost at a tie, so two texts that share a run of some
gram's length twice over share a fingerprint at the same place in it.
Fingerprints are joined by hash to their first occurrence in the corpus, by doc_id
and place; from there the match is extended piece by piece both ways, as far as the
next fingerprint must come, and the later occurrence is deleted. The first place of a
gram may hold less of a run than a later one, so around later fingerprints the shortest
runs of RUN_WORDS words from each piece on, and to each piece, that the extension did not
cover are joined to their own first occurrence as well. Of what is
covered, stretches of LEAST_WORDS words or more are deleted. A document whose text an
earlier one has goes as a whole.

A fingerprint that very many documents share is pre-aggregated to its first occurrence,
and the join back carries one small row for each place: no pairs of documents arise, and
a place's neighbourhood is a few hashes.

Pieces are compared by their words; pieces without words neither count nor break a
run. A line goes when all its pieces with words do. Everything is DataFrame expressions.

Defined results: null and empty texts stay as they are; documents under LEAST_WORDS
words stay; rows that repeat an id and a text are one document and
come out alike; null ids come last; a document that repeats wholly is left with an
empty text; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import let
from .tables import ensure_checkpoint_dir, tidy

GRAM_WORDS = 16
RUN_WORDS = 36
LEAST_WORDS = 25
#: Pieces that a match is extended by beyond its fingerprint on each side.
REACH = 8
LAST_ID = 2**63 - 1
MARKS = ".!?"
CUT = rf"(?<=[{MARKS}])(?=[\\x20\\x09\\x0B-\\x0D])"
#: A piece is named by its line and its place therein in one number.
PER_LINE = 2**32


def pieces(text: str, of: str) -> str:
    """SQL: an array of ``of`` for all pieces x of a text, the k-th ones of its lines l."""
    return f"flatten(transform(split({text}, '\\\\n'), (line, l) -> transform(split(line, '{CUT}'), (x, k) -> {of})))"


def outlined() -> str:
    """SQL for text t: hashes hs and lengths ns of its pieces with words, and its fingerprints (place * 16 + pieces) over them."""
    odd = " or ".join(["contains(t, '  ')", *(f"contains(t, chr({c}))" for c in (9, 11, 12, 13))])
    cut = f"if({odd}, regexp_replace(t, '[\\\\x20\\\\x09\\\\x0B-\\\\x0D]+', ' '), t)"
    for mark in MARKS:
        cut = f"replace({cut}, '{mark} ', '{mark}\\n')"
    listed = f"filter(transform(split({cut}, '\\n'), x -> trim(x)), x -> x <> '')"
    counts = "transform(xs, x -> octet_length(x) - octet_length(replace(x, ' ', '')) + 1)"
    plus = lambda a, b, k: f"zip_with({a}, slice({b}, {k} + 1, size(ns)), (a, b) -> a + b)"
    least = " ".join(f"when {s}[i] >= {GRAM_WORDS} then {k}" for s, k in (("s2", 2), ("s3", 3), ("s4", 4)))
    sizes = f"transform(ns, (n, i) -> case when n >= {GRAM_WORDS} then 1 {least} when i + 8 <= size(ns) then 8 else 0 end)"
    sizes = let(plus("ns", "ns", 1), "s2", let(plus("s2", "ns", 2), "s3", let(plus("s2", "s2", 2), "s4", sizes)))
    hashes = "transform(ks, (k, i) -> if(k = 0, null, xxhash64(slice(hs, i + 1, k))))"
    chosen = let("slice(gs, i + 1, k)", "w", "i + cast(array_position(w, array_min(w)) as int) - 1")
    picked = f"array_compact(array_distinct(transform(ks, (k, i) -> if(k = 0, null, {chosen}))))"
    prints = let(sizes, "ks", let(hashes, "gs", f"transform({picked}, j -> cast(j as bigint) * 16 + ks[j])"))
    lengths = f"transform(ns, n -> cast(least(n, {RUN_WORDS}) as tinyint))"
    return let(listed, "xs", let("transform(xs, x -> xxhash64(x))", "hs", let(counts, "ns", f"struct(hs, {lengths} as ns, {prints} as prints)")))


def windows() -> str:
    """SQL for pieces hs, ns, later fingerprints xs (i, k) and spans covered (i, j): the shortest runs of RUN_WORDS words from or to a piece that hold a fingerprint and are not covered, as structs (h, i, m) of hash, first piece and pieces."""
    grow = f"if((a & 127) < {RUN_WORDS}, a + x + 128, a)"
    taken = lambda i: f"aggregate(slice(ns, {i} + 1, most), 0, (a, x) -> {grow}, a -> if((a & 127) < {RUN_WORDS}, 0, shiftright(a, 7)))"
    # A run from piece i on that ends before the shortest one from piece i + 1 does is the shortest to its last piece.
    ends = "greatest(r, if(after = 0, size(ns) - i, after))"
    wanted = "not exists(covered, c -> c.i <= i and i + m - 1 <= c.j) and exists(xs, x -> x.i >= i and x.i + x.k <= i + m)"
    runs = f"transform(filter(sequence(r, {ends}), m -> {wanted}), m -> struct(xxhash64(slice(hs, i + 1, m)) as h, i as i, m as m))"
    from_piece = let(taken("i"), "r", f"if(r = 0, null, {let(taken('(i + 1)'), 'after', runs)})")
    # What is not covered and holds a fingerprint reaches over an end of a span.
    none = "cast(array() as array<int>)"
    beside = f"concat(if(c.i > 0, sequence(greatest(0, c.i - most), c.i - 1), {none}), if(c.j < size(ns) - 1, sequence(greatest(c.i, c.j - most), c.j), {none}))"
    starts = f"array_distinct(flatten(transform(covered, c -> {beside})))"
    whole = "size(xs) = 0 or (size(covered) = 1 and covered[0].i = 0 and covered[0].j = size(ns) - 1)"
    return f"if({whole}, null, {let(bounded(), 'most', f'flatten(array_compact(transform({starts}, i -> {from_piece})))')})"


def bounded() -> str:
    """SQL: a count of the pieces ns that holds RUN_WORDS words wherever it begins."""
    doubled = lambda a, k: f"zip_with({a}, slice({a}, {k} + 1, size({a})), (a, b) -> a + coalesce(b, {RUN_WORDS}))"
    holds = lambda a: f"coalesce(array_min({a}), {RUN_WORDS}) >= {RUN_WORDS}"
    sixteen = let(doubled("s8", 8), "s16", f"if({holds('s16')}, 16, {RUN_WORDS})")
    eight = let(doubled("s4", 4), "s8", f"if({holds('s8')}, 8, {sixteen})")
    return let(doubled("transform(ns, x -> cast(x as int))", 1), "s2", let(doubled("s2", 2), "s4", f"if({holds('s4')}, 4, {eight})"))


def places(docs: DataFrame) -> DataFrame:
    """(d, th, hs, ns, prints) for each row."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("d"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("t"))
    return keyed.select("d", "th", F.expr(let("t", "t", outlined())).alias("o")).select("d", "th", "o.*")


#: Sorted spans (i, j) of pieces, those that overlap or touch as one.
MERGED = """aggregate(slice(spans, 2, size(spans)), struct(cast(array() as array<struct<i:int,j:int>>) as done, spans[0] as last),
    (a, x) -> if(x.i <= a.last.j + 1, struct(a.done as done, struct(a.last.i as i, greatest(a.last.j, x.j) as j) as last), struct(concat(a.done, array(a.last)) as done, x as last)),
    a -> concat(a.done, array(a.last)))"""
LONG_ENOUGH = f"filter(merged, s -> aggregate(slice(ns, s.i + 1, s.j - s.i + 1), 0, (a, x) -> a + x) >= {LEAST_WORDS})"


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(d, th, spans): for documents with later repeats, the first and last of the pieces with words to delete, counted from 0."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    held = places(docs).checkpoint()
    gram = F.expr("xxhash64(slice(hs, cast(y div 16 as int) + 1, cast(y % 16 as int)))")
    prints = held.select("d", "th", "hs", F.explode("prints").alias("y")).select(gram.alias("g"), "d", "th", "y")
    again = prints.groupBy("g").agg(F.min("d").alias("d0"), F.count("*").alias("n")).where("n > 1").select("g", "d0").checkpoint()
    # Only places of fingerprints that occur elsewhere go back to their documents' pieces; a document has few.
    per_doc = prints.join(again, "g").groupBy("d", "th").agg(F.collect_set(F.struct("g", "y", "d0")).alias("xs")).checkpoint()
    tidy(spark)
    copied = held.groupBy("th").agg(F.min("d").alias("least"), F.max("d").alias("most")).where("least < most").select("th", "least").checkpoint()
    marked = per_doc.join(copied, "th", "left").withColumn("copy", F.coalesce(F.col("d") > F.col("least"), F.lit(False)))
    # Copies need no places: their first text has them.
    marked = marked.select("d", "th", "copy", F.when(F.col("copy"), F.expr("slice(xs, 1, 0)")).otherwise(F.col("xs")).alias("xs"))
    shared = held.select("d", "th", "hs", "ns").join(marked, ["d", "th"]).dropDuplicates(["d", "th"]).checkpoint()
    tidy(spark)
    at = shared.select("d", "th", "hs", F.explode("xs").alias("x")).select("d", "th", "hs", "x.g", "x.d0", F.expr("cast(x.y div 16 as int)").alias("i"), F.expr("cast(x.y % 16 as int)").alias("k"))
    around = at.select(
        *("d", "th", "g", "d0", "i", "k"),
        F.expr(f"transform(reverse(slice(hs, greatest(i - {REACH}, 0) + 1, least(i, {REACH}))), h -> cast(h & 2147483647 as int))").alias("before"),
        F.expr(f"transform(slice(hs, i + k + 1, {REACH}), h -> cast(h & 2147483647 as int))").alias("after"),
    )
    heads = around.groupBy("g").agg(F.min(F.when(F.col("d") == F.col("d0"), F.struct("th", "i", "before", "after"))).alias("head"), F.count("*").alias("n")).checkpoint()

    def common(ours: str, theirs: str) -> str:
        return let(f"array_position(zip_with({ours}, {theirs}, (x, y) -> x <=> y), false)", "m", f"if(m = 0, size({ours}), cast(m as int) - 1)")

    later = around.join(heads, "g").where("d <> d0 or th <> head.th or i <> head.i")
    # A fingerprint with one later place cannot hide a longer run of two of them.
    spans = later.select("d", "th", F.when(F.col("n") > 2, F.struct("i", "k")).alias("x"), F.struct((F.col("i") - F.expr(common("before", "head.before"))).alias("i"), (F.col("i") + F.col("k") + F.expr(common("after", "head.after")) - 1).alias("j")).alias("span"))
    spans = spans.groupBy("d", "th").agg(F.collect_set("x").alias("xs"), F.array_sort(F.collect_set("span")).alias("spans"))
    found = shared.where("not copy").select("d", "th", "hs", "ns").join(spans, ["d", "th"]).withColumn("covered", F.expr(MERGED)).select("d", "th", "hs", "ns", "xs", "covered").checkpoint()
    tidy(spark)
    wide = found.select("d", "th", F.explode(F.expr(windows())).alias("v")).select(F.col("v.h").alias("g"), F.struct("d", "th", F.col("v.i").alias("i")).alias("place"), (F.col("v.i") + F.col("v.m") - 1).alias("j")).checkpoint()
    first = wide.groupBy("g").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("g", "first")
    more = wide.join(first, "g").where("place <> first").groupBy("place.d", "place.th").agg(F.collect_set(F.struct("place.i", "j")).alias("more"))
    joined = found.join(more, ["d", "th"], "left").withColumn("spans", F.expr("if(more is null, covered, array_sort(concat(covered, more)))"))
    merged = joined.withColumn("merged", F.expr(f"if(more is null, covered, {MERGED})")).select("d", "th", F.expr(LONG_ENOUGH).alias("spans"))
    whole = shared.where("copy").select("d", "th", F.expr("array(struct(0 as i, size(ns) - 1 as j))").alias("merged"), "ns").select("d", "th", F.expr(LONG_ENOUGH).alias("spans"))
    return merged.union(whole).where("size(spans) > 0")


def with_spans(docs: DataFrame) -> DataFrame:
    """(doc, spans): each row as a struct beside the spans to delete, null without any."""
    spans = repeated_spans(docs).checkpoint()
    tidy(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("d"), F.xxhash64("text").alias("th"))
    return rows.join(spans, ["d", "th"], "left").select("doc", "spans")


def with_kept(found: DataFrame) -> DataFrame:
    """Adds cuts, the deleted spans as (low_line, low_piece, high_line, high_piece), and kept, the lines that stay."""
    worded = "rlike '[^\\\\x20\\\\x09-\\\\x0D]'"
    named = f"filter({pieces('doc.text', f'if(x {worded}, cast(l as bigint) * {PER_LINE} + k, null)')}, p -> p is not null)"
    at = lambda p: f"cast({p} div {PER_LINE} as int) as {{0}}_line, cast({p} % {PER_LINE} as int) as {{0}}_piece"
    cuts = let(named, "ps", "transform(spans, s -> struct(ps[s.i] as low, ps[s.j] as high))")
    gone = let(f"cast(l as bigint) * {PER_LINE}", "b", "filter(cuts, s -> s.high >= b and s.low < b + " + str(PER_LINE) + ")")
    left = f"filter(transform(split(line, '{CUT}'), (x, k) -> struct(x as x, exists(here, s -> b + k between s.low and s.high) as out)), y -> not y.out)"
    rest = let(f"cast(l as bigint) * {PER_LINE}", "b", let(left, "ys", f"if(exists(ys, y -> y.x {worded}), concat_ws('', transform(ys, y -> y.x)), null)"))
    kept = f"filter(transform(split(doc.text, '\\\\n'), (line, l) -> {let(gone, 'here', f'if(size(here) = 0, line, {rest})')}), x -> x is not null)"
    out = found.withColumn("cuts", F.expr(f"if(spans is null, null, {cuts})")).withColumn("kept", F.expr(f"if(cuts is null, null, {kept})"))
    return out.withColumn("cuts", F.expr(f"transform(cuts, s -> struct({at('s.low').format('low')}, {at('s.high').format('high')}))"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, without later repeats of runs."""
    found = with_kept(with_spans(docs)).withColumn("kept_text", F.expr("if(cuts is null, doc.text, concat_ws('\\n', kept))"))
    return found.select(*[F.col("kept_text").alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, deleted spans as (low_line, low_piece, high_line, high_piece) from 0, lines deleted whole and the text that stays."""
    found = with_kept(with_spans(docs.select("doc_id", "text")))
    gone = F.expr("if(cuts is null, 0, size(split(doc.text, '\\\\n')) - size(kept))")
    none = F.expr("cast(array() as array<struct<low_line:int,low_piece:int,high_line:int,high_piece:int>>)")
    return found.select(F.col("doc.doc_id").cast("long").alias("doc_id"), F.coalesce("cuts", none).alias("spans"), gone.cast("long").alias("n_deleted_lines"), F.expr("if(cuts is null, doc.text, concat_ws('\\n', kept))").alias("text"))
