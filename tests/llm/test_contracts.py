"""Each operator against brute force on the small tables, and on rows that are null, empty, tied or repeated."""

import base64
import hashlib
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from gridloom.llm import bpe, classifier, components, licenses, packing, quality_rules, queries, simhash, spherical, training_order, transcripts, winnowing

SF = "/root/testdata/sf0.001"
WORD, MULTI = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
LONG = "word " * 30_000 + "x" * 5000
ODD = [(1, None), (2, ""), (3, " \n\t\x0b"), (4, "A b"), (4, "A b"), (5, "a B"), (None, "one two three four five"), (6, LONG), (7, "é漢😀 don't\x1c\x85 12½ <|endoftext|> ǅ Σς"), (None, None)]


def odd(spark, rows=ODD):
    """Documents with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(d, t, None, "s", 0, 1.0, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.fixture(scope="module", params=["table", "odd", "empty"])
def docs(request, spark):
    return documents(spark) if request.param == "table" else odd(spark) if request.param == "odd" else odd(spark, [])


def test_bpe(docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t in texts(docs):
        ids = np.array(own.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert Counter(map(tuple, bpe.round_trip(docs, MULTI, P.PATTERN).collect())) == Counter(want)


def test_bpe_encode_decode(spark):
    coded = bpe.encode(odd(spark), MULTI, P.PATTERN)
    assert Counter(bytes(r["decoded"]) for r in bpe.decode(coded, MULTI, P.PATTERN).collect()) == Counter((t or "").encode() for _, t in ODD)


def test_packing(docs):
    from tokenizers import Tokenizer

    own, want = Tokenizer.from_file(WORD), []
    for d, t in texts(docs):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(d, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
    got = packing.pack_documents(docs, WORD).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    gaps, opened = [], 0
    for n in sorted((w[3] for w in want), reverse=True):
        k = bisect_left(gaps, n)
        opened += k == len(gaps)
        insort(gaps, (gaps.pop(k) if k < len(gaps) else 4096) - n)
    assert len(held) == opened


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_fingerprint(t):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    from xxhash import xxh64_intdigest

    hashes = [xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("most", [1024, 2])
def test_simhash(docs, most):
    rows = texts(docs)
    fps = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
    label = np.arange(len(rows))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    while len(rows) and (least := np.where(near, label, len(rows)).min(axis=1)).tolist() != label.tolist():
        label = least
    smallest = defaultdict(list)
    for (d, _), k in zip(rows, label.tolist(), strict=True):
        smallest[k] += [d] if d is not None else []
    want = Counter((d, f"{int(f):016x}", min(smallest[k], default=None)) for (d, _), f, k in zip(rows, fps, label.tolist(), strict=True))
    assert Counter(map(tuple, simhash.near_duplicate_components(docs, most=most).collect())) == want


def test_simhash_balls_find_every_distance(spark):
    """Fingerprints 0 to 6 bits apart, in crowds that go through the full balls and in pairs that do not."""
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 2**63, 12).astype(np.uint64)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for c in centre for k in (0, 1, 2, 3, 4, 5, 6) for _ in range(6)})
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    arr = np.array(fps, np.uint64)

    def classes(pairs):
        root = {int(simhash.signed(f)): int(simhash.signed(f)) for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        out = defaultdict(set)
        for x in root:
            out[find(x)].add(x)
        return sorted(map(sorted, out.values()))

    for radius in (4, 3, 2, 1, 0):
        near = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= radius
        want = classes([(simhash.signed(fps[a]), simhash.signed(fps[b])) for a, b in zip(*np.nonzero(near), strict=True)])
        for most in (1024, 3):
            assert classes([(r["a"], r["b"]) for r in simhash.fingerprint_links(df, radius, most).collect()]) == want


def test_keep_one(spark):
    kept = [r["doc_id"] for r in simhash.keep_one(odd(spark)).collect()]
    assert sorted(d for d in kept if d is not None) == [1, 4, 6, 7]  # 1 to 3 have no words, 4 and 5 differ in case only
    assert kept.count(None) == 2


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components.connected_components(edges.limit(0)).collect() == []


def base_counts(t):
    w = words(t)
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    often = Counter(windows)
    covered = {j for k, x in enumerate(windows) if often[x] > 1 for j in range(k, k + 8)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_rules(docs):
    got = quality_rules.quality_verdicts(docs).collect()
    want = Counter((d, *base_counts(t)) for d, t in texts(docs))
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_quality_rules_distances(spark):
    """The fitted distances against the same steps in numpy, and a planted outlier."""
    rng = np.random.default_rng(1)
    rows = [(k, " ".join("w" * int(rng.integers(2, 9)) + str(j) for j in range(int(rng.integers(40, 90))))) for k in range(120)]
    rows.append((500, " ".join(f"w{j} |" for j in range(60))))
    got = {r["doc_id"]: r for r in quality_rules.quality_verdicts(odd(spark, rows)).collect()}
    assert not got[500]["kept"]
    assert sum(got[k]["kept"] for k in range(120)) >= 119
    x = np.array([[np.log(c[0]), np.log(c[1] / c[0]), c[2] / c[0], 0, c[4] / c[0]] for c in (base_counts(t) for _, t in rows)])
    x = np.round(x * 4096) / 4096
    floor = np.diag(np.square(list(quality_rules.FEATURES.values())))
    d = np.array([got[k]["distance"] for k, _ in rows])
    keep = np.argsort(d)[: int(np.ceil(0.75 * len(rows)))]
    cov = np.cov(x[keep].T, bias=True) * quality_rules.CONSISTENCY + floor
    diff = x - x[keep].mean(axis=0)
    near = np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff)
    np.testing.assert_allclose(d[:120], near[:120], rtol=0.1, atol=0.1)


def brute_scatter(x, steps=60, starts=40):
    """The least determinant of a covariance of 75 % of the rows, floors included, that concentration from random subsets finds: (centre, covariance)."""
    rng, floor = np.random.default_rng(3), np.diag(np.square(list(quality_rules.FEATURES.values())))
    h, best = int(np.ceil(0.75 * len(x))), None
    for _ in range(starts):
        keep = rng.choice(len(x), 12, replace=False)
        for _ in range(steps):
            cov = np.cov(x[keep].T, bias=True) * quality_rules.CONSISTENCY + floor
            diff = x - x[keep].mean(axis=0)
            new = np.argsort(np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff), kind="stable")[:h]
            if set(new) == set(keep):
                break
            keep = new
        cov = np.cov(x[keep].T, bias=True) * quality_rules.CONSISTENCY + floor
        if best is None or np.linalg.slogdet(cov)[1] < best[0]:
            best = np.linalg.slogdet(cov)[1], x[keep].mean(axis=0), cov
    return best


def test_quality_rules_find_the_least_determinant(spark):
    """Verdicts against an own search with random starts, where a fifth of the rows form a cloud of their own that would pull a single estimate."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(240):
        words_ = [("w" * int(rng.integers(2, 9))) + str(j) for j in range(int(rng.integers(40, 90)))]
        if k % 5 == 0:
            words_ = [w * 3 + "|#" for w in words_]
        rows.append((k, " ".join(words_)))
    rows.append((500, " ".join(f"w{j} |" for j in range(60))))
    got = {r["doc_id"]: r for r in quality_rules.quality_verdicts(odd(spark, rows)).collect()}
    x = np.array([[np.log(c[0]), np.log(c[1] / c[0]), c[2] / c[0], 0, c[4] / c[0]] for c in (base_counts(t) for _, t in rows)])
    x = np.round(x * 4096) / 4096
    _, centre, cov = brute_scatter(x)
    diff = x - centre
    far = np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff)
    clear = np.abs(far - quality_rules.CUTOFF) > 0.1 * quality_rules.CUTOFF
    assert clear.mean() > 0.9
    assert all(got[d]["kept"] == (f <= quality_rules.CUTOFF) for (d, _), f, ok in zip(rows, far, clear, strict=True) if ok)
    kept = quality_rules.keep_good(odd(spark, [*rows, *rows[:3]])).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter([d for d, _ in rows if got[d]["kept"]] + [d for d, _ in rows[:3] if got[d]["kept"]])


def test_class_prior():
    """The estimate comes near the share of positives, from positives and mixed rows alone."""
    rng = np.random.default_rng(6)
    positive = rng.normal(1, 1, (1500, 3))
    for share in (0.3, 0.6, 0.9):
        n = int(3000 * share)
        mixed = np.concatenate([rng.normal(1, 1, (n, 3)), rng.normal(-2, 1, (3000 - n, 3))])
        assert abs(classifier.class_prior(positive, mixed) - share) < 0.08


def test_classifier_on_the_held_out_fold(spark):
    """Accuracy on documents whose labels were not learnt from; labels of the fold and negative ones change nothing."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = {r["doc_id"]: r for r in classifier.quality_scores(docs, labels).collect()}
    fold = [(got[d]["predicted"], got[d]["score"], q) for d, q in truth.items() if got[d]["held_out"]]
    assert np.mean([p == q for p, _, q in fold]) > 0.9
    good, poor = [s for _, s, q in fold if q == 1], [s for _, s, q in fold if q == 0]
    assert np.mean([a > b for a in good for b in poor]) > 0.95
    fewer = labels.where("quality = 1 and crc32(cast(doc_id as string)) % 5 <> 0")
    assert {r["doc_id"]: r["score"] for r in classifier.quality_scores(docs, fewer).collect()} == pytest.approx({d: r["score"] for d, r in got.items()})


def test_classifier(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in classifier.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in got.items())
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert np.mean([got[d]["predicted"] == q for d, q in truth.items()]) > 0.9
    assert len(classifier.quality_scores(odd(spark), labels).collect()) == len(ODD)
    assert classifier.quality_scores(odd(spark, []), labels).collect() == []
    assert {r["score"] for r in classifier.quality_scores(odd(spark), labels.limit(0)).collect()} == {0.5}
    assert classifier.keep_predicted(docs, labels).columns == docs.columns


def test_non_negative_risk():
    rng = np.random.default_rng(2)
    positive, negative = rng.normal(1, 1, (400, 3)), rng.normal(-2, 1, (400, 3))
    mixed = np.concatenate([rng.normal(1, 1, (600, 3)), rng.normal(-2, 1, (400, 3))])
    model = classifier.fit(positive, mixed, 0.6)
    assert (model.score(positive) >= 0.5).mean() > 0.9
    assert (model.score(negative) < 0.5).mean() > 0.9


PASSAGE = "\n".join(f"shared line {k} has some eight words of text" for k in range(8))


def test_winnowing(spark):
    other = lambda k: "\n".join(f"own {k} line {j} that nobody else has got here {k * j}" for j in range(9))
    rows = [(1, other(1) + "\n" + PASSAGE + "\n" + other(2)), (2, other(3) + "\n\n" + PASSAGE.replace(" some ", "  some\t")), (3, other(4)), (4, other(4)), (4, other(4)), (5, PASSAGE.split("\n")[0]), (6, PASSAGE + "\n" + PASSAGE), *ODD]
    got = defaultdict(list)
    for r in winnowing.line_report(odd(spark, rows)).collect():
        got[r["doc_id"]].append(r)
    assert got[1][0]["text"] == rows[0][1]
    assert got[2][0]["text"] == other(3) + "\n"
    assert got[3][0]["text"] == other(4)
    assert {r["text"] for r in got[4]} == {"", "A b"}
    assert got[5][0]["n_deleted_lines"] == 0
    assert {r["text"] for r in got[6]} == {"", LONG}
    assert {r["text"] for r in got[1]} == {rows[0][1], None}
    assert winnowing.line_report(odd(spark, [])).collect() == []
    assert winnowing.dedup_lines(odd(spark, rows)).columns == odd(spark).columns


def cut_pieces(t):
    """(line, piece, words) of the pieces that have words."""
    return [(p, k, tuple(words(x))) for p, line in enumerate(t.split("\n")) for k, x in enumerate(re.split(r"(?<=[.!?])(?=[\x20\x09\x0B-\x0D])", line)) if words(x)]


def runs_of(pieces, least):
    """The shortest runs of so many words from each piece on: (first, end)."""
    for i in range(len(pieces)):
        n = 0
        for j in range(i, len(pieces)):
            n += len(pieces[j][2])
            if n >= least:
                yield i, j + 1
                break


def runs_to(pieces, least):
    """The shortest runs of so many words to each piece: (first, end)."""
    back = [(len(pieces) - j, len(pieces) - i) for i, j in runs_of(pieces[::-1], least)]
    return back


def check_runs(rows, got):
    """Every run of 50 words that an earlier place has goes; what goes holds a run of 16 words that another place has; the rest stays as it is."""
    held = {(d, t): cut_pieces(t) for d, t in rows}
    places = Counter(tuple(x[2] for x in pieces[i:j]) for pieces in held.values() for i, j in {*runs_of(pieces, 16), *runs_to(pieces, 16)})
    first = {}
    for (d, t), pieces in sorted(held.items()):
        gone = {(p, k) for s in got[d]["spans"] for p, k, _ in pieces if (s["low_line"], s["low_piece"]) <= (p, k) <= (s["high_line"], s["high_piece"])}
        for i, j in runs_of(pieces, 50):
            key = tuple(x[2] for x in pieces[i:j])
            assert first.setdefault(key, (d, i)) == (d, i) or all((p, k) in gone for p, k, _ in pieces[i:j])
        again = {pieces[x][:2] for i, j in {*runs_of(pieces, 16), *runs_to(pieces, 16)} if places[tuple(x[2] for x in pieces[i:j])] > 1 for x in range(i, j)}
        assert gone <= again
        left = []
        for p, line in enumerate(t.split("\n")):
            parts = re.split(r"(?<=[.!?])(?=[\x20\x09\x0B-\x0D])", line)
            out = [x for k, x in enumerate(parts) if not any((s["low_line"], s["low_piece"]) <= (p, k) <= (s["high_line"], s["high_piece"]) for s in got[d]["spans"])]
            if len(out) == len(parts) or any(words(x) for x in out):
                left.append("".join(out))
        assert got[d]["text"] == "\n".join(left)


def test_winnowing_finds_every_run(spark):
    rows = texts(documents(spark))
    check_runs(rows, {r["doc_id"]: r for r in winnowing.line_report(documents(spark)).collect()})


def test_winnowing_of_shared_cores(spark):
    """Cores that occur alone in one document and with more around them in two others, at random."""
    rng = np.random.default_rng(11)
    some = lambda n: ["".join(rng.choice(list("abcdefghij"), 5)) + " " + " ".join(map(str, rng.integers(0, 10**6, rng.integers(0, 12)))) + rng.choice([".", ",", ""]) for _ in range(n)]
    rows = []
    for k in range(100):
        core, before, after = some(int(rng.integers(2, 6))), some(int(rng.integers(1, 6))), some(int(rng.integers(1, 6)))
        for j, run in enumerate((core, before + core + after, before + core + after)):
            rows.append((3 * k + j, "\n".join([*some(4), *run, *some(4)])))
    got = {r["doc_id"]: r for r in winnowing.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    check_runs(rows, got)


def test_winnowing_inside_lines(spark):
    """A passage set into the middle of long lines goes where it comes later, the rest of the line stays."""
    prose = lambda d: " ".join(f"{d} says {j} things, of which {d * j} are his. " for j in range(12))
    passage = " ".join(f"Sentence {j} of the passage has words, some of them {j * j} in number." for j in range(6))
    rows = [(1, prose(1) + passage + " " + prose(2)), (2, prose(3) + "then " + passage + " " + prose(4)), (3, prose(5) + passage + "\n" + prose(6))]
    got = {r["doc_id"]: r["text"] for r in winnowing.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1]
    assert got[3].replace(" ", "") == (prose(5) + "\n" + prose(6)).replace(" ", "")
    assert len(words(got[2])) == len(words(prose(3) + "then Sentence 0 of the passage has words, some of them 0 in number. " + prose(4)))


def test_spherical(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 24))
    rows = [(k, base[k % 40] + rng.standard_normal(24) * 0.08 * (k // 40), k % 3) for k in range(300)]
    crowd = rng.standard_normal(24)
    rows += [(1000 + k, crowd + rng.standard_normal(24) * 0.02, 1) for k in range(700)]
    rows += [(2000, crowd, None), (2001, np.zeros(24), 1), (2002, crowd, 1), (2002, crowd, 1), (2003, np.full(24, np.nan), 1), (2004, crowd[:8], 1)]
    data = [(k, [float(x) for x in v], lab, 7) for k, v, lab in rows] + [(2005, None, 1, 7), (2006, [1.0, None], 1, 7), (2007, [], 1, 7)]
    got = defaultdict(list)
    for r in spherical.near_duplicate_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, n_links int")).collect():
        got[r["vec_id"]].append((r["n_links"], r["component_id"], r["kept"]))
    real = [(k, v / np.linalg.norm(v), lab) for k, v, lab in rows if lab is not None and len(v) == 24 and np.isfinite(v).all() and np.abs(v).sum() > 0]
    unit, lab = np.array([v for _, v, _ in real]), np.array([x for _, _, x in real])
    near = (unit @ unit.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(near, False)
    links = near.sum(axis=1)
    for (k, _, _), n in zip(real, links, strict=True):
        assert all(x[0] <= n for x in got[k])
    assert sum(x[0] for k, _, _ in {r[0]: r for r in real}.values() for x in got[k]) >= 0.98 * links.sum()
    label = np.array([k for k, _, _ in real])
    while (least := np.where(near, label[None, :], label[:, None]).min(axis=1)).tolist() != label.tolist():
        label = np.minimum(label, least)
    if sum(x[0] for x in {r[0]: got[r[0]][0] for r in real}.values()) == sum({r[0]: n for r, n in zip(real, links, strict=True)}.values()):  # every link was found
        for (k, _, _), n, root in zip(real, links, label, strict=True):
            assert got[k][0] == (n, root, k == root)
    for k in (2000, 2001, 2003, 2004, 2005, 2006, 2007):
        assert got[k] == [(0, k, True)]
    assert len(got[2002]) == 2
    assert got[1001][0][1:] == (1000, False)
    assert spherical.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).collect() == []


@pytest.mark.parametrize("size", [8, 48, 134, 400])
def test_spherical_recall_at_any_size(size):
    """Pairs at cosine 0.98 share a filter in codes for a thousand to millions of vectors."""
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.standard_normal((400, 64)))
    z = rng.standard_normal((400, 64))
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * unit(z - (z * a).sum(axis=1, keepdims=True) * a)
    code = spherical.CapCode(64, size)
    assert np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(code.decode(a), code.decode(b), strict=True)]) > 0.97


@pytest.mark.parametrize("length", [1, 3, 5, 24])
def test_spherical_decoding(length):
    """The filters are those of the greatest sums of block scores."""
    code, x = spherical.CapCode(length, 6), np.random.default_rng(2).standard_normal((5, length))
    turned = spherical.normalized(x) @ code.rotation
    scores = [turned[:, a:b] @ c.T for (a, b), c in zip(code.cuts, code.codes, strict=True)]
    for k, found in enumerate(code.decode(spherical.normalized(x))):
        every = (scores[0][k][:, None, None, None] + scores[1][k][:, None, None] + scores[2][k][:, None] + scores[3][k]).ravel()
        np.testing.assert_allclose(every[found], np.sort(every)[::-1][: spherical.FILTERS], atol=1e-12)
        assert len(set(found.tolist())) == spherical.FILTERS


def test_spherical_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in (rng.standard_normal(12) if k % 3 else np.ones(12) + rng.standard_normal(12) * 0.15)], k % 2) for k in range(120)] + [(200, None, 1), (201, [0.0] * 12, 1), (202, [1.0] * 12, None), (203, [1.0] * 12, 1), (204, [1.0] * 12, 1)]
    con.execute("create table embeddings (vec_id bigint, embedding float[], label int)")
    con.executemany("insert into embeddings values (?, ?, ?)", rows)
    held = spark.createDataFrame(con.execute("select * from embeddings").fetchall(), "vec_id long, embedding array<float>, label int")
    want = con.execute(queries.ORACLES["op9_spherical_cap_near_dedup"]).fetchall()
    assert sorted(map(tuple, spherical.near_duplicate_vectors(held).collect())) == sorted(want)


@pytest.mark.parametrize("count", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_bijection(count):
    slots = training_order.permuted(np.arange(count), count)
    assert sorted(slots.tolist()) == list(range(count))
    assert count < 64 or (slots != np.arange(count)).mean() > 0.9
    assert count < 64 or (training_order.permuted(np.arange(count), count, 1) != slots).any()


def test_training_order(docs, tmp_path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(WORD)
    got = training_order.materialise(docs, WORD, str(tmp_path), stride=64, rows=128).collect()
    want = Counter()
    for d, t in texts(docs):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        want.update((d, k // 64, zlib.crc32(np.array(ids[k : k + 64], "<u2").tobytes())) for k in range(0, len(ids), 64))
    assert Counter((r["doc_id"], r["piece"], r["crc32"]) for r in got) == want
    assert sorted(r["slot"] for r in got) == list(range(len(got)))
    by_slot = {r["slot"]: r for r in got}
    for start in {0, len(got) // 2}:
        seen = list(training_order.read_from(str(tmp_path), start, 64, 128))
        assert len(seen) == len(got) - start
        assert all(zlib.crc32(x[: by_slot[start + k]["n_tokens"]].tobytes()) == by_slot[start + k]["crc32"] for k, x in enumerate(seen))


def odd_turns(spark):
    rows = [(None, None, None, None, 1), (None, 3, "user", "User: nobody", 1), (1, 0, "user", None, 1), (1, 0, "user", "", 1), (1, 0, "user", "", 1), (2, 5, "odd", "x\n\ny", 1)]
    rows += [(3, k % 50, ("user", "assistant", None)[k % 3], f"hot {k % 7}" + "?" * (k % 2), 1) for k in range(900)]
    rows += [(4, None, "assistant", "long " * 30_000, 1), (4, 1, "user", "\n".join(f"[Human] line {k}" for k in range(300)), 1)]
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, part int")


def test_transcripts(spark):
    held = spark.read.parquet(f"{SF}/conversations.parquet")
    got = transcripts.parse_conversations(held).collect()
    assert sum(r["n_turns"] for r in got) == held.count()
    for fold in (True, False):  # conversations and styles that the model was not fitted on, and those that it was
        some = [r for r in got if (r["style_written"] in transcripts.FIT_STYLES) != fold or (zlib.crc32(str(r["conv_id"]).encode()) % 5 == 0) == fold]
        assert some and sum(r["n_lines_right"] for r in some) > 0.95 * sum(r["n_lines"] for r in some)
        assert sum(r["n_exact"] for r in some) > 0.9 * sum(r["n_turns"] for r in some)
    assert all(r["style_found"] == r["style_written"] for r in got if r["n_turns"] > 4)
    odd_rows = odd_turns(spark)
    found = transcripts.parse_conversations(odd_rows).collect()
    assert sum(r["n_turns"] for r in found) == odd_rows.count()
    assert max(r["n_turns"] for r in found) <= transcripts.PART_ROWS
    assert transcripts.parse_conversations(odd_rows.limit(0)).collect() == []


def test_transcripts_in_parts(spark):
    """Conversations cut into parts of three turns give the lines, turns and texts that they give whole."""
    rows = odd_turns(spark).where("conv_id in (3, 4)").union(spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text", "turn").where("conv_id < 40 and conv_id > 9"))
    sums = {}
    for size in (3, 10_000):
        for r in transcripts.parse_conversations(rows, part_rows=size).orderBy("part").collect():
            held = sums.setdefault((size, r["conv_id"]), [0, 0, r["style_written"], r["style_found"], ""])
            held[0] += r["n_lines"]
            held[1] += r["n_lines_right"]
            held[4] += r["rendered"]
    heads = lambda x: x.count("<|user|>"), lambda x: x.count("<|assistant|>")
    for (size, conv), held in sums.items():
        whole = sums[10_000, conv]
        assert held[:4] == whole[:4], (size, conv)
        assert all(f(held[4]) == f(whole[4]) for f in heads)


def test_raw_transcripts(spark):
    """Words that look like markers of another style stay; a style's own markers go, and nothing else does."""
    model = transcripts.learn(spark.read.parquet(f"{SF}/conversations.parquet"))
    texts_ = {
        1: ("User: how many?\n\nAssistant: Let me see.\n  two lines\n\nUser: and why?\n\nAssistant: Answer: forty two\nQ: is that all?", [("user", "how many?"), ("assistant", "Let me see.\n  two lines"), ("user", "and why?"), ("assistant", "Answer: forty two\nQ: is that all?")]),
        2: ("### Human\n  hello\n### Ai\nUser: is a word\n### Human\nbye\n### Ai\nbye", [("user", "  hello"), ("assistant", "User: is a word"), ("user", "bye"), ("assistant", "bye")]),
        3: ("<|system|>\nBe kind.\n<|user|>\nhi\n<|assistant|>\nhi!\n<|user|>\nbye", [("system", "Be kind."), ("user", "hi"), ("assistant", "hi!"), ("user", "bye")]),
        4: (None, []),
    }
    df = spark.createDataFrame([(k, t, "x") for k, (t, _) in texts_.items()], "id long, text string, turns string")
    for r in transcripts.parse_transcripts(df, model).collect():
        assert [(x["role"], x["text"]) for x in r["turns"]] == texts_[r["id"]][1]
        assert r["rendered"] == "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in texts_[r["id"]][1])


def test_viterbi_finds_the_best_path():
    from itertools import product

    model, rng, n = transcripts.RoleModel(), np.random.default_rng(5), 2 * transcripts.N
    model.first += rng.random(n)
    model.step += rng.random((n, n))
    model.seen = [t + rng.random(t.shape) for t in model.seen]
    model.ready()
    many = [np.array([[rng.integers(k) for k in model.sizes] for _ in range(lines)]) for lines in (3, 4, 1, 4)]
    for features, path in zip(many, model.viterbi(many), strict=True):
        emit = model.emitted(features)
        score = lambda p: model.first[p[0]] + sum(emit[k, s] for k, s in enumerate(p)) + sum(model.step[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023,E731
        assert tuple(path) == max(product(range(n), repeat=len(features)), key=score)
    joined = np.concatenate(many)
    ends = transcripts.borders([model.transfer(x) for x in many])
    parts = model.viterbi(many, np.array([a for a, _ in ends]), np.array([b for _, b in ends]))
    assert np.concatenate(parts).tolist() == model.viterbi([joined])[0].tolist()


def test_licences(spark):
    plain = "\n".join(f"some ordinary line {k} of invented prose about nothing" for k in range(50))
    rows = [(1, plain), (2, plain + "\nReleased under the MIT License.\nmore"), (3, "see: Licensed under the Apache License, Version 2.0 for it"), (4, "license"), *ODD]
    found = [(r["doc_id"], r["line"], r["family"]) for r in licenses.scan(odd(spark, rows)).collect()]
    assert sorted(found) == [(2, 50, "MIT"), (3, 0, "Apache-2.0")]
    assert licenses.scan(odd(spark, [])).collect() == []


def test_licences_in_the_table(spark):
    docs = documents(spark)
    lines = {t: name for name, ts in licenses.templates().items() for t, _ in ts}
    want = {(d, p, lines[x]) for d, t in texts(docs) for p, x in enumerate(t.split("\n")) if x in lines}
    got = licenses.scan(docs).collect()
    held = {(r["doc_id"], p, r["family"]) for r in got for p in range(r["line"], r["last_line"] + 1)}
    assert want and want <= held
    assert len(held) <= len(want) + 3


NOTICES = {
    "Permission is hereby granted, free of\ncharge, to any person obtaining a copy\nof this software and associated documentation files": "MIT",
    "Redistribution and use in\nsource and binary forms, with or\nwithout modification, are permitted\nprovided that the following conditions are met:": "BSD",
    "Distributed under the Mozilla Public License,\nversion 2.0.": "MPL-2.0",
    "GNU Lesser General Public License, version 2.1, is the license.": "LGPL-2.1",
    "The license is CC BY-SA 4.0": "CC-BY-SA-4.0",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "Licensed under the Apache License, Version 1.1.": "unknown",
    "Licensed under CC BY 3.0.": "unknown",
    "This file is licensed under the GNU General Public License, version 1.": "unknown",
    "Licensed under the European Union Public Licence, Version 1.2.": "unknown",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "unknown",
}


def test_licences_wrapped_and_near_misses(spark):
    rows = [(k, f"plain words here\n\n{t}\n\nmore of them") for k, t in enumerate(NOTICES)] + [(90, "A licence to drive was what the man had.\nHis permission slip, too."), (91, "x " * 30_000 + "released under the MIT License. " + "y " * 30_000)]
    own = spark.createDataFrame([(d, t, "h", [1], "l") for d, t in rows], "doc_id long, text string, hits string, ls array<int>, line string")
    found = {r["doc_id"]: (r["family"], r["line"], r["last_line"]) for r in licenses.scan(own).collect()}
    assert found == {k: (f, 2, 2 + t.count("\n")) for k, (t, f) in enumerate(NOTICES.items())} | {91: ("MIT", 0, 0)}


def test_licence_probabilities():
    """Notices and near misses that the fit has not seen: the likelier classes hold as often as they say."""
    model = licenses.train([f"plain line {k} of some words" for k in range(200)])
    known = [(f"{a} {t} {b}", name) for name, ts in licenses.templates().items() for t, _ in ts for a, b in (("here we say:", "and so on"), ("note", "as of now"))]
    other = [(f"{a} the {name}, version {v}", "unknown") for a in ("Available under", "You may use this under") for name in ("Sleepycat License", "Python License", "Apache License", "Mozilla Public License", "Cryptix General License") for v in ("0.7", "1.3", "6")]
    p = model.probabilities([t for t, _ in known + other])
    y = np.array([model.families.index(f) for _, f in known + other])
    right = p.argmax(axis=1) == y
    assert right.mean() > 0.95
    assert abs(p.max(axis=1).mean() - right.mean()) < 0.05


def test_hashes_match_the_brute_force(spark):
    """Scores by expressions equal the model's own probabilities."""
    model = licenses.train(["plain words"])
    rows = [(k, t) for k, t in enumerate(NOTICES)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    p = model.probabilities(list(NOTICES))
    assert all(got[k]["probability"] == pytest.approx(p[k].max(), rel=1e-3) for k in got)


def test_queries_are_ten():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES) == list(range(1, 11))
