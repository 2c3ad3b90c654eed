"""Similarity groups against brute force."""

import numpy as np

from gridloom.llm import resemblance, simhash


def components(sets, similarity):
    near = np.array([[len(a & b) >= similarity * len(a | b) for b in sets] for a in sets])
    label = np.arange(len(sets))
    while (least := np.where(near, label, len(sets)).min(axis=1)).tolist() != label.tolist():
        label = least
    return label.tolist()


def test_stage_reaches_similarity(spark):
    """Copies with a few changed words, at similarities about 0.8, and a crowd of near copies."""
    rng = np.random.default_rng(7)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    texts = []
    for _ in range(40):
        base = word(150)
        texts.append(base)
        for changed in (1, 2, 3, 4, 6):
            copy = list(base)
            for k in rng.choice(150, changed, replace=False):
                copy[k] = f"x{rng.integers(10**6)}"
            texts.append(copy)
    crowd = word(120)
    texts += [[*crowd[:k], "new", *crowd[k:]] for k in range(1, 120, 2)]
    rows = [(k, " ".join(x)) for k, x in enumerate(texts)]
    sets = [set(zip(*[x[j:] for j in range(5)], strict=False)) for x in texts]
    want = components(sets, 0.8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted(set(want))
    pairs = {}
    for r in resemblance.similar_components(docs).collect():
        pairs.setdefault(r["root"], set()).add(want[r["doc_id"]])
    assert all(len(x) == 1 for x in pairs.values())


def test_stage_goes_through_simhash(spark, monkeypatch):
    """Every distinct fingerprint of the documents goes to the balls, and their links to the check, which only similar texts pass."""
    asked, checked = [], []
    links, pairs = simhash.fingerprint_links, resemblance.simhash_pairs

    def told(distinct, radius=4, most=simhash.MOST):
        asked.append((sorted(r["fp"] for r in distinct.collect()), radius))
        return links(distinct, radius, most)

    def kept(*given):
        out = pairs(*given)
        checked.append(out.count())
        return out

    monkeypatch.setattr(simhash, "fingerprint_links", told)
    monkeypatch.setattr(resemblance, "simhash_pairs", kept)
    base = [f"w{k}" for k in range(400)]
    texts = [base, [*base[:-1], "x"], [f"v{k}" for k in range(300)], ["only", "four", "words", "here"], base]
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [0, 2, 3]
    want = {simhash.fingerprint(" ".join(x), 5) for x in texts}
    assert [([f % 2**64 for f in fps], radius) for fps, radius in asked] == [([f for f in sorted(want, key=simhash.signed)], 4)]
    assert checked == [1]
    # With a radius of 64 bits nothing but the check could keep unlike texts apart.
    every = lambda fps: fps.toDF("a").crossJoin(fps.toDF("b")).where("a < b")
    roots = {r["doc_id"]: r["root"] for r in resemblance.similar_components(docs, near=every).collect()}
    assert len(set(roots.values())) == 3 and roots[0] == roots[1] == roots[4]


def test_crowd_of_unlike_copies_makes_few_pairs(spark):
    """Copies of one text with five words changed each are unlike one another: they are not compared pair by pair, and those few that are alike are."""
    rng = np.random.default_rng(3)
    base, texts = [f"w{k}" for k in range(40)], []
    for k in range(200):
        copy = list(base)
        for j in rng.choice(40, 5, replace=False):
            copy[j] = f"x{k}_{j}"
        texts += [copy] if k % 20 else [copy, [*copy, "more"]]
    sets = [set(zip(*[x[j:] for j in range(5)], strict=False)) for x in texts]
    units = spark.createDataFrame([(k, len(x), k, sorted(hash(s) for s in x)) for k, x in enumerate(sets)], "u long, n int, root long, shingles array<long>")
    got = {(r["a"], r["b"]) for r in resemblance.rare_pairs(units, 0.8).collect()}
    want = {(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(want) >= 10 and {(b, a) for a, b in want} <= got
    assert len(got) <= 2 * len(texts)
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted(set(components(sets, 0.8)))
