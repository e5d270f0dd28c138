"""Near-dedup with repeated ids, the parts of the toxicity model, and the pipeline as a whole, against plain restatements."""

import random

import numpy as np
import pytest

from lectern.llm import toxicity as tox
from lectern.llm.near_dedup import near_dedup


def shingles(text, size):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def components(rows, size, similarity):
    """Smallest doc_id reachable: documents are tied by equal ids and by texts that are similar enough."""
    sets = [(d, shingles(t, size)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= similarity * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {d: find(d) for d in parent}


@pytest.mark.parametrize("seed", [3, 4])
def test_repeated_ids_keep_their_links(spark, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)) for _ in range(5)]
    near = [t + " more" for t in texts] + [t.replace(" ", "  ", 3).upper() for t in texts]
    rows = [(rng.randint(0, 14), rng.choice([*texts, *near, None, "", "two words"])) for _ in range(34)]
    rows += [(3, texts[0]), (5, texts[0]), (5, texts[1]), (7, texts[1]), (9, texts[1] + " word")]
    got = {r["doc_id"]: r for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    want = components(rows, 3, 85)
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(r["kept"] == (d == want[d]) for d, r in got.items())
    assert {d: r["n_shingles"] for d, r in got.items()} == {d: min(len(shingles(t, 3)) for e, t in rows if e == d) for d in want}


def test_null_ids_stay(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in near_dedup(docs).collect()) == [(-1, -1, True), (-1, -1, True), (1, 1, True)]


# ---------------------------------------------------------------- toxicity
def test_first_split_and_leaves_by_brute_force():
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(60, 3)), 1)
    y = (x[:, 1] + 0.1 * rng.normal(size=60) > 0.3).astype(float)
    model = tox.Boosted(rounds=1, depth=1).fit(x, y)
    p = y.mean()
    g, h = p - y, np.full(60, p * (1 - p))
    best = (0.0, None)
    for f in range(3):
        for at in model.cuts[f]:
            left = x[:, f] < at
            if h[left].sum() < 1 or h[~left].sum() < 1:
                continue
            gain = sum(g[m].sum() ** 2 / (h[m].sum() + 2) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + 2)
            if gain > best[0] + 1e-12:
                best = (gain, (f, at))
    f, at = best[1]
    left = x[:, f] < at
    leaf = np.where(left, *(-0.15 * g[m].sum() / (h[m].sum() + 2) for m in (left, ~left)))
    assert np.allclose(model.margin(x), np.log(p / (1 - p)) + leaf)


def test_boosting_lowers_the_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0)).astype(float)
    loss = lambda n: (lambda z: np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z)))))(tox.Boosted(rounds=n).fit(x, y).margin(x))
    assert loss(40) < loss(10) < loss(1)


def test_isotonic_by_brute_force():
    rng = np.random.default_rng(2)
    z, y = np.round(rng.normal(size=12), 1), rng.integers(0, 2, 12).astype(float)
    knots, values = tox.isotonic(z, y)
    # the best monotone fit by the min-max formula
    order = np.unique(z)
    mean = lambda a, b: y[(z >= a) & (z <= b)].mean()
    want = [max(min(mean(a, b) for b in order if b >= k) for a in order if a <= k) for k in order]
    assert np.allclose(knots, order) and np.allclose(values, want)


def test_lexicon_is_learned_in_any_language(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice(["zu", "ké", "lo", "mi", "ra", "té"]) for _ in range(3)) for _ in range(300)]
    clean = lambda: [rng.choice(words) for _ in range(60)]
    rude = lambda: clean() + ["Éskrup" + rng.choice(["a", "o", "is"]) for _ in range(4)]
    rows, labels = [], []
    for i in range(240):
        bad = i % 5 == 0
        text = rude() if bad else clean()
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        if i < 160:
            labels.append((i, int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in tox.toxicity(docs, known).collect()}
    assert [d for d in range(160, 240) if got[d]["predicted"]] == [d for d in range(160, 240) if d % 5 == 0]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(None, "x", 1), (1, None, 2), (1, "", 3)], "doc_id long, text string, toxic int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in tox.toxicity(docs, none).collect()] == [0, 0, 0]
    assert tox.toxicity(docs.limit(0), none).count() == 0


# ---------------------------------------------------------------- pipeline
def test_pipeline_runs_over_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 99)) for _ in range(n))
    item, twin, line = text(20), text(80), text(8)
    rows = [(i, f"{text(40)}\n{line}\n{text(30)}") for i in range(30)]
    rows += [(40, twin), (41, twin + "\nand one more"), (42, f"{text(30)} {item} {text(30)}"), (43, None), (44, ""), (None, text(25)), (45, text(30)), (45, text(30)), (46, "alone"), (46, "alone")]
    rows += [(100 + i, "you stupid idiot worthless scum " + text(20)) for i in range(30)]
    # names that the operators use themselves
    full = [(d, t, "en", "web", len(t or ""), 1, "x") for d, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, predicted int, component_id string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(25)] + [(100 + i, 0, 1) for i in range(25)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in packed}
    assert ids == {*range(30), 40, 41, 43, 44, None, 45, 46}
    # line dedup leaves document 41 its own last line
    assert not ids & {42, *range(100, 130)}
    for seq in {r["sequence_id"] for r in packed}:
        at = 0
        for r in sorted((x for x in packed if x["sequence_id"] == seq), key=lambda x: x["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
