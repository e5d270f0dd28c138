"""The word model of operator 9 against brute force over dictionaries."""

import collections
import contextlib
import math
import os
import random
import re
import threading

import numpy as np
import pytest

from lectern.llm import quality_words

SCHEMA = "doc_id long, text string, lang string"


def units(t):
    return re.findall(r"[!-/:-@\[-`{-~]|[^\s!-/:-@\[-`{-~]+", (t or "").lower())


def model(texts):
    """p(word, two words before) of an interpolated modified Kneser-Ney model."""
    seen = collections.Counter()
    for w in texts:
        w = ["<", "<", *w, ">"]
        seen.update(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    tables = {3: seen}
    for n in (2, 1):
        tables[n] = collections.Counter(g[1:] for g in tables[n + 1])

    def discounts(c):
        n1, n2, n3, n4 = (sum(v == k for v in c.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        return [min(max(k + 1 - (k + 2) * y * b / a if a and b else 0.75 * (k + 1), 0.05), k + 0.95) for k, a, b in ((0, n1, n2), (1, n2, n3), (2, n3, n4))]

    cuts = {n: discounts(t) for n, t in tables.items()}
    contexts = collections.defaultdict(lambda: [0, 0.0])
    for n, t in tables.items():
        for g, c in t.items():
            contexts[n, g[:-1]][0] += c
            contexts[n, g[:-1]][1] += cuts[n][min(c, 3) - 1]

    def p(g, n):
        if n == 0:
            return 1 / (len(tables[1]) + 1)
        lower = p(g[1:], n - 1)
        if (n, g[:-1]) not in contexts:
            return lower
        total, freed = contexts[n, g[:-1]]
        c = tables[n].get(g, 0)
        return ((c - cuts[n][min(c, 3) - 1]) / total if c else 0) + freed / total * lower

    return p


def test_perplexities(spark):
    rng = random.Random(8)
    vocabulary = ["the", "river", "runs", "over", "stone", "and", "light", "слово", "其他", "Étang"] + [f"w{k}" for k in range(40)]
    say = lambda k: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", ".\n"]) for _ in range(k))
    texts = [(i, say(rng.randint(1, 30)), "en") for i in range(80)] + [(900, None, "en"), (901, " \n", "fr"), (902, "one", None), (902, "The river, the RIVER", "fr"), (903, "...", "fr")]
    labels = spark.createDataFrame([(i, 1) for i in range(50)] + [(60, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality_words.quality_words(spark.createDataFrame(texts, SCHEMA), labels).collect()
    assert len(got) == len(texts)
    of = quality_words.half(np.arange(50))
    models = [model([units(t) for i, t, _ in texts if i < 50 and of[i] != k]) for k in (0, 1)] + [model([units(t) for i, t, _ in texts if i < 50])]
    found = {(r.doc_id, r.n_scored): r for r in got}
    for i, t, _ in texts:
        w, r = units(t), found[i, len(units(t))]
        if not w:
            assert r.perplexity is None and not r.kept
            continue
        p = models[of[i] if i < 50 else 2]
        w = ["<", "<", *w, ">"]
        want = math.exp(-sum(math.log(p(tuple(w[k : k + 3]), 3)) for k in range(len(w) - 2)) / (len(w) - 2))
        assert r.perplexity == pytest.approx(want, rel=1e-4)


def test_words_count_not_only_letters(spark):
    """Trusted words in an order never seen, and words of usual letters, are worse than trusted text; in any script."""
    rng = random.Random(1)
    for words in ("the old river runs over a grey stone and into light", "старая река бежит через серый камень и дальше в свет"):
        w = words.split()
        follow = {a: rng.sample(w, 2) for a in w}

        def say():
            out = [rng.choice(w)]
            while len(out) < 60:
                out.append(rng.choice(follow[out[-1]]))
            return " ".join(out)

        texts = [(i, say(), "en") for i in range(200)]
        texts += [(300 + i, " ".join(rng.choice(w) for _ in range(60)), "en") for i in range(20)]
        # the first letters of one word and the last of another
        texts += [(400 + i, " ".join(rng.choice(w)[:2] + rng.choice(w)[-2:] for _ in range(60)), "en") for i in range(20)]
        labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
        docs = spark.createDataFrame(texts, SCHEMA)
        made = quality_words.quality_words(docs, labels).collect()
        kept = {r.doc_id: r.kept for r in made}
        assert sum(kept[i] for i in range(200)) >= 190
        assert not any(kept[i] for i in kept if i >= 300)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (None, None, None), (2, "", "x")], SCHEMA)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality_words.quality_words(docs.limit(0), labels).collect() == []
    free = quality_words.quality_words(docs, labels.limit(0)).collect()
    assert {(r.doc_id, r.perplexity, r.kept) for r in free} == {(1, 1.0, True), (None, None, False), (2, None, False)}
    # the other half is empty
    assert [r.kept for r in quality_words.quality_words(docs, labels).collect() if r.doc_id == 1] == [True]


def test_disk_of_one_pass(spark):
    """Shuffle files and stored tables at any time stay well below what all n-grams of all texts take."""
    rng = random.Random(5)
    texts = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 50_000}" for _ in range(1000)), "en") for i in range(1000)]
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    docs = spark.createDataFrame(texts, SCHEMA).repartition(4).cache()
    docs.count()
    folders = [quality_words.store.__globals__["shared_dir"](spark).removeprefix("file://"), *spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]

    def used():
        total = 0
        for folder in folders:
            for path, _, names in os.walk(folder):
                for name in names:
                    with contextlib.suppress(OSError):
                        total += os.path.getsize(f"{path}/{name}")
        return total

    before, most, done = used(), [0], threading.Event()

    def watch():
        while not done.wait(0.02):
            most[0] = max(most[0], used() - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        assert quality_words.quality_words(docs, labels).count() == len(texts)
    finally:
        done.set()
        watcher.join()
        docs.unpersist()
    # bytes of a million words
    assert most[0] < 6_000_000, most
