"""The training-data operators against brute force, and on nulls, empty tables, ties and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from lectern.llm import decontamination, html_text, license_scan, line_dedup, near_dedup, packing, quality_lm, quality_rules, substring_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, row string, words string"


def table(spark, texts):
    """Documents with columns whose names clash with what operators make."""
    rows = [(i, t, "en", "s", len(t or ""), "x", "y", "z", "w") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    texts = ["\n".join(say(rng.randint(3, 30)) for _ in range(rng.randint(1, 8))) for _ in range(n)]
    shared, line = say(70), say(8)
    for k in range(0, n, 5):
        w = texts[k].split(" ")
        texts.append(" ".join(w[: len(w) // 2] + ["changed"] + w[len(w) // 2 :]))
    for k in range(1, n, 9):
        texts[k] = f"{line}\n{texts[k]} {shared} {say(3)}"
    texts += [texts[2], texts[2].upper(), "", " \n\t ", None, "one", "ONE", "two words", "ha " * 120, "x\x0by z\n\n\nx\x0by z"]
    return [(7 * i % 1009, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    return corpus()


def test_near_dedup(spark, texts):
    def grams(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    sets = {i: grams(t) for i, t in texts}
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and 100 * len(a & b) >= 85 * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    found = {r.doc_id: r for r in near_dedup.near_dedup(table(spark, texts), 3, 85).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in found.items()} == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_dedup_large_group_without_common_leader(spark):
    """A list of several components is compared in blocks; no link between them is lost."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for g in range(6):
        own = base[:60] + [f"g{g}x{k}" for k in range(60)]
        for _ in range(5):
            w = list(own)
            w[rng.randrange(100, 119)] = f"r{rng.random()}"
            texts.append((len(texts), " ".join(w)))
    found = near_dedup.near_dedup(table(spark, texts), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i // 5 * 5 for i, _ in texts}


def test_license_scan(spark):
    mit = license_scan.LICENSES["MIT"]
    changed = "Copyright (c) 2020 Somebody\n\n" + mit.replace("Software", "SOFTWARE").replace('"', "”").replace("sublicense", "sub-license")
    docs = [(1, mit), (2, changed), (3, mit + " and more"), (4, None), (5, ""), (6, "hello\nReleased under the MIT Licence!\nbye"), (7, "© all\n(c) x"), (1, "copyright")]
    got = sorted((r.doc_id, r.license or "", r.notices) for r in license_scan.license_scan(table(spark, docs)).collect())
    assert got == [(1, "", ""), (1, "MIT", ""), (2, "MIT", ""), (3, "", ""), (4, "", ""), (5, "", ""), (6, "", "MIT"), (7, "", "")]


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("a  b\n c", "a b c"),
        ("<p>a<p>b", "a\n\nb"),
        ("<ul><li>x<li>y<ol start=3><li>q<li>r</ol></ul>", "- x\n- y\n  3. q\n  4. r"),
        ("<table><tr><td>one<td>two<tr><td>three3<td>4</table>", "one     two\nthree3  4"),
        ("<table><td>a<td>b<table><tr><td>in</table>", "a  b in"),
        ("x<script>if (a<b) '</p>'</script>y<div hidden>no</div><div style='display: none'>no</div><!-- no -->z", "xyz"),
        ("<pre>k\n  l</pre>m", "k\n  l\n\nm"),
        ("a<br>b &amp; c &lt;d&gt; <b>e</b>f", "a\nb & c <d> ef"),
        ("</div></p>t<p>u</li>v", "t\n\nuv"),
        ("<title>no</title><a title='>'>link</a", "link"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("<div>" * 5000 + "deep", "deep"),
    ],
)
def test_html(source, text):
    assert html_text.html_to_text(source) == text


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", None), (2, "u", "b")], "page_id long, text string, html string")
    assert sorted(map(tuple, html_text.extract_text(pages).collect())) == [(1, ""), (1, "a"), (2, "b")]
    assert html_text.extract_text(pages.limit(0)).collect() == []


def test_toxicity(spark):
    rng = random.Random(1)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "house", "tree", "river"]
    texts, labels = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "STUPID!", "you moron", "m0r0n", "s.t.u.p.i.d", "loooser"]))
        texts.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    texts += [(1000, None), (1001, ""), (1, "again tree")]
    marks = spark.createDataFrame(labels + [(2, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(table(spark, texts), marks, learn_from=marks["doc_id"] < 200).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    hits = [r.predicted == int(r.doc_id % 4 == 0) for r in got if 200 <= r.doc_id < 400]
    assert sum(hits) / len(hits) > 0.97
    empty = toxicity.toxicity(table(spark, texts), marks.limit(0)).collect()
    assert {r.score for r in empty} == {0.0}
    assert toxicity.toxicity(table(spark, texts).limit(0), marks).collect() == []


def test_decontamination(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(2000)]
    say = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    items = [(k, " ".join(say(rng.randint(16, 60)))) for k in range(50)] + [(50, "three word item"), (51, None), (52, ""), (3, "é É x y z w")]
    docs, want = [], {}
    for d in range(120):
        w = say(rng.randint(20, 300))
        if d % 3 == 0:
            k = rng.randrange(50)
            leak = items[k][1].split()
            if len(leak) > 54:
                leak[len(leak) // 2] = "other"
            at = rng.randrange(len(w))
            w[at:at] = [x.upper() + "&&&" for x in leak]
            want[d] = [k]
        docs.append((d, " ".join(w)))
    docs += [(500, "Three, word ITEM!"), (501, "a three word item"), (502, None), (503, ""), (504, " ".join(items[5][1].split()[1:]))]
    want |= {500: [50], 504: [5]}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: list(r["items"]) for r in decontamination.decontaminate(table(spark, docs), bench).collect()}
    # near 80 in 100 the exact similarity decides
    runs = lambda w: collections.Counter({g: sum(map(len, g)) * n for g, n in collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)).items()})
    for d, t in docs:
        for k in got[d]:
            if k < 50 and d < 500:
                w, item = re.findall(r"\w+", t.lower()), items[k][1].split()
                assert any(100 * sum((runs(item) & runs(w[s : s + len(item)])).values()) >= 80 * sum((runs(item) | runs(w[s : s + len(item)])).values()) for s in range(max(1, len(w) - len(item) + 1)))
    exact = {d for d, k in want.items() if d >= 500 or len(items[k[0]][1].split()) <= 54}
    assert {d: got[d] for d in exact} == {d: want[d] for d in exact}
    assert all(got[d] == [] for d in got if d not in want)
    assert decontamination.decontaminate(table(spark, docs).limit(0), bench).collect() == []
    assert not any(r.contaminated for r in decontamination.decontaminate(table(spark, docs), bench.limit(0)).collect())


def test_simhash_search_misses_nothing():
    rng = random.Random(4)
    texts = [" ".join(str(rng.randrange(500)) for _ in range(20)) for _ in range(80)]
    index = decontamination.Index(list(range(80)), texts)
    import numpy as np

    probes = np.array([int(p) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 20))) for p in index.prints for _ in range(5)], np.uint64)
    window, item, far = index.within(20, probes)
    brute = {(i, j) for i, p in enumerate(probes) for j, q in enumerate(index.prints) if bin(int(p) ^ int(q)).count("1") <= decontamination.RADIUS}
    assert set(zip(window.tolist(), item.tolist(), strict=True)) == brute


def test_line_dedup(spark, texts):
    docs = sorted(dict(texts).items())
    seen, out = (set(), set()), {}
    for i, t in docs:
        lines = (t or "").split("\n")
        held = [k for k, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for p, k in enumerate(held):
            one = lines[k]
            two = (one, lines[held[p + 1]]) if p + 1 < len(held) else None
            if one in seen[0] and len(WORD.findall(one)) >= 5:
                gone.add(k)
            if two and two in seen[1]:
                gone |= {k, held[p + 1]}
            seen[0].add(one)
            if two:
                seen[1].add(two)
        kept = "" if held and len(gone) == len(held) else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out[i] = (len(held), len(gone), kept)
    got = line_dedup.line_dedup(table(spark, docs))
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in got.collect()} == out
    carried = line_dedup.line_dedup(table(spark, docs + docs[:1]), carry=True)
    assert carried.columns == SCHEMA.replace(" string", "").replace(" long", "").split(", ")
    assert carried.count() == sum(1 for n, g, _ in out.values() if not g or g < n) + 1
    assert line_dedup.line_dedup(table(spark, docs).limit(0)).collect() == []


def test_longest_run(spark):
    run = "\n".join(f"line number {k} of the run here" for k in range(21))
    docs = [(1, run), (2, "first\n" + run + "\nlast"), (3, "solo")]
    got = {r.doc_id: (r.n_removed, r.longest) for r in line_dedup.line_dedup(table(spark, docs)).collect()}
    assert got == {1: (0, 0), 2: (21, 21), 3: (0, 0)}


@pytest.mark.parametrize("window", [50, 7])
def test_substring_dedup(spark, texts, window):
    first = {}
    words = {i: WORD.findall(t or "") for i, t in texts}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    want = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        want[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    got = substring_dedup.substring_dedup(table(spark, texts), window, bucket_bytes=4000)
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got.collect()} == want
    assert substring_dedup.substring_dedup(table(spark, texts).limit(0), window).collect() == []


def test_packing(spark, texts):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    docs = [*texts, (5000, "a <|endoftext|> b"), (5001, "it's 1234  \n\n tab\tÜber ñ 漢字 " * 60)]
    got = packing.best_fit_packing(table(spark, docs), path, capacity=64).collect()
    ids = {i: np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in docs}
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for i, rows in pieces.items():
        rows.sort(key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(-(-len(ids[i]) // 64)))
        assert [r.start for r in rows] == [0, *np.cumsum([r.length for r in rows])[:-1].tolist()] and sum(r.length for r in rows) == len(ids[i])
        assert all(r.length == 64 for r in rows[1:]) and all(r.ids_crc32 == zlib.crc32(ids[i][r.start : r.start + r.length].tobytes()) for r in rows)
    for spots in places.values():
        end = 0
        for at, n in sorted(spots):
            assert at == end
            end += n
        assert end <= 64
    assert len(places) <= 1.03 * sum(map(len, ids.values())) / 64 + 1


def test_bounds_and_bins():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = rng.integers(1, 101, rng.integers(1, 200))
        bins = packing.best_fit_decreasing(lengths, 100)
        assert np.bincount(bins, weights=lengths).max() <= 100
        bound = packing.lower_bound(np.bincount(lengths, minlength=101), 100)
        assert -(-lengths.sum() // 100) <= bound <= bins.max() + 1


def test_quality_lm(spark):
    rng = random.Random(8)
    say = lambda: " ".join(rng.choice(["the", "river", "runs", "over", "stone", "and", "light"]) for _ in range(40)) + "."
    texts = [(i, say()) for i in range(200)] + [(300 + i, "".join(rng.choice("#*$%&|QXZ ") for _ in range(200))) for i in range(20)] + [(900, None), (901, "abc")]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 100)] + [(i, 0) for i in range(300, 310)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_lm.quality_lm(table(spark, texts), labels).collect()}
    assert all(not got[i].kept for i in got if i >= 300) and sum(got[i].kept for i in range(200)) >= 195
    assert got[900].perplexity is None and len(got) == len(texts)
    # brute force
    import math

    units = {i: [int(quality_lm._CLASS[b]) for b in (t or "").encode() if quality_lm._CLASS[b] != 255] for i, t in texts}
    count = collections.Counter(tuple(units[i][k : k + 4]) for i in range(100) for k in range(len(units[i]) - 3))
    tables = {4: count}
    for n in (3, 2, 1):
        tables[n] = collections.Counter(g[1:] for g in tables[n + 1])

    def discounts(c):
        n1, n2, n3, n4 = (sum(v == k for v in c.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        return [min(max(k + 1 - (k + 2) * y * b / a if a and b else 0.75 * (k + 1), 0.05), k + 0.95) for k, a, b in ((0, n1, n2), (1, n2, n3), (2, n3, n4))]

    cuts, contexts = {n: discounts(t) for n, t in tables.items()}, {}
    for n, t in tables.items():
        for g, c in t.items():
            x = contexts.setdefault(g[:-1] if n > 1 else (), {}).setdefault(n, [0, 0.0])
            x[0] += c
            x[1] += cuts[n][min(c, 3) - 1]

    def p(g, n):
        if n == 0:
            return 1 / 64
        lower = p(g[1:], n - 1)
        total = contexts.get(g[:-1], {}).get(n)
        c = tables[n].get(g, 0)
        return lower if not total else ((c - cuts[n][min(c, 3) - 1]) / total[0] if c else 0) + total[1] / total[0] * lower

    for i in (0, 150, 305):
        grams = [tuple(units[i][k : k + 4]) for k in range(len(units[i]) - 3)]
        want = math.exp(-sum(math.log(p(g, 4)) for g in grams) / len(grams))
        assert got[i].perplexity == pytest.approx(want, rel=1e-3)
    assert quality_lm.quality_lm(table(spark, texts).limit(0), labels).collect() == []
    free = quality_lm.quality_lm(table(spark, texts), labels.limit(0)).collect()
    assert {r.doc_id for r in free if not r.kept} == {900, 901}


def test_quality_rules(spark, texts):
    import math

    import xxhash

    labels = [(i, int(i % 3 > 0)) for i, _ in texts[:50]]
    got = quality_rules.quality_rules(table(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int"), buckets=64)
    found = {r.doc_id: r for r in got.collect()}
    assert len(found) == len(texts)
    good = {i for i, q in labels if q}
    low = lambda h: h - (1 << 64) if h >> 63 else h

    def buckets(w):
        one = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        two = [xxhash.xxh64_intdigest(y.encode(), h) for h, y in zip(one, w[1:], strict=False)]
        return [low(h) % 64 for h in one + two]

    words = {i: WORD.findall(t or "") for i, t in texts}
    raw = collections.Counter(b for w in words.values() for b in buckets(w))
    target = collections.Counter(b for i in good for b in buckets(words[i]))
    ratio = lambda b: math.log((target[b] + 1) / (sum(target.values()) + 64)) - math.log((raw[b] + 1) / (sum(raw.values()) + 64))
    for i, t in texts:
        w, r = words[i], found[i]
        seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        twice = {j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(twice))
        assert r.base_failed == (len(w) < 50 or 100 * len(twice) > 50 * len(w))
        want = sum(map(ratio, buckets(w))) / len(buckets(w)) if w else 0
        assert r.llr == pytest.approx(want, abs=1e-5) and r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)
    assert quality_rules.quality_rules(table(spark, texts).limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).collect() == []


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, d)
        made.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and now <= ids
        assert docs.columns == columns if k < 4 else now == {r.doc_id for r in before.collect()}
        ids = now


def test_sql_agrees(spark):
    import duckdb

    from lectern.llm import queries

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        ours, theirs = queries.QUERIES[name](spark, d).toPandas(), con.execute(sql).df()
        names = sorted(ours.columns)
        same = [x[names].sort_values("doc_id").astype(object).where(lambda y: y.notna(), None).astype(str).values.tolist() for x in (ours, theirs)]
        assert same[0] == same[1], name


def test_digest_columns(spark):
    from lectern.llm import queries

    d = "/root/testdata/sf0.001"
    found = queries.op7_substring_dedup(spark, d).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert len(found) == len(docs)
    assert all(r.kept_sha256 == hashlib.sha256(" ".join(WORD.findall(docs[r.doc_id] or "")).encode()).hexdigest() for r in found if not r.n_removed)
    held = queries.op4_toxicity(spark, d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)
