"""Line dedup against brute force: sources, exact run lengths, deleted lines, long texts."""

import random
import time

import pytest

from lectern.llm.line_dedup import line_dedup, line_ids, maximal_runs, suffix_ranks


def brute(docs: list[tuple[int, list[str]]], min_lines: int, min_words: int):
    """(deleted lines of each document, its longest run) from all pairs of suffixes."""
    places = [(d, p) for d, lines in docs for p in range(len(lines))]
    lines = dict(docs)

    def shared(a, b):
        n = 0
        x, y = lines[a[0]][a[1] :], lines[b[0]][b[1] :]
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    gone, longest = {d: set() for d, _ in docs}, dict.fromkeys(lines, 0)
    for at in places:
        earlier = [(x, n) for x in places if x < at and (n := shared(x, at))]
        if not earlier:
            continue
        level = 1 << (max(n for _, n in earlier).bit_length() - 1)
        run = next(n for x, n in sorted(earlier) if n >= level)
        if run >= min_lines:
            gone[at[0]] |= set(range(at[1], at[1] + run))
            longest[at[0]] = max(longest[at[0]], run)
        if len(lines[at[0]][at[1]].split()) >= min_words:
            gone[at[0]].add(at[1])
            longest[at[0]] = max(longest[at[0]], 1)
    return gone, longest


@pytest.mark.parametrize(("seed", "min_lines"), [(1, 2), (2, 4)])
def test_brute_force(spark, seed, min_lines):
    rng = random.Random(seed)
    kinds = ["a", "b", "c d e f g", "h", "i j k l m n"]
    docs = [(i, [rng.choice(kinds) for _ in range(rng.randint(0, 14))]) for i in range(9)]
    docs += [(20, docs[3][1]), (21, docs[3][1] + ["z"] + docs[4][1]), (22, ["a"] * 13), (23, ["a"] * 6)]
    gone, longest = brute(docs, min_lines, 5)
    # blank lines are no part of a sequence
    rows = [(d, "\n".join(f"{x}\n " if i % 3 == 0 else x for i, x in enumerate(lines))) for d, lines in docs]
    found = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_lines).collect()}
    for d, lines in docs:
        assert found[d]["n_lines"] == len(lines)
        assert found[d]["n_removed"] == len(gone[d]), d
        assert found[d]["longest"] == longest[d], d
        kept = [x for i, x in enumerate(lines) if i not in gone[d]]
        assert [x for x in found[d]["text"].split("\n") if x.strip()] == kept


def test_maximal_runs_are_exact(spark):
    text = "\n".join(f"line {i}" for i in range(11))
    docs = spark.createDataFrame([(1, text), (2, "new\n" + text + "\nend"), (3, "x\nline 4\nline 5\nline 6\ny")], "doc_id long, text string")
    runs = maximal_runs(suffix_ranks(line_ids(docs)))
    assert sorted((r["doc"], r["pos"], r["length"], r["source"]["doc"], r["source"]["pos"]) for r in runs.collect()) == [(2, 1, 11, 1, 0), (3, 1, 3, 1, 4)]


def test_ranks_follow_the_order_of_suffixes(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nb\nc\nd\nb\nc"), (2, "b\nc\nd")], "doc_id long, text string")
    rounds = suffix_ranks(line_ids(docs))
    first = {(r["doc"], r["pos"]): r["rank"] for r in rounds[0].collect()}
    pairs = sorted(((first[r["doc"], r["pos"]], first[r["doc"], r["pos"] + 1]), r["rank"]) for r in rounds[1].collect())
    assert [x for _, x in pairs] == sorted(x for _, x in pairs)
    assert len({x for x, _ in pairs}) == len({x for _, x in pairs}) == 2


def test_edges(spark):
    same = "one two three four five\nsix"
    rows = [(None, same, 1), (5, same, 2), (5, same, 3), (6, None, 4), (7, "", 5), (8, "\n \n", 6), (9, "six\nx", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone int")
    found = sorted(tuple(r) for r in line_dedup(docs).fillna(-1, "doc_id").collect())
    assert found == [(-1, 2, 0, 0, same), (5, 2, 2, 2, ""), (5, 2, 2, 2, ""), (6, 0, 0, 0, ""), (7, 0, 0, 0, ""), (8, 0, 0, 0, "\n \n"), (9, 2, 0, 0, "six\nx")]
    kept = line_dedup(docs, carry=True)
    assert kept.columns == docs.columns
    assert sorted(r["gone"] for r in kept.collect()) == [1, 4, 5, 6, 7]
    assert line_dedup(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="power"):
        line_dedup(docs, 3)


def test_long_text_takes_linear_time(spark):
    long = "\n".join(f"row {i} of a long text" for i in range(10_000))
    docs = spark.createDataFrame([(1, "a b c d e"), (2, long + "\na b c d e\n" + long), (3, "a\n" * 5_000)], "doc_id long, text string")
    start = time.time()
    found = {r["doc_id"]: r for r in line_dedup(docs).collect()}
    assert time.time() - start < 120
    assert (found[2]["n_lines"], found[2]["n_removed"], found[2]["longest"]) == (20_001, 10_001, 10_000)
    assert found[2]["text"] == long
    assert (found[3]["n_removed"], found[3]["longest"]) == (4_999, 4_999)
