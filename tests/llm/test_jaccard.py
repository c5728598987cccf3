from __future__ import annotations

import re
from itertools import combinations

import pytest

from granary.llm import jaccard

from .conftest import clash, prose


def shingles(text, width=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, percent=85):
    """Class of every (id, text) by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, (_, s)), (b, (_, t)) in combinations(enumerate(sets), 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            root[find(a)] = find(b)
    low = {}
    for k, (i, s) in enumerate(sets):
        if s and i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(s), low.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)), key=str)


def joined(df):
    return jaccard.similarity_classes(df, width=4, percent=85)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_equals_brute_force(spark, some_docs):
    rows = [(r.doc_id, r.text) for r in some_docs.collect()]
    got = result(joined(some_docs))
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(got)


def test_chains_and_thresholds(spark):
    """Links at and just under the threshold, and chains whose ends do not link."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(24):
        words = list(base)
        for k in range(i):
            words[2 * k] = f"z{k}"
        rows.append((100 - i, " ".join(words)))
    rows += [(200 + i, " ".join(base[: 60 - i])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(joined(df)) == brute(rows)


def test_large_group_of_near_copies(spark):
    base = prose(1, 90).split()
    rows = []
    for i in range(150):
        words = list(base)
        for k in range(1 + i % 3):
            words[(11 * i + 29 * k) % 90] = f"edit{i}x{k}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(joined(df)) == brute(rows)


def test_one_id_for_several_texts(spark):
    """Rows of one id are rows of their own: each text links for itself."""
    a, b = prose(1, 80), prose(2, 80).split()
    rows = [(3, a), (7, a), (7, " ".join(b)), (9, " ".join([*b[:-1], "end"])), (7, a), (9, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(joined(df)) == brute(rows)


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert result(joined(clash(odd_docs, "n_shingles", "component_id", "cid", "token"))) == brute(rows)


def test_repeated_rows_ids_and_null_ids(spark):
    """A thousand repeats of a row, texts under one id, and rows without an id: each is linked by its own text."""
    a, b = prose(1, 120), " ".join([*prose(1, 119).split(), "end"])
    got = joined(spark.createDataFrame([(1, a)] * 1000 + [(2, b)] * 1000, "doc_id long, text string")).groupBy("doc_id", "component_id").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1000), (2, 1, 1000)]
    half = prose(2, 60)
    texts = [f"{half} {prose(100 + i, 60)}" for i in range(1000)] + [f"{half} {prose(100 + i, 60)} more" for i in range(0, 1000, 100)]
    for doc_id in (5, None):
        rows = [(doc_id, t) for t in texts] + [(6, texts[3])]
        got = joined(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id", "component_id").count().collect()
        # the copy of id 6 links with one row of the others: ids compare, so theirs is the class of that row alone where it is null
        expected = {(5, 5, 1010), (6, 5, 1)} if doc_id else {(None, None, 1009), (None, 6, 1), (6, 6, 1)}
        assert {tuple(r) for r in got} == expected


def test_empty(no_docs):
    assert joined(no_docs).collect() == []


@pytest.mark.parametrize(("n", "keep"), [(0, 0), (1, 1), (6, 1), (7, 2), (20, 4), (100, 16)])
def test_prefix_length(n, keep):
    assert jaccard.prefix_length(n, 85) == keep


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (20, 21)] + [(i, 100) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 230)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in (2, 3, 4)} == {1} and got[12] == got[11] == 10 and got[21] == 20
    assert all(got[i] == 100 for i in range(101, 140)) and all(got[i] == 200 for i in range(201, 231))
