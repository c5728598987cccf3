"""The registered corpus queries against DuckDB, and the pipeline against a plain version."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import language_id, mixing
from granary.llm.queries import QUERIES, SQL

from ..sqlcompare import DATA, compare, connect
from .conftest import ODD, SCHEMA, prose
from .test_jaccard import shingles
from .test_text_operators import brute_contamination, brute_quality

needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    compare(spark, connect(), QUERIES[name], SQL[name])


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def near_duplicates(rows, width=5, percent=80):
    sets = {r[0]: shingles(r[1], width) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [r for r in rows if find(r[0]) == r[0]]


def taken(rows):
    sizes, by = {}, {}
    for r in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
        sizes[r[3]] = sizes.get(r[3], 0) + n
        by.setdefault(r[3], []).append((n, r[0]))
    goal, out = mixing.targets(list(sizes.items()), (5, 2, 1), 3), []
    for s, own in by.items():
        per, u = goal[s] / sizes[s], mixing.offset(s, 11)
        for k, (_, i) in enumerate(sorted(own)):
            out += [i] * (math.floor((k + 1) * per + u) - math.floor(k * per + u))
    return sorted(out)


def test_pipeline_equals_plain_version(spark, some_docs, tmp_path):
    passage = prose(77, 25)
    rows = [tuple(r) for r in some_docs.collect()]
    rows += [(300 + i, prose(300 + i, 60) + " " + passage + " " + prose(400 + i, 40), "en", "s1", 1) for i in range(4)]
    rows += [(400, prose(1, 80).upper() + " $$$" * 60, "en", "s0", 1), (401, "too short", "en", "s0", 1), (402, "12345 " * 80, "en", "s0", 1)]
    rows += [r for r in ODD if r[0] in (900, 901, 902, 906, 909)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, prose(1, 9)[:3])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    found = language_id.identify(docs, docs.where("doc_id is not null").where(~language_id.held_out(docs["doc_id"])))
    sure = {r.doc_id for r in found.collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.MIN_LANGUAGE_SCORE}
    kept = [r for r in rows if r[0] in sure]
    got = corpus_pipeline.identify_language(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in kept) and got.columns == docs.columns
    assert 402 not in sure and 900 not in sure

    good = {r.doc_id for r in corpus_pipeline.apply_quality_rules(spark, got, str(tmp_path)).collect()}
    for r in kept:
        n, _, symbols, _, again = brute_quality(r[1])
        if n < 50 or 2 * again > n or symbols > 0.2 * n:
            assert r[0] not in good
    kept = [r for r in kept if r[0] in good]
    assert 400 not in good and 401 not in good and {300, 301} <= good

    kept = near_duplicates(kept)
    items = [(1, passage), (2, prose(1, 9)[:3])]
    kept = [r for r in kept if not brute_contamination(r[1], items)[2]]
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in final.collect()) == taken(kept)
    assert not {300, 301, 302, 303} & {r.doc_id for r in final.collect()}


def test_pipeline_with_repeated_rows_and_no_rows(spark, odd_docs, no_docs, tmp_path):
    got = corpus_pipeline.remove_near_duplicates(spark, odd_docs, str(tmp_path)).collect()
    assert [r.doc_id for r in got].count(905) == 1 and 906 not in [r.doc_id for r in got] and len(got) == len(ODD) - 2
    assert corpus_pipeline.remove_near_duplicates(spark, no_docs, str(tmp_path)).collect() == []
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "ngram_jaccard", "decontamination", "mixing"]


def test_near_duplicates_are_decided_by_row(spark, tmp_path):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    near = a.split()
    near[7] = "changed"
    # 2: a near copy of 1, and a text of its own; 3: two texts and a repeated row; 4: blank rows
    rows = [(1, a), (2, " ".join(near)), (2, b), (3, c), (3, c), (3, prose(4, 80)), (4, ""), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = corpus_pipeline.remove_near_duplicates(spark, docs, str(tmp_path)).collect()
    expected = [(1, a), (2, b), (3, c), (3, prose(4, 80)), (4, ""), (4, None)]
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted((i, t or "") for i, t in expected)


def test_very_long_clean_documents_stay(spark, tmp_path):
    text = " ".join("the" if i % 5 == 0 else f"word{i}" for i in range(200_100))
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (2, "too short", "en", "s", 1)], SCHEMA)
    assert [r.doc_id for r in corpus_pipeline.apply_quality_rules(spark, docs, str(tmp_path)).collect()] == [1]


def test_pipeline_keeps_clashing_columns_and_all_odd_rows(spark, odd_docs, tmp_path):
    """No stage replaces a column of the documents, whatever its name, and every odd row has its defined end."""
    names = ("score", "lang_pred", "kept", "n_words", "items", "n_hit", "leads", "text_hash", "id", "hash", "id_", "cid", "granary_guess", "base_failed", "measures_")
    docs = odd_docs.withColumns({n: F.lit(f"own {n}") for n in names})
    spark.createDataFrame([(1, "no such passage in any of these")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        rows = out.collect()
        assert all(r[n] == f"own {n}" for r in rows for n in names) and {r.doc_id for r in rows} <= {r[0] for r in ODD}
        ids = [r.doc_id for r in rows]
        if name == "ngram_jaccard":  # of 905, 905 and 906 one row stays, blank rows all
            assert ids.count(905) == 1 and 906 not in ids and len(ids) == len(ODD) - 2
        if name == "decontamination":
            assert len(ids) == len(ODD)
        if name == "quality_rules":
            assert 907 in ids and 908 not in ids and ids.count(905) == 2
    mixed = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    assert set(names) <= set(mixed.columns) and all(r[n] == f"own {n}" for r in mixed.collect() for n in names)


def test_near_duplicates_of_null_ids(spark, tmp_path):
    a, b = prose(1, 80), prose(2, 80)
    rows = [(None, a), (None, a), (4, a + " end"), (None, b), (None, b + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.remove_near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert (4, a + " end") in got and len(got) == 2 and got[0] != got[1]
