from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import decontaminate, language_id, quality_rules
from granary.llm.hashindex import HashIndex, Tally
from granary.llm.textarrays import ALNUM, SPACED, Texts, chunks

from .conftest import ODD, clash, prose


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- words and hashes


def test_words_match_regular_expressions():
    texts = [r[1] for r in ODD if r[1] != ODD[10][1]]
    for kind, pattern in ((SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = Texts(pa.array(texts)).words(kind)
        h = w.hashes()
        flat = [x for t in texts for x in re.findall(pattern, low(t))]
        assert w.counts.tolist() == [len(re.findall(pattern, low(t))) for t in texts]
        assert len({x: int(y) for x, y in zip(flat, h, strict=True)}) == len(set(h.tolist()))


def test_chunks_cover_all_rows():
    column = pa.array(["a" * n for n in (1, 50, 3, 200, 0, 7)] + [None])
    got = list(chunks(column, 60))
    assert got[0][0] == 0 and got[-1][1] == 7 and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))


def test_hash_index_and_tally():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    index = HashIndex(keys)
    assert (index.find(keys) == np.arange(len(keys))).all() and (index.find(keys + np.uint64(1))[: 10] == -1).all()
    assert HashIndex(keys[:0]).find(keys[:3]).tolist() == [-1] * 3
    t, parts = Tally(100), []
    for k in range(20):
        parts += [x for x in [t.add(np.arange(k, k + 30).astype(np.uint64))] if x]
    parts.append(t.take())
    assert sum(int(c.sum()) for _, c in parts) == 600


# -- decontamination


def brute_contamination(text, items, width=8):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words, hit, found = re.findall(pattern, low(text)), set(), set()
    for item, body in items:
        own = re.findall(pattern, low(body))
        if item is None or not own:
            continue
        k = min(width, len(own))
        for s in range(len(own) - k + 1):
            for i in range(len(words) - k + 1):
                if words[i : i + k] == own[s : s + k]:
                    hit |= set(range(i, i + k))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_contamination_equals_brute_force(spark, block_bytes):
    items = [(1, prose(50, 30)), (2, prose(51, 12)), (10, "The cat"), (11, "a"), (12, ""), (13, None), (None, prose(52, 20)), (2, prose(53, 9)), (14, prose(50, 30)), (15, "Ünïcode wörds only")]
    w1 = prose(50, 30).split()
    docs = [
        (1, "start " + prose(50, 30).upper() + " end " + prose(51, 12)),
        (2, " ".join(w1[5:13])),
        (3, " ".join(w1[5:12])),
        (4, "the,cat sat; THE-CAT thecat the cats"),
        (5, "ünïcode WÖRDS only, ünïcode wörds only"),
        (6, None),
        (7, ""),
        (8, "a b c a"),
        (8, "a b c a"),
        (9, prose(60, 400) + " " + prose(53, 9) + " " + prose(61, 300)),
    ]
    d = clash(spark.createDataFrame(docs, "doc_id long, text string"), "n_words", "n_hit", "items", "hit_start")
    got = decontaminate.item_digest(decontaminate.contamination(d, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)).collect()
    assert len(got) == len(docs)
    expected = {i: brute_contamination(t, items) for i, t in docs}
    for r in got:
        n, hit, names = expected[r.doc_id]
        assert (r.n_words, r.n_hit, r.items) == (n, hit, names)
        assert (r.n_items, r.contaminated) == (len(names), len(names) >= 2)
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert sum(e - s for s, e in zip(r.hit_start, r.hit_end, strict=True)) == hit


def test_contamination_odd_and_empty(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, prose(5, 120))], "item_id long, text string")
    got = {(r.doc_id, r.n_items) for r in decontaminate.item_digest(decontaminate.contamination(odd_docs, items)).collect()}
    assert {(905, 1), (906, 1), (900, 0), (901, 0), (None, 0)} <= got
    assert decontaminate.contamination(no_docs, items).collect() == []
    clean = decontaminate.contamination(odd_docs, items.limit(0)).collect()
    assert len(clean) == len(ODD) and all(r["items"] == [] for r in clean)


# -- quality rules


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)} if len(tri) < 3000 else None
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, None if again is None else len(again)


def test_quality_measures_equal_brute_force(spark, odd_docs):
    more = [(1, "a b c a b c\na b c\n\na b c\nx # $ % | <y> &*"), (2, prose(1, 200)), (3, (prose(2, 10) + "\n") * 20), (4, prose(1, 100) + " ### " * 60), (5, "- a\n* b\n• c...\nd…")]
    d = clash(odd_docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")), "n_words", "kept", "measures_")
    rows = quality_rules.apply_rules(d).collect()
    assert len(rows) == len(ODD) + len(more)
    for r in rows:
        n, chars, symbols, dup, again = brute_quality(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (n, chars, symbols, dup)
        if again is not None:
            assert r.n_repeat_words == again
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and (r.base_failed or r.failed_rules))
    kept = {r.doc_id: r.kept for r in rows}
    assert kept[2] and not kept[3] and not kept[4] and not kept[900]


def test_quality_plan_has_no_python(some_docs):
    plan = quality_rules.apply_rules(some_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "Exchange" not in plan
    kept = quality_rules.apply_rules(some_docs).where("kept").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert kept.count("n_repeat_words, ") == 1  # measured once, whatever is filtered


def test_quality_empty(no_docs):
    assert quality_rules.apply_rules(no_docs).collect() == []


# -- language identification


def test_language_held_out_accuracy(some_docs):
    held = language_id.held_out(F.col("doc_id"))
    found = language_id.identify(clash(some_docs, "lang_pred", "lang_guess_"), some_docs.where(~held)).withColumn("held", held).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert all(0 <= r.score <= 1 for r in found)
    test = [r for r in found if r.held]
    assert len(test) > 20 and sum(r.lang == r.lang_pred for r in test) / len(test) > 0.95


def test_language_reads_whole_texts(spark, some_docs):
    """The language of the longer, later part wins, and a text's score does not depend on its neighbours."""
    text = prose(1, 20, "fr") + " " + prose(2, 900, "de")
    one = language_id.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), some_docs).first()
    many = language_id.identify(some_docs.select("doc_id", "text").union(spark.createDataFrame([(999, text)], "doc_id long, text string")), some_docs).where("doc_id = 999").first()
    assert one.lang_pred == many.lang_pred == "de" and one.score == pytest.approx(many.score, abs=1e-6)


def test_language_odd_rows(spark, odd_docs, some_docs, no_docs):
    got = {(r.doc_id, r.text): r for r in language_id.identify(odd_docs, some_docs).collect()}
    for r in got.values():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    assert language_id.identify(no_docs, some_docs).collect() == []
    assert {r.lang_pred for r in language_id.identify(odd_docs, no_docs).collect()} == {"und"}


def test_network_predicts_what_it_learned_with():
    """The frozen tables give the responses of the trained ones."""
    net = language_id.ByteConvNet(language_id.Config(), ["a", "b"])
    x, doc, letters = language_id.windows(pa.array([prose(3, 300), "short", None, ""]), 256, net.halo)
    assert len(x) == len(doc) and set(doc) == {0, 1} and letters[-1] == 5
    plain = net._softmax(net._responses(x).max(axis=1))
    assert np.allclose(net.freeze().predict(x), plain, atol=1e-4)
