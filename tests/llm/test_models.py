from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import bloom_lm, chat_format, kneser_ney, mixing, token_histogram, url_reputation

from .conftest import ODD, clash, prose

WORD = r"[^\x20\x09-\x0D]+"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- url reputation


def test_host_and_path(spark):
    urls = {
        None: ("", ""),
        "no scheme": ("", ""),
        "http://Ex.COM/a/b?q#f": ("ex.com", "/a/b"),
        "x://É.com#f/g": ("É.com", ""),
        "https://a.b?x=/y": ("a.b", ""),
        "http://a/b\nc?d": ("a", "/b\nc"),
        "a://b://c/d": ("b:", "//c/d"),
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    host, path = url_reputation.host_and_path(F.col("url"))
    assert {r.url: (r.h, r.p) for r in df.select("url", host.alias("h"), path.alias("p")).collect()} == urls


def test_rules_and_reputation(spark):
    rules = [url_reputation.UrlRule(v, r) for v, r in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/"))]
    pages = [(1, "http://a.example.com/en/71"), (2, "http://example.com/en/8"), (3, "http://x.net/"), (4, "http://notexample.com/en/7"), (5, "http://com/en/"), (6, "http://q.org/en/7"), (6, "http://q.org/en/7"), (7, None)]
    df = clash(spark.createDataFrame(pages, "page_id long, url string"), "host", "rule", "good_mean")
    got = sorted((r.page_id, r.rule, r.verdict) for r in url_reputation.judge(df, spark.createDataFrame([], "page_id long, good boolean"), rules).select("page_id", F.coalesce("rule", F.lit("")).alias("rule"), "verdict").collect())
    assert got == [(1, "example.com/en/7", "allow"), (2, "com/en/", "block"), (3, "net/", "allow"), (4, "com/en/", "block"), (5, "com/en/", "block"), (6, "", "allow"), (6, "", "allow"), (7, "", "allow")]


def test_bad_hosts_are_blocked_and_small_ones_shrunk(spark):
    pages, outcomes = [], []
    for i in range(400):
        host = ("good.site.com", "bad.farm.org", "fine.site.com", "other.place.net")[i % 4]
        pages.append((i, f"http://{host}/{i}"))
        outcomes.append((i, host != "bad.farm.org" or i % 20 == 1))
    pages += [(1000, "http://new.farm.org/"), (1001, "http://new.site.com/"), (1002, "http://one.site.com/x")]
    outcomes += [(1002, False), (5, None), (None, True)]
    got = {r.page_id: r for r in url_reputation.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, good boolean")).collect()}
    assert got[1].verdict == "block" and got[0].verdict == got[1002].verdict == got[1001].verdict == "allow"
    assert got[1].good_mean < 0.3 < got[1002].good_mean < got[0].good_mean <= 1
    assert got[1000].good_mean < got[1001].good_mean and got[1000].n_labelled == 0
    plan = url_reputation.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, good boolean"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian", plan)


def test_registered_domains(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "x.shop.com.sg": ("shop.com.sg", "com.sg"), "www.kem.go.id": ("kem.go.id", "go.id"), "u@h.site.de:80": ("site.de", "de"), "1.2.3.4": ("1.2.3.4", ""), "localhost": ("localhost", "localhost"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = url_reputation.registered(F.col("host"))
    assert {r.host: (r.d, r.s) for r in df.select("host", domain.alias("d"), suffix.alias("s")).collect()} == hosts


def test_very_long_urls(spark):
    long = "http://" + "a" * 100_000 + ".com/" + "p" * 200_000 + "?" + "q" * 100_000
    pages = spark.createDataFrame([(1, long), (1, long), (2, "://"), (None, long)], "page_id long, url string")
    got = url_reputation.judge(pages, spark.createDataFrame([(1, True), (None, False)], "page_id long, good boolean")).collect()
    assert len(got) == 4 and sorted(len(r.host) for r in got) == [0, 100_004, 100_004, 100_004] and {len(r.path) for r in got} == {0, 200_001}
    assert {r.n_labelled for r in got if r.host} == {2}


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_reputation.judge(none, spark.createDataFrame([(1, True)], "page_id long, good boolean")).collect() == []


# -- mixing


def brute_targets(sizes, weights, most):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: w[s] * left / sum(w[x] for x in free) for s in free} if free else {}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 40}, {"x": 7}, {"a": 0, "b": 10}, {"a": 0}, {chr(97 + i): (i * 37) % 101 for i in range(20)}])
def test_targets(sizes):
    got = mixing.targets(list(sizes.items()), (5, 2, 1), 3)
    assert got == pytest.approx(brute_targets(sizes, (5, 2, 1), 3))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix(spark, some_docs, odd_docs):
    docs = some_docs.unionByName(odd_docs)
    got = mixing.mix(clash(docs, "size", "target", "taken")).collect()
    assert len(got) == docs.count()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda rows: sorted((str(r.doc_id), str(r.source), r.size, r.copies) for r in rows)
    assert key(got) == key(again)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * max(r.size for r in own) + 1
        assert all(r.taken <= 3 * r.size for r in own)
    odd = clash(docs, "copies", "size", "nth", "row", "target")
    texts = mixing.mixed_documents(odd)
    assert texts.count() == sum(r.copies for r in got) and texts.columns == [*odd.columns, "copy_no"]


def test_mix_empty(no_docs):
    assert mixing.mix(no_docs).collect() == [] and mixing.mixed_documents(no_docs).collect() == []


# -- Kneser-Ney


def brute_kn(texts, order):
    """Interpolated modified Kneser-Ney over bytes, straight from the definitions."""
    grams = Counter()
    for t in texts:
        b = b"\n" * (order - 1) + (t or "").encode() + bytes([kneser_ney.END])
        grams.update(b[i : i + order] for i in range(len(b) - order + 1))
    levels = {order: dict(grams)}
    for n in range(order - 1, 0, -1):
        levels[n] = dict(Counter(g[1:] for g in levels[n + 1]))
    rules = {}
    for n, counts in levels.items():
        c = Counter(counts.values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0.5
        d = [k - (k + 1) * y * (c[k + 1] / c[k] if c[k] else 0.5) for k in (1, 2, 3)]
        rules[n] = [min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True)]
    follow = {}
    for n, counts in levels.items():
        for g, c in counts.items():
            follow.setdefault(g[:-1] if n else b"", {}).setdefault(n, Counter())[g[-1:]] = c

    def p(ctx, w):
        n = len(ctx) + 1
        below = p(ctx[1:], w) if ctx else 1 / 256
        known = follow.get(ctx, {}).get(n)
        if not known:
            return below
        total, d = sum(known.values()), rules[n]
        cut = lambda c: d[min(c, 3) - 1] if c else 0
        c = known.get(w, 0)
        return (c - cut(c)) / total + sum(cut(x) for x in known.values()) / total * below

    return p


def test_kneser_ney_equals_the_definition(spark):
    train = [prose(i, 40) for i in range(6)] + [None, "Ünï"]
    test = [prose(100, 30), prose(2, 40), "", "ZZZ 123 é", None, "a"]
    order = 4
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in train], "text string"), order)
    docs = spark.createDataFrame(list(enumerate(test)), "doc_id long, text string")
    p = brute_kn(train, order)
    for shard, block in ((1 << 20, 1 << 20), (50, 60)):
        got = {r.doc_id: r for r in kneser_ney.perplexity(docs, model, order, shard, block).collect()}
        for i, t in enumerate(test):
            b = b"\n" * (order - 1) + (t or "").encode() + bytes([kneser_ney.END])
            expected = sum(math.log10(p(b[k : k + order - 1], b[k + order - 1 : k + order])) for k in range(len(b) - order + 1))
            assert got[i].log10_p == pytest.approx(expected, rel=1e-4) and (got[i].perplexity is None) == (not t)


def shuffled(spark, run):
    """The largest number of bytes that a stage of ``run()`` has shuffled."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    ids = lambda x: [x.apply(i) for i in range(x.size())]
    before = max((x.stageId() for x in ids(stages())), default=-1)
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return max(x.shuffleWriteBytes() for x in ids(stages()) if x.stageId() > before)


def test_texts_meet_their_answers_in_waves(spark):
    rng = np.random.default_rng(3)
    # one bit a letter and 8 different n-grams: nothing stores or moves a text in less than an eighth of its size
    texts = [rng.choice(np.frombuffer(b"ab", np.uint8), 20_000).tobytes().decode() for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = kneser_ney.train(docs.where("doc_id < 3"), 3)
    got = {}

    def run():
        got.update((r.doc_id, r.n_symbols) for r in kneser_ney.perplexity(docs, model, 3, block_bytes=60_000).collect())

    most = shuffled(spark, run)
    assert got == {i: 20_001 for i in range(120)}
    assert most < 120 * 20_000 / 8 / 2


def test_probabilities_sum_to_one(spark):
    p = brute_kn([prose(i, 40) for i in range(4)], 3)
    assert sum(p(b"th", bytes([w])) for w in range(256)) == pytest.approx(1, abs=1e-9)


def test_classifier(spark, some_docs, odd_docs, no_docs):
    docs = some_docs.unionByName(odd_docs)
    noise = spark.createDataFrame([(2000 + i, "".join(chr(33 + (7 * i * k) % 90) for k in range(300)), "en", "n", 1) for i in range(5)], some_docs.schema)
    trusted = some_docs.where("doc_id < 110").select("doc_id")
    got = kneser_ney.classify(clash(docs.unionByName(noise), "kept", "trusted"), trusted).collect()
    assert len(got) == docs.count() + 5
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[2000 + i] for i in range(5)) and not kept[900] and not kept[901]
    assert sum(kept[i] for i in range(120)) >= 110
    assert kneser_ney.classify(no_docs, trusted).collect() == []
    assert len(kneser_ney.classify(odd_docs, trusted.limit(0)).collect()) == len(ODD)


def test_thresholds_and_kept_equal_brute_force(spark, some_docs, odd_docs):
    """From the perplexities: medians and median deviations of each language's held-out trusted rows."""
    docs = some_docs.unionByName(odd_docs)
    trusted = [r.doc_id for r in docs.where("doc_id < 118").collect()]
    got = kneser_ney.classify(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), calibration_parts=2, least_calibrated=12).collect()
    lower = lambda x: sorted(x)[math.ceil(len(x) / 2) - 1]

    def cut(rows):
        mid = lower([r.perplexity for r in rows])
        return mid + 6 * 1.4826 * lower([abs(r.perplexity - mid) for r in rows])

    held = [r for r in got if r.doc_id in trusted and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and r.perplexity is not None]
    by_lang = {}
    for r in held:
        by_lang.setdefault(r.lang, []).append(r)
    limits = {k: cut(v) for k, v in by_lang.items() if k is not None and len(v) >= 12}
    assert 1 <= len(limits) and len({r.lang for r in got}) > len(limits)
    for r in got:
        assert r.threshold == pytest.approx(limits.get(r.lang, cut(held)), rel=1e-9)
        assert r.kept == (r.perplexity is not None and r.perplexity <= r.threshold) and r.trusted == (r.doc_id in trusted)


def test_odd_trusted_documents_do_not_let_junk_pass(spark, some_docs):
    rows = [(i, prose(i, 120), "en", "s", 1) for i in range(300)]
    odd = [i for i in range(300, 400) if zlib.crc32(str(i).encode()) % 5 == 0][:2]  # these calibrate
    rows += [(i, "".join(chr(33 + (7 * i * k) % 90) for k in range(1, 300)), "en", "s", 1) for i in odd]
    junk = ["zebra " * 100, "BUY now BUY " * 60, " | ".join(f"{37 * k % 101};{k}" for k in range(90)), "a b c d " * 60]
    docs = spark.createDataFrame(rows + [(1000 + i, t, "en", "s", 1) for i, t in enumerate(junk)], some_docs.schema)
    got = {r.doc_id: r for r in kneser_ney.classify(docs, docs.where("doc_id < 1000").select("doc_id")).collect()}
    assert not any(got[1000 + i].kept for i in range(len(junk))) and not any(got[i].kept for i in odd)
    assert sum(got[i].kept for i in range(300)) >= 290


# -- Bloom language model


def test_lm_base_score_is_exact(spark, some_docs, odd_docs):
    docs = some_docs.unionByName(odd_docs).select("doc_id", "text")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    small = bloom_lm.Config(table_words=40, share_bytes=1000, block_bytes=3000)
    for config in (None, small):
        got = bloom_lm.score(clash(docs, "score", "rid", "base"), docs.where(rest != 0), config).collect()
        words = lambda t: [*re.findall(WORD, low(t)), None]
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        c = Counter(w for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10 for w in words(t))
        n, v = sum(c.values()), len(c)
        expected = sorted((str(i), len(words(t)), sum(c[w] > 0 for w in words(t)), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), 3)) for i, t in rows)
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 3)) for r in got) == expected
        assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)


def test_lm_prefers_its_own_kind(spark):
    train = spark.createDataFrame([(prose(i, 200),) for i in range(40)], "text string")
    docs = spark.createDataFrame([(1, prose(500, 100)), (2, " ".join(reversed(prose(500, 100, "fr").split())))], "doc_id long, text string")
    got = {r.doc_id: r.score / r.n_tokens for r in bloom_lm.score(docs, train).collect()}
    assert got[1] > got[2] + 0.3


def test_filter_reads_counts_back():
    rng = np.random.default_rng(1)
    counts = np.concatenate([rng.integers(1, 4, 5000), [5, 40, 1000, 10**6]])
    keys = bloom_lm.mix(np.arange(1, 1 + len(counts)).astype(np.uint64))
    config = bloom_lm.Config(bits_per_key=200)
    q = bloom_lm.levels_of(counts, config.base)
    f = bloom_lm.filled(keys, q, config)
    assert (f.levels(keys) >= q).all() and (f.levels(keys) == q).mean() > 0.99
    got = bloom_lm.middles(config.base)[q]
    assert (got[counts <= 3] == counts[counts <= 3]).all() and (got >= counts / 1.3).all() and (got <= counts * 1.3).all()
    assert (f.levels(keys + np.uint64(1)) > 0).mean() < 0.01
    assert not bloom_lm.filled(keys[:0], q[:0], config).levels(keys).any()


def test_packed_keys_and_counts():
    keys = np.sort(bloom_lm.mix(np.arange(1000).astype(np.uint64)))
    assert (bloom_lm._unpacked(bloom_lm._packed(keys)) == keys & bloom_lm._LOW).all()
    counts = np.array([1, 255, 256, 700, 10**6, 2])
    k, c = bloom_lm._small(keys[:6], counts)
    k, c = bloom_lm._merged([k], [c.astype(np.int64)])
    assert (k == keys[:6]).all() and (c == counts).all()
    share, first, last = bloom_lm._bounds(keys, 7)
    assert share.tolist() == list(range(7)) and first[0] == 0 and last[-1] == 1000 and (first[1:] == last[:-1]).all()


def test_lm_empty(no_docs, odd_docs):
    docs = odd_docs.select("doc_id", "text")
    assert bloom_lm.score(no_docs.select("doc_id", "text"), docs).collect() == []
    got = bloom_lm.score(docs, no_docs).collect()
    assert len(got) == len(ODD) and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)


def counts_of(train):
    tokens = lambda t: [*re.findall(WORD, low(t)), None]
    words, pairs = Counter(), Counter()
    for t in train:
        ws = tokens(t)
        words.update(ws)
        pairs.update(zip(["begin", *ws], ws, strict=False))
    return words, pairs, len(train)


def brute_lm(words, pairs, n_texts, test, delta=0.1, base=1.5):
    """The definition's scores of ``test`` from all words and bigrams, with counts to the mean of their level."""
    tokens = lambda t: [*re.findall(WORD, low(t)), None]

    def level(c):
        same = [x for x in range(1, 2 * c + 2) if int(math.log(x) / math.log(base) + 1e-9) == int(math.log(c) / math.log(base) + 1e-9)] if c else []
        return (same[0] + same[-1]) / 2 if c else 0

    means = {c: level(c) for c in {0, *pairs.values()} if c < 10_000}
    mass = sum(words.values()) + delta * (len(words) + 1)

    def p(h, w):
        ahead = n_texts if h == "begin" else words[h]
        low = (words[w] + delta) / mass
        t = 2.0 * ahead**0.75
        return (min(means[pairs[h, w]], ahead, words[w]) + t * low) / (ahead + t) if ahead else low

    return [sum(math.log10(p(h, w)) for h, w in zip(["begin", *tokens(t)], tokens(t), strict=False)) for t in test]


def test_lm_tells_all_words_apart(spark):
    train = [prose(i, 150) for i in range(20)] + [f"begin{i} rare{i} word{i}" for i in range(300)] * 2
    test = [prose(100, 80), *(f"begin{i} rare{i} word{i}" for i in range(0, 300, 10)), "begin1 word2 rare3", "never seen", ""]
    expected = brute_lm(*counts_of(train), test)
    docs = spark.createDataFrame(list(enumerate(test)), "doc_id long, text string")
    texts = spark.createDataFrame([(t,) for t in train], "text string")
    # few false hits: the filter is given room
    for config in (bloom_lm.Config(bits_per_key=200), bloom_lm.Config(table_words=30, bits_per_key=200, share_bytes=500, block_bytes=300), bloom_lm.Config(table_words=0, bits_per_key=200)):
        got = {r.doc_id: r.score for r in bloom_lm.score(docs, texts, config).collect()}
        assert [got[i] for i in range(len(test))] == pytest.approx(expected, abs=2e-3)


def test_lm_probabilities_sum_to_one():
    train = [prose(i, 12) for i in range(6)]
    words, pairs, n_texts = counts_of(train)
    model = bloom_lm.Model(bloom_lm.Config(), 1, sum(words.values()), len(words), n_texts, None, None)
    for h in ["begin", *[w for w in words if w]]:
        ahead = n_texts if h == "begin" else words[h]
        c = np.array([*words.values(), 0], float)  # and all that is unknown
        found = np.array([*(pairs[h, w] for w in words), 0], float)
        logs = bloom_lm.log_probability(found, c, np.full(len(c), float(ahead)), model)
        assert np.power(10, logs).sum() == pytest.approx(1, abs=1e-9)


def test_lm_keeps_single_bigrams_of_large_input(spark):
    """Over 2**24 training tokens a bigram of count 1 is still known, and its text scores by the definition."""
    many = spark.range(0, 340, 1, 4).select(F.repeat(F.lit("a "), 50_000).alias("text"))
    train = many.unionByName(spark.createDataFrame([("single words here",)], "text string"))
    words, pairs, _ = counts_of(["single words here"])
    words.update({"a": 17_000_000, None: 340})
    pairs.update({("begin", "a"): 340, ("a", "a"): 16_999_660, ("a", None): 340})
    docs = spark.createDataFrame([(1, "single words here"), (2, "here words single")], "doc_id long, text string")
    got = {r.doc_id: r for r in bloom_lm.score(docs, train, bloom_lm.Config(bits_per_key=200)).collect()}
    assert got[1].train_tokens > 1 << 24
    expected = brute_lm(words, pairs, 341, ["single words here", "here words single"])
    assert [got[1].score, got[2].score] == pytest.approx(expected, abs=2e-3) and got[1].score > got[2].score + 3


def test_lm_with_repeated_and_very_long_texts(spark):
    long = prose(9, 60_000)
    rows = [(1, long), (2, "a b"), (2, "a b"), (None, None)] + [(i, prose(i, 30)) for i in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = bloom_lm.score(docs, docs, bloom_lm.Config(block_bytes=2000, share_bytes=4000, bits_per_key=200)).collect()
    expected = brute_lm(*counts_of([t for _, t in rows]), [t for _, t in rows])
    by_id = lambda pairs: [x for _, x in sorted(pairs)]
    assert by_id((str(r.doc_id), r.score) for r in got) == pytest.approx(by_id((str(i), x) for (i, _), x in zip(rows, expected, strict=True)), rel=1e-3)
    assert [r.score for r in got if r.doc_id == 2] == [got[[r.doc_id for r in got].index(2)].score] * 2


# -- chat


def test_transcripts_and_missing_roles(spark):
    rows = [
        (1, 0, None, "System: be nice\nUser: hi there\nhow are you?\nAssistant: fine\n- one\n- two"),
        (2, 0, "human", "x"),
        (2, 1, "gpt", None),
        (2, 1, "gpt", None),
        (3, 0, "USER", "### Human: q\n### Assistant: a"),
        (None, None, None, ""),
    ]
    df = clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "messages", "line", "state")
    got = sorted(((str(r.conv_id), str(r.turn), [(m.role, m.content) for m in r.messages]) for r in chat_format.canonical(df).collect()), key=str)
    assert got[0][2] == [("system", "be nice"), ("user", "hi there\nhow are you?"), ("assistant", "fine\n- one\n- two")]
    assert got[1][2] == [("user", "x")] and got[2][2] == got[3][2] == [("assistant", "")]
    assert got[4][2] == [("user", "q"), ("assistant", "a")] and len(got) == 6
    one = chat_format.canonical(df).where("conv_id = 2 and turn = 0").first().rendered
    assert one == "<|user|>\nx\n<|end|>\n"


def test_long_conversation_over_many_parts(spark):
    """A conversation that no task sees whole is decoded as one that is."""
    rng = np.random.default_rng(3)
    rows, true = [], []
    for t in range(300):
        role = "user" if t % 2 == 0 else "assistant"
        true.append(role)
        rows.append((7, t, role if rng.random() < 0.3 else None, "why?" if role == "user" else "\n".join(["long answer " * 8] * 4)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def roles(partitions):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            return [r.r for r in chat_format.canonical(df).orderBy("turn").select(F.col("messages")[0]["role"].alias("r")).collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

    whole = roles("1")
    assert roles("9") == whole and sum(a == b for a, b in zip(whole, true, strict=True)) > 290


def viterbi(scores, opens, start, steps):
    """The plain algorithm, one line after the other; ties go to the lower state."""
    row, back = [int(start[j] + scores[0][j]) for j in range(3)], []
    for e, o in zip(scores[1:], opens[1:], strict=True):
        step = steps[int(o)]
        best = [max(range(3), key=lambda k, j=j, row=row, step=step: (row[k] + step[k][j], -k)) for j in range(3)]
        row = [int(row[best[j]] + step[best[j]][j] + e[j]) for j in range(3)]
        back.append(best)
    state = max(range(3), key=lambda k: (row[k], -k))
    out = [state]
    for best in reversed(back):
        out.append(state := best[state])
    return out[::-1]


@pytest.mark.parametrize("sizes", [[1], [1, 2, 3, 1, 1, 40, 7], [300], [5, 1000, 2, 1]])
def test_decoder_equals_plain_viterbi(sizes, monkeypatch):
    monkeypatch.setattr(chat_format, "_CHUNK", 64)
    rng = np.random.default_rng(sum(sizes))
    n = sum(sizes)
    coder = chat_format.Decoder(chat_format.Hmm(), [np.log(rng.dirichlet(np.ones(v), 3)) for v in chat_format._SIZES])
    cols = {"marker": rng.choice(4, n, p=[0.9, 0.03, 0.03, 0.04])} | {f"f{i}": rng.integers(0, v, n) for i, v in enumerate(chat_format._SIZES)}
    e, opens = coder.scores(cols), rng.random(n) < 0.3
    first = np.zeros(n, bool)
    starts = np.cumsum([0, *sizes[:-1]])
    first[starts] = True
    free = np.full(n, -1)
    got = coder.path(e, opens, first, free, free)
    want = [s for a, k in zip(starts, sizes, strict=True) for s in viterbi(e[a : a + k].tolist(), opens[a : a + k], coder.start, coder.steps)]
    assert got.tolist() == want
    # any cut of a conversation gives the same roles
    for a, k in zip(starts.tolist(), sizes, strict=True):
        if k > 2:
            cuts = [0, *sorted(rng.choice(np.arange(1, k), 2, replace=False).tolist()), k]
            pieces = [(a + x, a + y) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            chain = []
            for i, (x, y) in enumerate(pieces):
                whole = coder.table(e[x:y], opens[x:y])
                begun = coder.start + e[x] if y - x == 1 else ((coder.start + e[x])[:, None] + coder.table(e[x + 1 : y], opens[x + 1 : y])).max(axis=0)
                chain.append((i, 1, whole.ravel().tolist(), begun.tolist()))
            ends = chat_format.borders([chain])
            parts = []
            for i, (x, y) in enumerate(pieces):
                before, last, head = np.full(y - x, -1), np.full(y - x, -1), np.zeros(y - x, bool)
                before[0], last[-1], head[0] = ends[i, 1][0], ends[i, 1][1], True
                parts += coder.path(e[x:y], opens[x:y], head, before, last).tolist()
            assert parts == want[a : a + k]


def test_chat_bears_odd_rows(spark):
    """Odd texts, repeated rows, one conversation for all; and a turn of very many lines."""
    rows = [(7, 1, "user" if i % 2 else None, t) for i, (_, t, *_) in enumerate(ODD)] + [(None, i, "bot", t) for i, (_, t, *_) in enumerate(ODD)]
    got = chat_format.canonical(clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "part", "at", "first", "table")).collect()
    body = lambda ms: "\n".join(m.content for m in ms)
    assert sorted((str(r.conv_id), str(r.turn), body(r.messages)) for r in got) == sorted((str(c), str(t), x or "") for c, t, _, x in rows)
    many = "\n".join(f"line {i:07d}" for i in range(1_000_000))
    one = chat_format.canonical(spark.createDataFrame([(1, 0, "user", many), (1, 1, None, "well?")], "conv_id long, turn long, role string, text string")).where("turn = 0").first()
    assert [(m.role, m.content) for m in one.messages] == [("user", many)]


def test_chat_empty(spark):
    assert chat_format.canonical(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


# -- token histogram


def test_histogram_equals_brute_force(spark, some_docs, odd_docs):
    docs = some_docs.unionByName(odd_docs)
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    lengths = token_histogram.token_lengths(clash(docs, "n_tokens"), path).cache()
    n = [r.n_tokens for r in lengths.collect()]
    with open(path, "rb") as f:
        code = token_histogram._encoding(f.read(), token_histogram.PATTERN)
    assert sorted(n) == sorted(len(code.encode_ordinary(r.text or "")) for r in docs.collect())
    assert all(code.decode(code.encode_ordinary(r.text)) == r.text for r in docs.collect() if r.text)
    hist = token_histogram.length_histogram(lengths).cache()
    for r in hist.collect():
        x = r.n_tokens
        assert (r.n_docs, r.docs_at_least, r.docs_longer) == (n.count(x), sum(k >= x for k in n), sum(k > x for k in n))
        assert r.tokens_at_least == sum(k for k in n if k >= x) and r.truncated_tokens == sum(min(k, x) for k in n)
        assert r.quantile == pytest.approx(sum(k <= x for k in n) / len(n))
    for r in token_histogram.for_limits(hist, [0, 10, 4096, 10**6]).collect():
        assert r.truncated_tokens == sum(min(k, r.context_limit) for k in n) and r.n_tokens == sum(n)
    assert token_histogram.quantile_length(hist, 0.5).first().n_tokens == sorted(n)[math.ceil(len(n) / 2) - 1]


def test_histogram_empty(no_docs):
    assert token_histogram.length_histogram(token_histogram.token_lengths(no_docs, "/opt/tokenizers/byte_bpe_50k.tiktoken")).collect() == []
