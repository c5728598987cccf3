"""Join of documents whose sets of word shingles overlap: exact, by prefixes under several token orders.

Two sets with a Jaccard similarity of at least t share a token among the first ``n - ceil(t*n) + 1``
of each, whatever global order the tokens are put in. The first order is by estimated document
frequency, rare tokens first: it feeds an inverted index, so passages that thousands of documents
share stay out of the prefixes. Two further orders, by independent hashes, must agree before a pair is
verified. Frequencies come from a table of ``ORDER_BUCKETS`` counters over the shingles of all
documents; any numbers there give an order, so the table's fixed size costs speed only, never links.

Copies cost nothing: documents of equal sets form one class, only classes meet, and one row of a class
carries its prefixes and its text, however often rows or ids repeat. Within an index bucket each class
first meets one pivot; what remains are pairs of a bucket which pivots have not brought together, and
those meet under the same filters. Components are found by alternating star contractions over verified
links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, intermediate, lasting, measured, stored
from .textarrays import SPACED, Texts, chunks, mix, sequence_hash

#: Counters of the frequency order: 4 bytes each in the broadcast, at every size of the input.
ORDER_BUCKETS = 1 << 19
_FURTHER_ORDERS = (0x5DEECE66D1234567, 0x2545F4914F6CDD1D)


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text; empty without words."""
    for lo, hi in chunks(column):
        words = Texts(column.slice(lo, hi - lo)).words(SPACED)
        h = words.hashes()
        runs = sequence_hash(h, width)
        for i, (a, b) in enumerate(zip(words.first.tolist(), words.last.tolist(), strict=True)):
            if b - a >= width:
                yield lo + i, np.unique(runs[a : b - width + 1])
            else:
                yield lo + i, sequence_hash(h[a:b], b - a) if b > a else h[:0]


def _class_id(s: np.ndarray) -> int:
    """Names a set: 64 bits from two independent sums over its tokens."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        two = np.array([mix(s).sum(), mix(s ^ np.uint64(_FURTHER_ORDERS[0])).sum()], dtype=np.uint64)
        return int(mix(mix(two[:1]) ^ two[1:] ^ np.uint64(len(s))).astype(np.int64)[0])


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - 19)).astype(np.int64)


_SLICES = 64


def _bucket_counts(width: int):
    """(slice, counts): the counters of a task, in slices that are added up apart."""

    def run(batches):
        counts = np.zeros(ORDER_BUCKETS, dtype=np.int32)
        for batch in batches:
            for _, s in shingle_sets(batch.column(0), width):
                np.add.at(counts, _bucket(s), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([x.tobytes() for x in counts.reshape(_SLICES, -1)], pa.binary())], ["slice", "counts"])

    return run


def _added(batches):
    """The sum of each slice's counters, at most 2**31 - 1."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[k] = total.get(k, 0) + np.frombuffer(x, dtype=np.int32).astype(np.int64)
    cut = [np.minimum(x, np.iinfo(np.int32).max).astype(np.int32).tobytes() for x in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(cut, pa.binary())], ["slice", "counts"])


def _frequencies(texts: DataFrame, width: int) -> np.ndarray:
    """The counters over all ``texts`` (text): the same size at every size of the input."""
    form = "slice int, counts binary"
    counted = texts.select("text").mapInArrow(_bucket_counts(width), form).repartition(8, "slice").mapInArrow(_added, form)
    out = np.zeros((_SLICES, ORDER_BUCKETS // _SLICES), dtype=np.int32)
    for r in counted.collect():
        out[r["slice"]] = np.frombuffer(r["counts"], dtype=np.int32)
    return out.ravel()


def _prefixes(width: int, percent: int, order):
    """Of each row its set's size and name, and its prefixes: tokens of the first order, 32-bit keys of the others."""

    def run(batches):
        counts = order.value
        for batch in batches:
            n, cid, ends = [], [], [0]
            cut: list[list[np.ndarray]] = [[], [], []]
            for _, s in shingle_sets(batch.column(2), width):
                keep = prefix_length(len(s), percent)
                # the first order: frequency, then the token itself
                cut[0].append((s[np.lexsort((s, counts[_bucket(s)]))[:keep]] if len(s) else s).view(np.int64))
                for k, by in enumerate(_FURTHER_ORDERS):
                    cut[k + 1].append((_lowest(s, by, keep) >> np.uint64(32)).astype(np.uint32).view(np.int32))
                n.append(len(s))
                cid.append(_class_id(s))
                ends.append(ends[-1] + keep)
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, t), *x]))) for x, t in zip(cut, (np.int64, np.int32, np.int32), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), *lists], ["doc_id", "text_hash", "n_shingles", "cid", "tokens", "second", "third"])

    return run


def _once(key: str):
    """Rows as they come, without those whose ``key`` has come before in this task."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            new = []
            for k in batch.column(batch.schema.get_field_index(key)).to_pylist():
                new.append(k not in seen)
                seen.add(k)
            yield batch.filter(pa.array(new, pa.bool_()))

    return run


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def _lowest(s: np.ndarray, order: int, keep: int) -> np.ndarray:
    keys = mix(s ^ np.uint64(order))
    return np.partition(keys, keep - 1)[:keep] if keep < len(keys) else keys


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two non-empty sets reach the similarity."""
    return (100 + percent) * len(np.intersect1d(a, b, assume_unique=True)) >= percent * (len(a) + len(b))


def _verify(width: int, percent: int):
    """Links (u, v) among rows (a, b, left, right); of a run of rows with one a, its text is cut once."""

    def run(batches):
        last, held = None, None
        for batch in batches:
            a, b, left, right = (batch.column(i) for i in range(4))
            want_a, want_b = a.to_pylist(), b.to_pylist()
            opens = [x != y for x, y in zip(want_a, [last, *want_a], strict=False)]
            cuts = shingle_sets(left.filter(pa.array(opens, pa.bool_())), width)
            hit = []
            for i, t in shingle_sets(right, width):
                if opens[i]:
                    held = next(cuts)[1]
                    held = held if _class_id(held) == want_a[i] else None
                hit.append(held is not None and _class_id(t) == want_b[i] and linked(held, t, percent))
            last = want_a[-1] if want_a else last
            keep = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["u", "v"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node of its component.

    Large-star and small-star steps alternate, each written to the shared folder, until the edges stay
    as they are. A hub's edges are reduced by a partial minimum before they are shuffled.
    """
    figures = (F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
    edges, state = measured(_ordered(edges), "edges", *figures)
    while True:
        edges, now = measured(_star_round(edges), "stars", *figures)
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; each edge goes from a node to a smaller one of its component."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return small.where("u <> v").distinct()


def _roots(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, root) of every linked node, by the components of what ``labels`` (node, label) leave apart."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label"))
    named = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("u_label", "u").alias("u"), F.coalesce("v_label", "v").alias("v"))
    nodes = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    labelled = nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    met = components(named).select(F.col("node").alias("label"), "root")
    return labelled.join(met, "label", "left").select("node", F.coalesce("root", "label").alias("root"))


def _placed(x: str, place: str) -> list[Column]:
    return [F.shiftright(place, 32).alias(f"{x}_pos"), F.col(place).bitwiseAND(F.lit((1 << 32) - 1)).alias(f"{x}_n")]


def _fits(a: str, b: str, percent: int) -> Column:
    """The overlap that a shared token leaves possible: all from its place onward in either set."""
    room = F.least(F.col(f"{a}_n") - F.col(f"{a}_pos"), F.col(f"{b}_n") - F.col(f"{b}_pos"))
    return (100 + percent) * room >= percent * (F.col(f"{a}_n") + F.col(f"{b}_n"))


def similarity_classes(docs: DataFrame, width: int = 5, percent: int = 80, keys: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text, ...).

    Words are runs of other than ASCII white space after lower-casing A-Z; the set holds the distinct
    ``width``-word shingles, or the whole sequence where there are fewer words. Two documents link at a
    Jaccard similarity of ``percent`` hundredths; component_id is the smallest doc_id of those reachable.
    A null, empty or blank text has no shingles, links with nothing and is its own component, as is any
    row of a null doc_id that links with none. Repeated rows stay repeated and repeated ids are rows of
    their own, each linked by its own text. Other columns are ignored. With ``keys`` rows also have
    text_hash (xxhash64 of the text) and leads: whether the row's id and text are those of its
    component's first row, by id (null last) and text_hash; null without shingles.
    """
    with intermediate(docs.sparkSession):
        return _similarity_classes(docs, width, percent, keys)


def _similarity_classes(docs: DataFrame, width: int, percent: int, keys: bool) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    order = spark.sparkContext.broadcast(_frequencies(texts, width))
    form = "doc_id long, text_hash long, n_shingles long, cid long, tokens array<long>, second array<int>, third array<int>"
    sets = stored(texts.mapInArrow(_prefixes(width, percent, order), form), "sets")
    filled = sets.where("n_shingles > 0")
    # the first row of each class, by id and text, stands for it
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    classes = stored(filled.groupBy("cid").agg(first).select("cid", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("rep_hash")), "classes")
    # ids grow with the corpus, so these joins are shuffled at every size
    of_rep = lambda df, of: df.join(of.hint("shuffle_hash"), df["doc_id"].eqNullSafe(of["rep"]) & (df["text_hash"] == of["rep_hash"]))
    reps = of_rep(filled.drop("cid"), classes).select("cid", "n_shingles", "tokens", "second", "third")
    reps = stored(reps.mapInArrow(_once("cid"), "cid long, n_shingles long, tokens array<long>, second array<int>, third array<int>"), "reps")
    whole, sets = sets, stored(sets.drop("tokens", "second", "third"), "rows")
    discard(whole)

    rows = reps.select("cid", "n_shingles", F.posexplode("tokens").alias("pos", "token"))
    # a row of the index: a place and a size share one number, which keeps the shuffle small
    rows = rows.select("token", "cid", (F.shiftleft(F.col("pos").cast("long"), 32) + F.col("n_shingles")).alias("place"))
    meet = rows.groupBy("token").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo <> hi").select("token")
    shared = stored(rows.join(meet, "token"), "shared")
    # the class in which a token stands furthest ahead has the fewest tokens of its own: of near copies, the original
    pivots = shared.groupBy("token").agg(F.min(F.struct("place", "cid")).alias("pivot"))
    paired = shared.join(pivots, "token").where(F.col("cid") != F.col("pivot.cid"))
    paired = stored(paired.select("token", "cid", F.col("pivot.cid").alias("pivot"), *_placed("s", "place"), *_placed("p", "pivot.place")), "paired")
    discard(shared)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The links (u, v) among candidate pairs (a, b) of classes, a the one that many pairs may share."""
        agreed = stored(_agreed(reps, pairs), "agreed")
        wanted = agreed.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        bodies = of_rep(texts, classes.join(wanted, "cid", "left_semi")).select("cid", "text")
        bodies = stored(bodies.mapInArrow(_once("cid"), "cid long, text string"), "bodies")
        body = lambda x, column: bodies.select(F.col("cid").alias(x), F.col("text").alias(column))
        # b's text comes first: the rows of a frequent a are then large enough for adaptive execution to split them
        full = agreed.join(body("b", "right"), "b").join(body("a", "left"), "a").select("a", "b", "left", "right")
        links = stored(full.mapInArrow(_verify(width, percent), "u long, v long"), name)
        discard(bodies)
        return links

    links = verified(paired.where(_fits("s", "p", percent)).select(F.col("pivot").alias("a"), F.col("cid").alias("b")), "links-first")
    # one round joins the stars around pivots; equal labels mean one component
    labels = stored(_star_round(_ordered(links)).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")), "labels")

    rest = paired.select("token", F.col("cid").alias("s_cid"), "s_pos", "s_n")
    rest = rest.join(labels, rest["s_cid"] == labels["node"], "left").select("token", "s_cid", "s_pos", "s_n", F.coalesce("label", "s_cid").alias("s_label"))
    undone = rest.groupBy("token").agg(F.min("s_label").alias("lo"), F.max("s_label").alias("hi")).where("lo <> hi").select("token")
    rest, left = measured(rest.join(undone, "token"), "rest", F.count("*").alias("n"))
    if left["n"]:
        other = rest.select("token", *(F.col(c).alias("o" + c[1:]) for c in rest.columns[1:]))
        pairs = rest.join(other, (rest["token"] == other["token"]) & (F.col("s_label") < F.col("o_label")) & _fits("s", "o", percent))
        more = verified(pairs.select(F.least("s_cid", "o_cid").alias("a"), F.greatest("s_cid", "o_cid").alias("b")), "links-rest")
        links = links.unionByName(more)
    roots = stored(_roots(links, labels), "roots")

    named = classes.join(roots, classes["cid"] == roots["node"], "left").select("cid", "rep", "rep_hash", F.coalesce("root", "cid").alias("root"))
    lead = named.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("no_id"), F.col("rep").alias("id"), F.col("rep_hash").alias("hash"))).alias("lead"))
    of_class = named.join(lead, "root").select(F.col("cid").alias("of"), "lead")
    columns = [F.when(F.col("n_shingles") > 0, F.col("lead.id")).otherwise(F.col("doc_id")).alias("component_id")]
    if keys:
        leads = F.col("doc_id").eqNullSafe(F.col("lead.id")) & (F.col("text_hash") == F.col("lead.hash"))
        columns += ["text_hash", F.when(F.col("n_shingles") > 0, leads).alias("leads")]
    out = sets.join(of_class, F.col("cid") == F.col("of"), "left").select("doc_id", "n_shingles", *columns)
    return lasting(out, "classes")


def _agreed(reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prefixes meet under every further order."""
    of = lambda x: reps.select(F.col("cid").alias(x), F.col("second").alias(f"{x}2"), F.col("third").alias(f"{x}3"))
    both = pairs.distinct().join(of("b"), "b").join(of("a"), "a")
    return both.where(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3")).select("a", "b")


#: similarity_classes() over documents with four words and 85 hundredths; all pairs that share a shingle, so for small tables.
SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
shared AS (SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM shared JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
sides AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT DISTINCT x AS a, x AS b FROM sides UNION SELECT reach.a, sides.y FROM reach JOIN sides ON reach.b = sides.x),
low AS (SELECT a, min(doc_id) AS component_id FROM reach JOIN d ON d.rid = reach.b GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(low.component_id, doc_id) AS component_id FROM d LEFT JOIN n ON n.rid = d.rid LEFT JOIN low ON low.a = d.rid
"""
