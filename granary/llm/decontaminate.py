"""Benchmark passages in documents, found by Wu-Manber multi-pattern search.

Texts are reduced to their words, joined and framed by single spaces, so that an occurrence of
`` w1 ... w8 `` in the bytes is an occurrence of those words. The search looks at the block of bytes
at the end of a window as long as the shortest pattern: the shift table tells how far the window can
move before any pattern could end there. Only where the shift is zero does a hash of the window's
suffix select the bucket of patterns to compare directly. Many cursors run through a chunk of texts at
once, so each step of the search is a vector operation.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, stored
from .textarrays import ALNUM, Texts, Words, chunks

#: Pattern bytes of one search pass; a larger benchmark is searched in several passes.
BLOCK_BYTES = 16 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LANE = 512


def item_windows(text: str | None, width: int) -> list[bytes]:
    """The distinct framed windows of ``width`` words of a text; one of all words if there are fewer."""
    words = _WORD.findall(text.encode().lower()) if text else []
    runs = [words[i : i + width] for i in range(max(1, len(words) - width + 1))] if words else []
    return list(dict.fromkeys(b" " + b" ".join(w) + b" " for w in runs))


class _Tables:
    """Shift and suffix tables for patterns of similar length."""

    def __init__(self, patterns: list[bytes], ids: list[int]):
        self.patterns, self.m = patterns, min(map(len, patterns))
        self.block = 2 if self.m < 8 else 3
        self.q = min(self.m, 8)
        heads = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(len(patterns), self.m)
        self.shift = np.full(1 << 16, self.m - self.block + 1, dtype=np.int32)
        for end in range(self.block - 1, self.m):  # later ends come last and are the smaller shifts
            self.shift[self._hash(*(heads[:, end - k] for k in range(self.block)))] = self.m - 1 - end
        suffix = self._suffix(heads.ravel(), np.arange(len(patterns)) * self.m + self.m - 1)
        order = np.argsort(suffix, kind="stable")
        self.ids = np.asarray(ids)[order]
        self.patterns = [patterns[i] for i in order.tolist()]
        self.keys, self.first = np.unique(suffix[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))

    def _hash(self, c: np.ndarray, b: np.ndarray, a: np.ndarray | None = None) -> np.ndarray:
        h = c.astype(np.int32) | (b.astype(np.int32) << 8)
        return h if a is None else (h ^ (a.astype(np.int32) * 0x9E5)) & 0xFFFF

    def _suffix(self, flat: np.ndarray, end: np.ndarray) -> np.ndarray:
        key = np.zeros(len(end), dtype=np.uint64)
        for k in range(self.q):
            key = (key << np.uint64(8)) | flat[end - k]
        return key

    def find(self, flat: np.ndarray, raw: bytes) -> Iterator[tuple[int, int]]:
        """(first byte, pattern id) of every occurrence."""
        at = np.arange(self.m - 1, len(flat), _LANE)
        limit = np.minimum(at + _LANE, len(flat))
        ends = []
        while len(at):
            shift = self.shift[self._hash(*(flat[at - k] for k in range(self.block)))]
            zero = shift == 0
            if zero.any():
                ends.append(at[zero])
            at = at + np.maximum(shift, 1)
            live = at < limit
            if not live.all():
                at, limit = at[live], limit[live]
        end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        key = self._suffix(flat, end)
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        same = self.keys[slot] == key
        for e, k in zip(end[same].tolist(), slot[same].tolist(), strict=True):
            s = e - self.m + 1
            for i in range(self.first[k], self.last[k]):
                p = self.patterns[i]
                if raw[s : s + len(p)] == p:
                    yield s, int(self.ids[i])


class WuManber:
    """Patterns by class of length, so that one short pattern does not shorten every shift."""

    def __init__(self, patterns: dict[bytes, dict[str, None]]):
        self.items = [list(p) for p in patterns.values()]
        self.words = [p.count(b" ") - 1 for p in patterns]
        classes: dict[int, tuple[list[bytes], list[int]]] = defaultdict(lambda: ([], []))
        for i, p in enumerate(patterns):
            of = classes[sum(len(p) >= n for n in (8, 16, 32))]
            of[0].append(p)
            of[1].append(i)
        self.tables = [_Tables(*classes[k]) for k in sorted(classes)]

    def find(self, flat: np.ndarray) -> Iterator[tuple[int, int]]:
        raw = flat.tobytes()
        for t in self.tables:
            yield from t.find(flat, raw)


def framed(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words with a space before the first of each text and after each, and where each word begins."""
    size = words.end - words.start
    before = np.cumsum(size) - size
    begin = before + np.arange(len(size)) + words.doc() + 1
    out = np.full(int(size.sum()) + len(size) + len(words.first), 32, dtype=np.uint8)
    inside = np.repeat(words.start - before, size) + np.arange(int(size.sum()))
    out[np.repeat(begin - before, size) + np.arange(int(size.sum()))] = words.flat[inside]
    return out, begin


def _blocks(benchmark: DataFrame, width: int, limit: int) -> Iterator[WuManber]:
    """Searches for the windows of all items, each of about ``limit`` bytes of patterns; made one at a time."""
    patterns: dict[bytes, dict[str, None]] = {}
    total = 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").where("item_id is not null and text is not null").toLocalIterator():
        for w in item_windows(row["text"], width):
            patterns.setdefault(w, {})[row["item_id"]] = None
            total += len(w) + 64
            if total >= limit:  # the rest of an item goes to the next block
                yield WuManber(patterns)
                patterns, total = {}, 0
    if patterns:
        yield WuManber(patterns)


def _search(model):
    def run(batches):
        search = model.value
        for batch in batches:
            names = batch.schema.names
            column, old = batch.column(names.index("text")), {c: batch.column(names.index(c)) for c in _STATE}
            n_words, starts, ends, items = [], [], [], []
            for lo, hi in chunks(column):
                words = Texts(column.slice(lo, hi - lo)).words(ALNUM)
                flat, begin = framed(words)
                mark = np.zeros(len(begin) + 1, dtype=np.int64)
                doc = words.doc()
                found: dict[int, set[str]] = defaultdict(set)
                for s, i in search.find(flat):
                    w = int(np.searchsorted(begin, s + 1))
                    mark[w] += 1
                    mark[w + search.words[i]] -= 1
                    found[int(doc[w])].update(search.items[i])
                for r, (a, b) in enumerate(zip(words.first.tolist(), words.last.tolist(), strict=True)):
                    for s, e in zip(old["hit_start"][lo + r].as_py() or (), old["hit_end"][lo + r].as_py() or (), strict=True):
                        mark[a + s] += 1
                        mark[a + e] -= 1
                    n_words.append(b - a)
                hit = (np.cumsum(mark[:-1]) > 0).view(np.int8)
                for r, (a, b) in enumerate(zip(words.first.tolist(), words.last.tolist(), strict=True)):
                    turn = np.diff(hit[a:b], prepend=0, append=0)
                    starts.append(np.flatnonzero(turn == 1))
                    ends.append(np.flatnonzero(turn == -1))
                    items.append(sorted(found[r].union(old["items"][lo + r].as_py() or ())))
            new = {"n_words": pa.array(n_words, pa.int64()), "hit_start": pa.array(starts, pa.list_(pa.int32())), "hit_end": pa.array(ends, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(c, x) for c, x in zip(names, batch.columns, strict=True)], names)

    return run


_STATE = {"n_words": "long", "hit_start": "array<int>", "hit_end": "array<int>", "items": "array<string>"}


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_start and hit_end (runs of hit words, ends exclusive), n_hit and items.

    Words are runs of digits, a-z and non-ASCII after lower-casing A-Z. A document word is hit where a
    window of ``width`` consecutive item words occurs (all words of an item that has fewer). items are
    the item_ids with an occurring window, sorted as strings. A null or empty text has no words; items of
    a null id or text, or without a word, never occur; copies of an item count once. Rows stay as they
    are, repeated ones too; a column named like a result is replaced. Patterns beyond ``block_bytes`` are
    searched in further passes, each with its own tables and written before the next, so what is broadcast
    and what the driver holds stay bounded.
    """
    docs = docs.drop(*_STATE, "n_hit").withColumns({c: F.lit(None).cast(t) for c, t in _STATE.items()})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out, sent, held = docs, None, None
    for block in _blocks(benchmark, width, block_bytes):
        if sent:  # a pass is written before the tables of the next are sent, so one block is held at a time
            held, before = stored(out, "searched"), held
            sent.unpersist()
            if before:
                discard(before)
            out = held
        sent = docs.sparkSession.sparkContext.broadcast(block)
        out = out.mapInArrow(_search(sent), schema)
    if not sent:
        out = out.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(WuManber({}))), schema)
    span = F.zip_with("hit_start", "hit_end", lambda s, e: (e - s).cast("long"))
    return out.withColumn("n_hit", F.aggregate(span, F.lit(0).cast("long"), lambda a, x: a + x))


def item_digest(out: DataFrame, least_items: int = 2) -> DataFrame:
    """``out`` of contamination() with n_items, items_sha256 and contaminated."""
    return out.withColumns(
        {
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.concat_ws(",", "items").cast("binary"), 256),
            "contaminated": F.size("items") >= least_items,
        }
    )


SQL = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
spots AS (SELECT item, w, least(8, len(w)) AS k, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS i FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM spots),
pos AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM low, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k),
occ AS (SELECT p.doc_id, p.i, p.k, wins.item FROM (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM pos) p JOIN wins ON wins.k = p.k AND wins.g = p.g),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM occ) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT low.doc_id, coalesce(len(low.w), 0)::BIGINT AS n_words, coalesce(hits.n_hit, 0)::BIGINT AS n_hit, coalesce(own.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(own.names, '')) AS items_sha256, coalesce(own.n_items, 0) >= 2 AS contaminated
FROM low LEFT JOIN hits ON hits.doc_id = low.doc_id LEFT JOIN own ON own.doc_id = low.doc_id
"""
