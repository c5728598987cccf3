"""Language-model scores from a Bloom filter that holds quantised bigram counts.

A bigram of count c is stored as the keys (bigram, 1) ... (bigram, q), q = 1 + floor(log_b(c)). Reading
a count back means probing those keys one after the other until one is missing; the number of hits gives
c up to the base of the logarithm. A word's probability after a context h mixes that count with the word's
own share p(w), add-delta smoothed: (c(hw) + t p(w)) / (c(h) + t), where t = scale * c(h) ** power is about
the number of distinct words that follow h. For exact counts the probabilities after h sum to 1.

Every training word and every bigram is in the model, at every size, so the filter grows with the input
and is never in one place. Keys are dealt out by their first bits into shares. The task of a share merges
its counts, fills its part of the filter and answers the probes for it: texts are cut into blocks of a few
megabytes, each block sends its distinct bigrams and rare words to their shares as packed arrays and gets
one level or count for each back. Only the counts of the most frequent words, a table of fixed size, are
broadcast; they save probes and change nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import DEALT, dealt, finished, in_blocks, rows_of
from .hashindex import HashIndex, Tally
from .scratch import intermediate, lasting, stored
from .textarrays import Texts, chunks, mix

_END = np.uint64(0x1D8E4E27C47D124F)  # the token at the end of each text
_BEGIN = np.uint64(0xA24BAED4963EE407)  # the context of a text's first token
_LOW = np.uint64((1 << 40) - 1)


@dataclass(frozen=True)
class Config:
    #: words whose counts are broadcast, some 30 bytes each; others are probed
    table_words: int = 1 << 18
    base: float = 1.5
    bits_per_key: int = 14
    delta: float = 0.1
    #: distinct followers of a context of count c: scale * c ** power
    scale: float = 2.0
    power: float = 0.75
    #: bytes of training text and of scored text to one share, about
    share_bytes: int = 16 << 20
    #: bytes of text of a block
    block_bytes: int = 8 << 20


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of all tokens, text of each): words after lower-casing A-Z, then an end."""
    for lo, hi in chunks(column):
        words = Texts(column.slice(lo, hi - lo)).words()
        counts = words.counts
        doc = np.repeat(np.arange(len(counts)), counts + 1)
        out = np.full(len(doc), _END, dtype=np.uint64)
        out[np.arange(len(words.start)) + words.doc()] = words.hashes()
        yield lo, out, doc


def _contexts(tokens: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The token before each one."""
    before = np.concatenate(([_BEGIN], tokens[:-1]))
    before[np.concatenate(([True], doc[1:] != doc[:-1]))] = _BEGIN
    return before


def _bigrams(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(mix(before) + tokens)


# -- shares: a key belongs to share (first 24 bits) * shares / 2**24, so sorted keys lie share by share


def _bounds(keys: np.ndarray, shares: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share, first, last) of the shares that sorted ``keys`` touch."""
    of = ((keys >> np.uint64(40)) * np.uint64(shares)) >> np.uint64(24)
    ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)] * (len(of) > 0)).astype(np.int64)
    first = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    return of[first].astype(np.int32), first, ends


def _packed(keys: np.ndarray) -> bytes:
    """The last 40 bits of each key: the first ones are nearly those of its share."""
    return np.ascontiguousarray(keys & _LOW, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _small(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys with counts up to 255: a larger one is written several times."""
    times = (counts + 254) // 255
    if (times == 1).all():
        return keys, counts.astype(np.uint8)
    at = np.repeat(np.arange(len(keys)), times)
    last = np.cumsum(times) - 1
    out = np.full(len(at), 255, dtype=np.uint8)
    out[last] = counts - 255 * (times - 1)
    return keys[at], out


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    k, c = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    if not len(k):
        return k, c
    order = np.argsort(k, kind="stable")
    k = k[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[first], np.add.reduceat(c[order], first)


class _Gathered:
    """Counts of keys from many parts, merged whenever many have come."""

    def __init__(self, limit: int = 1 << 21):
        self.keys, self.counts, self.size, self.limit = [], [], 0, limit

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts.astype(np.int64))
        self.size += len(keys)
        if self.size > self.limit:
            k, c = self.take()
            self.keys, self.counts, self.size, self.limit = [k], [c], len(k), max(self.limit, 2 * len(k))

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = _merged(self.keys, self.counts)
        self.keys, self.counts, self.size = [], [], 0
        return out


# -- training

def _dealt(keys: np.ndarray, counts: np.ndarray, shares: int, pack, kind: int) -> pa.RecordBatch:
    share, first, last = _bounds(keys, shares)
    blobs, more = [], []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        k, c = _small(keys[a:b], counts[a:b])
        blobs.append(pack(k))
        more.append(c.tobytes())
    return dealt(share, kind, -1, blobs, more)


def _counted(keys_of, shares: int, pack, kind: int):
    """Packed counts of the training texts, share by share, merged within a few million keys."""

    def run(batches):
        tally = Tally(1 << 22)
        for batch in batches:
            for _, tokens, doc in _tokens(batch.column(0)):
                if full := tally.add(keys_of(tokens, doc)):
                    yield _dealt(*full, shares, pack, kind)
        yield _dealt(*tally.take(), shares, pack, kind)

    return run


_STEP = float(np.log(1.02))


def _words(batches):
    """Of each share its words with exact counts, how many there are, and how many of each size (in steps of the logarithm)."""
    held: dict[int, _Gathered] = {}
    for batch in batches:
        for share, keys, counts in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
            held.setdefault(share, _Gathered()).add(np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.uint8))
    for share, of in held.items():
        k, c = of.take()
        sizes = np.bincount((np.log(c) / _STEP).astype(np.int64)) if len(c) else np.zeros(0, np.int64)
        row = [pa.array([share], pa.int32()), pa.array([k.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary()), pa.array([len(k)], pa.int64()), pa.array([int(c.sum())], pa.int64()), pa.array([sizes], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(row, ["share", "keys", "more", "types", "tokens", "sizes"])


def _at_least(step: int):
    def run(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k, c = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)
                pick = (np.log(c) / _STEP).astype(np.int64) >= step
                yield pa.RecordBatch.from_arrays([pa.array(k[pick].view(np.int64)), pa.array(c[pick])], ["h", "c"])

    return run


@dataclass
class Model:
    """What every worker receives."""

    config: Config
    shares: int
    tokens: int  # N
    types: int  # V
    texts: int
    table: HashIndex
    table_counts: np.ndarray

    @property
    def mass(self) -> float:
        return self.tokens + self.config.delta * (self.types + 1)


def train(training: DataFrame, docs: DataFrame, config: Config | None = None) -> tuple[Model, DataFrame, DataFrame]:
    """The model of ``training`` (text), all word counts by share, and all bigram counts as packed rows.

    The number of shares follows the bytes of ``training`` and ``docs`` (text).
    """
    config = config or Config()
    texts = training.select("text")
    bytes_of = lambda df: df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    (size, n_texts), (other, _) = bytes_of(texts), bytes_of(docs)
    spark = training.sparkSession
    shares = min(1 << 24, max(spark.sparkContext.defaultParallelism, (size + other) // config.share_bytes))
    words = texts.mapInArrow(_counted(lambda tokens, doc: tokens, shares, lambda k: k.tobytes(), 1), DEALT).repartitionById(shares, "share")
    words = stored(words.mapInArrow(_words, "share int, keys binary, more binary, types long, tokens long, sizes array<long>"), "words")
    v, n = words.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    # whole steps of the largest counts, as many as the table has room for
    steps = words.select(F.posexplode("sizes").alias("step", "n")).groupBy("step").agg(F.sum("n").alias("n")).collect()
    least, total = 1 << 30, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["n"]
        if total > config.table_words:
            break
        least = r["step"]
    known = words.select("keys", "more").mapInArrow(_at_least(least), "h long, c long").toArrow()
    table = HashIndex(known.column("h").to_numpy().view(np.uint64))
    pairs = texts.mapInArrow(_counted(lambda tokens, doc: _bigrams(_contexts(tokens, doc), tokens), shares, _packed, 0), DEALT)
    return Model(config, shares, n, v, n_texts, table, known.column("c").to_numpy()), words, pairs


# -- the filter


class BloomCounts:
    """Words of 64 bits; a key sets four bits of one word."""

    def __init__(self, words: np.ndarray, base: float):
        self.words, self.base = words, base
        self.shift = np.uint64(64 - (len(words) - 1).bit_length())

    @staticmethod
    def places(keys: np.ndarray, level: int, shift: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bits = np.uint64(0)
        for k in range(4):
            bits = bits | (np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63)))
        return (h >> shift).astype(np.int64), bits

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """How many probes of each key hit, one level after the other."""
        out = np.zeros(len(keys), dtype=np.uint8)
        live = np.arange(len(keys))
        for k in range(1, 200):
            if not len(live):
                break
            at, bits = self.places(keys[live], k, self.shift)
            live = live[(self.words[at] & bits) == bits]
            out[live] = k
        return out


def levels_of(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(base) + 1e-9).astype(np.int64)


def middles(base: float) -> np.ndarray:
    """The count that each level stands for: the mean of those that it takes in, 0 for level 0."""
    ends = [base**q for q in range(200)]
    out = [0.0]
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        first, last = int(np.ceil(lo - 1e-6)), int(np.ceil(hi - 1e-6)) - 1
        out.append((first + last) / 2 if last >= first else lo)
    return np.array(out)


def filled(keys: np.ndarray, q: np.ndarray, config: Config) -> BloomCounts:
    """The filter of ``keys`` with q levels each."""
    n_words = 1 << max(4, (int(q.sum()) * config.bits_per_key // 64).bit_length())
    out = BloomCounts(np.zeros(n_words, dtype=np.uint64), config.base)
    for k in range(1, int(q.max(initial=0)) + 1):
        at, bits = out.places(keys[q >= k], k, out.shift)
        order = np.argsort(at)
        at = at[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        out.words[at[first]] |= np.bitwise_or.reduceat(bits[order], first)
    return out


# -- scoring: blocks of texts, their probes, the answers, and the scores of a block


class _Block:
    """The rows of a block, and their tokens and contexts as places among its distinct words."""

    def __init__(self, data: bytes, model: Model):
        self.rows = rows_of(data)
        tokens, doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        done = 0
        for x in self.rows.column("text").chunks:
            for lo, t, d in _tokens(x):
                tokens.append(t)
                doc.append(done + lo + d)
            done += len(x)
        self.tokens, self.doc = np.concatenate(tokens), np.concatenate(doc)
        self.keys = _bigrams(before := _contexts(self.tokens, self.doc), self.tokens) if len(self.tokens) else self.tokens
        self.before = before if len(self.tokens) else self.tokens
        at = model.table.find(self.tokens)
        #: of each token the count in the table, -1 for others
        self.counts = np.where(at >= 0, model.table_counts[at], -1) if len(model.table.keys) else np.full(len(at), -1)
        self.counts[self.tokens == _END] = model.texts

    def rare(self) -> np.ndarray:
        return np.unique(self.tokens[self.counts < 0])


def _probes(sent):
    def run(batches):
        model = sent.value
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = _Block(data.as_py(), model)
                asked = {}
                for i, (keys, pack) in enumerate(((np.unique(block.keys), _packed), (block.rare(), np.ndarray.tobytes))):
                    for share, a, b in zip(*(x.tolist() for x in _bounds(keys, model.shares)), strict=True):
                        asked.setdefault(share, [b"", b""])[i] = pack(keys[a:b])
                yield dealt(list(asked), 2, number, [x[0] for x in asked.values()], [x[1] for x in asked.values()])

    return run


def _answers(config: Config):
    """(block, share, levels, counts) from the rows of a share: its bigrams, its words, then the probes of all blocks."""

    def run(batches):
        now, pairs, words, bloom = None, None, None, None
        for batch in batches:
            out = [], [], [], []
            for share, kind, block, keys, more in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if share != now:
                    now, pairs, words, bloom = share, _Gathered(), (np.zeros(0, np.uint64), np.zeros(0, np.int64)), None
                if kind == 0:
                    pairs.add(_unpacked(keys), np.frombuffer(more, np.uint8))
                elif kind == 1:
                    words = np.frombuffer(keys, np.uint64), np.frombuffer(more, np.int64)
                else:
                    if bloom is None:
                        k, c = pairs.take()
                        bloom = filled(k, levels_of(c, config.base), config)
                    wanted = np.frombuffer(more, np.uint64)
                    counts = np.zeros(len(wanted), dtype=np.int64)
                    if len(words[0]) and len(wanted):
                        at = np.minimum(np.searchsorted(words[0], wanted), len(words[0]) - 1)
                        counts = np.where(words[0][at] == wanted, words[1][at], 0)
                    for column, x in zip(out, (block, share, bloom.levels(_unpacked(keys)).tobytes(), counts.tobytes()), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["block", "share", "levels", "counts"])

    return run


def log_probability(found: np.ndarray, count: np.ndarray, context: np.ndarray, model: Model) -> np.ndarray:
    """log10 of (c(hw) + t p(w)) / (c(h) + t) from c(hw), c(w) and c(h)."""
    c = model.config
    share = (count + c.delta) / model.mass
    t = c.scale * np.power(np.maximum(context, 1), c.power)
    return np.log10(np.where(context > 0, (np.minimum(found, np.minimum(count, context)) + t * share) / (context + t), share))


_NEW = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def _scores(sent, names: list[str]):
    """The rows of a block with their scores, from its data and the answers to its probes."""

    def finish(data: bytes, levels: list[bytes], counts: list[bytes]):
        model = sent.value
        block = _Block(data, model)
        n = block.rows.num_rows
        total = lambda x=None: np.bincount(block.doc, x, n)
        _, at = np.unique(block.keys, return_inverse=True)
        found = middles(model.config.base)[np.frombuffer(b"".join(levels), np.uint8)][at]
        own = block.counts
        pick = own < 0
        _, at = np.unique(block.tokens[pick], return_inverse=True)
        own[pick] = np.frombuffer(b"".join(counts), np.int64)[at]
        own = own.astype(np.float64)
        context = np.concatenate(([0.0], own[:-1]))[: len(own)]
        context[block.before == _BEGIN] = model.texts
        base = np.log10((own + model.config.delta) / model.mass)
        results = [total().astype(np.int64), total(own > 0).astype(np.int64), np.full(n, model.tokens), total(base).astype(np.float64), total(log_probability(found, own, context, model)).astype(np.float64)]
        rows = block.rows.select(names).combine_chunks()
        for name, x in zip(_NEW, results, strict=True):
            rows = rows.append_column(name, pa.array(x))
        yield from rows.to_batches()

    return finish


def score(docs: DataFrame, training: DataFrame, config: Config | None = None) -> DataFrame:
    """``docs`` without text, with n_tokens, n_known, train_tokens, base_score and score.

    Tokens are runs of other than ASCII white space after lower-casing A-Z, then one end; a null text has
    the end alone. n_known tokens occur in ``training`` (text); base_score sums
    log10((c + delta) / (N + delta * (V + 1))) over the exact training counts, score the model's log10
    probabilities. Without training rows N = V = 0 and nothing is known. Rows stay as they are, repeated
    ones too; clashing columns are replaced.
    """
    docs = docs.drop(*_NEW)
    with intermediate(docs.sparkSession):
        return lasting(_scored(docs, *train(training, docs, config)), "scores")


def _scored(docs: DataFrame, model: Model, words: DataFrame, pairs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    blocks = in_blocks(docs, model.config.block_bytes)
    probes = blocks.mapInArrow(_probes(sent), DEALT)
    held = words.select("share", F.lit(1).alias("kind"), F.lit(-1).cast("long").alias("block"), "keys", "more")
    gathered = pairs.unionByName(held).unionByName(probes).repartitionById(model.shares, "share").sortWithinPartitions("share", "kind")
    form = "block long, share int, levels binary, counts binary"
    answers = stored(gathered.mapInArrow(_answers(model.config), form), "answers")
    names = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), "n_tokens long, n_known long, train_tokens long, base_score double, score double"])
    return finished(blocks, answers, _scores(sent, names), schema)
