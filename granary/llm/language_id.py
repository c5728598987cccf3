"""Language of a text by a small convolutional network over its bytes.

Filters of several widths slide over the bytes of a fixed-length window, each keeps its strongest
response (max pooling), and a softmax layer turns the responses into language probabilities. Training
is plain numpy with Adam on windows of a bounded sample of labelled rows. Prediction covers the whole
text: it is cut into consecutive windows, many texts' windows go through the network in one batch, and
a text's score is the mean of its windows' probabilities weighted by their letters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textarrays import CHUNK_BYTES, Texts, chunks

UNDETERMINED = "und"
_GUESS, _SCORE = "granary_guess", "granary_score"  # of the network, before texts without letters are told apart

#: Byte classes: 0 padding and controls, 1 white space, 2 digits, 3 other ASCII, 4 to 29 letters, then
#: each byte from 0x80. The network sees these, so case, digits and punctuation carry nothing.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[33:127] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = np.arange(4, 30)
_CLASS[128:] = np.arange(30, 158)
_N_CLASSES = 158
_LETTER = np.arange(_N_CLASSES) >= 4


@dataclass
class Config:
    """Sizes of the network and of its training sample."""

    window: int = 256
    #: (width, filters) of each bank; widths up to 4
    banks: tuple[tuple[int, int], ...] = ((2, 8), (3, 12), (4, 12))
    #: expected labelled rows that the sample takes of each language, at most, and windows of each row
    rows_per_language: int = 1500
    windows_per_row: int = 3
    epochs: int = 6
    batch: int = 128
    rate: float = 0.01
    seed: int = 7


def held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    """crc32 of the id as text, modulo ``parts``, is ``part``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def windows(column: pa.Array, length: int, halo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte classes of every window with ``halo`` more, its text, its letters) over whole texts."""
    texts = Texts(column, lower=False)
    per = -(-texts.sizes // length)
    doc = np.repeat(np.arange(len(per)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    begin = texts.starts[doc] + nth * length
    end = texts.starts[doc] + texts.sizes[doc]
    at = begin[:, None] + np.arange(length + halo)[None, :]
    inside = at < end[:, None]
    out = np.where(inside, _CLASS[texts.flat[np.minimum(at, len(texts.flat) - 1)]], 0)
    return out, doc, _LETTER[out[:, :length]].sum(axis=1)


class ByteConvNet:
    """Filters as tables: response at i is the sum over k of table[k][class of byte i + k]."""

    def __init__(self, config: Config, languages: list[str]):
        rng = np.random.default_rng(config.seed)
        self.config, self.languages = config, languages
        self.widths = np.concatenate([[w] * f for w, f in config.banks])
        self.halo = int(self.widths.max()) - 1
        tables = rng.normal(0, 0.3, (self.halo + 1, _N_CLASSES, len(self.widths)))
        self.live = (np.arange(self.halo + 1)[:, None] < self.widths[None, :])[:, None, :]
        self.p = {"tables": tables * self.live, "bias": np.zeros(len(self.widths)), "out": rng.normal(0, 0.1, (len(self.widths), len(languages))), "out_bias": np.zeros(len(languages))}
        self.pairs: np.ndarray | None = None

    def _responses(self, x: np.ndarray) -> np.ndarray:
        n = x.shape[1] - self.halo
        return sum(self.p["tables"][k][x[:, k : k + n]] for k in range(self.halo + 1))

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.p["bias"], 0) @ self.p["out"] + self.p["out_bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        c, rng = self.config, np.random.default_rng(self.config.seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, f = 0, np.arange(len(self.widths))
        for _ in range(c.epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), c.batch):
                rows = order[lo : lo + c.batch]
                r = self._responses(x[rows])
                best = r.argmax(axis=1)
                pooled = np.take_along_axis(r, best[:, None, :], axis=1)[:, 0, :]
                hidden = np.maximum(pooled + self.p["bias"], 0)
                prob = self._softmax(pooled)
                prob[np.arange(len(rows)), y[rows]] -= 1
                prob *= (weight[rows] / weight[rows].sum())[:, None]
                back = (prob @ self.p["out"].T) * (hidden > 0)
                tables = np.zeros_like(self.p["tables"])
                for k in range(self.halo + 1):  # only the winning position of each filter passes a gradient
                    np.add.at(tables[k], (x[rows[:, None], best + k], f[None, :]), back)
                grads = {"tables": tables * self.live, "bias": back.sum(axis=0), "out": hidden.T @ prob, "out_bias": prob.sum(axis=0)}
                step += 1
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    v2[k] += 0.001 * (g * g - v2[k])
                    self.p[k] -= c.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)

    def freeze(self) -> ByteConvNet:
        """Tables over two neighbouring bytes, so that a response is two look-ups and one addition."""
        t = self.p["tables"].astype(np.float32)
        t = np.concatenate([t, np.zeros((len(t) % 2, *t.shape[1:]), np.float32)])
        self.pairs = np.stack([(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(-1, t.shape[2]) for k in range(0, len(t), 2)])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        n, steps = self.config.window, len(self.pairs)
        out = np.empty((len(x), len(self.widths)), dtype=np.float32)
        two = (x[:, :-1] * _N_CLASSES + x[:, 1:]).astype(np.int32)
        need = 2 * (steps - 1) + n
        if two.shape[1] < need:
            two = np.pad(two, ((0, 0), (0, need - two.shape[1])))
        for lo in range(0, len(x), 32):  # what one step touches stays in the cache
            part = two[lo : lo + 32]
            r = self.pairs[0][part[:, :n]]
            for k in range(1, steps):
                r += self.pairs[k][part[:, 2 * k : 2 * k + n]]
            out[lo : lo + 32] = r.max(axis=1)
        return self._softmax(out)


def _training_windows(config: Config, halo: int):
    def run(batches):
        for batch in batches:
            for lo, hi in chunks(batch.column(2)):
                x, doc, letters = windows(batch.column(2).slice(lo, hi - lo), config.window, halo)
                rows, langs, data = [], [], []
                for i in range(hi - lo):
                    own = np.flatnonzero((doc == i) & (letters >= 8))
                    seed = batch.column(0)[lo + i].as_py()
                    pick = own if len(own) <= config.windows_per_row else np.sort(np.random.default_rng(seed % (1 << 32)).choice(own, config.windows_per_row, replace=False))
                    for w in pick.tolist():
                        rows.append(seed)
                        langs.append(batch.column(1)[lo + i].as_py())
                        data.append(x[w].astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(langs, pa.string()), pa.array(data, pa.binary())], ["key", "lang", "x"])

    return run


def train(labelled: DataFrame, config: Config | None = None) -> ByteConvNet | None:
    """Fit on rows of ``labelled`` (text, lang); None if no row has both a text with letters and a label.

    Of each language a sample of about ``rows_per_language`` rows is taken by a hash of the text (all
    rows of a rarer language), and a few windows from anywhere in each; languages weigh alike. Copies of a
    text in one language teach once, so the sample stays as small as it says however often one repeats.
    """
    config = config or Config()
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    net = ByteConvNet(config, sorted(sizes))
    key = F.xxhash64("text", F.lit(config.seed))
    share = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, config.rows_per_language / n)))))
    sample = rows.select(key.alias("key"), "lang", "text").where(F.pmod("key", F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    sample = sample.groupBy("key", "lang").agg(F.first("text").alias("text"))
    got = sample.mapInArrow(_training_windows(config, net.halo), "key long, lang string, x binary").toPandas().sort_values(["key", "lang", "x"], kind="stable")
    if not len(got):
        return None
    x = np.frombuffer(b"".join(got["x"]), dtype=np.uint8).reshape(len(got), -1)
    y = np.searchsorted(net.languages, got["lang"].to_numpy().astype(str))
    net.fit(x, y, 1.0 / np.bincount(y, minlength=len(net.languages))[y])
    return net.freeze()


def _predict(model):
    def run(batches):
        net = model.value
        for batch in batches:
            n = len(batch)
            best, score = np.zeros(n, np.int64), np.zeros(n)
            column = batch.column(batch.schema.get_field_index("text"))
            for lo, hi in chunks(column, CHUNK_BYTES // 2):
                x, doc, letters = windows(column.slice(lo, hi - lo), net.config.window, net.halo)
                if len(x):
                    total = np.zeros((hi - lo, len(net.languages)))
                    np.add.at(total, doc, net.predict(x) * (letters + 1e-3)[:, None])
                    weight = np.maximum(total.sum(axis=1), 1e-9)
                    best[lo:hi], score[lo:hi] = total.argmax(axis=1), np.clip(total.max(axis=1) / weight, 0, 1)
            names = pa.array(net.languages, pa.string()).take(pa.array(best))
            yield pa.RecordBatch.from_arrays([*batch.columns, names, pa.array(score)], [*batch.schema.names, _GUESS, _SCORE])

    return run


def identify(docs: DataFrame, labelled: DataFrame | None = None, config: Config | None = None) -> DataFrame:
    """``docs`` with lang_pred and score: every column of a row stays, clashing names are replaced.

    ``labelled`` defaults to ``docs``; only its text and lang teach. A null text, one without a letter
    and every text where nothing could be learned get ``und`` and 0. Equal texts get equal results.
    """
    docs = docs.drop("lang_pred", "score")
    net = train(labelled if labelled is not None else docs, config)
    if net is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    model = docs.sparkSession.sparkContext.broadcast(net)  # a fixed size: the network's tables
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"{_GUESS} string", f"{_SCORE} double"])
    out = docs.mapInArrow(_predict(model), schema)
    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return out.withColumns({"lang_pred": F.when(known, F.col(_GUESS)).otherwise(UNDETERMINED), "score": F.when(known, F.col(_SCORE)).otherwise(0.0)}).drop(_GUESS, _SCORE)
