"""Chat transcripts in one canonical form, with roles recovered by a hidden Markov model.

Every line of every turn is an observation: the speaker marker it carries (a role tag of its turn, or
a prefix such as ``User:`` in the text), whether it opens a turn, and features of the line and its turn
(length, question, list or code). States are the roles; their emission shares are counted over all
turns whose tag is known, transitions are parameters. Viterbi decoding finds the likeliest roles of a
whole conversation, and each turn is rendered as messages of one role.

Turns are range-partitioned in reading order, so a long conversation may lie across many tasks. A task
reduces its first and last conversation to a 3 x 3 table of best scores between border states; the
driver chains the tables of conversations that reach over several tasks, fixes the border states, and
tasks decode their own lines. Scores are whole numbers, so sums do not depend on their order and any
cut gives the same roles. Within a task all lines are decoded together, by products of (max, +)
matrices over runs of doubling length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

ROLES = ("system", "user", "assistant")

# Speaker names in the wild, by role.
SPEAKERS = {
    "system": ("system", "sys", "instructions"),
    "user": ("user", "human", "prompter", "customer", "question"),
    "assistant": ("assistant", "ai", "bot", "gpt", "model", "agent", "answer"),
}
_PREFIX = r"^\s*(?:#{1,6}\s*|\*\*|<\|?|\[)?(?i:(" + "|".join(n for names in SPEAKERS.values() for n in names) + r"))(?:\*\*|\|?>|\])?\s*(?::|>|$)\s*(?:\*\*\s*)?"
#: Values of each feature: length of the line, question, list or code, length of the turn.
_SIZES = (8, 2, 2, 10)


@dataclass(frozen=True)
class Hmm:
    """Transitions between lines; rows are from, columns to, in the order of ROLES."""

    start: tuple[float, ...] = (0.3, 0.6, 0.1)
    between_turns: tuple[tuple[float, ...], ...] = ((0.02, 0.88, 0.10), (0.01, 0.09, 0.90), (0.01, 0.90, 0.09))
    within_turn: tuple[tuple[float, ...], ...] = ((0.98, 0.01, 0.01), (0.01, 0.98, 0.01), (0.01, 0.01, 0.98))
    #: probability that a marker names its line's role
    marker: float = 0.98


def _role_of(name: Column) -> Column:
    name = F.lower(F.trim(name))
    out = F.lit(0)
    for i, role in enumerate(ROLES):
        out = F.when(name.isin(*SPEAKERS[role]), F.lit(i + 1)).otherwise(out)
    return out


def _log_bucket(n: Column, most: int) -> Column:
    return F.least(F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))), F.lit(most)).cast("int")


def lines(turns: DataFrame) -> DataFrame:
    """One row for each line of each turn (part, at, conv_id, turn, tag, text), with its marker (0: none, else role + 1) and features."""
    own = ["part", "at", "conv_id", "turn", _role_of("tag").alias("tag"), F.length("text").alias("size")]
    rows = turns.select(*own, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    spoken = _role_of(F.regexp_extract("line", _PREFIX, 1))
    marker = F.when(spoken > 0, spoken).when(F.col("line_no") == 0, F.col("tag")).otherwise(F.lit(0))
    body = F.when(spoken > 0, F.regexp_replace("line", _PREFIX, "")).otherwise(F.col("line"))
    stripped = F.trim("line")
    return rows.select(
        "part",
        "at",
        "conv_id",
        "turn",
        "line_no",
        body.alias("line"),
        "tag",
        marker.alias("marker"),
        ((F.col("line_no") == 0) | (spoken > 0)).alias("opens"),
        (spoken > 0).alias("spoken"),
        _log_bucket(F.length("line"), 7).alias("f0"),
        stripped.endswith("?").cast("int").alias("f1"),
        stripped.rlike(r"^(?:[-*•]\s|\d+[.)]\s|```)").cast("int").alias("f2"),
        F.when(F.col("line_no") == 0, _log_bucket(F.col("size"), 8)).otherwise(F.lit(9)).alias("f3"),
    )


def emissions(rows: DataFrame) -> list[np.ndarray]:
    """log P(feature value | role), add-one smoothed, over the lines of turns with a known tag."""
    known = rows.where("tag > 0 and not spoken")
    long = known.select("tag", F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"f{i}").alias("v")) for i in range(len(_SIZES))))).alias("x"))
    out = [np.ones((len(ROLES), n)) for n in _SIZES]
    for r in long.groupBy("tag", "x.f", "x.v").agg(F.count("*").alias("n")).collect():  # at most 3 * 22 rows
        out[r["f"]][r["tag"] - 1, r["v"]] += r["n"]
    return [np.log(x / x.sum(axis=1, keepdims=True)) for x in out]


def _whole(log_p: np.ndarray) -> np.ndarray:
    """Log-probabilities as whole numbers: sums are exact in any order."""
    return np.round(np.asarray(log_p) * (1 << 24)).astype(np.int64)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(max, +) products of 3 x 3 matrices, one for each row."""
    out = a[:, :, 0, None] + b[:, None, 0, :]
    for m in (1, 2):
        np.maximum(out, a[:, :, m, None] + b[:, None, m, :], out=out)
    return out


_CHUNK = 1 << 15


class Decoder:
    def __init__(self, hmm: Hmm, tables: list[np.ndarray]):
        self.start = _whole(np.log(hmm.start))
        self.steps = _whole(np.log([hmm.within_turn, hmm.between_turns]))
        self.tables = [_whole(t.T) for t in tables]
        wrong = (1 - hmm.marker) / (len(ROLES) - 1)
        self.marker = _whole(np.log([[1.0] * 3] + [[hmm.marker if i == m else wrong for i in range(3)] for m in range(3)]))

    def scores(self, cols: dict[str, np.ndarray]) -> np.ndarray:
        """Of each line and state."""
        e = self.marker[cols["marker"]]
        for i, t in enumerate(self.tables):
            e = e + t[cols[f"f{i}"]]
        return e

    def matrices(self, e: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """Best scores from each state before a line to each state at it."""
        return self.steps[opens.astype(np.int64)] + e[:, None, :]

    def table(self, e: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """Best scores from each state before the lines to each state at the last one."""
        out = None
        for lo in range(0, len(e), _CHUNK):
            p = self.matrices(e[lo : lo + _CHUNK], opens[lo : lo + _CHUNK])
            while len(p) > 1:
                odd = p[len(p) & ~1 :]
                p = np.concatenate([_times(p[: len(p) & ~1 : 2], p[1::2]), odd])
            out = p if out is None else _times(out, p)
        return out[0]

    def path(self, e: np.ndarray, opens: np.ndarray, first: np.ndarray, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """States of all lines; ``first`` marks where pieces of conversations begin.

        ``before`` holds at such a line the state ahead of the piece, or -1 where a conversation begins;
        ``last`` at a piece's last line the state there, or -1 where it is free. Ties go to the lower state.
        """
        n = len(e)
        back, best = np.empty((n, 3), np.int8), np.empty(n, np.int8)
        ahead = np.zeros(3, np.int64)
        since = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
        for lo in range(0, n, _CHUNK):
            hi = min(n, lo + _CHUNK)
            a = self.steps[opens[lo:hi].astype(np.int64)]
            f = np.flatnonzero(first[lo:hi])
            known = before[lo:hi][f]
            a[f] = np.where(known[:, None] >= 0, a[f, np.maximum(known, 0)], self.start)[:, None, :]
            a += e[lo:hi, None, :]
            p, d = a.copy(), 1
            longest = int(np.minimum(since[lo:hi], np.arange(hi - lo)).max()) + 1
            while d < longest:
                p[d:] = _times(p[:-d], p[d:])
                d *= 2
            row = (ahead[None, :, None] + p).max(axis=1)
            back[lo:hi] = (np.concatenate([ahead[None], row[:-1]])[:, :, None] + a).argmax(axis=1)
            best[lo:hi] = row.argmax(axis=1)
            ahead = row[-1] - row[-1].max()
        ends = np.append(first[1:], True)[:n]
        best = np.where(last >= 0, last, best)
        # from the state of the next line to that of each, or to the piece's last state whatever comes next
        then = np.empty((n, 3), np.int64)
        then[:-1] = back[1:]
        then[ends] = best[ends][:, None]
        out, follows = np.empty(n, np.int64), 0
        for hi in range(n, 0, -_CHUNK):
            lo = max(0, hi - _CHUNK)
            g, d = then[lo:hi].copy(), 1
            longest = int(since[lo:hi].max()) + 1
            while d < min(longest, hi - lo):
                g[:-d] = np.take_along_axis(g[:-d], g[d:], axis=1)
                d *= 2
            out[lo:hi] = g[:, follows]
            follows = int(out[lo])
        return out


_FEATURES = ("marker", "f0", "f1", "f2", "f3")


def _whole_conversations(batches) -> Iterator[pa.Table]:
    """The lines in tables that end where a part's piece of a conversation does."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        part, conv = batch.column(0), batch.column(1)
        if held and (held[-1].column(0)[-1], held[-1].column(1)[-1]) != (part[0], conv[0]):
            yield pa.Table.from_batches(held)
            held = []
        turns = np.flatnonzero(_changes(part, conv))
        if len(turns):
            at = int(turns[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
            held, batch = [], batch.slice(at)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _changes(part: pa.Array, conv: pa.Array) -> np.ndarray:
    """Whether a line, the first aside, belongs to another part or conversation than the one before."""
    p = part.to_numpy(zero_copy_only=False)
    none = conv.is_null().to_numpy(zero_copy_only=False)
    c = conv.fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([np.zeros(min(1, len(p)), bool), (p[1:] != p[:-1]) | (c[1:] != c[:-1]) | (none[1:] != none[:-1])])


def _numbers(t: pa.Table, names) -> dict[str, np.ndarray]:
    return {c: t.column(c).to_numpy() for c in names}


def _border_tables(sent):
    """(part, conv_id, table, first) of the first and the last conversation of each part.

    table holds the best scores from each state before to each state at the last line, first those from
    the beginning of a conversation.
    """

    def run(batches):
        coder = sent.value
        out: list[tuple] = []
        latest, opened = None, None

        def reduced(key, x):
            e = coder.scores(x)
            one, begun = coder.matrices(e[:1], x["opens"][:1]), coder.start + e[0]
            if len(e) > 1:
                rest = coder.table(e[1:], x["opens"][1:])
                one, begun = _times(one, rest[None]), (begun[:, None] + rest).max(axis=0)
            out.append((*key, one[0], begun))

        for t in _whole_conversations(batches):
            t = t.combine_chunks()
            part, conv = t.column("part").chunk(0), t.column("conv_id").chunk(0)
            starts = np.concatenate([[0], np.flatnonzero(_changes(part, conv))])
            x = _numbers(t, (*_FEATURES, "opens"))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(t)], strict=True):
                key = (part[a].as_py(), conv[a].as_py())
                if opened != key[0]:  # the part before is done, this one begins
                    if latest:
                        reduced(*latest)
                    latest, opened = None, key[0]
                    reduced(key, {k: v[a:b] for k, v in x.items()})
                else:
                    latest = (key, {k: v[a:b] for k, v in x.items()})
        if latest:
            reduced(*latest)
        columns = [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2].ravel().tolist() for r in out], pa.list_(pa.int64())), pa.array([r[3].tolist() for r in out], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "conv_id", "table", "first"])

    return run


def borders(chains: list[list]) -> dict[tuple[int, int | None], tuple[int, int]]:
    """(state before or -1, last state) of each part's piece of conversations that lie in several parts.

    A chain holds (part, conv_id, table, first) in order.
    """
    out = {}
    for chain in chains:
        row, back = np.asarray(chain[0][3]), []
        for _, _, table, _ in chain[1:]:
            reach = row[:, None] + np.asarray(table).reshape(3, 3)
            back.append(reach.argmax(axis=0))
            row = reach.max(axis=0)
        state = int(row.argmax())
        for i in range(len(chain) - 1, -1, -1):
            ahead = int(back[i - 1][state]) if i else -1
            out[chain[i][0], chain[i][1]] = (ahead, state)
            state = ahead
    return out


def _decode(sent, ends):
    """(conv_id, turn, messages) of each turn."""

    def run(batches):
        coder, known = sent.value, ends.value
        for t in _whole_conversations(batches):
            t = t.combine_chunks()
            n = len(t)
            part, conv, turn = (t.column(c).chunk(0) for c in ("part", "conv_id", "turn"))
            x = _numbers(t, (*_FEATURES, "opens", "spoken", "line_no"))
            first = _changes(part, conv)
            first[0] = True
            before, last = np.full(n, -1), np.full(n, -1)
            if known:
                starts = np.flatnonzero(first)
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
                    before[a], last[b - 1] = known.get((part[a].as_py(), conv[a].as_py()), (-1, -1))
            states = coder.path(coder.scores(x), x["opens"], first, before, last)
            begins = x["line_no"] == 0
            cut = np.flatnonzero(begins | x["spoken"] | np.concatenate([[True], states[1:] != states[:-1]]))
            stop = np.append(cut[1:], n)
            text = t.column("line").to_pylist()
            content = [text[a] if b == a + 1 else "\n".join(text[a:b]) for a, b in zip(cut.tolist(), stop.tolist(), strict=True)]
            rows = np.flatnonzero(begins)
            offsets = pa.array(np.searchsorted(cut, np.append(rows, n)), pa.int32())
            messages = pa.StructArray.from_arrays([pa.array(states[cut], pa.int32()), pa.array(content, pa.string())], ["state", "content"])
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([conv.take(at), turn.take(at), pa.ListArray.from_arrays(offsets, messages)], ["conv_id", "turn", "messages"])

    return run


def canonical(turns: DataFrame, hmm: Hmm | None = None) -> DataFrame:
    """(conv_id, turn, messages, rendered), a row for each row of ``turns`` (conv_id, turn, role, text).

    messages are the runs of lines of one role in the turn, or from one marker to the next, as (role,
    content); prefixes that name a speaker are cut off. rendered joins them as ``<|role|>``, the content
    and ``<|end|>``, each followed by a newline. Turns are read by conv_id and turn, nulls first; equal
    places go by a hash of role and text, so repeated rows stay and lie next to each other. A null or
    empty text is one empty line. An unknown or null role is recovered. No rows give no rows. Other
    columns are ignored, whatever their names.
    """
    spark = turns.sparkSession
    text = F.coalesce("text", F.lit(""))
    own = turns.select("conv_id", "turn", F.col("role").alias("tag"), text.alias("text")).withColumns({"tie": F.xxhash64("tag", "text"), "uid": F.monotonically_increasing_id()})
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "tie", "uid"]
    placed = own.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie", "uid")
    placed = stored(placed.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "turns")
    rows = lines(placed)
    decoder = Decoder(hmm or Hmm(), emissions(rows))
    coder = spark.sparkContext.broadcast(decoder)

    read = rows.drop("tag").repartition("part").sortWithinPartitions("part", "at", "line_no")
    tables = read.select("part", "conv_id", "opens", *_FEATURES).mapInArrow(_border_tables(coder), "part int, conv_id long, table array<long>, first array<long>")
    # of a conversation in one part alone nothing comes to the driver
    chains = tables.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "table", "first"))).alias("x")).where(F.size("x") > 1).collect()
    ends = spark.sparkContext.broadcast(borders([[(r["part"], c["conv_id"], r["table"], r["first"]) for r in c["x"]] for c in chains]))
    decoded = read.select("part", "conv_id", "turn", "line_no", "line", "opens", "spoken", *_FEATURES).mapInArrow(_decode(coder, ends), "conv_id long, turn long, messages array<struct<state:int,content:string>>")

    names = F.array(*map(F.lit, ROLES))
    messages = F.transform("messages", lambda m: F.struct(F.get(names, m["state"]).alias("role"), m["content"].alias("content")))
    rendered = F.transform("messages", lambda m: F.concat(F.lit("<|"), F.get(names, m["state"]), F.lit("|>\n"), m["content"], F.lit("\n<|end|>\n")))
    return decoded.select("conv_id", "turn", messages.alias("messages"), F.array_join(rendered, "").alias("rendered"))
