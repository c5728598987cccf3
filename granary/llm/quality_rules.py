"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Everything is measured on the whole text in one pass over its words and lines. Higher-order functions
bind what is used more than once (words, three-word windows, lines), so nothing is evaluated twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of the corpus languages.
STOP_WORDS = (
    "the of and to in is that it was for on are as with he be at by this have from or an had not a but "
    "de la le et les des en un une du dans est que qui pour par sur au avec il elle ne se pas plus ce "
    "der die das und den von zu mit ist des sich im dem nicht ein eine als auch es an auf für aus dass "
    "el los las del que y en un una por con no su para es al lo como más o pero sus se "
).split()

WHITE = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
WORD_BREAK = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """A document passes when low <= measure <= high; ``per`` divides the measure, and 0/0 is 0."""

    name: str
    measure: str
    per: str | None = None
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("length", "n_words", None, 50, 200_000),
    Rule("word_length", "word_chars", "n_words", 2, 16),
    Rule("symbols", "n_symbols", "n_words", None, 0.2),
    Rule("stop_words", "n_stop_words", "n_words", 0.06, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 0.5),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """How many words lie in a three-word window that occurs twice or more, its first place included."""
    windows = F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<string>"))

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))

        def places(p: Column) -> Column:
            twin = lambda x, j: (x["t"] == F.get(p, j - 1)["t"]) | (x["t"] == F.get(p, j + 1)["t"])
            return F.size(F.array_distinct(F.flatten(F.transform(F.filter(p, lambda x, j: F.coalesce(twin(x, j), F.lit(False))), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(placed, places))

    return _let(windows, covered)


def measures(text: Column) -> Column:
    """A struct of all counts of a text; a null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, WORD_BREAK, -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, WHITE, "")) > 0)

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda y: F.rtrim(y).endswith("...") | F.rtrim(y).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
            F.size(F.filter(x, lambda y: F.substring(F.ltrim(y), 1, 1).isin("-", "*", "•"))).cast("long").alias("n_bullet_lines"),
        )

    return F.struct(
        _let(words, of_words).alias("w"),
        _let(lines, of_lines).alias("l"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )


def compiled(rules: tuple[Rule, ...], column: Callable[[str], Column]) -> Column:
    """The names of the rules that a document fails, as an array."""

    def fails(r: Rule) -> Column:
        x = column(r.measure).cast("double")
        if r.per:
            x = F.coalesce(F.try_divide(x, column(r.per).cast("double")), F.lit(0.0))
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (x < F.lit(float(r.low)))
        if r.high is not None:
            bad = bad | (x > F.lit(float(r.high)))
        return bad

    return F.array_compact(F.array(*(F.when(fails(r), F.lit(r.name)) for r in rules)))


_NAMES = {"n_words": "w.n_words", "n_stop_words": "w.n_stop_words", "n_repeat_words": "w.n_repeat_words", "n_lines": "l.n_lines", "n_dup_lines": "l.n_dup_lines", "n_ellipsis_lines": "l.n_ellipsis_lines", "n_bullet_lines": "l.n_bullet_lines", "word_chars": "word_chars", "n_symbols": "n_symbols"}


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every measure, base_failed, failed_rules and kept.

    base_failed: under 50 words, or more than half of the words in repeated three-word windows. kept:
    not base_failed and no rule failed. A null or empty text has no words and fails. Rows stay as they
    are, repeated ones too; a column named like a result is replaced.
    """
    docs = docs.drop(*_NAMES, "base_failed", "failed_rules", "kept", "measures_")
    # a generator of one row: the optimizer moves no filter below it, which would measure once for each use
    found = docs.select("*", F.explode(F.array(measures(F.col("text")))).alias("measures_"))
    get = lambda c: F.col(f"measures_.{_NAMES[c]}")
    base = (get("n_words") < 50) | (100 * get("n_repeat_words") > 50 * get("n_words"))
    failed = compiled(rules, get)
    return found.withColumns({**{c: get(c) for c in _NAMES}, "base_failed": base, "failed_rules": failed, "kept": ~base & (F.size(failed) == 0)}).drop("measures_")


def _sql_rules(rules: tuple[Rule, ...]) -> str:
    out = []
    for r in rules:
        x = f"coalesce({r.measure}::DOUBLE / nullif({r.per}, 0), 0)" if r.per else f"{r.measure}::DOUBLE"
        out += [f"{x} {op} {float(bound)!r}" for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]
    return " AND ".join(out)


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
ws AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
tri AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM ws)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM tri) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM dup) GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS x FROM d),
lc AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines,
              count(*) FILTER (WHERE rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…') AS n_ellipsis_lines,
              count(*) FILTER (WHERE substr(ltrim(x, ' '), 1, 1) IN ('-', '*', '•')) AS n_bullet_lines
       FROM ln WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT ws.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(lc.n_lines, 0)::BIGINT AS n_lines, coalesce(lc.n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(lc.n_ellipsis_lines, 0) AS n_ellipsis_lines, coalesce(lc.n_bullet_lines, 0) AS n_bullet_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))}))) AS n_stop_words
      FROM ws LEFT JOIN lc ON lc.rid = ws.rid LEFT JOIN rep ON rep.rid = ws.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {_sql_rules(RULES)} AS kept
FROM m
"""
