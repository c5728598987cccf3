from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, lang: str = "en") -> str:
    """n invented words with function words of a language between them."""
    rng = random.Random(seed)
    stop = {"en": "the of and to in is that".split(), "fr": "le la les des une dans que".split(), "de": "der die und das nicht mit ein".split(), "es": "el los que una por las con".split()}[lang]
    parts = {"en": "th ing er on sh nd".split(), "fr": "eau oi é ment tion eux".split(), "de": "ung heit sch ü ver keit".split(), "es": "ción ado ñ rr os ía".split()}[lang]
    words = [rng.choice(stop) if rng.random() < 0.35 else "".join(rng.choices(parts, k=rng.randint(2, 4))) for _ in range(n)]
    return " ".join(words)


#: Rows that every operator has to bear: nulls, blanks, ties, repeated rows, a long text, odd characters.
ODD = [
    (None, None, None, None, None),
    (None, "the id is null", "en", "a", 1),
    (900, None, "en", None, 0),
    (901, "", "fr", "b", 0),
    (902, " \t\n \x0b\x0c\r ", "de", "b", 0),
    (903, "12 345 !!! ???", None, "c", 1),
    (904, "word", "es", "c", 1),
    (905, prose(5, 120), "en", "d", 1),
    (905, prose(5, 120), "en", "d", 1),
    (906, prose(5, 120).upper(), "en", "d", 1),
    (907, prose(6, 30_000), "en", "d", 1),
    (908, "x" * 50_000, "en", "e", 1),
    (909, "nul \x00 and 𝔘𝔫𝔦 é́ \u200b end " * 30, "en", "e", 1),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some_docs(spark):
    """Texts in four languages, near and exact copies among them."""
    rows = []
    for i in range(120):
        lang = ("en", "fr", "de", "es")[i % 4]
        rows.append((i, prose(i, 60 + i, lang), lang, f"s{i % 5}", i))
    for i in range(120, 140):
        words = rows[i - 120][1].split()
        words[7] = "changed"
        rows.append((i, " ".join(words), rows[i - 120][2], "copies", i))
    rows += [(i, rows[3][1], "es", "copies", i) for i in range(140, 150)]
    return spark.createDataFrame(rows, SCHEMA)


def clash(df, *names):
    """``df`` with columns named like an operator's results."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("clash") for n in names if n not in df.columns})
