"""CSV with the engine's type rules, read and written by Spark."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import type_of

# What a whole column must look like to become a number, a date or a boolean.
# A date is told by how it begins; one that cannot be read then is null.
NUMBER = r"^-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DATE = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2})?"
BOOLEAN = r"^(true|false)$"


def _typed(c: Column, kind: str) -> Column:
    if kind == "int":
        return c.try_cast("double").try_cast("int")
    if kind == "timestamp_ntz":
        return F.coalesce(c.try_cast("timestamp").cast("timestamp_ntz"), c.try_cast("timestamp_ntz"))
    return c if kind == "string" else F.trim(c).try_cast(kind)


def typed(raw: DataFrame, dtypes: Mapping[str, str] | None = None) -> DataFrame:
    """Columns of strings with empty ones null, each given or inferred from all its values in one pass."""
    dtypes = dtypes or {}
    raw = raw.select(*(F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).alias(c) for c in raw.columns))
    open_ = [c for c in raw.columns if c not in dtypes]
    fits = {}
    if open_:
        tests = [F.bool_and(F.col(f"`{c}`").rlike(p)).alias(f"{i}_{k}") for i, c in enumerate(open_) for k, p in enumerate((NUMBER, DATE, BOOLEAN))]
        r = raw.agg(*tests).first()
        for i, c in enumerate(open_):
            fits[c] = next((t for k, t in enumerate(("double", "timestamp_ntz", "boolean")) if r[f"{i}_{k}"]), "string")
    return raw.select(*(_typed(F.col(f"`{c}`"), type_of(dtypes[c]) if c in dtypes else fits[c]).alias(c) for c in raw.columns))


def read_csv(spark: SparkSession, path: str | list[str], *, delimiter: str = ",", dtypes: Mapping[str, str] | None = None) -> DataFrame:
    """Any path or URI that Spark reads, with a header. Empty fields are null."""
    raw = spark.read.csv(path, header=True, sep=delimiter, inferSchema=False, multiLine=True, escape='"', nullValue="", emptyValue="")
    return typed(raw, dtypes)


def read_csv_url(spark: SparkSession, url: str, *, delimiter: str = ",", dtypes: Mapping[str, str] | None = None, timeout: float = 60) -> DataFrame:
    """A small CSV behind a web address, fetched by the driver; other URIs go to ``read_csv``."""
    if not url.startswith(("http://", "https://")):
        return read_csv(spark, url, delimiter=delimiter, dtypes=dtypes)
    from urllib.request import urlopen

    with urlopen(url, timeout=timeout) as answer:  # raises for any status but success
        return from_text(spark, answer.read().decode("utf-8-sig"), delimiter=delimiter, dtypes=dtypes)


def from_text(spark: SparkSession, text: str, *, delimiter: str = ",", dtypes: Mapping[str, str] | None = None) -> DataFrame:
    """CSV held in a string."""
    import csv
    import io

    rows = list(csv.reader(io.StringIO(text), delimiter=delimiter))
    if not rows:
        raise ValueError("A CSV text needs a header")
    names = rows[0]
    body = [tuple((r + [""] * len(names))[: len(names)]) for r in rows[1:] if r]
    return typed(spark.createDataFrame(body, ", ".join(f"`{n}` string" for n in names)), dtypes)


def _field(c: Column, kind: str, delimiter: str) -> Column:
    text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if kind.startswith(("timestamp", "date")) else c.cast("string")
    if kind in ("double", "float"):
        text = F.when((c == F.floor(c)) & (F.abs(c) < 1e15), F.floor(c).cast("string")).otherwise(text)
    special = text.contains(delimiter) | text.contains('"') | text.contains("\n")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(special, quoted).otherwise(text), F.lit(""))


def csv_lines(df: DataFrame, delimiter: str = ",") -> DataFrame:
    """(line): each row as text; null is empty, dates are ISO, fields are quoted where they must be."""
    return df.select(F.concat_ws(delimiter, *(_field(F.col(f"`{n}`"), t, delimiter) for n, t in df.dtypes)).alias("line"))


def to_text(df: DataFrame, delimiter: str = ",") -> str:
    """Header and rows as one string on the driver, without a last newline; for small results."""
    head = delimiter.join('"' + n.replace('"', '""') + '"' if any(x in n for x in (delimiter, '"', "\n")) else n for n in df.columns)
    lines: Iterable[str] = (r["line"] for r in csv_lines(df, delimiter).collect())
    return "\n".join([head, *lines])


def write_csv(df: DataFrame, path: str, *, delimiter: str = ",", mode: str = "error") -> None:
    """Part files with headers, written by the executors."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    out = df.write.mode(mode).options(header=True, sep=delimiter, nullValue="", emptyValue='""', escape='"', timestampFormat=iso, timestampNTZFormat=iso)
    out.csv(path)
