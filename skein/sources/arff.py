"""ARFF: relations with declared attributes, read and written as DataFrames.

The header is parsed from the first lines on the driver; data rows are parsed on
executors.  Quoted values, ``?`` for null, comments, sparse rows ``{i v, ...}``
and quoted type names are understood.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..checkpoints import files_of
from .sinks import ordered_text

# Fixed type names of the format.
TYPES = {"NUMERIC": DoubleType(), "REAL": DoubleType(), "INTEGER": IntegerType(), "STRING": StringType()}


@dataclass
class Header:
    relation: str
    description: str
    attributes: list[tuple[str, str | list[str]]]

    def schema(self) -> StructType:
        return StructType([StructField(n, TYPES[t] if isinstance(t, str) else StringType()) for n, t in self.attributes])


def unquoted(s: str) -> str:
    s = s.strip()
    if len(s) > 1 and s[0] == s[-1] and s[0] in "'\"":
        s = s[1:-1]
    return re.sub(r"\\(.)", r"\1", s)


def values_of(row: str) -> list[str | None]:
    """The values of a dense row; unquoted ? is null."""
    out: list[str | None] = []
    for quoted, plain in re.findall(r"\s*(?:'((?:[^'\\]|\\.)*)'|([^,]*))\s*(?:,|$)", row)[: _commas(row) + 1]:
        text = re.sub(r"\\(.)", r"\1", quoted) if quoted or not plain else plain.strip().strip('"')
        out.append(None if plain.strip() == "?" else text)
    return out


def _commas(row: str) -> int:
    """Commas outside quotes."""
    return re.sub(r"'(?:[^'\\]|\\.)*'", "", row).count(",")


def parse_header(text: str) -> Header:
    relation, description, attributes = "", [], []
    for line in text.replace("\r", "").split("\n"):
        line = line.strip()
        if line.startswith("%"):
            if not relation:
                description.append(re.sub(r"^%\s?", "", line))
        elif line.upper().startswith("@RELATION"):
            relation = unquoted(line.split(None, 1)[1])
        elif line.upper().startswith("@ATTRIBUTE"):
            found = re.match(r"@attribute\s+('(?:[^'\\]|\\.)*'|\"[^\"]*\"|\S+)\s+(.*)$", line, re.I)
            name, kind = unquoted(found[1]), found[2].strip()
            plain = unquoted(kind).upper()
            attributes.append((name, plain if plain in TYPES else [v or "" for v in values_of(kind.strip("{} "))]))
        elif line.upper().startswith("@DATA"):
            break
    return Header(relation, "\n".join(description), attributes)


#: Lines that a header may have.
MOST_HEADER = 100_000


def header_of(spark: SparkSession, path: str, most: int = MOST_HEADER) -> Header:
    """The header of a file, or of the first files of a folder: the lines up to @DATA.

    They are read in order from the start, so comments among the rows don't
    matter.  Over ``most`` lines without @DATA are refused, as is a file that ends before it.
    """
    at, files = files_of(spark, path)
    found = sorted((str(f.getPath()) for f in files.globStatus(at) or []), key=str)
    names = [x for top in found for x in (sorted(str(f.getPath()) for f in files.listStatus(files_of(spark, top)[0]) if not f.getPath().getName().startswith(("_", "."))))]
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    lines: list[str] = []
    for name in names:
        file, _ = files_of(spark, name)
        codec, stream = codecs.getCodec(file), files.open(file)
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec is not None else stream, "UTF-8"))
        try:
            while (line := reader.readLine()) is not None:
                if line.strip().upper().startswith("@DATA"):
                    return parse_header("\n".join(lines))
                lines.append(line)
                if len(lines) > most:
                    raise ValueError(f"{path} has over {most} lines before @DATA")
        finally:
            reader.close()
    raise ValueError(f"{path} has no @DATA")


def read(spark: SparkSession, path: str, most: int = MOST_HEADER) -> tuple[Header, DataFrame]:
    """Header and rows.  The file is split by lines; rows are what follows @DATA.

    All header lines start with @ or %, so rows are told apart without order.
    """
    lines = spark.read.text(path)
    header = header_of(spark, path, most)
    names = [n for n, _ in header.attributes]
    body = lines.where(~F.col("value").rlike(r"(?i)^\s*(@relation|@attribute|@data|%|$)"))

    def split_row(row: str) -> list[str | None]:
        if row.strip().startswith("{"):
            out: list[str | None] = ["0" if isinstance(k, str) and k != "STRING" else (k[0] if isinstance(k, list) else "") for _, k in kinds]
            for part in filter(None, (x or "" for x in values_of(row.strip().strip("{} ")))):
                at, _, value = part.partition(" ")
                out[int(at)] = None if value.strip() == "?" else unquoted(value)
            return out
        return values_of(row)

    @F.pandas_udf("array<string>")
    def split(rows: pd.Series) -> pd.Series:
        return rows.map(split_row)

    kinds = header.attributes
    parsed = body.select(split("value").alias("v"))
    cast = lambda i, f: F.get("v", F.lit(i)).try_cast(f.dataType).alias(names[i])
    return header, parsed.select(*[cast(i, f) for i, f in enumerate(header.schema().fields)])


def quoted(value: Column) -> Column:
    """A value between quotes, with quotes and backslashes escaped and line ends as spaces; null is ?."""
    safe = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.coalesce(F.concat(F.lit("'"), F.regexp_replace(safe, r"[\r\n]+", " "), F.lit("'")), F.lit("?"))


def header_lines(header: Header) -> list[str]:
    name = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    kinds = [(n, k if isinstance(k, str) else "{" + ",".join(name(v) for v in k) + "}") for n, k in header.attributes]
    return [*[f"% {d}" for d in header.description.split("\n") if d], f"@RELATION {name(header.relation)}", "", *[f"@ATTRIBUTE {name(n)} {k}" for n, k in kinds], "", "@DATA"]


def rows_as_text(df: DataFrame, header: Header) -> DataFrame:
    """(value): a line for each row.  A nominal value that is not declared is an error."""
    def one(name: str, kind: str | list[str]) -> Column:
        c = F.col(f"`{name}`")
        if isinstance(kind, str):
            return quoted(c) if kind == "STRING" else F.coalesce(c.cast("string"), F.lit("?"))
        known = c.isNull() | c.isin(*kind)
        return F.when(known, quoted(c)).otherwise(F.raise_error(F.concat(F.lit(f"undeclared value of {name}: "), c)))

    return df.select(F.concat_ws(",", *[one(n, k) for n, k in header.attributes]).alias("value"))


def write(df: DataFrame, header: Header, path: str) -> None:
    """A folder of text files whose names sort in the order of the text: the header, the rows, three closing comments."""
    line = lambda text: df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1)
    ordered_text(path, line("\n".join(header_lines(header))), rows_as_text(df, header), line("%\n%\n%"))
