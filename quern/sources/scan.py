"""SRC-*: reading delimited text, JSON and Parquet, with header rules, flattening and type inference."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.names import q, standardise_headers, text, unique_headers
from quern.sources.quoted import quoted_records

# Extensions, delimiters in order of preference, wrapper keys, and text that reads as missing.
TEXT_EXTENSIONS = {".csv", ".tsv", ".txt", ".tab"}
JSON_EXTENSIONS = {".json", ".jsonl", ".ndjson"}
PARQUET_EXTENSIONS = {".parquet", ".pqt"}
DELIMITERS = (",", "\t", ";", "|")
WRAPPERS = ("data", "records", "items", "rows")
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
             "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# cp1252 is read as ISO 8859-1, which Spark accepts; the two differ only in these 32 code points.
READ_AS = {"cp1252": "iso-8859-1"}
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_CP1252 = "".join(bytes([b]).decode("cp1252", errors="replace").replace(chr(0xFFFD), chr(b)) for b in range(0x80, 0xA0))
_CORRUPT = "__bad_row__"


@dataclass
class ScanMetadata:
    filename: str
    extension: str
    file_size_kb: float
    detected_encoding: str | None
    detected_delimiter: str | None
    format: str
    rows: int | None = None
    columns: int | None = None

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass
class TextShape:
    encoding: str
    size_kb: float
    lines: int
    open_quotes: bool     # some line has an odd number of quotes: a quoted field goes on in the next line


def text_shape(spark: SparkSession, path: str) -> TextShape:
    """SRC-3, SRC-9: encoding, size and quoting of all files under a path, from one pass over all their lines. The text
    source hands on the bytes of a line as they are, and splits files of any size; the text is UTF-8 if every line is."""
    lines = spark.read.text(path)
    found = lines.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("size")).groupBy("f").agg(
        F.max("size").alias("size"), F.count("*").alias("n"),
        F.expr("count_if(NOT is_valid_utf8(value))").alias("bad"),
        F.expr("""count_if(pmod(length(value) - length(replace(value, '"', '')), 2) = 1)""").alias("open"))
    size, n, bad, opened = found.agg(F.sum("size"), F.sum("n"), F.sum("bad"), F.sum("open")).first()
    if not n:
        raise ValueError(f"no rows in {path!r}")
    return TextShape("cp1252" if bad else "utf-8", round(size / 1024, 2), n, opened > 0)


def detect_encoding(spark: SparkSession, path: str) -> tuple[str, float]:
    """SRC-3: (encoding, size in kB)."""
    shape = text_shape(spark, path)
    return shape.encoding, shape.size_kb


def sniff_delimiter(spark: SparkSession, path: str, encoding: str = "utf-8") -> str:
    """SRC-2: the candidate that splits every one of the first lines into the same number (> 1) of fields, most fields
    first; else the most frequent candidate; else a comma."""
    lines = [r[0] for r in spark.read.option("encoding", READ_AS.get(encoding, encoding)).text(path).limit(10).collect() if r[0]]
    return best_delimiter(lines)


def best_delimiter(lines: list[str]) -> str:
    def outside_quotes(line: str, mark: str) -> int:
        return sum(part.count(mark) for part in line.split('"')[::2])
    counts = {d: [outside_quotes(line, d) for line in lines] for d in DELIMITERS}
    steady = [d for d in DELIMITERS if counts[d] and min(counts[d]) == max(counts[d]) > 0]
    if steady:
        return max(steady, key=lambda d: counts[d][0])
    best = max(DELIMITERS, key=lambda d: sum(counts[d]))
    return best if sum(counts[best]) else ","


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None,
                   na_tokens=NA_TOKENS, infer_types: bool = True, shape: TextShape | None = None, stage=None) -> DataFrame:
    """SRC-1: every column is read as text, short rows are padded, rows with too many fields are skipped; then headers
    and types follow our own rules. Files are split over tasks, also where quoted fields hold line breaks (see quoted.py).
    Only files with such fields that also hold lone carriage returns, which a reader may take for line breaks or not, are
    read as a whole. `stage` keeps the parsed text where later passes read it (see staging.py)."""
    shape = shape or text_shape(spark, path)
    encoding = encoding or shape.encoding
    delimiter = delimiter or ("\t" if os.path.splitext(path)[1].lower() in (".tsv", ".tab")
                              else sniff_delimiter(spark, path, encoding))
    reader = (spark.read.option("sep", delimiter).option("encoding", READ_AS.get(encoding, encoding)).option("mode", "PERMISSIVE").option("columnPruning", False)
              .option("quote", '"').option("escape", '"').option("multiLine", shape.open_quotes))
    by_split = shape.open_quotes and spark.read.option("lineSep", "\n").text(path).count() == shape.lines
    header = reader.csv(path).first()
    if header is None:
        raise ValueError(f"{path!r} holds no rows")
    marks = str.maketrans(_C1, _CP1252) if encoding == "cp1252" else {}
    names = unique_headers([h.lstrip(chr(0xFEFF)).translate(marks) if h else h for h in header])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(_CORRUPT, T.StringType())])
    if by_split:
        options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
        ddl = ", ".join(f"{q(f.name)} string" for f in schema.fields)
        df = quoted_records(spark, path, delimiter, READ_AS.get(encoding, encoding)).select(F.from_csv("record", ddl, options).alias("r")).select("r.*")
    else:
        df = (reader.option("header", True).option("enforceSchema", True).schema(schema)
              .option("columnNameOfCorruptRecord", _CORRUPT).csv(path))
    # separators outside quotes in the raw line of a row that does not fit
    mark = text(delimiter)
    bare = f"regexp_replace({_CORRUPT}, '\"([^\"]|\"\")*\"', '')"
    too_long = f"{_CORRUPT} IS NOT NULL AND length({bare}) - length(replace({bare}, {mark}, '')) > {len(names) - 1}"
    # the second test always holds; it keeps a real column in the scan, which Spark requires beside the raw line
    df = df.where(f"NOT ({too_long}) AND length(coalesce({q(names[0])}, '')) >= 0").drop(_CORRUPT)
    df = decode(df, encoding)
    listed = ", ".join(text(t) for t in na_tokens)
    df = df.selectExpr(*[f"CASE WHEN {q(n)} NOT IN ({listed}) THEN {q(n)} END AS {q(n)}" for n in names])
    df = stage(df) if stage else df
    return infer_text_types(df) if infer_types else df


def decode(df: DataFrame, encoding: str | None) -> DataFrame:
    if encoding != "cp1252":
        return df
    return df.selectExpr(*[f"translate({q(f.name)}, {text(_C1)}, {text(_CP1252)}) AS {q(f.name)}"
                           if isinstance(f.dataType, T.StringType) else q(f.name) for f in df.schema.fields])


def infer_text_types(df: DataFrame) -> DataFrame:
    """SRC-8: text columns whose every value is a whole number, a number or true/false take that type; dates stay text.
    One grouped aggregate over stacked columns decides for all of them."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    cells = df.selectExpr(f"stack({len(texts)}, {', '.join(f'{i}, {q(c)}' for i, c in enumerate(texts))}) AS (col, v)")
    whole, real = text(r"^\s*[+-]?\d{1,18}\s*$"), text(r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$")
    found = cells.where("v IS NOT NULL").groupBy("col").agg(
        F.count("*").alias("n"), F.expr(f"count_if(v RLIKE {whole})").alias("whole"),
        F.expr(f"count_if(v RLIKE {real})").alias("real"),
        F.expr("count_if(v IN ('True', 'False', 'TRUE', 'FALSE', 'true', 'false'))").alias("flag")).collect()
    kind = {texts[r["col"]]: "bigint" if r["whole"] == r["n"] else "double" if r["real"] == r["n"]
            else "boolean" if r["flag"] == r["n"] else None for r in found}
    return df.selectExpr(*[f"try_cast(trim({q(c)}) AS {kind[c]}) AS {q(c)}" if kind.get(c) else q(c) for c in df.columns])


def flatten(df: DataFrame) -> DataFrame:
    """SRC-5: nested objects become dotted columns at every depth; lists and maps left over become JSON text."""
    def walk(schema: T.StructType, path: list[str]) -> list[str]:
        out = []
        for f in schema.fields:
            here = path + [f.name]
            ref = ".".join(q(p) for p in here)
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, here)
            elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                out.append(f"to_json({ref}) AS {q('.'.join(here))}")
            else:
                out.append(f"{ref} AS {q('.'.join(here))}")
        return out
    return df.selectExpr(*walk(df.schema, []))


def read_json(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """SRC-4: JSON Lines (split over tasks), a list of records, an object that wraps a list, or one object. Lines whose first
    one is a whole object are JSON Lines, and then a line that is no JSON is an error that tells how many there are."""
    charset = READ_AS.get(encoding, encoding)
    first = spark.read.option("encoding", charset).text(path).where("trim(value) <> ''").first()
    try:
        by_line = first is not None and isinstance(json.loads(first[0].lstrip(chr(0xFEFF))), dict)
    except ValueError:
        by_line = False
    reader = spark.read.option("encoding", charset).option("columnNameOfCorruptRecord", _CORRUPT)
    df = reader.option("multiLine", not by_line).json(path)
    if _CORRUPT in df.columns:
        if not by_line or df.columns == [_CORRUPT]:
            raise ValueError(f"{path!r} is neither JSON nor JSON Lines")
        bad = spark.read.text(path).where("trim(value) <> '' AND try_parse_json(value) IS NULL")
        raise ValueError(f"{path!r} has {bad.count()} lines that are no JSON, e.g. {[r[0][:200] for r in bad.take(1)]!r}")
    for key in WRAPPERS:
        kind = next((f.dataType for f in df.schema.fields if f.name == key), None)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            df = df.select(F.inline(q(key)))
            break
    return decode(flatten(df), encoding)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: nested columns are flattened as in JSON."""
    return flatten(spark.read.parquet(path))


def scan(spark: SparkSession, path: str, stage=None, **options) -> tuple[DataFrame, ScanMetadata]:
    """SRC-1..9: read by extension (unknown extensions as delimited text), with metadata; an empty table raises. `stage`: a
    Staging that text and JSON are parsed into once, before types are inferred and rows are counted."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    encoding = delimiter = None
    if ext in PARQUET_EXTENSIONS:
        df, kind = standardise_headers(read_parquet(spark, path)), "parquet"
        files = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s")).distinct()
        size = round((files.agg(F.sum("s")).first()[0] or 0) / 1024, 2)
    elif ext in JSON_EXTENSIONS:
        encoding, size = detect_encoding(spark, path)
        df = read_json(spark, path, encoding)
        df, kind = standardise_headers(stage(df) if stage else df), "json"
    else:
        shape = text_shape(spark, path)
        encoding, size = shape.encoding, shape.size_kb
        delimiter = options.pop("delimiter", None) or (
            "\t" if ext in (".tsv", ".tab") else sniff_delimiter(spark, path, encoding))
        df = read_delimited(spark, path, delimiter, encoding, shape=shape, stage=stage, **options)
        kind = "tsv" if delimiter == "\t" else "csv"
    if df.isEmpty():
        raise ValueError(f"{path!r} holds no rows")
    meta = ScanMetadata(os.path.basename(path), ext, size, encoding, delimiter, kind, df.count(), len(df.columns))
    return df, meta
