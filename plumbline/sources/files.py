"""Tabular files as text tables with ``_row_id`` in file order: CSV, TSV, JSON, JSON Lines, Excel, Parquet.

Only a file's first bytes are looked at on the driver; rows are read by Spark. An Excel sheet holds about a million
rows by its format, so one task parses one workbook.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.table import ROW, settled, work_folder
from . import spans

FORMATS = {".csv": "csv", ".tsv": "csv", ".txt": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".xlsx": "xlsx", ".parquet": "parquet"}
DELIMITERS = (",", ";", "\t", "|")
WRAPPERS = ("data", "records", "rows", "items", "results")
HEAD, MOST_LEVELS, MOST_XML = 1 << 16, 5, 200 << 20


class SourceError(ValueError):
    """A file that cannot be read as it is; nothing is guessed."""


@dataclass
class Ingested:
    df: DataFrame
    columns: list[str]
    format: str
    warnings: list[str] = field(default_factory=list)


def head(spark: SparkSession, path: str, size: int = HEAD) -> bytes:
    """The first bytes of a file, or of a folder's first file, through the session's own file systems; no more is read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    found = sorted((x.getPath().toString(), x.getLen()) for x in fs.listStatus(at) if x.isFile() and x.getPath().getName()[0] not in "._")
    start = next((name for name, n in found if n), None)
    if start is None:
        raise SourceError("The file is empty.")
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(start))
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def detect_format(name: str, start: bytes) -> str:
    """By extension first, then by the first bytes."""
    ext = "." + name.rsplit(".", 1)[-1].lower() if "." in name.rsplit("/", 1)[-1] else ""
    if ext == ".xls" or start.startswith(b"\xd0\xcf\x11\xe0"):
        raise SourceError("Old Excel files (.xls) are not read; save the workbook as .xlsx.")
    if ext in FORMATS:
        return FORMATS[ext]
    if start.startswith(b"PK\x03\x04"):
        return "xlsx"
    if start.startswith(b"PAR1"):
        return "parquet"
    body = start.lstrip(b"\xef\xbb\xbf \t\r\n")
    if body[:1] == b"[":
        return "json"
    if body[:1] == b"{":
        return "jsonl" if re.match(rb"\{[^\n]*\}\r?\n\s*\{", body) else "json"
    return "csv"


def encoding_of(start: bytes) -> str:
    """UTF-8, or UTF-16 by its mark; anything else is refused."""
    if start.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "UTF-16"
    try:
        start.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.start < len(start) - 4:  # else a character cut at the end of the head
            raise SourceError("The file is neither UTF-8 nor UTF-16 text.") from None
    return "UTF-8"


def sniff_delimiter(text: str) -> str:
    """The delimiter that gives the widest field count shared by four fifths of the first 20 lines, else a comma."""
    lines = [x for x in text.splitlines() if x.strip()][:20]
    best = (1, ",")
    for d in DELIMITERS:
        counts = [len(r) for r in csv.reader(lines, delimiter=d)]
        for width in set(counts):
            if width > best[0] and counts.count(width) >= 0.8 * len(counts):
                best = (width, d)
    return best[1]


def header(names: list[str | None]) -> list[str]:
    """Names trimmed; blanks become column_N, repeats get _2, _3, ..."""
    out: list[str] = []
    for i, n in enumerate(names, 1):
        name = base = (n or "").strip() or f"column_{i}"
        k = 2
        while name in out:
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return out


def in_file_order(df: DataFrame, name: str = ROW) -> DataFrame:
    """Rows of a file scan numbered from 0 in file order: by file, then by span of the file, then by place in it.

    A task may hold spans of several files, each of them whole and in order, so a row's place is its task's running
    number less the span's least. ``df`` is a scan, perhaps filtered; its spans are as many as its tasks at most."""
    rows = df.withColumns({"_file": F.col("_metadata.file_path"), "_from": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})
    spans = rows.groupBy("_file", "_from").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_file", "_from").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    spans = spans.select("_file", "_from", (before - F.col("_first")).alias("_shift"))
    return rows.join(spans, ["_file", "_from"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_file", "_from", "_at", "_shift")


def _named(rows: DataFrame, fmt: str, warnings: list[str]) -> Ingested:
    """(_row_id, cells) -> a table: the first row with text is the header, blank rows go, short rows are padded and
    longer ones widen the header."""
    filled = rows.withColumn("cells", F.transform("cells", lambda x: F.coalesce(x, F.lit("")))).where(F.exists("cells", lambda x: F.trim(x) != ""))
    first = filled.agg(F.min_by("cells", ROW).alias("cells"), F.min(ROW).alias("top"), F.max(F.size("cells")).alias("width")).first()
    if first["width"] is None:
        raise SourceError("The file has no rows.")
    names, top, width = list(first["cells"]), first["top"], first["width"]
    if width > len(names):
        warnings.append(f"Some rows have {width} cells under {len(names)} names; columns were added.")
    names = header(names + [None] * (width - len(names)))
    body = filled.where(F.col(ROW) > top)
    cells = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]
    return Ingested(body.select(*cells, (F.col(ROW) - top - 1).alias(ROW)), names, fmt, warnings)


def _width_of(line: Column, sep: str) -> Column:
    """Fields of a line: separators outside quoted parts, plus one."""
    plain = F.when(F.contains(line, F.lit('"')), F.regexp_replace(line, r'"(?:[^"]|"")*"', "")).otherwise(line)
    return F.size(F.split(plain, re.escape(sep))) if sep else F.lit(1)


def read_csv(spark: SparkSession, path: str, start: bytes | None = None) -> Ingested:
    """One pass over the lines finds the widest row and whether a quoted cell runs over a line's end. Where none does, rows
    are lines; else lines are put together to records by ``spans``. Either way the file is split over tasks. One task reads
    a file in UTF-16, or whose lines end with a carriage return alone."""
    start = head(spark, path) if start is None else start
    code = encoding_of(start)
    sep = sniff_delimiter(start.decode(code, errors="ignore").lstrip("\ufeff"))
    options = {"header": False, "sep": sep, "quote": '"', "escape": '"', "encoding": code, "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "nullValue": "\0", "emptyValue": "", "columnNameOfCorruptRecord": "_raw", "maxColumns": 100_000}
    lines = spark.read.text(path)
    width, open_cells = 1, 1
    if code == "UTF-8":
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        width, open_cells = lines.agg(F.coalesce(F.max(_width_of(F.col("value"), sep)), F.lit(1)), F.count_if(quotes % 2 == 1)).first()
    whole = code != "UTF-8" or bool(re.search(rb"\r[^\n]", start))
    sizes = F.arrow_udf(lambda a: pa.array([max((len(r) for r in csv.reader(io.StringIO(x.as_py()), delimiter=sep)), default=0) if x.as_py() else 0 for x in a], pa.int32()), T.IntegerType())

    def fields(n: int, raw: bool = False) -> T.StructType:
        return T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n)] + [T.StructField("_raw", T.StringType())] * raw)

    def load(n: int, raw: bool = False) -> DataFrame:
        return spark.read.options(**options, multiLine=whole).schema(fields(n, raw)).csv(path)

    if whole:
        # A row of another width keeps its raw text; ``c0`` is read beside it, since Spark refuses that text alone.
        width = load(1, raw=True).select("c0", sizes("_raw").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1)), F.count("c0")).first()[0] or 1
        rows = in_file_order(load(width))
    elif open_cells:
        records = settled(spans.csv_records(spark, path, sep))
        width = records.agg(F.max(sizes("value"))).first()[0] or 1
        plain = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if k not in ("header", "encoding")} | {"multiLine": "true"}
        parsed = F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)), plain)
        # Each record is parsed once, whatever its cells are asked for.
        rows = records.select(F.transform(F.array(parsed), lambda x: F.array(*[x[f"c{i}"] for i in range(width)]))[0].alias("cells"), ROW)
    else:
        rows = in_file_order(load(width))
    cells = F.col("cells") if "cells" in rows.columns else F.array(*[F.col(f"c{i}") for i in range(width)])
    last = lambda x: F.array_max(F.transform(x, lambda v, i: F.when(v.isNotNull(), i + 1).otherwise(0)))
    rows = rows.select(F.transform(F.array(cells), lambda x: F.slice(x, F.lit(1), F.greatest(last(x), F.lit(1))))[0].alias("cells"), ROW)
    rows = rows.withColumn("cells", F.transform("cells", lambda x, i: F.when((F.col(ROW) == 0) & (i == 0), F.ltrim(x, F.lit("\ufeff"))).otherwise(x)))
    return _named(rows, "csv", [])


def flatten(schema: T.StructType, prefix: str = "", path: str = "", level: int = 1) -> list[Column]:
    """Nested fields as dotted columns, five levels at most; lists and deeper objects as JSON text, missing as ''."""
    out: list[Column] = []
    for f in schema.fields:
        at, name = f"{path}`{f.name}`", f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType) and f.dataType.fields and level < MOST_LEVELS:
            out += flatten(f.dataType, f"{name}.", f"{at}.", level + 1)
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            out.append(F.coalesce(F.to_json(F.col(at)), F.lit("")).alias(name))
        else:
            out.append(F.coalesce(F.col(at).cast("string"), F.lit("")).alias(name))
    return out


def key_order(lines: DataFrame) -> list[str]:
    """Top-level keys of JSON text rows (value, _row_id) in the order first seen."""
    keys = lines.select(ROW, F.posexplode(F.json_object_keys("value")).alias("at", "key"))
    return [r["key"] for r in keys.groupBy("key").agg(F.min(F.struct(ROW, "at")).alias("o")).orderBy("o").select("key").collect()]


def read_jsonl(spark: SparkSession, path: str) -> Ingested:
    lines = in_file_order(spark.read.text(path).where(F.trim("value") != ""))
    schema = spark.read.option("primitivesAsString", True).json(path).schema
    if "_corrupt_record" in schema.fieldNames():
        raise SourceError("A line is not a JSON object.")
    order = [k for k in key_order(lines) if k in schema.fieldNames()]
    parsed = lines.select(F.from_json("value", schema, {"primitivesAsString": "true"}).alias("x"), ROW).select("x.*", ROW)
    return _records(parsed, T.StructType([schema[k] for k in order]), "jsonl")


def _records(df: DataFrame, schema: T.StructType, fmt: str) -> Ingested:
    columns = flatten(schema)
    out = df.select(*columns, ROW)
    return Ingested(out, [c for c in out.columns if c != ROW], fmt)


def _from_elements(spark: SparkSession, elements: DataFrame) -> Ingested:
    """Objects as text rows (value, _row_id), told their schema by one pass over them as JSON Lines in the shared folder."""
    path = f"{work_folder(spark)}/elements-{uuid.uuid4().hex}"
    elements.select("value").write.text(path, compression="gzip")
    schema = spark.read.option("primitivesAsString", True).json(path).schema
    if "_corrupt_record" in schema.fieldNames():
        raise SourceError("The file is not a JSON table.")
    order = [k for k in key_order(elements) if k in schema.fieldNames()]
    parsed = elements.select(F.from_json("value", schema, {"primitivesAsString": "true"}).alias("x"), ROW).select("x.*", ROW)
    return _records(parsed, T.StructType([schema[k] for k in order]), "json")


def read_json(spark: SparkSession, path: str) -> Ingested:
    """A list of objects, a list of lists, {columns, data}, or an object that wraps one list, three levels deep. A list of
    objects is split over tasks; the other forms are read by one task a file."""
    start = head(spark, path).lstrip(b"\xef\xbb\xbf \t\r\n")
    if re.match(rb"\[\s*\{", start):
        elements = settled(spans.json_elements(spark, path))
        if not elements.where("value NOT LIKE '{%'").head(1):
            return _from_elements(spark, elements)
    text = spark.read.text(path, wholetext=True)
    schema = spark.read.option("primitivesAsString", True).option("multiLine", True).json(path).schema
    if "_corrupt_record" in schema.fieldNames():
        if len(schema.fieldNames()) == 1:
            table = text.select(F.from_json("value", "array<array<string>>").alias("x")).where("x is not null")
            if not table.head(1):
                raise SourceError("The file is not a JSON table.")
            return _named(table.select(F.posexplode("x").alias(ROW, "cells")).withColumn(ROW, F.col(ROW).cast("long")), "json", [])
        return read_jsonl(spark, path)
    start = text.select(F.ltrim("value").substr(1, 1)).first()[0]
    at = F.col("x")
    if start == "[":
        rows = text.select(F.from_json("value", T.ArrayType(schema), {"primitivesAsString": "true"}).alias("x"), F.from_json("value", "array<string>").alias("raw"))
        element = schema
    else:
        rows, element, level = text.select(F.from_json("value", schema, {"primitivesAsString": "true"}).alias("x")), schema, 0
        names = element.fieldNames()
        if {"columns", "data"} <= set(names) and isinstance(element["data"].dataType, T.ArrayType) and isinstance(element["data"].dataType.elementType, T.ArrayType):
            cells = rows.select(F.concat(F.array(F.col("x.columns")), F.col("x.data")).alias("x")).select(F.posexplode("x").alias(ROW, "cells"))
            return _named(cells.withColumn(ROW, F.col(ROW).cast("long")), "json", [])
        while isinstance(element, T.StructType):
            lists = [f.name for f in element.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
            pick = lists[0] if len(lists) == 1 else next((w for w in WRAPPERS if w in lists), None)
            if pick is None:
                inner = [f.name for f in element.fields if isinstance(f.dataType, T.StructType)]
                if level == 2 or len(inner) != 1:
                    raise SourceError("The JSON holds no single list of records.")
                at, element, level = at[inner[0]], element[inner[0]].dataType, level + 1
                continue
            at, element = at[pick], element[pick].dataType.elementType
            break
        rows = rows.select(at.alias("x")).withColumn("raw", F.lit(None).cast("array<string>"))
    made = rows.select(F.posexplode("x").alias(ROW, "r"), "raw").withColumn("value", F.get("raw", F.col(ROW))).withColumn(ROW, F.col(ROW).cast("long"))
    order = [k for k in key_order(made.where("value is not null").select("value", ROW)) if k in element.fieldNames()] if start == "[" else []
    order += [k for k in element.fieldNames() if k not in order]
    return _records(made.select("r.*", ROW), T.StructType([element[k] for k in order]), "json")


# ---- Excel

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that are dates.
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])


def is_date_code(code: str) -> bool:
    """Whether a number format shows dates: day, month, year or hour letters outside quotes and brackets."""
    return bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower()))) and "general" not in code.lower()


def serial_to_text(serial: float, mac: bool = False) -> str:
    """An Excel day number as ISO text; the 1900 system has a day 60 that never was."""
    days, part = divmod(serial, 1)
    if not mac and int(days) == 60:
        day = "1900-02-29"
    else:
        base = dt.date(1904, 1, 1) if mac else dt.date(1899, 12, 31 if days < 60 else 30)
        day = (base + dt.timedelta(days=int(days))).isoformat()
    seconds = round(part * 86400)
    return day if not seconds else f"{day} {seconds // 3600:02d}:{seconds % 3600 // 60:02d}:{seconds % 60:02d}"


def _xml(book: zipfile.ZipFile, name: str) -> ElementTree.Element:
    try:
        info = book.getinfo(name)
    except KeyError:
        raise SourceError(f"The workbook lacks {name}.") from None
    if info.file_size > MOST_XML:
        raise SourceError("The workbook is too large when unpacked.")
    raw = book.read(info)
    if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw:
        raise SourceError("The workbook defines document types, which are refused.")
    return ElementTree.fromstring(raw)


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def sheet_rows(body: bytes, sheet: str | None = None, most_columns: int = 500) -> tuple[list[list[str]], list[str]]:
    """(rows of cell texts, warnings) of the named sheet or the first visible one."""
    try:
        book = zipfile.ZipFile(io.BytesIO(body))
    except zipfile.BadZipFile:
        raise SourceError("The file is not a workbook.") from None
    root = _xml(book, "xl/workbook.xml")
    sheets = [(s.get("name"), s.get(_REL), s.get("state", "visible")) for s in root.iter(f"{_NS}sheet")]
    if sheet is None:
        found = next((s for s in sheets if s[2] == "visible"), None)
    else:
        found = next((s for s in sheets if s[0] == sheet), None) or next((s for s in sheets if s[0].lower() == sheet.lower()), None)
    if found is None:
        raise SourceError(f"No such sheet; there are {', '.join(s[0] for s in sheets)}.")
    targets = {r.get("Id"): r.get("Target", "") for r in _xml(book, "xl/_rels/workbook.xml.rels")}
    part = targets.get(found[1], "")
    part = part.lstrip("/") if part.startswith("/") else f"xl/{part}"
    if ".." in part or part not in book.namelist():
        raise SourceError("A sheet points outside the workbook.")
    mac = any(p.get("date1904") in ("1", "true") for p in root.iter(f"{_NS}workbookPr"))
    strings = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in _xml(book, "xl/sharedStrings.xml").iter(f"{_NS}si")] if "xl/sharedStrings.xml" in book.namelist() else []
    dated: list[bool] = []
    if "xl/styles.xml" in book.namelist():
        styles = _xml(book, "xl/styles.xml")
        codes = {int(n.get("numFmtId")): n.get("formatCode", "") for n in styles.iter(f"{_NS}numFmt")}
        block = styles.find(f"{_NS}cellXfs")
        ids = [int(x.get("numFmtId", 0)) for x in block] if block is not None else []
        dated = [is_date_code(codes[i]) if i in codes else i in DATE_FORMATS for i in ids]
    rows, errors, uncached = [], 0, 0
    for r in _xml(book, part).iter(f"{_NS}row"):
        cells: dict[int, str] = {}
        for at, c in enumerate(r.iter(f"{_NS}c")):
            i = _column(c.get("r")) if c.get("r") else at
            if i >= most_columns:
                raise SourceError(f"A row reaches beyond {most_columns} columns.")
            kind, v = c.get("t", "n"), c.find(f"{_NS}v")
            raw = v.text if v is not None and v.text is not None else None
            if kind == "inlineStr":
                cells[i] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
            elif raw is None:
                uncached += c.find(f"{_NS}f") is not None
            elif kind == "s":
                cells[i] = strings[int(raw)]
            elif kind == "b":
                cells[i] = "TRUE" if raw == "1" else "FALSE"
            elif kind == "e":
                errors += 1
            elif kind == "n":
                style = int(c.get("s", 0))
                number = float(raw)
                if style < len(dated) and dated[style]:
                    cells[i] = serial_to_text(number, mac)
                else:
                    cells[i] = str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)
            else:
                cells[i] = raw
        rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    warnings = [f"{errors} error cells were read as blank."] * bool(errors) + [f"{uncached} formulas without a stored value were read as blank."] * bool(uncached)
    return rows, warnings


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> Ingested:
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body in b.column("content"):
                rows, warned = sheet_rows(body.as_py(), sheet)
                ids = [*range(len(rows)), *[-1] * len(warned)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([*rows, *[[w] for w in warned]], pa.list_(pa.string()))], names=[ROW, "cells"])

    parsed = files.mapInArrow(run, f"{ROW} long, cells array<string>").persist()
    warned = [r["cells"][0] for r in parsed.where(F.col(ROW) < 0).collect()]
    return _named(parsed.where(F.col(ROW) >= 0), "xlsx", warned)


def read_table(spark: SparkSession, path: str, fmt: str | None = None, sheet: str | None = None) -> Ingested:
    """A file by its format; Parquet keeps its types as text like any other source."""
    start = b"" if fmt == "parquet" or path.endswith(".parquet") else head(spark, path)
    fmt = fmt or detect_format(path, start or b"PAR1")
    if fmt == "csv":
        return read_csv(spark, path, start)
    if fmt == "json":
        return read_json(spark, path)
    if fmt == "jsonl":
        return read_jsonl(spark, path)
    if fmt == "xlsx":
        return read_xlsx(spark, path, sheet)
    if fmt == "parquet":
        rows = in_file_order(spark.read.parquet(path))
        return Ingested(rows.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in rows.columns if c != ROW], ROW), [c for c in rows.columns if c != ROW], "parquet")
    raise SourceError(f"“{fmt}” is not a format that is read.")
