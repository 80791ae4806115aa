"""Snapshots named by their content, results as files, and remote files behind strict address rules."""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
import socket
from dataclasses import dataclass
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.table import ROW, AnalysisTable, work_folder

#: Text that a spreadsheet would run as a formula.
FORMULA = r"^[=+\-@\t\r]"
SECRET_KEYS = ("key", "token", "secret", "password", "passwd", "pwd", "sig", "signature", "auth", "credential", "session")


def fingerprint(df: DataFrame) -> str:
    """A hash of a table's rows in their order and of its column names, from partial sums over rows."""
    cols = [c for c in df.columns if c != ROW]
    whole = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in cols], *([F.col(ROW).cast("string")] if ROW in df.columns else [])), 256)
    part = lambda a: F.sum(F.conv(F.substring(whole, a, 15), 16, 10).cast("decimal(38,0)"))
    row = df.agg(F.count("*").alias("n"), *[part(a).alias(f"p{a}") for a in (1, 16, 31, 46)]).first()
    return hashlib.sha256(repr((cols, row["n"], *[str(row[f"p{a}"]) for a in (1, 16, 31, 46)])).encode()).hexdigest()


def snapshot(df: DataFrame, root: str) -> tuple[str, bool]:
    """(folder, written): the table under its fingerprint; an equal one is there already and is not written again."""
    path = f"{root.rstrip('/')}/{fingerprint(df)[:32]}"
    spark = df.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):  # a half-written folder has no such mark
        return path, False
    df.write.mode("overwrite").parquet(path)
    return path, True


def cell(c: Column, numeric: bool) -> Column:
    """A cell as written: whole numbers without a point, null empty, formula-like text behind an apostrophe."""
    if numeric:
        n = c.cast("double")
        return F.when(n.isNull(), "").when((n == F.floor(n)) & (F.abs(n) < 1e15), n.cast("decimal(20,0)").cast("string")).otherwise(n.cast("string"))
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike(FORMULA), F.concat(F.lit("'"), text)).otherwise(text)


def csv_cells(table: AnalysisTable) -> DataFrame:
    return table.df.select(*[cell(F.col(f"`{c}`"), c in table.numeric).alias(c) for c in table.columns])


def csv_lines(table: AnalysisTable) -> DataFrame:
    """One ``line`` per row, quoted where needed, in row order, the header first."""
    quote = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    own = csv_cells(table)
    head = ",".join('"' + c.replace('"', '""') + '"' if re.search('[",\r\n]', c) else c for c in own.columns)
    rows = table.df.select(F.concat_ws(",", *[quote(cell(F.col(f"`{c}`"), c in table.numeric)) for c in table.columns]).alias("line"), *[F.col(f"`{o}`").alias(f"_o{i}") for i, o in enumerate(table.order)])
    first = table.df.sparkSession.createDataFrame([(head,)], "line string")
    return first.unionByName(rows.orderBy(*[f"_o{i}" for i in range(len(table.order))]).select("line"))


def to_csv(table: AnalysisTable) -> str:
    """The whole table as one text with a byte-order mark and CRLF: for downloads; use ``write_csv`` for large ones."""
    return "﻿" + "".join(r["line"] + "\r\n" for r in csv_lines(table).toLocalIterator())


def write_csv(table: AnalysisTable, path: str) -> None:
    """Part files, each with a header, written by the executors."""
    csv_cells(table).write.options(header=True, quote='"', escape='"', emptyValue="", lineSep="\r\n").csv(path)


def write_aggregates(frames: dict[str, DataFrame], path: str) -> None:
    """Aggregates only, a folder each, in as many files as their size asks for; rows of the data are never exported."""
    for name, df in frames.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def download_name(goal: str | None, run_id: str) -> str:
    slug = re.sub("[^a-z0-9]+", "-", (goal or "").lower()).strip("-")[:48]
    return f"{slug or 'run'}-{run_id}-cleaned.csv"


def name_of(goal: Column, run_id: Column) -> Column:
    """``download_name`` of many runs at once."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(goal, F.lit(""))), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.concat(F.coalesce(F.nullif(F.substring(slug, 1, 48), F.lit("")), F.lit("run")), F.lit("-"), run_id, F.lit("-cleaned.csv"))


def sample_dataset(spark: SparkSession) -> DataFrame:
    """A small sales table: 12 months, 2 regions, 3 categories."""
    rows = []
    for m in range(12):
        for r, region in enumerate(("North", "South")):
            for c, category in enumerate(("Hardware", "Software", "Services")):
                units = 40 + 3 * m + 10 * r + 5 * c
                rows.append((len(rows), f"2025-{m + 1:02d}", region, category, str(units * (12 + 4 * c)), str(units)))
    return spark.createDataFrame(rows, f"{ROW} long, month string, region string, category string, revenue string, units string")


# ---- remote files


class AddressError(ValueError):
    """An address that is not fetched."""


@dataclass(frozen=True)
class Address:
    host: str
    port: int
    path: str
    ip: str


def check_address(url: str, resolve=socket.getaddrinfo) -> Address:
    """https only, no credentials or secret-like query keys, public addresses only; the checked IP is the one to use."""
    parts = urlsplit(url)
    if parts.scheme != "https" or not parts.hostname:
        raise AddressError("Only https addresses are fetched.")
    if parts.username or parts.password:
        raise AddressError("An address must not carry a user name or password.")
    if any(any(s in k.lower() for s in SECRET_KEYS) for k, _ in parse_qsl(parts.query, keep_blank_values=True)):
        raise AddressError("An address must not carry a credential in its query.")
    port = parts.port or 443
    ips = {x[4][0] for x in resolve(parts.hostname, port)}
    if not ips or any(not ipaddress.ip_address(i).is_global for i in ips):
        raise AddressError("Only public addresses are fetched.")
    return Address(parts.hostname, port, parts.path + ("?" + parts.query) * bool(parts.query), sorted(ips)[0])


def fetch(url: str, most: int = 4 << 20, seconds: float = 20.0, resolve=socket.getaddrinfo) -> bytes:
    """The body behind an address, within a size and a time, without redirects; the connection goes to the checked IP."""
    import http.client
    import ssl
    import time

    a = check_address(url, resolve)
    end = time.monotonic() + seconds
    raw = socket.create_connection((a.ip, a.port), timeout=seconds)
    with ssl.create_default_context().wrap_socket(raw, server_hostname=a.host) as sock:
        sock.sendall(f"GET {a.path or '/'} HTTP/1.1\r\nHost: {a.host}\r\nConnection: close\r\nAccept: */*\r\n\r\n".encode())
        answer = http.client.HTTPResponse(sock)
        answer.begin()
        if answer.status != 200:
            raise AddressError(f"The address answered {answer.status}.")
        body = bytearray()
        while chunk := answer.read(1 << 16):
            body += chunk
            if len(body) > most or time.monotonic() > end:
                raise AddressError("The file is too large or too slow.")
    return bytes(body)


def next_check(now: dt.datetime, every: dt.timedelta, failures: int = 0) -> dt.datetime:
    """When a source is looked at again: doubled for each failure, a day at most."""
    if not dt.timedelta(minutes=15) <= every <= dt.timedelta(days=7):
        raise ValueError("A source is checked every 15 minutes to 7 days.")
    wait = every * 2**failures
    return now + (min(wait, max(every, dt.timedelta(days=1))) if failures else every)
