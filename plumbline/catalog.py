"""Every registered query with its DuckDB SQL, on the driver's tables.

A query is a function of (spark, folder); its SQL reads tables of the same names. Names follow the operator
inventory. ``holed`` plants blanks into ``orders`` alike on both sides, so null rules are exercised.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_tables
from .functions import claims, dates, numbers, text
from .operators import analysis, clean, detectors, experiments, governance, joins, maintenance, models
from .operators import query as q
from .operators.table import ROW, AnalysisTable, number_rows
from .plans import stages
from .sources import files, store
from .streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def add(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


HOLED = """CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END AS priority,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderstatus AS status, CAST(o_custkey AS DOUBLE) AS cust"""
WITH = f"WITH t AS (SELECT o_orderkey, o_orderdate, {HOLED} FROM orders) "
DEC = "CAST(sum(CAST({0} AS DECIMAL(28,4))) AS DOUBLE)"


def holed(spark: SparkSession, d: str) -> AnalysisTable:
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "o_orderdate", *_select_list(HOLED))
    return AnalysisTable(rows, frozenset({"price", "cust", "o_orderkey"}), ("o_orderkey",))


def _select_list(sql: str) -> list[str]:
    """A comma-separated select list cut at commas outside brackets."""
    out, depth, held = [], 0, ""
    for ch in sql:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(held)
            held = ""
        else:
            held += ch
    return [*out, held]


# ---- filters

FILTER_CASES = {
    "f_eq": ({"value": "2-HIGH"}, "coalesce(priority,'') = '2-HIGH'", {"value": 37}, "coalesce(cust = 37, false)"),
    "f_ne": ({"value": "2-HIGH"}, "coalesce(priority,'') <> '2-HIGH'", {"value": 37}, "coalesce(cust <> 37, true)"),
    "f_in": ({"values": ["2-HIGH", ""]}, "coalesce(priority,'') IN ('2-HIGH','')", {"values": ["1,0", 20, 30]}, "coalesce(cust IN (10, 20, 30), false)"),
    "f_not_in": ({"values": ["2-HIGH", "5-LOW"]}, "coalesce(priority,'') NOT IN ('2-HIGH','5-LOW')", {"values": [10, 20]}, "coalesce(cust NOT IN (10, 20), true)"),
    "f_gt": ({"value": "2-HIGH"}, "coalesce(priority,'') > '2-HIGH'", {"value": "50,000"}, "price > 50000"),
    "f_gte": ({"value": "2-HIGH"}, "coalesce(priority,'') >= '2-HIGH'", {"value": 50000}, "price >= 50000"),
    "f_lt": ({"value": "2-HIGH"}, "coalesce(priority,'') < '2-HIGH'", {"value": 50000}, "price < 50000"),
    "f_lte": ({"value": "2-HIGH"}, "coalesce(priority,'') <= '2-HIGH'", {"value": 50000}, "price <= 50000"),
    "f_between": ({"values": ["", "2-HIGH"]}, "coalesce(priority,'') BETWEEN '' AND '2-HIGH'", {"values": [20000, 90000]}, "price BETWEEN 20000 AND 90000"),
    "f_empty": ({}, "priority IS NULL OR priority = ''", {}, "price IS NULL"),
    "f_not_empty": ({}, "priority IS NOT NULL AND priority <> ''", {}, "price IS NOT NULL"),
}


def _filter_query(op: str, on_text: dict, on_number: dict, number_column: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = holed(spark, d)
        parts = []
        for kind, column, item in (("text", "priority", on_text), ("number", number_column, on_number)):
            kept = q.filtered(t, [{"column": column, "op": op, **item}]).df
            parts.append(kept.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.coalesce(F.sum("o_orderkey"), F.lit(0)).alias("keys")))
        return parts[0].unionByName(parts[1])

    return run


for _name, (_t, _tsql, _n, _nsql) in FILTER_CASES.items():
    _column = "cust" if "cust" in _nsql else "price"
    add(_name, _filter_query(_name[2:], _t, _n, _column), WITH + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n, CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS keys FROM t WHERE {w}" for k, w in (("text", _tsql), ("number", _nsql))))

# ---- aggregates


def _spec(spec: dict, source: Callable[[SparkSession, str], AnalysisTable] = holed) -> Query:
    return lambda spark, d: q.aggregate(source(spark, d), spec).groups


def _lineitem(spark: SparkSession, d: str) -> AnalysisTable:
    return AnalysisTable.of(table(spark, d, "lineitem"), ("l_orderkey", "l_linenumber"))


add("q_aggregate", _spec({"filters": [{"column": "l_quantity", "op": "gt", "value": 10}], "group_by": ["l_returnflag"], "measures": [{"agg": "sum", "column": "l_extendedprice"}, {"agg": "count"}, {"agg": "ratio", "numerator": "l_tax", "denominator": "l_quantity"}], "sort": {"by": "sum:l_extendedprice", "desc": True}}, _lineitem), f"SELECT l_returnflag, count(*) AS records, round({DEC.format('l_extendedprice')}, 6) AS sum_l_extendedprice, count(*) AS count, round({DEC.format('l_tax')} / nullif({DEC.format('l_quantity')}, 0), 6) AS ratio_l_tax_l_quantity FROM lineitem WHERE l_quantity > 10 GROUP BY 1")
_AGG = {
    "agg_sum": ({"agg": "sum", "column": "price"}, f"round({DEC.format('price')}, 6) AS sum_price"),
    "agg_mean": ({"agg": "mean", "column": "price"}, f"round({DEC.format('price')} / nullif(count(price), 0), 6) AS mean_price"),
    "agg_min": ({"agg": "min", "column": "price"}, "min(price) AS min_price"),
    "agg_max": ({"agg": "max", "column": "price"}, "max(price) AS max_price"),
    "agg_count": ({"agg": "count"}, "count(*) AS count"),
    "agg_distinct": ({"agg": "distinct", "column": "priority"}, "count(DISTINCT nullif(priority, '')) AS distinct_priority"),
    "agg_ratio": ({"agg": "ratio", "numerator": "price", "denominator": "cust"}, f"round({DEC.format('CASE WHEN cust IS NOT NULL THEN price END')} / nullif({DEC.format('CASE WHEN price IS NOT NULL THEN cust END')}, 0), 6) AS ratio_price_cust"),
}
for _name, (_m, _sql) in _AGG.items():
    add(_name, _spec({"group_by": ["status"], "measures": [_m]}), WITH + f"SELECT status, count(*) AS records, {_sql} FROM t GROUP BY 1")
_SUM, _SUMSQL = [{"agg": "sum", "column": "price"}], f"round({DEC.format('price')}, 6) AS sum_price"
add("grp_none", lambda s, d: q.aggregate(holed(s, d), {"measures": _SUM}).groups.unionByName(q.aggregate(holed(s, d), {"measures": _SUM, "filters": [{"column": "status", "op": "eq", "value": "nothing"}]}).groups), WITH + f"SELECT count(*) AS records, {_SUMSQL} FROM t")
add("grp_1", _spec({"group_by": ["priority"], "measures": _SUM}), WITH + f"SELECT priority, count(*) AS records, {_SUMSQL} FROM t GROUP BY 1")
add("grp_2", _spec({"group_by": ["priority", "status"], "measures": _SUM}), WITH + f"SELECT priority, status, count(*) AS records, {_SUMSQL} FROM t GROUP BY 1, 2")
_BINS = "lo AS (SELECT min(price) AS a, (max(price) - min(price)) / 12 AS w FROM t), b AS (SELECT t.*, CASE WHEN price IS NOT NULL THEN least(floor((price - a) / w), 11) END AS i, a, w FROM t, lo) "
add("grp_bins", _spec({"group_by": [{"column": "price", "bins": 12}], "measures": [{"agg": "count"}]}), WITH + "," + _BINS + "SELECT round(a + i * w, 6) AS price_low, round(a + (i + 1) * w, 6) AS price_high, count(*) AS records, count(*) AS count FROM b GROUP BY i, a, w")


def _ranked(spec: dict, *order: str) -> Query:
    """A sorted answer with its place as a column, so that the order is part of the result."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = q.aggregate(holed(spark, d), spec).groups.collect()  # at most the spec's limit
        kept = [(i, r["priority"], r["records"], r["sum_price"]) for i, r in enumerate(rows)]
        return spark.createDataFrame(kept, "place int, priority string, records long, sum_price double")

    return run


_RANK = "SELECT CAST(row_number() OVER (ORDER BY {0}) - 1 AS INT) AS place, * FROM (SELECT priority, count(*) AS records, " + _SUMSQL + " FROM t GROUP BY 1) g"
_BY = {"group_by": ["priority"], "measures": _SUM}
add("srt_default", _ranked(_BY), WITH + _RANK.format("priority NULLS LAST"))
add("srt_measure", _ranked(_BY | {"sort": {"by": "sum:price", "desc": True}}), WITH + _RANK.format("sum_price DESC NULLS LAST"))
add("srt_key", _ranked(_BY | {"sort": {"by": "priority", "desc": True}}), WITH + _RANK.format("(priority IS NULL OR priority = ''), priority DESC NULLS LAST"))
add("lim_groups", _ranked(_BY | {"sort": {"by": "sum:price", "desc": True}, "limit": 3}), WITH + _RANK.format("sum_price DESC NULLS LAST") + " ORDER BY place LIMIT 3")


def _records(spec: dict) -> Query:
    return lambda spark, d: q.records(holed(spark, d), spec).select("o_orderkey", "priority", "price", "status")


_COLS = "o_orderkey, priority, price, status"
add("rec_page", _records({"offset": 100, "limit": 50, "filters": [{"column": "price", "op": "gt", "value": 1000}]}), WITH + f"SELECT {_COLS} FROM t WHERE price > 1000 ORDER BY o_orderkey LIMIT 50 OFFSET 100")
add("rec_sort", _records({"sort": {"by": "priority", "desc": True}, "limit": 100}), WITH + f"SELECT {_COLS} FROM t ORDER BY (priority IS NULL OR priority = ''), priority DESC, o_orderkey LIMIT 100")
add("rec_sample", _records({"sample": 500, "filters": [{"column": "price", "op": "gt", "value": 1000}]}), WITH + f", n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM t WHERE price > 1000) SELECT {_COLS} FROM n WHERE i IN (SELECT CAST(floor(k * greatest(n / 500.0::DOUBLE, 1.0::DOUBLE)) AS BIGINT) FROM (SELECT DISTINCT n FROM n) x, range(0, 500) r(k) WHERE k < least(500, n))")
_FIELD = "SELECT '{0}' AS name, '{1}' AS type, count({0}) FILTER (WHERE CAST({0} AS VARCHAR) <> '') AS filled, count(*) AS records, {2} AS min, {3} AS max, {4} AS distinct FROM t"
_FIELDS = [_FIELD.format(c, "number", f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)", "NULL::BIGINT") for c in ("o_orderkey", "price", "cust")] + [_FIELD.format(c, "text", "NULL::DOUBLE", "NULL::DOUBLE", f"count(DISTINCT {c})") for c in ("o_orderdate", "priority", "status")]
add("q_fields", lambda s, d: q.fields(holed(s, d)).drop("role"), WITH + " UNION ALL ".join(_FIELDS))

# ---- parsing

_MONEY = {0: lambda: F.concat(F.lit("$"), F.format_number("o_totalprice", 2)), 1: lambda: F.concat(F.lit("("), F.format_number("o_totalprice", 2), F.lit(")")), 2: lambda: F.concat(F.lit(" "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" ")), 3: lambda: F.concat((F.col("o_orderkey") % 97).cast("string"), F.lit("%")), 4: lambda: F.translate(F.col("o_orderkey").cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩"), 5: lambda: F.lit("1,20,000"), 6: lambda: F.lit("n/a"), 7: lambda: F.concat(F.lit("SAR −"), F.format_number(F.col("o_orderkey"), 0))}


def _by_case(cases: dict[int, Callable[[], Column]]) -> Column:
    k = F.col("o_orderkey") % len(cases)
    return reduce(lambda c, x: c.when(k == x[0], x[1]()), list(cases.items())[1:], F.when(k == 0, cases[0]()))


add("num_mapped", lambda s, d: table(s, d, "orders").select("o_orderkey", _by_case(_MONEY).alias("x")).select("o_orderkey", F.round(numbers.mapped_number(F.col("x")), 2).alias("number")), "SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN round(o_totalprice, 2) WHEN 1 THEN -round(o_totalprice, 2) WHEN 2 THEN round(o_totalprice, 2) WHEN 3 THEN CAST(o_orderkey % 97 AS DOUBLE) WHEN 4 THEN CAST(o_orderkey AS DOUBLE) WHEN 7 THEN -CAST(o_orderkey AS DOUBLE) END AS number FROM orders")
_PLAIN = {0: lambda: F.format_number("o_totalprice", 2), 1: lambda: F.lit("1,2"), 2: lambda: F.lit("nan"), 3: lambda: F.concat(F.lit("$"), F.col("o_orderkey").cast("string"))}
add("num_plain", lambda s, d: table(s, d, "orders").select("o_orderkey", F.round(numbers.plain_number(_by_case(_PLAIN)), 2).alias("number")), "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN round(o_totalprice, 2) WHEN 1 THEN 12.0 END AS number FROM orders")
add("num_finite", lambda s, d: table(s, d, "orders").select("o_orderkey", numbers.finite(F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).when(F.col("o_orderkey") % 3 == 1, F.lit(float("inf"))).otherwise(F.col("o_totalprice"))).alias("number")), "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN o_totalprice END AS number FROM orders")
_DATES = {0: "yyyy-MM-dd", 1: "dd/MM/yyyy", 2: "d-MMM-yyyy", 3: "MMMM d, yyyy", 4: "MM/yyyy", 5: "yyyy"}


def _dated() -> Column:
    cases: dict[int, Callable[[], Column]] = {k: (lambda f=f: F.date_format("o_orderdate", f)) for k, f in _DATES.items()}
    cases[6] = lambda: F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), F.year("o_orderdate").cast("string"))
    cases[7] = lambda: F.lit("31/02/2001")
    return _by_case(cases)


_ISO = "strftime(o_orderdate, '%Y-%m-%d')"
add("date_parse", lambda s, d: table(s, d, "orders").select("o_orderkey", dates.parse_date(_dated()).alias("p")).select("o_orderkey", "p.y", "p.m", "p.d", "p.q", "p.precision"), "SELECT o_orderkey, CASE WHEN k < 7 THEN CAST(year(o_orderdate) AS INT) END AS y, CASE WHEN k < 5 THEN CAST(month(o_orderdate) AS INT) END AS m, CASE WHEN k < 4 THEN CAST(day(o_orderdate) AS INT) END AS d, CASE WHEN k = 6 THEN CAST(quarter(o_orderdate) AS INT) END AS q, CASE WHEN k < 4 THEN 'day' WHEN k = 4 THEN 'month' WHEN k = 5 THEN 'year' WHEN k = 6 THEN 'quarter' END AS precision FROM (SELECT *, o_orderkey % 8 AS k FROM orders)")
add("date_label", lambda s, d: table(s, d, "orders").select("o_orderkey", dates.parse_date(_dated()).alias("p")).select("o_orderkey", *[dates.label(F.col("p"), g).alias(g) for g in dates.GRAINS]), f"SELECT o_orderkey, CASE WHEN k < 4 THEN {_ISO} END AS day, CASE WHEN k < 5 THEN strftime(o_orderdate, '%Y-%m') END AS month, CASE WHEN k < 5 OR k = 6 THEN year(o_orderdate) || '-Q' || quarter(o_orderdate) END AS quarter, CASE WHEN k < 7 THEN strftime(o_orderdate, '%Y') END AS year FROM (SELECT *, o_orderkey % 8 AS k FROM orders)")
add("date_order", lambda s, d: table(s, d, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("x")).agg(*dates.order_evidence(F.col("x"))), "SELECT count(*) FILTER (WHERE day(o_orderdate) > 12) AS day_first, 0::BIGINT AS month_first, count(*) FILTER (WHERE day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate)) AS differs FROM orders")


def _grain(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("x"))
    period = dates.parse_date(F.col("x"))
    return dates.grain_counts(rows, period).select("n", *[F.col(f"d_{g}").alias(f"labels_{g}") for g in dates.GRAINS], F.lit(dates.choose_grain(rows, period)).alias("grain"))


add("date_grain", _grain, "SELECT *, CASE WHEN labels_day <= 36 THEN 'day' WHEN labels_month <= 36 THEN 'month' WHEN labels_quarter <= 36 THEN 'quarter' ELSE 'year' END AS grain FROM (SELECT count(*) AS n, count(DISTINCT strftime(o_orderdate, '%Y-%m-%d')) AS labels_day, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS labels_month, count(DISTINCT year(o_orderdate) * 10 + quarter(o_orderdate)) AS labels_quarter, count(DISTINCT year(o_orderdate)) AS labels_year FROM orders)")


def _date_column(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("x"))
    order, _ = dates.resolve_order(rows, "x")
    period = dates.parse_date(F.col("x"), order)
    return rows.groupBy(dates.label(period, dates.choose_grain(rows, period, "month")).alias("label")).agg(F.count("*").alias("n"))


add("date_column", _date_column, "SELECT strftime(o_orderdate, '%Y-%m') AS label, count(*) AS n FROM orders GROUP BY 1")
add("date_next", lambda s, d: s.createDataFrame([(i + 1, x) for i, x in enumerate(dates.next_labels(table(s, d, "orders").agg(F.max(F.date_format("o_orderdate", "yyyy-MM"))).first()[0], 3))], "step int, label string"), "SELECT CAST(k AS INT) AS step, strftime(date_trunc('month', max(o_orderdate)) + to_months(CAST(k AS INT)), '%Y-%m') AS label FROM orders, range(1, 4) r(k) GROUP BY k")
_KEYS = {0: lambda: F.concat(F.lit("00"), F.col("o_custkey").cast("string")), 1: lambda: F.concat(F.col("o_custkey").cast("string"), F.lit(".0")), 2: lambda: F.concat(F.lit(" "), F.translate(F.col("o_custkey").cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")), 3: lambda: F.lit("n/a")}
add("key_text", lambda s, d: table(s, d, "orders").select("o_orderkey", numbers.key_text(_by_case(_KEYS), True).alias("number_key"), numbers.key_text(F.concat(F.lit(" "), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")), F.lit(" ")), False).alias("text_key")), "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_custkey AS VARCHAR) END AS number_key, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS text_key FROM orders")
add("txt_figures", lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(text.figures(F.col("text")), " ").alias("figures")), r"SELECT doc_id, array_to_string(list_sort(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[-+−]?\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?%?'), lambda x: replace(ltrim(x, '+-−'), ',', '')), lambda x: x NOT IN ('1', '2'))), ' ') AS figures FROM documents")
_SAID = {0: " The P-value and the null hypothesis.", 1: " An AUC of 0.9 (95% CI), RMSE,MAE; an ANOVA.", 2: " A special decision at p = 0.04.", 3: " The Foo-Bar test.", 4: " فرضية العدم واختبار فو-بار"}
_SAY = "CASE " + " ".join(f"WHEN doc_id % 6 = {k} THEN '{v}'" for k, v in _SAID.items()) + " ELSE '' END"
# RE2 has no look-around: signs between words are doubled, so that words in a row do not share one.
_DOUBLED = r"regexp_replace(t, '([^\p{L}\p{N}_-])', '\1\1', 'g')"
_WORDS = r"(?i)(?:^|[^\p{L}\p{N}_-])(ci|s\.\.e\.\.|auc|roc|rmse|mape|mae|anova|vif|pca)(?:$|[^\p{L}\p{N}_-])|(?:^|[^\p{L}\p{N}_-])(p\s*(?:==|<<|>>|≤≤)\s*0?\.\.\d)"
_AUTHORS = r"(?i)\b[A-Z][a-z]+[-–][A-Z][a-z]+ test\b|اختبار\s+[ء-ي]+[-–][ء-ي]+"
_JARGON_SQL = "[" + ", ".join("'" + j.replace("'", "''") + "'" for j in text.JARGON) + "]"
add(
    "txt_jargon",
    lambda s, d: table(s, d, "documents").select("doc_id", F.size(text.jargon(F.concat(F.coalesce("text", F.lit("")), F.expr(_SAY)))).alias("n")),
    f"WITH t AS (SELECT doc_id, coalesce(text, '') || {_SAY} AS t FROM documents), f AS (SELECT doc_id, t, list_filter({_JARGON_SQL}, lambda j: contains(lower(t), j)) AS found, list_concat(regexp_extract_all({_DOUBLED}, '{_WORDS}'), regexp_extract_all(t, '{_AUTHORS}')) AS words FROM t) SELECT doc_id, CAST(len(found) + len(list_filter(words, lambda w: NOT list_bool_or(list_transform(list_append(found, chr(0)), lambda j: starts_with(regexp_replace(lower(w), '^[^\\p{{L}}\\p{{N}}_]+', ''), regexp_replace(j, '([^\\p{{L}}\\p{{N}}_-])', '\\1\\1', 'g')))))) AS INT) AS n FROM f",
)
_CAUSED = "text || CASE WHEN doc_id % 2 = 0 THEN '\nStock drives sales, and cuts made orders fall.\nWhat drives sales?' WHEN doc_id % 3 = 0 THEN '\nWe do not know whether stock drives sales. Delays led to stops! Late parts push total output down.' ELSE '' END"


def _caused(s: SparkSession, d: str) -> DataFrame:
    more = F.expr(_CAUSED[len("text || ") :])
    return table(s, d, "documents").select("doc_id", F.size(text.causal_sentences(F.concat("text", more))).cast("long").alias("n"))


add("txt_causal", _caused, f"SELECT doc_id, ({claims.sql_count('x')}) AS n FROM (SELECT doc_id, {_CAUSED} AS x FROM documents)")
_PASTED = "text || CASE WHEN doc_id % 5 = 0 THEN repeat('\n1,2,3', 8) WHEN doc_id % 5 = 1 THEN repeat('\n1;2;3', 7) WHEN doc_id % 5 = 2 THEN repeat('\na,b,c', 9) ELSE '' END"
# Runs of neighbouring lines with a digit and equally many separators, two at least; the documents hold no other kind of pasted rows.
_RAW = f"""WITH s AS (SELECT doc_id, string_split({_PASTED}, '\n') AS lines FROM documents), l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM s),
 w AS (SELECT doc_id, i, d, len(line) - len(replace(line, d, '')) AS n, regexp_matches(line, '[0-9]') AS digit FROM l, (VALUES (','), (';'), ('\t')) v(d)),
 r AS (SELECT doc_id, d, n, i - row_number() OVER (PARTITION BY doc_id, d, n ORDER BY i) AS run FROM w WHERE n >= 2 AND digit),
 f AS (SELECT doc_id FROM r GROUP BY doc_id, d, n, run HAVING count(*) >= 8)
SELECT doc_id, doc_id IN (SELECT doc_id FROM f) AS raw FROM documents"""
add("txt_raw_rows", lambda s, d: table(s, d, "documents").select("doc_id", text.raw_rows(F.expr(_PASTED)).alias("raw")), _RAW)
add("txt_figcheck", lambda s, d: text.check_figures(table(s, d, "documents"), "text", {"answer": 42.0, "share": 0.45}, "doc_id"))

# ---- joins

_LOOK = "SELECT CAST(CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS VARCHAR) AS code, c_mktsegment AS segment, c_acctbal AS balance FROM customer"


def _customers(s: SparkSession, d: str) -> joins.Lookup:
    rows = table(s, d, "customer").selectExpr("CAST(CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS STRING) AS code", "c_mktsegment AS segment", "c_acctbal AS balance")
    return joins.Lookup(rows, frozenset({"balance"}))


def _joined(how: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        t, _ = joins.join_one(holed(s, d), _customers(s, d), joins.Join((("cust", "code"),), how), "customers")
        return t.df.select("o_orderkey", "cust", "segment", "balance")

    return run


_JOIN = WITH + f", c AS ({_LOOK}) SELECT o_orderkey, cust, {{0}} AS segment, balance FROM t {{1}} JOIN c ON t.cust = CAST(c.code AS DOUBLE)"
add("jn_left", _joined("left"), _JOIN.format("coalesce(segment, '')", "LEFT"))
add("jn_inner", _joined("inner"), _JOIN.format("segment", "INNER"))
add("jn_numeric_key", lambda s, d: _joined("left")(s, d).groupBy("segment").agg(F.count("*").alias("n")), WITH + f", c AS ({_LOOK}) SELECT coalesce(segment, '') AS segment, count(*) AS n FROM t LEFT JOIN c ON t.cust = CAST(c.code AS DOUBLE) GROUP BY 1")
add("jn_stats", lambda s, d: joins.join_one(holed(s, d), _customers(s, d), joins.Join((("cust", "code"),)), "customers")[1], WITH + f", c AS ({_LOOK}), j AS (SELECT t.cust, c.code FROM t LEFT JOIN c ON t.cust = CAST(c.code AS DOUBLE)) SELECT count(*) AS rows_in, count(code) AS matched, count(*) - count(code) AS unmatched, round(count(code) / count(*), 4) AS coverage, 0 AS empty_keys, (SELECT count(*) FROM c WHERE code NOT IN (SELECT code FROM j WHERE code IS NOT NULL)) AS lookup_unused FROM j")
add("jn_unique_guard", lambda s, d: joins.repeated_keys(table(s, d, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"]), "SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")


def _composite(s: SparkSession, d: str) -> DataFrame:
    look = holed(s, d).df.groupBy("status", "priority").agg(F.count("*").cast("double").alias("peers"))
    t, _ = joins.join_one(holed(s, d), joins.Lookup(look, frozenset({"peers"})), joins.Join((("status", "status"), ("priority", "priority"))), "peers")
    return t.df.select("o_orderkey", "peers")


add("jn_composite", _composite, WITH + ", g AS (SELECT status, priority, CAST(count(*) AS DOUBLE) AS peers FROM t WHERE priority <> '' GROUP BY 1, 2) SELECT o_orderkey, peers FROM t LEFT JOIN g USING (status, priority)")


def _date_key(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_totalprice")
    look = rows.groupBy("month").agg(F.count("*").cast("double").alias("target")).select(F.date_format(F.to_date("month", "yyyy-MM"), "MMM yyyy").alias("period"), "target")
    t, _ = joins.join_one(AnalysisTable(rows, frozenset({"o_totalprice", "o_orderkey"}), ("o_orderkey",)), joins.Lookup(look, frozenset({"target"})), joins.Join((("month", "period"),)), "targets", "month", "month")
    return t.df.select("o_orderkey", "month", "target")


add("jn_date_key", _date_key, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, CAST(count(*) OVER (PARTITION BY strftime(o_orderdate, '%Y-%m')) AS DOUBLE) AS target FROM orders")


def _sequence(s: SparkSession, d: str) -> DataFrame:
    cust = table(s, d, "customer").selectExpr("CAST(c_custkey AS STRING) AS code", "CAST(c_nationkey AS DOUBLE) AS nation")
    nation = table(s, d, "nation").selectExpr("CAST(n_nationkey AS STRING) AS nkey", "n_name AS nation_name", "CAST(n_regionkey AS DOUBLE) AS region")
    region = table(s, d, "region").selectExpr("CAST(r_regionkey AS STRING) AS rkey", "r_name AS region_name")
    merged = joins.merge(holed(s, d), [joins.Lookup(cust, frozenset({"nation"})), joins.Lookup(nation, frozenset({"region"})), joins.Lookup(region, frozenset())], [joins.Join((("cust", "code"),), name="c"), joins.Join((("nation", "nkey"),), name="n"), joins.Join((("region", "rkey"),), name="r")])
    return merged.table.df.groupBy("region_name", "nation_name").agg(F.count("*").alias("n"), F.round(numbers.exact_sum(F.col("price")), 2).alias("price"))


add("jn_sequence", _sequence, WITH + f"SELECT coalesce(r_name, '') AS region_name, coalesce(n_name, '') AS nation_name, count(*) AS n, round({DEC.format('price')}, 2) AS price FROM t LEFT JOIN customer ON cust = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")

# ---- cleaning and profiles: a messy table of text, made alike in both engines

_MESS = """' ' || CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderpriority END || ' ' AS priority,
 CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN 'n/a' ELSE CAST(CAST(o_custkey % 50 AS INT) AS {s}) END AS amount,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS status"""
_MSQL = f"WITH raw AS (SELECT o_orderkey, {_MESS.format(s='VARCHAR')} FROM orders), m AS (SELECT o_orderkey, trim(coalesce(priority, '')) AS priority, trim(coalesce(amount, '')) AS amount, trim(coalesce(status, '')) AS status FROM raw) "


def messy(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").selectExpr(*_select_list(_MESS.format(s="STRING")), f"o_orderkey AS {ROW}")


_C3 = ("priority", "amount", "status")
_NUM = "try_cast(nullif(replace({0}, ',', ''), '') AS DOUBLE)"
add("cl_clean", lambda s, d: clean.clean(messy(s, d)).table.df.withColumnRenamed(ROW, "first_row"), _MSQL + f"SELECT priority, CASE WHEN amount = 'n/a' THEN NULL ELSE {_NUM.format('amount')} END AS amount, status, min(o_orderkey) AS first_row FROM m WHERE priority || amount || status <> '' GROUP BY priority, m.amount, status")
add("cl_rowacct", lambda s, d: clean.row_account(messy(s, d)), _MSQL + ", g AS (SELECT priority, amount, status, count(*) AS n FROM m GROUP BY 1, 2, 3), k AS (SELECT count(*) FILTER (WHERE priority || amount || status <> '') AS kept, coalesce(sum(n) FILTER (WHERE priority || amount || status = ''), 0) AS empty, sum(n) AS all_rows FROM g) SELECT CAST(all_rows AS BIGINT) AS rows_before, CAST(empty AS BIGINT) AS empty, CAST(all_rows - empty - kept AS BIGINT) AS duplicates, kept AS rows_after FROM k")
add("cl_profile", lambda s, d: clean.profile(messy(s, d)), _MSQL + " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) FILTER (WHERE {c} = '') AS missing, count(DISTINCT {c}) AS distinct, count(*) FILTER (WHERE {c} <> '') AS filled, count({_NUM.format(c)}) >= 0.9 * count(*) FILTER (WHERE {c} <> '') AS numeric FROM m" for c in _C3))
add("cl_completeness", lambda s, d: clean.completeness(messy(s, d)), _MSQL + "SELECT count(*) AS records, count(*) - (SELECT count(*) FROM (SELECT DISTINCT priority, amount, status FROM m)) AS duplicates, round(1 - CAST(sum(CAST(priority = '' AS INT) + CAST(amount = '' AS INT) + CAST(status = '' AS INT)) AS DOUBLE) / (count(*) * 3), 4) AS completeness FROM m")
_RATE = f"coalesce(count({_NUM}) / nullif(count(*) FILTER (WHERE {{0}} <> ''), 0), 0)"
add("cl_contract", lambda s, d: clean.contract(messy(s, d)), _MSQL + " UNION ALL ".join(f"SELECT '{c}' AS name, CASE WHEN {_RATE.format(c)} > 0.5 THEN 'number' ELSE 'text' END AS type, round({_RATE.format(c)}, 4) AS parse_rate, {_RATE.format(c)} >= 0.9 AS usable_as_measure, count(*) FILTER (WHERE {c} = '') > 0 AS nullable, count(*) FILTER (WHERE {c} = '') AS missing, count(DISTINCT nullif({c}, '')) AS distinct, CASE WHEN {_RATE.format(c)} > 0.5 THEN round(min({_NUM.format(c)}), 4) END AS min, CASE WHEN {_RATE.format(c)} > 0.5 THEN round(max({_NUM.format(c)}), 4) END AS max, CASE WHEN {_RATE.format(c)} > 0.5 THEN count(*) FILTER (WHERE {c} <> '') - count({_NUM.format(c)}) ELSE 0 END AS unreadable, count(*) FILTER (WHERE {c} <> '') AS filled FROM m" for c in _C3))
add("cl_quality", lambda s, d: clean.quality(messy(s, d)), _MSQL + f", x AS (SELECT round(1 - CAST(sum(CAST(priority = '' AS INT) + CAST(amount = '' AS INT) + CAST(status = '' AS INT)) AS DOUBLE) / (count(*) * 3), 4) AS completeness, round(1 - (count(*) - (SELECT count(*) FROM (SELECT DISTINCT priority, amount, status FROM m))) / count(*), 4) AS uniqueness, round(count({_NUM.format('amount')}) / count(*) FILTER (WHERE amount <> ''), 4) AS validity, 1.0::DOUBLE AS consistency FROM m) SELECT *, round(100 * (completeness + uniqueness + validity + consistency) / 4, 1) AS score, CASE WHEN round(100 * (completeness + uniqueness + validity + consistency) / 4, 1) >= 95 THEN 'A' WHEN round(100 * (completeness + uniqueness + validity + consistency) / 4, 1) >= 85 THEN 'B' WHEN round(100 * (completeness + uniqueness + validity + consistency) / 4, 1) >= 70 THEN 'C' ELSE 'D' END AS grade FROM x")
_PHONE, _LONG_ID = r"(?:^|[^\d])(?:\+\d{1,3}[ -]?)?(?:\d[ -]?){9,14}\d(?:[^\d]|$)", r"(?:^|[^\d])\d{12,19}(?:[^\d]|$)"
_MAIL, _PERSON, _SHORT = clean.PERSONAL_PATTERNS["email address"], clean.PERSON_VALUE.replace("'", "''"), r"^-?\d{1,8}(?:\.\d+)?$"
_HITS = f"SELECT '{{0}}' AS name, count(*) FILTER (WHERE v <> '') AS filled, count(DISTINCT nullif(v, '')) AS distinct, count(*) FILTER (WHERE regexp_matches(v, '{_MAIL}')) AS emails, count(*) FILTER (WHERE NOT regexp_matches(v, '{clean.DATED_VALUE}') AND regexp_matches(v, '{_PHONE}')) AS phones, count(*) FILTER (WHERE regexp_matches(v, '{_LONG_ID}')) AS identifiers, count(*) FILTER (WHERE regexp_matches(v, '{_PERSON}')) AS names, count(*) FILTER (WHERE regexp_matches(v, '{_SHORT}')) AS counts FROM (SELECT trim(coalesce(CAST({{1}} AS VARCHAR), ''), ' ') AS v FROM {{2}})"
add("cl_privacy", lambda s, d: clean.value_hits(table(s, d, "documents").select("text", "source", "lang", "n_chars")), " UNION ALL ".join(f"({_HITS})".replace("{0}", c).replace("{1}", c).replace("{2}", "documents") for c in ("text", "source", "lang", "n_chars")))
_PEOPLE = [("c_name", "c_name", False), ("contact", "c_custkey || '@mail.example'", False), ("card_type", "c_mktsegment", True), ("mobile", "'+971 50 ' || lpad(CAST(1000000 + c_custkey AS VARCHAR), 7, '0')", True)]
add(
    "cl_personal_columns",
    lambda s, d: clean.personal_columns(table(s, d, "customer").select("c_name", F.concat("c_custkey", F.lit("@mail.example")).alias("contact"), F.col("c_mktsegment").alias("card_type"), F.concat(F.lit("+971 50 "), F.lpad((F.col("c_custkey") + 1000000).cast("string"), 7, "0")).alias("mobile"))),
    'WITH h AS (' + ' UNION ALL '.join(f"SELECT *, {str(word).lower()} AS word FROM ({_HITS})".replace("{0}", n).replace("{1}", f"({c})").replace("{2}", "customer") for n, c, word in _PEOPLE) + '), p AS (SELECT *, CASE WHEN "distinct" >= 0.8 * filled AND filled >= 5 AND names >= 0.8 * filled THEN names ELSE 0 END AS people FROM h), b AS (SELECT *, word AND (emails + phones + identifiers + people > 0 OR NOT (filled > 0 AND ("distinct" < 0.5 * filled OR counts = filled))) AS by_name FROM p) SELECT name, by_name, emails, phones, identifiers, CAST(people AS BIGINT) AS names FROM b WHERE by_name OR emails + phones + identifiers + people > 0',
)
add("jn_clean_lookup", lambda s, d: joins.clean_lookup(messy(s, d)).df, _MSQL + f"SELECT DISTINCT priority, CASE WHEN amount = 'n/a' THEN NULL ELSE {_NUM.format('amount')} END AS amount, status FROM m WHERE priority || amount || status <> ''")
_WHOLE = "count(*) FILTER (WHERE {0} <> '') > 0 AND count(*) FILTER (WHERE {0} <> '' AND ({1} IS NULL OR {1} <> floor({1}))) = 0"
add("mp_profile", lambda s, d: clean.mapping_profile(messy(s, d)), _MSQL + " UNION ALL ".join(f"SELECT '{c}' AS name, CASE WHEN {_RATE.format(c)} >= 0.9 THEN 'number' ELSE 'text' END AS type, count(*) FILTER (WHERE {c} <> '') AS filled, count(*) AS cells, round({_RATE.format(c)}, 4) AS numeric_share, 0.0::DOUBLE AS date_share, count(DISTINCT nullif({c}, '')) AS distinct, {_WHOLE.format(c, _NUM.format(c))} AS whole_numbers, false AS formatted, coalesce({_WHOLE.format(c, _NUM.format(c))} AND max({_NUM.format(c)}) - min({_NUM.format(c)}) + 1 <= 2 * count(DISTINCT {_NUM.format(c)}), false) AS sequence FROM m" for c in _C3))


def _every_kth(s: SparkSession, d: str) -> DataFrame:
    rows = number_rows(table(s, d, "orders").select("o_orderkey"), "o_orderkey")
    return clean.sample(rows, 1000).select("o_orderkey")


add("mp_sample", _every_kth, "WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM n WHERE n <= 1000 OR i IN (SELECT CAST(floor(k * (n / 1000.0::DOUBLE)) AS BIGINT) FROM (SELECT DISTINCT n FROM n) x, range(0, 1000) r(k))")


# ---- files, written from the tables and read back


def _new_file(s: SparkSession, name: str) -> str:
    return f"{store.work_folder(s)}/{name}-{uuid.uuid4().hex}"


def _customer_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").selectExpr("CAST(c_custkey AS STRING) AS code", "concat(c_name, ', \"', c_mktsegment, '\"') AS name", "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING) END AS balance")


def _csv(s: SparkSession, d: str) -> DataFrame:
    path = _new_file(s, "customer.csv")
    _customer_text(s, d).coalesce(1).write.options(header=True, escape='"', emptyValue="").csv(path)
    return files.read_table(s, path, "csv").df.withColumnRenamed(ROW, "place")


_CUSTOMER_SQL = "SELECT CAST(c_custkey AS VARCHAR) AS code, c_name || ', \"' || c_mktsegment || '\"' AS name, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) END AS balance"
add("src_csv", _csv, _CUSTOMER_SQL + ", row_number() OVER () - 1 AS place FROM customer")


def _jsonl(s: SparkSession, d: str) -> DataFrame:
    path = _new_file(s, "customer.jsonl")
    _customer_text(s, d).coalesce(1).write.json(path)
    return files.read_table(s, path, "jsonl").df.withColumnRenamed(ROW, "place")


add("src_jsonl", _jsonl, _CUSTOMER_SQL + ", row_number() OVER () - 1 AS place FROM customer")


def _json(s: SparkSession, d: str) -> DataFrame:
    path = _new_file(s, "nation.json")
    rows = table(s, d, "nation").agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey")))).alias("value"))  # 25 rows by definition
    rows.select(F.concat(F.lit('{"made": "by hand", "records": '), "value", F.lit("}")).alias("value")).coalesce(1).write.text(path)
    return files.read_table(s, path, "json").df.withColumnRenamed(ROW, "place")


add("src_json", _json, "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation")


def _flat(s: SparkSession, d: str) -> DataFrame:
    path = _new_file(s, "orders.jsonl")
    nested = table(s, d, "orders").selectExpr("CAST(o_orderkey AS STRING) AS key", "named_struct('who', named_struct('code', o_custkey), 'marks', array(o_orderstatus, o_orderpriority)) AS about", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS status")
    nested.write.json(path)
    return files.read_table(s, path, "jsonl").df.drop(ROW).withColumnsRenamed({"about.who.code": "code", "about.marks": "marks"})


add("src_flatten", _flat, "SELECT CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) AS code, '[\"' || o_orderstatus || '\",\"' || o_orderpriority || '\"]' AS marks, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE '' END AS status FROM orders")


def _sink(s: SparkSession, d: str) -> DataFrame:
    path = _new_file(s, "written")
    rows = table(s, d, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN concat('=', o_orderstatus) WHEN 1 THEN concat('-', o_orderstatus, ', \"x\"') WHEN 2 THEN o_orderpriority END AS note", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS cust")
    store.write_csv(AnalysisTable(rows, frozenset({"o_orderkey", "cust"}), ("o_orderkey",)), path)
    return s.read.text(path).where("value <> 'o_orderkey,note,cust'").select(F.rtrim("value", F.lit("\r")).alias("line"))


add("sink_csv", _sink, "SELECT CAST(o_orderkey AS VARCHAR) || ',' || CASE o_orderkey % 4 WHEN 0 THEN chr(39) || '=' || o_orderstatus WHEN 1 THEN '\"' || chr(39) || '-' || o_orderstatus || ', \"\"x\"\"\"' WHEN 2 THEN o_orderpriority ELSE '' END || ',' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS line FROM orders")


def _counts(s: SparkSession, d: str) -> DataFrame:
    found = files.read_table(s, f"{d}/orders.parquet")
    return found.df.agg(F.count("*").alias("records")).withColumn("columns", F.lit(len(found.columns)).cast("long"))


add("src_counts", _counts, "SELECT count(*) AS records, (SELECT count(*) FROM information_schema.columns WHERE table_name = 'orders') AS columns FROM orders")

# ---- governance and the analytics types

_PRICED = "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_quantity END AS units, l_extendedprice / nullif(l_quantity, 0) AS unit_price, CASE WHEN l_orderkey % 50 = 0 THEN l_extendedprice * 1.1 ELSE l_extendedprice END AS amount FROM lineitem"
_FORMULA = {"op": "multiply", "inputs": ["units", "unit_price"]}


def _priced(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_quantity END AS units", "try_divide(l_extendedprice, l_quantity) AS unit_price", "CASE WHEN l_orderkey % 50 = 0 THEN l_extendedprice * 1.1D ELSE l_extendedprice END AS amount")


_DEFINED = f"WITH p AS ({_PRICED.replace('1.1', '1.1::DOUBLE')}), e AS (SELECT *, units * unit_price AS defined FROM p), f AS (SELECT *, abs(amount - defined) <= greatest(abs(defined) * 0.005::DOUBLE, 0.01::DOUBLE) AS ok FROM e) "
add("gv_formula", lambda s, d: _priced(s, d).select("l_orderkey", "l_linenumber", F.round(governance.evaluate(_FORMULA), 4).alias("defined")), _DEFINED + "SELECT l_orderkey, l_linenumber, round(defined, 4) AS defined FROM f")
add("gv_match", lambda s, d: _priced(s, d).select(governance.matches(F.col("amount"), governance.evaluate(_FORMULA)).alias("ok")).groupBy("ok").agg(F.count("*").alias("n")), _DEFINED + "SELECT ok, count(*) AS n FROM f GROUP BY 1")
add("gv_conform", lambda s, d: governance.conformance(_priced(s, d), "amount", _FORMULA), _DEFINED + "SELECT count(ok) AS checked, count(*) FILTER (WHERE ok) AS matching, count(*) - count(ok) AS skipped, round(count(*) FILTER (WHERE ok) / count(ok), 4) AS rate FROM f")
add("gv_breaches", lambda s, d: governance.breaches(_priced(s, d), "amount", _FORMULA, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.round("gap", 2).alias("gap")), _DEFINED + "SELECT l_orderkey, l_linenumber, round(amount - defined, 2) AS gap FROM f WHERE NOT ok ORDER BY abs(amount - defined) DESC, l_orderkey, l_linenumber LIMIT 3")

MONTH = lambda: F.date_format("o_orderdate", "yyyy-MM")
_ORDERS = lambda s, d: table(s, d, "orders")
_GROUPS = lambda s, d: analysis.groups(_ORDERS(s, d), "o_totalprice", "o_orderpriority", "o_orderkey")
_TREND = lambda s, d: analysis.trend(_ORDERS(s, d), "o_totalprice", MONTH())
_CONTRIB = lambda s, d: analysis.contributions(_ORDERS(s, d), "o_totalprice", "o_orderpriority", MONTH())
_G = f"g AS (SELECT o_orderpriority AS \"group\", round({DEC.format('o_totalprice')}, 2) AS total, count(*) AS n, min(o_orderkey) AS first_seen FROM orders GROUP BY 1)"
_T = f"t AS (SELECT strftime(o_orderdate, '%Y-%m') AS label, round({DEC.format('o_totalprice')}, 2) AS total, count(*) AS n FROM orders GROUP BY 1), x AS (SELECT *, CAST(row_number() OVER (ORDER BY label) - 1 AS DOUBLE) AS x, count(*) OVER () AS periods FROM t)"
_D = "sum(CAST({0} AS DECIMAL(28,4)))::DOUBLE"
add("pr_groups", _GROUPS, f"WITH {_G} SELECT * FROM g")
add("pr_trend", _TREND, f"WITH {_T} SELECT * FROM t")
add("pr_total", lambda s, d: analysis.total(_ORDERS(s, d), "o_totalprice"), f"SELECT round({DEC.format('o_totalprice')}, 2) AS total, count(o_totalprice) AS n FROM orders")
add("ds_stats", lambda s, d: analysis.describe(_ORDERS(s, d), "o_totalprice"), "WITH s AS (SELECT count(o_totalprice) AS n, avg(o_totalprice) AS mean, median(o_totalprice) AS median, coalesce(stddev_samp(o_totalprice), 0) AS sd FROM orders) SELECT n, round(mean, 4) AS mean, round(median, 4) AS median, round(sd, 4) AS sd, (SELECT count(*) FROM orders, s WHERE abs(o_totalprice - mean) > 2 * sd) AS beyond_2sd FROM s")
_ENDS = f"WITH {_T}, e AS (SELECT count(*) AS periods, min(label) AS first_label, max(label) AS last_label, arg_min(total, label) AS a, arg_max(total, label) AS b, arg_min(n, label) AS na, arg_max(n, label) AS nb, min(n) < 0.75 * max(n) AS uneven FROM t) "
add("ds_change", lambda s, d: analysis.change(_TREND(s, d)).drop("uneven", "change_per_record"), _ENDS + "SELECT periods, first_label, last_label, CASE WHEN periods >= 2 AND a <> 0 THEN round((b - a) / a, 4) END AS change FROM e")
add("ds_uneven", lambda s, d: analysis.change(_TREND(s, d)).select("uneven", "change_per_record"), _ENDS + "SELECT uneven, CASE WHEN uneven AND periods >= 2 AND a <> 0 THEN round((b / nb - a / na) / (a / na), 4) END AS change_per_record FROM e")
add("ds_top", lambda s, d: analysis.top_group(_GROUPS(s, d)), f"WITH {_G} SELECT \"group\", total, round(total / (SELECT sum(CAST(total AS DECIMAL(28,2)))::DOUBLE FROM g), 4) AS share FROM g ORDER BY total DESC, first_seen LIMIT 1")
_C = f"WITH e AS (SELECT min(strftime(o_orderdate, '%Y-%m')) AS a, max(strftime(o_orderdate, '%Y-%m')) AS b FROM orders), c AS (SELECT o_orderpriority AS \"group\", coalesce(sum(CAST(o_totalprice AS DECIMAL(28,4))) FILTER (WHERE strftime(o_orderdate, '%Y-%m') = b), 0) - coalesce(sum(CAST(o_totalprice AS DECIMAL(28,4))) FILTER (WHERE strftime(o_orderdate, '%Y-%m') = a), 0) AS d FROM orders, e GROUP BY 1), k AS (SELECT \"group\", round(d::DOUBLE, 2) AS change, round(round(d::DOUBLE, 2) / (SELECT sum(d)::DOUBLE FROM c), 4) AS share_of_change, round((SELECT sum(d)::DOUBLE FROM c), 2) AS total_change FROM c) "
add("dg_contrib", _CONTRIB, _C + "SELECT * FROM k")
_MOVED = "SELECT *, o_totalprice * CASE WHEN o_orderpriority <> '1-URGENT' THEN 1 WHEN strftime(o_orderdate, '%Y-%m') = (SELECT min(strftime(o_orderdate, '%Y-%m')) FROM orders) THEN -10 ELSE 1 END AS moved FROM orders"


def _against(s: SparkSession, d: str) -> DataFrame:
    """One priority starts below nothing and so grows, while the last month is short for all: they move against each other."""
    rows = _ORDERS(s, d)
    first = rows.agg(F.min(MONTH())).first()[0]
    times = F.when(F.col("o_orderpriority") != "1-URGENT", 1.0).when(MONTH() == first, -10.0).otherwise(1.0)
    return analysis.against_trend(analysis.contributions(rows.withColumn("moved", F.col("o_totalprice") * times), "moved", "o_orderpriority", MONTH()))


_AGAINST = _C.replace("WITH e AS", f"WITH moved_orders AS ({_MOVED}), e AS", 1).replace("CAST(o_totalprice AS", "CAST(moved AS").replace("FROM orders, e", "FROM moved_orders, e")
add("dg_against", _against, _AGAINST + "SELECT * FROM k WHERE sign(change) * sign(total_change) < 0")
add("dg_assoc", lambda s, d: analysis.associations(table(s, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]), " UNION ALL ".join(f"SELECT '{c}' AS other, round(corr(l_extendedprice, {c}), 4) AS r FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
_S = f"WITH {_G}, s AS (SELECT \"group\", total AS value, round(total / (SELECT sum(CAST(total AS DECIMAL(28,2)))::DOUBLE FROM g), 4) AS share, first_seen FROM g), z AS (SELECT \"group\", value, share, sum(CAST(share AS DECIMAL(18,4))) OVER (ORDER BY value DESC, first_seen ROWS UNBOUNDED PRECEDING)::DOUBLE AS cumulative, CAST(row_number() OVER (ORDER BY value DESC, first_seen) AS INT) AS place FROM s) "
add("sg_shares", lambda s, d: analysis.shares(_GROUPS(s, d)), _S + "SELECT * FROM z")
add("sg_concentration", lambda s, d: analysis.concentration(analysis.shares(_GROUPS(s, d))), _S + "SELECT count(*) AS segments, round(sum(CAST(share AS DECIMAL(18,4)) * CAST(share AS DECIMAL(18,4)))::DOUBLE, 4) AS hhi, least(count(*) FILTER (WHERE cumulative < 0.8) + 1, count(*)) AS pareto_count FROM z")
_F = f"WITH {_T}, f AS (SELECT regr_slope(total, x) AS slope, regr_intercept(total, x) AS intercept, regr_r2(total, x) AS explained, count(*) AS n FROM x) "
add("pd_fit", lambda s, d: analysis.fit(_TREND(s, d)).select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("explained", 4).alias("explained"), "n"), _F + "SELECT round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(explained, 4) AS explained, n FROM f")
add("pd_forecast", lambda s, d: analysis.labelled_forecast(_TREND(s, d)), _F + "SELECT CAST(k AS INT) AS step, strftime((SELECT date_trunc('month', max(o_orderdate)) FROM orders) + to_months(CAST(k AS INT)), '%Y-%m') AS label, round(intercept + slope * (n + k - 1), 2) AS value FROM f, range(1, 4) r(k)")
add("pd_backtest", lambda s, d: analysis.backtest(_TREND(s, d)), f"WITH {_T}, h AS (SELECT *, least(3, greatest(1, periods // 4)) AS holdout FROM x), f AS (SELECT regr_slope(total, x) AS slope, regr_intercept(total, x) AS intercept FROM h WHERE x < periods - holdout) SELECT CAST(holdout AS INT) AS holdout, round(avg(abs(intercept + slope * x - total) / abs(total)), 4) AS error FROM h, f WHERE x >= periods - holdout AND periods >= 6 AND total <> 0 GROUP BY holdout")
add("an_resid", lambda s, d: analysis.anomalies(_TREND(s, d)), f"WITH {_T}, f AS (SELECT regr_slope(total, x) AS slope, regr_intercept(total, x) AS intercept FROM x), r AS (SELECT label, total, intercept + slope * x AS expected, total - (intercept + slope * x) AS gap FROM x, f), s AS (SELECT *, stddev_pop(gap) OVER () AS spread FROM r) SELECT label, total AS value, round(expected, 2) AS expected, round(gap, 2) AS gap, round(spread, 2) AS spread FROM s WHERE abs(gap) > 2 * spread")
_O = _C.replace("WITH ", f"WITH {_G}, ", 1) + ", o AS (SELECT 'protect_leader' AS key, \"group\" AS target, total AS base_value FROM (SELECT * FROM g ORDER BY total DESC, first_seen LIMIT 1) UNION ALL SELECT 'grow_laggard', \"group\", total FROM (SELECT * FROM g ORDER BY total, first_seen LIMIT 1) UNION ALL SELECT 'recover_decline', \"group\", abs(change) FROM (SELECT * FROM k WHERE change < 0 ORDER BY change, \"group\" LIMIT 1)), r AS (SELECT *, round(base_value * 0.10::DOUBLE, 2) AS expected_gain FROM o UNION ALL SELECT 'hold_course', 'the whole business', 0.0, 0.0) "
_OPTIONS = lambda s, d: analysis.options(_GROUPS(s, d), _CONTRIB(s, d))
add("rx_options", _OPTIONS, _O + "SELECT * FROM r")
add("rx_sens", lambda s, d: analysis.sensitivity(_OPTIONS(s, d)), _O + ", u AS (SELECT u AS uplift, key, round(base_value * u, 2) AS gain, row_number() OVER (PARTITION BY u ORDER BY round(base_value * u, 2) DESC, key) AS n FROM r, (VALUES (0.05::DOUBLE), (0.10::DOUBLE), (0.20::DOUBLE)) v(u)) SELECT uplift, key AS winner, gain FROM u WHERE n = 1")
add("rx_break_even", lambda s, d: analysis.break_even(_OPTIONS(s, d)), _O + ", n AS (SELECT *, row_number() OVER (ORDER BY expected_gain DESC, key) AS i FROM r) SELECT round(max(base_value) FILTER (WHERE i = 1) / nullif(max(base_value) FILTER (WHERE i = 2), 0), 3) AS break_even FROM n WHERE i <= 2")

# ---- experiments

_ARM = "CASE user_id % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'b' ELSE 'c' END"
_EVENTS = lambda s, d: table(s, d, "events").withColumn("arm", F.expr(_ARM))
_ARMS = lambda s, d: experiments.arm_stats(_EVENTS(s, d), F.col("arm"), F.col("value"))
_A = f"WITH a AS (SELECT {_ARM} AS arm, count(*) AS n, avg(value) AS mean, var_samp(value) AS var FROM events WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) >= 2), b AS (SELECT n AS bn, mean AS bm, var AS bv FROM a WHERE arm = 'control'), k AS (SELECT arm, n, mean, mean - bm AS diff, sqrt(var / n + bv / bn) AS se, bm, least(n, bn) AS reached, 0.025::DOUBLE AS alpha FROM a, b WHERE arm <> 'control'), i AS (SELECT *, reached * ((-2 * ln(alpha)) + ln(-2 * ln(alpha) + 1)) / 1000 AS s FROM k), w AS (SELECT *, se * sqrt(2 * (s + 1) / s * ln(sqrt(s + 1) / alpha)) AS wide, 2.241402727604947::DOUBLE * se AS fixed FROM i) "
add("ex_arms", lambda s, d: _ARMS(s, d).select("arm", "n", F.round("mean", 4).alias("mean"), F.round("var", 4).alias("var")), _A + "SELECT arm, n, round(mean, 4) AS mean, round(var, 4) AS var FROM a")
_CMP = lambda s, d: experiments.compare(_ARMS(s, d))
add("ex_fixed", lambda s, d: _CMP(s, d).select("arm", "n", "average", "difference", "relative", "fixed_low", "fixed_high"), _A + "SELECT arm, n, round(mean, 2) AS average, round(diff, 2) AS difference, round(diff / abs(bm), 4) AS relative, round(diff - fixed, 2) AS fixed_low, round(diff + fixed, 2) AS fixed_high FROM w")
add("ex_always", lambda s, d: _CMP(s, d).select("arm", "low", "high"), _A + "SELECT arm, round(diff - wide, 2) AS low, round(diff + wide, 2) AS high FROM w")
add("ex_zero", lambda s, d: _CMP(s, d).select("arm", "beyond_chance", "beyond_chance_fixed"), _A + "SELECT arm, (diff - wide > 0) OR (diff + wide < 0) AS beyond_chance, (diff - fixed > 0) OR (diff + fixed < 0) AS beyond_chance_fixed FROM w")
add("ex_srm", lambda s, d: experiments.lopsided(_ARMS(s, d)), _A + ", p AS (SELECT arm, n / (SELECT sum(n) FROM a) AS share, (SELECT sum(n) FROM a) AS N, 1.0::DOUBLE / 3 AS p FROM a) SELECT arm, round(share, 4) AS share, round(abs(share - p), 4) AS gap, abs(share - p) > 3 * sqrt(p * (1 - p) / N) AS lopsided FROM p ORDER BY abs(share - p) DESC, arm LIMIT 1")
_Z = "(2 * pow(1.959963984540054::DOUBLE + 0.8416212335729143::DOUBLE, 2))"
add("ex_size", lambda s, d: experiments.sizes(table(s, d, "events"), F.col("value")), f"SELECT l AS lift, CAST(ceil({_Z} * var_samp(value) / pow(abs(avg(value)) * l, 2)) AS BIGINT) AS per_arm FROM events, (VALUES (0.05::DOUBLE), (0.10::DOUBLE), (0.20::DOUBLE)) v(l) GROUP BY l")
add("ex_mde", lambda s, d: experiments.smallest_change(table(s, d, "events"), F.col("value")), "SELECT count(value) AS n, round((1.959963984540054::DOUBLE + 0.8416212335729143::DOUBLE) * sqrt(2 * var_samp(value) / (count(value) / 2)), 4) AS smallest_change FROM events")

# ---- models

_PART = lambda s, d: table(s, d, "part")


def _split(s: SparkSession, d: str) -> DataFrame:
    return models.split(_ORDERS(s, d).withColumn("month", MONTH()), "month", "o_orderkey").groupBy("held_out").agg(F.count("*").alias("n"), F.min("month").alias("first_month"))


add("md_split", _split, "WITH p AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS m FROM orders), r AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS i, count(*) OVER () AS n FROM p), c AS (SELECT m FROM r WHERE i = floor(n * 0.8)) SELECT strftime(o_orderdate, '%Y-%m') >= m AS held_out, count(*) AS n, min(strftime(o_orderdate, '%Y-%m')) AS first_month FROM orders, c GROUP BY 1")


def _scaled(s: SparkSession, d: str) -> DataFrame:
    rows = _PART(s, d)
    return rows.select("p_partkey", F.round(models.scaled(rows, [F.col("p_retailprice")])[0], 4).alias("z"))


add("md_scale", _scaled, "SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 4) AS z FROM part")


def _card(card: dict, keys: list[str]) -> list[tuple]:
    return [(k, float(card[k]) if isinstance(card.get(k), (int, float)) else None, str(card.get(k))) for k in keys]


_CARD = "figure string, value double, shown string"
_LINE = lambda s, d: number_rows(table(s, d, "lineitem"), "l_orderkey", "l_linenumber")
add("md_regress", lambda s, d: s.createDataFrame(_card(models.regression(_LINE(s, d), ["l_quantity", "l_discount"], ["l_returnflag"], "l_extendedprice"), ["fitted", "rows", "held_out", "explained", "verdict"]), _CARD))
add("md_classify", lambda s, d: s.createDataFrame(_card(models.classification(_LINE(s, d), ["l_quantity", "l_discount"], ["l_returnflag"], None, "l_extendedprice"), ["fitted", "rows", "classes", "score", "baseline", "verdict"]), _CARD))
add("md_cluster", lambda s, d: s.createDataFrame(_card(models.clusters(_PART(s, d), ["p_size", "p_retailprice"], "p_partkey"), ["fitted", "k", "silhouette", "verdict"]), _CARD))
add("md_seasonal", lambda s, d: s.createDataFrame(_card(models.seasonal(_TREND(s, d), "month"), ["fitted", "season", "baseline", "verdict"]), _CARD))
add("md_season", lambda s, d: models.seasonal_many(_ORDERS(s, d).groupBy("o_orderpriority", MONTH().alias("label")).agg(F.sum("o_totalprice").alias("total")), "o_orderpriority", 12, 12))


def _ridge(s: SparkSession, d: str) -> DataFrame:
    w, b = models.least_squares(table(s, d, "lineitem"), [F.col("l_quantity"), F.col("l_discount")], F.col("l_extendedprice"))
    return s.createDataFrame([("l_quantity", round(w[0], 2)), ("l_discount", round(w[1], 2)), ("intercept", round(b, 2))], "input string, weight double")


_OLS = "WITH m AS (SELECT count(*)::DOUBLE AS n, sum(l_quantity) AS a, sum(l_discount) AS b, sum(l_extendedprice) AS y, sum(l_quantity * l_quantity) AS aa, sum(l_discount * l_discount) AS bb, sum(l_quantity * l_discount) AS ab, sum(l_quantity * l_extendedprice) AS ay, sum(l_discount * l_extendedprice) AS byy FROM lineitem), c AS (SELECT n, a, b, y, aa - a * a / n + 0.001 * n AS saa, bb - b * b / n + 0.001 * n AS sbb, ab - a * b / n AS sab, ay - a * y / n AS say, byy - b * y / n AS sby FROM m), w AS (SELECT *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS wa, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS wb FROM c)"
add("md_ols", _ridge, _OLS + " SELECT 'l_quantity' AS input, round(wa, 2) AS weight FROM w UNION ALL SELECT 'l_discount', round(wb, 2) FROM w UNION ALL SELECT 'intercept', round(y / n - wa * a / n - wb * b / n, 2) FROM w")
add("md_nb", lambda s, d: models.naive_bayes(table(s, d, "lineitem"), [F.col("l_quantity")], F.col("l_returnflag")).select("label", F.round("prior", 6).alias("prior"), F.round(F.col("means")[0], 4).alias("mean"), F.round(F.col("spreads")[0], 4).alias("spread")), "SELECT l_returnflag AS label, round(ln(count(*) / (SELECT count(*) FROM lineitem)), 6) AS prior, round(avg(l_quantity), 4) AS mean, round(greatest(var_pop(l_quantity), 0.001), 4) AS spread FROM lineitem GROUP BY 1")
_POINTS = "SELECT p_partkey, p_size > 25 AS g, CAST(p_size AS DOUBLE) AS x, p_retailprice / 100 AS y FROM part"
add(
    "md_silhouette",
    lambda s, d: models.silhouette(_PART(s, d).select((F.col("p_size") > 25).cast("int").alias("group"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100).alias("vector"))).select(F.round("silhouette", 4).alias("silhouette")),
    f"WITH p AS ({_POINTS}), d AS (SELECT a.p_partkey AS k, a.g, b.g AS h, sqrt(avg(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM p a JOIN p b ON a.p_partkey <> b.p_partkey GROUP BY 1, 2, 3), s AS (SELECT k, max(d) FILTER (WHERE g = h) AS i, min(d) FILTER (WHERE g <> h) AS n FROM d GROUP BY k) SELECT round(avg(CASE WHEN i IS NULL OR n IS NULL THEN 0 ELSE coalesce((n - i) / nullif(greatest(i, n), 0), 0) END), 4) AS silhouette FROM s",
)

# ---- detectors and the maintenance domain, on frames derived from the tables

_ASSET = "SELECT CAST(o_orderkey AS VARCHAR) AS Record_ID, CAST(o_custkey % 20 AS VARCHAR) AS Asset_ID, o_orderpriority AS Asset_Class, o_orderstatus AS Site, o_orderkey % 4 AS shift, CASE WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE (o_orderkey % 10) / 10.0 END AS rate FROM orders"


def _assets(s: SparkSession, d: str) -> DataFrame:
    return _ORDERS(s, d).selectExpr("o_orderkey AS " + ROW, "CAST(o_orderkey AS STRING) AS Record_ID", "CAST(o_custkey % 20 AS STRING) AS Asset_ID", "o_orderpriority AS Asset_Class", "o_orderstatus AS Site", "CAST(CASE WHEN o_orderkey % 4 = 0 THEN 0.0D ELSE (o_orderkey % 10) / 10.0D END AS STRING) AS rate", "concat('S', o_orderkey % 4) AS shift", "CAST(CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 5 END AS STRING) AS downtime", "CAST(CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 9 END AS STRING) AS failures")


_FOUND = "detector string, severity string, columns string"


def _all_findings(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(f.detector, f.severity, ",".join(f.columns)) for f in detectors.run_all(_assets(s, d), ROW)], _FOUND)


def _collapse(s: SparkSession, d: str) -> DataFrame:
    found = detectors.identity_collapse(detectors.Shape.of(_assets(s, d)))
    return s.createDataFrame([(f.detector, f.severity, ",".join(f.columns), f.numbers["keys"], f.numbers["rows"]) for f in found], _FOUND + ", keys long, rows long")


_IDENTITY = f"WITH a AS ({_ASSET}), g AS (SELECT Asset_ID, count(DISTINCT Asset_Class) AS c, count(DISTINCT Site) AS s, count(DISTINCT shift) AS h FROM a GROUP BY 1), k AS (SELECT count(*) AS keys, (SELECT count(*) FROM a) AS rows, min(c) AS c, min(s) AS s, min(h) AS h FROM g) SELECT 'identity_collapse' AS detector, 'high' AS severity, 'Asset_ID,Asset_Class,Site,shift' AS columns"
_COLLAPSED = "FROM k WHERE keys BETWEEN 10 AND rows * 0.5 AND c > 1 AND s > 1 AND h > 1"
add("dt_identity", _collapse, f"{_IDENTITY}, keys, rows {_COLLAPSED}")
add("dt_leakage", lambda s, d: detectors.purity(_assets(s, d), "shift", F.col("downtime").cast("double") > 0), "WITH g AS (SELECT o_orderkey % 4 AS g, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 4 > 0) AS p FROM orders GROUP BY 1) SELECT count(*) AS groups, CAST(sum(CASE WHEN p >= n * 0.999 OR p <= n * 0.001 THEN n ELSE 0 END) AS BIGINT) AS pure_rows FROM g")
add("dt_placeholder", lambda s, d: detectors.placeholder_gap(detectors.group_rates(_assets(s, d), "rate", "shift")), "WITH r AS (SELECT o_orderkey % 4 AS g, CASE WHEN o_orderkey % 4 = 0 THEN 0.0::DOUBLE ELSE (o_orderkey % 10) / 10.0::DOUBLE END AS x FROM orders), g AS (SELECT g, count(*) AS n, min(x) AS lo, max(x) AS hi, sum(CAST(x AS DECIMAL(28,6)))::DOUBLE AS s FROM r GROUP BY 1), f AS (SELECT *, lo = hi AND n >= 0.05 * (SELECT sum(n) FROM g) AS filler FROM g), z AS (SELECT 100 * sum(s) / sum(n) AS a, 100 * sum(s) FILTER (WHERE NOT filler) / sum(n) FILTER (WHERE NOT filler) AS m, coalesce(sum(n) FILTER (WHERE filler), 0) AS fr, count(*) FILTER (WHERE filler) AS fg, count(*) AS groups FROM f) SELECT round(a, 2) AS mean_all, round(m, 2) AS mean_measured, round(abs(a - m), 2) AS gap, CAST(fr AS BIGINT) AS filler_rows, fg AS filler_groups, groups FROM z")


def _scale(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").selectExpr("CAST(l_discount AS STRING) AS discount_pct", "CAST(l_quantity AS STRING) AS percent_filled", "CAST(l_tax AS STRING) AS tax")
    found = detectors.scale_mislabelled(detectors.Shape.of(rows))
    return s.createDataFrame([(f.severity, f.columns[0], f.numbers["min"], f.numbers["max"]) for f in found], "severity string, column string, lo double, hi double")


add("dt_scale", _scale, "WITH r AS (SELECT 'discount_pct' AS c, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem UNION ALL SELECT 'percent_filled', min(l_quantity), max(l_quantity) FROM lineitem) SELECT 'medium' AS severity, c AS column, round(lo, 4) + 0.0 AS lo, round(hi, 4) + 0.0 AS hi FROM r WHERE lo >= 0 AND hi <= 1")


def _broken(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select((F.col("l_quantity") * 10 + 5).alias("labour_cost"), F.col("l_quantity").alias("parts_cost"), (F.col("l_quantity") * 12 + 6).alias("repair_cost"))
    found = detectors.broken_identity(detectors.Shape.of(rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])))
    return s.createDataFrame([(",".join(f.columns), f.numbers["rows_off"], f.numbers["residual_total"], f.numbers["share_of_total"]) for f in found], "columns string, rows_off long, residual_total double, share_of_total double")


add("dt_broken", _broken, "WITH t AS (SELECT l_quantity * 10 + 5 AS a, l_quantity AS b, l_quantity * 12 + 6 AS r FROM lineitem) SELECT 'repair_cost,labour_cost,parts_cost' AS columns, count(*) AS rows_off, round(sum(r - a - b), 2) AS residual_total, round(sum(r - a - b) / sum(r), 4) AS share_of_total FROM t")
add("dt_uneven", lambda s, d: detectors.period_counts(_ORDERS(s, d).select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("date")), "date"), "SELECT strftime(o_orderdate, '%Y') AS period, count(*) AS n FROM orders GROUP BY 1")
_LEAKED = "SELECT 'target_leakage', 'high', 'shift,downtime,failures' FROM (SELECT count(DISTINCT o_orderkey % 4) AS groups, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS idle, count(*) AS n FROM orders) WHERE groups >= 2 AND least(idle, n - idle) >= greatest(30, n * 0.02)"
_FILLED = "SELECT 'placeholder_rates', 'high', 'rate,shift' FROM (SELECT 100 * avg(CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE (o_orderkey % 10) / 10.0 END) AS a, 100 * avg((o_orderkey % 10) / 10.0) FILTER (WHERE o_orderkey % 4 > 0) AS m FROM orders) WHERE abs(a - m) >= 2"
add("dt_all", _all_findings, f"{_IDENTITY} {_COLLAPSED} UNION ALL {_LEAKED} UNION ALL {_FILLED}")
_KPI = "SELECT CASE WHEN l_returnflag = 'R' THEN 'Corrective' ELSE 'Preventive' END AS Work_Order_Type, CAST(l_linenumber % 3 AS DOUBLE) AS First_Time_Fix_Count, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) END AS Corrective_WO_Count, CAST(l_linenumber % 2 AS DOUBLE) AS Repeat_Repair_Count, l_quantity AS Operating_Hours, l_quantity + 5 AS Planned_Operating_Hours, l_discount * 10 AS Downtime_Hours, l_extendedprice AS Production_Loss_USD, l_tax * 100 AS Maintenance_Cost_USD, CAST(l_linenumber AS DOUBLE) AS Preventive_WO_Count, 0.0 AS Completed_WO_Count, 1.0 AS Overdue_WO_Count FROM lineitem"


def _kpi_rows(s: SparkSession, d: str) -> DataFrame:
    body = _KPI[len("SELECT ") : _KPI.index(" FROM lineitem")].replace("0.0 AS", "0.0D AS").replace("1.0 AS", "1.0D AS")
    return table(s, d, "lineitem").selectExpr(*_select_list(body))


def _kpi_sql(key: str, num: str, den: str, pop: str = "true", scale: int = 1) -> str:
    ok = f"({pop}) AND {num} IS NOT NULL AND {den} IS NOT NULL"
    n, d = f"sum(CAST({num} AS DECIMAL(28,4))) FILTER (WHERE {ok})::DOUBLE", f"sum(CAST({den} AS DECIMAL(28,4))) FILTER (WHERE {ok})::DOUBLE"
    return f"SELECT '{key}' AS kpi, round({n} / nullif({d}, 0) * {scale}, 6) AS value, CASE WHEN count(*) FILTER (WHERE {ok}) = 0 THEN 'nothing measurable' WHEN {d} = 0 THEN 'denominator is zero' END AS undefined, count(*) FILTER (WHERE {ok}) AS records, count(*) FILTER (WHERE NOT ({pop})) AS excluded, count(*) FILTER (WHERE ({pop}) AND ({num} IS NULL OR {den} IS NULL)) AS unmeasured FROM k"


_COR = "Work_Order_Type = 'Corrective'"
_KPIS = [("preventive_share", "Preventive_WO_Count", "Preventive_WO_Count + Corrective_WO_Count", "true", 100), ("first_time_fix", "First_Time_Fix_Count", "Corrective_WO_Count", _COR, 100), ("repeat_repair", "Repeat_Repair_Count", "Corrective_WO_Count", _COR, 100), ("overdue_share", "Overdue_WO_Count", "Completed_WO_Count", "true", 100), ("operating_share", "Operating_Hours", "Planned_Operating_Hours", "true", 100), ("downtime_per_record", "Downtime_Hours", "1", "true", 1), ("loss_per_downtime_hour", "Production_Loss_USD", "Downtime_Hours", "true", 1), ("cost_per_operating_hour", "Maintenance_Cost_USD", "Operating_Hours", "true", 1)]
_KSQL = f"WITH k AS ({_KPI}) "
add("kp_register", lambda s, d: maintenance.compute(_kpi_rows(s, d)), _KSQL + " UNION ALL ".join(_kpi_sql(*k) for k in _KPIS))
add("kp_compute", lambda s, d: maintenance.compute(_kpi_rows(s, d)), _KSQL + " UNION ALL ".join(_kpi_sql(*k) for k in _KPIS))
add("kp_rowmean", lambda s, d: maintenance.row_mean(_kpi_rows(s, d), next(k for k in maintenance.register() if k.key == "operating_share")).select(F.round("row_mean", 4).alias("row_mean")), _KSQL + "SELECT round(avg(Operating_Hours / Planned_Operating_Hours) * 100, 4) AS row_mean FROM k")


def _risk_rows(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").selectExpr(f"l_orderkey * 10 + l_linenumber AS {ROW}", "date_format(l_shipdate, 'yyyy-MM') AS Record_Date", "CASE WHEN l_returnflag = 'R' THEN 'Corrective' ELSE 'Preventive' END AS Work_Order_Type", "CAST(l_linenumber AS STRING) AS Failure_Count", "l_linestatus AS Site", "l_returnflag AS Shift", "CAST(l_quantity AS STRING) AS SLA_Target_Hours", "CAST(l_quantity * (0.5 + l_tax * 12) AS STRING) AS SLA_Actual_Hours", "CAST(l_tax AS STRING) AS Asset_Age_Years")


add("rk_targets", lambda s, d: maintenance.labelled(_risk_rows(s, d), "repeat_failure").groupBy("label").agg(F.count("*").alias("n")), "SELECT l_linenumber > 1 AS label, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")


def _rule(s: SparkSession, d: str) -> DataFrame:
    rows = models.split(maintenance.labelled(_risk_rows(s, d), "sla_breach"), None)
    return maintenance.rule_counts(rows, "Shift", ROW)


_RK = "WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS g, l_quantity * (0.5 + l_tax * 12) > l_quantity AS label FROM lineitem), c AS (SELECT g, label, count(*) AS n, min(id) AS o FROM r WHERE id % 5 > 0 GROUP BY 1, 2), b AS (SELECT g, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, o) AS i FROM c) WHERE i = 1), p AS (SELECT label AS actual, predicted FROM r JOIN b USING (g) WHERE id % 5 = 0) "
add("rk_rule", _rule, _RK + "SELECT actual, predicted, count(*) AS n FROM p GROUP BY 1, 2")
add("rk_bacc", lambda s, d: models.balanced_accuracy(table(s, d, "labels").select(F.col("quality").alias("actual"), F.col("toxic").alias("predicted"))), "WITH g AS (SELECT quality, count(*) FILTER (WHERE quality = toxic) / count(*) AS r FROM labels GROUP BY 1) SELECT round(avg(r), 6) AS balanced_accuracy, count(*) AS classes FROM g")
add("rk_eval", lambda s, d: s.createDataFrame(_card(maintenance.risk(_risk_rows(s, d), "sla_breach"), ["fitted", "train", "test", "score", "baseline", "verdict"]), _CARD))

# ---- audit and live data

add("au_evals", lambda s, d: stages.confusion(table(s, d, "labels"), "quality", "toxic"), "WITH c AS (SELECT quality AS t, toxic AS g, count(*) AS n FROM labels GROUP BY 1, 2), k AS (SELECT DISTINCT t AS c FROM c UNION SELECT DISTINCT g FROM c) SELECT k.c AS class, round(h / nullif(g, 0), 4) AS precision, round(h / nullif(s, 0), 4) AS recall, round(2 * (h / nullif(g, 0)) * (h / nullif(s, 0)) / nullif(h / nullif(g, 0) + h / nullif(s, 0), 0), 4) AS f1, CAST(s AS BIGINT) AS support FROM (SELECT k.c, coalesce(sum(n) FILTER (WHERE t = k.c), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE g = k.c), 0)::DOUBLE AS g, coalesce(sum(n) FILTER (WHERE t = k.c AND g = k.c), 0)::DOUBLE AS h FROM k, c GROUP BY k.c) k")


def _lineage(s: SparkSession, d: str) -> DataFrame:
    claims = _ORDERS(s, d).select(F.concat(F.lit("cl"), F.col("o_orderkey")).alias("claim"), (F.col("o_custkey") * 2).alias("calculation"))
    return stages.dangling(claims, table(s, d, "customer").select(F.col("c_custkey").alias("calculation"))).groupBy("calculation").agg(F.count("*").alias("claims"))


add("au_lineage", _lineage, "SELECT o_custkey * 2 AS calculation, count(*) AS claims FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer) GROUP BY 1")


def _events_once(s: SparkSession, d: str) -> DataFrame:
    """A stream that sends every event twice, through the feed without repeats, into files."""
    stream = live.table_stream(s, f"{d}/events.parque[t]", table(s, d, "events").schema)
    path = _new_file(s, "updates")
    once = live.updates(stream.unionByName(stream), "ts", "event_id")
    once.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(once.schema).parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


add("lv_events", _events_once, "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
add("lv_poll", lambda s, d: live.poll(table(s, d, "events"), "2024-01-10 00:00:00~~", "ts", "event_type", "event_id").select("event_id"), "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts, event_type, CAST(event_id AS VARCHAR) LIMIT 100")
add("x_sessions", lambda s, d: live.sessions(table(s, d, "events"), "ts", "user_id").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events")), "WITH g AS (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events) SELECT user_id, CAST(sum(new) AS BIGINT) AS sessions, count(*) AS events FROM g GROUP BY 1")
add("x_windows", lambda s, d: live.windowed(table(s, d, "events"), "ts", "value", "event_type").select(F.col("start").cast("string").alias("start"), "event_type", "n", F.round("total", 2).alias("total")), "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")

# ---- decisions that the driver takes from small figures


def _suggested(s: SparkSession, d: str) -> DataFrame:
    mapping, why = clean.suggest(messy(s, d))
    return s.createDataFrame([(c, r, why[c]) for c, r in mapping.roles.items()], "name string, role string, why string")


add("mp_suggest", _suggested)
add("kp_avail", lambda s, d: s.createDataFrame([(k, ",".join(v)) for k, v in maintenance.computable(_kpi_rows(s, d).columns[:8], maintenance.register())[1].items()], "kpi string, missing string"))
add(
    "jn_preview",
    lambda s, d: joins.preview(joins.merge(holed(s, d), [_customers(s, d)], [joins.Join((("cust", "code"),), name="customers.csv")])),
    WITH + f", c AS ({_LOOK}) SELECT t.*, coalesce(c.segment, '') AS segment, c.balance FROM t LEFT JOIN c ON t.cust = CAST(c.code AS DOUBLE) ORDER BY o_orderkey LIMIT 5",
)
add("ex_detect", lambda s, d: s.createDataFrame([(experiments.find_column(_EVENTS(s, d).withColumnRenamed("arm", "variant"), ["variant"]) or ("none",))[:1]], "column string"))


# ---- files of every kind, snapshots and exports


def _put(s: SparkSession, name: str, body: bytes) -> str:
    """A small file in the shared folder, written through the session's own file systems."""
    path = f"{store.work_folder(s)}/{uuid.uuid4().hex}{name}"
    at = s._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(s._jsc.hadoopConfiguration()).create(at)
    try:
        stream.write(body)
    finally:
        stream.close()
    return path


def _nations(s: SparkSession, d: str) -> list[tuple[str, str]]:
    """25 rows by definition."""
    return [(str(r["n_nationkey"]), r["n_name"]) for r in table(s, d, "nation").orderBy("n_nationkey").collect()]


def _told(s: SparkSession, d: str, named: bool) -> DataFrame:
    """One table in four formats, told apart by name or by content alone."""
    rows, parts = table(s, d, "nation").selectExpr("CAST(n_nationkey AS STRING) AS key", "n_name AS name").coalesce(1), []
    for fmt in ("csv", "jsonl", "parquet"):
        path = f"{store.work_folder(s)}/{uuid.uuid4().hex}" + f".{fmt}" * named
        rows.write.format("json" if fmt == "jsonl" else fmt).options(**({"header": True} if fmt == "csv" else {})).save(path)
        parts.append(files.read_table(s, path))
    parts.append(files.read_table(s, _put(s, ".json" * named, json.dumps([{"key": k, "name": n} for k, n in _nations(s, d)]).encode())))
    return reduce(DataFrame.unionByName, [x.df.select(F.lit(x.format).alias("format"), "key", "name") for x in parts])


_TOLD = "SELECT f AS format, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation, (VALUES ('csv'), ('jsonl'), ('parquet'), ('json')) v(f)"
add("src_dispatch", lambda s, d: _told(s, d, True), _TOLD)
add("src_detect", lambda s, d: _told(s, d, False), _TOLD)


def _csv_text(head: str, line: Callable[[str, str], str], code: str = "utf-8") -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        body = head + "\r\n" + "".join(line(k, n) + "\r\n" for k, n in _nations(s, d))
        return files.read_table(s, _put(s, ".csv", body.encode(code))).df.withColumnRenamed(ROW, "place")

    return run


def _lines(s: SparkSession, d: str, source: str, key: str, first: str, line: str, last: str = "", one: bool = False) -> str:
    """A folder of text written by Spark: ``first``, a ``line`` (SQL) for each row by ``key``, ``last``; in one file or several."""
    rows = table(s, d, source).selectExpr(f"{key} AS _o", f"{line} AS value")
    ends = s.createDataFrame([(-1, first)] + [(2**62, last)] * bool(last), "_o long, value string")
    path, whole = _new_file(s, "lines"), ends.unionByName(rows)
    whole = whole.coalesce(1) if one else whole.repartitionByRange("_o")
    whole.sortWithinPartitions("_o").select("value").write.text(path)
    return path


def _as_csv(head: str, line: str, source: str = "customer", key: str = "c_custkey") -> Query:
    return lambda s, d: files.read_table(s, _lines(s, d, source, key, head, line), "csv").df.withColumnRenamed(ROW, "place")


_AS_READ = "SELECT CAST(n_nationkey AS VARCHAR) AS key, {0}, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation"
_AS_LINES = "SELECT CAST(c_custkey AS VARCHAR) AS key, {0}, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer"
add("src_decode", _csv_text("key,name", lambda k, n: f"{k},{n} \u00e9\u0661", "utf-16"), _AS_READ.format("n_name || ' \u00e9\u0661' AS name"))
add("src_sniff", _as_csv("key;name;mark", "concat(c_custkey, ';', c_name, ', ', c_custkey, ';x')"), _AS_LINES.format("c_name || ', ' || c_custkey AS name, 'x' AS mark"))
add(
    "src_header",
    _as_csv(" key ,,name,name", "concat(c_custkey, ',', left(c_name, 1), ',', c_name, CASE WHEN c_custkey % 2 = 1 THEN concat(',', c_custkey) ELSE '' END)"),
    _AS_LINES.format("c_name[1:1] AS column_2, c_name AS name, CASE WHEN c_custkey % 2 = 1 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS name_2"),
)
# Every third order has a cell of two lines, with separators and quotes in it.
add(
    "src_csv_quoted",
    _as_csv(
        "key,note,price",
        """concat(o_orderkey, ',', CASE WHEN o_orderkey % 3 = 0 THEN concat('"', o_orderpriority, ', ""', o_orderstatus, '""\n', date_format(o_orderdate, 'yyyy-MM-dd'), '"') ELSE o_orderstatus END, ',', o_custkey)""",
        "orders",
        "o_orderkey",
    ),
    """SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || ', "' || o_orderstatus || '"' || chr(10) || strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderstatus END AS note,
 CAST(o_custkey AS VARCHAR) AS price, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders""",
)


def _json_list(s: SparkSession, d: str) -> DataFrame:
    least = table(s, d, "customer").agg(F.min("c_custkey")).first()[0]
    line = f"""concat(CASE WHEN c_custkey = {least} THEN '' ELSE ',' END, to_json(named_struct('key', c_custkey, 'name', concat(c_name, ' }}, "[', c_mktsegment), 'of', named_struct('nation', c_nationkey))))"""
    return files.read_table(s, _lines(s, d, "customer", "c_custkey", "[", line, "]", one=True), "json").df.withColumnRenamed(ROW, "place")


add("src_json_list", _json_list, _AS_LINES.format("""c_name || ' }, "[' || c_mktsegment AS name, CAST(c_nationkey AS VARCHAR) AS "of.nation" """))
# A workbook's parts by the public format; style 1 shows a date.
_BOOK = {
    "xl/workbook.xml": '<workbook xmlns="{0}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Nations" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/one.xml"/></Relationships>',
    "xl/styles.xml": '<styleSheet xmlns="{0}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    "xl/worksheets/one.xml": '<worksheet xmlns="{0}"><sheetData>{1}</sheetData></worksheet>',
}


def _workbook(s: SparkSession, d: str) -> DataFrame:
    text_cell = lambda x: f'<c t="inlineStr"><is><t>{x}</t></is></c>'
    rows = ["".join(map(text_cell, ("key", "name", "day")))]
    rows += [f'<c><v>{k}</v></c>{text_cell(n)}<c s="1"><v>{10 + 50 * int(k)}</v></c>' for k, n in _nations(s, d)]
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as book:
        for name, part in _BOOK.items():
            book.writestr(name, part.format("http://schemas.openxmlformats.org/spreadsheetml/2006/main", "".join(f"<row>{r}</row>" for r in rows)))
    return files.read_table(s, _put(s, ".xlsx", body.getvalue())).df.withColumnRenamed(ROW, "place")


add("src_xlsx", lambda s, d: _workbook(s, d).drop("day"), _AS_READ.format("n_name AS name"))
add("src_xlsx_dates", lambda s, d: _workbook(s, d).select("key", "day"), "SELECT CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_nationkey = 1 THEN '1900-02-29' ELSE strftime(DATE '1899-12-30' + CAST(10 + 50 * n_nationkey + CASE WHEN n_nationkey < 1 THEN 1 ELSE 0 END AS INT), '%Y-%m-%d') END AS day FROM nation")


def _stored(s: SparkSession, d: str) -> DataFrame:
    """The same rows twice, the second time dealt in another way: one snapshot, written once."""
    rows, root = number_rows(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey"), _new_file(s, "snapshots")
    kept = [store.snapshot(x, root) for x in (rows, rows.repartition(7, "o_orderpriority"), rows.where("o_orderkey > 1"))]
    return reduce(DataFrame.unionByName, [s.read.parquet(path).agg(F.lit(i).alias("attempt"), F.lit(new).alias("written"), F.count("*").alias("n")) for i, (path, new) in enumerate(kept)])


add("src_store", _stored, "SELECT i AS attempt, i <> 1 AS written, count(*) AS n FROM orders, (VALUES (0), (1), (2)) v(i) WHERE i < 2 OR o_orderkey > 1 GROUP BY i")


def _canonical(s: SparkSession, d: str) -> DataFrame:
    path, _ = store.snapshot(files.read_table(s, f"{d}/customer.parquet").df.drop("c_comment"), _new_file(s, "snapshots"))
    return s.read.parquet(path).select("c_custkey", "c_name", "c_mktsegment")


add("src_canonical", _canonical, "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
add("src_sample", lambda s, d: store.sample_dataset(s).drop(ROW), "SELECT '2025-' || lpad(CAST(m + 1 AS VARCHAR), 2, '0') AS month, CASE r WHEN 0 THEN 'North' ELSE 'South' END AS region, CASE c WHEN 0 THEN 'Hardware' WHEN 1 THEN 'Software' ELSE 'Services' END AS category, CAST((40 + 3 * m + 10 * r + 5 * c) * (12 + 4 * c) AS VARCHAR) AS revenue, CAST(40 + 3 * m + 10 * r + 5 * c AS VARCHAR) AS units FROM range(12) a(m), range(2) b(r), range(3) e(c)")


def _export(s: SparkSession, d: str) -> DataFrame:
    path = _new_file(s, "export")
    store.write_aggregates({"groups": _GROUPS(s, d).select("group", "n")}, path)
    return s.read.schema("`group` string, n long").option("header", True).csv(f"{path}/groups")


add("sink_export", _export, 'SELECT o_orderpriority AS "group", count(*) AS n FROM orders GROUP BY 1')


add(
    "sink_name",
    lambda s, d: table(s, d, "customer").select("c_custkey", store.name_of(F.concat("c_name", F.lit(" & more, "), "c_mktsegment"), F.col("c_custkey").cast("string")).alias("name")),
    "SELECT c_custkey, trim(regexp_replace(lower(c_name || ' & more, ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-')[1:48] || '-' || c_custkey || '-cleaned.csv' AS name FROM customer",
)

# ---- joins as a stage, names on a clash, refusals, inputs and charts


def _clash(s: SparkSession, d: str) -> DataFrame:
    look = table(s, d, "customer").selectExpr("CAST(c_custkey AS STRING) AS code", "c_mktsegment AS status", "c_acctbal AS price")
    merged = joins.merge(holed(s, d), [joins.Lookup(look, frozenset({"price"}))], [joins.Join((("cust", "code"),), name="Our customers.xlsx")])
    return merged.table.df.select("o_orderkey", "status", "price", "`our_customers.status`", "`our_customers.price`")


add("jn_rename", _clash, WITH + """SELECT o_orderkey, status, price, coalesce(c_mktsegment, '') AS "our_customers.status", c_acctbal AS "our_customers.price" FROM t LEFT JOIN customer ON cust = c_custkey""")
_SOLD = "SELECT CAST(o_custkey AS {0}) AS customer, o_orderpriority AS priority, CAST(o_totalprice AS {0}) AS amount FROM orders"


def _sold(s: SparkSession, d: str, *lookups: tuple[DataFrame, joins.Join, clean.Mapping]) -> stages.Context:
    """A run up to its cleaned table."""
    raw = table(s, d, "orders").selectExpr(*_select_list(_SOLD.format("STRING")[len("SELECT ") : -len(" FROM orders")]), f"o_orderkey AS {ROW}")
    ctx = stages.Context(raw, clean.Mapping({"customer": "dimension", "priority": "dimension", "amount": "measure"}, "amount", "priority"), lookups=list(lookups))
    for name in ("cleaner", *["merge"] * bool(lookups), "governance"):
        ctx.results[name] = stages.STAGES[name](ctx)
    return ctx


def _join_stage(s: SparkSession, d: str) -> DataFrame:
    look = table(s, d, "customer").selectExpr("CAST(CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS STRING) AS code", "c_mktsegment AS segment", f"c_custkey AS {ROW}")
    found = _sold(s, d, (look, joins.Join((("customer", "code"),), "inner", name="c.csv"), clean.Mapping({"code": "dimension", "segment": "dimension"}))).results["merge"]
    return s.createDataFrame([(c.name, float(c.value)) for c in found.calculations] + [(c.name, float(c.passed)) for c in found.checks], "name string, value double")


add("jn_stage", _join_stage, f"WITH r AS (SELECT DISTINCT * FROM ({_SOLD.format('VARCHAR')})), j AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE customer IN (SELECT code FROM ({_LOOK})))::DOUBLE AS hit FROM r) SELECT 'rows_before_c' AS name, n AS value FROM j UNION ALL SELECT 'rows_matched_c', hit FROM j UNION ALL SELECT 'rows_after_c', hit FROM j UNION ALL SELECT 'coverage_c', round(hit / n, 4) FROM j UNION ALL SELECT 'join_c_adds_no_row', 1.0 FROM j")


def _refused(s: SparkSession, d: str) -> DataFrame:
    ctx = _sold(s, d)
    return s.createDataFrame([(r["lift"], r["per_arm"]) for r in stages.STAGES["experiment"](ctx).output["sizing"]], "lift double, per_arm long")


add("ex_refuse", _refused, f"WITH r AS (SELECT DISTINCT * FROM ({_SOLD.format('VARCHAR')})) SELECT l AS lift, CAST(ceil({_Z} * var_samp(CAST(amount AS DOUBLE)) / pow(abs(avg(CAST(amount AS DOUBLE))) * l, 2)) AS BIGINT) AS per_arm FROM r, (VALUES (0.05::DOUBLE), (0.10::DOUBLE), (0.20::DOUBLE)) v(l) GROUP BY l")


def _problems(s: SparkSession, d: str) -> DataFrame:
    wrong = clean.Mapping({"priority": "dimension", "amount": "measure", "status": "measure", "ghost": "dimension"}, "status", "amount")
    try:
        clean.validate(messy(s, d), wrong)
    except clean.MappingError as e:
        return s.createDataFrame(e.problems, "field string, column string, message string")
    raise AssertionError("a wrong mapping was accepted")


add("mp_validate", _problems, _MSQL + "SELECT 'roles' AS field, 'ghost' AS column, '“ghost” is not a column of this dataset.' AS message UNION ALL SELECT 'dimension', 'amount', 'The breakdown must be a column mapped as a dimension.' UNION ALL SELECT 'roles', 'status', '“status” cannot be a measure: 0 of ' || format('{:,}', count(*) FILTER (WHERE status <> '')) || ' filled cells are numbers.' FROM m")


def _inputs(s: SparkSession, d: str) -> DataFrame:
    rows = _LINE(s, d)
    found = models.Inputs.of(rows, ["l_quantity"], ["l_returnflag", "l_shipdate", "l_linestatus"])
    sums = rows.agg(*[F.sum(c.cast("decimal(28,2)")).cast("double").alias(f"c{i}") for i, c in enumerate(found.columns)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("input"), F.col(f"c{i}").alias("total")) for i, n in enumerate(found.names)])))


_LEVELS = "SELECT '{0} = ' || v, n::DOUBLE FROM (SELECT {0} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(l_orderkey * 10 + l_linenumber)) AS i FROM lineitem GROUP BY 1) WHERE i > 1"
add("md_inputs", _inputs, "SELECT 'l_quantity' AS input, sum(CAST(l_quantity AS DECIMAL(28,2)))::DOUBLE AS total FROM lineitem UNION ALL " + " UNION ALL ".join(_LEVELS.format(c) for c in ("l_returnflag", "l_linestatus")))


def _charts(s: SparkSession, d: str) -> DataFrame:
    drawn = analysis.charts(_GROUPS(s, d), _TREND(s, d))
    return s.createDataFrame([(k, x, float(y)) for k in ("bar", "line") for x, y in drawn[k]], "chart string, label string, value double").withColumn("ahead", F.expr(f"chart = 'line' and label >= '{drawn['forecast_from']}'"))


add("vz_charts", _charts, _F.replace("WITH ", f"WITH {_G}, ", 1) + "SELECT 'bar' AS chart, \"group\" AS label, total AS value, false AS ahead FROM g UNION ALL SELECT 'line', label, total, false FROM x UNION ALL SELECT 'line', strftime((SELECT date_trunc('month', max(o_orderdate)) FROM orders) + to_months(CAST(k AS INT)), '%Y-%m'), round(intercept + slope * (n + k - 1), 2), true FROM f, range(1, 4) r(k)")


def _refreshed(s: SparkSession, d: str) -> DataFrame:
    """A source read twice without a change: the second reading starts nothing."""
    root, rows = _new_file(s, "live"), []
    feed = live.SnapshotStream(f"{root}/snapshots", lambda df: rows.append(df.count()))
    for i in range(2):
        stream = live.table_stream(s, f"{d}/events.parque[t]", table(s, d, "events").schema)
        feed.start(stream, f"{root}/progress{i}").awaitTermination()
    return s.createDataFrame([(i, x.changed) for i, x in enumerate(feed.log)], "reading int, changed boolean").withColumn("n", F.lit(sum(rows)).cast("long"))


add("lv_snapshot", _refreshed, "SELECT CAST(i AS INT) AS reading, i = 0 AS changed, count(*) AS n FROM events, range(2) r(i) GROUP BY i")


def _resumed(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events")
    seen = live.cursor_now(rows.where("ts < TIMESTAMP_NTZ '2024-01-10 00:00:00'"), "ts")
    return live.poll(rows, seen, "ts", "event_type", "event_id").select("event_id")


add("lv_resume", _resumed, "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00') ORDER BY ts, event_type, CAST(event_id AS VARCHAR) LIMIT 100")

QUERIES |= catalog_tables.QUERIES
ORACLE |= catalog_tables.ORACLE
