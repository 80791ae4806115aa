"""Registered queries beyond the original operators: joins by time, states of a table compared, cubes, sketches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import changes, query, semistructured, sketches, temporal
from .operators.table import AnalysisTable, work_folder
from .streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
HOUR = 3_600_000_000


def add(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- by time


def _asof(s: SparkSession, d: str) -> DataFrame:
    """Each purchase with the same user's last click before it."""
    events = table(s, d, "events")
    bought, clicks = events.where("event_type = 'purchase'"), events.where("event_type = 'click'").select("event_id", "user_id", "ts", "value")
    found = temporal.asof(bought, clicks, ["user_id"], "ts", ties=["event_id"], strict=True)
    return found.select("event_id", "last_event_id", "last_value")


add(
    "x_asof",
    _asof,
    """SELECT b.event_id, arg_max(c.event_id, (c.ts, c.event_id)) AS last_event_id, arg_max(c.value, (c.ts, c.event_id)) AS last_value
 FROM (FROM events WHERE event_type = 'purchase') b LEFT JOIN (FROM events WHERE event_type = 'click') c ON b.user_id = c.user_id AND c.ts < b.ts
 GROUP BY b.event_id""",
)


def _previous(s: SparkSession, d: str) -> DataFrame:
    """Each event with the event before it of its type: five keys hold all rows."""
    events = table(s, d, "events").select("event_id", "event_type", "ts")
    found = temporal.asof(events, events, ["event_type"], "ts", ties=["event_id"], strict=True)
    return found.select("event_id", "last_event_id")


add(
    "x_asof_hot",
    _previous,
    """SELECT e.event_id, p.event_id AS last_event_id FROM events e ASOF LEFT JOIN
 (SELECT event_type, ts, max(event_id) AS event_id FROM events GROUP BY ALL) p ON e.event_type = p.event_type AND e.ts > p.ts""",
)


def _interval(s: SparkSession, d: str) -> DataFrame:
    """Pairs of a user's events: another one within the hour after."""
    events = table(s, d, "events").select("event_id", "user_id", "ts")
    pairs = temporal.interval_join(events, events, ["user_id"], "ts", 0, HOUR)
    return pairs.where("event_id <> near_event_id").select("event_id", "near_event_id")


add(
    "x_interval",
    _interval,
    """SELECT a.event_id, b.event_id AS near_event_id FROM events a JOIN events b
 ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR AND a.event_id <> b.event_id""",
)
add(
    "x_interval_anti",
    lambda s, d: temporal.interval_join(table(s, d, "events").where("event_type = 'error'"), table(s, d, "events").where("event_type = 'view'"), ["user_id"], "ts", -12 * HOUR, 0, how="anti").select("event_id"),
    """SELECT event_id FROM events a WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events b
 WHERE b.event_type = 'view' AND a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 12 HOUR AND a.ts)""",
)


def _frames(s: SparkSession, d: str) -> DataFrame:
    """Spending of each customer in the 30 days up to each order."""
    orders = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    day = 86_400_000_000
    made = temporal.range_frames(orders, ["o_custkey"], "o_orderdate", 30 * day, {"spent": F.sum("price"), "orders": F.count("*")})
    return made.select("o_orderkey", F.col("spent").cast("double").alias("spent"), "orders")


add(
    "x_frames",
    _frames,
    """SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS DOUBLE) AS spent, count(*) OVER w AS orders FROM orders
 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW)""",
)

# ---- states of a table

_BEFORE = "SELECT o_orderpriority AS priority, o_orderstatus AS status, o_custkey % 50 AS batch, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 40 END AS mark FROM orders"
_AFTER = (
    "SELECT o_orderpriority AS priority, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_custkey % 50 AS batch, "
    "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 40 END AS mark FROM orders WHERE o_orderkey % 101 > 0"
)


def _states(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tuple(table(s, d, "orders").selectExpr(*_expressions(x), "o_orderkey").where("o_orderkey % 101 > 0" if "WHERE" in x else "true").drop("o_orderkey") for x in (_BEFORE, _AFTER))


def _expressions(sql: str) -> list[str]:
    """The select list of the two statements above, whose commas all stand between expressions."""
    return sql[len("SELECT ") : sql.index(" FROM orders")].split(", ")


add(
    "x_changes",
    lambda s, d: changes.changes(*_states(s, d)),
    f"""SELECT priority, status, batch, mark, count(*) FILTER (WHERE side = 0) AS n_before, count(*) FILTER (WHERE side = 1) AS n_after,
 CASE WHEN n_before = 0 THEN 'added' WHEN n_after = 0 THEN 'removed' WHEN n_after > n_before THEN 'more' ELSE 'fewer' END AS change
 FROM (SELECT *, 0 AS side FROM ({_BEFORE}) UNION ALL SELECT *, 1 FROM ({_AFTER})) GROUP BY 1, 2, 3, 4 HAVING n_before <> n_after""",
)


def _applied(s: SparkSession, d: str) -> DataFrame:
    before, after = _states(s, d)
    now = changes.applied(before, changes.changes(before, after))
    return now.groupBy("priority", "status", "batch", "mark").agg(F.count("*").alias("n"))


add("x_changes_applied", _applied, f"SELECT priority, status, batch, mark, count(*) AS n FROM ({_AFTER}) GROUP BY ALL")


def _reconciled(s: SparkSession, d: str) -> DataFrame:
    """Parts as ordered and as stocked: lineitem against part, keys on either side only included."""
    sold = table(s, d, "lineitem").selectExpr("CASE WHEN l_partkey % 13 = 0 THEN -l_partkey WHEN l_partkey % 17 = 0 THEN NULL ELSE l_partkey END AS part", "l_extendedprice AS amount")
    stock = table(s, d, "part").selectExpr("CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_partkey END AS p_partkey", "p_retailprice AS price")
    return changes.reconcile(sold, stock, [("part", "p_partkey")], [("amount", "price")])


_FULL = """WITH l AS (SELECT CASE WHEN l_partkey % 13 = 0 THEN -l_partkey WHEN l_partkey % 17 = 0 THEN NULL ELSE l_partkey END AS part, l_extendedprice AS amount FROM lineitem),
 a AS (SELECT part, count(*) AS n, sum(CAST(amount AS DECIMAL(28,4))) AS s FROM l GROUP BY 1),
 b AS (SELECT CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_partkey END AS part, count(*) AS n, sum(CAST(p_retailprice AS DECIMAL(28,4))) AS s FROM part GROUP BY 1),
 f AS (SELECT CASE WHEN a.n IS NULL THEN b.part ELSE a.part END AS part, CASE WHEN b.n IS NULL THEN 'left' WHEN a.n IS NULL THEN 'right' ELSE 'both' END AS side,
 coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right, coalesce(a.s, 0)::DOUBLE AS amount_left, coalesce(b.s, 0)::DOUBLE AS amount_right,
 (coalesce(a.s, 0) - coalesce(b.s, 0))::DOUBLE AS amount_apart FROM a FULL JOIN b ON a.part IS NOT DISTINCT FROM b.part) """
add("jn_full", _reconciled, _FULL + "SELECT * FROM f")
add(
    "jn_full_stats",
    lambda s, d: changes.accounts(_reconciled(s, d)),
    _FULL
    + """SELECT side, count(*) AS keys, sum(n_left)::BIGINT AS n_left, sum(n_right)::BIGINT AS n_right, sum(amount_left::DECIMAL(28,4))::DOUBLE AS amount_left,
 sum(amount_right::DECIMAL(28,4))::DOUBLE AS amount_right, sum(amount_apart::DECIMAL(28,4))::DOUBLE AS amount_apart FROM f GROUP BY 1""",
)


# ---- lattices, sketches, semi-structured cells, a feed

_CUBE_ROWS = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority, o_orderstatus AS status, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price, CAST(o_custkey % 97 AS VARCHAR) AS clerk FROM orders"
_CUBE_SQL = """WITH t AS ({rows}) SELECT priority, status, CASE WHEN grouping(priority) = 0 THEN 'g' ELSE 't' END || CASE WHEN grouping(status) = 0 THEN 'g' ELSE 't' END AS level,
 count(*) AS records, round(CAST(sum(CAST(price AS DECIMAL(28,4))) AS DOUBLE), 6) AS sum_price, round(CAST(sum(CAST(price AS DECIMAL(28,4))) AS DOUBLE) / nullif(count(price), 0), 6) AS mean_price,
 min(price) AS min_price, max(price) AS max_price, count(DISTINCT nullif(clerk, '')) AS distinct_clerk FROM t GROUP BY CUBE (priority, status) HAVING count(*) >= 3"""


def _cube(s: SparkSession, d: str) -> DataFrame:
    s_rows = table(s, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"),
        (F.col("o_custkey") % 97).cast("string").alias("clerk"),
    )
    measures = [{"agg": a, "column": "price"} for a in ("sum", "mean", "min", "max")] + [{"agg": "distinct", "column": "clerk"}]
    spec = {"group_by": ["priority", "status"], "sets": "cube", "measures": measures, "having": [{"by": "records", "op": "gte", "value": 3}]}
    return query.lattice(AnalysisTable(s_rows, frozenset({"price", "o_orderkey"}), ("o_orderkey",)), spec)


add("x_cube", _cube, _CUBE_SQL.format(rows=_CUBE_ROWS))
_SHARES = [0.5, 0.9, 0.99]


def _sketched(s: SparkSession, d: str) -> DataFrame:
    """Customers and prices by priority, from sketches that took the orders in three refreshes."""
    orders = table(s, d, "orders")
    kept = sketches.Stored(s, f"{work_folder(s)}/sketches-{uuid.uuid4().hex}", ["o_orderpriority"], ["o_custkey"], ["o_totalprice"])
    for part in range(3):
        kept.refresh(orders.where(F.col("o_orderkey") % 3 == part))
    both = kept.distinct_counts("o_custkey").join(kept.quantiles("o_totalprice", _SHARES), "o_orderpriority")
    return both.select("o_orderpriority", "distinct", "n", *[F.round(f"q{i}", 4).alias(f"q{i}") for i in range(3)])


_STEP = "ln((1 + 0.01::DOUBLE) / (1 - 0.01::DOUBLE))"
add(
    "x_sketch",
    _sketched,
    f"""WITH h AS (SELECT o_orderpriority AS p, ('0x' || substr(md5(o_custkey::VARCHAR), 1, 15))::BIGINT AS h FROM orders),
 r AS (SELECT p, h >> 49 AS register, max(CASE WHEN h & ((1::BIGINT << 49) - 1) = 0 THEN 50 ELSE 50 - length(ltrim(bin(h & ((1::BIGINT << 49) - 1)), '0')) END) AS zeros FROM h GROUP BY 1, 2),
 e AS (SELECT p, 2048 - count(*) AS empty, sum(2.0::DOUBLE ** (-zeros)) AS s FROM r GROUP BY 1),
 c AS (SELECT p, round(CASE WHEN {0.7213 / (1 + 1.079 / 2048) * 2048 * 2048!r}::DOUBLE / (s + empty) <= 5120 AND empty > 0 THEN 2048 * ln(2048.0::DOUBLE / empty) ELSE {0.7213 / (1 + 1.079 / 2048) * 2048 * 2048!r}::DOUBLE / (s + empty) END)::BIGINT AS "distinct" FROM e),
 b AS (SELECT o_orderpriority AS p, ceil(ln(o_totalprice) / {_STEP})::INT AS bucket, count(*) AS n FROM orders GROUP BY 1, 2),
 u AS (SELECT p, bucket, sum(n) OVER (PARTITION BY p ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY p) AS total, 2.0::DOUBLE * (1.01::DOUBLE / 0.99::DOUBLE) ** bucket / (1.01::DOUBLE / 0.99::DOUBLE + 1) AS v FROM b)
SELECT p AS o_orderpriority, any_value("distinct") AS "distinct", max(total)::BIGINT AS n, {", ".join(f"round(min(v) FILTER (WHERE upto >= ceil(total * {q})), 4) AS q{i}" for i, q in enumerate(_SHARES))} FROM u JOIN c USING (p) GROUP BY p""",
)
_PROPS = "CASE WHEN event_id % 10 = 0 THEN '{\"k\": ' WHEN event_id % 10 = 1 THEN NULL WHEN event_id % 10 = 2 THEN '{\"k\": \"many\", \"user\": {\"name\": \"u' || user_id || '\", \"vip\": true}}' ELSE props END"


def _props(s: SparkSession, d: str) -> DataFrame:
    events = table(s, d, "events").select("event_id", "event_type", F.expr(_PROPS).alias("props"))
    kinds = [(("k",), "bigint"), (("user", "name"), "string"), (("user", "vip"), "boolean")]
    made = semistructured.typed(events, "props", kinds)
    return made.groupBy("event_type").agg(F.sum("`props.k`").alias("k"), F.count("`props.k`").alias("n"), F.count_distinct("`props.user.name`").alias("names"), F.count_if("`props.user.vip`").alias("vips"), F.count_if("`props.malformed`").alias("malformed"))


add(
    "x_props",
    _props,
    f"""WITH e AS (SELECT event_id, event_type, {_PROPS} AS props FROM events), j AS (SELECT *, TRY_CAST(props AS JSON) AS v FROM e)
 SELECT event_type, sum(TRY_CAST(v->>'k' AS BIGINT))::BIGINT AS k, count(TRY_CAST(v->>'k' AS BIGINT)) AS n, count(DISTINCT v->>'$.user.name') AS names,
 count(*) FILTER (WHERE (v->>'$.user.vip') = 'true') AS vips, count(*) FILTER (WHERE props IS NOT NULL AND v IS NULL) AS malformed FROM j GROUP BY 1""",
)
add(
    "x_props_paths",
    lambda s, d: semistructured.paths(table(s, d, "events").select(F.expr(_PROPS).alias("props")), "props"),
    f"""WITH e AS (SELECT {_PROPS} AS props FROM events), j AS (SELECT props, TRY_CAST(props AS JSON) AS v FROM e), c AS (SELECT count(*) AS records, count(*) FILTER (WHERE props IS NOT NULL AND v IS NULL) AS malformed,
 count(v->>'k') AS a, count(v->>'$.user.name') AS b, count(v->>'$.user.vip') AS c FROM j)
 SELECT path, type, filled, records, malformed FROM (SELECT 'k' AS path, 'string' AS type, a AS filled, records, malformed FROM c UNION ALL SELECT 'user.name', 'string', b, records, malformed FROM c UNION ALL SELECT 'user.vip', 'boolean', c, records, malformed FROM c)""",
)


def _fed(s: SparkSession, d: str) -> DataFrame:
    """Every event in pages, an eighth of them late and each row there twice: the pages hold each event once."""
    events = table(s, d, "events")
    twice = events.unionByName(events)
    feed = live.Feed(s, f"{work_folder(s)}/feed-{uuid.uuid4().hex}", "ts", "event_type", "event_id", "400 DAYS", most=6_000)
    feed.start(twice, "1970-01-01 00:00:00~~")
    at = f"{work_folder(s)}/pages-{uuid.uuid4().hex}"
    for there in (twice.where("event_id % 8 > 0"), twice):
        feed.pages(there).select("event_id", "page").write.mode("append").parquet(at)
        feed.commit()
    return s.read.parquet(at).groupBy("event_id").agg(F.count("*").alias("n"))


add("lv_feed", _fed, "SELECT event_id, 1::BIGINT AS n FROM events")
