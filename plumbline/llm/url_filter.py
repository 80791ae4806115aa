"""URL filters: a Bloom filter cascade, with DataFrame functions only.

A rule is a (host, path) pair; it fits its host and every subdomain where the url's path starts with its path.
The keys looked up for a url are its host suffixes joined with its path cut at each length a rule has. Level 1 of
a cascade is a Bloom filter of the listed keys, level 2 one of the corpus's keys that pass level 1 unlisted,
level 3 of the listed keys that pass level 2, and so on until nothing passes falsely. Over the key universe it
was built from the answer is exact, and a lookup is bit tests on literal arrays: no join.

A filter has 16 bits a key; the arrays are literals of the plan, so ``most_bytes`` bounds each. A longer list is dealt
by a hash of the key into cascades within the bound, and the urls pass one after the other, written in between.

Defined cases: a null url or one without ``://`` has an empty host and path and fits no rule; an empty host label
(``a..b``) is a label; of a host of very many labels only as many as a rule has are looked at; repeated urls are judged
alike; extra columns pass through whatever their names, and result columns replace columns of their name.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, lower_ascii, materialize, packed, unpacked

RESULT = ["host", "path", "rule", "verdict"]
HASHES = 4
#: Bytes of a filter: as a literal it goes into the plan, at most three times as long.
MOST_BYTES = 4 << 20


def with_parts(pages: DataFrame) -> tuple[DataFrame, list[str]]:
    """``pages`` with host and path, cut by positions as the rules say."""
    url = F.coalesce(pages["url"].cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rows, own = packed(pages, F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit("")).alias("rest"), without=RESULT)
    host = lower_ascii(F.regexp_extract("rest", r"^[^/?#]*", 0))
    path = F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1)
    return rows.select(*held(own), host.alias("host"), path.alias("path")), own


def keys(shapes: Sequence[tuple[int, int]]) -> Column:
    """The keys of a row's host and path that a rule can have: of (labels, path length) pairs, the host's last labels
    and the path's first characters, joined. A null label count means none has that many."""
    labels = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    made = [F.when((labels >= n) & (F.length("path") >= cut), F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, cut))) for n, cut in shapes]
    known = F.array_compact(F.array(*made)) if made else F.array().cast("array<string>")
    return F.when(F.length("host") > 0, known).otherwise(F.array().cast("array<string>"))


class Bloom:
    """One level: ``words`` 64-bit words, tested by HASHES positions of one hash."""

    def __init__(self, level: int, words: list[int]):
        self.level, self.words = level, words

    @staticmethod
    def positions(key: Column, level: int, bits: int) -> list[Column]:
        """Double hashing: two 64-bit hashes give all positions."""
        a, b = F.xxhash64(key, F.lit(level)), F.xxhash64(key, F.lit(level + 1000))
        return [F.pmod(F.shiftrightunsigned(a, 1) % bits + F.lit(i) * (F.shiftrightunsigned(b, 1) % bits), F.lit(bits)) for i in range(HASHES)]

    @classmethod
    def of(cls, listed: DataFrame, level: int, n: int, bits_per_key: int, most_bytes: int) -> Bloom:
        """From ``n`` keys in column ``key``; the words are gathered only after their number is checked."""
        size = max(1, -(-n * bits_per_key // 64))
        if size * 8 > most_bytes:
            raise ValueError(f"a filter of {n} keys has {size * 8} bytes, above {most_bytes}: split the list")
        bit = F.explode(F.array(*cls.positions(F.col("key"), level, size * 64))).alias("bit")
        made = listed.select(bit).groupBy(F.expr("cast(bit div 64 as int)").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("word"))
        words = [0] * size
        for row in made.collect():
            words[row["at"]] = row["word"]
        return cls(level, words)

    def test(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        hit = lambda p: F.getbit(F.element_at(words, (F.floor(p / 64) + 1).cast("int")), (p % 64).cast("int")) == 1
        return reduce(lambda a, b: a & b, [hit(p) for p in self.positions(key, self.level, len(self.words) * 64)])


class Cascade:
    """Exact membership of listed keys over the universe that it was built from."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, bits_per_key: int = 16, most_bytes: int = MOST_BYTES) -> Cascade:
        """``listed`` and ``universe`` have a column ``key``. The universe may repeat keys: only those that pass
        level 1 are made distinct, after the test, so the first scan shuffles next to nothing."""
        listed = listed.select("key").distinct()
        inside, n = listed, listed.count()
        levels: list[Bloom] = []
        outside: DataFrame | None = None
        while n:
            levels.append(Bloom.of(inside, len(levels), n, bits_per_key, most_bytes))
            if outside is None:
                passing = universe.select("key").where(levels[-1].test(F.col("key"))).distinct()
                other = materialize(passing.join(listed, "key", "left_anti"), "cascade")
            else:
                other = materialize(outside.where(levels[-1].test(F.col("key"))), "cascade")
            outside, inside, n = inside, other, other.count()
        return cls(levels)

    def contains(self, key: Column) -> Column:
        """Levels in turn: the first that says no decides; an odd one (counting from 1) says unlisted."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            answer = F.when(level.test(key), answer).otherwise(F.lit(i % 2 == 1))
        return answer


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``pages`` (with a url) with host, path, rule and verdict. ``rules``: (verdict, host, path); the longest that
    fits decides, ``default`` where none does."""
    spark: SparkSession = pages.sparkSession
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    found, own = with_parts(pages)
    found = found.withColumn("keys", keys(shapes))
    best = F.lit(None).cast("struct<n:int,key:string,verdict:string>")
    passes = max([1, *[passes_for(sum(v == kind for v, _, _ in rules), most_bytes) for kind in {v for v, _, _ in rules}]])
    part_of = lambda k: F.pmod(F.xxhash64(k, F.lit("part")), F.lit(passes))
    for nth in range(passes):
        mine = found.select(F.filter("keys", lambda k: part_of(k) == nth).alias("keys") if passes > 1 else F.col("keys"))
        universe = mine.select(F.explode("keys").alias("key"))
        hits = [best]
        for kind in sorted({v for v, _, _ in rules}):
            listed = spark.createDataFrame([(lower(h) + p,) for v, h, p in rules if v == kind], "key string")
            # A hash deals unevenly: a part may be a fifth larger than the mean.
            member = Cascade.build(listed.where(part_of(F.col("key")) == nth) if passes > 1 else listed, universe, most_bytes=most_bytes * 6 // 5 + 64)
            hits.append(longest(member, kind, (lambda k: part_of(k) == nth) if passes > 1 else None))
        found = found.select(*held(own), "host", "path", "keys", F.array_max(F.array_compact(F.array(*hits))).alias("best"))
        best = F.col("best")
        if nth + 1 < passes:
            found = materialize(found, "url-pass")
    return found.select(*unpacked(own), "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def longest(member: Cascade, kind: str, mine=None) -> Column:
    """The longest key of a row that ``member`` contains, as (length, key, verdict); null if there is none."""

    def test(k: Column) -> Column:
        return member.contains(k) if mine is None else mine(k) & member.contains(k)

    return F.array_max(F.transform(F.filter("keys", test), lambda k: F.struct(F.length(k).alias("n"), k.alias("key"), F.lit(kind).alias("verdict"))))


def passes_for(n: int, most_bytes: int, bits_per_key: int = 16) -> int:
    """Cascades that a list of ``n`` keys is dealt into."""
    return max(1, -(-n * bits_per_key // 8 // most_bytes)) if n * bits_per_key // 8 > most_bytes else 1


def lower(host: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)


#: The rules of the registered query: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

ORACLE = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fit USING (page_id)
"""
