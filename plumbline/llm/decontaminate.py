"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Words are runs of letters and digits, lower-cased. A fixed mask over ``span`` words ignores some positions, so a
seed still matches when an ignored word was replaced. Hashes of all test seeds go into a bit set; a document's
positions are tested against it before any row is made, the few that pass join the test seeds on the hash, and
around each hit the two word sequences are compared position by position.

A document is contaminated by an item if ``window`` words in a row of the item (all of them, if it has fewer)
stand in the document aligned with at most ``2 * window // 13`` words replaced: 2 of 13. A place beyond the
document's ends counts as replaced. The mask 11011 finds
every such window of five words or more: a test tries all placements of replaced words.

Defined cases: null or empty texts have no words and are clean; items of under ``least`` words contaminate
nothing; repeated rows are judged alike; ids are integers (others are refused) and may be null; an empty benchmark
leaves all clean, an empty table stays empty; very long texts are compared whole; extra columns pass through whatever their names, and result columns replace columns of their name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import integer_id, materialize, packed, unpacked

RESULT = ["contaminated", "n_items", "first_item", "best_match"]
WORDS = r"[\p{L}\p{N}]+"


@dataclass(frozen=True)
class Seeds:
    masks: tuple[tuple[int, ...], ...] = ((0, 1, 3, 4),)
    window: int = 13
    least: int = 5
    #: Test seeds up to this number are broadcast (about 300 bytes each); more are joined by shuffle.
    broadcast_rows: int = 200_000
    #: Bits of the bit set: 64 for each test seed, within this bound.
    most_bits: int = 1 << 26

    @property
    def span(self) -> int:
        return 1 + max(m[-1] for m in self.masks)


def allowed(n: Column) -> Column:
    """Replaced words allowed in a window of ``n`` words."""
    return F.floor(2 * n / 13).cast("int")


def word_hashes(text: str) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), 0), lambda w: F.xxhash64(w))


def seed(words: Column, at: Column, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(*[F.get(words, at + o) for o in mask], F.lit(len(mask)))


def with_seeds(rows: DataFrame, s: Seeds, test=None) -> DataFrame:
    """``rows`` has words (hashes): one row for each seed (that passes ``test``), with the words around it."""
    spots = []
    for k, mask in enumerate(s.masks):
        last = F.size("words") - 1 - mask[-1]
        at = F.when(last >= 0, F.sequence(F.lit(0), last))
        if test is not None:
            at = _passing(at, mask, test)
        spots.append(_spots(at, k, mask, s))
    kept = [c for c in rows.columns if c != "words"]
    found = F.explode(F.flatten(F.array_compact(F.array(*spots)))).alias("spot")
    return rows.select(*kept, found).select(*kept, "spot.*")


def _passing(at: Column, mask: tuple[int, ...], test) -> Column:
    return F.filter(at, lambda i: test(seed(F.col("words"), i, mask)))


def _spots(at: Column, k: int, mask: tuple[int, ...], s: Seeds) -> Column:
    reach = s.window - 1 - mask[-1]

    def spot(i: Column) -> Column:
        around = F.transform(F.sequence(i - reach, i + s.window - 1), lambda j: F.when(j >= 0, F.get(F.col("words"), j)))
        return F.struct(F.lit(k).alias("mask"), i.alias("at"), seed(F.col("words"), i, mask).alias("seed"), around.alias("around"))

    return F.transform(at, spot)


def matches(docs: DataFrame, items: DataFrame, s: Seeds, key: list[str]) -> DataFrame:
    """(key..., item_id, matched): the best window of each document and item that qualifies."""
    tests = items.select("item_id", word_hashes("text").alias("words")).withColumn("n", F.size("words")).where(F.col("n") >= s.least)
    tests = materialize(with_seeds(tests, s), "decontaminate-tests").withColumnsRenamed({"at": "item_at", "around": "item_around"})
    n_tests = tests.count()
    bits = min(s.most_bits, max(64, 1 << (64 * n_tests - 1).bit_length() if n_tests else 64))
    position = lambda h: F.pmod(h, F.lit(bits))
    words = [0] * (bits // 64)
    made = tests.select(position(F.col("seed")).alias("bit")).groupBy(F.expr("cast(bit div 64 as int)").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("word"))
    for row in made.collect():
        words[row["at"]] = row["word"]
    held = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    test = lambda h: F.getbit(F.get(held, F.shiftright(position(h), 6).cast("int")), position(h).bitwiseAND(63).cast("int")) == 1

    hits = with_seeds(docs.select(*key, word_hashes("text").alias("words")), s, test)
    tests = F.broadcast(tests) if n_tests <= s.broadcast_rows else tests
    both = hits.join(tests, ["mask", "seed"])
    # Where a window of w words starts in ``around``: its first place is item position item_at - reach.
    w = F.least(F.lit(s.window), F.col("n"))
    both = both.withColumns({"equal": F.zip_with("around", "item_around", lambda a, b: F.when(a == b, 1).otherwise(0)), "w": w, "from": F.col("item_at") - (F.size("around") - s.window)})
    starts = F.filter(F.sequence(F.lit(0), F.size("equal") - F.col("w")), lambda j: (F.col("from") + j >= 0) & (F.col("from") + j + F.col("w") <= F.col("n")))
    total = lambda j: F.aggregate(F.slice("equal", j + 1, F.col("w")), F.lit(0), lambda a, x: a + x)
    best = both.withColumn("matched", F.array_max(F.transform(starts, total))).where(F.col("matched") >= F.col("w") - allowed(F.col("w")))
    return best.groupBy(*key, "item_id").agg(F.max("matched").alias("matched"))


def keys_of(docs: DataFrame) -> list[Column]:
    """Two numbers that rows equal in doc_id and text share."""
    integer_id(docs, "doc_id")
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(docs["text"]).alias("_text")]


def judge(docs: DataFrame, items: DataFrame, s: Seeds | None = None) -> DataFrame:
    """``docs`` with contaminated, n_items, first_item (the least item id) and best_match (equal words)."""
    rows, own = packed(docs, *keys_of(docs), without=RESULT)
    found = matches(docs.select(*keys_of(docs), "text"), items.select("item_id", "text"), s or Seeds(), ["_id", "_text"])
    found = found.groupBy("_id", "_text").agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"), F.max("matched").alias("best_match"))
    out = rows.join(found, ["_id", "_text"], "left")
    return out.select(*unpacked(own), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "first_item", "best_match")


def clean(docs: DataFrame, items: DataFrame, s: Seeds | None = None) -> DataFrame:
    """The rows of ``docs`` that no item contaminates."""
    held, own = packed(docs, *keys_of(docs))
    found = matches(docs.select(*keys_of(docs), "text"), items.select("item_id", "text"), s or Seeds(), ["_id", "_text"])
    return held.join(found.select("_id", "_text").distinct(), ["_id", "_text"], "left_anti").select(*unpacked(own))


#: The same verdicts in DuckDB's SQL: every word pair of a document and an item is aligned, without seeds.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
dw AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS p FROM d),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM benchmark),
iw AS (SELECT item_id, len(ws) AS n, least(13, len(ws)) AS w0, unnest(ws) AS w, unnest(range(0, len(ws))) AS q FROM i WHERE len(ws) >= 5),
pairs AS (SELECT doc_id, item_id, n, w0, p - q AS diag, q FROM dw JOIN iw USING (w)),
runs AS (SELECT doc_id, item_id, n, w0, diag, list(q) AS qs FROM pairs GROUP BY ALL HAVING count(*) >= w0 - w0 * 2 // 13),
starts AS (SELECT doc_id, item_id, w0, qs, unnest(range(0, n - w0 + 1)) AS s FROM runs),
counted AS (SELECT doc_id, item_id, w0, len(list_filter(qs, lambda x: x >= s AND x < s + w0)) AS matched FROM starts),
best AS (SELECT doc_id, item_id, max(matched)::INT AS matched FROM counted WHERE matched >= w0 - w0 * 2 // 13 GROUP BY ALL),
found AS (SELECT doc_id, count(*) AS n_items, min(item_id) AS first_item, max(matched) AS best_match FROM best GROUP BY doc_id)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, first_item, best_match FROM documents LEFT JOIN found USING (doc_id)
"""
