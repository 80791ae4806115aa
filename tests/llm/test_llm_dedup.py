"""Decontamination, suffix-array and line dedup, near-duplicates and the pipeline: defined cases and brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import components, decontaminate, langid, line_dedup, neardup, suffix_dedup

SCHEMA = "doc_id long, text string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


def words_of(n, seed):
    r = random.Random(seed)
    return [f"{r.choice('bcdfgklmnprst')}{r.choice('aeiou')}{r.randrange(4000)}" for _ in range(n)]


# ---- 3


def best_match(text, item):
    a, b = (re.findall(r"[^\W_]+", (x or "").lower()) for x in (text, item))
    if len(b) < 5:
        return None
    w = min(13, len(b))
    a = [None] * w + a + [None] * w  # places beyond the document's ends count as replaced
    best = max((sum(x == y for x, y in zip(a[i : i + w], b[j : j + w], strict=True)) for i in range(len(a) - w + 1) for j in range(len(b) - w + 1)), default=0)
    return best if best >= w - 2 * w // 13 else None


def test_every_placement_of_two_replaced_words(spark):
    item = words_of(13, 1)
    docs = []
    for i, gone in enumerate(itertools.combinations(range(13), 2)):
        docs.append((i, " ".join(["lead in", *("zz" if k in gone else w for k, w in enumerate(item)), "and out"])))
    docs.append((500, " ".join("zz" if k in (2, 6, 10) else w for k, w in enumerate(item))))
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.judge(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got.pop(500) is False and len(got) == 78 and all(got.values())


@pytest.mark.parametrize("rows", [200_000, 0])
def test_decontamination_brute(spark, rows):
    items = [(i, " ".join(words_of(n, i))) for i, n in enumerate((4, 5, 6, 7, 12, 13, 14, 25, 40))] + [(50, None), (51, ""), (7, " ".join(words_of(25, 7)))]
    r = random.Random(3)
    docs = [(None, items[5][1]), (900, None), (901, ""), (902, "x"), (903, LONG + " " + items[8][1]), (904, items[5][1]), (904, items[5][1])]
    for d in range(120):
        text = words_of(r.randrange(0, 60), 1000 + d)
        src = items[r.randrange(9)][1].split()
        cut = src[r.randrange(0, 6) :][: r.randrange(4, 40)]
        for k in range(r.randrange(0, 4)):
            if cut:
                cut[r.randrange(len(cut))] = f"changed{k}"
        docs.append((d, " ".join(text + cut + words_of(5, d)).upper() if d % 2 else ", ".join(cut)))
    made = decontaminate.judge(spark.createDataFrame(docs, SCHEMA).withColumn("n_items", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string"), decontaminate.Seeds(broadcast_rows=rows))
    got = Counter((x["doc_id"], x["contaminated"], x["n_items"], x["first_item"], x["best_match"]) for x in made.collect())
    want = Counter()
    for i, t in docs:
        if i == 903:
            found = {8: 13}
        else:
            found = {k: m for k, x in items if (m := best_match(t, x))}
        want[i, bool(found), len(found), min(found, default=None), max(found.values(), default=None)] += 1
    assert got == want


def test_decontamination_empty(spark):
    docs = spark.createDataFrame([(1, "some words")], SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in decontaminate.judge(docs, none).collect()] == [False]
    assert decontaminate.clean(docs.limit(0), none).count() == 0


# ---- 5


def brute_suffix(docs, length):
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = Counter()
    for i, b in data:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("shape", [suffix_dedup.Shape(20, 8, 24 << 20, 60_000), suffix_dedup.Shape(20, 8, 2000, 40), suffix_dedup.Shape(9, 9, 500, 7), suffix_dedup.Shape(), suffix_dedup.Shape(20, 8, hot=2), suffix_dedup.Shape(20, 8, hot=12), suffix_dedup.Shape(20, 8, stretch=13), suffix_dedup.Shape(stretch=300)])
def test_suffix_dedup_brute(spark, shape):
    r = random.Random(shape.length + shape.range_rows)
    common = ["".join(r.choice("abü ") for _ in range(n)) for n in (10, 25, 60, 260)]
    docs = [(None, None), (1, ""), (2, "a" * 700), (3, common[3]), (3, common[3]), (4, "ab" * 300), (5, "ñ" * 9), (6, common[3][40:] + "é"), (7, common[3][:230])]
    for i in range(10, 60):
        docs.append((i, "".join(r.choice([r.choice(common), r.choice(common)[3:-2], "".join(r.choice("abc") for _ in range(r.randrange(30)))]) for _ in range(r.randrange(8)))))
    got = suffix_dedup.dedup(spark.createDataFrame(docs, SCHEMA).withColumn("spans", F.lit(1)).repartition(3), shape)
    found = Counter((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got.collect())
    assert found == brute_suffix(docs, shape.length)


def test_suffix_dedup_long_and_empty(spark):
    alone = "".join(random.Random(5).choice("abcdefghij ") for _ in range(400_000))
    passage = alone[1000:1300]
    got = {x["doc_id"]: x["spans"] for x in suffix_dedup.dedup(spark.createDataFrame([(1, alone), (2, "start " + passage + " end")], SCHEMA)).collect()}
    assert got == {1: [[1000, 1300]], 2: [[6, 306]]} or (got[1][0][0] <= 1000 and got[1][0][1] >= 1300)
    assert suffix_dedup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_loser_tree():
    r = random.Random(1)
    strings = sorted(bytes(r.choice(b"ab") for _ in range(r.randrange(12))) for _ in range(200))
    for k in (1, 2, 3, 7, 8):
        runs = [[(s, b"", 0, 0, 0, 0, 0) for s in strings[i::k]] for i in range(k)]
        packed = [suffix_dedup.open_run([suffix_dedup.pack_run(x, suffix_dedup.Shape(20, 8))]) for x in runs]
        merged = list(suffix_dedup.merge(packed))
        assert [e[0] for _, e in merged] == strings
        assert [n for n, _ in merged][1:] == [suffix_dedup.common(a, b) for a, b in itertools.pairwise(strings)]


# ---- 6


def brute_lines(docs, n):
    """Whole windows compared; rows equal in doc_id and text are one document."""
    seen, out = {}, Counter()
    order = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0))
    gone = {}
    for d in order:
        lines = [x.strip(" \t\n\x0b\x0c\r") for x in (d[1] or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        marks = set()
        for k in range(len(lines) - n + 1):
            if tuple(lines[k : k + n]) in seen:
                marks |= set(range(k, k + n))
            seen.setdefault(tuple(lines[k : k + n]), d)
        gone[d] = (len(lines), len(marks), sum(m - 1 not in marks for m in marks))
    for d in docs:
        out[(d[0], *gone[d])] += 1
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_line_dedup_brute(spark, n):
    r = random.Random(n)
    docs = [(None, "a\nb\nc\nd\ne"), (1, None), (2, ""), (3, "\n \n\t\n"), (4, "a\n" * 12), (5, " a\nb \n\n c\nd\ne\nf"), (5, " a\nb \n\n c\nd\ne\nf"), (6, "\n".join(f"line {i}" for i in range(20_000)))]
    docs += [(i, "\n".join(r.choice("abcd") for _ in range(r.randrange(14)))) for i in range(10, 40)]
    got = line_dedup.dedup(spark.createDataFrame(docs, SCHEMA).withColumn("kept_text", F.lit(1)).repartition(3), n)
    assert Counter((x["doc_id"], x["n_lines"], x["n_removed"], x["n_runs"]) for x in got.collect()) == brute_lines(docs, n)
    assert line_dedup.dedup(spark.createDataFrame([], SCHEMA), n).count() == 0


@pytest.mark.parametrize(("n", "words"), [(3, 50), (1, 50), (4, 6)])
def test_passage_dedup_brute(spark, n, words):
    """Later copies of planted passages of one and two lines go; runs are judged by whole windows of 1 to n lines."""
    r = random.Random(n)
    one, two = " ".join(words_of(60, 1)), " ".join(words_of(30, 2)) + "\n" + " ".join(words_of(25, 3))
    few = " ".join(words_of(49, 4))
    docs = [(None, one), (1, None), (2, few), (3, few), (4, one), (5, two), (6, f"{one}\n{one}"), (7, " \n" + two + "\nend")]
    docs += [(i, "\n".join(r.choice(["a b c", "d", "e f", one, two, few, f"own {i}"]) for _ in range(r.randrange(9)))) for i in range(10, 50)]
    docs.append(docs[-1])
    got = line_dedup.dedup(spark.createDataFrame(docs, SCHEMA).repartition(3), n, words)
    seen, gone = set(), {}
    for d in sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0)):
        lines, marks = [x.strip() for x in (d[1] or "").split("\n") if x.strip()], set()
        for k, m in itertools.product(range(len(lines)), range(1, n + 1)):
            window = tuple(lines[k : k + m])
            if len(window) == m and (m == n or len(" ".join(window).split()) >= words):
                marks |= set(range(k, k + m)) if window in seen else set()
                seen.add(window)
        gone[d] = (len(lines), len(marks), "\n".join(x for i, x in enumerate(lines) if i not in marks))
    plain = lambda t: "\n".join(x.strip() for x in t.split("\n") if x.strip())
    assert Counter((x["doc_id"], x["n_lines"], x["n_removed"], plain(x["kept_text"])) for x in got.collect()) == Counter((d[0], *gone[d]) for d in docs)


def test_ranks_are_in_order(spark):
    """Each round's ranks sort its suffixes as their lines do, and equal ranks are equal lines: intervals of the array."""
    r = random.Random(7)
    docs = spark.createDataFrame([(i, "\n".join(r.choice("ab") for _ in range(r.randrange(1, 20)))) for i in range(30)], SCHEMA)
    keyed = docs.select(*line_dedup.keys_of(docs), "text")
    rows = line_dedup.sequence_of(keyed, False)
    code = {x["a"]: x["a"] for x in rows.collect()}
    lines = {}
    for x in sorted(rows.collect(), key=lambda x: x["at"]):
        lines.setdefault((x["_id"], x["_text"]), []).append((code[x["a"]], x["b"]))
    now, depth = line_dedup.ranked(rows, line_dedup.classes_of(rows, ["a", "b"]), ["a", "b"]), 1
    while depth < 8:
        held = [(x["rank"], lines[x["_id"], x["_text"]][x["at"] : x["at"] + depth]) for x in now.collect()]
        assert all(len(y) == depth for _, y in held)
        order = sorted(held)
        assert [y for _, y in order] == sorted(y for _, y in held)
        assert len({k for k, _ in held}) == len({tuple(y) for _, y in held})
        ahead = now.select("_id", "_text", (F.col("at") - depth).alias("at"), F.col("rank").alias("other"))
        pairs = now.drop("later").join(ahead, ["_id", "_text", "at"])
        now, depth = line_dedup.ranked(pairs, line_dedup.classes_of(pairs, ["rank", "other"]), ["rank", "other"]), 2 * depth


def test_long_repeated_run(spark):
    """Two copies of a run of 3,000 lines, and one line 2,000 times: few rounds, one maximal run each."""
    run = "\n".join(f"line {i}" for i in range(3000))
    docs = spark.createDataFrame([(1, "x\n" + run + "\ny"), (2, "z\n" + run), (3, "again\n" * 2000)], SCHEMA)
    got = {r["doc_id"]: (r["n_removed"], r["n_runs"], r["kept_text"].strip()) for r in line_dedup.dedup(docs).collect()}
    assert got[1][:2] == (0, 0) and got[2] == (3000, 1, "z") and got[3] == (1999, 1, "again")


# ---- 10


def shingle_set(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(docs, k):
    """doc_id -> least doc_id reachable, over all pairs."""
    sets = [(i, shingle_set(t, k)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize("k", [4, 5])
def test_near_dup_brute(spark, k):
    r = random.Random(k)
    docs = []
    for family in range(12):
        base = words_of(r.randrange(3, 160), family)
        for _ in range(r.randrange(1, 14)):
            docs.append((len(docs), " ".join(base)))
            base = list(base)
            for _ in range(r.randrange(0, 3)):  # a chain: each is near the one before
                base[r.randrange(len(base))] = f"v{r.randrange(10**6)}"
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, LONG), (1004, LONG + " tail"), (1005, "one two"), (1006, "ONE two"), (1007, "two one")]
    r.shuffle(docs)
    made = neardup.link(spark.createDataFrame(docs, SCHEMA).withColumn("kept", F.lit("clash")).repartition(3), neardup.Settings(words=k)).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in made} == brute_components(docs, k)
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in made) and len(made) == len(docs)


def test_near_dup_odd(spark):
    text = " ".join(words_of(60, 9))
    docs = spark.createDataFrame([(None, text), (5, text), (5, text), (9, text.upper()), (None, None)], SCHEMA)
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.link(docs).collect())
    assert got == Counter({(None, 5, False): 1, (5, 5, True): 2, (9, 5, False): 1, (None, None, True): 1})
    assert neardup.link(docs.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 180), r.randrange(100, 180)) for _ in range(60)] + [(200, 201 + i) for i in range(50)] + [(7, 7), (3, None)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {x["node"]: x["label"] for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: root(i) for i in parent}


# ---- the pipeline


def test_pipeline_stages_brute(spark):
    """Each stage against a plain version of it, on what the stage before kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}

    judge = langid.LanguageModel.fit(docs.where(~langid.held_out(F.col("doc_id")))).judge()
    docs = corpus_pipeline.language_id(spark, docs, sf)
    want = {i for i, r in rows.items() if judge(r["text"])[3]}
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == want

    docs = corpus_pipeline.near_dedup(spark, docs, sf)
    kept = {i for i, (_, c) in brute_components([(i, rows[i]["text"]) for i in sorted(want)], 5).items() if c == i}
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == kept

    docs = corpus_pipeline.decontamination(spark, docs, sf)
    items = [re.findall(r"[^\W_]+", r["text"].lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r["text"]]
    held = {r["doc_id"] for r in docs.collect()}
    assert docs.columns == columns and held <= kept
    exact = lambda t: any(" ".join(x[:13]) in " ".join(re.findall(r"[^\W_]+", t.lower())) for x in items if len(x) >= 13)
    assert not any(exact(rows[i]["text"]) for i in held)
    for i in sorted(kept - held)[:8]:
        assert any(best_match(rows[i]["text"], " ".join(x)) for x in items)

    docs = corpus_pipeline.mix_sources(spark, docs, sf)
    copies = Counter(r["doc_id"] for r in docs.collect())
    assert docs.columns == columns and set(copies) <= held and max(copies.values()) <= 3

    docs = corpus_pipeline.shards(spark, docs, sf)
    assert Counter(r["doc_id"] for r in docs.collect()) == copies and {"shard", "shard_bytes"} <= set(docs.columns)
    assert not docs.where("shard_bytes > n_bytes and oversized").count()
