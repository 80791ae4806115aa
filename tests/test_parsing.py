import pytest
from pyspark.sql import functions as F

from plumbline.functions import dates, numbers, text


def one(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", make(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_mapped_numbers(spark):
    good = {"$1,200": 1200, "€ 3.5": 3.5, "SAR 5,000": 5000, "(300)": -300, "-$5": -5, "12%": 12, "1 200": 1200, "1e3": 1000, "١٢٠٠": 1200, "١٬٢٠٠٫٥": 1200.5, "۱۲۳": 123, "−7": -7}
    assert one(spark, list(good), numbers.mapped_number) == [float(x) for x in good.values()]
    bad = ["12,5", "1.234,56", "1,20,000", "1,2", "abc", "", "nan", "inf", None, "12d"]
    assert one(spark, bad, numbers.mapped_number) == [None] * len(bad)


def test_plain_numbers(spark):
    assert one(spark, ["1,2", " 7 ", "nan", "inf", "x", "1_000"], numbers.plain_number) == [12.0, 7.0, None, None, None, None]


def test_keys(spark):
    assert one(spark, ["3", "3.0", "003", " 3.0 ", "٣", "2.50", "n/a"], lambda c: numbers.key_text(c, True)) == ["3"] * 5 + ["2.5", None]
    assert one(spark, [" a ", "A", "  "], lambda c: numbers.key_text(c, False)) == ["a", "A", None]


@pytest.mark.parametrize(
    ("grain", "cases"),
    [
        ("day", {"2025/3/4": "2025-03-04", "2025-03-14T10:00:00Z": "2025-03-14", "13/04/2025": "2025-04-13", "1/2/99": "1999-02-01", "1/2/05": "2005-02-01", "15-Jan-2025": "2025-01-15", "January 15, 2025": "2025-01-15", "١٥ مارس ٢٠٢٥": "2025-03-15", "31/02/2025": None, "12345": None, "2025-01": None}),
        ("month", {"3/2025": "2025-03", "Jan 2025": "2025-01", "Jan-25": "2025-01", "sept 2024": "2024-09", "يناير 2025": "2025-01", "كانون الثاني 2025": "2025-01", "May June 2025": None}),
        ("quarter", {"2025-Q1": "2025-Q1", "Q3 2024": "2024-Q3", "2024q4": "2024-Q4", "2024-05-01": "2024-Q2"}),
        ("year", {"1999": "1999", "1700": None, "2024-Q1": "2024"}),
    ],
)
def test_dates(spark, grain, cases):
    assert one(spark, list(cases), lambda c: dates.label(dates.parse_date(c), grain)) == list(cases.values())


def test_order(spark):
    def order(*v):
        return dates.resolve_order(spark.createDataFrame([(x,) for x in v], "d string"), "d")

    assert order("13/04/2025", "01/02/2025") == ("day-first", False)
    assert order("04/13/2025") == ("month-first", False)
    assert order("03/04/2025") == ("day-first", True)
    assert order("03/03/2025") == ("day-first", False)


def test_next_labels():
    assert dates.next_labels("2024-12", 2) == ["2025-01", "2025-02"]
    assert dates.next_labels("2024-12-31", 1) == ["2025-01-01"]
    assert dates.next_labels("2024-Q4", 1) == ["2025-Q1"]
    assert dates.next_labels("2024", 1) == ["2025"]
    assert dates.next_labels("week 3", 2) == ["next period +1", "next period +2"]


def test_grain(spark):
    days = spark.range(40).select(F.date_format(F.date_add(F.lit("2025-01-01"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    assert dates.choose_grain(days, dates.parse_date(F.col("d"))) == "month"


def test_figures_and_raw_rows(spark):
    assert one(spark, ["2 of 1,200 sold at 3.5, up 14% and -14%"], text.figures) == [["1200", "14%", "14%", "3.5"]]
    rows = "\n".join(f"{i},{i},x" for i in range(8))
    pairs = "\n".join(f"id: {i}, n: {i}" for i in range(8))
    objects = "see [" + ", ".join('{"a": 1}' for _ in range(8)) + "] here"
    assert one(spark, [rows, "a, b and c\n1, 2", pairs, "x", objects, objects.replace(", {", ", 1, {", 1)[:40]], text.raw_rows) == [True, False, True, False, True, False]


def test_jargon(spark):
    said = ["The p-value is low", "A special decision", "the 95% CI", "An ANOVA, and p = 0.04", "the Foo-Bar test", "اختبار فو-بار", "Sales rose", None]
    assert one(spark, said, text.jargon) == [["p-value"], [], ["CI"], ["anova", "p = 0.0"], ["Foo-Bar test"], ["اختبار فو-بار"], [], []]
    assert one(spark, said, text.has_jargon) == [True, False, True, True, True, True, False, False]
    assert [text.plain_jargon(x or "") for x in said] == one(spark, said, text.jargon)


@pytest.mark.parametrize(
    ("sentence", "phrase"),
    [
        ("Rain drives demand.", "drives"),
        ("Late parts led to idle lines.", "led to"),
        ("Idle time is due to late parts.", "due to"),
        ("Two shifts doubled output.", "doubled"),
        ("Output doubled the year before.", None),
        ("Training reduced errors.", "reduced errors"),
        ("Errors reduced by 4%.", None),
        ("Errors increased sharply.", None),
        ("Prices increased 15%.", None),
        ("Follow-up visits raise in-house costs.", "raise in"),
        ("Delays are pulling total output down.", "pulling total output down"),
        ("A backlog is responsible for delays.", "is responsible for"),
        ("What drives demand?", None),
        ("This cannot prove that rain drives demand.", None),
        ("We do not know whether rain drives demand.", None),
        ("أدى نقص القطع إلى توقف الخط.", "أدى نقص القطع إلى"),
        ("ساهم التدريب كثيرا في الجودة.", "ساهم التدريب كثيرا في"),
        ("التدريب يقلل الأخطاء.", "التدريب يقلل الأخطاء"),
        ("وأدت الأعطال إلى تأخير.", "وأدت الأعطال إلى"),
        ("التأخير نتيجة لنقص القطع.", "نتيجة لنقص"),
        ("Rain, driving demand.", "driving"),
        ("Sales increased, orders fell.", None),
        ("It's not yet proven that rain causes floods.", None),
        ("We checked whether rain causes floods.", None),
        ("An association, not what causes it.", None),
        ("Our hypothesis is that rain causes floods.", None),
        ("It cannot be stated as a cause that prolongs stops.", None),
        ("That is not a caused delay.", None),
        ("Lead times lead nowhere.", None),
        ("The result was good in May.", None),
        ("Prices push margins steadily further up.", "push margins steadily further up"),
        ("يزيد العدد.", None),
        ("لم نتحقق مما يسبب التأخير.", None),
    ],
)
def test_causal_claims(spark, sentence, phrase):
    got = one(spark, [f"Nothing here.  {sentence}\nNor here"], text.causal_claims)[0]
    assert [r["phrase"] for r in got] == ([phrase] if phrase else [])
    assert all(r["sentence"] == sentence for r in got)


def test_unsourced_figures():
    reg = {"sales": 1234567.0, "share": 0.451}
    assert text.unsourced("Sales of $1.2 million, 45% of all, in 2024 and 7 shops.", reg) == []
    assert text.unsourced("Sales of 9,999.", reg) == ["9,999"]
    assert text.unsourced("40 × 50 = 2,000", {"a": 40, "b": 50}) == []
    assert "40 × 50 = 2,100" in text.unsourced("40 × 50 = 2,100", {"a": 40, "b": 50})
