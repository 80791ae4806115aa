"""Which sentences claim a cause: a vocabulary by class, and rules over the tokens of a sentence.

A sentence becomes a list of words and single punctuation marks. A rule names the class that a token must belong to and
what must stand beside it; since marks are tokens, words apart by a comma are no neighbours. Sentences that end with a
question mark ask, and those that deny, doubt or only test a cause claim nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabulary, by class.
VOCABULARY: dict[str, str] = {
    # a cause wherever the word stands
    "causes": "drive drives drove driven driving cause causes caused causing prolong prolongs prolonged",
    "brings": "contributes contributed contributing produces produced triggers triggered",
    # a cause if the word of the same line follows
    "leads": "lead leads led leading",
    "results": "result results resulted resulting",
    "owed": "due owing",
    # an effect, unless "the" follows: a comparison
    "multiplies": "double doubles doubled triple triples tripled",
    # an effect if an object follows, else only a change
    "changes": "increase increases increased reduce reduces reduced decrease decreases decreased boost boosts boosted "
    "raise raises raised lower lowers lowered improve improves improved worsen worsens worsened cut cuts lift lifts lifted",
    # what begins no object
    "prepositions": "by to from in on at over during after before across between with than for of and or but",
    # a force, if "up" or "down" follows two to four words later
    "forces": "push pushes pushed pushing drag drags dragged dragging pull pulls pulled pulling",
    # Arabic: leads (to), causes, contributes (in), and verbs of change with what begins no object
    "ar_leads": "أدى أدت يؤدي تؤدي أدّى أدّت",
    "ar_causes": "بسبب تسبب تسبّب يسبب يسبّب",
    "ar_shares": "ساهم ساهمت يساهم تساهم أسهم أسهمت",
    "ar_changes": "يقلل تقلل يقلّل تقلّل يزيد تزيد يزود تزود يرفع ترفع يخفض تخفض يخفّض تخفّض يحسن تحسن يحسّن تحسّن يسوي تسوي يخلي تخلي يخلّي تخلّي",
    "ar_prepositions": "في خلال بنسبة عن على إلى الى حتى",
    # denial, doubt and tests of a claim
    "negations": "not cannot can't",
    "asserts": "claim prove show establish",
    "does_not": "doesn't don't can't cannot",
    "tells": "tell show say prove",
    "questions": "which whether if what",
    "confirmed": "checked tested verified established proven confirmed",
    "checks": "check checked test tested know knew see established establish determine determined confirm confirmed",
    "open": "untested unproven hypothesis hypotheses hypothesize hypothesise hypothesized hypothesised hypothesizes hypothesises hypothesizing hypothesising",
}
# Arabic denials and doubts, found anywhere in a sentence.
AR_DENIALS = (
    "لا يمكن ادعاء", "لا يمكن إثبات", "ليس سبباً", "لم يثبت", "لم تثبت", "لم يُثبت", "لم تُثبت", "لم يتضح",
    "لا يثبت", "لا تثبت", "لا يدل على أن", "فرضية", "لم نختبر", "لم يختبر", "لم يُختبر", "لم نتحقق",
    "نحتاج لاختبار", "نحتاج إلى اختبار", "نحتاج الى اختبار", "قبل أن نستنتج",
)
SENTENCE = r"[^.!?؟\n]+[.!?؟]?"
TOKEN = r"(?U)(\w+(?:['’]\w+)*|[^\w\s])"


def words(of: str) -> list[str]:
    return VOCABULARY[of].split()


class Tokens:
    """A sentence's tokens as written and in lower case, with tests of the token at a place.

    Both have to be columns that cost nothing to read again: variables of a lambda, or columns of the table."""

    def __init__(self, said: Column, low: Column):
        self.said, self.low = said, low

    def at(self, i: Column) -> Column:
        return F.coalesce(F.get(self.low, i), F.lit(""))

    def is_(self, i: Column, *texts: str) -> Column:
        return self.at(i).isin(*texts)

    def of(self, i: Column, kind: str) -> Column:
        return self.at(i).isin(words(kind))

    def places(self, test: Callable[[Column], Column]) -> Column:
        return F.filter(F.sequence(F.lit(0), F.greatest(F.size(self.low), F.lit(1)) - 1), test)

    def any(self, test: Callable[[Column], Column]) -> Column:
        return F.size(self.places(test)) > 0

    def phrase(self, start: Column, n: Column) -> Column:
        return F.array_join(F.slice(self.said, start + 1, n), " ")

    def first(self, test: Callable[[Column], Column], n: int, back: int = 0) -> Column:
        """The ``n`` tokens from the first place that passes, and at most ``back`` before it; null without one."""
        found = F.get(self.places(test), F.lit(0))
        start = F.greatest(found - back, F.lit(0))
        return F.when(found.isNotNull(), self.phrase(start, found + n - start))

    def upto(self, test: Callable[[Column], Column], ends: Callable[[Column], Column], least: int, most: int) -> Column:
        """The tokens from the first place that passes to the last of the ``least`` to ``most`` after it that ``ends``."""
        reach = lambda i: F.filter(F.sequence(i + least, i + most), ends)
        found = F.get(self.places(lambda i: test(i) & (F.size(reach(i)) > 0)), F.lit(0))
        return F.when(found.isNotNull(), self.phrase(found, F.array_max(reach(found)) - found + 1))


def _ends(c: Column, kind: str) -> Column:
    """Arabic writes "and", "so" and prepositions as letters before a word."""
    return F.exists(F.array(*[F.lit(w) for w in words(kind)]), lambda w: c.endswith(w))


def _object(t: Tokens, i: Column) -> Column:
    """Whether an object begins at a place: a word that is no preposition (but "in-house" is one), adverb or number."""
    alone = t.of(i, "prepositions") & ~t.is_(i + 1, "-")
    return t.at(i).rlike(r"(?U)^\w") & ~alone & ~t.at(i).rlike(r"(?U)^\d|\wly$")


def _arabic_change(t: Tokens, i: Column) -> Column:
    bare = F.regexp_replace(t.at(i), "^[وف]?ب?", "")
    verb = t.of(i, "ar_changes") | bare.isin(words("ar_changes"))
    return verb & (i >= 1) & (t.at(i + 1) != "") & ~(t.of(i + 1, "ar_prepositions") & (t.at(i + 2) != ""))


def claim(t: Tokens) -> Column:
    """The phrase that claims a cause; null where none does. Rules by precedence."""
    next_is = lambda kind, *texts: lambda i: t.of(i, kind) & t.is_(i + 1, *texts)
    return F.coalesce(
        t.first(lambda i: t.of(i, "causes"), 1),
        t.first(next_is("leads", "to"), 2),
        t.first(next_is("results", "in"), 2),
        t.first(lambda i: (t.is_(i, "because") & t.is_(i + 1, "of")) | (t.of(i, "owed") & t.is_(i + 1, "to")), 2),
        t.first(lambda i: t.of(i, "multiplies") & ~t.is_(i + 1, "the"), 1),
        t.upto(lambda i: _ends(t.at(i), "ar_leads"), lambda j: t.at(j).startswith("إلى") | t.at(j).startswith("الى"), 1, 8),
        t.first(lambda i: F.exists(F.array(*[F.lit(w) for w in words("ar_causes")]), lambda w: t.at(i).contains(w)), 1),
        t.first(lambda i: t.of(i, "brings"), 1),
        t.first(lambda i: t.is_(i, "is", "are") & t.is_(i + 1, "responsible") & t.is_(i + 2, "for"), 3),
        t.upto(lambda i: _ends(t.at(i), "ar_shares"), lambda j: t.at(j).startswith("في"), 1, 5),
        t.first(lambda i: (t.at(i).endswith("ينتج") | t.at(i).endswith("نتج")) & t.at(i + 1).startswith("عن"), 2),
        t.first(lambda i: t.at(i).endswith("نتيجة") & t.at(i + 1).startswith("ل"), 2),
        t.first(lambda i: t.of(i, "changes") & _object(t, i + 1), 2),
        t.upto(lambda i: t.of(i, "forces"), lambda j: t.is_(j, "up", "down"), 2, 4),
        t.first(lambda i: _arabic_change(t, i), 2, back=7),
    )


def is_about_causes(t: Tokens, sentence: Column) -> Column:
    """Whether a sentence denies, doubts or tests a cause instead of claiming it."""

    def denied(i: Column) -> Column:
        no = t.of(i, "negations") | (t.is_(i, "not") & t.is_(i - 1, "can")) | (t.is_(i, "finding") & t.is_(i - 1, "no"))
        return no & (t.of(i + 1, "asserts") | (t.is_(i + 1, "be") & t.is_(i + 2, "stated") & t.is_(i + 3, "as")))

    def untold(i: Column) -> Column:
        no = t.of(i, "does_not") | (t.is_(i, "not") & t.is_(i - 1, "does", "do"))
        asked = t.of(i + 2, "questions") | (t.is_(i + 2, "us") & t.of(i + 3, "questions"))
        return no & t.of(i + 1, "tells") & asked

    def excluded(i: Column) -> Column:
        after = i + F.when(t.is_(i + 1, "yet"), 2).otherwise(1)
        cause = t.is_(i + 1, "what", "a") & t.at(i + 2).startswith("caus")
        return t.is_(i, "not") & (cause | t.is_(i + 1, "proof") | t.of(after, "confirmed"))

    def apart(i: Column) -> Column:
        return t.is_(i, "association") & (t.is_(i + 1, "not") | (t.is_(i + 1, ",") & t.is_(i + 2, "not")))

    english = t.any(lambda i: t.of(i, "open") | denied(i) | untold(i) | excluded(i) | apart(i) | (t.of(i, "checks") & t.is_(i + 1, "whether")))
    spaced = F.regexp_replace(sentence, r"(?U)\s+", " ")
    return english | F.exists(F.array(*[F.lit(x) for x in AR_DENIALS]), lambda x: spaced.contains(x))


def causal_claims(c: Column) -> Column:
    """(phrase, sentence) of each sentence that claims a cause."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({SENTENCE})"), 1)
    told = F.filter(F.transform(found, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: (s != "") & ~s.rlike(r"[?؟]$"))

    def judged(s: Column) -> Column:
        said = F.regexp_extract_all(s, F.lit(TOKEN), 1)
        phrase = _once(said, lambda x: _once(F.transform(x, _lower), lambda low: _judged(Tokens(x, low), s)))
        # Most sentences hold no word that any rule begins with.
        return F.struct(F.when(F.lower(s).rlike(_BEGINS), phrase).alias("phrase"), s.alias("sentence"))

    return F.filter(F.transform(told, judged), lambda x: x["phrase"].isNotNull())


#: What a sentence with a claim holds somewhere: a word that an English rule begins with, or an Arabic letter.
_BEGINS = r"[ء-ي]|(?U)\b(?:" + "|".join([*[w for k in ("causes", "brings", "leads", "results", "owed", "multiplies", "changes", "forces") for w in words(k)], "because", "responsible"]) + r")\b"


def _lower(token: Column) -> Column:
    return F.replace(F.lower(token), F.lit("’"), F.lit("'"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, as the variable of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _judged(t: Tokens, sentence: Column) -> Column:
    return F.when(~is_about_causes(t, sentence), claim(t))


def causal_sentences(c: Column) -> Column:
    return F.transform(causal_claims(c), lambda x: x["sentence"])


def sql_count(text: str) -> str:
    """DuckDB SQL for the number of claims in an English ``text``: the same vocabulary, the rules as list conditions."""
    quoted = lambda kind: ", ".join("'" + w.replace("'", "''") + "'" for w in words(kind))
    of = lambda k, kind: f"coalesce(t[i{k}] IN ({quoted(kind)}), false)"
    is_ = lambda k, *texts: "coalesce(t[i{}] IN ({}), false)".format(k, ", ".join(f"'{x}'" for x in texts))
    an_object = (
        f"(coalesce(regexp_matches(t[i+1], '^\\w'), false) AND NOT ({of('+1', 'prepositions')} AND NOT {is_('+2', '-')}) AND NOT regexp_matches(t[i+1], '^\\d|\\wly$'))"
    )
    claims = [
        of("", "causes"), of("", "brings"), f"{of('', 'leads')} AND {is_('+1', 'to')}", f"{of('', 'results')} AND {is_('+1', 'in')}",
        f"{is_('', 'because')} AND {is_('+1', 'of')}", f"{of('', 'owed')} AND {is_('+1', 'to')}", f"{of('', 'multiplies')} AND NOT {is_('+1', 'the')}",
        f"{is_('', 'is', 'are')} AND {is_('+1', 'responsible')} AND {is_('+2', 'for')}", f"{of('', 'changes')} AND {an_object}",
        f"{of('', 'forces')} AND ({is_('+2', 'up', 'down')} OR {is_('+3', 'up', 'down')} OR {is_('+4', 'up', 'down')})",
    ]
    asserts = f"({of('+1', 'asserts')} OR ({is_('+1', 'be')} AND {is_('+2', 'stated')} AND {is_('+3', 'as')}))"
    denials = [
        of("", "open"), f"({of('', 'negations')} OR ({is_('', 'finding')} AND {is_('-1', 'no')})) AND {asserts}",
        f"({of('', 'does_not')} OR ({is_('', 'not')} AND {is_('-1', 'does', 'do')})) AND {of('+1', 'tells')} AND ({of('+2', 'questions')} OR ({is_('+2', 'us')} AND {of('+3', 'questions')}))",
        f"{is_('', 'not')} AND ({is_('+1', 'proof')} OR ({is_('+1', 'what', 'a')} AND coalesce(t[i+2] LIKE 'caus%', false)) OR {of('+1', 'confirmed')} OR ({is_('+1', 'yet')} AND {of('+2', 'confirmed')}))",
        f"{is_('', 'association')} AND ({is_('+1', 'not')} OR ({is_('+1', ',')} AND {is_('+2', 'not')}))", f"{of('', 'checks')} AND {is_('+1', 'whether')}",
    ]
    hits = lambda tests: "len([i FOR i IN range(1, len(t) + 1) IF " + " OR ".join(f"({x})" for x in tests) + "])"
    tokens = "[replace(lower(w), '’', '''') FOR w IN regexp_extract_all(s, '[\\pL\\pM\\pN_]+(?:[''’][\\pL\\pM\\pN_]+)*|[^\\pL\\pM\\pN_\\s]')]"
    sentences = f"unnest(regexp_extract_all({text}, '[^.!?؟\\n]+[.!?؟]?'))"
    return f"SELECT count(*) FROM (SELECT {tokens} AS t FROM (SELECT {sentences} AS s) WHERE NOT regexp_matches(s, '[?؟]\\s*$')) WHERE {hits(claims)} > 0 AND {hits(denials)} = 0"
