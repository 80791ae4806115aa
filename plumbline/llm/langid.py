"""Language identification by compression.

Each language gets a raw-content zstandard dictionary made of sample texts. A text is cut into blocks, each
block is compressed with every dictionary, and the language with the fewest bytes in all wins. Where the
runner-up needs hardly more bytes the verdict is not ``accepted``.

Defined cases: a null text, an empty text and a text without a letter get ``und`` with score 0 and are not
accepted. Whole texts are judged, very long ones block by block. A tie goes to the language first in code-point order. Rows with null text or label teach nothing.
Repeated rows get the same verdict each. Without any label every text is ``und``; an empty table gives an empty one. Other columns pass through;
result columns replace input columns of the same name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, unpacked

UNDETERMINED = "und"
#: A letter by Unicode's category; signs that stand for numbers are none.
_LETTER = regex.compile(r"\p{L}")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_RESULT = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("margin", T.DoubleType()),
        T.StructField("accepted", T.BooleanType()),
    ]
)


def letters_of(text: str) -> bytes:
    """Lower-case letters with single spaces: what is compressed, so that case and signs carry no weight."""
    return _NOT_LETTERS.sub(" ", text.lower()).encode()


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language; at most ``texts_per_lang * chars_per_text`` characters each, whatever the corpus."""

    dictionaries: dict[str, bytes]
    block: int = 2048
    level: int = 12
    min_margin: float = 0.005
    sharpness: float = 30.0

    @classmethod
    def fit(cls, labelled: DataFrame, text: str = "text", label: str = "lang", texts_per_lang: int = 32, chars_per_text: int = 3000, most_langs: int = 1000, **settings) -> LanguageModel:
        """Learn from a bounded sample: the ``texts_per_lang`` distinct texts of lowest hash of each label, those of 200
        characters and more first. Of a text longer than ``chars_per_text`` a stretch of that many characters is taken that
        begins anywhere in it, as the text's hash decides. More than ``most_langs`` labels are refused before anything is
        dealt by them: each has a dictionary in every worker."""
        if labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(label).distinct().limit(most_langs + 1).count() > most_langs:
            raise ValueError(f"more than {most_langs} labels: map them to languages first")
        n = F.length(text)
        begin = F.when(n > chars_per_text, F.pmod(F.xxhash64(text), n - chars_per_text + 1)).otherwise(0).cast("int") + 1
        rows = labelled.where(F.col(text).isNotNull() & (F.length(F.trim(text)) > 0) & F.col(label).isNotNull()).select(
            F.col(label).alias("label"), F.substring(F.col(text), begin, F.lit(chars_per_text)).alias("sample"), (n < 200).cast("int").alias("worse")
        ).withColumn("h", F.xxhash64("sample"))
        # Copies are one text and take one place; places are dealt by hashes alone, so that few texts are shuffled.
        first = Window.partitionBy("label").orderBy("worse", "h")
        hashes = rows.groupBy("label", "h").agg(F.min("worse").alias("worse"))
        places = hashes.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= texts_per_lang).drop("worse")
        kept = rows.drop("worse").join(F.broadcast(places), ["label", "h"]).groupBy("label", "nth").agg(F.min("sample").alias("sample"))
        samples: dict[str, list[str]] = {}
        for row in kept.select("label", "sample", "nth").orderBy("label", "nth").collect():  # most_langs x texts_per_lang rows at most
            samples.setdefault(row["label"], []).append(row["sample"])
        return cls({k: b"\n".join(dict.fromkeys(map(letters_of, v))) for k, v in sorted(samples.items())}, **settings)

    def predict(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``df`` with lang_pred, score (0 to 1), margin (0 to 1) and accepted."""
        model, column = self, df[f"`{text}`"]

        @F.arrow_udf(_RESULT)
        def verdicts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            judge = model.judge()
            for batch in batches:
                rows = [judge(x.as_py()) for x in batch]
                yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))], names=_RESULT.names)

        rows, own = packed(df, verdicts(column).alias("verdict"), without=_RESULT.names)
        return rows.select(*unpacked(own), "verdict.*")

    def judge(self):
        """A function from a text to (language, score, margin, accepted)."""
        langs = sorted(self.dictionaries)
        coders = []
        for lang in langs:
            made = zstandard.ZstdCompressionDict(self.dictionaries[lang] or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=self.level)
            coders.append(zstandard.ZstdCompressor(level=self.level, dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False))

        def verdict(text: str | None) -> tuple[str, float, float, bool]:
            if not coders or not text or not _LETTER.search(text):
                return UNDETERMINED, 0.0, 0.0, False
            data = memoryview(letters_of(text))
            blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
            sizes = [sum(len(coder.compress(b)) for b in blocks) for coder in coders]
            best = min(range(len(langs)), key=sizes.__getitem__)
            weights = [math.exp(-self.sharpness * (s - sizes[best]) / len(data)) for s in sizes]
            second = min((s for i, s in enumerate(sizes) if i != best), default=None)
            margin = 1.0 if second is None else (second - sizes[best]) / second
            return langs[best], 1.0 / sum(weights), margin, margin >= self.min_margin

        return verdict


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo ``folds``, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """Fit on the rows of ``docs`` that are not held out, unless a model is given, and judge every row."""
    return (model or taught(docs)).predict(docs)


def accepted(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is told with a sufficient margin, with their own columns alone."""
    judged = (model or taught(docs)).predict(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")))
    return judged.where("accepted").select("row.*")


def taught(docs: DataFrame) -> LanguageModel:
    return LanguageModel.fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
