"""Language identification by compression.

Each language has a zstandard dictionary of raw content: text of labelled documents. A text is
reduced to its lower-cased letters, each run of other characters a blank, and
cut into chunks of ``CHUNK`` bytes that cover it whole; the language whose dictionary makes their
total compressed size smallest is chosen. The margin, how much smaller that total is than the
second best as a share of it, is the score; a margin below ``min_margin`` marks the choice as
rejected. Texts of up to ``SHORT`` bytes are compressed at a higher level, which finds shorter matches.

The dictionaries hold a bounded sample: at most ``DICTIONARY_BYTES`` a language, ``SAMPLE_CHARS``
characters from a place in each of about ``2 * SAMPLE_DOCS`` documents; a hash of the id picks both.

Defined results: null text, and text without a letter, is ``und`` with score 0; so is every text
if there is nothing to learn from. With one language its name is given with score 1. Equal sizes
go to the commoner language of the sample's source. Repeated rows are judged alike.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabsight.llm.common import ship

UNKNOWN = "und"
DICTIONARY_BYTES, SAMPLE_CHARS, SAMPLE_DOCS, MIN_MARGIN = 64_000, 2_000, 64, 0.01
MOST_PARTS = 8 * SAMPLE_DOCS
CHUNK, LEVEL, SHORT, SHORT_LEVEL = 4_096, 6, 400, 19
# Goes before every chunk: without it a short block that gains little is stored as it is, whatever the dictionary.
_FILLER = bytes(64)
_LETTER = regex.compile(r"\p{L}")
_OTHER = re.compile(r"[\W\d_]+")


def normal(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).encode()


def learn(rows: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Language -> dictionary content, the commonest language first, from labelled rows (those with
    a null id, text or language are left out). About ``2 * SAMPLE_DOCS`` documents a language reach the driver, ``MOST_PARTS``
    at most, however many texts an id has."""
    known = rows.select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        "id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    counts = known.groupBy("lang").count().collect()
    share = 1 << 40
    chosen = F.lit(False)
    for r in counts:
        least = min(share, 2 * SAMPLE_DOCS * share // r["count"] + 1)
        chosen = chosen | ((F.col("lang") == r["lang"]) & (F.pmod(F.xxhash64("id"), F.lit(share)) < least))
    length = F.char_length("text")
    start = F.when(length > SAMPLE_CHARS, F.pmod(F.xxhash64("id", F.lit(1)), length - SAMPLE_CHARS)).otherwise(0) + 1
    parts = (known.where(chosen).select("lang", F.xxhash64("id").alias("h"),
                                        F.col("text").substr(start.cast("int"), F.lit(SAMPLE_CHARS)).alias("part"))
             .groupBy("lang", "part").agg(F.min("h").alias("h"))
             .withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "part")))
             .where(F.col("nth") <= MOST_PARTS).orderBy("lang", "h", "part").collect())
    found = {r["lang"]: b"" for r in sorted(counts, key=lambda r: (-r["count"], r["lang"]))}
    for r in parts:
        found[r["lang"]] = (found[r["lang"]] + normal(r["part"]) + b"\n")[:DICTIONARY_BYTES]
    return found


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.names = list(dictionaries)
        self.coders = {level: [self._coder(dictionaries[name], level) for name in self.names] for level in (LEVEL, SHORT_LEVEL)}

    @staticmethod
    def _coder(content: bytes, level: int) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False,
                                        write_checksum=False, write_dict_id=False)

    def classify(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.names or not _LETTER.search(text):
            return UNKNOWN, 0.0
        if len(self.names) == 1:
            return self.names[0], 1.0
        raw = normal(text)
        chunks = [raw[i:i + CHUNK] for i in range(0, len(raw), CHUNK)]
        coders = self.coders[SHORT_LEVEL if len(raw) <= SHORT else LEVEL]
        sizes = [sum(len(coder.compress(_FILLER + c)) for c in chunks) for coder in coders]
        best, second = sorted(range(len(sizes)), key=sizes.__getitem__)[:2]
        return self.names[best], (sizes[second] - sizes[best]) / sizes[second]


_HELD: dict[str, Classifier] = {}


def language_column(spark, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN) -> Column:
    """A struct of ``lang``, ``score`` and ``rejected`` for a whole text."""
    ship(spark)
    shared = spark.sparkContext.broadcast(dictionaries)
    key = hashlib.sha256(repr(sorted(dictionaries.items())).encode()).hexdigest()

    @F.pandas_udf("lang string, score double, rejected boolean")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _HELD:
            _HELD.clear()
            _HELD[key] = Classifier(shared.value)
        held = _HELD[key]
        for texts in batches:
            found = pd.DataFrame([held.classify(t) for t in texts], columns=["lang", "score"])
            found["score"] = found["score"].astype("float64")
            yield found.assign(rejected=found["score"] < min_margin)

    return classify(text)
