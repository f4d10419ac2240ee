"""Language identification by compression (operator 7).

For each language a raw-content zstandard dictionary is cut from labelled
texts. A text belongs to the language whose dictionary makes it smallest. Case,
digits and punctuation tell nothing of the language and break up matches, so
both sides are lower-cased and other runs than letters become one space. Texts
are compressed in chunks, so that a long text's own content does not drown the
dictionary, and every chunk of the whole text counts.

Fitting reads a bounded sample of labelled rows, ``rows_per_language`` texts of
each language with an excerpt of ``excerpt_chars`` from each; rows are taken in
the order of a hash of their text, so the sample does not depend on how the
table is laid out. Prediction covers every row.

The score is the winner's share when each byte that a dictionary saves counts
as ``evidence`` bits, at most 1. A row is ``rejected`` when it has no letter, or when
the best two sizes differ by less than ``min_margin`` bytes per 100 bytes of text.

Rows: null texts and texts without a letter are ``und`` with score 0, and are
rejected. Ties go to the language that sorts first. Repeated rows give repeated
results; an empty table gives an empty result. Without any labelled text every
row is ``und`` with score and margin 0; the margin says nothing then, and only
texts without a letter are rejected. Columns other than key and text are left out.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm.tasks import map_arrow, text_slices

NO_LANGUAGE = "und"
ROWS_PER_LANGUAGE = 256
EXCERPT_CHARS = 1600
MAX_LANGUAGES = 400
SPARE = 8
CHUNK_BYTES = 1024
LEVEL = 3
EVIDENCE = 2.0
MIN_MARGIN = 0.05

_LETTER = regex.compile(r"\p{L}")
_OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    return _OTHER.sub(" ", text.lower())


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE,
        excerpt_chars: int = EXCERPT_CHARS) -> dict[str, bytes]:
    """A dictionary's raw content for each language of the labelled rows.

    An excerpt is taken from the middle of a text. At most ``MAX_LANGUAGES``
    languages are taken on; more labels than that are an error, so what is sent
    to the tasks stays within their number times rows times excerpt.
    """
    body = F.col(text).cast("string")
    some = labelled.select(F.col(lang).cast("string").alias("lang"), body.alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    middle = F.greatest(F.lit(1), (F.char_length("text") / 2 - excerpt_chars / 2).cast("int"))
    sample = some.select("lang", F.xxhash64("text").alias("h"), F.substring("text", middle, F.lit(excerpt_chars)).alias("text"))
    # A hash keeps about SPARE times the texts wanted of each language; copies count once.
    counts = {r["lang"]: r["n"] for r in some.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in the labels")
    if not counts:
        return {}
    share = F.create_map(*(F.lit(x) for name, n in counts.items() for x in (name, min(1.0, SPARE * rows_per_language / max(n, 1)))))
    sample = sample.where(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30))
    order = Window.partitionBy("lang").orderBy("h")
    few = sample.groupBy("lang", "h").agg(F.min("text").alias("text"))
    few = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows_per_language)
    found: dict[str, dict[str, None]] = {}
    for row in few.orderBy("lang", "n").collect():
        found.setdefault(row["lang"], {})[row["text"]] = None
    return {name: "\n".join(map(plain, texts)).encode() for name, texts in sorted(found.items())}


@lru_cache(maxsize=2)
def _compressors(content: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for name, data in content:
        known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        out.append((name, zstandard.ZstdCompressor(
            dict_data=known, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)))
    return out


def sizes(text: bytes, compressors: list[tuple[str, zstandard.ZstdCompressor]]) -> list[int]:
    """Bytes of the whole text under each dictionary, chunk by chunk."""
    chunks = [text[i:i + CHUNK_BYTES] for i in range(0, len(text), CHUNK_BYTES)]
    return [sum(map(len, map(one.compress, chunks))) for _, one in compressors]


def judge(text: str | None, compressors: list[tuple[str, zstandard.ZstdCompressor]],
          min_margin: float = MIN_MARGIN) -> tuple[str, float, float, bool]:
    """``(language, score, margin in bytes per 100 bytes of text, rejected)``."""
    if not text or not _LETTER.search(text):
        return NO_LANGUAGE, 0.0, 0.0, True
    if not compressors:
        return NO_LANGUAGE, 0.0, 0.0, False
    data = plain(text).encode()
    found = sizes(data, compressors)
    order = sorted(range(len(found)), key=lambda i: (found[i], i))
    best = found[order[0]]
    margin = 100.0 * (found[order[1]] - best) / len(data) if len(order) > 1 else 100.0
    score = 1.0 / sum(math.exp(-EVIDENCE * min(50.0, (n - best) * math.log(2))) for n in found)
    return compressors[order[0]][0], score, margin, margin < min_margin


def _judged(docs: DataFrame, dictionaries: dict[str, bytes], text: str, keep: tuple[str, ...], min_margin: float) -> DataFrame:
    """``(_keep0.., lang_pred, score, margin, rejected)`` per row."""
    content = tuple(sorted(dictionaries.items()))
    kept = [docs[c].alias(f"_keep{i}") for i, c in enumerate(keep)]
    chosen = docs.select(docs[text].cast("string").alias("text"), *kept)
    types = [docs.schema[c].dataType.simpleString() for c in keep]

    def run(batches):
        compressors = _compressors(content)
        for part in text_slices(batches):
            found = [judge(t, compressors, min_margin) for t in part.column(0).to_pylist()]
            lang, score, margin, rejected = zip(*found)
            columns = [*part.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                       pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    own = [f"_keep{i}" for i in range(len(keep))]
    names = [*own, "lang_pred", "score", "margin", "rejected"]
    schema = ", ".join([*(f"{o} {t}" for o, t in zip(own, types)), "lang_pred string, score double, margin double, rejected boolean"])
    return map_arrow(chosen, run, schema)


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", key: str = "doc_id",
            min_margin: float = MIN_MARGIN) -> DataFrame:
    """``(key, lang_pred, score, margin, rejected)`` per row."""
    return _judged(docs, dictionaries, text, (key,), min_margin).withColumnRenamed("_keep0", key)


def held_out(key: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Rows that fitting must not see, by the checksum of their key's text."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def keep_documents(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text",
                   min_margin: float = MIN_MARGIN) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    out = _judged(docs, dictionaries, text, tuple(docs.columns), min_margin).where(~F.col("rejected"))
    return out.select(*(F.col(f"_keep{i}").alias(c) for i, c in enumerate(docs.columns)))
