"""T1–T6 and the fixed values they rely on."""

import string

from pyspark.sql import functions as F

from hearsay.functions import text as tx
from hearsay.functions.stopwords import ENGLISH_STOP_WORDS


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("o")).first()["o"]


def test_stop_words_equal_spark_default(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert list(ENGLISH_STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")


def test_punctuation_deleted_not_replaced(spark):
    assert tx.PUNCTUATION == string.punctuation and len(tx.PUNCTUATION) == 32
    assert one(spark, tx.strip_punctuation, "a" + string.punctuation + "b") == "ab"
    assert one(spark, tx.normalize, "Rock'n'Roll a-b") == "rocknroll ab"
    assert one(spark, tx.strip_punctuation, "a—b’c¿d") == "a—b’c¿d"


def test_lowercase_unicode(spark):
    assert one(spark, tx.normalize, "ÉÑÜß") == "éñüß"


def test_whitespace_29_characters(spark):
    assert len(tx.WHITESPACE) == 29
    for ch in tx.WHITESPACE:
        assert one(spark, tx.tokenize, f"a{ch}b") == ["a", "b"], hex(ord(ch))
    assert one(spark, tx.tokenize, "a\u200bb") == ["a\u200bb"]
    assert one(spark, tx.tokenize, "  a \n\n b  ") == ["a", "b"]
    assert one(spark, tx.tokenize, "") == []


def test_every_character_as_python_takes_it(spark):
    # 256 texts of 256 characters each, every one between two letters; no surrogates.
    texts = ["".join(f"a{chr(c)}b" for c in range(256 * i, 256 * i + 256)) for i in range(256) if not 0xd8 <= i <= 0xdf]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select(
        "v", tx.strip_punctuation("v").alias("s"), tx.tokenize("v").alias("t")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["s"] == r["v"].translate({ord(c): None for c in string.punctuation}) and r["t"] == r["v"].split()


def test_characters_are_not_looked_up_one_by_one(spark):
    df = spark.createDataFrame([("a-b",)], "v string").select(tx.normalize("v"))
    assert "translate(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_stop_words_after_apostrophes(spark):
    toks = spark.createDataFrame([("Don't stop the music",)], "v string").select(
        tx.remove_stop_words(tx.tokenize(tx.normalize("v"))).alias("o")).first()["o"]
    assert toks == ["dont", "stop", "music"]


def test_remove_keeps_order_and_repeats(spark):
    df = spark.createDataFrame([(["b", "the", "x", "b"],)], "t array<string>")
    assert df.select(tx.remove_stop_words("t").alias("o")).first()["o"] == ["b", "x", "b"]


def test_path_display(spark):
    assert one(spark, tx.path_display, "C:\\v\\a.mp4") == "C:/v/a.mp4"


def test_term_runs(spark):
    df = spark.createDataFrame([(["b", "c", "b", "c", "c"],), ([],), (["x"],)], "t array<string>")
    out = df.select(F.sort_array("t").alias("s")).select(tx.term_runs("s").alias("r")).collect()
    assert [[(e["term"], e["tf_count"]) for e in r["r"]] for r in out] == [[("b", 2), ("c", 3)], [], [("x", 1)]]
