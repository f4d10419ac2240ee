import zlib

from pyspark.sql import functions as F

from hearsay.llm import langid

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_rows_are_told_apart(spark):
    docs = spark.read.parquet(DOCS)
    found = langid.predict(docs, langid.fit(docs.where(~langid.held_out()))).join(docs.select("doc_id", "lang"), "doc_id")
    rows = found.where(langid.held_out()).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    lettered = [r for r in rows if r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == r["lang"] for r in lettered) >= 0.95 * len(lettered)
    assert sum(r["rejected"] for r in rows) <= 0.05 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(odd_documents, empty_documents, spark):
    known = langid.fit(spark.read.parquet(DOCS))
    rows = langid.predict(odd_documents, known).collect()
    texts = {r["doc_id"]: r["text"] for r in odd_documents.collect()}
    assert len(rows) == odd_documents.count()
    for r in rows:
        text = texts[r["doc_id"]]
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] in known
    assert langid.predict(empty_documents, known).count() == 0
    assert langid.fit(empty_documents) == {}
    assert {r["lang_pred"] for r in langid.predict(odd_documents, {}).collect()} == {"und"}
    kept = langid.keep_documents(odd_documents, known)
    assert kept.columns == odd_documents.columns


def test_sample_is_bounded_and_copies_count_once(spark):
    rows = [(i, "hello number " + "abcdefg"[i % 7] * 3, "en") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    content = langid.fit(docs, rows_per_language=5)["en"].decode().split("\n")
    assert len(content) == len(set(content)) <= 5


def test_narrow_margins_reject():
    content = tuple((n, b"the same words for both of them " * 20) for n in ("aa", "bb"))
    lang, score, margin, rejected = langid.judge("the same words", langid._compressors(content))
    assert (lang, margin, rejected) == ("aa", 0.0, True) and score == 0.5


def test_fold_of_null_keys(spark):
    docs = spark.createDataFrame([(None,)], "doc_id long")
    assert docs.select(langid.held_out().alias("h")).first()["h"] is False
    assert docs.select(F.lit(1)).count() == 1


def test_unlabelled_tables_pass_the_stage(spark):
    import corpus_pipeline

    texts = ["some words without a label", "123 456", "", None, "ещё текст"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()} == {0, 4}
    assert {r["doc_id"]: r["rejected"] for r in langid.predict(docs, {}).collect()} == {0: False, 1: True, 2: True, 3: True, 4: False}
