"""A stream's final state equals the batch result."""

import os
import shutil

import pytest

from hearsay.plans.ingest import ingest_corpus
from hearsay.plans.search import search_batch
from hearsay.sources.store import IndexStore
from hearsay.streaming import (FrequencyTable, document_frequency_stream, frequency_from_index, ingest_stream,
                               read_frequency_state, search_stream, write_frequency_updates)

from conftest import GOLDEN, GOLDEN_STOP_WORDS

CORPUS_SCHEMA = "file string, transcript string"


def write_parts(spark, folder, rows, schema, parts):
    for i, chunk in enumerate(parts):
        spark.createDataFrame([rows[j] for j in chunk], schema).coalesce(1).write.mode("append").parquet(folder)


def test_ingest_stream_matches_batch(spark, workdir):
    src = os.path.join(workdir, "in")
    rows = GOLDEN + [("/v/a.mp4", "Ice hockey! The puck, the stick; score.")]   # a re-sent file
    write_parts(spark, src, rows, CORPUS_SCHEMA, [[0, 1], [2, 3, 4]])
    stream = spark.readStream.schema(CORPUS_SCHEMA).option("maxFilesPerTrigger", "1").parquet(src)
    store = IndexStore(spark, workdir + "/ix", GOLDEN_STOP_WORDS).create()
    ingest_stream(stream, store, workdir + "/ckpt").awaitTermination()
    batch = IndexStore(spark, workdir + "/bx", GOLDEN_STOP_WORDS).create()
    ingest_corpus(batch, spark.createDataFrame(GOLDEN, CORPUS_SCHEMA), "b")
    assert sorted(tuple(r) for r in store.postings().collect()) == sorted(tuple(r) for r in batch.postings().collect())
    assert len(store.committed_ids()) == 2
    # Restarting from the same checkpoint finds nothing new.
    ingest_stream(stream, store, workdir + "/ckpt").awaitTermination()
    assert store.documents().count() == 4


def test_document_frequency_stream(spark, workdir):
    src = os.path.join(workdir, "in")
    rows = GOLDEN + [("/v/b.mp4", "Ice ice baby")]
    write_parts(spark, src, rows, CORPUS_SCHEMA, [[0], [1, 2], [3, 4]])
    stream = spark.readStream.schema(CORPUS_SCHEMA).option("maxFilesPerTrigger", "1").parquet(src)
    out = os.path.join(workdir, "df")
    write_frequency_updates(document_frequency_stream(stream, GOLDEN_STOP_WORDS), out,
                            workdir + "/ckpt").awaitTermination()
    got = dict(tuple(r) for r in read_frequency_state(spark, out).collect())
    assert got == {"ice": 2, "hockey": 1, "puck": 1, "stick": 1, "score": 2, "baby": 1, "dont": 1}


def test_search_stream(spark, workdir):
    store = IndexStore(spark, workdir + "/ix", GOLDEN_STOP_WORDS).create()
    ingest_corpus(store, spark.createDataFrame(GOLDEN, CORPUS_SCHEMA), "b")
    qschema = "query_id string, terms array<string>"
    qrows = [("q1", ["ice"]), ("q2", ["hockey", "ice", "score"]), ("q3", []), ("q4", ["a", "b", "c", "d", "e", "f", "ice"])]
    src = os.path.join(workdir, "q")
    write_parts(spark, src, qrows, qschema, [[0, 1], [2, 3]])
    stream = spark.readStream.schema(qschema).option("maxFilesPerTrigger", "1").parquet(src)
    out = os.path.join(workdir, "res")
    search_stream(stream, store.index, out, workdir + "/ckpt", k=3).awaitTermination()
    got = sorted((r["query_id"], r["rank"], r["file"], r["score"]) for r in spark.read.parquet(out).collect())
    expect = search_batch(store.index(), spark.createDataFrame(qrows, qschema), 3)
    assert got == sorted((r["query_id"], r["rank"], r["file"], r["score"]) for r in expect.collect())
    assert {g[0] for g in got} == {"q1", "q2", "q4"}


def test_ingest_stream_compacts(spark, workdir):
    src = os.path.join(workdir, "in")
    write_parts(spark, src, GOLDEN, CORPUS_SCHEMA, [[0], [1], [2], [3]])
    stream = spark.readStream.schema(CORPUS_SCHEMA).option("maxFilesPerTrigger", "1").parquet(src)
    store = IndexStore(spark, workdir + "/ix", GOLDEN_STOP_WORDS).create()
    ingest_stream(stream, store, workdir + "/ckpt", compact_after=2).awaitTermination()
    assert len(store.committed_ids()) <= 2
    batch = IndexStore(spark, workdir + "/bx", GOLDEN_STOP_WORDS).create()
    ingest_corpus(batch, spark.createDataFrame(GOLDEN, CORPUS_SCHEMA), "b")
    assert sorted(tuple(r) for r in store.postings().collect()) == sorted(tuple(r) for r in batch.postings().collect())
    assert store.index().documents.count() == 4


ALL_DF = {"ice": 2, "hockey": 1, "puck": 1, "stick": 1, "score": 2, "baby": 1, "dont": 1}


def test_frequency_starts_from_the_index_and_outlives_its_checkpoint(spark, workdir):
    src = os.path.join(workdir, "in")
    write_parts(spark, src, GOLDEN + [GOLDEN[1], ("/v/n.mp4", None)], CORPUS_SCHEMA, [[0, 1], [2], [3, 4, 5]])
    stream = spark.readStream.schema(CORPUS_SCHEMA).option("maxFilesPerTrigger", "1").parquet(src)
    store = IndexStore(spark, workdir + "/ix", GOLDEN_STOP_WORDS).create()
    ingest_corpus(store, spark.createDataFrame(GOLDEN[:1], CORPUS_SCHEMA), "b0")
    table = FrequencyTable(spark, workdir + "/df", fan_in=2)
    assert table.read().count() == 0

    def run(checkpoint):
        frequency_from_index(stream, store, table, workdir + checkpoint).awaitTermination()
        return {r["term"]: r["df"] for r in table.read().collect()}

    assert run("/ckpt") == ALL_DF
    # Indexed after the start: a restart neither counts it twice nor begins a new run.
    ingest_corpus(store, spark.createDataFrame(GOLDEN[1:3], CORPUS_SCHEMA), "b1")
    store.compact()
    store.vacuum()
    assert run("/ckpt") == ALL_DF and len(table.runs()) == 1
    write_parts(spark, src, [("/v/e.mp4", "ice puck"), ("/v/a.mp4", "other words")], CORPUS_SCHEMA, [[0, 1]])
    after = {**ALL_DF, "ice": 3, "puck": 2}
    assert run("/ckpt") == after and len(table.runs()) == 1
    # The checkpoint is lost: a new run from the index of now gives the same.
    shutil.move(workdir + "/ckpt", workdir + "/lost")
    assert run("/ckpt") == after and len(table.runs()) == 2


def test_frequency_over_an_empty_index(spark, workdir):
    write_parts(spark, workdir + "/in", GOLDEN, CORPUS_SCHEMA, [[0, 1, 2, 3]])
    store = IndexStore(spark, workdir + "/ix", GOLDEN_STOP_WORDS).create()
    table = FrequencyTable(spark, workdir + "/df")
    frequency_from_index(spark.readStream.schema(CORPUS_SCHEMA).parquet(workdir + "/in"), store, table,
                         workdir + "/ckpt").awaitTermination()
    assert dict(tuple(r) for r in table.read().collect()) == ALL_DF


def test_old_epochs_are_folded(spark, workdir):
    store = IndexStore(spark, workdir + "/ix", GOLDEN_STOP_WORDS).create()
    ingest_corpus(store, spark.createDataFrame(GOLDEN[:2], CORPUS_SCHEMA), "b0")
    table = FrequencyTable(spark, workdir + "/df", fan_in=3)
    run = table.begin(store, workdir + "/ckpt")
    assert table.begin(store, workdir + "/ckpt") == run
    for epoch in range(20):
        since = [("ice", epoch + 1), (f"t{epoch}", 1)]
        table.add(run, spark.createDataFrame(since, "term string, df long"), epoch)
        kept = table.updates(run)
        assert [e for a, b in kept for e in range(a, b + 1)] == list(range(epoch + 1))      # each epoch once
        assert len(kept) <= 2 * (len(kept) and table._tier((0, epoch)) + 1)
        assert len(table._updates(run)) <= 2 * 3 + 9
    # A replayed epoch, folded or not, changes nothing.
    for epoch in (0, 7, 19):
        table.add(run, spark.createDataFrame([("ice", epoch + 1)], "term string, df long"), epoch)
    got = dict(tuple(r) for r in table.read().collect())
    assert got == {"ice": 22, "baby": 1, "hockey": 1, "puck": 1, "stick": 1, "score": 1, **{f"t{e}": 1 for e in range(20)}}


def test_fold_needs_two(spark, workdir):
    with pytest.raises(ValueError):
        FrequencyTable(spark, workdir, fan_in=1)


def test_a_table_of_part_files_is_streamed(spark, workdir):
    from hearsay.streaming.sources import documents_corpus_stream

    rows = [(i, f"word{i} ice", "en", "s", 9) for i in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(
        f"{workdir}/sf/documents.parquet")
    q = write_frequency_updates(document_frequency_stream(documents_corpus_stream(spark, f"{workdir}/sf")),
                                f"{workdir}/state", f"{workdir}/ckpt", name="r2_parts")
    q.awaitTermination()
    state = {r["term"]: r["df"] for r in read_frequency_state(spark, f"{workdir}/state").collect()}
    assert state == {"ice": 4, **{f"word{i}": 1 for i in range(4)}}
