"""Replays, interruptions and odd inputs that once gave wrong answers."""

import os

import pytest
from pyspark.sql import functions as F

from hearsay.operators import indexing as ix
from hearsay.operators import scoring as sc
from hearsay.plans.ingest import ingest_corpus
from hearsay.plans.search import search_batch
from hearsay.sources.corpus import read_corpus
from hearsay.sources.media import extract_transcripts, list_sources
from hearsay.sources.store import IndexStore

CORPUS = "file string, transcript string"


def test_replay_after_another_batch_took_the_files(spark, workdir, golden_corpus):
    store = IndexStore(spark, workdir + "/ix").create()
    # b1 is interrupted after its documents are written, b2 takes the same files, b1 is replayed.
    store._write_batch(ix.build_documents(golden_corpus, store.settings_stop_words()), store._attempt("b1"))
    assert ingest_corpus(store, golden_corpus, "b2") == 4
    assert ingest_corpus(store, golden_corpus, "b1") == 0
    assert store.documents().count() == 4
    assert store.documents().select("file").distinct().count() == 4


def test_null_and_repeated_transcripts(spark, workdir):
    rows = [("z", None), ("z", "ice"), ("y", "b b"), ("y", "a"), ("x", None)]
    corpus = spark.createDataFrame(rows, CORPUS)
    store = IndexStore(spark, workdir + "/ix", []).create()
    assert ingest_corpus(store, corpus, "b1") == 2
    assert {r["file"]: r["transcription"] for r in store.documents().collect()} == {"z": "ice", "y": "a"}
    assert [r["file"] for r in ix.rejected_documents(corpus).collect()] == ["x"]


def test_vacuum_interrupted_at_any_delete_shows_the_same_snapshot(spark, workdir, golden_corpus):
    store = IndexStore(spark, workdir + "/ix").create()
    for i, path in enumerate(["/v/a.mp4", "/v/b.mp4"]):
        ingest_corpus(store, golden_corpus.where(F.col("file") == path), f"s{i}")
    store.compact("c1")
    ingest_corpus(store, golden_corpus.where("file > '/v/b.mp4'"), "s2")
    store.compact("c2")
    assert store.committed_ids() == ["c2"]
    rows = {r["batch_id"]: r for r in store.commits().collect()}
    assert set(rows["c2"]["replaces"]) == {"c1", "s0", "s1", "s2"}
    jvm = spark.sparkContext._jvm
    for gone in ("c1", "s1", "s0"):        # commit rows deleted one by one, the chain's middle first
        path = jvm.org.apache.hadoop.fs.Path(f"{store.path('commits')}/{rows[gone]['number']:020d}.json")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        assert store.committed_ids() == ["c2"] and store.documents().count() == 4
    store.vacuum()
    assert store.committed_ids() == ["c2"] and store.documents().count() == 4


def test_another_stop_word_list_is_refused(spark, workdir, golden_corpus):
    IndexStore(spark, workdir + "/ix", ["the"]).create()
    with pytest.raises(ValueError):
        ingest_corpus(IndexStore(spark, workdir + "/ix", ["ice"]), golden_corpus, "b1")


def test_listing_takes_direct_children_only(spark, workdir):
    folder = os.path.join(workdir, "m [1]{x}")
    for name in ("a.mp4", "k=v/b.mp4", "sub/c.mp4", "g h.mp4", "d.txt"):
        os.makedirs(os.path.dirname(os.path.join(folder, name)), exist_ok=True)
        with open(os.path.join(folder, name), "w") as f:
            f.write("x")
    found = {os.path.relpath(r["file"], folder) for r in list_sources(spark, folder).collect()}
    assert found == {"a.mp4", "g h.mp4"}


def test_text_paths_are_not_encoded(spark, workdir):
    os.makedirs(workdir + "/t")
    with open(workdir + "/t/g h+1%.txt", "w") as f:
        f.write("ice")
    assert [os.path.basename(r["file"]) for r in read_corpus(spark, workdir + "/t", fmt="text").collect()] == ["g h+1%.txt"]


def test_extraction_is_spread_without_being_told(spark):
    paths = spark.range(300).select(F.col("id").cast("string").alias("file")).coalesce(1)
    out = extract_transcripts(paths, lambda: lambda path: path + "!")
    assert out.rdd.getNumPartitions() >= 30
    assert {r["transcript"] for r in out.collect()} == {f"{i}!" for i in range(300)}


def test_repeated_query_rows_count_once(spark, golden_index):
    one = spark.createDataFrame([("q", ["ice", "hockey"])], "query_id string, terms array<string>")
    assert search_batch(golden_index, one.union(one)).collect() == search_batch(golden_index, one).collect()


def test_a_null_line_is_empty(spark):
    row = spark.createDataFrame([(None,)], "line string").select(sc.parse_query("line").alias("q")).first()["q"]
    assert row["status"] == "empty" and row["terms"] == []


def test_hot_term_is_chunked_over_many_tasks(spark):
    postings = spark.range(4000).select(F.lit("hot").alias("term"), F.col("id").cast("string").alias("file"))
    plan = ix.inverted_index(postings, chunk_size=100)._jdf.queryExecution().executedPlan().toString()
    assert "salt" in plan
    rows = ix.inverted_index(postings, chunk_size=100).collect()
    assert len(rows) == 40 and sum(len(r["documents"]) for r in rows) == 4000
