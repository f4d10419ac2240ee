"""Tiers of batches, two writers, and what an ingest reads."""

from collections import Counter

from pyspark.sql import functions as F

from hearsay.operators import indexing as ix
from hearsay.plans.search import search
from hearsay.sources.store import TABLES, IndexStore

CORPUS = "file string, transcript string"


def snapshot(store):
    return (sorted(tuple(r) for r in store.postings().collect()), sorted(tuple(r) for r in store.lexicon().collect()),
            sorted((r["file"], r["transcription"]) for r in store.documents().collect()))


def test_tiers_rewrite_a_row_a_few_times(spark, workdir, monkeypatch):
    """64 batches of one document: only commits are written here, the tables are left out."""
    store = IndexStore(spark, workdir + "/ix", []).create()
    rewritten, merge, sizes = Counter(), IndexStore._merge, {}

    def counted(self, rows, batch_id):
        sizes["now"] = sum(r["n_documents"] for r in rows)
        rewritten.update(b for r in rows for b in (r["batch_id"], *r["replaces"]) if b.startswith("b"))
        return merge(self, rows, batch_id)

    monkeypatch.setattr(IndexStore, "_merge", counted)
    monkeypatch.setattr(IndexStore, "_write_batch", lambda self, documents, folder: (sizes["now"], 2 * sizes["now"]))
    nothing = spark.createDataFrame([], CORPUS)
    monkeypatch.setattr(IndexStore, "_folders", lambda self, table, folders: spark.createDataFrame([], TABLES[table]))
    for i in range(64):
        sizes["now"] = 1
        store.append(nothing, f"b{i}", assume_new=True)
        store.compact_tiers(4)
    assert max(rewritten.values()) <= 4 and len(rewritten) == 64
    assert len(store.visible_batches()) <= 4
    assert sum(r["n_documents"] for r in store.visible_batches()) == 64


def test_tiers_keep_every_row(spark, workdir):
    store = IndexStore(spark, workdir + "/ix", [], term_buckets=4).create()
    for i in range(6):
        store.append(spark.createDataFrame([(f"f{i}", f"common w{i}")], CORPUS), f"b{i}", assume_new=True)
        store.compact_tiers(2)
    assert store.documents().count() == 6 and dict(tuple(r) for r in store.lexicon().collect())["common"] == 6
    assert [r["file"] for r in search(store.index(), ["w5"], 3).collect()] == ["f5"]


def test_a_merge_that_would_be_merged_again_is_not_written(spark, workdir, monkeypatch):
    store = IndexStore(spark, workdir + "/ix", []).create()
    wrote, write = [], IndexStore._write_batch
    monkeypatch.setattr(IndexStore, "_write_batch", lambda self, *a: (wrote.append(write(self, *a)), wrote[-1])[1])
    made = []
    for i in range(4):
        store.append(spark.createDataFrame([(f"f{i}", f"common w{i}")], CORPUS), f"b{i}", assume_new=True)
        made.append(len(store.compact_tiers(2)))
    assert made == [0, 1, 0, 1]                        # the last takes all three batches that are left
    assert [n for n, _ in wrote] == [1, 1, 2, 1, 1, 4]
    assert len(store.committed_ids()) == 1 and store.documents().count() == 4
    assert len(store.vacuum()) == 5 and dict(tuple(r) for r in store.lexicon().collect())["common"] == 4


def test_postings_are_shuffled_without_what_follows_from_them(spark, workdir):
    store = IndexStore(spark, workdir + "/ix", []).create()
    postings = spark.createDataFrame([("t", "f", 1, 1, 5)], "term string, file string, tf_count long, num_terms long, doc long")
    striped = store._striped(postings, 10_000_000)
    plan = striped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and " AS block" not in plan.split("Exchange")[1]
    row = striped.first()
    assert (row["term"], row["block"], row["n"], row["max_tf"]) == ("t", 0, 1, 1.0) and 0 <= row["bucket"] < 32


def test_tiered_query_leaves_no_merged_batch_behind(spark, workdir, monkeypatch):
    from hearsay import registry

    spark.createDataFrame([(i, f"word{i} common") for i in range(40)], "doc_id long, text string").write.parquet(workdir + "/documents.parquet")
    there, append = [], IndexStore.append

    def noting(self, *a, **b):
        there.append(len(self._commit_rows()))
        return append(self, *a, **b)

    monkeypatch.setattr(IndexStore, "append", noting)
    assert registry.u2_tiered_postings(spark, workdir).count() == 80
    assert there == [0, 1, 1, 2]


def test_a_large_batch_is_not_merged_with_small_ones(spark, workdir):
    store = IndexStore(spark, workdir + "/ix", []).create()
    big = spark.range(500).select(F.concat(F.lit("big"), "id").alias("file"), F.lit("a b c").alias("transcript"))
    store.append(big, "big")
    for i in range(3):
        store.append(spark.createDataFrame([(f"s{i}", "a")], CORPUS), f"s{i}")
    before = snapshot(store)
    assert len(store.compact_tiers(3)) == 1
    assert "big" in store.committed_ids() and len(store.committed_ids()) == 2
    assert snapshot(store) == before
    assert store.vacuum() == ["s0", "s1", "s2"] and snapshot(store) == before


def interrupted_by(store, monkeypatch, other):
    """Let another writer commit between this store's last look and its commit, once."""
    commit = IndexStore._commit
    state = {"done": False}

    def late(self, *args):
        if self is store and not state["done"]:
            state["done"] = True
            other()
        return commit(self, *args)

    monkeypatch.setattr(IndexStore, "_commit", late)


def test_two_writers_of_one_file(spark, workdir, monkeypatch):
    one = IndexStore(spark, workdir + "/ix", []).create()
    two = IndexStore(spark, workdir + "/ix", [])
    interrupted_by(one, monkeypatch, lambda: two.append(spark.createDataFrame([("x", "second"), ("y", "second")], CORPUS), "two"))
    assert one.append(spark.createDataFrame([("x", "first"), ("z", "first")], CORPUS), "one", assume_new=True) == 1
    assert {r["file"]: r["transcription"] for r in one.documents().collect()} == {"x": "second", "y": "second", "z": "first"}
    assert [r["number"] for r in one._commit_rows()] == [1, 2]


def test_two_writers_of_other_files_and_of_one_batch(spark, workdir, monkeypatch):
    one = IndexStore(spark, workdir + "/ix", []).create()
    two = IndexStore(spark, workdir + "/ix", [])
    wrote = []
    interrupted_by(one, monkeypatch, lambda: two.append(spark.createDataFrame([("y", "b")], CORPUS), "two"))
    write = IndexStore._write_batch
    monkeypatch.setattr(IndexStore, "_write_batch", lambda self, *a: (wrote.append(self), write(self, *a))[1])
    assert one.append(spark.createDataFrame([("x", "a")], CORPUS), "one") == 1
    assert wrote.count(one) == 1 and one.documents().count() == 2       # nothing was written twice
    interrupted_by(one, monkeypatch, lambda: two.append(spark.createDataFrame([("z", "c")], CORPUS), "same"))
    assert one.append(spark.createDataFrame([("z", "c")], CORPUS), "same") == 0
    assert one.documents().count() == 3


def test_a_merge_gives_way_to_another_merge(spark, workdir, monkeypatch):
    one = IndexStore(spark, workdir + "/ix", []).create()
    two = IndexStore(spark, workdir + "/ix", [])
    for n in ("a", "b"):
        one.append(spark.createDataFrame([(n, "t")], CORPUS), n)
    interrupted_by(one, monkeypatch, lambda: two.compact("two"))
    assert one.compact("one") is None
    assert one.committed_ids() == ["two"] and one.documents().count() == 2


def test_ingest_decides_on_paths(spark, workdir):
    store = IndexStore(spark, workdir + "/ix", []).create()
    store.append(spark.createDataFrame([("a", "t"), ("b", "t")], CORPUS), "b1")
    spark.createDataFrame([("a", "new"), ("c", "c1"), ("c", "c0"), ("d", "d"), ("e", None)], CORPUS).write.parquet(workdir + "/in")
    corpus = spark.read.parquet(workdir + "/in")
    fresh = store.fresh_rows(corpus, store.visible_batches())
    assert {tuple(r) for r in fresh.collect()} == {("c", "c0"), ("d", "d")}
    known = store.known_files(store.visible_batches())._jdf.queryExecution().executedPlan().toString()
    assert "documents" not in known and "transcription" not in known
    # Nothing known, nothing repeated: the transcripts meet no join at all.
    plain = store.fresh_rows(corpus.where("file = 'd'"), store.visible_batches())._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plain and "Exchange" not in plain


def test_only_heavy_terms_are_repeated_for_salts(spark):
    postings = spark.range(3000).select(
        F.when(F.col("id") < 1000, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 700)).alias("term"), F.col("id").cast("string").alias("file"))
    view = ix.inverted_index(postings, chunk_size=100, salts=8)
    chunks = {r["term"]: 0 for r in view.collect()}
    for r in view.collect():
        chunks[r["term"]] += 1
    assert chunks["hot"] == 10 and set(chunks.values()) == {1, 10} and len(chunks) == 701
    lexicon = ix.document_frequency(postings)
    assert sorted(map(tuple, ix.inverted_index(postings, 100, lexicon).collect())) == sorted(map(tuple, ix.inverted_index(postings, 100).collect()))
