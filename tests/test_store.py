"""The index store life cycle."""

import json
import os

from pyspark.sql import functions as F

from hearsay.operators import indexing as ix
from hearsay.plans.ingest import ingest_corpus, ingest_sources
from hearsay.plans.search import search
from hearsay.sources import interchange
from hearsay.sources.media import list_sources, text_file_extractor
from hearsay.sources.store import IndexStore

from conftest import GOLDEN, GOLDEN_STOP_WORDS


def snapshot(store):
    idx = store.index()
    docs = sorted((r["file"], r["num_terms"], tuple(sorted(r["term_frequencies"].items())))
                  for r in idx.documents.collect())
    post = sorted(tuple(r) for r in idx.postings.collect())
    lex = sorted(tuple(r) for r in idx.lexicon.collect())
    return docs, post, lex


def test_create_keeps_existing(spark, workdir):
    store = IndexStore(spark, workdir + "/ix").create()
    assert store.documents().count() == 0 and store.postings().count() == 0
    ingest_corpus(store, spark.createDataFrame(GOLDEN, "file string, transcript string"), "b1")
    IndexStore(spark, workdir + "/ix").create()
    assert store.documents().count() == 4


def test_double_ingest_and_repeated_path(spark, workdir, golden_corpus):
    store = IndexStore(spark, workdir + "/ix", GOLDEN_STOP_WORDS).create()
    doubled = golden_corpus.unionByName(golden_corpus)
    assert ingest_corpus(store, doubled, "b1") == 4
    first = snapshot(store)
    assert ingest_corpus(store, golden_corpus, "b2") == 0
    assert ingest_corpus(store, golden_corpus, "b1") == 0
    assert snapshot(store) == first
    assert dict(first[2])["ice"] == 2


def test_batches_equal_one_batch(spark, workdir, golden_corpus):
    one = IndexStore(spark, workdir + "/one", GOLDEN_STOP_WORDS).create()
    ingest_corpus(one, golden_corpus, "all")
    two = IndexStore(spark, workdir + "/two", GOLDEN_STOP_WORDS).create()
    ingest_corpus(two, golden_corpus.where("file < '/v/c'"), "x")
    ingest_corpus(two, golden_corpus, "y")
    assert snapshot(one) == snapshot(two)


def test_interrupted_ingest_invisible_then_replayed(spark, workdir, golden_corpus):
    clean = IndexStore(spark, workdir + "/clean", GOLDEN_STOP_WORDS).create()
    ingest_corpus(clean, golden_corpus, "b1")
    store = IndexStore(spark, workdir + "/crash", GOLDEN_STOP_WORDS).create()
    # A crash after the documents and postings writes, before the commit row.
    docs = ix.build_documents(golden_corpus, GOLDEN_STOP_WORDS)
    store._write_batch(docs, store._attempt("b1"))
    assert store.documents().count() == 0 and store.postings().count() == 0
    assert search(store.index(), ["ice"], 3).count() == 0
    assert ingest_corpus(store, golden_corpus, "b1") == 4
    assert snapshot(store) == snapshot(clean)


def test_new_sources_and_is_indexed(spark, golden_corpus):
    docs = ix.build_documents(golden_corpus.where("file <> '/v/d.mp4'"))
    sources = spark.createDataFrame([("/v/a.mp4",), ("/v/d.mp4",), ("/v/d.mp4",), ("/v/e.mp4",)], "file string")
    assert sorted(r["file"] for r in ix.new_sources(sources, docs).collect()) == ["/v/d.mp4", "/v/e.mp4"]
    flags = {r["file"]: r["indexed"] for r in ix.is_indexed(sources, docs).collect()}
    assert flags == {"/v/a.mp4": True, "/v/d.mp4": False, "/v/e.mp4": False}


def test_source_listing_and_extraction(spark, workdir):
    media = os.path.join(workdir, "media")
    os.makedirs(os.path.join(media, "sub"))
    for name in ["a.mp4", "g h.mp4", ".c.mp4", "e.txt", "sub/f.mp4", "_b.mp4"]:
        with open(os.path.join(media, name), "w") as fh:
            fh.write("Ice ice baby" if name == "a.mp4" else "Ice hockey")
    src = list_sources(spark, media)
    assert sorted(os.path.basename(r["file"]) for r in src.collect()) == ["a.mp4", "g h.mp4"]
    store = IndexStore(spark, workdir + "/ix").create()
    assert ingest_sources(store, src, text_file_extractor, "b1") == 2
    assert ingest_sources(store, src, text_file_extractor, "b2") == 0
    top = search(store.index(), ["baby"], 3).collect()
    assert [os.path.basename(r["file"]) for r in top] == ["a.mp4"]


def test_json_layout_roundtrip(spark, golden_index):
    exported = interchange.export_documents(golden_index.documents)
    row = {r["file"]: r for r in exported.collect()}["/v/b.mp4"]
    assert json.loads(row["termFrequencies"]) == {"ice": 2, "baby": 1}
    back = interchange.import_documents(exported)
    assert {r["file"]: r["term_frequencies"] for r in back.collect()} == \
        {r["file"]: r["term_frequencies"] for r in golden_index.documents.collect()}


def test_import_reference_style_json(spark):
    docs = spark.createDataFrame([("/v/a.mp4", "ice été", json.dumps({"ice": 1, "été": 2}), 2)],
                                 "file string, transcription string, termFrequencies string, numTerms long")
    terms = spark.createDataFrame([("ice", json.dumps(["/v/a.mp4", "/v/b.mp4"])), ("été", json.dumps(["/v/a.mp4"]))],
                                  "term string, documents string")
    assert "\\u00e9" in json.dumps({"été": 2})
    idx = interchange.import_index(docs, terms)
    assert idx.documents.first()["term_frequencies"] == {"ice": 1, "été": 2}
    assert sorted(tuple(r) for r in interchange.import_terms(terms).collect()) == [
        ("ice", "/v/a.mp4"), ("ice", "/v/b.mp4"), ("été", "/v/a.mp4")]
    assert dict(tuple(r) for r in idx.lexicon.collect()) == {"ice": 2, "été": 1}


def test_export_terms_chunks_cover_list(spark, golden_index):
    ex = interchange.export_terms(golden_index.postings, chunk_size=1)
    lists = {}
    for r in ex.collect():
        lists.setdefault(r["term"], []).extend(json.loads(r["documents"]))
    assert sorted(lists["ice"]) == ["/v/a.mp4", "/v/b.mp4"]
    assert 1 <= ex.where(F.col("term") == "ice").count() <= 2   # at most ceil(df / chunk_size) chunks


def test_compaction_switches_atomically(spark, workdir, golden_corpus):
    store = IndexStore(spark, workdir + "/ix", GOLDEN_STOP_WORDS).create()
    for i, f in enumerate(["/v/a.mp4", "/v/b.mp4", "/v/c.mp4", "/v/d.mp4"]):
        ingest_corpus(store, golden_corpus.where(F.col("file") == f), f"s{i}")
    before = snapshot(store)
    new_id = store.compact()
    assert store.committed_ids() == [new_id]
    assert snapshot(store) == before
    assert ingest_corpus(store, golden_corpus, "s1") == 0          # a replayed, compacted batch stays done
    assert sorted(store.vacuum()) == ["s0", "s1", "s2", "s3"]
    assert snapshot(store) == before
    assert store.commits().count() == 1                               # only the compaction's row is left
    assert ingest_corpus(store, golden_corpus, "s2") == 0             # a late replay adds nothing
    assert snapshot(store) == before
    assert [r["file"][-5] for r in search(store.index(), ["ice"], 3).collect()] == ["b", "a"]


def test_stop_words_fixed_at_create(spark, workdir, golden_corpus):
    IndexStore(spark, workdir + "/ix", GOLDEN_STOP_WORDS).create()
    reopened = IndexStore(spark, workdir + "/ix").create()     # no list given: the recorded one is used
    assert reopened.settings_stop_words() == GOLDEN_STOP_WORDS
    ingest_corpus(reopened, golden_corpus, "b1")
    assert dict(tuple(r) for r in reopened.lexicon().collect())["dont"] == 1


def test_extractor_runs_once_per_new_file(spark, workdir):
    media = os.path.join(workdir, "media")
    os.makedirs(media)
    for name in ["a.mp4", "b.mp4", "c.mp4"]:
        with open(os.path.join(media, name), "w") as fh:
            fh.write("ice " + name[0])
    log = os.path.join(workdir, "calls.log")

    def counting_extractor():
        def extract(path):
            with open(log, "a") as fh:
                fh.write(path + "\n")
            with open(path) as fh:
                return fh.read()
        return extract

    store = IndexStore(spark, workdir + "/ix").create()
    ingest_corpus(store, spark.createDataFrame([(os.path.join(media, "a.mp4"), "ice a")], "file string, transcript string"), "b0")
    assert ingest_sources(store, list_sources(spark, media), counting_extractor, "b1") == 2
    with open(log) as fh:
        calls = sorted(os.path.basename(x) for x in fh.read().split())
    assert calls == ["b.mp4", "c.mp4"]


def test_inventory_names(spark, workdir, golden_corpus, golden_index):
    from hearsay.operators.output import format_results
    from hearsay.sources.store import append_documents, create_index, scan_documents, scan_terms

    store = create_index(spark, workdir + "/ix", GOLDEN_STOP_WORDS)
    assert append_documents(store, golden_corpus, "b1") == 4
    assert scan_documents(store).count() == 4
    terms = {r["term"]: sorted(r["documents"]) for r in scan_terms(store).collect()}
    assert terms["ice"] == ["/v/a.mp4", "/v/b.mp4"]
    docs_json, terms_json = interchange.export_index(golden_index)
    assert docs_json.count() == 4 and terms_json.where(F.col("term") == "ice").count() == 1
    lines = [r["line"] for r in format_results(search(store.index(), ["ice"], 3)).orderBy("rank").collect()]
    assert lines == ["Score: 0.74  | File: /v/b.mp4", "Score: 0.15  | File: /v/a.mp4"]


def test_read_corpus_formats(spark, workdir):
    from hearsay.sources.corpus import read_corpus

    folder = os.path.join(workdir, "texts")
    os.makedirs(folder)
    for name, txt in GOLDEN:
        with open(os.path.join(folder, os.path.basename(name) + ".txt"), "w") as fh:
            fh.write(txt + "\n")
    texts = {os.path.basename(r["file"]): r["transcript"] for r in read_corpus(spark, folder, fmt="text").collect()}
    assert texts["b.mp4.txt"].strip() == "Ice ice baby"   # a trailing newline is whitespace either way
    spark.createDataFrame(GOLDEN, "path string, body string").write.json(os.path.join(workdir, "j"))
    js = read_corpus(spark, os.path.join(workdir, "j"), "path", "body", fmt="json")
    assert sorted(tuple(r) for r in js.collect()) == sorted(GOLDEN)


def test_hot_path_is_one_document(spark, workdir):
    # One path is a third of the incoming rows: it is indexed once.
    rows = [("/v/hot.mp4", "ice hockey")] * 40 + [(f"/v/{i:03d}.mp4", f"puck {i}") for i in range(80)]
    store = IndexStore(spark, workdir + "/ix").create()
    assert ingest_corpus(store, spark.createDataFrame(rows, "file string, transcript string"), "b1") == 81
    assert store.documents().where(F.col("file") == "/v/hot.mp4").count() == 1
    assert dict(tuple(r) for r in store.lexicon().collect())["ice"] == 1


def test_batch_with_documents_but_no_postings(spark, workdir, golden_corpus):
    store = IndexStore(spark, workdir + "/ix", GOLDEN_STOP_WORDS).create()
    assert ingest_corpus(store, golden_corpus.where(F.col("file") == "/v/c.mp4"), "only-stop-words") == 1
    assert store.postings().count() == 0 and store.lexicon().count() == 0
    assert ingest_corpus(store, golden_corpus, "rest") == 3
    assert store.documents().count() == 4
    assert [r["file"][-5] for r in search(store.index(), ["ice"], 3).collect()] == ["b", "a"]


def test_tasks_follow_the_postings_and_blocks_come_from_them(spark, workdir, monkeypatch):
    from hearsay.functions.tfidf import tf
    from hearsay.sources import store as st

    monkeypatch.setattr(st, "TASK_POSTINGS", 100, raising=False)
    monkeypatch.setattr(st, "LEAST_POSTINGS", 100, raising=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")     # what a task sorts must not depend on it
    try:
        store = st.IndexStore(spark, workdir + "/ix", stop_words=[]).create()
        rows = [(f"f{i}", "hot " * (1 + i % 5) + " ".join(f"w{i + j}" for j in range(i % 4))) for i in range(600)]
        assert store.append(spark.createDataFrame(rows, "file string, transcript string"), "b") == 600
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    index = store.index()
    postings = index.blocks.postings
    assert postings.where("term = 'hot'").select(F.input_file_name().alias("f")).distinct().count() > 1
    expected = postings.groupBy("bucket", "term", "block").agg(
        F.count(F.lit(1)).alias("n"), F.max(tf(F.col("tf_count"), F.col("num_terms"))).alias("max_tf"))
    written = index.blocks.blocks.select(*expected.columns)
    assert sorted(written.collect()) == sorted(expected.collect())
    assert store.visible_batches()[0]["n_postings"] == postings.count() == 600 + sum(i % 4 for i in range(600))


def test_an_index_tokenises_once_if_its_documents_are_written(spark, workdir, golden_corpus, golden_index):
    from hearsay.plans.index import build_index

    index = build_index(golden_corpus, GOLDEN_STOP_WORDS, scratch=workdir + "/documents")
    whole, plain = (interchange.import_index(*interchange.export_index(i)) for i in (index, golden_index))
    for table in ("documents", "postings", "lexicon"):
        columns = [c for c in getattr(plain, table).columns if c != "term_frequencies"]
        assert sorted(getattr(whole, table).select(*columns).collect()) == sorted(getattr(plain, table).select(*columns).collect())
    joined = whole.postings.join(whole.lexicon, "term")._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" not in joined


def test_lists_are_dealt_out_before_they_are_gathered(golden_index):
    view = ix.inverted_index(golden_index.postings, 1)
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_list" not in plan.split("Exchange hashpartitioning(term")[1]
    got = {}
    for r in view.collect():
        assert list(r["documents"]) == sorted(r["documents"])
        got.setdefault(r["term"], []).extend(r["documents"])
    wanted = {}
    for r in golden_index.postings.select("term", "file").collect():
        wanted.setdefault(r["term"], []).append(r["file"])
    assert {t: sorted(f) for t, f in got.items()} == {t: sorted(f) for t, f in wanted.items()}
