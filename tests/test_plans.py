"""Physical plan shape: the operators the design relies on are really chosen."""

from pyspark.sql import functions as F

from hearsay.plans.ingest import ingest_corpus
from hearsay.plans.search import search, search_batch
from hearsay.sources.store import IndexStore

from conftest import GOLDEN


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def test_single_search_plan(spark, workdir):
    store = IndexStore(spark, workdir + "/ix").create()
    ingest_corpus(store, spark.createDataFrame(GOLDEN, "file string, transcript string"), "b")
    p = plan(search(store.index(), ["ice", "score"], 3))
    assert "TakeOrderedAndProject" in p
    assert "BroadcastHashJoin" in p
    assert "PushedFilters: [In(term, [ice,score])" in p or "In(term, [ice,score])" in p
    assert "BatchEvalPython" not in p and "MapInPandas" not in p and "ArrowEvalPython" not in p


def test_batch_search_plan(spark, golden_index):
    queries = spark.createDataFrame([("q1", ["ice"]), ("q2", ["score"])], "query_id string, terms array<string>")
    p = plan(search_batch(golden_index, queries, 3))
    assert "WindowGroupLimit" in p and "Partial" in p
    assert "BatchEvalPython" not in p and "MapInPandas" not in p


def test_index_build_has_no_shuffle(spark, golden_index):
    p = golden_index.documents._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in p
    assert "Exchange" not in golden_index.postings._jdf.queryExecution().executedPlan().toString()


def test_postings_scan_prunes_columns(spark, workdir):
    store = IndexStore(spark, workdir + "/ix").create()
    ingest_corpus(store, spark.createDataFrame(GOLDEN, "file string, transcript string"), "b")
    p = plan(store.postings().where(F.col("term") == "ice").select("file"))
    assert "ReadSchema: struct<term:string,file:string>" in p


def test_hot_term_spreads_over_postings_files(spark, workdir):
    # "hot" is in every document: ranging on (term, file) must not put all of
    # its postings into one file / task.
    rows = [(f"/v/{i:04d}.mp4", f"hot word{i} other{i % 7}") for i in range(400)]
    store = IndexStore(spark, workdir + "/ix", stop_words=[], postings_partitions=8).create()
    ingest_corpus(store, spark.createDataFrame(rows, "file string, transcript string"), "b")
    hot = store.postings().where(F.col("term") == "hot").select(F.input_file_name().alias("f"))
    assert hot.count() == 400
    assert hot.distinct().count() > 1


def test_single_term_search_has_no_shuffle_of_postings(spark, workdir):
    store = IndexStore(spark, workdir + "/ix").create()
    ingest_corpus(store, spark.createDataFrame(GOLDEN, "file string, transcript string"), "b")
    p = search(store.index(), ["ice", "ice"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in p
    main = p.split("Subquery")[0]
    assert "Exchange hashpartitioning(file" not in main


def test_a_table_of_queries_meets_the_postings_once(spark, golden_index):
    """The idf comes with the query's terms: one join, and none before the sums that shuffles matched postings."""
    queries = spark.createDataFrame([("q", ["ice", "puck"]), (None, ["ice"])], "query_id string, terms array<string>")
    found = search_batch(golden_index, queries, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert {r["query_id"] for r in found.collect()} == {"q"}
