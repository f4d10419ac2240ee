"""Search of a stored index: bounds by block, buckets of terms."""

import random

import pytest
from pyspark.sql import functions as F

from hearsay.operators import scoring as sc
from hearsay.plans import search as S
from hearsay.plans.index import build_index
from hearsay.plans.ingest import ingest_corpus
from hearsay.plans.search import QUERY_SCHEMA, scored_candidates, search, search_batch
from hearsay.sources.store import IndexStore

CORPUS = "file string, transcript string"


def random_corpus(seed, n):
    """Zipf-like words, lengths from nothing to long, groups of equal texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    texts = [" ".join(rng.choices(words, weights, k=rng.choice((0, 1, 3, 10, 40, 200)))) for _ in range(n)]
    return [(f"/{i % 7}/f{i:05d}", texts[i - i % 3] if i % 5 == 0 else texts[i]) for i in range(n)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = random_corpus(1, 900)
    corpus = spark.createDataFrame(rows, CORPUS).repartition(2)
    store = IndexStore(spark, str(tmp_path_factory.mktemp("stored")), [], term_buckets=16).create()
    ingest_corpus(store, corpus.where("file < '/3'"), "a")
    ingest_corpus(store, corpus.where("file >= '/3'"), "b")
    return store.index(), build_index(corpus, [])


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(2)
    rows = [(f"q{i}", [f"w{rng.randrange(70)}" for _ in range(rng.choice((1, 2, 5, 20)))]) for i in range(40)]
    rows += [("none", ["absent"]), ("empty", []), ("blank", [""]), ("all", [f"w{i}" for i in range(60)])]
    return spark.createDataFrame(rows, QUERY_SCHEMA)


def answers(df):
    return {(r["query_id"], r["rank"]): (r["file"], round(r["score"], 6)) for r in df.collect()}


@pytest.mark.parametrize("k,round_to", [(1, None), (3, 6), (3, 1), (50, 6), (2000, 6)])
def test_stored_search_equals_the_plain_one(stored, queries, k, round_to):
    index, plain = stored
    # Rounded, so that the order of summing decides no tie.
    got, want = (answers(search_batch(i, queries, k, round_to=6 if round_to is None else round_to)) for i in (index, plain))
    assert got == want


def test_all_scores_of_a_stored_index(stored, queries):
    index, plain = stored
    got, want = ({(r[0], r[1]): round(r[2], 9) for r in scored_candidates(i, queries).collect()} for i in (index, plain))
    assert got == want


def test_pairs_of_query_and_document_are_not_shuffled(stored, queries):
    """A posting is dealt out by its document before it meets the queries; nothing is shuffled by pair."""
    scores = scored_candidates(stored[0], queries)
    assert scores.count()
    p = scores._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(batch" in p and "hashpartitioning(query_id" not in p
    assert "paths" not in "".join(scores.inputFiles())


def test_blocks_that_cannot_reach_the_best_are_skipped(stored, queries, workdir):
    index, _ = stored
    weighted = S._written(S._weighted(index, S._bucketed(index, sc.query_terms(queries))), workdir + "/terms")
    cells = S._written(S.block_bounds(index, weighted), workdir + "/cells")
    wide = cells.join(queries.where(F.size("terms") > 1).select("query_id"), "query_id", "left_semi")
    left = S.open_blocks(index, wide, 3, 6)
    assert 0 < left.count() < wide.count()
    # No document scores above its block's bound, and every one of the best lies in a block left open.
    scores = S._sums(index, S.block_terms(cells)).withColumn("block", F.shiftright("doc", 7))
    over = scores.join(cells, ["query_id", "batch", "block"]).where(F.col("score") > F.col("bound"))
    assert over.count() == 0


def test_buckets_are_pruned(stored, queries):
    index, _ = stored
    plan = search(index, ["w1", "w5"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket), ", "") and "In(term" in plan
    batch = search_batch(index, queries.limit(2), 3)
    batch.collect()
    plan = batch._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "term_frequencies" not in plan and "transcription" not in plan


def test_no_path_in_the_exchange_of_pairs(stored, queries):
    index, _ = stored
    plan = search_batch(index, queries, 3)._jdf.queryExecution().executedPlan().toString()
    sums = [line for line in plan.splitlines() if "HashAggregate" in line and "sum(" in line]
    assert sums and not any("file#" in line for line in sums)


def test_empty_index_and_batches_without_terms(spark, workdir, queries):
    store = IndexStore(spark, workdir + "/ix").create()
    assert search_batch(store.index(), queries, 3).count() == 0
    ingest_corpus(store, spark.createDataFrame([("a", ""), ("b", " ")], CORPUS), "blank")
    assert search_batch(store.index(), queries, 3).count() == 0 and search(store.index(), ["w1"], 3).count() == 0
    ingest_corpus(store, spark.createDataFrame([("c", "w1 w2")], CORPUS), "one")
    assert [r["file"] for r in search_batch(store.index(), queries.where("query_id = 'all'"), 3).collect()] == ["c"]
    assert store.index().documents.count() == 3
