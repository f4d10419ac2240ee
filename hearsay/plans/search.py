"""Q2 / Q3: one query or a table of queries, top-k by TF-IDF.

One query (Q2), one plan:

    postings with bucket IN (...) and term IN (...)                J3, J4
    lexicon of the same terms → df → idf (N as scalar subquery)    A6, M2
    tf·idf per posting, sum per file, TakeOrderedAndProject        M3, M4, A7, K1
    one distinct term: no sum, top-k directly                      K1

Every score of a table of queries (A7) over a stored index: postings of the query
terms are dealt out by document, then meet the queries and are summed in place.

A table of queries (Q3, K2) over an unsaved index is two plans: the idf of the
query terms is written, then term maps exploded ⋈ these, sum per (query, file),
WindowGroupLimit.

A table of queries over a stored index skips blocks of documents that cannot
reach a query's k best. Since idf is never negative, the sum of idf · greatest tf
over a query's terms bounds every score in a block from above:

    blocks ⋈ query terms (dynamic pruning by bucket) → bounds per (query, block)
    postings of the k blocks with the highest bounds → the k-th best score so far
    blocks whose bound reaches it ⋈ postings → sum per (query, document number)
    the k best of these, ties kept → their paths → the k best by (score, path)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.functions.tfidf import idf
from hearsay.operators import indexing as ix
from hearsay.operators import scoring as sc
from hearsay.plans.index import BLOCK_BITS, TfIdfIndex, bucket_of
from hearsay.session import default_parallelism, scratch_path

# The shape of a query table.
QUERY_SCHEMA = T.StructType([
    T.StructField("query_id", T.StringType(), False),
    T.StructField("terms", T.ArrayType(T.StringType(), False), False),
])


def scored_candidates(index: TfIdfIndex, queries: DataFrame, pushdown_terms: Sequence[str] | None = None,
                      scratch: str | None = None) -> DataFrame:
    """``(query_id, file, score)`` for every candidate of every query.

    For a table of queries the query terms with their idf are written to ``scratch``
    first. From their real size Spark picks the join. Over an index that is not stored
    postings meet them once, and nothing is shuffled before the sums; over a stored one
    postings are dealt out by document first, and nothing is after that.
    """
    qterms = sc.query_terms(queries)
    literal = pushdown_terms is not None
    lexicon = index.lexicon
    if literal:
        terms = sorted(set(pushdown_terms))
        postings, lexicon = index.postings_of(terms), index.lexicon_of(terms)
    elif index.blocks is not None:
        weighted = _written(_weighted(index, _bucketed(index, qterms)), f"{scratch or scratch_path(lexicon.sparkSession, 'scores')}/terms")
        return _document_sums(index, _pruning(weighted))
    else:
        # Nothing is stored by term: all of a document's terms reach the same
        # task, so the partial aggregate finishes each (query, file) sum before
        # the shuffle.
        postings = ix.postings_from_documents(index.documents.select("file", "term_frequencies", "num_terms"))
    idfs = sc.query_idf(qterms, lexicon, index.n_documents(), literal)
    if literal:
        return sc.score_documents(sc.term_tf_idf(sc.match_terms(qterms, postings, True), F.broadcast(idfs)))
    idfs = _written(idfs.where(F.col("query_id").isNotNull()),
                    f"{scratch or scratch_path(index.documents.sparkSession, 'scores')}/idfs")
    return sc.score_documents(sc.term_tf_idf(sc.match_terms(idfs, postings)))


TASK_POSTINGS = 1_500_000       # of a stored index, for each task that sums scores by document


# ---- stored index: bounds by block ---------------------------------------------

# Bounds and scores may add the same terms in another order: bounds get this much more.
SLACK = 1e-9


def _bucketed(index: TfIdfIndex, qterms: DataFrame) -> DataFrame:
    """Query terms with their bucket; no indexed term is empty."""
    return _pruning(qterms).withColumn("bucket", bucket_of("term", index.blocks.buckets))


def _weighted(index: TfIdfIndex, qterms: DataFrame) -> DataFrame:
    """``(query_id, term, bucket, idf)`` of the query terms that the index has."""
    found = index.blocks.lexicon.join(qterms, ["bucket", "term"]).groupBy("query_id", "term", "bucket").agg(F.sum("df").alias("df"))
    return found.select("query_id", "term", "bucket", idf(index.n_documents(), F.col("df")).alias("idf"))


def _written(df: DataFrame, path: str) -> DataFrame:
    """Write and read back: from the real size Spark picks the joins that follow."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _pruning(terms: DataFrame) -> DataFrame:
    """The same rows, since no term is empty; a filter tells Spark that they may prune the buckets of what they join."""
    return terms.where(F.col("term") != "")


def _sums(index: TfIdfIndex, wanted: DataFrame) -> DataFrame:
    """``(query_id, batch, doc, score)`` over the postings that ``wanted`` joins with.

    ``wanted`` has ``(query_id, term, bucket, idf)``, and ``(batch, block)`` if only some blocks are.
    """
    postings = index.blocks.postings.select("bucket", "term", "batch", "block", "doc", "tf_count", "num_terms")
    keys = [c for c in ("bucket", "term", "batch", "block") if c in wanted.columns]
    part = sc.tf_idf(sc.tf(F.col("tf_count"), F.col("num_terms")), F.col("idf"))
    return postings.join(wanted, keys).groupBy("query_id", "batch", "doc").agg(F.sum(part).alias("score"))


def _document_sums(index: TfIdfIndex, weighted: DataFrame) -> DataFrame:
    """``(query_id, file, score)`` of every document with a term of ``weighted``, ``(query_id, term, bucket, idf)``.

    A stored index's postings lie by term. Those of the query terms are dealt out by document, each once however
    many queries have its term: the pairs of query and document are made and summed where they are, without a shuffle.
    The number of tasks follows the index, so that none sums more pairs as it grows.
    """
    blocks = index.blocks
    asked = weighted.select("bucket", "term").distinct()
    postings = blocks.postings.select("bucket", "term", "batch", "doc", "file", "tf_count", "num_terms")
    tasks = max(default_parallelism(postings.sparkSession), -(-blocks.n_postings // TASK_POSTINGS))
    met = postings.join(asked, ["bucket", "term"], "left_semi").drop("bucket").repartition(tasks, "batch", "doc")
    part = sc.tf_idf(sc.tf(F.col("tf_count"), F.col("num_terms")), F.col("idf"))
    sums = met.join(weighted.select("query_id", "term", "idf"), "term").groupBy("query_id", "batch", "doc", "file").agg(F.sum(part).alias("score"))
    return sums.select("query_id", "file", "score")


def block_bounds(index: TfIdfIndex, weighted: DataFrame) -> DataFrame:
    """``(query_id, batch, block, bound, terms)``: no document of the block scores more than ``bound``.

    ``weighted`` are query terms with their idf, ``terms`` those that the block has, ``(term, bucket, idf)`` each.
    """
    met = index.blocks.blocks.select("bucket", "term", "batch", "block", "max_tf").join(weighted, ["bucket", "term"])
    return met.groupBy("query_id", "batch", "block").agg(
        (F.sum(sc.tf_idf(F.col("max_tf"), F.col("idf"))) * (1 + SLACK) + SLACK).alias("bound"),
        F.collect_list(F.struct("term", "bucket", "idf")).alias("terms"))


def block_terms(cells: DataFrame) -> DataFrame:
    """``(query_id, batch, block, term, bucket, idf)`` of rows of ``block_bounds``."""
    return cells.select("query_id", "batch", "block", F.explode("terms").alias("t")).select("query_id", "batch", "block", "t.*")


def open_blocks(index: TfIdfIndex, cells: DataFrame, k: int, round_to: int | None = None) -> DataFrame:
    """The rows of ``block_bounds`` whose block may hold one of the query's k best documents.

    The ``k`` blocks with the highest bounds are scored; the k-th best score
    there is one that the k best reach. A query with fewer scored documents
    keeps all its blocks.
    """
    first = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "batch", "block")
    leading = cells.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k).drop("place")
    score = sc.rank_key(F.col("score"), round_to)
    best = Window.partitionBy("query_id").orderBy(score.desc(), "batch", "doc")
    floors = (_sums(index, _pruning(block_terms(leading))).withColumn("place", F.row_number().over(best))
              .where(F.col("place") <= k).groupBy("query_id").agg(F.min(score).alias("floor"), F.count(F.lit(1)).alias("n")))
    known = cells.join(floors.where(F.col("n") == k).select("query_id", "floor"), "query_id", "left")
    return known.where(F.col("floor").isNull() | (sc.rank_key(F.col("bound"), round_to) >= F.col("floor"))).drop("floor")


def _search_stored(index: TfIdfIndex, queries: DataFrame, k: int, round_to: int | None, scratch: str) -> DataFrame:
    weighted = _written(_weighted(index, _bucketed(index, sc.query_terms(queries))), f"{scratch}/terms")
    cells = _written(block_bounds(index, _pruning(weighted)), f"{scratch}/bounds")
    wanted = _written(block_terms(open_blocks(index, cells, k, round_to)), f"{scratch}/open")
    scores = _sums(index, _pruning(wanted))
    # Paths order ties only: they are looked up for the documents that may be among the k best.
    w = Window.partitionBy("query_id").orderBy(sc.rank_key(F.col("score"), round_to).desc())
    tied = scores.withColumn("place", F.rank().over(w)).where(F.col("place") <= k).drop("place")
    tied = tied.withColumn("bucket", F.pmod(F.shiftright("doc", BLOCK_BITS), F.lit(index.blocks.buckets)).cast("int"))
    named = index.blocks.names.join(tied, ["bucket", "batch", "doc"])
    return sc.top_k_per_query(named.select("query_id", "file", "score"), k, round_to)


def search_batch(index: TfIdfIndex, queries: DataFrame, k: int = 3, round_to: int | None = None,
                 scratch: str | None = None) -> DataFrame:
    """Q3: top-k per query for a table ``(query_id, terms)``.

    Any number of terms per query (the socket front end's rule); queries
    with no known term produce no rows. Result ``(query_id, rank, file, score)``.
    Over a stored index the query terms, the blocks' bounds and the blocks left
    open are written to ``scratch`` first (a new folder of the checkpoint root by default); over
    another the query terms with their idf are.
    """
    if index.blocks is not None and k > 0:
        return _search_stored(index, queries, k, round_to, scratch or scratch_path(index.postings.sparkSession, "search"))
    scores = scored_candidates(index, queries, scratch=scratch)
    return sc.top_k_per_query(scores, k, round_to)


def query_frame(spark: SparkSession, terms: Sequence[str], query_id: str = "q") -> DataFrame:
    """A one-row query table for a literal list of terms (a JVM-side literal, no Python RDD)."""
    terms_col = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    return spark.range(1).select(F.lit(query_id).alias("query_id"), terms_col.alias("terms"))


def search(index: TfIdfIndex, terms: Sequence[str], k: int = 3, max_terms: int | None = 5,
           round_to: int | None = None) -> DataFrame:
    """Q2: one search, result ``(rank, file, score)`` best first.

    As at the prompt: 1 to ``max_terms`` terms, else ``ValueError`` (never
    truncated); ``max_terms=None`` lifts the limit. The terms are literals,
    so the postings and lexicon scans get ``term IN (...)`` pushed down, and those of a
    stored index read only the terms' buckets.
    """
    terms = list(terms)
    if not terms:
        raise ValueError("empty: no search terms")
    if max_terms is not None and len(terms) > max_terms:
        raise ValueError(f"too_many: {len(terms)} terms, at most {max_terms}")
    spark = index.postings.sparkSession
    queries = query_frame(spark, terms)
    if len(set(terms)) == 1:
        # One distinct term: each posting is a whole score (tf·idf), so no
        # aggregation and no shuffle; the top-k keeps k rows per task.
        return sc.top_k(_single_term_scores(index, queries, terms[0]), k, round_to)
    scores = scored_candidates(index, queries, pushdown_terms=terms)
    return sc.top_k(scores.drop("query_id"), k, round_to)


def _single_term_scores(index: TfIdfIndex, queries: DataFrame, term: str) -> DataFrame:
    qterms = sc.query_terms(queries)
    postings = index.postings_of([term])
    idfs = sc.query_idf(qterms, index.lexicon_of([term]), index.n_documents(), True).select("term", "idf")
    scored = postings.join(F.broadcast(idfs), "term")
    return scored.select("file", sc.tf_idf(sc.tf(F.col("tf_count"), F.col("num_terms")), F.col("idf")).alias("score"))
