"""Query-side operators: term matching, IDF, TF-IDF scores and top-k.

A query table is ``(query_id, terms array<string>)``. Query terms are used
as given: exact, case-sensitive equality with indexed terms; a repeated
term counts once; an unknown term has idf 0 and adds no candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.functions.text import index_tokens, normalize
from hearsay.functions.tfidf import idf, tf, tf_idf  # noqa: F401  (re-exported for plans)

# C-locale blanks (what stream extraction of a typed line stops at): Java's \s.
_ASCII_BLANKS = r"\s+"


def parse_query(line: Column | str, max_terms: int | None = 5, normalize_terms: bool = False) -> Column:
    """Q1: ``struct<terms array<string>, status string>`` from a typed line.

    status is ``empty`` (no terms), ``too_many`` (more than ``max_terms``;
    the search is refused, never truncated) or ``ok``. ``max_terms=None``
    accepts any number, as the socket front end does. With
    ``normalize_terms`` the line goes through the index's normalisation
    first (an opt-in; the default keeps the terms as typed).
    """
    c = F.col(line) if isinstance(line, str) else line
    if normalize_terms:
        terms = index_tokens(normalize(c), stop_words=[])
    else:
        terms = F.filter(F.split(c, _ASCII_BLANKS), lambda t: t != "")
    terms = F.coalesce(terms, F.array().cast("array<string>"))      # a null line has no terms
    n = F.size(terms)
    status = F.when(n == 0, F.lit("empty"))
    if max_terms is not None:
        status = status.when(n > F.lit(max_terms), F.lit("too_many"))
    status = status.otherwise(F.lit("ok"))
    return F.struct(terms.alias("terms"), status.alias("status"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, term)``, each distinct term of each query once.

    A query sent again counts once; different queries under one id count as
    one query with the terms of both.
    """
    exploded = queries.select("query_id", F.explode_outer(F.array_distinct("terms")).alias("term"))
    return exploded.where(F.col("term").isNotNull()).distinct()


def match_terms(qterms: DataFrame, postings: DataFrame, literal_query: bool = False) -> DataFrame:
    """Postings of every query term ``(query_id, term, file, tf_count, num_terms)``.

    ``literal_query`` says that the terms are those of one call, which are
    broadcast. For a query table AQE picks the join from its real size.
    An ``idf`` of the query terms (``query_idf``) is carried along.
    """
    q = F.broadcast(qterms) if literal_query else qterms
    more = [c for c in ("idf",) if c in qterms.columns]
    return postings.join(q, "term").select("query_id", "term", "file", "tf_count", "num_terms", *more)


def query_idf(qterms: DataFrame, lexicon: DataFrame, n_documents: Column, literal_query: bool = False) -> DataFrame:
    """M2: ``(query_id, term, df, idf)``; a term absent from the corpus gets 0.0."""
    wanted = qterms.select("term").distinct()
    w = F.broadcast(wanted) if literal_query else wanted
    dfs = lexicon.join(w, "term", "left_semi")
    joined = qterms.join(dfs, "term", "left")
    return joined.select(
        "query_id", "term",
        F.coalesce(F.col("df"), F.lit(0)).cast("bigint").alias("df"),
        F.when(F.col("df").isNull(), F.lit(0.0)).otherwise(idf(n_documents, F.col("df"))).alias("idf"),
    )


def term_tf_idf(matched: DataFrame, idfs: DataFrame | None = None) -> DataFrame:
    """M3 + M4 per matched posting: ``(query_id, file, term, tf, idf, tf_idf)``.

    ``idfs`` holds one row per (query, term); without it ``matched`` has the idf already.
    """
    j = matched if idfs is None else matched.join(idfs.select("query_id", "term", "idf"), ["query_id", "term"])
    t = tf(F.col("tf_count"), F.col("num_terms"))
    return j.select("query_id", "file", "term", t.alias("tf"), "idf", tf_idf(t, F.col("idf")).alias("tf_idf"))


def candidate_documents(matched: DataFrame) -> DataFrame:
    """Union of the terms' document lists per query (no score filter, G8)."""
    return matched.select("query_id", "file").distinct()


def score_documents(scored_terms: DataFrame) -> DataFrame:
    """Sum of tf·idf over the query's distinct terms, per (query, file).

    Shuffles on (query_id, file): even a query matching a third of the
    corpus spreads over all partitions; the partial sum runs map-side.
    """
    return scored_terms.groupBy("query_id", "file").agg(F.sum("tf_idf").alias("score"))


def query_term_frequencies(matched: DataFrame, candidates: DataFrame, qterms: DataFrame) -> DataFrame:
    """Count of each query term in each candidate document, 0 when absent.

    Dense form: one row per (query, candidate, query term). Counts come from
    the matched postings, so no document's term map is moved or searched.
    Only these and the candidates are shuffled, with the place of their term
    in the query: a candidate's rows are sorted by place, after one for the
    candidate itself, and each is followed by the zeros up to the next, which
    are read off the query's terms last of all.
    """
    keys = ["query_id", "file"]
    # Sorted, so that a term has the same place wherever the list is made.
    terms = qterms.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term"))).alias("terms"))
    places = terms.select("query_id", F.posexplode("terms").alias("place", "t")).select("query_id", "place", "t.term")
    counted = matched.where(F.col("file").isNotNull()).join(places, ["query_id", "term"]).select(
        *keys, "place", F.col("tf_count").cast("bigint").alias("tf_count"), F.lit(0).alias("asked"))
    asked = candidates.select(*keys, F.lit(-1).alias("place"), F.lit(None).cast("bigint").alias("tf_count"), F.lit(1).alias("asked"))
    within = Window.partitionBy(*keys).orderBy("place")
    # A candidate's own rows come first: all others see how often it was asked for.
    met = counted.union(asked).withColumns({
        "next": F.lead("place").over(within),
        "asked": F.sum("asked").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"),
    }).where(F.col("asked") > 0)
    counts, end = F.col("place") >= 0, F.coalesce("next", F.size("terms"))
    # Of rows of one place the last is followed by the zeros.
    length = F.when(counts, F.greatest(end - F.col("place"), F.lit(1))).otherwise(F.greatest(end, F.lit(0)))
    held = met.join(terms, "query_id").select(
        *keys, "tf_count", "asked", counts.alias("counts"), length.alias("length"),
        F.slice("terms", F.when(counts, F.col("place") + 1).otherwise(1), length).alias("row"))
    often = F.when(F.col("asked") == 1, F.col("row")).otherwise(F.flatten(F.array_repeat("row", F.col("asked"))))
    dense = held.select(*keys, "tf_count", "counts", "length", F.posexplode(often).alias("n", "t"))
    own = F.col("counts") & (F.pmod("n", "length") == 0)
    return dense.select(*keys, "t.term", F.when(own, F.col("tf_count")).otherwise(F.lit(0).cast("bigint")).alias("tf_count"))


def rank_key(score: Column, round_to: int | None) -> Column:
    """What scores are ranked by: the score, rounded if asked for."""
    return F.round(score, round_to) if round_to is not None else score


def top_k(scores: DataFrame, k: int = 3, round_to: int | None = None) -> DataFrame:
    """K1: the k best ``(rank, file, score)``, best first, ties by file.

    ``orderBy(...).limit(k)`` plans as ``TakeOrderedAndProject``: a bounded
    heap per task, k rows per task to the final merge.
    """
    if k <= 0:
        return scores.select(F.lit(1).alias("rank"), "file", "score").limit(0)
    key = rank_key(F.col("score"), round_to)
    best = scores.orderBy(key.desc(), F.col("file").asc()).limit(k)
    w = Window.orderBy(rank_key(F.col("score"), round_to).desc(), F.col("file").asc())
    # k rows at most: the window runs over the already-limited set.
    return best.select(F.row_number().over(w).alias("rank"), "file", "score")


def top_k_per_query(scores: DataFrame, k: int = 3, round_to: int | None = None) -> DataFrame:
    """K2: the k best per query, ``(query_id, rank, file, score)``.

    ``row_number() <= k`` plans as ``WindowGroupLimit``: a partial limit
    before the shuffle keeps at most k rows per query and task, so a query
    with millions of candidates moves k rows per task, not millions.
    """
    if k <= 0:
        return scores.select("query_id", F.lit(1).alias("rank"), "file", "score").limit(0)
    w = Window.partitionBy("query_id").orderBy(rank_key(F.col("score"), round_to).desc(), F.col("file").asc())
    ranked = scores.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "file", "score")
