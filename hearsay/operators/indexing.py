"""Index-side operators: documents, postings, counts, look-ups and merges.

Schemas (all explicit, never inferred):

* documents ``(file, transcription, term_frequencies map<string,bigint>, num_terms)``
* postings  ``(term, file, tf_count, num_terms)``, one row per (term, file)
* lexicon   ``(term, df)``, one row per term
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.functions.text import index_tokens, normalize, term_runs

DOCUMENTS_SCHEMA = T.StructType([
    T.StructField("file", T.StringType(), False),
    T.StructField("transcription", T.StringType(), True),
    T.StructField("term_frequencies", T.MapType(T.StringType(), T.LongType(), False), True),
    T.StructField("num_terms", T.LongType(), True),
])

POSTINGS_SCHEMA = T.StructType([
    T.StructField("term", T.StringType(), False),
    T.StructField("file", T.StringType(), False),
    T.StructField("tf_count", T.LongType(), False),
    T.StructField("num_terms", T.LongType(), False),
])

LEXICON_SCHEMA = T.StructType([
    T.StructField("term", T.StringType(), False),
    T.StructField("df", T.LongType(), False),
])


def rejected_documents(corpus: DataFrame) -> DataFrame:
    """``(file)`` of the sources whose only rows have no transcript; they are not indexed."""
    return corpus.groupBy("file").agg(F.count("transcript").alias("n")).where(F.col("n") == 0).select("file")


def analyze(corpus: DataFrame, stop_words: Iterable[str] | None = None) -> DataFrame:
    """Normalise each transcript and count its terms inside the row.

    Returns ``(file, transcription, runs array<struct<term, tf_count>>)`` with
    ``runs`` sorted by term. A document's tokens never leave its row: sorting
    and run-length counting replace an explode + groupBy(file, term), so no
    shuffle is needed to build the index. Null transcripts are rejected rows;
    ``rejected_documents`` names them.
    """
    words = None if stop_words is None else list(stop_words)
    normed = corpus.where(F.col("transcript").isNotNull()).select(
        "file", normalize("transcript").alias("transcription"))
    with_sorted = normed.select(
        "file", "transcription", F.sort_array(index_tokens("transcription", words)).alias("sorted_tokens"))
    return with_sorted.select("file", "transcription", term_runs("sorted_tokens").alias("runs"))


def documents_from_runs(analyzed: DataFrame) -> DataFrame:
    """S5 rows: the documents table (A2 num_terms, A3 term-frequency map)."""
    return analyzed.select(
        "file",
        "transcription",
        F.map_from_entries("runs").alias("term_frequencies"),
        F.size("runs").cast("bigint").alias("num_terms"),
    )


def build_documents(corpus: DataFrame, stop_words: Iterable[str] | None = None) -> DataFrame:
    return documents_from_runs(analyze(corpus, stop_words))


def postings_from_documents(documents: DataFrame, *more: str) -> DataFrame:
    """Long-form inverted index from the documents' term maps (no shuffle), with ``more`` of their columns.

    ``explode_outer`` + a null filter, rather than ``explode``, so Catalyst
    does not infer a ``size(map) > 0`` filter and push a copy of the whole
    tokenising expression below it.
    """
    exploded = documents.select(
        "file", "num_terms", *more, F.explode_outer("term_frequencies").alias("term", "tf_count"))
    return exploded.where(F.col("term").isNotNull()).select(
        "term", "file", F.col("tf_count").cast("bigint").alias("tf_count"),
        F.col("num_terms").cast("bigint").alias("num_terms"), *more)


def document_terms(corpus: DataFrame, stop_words: Iterable[str] | None = None) -> DataFrame:
    """T5: one row per kept token occurrence ``(file, pos, term)``, 0-based pos."""
    words = None if stop_words is None else list(stop_words)
    toks = corpus.select("file", index_tokens(normalize("transcript"), words).alias("_tokens"))
    exploded = toks.select("file", F.posexplode_outer("_tokens").alias("pos", "term"))
    return exploded.where(F.col("term").isNotNull())


def term_counts(postings: DataFrame) -> DataFrame:
    """A1: occurrences per (file, term)."""
    return postings.select("file", "term", "tf_count")


def num_terms(documents: DataFrame) -> DataFrame:
    """A2: distinct kept terms per document, 0 for an empty one."""
    return documents.select("file", "num_terms")


def term_frequency_map(documents: DataFrame) -> DataFrame:
    """A3: term → count per document, ``{}`` when empty."""
    return documents.select("file", "term_frequencies")


def corpus_size(documents: DataFrame) -> DataFrame:
    """A5: N, the number of documents, empty ones included."""
    return documents.agg(F.count(F.lit(1)).alias("n_documents"))


def corpus_size_col(documents: DataFrame) -> Column:
    """A5 as a scalar subquery column, evaluated once per query."""
    return documents.select(F.count(F.lit(1))).scalar()


def document_frequency(postings: DataFrame) -> DataFrame:
    """Df per term. Postings hold one row per (term, file), so a count.

    A hot term (in a third of all documents) is summed map-side by the
    partial aggregate; only one row per term and task crosses the shuffle.
    """
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def inverted_index(postings: DataFrame, chunk_size: int = 10_000, lexicon: DataFrame | None = None, salts: int = 64) -> DataFrame:
    """A4: term → sorted list of documents, as a view.

    A heavy term, one of more than ``chunk_size`` documents, has its list split
    into chunks of about that many files (chunk = hash(file) mod ceil(df /
    chunk_size)), so a hot term never becomes one unbounded array in one task.
    Rows: ``(term, chunk, documents)``; the union of a term's chunks is its full
    list. Heavy terms come from the lexicon (counted here if not given) and are
    few, at most a row for each ``chunk_size`` postings; only they are repeated
    for each salt, so that their postings are spread before they are chunked.
    Postings of other terms meet no row and are grouped as they are.
    """
    dfs = document_frequency(postings) if lexicon is None else lexicon
    heavy = dfs.where(F.col("df") > chunk_size).select(
        "term", F.ceil(F.col("df") / F.lit(chunk_size)).cast("bigint").alias("n_chunks"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = postings.select("term", "file", F.pmod(F.xxhash64("file", F.lit(1)), F.lit(salts)).cast("int").alias("salt"))
    keyed = salted.join(heavy, ["term", "salt"], "left").select(
        "term", "file", F.pmod(F.xxhash64("file"), F.coalesce("n_chunks", F.lit(1))).alias("chunk"))
    # Dealt out before they are gathered: collecting on the map side would sort and spill whole partitions.
    return keyed.repartition("term", "chunk").groupBy("term", "chunk").agg(
        F.sort_array(F.collect_list("file")).alias("documents"))


def is_indexed(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """``(file, indexed)`` for each distinct source path.

    An index holds each file once, so the index side needs no ``distinct``
    (no shuffle of the big side beyond the join itself).
    """
    known = documents.select("file").withColumn("indexed", F.lit(True))
    return (sources.select("file").distinct().join(known, "file", "left")
            .select("file", F.coalesce("indexed", F.lit(False)).alias("indexed")))


def new_sources(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """Paths not yet indexed, each once (first row per path is kept).

    ``dropDuplicates`` is a partial aggregate, so a path repeated millions of
    times is collapsed map-side; the anti-join shuffles both sides on
    ``file`` unless AQE sees a small side.
    """
    return sources.dropDuplicates(["file"]).join(documents.select("file"), "file", "left_anti")


def lookup_term(postings: DataFrame, term: str) -> DataFrame:
    """Postings of one term, exact and case-sensitive; pushed to the scan."""
    return postings.where(F.col("term") == F.lit(term))


def lookup_documents(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Term map and num_terms of the given files (semi-join: repeats in ``files`` are harmless)."""
    return documents.join(files.select("file"), "file", "left_semi").select(
        "file", "term_frequencies", "num_terms")


def lookup_document(documents: DataFrame, file: str) -> DataFrame:
    """J5 for one path: a pushed-down equality filter."""
    return documents.where(F.col("file") == F.lit(file)).select("file", "term_frequencies", "num_terms")


def merge_postings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Add documents to the index. Long form needs no row update: a union."""
    return old.unionByName(new)
