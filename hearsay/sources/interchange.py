"""The JSON-in-text table layout (term map and document list as text).

``export_*`` writes typed columns as JSON text, ``import_*`` reads that
layout (including text written by other tools, with spaces or ``\\u``
escapes) back into typed columns. Both are per-row expressions, except the
document lists of ``export_terms``, which come chunked from
``inverted_index`` so no term's list becomes one unbounded row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.operators import indexing as ix
from hearsay.plans.index import TfIdfIndex


def export_documents(documents: DataFrame) -> DataFrame:
    """Documents as ``(file, transcription, termFrequencies, numTerms)`` text columns."""
    return documents.select(
        "file", "transcription",
        F.to_json("term_frequencies").alias("termFrequencies"),
        F.col("num_terms").cast("bigint").alias("numTerms"))


def export_terms(postings: DataFrame, chunk_size: int = 10_000) -> DataFrame:
    """Terms as ``(term, chunk, documents)`` with ``documents`` a JSON array."""
    view = ix.inverted_index(postings, chunk_size)
    return view.select("term", "chunk", F.to_json("documents").alias("documents"))


def import_documents(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("file").cast("string").alias("file"),
        F.col("transcription").cast("string").alias("transcription"),
        F.from_json("termFrequencies", "map<string,bigint>").alias("term_frequencies"),
        F.col("numTerms").cast("bigint").alias("num_terms"))


def import_terms(df: DataFrame) -> DataFrame:
    """Long form ``(term, file)`` from rows of ``(term, documents JSON array)``."""
    files = df.select("term", F.explode_outer(F.from_json("documents", "array<string>")).alias("file"))
    return files.where(F.col("file").isNotNull())


def import_index(documents_json: DataFrame, terms_json: DataFrame) -> TfIdfIndex:
    """A searchable index from the JSON-text layout: tf from documents, df from terms."""
    documents = import_documents(documents_json)
    postings = ix.postings_from_documents(documents)
    lexicon = import_terms(terms_json).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return TfIdfIndex(documents, postings, lexicon)


def export_index(index: TfIdfIndex, chunk_size: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Both tables in the JSON-text layout: ``(documents, terms)``."""
    return export_documents(index.documents), export_terms(index.postings, chunk_size)
