"""TF-IDF arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idf(n_documents: Column, document_frequency: Column) -> Column:
    """M1: ``log2((1 + N) / (1 + df))``; 0 when a term is in every document."""
    return F.log2((F.lit(1.0) + n_documents.cast("double")) / (F.lit(1.0) + document_frequency.cast("double")))


def tf(count: Column, num_terms: Column) -> Column:
    """M3: occurrences over the document's number of *distinct* kept terms.

    May exceed 1. ``try_divide`` gives NULL instead of an ANSI error for a
    zero denominator (a document with no terms is never a candidate anyway).
    """
    return F.try_divide(count.cast("double"), num_terms.cast("double"))


def tf_idf(tf_col: Column, idf_col: Column) -> Column:
    """M4: product per (document, term)."""
    return tf_col * idf_col
