"""An index as three DataFrames: documents, postings, lexicon.

``build_index`` gives a lazy in-memory index straight from a corpus
``(file, transcript)``; ``hearsay.sources.store.IndexStore`` gives the same
object over Parquet tables that only show committed batches.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.operators import indexing as ix


BLOCK_BITS = 7      # of a stored index: a block is 2**BLOCK_BITS document numbers


def bucket_of(term: Column | str, buckets: int) -> Column:
    """The bucket that a stored index keeps a term's rows in."""
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class BlockIndex:
    """A stored index's tables by bucket of the term and block of documents.

    A document is (batch, doc); the block of its batch that holds it is ``block``.
    """
    postings: DataFrame    # (term, file, tf_count, num_terms, doc, block, bucket, batch)
    blocks: DataFrame      # (term, block, n, max_tf, bucket, batch): the greatest tf of a term in a block
    lexicon: DataFrame     # (term, df, bucket), a row per batch
    names: DataFrame       # (batch, doc, file, bucket), the bucket being the block's
    buckets: int
    n_postings: int


@dataclass(frozen=True)
class TfIdfIndex:
    documents: DataFrame   # (file, transcription, term_frequencies, num_terms)
    postings: DataFrame    # (term, file, tf_count, num_terms)
    lexicon: DataFrame     # (term, df)
    n_documents_source: DataFrame | None = None   # one row, one column: N, if known cheaper
    blocks: BlockIndex | None = None              # of a stored index

    def n_documents(self) -> Column:
        """N as a scalar subquery (empty documents count).

        A store answers from its commit rows (one per batch) instead of
        opening every documents file footer.
        """
        if self.n_documents_source is not None:
            return self.n_documents_source.scalar()
        return ix.corpus_size_col(self.documents)

    def _of_terms(self, plain: DataFrame, stored: DataFrame | None, terms: list[str]) -> DataFrame:
        named = F.col("term").isin(terms)
        if stored is None:
            return plain.where(named)
        # Literal buckets prune folders, literal terms row groups.
        found = stored.where(F.col("bucket").isin([bucket_of(F.lit(t), self.blocks.buckets) for t in terms]) & named)
        return found.select(*plain.columns)

    def postings_of(self, terms: list[str]) -> DataFrame:
        """Postings of some literal terms."""
        return self._of_terms(self.postings, self.blocks and self.blocks.postings, terms)

    def lexicon_of(self, terms: list[str]) -> DataFrame:
        found = self._of_terms(self.lexicon, self.blocks and self.blocks.lexicon, terms)
        return found.groupBy("term").agg(F.sum("df").cast("bigint").alias("df")) if self.blocks else found


def build_index(corpus: DataFrame, stop_words: Iterable[str] | None = None, scratch: str | None = None) -> TfIdfIndex:
    """Index a corpus ``(file, transcript)`` without writing anything but, if asked for, its documents.

    Each file must appear once (``hearsay.operators.indexing.new_sources``
    does that for ingest). With a new folder ``scratch`` the documents are written
    there first: transcripts are tokenised once, however many tables are used.
    """
    documents = ix.build_documents(corpus, stop_words)
    if scratch:
        documents.write.parquet(scratch)
        documents = documents.sparkSession.read.schema(documents.schema).parquet(scratch)
    postings = ix.postings_from_documents(documents)
    return TfIdfIndex(documents, postings, ix.document_frequency(postings))


def merge_indexes(old: TfIdfIndex, new: TfIdfIndex) -> TfIdfIndex:
    """U2 for whole indexes over disjoint files: unions, df re-summed per term."""
    from pyspark.sql import functions as F

    postings = ix.merge_postings(old.postings, new.postings)
    lexicon = old.lexicon.unionByName(new.lexicon).groupBy("term").agg(F.sum("df").cast("bigint").alias("df"))
    return TfIdfIndex(old.documents.unionByName(new.documents), postings, lexicon)
