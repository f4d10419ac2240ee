"""hearsay: index spoken-word transcripts and rank them by TF-IDF, on Spark.

The library is a set of DataFrame builders. Nothing runs until an action on
a returned DataFrame; every heavy step is a Catalyst plan (scan, project,
generate, aggregate, join, window), so it partitions across a cluster.
"""

from hearsay.plans.index import TfIdfIndex, build_index
from hearsay.plans.ingest import ingest_corpus, ingest_sources
from hearsay.plans.search import search, search_batch
from hearsay.sources.store import IndexStore, create_index

__all__ = ["IndexStore", "TfIdfIndex", "build_index", "create_index", "ingest_corpus", "ingest_sources", "search",
           "search_batch"]
