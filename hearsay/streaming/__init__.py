"""Structured Streaming: incremental ingest, running document frequency, search of a query stream."""

from hearsay.streaming.ingest import ingest_media_stream, ingest_stream
from hearsay.streaming.frequency import (FrequencyTable, document_frequency_stream, frequency_from_index,
                                         read_frequency_state, write_frequency_updates)
from hearsay.streaming.search import search_stream

__all__ = ["FrequencyTable", "document_frequency_stream", "frequency_from_index", "ingest_media_stream", "ingest_stream",
           "read_frequency_state", "search_stream", "write_frequency_updates"]
