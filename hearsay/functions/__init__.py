"""Column expressions: text normalisation, tokens, per-document term runs, TF-IDF math."""

from hearsay.functions.stopwords import ENGLISH_STOP_WORDS
from hearsay.functions.text import (
    PUNCTUATION,
    WHITESPACE,
    normalize,
    path_display,
    remove_stop_words,
    strip_punctuation,
    term_runs,
    tokenize,
)
from hearsay.functions.tfidf import idf, tf, tf_idf

__all__ = [
    "ENGLISH_STOP_WORDS", "PUNCTUATION", "WHITESPACE", "idf", "normalize", "path_display",
    "remove_stop_words", "strip_punctuation", "term_runs", "tf", "tf_idf", "tokenize",
]
