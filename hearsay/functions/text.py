"""Transcript normalisation and tokenisation as native Spark expressions.

Order matters and is part of the semantics: punctuation is *deleted* (not
replaced by a space) before lowercasing, tokens split on runs of Unicode
whitespace, and stop words are tested afterwards, so ``don't`` survives as
``dont``. All of it stays JVM-side (regexp_replace / lower / split / filter).
"""

from __future__ import annotations

import string
import sys
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearsay.functions.stopwords import ENGLISH_STOP_WORDS

# The 32 ASCII punctuation characters of Python's string.punctuation.
PUNCTUATION: str = string.punctuation

# Every code point Python's str.isspace() accepts (29 of them). Java's \s knows
# only 6, so the class is spelled out; built from the rule, not typed in.
WHITESPACE: str = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())


def _char_class(chars: str, escape: str) -> str:
    return "[" + "".join(escape.format(ord(c)) for c in chars) + "]+"


def _tabled(chars: str) -> str:
    """The same class for Java, which looks up members below 256 in a table and tries all others one by one.

    Those lie behind one range, so that most characters are tried against that alone.
    """
    low, high = "".join(f"\\x{ord(c):02x}" for c in chars if ord(c) < 256), [f"\\u{ord(c):04x}" for c in chars if ord(c) >= 256]
    return f"[{low}" + (f"[{high[0]}-{high[-1]}&&[{''.join(high)}]]" if high else "") + "]+"


# Java regex (Spark) and RE2 (DuckDB) spellings of the same class.
WHITESPACE_REGEX: str = _tabled(WHITESPACE)
WHITESPACE_REGEX_RE2: str = _char_class(WHITESPACE, "\\x{{{:04x}}}")
PUNCTUATION_REGEX: str = _tabled(PUNCTUATION)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_punctuation(text: Column | str) -> Column:
    """Delete the ASCII punctuation characters; other symbols stay.

    By a regular expression: ``translate`` makes a string of each character and looks it up in a hash map.
    """
    return F.regexp_replace(_col(text), PUNCTUATION_REGEX, "")


def normalize(text: Column | str) -> Column:
    """Strip punctuation, then lowercase. This is the stored transcription."""
    return F.lower(strip_punctuation(text))


def tokenize(text: Column | str) -> Column:
    """Split on runs of Unicode whitespace, dropping empty tokens."""
    return F.filter(F.split(_col(text), WHITESPACE_REGEX), lambda t: t != "")


def remove_stop_words(tokens: Column | str, stop_words: Iterable[str] | None = None) -> Column:
    """T4: keep tokens not in ``stop_words``; order and repeats are kept.

    The list becomes an ``InSet`` (hash lookup) inside the lambda, evaluated
    per row with no join.
    """
    words = list(ENGLISH_STOP_WORDS if stop_words is None else stop_words)
    if not words:
        return _col(tokens)
    return F.filter(_col(tokens), lambda t: ~t.isin(words))


def index_tokens(text: Column | str, stop_words: Iterable[str] | None = None) -> Column:
    """T3 + T4 in one pass over the split array (one lambda, one array copy)."""
    words = list(ENGLISH_STOP_WORDS if stop_words is None else stop_words)
    parts = F.split(_col(text), WHITESPACE_REGEX)
    if not words:
        return F.filter(parts, lambda t: t != "")
    return F.filter(parts, lambda t: (t != "") & ~t.isin(words))


def path_display(path: Column | str) -> Column:
    """Backslashes become slashes, for file names shown to users."""
    return F.translate(_col(path), "\\", "/")


# Run-length encoding of a sorted token array: one struct per distinct term with
# its count, in term order. Every lambda reads only its own arguments, so the
# sorted array is computed once per row and the work is O(n log n) per document,
# with no shuffle. Each token is zipped with the one before it and its place;
# arrays_zip pads the tokens with one NULL, which marks the end of the last run.
# `st` binds the starts of the runs, so that they are found once, and each run
# ends where the next one starts.
_RUN_STARTS = (
    "filter(arrays_zip({s}, concat(array(CAST(NULL AS STRING)), {s}), sequence(0, size({s}))),"
    " p -> NOT (p.{name} <=> p.`1`))"
)
_RUNS = (
    "transform(array({starts}), st -> zip_with("
    "slice(st, 1, greatest(size(st) - 1, 0)), slice(st, 2, greatest(size(st) - 1, 0)),"
    " (r, nx) -> named_struct('term', r.{name}, 'tf_count', CAST(nx.`2` - r.`2` AS BIGINT))))[0]"
)


def term_runs(sorted_tokens_col: str) -> Column:
    """A1 in-row: ``array<struct<term, tf_count>>`` from a column of sorted tokens.

    ``sorted_tokens_col`` must name a column already holding
    ``sort_array(tokens)`` (a plain column reference keeps it from being
    recomputed inside the expression).
    """
    s = f"`{sorted_tokens_col}`"
    starts = _RUN_STARTS.format(s=s, name=s)
    return F.expr(_RUNS.format(starts=starts, name=s))
