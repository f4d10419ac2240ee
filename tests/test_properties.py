"""Property tests: Spark results equal a plain-Python model of the formulas.

The model follows SURVEY §0 directly (delete punctuation, lowercase, split on
whitespace, drop stop words, count; idf = log2((1+N)/(1+df)); tf over the
distinct-term count; sum over the query's distinct terms; ties by file).
"""

import math
import string
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hearsay.plans.index import build_index
from hearsay.plans.search import search, search_batch

STOP = ["the", "and", "of", "don't"]
WORDS = ["ice", "Ice", "hockey", "the", "puck!", "don't", "score", "a-b", "été", "É", "and", "x", "ice,"]
SEPS = [" ", "\n", "\t", "　", " ", "  "]


def model_index(docs):
    table = str.maketrans(dict.fromkeys(string.punctuation))
    counts = {f: Counter(t for t in text.translate(table).lower().split() if t not in STOP) for f, text in docs}
    return counts


def model_search(counts, terms, k):
    n = len(counts)
    scores, idfs = {}, {}
    for t in terms:
        holders = [f for f, c in counts.items() if t in c]
        idfs[t] = math.log2((1.0 + n) / (1.0 + len(holders))) if holders else 0.0
        for f in holders:
            scores[f] = 0.0
    for f in scores:
        for t, w in idfs.items():
            scores[f] += counts[f].get(t, 0) / len(counts[f]) * w
    ranked = sorted(scores.items(), key=lambda kv: (-round(kv[1], 9), kv[0]))
    return [(f, round(s, 9)) for f, s in ranked[:k]]


texts = st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from(SEPS)), min_size=0, max_size=8).map(
    lambda parts: "".join(w + s for w, s in parts))
corpora = st.lists(texts, min_size=1, max_size=6).map(lambda ts: [(f"/v/{i:02d}.mp4", t) for i, t in enumerate(ts)])
queries = st.lists(st.sampled_from(["ice", "hockey", "score", "dont", "été", "é", "ab", "zzz", "the", "Ice"]),
                   min_size=1, max_size=5)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(docs=corpora, terms=queries)
def test_search_equals_model(spark, docs, terms):
    idx = build_index(spark.createDataFrame(docs, "file string, transcript string"), STOP)
    got = [(r["file"], round(r["score"], 9)) for r in search(idx, terms, 3, round_to=9).orderBy("rank").collect()]
    assert got == model_search(model_index(docs), terms, 3)
    # Repeating a term or adding an unknown one changes nothing.
    again = search(idx, (terms + terms[:1])[:5] if len(terms) < 5 else terms, 3, round_to=9)
    assert [(r["file"], round(r["score"], 9)) for r in again.orderBy("rank").collect()] == got
    unknown = search(idx, terms[:4] + ["qqqq"], 3, round_to=9)
    assert [(r["file"], round(r["score"], 9)) for r in unknown.orderBy("rank").collect()] == \
        model_search(model_index(docs), terms[:4], 3)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(docs=corpora, qs=st.lists(queries, min_size=1, max_size=4))
def test_batch_equals_model(spark, docs, qs):
    idx = build_index(spark.createDataFrame(docs, "file string, transcript string"), STOP)
    table = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(qs)], "query_id string, terms array<string>")
    res = search_batch(idx, table, 2, round_to=9).collect()
    counts = model_index(docs)
    for i, q in enumerate(qs):
        got = [(r["file"], round(r["score"], 9)) for r in sorted((r for r in res if r["query_id"] == f"q{i}"),
                                                                 key=lambda r: r["rank"])]
        assert got == model_search(counts, q, 2)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(docs=corpora)
def test_documents_equal_model(spark, docs):
    idx = build_index(spark.createDataFrame(docs, "file string, transcript string"), STOP)
    got = {r["file"]: (dict(r["term_frequencies"]), r["num_terms"]) for r in idx.documents.collect()}
    assert got == {f: (dict(c), len(c)) for f, c in model_index(docs).items()}
