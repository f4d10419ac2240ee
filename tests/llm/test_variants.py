import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from hearsay.llm import variants
from hearsay.llm.queries import op12_spelling_variants


def near(a, b):
    """Exactly one inserted, deleted or replaced code point, from the definition."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(counts, ratio=10):
    cut = defaultdict(set)      # words by what is left without one letter, or with one masked
    for w in counts:
        for i in range(len(w)):
            cut["-", w[:i] + w[i + 1:]].add(w)
            cut["?", w[:i] + "\0" + w[i + 1:]].add(w)
    out, form = {}, {}
    for w in counts:
        close = {v for i in range(len(w)) for v in cut["?", w[:i] + "\0" + w[i + 1:]]} | cut["-", w]
        close |= {w[:i] + w[i + 1:] for i in range(len(w)) if w[:i] + w[i + 1:] in counts}
        close = {v for v in close if v != w}
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
        out[w] = (counts[w], len(close), counts[best] if form[w] else None)
    def root(w):
        return root(form[w]) if form[w] else w
    return {(w, form[w], root(w), n, m, f) for w, (n, m, f) in out.items()}


def grouped(spark, counts):
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    rows = variants.spelling_variants(words).collect()
    assert len(rows) == len(counts)
    return {tuple(r) for r in rows}


def random_words(seed, n, letters, low, high):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)}
    return {w: rng.choice((2, 3, 20, 25, 300, 4000)) for w in sorted(words)}


@pytest.mark.parametrize("letters", ["ab", "abn", "aeiorstn", "abcdefghijklmnopqrstuvwxyzÀßéÿ×"])
def test_equal_to_brute_force(spark, letters):
    counts = random_words(len(letters), 1500, letters, 1, 9)
    assert grouped(spark, counts) == brute(counts)


@pytest.mark.parametrize("node_words", [1, 40])
def test_deep_and_split_cells_change_nothing(spark, monkeypatch, node_words):
    counts = random_words(3, 250, "abcn", 3, 7)     # a and n fall into one group
    monkeypatch.setattr(variants, "NODE_WORDS", node_words)
    monkeypatch.setattr(variants, "LEAF", 2)
    monkeypatch.setattr(variants, "ASKERS", 30)
    assert grouped(spark, counts) == brute(counts)


def test_ties_chains_and_long_words(spark):
    long = "x" * 20000
    counts = {"aaaaaaa": 5000, "aaaaaab": 500, "aaaaabb": 50, "aaaabbb": 5, "zzzzzzy": 100, "zzzzzza": 100, "zzzzzzz": 3,
              long: 2, long + "y": 30, "alone" * 2: 9}
    got = {r[0]: r for r in grouped(spark, counts)}
    assert set(got.values()) == brute(counts)
    assert got["aaaabbb"][1:3] == ("aaaaabb", "aaaaaaa") and got["zzzzzzz"][1] == "zzzzzza" and got[long][1] == long + "y"


def test_a_word_near_to_very_many(spark):
    counts = {"abcdefghij": 10**6} | {w: 2 for i in range(10) for c in "abcdefghijklmnopqrstuvwxyz"
                                      if (w := "abcdefghij"[:i] + c + "abcdefghij"[i:]) != "abcdefghij"}
    assert grouped(spark, counts) == brute(counts)


def test_runs_and_counts(spark, empty_documents, odd_documents):
    docs = spark.createDataFrame([(1, "The THE Ünder×ÿ é1abc-ABC \u0100bc"), (None, None), (2, "")], "doc_id long, text string")
    assert sorted(r["run"] for r in variants.letter_runs(docs).collect()) == sorted(["the", "the", "Ünder×ÿ", "é", "abc", "abc", "bc"])
    assert variants.spelling_variants(variants.word_counts(variants.letter_runs(empty_documents).selectExpr("run word"))).count() == 0
    assert variants.spelling_variants(variants.word_counts(variants.letter_runs(odd_documents).selectExpr("run word"), 1, 1)).count() > 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    counts = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", r["text"] or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{r['doc_id']}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    rows = [tuple(r) for r in op12_spelling_variants(spark, sf).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(words) and set(rows) == brute(words)
