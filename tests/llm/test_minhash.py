import random
import re

import numpy as np

from hearsay.llm import minhash
from hearsay.llm.components import connected_components
from hearsay.llm.wordhash import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(texts, size):
    """Smallest reachable id of each id, by comparing all pairs."""
    sets = {i: shingle_set(t, size) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def check(docs, texts, size):
    rows = minhash.near_duplicates(docs, size=size).collect()
    want = brute(texts, size)
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_components_match_all_pairs(small):
    check(*small, 4)


def test_families_of_near_copies(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    texts, n = {}, 0
    for family in range(4):
        base = [rng.choice(vocabulary) for _ in range(150)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts[n] = " ".join(copy)
            n += 1
    check(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts, 4)


def test_odd_rows(odd_documents, empty_documents):
    texts = {r["doc_id"]: r["text"] for r in odd_documents.collect() if r["doc_id"] is not None}
    check(odd_documents, texts, 5)
    assert minhash.near_duplicates(empty_documents).count() == 0
    kept = minhash.keep_documents(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and None in ids


def test_signature_is_dense_and_follows_similarity():
    rng = np.random.default_rng(1)
    whole = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64) * np.uint64(2))
    for n in (1, 2, 5, 40, 300):
        values = minhash.signature(np.sort(whole[:n]))
        assert len(values) == minhash.BINS and np.isin(values, whole[:n]).all()
    a, b = np.sort(whole[:360]), np.sort(whole[40:400])
    same = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(same - 320 / 400) < 0.12


def test_word_hashes_split_and_fold_like_the_pattern():
    hashes, ends = words(["A b\x0bC", "", "a  B c", "é É"], lower=True)
    assert ends.tolist() == [3, 3, 6, 8]
    assert hashes[:3].tolist() == hashes[3:6].tolist() and hashes[6] != hashes[7]


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(7, 7), (None, 3)]
    found = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert found == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_an_id_with_several_texts(spark):
    x, y, z, w = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyzw")
    rows = [(3, x), (4, y), (5, x), (5, y), (5, None), (7, z), (8, w), (9, z), (9, w + " more"), (6, ""), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in minhash.near_duplicates(docs, size=4).collect():
        got.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert got == {3: {3}, 4: {3}, 5: {3}, 6: {6}, 7: {7}, 8: {7}, 9: {7}}
    kept = minhash.keep_documents(docs, size=4).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == [(3, x), (6, ""), (7, z), (7, None)]


def test_no_text_of_a_kept_id_is_lost(spark):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "xyz"]
    docs = spark.createDataFrame([(1, t, "en") for t in texts] + [(1, texts[0], "en"), (2, texts[1], "en")], "doc_id long, text string, lang string")
    assert sorted((r["doc_id"], r["text"]) for r in minhash.keep_documents(docs, size=4).collect()) == sorted((1, t) for t in texts)


def test_empty_rows_link_nothing(spark):
    """Two ids whose texts meet in a bucket but are not alike enough, and that both have rows without words."""
    a = [f"w{i}" for i in range(200)]
    b = a[:150] + [f"v{i}" for i in range(50)]
    rows = [(1, " ".join(a)), (1, ""), (1, None), (2, " ".join(b)), (2, " "), (2, None)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(1, 1), (2, 2)}
