import random
import re

import numpy as np

from hearsay.llm import recompress, substrings
from hearsay.llm.substrings import Windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    seen = {}
    for i, t in rows:
        if i is not None:
            w = WORD.findall(t or "")
            for p in range(len(w) - size + 1):
                h = tuple(w[p:p + size])
                seen[h] = min(seen.get(h, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if i is not None and seen[tuple(w[p:p + size])] < i:
                gone[p:p + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def check(docs, size=50):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = sorted((tuple(r) for r in substrings.without_repeats(docs, size=size).collect()), key=str)
    assert found == brute(rows, size)


def test_whole_table(small):
    check(small[0])


def test_shared_passages_periodic_text_and_copies(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    rows = []
    for i in range(60):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 160))]
        if i % 3 == 0:
            at = rng.randint(0, len(own))
            own[at:at] = passage[:rng.choice([49, 50, 51, 70])]
        rows.append((i, " ".join(own)))
    rows += [(100, "la " * 80), (101, "la " * 60 + "lo"), (102, "la lo " * 60), (103, rows[4][1]), (104, rows[4][1])]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_odd_rows(odd_documents, empty_documents):
    check(odd_documents)
    check(odd_documents, size=3)
    assert substrings.without_repeats(empty_documents).count() == 0
    cut = substrings.cut_documents(odd_documents)
    assert cut.columns == odd_documents.columns


def test_equal_windows_have_equal_anchors():
    rng = random.Random(7)
    passage = " ".join(f"p{rng.randint(0, 99)}" for _ in range(80))
    texts = [" ".join(f"x{rng.randint(0, 9999)}" for _ in range(n)) + " " + passage + f" y{n}" for n in (0, 3, 40, 77)]
    w = Windows(texts, 50)
    names, hashes = w.anchors(), w.rolled(41)
    by_hash = {}
    for h, a in zip(hashes.tolist(), names.tolist()):
        assert by_hash.setdefault(h, a) == a
    shared = [h for h in set(hashes.tolist()) if (hashes == h).sum() == len(texts)]
    assert len(shared) == 31


def test_parse_does_not_depend_on_the_neighbouring_texts():
    w = Windows(["a b c d e f g h " * 9, "z", "q r s " * 30], 50)
    names, low, high = recompress.parse(w.hashes, w.stops)
    assert (np.diff(low) >= 0).all() and (np.diff(high) >= 0).all()
    alone = Windows(["q r s " * 30], 50)
    assert alone.anchors().tolist() == w.anchors()[w.row == 2].tolist()


def test_an_id_with_several_texts(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    rows = [(3, x), (5, x), (5, y + " e"), (9, y + " f"), (9, x + " g"), (4, None), (4, y)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))
    check(spark.createDataFrame(rows[:4], "doc_id long, text string"))
    got = {(r["doc_id"], r["n_removed"]) for r in substrings.without_repeats(spark.createDataFrame(rows[:4], "doc_id long, text string")).collect()}
    assert got == {(3, 0), (5, 60), (5, 0), (9, 60)}


def test_windows_are_known_by_both_hashes():
    pairs = [np.array([1, 1, 2, 3]), np.array([7, 8, 7, 9])]
    assert substrings._among(pairs, [np.array([1, 3, 3]), np.array([8, 9, 9])]).tolist() == [False, True, False, True]
    assert substrings._among(pairs, [np.array([], np.int64)] * 2).tolist() == [False] * 4
