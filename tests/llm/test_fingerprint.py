import hashlib
import math
from collections import Counter

import numpy as np

from hearsay.llm import fingerprint as fp


PLAIN = np.append(np.arange(fp.STEPS + 1), fp.WORST)


def of(text, ranks=PLAIN):
    return fp.fingerprint(fp.chosen([(text or "").encode()], ranks)[0])


def plain_steps(data):
    """Entropy step of each window, one at a time."""
    for i in range(len(data) - fp.WINDOW + 1):
        counts = Counter(data[i:i + fp.WINDOW]).values()
        share = -sum(c / fp.WINDOW * math.log2(c / fp.WINDOW) for c in counts) / math.log2(fp.WINDOW)
        yield fp.LEFT_OUT if not fp.LEAST <= share <= fp.GREATEST else round(share * fp.STEPS)


def plain_features(data, ranks):
    """Windows with enough votes, in the order of the text."""
    if len(data) < fp.WINDOW:
        return [data] if data else []
    rank = [int(ranks[s]) for s in plain_steps(data)]
    votes = Counter()
    for i in range(len(rank)):
        best = min(range(i, min(i + fp.RUN, len(rank))), key=lambda at: (rank[at], at))
        if rank[best] < fp.WORST:
            votes[best] += 1
    return [data[i:i + fp.WINDOW] for i in sorted(i for i, n in votes.items() if n >= fp.VOTES) or [0]]


def plain_hash(window, seed):
    total = sum((byte + 1) * pow(int(fp.powers(2)[1]), i, 2**64) for i, byte in enumerate(window)) % 2**64
    return int(fp.mix(np.array([total], np.uint64), seed)[0])


def plain_fingerprint(data, ranks):
    hashes = list(dict.fromkeys(plain_hash(w, 51 if len(data) >= fp.WINDOW else len(data)) for w in plain_features(data, ranks)))
    out = b""
    for i in range(0, len(hashes), fp.MOST):
        some, bits = hashes[i:i + fp.MOST], 0
        for h in some:
            for k in range(fp.HASHES):
                bits |= 1 << (fp.BITS - 1 - ((h >> 16 * k) & (fp.BITS - 1)))
        out += len(some).to_bytes(2, "little") + bits.to_bytes(fp.BITS // 8, "big")
    return out


def test_steps_follow_the_entropy_of_each_window():
    data = ("the quick brown fox " * 5 + "aaaa" * 20 + "0123456789abcdefghijklmnopqrstuvwxyz").encode()
    for got, want in zip(fp.entropy_steps(np.frombuffer(data, np.uint8)).tolist(), plain_steps(data), strict=True):
        assert got == want or abs(got - want) <= 1


def test_ranks_count_the_windows_of_all_documents(small, spark):
    texts = [(t or "").encode() for t in small[1].values()][:40]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    counts = Counter()
    for t in texts:
        if len(t) >= fp.WINDOW:
            counts.update(fp.entropy_steps(np.frombuffer(t, np.uint8)).tolist())
    ranks = fp.count_steps(docs)
    del counts[fp.LEFT_OUT]
    order = sorted(range(fp.STEPS + 1), key=lambda s: (counts[s], s))
    assert ranks.tolist() == [*np.argsort(order).tolist(), fp.WORST]


def test_the_commonest_entropy_ranks_last_wherever_it_lies(spark):
    """Text whose windows nearly all have one entropy, near 0.80 here: the few others are the features."""
    common = "abcdefghijklmnop" * 40
    texts = [common[:300] + "Zebras quiz 17 jumpy foxes now!" + common, common, common * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ranks = fp.count_steps(docs)
    assert ranks[800] == fp.STEPS and all(s == 800 for s in plain_steps(common.encode()))
    found = plain_features(texts[0].encode(), ranks)
    assert any(b"quiz" in w for w in found)
    assert fp.fingerprint(fp.chosen([texts[0].encode()], ranks)[0]) == plain_fingerprint(texts[0].encode(), ranks)


def test_fingerprints_equal_plain_python(small, spark):
    texts = sorted({t or "" for t in small[1].values()}, key=len)
    texts = texts[:8] + texts[len(texts) // 2:len(texts) // 2 + 8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ranks = fp.count_steps(docs)
    for r in fp.fingerprints(docs).collect():
        assert bytes(r["fingerprint"]) == plain_fingerprint(texts[r["doc_id"]].encode(), ranks)


def test_features_do_not_depend_on_the_batch(small):
    texts = [(t or "").encode() for t in small[1].values()]
    for text, features in zip(texts, fp.chosen(texts, PLAIN)):
        assert features.tolist() == fp.chosen([text], PLAIN)[0].tolist()


def test_likeness():
    a, b = "the river ran slowly past old houses and quiet gardens " * 8, "completely other words about numbers and machines " * 8
    whole = " ".join(f"{a[i:i + 20]}{i}" for i in range(0, 300, 7))
    assert fp.likeness(of(a), of(a)) == 1.0 and fp.likeness(b"", b"") == 1.0 and fp.likeness(of(a), b"") == 0.0
    assert fp.likeness(of(a), of(b)) < 0.3 < fp.likeness(of(whole), of(whole[: len(whole) * 2 // 3] + b))


def brute(docs):
    ranks = fp.count_steps(docs)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        own, other, following = (of(t, ranks) for t in (text, edited, after))
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, fp.likeness(own, other), fp.likeness(own, following)))
    return sorted(out, key=str)


def check(docs):
    found = sorted(((*tuple(r)[:3], bytes(r[3]), bytes(r[4]), *tuple(r)[5:]) for r in fp.edited_likeness(docs).collect()), key=str)
    assert found == brute(docs)


def test_whole_table(small):
    check(small[0])


def test_odd_rows(odd_documents, empty_documents, spark):
    check(odd_documents)
    check(spark.createDataFrame([(5, "alone")], "doc_id long, text string"))
    assert fp.edited_likeness(empty_documents).count() == 0
