import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from hearsay.llm import packing
from hearsay.llm.queries import WORD_TOKENIZER

PATH = public_tokenizers.path(WORD_TOKENIZER)


def best_sum(counts, room):
    sums = {0}
    for length, n in counts.items():
        for _ in range(n):
            sums |= {s + length for s in sums if s + length <= room}
    return max(sums)


def test_fullest_combination_matches_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 60)
        use = packing.fullest(counts, sorted(counts, reverse=True), room)
        assert all(n <= counts[length] for length, n in use.items())
        assert sum(length * n for length, n in use.items()) == best_sum(counts, room)


def test_combinations_use_up_every_piece():
    rng = random.Random(2)
    counts = Counter(rng.randint(1, 64) for _ in range(3000))
    found = packing.combinations(dict(counts), 64)
    used = Counter()
    for times, use in found:
        assert sum(length * n for length, n in use.items()) <= 64
        for length, n in use.items():
            used[length] += n * times
    assert used == counts
    total = sum(length * n for length, n in counts.items())
    assert sum(times for times, _ in found) <= 1.02 * total / 64 + 1
    assert packing.combinations({}) == []
    with pytest.raises(ValueError):
        packing.combinations({70: 1}, 64)


def check_packed(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_documents_are_cut_and_packed_whole(odd_documents, empty_documents):
    import numpy as np
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    capacity = 64
    rows = packing.pack_documents(odd_documents, PATH, capacity=capacity).collect()
    want = Counter()
    for r in odd_documents.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            want[r["doc_id"], k, at, tuple(ids[at:at + capacity])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows) == want
    assert all(r["length"] == len(r["ids"]) // 4 for r in rows)
    assert check_packed(rows, capacity) <= -(-sum(r["length"] for r in rows) // capacity) + 1
    assert packing.pack_documents(empty_documents, PATH).count() == 0


def test_whole_table_reaches_the_lower_bound(small):
    docs, _ = small
    rows = packing.pack(packing.token_pieces(docs, PATH).drop("ids")).collect()
    assert check_packed(rows, 4096) <= -(-sum(r["length"] for r in rows) // 4096) + 1
