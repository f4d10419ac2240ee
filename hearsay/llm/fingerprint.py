"""Document fingerprints from improbable features (operator 9).

A feature is a window of ``WINDOW`` bytes. Its rank is how rare its entropy is:
one aggregation counts the windows of all documents by entropy, in ``STEPS``
steps, and the fewer windows share a window's step, the better it ranks; of steps
as rare the lower is better. Windows of very low entropy (padding) and of very
high entropy (noise, tables) say little and are left out. In every run of ``RUN`` neighbouring windows the
one of best rank, the leftmost of equals, gets a vote, and windows with
``VOTES`` votes are the document's features. Each is hashed into a Bloom filter
of ``BITS`` bits; a filter takes ``MOST`` features and then a next one is
chained to it.

Two fingerprints are compared filter by filter. For a pair of filters the bits
they share are set against the bits that chance would have them share and the
most that they could share. Each filter of the shorter chain takes its best
match in the longer, and the mean of these, weighted by features, is the
likeness, from 0 to 1.

Rows: null and empty texts have the empty fingerprint; two empty fingerprints
are alike (1), an empty one and another are not (0). A text shorter than a
window is one feature. Equal texts have equal fingerprints, and so likeness 1.
Repeated rows give repeated results. Very long texts give long chains, and are
read in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
import math
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.tasks import map_arrow, text_slices
from hearsay.llm.wordhash import mix, powers

WINDOW = 32
RUN = 32
VOTES = 8
BITS = 1024
HASHES = 4
MOST = 96
STEPS = 1000                # of entropy, as a share of the greatest
LEAST, GREATEST = 0.30, 0.985
LEFT_OUT = STEPS + 1        # in place of a step
WORST = 1 << 20
BLOCK = 1 << 20


@lru_cache(maxsize=1)
def _steps() -> np.ndarray:
    """Change of the sum of c log c when a byte's count goes from c to c + 1."""
    c = np.arange(WINDOW + 2, dtype=np.float64)
    g = np.where(c > 0, c * np.log2(np.maximum(c, 1)), 0.0)
    return np.round(np.diff(g) * (1 << 20)).astype(np.int64)


def _earlier(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each byte's value occurs in the ``WINDOW - 1`` bytes before it and after it."""
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for step in range(1, min(WINDOW, len(data))):
        same = (data[step:] == data[:-step]).view(np.uint8)
        before[step:] += same
        after[:-step] += same
    return before, after


def entropy_steps(data: np.ndarray) -> np.ndarray:
    """Step of the entropy of the window at each byte; ``LEFT_OUT`` for those too low or too high."""
    n = len(data) - WINDOW + 1
    before, after = _earlier(data)
    steps = _steps()
    # Sum of c log c over the window that ends at a byte: what came in less what went out.
    came = np.cumsum(steps[before])
    went = np.cumsum(steps[after])
    total = came[WINDOW - 1:].copy()
    total[1:] -= went[:n - 1]
    entropy = np.log2(WINDOW) - total / (WINDOW * float(1 << 20))
    share = entropy / np.log2(WINDOW)
    step = np.round(share * STEPS).astype(np.int64)
    step[(share < LEAST) | (share > GREATEST)] = LEFT_OUT
    return step


def ranks_of(counts: dict[int, int]) -> np.ndarray:
    """Rank of each step, lower is better, from the numbers of windows; the last is that of windows left out."""
    found = np.zeros(STEPS + 1, np.int64)
    for step, n in counts.items():
        if step != LEFT_OUT:
            found[step] = n
    ranks = np.full(STEPS + 2, WORST, np.int64)
    ranks[np.argsort(found, kind="stable")] = np.arange(STEPS + 1)
    return ranks


def count_steps(docs: DataFrame, text: str = "text") -> np.ndarray:
    """``ranks_of`` the windows of all documents; at most ``STEPS + 2`` numbers come to the driver."""

    def run(batches):
        found = np.zeros(STEPS + 2, np.int64)
        for part in text_slices(batches, max_bytes=BLOCK):
            texts = [t for t in ((t or "").encode() for t in part.column(0).to_pylist()) if len(t) >= WINDOW]
            if texts:
                data, within, _ = _joined(texts)
                found += np.bincount(entropy_steps(data)[within], minlength=STEPS + 2)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[some])], names=["step", "n"])

    counted = map_arrow(docs.select(docs[text].cast("string").alias("text")), run, "step int, n long").groupBy("step").agg(F.sum("n").alias("n"))
    return ranks_of({r["step"]: r["n"] for r in counted.collect()})


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes in one row, which windows lie within one text, and the text of each byte."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return data, row[:len(data) - WINDOW + 1] == row[WINDOW - 1:], row


def _least(values: np.ndarray, run: int) -> np.ndarray:
    """Least value of each ``run`` neighbours, a power of two."""
    step = 1
    while step < run:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return values


def chosen(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Hashes of the features of each text, in the order of the text; ``ranks`` by entropy step."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    long = [i for i, t in enumerate(texts) if len(t) >= WINDOW]
    for i, t in enumerate(texts):
        if 0 < len(t) < WINDOW:
            data = np.frombuffer(t, np.uint8).astype(np.uint64) + np.uint64(1)
            out[i] = mix(np.array([(data * powers(len(data))).sum(dtype=np.uint64)]), len(data))
    if not long:
        return out
    sizes = np.array([len(texts[i]) for i in long])
    ends = np.cumsum(sizes)
    data, within, row = _joined([texts[i] for i in long])
    n = len(data) - WINDOW + 1
    rank = ranks[entropy_steps(data)]
    rank[~within] = 1 << 21
    # Rank and place in one number, so the least is the leftmost of the best.
    keyed = rank << 32 | np.arange(n)
    pad = np.full(RUN - 1, (1 << 22) << 32, np.int64)
    best = _least(np.concatenate([keyed, pad]), RUN)
    own = row[:n][within]
    winners = best[within] & 0xFFFFFFFF
    good = (best[within] >> 32 < WORST) & (row[np.minimum(winners, n - 1)] == own)
    votes = np.bincount(winners[good], minlength=n)
    picked = np.flatnonzero(votes >= VOTES)
    # A text none of whose windows stands out keeps its first.
    begins = ends - sizes
    count = np.bincount(row[picked], minlength=len(long))
    picked = np.sort(np.concatenate([picked, begins[count == 0]]))
    windows = data[picked[:, None] + np.arange(WINDOW)].astype(np.uint64) + np.uint64(1)
    hashes = mix((windows * powers(WINDOW)).sum(axis=1, dtype=np.uint64), 51)
    for i, part in zip(long, np.split(hashes, np.searchsorted(picked, ends[:-1]))):
        out[i] = part
    return out


def fingerprint(features: np.ndarray) -> bytes:
    """The chained filters: for each, its number of features and its bits. Features count once."""
    _, first = np.unique(features, return_index=True)
    features, parts = features[np.sort(first)], []
    for i in range(0, len(features), MOST):
        some = features[i:i + MOST]
        bits = np.zeros(BITS, np.uint8)
        for k in range(HASHES):
            bits[((some >> np.uint64(16 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
        parts.append(struct.pack("<H", len(some)) + np.packbits(bits).tobytes())
    return b"".join(parts)


def likeness(a: bytes, b: bytes) -> float:
    """Normalised overlap of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    size = 2 + BITS // 8
    tables = [np.frombuffer(x, np.uint8).reshape(-1, size) for x in (a, b)]
    short, long = sorted(tables, key=len)
    counts = [t[:, :2].copy().view("<u2").ravel().astype(float) for t in (short, long)]
    lanes = [np.ascontiguousarray(t[:, 2:]).view(np.uint64) for t in (short, long)]
    ones = [np.bitwise_count(x).sum(axis=1, dtype=np.int64).astype(float) for x in lanes]
    total = weight = 0.0
    for i in range(len(short)):
        shared = np.bitwise_count(lanes[0][i] & lanes[1]).sum(axis=1, dtype=np.int64)
        chance = ones[0][i] * ones[1] / BITS
        most = np.minimum(ones[0][i], ones[1])
        total += counts[0][i] * float(np.clip((shared - chance) / np.maximum(most - chance, 1.0), 0.0, 1.0).max())
        weight += counts[0][i]
    return total / weight


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: np.ndarray | None = None) -> DataFrame:
    """``(key, fingerprint)`` per row, the fingerprint in binary. ``ranks``: those of another table, to compare with its fingerprints."""
    ranks = count_steps(docs, text) if ranks is None else ranks
    chosen_columns = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))

    def run(batches):
        for part in text_slices(batches, max_bytes=BLOCK):
            found = [fingerprint(f) for f in chosen([(t or "").encode() for t in part.column(1).to_pylist()], ranks)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["key", "fingerprint"])

    return map_arrow(chosen_columns, run, f"key {docs.schema[key].dataType.simpleString()}, fingerprint binary").withColumnRenamed("key", key)


BUCKET_BYTES = 4 << 20
LEAST_BUCKETS = 64


def _bounds(docs: DataFrame, key: str, text: str) -> np.ndarray:
    """Keys that begin the buckets of a descending order, the greatest first; each is a key of the table."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(size / BUCKET_BYTES))
    shares = [i / buckets for i in range(1, buckets + 1)]
    found = docs.agg(F.percentile_approx(F.col(key).cast("long"), shares, 20 * buckets).alias("b"), F.max(F.col(key).cast("long")).alias("m")).first()
    return np.array(sorted({*(found["b"] or []), *([] if found["m"] is None else [found["m"]])}, reverse=True), np.int64)


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses.

    The edited text has the last third of the characters replaced by the first
    as many of the next row's text, rows in descending order of the key (ties by
    text, null keys last), the first row after the last. Columns: key, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Rows are dealt by ranges of the key. A range's first row is sent to the range
    before it as well, so that every row meets the next one.
    """
    rows = docs.select(docs[key].cast("long").alias("key"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    bounds, ranks = _bounds(rows, "key", "text"), count_steps(rows)

    def first_pass(batches):
        for part in text_slices(batches, max_bytes=BLOCK):
            found = [fingerprint(f) for f in chosen([t.encode() for t in part.column(1).to_pylist()], ranks)]
            missing = np.array([not v.is_valid for v in part.column(0)])
            keys = part.column(0).fill_null(0).to_numpy()
            last = max(len(bounds) - 1, 0)
            bucket = np.where(missing, last, len(bounds) - 1 - np.searchsorted(bounds[::-1], keys)).astype(np.int32)
            # bounds[bucket] >= key > bounds[bucket + 1]; where they are equal the row is a first one.
            first = ~missing & (bounds[bucket] == keys) if len(bounds) else missing
            at = np.concatenate([np.arange(len(keys)), np.flatnonzero(first)])
            where = np.concatenate([bucket, np.where(bucket[first] > 0, bucket[first] - 1, last)]).astype(np.int32)
            tail = np.arange(len(at)) >= len(keys)
            whole = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], names=["key", "text", "print"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(tail), *whole.columns], names=["bucket", "tail", "key", "text", "print"])

    dealt = map_arrow(rows, first_pass, "bucket int, tail boolean, key long, text string, print binary")
    dealt = dealt.repartition(F.col("bucket")).sortWithinPartitions(F.col("bucket"), F.col("tail"), F.col("key").desc_nulls_last(), F.col("text"))

    def finish(waiting):
        """Result rows of ``(row, next row)`` pairs."""
        texts = []
        for (_, _, _, text, _), (_, _, _, after, _) in waiting:
            cut = len(text) // 3
            texts.append((text[:len(text) - cut] + after[:cut]).encode())
        edited = [fingerprint(f) for f in chosen(texts, ranks)]
        own, following = [r[4] for r, _ in waiting], [r[4] for _, r in waiting]
        return pa.RecordBatch.from_arrays([
            pa.array([r[2] for r, _ in waiting], pa.int64()), pa.array([len(r[3]) for r, _ in waiting], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(own, pa.binary()), pa.array(edited, pa.binary()),
            pa.array(list(map(likeness, own, edited)), pa.float64()), pa.array(list(map(likeness, own, following)), pa.float64())], names=names)

    def second_pass(batches):
        last, waiting, size = None, [], 0
        for part in text_slices(batches, max_bytes=BLOCK):
            for row in zip(*(c.to_pylist() for c in part.columns)):
                if last is not None and last[0] == row[0] and not last[1]:
                    waiting.append((last, row))
                    size += len(last[3])
                last = row
                if size >= BLOCK:
                    yield finish(waiting)
                    waiting, size = [], 0
        if waiting:
            yield finish(waiting)

    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    out = map_arrow(dealt, second_pass, "key long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double")
    return out.withColumnRenamed("key", key)
