"""Hard negatives by Four-Russians scoring (operator 11).

A row is an id, a label and a vector, whose components x become floor(scale * x).
Rows with a null id, label or vector, or a component that is null or not finite,
take no part. A row's score is its exact integer inner product with the anchor.

1. Each row's components are written once as two's complement bit planes and
   packed: one byte holds one bit of eight dimensions. This table is stored.
2. Anchors are taken in slices of at most about ``COMPONENTS`` components, each
   sent to the tasks that read the packed rows. For every group of eight
   dimensions a task builds the 256 sums of an anchor's subsets; a row's byte
   looks up its sum, and planes are added from the top one down, doubling.
3. First pass: each task keeps an anchor's best rows of its own label, Spark the
   best of these: its positives. Second pass: likewise the best rows of other
   labels whose score lies in the positive's band.

What a task holds is set by the slice. All anchors meet all rows, as a stated
query set does, and the rows are neither shuffled nor copied for it. Sums are
kept in the narrowest integers that hold them, so scores are exact while they
fit a long; components of 2**53 / scale or more are refused with an error.

Higher scores come first, ties by smaller id. Rows of one id, label and score
count once for an anchor; no row is a positive of an anchor of its own id.
Repeated anchors count once; different rows of one anchor id are anchors each.
Shorter vectors count as filled up with zeros, so an empty vector scores 0.
Without anchors, or on an empty table, the result is empty. Other columns are
left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm.tasks import map_arrow, stored
from hearsay.session import scratch_path

COMPONENTS = 1 << 22        # of the anchors of one slice
BLOCK_ROWS, BLOCK_ANCHORS = 2048, 64
WAITING = 1 << 16
LOWEST = np.iinfo(np.int64).min
PACKED = "id long, label long, width int, planes binary"


def usable(rows: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    chosen = rows.select(rows[key].cast("long").alias("id"), rows[label].cast("long").alias("label"),
                         rows[vector].cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return chosen.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)


def widths(values: np.ndarray) -> np.ndarray:
    """How many planes hold each row of integers."""
    most = np.maximum(values.max(axis=1, initial=0), -1 - values.min(axis=1, initial=0))
    return 2 + np.floor(np.log2(np.maximum(most, 0.5))).astype(np.int64)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """The bytes ``[rows, planes, groups]`` of integers that ``width`` planes hold."""
    return np.stack([np.packbits((values >> p & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(width)], axis=1)


def unpack(planes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(planes, axis=2, bitorder="little").astype(np.int64)
    weights = np.int64(1) << np.arange(planes.shape[1], dtype=np.int64)
    weights[-1] = -weights[-1]
    return (bits * weights[None, :, None]).sum(axis=1)


def packed(rows: DataFrame, scale: int) -> DataFrame:
    """``(id, label, width, planes)`` of usable rows."""
    def run(batches):
        for batch in batches:
            vectors = batch.column(2)
            sizes = np.diff(vectors.offsets.to_numpy())
            whole = np.floor(vectors.flatten().to_numpy() * scale)
            if np.any(np.abs(whole) >= 2**53):
                raise ValueError("a component is too large to be scored exactly")
            values = np.zeros((batch.num_rows, max(1, int(sizes.max(initial=0)))), np.int64)
            values[np.arange(values.shape[1]) < sizes[:, None]] = whole
            # A row's shape is its own, so that equal rows have equal bytes in any batch.
            width, groups, planes = widths(values), np.maximum(1, -(-sizes // 8)), [b""] * batch.num_rows
            for w, g in {*zip(width.tolist(), groups.tolist())}:
                same = np.flatnonzero((width == w) & (groups == g))
                for i, p in zip(same.tolist(), pack(values[same, :g * 8], w)):
                    planes[i] = p.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(width.astype(np.int32)), pa.array(planes, pa.binary())],
                                             names=["id", "label", "width", "planes"])

    return map_arrow(rows.select("id", "label", "vector"), run, PACKED)


def of_one_shape(width: np.ndarray, planes: pa.BinaryArray):
    """``(rows, [rows, planes, groups])`` for the rows of each shape."""
    size = np.diff(np.frombuffer(planes.buffers()[1], np.int32)[planes.offset:planes.offset + len(planes) + 1])
    for w, n in {*zip(width.tolist(), size.tolist())}:
        rows = np.flatnonzero((width == w) & (size == n))
        raw = b"".join(planes.take(pa.array(rows)).to_pylist())
        yield rows, np.frombuffer(raw, np.uint8).reshape(len(rows), w, n // w)


def subset_sums(anchors: np.ndarray, groups: int) -> np.ndarray:
    """``[groups, 256, anchors]``: for each byte, the sum of the anchor's components that it names."""
    values = np.zeros((len(anchors), groups * 8), np.int64)
    values[:, :anchors.shape[1]] = anchors[:, :groups * 8]
    bound = int(np.abs(values).sum(axis=1).max(initial=0))
    kind = np.int16 if bound < 2**15 else np.int32 if bound < 2**31 else np.int64
    by_dimension = values.T.reshape(groups, 8, len(anchors)).astype(kind)
    sums = np.zeros((groups, 256, len(anchors)), kind)
    for i in range(8):
        sums[:, 1 << i:2 << i] = sums[:, :1 << i] + by_dimension[:, i, None]
    return sums


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """``[rows, anchors]``, by look-ups, additions and doublings."""
    width = planes.shape[1]
    room = np.int32 if sums.itemsize == 2 and width <= 15 else np.int64
    total = None
    for p in range(width - 1, -1, -1):
        found = sums[0].take(planes[:, p, 0], axis=0)
        for g in range(1, len(sums)):
            found += sums[g].take(planes[:, p, g], axis=0)
        if total is None:
            total = -found.astype(room)
        else:
            total <<= 1
            total += found
    return total


class Best:
    """The ``k`` highest scores with their ids for each of many keys.

    New entries wait until they are as many as those kept, so each is sorted a few times only.
    """

    def __init__(self, keys: int, k: int):
        self.k = k
        self.kept = tuple(np.zeros(0, np.int64) for _ in range(3))      # key, score, id
        self.waiting, self.many = [], 0
        self.least = np.full(keys, LOWEST)      # what a key's new scores must reach

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.waiting.append((key, score, ids))
        self.many += len(key)
        if self.many >= max(WAITING, len(self.kept[0])):
            self.sort()

    def sort(self) -> tuple[np.ndarray, ...]:
        key, score, ids = (np.concatenate(parts) for parts in zip(self.kept, *self.waiting))
        self.waiting, self.many = [], 0
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        key, score, ids = key[new], score[new], ids[new]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        first, last = place < self.k, place == self.k - 1
        self.least[key[last]] = score[last]
        self.kept = key[first], score[first], ids[first]
        return self.kept


def _blocks(batches, anchors: np.ndarray, groups_of):
    """``(rows' ids, rows' labels, anchor numbers, scores)`` of every row block and block of anchors.

    ``groups_of(labels)`` yields which rows of a batch meet which anchors.
    """
    for batch in batches:
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for shape, planes in of_one_shape(batch.column(2).to_numpy(), batch.column(3)):
            for rows, chosen in groups_of(labels[shape]):
                for a in range(0, len(chosen), BLOCK_ANCHORS):
                    numbers = chosen[a:a + BLOCK_ANCHORS]
                    sums = subset_sums(anchors[numbers], planes.shape[2])
                    for r in range(0, len(rows), BLOCK_ROWS):
                        part = rows[r:r + BLOCK_ROWS]
                        yield ids[shape[part]], labels[shape[part]], numbers, scores(sums, planes[part])


def _best_rows(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Of what the tasks kept, the ``k`` best for each key, with their ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id"))
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def positives_of(rows: DataFrame, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """``(anchor, id, score, rank)``: the best rows of each anchor's label, anchors by number."""
    by_label = np.argsort(labels, kind="stable")

    def run(batches):
        best = Best(len(ids), k)

        def of_label(own):
            order = np.argsort(own, kind="stable")
            for label in np.intersect1d(own, labels):
                start, end = np.searchsorted(own[order], [label, label + 1])
                yield order[start:end], by_label[slice(*np.searchsorted(labels[by_label], [label, label + 1]))]

        for row_ids, _, numbers, score in _blocks(batches, vectors, of_label):
            least = best.least[numbers]
            if len(score) > 16 * k and np.any(least == LOWEST) and len(np.unique(row_ids)) == len(row_ids):
                # The block itself has k rows other than the anchor that reach this.
                least = np.maximum(least, np.partition(score, len(score) - k - 1, axis=0)[len(score) - k - 1])
            r, a = np.nonzero(score >= least)
            other = row_ids[r] != ids[numbers[a]]
            r, a = r[other], a[other]
            best.add(numbers[a], score[r, a].astype(np.int64), row_ids[r])
        anchor, score, found = best.sort()
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(found), pa.array(score)], names=["anchor", "id", "score"])

    return _best_rows(map_arrow(rows, run, "anchor long, id long, score long"), ["anchor"], k)


def negatives_of(rows: DataFrame, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> DataFrame:
    """``(slot, id, score, rank)``: the best rows of other labels from ``low`` to ``high``.

    Both are ``[anchors, positives]``; a slot is an anchor's number times their number, plus the positive's.
    """
    slots = low.shape[1]

    def run(batches):
        best = Best(low.size, k)
        everything = np.arange(len(labels))
        for row_ids, row_labels, numbers, score in _blocks(batches, vectors, lambda own: [(np.arange(len(own)), everything)]):
            least = np.maximum(low[numbers], best.least.reshape(-1, slots)[numbers])
            most = high[numbers]
            r, a = np.nonzero((score >= least.min(axis=1)) & (score <= most.max(axis=1)))
            other = row_labels[r] != labels[numbers[a]]
            r, a = r[other], a[other]
            found = score[r, a].astype(np.int64)
            for s in range(slots):
                fits = (found >= least[a, s]) & (found <= most[a, s])
                best.add(numbers[a[fits]] * slots + s, found[fits], row_ids[r[fits]])
        slot, score, found = best.sort()
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(found), pa.array(score)], names=["slot", "id", "score"])

    return _best_rows(map_arrow(rows, run, "slot long, id long, score long"), ["slot"], k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding",
                   positives: int = 5, negatives: int = 3, band: tuple[int, int] = (50, 95), scale: int = 256) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    An anchor's positives are its ``positives`` best other rows of the same
    label. For each, the ``negatives`` best rows of other labels whose score is
    at least ``band[0]`` and at most ``band[1]`` hundredths of the positive's.
    ``anchors`` has the columns of ``rows``.
    """
    spark = rows.sparkSession
    table = stored(packed(usable(rows, key, label, vector), scale), "packed")
    queries = stored(packed(usable(anchors, key, label, vector), scale).distinct(), "anchors")
    size = queries.agg(F.sum(F.octet_length("planes") / F.col("width") * 8)).first()[0] or 0
    count = max(1, -(-int(size) // COMPONENTS))
    slices = queries.withColumn("slice", F.pmod(F.xxhash64("id", "label", "planes"), F.lit(count)))

    result = scratch_path(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(f"{result}/slice=none")
    for number in range(count):
        chosen = slices.where(F.col("slice") == number).drop("slice").orderBy("id", "label", "planes").toArrow()
        if not chosen.num_rows:
            continue
        ids, labels = chosen.column(0).to_numpy(), chosen.column(1).to_numpy()
        bits = chosen.column(3).combine_chunks()
        parts = [(where, unpack(planes)) for where, planes in of_one_shape(chosen.column(2).to_numpy(), bits)]
        vectors = np.zeros((len(ids), max(v.shape[1] for _, v in parts)), np.int64)
        for where, v in parts:
            vectors[where, :v.shape[1]] = v

        own = positives_of(table, ids, labels, vectors, positives).toPandas()
        anchor, place = own["anchor"].to_numpy(np.int64), own["rank"].to_numpy(np.int64) - 1
        who, score = np.zeros((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)
        who[anchor, place], score[anchor, place] = own["id"], own["score"]
        low, high = -(-band[0] * score // 100), band[1] * score // 100
        none = np.ones((len(ids), positives), bool)
        none[anchor, place] = False
        low[none], high[none] = 1, 0

        found = negatives_of(table, labels, vectors, low, high, negatives)

        def named(batches, ids=ids, who=who, score=score):
            for batch in batches:
                slot = batch.column(0).to_numpy()
                a, p = slot // positives, slot % positives
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a]), pa.array(who[a, p]), batch.column(3).cast(pa.int32()), batch.column(1),
                     pa.array(score[a, p]), batch.column(2)],
                    names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

        map_arrow(found.select("slot", "id", "score", "rank"), named, schema).write.parquet(f"{result}/slice={number}")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(result)
