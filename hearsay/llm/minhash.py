"""Near-duplicates by one-permutation MinHash (operator 5).

A document's set is its distinct ``size``-word shingles, words being runs of
characters other than space and U+0009 to U+000D, with A-Z in lower case; with
fewer words the whole sequence is its one shingle.

1. One hash per shingle fills ``BINS`` bins with their least value. An empty bin
   takes the value of the first full bin in a probe order of its own (optimal
   densification). ``ROWS`` bins make a band; its hash is a bucket.
2. Documents with equal sets become one node, known by their smallest id.
3. Each bucket's candidates are a star round its most central node, the one
   that shares most buckets, so a bucket of n nodes gives at most n - 1 pairs.
4. Links are confirmed on the full sets, and components found.
5. What a star can miss are links between components that meet in a bucket
   without both touching its centre. For those buckets alone, nodes of
   different components are compared within the join: by set size, by a 256-bit
   sketch, and by how each is known to differ from the bucket's centre, which
   bounds how alike they can be. Pairs that may reach the threshold are confirmed
   likewise.

With 42 bands of 6 bins, a pair at the threshold of 0.8 shares no bucket with
probability 3e-6. No bucket is capped.

Rows: documents without text or words have the empty set and are linked with
nothing. Rows that share an id are one node with all their sets. Rows with a null id are linked with
nothing and have a null component. Very long texts are read whole. An empty
table gives an empty result. Columns other than id and text are left out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.components import connected_components
from hearsay.llm.tasks import IdFilter, map_arrow, stored, text_slices
from hearsay.llm.wordhash import combine, mix, powers, words

BINS, BANDS, ROWS = 256, 42, 6
SIZE = 5
THRESHOLD = (80, 100)       # links have 100 * intersection >= 80 * union
# The sketch keeps one bit of each bin. At a similarity of 0.8 about 230 of 256
# bits agree, with a deviation of 5: a linked pair falls below SKETCH_AGREE with a chance of
# 7e-9 (binomial tail). Sets under SKETCHED shingles are not judged by it.
SKETCH_AGREE, SKETCHED = 200, 128


@lru_cache(maxsize=1)
def _probes() -> np.ndarray:
    """For each bin, the order in which it looks for a full one."""
    return np.argsort(mix(np.arange(BINS * BINS, dtype=np.uint64), 7).reshape(BINS, BINS), axis=1)


def shingles(hashes: np.ndarray, ends: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, from the word hashes of all of them."""
    whole = hashes
    for i in range(1, size):
        whole = combine(whole[:-1], hashes[i:], i) if len(whole) > 1 else whole[:0]
    sets, start = [], 0
    for end in ends.tolist():
        if end - start >= size:
            sets.append(np.unique(whole[start:end - size + 1]))
        elif end > start:
            short = hashes[start:start + 1]
            for i in range(start + 1, end):
                short = combine(short, hashes[i:i + 1], i - start)
            sets.append(mix(short, 100 + end - start))
        else:
            sets.append(hashes[:0])
        start = end
    return sets


def signature(found: np.ndarray) -> np.ndarray:
    """The least hash of each bin, empty bins densified; ``found`` is sorted and not empty."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
    first = np.searchsorted(found, edges)
    full = np.append(first[1:], len(found)) > first
    values = found[np.minimum(first, len(found) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        probes = _probes()[empty]
        values[empty] = values[probes[np.arange(len(empty)), full[probes].argmax(axis=1)]]
    return values


def bands(values: np.ndarray) -> np.ndarray:
    own = values[:BANDS * ROWS].reshape(BANDS, ROWS)
    return mix((mix(own, 11) * powers(ROWS)).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 12)


def sketch(values: np.ndarray) -> np.ndarray:
    return np.packbits((mix(values, 13) >> np.uint64(40)).astype(np.uint8) & 1).view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``(id, n, f1, f2, bands, s0..s3)``: set size, set fingerprint, buckets and sketch."""
    chosen = docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text"))
    id_type = docs.schema[key].dataType.simpleString()
    empty = np.zeros(4, np.int64)

    def run(batches):
        for part in text_slices(batches, max_bytes=1 << 20):
            sets = shingles(*words([t or "" for t in part.column(1).to_pylist()], lower=True), size)
            n = np.array([len(s) for s in sets], np.int64)
            prints = np.array([(mix(s, 21).sum(dtype=np.uint64), mix(s, 22).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
            values = [signature(s) if len(s) else None for s in sets]
            buckets = [None if v is None else bands(v).view(np.int64) for v in values]
            sketches = np.array([empty if v is None else sketch(v) for v in values])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(buckets, pa.list_(pa.int64())),
                 *(pa.array(np.ascontiguousarray(sketches[:, i])) for i in range(4))],
                names=["id", "n", "f1", "f2", "bands", "s0", "s1", "s2", "s3"])

    return map_arrow(chosen, run, f"id {id_type}, n long, f1 long, f2 long, bands array<long>, s0 long, s1 long, s2 long, s3 long")


def _sizes_allow(n: str, m: str, threshold: tuple[int, int]):
    return F.least(n, m) * threshold[1] >= F.greatest(n, m) * threshold[0]


def judged(pairs: DataFrame, texts: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """``(a, b, linked, d, d0..d3)`` of each pair from its full shingle sets.

    ``d`` counts the shingles that only one has; ``d0..d3`` are 256 bits, one
    of them set for each of those shingles.
    """
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    id_type = both.schema["a"].dataType.simpleString()
    least, whole = threshold

    def run(batches):
        last, own = None, None      # pairs come sorted by b: its set is kept while it stays
        for batch in batches:
            for part in text_slices([batch], "text_a"):
                sets = shingles(*words(part.column(2).to_pylist(), lower=True), size)
                linked, differ, bits = [], [], np.zeros((part.num_rows, 32), np.uint8)
                for i, (found, text) in enumerate(zip(sets, part.column(3))):
                    text = text.as_py()
                    if text != last:
                        last, own = text, shingles(*words([text], lower=True), size)[0]
                    only = np.setxor1d(found, own, assume_unique=True)
                    both, either = (len(found) + len(own) - len(only)) // 2, (len(found) + len(own) + len(only)) // 2
                    linked.append(both > 0 and both * whole >= least * either)
                    differ.append(len(only))
                    spots = np.zeros(256, np.uint8)
                    spots[(mix(only, 14) >> np.uint64(56)).astype(np.int64)] = 1
                    bits[i] = np.packbits(spots)
                lanes = bits.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(linked, pa.bool_()), pa.array(differ, pa.int64()),
                     *(pa.array(np.ascontiguousarray(lanes[:, k])) for k in range(4))],
                    names=["a", "b", "linked", "d", "d0", "d1", "d2", "d3"])

    return map_arrow(both, run, f"a {id_type}, b {id_type}, linked boolean, d long, d0 long, d1 long, d2 long, d3 long")


def _may_link(threshold: tuple[int, int]):
    """Whether two nodes of a bucket can reach the threshold, from how they differ from its centre.

    The shingles that tell x and y apart are those that tell exactly one of them
    from the centre. Each bit that only x has stands for a shingle at least that
    x does not share with y, which bounds the shared ones from above.
    """
    least, whole = threshold
    lone = [sum((F.bit_count(F.col(f"d{i}_{p}").bitwiseAND(F.bitwise_not(F.col(f"d{i}_{q}")))) for i in range(4)), F.lit(0))
            for p, q in ((1, 2), (2, 1))]
    shared = F.least(F.col("d_1") - lone[0], F.col("d_2") - lone[1])
    apart = F.col("d_1") + F.col("d_2") - 2 * shared
    return F.coalesce(apart * (whole + least) <= (F.col("n_1") + F.col("n_2")) * (whole - least), F.lit(True))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE,
                    threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``(key, n_shingles, component_id, kept)`` per row; ``kept`` marks the smallest id of a component."""
    signed = stored(signatures(docs, key, text, size), "signed")
    whole = signed.where(F.col("id").isNotNull() & (F.col("n") > 0))
    # What is joined back to its own rows is stored first: then both sides come
    # straight from a shuffle, and Spark splits a key that very many rows share.
    sets = stored(whole.groupBy("f1", "f2", "n").agg(F.min("id").alias("node")), "sets")
    rows = stored(signed.select("id", "n", "f1", "f2").join(sets, ["f1", "f2", "n"], "left")
                  .select("id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")), "rows")
    # An id with several sets links the nodes that stand for them.
    several = stored(rows.groupBy("id").agg(F.min("node").alias("own"), F.max("node").alias("other"), F.count_if(F.col("node").isNull()).alias("bare"))
                     .where((F.col("own") != F.col("other")) | (F.col("own").isNotNull() & (F.col("bare") > 0))), "several")
    own_links = rows.join(several, "id").where(F.col("node") != F.col("own")).select(F.col("node").alias("a"), F.col("own").alias("b"))
    nodes = rows.where(F.col("id") == F.col("node")).select("id").distinct()
    signed_nodes = whole.join(nodes, "id", "left_semi")

    spread = signed_nodes.select(F.col("id").alias("a"), "n", F.explode("bands").alias("bucket"))
    shared = stored(spread.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > 1), "shared")
    members = stored(spread.join(shared, "bucket"), "members")

    central = members.groupBy("a").agg(F.sum("size").alias("score"))
    centres = stored(members.join(central, "a").groupBy("bucket").agg(
        F.max(F.struct(F.col("score"), F.col("n").alias("m"), F.col("a").alias("b"))).alias("c")).select("bucket", "c.b", "c.m"), "centres")
    stars = members.join(centres, "bucket").where((F.col("a") != F.col("b")) & _sizes_allow("n", "m", threshold))
    pairs = stored(stars.select("a", "b").distinct(), "pairs")

    paired = stored(members.select(F.col("a").alias("id")).distinct(), "paired")
    bodies = docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text")).where(F.col("text").isNotNull())
    texts = stored(IdFilter(paired, "id").rows(bodies, "id").join(paired, "id", "left_semi"), "texts")
    stars = stored(judged(pairs, texts, size, threshold), "stars")
    labels = connected_components(stars.where("linked").select("a", "b").union(own_links))

    labelled = members.join(labels.withColumnRenamed("node", "a"), "a", "left").select(
        "bucket", "a", "n", F.coalesce("component", "a").alias("label"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    mixed = stored(mixed.join(centres.select("bucket", "b"), "bucket"), "mixed")
    open_members = stored(labelled.join(mixed, "bucket"), "open")
    # Two nodes meet once, in the first bucket that they share.
    facts = open_members.groupBy("a").agg(F.sort_array(F.collect_list("bucket")).alias("all")).join(
        signed_nodes.select(F.col("id").alias("a"), "s0", "s1", "s2", "s3"), "a")
    own = F.col("a") == F.col("b")
    known = open_members.join(facts, "a").join(stars.drop("linked"), ["a", "b"], "left").select(
        "bucket", "a", "n", "label", "all", "s0", "s1", "s2", "s3",
        *(F.when(own, 0).otherwise(F.col(c)).alias(c) for c in ("d", "d0", "d1", "d2", "d3")))
    one = known.select("bucket", *(F.col(c).alias(f"{c}_1") for c in known.columns if c != "bucket"))
    two = known.select(F.col("bucket").alias("bucket_2"), *(F.col(c).alias(f"{c}_2") for c in known.columns if c != "bucket"))
    differ = sum((F.bit_count(F.col(f"s{i}_1").bitwiseXOR(F.col(f"s{i}_2"))) for i in range(4)), F.lit(0))
    rest = one.join(two, (F.col("bucket") == F.col("bucket_2")) & (F.col("label_1") < F.col("label_2"))
                    & _sizes_allow("n_1", "n_2", threshold)
                    & ((F.least("n_1", "n_2") < SKETCHED) | (differ <= BINS - SKETCH_AGREE))
                    & _may_link(threshold)
                    & (F.array_min(F.array_intersect("all_1", "all_2")) == F.col("bucket")))
    # The centre's pairs were judged already; a pair's order there is (member, centre).
    rest = rest.select(F.col("a_1").alias("a"), F.col("a_2").alias("b")).distinct()
    tested = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = stored(rest.join(tested, ["a", "b"], "left_anti"), "rest")
    more = judged(rest, texts, size, threshold).where("linked")
    labels = connected_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more.select("a", "b")))

    # A row without words of an id that has others goes with them.
    out = rows.join(several.select("id", "own"), "id", "left").withColumn("node", F.coalesce("node", "own")).join(labels, "node", "left")
    component = F.coalesce("component", "node", "id")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))


def keep_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE,
                   threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One document of each component, the one with the smallest id, with its own columns.

    All different texts of that id stay; of rows with the same id and text one
    stays. Rows with a null id all stay.
    """
    found = near_duplicates(docs, key, text, size, threshold).where(F.col("kept")).select(F.col(key).alias("_kept_id_")).dropna().distinct()
    with_id = docs.join(found, docs[key] == found["_kept_id_"]).drop("_kept_id_").dropDuplicates([key, text])
    return with_id.union(docs.where(docs[key].isNull()))
