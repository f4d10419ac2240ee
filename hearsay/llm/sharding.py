"""Sharding by a k-d tree over metadata (operator 6), with built-in functions only.

Rows go to shards of nearly equal bytes. Rows of equal text are one point of the
tree. From the root on, each node is cut across the dimension along which its
bytes lie widest apart (their standard deviation, compared with that of the
whole table's), at the weighted quantile that gives each side the bytes of its
share of the shards, until a node is one shard. With a target size
instead of a number of shards, there are as many shards as the bytes need.

A cut needs no sorting. A point's place along a dimension is a 40-bit number,
the dimension's value in front and a hash of the text behind, which orders
points of one value. Spark sums bytes by the next ``DIGIT`` bits of that number
in all nodes of a level at once; the digit in which the wanted share falls is
kept and the next one looked at. So a level takes a few sums of a bounded number
of rows, whatever the table's size.

Equal texts stay together unless they weigh more than a whole shard. Such a group
is cut, by a hash of the key, into pieces of about a shard over ``PIECES``; its
pieces lie side by side along every dimension, so it fills neighbouring shards
and no more than its bytes need and a cut may add.

Rows: a null text counts as the empty text, of ``OVERHEAD`` bytes. Null
dimensions form one value of their own. Rows of one key and text that
are repeated stay together. An empty table gives an
empty result. Other columns are left out, so clashing names do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm.tasks import stored

SHARDS = 40
OVERHEAD = 16
PIECES = 8
PIECE_BITS = 10
DIGIT = 10
VALUE_BITS, PLACE_BITS = 20, 40
ROWS_PER_SHARE = 20_000


def _scaled(value: Column) -> Column:
    """A count as 20 bits that grow with its logarithm."""
    return F.least(F.lit((1 << VALUE_BITS) - 1), (F.log2(value.cast("double") + 1) * (1 << VALUE_BITS) / 64).cast("long"))


def _named(value: Column) -> Column:
    """A name as 20 bits of its hash; 0 for null."""
    return F.when(value.isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(value), F.lit(1 << VALUE_BITS)))


def _spreads(points: DataFrame, dims: list[str]) -> list:
    """For each node its bytes, and how far they lie apart along each dimension."""
    weigh = F.col("bytes").cast("double")
    sums = points.groupBy("node").agg(
        F.sum("bytes").alias("total"), F.sum(weigh).alias("w"),
        *(F.sum(weigh * F.col(f"d_{d}") / (1 << VALUE_BITS)).alias(f"s_{d}") for d in dims),
        *(F.sum(weigh * F.pow(F.col(f"d_{d}") / (1 << VALUE_BITS), 2)).alias(f"q_{d}") for d in dims))
    # Rounded, so that the order of summing does not choose a dimension.
    return sums.select("node", "total", *(
        F.round(F.sqrt(F.greatest(F.lit(0.0), F.col(f"q_{d}") / F.col("w") - F.pow(F.col(f"s_{d}") / F.col("w"), 2))), 6).alias(d)
        for d in dims)).collect()       # a row for each node, at most the number of shards


def _cuts(points: DataFrame, widths: dict[int, int], dims: list[str], whole: dict[str, float]) -> dict[int, tuple[str, int]]:
    """For each node to cut, its widest dimension and the place below which the left side lies.

    ``whole`` has the spreads of the root, filled in when the root is cut. Of equal spreads the first dimension's counts.
    """
    nodes = {}
    for row in _spreads(points, dims):
        if not whole:
            whole.update({d: row[d] or 1.0 for d in dims})
        if widths.get(row["node"], 1) > 1:
            shards = widths[row["node"]]
            nodes[row["node"]] = [max(dims, key=lambda d: row[d] / whole[d]), 0, int(row["total"]) * (shards // 2) / shards]
    if not nodes:
        return {}
    # Digit by digit, the place in which the wanted bytes are reached.
    for shift in range(PLACE_BITS - DIGIT, -1, -DIGIT):
        dim = F.coalesce(*(F.when(F.col("node") == n, F.col(f"p_{d}")) for n, (d, _, _) in nodes.items()))
        prefix = F.coalesce(*(F.when(F.col("node") == n, F.lit(p)) for n, (_, p, _) in nodes.items()))
        digits = points.select("node", "bytes", dim.alias("place"), prefix.alias("prefix")).where(
            F.shiftright("place", shift + DIGIT) == F.col("prefix")).groupBy(
            "node", F.shiftright("place", shift).alias("digit")).agg(F.sum("bytes").alias("bytes"))
        sums: dict[int, list[tuple[int, int]]] = {}
        for row in digits.orderBy("node", "digit").collect():      # at most 1024 rows for each node
            sums.setdefault(row["node"], []).append((row["digit"], int(row["bytes"])))
        for n, found in sums.items():
            rest = nodes[n][2]
            for digit, size in found:
                if size >= rest:
                    break
                rest -= size
            nodes[n][1:] = [digit, rest]
    # The last place's own points go left where that comes closer.
    return {n: (d, p + 1 if rest * 2 >= dict(sums.get(n, [])).get(p, 0) else p) for n, (d, p, rest) in nodes.items()}


def kd_shards(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, key: str = "doc_id", text: str = "text",
              counts: tuple[str, ...] = (), names: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """``(key, size, text_crc32, shard)``; shards are numbered from 0.

    ``counts`` and ``names`` are further columns to cut along, numeric and
    textual, beside the size of the text; ``target_bytes`` in place of
    ``shards`` gives as many shards as the bytes need.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    dims = ["size", *counts, *names]
    rows = stored(docs.select(
        F.col(key).alias("key"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("crc"), F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2"),
        *(F.col(c).cast("double").alias(f"c_{c}") for c in counts), *(F.col(c).cast("string").alias(f"c_{c}") for c in names)), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    number = shards if target_bytes is None else max(1, math.ceil(total / target_bytes))
    if not number or number < 1:
        raise ValueError("a positive number of shards or target is needed")

    # Stored before it is joined back: both sides then come straight from a
    # shuffle, and Spark splits a text that very many rows share.
    texts = stored(rows.groupBy("h1", "h2").agg(F.sum("size").alias("weight"), *(F.min(f"c_{c}").alias(f"c_{c}") for c in (*counts, *names))), "texts")
    share = total / number
    pieces = F.when(F.col("weight") > share, F.least(F.lit(1 << PIECE_BITS), F.ceil(F.col("weight") * PIECES / share))).cast("long")
    rows = stored(rows.select("key", "size", "crc", "h1", "h2").join(texts, ["h1", "h2"]).select(
        "key", "size", "crc", "h1", "h2", *(f"c_{c}" for c in (*counts, *names)),
        F.coalesce(F.pmod(F.xxhash64("h1", "key"), pieces), F.lit(-1)).alias("part")), "rows")

    values = {"size": _scaled(F.col("size"))} | {c: _scaled(F.greatest(F.coalesce(F.col(f"c_{c}"), F.lit(0.0)), F.lit(0.0))) for c in counts}
    values |= {c: _named(F.col(f"c_{c}")) for c in names}
    behind = F.pmod("h2", F.lit(1 << (PLACE_BITS - VALUE_BITS)))
    group = F.shiftleft(F.shiftright(behind, PIECE_BITS), PIECE_BITS)
    behind = F.when(F.col("part") < 0, behind).otherwise(group + F.col("part"))
    points = stored(rows.groupBy("h1", "h2", "part").agg(
        F.sum("size").alias("bytes"), *(F.min(values[d]).alias(f"d_{d}") for d in dims)).select(
        "h1", "h2", "part", "bytes", *(f"d_{d}" for d in dims),
        *(F.shiftleft(f"d_{d}", PLACE_BITS - VALUE_BITS).bitwiseOR(behind).alias(f"p_{d}") for d in dims)), "points")

    # Nodes are numbered by the first shard under them.
    now, widths, whole = points.withColumn("node", F.lit(0)), {0: number}, {}
    while any(w > 1 for w in widths.values()):
        cuts = _cuts(now, widths, dims, whole)
        after, moved = {}, F.col("node")
        for node, width in widths.items():
            left = width // 2
            if node in cuts:
                dim, place = cuts[node]
                moved = F.when((F.col("node") == node) & (F.col(f"p_{dim}") >= place), F.lit(node + left)).otherwise(moved)
                after |= {node: left, node + left: width - left}
            elif width == 1:
                after[node] = 1
        # A node without rows has no cut; its shards stay empty.
        widths = after
        now = stored(now.withColumn("node", moved), "level")
    placed = rows.join(now.select("h1", "h2", "part", F.col("node").alias("shard")), ["h1", "h2", "part"])
    return placed.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard")


def with_slots(rows: DataFrame, shard: str = "shard", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``slot``, a row's gapless place within its shard.

    Numbers come in two steps, within a salted share of a shard and by the
    shares' totals, so that no shard is numbered in one task.
    """
    rows = stored(rows, "placed")
    shares = max(16, math.ceil(rows.count() / ROWS_PER_SHARE))
    salted = rows.withColumn("_share", F.pmod(F.xxhash64(*order), F.lit(shares)))
    totals = salted.groupBy(shard, "_share").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(shard, "_share", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    row = F.row_number().over(Window.partitionBy(shard, "_share").orderBy(*order)) - 1
    numbered = salted.withColumn("_row", row).join(totals, [shard, "_share"])
    # No more files than shares: few rows need few.
    return numbered.coalesce(shares).select(*rows.columns, (F.col("_before") + F.col("_row")).alias("slot"))
