"""Removal of long repeats by recompression (operator 10).

A window is ``size`` consecutive words of one text, words being runs of
characters other than space and U+0009 to U+000D. A word is removed where a
window covers it whose words also start in a text with a smaller id. Windows
are judged on the input, not on what is left.

1. One pass parses every text by recompression and takes its anchors: for each
   window the two symbols that every other window of the same words takes too.
2. A row whose whole word sequence a smaller id has is removed as a whole; the
   smallest id of such a group stands for it from here on. Other rows of its id stay.
3. Spark counts the texts of each anchor. Only windows whose anchor more than
   one text has can repeat; they, and windows without an anchor (in periodic
   text), go on as two 64-bit hashes of their words.
4. Spark finds the smallest id of each window; windows that a smaller id has
   mark their words.

Counts are combined before each shuffle and joined back, so a passage that very
many texts share is split like any skewed join. Nothing is capped.

Rows: null or empty texts have no words and keep none. Texts under ``size``
words have no window. Rows that share an id count as one text, so they never
remove from each other. Rows with a null id neither remove nor lose words. Very
long texts are read whole. An empty table gives an empty result. Columns other
than id and text are left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.recompress import anchors
from hearsay.llm.tasks import IdFilter, map_arrow, stored, text_slices
from hearsay.llm.wordhash import BASE, mix, powers, words

SIZE = 50
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


class Windows:
    """The windows of some texts: the places where they start and whose they are."""

    def __init__(self, texts: list[str], size: int):
        hashes, ends = words(texts)
        counts = np.diff(ends, prepend=0)
        # A stop before each text and one at the end.
        self.size, self.counts = size, counts
        self.first = np.cumsum(counts + 1) - counts
        total = int(counts.sum()) + len(texts) + 1
        self.stops = np.zeros(total, bool)
        self.stops[np.append(self.first - 1, total - 1)] = True
        self.hashes = np.zeros(total, np.uint64)
        self.hashes[~self.stops] = hashes
        many = np.maximum(counts - size + 1, 0)
        self.row = np.repeat(np.arange(len(texts)), many)
        self.starts = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + self.first[self.row]

    def anchors(self) -> np.ndarray:
        return anchors(self.hashes, self.stops, self.starts, self.size)

    def rolled(self, seed: int) -> np.ndarray:
        """Hash of each window's words: differences of one running sum."""
        values = mix(self.hashes, seed)
        n = len(values)
        total = np.concatenate([[np.uint64(0)], np.cumsum(values * powers(n), dtype=np.uint64)])
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _INVERSE, np.uint64)]), dtype=np.uint64)
        return mix((total[self.starts + self.size] - total[self.starts]) * back[self.starts], seed)

    def prints(self, seed: int) -> np.ndarray:
        """Hash of each text's whole word sequence."""
        place = np.arange(len(self.hashes)) - np.repeat(np.append(self.first - 1, len(self.hashes) - 1), np.append(self.counts + 1, 1))
        most = int(self.counts.max(initial=0)) + 1
        return mix(np.add.reduceat(np.where(self.stops, np.uint64(0), mix(self.hashes, seed) * powers(most)[place]), self.first - 1), seed)


def _distinct(row: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of equal arrays, each once, in the order of ``row``."""
    order = np.lexsort((*columns[::-1], row))
    row, columns = row[order], [c[order] for c in columns]
    new = np.ones(len(row), bool)
    if len(row):
        new[1:] = (row[1:] != row[:-1]) | np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return (row[new], *(c[new] for c in columns))


def _among(pairs: list[np.ndarray], known: list[np.ndarray]) -> np.ndarray:
    """Which of the pairs are among the known ones."""
    first, second = (np.concatenate(both) for both in zip(pairs, known))
    order = np.lexsort((second, first))
    new = np.ones(len(order), bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new)
    return np.isin(group[:len(pairs[0])], group[len(pairs[0]):])


def _lists(row: np.ndarray, values: np.ndarray, count: int) -> pa.ListArray:
    ends = np.searchsorted(row, np.arange(count + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64)))


def parsed(docs: DataFrame, size: int) -> DataFrame:
    """``(id, n, f1, f2, anchors, bare)``: words, print of them, distinct anchors, whether a window has none."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for part in text_slices(batches):
            w = Windows([t or "" for t in part.column(1).to_pylist()], size)
            found = w.anchors()
            bare = np.bincount(w.row[found == 0], minlength=part.num_rows) > 0
            row, names = _distinct(w.row[found > 0], found[found > 0])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(w.counts), pa.array(w.prints(31).view(np.int64)), pa.array(w.prints(32).view(np.int64)),
                 _lists(row, names, part.num_rows), pa.array(bare)], names=["id", "n", "f1", "f2", "anchors", "bare"])

    return map_arrow(docs, run, f"id {id_type}, n long, f1 long, f2 long, anchors array<long>, bare boolean")


def open_windows(texts: DataFrame, size: int) -> DataFrame:
    """``(h, g, id)``: the distinct windows of each text that have no anchor or one of ``shared``, by two hashes."""
    id_type = texts.schema["id"].dataType.simpleString()

    def run(batches):
        for part in text_slices(batches):
            w = Windows(part.column(1).to_pylist(), size)
            found = w.anchors()
            shared = part.column(2)
            owner = np.repeat(np.arange(part.num_rows), np.diff(shared.offsets.to_numpy()))
            known = shared.flatten().to_numpy().view(np.uint64)
            wanted = (found == 0) | np.isin(mix(found + w.row.astype(np.uint64) * BASE), mix(known + owner.astype(np.uint64) * BASE))
            row, h, g = _distinct(w.row[wanted], w.rolled(41)[wanted], w.rolled(42)[wanted])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), part.column(0).take(pa.array(row))],
                                             names=["h", "g", "id"])

    return map_arrow(texts.select("id", "text", "shared"), run, f"h long, g long, id {id_type}")


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that more than one id has, with the smallest; stored.

    Joined back to the rows, both sides then come straight from a shuffle, and
    Spark splits a key that very many rows share.
    """
    both = rows.groupBy(*keys).agg(F.min("id").alias("least"), F.max("id").alias("most"))
    return stored(both.where("least <> most").select(*keys, "least"), "shared")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """``(key, prints, hashes)`` of the ids that lose words.

    ``prints`` are whole texts of that id that a smaller id has, ``hashes``
    windows that a smaller id has, ``(h, g)`` each.
    """
    docs = docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text")).where(
        F.col("id").isNotNull() & F.col("text").isNotNull())
    known = stored(parsed(docs, size), "parsed").where(F.col("n") >= size)
    copied = known.select("id", "n", "f1", "f2").join(_shared(known, "n", "f1", "f2"), ["n", "f1", "f2"]).where("id > least")
    copied = stored(copied.select("id", "n", "f1", "f2").distinct(), "copies")
    copies = copied.groupBy("id").agg(F.collect_list(F.struct("f1", "f2")).alias("prints"))
    # Rows, not ids: an id may have other texts that are no copies.
    first = known.join(copied, ["id", "n", "f1", "f2"], "left_anti")

    marks = stored(first.select("id", F.explode("anchors").alias("anchor")), "anchors")
    own = marks.join(_shared(marks, "anchor"), "anchor").select("id", "anchor")
    bare = first.where("bare").select("id", F.lit(None).cast("long").alias("anchor"))
    open_texts = stored(own.union(bare).groupBy("id").agg(F.collect_list("anchor").alias("shared")), "open")
    # Computed anew for the join rather than stored: the rows are many and cheap to make.
    found = open_windows(IdFilter(open_texts, "id").rows(docs, "id").join(open_texts, "id"), size)
    lost = found.join(_shared(found, "h", "g"), ["h", "g"]).where("id > least")
    lost = lost.groupBy("id").agg(F.collect_list(F.struct("h", "g")).alias("hashes"))
    return copies.join(lost, "id", "full_outer").select(F.col("id").alias(key), "prints", "hashes")


def _cut(docs: DataFrame, key: str, text: str, size: int, keep: tuple[str, ...], rejoin: bool) -> DataFrame:
    """``(_key, _keep0.., _words, _removed, _text)``; without ``rejoin`` a text that loses nothing stays as it is."""
    kept = [docs[c].alias(f"_keep{i}") for i, c in enumerate(keep)]
    own = [f"_keep{i}" for i in range(len(keep))]
    lost = stored(repeats(docs, key, text, size).select(F.col(key).alias("_id"), "prints", "hashes"), "lost")
    rows = docs.select(docs[text].cast("string").alias("_text"), docs[key].alias("_key"), *kept)
    # Only rows that may lose words are shuffled.
    touched = IdFilter(lost, "_id")
    joined = touched.rows(rows, "_key").join(lost, F.col("_key") == F.col("_id"), "left").select("_text", "prints", "hashes", "_key", *own)
    none = {f.name: F.lit(None).cast(f.dataType) for f in joined.schema.fields[1:3]}
    rows = joined.union(touched.rows(rows, "_key", held=False).withColumns(none).select(*joined.columns))
    types = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[3:]]

    def run(batches):
        for part in text_slices(batches, "_text"):
            texts = [t or "" for t in part.column(0).to_pylist()]
            prints, hashes = part.column(1).to_pylist(), part.column(2)
            touched = [i for i, p in enumerate(prints) if p or hashes[i].is_valid]
            count, removed = np.array([len(t.encode().split()) for t in texts], np.int64), np.zeros(len(texts), np.int64)
            out = [" ".join(WORD.findall(t)) for t in texts] if rejoin else part.column(0).to_pylist()
            if touched:
                w = Windows([texts[i] for i in touched], size)
                whole = [{"f1": a, "f2": b} for a, b in zip(*(w.prints(seed).view(np.int64).tolist() for seed in (31, 32)))]
                rolled = w.rolled(41).view(np.int64), w.rolled(42).view(np.int64)
                edges = np.searchsorted(w.row, np.arange(len(touched) + 1))
                for j, i in enumerate(touched):
                    n = int(w.counts[j])
                    if whole[j] in (prints[i] or ()):
                        removed[i], out[i] = n, ""
                    elif hashes[i].is_valid and n >= size:
                        hit = _among([r[edges[j]:edges[j + 1]] for r in rolled], [hashes[i].values.field(c).to_numpy() for c in (0, 1)])
                        cover = np.zeros(n + 1, np.int64)
                        cover[:n - size + 1] += hit
                        cover[size:] -= hit
                        gone = np.cumsum(cover[:n]) > 0
                        removed[i] = int(gone.sum())
                        if not removed[i]:
                            continue
                        found = WORD.findall(texts[i])
                        out[i] = " ".join([found[k] for k in np.flatnonzero(~gone).tolist()])
            yield pa.RecordBatch.from_arrays([*part.columns[3:], pa.array(count), pa.array(removed), pa.array(out, pa.string())], names=names)

    names = ["_key", *own, "_words", "_removed", "_text"]
    return map_arrow(rows, run, ", ".join([*types, "_words long, _removed long, _text string"]))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """``(key, n_words, n_removed, text)`` per row; the text is its kept words joined by one space."""
    return _cut(docs, key, text, size, (), True).select(
        F.col("_key").alias(key), F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"), F.col("_text").alias(text))


def cut_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """The documents with their own columns, texts that lose words replaced by their kept words.

    Texts that lose nothing stay as they are; texts that lose every word go.
    """
    rest = tuple(c for c in docs.columns if c not in (key, text))
    cut = _cut(docs, key, text, size, rest, False).where((F.col("_removed") == 0) | (F.col("_removed") < F.col("_words")))
    now = {key: "_key", text: "_text"} | {c: f"_keep{i}" for i, c in enumerate(rest)}
    return cut.select(*(F.col(now[c]).alias(c) for c in docs.columns))
