"""The index as Parquet tables under one folder, with numbered commits.

Layout under ``root``::

    documents/batch_id=<folder>/          (file, transcription, term_frequencies, num_terms, doc)
    paths/batch_id=<folder>/bucket=<p>/   (file, digest, doc): known paths, and names by document number
    postings/batch_id=<folder>/bucket=<b>/  (term, file, tf_count, num_terms, doc, block), by (term, doc) in stripes of blocks
    blocks/batch_id=<folder>/bucket=<b>/  (term, block, n, max_tf): postings of a term in a block, and the best tf
    lexicon/batch_id=<folder>/bucket=<b>/ (term, df) of that batch
    commits/<number>.json                 one row per batch, written last; a merge's row lists what it replaces
    settings/                             stop-word list and number of buckets, fixed when the index is created

A term's bucket is its hash modulo the number of buckets: look-ups prune to the
buckets of their terms, tables of queries by dynamic pruning. A document's
number is given within its batch as it is written; a block is 2**BLOCK_BITS
consecutive numbers. Documents are written in order of ``num_terms`` within each
task, so a block's documents are about equally long and its best tf is close to all.

Several tables cannot be appended atomically together, so every attempt at a
batch writes folders of its own, named ``<batch>.<attempt>``, and its commit
names them. Readers only see folders that a commit names: a crash leaves nothing
visible, and a replay starts afresh, whatever was left behind.

Two writers: a commit takes the next number by a rename that never replaces a
file. Who loses the number looks at what was committed meanwhile, and starts
again where that took one of the same paths.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.functions.tfidf import tf
from hearsay.operators import indexing as ix
from hearsay.plans.index import BLOCK_BITS, BlockIndex, TfIdfIndex, bucket_of
from hearsay.session import default_parallelism, scratch_path

TERM_BUCKETS = 32
TASK_POSTINGS = 1_500_000       # what a task sorts and writes, on average
LEAST_POSTINGS = 50_000         # fewer are not worth another task
TASK_BITS = 33                  # document numbers of one writing task differ in as many lower bits
TASK_STRIPES = 4                # stripes dealt to a task, on average: more of them are dealt more evenly

COMMITS_SCHEMA = T.StructType([
    T.StructField("number", T.LongType(), False),
    T.StructField("n_documents", T.LongType(), False),
    T.StructField("n_postings", T.LongType(), False),
    T.StructField("replaces", T.ArrayType(T.StringType(), False), False),
    T.StructField("folder", T.StringType(), False),
    T.StructField("batch_id", T.StringType(), False),
])

SETTINGS_SCHEMA = T.StructType([
    T.StructField("stop_words", T.ArrayType(T.StringType(), False), False),
    T.StructField("term_buckets", T.IntegerType(), False),
])


def _table(own: T.StructType | None, bucketed: bool, **more: T.DataType) -> T.StructType:
    fields = list(own.fields) if own else []
    fields += [T.StructField(name, kind, False) for name, kind in more.items()]
    fields.append(T.StructField("batch_id", T.StringType(), False))
    return T.StructType(fields + ([T.StructField("bucket", T.IntegerType(), False)] if bucketed else []))


_TEXT, _LONG = T.StringType(), T.LongType()
TABLES = {
    "documents": _table(ix.DOCUMENTS_SCHEMA, False, doc=_LONG),
    "paths": _table(None, True, file=_TEXT, digest=_LONG, doc=_LONG),
    "postings": _table(ix.POSTINGS_SCHEMA, True, doc=_LONG, block=_LONG),
    "blocks": _table(None, True, term=_TEXT, block=_LONG, n=_LONG, max_tf=T.DoubleType()),
    "lexicon": _table(ix.LEXICON_SCHEMA, True),
}

# Of postings as they are written: a block's first has these, the others null.
BLOCK_FIELDS = T.StructType([T.StructField("n", T.LongType(), True), T.StructField("max_tf", T.DoubleType(), True)])


class CommitConflict(Exception):
    """Another writer took the number of a commit."""


class IndexStore:
    """A TF-IDF index kept as path-based Parquet tables (no catalog needed)."""

    def __init__(self, spark: SparkSession, root: str, stop_words: Iterable[str] | None = None,
                 postings_partitions: int | None = None, term_buckets: int = TERM_BUCKETS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.stop_words = None if stop_words is None else list(stop_words)
        self.postings_partitions = postings_partitions
        self._fixed: Row | None = None
        self.term_buckets = term_buckets        # of an index created here; an existing one keeps its own

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    # ---- S4 -------------------------------------------------------------
    def create(self) -> IndexStore:
        """Create the index if absent; an existing one is kept (mode ignore)."""
        self._fs(self.path("commits")).mkdirs(self._hadoop_path(self.path("commits")))
        from hearsay.functions.stopwords import ENGLISH_STOP_WORDS

        words = list(ENGLISH_STOP_WORDS) if self.stop_words is None else self.stop_words
        self.spark.createDataFrame([(words, self.term_buckets)], SETTINGS_SCHEMA).coalesce(1).write.mode("ignore").parquet(
            self.path("settings"))
        return self

    def _settings(self) -> Row:
        """What the index was created with; later appends must use the same. It never changes, so it is read once."""
        if self._fixed is None:
            self._fixed = self.spark.read.schema(SETTINGS_SCHEMA).parquet(self.path("settings")).first()
        return self._fixed

    def settings_stop_words(self) -> list[str]:
        return list(self._settings()["stop_words"])

    # ---- commits -----------------------------------------------------------
    def _hadoop_path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._hadoop_path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> DataFrame:
        return self.spark.read.schema(COMMITS_SCHEMA).json(self.path("commits"))

    def _commit_rows(self) -> list[Row]:
        """Commit rows are metadata (one per ingest or merge), not data."""
        return sorted(self.commits().collect(), key=lambda r: r["number"])

    @staticmethod
    def _visible(rows: list[Row]) -> list[Row]:
        replaced = {b for r in rows for b in r["replaces"]}
        return sorted((r for r in rows if r["batch_id"] not in replaced), key=lambda r: r["batch_id"])

    def visible_batches(self) -> list[Row]:
        """Commit rows of the visible batches: committed, not replaced by a merge."""
        return self._visible(self._commit_rows())

    def committed_ids(self) -> list[str]:
        return [r["batch_id"] for r in self.visible_batches()]

    def is_committed(self, batch_id: str) -> bool:
        return any(r["batch_id"] == batch_id for r in self._commit_rows())

    def _commit(self, number: int, batch_id: str, folder: str, n: int, n_postings: int, replaces: list[str]) -> None:
        """Take ``number`` with a whole file, or raise ``CommitConflict``: a rename that replaces nothing."""
        jvm = self.spark.sparkContext._jvm
        row = {"number": number, "n_documents": n, "n_postings": n_postings, "replaces": replaces,
               "folder": folder, "batch_id": batch_id}
        draft = self._hadoop_path(f"{self.path('commits')}/_{uuid.uuid4().hex}")
        out = self._fs(self.path("commits")).create(draft, False)
        out.write(bytearray(json.dumps(row).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            draft.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getUri(),
            self.spark.sparkContext._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(draft, self._hadoop_path(f"{self.path('commits')}/{number:020d}.json"), plain)
        except Py4JJavaError as refused:
            files.delete(draft, False)
            if "FileAlreadyExists" in refused.java_exception.getClass().getName():
                raise CommitConflict(number) from None
            raise

    # ---- reads (S6) ---------------------------------------------------------
    def _rows_for(self, ids: list[str] | None) -> list[Row]:
        rows = self.visible_batches()
        return rows if ids is None else [r for r in rows if r["batch_id"] in set(ids)]

    def _committed(self, table: str, rows: list[Row]) -> DataFrame:
        """Only the folders of the given committed batches are listed and read.

        Uncommitted, replaced or empty batch folders are never listed, so the
        cost of opening an index follows its visible batches, not its history.
        """
        need = "n_documents" if table in ("documents", "paths") else "n_postings"
        return self._folders(table, [r["folder"] for r in rows if r[need] > 0])

    def _folders(self, table: str, folders: list[str], more: T.StructType | None = None) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], TABLES[table])
        schema = T.StructType(TABLES[table].fields + (more.fields if more else []))
        return (self.spark.read.schema(schema).option("basePath", self.path(table))
                .parquet(*(f"{self.path(table)}/batch_id={f}" for f in folders)))

    def documents(self, ids: list[str] | None = None) -> DataFrame:
        return self._committed("documents", self._rows_for(ids)).select(*ix.DOCUMENTS_SCHEMA.names)

    def postings(self, ids: list[str] | None = None) -> DataFrame:
        return self._committed("postings", self._rows_for(ids)).select(*ix.POSTINGS_SCHEMA.names)

    @staticmethod
    def _sum_df(per_batch: DataFrame) -> DataFrame:
        return per_batch.groupBy("term").agg(F.sum("df").cast("bigint").alias("df"))

    def lexicon(self, ids: list[str] | None = None) -> DataFrame:
        """df per term over the committed batches (batches hold disjoint files)."""
        return self._sum_df(self._committed("lexicon", self._rows_for(ids)))

    def index(self) -> TfIdfIndex:
        """One consistent snapshot: all tables see the same committed batches.

        N is the sum of the batches' document counts from their commit rows.
        """
        rows = self.visible_batches()
        n = sum(r["n_documents"] for r in rows)
        n_df = self.spark.range(1).select(F.lit(n).cast("bigint").alias("n_documents"))
        place = F.array_position(F.array(*(F.lit(r["folder"]) for r in rows)).cast("array<string>"), F.col("batch_id")).cast("int")

        def numbered(table: str) -> DataFrame:
            return self._committed(table, rows).withColumn("batch", place).drop("batch_id")

        postings, lexicon = numbered("postings"), self._committed("lexicon", rows).select("term", "df", "bucket")
        blocks = BlockIndex(postings, numbered("blocks"), lexicon, numbered("paths").select("batch", "doc", "file", "bucket"),
                            self._settings()["term_buckets"], sum(r["n_postings"] for r in rows))
        documents = self._committed("documents", rows).select(*ix.DOCUMENTS_SCHEMA.names)
        return TfIdfIndex(documents, postings.select(*ix.POSTINGS_SCHEMA.names), self._sum_df(lexicon), n_df, blocks)

    def counted(self) -> tuple[DataFrame, DataFrame]:
        """``(term, df)`` of one snapshot, and ``(file, digest)`` of the documents counted there."""
        rows = self.visible_batches()
        return self._sum_df(self._committed("lexicon", rows)), self.known_files(rows)

    # ---- S5 / U2 --------------------------------------------------------
    def known_files(self, rows: list[Row]) -> DataFrame:
        """``(file, digest)`` of the given committed batches; no transcript is read."""
        return self._committed("paths", rows).select("file", "digest")

    def fresh_rows(self, corpus: DataFrame, rows: list[Row]) -> DataFrame:
        """J2 for a batch: rows of ``corpus`` whose file is new, one per file.

        Rows without a transcript go first. One pass over the corpus decides on
        paths alone: which repeat, which are known (by digest and path; AQE and
        Spark's runtime filters see the sizes). Only the smaller of the two sets
        of paths, those to take or those to leave, then meets the transcripts;
        none does if every row is to be taken. Of repeated paths the smallest
        transcript stays.
        """
        with_text = corpus.where(F.col("transcript").isNotNull()).select("file", "transcript")
        paths = with_text.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
        if rows:
            known = self.known_files(rows).select("file", "digest", F.lit(True).alias("known"))
            paths = paths.withColumn("digest", F.xxhash64("file")).join(known, ["digest", "file"], "left").select("file", "n", "known")
        else:
            paths = paths.withColumn("known", F.lit(None).cast("boolean"))
        decided = scratch_path(self.spark, "paths")
        paths.write.parquet(decided)
        decided = self.spark.read.schema("file string, n long, known boolean").parquet(decided)
        new = F.col("known").isNull()
        take, many, leave = decided.agg(*(F.count_if(c) for c in (new & (F.col("n") == 1), new & (F.col("n") > 1), ~new))).first()
        once = with_text
        if take < many + leave:
            once = with_text.join(decided.where(new & (F.col("n") == 1)).select("file"), "file", "left_semi")
        elif many + leave:
            once = with_text.join(decided.where(~new | (F.col("n") > 1)).select("file"), "file", "left_anti")
        if not many:
            return once
        repeated = with_text.join(decided.where(new & (F.col("n") > 1)).select("file"), "file", "left_semi")
        return once.unionByName(repeated.groupBy("file").agg(F.min("transcript").alias("transcript")))

    def append(self, corpus: DataFrame, batch_id: str, assume_new: bool = False) -> int:
        """Index the new files of ``corpus`` as batch ``batch_id``; returns how many.

        Safe to repeat: a committed batch is not redone, an uncommitted one
        starts afresh in folders of its own. Files already in other committed batches are
        skipped (path equality only); each path is taken once.
        ``assume_new`` skips that check for a corpus already reduced to new,
        distinct paths (``ingest_sources`` does it on paths before extraction,
        so the extractor is not run for a check); a second writer's paths are
        still looked at when both commit.
        """
        while True:
            rows = self._commit_rows()
            if any(r["batch_id"] == batch_id for r in rows):   # committed, maybe merged since
                return 0
            visible = self._visible(rows)
            # Committed batches only: never this batch's own rows.
            fresh = corpus if assume_new else self.fresh_rows(corpus, visible)
            folder = self._attempt(batch_id)
            n, n_postings = self._write_batch(ix.build_documents(fresh, self._stop_words()), folder)
            while True:
                try:
                    self._commit(self._next(rows), batch_id, folder, n, n_postings, [])
                    return n
                except CommitConflict:
                    before, rows = {r["batch_id"] for r in rows}, self._commit_rows()
                    if any(r["batch_id"] == batch_id for r in rows):
                        return 0
                    others = [r for r in self._visible(rows) if r["batch_id"] not in before]
                    mine = self._folders("paths", [folder] if n else []).select("file", "digest")
                    if mine.join(self.known_files(others), ["digest", "file"], "left_semi").limit(1).count():
                        assume_new = False
                        break       # start again without the paths that the other writer has

    @staticmethod
    def _next(rows: list[Row]) -> int:
        return max((r["number"] for r in rows), default=0) + 1

    @staticmethod
    def _attempt(batch_id: str) -> str:
        return f"{batch_id}.{uuid.uuid4().hex[:12]}"

    def _stop_words(self) -> list[str]:
        """The list fixed when the index was created; another one given on reopening is an error."""
        fixed = self.settings_stop_words()
        if self.stop_words is not None and list(self.stop_words) != fixed:
            raise ValueError("the index was created with another stop-word list")
        return fixed

    def _write(self, df: DataFrame, table: str, folder: str, more: T.StructType | None = None) -> DataFrame:
        """Write one table of a batch and read it back from its own folder, with the columns ``more`` besides its own."""
        out = f"{self.path(table)}/batch_id={folder}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy("bucket") if "bucket" in df.columns else writer).parquet(out)
        return self._folders(table, [folder], more)

    def _by_bucket(self, df: DataFrame, *columns: str) -> DataFrame:
        """Few files to a bucket, none of them unbounded: AQE splits large buckets and puts small ones together; sorted."""
        count = self.postings_partitions
        dealt = df.repartition(count, "bucket") if count else df.hint("rebalance", F.col("bucket"))
        return dealt.sortWithinPartitions("bucket", *columns)

    def _striped(self, postings: DataFrame, n: int) -> DataFrame:
        """``n`` postings with their block, by bucket and stripe, sorted by term and number within; each block's first has its ``n`` and ``max_tf``.

        A stripe of a bucket has the postings of some blocks: a hot term lies in several files, and the postings
        of a term in a block in one task, which counts them without another shuffle. The number of
        tasks follows ``n``, so that none sorts more than memory holds however large a batch is.
        """
        fewest = min(default_parallelism(self.spark), -(-n // LEAST_POSTINGS))
        tasks = self.postings_partitions or max(1, fewest, -(-n // TASK_POSTINGS))
        stripes = max(min(tasks, 2), -(-tasks * TASK_STRIPES // self._settings()["term_buckets"]))
        # Blocks in turn, and from task to task (the upper bits of its numbers) one further.
        block, bucket = F.shiftright("doc", BLOCK_BITS), bucket_of("term", self._settings()["term_buckets"])
        turn = F.pmod(block + F.shiftright("doc", TASK_BITS), F.lit(stripes)).cast("int")
        # What follows from a row's term and number is not shuffled with it.
        dealt = postings.repartition(tasks, bucket, turn).withColumns({"block": block, "bucket": bucket, "stripe": turn})
        met = Window.partitionBy("bucket", "stripe", "term", "block").orderBy("doc").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)
        first = F.col("doc") == F.min("doc").over(met)
        best = F.max(tf(F.col("tf_count"), F.col("num_terms"))).over(met)
        return (dealt.withColumns({"n": F.when(first, F.count(F.lit(1)).over(met)), "max_tf": F.when(first, best)})
                .sortWithinPartitions("bucket", "stripe", "term", "block", "doc").drop("stripe"))

    def _write_batch(self, documents: DataFrame, folder: str) -> tuple[int, int]:
        """Write all tables of a batch; returns the numbers of documents and postings.

        Both are counted from the written files, not from task accumulators, so
        retried tasks cannot skew them. Postings come from the written
        documents' term maps: transcripts are not tokenised twice. Blocks come
        from the written postings, in the order in which these lie.
        """
        buckets = self._settings()["term_buckets"]
        numbered = documents.sortWithinPartitions("num_terms").withColumn("doc", F.monotonically_increasing_id())
        written = self._write(numbered, "documents", folder)
        block = F.shiftright("doc", BLOCK_BITS)
        paths = written.select("file", F.xxhash64("file").alias("digest"), "doc", F.pmod(block, F.lit(buckets)).cast("int").alias("bucket"))
        self._write(self._by_bucket(paths, "doc"), "paths", folder)
        n, n_terms = written.agg(F.count(F.lit(1)), F.sum("num_terms")).first()
        postings = self._striped(ix.postings_from_documents(written, "doc"), n_terms or 0)
        postings = self._write(postings, "postings", folder, BLOCK_FIELDS)
        blocks = postings.where(F.col("n").isNotNull()).select("bucket", "term", "block", "n", "max_tf")
        blocks = self._write(blocks.sortWithinPartitions("bucket", "term", "block"), "blocks", folder)
        lexicon = blocks.groupBy("bucket", "term").agg(F.sum("n").alias("df"))
        lexicon = self._write(self._by_bucket(lexicon, "term"), "lexicon", folder)
        n_postings = lexicon.agg(F.sum("df")).first()[0] or 0
        # What this batch shuffled would else lie on the executors' disks until the driver happens to collect its garbage.
        self.spark.sparkContext._jvm.System.gc()
        return n, n_postings

    # ---- maintenance ------------------------------------------------------
    def compact(self, batch_id: str | None = None) -> str | None:
        """Rewrite all visible batches as one; one commit switches.

        Many small batches (a stream's micro-batches) mean many small files
        and weak pruning by term. ``compact_tiers`` rewrites less.
        """
        rows = self.visible_batches()
        return self._merge(rows, batch_id) if len(rows) > 1 else None

    def compact_tiers(self, fan_in: int = 4) -> list[str]:
        """Merge batches of like size, ``fan_in`` or more at once, until no tier has as many.

        A batch's tier is the logarithm of its size (documents and postings) to
        the base ``fan_in``; merged batches are at least a tier higher. So a row
        is rewritten once for each tier at most, however many batches come. Where
        a merge fills the tier that it comes to, that one is merged with it at once.
        Returns the ids of the merged batches.
        """
        made = []
        while True:
            tiers: dict[int, list[Row]] = {}
            for r in self.visible_batches():
                tiers.setdefault(self._tier(r["n_documents"] + r["n_postings"], fan_in), []).append(r)
            full = [tier for tier, rows in sorted(tiers.items()) if len(rows) >= fan_in]
            if not full:
                return made
            rows = tiers.pop(full[0])
            # Batches hold disjoint files, so the sizes add up. A merge that would only be merged again takes that tier, too.
            while len(more := tiers.pop(self._tier(sum(r["n_documents"] + r["n_postings"] for r in rows), fan_in), [])) + 1 >= fan_in:
                rows = rows + more
            merged = self._merge(rows, None)
            if merged is None:
                return made
            made.append(merged)

    @staticmethod
    def _tier(size: int, fan_in: int) -> int:
        tier = 0
        while size >= fan_in ** (tier + 1):
            tier += 1
        return tier

    def _merge(self, rows: list[Row], batch_id: str | None) -> str | None:
        """Rewrite the given batches as one whose commit names them.

        Readers move from the old set to the new one at a single write; a crash
        before it leaves the old set visible. None if another writer merged one
        of them meanwhile.
        """
        new_id = batch_id or f"compact-{uuid.uuid4().hex}"
        folder = self._attempt(new_id)
        documents = self._committed("documents", rows).select(*ix.DOCUMENTS_SCHEMA.names)
        n, n_postings = self._write_batch(documents, folder)
        # What the replaced batches replaced is named too, so that dropping their
        # commits brings nothing back.
        replaces = {b for r in rows for b in (r["batch_id"], *r["replaces"])}
        while True:
            now = self._commit_rows()
            if not {r["batch_id"] for r in rows} <= {r["batch_id"] for r in self._visible(now)}:
                return None
            try:
                self._commit(self._next(now), new_id, folder, n, n_postings, sorted(replaces))
                return new_id
            except CommitConflict:
                continue

    def vacuum(self) -> list[str]:
        """Delete the folders (and commits) of batches that a committed merge replaced."""
        rows = self._commit_rows()
        replaced = {b for r in rows for b in r["replaces"]}
        gone = sorted((r for r in rows if r["batch_id"] in replaced), key=lambda r: r["batch_id"])

        def delete(path: str) -> None:
            self._fs(path).delete(self._hadoop_path(path), True)

        # A visible batch names all that it stands for, so any order of deletion
        # shows the same snapshot. A commit goes last: until then a rerun still
        # finds its folder.
        for r in gone:
            for table in TABLES:
                delete(f"{self.path(table)}/batch_id={r['folder']}")
            delete(f"{self.path('commits')}/{r['number']:020d}.json")
        return [r["batch_id"] for r in gone]


# ---- the inventory's function names -----------------------

def create_index(spark: SparkSession, path: str, stop_words: Iterable[str] | None = None) -> IndexStore:
    """Create both (all) empty tables if absent; existing ones are kept."""
    return IndexStore(spark, path, stop_words).create()


def append_documents(store: IndexStore, corpus: DataFrame, batch_id: str) -> int:
    """Index the new files of ``corpus`` as one committed batch; returns how many."""
    return store.append(corpus, batch_id)


def scan_documents(store: IndexStore) -> DataFrame:
    """The committed documents table."""
    return store.documents()


def scan_terms(store: IndexStore, chunk_size: int = 10_000) -> DataFrame:
    """The term → documents table, as the chunked array view of the postings."""
    rows = store.visible_batches()
    postings = store._committed("postings", rows).select(*ix.POSTINGS_SCHEMA.names)
    return ix.inverted_index(postings, chunk_size, store._sum_df(store._committed("lexicon", rows)))
