"""Recordings: listing, extraction that survives failures, polling a folder."""

import os

import pytest

from hearsay.plans.ingest import ingest_sources, transcript_stage
from hearsay.sources.media import TranscriptStage, list_sources, text_file_extractor
from hearsay.sources.store import IndexStore
from hearsay.streaming.ingest import ingest_media_stream


def record(folder, names, text="ice hockey {}"):
    os.makedirs(folder, exist_ok=True)
    for n in names:
        with open(f"{folder}/{n}", "w") as out:
            out.write(text.format(n))


def counting(log, bad=(), crash=()):
    """An extractor that notes each file it is given, fails on some, and takes its worker down on others."""
    def make():
        plain = text_file_extractor()

        def extract(path):
            with open(log, "a") as out:
                out.write(path.rsplit("/", 1)[1] + "\n")
            if path.endswith(tuple(crash) or "\0"):
                os._exit(1)
            if path.endswith(tuple(bad) or "\0"):
                raise ValueError("cannot decode")
            return plain(path)
        return extract
    return make


def noted(log):
    with open(log) as lines:
        return sorted(lines.read().split())


def test_only_direct_children_are_listed(spark, workdir):
    folder = workdir + "/a [x] {y}"
    record(folder, ["one.mp4", "two two.mp4", "three+%20.mp4", "four.txt"])
    record(folder + "/sub", ["deep.mp4"])
    record(folder + "/k=v", ["deep.mp4"])
    record(folder + "/dir.mp4", ["deep.mp4"])
    record(workdir + "/a qxq qyq", ["other.mp4"])      # matches the loose pattern
    assert sorted(r["file"] for r in list_sources(spark, folder).collect()) == sorted(
        f"{folder}/{n}" for n in ("one.mp4", "two two.mp4", "three+%20.mp4"))
    os.makedirs(workdir + "/none")
    assert list_sources(spark, workdir + "/none").count() == 0
    assert list_sources(spark, workdir + "/absent").count() == 0


def test_one_failing_file_of_fifty(spark, workdir):
    record(workdir + "/m", [f"{i:02d}.mp4" for i in range(50)])
    store = IndexStore(spark, workdir + "/ix", []).create()
    sources, log = list_sources(spark, workdir + "/m"), workdir + "/log"
    assert ingest_sources(store, sources, counting(log, bad=["17.mp4"])) == 49
    errors = [tuple(r) for r in transcript_stage(store).errors().collect()]
    assert errors == [(f"{workdir}/m/17.mp4", "ValueError: cannot decode", 1)]
    assert len(noted(log)) == 50
    again = workdir + "/again"
    assert ingest_sources(store, sources, counting(again)) == 1
    assert noted(again) == ["17.mp4"] and transcript_stage(store).errors().count() == 0
    assert store.documents().count() == 50
    assert ingest_sources(store, sources, counting(again)) == 0 and noted(again) == ["17.mp4"]


def test_what_a_failed_run_extracted_is_kept(spark, workdir):
    record(workdir + "/m", [f"{i:02d}.mp4" for i in range(30)])
    store = IndexStore(spark, workdir + "/ix", []).create()
    sources, log = list_sources(spark, workdir + "/m"), workdir + "/log"
    with pytest.raises(Exception):
        ingest_sources(store, sources, counting(log, crash=["17.mp4"]), num_tasks=30)
    assert store.documents().count() == 0
    kept = {r["file"] for r in transcript_stage(store).transcripts().collect()}
    assert 0 < len(kept) < 30
    again = workdir + "/again"
    assert ingest_sources(store, sources, counting(again)) == 30
    assert noted(again) == sorted({f"{i:02d}.mp4" for i in range(30)} - {f.rsplit("/", 1)[1] for f in kept})


def test_extraction_after_an_interrupted_append_is_not_repeated(spark, workdir, monkeypatch):
    record(workdir + "/m", ["a.mp4", "b.mp4"])
    store = IndexStore(spark, workdir + "/ix", []).create()
    sources, log = list_sources(spark, workdir + "/m"), workdir + "/log"
    with monkeypatch.context() as patch:
        patch.setattr(IndexStore, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            ingest_sources(store, sources, counting(log), "b1")
    assert ingest_sources(store, sources, counting(log), "b1") == 2
    assert noted(log) == ["a.mp4", "b.mp4"]
    stage = transcript_stage(store)
    assert len(stage.vacuum(store.documents())) == 1 and stage.transcripts().count() == 0


def test_stage_without_rows(spark, workdir):
    stage = TranscriptStage(spark, workdir + "/stage")
    assert stage.transcripts().count() == 0 and stage.errors().count() == 0 and stage.vacuum(spark.createDataFrame([], "file string")) == []
    stage.extract(spark.createDataFrame([], "file string"), text_file_extractor)
    assert stage.transcripts().count() == 0


def test_a_polled_folder_is_extracted_once_across_two_checkpoints(spark, workdir):
    folder, log = workdir + "/m", workdir + "/log"
    store = IndexStore(spark, workdir + "/ix", []).create()

    def poll(checkpoint, **bad):
        ingest_media_stream(spark, folder, store, counting(log, **bad), workdir + checkpoint).awaitTermination()

    record(folder, ["a.mp4", "b.mp4", "x.txt"])
    poll("/c1")
    assert store.documents().count() == 2
    record(folder, ["c.mp4"])
    record(folder + "/sub", ["deep.mp4"])
    poll("/c1")
    poll("/c1")                                         # nothing new
    assert store.documents().count() == 3
    record(folder, ["d.mp4", "e.mp4"])
    poll("/c2", bad=["e.mp4"])                          # a new checkpoint sees every file again
    assert noted(log) == ["a.mp4", "b.mp4", "c.mp4", "d.mp4", "e.mp4"]
    assert store.documents().count() == 4
    record(folder, ["f.mp4"])
    poll("/c1")                                         # the failed file is tried again
    assert noted(log)[-4:] == ["d.mp4", "e.mp4", "e.mp4", "f.mp4"]
    assert sorted(r["file"][-5:] for r in store.documents().collect()) == [f"{c}.mp4" for c in "abcdef"]


def test_a_polled_folder_is_not_listed_on_the_driver(spark, workdir):
    folder = workdir + "/a [x] {y}"
    record(folder, ["one.mp4", "two two.mp4", "three+%20.mp4", "four.txt", "_x.mp4", ".y.mp4", "_k=v.mp4"])
    record(folder, ["empty.mp4"], "")
    record(folder + "/sub.mp4", ["deep.mp4"])
    store, log = IndexStore(spark, workdir + "/ix", []).create(), workdir + "/log"
    plans = []

    def noting(batch, epoch):
        plans.append(batch._jdf.queryExecution().optimizedPlan().toString())
        got.update(r["file"] for r in batch.collect())

    from hearsay.streaming.sources import media_stream

    got = set()
    media_stream(spark, folder).writeStream.foreachBatch(noting).option("checkpointLocation", workdir + "/c").trigger(availableNow=True).start().awaitTermination()
    assert got == {f"{folder}/{n}" for n in ("one.mp4", "two two.mp4", "three+%20.mp4", "_k=v.mp4")}
    assert got == {r["file"] for r in list_sources(spark, folder).collect()}
    assert len(plans) == 1 and "binaryFile" not in plans[0] and "path#" not in plans[0]
    assert not os.path.exists(workdir + "/c/sources")          # the file source writes every name there
    ingest_media_stream(spark, folder, store, counting(log), workdir + "/c1").awaitTermination()
    assert {r["file"] for r in store.documents().collect()} == got
    record(folder, ["empty.mp4"])                               # filled since
    ingest_media_stream(spark, folder, store, counting(log), workdir + "/c1").awaitTermination()
    with open(log) as lines:
        assert store.documents().count() == 5 and len(list(lines)) == 5


def test_a_failing_recording_is_not_tried_for_ever(spark, workdir):
    folder, log = workdir + "/m", workdir + "/log"
    store = IndexStore(spark, workdir + "/ix", []).create()
    for i in range(4):
        record(folder, [f"{i}.mp4", "bad.mp4"])
        ingest_media_stream(spark, folder, store, counting(log, bad=["bad.mp4"]), workdir + "/c", tries=2).awaitTermination()
    assert noted(log) == ["0.mp4", "1.mp4", "2.mp4", "3.mp4", "bad.mp4", "bad.mp4"]
    assert store.documents().count() == 4


def test_a_limit_of_files_to_an_epoch(spark, workdir):
    folder, log = workdir + "/m", workdir + "/log"
    store = IndexStore(spark, workdir + "/ix", []).create()
    record(folder, ["a.mp4", "b.mp4", "c.mp4"])
    ingest_media_stream(spark, folder, store, counting(log), workdir + "/c", max_files=2).awaitTermination()
    assert sorted(r["n_documents"] for r in store._commit_rows()) == [1, 2] and noted(log) == ["a.mp4", "b.mp4", "c.mp4"]


def test_very_many_files_make_longer_tasks(spark, workdir, monkeypatch):
    from hearsay.sources import media

    os.makedirs(f"{workdir}/many")
    for i in range(60):
        with open(f"{workdir}/many/{i}.txt", "w") as f:
            f.write(f"word{i}")
    monkeypatch.setattr(media, "FILES_PER_TASK", 1)
    monkeypatch.setattr(media, "TASKS_PER_CORE", 2)
    got = media.extract_transcripts(media.list_sources(spark, f"{workdir}/many", "txt"), media.text_file_extractor)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {2 * spark.sparkContext.defaultParallelism}," in plan
    assert sorted(r["transcript"] for r in got.collect()) == sorted(f"word{i}" for i in range(60))
