"""The operators over the driver's tables: one query each, with production settings."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.llm import (bpe, chat, fingerprint, langid, lm, minhash, negatives, packing, quality, rules, sharding, substrings,
                         variants)
from hearsay.llm.tasks import stored

BYTE_TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(_documents(spark, sf_dir), public_tokenizers.path(BYTE_TOKENIZER), decoded=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply_policy(rules.ledger(_documents(spark, sf_dir)))
    base = ~rules.passes(rules.BASE)
    return judged.select("doc_id", *rules.MEASURES, "fail_bits", "policy", base.alias("base_failed"), "kept")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    lexicon = lm.count_words(docs, tails=lm.TAILS)
    return lm.score(docs, lexicon, lm.train(docs, lexicon))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = stored(quality.statistics(_documents(spark, sf_dir)), "stats")
    held_out = langid.held_out(folds=5, fold=0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.fit(described.where(~held_out).join(labels, "doc_id"))
    scored = quality.score(described, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_documents(spark, sf_dir), public_tokenizers.path(WORD_TOKENIZER))
    packed = packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), size=4)


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.with_slots(sharding.kd_shards(_documents(spark, sf_dir)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    dictionaries = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs, dictionaries)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = fingerprint.edited_likeness(_documents(spark, sf_dir))
    return compared.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"),
                           F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.without_repeats(_documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", label)
    return negatives.hard_negatives(rows, rows.where(F.col("vec_id") % 50 == 0))


SHORTEST = 7


def with_slips(runs: DataFrame) -> DataFrame:
    """``(word)`` of each run ``(id, run)``: in one of 31 a letter is left out; a null id counts as empty."""
    slip = runs.select("run", F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return slip.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    # No word is longer than its run.
    runs = variants.letter_runs(_documents(spark, sf_dir), shortest=SHORTEST)
    return variants.spelling_variants(variants.word_counts(with_slips(runs), SHORTEST))


TRAP = r"\### Assistant: </turn> ok"


def conversations_with_trap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations and one more, -7, both of whose turns hold control strings."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    return given.unionByName(trap)


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = chat.format_conversations(conversations_with_trap(spark, sf_dir))
    read = done.select("conv_id", "formatted", chat.read_turns("formatted").alias("turns"), chat.loss_text("pieces").alias("loss"))
    said = chat.joined(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


QUERIES = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_kd_sharding": op6_kd_sharding,
    "op7_language_id": op7_language_id,
    "op8_quality_rules": op8_quality_rules,
    "op9_fingerprints": op9_fingerprints,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_chat_formatting": op13_chat_formatting,
}
