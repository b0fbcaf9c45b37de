"""Registered queries of this package, with DuckDB counterparts where SQL can express them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bugloom.llm import fingerprints as fp
from bugloom.llm import (
    hard_negatives,
    html_cut,
    line_rules,
    mixing,
    ngram_join,
    packing,
    quality_gam,
    sharding,
    token_records,
    toxicity,
    turn_repair,
    warc,
)
from bugloom.llm.common import new_folder, table
from bugloom.llm.oracles import OP2_SQL, OP5_SQL, OP6_SQL, OP7_SQL, OP11_SQL


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of all documents and their edited texts, with likeness to those and the next."""
    found = fp.fingerprints(table(spark, sf_dir, "documents"))
    own, changed, following = F.col("hashes"), F.col("edited_hashes"), F.col("next_hashes")
    return found.select(
        "doc_id",
        F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        fp.to_text(own).alias("fingerprint"),
        fp.to_text(changed).alias("edited_fingerprint"),
        fp.likeness(own, changed).alias("near_edited"),
        fp.likeness(own, following).alias("near_next"),
        fp.containment(own, changed).alias("contained_in_edited"),
        fp.containment(own, following).alias("contained_in_next"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as segmented, chunked records and read back."""
    folder = new_folder(spark, "warc")
    warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    found = warc.read_warc(spark, folder)
    own = F.col("type") == "response"
    return found.select(
        "page_id",
        F.when(own, F.octet_length("payload")).otherwise(F.col("payload_length"))
        .cast("bigint").alias("payload_bytes"),
        F.when(own, warc.base32_sha1(F.col("payload"))).otherwise(F.col("digest"))
        .alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )


def _scores(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, restored by the noisy-channel decoder."""
    return _scores(toxicity.scored(
        table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    ))


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by lookup tables."""
    return _scores(quality_gam.scored(
        table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    ))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document, in words."""
    sizes = table(spark, sf_dir, "documents").select(
        "doc_id", "source", mixing.word_count(F.col("text")).alias("size")
    )
    return mixing.repetitions(sizes).select(
        "doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken")
    )


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the line rules' verdict on every document."""
    return line_rules.cleaned(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "lost_chars",
    )


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingles are alike by 0.8 or more."""
    return ngram_join.components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_shingles", "component_id"
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in windows of 2,048."""
    return packing.packed(table(spark, sf_dir, "documents"))


def op9_html_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html_cut.extracted(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", "n_chars"
    )


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens written as records, read back and indexed."""
    folder = new_folder(spark, "records")
    token_records.write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    index = token_records.write_index(spark, folder, new_folder(spark, "record-index"))
    return token_records.with_starts(index).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector by cover trees over all vectors."""
    rows = hard_negatives.candidates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return hard_negatives.mined(hard_negatives.relabelled(rows), F.col("vec_id") % 100 == 0)


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of all damaged conversations."""
    return turn_repair.repairs(turn_repair.damaged(
        spark.read.parquet(f"{sf_dir}/conversations.parquet")
    ))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, texts included, in eight shuffled shards of equal numbers of rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.digest_columns(sharding.sharded(docs))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_quality_gam": op4_quality_gam,
    "op5_mixing": op5_mixing,
    "op6_line_rules": op6_line_rules,
    "op7_ngram_join": op7_ngram_join,
    "op8_packing": op8_packing,
    "op9_html_cut": op9_html_cut,
    "op10_token_records": op10_token_records,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_turn_repair": op12_turn_repair,
    "op13_sharding": op13_sharding,
}

ORACLES: dict[str, str] = {
    "op2_warc": OP2_SQL,
    "op5_mixing": OP5_SQL,
    "op6_line_rules": OP6_SQL,
    "op7_ngram_join": OP7_SQL,
    "op11_hard_negatives": OP11_SQL,
}
