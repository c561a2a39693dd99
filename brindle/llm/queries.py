"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import ball_kmeans, decontamination, filtering_lloyd, html_text, line_templates, minhash, mixing, oracles, pii, quality, secrets, sharding, token_store, toxicity
from brindle.llm.common import read, scratch_folder

#: Production parameters of the placement query.
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))

#: The id that ends each document.
END_ID = 2


def tokenizer_path() -> str:
    """The vocabulary file of the token queries; it stays where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bit_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "tokens")
    token_store.write_tokens(read(spark, sf_dir, "documents"), folder, tokenizer_path(), end_id=END_ID)
    return token_store.read_tokens(spark, folder)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text is a repository, however many copies it has; a source is an owner."""
    docs = read(spark, sf_dir, "documents").withColumn("repo", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    out = secrets.secrets(docs, repo_col="repo")
    digest = F.sha2(F.col("base_spans").cast("binary"), 256)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", digest.alias("base_sha256"), "spans", "n_live", "n_example")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id", "lang"])
    score = F.col(toxicity.SCORE)
    return scored.select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        score.alias("score"),
        F.when(score >= toxicity.CUT, 1).otherwise(0).alias("predicted"),
        (score >= toxicity.threshold(model)).alias("rejected"),
    )


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring_lines(read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op11_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filtering_lloyd.compress(read(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.personal_data(read(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("base_spans").cast("binary"), 256)
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", digest.alias("base_sha256"), "spans", "n_added")


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.clustered(read(spark, sf_dir, "embeddings"))


_QUERIES = (
    op1_bit_plane_tokens,
    op2_decontamination,
    op3_quality_rules,
    op4_secret_scan,
    op5_source_mix,
    op6_toxicity,
    op7_minhash_near_dedup,
    op8_html_extraction,
    op9_line_templates,
    op10_sharding,
    op11_filtering_lloyd,
    op12_pii_boosting,
    op13_ball_kmeans,
)


def queries():
    return {f.__name__: f for f in _QUERIES}


def oracle_sql():
    return {
        "op2_decontamination": oracles.op2(),
        "op3_quality_rules": oracles.op3(),
        "op4_secret_scan": oracles.op4(),
        "op5_source_mix": oracles.op5(),
        "op7_minhash_near_dedup": oracles.op7(),
        "op9_line_templates": oracles.op9(),
        "op10_sharding": oracles.op10(SHARDS),
        "op11_filtering_lloyd": oracles.op11(),
        "op13_ball_kmeans": oracles.op13(),
    }
