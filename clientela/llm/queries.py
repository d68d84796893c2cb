"""The operators as queries over whole tables, named op1_ to op13_."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clientela.llm import (
    exact_dedup, filter_audit, language_id, license_scan, mixing, near_dedup, packing, quality_mil, quality_rules,
    sanitise, secret_scan, suffix_dedup, vector_codes,
)
from clientela.llm.folds import held_out
from clientela.llm.shipping import ship
from clientela.sources.scratch import stored

# Shares of tokens that training is to see of each labelled domain.
WEIGHTS = {"good": 0.90, "poor": 0.07, "toxic": 0.03}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def tokenizer_path() -> str:
    """Where the tokenizer's file is; its id 0 ends a document."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def domain_labels(labels: DataFrame) -> DataFrame:
    """Domains of the labelled table: toxic first, then by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.when(F.col("quality") == 0, "poor").alias("domain"))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.remove_repeats(_documents(spark, sf_dir))
    return cleaned.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = domain_labels(_labels(spark, sf_dir))
    return mixing.mix_domains(_documents(spark, sf_dir), labelled, WEIGHTS)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality_mil.learn_quality(docs, _labels(spark, sf_dir).where(~held_out()))
    predicted = (F.col("score") >= quality_mil.THRESHOLD).cast("int").alias("predicted")
    return quality_mil.score_quality(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", predicted, "passages"
    )


def op5_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.disclosures(_documents(spark, sf_dir))
    return found.select(
        "doc_id", *(f"n_{kind}" for kind in sanitise.KINDS), F.sha2("base", 256).alias("base_sha256"),
        "spans", F.size("revealing").alias("n_revealing"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    statistics = stored(quality_rules.text_statistics(_documents(spark, sf_dir)))
    labels = _labels(spark, sf_dir).where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = statistics.where(~quality_rules.base_failed()).join(labels, "doc_id")
    rules = quality_rules.learn_rules(labelled.withColumn("bad", F.col("quality") == 0))
    return quality_rules.apply_rules(statistics, rules)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = stored(secret_scan.candidates(docs, secret_scan.learn_text(docs)))
    labelled = secret_scan.findings_by_syntax(found.where(~held_out()))
    scored = secret_scan.judged(found, secret_scan.learn_forest(labelled))
    return scored.select("doc_id", "start", "end", held_out().alias("held_out"), "score", "is_secret")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.text_groups(_documents(spark, sf_dir))
    return groups.withColumnRenamed("digest", "text_sha256")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language_id.fit_languages(docs.where(~held_out()))
    found = language_id.identify_languages(docs, model)
    return found.select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score",
        _listed("languages").alias("languages"), "accepted",
    )


def _listed(shares: str) -> Column:
    """A map of shares as text, names in order, three decimals."""
    entries = F.array_sort(F.map_entries(shares))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.format_number(e["value"], 3))), " "
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), tokenizer_path())


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    coded = vector_codes.compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return vector_codes.label_errors(coded).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", "codebooks_sha256"
    )


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = license_scan.scan_licenses(docs, license_scan.learn_index(docs))
    base = F.filter("places", lambda p: p["base"])

    def labels(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    starts = F.transform(base, lambda p: p["start"])
    shares = F.transform("places", lambda p: p["share"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(shares), F.lit(0.0)).alias("score"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_source_mixing": op3_source_mixing,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_pii_sanitisation": op5_pii_sanitisation,
    "op6_quality_rules": op6_quality_rules,
    "op7_secret_scan": op7_secret_scan,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_language_id": op9_language_id,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_filter_audit": op11_filter_audit,
    "op12_vector_codes": op12_vector_codes,
    "op13_license_scan": op13_license_scan,
}
