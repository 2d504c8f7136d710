"""The queries opN_<name> and pipeline: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F


def _read(spark, sf_dir: str, table: str):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_packing(spark, sf_dir):
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), *tokenizer_paths(), capacity=1024, end_id=0, with_ids=False)


def _crc_mod(column: str, n: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def op2_lm_score(spark, sf_dir):
    from .lm_score import cross_entropy_difference, mark_target

    docs, good = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels").where("quality = 1")
    return cross_entropy_difference(mark_target(docs, good))


def op3_language_id(spark, sf_dir):
    from .langid import fit, identify

    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(_crc_mod("doc_id", 3) == 1, F.lit(False))
    model = fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)


def op4_warc(spark, sf_dir):
    from .warc import archive_pages

    return archive_pages(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_chunks")


def op5_ngram_jaccard(spark, sf_dir):
    from .ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(_read(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op6_quality(spark, sf_dir):
    from .quality import fit, score

    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels")
    held_out = F.coalesce(_crc_mod("doc_id", 4) == 2, F.lit(False))
    weights = fit(docs.where(~held_out), labels)
    out = score(docs.withColumn("held_out", held_out), weights)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: The key of a real run comes from a secret store; a fixed one here makes the query repeatable.
PII_KEY = "public example key"


def op7_pii(spark, sf_dir):
    from .pii import pseudonymise

    return pseudonymise(_read(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op8_decontaminate(spark, sf_dir):
    from .decontaminate import find_leaks

    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("th")


def op9_quality_rules(spark, sf_dir):
    from .quality_rules import apply_rules

    return apply_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels").where("quality = 1"))


def op10_substring_dedup(spark, sf_dir):
    from .substring import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents"), width=50, text=False)


#: Words are split at these.
BLANKS = r"[\x20\x09-\x0D]+"


def with_planted_runs(docs):
    """docs(doc_id, text): by a checksum of doc_id, one text in ten goes on in periods of its own words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"))
    words = F.filter(F.split(F.col("text"), BLANKS), lambda w: w != "")
    g, n = F.expr("h div 10"), F.size("w")
    chosen = rows.where("h % 10 = 0").withColumn("w", words).withColumn("a", F.when(n > 0, (g % n).cast("int")))
    period = F.expr("cast(1 + (size(w) - a) div (3 + (h div 10) % 8) as int)")
    planted = F.concat(F.slice("w", F.lit(1), F.col("a")), F.transform(F.sequence(F.col("a"), n - 1), lambda i: F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))))
    chosen = chosen.withColumn("p", period).select("doc_id", F.when(n > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))
    return rows.where("h is null or h % 10 <> 0").select("doc_id", "text").unionByName(chosen)


def op11_periodic_runs(spark, sf_dir):
    from .periodic import collapse_runs

    return collapse_runs(with_planted_runs(_read(spark, sf_dir, "documents")), text=False)


def op12_simhash(spark, sf_dir):
    from .simhash import simhash_groups

    return simhash_groups(_read(spark, sf_dir, "documents"), n=4, radius=4)


def op13_conversation_repair(spark, sf_dir):
    from .conversations import damage, repair_report

    conversations = _read(spark, sf_dir, "conversations")
    return repair_report(conversations, damage(conversations))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
