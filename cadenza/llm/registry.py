"""The queries of this subpackage, one thin function for each operator, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import chroma, conversations, decontaminate, filter_audit, language, near_dedup, oracles, pii, quality, repeats, sentencepiece_codec, token_counts, url_filter, warc
from cadenza.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds audio: the vectors of ``embeddings`` are played as tones, each whole and in a second take.

    A recording's number is twice the vector's, plus the take. Queries: whole takes of ids divisible by 100. A class's own
    row (recording = class_id) is there once for each of its links, or once without; other members once each.
    """
    both = chroma.takes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    prints = both.select((2 * F.col("vec_id") + F.col("take")).alias("recording"), "fingerprint")
    members, links = chroma.align(prints, F.col("recording") % 200 == 0, "recording")
    linked = links.withColumnRenamed("class_id", "recording")
    named = members.join(linked, "recording", "left")
    return named.select(F.floor(F.col("recording") / 2).alias("vec_id"), (F.col("recording") % 2).cast("int").alias("take"), "recording", "class_id", "n_frames", "query_id", "offset", "bit_error_rate")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Words in the host labels of spam families.
BLOCKED_WORDS = "ads|adult|bet|bets|casino|pills|porn|poker|spam|xxx"


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds a block list: the hosts of the spam families stand for one, with some by a hash that no url shows."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).distinct()
    listed = hosts.where(F.col("host").rlike(rf"(^|[.-])({BLOCKED_WORDS})([.-]|$)") | F.md5("host").startswith("0"))
    return url_filter.judge(pages, RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scores``: of all spans, as listed in ``spans``, in tenths."""
    found = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), out="found").select("doc_id", "found")
    return found.select(
        "doc_id",
        *(pii.count_of(F.col("found"), k).alias(f"n_{k}") for k in pii.BASE_KINDS),
        F.sha2(pii.listed(pii.base_only(F.col("found"))), 256).alias("base_sha256"),
        pii.listed(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: F.round(s["score"] * 10).cast("int").cast("string")), ",").alias("scores"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = token_counts.unigram_scores(tokenizer_path("piece_bpe_32k.model"))
    return token_counts.with_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), scores).select("doc_id", "n_tokens", "n_pretokens")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = language.fit(docs, docs.where(quality.fold(3) != 1).select("doc_id", F.col("lang").alias("label")))
    out = language.with_language(docs.select("doc_id", "text"), network)
    return out.select("doc_id", F.coalesce(quality.fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    out = near_dedup.groups(docs, words_each=4, percent=80)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(quality.fold(4) != 2).select("doc_id", F.col("quality").alias("label"))
    out = quality.with_score(docs.select("doc_id", "text"), quality.fit(docs, labels))
    return out.select("doc_id", F.coalesce(quality.fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


QUERIES = (
    op1_decontaminate,
    op2_chroma,
    op3_warc,
    op4_url_filter,
    op5_sentencepiece,
    op6_pii,
    op7_token_counts,
    op8_language,
    op9_near_dedup,
    op10_quality,
    op11_repeats,
    op12_filter_audit,
    op13_conversations,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
