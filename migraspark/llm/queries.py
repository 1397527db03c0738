"""The operators over the test tables, as queries, with the SQL that cross-checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from migraspark.llm import sql, sql_stream
from migraspark.llm.common import table
from migraspark.llm.classifier import classify, held_out, train
from migraspark.llm.conversations import damaged_and_repaired
from migraspark.llm.decontaminate import contaminated
from migraspark.llm.line_dedup import duplicate_lines
from migraspark.llm.mixing import mix
from migraspark.llm.near_dedup import near_duplicates
from migraspark.llm.periodic import periodic_runs, run_digests
from migraspark.llm.quality_rules import STOP_WORDS, quality_rules
from migraspark.llm.sharding import assign_shards
from migraspark.llm.substring_dedup import substring_digests, without_repeats
from migraspark.llm.tokens import token_counts
from migraspark.llm.url_filter import url_filter
from migraspark.llm.warc import archived

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


@query("op1_quality_rules", sql.QUALITY_RULES.replace("{stops}", ", ".join(f"'{w}'" for w in STOP_WORDS)))
def _quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"))


@query("op2_url_filter", sql.URL_FILTER)
def _url_filter(spark: SparkSession, folder: str) -> DataFrame:
    bad = F.expr("quality = 0 OR toxic = 1")
    outcomes = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_filter(table(spark, folder, "pages"), outcomes)


@query("op3_quality_classifier")
def _quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = classify(docs, train(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op4_near_dedup", sql.NEAR_DEDUP)
def _near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query("op5_mixing", sql.MIXING)
def _mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(table(spark, folder, "documents"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


@query("op6_warc", sql.WARC)
def _warc(spark: SparkSession, folder: str) -> DataFrame:
    records = archived(table(spark, folder, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_token_counts")
def _token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(table(spark, folder, "documents"), path)


@query("op8_line_dedup", sql.LINE_DEDUP)
def _line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_lines(table(spark, folder, "documents"))


@query("op9_decontamination")
def _decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op10_sharding", sql.SHARDING)
def _sharding(spark: SparkSession, folder: str) -> DataFrame:
    return assign_shards(table(spark, folder, "documents")).select("doc_id", "slot", "shard")


@query("op11_periodic_runs", sql_stream.PERIODIC_RUNS)
def _periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return run_digests(periodic_runs(table(spark, folder, "documents"), loops=True))


@query("op12_substring_dedup", sql_stream.SUBSTRING_DEDUP)
def _substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_digests(without_repeats(table(spark, folder, "documents")))


@query("op13_conversation_repair", sql_stream.CONVERSATIONS)
def _conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return damaged_and_repaired(table(spark, folder, "conversations"))
