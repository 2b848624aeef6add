"""The registered queries over training data and their oracle SQL; each query loads the modules it needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _parcels(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return _table(spark, folder, "parcels"), _table(spark, folder, "villages"), _table(spark, folder, "parcel_sources")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of records of one parcel, with the record that survives of their set."""
    from parcelwright.llm import survivors

    return survivors.same_parcel_pairs(*_parcels(spark, folder))


def p2_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving record of each parcel, field by field."""
    from parcelwright.llm import survivors

    return survivors.survivors(*_parcels(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The values of message and reply that lost their end."""
    from parcelwright.llm import truncation

    return truncation.judge(_table(spark, folder, "chat_turns")).where("posterior >= 0.5").select("turn_id", "field_name").distinct()


def p3_sources(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source cuts each field; a turn delivered twice counts once."""
    from parcelwright.llm import truncation

    judged = truncation.judge(_table(spark, folder, "chat_turns")).select("turn_id", "source", "field_name", "length", "posterior").distinct()
    cut = (F.col("posterior") >= 0.5).cast("int")
    return judged.groupBy("source", "field_name").agg(F.count("*").alias("texts"), F.sum(cut).alias("cut_texts"), F.round(F.avg(cut), 6).alias("share"), F.max(F.when(cut == 1, F.col("length"))).alias("longest_cut"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The field sketches and all parcel records of the same plot."""
    from parcelwright.llm import linking

    return linking.matches(_table(spark, folder, "fmb_errors"), *_parcels(spark, folder))


def p4_links(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the rule that found each match and the confidence in it."""
    from parcelwright.llm import linking

    return linking.link(_table(spark, folder, "fmb_errors"), *_parcels(spark, folder)).withColumn("confidence", F.round("confidence", 6))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of each document under byte_bpe_50k."""
    from parcelwright.llm import tokens

    return tokens.encode(_table(spark, folder, "documents").select("doc_id", "text"))


def p7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """A container for each document in each context."""
    from parcelwright.llm import packing

    return packing.pack(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "contexts"))


def p7_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Containers of each context, what each limit holds of them, and unused space."""
    from parcelwright.llm import packing

    return packing.usage(p7_packing(spark, folder), _table(spark, folder, "contexts"))


def _instructions(spark: SparkSession, folder: str) -> tuple:
    """Documents as instruction data, where all three limits act: the first line is a prompt without loss, and a container has at most 8 examples and 70 % of its tokens with loss."""
    from parcelwright.llm import packing

    limits, contexts = packing.Limits(most_segments=8, loss_share=0.7, prompt_lines=1), _table(spark, folder, "contexts")
    return packing.pack(_table(spark, folder, "documents").select("doc_id", "text"), contexts, limits=limits), contexts, limits


def p7_instructions(spark: SparkSession, folder: str) -> DataFrame:
    """Use of the containers when documents are packed as instruction data."""
    from parcelwright.llm import packing

    return packing.usage(*_instructions(spark, folder))


def p7_soundness(spark: SparkSession, folder: str) -> DataFrame:
    """Documents placed and limits broken in that packing."""
    from parcelwright.llm import packing

    return packing.soundness(*_instructions(spark, folder))


def _languages(spark: SparkSession, folder: str) -> DataFrame:
    from parcelwright.llm import langid

    return langid.detect(_table(spark, folder, "documents").select("doc_id", "text"), langid.fit(_table(spark, folder, "lang_samples")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The languages of each document that has several, or whose label is missing or wrong."""
    from parcelwright.llm import langid

    documents = _table(spark, folder, "documents")
    model = langid.fit(_table(spark, folder, "lang_samples"))
    labels = documents.select("doc_id", "text", langid.label_code(F.col("lang")).alias("label"))
    found = langid.detect(labels, model, keep="label")
    case = (F.size("languages") > 1) | ((F.size("languages") == 1) & (F.col("languages")[0] != F.col("label")))
    return found.where(case).select("doc_id", F.explode("languages").alias("lang"))


def p8_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's language with its confidence, and each segment of another language with its own."""
    found = _languages(spark, folder)
    other = F.filter("segments", lambda s: s["lang"] != F.col("lang"))
    return found.select("doc_id", "lang", F.round("confidence", 6).alias("confidence"), F.explode_outer(other).alias("s")).select("doc_id", "lang", "confidence", F.col("s.start").alias("segment_start"), F.col("s.end").alias("segment_end"), F.col("s.lang").alias("segment_lang"), F.round("s.confidence", 6).alias("segment_confidence"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p2_survivors": p2_survivors, "p3_found": p3_found, "p3_sources": p3_sources, "p4_found": p4_found, "p4_links": p4_links, "p6_ids": p6_ids, "p7_packing": p7_packing, "p7_usage": p7_usage, "p7_instructions": p7_instructions, "p7_soundness": p7_soundness, "p8_found": p8_found, "p8_segments": p8_segments}


def oracle_sql() -> dict[str, str]:
    return {"p7_soundness": "SELECT CAST(context_id AS INTEGER) AS context_id, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, CAST(0 AS BIGINT) AS over_a_limit, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS split_in_vain FROM contexts"}
