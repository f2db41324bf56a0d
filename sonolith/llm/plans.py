"""Queries on texts and entities, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolith.functions.text import reference_key
from sonolith.llm.fusion import FusedField, fuse
from sonolith.llm.matching import match
from sonolith.llm.packing import pack
from sonolith.llm.residue import find_residue
from sonolith.llm.tokens import count_tokens, encode_texts
from sonolith.sources import table

CONTAINER = 2048


def fuse_turbines(spark: SparkSession, folder: str, authority: str, posteriors: bool = True) -> DataFrame:
    """One row for each group of turbine records that share a mast_ref."""
    hub, power = F.col("hub_m"), F.col("power_kw")
    fields = [
        FusedField("hub_m", hub.between(10, 250) & ~F.isnan(hub), 10),
        FusedField("power_kw", power.between(1, 20000) & ~F.isnan(power), 10),
    ]
    records = table(spark, folder, "turbines").select(
        "record_id", "mast_ref", "source", "updated_at", "hub_m", "power_kw"
    )
    key, source = reference_key(F.col("mast_ref")), F.lower(F.trim("source"))
    trust = table(spark, folder, "source_trust")
    return fuse(records, key, "record_id", source, "updated_at", trust, fields, authority, posteriors=posteriors)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The records that the order of trust takes: it leaves nothing open, so no accuracy or posterior is estimated for it."""
    return fuse_turbines(spark, folder, "trust", posteriors=False).select(
        "group_id",
        F.col("hub_m_record").alias("hub_record"),
        F.col("power_kw_record").alias("power_record"),
        "source_record",
    )


def p2_fused(spark: SparkSession, folder: str) -> DataFrame:
    """The values of largest posterior, by what the votes say of the sources, and the most trusted records that hold them."""
    return fuse_turbines(spark, folder, "evidence")


def match_turbines(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a turbine record and a register unit that describe one turbine, with rule and confidence."""
    records = table(spark, folder, "turbines").select(
        "record_id", reference_key(F.col("mast_ref")).alias("key"), "lat", "lon", F.col("hub_m").alias("hub"),
        F.col("power_kw").alias("power"), "farm", F.col("turbine_model").alias("maker"),
    )
    units = table(spark, folder, "register_units").select(
        "unit_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("hub_height_m").alias("hub"),
        F.col("capacity_mw").alias("power"), F.col("farm_label").alias("farm"), F.col("unit_model").alias("maker"),
        (F.lower(F.trim("unit_status")) == "dismantled").alias("gone"),
    )
    return match(records, units)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return match_turbines(spark, folder).select("record_id", "unit_id")


def p5_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs with the rule that found each and its confidence."""
    return match_turbines(spark, folder).withColumn("confidence", F.floor(F.col("confidence") * 10000 + 0.5) / 10000)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents").select("doc_id", "text"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every text's pieces with the container that each is in."""
    sizes = count_tokens(table(spark, folder, "documents").select("doc_id", "text"))
    return pack(sizes, "doc_id", "tokens", CONTAINER)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_residue(table(spark, folder, "documents")).where("residue").select("doc_id")


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that stay: those without residue."""
    documents = table(spark, folder, "documents")
    return documents.join(p8_found(spark, folder), "doc_id", "left_anti").select("doc_id", "lang", "n_chars")


QUERIES = {"p2_found": p2_found, "p2_fused": p2_fused, "p5_found": p5_found, "p5_matches": p5_matches, "p6_ids": p6_ids, "p7_containers": p7_containers,
    "p8_found": p8_found, "p8_kept": p8_kept,
}
_KEY = """nullif(regexp_replace(regexp_replace(upper(mast_ref), '(^|[^0-9])0+([0-9])', '\\1\\2', 'g'), '[\\s\\-_/.]+', '', 'g'), '')"""
_ORDER = "{'a': coalesce(trust, 2147483647), 'b': coalesce(-epoch_us(updated_at), 9000000000000000000), 'c': record_id}"
SQL = {
    "p2_found": f"""with r as (select t.*, s.trust, {_KEY} as k from turbines t left join source_trust s on lower(trim(t.source)) = s.source)
        select min(record_id) as group_id,
        coalesce(arg_min(record_id, {_ORDER}) filter (where hub_m between 10 and 250 and not isnan(hub_m)), 0) as hub_record,
        coalesce(arg_min(record_id, {_ORDER}) filter (where power_kw between 1 and 20000 and not isnan(power_kw)), 0) as power_record,
        coalesce(arg_min(record_id, {_ORDER}) filter (where trust is not null), 0) as source_record
        from r where k is not null group by k having count(*) >= 2""",
}
