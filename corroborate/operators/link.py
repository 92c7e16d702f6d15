"""Facts to evidence groups: one per packet, entity and field, in order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions import normalize as N

#: Fields that support rules and are not adjudicated themselves.
SUPPORTING = ["loss_incurred", "loss_cause", "loss_summary_claim", "endorsement_add_unit", "endorsement_remove_unit", "unit_status", "schedule_unit_count"]
LABELS = {
    "effective_date": "Effective date", "stated_vehicle_count": "Stated vehicle count", "liability_limit": "Liability limit",
    "total_scheduled_value": "Total scheduled value", "garaging_location_count": "Garaging location count", "vin": "VIN",
    "garaging_address": "Garaging address", "stated_value": "Stated value", "year_make_model": "Year, make and model",
}


def group_key(entity: Column, field: Column) -> Column:
    return F.concat(entity, F.lit("::"), field)


def evidence(facts: DataFrame) -> DataFrame:
    """``facts`` with ``ev``, the struct that groups carry (offsets, not contents)."""
    return facts.withColumn("ev", F.struct("received_at", "document_id", F.col("span.start").alias("start"), "fact_seq", "fact_id", "raw", "value", "span", "confidence", "change_intent", "entity_key", "field", "document_title"))


def group_label(entity: Column, field: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.concat(N.entity_label(entity), F.lit(" — "), F.coalesce(F.try_element_at(names, field), field))


def groups(facts: DataFrame) -> DataFrame:
    """(packet_id, group_key, entity_key, field, label, facts): facts sorted by arrival, document, offset.

    The sort key leads the struct, so its own order is theirs and ties fall to fact_seq. A group is what
    one packet says of one entity's field, a handful of rows.
    """
    kept = evidence(facts.where(~F.col("field").isin(*SUPPORTING)))
    out = kept.groupBy("packet_id", "entity_key", "field").agg(F.sort_array(F.collect_list("ev")).alias("facts"))
    return out.select("packet_id", group_key(F.col("entity_key"), F.col("field")).alias("group_key"), "entity_key", "field", group_label(F.col("entity_key"), F.col("field")).alias("label"), "facts")


def ordered(groups_df: DataFrame) -> DataFrame:
    """The policy's groups first, then vehicles by number, then the rest."""
    unit = N.unit_number(F.col("entity_key"))
    rank = F.when(F.col("entity_key") == "policy", 0).when(unit.isNotNull(), 1).otherwise(2)
    return groups_df.orderBy("packet_id", rank, F.coalesce(unit, F.lit(0)), "entity_key", "group_key")


def supporting(facts: DataFrame, field: str) -> DataFrame:
    return facts.where(F.col("field") == field).orderBy("packet_id", "received_at", "document_id", "span.start", "fact_seq")
