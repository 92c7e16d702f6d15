"""Adjudication of one evidence group: five classes with additive confidence.

Everything is a CASE over the group's facts array. What an announcing document says of itself (units
named, fields itemised) comes with the group, or by a join where it does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions import normalize as N

# Ceilings by class, the floor, and the thresholds of the rules.
CEILINGS = {"consistent": 0.99, "conflict": 0.97, "benign_variant": 0.96, "supersession": 0.95, "unresolved": 0.70}
FLOOR, MINOR_LOSS, MATERIAL_GAP, NEAR_ADDRESS = 0.05, 25_000, 0.05, 0.85


def signal(name: str | Column, weight: Column | float, when: Column | None = None) -> Column:
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return F.struct((name if isinstance(name, Column) else F.lit(name)).alias("name"), (w if when is None else F.when(when, w).otherwise(0.0)).cast("double").alias("weight"))


def quality(facts: Column) -> Column:
    """The least confidence among the facts, 0.5 without any."""
    return F.coalesce(F.array_min(F.transform(facts, lambda f: f["confidence"])), F.lit(0.5))


def confidence(terms: Column, cls: Column) -> Column:
    """Terms summed left to right, floored, capped by class, 3 places."""
    total = F.aggregate(terms, F.lit(0.0), lambda a, s: a + s["weight"])
    ceiling = F.create_map(*[F.lit(x) for pair in CEILINGS.items() for x in pair])[cls]
    return F.floor(F.least(F.greatest(total, F.lit(FLOOR)), ceiling) * 1000 + 0.5) / 1000


def signals(terms: Column) -> Column:
    """Names of the terms that count."""
    return F.transform(F.filter(terms, lambda s: s["weight"] != 0), lambda s: s["name"])


def document_marks(facts: DataFrame) -> DataFrame:
    """(packet_id, document_id, names_unit, itemised) of every document with facts."""
    unit = F.max(N.unit_number(F.col("entity_key")).isNotNull())
    both = F.max(F.col("field") == "vin") & F.max(F.col("field") == "stated_value")
    return facts.groupBy("packet_id", "document_id").agg(unit.alias("names_unit"), (unit & both).alias("itemised"))


def classify(groups: DataFrame, marks: DataFrame) -> DataFrame:
    """One finding per group; ``marks`` are the ``document_marks`` of the same facts."""
    g, last = groups.withColumn("_last", F.try_element_at("facts", F.lit(-1))["document_id"]), marks.withColumnRenamed("document_id", "_doc")
    return judged(g.join(last, (g["packet_id"] == last["packet_id"]) & (F.col("_last") == F.col("_doc")), "left").drop(last["packet_id"]))


def classification(x: Column) -> Column:
    """The class of a group: a struct (or row) of field and facts in order of arrival."""
    facts = x["facts"]

    def of(g: Column) -> Column:
        one = F.size(g["canon"]) == 1
        close = (x["field"] == "vin") & F.forall(g["canon"], lambda a: F.forall(g["canon"], lambda b: (a == b) | N.confusable(a, b)))
        final = F.try_element_at(facts, F.lit(-1))
        superseded = final["change_intent"].isNotNull() & F.exists(facts, lambda f: f["value"]["canonical"] != final["value"]["canonical"])
        surfaces = F.array_distinct(F.transform(facts, lambda f: N.surface(f["raw"])))
        return (
            F.when(F.exists(facts, lambda f: f["value"]["ambiguous"]), "unresolved")
            .when(one & (~F.exists(facts, lambda f: f["value"]["domain_rule"].isNotNull()) | (F.size(surfaces) == 1)), "consistent")
            .when(one, "benign_variant")
            .when(close, "unresolved")
            .when(superseded, "supersession")
            .otherwise("conflict")
        )

    return N.let(F.struct(F.array_distinct(F.transform(facts, lambda f: f["value"]["canonical"])).alias("canon")), of)


def judged(groups: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One finding per group: classification, confidence, rationale, signals, evidence, superseded_by.

    ``groups`` have names_unit and itemised of the document of their last fact; columns ``keep`` stay. No rows move.
    """
    g = groups.withColumns(
        {
            "canon": F.array_distinct(F.transform("facts", lambda f: f["value"]["canonical"])),
            "surfaces": F.array_distinct(F.transform("facts", lambda f: N.surface(f["raw"]))),
            "docs": F.size(F.array_distinct(F.transform("facts", lambda f: f["document_id"]))),
            "n": F.size("facts"),
            "q": quality(F.col("facts")),
            "final": F.try_element_at("facts", F.lit(-1)),
            "rule": F.try_element_at(F.filter(F.transform("facts", lambda f: f["value"]["domain_rule"]), lambda r: r.isNotNull()), F.lit(1)),
            "ambiguous": F.exists("facts", lambda f: f["value"]["ambiguous"]),
            "change_words": F.exists("facts", lambda f: f["change_intent"].isNotNull()),
        }
    )
    cls = classification(F.struct("field", "facts"))
    q = lambda x: signal("evidence.extraction-quality", F.col("q") * x)
    terms = (
        F.when(F.col("ambiguous"), F.array(signal("normalize.self-declared-ambiguous", 0.40), q(0.15)))
        .when(F.col("classification") == "consistent", F.when(F.col("n") > 1, F.array(signal("evidence.corroborated-across-documents", 0.86), q(0.12))).otherwise(F.array(signal("evidence.single-reading", 0.90), q(0.09))))
        .when(F.col("classification") == "benign_variant", F.array(signal(F.concat(F.lit("normalize."), F.col("rule")), 0.72), q(0.20), signal("evidence.corroborated-across-documents", 0.04, F.col("docs") >= 3)))
        .when(F.col("classification") == "unresolved", F.array(signal("identity.ambiguous-glyphs-legal-in-both-readings", 0.40), q(0.15)))
        .when(
            F.col("classification") == "supersession",
            F.array(signal("temporal.explicit-change-language-in-source", 0.55), q(0.14), signal("change.names-specific-unit", 0.14, F.coalesce("names_unit", F.lit(False))), signal("change.itemised-and-auditable", 0.10, F.coalesce("itemised", F.lit(False)))),
        )
        .otherwise(F.array(signal("contradiction.no-reconciling-document", 0.45), signal("evidence.asserted-by-separate-documents", 0.12, F.col("docs") > 1), q(0.30)))
    )
    first_of = lambda s: F.get(F.filter("facts", lambda f: N.surface(f["raw"]) == s), F.lit(0))
    readings = F.array_join(F.transform(F.slice("surfaces", 1, 3), lambda s: N.cited(first_of(s))), " / ")
    why = (
        F.when(F.col("classification") == "consistent", F.concat(F.lit("All readings agree: "), readings))
        .when(F.col("classification") == "benign_variant", F.concat(F.lit("One value in several notations: "), readings))
        .when(F.col("classification") == "supersession", F.concat(F.lit("Announced change in "), F.col("final.document_title"), F.lit(": "), readings))
        .when(F.col("classification") == "unresolved", F.concat(F.lit("The source does not decide between readings: "), readings))
        .when(F.col("change_words"), F.concat(F.lit("Change wording does not account for the values: "), readings))
        .otherwise(F.concat(F.lit("Different values and no change wording: "), readings))
    )
    by = F.when(F.col("classification") == "supersession", F.struct(F.col("final.document_id").alias("document_id"), F.col("final.document_title").alias("document_title"), F.col("final.received_at").alias("at")))
    out = g.withColumn("classification", cls).withColumn("terms", terms).withColumns({"confidence": confidence(F.col("terms"), F.col("classification")), "signals": signals(F.col("terms"))})
    return out.select("packet_id", "group_key", "label", "entity_key", "field", "classification", "confidence", why.alias("rationale"), "signals", F.col("facts").alias("evidence"), by.alias("superseded_by"), *(keep or []))


def classify_naive(groups: DataFrame) -> DataFrame:
    """The control engine: different surface forms are a conflict, whatever they mean."""
    surfaces = F.array_distinct(F.transform("facts", lambda f: N.surface(f["raw"])))
    many = F.size("surfaces") > 1
    return groups.withColumn("surfaces", surfaces).select(
        "packet_id", "group_key", "label", "entity_key", "field",
        F.when(many, "conflict").otherwise("consistent").alias("classification"),
        F.when(many, 0.80).otherwise(0.90).alias("confidence"),
        F.concat(F.lit("Surface forms: "), F.array_join(F.slice("surfaces", 1, 3), " / ")).alias("rationale"),
        F.array(F.when(many, F.lit("naive.multiple-surface-forms")).otherwise(F.lit("naive.single-surface-form"))).alias("signals"),
        F.col("facts").alias("evidence"),
        F.lit(None).cast("struct<document_id:string,document_title:string,at:timestamp>").alias("superseded_by"),
    )
