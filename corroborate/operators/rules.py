"""Cross-field rules over a packet's settled evidence.

All that is known of a packet is one row: its groups, each with its finding, and its tables. The row is
made by one exchange on packet_id, and every rule is an expression on it that gives a finding or null. Own
rules can be added to the list that ``derive`` takes. A packet is one case file; it must fit into a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corroborate.functions import normalize as N
from corroborate.functions.normalize import let
from corroborate.operators import classify as C
from corroborate.operators import link as L
from corroborate.operators.classify import MATERIAL_GAP, MINOR_LOSS, NEAR_ADDRESS, quality, signal

LABELS = {
    "vin_uniqueness": "VIN uniqueness", "vehicle_count_reconciliation": "Vehicle count reconciliation",
    "scheduled_value_reconciliation": "Scheduled value reconciliation", "loss_history_completeness": "Loss history completeness",
    "location_roster": "Location roster", "location_count_reconciliation": "Location count reconciliation",
}
SPAN = "array<struct<document_id:string,start:int,end:int,quote:string>>"
TABLE = ["table_seq", "document_id", "document_title", "received_at", "span", "units", "degraded"]
GROUP = ["group_key", "label", "entity_key", "field", "classification", "confidence", "rationale", "signals", "evidence", "superseded_by"]


def packets(facts: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(packet_id, groups, tables): one row per packet.

    ``groups`` are array<struct<GROUP>>, all groups of facts with their findings. A supporting field is one
    group of all its readings, not adjudicated, with a null classification. ``tables`` are array<struct<TABLE>> in order. The
    rows are dealt by packet once; what is counted and gathered after that stays where it is.
    """
    rows = L.evidence(facts).select("packet_id", "entity_key", "field", "document_id", "ev", F.lit(None).cast(table_type()).alias("t"))
    if tables is not None:
        rows = rows.unionByName(tables.select("packet_id", F.struct(*TABLE).alias("t")), allowMissingColumns=True)
    rows = rows.repartition("packet_id")
    of_document = Window.partitionBy("packet_id", "document_id")
    unit = F.max(N.unit_number(F.col("entity_key")).isNotNull()).over(of_document)
    both = F.max(F.col("field") == "vin").over(of_document) & F.max(F.col("field") == "stated_value").over(of_document)
    rows = rows.withColumns({"names_unit": unit, "itemised": unit & both})
    # Readings of a supporting field are one group, whatever their entity.
    support = F.col("field").isin(*L.SUPPORTING)
    rows = rows.withColumn("entity_key", F.when(support, F.lit("policy")).otherwise(F.col("entity_key")))
    groups = rows.groupBy("packet_id", "entity_key", "field").agg(
        F.sort_array(F.collect_list(F.when(F.col("ev").isNotNull(), F.struct("ev", "names_unit", "itemised")))).alias("held"), F.sort_array(F.collect_list("t")).alias("tables")
    )
    last = lambda c: F.try_element_at("held", F.lit(-1))[c].alias(c)
    held = F.transform("held", lambda x: x["ev"])
    found = C.judged(
        groups.select(
            "packet_id", L.group_key(F.col("entity_key"), F.col("field")).alias("group_key"), "entity_key", "field", L.group_label(F.col("entity_key"), F.col("field")).alias("label"),
            F.when(support, F.slice(held, 1, 0)).otherwise(held).alias("facts"), F.when(support, held).alias("own"), last("names_unit"), last("itemised"), "tables",
        ),
        keep=["tables", "own"],
    )
    found = found.withColumns({"classification": F.when(~support, F.col("classification")), "evidence": F.coalesce("own", "evidence")})
    group = F.when(F.col("entity_key").isNotNull(), F.struct(*GROUP))
    return found.groupBy("packet_id").agg(F.collect_list(group).alias("groups"), F.flatten(F.collect_list("tables")).alias("tables"))


def gathered(rows: DataFrame, settle: str | None = None) -> DataFrame:
    """(packet_id, groups, tables) as rules read them, from rows of packet_id, ``evidence`` (array of ``ev`` structs) and ``tables``.

    For packets whose readings are one row already: they are sorted and cut into groups within the row, so
    nothing is exploded, dealt or sorted outside. Groups have what ``derive`` reads, and no findings of their own.
    With ``settle`` only that entity's groups are classified: the rules of RULES ask for no other's class than the policy's.
    """
    support = lambda e: e["field"].isin(*L.SUPPORTING)
    keyed = F.transform("evidence", lambda e: F.struct(F.when(support(e), "policy").otherwise(e["entity_key"]).alias("entity_key"), e["field"].alias("field"), e.alias("ev")))
    apart = lambda x, y: (x["entity_key"] != y["entity_key"]) | (x["field"] != y["field"])

    def group(run: Column) -> Column:
        first = F.get(run, 0)
        x = F.struct(first["entity_key"].alias("entity_key"), first["field"].alias("field"), F.transform(run, lambda r: r["ev"]).alias("facts"))
        cls = lambda g: F.when(~support(g) & (F.lit(True) if settle is None else g["entity_key"] == settle), C.classification(g))
        return let(x, lambda g: F.struct(g["entity_key"].alias("entity_key"), g["field"].alias("field"), cls(g).alias("classification"), g["facts"].alias("evidence")))

    def groups(all_: Column) -> Column:
        starts = F.filter(F.transform(all_, lambda _, i: i), lambda i: (i == 0) | apart(F.get(all_, i), F.get(all_, i - 1)))
        return let(starts, lambda s: F.transform(s, lambda i, k: let(F.slice(all_, i + 1, F.coalesce(F.get(s, k + 1), F.size(all_)) - i), group)))

    return rows.select("packet_id", let(F.sort_array(keyed), groups).alias("groups"), "tables")


def table_type() -> str:
    kinds = {"table_seq": "int", "document_id": "string", "document_title": "string", "received_at": "timestamp", "span": SPAN[6:-1], "units": "array<int>", "degraded": "boolean"}
    return f"struct<{','.join(f'{c}:{kinds[c]}' for c in TABLE)}>"


class Packet:
    """What a rule reads: columns of one row of ``packets``."""

    @property
    def groups(self) -> Column:
        return F.col("groups")

    @property
    def tables(self) -> Column:
        return F.col("tables")

    def of(self, field: str) -> Column:
        """The groups of a field."""
        return F.filter(self.groups, lambda g: g["field"] == field)

    def evidence(self, field: str) -> Column:
        """All readings of a field, in the order they were extracted."""
        return _by_seq(F.flatten(F.transform(self.of(field), lambda g: g["evidence"])))

    def effective(self, field: str) -> Column:
        """The readings in force, the last of each group of a field, in the order they were extracted."""
        return _by_seq(F.transform(self.of(field), lambda g: F.element_at(g["evidence"], -1)))

    def settled(self, field: str) -> Column:
        """struct<f, documents>: the policy's reading in force and in how many documents it is given; null while in dispute."""
        own = F.filter(self.of(field), lambda g: (g["entity_key"] == "policy") & ~g["classification"].isin("conflict", "unresolved") & F.element_at(g["evidence"], -1)["value"]["numeric"].isNotNull())
        told = lambda g: F.struct(F.element_at(g["evidence"], -1).alias("f"), F.size(F.array_distinct(F.transform(g["evidence"], lambda x: x["document_id"]))).alias("documents"))
        return F.get(F.transform(own, told), 0)


#: A rule makes a finding of a packet, or null where it does not apply.
Rule = Callable[[Packet], Column]


def _by_seq(facts: Column) -> Column:
    ranked = F.transform(facts, lambda f: F.struct(f["fact_seq"].alias("o"), f.alias("x")))
    return F.transform(F.sort_array(ranked), lambda s: s["x"])


def _bound(body, **parts: Column) -> Column:
    """``body`` of a struct of ``parts``, each computed once."""
    return let(F.struct(*[c.alias(k) for k, c in parts.items()]), body)


def finding(rule: str, cls: Column, terms: Column, rationale: Column, evidence: Column, explained: Column | None = None) -> Column:
    """A rule's finding in the shape of ``GROUP`` and explained_by."""
    none = F.array().cast(SPAN)
    return _bound(
        lambda x: F.struct(
            F.lit(f"policy::{rule}").alias("group_key"), F.lit(f"Policy — {LABELS.get(rule, rule)}").alias("label"), F.lit("policy").alias("entity_key"), F.lit(rule).alias("field"),
            x["cls"].alias("classification"), C.confidence(x["terms"], x["cls"]).alias("confidence"), rationale.alias("rationale"), C.signals(x["terms"]).alias("signals"), evidence.alias("evidence"),
            F.lit(None).cast("struct<document_id:string,document_title:string,at:timestamp>").alias("superseded_by"), (none if explained is None else F.coalesce(explained.cast(SPAN), none)).alias("explained_by"),
        ),
        cls=cls, terms=terms,
    )


def extraction(evidence: Column, weight: float) -> Column:
    """The term that every finding has: the quality of its evidence."""
    return signal("evidence.extraction-quality", quality(evidence) * weight)


def vin_uniqueness(p: Packet) -> Column:
    """A number carried by two units is a conflict, the graver if their values or models differ."""
    of_unit = lambda field: F.map_from_entries(F.transform(p.effective(field), lambda f: F.struct(f["entity_key"], f)))

    def shared(x: Column) -> Column:
        """Numbers that several units carry, with those units."""
        carried = F.sort_array(F.array_distinct(F.transform(x["all"], lambda f: F.struct(f["value"]["canonical"].alias("vin"), f["entity_key"].alias("unit")))))
        beside = lambda c, v, i: F.coalesce(F.get(c, i)["vin"] == v["vin"], F.lit(False))
        return let(carried, lambda c: F.filter(c, lambda v, i: beside(c, v, i - 1) | beside(c, v, i + 1)))

    def judge(x: Column) -> Column:
        pairs, hit = x["shared"], F.size(x["shared"]) > 0
        vins = F.array_distinct(F.transform(pairs, lambda s: s["vin"]))
        units = lambda v: F.transform(F.filter(pairs, lambda s: s["vin"] == v), lambda s: s["unit"])
        known = lambda by, v: F.filter(F.transform(units(v), lambda u: F.try_element_at(by, u)), lambda f: f.isNotNull())
        apart = lambda by: F.exists(vins, lambda v: F.size(F.array_distinct(F.transform(known(by, v), lambda f: f["value"]["canonical"]))) > 1)
        more = _by_seq(F.flatten(F.transform(vins, lambda v: F.concat(known(x["worth"], v), known(x["model"], v)))))
        held = F.when(hit, F.concat(F.filter(x["all"], lambda f: F.array_contains(vins, f["value"]["canonical"])), more)).otherwise(x["all"])
        grave = F.array(signal("identity.vin-carried-on-two-units", 0.60), signal("identity.units-rated-differently", 0.16, apart(x["worth"])), signal("identity.units-described-as-different-vehicles", 0.10, apart(x["model"])), extraction(x["all"], 0.14))
        terms = F.when(hit, grave).otherwise(F.array(signal("identity.vins-distinct-across-units", 0.88), extraction(x["all"], 0.10)))
        why = F.when(hit, F.concat(F.lit("Carried by more than one unit: "), F.array_join(vins, ", "))).otherwise(F.lit("Every unit carries a number of its own"))
        return F.when(F.size(x["all"]) > 0, finding("vin_uniqueness", F.when(hit, "conflict").otherwise("consistent"), terms, why, held))

    vins = F.filter(p.evidence("vin"), lambda f: f["entity_key"].startswith("vehicle:"))
    return _bound(lambda x: _bound(judge, all=x["all"], shared=shared(x), worth=of_unit("stated_value"), model=of_unit("year_make_model")), all=vins)


def vehicle_count_reconciliation(p: Packet) -> Column:
    """Stated count against scheduled and added units; units cited as off the schedule explain a gap."""
    largest = lambda ts: F.element_at(F.sort_array(F.transform(ts, lambda t: F.struct(F.size(t["units"]).alias("n"), (-t["table_seq"]).alias("o"), t.alias("t")))), -1)["t"]
    scheduled = F.array_sort(F.array_distinct(F.flatten(F.transform(p.tables, lambda t: t["units"]))))

    def counted(x: Column) -> Column:
        """The primary table as a reading of its units."""
        t, n = x["table"], F.size(x["scheduled"])
        return F.struct(
            t["received_at"].alias("received_at"), t["document_id"].alias("document_id"), t["span"]["start"].alias("start"), F.lit(0).alias("fact_seq"), F.concat(t["document_id"], F.lit(":policy:schedule_unit_count")).alias("fact_id"),
            F.concat(n.cast("string"), F.lit(" unit rows")).alias("raw"), N.value("count", n.cast("string"), n).alias("value"), t["span"].alias("span"), F.when(t["degraded"], 0.90).otherwise(0.96).alias("confidence"),
            F.lit(None).cast("string").alias("change_intent"), F.lit("policy").alias("entity_key"), F.lit("schedule_unit_count").alias("field"), t["document_title"].alias("document_title"),
        )

    def judge(x: Column) -> Column:
        f, n = x["stated"]["f"], F.size(x["scheduled"])
        added, off = F.size(F.array_distinct(F.transform(x["adds"], lambda f: f["value"]["numeric"]))), F.size(F.array_distinct(F.transform(x["gone"], lambda f: f["entity_key"])))
        delta = f["value"]["numeric"] - n - added
        cls = F.when(delta == 0, "consistent").when((delta > 0) & (delta == off), "benign_variant").otherwise("conflict")
        return _bound(lambda y: told(x, y, f, n), cls=cls, off=off, added=added, evidence=F.concat(F.array(f), F.array(counted(x)), x["adds"], F.when(cls == "consistent", F.slice(x["gone"], 1, 0)).otherwise(x["gone"])))

    def told(x: Column, y: Column, f: Column, n: Column) -> Column:
        q = lambda w: extraction(y["evidence"], w)
        terms = (
            F.when(y["cls"] == "consistent", F.array(signal("reconciliation.stated-count-matches-schedule", 0.88), q(0.10)))
            .when(y["cls"] == "benign_variant", F.array(signal("reconciliation.gap-fully-accounted-for", 0.74), q(0.18), signal("explanation.cited-in-packet", 0.04)))
            .otherwise(F.array(signal("reconciliation.stated-count-differs-from-schedule", 0.52), signal("reconciliation.no-explanation-in-packet", 0.12), q(0.30), signal("reconciliation.count-corroborated-by-multiple-documents", 0.06, x["stated"]["documents"] > 1)))
        )
        why = F.format_string("stated %d, scheduled %d, added %d, cited as off the schedule %d", f["value"]["numeric"], n, y["added"], y["off"])
        return finding("vehicle_count_reconciliation", y["cls"], terms, why, y["evidence"], F.when(y["cls"] == "benign_variant", F.transform(x["gone"], lambda f: f["span"])))

    def unscheduled(x: Column) -> Column:
        adds = F.filter(p.evidence("endorsement_add_unit"), lambda f: ~F.array_contains(x["scheduled"], f["value"]["numeric"].cast("int")))
        gone = F.filter(p.evidence("unit_status"), lambda f: f["value"]["canonical"].contains("removed_from_schedule") & ~F.array_contains(x["scheduled"], F.coalesce(N.unit_number(f["entity_key"]), F.lit(-1))))
        return _bound(judge, stated=x["stated"], scheduled=x["scheduled"], table=largest(p.tables), adds=adds, gone=gone)

    return F.when(F.size(p.tables) > 0, _bound(lambda x: F.when(x["stated"].isNotNull(), unscheduled(x)), stated=p.settled("stated_vehicle_count"), scheduled=scheduled))


def scheduled_value_reconciliation(p: Packet) -> Column:
    """Stated total against the sum of the units' values in force."""

    def judge(x: Column) -> Column:
        stated, sum_ = x["total"]["f"]["value"]["numeric"], F.aggregate(x["each"], F.lit(0).cast("bigint"), lambda a, f: a + f["value"]["numeric"])
        return _bound(lambda y: told(x, y), stated=stated, sum=sum_, gap=stated - sum_, evidence=F.concat(F.array(x["total"]["f"]), x["each"]))

    def told(x: Column, y: Column) -> Column:
        same, material = y["gap"] == 0, F.abs(y["gap"]) >= y["stated"] * MATERIAL_GAP
        terms = F.when(same, F.array(signal("arithmetic.total-equals-sum-of-schedule", 0.86), extraction(y["evidence"], 0.12)))
        terms = terms.otherwise(F.array(signal("arithmetic.total-does-not-equal-sum", 0.55), signal("arithmetic.gap-is-material", 0.12, material), extraction(y["evidence"], 0.30)))
        why = F.concat(F.lit("stated "), N.dollars(y["stated"]), F.lit(", units sum to "), N.dollars(y["sum"]))
        return finding("scheduled_value_reconciliation", F.when(same, "consistent").otherwise("conflict"), terms, why, y["evidence"])

    each = F.filter(p.effective("stated_value"), lambda f: f["value"]["numeric"].isNotNull())
    return _bound(lambda x: F.when(x["total"].isNotNull() & (F.size(x["each"]) > 0), judge(x)), total=p.settled("total_scheduled_value"), each=each)


def loss_history_completeness(p: Packet) -> Column:
    """What the narrative says of the losses (count, cap, minor) against the loss run."""

    def breach(x: Column, f: Column) -> Column:
        key, said = F.split_part(f["value"]["canonical"], F.lit("="), F.lit(1)), F.split_part(f["value"]["canonical"], F.lit("="), F.lit(2)).try_cast("bigint")
        told = lambda name, ratio: F.struct(F.lit(name).alias("name"), ratio.cast("double").alias("ratio"))
        return (
            F.when((key == "count") & (x["n"] > said), told("appetite.narrative-understates-loss-count", x["n"] / F.greatest(said, F.lit(1))))
            .when((key == "cap") & (x["worst"] > said), told("appetite.narrative-understates-loss-severity", x["worst"] / F.greatest(said, F.lit(1))))
            .when((key == "qualifier") & (x["worst"] > MINOR_LOSS), told("appetite.losses-described-as-minor-exceed-guideline", x["worst"] / MINOR_LOSS))
        )

    def told(x: Column, y: Column) -> Column:
        bad = F.size(y["breaches"]) > 0
        each = F.transform(y["breaches"], lambda b: F.struct(b["name"].alias("name"), F.lit(0.12).alias("weight")))
        severe = F.exists(y["breaches"], lambda b: b["ratio"] >= 5)
        terms = F.when(bad, F.concat(F.array(signal("appetite.narrative-contradicted-by-loss-run", 0.45)), each, F.array(signal("appetite.breach-exceeds-assertion-fivefold", 0.10, severe), extraction(y["evidence"], 0.25))))
        terms = terms.otherwise(F.array(signal("appetite.narrative-matches-loss-run", 0.84), extraction(y["evidence"], 0.12)))
        why = F.concat(F.format_string("%d claims, worst ", x["n"]), N.dollars(x["worst"]), F.when(bad, F.lit("; the narrative says less")).otherwise(F.lit("; as the narrative says")))
        return finding("loss_history_completeness", F.when(bad, "conflict").otherwise("consistent"), terms, why, y["evidence"])

    def judge(x: Column) -> Column:
        n = F.size(F.array_distinct(F.transform(x["incurred"], lambda f: f["entity_key"])))
        worst = F.coalesce(F.array_max(F.transform(x["incurred"], lambda f: f["value"]["numeric"])), F.lit(0))
        found = lambda y: F.filter(F.transform(x["claims"], lambda f: breach(y, f)), lambda b: b.isNotNull())
        return _bound(lambda y: _bound(lambda z: told(y, z), breaches=found(y), evidence=F.concat(x["claims"], x["incurred"])), n=n, worst=worst)

    return _bound(lambda x: F.when(F.size(x["claims"]) > 0, judge(x)), claims=p.evidence("loss_summary_claim"), incurred=p.evidence("loss_incurred"))


def _addresses(p: Packet) -> Column:
    """The first reading in force of each distinct address of a packet."""
    ranked = F.sort_array(F.transform(p.effective("garaging_address"), lambda f: F.struct(f["value"]["canonical"].alias("a"), f["fact_seq"].alias("o"), f.alias("f"))))
    first = let(ranked, lambda r: F.filter(r, lambda x, i: (i == 0) | (F.get(r, i - 1)["a"] != x["a"])))
    return _by_seq(F.transform(first, lambda x: x["f"]))


def near_within(addresses: Column, least: float = NEAR_ADDRESS) -> Column:
    """array<struct<a, b, told>>: near-equal but different ones among distinct addresses of one row.

    As in ``near_pairs``, only those that agree but for one token meet: they are neighbours once all
    addresses with one token left out are sorted.
    """
    hole = lambda a, toks, i: F.struct(i.alias("hole"), F.array_join(F.transform(toks, lambda t, j: F.when(i == j, F.lit("*")).otherwise(t)), " ").alias("rest"), a.alias("a"))
    holes = F.sort_array(F.flatten(F.transform(addresses, lambda a: let(F.split(a, " "), lambda toks: F.transform(toks, lambda _, i: hole(a, toks, i))))))
    other = lambda x, y: (x["hole"] != y["hole"]) | (x["rest"] != y["rest"])
    starts = lambda h: F.filter(F.transform(h, lambda _, i: i), lambda i: (i == 0) | other(F.get(h, i), F.get(h, i - 1)))

    def near(x: Column, y: Column) -> Column:
        short, long_ = F.least(F.length(x["a"]), F.length(y["a"])), F.greatest(F.length(x["a"]), F.length(y["a"]))
        close = (short >= long_ * least) & (N.similarity(x["a"], y["a"]) >= least)
        return F.when(close, F.struct(x["a"].alias("a"), y["a"].alias("b"), N.distinguishing_token(x["a"], y["a"]).alias("told")))

    def pairs(run: Column) -> Column:
        return F.flatten(F.transform(run, lambda x, i: F.transform(F.slice(run, i + 2, F.size(run)), lambda y: near(x, y))))

    def runs(h: Column) -> Column:
        return let(starts(h), lambda s: F.flatten(F.transform(s, lambda i, k: let(F.slice(h, i + 1, F.coalesce(F.get(s, k + 1), F.size(h)) - i), pairs))))

    return F.filter(let(holes, runs), lambda p: p["told"].isNotNull())


def near_pairs(addresses: DataFrame, least: float = NEAR_ADDRESS) -> DataFrame:
    """(packet_id, a, b, similarity, told): near-equal but different addresses within a packet.

    Only pairs that differ in exactly one token are told, so the self-join is keyed by packet and the
    address with one token left out, and bounded by length before any edit distance is computed.
    """
    tokens = F.split("address", " ")
    holes = addresses.select("packet_id", "address", F.posexplode(tokens).alias("hole", "_"))
    rest = F.array_join(F.transform(tokens, lambda t, i: F.when(i == F.col("hole"), F.lit("*")).otherwise(t)), " ")
    holes = holes.select("packet_id", "address", "hole", rest.alias("rest"))
    x, y = holes.withColumnRenamed("address", "a"), holes.withColumnRenamed("address", "b")
    short, long_ = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
    pairs = x.join(y, ["packet_id", "hole", "rest"]).where((F.col("a") < F.col("b")) & (short >= long_ * least)).select("packet_id", "a", "b")
    return pairs.withColumn("similarity", N.similarity(F.col("a"), F.col("b"))).where(F.col("similarity") >= least).withColumn("told", N.distinguishing_token(F.col("a"), F.col("b"))).where("told is not null")


def location_roster(p: Packet) -> Column:
    """Addresses that nearly coincide and are yet different places are kept apart, and named."""

    def judge(x: Column) -> Column:
        near = F.array_sort(F.transform(near_within(F.transform(x["own"], lambda f: f["value"]["canonical"])), lambda n: F.concat(n["a"], F.lit(" / "), n["b"], F.lit(": "), n["told"])))
        return _bound(lambda y: told(x, y), near=near)

    def told(x: Column, y: Column) -> Column:
        hit = F.size(y["near"]) > 0
        terms = F.when(hit, F.array(signal("identity.near-duplicate-addresses-kept-distinct", 0.70), signal("identity.distinguishing-token-identified", 0.10), extraction(x["own"], 0.12)))
        terms = terms.otherwise(F.array(signal("identity.locations-not-near-duplicates", 0.88), extraction(x["own"], 0.10)))
        why = F.when(hit, F.concat(F.lit("Kept apart: "), F.array_join(y["near"], "; "))).otherwise(F.lit("No two locations are close to each other"))
        return finding("location_roster", F.when(hit, "benign_variant").otherwise("consistent"), terms, why, x["own"])

    return _bound(lambda x: F.when(F.size(x["own"]) > 0, judge(x)), own=_addresses(p))


def location_count_reconciliation(p: Packet) -> Column:
    """Stated number of locations against the distinct addresses in force."""

    def judge(x: Column) -> Column:
        f, n = x["stated"]["f"], F.size(x["own"])
        same, evidence = n == f["value"]["numeric"], F.concat(F.array(f), x["own"])
        terms = F.when(same, F.array(signal("reconciliation.location-count-matches-schedule", 0.88), extraction(evidence, 0.10))).otherwise(F.array(signal("reconciliation.location-count-differs-from-schedule", 0.55), extraction(evidence, 0.30)))
        why = F.format_string("stated %d, distinct addresses %d", f["value"]["numeric"], n)
        return finding("location_count_reconciliation", F.when(same, "consistent").otherwise("conflict"), terms, why, evidence)

    return _bound(lambda x: F.when(x["stated"].isNotNull() & (F.size(x["own"]) > 0), judge(x)), stated=p.settled("garaging_location_count"), own=_addresses(p))


RULES: list[Rule] = [vin_uniqueness, vehicle_count_reconciliation, scheduled_value_reconciliation, loss_history_completeness, location_roster, location_count_reconciliation]


def derive(state: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Findings of all rules over ``packets``: packet_id, GROUP and explained_by. No rows move."""
    found = F.array(*[rule(Packet()) for rule in (RULES if rules is None else rules)])
    # Filtered after the rows are out, so that no rule is evaluated again to see whether there are any.
    return state.select("packet_id", F.inline_outer(found)).where(F.col("group_key").isNotNull())


def observed(state: DataFrame) -> DataFrame:
    """Findings of the groups themselves: packet_id, GROUP and an empty explained_by."""
    rows = state.select("packet_id", F.inline_outer("groups")).where(F.col("classification").isNotNull())
    return rows.withColumn("explained_by", F.array().cast(SPAN))
