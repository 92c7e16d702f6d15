"""Packets: schemas, and a deterministic generator of labelled ones.

Ten cases, each with one planted situation: five true conflicts and five hard negatives. All
wording and numbers are made up here.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = "packet_id string, doc_pos int, doc_id string, kind string, title string, received_at timestamp, content string"
PACKETS = "packet_id string, packet_pos int, title string, insured string, taxonomy_case int, bucket string, synopsis string, focus_group string, why string"
LABELS = "packet_id string, group_key string, expected string"

#: id, bucket, name, what it tests
TAXONOMY = [
    (1, "true_conflict", "Duplicate identifier", "one VIN on two units"),
    (2, "true_conflict", "Count against rows", "stated units exceed the schedule"),
    (3, "true_conflict", "Narrative against table", "losses understated"),
    (4, "true_conflict", "Two dates", "effective dates differ"),
    (5, "true_conflict", "Total against sum", "values do not add up"),
    (6, "hard_negative", "Announced change", "a later document supersedes"),
    (7, "hard_negative", "Near-duplicate entities", "addresses one suffix apart"),
    (8, "hard_negative", "Equivalent notation", "shorthand for the same amount"),
    (9, "hard_negative", "Scan noise", "illegal glyphs in one reading"),
    (10, "hard_negative", "Explained gap", "a unit cited as off the schedule"),
]


@dataclass
class Packet:
    case: int
    variant: int
    docs: list[tuple[str, str, datetime, str]] = field(default_factory=list)
    labels: dict[str, str] = field(default_factory=dict)
    focus: str = ""

    @property
    def id(self) -> str:
        return f"GP-{self.case:02d}{self.variant}"


def _vin(r: random.Random) -> str:
    return "".join(r.choice("ABCEFHJKLMNPRTUVWXY3479") for _ in range(17))


def _fleet(r: random.Random, n: int) -> list[dict]:
    makes = ["Orion Hauler", "Kestrel 900", "Borealis T2", "Mistral HD"]
    streets = ["4100 Quarry Commerce Rd", "77 Foundry Ln", "1520 Harbor Blvd"]
    return [{"unit": k + 1, "year": r.randint(2014, 2023), "make": r.choice(makes), "vin": _vin(r), "address": streets[k % 3], "value": r.randint(60, 160) * 1000} for k in range(n)]


def _schedule(fleet: list[dict], vin_head: str = "VIN") -> str:
    rows = [f"Unit | Year | Make/Model | {vin_head} | Garaging Address | Stated Value", "-" * 60]
    rows += [f"{u['unit']} | {u['year']} | {u['make']} | {u['vin']} | {u['address']} | ${u['value']:,}" for u in fleet]
    return "\n".join(["EQUIPMENT LIST", *rows])


def _losses(rows: list[tuple[str, str, int]]) -> str:
    out = ["Claim No | Date of Loss | Cause | Status | Incurred", "-" * 50]
    return "\n".join(["CARRIER REPORT", *out, *[f"{c} | 2023-02-11 | {why} | Closed | ${n:,}" for c, why, n in rows]])


def _form(**lines: str) -> str:
    return "APPLICATION FORM\n" + "\n".join(f"{k.replace('_', ' ').upper()}: {v}" for k, v in lines.items())


def _mail(subject: str, body: str) -> str:
    return f"From: broker@example.com\nTo: desk@example.com\nSubject: {subject}\n\n{body}\n"


def build(case: int, variant: int) -> Packet:
    """One labelled packet; the same arguments always give the same text."""
    r, p = random.Random(case * 1000 + variant), Packet(case, variant)
    at = datetime(2025, 1, 6, 9) + timedelta(days=variant)
    n = {8: 8, 10: 12}.get(case, r.randint(6, 10))
    fleet = _fleet(r, n)
    total, month = sum(u["value"] for u in fleet), "03/01/2025"
    stated, listed, count_words = n, fleet, "{} power units"
    amount, losses, story, extra = f"${total:,}", [("CL-1001", "Glass", 1800), ("CL-1002", "Backing", 6400)], "2 losses in the period, both minor.", []
    mail_date, lab = month, p.labels
    lab["policy::effective_date"] = "consistent"
    if case == 1:
        a, b = sorted(r.sample(range(n), 2))
        fleet[b]["vin"] = fleet[a]["vin"]
        p.focus = "policy::vin_uniqueness"
    elif case == 2:
        stated, p.focus = n + r.randint(1, 2), "policy::vehicle_count_reconciliation"
    elif case == 3:
        losses += [("CL-1003", "Rollover", 180_000), ("CL-1004", "Jackknife", 95_000)]
        p.focus = "policy::loss_history_completeness"
    elif case == 4:
        mail_date, p.focus = "05/01/2025", "policy::effective_date"
    elif case == 5:
        total += r.randint(3, 24) * 5000
        amount, p.focus = f"${total:,}", "policy::scheduled_value_reconciliation"
    elif case == 6:
        new = {"unit": n + 1, "vin": _vin(r), "value": r.randint(60, 160) * 1000}
        # The form's total already has the unit that the later note announces.
        amount = f"${total + new['value']:,}"
        extra.append(("email", "Change note", at + timedelta(days=13), _mail("Change to fleet", f"Please ADD Unit {n + 1} to the policy.\nVIN {new['vin']}, garaged with the rest.\nStated value ${new['value']:,}.\nThat makes {n + 1} power units.")))
        p.focus, lab["policy::stated_vehicle_count"], lab["policy::vehicle_count_reconciliation"] = "policy::stated_vehicle_count", "supersession", "consistent"
    elif case == 7:
        for u in fleet:
            u["address"] = {"77 Foundry Ln": "4100 Quarry Commerce Dr"}.get(u["address"], u["address"])
        p.focus = "policy::location_roster"
    elif case == 8:
        fleet[-1]["value"] += -total % 100_000 if -total % 100_000 else 0
        total = sum(u["value"] for u in fleet)
        amount, p.focus = f"${total:,}", "policy::total_scheduled_value"
        extra.append(("email", "Cover note", at + timedelta(days=2), _mail("Values", f"The total insured value of ${total / 1e6:.1f}M is as scheduled.")))
        lab["policy::scheduled_value_reconciliation"] = "consistent"
    elif case == 9:
        own = list(fleet[2]["vin"])
        own[3], own[9] = "1", "0"
        fleet[2]["vin"] = "".join(own)
        scan = dict(fleet[2], vin=fleet[2]["vin"].replace("1", "I").replace("0", "O"))
        extra.append(("schedule", "Rescanned page", at + timedelta(days=3), _schedule([scan], "VLN")))
        p.focus = "vehicle:unit-3::vin"
    else:
        gone = fleet[6]["unit"]
        listed = [u for u in fleet if u["unit"] != gone]
        amount = f"${sum(u['value'] for u in listed):,}"
        extra.append(("note", "Yard note", at + timedelta(days=1), f"Walked the yard today. Unit {gone} is OUT OF SERVICE with engine damage and was removed from the active schedule."))
        p.focus = "policy::vehicle_count_reconciliation"
    lab[p.focus] = {c: "conflict" for c in range(1, 6)}.get(case, {6: "supersession"}.get(case, "benign_variant"))
    if case in (1, 3, 4, 5, 7, 8, 9):
        lab["policy::vehicle_count_reconciliation"] = "consistent"
    places = len({u["address"] for u in listed})
    p.docs = [
        ("email", "Submission mail", at, _mail("New submission", f"Good morning, please quote the account effective {mail_date}.\nThe insured runs {count_words.format(stated)}.\n{story}")),
        ("application", "Application", at + timedelta(hours=1), _form(requested_effective_date=month, number_of_vehicles=str(stated), liability_limit="$1,000,000 CSL", total_scheduled_value=amount, garaging_locations=str(places))),
        ("schedule", "Equipment schedule", at + timedelta(hours=2), _schedule(listed)),
        ("loss_run", "Loss run", at + timedelta(hours=3), _losses(losses)),
        *extra,
    ]
    return p


def _rows(kind: str, number: int) -> list[tuple]:
    """The rows of a table that packet ``number`` (from 0) gives: ten cases to each variant."""
    case, bucket, *_ = TAXONOMY[number % len(TAXONOMY)]
    p = build(case, number // len(TAXONOMY) + 1)
    if kind == "packets":
        return [(p.id, number, f"Case {p.case}, variant {p.variant}", f"Carrier {p.id}", p.case, bucket, "made up", p.focus, "planted")]
    if kind == "documents":
        return [(p.id, k, f"{p.id}-D{k}", kind_, title, at, text) for k, (kind_, title, at, text) in enumerate(p.docs)]
    return [(p.id, k, v) for k, v in p.labels.items()]


def generated(spark: SparkSession, variants: int = 6, partitions: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(packets, documents, labels) of all ten cases, ``variants`` each, made in the tasks that read them.

    A packet's text follows from its number alone, so it is the same under any partitioning.
    """

    def table(kind: str, schema: str) -> DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]

        def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for ids in parts:
                for at in range(0, len(ids), 500):
                    rows = [r for n in ids["id"][at : at + 500] for r in _rows(kind, int(n))]
                    yield pd.DataFrame(rows, columns=names)

        numbers = spark.range(0, variants * len(TAXONOMY), 1, partitions or max(1, min(1000, variants // 10)))
        return numbers.mapInPandas(make, schema)

    return table("packets", PACKETS), table("documents", DOCUMENTS), table("labels", LABELS)


def known_failures(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(packets, documents, labels) that the engine is known to get wrong; never part of what is graded.

    A note adds a tenth unit, then a later mail repeats the old count by habit. A reader sees a change
    and a stale figure; the engine sees a conflict, because only the latest reading may announce a change.
    """
    at, vin = datetime(2025, 3, 3, 8), _vin(random.Random(77))
    texts = [
        ("application", "Application", at, _form(number_of_vehicles="9")),
        ("email", "Delivery of a truck", at + timedelta(days=6), _mail("One more truck", f"Please ADD Unit 10 to the policy.\nVIN {vin}, same yard.\nStated value $121,000.\nThat makes 10 power units.")),
        ("email", "Any news", at + timedelta(days=9), _mail("Any news", "Just asking after the quote for their 9 power units.")),
    ]
    key = "policy::stated_vehicle_count"
    packets = [("KF-1", 0, "Old count repeated after a change", "Carrier KF-1", 6, "hard_negative", "made up", key, "stale figure")]
    docs = [("KF-1", k, f"KF-1-D{k}", kind, title, when, text) for k, (kind, title, when, text) in enumerate(texts)]
    return spark.createDataFrame(packets, PACKETS), spark.createDataFrame(docs, DOCUMENTS), spark.createDataFrame([("KF-1", key, "supersession")], LABELS)


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAXONOMY, "id int, bucket string, name string, tests string")


def packet(packets: DataFrame, packet_id: str) -> DataFrame:
    return packets.where(F.col("packet_id") == packet_id).limit(1)


def taxonomy_case(cases: DataFrame, case_id: int) -> DataFrame:
    """The case's row; raises for an unknown one."""
    found = cases.where(F.col("id") == case_id)
    if found.isEmpty():
        raise KeyError(f"no taxonomy case {case_id}")
    return found
