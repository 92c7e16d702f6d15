"""The evidence pipeline: documents to findings, both engines over one extraction, and grading."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corroborate.operators import browse
from corroborate.operators import classify as C
from corroborate.operators import extract as X
from corroborate.operators import grade as G
from corroborate.operators import link as L
from corroborate.operators import review as R
from corroborate.operators import rules as U
from corroborate.sources.runs import borrow_evidence
from corroborate.sources.shared import materialize

SPANS = "array<struct<document_id:string,start:int,end:int,quote:string>>"


@dataclass(frozen=True)
class Analysis:
    facts: DataFrame
    tables: DataFrame
    groups: DataFrame
    findings: DataFrame


def _numbered(findings: DataFrame, engine: str) -> DataFrame:
    """Derived findings first, then observed ones by entity."""
    order = Window.partitionBy("packet_id").orderBy(F.when(F.col("derived"), 0).otherwise(1), "entity_key", "group_key")
    return findings.withColumn("engine", F.lit(engine)).withColumn("finding_seq", F.row_number().over(order))


def analyze(documents: DataFrame, rules: list[U.Rule] | None = None) -> Analysis:
    """Findings of the main engine. Documents with blank content count for nothing."""
    got = X.extract(documents.where(F.trim("content") != ""))
    # Both engines and every rule read these tables: written once, so plans stay small.
    got = X.Extraction(materialize(got.facts, "facts"), materialize(got.tables, "tables"))
    groups = materialize(L.groups(got.facts), "groups")
    state = materialize(U.packets(got.facts, got.tables), "packets")
    findings = U.derive(state, rules).withColumn("derived", F.lit(True)).unionByName(U.observed(state).withColumn("derived", F.lit(False)))
    return Analysis(got.facts, got.tables, groups, materialize(_numbered(findings, "reference"), "findings"))


def analyze_naive(analysis: Analysis) -> DataFrame:
    """The control engine's findings over the same groups; no rules."""
    return _numbered(C.classify_naive(analysis.groups).withColumn("explained_by", F.array().cast(SPANS)).withColumn("derived", F.lit(False)), "naive")


@dataclass(frozen=True)
class Score:
    graded: DataFrame
    headline: DataFrame
    confusion: DataFrame
    calibration: DataFrame
    packets: DataFrame
    cases: DataFrame


def score(packets: DataFrame, labels: DataFrame, findings: DataFrame, cases: DataFrame) -> Score:
    """All figures of an engine; the graded rows are written once, and one pass over them feeds all rollups."""
    graded = materialize(G.grade(packets, labels, findings), "graded")
    shown, rolled = graded.where(G.reported(F.col("outcome"))), materialize(G.rollups(graded, packets), "rollups")
    return Score(graded, G.headline_of(rolled), G.confusion(graded), G.calibration(shown), G.packets_of(rolled), G.cases_of(rolled, cases))


def exit_status(*scores: Score) -> int:
    """What a command that reports scores should end with: 1 if a taxonomy case fails in any of them, else 0."""
    return int(any(not s.cases.where(~F.col("passed")).isEmpty() for s in scores))


@dataclass(frozen=True)
class Bench:
    main: Score
    control: Score
    delta: DataFrame
    human: DataFrame
    human_control: DataFrame


def bench(packets: DataFrame, documents: DataFrame, labels: DataFrame, cases: DataFrame, decisions: DataFrame) -> Bench:
    """Both engines on the same extraction, their scores and what sets them apart; decisions count for the engine they judge."""
    analysis = analyze(documents)
    a = score(packets, labels, analysis.findings, cases)
    b = score(packets, labels, analyze_naive(analysis), cases)
    return Bench(a, b, G.engine_delta(a.graded, b.graded), R.agreement(decisions.where("engine = 'reference'")), R.agreement(decisions.where("engine = 'naive'")))


@dataclass(frozen=True)
class Reviews:
    """How reviewers and the engine agree, on one engine's graded rows."""

    agreement: DataFrame
    disputed: DataFrame
    calibration: DataFrame
    reviewers: DataFrame


def score_reviews(decisions: DataFrame, graded: DataFrame) -> Reviews:
    """All figures of a review log; decisions on groups that were not graded count in the verdicts only."""
    return Reviews(R.agreement(decisions), R.disputed(decisions, graded), R.human_calibration(decisions, graded), R.inter_reviewer(decisions))


@dataclass(frozen=True)
class External:
    external: Score
    main: Score
    delta: DataFrame


def grade_external(run: DataFrame, packets: DataFrame, labels: DataFrame, cases: DataFrame, analysis: Analysis) -> External:
    """A run reported from outside (``runs.read_run``) and the main engine, on the same labels.

    Raises BadInput for a packet that is not in the corpus.
    """
    theirs = score(packets, labels, borrow_evidence(run, packets, analysis.groups), cases)
    ours = score(packets, labels, analysis.findings, cases)
    return External(theirs, ours, G.engine_delta(ours.graded, theirs.graded))


def report(s: Score) -> list[str]:
    """The headline as fixed-width lines (a handful of numbers reach the driver)."""
    row = s.headline.first().asDict(recursive=True)
    rate = lambda x: "—" if x["value"] is None else f"{100 * x['value']:.1f}%"
    out = [f"{k.replace('_', ' '):<28}{rate(v):>8}  ({v['n']}/{v['of']})" for k, v in row.items() if isinstance(v, dict)]
    return [*out, f"{'review load':<28}{row['review_load']:>8.2f}"]


#: What a difference between engines means, in the order it is told.
DIFFERENCES = {
    "caught_only_a": "caught only by the main engine", "caught_only_b": "caught only by the {other}",
    "false_only_b": "false alarms of the {other} alone", "false_only_a": "false alarms of the main engine alone",
}


def comparison(main: Score, other: Score, delta: DataFrame, name: str = "baseline") -> list[str]:
    """Both engines' headline side by side, then what sets them apart (``delta`` of one corpus: a short list)."""
    rows = browse.ablation(main.headline, other.headline).collect()
    out = [f"{'':<44}{'main':>20}{name:>20}", *[f"{r['measure']:<44}{r['a']:>20}{r['b']:>20}" for r in rows]]
    apart = delta.orderBy("kind", "item").collect()
    for kind, text in DIFFERENCES.items():
        items = [r["item"] for r in apart if r["kind"] == kind]
        out += ["", text.format(other=name), *[f"  {x}" for x in items]] if items else []
    return out
