"""Registered queries: each operator bound to the driver's star schema, events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corroborate.functions import normalize as N
from corroborate.functions import spans as S
from corroborate.operators import browse
from corroborate.operators import grade as G
from corroborate.operators import noise
from corroborate.operators import review as R
from corroborate.operators.rules import near_pairs
from corroborate.operators.similar import similar_pairs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c) -> F.Column:
    return F.col(c).cast("decimal(18,2)")


def value_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated order total against the sum of its lines: consistent, small gap, material, or not run."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", _cents("o_totalprice").alias("stated"))
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(_cents("l_extendedprice")).cast("decimal(18,2)").alias("summed"))
    rows = orders.join(sums, "o_orderkey", "left").withColumn("gap", (F.col("stated") - F.col("summed")).cast("decimal(18,2)"))
    cls = F.when(F.col("summed").isNull(), "not_run").when(F.col("gap") == 0, "consistent").when(F.abs("gap") * 20 >= F.col("stated"), "material_conflict").otherwise("conflict")
    return rows.select("o_orderkey", "stated", "summed", "gap", cls.alias("classification"))


def stored_sum_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rule where a stored sum exists: orders with an even key state it rightly, others 1 % over."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(_cents("l_extendedprice")).cast("decimal(18,2)").alias("summed"))
    stated = F.when(F.col("l_orderkey") % 2 == 0, F.col("summed")).otherwise((F.col("summed") * F.lit("1.01").cast("decimal(3,2)")).cast("decimal(18,2)"))
    return sums.withColumn("stated", stated).select("l_orderkey", "summed", "stated", F.when(F.col("stated") == F.col("summed"), "consistent").otherwise("conflict").alias("classification"))


def span_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of digits in the documents with its offsets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(S.matches(F.col("text"), "[0-9]+")).alias("m"), "text")
    return docs.select("doc_id", F.col("m.start").cast("long").alias("start"), (F.col("m.start") + F.length("m.raw")).cast("long").alias("stop"), F.col("m.raw").alias("raw"))


def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.lines(F.col("text"))).alias("line", "l"))
    return docs.select("doc_id", F.col("line").cast("long").alias("line"), F.col("l.start").cast("long").alias("start"), F.length("l.text").cast("long").alias("n_chars"))


def pipe_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of table lines (three pipes or more) with absolute offsets."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.lines(F.col("text"))).alias("line", "l")).where(S.is_table_line(F.col("l.text")))
    cells = lines.select("doc_id", "line", F.posexplode(S.cells(F.col("l.text"), F.col("l.start"))).alias("cell", "c"))
    return cells.select("doc_id", F.col("line").cast("long").alias("line"), F.col("cell").cast("long").alias("cell"), F.col("c.value").alias("value"), F.col("c.start").cast("long").alias("start"), F.col("c.end").cast("long").alias("stop"))


def glyph_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = N.vin_value(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", v.alias("v")).select("c_custkey", F.col("v.canonical").alias("folded"), F.col("v.domain_rule").isNotNull().alias("changed"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct part names that are similar to 0.85 or more (edit distance)."""
    return similar_pairs(table(spark, sf_dir, "part"), "p_name", 15)


def distinguishing_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names one token apart: the token position and both tokens."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct().withColumn("x", F.split("a", " "))
    # A name with one token left out is the key two such names share.
    holes = names.select("a", "x", F.posexplode("x").alias("pos", "token")).withColumn("rest", F.array_join(F.transform("x", lambda t, i: F.when(i == F.col("pos"), F.lit("*")).otherwise(t)), " "))
    one, two = holes.alias("p"), holes.alias("q")
    pairs = one.join(two, (F.col("p.rest") == F.col("q.rest")) & (F.col("p.pos") == F.col("q.pos"))).where(F.col("p.a") < F.col("q.a"))
    return pairs.select(F.col("p.a").alias("a"), F.col("q.a").alias("b"), F.col("p.pos").cast("long").alias("pos"), F.col("p.token").alias("token_a"), F.col("q.token").alias("token_b"))


def surface_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that are one text in several surface forms; blank lines count for nothing."""
    lines = table(spark, sf_dir, "documents").select(F.explode(S.lines(F.col("text"))).alias("l")).select(F.col("l.text").alias("line"))
    rows = lines.select(N.text_value(F.col("line"))["canonical"].alias("canonical"), "line").where("trim(canonical) <> ''")
    rows = rows.groupBy("canonical", "line").agg(F.count("*").alias("n")).groupBy("canonical").agg(F.count("*").alias("forms"), F.sum("n").alias("n"))
    return rows.where("n > 1").select("canonical", "forms", "n", F.when(F.col("forms") == 1, "consistent").otherwise("benign_variant").alias("classification"))


def effective_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turn of each conversation."""
    c = table(spark, sf_dir, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by(F.struct("role", "text"), F.struct("turn", "role", "text")).alias("x"))
    return last.select("conv_id", "turn", F.col("x.role").alias("role"), F.length("x.text").cast("long").alias("n_chars"))


def naive_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The control engine on parts: any two return flags or statuses are a conflict."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_returnflag", "l_linestatus").alias("forms"))
    return rows.select("l_partkey", "forms", F.when(F.col("forms") > 1, "conflict").otherwise("consistent").alias("classification"), F.when(F.col("forms") > 1, 80).otherwise(90).cast("long").alias("confidence_pct"))


def supersession_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: a differing last event supersedes if it is a change, conflicts if it is not."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    rows = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"), F.count_distinct("event_type").alias("kinds"))
    cls = F.when(F.col("kinds") == 1, "consistent").when(F.col("latest").isin("purchase", "signup"), "supersession").otherwise("conflict")
    return rows.select("user_id", "latest", "kinds", cls.alias("classification"))


def count_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated line count (largest number) against the lines there are; returned lines explain a gap."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.groupBy("l_orderkey").agg(F.max("l_linenumber").cast("long").alias("stated"), F.count("*").alias("scheduled"), F.count_if(F.col("l_returnflag") == "R").alias("explained"))
    delta = F.col("stated") - F.col("scheduled")
    cls = F.when(delta == 0, "consistent").when((delta > 0) & (delta == F.col("explained")), "benign_variant").otherwise("conflict")
    return rows.select("l_orderkey", "stated", "scheduled", "explained", cls.alias("classification"))


def uniqueness_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that more than 20 suppliers carry, and whether they are rated differently."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("carriers"), F.count_distinct("l_discount").alias("ratings"))
    return rows.where("carriers > 20").select("l_partkey", "carriers", (F.col("ratings") > 1).alias("rated_differently"))


def cap_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim per segment (no balance above 9,900; fewer than 290 customers) against the facts."""
    rows = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.max(_cents("c_acctbal")).alias("worst"), F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("worst_key"))
    broken = (F.col("n") >= 290).cast("long") + (F.col("worst") > 9900).cast("long")
    return rows.select("c_mktsegment", "n", "worst", "worst_key", broken.alias("breaches"))


def location_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct nations per segment against a stated 25."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment").agg(F.count_distinct("n_name").alias("places"))
    return rows.select("c_mktsegment", "places", F.when(F.col("places") == 25, "consistent").otherwise("conflict").alias("classification"))


def _graded(spark: SparkSession, sf_dir: str, rule: int = 0) -> DataFrame:
    """Labels graded against a rule over documents: each is a group, in one of four packets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels").withColumn("labelled", F.lit(True)), "doc_id", "left")
    key = F.array_join(F.array("lang", "source", F.col("doc_id").cast("string")), "|", "")
    rows = docs.select("*", F.concat(F.lit("p"), (F.col("doc_id") % 4).cast("string")).alias("packet_id"), key.alias("group_key"))
    want = F.when(F.col("toxic") == 1, "conflict").when(F.col("quality") == 0, "supersession").when(F.col("toxic").isNotNull() & (F.col("doc_id") % 7 == 3), "benign_variant")
    declared = rows.select("packet_id", "group_key", want.alias("expected")).where("expected is not null")
    size, k = F.col("n_chars"), F.col("doc_id") + rule
    told = F.when(size > 6000, "conflict").when(k % 5 == 0, "supersession").when(k % 5 == 1, "benign_variant").when(size < 300, "unresolved")
    findings = rows.select("packet_id", F.lit(1).alias("finding_seq"), "group_key", F.col("group_key").alias("label"), told.alias("classification"), ((50 + size % 50) / 100).alias("confidence"), F.array().cast("array<string>").alias("signals"))
    packets = rows.select("packet_id", F.lit("t").alias("title"), F.lit(0).alias("taxonomy_case"), F.lit("b").alias("bucket")).distinct()
    got = G.grade(packets, declared, findings.where("classification is not null"))
    part = F.split("group_key", "[|]")
    return got.select(
        part[2].cast("bigint").alias("doc_id"), F.nullif(part[0], F.lit("")).alias("lang"), F.nullif(part[1], F.lit("")).alias("source"), "declared", "expected", "predicted",
        F.round(F.col("confidence") * 100).cast("bigint").alias("pct"), "correct", "outcome",
    )


_GRADED_SQL = """
with declared as (
  select * from (select doc_id, case when toxic = 1 then 'conflict' when quality = 0 then 'supersession' when doc_id % 7 = 3 then 'benign_variant' end as expected from labels) where expected is not null),
findings{k} as (
  select doc_id, predicted, pct from (select doc_id, 50 + n_chars % 50 as pct, case when n_chars > 6000 then 'conflict' when (doc_id + {r}) % 5 = 0 then 'supersession'
    when (doc_id + {r}) % 5 = 1 then 'benign_variant' when n_chars < 300 then 'unresolved' end as predicted from documents) where predicted is not null),
graded{k} as (
  select *, expected = predicted as correct, case when expected = 'conflict' then case when predicted = 'conflict' then 'conflict_caught' else 'conflict_missed' end
      when predicted = 'conflict' then 'false_conflict' when expected = 'consistent' then case when predicted = 'consistent' then 'quiet' else 'noise' end
      when predicted = 'consistent' then 'dropped' when expected = predicted then 'label_correct' else 'label_wrong' end as outcome
  from (select doc_id, pct, d.expected is not null as declared, coalesce(d.expected, 'consistent') as expected, coalesce(f.predicted, 'consistent') as predicted
        from declared d full join findings{k} f using (doc_id)) join (select doc_id, lang, source from documents) using (doc_id))
"""


def graded_sql(rule: int = 0, k: str = "") -> str:
    return _GRADED_SQL.format(r=rule, k=k)


def grade_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).select("doc_id", "declared", "expected", "predicted", "outcome")


def headline_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerators and denominators of the headline rates; languages other than English are the hard negatives."""
    graded = _graded(spark, sf_dir).select(F.col("source").alias("packet_id"), F.when(F.col("lang") == "en", "true_conflict").otherwise("hard_negative").alias("bucket"), "declared", "expected", "predicted", "correct", "outcome")
    packets = table(spark, sf_dir, "documents").select(F.col("source").alias("packet_id"), F.when(F.col("lang") == "en", "true_conflict").otherwise("hard_negative").alias("bucket")).distinct()
    h = G.headline(graded, packets)
    names = ["hard_negative_packet_fpr", "hard_negative_group_fpr", "false_conflict_rate", "conflict_recall", "conflict_packet_recall", "label_accuracy", "noise_rate", "drop_rate"]
    return h.select("graded", "reported", *[F.col(f"{c}.{x}").alias(f"{c}_{x}") for c in names for x in ("n", "of")])


def packet_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = _graded(spark, sf_dir).withColumn("packet_id", F.col("source"))
    packets = table(spark, sf_dir, "documents").select(F.col("source").alias("packet_id"), F.lit("all").alias("bucket"), F.lit(0).alias("taxonomy_case")).distinct()
    return G.packet_rollup(graded, packets).drop("bucket", "taxonomy_case")


def case_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = _graded(spark, sf_dir).withColumn("taxonomy_case", F.col("lang"))
    packets = table(spark, sf_dir, "documents").select(F.col("lang").alias("taxonomy_case"), F.col("source").alias("packet_id")).distinct()
    cases = spark.createDataFrame([(x, "b", x) for x in ("de", "en", "es", "fr", "it")], "id string, bucket string, name string")
    out = G.case_rollup(graded, cases, packets)
    return out.select("taxonomy_case", "declared", "correct", "caught", "missed", "false_conflicts", "noise", "reported", "passed", F.coalesce(F.size("packets"), F.lit(0)).cast("long").alias("n_packets"))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.confusion(_graded(spark, sf_dir))


def _percent_bins(rows: DataFrame) -> DataFrame:
    return G.calibration(rows.withColumn("confidence", F.col("pct") / 100))


def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = _percent_bins(_graded(spark, sf_dir))
    return bins.select("bin", "n", "correct", F.coalesce(F.round(F.col("claimed") * F.col("n") * 100).cast("long"), F.lit(0)).alias("claimed_pct_sum"))


def calibration_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.calibration_error(_percent_bins(_graded(spark, sf_dir))).select(F.round("ece", 6).alias("ece"))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decisions: the user reviews, the value's thousandths are the finding, the type is the verdict."""
    e = table(spark, sf_dir, "events")
    verdict = F.when(F.col("event_type").isin("click", "view"), "accept").when(F.col("event_type") == "purchase", "reject").otherwise("unresolved")
    finding = (F.col("event_id") * 7 % 1000).cast("string")
    return e.select(F.lit("p").alias("packet_id"), finding.alias("group_key"), F.lit("reference").alias("engine"), F.lit("conflict").alias("pipeline_classification"), verdict.alias("verdict"), F.col("event_type").alias("reason"), F.col("user_id").cast("string").alias("reviewer"), F.col("ts").alias("decided_at"), F.col("event_id").alias("log_pos"))


_DECISIONS_SQL = """with decisions as (select 'p' as packet_id, cast(event_id * 7 % 1000 as varchar) as group_key, case when event_type in ('click', 'view') then 'accept' when event_type = 'purchase' then 'reject' else 'unresolved' end as verdict,
  event_type as reason, cast(user_id as varchar) as reviewer, ts as decided_at, event_id as log_pos from events)"""


def human_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.agreement(_decisions(spark, sf_dir)).select("accepted", "rejected", "unresolved", F.round("agreement", 6).alias("agreement"))


def disputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = _graded(spark, sf_dir).select(F.lit("p").alias("packet_id"), F.col("doc_id").cast("string").alias("group_key"), F.col("source").alias("label"), "expected", "predicted", (F.col("pct") / 100).alias("confidence"), "correct")
    return R.disputed(_decisions(spark, sf_dir), graded).select("group_key", "reviewer", "log_pos", "verdict", "expected", "predicted")


def pairwise_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.inter_reviewer(_decisions(spark, sf_dir)).select("findings", "pairs", "agreed", F.round("agreement", 6).alias("agreement"))


def engine_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = lambda rule: _graded(spark, sf_dir, rule).select(F.col("source").alias("packet_id"), F.col("doc_id").cast("string").alias("label"), "outcome").where("outcome in ('conflict_caught', 'false_conflict')")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("label"), "n_chars")
    # The second engine sees a conflict only in shorter texts than the first.
    other = shape(0).join(docs, "label").where("n_chars < 9000").drop("n_chars")
    return G.engine_delta(shape(0), other)


def upsert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decisions of one reviewer per event type on a finding per user: the latest stands."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("packet_id"), F.lit("g").alias("group_key"), F.lit("reference").alias("engine"), F.lit("c").alias("pipeline_classification"), F.lit("accept").alias("verdict"), F.concat(F.lit(" because "), F.col("event_id").cast("string"), F.lit(" ")).alias("reason"), F.col("event_type").alias("reviewer"), F.expr("ts + make_dt_interval(0, 0, 0, 0)").cast("timestamp").alias("decided_at"), "event_id")
    order = Window.partitionBy("packet_id", "reviewer").orderBy(F.col("decided_at").desc(), F.col("event_id").desc())
    fresh = rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "event_id")
    log = spark.createDataFrame([], R.SCHEMA)
    return R.upsert(log, fresh.where(R.problem().isNull())).select("decision_id", "packet_id", "reviewer", "reason")


def merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship-date intervals of a part (as long as the quantity, in days), merged."""
    li = table(spark, sf_dir, "lineitem")
    first = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    rows = li.select("l_partkey", first.alias("start"), (first + F.rint("l_quantity").cast("long")).alias("end"))
    return S.merge_spans(rows, ["l_partkey"]).select("l_partkey", F.col("start").alias("first_day"), F.col("end").alias("last_day"))


def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faceted rows (status and priority) summed up."""
    rows = G.facets(table(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority=None).where("o_totalprice > 1000")
    return rows.agg(F.count("*").alias("rows"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.avg(_cents("o_totalprice")).cast("double").alias("m")).select("rows", "urgent", F.round("m", 2).alias("mean_total"))


def prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders with the one before and after, -1 for none."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    beside = browse.neighbours(o, "o_orderkey", ["o_orderdate", "o_orderkey"], ["o_custkey"])
    return beside.select("o_orderkey", F.coalesce("previous", F.lit(-1)).alias("previous"), F.coalesce("next", F.lit(-1)).alias("next"))


def external_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported values in JSON joined to known keys; an unknown key keeps no evidence."""
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    return e.join(known, "k", "left").select("event_id", "k", F.coalesce("n_name", F.lit("")).alias("evidence"))


def noise_perturb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under seeded glyph noise."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") + 1000).alias("seed"))
    return noise.perturb(docs, "text", "seed", 0.015).select("doc_id", "text")


def normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money and count readings of order values written as text."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("total of $"), F.format_number(_cents("o_totalprice"), 2), F.lit(" USD")).alias("raw"))
    return o.select("o_orderkey", N.money_value(F.col("raw"))["numeric"].alias("money"), N.count_value(F.concat(F.lit("twelve (12) in "), F.col("o_orderkey").cast("string")))["canonical"].alias("count"))


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate addresses within a nation, made from customer numbers."""
    c = table(spark, sf_dir, "customer")
    c = c.select(F.col("c_nationkey").cast("string").alias("packet_id"), F.concat((F.col("c_custkey") % 100).cast("string"), F.lit(" MAIN QUARRY "), F.when(F.col("c_custkey") % 2 == 0, "ST").otherwise("AVE")).alias("address")).distinct()
    return near_pairs(c).select("packet_id", "a", "b", "told")


QUERIES = {
    f.__name__: f
    for f in (
        value_reconciliation, stored_sum_reconciliation, span_extract, line_offsets, pipe_cells, glyph_fold, near_duplicates, distinguishing_token, surface_variants, effective_value,
        naive_conflicts, supersession_gate, count_reconciliation, uniqueness_violation, cap_violation, location_count, grade_outcomes, headline_rates, packet_rollup, case_rollup,
        confusion_matrix, calibration_bins, calibration_ece, human_agreement, disputed, pairwise_agreement, engine_delta, upsert_log, merge_spans, facet_filter, prev_next, external_json,
        noise_perturb, normalizers, roster,
    )
}

_TALLY = """count(*) filter (declared) as declared, count(*) filter (declared and correct) as correct, count(*) filter (outcome = 'conflict_caught') as caught, count(*) filter (outcome = 'conflict_missed') as missed,
  count(*) filter (outcome = 'false_conflict') as false_conflicts, count(*) filter (outcome = 'noise') as noise, count(*) filter (outcome in ('conflict_caught', 'false_conflict', 'label_correct', 'label_wrong', 'noise')) as reported"""
_BINS = "(values (0, 0.0, 0.5), (1, 0.5, 0.6), (2, 0.6, 0.7), (3, 0.7, 0.8), (4, 0.8, 0.9), (5, 0.9, 0.95), (6, 0.95, 1.0001)) b(bin, lo, hi)"
_BINNED = f"binned as (select bin, count(pct) as n, count(*) filter (correct and pct is not null) as correct, cast(coalesce(sum(pct), 0) as bigint) as s from {_BINS} left join graded on pct / 100.0 >= lo and pct / 100.0 < hi group by bin)"

_GLYPHS = "".join(noise.CONFUSIONS)
_READ = " ".join(f"when '{g}' then " + (f"'{r[0]}'" if len(r) == 1 else f"case when later < 0.5 then '{r[0]}' else '{r[1]}' end") for g, r in noise.CONFUSIONS.items())

ORACLES = {
    "value_reconciliation": """with s as (select l_orderkey, cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(18,2)) as summed from lineitem group by 1),
 r as (select o_orderkey, cast(o_totalprice as decimal(18,2)) as stated, summed, cast(cast(o_totalprice as decimal(18,2)) - summed as decimal(18,2)) as gap from orders left join s on l_orderkey = o_orderkey)
 select *, case when summed is null then 'not_run' when gap = 0 then 'consistent' when abs(gap) * 20 >= stated then 'material_conflict' else 'conflict' end as classification from r""",
    "stored_sum_reconciliation": """with s as (select l_orderkey, cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(18,2)) as summed from lineitem group by 1),
 r as (select l_orderkey, summed, case when l_orderkey % 2 = 0 then summed else cast(summed * cast(1.01 as decimal(3,2)) as decimal(18,2)) end as stated from s)
 select *, case when stated = summed then 'consistent' else 'conflict' end as classification from r""",
    "span_extract": """with m as (select doc_id, regexp_extract_all(text, '[0-9]+') as w, regexp_split_to_array(text, '[0-9]+') as g from documents),
 e as (select doc_id, w, g, unnest(range(1, len(w) + 1)) as i from m)
 select doc_id, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) as bigint) as start,
 cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(w[1:i], lambda x: length(x))) as bigint) as stop, w[i] as raw from e""",
    "line_offsets": """with l as (select doc_id, string_split(text, chr(10)) as ls from documents), e as (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from l)
 select doc_id, i - 1 as line, cast(coalesce(list_sum(list_transform(ls[1:i-1], lambda x: length(x) + 1)), 0) as bigint) as start, cast(length(ls[i]) as bigint) as n_chars from e""",
    "pipe_cells": """with l as (select doc_id, string_split(text, chr(10)) as ls from documents), e as (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from l),
 t as (select doc_id, i - 1 as line, cast(coalesce(list_sum(list_transform(ls[1:i-1], lambda x: length(x) + 1)), 0) as bigint) as base, string_split(ls[i], '|') as cs from e where length(ls[i]) - length(replace(ls[i], '|', '')) >= 3),
 c as (select doc_id, line, base, cs, unnest(range(1, len(cs) + 1)) as k from t),
 p as (select doc_id, line, k - 1 as cell, trim(cs[k], ' ') as value, base + cast(coalesce(list_sum(list_transform(cs[1:k-1], lambda x: length(x) + 1)), 0) as bigint) + length(cs[k]) - length(ltrim(cs[k], ' ')) as start from c)
 select doc_id, line, cell, value, start, start + length(value) as stop from p""",
    "glyph_fold": """select c_custkey, translate(upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')), 'IOQ', '100') as folded, regexp_matches(upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')), '[IOQ]') as changed from customer""",
    "near_duplicates": """with n as (select distinct p_name as a from part)
 select x.a, y.a as b, levenshtein(x.a, y.a) as distance from n x join n y on x.a < y.a where levenshtein(x.a, y.a) * 100 <= greatest(length(x.a), length(y.a)) * 15""",
    "distinguishing_token": """with n as (select distinct p_name as a, string_split(p_name, ' ') as x from part),
 p as (select l.a, r.a as b, l.x, r.x as y from n l join n r on l.a < r.a and len(l.x) = len(r.x)),
 d as (select a, b, x, y, list_filter(range(1, len(x) + 1), lambda i: x[i] <> y[i]) as ps from p)
 select a, b, ps[1] - 1 as pos, x[ps[1]] as token_a, y[ps[1]] as token_b from d where len(ps) = 1""",
    "surface_variants": """with l as (select unnest(string_split(text, chr(10))) as line from documents),
 r as (select lower(regexp_replace(trim(line, ' '), '\\s+', ' ', 'g')) as canonical, count(distinct line) as forms, count(*) as n from l group by 1 having trim(canonical, ' ') <> '')
 select canonical, forms, n, case when forms = 1 then 'consistent' else 'benign_variant' end as classification from r where n > 1""",
    "effective_value": """select conv_id, turn, role, length(text) as n_chars from (select *, row_number() over (partition by conv_id order by turn desc, role desc, text desc) as k from conversations) where k = 1""",
    "naive_conflicts": """select l_partkey, forms, case when forms > 1 then 'conflict' else 'consistent' end as classification, cast(case when forms > 1 then 80 else 90 end as bigint) as confidence_pct
 from (select l_partkey, count(distinct l_returnflag || l_linestatus) as forms from lineitem group by 1)""",
    "supersession_gate": """with r as (select user_id, arg_max(event_type, (ts, event_id)) as latest, count(distinct event_type) as kinds from events group by 1)
 select *, case when kinds = 1 then 'consistent' when latest in ('purchase', 'signup') then 'supersession' else 'conflict' end as classification from r""",
    "count_reconciliation": """with r as (select l_orderkey, cast(max(l_linenumber) as bigint) as stated, count(*) as scheduled, count(*) filter (l_returnflag = 'R') as explained from lineitem group by 1)
 select *, case when stated = scheduled then 'consistent' when stated > scheduled and stated - scheduled = explained then 'benign_variant' else 'conflict' end as classification from r""",
    "uniqueness_violation": """select l_partkey, carriers, ratings > 1 as rated_differently from (select l_partkey, count(distinct l_suppkey) as carriers, count(distinct l_discount) as ratings from lineitem group by 1) where carriers > 20""",
    "cap_violation": """with r as (select c_mktsegment, count(*) as n, max(cast(c_acctbal as decimal(18,2))) as worst, arg_max(c_custkey, (c_acctbal, c_custkey)) as worst_key from customer group by 1)
 select *, cast(n >= 290 as bigint) + cast(worst > 9900 as bigint) as breaches from r""",
    "location_count": """select c_mktsegment, places, case when places = 25 then 'consistent' else 'conflict' end as classification from (select c_mktsegment, count(distinct n_name) as places from customer join nation on c_nationkey = n_nationkey group by 1)""",
    "grade_outcomes": graded_sql() + "select doc_id, declared, expected, predicted, outcome from graded",
    "headline_rates": graded_sql()
    + """, g as (select *, lang <> 'en' as hard from graded), p as (select distinct source, lang <> 'en' as hard from documents)
 select count(*) as graded, count(*) filter (outcome in ('conflict_caught', 'false_conflict', 'label_correct', 'label_wrong', 'noise')) as reported,
 count(distinct case when hard and outcome = 'false_conflict' then source end) as hard_negative_packet_fpr_n, (select count(*) from p where hard) as hard_negative_packet_fpr_of,
 count(*) filter (hard and outcome = 'false_conflict') as hard_negative_group_fpr_n, count(*) filter (hard) as hard_negative_group_fpr_of,
 count(*) filter (outcome = 'false_conflict') as false_conflict_rate_n, count(*) filter (expected <> 'conflict') as false_conflict_rate_of,
 count(*) filter (outcome = 'conflict_caught') as conflict_recall_n, count(*) filter (expected = 'conflict') as conflict_recall_of,
 count(distinct case when not hard and outcome = 'conflict_caught' then source end) as conflict_packet_recall_n, (select count(*) from p where not hard) as conflict_packet_recall_of,
 count(*) filter (declared and correct) as label_accuracy_n, count(*) filter (declared) as label_accuracy_of, count(*) filter (outcome = 'noise') as noise_rate_n, count(*) filter (not declared) as noise_rate_of,
 count(*) filter (outcome = 'dropped') as drop_rate_n, count(*) filter (declared and expected <> 'consistent') as drop_rate_of from g""",
    "packet_rollup": graded_sql()
    + f""", t as (select source, {_TALLY} from graded group by 1), p as (select distinct source as packet_id from documents)
 select packet_id, coalesce(declared, 0) as declared, coalesce(correct, 0) as correct, coalesce(caught, 0) as caught, coalesce(missed, 0) as missed, coalesce(false_conflicts, 0) as false_conflicts, coalesce(noise, 0) as noise,
 coalesce(reported, 0) as reported, coalesce(declared, 0) = coalesce(correct, 0) and coalesce(false_conflicts, 0) = 0 and coalesce(noise, 0) = 0 as passed from p left join t on source = packet_id""",
    "case_rollup": graded_sql()
    + f""", t as (select lang, {_TALLY} from graded group by 1), p as (select lang, count(distinct source) as n_packets from documents group by 1), c as (select unnest(['de', 'en', 'es', 'fr', 'it']) as taxonomy_case)
 select taxonomy_case, coalesce(declared, 0) as declared, coalesce(correct, 0) as correct, coalesce(caught, 0) as caught, coalesce(missed, 0) as missed, coalesce(false_conflicts, 0) as false_conflicts, coalesce(noise, 0) as noise,
 coalesce(reported, 0) as reported, coalesce(declared, 0) > 0 and declared = correct and false_conflicts = 0 and noise = 0 as passed, coalesce(n_packets, 0) as n_packets
 from c left join t on t.lang = taxonomy_case left join p on p.lang = taxonomy_case""",
    "confusion_matrix": graded_sql()
    + """, k as (select unnest(['conflict', 'supersession', 'benign_variant', 'unresolved', 'consistent']) as c)
 select x.c as expected, y.c as predicted, count(doc_id) as n from k x cross join k y left join (select * from graded where declared) g on g.expected = x.c and g.predicted = y.c group by 1, 2""",
    "calibration_bins": graded_sql() + f", {_BINNED} select bin, n, correct, s as claimed_pct_sum from binned",
    "calibration_ece": graded_sql() + f", {_BINNED} select round(sum(abs(correct - s / 100.0)) / sum(n), 6) as ece from binned",
    "human_agreement": _DECISIONS_SQL + """ select count(*) filter (verdict = 'accept') as accepted, count(*) filter (verdict = 'reject') as rejected, count(*) filter (verdict = 'unresolved') as unresolved,
 round(count(*) filter (verdict = 'accept') / count(*) filter (verdict <> 'unresolved'), 6) as agreement from decisions""",
    "disputed": graded_sql()
    + """, decisions as (select cast(event_id * 7 % 1000 as varchar) as group_key, case when event_type in ('click', 'view') then 'accept' when event_type = 'purchase' then 'reject' else 'unresolved' end as verdict, cast(user_id as varchar) as reviewer, event_id as log_pos from events)
 select group_key, reviewer, log_pos, verdict, expected, predicted from decisions join graded on group_key = cast(doc_id as varchar) where verdict <> 'unresolved' and (verdict = 'accept') <> correct""",
    "pairwise_agreement": _DECISIONS_SQL
    + """, v as (select *, row_number() over (partition by group_key, reviewer order by log_pos desc) as k from decisions), l as (select group_key, reviewer, verdict from v where k = 1),
 p as (select x.group_key, x.verdict = y.verdict as same from l x join l y on x.group_key = y.group_key and x.reviewer < y.reviewer)
 select count(distinct group_key) as findings, count(*) as pairs, count(*) filter (same) as agreed, round(count(*) filter (same) / count(*), 6) as agreement from p""",
    "engine_delta": graded_sql()
    + """, a as (select distinct outcome, source || ' · ' || doc_id as item from graded where outcome in ('conflict_caught', 'false_conflict')),
 b as (select distinct outcome, source || ' · ' || doc_id as item from graded join (select doc_id, n_chars from documents) using (doc_id) where outcome in ('conflict_caught', 'false_conflict') and n_chars < 9000)
 select case when outcome = 'conflict_caught' then 'caught_only_a' else 'false_only_a' end as kind, item from (select * from a except select * from b)
 union all select case when outcome = 'conflict_caught' then 'caught_only_b' else 'false_only_b' end, item from (select * from b except select * from a)""",
    "upsert_log": """select user_id || '::g::reference::' || event_type as decision_id, cast(user_id as varchar) as packet_id, event_type as reviewer, 'because ' || event_id as reason
 from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events) where k = 1""",
    "merge_spans": """with s as (select l_partkey, date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as a, date_diff('day', date '1970-01-01', cast(l_shipdate as date)) + cast(l_quantity as bigint) as b from lineitem),
 m as (select *, max(b) over (partition by l_partkey order by a, b rows between unbounded preceding and 1 preceding) as before from s),
 i as (select *, sum(case when before is null or a > before then 1 else 0 end) over (partition by l_partkey order by a, b rows unbounded preceding) as island from m)
 select l_partkey, min(a) as first_day, max(b) as last_day from i group by l_partkey, island""",
    "facet_filter": """select count(*) as rows, count(*) filter (o_orderpriority = '1-URGENT') as urgent, round(avg(cast(o_totalprice as decimal(18,2))), 2) as mean_total from orders where o_orderstatus = 'F' and o_totalprice > 1000""",
    "prev_next": """select o_orderkey, coalesce(lag(o_orderkey) over w, -1) as previous, coalesce(lead(o_orderkey) over w, -1) as next from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""",
    "external_json": """select event_id, cast(json_extract(props, '$.k') as bigint) as k, coalesce(n_name, '') as evidence from events left join nation on n_nationkey = cast(json_extract(props, '$.k') as bigint)""",
    # A draw is a glyph's own if an even number of hits stands right before it, else the reading of the hit before.
    "noise_perturb": f"""with d as (select doc_id, text, length(regexp_replace(text, '[^{_GLYPHS}]', '', 'g')) as glyphs from documents),
 j as (select doc_id, unnest(range(1, 2 * glyphs + 1)) as j from d), s as (select doc_id, j, cast((doc_id + 1000 + j * 1831565813) & 4294967295 as ubigint) as s from j),
 t as (select doc_id, j, (xor(s, s >> 15) * (s | 1)) & 4294967295 as t from s), x as (select doc_id, j, xor((t + ((xor(t, t >> 7) * (t | 61)) & 4294967295)) & 4294967295, t) as x from t),
 u as (select doc_id, j, cast(xor(x, x >> 14) as double) / 4294967296 as u from x),
 w as (select doc_id, j, u, lead(u) over (partition by doc_id order by j) as later, coalesce(max(case when u >= 0.015 then j end) over (partition by doc_id order by j rows between unbounded preceding and 1 preceding), 0) as miss from u),
 g as (select doc_id, row_number() over (partition by doc_id order by j) as i, u < 0.015 as hit, later from w where (j - 1 - miss) % 2 = 0),
 p as (select doc_id, unnest(regexp_extract_all(text, '[^{_GLYPHS}]*[{_GLYPHS}]')) as piece, generate_subscripts(regexp_extract_all(text, '[^{_GLYPHS}]*[{_GLYPHS}]'), 1) as i from d),
 o as (select doc_id, string_agg(case when hit then left(piece, length(piece) - 1) || case right(piece, 1) {_READ} end else piece end, '' order by i) as noisy from p join g using (doc_id, i) group by 1)
 select doc_id, coalesce(noisy, '') || regexp_extract(text, '[^{_GLYPHS}]*$') as text from d left join o using (doc_id)""",
    "normalizers": """select o_orderkey, cast(floor(cast(o_totalprice as decimal(18,2)) + 0.5) as bigint) as money, '12' as count from orders""",
    "roster": """with c as (select distinct cast(c_nationkey as varchar) as packet_id, (c_custkey % 100) || ' MAIN QUARRY ' || case when c_custkey % 2 = 0 then 'ST' else 'AVE' end as address from customer),
 p as (select x.packet_id, x.address as a, y.address as b, string_split(x.address, ' ') as s, string_split(y.address, ' ') as t from c x join c y on x.packet_id = y.packet_id and x.address < y.address),
 f as (select * from p where 1 - levenshtein(a, b) / greatest(length(a), length(b)) >= 0.85)
 select packet_id, a, b, case when s[1] <> t[1] then 'different street number (' || s[1] || ' vs ' || t[1] || ')' else 'different street suffix (' || s[4] || ' vs ' || t[4] || ')' end as told from f where (s[1] = t[1]) <> (s[4] = t[4])""",
}
