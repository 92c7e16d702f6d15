"""Queries that run extraction over documents rendered from orders and their lines.

The texts are schedules, loss runs, application forms and mails; the SQL beside each query renders the
same text only to know where a reading stands, and states the readings from the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corroborate.operators import extract as X
from corroborate.plans.queries import table

KEY = "o_orderkey"


def read(texts: DataFrame) -> DataFrame:
    """Facts of (o_orderkey, content), each order a packet of one document."""
    docs = texts.select(
        F.col(KEY).cast("string").alias("packet_id"), F.lit(0).alias("doc_pos"), F.lit("D").alias("doc_id"), F.lit("note").alias("kind"), F.lit("T").alias("title"),
        F.lit("2025-06-01 00:00:00").cast("timestamp").alias("received_at"), "content",
    )
    return X.read_facts(docs).select(
        F.col("packet_id").cast("bigint").alias(KEY), "entity_key", "field", F.col("value.canonical").alias("canonical"), "raw", F.col("start").cast("bigint").alias("start"), "confidence",
        F.coalesce("value.domain_rule", F.lit("")).alias("rule"), F.coalesce("value.ambiguous", F.lit(False)).alias("ambiguous"), F.coalesce("change_intent", F.lit("")).alias("intent"), (F.col("quote") == F.col("raw")).alias("quoted"),
    )


def _text(c: Column) -> Column:
    return c.cast("string")


def _cat(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _pick(key: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt evenly by ``key``: reading a text costs far more than moving its rows, however few files
    there are. The number of parts is given, as AQE would else make few of so few bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    return _dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").withColumn("unit", F.row_number().over(order))


_UNITS_SQL = """with units as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_returnflag, l_linestatus) as unit from lineitem)"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(table(spark, sf_dir, "orders").select(KEY, "o_totalprice", "o_orderdate"), KEY)


def extract_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of an equipment list and a loss run per order, one row of each per line.

    Every third header is misread (VLN), accepted lines carry no unit number, every fourth claim id is not one.
    """
    u, key = _units(spark, sf_dir), F.col("l_orderkey")
    dollars = _cat("$", F.format_number(F.floor("l_extendedprice").cast("bigint"), 0))
    vin = _cat(F.when(F.col("unit") % 2 == 1, "IM8GDM9A").otherwise("1M8GDM9A"), F.lpad(_text(F.col("l_partkey")), 9, "0"))
    row = _cat(
        F.when(F.col("l_returnflag") == "A", "n/a").otherwise(_text(F.col("unit"))), " | ", _text(1990 + F.col("l_suppkey") % 35), " | Kestrel ", _text(F.col("l_partkey") % 7), " | ", vin,
        " |  ", _text(F.col("l_suppkey") % 90), " North Main Street | ", dollars,
    )
    claim = _cat(F.when(F.col("unit") % 4 == 0, "CLM-").otherwise("CL-"), _text(F.col("unit") + 100), " | 2023-02-11 | ", F.col("l_linestatus"), " | ", dollars)
    lines = u.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("unit", row.alias("row"), claim.alias("claim")))).alias("rows"))
    head = F.when(key % 3 == 0, EQUIPMENT.replace("VIN", "VLN")).otherwise(EQUIPMENT)
    rows = lambda c: F.array_join(F.transform("rows", lambda r: r[c]), "\n")
    return read(lines.select(key.alias(KEY), _cat(head, rows("row"), CARRIER, rows("claim"), "\nend of file").alias("content")))


def extract_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of an application form per order; labels in lower case, or unknown, are none."""
    o, key, n = _orders(spark, sf_dir), F.col(KEY), F.floor("o_totalprice").cast("bigint")
    date = F.date_format(F.col("o_orderdate").cast("timestamp"), "M/d/yyyy")
    units = _cat(_pick(key, "three (3)", "4", "seven", "five (6)"), _pick(key, "", " ", " vehicles"))
    limit = _cat("$", _text(key % 9 + 1), _pick(key, "M CSL", ",000,000", " million combined single limit"))
    content = _cat(
        "APPLICATION FORM\n", _pick(key, "REQUESTED EFFECTIVE DATE: ", "EFFECTIVE DATE : "), date, "\n", _pick(key, "POWER UNITS: ", "NUMBER OF VEHICLES (ALL):  "), units, "\ngaraging locations: 9\nLIABILITY LIMIT: ", limit,
        "\nTOTAL SCHEDULED VALUE: $", F.format_number(n, 0), "\nCONTACT: 8 people\nGARAGING LOCATIONS: ", _text(key % 12), "\n",
    )
    return read(o.select(KEY, content.alias("content")))


#: A mail header, a form line and a table: their dates, counts and units are no prose.
PASSED_OVER = "From: a@example.com\nSubject: effective 1/2/2003 with 5 trucks\n\nPOWER UNITS: 4 trucks\nUnit | Note | VIN | x\n7 | effective 1/2/2003 | 6 trucks | Unit 3 is laid up\n\n"
EQUIPMENT, CARRIER = "EQUIPMENT LIST\nUnit | Year | Make/Model | VIN | Garaging Address | Stated Value\n----------\n", "\n\nCARRIER REPORT\nClaim No | Date | Cause | Incurred\n=====+=====\n"


def extract_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of running text: eight mails by order number, under a header, a form line and a table that must be passed over."""
    o, key, n = _orders(spark, sf_dir), F.col(KEY), F.floor("o_totalprice").cast("bigint")
    date = F.date_format(F.col("o_orderdate").cast("timestamp"), "M/d/yyyy")
    unit, vin, money = _text(key % 50 + 1), _cat("1M8GDM9A", F.lpad(_text(key % 100000), 9, "0")), _cat("$", F.format_number(n, 0))
    said = [
        _cat("Please quote effective ", date, ". The insured runs ", _text(key % 290 + 1), " power\nunits."),
        _cat("We amend the terms, effective ", date, ". Coverage is for a ", date, ", with a total insured value of ", money, "."),
        _cat("It incepts; incepting on March ", _text(key % 28 + 1), ". The limit is $", _text(key % 5 + 1), "M CSL."),
        _cat("There were ", _text(key % 9), " losses in the period, all minor. No claims over ", money, "."),
        _cat("Please ADD Unit ", unit, ".\nVIN ", vin, ", garaged here. Stated value ", money, "."),
        _cat("REVISE Unit ", unit, " (VIN ", vin, ") from $1,000 to ", money, "."),
        _cat("Unit ", unit, ", VIN ", vin, ", is OUT OF SERVICE and was removed from the active schedule."),
        _cat("Unit ", unit, " is laid up. Also twelve (12) trucks and ", date, " effective date."),
    ]
    mail = F.element_at(F.array(*said), (key % 8 + 1).cast("int"))
    return read(o.select(KEY, _cat(PASSED_OVER, mail).alias("content")))


QUERIES = {f.__name__: f for f in (extract_tables, extract_labels, extract_prose)}



def _thousands(n: str) -> str:
    """A whole number below 10^9 with commas."""
    s = f"cast({n} as varchar)"
    return f"case when {n} >= 1000000 then {s}[:-7] || ',' || {s}[-6:-4] || ',' || {s}[-3:] when {n} >= 1000 then {s}[:-4] || ',' || {s}[-3:] else {s} end"


def _picked(key: str, *values: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[{key} % {len(values)} + 1]"


ORACLES = {
    "extract_tables": _UNITS_SQL
    + f""", r as (select l_orderkey as k, unit, l_returnflag = 'A' as skipped, case when l_returnflag = 'A' then 'n/a' else cast(unit as varchar) end as c1, cast(1990 + l_suppkey % 35 as varchar) as c2, 'Kestrel ' || l_partkey % 7 as c3,
   case when unit % 2 = 1 then 'I' else '1' end || 'M8GDM9A' || lpad(cast(l_partkey as varchar), 9, '0') as c4, (l_suppkey % 90) || ' North Main Street' as c5, '$' || {_thousands("cast(floor(l_extendedprice) as bigint)")} as c6, cast(floor(l_extendedprice) as bigint) as n,
   case when unit % 4 = 0 then 'CLM-' else 'CL-' end || (unit + 100) as id, l_linestatus as cause from units),
 w as (select *, length(c1) + length(c2) + length(c3) + length(c4) + length(c5) + length(c6) + 17 as size, length(id) + length(cause) + length(c6) + 20 as size2 from r),
 p as (select *, {len(EQUIPMENT)} + sum(size) over (partition by k order by unit) - size as pos, {len(EQUIPMENT) - 1 + len(CARRIER)} + sum(size) over (partition by k) + sum(size2) over (partition by k order by unit) - size2 as pos2 from w),
 f as (select k, 'vehicle:unit-' || unit as entity_key, 'vin' as field, '1' || c4[2:] as canonical, c4 as raw, pos + length(c1) + length(c2) + length(c3) + 9 as start, c4[1] = 'I' as ruled, true as quoted, 1 as kind, skipped from p
   union all select k, 'vehicle:unit-' || unit, 'garaging_address', split_part(c5, ' ', 1) || ' N MAIN ST', c5, pos + length(c1) + length(c2) + length(c3) + length(c4) + 13, true, true, 1, skipped from p
   union all select k, 'vehicle:unit-' || unit, 'stated_value', cast(n as varchar), c6, pos + size - length(c6) - 1, false, true, 1, skipped from p
   union all select k, 'vehicle:unit-' || unit, 'year_make_model', c2 || ' kestrel ' || c3[9:], c2 || ' ' || c3, pos + length(c1) + 3, false, false, 1, skipped from p
   union all select k, 'loss:' || id, 'loss_incurred', cast(n as varchar), c6, pos2 + size2 - length(c6) - 1, false, true, 2, unit % 4 = 0 from p
   union all select k, 'loss:' || id, 'loss_cause', lower(cause), cause, pos2 + length(id) + 16, false, true, 2, unit % 4 = 0 from p)
 select k as o_orderkey, entity_key, field, canonical, raw, cast(start as bigint) as start, cast(case when kind = 1 and k % 3 = 0 then 0.9 else 0.97 end as double) as confidence,
 case when not ruled then '' when field = 'vin' then 'vin.illegal-glyph-folding' else 'address.suffix-family-folding' end as rule, false as ambiguous, '' as intent, quoted from f where not skipped""",
    "extract_labels": f"""with o as (select o_orderkey as k, cast(floor(o_totalprice) as bigint) as n, strftime(o_orderdate, '%-m/%-d/%Y') as d, strftime(o_orderdate, '%Y-%m-%d') as iso from orders),
 v as (select *, {_picked("k", "REQUESTED EFFECTIVE DATE: ", "EFFECTIVE DATE : ")} as l1, {_picked("k", "POWER UNITS: ", "NUMBER OF VEHICLES (ALL):  ")} as l2, rtrim({_picked("k", "three (3)", "4", "seven", "five (6)")} || {_picked("k", "", " ", " vehicles")}) as u, '$' || (k % 9 + 1) || {_picked("k", "M CSL", ",000,000", " million combined single limit")} as lim, '$' || {_thousands("n")} as total from o),
 t as (select *, 17 + length(l1) as a1, 17 + length(l1) + length(d) + 1 + length(l2) as a2, 17 + length(l1) + length(d) + 1 + length(l2) + length({_picked("k", "three (3)", "4", "seven", "five (6)")} || {_picked("k", "", " ", " vehicles")}) + 23 + 17 as a3 from v),
 f as (select k, 'effective_date' as field, iso as canonical, d as raw, a1 as start, '' as rule, false as ambiguous from t
   union all select k, 'stated_vehicle_count', {_picked("k", "3", "4", "7", "6")}, u, a2, {_picked("k", "count.dual-assertion", "", "", "")}, k % 4 = 3 from t
   union all select k, 'liability_limit', (k % 9 + 1) || '000000 ' || {_picked("k", "CSL", "UNSPECIFIED", "CSL")}, lim, a3, {_picked("k", "money.magnitude-shorthand", "", "money.magnitude-shorthand + limit.basis-from-prose")}, false from t
   union all select k, 'total_scheduled_value', cast(n as varchar), total, a3 + length(lim) + 24, '', false from t
   union all select k, 'garaging_location_count', cast(k % 12 as varchar), cast(k % 12 as varchar), a3 + length(lim) + 24 + length(total) + 39, '', false from t)
 select k as o_orderkey, 'policy' as entity_key, field, canonical, raw, start, cast(0.95 as double) as confidence, rule, ambiguous, '' as intent, true as quoted from f""",
    "extract_prose": f"""with o as (select o_orderkey as k, cast(floor(o_totalprice) as bigint) as n, strftime(o_orderdate, '%-m/%-d/%Y') as d, strftime(o_orderdate, '%Y-%m-%d') as iso, cast(o_orderkey % 50 + 1 as varchar) as u, '1M8GDM9A' || lpad(cast(o_orderkey % 100000 as varchar), 9, '0') as vin from orders),
 v as (select *, 'vehicle:unit-' || u as ent, '$' || {_thousands("n")} as m from o),
 f as (select k, 'policy' as entity_key, 'stated_vehicle_count' as field, '4' as canonical, '4 trucks' as raw, -{PASSED_OVER.index('4 trucks')} as pos, 0.95 as confidence, '' as rule, '' as intent from v
   union all select k, 'vehicle:unit-7', 'vin', '6TRUCKS', '6 trucks', -{PASSED_OVER.index('6 trucks')}, 0.97, '', '' from v
   union all select k, 'policy', 'effective_date', iso, d, 23, 0.88, '', '' from v where k % 8 = 0
   union all select k, 'policy', 'stated_vehicle_count', cast(k % 290 + 1 as varchar), (k % 290 + 1) || ' power' || chr(10) || 'units', 25 + length(d) + 17, 0.86, '', '' from v where k % 8 = 0
   union all select k, 'policy', 'total_scheduled_value', cast(n as varchar), m || '.', 30 + 2 * length(d) + 52, 0.85, '', 'revise' from v where k % 8 = 1
   union all select k, 'policy', 'effective_date', '2025-03-' || lpad(cast(k % 28 + 1 as varchar), 2, '0'), 'March ' || (k % 28 + 1), 25, 0.72, '', '' from v where k % 8 = 2
   union all select k, 'policy', 'liability_limit', (k % 5 + 1) || '000000 CSL', '$' || (k % 5 + 1) || 'M CSL', 31 + length(cast(k % 28 + 1 as varchar)) + 15, 0.85, 'money.magnitude-shorthand', '' from v where k % 8 = 2
   union all select k, 'policy', 'loss_summary_claim', 'count=' || k % 9, (k % 9) || ' losses in the period, all minor', 11, 0.74, '', '' from v where k % 8 = 3
   union all select k, 'policy', 'loss_summary_claim', 'cap=' || n, 'No claims over ' || m || '.', 46, 0.74, '', '' from v where k % 8 = 3
   union all select k, 'policy', 'loss_summary_claim', 'qualifier=minor', 'all minor', 35, 0.74, '', '' from v where k % 8 = 3
   union all select k, ent, 'endorsement_add_unit', u, 'Unit ' || u, 11, 0.92, '', 'add' from v where k % 8 = 4
   union all select k, ent, 'vin', vin, vin, 22 + length(u), 0.92, '', 'add' from v where k % 8 = 4
   union all select k, ent, 'stated_value', cast(n as varchar), m, 22 + length(u) + 17 + 29, 0.92, '', 'add' from v where k % 8 = 4
   union all select k, ent, 'stated_value', cast(n as varchar), m, 12 + length(u) + 6 + 17 + 17, 0.93, '', 'revise' from v where k % 8 = 5
   union all select k, ent, 'vin', vin, vin, 12 + length(u) + 6, 0.93, '', 'revise' from v where k % 8 = 5
   union all select k, ent, 'unit_status', 'out_of_service;removed_from_schedule', 'Unit ' || u || ', VIN ' || vin || ', is OUT OF SERVICE', 0, 0.88, '', '' from v where k % 8 = 6
   union all select k, ent, 'vin', vin, vin, 11 + length(u), 0.88, '', '' from v where k % 8 = 6
   union all select k, ent, 'unit_status', 'out_of_service', 'Unit ' || u || ' is laid up', 0, 0.8, '', '' from v where k % 8 = 7
   union all select k, 'policy', 'stated_vehicle_count', '12', 'twelve (12) trucks', 23 + length(u), 0.86, 'count.dual-assertion', '' from v where k % 8 = 7
   union all select k, 'policy', 'effective_date', iso, d, 18 + length(u) + 28, 0.88, '', '' from v where k % 8 = 7)
 select k as o_orderkey, entity_key, field, canonical, raw, cast(case when pos < 0 then -pos else {len(PASSED_OVER)} + pos end as bigint) as start, cast(confidence as double) as confidence, rule, false as ambiguous, intent, true as quoted from f""",
}
