"""Evidence as a stream: documents are read row by row, readings are kept per packet, findings follow.

The state of a packet holds the sorted readings of each of its groups. A batch opens only the groups it
adds to, and emits their findings anew, so a late document re-emits what it changes and nothing else. The
review log takes decisions as upserts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructType

from corroborate.functions import normalize as N
from corroborate.operators import classify as C
from corroborate.operators import extract as X
from corroborate.operators import link as L
from corroborate.sources.review_log import ReviewLog

#: What ``adjudicate`` needs in spark.sql.streaming.stateStore.providerClass.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def readings(docs: DataFrame) -> DataFrame:
    """(packet_id, entity_key, field, at, document_id, start, seq, reading, names_unit, itemised): facts to be grouped.

    ``reading`` is the struct that groups carry, as JSON; ``seq`` numbers the facts of a document. Row by row.
    """
    read = X.read_documents(docs)
    unit = F.exists("facts", lambda f: N.unit_number(f["entity_key"]).isNotNull())
    has = lambda field: F.exists("facts", lambda f: f["field"] == field)
    order = lambda f: F.struct(f["stage"].alias("a"), f["k1"].alias("b"), F.when(f["stage"] == 2, f["start"]).otherwise(f["k"]).alias("c"), f["k"].alias("d"), f.alias("f"))
    numbered = F.transform(F.sort_array(F.transform("facts", order)), lambda x, i: F.struct((i + 1).alias("seq"), x["f"].alias("f")))
    rows = read.withColumns({"names_unit": unit, "itemised": unit & has("vin") & has("stated_value"), "numbered": numbered})
    rows = rows.select("packet_id", "doc_id", "title", "received_at", "names_unit", "itemised", F.inline_outer("numbered")).where(F.col("f").isNotNull())
    rows = rows.select(
        "packet_id", F.col("f.entity_key").alias("entity_key"), F.col("f.field").alias("field"), F.col("doc_id").alias("document_id"), F.col("title").alias("document_title"), "received_at", F.col("seq").alias("fact_seq"),
        F.concat_ws(":", "doc_id", "f.entity_key", "f.field", F.col("f.start").cast("string")).alias("fact_id"), F.col("f.raw").alias("raw"), F.col("f.value").alias("value"),
        F.struct(F.col("doc_id").alias("document_id"), F.col("f.start").alias("start"), F.col("f.end").alias("end"), F.col("f.quote").alias("quote")).alias("span"), F.col("f.confidence").alias("confidence"), F.col("f.change_intent").alias("change_intent"), "names_unit", "itemised",
    )
    rows = L.evidence(rows.where(~F.col("field").isin(*L.SUPPORTING)))
    return rows.select(
        "packet_id", "entity_key", "field", F.coalesce(F.unix_micros("received_at"), F.lit(-(1 << 62))).alias("at"), "document_id", F.col("span.start").alias("start"), F.col("fact_seq").alias("seq"),
        F.to_json("ev", TIMES).alias("reading"), "names_unit", "itemised",
    )


class Groups(StatefulProcessor):
    """Keeps each group's readings in order; emits the groups that a batch adds to."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        text = lambda name: StructType().add(name, StringType())
        self.groups = handle.getMapState("groups", text("grp"), text("readings"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[tuple, list] = {}
        for part in rows:
            for x in part.itertuples(index=False):
                fresh.setdefault((x.entity_key, x.field), []).append([int(x.at), x.document_id, int(x.start), int(x.seq), x.reading, bool(x.names_unit), bool(x.itemised)])
        out = []
        for group, added in fresh.items():
            name = (json.dumps(group),)
            held = json.loads(self.groups.getValue(name)[0]) if self.groups.containsKey(name) else []
            known = {tuple(x[:4]) for x in held}
            more = {tuple(x[:4]): x for x in added if tuple(x[:4]) not in known}  # a document that comes again adds nothing
            if more:
                held = sorted([*held, *more.values()], key=lambda x: x[:4])
                self.groups.updateValue(name, (json.dumps(held),))
                out.append((key[0], *group, [x[4] for x in held], *held[-1][5:]))
        yield pd.DataFrame(out, columns=["packet_id", "entity_key", "field", "readings", "names_unit", "itemised"])

    def close(self) -> None:
        pass


CHANGED = "packet_id string, entity_key string, field string, readings array<string>, names_unit boolean, itemised boolean"


def adjudicate(docs: DataFrame) -> DataFrame:
    """Findings of the groups that each batch of a stream of documents adds readings to, in the shape of ``classify``.

    The last finding of a group is that of the batch engine over all documents so far, in whatever order and
    batches they came; only ``fact_seq`` of its evidence counts per document and not per packet. A packet's
    state is opened group by group. Needs STATE_STORE.
    """
    rows = readings(docs)
    kind = "struct<received_at:timestamp,document_id:string,start:int,fact_seq:int,fact_id:string,raw:string,value:" + N.VALUE + ",span:struct<document_id:string,start:int,end:int,quote:string>,confidence:double,change_intent:string,entity_key:string,field:string,document_title:string>"
    changed = rows.groupBy("packet_id").transformWithStateInPandas(Groups(), CHANGED, "Update", "None")
    facts = F.transform("readings", lambda r: F.from_json(r, kind, TIMES))
    return C.judged(
        changed.select("packet_id", L.group_key(F.col("entity_key"), F.col("field")).alias("group_key"), "entity_key", "field", L.group_label(F.col("entity_key"), F.col("field")).alias("label"), facts.alias("facts"), "names_unit", "itemised")
    )


def review_upserts(spark: SparkSession, path: str, name: str = "reviews") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over decisions: each batch goes into the log once, and writes its own buckets only."""
    log = ReviewLog(spark, path)

    def batch(decisions: DataFrame, number: int) -> None:
        log.upsert(decisions, name, number)
        log.compact()

    return batch


def windowed_arrivals(docs: DataFrame, late: str = "2 days", width: str = "1 day") -> DataFrame:
    """Documents per kind and window of arrival, closed ``late`` after the latest seen."""
    return docs.withWatermark("received_at", late).groupBy(F.window("received_at", width), "kind").agg(F.count("*").alias("n"))
