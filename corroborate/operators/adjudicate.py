"""Groups adjudicated by a model that the caller brings (a function from prompt to reply)."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.operators.grade import CLASSES
from corroborate.sources.runs import exists
from corroborate.sources.shared import shared_dir

REPLY = "classification string, confidence double, reason string"


def prompt() -> Column:
    """A group's readings as text."""
    line = F.transform("facts", lambda f: F.concat(F.lit("- "), F.date_format(f["received_at"], "yyyy-MM-dd"), F.lit(" "), f["document_title"], F.lit(': "'), f["raw"], F.lit('" read as '), f["value"]["canonical"]))
    return F.concat_ws("\n", F.concat(F.lit("Readings of "), "label"), F.array_join(line, "\n"), F.lit("Classify as one of: " + ", ".join(CLASSES) + '. Reply with JSON {"classification", "confidence", "reason"}.'))


def parse_reply(reply: Column) -> Column:
    """struct<classification, confidence, reason> of the reply's outermost braces, null if it is not valid."""
    low, high = F.locate("{", reply), F.length(reply) - F.locate("}", F.reverse(reply)) + 1
    got = F.from_json(F.substring(reply, low, high - low + 1), REPLY)
    good = got["classification"].isin(*CLASSES) & got["confidence"].between(0, 1) & (F.trim(got["reason"]) != "")
    return F.when((low > 0) & (F.locate("}", reply) > 0) & good, got)


class Unanswered(RuntimeError):
    """Groups without a usable reply; what was answered is kept in the store."""


@dataclass(frozen=True)
class Calls:
    """How the model is called: ``tasks`` at a time, in each ``threads``; a failed call is tried again after growing waits."""

    tasks: int = 6
    threads: int = 1
    attempts: int = 6
    first_wait: float = 1.0
    most_wait: float = 30.0
    #: The groups are asked in so many steps, and replies are written after each.
    steps: int = 1


def with_retries(model: Callable[[str], str], calls: Calls, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], tuple[str | None, str | None]]:
    """``model`` as a function to (reply, error). An exception with a false attribute ``retry`` is final at once."""

    def ask(prompt: str) -> tuple[str | None, str | None]:
        for k in range(calls.attempts):
            try:
                return model(prompt), None
            except Exception as e:  # noqa: BLE001  the caller's function may raise anything
                error, final = f"{type(e).__name__}: {e}"[:500], not getattr(e, "retry", True)
            if final or k + 1 == calls.attempts:
                break
            sleep(min(calls.most_wait, calls.first_wait * 2**k))
        return None, error

    return ask


def replies(prompts: DataFrame, model: Callable[[str], str], store: str, calls: Calls = Calls()) -> DataFrame:
    """(key, reply): what the model says to each distinct ``prompt``, one row per answered prompt.

    Replies are kept under ``store`` by the prompt's SHA-256, step by step, so a later run with the same
    store asks only what is missing: after failed calls, a lost job, or with new groups. Calls that fail
    for good leave no row.
    """
    spark = prompts.sparkSession
    asked = prompts.select(F.sha2("prompt", 256).alias("key"), "prompt").dropDuplicates(["key"])
    schema = "key string, reply string, error string"
    known = lambda: (spark.read.schema(schema).parquet(f"{store}/*") if exists(spark, store) else spark.createDataFrame([], schema)).where("reply is not null").select("key", "reply").dropDuplicates(["key"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = with_retries(model, calls)
        with ThreadPoolExecutor(calls.threads) as pool:
            for rows in parts:
                said = list(pool.map(ask, rows["prompt"]))
                yield pd.DataFrame({"key": rows["key"], "reply": [r for r, _ in said], "error": [e for _, e in said]}, dtype=object)

    for k in range(calls.steps):
        todo = asked.where(F.pmod(F.xxhash64("key"), F.lit(calls.steps)) == k).join(known(), "key", "left_anti")
        todo.repartition(calls.tasks, "key").mapInPandas(run, schema).write.parquet(f"{store}/{uuid.uuid4().hex}")
    return known()


def adjudicate(groups: DataFrame, model: Callable[[str], str], calls: Calls | int = Calls(), store: str | None = None) -> DataFrame:
    """Findings: single readings are consistent, other groups go to ``model``.

    Raises Unanswered if a group has no reply after all attempts, or an unusable one. With a ``store`` (a
    folder that all executors share) the replies there are stay, and the next run goes on from them.
    """
    calls = Calls(tasks=calls) if isinstance(calls, int) else calls
    single = groups.where(F.size("facts") <= 1).select("packet_id", "group_key", "label", "entity_key", F.lit("consistent").alias("classification"), F.lit(0.99).alias("confidence"), F.lit("single reading").alias("rationale"), F.array(F.lit("llm.single-assertion")).alias("signals"))
    many = groups.where(F.size("facts") > 1).select("packet_id", "group_key", "label", "entity_key", prompt().alias("prompt")).withColumn("key", F.sha2("prompt", 256))
    said = replies(many, model, store or f"{shared_dir(groups.sparkSession)}/corroborate/{uuid.uuid4().hex}/replies", calls)
    said = many.join(said, "key", "left").withColumn("r", parse_reply(F.col("reply")))
    bad = said.where(F.col("r").isNull())
    first = bad.orderBy("packet_id", "group_key").limit(1).collect()
    if first:
        what = "no reply" if first[0]["reply"] is None else "unusable reply"
        raise Unanswered(f"{what} for {first[0]['packet_id']} {first[0]['group_key']}; {bad.count()} groups are open")
    return single.unionByName(said.select("packet_id", "group_key", "label", "entity_key", "r.classification", "r.confidence", F.col("r.reason").alias("rationale"), F.array(F.lit("llm.adjudicated")).alias("signals")))
