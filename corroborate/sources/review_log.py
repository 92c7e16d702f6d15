"""The review log as a delta log: segments by bucket, and manifests that are switched as a whole.

    <path>/segments/<id>/bucket=<k>/part-*.parquet
    <path>/manifests/<version>.json

A write adds a segment that holds its own buckets only, then a manifest that names it. A manifest is made
beside and renamed into place, and the rename fails if that version is there: so readers see one version or
the next, two writers cannot both take a version, and what a crash leaves between segment and manifest is
named by none and read by nobody. Reading merges: of the decisions with one key the latest stands.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corroborate.operators import review as R


@dataclass
class Manifest:
    version: int = 0
    buckets: int = 64
    #: What is in force: segment id and the buckets it is read for, oldest first.
    segments: list[tuple[str, list[int]]] = field(default_factory=list)
    #: Last batch of each stream that is in the log.
    batches: dict[str, int] = field(default_factory=dict)


class ReviewLog:
    """A log under ``path``, which all executors share. ``buckets`` counts when the log is made."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self._buckets = spark, path.rstrip("/"), buckets

    # ---- manifests

    def _hadoop(self, path: str):
        jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return jpath, jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        jpath, fs = self._hadoop(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(jpath)) if fs.exists(jpath) else []

    def manifest(self) -> Manifest:
        """The latest version; without any, an empty log."""
        names = [x for x in self._names(f"{self.path}/manifests") if x.endswith(".json") and not x.startswith((".", "_"))]
        if not names:
            return Manifest(buckets=self._buckets)
        jpath, fs = self._hadoop(f"{self.path}/manifests/{names[-1]}")
        stream = fs.open(jpath)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        got = json.loads(text)
        return Manifest(got["version"], got["buckets"], [(s, b) for s, b in got["segments"]], got["batches"])

    def _commit(self, m: Manifest) -> bool:
        """Put version ``m.version`` in place; False if another writer has."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        made, fs = self._hadoop(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        stream = fs.create(made, False)
        stream.write(bytearray(json.dumps({"version": m.version, "buckets": m.buckets, "segments": m.segments, "batches": m.batches}).encode()))
        stream.close()
        to, _ = self._hadoop(f"{self.path}/manifests/{m.version:012d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(made, to, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as error:
            fs.delete(made, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    def _switch(self, change) -> Manifest:
        """Commit ``change`` of the latest manifest, of a later one if another writer was faster."""
        while True:
            m = change(self.manifest())
            m.version += 1
            if self._commit(m):
                return m

    # ---- segments

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64("packet_id"), F.lit(n)).cast("int")

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        segment = uuid.uuid4().hex
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/segments/{segment}")
        return segment, sorted(int(x.split("=")[1]) for x in self._names(f"{self.path}/segments/{segment}") if x.startswith("bucket="))

    def _stored(self, segments: list[tuple[str, list[int]]]) -> DataFrame:
        """All decisions of segments, with the version they came in by."""
        paths = [f"{self.path}/segments/{s}/bucket={b}" for s, buckets in segments for b in buckets]
        schema = f"{R.SCHEMA}, came int"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def _merged(stored: DataFrame) -> DataFrame:
        latest = Window.partitionBy("decision_id").orderBy(F.col("decided_at").desc(), F.col("came").desc())
        return stored.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")

    # ---- what users call

    def upsert(self, decisions: DataFrame, stream: str | None = None, batch: int | None = None) -> Manifest:
        """Add valid decisions; those that cannot be recorded are left out. Writes the buckets it touches.

        A ``batch`` of a ``stream`` that is in the log already is not added again.
        """
        now = self.manifest()
        if stream is not None and batch <= now.batches.get(stream, -1):
            return now
        good = R.tidy(decisions.where(R.problem().isNull())).select(*[c.split()[0] for c in R.SCHEMA.split(", ")])
        segment = self._write(good.withColumns({"came": F.lit(now.version + 1), "bucket": self._bucket(now.buckets)}))

        def change(m: Manifest) -> Manifest:
            if stream is not None:
                if batch <= m.batches.get(stream, -1):
                    return m
                m.batches[stream] = batch
            m.segments += [segment] if segment[1] else []
            return m

        return self._switch(change)

    def read(self, version: Manifest | None = None) -> DataFrame:
        """The decisions in force, one per key."""
        m = version or self.manifest()
        return self._merged(self._stored(m.segments)).drop("came")

    def decisions_for(self, packet_id: str) -> DataFrame:
        """The decisions on one packet; files of its bucket only are read."""
        m = self.manifest()
        own = self.spark.range(1).select(F.lit(packet_id).alias("packet_id")).select(self._bucket(m.buckets)).first()[0]
        held = [(s, [own]) for s, buckets in m.segments if own in buckets]
        return self._merged(self._stored(held).where(F.col("packet_id") == packet_id)).drop("came")

    def clear(self) -> Manifest:
        """An empty log as a new version."""

        def change(m: Manifest) -> Manifest:
            m.segments = []
            return m

        return self._switch(change)

    def compact(self, most: int = 8) -> Manifest:
        """Merge the buckets that more than ``most`` segments hold into one segment each; others stay as they are.

        What is added meanwhile stays, since only what was merged is replaced.
        """
        m = self.manifest()
        count = [0] * m.buckets
        for _, buckets in m.segments:
            for b in buckets:
                count[b] += 1
        full = {b for b, n in enumerate(count) if n > most}
        if not full:
            return m
        old = [(s, [b for b in buckets if b in full]) for s, buckets in m.segments]
        merged = self._merged(self._stored(old)).withColumn("bucket", self._bucket(m.buckets))
        segment, seen = self._write(merged), {s for s, _ in old}

        def change(now: Manifest) -> Manifest:
            if not seen <= {s for s, _ in now.segments}:
                return now  # cleared, or compacted by another
            kept = [(s, [b for b in buckets if s not in seen or b not in full]) for s, buckets in now.segments]
            now.segments = [segment] + [(s, b) for s, b in kept if b]
            return now

        return self._switch(change)

    def vacuum(self) -> list[str]:
        """Remove segments that the latest manifest does not name; no reader of an older version, and no writer, may be left."""
        named = {s for s, _ in self.manifest().segments}
        gone = [s for s in self._names(f"{self.path}/segments") if s not in named]
        for s in gone:
            jpath, fs = self._hadoop(f"{self.path}/segments/{s}")
            fs.delete(jpath, True)
        return gone
