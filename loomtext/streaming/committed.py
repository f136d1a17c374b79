"""Tables in versions: written aside, then published all at once by one rename.

A table is a folder with ``data`` (a folder for each version) and ``log`` (a
manifest for each version, numbered). A version counts from the moment its
manifest has its name, so a run that dies before leaves nothing but a folder
that nobody reads; a batch that is published again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another run has published the version in the meantime."""


class Versions:
    """The versions of one table, through Spark's own file system layer."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for part in ("data", "log"):
            self._fs.mkdirs(self._Path(f"{self.path}/{part}"))

    def manifest(self) -> dict | None:
        """The newest one: version, batch, data, state."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._Path(f"{self.path}/log"))]
        known = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(("_", "."))]
        if not known:
            return None
        stream = self._fs.open(self._Path(f"{self.path}/log/{max(known):012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        """The table as last published; None before that."""
        now = self.manifest()
        return None if now is None else self.spark.read.parquet(f"{self.path}/{now['data']}")

    def publish(self, batch: str, make: Callable[[DataFrame | None], DataFrame], state: dict | None = None, before: Callable[[DataFrame], None] | None = None) -> dict:
        """Make the next version from the last one and publish it; a batch that is the last one published is left as it is.

        ``before`` is called with the written rows before they are published (sinks
        go there): if it fails, nothing is published, and the batch can be run again.
        """
        last = self.manifest()
        if last and last["batch"] == batch:
            return last
        data = f"data/{uuid.uuid4().hex}"
        make(self.read()).write.parquet(f"{self.path}/{data}")
        if before:
            before(self.spark.read.parquet(f"{self.path}/{data}"))
        new = {"version": (last["version"] if last else 0) + 1, "batch": batch, "data": data, "state": state or {}}
        aside = self._Path(f"{self.path}/log/_{uuid.uuid4().hex}")
        out = self._fs.create(aside)
        try:
            out.write(bytearray(json.dumps(new).encode()))
        finally:
            out.close()
        name = self._Path(f"{self.path}/log/{new['version']:012d}.json")
        if self._fs.exists(name) or not self._fs.rename(aside, name):
            self._fs.delete(aside, False)
            raise Conflict(f"version {new['version']} of {self.path} is there already")
        return new

    def sweep(self) -> int:
        """Delete the folders of no published version; not while another run is writing. Gives their number."""
        logs = [f.getPath() for f in self._fs.listStatus(self._Path(f"{self.path}/log"))]
        kept, gone = set(), 0
        for p in logs:
            if p.getName().endswith(".json") and not p.getName().startswith(("_", ".")):
                stream = self._fs.open(p)
                try:
                    kept.add(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["data"])
                finally:
                    stream.close()
        for f in self._fs.listStatus(self._Path(f"{self.path}/data")):
            if f"data/{f.getPath().getName()}" not in kept:
                self._fs.delete(f.getPath(), True)
                gone += 1
        return gone


def merged(cached: DataFrame | None, live: DataFrame, key: str, hand: DataFrame | None = None) -> DataFrame:
    """The rows of a feed after a refresh: live rows replace cached ones of their key, cached ones that are gone stay, hand-written ones win; ``is_new`` marks keys that weren't cached."""
    rows = live.withColumn("is_new", F.lit(True))
    if cached is not None:
        old = cached.drop("is_new")
        rows = live.join(old.select(key, F.lit(False).alias("_old")), key, "left").withColumn("is_new", F.coalesce("_old", F.lit(True))).drop("_old")
        rows = rows.unionByName(old.join(live.select(key), key, "left_anti").withColumn("is_new", F.lit(False)), allowMissingColumns=True)
    if hand is None:
        return rows
    return rows.join(hand.select(key), key, "left_anti").unionByName(hand.withColumn("is_new", F.lit(False)), allowMissingColumns=True)


def refresh(table: Versions, batch: str, live: DataFrame, key: str, sink: Callable[[DataFrame], None], hand: DataFrame | None = None, keep_new: bool = False) -> dict:
    """Refresh a feed: merge, hand the rows to ``sink``, then publish them with the lengths.

    The state has ``length_curr`` and ``length_old``: what is new is new against
    length_old, which moves up only after the sink has succeeded, with the same
    rename that publishes the rows, and not at all with ``keep_new``.
    """
    last = table.manifest()
    if last and last["batch"] == batch:
        return last
    old = last["state"]["length_old"] if last else 0
    state: dict = {}

    def hand_over(rows: DataFrame) -> None:
        sink(rows)
        state["length_curr"] = rows.count()
        state["length_old"] = old if keep_new else state["length_curr"]

    return table.publish(batch, lambda cached: merged(cached, live, key, hand), state, hand_over)
