"""A table of replaceable partitions whose state changes by publishing one manifest file.

Each commit writes the replaced partitions beside the old ones and then creates the next
numbered manifest. Creation fails if that number exists, so of two writers one wins whole and
a reader or a crashed writer never sees a part of a commit. A batch that was already
committed is skipped, which makes replays of a failed job harmless. The folder must lie on a file
system that renames atomically. One table may hold several kinds of rows, each with its own schema
and its partitions named `kind:...`, so that they change together.

`vacuum` removes folders that the newest state no longer names once they are older than a given age:
younger ones may be what another writer is about to publish, or what a reader still reads.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Seconds that a folder no state names is kept.
KEEP_S = 3600


class VersionedTable:
    """Partitions by name, each a folder of Parquet files with a small dictionary of statistics. `schema` is one schema, or one by kind."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str | dict[str, str]):
        self.spark, self.root = spark, root.rstrip("/")
        of = lambda s: s if isinstance(s, StructType) else spark.createDataFrame([], s).schema
        self.schemas = {k: of(s) for k, s in schema.items()} if isinstance(schema, dict) else {"": of(schema)}
        self.schema = next(iter(self.schemas.values()))
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        folder = self._path(f"{self.root}/_manifest")
        if not self._fs.exists(folder):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self) -> dict:
        found = self._manifests()
        if not found:
            return {"version": 0, "last_batch": None, "parts": {}}
        stream = self._fs.open(self._path(f"{self.root}/_manifest/{found[-1]:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def parts(self, state: dict, kind: str = "") -> list[str]:
        return [p for p in state["parts"] if not kind or p.startswith(f"{kind}:")]

    def read(self, parts: Iterable[str] | None = None, state: dict | None = None, kind: str = "") -> DataFrame:
        state = state or self.state()
        paths = [state["parts"][p]["path"] for p in (self.parts(state, kind) if parts is None else parts) if p in state["parts"]]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[kind])
        return self.spark.read.schema(self.schemas[kind]).parquet(*paths)

    def write(self, df: DataFrame, by: Column | None = None, kind: str = "") -> dict[str, str]:
        """Write rows aside and return folder by partition name; `by` gives the partition, else there is one of the name ''. Rows with a null partition are refused."""
        out = f"{self.root}/data/{int(time.time()):012d}-{uuid.uuid4().hex}"
        cols = self.schemas[kind].fieldNames()
        if by is None:
            df.select(*cols).write.parquet(out)
            return {"": out}
        of = F.coalesce(by.cast("string"), F.raise_error(F.lit(f"a row of {self.root} has no partition")))
        # Rebalanced, a partition is a few files however many tasks made it, and a large one is still shared out.
        df.select(*cols, of.alias("_part")).hint("rebalance", F.col("_part")).write.partitionBy("_part").parquet(out)
        status = self._fs.listStatus(self._path(out))
        names = [f.getPath().getName() for f in status]
        return {n.removeprefix("_part="): f"{out}/{n}" for n in names if n.startswith("_part=")}

    def commit(self, base: dict, put: dict[str, dict], drop: list[str] = (), batch: int | None = None) -> dict:
        """Publish `put` (name to {"path", "stats"}) and `drop` on top of state `base`; raises if another commit came first."""
        parts = {k: v for k, v in base["parts"].items() if k not in drop} | put
        new = {"version": base["version"] + 1, "last_batch": base["last_batch"] if batch is None else batch, "parts": parts}
        temp = self._path(f"{self.root}/_manifest/.{uuid.uuid4().hex}")
        stream = self._fs.create(temp, False)
        try:
            stream.write(bytearray(json.dumps(new).encode()))
        finally:
            stream.close()
        target = self._path(f"{self.root}/_manifest/{new['version']:012d}.json")
        if self._fs.exists(target) or not self._fs.rename(temp, target):
            self._fs.delete(temp, False)
            raise RuntimeError(f"version {new['version']} of {self.root} was committed by another writer")
        return new

    def vacuum(self, keep: dict, age_s: float = KEEP_S) -> None:
        """Delete partition folders that state `keep` does not name and that were begun more than `age_s` ago."""
        live = {v["path"].removeprefix(f"{self.root}/data/").split("/")[0] for v in keep["parts"].values()}
        folder = self._path(f"{self.root}/data")
        if not self._fs.exists(folder):
            return
        for f in self._fs.listStatus(folder):
            name = f.getPath().getName()
            if name not in live and int(name.split("-")[0]) + age_s < time.time():
                self._fs.delete(f.getPath(), True)
