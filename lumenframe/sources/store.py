"""The catalog on disk: Parquet snapshots and a pointer to the current one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.catalog import CLUSTERS, EMBEDDINGS, FILES, IMAGES

TABLES: dict[str, T.StructType] = {
    "files": FILES,
    "images": IMAGES,
    "embeddings": EMBEDDINGS,
    "clusters": CLUSTERS,
    "keepers": T.StructType([T.StructField("cluster_id", T.LongType()), T.StructField("keeper_file_id", T.LongType())]),
    "decisions": T.StructType([T.StructField("content_hash", T.StringType()), T.StructField("state", T.StringType()), T.StructField("decided_at", T.LongType())]),
    "resolutions": T.StructType([T.StructField("content_hash", T.StringType()), T.StructField("keeper_path", T.StringType())]),
    "verdicts": T.StructType([T.StructField(n, T.StringType()) for n in ("cluster_hash", "model", "keeper_hash", "reason")]),
}

#: From schema version i + 1 to i + 2: what to do with the tables. Version 1 is the first.
MIGRATIONS: list[Callable[[dict[str, DataFrame]], dict[str, DataFrame]]] = []


class Store:
    """Versioned tables below a folder. Writers put new data beside the old and then name it in a new pointer file.

    The pointer of a version appears by one rename to a name that must not exist, so readers see the last whole
    version and of two writers of one version the second fails. Readers keep the snapshot that they opened.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointers")
        self._fs = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self.state = self._read() or {"schema": len(MIGRATIONS) + 1, "version": 0, "tables": {}}
        if self.state["schema"] > len(MIGRATIONS) + 1:
            raise ValueError(f"the catalog has schema {self.state['schema']}, newer than {len(MIGRATIONS) + 1}")
        while self.state["schema"] < len(MIGRATIONS) + 1:
            new = MIGRATIONS[self.state["schema"] - 1]({n: self.table(n) for n in TABLES})
            self.state["schema"] += 1
            self.put(**new)

    def _read(self) -> dict | None:
        if not self._fs.exists(self._folder):
            return None
        names = [f.getPath().getName() for f in self._fs.listStatus(self._folder)]
        last = max((n for n in names if n.startswith("v")), default=None)
        if last is None:
            return None
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/pointers/{last}").collect()))

    def table(self, name: str) -> DataFrame:
        at = self.state["tables"].get(name)
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in TABLES[name]])
        return self.spark.read.schema(schema).parquet(at) if at else self.spark.createDataFrame([], schema)

    def put(self, **tables: DataFrame) -> None:
        """Replace tables, all at once."""
        state = json.loads(json.dumps(self.state))
        state["version"] += 1
        for name, df in tables.items():
            fields = TABLES[name].fieldNames()
            at = f"{self.path}/{name}/{state['version']}-{uuid.uuid4().hex}"
            df.select(*[F.col(c).cast(TABLES[name][c].dataType) if c in df.columns else F.lit(None).cast(TABLES[name][c].dataType).alias(c) for c in fields]).write.parquet(at)
            state["tables"][name] = at
        jvm = self.spark._jvm
        new = jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointers/.next-{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        pointer = jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointers/v{state['version']:012d}")
        if self._fs.exists(pointer) or not self._fs.rename(new, pointer):
            raise OSError(f"version {state['version']} of {self.path} was written by another")
        self.state = state
