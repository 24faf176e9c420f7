"""Stores: one folder of Parquet tables per snapshot, with a version, a LATEST pointer and derived artifacts.

``root/stores/<store id>/<table>.parquet`` holds the tables of a snapshot, ``root/LATEST`` the id of the newest one
and ``root/cache/<key>.parquet`` derived tables. Writes go to a new folder and are published by renaming it, so a
reader never sees half a table.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.sources.tables import SCHEMAS

#: Versions of the tables' layout and of the derived graph's.
FACTS_VERSION, GRAPH_VERSION = 3, 1


class StoreError(Exception):
    """A store that can't be read: not found, ambiguous, or of another version."""


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jvm_path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # files ------------------------------------------------------------------------------------------------------

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._jvm_path(path))

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._jvm_path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, path: str, text: str) -> None:
        stream = self._fs.create(self._jvm_path(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _publish(self, made: str, path: str) -> None:
        if self._exists(path):
            self._fs.delete(self._jvm_path(path), True)
        self._fs.mkdirs(self._jvm_path(path).getParent())
        if not self._fs.rename(self._jvm_path(made), self._jvm_path(path)):
            raise StoreError(f"can't publish {path}")

    # snapshots --------------------------------------------------------------------------------------------------

    def ids(self) -> list[str]:
        """Store ids, sorted."""
        at = self._jvm_path(f"{self.root}/stores")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def resolve(self, prefix: str | None = None) -> str:
        """The id that a prefix names, the LATEST one without a prefix."""
        if prefix is None:
            if not self._exists(f"{self.root}/LATEST"):
                raise StoreError("there is no store yet")
            return self._read(f"{self.root}/LATEST").strip()
        hits = [i for i in self.ids() if i.startswith(prefix)]
        if len(hits) != 1:
            raise StoreError(f"{len(hits)} stores start with {prefix!r}")
        return hits[0]

    def write(self, store_id: str, tables: dict[str, DataFrame], append: bool = False) -> None:
        """Write tables of a snapshot and make it the LATEST. Columns must be the data model's, in any order; nothing
        is written where one doesn't fit. ``append`` adds to the tables of a snapshot of the same version."""
        for name, df in tables.items():
            check_schema(name, df)
        if append and self._exists(f"{self.root}/stores/{store_id}/meta.json"):
            self.gate(store_id)
        for name, df in tables.items():
            path = f"{self.root}/stores/{store_id}/{name}.parquet"
            ordered = df.select(*[f.name for f in _schema(name)])
            if append:
                ordered.write.mode("append").parquet(path)
            else:
                made = f"{self.root}/.made-{uuid.uuid4().hex}"
                ordered.write.parquet(made)
                self._publish(made, path)
        self._write(f"{self.root}/stores/{store_id}/meta.json", json.dumps({"facts": FACTS_VERSION, "graph": GRAPH_VERSION}))
        self._write(f"{self.root}/LATEST", store_id)
        self.purge()

    def gate(self, store_id: str) -> None:
        """Fail at once where a snapshot is of another version."""
        path = f"{self.root}/stores/{store_id}/meta.json"
        meta = json.loads(self._read(path)) if self._exists(path) else {}
        if meta.get("facts") != FACTS_VERSION or meta.get("graph") != GRAPH_VERSION:
            raise StoreError(f"store {store_id} has versions {meta}; facts {FACTS_VERSION} and graph {GRAPH_VERSION} are read here")

    def read(self, name: str, prefix: str | None = None) -> DataFrame:
        """A table of a snapshot, through the version gate; a table that wasn't written is empty."""
        store_id = self.resolve(prefix)
        self.gate(store_id)
        path = f"{self.root}/stores/{store_id}/{name}.parquet"
        return self.spark.read.schema(_schema(name)).parquet(path) if self._exists(path) else self.spark.createDataFrame([], _schema(name))

    def inventory(self) -> DataFrame:
        """(store_id, latest, id, solution_path, created_at_utc_text, commit): runs of every readable snapshot."""
        latest = self.resolve() if self._exists(f"{self.root}/LATEST") else None
        out = None
        for i in self.ids():
            try:
                runs = self.read("runs", i)
            except StoreError:
                continue
            rows = runs.select(F.lit(i).alias("store_id"), F.lit(i == latest).alias("latest"), "id", "solution_path", "created_at_utc_text", F.substring("source_commit", 1, 12).alias("commit"))
            out = rows if out is None else out.unionAll(rows)
        return out if out is not None else self.spark.createDataFrame([], "store_id string, latest boolean, id string, solution_path string, created_at_utc_text string, commit string")

    # derived tables ---------------------------------------------------------------------------------------------

    def key(self, kind: str, version: int, store_id: str, rules: str, **params) -> str:
        """A hash of all that a derived table depends on."""
        text = json.dumps([kind, version, store_id, rules, params], sort_keys=True)
        return hashlib.sha256(text.encode()).hexdigest()

    def cached(self, key: str, make) -> DataFrame:
        """The derived table of a key, made and kept where it isn't there yet."""
        path = f"{self.root}/cache/{key}.parquet"
        if not self._exists(path):
            made = f"{self.root}/.made-{uuid.uuid4().hex}"
            make().write.parquet(made)
            self._publish(made, path)
        return self.spark.read.parquet(path)

    def purge(self) -> None:
        """Forget all derived tables."""
        at = self._jvm_path(f"{self.root}/cache")
        if self._fs.exists(at):
            self._fs.delete(at, True)

    def build_graph(self, store_id: str, graph: dict[str, DataFrame]) -> None:
        """Write derived graph tables (call_edges and others) of a snapshot, each published as a whole; repeating it
        gives the same tables."""
        for name, df in graph.items():
            made = f"{self.root}/.made-{uuid.uuid4().hex}"
            df.write.parquet(made)
            self._publish(made, f"{self.root}/stores/{store_id}/{name}.parquet")


def _schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def check_schema(name: str, df: DataFrame) -> None:
    """Fail where a table lacks a column of the data model or has it in another type."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in _schema(name) if have.get(f.name) != f.dataType]
    if wrong:
        raise StoreError(f"{name}: columns missing or of another type: {', '.join(wrong)}")


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header; arrays and structs as JSON, tabs and line ends in strings as spaces."""
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        if isinstance(f.dataType, T.StringType):
            c = F.regexp_replace(c, r"[\t\r\n]", " ")
        cols.append(c.alias(f.name))
    df.select(*cols).write.mode("overwrite").option("header", True).option("sep", "\t").option("quote", "").csv(path)
