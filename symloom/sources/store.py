"""Versioned snapshots of an index: tables in Parquet below a state folder, and one file that names the current snapshot.

A snapshot is written whole beside the others and becomes current when a pointer with the next number is renamed into its place. No pointer is written
over or removed before the next is there, so readers see all of an update, resolution included, or nothing of it, whenever a job dies; what a dead
job leaves is a folder that nobody reads.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom import shared
from symloom.operators import graph
from symloom.schema import TABLES, struct

SCHEMA_VERSION = 2
POINTERS = "pointers"
#: How tables are laid out, for the lookups that verbs make.
SORTED = {"symbols": ["file_id", "id"], "calls": ["callee_symbol_id", "id"], "refs": ["symbol_id", "id"], "edges": ["src", "kind_rank", "row_id", "top_id", "dst"]}


def _add_doc_comment(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return tables | {"symbols": tables["symbols"].withColumn("doc_comment", F.lit(None).cast("string"))}


#: From each version to the next: functions over the tables.
MIGRATIONS = {1: _add_doc_comment}


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path if "://" in path or path.startswith("file:") else "file://" + path

    def _pointers(self) -> list[str]:
        """Names of the pointers, the current one last."""
        return sorted(n for n in shared.names(self.spark, f"{self.path}/{POINTERS}") if n.endswith(".json") and not n.startswith("."))

    def _meta(self) -> dict | None:
        while found := self._pointers():
            try:
                return json.loads(shared.read_text(self.spark, f"{self.path}/{POINTERS}/{found[-1]}"))
            except Py4JJavaError:
                if found == self._pointers():  # not gone since for a newer one
                    raise
        return None

    def exists(self) -> bool:
        return self._meta() is not None

    def version(self) -> int:
        return (self._meta() or {}).get("schema_version", 0)

    def open(self) -> int:
        """Creates the store, empty, or brings an older one to the current version; gives the version."""
        meta = self._meta()
        if meta is None:
            self.publish({n: self.spark.createDataFrame([], struct(ddl)) for n, ddl in TABLES.items()})
        elif meta["schema_version"] < SCHEMA_VERSION:
            tables = {n: self.spark.read.parquet(f"{self.path}/{meta['snapshot']}/{n}") for n in TABLES}
            for v in range(meta["schema_version"], SCHEMA_VERSION):
                tables = MIGRATIONS[v](tables) if v in MIGRATIONS else tables
            self.publish(tables)
        elif meta["schema_version"] > SCHEMA_VERSION:
            raise ValueError(f"the store has version {meta['schema_version']}, this engine knows {SCHEMA_VERSION}")
        return SCHEMA_VERSION

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.read(n) for n in TABLES}

    def read(self, name: str) -> DataFrame:
        meta = self._meta()
        if meta is None:
            raise FileNotFoundError(f"no index at {self.path}")
        return self.spark.read.parquet(f"{self.path}/{meta['snapshot']}/{name}")

    def publish(self, tables: dict[str, DataFrame], schema_version: int = SCHEMA_VERSION) -> None:
        """Writes a snapshot, with the edges made of its tables, and makes it current; the one before the last is removed."""
        before = self._meta() or {}
        name = f"snapshots/{uuid.uuid4().hex}"

        def write(table: str, df: DataFrame) -> DataFrame:
            keys = SORTED.get(table)
            (df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df).write.parquet(f"{self.path}/{name}/{table}")
            return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}/{table}")

        with ThreadPoolExecutor(4) as pool:  # tables are independent jobs, most of them small
            done = dict(zip(tables, pool.map(write, tables, tables.values())))
        write("edges", graph.edges(done["symbols"], done["calls"], done["types"], done["imports"]))
        meta = {"snapshot": name, "previous": before.get("snapshot"), "schema_version": schema_version, "created_at": before.get("created_at", int(time.time())), "indexed_at": int(time.time())}
        self._point(meta)
        if before.get("previous"):
            shared.remove(self.spark, f"{self.path}/{before['previous']}")

    def _point(self, meta: dict) -> None:
        """Adds the next pointer, then drops the older ones but one, which readers may be at."""
        known = self._pointers()
        number = int(known[-1].split("-")[0]) + 1 if known else 1
        at = f"{self.path}/{POINTERS}"
        name = f"{number:012d}-{uuid.uuid4().hex}.json"  # of two writers at once both succeed, and the later name counts
        shared.write_text(self.spark, f"{at}/.{name}", json.dumps(meta))
        if not shared.rename(self.spark, f"{at}/.{name}", f"{at}/{name}"):
            raise OSError(f"{at}/{name} can't be written")
        for old in known[:-1]:
            shared.remove(self.spark, f"{at}/{old}")
