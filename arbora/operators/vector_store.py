"""A versioned table of vectors in a folder: upserts, deletes, snapshots, compaction; what failed halfway is never seen.

    data/<id>/       rows of one commit, each with its version
    deletes/<id>/    keys whose rows of earlier versions are gone
    versions/<n>     the commit marker: which folders version n adds, or that it replaces all before

A version exists when its marker does, and a marker is created only if there is none of that number; so of two writers that
started from one version one is told to try again. A folder without a marker is no part of any version. File systems whose
create-if-absent isn't atomic need a single writer.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.sources import shared


class Conflict(RuntimeError):
    """Another writer has committed this version; nothing of this write is visible."""


class VectorStore:
    """Rows with a unique key and any other columns, of which embedding is one as a rule."""

    def __init__(self, spark: SparkSession, path: str, key: str = "vec_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def versions(self) -> list[int]:
        """Those committed, ascending."""
        return sorted(int(x) for x, _ in shared.children(self.spark, f"{self.path}/versions") if x.isdigit())

    def _markers(self, version: int | None) -> list[dict]:
        """From the last compaction up to a version; one marker for each commit since."""
        known, out = self.versions(), []
        if version is not None and version not in known:
            raise ValueError(f"no version {version}")
        for v in reversed([x for x in known if version is None or x <= version]):
            out.append(json.loads(shared.text_of(self.spark, f"{self.path}/versions/{v:012d}")) | {"version": v})
            if out[-1]["whole"]:
                break
        return out[::-1]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is named. Commits since the last compaction are merged by key.

        Deleted keys are joined, never collected; a snapshot stays the same whatever is committed later.
        """
        markers = self._markers(version)
        if not any(m["data"] for m in markers):
            if not markers:
                raise ValueError("the store has no version")
            return self.spark.createDataFrame([], T.StructType.fromJson(markers[-1]["schema"]))
        schema = T.StructType.fromJson(markers[-1]["schema"])
        rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("_version", T.LongType())])).parquet(*[f"{self.path}/{d}" for m in markers for d in m["data"]])
        gone = [f"{self.path}/{d}" for m in markers for d in m["deletes"]]
        if not gone:
            return rows.drop("_version")
        last = self.spark.read.schema(T.StructType([schema[self.key], T.StructField("_version", T.LongType())])).parquet(*gone).groupBy(self.key).agg(F.max("_version").alias("_gone"))
        return rows.join(last, self.key, "left").where("_gone IS NULL OR _gone <= _version").select(*schema.names)

    def commit(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, whole: bool = False) -> int:
        """One version: rows of `upserts` replace those of their keys, keys of `deletes` go; in both, the row stays. Returns its number.

        Of rows with one key in `upserts` the greatest by its other columns is taken. A null key fails. All is written, then the
        marker; if another writer has made this version since, Conflict is raised. The first upsert sets the columns, later ones must have them.
        """
        known = self._markers(None)
        version, schema = (known[-1]["version"] if known else 0) + 1, T.StructType.fromJson(known[-1]["schema"]) if known else None
        if upserts is not None:
            schema = schema or T.StructType([T.StructField(x.name, x.dataType) for x in upserts.schema.fields])
            others = [x for x in schema.names if x != self.key]
            present = F.assert_true(F.col(self.key).isNotNull(), F.lit("a key is null")).isNull()
            upserts = upserts.select(*[F.col(x.name).cast(x.dataType).alias(x.name) for x in schema.fields]).where(present)
            upserts = upserts.groupBy(self.key).agg(F.max(F.struct(*others)).alias("_row")).select(self.key, "_row.*").select(*schema.names) if others else upserts.distinct()
        if schema is None:
            raise ValueError("the store has no columns yet: begin with an upsert")
        data, gone = [], []
        if upserts is not None:
            data = [f"data/{uuid.uuid4().hex}"]
            upserts.withColumn("_version", F.lit(version).cast("long")).write.parquet(f"{self.path}/{data[0]}")
        if not whole and known:
            keys = [] if upserts is None else [self.spark.read.schema(schema).parquet(f"{self.path}/{data[0]}").select(self.key)]
            keys += [] if deletes is None else [deletes.select(F.col(self.key).cast(schema[self.key].dataType).alias(self.key))]
            if keys:
                gone = [f"deletes/{uuid.uuid4().hex}"]
                every = keys[0] if len(keys) == 1 else keys[0].unionByName(keys[1])
                every.distinct().withColumn("_version", F.lit(version).cast("long")).write.parquet(f"{self.path}/{gone[0]}")
        marker = {"data": data, "deletes": gone, "whole": whole, "schema": schema.jsonValue()}
        if not shared.created(self.spark, f"{self.path}/versions/{version:012d}", json.dumps(marker)):
            raise Conflict(f"version {version} was committed by another writer")
        return version

    def upsert(self, rows: DataFrame) -> int:
        return self.commit(upserts=rows)

    def delete(self, keys: DataFrame) -> int:
        """Rows whose key is among these go; unknown keys do nothing."""
        return self.commit(deletes=keys)

    def compact(self) -> int:
        """A version with the same rows as the last one, in files of their own; reads no longer merge."""
        rows = self.read()
        return self.commit(upserts=rows, whole=True)

    def vacuum(self, keep: int, hours: float = 24.0) -> list[str]:
        """Deletes what no version from `keep` on reads, and leavings of failed writes older than so many hours. Returns the folders.

        A folder of a write that is still running is younger than that, so hours must exceed the longest write.
        """
        needed = {d for v in self.versions() if v >= keep for m in self._markers(v) for d in (*m["data"], *m["deletes"])}
        markers = {m["version"] for v in self.versions() if v >= keep for m in self._markers(v)}
        named = {d for v in self.versions() for m in [json.loads(shared.text_of(self.spark, f"{self.path}/versions/{v:012d}"))] for d in (*m["data"], *m["deletes"])}
        before = (time.time() - hours * 3600) * 1000
        out = [f"{kind}/{name}" for kind in ("data", "deletes") for name, at in shared.children(self.spark, f"{self.path}/{kind}") if f"{kind}/{name}" not in needed and (f"{kind}/{name}" in named or at < before)]
        for v in self.versions():
            if v < keep and v not in markers:
                shared.removed(self.spark, f"{self.path}/versions/{v:012d}")
        for d in out:
            shared.removed(self.spark, f"{self.path}/{d}")
        return out
