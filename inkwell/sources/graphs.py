"""Graphs kept as versions: nodes and edges of a write become visible together, and a reader stays with the version it began with.

    data/<write>/nodes|edges      Parquet by graph_id, never changed
    manifests/<write>             table of (graph_id, folder): where each graph of a version lies
    commits/<number>              the manifest of a version; the largest complete number is the newest one

A write puts its data and the next manifest in place first; creating the commit file, which fails if another writer was first, is
all that publishes it. What breaks before that leaves files that nobody reads, which ``vacuum`` removes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("nodes", "edges")


class Conflict(RuntimeError):
    """Another writer published a version meanwhile."""


def _file_system(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, path: str) -> dict[int, str]:
    """Version -> manifest, of complete commit files."""
    folder, fs = _file_system(spark, f"{path}/commits")
    out = {}
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        with_name = status.getPath()
        if with_name.getName().isdigit():
            source = fs.open(with_name)
            try:
                text = spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
            finally:
                source.close()
            if text.endswith("}"):
                out[int(with_name.getName())] = json.loads(text)["manifest"]
    return out


def newest_version(spark: SparkSession, path: str) -> int:
    """The newest version, 0 if there is none."""
    return max(_commits(spark, path), default=0)


def _manifest(spark: SparkSession, path: str, version: int | None) -> DataFrame:
    commits = _commits(spark, path)
    version = max(commits, default=0) if version is None else version
    if version and version not in commits:
        raise KeyError(f"no version {version}")
    if not version:
        return spark.createDataFrame([], "graph_id string, folder string")
    return spark.read.schema("graph_id string, folder string").parquet(f"{path}/manifests/{commits[version]}")


def _publish(spark: SparkSession, path: str, base: int, manifest: DataFrame, name: str) -> int:
    manifest.write.parquet(f"{path}/manifests/{name}")
    target, fs = _file_system(spark, f"{path}/commits/{base + 1:012d}")
    try:
        out = fs.create(target, False)
    except Exception as error:
        if not fs.exists(target):
            raise
        raise Conflict(f"version {base + 1} is there already") from error
    try:
        out.write(bytearray(json.dumps({"manifest": name}).encode()))
    finally:
        out.close()
    return base + 1


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> int:
    """Replace the graphs that nodes or edges (each with graph_id) hold, and return the version that has them."""
    spark, name = nodes.sparkSession, uuid.uuid4().hex
    base = newest_version(spark, path)
    before = _manifest(spark, path, base)
    written = []
    for kind, rows in zip(KINDS, (nodes, edges)):
        rows.write.partitionBy("graph_id").parquet(f"{path}/data/{name}/{kind}")
        # which graphs there are is asked of what was written, not of what nodes and edges are made of
        stored = spark.read.schema(rows.schema).parquet(f"{path}/data/{name}/{kind}")
        written.append(stored.select(F.col("graph_id").cast("string").alias("graph_id")))
    fresh = written[0].union(written[1]).distinct()
    manifest = before.join(fresh, "graph_id", "left_anti").union(fresh.withColumn("folder", F.lit(name)))
    return _publish(spark, path, base, manifest, name)


def delete_graph(spark: SparkSession, path: str, graph_id: str) -> int:
    """A version without the graph."""
    base = newest_version(spark, path)
    return _publish(spark, path, base, _manifest(spark, path, base).where(F.col("graph_id") != graph_id), uuid.uuid4().hex)


def list_graphs(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return _manifest(spark, path, version).select("graph_id").orderBy("graph_id")


def read_graph(spark: SparkSession, path: str, graph_id: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph in a version, the newest if none is named. Both are of one write."""
    found = _manifest(spark, path, version).where(F.col("graph_id") == graph_id).select("folder").limit(1).collect()
    if not found:
        raise KeyError(f"no graph {graph_id!r}")
    # graph_id is a folder's name, of which the reader would otherwise guess the type
    out = []
    for kind in KINDS:
        rows = spark.read.parquet(f"{path}/data/{found[0].folder}/{kind}")
        out.append(rows.where(F.col("graph_id").cast("string") == graph_id))
    return tuple(out)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove what the newest ``keep`` versions don't need, and return the data folders that went.

    Not to be run beside writers: what they have not published yet counts as needless.
    """
    commits = _commits(spark, path)
    kept = sorted(commits)[-keep:]
    used = {r.folder for v in kept for r in _manifest(spark, path, v).select("folder").distinct().collect()}
    gone = []
    for part, needed in (("commits", {f"{v:012d}" for v in kept}), ("manifests", {commits[v] for v in kept}), ("data", used)):
        folder, fs = _file_system(spark, f"{path}/{part}")
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            if status.getPath().getName() not in needed:
                gone += [status.getPath().getName()] if part == "data" else []
                fs.delete(status.getPath(), True)
    return sorted(gone)
