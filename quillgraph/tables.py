"""A snapshot of the graph: immutable DataFrames, so that a preview is a snapshot nobody commits."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .schema import TABLES


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    node_types: DataFrame
    node_fields: DataFrame
    relationships: DataFrame

    def replace(self, **tables: DataFrame) -> Graph:
        return replace(self, **tables)


def table(spark: SparkSession, name: str, rows: list[tuple] = ()) -> DataFrame:
    """A small table with the columns of ``TABLES[name]``."""
    return spark.createDataFrame(list(rows), TABLES[name])


NAMES = ("nodes", "node_types", "node_fields", "relationships")
#: What filters name literally; a filter then opens the files of its types, fields and relations alone.
PARTS = {"node_types": "schema_type", "node_fields": "field_name", "relationships": "rel_type"}


def save(graph: Graph, path: str) -> None:
    """A new version under its own folder; a reader takes the path of the version it was told."""
    for name in NAMES:
        put(getattr(graph, name), f"{path}/{name}", PARTS.get(name))


def load(spark: SparkSession, path: str) -> Graph:
    return Graph(*(get(spark, f"{path}/{n}", PARTS.get(n)) for n in NAMES))


def put(df: DataFrame, path: str, by: str | None = None) -> None:
    """The rows and, beside them, their schema: a partitioned table without rows has no file to tell it."""
    with _open_files(df.sparkSession, WRITERS):
        out = df.write.mode("overwrite")
        (out.partitionBy(by) if by else out).parquet(path)
    _write(df.sparkSession, f"{path}/_schema", df.schema.json())


#: Types, fields or relations that a task writes side by side; beyond that Spark sorts its rows by them first, which spills.
WRITERS = 64


@contextmanager
def _open_files(spark: SparkSession, most: int) -> Iterator[None]:
    name = "spark.sql.maxConcurrentOutputFileWriters"
    was = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def get(spark: SparkSession, path: str, by: str | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(_read(spark, f"{path}/_schema")))
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _write(spark: SparkSession, path: str, text: str) -> None:
    where, files = _files(spark, path)
    stream = files.create(where, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def _read(spark: SparkSession, path: str) -> str:
    where, files = _files(spark, path)
    stream = files.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, name: str, sources: list[str], make: Callable[[str], None]) -> str:
    """Folder of what ``make(folder)`` writes, made once a session for each state of the source files (their paths, sizes
    and times). It lies below ``spark.checkpoint.dir``; where that is unset, as in tests, in a temporary folder."""
    marks = []
    for s in sources:
        where, files = _files(spark, s)
        marks += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files.listStatus(where)]
    key = (spark.sparkContext.applicationId, name, tuple(sorted(marks)))
    if key not in _STORED:
        folder = own_folder(spark, name)
        make(folder)
        _STORED[key] = folder
    return _STORED[key]


_KEPT: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where the setting is absent and all tasks run on this machine (tests). On a
    cluster its absence is an error: executors can't read the driver's folders."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the session ends."""
    path = f"{shared_dir(spark)}/quillgraph-{name}-{uuid.uuid4().hex}"
    if not _KEPT:
        atexit.register(_clean)
    _KEPT.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    where, files = _files(spark, path)
    files.delete(where, True)


def _clean() -> None:
    for spark, path in _KEPT:
        try:
            remove(spark, path)
        except Exception:  # the JVM may have gone first
            return


class Conflict(RuntimeError):
    """Another writer committed the same version first."""


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions of what lies below ``root``."""
    where, files = _files(spark, f"{root}/_versions")
    names = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
    return sorted(int(n) for n in names if n.isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """What the given, or the last, committed version says; empty before the first."""
    known = versions(spark, root)
    return json.loads(_read(spark, f"{root}/_versions/{known[-1] if version is None else version}")) if known else {}


def commit(spark: SparkSession, root: str, version: int, content: dict) -> None:
    """Several tables become visible at once: a small file is made under the version's number, which fails where it is there
    already. What a writer wrote before it failed is in folders that no manifest names."""
    where, files = _files(spark, f"{root}/_versions/{version}")
    part = f"{root}/_versions/.{version}-{uuid.uuid4().hex}"
    _write(spark, part, json.dumps(content))
    if files.exists(where) or not files.rename(_files(spark, part)[0], where):
        remove(spark, part)
        raise Conflict(f"version {version} of {root} is there already")


def save_version(graph: Graph, root: str, base: int) -> int:
    """The graph as the version after ``base``: all four tables are written, then committed by one manifest."""
    spark = graph.nodes.sparkSession
    folder = f"v{base + 1}-{uuid.uuid4().hex}"
    save(graph, f"{root}/{folder}")
    commit(spark, root, base + 1, {"folder": folder})
    return base + 1


def load_version(spark: SparkSession, root: str, version: int | None = None) -> Graph:
    return load(spark, f"{root}/{manifest(spark, root, version)['folder']}")


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from a table of their own, so that what follows neither plans nor computes it again."""
    spark = df.sparkSession
    path = own_folder(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
