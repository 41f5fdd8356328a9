"""A folder of notes brought into a snapshot: what changed, what goes, and the log of it."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import backfill, forget
from ..operators.write import claim_edges
from ..tables import Graph, cut
from . import markdown as MD


def index(g: Graph, files: DataFrame, at_ms: int = 0, full: bool = True) -> tuple[Graph, DataFrame, DataFrame]:
    """The snapshot after ``files`` (as of ``read_folder``), its log rows, and ``action, n``: indexed, skipped, deleted, errors.

    A file whose time or hash is the known one is skipped; ``full`` also removes nodes whose file is gone. Without it the
    given files alone are looked at, by hash. Nodes keep their id and creation; edges resolve once all files are in.
    """
    known = g.nodes.select("id", "file_path", "content_hash", "file_mtime", "created_at", "version")
    if full:
        what = MD.changes(files, known)
    else:
        k = known.select("file_path", F.col("content_hash").alias("_h"))
        what = files.join(k, "file_path", "left").select("file_path", F.when(F.col("_h").isNull(), "added").when(F.col("_h") == F.col("content_hash"), "unchanged").otherwise("changed").alias("action"))
    what = cut(what)
    todo = what.filter("action in ('added', 'changed')").select("file_path")
    parsed = cut(MD.parse_files(files.join(todo, "file_path", "left_semi")))
    nodes, types, fields, edges = MD.tables(parsed)
    old = known.select("file_path", F.col("id").alias("_id"), F.col("version").alias("_v"), F.col("created_at").alias("_c"))
    ids = nodes.select("id", "file_path").join(old, "file_path", "left").select(F.col("id").alias("_new"), F.coalesce("_id", "id").alias("_keep"), "_v", "_c")
    keep = lambda df, c: df.join(ids.select("_new", "_keep"), F.col(c) == F.col("_new")).withColumn(c, F.col("_keep")).drop("_new", "_keep")
    fresh = nodes.join(ids, F.col("id") == F.col("_new")).withColumns({"id": F.col("_keep"), "version": F.coalesce(F.col("_v") + 1, F.lit(1)), "indexed_at": F.lit(at_ms).cast("long"), "created_at": F.coalesce("_c", F.lit(at_ms).cast("long"))})
    fresh = cut(fresh)
    types, fields, edges = cut(keep(types, "node_id")), cut(keep(fields, "node_id")), cut(keep(edges, "source_id"))
    gone = known.join(what.filter("action = 'deleted'"), "file_path", "left_semi").select("id")
    away = gone.unionByName(fresh.select("id"))
    swap = lambda a, b, c: a.join(away.withColumnRenamed("id", c), c, "left_anti").unionByName(b, allowMissingColumns=True).select(*a.columns)
    relationships = forget(swap(g.relationships, edges, "source_id"), gone)
    out = Graph(swap(g.nodes, fresh, "id"), swap(g.node_types, types, "node_id"), swap(g.node_fields, fields, "node_id"), relationships)
    out = out.replace(nodes=cut(out.nodes), relationships=cut(out.relationships))
    out = out.replace(relationships=backfill(out) if full else claim_edges(out.relationships, fresh))
    row = lambda df, event, details: df.select("node_id", F.lit(at_ms).cast("long").alias("timestamp"), F.lit(event).alias("event_type"), details.cast("string").alias("details"))
    log = row(keep(nodes.select(F.col("id").alias("node_id"), "file_path"), "node_id"), "file-indexed", F.col("file_path"))
    log = log.unionByName(row(keep(parsed.filter("parse_error is not null").select(F.sha2("file_path", 256).alias("node_id"), "parse_error"), "node_id"), "parse-error", F.col("parse_error")))
    log = log.unionByName(row(gone.select(F.col("id").alias("node_id")), "file-deleted", F.lit(None)))
    counts = what.groupBy(F.when(F.col("action").isin("added", "changed"), "indexed").when(F.col("action") == "unchanged", "skipped").otherwise("deleted").alias("action")).agg(F.count("*").alias("n"))
    errors = parsed.filter("parse_error is not null").agg(F.lit("errors").alias("action"), F.count("*").alias("n"))
    return out, log, counts.unionByName(errors)


def write_file(path: str, text: str, expected_hash: str | None = None) -> str:
    """Writes through a temporary name, so a reader sees the old file or the new one; gives the hash. A file that was
    changed from outside since ``expected_hash`` is left alone (ValueError)."""
    if expected_hash is not None and os.path.exists(path):
        with open(path, "rb") as f:
            if hashlib.sha256(f.read()).hexdigest() != expected_hash:
                raise ValueError(f"{path} was changed from outside")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".write-")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(text.encode())
        os.replace(temp, path)
    except BaseException:
        os.unlink(temp)
        raise
    return hashlib.sha256(text.encode()).hexdigest()


def with_backup(paths: list[str], work: Callable[[], None]) -> None:
    """Runs ``work``; if it fails, the files are as they were before."""
    held = {}
    for p in paths:
        if os.path.exists(p):
            with open(p, "rb") as f:
                held[p] = f.read()
    try:
        work()
    except BaseException:
        for p in paths:
            if p in held:
                with open(p, "wb") as f:
                    f.write(held[p])
            elif os.path.exists(p):
                os.unlink(p)
        raise


def schema_yaml(name: str, claims: list[dict]) -> str:
    """A schema as YAML: its claims by order and name, with what they override."""
    lines = [f"name: {name}", "fields:" if claims else "fields: []"]
    for c in sorted(claims, key=lambda c: (c.get("sort_order") or 1000, c["field"])):
        lines.append(f"  - field: {c['field']}")
        for k in ("label", "description", "sort_order", "required_override", "default_override", "enum_override"):
            v = c.get(k)
            if v is not None:
                lines.append(f"    {k}: {str(v).lower() if isinstance(v, bool) else v if isinstance(v, int) else MD.json.dumps(v, ensure_ascii=False)}")
    return "\n".join(lines) + "\n"


def render_schemas(root: str, wanted: dict[str, list[dict]], hashes: dict[str, str]) -> tuple[dict[str, str], list[str]]:
    """Schema files that differ or are missing are written; one that was edited from outside stays and is told. Gives the
    new hashes and the blocked names."""
    out, blocked = dict(hashes), []
    for name, claims in wanted.items():
        path = os.path.join(root, f"{name}.yaml")
        try:
            out[name] = write_file(path, schema_yaml(name, claims), hashes.get(name))
        except ValueError:
            blocked.append(name)
    return out, blocked


def delete_schema_file(root: str, name: str, known_hash: str) -> bool:
    """Removes a schema's file unless it was edited from outside."""
    path = os.path.join(root, f"{name}.yaml")
    if not os.path.exists(path):
        return True
    with open(path, "rb") as f:
        same = hashlib.sha256(f.read()).hexdigest() == known_hash
    if same:
        os.unlink(path)
    return same


def folder_stream(spark: SparkSession, root: str) -> DataFrame:
    """New and changed notes below ``root`` as a stream (path, raw, time); a stream has no deletions, ``index`` finds them."""
    s = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    return s.select("path", F.decode("content", "UTF-8").alias("raw"), F.col("modificationTime").alias("ts"))


def retry(attempts: DataFrame, now_ms: int, most: int = 3, wait_ms: int = 2000) -> DataFrame:
    """Files whose parse failed and that are due again: fewer than ``most`` tries, the last one ``wait_ms`` ago."""
    last = attempts.groupBy("file_path").agg(F.count("*").alias("tries"), F.max("ms").alias("ms"), F.max_by("ok", "ms").alias("ok"))
    return last.filter(~F.col("ok") & (F.col("tries") < most) & (F.col("ms") <= now_ms - wait_ms)).select("file_path", "tries")


def sweep(states: DataFrame, now_ms: int, minutes: int = 60) -> DataFrame:
    """``status, n`` of a normaliser's pass: rewritten where the stored text differs from the rendered one, unchanged, or
    skipped because the file is too young."""
    young = F.col("file_mtime") >= now_ms - minutes * 60_000
    return states.groupBy(F.when(young, "skipped").when(F.col("content_hash") == F.col("rendered_hash"), "unchanged").otherwise("rewritten").alias("status")).agg(F.count("*").alias("n"))
