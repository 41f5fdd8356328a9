"""Text of embedded files: extractors by extension, a cache by content, and the assembly of a node with what it embeds."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from itertools import groupby
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import embeds
from ..operators.graph import resolve
from ..tables import Graph, cut

MAX_DEPTH, MAX_EMBEDS, MAX_BYTES = 5, 20, 100 << 20
LEAST_CHARS = 50  # a page; PDF text below that is no text layer


def _plain(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def _office(pattern: str, text: str, row: str) -> Callable[[bytes], str]:
    """Text of the parts of an office file whose names match, a line for each ``row`` element."""

    def read(raw: bytes) -> str:
        out = []
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for name in sorted((n for n in z.namelist() if re.fullmatch(pattern, n)), key=lambda n: (len(n), n)):
                for node in ElementTree.fromstring(z.read(name)).iter():
                    if node.tag.rsplit("}", 1)[-1] == row:
                        line = "".join(x.text or "" for x in node.iter() if x.tag.rsplit("}", 1)[-1] == text)
                        if line:
                            out.append(line)
        return "\n".join(out)

    return read


#: Extractors that need nothing but this file, by extension. More are registered by the caller.
LOCAL: dict[str, Callable[[bytes], str]] = {
    "md": _plain, "txt": _plain, "csv": _plain,
    "docx": _office(r"word/document\.xml", "t", "p"), "pptx": _office(r"ppt/slides/slide\d+\.xml", "t", "p"), "xlsx": _office(r"xl/sharedStrings\.xml", "t", "si"),
}
#: Extensions whose extractors call a service, and what they wait for.
REMOTE = {**dict.fromkeys(("mp3", "m4a", "wav", "ogg"), "speech key"), **dict.fromkeys(("png", "jpg", "jpeg", "webp", "gif"), "vision key"), "pdf": "PDF extractor"}


def extension(path: str) -> F.Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def availability(files: DataFrame, more: list[str] = ()) -> DataFrame:
    """``file_path, available, reason`` of each file: why its extension can't be read here."""
    ext = extension("file_path")
    ready = sorted({*LOCAL, *more})
    missing = {k: v for k, v in REMOTE.items() if k not in more}
    wait = F.create_map(*(F.lit(x) for kv in missing.items() for x in kv))[ext] if missing else F.lit(None).cast("string")
    reason = F.when(ext.isin(ready), None).otherwise(F.coalesce(F.concat(F.lit("needs a "), wait), F.concat(F.lit("no extractor for ."), ext)))
    return files.select("file_path", reason.isNull().alias("available"), reason.alias("reason"))


def extract(files: DataFrame, cache: DataFrame | None = None, more: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """``content_hash, text, error`` of each distinct content of ``files(file_path, content)``, one row a hash. What the cache
    has isn't read again."""
    every = {**LOCAL, **(more or {})}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for h, ext, raw in df.itertuples(index=False):
                try:
                    rows.append((h, every[ext](bytes(raw)), None))
                except Exception as e:  # a broken file is told, not fatal
                    rows.append((h, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["content_hash", "text", "error"])

    todo = files.select(F.sha2("content", 256).alias("content_hash"), extension("file_path").alias("ext"), "content").filter(F.col("ext").isin(sorted(every))).dropDuplicates(["content_hash"])
    if cache is not None:
        todo = todo.join(cache.select("content_hash"), "content_hash", "left_anti")
    fresh = todo.select("content_hash", "ext", "content").mapInPandas(run, "content_hash string, text string, error string")
    return fresh if cache is None else cache.unionByName(fresh)


def thin(pages: DataFrame) -> DataFrame:
    """``content_hash`` of PDFs whose pages have few characters on average: they need another extractor.
    ``pages(content_hash, text)``, one row a page."""
    return pages.groupBy("content_hash").agg(F.avg(F.length("text")).alias("a")).filter(F.col("a") < LEAST_CHARS).select("content_hash")


def resolve_embeds(refs: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """``ref, file_path, node_id`` of ``refs(ref)``: notes through the resolver, with and without ``.md``; other files by
    path, else by name, the smallest path first. References that nothing answers to have no row."""
    r = refs.select("ref").distinct().withColumn("ext", extension("ref"))
    note = (F.col("ext") == "") | (F.col("ext") == "md")
    name = F.element_at(F.split("file_path", "/"), -1)
    named = files.groupBy(name.alias("ref")).agg(F.min("file_path").alias("by_name"))
    other = r.filter(~note).join(files.select("file_path"), F.col("ref") == F.col("file_path"), "left")
    other = other.withColumn("base", F.element_at(F.split("ref", "/"), -1)).join(named.withColumnRenamed("ref", "base"), "base", "left")
    other = other.select("ref", F.coalesce("file_path", "by_name").alias("file_path"), F.lit(None).cast("string").alias("node_id")).filter("file_path is not null")
    swapped = F.when(F.col("ref").endswith(".md"), F.regexp_replace("ref", r"\.md$", "")).otherwise(F.concat("ref", F.lit(".md")))
    tries = r.filter(note).select("ref", F.posexplode(F.array("ref", swapped)).alias("o", "target"))
    found = tries.join(resolve(nodes, tries), "target").groupBy("ref").agg(F.min_by("id", "o").alias("node_id"))
    return other.unionByName(found.join(nodes.select(F.col("id").alias("node_id"), "file_path"), "node_id").select("ref", "file_path", "node_id"))


def read_embedded(files: DataFrame, name: str) -> DataFrame:
    """``file_path, status`` of one file by path or by name: OK, AMBIGUOUS_FILENAME or NOT_FOUND."""
    hit = files.filter((F.col("file_path") == name) | (F.element_at(F.split("file_path", "/"), -1) == name))
    one = hit.agg(F.count("*").alias("n"), F.max(F.when(F.col("file_path") == name, F.col("file_path"))).alias("exact"), F.min("file_path").alias("low"))
    status = F.when(F.col("n") == 0, "NOT_FOUND").when(F.col("exact").isNull() & (F.col("n") > 1), "AMBIGUOUS_FILENAME").otherwise("OK")
    return one.select(F.when(status == "OK", F.coalesce("exact", "low")).alias("file_path"), status.alias("status"))


ASSEMBLED = "root string, kind string, place int, depth int, source string, ref string, file_path string, node_id string, code string"
FLUSH = 10_000  # rows of a batch that leaves a worker


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of ``ASSEMBLED``."""
    names, kinds = zip(*(c.split(" ") for c in ASSEMBLED.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if k == "int" else pa.string()) for i, k in enumerate(kinds)], list(names))


def assemble(g: Graph, files: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH, max_embeds: int = MAX_EMBEDS, max_bytes: int = MAX_BYTES, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What nodes embed, and what those embed, depth first: ``(root, place, depth, source, ref, file_path, node_id[, text])``,
    and the errors ``(root, ref, code)``: UNRESOLVED, FILE_TOO_LARGE, or TRUNCATED, once for each list that ``max_embeds`` cuts.

    Every embed is listed as often as it stands; a note is entered once a root, at its first place, and to ``max_depth``
    levels below the root's own. ``files`` has paths and ``size``; ``texts(file_path, text)`` joins what was extracted.
    Each note's list is resolved once, whatever its roots; a root's notes are found level by level, by joins of ids; its order
    is a small walk over its own rows, which come sorted, root behind root.
    """
    body = g.nodes.select(F.col("id").alias("at"), F.posexplode(embeds("body")).alias("place", "ref"))
    level = roots.select(F.col("id").alias("root"), F.col("id").alias("at"))
    todo, known, linked = cut(level.select("at").distinct()), None, None
    for _ in range(max_depth + 1):
        asked = cut(todo.join(body, "at").select("at", "place", F.trim("ref").alias("ref")))
        found = cut(asked.join(cut(resolve_embeds(asked, files, g.nodes)), "ref", "left").join(files.select("file_path", "size"), "file_path", "left").select("at", "place", "ref", "file_path", "node_id", "size"))
        linked = found if linked is None else linked.unionByName(found)
        known = todo if known is None else known.unionByName(todo)
        todo = cut(found.filter("node_id is not null").select(F.col("node_id").alias("at")).distinct().join(known, "at", "left_anti"))
        if todo.isEmpty():
            break
    hops = cut(linked.filter("node_id is not null").select("at", "node_id").distinct())
    seen = level
    for _ in range(max_depth):
        fresh = level.join(hops, "at").select("root", F.col("node_id").alias("at")).distinct()
        level = cut(fresh.join(seen, ["root", "at"], "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    every = seen.join(linked, "at").select("root", "at", "place", "ref", "file_path", "node_id", "size")

    def walk(root: str, own: Iterator[tuple]) -> Iterator[tuple]:
        lists = {at: list(rest) for at, rest in groupby(own, key=lambda r: r[1])}
        entered, count = {root}, 0
        todo = [(iter(lists.get(root, ())), 0, None)]
        while todo:
            rest, depth, source = todo[-1]
            r = next(rest, None)
            if r is None or count >= max_embeds:
                if r is not None:
                    yield root, "error", None, depth, source, r[3], None, None, "TRUNCATED"
                todo.pop()
                continue
            ref, path, node, size = r[3:]
            large = size is not None and size > max_bytes
            if path is None or large:
                yield root, "error", None, depth, source, ref, None, None, "FILE_TOO_LARGE" if large else "UNRESOLVED"
                continue
            count += 1
            yield root, "embed", count, depth, source, ref, path, node, None
            if node is not None and node not in entered and depth < max_depth:
                entered.add(node)
                if node in lists:
                    todo.append((iter(lists[node]), depth + 1, ref))

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        out: list[tuple] = []
        for root, own in groupby(rows, key=lambda r: r[0]):
            out.extend(walk(root, own))
            if len(out) >= FLUSH:
                yield _batch(out)
                out = []
        yield _batch(out)

    out = cut(every.repartition("root").sortWithinPartitions("root", "at", "place").mapInArrow(walks, ASSEMBLED))
    rows = out.filter("kind = 'embed'").select("root", "place", "depth", "source", "ref", "file_path", "node_id")
    if texts is not None:
        rows = rows.join(texts.select("file_path", "text"), "file_path", "left")
    return rows, out.filter("kind = 'error'").select("root", "ref", "code")
