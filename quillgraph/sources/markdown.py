"""Markdown folders as graph tables."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import classified

PARSED = "file_path string, title string, types array<string>, fields map<string,string>, body string, links array<struct<target:string,context:string,field:string>>, raw_fields map<string,string>, parse_error string, content_hash string, file_mtime long"
SKIPPED = {"node_modules"}
_LINK = re.compile(r"(?<!!)\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]")


def split_frontmatter(raw: str) -> tuple[str | None, str]:
    """YAML between a first line ``---`` and the next one, and the rest."""
    m = re.match(r"---[ \t]*\r?\n(.*?)(?:^|\n)---[ \t]*(?:\r?\n|$)", raw, re.S) if raw.startswith("---") else None
    return (m[1], raw[m.end() :]) if m else (None, raw)


def scalar(text: str) -> object:
    """A YAML scalar: quoted text, number, boolean, null, flow list, or plain text."""
    t = text.strip()
    if len(t) > 1 and t[0] == t[-1] and t[0] in "\"'":
        return t[1:-1].replace("''", "'") if t[0] == "'" else json.loads(t)
    if t[:1] in "\"'" and t:
        raise ValueError("unterminated string")
    if t.startswith("[[") and t.endswith("]]"):
        return t
    if t.startswith("[") and t.endswith("]"):
        return [scalar(x) for x in re.findall(r'"(?:[^"\\]|\\.)*"|\'[^\']*\'|\[\[.*?\]\]|[^,\s][^,]*', t[1:-1])]
    if t in ("", "~", "null"):
        return None
    if t in ("true", "false"):
        return t == "true"
    if re.fullmatch(r"[+-]?\d+", t):
        return int(t)
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?", t):
        return float(t)
    return t


def parse_yaml(text: str) -> dict:
    """A subset: ``key: value`` lines, flow and block lists; a repeated key keeps its last value."""
    out: dict[str, object] = {}
    key = None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        item = re.match(r"\s*-\s+(.*)$", line) or re.match(r"\s*-$", line)
        if item and key is not None:
            if not isinstance(out[key], list):
                out[key] = []
            out[key].append(scalar(item[1]) if item.lastindex else None)
            continue
        m = re.match(r"(\"[^\"]+\"|[^:\s][^:]*):(?:\s+(.*))?$", line)
        if not m or line[0].isspace():
            raise ValueError(f"can't read: {line[:60]}")
        key = m[1].strip('"').strip()
        out[key] = scalar(m[2] or "")
    return out


def links_of(value: object) -> list[str]:
    if isinstance(value, str):
        return [x.strip() for x in _LINK.findall(value)]
    return [y for x in value for y in links_of(x)] if isinstance(value, list) else []


def bare(value: object) -> object:
    """A value without the brackets of a link that it consists of."""
    if isinstance(value, list):
        return [bare(x) for x in value]
    m = _LINK.fullmatch(value.strip()) if isinstance(value, str) else None
    return m[1].strip() if m else value


def body_links(body: str) -> list[tuple[str, str]]:
    """(target, context) outside code; the context is the line's text, 200 characters at most."""
    plain = re.sub(r"`[^`\n]*`", " ", re.sub(r"(?ms)^```.*?(^```|\Z)", "", body))
    return [(t.strip(), line.strip()[:200]) for line in plain.splitlines() for t in _LINK.findall(line)]


def parse(path: str, raw: str) -> tuple:
    title = re.sub(r"\.md$", "", path.rsplit("/", 1)[-1])
    front, body = split_frontmatter(raw)
    error, data = None, {}
    if front is not None:
        try:
            data = parse_yaml(front)
        except ValueError as e:
            error, body, data = str(e), raw, {}
    types = data.pop("types", None) or []
    types = [str(bare(x)) for x in (types if isinstance(types, list) else [types])]
    links = [(t, None, k) for k, v in data.items() for t in links_of(v)] + [(t, c, None) for t, c in body_links(body)]
    fields = {k: json.dumps(bare(v), ensure_ascii=False, default=str) for k, v in data.items()}
    # the text of a value that holds links as it was written; JSON for lists
    raw_fields = {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str) for k, v in data.items() if links_of(v)}
    return title, types, fields, body, links, raw_fields, error


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        rows = [(p, *parse(p, raw or ""), h, m) for p, raw, h, m in df.itertuples(index=False)]
        yield pd.DataFrame(rows, columns=["file_path", "title", "types", "fields", "body", "links", "raw_fields", "parse_error", "content_hash", "file_mtime"])


def ignored(path: F.Column, extra: list[str] = ()) -> F.Column:
    """Not markdown, a sync conflict, or below a dot folder, a fixed or an excluded folder (whole segments)."""
    parts = F.split(path, "/")
    out = ~path.endswith(".md") | F.element_at(parts, -1).startswith(".sync-conflict-") | F.exists(parts, lambda s: s.startswith(".") | s.isin(sorted(SKIPPED)))
    for e in extra:
        out = out | path.startswith(e.strip("/") + "/")
    return out


def read_folder(spark: SparkSession, root: str, exclude: list[str] = ()) -> DataFrame:
    """``file_path, raw, content_hash, file_mtime`` of all markdown files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = re.sub(r"^file:/*", "/", root).rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(base), "")
    out = files.select(path.alias("file_path"), F.decode("content", "UTF-8").alias("raw"), F.sha2("content", 256).alias("content_hash"), F.unix_millis("modificationTime").alias("file_mtime"))
    return out.filter(~ignored(F.col("file_path"), exclude))


def parse_files(files: DataFrame) -> DataFrame:
    return files.select("file_path", "raw", "content_hash", "file_mtime").mapInPandas(_parse_batches, PARSED)


def changes(files: DataFrame, known: DataFrame) -> DataFrame:
    """``file_path, action``: added, changed (time and hash differ), unchanged, deleted."""
    k = known.select("file_path", F.col("content_hash").alias("_h"), F.col("file_mtime").alias("_m"))
    same = (F.col("file_mtime") == F.col("_m")) | (F.col("content_hash") == F.col("_h"))
    action = F.when(F.col("_h").isNull(), "added").when(F.col("content_hash").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return files.select("file_path", "content_hash", "file_mtime").join(k, "file_path", "full").select("file_path", action.alias("action"))


def tables(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes, types, fields and edges of parsed files; the id is the path's hash."""
    p = parsed.withColumn("id", F.sha2("file_path", 256))
    nodes = p.select("id", "file_path", "title", "body", "content_hash", "file_mtime", F.lit(1).alias("version"))
    types = p.select(F.col("id").alias("node_id"), F.posexplode("types").alias("sort_order", "schema_type")).dropDuplicates(["node_id", "schema_type"])
    f = p.select(F.col("id").alias("node_id"), "raw_fields", F.explode("fields").alias("field_name", "v"))
    fields = f.select("node_id", "field_name", *classified(F.col("v")), F.try_element_at("raw_fields", F.col("field_name")).alias("value_raw_text"))
    e = p.select(F.col("id").alias("source_id"), F.explode("links").alias("l"))
    edges = e.select("source_id", F.col("l.target").alias("target"), F.coalesce("l.field", F.lit("wiki-link")).alias("rel_type"), F.col("l.context").alias("context"), F.lit(None).cast("string").alias("resolved_target_id")).dropDuplicates(["source_id", "target", "rel_type"])
    return nodes, types, fields, edges


def render(types: list[str], fields: dict[str, object], order: list[str], body: str, references: frozenset[str] = frozenset()) -> str:
    """Markdown of a node: types, claimed fields in order, then others by name; references get their brackets back."""

    def show(v: object, ref: bool) -> str:
        if isinstance(v, list):
            return "".join(f"\n  - {show(x, ref)}" for x in v)
        if ref and isinstance(v, str):
            return f'"[[{v}]]"'
        plain = isinstance(v, str) and scalar(v) == v and not re.search(r"[:#\[\]{}\"']|^[-?&*!|>%@`]|^\s|\s$", v)
        return v if plain else json.dumps(v, ensure_ascii=False, default=lambda d: d.isoformat() if isinstance(d, dt.date) else str(d))

    lines = ["types:" + ("".join(f"\n  - {t}" for t in types) if types else "")]
    names = [k for k in order if k in fields] + sorted(k for k in fields if k not in order)
    for k in names:
        if fields[k] is not None:
            text = show(fields[k], k in references)
            lines.append(f"{k}:{text if text.startswith(chr(10)) else ' ' + text}")
    return "---\n" + "\n".join(lines) + "\n---\n" + body
