"""Small text rules: default tokens, file names, relative times, paths, sizes and transcripts."""

from __future__ import annotations

import datetime as dt
import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.filters import InvalidParams

# Date tokens of default values and the datetime patterns they stand for; fixed values.
TOKENS = {"YYYY": "yyyy", "MM": "MM", "DD": "dd", "HH": "HH", "mm": "mm", "ss": "ss"}
UNSAFE = r"[\[\]#^|\\:*?\"<>]"


def default_value(c: Column, created_ms: Column, modified_ms: Column, now_ms: Column) -> Column:
    """``$ctime``, ``$mtime`` and ``$now`` with an optional ``:format`` as text in the session's zone; other values stay. A
    missing time is now."""
    word = F.regexp_extract(c, r"^\$(ctime|mtime|now)(?::(.+))?$", 1)
    form = F.regexp_extract(c, r"^\$(ctime|mtime|now)(?::(.+))?$", 2)
    when = F.timestamp_millis(F.when(word == "ctime", F.coalesce(created_ms, now_ms)).when(word == "mtime", F.coalesce(modified_ms, now_ms)).otherwise(now_ms))
    out = F.when(form == "", F.lit("YYYY-MM-DD")).otherwise(form)
    for token, pattern in TOKENS.items():
        out = F.replace(out, F.lit(token), F.date_format(when, pattern))
    return F.when(word != "", out).otherwise(c)


def file_name(template: str, values: dict[str, Column], today: Column | None = None) -> Column:
    """``{name}`` replaced by the value of that name, ``{date}`` by today (UTC); null where a value is missing, which the
    caller must refuse. Slashes become dashes."""
    out = F.lit("")
    for plain, name in re.findall(r"([^{]*)(?:\{(\w+)\}|$)", template):
        out = F.concat(out, F.lit(plain))
        if name:
            v = values.get(name)
            if v is None:
                v = F.date_format(today if today is not None else F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd") if name == "date" else F.lit(None).cast("string")
            out = F.concat(out, F.translate(v.cast("string"), "/\\", "--"))
    return F.concat(out, F.lit("" if template.endswith(".md") else ".md"))


def title_warnings(c: Column) -> Column:
    """Characters of a title that links or file systems can't hold, each once, in order of the first."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("(" + UNSAFE + ")"), F.lit(1)))


def since_ms(text: str, now_ms: int) -> int | None:
    """``15m``, ``2h``, ``3d`` before now, or an ISO time; None if neither, which filters nothing."""
    if m := re.fullmatch(r"(\d+)([mhd])", text):
        return now_ms - int(m[1]) * {"m": 60_000, "h": 3_600_000, "d": 86_400_000}[m[2]]
    try:
        when = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    return int((when if when.tzinfo else when.replace(tzinfo=dt.timezone.utc)).timestamp() * 1000)


def safe_path(root: str, path: str) -> str:
    """The path below ``root``; one that leaves it is refused."""
    base = posixpath.normpath(root)
    full = posixpath.normpath(posixpath.join(base, path))
    if full != base and not full.startswith(base.rstrip("/") + "/"):
        raise InvalidParams(f"{path} is outside of the root")
    return full


def size_text(n: int) -> str:
    """A size for a log line."""
    for unit in ("B", "KB", "MB"):
        if n < 1024 or unit == "MB":
            return f"{n} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return ""


def transcript(parts: Column) -> Column:
    """Lines ``[Speaker n] HH:MM:SS`` and text of an array of ``struct(speaker int, start double, text string)``."""

    def line(x: Column) -> Column:
        s = F.floor(x["start"]).cast("int")
        return F.concat(F.format_string("[Speaker %d] %02d:%02d:%02d\n", x["speaker"], (s / 3600).cast("int"), ((s % 3600) / 60).cast("int"), s % 60), x["text"])

    return F.array_join(F.transform(parts, line), "\n\n")


def operator_warnings(fields: dict[str, dict], kinds: dict[str, str]) -> list[dict]:
    """Operators of a filter that a field's type can't use; the query runs all the same. Unknown fields are passed over."""
    out = []
    for name, ops in fields.items():
        kind = kinds.get(name)
        for op in ops if kind else ():
            wrong = (op == "includes" and kind != "list") or (op in ("eq", "ne", "one_of") and kind == "list") or (op in ("gt", "gte", "lt", "lte") and kind not in ("number", "date"))
            if wrong:
                out.append({"code": "FIELD_OPERATOR_MISMATCH", "severity": "warning", "field": name, "operator": op, "field_type": kind})
    return out
