"""Text functions with the reference semantics: ASCII-only case folding and live LIKE wildcards."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Lower case of A to Z alone; other letters keep their case."""
    return F.translate(_col(c), UPPER, UPPER.lower())


def fold_text(s: str) -> str:
    return s.translate(str.maketrans(UPPER, UPPER.lower()))


def like_ci(c: Column | str, pattern: str) -> Column:
    """LIKE without regard to ASCII case; ``%`` and ``_`` are wildcards, a backslash is plain."""
    return fold(c).like(fold_text(pattern).replace("\\", "\\\\"))


def basename(path: Column | str) -> Column:
    """File name without folder and ``.md``."""
    return F.regexp_replace(F.element_at(F.split(_col(path), "/"), -1), r"\.md$", "")


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode normal form C; Spark has no function for it."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def sanitize_filename(c: Column | str) -> Column:
    return F.translate(_col(c), "/\\", "--")


def embeds(body: Column | str) -> Column:
    """Targets of ``![[target|alias]]``."""
    return F.regexp_extract_all(_col(body), F.lit(r"!\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"), F.lit(1))


def wiki_links(body: Column | str) -> Column:
    """Targets of ``[[target|alias]]`` outside fenced and inline code; embeds are not links."""
    plain = F.regexp_replace(F.regexp_replace(_col(body), r"(?s)```.*?(```|$)", " "), r"`[^`\n]*`", " ")
    return F.regexp_extract_all(plain, F.lit(r"(?<!!)\[\[([^\]|\[]+)(?:\|[^\]]+)?\]\]"), F.lit(1))


# Blocks of a body: paragraphs, headings, list items and table rows; a row's cells are parted by pipes outside links.
FENCE = r"(?ms)^[ ]{0,3}```.*?(?:^[ ]{0,3}```[^\n]*|\Z)"
BLOCK = r"\n[ \t]*(?:\n|(?=#{1,6}[ ]|[-*+][ ]|[0-9]+[.)][ ]|\|))|(?<=\n)(?=\|)"
CELL = r"(?<!\\)\|(?![^\[\n]*\]\])"
MARKER = r"^\s*(?:#{1,6}\s+|[-*+]\s+(?:\[[ xX]\]\s+)?|[0-9]+[.)]\s+|>\s?)"
CODE = r"`[^`\n]*`"
LINK = r"(?<!!)\[\[([^\]|\[]+)(?:\|[^\]\[]*)?\]\]"
MARKS = r"`|\*\*|__"
REACH = 200  # characters of a block that a link keeps as its context


def links_in(body: Column | str) -> Column:
    """array<struct(target, context)> of the links of a body outside code; the context is the text of the enclosing block."""
    text = F.regexp_replace(F.coalesce(_col(body), F.lit("")), FENCE, "")
    rows = F.transform(F.split(text, BLOCK), lambda b: F.when(F.ltrim(b).startswith("|"), F.split(b, CELL)).otherwise(F.array(b)))

    def of(block: Column) -> Column:
        own = F.regexp_replace(block, MARKER, "")
        context = F.substring(F.trim(F.regexp_replace(own, MARKS, "")), 1, REACH)
        found = F.regexp_extract_all(F.regexp_replace(block, CODE, " "), F.lit(LINK), F.lit(1))
        return F.transform(found, lambda t: F.struct(F.trim(t).alias("target"), context.alias("context")))

    return F.flatten(F.transform(F.flatten(rows), of))


def closest_of(value: Column | str, candidates: Column, most: int = 3) -> Column:
    """``closest`` over an array column of candidates."""
    low = F.lower(_col(value))
    near = F.greatest(F.lit(2), F.ceil(F.length(low) * 0.4))
    found = F.transform(candidates, lambda c, i: F.struct(F.levenshtein(low, F.lower(c)).alias("d"), i.alias("i"), c.alias("c")))
    good = F.filter(found, lambda x: (x["d"] <= near) & (x["d"] <= F.ceil(F.length(x["c"]) * 0.5)))
    return F.transform(F.slice(F.array_sort(good), 1, most), lambda x: x["c"])


def rewrite_links(body: Column | str, targets: list[str], title: str) -> Column:
    """``[[target|alias]]`` of the given targets names ``title`` instead, the alias stays; code is left as it is."""
    import re

    if not targets:
        return _col(body)
    # Java reads \\Q...\\E as plain text
    names = "|".join("\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E" for t in sorted(targets, key=len, reverse=True))
    parts = F.regexp_extract_all(_col(body), F.lit(r"(?s)```.*?(?:```|\z)|`[^`\n]*`|[^`]+|`"), F.lit(0))
    new = re.sub(r"([\\$])", r"\\\1", title)
    link = r"\[\[(?:" + names + r")(\|[^\]]+)?\]\]"
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("`"), p).otherwise(F.regexp_replace(p, F.lit(link), F.lit(f"[[{new}$1]]")))), "")


def snippet(text: Column | str, terms: list[str], before: int = 40) -> Column:
    """``<mark>`` around every term in turn, cut to ``before`` characters ahead of the first mark and three times as many
    after it; null where no term stands."""
    marked = _col(text)
    for t in terms:
        if t:
            quoted = "\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E"
            marked = F.regexp_replace(marked, F.lit("(?iu)" + quoted), F.lit("<mark>$0</mark>"))
    first = F.instr(marked, "<mark>") - 1
    a = F.greatest(F.lit(0), first - before)
    b = F.least(F.length(marked), first + 3 * before)
    cut = F.concat(F.when(a > 0, "...").otherwise(""), F.substring(marked, a + 1, b - a), F.when(b < F.length(marked), "...").otherwise(""))
    return F.when(first >= 0, cut)


def closest(value: Column | str, candidates: list[str], most: int = 3) -> Column:
    """Candidates within edit distance max(2, ceil(0.4 n)) of the value and half their own length, nearest first."""
    low = F.lower(_col(value))
    near = F.greatest(F.lit(2), F.ceil(F.length(low) * 0.4))
    found = F.array(*(F.struct(F.levenshtein(low, F.lit(c.lower())).alias("d"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(candidates)))
    good = F.filter(found, lambda x: (x["d"] <= near) & (x["d"] <= F.ceil(F.length(x["c"]) * 0.5)))
    return F.transform(F.slice(F.array_sort(good), 1, most), lambda x: x["c"])
