"""The text query language: words, phrases, prefixes, columns, NEAR groups and operators as an expression tree over positions.

    or   := and (OR and)*        and := not (AND not)*       not := part (NOT part)*
    part := near+ | [columns :] "(" or ")"                   (near near: both are wanted; this binds tightest)
    near := [columns :] ( ["^"] phrase | NEAR "(" phrase+ ["," n] ")" )
    phrase := string ["*"] ("+" string ["*"])*               columns := ["-"] ( name | "{" name+ "}" )
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COLUMNS = ("title", "body")
BODY = 1 << 24  # places of the body begin here, so that no phrase spans two columns
NEAR = 10  # words between the first and the last phrase of a NEAR group, unless it names a number
# Latin-1 letters with marks and the letters they fold to; fixed values.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
_WORD = re.compile(r'\s*(?:(?P<quoted>"(?:[^"]|"")*")|(?P<bare>[A-Za-z0-9_\x1a\u0080-\U0010ffff]+)|(?P<mark>[(){}:+*^,-]))')


class Unreadable(ValueError):
    """The query isn't in the language."""


@dataclass(frozen=True)
class Phrase:
    """Words side by side; a last one with ``*`` is a prefix. ``columns``: where it may stand; ``first``: at a column's start."""

    words: tuple[str, ...]
    columns: tuple[str, ...] = COLUMNS
    first: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    within: int


@dataclass(frozen=True)
class Node:
    """``op``: and, or, not."""

    op: str
    left: Node | Phrase | Near
    right: Node | Phrase | Near


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower().translate(str.maketrans(*ACCENTS))) if w]


def parse(query: str) -> Node | Phrase | Near | None:
    """The tree; None for a query without a word. Raises ``Unreadable``."""
    found, at = [], 0
    while query[at:].strip():
        m = _WORD.match(query, at)
        if not m:
            raise Unreadable(query)
        found.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    if not found:
        raise Unreadable(query)
    out, rest = _binary(found, 0, 0)
    if rest != len(found):
        raise Unreadable(query)
    return out


LEVELS = ("OR", "AND", "NOT")


def _is(t: list, at: int, *what: str) -> bool:
    return at < len(t) and t[at][0] != "quoted" and t[at][1] in what


def _join(op: str, left, right):
    """A side without a word says nothing."""
    return right if left is None else left if right is None else Node(op.lower(), left, right)


def _binary(t: list, at: int, level: int):
    if level == len(LEVELS):
        return _part(t, at)
    out, at = _binary(t, at, level + 1)
    while _is(t, at, LEVELS[level]):
        right, at = _binary(t, at + 1, level + 1)
        out = _join(LEVELS[level], out, right)
    return out, at


def _columns(t: list, at: int) -> tuple[tuple[str, ...] | None, int]:
    """A column filter and the place behind its colon, if one stands here."""
    k, without = at, False
    if _is(t, k, "-"):
        k, without = k + 1, True
    if _is(t, k, "{"):
        end = next((i for i in range(k, len(t)) if _is(t, i, "}")), None)
        names = [x for _, x in t[k + 1 : end]] if end else []
        k = (end or k) + 1
    else:
        names = [t[k][1]] if k < len(t) and t[k][0] != "mark" else []
        k += 1
    if not names or not _is(t, k, ":"):
        if without or _is(t, at, "{"):
            raise Unreadable("columns")
        return None, at
    names = [n.strip('"').lower() for n in names]
    if set(names) - set(COLUMNS):
        raise Unreadable("no such column")
    return tuple(c for c in COLUMNS if (c in names) != without), k + 1


def _limit(x, columns: tuple[str, ...]):
    if isinstance(x, Node):
        return Node(x.op, _limit(x.left, columns), _limit(x.right, columns))
    if isinstance(x, Near):
        return Near(tuple(_limit(p, columns) for p in x.phrases), x.within)
    return x and Phrase(x.words, tuple(c for c in x.columns if c in columns), x.first)


def _part(t: list, at: int):
    columns, k = _columns(t, at)
    if _is(t, k, "("):
        out, k = _binary(t, k + 1, 0)
        if not _is(t, k, ")"):
            raise Unreadable("no closing bracket")
        return (out if columns is None else _limit(out, columns)), k + 1
    out, at, some = None, at, False
    while at < len(t) and not _is(t, at, *LEVELS, ")"):
        columns, k = _columns(t, at)
        if _is(t, k, "("):
            break
        near, at = _near(t, k)
        out, some = _join("and", out, near if columns is None else _limit(near, columns)), True
    if not some:
        raise Unreadable("an operand is missing")
    return out, at


def _near(t: list, at: int):
    if _is(t, at, "NEAR") and _is(t, at + 1, "("):
        at, within, phrases = at + 2, NEAR, []
        while not _is(t, at, ")", ","):
            p, at = _phrase(t, at)
            phrases.append(p)
        if _is(t, at, ","):
            if at + 1 >= len(t) or not t[at + 1][1].isdigit():
                raise Unreadable("NEAR takes a number")
            within, at = int(t[at + 1][1]), at + 2
        if not _is(t, at, ")") or not phrases:
            raise Unreadable("NEAR")
        phrases = [p for p in phrases if p]
        return (phrases[0] if len(phrases) == 1 else Near(tuple(phrases), within) if phrases else None), at + 1
    first = _is(t, at, "^")
    p, at = _phrase(t, at + first)
    return p and Phrase(p.words, p.columns, first), at


def _phrase(t: list, at: int) -> tuple[Phrase | None, int]:
    words: list[str] = []
    while True:
        if at >= len(t) or t[at][0] == "mark" or (t[at][0] == "bare" and t[at][1] in LEVELS):
            raise Unreadable("a word is missing")
        kind, text = t[at]
        words += words_of(text[1:-1].replace('""', '"') if kind == "quoted" else text)
        at += 1
        if _is(t, at, "*"):
            if words:
                words[-1] += "*"
            at += 1
        if not _is(t, at, "+"):
            return (Phrase(tuple(words)) if words else None), at
        if words and words[-1].endswith("*"):
            raise Unreadable("a prefix is last")
        at += 1


def atoms(x) -> list:
    """Phrases and NEAR groups of a tree, each once, in order."""
    if x is None:
        return []
    return list(dict.fromkeys(atoms(x.left) + atoms(x.right))) if isinstance(x, Node) else [x]


def truth(x, found) -> Column:
    """The tree as a condition; ``found`` gives that of a phrase or group."""
    if isinstance(x, Node):
        a, b = truth(x.left, found), truth(x.right, found)
        return a & b if x.op == "and" else a | b if x.op == "or" else a & ~b
    return found(x)


def score(x, found, worth) -> Column:
    """The sum of what the phrases are worth that stand in a matching part of the tree; what NOT takes away is worth nothing."""
    if isinstance(x, Node):
        a, b = (score(y, found, worth) for y in (x.left, x.right))
        own = lambda y, s: F.when(truth(y, found), s).otherwise(F.lit(0.0)) if isinstance(y, Node) else s
        return a if x.op == "not" else a + b if x.op == "and" else own(x.left, a) + own(x.right, b)
    return worth(x)


# A lambda's second argument would be an index: numbers are bound by functions of their own.
def _less(j: int):
    return lambda x: x - j


def _behind(r: int):
    return lambda x: F.sequence(x, x + r)


def _before(r: int):
    return lambda x: F.sequence(x - r, x)


def starts(p: Phrase, places) -> Column:
    """Where the phrase begins in a document: the words' position lists, moved onto the first word and intersected by hash, so
    in time linear in their lengths. ``places``: the position list of a term."""
    moved = [places(w) if j == 0 else F.transform(places(w), _less(j)) for j, w in enumerate(p.words)]
    out = reduce(F.array_intersect, moved)
    if p.columns != COLUMNS:
        keep = {(): F.lit(False), ("title",): lambda x: x < BODY, ("body",): lambda x: x >= BODY}[p.columns]
        out = F.filter(out, keep if callable(keep) else lambda x: F.lit(False))
    return F.filter(out, lambda x: x.isin(0, BODY)) if p.first else out


def clumps(group: Near, lists: list[Column]) -> list[Column]:
    """Of each phrase of a NEAR group the places that stand in a clump: one place of every phrase such that none begins more
    than its own length and ``within`` words before the last. Each list is spread over the ends it allows and the spreads are
    intersected, which is linear in the lists for a given distance."""
    reach = [len(p.words) + group.within for p in group.phrases]
    ends = reduce(F.array_intersect, [F.array_distinct(F.flatten(F.transform(s, _behind(r)))) for s, r in zip(lists, reach, strict=True)])
    ends = F.array_intersect(ends, F.array_distinct(F.concat(*lists)))
    return [F.array_intersect(s, F.flatten(F.transform(ends, _before(r)))) for s, r in zip(lists, reach, strict=True)]
