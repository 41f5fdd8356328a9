"""Hard negatives and vector codes against brute force in whole numbers of Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from quillgraph.llm import hard_negatives as H
from quillgraph.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, q string, a long, code string, rank int"


def vectors(seed=3, n=260, d=32):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(d)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = centres[i % 4]
        v = [float(np.float32(x + rng.gauss(0, 0.12))) for x in c]
        rows.append((i, v, i % 3 if i % 11 else None))
    same = rows[1][1]
    rows += [(1000 + i, same, 1) for i in range(40)]  # copies of one vector, ties by id
    rows += [(2000, None, 1), (2001, [None] + same[1:], 1), (2002, [float("nan")] + same[1:], 1), (2003, [float("inf")] + same[1:], 2), (2050, [0.0] * d, 2), (None, same, 1), (2100, [float(np.float32(x * 9)) for x in same], 0)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1, "y", 2) for i, v, lab in rows], SCHEMA).repartition(3)


def usable(rows):
    return [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def negatives(rows):
    rows = [(i, v, (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in usable(rows) if i is not None and lab is not None]
    out = []
    for a, va, la in rows:
        if a % 50:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(va, v, strict=True)), i, lab) for i, v, lab in rows if i != a))
        for p, pid, _ in [x for x in scored if x[2] == la][:5]:
            fits = [(n, nid) for n, nid, lab in scored if lab != la and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(a, pid, r, nid, -p, -n) for r, (n, nid) in enumerate(fits, 1)]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    rows = vectors()
    want = negatives(rows)
    assert len(want) > 20
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = lambda df: sorted(tuple(r[c] for c in names) for r in df.collect())
    out = H.hard_negatives(table(spark, rows))
    assert [f"{f.name} {f.dataType.simpleString()}" for f in out.schema] == ["anchor_id bigint", "positive_id bigint", "rank int", "negative_id bigint", "positive_score bigint", "negative_score bigint"]
    assert got(out) == want
    assert got(H.hard_negatives(table(spark, rows + rows))) == want  # copies of rows count once
    monkeypatch.setattr(H, "BLOCK", 700)  # several blocks, small tiles
    monkeypatch.setattr(H, "TILE", 64)
    assert got(H.hard_negatives(table(spark, rows))) == want
    assert H.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert H.hard_negatives(table(spark, [(1, [0.5] * 4, 1), (2, [0.25] * 4, 2)])).count() == 0  # no anchor
    assert H.hard_negatives(table(spark, [(50, None, 1)])).count() == 0


@pytest.mark.parametrize("d", [1, 3, 64])
def test_bounds_keep_every_pair_in_the_window(d):
    """Also for windows that a product lies exactly on."""
    rng = np.random.default_rng(d)
    a, b = (rng.integers(-400, 400, (40, d)) for _ in range(2))
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
    product = a @ b.T
    low = high = product[:, 7]
    i, j = H.survivors(H.Turned(a, turn), H.Turned(b, turn), np.ones(product.shape, bool), low, high)
    assert {(x, y) for x, y in zip(*np.nonzero(product == low[:, None]), strict=True)} <= set(zip(i.tolist(), j.tolist(), strict=True))
    i, j = H.survivors(H.Turned(a, turn), H.Turned(b, turn), np.ones(product.shape, bool), np.quantile(product, 0.9, axis=1).astype(np.int64), None)
    assert len(i) < product.size or d == 1


def codes(rows):
    kept = [(i, v, lab) for i, v, lab in usable(rows)]
    d = max(len(v) for _, v, _ in kept)
    d = -(-d // 16) * 16
    kept = [(i, v + [0] * (d - len(v)), lab) for i, v, lab in kept]
    w = d // 16
    first = sorted((x for x in kept if x[0] is not None), key=lambda x: x[0])[:64]
    books = [[v[p * w : p * w + w] for _, v, _ in first] for p in range(16)]
    near = lambda x, book: min((sum((s - t) ** 2 for s, t in zip(x, c, strict=True)), k) for k, c in enumerate(book))
    for _ in range(2):
        for p in range(16):
            mine = [[] for _ in first]
            for _, v, _ in kept:
                mine[near(v[p * w : p * w + w], books[p])[1]].append(v[p * w : p * w + w])
            books[p] = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(mine, books[p], strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    found = [(i, lab, [near(v[p * w : p * w + w], books[p]) for p in range(16)]) for i, v, lab in kept]
    total = {}
    for _, lab, x in found:
        total[lab] = total.get(lab, 0) + sum(e for e, _ in x)
    return sorted(((i, "".join(f"{k:02x}" for _, k in x), sum(e for e, _ in x), total[lab], digest) for i, lab, x in found), key=repr)


def test_vector_codes(spark, monkeypatch):
    rows = vectors()
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = lambda df: sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    out = V.vector_codes(table(spark, rows))
    assert [f"{f.name} {f.dataType.simpleString()}" for f in out.schema] == ["vec_id bigint", "code string", "error bigint", "label_error bigint", "codebooks_sha256 string"]
    assert got(out) == codes(rows)
    monkeypatch.setattr(V, "LABELS", 0)  # the salted join
    monkeypatch.setattr(V, "TILE", 7)
    assert got(V.vector_codes(table(spark, rows + rows[:9]))) == codes(rows + rows[:9])
    odd = [(3, [0.5, 0.25, -0.1], 1), (1, [0.5], None), (2, [], None), (9, [0.5, 0.25, -0.1], 1)]  # few rows, lengths that differ
    assert got(V.vector_codes(table(spark, odd))) == codes(odd)
    assert V.vector_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r)[:4] for r in V.vector_codes(table(spark, [(1, None, 1), (None, [1.0], 1)])).collect()] == [(None, None, None, None)]


def test_annulus_is_exact():
    rng = np.random.default_rng(5)
    for w, high in ((1, 3), (4, 90), (7, 4)):  # small numbers: many ties
        x, c = rng.integers(-high, high, (500, w)), rng.integers(-high, high, (64, w))
        far = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        index, error = V.nearest(x, c)
        assert (error == far.min(axis=1)).all() and (index == far.argmin(axis=1)).all()
