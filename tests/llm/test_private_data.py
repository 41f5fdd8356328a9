"""Personal data against brute force: base spans by the contract's own patterns, contexts and scores in plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import regex

from quillgraph.llm import private_data as P

SCHEMA = "doc_id long, text string, row long, kind string, start int, spans string"
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    return luhn(d) if kind == "card" and 12 <= len(d) <= 19 else 9 <= len(d) <= 15 if kind == "phone" else kind == "email"


def base(t):
    return [(m.start(), k, m.end()) for k, kind in enumerate(P.KINDS) for m in re.finditer(PLAIN[kind], t) if holds(kind, m.group())]


def shapes(m):
    n, letters = len(re.sub("[^0-9]", "", m)), re.search("[A-Za-z]", m)
    return [bool(letters), not letters and bool(re.search(r"^[0-9]{1,3}([\x20.-]{1,2}[0-9]{1,3}){3}$", m)), not letters and 12 <= n <= 19, not letters and 7 <= n <= 15]


def found(t):
    """start, end, value, shapes, seeds, contexts of each candidate."""
    out, last, all_ = [], 0, list(regex.finditer(P.CANDIDATE, t))
    for i, m in enumerate(all_):
        x = m.group()
        before, behind = t[last : m.start()], t[m.end() : all_[i + 1].start() if i + 1 < len(all_) else None]
        last = m.end()
        near = before[-64:]
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", near.split("\n")[-1].lower()) if w]
        if "\n" in near or len(before) < 64:
            words = ["^", *words]
        after = re.match(r"[\x20\x09]*([^\x20\x09-\x0D]*)", behind[:64].lower())[1]
        value = re.sub(r"\x20?[\[(]dot[\])]\x20?", ".", re.sub(r"\x20?[\[(](?:at|@)[\])]\x20?", "@", x.lower())) if re.search("[A-Za-z]", x) else re.sub("[^0-9]", "", x)
        seeds = [bool(re.fullmatch(PLAIN[k], x)) and holds(k, x) for k in P.KINDS]
        out.append((m.start(), m.end(), value, shapes(x), seeds, ["2 " + " ".join(words[-2:]), f"1 {' '.join(words[-1:])} | {after}"]))
    return out


def accepted(all_found):
    members, seeds = defaultdict(set), set()
    for *_, value, shape, seed, contexts in all_found:
        for k in range(4):
            if shape[k]:
                seeds |= {(k, value)} if seed[k] else set()
                for c in contexts:
                    members[k, c].add(value)
    worth, out = {x: P.WHOLE for x in seeds}, {}
    for _ in range(P.ROUNDS):
        out = {}
        for (k, c), values in members.items():
            w = [worth.get((k, v), 0) for v in values]
            if sum(w) // len(w) >= P.ACCEPT and sum(x >= P.ACCEPT for x in w) >= P.SUPPORT:
                out[k, c] = sum(w) // len(w)
        worth = {x: P.WHOLE for x in seeds}
        for (k, c), w in out.items():
            for v in members[k, c]:
                worth[k, v] = max(worth.get((k, v), 0), w)
    return out


def expected(texts):
    each = [found(t or "") for t in texts]
    patterns = accepted([x for f in each for x in f])
    rows = []
    for t, f in zip(texts, each, strict=True):
        b = base(t or "")
        more = []
        for s, e, _, shape, _, contexts in f:
            best = max(((patterns[k, c], -k) for k in range(4) if shape[k] for c in contexts if (k, c) in patterns), default=None)
            if best and all(e <= x or z <= s for x, _, z in b):
                more.append((s, -best[1], e))
        name = lambda xs: ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in sorted(xs))
        rows.append((*(sum(k == j for _, k, _ in b) for j in range(4)), hashlib.sha256(name(b).encode()).hexdigest(), name(b + more)))
    return rows


def texts():
    rng = random.Random(4)
    word = lambda: rng.choice(["haus", "Été", "river", "and", "of", "the", "stone"])
    fill = lambda n: " ".join(word() for _ in range(n))
    out = []
    for i in range(12):
        out.append(f"{fill(12)}\nPhone: +1 (20{i % 10}) 555-01{i:02d}\n{fill(5)} write to me{i}@mail.example.com please {fill(4)}")
        out.append(f"{fill(9)} from host address 10.2.{i}.{i * 20} was {fill(6)}")
    for i in range(3):  # behind the same words: what no fixed pattern takes
        out.append(f"{fill(12)}\nPhone: (30{i}) 555-02{i:02d}\n{fill(5)} write to you{i} (at) mail (dot) example.com please, {fill(20)}")
        out.append(f"{fill(9)} from host address 10 2 {i} 77 was {fill(6)}")
        out.append(f"{fill(20)} {4000000000000000 + i * 7919} {fill(3)} number {i}{i}{i} 444 5555 x")  # decoys in no such context
    out += [f"card 4111 1111 1111 1111{'' if i % 2 else ' and 4111-1111-1111-1112'} {fill(i)}" for i in range(4)]
    out += [None, "", "no digits", "a.b@c_d@e.f.g@h.i..j@k", "1.2.3.4.5.6.7.8 256.1.1.1 00255.1.1.1 1.2.3", "+12 (3)45-678.90)) +1 2 +49 30 1234567--", "9" * 4000 + " " + "1 " * 3000 + "12.34." * 2000, "x" * 50_000 + "@y " + "a@b." * 2000 + "c",
            "é 12345678 (at) +1 (555) 555-1234.a@b.c", "ünï +1 (407) 555-7710\n" + "Fax: 555-0199\n" * 300]
    out += [out[0], out[0]]
    return out


def test_private_spans(spark):
    t = texts()
    ids = [None if i % 9 == 8 else i - i % 2 for i in range(len(t))]  # null and repeated ids
    docs = spark.createDataFrame([(i, x, 5, "clash", 1, "clash") for i, x in zip(ids, t, strict=True)], SCHEMA).repartition(3)
    out = P.private_spans(docs)
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = expected(t)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(((i, *x) for i, x in zip(ids, want, strict=True)), key=repr)
    more = sum(x[5].count(":") // 2 - sum(x[:4]) for x in want)
    assert more >= 9  # phones, addresses and hosts that the fixed patterns don't take
    assert all(x[5].count(":") // 2 == sum(x[:4]) for x, s in zip(want, t, strict=True) if s and "4000000" in s)  # decoys stay
    assert P.private_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql_says_the_same():
    """The registered SQL over texts in which patterns do discover something."""
    import duckdb
    import pandas as pd

    from quillgraph.llm.sql import ORACLES

    t = [x for x in texts() if len(x or "") < 5000]
    documents = pd.DataFrame({"doc_id": range(len(t)), "text": t})
    db = duckdb.connect()
    db.register("documents", documents)
    got = sorted(db.execute(ORACLES["op11_private_data"]).fetchall())
    assert got == [(i, *x) for i, x in enumerate(expected(t))]


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "mail a@b.c", 5, "x", 1, "y")], SCHEMA)
    plan = P.private_spans(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)
