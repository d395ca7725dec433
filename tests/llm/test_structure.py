"""Fill-in-the-middle, conversation repair and personal data against brute force and SQL, and on odd input."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import conversation_repair, fill_in_middle, personal_data, queries

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "a", " a", "a ", "  a b  ", "é　x\x1c \x0bü🙂 ", "one\ttwo  three\n", "1 a\x85b 22", "<P> x", "a<", " <<S", "x <S> y <M>", "nul\x00 x", "word " * 5000, "x" * 70_000]
CLASHES = ["n", "form", "output", "kind", "spans", "found", "body", "h1", "role2", "digest", "copies", "part", "cells", "audit", "label", "weight", "share"]


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_conversation_repair", "digest_op13_base"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in got.columns]
    assert plain(got.collect()) == plain(tuple(r[k] for k in at) for r in want.fetchall())


def test_wavelet_matrix():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 63, 1000):
        symbols = rng.integers(0, 8, n).astype(np.uint8)
        matrix, places = fill_in_middle.WaveletMatrix(symbols), np.arange(n + 1)
        for c in range(8):
            assert matrix.rank(c, places).tolist() == [int((symbols[:p] == c).sum()) for p in places]
            at = np.flatnonzero(symbols == c)
            assert matrix.select(c, np.arange(len(at))).tolist() == at.tolist()


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def middle_form(doc, text, seed=42, share=50, spm=80):
    text, h = text or "", hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    draw = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    assert "".join(units) == text
    i, j = sorted(d % (len(units) + 1) for d in draw[:2])
    p, m, s = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or draw[2] % 100 >= share:
        return doc, len(units), "plain", None, None, text
    psm = draw[3] % 100 >= spm
    return doc, len(units), "psm" if psm else "spm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if psm else f"<S>{s}<P>{p}<M>{m}"


@pytest.mark.parametrize("share", [50, 100])
def test_middle_of_odd_texts(spark, share):
    rows = [(k * 100 + c, t) for k, t in enumerate(ODD) for c in range(6)] + [(None, "a b c d"), (None, None), (7, "x y"), (7, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("clash").alias(c) for c in CLASHES])
    made = fill_in_middle.fill_in_middle(docs, share=share)
    back = made.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert plain(r[:6] for r in back) == plain(middle_form(d, t, share=share) for d, t in rows)
    assert sorted(r.back for r in back) == sorted(t or "" for _, t in rows)
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(docs.where("false")).count() == 0


STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FULL = {"u": "user", "a": "assistant"}


def cheapest(turns):
    """Least (cost, audit, repaired) over all edits of (role, text, must go, cut off) turn by turn, by every prefix's best."""
    best = {"": (0, "", ())}

    def inserted(best):
        for _ in range(3):
            for p, (c, a, out) in list(best.items()):
                for x in "ua":
                    if (p, x) in STEP:
                        q, way = STEP[p, x], (c + 3, a + "I", (*out, f"{FULL[x]}:"))
                        best[q] = min(best.get(q, way), way)
        return best

    for role, text, gone, cut in turns:
        old, best = inserted(best), {}
        for p, (c, a, out) in old.items():
            ways = [(p, (c + 4, a + "D", out))]
            if not gone:
                ways += [(STEP[p, x], (c + 3 * cut, a + "K", (*out, f"{role}:{text}"))) for x in "sua" if role[:1] == x and (p, x) in STEP]
                ways += [(STEP[p, x], (c + 3 + 3 * cut, a + "R", (*out, f"{FULL[x]}:{text}"))) for x in "ua" if (p, x) in STEP]
            for q, way in ways:
                best[q] = min(best.get(q, way), way)
    return min(v for q, v in inserted(best).items() if q in ("", "a"))


def judged(rows):
    """What op12 returns of one conversation, from its damaged rows (turn, role, text)."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())
    rows, seen, turns, n = sorted(rows, key=key), set(), [], {"b": 0, "d": 0, "t": 0}
    for _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+", "", text)[-1:]
        fault = "b" if not last else "d" if (role, text) in seen else "t" if last not in ".!?" else ""
        seen.add((role, text))
        turns.append((role, text, fault in ("b", "d"), fault == "t"))
        if fault:
            n[fault] += 1
    known = [r[0] for r in rows if r[0] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = cheapest(turns)
    return gaps, n["b"], n["d"], n["t"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def conversations():
    rng = random.Random(3)
    texts = ["Yes.", "No!", "well", " \n", "Why? ", "ok.\t", "x. y", "é!", "a longer answer, cut"]
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool", "", None, "unknown"]), rng.choice([*texts, None])) for c in range(60) for t in range(rng.choice([1, 2, 5, 9, 14, 25]))]
    rows += [(100, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(700)]  # over several tasks
    rows += [(101, 5, "user", "Same.")] * 40 + [(101, None, "user", "Early."), (101, 2, "assistant", "Same.")]  # repeated rows, a turn without a number
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hi!"), (None, None, None, None)]
    rows += [(200 + c, t, "user" if t % 2 else "assistant", f"{c % 3} {t} said.") for c in range(5) for t in (0, 3, 4, 9)]
    return rows


@pytest.mark.parametrize("parts", [1, 4])
def test_repairs(spark, parts):
    rows = conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts).select("*", *[F.lit("clash").alias(c) for c in ("copies", "digest", "cells", "part", "head", "cut", "seen")])
    by = {}
    for c, *r in damage(rows):
        by.setdefault(c, []).append(r)
    turns = conversation_repair.damaged(table)
    found = conversation_repair.audits(conversation_repair.parsed(conversation_repair.faults(turns)), table.select("conv_id").distinct())
    got = {r[0]: tuple(r[1:]) for r in conversation_repair.repair_digests(turns, found).collect()}
    assert got == {c: judged(by.get(c, [])) for c in {r[0] for r in rows}}
    out = {}
    for r in conversation_repair.repaired(turns, found).collect():
        out.setdefault(r.conv_id, []).append((r.nth, f"{r.role}:{r.text}"))
    for c, want in got.items():
        assert hashlib.sha256("\n".join(x for _, x in sorted(out.get(c, []))).encode()).hexdigest() == want[-1]
    assert conversation_repair.repair_digests(turns.where("false"), conversation_repair.plan_repairs(turns.where("false"))).count() == 0


def test_cells():
    """A block's chart gives what any cut of it gives, and cells are ordered as (cost, audit)."""
    rng = np.random.default_rng(1)
    kinds = rng.integers(0, 9, (200, conversation_repair.BLOCK))
    top = conversation_repair.parse(kinds)
    for n in (1, 4, 9):
        assert (conversation_repair.combine(conversation_repair.parse(kinds[:, :n]), conversation_repair.parse(kinds[:, n:])) == top).all()
    for row, cells in zip(kinds[:50], top[:50]):
        spans = conversation_repair.Spans()
        for k in row:
            spans.add([None if c >= conversation_repair.NONE else conversation_repair.read_cell(c) for c in conversation_repair.TURNS[k].tolist()])
        assert spans.whole() == [None if c >= conversation_repair.NONE else conversation_repair.read_cell(c) for c in cells.tolist()]
    some = [(c, "".join(a)) for c in (0, 3) for a in itertools.product("DIKR", repeat=3)]
    assert sorted(some) == [conversation_repair.read_cell(x) for x in sorted(conversation_repair.cell(*s) for s in some)]


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(int(x) for x in reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda d=d: 14 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 10 <= len(d) <= 15}[kind]
            if ok():
                out.append((m.start(), k, m.end()))
    return sorted(out)


def personal_texts():
    rng = random.Random(9)
    bits = ["a@b.c", "x.y+z@mail-1.example.com", "a@b..c", "@", "..", "1.2.3.4", "999.1.1.1", "001.002.003.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "12345678901234567890", "+1 (132) 555-1352", "+12", "+49 30 1234567",
            "+1+2", "é🙂", " ", "\n", "-", "name [at] host [dot] org", "call 132-555-1352", "version 10.2.3.4", "0000000000000000", "a@b.c%x@d.e", "1[.]2[.]3[.]4", "(", ")", "7", "4"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.choice([1, 2, 3, 8, 40]))) for _ in range(400)]
    return [*texts, "", None, "9" * 60_000, "a" * 60_000 + "@x.yz", ("+1 (132) 555-1352, " * 3000), "1 " * 20_000, "x@y.z " * 2000]


def test_personal_data(spark):
    rows = [(k, t) for k, t in enumerate(personal_texts())] + [(None, "me@here.org"), (3, "+49 30 1234567 x"), (3, "+49 30 1234567 x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("clash").alias(c) for c in CLASHES])
    got = personal_data.personal_data(docs).collect()
    assert plain((r.doc_id, str([(s.start, s.kind, s.end) for s in r.found if s.base])) for r in got) == plain((d, str(base_spans(t))) for d, t in rows)
    for r in got:  # added ones are likely, and no two spans of a kind overlap
        assert all(s.base or s.probability >= 0.5 for s in r.found)
        for k in range(4):
            own = [(s.start, s.end) for s in r.found if s.kind == k]
            assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))
    assert personal_data.personal_data(docs.where("false")).count() == 0
    nothing = spark.createDataFrame([(1, "no data"), (2, None)], "doc_id long, text string")
    assert [len(r.found) for r in personal_data.personal_data(nothing).collect()] == [0, 0]


def brute_estimate(patterns, rounds):
    """Expectation-maximisation span by span."""
    spans = [v for v, n in patterns for _ in range(n)]
    post = [0.5 + 0.45 * sum(v) / 6 for v in spans]
    for r in range(rounds + 1):
        yes, no = sum(post), len(post) - sum(post)
        share = (yes + 1) / (len(post) + 2)
        table = [[(sum(p for p, v in zip(post, spans) if v[j] == x) + 1) / (yes + 3) for j in range(6) for x in (-1, 0, 1)], [(sum(1 - p for p, v in zip(post, spans) if v[j] == x) + 1) / (no + 3) for j in range(6) for x in (-1, 0, 1)]]
        odds = [np.log(share / (1 - share)) + sum(np.log(table[0][j * 3 + x + 1] / table[1][j * 3 + x + 1]) for j, x in enumerate(v)) for v in spans]
        post = [1 / (1 + np.exp(-o)) for o in odds]
    return share, *table


def test_estimate(spark):
    rng = random.Random(4)
    truth = [rng.random() < 0.7 for _ in range(300)]
    votes = [tuple((1 if t else -1) * (1 if rng.random() < good else -1) if rng.random() < 0.9 else 0 for good in (0.95, 0.9, 0.8, 0.7, 0.6, 0.5)) for t in truth]
    counts = {v: votes.count(v) for v in set(votes)}
    table = spark.createDataFrame([(0, *v, 0, 0, 0, n) for v, n in counts.items()], "kind int, " + ", ".join(f"{n} int" for n in (*personal_data.LABELERS, *personal_data.FORMS)) + ", n long")
    model = personal_data.estimate(table).collect()
    share, yes, no = brute_estimate(list(counts.items()), personal_data.ROUNDS)
    assert model[0].share == pytest.approx(share) and model[0].yes == pytest.approx(yes) and model[0].no == pytest.approx(no)
    assert abs(share - sum(truth) / 300) < 0.1
    reliable = {(r.labeler, r.vote): r.on_true for r in personal_data.reliabilities(personal_data.estimate(table)).collect()}
    assert reliable["pattern", 1] > reliable["context", 1] > reliable["variety", 1]
    weights = personal_data.train(table, personal_data.estimate(table))
    ranked = table.selectExpr("*", f"{personal_data._probability(weights).replace('s.', '')} AS p").collect()
    right = sum(r.n for r in ranked for v in [tuple(r[1:7])] if (r.p >= 0.5) == (sum(votes.count(v) and t for t, x in zip(truth, votes) if x == v) * 2 > counts[v]))
    assert right / 300 > 0.9


def test_no_python_in_the_plan(spark):
    found = personal_data.candidates(spark.read.parquet(f"{SF}/documents.parquet"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
