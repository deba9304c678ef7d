import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from loanlens.llm import conversation_repair as R
from loanlens.llm.conversation_sql import OP11_SQL
from loanlens.llm.persistent_audit import Audits

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        out.append(1 if not said else 2 if (role, text) in seen else 3 if said[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def exhaustive(rows, most_inserts=3):
    """Cheapest, then ASCII-least edits of a few rows by trying all: (cost, audit, repaired rows)."""
    bad, best = faults(rows), None
    gaps = [g for n in range(most_inserts + 1) for g in itertools.product(range(n + 1), repeat=len(rows) + 1) if sum(g) == n]
    inserts = [[("I", 3, r, "") for r in ("user", "assistant")]]
    choices = [[("D", 4, None, None)] + ([] if b in (1, 2) else [("K", 3 * (b == 3), role, text),
               ("R", 3 + 3 * (b == 3), "user", text), ("R", 3 + 3 * (b == 3), "assistant", text)]) for (role, text), b in zip(rows, bad)]
    for g in gaps:
        slots = [c for i in range(len(rows) + 1) for c in inserts * g[i] + ([choices[i]] if i < len(rows) else [])]
        for pick in itertools.product(*slots):
            kept = [(r, t) for _, _, r, t in pick if r is not None]
            if all(r for r, _ in kept) and GOOD.fullmatch("".join(r[0] for r, _ in kept)):
                found = (sum(p[1] for p in pick), "".join(p[0] for p in pick), kept)
                best = found if best is None or found[:2] < best[:2] else best
    return best


def digest(kept):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()


def programme(rows):
    p = R.Repair()
    for n, ((role, text), fault) in enumerate(zip(rows, faults(rows))):
        p.row(n, role, text, fault)
    return p.result()


def test_equals_trying_all_edits():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), rng.choice(["a.", "b!", "c", "", "d?"]))
                for _ in range(rng.randint(0, 4))]
        cost, audit, kept = exhaustive(rows)
        got = programme(rows)
        assert (got[5], got[6], got[7]) == (cost, audit, digest(kept)), rows


def plain(rows):
    """The same programme with whole strings: (cost, audit) per state, by tuple order."""
    bad, states = faults(rows), {"start": (0, "")}
    after = {"start": "su", "s": "u", "u": "a", "a": "u"}

    def insert(st):
        st = dict(st)
        for _ in range(3):
            for s, (c, a) in list(st.items()):
                for x in after[s].replace("s", ""):
                    st[x] = min(st.get(x, (10 ** 9, "")), (c + 3, a + "I"))
        return st

    states = insert(states)
    for (role, _), b in zip(rows, bad):
        new = {}
        for s, (c, a) in states.items():
            new[s] = min(new.get(s, (10 ** 9, "")), (c + 4, a + "D"))
            if b in (1, 2):
                continue
            for x in after[s]:
                if role[:1] == x:
                    new[x] = min(new.get(x, (10 ** 9, "")), (c + 3 * (b == 3), a + "K"))
                if x != "s":
                    new[x] = min(new.get(x, (10 ** 9, "")), (c + 3 + 3 * (b == 3), a + "R"))
        states = insert(new)
    return min(states[s] for s in ("start", "a") if s in states)


def test_long_conversations_and_trimming(monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(R, "TRIM_AT", 40)
    for n in (50, 400, 2000):
        rows = [(rng.choice(["system", "user", "assistant"]), f"{rng.randint(0, n)}{rng.choice('.!x')}") for _ in range(n)]
        got = programme(rows)
        assert (got[5], got[6]) == plain(rows)


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 7, 2])
def test_persistent_strings_compare_like_strings(modulus):
    """With a modulus of 2 nearly all hashes collide: the check of the prefix found keeps the order right."""
    rng, a = random.Random(modulus), Audits(modulus)
    made = {0: ""}
    for _ in range(300):
        n = rng.choice(list(made))
        if len(made[n]) < 40:
            letter = rng.choice("DIK")
            made[a.add(n, letter)] = made[n] + letter
    assert all(a.text(n) == text for n, text in made.items())
    for x, y in itertools.product(rng.sample(list(made), 60), repeat=2):
        assert a.less(x, y) == (made[x] < made[y])


def test_trim_keeps_strings():
    rng, a = random.Random(1), Audits()
    stem = 0
    for c in "KKDI":
        stem = a.add(stem, c)
    tips = []
    for _ in range(4):
        n = stem
        for c in rng.choices("KDI", k=5):
            n = a.add(n, c)
        tips.append(n)
    texts = [a.text(n) for n in tips]
    assert [a.text(n) for n in a.trim(tips)] == texts


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t, " " if r is None else r, " " if x is None else x) for c, t, r, x, there in rows if c == conv and there),
                      key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
        pairs = [(r, x) for _, r, x in mine]
        bad = faults(pairs)
        turns = {t for t, _, _ in mine if t is not None}
        cost, audit, kept = exhaustive(pairs)
        out[conv] = (*(bad.count(k) for k in (1, 2, 3)), sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:])),
                     max(turns) - min(turns) + 1 - len(turns) if turns else 0, cost, audit, digest(kept))
    return out


AWKWARD = [(1, 0, "user", "hello.", True), (1, 0, "user", "hello.", True), (1, 5, "assistant", None, True), (None, None, None, None, True),
           (None, 2, "user", "x?", True), (2, None, "assistant", "a.", True), (2, None, "assistant", "A", True), (3, 1, "user", "dropped", False),
           (4, 7, "", "no role.", True), (5, 1, "user", "long " * 50_000 + ".", True), (5, 2, "assistant", " \t\n.", True), (6, -3, "tool", "t", True)]


def run(spark, rows, extra=""):
    df = spark.createDataFrame([(*r, *([None] * extra.count(","))) for r in rows], f"{SCHEMA}, there boolean{extra}")
    out = R.repair(df, present=df["there"])
    return {r[0]: tuple(r)[1:] for r in out.collect()}


def test_awkward_rows(spark):
    want = brute(AWKWARD)
    assert run(spark, AWKWARD) == want
    assert run(spark, AWKWARD, ", audit string, cost string, _id int") == want
    assert run(spark, []) == {}


def test_repaired_rows_have_the_digest(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["system", "user", "assistant"]), rng.choice(["a.", "b", "", f"{t}!", "same."]))
            for c in [*range(30), None] for t in range(rng.randint(0, 9))]
    df = spark.createDataFrame(rows, SCHEMA)
    audits = R.repair(df)
    kept = {}
    for r in sorted(R.repaired_rows(df, audits).collect(), key=lambda r: r.position):
        kept.setdefault(r.conv_id, []).append((r.role, r.text))
    for r in audits.collect():
        lines = kept.get(r.conv_id, [])
        assert r.repaired_sha256 == digest(lines) and GOOD.fullmatch("".join(x[0][0] for x in lines))


def test_query_equals_sql(spark, sf):
    got = R.op11(spark, sf).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.sql(OP11_SQL).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    assert got[cols].sort_values("conv_id").values.tolist() == want[cols].sort_values("conv_id").values.tolist()


def test_damage(spark):
    rows = [(c, t, "assistant", "Well. Yes!") for c in range(60) for t in (None, 0, 1)]
    df = R.damaged(spark.createDataFrame(rows, SCHEMA))
    got = sorted(((r.conv_id, r.turn, r.role, r.text, r.there) for r in df.collect()), key=repr)
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        one = (c, t, "user" if k == 4 else role, "" if k == 1 else "Well Yes" if k == 2 else text, k != 0)
        want += [one] * (2 if k == 3 else 1)
    assert got == sorted(want, key=repr)
