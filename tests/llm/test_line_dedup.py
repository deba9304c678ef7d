import random

import duckdb

from loanlens.llm import line_dedup as L
from tests.llm.conftest import CLASH


def brute(rows, min_docs=2, min_chars=10):
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(i)
    order = lambda i: (i is None, i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < min_docs or min(held[key(x)], key=order) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def run(df, **kw):
    return sorted([(r.row.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in L.line_dedup(df, **kw).collect()], key=repr)


def test_equals_brute_force_on_random_lines(make):
    rng = random.Random(3)
    pool = ["Some shared line", " some SHARED line\r", "short", "", "Ärger über alles", "ärger über alles", "another shared passage"]
    rows = [(i, "\n".join(rng.choice(pool + [f"own line of {i}"]) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    assert run(make(rows)) == brute(rows)


def test_awkward_rows(make, awkward):
    assert run(make(awkward)) == brute(awkward)
    assert run(make(awkward, CLASH)) == brute(awkward)


def test_null_id_is_a_document_after_all_others(make):
    rows = [(None, "a line that two share"), (9, "a line that two share"), (None, "only the null id has this")]
    assert run(make(rows)) == brute(rows)


def test_hot_line_and_higher_threshold(make):
    rows = [(i, f"the line of everyone\nline number {i} alone") for i in range(300)]
    assert run(make(rows)) == brute(rows)
    assert run(make(rows), min_docs=301) == brute(rows, min_docs=301)


def test_empty_table(make):
    assert run(make([])) == []


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in L.op8(spark, d).select("doc_id", "kept_sha256", "n_dropped", "n_lines").collect())
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    assert got == sorted(con.sql(f"select doc_id, kept_sha256, n_dropped, n_lines from ({L.OP8_SQL})").fetchall())


