import math

import duckdb
import numpy as np
import pytest

from loanlens.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, id long, g int"


def brute(rows, threshold=0.9):
    good = {}
    for i, v in sorted(((i, v) for i, v in rows if i is not None and v is not None), key=lambda x: x[0]):
        good.setdefault(i, v)
    good = {i: np.array(v, np.float32).astype(float) for i, v in good.items()
            if len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = sorted({i for i, _ in rows if i is not None})
    links = {i: set() for i in ids}
    for a in good:
        for b in good:
            if a != b and len(good[a]) == len(good[b]):
                x, y = good[a] / np.abs(good[a]).max(), good[b] / np.abs(good[b]).max()
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    links[a].add(b)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in links[a]:
                if comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    return sorted((i, len(links[i]), comp[i], comp[i] == i) for i in ids)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 0, 7, 1) for i, v in rows], SCHEMA)
    out = [tuple(r) for r in E.embedding_dedup(df).collect()]
    return sorted(r for r in out if r[0] is not None), [r for r in out if r[0] is None]


def cloud(n, dims=16, spread=0.25, groups=6, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return [(i, (centres[i % groups] + spread * rng.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]


def test_equals_brute_force_over_several_groups(spark, monkeypatch):
    monkeypatch.setattr(E, "GROUP", 40)
    monkeypatch.setattr(E, "TILE", 16)
    rows = cloud(150, spread=0.45)
    assert run(spark, rows)[0] == brute(rows)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]),
            (8, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [-1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1e30, 1e28]), (12, [1e-30, 0.0])]
    got, none = run(spark, rows + [(None, [1.0, 0.0]), (None, None)])
    assert got == brute(rows)
    assert none == [(None, 0, None, True)] * 2


def test_many_copies(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(500)] + cloud(60, 3)
    rows = [(k, v) for k, (_, v) in enumerate(rows)]
    assert run(spark, rows)[0] == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == ([], [])


@pytest.mark.parametrize("dims", [3, 64, 1500])
def test_bound_holds_for_every_pair(dims):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(80, dims)) * np.exp(2 * rng.normal(size=(80, dims)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, a, d = E.quantise(x)
    assert np.abs(q.astype(int)).max() <= 127
    exact = x @ x.T
    quant = (q.astype(float) @ q.T.astype(float)) * np.outer(s, s)
    room = np.outer(a, d) + np.outer(d, a) + np.outer(d, d)
    assert (np.abs(exact - quant) <= room + 1e-9).all()


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    cols = "vec_id, n_links, component_id, kept"
    want = sorted(con.sql(f"select {cols} from ({E.OP2_SQL})").fetchall())
    assert sorted(tuple(r) for r in E.op2(spark, d).selectExpr(*cols.split(", ")).collect()) == want
