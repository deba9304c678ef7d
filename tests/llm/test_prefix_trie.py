import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from loanlens.llm import prefix_trie as T
from loanlens.llm.conversation_sql import OP13_SQL

SCHEMA = "conv_id long, turn long, role string, text string"


def turns_of(rows):
    out = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda v: (v[0], v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def regrown(convs):
    """Each conversation after taking over the first turns of the one its group begins with."""
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    members = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for key, ids in members.items():
        kids = [k for k in members if len(k) == len(key) + 1 and k[:len(key)] == key]
        below = [k for k in members if k[:len(key)] == key]
        leaves = [k for k in below if not any(len(j) == len(k) + 1 and j[:len(k)] == k for j in members)]
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = ",".join(str(c) for c in sorted(c for c in ids if len(convs[c]) == len(key)))
        out.append((min(ids), len(key), min(members[key[:-1]]) if key else None, len(ids), len(kids), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def run(df, regrow=False, **kw):
    c = F.col("conv_id")
    chained = T.chains(df, base=c - c % 5, shared=F.crc32(c.cast("string").cast("binary")) % 9) if regrow else T.chains(df)
    return sorted((tuple(r) for r in T.prefix_trie(chained, **kw).collect()), key=lambda r: r[:2])


def random_rows(rng, n, pool=4):
    return [(c, t, rng.choice(["user", "assistant"]), f"text {rng.randint(0, pool)} é") for c in range(n) for t in range(rng.randint(1, 7))]


@pytest.mark.parametrize("regrow", [False, True])
def test_equals_brute_force(spark, regrow):
    rows = random_rows(random.Random(2), 80, 2)
    convs = turns_of(rows)
    assert run(spark.createDataFrame(rows, SCHEMA), regrow) == brute(regrown(convs) if regrow else convs)


AWKWARD = [(1, None, None, None), (1, 0, "user", "a"), (2, None, "", ""), (2, 0, "user", "a"), (None, 0, "user", "a"), (3, 0, "user", "a"),
           (3, 0, "user", "a"), (4, 5, "user", "é" * 60_000), (6, 0, "", "ab"), (7, 0, "a", "b"), (-3, 1, "user", "a"), (10, 1, "user", "")]


def test_awkward_rows(spark):
    want = brute(turns_of(AWKWARD))
    assert run(spark.createDataFrame(AWKWARD, SCHEMA)) == want
    clash = spark.createDataFrame([(*r, 1, "x", None) for r in AWKWARD], SCHEMA + ", depth int, digest string, c long")
    assert run(clash) == want
    assert run(spark.createDataFrame([], SCHEMA)) == []


def test_conversations_that_lose_all_turns(spark):
    """c with a base that is absent and no turn behind its first h: a member of the root alone."""
    rows = [(c, 0, "user", "x") for c in (1, 2, 3, 4, 6, 7, 8, 9)]
    assert run(spark.createDataFrame(rows, SCHEMA), True) == brute(regrown(turns_of(rows)))


def test_copies_and_long_chains(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(150) for t in range(4)] + [(500, t, "user", f"turn {t}") for t in range(300)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(turns_of(rows))


def test_a_crowded_sketch_only_passes_more(spark):
    """With 1,024 cells for 6,000 prefixes hardly any is proven single; the nodes are the same."""
    rows = random_rows(random.Random(4), 1500, 10 ** 6)
    df = spark.createDataFrame(rows, SCHEMA)
    assert run(df, most_cells=1 << 10) == run(df)


def test_sketch_proves_only_singles(spark):
    rows = random_rows(random.Random(7), 300, 1)
    chained = T.chains(spark.createDataFrame(rows, SCHEMA)).cache()
    seen = {}
    for r in chained.where("depth > 0").collect():
        seen[bytes(r.digest)] = seen.get(bytes(r.digest), 0) + 1
    got = T.screened(chained, T.crowded(chained)).collect()
    assert all(seen[bytes(r.digest)] == 1 for r in got if r.single)
    assert sum(r.single for r in got) > 0.8 * sum(n == 1 for n in seen.values())


def test_query_equals_sql(spark, sf):
    got = T.op13(spark, sf).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.sql(OP13_SQL).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    tidy = lambda d: d[cols].fillna(-1).sort_values(["conv_id", "depth"]).values.tolist()
    assert tidy(got) == tidy(want)
