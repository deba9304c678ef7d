"""Each stage against a brute-force version on its own input, and the whole run."""

from collections import defaultdict

import pytest

import corpus_pipeline as P
from loanlens.llm import toxicity
from tests.llm.conftest import SCHEMA
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dedup import brute as brute_near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage, written and read again in between."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, fn in P.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        fn(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (a, b) for name, a, b in out}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_order_of_stages():
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "packing"]


def test_all_but_the_last_return_documents(stages):
    for name in ("toxicity", "line_dedup", "near_dedup"):
        assert stages[name][1].columns == stages[name][0].columns


def test_toxicity_stage_drops_what_the_classifier_rejects(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.fit(*toxicity.training_sample(before, spark.read.parquet(f"{SF}/labels.parquet")))
    scorer = model.scorer()
    want = [r for r in before.collect() if scorer.scores([r.text or ""])[0] < 0.3]
    assert rows(after) == sorted(map(tuple, want), key=repr)


def test_line_stage(stages):
    before, after = stages["line_dedup"]
    want = {i: t for i, n, d, t in brute_lines([(r.doc_id, r.text) for r in before.collect()]) if d == 0 or n > d}
    got = after.collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_documents_without_a_line_left_go(spark, make):
    rows = [(1, "a line of ten or more\nanother line of this"), (2, "a line of ten or more"), (3, ""), (4, None), (5, "another line of this\nown")]
    out = P.drop_shared_lines(spark, make(rows), SF)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, rows[0][1]), (3, ""), (4, ""), (5, "own")]


def test_near_stage_keeps_one_of_each_group(stages):
    before, after = stages["near_dedup"]
    kept = {i for i, _, _, k in brute_near([(r.doc_id, r.text) for r in before.collect()], 5, 80) if k}
    assert rows(after) == sorted((tuple(r) for r in before.collect() if r.doc_id in kept), key=repr)


def test_near_stage_judges_each_text_under_one_id(spark, make):
    text = " ".join(f"w{i}" for i in range(200))
    near = text.replace("w7 ", "v7 ")
    docs = [(1, text), (5, near), (5, "a text of its own that no other document has at all"), (5, text), (None, near),
            (8, "equal rows are one document here"), (8, "equal rows are one document here"), (3, None), (3, "")]
    out = P.drop_near_duplicates(spark, make(docs), SF)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([docs[0], docs[2], docs[5], docs[7], docs[8]], key=repr)


def test_packing_stage_holds_every_document_once(stages):
    before, after = stages["packing"]
    bins, held = defaultdict(int), defaultdict(list)
    for r in after.collect():
        bins[r.sequence_id] += r.length
        held[r.doc_id].append((r.piece, r.start, r.length))
    assert max(bins.values()) <= 1024
    assert held.keys() == {r.doc_id for r in before.collect()}
    for parts in held.values():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(parts)):
            assert (piece, start) == (k, at)
            at += length


def test_run_equals_the_stages(spark, stages):
    keys = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert rows(P.run(spark, SF).select(*keys)) == rows(stages["packing"][1].select(*keys))


def test_awkward_documents_and_an_empty_table(spark, make, awkward):
    for table in (awkward, []):
        docs = make(table, SCHEMA)
        for name, fn in P.STAGES:
            docs = fn(spark, docs, SF)
            docs.count()
