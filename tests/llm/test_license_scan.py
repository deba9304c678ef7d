import duckdb
import pytest

from loanlens.llm import license_scan as L
from loanlens.llm.license_texts import NOTICES, TEXTS
from tests.llm.conftest import CLASH


def run(df):
    return {(r.doc_id, i): r for i, r in enumerate(sorted(L.license_scan(df).collect(), key=repr))}


def one(make, text):
    (r,) = L.license_scan(make([(1, text)])).collect()
    return r


def changed(text):
    """Other case, line ends, punctuation, holder and spelling; the same licence."""
    text = text.replace("<year> <holder>", "2019-2024 Jane Doe & Co.").replace("<year>, <holder>", "1999, someone")
    return text.upper().replace("LICENSE", "Licence").replace('"', "“").replace(",", " ,").replace("HTTPS:", "HTTP:") + "\n\n"


def test_known_texts_and_notices(make):
    rows = [(k, changed(t)) for k, (_, t) in enumerate([*TEXTS, *NOTICES])]
    got = {r.doc_id: r.text_license for r in L.license_scan(make(rows)).collect()}
    # a text that stands for two licences would show up as a wrong one here
    assert got == {k: i for k, (i, _) in enumerate([*TEXTS, *NOTICES])}


def test_rewrapped_text(make):
    words = TEXTS[0][1].split("\n\n", 2)
    body = " ".join(words[2].split()).replace("above copyright", "above\ncopyright")
    assert one(make, f"{words[0]}\nCopyright 2021 Someone\n{body}").text_license == "MIT"


def test_notice_in_a_document(make):
    r = one(make, "Some prose.\nReleased under the MIT License.\nCopyright 2020 me\n  * ALL RIGHTS RESERVED *\nmore prose")
    assert (r.text_license, r.n_lines, r.n_license_lines, r.licenses) == (None, 4, 2, "MIT,all-rights-reserved")


@pytest.mark.parametrize("text", ["Released under the MIT License, mostly.", "the MIT License", "Licensed under CC BY-NC 3.0.", ""])
def test_near_misses(make, text):
    r = one(make, text)
    assert r.text_license is None and r.n_license_lines == 0 and r.licenses == ""


def test_awkward_rows(make, awkward):
    a, b = (sorted(map(tuple, L.license_scan(df).collect()), key=repr) for df in (make(awkward), make(awkward, CLASH)))
    assert a == b and len(a) == len(set(awkward))
    assert [r[2] for r in a if r[0] in (2, 3, 4)] == [0, 0, 0]
    assert L.license_scan(make([])).count() == 0


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    cols = "doc_id, text_license, n_lines, n_license_lines, licenses, canonical_sha256"
    want = sorted(con.sql(f"select {cols} from ({L.OP10_SQL})").fetchall(), key=repr)
    assert sorted((tuple(r) for r in L.op10(spark, d).selectExpr(*cols.split(", ")).collect()), key=repr) == want
    assert "Python" not in L.op10(spark, d)._jdf.queryExecution().toString()
