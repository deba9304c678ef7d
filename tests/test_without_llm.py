"""The library and its queries work where the training-data subpackage is not installed."""

import os
import subprocess
import sys
import textwrap

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code):
    return subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=REPO, capture_output=True, text=True, timeout=300)


HIDE = """
    import sys
    class Hidden:
        def find_spec(self, name, path=None, target=None):
            if name in ({names}):
                raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
    sys.meta_path.insert(0, Hidden())
"""


@pytest.mark.parametrize("names", ["'corpus_pipeline', 'loanlens.llm'", "'corpus_pipeline',", "'loanlens.llm',"])
def test_entry_imports_without_them(names):
    got = run(HIDE.format(names=names) + """
    import __spark_entry__ as e
    q, s = e.queries(), e.oracle_sql()
    print(len(q), len(s), any(k.startswith("op") or k == "pipeline" for k in q))
    """)
    assert got.returncode == 0, got.stderr
    n, m, any_ = got.stdout.split()[-3:]
    assert int(n) >= 57 and int(m) >= 53 and any_ == "False"


def test_other_import_errors_are_raised():
    got = run(HIDE.format(names="'loanlens.operators.drift',") + """
    import __spark_entry__ as e
    e.queries()
    """)
    assert got.returncode != 0 and "drift" in got.stderr


def test_nothing_else_imports_the_subpackage():
    for top, _, files in os.walk(os.path.join(REPO, "loanlens")):
        if os.path.basename(top) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "loanlens.llm" not in open(os.path.join(top, f), encoding="utf-8").read(), f
