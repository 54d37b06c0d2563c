import os
import shutil
import subprocess
import sys

import pytest

from .conftest import ROOT

ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n[:2] == 'op' and n[2].isdigit() or n == 'pipeline' for n in q))"
HIDE = "import sys; sys.modules['{name}'] = None; "


def listed(root, before=""):
    out = subprocess.run([sys.executable, "-c", before + ASK], cwd=root, env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True, check=True)
    return [int(x) for x in out.stdout.split()]


def test_optional_parts_can_be_missing(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json"))
    core = listed(copy)[0] - listed(copy)[1]
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "gridloom" / "llm", ignore_errors=True)
    assert listed(copy) == [core, 0]
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert listed(copy) == [core, 0]


@pytest.mark.parametrize("name", ["public_tokenizers", "zstandard", "corpus_pipeline", "gridloom.llm"])
def test_optional_parts_that_cannot_be_imported(name):
    """A package that they need is not installed: the core queries remain, all of them."""
    both = listed(ROOT)
    hidden = listed(ROOT, HIDE.format(name=name))
    assert hidden[0] - hidden[1] == both[0] - both[1] > 0
