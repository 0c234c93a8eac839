"""The entry module with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

from tests.conftest import ROOT

COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q), set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("without", [[], ["vigil/llm", "tests/llm"], ["vigil/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_imports(tmp_path, without):
    for name in ("vigil", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        skip = shutil.ignore_patterns("__pycache__", *[os.path.basename(w) for w in without if w.startswith(name + "/")])
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=skip)
        elif os.path.exists(source) and name not in without:
            shutil.copy(source, tmp_path / name)
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    every, corpus, known = out.stdout.split()
    assert known == "True" and int(every) - int(corpus) >= 180
    if "vigil/llm" in without or not os.path.isdir(os.path.join(ROOT, "vigil", "llm")):
        assert int(corpus) == 0
