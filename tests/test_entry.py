"""The registry in a copy of the repository without the training-data operators."""

import pathlib
import shutil
import subprocess
import sys

import pytest

REPO = pathlib.Path(__file__).resolve().parent.parent
PROBE = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), sum(k.startswith('op') or k == 'pipeline' for k in q))"


@pytest.mark.parametrize("gone", [("quillmill/llm",), ("quillmill/llm", "corpus_pipeline.py")])
def test_registry_without_the_optional_folders(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", ".hypothesis"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    out = subprocess.run([sys.executable, "-B", "-c", PROBE], cwd=copy, capture_output=True, text=True, check=True)
    n, sql, optional = map(int, out.stdout.split())
    assert n > 50 and 0 < sql <= n and optional == 0


def test_a_broken_operator_is_not_hidden(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", ".hypothesis"))
    if not (copy / "quillmill/llm").is_dir():
        pytest.skip("no training-data operators")
    (copy / "quillmill/llm/queries.py").write_text("import a_module_that_is_not_there\n")
    out = subprocess.run([sys.executable, "-B", "-c", PROBE], cwd=copy, capture_output=True, text=True)
    assert out.returncode and "a_module_that_is_not_there" in out.stderr
