"""The entry file without the package for training data, or without a library that it needs."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
LOADED = "import importlib.util as u; s = u.spec_from_file_location('entry', {path!r}); e = u.module_from_spec(s); s.loader.exec_module(e)"
HIDDEN = "import sys; sys.modules[{name!r}] = None"


@pytest.mark.parametrize("name", ["public_tokenizers", "cohortry.llm", "corpus_pipeline"])
def test_other_queries_work_without(name, tmp_path):
    """Loaded by path from another folder, too."""
    code = "; ".join(
        [
            HIDDEN.format(name=name),
            LOADED.format(path=f"{ROOT}/__spark_entry__.py"),
            "print(len(e.QUERIES), len(e.queries()), len(e.oracle_sql()))",
        ]
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.split() == ["61", "61", "61"], done.stderr
    assert ("left out" in done.stderr) == (name == "public_tokenizers")
