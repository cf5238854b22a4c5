"""The entry module with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
NAMES = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


def names(folder: Path) -> set[str]:
    return set(subprocess.run([sys.executable, "-c", NAMES], cwd=folder, check=True, capture_output=True, text=True).stdout.split())


def test_entry_without_the_corpus_folders(tmp_path):
    for keep_pipeline in (True, False):
        to = tmp_path / str(keep_pipeline)
        shutil.copytree(REPO / "fieldproof", to / "fieldproof", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(REPO / "__spark_entry__.py", to)
        if keep_pipeline and (REPO / "corpus_pipeline.py").exists():
            shutil.copy(REPO / "corpus_pipeline.py", to)
        rest = names(to)
        assert "qualify_numeric" in rest and "pipeline" not in rest and not any(n.startswith("op1_") for n in rest)
        assert rest <= names(REPO)
