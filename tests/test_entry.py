import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_imports_without_the_corpus_subpackage(tmp_path):
    shutil.copytree(ROOT / "keyflow", tmp_path / "keyflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(q) == set(e.oracle_sql()); assert not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_outside_imports_the_corpus_subpackage():
    allowed = {ROOT / "__spark_entry__.py", ROOT / "corpus_pipeline.py"}
    for path in ROOT.rglob("*.py"):
        inside = "llm" in path.relative_to(ROOT).parts
        if not inside and path not in allowed and path != Path(__file__).resolve():
            assert "keyflow.llm" not in path.read_text(), path
