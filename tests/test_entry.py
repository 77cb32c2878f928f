"""The entry module, with the training-data subpackage and without it."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def _names(folder):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)}).stdout.split()


def test_imports_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "tracequill", tmp_path / "tracequill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    names = _names(tmp_path)
    assert len(names) > 60 and "pipeline" not in names and not any(n.startswith("op1_") for n in names)


def test_a_missing_library_leaves_the_other_queries(tmp_path):
    """A library that only the subpackage needs can't be imported."""
    for name in ("zstandard", "xxhash", "sentencepiece", "tokenizers"):
        (tmp_path / f"{name}.py").write_text("raise ImportError('blocked')")
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"
    env = {"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:{ROOT}"}
    names = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env=env).stdout.split()
    assert len(names) > 60 and "pipeline" not in names and not any(n.startswith("op1_") for n in names)


def test_all_is_registered():
    if (ROOT / "tracequill/llm").exists():
        names = _names(ROOT)
        assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_flagship(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
