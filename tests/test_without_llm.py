"""The rest of the library must work where the llm folders and the pipeline were deleted."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/lumenframe", tmp_path / "lumenframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(q) == set(e.oracle_sql()) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_it():
    for folder, _, files in os.walk(f"{ROOT}/lumenframe"):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as source:
                        assert "llm" not in source.read(), f


def test_models_are_opened_late_and_texts_cut():
    import pickle

    from lumenframe.sources.models import OnnxEmbedder, truncated

    assert pickle.loads(pickle.dumps(OnnxEmbedder("a", "b", "c"))).paths == ("a", "b", "c")
    assert truncated([1, 2, 3]) == [1, 2, 3] and truncated(list(range(100)))[-2:] == [75, 99]
