import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
TELL = "import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(set(e.oracle_sql()) - set(q)), any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"


def test_registry():
    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found)
    assert all(callable(f) for f in found.values())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["lot_id", "title", "status", "price", "score"]


def copied(tmp_path, *without):
    """The tree without some files and folders."""
    made = tmp_path / "tree"
    shutil.copytree(ROOT, made, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in without:
        path = made / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    return made


def told(tree):
    return subprocess.run([sys.executable, "-c", TELL], cwd=tree, capture_output=True, text=True, check=True).stdout.split(maxsplit=1)


@pytest.mark.parametrize("without", [("martelo/llm", "tests/llm"), ("martelo/llm", "tests/llm", "corpus_pipeline.py")])
def test_stands_without_the_corpus_operators(tmp_path, without):
    from martelo.plans.catalogue import QUERIES

    tree = copied(tmp_path, *without)
    assert told(tree) == [str(len(QUERIES)), "[] False False\n"]
    (tree / "martelo/llm/__pycache__").mkdir(parents=True)
    assert told(tree)[0] == str(len(QUERIES))


def test_stands_without_a_library(tmp_path):
    tree = copied(tmp_path)
    (tree / "ahocorasick.py").write_text("raise ModuleNotFoundError('none here', name='ahocorasick')\n")
    assert told(tree)[1] == "[] False False\n"


def test_errors_of_the_corpus_operators_show(tmp_path):
    tree = copied(tmp_path)
    package = tree / "martelo/llm"
    package.mkdir(exist_ok=True)
    (package / "__init__.py").write_text("")
    (package / "queries.py").write_text("import martelo.llm.nothing\n")
    with pytest.raises(subprocess.CalledProcessError):
        told(tree)
