"""Every query of the engine against its oracle SQL, on the smallest tables."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from compare import same
from tidewell.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    same(spark, QUERIES[name], ORACLES[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_lsh_agrees_with_exact_search(spark):
    folder = "/root/testdata/sf0.01"
    exact = {(r.query_id, r.memory_id) for r in QUERIES["vec_topk_batched"](spark, folder).collect()}
    near = {(r.query_id, r.memory_id) for r in QUERIES["vec_topk_lsh"](spark, folder).collect()}
    assert len(exact & near) >= 0.95 * len(exact)


def test_runs_without_the_llm_folders(tmp_path):
    """A copy without tidewell/llm, tests/llm and corpus_pipeline.py imports, registers the rest and answers."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "copy", ignore=lambda d, names: [n for n in names if n in ("llm", "corpus_pipeline.py", ".git", "__pycache__")])
    code = (
        "import __spark_entry__ as e\nfrom tidewell.session import get_session\n"
        "assert not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in e.queries()) and set(e.oracle_sql()) <= set(e.queries())\n"
        f"print('rows', e.queries()['mem_stats'](get_session('copy', cores=2, shuffle_partitions=2), '{FOLDER}').count())"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "rows" in done.stdout, done.stderr[-2000:]


def test_entry(spark):
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
    assert e.entry(spark).columns
