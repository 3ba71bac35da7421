"""Every registered query against its SQL on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from contract import DATA, compare, duck

SF = str(DATA / "sf0.001")
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
#: No rows in the smallest tables, but at 0.01.
EMPTY_AT_SMALLEST = {"files_since", "tunnels_of_wing", "graph_suggest_links"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    verdict, _ = compare(spark, con, SF, QUERIES[name], ORACLES.get(name))
    assert verdict in ("equal", "rows only") or (name in EMPTY_AT_SMALLEST and verdict == "equal but EMPTY"), verdict


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_python_workers_need_no_copy_of_the_package(tmp_path):
    """Started elsewhere, with the package known to the driver only."""
    script = f"""
import sys
sys.path.insert(0, {str(Path(entry.__file__).parent)!r})
import __spark_entry__ as entry
from memlake.session import local_session
spark = local_session(2, memory="1g")
assert entry.entry(spark).count() > 0
assert entry.queries()["vector_topk_cells"](spark, {SF!r}).count() > 0
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
