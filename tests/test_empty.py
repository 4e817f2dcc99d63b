"""Every registered query of the core over tables without rows."""

from pathlib import Path

import pytest

from fedlens.plans import catalogue, more, problems  # noqa: F401  more adds to the catalogue
from tests.oracle import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    if not Path(DATA).exists():
        pytest.skip("no test tables")
    folder = f"file://{tmp_path_factory.mktemp('empty')}"
    for name in TABLES:
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


#: Queries that bring their own rows.
OWN = {"vec_aggregators": 4, "msg_topologies": 4, "msg_gossip": 1, "msg_signatures": 60, "gen_split_mix": 500, "gen_attacked_round": 1, "run_report": 6, "run_reuse": 6, "run_registry": 7, "run_lineage": 5, "run_events": 2, "run_nodes": 6, "run_predicted": 2}


@pytest.mark.parametrize("name", [*problems.QUERIES, *catalogue.QUERIES])
def test_no_rows_no_failure(spark, empty, name):
    rows = {**problems.QUERIES, **catalogue.QUERIES}[name](spark, empty).collect()
    assert len(rows) == OWN.get(name, 0)
