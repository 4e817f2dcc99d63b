import numpy as np
import pytest
from pyspark.sql import functions as F

from fedlens.functions import generators as gen
from fedlens.plans import config as C


def test_bounds():
    for make in (lambda: C.Topology("gossip", fanout=0), lambda: C.Topology("gossip", fanout=65), lambda: C.Topology("hierarchical", layers=17), lambda: C.Topology("tree"), lambda: C.RunConfig(rounds=0), lambda: C.RunConfig(threshold=float("nan")), lambda: C.RunConfig(threshold=-1), lambda: C.ReplayConfig(capacity=0), lambda: C.ReplayConfig(window=257)):
        with pytest.raises(C.ConfigError):
            make()
    assert C.RunConfig() == C.RunConfig(C.Topology("gossip", 3), "trimmed_mean", 0.2, 100, 0.01)


def test_topologies(spark):
    edges = lambda t, n: sorted(map(tuple, t.edges(spark, n).collect()))
    assert edges(C.Topology("ring"), 3) == [(0, 1), (1, 2), (2, 0)] and edges(C.Topology("star"), 3) == [(1, 0), (2, 0)]
    assert len(edges(C.Topology("full_mesh"), 5)) == 20 and len(edges(C.Topology("hierarchical", layers=2), 10)) == 9
    gossip = edges(C.Topology("gossip", fanout=3), 50)
    assert all(a != b and 0 <= b < 50 for a, b in gossip) and 100 < len(gossip) <= 150
    assert edges(C.Topology("ring"), 1) == edges(C.Topology("gossip"), 1) == []
    with pytest.raises(C.ConfigError):
        C.Topology("full_mesh").edges(spark, 1001)


def test_rounds(spark):
    rounds = spark.createDataFrame([(1, 2, 100), (2, 2, 100), (3, 1, 5), (4, 1, 100)], "round_id int, expected int, deadline int")
    updates = spark.createDataFrame([(1, "a", 50), (1, "b", 101), (1, "b", 102), (2, "a", 1), (9, "a", 1), (1, "c", None)], "round_id int, sender string, sent int")
    assert [r["late"] for r in C.in_time(updates, rounds, F.col("sent")).orderBy("round_id", "sender", "sent").collect()] == [False, True, True, True, False, True]
    assert {r[0]: r[1:] for r in C.round_status(rounds, updates, F.lit(50)).collect()} == {1: (3, "complete"), 2: (1, "collecting"), 3: (0, "failed"), 4: (0, "pending")}


def test_generators():
    assert gen.split_mix(0, 2).tolist() == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4]  # the published first outputs of seed 0
    drawn = gen.uniform(7, 10_000)
    assert drawn.min() >= -0.5 and drawn.max() < 0.5 and abs(drawn.mean()) < 0.02
    p = gen.linear_parameters(3, 2, 1)
    assert len(p) == 8 and abs(p[6:]).max() <= 0.05 and gen.linear_forward(p, 3, np.zeros((1, 3))).tolist() == [p[6:].tolist()]
    with pytest.raises(ValueError):
        gen.linear_forward(p[:-1], 3, np.zeros(3))
    assert gen.mock_peer(1) != gen.mock_peer(2) and len(gen.mock_peer(1)) == 64
