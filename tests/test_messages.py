import random

import pytest
from pyspark.sql import functions as F

from fedlens.operators import messages as M
from fedlens.streaming import messages as live

KEY = "ab" * 32


def model(trace, window):
    last, seen, out = {}, set(), []
    for peer, n in trace:
        prev = last.get(peer)
        if prev is not None and n <= prev - window:
            out.append("too_old")
        elif (peer, n) in seen:
            out.append("replay")
        else:
            out.append("ok")
            last[peer] = n if prev is None else max(prev, n)
        seen.add((peer, n))
    return out


def run(spark, trace, window=16, piece=M.PIECE):
    df = spark.createDataFrame([(i, p, n, "x") for i, (p, n) in enumerate(trace)], "at long, peer string, n long, __note string")
    rows = M.sequence_verdict(df, F.col("peer"), F.col("n"), F.col("at"), window, piece).collect()
    return [r["sequence_verdict"] for r in sorted(rows, key=lambda r: r["at"])]


@pytest.mark.parametrize("numbers, want", [([1, 2, 3, 100], "ok ok ok ok"), ([1, 1], "ok replay"), ([100, 50], "ok too_old"), ([20, 10, 5], "ok ok ok"), ([*range(1, 21), 100, 50], "ok " * 21 + "too_old"), ([7, 0, 0], "ok ok replay")])
def test_fixed_traces(spark, numbers, want):
    assert run(spark, [("a", n) for n in numbers]) == want.split()


def test_peers_are_apart_and_missing_values_have_no_verdict(spark):
    assert run(spark, [("a", 10), ("b", 5), ("a", 10), ("b", 10)]) == ["ok", "ok", "replay", "ok"]
    assert run(spark, [("a", 1), (None, 1), ("a", None)]) == ["ok", None, None]
    assert run(spark, []) == []


@pytest.mark.parametrize("window, piece", [(16, M.PIECE), (4, 7), (1, 3)])
def test_random_traces(spark, window, piece):
    rng = random.Random(window)
    trace = [(rng.choice("abc"), max(1, i // 3 + rng.randrange(-25, 5))) for i in range(400)]
    want = model(trace, window)
    assert run(spark, trace, window, piece) == want
    for peer in "abc":  # the streaming state machine, in uneven batches
        own = [(i, n) for i, (p, n) in enumerate(trace) if p == peer]
        last, kept, got = None, set(), []
        while len(got) < len(own):
            part = [n for _, n in own[len(got) : len(got) + rng.randrange(1, 9)]]
            verdicts, last, kept = live.judged(part, last, kept, window)
            got += verdicts
            assert len(kept) <= window + 1
        assert got == [want[i] for i, _ in own]


def test_window_zero_and_bounds(spark):
    assert run(spark, [("a", 1), ("a", 1), ("a", 2)], 0) == ["ok", "too_old", "ok"]
    with pytest.raises(ValueError):
        run(spark, [], 257)


def envelope(**k):
    return {"arrival": 1, "sender": KEY, "version_major": 0, "version_minor": 1, "message_type": 1, "sequence": 1, "ts": 1000, "now": 1000, "sig_valid": True, **k}


def test_order_of_checks_and_untouched_state(spark):
    rows = [envelope(arrival=1), envelope(arrival=2, sequence=2, sig_valid=False), envelope(arrival=3, sequence=2), envelope(arrival=4, sequence=3, ts=939, sig_valid=None), envelope(arrival=5, sequence=3, ts=940), envelope(arrival=6, version_minor=2, ts=1), envelope(arrival=7, sender="0x" + "0" * 64), envelope(arrival=8, sender=None), envelope(arrival=9, sig_valid=None), envelope(arrival=10, sequence=3), envelope(arrival=11, ts=None)]
    schema = "arrival long, sender string, version_major int, version_minor int, message_type int, sequence long, ts long, now long, sig_valid boolean"
    got = {r.arrival: r.verdict for r in M.verified(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "ok", 2: "invalid_signature", 3: "ok", 4: "expired", 5: "ok", 6: "unsupported_version", 7: "invalid_sender", 8: "invalid_sender", 9: "missing_signature", 10: "replay", 11: "expired"}


def test_small_rules(spark):
    ages = spark.createDataFrame([(a,) for a in (-1, 0, 2, 5, 6)], "age int")
    w = lambda how: [round(r[0], 4) for r in ages.select(M.staleness_weight(F.col("age"), how)).collect()]
    assert w("none") == [0, 1, 1, 1, 0] and w("threshold") == [0, 1, 0.5, 0.5, 0] and w("exponential") == [0, 1, 0.3679, 0.0821, 0]
    votes = spark.createDataFrame([(1, i < 67) for i in range(100)] + [(2, i < 66) for i in range(100)], "round int, yes boolean")
    assert {r["round"]: r["reached"] for r in M.quorum(votes, "round", F.col("yes")).collect()} == {1: True, 2: False}
    rows = spark.createDataFrame([("a", i) for i in range(7)], "k string, i int")
    assert [r["i"] for r in M.every_nth(rows, ["k"], ["i"], 3).collect()] == [2, 5] and M.every_nth(rows, ["k"], ["i"], 0).count() == 7
    roles = M.peers_by_role(spark.createDataFrame([("gateway",), ("contributor",), ("observer",)], "role string"), F.col("role"))
    assert [r[1:] for r in roles.collect()] == [(True, False), (False, True), (False, False)]


def test_streams(spark, tmp_path):
    schema = "arrival long, sender string, version_major int, version_minor int, message_type int, sequence long, ts long, now long, sig_valid boolean"
    source = str(tmp_path / "in")
    for i, part in enumerate(([(1, 1), (2, 2), (3, 1)], [(4, 2), (5, 30), (6, 3)])):
        rows = [envelope(arrival=a, sequence=n, ts=1000 + n, now=1000 + n) for a, n in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        (tmp_path / f"mark{i}").touch()
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    live.exactly_once_sink(read(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert len(spark.read.parquet(str(tmp_path / "out/accepted")).select("sequence").distinct().collect()) == spark.read.parquet(str(tmp_path / "out/accepted")).count() == 4
    q = live.counts_per_window(live.accepted_stream(read())).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(messages) from windows").first()[0] == 6
    q = live.deduplicated_stream(read()).writeStream.outputMode("append").format("memory").queryName("unique_rows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select count(*) from unique_rows").first()[0] == 4
