import random

from fedlens.operators import receipts

KEY = "ab" * 32
SCHEMA = "arrival long, sender string, sequence long, ts long, kept string, surplus string, block string"


def surplus(received):
    return sorted((r.kept, r.surplus) for r in received.surplus.collect())


def brute(rows):
    first, out = {}, []
    for arrival, sender, sequence, ts, *_ in sorted(rows, key=lambda r: r[0]):
        if sender is None or not sender.strip() or ts is None or sequence is None:
            continue
        key = (sender.strip().lower().removeprefix("0x"), sequence, ts // 1000 if ts >= 10**11 else ts)
        if key in first:
            out.append((first[key], arrival))
        else:
            first[key] = arrival
    return sorted(out)


def rows_of(*rows):
    return [(*r, "x", None, "z") for r in rows]


def test_spellings_milliseconds_and_missing_values(spark):
    rows = rows_of((1, KEY, 5, 1000), (2, f" {KEY.upper()} ", 5, 1000), (3, f"0x{KEY}", 5, 1000), (4, None, 5, 1000), (5, None, 5, 1000), (6, KEY, None, 1000), (7, KEY, None, 1000), (8, KEY, 5, None), (9, KEY, 6, 1735689600), (10, KEY, 6, 1735689600999), (11, KEY, 5, 1001), (12, KEY, 5, 1001), (13, "  ", 5, 1000))
    got = receipts.receive(spark.createDataFrame(rows, SCHEMA))
    assert surplus(got) == [(1, 2), (1, 3), (9, 10), (11, 12)] == brute(rows)


def test_random_against_brute_force(spark):
    rng = random.Random(3)
    rows = rows_of(*[(i, rng.choice([KEY, "cd" * 32, None]), rng.randrange(0, 40), rng.choice([1, 2, None])) for i in range(600)])
    assert surplus(receipts.receive(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_batches_in_turn_equal_one(spark):
    rng = random.Random(4)
    rows = rows_of(*[(i, rng.choice([KEY, "cd" * 32]), rng.randrange(0, 60), rng.choice([1, 2])) for i in range(400)])
    df = spark.createDataFrame(rows, SCHEMA)
    seen, found = None, []
    for lo in (0, 150, 300):
        got = receipts.receive(df.filter(f"arrival >= {lo} and arrival < {lo + 150}"), seen)
        found += surplus(got)
        seen = got.seen
    assert sorted(found) == brute(rows)
    assert sorted(map(tuple, receipts.joined_ranges(seen.ranges).collect())) == sorted(map(tuple, receipts.joined_ranges(receipts.receive(df).seen.ranges).collect()))


def receipts_key(packed):
    return bytes(packed).hex()


def test_slices_of_a_table_equal_one_batch(spark):
    rng = random.Random(5)
    rows = rows_of(*[(i, rng.choice([KEY, f"0x{KEY}", "cd" * 32, None]), rng.randrange(0, 3 * receipts.BLOCK, 700), rng.choice([1, 2, None])) for i in range(500)])
    df = spark.createDataFrame(rows, SCHEMA)
    for slices in (1, 2, 5):
        got = receipts.receive_in_turn(df, slices)
        assert surplus(got) == brute(rows)
        assert got.seen.ranges.count() == len({(r[1].removeprefix("0x"), r[2]) for r in rows if r[1] and r[3]})  # no two numbers touch
    first = receipts.receive(df.filter("arrival < 250"))
    numbers = receipts.tested(df.filter("arrival >= 250").select(receipts.packed(df.sender).alias("sender"), df.sequence.alias("number")).dropna(), first.seen.ranges)
    earlier = {(r[1].removeprefix("0x"), r[2]) for r in rows[:250] if r[1] and r[3]}
    assert all(r["covered"] == ((receipts_key(r["sender"]), r["number"]) in earlier) for r in numbers.collect())


def test_a_counter_that_starts_again_in_a_later_batch(spark):
    rows = rows_of((1, KEY, 1, 10), (2, KEY, 2, 11), (3, KEY, 3, 12), (6, KEY, 2, 90), (7, KEY, 2, 90), (8, KEY, 2, 11), (9, KEY, 3, 91), (10, KEY, 4, 92))
    df = spark.createDataFrame(rows, SCHEMA)
    first = receipts.receive(df.filter("arrival < 5"))
    second = receipts.receive(df.filter("arrival > 5"), first.seen)
    assert surplus(first) == [] and surplus(second) == [(2, 8), (6, 7)]
    assert [(r.lo, r.hi) for r in receipts.joined_ranges(second.seen.ranges).collect()] == [(1, 4)]


def test_one_number_received_very_often(spark):
    rows = rows_of(*[(i, KEY, 7, 10) for i in range(3000)], *[(3000 + i, KEY, i, 10) for i in range(50)])
    assert surplus(receipts.receive_in_turn(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_ranges_merge_over_blocks_and_leave_holes(spark):
    rows = rows_of(*[(i, KEY, n, 1) for i, n in enumerate([receipts.BLOCK - 1, receipts.BLOCK, receipts.BLOCK + 3])])
    seen = receipts.receive(spark.createDataFrame(rows, SCHEMA)).seen
    assert sorted((r.lo, r.hi) for r in receipts.joined_ranges(seen.ranges).collect()) == [(receipts.BLOCK - 1, receipts.BLOCK), (receipts.BLOCK + 3,) * 2]
    assert [(r.missing_from, r.missing_to) for r in receipts.missing_numbers(seen.ranges).collect()] == [(receipts.BLOCK + 1, receipts.BLOCK + 2)]


def test_accepted_keeps_one_copy_and_rows_without_identifier(spark):
    rows = rows_of((1, KEY, 5, 1000), (1, KEY, 5, 1000), (2, KEY, 5, 1000), (3, None, 5, 1))
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.arrival for r in receipts.receive(df).accepted(df).collect()) == [1, 3]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    got = receipts.receive(df)
    assert receipts.receive_in_turn(df).surplus.count() == 0 and got.surplus.count() == 0 and got.seen.ranges.count() == 0 and got.accepted(df).count() == 0
