import random
from collections import Counter

import pytest

from fedlens.llm.distinct import BUCKET, distinct_rows

SCHEMA = "name string, v double, place long, h long, n long"


@pytest.mark.parametrize("bits", [BUCKET, 1 << 20])
def test_exact_with_few_and_many_bits(spark, bits):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([float(rng.randrange(400)), None]), 1, 2, 3) for _ in range(900)]
    rows += [("hot", 1.0, None, None, None)] * 500
    got = Counter(map(tuple, distinct_rows(spark.createDataFrame(rows, SCHEMA).repartition(5), bits).collect()))
    assert got == Counter(set(rows))


def test_no_rows_and_no_repeats(spark):
    assert distinct_rows(spark.createDataFrame([], SCHEMA)).count() == 0
    assert distinct_rows(spark.range(1000)).count() == 1000
