import random
from collections import Counter, defaultdict

import pytest

from fedlens.llm import packing, tokens

SCHEMA = "id long, tokens long, part string, length string, bucket string, rank string"


def run(spark, sizes, capacity, **k):
    df = spark.createDataFrame([(i, t, "p", "l", "b", "r") for i, t in sizes], SCHEMA)
    packed, plan = packing.pack(df, capacity, **k)
    return packed.collect(), plan


def check(rows, plan, sizes, capacity):
    used, parts = defaultdict(int), defaultdict(list)
    for r in rows:
        used[r.container] += r.length
        parts[r.id].append((r.part, r.length))
    assert all(n <= capacity for n in used.values()) and set(used) == set(range(plan.containers))
    want = Counter()
    for i, t in sizes:
        if i is not None and t and t > 0:
            want.update([(i, p, min(capacity, t - p * capacity)) for p in range(-(-t // capacity))])
    assert Counter((r.id, r.part, r.length) for r in rows) == want
    return sum(used.values()) / (plan.containers * capacity)


@pytest.mark.parametrize("bucket_rows", [packing.BUCKET_ROWS, 50])
def test_random_sizes_fill_well(spark, bucket_rows):
    rng = random.Random(9)
    sizes = [(i, rng.choice([rng.randrange(5, 60), rng.randrange(1, 400)])) for i in range(1500)]
    for capacity in (128, 512):
        rows, plan = run(spark, sizes, capacity, bucket_rows=bucket_rows)
        assert check(rows, plan, sizes, capacity) > 0.98


def test_exact_fits_cuts_ties_and_repeats(spark):
    sizes = [(1, 10), (2, 10), (3, 20), (4, 25), (4, 25), (5, 0), (6, None), (None, 3), (7, 1)]
    rows, plan = run(spark, sizes, 10)
    check(rows, plan, sizes, 10)
    assert plan.containers == 10  # 2 + 2 + 2 * 2 full ones, two remainders of 5 in one, and the 1


def test_one_length_holds_everything(spark):
    sizes = [(i, 60) for i in range(400)]
    rows, plan = run(spark, sizes, 128, bucket_rows=30)
    check(rows, plan, sizes, 128)
    assert plan.containers == 200


def test_empty(spark):
    rows, plan = run(spark, [], 128)
    assert rows == [] and plan.containers == 0


def test_greedy_alone_and_least_squares():
    import numpy as np

    left = np.zeros(11, dtype=int)
    left[[6, 4, 3]] = 5, 5, 2
    assert sum(t for _, t in packing.greedy(left, 10)) == 6 and not left.any()
    which, copies = packing.combinations(np.array([3, 4, 6]), 10, 0)
    assert ((which * copies).sum(1) == 10).all()
    x = packing.least_squares(which, copies, np.array([0, 0, 0, 2, 6, 0, 5, 0, 0, 0, 0], dtype=float))  # five of 6 + 4 and one of 3 + 3 + 4
    got = np.bincount(which.ravel(), weights=(copies * x[:, None]).ravel(), minlength=11)
    assert abs(got[6] - 5) < 0.1 and abs(got[4] - 6) < 0.1 and (x >= 0).all()


def test_token_counts(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=f"{tokens.TOKENIZERS}/piece_bpe_32k.model")
    texts = ["", None, "Hello there.", "Привет, мир", "word " * 50_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, tokens string")
    assert [r.tokens for r in sorted(tokens.token_counts(df).collect())] == [len(model.encode(t or "")) for t in texts]
