"""Top-k against sorting all scores."""

import math
import random

from girder.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int, score long, id string"


def brute(rows, k):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: v for i, v in sorted(good, reverse=True) if i % 5 == 0}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(b) == len(a))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def test_against_all_pairs(spark):
    dice = random.Random(3)
    rows = [(i, [dice.uniform(-0.3, 0.3) for _ in range(8)]) for i in range(120)]
    rows += [(i, rows[7][1]) for i in range(200, 290)]  # one very common vector
    rows += [(300, None), (305, [None] * 8), (310, [float("nan")] * 8), (315, [float("inf")] * 8), (None, [0.1] * 8), (320, []), (325, [1.0]), (326, [2.0]), (5, rows[5][1])]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    for k, block in ((20, 8192), (3, 4), (500, 8192)):
        got = {tuple(r) for r in topk.top_k(df, df.where("vec_id % 5 = 0"), k=k, block=block).collect()}
        assert got == brute(rows, k)


def test_large_components_and_empty_tables(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 3.0]), (3, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    got = [(r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 0"), k=5).orderBy("rank").collect()]
    assert [i for i, _ in got] == [1, 3, 2] and got[0][1] == 2**63 - 1 and got[2][1] == -(2**63)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
