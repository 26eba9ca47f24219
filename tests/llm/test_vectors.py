"""Vector search against brute force."""

import numpy as np
import pytest

from mailloom.llm.vectors import Block, balls, codes, learned_rotation, nearest, substring


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), v if v is None else [float(a) for a in v], "z") for i, v in zip(ids, x)], "vec_id long, embedding array<float>, query_id string")


def exact(ids, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return {i: [ids[j] for j in np.lexsort((ids, -np.round(s[r], 6)))[:k]] for r, i in enumerate(ids)}


@pytest.mark.parametrize("noise,block", [(0.1, 1000), (0.1, 70), (2.0, 1000)])
def test_recall(spark, noise, block):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(25, 64))
    x = (centres[rng.integers(0, 25, 400)] + noise * rng.normal(size=(400, 64))).astype(np.float32)
    ids = rng.permutation(400) * 3
    got = {}
    for r in nearest(table(spark, ids, x), block=block).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = exact(ids, x.astype(float), 10)
    hits = sum(len(got[i] & set(w)) for i, w in want.items())
    assert hits >= 0.97 * 10 * len(ids) and all(len(v) == 10 for v in got.values())


@pytest.mark.parametrize("width", [384, 20])
def test_other_widths(spark, width):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, width))
    x = (centres[rng.integers(0, 20, 300)] + 0.1 * rng.normal(size=(300, width))).astype(np.float32)
    got = {}
    for r in nearest(table(spark, range(300), x), width=width).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = exact(np.arange(300), x.astype(float), 10)
    assert sum(len(got[i] & set(w)) for i, w in want.items()) >= 0.97 * 3000
    assert nearest(table(spark, range(300), x)).count() == 0


def test_dirty_vectors_and_ties(spark):
    one = [1.0] + [0.0] * 63
    rows = [(5, one), (3, one), (9, one), (1, None), (2, [0.0] * 64), (4, [1.0] * 57), (6, [float("nan")] * 64), (7, [-1.0] + [0.0] * 63)]
    got = {(r["query_id"], r["vec_id"]) for r in nearest(table(spark, *zip(*rows)), k=1).collect()}
    assert got == {(5, 3), (3, 5), (9, 3), (7, 3)}
    assert nearest(table(spark, *zip(*rows)).limit(0)).count() == 0
    assert nearest(table(spark, *zip(*rows[:1]))).count() == 0


def test_probing_finds_the_whole_ball():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 64)).astype(np.float32)
    mean, turn = learned_rotation(x[:10].astype(float))
    block = Block(np.arange(500), x, mean, turn)
    q, r = block.candidates(block.codes[:20], balls(16, 2))
    found = set(zip(q.tolist(), r.tolist()))
    distance = np.bitwise_count(codes(x, mean, turn)[:20, None] ^ block.codes[None, :])
    assert all((a, b) in found for a, b in zip(*np.nonzero(distance <= 11)))
    assert substring(block.codes, 3).max() < 1 << 16
