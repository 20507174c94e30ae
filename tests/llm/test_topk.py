import math
import random

import numpy as np
import pytest

from hitfeed.llm.bitsliced_topk import SlicedBlock, add_slices, bitmap, members, top_inner_products

SCHEMA = "vec_id long, embedding array<float>, row string, score string, block int, chunk int"


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def expected(rows, every=20, k=20):
    """(query_id, rank, vec_id, score) in plain Python."""
    whole = [(i, id_, [math.floor(64 * float(np.float32(x))) for x in v]) for i, (id_, v) in enumerate(rows) if sound(v)]
    out = []
    for i, q_id, q in whole:
        if q_id is None or q_id % every:
            continue
        best = sorted((-sum(a * b for a, b in zip(q, v)), id_ is None, id_ or 0) for j, id_, v in whole if j != i and len(v) == len(q))
        out += [(q_id, r, None if none else id_, -s) for r, (s, none, id_) in enumerate(best[:k], 1)]
    return sorted(out, key=str)


def run(spark, rows, **kw):
    table = spark.createDataFrame([(*r, "a", "b", 1, 2) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in top_inner_products(table, **kw).collect()), key=str)


def vectors(seed, n, dim=16, spread=0.3):
    rnd = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in v]) for i, v in enumerate(rnd.normal(0, spread, (n, dim)).astype(np.float32))]


def test_against_brute_force(spark):
    rows = vectors(1, 400)
    assert run(spark, rows) == expected(rows)


def test_blocks_and_chunks_give_the_same(spark):
    rows = vectors(2, 300)
    assert run(spark, rows, block_values=500, chunk_values=60) == expected(rows)


def test_ties_go_to_the_smaller_id(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-0.5, 0.0, 0.5]) for _ in range(3)]) for i in range(200)]
    assert run(spark, rows, block_values=300) == expected(rows)


def test_defined_cases(spark):
    rows = vectors(4, 50, 4) + [
        (60, None), (61, [0.1, None, 0.2, 0.3]), (80, [float("nan")] * 4), (100, [float("inf"), 0.0, 0.0, 0.0]), (120, [0.0] * 4),
        (140, [0.5, 0.5]), (160, [0.25, -0.5]), (180, []), (200, []), (-20, [1.5, 2.5, -3.5, 9.0]), (None, [0.9, 0.9, 0.9, 0.9]),
        (None, [0.9, 0.9, 0.9, 0.9]), (40, [0.3, 0.1, 0.2, -0.1]), (40, [0.3, 0.1, 0.2, -0.1]), (220, [1e6, -1e6, 3.0, 0.0]),
        (240, [0.1] * 7)]
    found = run(spark, rows)
    assert found == expected(rows)
    assert not [r for r in found if r[0] in (60, 61, 80, 100, 240)]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_too_large_scores_are_an_error(spark):
    with pytest.raises(Exception, match="do not fit a long"):
        run(spark, [(0, [1e18, 1e18]), (1, [1e18, 1e18])])


def test_slices_add_up():
    rnd = np.random.default_rng(7)
    values = rnd.integers(0, 1 << 20, (37, 130))
    weights = rnd.integers(0, 4, 37)
    planes = {}
    for v, w in zip(values, weights):
        for b in range(20):
            planes.setdefault(int(w) + b, []).append(bitmap((v >> b & 1).astype(bool)[None]))
    slices = add_slices(planes, 3)
    total = np.zeros(130, np.int64)
    for w, s in enumerate(slices):
        total[members(s)] += 1 << w
    assert (total == (values << weights[:, None]).sum(axis=0)).all()


def test_a_block_selects_like_a_sort():
    rnd = np.random.default_rng(8)
    for rows in (1, 63, 64, 65, 500):
        x = rnd.integers(-9, 9, (rows, 5))
        q = rnd.integers(-9, 9, 5)
        block = SlicedBlock.build(x.astype(np.int64))
        for k in (1, 5, 20):
            for without in (None, rows // 2):
                at, score = block.top(q.astype(np.int64), k, without)
                want = sorted((-s, i) for i, s in enumerate((x @ q).tolist()) if i != without)[:k]
                assert [(-s, i) for i, s in zip(at.tolist(), score.tolist())] == want
