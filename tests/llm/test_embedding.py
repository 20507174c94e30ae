import numpy as np
import pytest

from hitfeed.llm import embedding_itq as itq
from hitfeed.llm.embedding_itq import HalfTables, embedding_components, fit_codes, index_shape, sign_codes


def brute(ids, x, threshold=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= threshold
    np.fill_diagonal(link, False)
    label = np.array(ids)
    while True:
        new = np.array([min([label[i], *label[link[i]]]) for i in range(len(ids))])
        if (new == label).all():
            return {i: (int(n), int(c), i == c) for i, n, c in zip(ids, link.sum(1), label)}, link
        label = new


def clusters(rng, n, dim, spread):
    centres = rng.standard_normal((n // 6, dim))
    x = np.repeat(centres, 6, axis=0)
    return x + spread * rng.standard_normal(x.shape) * rng.random((len(x), 1))


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, component_id int")


@pytest.mark.parametrize("block", [1024, 7])
def test_links_equal_brute_force(spark, block):
    rng = np.random.default_rng(1)
    x = clusters(rng, 300, 64, 0.2).astype(np.float32)
    x[:40] = x[0] + 0.01 * rng.standard_normal((40, 64)).astype(np.float32)  # a large group
    ids = rng.permutation(len(x)).tolist()
    rows = [(i, v.tolist()) for i, v in zip(ids, x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 64), (1003, [float("nan")] + [1.0] * 63), (1004, [None] + [1.0] * 63),
           (1005, [float("inf")] * 64), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (None, x[0].tolist())]
    got = {r[0]: tuple(r)[1:] for r in embedding_components(frame(spark, rows + odd + rows[:5]), block=block).collect()}
    want, _ = brute(ids, x.astype(np.float64))
    want |= {i: (0, i, True) for i in range(1000, 1006)} | {1006: (1, 1006, True), 1007: (1, 1006, False), None: (0, None, True)}
    assert got == want


def test_recall_near_the_threshold():
    """Pairs of cosine 0.9 and a little above, in the tables of the registered parameters."""
    rng = np.random.default_rng(2)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    mean, planes = fit_codes(np.vstack([a, b]), 2)
    t = HalfTables(2, 16)
    for cos, least in ((0.9, 0.9), (0.95, 0.98), (0.98, 0.999)):
        c = cos * a + np.sqrt(1 - cos * cos) * b
        x, y = sign_codes(a, mean, planes), sign_codes(c, mean, planes)
        met = ~t.first_meeting(x, y, len(t.tables))
        assert met.mean() >= least, (cos, met.mean())


def test_codes_are_balanced():
    rng = np.random.default_rng(3)
    x = clusters(rng, 3000, 48, 0.5)
    mean, planes = fit_codes(x, 1)
    code = sign_codes(x / np.linalg.norm(x, axis=1, keepdims=True), mean, planes)
    ones = np.unpackbits(code.astype(">u8").view(np.uint8).reshape(len(x), -1), axis=1).mean(axis=0)
    assert code.shape == (len(x), 1) and (abs(ones - 0.5) < 0.15).mean() > 0.9


def test_table_without_vectors(spark):
    df = frame(spark, [(1, None), (2, [0.0, 0.0])])
    assert sorted(map(tuple, embedding_components(df).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert embedding_components(df.limit(0)).count() == 0


def pairs_at(cos, a, rng):
    b = rng.standard_normal(a.shape) * a.std(axis=0)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return cos * a + np.sqrt(1 - cos * cos) * b


@pytest.mark.parametrize("vectors", [10 ** 5, 10 ** 6, 10 ** 7])
def test_recall_on_anisotropic_vectors(vectors):
    """Components of very different spread, and the tables that an index of that many vectors has."""
    rng = np.random.default_rng(4)
    a = rng.standard_normal((2000, 96)) * (1 + np.arange(96)) ** -0.7
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    rotations, bits = index_shape(vectors, 0.9)
    mean, planes = fit_codes(a, rotations)
    t = HalfTables(rotations, bits)
    assert vectors / 2 ** t.half <= itq.BUCKET_ROWS  # rows of a bucket, however many vectors
    for cos, least in ((0.9, 0.9), (0.95, 0.97)):
        x, y = sign_codes(a, mean, planes), sign_codes(pairs_at(cos, a, rng), mean, planes)
        met = ~t.first_meeting(x, y, len(t.tables)) & (np.bitwise_count(x ^ y).sum(axis=1) <= itq.FAR * 64 * rotations)
        assert met.mean() >= least, (cos, met.mean())


def test_only_vectors_with_a_candidate_are_fetched(spark):
    """Few of many unrelated vectors go on to the comparison; buckets keep their size as the table grows."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((6000, 64)).astype(np.float32)
    x[1] = x[0] + 0.01
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    one = itq.different(itq.vectors(df))
    tables = HalfTables(2, 16)
    coded = itq.vector_codes(one, *fit_codes(itq.learning_sample(one, 2000), 2))
    keyed = itq.keyed_codes(coded, tables)
    assert "vec" not in keyed.columns and keyed.count() == 16 * 6000
    none = spark.createDataFrame([], "t int, dim int, bits long, n_blocks int")
    met = itq.cells_with_candidates(itq.block_cells(keyed, itq.KEYS, none, itq.F.xxhash64("vec_id"), 1024), tables)
    ids = [r["vec_id"] for r in met.select("vec_id").collect()]
    assert {0, 1} <= set(ids) and len(ids) < 600


def test_equal_vectors_are_one_with_their_number(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((40, 32)).astype(np.float32)
    rows = [(i, x[i % 40 if i % 3 else 0].tolist()) for i in range(3000)] + [(5000, (x[0] * 1.001).tolist())]
    assert itq.different(itq.vectors(frame(spark, rows))).count() == 41
    got = {r[0]: tuple(r)[1:] for r in embedding_components(frame(spark, rows)).collect()}
    want, _ = brute([i for i, _ in rows], np.array([v for _, v in rows], np.float64))
    assert got == want


def test_index_shape_grows_with_the_vectors():
    shapes = [index_shape(n, 0.9) for n in (10, 10 ** 5, 10 ** 6, 10 ** 7, 10 ** 8)]
    assert shapes[0] == shapes[1] == (2, 16) and [b for _, b in shapes] == sorted(b for _, b in shapes)
    assert index_shape(10, 1.0)[0] == 2
