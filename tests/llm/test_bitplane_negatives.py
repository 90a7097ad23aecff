"""Hard negatives by bit-planes, against plain inner products."""

import math
import random

import numpy as np
import pytest

from cairnspark.llm import bitplane_negatives as b
from cairnspark.llm import queries

DDL = "vec_id bigint, embedding array<float>, label int, row string, v string"


def _mined(rows: list) -> list[tuple]:
    """Every anchor against every row, one by one."""
    taken = []
    for i, vec, label, *_ in rows:
        if None in (i, vec, label) or any(x is None or not math.isfinite(x) for x in vec):
            continue
        v = [math.floor(256 * x) for x in vec]
        if len(v) * sum(x * x for x in v) < 1 << 60:
            taken.append((i, int(math.fmod(label + 1, 10)) if i % 7 == 0 else label, v))
    out = []
    for n, (i, label, v) in enumerate(taken):
        if i % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, other) for m, (j, other, w) in enumerate(taken) if m != n]
        far = sorted(s for s in scored if s[2] != label)
        for p, j, _ in sorted(s for s in scored if s[2] == label)[:5]:
            inside = [s for s in far if 50 * -p <= 100 * -s[0] <= 95 * -p]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k, _) in enumerate(inside[:3], 1)]
    return sorted(out)


def _vectors(seed: int, n: int, width: int = 8, scale: float = 1.0) -> list[tuple]:
    r = random.Random(seed)
    return [(i * r.choice((1, 5, 10)), [float(np.float32(r.gauss(0, scale))) for _ in range(width)], r.randrange(3), "a", "b") for i in range(n)]


@pytest.fixture(scope="module")
def odd_vectors():
    same = [0.5, -0.25, 0.125]
    rows = [(50 * (i % 4), same, i % 3, None, None) for i in range(40)]  # ties, repeated ids and rows
    rows += [(None, same, 1, "x", "y"), (100, None, 1, "x", "y"), (150, same, None, "x", "y"), (200, [0.1, None, 0.2], 1, "x", "y"), (250, [float("nan")], 1, "x", "y")]
    rows += [(300, [float("inf"), 1.0], 1, "x", "y"), (350, [], 1, "x", "y"), (400, [1e30, 0.0], 1, "x", "y"), (450, [3000.0, -2.5], 2, "x", "y"), (-50, [2.0, 1.0, 0.5, 7.0], -4, "x", "y")]
    return rows


def _got(spark, rows: list, **more) -> list[tuple]:
    return sorted(map(tuple, b.hard_negatives(spark.createDataFrame(rows, DDL), **more).collect()))


@pytest.mark.parametrize("group_rows", [b.GROUP_ROWS, 20])
def test_rows_are_those_of_plain_products(spark, odd_vectors, group_rows):
    for rows in (_vectors(1, 300), _vectors(2, 200, 40, 0.2), odd_vectors):
        assert _got(spark, rows, group_rows=group_rows) == _mined(rows)


def test_very_large_and_very_small_components(spark):
    for scale in (1e-4, 30_000.0):
        rows = _vectors(3, 120, 5, scale)
        assert _got(spark, rows) == _mined(rows)


def test_planes_drop_most_pairs_before_the_last():
    r = np.random.default_rng(4)
    v, anchors = (r.normal(0, 32, (n, 64)).astype(np.int64) for n in (4000, 10))
    left = []
    coarse, fine = b.among_best(10, 5)

    def seen(*intervals):
        out = (coarse if len(intervals) == 2 else fine)(*intervals)
        assert (intervals[-2] <= intervals[-1]).all()
        left.append(np.count_nonzero(out))
        return out

    i, j, score = b.scores_left(b.Planes(v), anchors, slice(1000, 4000), None, seen, seen)
    exact = anchors @ v.T
    assert (score == exact[i, j]).all() and left == sorted(left, reverse=True) and left[-3] < 1500
    assert all(set(np.argsort(-exact[k, 1000:])[:5] + 1000) <= set(j[i == k]) for k in range(10))


def test_empty_table(spark):
    assert _got(spark, []) == []


def test_query_has_the_rows_of_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = queries.QUERIES["op13_bitplane_negatives"](spark, sf_dir).toArrow()
    want = con.sql(queries.ORACLE["op13_bitplane_negatives"]).to_arrow_table()
    names = want.column_names
    assert got.num_rows > 50 and sorted(tuple(r[c] for c in names) for r in got.to_pylist()) == sorted(tuple(r[c] for c in names) for r in want.to_pylist())
