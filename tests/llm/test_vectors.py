"""Whitening and vector codes against plain numpy, and odd rows."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from nlimorph.llm import vector_codes, vectors, whitening

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("x", T.StringType()), T.StructField("row", T.StringType())])
DROPPED = [(900, None, 1), (901, [None] + [0.5] * 31, 1), (902, [math.nan] * 32, 1), (903, [math.inf] + [0.0] * 31, 2), (904, [3e38] * 32, 2), (905, [], 2), (906, [0.5] * 3, 2)]


def made(n: int, d: int = 32, seed: int = 1) -> list[tuple]:
    """Rows with copies, negative values, null labels, null and repeated ids."""
    r = np.random.default_rng(seed)
    v = (r.normal(0, 0.3, (n, d)) * np.linspace(0.5, 2, d)).astype(np.float32).tolist()
    rows = [(k, v[k if k % 3 else 0], None if k % 7 == 0 else k % 4) for k in range(n)]
    return [*rows, (None, v[1], 3), (5, v[5], 1), (5, v[6], 1)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def integers(rows, scale, shift=0):
    return np.array([[math.floor(scale * float(c)) + shift for c in r[1]] for r in rows], dtype=np.int64)


@pytest.mark.parametrize("parallel", [1, 7])
def test_whiten(spark, parallel):
    rows = made(300)
    got = whitening.whiten(frame(spark, rows + DROPPED).repartition(parallel)).toPandas()
    x = integers(rows, 64, 1_000_000)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    covariance = ((fit * n - s) / n).T @ ((fit * n - s) / n) / n
    e, w = np.linalg.eigh(covariance)
    e, w = e[::-1], w[:, ::-1]
    want = ((x * n - s) / n) @ w[:, :16] / np.sqrt(e[:16])
    assert len(got) == 16 * len(rows) and set(got.n) == {n} and set(got.component) == set(range(1, 17))
    assert got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    assert np.allclose(sorted(got.explained.unique(), reverse=True), (e / e.sum())[:16], rtol=1e-9)
    by = got[got.vec_id.notna() & (got.vec_id != 5)].sort_values(["vec_id", "component"])
    place = [k for k, r in enumerate(rows) if r[0] is not None and r[0] != 5]
    values, want = by.whitened.to_numpy().reshape(-1, 16), want[place]
    assert np.abs(values * np.sign((values * want).sum(axis=0)) - want).max() < 1e-8
    assert (by.deviation.to_numpy().reshape(-1, 16)[:, 0] == ((x * n - s) ** 2).sum(axis=1)[place]).all()


def test_deviation_of_large_entries(spark):
    rows = [(k, [float(2**40 + k * 2**20), float(k)], 1) for k in range(5)]
    got = whitening.whiten(frame(spark, rows)).where("component = 1").toPandas().sort_values("vec_id")
    x = integers(rows, 64, 1_000_000).astype(object)
    n, s = len(x), x.sum(axis=0)
    assert got.deviation.tolist() == [v if v < 1 << 63 else None for v in ((x * n - s) ** 2).sum(axis=1).tolist()]


@pytest.mark.parametrize("rows", [[(1, [0.5, 0.5], 1)], [(1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1)], [(1, [0.5, 0.5], 1), (2, [0.5, 0.9], 1)]])
def test_whiten_without_variance(spark, rows):
    got = whitening.whiten(frame(spark, rows)).toPandas()
    assert len(got) == 2 * len(rows) and got.identity_error.max() < 1e-9
    assert got[got.component == 2].whitened.isna().all() and set(got[got.component == 2].explained) == {0.0}


def test_empty(spark):
    for rows in ([], DROPPED[:6]):
        assert whitening.whiten(frame(spark, rows)).collect() == []
        assert vector_codes.compress(frame(spark, rows)).collect() == []


def test_row_numbers_have_no_gap(spark):
    got = vectors.numbered(spark.range(1000).repartition(7), "t").collect()
    assert sorted(r.row for r in got) == list(range(1000)) and len({r.id for r in got}) == 1000


def plain_codes(rows, parts, entries, rounds):
    """All distances to all entries, in Python's integers."""
    x = integers(rows, 256).astype(object)
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % parts))).reshape(len(x), parts, -1)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, x[k].ravel().tolist()))[:entries]
    books = [[x[k, p].tolist() for k in order] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(v, books[p])[1] for v in x[:, p]]
            for k in set(own):
                mine = [v for v, o in zip(x[:, p], own, strict=True) if o == k]
                books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [[nearest(row[p], books[p]) for p in range(parts)] for row in x]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    by = {label: sum(e for e, r in zip(errors, rows, strict=True) if r[2] == label) for label in {r[2] for r in rows}}
    return sorted(("-" if r[0] is None else str(r[0]), "".join(f"{k:02x}" for _, k in f), e, by[r[2]], sha) for r, f, e in zip(rows, found, errors, strict=True))


@pytest.mark.parametrize("n, d, parts", [(150, 32, 16), (150, 10, 4), (20, 32, 16)])
def test_codes(spark, n, d, parts):
    rows = made(n, d)
    dropped = [r for r in DROPPED if r[0] != 906] + [(907, [0.1], 1)]
    got = vector_codes.compress(frame(spark, rows + dropped).repartition(5), parts=parts).collect()
    assert sorted(("-" if r[0] is None else str(r[0]), *r[1:]) for r in got) == plain_codes(rows, parts, 64, 2)


def test_codes_of_large_components(spark):
    rows = [(k, [float((-1) ** k * k * 2**m) for m in (0, 20, 22, 24)], 0) for k in range(40)]
    got = vector_codes.compress(frame(spark, rows), parts=2, entries=4).collect()
    want = [(i, code, e if e < 1 << 63 else None, None, sha) for i, code, e, _, sha in plain_codes(rows, 2, 4, 2)]
    assert sorted((str(r[0]), *r[1:]) for r in got) == want


def test_search_is_exact_and_compares_few():
    r = np.random.default_rng(2)
    book = vector_codes.Codebook(r.integers(-60, 60, (64, 4)))
    book.entries[40] = book.entries[3]  # equal entries
    book._order()
    parts = r.integers(-60, 60, (5000, 4))
    compared = []
    index, far = book.nearest(parts, compared)
    all_far = ((parts[:, None] - book.entries[None]) ** 2).sum(axis=2)
    assert (index == all_far.argmin(axis=1)).all() and (far == all_far.min(axis=1)).all()
    assert sum(compared) < 0.6 * all_far.size


def test_codes_sql(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    try:
        df = spark.read.parquet(path)
    except Exception:
        pytest.skip("tables are not here")
    with duckdb.connect() as db:
        db.execute(f"create view embeddings as select * from '{path}'")
        assert sorted(map(tuple, vector_codes.compress(df).collect())) == sorted(db.execute(vector_codes.compress_sql()).fetchall())
