import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlake.llm import centroids


def plain(rows, k, rounds, dim, scale=1024, seed="3"):
    """Full search in Python integers."""
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v], v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), i, np.array(v, "<f8").tobytes(), x) for i, x, v in kept if i is not None)[:k]
    at = [x for *_, x in first]
    if not at:
        return []

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(at))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x, _ in kept]
        for c in range(len(at)):
            some = [x for (_, x, _), o in zip(kept, own) if o == c]
            if some:
                at[c] = [sum(col) // len(some) for col in zip(*some)]
    last = [nearest(x) for _, x, _ in kept]
    most = (1 << 63) - 1
    of = [sum(d for d, c in last if c == n) for n in range(len(at))]
    key = lambda r: (r[0] is not None, r)
    return sorted(((i, c, min(d, most), min(of[c], most), min(sum(of), most), ",".join(map(str, at[c]))) for (i, _, _), (d, c) in zip(kept, last)), key=key)


def found(df, **options):
    rows = centroids.cluster(df, **options).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid").collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r))


def test_odd_vectors_equal_full_search(spark):
    r = random.Random(4)
    rows = [(i, [float(r.randint(-3, 3)) for _ in range(3)]) for i in range(60)]  # many ties and equal vectors
    rows += rows[:5] + [(None, [1.0, 2.0, 3.0]), (70, None), (71, [1.0, None, 2.0]), (72, [1.0, math.nan, 0.0]), (73, [math.inf, 0.0, 0.0]), (74, [1.0, 2.0]), (75, []), (3, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("cluster", "id", "key", "n")})
    assert found(df, k=8, rounds=10, dim=3) == plain(rows, 8, 10, 3)
    assert found(df, k=200, rounds=2, dim=3) == plain(rows, 200, 2, 3)
    assert found(df, k=1, rounds=3, dim=3) == plain(rows, 1, 3, 3)


def test_components_of_any_size_are_exact(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([1e300, -1e300, 1.7e308, 5e-324, -5e-324, 3.7e15, 2.0**40 + 0.3, r.random()]) for _ in range(4)]) for i in range(30)] + [(40 + i, [r.random() * 9 for _ in range(4)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, k=5, rounds=4, dim=4) == plain(rows, 5, 4, 4)


def test_tables_without_vectors(spark):
    for rows in ([], [(1, None)], [(None, [1.0, 2.0])]):
        assert found(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), dim=2) == []
    with pytest.raises(ValueError):
        centroids.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>"), k=1 << 20)


def test_the_search_measures_few_centroids(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(i, list(map(float, v))) for i, v in df.select("vec_id", "embedding").limit(300).collect()]
    lists = centroids.Lists([[math.floor(x * 1024) for x in v] for _, v in rows[:100]])
    x = np.array([[math.floor(a * 1024) for a in v] for _, v in rows], np.int64)
    best, far, measured = lists.nearest(x)
    full = ((x[:, None, :] - lists.at[None, :, :]) ** 2).sum(2)
    assert (best == full.argmin(1)).all() and (far == full.min(1)).all() and (measured <= 100).all() and (measured[:100] < 100).any()


def test_query_on_a_whole_table(spark):
    from tenderlake.llm.queries import op12_centroid_clusters

    sf = "/root/testdata/sf0.001"
    rows = [(r[0], None if r[1] is None else list(r[1])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    out = op12_centroid_clusters(spark, sf)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, out.collect())) == [(*r[:5], hashlib.sha256(r[5].encode()).hexdigest()) for r in plain(rows, 8, 10, 64)]
