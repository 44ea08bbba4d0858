"""Windows of many samples: covariance that is never formed, and clusters on a line."""

import itertools

import numpy as np

from snpweave.operators import models


def test_product_with_the_pairwise_covariance():
    rng = np.random.default_rng(2)
    for n, m, gone in ((60, 10, 0.3), (40, 5, 0.7), (7, 3, 0.0), (50, 90, 0.2)):
        x = rng.integers(0, 3, (n, m)).astype(float)
        x[rng.random(x.shape) < gone] = np.nan
        q = rng.normal(size=(n, 4))
        want = models.pair_covariance(x) @ q
        for cells in (1, 1 << 22):
            assert np.allclose(models.covariance_times(x, cells)(q), want, atol=1e-11)


def test_many_samples_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (20_000, 10)).astype(float)
    x[rng.random(x.shape) < 0.1] = np.nan
    tracemalloc.start()
    models.window_axes(x, 2)
    assert tracemalloc.get_traced_memory()[1] < 400e6  # the covariance alone is 3200 MB
    tracemalloc.stop()


def test_best_clusters():
    rng = np.random.default_rng(4)
    for _ in range(20):
        x = np.round(rng.normal(size=9), 2)
        v = np.sort(x)
        cost = lambda parts: sum(((p - p.mean()) ** 2).sum() for p in parts)
        best = min(cost(np.split(v, c)) for c in itertools.combinations(range(1, 9), 2))
        own = models.kmeans_line(x, 3)
        assert abs(cost([x[own == c] for c in range(3)]) - best) < 1e-9
