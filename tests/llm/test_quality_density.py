"""The discriminant against directly written densities."""

import numpy as np

from nestegg.llm import quality as ql


def test_raw_scores_are_differences_of_gaussian_log_densities():
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(16, 16))
    x = np.concatenate([rng.normal(size=(900, 16)) @ mix, rng.normal(size=(400, 16)) * 2 + 1])
    y = np.repeat([0, 1], [900, 400])
    model = ql.fit(x, y)
    z = (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-3)
    groups = [z[y == k] for k in (0, 1)]
    own = [np.cov(g.T, bias=True) for g in groups]
    pooled = sum(len(g) * c for g, c in zip(groups, own)) / len(z)
    density = []
    for g, c in zip(groups, own):
        c = (1 - ql.SHRINK_TO_POOLED) * c + ql.SHRINK_TO_POOLED * pooled
        c = (1 - ql.SHRINK_TO_DIAGONAL) * c + ql.SHRINK_TO_DIAGONAL * np.diag(np.diag(c)) + 1e-3 * np.eye(16)
        d = z - g.mean(axis=0)
        density.append(-0.5 * np.sum(d @ np.linalg.inv(c) * d, axis=1) - 0.5 * np.linalg.slogdet(c)[1])
    want = density[1] - density[0] + np.log(400 / 900)
    assert np.allclose(model.raw(x), want, rtol=1e-8, atol=1e-8)
    assert ((model.score(x) >= 0.5) == (y == 1)).mean() > 0.95


def test_triangular_inverse():
    factor = np.linalg.cholesky(np.cov(np.random.default_rng(1).normal(size=(6, 50))))
    assert np.allclose(ql.triangular_inverse(factor) @ factor, np.eye(6))
