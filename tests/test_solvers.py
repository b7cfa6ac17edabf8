import math

import numpy as np
import pytest

from plover.functions import reducers, solvers, tdist


def problem(n=120, p=15, t=1, seed=0):
    r = np.random.RandomState(seed)
    x = r.normal(size=(n, p))
    b = np.zeros((p, t))
    b[:3] = r.normal(size=(3, t)) * 2
    y = x @ b + r.normal(size=(n, t))
    z = (x - x.mean(0)) / x.std(0)
    yc = y - y.mean(0)
    return z.T @ z / n, z.T @ yc / n, z, yc


@pytest.mark.parametrize("alpha,rho", [(0.01, 0.5), (0.3, 0.9), (1.0, 0.1), (0.1, 1.0)])
def test_elastic_net_is_optimal(alpha, rho):
    g, c, *_ = problem()
    b, ok = solvers.enet_gram(g, c[:, 0], alpha, rho)
    assert ok and solvers.kkt_residual(g, c[:, 0], b, alpha, rho) < 1e-8


def test_multi_task_shares_support_and_is_optimal():
    g, c, *_ = problem(t=3)
    a, rho = 0.2, 0.8
    b, ok = solvers.enet_gram(g, c, a, rho)
    assert ok and 0 < (b != 0).any(1).sum() < len(b)
    assert ((b != 0).any(1) == (b != 0).all(1)).all()
    r = c - g @ b - a * (1 - rho) * b
    n = np.linalg.norm(b, axis=1)
    on = n > 0
    assert np.allclose(r[on], a * rho * b[on] / n[on, None], atol=1e-8)
    assert (np.linalg.norm(r[~on], axis=1) <= a * rho + 1e-8).all()


@pytest.mark.parametrize("p,t,n", [(1, 1, 50), (15, 1, 50), (15, 3, 50), (6, 2, 5), (6, 2, 3), (6, 1, 5)])
@pytest.mark.parametrize("begin", [None, 0.1])
def test_a_stack_of_problems_is_solved_as_one_by_one(p, t, n, begin):
    made = [problem(n=60, p=p, t=t, seed=i) for i in range(n)] if p >= 3 else [problem(n=60, p=3, t=t, seed=i) for i in range(n)]
    g, c = np.stack([m[0][:p, :p] for m in made]), np.stack([m[1][:p, 0] if t == 1 else m[1][:p] for m in made])
    start = None if begin is None else np.full(c.shape[1:], begin)
    for alpha, rho, most in ((0.05, 0.5, 10_000), (0.6, 0.9, 10_000), (0.05, 0.5, 3)):
        b, ok = solvers.enet_gram(g, c, alpha, rho, max_iter=most, start=start)
        want = [solvers.enet_gram(x, y, alpha, rho, max_iter=most, start=start) for x, y in zip(g, c, strict=True)]
        assert ok.tolist() == [w[1] for w in want]
        assert np.allclose(b, np.stack([w[0] for w in want]), rtol=0, atol=1e-13)


@pytest.mark.parametrize("t", [1, 2])
def test_a_stack_of_moments_gives_a_stack_of_models(t):
    from plover.plans.moments import solve, squared_errors

    r = np.random.RandomState(3)
    a = np.concatenate([np.ones((40, 30, 1)), r.normal(size=(40, 30, 5 + t)) + 2], axis=2)
    w = r.uniform(0.5, 2, size=(40, 30, 1))
    a[3, :, 2] = 7.0  # a constant column
    plain, weighted, params = np.swapaxes(a, 1, 2) @ a, np.swapaxes(a * w, 1, 2) @ a, {"alpha_or_c": 0.1, "l1_ratio": 0.5, "penalty_weight": 0.3}
    many = solve(plain, weighted, t, 1, params)
    for i in range(40):
        one = solve(plain[i], weighted[i], t, 1, params)
        for f in ("mean", "scale", "coef", "intercept", "converged"):
            assert np.allclose(getattr(many, f)[i], getattr(one, f), rtol=0, atol=1e-12)
        assert np.allclose(squared_errors(plain, many)[i], squared_errors(plain[i], one), rtol=1e-10)


@pytest.mark.parametrize("k", [2, 3])
def test_logistic_is_optimal(k):
    r = np.random.RandomState(1)
    x = r.normal(size=(150, 6))
    y = np.argmax(x[:, :k] + r.normal(size=(150, k)), axis=1)
    w = r.uniform(0.5, 2, size=150)
    c, rho = 0.5, 0.6
    b, b0, ok = solvers.logistic_enet(x, y, k, c, rho, w, max_iter=50_000, tol=1e-10)
    assert ok
    z = x @ b.T + b0
    if k == 2:
        g = c * ((1 / (1 + np.exp(-z)) - (y == 1)[:, None]) * w[:, None]).T @ x
    else:
        g = c * ((solvers.softmax(z) - np.eye(k)[y]) * w[:, None]).T @ x
    g = g + (1 - rho) * b
    assert np.allclose(g[b != 0], -rho * np.sign(b[b != 0]), atol=1e-5)
    assert (np.abs(g[b == 0]) <= rho + 1e-5).all()


def test_t_distribution_against_tables():
    for df, q in ((1, 12.706204736), (4, 2.776445105), (9, 2.262157163), (30, 2.042272456)):
        assert math.isclose(tdist.t_quantile(0.975, df), q, rel_tol=1e-8)
        assert math.isclose(tdist.t_two_sided(q, df), 0.05, rel_tol=1e-7)
    assert tdist.t_two_sided(0.0, 5) == 1.0 and tdist.t_two_sided(math.inf, 5) == 0.0 and math.isnan(tdist.t_two_sided(math.nan, 5))


def test_first_component_is_the_correlation_matrix_s_eigenvector():
    x = np.random.RandomState(2).normal(size=(50, 5)) @ np.random.RandomState(3).normal(size=(5, 5))
    v = solvers.first_component(x)
    w = np.linalg.eigh(np.corrcoef(x.T))[1][:, -1]
    assert np.allclose(np.abs(v), np.abs(w)) and v[np.argmax(np.abs(v))] > 0
    wide = np.random.RandomState(4).normal(size=(10, 30))
    z = (wide - wide.mean(0)) / wide.std(0)
    u = np.linalg.svd(z, full_matrices=False)[2][0]
    assert np.allclose(np.abs(solvers.first_component(wide)), np.abs(u))


def test_density_clusters_of_planted_groups():
    r = np.random.RandomState(5)
    base = r.normal(size=(200, 3))
    x = np.column_stack([base[:, [i]] + 0.2 * r.normal(size=(200, 6)) for i in range(3)] + [r.normal(size=(200, 4))])
    label = solvers.hdbscan(solvers.distance_matrix(x, "pearson"), 3)
    groups = [set(label[i * 6 : i * 6 + 6].tolist()) for i in range(3)]
    assert all(len(g) == 1 and -1 not in g for g in groups) and len(set.union(*groups)) == 3
    assert (solvers.hdbscan(np.ones((2, 2)), 3) == -1).all()


def test_ica_finds_sources_and_backprojection_is_linear():
    r = np.random.RandomState(6)
    s = r.uniform(-1, 1, size=(2000, 3)) ** 3
    x = s @ r.normal(size=(3, 8))
    m, unmix, mix = solvers.fast_ica(x, 3)
    got = (x - m) @ unmix.T
    c = np.abs(np.corrcoef(got.T, s.T)[:3, 3:])
    assert (c.max(1) > 0.99).all() and np.allclose(got.std(0), 1) and np.allclose(got @ mix.T + m, x, atol=1e-6)
    red = reducers.ICA([f"f{i}" for i in range(8)], np.zeros(8), np.ones(8), m, unmix, mix)
    a, b = r.normal(size=(1, 3)), r.normal(size=(1, 3))
    assert np.allclose(red.backproject(a + 2 * b), red.backproject(a) + 2 * red.backproject(b))


def test_parallel_analysis_counts_planted_components():
    r = np.random.RandomState(7)
    x = r.normal(size=(300, 4)) @ (3 * r.normal(size=(4, 20))) + r.normal(size=(300, 20))
    assert solvers.parallel_analysis(x, 30, standardize=True) == 4
    assert solvers.parallel_analysis(x[:, :1]) == 1
    assert 1 <= solvers.parallel_analysis(r.normal(size=(10, 40)), 20, standardize=True) <= 3


def test_distances():
    assert solvers.distance_matrix(np.ones((5, 1))).tolist() == [[0.0]]
    x = np.column_stack([np.arange(9.0), -np.arange(9.0), np.ones(9)])
    d = solvers.distance_matrix(x, "spearman")
    assert np.allclose(d[0, 1], 0, atol=1e-6) and np.allclose(d[0, 2], math.sqrt(2))
    assert np.allclose(solvers.distance_matrix(x, "spearman", signed=True)[0, 1], 2)
    assert reducers.auto_size(2, 1000) == 3


def test_average_ranks():
    assert solvers.rank_average(np.array([3.0, 1.0, 3.0, 2.0])).tolist() == [3.5, 1.0, 3.5, 2.0]
