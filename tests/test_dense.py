import numpy as np
import pytest

from eigenfold import dense

rng = np.random.default_rng(0)
A = rng.standard_normal((9, 9))
SPD = A @ A.T + np.eye(9)


def test_schur_and_reorder():
    t, q = dense.schur(A)
    assert np.abs(q @ t @ q.conj().T - A).max() < 1e-12
    keep = np.abs(np.diag(t)) > 2
    t2, q2 = dense.reorder(t, q, keep)
    assert np.abs(q2 @ t2 @ q2.conj().T - A).max() < 1e-12
    assert np.allclose(np.sort(np.abs(np.diag(t2)[: keep.sum()])), np.sort(np.abs(np.diag(t)[keep])))


@pytest.mark.parametrize("method", ["schur", "db", "ns", "sadeghi"])
def test_roots(method):
    x = dense.sqrtm(SPD, method)
    assert np.abs(x @ x - SPD).max() < 1e-10
    assert np.abs(dense.invsqrtm(SPD, method) @ x - np.eye(9)).max() < 1e-10


def test_exponential_logarithm_phi():
    g = A + 12 * np.eye(9)
    assert np.abs(dense.expm(dense.logm(g)) - g).max() < 1e-9
    w, x = np.linalg.eig(A)
    assert np.abs(dense.expm(A) - (x * np.exp(w)) @ np.linalg.inv(x)).max() < 1e-10
    assert np.abs(dense.expm(A) - dense.expm(A, "pade")).max() < 1e-10
    assert np.abs(dense.phim(A, 2) @ A + np.eye(9) - dense.phim(A, 1)).max() < 1e-10


def test_generalised():
    b = rng.standard_normal((9, 9))
    b = b @ b.T + np.eye(9)
    w, x = dense.ghep(SPD, b)
    assert np.abs(SPD @ x - b @ x * w).max() < 1e-10 and np.abs(x.T @ b @ x - np.eye(9)).max() < 1e-10
    w, x = dense.gnhep(np.diag([1.0, 2.0, 3.0]), np.diag([1.0, 1.0, 0.0]))
    assert np.isinf(w).sum() == 1 and np.allclose(np.sort(w[np.isfinite(w)].real), [1, 2])


def test_gsvd_hsvd_lyapunov():
    a, b = rng.standard_normal((20, 6)), rng.standard_normal((8, 6))
    c, s, u, v, x = dense.gsvd(a, b)
    assert np.abs(a @ x - u * c).max() < 1e-12 and np.abs(b @ x - v * s).max() < 1e-12
    omega = np.where(np.arange(20) % 3 == 0, -1.0, 1.0)
    sigma, u, v, sign = dense.hsvd(a, omega)
    assert np.abs(u.T @ (omega[:, None] * u) - np.diag(sign)).max() < 1e-10
    stable, c = A - 6 * np.eye(9), rng.standard_normal((9, 2))
    x = dense.lyapunov(stable, c @ c.T)
    assert np.abs(stable @ x + x @ stable.T + c @ c.T).max() < 1e-12


@pytest.mark.parametrize("basis", dense.BASES)
def test_companion(basis):
    mats = [rng.standard_normal((4, 4)) for _ in range(4)]
    w, v = dense.polyeig(mats, basis)
    for k, z in enumerate(w):
        r = sum(p * m for p, m in zip(dense.basis_values(basis, 3, z), mats)) @ v[:, k]
        assert np.linalg.norm(r) < 1e-9 * max(1, abs(z) ** 3)


@pytest.mark.parametrize("kind", ["symmetric", "hamiltonian", "nonsymmetric"])
def test_linearisations_have_one_spectrum(kind):
    k, c, m = [(lambda z: z + z.T)(rng.standard_normal((4, 4))) for _ in range(3)]
    w, _ = dense.gnhep(*dense.symmetric_linearisations([k, c, m], kind))
    assert np.allclose(np.sort_complex(w), np.sort_complex(dense.polyeig([k, c, m])[0]), atol=1e-8)


def test_rational_approximation():
    z = np.linspace(-1, 1, 200) + 0j
    support, _, w = dense.aaa(1 / (z - 1.5), z)
    assert np.allclose(dense.aaa_poles(support, w), [1.5], atol=1e-8)
    assert dense.inertia(np.diag([-1.0, 0, 2, 3])) == (1, 1, 2)


@pytest.mark.parametrize("kind", ["real", "complex"])
def test_arrows(kind):
    rng = np.random.default_rng(8)
    n, k = 9, 6
    a = np.diag(rng.standard_normal(n)).astype(complex if kind == "complex" else float)
    a[:k, k] = rng.standard_normal(k) + (1j * rng.standard_normal(k) if kind == "complex" else 0)
    a[k, k + 1], a[k + 1, k + 2] = 1.0, 2.0
    a = np.triu(a) + np.triu(a, 1).conj().T
    t, q = dense.tridiagonalised(a)
    assert np.allclose(q @ t @ q.conj().T, a) and np.allclose(q.conj().T @ q, np.eye(n)) and np.allclose(q[-1], np.eye(n)[-1])
    b = np.triu(a)
    c, p, q = dense.bidiagonalised(b)
    assert np.allclose(p @ c @ q.conj().T, b) and np.allclose(p.conj().T @ p, np.eye(n)) and np.allclose(q.conj().T @ q, np.eye(n))
