"""Array kernels for steps that are sequential within one small grid or tile.

All solve A u = f with A = -Laplacian + shift, boundary values held. Arrays are [i, j].
"""

from __future__ import annotations

import numpy as np

from ..grid import Grid


def apply(u: np.ndarray, g: Grid, shift: float = 0.0) -> np.ndarray:
    out = np.zeros_like(u)
    c = u[1:-1, 1:-1]
    out[1:-1, 1:-1] = c * (g.diagonal + shift) - ((u[2:, 1:-1] + u[:-2, 1:-1]) * g.cx + (u[1:-1, 2:] + u[1:-1, :-2]) * g.cy)
    return out


def residual(u, f, g: Grid, shift=0.0):
    out = f - apply(u, g, shift)
    out[0], out[-1], out[:, 0], out[:, -1] = 0, 0, 0, 0
    return out


def norm(r: np.ndarray, g: Grid) -> float:
    return float(np.sqrt(g.hx * g.hy * np.sum(r.astype(np.float64) ** 2)))


def jacobi(u, f, g: Grid, omega=0.8, shift=0.0):
    u = u.copy()
    near = (u[2:, 1:-1] + u[:-2, 1:-1]) * g.cx + (u[1:-1, 2:] + u[1:-1, :-2]) * g.cy
    u[1:-1, 1:-1] = (1 - omega) * u[1:-1, 1:-1] + omega * (f[1:-1, 1:-1] + near) / (g.diagonal + shift)
    return u


def red_black(u, f, g: Grid, omega=1.0, shift=0.0):
    u = u.copy()
    i, j = np.indices(u.shape)
    inner = (i > 0) & (i < g.nx - 1) & (j > 0) & (j < g.ny - 1)
    for colour in (0, 1):
        near = np.zeros_like(u)
        near[1:-1, 1:-1] = (u[2:, 1:-1] + u[:-2, 1:-1]) * g.cx + (u[1:-1, 2:] + u[1:-1, :-2]) * g.cy
        at = inner & ((i + j) % 2 == colour)
        u[at] = (1 - omega) * u[at] + omega * (f[at] + near[at]) / (g.diagonal + shift)
    return u


def gauss_seidel(u, f, g: Grid, omega=1.0, shift=0.0, backward=False):
    """Lexicographic, i outer, along anti-diagonals: points of one diagonal do not touch each other."""
    u = u.copy()
    sums = range(2, g.nx + g.ny - 3)
    for s in reversed(sums) if backward else sums:
        i = np.arange(max(1, s - (g.ny - 2)), min(g.nx - 2, s - 1) + 1)
        j = s - i
        near = (u[i + 1, j] + u[i - 1, j]) * g.cx + (u[i, j + 1] + u[i, j - 1]) * g.cy
        u[i, j] = (1 - omega) * u[i, j] + omega * (f[i, j] + near) / (g.diagonal + shift)
    return u


def symmetric(u, f, g: Grid, omega=1.0, shift=0.0):
    return gauss_seidel(gauss_seidel(u, f, g, omega, shift), f, g, omega, shift, backward=True)


def optimal_sor(g: Grid) -> float:
    return 2.0 / (1.0 + np.sin(np.pi * g.h / max(g.x1 - g.x0, g.y1 - g.y0)))


#: Weight of Jacobi's smoother for the 5-point Laplacian. 2 / (1 + sqrt(1 - rho^2)), often given as optimal, is that of
#: over-relaxation; with Jacobi it diverges once rho exceeds sqrt(1/2).
JACOBI_WEIGHT = 4.0 / 5.0


def spectral_radius(g: Grid) -> float:
    """Of Jacobi's iteration."""
    return float(np.cos(np.pi / (g.nx - 1)) * np.cos(np.pi / (g.ny - 1)))


SMOOTHERS = {"jacobi": jacobi, "weighted_jacobi": lambda u, f, g, omega=JACOBI_WEIGHT, shift=0.0: jacobi(u, f, g, omega, shift), "red_black": red_black, "gauss_seidel": gauss_seidel, "symmetric": symmetric, "sor": lambda u, f, g, omega=None, shift=0.0: gauss_seidel(u, f, g, omega or optimal_sor(g), shift)}


def restrict(r: np.ndarray) -> np.ndarray:
    """Full weighting inside, zero on the boundary."""
    out = np.zeros(((r.shape[0] - 1) // 2 + 1, (r.shape[1] - 1) // 2 + 1), r.dtype)
    c = r[2:-1:2, 2:-1:2]
    edges = r[3::2, 2:-1:2] + r[1:-2:2, 2:-1:2] + r[2:-1:2, 3::2] + r[2:-1:2, 1:-2:2]
    corners = r[3::2, 3::2] + r[3::2, 1:-2:2] + r[1:-2:2, 3::2] + r[1:-2:2, 1:-2:2]
    out[1:-1, 1:-1] = c * 0.25 + edges * 0.125 + corners * 0.0625
    return out


def prolong(c: np.ndarray) -> np.ndarray:
    out = np.zeros((2 * (c.shape[0] - 1) + 1, 2 * (c.shape[1] - 1) + 1), c.dtype)
    out[::2, ::2] = c
    out[1::2, ::2] = (c[1:] + c[:-1]) * 0.5
    out[:, 1::2] = (out[:, 2::2] + out[:, :-2:2]) * 0.5
    return out


def solve_coarse(u, f, g: Grid, shift=0.0, tolerance=1e-12, most=1000):
    for _ in range(most):
        u = gauss_seidel(u, f, g, 1.0, shift)
        if norm(residual(u, f, g, shift), g) < tolerance:
            break
    return u


def calls(kind: str, levels: int) -> list[str]:
    """The kinds of the cycles that a cycle runs one level below; ``levels`` counts from its own down.

    An F cycle runs 2^(levels - 2) F cycles below, so its work multiplies with every level; FV, once F and
    once V, costs little more than a V cycle and suits deep hierarchies.
    """
    return {"V": ["V"], "W": ["W", "W"], "F": ["F"] * max(1, 2 ** (levels - 2)), "FV": ["FV", "V"]}[kind]


def cycle(u, f, levels: list[Grid], kind="V", before=2, after=2, smoother="red_black", shift=0.0, level=0, precision=None):
    """One V, W, F or FV cycle."""
    g, smooth = levels[level], SMOOTHERS[smoother]
    if level == len(levels) - 1:
        return solve_coarse(u, f, g, shift)
    kind_of = np.dtype(precision(level)) if precision else u.dtype
    u, f = u.astype(kind_of), f.astype(kind_of)
    for _ in range(before):
        u = smooth(u, f, g, shift=shift)
    coarse = restrict(residual(u, f, g, shift))
    e = np.zeros_like(coarse)
    for k in calls(kind, len(levels) - level):
        e = cycle(e, coarse, levels, k, before, after, smoother, shift, level + 1, precision)
    u = u + prolong(e).astype(kind_of)
    for _ in range(after):
        u = smooth(u, f, g, shift=shift)
    return u


def full_multigrid(f, levels: list[Grid], boundary=None, cycles=1, **kw):
    """Right sides restricted down, solved on the coarsest, prolonged up with cycles at each level."""
    rights, edges = [f], [np.zeros_like(f) if boundary is None else boundary]
    for _ in levels[1:]:
        r = restrict(rights[-1])
        r[0], r[-1], r[:, 0], r[:, -1] = rights[-1][0, ::2], rights[-1][-1, ::2], rights[-1][::2, 0], rights[-1][::2, -1]
        rights.append(r)
        edges.append(edges[-1][::2, ::2])
    held = lambda u, e: np.block([[e[:1]], [np.hstack([e[1:-1, :1], u[1:-1, 1:-1], e[1:-1, -1:]])], [e[-1:]]])
    u = solve_coarse(held(np.zeros_like(edges[-1]), edges[-1]), rights[-1], levels[-1])
    for level in range(len(levels) - 2, -1, -1):
        u = held(prolong(u), edges[level])
        for _ in range(cycles):
            u = cycle(u, rights[level], levels[level:], **kw)
    return u


def ilu0(g: Grid, shift=0.0, modified=0.0, drop=0.0):
    """Incomplete factors of A on inner points without fill: the pivots.

    Couplings whose factor is below ``drop`` are left out, here and in ilu_apply.
    """
    n, m = g.nx - 2, g.ny - 2
    pivot = np.zeros((n, m))
    for i in range(n):
        for j in range(m):
            d = g.diagonal + shift + modified
            if i and g.cx / pivot[i - 1, j] >= drop:
                d -= g.cx * g.cx / pivot[i - 1, j]
            if j and g.cy / pivot[i, j - 1] >= drop:
                d -= g.cy * g.cy / pivot[i, j - 1]
            pivot[i, j] = d
    return pivot


def ilu_apply(r: np.ndarray, g: Grid, pivot: np.ndarray, drop=0.0) -> np.ndarray:
    """z with L U z = r on inner points; the boundary is passed through."""
    z = r.copy()
    n, m = pivot.shape
    cx, cy = np.where(g.cx / pivot >= drop, g.cx, 0.0), np.where(g.cy / pivot >= drop, g.cy, 0.0)  # by the earlier point
    y = np.zeros((n + 1, m + 1))
    for i in range(n):
        for j in range(m):
            y[i, j] = (r[i + 1, j + 1] + (cx[i - 1, j] * y[i - 1, j] if i else 0) + (cy[i, j - 1] * y[i, j - 1] if j else 0)) / pivot[i, j]
    x = np.zeros((n + 1, m + 1))
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            x[i, j] = y[i, j] + (cx[i, j] * x[i + 1, j] + cy[i, j] * x[i, j + 1]) / pivot[i, j]
    z[1:-1, 1:-1] = x[:n, :m]
    return z


def lines(r: np.ndarray, g: Grid, axis: str = "x", shift=0.0) -> np.ndarray:
    """Block-diagonal inverse: a tridiagonal solve along each line, boundary passed through."""
    rr = r if axis == "x" else r.T
    off = g.cx if axis == "x" else g.cy
    n = rr.shape[0] - 2
    c, d = np.zeros(n), np.zeros((n, rr.shape[1] - 2))
    for k in range(n):
        denominator = g.diagonal + shift - (off * c[k - 1] if k else 0)
        c[k] = off / denominator
        d[k] = (rr[k + 1, 1:-1] + (off * d[k - 1] if k else 0)) / denominator
    z = rr.copy()
    z[n, 1:-1] = d[-1]
    for k in range(n - 2, -1, -1):
        z[k + 1, 1:-1] = d[k] + c[k] * z[k + 2, 1:-1]
    return z if axis == "x" else z.T


def conjugate_gradients(u, f, g: Grid, precondition=None, tolerance=1e-10, most=500, shift=0.0):
    """(solution, residual norms); precondition maps a residual to a correction."""
    r = residual(u, f, g, shift)
    z = precondition(r) if precondition else r
    z[0], z[-1], z[:, 0], z[:, -1] = 0, 0, 0, 0
    p, rz, history = z.copy(), float((r * z).sum()), [norm(r, g)]
    while history[-1] >= tolerance and len(history) <= most and rz:
        q = apply(p, g, shift)
        step = rz / float((p * q).sum())
        u, r = u + step * p, r - step * q
        history.append(norm(r, g))
        z = (precondition(r) if precondition else r).copy()
        z[0], z[-1], z[:, 0], z[:, -1] = 0, 0, 0, 0
        new = float((r * z).sum())
        p, rz = z + new / rz * p, new
    return u, history
