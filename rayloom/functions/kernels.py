"""Small numpy helpers for what columns cannot say: localisation, triangulation, fits."""

from __future__ import annotations

import numpy as np

from .cameras import BASIS
from .geodesy import A, B, E2


def terms(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    p = [np.stack([np.ones_like(v), v, v * v, v * v * v]) for v in (x, y, z)]
    return np.stack([p[0][i] * p[1][j] * p[2][k] for i, j, k in BASIS])


def project(rpc: dict, lon, lat, alt) -> np.ndarray:
    """(2, n): column and row, by one model or by a model for each point (numbers of n, coefficients of n x 20)."""
    t = terms(*((np.asarray(v, float) - rpc[f"{k}_off"]) / rpc[f"{k}_scale"] for k, v in (("lon", lon), ("lat", lat), ("alt", alt))))
    poly = lambda c: np.einsum("nk,kn->n", c, t) if np.ndim(c) == 2 else np.asarray(c) @ t
    return np.stack([poly(rpc[f"{a}_num"]) / poly(rpc[f"{a}_den"]) * rpc[f"{a}_scale"] + rpc[f"{a}_off"] for a in ("col", "row")])


def localize(rpc: dict, col, row, alt, rounds: int = 50) -> np.ndarray:
    """(2, n): longitude and latitude at an altitude, by Newton steps with a numeric Jacobian; a point is
    done when its own step is small. One model, or a model for each point, as in `project`."""
    goal, alt = np.stack([np.asarray(col, float), np.asarray(row, float)]), np.asarray(alt, float) + np.zeros(len(np.atleast_1d(col)))
    n = goal.shape[1]
    lon, lat = (np.zeros(n) + rpc[f"{k}_off"] for k in ("lon", "lat"))
    step, left = 1e-6, np.arange(n)
    for _ in range(rounds):
        m = rpc if len(left) == n else {k: np.asarray(v)[left] if np.ndim(rpc["lon_off"]) else v for k, v in rpc.items()}
        x, y, h = lon[left], lat[left], alt[left]
        f = project(m, x, y, h)
        a, b = (project(m, x + step, y, h) - f) / step, (project(m, x, y + step, h) - f) / step
        e = goal[:, left] - f
        det = a[0] * b[1] - b[0] * a[1]
        dx, dy = (e[0] * b[1] - b[0] * e[1]) / det, (a[0] * e[1] - e[0] * a[1]) / det
        lon[left], lat[left] = x + dx, y + dy
        left = left[np.maximum(np.abs(dx), np.abs(dy)) >= 1e-12]  # not a number: done too
        if not len(left):
            break
    return np.stack([lon, lat])


def ecef(lon, lat, alt) -> np.ndarray:
    p, q = np.radians(lat), np.radians(lon)
    n = A / np.sqrt(1 - E2 * np.sin(p) ** 2)
    return np.stack([(n + alt) * np.cos(p) * np.cos(q), (n + alt) * np.cos(p) * np.sin(q), (n * (1 - E2) + alt) * np.sin(p)])


def geodetic(x, y, z) -> np.ndarray:
    r = np.hypot(x, y)
    t = np.arctan2(A * z, B * r)
    lat = np.arctan2(z + (A * A - B * B) / B * np.sin(t) ** 3, r - E2 * A * np.cos(t) ** 3)
    return np.stack([np.degrees(np.arctan2(y, x)), np.degrees(lat), r / np.cos(lat) - A / np.sqrt(1 - E2 * np.sin(lat) ** 2)])


def height(a: dict, b: dict, ca, ra, cb, rb, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Altitude at which a point of image a falls nearest to its match in b, and the distance."""
    h = np.full(len(np.atleast_1d(ca)), float(a["alt_off"]))
    goal = np.stack([np.asarray(cb, float), np.asarray(rb, float)])
    for _ in range(rounds):
        p = project(b, *localize(a, ca, ra, h), h)
        d = project(b, *localize(a, ca, ra, h + 1), h + 1) - p
        s = ((goal - p) * d).sum(0) / (d * d).sum(0)
        h = h + s
        if np.abs(s).max(initial=0) < 1e-5:
            break
    return h, np.sqrt(((goal - project(b, *localize(a, ca, ra, h), h)) ** 2).sum(0))


def triangulate_matrices(p1: np.ndarray, p2: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """(n, 3) linear triangulation of matches (n, 2), all in one batch of 4 x 4 decompositions."""
    rows = [x[:, i, None] * p[2] - p[i] for p, x in ((p1, x1), (p2, x2)) for i in (0, 1)]
    m = np.stack(rows, axis=1)
    m = m / np.linalg.norm(m, axis=2, keepdims=True)
    v = np.linalg.svd(m)[2][:, -1]
    return v[:, :3] / v[:, 3:]


def camera_matrix(x3: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """3 x 4 matrix from points (n, 3) and their images (n, 2), normalised direct linear transform."""

    def normal(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = x.mean(0)
        s = np.sqrt(x.shape[1]) / np.linalg.norm(x - c, axis=1).mean()
        t = np.diag([s] * x.shape[1] + [1.0])
        t[:-1, -1] = -s * c
        return np.c_[x, np.ones(len(x))] @ t.T, t

    (a, ta), (b, tb) = normal(x3), normal(x2)
    z = np.zeros_like(a)
    m = np.r_[np.c_[a, z, -b[:, :1] * a], np.c_[z, a, -b[:, 1:2] * a]]
    p = np.linalg.inv(tb) @ np.linalg.svd(m)[2][-1].reshape(3, 4) @ ta
    return p / p[2, 3]


def fit_rpc(lon, lat, alt, col, row, ridge: float = 1e-3, rounds: int = 20, tol: float = 1e-2) -> dict:
    """A rational polynomial model from points and images: reweighted ridge regression, 39
    unknowns an axis, until no image moves by `tol` pixels."""
    data = {"lon": np.asarray(lon, float), "lat": np.asarray(lat, float), "alt": np.asarray(alt, float), "col": np.asarray(col, float), "row": np.asarray(row, float)}
    rpc = {}
    for k, v in data.items():
        rpc[f"{k}_off"] = (v.max() + v.min()) / 2
        rpc[f"{k}_scale"] = max((v.max() - v.min()) / 2, 1e-12)
    t = terms(*((data[k] - rpc[f"{k}_off"]) / rpc[f"{k}_scale"] for k in ("lon", "lat", "alt"))).T
    for a in ("col", "row"):
        y = (data[a] - rpc[f"{a}_off"]) / rpc[f"{a}_scale"]
        m = np.c_[t, -y[:, None] * t[:, 1:]]
        w, last = np.ones(len(y)), None
        for _ in range(rounds):
            mw = m * w[:, None]
            x = np.linalg.solve(mw.T @ mw + ridge**2 * np.eye(39), mw.T @ (y * w))
            rpc[f"{a}_num"], rpc[f"{a}_den"] = x[:20], np.r_[1.0, x[20:]]
            den = t @ rpc[f"{a}_den"]
            now = t @ rpc[f"{a}_num"] / den
            if last is not None and np.abs(now - last).max() * rpc[f"{a}_scale"] < tol:
                break
            w, last = 1 / den, now
    return rpc


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counterclockwise from its lowest point (by x, then y), without repetition."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(pts: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in pts:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = ring.T - ring.T.mean(axis=1, keepdims=True)
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def clip(ring: np.ndarray, by: np.ndarray) -> np.ndarray:
    """A polygon cut by a convex counterclockwise one."""
    out = [tuple(p) for p in ring]
    for a, b in zip(by, np.roll(by, -1, axis=0), strict=True):
        side = lambda p, a=a, b=b: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        kept: list[tuple] = []
        for p, q in zip(out[-1:] + out[:-1], out, strict=True):
            sp, sq = side(p), side(q)
            if (sp >= 0) != (sq >= 0):
                u = sp / (sp - sq)
                kept.append((p[0] + u * (q[0] - p[0]), p[1] + u * (q[1] - p[1])))
            if sq >= 0:
                kept.append(q)
        out = kept
    return np.array(out).reshape(-1, 2)


def decompose_perspective(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Calibration, rotation, translation and centre of a 3 x 4 matrix."""
    p = p if np.linalg.det(p[:, :3]) > 0 else -p  # a matrix has no sign
    flip = np.eye(3)[::-1]
    q, r = np.linalg.qr((flip @ p[:, :3]).T)
    k, rot = flip @ r.T @ flip, flip @ q.T
    sign = np.diag(np.sign(np.diag(k)))
    k, rot = k @ sign, sign @ rot
    centre = -np.linalg.solve(p[:, :3], p[:, 3])
    return k, rot, -rot @ centre, centre


def compose_perspective(k: np.ndarray, rot: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Scaled so that the last entry is 1, as all stored matrices are."""
    p = k @ rot @ np.c_[np.eye(3), -centre]
    return p / p[2, 3]


def decompose_affine(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """2 x 2 calibration (upper triangular), rotation and translation."""
    m = p[:2, :3]
    k = np.linalg.cholesky((m @ m.T)[::-1, ::-1])[::-1, ::-1]
    two = np.linalg.solve(k, m)
    return k, np.vstack([two, np.cross(two[0], two[1])]), np.linalg.solve(k, p[:2, 3])


def compose_affine(k: np.ndarray, rot: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.vstack([np.c_[k @ rot[:2], k @ t], [0, 0, 0, 1]])


def fundamental(p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
    """x2' F x1 = 0 for the images of any point."""
    pick = lambda p, i: np.delete(p, i, axis=0)
    return np.array([[(-1) ** (i + j) * np.linalg.det(np.vstack([pick(p1, j), pick(p2, i)])) for j in range(3)] for i in range(3)])


def rescaled(rpc: dict, alpha: float) -> dict:
    """The model of the image zoomed by alpha."""
    return rpc | {f"{a}_{s}": rpc[f"{a}_{s}"] * alpha for a in ("col", "row") for s in ("off", "scale")}


def affine_approximation(rpc: dict, lon: float, lat: float, alt: float) -> np.ndarray:
    """3 x 4 matrix with the model's value and derivatives at a ground point, by ECEF steps of a metre."""
    x = ecef(lon, lat, alt)
    see = lambda y: project(rpc, *geodetic(*y[:, None]))[:, 0]
    f = see(x)
    j = np.stack([(see(x + e) - see(x - e)) / 2 for e in np.eye(3)], axis=1)
    return np.vstack([np.c_[j, f - j @ x], [0, 0, 0, 1]])
