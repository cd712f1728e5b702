"""Filter coefficients, computed once on the driver.

A tap table maps the offset ``o`` to its weight: out[i] = sum w[o] * x[i + o].
"""

from __future__ import annotations

import math

import numpy as np


def odd(window: int) -> int:
    window = int(window)
    return window + 1 if window % 2 == 0 else window


def centred(kernel: np.ndarray) -> dict[int, float]:
    """Taps of a convolution whose result keeps the length of the series."""
    ahead = (len(kernel) - 1) // 2
    return {ahead - m: float(k) for m, k in enumerate(kernel)}


def linear_taps(window: int, newest: bool = False) -> dict[int, float]:
    """Linear weights; by default the oldest sample is the heaviest."""
    ramp = np.arange(1, window + 1, dtype=float)
    ramp = ramp[::-1] if newest else ramp
    return centred(ramp / ramp.sum())


def bell(window: int, centre: float, width: float) -> np.ndarray:
    k = np.exp(-0.5 * ((np.arange(window) - centre) / width) ** 2)
    return k / k.sum()


def alma_taps(window: int, offset: float, sigma: float, causal: bool = False) -> dict[int, float]:
    if causal:
        k = bell(window, offset * (window - 1), window / max(sigma, 1e-6))
        return {m - (window - 1): float(v) for m, v in enumerate(k)}
    return centred(bell(window, offset * (window - 1), window / sigma if sigma > 0 else 1.0))


def gaussian_taps(sigma: float, radius: int) -> dict[int, float]:
    k = bell(2 * radius + 1, radius, sigma)
    return {m - radius: float(v) for m, v in enumerate(k)}


def savgol_matrix(window: int, order: int) -> np.ndarray:
    """Row i holds the weights that evaluate, at sample i, the least-squares
    polynomial through all samples of one window."""
    h = (window - 1) / 2
    basis = np.vander((np.arange(window) - h) / max(h, 1.0), order + 1, increasing=True)
    q, _ = np.linalg.qr(basis)
    return q @ q.T


def butterworth_sections(order: int, cutoff: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a1 a2) of a low-pass, unit gain at zero.
    ``cutoff`` is a fraction of the half sampling rate."""
    warped = math.tan(math.pi * cutoff / 2)
    angles = [math.pi * (2 * k + order + 1) / (2 * order) for k in range(order)]
    rows = []
    for angle in angles[: order // 2]:
        s = warped * complex(math.cos(angle), math.sin(angle))
        z = (1 + s) / (1 - s)
        a1, a2 = -2 * z.real, abs(z) ** 2
        g = (1 + a1 + a2) / 4
        rows.append([g, 2 * g, g, a1, a2])
    if order % 2:
        z = (1 - warped) / (1 + warped)
        g = (1 - z) / 2
        rows.append([g, g, 0.0, -z, 0.0])
    return np.array(rows)


def section_radius(sections: np.ndarray) -> float:
    return max(float(np.abs(np.roots([1.0, r[3], r[4]])).max()) for r in sections)


# Process noise per unit of Q for a step of dt, by model.
KALMAN_NOISE = {
    "piecewise": lambda dt: np.array([[dt**4 / 4, dt**3 / 2], [dt**3 / 2, dt**2]]),
    "diagonal": lambda dt: np.eye(2),
    "continuous": lambda dt: np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]]),
}


def kalman_gains(q: float, r: float, dt: float = 1.0, model: str = "piecewise",
                 tol: float = 1e-15, most: int = 200_000) -> tuple[np.ndarray, float]:
    """Gains of the constant-velocity model until they stop changing, and the
    spectral radius of the error recursion under the last gain. They depend on
    the parameters only, never on the data."""
    noise = q * KALMAN_NOISE[model](dt)
    step = np.array([[1.0, dt], [0.0, 1.0]])
    cov = np.eye(2) * (1.0 if model == "continuous" else 0.1)
    gains = []
    for _ in range(most):
        cov = step @ cov @ step.T + noise
        gain = cov[:, 0] / (cov[0, 0] + r)
        cov = cov - np.outer(gain, cov[0, :])
        gains.append(gain)
        if len(gains) > 1 and np.abs(gains[-1] - gains[-2]).max() <= tol:
            break
    else:
        raise ValueError(f"the gains for Q={q}, R={r} don't settle within {most} rows")
    closed = (np.eye(2) - np.outer(gains[-1], [1.0, 0.0])) @ step
    return np.array(gains), float(np.abs(np.linalg.eigvals(closed)).max())


def settle(radius: float, floor: float = 1e-18) -> int:
    """Rows after which a factor ``radius`` per row has fallen below ``floor``."""
    if radius <= 0.0:
        return 1
    return int(math.ceil(math.log(floor) / math.log(radius))) + 1
