"""Incomplete beta and gamma functions and their inverses, in numpy."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_TINY = 1e-300


def gamma_p(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    out[np.isinf(x)] = 1.0
    live = (x > 0) & np.isfinite(x)
    front = np.zeros(a.shape)
    front[live] = np.exp(a[live] * np.log(x[live]) - x[live] - _lgamma(a[live]))
    series = live & (x < a + 1)
    if series.any():
        s, n = a[series], x[series]
        term = total = 1 / s
        k = s.copy()
        for _ in range(3000):
            k = k + 1
            term = term * n / k
            total = total + term
            if (np.abs(term) < 1e-16 * np.abs(total)).all():
                break
        out[series] = front[series] * total
    tail = live & ~series
    if tail.any():  # Lentz's continued fraction of the upper function
        s, n = a[tail], x[tail]
        b = n + 1 - s
        c, d = np.full(s.shape, 1 / _TINY), 1 / b
        h = d.copy()
        for i in range(1, 3000):
            an = -i * (i - s)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[tail] = 1 - front[tail] * h
    return np.clip(out, 0, 1)


def beta_i(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    live = (y > 0) & (y < 1)
    out = np.where(y >= 1, 1.0, 0.0)
    if live.any():
        s, t, z = p[live], q[live], y[live]
        front = np.exp(_lgamma(s + t) - _lgamma(s) - _lgamma(t) + s * np.log(z) + t * np.log1p(-z)) / s
        c, d = np.ones(s.shape), 1 - (s + t) * z / (s + 1)
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        h = d.copy()
        for m in range(1, 2000):
            for num in (m * (t - m) * z / ((s + 2 * m - 1) * (s + 2 * m)), -(s + m) * (s + t + m) * z / ((s + 2 * m) * (s + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < _TINY, _TINY, c)
                h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[live] = front * h
    return np.where(swap, 1 - out, out)


def _inverse(f, density, p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where the increasing f reaches p: Newton steps, halving where a step leaves the bracket."""
    lo, hi, x = lo.copy(), hi.copy(), (lo + hi) / 2
    for _ in range(200):
        off = f(x) - p
        lo, hi = np.where(off < 0, x, lo), np.where(off < 0, hi, x)
        with np.errstate(all="ignore"):
            step = x - off / density(x)
        inside = np.isfinite(step) & (step > lo) & (step < hi)
        new = np.where(inside, step, (lo + hi) / 2)
        done = np.abs(new - x) <= 1e-14 * np.maximum(np.abs(x), 1e-300)
        x = new
        if (done | (hi - lo <= 1e-15 * np.maximum(hi, 1e-300))).all():
            break
    return x


def gamma_quantile(p: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Quantile of the gamma distribution with scale 1."""
    p, a = (np.array(v, float) for v in np.broadcast_arrays(p, a))
    top = a + 1
    for _ in range(200):
        short = gamma_p(a, top) < p
        if not short.any():
            break
        top = np.where(short, top * 2, top)
    norm = _lgamma(a)
    density = lambda x: np.exp((a - 1) * np.log(x) - x - norm)
    return _inverse(lambda x: gamma_p(a, x), density, p, np.zeros(a.shape), top)


def beta_quantile(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p, a, b = (np.array(v, float) for v in np.broadcast_arrays(p, a, b))
    norm = _lgamma(a + b) - _lgamma(a) - _lgamma(b)
    density = lambda x: np.exp(norm + (a - 1) * np.log(x) + (b - 1) * np.log1p(-x))
    return _inverse(lambda x: beta_i(a, b, x), density, p, np.zeros(a.shape), np.ones(a.shape))


def normal_quantile(p: float) -> float:
    """Quantile of the standard normal distribution."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2
