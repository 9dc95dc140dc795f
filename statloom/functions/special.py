"""Tail probabilities of the t, F, chi-square and normal distributions on numpy arrays.

Called only from the vectorised UDFs in `tails`, on result rows (one per test), never on data rows.
"""

import math

import numpy as np

_TINY = 1e-300
_HUGE_DF = 1e8


def _lgamma(x):
    return np.asarray(np.frompyfunc(math.lgamma, 1, 1)(x), dtype=float)


def _erfc(x):
    return np.asarray(np.frompyfunc(math.erfc, 1, 1)(x), dtype=float)


def betainc(a, b, x):
    """Regularised incomplete beta function, modified Lentz continued fraction."""
    a, b, x = (np.array(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    out[ok & (x == 0)] = 0.0
    out[ok & (x == 1)] = 1.0
    idx = np.flatnonzero(ok & (x > 0) & (x < 1))
    if idx.size == 0:
        return out
    a, b, x = a.flat[idx], b.flat[idx], x.flat[idx]
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, 20000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    value = front * h
    out.flat[idx] = np.where(swap, 1 - value, value)
    return out


def gammaincc(a, x):
    """Upper regularised incomplete gamma function: series below the mean, continued fraction above."""
    a, x = (np.array(v, dtype=float) for v in np.broadcast_arrays(a, x))
    out = np.full(x.shape, np.nan)
    out[(a > 0) & (x == 0)] = 1.0
    out[(a > 0) & np.isposinf(x)] = 0.0
    idx = np.flatnonzero((a > 0) & (x > 0) & np.isfinite(x))
    if idx.size == 0:
        return out
    a, x = a.flat[idx], x.flat[idx]
    front = np.exp(a * np.log(x) - x - _lgamma(a))
    low = x < a + 1
    total = 1 / a
    term = total.copy()
    n = a.copy()
    for _ in range(20000):
        n = n + 1
        term = term * np.where(low, x, 0) / n
        total = total + term
        if np.all(term <= total * 1e-17):
            break
    b = np.where(low, 2.0, x + 1 - a)
    c = np.full_like(x, 1 / _TINY)
    d = 1 / b
    h = d.copy()
    for i in range(1, 20000):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = b + an / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        step = np.where(low, 1.0, c * d)
        h = h * step
        if np.all(np.abs(step - 1) < 1e-16):
            break
    out.flat[idx] = np.where(low, 1 - front * total, front * h)
    return out


def norm_sf(z):
    return 0.5 * _erfc(np.asarray(z, dtype=float) / math.sqrt(2))


def norm_ppf(p):
    """Normal quantile: rational start, then Newton steps on the exact tail."""
    p = np.array(p, dtype=float)
    out = np.full(p.shape, np.nan)
    out[p == 0], out[p == 1] = -np.inf, np.inf
    ok = (p > 0) & (p < 1)
    q = np.minimum(p[ok], 1 - p[ok])
    t = np.sqrt(-2 * np.log(q))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t**2) / (1 + 1.432788 * t + 0.189269 * t**2 + 0.001308 * t**3)
    for _ in range(6):
        density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        step = (norm_sf(z) - q) / density
        z = z + step / (1 - np.clip(z * step / 2, -0.5, 0.5))
    out[ok] = np.where(p[ok] < 0.5, -z, z)
    return out


def t_sf(t, df):
    """Upper tail of Student's t; the normal limit with its first correction for huge df."""
    t, df = (np.array(v, dtype=float) for v in np.broadcast_arrays(t, df))
    huge = df > _HUGE_DF
    safe = np.where(huge | ~(df > 0), 1.0, df)
    half = 0.5 * betainc(safe / 2, np.full_like(safe, 0.5), safe / (safe + t * t))
    exact = np.where(t >= 0, half, 1 - half)
    limit = norm_sf(t * (1 - 1 / (4 * np.where(df > 0, df, 1))))
    return np.where(df > 0, np.where(huge, limit, exact), np.nan)


def t_ppf(p, df):
    """Quantile of Student's t by bisection on the tail, refined to double precision."""
    p, df = (np.array(v, dtype=float) for v in np.broadcast_arrays(p, df))
    q = np.minimum(p, 1 - p)
    low, high = np.zeros_like(q), np.ones_like(q)
    for _ in range(1100):
        short = t_sf(high, df) > q
        if not np.any(short):
            break
        high = np.where(short, high * 2, high)
    for _ in range(200):
        mid = (low + high) / 2
        above = t_sf(mid, df) > q
        low, high = np.where(above, mid, low), np.where(above, high, mid)
        if np.all(high - low <= 1e-15 * np.maximum(high, 1e-300)):
            break
    t = np.where(p < 0.5, -(low + high) / 2, (low + high) / 2)
    return np.where((df > 0) & (p > 0) & (p < 1), t, np.nan)


def chi2_sf(x, df):
    x, df = (np.array(v, dtype=float) for v in np.broadcast_arrays(x, df))
    return gammaincc(df / 2, x / 2)


def f_sf(f, d1, d2):
    """Upper tail of F; the chi-square limit once the second df is huge."""
    f, d1, d2 = (np.array(v, dtype=float) for v in np.broadcast_arrays(f, d1, d2))
    infinite = np.isposinf(f)
    f = np.where(infinite, 0.0, f)
    huge = d2 > _HUGE_DF
    safe = np.where(huge, 1.0, d2)
    exact = betainc(safe / 2, d1 / 2, safe / (safe + d1 * f))
    out = np.where(huge, chi2_sf(d1 * f, d1), exact)
    return np.where(infinite, 0.0, out)
