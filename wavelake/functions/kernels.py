"""Numerical kernels without a relational form: recurrences, transforms and matrix iterations over one channel or recording.

Plain numpy on arrays; the operators apply them inside grouped Arrow functions.
"""

from __future__ import annotations

from functools import lru_cache
from math import gcd

import numpy as np

# -- recursive filters -----------------------------------------------------------------------------------------------


def _sections(z, p, k) -> np.ndarray:
    """Second-order sections from zeros, poles (conjugate pairs or real) and gain."""
    def pairs(roots):
        roots = sorted(roots, key=lambda r: (abs(r.imag) < 1e-12, -abs(r)))
        cplx = [r for r in roots if r.imag > 1e-12]
        real = [r.real for r in roots if abs(r.imag) <= 1e-12]
        out = [(-2 * r.real, abs(r) ** 2) for r in cplx]
        while real:
            a = real.pop(0)
            b = real.pop() if real else 0.0
            out.append((-(a + b), a * b))
        return out

    num, den = pairs(z), pairs(p)
    num += [(0.0, 0.0)] * (len(den) - len(num))
    sos = np.array([[1.0, *n, 1.0, *d] for n, d in zip(num, den, strict=True)])
    sos[0, :3] *= k
    return sos


def butter_sos(order: int, low: float | None, high: float | None, fs: float) -> np.ndarray:
    """Butterworth sections: band-pass with both edges, high-pass with ``low`` alone, low-pass with ``high`` alone.

    Analog prototype on the unit circle, frequency transformation, bilinear transformation with prewarped edges.
    """
    proto = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    if low is not None and high is not None:
        w1, w2 = warp(low), warp(high)
        bw, w0 = w2 - w1, np.sqrt(w1 * w2)
        half = proto * bw / 2
        root = np.sqrt(half**2 - w0**2 + 0j)
        p, z, k = np.concatenate([half + root, half - root]), np.zeros(order, complex), bw**order
    elif low is not None:
        w = warp(low)
        p, z, k = w / proto, np.zeros(order, complex), float(np.real(1 / np.prod(-proto)))
    else:
        w = warp(high)
        p, z, k = proto * w, np.zeros(0, complex), w**order
    c = 2 * fs
    gain = k * np.real(np.prod(c - z) / np.prod(c - p))
    zd = np.concatenate([(c + z) / (c - z), -np.ones(len(p) - len(z))])
    return _sections(zd, (c + p) / (c - p), gain)


def notch_sos(freq: float, fs: float, q: float = 30.0) -> np.ndarray:
    w = 2 * np.pi * freq / fs
    gain = 1 / (1 + np.tan(w / q / 2))
    b = gain * np.array([1.0, -2 * np.cos(w), 1.0])
    return np.array([[*b, 1.0, -2 * gain * np.cos(w), 2 * gain - 1]])


def _steady(b, a) -> np.ndarray:
    """State of a section (transposed direct form) that a constant input of one leaves as it is."""
    y = b.sum() / a.sum()
    return np.array([y - b[0], b[2] - a[2] * y])


def _run_section(b, a, x: np.ndarray, state: np.ndarray, block: int = 256) -> np.ndarray:
    """Outputs of one section over x."""
    return _section_pass(b, a, x, state, block)[0]


def _section_pass(b, a, x: np.ndarray, state: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of one section over x and its state at the end, in blocks: outputs of a block are a matrix product with its inputs and
    the state before it."""
    n = len(x)
    m = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    drive = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = np.empty((block + 1, 2, 2))
    powers[0] = np.eye(2)
    for i in range(block):
        powers[i + 1] = m @ powers[i]
    free = powers[:block, 0, :]
    impulse = np.concatenate([[b[0]], (powers[: block - 1] @ drive)[:, 0]])
    lag = np.arange(block)[:, None] - np.arange(block)[None, :]
    forced = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    carry = (powers[:block][::-1] @ drive).T
    out = np.empty(n)
    for at in range(0, n, block):
        u = x[at : at + block]
        k = len(u)
        out[at : at + k] = forced[:k, :k] @ u + free[:k] @ state
        state = powers[k] @ state + carry[:, block - k :] @ u
    return out, state


def run_sections(sos: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sections one after another over x from their states (two numbers each): outputs and the states at the end."""
    state = np.array(state, float).reshape(-1, 2)
    for k, row in enumerate(sos):
        x, state[k] = _section_pass(row[:3], row[3:], x, state[k])
    return x, state.ravel()


def steady_states(sos: np.ndarray, level: float) -> np.ndarray:
    """States that a constant input of ``level`` leaves as they are."""
    out = []
    for row in sos:
        out.append(_steady(row[:3], row[3:]) * level)
        level = level * row[:3].sum() / row[3:].sum()
    return np.concatenate(out)


@lru_cache(maxsize=64)
def _transition(sections: tuple, n: int) -> np.ndarray:
    sos = np.array(sections)
    one = np.array([run_sections(sos, np.zeros(1), e)[1] for e in np.eye(2 * len(sos))]).T
    return np.linalg.matrix_power(one, n)


def transition(sos: np.ndarray, n: int) -> np.ndarray:
    """The matrix that takes states over n samples without input."""
    return _transition(tuple(map(tuple, sos)), n)


def extension(sos: np.ndarray) -> int:
    """Samples by which zero-phase filtering extends a series at both ends: three times the number of coefficients."""
    order = int((sos[:, 5] != 0).sum() + ((sos[:, 4] != 0) | (sos[:, 5] != 0)).sum())
    return 3 * (order + 1)


def filter_zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward, with odd extension at both ends and steady initial states."""
    pad = extension(sos)
    x = np.asarray(x, float)
    if len(x) <= pad:
        raise ValueError(f"the filter needs more than {pad} samples, got {len(x)}")
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        ext = run_sections(sos, ext, steady_states(sos, ext[0]))[0][::-1]
    return ext[pad : len(ext) - pad]


def band_limits(fs: float, lp: float, hp: float) -> tuple[float, float]:
    """Edges brought below half the rate: low-pass 0.9 of it, high-pass a tenth, high-pass always below low-pass."""
    half = fs / 2
    lp = half * 0.9 if lp >= half else lp
    hp = half * 0.1 if hp >= half else hp
    return lp, (lp * 0.1 if hp >= lp else hp)


def cleaning(fs: float, lp: float | None, hp: float | None, notch: float | None, strict: bool = False, order: int = 4) -> list[np.ndarray]:
    """Sections of the filters one after another: band-pass (or one-sided), then notch; ``strict`` refuses edges beyond half the rate
    instead of moving them."""
    half, out = fs / 2, []
    if strict:
        if any(f is not None and f > half for f in (lp, hp)) or (lp is not None and hp is not None and hp >= lp):
            raise ValueError(f"filter edges {hp} and {lp} do not fit the rate {fs}")
    elif lp is not None and hp is not None:
        lp, hp = band_limits(fs, lp, hp)
    if lp is not None or hp is not None:
        out.append(butter_sos(order, hp, lp, fs))
    if notch and notch < half - 1:
        out.append(notch_sos(notch, fs))
    return out


def clean_channel(x: np.ndarray, fs: float, lp: float | None, hp: float | None, notch: float | None, strict: bool = False, order: int = 4) -> np.ndarray:
    """The whole series through ``cleaning``."""
    for sos in cleaning(fs, lp, hp, notch, strict, order):
        x = filter_zero_phase(sos, x)
    return np.asarray(x, float)


# -- transforms ------------------------------------------------------------------------------------------------------


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal through the spectrum: negative frequencies dropped, positive doubled."""
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * h)


def quadrature(d: np.ndarray, n: int, odd) -> np.ndarray:
    """The kernel by which a transform of n samples (a ring) turns all phases by a quarter, at distance d; ``odd``: as for odd d."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if n % 2 == 0:
            h = np.where(odd, 2 / np.tan(np.pi * d / n), 0.0) / n
        else:
            h = np.where(odd, 1 / np.tan(np.pi * d / (2 * n)), -np.tan(np.pi * d / (2 * n))) / n
    return np.where(d == 0, 0.0, h)


def nodes(p: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(p) + 1) / (2 * p))


def interpolation(at: np.ndarray, p: int) -> np.ndarray:
    """(places, p): weights of the values at ``nodes`` for places in [-1, 1]."""
    k = np.arange(1, p)[:, None]
    return 1 / p + 2 / p * np.cos(k * np.arccos(np.clip(at, -1, 1))).T @ np.cos(k * np.arccos(nodes(p)))


def near_quadrature(x: np.ndarray, low: int, high: int, n: int) -> np.ndarray:
    """What the samples x give at their places low to high - 1."""
    d = np.arange(low - len(x) + 1, high)
    full = len(x) + len(d) - 1
    while _rough(full):
        full += 1
    got = np.fft.irfft(np.fft.rfft(x, full) * np.fft.rfft(quadrature(d, n, d % 2 != 0), full), full)
    return got[len(x) - 1 : len(x) - 1 + high - low]


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if n > 1 else np.ones(1)


def segment_psd(segments: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """One-sided density of each row: mean removed, periodic Hann taper."""
    n = segments.shape[1]
    w = hann(n)
    spec = np.abs(np.fft.rfft((segments - segments.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2 / (fs * (w * w).sum())
    spec[:, 1 : (n + 1) // 2 if n % 2 else n // 2] *= 2
    return np.arange(spec.shape[1]) * fs / n, spec


def welch(x: np.ndarray, fs: float, nperseg: int, overlap: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Mean density over overlapping segments; the overlap is that of the length in use."""
    n = min(nperseg, len(x))
    step = max(n - int(n * overlap), 1)
    rows = np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), n)[::step]
    f, p = segment_psd(rows, fs)
    return f, p.mean(axis=0)


def log_grid(fmin: float = 1.0, fmax: float = 45.0, n: int = 50) -> np.ndarray:
    fmin = 1.0 if fmin <= 0 else fmin
    fmax = fmin + 1.0 if fmax <= fmin else fmax
    return np.logspace(np.log10(fmin), np.log10(fmax), n)


def wavelet_transform(x: np.ndarray, fs: float, freqs: np.ndarray, width: float = 5.0, delayed: bool = False) -> np.ndarray:
    """(frequencies, samples) complex Morlet coefficients.

    Wavelets have unit energy and the length of the signal.  ``delayed`` leaves the circular delay by half the signal that comes
    from not centring the wavelet, for comparison with results that have it.
    """
    n = len(x)
    half = n // 2
    t = np.arange(-half, half + 1) / fs
    size = n
    while _rough(size):
        size += 1
    spec = np.fft.fft(x, size)
    out = np.empty((len(freqs), n), complex)
    for k, f in enumerate(freqs):
        w = np.exp(-(t**2) / (2 * (width / (2 * np.pi * f)) ** 2)) * np.exp(2j * np.pi * f * t)
        w /= np.sqrt((np.abs(w) ** 2).sum() + 1e-12)
        if delayed:
            out[k] = np.fft.ifft(spec * np.fft.fft(w, size))[:n]
        else:
            full = size + len(w)
            while _rough(full):
                full += 1
            conv = np.fft.ifft(np.fft.fft(x, full) * np.fft.fft(w, full))
            out[k] = conv[half : half + n]
    return out


@lru_cache(maxsize=8)
def _wavelet_bank(n: int, fs: float, freqs: tuple[float, ...], width: float) -> tuple[int, np.ndarray]:
    """Length of the transform and spectra of the centred wavelets for series of n samples."""
    half = n // 2
    t = np.arange(-half, half + 1) / fs
    f = np.array(freqs)[:, None]
    w = np.exp(-(t**2) / (2 * (width / (2 * np.pi * f)) ** 2)) * np.exp(2j * np.pi * f * t)
    w /= np.sqrt((np.abs(w) ** 2).sum(axis=1, keepdims=True) + 1e-12)
    full = n + w.shape[1]
    while _rough(full):
        full += 1
    return full, np.fft.fft(w, full, axis=1)


def wavelet_transforms(x: np.ndarray, fs: float, freqs, width: float = 5.0) -> np.ndarray:
    """(series, frequencies, samples) centred coefficients of many series of one length."""
    n = x.shape[1]
    full, bank = _wavelet_bank(n, float(fs), tuple(map(float, freqs)), width)
    spec = np.fft.fft(x, full, axis=1)
    return np.fft.ifft(spec[:, None, :] * bank, axis=2)[:, :, n // 2 : n // 2 + n]


def _rough(n: int) -> bool:
    for p in (2, 3, 5):
        while n % p == 0:
            n //= p
    return n > 1


# -- resampling ------------------------------------------------------------------------------------------------------


def ratio_kernel(up: int, down: int) -> tuple[int, int, np.ndarray]:
    """Ratio without common factors, and a Kaiser-windowed (beta 5) low-pass of twenty lobes for it."""
    g = gcd(up, down)
    up, down = up // g, down // g
    most = max(up, down)
    half = 10 * most
    t = np.arange(-half, half + 1)
    h = np.sinc(t / most) / most * np.kaiser(2 * half + 1, 5.0)
    return up, down, h / h.sum() * up


def resample_part(x: np.ndarray, first: int, low: int, high: int, up: int, down: int, h: np.ndarray) -> np.ndarray:
    """Outputs low to high - 1 of polyphase resampling, where x has the inputs from ``first`` on; others count as zero."""
    half, out = len(h) // 2, np.zeros(high - low)
    at = np.arange(low, high) * down
    for j in range(-(half // up) - 1, half // up + 2):
        src = at // up + j
        lag = at - src * up
        ok = (src >= first) & (src < first + len(x)) & (np.abs(lag) <= half)
        out[ok] += x[src[ok] - first] * h[lag[ok] + half]
    return out


def resample_ratio(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase resampling, zero-padded ends."""
    up, down, h = ratio_kernel(up, down)
    x = np.asarray(x, float)
    return x if up == down else resample_part(x, 0, 0, -(-len(x) * up // down), up, down, h)


def resample_fourier(x: np.ndarray, n: int) -> np.ndarray:
    """Resampling to n points through the spectrum."""
    m = len(x)
    spec = np.fft.rfft(x)
    k = min(n, m) // 2 + 1
    out = np.zeros(n // 2 + 1, complex)
    out[:k] = spec[:k]
    if min(n, m) % 2 == 0 and n != m:
        out[k - 1] *= 2 if n < m else 0.5
    return np.fft.irfft(out, n) * (n / m)


# -- independent components ------------------------------------------------------------------------------------------


def independent_components(x: np.ndarray, n: int | None = None, rounds: int = 300, tol: float = 1e-6, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(sources: samples x n, mixing: n x channels) by the tanh fixed point, all components at once.

    The singular vectors of the centred samples are white already; each round moves the rotation by the fixed-point step and
    takes the nearest rotation to that (its polar factor), so components stay orthogonal without an order among them.  Directions
    without variance are left out.  Components come in the order of the variance they explain, with a positive largest loading.
    """
    centred = np.asarray(x, float) - np.mean(x, axis=0)
    left, strength, right = np.linalg.svd(centred, full_matrices=False)
    n = min(n or len(strength), int((strength > 1e-10 * max(strength[0], 1e-300)).sum()))
    if not n:
        return np.zeros((len(centred), 0)), np.zeros((0, centred.shape[1]))
    unit = np.sqrt(len(centred))
    white, back = left[:, :n] * unit, right[:n] * strength[:n, None] / unit
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))[0]
    for _ in range(rounds):
        g = np.tanh(white @ turn.T)
        step = g.T @ white / len(white) - (1 - (g**2).mean(axis=0))[:, None] * turn
        p, _, q = np.linalg.svd(step)
        before, turn = turn, p @ q
        if np.abs(np.abs((turn * before).sum(axis=1)) - 1).max() < tol:
            break
    sources, mixing = white @ turn.T, turn @ back
    first = np.argsort(-np.square(mixing).sum(axis=1), kind="stable")
    largest = np.take_along_axis(mixing, np.abs(mixing).argmax(axis=1)[:, None], axis=1)[:, 0]
    turned = np.where(largest < 0, -1.0, 1.0)[first]
    return sources[:, first] * turned, mixing[first] * turned[:, None]


# -- interpolation over the scalp ------------------------------------------------------------------------------------


def radial_surface(x, y, v, grid: np.ndarray, smooth: float = 0.1) -> np.ndarray:
    """Multiquadric surface through (x, y, v), at all points of grid x grid (rows: y)."""
    x, y, v = (np.asarray(a, float) for a in (x, y, v))
    edges = np.array([np.ptp(x), np.ptp(y)])
    edges = edges[edges > 0]
    eps = (np.prod(edges) / len(x)) ** (1 / max(len(edges), 1)) if len(edges) else 1.0
    phi = lambda r: np.sqrt((r / eps) ** 2 + 1)
    a = phi(np.hypot(x[:, None] - x, y[:, None] - y)) - smooth * np.eye(len(x))
    weight = np.linalg.solve(a, v)
    gx, gy = np.meshgrid(grid, grid)
    return sum(w * phi(np.hypot(gx - px, gy - py)) for w, px, py in zip(weight, x, y, strict=True))


def distance_surface(x, y, v, grid: np.ndarray, power: float = 2.0) -> np.ndarray:
    """Means of the values weighted by inverse distances, at all points of grid x grid (rows: y); a point itself has its value."""
    x, y, v = (np.asarray(a, float) for a in (x, y, v))
    gx, gy = np.meshgrid(grid, grid)
    far = np.hypot(gx[..., None] - x, gy[..., None] - y)
    near = 1 / np.maximum(far, 1e-9) ** power
    return (near * v).sum(axis=-1) / near.sum(axis=-1)
