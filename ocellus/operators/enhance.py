"""Ridge enhancement kernels on whole pictures: block masks, orientation, frequency, oriented filtering.

A picture is one row (key, width, height, data: array<double>, row by row); each kernel is one numpy pass per picture
in mapInPandas, so pictures spread over tasks and no task holds more than an Arrow batch of them. Sampling between
pixels is bilinear: results agree with other implementations in meaning, not bit for bit.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def gaussian(sigma: float, odd: bool = True) -> np.ndarray:
    size = max(1, int(6 * sigma))
    size += odd and size % 2 == 0
    x = np.arange(size) - (size - 1) / 2
    g = np.exp(-(x**2) / (2 * sigma**2))
    return g / g.sum()


def smooth(a: np.ndarray, sigma: float) -> np.ndarray:
    g = gaussian(sigma)
    pad = g.size // 2
    for axis in (0, 1):
        width = [(pad, pad) if k == axis else (0, 0) for k in (0, 1)]
        a = np.apply_along_axis(np.convolve, axis, np.pad(a, width, mode="symmetric"), g, "valid")
    return a


def block_mask(a: np.ndarray, block: int = 16, threshold: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """The picture scaled by the mean and deviation of its lively part, and that part: blocks (zero-padded at the far
    edges) whose deviation after z-scoring exceeds the threshold."""
    h, w = a.shape
    z = (a - a.mean()) / max(a.std(), 1e-12)
    full = np.zeros((-(-h // block) * block, -(-w // block) * block))
    full[:h, :w] = z
    spread = full.reshape(full.shape[0] // block, block, -1, block).std(axis=(1, 3))
    mask = np.kron(spread, np.ones((block, block)))[:h, :w] > threshold
    live = z[mask] if mask.any() else z
    return (z - live.mean()) / max(live.std(), 1e-12), mask


def orientation(a: np.ndarray, gradient: float = 1.0, block: float = 7.0, angles: float = 7.0) -> np.ndarray:
    """Ridge direction in radians, [0, pi): smoothed squared gradients, doubled angles smoothed again."""
    gy, gx = np.gradient(smooth(a, gradient))
    xx, yy, xy = smooth(gx**2, block), smooth(gy**2, block), 2 * smooth(gx * gy, block)
    size = np.hypot(xy, xx - yy) + np.finfo(float).eps
    sin, cos = xy / size, (xx - yy) / size
    if angles:
        sin, cos = smooth(sin, angles), smooth(cos, angles)
    return np.pi / 2 + np.arctan2(sin, cos) / 2


def frequency(a: np.ndarray, mask: np.ndarray, direction: np.ndarray, block: int = 38, shortest: float = 5, longest: float = 15) -> tuple[np.ndarray, float]:
    """Ridges per pixel of each whole block inside the mask (0 if its strongest period is out of range), and the mean of those above 0.

    The sum of a block along its ridges is a signal whose spectrum is, by the projection-slice theorem, the slice of
    the block's spectrum across the ridges. So the slice is summed directly, at all frequencies up to one in two pixels, for
    all blocks together; its highest point, refined by a parabola, is the frequency.
    """
    rows, columns = a.shape[0] // block, a.shape[1] // block
    out = np.zeros(a.shape)
    if not rows or not columns:
        return out, 0.0
    tiles = lambda x: x[: rows * block, : columns * block].reshape(rows, block, columns, block).swapaxes(1, 2).reshape(-1, block, block)
    twice = 2 * tiles(direction)
    across = np.arctan2(np.sin(twice).mean((1, 2)), np.cos(twice).mean((1, 2))) / 2 - np.pi / 2
    window = np.outer(*[np.hanning(block + 2)[1:-1]] * 2)
    some = tiles(a)
    some = (some - some.mean((1, 2), keepdims=True)) * window
    y, x = np.mgrid[:block, :block] - (block - 1) / 2
    place = x * np.cos(across)[:, None, None] + y * np.sin(across)[:, None, None]
    tried = np.arange(4, 2 * block + 1) / (4 * block)
    power = np.stack([np.abs((some * np.exp(-2j * np.pi * f * place)).sum((1, 2))) for f in tried], axis=1)
    top = power.argmax(1)
    inner = np.clip(top, 1, tried.size - 2)
    left, middle, right = (power[np.arange(len(power)), inner + d] for d in (-1, 0, 1))
    bend = left - 2 * middle + right
    shift = np.where((top == inner) & (bend < 0), (left - right) / np.where(bend == 0, 1, bend) / 2, 0.0)
    best = tried[top] + shift * (tried[1] - tried[0])
    best = np.where((power.max(1) > 0) & (best * longest >= 1) & (best * shortest <= 1), best, 0.0)
    out[: rows * block, : columns * block] = np.kron(best.reshape(rows, columns), np.ones((block, block)))
    out *= mask
    return out, float(out[out > 0].mean()) if (out > 0).any() else 0.0


def oriented_filter(a: np.ndarray, direction: np.ndarray, freq: np.ndarray, kx: float = 0.65, ky: float = 0.65, step: int = 3) -> np.ndarray:
    """Even Gabor response across the ridges: at each pixel the wave exp(-(x / sx)^2 - (y / sy)^2) cos(2 pi f x), turned to
    the pixel's direction (in steps of `step` degrees), with f its frequency to two places and s = k / f.

    The bank is applied as transfer functions, two Gaussians each, to the picture's spectrum. Pixels without a
    frequency, or within three widths of an edge, are 0."""
    rounded = np.round(freq, 2)
    which = np.round(np.degrees(direction) / step).astype(int) % (180 // step)
    out = np.zeros(a.shape)
    for f in np.unique(rounded[rounded > 0]):
        sx, sy = kx / f, ky / f
        n = int(round(3 * max(sx, sy)))
        at = rounded == f
        at[:n], at[a.shape[0] - n :], at[:, :n], at[:, a.shape[1] - n :] = False, False, False, False
        if not at.any():
            continue
        padded = np.pad(a, n)
        spectrum = np.fft.rfft2(padded)
        v, u = np.fft.fftfreq(padded.shape[0])[:, None], np.fft.rfftfreq(padded.shape[1])[None, :]
        for k in np.unique(which[at]):
            t = np.radians(k * step) - np.pi / 2  # across the ridges
            along, beside = u * np.cos(t) + v * np.sin(t), v * np.cos(t) - u * np.sin(t)
            lobes = sum(np.exp(-((np.pi * sx * (along - sign * f)) ** 2)) for sign in (1, -1))
            transfer = np.pi * sx * sy / 2 * lobes * np.exp(-((np.pi * sy * beside) ** 2))
            response = np.fft.irfft2(spectrum * transfer, s=padded.shape)[n : n + a.shape[0], n : n + a.shape[1]]
            mine = at & (which == k)
            out[mine] = response[mine]
    return out


def ridges(a: np.ndarray) -> tuple[np.ndarray, float]:
    """Mask of ridge pixels (response below -3) and the mean frequency; the whole chain."""
    normal, mask = block_mask(a)
    direction = orientation(normal)
    freq, mean = frequency(normal, mask, direction)
    return oriented_filter(normal, direction, mean * mask) < -3, mean


def per_picture(pictures: DataFrame, key: str, kernel: Callable[[np.ndarray], tuple[np.ndarray, float]], out: str) -> DataFrame:
    """Applies a kernel to every picture: columns key, <out> array<double> of the same layout, mean double."""

    def run(batches):
        for pdf in batches:
            made = [kernel(np.reshape(d, (h, w)).astype(float)) for d, h, w in zip(pdf["data"], pdf["height"], pdf["width"], strict=True)]
            yield pd.DataFrame({key: pdf[key], out: [np.asarray(a, float).ravel().tolist() for a, _ in made], "mean": [m for _, m in made]})

    return pictures.select(key, "width", "height", "data").mapInPandas(run, f"`{key}` {pictures.schema[key].dataType.simpleString()}, `{out}` array<double>, mean double")
