"""Filtering of sampled signals in blocks: a Butterworth band-pass as second-order sections, run forward and backward, and polyphase resampling.

The cascade of sections is one linear system with a state of two numbers for each section. A block's effect on the state is linear in both its samples and the state that it
begins with, so blocks can be filtered apart from a state of zero, and what they begin with follows from a running product over small states.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from functools import cache

import numpy as np

#: Samples that one matrix product filters.
STEP = 64


def band_pass(low: float, high: float, rate: float, order: int = 4) -> np.ndarray:
    """Second-order sections (b0, b1, b2, 1, a1, a2) of a digital Butterworth band-pass, poles nearest to the unit circle last."""
    if not 0 < low < high < rate / 2 or order < 2 or order % 2:
        raise ValueError("0 < low < high < rate / 2 and an even order are needed")
    w1, w2 = 4 * np.tan(np.pi * np.array([low, high]) / rate)
    p = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order)) * (w2 - w1) / 2
    root = np.sqrt(p * p - w1 * w2)
    p = np.concatenate([p + root, p - root])
    gain = ((w2 - w1) ** order * 4.0**order / np.prod(4 - p)).real
    z = (4 + p) / (4 - p)
    z = sorted(z[z.imag > 0], key=abs)
    sos = np.array([[1, 0, -1, 1, -2 * x.real, abs(x) ** 2] for x in z])
    sos[0, :3] *= gain
    return sos


@dataclass(frozen=True)
class System:
    """state' = a state + b x; y = c state + d x. rest: the state of a constant signal of 1. edge: samples of extension at either end."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float
    rest: np.ndarray
    edge: int

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """y and the end state, of channels of samples and a state for each channel."""
        seen, direct, fed, power = _matrices(self)
        y = np.empty_like(x)
        for k in range(0, x.shape[1], STEP):
            part = x[:, k : k + STEP]
            n = part.shape[1]
            y[:, k : k + STEP] = part @ direct[:n, :n].T + state @ seen[:n].T
            state = state @ power[n].T + part @ fed[:, STEP - n :].T
        return y, state

    def begun(self, n: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The states that blocks of n samples begin with, from the ends that they have when begun with zero, and the first one's beginning."""
        out = [first]
        for size, end in zip(n[:-1], ends[:-1], strict=True):
            out.append(out[-1] @ np.linalg.matrix_power(self.a, int(size)).T + end)
        return np.array(out)

    def __hash__(self) -> int:
        return hash(self.a.tobytes())

    def __eq__(self, other: object) -> bool:
        return isinstance(other, System) and self.a.tobytes() == other.a.tobytes() and self.c.tobytes() == other.c.tobytes() and self.d == other.d


@cache
def _matrices(s: System) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    power = [np.eye(len(s.a))]
    for _ in range(STEP):
        power.append(s.a @ power[-1])
    seen = np.array([s.c @ p for p in power[:STEP]])
    pulse = np.append(s.d, [s.c @ p @ s.b for p in power[: STEP - 1]])
    lag = np.subtract.outer(np.arange(STEP), np.arange(STEP))
    direct = np.where(lag >= 0, pulse[np.maximum(lag, 0)], 0.0)
    return seen, direct, np.array([p @ s.b for p in power[STEP - 1 :: -1]]).T, power


@cache
def _system(low: float, high: float, rate: float, order: int) -> System:
    sos = band_pass(low, high, rate, order)
    a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
    for b0, b1, b2, _, a1, a2 in sos:
        own, into = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
        a = np.block([[a, np.zeros((len(a), 2))], [np.outer(into, c), own]])
        b, c, d = np.append(b, into * d), np.append(b0 * c, [1.0, 0.0]), b0 * d
    return System(a, b, c, d, np.linalg.solve(np.eye(len(a)) - a, b), 3 * (2 * len(sos) + 1))


def system(low: float, high: float, rate: float, order: int = 4) -> System:
    return _system(float(low), float(high), float(rate), order)


def extended(x: np.ndarray, edge: int, first: bool, last: bool) -> np.ndarray:
    """x with its odd reflection by so many samples before the first block of a signal and behind the last."""
    if (first or last) and x.shape[1] <= edge:
        raise ValueError(f"a signal needs more than {edge} samples in its first and last block")
    head = [2 * x[:, :1] - x[:, edge:0:-1]] if first else []
    tail = [2 * x[:, -1:] - x[:, -2 : -edge - 2 : -1]] if last else []
    return np.concatenate([*head, x, *tail], 1)


def zero_phase(x: np.ndarray, s: System) -> np.ndarray:
    """A whole signal filtered forward and backward; each pass begins as if its first sample had stood for ever."""
    long = extended(x, s.edge, True, True)
    y, _ = s.run(long, np.outer(long[:, 0], s.rest))
    z, _ = s.run(y[:, ::-1], np.outer(y[:, -1], s.rest))
    return z[:, ::-1][:, s.edge : s.edge + x.shape[1]]


@cache
def resampler(n: int, rate: float, wanted: float) -> np.ndarray:
    """Rows of weights that make the samples of the wanted rate out of n: a windowed low-pass at the lower of both rates, each output by the phase of the
    filter that falls on it. Beyond the ends the signal counts as zero."""
    ratio = Fraction(wanted / rate).limit_denominator(10_000)
    up, down = ratio.numerator, ratio.denominator
    if up == down:
        return np.eye(n)
    most = max(up, down)
    half = 10 * most
    t = np.arange(-half, half + 1)
    h = np.sinc(t / most) * np.kaiser(2 * half + 1, 5.0)
    h *= up / h.sum()
    at = np.arange(-(-n * up // down))[:, None] * down + half - np.arange(n)[None, :] * up
    return np.where((at >= 0) & (at < len(h)), h[np.clip(at, 0, len(h) - 1)], 0.0)


def resampled(x: np.ndarray, rate: float, wanted: float) -> np.ndarray:
    """Channels of samples at the wanted rate."""
    return x @ resampler(x.shape[1], float(rate), float(wanted)).T
