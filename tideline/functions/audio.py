"""Samples: mixing down, resampling, level control. NumPy, for Arrow functions."""

from __future__ import annotations

import math

import numpy as np

TAPS = 63
TARGET, FLOOR, MOST, KEEP = 0.067, 1e-3, 20.0, 0.95


def downmix(samples: np.ndarray, channels: int) -> np.ndarray:
    """The mean of interleaved channels; a last incomplete frame goes."""
    whole = len(samples) // channels * channels
    return samples[:whole].reshape(-1, channels).mean(axis=1)


def low_pass(rate_in: int, rate_out: int) -> np.ndarray:
    """A Hann-windowed sinc of ``TAPS`` values that sums to one."""
    cutoff = 0.5 * min(1.0, rate_out / rate_in)
    at = np.arange(TAPS) - (TAPS - 1) / 2
    taps = 2 * cutoff * np.sinc(2 * cutoff * at) * np.hanning(TAPS)
    return taps / taps.sum()


class Resampler:
    """Filter and linear interpolation; chunks may come in any size."""

    def __init__(self, rate_in: int, rate_out: int) -> None:
        self.step = rate_in / rate_out
        self.taps = low_pass(rate_in, rate_out) if rate_in > rate_out else np.ones(1)
        self.held = np.zeros(len(self.taps) - 1)
        self.smooth = np.zeros(0)
        self.base = 0
        self.sent = 0

    def push(self, samples: np.ndarray) -> np.ndarray:
        if not len(samples):
            return np.zeros(0)
        whole = np.concatenate([self.held, samples])
        self.held = whole[len(whole) - len(self.taps) + 1 :]
        self.smooth = np.concatenate([self.smooth, np.convolve(whole, self.taps, "valid")])
        last = self.base + len(self.smooth) - 1
        count = max(0, math.floor(last / self.step + 1e-9) + 1 - self.sent)
        at = (self.sent + np.arange(count)) * self.step
        out = np.interp(at, self.base + np.arange(len(self.smooth)), self.smooth)
        self.sent += count
        keep = max(0, math.floor(self.sent * self.step) - self.base)
        self.smooth, self.base = self.smooth[keep:], self.base + min(keep, len(self.smooth))
        return out


def resample(samples: np.ndarray, rate_in: int, rate_out: int) -> np.ndarray:
    return samples if rate_in == rate_out else Resampler(rate_in, rate_out).push(samples)


def rms(samples: np.ndarray) -> float:
    return float(np.sqrt(np.mean(np.square(samples.astype(np.float64))))) if len(samples) else 0.0


class GainControl:
    """Frame-wise gain: the average level holds on quiet frames; sound is only made louder."""

    def __init__(self) -> None:
        self.level: float | None = None

    def process(self, frame: np.ndarray) -> np.ndarray:
        now = rms(frame)
        if now >= FLOOR:
            self.level = now if self.level is None else KEEP * self.level + (1 - KEEP) * now
        gain = 1.0 if self.level is None else min(max(TARGET / self.level, 1.0), MOST)
        return np.clip(frame * gain, -1.0, 1.0)
