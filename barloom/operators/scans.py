"""Recurrences over series as scans: exponential and Wilder averages, running totals, and the indicators made of them.

A scan runs over many runs of consecutive candles at once, each from a state of its own, and gives the states that they
end with.  So series that are streamed in batches go on where the last batch ended (``streamed``), and blocks of one
series are put together from their maps of states (``operators.blocks``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd


class Runs:
    """Where runs of consecutive candles lie in arrays: each row's place in its series and its run, and the first and last row of each run."""

    def __init__(self, place: np.ndarray, starts: np.ndarray):
        self.place, self.starts, self.n = place, starts, len(place)
        ends = np.append(starts[1:], self.n)
        self.last = ends - 1
        self.run = np.repeat(np.arange(len(starts)), ends - starts)


def recurred(keep: np.ndarray, add: np.ndarray) -> np.ndarray:
    """v where v[i] = keep[i] * v[i - 1] + add[i], by doubling the steps; ``keep`` is 0 in the first row of a run."""
    keep, v, step = keep.copy(), add.copy(), 1
    while step < len(v) and keep.any():
        v[step:] += keep[step:] * v[:-step]
        keep[step:] *= keep[:-step]
        step *= 2
    return v


class Average:
    """An average seeded by the mean of ``period`` values from place ``begin``; its state is the seed's sum so far and the value."""

    size = 2

    def __init__(self, begin: int, period: int, alpha: float):
        self.begin, self.period, self.alpha = begin, period, alpha

    def run(self, x: np.ndarray, runs: Runs, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (NaN before the seed) and the states after each run, from the states before it."""
        at, place = self.begin + self.period - 1, runs.place
        sound = np.isfinite(x)
        y = x if sound.all() else np.where(sound, x, 0.0)
        seeding = (place >= self.begin) & (place <= at)
        total = state[:, 0] + np.bincount(runs.run, weights=np.where(seeding, y, 0.0), minlength=len(state))
        after = place > at
        keep, add = np.where(after, 1 - self.alpha, 0.0), np.where(after, self.alpha * y, 0.0)
        add[place == at] = total[runs.run[place == at]] / self.period
        go_on = runs.starts[after[runs.starts]]
        add[go_on] += keep[go_on] * state[runs.run[go_on], 1]
        keep[runs.starts] = 0.0
        out = np.where(place >= at, recurred(keep, add), np.nan)
        value = np.where(place[runs.last] >= at, out[runs.last], state[:, 1])
        ended = np.column_stack((total, value))
        for k in np.unique(runs.run[~sound]).tolist():  # what isn't finite stays in its run
            low, high = runs.starts[k], runs.last[k] + 1
            out[low:high], ended[k] = self.alone(x[low:high], int(place[low]), state[k])
        return out, ended

    def alone(self, x: np.ndarray, first: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``run`` of one run, in which values that are no numbers are passed over."""
        n, at = len(x), self.begin + self.period - 1
        total, value = state
        out = np.full(n, np.nan)
        low, high = (min(max(k - first, 0), n) for k in (self.begin, at + 1))
        total = total + x[low:high].sum()
        if first <= at < first + n:
            value = out[at - first] = total / self.period
        start = max(at + 1 - first, 0)
        if start < n:
            made = pd.Series(np.concatenate(([value], x[start:]))).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()
            out[start:], value = made[1:], made[-1]
        return out, np.array([total, value])


class Sum:
    size = 1

    def run(self, x: np.ndarray, runs: Runs, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.concatenate([np.cumsum(np.append(before, x[low : high + 1]))[1:] for before, low, high in zip(state[:, 0], runs.starts, runs.last)])
        return out, out[runs.last][:, None]


def _chain(parts: list, inputs: list[Callable], finish: Callable) -> tuple[list, Callable]:
    """A scan of several parts; an input may use the values of the parts before it.  ``finish`` makes the indicator's columns.

    It runs over one run from place ``first`` and one state, or over ``Runs`` and a row of states for each.
    """

    def run(bars: dict, first: int | Runs, state: np.ndarray) -> tuple[dict, np.ndarray]:
        if not isinstance(first, Runs):
            n = len(bars["close"])
            if not n:
                return {c: np.zeros(0) for c in finish(bars, [np.zeros(0)] * len(parts), Runs(np.zeros(0, dtype=int), np.zeros(1, dtype=int)))}, np.asarray(state)
            made, after = run(bars, Runs(np.arange(first, first + n), np.zeros(1, dtype=int)), np.asarray(state, dtype=float)[None, :])
            return made, after[0]
        made, after, at = [], [], 0
        for part, x in zip(parts, inputs):
            values, own = part.run(x(bars, made), first, state[:, at : at + part.size])
            made.append(values)
            after.append(own)
            at += part.size
        return finish(bars, made, first), np.concatenate(after, axis=1)

    return parts, run


def _slope(values: np.ndarray, lag: int, runs: Runs) -> np.ndarray:
    """The mean step of the last ``lag`` values; NaN in the first ``lag`` rows of a run."""
    out = np.full(len(values), np.nan)
    out[lag:] = (values[lag:] - values[:-lag]) / lag
    if len(values):
        out[np.arange(runs.n) - runs.starts[runs.run] < lag] = np.nan
    return out


def _close(bars: dict, made: list) -> np.ndarray:
    return bars["close"]


def _rsi_of(bars: dict, made: list, runs: Runs) -> dict:
    gain, loss = made
    with np.errstate(divide="ignore", invalid="ignore"):
        return {"": np.where(loss == 0, np.where(gain > 0, 100.0, 50.0), 100 - 100 / (1 + gain / loss))}


def _macd_of(bars: dict, made: list, runs: Runs) -> dict:
    fast, slow, signal = made
    line = np.where(np.isnan(signal), np.nan, fast - slow)
    return {"macd": line, "signal": signal, "histogram": line - signal}


def _natr_of(bars: dict, made: list, runs: Runs) -> dict:
    with np.errstate(divide="ignore", invalid="ignore"):
        return {"": made[0] / bars["close"] * 100, "invalid": bars["close"] <= 0}


def _ema(period: int) -> Average:
    return Average(0, period, 2 / (period + 1))


SCANS: dict[str, Callable[[dict], tuple[list, Callable]]] = {
    "ema": lambda p: _chain([_ema(p["period"])], [_close], lambda bars, made, runs: {"": made[0]}),
    "ema_slope": lambda p: _chain([_ema(p["period"])], [_close], lambda bars, made, runs: {"": _slope(made[0], p["lag"], runs)}),
    "rsi": lambda p: _chain([Average(1, p["period"], 1 / p["period"])] * 2, [lambda bars, made: np.maximum(bars["step"], 0.0), lambda bars, made: np.maximum(-bars["step"], 0.0)], _rsi_of),
    "macd": lambda p: _chain(
        [_ema(p["fast_period"]), _ema(p["slow_period"]), Average(p["slow_period"] - 1, p["signal_period"], 2 / (p["signal_period"] + 1))],
        [_close, _close, lambda bars, made: np.nan_to_num(made[0] - made[1])],
        _macd_of,
    ),
    "atr": lambda p: _chain([Average(0, p["period"], 1 / p["period"])], [lambda bars, made: bars["tr"]], lambda bars, made, runs: {"": made[0]}),
    "natr": lambda p: _chain([Average(0, p["period"], 1 / p["period"])], [lambda bars, made: bars["tr"]], _natr_of),
    "obv": lambda p: _chain([Sum()], [lambda bars, made: np.sign(bars["step"]) * bars["volume"]], lambda bars, made, runs: {"": made[0]}),
}
#: The columns that scans read, in the order in which they are handed over, after the place of a row in its series.
INPUTS = ["close", "_prev", "_tr", "volume"]


class Scans:
    """The scans of several indicators as one, with one row of states for all."""

    def __init__(self, specs: list):
        self.plans = [(s, *SCANS[s.name](s.p)) for s in specs]
        self.sizes = [sum(part.size for part in parts) for _, parts, _ in self.plans]
        self.size = sum(self.sizes)
        #: Candles before a row whose values its own value needs besides the state.
        self.lead = max((s.p.get("lag", 0) for s in specs), default=0)
        #: The place from which on all averages have their seeds, so that the map of a run depends on its length alone.
        self.seeded = max((part.begin + part.period for _, parts, _ in self.plans for part in parts if isinstance(part, Average)), default=0)
        self.names = [c for s in specs for c in s.columns()] + [f"{s.name}_bad" for s in specs]

    def run(self, bars: dict, runs: Runs, state: np.ndarray) -> tuple[dict, np.ndarray]:
        more, after, at = {}, [], 0
        for (s, _, run), n in zip(self.plans, self.sizes):
            made, own = run(bars, runs, state[:, at : at + n])
            more[f"{s.name}_bad"] = np.broadcast_to(made.pop("invalid", False), runs.n)
            more |= {f"{s.name}_{c}" if c else s.name: v for c, v in made.items()}
            after.append(own)
            at += n
        return more, np.concatenate(after, axis=1)


def bars_of(close: pd.Series, prev: pd.Series, tr: pd.Series, volume: pd.Series) -> dict:
    """The arrays that scans read, from the columns ``INPUTS``."""
    close_ = close.to_numpy(float)
    return {"close": close_, "step": close_ - prev.fillna(close).to_numpy(float), "tr": tr.to_numpy(float), "volume": volume.to_numpy(float)}


def streamed(scans: Scans, batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """The scans' columns for the rows of whole series, one series after the other in time order, in batches that may end anywhere.

    Instead of whole series there may be blocks of some; then a last column has the states at a block's begin, and null in
    its other rows.  Of the run that a batch ends in, the last ``lead`` candles and the state before them are kept.  Rows
    out of order raise.
    """
    before, tail, state = -1, None, np.zeros(scans.size)
    for place, *columns in batches:
        place, bars = place.to_numpy(), bars_of(*columns[: len(INPUTS)])
        if not len(place):
            yield pd.DataFrame({c: [] for c in scans.names})
            continue
        given = columns[len(INPUTS)] if len(columns) > len(INPUTS) else None
        begins = place == 0 if given is None else given.notna().to_numpy()
        if ((place != np.append(before, place[:-1]) + 1) & ~begins).any():
            raise RuntimeError("the candles of a series came out of order")
        starts = np.flatnonzero(begins)
        states = np.zeros((len(starts), scans.size)) if given is None or not len(starts) else np.stack(given.iloc[starts].to_numpy())
        held = 0
        if not begins[0]:
            held = len(tail[0])
            place, bars = np.append(tail[0], place), {k: np.append(tail[1][k], v) for k, v in bars.items()}
            starts, states = np.append(0, starts + held), np.concatenate((state[None, :], states))
        made, after = scans.run(bars, Runs(place, starts), states)
        yield pd.DataFrame({c: made[c][held:] for c in scans.names})
        low, high = int(starts[-1]), max(int(starts[-1]), len(place) - scans.lead)
        if high == len(place):
            state = after[-1]
        elif high > low:
            cut = {k: v[low:high] for k, v in bars.items()}
            state = scans.run(cut, Runs(place[low:high], np.zeros(1, dtype=int)), states[-1:])[1][0]
        else:
            state = states[-1]
        before, tail = place[-1], (place[high:], {k: v[high:] for k, v in bars.items()})
