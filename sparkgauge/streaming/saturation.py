"""Over-saturation of a live run: what a run's state keeps is bounded by age and by a share of all points seen."""

from __future__ import annotations

from collections.abc import Iterator
from math import isnan, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.student import t_quantile_of, two_sided

STATE = "started_t array<double>, started_v array<double>, first_t array<double>, first_v array<double>, n_started long, n_first long"
VERDICT = "run_index long, at_s double, kind string, value double, n_started long, n_first long, n_late long, saturated boolean"


def rises(t: np.ndarray, v: np.ndarray, n: float, confidence: float, most_error: float) -> bool:
    """Whether the least-squares slope is positive with a relative margin below most_error; n stands for independent points."""
    if n <= 2 or not len(t):
        return False
    x, y = t - t.mean(), v - v.mean()
    sxx = max(float(x @ x), 1e-12)
    slope = float(x @ y) / sxx
    margin = t_quantile_of(two_sided(confidence), n - 2) * sqrt(max(float(y @ y) - slope * float(x @ y), 0.0) / (n - 2) / sxx) / max(slope, 1e-12)
    return slope > 0 and not isnan(margin) and margin < most_error


def kept(t: np.ndarray, v: np.ndarray, ever: int, now: float, ratio: float, age: float) -> tuple[np.ndarray, np.ndarray]:
    """The youngest points: at most a share of all ever seen, none older than age."""
    most = int(ever * ratio)
    t, v = t[len(t) - most :] if len(t) > most else t, v[len(v) - most :] if len(v) > most else v
    return t[now - t <= age], v[now - t <= age]


def saturation(points: DataFrame, least_s: float = 30.0, age_s: float = 120.0, most_error: float = 2.0, most_ttft_s: float = 2.5, ratio: float = 0.75, least: int = 5, confidence: float = 0.95) -> DataFrame:
    """A verdict at every point of a run, from points (run_index, t_s, kind, value), as operators.saturation gives them in batch.

    kind is `started` (value: requests in flight) or `first` (value: seconds to the first token); others and
    rows with nulls are ignored. A run is saturated after least_s seconds if most first tokens in the window are late and
    both series rise, or the first alone while fewer than `least` first tokens count. Seconds bound how many
    points count as independent. Points of a batch are taken in order of time, then of kind; one that comes a batch late counts from
    then on.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else ([], [], [], [], 0, 0)
        rows = pd.concat(list(batches)).dropna(subset=["t_s", "value"]).sort_values(["t_s", "kind"], kind="stable")
        series, ever, now = [[np.array(old[2 * k], float), np.array(old[2 * k + 1], float)] for k in range(2)], [old[4], old[5]], max((*old[0][-1:], *old[2][-1:]), default=0.0)
        out = []
        for t, kind, value in rows[rows["kind"].isin(("first", "started"))][["t_s", "kind", "value"]].itertuples(index=False):
            k, now = int(kind == "first"), max(now, t)
            series[k] = [np.append(a, x) for a, x in zip(series[k], (t, value), strict=True)]
            ever[k] += 1
            series = [[*kept(*x, n, now, ratio, age_s)] for x, n in zip(series, ever, strict=True)]
            (st, sv), (ft, fv) = series
            late, n_started, n_first = int((fv > most_ttft_s).sum()), min(now, len(st)), min(now, len(ft))
            over = now >= max(least_s, most_ttft_s) and len(ft) <= 2 * late and n_started >= least and rises(st, sv, n_started, confidence, most_error)
            over = over and (n_first < least or rises(ft, fv, n_first, confidence, most_error))
            out.append((key[0], t, kind, value, len(st), len(ft), late, bool(over)))
        state.update((*(x.tolist() for pair in series for x in pair), *ever))
        yield pd.DataFrame(out, columns=["run_index", "at_s", "kind", "value", "n_started", "n_first", "n_late", "saturated"])

    return points.groupBy("run_index").applyInPandasWithState(run, VERDICT, STATE, "append", GroupStateTimeout.NoTimeout)
