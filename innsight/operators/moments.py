"""Elastic-net regression from moments: sums that merge, take a row out again, and are solved.

A row of an area is the vector ``v = (1, slots, missing, label)``. Slots are numeric features
(minus the area's median, 0 where missing), 0/1 flags and one-hot categories; ``missing`` marks
the numeric features without a value. The sum of ``v vᵀ`` over the labelled rows holds every
moment of the regression, for any value that missing features are filled with. Beside it stand
the counts around each median and around the label's threshold, so that medians, threshold and
benchmark are known without any one row as well. All of it is added up; nothing is sorted.

The state of an area is one flat array, so it travels as a column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

REG, ALPHA = 0.1, 0.5
SWEEPS, TOLERANCE = 5000, 1e-12
QUANTILE = 0.8


@dataclass(frozen=True)
class Layout:
    """Numeric features come first among the slots."""

    numerics: int
    slots: int

    @property
    def width(self) -> int:
        return 2 + self.slots + self.numerics

    def parts(self) -> dict[str, int]:
        m, top = self.numerics, self.width - 1
        return {
            "gram": self.width**2, "lower": m, "equal": m, "below": m, "above": m, "around": 4, "top": top, "at": top,
            "under": top,
        }


def views(state: np.ndarray, layout: Layout) -> dict[str, np.ndarray]:
    """The named parts of a flat state; ``around`` is the label's (lower, equal, below, above)."""
    out, at = {}, 0
    for name, size in layout.parts().items():
        out[name] = state[at : at + size]
        at += size
    out["gram"] = out["gram"].reshape(layout.width, layout.width)
    return out


def vectors(raw: np.ndarray, medians: np.ndarray, labels: np.ndarray, layout: Layout) -> np.ndarray:
    """The vectors ``v`` of rows whose missing numeric values are NaN; a missing label counts as 0."""
    m = layout.numerics
    numeric = raw[:, :m] - np.nan_to_num(medians)
    missing = np.isnan(numeric)
    return np.hstack([
        np.ones((len(raw), 1)), np.where(missing, 0.0, numeric), raw[:, m:], missing, np.nan_to_num(labels)[:, None],
    ])


def _counts(values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per column: values below and at zero, the greatest below and the least above; NaN is none."""
    low, high = values < 0, values > 0
    below = np.where(low, values, -np.inf).max(axis=0, initial=-np.inf)
    above = np.where(high, values, np.inf).min(axis=0, initial=np.inf)
    return low.sum(axis=0), (values == 0).sum(axis=0), below, above


def state_of(raw: np.ndarray, medians: np.ndarray, labels: np.ndarray, threshold: float, layout: Layout) -> np.ndarray:
    """The state of some rows of an area; rows without a label do not count."""
    known = ~np.isnan(labels)
    raw, labels = raw[known], labels[known]
    v = vectors(raw, medians, labels, layout)
    state = np.zeros(sum(layout.parts().values()))
    out = views(state, layout)
    out["gram"][:] = v.T @ v
    out["lower"][:], out["equal"][:], out["below"][:], out["above"][:] = _counts(raw[:, : layout.numerics] - np.nan_to_num(medians))
    distance = (labels - threshold)[:, None]
    out["around"][:] = [part[0] for part in _counts(distance)]
    distance = distance[:, 0]
    out["top"][:] = v[distance >= 0, :-1].sum(axis=0)
    out["at"][:] = v[distance == 0, :-1].sum(axis=0)
    out["under"][:] = v[distance == out["around"][2], :-1].sum(axis=0)
    return state


def merged(states: np.ndarray, layout: Layout) -> np.ndarray:
    """The state of all rows of several states of one area."""
    total = states.sum(axis=0)
    out, all_of = views(total, layout), [views(s, layout) for s in states]
    for name, pick in (("below", np.max), ("above", np.min)):
        out[name][:] = pick([v[name] for v in all_of], axis=0)
    under = max(v["around"][2] for v in all_of)
    out["around"][2:] = under, min(v["around"][3] for v in all_of)
    out["under"][:] = np.sum([v["under"] for v in all_of if v["around"][2] == under], axis=0)
    return total


def _shifted(rank_lost, values, lower, equal, below, above, whole_rank):
    """What an order statistic at zero becomes without one value; 0 where it stays.

    ``rank_lost`` says whether its rank is one less among the other values. A rank outside the
    values equal to zero, as a sketch over many rows may give, counts as the nearest of them.
    """
    rank = np.clip(whole_rank, lower + 1, np.maximum(lower + equal, lower + 1)) - rank_lost
    left_lower = lower - (values < 0)
    left_equal = equal - (values == 0)
    down, stays = rank <= left_lower, rank <= left_lower + left_equal
    out = np.where(down, below, np.where(stays, 0.0, above))
    return np.where(np.isnan(values) | ~np.isfinite(out), 0.0, out)


@dataclass
class Fit:
    """One regression per leading index: slots' coefficients and what explains a row by them.

    Coefficients and ``std`` belong to features scaled by their sample deviation. ``used`` marks
    slots that a model has: numeric features with a value and categories with a row.
    """

    n: np.ndarray
    beta: np.ndarray
    coef: np.ndarray
    fill: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    used: np.ndarray
    top_value: np.ndarray
    top_scaled: np.ndarray

    def scaled(self, values: np.ndarray) -> np.ndarray:
        """Standardised slots, 0 for a slot that never varies."""
        return np.where(self.std > 0, (values - self.mean) / np.where(self.std > 0, self.std, 1.0), 0.0)


def descend(corr: np.ndarray, target: np.ndarray, l1: np.ndarray, l2: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Elastic-net solutions by cyclic coordinate descent on correlations, many problems at once."""
    beta = start.copy()
    varies = np.einsum("bpp->bp", corr) > 0
    for _ in range(SWEEPS):
        moved = 0.0
        for k in range(beta.shape[1]):
            rho = target[:, k] - np.einsum("bp,bp->b", corr[:, k], beta) + corr[:, k, k] * beta[:, k]
            new = np.where(varies[:, k], np.sign(rho) * np.maximum(np.abs(rho) - l1, 0.0) / (1.0 + l2) + 0.0, 0.0)
            moved = max(moved, float(np.abs(new - beta[:, k]).max(initial=0.0)))
            beta[:, k] = new
        if moved < TOLERANCE:
            break
    return beta


def _solve(gram, fill, top, top_rows, medians, layout: Layout, categories: int, start, scale) -> Fit:
    """Fits from sums of ``v vᵀ`` with numeric gaps filled by ``fill`` (distance from the median)."""
    m, p = layout.numerics, layout.slots
    gram = gram.copy()
    gaps = slice(1 + p, 1 + p + m)
    gram[:, 1 : 1 + m, :] += fill[:, :, None] * gram[:, gaps, :]
    gram[:, :, 1 : 1 + m] += fill[:, None, :] * gram[:, :, gaps]
    n = gram[:, 0, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        moments = np.nan_to_num(gram / n[:, None, None])
    mean = moments[:, 0, :]
    cov = moments - mean[:, :, None] * mean[:, None, :]
    slots, y = slice(1, 1 + p), -1
    var = np.einsum("bpp->bp", cov)
    # what rounding leaves of a constant is not a deviation
    var = np.where(var > 1e-12 * scale, var, 0.0)
    sigma = np.sqrt(var)
    inverse = np.where(sigma > 0, 1.0 / np.where(sigma > 0, sigma, 1.0), 0.0)
    corr = cov * inverse[:, :, None] * inverse[:, None, :]
    diagonal = np.arange(p)
    square = corr[:, slots, slots].copy()
    square[:, diagonal, diagonal] = sigma[:, slots] > 0
    sigma_y = sigma[:, y]
    weight = np.where(sigma_y > 0, REG / np.where(sigma_y > 0, sigma_y, 1.0), 0.0)
    beta = descend(square, corr[:, slots, y], ALPHA * weight, (1 - ALPHA) * weight, start)
    beta = np.where((sigma_y > 0)[:, None], beta, 0.0)
    sample = np.sqrt(n / np.maximum(n - 1, 1))[:, None]
    middle = np.zeros((len(gram), p))
    middle[:, :m] = np.nan_to_num(medians)
    used = np.ones((len(gram), p), bool)
    used[:, :m] = n[:, None] - gram[:, 0, gaps] > 0
    used[:, p - categories : p - 1] = gram[:, 0, 1 + p - categories : p] > 0
    fit = Fit(
        n=n, beta=beta, coef=beta * sigma_y[:, None] * sample, fill=middle[:, :m] + fill,
        mean=mean[:, slots] + middle, std=sigma[:, slots] * sample, used=used, top_value=np.empty(0), top_scaled=np.empty(0),
    )
    counts = np.where(np.arange(p) < m, top_rows[:, None] - np.pad(top[:, gaps], ((0, 0), (0, p - m))), top_rows[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        average = np.where(counts > 0, top[:, slots] / counts + middle, np.nan)
    filled = average.copy()
    filled[:, :m] = np.where(np.isnan(average[:, :m]), fit.fill, average[:, :m])
    first = p - categories
    most = np.argmax(top[:, 1 + first : p], axis=1) if categories > 1 else np.zeros(len(top), int)
    shown = np.zeros((len(top), categories))
    if categories > 1:
        some = top[:, 1 + first : p].max(axis=1) > 0
        shown[some, most[some]] = 1.0
    filled[:, first:] = shown
    average[:, first:] = np.nan
    fit.top_value, fit.top_scaled = average, fit.scaled(filled)
    return fit


def fit_whole(state: np.ndarray, medians: np.ndarray, layout: Layout, categories: int) -> Fit:
    """The regression over all labelled rows of an area.

    The last ``categories`` slots are one-hot, sorted by name, the very last one for values that
    are not known.
    """
    part = views(state, layout)
    start = np.zeros((1, layout.slots))
    scale = np.zeros((1, layout.width))
    fill = np.zeros((1, layout.numerics))
    return _solve(part["gram"][None], fill, part["top"][None], part["top"][:1], medians, layout, categories, start, scale)


def fit_without(
    state: np.ndarray, medians: np.ndarray, threshold: float, layout: Layout, categories: int, beta: np.ndarray,
    raw: np.ndarray, labels: np.ndarray,
) -> Fit:
    """For each given row the regression without it, started from the whole area's solution.

    The row's own vector is taken out of the sums (a rank-one downdate); medians, threshold and
    benchmark move to the neighbouring value where its loss moves their rank. A row without a
    label was in no sum, so its regression is that of the whole area.
    """
    part, m = views(state, layout), layout.numerics
    known = ~np.isnan(labels)
    v = vectors(raw, medians, labels, layout)
    own = v * known[:, None]
    gram = part["gram"] - own[:, :, None] * own[:, None, :]
    numeric = np.where(known[:, None], raw[:, :m] - np.nan_to_num(medians), np.nan)
    rows = part["gram"][0, 0]
    filled = rows - part["gram"][0, 1 + layout.slots : -1]
    fill = _shifted(filled % 2 == 1, numeric, part["lower"], part["equal"], part["below"], part["above"], np.ceil(filled / 2))
    lower, equal, below, above = part["around"]
    rank = np.ceil(QUANTILE * rows)
    cut = _shifted(
        rank - np.ceil(QUANTILE * (rows - 1)) > 0, np.where(known, labels - threshold, np.nan), lower, equal, below, above, rank
    )
    top = np.where((cut < 0)[:, None], part["top"] + part["under"], np.where((cut > 0)[:, None], part["top"] - part["at"], part["top"]))
    top = top - own[:, :-1] * (np.nan_to_num(labels, nan=-np.inf) - threshold >= cut)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.nan_to_num(part["gram"][0] / rows)
    scale = np.nan_to_num(np.diagonal(part["gram"]) / max(rows, 1)) - mean**2
    start = np.repeat(beta[None], len(raw), axis=0)
    return _solve(gram, fill, top, top[:, 0], medians, layout, categories, start, np.maximum(scale, 0.0)[None])
