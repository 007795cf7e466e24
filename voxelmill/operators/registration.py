"""Rigid registration of pairs of sparse masks over a grid of losses and optimizers, one task for each pair and configuration.

The optimizers are short numpy forms of published methods (Powell's directions, limited-memory quasi-Newton steps with
finite differences, a covariance-adapting evolution strategy); they reach like overlaps, not like steps, as other forms.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOSSES = ("dsc", "soft_dice", "assd", "hd95")
OPTIMIZERS = ("powell", "lbfgsb", "cmaes")
#: Loss of a warp that leaves nothing.
PENALTY = 1e6
#: Steps of finite differences and first spreads, for translations and for rotations.
DIFFERENCES = np.array([0.3] * 3 + [0.01] * 3)
SPREADS = np.array([7.0] * 3 + [0.05] * 3)
SIGMA = 2.0
RESULT = "volume long, config string, dsc_start double, dsc_final double, loss_final double, n_feval int, converged boolean, params array<double>, error string"


def grid_points(shape: tuple[int, ...]) -> np.ndarray:
    return np.indices(shape).reshape(3, -1).T.astype(np.float64)


def rotation(rz: float, ry: float, rx: float) -> np.ndarray:
    cz, sz, cy, sy, cx, sx = np.cos(rz), np.sin(rz), np.cos(ry), np.sin(ry), np.cos(rx), np.sin(rx)
    about_z, about_y, about_x = np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]]), np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]), np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]])
    return about_z @ about_y @ about_x


def warped(volume: np.ndarray, pose: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The volume's values, interpolated linearly, where a pose (tz, ty, tx, rz, ry, rx) sends the grid's points."""
    centre = np.array(volume.shape) / 2
    back = rotation(*pose[3:]).T
    at = points @ back.T + (centre - back @ centre - back @ pose[:3])
    low = np.floor(at).astype(int)
    part = at - low
    out = np.zeros(len(points))
    for corner in np.ndindex(2, 2, 2):
        index = low + corner
        inside = np.all((index >= 0) & (index < volume.shape), axis=1)
        weight = np.prod(np.where(corner, part, 1 - part), axis=1)
        out[inside] += weight[inside] * volume[tuple(index[inside].T)]
    return out.reshape(volume.shape)


def smoothed(volume: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    kernel /= kernel.sum()
    for axis in range(3):
        padded = np.pad(volume, [(reach, reach) if a == axis else (0, 0) for a in range(3)], mode="symmetric" if volume.shape[axis] >= reach else "edge")
        volume = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1, axis=axis) @ kernel
    return volume


def dice(a: np.ndarray, b: np.ndarray) -> float:
    total = a.sum() + b.sum()
    return float(2 * np.logical_and(a, b).sum() / total) if total else 0.0


def edge_points(mask: np.ndarray) -> np.ndarray:
    padded = np.pad(mask, 1)
    full = np.ones_like(mask)
    for i, j, k in np.ndindex(3, 3, 3):
        full &= padded[i : i + mask.shape[0], j : j + mask.shape[1], k : k + mask.shape[2]]
    return np.argwhere(mask & ~full).astype(np.float64)


def nearest(a: np.ndarray, b: np.ndarray, block: int = 512) -> np.ndarray:
    """For each row of a its distance to the nearest row of b, in blocks."""
    squares = (b**2).sum(axis=1)
    return np.concatenate([np.sqrt(np.maximum(0, ((x**2).sum(axis=1)[:, None] - 2 * x @ b.T + squares).min(axis=1))) for x in (a[i : i + block] for i in range(0, len(a), block))])


def loss_of(name: str, fixed: np.ndarray, spacing: np.ndarray) -> Callable[[np.ndarray], float]:
    """The loss of a warped (continuous) moving mask against the fixed one."""
    edge = edge_points(fixed) * spacing
    soft = smoothed(fixed.astype(float))

    def surface(values: np.ndarray) -> float:
        other = edge_points(values > 0.5) * spacing
        if not len(other) or not len(edge):
            return PENALTY
        there, back = nearest(edge, other), nearest(other, edge)
        return float((there.sum() + back.sum()) / (len(there) + len(back))) if name == "assd" else float(max(np.percentile(there, 95), np.percentile(back, 95)))

    def soft_dice(values: np.ndarray) -> float:
        field = smoothed(values)
        total = field.sum() + soft.sum()
        return float(1 - 2 * (field * soft).sum() / total) if total else 1.0

    if name in ("assd", "hd95"):
        return surface
    if name == "soft_dice":
        return soft_dice
    if name == "dsc":
        return lambda values: 1 - dice(fixed, values > 0.5) if fixed.any() or (values > 0.5).any() else 0.0
    raise ValueError(f"unknown loss {name}")


def powell(f, x, steps: int) -> tuple[np.ndarray, bool]:
    """Line searches along directions that are replaced by the way gone in a round."""
    directions, best = list(np.diag(SPREADS)), f(x)
    for _ in range(steps):
        start, before = x.copy(), best
        for d in [*directions]:
            low, high = -1.0, 1.0
            for _ in range(6):  # golden sections
                a, b = high - 0.618 * (high - low), low + 0.618 * (high - low)
                low, high = (low, b) if f(x + a * d) < f(x + b * d) else (a, high)
            if (value := f(x + (low + high) / 2 * d)) < best:
                x, best = x + (low + high) / 2 * d, value
        if before - best < 1e-4:
            return x, True
        directions = [*directions[1:], x - start]
    return x, False


def lbfgs(f, x, steps: int) -> tuple[np.ndarray, bool]:
    slope = lambda x, value: np.array([(f(x + h * e) - value) / h for h, e in zip(DIFFERENCES, np.eye(6), strict=True)])
    best = f(x)
    g, past = slope(x, best), []
    for _ in range(steps):
        q, coefficients = g * SPREADS**2 if not past else g.copy(), []
        for s, y in reversed(past):
            coefficients.append((s @ q) / (s @ y))
            q = q - coefficients[-1] * y
        if past:
            s, y = past[-1]
            q = q * (s @ y) / (y @ y)
        for (s, y), c in zip(past, reversed(coefficients), strict=True):
            q = q + s * (c - (y @ q) / (s @ y))
        step = next((t for t in 0.5 ** np.arange(8) if f(x - t * q) < best - 1e-6), None)
        if step is None:
            return x, True
        new = x - step * q
        value = f(new)
        h = slope(new, value)
        if (new - x) @ (h - g) > 1e-12:
            past = [*past[-5:], (new - x, h - g)]
        x, g, best = new, h, value
    return x, False


def cmaes(f, x, steps: int, seed: int = 1) -> tuple[np.ndarray, bool]:
    random = np.random.default_rng(seed)
    mean, spread, covariance, best, at = x.copy(), 1.0, np.diag(SPREADS**2) / 9, f(x), x
    weights = np.log(5.5) - np.log(np.arange(1, 6))
    weights /= weights.sum()
    for _ in range(steps):
        points = random.multivariate_normal(mean, spread**2 * covariance, size=10)
        values = np.array([f(p) for p in points])
        order = np.argsort(values)[:5]
        moves = (points[order] - mean) / spread
        mean = mean + spread * weights @ moves
        covariance = 0.8 * covariance + 0.2 * (moves * weights[:, None]).T @ moves + 1e-10 * np.eye(6)
        improved = values[order[0]] < best
        if improved:
            best, at = values[order[0]], points[order[0]]
        spread *= 1.05 if improved else 0.85
        if spread < 1e-3:
            return at, True
    return at, False


SEARCHES = {"powell": powell, "lbfgsb": lbfgs, "cmaes": cmaes}


def register(masks: DataFrame, configs: DataFrame, fixed: str, moving: str, shape: tuple[int, ...], spacing=(1.0, 1.0, 1.0), steps: int = 100) -> DataFrame:
    """A row for each volume and configuration (loss, optimizer): the pose that lays the moving mask onto the fixed one.

    Searches begin at the difference of the centroids without rotation. A failing pair gives a row with its error. A
    volume's voxels must fit into a worker.
    """
    points = grid_points(shape)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        loss_name, optimizer = group["loss"].iloc[0], group["optimizer"].iloc[0]
        row = {"volume": group["volume"].iloc[0], "config": f"{loss_name}_{optimizer}", "dsc_start": None, "dsc_final": None, "loss_final": None, "n_feval": 0, "converged": False, "params": None, "error": None}
        try:
            grids = {side: np.zeros(shape, bool) for side in (fixed, moving)}
            for side, grid in grids.items():
                at = group.loc[group["side"] == side, ["z", "y", "x"]].to_numpy()
                grid[tuple(at.T)] = True
            goal, other = grids[fixed], grids[moving].astype(float)
            if not goal.any() or not other.any():
                raise ValueError("an empty mask")
            loss, calls = loss_of(loss_name, goal, np.array(spacing)), []

            def f(pose: np.ndarray) -> float:
                calls.append(loss(warped(other, pose, points)))
                return calls[-1]

            start = np.append(np.argwhere(goal).mean(axis=0) - np.argwhere(other > 0).mean(axis=0), np.zeros(3))
            pose, converged = SEARCHES[optimizer](f, start, steps)
            overlap = lambda pose: dice(goal, warped(other, pose, points) > 0.5)
            row |= {"dsc_start": overlap(start), "dsc_final": overlap(pose), "loss_final": round(loss(warped(other, pose, points)), 6), "n_feval": len(calls), "converged": bool(converged), "params": pose.tolist()}
        except (ValueError, IndexError, np.linalg.LinAlgError) as wrong:
            row["error"] = str(wrong)
        return pd.DataFrame([row])

    tasks = masks.filter(F.col("side").isin(fixed, moving)).crossJoin(F.broadcast(configs))  # a few configurations
    return tasks.groupBy("volume", "loss", "optimizer").applyInPandas(run, RESULT)


def grid(spark, losses=LOSSES, optimizers=OPTIMIZERS) -> DataFrame:
    return spark.createDataFrame([(a, b) for a in losses for b in optimizers], "loss string, optimizer string")
