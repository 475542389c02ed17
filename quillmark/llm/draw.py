"""Problem 1: samples that match target shares of categories, by the cube method.

Every candidate gets the inclusion probability that its cell's target (a real number) asks for. Flight phases move the
probabilities, balanced on the indicators of the cells, in bounded groups of each pool; what a group leaves unresolved (at
most one candidate per cell) merges upward until one group per pool is left. There the flight goes on, balanced on the
indicators of strata, of ground truths and of the whole draw, and the landing drops these one after another, so that
cells are rounded up and down in step; what imbalance is left is reported.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import written
from .lookalike import with_canonical

#: Candidates of one flight group on average, and groups that merge into one at each step upward.
GROUP, FAN_IN, SEED = 4096, 16, 42
_EPS = 1e-9


def _step(up: float, down: float, rng: np.random.Generator) -> float:
    """How far to go along a direction that can go `up` forwards and `down` backwards, so that probabilities are kept."""
    return up if rng.random() * (up + down) < down else -down


def fly_cells(pi: np.ndarray, cell: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase balanced on the indicators of disjoint cells: at the end at most one candidate of each is fractional.

    The null space of such indicators is spanned by pairs of one cell, so each cell has one open candidate at a time.
    """
    pi = pi.copy()
    open_: dict[int, int] = {}
    for i in np.flatnonzero((pi > _EPS) & (pi < 1 - _EPS)).tolist():
        j = open_.pop(cell[i], None)
        if j is not None:
            move = _step(min(1 - pi[i], pi[j]), min(pi[i], 1 - pi[j]), rng)
            for k, x in ((i, pi[i] + move), (j, pi[j] - move)):
                pi[k] = 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x
            i = i if 0 < pi[i] < 1 else j
        if 0 < pi[i] < 1:
            open_[cell[i]] = i
    return pi


def fly(pi: np.ndarray, marks: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase balanced on any variables: marks has a row of them for each candidate.

    Works on a window of J + 1 candidates, J the number of variables, and a vector of their null space; at the end at most J are fractional.
    """
    pi = pi.copy()
    waiting = np.flatnonzero((pi > _EPS) & (pi < 1 - _EPS))[::-1].tolist()
    window: list[int] = []
    while True:
        while waiting and len(window) <= marks.shape[1]:
            window.append(waiting.pop())
        if not window:
            return pi
        a = marks[window].T
        _, size, turned = np.linalg.svd(a) if a.shape[0] else (None, np.zeros(0), np.eye(len(window)))
        if len(window) <= (size > 1e-9).sum():
            return pi
        u, p = turned[-1], pi[window]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(u > _EPS, (1 - p) / u, np.where(u < -_EPS, -p / u, np.inf)))
            down = np.min(np.where(u > _EPS, p / u, np.where(u < -_EPS, (p - 1) / u, np.inf)))
        p = p + _step(up, down, rng) * u
        p[p < _EPS], p[p > 1 - _EPS] = 0.0, 1.0
        pi[window] = p
        window = [i for i, x in zip(window, p) if 0 < x < 1]


def land(pi: np.ndarray, stratum: np.ndarray, truth: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """All candidates settled: flights balanced on the whole draw, the ground truths and the strata, of which the last is dropped each time."""
    left = np.flatnonzero((pi > 0) & (pi < 1))
    if not len(left):
        return pi
    sides = [np.ones((len(left), 1)), *(np.unique(x[left], return_inverse=True)[1][:, None] == np.arange(len(np.unique(x[left]))) for x in (truth, stratum))]
    marks = np.hstack(sides).astype(float)
    out = pi.copy()
    for j in range(marks.shape[1], -1, -1):
        out[left] = fly(out[left], marks[:, :j], rng)
    return out


def _land(pdf: pd.DataFrame) -> pd.DataFrame:
    return _moved(pdf, True)


def _fly(pdf: pd.DataFrame) -> pd.DataFrame:
    return _moved(pdf, False)


def _moved(pdf: pd.DataFrame, last: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["turn", "sample_id"], kind="stable").reset_index(drop=True)
    rng = np.random.default_rng(int(pdf.turn.iloc[0]) & 0x7FFFFFFF)
    pi = fly_cells(pdf.pi.to_numpy(float), pdf.cell.to_numpy(), rng)
    return pdf.assign(pi=land(pi, pdf.stratum.to_numpy(), pdf.truth.to_numpy(), rng) if last else pi)


def cells_of(targets: DataFrame) -> DataFrame:
    """targets with `target` (how many samples, a real number), `needed` (the same as a whole number) and the normalised key `stratum_key`."""
    least, asked = F.coalesce("min_count", F.lit(0)), F.round(F.col("target_share") * F.col("draw_size"), 6)
    needed = F.greatest(least.cast("long"), F.floor(asked + F.lit(0.5)).cast("long"))
    target = F.greatest(least.cast("double"), asked)
    return targets.withColumn("needed", F.coalesce(needed, F.lit(0))).withColumn("target", F.coalesce(target, F.lit(0.0))).withColumn("stratum_key", _key(F.col("stratum_id")))


def _key(c):
    return F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def draw(manifest: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(drawn samples, report of all cells). manifest needs manifest_id, sample_id, stratum_id, ground_truth; targets the
    columns of draw_targets.

    drawn: (manifest_id, stratum_id, ground_truth, sample_id). report: (manifest_id, stratum_id, ground_truth, target,
    needed, pool, drawn, shortfall, residual, stratum_residual, truth_residual, draw_residual). shortfall is what a cell
    whose pool was drawn to the last sample lacks of `needed`; the residuals are samples drawn less inclusion
    probabilities, of the cell, of its stratum, of its ground truth and of the whole manifest.
    A null stratum, ground truth or sample id belongs to no cell; a sample delivered again counts once; a cell without
    candidates reports its whole need as shortfall; an empty pool or empty targets give no drawn rows.
    """
    cells = cells_of(targets)
    pool = with_canonical(manifest.select("manifest_id", "sample_id", "stratum_id", "ground_truth").dropna(), "stratum_id")
    pool = pool.select("manifest_id", "sample_id", _key(F.col("canon")).alias("stratum_key"), "ground_truth").distinct()
    at = ["manifest_id", "stratum_key", "ground_truth"]
    sizes = pool.groupBy(*at).agg(F.count("*").alias("pool"))
    cells = cells.join(sizes, at, "left").withColumn("pool", F.coalesce("pool", F.lit(0)))
    cells = written(cells.withColumn("cell", F.xxhash64("stratum_key", "ground_truth")), "cells")
    groups = cells.groupBy("manifest_id").agg(F.greatest(F.lit(1), F.ceil(F.sum("pool") / F.lit(GROUP))).cast("int").alias("groups"))
    # a cell that lacks samples gives all it has
    rate = F.when(F.col("pool") < F.col("needed"), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.try_divide(F.col("target"), F.col("pool").cast("double"))))
    units = pool.join(cells.select(*at, "cell", rate.alias("pi")), at).join(groups, "manifest_id")
    turn = F.xxhash64(F.lit(SEED), "manifest_id", "sample_id", "cell")
    units = units.select("manifest_id", "sample_id", "cell", F.xxhash64("stratum_key").alias("stratum"), F.col("ground_truth").cast("long").alias("truth"), "pi", turn.alias("turn"), F.pmod("turn", F.col("groups")).cast("int").alias("grp"))
    settled = units.where("pi = 0 or pi = 1").select("manifest_id", "sample_id", "cell", "pi")
    open_ = units.where("pi > 0 and pi < 1")
    kind = "manifest_id string, sample_id string, cell long, stratum long, truth long, pi double, turn long, grp int"
    most = groups.agg(F.max("groups")).first()[0] or 1
    parts = []
    while True:
        last = most <= 1
        flown = written(open_.groupBy("manifest_id", "grp").applyInPandas(_land if last else _fly, kind), "flight")
        parts.append(flown.where("pi = 0 or pi = 1").select("manifest_id", "sample_id", "cell", "pi"))
        if last:
            break
        open_ = flown.where("pi > 0 and pi < 1").withColumn("grp", F.floor(F.col("grp") / F.lit(FAN_IN)).cast("int"))
        most = -(-most // FAN_IN)
    for p in parts:
        settled = settled.unionByName(p)
    names = cells.select("manifest_id", "cell", "stratum_id", "ground_truth")
    taken = settled.where("pi = 1").join(names, ["manifest_id", "cell"]).select("manifest_id", "stratum_id", "ground_truth", "sample_id", "cell")
    count = taken.groupBy("manifest_id", "cell").agg(F.count("*").alias("drawn"))
    report = cells.join(count, ["manifest_id", "cell"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    report = report.withColumn("shortfall", F.when(F.col("drawn") == F.col("pool"), F.greatest(F.col("needed") - F.col("drawn"), F.lit(0))).otherwise(F.lit(0)))
    report = report.withColumn("residual", F.col("drawn") - F.coalesce(rate * F.col("pool"), F.lit(0.0)))
    sums = [("stratum_residual", ["manifest_id", "stratum_key"]), ("truth_residual", ["manifest_id", "ground_truth"]), ("draw_residual", ["manifest_id"])]
    for name, over in sums:
        report = report.withColumn(name, F.round(F.sum("residual").over(Window.partitionBy(*over)), 6))
    return taken.drop("cell"), report.select("manifest_id", "stratum_id", "ground_truth", "target", "needed", "pool", "drawn", "shortfall", F.round("residual", 6).alias("residual"), *(n for n, _ in sums))
