"""Blockwise regression, predictor sampling and per-block predictor choice, all as aggregations.

Input is one row per cell: ``keys, i0..i{N-1}, v``.  Blocks are ``i div B`` tiles, so a block never
holds more than ``B**N`` rows; edge blocks are smaller.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from errbound.operators.stencil import LORENZO_NOISE

# Block edge limits of the second-order regression by rank.
POLY_BLOCK_CAP = {1: 4096, 2: 64, 3: 16}


def axis_names(rank: int) -> list[str]:
    return [f"i{a}" for a in range(rank)]


def with_blocks(df: DataFrame, dims: list[int], block: int) -> DataFrame:
    """Add block numbers ``b*``, in-block coordinates ``l*`` and block extents ``d*``."""
    added = {}
    for a, n in enumerate(dims):
        i = F.col(f"i{a}")
        b = F.floor(i / F.lit(block))
        added[f"b{a}"] = b
        added[f"l{a}"] = i - b * block
        added[f"d{a}"] = F.least(F.lit(block), F.lit(n) - b * block)
    return df.withColumns(added)


def block_keys(rank: int) -> list[str]:
    return [f"b{a}" for a in range(rank)]


def regression_coefficients(cells: DataFrame, keys: list[str], rank: int, value: str = "v") -> DataFrame:
    """Closed-form linear fit of each block; blocks with an extent of one are left out (fallback).

    A block's extents follow from its cells, so one hash aggregation yields ``c0..c{N}``.
    """
    v = F.col(value)
    sums = cells.groupBy(*keys, *block_keys(rank)).agg(
        F.count(v).alias("n"), F.sum(v).alias("_s"),
        *[F.sum(v * F.col(f"l{a}")).alias(f"_s{a}") for a in range(rank)],
        *[F.first(f"d{a}").alias(f"d{a}") for a in range(rank)])
    sums = sums.where(reduce(lambda x, y: x & y, [F.col(f"d{a}") > 1 for a in range(rank)]))
    s, n = F.col("_s"), F.col("n")
    slopes = [(2 * F.col(f"_s{a}") / (F.col(f"d{a}") - 1) - s) * 6 / n / (F.col(f"d{a}") + 1)
              for a in range(rank)]
    level = s / n
    for a in range(rank):
        level = level - (F.col(f"d{a}") - 1) * slopes[a] / 2
    return sums.select(*keys, *block_keys(rank), "n", *[slopes[a].alias(f"c{a}") for a in range(rank)],
                       level.alias(f"c{rank}"))


def regression_predict(cells: DataFrame, coefs: DataFrame, keys: list[str], rank: int) -> DataFrame:
    """Attach the linear prediction of each cell; NULL where the block has no fit."""
    fitted = cells.join(coefs.drop("n"), keys + block_keys(rank), "left")
    pred = reduce(lambda x, y: x + y, [F.col(f"l{a}") * F.col(f"c{a}") for a in range(rank)]) + F.col(f"c{rank}")
    return fitted.withColumn("reg_pred", pred).drop(*[f"c{a}" for a in range(rank + 1)])


def monomials(rank: int) -> list[tuple[int, ...]]:
    """Exponent tuples of the quadratic basis: 1, the axes, then the products in index order."""
    rank = min(rank, 3)
    unit = [tuple(int(a == b) for b in range(rank)) for a in range(rank)]
    pairs = [tuple(x + y for x, y in zip(unit[a], unit[b])) for a in range(rank) for b in range(a, rank)]
    return [tuple([0] * rank), *unit, *pairs]


def _monomial(powers: tuple[int, ...]) -> Column:
    out = F.lit(1.0)
    for a, p in enumerate(powers):
        for _ in range(p):
            out = out * F.col(f"l{a}")
    return out


def poly_sums(cells: DataFrame, keys: list[str], rank: int, value: str = "v") -> DataFrame:
    """Sums of value times each quadratic monomial per block (extents above two only)."""
    basis = monomials(rank)
    sums = cells.groupBy(*keys, *block_keys(rank)).agg(
        *[F.sum(F.col(value) * _monomial(m)).alias(f"s{k}") for k, m in enumerate(basis)],
        *[F.first(f"d{a}").alias(f"d{a}") for a in range(rank)])
    return sums.where(reduce(lambda x, y: x & y, [F.col(f"d{a}") > 2 for a in range(rank)]))


def normal_inverse(extents: tuple[int, ...]) -> np.ndarray:
    """Inverse normal matrix of the quadratic basis on a block with these extents."""
    grid = [g.ravel() for g in np.indices(extents)]
    basis = np.stack([np.prod([g ** p for g, p in zip(grid, m)], axis=0) for m in monomials(len(extents))], 1)
    return np.linalg.inv(basis.T.astype(np.float64) @ basis)


def poly_coefficients(sums: DataFrame, keys: list[str], dims: list[int], block: int) -> DataFrame:
    """Quadratic fit per block from :func:`poly_sums`.

    Only 2**N block shapes exist (full or remainder along each axis), so the inverses are literals.
    """
    rank = len(dims)
    block = min(block, POLY_BLOCK_CAP[rank])
    edges = [sorted({min(block, n), n % block or block}) for n in dims]
    basis = monomials(rank)
    shapes = [tuple(s) for s in np.array(np.meshgrid(*edges, indexing="ij")).reshape(rank, -1).T]
    inverses = {s: normal_inverse(tuple(int(x) for x in s)) for s in shapes if min(s) > 2}

    def coefficient(m: int) -> Column:
        out = None
        for shape, inv in inverses.items():
            same = reduce(lambda x, y: x & y, [F.col(f"d{a}") == int(shape[a]) for a in range(rank)])
            dot = reduce(lambda x, y: x + y, [F.lit(float(inv[m, j])) * F.col(f"s{j}") for j in range(len(basis))])
            out = F.when(same, dot) if out is None else out.when(same, dot)
        return out

    return sums.select(*keys, *block_keys(rank), *[coefficient(m).alias(f"p{m}") for m in range(len(basis))])


def poly_predict(cells: DataFrame, coefs: DataFrame, keys: list[str], rank: int) -> DataFrame:
    basis = monomials(rank)
    fitted = cells.join(coefs, keys + block_keys(rank), "left")
    pred = reduce(lambda x, y: x + y, [F.col(f"p{k}") * _monomial(m) for k, m in enumerate(basis)])
    return fitted.withColumn("poly_pred", pred).drop(*[f"p{k}" for k in range(len(basis))])


def on_diagonals(rank: int) -> Column:
    """How often the block sampler visits a cell.

    It walks the 2**(N-1) space diagonals of the block's leading cube, leaving out the last two steps.
    A cell where diagonals cross counts once per diagonal.
    """
    m = reduce(F.least, [F.col(f"d{a}") for a in range(rank)]) if rank > 1 else F.col("d0")
    if rank == 1:
        return (F.col("l0") == 0).cast("int") + (F.col("l0") == m - 1).cast("int")
    visits = F.lit(0)
    step = F.col("l0")
    for signs in range(2 ** (rank - 1)):
        hit = step < m - 2
        for a in range(1, rank):
            target = m - 1 - step if signs >> (a - 1) & 1 else step
            hit = hit & (F.col(f"l{a}") == target)
        visits = visits + hit.cast("int")
    return visits


def on_diagonals_fast3d() -> Column:
    """Visits of the fast 3-D sampler: steps 2 .. m-2 of four diagonals plus the far corner."""
    m = F.least("d0", "d1", "d2")
    i, j, k = F.col("l0"), F.col("l1"), F.col("l2")
    inside = (i >= 2) & (i < m - 1)
    visits = F.lit(0)
    for flip_j in (False, True):
        for flip_k in (False, True):
            hit = inside & (j == (m - i if flip_j else i)) & (k == (m - i if flip_k else i))
            visits = visits + hit.cast("int")
    corner = (m > 3) & (i == m - 1) & (j == m - 1) & (k == m - 1)
    return visits + corner.cast("int")


def predictor_errors(cells: DataFrame, keys: list[str], rank: int, eb: float, predictors: dict[str, Column],
                     visits: Column, noise: dict[str, float] | None = None) -> DataFrame:
    """Sampled absolute error of each predictor per block, plus its expected closed-loop noise."""
    noise = noise or {}
    v, times = F.col("v"), F.col("_visits")
    sampled = cells.withColumn("_visits", visits).where("_visits > 0")
    return sampled.groupBy(*keys, *block_keys(rank)).agg(*[
        F.sum(times * (F.abs(v - pred) + F.lit(noise.get(name, 0.0) * eb))).alias(f"err_{name}")
        for name, pred in predictors.items()])


def lorenzo_noise(rank: int, layers: int) -> float:
    return LORENZO_NOISE[(layers, rank)]


def argmin_first(names: list[str]) -> Column:
    """Position of the smallest ``err_{name}``; the first wins ties, NULL never wins."""
    packed = [F.struct(F.coalesce(F.col(f"err_{n}"), F.lit(math.inf)).alias("e"), F.lit(k).alias("k"))
              for k, n in enumerate(names)]
    return (F.least(*packed) if len(packed) > 1 else packed[0])["k"]


def fast3d_choice() -> Column:
    """0 Lorenzo, 1 regression, 2 two-layer Lorenzo."""
    lor, lor2, reg = F.col("err_lorenzo"), F.col("err_lorenzo2"), F.coalesce("err_regression", F.lit(math.inf))
    return (F.when((reg <= lor) & (reg < lor2), 1)
            .when((lor2 <= lor) & (lor2 <= reg), 2).otherwise(0))


def selection_histogram(choices: DataFrame, column: str = "sid") -> DataFrame:
    return choices.groupBy(column).agg(F.count(F.lit(1)).alias("blocks"))


def coefficient_bounds(kind: str, rank: int, eb: float, block: int) -> dict[str, float]:
    """Error bounds that the coefficients of a block are coded with."""
    if kind == "linear":
        return {"intercept": eb / (rank + 1), "slope": eb / (rank + 1) / block}
    if kind == "fast3d":
        slope = 0.1 * eb / 4 / block
        return {"slope": slope, "intercept": slope * block}
    return {"intercept": eb / 5 / block, "slope": eb / 20 / block, "square": eb / 100 / block}
