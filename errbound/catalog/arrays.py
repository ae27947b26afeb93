"""Dense arrays: stencils, regression, predictor choice, sampling, transposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errbound.catalog.tables import CELLS_SQL, slabs, table
from errbound.functions import quantizer as qz
from errbound.operators import blocks, sampling, stencil, transforms
from errbound.operators.encoders import histogram

EB = 0.005
BLOCK = 6


def _rank_dims(rank: int) -> list[int]:
    """Extents of the slice by rank; extent 0 stands for the open slowest dimension."""
    return {2: [0, 64], 3: [0, 8, 8], 4: [0, 4, 4, 4]}[rank]


def _grid_slabs(spark, sf_dir) -> DataFrame:
    """Values snapped to a uniform grid first: integer stencils need no recurrence."""
    rows = slabs(spark, sf_dir)
    origin = rows.agg(F.min(F.array_min("row")).alias("_o"))
    snapped = F.transform("row", lambda v: qz.grid_index(v, F.col("_o"), EB).cast("double"))
    return rows.crossJoin(F.broadcast(origin)).select("i0", snapped.alias("row"))


_GRID_SQL = f"""{CELLS_SQL}, g AS (
  SELECT i0, p, CAST(CAST(floor((v - (SELECT min(v) FROM cells)) / {EB!r}::DOUBLE) AS BIGINT) // 2 AS DOUBLE) AS v
  FROM cells)"""


def _axis_keys(rank: int) -> list[str]:
    return {2: ["i0", "p"], 3: ["i0", "p // 8", "p % 8"],
            4: ["i0", "p // 16", "(p // 4) % 4", "p % 4"]}[rank]


def _residual_sql(rank: int, layers: int, source: str = "g", out: str = "residual", axes=None) -> tuple[str, str]:
    """CTE chain that differences along each axis in turn; returns (ctes, last name)."""
    keys, ctes, last = _axis_keys(rank), [], source
    for a in axes if axes is not None else range(rank):
        part = ", ".join(k for b, k in enumerate(keys) if b != a)
        w = f"OVER (PARTITION BY {part} ORDER BY {keys[a]})"
        expr = f"v - coalesce(lag(v) {w}, 0)" if layers == 1 else \
            f"v - 2 * coalesce(lag(v) {w}, 0) + coalesce(lag(v, 2) {w}, 0)"
        name = f"{source}_d{a}_{layers}"
        ctes.append(f"{name} AS (SELECT i0, p, {expr} AS v FROM {last})")
        last = name
    return ", ".join(ctes), last


def _open(rank: int, layers: int, pred_dim: int | None = None):
    def run(spark, sf_dir):
        res = stencil.lorenzo_residual(_grid_slabs(spark, sf_dir), [], _rank_dims(rank), layers=layers,
                                       pred_dim=pred_dim, tile=128)
        cells = stencil.explode_slab(res, [], {"residual": "residual"})
        return cells.select("i0", "p", F.col("residual").cast("bigint").alias("residual"))

    axes = None if pred_dim is None else list(range(rank))[rank - pred_dim:]
    ctes, last = _residual_sql(rank, layers, axes=axes)
    sql = f"WITH {_GRID_SQL}, {ctes} SELECT i0, p, CAST(v AS BIGINT) AS residual FROM {last}"
    return run, sql


def residual_hist(spark, sf_dir):
    run, _ = _open(3, 1)
    return histogram(run(spark, sf_dir), [], "residual")


RESIDUAL_HIST_SQL = _open(3, 1)[1].replace(
    "SELECT i0, p, CAST(v AS BIGINT) AS residual FROM", "SELECT CAST(v AS BIGINT) AS residual, count(*) AS freq FROM"
) + " GROUP BY 1"


def _dims3(spark, sf_dir) -> list[int]:
    """Extents of the 3-D view; the open extent comes from one footer-level aggregate."""
    top = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    return [int(top) + 1, 8, 8]


def _cells3(spark, sf_dir, cols: dict[str, str] | None = None, rows: DataFrame | None = None) -> DataFrame:
    rows = slabs(spark, sf_dir) if rows is None else rows
    cells = stencil.explode_slab(rows, [], cols or {"row": "v"})
    return cells.withColumn("i1", F.floor(F.col("p") / 8)).withColumn("i2", F.col("p") % 8)


def _blocked(spark, sf_dir) -> DataFrame:
    return blocks.with_blocks(_cells3(spark, sf_dir), _dims3(spark, sf_dir), BLOCK)


_BLOCKS_SQL = f"""{CELLS_SQL}, n AS (SELECT max(vec_id) + 1 AS n0 FROM embeddings), bl AS (
  SELECT i0, p, v, p // 8 AS i1, p % 8 AS i2, i0 // {BLOCK} AS b0, (p // 8) // {BLOCK} AS b1, (p % 8) // {BLOCK} AS b2,
    i0 % {BLOCK} AS l0, (p // 8) % {BLOCK} AS l1, (p % 8) % {BLOCK} AS l2,
    least({BLOCK}, n0 - (i0 // {BLOCK}) * {BLOCK}) AS d0,
    least({BLOCK}, 8 - ((p // 8) // {BLOCK}) * {BLOCK}) AS d1,
    least({BLOCK}, 8 - ((p % 8) // {BLOCK}) * {BLOCK}) AS d2 FROM cells, n)"""

_COEF_SQL = f"""{_BLOCKS_SQL}, sm AS (
  SELECT b0, b1, b2, any_value(d0) AS d0, any_value(d1) AS d1, any_value(d2) AS d2, count(*) AS n,
    sum(v) AS s, sum(v * l0) AS s0, sum(v * l1) AS s1, sum(v * l2) AS s2 FROM bl GROUP BY b0, b1, b2),
sl AS (SELECT *, (2 * s0 / (d0 - 1) - s) * 6 / n / (d0 + 1) AS c0, (2 * s1 / (d1 - 1) - s) * 6 / n / (d1 + 1) AS c1,
    (2 * s2 / (d2 - 1) - s) * 6 / n / (d2 + 1) AS c2 FROM sm WHERE d0 > 1 AND d1 > 1 AND d2 > 1),
co AS (SELECT b0, b1, b2, n, c0, c1, c2,
    s / n - (d0 - 1) * c0 / 2 - (d1 - 1) * c1 / 2 - (d2 - 1) * c2 / 2 AS c3 FROM sl)"""


def regression_coeffs(spark, sf_dir):
    co = blocks.regression_coefficients(_blocked(spark, sf_dir), [], 3)
    return co.select("b0", "b1", "b2", "n", *[F.round(f"c{k}", 7).alias(f"c{k}") for k in range(4)])


REGRESSION_COEFFS_SQL = f"""WITH {_COEF_SQL} SELECT b0, b1, b2, n, round(c0, 7) AS c0, round(c1, 7) AS c1,
  round(c2, 7) AS c2, round(c3, 7) AS c3 FROM co"""


def regression_predict(spark, sf_dir):
    cells = _blocked(spark, sf_dir)
    fitted = blocks.regression_predict(cells, blocks.regression_coefficients(cells, [], 3), [], 3)
    return fitted.select("i0", "p", F.round("reg_pred", 7).alias("reg_pred"))


REGRESSION_PREDICT_SQL = f"""WITH {_COEF_SQL} SELECT i0, p, round(l0 * c0 + l1 * c1 + l2 * c2 + c3, 7) AS reg_pred
FROM bl LEFT JOIN co USING (b0, b1, b2)"""


def poly_sums(spark, sf_dir):
    sums = blocks.poly_sums(_blocked(spark, sf_dir), [], 3)
    return sums.select("b0", "b1", "b2", *[F.round(f"s{k}", 6).alias(f"s{k}") for k in range(10)])


_MONO = ["1", "l0", "l1", "l2", "l0*l0", "l0*l1", "l0*l2", "l1*l1", "l1*l2", "l2*l2"]
POLY_SUMS_SQL = (f"WITH {_BLOCKS_SQL} SELECT b0, b1, b2, "
                 + ", ".join(f"round(sum(v * {m}), 6) AS s{k}" for k, m in enumerate(_MONO))
                 + " FROM bl WHERE d0 > 2 AND d1 > 2 AND d2 > 2 GROUP BY b0, b1, b2")


def poly_fit(spark, sf_dir):
    """Quadratic fit: its residual is orthogonal to the basis, which is what makes it least squares."""
    cells = _blocked(spark, sf_dir)
    coefs = blocks.poly_coefficients(blocks.poly_sums(cells, [], 3), [], _dims3(spark, sf_dir), BLOCK)
    fitted = blocks.poly_predict(cells, coefs, [], 3).where(F.col("poly_pred").isNotNull())
    err = F.col("v") - F.col("poly_pred")
    checks = [F.abs(F.sum(err * F.expr(m))) < 1e-6 for m in _MONO]
    ok = checks[0]
    for c in checks[1:]:
        ok = ok & c
    return fitted.groupBy("b0", "b1", "b2").agg(F.count(F.lit(1)).alias("n"), ok.alias("orthogonal"))


POLY_FIT_SQL = f"""WITH {_BLOCKS_SQL} SELECT b0, b1, b2, count(*) AS n, true AS orthogonal
FROM bl WHERE d0 > 2 AND d1 > 2 AND d2 > 2 GROUP BY b0, b1, b2"""


def _with_candidates(spark, sf_dir) -> DataFrame:
    dims = _dims3(spark, sf_dir)
    res = stencil.lorenzo_residuals(slabs(spark, sf_dir), [], dims, {"r1": 1, "r2": 2}, tile=128)
    cells = _cells3(spark, sf_dir, {"row": "v", "r1": "r1", "r2": "r2"}, res)
    cells = blocks.with_blocks(cells, dims, BLOCK)
    coefs = blocks.regression_coefficients(cells, [], 3)
    return blocks.regression_predict(cells, coefs, [], 3)


def _errors(spark, sf_dir, visits) -> DataFrame:
    v = F.col("v")
    return blocks.predictor_errors(
        _with_candidates(spark, sf_dir), [], 3, EB,
        {"lorenzo": v - F.col("r1"), "lorenzo2": v - F.col("r2"), "regression": F.col("reg_pred")}, visits,
        {"lorenzo": blocks.lorenzo_noise(3, 1), "lorenzo2": blocks.lorenzo_noise(3, 2)})


def predictor_select(spark, sf_dir):
    err = _errors(spark, sf_dir, blocks.on_diagonals(3))
    return err.select("b0", "b1", "b2", *[F.round(f"err_{n}", 6).alias(f"err_{n}")
                                          for n in ("lorenzo", "lorenzo2", "regression")],
                      blocks.argmin_first(["lorenzo", "lorenzo2", "regression"]).alias("sid"))


def predictor_select_fast(spark, sf_dir):
    err = _errors(spark, sf_dir, blocks.on_diagonals_fast3d())
    return err.select("b0", "b1", "b2", blocks.fast3d_choice().alias("sid"))


def selection_hist(spark, sf_dir):
    return blocks.selection_histogram(predictor_select(spark, sf_dir))


def _select_sql(fast: bool) -> str:
    c1, l1 = _residual_sql(3, 1, "cells")
    c2, l2 = _residual_sql(3, 2, "cells")
    m = "least(d0, d1, d2)"
    if fast:
        terms = [f"CASE WHEN l0 >= 2 AND l0 < {m} - 1 AND l1 = {('l0', f'{m} - l0')[j]} AND l2 = {('l0', f'{m} - l0')[k]} THEN 1 ELSE 0 END"
                 for j in (0, 1) for k in (0, 1)]
        terms.append(f"CASE WHEN {m} > 3 AND l0 = {m} - 1 AND l1 = {m} - 1 AND l2 = {m} - 1 THEN 1 ELSE 0 END")
    else:
        terms = [f"CASE WHEN l0 < {m} - 2 AND l1 = {('l0', f'{m} - 1 - l0')[j]} AND l2 = {('l0', f'{m} - 1 - l0')[k]} THEN 1 ELSE 0 END"
                 for j in (0, 1) for k in (0, 1)]
    pick = ("CASE WHEN er <= el AND er < el2 THEN 1 WHEN el2 <= el AND el2 <= er THEN 2 ELSE 0 END" if fast else
            "CASE WHEN el <= el2 AND el <= er THEN 0 WHEN el2 <= er THEN 1 ELSE 2 END")
    return f"""WITH {_COEF_SQL}, {c1}, {c2}, sa AS (
  SELECT bl.*, {' + '.join(terms)} AS k FROM bl),
er AS (SELECT sa.b0, sa.b1, sa.b2,
    sum(k * (abs(sa.v - (sa.v - a.v)) + 1.22::DOUBLE * {EB!r}::DOUBLE)) AS el,
    sum(k * (abs(sa.v - (sa.v - b.v)) + 6.8::DOUBLE * {EB!r}::DOUBLE)) AS el2,
    coalesce(sum(k * abs(sa.v - (l0 * c0 + l1 * c1 + l2 * c2 + c3))), 'Infinity'::DOUBLE) AS er
  FROM sa JOIN {l1} a USING (i0, p) JOIN {l2} b USING (i0, p) LEFT JOIN co USING (b0, b1, b2)
  WHERE k > 0 GROUP BY sa.b0, sa.b1, sa.b2),
ch AS (SELECT b0, b1, b2, round(el, 6) AS err_lorenzo, round(el2, 6) AS err_lorenzo2,
    round(er, 6) AS err_regression, {pick} AS sid FROM er)"""


def transpose(spark, sf_dir):
    dims = _dims3(spark, sf_dir)
    cells = _cells3(spark, sf_dir).select((F.col("i0") * 64 + F.col("p")).alias("idx"), "v")
    return transforms.transpose(cells, dims, [2, 0, 1], out="t").select("idx", "t", "v")


TRANSPOSE_SQL = f"""WITH {CELLS_SQL}, n AS (SELECT max(vec_id) + 1 AS n0 FROM embeddings)
SELECT i0 * 64 + p AS idx, (p % 8) * n0 * 8 + i0 * 8 + p // 8 AS t, v FROM cells, n"""


def grid_sample(spark, sf_dir):
    """Corner-block sample of the 2-D view (edge 64, block from the share rule)."""
    n0 = _dims3(spark, sf_dir)[0]
    dims = [n0, 64]
    b = sampling.sample_block(dims) or 3
    cells = stencil.explode_slab(slabs(spark, sf_dir), [], {"row": "v"})
    return cells.where(sampling.in_grid_sample([F.col("i0"), F.col("p")], dims, b)).select("i0", "p", "v")


GRID_SAMPLE_SQL = f"""WITH {CELLS_SQL}, n AS (SELECT max(vec_id) + 1 AS n0 FROM embeddings)
SELECT i0, p, v FROM cells, n WHERE i0 < n0 // 64 * 64
  AND (i0 % 64 BETWEEN 3 AND 5 OR i0 % 64 BETWEEN 58 AND 60) AND (p BETWEEN 3 AND 5 OR p BETWEEN 58 AND 60)"""


def quant_interval_est(spark, sf_dir):
    """Quantizer range from the Lorenzo errors of the whole 3-D array."""
    res = stencil.lorenzo_residual(slabs(spark, sf_dir), [], _rank_dims(3), tile=128)
    err = F.abs("residual")
    cells = stencil.explode_slab(res, [], {"residual": "residual"})
    return sampling.quant_intervals(histogram(cells.select(sampling.error_bin(err, EB).alias("bin")), [], "bin"))


def _quant_interval_sql() -> str:
    ctes, last = _residual_sql(3, 1, "cells")
    return f"""WITH {CELLS_SQL}, {ctes}, h AS (
  SELECT least(CAST(floor((abs(v) / {EB!r}::DOUBLE + 1) / 2) AS BIGINT), 32767) AS bin, count(*) AS freq FROM {last} GROUP BY 1),
c AS (SELECT bin, sum(freq) OVER (ORDER BY bin) AS cum, sum(freq) OVER () AS n FROM h),
i AS (SELECT CAST(max(n) AS BIGINT) AS samples, min(CASE WHEN cum > floor(n * 0.999) THEN bin END) AS i FROM c)
SELECT samples, greatest(32, 2 * CAST(pow(2, ceil(log2(2 * (i + 1)))) AS BIGINT)) AS intervals FROM i"""


def mean_freq(spark, sf_dir):
    """Mode of adjacent value bins around a rough mean."""
    cells = _cells3(spark, sf_dir)
    rough = sampling.rough_mean(cells.select((F.col("i0") * 64 + F.col("p")).alias("idx"), "v"), "idx", "v",
                                _dims3(spark, sf_dir)).select(F.col("rough_mean").alias("rm"))
    both = cells.crossJoin(F.broadcast(rough))
    hist = histogram(both.select(sampling.mean_bin(F.col("v"), F.round("rm", 9), EB).alias("bin")), [], "bin")
    best = sampling.mean_frequency(hist, F.lit(0.0), EB)
    return best.crossJoin(F.broadcast(rough)).select(
        "samples", "bin", F.round("mean_freq", 9).alias("mean_freq"),
        F.round(F.round("rm", 9) + F.col("mean_guess"), 7).alias("mean_guess"))


MEAN_FREQ_SQL = f"""WITH {CELLS_SQL}, n AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*))) AS BIGINT) AS st FROM cells),
w AS (SELECT k * st - k // CAST(ceil(8 / st) AS BIGINT) - k // CAST(ceil(64 / st) AS BIGINT) AS idx
  FROM n, unnest(range(100000)) AS t(k)),
r AS (SELECT round(avg(v), 9) AS rm FROM cells JOIN w ON w.idx = i0 * 64 + p),
b AS (SELECT least(greatest(CASE WHEN v - rm > 0 THEN CAST(floor((v - rm) / {EB!r}::DOUBLE) AS BIGINT) + 4096
    ELSE CAST(ceil((v - rm) / {EB!r}::DOUBLE) AS BIGINT) - 1 + 4096 END, 0), 8191) AS bin FROM cells, r),
h AS (SELECT bin, count(*) AS f FROM b GROUP BY bin),
k AS (SELECT bin FROM h UNION SELECT bin - 1 FROM h),
p AS (SELECT k.bin, coalesce(a.f, 0) + coalesce(c.f, 0) AS pair FROM k LEFT JOIN h a ON a.bin = k.bin
  LEFT JOIN h c ON c.bin = k.bin + 1 WHERE k.bin >= 1 AND k.bin < 8190),
t AS (SELECT * FROM p ORDER BY pair DESC, bin LIMIT 1)
SELECT (SELECT count(*) FROM b) AS samples, bin, round(pair / (SELECT count(*) FROM b)::DOUBLE, 9) AS mean_freq,
  round(rm + {EB!r}::DOUBLE * (bin + 1 - 4096), 7) AS mean_guess FROM t, r"""


def wavelet_roundtrip(spark, sf_dir):
    """Daubechies-4 forward and inverse; an orthogonal transform keeps the energy."""
    rows = slabs(spark, sf_dir).withColumn("w", transforms.wavelet("row"))
    back = rows.withColumn("b", transforms.wavelet("w", inverse=True))

    def energy(col):
        return F.aggregate(col, F.lit(0.0), lambda acc, v: acc + v * v)

    worst = F.array_max(F.zip_with("row", "b", lambda a, b: F.abs(a - b)))
    return back.select("i0", F.size("w").alias("n"), (worst < 1e-9).alias("same"),
                       (F.abs(energy("row") - energy("w")) < 1e-9).alias("energy_kept"))


WAVELET_SQL = "SELECT vec_id AS i0, CAST(len(embedding) AS INT) AS n, true AS same, true AS energy_kept FROM embeddings"


QUERIES = {
    "wavelet": (wavelet_roundtrip, WAVELET_SQL),
    "lorenzo2d_open": _open(2, 1),
    "lorenzo2d_2nd_open": _open(2, 2),
    "lorenzo3d_open": _open(3, 1),
    "lorenzo3d_2nd_open": _open(3, 2),
    "lorenzo4d_open": _open(4, 1),
    "lorenzo_pred_dim2_open": _open(3, 1, 2),
    "residual_hist": (residual_hist, RESIDUAL_HIST_SQL),
    "regression_coeffs": (regression_coeffs, REGRESSION_COEFFS_SQL),
    "regression_predict": (regression_predict, REGRESSION_PREDICT_SQL),
    "poly_sums": (poly_sums, POLY_SUMS_SQL),
    "poly_fit": (poly_fit, POLY_FIT_SQL),
    "predictor_select": (predictor_select, _select_sql(False)
                         + " SELECT b0, b1, b2, err_lorenzo, err_lorenzo2, err_regression, sid FROM ch"),
    "predictor_select_fast": (predictor_select_fast, _select_sql(True) + " SELECT b0, b1, b2, sid FROM ch"),
    "selection_hist": (selection_hist, _select_sql(False) + " SELECT sid, count(*) AS blocks FROM ch GROUP BY sid"),
    "transpose": (transpose, TRANSPOSE_SQL),
    "grid_sample": (grid_sample, GRID_SAMPLE_SQL),
    "quant_interval_est": (quant_interval_est, _quant_interval_sql()),
    "mean_freq": (mean_freq, MEAN_FREQ_SQL),
}
