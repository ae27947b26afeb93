"""1-D series: bounds, quantization, closed-loop prediction, interpolation, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errbound.catalog.tables import (SERIES_SQL, placed_series, quantize_sql, recover_sql, series, table)
from errbound.config import Config, ErrorBoundMode
from errbound.functions import interpolators as ip
from errbound.functions import quantizer as qz
from errbound.functions import scalars
from errbound.operators import closed_loop, interp, stats, transforms
from errbound.operators.encoders import histogram
from errbound.operators.ordering import from_chunks, to_chunks, with_neighbours

EB = 0.5
RADIUS = 64
CHUNK = 32


def eb_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = stats.value_range(table(spark, sf_dir, "events"), [], "value")
    rows = []
    for mode in ErrorBoundMode:
        conf = Config(mode=mode, abs_bound=0.7, rel_bound=1e-3, psnr_bound=60.0, l2norm_bound=25.0)
        rows.append(F.struct(F.lit(mode.value).alias("mode"),
                             F.round(stats.resolve_bound(conf, F.col("v_range"), F.col("n")), 9).alias("eb")))
    return facts.select(F.explode(F.array(*rows)).alias("r")).select("r.mode", "r.eb")


EB_MODES_SQL = """
WITH f AS (SELECT max(value) - min(value) AS r, count(value) AS n FROM events)
SELECT mode, round(eb, 9) AS eb FROM (
  SELECT 'ABS' AS mode, 0.7::DOUBLE AS eb FROM f
  UNION ALL SELECT 'REL', 1e-3::DOUBLE * r FROM f
  UNION ALL SELECT 'PSNR', r * pow(10::DOUBLE, (60 + 10 * log10(1 - 2::DOUBLE / 3 * 0.99)) / -20) FROM f
  UNION ALL SELECT 'NORM', sqrt(3::DOUBLE / n) * 25 FROM f
  UNION ALL SELECT 'ABS_AND_REL', least(0.7::DOUBLE, 1e-3::DOUBLE * r) FROM f
  UNION ALL SELECT 'ABS_OR_REL', greatest(0.7::DOUBLE, 1e-3::DOUBLE * r) FROM f)"""


def value_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_range(table(spark, sf_dir, "events"), ["event_type"], "value")


VALUE_RANGES_SQL = """
SELECT event_type, min(value) AS v_min, max(value) AS v_max, max(value) - min(value) AS v_range,
       count(value) AS n FROM events GROUP BY event_type"""


def _open_loop(spark: SparkSession, sf_dir: str, eb: float, radius: int) -> DataFrame:
    near = with_neighbours(placed_series(spark, sf_dir), ["user_id"], "pos", ["value"], before=1, tile=CHUNK)
    pred = F.coalesce("value_m1", F.lit(0.0))
    return near.select("user_id", "pos", "value", pred.alias("pred"),
                       qz.quantize("value", pred, eb, radius).alias("q"))


def quant_open(spark, sf_dir):
    """Quantize against the preceding original and recover."""
    q = _open_loop(spark, sf_dir, EB, RADIUS)
    return q.select("user_id", "pos", "q",
                    F.round(qz.recover("q", "pred", EB, "value", RADIUS), 6).alias("recon"))


_OPEN_SQL = f"""WITH {SERIES_SQL}, o AS (
  SELECT user_id, pos, value, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY pos), 0) AS pred FROM s),
q AS (SELECT *, {quantize_sql('value', 'pred', EB, RADIUS)} AS q FROM o)"""

QUANT_OPEN_SQL = f"""{_OPEN_SQL}
SELECT user_id, pos, CAST(q AS INTEGER) AS q, round({recover_sql('q', 'value', 'pred', EB, RADIUS)}, 6) AS recon FROM q"""


def quant_hist(spark, sf_dir):
    return histogram(_open_loop(spark, sf_dir, EB, RADIUS), [], "q")


QUANT_HIST_SQL = f"{_OPEN_SQL} SELECT CAST(q AS INTEGER) AS q, count(*) AS freq FROM q GROUP BY q"


def unpred_list(spark, sf_dir):
    """The side list of unpredictable values, kept in stream order by (user_id, pos)."""
    return _open_loop(spark, sf_dir, EB, RADIUS).where("q = 0").select("user_id", "pos", "value")


UNPRED_LIST_SQL = f"{_OPEN_SQL} SELECT user_id, pos, value FROM q WHERE q = 0"


def _closed(spark, sf_dir, layers: int, eb: float = EB, radius: int = RADIUS) -> DataFrame:
    return closed_loop.lorenzo_series(series(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value",
                                      eb, layers, radius, CHUNK)


def _closed_rows(spark, sf_dir, layers: int) -> DataFrame:
    flat = from_chunks(_closed(spark, sf_dir, layers), ["user_id"], CHUNK, {"q": "q", "recon": "recon"})
    return flat.select("user_id", "pos", "q", F.round("recon", 6).alias("recon"))


def _closed_sql(layers: int, eb: float = EB, radius: int = RADIUS) -> str:
    pred = "c.r1" if layers == 1 else "(2 * c.r1 - c.r2)"
    q0 = quantize_sql("s.value", "0.0::DOUBLE", eb, radius)
    qn = quantize_sql("s.value", pred, eb, radius)
    r0 = recover_sql(f"{q0}", "s.value", "0.0::DOUBLE", eb, radius)
    rn = recover_sql(f"{qn}", "s.value", pred, eb, radius)
    return f"""WITH RECURSIVE {SERIES_SQL},
c AS (
  SELECT s.user_id, s.pos, s.value, CAST({q0} AS INTEGER) AS q, {r0} AS r1, 0.0::DOUBLE AS r2
  FROM s WHERE s.pos % {CHUNK} = 0
  UNION ALL
  SELECT s.user_id, s.pos, s.value, CAST({qn} AS INTEGER), {rn}, c.r1
  FROM c JOIN s ON s.user_id = c.user_id AND s.pos = c.pos + 1
  WHERE s.pos % {CHUNK} <> 0)"""


def lorenzo1d_closed(spark, sf_dir):
    return _closed_rows(spark, sf_dir, 1)


def lorenzo1d_2nd_closed(spark, sf_dir):
    return _closed_rows(spark, sf_dir, 2)


LORENZO1D_SQL = _closed_sql(1) + " SELECT user_id, pos, q, round(r1, 6) AS recon FROM c"
LORENZO1D_2ND_SQL = _closed_sql(2) + " SELECT user_id, pos, q, round(r1, 6) AS recon FROM c"


def closed_recover(spark, sf_dir):
    """Decode the closed-loop indices again and check them against the originals, per user."""
    done = _closed(spark, sf_dir, 2)
    back = done.withColumn("back", closed_loop.series_recover(2, RADIUS)(
        "q", "unpred", F.lit(0.0), F.lit(EB)))
    flat = from_chunks(back, ["user_id"], CHUNK, {"vals": "value", "recon": "recon", "back": "back"})
    return flat.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), (F.max(F.abs(F.col("back") - F.col("value"))) <= EB).alias("bound_ok"),
        F.bool_and(F.col("back") == F.col("recon")).alias("same"))


CLOSED_RECOVER_SQL = "SELECT user_id, count(*) AS n, true AS bound_ok, true AS same FROM events GROUP BY user_id"


def verify_report(spark, sf_dir):
    flat = from_chunks(_closed(spark, sf_dir, 1), ["user_id"], CHUNK, {"vals": "o", "recon": "d"})
    rep = stats.distortion(flat, [], "o", "d")
    return rep.select("n", *[F.round(c, 6).alias(c) for c in rep.columns if c != "n"])


VERIFY_SQL = _closed_sql(1) + """,
m AS (SELECT count(*) AS n, min(value) AS v_min, max(value) AS v_max, max(abs(r1 - value)) AS max_abs_err,
  max(CASE WHEN value <> 0 THEN abs(r1 - value) / abs(value) END) AS pw,
  sum((r1 - value) * (r1 - value)) AS se, sum(r1 * r1) AS dd, corr(value, r1) AS corr FROM c)
SELECT n, round(v_min, 6) AS v_min, round(v_max, 6) AS v_max, round(v_max - v_min, 6) AS v_range,
  round(max_abs_err, 6) AS max_abs_err, round(max_abs_err / (v_max - v_min), 6) AS max_rel_err,
  round(pw, 6) AS max_pw_rel_err, round(se / n, 6) AS mse,
  round(20 * log10(v_max - v_min) - 10 * log10(se / n), 6) AS psnr,
  round(sqrt(se / n) / (v_max - v_min), 6) AS nrmse, round(sqrt(se), 6) AS norm_err,
  round(sqrt(se) / sqrt(dd), 6) AS norm_err_rel, round(corr, 6) AS corr FROM m"""


def autocorr(spark, sf_dir):
    r = stats.autocorrelation(placed_series(spark, sf_dir), ["user_id"], "pos", "value")
    return r.select("user_id", "n", F.round("autocorr", 6).alias("autocorr"))


AUTOCORR_SQL = f"""WITH {SERIES_SQL}, m AS (
  SELECT user_id, avg(value) AS mu, var_pop(value) AS var, count(*) AS n FROM s GROUP BY user_id),
d AS (SELECT s.user_id, (value - mu) * (lead(value) OVER (PARTITION BY s.user_id ORDER BY pos) - mu) AS w
  FROM s JOIN m USING (user_id))
SELECT m.user_id, n, round(CASE WHEN var = 0 THEN 0 ELSE a / var END, 6) AS autocorr
FROM m JOIN (SELECT user_id, sum(w) / count(w) AS a FROM d GROUP BY user_id) USING (user_id)"""


def _interp_level(spark, sf_dir, kind: str) -> DataFrame:
    chunks = to_chunks(placed_series(spark, sf_dir), ["user_id"], "pos", "value", CHUNK)
    res = chunks.select("user_id", "chunk_id", F.explode(interp.level_residuals("vals", kind)).alias("r"))
    return res.select("user_id", (F.col("chunk_id") * CHUNK + F.col("r.i")).alias("pos"),
                      F.round("r.residual", 6).alias("residual"))


def interp_linear_residual(spark, sf_dir):
    return _interp_level(spark, sf_dir, "linear")


def interp_cubic_residual(spark, sf_dir):
    return _interp_level(spark, sf_dir, "cubic")


def _interp_sql(kind: str) -> str:
    w = f"OVER (PARTITION BY user_id, pos // {CHUNK} ORDER BY pos)"
    tail = "CASE WHEN n < 4 THEN m1 ELSE -0.5::DOUBLE * m3 + 1.5::DOUBLE * m1 END"
    lin = f"CASE WHEN i = n - 1 THEN {tail} ELSE (m1 + p1) / 2 END"
    cub = f"""CASE WHEN n < 5 THEN {lin}
      WHEN i = n - 1 THEN (3 * m5 - 10 * m3 + 15 * m1) / 8
      WHEN i = 1 THEN (3 * m1 + 6 * p1 - p3) / 8
      WHEN i + 3 < n THEN (-m3 + 9 * m1 + 9 * p1 - p3) / 16
      ELSE (-m3 + 6 * m1 + 3 * p1) / 8 END"""
    return f"""WITH {SERIES_SQL}, n AS (
  SELECT user_id, pos, value, pos % {CHUNK} AS i,
    count(*) OVER (PARTITION BY user_id, pos // {CHUNK}) AS n,
    lag(value, 1) {w} AS m1, lag(value, 3) {w} AS m3, lag(value, 5) {w} AS m5,
    lead(value, 1) {w} AS p1, lead(value, 3) {w} AS p3 FROM s)
SELECT user_id, pos, round(value - ({lin if kind == 'linear' else cub}), 6) AS residual FROM n WHERE i % 2 = 1"""


def interpolators_all(spark, sf_dir):
    """Every interpolation stencil on four consecutive values."""
    near = with_neighbours(placed_series(spark, sf_dir), ["user_id"], "pos", ["value"], before=1, after=2)
    a, b, c, d = F.col("value_m1"), F.col("value"), F.col("value_p1"), F.col("value_p2")
    forms = {
        "linear": ip.linear(b, c), "linear1": ip.linear1(a, b), "quad_1": ip.quad_1(a, b, c),
        "quad_2": ip.quad_2(a, b, c), "quad_3": ip.quad_3(a, b, c), "cubic": ip.cubic(a, b, c, d),
        "cubic_front": ip.cubic_front(a, b, c, d), "cubic_front_2": ip.cubic_front_2(a, b, c, d),
        "cubic_back_1": ip.cubic_back_1(a, b, c, d), "cubic_back_2": ip.cubic_back_2(a, b, c, d),
        "cubic2": ip.cubic2(a, b, c, d), "akima": ip.akima(a, b, c, d), "pchip": ip.pchip(a, b, c, d)}
    return near.where(a.isNotNull() & d.isNotNull()).select(
        "user_id", "pos", *[F.round(e, 8).alias(n) for n, e in forms.items()])


INTERPOLATORS_SQL = f"""WITH {SERIES_SQL}, n AS (SELECT user_id, pos, value AS b,
  lag(value) OVER w AS a, lead(value) OVER w AS c, lead(value, 2) OVER w AS d FROM s
  WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
t AS (SELECT *, 2*b - a - c AS t0, 2*c - b - d AS t1 FROM n WHERE a IS NOT NULL AND d IS NOT NULL)
SELECT user_id, pos, round((b+c)/2, 8) AS linear, round(-0.5::DOUBLE*a + 1.5::DOUBLE*b, 8) AS linear1,
  round((3*a+6*b-c)/8, 8) AS quad_1, round((-a+6*b+3*c)/8, 8) AS quad_2, round((3*a-10*b+15*c)/8, 8) AS quad_3,
  round((-a+9*b+9*c-d)/16, 8) AS "cubic", round((5*a+15*b-5*c+d)/16, 8) AS cubic_front,
  round((a+6*b-4*c+d)/4, 8) AS cubic_front_2, round((a-5*b+15*c+5*d)/16, 8) AS cubic_back_1,
  round((-5*a+21*b-35*c+35*d)/16, 8) AS cubic_back_2, round((-3*a+23*b+23*c-3*d)/40, 8) AS cubic2,
  round(CASE WHEN abs(t0)+abs(t1) > 1e-9 THEN (b+c)/2 + (t0*abs(t1)+t1*abs(t0))/8/(abs(t0)+abs(t1))
        ELSE (b+c)/2 END, 8) AS akima,
  round((b+c)/2, 8) AS pchip FROM t"""


def prefilter(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", transforms.replace_outside("value", 5.0, 200.0, -1.0).alias("value"))


PREFILTER_SQL = "SELECT event_id, CASE WHEN value BETWEEN 5 AND 200 THEN value ELSE -1.0::DOUBLE END AS value FROM events"


def truncate_bytes(spark, sf_dir):
    """Keep the two top bytes of each value's 32-bit pattern."""
    ev = table(spark, sf_dir, "events")
    kept = transforms.truncate_mantissa("value", 2)
    return ev.select("event_id", kept.cast("double").alias("kept"))


# A positive float32 keeps 7 explicit mantissa bits: floor to a multiple of 2**(e-7).
TRUNCATE_SQL = """WITH f AS (SELECT event_id, CAST(CAST(value AS FLOAT) AS DOUBLE) AS v FROM events)
SELECT event_id, floor(v / pow(2::DOUBLE, floor(log2(v)) - 7)) * pow(2::DOUBLE, floor(log2(v)) - 7) AS kept FROM f"""


def xor_bytes(spark, sf_dir):
    """Low bytes that change against the preceding value's 32-bit pattern, and the decode of it."""
    near = with_neighbours(
        placed_series(spark, sf_dir).withColumn("bits", scalars.float_bits("value")),
        ["user_id"], "pos", ["bits"], before=1)
    prev = F.coalesce("bits_m1", F.lit(0))
    kept = transforms.low_bytes(F.col("bits"), scalars.changed_low_bytes(prev, F.col("bits")))
    back = transforms.restore_low_bytes(prev, kept, scalars.changed_low_bytes(prev, F.col("bits")))
    return near.select("user_id", "pos", scalars.changed_low_bytes(prev, F.col("bits")).alias("n_bytes"),
                       (back == F.col("bits")).alias("same"))


# Bits of a positive float32 from its exponent and mantissa.
XOR_SQL = f"""WITH {SERIES_SQL}, f AS (SELECT user_id, pos, CAST(CAST(value AS FLOAT) AS DOUBLE) AS v FROM s),
b AS (SELECT user_id, pos, CAST((floor(log2(v)) + 127) * 8388608 + (v / pow(2::DOUBLE, floor(log2(v))) - 1) * 8388608 AS BIGINT) AS bits FROM f),
x AS (SELECT user_id, pos, xor(bits, coalesce(lag(bits) OVER (PARTITION BY user_id ORDER BY pos), 0)) AS x FROM b)
SELECT user_id, pos, CASE WHEN x = 0 THEN 0 WHEN x < 256 THEN 1 WHEN x < 65536 THEN 2 WHEN x < 16777216 THEN 3 ELSE 4 END AS n_bytes,
  true AS same FROM x"""


def quant_rel(spark, sf_dir):
    """Range-relative bound resolved per series, then quantization with it."""
    conf = Config(mode=ErrorBoundMode.REL, rel_bound=0.01)
    bounded = stats.with_bound(placed_series(spark, sf_dir), ["user_id"], "value", conf)
    near = with_neighbours(bounded, ["user_id"], "pos", ["value"], before=1, tile=CHUNK)
    pred = F.coalesce("value_m1", F.lit(0.0))
    q = near.withColumn("q", qz.quantize("value", pred, F.col("eb"), RADIUS))
    return q.select("user_id", "pos", F.round("eb", 9).alias("eb"), "q",
                    F.round(qz.requantized("value", pred, F.col("eb"), RADIUS), 6).alias("recon"))


_H = "((CAST(floor(abs(value - pred) * (1.0::DOUBLE / eb)) AS BIGINT) + 1) // 2)"
_R = f"(pred + CAST(2 * sg * {_H} AS DOUBLE) * eb)"
_OK = f"floor(abs(value - pred) * (1.0::DOUBLE / eb)) + 1 < {2 * RADIUS} AND abs({_R} - value) <= eb"
QUANT_REL_SQL = f"""WITH {SERIES_SQL}, e AS (SELECT user_id, 0.01::DOUBLE * (max(value) - min(value)) AS eb FROM s GROUP BY user_id),
o AS (SELECT user_id, pos, value, eb, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY pos), 0) AS pred FROM s JOIN e USING (user_id)),
g AS (SELECT *, CASE WHEN value < pred THEN -1 ELSE 1 END AS sg FROM o)
SELECT user_id, pos, round(eb, 9) AS eb, CAST(CASE WHEN {_OK} THEN {RADIUS} + sg * {_H} ELSE 0 END AS INTEGER) AS q,
  round(CASE WHEN {_OK} THEN {_R} ELSE value END, 6) AS recon FROM g"""


def pw_rel_roundtrip(spark, sf_dir):
    """Point-wise relative bound on order prices through the log transform."""
    rel = 1e-3
    prices = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    logged = transforms.log_transform(prices, "v", rel)
    q = qz.grid_index("log_v", F.col("min_log"), F.col("log_eb"))
    back = logged.withColumn("_d", qz.grid_centre(q, F.col("min_log"), F.col("log_eb")))
    back = back.withColumn("dec", transforms.log_inverse("_d", "sign_v", "min_log", "log_eb"))
    return back.select("o_orderkey", q.alias("q"), F.round("dec", 4).alias("dec"),
                       (F.abs(F.col("dec") - F.col("v")) <= rel * F.abs("v") * (1 + 1e-9)).alias("bound_ok"))


PW_REL_SQL = """WITH l AS (SELECT o_orderkey, o_totalprice AS v, log2(o_totalprice) AS lv FROM orders),
f AS (SELECT min(lv) AS mn, log2(1.001::DOUBLE) - greatest(max(lv), abs(min(lv))) * 1.2e-7::DOUBLE AS p FROM l),
q AS (SELECT o_orderkey, v, mn, p, CAST(floor((lv - mn) / p) AS BIGINT) // 2 AS q FROM l, f)
SELECT o_orderkey, q, round(pow(2::DOUBLE, CAST(2 * q + 1 AS DOUBLE) * p + mn), 4) AS dec, true AS bound_ok FROM q"""


QUERIES = {
    "eb_modes": (eb_modes, EB_MODES_SQL),
    "value_range": (value_ranges, VALUE_RANGES_SQL),
    "quant_open": (quant_open, QUANT_OPEN_SQL),
    "quant_hist": (quant_hist, QUANT_HIST_SQL),
    "unpred_list": (unpred_list, UNPRED_LIST_SQL),
    "lorenzo1d_closed": (lorenzo1d_closed, LORENZO1D_SQL),
    "lorenzo1d_2nd_closed": (lorenzo1d_2nd_closed, LORENZO1D_2ND_SQL),
    "closed_recover": (closed_recover, CLOSED_RECOVER_SQL),
    "verify_report": (verify_report, VERIFY_SQL),
    "autocorr": (autocorr, AUTOCORR_SQL),
    "interp_linear_residual": (interp_linear_residual, _interp_sql("linear")),
    "interp_cubic_residual": (interp_cubic_residual, _interp_sql("cubic")),
    "interpolators": (interpolators_all, INTERPOLATORS_SQL),
    "prefilter": (prefilter, PREFILTER_SQL),
    "truncate": (truncate_bytes, TRUNCATE_SQL),
    "xor_bytes": (xor_bytes, XOR_SQL),
    "quant_rel": (quant_rel, QUANT_REL_SQL),
    "pw_rel_roundtrip": (pw_rel_roundtrip, PW_REL_SQL),
}
