"""Trajectories: temporal prediction, per-frame choice, batches, level coding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errbound.catalog.tables import quantize_sql, recover_sql, table
from errbound.operators import levels as lv
from errbound.operators import temporal as tm
from errbound.operators import transforms
from errbound.operators.ordering import from_chunks, with_position

EB = 2.0
RADIUS = 64
BATCH = 8
EDGE = 4


def trajectory(spark, sf_dir) -> DataFrame:
    """Each user is a particle, each event its next frame."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    placed = with_position(ev, ["user_id"], ["ts", "event_id"], "frame")
    secs = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    return placed.select(F.col("user_id").alias("pid"), "frame", F.col("value").alias("x"),
                         ((secs % 86400) / 864.0).alias("y"), (F.col("event_id") / 1000.0).alias("z"))


TRAJ_SQL = """tr AS (
  SELECT user_id AS pid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
    value AS x, CAST((epoch_us(ts) // 1000000) % 86400 AS DOUBLE) / 864.0::DOUBLE AS y,
    event_id / 1000.0::DOUBLE AS z FROM events)"""


def temporal_residual(spark, sf_dir):
    """Closed loop along time; each batch starts from the particle's key frame."""
    tr = trajectory(spark, sf_dir)
    done = tm.temporal_batches(tr, ["pid"], "x", EB, BATCH, RADIUS, tm.first_frame(tr, ["pid"], "x"))
    flat = from_chunks(done, ["pid"], BATCH, {"q": "q", "recon": "recon"}, "frame", "batch")
    return flat.select("pid", "frame", "q", F.round("recon", 6).alias("recon"))


def _chain_sql() -> str:
    def both(p):
        q = quantize_sql("t.x", p, EB, RADIUS)
        return q, recover_sql(q, "t.x", p, EB, RADIUS)
    q0, r0 = both("k.x")
    qn, rn = both("c.r")
    return f"""WITH RECURSIVE {TRAJ_SQL}, c AS (
  SELECT t.pid, t.frame, CAST({q0} AS INTEGER) AS q, {r0} AS r FROM tr t JOIN tr k ON k.pid = t.pid AND k.frame = 0
  WHERE t.frame % {BATCH} = 0
  UNION ALL SELECT t.pid, t.frame, CAST({qn} AS INTEGER), {rn} FROM c JOIN tr t ON t.pid = c.pid AND t.frame = c.frame + 1
  WHERE t.frame % {BATCH} <> 0)
SELECT pid, frame, q, round(r, 6) AS recon FROM c"""


def _sizes(spark, sf_dir) -> DataFrame:
    tr = trajectory(spark, sf_dir)
    return tm.spatial_sizes(tr, [], EB, EDGE).join(tm.temporal_sizes(tr, [], EB, RADIUS), "frame")


def frame_sizes(spark, sf_dir):
    s = _sizes(spark, sf_dir)
    return s.select("frame", F.round("spatial_bits", 3).alias("spatial_bits"),
                    F.round("temporal_bits", 3).alias("temporal_bits"))


def _sizes_sql() -> str:
    tq = [f"SELECT frame, {quantize_sql(a, f'p{a}', EB, RADIUS)} AS q FROM lg" for a in "xyz"]
    return f"""{TRAJ_SQL},
lg AS (SELECT frame, x, y, z, coalesce(lag(x) OVER w, 0) AS px, coalesce(lag(y) OVER w, 0) AS py,
  coalesce(lag(z) OVER w, 0) AS pz FROM tr WINDOW w AS (PARTITION BY pid ORDER BY frame)),
tq AS ({' UNION ALL '.join(tq)}),
th AS (SELECT frame, q, count(*) AS f FROM tq GROUP BY frame, q),
ts AS (SELECT frame, sum(f) * log2(sum(f)) - sum(f * log2(f)) + 32 * sum(CASE WHEN q = 0 THEN f ELSE 0 END) AS t FROM th GROUP BY frame),
bx AS (SELECT frame, min(x) px, min(y) py, min(z) pz, max(x)-min(x) rx, max(y)-min(y) ry, max(z)-min(z) rz FROM tr GROUP BY frame),
g AS (SELECT frame, CAST(floor((x - px) / {EB!r}::DOUBLE) AS BIGINT) // 2 AS qx, CAST(floor((y - py) / {EB!r}::DOUBLE) AS BIGINT) // 2 AS qy,
  CAST(floor((z - pz) / {EB!r}::DOUBLE) AS BIGINT) // 2 AS qz,
  (CAST(ceil(rx / (2.0::DOUBLE * {EDGE} * {EB!r}::DOUBLE)) AS BIGINT) + 2) // 2 AS nx,
  (CAST(ceil(ry / (2.0::DOUBLE * {EDGE} * {EB!r}::DOUBLE)) AS BIGINT) + 2) // 2 AS ny FROM tr JOIN bx USING (frame)),
c AS (SELECT frame, qx // {EDGE} // 2 + (qy // {EDGE} // 2) * nx + (qz // {EDGE} // 2) * nx * ny AS block,
  (qx // {EDGE}) % 2 + ((qy // {EDGE}) % 2) * 2 + ((qz // {EDGE}) % 2) * 4 AS oct,
  qx % {EDGE} + (qy % {EDGE}) * {EDGE} + (qz % {EDGE}) * {EDGE * EDGE} AS pos, count(*) AS n FROM g GROUP BY 1, 2, 3, 4),
d AS (SELECT *, oct - coalesce(lag(oct) OVER (PARTITION BY frame, block ORDER BY oct, pos), 0) AS od,
  pos - coalesce(lag(pos) OVER (PARTITION BY frame, block, oct ORDER BY pos), 0) AS pd FROM c),
hs AS (SELECT frame, 'block' AS stream, block - coalesce(lag(block) OVER (PARTITION BY frame ORDER BY block), 0) AS symbol, 1 AS w
    FROM (SELECT DISTINCT frame, block FROM c)
  UNION ALL SELECT frame, 'count', sum(n), 1 FROM c GROUP BY frame, block
  UNION ALL SELECT frame, 'octant', od, 1 FROM d UNION ALL SELECT frame, 'octant', 0, n - 1 FROM d
  UNION ALL SELECT frame, 'position', pd, 1 FROM d UNION ALL SELECT frame, 'position', 0, n - 1 FROM d),
h AS (SELECT frame, stream, symbol, sum(w) AS f FROM hs WHERE w > 0 GROUP BY 1, 2, 3),
z AS (SELECT frame, stream, least(sum(f) * log2(sum(f)) - sum(f * log2(f)),
  sum(f) * greatest(1, ceil(log2(max(symbol) - min(symbol) + 1)))) AS bits FROM h GROUP BY frame, stream),
sz AS (SELECT frame, sum(bits) AS s, any_value(t) AS t FROM z JOIN ts USING (frame) GROUP BY frame)"""


FRAME_SIZES_SQL = f"WITH {_sizes_sql()} SELECT frame, round(s, 3) AS spatial_bits, round(t, 3) AS temporal_bits FROM sz"


def temporal_choice(spark, sf_dir):
    return tm.choose_frames(_sizes(spark, sf_dir), [])


CHOICE_SQL = f"""WITH RECURSIVE {_sizes_sql()}, sm AS MATERIALIZED (SELECT frame, s, t FROM sz),
f AS (
  SELECT frame, 0 AS mode, false AS tested, s AS last, 0 AS skip, 1 AS lim FROM sm WHERE frame = 0
  UNION ALL
  SELECT m.frame, CASE WHEN f.skip = 0 AND m.t <= f.last THEN 1 ELSE 0 END, f.skip = 0,
    CASE WHEN f.skip = 0 AND m.t <= f.last THEN f.last ELSE m.s END,
    CASE WHEN f.skip > 0 THEN f.skip - 1 WHEN m.t <= f.last THEN 0 ELSE f.lim // 2 END,
    CASE WHEN f.skip > 0 THEN f.lim WHEN m.t <= f.last THEN 1 WHEN f.lim < 64 THEN f.lim * 2 ELSE f.lim END
  FROM f JOIN sm m ON m.frame = f.frame + 1)
SELECT frame, mode, tested FROM f"""


def batch_keyframe(spark, sf_dir):
    """Which frame each frame's temporal chain starts from."""
    return tm.chain_starts(temporal_choice(spark, sf_dir), [], BATCH).select("frame", "batch", "mode", "anchor")


KEYFRAME_SQL = CHOICE_SQL.rsplit("SELECT frame, mode, tested FROM f", 1)[0] + f"""
SELECT frame, frame // {BATCH} AS batch, mode, max(CASE WHEN mode = 0 OR frame % {BATCH} = 0 THEN frame END)
  OVER (PARTITION BY frame // {BATCH} ORDER BY frame) AS anchor FROM f"""


def tight_factor(spark, sf_dir):
    tr = trajectory(spark, sf_dir)
    return tm.tight_factor(tr, _sizes(spark, sf_dir), EB)


TIGHT_SQL = f"""WITH {_sizes_sql()}, p AS (SELECT max(frame) AS t FROM tr),
j AS (SELECT count(*) AS jumps FROM tr a JOIN tr b ON a.pid = b.pid AND a.frame = 1 AND b.frame = 0
  WHERE (abs(a.x - b.x) > 131072 OR abs(a.y - b.y) > 131072 OR abs(a.z - b.z) > 131072)),
w AS (SELECT count(CASE WHEN sz.t < sz.s THEN 1 END) AS wins FROM sz, p
  WHERE frame = p.t // 2 OR frame = p.t // 4 OR frame = p.t // 4 * 3)
SELECT p.t + 1 AS frames, jumps, wins, CASE WHEN p.t + 1 >= 64 AND jumps = 0 AND wins > 1 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS factor
FROM p, j, w"""


def axis_unpivot(spark, sf_dir):
    """Interleaved axes to one row per axis, and back."""
    tr = trajectory(spark, sf_dir)
    long = transforms.unpivot_axes(tr, ["pid", "frame"])
    return long.select("pid", "frame", "axis", F.round("v", 6).alias("v"))


UNPIVOT_SQL = f"""WITH {TRAJ_SQL} SELECT pid, frame, axis, round(v, 6) AS v FROM (
  SELECT pid, frame, unnest(['x', 'y', 'z']) AS axis, unnest([x, y, z]) AS v FROM tr)"""


START, OFFSET, LEVELS, VQ_EB = 0.0, 5.0, 100, 0.5


def vq_levels(spark, sf_dir):
    """Level number, biased level delta across particles, index and reconstruction, per frame."""
    tr = trajectory(spark, sf_dir)
    by_frame = with_position(tr, ["frame"], ["pid"], "slot", width=1 << 20)
    out = lv.vq(by_frame, ["frame"], "slot", "x", F.lit(START), F.lit(OFFSET), LEVELS, VQ_EB, RADIUS)
    return out.select("pid", "frame", "level", "code", "q", F.round("recon", 6).alias("recon"))


def _vq_sql() -> str:
    p = f"({START!r}::DOUBLE + CAST(l AS DOUBLE) * {OFFSET!r}::DOUBLE)"
    q = quantize_sql("x", p, VQ_EB, RADIUS)
    return f"""WITH {TRAJ_SQL}, l AS (SELECT *, CAST(round((x - {START!r}::DOUBLE) / {OFFSET!r}::DOUBLE) AS BIGINT) AS l FROM tr),
d AS (SELECT *, l - coalesce(lag(l) OVER (PARTITION BY frame ORDER BY pid), 0) + {LEVELS} + 200 AS code FROM l)
SELECT pid, frame, l AS level, code, CAST({q} AS INTEGER) AS q, round({recover_sql(q, 'x', p, VQ_EB, RADIUS)}, 6) AS recon FROM d"""


def vqt(spark, sf_dir):
    """Levels in the first frame of a batch, time prediction after it."""
    tr = trajectory(spark, sf_dir)
    start = tm.with_batch(tr, BATCH).where(F.col("frame") % BATCH == 0).select(
        "pid", "batch", lv.level_value(lv.level_number("x", F.lit(START), F.lit(OFFSET)), F.lit(START), F.lit(OFFSET)).alias("start"))
    from errbound.operators.closed_loop import quantize_chunks
    from errbound.operators.ordering import to_chunks
    chunks = to_chunks(tr, ["pid"], "frame", "x", BATCH, chunk="batch").join(start, ["pid", "batch"])
    done = quantize_chunks(chunks, F.col("start"), VQ_EB, 1, RADIUS)
    flat = from_chunks(done, ["pid"], BATCH, {"q": "q", "recon": "recon"}, "frame", "batch")
    return flat.select("pid", "frame", "q", F.round("recon", 6).alias("recon"))


def _vqt_sql() -> str:
    lev = f"({START!r}::DOUBLE + round((t.x - {START!r}::DOUBLE) / {OFFSET!r}::DOUBLE) * {OFFSET!r}::DOUBLE)"
    q0 = quantize_sql("t.x", lev, VQ_EB, RADIUS)
    qn = quantize_sql("t.x", "c.r", VQ_EB, RADIUS)
    return f"""WITH RECURSIVE {TRAJ_SQL}, c AS (
  SELECT t.pid, t.frame, CAST({q0} AS INTEGER) AS q, {recover_sql(q0, 't.x', lev, VQ_EB, RADIUS)} AS r FROM tr t WHERE t.frame % {BATCH} = 0
  UNION ALL SELECT t.pid, t.frame, CAST({qn} AS INTEGER), {recover_sql(qn, 't.x', 'c.r', VQ_EB, RADIUS)}
  FROM c JOIN tr t ON t.pid = c.pid AND t.frame = c.frame + 1 WHERE t.frame % {BATCH} <> 0)
SELECT pid, frame, q, round(r, 6) AS recon FROM c"""


def kmeans_cost_prefix(spark, sf_dir):
    """Prefix sums over the distinct discount levels."""
    t = lv.cost_table(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_discount"), ["l_returnflag"], "l_discount")
    return t.select("l_returnflag", "l_discount", "cum_n", F.round("cum_sum", 4).alias("cum_sum"),
                    F.round("cum_sq", 4).alias("cum_sq"))


COST_SQL = """WITH g AS (SELECT l_returnflag, l_discount, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_discount, CAST(sum(n) OVER w AS BIGINT) AS cum_n, round(sum(l_discount * n) OVER w, 4) AS cum_sum,
  round(sum(l_discount * l_discount * n) OVER w, 4) AS cum_sq FROM g WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_discount)"""


def kmeans_levels(spark, sf_dir):
    """Regular levels found in discounts: eleven levels one hundredth apart."""
    fit = lv.fit_levels(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_discount"), ["l_returnflag"], "l_discount")
    return fit.select("l_returnflag", F.round("start", 4).alias("start"), F.round("offset", 4).alias("offset"), "levels")


KMEANS_SQL = """SELECT l_returnflag, round(min(l_discount), 4) AS start,
  round((max(l_discount) - min(l_discount)) / (count(DISTINCT l_discount) - 1), 4) AS "offset",
  CAST(count(DISTINCT l_discount) AS INT) AS levels FROM lineitem GROUP BY l_returnflag"""


QUERIES = {
    "temporal_residual": (temporal_residual, _chain_sql()),
    "frame_sizes": (frame_sizes, FRAME_SIZES_SQL),
    "temporal_choice": (temporal_choice, CHOICE_SQL),
    "batch_keyframe": (batch_keyframe, KEYFRAME_SQL),
    "tight_factor": (tight_factor, TIGHT_SQL),
    "axis_unpivot": (axis_unpivot, UNPIVOT_SQL),
    "vq_levels": (vq_levels, _vq_sql()),
    "vqt": (vqt, _vqt_sql()),
    "kmeans_cost_prefix": (kmeans_cost_prefix, COST_SQL),
    "kmeans_levels": (kmeans_levels, KMEANS_SQL),
}
