"""Whole codecs: compress, decompress and verify."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errbound.catalog.particles import INVERSE_SQL
from errbound.catalog.tables import ORDERS_PARTICLES_SQL, orders_particles, particles, slabs, table
from errbound.catalog.trajectories import TRAJ_SQL, trajectory
from errbound.config import Algorithm, Config, ErrorBoundMode, Interpolator
from errbound.operators import particles as pt
from errbound.operators import stencil, transforms
from errbound.operators.ordering import to_chunks, with_position
from errbound.plans import array_codec as codec
from errbound.plans import md_codec as md
from errbound.plans import particle_codec as pc
from errbound.plans import tuner
from errbound.session import checkpointed

HEIGHT = 64
BASE = Config(dims=(HEIGHT, 8, 8), mode=ErrorBoundMode.REL, rel_bound=1e-3)


def chunks3d(spark, sf_dir) -> DataFrame:
    return codec.slabs_to_chunks(slabs(spark, sf_dir), [], [8, 8], HEIGHT)


def _verified(chunks: DataFrame, back: DataFrame, slack: float = 1e-9) -> DataFrame:
    """Per chunk: value count and whether every value honours the bound."""
    both = chunks.select("chunk_id", "vals").join(back.select("chunk_id", "eb", "decoded"), "chunk_id")
    worst = F.array_max(F.zip_with("vals", "decoded", lambda a, b: F.abs(a - b)))
    return both.select("chunk_id", F.size("decoded").cast("bigint").alias("n"),
                       (worst <= F.col("eb") * (1 + slack)).alias("bound_ok"))


def _codec(conf: Config):
    def run(spark, sf_dir):
        chunks = chunks3d(spark, sf_dir)
        return _verified(chunks, codec.decompress(codec.compress(chunks, [], conf), conf))
    return run


VERIFIED_SQL = f"""SELECT vec_id // {HEIGHT} AS chunk_id, CAST(sum(len(embedding)) AS BIGINT) AS n, true AS bound_ok
FROM embeddings GROUP BY 1"""


def codec_auto(spark, sf_dir):
    chunks = chunks3d(spark, sf_dir)
    return _verified(chunks, tuner.decompress_tuned(tuner.compress_tuned(chunks, [], BASE), BASE))


def tuner_report(spark, sf_dir):
    """Trial ratios of all candidates and the winner."""
    return tuner.tune(chunks3d(spark, sf_dir), [], BASE)


def codec_series(spark, sf_dir):
    """1-D codec over each user's series: second-order Lorenzo with regression."""
    conf = Config(dims=(32,), algorithm=Algorithm.LORENZO_REG, mode=ErrorBoundMode.ABS, abs_bound=0.5, lorenzo2=True)
    placed = with_position(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"),
                           ["user_id"], ["ts", "event_id"])
    chunks = to_chunks(placed, ["user_id"], "pos", "value", 32).withColumns(
        {"origin": F.array((F.col("chunk_id") * 32).cast("int")), "dims": F.array(F.size("vals"))})
    packed = codec.compress(chunks, ["user_id"], conf)
    back = codec.decompress(packed, conf)
    both = chunks.join(back.select("user_id", "chunk_id", "decoded"), ["user_id", "chunk_id"])
    worst = F.array_max(F.zip_with("vals", "decoded", lambda a, b: F.abs(a - b)))
    return both.groupBy("user_id").agg(F.sum(F.size("decoded")).alias("n"), (F.max(worst) <= 0.5 * (1 + 1e-9)).alias("bound_ok"))


SERIES_CODEC_SQL = "SELECT user_id, count(*) AS n, true AS bound_ok FROM events GROUP BY user_id"


def codec_truncate(spark, sf_dir):
    """Two of four bytes kept: relative error below 2**-7."""
    conf = BASE.with_(algorithm=Algorithm.TRUNCATE, extra={"keep_bytes": 2})
    chunks = chunks3d(spark, sf_dir)
    back = codec.decompress(codec.compress(chunks, [], conf), conf)
    both = chunks.select("chunk_id", "vals").join(back.select("chunk_id", "decoded"), "chunk_id")
    ok = F.forall(F.arrays_zip("vals", "decoded"), lambda s: F.abs(s["vals"] - s["decoded"]) <= F.abs(s["vals"]) * 2.0 ** -7)
    return both.select("chunk_id", F.size("decoded").cast("bigint").alias("n"), ok.alias("bound_ok"))


def compression_report(spark, sf_dir):
    """Ratio of each algorithm on the 3-D array."""
    chunks = chunks3d(spark, sf_dir)
    parts = None
    for name, conf in CODECS.items():
        p = codec.compress(chunks, [], conf).agg(
            F.lit(name).alias("codec"), F.sum(F.col("n") * 4).alias("raw_bytes"),
            F.sum(codec.packed_bytes()).alias("packed_bytes"))
        parts = p if parts is None else parts.unionByName(p)
    return parts.withColumn("ratio", F.round(F.col("raw_bytes") / F.col("packed_bytes"), 4))


CODECS = {
    "lorenzo_reg": BASE.with_(algorithm=Algorithm.LORENZO_REG),
    "lorenzo2_reg": BASE.with_(algorithm=Algorithm.LORENZO_REG, lorenzo2=True),
    "poly": BASE.with_(algorithm=Algorithm.LORENZO_REG, regression2=True),
    "lorenzo_pred2": BASE.with_(algorithm=Algorithm.LORENZO_REG, regression=False, pred_dim=2),
    "interp_linear": BASE.with_(algorithm=Algorithm.INTERP, interpolator=Interpolator.LINEAR),
    "interp_cubic": BASE.with_(algorithm=Algorithm.INTERP, interpolator=Interpolator.CUBIC),
    "interp_reversed": BASE.with_(algorithm=Algorithm.INTERP, interp_direction=5),
    "lossless": BASE.with_(algorithm=Algorithm.LOSSLESS),
}

QUERIES = {f"codec_{name}": (_codec(conf), VERIFIED_SQL) for name, conf in CODECS.items()} | {
    "codec_auto": (codec_auto, VERIFIED_SQL),
    "codec_series": (codec_series, SERIES_CODEC_SQL),
    "codec_truncate": (codec_truncate, VERIFIED_SQL),
    "compression_report": (compression_report, None),
    "tuner_report": (tuner_report, None),
}


PW_REL = 1e-3


def codec_pw_rel(spark, sf_dir):
    """Point-wise relative bound: log transform, array codec, inverse."""
    prices = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    logged = transforms.log_transform(with_position(prices, [], ["o_orderkey"]), "v", PW_REL)
    chunks = logged.groupBy(F.floor(F.col("pos") / 1024).alias("chunk_id")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "v", "sign_v", "log_v"))).alias("_s"),
        F.first("min_log").alias("min_log"), F.first("log_eb").alias("eb"))
    chunks = chunks.select("chunk_id", F.array(F.lit(0)).alias("origin"), F.array(F.size("_s")).alias("dims"),
                           F.col("_s.log_v").alias("vals"), F.col("_s.v").alias("v"), F.col("_s.sign_v").alias("sign_v"),
                           "min_log", "eb")
    conf = Config(dims=(1024,), algorithm=Algorithm.LORENZO_REG)
    back = codec.decompress(codec.compress(chunks, [], conf), conf).select("chunk_id", "decoded")
    both = chunks.join(back, "chunk_id").select("chunk_id", "min_log", "eb", F.explode(
        F.arrays_zip("v", "sign_v", "decoded")).alias("e")).select("chunk_id", "min_log", "eb", "e.*")
    dec = transforms.log_inverse("decoded", "sign_v", "min_log", "eb")
    return both.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(
        F.abs(dec - F.col("v")) <= PW_REL * F.abs("v") * (1 + 1e-9)).alias("bound_ok"))


PW_CODEC_SQL = """SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 1024 AS chunk_id FROM orders"""
PW_CODEC_SQL = f"SELECT chunk_id, count(*) AS n, true AS bound_ok FROM ({PW_CODEC_SQL}) GROUP BY chunk_id"


PARTICLE_EB = 0.05


def particle_codec_query(spark, sf_dir):
    """Spatial codec round trip on particles with ids: positions match through the permutation."""
    pts = orders_particles(spark, sf_dir)
    particles = checkpointed(pc.blocked(pts, [], PARTICLE_EB, 8).select("pid", *pc.CELL_COLUMNS))
    cells = pc.numbered_cells(particles, [])
    back = pc.expand_cells(pc.decode_cells(pc.compress_cells(cells, [], PARTICLE_EB), []), [])
    order = pc.output_positions(particles, cells, [])
    both = pts.join(order, "pid").join(back.select("position", *[F.col(a).alias(f"d{a}") for a in "xyz"]), "position")
    worst = F.greatest(*[F.abs(F.col(a) - F.col(f"d{a}")) for a in "xyz"])
    return both.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("positions"),
                    (F.max(worst) <= PARTICLE_EB * (1 + 1e-9)).alias("bound_ok"))


PARTICLE_CODEC_SQL = "SELECT count(*) AS n, count(*) AS positions, true AS bound_ok FROM orders"


def _yearly(spark, sf_dir):
    """The particle set with ids, one frame per year."""
    return orders_particles(spark, sf_dir).withColumn("year", F.floor(F.col("z") / 366).cast("int"))


def particle_codec_tuned(spark, sf_dir):
    """Frames by year, each coded with the block edge that codes it best: edge, rows and whether all come back within the bound."""
    pts = _yearly(spark, sf_dir)
    edges = pc.best_edges(pts, ["year"], TUNED_EB)
    packed = pc.compress_frames(pts, ["year"], TUNED_EB, edges)
    order = pc.frame_order(pts, ["year"], TUNED_EB, edges)
    back = pc.decode_frames(packed, ["year"]).select("year", "position", *[F.col(a).alias(f"d{a}") for a in "xyz"])
    both = pts.join(order, ["year", "pid"]).join(back, ["year", "position"])
    worst = F.greatest(*[F.abs(F.col(a) - F.col(f"d{a}")) for a in "xyz"])
    found = both.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("positions"), (F.max(worst) <= TUNED_EB * (1 + 1e-9)).alias("bound_ok"))
    return found.join(edges, "year")


def edge_bits(spark, sf_dir):
    """Coded bits of every candidate edge of every year's frame."""
    pts = _yearly(spark, sf_dir)
    return pt.edge_bits(pt.grid_cells(pts, ["year"], TUNED_EB), ["year"], TUNED_EB).select("year", "edge", F.round("bits", 2).alias("bits"))


TUNED_EB = 2.0


def _edge_bits_sql() -> str:
    eb = f"{TUNED_EB!r}::DOUBLE"
    cells = ", ".join(f"CAST(floor(({a} - p{a}) / {eb}) AS BIGINT) // 2 AS q{a}" for a in "xyz")
    return f"""{ORDERS_PARTICLES_SQL}, f AS (SELECT *, CAST(floor(z / 366) AS INT) AS year FROM pts),
bx AS (SELECT year, min(x) px, min(y) py, min(z) pz, max(x) - min(x) AS rx, max(y) - min(y) AS ry, max(z) - min(z) AS rz FROM f GROUP BY year),
t AS (SELECT *, CAST(pow(2, a) AS BIGINT) AS e, (CAST(ceil(rx / (2.0::DOUBLE * pow(2, a) * {eb})) AS BIGINT) + 2) // 2 AS nx,
  (CAST(ceil(ry / (2.0::DOUBLE * pow(2, a) * {eb})) AS BIGINT) + 2) // 2 AS ny FROM bx, unnest(range(17)) AS k(a)
  WHERE a <= greatest(0, least(ceil(log2(rx / {eb})), ceil(log2(ry / {eb})), ceil(log2(rz / {eb}))))),
q AS (SELECT year, e, nx, ny, {cells} FROM f JOIN t USING (year)),
c AS (SELECT year, e, qx // e // 2 + (qy // e // 2) * nx + (qz // e // 2) * nx * ny AS block,
  (qx // e) % 2 + ((qy // e) % 2) * 2 + ((qz // e) % 2) * 4 AS oct, qx % e + (qy % e) * e + (qz % e) * e * e AS pos, count(*) AS n FROM q GROUP BY ALL),
d AS (SELECT *, oct - coalesce(lag(oct) OVER (PARTITION BY year, e, block ORDER BY oct, pos), 0) AS od,
  pos - coalesce(lag(pos) OVER (PARTITION BY year, e, block, oct ORDER BY pos), 0) AS pd FROM c),
hs AS (SELECT year, e, 'block' AS stream, block - coalesce(lag(block) OVER (PARTITION BY year, e ORDER BY block), 0) AS symbol, 1 AS w
    FROM (SELECT DISTINCT year, e, block FROM c)
  UNION ALL SELECT year, e, 'count', sum(n), 1 FROM c GROUP BY year, e, block
  UNION ALL SELECT year, e, 'octant', od, 1 FROM d UNION ALL SELECT year, e, 'octant', 0, n - 1 FROM d
  UNION ALL SELECT year, e, 'position', pd, 1 FROM d UNION ALL SELECT year, e, 'position', 0, n - 1 FROM d),
h AS (SELECT year, e, stream, symbol, sum(w) AS f FROM hs WHERE w > 0 GROUP BY ALL),
z AS (SELECT year, e, stream, least(sum(f) * log2(sum(f)) - sum(f * log2(f)), sum(f) * greatest(1, ceil(log2(max(symbol) - min(symbol) + 1)))) AS bits FROM h GROUP BY ALL),
s AS (SELECT year, e AS edge, round(sum(bits), 2) AS bits FROM z GROUP BY ALL)"""


EDGE_BITS_SQL = f"WITH {_edge_bits_sql()} SELECT year, edge, bits FROM s"
TUNED_SQL = f"""WITH {_edge_bits_sql()}, b AS (SELECT year, arg_min(edge, bits * 1000000 + edge) AS edge FROM s GROUP BY year)
SELECT f.year, count(*) AS n, count(*) AS positions, true AS bound_ok, any_value(edge) AS edge FROM f JOIN b USING (year) GROUP BY f.year"""


def particle_cells_codec(spark, sf_dir):
    """Spatial codec on the crowded particle set: decoded centres and their counts."""
    packed = pc.compress_frames(particles(spark, sf_dir), [], 0.5, 8)
    return pc.decode_cells(packed, []).groupBy(*[F.round(a, 6).alias(a) for a in "xyz"]).agg(F.sum("n").alias("n"))


def particle_raw(spark, sf_dir):
    """A range beyond the grid limits takes the lossless path."""
    pts = orders_particles(spark, sf_dir).withColumn("x", F.col("x") * 1e6)
    back = pc.decompress_raw(pc.compress_raw(pts, [], 1e-3), [])
    return back.groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("n"))


RAW_SQL = f"WITH {ORDERS_PARTICLES_SQL} SELECT x * 1e6::DOUBLE AS x, y, z, count(*) AS n FROM pts GROUP BY 1, 2, 3"


def trajectory_codec(spark, sf_dir):
    """Key frames and temporal batches, decoded and matched to the input through the permutation."""
    tr = trajectory(spark, sf_dir)
    key_frames, batches, order = pc.compress_trajectory(tr, 2.0, 8, 4, 64)
    back = pc.decompress_trajectory(key_frames, batches, 2.0, 64)
    named = back.join(order, ["anchor", "position"]).select(
        "pid", (F.col("anchor") + F.col("step")).alias("frame"), *[F.col(a).alias(f"d{a}") for a in "xyz"])
    both = tr.join(named, ["pid", "frame"])
    worst = F.greatest(*[F.abs(F.col(a) - F.col(f"d{a}")) for a in "xyz"])
    return both.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), (F.max(worst) <= 2.0 * (1 + 1e-9)).alias("bound_ok"))


TRAJECTORY_SQL = f"WITH {TRAJ_SQL} SELECT frame, count(*) AS n, true AS bound_ok FROM tr GROUP BY frame"


def _md_rows(spark, sf_dir) -> DataFrame:
    """Vectors as frames, their 64 components as atoms, on one axis."""
    cells = stencil.explode_slab(slabs(spark, sf_dir), [], {"row": "v"})
    return cells.select(F.lit("x").alias("axis"), F.col("i0").alias("frame"), F.col("p").cast("bigint").alias("slot"), "v")


MD = Config(dims=(10, 64), mode=ErrorBoundMode.REL, rel_bound=1e-3)


def _md(method: int):
    def run(spark, sf_dir):
        rows = _md_rows(spark, sf_dir)
        packed = md.compress(rows, MD, 10, method, 32)
        back = md.decompress(packed, MD).withColumnRenamed("v", "d")
        ebs = packed.groupBy("axis", "batch").agg(F.first("eb").alias("eb"))
        both = rows.join(back, ["axis", "frame", "slot"]).withColumn("batch", F.floor(F.col("frame") / 10)).join(ebs, ["axis", "batch"])
        return both.groupBy("axis", "batch").agg(F.count(F.lit(1)).alias("n"), F.bool_and(
            F.abs(F.col("v") - F.col("d")) <= F.col("eb") * (1 + 1e-9)).alias("bound_ok"))
    return run


MD_SQL = """SELECT 'x' AS axis, vec_id // 10 AS batch, CAST(sum(len(embedding)) AS BIGINT) AS n, true AS bound_ok
FROM embeddings GROUP BY 2"""


def md_methods(spark, sf_dir):
    """Bytes of each method over the whole run and the adaptive choice per period."""
    prep = md.prepared(_md_rows(spark, sf_dir), MD, 10, 32)
    return md.select_methods(prep, MD.radius)


QUERIES |= {
    "codec_pw_rel": (codec_pw_rel, PW_CODEC_SQL),
    "edge_bits": (edge_bits, EDGE_BITS_SQL),
    "particle_codec_tuned": (particle_codec_tuned, TUNED_SQL),
    "particle_codec": (particle_codec_query, PARTICLE_CODEC_SQL),
    "particle_cells_codec": (particle_cells_codec, INVERSE_SQL),
    "particle_raw": (particle_raw, RAW_SQL),
    "trajectory_codec": (trajectory_codec, TRAJECTORY_SQL),
    "md_adaptive": (_md(md.ADAPTIVE), MD_SQL),
    "md_mt": (_md(md.MT), MD_SQL),
    "md_lorenzo": (_md(md.LR), MD_SQL),
    "md_ts": (_md(md.TS), MD_SQL),
    "md_methods": (md_methods, None),
}


# ---------------------------------------------------------------- rows that are not everywhere

def daily(spark, sf_dir) -> DataFrame:
    """A user is a particle in each day with events: late starts, gaps and early ends as they come."""
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000)
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("pid"), day.alias("frame")).agg(
        F.count(F.lit(1)).cast("double").alias("x"), F.max(F.floor("value")).cast("double").alias("y"),
        F.min(F.col("event_id") % 100000).cast("double").alias("z"))


DAILY_SQL = """daily AS (SELECT user_id AS pid, epoch_us(ts) // 86400000000 AS frame, CAST(count(*) AS DOUBLE) AS x,
  CAST(max(floor(value)) AS DOUBLE) AS y, CAST(min(event_id % 100000) AS DOUBLE) AS z FROM events GROUP BY 1, 2)"""


def _trajectory_rows(tr: DataFrame, edge: int) -> DataFrame:
    """Whole coordinates under a bound of a quarter come back exactly once they are rounded."""
    key_frames, batches, order = pc.compress_trajectory(tr, 0.25, 8, edge)
    back = pc.decompress_trajectory(key_frames, batches, 0.25).join(order, ["anchor", "position"])
    return back.select("pid", (F.col("anchor") + F.col("step")).alias("frame"), *[F.round(a).alias(a) for a in "xyz"])


def trajectory_ragged(spark, sf_dir):
    """Late and returning particles keep their rows."""
    return _trajectory_rows(daily(spark, sf_dir), 8)


def trajectory_wide(spark, sf_dir):
    """Every other frame is too wide for the grid."""
    far = F.when(F.col("frame") % 2 == 1, F.col("x") * 1e6).otherwise(F.col("x"))
    return _trajectory_rows(daily(spark, sf_dir).withColumn("x", far), 8)


def particle_fine_grid(spark, sf_dir):
    """A grid of up to thousands of millions of cells per axis: the edge grows until block ids fit."""
    pts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pid"), F.col("o_totalprice").cast("double").alias("x"),
                                                F.col("o_custkey").cast("double").alias("y"), F.col("o_orderkey").cast("double").alias("z"))
    back = pc.decode_frames(pc.compress_frames(pts, [], 2e-4, 8), []).join(pc.frame_order(pts, [], 2e-4, 8), "position")
    return back.select("pid", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), F.round("z", 2).alias("z"))


def md_ragged(spark, sf_dir):
    """Atoms that come and go, tiles that the first frame lacks."""
    rows = daily(spark, sf_dir).select(F.lit("x").alias("axis"), "frame", F.col("pid").alias("slot"), F.col("x").alias("v"))
    conf = Config(dims=(10, 64), mode=ErrorBoundMode.ABS, abs_bound=0.25)
    return md.decompress(md.compress(rows, conf, 10, md.ADAPTIVE, 64), conf).select("axis", "frame", "slot", F.round("v").alias("v"))


FINE_SQL = """SELECT o_orderkey AS pid, round(CAST(o_totalprice AS DOUBLE), 2) AS x, CAST(o_custkey AS DOUBLE) AS y,
  CAST(o_orderkey AS DOUBLE) AS z FROM orders"""
WIDE_SQL = f"WITH {DAILY_SQL} SELECT pid, frame, CASE WHEN frame % 2 = 1 THEN x * 1e6::DOUBLE ELSE x END AS x, y, z FROM daily"

QUERIES |= {
    "trajectory_ragged": (trajectory_ragged, f"WITH {DAILY_SQL} SELECT pid, frame, x, y, z FROM daily"),
    "trajectory_wide": (trajectory_wide, WIDE_SQL),
    "particle_fine_grid": (particle_fine_grid, FINE_SQL),
    "md_ragged": (md_ragged, f"WITH {DAILY_SQL} SELECT 'x' AS axis, frame, pid AS slot, x AS v FROM daily"),
}
