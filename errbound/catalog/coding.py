"""Symbol coding: sizes, tables, runs, and chunk round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errbound.catalog.series import CHUNK, EB, RADIUS, _OPEN_SQL, _open_loop
from errbound.catalog.tables import table
from errbound.functions import scalars
from errbound.operators import encoders as en
from errbound.operators import lossless
from errbound.operators.ordering import to_chunks


def _symbols(spark, sf_dir) -> DataFrame:
    return _open_loop(spark, sf_dir, EB, RADIUS).select("user_id", "pos", "q")


_SYM = f"{_OPEN_SQL}, h AS (SELECT q, count(*) AS f FROM q GROUP BY q)"


def entropy_bits(spark, sf_dir):
    bits = en.entropy_bits(en.histogram(_symbols(spark, sf_dir), [], "q"), [])
    return bits.select("n", "symbols", F.round("bits", 3).alias("bits"))


ENTROPY_SQL = f"{_SYM} SELECT CAST(sum(f) AS BIGINT) AS n, count(*) AS symbols, round(sum(f) * log2(sum(f)) - sum(f * log2(f)), 3) AS bits FROM h"


def fixed_bits(spark, sf_dir):
    return en.fixed_bits(_symbols(spark, sf_dir), ["user_id"], "q")


FIXED_SQL = f"""{_OPEN_SQL}, a AS (SELECT user_id, count(*) AS n, max(q) - min(q) + 1 AS span FROM q GROUP BY user_id)
SELECT user_id, n, CAST(greatest(1, ceil(log2(span))) AS INT) AS width,
  n * CAST(greatest(1, ceil(log2(span))) AS BIGINT) AS bits FROM a"""


def zigzag(spark, sf_dir):
    z = scalars.zigzag(F.col("q"), 2 * RADIUS)
    return _symbols(spark, sf_dir).select("user_id", "pos", z.alias("code"),
                                          (scalars.unzigzag(z, 2 * RADIUS) == F.col("q")).alias("same"))


ZIGZAG_SQL = f"""{_OPEN_SQL} SELECT user_id, pos, CASE WHEN q < {RADIUS} THEN 2 * ({RADIUS} - q) - 1
  ELSE 2 * (q - {RADIUS}) END AS code, true AS same FROM q"""


def cumfreq(spark, sf_dir):
    t = en.cumulative_frequencies(en.histogram(_symbols(spark, sf_dir), [], "q"), [], "q")
    return t.select("q", "freq", "low", "high")


CUMFREQ_SQL = f"""{_SYM}, sc AS (SELECT q, f, CASE WHEN sum(f) OVER () <= 1048576 THEN f
  ELSE greatest(1, f // CAST(ceil(sum(f) OVER () / 1048576) AS BIGINT)) END AS g FROM h)
SELECT CAST(q AS INTEGER) AS q, f AS freq, CAST(sum(g) OVER (ORDER BY q) - g AS BIGINT) AS low,
  CAST(sum(g) OVER (ORDER BY q) AS BIGINT) AS high FROM sc"""


def rle_runs(spark, sf_dir):
    """Runs of the predictable / unpredictable flag along each series."""
    flags = _symbols(spark, sf_dir).select("user_id", "pos", (F.col("q") == 0).cast("int").alias("flag"))
    return en.run_lengths(flags, ["user_id"], "pos", "flag", tile=16).select(
        "user_id", "run_start", "flag", "run_length")


RLE_SQL = f"""{_OPEN_SQL}, fl AS (SELECT user_id, pos, CASE WHEN q = 0 THEN 1 ELSE 0 END AS flag FROM q),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, flag ORDER BY pos) AS grp FROM fl)
SELECT user_id, min(pos) AS run_start, flag, count(*) AS run_length FROM g GROUP BY user_id, flag, grp"""


def huffman_codebook(spark, sf_dir):
    """Code lengths over the whole stream: a full prefix code within one bit of the entropy."""
    hist = en.histogram(_symbols(spark, sf_dir), [], "q")
    codes = en.huffman_code_lengths(hist, [], "q").agg(
        F.count(F.lit(1)).alias("symbols"), F.sum("freq").alias("n"),
        F.sum(F.pow(F.lit(2.0), -F.col("code_length"))).alias("kraft"),
        F.sum(F.col("freq") * F.col("code_length")).alias("bits"))
    ideal = en.entropy_bits(hist, []).select(F.col("bits").alias("ideal"))
    both = codes.crossJoin(F.broadcast(ideal))
    return both.select("symbols", "n", (F.abs(F.col("kraft") - 1) < 1e-12).alias("complete"),
                       ((F.col("bits") >= F.col("ideal") - 1e-6) & (F.col("bits") < F.col("ideal") + F.col("n"))).alias("near_entropy"))


CODEBOOK_SQL = f"{_SYM} SELECT count(*) AS symbols, CAST(sum(f) AS BIGINT) AS n, true AS complete, true AS near_entropy FROM h"


def _roundtrip(coder: str, byte_stage: bool = False):
    def run(spark, sf_dir):
        chunks = to_chunks(_symbols(spark, sf_dir), ["user_id"], "pos", "q", CHUNK)
        packed = en.pack("vals", coder)
        if byte_stage:
            packed = lossless.decompress(lossless.compress(packed))
        done = chunks.withColumn("payload", packed)
        return done.select("user_id", "chunk_id", F.size("vals").alias("n"),
                           (en.unpack("payload", coder) == F.col("vals").cast("array<bigint>")).alias("same"))
    return run


ROUNDTRIP_SQL = f"""{_OPEN_SQL} SELECT user_id, pos // {CHUNK} AS chunk_id, CAST(count(*) AS INT) AS n, true AS same
FROM q GROUP BY 1, 2"""


def coder_sizes(spark, sf_dir):
    """Packed bytes of each coder on each stream chunk, and the ratio they give."""
    chunks = to_chunks(_symbols(spark, sf_dir), ["user_id"], "pos", "q", CHUNK)
    coders = ("huffman", "fixed", "auto", "arithmetic")
    sized = chunks.select(F.size("vals").alias("n"), *[F.octet_length(en.pack("vals", c)).alias(c) for c in coders])
    return sized.agg(F.sum("n").alias("n"), *[F.sum(c).alias(f"{c}_bytes") for c in coders])


def lossless_ratio(spark, sf_dir):
    """zstd on whole document texts: exact round trip per language."""
    docs = table(spark, sf_dir, "documents").select("lang", F.col("text").cast("binary").alias("raw"))
    done = docs.withColumn("payload", lossless.compress("raw"))
    return done.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("raw")).alias("raw_bytes"),
        F.bool_and(lossless.decompress("payload") == F.col("raw")).alias("same"))


LOSSLESS_SQL = "SELECT lang, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS raw_bytes, true AS same FROM documents GROUP BY lang"


QUERIES = {
    "entropy_bits": (entropy_bits, ENTROPY_SQL),
    "fixed_bits": (fixed_bits, FIXED_SQL),
    "zigzag": (zigzag, ZIGZAG_SQL),
    "cumfreq": (cumfreq, CUMFREQ_SQL),
    "rle_runs": (rle_runs, RLE_SQL),
    "huffman_codebook": (huffman_codebook, CODEBOOK_SQL),
    "huffman_roundtrip": (_roundtrip("huffman"), ROUNDTRIP_SQL),
    "fixed_roundtrip": (_roundtrip("fixed"), ROUNDTRIP_SQL),
    "arith_roundtrip": (_roundtrip("arithmetic"), ROUNDTRIP_SQL),
    "bypass_roundtrip": (_roundtrip("bypass"), ROUNDTRIP_SQL),
    "zstd_roundtrip": (_roundtrip("auto", True), ROUNDTRIP_SQL),
    "lossless_ratio": (lossless_ratio, LOSSLESS_SQL),
    "coder_sizes": (coder_sizes, None),
}
