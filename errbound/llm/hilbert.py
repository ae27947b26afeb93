"""Hilbert-curve shards: quantise metadata dimensions, order rows along the curve, cut runs of equal length.

Each dimension is quantised to its quantiles (2**bits levels); text dimensions are first read as numbers, from the
characters after the prefix that all values share, so levels keep their order.  The curve index comes from a state table,
one step a bit.  Rows are range-partitioned by (index, doc_id, size, checksum), so a crowded cell spreads over many
tasks; positions are local numbers plus the prefix sums of the partition counts.

Law `rows`: shard = position * shards / rows, so counts differ by one at most.

Rows: null metadata count as the smallest value, a null text has no bytes, a null doc_id comes first in its cell;
repeated rows take neighbouring places; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, utf8_bytes


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """(digit, next state) by state * 2**n + cell bits; a state is an entry corner and a direction."""
    cells, mask = 1 << n, (1 << n) - 1

    def turn_right(x: int, by: int) -> int:
        by %= n
        return ((x >> by) | (x << (n - by))) & mask

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    back = {gray(i): i for i in range(cells)}

    def trailing_ones(i: int) -> int:
        return (~i & (i + 1)).bit_length() - 1

    digits, states = [], []
    for entry in range(cells):
        for direction in range(n):
            for cell in range(cells):
                w = back[turn_right(cell ^ entry, direction + 1)]
                corner = gray(2 * ((w - 1) // 2)) if w else 0
                inner = 0 if w == 0 else trailing_ones(w - 1) % n if w % 2 == 0 else trailing_ones(w) % n
                digits.append(w)
                states.append((entry ^ turn_right(corner, -(direction + 1))) * n + (direction + inner + 1) % n)
    return digits, states


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Curve index of small non-negative integers, built in the JVM by a fold over the bits."""
    n = len(dims)
    digits, states = (F.array(*map(F.lit, x)) for x in curve_tables(n))
    named = F.struct(*(d.cast("int").alias(f"d{i}") for i, d in enumerate(dims)))

    def step(acc: Column, x: Column) -> Column:
        at = acc["state"] * (1 << n) + x + 1
        return F.struct(F.element_at(states, at).alias("state"), (acc["index"] * (1 << n) + F.element_at(digits, at)).alias("index"))

    def cell(level: Column) -> Column:
        picked = [F.call_function("shiftright", named[f"d{i}"], level).bitwiseAND(F.lit(1)) * (1 << i) for i in range(n)]
        return sum(picked[1:], picked[0])

    cells = F.transform(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), cell)
    return F.aggregate(cells, F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index")), step, lambda acc: acc["index"])


def _number(col: Column, shared: int) -> Column:
    """The seven bytes after a shared prefix as a number; order is kept."""
    head = F.rpad(F.substring(F.hex(F.substring(F.coalesce(col, F.lit("")).cast("binary"), shared + 1, 7)), 1, 14), 14, "0")
    return F.conv(head, 16, 10).cast("long")


def _level(number: Column, cuts: list) -> Column:
    """How many cuts lie below a number."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < number))


def quantised(df: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """Level of each dimension, 0 to 2**bits - 1, by the quantiles of its values."""
    text = {f.name for f in df.schema if f.dataType.typeName() == "string"}
    ends = df.agg(F.count(F.lit(1)), *(f(c).alias(f"{c}_{f.__name__}") for c in dims if c in text for f in (F.min, F.max))).first()
    numbers = []
    for c in dims:
        if c in text:
            low, high = ((ends[f"{c}_{f}"] or "").encode() for f in ("min", "max"))
            shared = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
            has_null = df.where(F.col(c).isNull()).limit(1).count()
            numbers.append(_number(F.col(c), 0 if has_null else shared))
        else:
            numbers.append(F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))))
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = df.agg(*(F.percentile_approx(x, shares).alias(f"c{i}") for i, x in enumerate(numbers))).first()
    return [_level(x, cuts[i] or [0]) for i, x in enumerate(numbers)]


def hilbert_shards(df: DataFrame, dims: list[str], shards: int = 24, bits: int = 5) -> DataFrame:
    """Rows with hilbert_index, position, shard and slot.  `df` has doc_id, size, text_crc32 and the dimensions."""
    indexed = df.withColumn("hilbert_index", hilbert_index(quantised(df, dims, bits), bits))
    keys = ["hilbert_index", "doc_id", "size", "text_crc32"]
    placed = stored(indexed.repartitionByRange(*keys).sortWithinPartitions(*keys)
                    .withColumn("_at", F.monotonically_increasing_id()), "hilbert")
    task, row = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))  # one row for each task of the sort
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
                          F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    found = placed.withColumn("_task", task).join(F.broadcast(bases), "_task").withColumn("position", F.col("_base") + row)
    found = found.withColumn("shard", F.expr(f"position * {shards} div _all").cast("int"))
    first = F.expr(f"(shard * _all + {shards - 1}) div {shards}")
    return found.withColumn("slot", (F.col("position") - first).cast("long")).drop("_at", "_task", "_base", "_all")


def shard_ranges(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """Least and greatest value of each dimension in each shard, for pruning whole files."""
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *(f(c).alias(f"{f.__name__}_{c}") for c in dims for f in (F.min, F.max)))


def write_shards(df: DataFrame, sharded: DataFrame, folder: str) -> None:
    """Write whole rows of `df` by shard, each shard sorted along the curve."""
    placed = df.join(sharded.select("doc_id", "shard", "slot"), "doc_id")
    placed.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def document_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The documents' shards by size, language and source."""
    size = utf8_bytes(F.col("text")) + 8
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), "lang", "source")
    found = hilbert_shards(rows, ["size", "lang", "source"], shards)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"), "hilbert_index")
