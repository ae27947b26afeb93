"""Exact top-k inner products over a bit-sliced index.

Vectors become integers floor(1024 * x).  The index holds, for each block of rows and each component, the bits of
the component above `dropped` low bits as one bitmap a bit (a slice).  For a query the slices are added with their
weights by carry-save bitmap arithmetic into the slices of a coarse score; rows are then selected from the most
significant slice downward.  The dropped bits can change a score by a known width at most, so every row within that width of
the k-th coarse score is scored exactly from its integers.  Local top rows of all blocks meet in one window.

Blocks and runs of queries are paired by co-grouping: each task holds one block and one run of queries.

Rows: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without a
vec_id; rows that repeat a vec_id are candidates and queries each; vectors are compared with those of their own length;
ties go to the smaller vec_id; an empty table gives an empty result; other columns are ignored.  Integers beyond 2**61
and scores beyond 64 bits are errors, not losses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LIMIT = 1 << 61
HIT_SCHEMA = "query_row long, query_id long, vec_id long, score long"


def _add_planes(planes: dict, words: int):
    """Carry-save sum of weighted bitmaps: {weight exponent: [bitmaps]} to one bitmap an exponent, lowest first."""
    import numpy as np

    out, level = [], 0
    carry: list = []
    while planes or carry:
        held = [*planes.pop(level, []), *carry]
        stack = np.concatenate([x.reshape(-1, words) for x in held]) if held else np.empty((0, words), np.uint64)
        carry = []
        while len(stack) > 1:
            m = len(stack) // 3
            if m:
                a, b, c = stack[:m], stack[m:2 * m], stack[2 * m:3 * m]
                ab = a ^ b
                carry.append((a & b) | (c & ab))
                stack = np.concatenate([ab ^ c, stack[3 * m:]])
            else:
                carry.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
        out.append(stack[0] if len(stack) else np.zeros(words, np.uint64))
        level += 1
    return out


def _count(bitmap) -> int:
    import numpy as np

    return int(np.bitwise_count(bitmap).sum())


def _kth_value(slices: list, every, k: int) -> int:
    """The k-th largest coarse score, bit by bit from the most significant slice; 0 if there are fewer rows."""
    above, even, value = 0, every, 0
    for i in range(len(slices) - 1, -1, -1):
        ones = even & slices[i]
        n = _count(ones)
        if above + n >= k:
            even, value = ones, value | 1 << i
        else:
            above, even = above + n, even & ~slices[i]
    return value


def _at_least(slices: list, every, value: int):
    """Rows whose coarse score is at least a value."""
    if value <= 0:
        return every
    if value >= 1 << len(slices):
        return every & ~every
    over, even = every & ~every, every
    for i in range(len(slices) - 1, -1, -1):
        if value >> i & 1:
            even = even & slices[i]
        else:
            over, even = over | (even & slices[i]), even & ~slices[i]
    return over | even


class Block:
    """Slices of one block of rows."""

    def __init__(self, rows, ids, vectors, dropped: int):
        import numpy as np

        n, self.dims = vectors.shape
        self.rows, self.ids, self.vectors, self.dropped = rows, ids, vectors, dropped
        self.most = float(np.abs(vectors).max())
        self.base = vectors.min(axis=0)
        coarse = (vectors - self.base) >> dropped
        self.bits = max(1, int(coarse.max()).bit_length())
        self.words = -(-n // 64)
        padded = np.zeros((self.words * 64, self.dims), np.int64)
        padded[:n] = coarse
        planes = ((padded.T[:, None, :] >> np.arange(self.bits)[None, :, None]) & 1).astype(bool)
        self.slices = np.ascontiguousarray(np.packbits(planes, axis=2, bitorder="little")).view(np.uint64)  # component, bit, word
        rows = np.zeros(self.words * 64, bool)
        rows[:n] = True
        self.every = np.packbits(rows, bitorder="little").view(np.uint64)

    def scores(self, rows, query):
        """Inner products; in whole numbers of any size where 64 bits may not do."""
        import numpy as np

        if self.dims * self.most * float(np.abs(query).max()) < 2.0**62:
            return self.vectors[rows] @ query
        return self.vectors[rows].astype(object) @ query.astype(object)

    def top(self, query, own: int, k: int):
        """Ids and scores of the k best rows without the query's own row."""
        import numpy as np

        planes: dict = {}
        size = np.abs(query)
        signed = np.where((query < 0)[:, None, None], ~self.slices, self.slices)
        for j in range(int(size.max()).bit_length()):
            used = np.flatnonzero(size >> j & 1)
            for b in range(self.bits):
                if len(used):
                    planes.setdefault(j + b, []).append(signed[used, b])
        slices = _add_planes(planes, self.words)
        every = self.every
        mine = np.flatnonzero(self.rows == own)
        if len(mine):
            every = every.copy()
            every[mine // 64] &= ~(np.uint64(1) << (mine % 64).astype(np.uint64))
        width = sum(size.tolist()) * ((1 << self.dropped) - 1)
        floor = (_kth_value(slices, every, k) << self.dropped) - width
        chosen = _at_least(slices, every, max(0, -(-floor >> self.dropped)) if floor > 0 else 0)
        rows = np.flatnonzero(np.unpackbits(chosen.view(np.uint8), bitorder="little"))
        scores, ids = self.scores(rows, query).tolist(), self.ids[rows].tolist()
        best = sorted(range(len(rows)), key=lambda i: (-scores[i], ids[i]))[:k]
        return [ids[i] for i in best], [scores[i] for i in best]


def _search(k: int, dropped: int):
    def run(block, queries):
        import numpy as np
        import pyarrow as pa

        out: list[list] = [[], [], [], []]
        if block.num_rows and queries.num_rows:
            def matrix(t):
                return np.frombuffer(b"".join(t.column("v").to_pylist()), ">i8").astype(np.int64).reshape(t.num_rows, -1)

            index = Block(block.column("row").to_numpy(), block.column("vec_id").to_numpy(), matrix(block), dropped)
            for r, q, v in zip(queries.column("row").to_pylist(), queries.column("query_id").to_pylist(), matrix(queries), strict=True):
                ids, scores = index.top(v, r, k)
                for column, values in zip(out, ([r] * len(ids), [q] * len(ids), ids, scores), strict=True):
                    column.extend(values)
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_row", "query_id", "vec_id", "score"])
    return run


def integer_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """row, vec_id, n (length) and v (big-endian 64-bit integers) of the vectors that take part."""
    x = F.col(vector).cast("array<double>")
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = df.where(F.col("vec_id").isNotNull() & (F.size(vector) > 0) & good).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    whole = F.transform("x", lambda e: F.when(F.abs(e) * 1024 < float(LIMIT), F.floor(e * 1024)).otherwise(F.raise_error(F.lit("a component is too large for 64 bits")).cast("long")))
    packed = F.unhex(F.array_join(F.transform(whole, lambda e: F.lpad(F.hex(e), 16, "0")), ""))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("x").alias("n"), packed.alias("v"))


def top_k(df: DataFrame, is_query, k: int = 10, block_rows: int = 8192, query_rows: int = 4096, dropped: int = 3) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for every row that `is_query` names.

    The block counts come from one aggregate; a block holds about `block_rows` rows whatever the table's size.
    """
    from .common import stored

    rows = stored(integer_vectors(df).withColumn("asks", is_query), "vectors")
    sizes = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    n_blocks, n_runs = max(1, -(-sizes[0] // block_rows)), max(1, -(-sizes[1] // query_rows))
    key = F.xxhash64("row")
    blocks = rows.select("row", "vec_id", "v", F.concat_ws("/", "n", F.pmod(key, F.lit(n_blocks))).alias("block"),
                         F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1))).alias("run"))
    asked = rows.where("asks").select("row", F.col("vec_id").alias("query_id"), "v", "n", F.pmod(key, F.lit(n_runs)).cast("int").alias("run"))
    asked = asked.select("row", "query_id", "v", "run", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"), "n")
    asked = asked.select("row", "query_id", "v", "run", F.concat_ws("/", "n", "b").alias("block"))
    local = blocks.groupBy("block", "run").cogroup(asked.groupBy("block", "run")).applyInArrow(_search(k, dropped), HIT_SCHEMA)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (select vec_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as w from embeddings
           where vec_id is not null and len(embedding) > 0
             and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(cast(q.w as double[]), cast(c.w as double[])) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id and len(q.w) = len(c.w) where q.vec_id % 100 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
