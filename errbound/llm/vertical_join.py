"""N-gram Jaccard join by vertical partitioning.

A document is the set of its 5-word shingles (63-bit hashes).  The shingles have one global order, rare ones first, which is
cut into fragments; a document's set falls into one segment a fragment.

1. Pruning.  Of a document's n shingles a partner lacks at most n - ceil(n * percent / 100).  Fragment by fragment, the shingles
   that no different set holds are counted as lacked; documents beyond their allowance leave before the next fragment is
   read.  Equal sets are one class all along.
2. Candidates.  Among the classes that are left, linked ones share one of their first n - ceil(n * percent / 100) + 1
   shingles of the order.  Members of such a shingle's bucket are compared with pivots: the member with the least
   place in front of the shingle first, then members picked at random.  Links merge into components, and pairs
   inside a component are not compared any more.  What then remains between components is compared directly, but for pairs whose
   sizes, or whose places in the bucket, leave too little room for the overlap; so no link between components is lost.
3. Overlaps.  A pair's segments meet fragment by fragment; the partial overlaps are counted apart and summed per pair.

Rows: null or wordless texts have an empty set and are linked with nothing; fewer than five words are one shingle; every row
gives a row, repeated rows too; texts that share a doc_id are judged each on its own; rows without a doc_id are linked with
nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored
from .components import merged
from .minhash import shingle_set

HASH_BITS = 63
#: The first fragment read for pruning: shingle hashes below this share of their range.
FIRST_SHARE = 0.375
FRAGMENTS = 8
#: Cells of the global order in which fragment borders are sought: levels of frequency by leading bits of the hash.
CELL_BITS = 6
#: Remaining pairs are compared directly once they are at most so many a bucket entry; a hot document's pairs are dealt in runs.
SPARE, RUN = 2, 1024
SIGNED_SCHEMA = "doc_id long, n_shingles long, set_id string, owner long, hashes array<long>"


def _stored(df: DataFrame, tag: str) -> DataFrame:
    """Store a table; the shuffles that made it are no longer needed, and Spark removes their files at once."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return stored(df, tag)
    finally:
        conf.set(name, before)


def _allowance(n: Column, percent: int) -> Column:
    """How many of n shingles a linked document may lack."""
    return n - F.ceil(n * percent / F.lit(100)).cast("long")


def _sets(share: float | None):
    """Rows of a document's set: size, digests and its hashes (only those of the first fragment, with a share)."""
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in small_batches(batches):
            sizes, ids, owners, parts = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = np.unique(shingle_set(text) >> np.uint64(1)).view(np.int64)
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest()
                sizes.append(len(found))
                ids.append(digest if len(found) else None)
                owners.append(int(digest[:15], 16))
                parts.append(found if share is None else found[:np.searchsorted(found, int(share * 2**HASH_BITS))])
            ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(owners, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))],
                names=["doc_id", "n_shingles", "set_id", "owner", "hashes"])
    return run


def _lacking(sets: DataFrame) -> DataFrame:
    """owner, lacking: how many of an owner's hashes no other owner has."""
    held = sets.select("owner", F.explode("hashes").alias("h")).groupBy("h").agg(F.min("owner").alias("owner"), F.max("owner").alias("last"))
    return held.where("owner = last").groupBy("owner").agg(F.count(F.lit(1)).alias("lacking"))


def _survivors(docs: DataFrame, classes: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """node, rep, set_id, n, hashes: classes that may be linked, after all fragments."""
    n = F.col("n_shingles")
    lacking = _stored(_lacking(signed.where("doc_id is not null")), "lacking")
    first = classes.join(lacking, "owner", "left").na.fill(0, ["lacking"])
    open_ = first.where(F.col("lacking") <= _allowance(n, percent)).select(F.col("rep").alias("doc_id"), F.col("set_id").alias("class_id"), "lacking")
    texts = docs.join(open_.select("doc_id").distinct(), "doc_id", "left_semi")
    made = texts.mapInArrow(_sets(None), SIGNED_SCHEMA).where("set_id is not null").dropDuplicates(["doc_id", "set_id"])
    sets = _stored(made.join(open_.withColumnRenamed("class_id", "set_id"), ["doc_id", "set_id"]), "open-sets")
    rest = sets.select("owner", F.filter("hashes", lambda h: h >= int(FIRST_SHARE * 2**HASH_BITS)).alias("hashes"))
    more = sets.join(_lacking(rest).withColumnRenamed("lacking", "more"), "owner", "left").na.fill(0, ["more"])
    kept = more.where(F.col("lacking") + F.col("more") <= _allowance(n, percent))
    return _stored(kept.select(F.monotonically_increasing_id().alias("node"), F.col("doc_id").alias("rep"), "set_id", n.alias("n"), "hashes"), "survivors")


def _cell(shingle: Column) -> Column:
    """Where in the global order a shingle lies: its level of frequency and the leading bits of its hash."""
    return shingle["level"] * (1 << CELL_BITS) + F.shiftright(shingle["h"], HASH_BITS - CELL_BITS).cast("int")


def _ordered(survivors: DataFrame) -> DataFrame:
    """node, n, shared: the shingles (level, h) that other survivors hold as well, in the global order."""
    rows = survivors.select("node", F.explode("hashes").alias("h"))
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("h", F.floor(F.log2("df")).cast("int").alias("level"))
    found = rows.join(counts, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("level", "h"))).alias("shared"))
    return _stored(found.join(survivors.select("node", "n"), "node"), "ordered")


def _segments(ordered: DataFrame, fragments: int) -> DataFrame:
    """node, fragment, hashes: the sets cut at borders between cells of the order, evenly by use; at most 64 * 2**CELL_BITS cells."""
    cells = ordered.select(F.explode("shared").alias("s")).groupBy(_cell(F.col("s")).alias("cell")).count().collect()
    uses = sorted(tuple(r) for r in cells)
    total, upto, borders = sum(n for _, n in uses), 0, []
    for at, n in uses:
        if upto * fragments >= (len(borders) + 1) * total:
            borders.append(at)
        upto += n

    def before(border: int) -> Column:
        return F.size(F.filter("shared", lambda s: _cell(s) < border))

    ends = [*map(before, borders), F.size("shared")]
    placed = ordered.select("node", "shared", F.array(F.lit(0), *ends).alias("ends"))
    cut = placed.select("node", "shared", F.posexplode(F.arrays_zip(F.slice("ends", 1, len(ends)).alias("a"), F.slice("ends", 2, len(ends)).alias("b"))).alias("fragment", "e"))
    some = cut.where("e.a < e.b")
    return some.select("node", "fragment", F.transform(F.slice("shared", F.col("e.a") + 1, F.col("e.b") - F.col("e.a")), lambda s: s["h"]).alias("hashes"))


def _buckets(ordered: DataFrame, percent: int) -> DataFrame:
    """bucket, node, n, place: each class under the first shingles of its order of which linked classes share one."""
    own = F.col("n") - F.size("shared")  # shingles that no other has come first
    room = F.greatest(_allowance(F.col("n"), percent) + 1 - own, F.lit(0)).cast("int")
    first = ordered.select("node", "n", own.alias("own"), F.posexplode(F.slice("shared", F.lit(1), room)).alias("at", "s"))
    rows = first.select(F.col("s.h").alias("bucket"), "node", "n", (F.col("own") + F.col("at") + 1).alias("place"))
    full = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("bucket")
    return _stored(rows.join(full, "bucket"), "members")


class _Linker:
    def __init__(self, members: DataFrame, segments: DataFrame, percent: int):
        self.members, self.segments, self.percent = members, segments, percent
        self.labels = members.sparkSession.createDataFrame([], "node long, component long")
        self.tested: DataFrame | None = None

    def _attached(self, pairs: DataFrame, side: str, on: list[str]) -> DataFrame:
        """Bring one side's segments to the pairs; the pairs of a document in many of them are dealt in runs."""
        other = "b" if side == "a" else "a"
        busy = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("uses")).where(F.col("uses") > RUN).select(side, F.ceil(F.col("uses") / RUN).cast("int").alias("runs"))
        mine = self.segments.select(F.col("node").alias(side), "fragment", F.col("hashes").alias(f"hashes_{side}"))
        mine = mine.join(pairs.select(side).distinct(), side).join(busy, side, "left")
        mine = mine.withColumn("run", F.explode(F.sequence(F.lit(0), F.coalesce("runs", F.lit(1)) - 1))).drop("runs")
        dealt = pairs.join(busy, side, "left").withColumn("run", F.pmod(F.xxhash64(other), F.coalesce("runs", F.lit(1))).cast("int")).drop("runs")
        return dealt.join(mine, [side, "run", *on]).drop("run")

    def overlaps(self, pairs: DataFrame) -> DataFrame:
        """a, b, shared: partial overlaps by fragment, summed per pair."""
        one = self._attached(pairs.select("a", "b"), "a", [])
        both = self._attached(one, "b", ["fragment"])
        partial = both.select("a", "b", "fragment", F.size(F.array_intersect("hashes_a", "hashes_b")).alias("partial"))
        return partial.groupBy("a", "b").agg(F.sum("partial").alias("shared"))

    def _test(self, pairs: DataFrame) -> bool:
        """Compare pairs that were not compared before and merge what they link; whether there was a link."""
        fresh = pairs.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
        if self.tested is not None:
            fresh = fresh.join(self.tested, ["a", "b"], "left_anti")
        fresh = _stored(fresh, "pairs")
        self.tested = fresh.select("a", "b") if self.tested is None else self.tested.union(fresh.select("a", "b"))
        linked = (100 + self.percent) * F.col("shared") >= self.percent * (F.col("n_a") + F.col("n_b"))
        links = _stored(fresh.join(self.overlaps(fresh), ["a", "b"]).where(linked).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
        if not links.limit(1).count():
            return False
        self.labels = _stored(merged(self.labels, links), "labels")
        return True

    def _room(self, x: str, y: str) -> Column:
        """Whether sizes and places in a bucket leave room for the overlap, if the bucket's shingle is the first that both have."""
        n_x, n_y = F.col(f"n_{x}"), F.col(f"n_{y}")
        after = 1 + F.least(n_x - F.col(f"place_{x}"), n_y - F.col(f"place_{y}"))
        return (100 * F.least(n_x, n_y) >= self.percent * F.greatest(n_x, n_y)) & ((100 + self.percent) * after >= self.percent * (n_x + n_y))

    def run(self) -> DataFrame:
        """node, component of every linked class."""
        spare, turn, last = SPARE * self.members.count(), 0, False
        while True:
            placed = self.members.join(self.labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
            rank = F.xxhash64("node", F.lit(turn)) if turn else F.col("place")
            groups = placed.groupBy("bucket", "component").agg(
                F.count(F.lit(1)).alias("held"), F.min(F.struct(rank.alias("rank"), "node", "n", "place", "component")).alias("pivot"))
            open_ = _stored(groups.groupBy("bucket").agg(
                F.count(F.lit(1)).alias("groups"), F.sum("held").alias("held"), F.max(F.struct("held", "component")).alias("main"),
                F.min("pivot").alias("pivot")).where("groups > 1"), "open-buckets")
            rest = open_.agg(F.sum(F.col("held") * (F.col("held") - F.col("main.held")))).first()[0] or 0
            last = last or (turn > 0 and rest <= spare)
            pairs = self._rest(placed, open_) if last else self._to_pivots(placed, open_)
            found = self._test(pairs)
            if last or not rest:
                return self.labels
            turn, last = turn + 1, not found

    def _side(self, rows: DataFrame, name: str) -> DataFrame:
        return rows.select("bucket", F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("n", "place", "component")))

    def _named(self, pairs: DataFrame, x: str, y: str) -> DataFrame:
        low = F.col(x) < F.col(y)
        return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.when(low, F.col(f"n_{x}")).otherwise(F.col(f"n_{y}")).alias("n_a"),
                            F.when(low, F.col(f"n_{y}")).otherwise(F.col(f"n_{x}")).alias("n_b"))

    def _to_pivots(self, placed: DataFrame, open_: DataFrame) -> DataFrame:
        pivots = self._side(open_.select("bucket", "pivot.node", "pivot.n", "pivot.place", "pivot.component"), "y")
        pairs = self._side(placed, "x").join(pivots, "bucket").where("component_x <> component_y").where(self._room("x", "y"))
        return self._named(pairs, "x", "y")

    def _rest(self, placed: DataFrame, open_: DataFrame) -> DataFrame:
        """Pairs of different components in open buckets: those outside the main component with all others, once."""
        left = placed.join(open_.select("bucket", F.col("main.component").alias("main")), "bucket")
        outside = self._side(left.where("component <> main"), "x")
        others = self._side(left, "y").join(open_.select("bucket", F.col("main.component").alias("main")), "bucket")
        pairs = outside.join(others, "bucket").where("component_x <> component_y").where(self._room("x", "y")).where("component_y = main or x < y")
        return self._named(pairs, "x", "y")


def similar_documents(docs: DataFrame, percent: int = 80, fragments: int = FRAGMENTS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = _stored(texts.mapInArrow(_sets(FIRST_SHARE), SIGNED_SCHEMA), "sets")
    named = signed.where("doc_id is not null and set_id is not null")
    classes = _stored(named.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("owner").alias("owner")), "classes")
    survivors = _survivors(texts, classes, signed, percent)
    ordered = _ordered(survivors)
    members = _buckets(ordered, percent)
    segments = _stored(_segments(ordered.join(members.select("node").distinct(), "node"), fragments), "segments")
    labels = _Linker(members, segments, percent).run()
    linked = survivors.select("node", "rep", "set_id").join(labels, "node")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    known = classes.select("set_id", "rep").join(linked.join(least, "component").select("set_id", "least"), "set_id", "left")
    known = known.select("set_id", F.coalesce("least", "rep").alias("class_component"))
    rows = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id"))
    return rows.join(known, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("class_component", "doc_id").alias("component_id"))


ORACLE = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
      else list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) end as sh from w),
n as (select doc_id, len(sh) as n_shingles from s),
e as materialized (select doc_id, hash(unnest(sh)) as h from s),
p as materialized (select a.doc_id as a, b.doc_id as b, count(*) as shared from e a join e b on a.h = b.h and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as materialized (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * shared >= 80 * (x.n_shingles + y.n_shingles - shared)),
g as materialized (select a, b from l union all select b, a from l),
r as (select doc_id as node, doc_id as reach from n union select r.node, g.b from r join g on r.reach = g.a)
select n.doc_id, n_shingles, min(reach) as component_id from n join r on n.doc_id = r.node group by n.doc_id, n_shingles
"""
