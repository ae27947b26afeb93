"""Near-duplicate documents by circulant MinHash.

A document is the set of its 5-word shingles (64-bit hashes of the lower-cased words).  A first permutation sends a
shingle to a slot of a circle of 2**22; a second one is a fixed table of the slots' ranks.  Coordinate k of the signature is
the least rank over the document's slots after the table is shifted circularly by k, so the values that one
shingle offers to all coordinates are one window of the table, and the signature is the elementwise minimum of windows.
128 coordinates make 32 bands of 4: a pair at similarity 0.75 shares no band with probability 6e-6.

Equal sets are one class.  Class representatives meet in band buckets; each bucket compares its members with a pivot, by exact
Jaccard similarity on full sets made again from the texts.  Linked members are merged into components, and buckets
documents of buckets that still hold several components are dealt anew, by their rarest shingles of which linked documents must
share one; there buckets get more pivots, picked at random.  Once the remaining pairs are few for the number of
bucket entries, or pivots find nothing more, they are compared directly (with large components by block scans), except those within one component and those
whose set sizes or whose distances from the first pivot differ by too much to be linked (the Jaccard distance is
a metric).  So no pair of a band bucket that could change a component is left out, and no bucket of copies is squared.

Rows: null or wordless texts have an empty set and are linked with nothing; fewer than five words are one shingle; every row
gives a row, repeated rows too; texts that share a doc_id are one document, linked by any of them; rows without a
doc_id are linked with nothing and kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept_for, small_batches, stored
from .components import merged

WORDS = 5
BANDS, ROWS = 32, 4
SLOT_BITS = 22
#: The remaining pairs are compared directly once they are at most so many for each bucket entry.
SPARE = 4
#: Components of more documents are scanned in blocks and runs of so many documents, instead of pair by pair.
LARGE, BLOCK, RUN = 16, 1024, 1024
PAIR_SCHEMA = "a long, b long, shared long, n_a long, n_b long"
#: Odd multipliers of the shingle hash, and the multipliers of the mixing step.
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
SIGNATURE_SCHEMA = "doc_id long, n_shingles long, set_id string, bands array<long>"


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None):
    """Sorted distinct 64-bit hashes of a text's shingles."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8").lower().split()  # lower() and split() of bytes know ASCII only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    size = min(n, WORDS)
    total = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        total += hashes[i:n - size + 1 + i] * np.uint64(_ODD[i])
    return np.unique(_mixed(total))


@kept_for("minhash", 1)
def _windows():
    """The rank table as overlapping windows of one value a coordinate, closed to a circle."""
    import numpy as np

    ranks = np.random.default_rng(20_061).permutation(1 << SLOT_BITS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[:BANDS * ROWS - 1]]), BANDS * ROWS)


def signature(shingles):
    """All coordinates of a non-empty set."""
    import numpy as np

    windows, slots = _windows(), (_mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    out = windows[slots[:4096]].min(axis=0)
    for a in range(4096, len(slots), 4096):
        out = np.minimum(out, windows[slots[a:a + 4096]].min(axis=0))
    return out


def band_keys(coordinates):
    import numpy as np

    rows = coordinates.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = _mixed(key * np.uint64(_ODD[i]) + rows[:, i])
    return key.view(np.int64)


def _signatures(batches):
    import hashlib

    import numpy as np
    import pyarrow as pa

    for batch in small_batches(batches):
        sizes, ids, bands = [], [], []
        for text in batch.column("text").to_pylist():
            found = shingle_set(text)
            sizes.append(len(found))
            ids.append(hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest() if len(found) else None)
            bands.append(band_keys(signature(found)) if len(found) else np.empty(0, np.int64))
        ends = np.cumsum([0, *map(len, bands)], dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.string()),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*bands, np.empty(0, np.int64)])))],
            names=["doc_id", "n_shingles", "set_id", "bands"])


def _compare(batches):
    import numpy as np
    import pyarrow as pa

    for batch in small_batches(batches):
        found, last, held = [], None, None
        for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
            if a != last:
                last, held = a, shingle_set(a)
            other = shingle_set(b)
            found.append((len(np.intersect1d(held, other, assume_unique=True)), len(held), len(other)))
        columns = list(zip(*found, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(c, pa.int64()) for c in columns)],
                                        names=["a", "b", "shared", "n_a", "n_b"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, shared, n_a, n_b of pairs of representatives, on full sets made from their texts."""
    one = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = one.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_compare, PAIR_SCHEMA)


def _linked(shared, n_a, n_b, percent: int):
    return 100 * shared >= percent * (n_a + n_b - shared)


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(texts.mapInArrow(_signatures, SIGNATURE_SCHEMA), "signatures")
    return labelled(signed, texts, percent)


def labelled(signed: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    known = signed.where(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(known.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"),
                                                 F.first("bands").alias("bands")), "classes")
    rows = classes.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    full = rows.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("bucket")
    members = stored(rows.join(full, "bucket"), "members")
    texts = stored(texts.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id"), "texts")  # few of all
    state = _State(texts, percent)
    state.compare(members, rounds=1)
    state.compare(_rare_prefixes(state.still_open(members), texts, percent))
    labels = state.labels
    found = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("class_component"))
    rows = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id"))
    return (rows.join(found, "set_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("class_component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


class _State:
    """Pairs tested so far and the components that their links make."""

    def __init__(self, texts: DataFrame, percent: int):
        self.texts, self.percent, self.tested = texts, percent, None
        self.labels = texts.sparkSession.createDataFrame([], "node long, component long")

    def _placed(self, members: DataFrame) -> DataFrame:
        return (members.join(self.labels.withColumnRenamed("node", "rep"), "rep", "left")
                .withColumn("component", F.coalesce("component", "rep")))

    def _open(self, placed: DataFrame, turn: int) -> DataFrame:
        """Buckets of several components, with their sizes, main component and next pivot."""
        rank = F.xxhash64("rep", "bucket", F.lit(turn)) if turn else F.col("rep")
        groups = placed.groupBy("bucket", "component").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct(rank.alias("rank"), "rep", "n_shingles")).alias("p"))
        return stored(groups.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("main"),
            F.min(F.struct("p.rank", "p.rep", "p.n_shingles", "component")).alias("p")).where("groups > 1"), "open")

    def still_open(self, members: DataFrame) -> DataFrame:
        """Documents of buckets that hold several components."""
        placed = self._placed(members)
        return stored(placed.join(self._open(placed, 0).select("bucket"), "bucket").select("rep").distinct(), "open-documents")

    def compare(self, members: DataFrame, rounds: int | None = None) -> None:
        """Compare members of a bucket with pivots, and without a limit of rounds all pairs that may still matter."""
        room, turn, last = SPARE * members.count(), 0, False
        while turn != rounds:
            placed = self._placed(members)
            open_ = self._open(placed, turn)
            rest = open_.agg(F.sum(F.col("n") * (F.col("n") - F.col("main.n")))).first()[0] or 0
            last = last or (turn > 0 and rest <= room)
            if last:
                sizes = placed.select("rep", "component").distinct().groupBy("component").agg(F.count(F.lit(1)).alias("held"))
                large = stored(sizes.where(F.col("held") > LARGE), "large")
                pairs = _rest(placed, open_, large, self.tested, self.percent)
                self._keep(stored(self._scanned(placed, open_, large), "scanned"))
            else:
                pivots = open_.select("bucket", F.col("p.rep").alias("pivot"), F.col("p.n_shingles").alias("n_p"), F.col("p.component").alias("c_p"))
                near = placed.join(pivots, "bucket").where("component <> c_p").where(_sizes_fit("n_shingles", "n_p", self.percent))
                pairs = near.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
            found = self._test(pairs.distinct())
            if last:
                return
            turn, last = turn + 1, not found

    def _test(self, pairs: DataFrame) -> bool:
        """Test new pairs and merge what they link; whether there was a link."""
        if self.tested is not None:
            pairs = pairs.join(self.tested.select("a", "b"), ["a", "b"], "left_anti")
        return self._keep(stored(_verified(stored(pairs, "pairs"), self.texts), "verified"))

    def _scanned(self, placed: DataFrame, open_: DataFrame, large: DataFrame) -> DataFrame:
        """Links between large components and the documents outside that share a bucket with them.

        A large component is cut into blocks of documents and its askers into runs; a task counts the shingles that each asker
        shares with all documents of a block at once and returns links only.
        """
        outside = placed.join(open_.select("bucket", F.col("main.component").alias("main")), "bucket").where("component <> main")
        inside = placed.join(large, "component").groupBy("bucket", "component").agg(F.first("held").alias("held"))
        asks = outside.select("bucket", "rep", F.col("component").alias("own")).join(inside, "bucket").where("own <> component")
        asks = stored(asks.select("rep", "component", "held").distinct(), "asks")
        plan = stored(asks.groupBy("component").agg(F.ceil(F.first("held") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count(F.lit(1)) / RUN).cast("int").alias("runs")), "plan")

        def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
            placed_ = rows.join(plan, "component").withColumn(own, F.pmod(F.xxhash64("rep"), F.col(f"{own}s")).cast("int"))
            spread = placed_.select("component", "rep", own, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other))
            return (spread.join(self.texts.withColumnRenamed("doc_id", "rep"), "rep")
                    .select(*(F.col(c).alias(c) for c in ("component", "block", "run", "rep", "text"))).groupBy("component", "block", "run"))

        held = dealt(placed.select("component", "rep").distinct(), "block", "run")
        return held.cogroup(dealt(asks.select("component", "rep"), "run", "block")).applyInArrow(_scan(self.percent), PAIR_SCHEMA)

    def _keep(self, fresh: DataFrame) -> bool:
        linked = _linked(F.col("shared"), F.col("n_a"), F.col("n_b"), self.percent)
        self.tested = fresh if self.tested is None else self.tested.unionByName(fresh)
        if not fresh.where(linked).limit(1).count():
            return False
        links = fresh.where(linked).select(F.col("a").alias("u"), F.col("b").alias("v"))
        self.labels = stored(merged(self.labels, links), "labels")
        return True


def _scan(percent: int):
    def run(block, asks):
        import numpy as np
        import pyarrow as pa

        out = []
        if block.num_rows and asks.num_rows:
            sets = [shingle_set(t) for t in block.column("text").to_pylist()]
            reps, sizes = block.column("rep").to_numpy(), np.array([len(x) for x in sets])
            keys, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            for rep, text in zip(asks.column("rep").to_pylist(), asks.column("text").to_pylist(), strict=True):
                mine = shingle_set(text)
                low, high = np.searchsorted(keys, mine), np.searchsorted(keys, mine, "right")
                n = high - low
                hits = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
                shared = np.bincount(owner[hits], minlength=len(sets))
                for i in np.flatnonzero(_linked(shared, len(mine), sizes, percent) & (reps != rep)):
                    pair = sorted(((rep, len(mine)), (int(reps[i]), int(sizes[i]))))
                    out.append((pair[0][0], pair[1][0], int(shared[i]), pair[0][1], pair[1][1]))
                    break  # one link joins the asker to the whole component
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "shared", "n_a", "n_b"])
    return run


def _shingle_rows(batches):
    import numpy as np
    import pyarrow as pa

    for batch in small_batches(batches, 128):
        sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        sizes = np.array([len(x) for x in sets], np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(owner)), batch.column("version").take(pa.array(owner)), pa.array(sizes[owner]),
                                          pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64))], names=["rep", "version", "n_shingles", "bucket"])


def _rare_prefixes(documents: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """bucket, rep, n_shingles: each document under the rarest shingles of which linked documents must share one.

    Of n shingles, rarest first, linked documents share one of the first n - ceil(n * percent / 100) + 1.  Shingles that only
    one document has fill places but join nothing, so documents that share only a common passage drop out here.
    """
    whole = texts.join(documents, texts["doc_id"] == documents["rep"]).select("rep", F.xxhash64("text").alias("version"), "text")
    rows = stored(whole.mapInArrow(_shingle_rows, "rep long, version long, n_shingles long, bucket long"), "shingles")
    counts = stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1"), "uses")
    common = stored(rows.join(counts, "bucket"), "common")
    size = F.col("n_shingles")
    places = size - F.ceil(size * percent / 100) + 1
    left = (common.groupBy("rep", "version", "n_shingles").agg(F.count(F.lit(1)).alias("shared"))
            .select("rep", "version", "shared", (places - (size - F.col("shared"))).alias("places")).where("places > 0"))
    order = Window.partitionBy("rep", "version").orderBy("uses", "bucket")
    ranked = common.join(left, ["rep", "version"]).withColumn("at", F.row_number().over(order)).where("at <= places")
    # a document's place counts its shingles that nobody shares, too
    return stored(ranked.select("bucket", "rep", "n_shingles", (size - F.col("shared") + F.col("at")).alias("place")), "prefixes")


def _sizes_fit(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _rest(placed: DataFrame, open_: DataFrame, large: DataFrame, tested: DataFrame | None, percent: int) -> DataFrame:
    """Pairs in still open buckets that no scan covers and no bound rules out: other component, fitting sizes, places and distances.

    A bucket's main component is compared with the rest unless it is large, and the rest with each other once; the scans cover
    large components.  Linked documents meet at their first common shingle, and what follows it in both must suffice.
    The distances are those from the bucket's first pivot, its smallest member; members that were never compared with it
    (they joined its component by others, or their sizes do not fit) have no bound.
    """
    first = placed.groupBy("bucket").agg(F.min("rep").alias("pivot"))
    left = placed.join(first, "bucket")
    if tested is not None:
        far = tested.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), (1 - F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("d"))
        left = left.join(far, ["pivot", "rep"], "left")
    else:
        left = left.withColumn("d", F.lit(None).cast("double"))
    left = left.withColumn("d", F.when(F.col("rep") == F.col("pivot"), 0.0).otherwise(F.col("d")))
    left = left.join(open_.select("bucket", F.col("main.component").alias("main")), "bucket").join(large, "component", "left")
    left = left.withColumn("large", F.col("held").isNotNull()).withColumn("in_main", F.col("component") == F.col("main"))

    def side(rows: DataFrame, name: str) -> DataFrame:
        kept = (("n_shingles", "n"), ("component", "c"), ("place", "p"), ("d", "d"), ("large", "large"), ("in_main", "in_main"))
        return rows.select("bucket", F.col("rep").alias(name), *(F.col(c).alias(f"{short}_{name}") for c, short in kept))

    slack = 1 - percent / 100 + 1e-9
    follow = 1 + F.least(F.col("n_x") - F.col("p_x"), F.col("n_y") - F.col("p_y"))
    pairs = side(left.where(~F.col("in_main")), "x").join(side(left.where(~F.col("large")), "y"), "bucket").where("c_x <> c_y")
    pairs = pairs.where("in_main_y or (not large_x and x < y)").where(_sizes_fit("n_x", "n_y", percent))
    pairs = pairs.where((100 + percent) * follow >= percent * (F.col("n_x") + F.col("n_y")))
    pairs = pairs.where(F.col("d_x").isNull() | F.col("d_y").isNull() | (F.abs(F.col("d_x") - F.col("d_y")) <= slack))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The documents without all but one of each near-duplicate group, whole rows."""
    drop = near_duplicates(docs, percent).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)


ORACLE = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
      else list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) end as sh from w),
n as (select doc_id, len(sh) as n_shingles from s),
e as materialized (select doc_id, hash(unnest(sh)) as h from s),
p as materialized (select a.doc_id as a, b.doc_id as b, count(*) as shared from e a join e b on a.h = b.h and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as materialized (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * shared >= 75 * (x.n_shingles + y.n_shingles - shared)),
g as materialized (select a, b from l union all select b, a from l),
r as (select doc_id as node, doc_id as reach from n union select r.node, g.b from r join g on r.reach = g.a)
select n.doc_id, n_shingles, min(reach) as component_id, n.doc_id = min(reach) as kept from n join r on n.doc_id = r.node group by n.doc_id, n_shingles
"""
