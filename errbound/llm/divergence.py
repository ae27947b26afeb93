"""Source divergence audit by a token-start pointer sort.

A shard is a slice of an Arrow text buffer.  Every word start in it is a pointer to the suffix that begins there; the
pointers are put in order by multikey quicksort, eight bytes at a time and no further than the word's end, so that equal words
are runs of pointers.  A run gives the term's occurrences by document, hence its document frequency and its counts by
source; only those sums leave the shard.  Spark adds them up, keeps each language's frequent terms and compares the sources'
smoothed rates, in integers throughout: pairs of sources by sums over slices of the terms, for blocks of sources at a time.

Rows: null text, lang and source are empty strings; every row is a document of its own, repeated rows and null
doc_ids too; a group without terms has all rates equal; a language without kept terms has pairs of value 0 and no terms; equal
values rank by item; texts longer than a slice are cut between words and counted as one document; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

LEAST_DOCS = 30
TOP_TERMS = 50
SCALE, PRIOR = 1_000_000_000, 5
#: Bytes of text in a slice, and how many sources and terms a task compares at a time.
SLICE_BYTES = 12_000_000
SOURCE_BLOCK, TERM_SLICE = 128, 8192
ROW_SCHEMA = "lang string, source string, term string, n long, docs long"
PAIR_SCHEMA = "lang string, a string, b string, apart long, terms long"


def _byte_tables():
    import numpy as np

    code = np.arange(256)
    letters = ((code >= 0x41) & (code <= 0x5A)) | ((code >= 0x61) & (code <= 0x7A)) | (code >= 0x80)
    return letters, np.where((code >= 0x41) & (code <= 0x5A), code + 32, code).astype(np.uint8)


def word_bounds(data, offsets):
    """Starts and ends of the words of a lower-cased buffer; words end with their document."""
    import numpy as np

    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _byte_tables()[0][data]
    opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    opens[edges], closes[edges - 1] = inside[1:-1][edges], inside[1:-1][edges - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def pointer_sort(data, starts, ends):
    """Word pointers in lexicographic order, and the number of each one's run of equal words; equal words keep their places' order.

    Multikey quicksort over eight-byte characters: pointers are sorted by the character at a depth, and only runs of equal
    characters whose words go on are sorted by the next.
    """
    import numpy as np

    padded = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    keep = np.array([0] + [((1 << 8 * k) - 1) << (64 - 8 * k) for k in range(1, 9)], np.uint64)

    def character(pointers, depth):
        left = np.clip(ends[pointers] - starts[pointers] - depth, 0, 8)
        at = np.minimum(starts[pointers] + depth, len(data))
        return np.ascontiguousarray(padded[at]).view(">u8").ravel().astype(np.uint64) & keep[left]

    every = np.arange(len(starts))
    key = character(every, 0)
    order = np.argsort(key, kind="stable")
    first = np.ones(len(order), bool)
    first[1:] = key[order[1:]] != key[order[:-1]]
    depth = 8
    while len(order):
        run = np.cumsum(first) - 1
        goes_on = np.zeros(run[-1] + 1, bool)
        goes_on[run[(ends - starts)[order] > depth]] = True
        active = np.flatnonzero(goes_on[run])
        if not len(active):
            return order, run
        key, segment = character(order[active], depth), run[active]
        turn = np.lexsort((key, segment))
        order[active], key = order[active][turn], key[turn]
        first[active[1:]] |= key[1:] != key[:-1]
        depth += 8
    return order, np.zeros(0, np.int64)


def run_counts(data, offsets, groups):
    """(starts, ends, group, occurrences, documents) of each term and group in a slice, in the terms' order."""
    import numpy as np

    starts, ends = word_bounds(data, offsets)
    order, run = pointer_sort(data, starts, ends)
    if not len(order):
        return (np.zeros(0, np.int64),) * 5
    doc = (np.searchsorted(offsets, starts, "right") - 1)[order]
    first = np.ones(len(order), bool)
    first[1:] = (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])  # a term in a document: equal words keep their order
    at = np.flatnonzero(first)
    n, width = np.diff(np.append(at, len(order))), int(groups.max()) + 1
    key = run[at] * width + groups[doc[at]]
    turn = np.argsort(key, kind="stable")
    sorted_key = key[turn]
    cut = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1]))
    head = order[at[turn[cut]]]
    return starts[head], ends[head], sorted_key[cut] % width, np.add.reduceat(n[turn], cut), np.diff(np.append(cut, len(turn)))


def _buffer(texts):
    """Bytes and offsets of an Arrow string array, from 0."""
    import numpy as np
    import pyarrow as pa

    texts = texts.cast(pa.large_string())
    held = texts.buffers()
    offsets = np.frombuffer(held[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(held[2], np.uint8)[offsets[0]:offsets[-1]] if held[2] is not None else np.zeros(0, np.uint8)
    return _byte_tables()[1][data], offsets - offsets[0]


def _long_counts(data, limit: int) -> Counter:
    """Occurrences of each term of one long text, a piece at a time; pieces are cut between words."""
    import numpy as np

    total, at, letters = Counter(), 0, _byte_tables()[0]
    while at < len(data):
        to = min(at + limit, len(data))
        while to < len(data) and letters[data[to - 1]] and letters[data[to]]:
            free = np.flatnonzero(~letters[data[to:to + limit]])
            to = to + int(free[0]) if len(free) else min(to + limit, len(data))
        piece = data[at:to]
        for a, b, _, n, _ in zip(*run_counts(piece, np.array([0, len(piece)]), np.zeros(1, np.int64)), strict=True):
            total[piece[a:b].tobytes()] += int(n)
        at = to
    return total


def _slices(batches, limit: int):
    """Runs of rows of about `limit` bytes of text; a longer text is alone."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        sizes = np.append(0, np.cumsum(pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + limit, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def term_counts(limit: int = SLICE_BYTES):
    def count(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        for batch in _slices(batches, limit):
            data, offsets = _buffer(batch.column("text"))
            names = [batch.column(c).dictionary_encode() for c in ("lang", "source")]
            code = [x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in names]
            width = len(names[1].dictionary)
            if len(data) > limit and batch.num_rows == 1:
                counts = _long_counts(data, limit)
                words, n = pa.array([w.decode() for w in counts], pa.string()), np.fromiter(counts.values(), np.int64, len(counts))
                group, docs = np.full(len(n), code[0][0] * width + code[1][0]), np.ones(len(n), np.int64)
            else:
                starts, ends, group, n, docs = run_counts(data, offsets, code[0] * width + code[1])
                long = np.append(0, np.cumsum(ends - starts))
                flat = data[np.arange(long[-1]) + np.repeat(starts - long[:-1], ends - starts)]
                words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(long.astype(np.int32)), pa.py_buffer(flat))
            yield pa.RecordBatch.from_arrays(
                [names[0].dictionary.take(pa.array(group // max(width, 1))), names[1].dictionary.take(pa.array(group % max(width, 1))), words,
                 pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])
    return count


def _rate(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exact at any count."""
    whole = (n + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    left = (total + terms * PRIOR).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", whole, F.nullif(left, F.lit(0).cast("decimal(20,0)"))).cast("long")


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n, lang_n: occurrences of each language's kept terms by source, where there are any."""
    found = docs.mapInArrow(term_counts(), ROW_SCHEMA).repartition("lang", "term")
    counts = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    both = counts.withColumn("lang_docs", F.sum("docs").over(same)).withColumn("lang_n", F.sum("n").over(same))
    return both.where(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n")


def group_facts(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total, terms, lang_total, sources and the rate of an absent term of every occurring group."""
    langs = (kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang")
             .agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total")))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct()
    sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    known = groups.join(sources, "lang").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    known = known.na.fill(0, ["total", "terms", "lang_total"])
    return known.withColumn("absent", _rate(F.lit(0), F.col("total"), F.col("terms")))


def _apart(key, rows):
    """Sums over the terms of a slice of the differences between the sources of two blocks."""
    import numpy as np
    import pyarrow as pa

    names, terms = rows.column("source").combine_chunks().dictionary_encode(), rows.column("term").combine_chunks().dictionary_encode()
    at, rate = names.indices.to_numpy(), rows.column("rate").to_numpy()
    word = terms.indices.fill_null(-1).to_numpy()
    marker = word < 0
    table = np.zeros((len(names.dictionary), len(terms.dictionary)), np.int64)
    block, absent = np.zeros(len(table), np.int64), np.zeros(len(table), np.int64)
    absent[at[marker]], block[at[marker]] = rate[marker], rows.column("block").to_numpy()[marker]
    table[:] = absent[:, None]
    table[at[~marker], word[~marker]] = rate[~marker]
    low, high = (k.as_py() for k in key[1:3])
    a_all, b_all, apart = [], [], []
    for a in np.flatnonzero(block == low):
        others = np.flatnonzero(block == high)
        others = others[others > a] if low == high else others
        a_all.append(np.full(len(others), a))
        b_all.append(others)
        apart.append(np.abs(table[others] - table[a]).sum(axis=1))
    a_all, b_all, apart = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a_all, b_all, apart))
    return pa.table({"lang": pa.array([key[0].as_py()] * len(a_all), pa.string()), "a": names.dictionary.take(pa.array(a_all)),
                     "b": names.dictionary.take(pa.array(b_all)), "apart": pa.array(apart, pa.int64()),
                     "terms": pa.array(np.full(len(a_all), table.shape[1]), pa.int64())})


def _pairs(rates: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for every two sources of a language."""
    blocks = F.ceil(F.col("sources") / SOURCE_BLOCK).cast("int")
    slices = F.greatest(F.ceil(F.col("terms") / TERM_SLICE), F.lit(1)).cast("int")
    block = F.pmod(F.xxhash64("source"), blocks).cast("int")
    facts = groups.select("lang", "source", "terms", "absent", blocks.alias("blocks"), slices.alias("slices"), block.alias("block"))
    cells = rates.join(facts.select("lang", "source", "blocks", "slices", "block"), ["lang", "source"])
    cells = cells.select("lang", "source", "term", "rate", "blocks", "block", F.pmod(F.xxhash64("term"), "slices").cast("int").alias("slice"))
    markers = facts.where("terms > 0").select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("absent").alias("rate"), "blocks", "block",
                                              F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    dealt = cells.unionByName(markers).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "slice", "source", "term", "rate", "block")
    parts = dealt.groupBy("lang", "low", "high", "slice").applyInArrow(_apart, PAIR_SCHEMA)
    one = parts.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "apart", "terms")
    apart = one.groupBy("lang", "a", "b").agg(F.sum("apart").alias("apart"), F.sum("terms").alias("seen"))
    left = facts.select("lang", F.col("source").alias("a"), F.col("absent").alias("absent_a"), "terms", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = facts.select("lang", "block", F.col("source").alias("b"), F.col("absent").alias("absent_b"))
    every = left.join(right, ["lang", "block"]).where("a < b").join(apart, ["lang", "a", "b"], "left")
    rest = (F.col("terms") - F.coalesce("seen", F.lit(0))) * F.abs(F.col("absent_a") - F.col("absent_b"))
    valued = every.withColumn("value", F.coalesce("apart", F.lit(0)) + F.coalesce(rest, F.lit(0)))
    return valued.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                            F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("p")).select("lang", "p.*", "value")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far the sources of a language are apart, and what sets each apart from it."""
    plain = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = stored(kept_terms(plain, least_docs), "terms")
    groups = stored(group_facts(plain, kept), "groups")
    rates = kept.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    rates = rates.select("lang", "source", "term", _rate(F.col("n"), F.col("total"), F.col("terms")).alias("rate"),
                         _rate(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("lang_rate"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = rates.where("rate > lang_rate").select("lang", "source", F.col("term").alias("item"), (F.col("rate") - F.col("lang_rate")).alias("value"))
    terms = above.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms)
    pairs = _pairs(rates.drop("lang_rate"), groups).withColumn("rank", F.row_number().over(by_value))
    named = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*named).unionByName(terms.withColumn("part", F.lit("term")).select(*named))


ORACLE = """
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ws from documents),
o as (select r, lang, source, unnest(ws) as term from d),
c as (select lang, source, term, count(*) as n, count(distinct r) as docs from o group by all),
k as (select lang, term, sum(n)::hugeint as n from c group by all having sum(docs) >= 30),
l as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from k group by all),
g as (select distinct lang, source from d),
t as (select g.lang, g.source, k.term, k.n as lang_n, coalesce(c.n, 0)::hugeint as n from g join k on g.lang = k.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
s as (select lang, source, sum(n)::hugeint as total from t group by all),
p as (select t.lang, t.source, t.term, t.n, (1 + (1000000000::hugeint * (t.n + 5)) // (s.total + 5 * l.v))::bigint as p,
  (1 + (1000000000::hugeint * (t.lang_n + 5)) // (l.total + 5 * l.v))::bigint as q from t join s on t.lang = s.lang and t.source = s.source join l on t.lang = l.lang),
a as (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p))::bigint as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
pairs as (select x.lang, x.source, y.source as item, coalesce(a.value, 0) as value from g x join g y on x.lang = y.lang and x.source <> y.source
  left join a on a.lang = x.lang and a.source = x.source and a.item = y.source),
terms as (select lang, source, term as item, p - q as value, row_number() over (partition by lang, source order by p - q desc, term) as rank from p where n > 0 and p > q)
select lang, source, 'pair' as part, item, value::bigint as value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
union all select lang, source, 'term', item, value::bigint, rank::int from terms where rank <= 50
"""
