"""Cross-tokenizer alignment by lockstep merging.

Tokenizer A (byte-level BPE) and tokenizer B (pieces) cut the same bytes.  Lanes of a few hundred bytes of all documents of a slice
advance together: one NumPy state holds each lane's pointers into the two lists of token ends, and a step links the two tokens it
stands at, advances the pointer of the smaller end, or both where the ends meet, which is a cut; lanes that reach
their end are compacted away.  A step depends on nothing but the two ends it stands at, so a lane may begin anywhere: the
steps of a document's lanes are together those of one run through it.  Tokens between two cuts are a group; where a group has
several tokens on both sides, its pairs that do not overlap are linked as well.

A slice stores its documents' links as numbers of its own list of id pairs.  Only that list is shuffled, once to count the
documents of each pair and once to bring the counts back to the slice.

Rows: null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens; every row gives a
row, repeated rows and null doc_ids too, and counts as a document; ties for the highest count are all best; an empty table
gives an empty result; other columns are ignored.  A text is aligned whole, so a task's memory follows its longest text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

SLICE_BYTES, LANE_BYTES = 4_000_000, 512
MEMO_CHARS = 6_000_000
#: Groups with more pairs than this are counted by distinct ids.
WIDE = 4096
SHARD_SCHEMA = ("shard string, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, "
                "n_pairs array<long>, links binary, weights binary, codes array<long>, docs array<long>")
ROW_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: Texts are cut where a space follows another character than white space: no token of either tokenizer spans that.
_CHUNK = re.compile(r"\s*+\S++(?:[^\S ]\s*+(?:\S++|\Z))*+(?:\s++\Z)?|\s+")
#: Controls that Python counts as white space and the tokenizers' patterns do not.
_ODD = re.compile("[\x1c-\x1f]")


def _byte_of_char() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies write: printable ones as they are, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Bytes of each id's token, as one flat array with starts and lengths."""

    def __init__(self, tokens: list[bytes]):
        import numpy as np

        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids):
        import numpy as np

        n = self.length[ids]
        upto = np.cumsum(n)
        return self.flat[np.arange(int(upto[-1]) if len(ids) else 0) + np.repeat(self.start[ids] - (upto - n), n)]


class Pair:
    """Both tokenizers with a memo of recurring chunks."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        entries = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"]}
        to_byte, tokens = _byte_of_char(), [b""] * (max(entries.values()) + 1)
        for word, i in entries.items():
            tokens[i] = bytes(map(to_byte.__getitem__, word))
        self.vocabulary_a = Vocabulary(tokens)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.vocabulary_b = Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        before = spec.get("pre_tokenizer") or {}
        self.splits = (before.get("type") == "ByteLevel" and before.get("use_regex") and not spec.get("normalizer")
                       and not any(re.search("[^▁]▁", p) for p in pieces))
        self._forget()

    def _forget(self):
        import numpy as np

        self.number: dict[str, int] = {}
        self.held, self.odd = 0, set()
        self.ids = [np.zeros(0, np.int32)] * 2
        self.starts, self.sizes = [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2

    def _learn(self, chunks: list[str]) -> None:
        """Number new chunks and keep their ids; those that a tokenizer does not give back are marked."""
        import numpy as np

        self.held += sum(map(len, chunks))
        for at in range(0, len(chunks), 4000):
            some = chunks[at:at + 4000]
            self.number.update(zip(some, range(len(self.number), len(self.number) + len(some)), strict=True))
            found = [x.ids for x in self.a.encode_batch_fast(some, add_special_tokens=False)], self.b.encode([c[1:] for c in some], num_threads=1)
            for k, (rows, vocabulary) in enumerate(zip(found, (self.vocabulary_a, self.vocabulary_b), strict=True)):  # B adds the first space itself
                sizes = np.array(list(map(len, rows)), np.int64)
                ids = np.fromiter(chain.from_iterable(rows), np.int32, int(sizes.sum()))
                self.starts[k] = np.append(self.starts[k], len(self.ids[k]) + np.cumsum(sizes) - sizes)
                self.sizes[k], self.ids[k] = np.append(self.sizes[k], sizes), np.append(self.ids[k], ids)
                ends = np.append(0, np.cumsum(vocabulary.length[ids]))[np.append(0, np.cumsum(sizes))]
                flat = vocabulary.joined(ids).tobytes()
                self.odd.update(c for c, i, j in zip(some, ends[:-1], ends[1:], strict=True) if flat[i:j] != c.encode())

    def encode(self, texts: list[str]):
        """Ids of ' ' + text by both and the number of ids of each text: [ids_a, n_a, ids_b, n_b], then the texts with a marked chunk."""
        import numpy as np

        cut = [_CHUNK.findall(t) if self.splits and not _ODD.search(t) else [t] for t in (" " + t for t in texts)]
        used = set().union(*cut)
        new = list(used.difference(self.number))
        if self.held + sum(map(len, new)) > MEMO_CHARS:
            self._forget()
            new = list(used)
        self._learn(new)
        parts = np.array(list(map(len, cut)), np.int64)
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64, int(parts.sum()))
        ends, out = np.cumsum(parts), []
        for ids, starts, sizes in zip(self.ids, self.starts, self.sizes, strict=True):
            n = sizes[at]
            upto = np.cumsum(n)
            out.append(ids[np.arange(int(upto[-1]) if len(at) else 0) + np.repeat(starts[at] - (upto - n), n)])
            out.append(np.diff(np.append(0, np.append(0, upto)[ends])))
        return [*out, [i for i, p in enumerate(cut) if self.odd and not self.odd.isdisjoint(p)]]


@lru_cache(maxsize=1)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def lockstep(ends_a, ends_b, bounds, lane: int = LANE_BYTES):
    """Merge the token ends of all documents at once: links (a, b) between overlapping tokens, and the cuts (a, b) where both end.

    `ends_*` are ascending byte places through all documents, `bounds` the documents' starts and the end of the last.
    """
    import numpy as np

    size = np.diff(bounds)
    lanes = -(-size // lane)
    begin = np.repeat(bounds[:-1], lanes) + lane * (np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    stop = np.minimum(begin + lane, np.repeat(bounds[1:], lanes))
    never = np.iinfo(np.int64).max
    at_a, at_b = np.append(ends_a, never), np.append(ends_b, never)
    a, b = np.searchsorted(ends_a, begin, "right"), np.searchsorted(ends_b, begin, "right")
    links, cuts = [], []
    while len(a):
        to_a, to_b = at_a[a], at_b[b]
        live = np.minimum(to_a, to_b) <= stop
        if not live.all():  # compact: lanes that are through leave the state
            a, b, stop, to_a, to_b = a[live], b[live], stop[live], to_a[live], to_b[live]
        links.append((a.astype(np.int32), b.astype(np.int32)))
        meet = to_a == to_b
        cuts.append((a[meet], b[meet]))
        a, b = a + (to_a <= to_b), b + (to_b <= to_a)
    joined = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (*zip(*links, strict=True), *zip(*cuts, strict=True))] if links else [np.zeros(0, np.int64)] * 4
    return joined[0], joined[1], np.sort(joined[2]), np.sort(joined[3])


@lru_cache(maxsize=1)
def _digits(size_a: int, size_b: int):
    """Text of each id with the mark that follows it, in eight bytes: A ids with a comma or bar, then B ids with a comma or semicolon."""
    import numpy as np

    marked = [f"{i}{m}" for size, marks in ((size_a, ",|"), (size_b, ",;")) for i in range(size) for m in marks]
    return np.array(marked, "S8").view("<u8"), np.array([len(x) for x in marked], np.int64)


def _wide_pairs(ids_a, ids_b, base: int):
    import numpy as np

    (a, n_a), (b, n_b) = np.unique(ids_a, return_counts=True), np.unique(ids_b, return_counts=True)
    return (a[:, None] * base + b[None]).ravel(), (n_a[:, None] * n_b[None]).ravel()


def align(ids_a, ids_b, lengths_a, lengths_b, bounds, n_a, n_b, size_a: int, size_b: int, lane: int = LANE_BYTES, wide: int = WIDE):
    """Counts, group texts and distinct linked id pairs of documents whose tokens cover the same bytes.

    Returns groups and links by document, the groups' texts, and (document, code, weight) of the pairs in that order; a code is
    a * size_b + b, its weight the number of linked occurrences.
    """
    import numpy as np

    count = len(bounds) - 1
    link_a, link_b, cut_a, cut_b = lockstep(np.cumsum(lengths_a), np.cumsum(lengths_b), bounds, lane)
    wide_a, wide_b = np.diff(np.append(-1, cut_a)), np.diff(np.append(-1, cut_b))
    group_a, group_b = np.repeat(np.arange(len(cut_a)), wide_a), np.repeat(np.arange(len(cut_b)), wide_b)
    doc_a = np.repeat(np.arange(count), n_a)
    doc_of_group = doc_a[cut_a]
    groups = np.bincount(doc_of_group, minlength=count)
    links = np.zeros(count, np.int64)
    np.add.at(links, doc_of_group, wide_a * wide_b)
    # text of the groups
    seq = np.empty(len(ids_a) + len(ids_b), np.int64)
    last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    last_a[cut_a], last_b[cut_b] = 1, 1
    seq[np.arange(len(ids_a)) + (np.cumsum(wide_b) - wide_b)[group_a]] = 2 * ids_a.astype(np.int64) + last_a
    seq[np.arange(len(ids_b)) + np.cumsum(wide_a)[group_b]] = 2 * (size_a + ids_b.astype(np.int64)) + last_b
    table, width = _digits(size_a, size_b)
    flat = table[seq].view(np.uint8)
    flat = flat[flat != 0]
    upto = np.append(0, np.cumsum(width[seq]))[np.append(0, np.cumsum(n_a + n_b))]
    # distinct pairs by document
    full = (wide_a > 1) & (wide_b > 1)
    base = size_a * size_b
    plain = ~full[group_a[link_a]]
    one_a, one_b = link_a[plain], link_b[plain]
    keys = [doc_a[one_a] * base + ids_a[one_a].astype(np.int64) * size_b + ids_b[one_b]]
    heavy_key, heavy_weight = [], []
    some = np.flatnonzero(full & (wide_a * wide_b <= wide))
    if len(some):
        pairs = (wide_a * wide_b)[some]
        k = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        across = np.repeat(wide_b[some], pairs)
        a = np.repeat((cut_a - wide_a + 1)[some], pairs) + k // across
        b = np.repeat((cut_b - wide_b + 1)[some], pairs) + k % across
        keys.append(doc_a[a] * base + ids_a[a].astype(np.int64) * size_b + ids_b[b])
    for g in np.flatnonzero(full & (wide_a * wide_b > wide)):
        code, weight = _wide_pairs(ids_a[cut_a[g] - wide_a[g] + 1:cut_a[g] + 1].astype(np.int64), ids_b[cut_b[g] - wide_b[g] + 1:cut_b[g] + 1].astype(np.int64), size_b)
        heavy_key.append(doc_of_group[g] * base + code)
        heavy_weight.append(weight)
    key = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    weight, key = np.diff(np.append(first, len(key))), key[first]
    if heavy_key:
        key, weight = np.concatenate([key, *heavy_key]), np.concatenate([weight, *heavy_weight])
        key, inverse = np.unique(key, return_inverse=True)
        weight, held = np.zeros(len(key), np.int64), weight
        np.add.at(weight, inverse, held)
    return groups, links, flat, upto, key // base, key % base, weight


def _planes(values) -> bytes:
    """32-bit integers by byte planes, compressed."""
    import numpy as np
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _from_planes(data: bytes):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def aligned_slice(texts: list, path_a: str, path_b: str, lane: int = LANE_BYTES, wide: int = WIDE):
    """n_a, n_b, n_groups, n_links, sha256 and the distinct pairs (document, code, weight) of the texts of a slice."""
    import numpy as np

    both = pair(path_a, path_b)
    one, two = both.vocabulary_a, both.vocabulary_b
    count = len(texts)
    ids_a, n_a, ids_b, n_b, marked = both.encode([x or "" for x in texts])
    size = np.array([len((x or "").encode()) + 1 for x in texts], np.int64)
    doc_a, doc_b = np.repeat(np.arange(count), n_a), np.repeat(np.arange(count), n_b)
    fine = np.array([bool(x) for x in texts], bool)
    for i in marked:
        whole = b" " + (texts[i] or "").encode()
        fine[i] &= all(v.joined(ids[doc == i]).tobytes() == whole for v, ids, doc in ((one, ids_a, doc_a), (two, ids_b, doc_b)))
    keep_a, keep_b = fine[doc_a], fine[doc_b]
    ids_a, ids_b = ids_a[keep_a], ids_b[keep_b]
    n_a, n_b = np.where(fine, n_a, 0), np.where(fine, n_b, 0)
    bounds = np.append(0, np.cumsum(size[fine]))
    groups, links, flat, upto, doc, code, weight = align(ids_a, ids_b, one.length[ids_a], two.length[ids_b], bounds, n_a[fine], n_b[fine],
                                                              len(one.length), len(two.length), lane, wide)
    where = np.flatnonzero(fine)
    sha = [""] * count
    for i, k in enumerate(where):
        sha[k] = hashlib.sha256(flat[upto[i]:upto[i + 1] - 1]).hexdigest()
    n_groups, n_links = np.zeros(count, np.int64), np.zeros(count, np.int64)
    n_groups[where], n_links[where] = groups, links
    return n_a, n_b, n_groups, n_links, sha, where[doc], code, weight


def _shards(path_a: str, path_b: str, slice_bytes: int, lane: int, wide: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("shard", pa.string()), *((c, pa.list_(pa.int64())) for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")), ("sha", pa.list_(pa.string())),
                            ("n_pairs", pa.list_(pa.int64())), ("links", pa.binary()), ("weights", pa.binary()), ("codes", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])

        def row(keys, texts):
            n_a, n_b, n_groups, n_links, sha, doc, code, weight = aligned_slice(texts, path_a, path_b, lane, wide)
            codes, number = np.unique(code, return_inverse=True)
            columns = [[uuid.uuid4().hex], [keys], [n_a], [n_b], [n_groups], [n_links], [sha], [np.bincount(doc, minlength=len(texts))],
                       [_planes(np.diff(number, prepend=0))], [_planes(weight)], [codes], [np.bincount(number, minlength=len(codes))]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        keys, texts, held = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                if texts and held + len(text or "") > slice_bytes:
                    yield row(keys, texts)
                    keys, texts, held = [], [], 0
                keys.append(key)
                texts.append(text)
                held += len(text or "")
        if texts:
            yield row(keys, texts)
    return run


def _counted(facts, shards):
    """Rows of a slice's documents from its stored links and the counts of its pairs."""
    import numpy as np
    import pyarrow as pa

    out = []
    for shard in shards.to_pylist():
        count, best = np.zeros(len(shard["codes"]), np.int64), np.zeros(len(shard["codes"]), bool)
        at = facts.column("i").to_numpy()
        count[at], best[at] = facts.column("count").to_numpy(), facts.column("best").to_numpy(zero_copy_only=False)
        number, weight = np.cumsum(_from_planes(shard["links"])), _from_planes(shard["weights"]).astype(np.int64)
        ends = np.append(0, np.cumsum(np.array(shard["n_pairs"], np.int64)))
        sums = [np.diff(np.append(0, np.cumsum(x))[ends]) for x in (np.where(best[number], weight, 0), weight * count[number])]
        out.append(pa.table({"doc_id": pa.array(shard["doc_ids"], pa.int64()), **{c: pa.array(shard[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")},
                             "n_best": pa.array(sums[0], pa.int64()), "count_sum": pa.array(sums[1], pa.int64()), "groups_sha256": pa.array(shard["sha"], pa.string())}))
    return pa.concat_tables(out)


def pair_counts(shards: DataFrame, size_b: int) -> DataFrame:
    """code, count and best of every linked id pair: the documents that hold it, and whether no pair of its A id has more."""
    counts = (shards.select(F.explode(F.arrays_zip("codes", "docs")).alias("p")).groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.docs").alias("count")))
    same = Window.partitionBy(F.floor(F.col("code") / size_b))
    return counts.withColumn("best", F.col("count") == F.max("count").over(same))


def alignments(docs: DataFrame, path_a: str, path_b: str, slice_bytes: int = SLICE_BYTES, lane: int = LANE_BYTES, wide: int = WIDE) -> DataFrame:
    """One row per document: tokens, groups and links of the two tokenizers, and how common its links are in all documents."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = stored(texts.mapInArrow(_shards(path_a, path_b, slice_bytes, lane, wide), SHARD_SCHEMA), "alignments")
    size_b = len(pair(path_a, path_b).vocabulary_b.length)
    listed = shards.select("shard", F.posexplode("codes").alias("i", "code"))
    facts = listed.join(pair_counts(shards, size_b), "code").select("shard", "i", "count", "best")
    whole = shards.select(*(F.col(c).alias(c) for c in shards.columns))
    return facts.groupBy("shard").cogroup(whole.groupBy("shard")).applyInArrow(_counted, ROW_SCHEMA)
