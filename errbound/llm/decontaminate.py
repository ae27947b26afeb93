"""Benchmark passages in documents by latent semantic retrieval.

1. Terms are the words of the benchmark; document frequencies over all documents give their weights.
2. Benchmark texts are cut into overlapping passages; their TF-IDF matrix A gets a randomised SVD: products A'(A X) are
   summed over partitions, with X a random matrix first and the basis found so far afterwards.
3. Every document is cut into windows of two bins of 16 words; windows and passages meet by cosine in the latent space.
   Beside it every item is searched exactly: a place that holds `share` of an item can lack only so many of its words, hence
   it holds some of the item's rarest ones.  The candidates of both searches are checked.
4. A candidate counts if the longest common subsequence of words holds `share` of the item, and `answer_share` of its
   answer: the words after the last question mark, else the last quarter.  Of an item as near as `near` by cosine
   `near_share` will do: a paraphrase, which only the latent search finds.

Benchmark texts are dealt into blocks of about `block_bytes` bytes, one search of all documents a block, so what is sent
to the executors is bounded whatever the benchmark's size.

Rows: null or wordless documents and items match nothing; rows without a doc_id or item_id take no part; of a
repeated pair the best match counts; an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain, compress, repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import serve, small_batches, text_slices

BIN = 16
RANK = 128
#: Weight of a word outside the benchmark: half that of a word in one of 10,000 documents, whatever the table's size.
OUTSIDE = 0.5 * math.log(10_000)
#: Words of a smaller weight, those that more than an eighth of the documents hold, are everyday ones in a bound of the check.
EVERYDAY = math.log(8)
_WORD = re.compile(r"\w+")
HIT_SCHEMA = "doc_id long, item_id long, word_start long, matched long, item_words long, cosine double"


#: Small letter of each Latin-1 character that is part of a word, else a blank.
_SMALL = bytes(ord(chr(b).lower()) if _WORD.match(chr(b).lower()) else 32 for b in range(256))


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    try:
        return text.encode("latin-1").translate(_SMALL).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(text.lower())


def answer_length(text: str, n_words: int) -> int:
    tail = len(words_of(text.rsplit("?", 1)[1])) if "?" in text else 0
    return tail or min(n_words, max(3, -(-n_words // 4)))


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit vectors over a."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if hit := at.get(w):
            x = row & hit
            row = ((row + x) | (row - x)) & full
    return len(a) - row.bit_count()


def passages(words: list[str], step: int = 4) -> list[list[str]]:
    """Overlapping passages of two bins' length; a shorter text is one passage."""
    if len(words) <= 2 * BIN:
        return [words] if words else []
    starts = [*range(0, len(words) - 2 * BIN, step), len(words) - 2 * BIN]
    return [words[i:i + 2 * BIN] for i in starts]


def document_frequencies(docs: DataFrame, vocabulary: set[str]) -> tuple[int, dict[str, int]]:
    """Rows, and how many of them hold each term, over all documents."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        import pyarrow as pa

        serve("decontamination")
        seen, terms = Counter(), known.value
        for batch in small_batches(batches):
            for text in batch.column("text").to_pylist():
                seen.update(terms.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    n = docs.count()
    counts = docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return n, {r.term: r.n for r in counts.collect()}


def _product(rows: DataFrame, matrix) -> object:
    """A'(A X), summed over the partitions of the passages' sparse rows (ids, weights)."""
    import numpy as np

    known, slab = rows.sparkSession.sparkContext.broadcast(matrix), 512

    def run(batches):
        import pyarrow as pa

        x = known.value
        total, held = np.zeros_like(x), False
        for batch in batches:
            held = held or batch.num_rows > 0
            for ids, weights in zip(batch.column("ids").to_pylist(), batch.column("weights").to_pylist(), strict=True):
                w = np.array(weights)
                np.add.at(total, ids, w[:, None] * (w @ x[ids]))
        for a in range(0, len(total) if held else 0, slab):
            yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([total[a:a + slab].tobytes()], pa.binary())], names=["a", "m"])

    def add(group):
        import pyarrow as pa

        total = 0.0
        for part in group.column("m"):
            total = total + np.frombuffer(part.as_py())
        return pa.Table.from_arrays([pa.array([group.column("a")[0].as_py()]), pa.array([total.tobytes()], pa.binary())], names=["a", "m"])

    schema = "a long, m binary"
    found = rows.mapInArrow(run, schema).groupBy("a").applyInArrow(add, schema).collect()
    out = np.zeros_like(matrix)
    for r in found:
        part = np.frombuffer(r.m).reshape(-1, matrix.shape[1])
        out[r.a:r.a + len(part)] = part
    return out


def latent_basis(rows: DataFrame, n_terms: int, rank: int = RANK, rounds: int = 2, seed: int = 11):
    """Right singular vectors (term, rank) of the sparse rows, by randomised subspace iteration."""
    import numpy as np

    basis = np.random.default_rng(seed).standard_normal((n_terms, min(rank, n_terms)))
    for _ in range(rounds):
        basis, _ = np.linalg.qr(_product(rows, basis))
    small = basis.T @ _product(rows, basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return basis @ turn[:, values > 1e-9 * max(values.max(), 1e-30)]


class Searcher:
    """Latent passages of one block of items and the checks on candidates."""

    def __init__(self, items: list[tuple[int, str]], weights: dict[str, float], terms: dict[str, int], basis,
                 cosine: float, share: float, answer_share: float, seen: dict[str, int], near: float, near_share: float):
        import numpy as np

        # by place in the block: texts that share an item_id are items of their own
        self.item_ids, self.words = [i for i, _ in items], [words_of(t) for _, t in items]
        self.answers = [w[len(w) - answer_length(t, len(w)):] for w, (_, t) in zip(self.words, items, strict=True)]
        self.counts = [Counter(w) for w in self.words]
        self.cosine, self.share, self.answer_share, self.near, self.near_share = cosine, share, answer_share, near, near_share
        # codes: a term's number; the last (not in the table) is for words outside the benchmark
        self.n_terms, self.codes = len(terms), terms
        weight = np.array([weights[w] for w in terms])
        self.mass = np.append(weight, OUTSIDE) ** 2  # by code
        self.vectors = (basis * weight[:, None]).astype(np.float32)
        owner, rows = [], []
        for i, w in enumerate(self.words):
            for p in passages(w):
                ids = [terms[x] for x in p if x in terms]
                if ids:
                    rows.append(self.vectors[ids].sum(axis=0))
                    owner.append(i)
        self.holds, self.rare = (np.zeros((len(self.words), len(terms) + 1), bool) for _ in range(2))  # item, code: any word, words that are not everyday
        self.everyday = np.zeros(len(self.words), np.int64)
        for i, w in enumerate(self.words):
            self.holds[i, [terms[x] for x in w]] = True
            self.rare[i, [terms[x] for x in w if weights[x] >= EVERYDAY]] = True
            self.everyday[i] = sum(weights[x] < EVERYDAY for x in w)
        # how often an item has a word, by item and code
        wanted = np.array(sorted((i * (len(terms) + 1) + terms[w], n) for i, c in enumerate(self.counts) for w, n in c.items()), np.int64).reshape(-1, 2)
        self.wanted, self.wanted_n = wanted[:, 0], wanted[:, 1]
        self.owner, self.passages = np.array(owner, np.int64), self._unit(np.array(rows, np.float32).reshape(len(rows), self.vectors.shape[1]))
        self._list_rare(seen)

    def _list_rare(self, seen: dict[str, int]) -> None:
        """Postings by code: the items of which a word is among the rarest, and how often it stands in the item.

        A match may lack `spare` of the item's words; of any set of them it holds all but `spare`.
        """
        import numpy as np

        self.least, self.span, posted = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.int64), []
        for i, words in enumerate(self.words):
            n = len(words)
            held = max(1, math.ceil(self.share * n))
            self.span[i] = 2 * BIN + 2 * n
            if held > n:
                continue
            spare, total = n - held, 0
            for w, c in sorted(self.counts[i].items(), key=lambda x: (seen.get(x[0], 0), x[0])):
                if total >= spare + -(-held // 4):
                    break
                posted.append((self.codes[w], i, c))
                total += c
            self.least[i] = total - spare
        posted = np.array(sorted(posted), np.int64).reshape(-1, 3)
        self.degree = np.bincount(posted[:, 0], minlength=len(self.codes) + 1)
        self.post_at, self.post_item, self.post_n = np.cumsum(self.degree) - self.degree, posted[:, 1], posted[:, 2]

    @staticmethod
    def _unit(rows):
        import numpy as np

        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    def _ids(self, split: list[list[str]], sizes):
        import numpy as np

        return np.fromiter(map(self.codes.get, chain.from_iterable(split), repeat(len(self.codes))), np.int64, int(sizes.sum()))

    def candidates(self, split: list[list[str]], ids):
        """Texts, windows' first bins, items and cosines of the pairs above the threshold, each once.

        The cosine is that of the latent vectors times the share of the window's length that its terms make up; words
        outside the benchmark count with the weight OUTSIDE.  A window below the threshold by that
        share alone needs no vector.
        """
        import numpy as np

        sizes = np.array([len(x) for x in split], np.int64)
        ends = np.cumsum(sizes)
        none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        if not len(ids) or not len(self.passages):
            return none
        bins = -(-sizes // BIN) + 1  # the last one stays empty, so no window spans two texts
        first = np.cumsum(bins) - bins
        place = np.repeat(first, sizes) + (np.arange(len(ids)) - np.repeat(ends - sizes, sizes)) // BIN
        total, mass = int(bins.sum()) + 1, self.mass[ids]
        every, own = np.bincount(place, mass, total), np.bincount(place, np.where(ids < self.n_terms, mass, 0.0), total)
        covered = np.sqrt((own[:-1] + own[1:]) / np.maximum(every[:-1] + every[1:], 1e-12))
        asked = np.flatnonzero(covered >= self.cosine)
        if not len(asked):
            return none
        needed = np.zeros(total, bool)
        needed[asked] = needed[asked + 1] = True
        used = np.flatnonzero((ids < self.n_terms) & needed[place])
        heads = np.flatnonzero(np.diff(place[used], prepend=-1))
        slot = np.full(total, len(heads))
        # a bin's words are added one place after the other, for all bins that have so many, the fullest bins first
        many = np.diff(np.append(heads, len(used)))
        order = np.argsort(-many, kind="stable")
        many, begin, codes = many[order], heads[order], ids[used]
        slot[place[used[begin]]] = np.arange(len(begin))
        sums = np.zeros((len(heads) + 1, self.vectors.shape[1]), np.float32)
        for a in range(0, len(heads), 4096):
            for k in range(int(many[a])):
                b = min(a + 4096, int(np.searchsorted(-many, -k)))
                sums[a:b] += self.vectors[codes[begin[a:b] + k]]
        owner, parts = np.repeat(np.arange(len(split)), bins), []
        for a in range(0, len(asked), 8192):
            at = asked[a:a + 8192]
            near = self._unit(sums[slot[at]] + sums[slot[at + 1]]) @ self.passages.T
            some = np.flatnonzero(near.max(axis=1) * covered[at] >= self.cosine)
            if not len(some):
                continue
            at = at[some]
            near = near[some] * covered[at, None]
            r, c = np.nonzero(near >= self.cosine)
            item = self.owner[c]
            heads = np.flatnonzero((np.diff(r, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0))  # an item's best passage
            text = owner[at[r[heads]]]
            parts.append((text, at[r[heads]] - first[text], item[heads], np.maximum.reduceat(near[r, c], heads).astype(float)))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else none

    def roomy(self, split: list[list[str]], ids, text, at, item, cosine):
        """Whether the windows' surroundings have as many of the items' words as a match needs: each time they occur, or
        the rare ones each time they occur and the everyday ones as often as the item has them."""
        import numpy as np

        sizes = np.array([len(x) for x in split], np.int64)
        first = np.cumsum(sizes) - sizes
        n = np.array([len(w) for w in self.words])[item]
        places = np.flatnonzero(ids < self.n_terms)
        low = np.searchsorted(places, first[text] + np.maximum(0, at * BIN - n))
        high = np.searchsorted(places, first[text] + np.minimum(sizes[text], (at + 2) * BIN + n))
        needed = np.where(cosine >= self.near, min(self.near_share, self.share), self.share) * n
        codes, width, fine = ids[places], self.n_terms + 1, []
        for a, b in self._loads(high - low):
            size, i = (high - low)[a:b], item[a:b]
            ends = np.cumsum(size)
            at_item = np.repeat(i * width, size) + codes[np.arange(int(size.sum())) + np.repeat(low[a:b] - ends + size, size)]
            held = size
            for table, more in ((self.holds, 0), (self.rare, self.everyday[i])):
                upto = np.append(0, np.cumsum(table.ravel()[at_item]))
                held = np.minimum(held, upto[ends] - upto[ends - size] + more)
            fine.append(held >= needed[a:b] - 1e-9)
        return np.concatenate(fine) if fine else np.zeros(0, bool)

    @staticmethod
    def _loads(sizes, most: int = 1_000_000):
        """Ranges of regions of together about so many words, at least one."""
        import numpy as np

        load, a = np.cumsum(sizes), 0
        while a < len(load):
            b = max(a + 1, int(np.searchsorted(load, (load[a - 1] if a else 0) + most, "right")))
            yield a, b
            a = b

    def may_hold_all(self, split: list[list[str]], ids, text, at, item, cosine):
        """may_hold of many windows' surroundings at once."""
        import numpy as np

        sizes = np.array([len(x) for x in split], np.int64)
        first = np.cumsum(sizes) - sizes
        n, width, fine = np.array([len(w) for w in self.words])[item], self.n_terms + 1, []
        low = first[text] + np.maximum(0, at * BIN - n)
        high = np.maximum(low, first[text] + np.minimum(sizes[text], (at + 2) * BIN + n))
        needed = np.where(cosine >= self.near, self.near_share, self.share) * n
        for a, b in self._loads(high - low):
            size = (high - low)[a:b]
            ends, region = np.cumsum(size), np.repeat(np.arange(b - a), size)
            codes = ids[np.arange(len(region)) + np.repeat(low[a:b] - ends + size, size)]
            own = self.holds[item[a:b][region], codes]
            key, count = np.unique(region[own] * width + codes[own], return_counts=True)
            region, wanted = key // width, item[a:b][key // width] * width + key % width
            most = self.wanted_n[np.searchsorted(self.wanted, wanted)]
            fine.append(np.bincount(region, np.minimum(count, most), b - a) >= needed[a:b])
        return np.concatenate(fine) if fine else np.zeros(0, bool)

    def exact(self, split: list[list[str]], ids):
        """(text, window's first bin, item) of all windows whose surroundings may hold `share` of the item's words.

        An item's cells are two spans long and start a span apart, so that one of them holds all of a window's surroundings.
        """
        import numpy as np

        sizes = np.array([len(x) for x in split], np.int64)
        first = np.cumsum(sizes) - sizes
        rare = np.flatnonzero(self.degree[ids])
        text = np.searchsorted(first, rare, "right") - 1
        load = np.cumsum(self.degree[ids[rare]])
        a = 0
        while a < len(rare):
            # whole texts of together about a million postings, at least one
            b = int(np.searchsorted(load, (load[a - 1] if a else 0) + 1_000_000))
            b = max(int(np.searchsorted(text, text[b])), int(np.searchsorted(text, text[a], "right"))) if b < len(rare) else len(rare)
            at, many = rare[a:b], self.degree[ids[rare[a:b]]]
            row = np.repeat(np.arange(b - a), many)
            post = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + self.post_at[ids[at]][row]
            item, d = self.post_item[post], text[a:b][row]
            cell = (at[row] - first[d]) // self.span[item] + 1  # and the one before it
            width = int(cell.max()) + 1
            key = (d * len(self.words) + item) * width + cell
            # a word counts once in a cell, as often as the item has it
            key, code, n = (np.concatenate([x, y]) for x, y in ((key, key - 1), (ids[at][row],) * 2, (self.post_n[post],) * 2))
            order = np.lexsort((code, key))
            key, code, n = key[order], code[order], n[order]
            new = np.diff(key, prepend=-1) > 0
            heads = np.flatnonzero(new)
            held = np.add.reduceat(np.where(new | (np.diff(code, prepend=-1) != 0), n, 0), heads)
            key = key[heads]
            item = key // width % len(self.words)
            for x in np.flatnonzero(held >= self.least[item]):
                i, d, c = int(item[x]), int(key[x] // width // len(self.words)), int(key[x] % width) - 1
                span = int(self.span[i])
                size, words = len(self.words[i]), split[d]
                if self.may_hold(words[max(0, c * span):(c + 2) * span], i, self.share):
                    for w in range(max(0, -(-(c * span + size) // BIN)), -(-min((c + 1) * span + size, len(words)) // BIN)):
                        yield d, w, i
            a = b

    def score(self, words: list[str], at: int, item: int) -> float:
        """The cosine of a window and an item, as in candidates."""
        import numpy as np

        ids = self._ids([words[at * BIN:(at + 2) * BIN]], np.array([len(words[at * BIN:(at + 2) * BIN])]))
        known, mine = ids[ids < self.n_terms], self.passages[self.owner == item]
        if not len(known) or not len(mine):
            return 0.0
        near = float((mine @ self._unit(self.vectors[known].sum(axis=0)[None])[0]).max())
        return near * math.sqrt(self.mass[known].sum() / max(self.mass[ids].sum(), 1e-12))

    def may_hold(self, region: list[str], item: int, share: float) -> bool:
        """Whether a region has enough of an item's words, in whatever order."""
        here = Counter(region)
        return sum(min(n, here[w]) for w, n in self.counts[item].items()) >= share * len(self.words[item])

    def matches(self, words: list[str], at: int, item: int, cosine: float) -> int | None:
        """Words of an item that a window and its surroundings hold in order, or None if they are too few."""
        wanted, answer = self.words[item], self.answers[item]
        share = self.near_share if cosine >= self.near else self.share
        region = words[max(0, at * BIN - len(wanted)):(at + 2) * BIN + len(wanted)]
        if not self.may_hold(region, item, share):
            return None
        n = common_length(wanted, region)
        if n < share * len(wanted) or common_length(answer, region) < self.answer_share * len(answer):
            return None
        return n

    def search(self, keys: list, texts: list):
        import numpy as np

        split = [words_of(t) for t in texts]
        ids = self._ids(split, np.array([len(x) for x in split], np.int64))
        cosines: dict[tuple, float] = {}
        near = self.candidates(split, ids)
        fine = self.roomy(split, ids, *near)
        for d, at, item, cosine in zip(*(x[fine].tolist() for x in near), strict=True):
            cosines[d, at, item] = cosine
        for d, at, item in self.exact(split, ids):
            cosines.setdefault((d, at, item), -1.0)
        best: dict[tuple, tuple] = {}
        found = np.array(list(cosines), np.int64).reshape(-1, 3).T
        held = self.may_hold_all(split, ids, *found, np.fromiter(cosines.values(), float, len(cosines)))
        for (d, at, item), cosine in compress(cosines.items(), held):
            n = self.matches(split[d], at, item, cosine)
            if n is not None and cosine < 0:
                cosine = self.score(split[d], at, item)
            if n is not None and (n, cosine) > best.get((d, item), (0, 0.0, 0))[:2]:
                best[d, item] = (n, cosine, at * BIN)
        return [(keys[d], self.item_ids[i], at, n, len(self.words[i]), c) for (d, i), (n, c, at) in best.items()]


def _block_matches(docs: DataFrame, bench: DataFrame, cosine: float, share: float, answer_share: float, near: float, near_share: float) -> DataFrame | None:
    import numpy as np

    spark = docs.sparkSession
    items = [(r.item_id, r.text) for r in bench.collect()]  # bounded by block_bytes
    vocabulary = {w for _, t in items for w in words_of(t)}
    if not vocabulary:
        return None
    n, seen = document_frequencies(docs, vocabulary)
    weights = {w: max(math.log((n + 1) / (seen.get(w, 0) + 1)), 1e-3) for w in sorted(vocabulary)}
    terms = {w: i for i, w in enumerate(weights)}
    known = spark.sparkContext.broadcast((weights, terms))

    def rows(batches):
        import pyarrow as pa

        weight, at = known.value
        for batch in batches:
            ids, values = [], []
            for text in batch.column("text").to_pylist():
                for p in passages(words_of(text)):
                    counts: dict[int, float] = {}
                    for w in p:
                        if w in at:
                            counts[at[w]] = counts.get(at[w], 0.0) + weight[w]
                    size = math.sqrt(sum(x * x for x in counts.values())) or 1.0
                    ids.append(list(counts))
                    values.append([x / size for x in counts.values()])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float64()))], names=["ids", "weights"])

    matrix = bench.select("text").mapInArrow(rows, "ids array<long>, weights array<double>").where(F.size("ids") > 0)
    basis = latent_basis(matrix, len(terms))
    searcher = spark.sparkContext.broadcast(Searcher(items, weights, terms, basis, cosine, share, answer_share, seen, near, near_share))

    def search(batches):
        import pyarrow as pa

        serve("decontamination")
        for batch in small_batches(batches, 1024):
            keys, texts = batch.column("doc_id").to_pylist(), [x or "" for x in batch.column("text").to_pylist()]
            for a, b in text_slices(texts, 1_000_000):
                found = searcher.value.search(keys[a:b], texts[a:b])
                columns = list(zip(*found, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.float64()], strict=True)],
                                                names=["doc_id", "item_id", "word_start", "matched", "item_words", "cosine"])

    return docs.mapInArrow(search, HIT_SCHEMA)


def benchmark_matches(docs: DataFrame, bench: DataFrame, cosine: float = 0.3, share: float = 0.6, answer_share: float = 0.5,
                      near: float = 0.45, near_share: float = 0.45, block_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, item_id, word_start, matched, item_words, cosine: one row for each document and item that it holds."""
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = bench.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-total // block_bytes)
    out = docs.sparkSession.createDataFrame([], HIT_SCHEMA)
    for b in range(n_blocks):
        found = _block_matches(texts, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b), cosine, share, answer_share, near, near_share)
        out = out if found is None else found if n_blocks == 1 else out.unionByName(found)
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("matched"), F.desc("cosine"), "word_start")
    return out.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def without_benchmark(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item, whole rows."""
    held = benchmark_matches(docs, bench, **options).select("doc_id").distinct()
    return docs.join(held, "doc_id", "left_anti").select(*docs.columns)
