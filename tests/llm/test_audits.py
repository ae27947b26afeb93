"""The source audit and the cross-tokenizer alignment on small fixtures, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from errbound.llm import alignment, divergence
from errbound.llm.encoders import public_path

BYTE, PIECE = public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")
#: Extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, shard string, code long, rate int, block int, docs array<long>"
RNG = random.Random(11)
WORDS = ["the", "The", "of", "straße", "élan", "ÉLAN", "antidisestablishmentarianism", "antidisestablishmentarianismo", "x", "a\x00b", "don't", "数据", "abcdefgh", "abcdefghi"]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "t", 5, "s", 7, 1, 2, [1]) for r in rows], SCHEMA)


def audit_rows():
    rows = [(i, " ".join(RNG.choices(WORDS, k=RNG.randrange(0, 40))) + RNG.choice(["", ".", " 9"]), RNG.choice(["en", "fr", None]), RNG.choice(["s1", "s2", "s3", "é", None]))
            for i in range(120)]
    return rows + [(500, None, "en", "s1"), (501, "", "de", "only"), (502, "12 34", "de", "other"), (None, "the of", "en", "s1"), (3, "the", "en", "s2"), (3, "the", "en", "s2")]


def brute_audit(rows, least, top):
    terms = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    out = []
    for lang in {r[0] for r in terms}:
        mine = [r for r in terms if r[0] == lang]
        held = Counter(w for _, _, ws in mine for w in set(ws))
        kept = sorted(w for w, n in held.items() if n >= least)
        counts = defaultdict(Counter)
        for _, source, ws in mine:
            counts[source].update(w for w in ws if w in set(kept))
        rate = {s: {w: 1 + 10**9 * (counts[s][w] + 5) // (sum(counts[s].values()) + 5 * len(kept)) for w in kept} for _, s, _ in mine}
        total = sum(counts.values(), Counter())
        q = {w: 1 + 10**9 * (total[w] + 5) // (sum(total.values()) + 5 * len(kept)) for w in kept}
        for s in rate:
            pairs = sorted((-sum(abs(rate[s][w] - rate[o][w]) for w in kept), o.encode()) for o in rate if o != s)
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)]
            above = sorted((q[w] - rate[s][w], w.encode()) for w in kept if counts[s][w] and rate[s][w] > q[w])[:top]
            out += [(lang, s, "term", w.decode(), -v, k) for k, (v, w) in enumerate(above, 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "limit", "blocks"), [(5, 50, 12_000_000, 128), (1, 3, 60, 2), (10_000, 50, 200, 1)])
def test_divergence(spark, monkeypatch, least, top, limit, blocks):
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", blocks)
    monkeypatch.setattr(divergence, "TERM_SLICE", 8192 if blocks > 2 else 3)
    monkeypatch.setattr(divergence, "term_counts", lambda f=divergence.term_counts: f(limit))
    rows = audit_rows()
    got = divergence.divergence(docs(spark, rows), least, top)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == brute_audit(rows, least, top)
    assert divergence.divergence(docs(spark, []), least, top).count() == 0


def test_rates_are_exact_at_any_count(spark):
    n, total, terms = 9_123_456_789_012_345, 91_234_567_890_123_456, 12_345_678
    got = spark.range(1).select(divergence._rate(F.lit(n), F.lit(total), F.lit(terms))).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def test_pointer_sort():
    words = ["".join(RNG.choices("ab", k=RNG.randrange(1, 40))) for _ in range(500)] + ["a" * k for k in range(1, 30)] * 2
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends = divergence.word_bounds(data, np.array([0, len(data)]))
    order, run = divergence.pointer_sort(data, starts, ends)
    assert [words[i] for i in order] == sorted(words)
    assert [sorted(set(words))[k] for k in run] == sorted(words)


def brute_alignment(text):
    """ids of A, ids of B and groups of ids, by sets of token ends; None where a tokenizer changes the bytes."""
    both = alignment.pair(BYTE, PIECE)
    if not text:
        return None
    ids = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    ends = []
    for mine, v in zip(ids, (both.vocabulary_a, both.vocabulary_b), strict=True):
        tokens = [v.flat[v.start[i]:v.start[i] + v.length[i]].tobytes() for i in mine]
        if b"".join(tokens) != (" " + text).encode():
            return None
        ends.append(np.cumsum([len(t) for t in tokens]).tolist())
    groups, low = [], 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        groups.append([[i for i, e in zip(mine, at, strict=True) if low < e <= cut] for mine, at in zip(ids, ends, strict=True)])
        low = cut
    return *ids, groups


def alignment_rows():
    rows = ["".join(RNG.choices("ab 's\n\r\t<|endoftext|>é世\U0001f600▁\x00\x1c\xa0  ", k=RNG.randrange(1, 90))) for _ in range(120)]
    rows += [" ".join(RNG.choices(["the", "quotation", "mentarianism", "élève", "123", "aaaaaaaaaaaaaaaaaaaaaaaaa"], k=RNG.randrange(1, 300))) for _ in range(40)]
    rows += [None, "", " ", "  ", "a", "▁", "<|endoftext|>", "</s>", "x" * 3000, "x y " * 900, "same text", "same text"]
    return [(i, t, "en", "s") for i, t in enumerate(rows)] + [(None, "same text", "en", "s"), (0, "again", "en", "s")]


@pytest.mark.parametrize(("lane", "wide", "size"), [(512, 4096, 4_000_000), (3, 1, 500)])
def test_alignment(spark, lane, wide, size):
    rows = alignment_rows()
    found = [brute_alignment(r[1]) for r in rows]
    links = [Counter((p, q) for x, y in f[2] for p in x for q in y) if f else Counter() for f in found]
    held = Counter(p for one in links for p in one)
    best = defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    want = []
    for (i, *_), f, one in zip(rows, found, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in f[2]) if f else ""
        want.append((i, *(map(len, f) if f else (0, 0, 0)), sum(one.values()), sum(n for p, n in one.items() if held[p] == best[p[0]]),
                     sum(n * held[p] for p, n in one.items()), hashlib.sha256(text.encode()).hexdigest() if f else ""))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = alignment.alignments(docs(spark, rows), BYTE, PIECE, size, lane, wide).select(*columns).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))
    assert sum(not f for f in found) > 10 and alignment.alignments(docs(spark, []), BYTE, PIECE).count() == 0


def test_memo_gives_the_libraries_ids():
    both = alignment.pair(BYTE, PIECE)
    texts = [r[1] for r in alignment_rows() if r[1] and "▁" not in r[1]]
    ids_a, n_a, ids_b, n_b, _ = both.encode(texts)
    for ids, n, want in ((ids_a, n_a, [both.a.encode(" " + t, add_special_tokens=False).ids for t in texts]), (ids_b, n_b, both.b.encode(texts))):
        assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]
