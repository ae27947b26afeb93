"""The latent search of the decontamination on its own, and both searches against brute force."""

import random

import numpy as np
import pytest

from errbound.llm import decontaminate

DOCS = "doc_id long, text string, item_id string, matched int, cosine double, n long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 0.5, 2) for i, t in rows], DOCS)


def corpus(rng, share):
    """Documents of which every third holds an item with `share` of its words kept in order; the others hold a few scattered words."""
    items = [(i, [f"b{rng.randrange(2000)}" for _ in range(rng.randrange(24, 60))]) for i in range(30)]
    rows, planted = [], set()
    for d in range(120):
        words = [f"n{rng.randrange(4000)}" for _ in range(rng.randrange(50, 250))]
        i, item = items[d % 30]
        if d % 3 == 0:
            part, at = [w if k >= len(item) - 4 or rng.random() < share else f"n{rng.randrange(4000)}" for k, w in enumerate(item)], rng.randrange(len(words))
            words[at:at] = part
            if sum(a == b for a, b in zip(part, item, strict=True)) >= 0.5 * len(item):
                planted.add((d, i))
        else:
            for w in rng.sample(item, 5):
                words[rng.randrange(len(words))] = w
        rows.append((d, " ".join(words)))
    return [(i, " ".join(w)) for i, w in items], rows, planted


def found(spark, rows, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.benchmark_matches(docs(spark, rows), bench, **options).collect()}


def brute(rows, items, share, answer_share):
    out = set()
    for d, text in rows:
        words = decontaminate.words_of(text)
        for i, item in items:
            wanted = decontaminate.words_of(item)
            answer = wanted[len(wanted) - decontaminate.answer_length(item, len(wanted)):]
            for at in range(0, max(len(words), 1), decontaminate.BIN):
                region = words[max(0, at - len(wanted)):at + 2 * decontaminate.BIN + len(wanted)]
                if set(region) & set(wanted) and decontaminate.common_length(wanted, region) >= share * len(wanted) and (
                        decontaminate.common_length(answer, region) >= answer_share * len(answer)):
                    out.add((d, i))
    return out


def test_paraphrases_need_the_latent_search(spark, monkeypatch):
    items, rows, planted = corpus(random.Random(31), 0.55)
    got = found(spark, rows, items)
    strict = brute(rows, items, 0.6, 0.5)
    assert strict <= got and len(got - strict) >= 5  # paraphrases of less than 60 % of the words
    assert len(got & planted) >= 0.9 * len(planted) and all(d % 3 == 0 for d, _ in got)
    assert found(spark, rows, items, near=2.0) == strict  # without the rule for near texts they are missed


@pytest.mark.parametrize("share", [0.8, 0.65])
def test_latent_candidates_alone_reach_recall(spark, share):
    items, rows, _ = corpus(random.Random(32), share)
    want = brute(rows, items, 0.6, 0.5)
    words = sorted({w for _, t in items for w in decontaminate.words_of(t)})
    bench = spark.createDataFrame(items, "item_id long, text string")
    n, seen = decontaminate.document_frequencies(docs(spark, rows), set(words))
    terms, weights = {w: k for k, w in enumerate(words)}, {w: 5.0 for w in words}

    def matrix(batches):
        import pyarrow as pa

        for batch in batches:
            lists = [[terms[w] for w in dict.fromkeys(p)] for t in batch.column("text").to_pylist() for p in decontaminate.passages(decontaminate.words_of(t))]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int64())), pa.array([[1 / len(x) ** 0.5] * len(x) for x in lists], pa.list_(pa.float64()))], names=["ids", "weights"])

    basis = decontaminate.latent_basis(bench.select("text").mapInArrow(matrix, "ids array<long>, weights array<double>"), len(terms))
    searcher = decontaminate.Searcher(items, weights, terms, basis, 0.3, 0.6, 0.5, seen, 2.0, 0.45)
    split = [decontaminate.words_of(t) for _, t in rows]
    ids = searcher._ids(split, np.array([len(x) for x in split]))
    latent = {(rows[d][0], items[i][0]) for d, at, i in zip(*(x.tolist() for x in searcher.candidates(split, ids)[:3]), strict=True) if searcher.matches(split[d], at, i, 0.0) is not None}
    assert want and len(latent & want) >= 0.9 * len(want)


def test_windows_are_checked_together(monkeypatch):
    """The words of all candidates are counted in one pass, with the same answer as one by one; few are then looked at alone."""
    rng = random.Random(8)
    items, rows, planted = corpus(rng, 0.8)
    vocabulary = sorted({w for _, t in items for w in decontaminate.words_of(t)})
    terms, weights = {w: i for i, w in enumerate(vocabulary)}, dict.fromkeys(vocabulary, 3.0)
    basis = np.linalg.qr(np.random.default_rng(1).standard_normal((len(terms), 64)))[0]
    own = decontaminate.Searcher(items, weights, terms, basis, 0.05, 0.6, 0.5, {}, 0.45, 0.45)
    split = [decontaminate.words_of(t) for _, t in rows]
    ids = own._ids(split, np.array([len(x) for x in split]))
    near = own.candidates(split, ids)
    held = own.may_hold_all(split, ids, *near)
    for d, at, i, cosine, got in zip(*(x.tolist() for x in near), held.tolist(), strict=True):
        n = len(own.words[i])
        share = own.near_share if cosine >= own.near else own.share
        assert got == own.may_hold(split[d][max(0, at * 16 - n):(at + 2) * 16 + n], i, share)
    fine = own.roomy(split, ids, *near)
    assert len(held) > 1000 and not (held & ~fine).any()
    alone, check = [], own.may_hold
    monkeypatch.setattr(own, "may_hold", lambda *a: alone.append(1) or check(*a))
    monkeypatch.setattr(own, "exact", lambda *a: [])
    hits = {(d, i) for d, i, *_ in own.search([d for d, _ in rows], [t for _, t in rows])}
    assert hits and hits <= {(d, i) for d, i in planted} and len(alone) == held.sum()


def test_words_of_latin_texts():
    for text in ["".join(map(chr, range(k, k + 64))) for k in range(0, 0x500, 64)] + ["É_a-ß\xa0x\x85y\x1cz µÀ÷×ª", "İ ſ Σας", ""]:
        assert decontaminate.words_of(text) == decontaminate._WORD.findall(text.lower())
