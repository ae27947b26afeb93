"""The vertically partitioned Jaccard join against brute force."""

import random

import pytest

from errbound.llm import vertical_join

#: Extra columns whose names the operator uses inside.
SCHEMA = "doc_id long, text string, lang string, bucket long, node int, n int, hashes array<long>, component string, a long, owner long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, [4], "c", 5, 6) for i, t in rows], SCHEMA)


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows]
    label = [i for i, _ in sets]
    changed = True
    while changed:
        changed = False
        for x, (i, s) in enumerate(sets):
            for y, (j, t) in enumerate(sets):
                if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t) and label[x] < label[y]:
                    label[y], changed = label[x], True
    return sorted(str((i, len(s), c)) for (i, s), c in zip(sets, label, strict=True))


def changed_words(rng, words, times):
    out = list(words)
    for _ in range(times):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


def corpus():
    rng = random.Random(21)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    passage = [f"p{i}" for i in range(60)]
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "ONE two"), (6, "one two three four five"), (None, " ".join(base)), (7, "lone text of its own here")]
    rows += [(100 + i, changed_words(rng, base, rng.randrange(0, 7))) for i in range(50)]
    rows += [(200 + i, " ".join(base)) for i in range(10)] + [(200, " ".join(base)), (205, " ".join(passage))]
    rows += [(300 + i, " ".join(passage + [f"u{i}-{j}" for j in range(rng.randrange(0, 60))])) for i in range(50)]
    chain = [f"k{i}" for i in range(400)]
    rows += [(400 + i, " ".join(chain[8 * i:8 * i + 120])) for i in range(35)]  # each linked with the next only
    rows += [(500 + i, " ".join(f"{rng.choice('ab')}{j}" if j % 9 == 0 else f"c{j}" for j in range(90))) for i in range(30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("percent", "spare", "run", "fragments"), [(80, 2, 1024, 8), (75, 0, 2, 3)])
def test_similar_documents(spark, monkeypatch, percent, spare, run, fragments):
    monkeypatch.setattr(vertical_join, "SPARE", spare)
    monkeypatch.setattr(vertical_join, "RUN", run)
    rows = corpus()
    got = vertical_join.similar_documents(docs(spark, rows), percent, fragments).collect()
    have, want = sorted(str(tuple(r)) for r in got), brute(rows, percent)
    assert have == want, [(x, y) for x, y in zip(have, want) if x != y][:5]


def test_tables_without_links(spark):
    assert vertical_join.similar_documents(docs(spark, [])).count() == 0
    rows = [(1, None), (2, "a b"), (3, "a b c d e f"), (None, None)]
    assert sorted(str(tuple(r)) for r in vertical_join.similar_documents(docs(spark, rows)).collect()) == brute(rows, 80)


def test_overlaps_are_sums_over_fragments(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(300)}" for _ in range(200)]
    rows = [(i, changed_words(rng, base, 3)) for i in range(12)]
    signed = docs(spark, rows).select("doc_id", "text").mapInArrow(vertical_join._sets(None), vertical_join.SIGNED_SCHEMA)
    sets = {r.doc_id: set(r.hashes) for r in signed.collect()}
    survivors = signed.selectExpr("doc_id as node", "n_shingles as n", "hashes")
    ordered = vertical_join._ordered(survivors)
    segments = vertical_join._segments(ordered, 5)
    assert segments.select("fragment").distinct().count() > 1
    members = vertical_join._buckets(ordered, 80)
    pairs = spark.createDataFrame([(a, b) for a in range(12) for b in range(a)], "b long, a long")
    got = vertical_join._Linker(members, segments, 80).overlaps(pairs).collect()
    assert {(r.a, r.b): r.shared for r in got} == {(a, b): len(sets[a] & sets[b]) for b in range(12) for a in range(b)}
