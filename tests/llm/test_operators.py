"""Operators on small fixtures with nulls, empty and long texts, ties and repeated rows, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from errbound.llm import bitsliced, components, count_cache, decontaminate, hilbert, language_crf, minhash, snapshots, token_files, tree_bpe, warc
from errbound.llm.common import fresh_dir, stored
from errbound.llm.encoders import encoder, public_path

BYTE, WORD = public_path("byte_bpe_50k.json"), public_path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"
RNG = random.Random(5)
LONG = " ".join("".join(RNG.choices("abcdeé", k=RNG.randrange(1, 9))) for _ in range(9000))


def texts():
    base = " ".join(f"word{i}" for i in range(60))
    return [(1, base), (2, base + " more"), (3, base), (4, None), (5, ""), (6, "  \n "), (7, "one two"), (8, "ONE two"), (9, LONG),
            (10, LONG + " end"), (11, "a<|endoftext|>b"), (1, base), (None, base), (12, "\U0001f600 你好" * 50)]


def docs(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5) for i, t in rows], DOCS)


def test_token_files(spark):
    t = encoder(WORD).tokenizer
    rows = sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_files.token_files(docs(spark), WORD).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    manifest = token_files.write_token_files(docs(spark), fresh_dir(spark, "t"), WORD)
    assert token_files.read_document(manifest, len(rows) - 1).tolist() == t.encode(rows[-1][1], add_special_tokens=False).ids + [1]
    assert token_files.token_files(docs(spark, []), WORD).count() == 0


def test_count_cache(spark):
    folder, t = fresh_dir(spark, "c"), encoder(BYTE).tokenizer
    want = sorted(str((i, len((x or "").encode()), n := len(t.encode(x or "").ids), n > 1024)) for i, x in texts())
    for _ in range(2):  # the second run is all hits
        assert sorted(str(tuple(r)) for r in count_cache.token_counts(docs(spark), folder, BYTE).collect()) == want
    assert count_cache.misses(docs(spark), count_cache.read_cache(spark, folder, BYTE)).count() == 0
    assert count_cache.read_cache(spark, folder, BYTE).count() == len({x or "" for _, x in texts()})
    assert count_cache.token_counts(docs(spark, []), folder, BYTE).count() == 0


@pytest.mark.parametrize("leaf", [7, 100, 16_384])
def test_tree_bpe(spark, leaf):
    t = encoder(BYTE).tokenizer
    rows = texts() if leaf > 50 else [r for r in texts() if r[1] is None or len(r[1]) < 1000]
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append(str((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())))
    assert sorted(str(tuple(r)) for r in tree_bpe.encode_decode(docs(spark, rows), BYTE, leaf).collect()) == sorted(want)


def test_tree_of_a_text_of_several_megabytes(spark):
    text = LONG * 60 + "é" * 40_000 + "ab" * 30_000
    parts = tree_bpe.leaves_of(text, 16_384)
    assert "".join(parts) == text and max(map(len, parts)) <= 16_384 and len(parts) & (len(parts) - 1) == 0
    t = encoder(BYTE).tokenizer
    ids = t.encode(text, add_special_tokens=False).ids
    (got,) = tree_bpe.encode_decode(docs(spark, [(1, text)]), BYTE).collect()
    assert (got.n_tokens, got.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_tree_join_on_unsplit_texts():
    rng, t = random.Random(2), encoder(BYTE).tokenizer
    for alphabet in ("ab", "abcdefghijklmnop", "0123456789", "!?-", "ab 's\n<|endoftext|>", "é世\U0001f600a"):
        for _ in range(12):
            text = "".join(rng.choices(alphabet, k=rng.randrange(50, 1500)))
            if "<" in alphabet:
                text = text.replace("<", "<|endoftext|>")
            cuts = sorted(rng.sample(range(len(text)), 3))
            leaves = [t.encode(text[a:b]).ids for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
            assert tree_bpe.Joiner(BYTE).tree(leaves) == t.encode(text).ids


def brute_components(rows):
    def shingles(x):
        w = (x or "").encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [(i, shingles(x)) for i, x in rows]
    label = {i: i for i, _ in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y) and label[a] < label[b]:
                    label[b], changed = label[a], True
    return sorted(str((i, len(x), label.get(i), i is None or label[i] == i)) for i, x in sets)


def test_near_duplicates(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    common = [f"c{i}" for i in range(40)]
    rows = texts()
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
        rows.append((100 + i, " ".join(words)))
    rows += [(300 + i, " ".join(common + [f"u{i}-{j}" for j in range(30)])) for i in range(60)]
    got = minhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_components(rows)
    kept = minhash.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark).columns and kept.count() < len(rows)
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_hilbert(spark):
    rows = [(i, None if i % 7 == 0 else "t" * (i % 50), None if i % 5 == 0 else f"l{i % 3}", f"src{i % 11}", 1, 0.0) for i in range(500)] + [(None, "x", "l1", None, 1, 0.0)] * 3
    got = hilbert.document_shards(spark.createDataFrame(rows, DOCS)).collect()
    sizes = {s: sorted(r.slot for r in got if r.shard == s) for s in range(24)}
    assert len(got) == 503 and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(x == list(range(len(x))) for x in sizes.values())
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert_index for r in order] == sorted(r.hilbert_index for r in got)
    want = sorted(str((r[0], len(r[1] or "") + 8, zlib.crc32((r[1] or "").encode()))) for r in rows)
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in got) == want
    assert hilbert.document_shards(docs(spark, [])).count() == 0
    for n, b in ((2, 4), (3, 3)):
        cells = spark.range(1 << n * b).select(*(F.expr(f"cast((id >> {b * i}) & {(1 << b) - 1} as int)").alias(f"x{i}") for i in range(n)))
        walk = sorted(cells.withColumn("h", hilbert.hilbert_index([F.col(f"x{i}") for i in range(n)], b)).collect(), key=lambda r: r.h)
        assert [r.h for r in walk] == list(range(1 << n * b))
        assert all(sum(abs(x[i] - y[i]) for i in range(n)) == 1 for x, y in zip(walk, walk[1:]))


def test_snapshots(spark):
    say = [("user", "a"), ("assistant", "b"), ("user", None), (None, "d")]
    rows = [(c, t, *say[t]) for c, n in ((1, 4), (2, 2), (3, 4), (4, 1)) for t in range(n)]
    rows += [(5, 0, "user", "a"), (5, 1, "assistant", "other"), (5, 1, "assistant", "other"), (None, 0, "user", "a"), (6, None, "user", "z")]
    rows += [(7, t, "user", str(t)) for t in range(200)] + [(8, t, "user", str(t)) for t in range(150)]
    got = snapshots.collapse_snapshots(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.conv_id: r.n_turns for r in got} == {1: 4, 5: 2, 6: 1, 7: 200}
    assert "".join(r.rendered for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.part)) == "".join(
        f"<|im_start|>{a or ''}\n{b or ''}<|im_end|>\n" for a, b in say)
    assert sorted(r.part for r in got if r.conv_id == 7) == [0, 1, 2, 3]


def test_bitsliced(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in (rng.standard_normal(8) * (30 if i % 9 == 0 else 0.2)).round(2)], 0) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8, 0) for i in range(40)] + [(2000, None, 0), (2100, [1.0, None], 0), (2200, [float("nan")] * 8, 0), (2300, [], 0), (2400, [1.0, 2.0], 0), (2500, [3.0, -2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    vectors = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for i, v, _ in rows if v and None not in v and np.isfinite(v).all()}
    want = []
    for q in (i for i in vectors if i % 100 == 0):
        hits = sorted((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))[:10]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(hits, 1)]
    for dropped, block in ((0, 50), (3, 8192), (6, 100)):
        got = bitsliced.top_k(df, F.col("vec_id") % 100 == 0, block_rows=block, dropped=dropped).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert bitsliced.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_bitsliced_large_components_and_repeated_ids(spark):
    rows = [(0, [1.0, 2.0]), (5, [40000.0, 0.0]), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (7, [5.0, 5.0]), (8, [0.5, 0.5]), (9, [-3e9, 2e9]), (100, [2.0, 0.0]), (0, [1.5, 0.0]), (11, [0.0, float("inf")])]
    df = spark.createDataFrame([(i, v, "q", 1) for i, v in rows], "vec_id long, embedding array<double>, block string, row long")
    vectors = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if np.isfinite(v).all()]
    want = []
    for a, (q, v) in enumerate(vectors):
        if q % 100 == 0:
            hits = sorted((-sum(x * y for x, y in zip(v, w)), i) for b, (i, w) in enumerate(vectors) if a != b)[:5]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(hits, 1)]
    for block, dropped in ((2, 3), (100, 0)):
        got = bitsliced.top_k(df, F.col("vec_id") % 100 == 0, k=5, block_rows=block, query_rows=2, dropped=dropped)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    with pytest.raises(Exception, match="too large"):
        bitsliced.top_k(spark.createDataFrame([(0, [1e30])], "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()


def test_warc(spark):
    page = "<p>" + "x" * 200
    rows = [(i, f"http://h/{i}", page + str(i % 3)) for i in range(90)] + [(100, None, None), (101, "u v", "short"), (102, "u", "short"), (0, "http://h/0", page + "0"), (None, "n", page + "0")]
    got = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    first, want = {}, []
    for i, _, h in rows:
        if i is not None and len(h or "") >= 100:
            first[h] = min(i, first.get(h, i))
    for i, _, h in rows:
        again = i is not None and h in first and i > first[h]
        want.append((i, len(h or ""), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))
    good = warc.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    assert warc.payload_row(good)["payload_bytes"] == 3
    for bad in (good[:-1], good + b"x", good.replace(b"abc", b"abd"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(ValueError):
            warc.payload_row(bad)


def test_language(spark):
    sets = {"xx": ["the", "and", "thing", "ership", "hation"], "yy": ["der", "und", "schung", "keiten", "lich"], "zz": ["que", "eaux", "ment", "leur", "tion"]}
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(sets[x], k=40)), x, "s", 1, 0.0) for i, x in enumerate(rng.choices(list(sets), k=150))]
    extra = [(1000, None, "xx", "s", 1, 0.0), (1001, "123 ...", None, "s", 1, 0.0), (1002, "", None, "s", 1, 0.0)]
    df = spark.createDataFrame(rows + extra, DOCS)
    model = language_crf.train(df)
    got = {r.doc_id: r for r in language_crf.detect_languages(df, model).collect()}
    assert len(got) == 153 and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert sum(got[r[0]].lang_pred == r[2] for r in rows) >= 148
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    mixed = language_crf.label_words(" ".join(sets["xx"] * 4 + sets["yy"] * 4), model)
    assert [y for _, y in mixed] == ["xx"] * 20 + ["yy"] * 20
    assert {r.lang_pred for r in language_crf.detect_languages(df, language_crf.train(df.limit(0))).collect()} == {"und"}


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    scores, begins, trans, start = rng.standard_normal((7, 3)), np.array([1, 0, 0, 1, 0, 0, 0], bool), rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    want = np.zeros((7, 3))
    import itertools
    for a, b in ((0, 3), (3, 7)):
        for path in itertools.product(range(3), repeat=b - a):
            p = start[path[0]] * np.prod([np.exp(scores[a + i, y]) for i, y in enumerate(path)]) * np.prod([trans[x, y] for x, y in zip(path, path[1:])])
            for i, y in enumerate(path):
                want[a + i, y] += p
    want /= want.sum(axis=1, keepdims=True)
    for steps in (1, 2, 3, 256):
        assert np.allclose(language_crf.posteriors(scores, begins, trans, start, steps), want)


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"b{rng.randrange(3000)}" for _ in range(rng.randrange(15, 50)))) for i in range(40)] + [(90, None), (91, "")]
    rows, want = [], set()
    for d in range(80):
        words = [f"n{rng.randrange(5000)}" for _ in range(rng.randrange(0, 400))]
        if d % 4 == 0:
            i = d // 4
            part = items[i][1].split()
            if d % 8 == 0:
                part = [w for w in part if rng.random() > 0.15] + part[-2:]
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
            want.add((d, i))
        rows.append((d, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows += [(500, None), (501, ""), (None, items[0][1])]
    got = decontaminate.benchmark_matches(docs(spark, rows), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    clean = decontaminate.without_benchmark(docs(spark, rows), bench)
    assert clean.columns == docs(spark).columns and clean.count() == len(rows) - len(want)
    assert decontaminate.benchmark_matches(docs(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.benchmark_matches(docs(spark, []), bench).count() == 0


def test_decontamination_of_a_passage_in_a_third_of_the_rows(spark):
    rng = random.Random(12)
    hot, rare = ([f"{k}{rng.randrange(3000)}" for _ in range(30)] for k in "hr")
    everyday = [f"e{i}" for i in range(25)]  # its words stand in all documents, its order in one
    rows, want = [], {(7, 1), (8, 2)}
    for d in range(90):
        words = [f"n{rng.randrange(5000)}" for _ in range(rng.randrange(40, 300))]
        if d % 3 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = hot
            want.add((d, 0))
        words[len(words) // 2:len(words) // 2] = everyday if d == 7 else rare if d == 8 else everyday[::-1]
        rows.append((d, " ".join(words)))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate((hot, everyday, rare))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.benchmark_matches(docs(spark, rows), bench).collect()} == want
    assert decontaminate.without_benchmark(docs(spark, rows), bench).count() == len(rows) - len({d for d, _ in want})
    only = spark.createDataFrame([(1, " ".join(everyday))], "item_id long, text string")  # no item with a weight
    assert {(r.doc_id, r.item_id) for r in decontaminate.benchmark_matches(docs(spark, rows), only).collect()} == {(7, 1)}


def test_decontamination_cosine_does_not_fall_with_the_table(spark):
    rng = random.Random(13)
    items = [(i, " ".join(f"b{rng.randrange(3000)}" for _ in range(30))) for i in range(10)]
    rows = []
    for d in range(40):
        words = [f"n{rng.randrange(5000)}" for _ in range(60)]
        if d < 10:
            words[20:20] = [w if rng.random() > 0.3 else f"n{rng.randrange(5000)}" for w in items[d][1].split()[:24]] + items[d][1].split()[24:]
        rows.append((d, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    few, many = ({(r.doc_id % 1000, r.item_id): r.cosine for r in decontaminate.benchmark_matches(docs(spark, x), bench).collect()}
                 for x in (rows, [(1000 * k + d, t) for k in range(20) for d, t in rows]))
    assert few and few.keys() == many.keys() and all(many[x] > few[x] - 0.01 for x in few)


def test_decontamination_of_repeated_ids_and_words(spark):
    rng = random.Random(14)
    one, two = (" ".join(f"{k}{i}" for i in range(20)) for k in "xy")
    often = " ".join(["again"] * 14 + [f"z{i}" for i in range(10)])  # 60 % of it are few of its distinct words
    noise = [[f"n{rng.randrange(5000)}" for _ in range(120)] for _ in range(30)]
    held = " ".join(["again"] * 14 + [f"z{i}" for i in range(5)])
    rows = [(d, " ".join(w[:50]) + " " + {3: one, 4: two, 5: held}.get(d, "") + " " + " ".join(w[50:])) for d, w in enumerate(noise)]
    bench = spark.createDataFrame([(1, one), (1, two), (2, often + " ? " + " ".join(["again"] * 4))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.benchmark_matches(docs(spark, rows), bench).collect()} == {(3, 1), (4, 1), (5, 2)}


def test_common_length():
    rng = random.Random(9)
    for _ in range(200):
        a, b = rng.choices("abcd", k=rng.randrange(0, 20)), rng.choices("abcd", k=rng.randrange(0, 30))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert decontaminate.common_length(a, b) == row[-1]


def test_merged_components(spark):
    rng, parent, labels = random.Random(3), {}, spark.createDataFrame([], "node long, component long")

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    chain = [(i, i + 1) for i in range(20)]
    for links in (chain, [(rng.randrange(60), rng.randrange(60)) for _ in range(25)], [], [(5, 5), (70, 3), (80, 81), (80, 81)]):
        for u, v in links:
            if u != v:
                a, b = sorted((root(u), root(v)))
                parent[b] = a
        labels = stored(components.merged(labels, spark.createDataFrame(links, "u long, v long")), "labels")
        assert {r.node: r.component for r in labels.collect()} == {x: root(x) for x in parent}
        assert labels.count() == len(parent)
