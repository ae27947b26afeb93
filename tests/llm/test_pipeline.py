"""The pipeline's stages on small tables, against brute force."""

import hashlib
import random
import weakref
from types import SimpleNamespace

import numpy as np

import corpus_pipeline
from errbound.llm import language_crf, minhash
from errbound.llm.common import stored
from errbound.llm.encoders import encoder, public_path

#: Extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, held_out int, kept string, bucket long, ids array<int>, n long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "held_out", "kept", "bucket", "ids", "n"]
STEMS = {"xx": ["the", "and", "thing", "ership", "hation"], "yy": ["der", "und", "schung", "keiten", "lich"]}


def table(spark, rows):
    return spark.createDataFrame([(i, t, x, "s", 1, 2, "k", 3, [4], 5) for i, t, x in rows], SCHEMA)


def labelled(rng):
    return [(i, " ".join(rng.choices(STEMS[x], k=30)) + f" {i}", x) for i, x in enumerate(rng.choices(list(STEMS), k=80))]


def test_language_stage_drops_only_what_has_no_language(spark, tmp_path):
    rng = random.Random(2)
    rows = labelled(rng)
    mixed = " ".join(rng.choices(STEMS["xx"], k=20) + rng.choices(STEMS["yy"], k=21))
    keep = [(900, mixed, None), (None, "der und keiten schung", None), (3, "the and thing", "xx"), (901, "thing" * 4000, None)]
    drop = [(910, None, "xx"), (911, "", None), (912, " \n", None), (913, "12 ... 34", "yy")]
    docs = table(spark, rows + keep + drop)
    got = corpus_pipeline.identify_language(spark, docs, str(tmp_path))
    assert got.columns == COLUMNS and got.schema == docs.schema
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(tuple(r)) for r in table(spark, rows + keep).collect())
    assert corpus_pipeline.identify_language(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_near_duplicate_stage(spark, tmp_path):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    near = list(base)
    near[40] = "other"
    rows = [(9, " ".join(base), "xx"), (4, " ".join(near), "xx"), (7, " ".join(base).upper(), "xx"), (1, None, "xx"), (2, "", None), (None, " ".join(base), "yy")]
    rows += [(100 + i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(20)), "yy") for i in range(10)]
    got = corpus_pipeline.drop_near_duplicates(spark, table(spark, rows), str(tmp_path))
    want = [r for r in rows if r[0] not in (9, 7)]
    assert got.columns == COLUMNS
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == sorted(str(r[:2]) for r in want)


def test_decontamination_and_encoding_stages(spark, tmp_path):
    rng = random.Random(4)
    item = " ".join(f"b{rng.randrange(10**5)}" for _ in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    noise = [" ".join(f"n{rng.randrange(10**5)}" for _ in range(60)) for _ in range(20)]
    rows = [(i, t, "xx") for i, t in enumerate(noise)] + [(50, noise[0] + " " + item + " " + noise[1], "xx"), (51, None, None), (52, "", None), (None, "x", None), (5, noise[5], "xx")]
    clean = corpus_pipeline.drop_benchmark(spark, table(spark, rows), str(tmp_path))
    want = [r for r in rows if r[0] != 50]
    assert clean.columns == COLUMNS
    assert sorted(str((r.doc_id, r.text)) for r in clean.collect()) == sorted(str(r[:2]) for r in want)
    tokenizer = encoder(public_path("byte_bpe_50k.json")).tokenizer
    coded = corpus_pipeline.encode(spark, clean, str(tmp_path)).collect()
    expect = []
    for i, t, _ in want:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        expect.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in coded) == sorted(map(str, expect))


def test_words_beyond_64_characters_and_long_texts_count(spark):
    assert language_crf.words_of("é" * 150) == ["é" * 64, "é" * 64, "é" * 22]
    rows = [(i, " ".join(["langes", "wort"] * 6000), "long") for i in range(6)] + [(10 + i, "short words here", "brief") for i in range(6)]
    sample = language_crf.training_sample(table(spark, rows), 200, 500, 100)
    assert sorted(sample) == ["brief", "long"] and all(len(t) == 500 for t in sample["long"]) and len(sample["brief"]) == 6
    model = language_crf.train(table(spark, rows), max_chars=500)
    found = {r.doc_id: r.lang_pred for r in language_crf.detect_languages(table(spark, rows), model).collect()}
    assert set(model.labels) == {"brief", "long"} and all(found[r[0]] == r[2] for r in rows)


def test_worker_gives_up_tables_of_other_stages():
    encoder(public_path("byte_bpe_50k.json"))
    held = weakref.ref(encoder(public_path("byte_bpe_50k.json")))
    assert held() is not None
    language_crf._tagger(SimpleNamespace(value=language_crf.Model([])))
    assert held() is None
    ranks = weakref.ref(minhash._windows())
    assert ranks() is not None
    encoder(public_path("byte_bpe_50k.json"))
    assert ranks() is None


def test_stored_tables_move_in_bounded_batches(spark):
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})

    rows = spark.range(300).selectExpr("id", "repeat('some words ', 10000) as text").coalesce(1)
    found = stored(rows.mapInArrow(sizes, "n long, size long"), "sizes").collect()
    assert sum(r.n for r in found) == 300 and max(r.size for r in found) < 8 << 20
