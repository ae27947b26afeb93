import numpy as np
import pytest

from errbound.operators import encoders as en

RNG = np.random.default_rng(3)
STREAMS = {
    "empty": np.zeros(0, np.int64), "one": np.array([42]), "constant": np.full(500, 7),
    "uniform": RNG.integers(0, 1024, 65536), "skewed": RNG.geometric(0.3, 5000) + 32768,
    "negative": RNG.integers(-1000, 1000, 3000), "wide": RNG.integers(-2 ** 62, 2 ** 62, 100),
    "two": np.array([0, 1] * 50),
}


@pytest.mark.parametrize("name", STREAMS)
@pytest.mark.parametrize("coder", ["huffman", "fixed", "auto"])
def test_round_trip(name, coder):
    pack, unpack = en._CODERS[coder]
    assert (unpack(pack(STREAMS[name])) == STREAMS[name]).all()


@pytest.mark.parametrize("name", ["empty", "one", "constant", "skewed", "negative", "two"])
def test_arithmetic(name):
    s = STREAMS[name]
    packed = en.arith_pack(s)
    assert (en.arith_unpack(packed) == s).all()


def test_arithmetic_state_limit():
    with pytest.raises(ValueError):
        en.arith_pack(np.arange(5000))


def test_bypass_limit():
    with pytest.raises(ValueError):
        en.bypass_pack(np.array([256]))


def test_huffman_is_optimal_and_complete():
    freqs = RNG.integers(1, 10_000, 300)
    lengths = en.huffman_lengths(freqs)
    assert abs((2.0 ** -lengths).sum() - 1) < 1e-12
    p = freqs / freqs.sum()
    entropy = -(p * np.log2(p)).sum()
    assert entropy <= (p * lengths).sum() < entropy + 1


def test_large_alphabet_gets_fixed_codes(spark, monkeypatch):
    monkeypatch.setattr(en, "HUFFMAN_MAX_ALPHABET", 4)
    hist = spark.createDataFrame([("a", i, 10) for i in range(3)] + [("b", i, 1) for i in range(9)], "k string, s int, freq long")
    rows = {(r.k, r.s): r.code_length for r in en.huffman_code_lengths(hist, ["k"], "s").collect()}
    assert {v for (k, _), v in rows.items() if k == "b"} == {4}
    assert sorted(v for (k, _), v in rows.items() if k == "a") == [1, 2, 2]


def test_arithmetic_table_limit(spark):
    hist = spark.range(5000).selectExpr("id AS s", "1L AS freq")
    with pytest.raises(Exception, match="4096"):
        en.cumulative_frequencies(hist, [], "s").collect()
