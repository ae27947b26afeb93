"""Language of whole texts by a linear-chain conditional random field over words.

Each word has features: its prefixes and suffixes of one to three characters, its character 2- and 3-grams, and how it
stands in each language's lexicon.  A chain is a whole text; learned transitions say how likely the language
changes from word to word.  Forward-backward gives each word's distribution over languages; their mean over the
text names the language and its score, and words can be labelled in code-switched text (`label_words`).

Fit: the sample is `per_language` labelled texts a language (chosen by a hash), fewer where `most_texts` texts would not
suffice for all languages, and an error where they are fewer than the languages; of a text beyond `max_chars` characters a
piece at a place chosen by hash is read.  Training chains switch languages at random between runs of these texts' words.
Only text and lang are read.  Everything else covers all words of all rows; a word beyond 64 characters is several.

Rows: a null text or one without letters is `und` with score 0; without labelled rows every text is `und`; every row
gives a row, repeated ones too; labels that are null are not learned; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import serve, small_batches, text_slices

UNDETERMINED = "und"
FEATURES = 1 << 16
MEMO_ENTRIES = 200_000
_WORD = re.compile(r"[^\W\d_]{1,64}")  # what is longer, as in scripts without spaces, is several words of the chain
ROW_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@dataclass
class Model:
    labels: list[str]
    weights: object = None  # feature, label
    transitions: object = None  # potentials, label to label
    start: object = None
    lexicon: dict = field(default_factory=dict)  # word to a small code, one a language profile


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(word: str, lexicon: dict) -> list[int]:
    """Hashed features of a word."""
    marked = f"^{word}$"
    named = [f"p{word[:i]}" for i in (1, 2, 3)] + [f"s{word[-i:]}" for i in (1, 2, 3)]
    named += [marked[i:i + n] for n in (2, 3) for i in range(len(marked) - n + 1)]
    named.append(f"L{lexicon.get(word, -1)}")
    return [zlib.crc32(x.encode()) % FEATURES for x in named]


def emissions(words: list[str], model: Model):
    """Score of each word for each label."""
    import numpy as np

    found = [features(w, model.lexicon) for w in words]
    at = np.cumsum([0, *map(len, found)])[:-1]
    flat = np.fromiter((x for f in found for x in f), np.int64)
    return np.add.reduceat(model.weights[flat], at, axis=0) / 4 if len(words) else np.empty((0, len(model.labels)))


def posteriors(scores, begins, transitions, start, steps: int = 256):
    """Distribution of each word's label: forward-backward over chains laid end to end.

    scores: word, label.  begins: True at the first word of a chain.  The row of words is cut into equal blocks; the
    product of each block's step matrices carries both passes over block ends, so all blocks advance together and
    a chain may be of any length.
    """
    import numpy as np

    n, k = scores.shape
    if not n:
        return np.empty((0, k))
    steps = min(steps, n)
    blocks = -(-n // steps)
    psi = np.ones((blocks * steps, k))
    psi[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    first = np.zeros(blocks * steps, bool)
    first[:n] = begins
    first[0] = True
    first[n:] = True  # what fills the last block stands apart
    psi, first = psi.reshape(blocks, steps, k).swapaxes(0, 1).copy(), first.reshape(blocks, steps).T.copy()
    products = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(steps):
        moved = products @ transitions
        if first[t].any():
            moved[first[t]] = products[first[t]].sum(axis=2, keepdims=True) * start
        products = moved * psi[t][:, None, :]
        products /= products.max(axis=(1, 2), keepdims=True)
    enter, leave = np.full((blocks, k), 1 / k), np.ones((blocks, k))
    for b in range(1, blocks):
        x = enter[b - 1] @ products[b - 1]
        enter[b] = x / x.sum()
    for b in range(blocks - 2, -1, -1):
        x = products[b + 1] @ leave[b + 1]
        leave[b] = x / x.max()
    forward, now = np.empty_like(psi), enter
    for t in range(steps):
        moved = now @ transitions
        if first[t].any():
            moved[first[t]] = start
        now = moved * psi[t]
        now = now / now.sum(axis=1, keepdims=True)
        forward[t] = now
    after = leave
    for t in range(steps - 1, -1, -1):
        forward[t] *= after
        weighted = psi[t] * after
        moved = weighted @ transitions.T
        if first[t].any():
            moved[first[t]] = (weighted[first[t]] @ start)[:, None]
        after = moved / moved.max(axis=1, keepdims=True)
    out = forward.swapaxes(0, 1).reshape(-1, k)[:n]
    return out / out.sum(axis=1, keepdims=True)


def training_sample(labelled: DataFrame, per_language: int, max_chars: int, most_texts: int) -> dict[str, list[str]]:
    """lang to texts, of a longer one a piece of max_chars characters at a place chosen by hash; at most most_texts reach the driver."""
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = usable.select("lang").distinct().limit(most_texts + 1).count()
    if langs > most_texts:
        raise ValueError(f"more than {most_texts} languages: a larger sample is needed to learn them all")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"), "doc_id")
    light = usable.withColumn("n", F.row_number().over(order)).where(F.col("n") <= min(per_language, most_texts // max(langs, 1)))
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - max_chars, F.lit(0)) + 1) + 1
    out: dict[str, list[str]] = {}
    for r in light.select("lang", F.substring("text", start.cast("int"), F.lit(max_chars)).alias("text"), "n").orderBy("lang", "n").collect():
        out.setdefault(r.lang, []).append(r.text)
    return out


def _lexicon(texts: dict[str, list[str]], labels: list[str], least: int = 2) -> dict[str, int]:
    """Words of the sample by profile: the language that has most of its uses, and how clearly."""
    uses: dict[str, list[int]] = {}
    for i, label in enumerate(labels):
        for text in texts[label]:
            for w in words_of(text):
                uses.setdefault(w, [0] * len(labels))[i] += 1
    out = {}
    for w, n in uses.items():
        if sum(n) >= least:
            share = max(n) / sum(n)
            out[w] = 3 * n.index(max(n)) + (share > 0.6) + (share > 0.9)
    return out


def fit(texts: dict[str, list[str]], chain: int = 64, chains: int = 1500, epochs: int = 24, seed: int = 7) -> Model:
    """Maximum-likelihood training with Adagrad steps on chains that switch languages."""
    import numpy as np

    labels = sorted(x for x in texts if any(words_of(t) for t in texts[x]))
    if not labels:
        return Model([])
    rng, k = np.random.default_rng(seed), len(labels)
    model = Model(labels, np.zeros((FEATURES, k), np.float64), np.ones((k, k)), np.full(k, 1 / k), _lexicon(texts, labels))
    pool = [[w for t in texts[x] for w in words_of(t)] for x in labels]
    index: dict[str, int] = {}
    word, gold = np.empty((chains, chain), np.int64), np.empty((chains, chain), np.int64)
    for c in range(chains):
        at = 0
        while at < chain:
            y, n = int(rng.integers(k)), min(int(rng.geometric(1 / 16)), chain - at)
            a = int(rng.integers(max(1, len(pool[y]) - n)))
            run = (pool[y][a:a + n] * n)[:n]
            word[c, at:at + n] = [index.setdefault(w, len(index)) for w in run]
            gold[c, at:at + n] = y
            at += n
    known = list(index)
    # half the words train without their lexicon entry, as most words of other texts have none
    bare = rng.random(len(known)) < 0.5
    sets = [features(w, {} if b else model.lexicon) for w, b in zip(known, bare, strict=True)]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate([np.array(s) for s in sets])
    edges, logs = np.cumsum([0, *map(len, sets)])[:-1], np.zeros((k, k))
    steps_w, steps_t = np.full_like(model.weights, 1e-6), np.full_like(logs, 1e-6)
    for turn in range(epochs):
        chosen = np.arange(chains)[(turn % 6)::6] if chains >= 6 else np.arange(chains)
        ids, y = word[chosen].ravel(), gold[chosen].ravel()
        scores = np.add.reduceat(model.weights[flat], edges, axis=0) / 4
        begins = np.tile(np.arange(chain) == 0, len(chosen))
        trans = np.exp(logs - logs.max())
        gamma = posteriors(scores[ids], begins, trans, model.start, steps=chain)
        rest = np.eye(k)[y] - gamma
        by_word = np.stack([np.bincount(ids, rest[:, j], len(known)) for j in range(k)], axis=1)
        grad = np.stack([np.bincount(flat, by_word[owner, j], FEATURES) for j in range(k)], axis=1) / 4 - 1e-3 * model.weights
        steps_w += grad ** 2
        model.weights += 0.5 * grad / np.sqrt(steps_w)
        # pair marginals: expected counts of neighbours, with the pair potential between one-sided messages
        inside = ~begins[1:]
        seen = np.zeros((k, k))
        np.add.at(seen, (y[:-1][inside], y[1:][inside]), 1.0)
        grad_t = seen - _expected_pairs(scores[ids], begins, trans, model.start, chain) - 1e-2 * logs
        steps_t += grad_t ** 2
        logs += 0.3 * grad_t / np.sqrt(steps_t)
    model.weights, model.transitions = model.weights.astype(np.float32), np.exp(logs - logs.max())
    return model


def _expected_pairs(scores, begins, transitions, start, chain: int):
    """Summed pair marginals of chains of one length."""
    import numpy as np

    k = scores.shape[1]
    psi = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(-1, chain, k).swapaxes(0, 1)
    ahead, now = [], start * psi[0]
    for t in range(chain):
        now = (now @ transitions) * psi[t] if t else now
        now = now / now.sum(axis=1, keepdims=True)
        ahead.append(now)
    total, after = np.zeros((k, k)), np.ones_like(now)
    for t in range(chain - 1, 0, -1):
        weighted = psi[t] * after
        pair = ahead[t - 1][:, :, None] * transitions * weighted[:, None, :]
        total += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        after = weighted @ transitions.T
        after = after / after.max(axis=1, keepdims=True)
    return total


class Tagger:
    """A model with a memo of the scores of recurring words."""

    def __init__(self, model: Model, entries: int = MEMO_ENTRIES, chars: int = 800_000):
        import numpy as np

        self.model, self.memo, self.entries, self.chars = model, {}, entries, chars
        self.scores = np.empty((entries, len(model.labels)), np.float32)

    def _word_scores(self, words: list[str]):
        import numpy as np

        new = list(set(words).difference(self.memo))
        if len(self.memo) + len(new) > self.entries:
            self.memo.clear()
            new = list(set(words))
            if len(new) > self.entries:
                place = {w: i for i, w in enumerate(new)}
                return emissions(new, self.model)[np.fromiter(map(place.__getitem__, words), np.int64, len(words))]
        at = len(self.memo)
        self.scores[at:at + len(new)] = emissions(new, self.model)
        self.memo.update(zip(new, range(at, at + len(new)), strict=True))
        return self.scores[np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))]

    def label(self, texts: list) -> list[tuple[list[str], object]]:
        """Words and their posterior distributions, for each text."""
        import numpy as np

        split = [words_of(t) for t in texts]
        sizes = np.array([len(x) for x in split], np.int64)
        flat = [w for x in split for w in x]
        begins = np.zeros(len(flat), bool)
        begins[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        found = posteriors(self._word_scores(flat).astype(float), begins, self.model.transitions, self.model.start)
        ends = np.cumsum(sizes)
        return [(x, found[e - n:e]) for x, e, n in zip(split, ends, sizes, strict=True)]

    def predict(self, texts: list) -> list[tuple[str, float]]:
        out = []
        for a, b in text_slices([t or "" for t in texts], self.chars):
            for words, found in self.label(texts[a:b]):
                if words:
                    mean = found.mean(axis=0)
                    best = int(mean.argmax())
                    out.append((self.model.labels[best], min(1.0, max(0.0, float(mean[best])))))
                else:
                    out.append((UNDETERMINED, 0.0))
        return out


def label_words(text: str, model: Model) -> list[tuple[str, str]]:
    """Each word of a text with its language."""
    if not model.labels:
        return [(w, UNDETERMINED) for w in words_of(text)]
    words, found = Tagger(model).label([text])[0]
    return [(w, model.labels[i]) for w, i in zip(words, found.argmax(axis=1) if len(words) else [], strict=True)]


def train(docs: DataFrame, per_language: int = 200, max_chars: int = 8192, most_texts: int = 12_800) -> Model:
    """Fit on the documents that are not held out."""
    return fit(training_sample(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))), per_language, max_chars, most_texts))


def _tagger(known):
    serve("language")
    return Tagger(known.value) if known.value.labels else None


def _predicted(tagger: Tagger | None, texts: list) -> list[tuple[str, float]]:
    return tagger.predict(texts) if tagger else [(UNDETERMINED, 0.0)] * len(texts)


def detect_languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        tagger = _tagger(known)
        for batch in small_batches(batches, 2048):
            found = _predicted(tagger, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, ROW_SCHEMA)


def determined(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text has a language, whole and in one pass; a text in several languages has one, the most of its words'."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        tagger = _tagger(known)
        for batch in small_batches(batches):
            yield batch.filter(pa.array([x != UNDETERMINED for x, _ in _predicted(tagger, batch.column("text").to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
