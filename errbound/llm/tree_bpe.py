"""Byte-level BPE of long unsplit texts by tree concatenation, and decoding from the ids.

A text longer than `leaf_chars` is halved until its leaves are short enough; leaves are dealt over the executors
and encoded in parallel.  Neighbours are joined level by level: the last ids of the left half and the first of
the right half are decoded, encoded together, and the window grows until both of its sides agree with the
halves at a place where the encoding cannot depend on what lies beyond:

* a class boundary (a letter, a digit or a mark ends before a character of another kind), where pre-tokens of
  the byte-level pattern always end; or
* inside one long pre-token, a token boundary whose two tokens encode to themselves when put together.  A
  sequence of tokens all of whose neighbours do so is the encoding of its text.

Both places keep a margin longer than any special string from the window's ends.  A window that has become both
halves is their encoding.

Rows: a null text is an empty one; every row gives a row, repeated ones too; null doc_ids stay null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_for, small_batches
from .encoders import encoder

ROW_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
FIRST_WINDOW = 24


@kept_for("encoders", 2)
def token_bytes(path: str) -> list[bytes]:
    """Bytes of each id: byte-level alphabet for ordinary tokens, the string itself for added ones."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    tokenizer = encoder(path).tokenizer
    added = tokenizer.get_added_tokens_decoder()
    out = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        out[i] = added[i].content.encode() if i in added else bytes(back[c] for c in token)
    return out


def decode(ids, path: str) -> str:
    """Text of ids; bytes that form no character become the replacement character."""
    ids = ids if isinstance(ids, list) else ids.tolist()
    return b"".join(map(token_bytes(path).__getitem__, ids)).decode("utf-8", "replace")


def _kind(c: str) -> str:
    return "S" if c.isspace() or "\x1c" <= c <= "\x1f" else unicodedata.category(c)[0] if c.isalpha() or unicodedata.category(c)[0] == "N" else "P"


def _ends(a: str, b: str) -> bool:
    """Whether a pre-token always ends between two characters."""
    x, y = _kind(a), _kind(b)
    return x != y and (x in "LN" or (x == "P" and b in " \n\t\r"))


class Joiner:
    def __init__(self, path: str):
        import numpy as np

        self.path, self.bytes, self.encoder = path, token_bytes(path), encoder(path)
        self.margin = max([16, *(len(x.content.encode()) + 1 for x in self.encoder.tokenizer.get_added_tokens_decoder().values())])
        self.np = np

    def _ids(self, text: str) -> list[int]:
        return self.np.frombuffer(self.encoder.encode([text])[0], "<u4").tolist()

    def _places(self, ids: list[int]) -> dict[int, int]:
        """Byte offset of each token boundary and the number of ids before it."""
        at, out = 0, {0: 0}
        for n, i in enumerate(ids, 1):
            at += len(self.bytes[i])
            out[at] = n
        return out

    def _fits(self, left: int, right: int) -> bool:
        try:
            text = (self.bytes[left] + self.bytes[right]).decode()
        except UnicodeDecodeError:
            return False
        return self._ids(text) == [left, right]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        size = FIRST_WINDOW
        while True:
            a, b = max(0, len(left) - size), min(size, len(right))
            edge, head = left[a:], right[:b]
            raw = b"".join(map(self.bytes.__getitem__, edge + head))
            if a == 0 and b == len(right):
                return self._ids(raw.decode())
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                size += 1 if size % 8 else size  # an end of the window lies inside a character
                continue
            got = self._ids(text)
            middle = sum(len(self.bytes[i]) for i in edge)
            mine, old_left, old_right = self._places(got), self._places(edge), self._places(head)
            chars, at = {}, 0
            for n, c in enumerate(text):
                chars[at] = n
                at += len(c.encode())
            one = len(self.encoder.tokenizer.pre_tokenizer.pre_tokenize_str(text)) == 1

            def sure(p: int, before: int, after: int) -> bool:
                return p in chars and (_ends(text[chars[p] - 1], text[chars[p]]) or one and self._fits(before, after))

            start = 0 if a == 0 else next((p for p in old_left if self.margin <= p <= middle - self.margin and p in mine
                                           and sure(p, edge[old_left[p] - 1], got[mine[p]])), None)
            stop = len(raw) if b == len(right) else next(
                (q for q in (middle + x for x in reversed(old_right)) if middle + self.margin <= q <= len(raw) - self.margin and q in mine
                 and sure(q, got[mine[q] - 1], head[old_right[q - middle]])), None)
            if start is not None and stop is not None:
                head_ids = [] if a == 0 else left[:a + old_left[start]]
                tail_ids = [] if b == len(right) else right[old_right[stop - middle]:]
                return head_ids + got[mine[start]:mine[stop]] + tail_ids
            size *= 2

    def tree(self, leaves: list[list[int]]) -> list[int]:
        while len(leaves) > 1:
            leaves = [self.join(*leaves[i:i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else []


def _row(doc_id, ids, path: str) -> tuple:
    import numpy as np

    return (doc_id, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(decode(ids, path).encode()).hexdigest())


def _table(rows: list[tuple]):
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _whole(path: str):
    def run(batches):
        import numpy as np

        for batch in small_batches(batches):
            found = encoder(path).encode(batch.column("text").to_pylist())
            rows = [_row(k, np.frombuffer(x, "<u4"), path) for k, x in zip(batch.column("doc_id").to_pylist(), found, strict=True)]
            yield from _table(rows).to_batches()
    return run


def leaves_of(text: str, leaf_chars: int) -> list[str]:
    """A text cut into a power of two of almost equal parts of at most `leaf_chars` characters."""
    n, m = len(text), 1
    while m * leaf_chars < n:
        m *= 2
    return [text[i * n // m:(i + 1) * n // m] for i in range(m)]


def _cut(leaf_chars: int):
    def run(batches):
        import pyarrow as pa

        for batch in small_batches(batches, 16):
            for key, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                text = text.as_py()
                digest, parts = hashlib.sha256(text.encode()).hexdigest(), leaves_of(text, leaf_chars)
                for a in range(0, len(parts), 256):
                    some = parts[a:a + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(some), pa.int64()), pa.array([digest] * len(some)),
                                                      pa.array(range(a, a + len(some)), pa.int64()), pa.array(some, pa.string())],
                                                     names=["doc_id", "digest", "leaf", "text"])
    return run


def _leaf(path: str):
    def run(batches):
        import pyarrow as pa

        for batch in small_batches(batches, 64):
            found = encoder(path).encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "digest", "leaf")), pa.array(found, pa.binary())],
                                            names=["doc_id", "digest", "leaf", "ids"])
    return run


def _merge(path: str):
    def run(group):
        import numpy as np

        rows = sorted(zip(group.column("leaf").to_pylist(), group.column("ids").to_pylist(), strict=True))
        copies = sum(x[0] == 0 for x in rows)  # repeated rows bring each leaf as often
        ids = Joiner(path).tree([np.frombuffer(x, "<u4").tolist() for _, x in rows[::copies]])
        return _table([_row(group.column("doc_id")[0].as_py(), ids, path)] * copies)
    return run


def encode_decode(docs: DataFrame, tokenizer: str, leaf_chars: int = 16_384) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them, for every row."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    short = named.where(F.length("text") <= leaf_chars).mapInArrow(_whole(tokenizer), ROW_SCHEMA)
    cut = named.where(F.length("text") > leaf_chars).mapInArrow(_cut(leaf_chars), "doc_id long, digest string, leaf long, text string")
    spread = cut.repartition("doc_id", "digest", "leaf").mapInArrow(_leaf(tokenizer), "doc_id long, digest string, leaf long, ids binary")
    return short.unionByName(spread.groupBy("doc_id", "digest").applyInArrow(_merge(tokenizer), ROW_SCHEMA))
