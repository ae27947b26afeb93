"""Token ids of whole texts as the tokenizers library gives them, with a memo of recurring chunks.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so joined chunk ids are the
library's ids of the whole text.  Recurring chunks are encoded once a worker.  Tokenizers of another make are
given whole texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain, repeat

from .common import kept_for, text_slices

#: Characters beyond these, or the start of a special string, send a text to the coarse pattern.
_UNUSUAL = re.compile("[\x1c-\x1f\u0130\u0180-\U0010ffff]|<\\|")
#: What of these an ASCII text may hold.
_MARKS = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: Controls that Python counts as white space and the tokenizers' patterns do not.
_ODD = re.compile("[\x1c-\x1f]")
_LETTER, _DIGIT = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Beyond so many characters of chunks the memo keeps only those that came back, or none if these are most of them.
MEMO_CHARS = 2_500_000
#: Chunks that a call of the library is given at once.
GLUED = 500
#: Small letters that no normalizer changes and every pattern takes for letters.
_PLAIN = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")


class Cuts:
    """Places where a tokenizer's pre-tokens always end: finely in usual texts, else at white space only."""

    def __init__(self, fine: str, coarse: str, lower: bool):
        self.fine, self.coarse, self.lower = re.compile(fine), re.compile(coarse), lower

    def __call__(self, text: str) -> list[str]:
        if not any(map(text.__contains__, _MARKS)) if text.isascii() else not _UNUSUAL.search(text):
            return self.fine.findall(text.lower() if self.lower else text)
        return [text] if _ODD.search(text) else self.coarse.findall(text)


def _cuts(spec: dict) -> Cuts | None:
    """Chunks that can be encoded alone, for the two makes whose patterns are known; else None.

    An apostrophe keeps the letters after it, as contractions are pre-tokens of their own.
    """
    before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    added = [x for x in spec.get("added_tokens", []) if not x["content"].startswith("<|") or re.search(r"\s", x["content"]) or x["lstrip"] or x["rstrip"]]
    if added or spec.get("model", {}).get("type") != "BPE":
        return None
    if before.get("type") == "ByteLevel" and not norm and before.get("use_regex") and not before.get("add_prefix_space"):
        fine = rf"'[{_LETTER}]+| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^\s{_LETTER}{_DIGIT}]+|\s+(?!\S)|\s+"
        return Cuts(fine, r"\s*\S+|\s+", False)
    steps = [x["type"] for x in (norm or {}).get("normalizers", [])]
    parts = before.get("pretokenizers", [{}])
    if steps == ["NFC", "Replace", "Lowercase"] and parts[0].get("invert") and parts[0].get("behavior") == "Removed":
        pattern = parts[0].get("pattern", {}).get("Regex", "")
        if pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"):
            return Cuts(rf"'[{_LETTER}]+|[{_LETTER}]+|[{_DIGIT}]|[^\s{_LETTER}{_DIGIT}]+", r"[^ \t\n\r]+", True)
    return None


class Growing:
    """An array that grows at its end."""

    def __init__(self, kind):
        import numpy as np

        self.room, self.size = np.zeros(1024, kind), 0

    def extend(self, more) -> None:
        import numpy as np

        if self.size + len(more) > len(self.room):
            room = np.zeros(2 * (self.size + len(more)), self.room.dtype)
            room[:self.size] = self.room[:self.size]
            self.room = room
        self.room[self.size:self.size + len(more)] = more
        self.size += len(more)


class ChunkEncoder:
    """A tokenizer with a memo: each known chunk has a number, its ids lie in one array."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cuts = _cuts(spec)
        if self.cuts:
            self._glue(spec)
        self._forget()

    def _glue(self, spec: dict):
        """How chunks are told apart that are encoded in one call: by a special string between them, which cuts a text before all
        else, or where words' last ids are known by a suffix, by a blank between plain words."""
        import numpy as np

        vocabulary, suffix = self.tokenizer.get_vocab(), spec["model"].get("end_of_word_suffix")
        special = next((x for x in spec.get("added_tokens", []) if x.get("special") and not x["normalized"] and not x["single_word"]), None)
        self.glue, self.ends, self.words = None, np.zeros(max(vocabulary.values()) + 1, bool), bool(suffix and self.cuts.lower)
        if self.words:
            self.glue = " "
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        elif special:
            self.glue = special["content"]
            self.ends[special["id"]] = True

    def _forget(self):
        self.number: dict[str, int] = {}
        self.held, self.ids, self.starts, self.sizes, self.again = 0, Growing("i4"), Growing("i8"), Growing("i8"), Growing(bool)

    def _thin(self):
        """Keep the chunks that came back since the memo was last thinned, if they are not most of it."""
        import numpy as np

        number, ids, starts, sizes = self.number, self.ids.room, self.starts.room, self.sizes.room
        again = self.again.room.tolist()
        kept = [x for x, i in number.items() if again[i]]
        at = np.fromiter(map(number.__getitem__, kept), np.int64, len(kept))
        self._forget()
        if (held := sum(map(len, kept))) > MEMO_CHARS // 2:
            return
        size = sizes[at]
        upto = np.cumsum(size)
        self._keep(kept, ids[np.arange(int(size.sum())) + np.repeat(starts[at] - upto + size, size)], size, held)

    def _keep(self, chunks: list[str], ids, sizes, held: int):
        import numpy as np

        self.held += held
        self.starts.extend(self.ids.size + np.cumsum(sizes) - sizes)
        self.ids.extend(ids)
        self.sizes.extend(sizes)
        self.again.extend(np.zeros(len(sizes), bool))
        self.number.update(zip(chunks, range(len(self.number), len(self.number) + len(chunks)), strict=True))

    def _library(self, texts: list[str]):
        """Joined ids and the number of ids of each text."""
        import numpy as np

        sizes, ids = [], []
        for a in range(0, len(texts), 4_000):
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts[a:a + 4_000], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.int32, int(sizes[-1].sum())))
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def _encoded(self, chunks: list[str]):
        """The chunks, those first that can be encoded many to a call, their joined ids and the number of ids of each."""
        import numpy as np

        many = list(filter(_PLAIN.fullmatch if self.words else self._unmarked, chunks)) if self.glue else []
        held = set(many) if len(many) < len(chunks) else ()
        rest = [x for x in chunks if x not in held] if len(many) < len(chunks) else []
        (ids, sizes), (more, their) = self._joined(many), self._library(rest)
        return many + rest, np.concatenate([ids, more]), np.concatenate([sizes, their])

    def _unmarked(self, chunk: str) -> bool:
        return "<|" not in chunk

    def _joined(self, chunks: list[str]):
        """The same as _library for chunks that the glue keeps apart."""
        import numpy as np

        tail = "" if self.words else self.glue
        ids, _ = self._library([self.glue.join(chunks[a:a + GLUED]) + tail for a in range(0, len(chunks), GLUED)])
        ends = self.ends[ids]
        sizes = np.diff(np.flatnonzero(ends), prepend=-1)
        if len(sizes) != len(chunks):
            return self._library(chunks)
        return (ids, sizes) if self.words else (ids[~ends], sizes - 1)

    def _numbers(self, texts: list[str]):
        """Numbers of all chunks of the texts, and how many each text has; new chunks are encoded and kept."""
        import numpy as np

        parts = [self.cuts(t) for t in texts]
        flat = list(chain.from_iterable(parts))
        at = np.fromiter(map(self.number.get, flat, repeat(-1)), np.int64, len(flat))
        missed = np.flatnonzero(at < 0)
        self.again.room[at[at >= 0]] = True
        new = list(dict.fromkeys(map(flat.__getitem__, missed.tolist())))
        if self.held + sum(map(len, new)) > MEMO_CHARS:
            self._thin()
            at = np.fromiter(map(self.number.get, flat, repeat(-1)), np.int64, len(flat))
            missed = np.flatnonzero(at < 0)
            new = list(dict.fromkeys(map(flat.__getitem__, missed.tolist())))
        new, ids, sizes = self._encoded(new)
        self._keep(new, ids, sizes, sum(map(len, new)))
        at[missed] = np.fromiter(map(self.number.__getitem__, map(flat.__getitem__, missed.tolist())), np.int64, len(missed))
        return at, np.fromiter(map(len, parts), np.int64, len(parts))

    def slices(self, texts: list[str]):
        """Runs of texts: their joined ids and the number of ids of each."""
        import numpy as np

        for a, b in text_slices(texts):
            if self.cuts is None:
                yield self._library(texts[a:b])
                continue
            at, count = self._numbers(texts[a:b])
            sizes = self.sizes.room[at]
            upto = np.append(0, np.cumsum(sizes))
            yield self.ids.room[np.arange(upto[-1]) + np.repeat(self.starts.room[at] - upto[:-1], sizes)], np.diff(upto[np.append(0, np.cumsum(count))])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        import numpy as np

        out = []
        for ids, sizes in self.slices(texts):
            flat, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(sizes)
            out += [flat[b - n:b] for b, n in zip(ends.tolist(), (4 * sizes).tolist(), strict=True)]
        return out

    def count(self, texts: list[str]) -> list[int]:
        import numpy as np

        out = []
        for a, b in text_slices(texts):
            if self.cuts is None:
                out += self._library(texts[a:b])[1].tolist()
            else:
                at, count = self._numbers(texts[a:b])
                out += np.diff(np.append(0, np.cumsum(self.sizes.room[at]))[np.append(0, np.cumsum(count))]).tolist()
        return out


@kept_for("encoders", 2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder with its memo for each worker process."""
    return ChunkEncoder(path)


class PieceCounter:
    """Counts of the sentencepiece library."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)] if texts else []


@kept_for("encoders", 2)
def counter(path: str):
    return PieceCounter(path) if path.endswith(".model") else encoder(path)


def version_digest(path: str) -> str:
    """Digest of a tokenizer's file together with its library and version."""
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(library.encode() + b"\0" + f.read()).hexdigest()


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
