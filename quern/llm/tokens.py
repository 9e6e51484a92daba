"""Token ids of whole batches of texts: each distinct word of a batch is encoded once."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa

from quern.llm.words import buffer, words

CACHE = 200_000  # words, and parts of words, whose ids a worker remembers; never more, also within a batch
# The pre-tokenizer whose parts are known here: letters, single digits and the rest, but for contractions with "'".
KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile(r"[!-&(-~\xdf-\xf6\xf8-\xff]+")
_PARTS = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


class WordEncoder:
    """For tokenizers that split at white space and drop it, so that a text's ids are those of its words in a row.

    New words are encoded many in one go, and cut apart by their tokens' offsets. Under a lower-casing tokenizer with the known
    pre-tokenizer, words of ASCII and Latin-1 letters are encoded by parts, each new part once; how letters become bytes is
    asked of the tokenizer."""

    _own: dict[str, WordEncoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        contents = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(contents) or r"(?!)")
        self.ids: dict[int, bytes] = {}
        self.parts: dict[str, bytes] = {}
        made = json.loads(self.tokenizer.to_str())
        steps = json.dumps([made["pre_tokenizer"], made["normalizer"]])
        self.by_parts = json.dumps(KNOWN) in steps and '"Lowercase"' in steps and '"ByteLevel"' in steps
        self.letters = {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7} if self.by_parts else {}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One for each worker process."""
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def encode(self, texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and n + 1 offsets of the texts into them."""
        data, offsets = buffer(texts)
        hashes, first, last, at = words(data, offsets)
        keys, place, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.ids) >= CACHE:
            self.ids.clear()
        known = [self.ids.get(k) for k in keys.tolist()]
        new = [i for i, v in enumerate(known) if v is None]
        raw = data.tobytes()
        fresh = [raw[a:b].decode() for a, b in zip(first[place[new]].tolist(), last[place[new]].tolist(), strict=True)]
        for i, k, v in zip(new, keys[new].tolist(), self._words(fresh), strict=True):
            known[i] = v
            if len(self.ids) < CACHE:
                self.ids[k] = v
        if not known:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        sizes = np.array([len(v) for v in known]) // 4
        flat, begin = np.frombuffer(b"".join(known), np.uint32), np.cumsum(sizes) - sizes
        each = sizes[inverse]
        ends = np.cumsum(each)
        out = flat[np.arange(ends[-1]) + np.repeat(begin[inverse] - (ends - each), each)]
        return out, np.concatenate(([0], ends))[at]

    def _words(self, fresh: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(fresh)
        rest, parts, own = [], self.parts, self._part
        special = self.special.search("\n".join(fresh)) is not None
        for i, word in enumerate(fresh):
            if special and self.special.search(word):
                out[i] = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
            elif self.by_parts and _PLAIN.fullmatch(small := word.lower()):
                found = _PARTS.findall(small)
                out[i] = (parts.get(small) or own(small)) if len(found) == 1 else b"".join([parts.get(p) or own(p) for p in found])
            else:
                rest.append(i)
        for a in range(0, len(rest), 1000):
            some = rest[a:a + 1000]
            found = self.tokenizer.encode(" ".join([fresh[i] for i in some]), add_special_tokens=False)
            begin = np.cumsum([0] + [len(fresh[i]) + 1 for i in some])
            cuts = np.searchsorted([o[0] for o in found.offsets], begin)
            ids = np.array(found.ids, np.uint32)
            for i, x, y in zip(some, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                out[i] = ids[x:y].tobytes()
        return out

    def _part(self, part: str) -> bytes:
        made = self.tokenizer.model.tokenize(part if part.isascii() else part.translate(self.letters))
        ids = array("I", [t.id for t in made]).tobytes()
        if len(self.parts) >= CACHE:
            self.parts.clear()
        self.parts[part] = ids
        return ids
