"""Token ids of whole texts by the tokenizers library, with a bounded cache of white-space separated chunks.

The vocabulary's pre-tokenizer drops white space and none of its patterns reaches across it, its
normaliser changes characters one neighbourhood at a time, and its special strings hold no white
space. So the ids of a text are the ids of its chunks in order, and each distinct chunk goes through
the library once per worker (until the cache is emptied). ``chunked`` says whether a tokenizer file
allows this; other files are encoded text by text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

import numpy as np

#: Chunks in each of the two generations of a worker's cache: about 200 bytes each.
CACHE_CHUNKS = 200_000
#: Words that go through the library as one text.
WORDS_AT_ONCE = 1_000
_encoders: dict[str, Encoder] = {}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.chunked = _drops_space(spec)
        self.special = [x["content"].encode() for x in spec.get("added_tokens") or []]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        vocabulary = spec["model"]["vocab"]
        #: by id: is it the last of a word
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        if self.chunked and suffix:
            self.ends[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True
        #: chunk -> its ids as little-endian unsigned 32-bit integers; what stood in the cache before it was last emptied
        self.cache: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> Iterable[list[int]]:
        batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return (x.ids for x in batch(texts, add_special_tokens=False))

    def id_bytes(self, texts: list[bytes]) -> list[bytes]:
        """For each text its ids, 4 bytes each."""
        if not self.chunked:
            return [np.asarray(x, dtype="<u4").tobytes() for x in self._encode([t.decode("utf-8") for t in texts])]
        out = []
        for text in texts:
            # the normaliser lower-cases anyway; texts with a special string keep their letters
            chunks = (text if any(s[:2] in text for s in self.special) else text.lower()).split()
            found = list(map(self.cache.get, chunks))
            if None in found:
                self._learn({c for c, x in zip(chunks, found, strict=True) if x is None})
                found = list(map(self.cache.__getitem__, chunks))
            out.append(b"".join(found))
            if len(self.cache) > CACHE_CHUNKS:
                self.cache, self.before = {}, self.cache
        return out

    def _learn(self, chunks: set[bytes]) -> None:
        """Put the ids of chunks into the cache. A last full stop or comma after a letter or digit is a token by itself."""
        cut = []
        for c in chunks:
            if (x := self.before.get(c)) is not None:
                self.cache[c] = x
            elif len(c) > 1 and c[-1:] in b".," and chr(c[-2]).isalnum() and c[-2] < 128:
                cut.append(c)
            else:
                self.cache[c] = b""
        new = [c for c in chunks if self.cache.get(c) == b""]
        for c in cut:
            for part in (c[:-1], c[-1:]):
                if part not in self.cache:
                    if (x := self.before.get(part)) is not None:
                        self.cache[part] = x
                    else:
                        self.cache[part] = b""
                        new.append(part)
        words, rest = [], []
        for c in new:
            (words if (s := c.decode("utf-8")).isalpha() else rest).append(s)
        for k in range(0, len(words), WORDS_AT_ONCE):
            self._learn_words(words[k : k + WORDS_AT_ONCE])
        for s, ids in zip(rest, self._encode(rest), strict=True):
            self.cache[s.encode()] = np.asarray(ids, dtype="<u4").tobytes()
        for c in cut:
            self.cache[c] = self.cache[c[:-1]] + self.cache[c[-1:]]

    def _learn_words(self, words: list[str]) -> None:
        """Words of letters alone, encoded as one text and parted where a token ends a word."""
        (ids,) = self._encode([" ".join(words)])
        ids = np.asarray(ids, dtype="<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):  # a letter that the normaliser turns into more than a letter
            for s, one in zip(words, self._encode(words), strict=True):
                self.cache[s.encode()] = np.asarray(one, dtype="<u4").tobytes()
            return
        data, at = ids.tobytes(), 0
        for s, stop in zip(words, (4 * stops).tolist(), strict=True):
            self.cache[s.encode()] = data[at:stop]
            at = stop


def _drops_space(spec: dict) -> bool:
    """True if chunks between ASCII white space are encoded independently of each other."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1]["pattern"] == {"Regex": r"\s+"}
        and steps[1]["content"] == " "
        and split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and split.get("invert") is True
        and split["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and not any(x["lstrip"] or x["rstrip"] or x["normalized"] or x["single_word"] or any(c.isspace() for c in x["content"]) for x in spec.get("added_tokens") or [])
    )


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file; loaded once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
