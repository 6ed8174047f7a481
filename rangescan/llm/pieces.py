"""SentencePiece BPE by backtracking over longest matches.

A segmentation is the one that merging would give exactly when merging each two neighbours again gives
these neighbours. So the encoder goes from left to right, takes the longest piece that an Aho-Corasick
automaton finds at a place, checks it against the piece before by merging both again (each pair once
per worker), and otherwise tries the next shorter one; a bitfield of places from which no segmentation
was found keeps the search linear. Pieces that merging their own letters never gives are left out.

Texts are cut before the first white-space mark of a run, at characters outside the vocabulary, and
between two characters that no piece has side by side; no merge can reach across such a place.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rangescan.llm.common import doc_frame, ids_of, sliced, texts_of

SPACE = "▁"
#: Chunks a worker keeps before it starts anew: about 250 bytes each.
CACHE_CHUNKS = 400_000
_models: dict[str, PieceModel] = {}


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        kinds = type(proto).SentencePiece
        if train.model_type != train.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or not train.byte_fallback or train.treat_whitespace_as_suffix or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("only BPE models with identity normalisation, dummy prefix and byte fallback are read")
        self.bos, self.eos, self.unk = train.bos_id, train.eos_id, train.unk_id
        self.piece: dict[str, int] = {}
        self.score: list[float] = []
        #: bytes that an id stands for in a decoded text
        self.out: list[bytes] = []
        self.byte_id = [0] * 256
        for k, p in enumerate(proto.pieces):
            self.score.append(p.score)
            if p.type == kinds.NORMAL:
                self.piece[p.piece] = k
                self.out.append(p.piece.replace(SPACE, " ").encode())
            elif p.type == kinds.BYTE:
                value = int(p.piece[3:-1], 16)
                self.byte_id[value] = k
                self.out.append(bytes([value]))
            else:
                self.out.append(train.unk_surface.encode() if p.type == kinds.UNKNOWN else b"")
        self.letters = {c for p in self.piece for c in p}
        self.pairs = {p[i : i + 2] for p in self.piece for i in range(len(p) - 1)}
        self.find = ahocorasick.Automaton()
        self.text: dict[int, str] = {}
        for p, k in self.piece.items():
            if len(p) == 1 or self._merge(p) == [k]:
                self.find.add_word(p, (len(p), k))
                self.text[k] = p
        self.find.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}
        # "word." and "word," are the commonest ends of a chunk: cut there if no piece reaches across
        lone = "".join(c for c in ".,;:!?%&#$*|" if not any(x + c in self.pairs for x in self.letters if x.isalpha()))
        self.joint = re.compile(rf"(?<=[^\W\d_])(?=[{re.escape(lone)}])|(?<=\n)|(?=\n)" if lone else r"(?<=\n)|(?=\n)")

    def _merge(self, text: str) -> list[int]:
        """Ids by merging: the pair with the best score first, the leftmost of equals."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts):
                both = parts[i] + parts[j]
                if (k := self.piece.get(both)) is not None:
                    heapq.heappush(heap, (-self.score[k], i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or j >= len(parts) or parts[j] is None or parts[i] + parts[j] != both or after[i] != j:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [self.piece.get(p, -1) for p in parts if p is not None]

    def _compatible(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            known = self.fits[key] = self._merge(self.text[a] + self.text[b]) == [a, b]
        return known

    def _backtrack(self, text: str) -> list[int]:
        """Ids of a run of known characters."""
        if (k := self.piece.get(text)) in self.text:
            return [k]
        starts: list[list[tuple[int, int]]] = [[] for _ in text]  # by place: (length, id), shortest first
        for end, (size, k) in self.find.iter(text):
            starts[end - size + 1].append((size, k))
        for found in starts:
            found.sort()
        failed = bytearray(len(text) + 1)
        ids: list[int] = []
        at, tries = 0, [len(starts[0])]
        while at < len(text):
            while tries[-1]:
                tries[-1] -= 1
                size, k = starts[at][tries[-1]]
                if not failed[at + size] and (not ids or self._compatible(ids[-1], k)):
                    ids.append(k)
                    at += size
                    tries.append(len(starts[at]) if at < len(text) else 0)
                    break
            else:
                if not ids:
                    return self._merge(text)  # not reached for a vocabulary that holds its own letters
                failed[at] = 1
                tries.pop()
                at -= len(self.text[ids.pop()])
        return ids

    def _run(self, text: str) -> bytes:
        """Ids of a chunk, 4 bytes each: known runs by backtracking, other characters by their bytes."""
        ids: list[int] = []
        at = 0
        for i, c in enumerate(text):
            if c not in self.letters:
                if i > at:
                    ids += self._backtrack(text[at:i])
                ids += [self.byte_id[b] for b in c.encode()]
                at = i + 1
        if at < len(text):
            ids += self._backtrack(text[at:])
        return np.array(ids, "<u4").tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text without begin and end, 4 bytes each."""
        if not text:
            return b""
        marked = SPACE + text.replace(" ", SPACE)
        chunks = (SPACE + w for w in marked[1:].split(SPACE)) if SPACE * 2 not in marked else re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", marked)
        chunks = list(chunks)
        get = self.cache.get
        found = list(map(get, chunks))
        if None in found:
            for c in {c for c, x in zip(chunks, found, strict=True) if x is None}:
                parts = self.joint.split(c)
                self.cache[c] = b"".join(map(self._part, parts)) if len(parts) > 1 else self._run(c)
            found = list(map(get, chunks))
        if len(self.cache) > CACHE_CHUNKS:
            self.cache = {}
        return b"".join(found)

    def _part(self, part: str) -> bytes:
        """Ids of a piece of a chunk; parts are kept too, as many chunks share them."""
        known = self.cache.get(part)
        if known is None:
            known = self.cache[part] = self._run(part)
        return known

    def encode(self, text: str) -> list[int]:
        return [self.bos, *np.frombuffer(self.encode_bytes(text), "<u4").tolist(), self.eos]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """UTF-8 of the decoded text; the blank of the dummy prefix goes."""
        text = b"".join(map(self.out.__getitem__, ids))
        return text[1:] if text[:1] == b" " else text

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def model(path: str) -> PieceModel:
    """The worker's model of a file; loaded once."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) for every row, begin and end ids included.

    Null texts count as empty and give begin and end alone. Repeated rows stay, null ids stay null, an
    empty table gives an empty table.
    """

    def run(batches):
        m = model(path)
        first, last = np.array([m.bos], "<u4").tobytes(), np.array([m.eos], "<u4").tobytes()
        for batch in sliced(batches):
            n, shas, back, kept, texts = [], [], [], [], []
            for text in texts_of(batch):
                ids = first + m.encode_bytes(text.decode("utf-8")) + last
                numbers = np.frombuffer(ids, "<u4").tolist()
                decoded = m.decode_bytes(numbers)
                n.append(len(numbers))
                shas.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    kept.append(numbers)
                    texts.append(decoded.decode("utf-8", "replace"))
            cols = [ids_of(batch), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(kept, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.record_batch(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return doc_frame(docs, id_col, text_col).mapInArrow(run, schema)
