"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton recognises every run of words of every item. Documents stream through it and only the
length of the longest match that ends at the present word is kept; from that length and the state
follow all windows that end there. Benchmarks are the stated query set: their items go to every task,
cut into automata of a bounded number of words.
"""

from __future__ import annotations

from array import array
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangescan.llm.common import bounded_batches, doc_frame, ids_of, sliced, texts_of

#: Words of a benchmark that one automaton holds (about 100 bytes a word); more words take more automata.
BLOCK_WORDS = 1_000_000
#: A-Z to a-z; every other ASCII byte but 0-9 and a-z to a space.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return text.translate(WORD_TABLE).split()


class Automaton:
    """Generalised suffix automaton of items; items shorter than ``window`` words count only as a whole."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.names = [name for name, _ in items]
        self.vocab: dict[bytes, int] = {}
        self.shortest = min((min(len(w), window) for _, w in items), default=window)
        step: list[dict[int, int]] = [{}]
        link, length = array("q", [-1]), array("q", [0])
        ends: list[tuple[int, int, int]] = []  # (state of a prefix, item, words in the prefix)
        for k, (_, words) in enumerate(items):
            last = 0
            for n, word in enumerate(words, 1):
                last = self._extend(step, link, length, last, self.vocab.setdefault(word, len(self.vocab)))
                ends.append((last, k, n))
        self.step, self.link, self.length = step, link, length
        #: state that stands for a run of ``window`` words -> items with it
        hold: dict[int, set[int]] = defaultdict(set)
        #: state -> short items, as (words, item), that end there as a whole
        whole: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for state, k, n in ends:
            if n >= window:
                while length[link[state]] >= window:
                    state = link[state]
                hold[state].add(k)
            elif n == len(items[k][1]):
                whole[state].append((n, k))
        self.hold = {s: frozenset(v) for s, v in hold.items()}
        #: state -> nearest state on its suffix path, itself included, where a short item ends; -1 if none
        self.near = array("q", [-1]) * len(length)
        for s in sorted(range(len(length)), key=length.__getitem__):
            self.near[s] = s if s in whole else (self.near[link[s]] if s else -1)
        self.whole = dict(whole)

    @staticmethod
    def _copy(step, link, length, p: int, q: int, word: int) -> int:
        """Split q so that a state of length(p) + 1 exists; returns it."""
        twin = len(length)
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and step[p].get(word) == q:
            step[p][word] = twin
            p = link[p]
        link[q] = twin
        return twin

    @classmethod
    def _extend(cls, step, link, length, last: int, word: int) -> int:
        if (q := step[last].get(word)) is not None:  # the prefix is already a run of an earlier item
            return q if length[q] == length[last] + 1 else cls._copy(step, link, length, last, q, word)
        new = len(length)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if p >= 0:
            q = step[p][word]
            link[new] = q if length[q] == length[p] + 1 else cls._copy(step, link, length, p, q, word)
        return new

    def hits(self, ids: list[int | None]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [start, end) of windows in a document, by word, and the items they come from."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        n, i, need = len(ids), 0, self.shortest
        while i < n:
            if ids[i] is None:
                i += 1
                continue
            j = i + 1
            while j < n and ids[j] is not None:
                j += 1
            if j - i >= need:  # shorter runs of known words hold no window
                self._scan(ids, i, j, spans, found)
            i = j
        return spans, found

    def _scan(self, ids, i: int, j: int, spans, found) -> None:
        step, link, length, window, near = self.step, self.link, self.length, self.window, self.near
        state = run = 0
        for at in range(i, j):
            word = ids[at]
            while state and word not in step[state]:
                state = link[state]
                run = length[state]
            if word in step[state]:
                state = step[state][word]
                run += 1
            if run >= window:
                top = state
                while length[link[top]] >= window:
                    top = link[top]
                if top in self.hold:
                    spans.append((at + 1 - window, at + 1))
                    found |= self.hold[top]
            s = near[state]
            while s > 0:
                for size, k in self.whole[s]:
                    if size <= run:
                        spans.append((at + 1 - size, at + 1))
                        found.add(k)
                s = near[link[s]]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans of the same words, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def automata(benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS, item_col: str = "item_id", text_col: str = "text") -> list[Automaton]:
    """Automata of the benchmark, each of at most ``block_words`` words (or one item). Items without words are left out."""
    blocks: list[Automaton] = []
    items: list[tuple[str, list[bytes]]] = []
    size = 0
    for r in benchmark.select(F.col(f"`{item_col}`").cast("string"), F.col(f"`{text_col}`")).toLocalIterator():
        words = words_of((r[1] or "").encode())
        if words:
            if items and size + len(words) > block_words:
                blocks.append(Automaton(items, window))
                items, size = [], 0
            items.append(("" if r[0] is None else r[0], words))
            size += len(words)
    return [*blocks, Automaton(items, window)] if items else blocks


def _hits(blocks: list[Automaton], words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    spans, names = [], set()
    for auto in blocks:
        s, found = auto.hits(list(map(auto.vocab.get, words)))
        spans += s
        names.update(auto.names[k] for k in found)
    return merged(spans), names


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_hit, n_items, items (sorted ids), spans (word offsets), contaminated.

    Null and empty texts have no words; repeated rows stay; an empty benchmark hits nothing; items that
    repeat an id count once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automata(benchmark, window, block_words))

    def run(batches):
        blocks = shared.value
        for batch in sliced(batches):
            rows = []
            for text in texts_of(batch):
                words = words_of(text)
                spans, names = _hits(blocks, words)
                rows.append((len(words), sum(b - a for a, b in spans), len(names), sorted(names), [x for s in spans for x in s], bool(spans)))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.bool_()))]
            yield pa.record_batch([ids_of(batch), *cols], ["doc_id", "n_words", "n_hit", "n_items", "items", "spans", "contaminated"])

    return doc_frame(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items array<string>, spans array<long>, contaminated boolean")


def items_digest(items):
    """SHA-256 of sorted item ids, comma-joined."""
    return F.sha2(F.array_join(items, ","), 256)


def _word_spans(text: bytes) -> list[tuple[int, int]]:
    """Byte offsets of the words of a text."""
    flat, out, at = text.translate(WORD_TABLE), [], 0
    for w in flat.split():
        at = flat.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


def _cleaned(blocks: list[Automaton], text: bytes, max_coverage: float) -> bytes | None:
    """The text without benchmark windows; None if they cover more than the limit."""
    words = words_of(text)
    spans, _ = _hits(blocks, words)
    if spans and sum(b - a for a, b in spans) > max_coverage * len(words):
        return None
    while spans:
        places = _word_spans(text)
        parts, at = [], 0
        for a, b in spans:
            parts.append(text[at : places[a][0]])
            at = places[b - 1][1]
        text = b" ".join([*parts, text[at:]])
        spans, _ = _hits(blocks, words_of(text))  # what a cut brings together may be a window again
    return text


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS, text_col: str = "text") -> DataFrame:
    """``docs`` with every benchmark window cut out of its texts; rows covered beyond ``max_coverage`` go.

    Columns stay as they are; texts without a window are returned unchanged, null texts stay null.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(automata(benchmark, window, block_words))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in sliced(batches, text_col):
            old = batch.column(at).cast(pa.binary()).to_pylist()
            new = [t if t is None else _cleaned(shared.value, t, max_coverage) for t in old]
            keep = pa.array([t is None or n is not None for t, n in zip(old, new, strict=True)], pa.bool_())
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, pa.binary()).cast(batch.schema.field(at).type)).filter(keep)

    return docs.mapInArrow(run, docs.schema)

