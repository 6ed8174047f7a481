"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens are the beginnings of words, by bytes, and whole words. Each has the log-odds of standing in toxic
rather than clean text, under a Dirichlet prior whose weights are the token's frequency in all documents;
those that are significant both by their occurrences and by the documents that hold them are kept, and a
word scores by its best token. A linear scan gives all maximal scoring segments of a text. Under clean
text the score of its best segment follows an extreme-value law whose scale solves a moment equation over
the word scores of all documents and whose location is fitted on clean training texts; normalised segment
scores are summed for each document and mapped to a probability. Location and mapping are fitted on scores
from models that have not seen the text (nor an equal one).
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangescan.llm.common import bounded_batches, cut, discard, doc_frame, ids_of, raw, sliced, texts_of
from rangescan.llm.decontamination import words_of

#: Labelled rows that the model is fitted on at most; beyond, those with the smallest hashes of their ids.
MAX_TRAIN = 20_000
#: Bytes of a word's beginning at most; documents of the training rows that hold a token at least.
LONGEST, MIN_DOCS = 16, 5
#: Pseudo-counts of the prior; significance that a token's log-odds must reach, by occurrences and by documents.
PRIOR, Z, Z_DOCS = 2_000.0, 3.0, 3.0
#: Cost of every word of a segment; bounds of a token's score.
DRIFT, BOUNDS = 0.25, (-2.0, 8.0)
#: Parts of the training rows; each is scored by a model of the others.
FOLDS = 3
#: Best segment score of a text without any, normalised.
FLOOR = -5.0
EULER = 0.5772156649015329
#: Entries of a task's tables before they are passed on.
_HELD = 100_000


def tokens_of(word: bytes) -> list[bytes]:
    """The beginnings of a word from 2 bytes on, itself among them, and the whole word, marked by a blank."""
    return [word[:k] for k in range(2, min(len(word), LONGEST) + 1)] + [word + b" "]


class Scanner:
    """Finds tokens at the beginnings of words in one pass of an Aho-Corasick automaton."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.whole = np.array([t.endswith(b" ") for t in tokens], bool)
        self.automaton = ahocorasick.Automaton()
        for k, t in enumerate(tokens):
            self.automaton.add_word((b" " + t).decode("latin-1"), k)
        if tokens:
            self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the word, number of the token) of every token found, by word, a word's beginnings by length, the whole word last."""
        if not len(self.sizes) or not words:
            return (np.zeros(0, np.int64),) * 2
        text = b" " + b" ".join(words) + b" "
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text.decode("latin-1"))), np.int64).reshape(-1, 2)
        if not len(found):
            return found[:, 0], found[:, 1]
        blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        return np.searchsorted(blanks, found[:, 0] - self.sizes[found[:, 1]]), found[:, 1]

    def keys(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of the words with tokens: number of the longest beginning and of the whole word, -1 for none."""
        place, token = self.find(words)
        last = np.flatnonzero(np.append(place[1:] != place[:-1], True)[: len(place)])
        whole = self.whole[token[last]]
        before = np.where((last > 0) & (place[last - 1] == place[last]), token[last - 1], -1)
        return np.where(whole, before, token[last]), np.where(whole, token[last], -1)


def _below(token: bytes) -> list[bytes]:
    """The token and its own beginnings; a word with it has them all."""
    return [token] + [token[:k] for k in range(2, len(token))]


@dataclass
class Model:
    #: token -> score with the drift taken off
    score: dict[bytes, float]
    lam: float
    log_k: float
    weights: list[float]

    def segments(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """Maximal scoring segments (start, end, score) of a text, in order; a word scores by its best token."""
        if "_scanner" not in self.__dict__:  # made by each worker, as an automaton is not sent
            self._scores, self._scanner = list(self.score.values()), Scanner(list(self.score))
        best: dict[int, float] = {}
        for place, token in zip(*map(np.ndarray.tolist, self._scanner.find(words)), strict=True):
            best[place] = max(self._scores[token], best.get(place, -math.inf))
        return maximal_segments(list(best.items()), DRIFT)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def features(self, words: list[bytes]) -> list[float]:
        found = self.segments(words)
        if not found:
            return [FLOOR, 0.0, 0.0]
        base = self.log_k + math.log(len(words))
        each = [self.lam * s for _, _, s in found]
        return [max(FLOOR, max(each) - base), math.log1p(sum(x - base for x in each if x > base)), math.log1p(sum(each))]

    def probability(self, words: list[bytes]) -> float:
        """Probability of a toxic text where both classes are as frequent."""
        x = self.weights[0] + sum(w * f for w, f in zip(self.weights[1:], self.features(words), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def maximal_segments(scored: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence in which unlisted places score -drift.

    Linear: a candidate keeps its total before (left) and after (right), and a link to the last earlier
    candidate with a smaller left, so merged candidates are not looked at again.
    """
    lefts: list[float] = []
    rights: list[float] = []
    spans: list[tuple[int, int]] = []
    links: list[int] = []
    total, at = 0.0, 0
    for place, score in scored:
        total -= drift * (place - at)
        at = place + 1
        left, total = total, total + score
        if score <= 0:
            continue
        start, right, j = place, total, len(lefts) - 1
        while True:
            while j >= 0 and lefts[j] >= left:
                j = links[j]
            if j < 0 or rights[j] >= right:
                break
            left, start = lefts[j], spans[j][0]  # the candidate reaches back over all after j
            del lefts[j:], rights[j:], spans[j:], links[j:]
            j = len(lefts) - 1
        lefts.append(left)
        rights.append(right)
        spans.append((start, place + 1))
        links.append(j)
    return [(a, b, r - v) for (a, b), v, r in zip(spans, lefts, rights, strict=True)]


def training_ids(labels: DataFrame, max_rows: int = MAX_TRAIN, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(doc_id, toxic) of the rows that may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out("doc_id"))
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * max_rows / n))
    return rows


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _tallies(batches):
    """Of training rows, for each token and class (2 * fold + toxic): documents and occurrences; the empty token has those of all words."""
    docs: dict[int, Counter] = {}
    counts: dict[int, Counter] = {}

    def out():
        for k, held in docs.items():
            times: Counter = Counter()
            for word, n in counts[k].items():
                if word:
                    for t in tokens_of(word):
                        times[t] += n
                else:
                    times[b""] = n
            keys = list(held)
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield pa.record_batch([pa.array(part, pa.binary()), pa.array([k] * len(part), pa.int32()), *(pa.array([c[t] for t in part], pa.int64()) for c in (held, times))], ["token", "k", "docs", "times"])
        docs.clear()
        counts.clear()

    for batch in sliced(batches):
        for text, toxic, fold in zip(texts_of(batch), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words, k = words_of(text), 2 * fold + (toxic == 1)
            times = Counter(words)
            docs.setdefault(k, Counter()).update({b"", *(t for w in times for t in tokens_of(w))})
            times[b""] = len(words)
            counts.setdefault(k, Counter()).update(times)
        if sum(map(len, docs.values())) > _HELD:
            yield from out()
    yield from out()


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Weights (intercept first) by Newton steps with a small ridge; both classes weigh the same."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[1e-2] * (x.shape[1] - 1)])
    each = np.where(y == 1, 1 / max(1.0, y.sum()), 1 / max(1.0, (1 - y).sum())) * len(y) / 2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (each * (y - p)) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _significance(a, b, n_a, n_b):
    """Of the odds that documents of two classes hold a token (columns or numbers): half a document is added to each count."""
    log, root = (F.log, F.sqrt) if not isinstance(a, (int, float)) else (math.log, math.sqrt)
    a, b, rest_a, rest_b = a + 0.5, b + 0.5, n_a - a + 0.5, n_b - b + 0.5
    return (log(a / rest_a) - log(b / rest_b)) / root(1 / a + 1 / rest_a + 1 / b + 1 / rest_b)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from the training rows of ``labels`` and the token frequencies of all documents.

    What reaches the driver is bounded by ``max_train``: tokens that stand in ``min_docs`` training texts
    and whose documents differ between the classes, and a few numbers for each training row. Null texts
    count as empty. Without rows of both classes, or in an empty table, no token is scored, and every text
    gets the smoothed share of toxic rows.
    """
    spark, frame = docs.sparkSession, doc_frame(docs, id_col, text_col)
    ids = training_ids(labels, max_train, id_col, label_col)
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")  # equal texts in one fold
    train = frame.join(F.broadcast(ids), "doc_id").select("text", "toxic", fold)  # ids: bounded by max_train
    tallies = train.mapInArrow(_tallies, "token binary, k int, docs long, times long")
    kinds = range(2 * FOLDS)
    sums = [F.sum(F.when(F.col("k") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for c in ("docs", "times") for k in kinds]
    tallies = cut(tallies.groupBy("token").agg(*sums), "toxicity-tallies")

    total = tallies.where(F.octet_length("token") == 0).first()
    n_docs, n_times = ([total[f"{c}{k}"] if total else 0 for k in kinds] for c in ("docs", "times"))
    folds = [*range(FOLDS), FOLDS]  # the last model leaves no fold out
    parts = [[[k for k in kinds if k % 2 == toxic and k // 2 != out] for toxic in (1, 0)] for out in folds]
    wanted = F.lit(False)
    for toxic, clean in parts:
        a, b = (sum((F.col(f"docs{k}") for k in ks), F.lit(0)) for ks in (toxic, clean))
        wanted |= (a + b >= min_docs) & (F.abs(_significance(a, b, sum(n_docs[k] for k in toxic), sum(n_docs[k] for k in clean))) >= Z_DOCS)
    rows = tallies.where((F.octet_length("token") > 0) & wanted).orderBy("token").collect()
    discard(tallies)
    chosen = {bytes(r.token): r for r in rows}
    groups, n_all = _background(frame, list(chosen))
    everywhere: Counter = Counter()
    for tokens, n in groups.items():
        for t in tokens:
            everywhere[t] += n

    models = []
    for toxic, clean in parts:
        score = {}
        d1, d0, n1, n0 = (sum(c[k] for k in ks) for c in (n_docs, n_times) for ks in (toxic, clean))
        for t, r in chosen.items() if d1 and d0 and n_all else ():
            a, b, y, c = (sum(r[f"{name}{k}"] for k in ks) for name in ("docs", "times") for ks in (toxic, clean))
            prior = PRIOR * everywhere[t] / n_all
            y, c = y + prior, c + prior
            if a + b < min_docs or not y or not c:
                continue
            delta = math.log(y / (n1 + PRIOR - y)) - math.log(c / (n0 + PRIOR - c))
            by_docs = _significance(a, b, d1, d0)
            if abs(delta) / math.sqrt(1 / y + 1 / c) >= Z and by_docs * math.copysign(1, delta) >= Z_DOCS:
                score[t] = min(max(delta, BOUNDS[0]), BOUNDS[1]) - DRIFT
        model = Model(score, 1.0, 0.0, [0.0, 0.0, 0.0, 0.0])
        by_score: Counter = Counter()
        for tokens, n in groups.items():
            if (s := max((score[t] for t in tokens if t in score), default=None)) is not None:
                by_score[s] += n
        model.lam = _scale(by_score, n_all)
        models.append(model)

    shared = spark.sparkContext.broadcast(models)

    def measured(batches):
        for batch in sliced(batches):
            rows = []
            for text, toxic, fold in zip(texts_of(batch), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words, m = words_of(text), shared.value[fold]
                rows.append((toxic, len(words), [m.lam * s for _, _, s in m.segments(words)]))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([max(r[2], default=0.0) for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["toxic", "n_words", "best", "scores"])

    rows = cut(train.mapInArrow(measured, "toxic int, n_words long, best double, scores array<double>"), "toxicity-scores")
    model = models[-1]
    clean = rows.where("toxic <> 1 and best > 0").agg(F.avg(F.col("best") - F.log("n_words"))).first()[0]
    model.log_k = (clean - EULER) if clean is not None else 0.0
    base = F.lit(model.log_k) + F.log("n_words")
    top = F.when(F.col("best") > 0, F.greatest(F.lit(FLOOR), F.col("best") - base)).otherwise(FLOOR)
    rest = F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.when(s > base, s - base).otherwise(0.0))
    points = rows.select((F.col("toxic") == 1).cast("double").alias("y"), top.alias("top"), F.log1p(F.coalesce(rest, F.lit(0.0))).alias("rest"), F.log1p(F.aggregate("scores", F.lit(0.0), lambda a, s: a + s)).alias("total"))
    points = points.toPandas().to_numpy(dtype=float)  # bounded by max_train
    points = points[np.lexsort(points.T)]
    if len(points) and 0 < points[:, 0].sum() < len(points) and model.score:
        model.weights = _logistic(points[:, 1:], points[:, 0])
    else:
        share = (points[:, 0].sum() + 0.5) / (len(points) + 1) if len(points) else 0.5
        model.weights = [math.log(share / (1 - share)), 0.0, 0.0, 0.0]
    return model


def _background(frame: DataFrame, tokens: list[bytes]) -> tuple[dict[tuple[bytes, ...], int], int]:
    """Words of all documents by the tokens they have, and the number of all words."""
    shared = frame.sparkSession.sparkContext.broadcast(tokens)

    def run(batches):
        scanner, counts, total = Scanner(shared.value), Counter(), 0
        for batch in sliced(batches):
            words = [w for text in texts_of(batch) for w in words_of(text)]
            total += len(words)
            head, whole = scanner.keys(words)
            pairs, n = np.unique(head * (len(scanner.sizes) + 1) + whole, return_counts=True)
            counts.update(dict(zip(pairs.tolist(), n.tolist(), strict=True)))
        keys = np.array(list(counts), np.int64)
        head = (keys + 1) // (len(scanner.sizes) + 1)  # the other number lies between -1 and the last token
        cols = [head, keys - head * (len(scanner.sizes) + 1), np.array(list(counts.values()), np.int64)]
        yield pa.record_batch([pa.array(np.append(c, x)) for c, x in zip(cols, (-2, -2, total), strict=True)], ["head", "whole", "n"])

    rows = frame.select("text").mapInArrow(run, "head long, whole long, n long").groupBy("head", "whole").agg(F.sum("n").alias("n")).collect()
    known, groups, total = set(tokens), {}, 0
    for r in rows:  # at most two for each token
        if r.head == -2:
            total = r.n
        else:
            both = [t for k in (r.head, r.whole) if k >= 0 for t in _below(tokens[k])]
            groups[tuple(sorted(known.intersection(both)))] = r.n
    return groups, total


def _scale(counts: dict[float, int], n: int) -> float:
    """Positive root of: mean of exp(lam * score) over all words = 1; 1 if there is none. Words without a token score -DRIFT."""
    if not n or not any(s > 0 for s in counts):
        return 1.0
    order = sorted(counts)
    s = np.array([*order, -DRIFT])
    p = np.array([counts[x] for x in order] + [0.0])
    p[-1] = n - p.sum()
    p /= n
    if p @ s >= 0:
        return 0.1
    low, high = 0.0, 5.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if p @ np.exp(mid * s) < 1 else (low, mid)
    return max(low, 1e-3)


def toxicity_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_segments: bool = False) -> DataFrame:
    """(doc_id, score[, segments: start, end, score, e_value]) for every row; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    segment = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())])

    def run(batches):
        m = shared.value
        for batch in sliced(batches):
            scores, found = [], []
            for text in texts_of(batch):
                words = words_of(text)
                scores.append(m.probability(words))
                if with_segments:
                    base = m.log_k + math.log(len(words) or 1)
                    found.append([{"start": a, "end": b, "score": s, "e_value": math.exp(min(700.0, base - m.lam * s))} for a, b, s in m.segments(words)])
            cols = [ids_of(batch), pa.array(scores, pa.float64())]
            yield pa.record_batch(cols + [pa.array(found, pa.list_(segment))] * with_segments, ["doc_id", "score"] + ["segments"] * with_segments)

    schema = "doc_id long, score double" + ", segments array<struct<start: long, end: long, score: double, e_value: double>>" * with_segments
    return doc_frame(docs, id_col, text_col).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns stay as they are.

    Null texts count as empty and score what an empty text does. Rows that repeat have one fate; an empty
    table stays empty; columns may have any names.
    """
    bounded_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in sliced(batches, text_col):
            yield batch.filter(pa.array([shared.value.probability(words_of(t)) < threshold for t in raw(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
