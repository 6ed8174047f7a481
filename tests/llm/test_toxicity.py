import random
import zlib

import pytest

from rangescan.llm.toxicity import DRIFT, LONGEST, Model, Scanner, _below, drop_toxic, fit, held_out, maximal_segments, tokens_of, toxicity_scores


def plain(scores):
    """Maximal segments by their definition: the best one, then the rest on either side of it."""

    def best(lo, hi):
        found = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > 1e-12 and (found is None or total > found[0] + 1e-9):
                    found = (total, i, j + 1)
        if not found:
            return []
        _, a, b = found
        return [*best(lo, a), (a, b), *best(b, hi)]

    return best(0, len(scores))


def test_segments_follow_their_definition():
    rng = random.Random(0)
    for _ in range(400):
        n = rng.randint(1, 25)
        listed = [(i, rng.uniform(-3, 5)) for i in range(n) if rng.random() < 0.4]
        scores = [-0.7] * n
        for i, x in listed:
            scores[i] = x
        got = maximal_segments(listed, 0.7)
        assert [(a, b) for a, b, _ in got] == plain(scores)
        assert [s for *_, s in got] == pytest.approx([sum(scores[a:b]) for a, b, _ in got])
    assert maximal_segments([], DRIFT) == []


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for d in range(600):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(20, 200))]
        toxic = d % 4 == 0
        for _ in range(8 if toxic else rng.random() < 0.1):
            words.insert(rng.randrange(len(words)), rng.choice(["Vile", "rotten", "nasty"]))
        rows.append((d, " ".join(words), "x"))
        labels.append((d, int(toxic), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_held_out_rows_are_told_apart(planted):
    docs, labels = planted
    rows = toxicity_scores(docs, fit(docs, labels)).select("doc_id", held_out("doc_id").alias("h"), "score").collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    out = [(truth[r.doc_id], r.score >= 0.7) for r in rows if r.h]
    assert len(out) > 100 and sum(a == b for a, b in out) / len(out) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_labels_are_not_learnt(planted):
    docs, labels = planted
    other = labels.withColumn("toxic", (1 - labels.toxic).cast("int")).where(held_out("doc_id")).union(labels.where(~held_out("doc_id")).select("doc_id", "toxic", "quality"))
    assert fit(docs, labels) == fit(docs, other.select("doc_id", "toxic"))


def test_real_documents(spark, docs, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity_scores(docs, model).select("doc_id", held_out("doc_id").alias("h"), "score").collect()
    out = [(truth[r.doc_id], r.score >= 0.7) for r in rows if r.h and r.doc_id in truth]
    assert sum(a == b for a, b in out) / len(out) > 0.85
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in rows if r.score < 0.7)


@pytest.mark.parametrize(("sf", "least", "least_lang"), [("0.01", 0.8, 0.0), ("0.1", 0.9, 0.9)])
def test_toxic_documents_are_found_in_every_language(spark, sf, least, least_lang):
    """Recall on held-out rows at the score below which 9 of 10 clean ones lie, and what 0.7 keeps and catches."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf{sf}/{t}.parquet") for t in ("documents", "labels"))
    lang, truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}, {r.doc_id: r.toxic for r in labels.collect()}
    rows = [(truth[r.doc_id], r.score, lang[r.doc_id]) for r in toxicity_scores(docs, fit(docs, labels)).where(held_out("doc_id")).collect() if r.doc_id in truth]

    def recall(part):
        clean = sorted(s for t, s, _ in part if not t)
        at = clean[int(0.9 * len(clean))]
        return sum(s > at for t, s, _ in part if t) / max(1, sum(t for t, *_ in part))

    assert recall(rows) >= least
    assert all(recall([r for r in rows if r[2] == x]) >= least_lang for x in set(lang.values()))
    assert sum(s < 0.7 for t, s, _ in rows if not t) >= 0.9 * sum(not t for t, *_ in rows)
    assert sum(s >= 0.7 for t, s, _ in rows if t) >= (least - 0.05) * sum(t for t, *_ in rows)


def test_tokens_are_found_where_they_stand():
    rng = random.Random(4)
    words = [bytes(rng.choices(b"ab", k=rng.randint(1, 2 * LONGEST))) for _ in range(300)]
    tokens = rng.sample(sorted({t for w in words for t in tokens_of(w)}), 200)
    scanner = Scanner(tokens)
    want = [(k, t) for k, w in enumerate(words) for t in tokens_of(w) if t in tokens]
    assert [(k, tokens[t]) for k, t in zip(*map(list, scanner.find(words)), strict=True)] == want
    keys = [{t for x in pair if x >= 0 for t in _below(tokens[x])} & set(tokens) for pair in zip(*map(list, scanner.keys(words)), strict=True)]
    each = [{t for p, t in want if p == k} for k in range(len(words))]
    assert keys == [x for x in each if x]
    assert not len(scanner.find([])[0]) and not len(Scanner([]).keys(words)[0])


def test_segments_are_reported(spark):
    model = Model({b"vile ": 6.0 - DRIFT}, 1.0, 0.0, [0.0, 1.0, 0.0, 0.0])
    docs = spark.createDataFrame([(1, "a b vile vile c " + "d " * 60 + "vile"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.segments for r in toxicity_scores(docs, model, with_segments=True).collect()}
    assert [(s.start, s.end) for s in got[1]] == [(2, 4), (65, 66)] and got[1][0].e_value < got[1][1].e_value and got[2] == []


def test_odd_rows(spark, odd, none, planted):
    _, labels = planted
    model = fit(odd, labels)
    assert toxicity_scores(odd, model).count() == odd.count() and drop_toxic(odd, model).columns == odd.columns
    for ls in (labels.where("false"), labels.where("toxic = 1"), spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")):
        assert all(0 <= r.score <= 1 for r in toxicity_scores(odd, fit(odd, ls)).collect())
    assert toxicity_scores(none, fit(none, labels)).count() == 0
