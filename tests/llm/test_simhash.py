import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from rangescan.llm import similar_sets
from rangescan.llm.components import components
from rangescan.llm.simhash import LIST, SET_BYTES, WIDE_BITS, _near, _spanning_tree, fingerprint, keep_one_per_class, link_fingerprints, position_sets, similar_classes, simhash_classes
from rangescan.llm.similar_sets import links_between


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def classes(fps, bits=2):
    """Smallest id of each row's class; ids None are skipped as members that could be smallest."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= bits:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(fps))]


def signed(x):
    return int(np.array([x], np.uint64).view(np.int64)[0])


def check(df, got):
    rows = [(r.doc_id, plain(r.text)) for r in df.collect()]
    want = Counter((d, signed(f), c) for (d, f), c in zip(rows, classes(rows), strict=True))
    assert Counter(map(tuple, got.collect())) == want


def test_documents(docs):
    check(docs, simhash_classes(docs))


def test_odd_rows(odd, none):
    check(odd, simhash_classes(odd))
    assert simhash_classes(none).count() == 0
    assert fingerprint(b"") == 0 == fingerprint(b" \n")


def test_lists_long_and_short_find_the_same(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(5)]
    fps = sorted({b ^ (rng.getrandbits(16) & rng.getrandbits(16)) for b in base for _ in range(150)} | {0, 1, 2**63})
    x = np.array(fps, np.uint64)
    pairs = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2}
    group = np.array([f for f in fps if f >> 16 == base[0] >> 16], np.uint64)
    assert {tuple(sorted(p)) for p in zip(*map(np.ndarray.tolist, _near(group, 2)), strict=True)} == {(i, j) for i in range(len(group)) for j in range(i + 1, len(group)) if int(group[i] ^ group[j]).bit_count() <= 2}
    df = spark.createDataFrame([(signed(f), k) for k, f in enumerate(fps)], "fp long, rep long")
    links = {tuple(sorted(map(int, r))) for r in link_fingerprints(df).collect()}
    assert links <= pairs
    want = classes([(k, f) for k, f in enumerate(fps)])
    tree = {r.child: r.parent for r in components(link_fingerprints(df)).collect()}
    assert [tree.get(k, k) for k in range(len(fps))] == want and len(x) == len(fps)


def similar(rows, size=5, least=0.8):
    """Smallest id of the class of each (id, text), all pairs compared by their shingles."""
    texts = [tuple(lower(t).encode().split()) for _, t in rows]
    grams = {w: {w[i : i + size] for i in range(max(1, len(w) - size + 1))} for w in set(texts)}
    names = list(grams)
    low = {w: min((d for (d, _), x in zip(rows, texts, strict=True) if x == w and d is not None), default=None) for w in names}
    joined = {w: w for w in names}

    def find(w):
        while joined[w] != w:
            w = joined[w]
        return w

    for i, v in enumerate(names):
        for w in names[:i]:
            if None not in (low[v], low[w]) and len(grams[v] & grams[w]) >= least * len(grams[v] | grams[w]):
                joined[find(v)] = find(w)
    best = {}
    for w in names:
        if low[w] is not None:
            best[find(w)] = min(low[w], best.get(find(w), low[w]))
    return [best.get(find(w)) for w in texts]


def test_similar_texts(docs, odd, none):
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        want = Counter(zip([d for d, _ in rows], similar(rows), strict=True))
        assert Counter(map(tuple, similar_classes(df).collect())) == want
    assert similar_classes(none).count() == 0


def test_planted_near_copies_are_found(spark):
    """Copies with edits near the bound, a large group of variants, and clean texts of common words."""
    rng = random.Random(11)
    word = lambda: rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < 0.3 else f"w{rng.randrange(4000)}"
    rows, clean = [], []
    for _ in range(60):
        base = [word() for _ in range(rng.randint(80, 400))]
        rows.append((len(rows), " ".join(base)))
        edits = set(rng.sample(range(len(base)), max(1, len(base) // 60)))
        rows.append((len(rows), " ".join(f"e{rng.random()}" if i in edits else w for i, w in enumerate(base))))
    base = [word() for _ in range(300)]
    for _ in range(200):
        rows.append((len(rows), " ".join(f"e{rng.random()}" if rng.random() < 0.005 else w for w in base)))
    for _ in range(100):
        clean.append(len(rows))
        rows.append((len(rows), " ".join(word() for _ in range(200))))
    got = {r.doc_id: r.component_id for r in similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = dict(zip([d for d, _ in rows], similar(rows), strict=True))
    assert all(got[d] == d for d in clean)
    assert sum(got[d] == want[d] for d in got) >= 0.99 * len(got) and all(got[d] in (want[d], d) or want[got[d]] == want[d] for d in got)


def test_groups_of_variants_have_their_true_classes(spark):
    """250 variants of a text each, of which few pairs are similar, and short texts with a word more."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for share in (0.012, 0.02):
        base = [word() for _ in range(200)]
        for _ in range(250):
            own = share * rng.random() * 3
            rows.append((len(rows), " ".join(f"e{rng.randrange(10**6)}" if rng.random() < own else w for w in base)))
    for _ in range(120):  # 9 to 16 words: one word more leaves a similarity of 0.8 or more
        base = [word() for _ in range(rng.randint(9, 16))]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base, word()]))]
    base = [word() for _ in range(300)]  # the same words in another order: same fingerprint, not similar
    for _ in range(40):
        rows.append((len(rows), " ".join(base)))
        base = base[150:] + base[:100] + rng.sample(base[100:150], 50)
    rows += [(len(rows) + k, " ".join([*(word() for _ in range(40)), *base])) for k in range(60)]  # a passage that many share
    got = {r.doc_id: r.component_id for r in similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d] for d, _ in rows] == similar(rows)


@pytest.mark.parametrize("table", [False, True])
def test_links_are_found_without_any_candidates(spark, monkeypatch, table):
    """Every text its own class: small blocks, long lists over several tasks, and any order of the shingles."""
    rng, low = random.Random(6), np.random.default_rng(1).random(1 << similar_sets.BITS) < 0.5
    if table:
        monkeypatch.setattr(similar_sets, "_frequent", lambda texts, shingle: low)
    base = [f"w{k}" for k in range(60)]
    rows = [(d, " ".join(f"e{rng.randrange(99)}" if rng.random() < 0.02 else w for w in base[: rng.randint(40, 60)])) for d in range(120)]
    rows += [(120 + d, " ".join(rng.choices("abcdef", k=rng.randint(0, 9)))) for d in range(80)]
    want = similar(rows)
    classes = [(d, c % 9, 30, t) for (d, t), c in zip(rows, range(len(rows)), strict=True)]  # classes that mean nothing
    links = links_between(spark.createDataFrame([(d, d, 1, t) for d, t in rows], "rep long, class long, size long, text string"), 5, 0.8, 7, 500)
    tree = {r.child: r.parent for r in components(links).collect()}
    assert all(tree.get(d, d) == c for (d, _), c in zip(rows, want, strict=True))
    grams = {d: set(similar_sets.grams_of(t.encode(), 5).tolist()) for d, t in rows}
    for r in links_between(spark.createDataFrame(classes, "rep long, class long, size long, text string"), 5, 0.8, 7, 500).collect():
        assert len(grams[r.a] & grams[r.b]) >= 0.8 * len(grams[r.a] | grams[r.b]) and r.a % 9 != r.b % 9


def test_trees_span_what_is_near():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, (3, 4), dtype=np.uint64)
    fps = np.array([b ^ (np.uint64(1) << rng.integers(0, 63, 4, dtype=np.uint64)) for b in base for _ in range(20)])
    tree = _spanning_tree(fps)
    assert len(tree) == 57 and all(a // 20 == b // 20 for a, b in tree)
    assert len(set(position_sets())) == len(position_sets()) and all(len(s) == SET_BYTES for s in position_sets()) and SET_BYTES == 32 - WIDE_BITS and LIST > 1


def test_one_row_of_each_class_stays(docs, odd):
    kept = keep_one_per_class(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(similar(rows)))
    assert keep_one_per_class(odd).columns == odd.columns


def test_texts_stay_where_they_are_and_no_shingles_are_written(spark, docs, monkeypatch):
    """Of near-dedup's disk, most was texts moved for the last join and a table of all shingles, larger than the texts."""
    written = []
    monkeypatch.setattr(similar_sets.Scratch, "cut", lambda self, df, label, kept=similar_sets.Scratch.cut: written.append((label, df.schema)) or kept(self, df, label))
    rows = spark.createDataFrame([(d, f"{'same words again ' * (d % 3)}a b c d e f g h i j k l m n o p {d}") for d in range(60)], "rep long, text string")
    links_between(rows.selectExpr("rep", "rep as class", "1L as size", "text"), 5, 0.8)
    assert written and not any("array" in f.dataType.simpleString() for _, schema in written for f in schema)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = keep_one_per_class(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_components_of_a_chain_a_star_and_loops(spark):
    n = 60
    pairs = [(k, k + 1) for k in range(n)] + [(1000, 1001 + k) for k in range(50)] + [(5, 5), (None, 3), (2000, 2001), (2001, 2000)]
    got = {r.child: r.parent for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, n + 1)} | {1001 + k: 1000 for k in range(50)} | {2001: 2000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
