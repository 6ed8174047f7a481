import hashlib
import random
import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from rangescan.llm.decontamination import Automaton, contamination, decontaminate, items_digest, merged, words_of
from tests.llm.test_simhash import lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(lower(text))


def plain(items, words, size=10):
    """Words hit, and the items whose windows occur."""
    windows = defaultdict(set)
    for name, w in items:
        for k in range(max(1, len(w) - size + 1)) if w else []:
            windows[tuple(w[k : k + size])].add(name)
    hit, found = set(), set()
    for n in {len(w) for w in windows}:
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in windows:
                hit.update(range(k, k + n))
                found |= windows[tuple(words[k : k + n])]
    return hit, found


def rows_of(docs, bench, size=10):
    items = [("" if r.item_id is None else str(r.item_id), split(r.text)) for r in bench.collect()]
    for r in docs.collect():
        words = split(r.text)
        hit, found = plain(items, words, size)
        yield r.doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def check(docs, bench, **options):
    got = contamination(docs, bench, **options)
    got = got.select("doc_id", "n_words", "n_hit", "n_items", items_digest("items"), "contaminated")
    want = Counter(rows_of(docs, bench))
    assert Counter(map(tuple, got.collect())) == want
    return want


def test_documents(spark, docs, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert any(r[-1] for r in check(docs, bench))
    check(docs, bench, block_words=60)  # several automata give the same


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "beta Gamma"), (1, "beta gamma"), (2, None), (3, ""), (None, "w5 w6 w7"), (4, " ".join(f"w{k}" for k in range(40))), (5, "漢字")], "item_id long, text string")
    check(odd, bench)
    check(odd, bench.where("false"))
    assert contamination(none, bench).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_automaton_equals_all_windows(data):
    letters, size = [b"a", b"b", b"c"], data.draw(st.integers(1, 5))
    words = st.lists(st.sampled_from(letters), max_size=14)
    items = [(str(k), w) for k, w in enumerate(data.draw(st.lists(words, max_size=5))) if w]
    doc = data.draw(st.lists(st.sampled_from([*letters, b"x"]), max_size=40))
    if not items:
        return
    auto = Automaton(items, size)
    spans, found = auto.hits([auto.vocab.get(w) for w in doc])
    hit, names = plain(items, doc, size)
    assert {k for a, b in spans for k in range(a, b)} == hit and {auto.names[k] for k in found} == names


def test_windows_are_cut_out(spark):
    rng = random.Random(1)
    item = [f"q{k}" for k in range(14)]
    clean = [f"c{rng.randrange(50)}" for _ in range(60)]
    rows = [
        (0, " ".join(clean)), (1, " ".join(clean[:30] + item + clean[30:])), (2, " ".join(item)), (3, None), (4, ""), (5, " ".join(item[:9])),
        (6, " ".join(clean + item[:5] + item[:12] + item[5:] + clean)),  # what the cut leaves is a window again
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as shared")
    bench = spark.createDataFrame([("i", " ".join(item))], "item_id string, text string")
    got = {r.doc_id: r.text for r in decontaminate(docs, bench).collect()}
    assert sorted(got) == [0, 1, 3, 4, 5, 6] and got[0] == rows[0][1] and got[3] is None and got[4] == "" and got[5] == rows[5][1]
    assert not any(r.contaminated for r in contamination(decontaminate(docs, bench), bench).collect())
    assert got[1].split() == clean
    assert decontaminate(docs, bench).columns == docs.columns


def test_words():
    assert words_of("Ab-c9 É_x\x7f'q".encode()) == [w.encode() for w in split("Ab-c9 É_x\x7f'q")]
    assert merged([(3, 5), (0, 2), (2, 3), (9, 10)]) == [(0, 5), (9, 10)]
