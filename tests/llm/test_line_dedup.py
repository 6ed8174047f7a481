import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rangescan.llm import line_dedup
from rangescan.llm.line_dedup import deduplicate_lines, keep_first_lines, line_report


def plain(rows, min_words):
    """{(id, text): (lines, deleted, rest)}: all runs of all lengths in corpus order; rows: (id, digest, text).

    An index by line of earlier places; from each, the longest run that an earlier place begins with too.
    """
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    lines = [(d, t, t.split("\n")) for d, _, t in order]
    gone, earlier = {k: set() for k in range(len(lines))}, defaultdict(list)
    for k, (_, _, x) in enumerate(lines):
        words = [len(y.encode().split()) for y in x]
        for i in range(len(x)):
            for m, j in earlier[x[i]]:
                n, y = 0, lines[m][2]
                while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                    n += 1
                if sum(words[i : i + n]) >= min_words:
                    gone[k].update(range(i, i + n))
            earlier[x[i]].append((k, i))
    return {(d, t): (len(x), len(gone[k]), "\n".join(y for i, y in enumerate(x) if i not in gone[k])) for k, (d, t, x) in enumerate(lines)}


def check(df, min_words):
    rows = [(r.doc_id, r.d, r.text or "") for r in df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("d"), "text").collect()]
    want = plain(rows, min_words)
    got = deduplicate_lines(df, min_words).collect()
    assert Counter((r.doc_id, r._lines, r._deleted, r.text or "") for r in got) == Counter((d, *want[d, t]) for d, _, t in rows)
    assert sum(r.text is None for r in got) == sum(r.text is None for r in df.collect())


def test_documents(docs):
    check(docs, 10)


def test_odd_rows(odd, none):
    check(odd, 3)
    assert deduplicate_lines(none).count() == 0 and line_report(odd).count() == odd.count()
    assert keep_first_lines(odd, 3).columns == odd.columns


@pytest.mark.parametrize("seed", [0, 1])
def test_random_runs_over_many_tasks(spark, seed, monkeypatch):
    """Few different lines: intervals reach across tasks, runs repeat within a document and overlap themselves."""
    rng = random.Random(seed)
    rows = [(k if k % 7 else None, "\n".join(rng.choice(["a b", "c", "d e f", "a b", ""]) for _ in range(rng.randint(1, 25)))) for k in range(40)]
    rows += [(100 + k, "\n".join(["z z"] * 17)) for k in range(3)]
    monkeypatch.setattr(line_dedup, "partitions", lambda spark: 7)
    check(spark.createDataFrame(rows, "doc_id long, text string"), 4)


def test_the_first_copy_stays(spark):
    run = "one two three four\nfive six seven eight\nnine ten eleven twelve"
    df = spark.createDataFrame([(5, f"x\n{run}\ny"), (2, f"{run}"), (9, run), (1, "five six seven eight")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in keep_first_lines(df, 6).collect()}
    assert got == {1: "five six seven eight", 2: run, 5: "x\ny"}


def test_any_column_names(spark):
    """Columns named like the operator's own."""
    run = "one two three four\nfive six seven eight\nnine ten eleven twelve"
    rows = [(1, run, 1, 2, "a", 3), (2, f"{run}\nz", 1, 2, "b", 3), (2, f"{run}\nz", 1, 2, "c", 3)]
    for names in ("_doc long, _lines long, _deleted string, lines long", "doc_key long, run_key long, run_starts string, d long"):
        df = spark.createDataFrame(rows, f"doc_id long, text string, {names}")
        got = keep_first_lines(df)
        assert got.columns == df.columns and sorted(r.text for r in got.collect()) == sorted([run, "z", "z"])
        assert line_report(df).count() == 3


def every_run(rows, min_words):
    """{id: lines that go}: all runs of all lengths, in corpus order."""
    seen, gone = set(), {}
    for d, text in sorted(rows):
        x = text.split("\n")
        words = [len(y.split()) for y in x]
        gone[d] = set()
        for i in range(len(x)):
            for n in range(1, len(x) - i + 1):
                run = tuple(x[i : i + n])
                if run in seen and sum(words[i : i + n]) >= min_words:
                    gone[d].update(range(i, i + n))
                seen.add(run)
    return gone


def test_runs_of_any_length(spark, monkeypatch):
    """3 lines of 4 words, 5 to 7 short lines, and random ones: the words count over the whole run."""
    menu, short = ["one two three four", "five six seven eight", "nine ten eleven twelve"], [f"{k} x" for k in range(7)]
    rows = [(1, menu), (2, ["a", *menu, "b"]), (3, short), (4, ["c", *short, "d"]), (5, ["e", *short[:5], "f"]), (6, ["g", *short[:4]])]
    rng = random.Random(2)
    rows += [(10 + k, [rng.choice(["p q", "r", "", "s t u", "v"]) for _ in range(rng.randint(1, 14))]) for k in range(40)]
    rows = [(d, "\n".join(x)) for d, x in rows]
    rows += [(100 + k, "\n".join(["z z"] * 17)) for k in range(3)]
    monkeypatch.setattr(line_dedup, "partitions", lambda spark: 7)
    want = every_run(rows, 10)
    assert [len(want[d]) for d in range(1, 7)] == [0, 3, 0, 7, 5, 0]
    got = {r.doc_id: r.text for r in deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: "\n".join(y for i, y in enumerate(t.split("\n")) if i not in want[d]) for d, t in rows}
