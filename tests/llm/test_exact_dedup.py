import hashlib
import random
from collections import Counter, defaultdict

import pytest

from rangescan.llm.exact_dedup import LEAST, MOST, chunks, exact_duplicates
from tests.llm.test_simhash import lower


def check(df, **options):
    rows = [(r.doc_id, lower(r.text)) for r in df.collect()]
    groups = defaultdict(list)
    for d, t in rows:
        groups[t].append(d)
    best = {t: max((d for d in g if d is not None), default=None) for t, g in groups.items()}
    want = Counter((d, best[t], len(groups[t]), d == best[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in rows)
    assert Counter(map(tuple, exact_duplicates(df, **options).collect())) == want


def test_documents(docs):
    check(docs)


def test_odd_rows(odd, none):
    check(odd)
    assert exact_duplicates(none).count() == 0


def test_digests_that_clash_are_told_apart(docs, odd):
    """With digests of one byte nearly every chunk shares one with another content."""
    check(docs.limit(60), digest_bytes=1)
    check(odd, digest_bytes=1)


def test_chunks_follow_the_content():
    rng = random.Random(0)
    data = bytes(rng.randrange(97, 123) for _ in range(200_000))
    parts = chunks(data)
    assert b"".join(parts) == data and all(LEAST <= len(p) <= MOST for p in parts[:-1]) and len(parts) > 40
    moved = chunks(b"a few bytes in front" + data)
    assert len(set(parts) & set(moved)) > 0.9 * len(parts)
    assert chunks(b"") == [] and b"".join(chunks(b"x" * 100_000)) == b"x" * 100_000


@pytest.mark.parametrize("n", [1, LEAST - 1, LEAST, LEAST + 1, MOST + 1])
def test_short_texts(n):
    assert b"".join(chunks(b"ab" * n)) == b"ab" * n
