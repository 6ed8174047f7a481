import base64
import gzip
import hashlib
import random
from collections import Counter, defaultdict

import pytest

from rangescan.llm import warc
from rangescan.llm.warc import LoserTree, archive_pages, capture_index, url_key, write_archives


class Source:
    def __init__(self, rows):
        self.rows = iter(rows)

    def next(self):
        return next(self.rows, None)


def capture(key, n):
    return (key, "2020", n, "", "response", None, "", 0, "f", n)


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(0)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((capture(rng.choice("abc"), rng.randrange(20)) for _ in range(rng.randint(0, 12))), key=warc._order) for _ in range(k)]
        assert list(LoserTree([Source(r) for r in runs])) == sorted((x for r in runs for x in r), key=warc._order)


@pytest.mark.parametrize("url,key", [("http://www.Example.com:80/A/?b=2&a=1#x", "com,example)/a?a=1&b=2"), ("https://user@m.a.org:8080", "org,a,m:8080)/"), ("", ")/"), ("a.b/c", "b,a)/c"), ("http://[::1/X", "!http://[::1/x"), ("http://[abc]/", "!http://[abc]/"), ("http://a\u2100.com/", "!http://a\u2100.com/")])
def test_url_keys(url, key):
    assert url_key(url) == key


def check(pages, got, least=0):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    groups = defaultdict(list)
    for p, b in rows:
        groups[b].append(p)
    first = {b: min((p for p in g if p is not None), default=None) for b, g in groups.items()}
    want = Counter()
    for p, b in rows:
        f = first[b] if len(b) >= least else p
        revisit = f is not None and f != p
        want[p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", f if revisit else None] += 1
    assert Counter(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())) == want


def ordered(got):
    rows = got.orderBy("range_no", "seq").select("url_key", "captured", "page_id").collect()
    keys = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in rows]
    assert keys == sorted(keys)


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = archive_pages(pages)
    check(pages, got)
    ordered(got)


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [(3, "http://a.b/x", "same"), (1, "http://a.b/x", "same"), (2, None, None), (4, "", ""), (None, "http://c.d", "same"), (None, "http://c.d", "alone\r\n\r\n"), (5, "http://é.ü/\nz", "漢 \x00"), (1, "http://a.b/x", "same"), (6, "http://a.b/x", "y" * 100_000), (-7, "u", "same")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as sum", "2 as first")


def test_odd_rows(odd_pages, tmp_path):
    got = archive_pages(odd_pages)
    check(odd_pages, got)
    ordered(got)
    check(odd_pages, archive_pages(odd_pages, least_bytes=5), 5)
    assert archive_pages(odd_pages.where("false")).count() == 0


def test_malformed_urls(spark):
    pages = spark.createDataFrame([(1, "http://[::1/x", "a"), (2, "http://[abc]/", "b"), (3, "http://a\u2100.com/", "a"), (4, "http://a.b/", "c")], "page_id long, url string, html string")
    got = archive_pages(pages)
    check(pages, got)
    ordered(got)


def test_many_archives_and_several_rounds(spark, odd_pages, tmp_path, monkeypatch):
    manifest = write_archives(odd_pages, str(tmp_path / "w"), archive_bytes=1)
    assert manifest.count() == odd_pages.count()
    got = capture_index(manifest, str(tmp_path / "runs"), fan_in=3)
    check(odd_pages, got)
    ordered(got)


def test_archives_are_plain_gzip(odd_pages, tmp_path):
    (path,) = [r.path for r in write_archives(odd_pages.coalesce(1), str(tmp_path / "w")).collect()]
    with gzip.open(path) as f:
        text = f.read()
    assert text.count(b"WARC/1.1\r\n") == odd_pages.count() and text.count(b"WARC-Type: revisit") == 4 + 1
    data = open(path, "rb").read()
    (tmp_path / "cut.gz").write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="ends within|Error|invalid"):
        with open(tmp_path / "cut.gz", "rb") as f:
            list(warc.records(f))
