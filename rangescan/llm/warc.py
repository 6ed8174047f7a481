"""WARC archives of pages and their capture index by external merge.

Pages are written as WARC 1.1 records, one gzip member each, and read back record by record. The
captures of an archive are sorted by URL key, timestamp and page and written as a run; the runs are
then merged by loser trees, one for each range of keys, into capture histories in global order. A run is
an Arrow file of small sorted blocks, so a merge reads only the blocks of its range and holds one block
of each run; beyond FAN_IN runs, groups of runs are merged first.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangescan.llm.common import cut, fresh_dir, open_fs, partitions, raw

#: Bytes after which a task starts another archive; rows of a block of a run; runs merged at a time.
ARCHIVE_BYTES, BLOCK_ROWS, FAN_IN = 64 << 20, 2048, 256
#: Keys that a run gives the driver to choose ranges from, at most; ending of the file with the first keys of its blocks.
SAMPLES, KEYS = 64, ".keys"
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
CAPTURE = pa.schema([("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("file", pa.string()), ("offset", pa.int64())])
CAPTURE_SQL = "url_key string, captured string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, file string, offset long"


def url_key(url: str) -> str:
    """Sort key of a URL: host labels reversed, no scheme, port 80/443, user, leading www or fragment; lower case.

    What is no URL (an open bracket in the host, characters that become part of its syntax) keeps its text behind a "!".
    """
    try:
        parts = urlsplit(url if "//" in url[:9] else "//" + url)
    except ValueError:
        return "!" + url.lower()
    host = re.sub(r"^www\d*\.", "", (parts.netloc.rpartition("@")[2]).lower())
    host, _, port = host.partition(":")
    query = "&".join(sorted(parts.query.lower().split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{':' + port if port not in ('', '80', '443') else ''}){parts.path.lower().rstrip('/') or '/'}{'?' + query if query else ''}"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _record(page_id: int | None, url: str, date: str, payload: bytes, refers: int | None, digest: str, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the HTTP head with the length of the full payload, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    name = f"<urn:page:{page_id}>" if page_id is not None else "<urn:page:none>"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}",
        "WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url), f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _write(batches, folder: str, archive_bytes: int):
    """Rows (page_id, url, html, response id) into archives; gives (path, bytes, records)."""
    store, root = open_fs(folder)
    store.create_dir(root, recursive=True)
    out, path, size, n = None, "", 0, 0
    done = []
    for batch in batches:
        pages, firsts = batch.column(0).to_pylist(), batch.column(3).to_pylist()
        for page, url, html, first in zip(pages, raw(batch.column(1)), raw(batch.column(2)), firsts, strict=True):
            if out is None:
                path, size, n = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                out = store.open_output_stream(f"{root}/{path}", compression=None)
            revisit = first is not None and first != page
            date = (EPOCH + timedelta(seconds=(page or 0) % (10**9))).strftime("%Y-%m-%dT%H:%M:%SZ")
            data = _gzip(_record(page, url.decode("utf-8", "replace"), date, html, first, base32_sha1(html), revisit))
            out.write(data)
            size, n = size + len(data), n + 1
            if size >= archive_bytes:
                out.close()
                out = None
                done.append((f"{folder}/{path}", size, n))
    if out is not None:
        out.close()
        done.append((f"{folder}/{path}", size, n))
    yield pa.record_batch([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "n_bytes", "n_records"])


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every row of ``pages`` as a record; returns the manifest (path, n_bytes, n_records).

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the smallest id is the
    response, rows that repeat that id included; the others revisit it. Equal means equal SHA-1, SHA-256
    and length. Null payloads count as empty, null URLs as empty; rows without an id revisit the smallest
    id of their group, or are responses if it has none.
    """
    page, body = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    rows = pages.select(page.alias("page_id"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"), body.alias("html"))
    sums = rows.select("page_id", F.concat(F.unhex(F.sha1("html")), F.unhex(F.sha2("html", 256))).alias("sum"), F.octet_length("html").alias("n"))
    firsts = sums.where(F.col("n") >= least_bytes).groupBy("sum").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    later = sums.join(firsts, "sum").where("not page_id <=> first").select(F.col("page_id").alias("_page"), F.col("sum").alias("_sum"), "first").distinct()
    joined = rows.withColumn("sum", F.concat(F.unhex(F.sha1("html")), F.unhex(F.sha2("html", 256)))).join(later, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sum") == F.col("_sum")), "left")
    return cut(joined.select("page_id", "url", "html", "first").mapInArrow(lambda b: _write(b, folder, archive_bytes), "path string, n_bytes long, n_records long"), "warc-manifest")


def records(stream):
    """(offset, headers, block) of each record of a gzip-member archive, one in memory at a time."""
    base, data = 0, b""
    while True:
        if not data and not (data := stream.read(1 << 20)):
            return
        member, parts, used = zlib.decompressobj(31), [], 0
        while True:
            parts.append(member.decompress(data))
            used += len(data) - len(member.unused_data)
            if member.eof:
                data = member.unused_data
                break
            if not (data := stream.read(1 << 20)):
                raise ValueError("archive ends within a record")
        text = b"".join(parts)
        head, _, block = text.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield base, fields, block[: int(fields["Content-Length"])]
        base += used


def _page(urn: str | None) -> int | None:
    name = (urn or "").rpartition(":")[2].rstrip(">")
    return int(name) if name not in ("", "none") else None


def _capture(path: str, offset: int, fields: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    n = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    if kind == "response" and (base32_sha1(payload) != digest or len(payload) != n):
        raise ValueError(f"{path}, {offset}: the payload doesn't match its digest")
    url = fields.get("WARC-Target-URI", "")
    return url_key(url), fields["WARC-Date"], _page(fields["WARC-Record-ID"]), url, kind, _page(fields.get("WARC-Refers-To")), digest, n, path, offset


def _key(row: tuple) -> str:
    """Place of a capture by URL key, timestamp and page (none first), as text; page numbers are shifted to be positive."""
    return f"{row[0]}\0{row[1]}\0{'' if row[2] is None else f'{row[2] + (1 << 63):020d}'}"


def _order(row: tuple) -> tuple:
    return _key(row), row[8], row[9]


class Run:
    """A sorted run on disk, read block by block from the first block that may hold ``low``."""

    def __init__(self, path: str, low: str | None, high: str | None):
        store, name = open_fs(path)
        self.reader, self.block = pa.ipc.open_file(store.open_input_file(name)), 0
        if low is not None:
            with pa.ipc.open_file(store.open_input_file(name + KEYS)) as keys:
                self.block = max(0, bisect_left(keys.read_all().column(0).to_pylist(), low) - 1)
        self.low, self.high, self.rows = low, high, iter(())

    def next(self) -> tuple | None:
        while True:
            for row in self.rows:
                if self.low is not None and _key(row) < self.low:
                    continue
                return row if self.high is None or _key(row) < self.high else None
            if self.block >= self.reader.num_record_batches:
                return None
            batch = self.reader.get_batch(self.block)
            self.block += 1
            self.rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)


class LoserTree:
    """K-way merge: each inner node keeps the loser of its match, so the next row costs one path to the root."""

    def __init__(self, sources: list):
        self.sources, self.k = sources, len(sources)
        self.heads = [s.next() for s in sources]
        self.keys = [None if h is None else _order(h) for h in self.heads]
        self.losers = [-1] * max(1, self.k)
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._wins(a, b) else (b, a)
        self.losers[0] = winners[1] if self.k > 1 else 0

    def _wins(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def __iter__(self):
        while self.k and (best := self.losers[0]) >= 0 and self.heads[best] is not None:
            yield self.heads[best]
            head = self.heads[best] = self.sources[best].next()
            self.keys[best] = None if head is None else _order(head)
            node = (best + self.k) // 2
            while node:
                if self._wins(self.losers[node], best):
                    best, self.losers[node] = self.losers[node], best
                node //= 2
            self.losers[0] = best


def _save_run(rows, folder: str) -> tuple[str, list[str], int]:
    """Write sorted rows as a run, and the first key of each block beside it; gives its path, some of these keys and the number of rows."""
    store, root = open_fs(folder)
    store.create_dir(root, recursive=True)
    name, firsts, n, held = f"run-{uuid.uuid4().hex}.arrow", [], 0, []
    with store.open_output_stream(f"{root}/{name}", compression=None) as f, pa.ipc.new_file(f, CAPTURE, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:

        def put():
            nonlocal held
            firsts.append(_key(held[0]))
            w.write_batch(_batch(held))
            held = []

        for row in rows:
            held.append(row)
            n += 1
            if len(held) == BLOCK_ROWS:
                put()
        if held:
            put()
    keys = pa.record_batch([pa.array(firsts, pa.string())], ["first"])
    with store.open_output_stream(f"{root}/{name}{KEYS}", compression=None) as f, pa.ipc.new_file(f, keys.schema) as w:
        w.write_batch(keys)
    return f"{folder}/{name}", firsts[:: -(-len(firsts) // SAMPLES) or 1], n


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), CAPTURE.types, strict=True)], schema=CAPTURE)


_RUN = "path string, firsts array<string>, n long"


def _runs_of(found: list[tuple[str, list[str], int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.list_(pa.string())), pa.array([x[2] for x in found], pa.int64())], ["path", "firsts", "n"])


def capture_index(manifest: DataFrame, folder: str, fan_in: int = FAN_IN) -> DataFrame:
    """Captures of all archives of a manifest with (range_no, seq), whose order is that of URL key, timestamp and page.

    Each archive gives one run. An empty manifest gives an empty table; captures without a page come first
    among equals. The ranges come from a bounded sample of the first places of blocks; the
    long history of one URL may reach over several ranges, which follow each other.
    """
    spark = manifest.sparkSession

    def index(batches):
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                store, name = open_fs(path)
                with store.open_input_stream(name, compression=None) as f:
                    rows = sorted((_capture(path, at, head, block) for at, head, block in records(f)), key=_order)
                found.append(_save_run(rows, folder))
            yield _runs_of(found)

    n_files = manifest.count()
    runs = cut(manifest.select("path").repartition(max(1, min(n_files, 10_000))).mapInArrow(index, _RUN), "capture-runs")
    while (k := runs.count()) > fan_in:
        groups = runs.withColumn("g", F.pmod(F.xxhash64("path"), F.lit(-(-2 * k // fan_in)))).groupBy("g").agg(F.collect_list("path").alias("runs")).select("runs")

        def merge(batches):
            for batch in batches:
                yield _runs_of([_save_run(LoserTree([Run(path, None, None) for path in group]), folder) for group in batch.column(0).to_pylist()])

        runs = cut(groups.mapInArrow(merge, _RUN), "capture-runs")

    found = runs.orderBy("path").collect()  # at most fan_in runs with SAMPLES keys each
    keys = sorted(k for r in found for k in r.firsts)
    n = partitions(spark)
    cuts = sorted({keys[i * len(keys) // n] for i in range(1, n)} - {keys[0]}) if keys else []
    ranges = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None], strict=True))], "range_no long, low string, high string").repartitionByRange(len(cuts) + 1, "range_no")
    inputs = [r.path for r in found]

    def histories(batches):
        for batch in batches:
            for no, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held, seq = [], 0
                for row in LoserTree([Run(path, low, high) for path in inputs]):
                    held.append(row)
                    if len(held) == BLOCK_ROWS:
                        yield _numbered(no, seq, held)
                        seq, held = seq + len(held), []
                if held:
                    yield _numbered(no, seq, held)

    return ranges.mapInArrow(histories, "range_no long, seq long, " + CAPTURE_SQL)


def _numbered(no: int, seq: int, rows: list[tuple]) -> pa.RecordBatch:
    b = _batch(rows)
    return pa.record_batch([pa.array([no] * len(rows), pa.int64()), pa.array(range(seq, seq + len(rows)), pa.int64()), *b.columns], ["range_no", "seq", *b.schema.names])


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, **options) -> DataFrame:
    """Write archives of ``pages``, read them back and give the merged capture index.

    Nulls, repeated rows and odd URLs are treated as in ``write_archives`` and ``url_key``; an empty table gives an
    empty one; columns beside the three named are ignored.
    """
    folder = folder or fresh_dir(pages.sparkSession, "warc")
    return capture_index(write_archives(pages, folder, least_bytes, **options), f"{folder}/runs")
