"""WARC archives, index first.

Each task streams its records into one archive in the shared folder and yields the index: path,
offset, length, URL and digest per record; each record is a gzip member of its own, as the format has it. Readers sort the selected index rows by archive and
offset, coalesce neighbouring byte ranges, and fetch each range in one read. A retried
task writes a new archive; only archives of committed index rows are ever read.

Of equal payloads the largest page_id is the response, the others revisit it. Null html is an
empty payload; repeated rows of one page_id: the one response is the largest row of that page_id,
and all its rows are responses. A null page_id revisits the largest one of its payload, or is a response where
there is none. Very long payloads are one record each. Empty tables write no archive and give no rows; extra columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from datetime import datetime, timezone
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh_path, stored, table

#: Copies of each row of the digests with several pages, so that a hot digest spreads over tasks.
SALTS = 32
#: Bytes between records that are read over rather than skipped, and the longest coalesced read.
GAP, RANGE = 1 << 16, 8 << 20
#: Bytes of an archive that one reading task is dealt.
SLICE = 16 << 20
#: Of the compression.
LEVEL = 1

INDEX = "page_id long, url string, path string, offset long, length long, digest string"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head and drops the payload. The page_ids stand in fields
    of their own, so that record ids are unique whatever the rows."""
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Target-URI: {url}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member of its own."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(data: bytes) -> dict:
    """The fields of one record and its payload (None for a revisit)."""
    head, rest = data.split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    fields["http"] = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    fields["payload"] = payload if fields["WARC-Type"] == "response" else None
    return fields


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives and returns their index, stored."""
    digest = F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    source = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), digest.alias("hash"),
        F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    several = source.groupBy("hash").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")
    several = stored(several.select("hash", "response"), "warc-repeats")
    if several.count() <= BROADCAST_ROWS:
        # No payload moves: each task archives the pages that it reads.
        joined = source.join(F.broadcast(several), "hash", "left")
    else:
        salted = several.select("hash", "response", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        joined = source.join(salted, ["hash", "salt"], "left")
    dealt = joined.select(
        "page_id", "url", "html", "hash", F.when(~F.col("response").eqNullSafe(F.col("page_id")), F.col("response")).alias("refers_to")
    )

    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _filesystem(folder)
        path = f"{root}/{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, hashed, refers in zip(*(batch[c] for c in ("page_id", "url", "html", "hash", "refers_to"))):
                    if out is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(path, compression=None)
                    page_id = None if pd.isna(page_id) else int(page_id)
                    sha = base64.b32encode(bytes.fromhex(hashed)).decode()
                    data = member(record(page_id, url, html.encode("utf-8", "replace"), sha, None if pd.isna(refers) else int(refers), date))
                    out.write(data)
                    rows.append((page_id, url, path, at, len(data), sha))
                    at += len(data)
                yield pd.DataFrame(rows, columns=["page_id", "url", "path", "offset", "length", "digest"]).astype({"page_id": "Int64"})
        finally:
            if out is not None:
                out.close()

    return stored(dealt.mapInPandas(archive, INDEX), "warc-index")


def ranges(rows: list[tuple[int, int]], gap: int = GAP, longest: int = RANGE) -> list[list[tuple[int, int]]]:
    """Sorted (offset, length) pairs in runs that one read fetches."""
    runs: list[list[tuple[int, int]]] = []
    for at, n in rows:
        if runs and at - sum(runs[-1][-1]) <= gap and at + n - runs[-1][0][0] <= longest:
            runs[-1].append((at, n))
        else:
            runs.append([(at, n)])
    return runs


def read(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the selected records."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _filesystem(folder)
        name = file = None
        for batch in batches:
            out = []
            for path, part in batch.groupby("path", sort=False):
                if path != name:
                    name, file = path, store.open_input_file(path)
                for run in ranges(list(zip(part["offset"].tolist(), part["length"].tolist()))):
                    first = run[0][0]
                    data = file.read_at(sum(run[-1]) - first, first)
                    for at, n in run:
                        x = parse(zlib.decompress(data[at - first : at - first + n], 31))
                        size, sha = int(x["http"]["Content-Length"]), x["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload = x["payload"]
                        if payload is not None and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != sha):
                            raise ValueError(f"damaged record at {path}:{at}")
                        page, refers = x["X-Page-ID"], x.get("X-Refers-To-Page-ID", "")
                        out.append((int(page) if page else None, size, sha, x["WARC-Type"], int(refers) if refers else None))
            columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pd.DataFrame(out, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    slices = index.withColumn("slice", F.floor(F.col("offset") / SLICE))
    placed = slices.repartition("path", "slice").sortWithinPartitions("path", "offset").select("path", "offset", "length")
    return placed.mapInPandas(fetch, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    return read(write(table(spark, sf_dir, "pages"), folder), folder)


#: Five bits at a time of the hexadecimal digest, as letters of base32.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), d AS (SELECT page_id, t, sha1(t) AS h FROM p),
b AS (SELECT page_id, t, array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((CAST(concat('0x', h[5 * (i // 4) + 1 : 5 * (i // 4) + 5]) AS BIGINT) >> (15 - 5 * (i % 4))) & 31)]), '') AS digest FROM d),
r AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM b)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM r
"""
