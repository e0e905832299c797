"""Web archives with a two-level capture index.

**Archives.** Every task writes its captures as WARC/1.1 records, one gzip member each, into files of
its own in the shared folder. Of captures with equal payloads the one with the largest id is a
``response``, the others are ``revisit`` records that name it. Only files that a finished task
reports belong to the archive; what a lost task left behind is never read.

**Index.** Captures are range-partitioned and sorted by (reversed-host URL key, id). Every partition
becomes a file of compressed blocks of ``BLOCK_LINES`` lines and a directory file with the first key,
offset and length of each block. The list of partitions, with their first keys, is the top level: one
row for about a million captures, in the order of first and last keys.

**Lookup.** A key is placed in its partition, or in all partitions that its rows run over, by binary
search in the top level, in its block by binary search in the directory, and in the block by binary
search among its lines. A block is read by one range read for all keys that need it; records are
range reads too, in the order of their files.

Null payloads count as empty. A null URL has the key ``-`` and no target header. Ids that are null
order before all others. Rows that repeat become a record each (with the largest id: a response
each). White space and control characters in URLs are percent-encoded in headers and keys. An empty
table gives no files and an empty result.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tellmark.llm.common import arrow, file_store, join_checked, scratch_path, stored, whole_groups

BLOCK_LINES = 1024
PART_LINES = 1_000_000
#: Rows that a lookup holds before it passes them on.
BATCH_ROWS = 16_384
ARCHIVE_BYTES = 1 << 30
#: Bytes of archive that a task reads.
FETCH_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = -(1 << 63)
NO_URL = "-"


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f\u0080-   ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def url_key(url: str | None) -> str:
    """The URL with its host reversed: ``http://www.Example.com:80/a?b`` is ``com,example,www)/a?b``."""
    if url is None:
        return NO_URL
    found = re.fullmatch(r"(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?//(?:[^/?#]*@)?([^/?#:]*)(?::(\d*))?([^#]*)(?:#.*)?", _clean(url))
    if not found:
        return _clean(url) or NO_URL
    scheme, host, port, rest = found.groups()
    usual = {"http": "80", "https": "443"}.get((scheme or "").lower())
    host = re.sub(r"^www\d*\.", "", host.lower().rstrip("."))
    port = f":{port}" if port and port != usual else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (rest if rest[:1] == "/" else "/" + rest)


def record(capture: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record. A revisit holds the HTTP head alone; its length line tells the full size."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'capture {i}')}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(capture)}",
        f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {_clean(url)}"]),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"Capture-Id: {capture}",
        *([] if refers_to is None else [
            f"WARC-Refers-To: {name(refers_to)}", f"Refers-To-Capture: {refers_to}", f"WARC-Profile: {PROFILE}",
        ]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record as a dictionary; raises where a digest or a length does not hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if not version.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record of the length that it tells")
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    kind = fields["WARC-Type"]
    if sha(block) != fields["WARC-Block-Digest"] or kind == "response" and (
        sha(payload) != fields["WARC-Payload-Digest"] or len(payload) != size
    ):
        raise ValueError(f"capture {fields['Capture-Id']} does not match its digests")
    return {
        "capture": int(fields["Capture-Id"]), "url": fields.get("WARC-Target-URI"), "record_type": kind,
        "payload": payload if kind == "response" else None, "payload_bytes": size,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": int(fields["Refers-To-Capture"]) if kind == "revisit" else None,
    }


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _id(key: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(NO_ID).cast("long"))


def write(pages: DataFrame, folder: str, url: str = "url", payload: str = "html", key: str = "page_id", min_bytes: int = 0) -> DataFrame:
    """Write a record per row under ``folder``; returns the captures (stored): ``surt``, ``capture``,
    ``file``, ``offset``, ``length``. Payloads below ``min_bytes`` are always responses."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(_id(key).alias("capture"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    several = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(
        F.max("capture").alias("refers_to"), F.count(F.lit(1)).alias("_n")
    ).where("_n > 1").drop("_n")
    again = join_checked(rows.select("capture", "sha"), stored(several, "payloads"), "sha", "inner", 80)
    again = stored(again.where("capture < refers_to").distinct(), "revisits")
    rows = join_checked(rows, again, ["capture", "sha"], "left", 100)
    schema = "surt string, capture long, file string, offset long, length long"
    out = arrow(schema)
    rows = rows.select("capture", "url", "payload", "sha", "refers_to")

    def run(batches):
        fs, path = file_store(folder)
        sink = name = None
        place = 0
        for batch in batches:
            found = []
            for capture, address, content, sha, refers in zip(*[c.to_pylist() for c in batch.columns]):
                if sink is None or place >= ARCHIVE_BYTES:
                    if sink is not None:
                        sink.close()
                    fs.create_dir(path, recursive=True)
                    name, place = f"captures-{uuid.uuid4().hex}.warc.gz", 0
                    sink = fs.open_output_stream(f"{path}/{name}", compression=None)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                data = _member(record(capture, address, content, digest, refers))
                sink.write(data)
                found.append((url_key(address), capture, name, place, len(data)))
                place += len(data)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), out)], schema=out)
        if sink is not None:
            sink.close()

    return stored(rows.mapInArrow(run, schema), "captures")


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the blocks and directories under ``folder``; returns the top level (stored): ``part``,
    ``first_surt``, ``first_capture``, ``last_surt``, ``last_capture``, ``blocks``."""
    total = captures.count()
    least = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-total // PART_LINES))
    ordered = captures.repartitionByRange(parts, "surt", "capture", "file", "offset").sortWithinPartitions(
        "surt", "capture", "file", "offset"
    ).select("surt", "capture", "file", "offset", "length")
    schema = "part string, first_surt string, first_capture long, last_surt string, last_capture long, blocks int"
    out = arrow(schema)

    def run(batches):
        fs, path = file_store(folder)
        part, place, lines, directory = uuid.uuid4().hex, 0, [], []
        sink = last = None

        def flush():
            nonlocal place, last
            data = _member("\n".join(f"{s} {c} {json.dumps([f, o, n])}" for s, c, f, o, n in lines).encode())
            sink.write(data)
            directory.append((*lines[0][:2], place, len(data)))
            place += len(data)
            last = lines[-1][:2]
            lines.clear()

        for batch in batches:
            for line in zip(*[c.to_pylist() for c in batch.columns]):
                if sink is None:
                    fs.create_dir(path, recursive=True)
                    sink = fs.open_output_stream(f"{path}/{part}.index.gz", compression=None)
                lines.append(line)
                if len(lines) == BLOCK_LINES:
                    flush()
        if sink is None:
            return
        if lines:
            flush()
        sink.close()
        with fs.open_output_stream(f"{path}/{part}.directory.json", compression=None) as f:
            f.write(json.dumps(directory).encode())
        cells = [part, *directory[0][:2], *last, len(directory)]
        yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(cells, out)], schema=out)

    return stored(ordered.mapInArrow(run, schema), "index-parts")


def _around(firsts: list, wanted) -> list[int]:
    """Places of the entries that may hold the wanted key: from the last whose first key is before it
    to the last whose first key equals it."""
    begin = max(0, bisect.bisect_left(firsts, wanted) - 1)
    return list(range(begin, max(begin + 1, bisect.bisect_right(firsts, wanted))))


def lookup(keys: DataFrame, parts: DataFrame, folder: str) -> DataFrame:
    """``surt``, ``capture``, ``file``, ``offset``, ``length`` of every capture that the distinct
    (``surt``, ``capture``) of ``keys`` name; keys without a capture give no row."""
    # of parts that begin with one key, the one that goes on to further keys is the last
    top = sorted((r["first_surt"], r["first_capture"], r["last_surt"], r["last_capture"], r["part"]) for r in parts.collect())
    firsts = [t[:2] for t in top]
    spark: SparkSession = keys.sparkSession
    schema = "surt string, capture long, file string, offset long, length long"
    out = arrow(schema)
    if not top:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast((firsts, [t[-1] for t in top]))

    @F.pandas_udf("array<int>")
    def parts_of(surt, capture):
        import pandas as pd

        where = shared.value[0]
        return pd.Series([_around(where, wanted) for wanted in zip(surt, capture)], dtype="object")

    placed = keys.select("surt", "capture").distinct().withColumn("part", F.explode(parts_of("surt", "capture")))
    placed = placed.repartition(len(top), "part").sortWithinPartitions("part", "surt", "capture")

    def run(batches):
        fs, path = file_store(folder)
        for group in whole_groups(batches, "part"):
            name = shared.value[1][group.column("part")[0].as_py()]
            with fs.open_input_file(f"{path}/{name}.directory.json") as f:
                directory = [tuple(x) for x in json.loads(f.read())]
            starts = [x[:2] for x in directory]
            found, held, lines, entries = [], None, [], []
            with fs.open_input_file(f"{path}/{name}.index.gz") as f:
                for wanted in zip(group.column("surt").to_pylist(), group.column("capture").to_pylist()):
                    # equal keys may run over a block's end
                    block = max(0, bisect.bisect_left(starts, wanted) - 1)
                    while block < len(directory) and (starts[block] <= wanted):
                        if held != block:
                            text = zlib.decompress(f.read_at(directory[block][3], directory[block][2]), 31).decode()
                            entries = [line.split(" ", 2) for line in text.split("\n")]
                            lines, held = [(s, int(c)) for s, c, _ in entries], block
                        at = bisect.bisect_left(lines, wanted)
                        while at < len(lines) and lines[at] == wanted:
                            found.append((*wanted, *json.loads(entries[at][2])))
                            at += 1
                        block += 1
                        if len(found) >= BATCH_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), out)], schema=out)
                            found = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), out)], schema=out)

    return placed.mapInArrow(run, schema)


def fetch(located: DataFrame, folder: str) -> DataFrame:
    """The records at the places found, with payloads (null for revisits)."""
    schema = (
        "capture long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    )
    out = arrow(schema)
    located = stored(located, "located")
    size = located.agg(F.sum("length")).first()[0] or 0
    rows = located.repartition(max(1, -(-size // FETCH_BYTES)), "file", F.floor(F.col("offset") / (16 << 20)))
    rows = rows.sortWithinPartitions("file", "offset").select("file", "offset", "length")

    def run(batches):
        fs, path = file_store(folder)
        name = f = None
        for batch in batches:
            found, held = [], 0
            for file, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, fs.open_input_file(f"{path}/{file}")
                found.append(parse(zlib.decompress(f.read_at(length, offset), 31)))
                held += found[-1]["payload_bytes"]
                if held > 8 << 20:
                    yield _rows(found, out)
                    found, held = [], 0
            if found:
                yield _rows(found, out)
        if f is not None:
            f.close()

    return rows.mapInArrow(run, schema)


def _rows(found: list[dict], out: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[t.name] for r in found], t.type) for t in out], schema=out)


def surts(pages: DataFrame, url: str = "url", key: str = "page_id") -> DataFrame:
    """The index keys (``surt``, ``capture``) of rows with a URL and an id."""

    @F.pandas_udf("string")
    def surt(urls):
        return urls.map(lambda u: url_key(u if isinstance(u, str) else None), na_action=None)

    return pages.select(surt(F.col(url)).alias("surt"), _id(key).alias("capture"))


def round_trip(pages: DataFrame, url: str = "url", payload: str = "html", key: str = "page_id", min_bytes: int = 0) -> DataFrame:
    """Write the archives and the index, look every row up again, and describe what is read."""
    folder = scratch_path(pages.sparkSession, "warc")
    parts = build_index(write(pages, folder, url, payload, key, min_bytes), folder)
    read = fetch(lookup(surts(pages, url, key), parts, folder), folder)
    back = lambda c: F.when(F.col(c) != F.lit(NO_ID), F.col(c))
    return read.select(
        back("capture").alias(key), "payload_bytes", "payload_digest", "record_type", back("refers_to").alias("refers_to")
    )
