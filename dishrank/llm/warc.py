"""WARC archives with a two-level capture index.

``write_archives`` turns pages into WARC records, one gzip member each, gathered into
archives. Of pages with one payload the smallest id is a response and the others are
revisits of it. ``write_index`` sorts the captures by reversed-host URL key into
compressed blocks, ``find`` answers keys by binary search in the sparse directory of
blocks and then in one block, and ``read_records`` reads just the named byte ranges.

An archive is a row ``(archive, content)`` of a written table, so any store that Spark
reads will do; ``content`` is a complete ``.warc.gz`` file. Index shards hold ranges of
keys; the first keys of the shards, one row each, are all that the driver sees.

Defined results: a null payload is empty; a null or odd URL is indexed as it stands; of
repeated rows of the smallest id each is a response; a null id is never the smallest
unless all are null; an empty table gives empty archives and no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import partitions_for, plain, ready, staged, text_bytes

LEAST_PAYLOAD = 100
ARCHIVE_BYTES = 4 << 20
BLOCK_LINES = 1_000
SHARD_ROWS = 50_000
GZIP_LEVEL = 3
# Fixed value: the profile of a revisit whose payload is the same.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = b"\r\n"


def surt(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then port, path and query."""
    text = quote((url or "").strip(), safe="/:?#[]@!$&'()*+,;=%-._~|")
    scheme, mark, rest = text.partition("://")
    if not mark:
        rest = text
    rest = rest.partition("#")[0]
    host, slash, path = rest.partition("/")
    if "?" in host:
        host, _, tail = host.partition("?")
        slash, path = "/", "?" + tail
    host = host.rpartition("@")[2].lower()
    name, colon, port = host.partition(":")
    if port in ("80", "443"):
        colon = port = ""
    return f"{','.join(reversed(name.split('.')))}{colon}{port}){slash or '/'}{path}"


def index_key(url: str | None, id: int | None) -> str:
    return f"{surt(url)} {'-' if id is None else id}"


def record_bytes(
    id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool
) -> bytes:
    """One WARC record; a revisit has the HTTP head alone."""
    head = EOL.join([
        b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b"",
    ])
    block = head if revisit else head + payload
    target = quote(url or "", safe="/:?#[]@!$&'()*+,;=%-._~|")
    fields = [
        b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <urn:page:%s>" % (b"" if id is None else str(id).encode()),
        b"WARC-Target-URI: " + target.encode("ascii"),
        b"WARC-Payload-Digest: sha256:" + digest.encode("ascii"),
    ]
    if revisit:
        fields += [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: " + REVISIT_PROFILE.encode()]
    fields += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block), b"", b""]
    return EOL.join(fields) + block + EOL + EOL


_ID = re.compile(rb"<urn:page:(-?\d*)>")


def parse_record(data: bytes) -> dict:
    """Fields of one record; digest and size are those of the payload it stands for."""
    head, _, rest = data.partition(EOL + EOL)
    fields = dict(line.split(b": ", 1) for line in head.split(EOL)[1:])
    block = rest[:int(fields[b"Content-Length"])]
    http, _, payload = block.partition(EOL + EOL)
    size = int(next(line for line in http.split(EOL) if line.startswith(b"Content-Length: "))[16:])
    kind = fields[b"WARC-Type"].decode()
    own = _ID.match(fields[b"WARC-Record-ID"]).group(1)
    other = _ID.match(fields.get(b"WARC-Refers-To", b""))
    digest = fields[b"WARC-Payload-Digest"].decode().partition(":")[2]
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"record of page {own.decode()} is damaged")
    return {
        "page_id": int(own) if own else None, "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": int(other.group(1)) if other else None,
    }


def with_responses(pages: DataFrame) -> DataFrame:
    """Add ``digest``, ``revisit`` and ``refers_to``; the smallest id of a payload answers."""
    rows = pages.withColumn("payload", F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).drop("html")
    long = F.octet_length("payload") >= LEAST_PAYLOAD
    groups = rows.where(long).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    # Only these are joined, by one small row each: while they are few, no payload moves.
    first = staged(groups.where("copies > 1").select("digest", "first"), "copies")
    joined = rows.join(first, "digest", "left")
    revisit = F.coalesce(long & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id")), F.lit(False))
    return joined.select(
        "id", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to")
    )


ARCHIVES = "archive string, content binary, entries array<struct<key: string, start: int, size: int>>"


def write_archives(pages: DataFrame, level: int = GZIP_LEVEL, size: int = ARCHIVE_BYTES) -> DataFrame:
    """Written table of archives from rows ``(id, url, html)``, with each record's place.

    An archive is named by its content, so a repeated task gives the same names.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[bytes] = []
        entries: list[dict] = []
        at = 0

        def archive() -> pa.RecordBatch:
            content = b"".join(members)
            rows = [{
                "archive": hashlib.sha256(content).hexdigest(), "content": content, "entries": list(entries),
            }]
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("archive", pa.string()), ("content", pa.binary()),
                ("entries", pa.list_(pa.struct([("key", pa.string()), ("start", pa.int32()), ("size", pa.int32())]))),
            ]))

        for batch in batches:
            columns = [batch.column(c) for c in ("id", "url", "payload", "digest", "refers_to", "revisit")]
            for row in zip(*columns):
                id, url, payload, digest, refers, revisit = (c.as_py() for c in row)
                member = gzip.compress(record_bytes(id, url, payload, digest, refers, revisit), level, mtime=0)
                entries.append({"key": index_key(url, id), "start": at, "size": len(member)})
                members.append(member)
                at += len(member)
                if at >= size:
                    yield archive()
                    members.clear()
                    entries.clear()
                    at = 0
        if members:
            yield archive()

    # Where payloads move after all, their partitions follow the bytes.
    parts = partitions_for(pages.sparkSession, text_bytes(pages, "html"))
    return staged(with_responses(pages).mapInArrow(build, ARCHIVES), "archives", parts)


def write_index(archives: DataFrame) -> DataFrame:
    """Written index ``(shard, block, first_key, lines)`` of the archives' records."""
    spark = archives.sparkSession
    places = archives.select("archive", F.explode("entries").alias("e")).select("e.key", "archive", "e.start", "e.size")
    shards = partitions_for(spark, places.count(), SHARD_ROWS)
    ordered = places.repartitionByRange(shards, "key", "archive", "start").sortWithinPartitions("key", "archive", "start")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, lines = TaskContext.get().partitionId(), 0, []

        def block() -> pa.RecordBatch:
            text = "\n".join("\t".join(map(str, line)) for line in lines).encode("utf-8")
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([lines[0][0]]),
                 pa.array([zlib.compress(text)], pa.binary())],
                names=["shard", "block", "first_key", "lines"],
            )

        for batch in batches:
            for line in zip(*(batch.column(c).to_pylist() for c in ("key", "archive", "start", "size"))):
                lines.append(line)
                if len(lines) == BLOCK_LINES:
                    yield block()
                    number, lines = number + 1, []
        if lines:
            yield block()

    return staged(ordered.mapInArrow(blocks, "shard int, block int, first_key string, lines binary"), "index")


FOUND = "key string, archive string, start int, size int"


def _search(keys: pa.Table, index: pa.Table) -> pa.Table:
    """Captures of the asked keys in one shard."""
    order = sorted(range(index.num_rows), key=index.column("block").to_pylist().__getitem__)
    firsts = [index.column("first_key")[i].as_py() for i in order]
    out: list[list[str]] = []
    opened, lines, starts = -1, [], []
    for key in sorted(keys.column("key").to_pylist()):
        # The last block that begins before the key, and those behind it that begin with it.
        at = max(bisect_left(firsts, key) - 1, 0)
        while at < len(firsts) and firsts[at] <= key:
            if at != opened:
                text = zlib.decompress(index.column("lines")[order[at]].as_py()).decode("utf-8")
                lines = [line.split("\t") for line in text.split("\n")]
                starts, opened = [line[0] for line in lines], at
            out += lines[bisect_left(starts, key):bisect_right(starts, key)]
            at += 1
    columns = list(zip(*out)) or [[], [], [], []]
    return pa.table({
        "key": pa.array(columns[0], pa.string()), "archive": pa.array(columns[1], pa.string()),
        "start": pa.array([int(x) for x in columns[2]], pa.int32()),
        "size": pa.array([int(x) for x in columns[3]], pa.int32()),
    })


def find(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Places ``(key, archive, start, size)`` of the captures of ``keys(key)``."""
    firsts = sorted((r.first_key, r.shard) for r in index.groupBy("shard").agg(F.min("first_key").alias("first_key")).collect())
    names, shards = [f for f, _ in firsts], [s for _, s in firsts]

    @F.arrow_udf("array<int>")
    def shard_of(asked: pa.Array) -> pa.Array:
        # A key that begins a shard may end the one before it as well.
        return pa.array(
            [shards[max(bisect_left(names, k) - 1, 0):bisect_right(names, k)] for k in asked.to_pylist()], pa.list_(pa.int32())
        )

    routed = keys.where(F.col("key").isNotNull()).distinct().withColumn("shard", F.explode(shard_of("key")))
    return routed.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_search, FOUND)


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _ranges(places: pa.Table, archives: pa.Table) -> pa.Table:
    """Records in the asked ranges of one archive."""
    content = memoryview(archives.column("content")[0].as_buffer()) if archives.num_rows else b""
    rows = [
        parse_record(gzip.decompress(content[start:start + size]))
        for start, size in zip(places.column("start").to_pylist(), places.column("size").to_pylist())
    ]
    schema = pa.schema([
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()),
    ])
    return pa.Table.from_pylist(rows, schema=schema)


def read_records(places: DataFrame, archives: DataFrame) -> DataFrame:
    """Parsed records at the given places; archives that are not asked for stay unread."""
    size = archives.select(F.explode("entries.size").alias("size")).agg(F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0))).first()[0]
    parts = partitions_for(archives.sparkSession, size)
    asked = archives.select("archive", "content").repartition(parts, "archive")
    return places.repartition(parts, "archive").groupBy("archive").cogroup(asked.groupBy("archive")).applyInArrow(_ranges, RECORDS)


def key_column(url: Column, id: Column) -> Column:
    @F.arrow_udf("string")
    def key(urls: pa.Array, ids: pa.Array) -> pa.Array:
        return pa.array([index_key(u, i) for u, i in zip(urls.to_pylist(), ids.to_pylist())], pa.string())

    return key(url, id)


def round_trip(df: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write pages as archives with their index, look every page up and read it back."""
    ready(df.sparkSession)
    pages = plain(df, id=id, url=url, html=html).withColumn("id", F.col("id").cast("long"))
    archives = write_archives(pages)
    index = write_index(archives)
    places = find(pages.select(key_column(F.col("url"), F.col("id")).alias("key")), index)
    return read_records(places, archives)


def archive_files(archives: DataFrame) -> Iterator[tuple[str, bytes]]:
    """Name and bytes of each archive, one at a time, to be written where a user wants them."""
    for row in archives.select("archive", "content").toLocalIterator():
        yield f"{row.archive}.warc.gz", bytes(row.content)

