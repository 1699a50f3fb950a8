"""Deterministic sharded WARC writer and its reader.

Pages are range-sorted by page_id and payload hash into shards whose bounds come from exact sums of bytes in that order (and not from samples), so the same table gives the same
files, byte for byte, however it was partitioned, and neither far-off identifiers nor one that many pages share make a shard larger than others (repeated rows alone stay together, and are streamed). A task writes each of its shards in order, one gzip member per record, and begins a new file when the compressed
size reaches the roll size. Headers and digests are made anew: block and payload SHA-1 in base32, record identifiers from content. Of equal payloads the page with the largest
page_id is a response and the others revisit it. Files are written under temporary names; the rows of those tasks that succeeded form the manifest, files that it
lists are renamed, and the manifest, written last, commits the archive. Files of lost or repeated attempts are not listed, so no reader sees them.

Defined cases: a null html is an empty payload; a null url leaves out WARC-Target-URI; a null page_id leaves out the page header, sorts first, and never is what others revisit unless all pages with
that payload lack it (then one is the response, and refers_to stays null); of repeated rows of the owning page one is the response and the others revisit it; an empty table gives an archive without files; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, written

#: Raw payload bytes in a shard, at least and about; compressed bytes after which a file ends.
SHARD_BYTES, ROLL_BYTES = 48 << 20, 32 << 20
#: Shards at most, so that the list of where they begin stays small: of more data each shard has more, and rolls more files.
MOST_SHARDS = 20_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, seq int, temp string, name string, n_records long, n_bytes long, sha256 string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def record(kind: str, block: bytes, headers: list[tuple[str, object]]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers if v is not None), f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, owner, revisit: bool, nth: int) -> bytes:
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    safe = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    headers = [("WARC-Record-ID", record_id("page", page_id, digest, nth)), ("WARC-Target-URI", safe), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload)), ("X-Page-ID", page_id)]
    if not revisit:
        return record("response", http + payload, headers)
    return record("revisit", http, [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("page", owner, digest, 0)), ("X-Refers-To-Page-ID", owner)])


def member(data: bytes) -> bytes:
    """One gzip member without time or name."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def records(stream, size: int = 1 << 20):
    """(headers, block) of each gzip member of a stream; bounded by the largest record."""
    z, raw, data = zlib.decompressobj(31), [], stream.read(size)
    while data:
        raw.append(z.decompress(data))
        if z.eof:
            whole = b"".join(raw)
            head, _, rest = whole.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            n = int(headers["Content-Length"])
            if lines[0] != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
                raise ValueError("not a WARC record")
            yield headers, rest[:n]
            data, z, raw = z.unused_data, zlib.decompressobj(31), []
            if data:
                continue
        data = stream.read(size)


def bounds(small: DataFrame, shard_bytes: int) -> list[tuple]:
    """Of rows (page_id, key, n): where each shard begins, as (page_id, key), in order; from exact sums of n in that order, however rows lie. A shard has shard_bytes, about, or as many as make MOST_SHARDS."""
    units = small.groupBy("page_id", "key").agg(F.sum("n").alias("n"))
    units = written(units.repartitionByRange("page_id", "key").withColumn("part", F.spark_partition_id()), "units")
    parts = units.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each partition
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    here = F.sum("n").over(Window.partitionBy("part").orderBy("page_id", "key")) - F.col("n")
    size = F.greatest(F.lit(shard_bytes), F.ceil(F.col("total") / MOST_SHARDS))
    at = units.withColumn("here", here).join(F.broadcast(before), "part").withColumn("shard", F.floor((F.col("before") + F.col("here")) / size))
    return sorted((_place(r[0], r[1]) for r in at.groupBy("shard").agg(F.min(F.struct("page_id", "key")).alias("first")).select("first.page_id", "first.key").collect()))


def _place(page_id, key) -> tuple:
    return page_id is not None, page_id or 0, key


def write(pages: DataFrame, folder: str, least: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as an archive in folder, a URI; returns the manifest. Payloads under `least` bytes are never revisits."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html, 256).alias("key"))
    small = written(rows.select("page_id", "key", (F.octet_length("html").cast("long") + 512).alias("n")), "payloads")
    owners = small.groupBy("key").agg(F.max("page_id").alias("owner"), F.count("*").alias("copies"))
    begins = bounds(small, shard_bytes)

    @F.arrow_udf("int")
    def shard_of(page_id: pa.Array, key: pa.Array) -> pa.Array:
        return pa.array([bisect_right(begins, _place(i, k)) - 1 for i, k in zip(page_id.to_pylist(), key.to_pylist(), strict=True)], pa.int32())

    # Payloads are shuffled once: who owns a payload comes to its shard as a row of its own, sorted before the pages that it is about.
    who = small.select("page_id", "key").distinct().join(owners, "key").select("page_id", "key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), "owner", "copies")
    both = who.unionByName(rows.withColumns({"kind": F.lit(1), "owner": F.lit(None).cast("long"), "copies": F.lit(None).cast("long")}))
    dealt = both.select(shard_of("page_id", "key").alias("shard"), "page_id", "key", "kind", "url", "html", "owner", "copies")
    dealt = dealt.repartitionById(max(1, len(begins)), F.col("shard")).sortWithinPartitions("shard", "page_id", "key", "kind", "url")

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(f"{root}/_temporary", recursive=True)
        at, out, last, owner, copies = None, None, None, None, 1
        state = {"shard": -1, "seq": 0}

        def begin(shard):
            state.update(seq=state["seq"] + 1 if state["shard"] == shard else 0, shard=shard, n=0, bytes=0, sha=hashlib.sha256())
            state["name"] = f"part-{shard:05d}-{state['seq']:05d}.warc.gz"
            state["temp"] = f"_temporary/{state['name']}.{uuid.uuid4().hex}"
            state["out"] = fs.open_output_stream(f"{root}/{state['temp']}", compression=None)
            put(record("warcinfo", b"software: loomgraph\r\nformat: WARC File Format 1.1\r\n", [("WARC-Record-ID", record_id("info", state["name"])), ("WARC-Filename", state["name"]), ("Content-Type", "application/warc-fields")]))

        def put(data):
            z = member(data)
            state["out"].write(z)
            state["sha"].update(z)
            state["bytes"] += len(z)

        def end():
            state["out"].close()
            cells = [[state[k]] for k in ("shard", "seq", "temp", "name", "n", "bytes")] + [[state["sha"].hexdigest()]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["shard", "seq", "temp", "name", "n_records", "n_bytes", "sha256"])

        nth = 0
        for b in batches:
            for cells in zip(*(b.column(i) for i in range(8)), strict=True):
                shard, page, key, kind, url, payload, new, n_new = (x.as_py() for x in cells)
                if kind == 0:
                    owner, copies = new, n_new
                    continue
                if out and (shard != at or state["bytes"] >= roll_bytes):
                    yield end()
                    out = None
                if not out:
                    begin(shard)
                    at, out = shard, True
                nth = nth + 1 if last == (page, key) else 0
                last = (page, key)
                put(page_record(page, url, payload, owner, copies > 1 and len(payload) >= least and (page != owner or nth > 0), nth))
                state["n"] += 1
        if out:
            yield end()

    spark = pages.sparkSession
    staged = f"{folder}/_staged"
    map_arrow(dealt, run, MANIFEST).write.parquet(staged)
    manifest = spark.read.schema(MANIFEST).parquet(staged)

    def move(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for temp, name, size in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(5).to_pylist(), strict=True):
                if fs.get_file_info(f"{root}/{name}").size != size:  # else an earlier attempt has moved it
                    fs.move(f"{root}/{temp}", f"{root}/{name}")
            yield b

    map_arrow(manifest, move, MANIFEST).write.parquet(f"{folder}/_manifest")
    fs, root = pafs.FileSystem.from_uri(folder)
    for x in ("_temporary", "_staged"):
        if fs.get_file_info(f"{root}/{x}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{x}")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Page records of the files in the manifest: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to, file. Digests of blocks and payloads are verified."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    files = max(1, manifest.count())

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "file"]
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        number = lambda x: None if x is None else int(x)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for h, block in records(stream):
                        if h["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                            raise ValueError(f"{name}: a block does not have its digest")
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2] if h["WARC-Type"] == "response" else None
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if payload is not None and digest != base32_sha1(payload):
                            raise ValueError(f"{name}: a payload does not have its digest")
                        rows.append((number(h.get("X-Page-ID")), h.get("WARC-Target-URI"), payload, int(h["X-Payload-Length"]), digest, h["WARC-Type"], number(h.get("X-Refers-To-Page-ID")), name))
                        held += len(payload or b"")
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return map_arrow(manifest.select("name").repartition(files, "name"), run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, file string")
