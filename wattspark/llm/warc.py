"""WARC: whole-file gzip archives, their normalisation to one member a record, and reading by offset.

A crawl is written as monolithic gzip files: one stream over all records. The normaliser inflates such a stream once, from front
to back, turns repeated payloads into revisit records, rewrites each record as a gzip member of its own, and writes
beside the archive an index with a line a record: page id, offset and length of its member. Readers can then seek to any record.

Which records are revisits is decided from digests alone: pages themselves are never shuffled. Names hold the task's attempt, and only
names in a saved manifest count, so a lost executor costs no more than its tasks.

Records follow WARC/1.1: a file begins with its warcinfo, a block is an HTTP response, ids are UUIDs made from the place in the crawl, and a
revisit has the response's HTTP head and names the record that has the payload. Page ids are fields of their own (X-Page-ID).

Nulls: null html is an empty payload; a null url is written as an empty one; a null page_id orders before all others. Repeated page
rows give a record each. Empty table: no archive, no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import functions as F

from . import textkit as K

#: Payloads of at least this many bytes can be revisited.
LEAST_REVISIT = 0
CRAWL_SCHEMA = "file string, page_id long, payload_bytes long, payload_digest string, seq long"
INDEX_SCHEMA = "archive string, page_id long, offset long, length long"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_CHUNK = 1 << 16


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


#: Between an HTTP head and the payload.
_BLANK = b"\r\n\r\n"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # names that are URLs, RFC 9562


def record_id(place: str) -> str:
    """The id of the record at a place (file and number in it): unique, and the same whenever it is made."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, place)}>"


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}".encode() + _BLANK


def record(kind: str, id_: str, page_id: int | None, url: str, date: str, payload: bytes, digest_: str, refers_to: tuple[str, int | None] | None = None) -> bytes:
    """A WARC/1.1 record; its block is an HTTP response. A revisit has that response's head alone and names the record (id, page) with the payload."""
    block = http_head(len(payload)) + (b"" if kind == "revisit" else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {id_}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest_}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {refers_to[0]}", f"X-Refers-To-Page-ID: {'' if refers_to[1] is None else refers_to[1]}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + _BLANK + block + _BLANK


def info(place: str, date: str) -> bytes:
    """The warcinfo record that begins a file."""
    block = b"software: wattspark\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(place + '#info')}", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _BLANK + block + _BLANK


def payload_of(block: bytes) -> tuple[int, bytes]:
    """(length of the payload by the HTTP head, what follows the head)."""
    head, _, body = block.partition(_BLANK)
    return int(_fields(head.decode("utf-8", "replace"))["content-length"]), body


def _fields(head: str) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.split("\r\n")[1:])}


def _parse_head(raw: bytes) -> dict[str, str]:
    if not raw.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    return _fields(raw.decode("utf-8", "replace"))


def records(stream):
    """(head, block) of each record of an inflated stream; holds one record at a time."""
    held = bytearray()

    def more() -> bool:
        data = stream.read(_CHUNK)
        held.extend(data)
        return bool(data)

    while True:
        end = held.find(b"\r\n\r\n")
        while end < 0:
            start = max(0, len(held) - 3)
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a record")
                return
            end = held.find(b"\r\n\r\n", start)
        head = _parse_head(bytes(held[:end]))
        size = end + 4 + int(head["content-length"])
        while len(held) < size + 4:
            if not more():
                raise ValueError("the archive ends within a record")
        yield head, bytes(held[end + 4 : size])
        del held[: size + 4]


def _page(text: str | None) -> int | None:
    return int(text) if text else None


class _Inflated(io.RawIOBase):
    """The bytes of a gzip file of one or more members."""

    def __init__(self, raw):
        self.raw, self.z = raw, zlib.decompressobj(31)

    def read(self, size: int = -1) -> bytes:
        while True:
            data = self.z.unconsumed_tail or self.z.unused_data
            if self.z.eof:
                if not data and not (data := self.raw.read(_CHUNK)):
                    return b""
                self.z = zlib.decompressobj(31)
            elif not data and not (data := self.raw.read(_CHUNK)):
                return b""
            if out := self.z.decompress(data, 1 << 20):
                return out


def write_monolithic(pages, spark, folder: str, date: str | None = None):
    """Writes the pages of each task as response records in one gzip stream; returns a saved row a record (CRAWL_SCHEMA). date: now, in UTC, by default."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches):
        from pyspark import TaskContext

        fs, at = K.filesystem(folder)
        fs.create_dir(at, recursive=True)
        context = TaskContext.get()
        name = f"crawl-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        z, seq, out = zlib.compressobj(1, zlib.DEFLATED, 31), 0, None
        try:
            for batch in batches:
                rows = {k: [] for k in ("file", "page_id", "payload_bytes", "payload_digest", "seq")}
                for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    if out is None:
                        out = fs.open_output_stream(f"{at}/{name}", compression=None)
                        out.write(z.compress(info(f"{folder}/{name}", date)))
                    payload = (html or "").encode()
                    found = digest(payload)
                    out.write(z.compress(record("response", record_id(f"{folder}/{name}#{seq}"), page_id, url or "", date, payload, found)))
                    for k, v in zip(rows, (f"{folder}/{name}", page_id, len(payload), found, seq)):
                        rows[k].append(v)
                    seq += 1
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("file", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("seq", pa.int64())]))
        finally:
            if out is not None:
                out.write(z.flush())
                out.close()

    return K.saved(pages.select("page_id", "url", "html").mapInArrow(K.tidy(write), CRAWL_SCHEMA), spark, "warc-crawl")


def with_decisions(crawl, least: int = LEAST_REVISIT):
    """Adds refers_to: the smallest page_id with the same payload, where that is another record; null for responses."""
    key = F.struct(F.col("page_id"), F.col("file"), F.col("seq"))
    firsts = crawl.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.min(key).alias("first"))
    found = crawl.join(firsts, ["payload_digest", "payload_bytes"], "left")
    return found.withColumn("revisit", F.col("first").isNotNull() & (F.col("first") != key)).withColumn("refers_to", F.when(F.col("revisit"), F.col("first"))).drop("first")


def _dealt(rows, count: int):
    """Rows over so many tasks, four a shuffle partition at most: few bytes that stand for much work are not to be merged."""
    return rows.repartition(max(1, min(count, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def normalise(decided, spark, folder: str):
    """Rewrites each monolithic file with a member a record and a sidecar index; returns the saved rows of all indexes."""

    def rewrite(batches):
        from pyspark import TaskContext

        out_fs, out_at = K.filesystem(folder)
        out_fs.create_dir(out_at, recursive=True)
        for batch in batches:
            for file, told in zip(batch.column("file").to_pylist(), batch.column("told").to_pylist()):
                refers = {x["seq"]: (record_id(f"{x['refers_to']['file']}#{x['refers_to']['seq']}"), x["refers_to"]["page_id"]) for x in told}
                name = f"{file.rsplit('/', 1)[1].split('.')[0]}-{TaskContext.get().taskAttemptId()}.warc.gz"
                fs, at = K.filesystem(file)
                offset, index = 0, {k: [] for k in ("archive", "page_id", "offset", "length")}
                with fs.open_input_stream(at, compression=None) as source, out_fs.open_output_stream(f"{out_at}/{name}", compression=None) as out:
                    seq = 0
                    for head, block in records(_Inflated(source)):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        if head["warc-type"] == "warcinfo":
                            member = z.compress(info(f"{folder}/{name}", head["warc-date"])) + z.flush()
                            out.write(member)
                            offset += len(member)
                            continue
                        page_id, (_, payload) = _page(head["x-page-id"]), payload_of(block)
                        made = record("revisit" if seq in refers else "response", head["warc-record-id"], page_id, head["warc-target-uri"], head["warc-date"], payload, head["warc-payload-digest"].removeprefix("sha1:"), refers.get(seq))
                        member = z.compress(made) + z.flush()
                        out.write(member)
                        for k, v in zip(index, (f"{folder}/{name}", page_id, offset, len(member))):
                            index[k].append(v)
                        offset += len(member)
                        seq += 1
                with out_fs.open_output_stream(f"{out_at}/{name}.idx") as side:
                    side.write("".join(f"{p if p is not None else ''} {o} {n}\n" for p, o, n in zip(index["page_id"], index["offset"], index["length"])).encode())
                yield pa.RecordBatch.from_pydict(index, schema=pa.schema([("archive", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))

    # A file has as many records as one task wrote, so what is gathered here is bounded by a split of the input.
    files = decided.groupBy("file").agg(F.collect_list(F.when(F.col("revisit"), F.struct("seq", "refers_to"))).alias("told"))
    return K.saved(_dealt(files, decided.select("file").distinct().count()).mapInArrow(K.tidy(rewrite), INDEX_SCHEMA), spark, "warc-index")


def read_archives(index):
    """Reads every record of the archives by the sidecar indexes; payload length and digest are taken from the block where there is one."""

    def read(batches):
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                fs, at = K.filesystem(archive)
                rows = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
                with fs.open_input_stream(f"{at}.idx") as f:
                    entries = [line.split(" ") for line in f.read().decode().splitlines()]
                with fs.open_input_file(at) as f:
                    for page, offset, length in entries:
                        f.seek(int(offset))
                        (head, block), *rest = records(io.BytesIO(zlib.decompress(f.read(int(length)), 31)))
                        if rest or head["x-page-id"] != page:
                            raise ValueError(f"the index of {archive} doesn't fit it")
                        kind = head["warc-type"]
                        named, (size, payload) = head["warc-payload-digest"].removeprefix("sha1:"), payload_of(block)
                        if kind == "response" and (digest(payload) != named or len(payload) != size):
                            raise ValueError(f"page {page}: the payload has another digest or length")
                        for k, v in zip(rows, (_page(head["x-page-id"]), size, named, kind, _page(head.get("x-refers-to-page-id")))):
                            rows[k].append(v)
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    archives = index.select("archive").distinct()
    return _dealt(archives, archives.count()).mapInArrow(K.tidy(read), RECORD_SCHEMA)


def op3_warc_normaliser(spark, sf_dir):
    """Every row of `pages` as a record, written, normalised and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = K.shared_dir(spark, "warc")
    crawl = write_monolithic(pages, spark, f"{folder}/crawl")
    index = normalise(with_decisions(crawl), spark, f"{folder}/archive")
    fs, at = K.filesystem(f"{folder}/crawl")
    if fs.get_file_info(at).type.name == "Directory":
        fs.delete_dir(at)  # the normalised archives replace it
    return read_archives(index)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, h, sha1(h) AS hex, strlen(h) AS n, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS FIRST) AS r, first_value(page_id) OVER (PARTITION BY h ORDER BY page_id NULLS FIRST) AS f FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
 list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (
  list_sum(list_transform(range(0, 5), lambda b: ((instr('0123456789abcdef', substr(hex, ((5 * i + b) // 4 + 1)::INT, 1)) - 1) >> (3 - (5 * i + b) % 4)::INT & 1) << (4 - b)::INT)) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
 CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r > 1 THEN f END AS refers_to
FROM k
"""
