"""WARC archives: write with an index, then read selected records by coalesced byte ranges.

Each task writes its rows as compressed records, one gzip member each, into files of its own
in a folder that all machines share, and returns an index row per record: file, offset,
length, URL, digest. File names are new for each attempt, so a task that runs twice leaves a
file that no index row names. The index is stored before anything is read.

A read sorts the selected index rows by file and offset, and each task merges neighbouring
records into ranges of bounded size, one read call each. Payload digests are checked.

Equal payloads are stored once: the page with the largest id holds it, the others are
revisit records that name it. Only digests are grouped; where many pages share one, its
group is a count and a maximum, merged before the shuffle.

Defined results: a null payload counts as empty; a null id never is the largest, and pages
of a payload that all have null ids are all responses, as are repeated rows of the largest
id; a null URL is left out of the record and read back as null; line breaks in a URL are
percent-encoded in the record; an empty table gives an empty index and no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.scratch import folder, stored

MAX_FILE_BYTES = 512 << 20
MAX_RANGE_BYTES = 8 << 20
MAX_GAP_BYTES = 64 << 10
TASK_BYTES = 32 << 20
#: Of decoded payloads, and rows, that a batch of records read has at most, but for its last.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2048
DATE = "1970-01-01T00:00:00Z"

INDEX = "page_id long, url string, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
RECORDS = "page_id long, url string, record_type string, payload string, payload_bytes long, payload_digest string, refers_to long"


class Page(NamedTuple):
    page_id: int | None
    url: str | None
    payload: bytes
    refers_to: int | None  # the page that holds the payload; none if this one does


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{payload_digest}')}>"


def encode(page: Page, date: str = DATE) -> tuple[bytes, str]:
    """One record as a gzip member, and its payload digest."""
    own = digest(page.payload)
    block = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(page.payload)}\r\n\r\n"
    ).encode()
    revisit = page.refers_to is not None
    if not revisit:
        block += page.payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page.page_id, own),
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{own}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page.url is not None:
        fields["WARC-Target-URI"] = page.url.replace("\r", "%0D").replace("\n", "%0A")
    if page.page_id is not None:
        fields["X-Page-Id"] = str(page.page_id)
    if revisit:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = record_id(page.refers_to, own)
        fields["X-Refers-To-Page-Id"] = str(page.refers_to)
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush(), own


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines if line)


def decode(member: bytes) -> dict:
    """A record's columns as in RECORDS. Raises if the payload is not what its digest says."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    own = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and digest(payload) != own:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page-Id"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "payload": None if revisit else payload.decode(),
        "payload_bytes": int(_fields(http)["Content-Length"]),
        "payload_digest": own,
        "refers_to": number("X-Refers-To-Page-Id"),
    }


def _arrow(rows: list[dict], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _writer(path: str, max_file_bytes: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        name, out, offset = None, None, 0
        for batch in batches:
            rows = []
            columns = [batch.column(n) for n in ("page_id", "url", "html", "refers_to")]
            for k in range(batch.num_rows):
                page_id, url, html, refers_to = (c[k].as_py() for c in columns)
                member, own = encode(Page(page_id, url, (html or "").encode(), refers_to), date)
                if out is None or offset + len(member) > max_file_bytes and offset:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(member)
                rows.append(
                    {
                        "page_id": page_id, "url": url, "payload_digest": own,
                        "record_type": "response" if refers_to is None else "revisit",
                        "refers_to": refers_to, "file": name, "offset": offset, "length": len(member),
                    }
                )
                offset += len(member)
            yield _arrow(rows, INDEX)
        if out is not None:
            out.close()

    return write


def write_archive(
    pages: DataFrame, path: str, max_file_bytes: int = MAX_FILE_BYTES, date: str = DATE
) -> DataFrame:
    """Archive `pages` (page_id, url, html) under `path`, a URI that pyarrow can open from every
    executor, and return the stored index (INDEX)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html",
        F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha1"),
    )
    shared = stored(
        rows.groupBy("sha1")
        .agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("rows"))
        .filter("rows > 1 and holder is not null")
        .drop("rows"),
        "warc-shared",
    )
    marked = rows.join(shared, "sha1", "left").select(
        "page_id", "url", "html",
        F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder")).alias("refers_to"),
    )
    return stored(marked.mapInArrow(_writer(path, max_file_bytes, date), INDEX), "warc-index")


def _ranges(rows, max_range: int, max_gap: int):
    """Runs of (file, offset, length), sorted, that one read serves."""
    run, start, end = [], 0, 0
    for file, offset, length in rows:
        fits = (
            run
            and run[0][0] == file
            and offset - end <= max_gap
            and max(end, offset + length) - start <= max_range
        )
        if not fits:
            if run:
                yield run[0][0], start, end, run
            run, start, end = [], offset, offset
        run.append((file, offset, length))
        end = max(end, offset + length)
    if run:
        yield run[0][0], start, end, run


def _reader(path: str, max_range: int, max_gap: int, payloads: bool, batch_bytes: int = BATCH_BYTES):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)

        def rows():
            for batch in batches:
                yield from zip(
                    batch.column("file").to_pylist(),
                    batch.column("offset").to_pylist(),
                    batch.column("length").to_pylist(),
                    strict=True,
                )

        name, source = None, None
        for file, start, end, run in _ranges(rows(), max_range, max_gap):
            if file != name:
                if source is not None:
                    source.close()
                name, source = file, store.open_input_file(f"{root}/{file}")
            data, records, held = source.read_at(end - start, start), [], 0
            for _, offset, length in run:
                record = decode(data[offset - start : offset - start + length])
                held += len(record["payload"] or "")
                records.append(record if payloads else record | {"payload": None})
                # Decoded payloads can be many times as large as the range.
                if held > batch_bytes or len(records) >= BATCH_ROWS:
                    yield _arrow(records, RECORDS)
                    records, held = [], 0
            if records:
                yield _arrow(records, RECORDS)
        if source is not None:
            source.close()

    return read


def read_records(
    index: DataFrame,
    path: str,
    payloads: bool = True,
    max_range: int = MAX_RANGE_BYTES,
    max_gap: int = MAX_GAP_BYTES,
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """The records (RECORDS) that rows of an index name, read in order of file and offset."""
    wanted = index.select("file", "offset", "length")
    size = wanted.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, -(-size // task_bytes))
    ordered = wanted.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_reader(path, max_range, max_gap, payloads), RECORDS)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written, indexed, and read back from the archives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = folder(spark, "warc")
    index = write_archive(pages, path)
    return read_records(index, path, payloads=False, task_bytes=4 << 20).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP10_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages
), d as (
  select *, max(page_id) over (partition by hex) as holder from p
)
select page_id, octet_length(encode(html))::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((instr('0123456789abcdef', substr(hex, (5 * i // 4 + 1)::int, 1)) - 1) * 256
    + (instr('0123456789abcdef', substr(hex, (5 * i // 4 + 2)::int, 1)) - 1) * 16
    + greatest(instr('0123456789abcdef', substr(hex || '0', (5 * i // 4 + 3)::int, 1)) - 1, 0))
    // [128, 64, 32, 16][(5 * i % 4 + 1)::int] % 32 + 1)::int, 1)), '') as payload_digest,
  case when page_id = holder then 'response' else 'revisit' end as record_type,
  case when page_id <> holder then holder end as refers_to
from d
"""
