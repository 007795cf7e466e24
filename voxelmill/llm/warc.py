"""WARC archives: a deterministic sharded writer, and a reader that tests digests."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches
from .permutation import with_row_numbers
from .shared import fresh_path, stored

SHARD_RECORDS = 4096
ROLL_BYTES = 16 << 20
#: Tasks that read archives at most; with more files a task reads several, one after the other.
MOST_READERS = 20_000
#: Tasks that write archives at most; with more shards a task writes several in a row, one after the other.
MOST_WRITERS = 65_536
DATE = "2024-01-01T00:00:00Z"
MANIFEST_FIELDS = "shard long, file string, records long, bytes long, sha256 string, first_id long, last_id long"
RECORD_FIELDS = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, file string, error string"


def open_store(path: str):
    """The file system of a path that all machines share, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(page_id: int | None, digest: str, repeat: int) -> str:
    """Unique for every record: rows may repeat an id with another payload, or a whole row."""
    return f"<urn:x-page:{'none' if page_id is None else page_id}:{digest}{f':{repeat}' if repeat else ''}>"


def record_bytes(page_id, url, payload: bytes, refers_to, repeat: int = 0, date: str = DATE) -> bytes:
    """One record, compressed on its own. A revisit keeps the HTTP header, with the payload's length, and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    address = " ".join((url or "about:blank").split()) or "about:blank"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_urn(page_id, base32_sha1(payload), repeat)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {address}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_urn(refers_to, base32_sha1(payload), 0)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


class ShardWriter:
    """Files of one shard, under temporary names until ``commit``; a new file begins when the next record would pass ``roll`` bytes."""

    def __init__(self, root: str, shard: int, roll: int):
        self.fs, self.root = open_store(root)
        self.shard, self.roll, self.files, self.out = shard, roll, [], None
        self.attempt = f"{self.root}/_temporary/{uuid.uuid4().hex}"
        self.fs.create_dir(self.attempt, recursive=True)

    def add(self, page_id, record: bytes) -> None:
        if self.out is None or self.files[-1]["bytes"] + len(record) > self.roll:
            self.close()
            self.files.append({"shard": self.shard, "file": f"shard-{self.shard:06d}-{len(self.files):05d}.warc.gz", "records": 0, "bytes": 0, "first_id": page_id, "hash": hashlib.sha256()})
            self.out = self.fs.open_output_stream(f"{self.attempt}/{self.files[-1]['file']}", compression=None)
        self.out.write(record)
        last = self.files[-1]
        last["hash"].update(record)
        last |= {"records": last["records"] + 1, "bytes": last["bytes"] + len(record), "last_id": page_id}

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None

    def commit(self) -> list[dict]:
        """Moves the files to their names, then the manifest; a shard counts as written once its manifest is there."""
        self.close()
        rows = [{k: v for k, v in f.items() if k != "hash"} | {"sha256": f["hash"].hexdigest()} for f in self.files]
        for row in rows:
            self.fs.move(f"{self.attempt}/{row['file']}", f"{self.root}/{row['file']}")
        with self.fs.open_output_stream(f"{self.attempt}/manifest.json") as out:
            out.write(json.dumps(rows, sort_keys=True).encode())
        self.fs.move(f"{self.attempt}/manifest.json", f"{self.root}/shard-{self.shard:06d}.manifest.json")
        self.fs.delete_dir(self.attempt)
        return rows


def write_warc(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    payload: str = "html",
    url: str | None = "url",
    least_revisit_bytes: int = 0,
    shard_records: int = SHARD_RECORDS,
    roll_bytes: int = ROLL_BYTES,
    most_writers: int = MOST_WRITERS,
) -> DataFrame:
    """Writes all rows as records to ``path``, a folder that all machines share, and returns the manifest (a row for each file).

    Records are numbered in order of id, then digest; each ``shard_records`` numbers in a row make a shard, so the files'
    names and bytes depend on the rows alone. At most ``most_writers`` tasks write, each its run of whole shards, whose first
    keys the driver sends to all. Of records with equal payloads of at least ``least_revisit_bytes`` bytes
    the one with the smallest id is a response and the others revisit it. Null payloads are empty ones. Null ids come
    first, are responses and are never referred to; a repeated row of the response is a response too. Rows of one id with
    other payloads are records of their own. Other columns of ``pages`` may have any names; an empty table gives no files.
    """
    html = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), (F.col(url) if url else F.lit(None)).cast("string").alias("url"), html.alias("payload"), F.sha1(html).alias("sha1"))
    sizes = rows.select("page_id", "sha1", F.length("payload").cast("long").alias("payload_bytes"))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered, total = with_row_numbers(sizes, ["page_id", "sha1"], "number", parts)
    originals = numbered.filter((F.col("payload_bytes") >= least_revisit_bytes) & F.col("page_id").isNotNull()).groupBy("sha1").agg(F.min("page_id").alias("original"))
    plan = (
        numbered.groupBy("page_id", "sha1")
        .agg(F.min("number").alias("number"), F.max("payload_bytes").alias("payload_bytes"))
        .join(originals, "sha1", "left")
        .select(
            F.floor(F.col("number") / shard_records).cast("long").alias("shard"),
            "page_id",
            "sha1",
            F.when((F.col("payload_bytes") >= least_revisit_bytes) & (F.col("original") < F.col("page_id")), F.col("original")).alias("refers_to"),
        )
    )
    plan = stored(plan, "warc-plan")
    shards = -(-total // shard_records)
    each = max(1, -(-shards // most_writers))
    writer_of = F.floor(F.col("shard") / each).cast("int")
    bounds = plan.groupBy(writer_of.alias("writer")).agg(F.min(F.struct("page_id", "sha1")).alias("first"))
    firsts = [(r["writer"], r["first"]["page_id"], r["first"]["sha1"]) for r in bounds.orderBy("writer").collect()]  # at most one for each writer
    records = rows.withColumn("writer", range_of(F.col("page_id"), F.col("sha1"), firsts).cast("int"))
    decisions = plan.select(writer_of.alias("writer"), "shard", "page_id", "sha1", "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), F.lit(0).alias("kind"))
    # records take their shard from the decision that stands before them
    both = decisions.unionByName(records.select("writer", F.lit(-1).cast("long").alias("shard"), "page_id", "sha1", F.lit(None).cast("long").alias("refers_to"), "url", "payload", F.lit(1).alias("kind")))
    dealt = both.repartitionById(max(1, min(shards, most_writers)), F.col("writer")).sortWithinPartitions("page_id", "sha1", "kind", "url")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer, key, refers_to, repeat, place = None, None, None, 0, -1
        for batch in batches:
            for shard, id_, sha1, refers, address, data, kind in batch.itertuples(index=False):
                id_ = None if id_ is None else int(id_)
                if kind == 0:
                    key, refers_to, repeat, place = (id_, sha1), None if refers is None else int(refers), 0, int(shard)
                    continue
                if key != (id_, sha1):
                    raise ValueError(f"no decision for page {id_}")
                if writer is None or writer.shard != place:
                    if writer is not None:
                        yield manifest_rows(writer.commit())
                    writer = ShardWriter(path, place, roll_bytes)
                writer.add(id_, record_bytes(id_, address, bytes(data), refers_to, repeat))
                repeat += 1
        if writer is not None:
            yield manifest_rows(writer.commit())

    # ids travel as text, since pandas would make floats of numbers with nulls
    sent = dealt.select("shard", F.col("page_id").cast("string"), "sha1", F.col("refers_to").cast("string"), "url", "payload", "kind")
    return stored(small_batches(sent).mapInPandas(write, MANIFEST_FIELDS), "warc-manifest")


def manifest_rows(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows)[[f.split()[0] for f in MANIFEST_FIELDS.split(", ")]].astype({"first_id": "Int64", "last_id": "Int64"})


def range_of(page_id: Column, sha1: Column, firsts: list[tuple]) -> Column:
    """The number of the range of (id, digest) that holds a row; ``firsts`` are the ranges' numbers and first keys, nulls first."""
    from bisect import bisect_right

    lowest = -(1 << 63)
    keys = [(lowest if i is None else i, s) for _, i, s in firsts]
    numbers = [n for n, *_ in firsts]

    @F.pandas_udf("long")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ids, digests in batches:
            at = (bisect_right(keys, key) - 1 for key in zip(ids.tolist(), digests, strict=True))
            yield pd.Series([numbers[max(a, 0)] for a in at], dtype="int64")

    return place(F.coalesce(page_id, F.lit(lowest)), sha1)


def urn_id(urn: str | None) -> int | None:
    part = urn[len("<urn:x-page:") : -1].split(":")[0] if urn else "none"
    return None if part == "none" else int(part)


def parse_record(data: bytes) -> dict:
    """A record's fields; ``error`` says which digest is wrong, if one is."""
    head, _, block = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kept = fields["WARC-Type"] == "response"
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    wrong = "block digest" if "sha1:" + base32_sha1(block) != fields["WARC-Block-Digest"] else "payload digest" if kept and base32_sha1(payload) != stated else None
    return {
        "page_id": urn_id(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "refers_to": urn_id(fields.get("WARC-Refers-To")),
        "payload": payload if kept else None,
        "payload_bytes": int(http.rpartition(b"Content-Length: ")[2]),
        "payload_digest": stated,
        "error": wrong,
    }


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream one by one, each uncompressed."""
    rest = b""
    while rest or (rest := stream.read(1 << 20)):
        unpack, out = zlib.decompressobj(31), io.BytesIO()
        while not unpack.eof:
            if not rest and not (rest := stream.read(1 << 20)):
                raise EOFError("a record is cut")
            out.write(unpack.decompress(rest))
            rest = unpack.unused_data
        yield out.getvalue()


def read_warc(manifest: DataFrame, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the manifest's files under ``path``; a file is read as a stream, record by record."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_store(path)
        names = [f.split()[0] for f in RECORD_FIELDS.split(", ")]
        for batch in batches:
            for file in batch["file"]:
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    for data in members(stream):
                        row = parse_record(data) | {"file": file}
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(data) if with_payload else 256
                        if held > 8 << 20:
                            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    # a stated number, since rows this small would all be put into one task otherwise
    return manifest.select("file").repartition(max(1, min(manifest.count(), MOST_READERS)), "file").mapInPandas(read, RECORD_FIELDS)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Writes all pages as records, reads the archives back, and returns what their headers and payloads say."""
    path = fresh_path(spark, "warc")
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = read_warc(manifest, path, with_payload=False)
    tested = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("damaged record: "), F.col("error")))).otherwise(F.col("payload_digest"))
    return records.select("page_id", "payload_bytes", tested.alias("payload_digest"), "record_type", "refers_to")
