"""WARC archives whose records are compressed one by one with a shared Zstandard dictionary.

A task cuts its rows into archives of a bounded size. For each archive it builds a dictionary from evenly spread records
of that archive, writes it in a leading skippable frame, and then writes every record as a frame of its own. Records
with equal payloads of at least ``revisit_bytes`` are written once: that of the largest page id as ``response``, the
others as ``revisit`` records that name it. Files are opened through Arrow's file systems, so that the folder may be any
shared store; a task's files count only when the task has ended well (their names go through Spark's own commit), and
files of lost attempts are never read.

Defined results: a null html is the empty payload; a null url leaves out the target; control characters and blanks in
urls are percent-encoded; rows with a null page id never stand for others but may revisit; of repeated rows with the
largest page id each is a response; an empty table gives no archive and an empty result; very long payloads are one
record each, in an archive of their own where they exceed its bound; every archive has a dictionary, that of one with
too little to learn from holds its records' own first bytes; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import fresh_path, materialize

#: Fixed value: first bytes of the skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
SCHEMA = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, record_id string, archive string"
NAME = "urn:cadenza:page"
#: With fewer sampled records than this, slices of so many bytes are sampled in their place.
FEW_SAMPLES, SLICE = 64, 2048


def with_decisions(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """page_id, url, html with payload_digest, payload_bytes, and refers_to for those that revisit another page."""
    raw = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(raw).alias("payload_digest"), F.octet_length(raw).cast("long").alias("payload_bytes"))
    counted = rows.where(F.col("payload_bytes") >= revisit_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("stands"), F.count("*").alias("n"))
    # written first: then its true size decides between a broadcast and a shuffled join, which Spark splits where skewed
    repeated = materialize(counted.where("n > 1 AND stands IS NOT NULL").select("payload_digest", "stands"), "repeated")
    same = F.col("stands").eqNullSafe(F.col("page_id"))
    return rows.join(repeated, "payload_digest", "left").withColumn("refers_to", F.when(~same, F.col("stands"))).drop("stands")


def record(page_id: int | None, url: str | None, html: str | None, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + (html or "").encode() if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{NAME}:{'' if page_id is None else page_id}:{digest}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <{NAME}:{refers_to}:{digest}>")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def made_dictionary(records: list[bytes], dictionary_bytes: int, sample_bytes: int) -> zstandard.ZstdCompressionDict:
    """From evenly spread records: trained on slices of them, or of their own bytes where they are too few to learn from."""
    step = max(1, -(-sum(map(len, records)) // sample_bytes))
    sample = records[::step]
    if len(sample) < FEW_SAMPLES:  # few or large records: evenly spread slices of all of them
        slices = [r[k : k + SLICE] for r in records for k in range(0, len(r), SLICE)]
        sample = slices[:: max(1, -(-len(slices) * SLICE // sample_bytes))]
    try:
        return zstandard.train_dictionary(dictionary_bytes, sample, k=200, d=8, steps=1)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[:dictionary_bytes], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(out, records: list[bytes], dictionary_bytes: int, sample_bytes: int, level: int) -> None:
    dictionary = made_dictionary(records, dictionary_bytes, sample_bytes)
    data = dictionary.as_bytes()
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data)
    packer = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
    for r in records:
        out.write(packer.compress(r))


def read_archive(file) -> Iterator[bytes]:
    """The records, one frame after the other."""
    head = file.read(8)
    dictionary = None  # archives of other writers may have none
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
        dictionary = zstandard.ZstdCompressionDict(file.read(struct.unpack("<I", head[4:])[0]))
        head = b""
    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    left = head
    while True:
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            left = left or file.read(1 << 16)
            if not left:
                break
            parts.append(frame.decompress(left))
            left = frame.unused_data if frame.eof else b""
        if not frame.eof:
            if any(parts):
                raise ValueError("an archive ends within a record")
            return
        yield b"".join(parts)


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")

    def page(name: str) -> int | None:
        number = fields.get(name, "").strip("<>").removeprefix(NAME + ":").split(":")[0]
        return int(number) if number else None

    return {"page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload_digest": digest, "payload_bytes": size, "refers_to": page("WARC-Refers-To"), "record_id": fields["WARC-Record-ID"].strip("<>"), "payload": payload}


def write(decided: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 16 << 20, dictionary_bytes: int = 1 << 16, sample_bytes: int = 1 << 20, level: int = 3) -> DataFrame:
    """Archives of the rows of ``with_decisions``; the written table of (archive, records)."""
    rows = decided.select("page_id", "url", "html", "payload_digest", "payload_bytes", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        held, size, number = [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, number
            path = f"{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
            with store.open_output_stream(f"{base}/{path}") as out:
                write_archive(out, held, dictionary_bytes, sample_bytes, level)
            done = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path}"]), pa.array([len(held)], pa.int64())], names=["archive", "records"])
            held, size, number = [], 0, number + 1
            return done

        for batch in batches:
            for k in range(batch.num_rows):
                one = record(*(batch.column(c)[k].as_py() for c in range(6)), date)
                if held and size + len(one) > archive_bytes:
                    yield close()
                held.append(one)
                size += len(one)
        if held:
            yield close()

    return materialize(rows.mapInArrow(run, "archive string, records long"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """A row for each record of the named archives, payloads checked against their digests."""
    files = max(1, archives.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, where = fs.FileSystem.from_uri(path)
                with store.open_input_stream(where) as file:
                    rows = [parse_record(r) | {"payload": None, "archive": path} for r in read_archive(file)]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

    return archives.select("archive").repartition(min(files, 10_000)).mapInArrow(run, SCHEMA)


def roundtrip(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """The records of ``pages`` as read back from archives in a fresh folder; the archives stay, they are the output."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read(write(with_decisions(pages, revisit_bytes), folder))
