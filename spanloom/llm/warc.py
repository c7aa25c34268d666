"""WARC archives with Zstandard dictionaries.

One dictionary is built from a sample over all records. The writer makes one or more ``.warc.zst``
files per partition: each begins with a skippable frame that holds the dictionary, then every
record is a frame of its own, so that any can be read alone. Payloads that are equal byte for byte
are written once as a response and otherwise as revisits of it. The reader takes the dictionary
from the file's head and streams the records; both sides hold one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, new_path

#: Skippable frame that a dictionary comes in.
MAGIC = 0x184D2A5D
#: Fixed, so that reruns write equal bytes.
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "path string, records long, bytes long"
RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long,"
    " payload_digest string, payload binary, intact boolean"
)
#: What a header line can't hold as it is: line ends and other controls, and blanks at either end.
_NOT_IN_A_LINE = re.compile(r"[\x00-\x1f\x7f]|^\s|\s$|^$")


def payloads_of(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload`` (UTF-8) and ``digest`` (SHA-1, hex)."""
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    return p.withColumn("digest", F.sha1("payload"))


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The columns of ``payloads_of`` and ``refers_to``: for a payload of at least
    ``least_bytes`` that others share, the largest page_id among them, unless it is the row's own.
    Digests find who may be equal, bytes decide."""
    p = payloads_of(pages)
    often = p.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.count("*").alias("rows")).where("rows > 1")
    often = materialize(often.select("digest"), "op2-digests")
    # Equal payloads combine before they are shuffled; only those with a digest that repeats are.
    same = p.join(often, "digest", "left_semi").groupBy("digest", "payload").agg(F.max("page_id").alias("keep"), F.count("*").alias("rows"))
    # Written first, so that the join is one of plain shuffles, in which a frequent payload is split.
    same = materialize(same.where("rows > 1").select("digest", F.col("payload").alias("shared"), "keep"), "op2-same")
    p = p.join(same, (p["digest"] == same["digest"]) & (F.col("payload") == F.col("shared")), "left").drop(same["digest"])
    return p.select(
        "page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")).alias("refers_to")
    )


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def page_urn(page_id) -> str:
    return "<urn:page:null>" if page_id is None or pd.isna(page_id) else f"<urn:page:{int(page_id)}>"


def page_record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """The response or, with ``refers_to``, the revisit record of a page. The HTTP head of a
    revisit still tells the payload's length. A url that no header line can hold comes as JSON in
    a header of its own, next to one without blanks and controls."""
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", page_urn(page_id)), ("WARC-Date", date)]
    if url is not None:
        if _NOT_IN_A_LINE.search(url):
            headers += [("WARC-Target-URI", re.sub(r"[\s\x00-\x1f\x7f]", "", url)), ("X-Target-JSON", json.dumps(url))]
        else:
            headers.append(("WARC-Target-URI", url))
    headers += [("WARC-Payload-Digest", f"sha1:{b32}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None or pd.isna(refers_to):
        return _record("response", headers, http + payload)
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return _record("revisit", [*headers, ("WARC-Profile", profile), ("WARC-Refers-To", page_urn(refers_to))], http)


def build_dictionary(
    pages: DataFrame, samples: int = 1_000, piece_bytes: int = 8_192, dict_bytes: int = 65_536, date: str = DATE
) -> bytes:
    """A dictionary of at most ``dict_bytes``, built in one task from records of at most ``samples`` pages of
    ``payloads_of``, which are drawn by hash from all of them. A payload above ``piece_bytes`` gives one piece from a hashed
    place. Records that are too few or too alike to train on become a raw-content dictionary."""
    n = pages.count()
    order = F.xxhash64("page_id", "url")
    room = F.greatest(F.octet_length("payload") - piece_bytes, F.lit(0)) + 1
    piece = F.substr("payload", (F.pmod(F.xxhash64("page_id", F.lit(1)), room) + 1).cast("int"), F.lit(piece_bytes))
    some = pages.where(F.pmod(order, F.lit(max(n, 1))) < 2 * samples)
    some = some.select(order.alias("o"), "page_id", "url", piece.alias("payload"), "digest").orderBy("o").limit(samples)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        records = [
            page_record(*row, None, date) for pdf in batches for row in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["digest"])
        ]
        if records:
            try:
                made = zstandard.train_dictionary(dict_bytes, records).as_bytes()
            except zstandard.ZstdError:
                made = b"".join(records)[-dict_bytes:]
            yield pd.DataFrame({"dictionary": [made]})

    found = some.coalesce(1).mapInPandas(train, "dictionary binary").first()
    return bytes(found["dictionary"]) if found else b""


def write_archives(
    pages: DataFrame, learned: bytes, file_bytes: int = 1 << 30, level: int = 3, date: str = DATE
) -> DataFrame:
    """Write the pages of ``with_revisits`` as archives with the dictionary ``learned`` into the shared
    folder; returns the manifest ``path, records, bytes``.

    Each task attempt writes under names of its own, and the manifest has those of the attempts
    that succeeded.
    """
    folder = new_path(pages.sparkSession, "op2-warc")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        ctx = TaskContext.get()
        stem = f"part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        z = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(learned))
        info = _record("warcinfo", [("WARC-Record-ID", "<urn:info:0>"), ("WARC-Date", date)], b"format: WARC/1.1\r\n")
        rows = (
            page_record(*row, date)
            for pdf in batches
            for row in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["digest"], pdf["refers_to"])
        )
        done = []
        record = next(rows, None)
        while record is not None:
            name, count = f"{stem}-{len(done)}.warc.zst", 0
            # The frames are compressed here: the stream must not guess from the name and do it again.
            with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                size = out.write(struct.pack("<II", MAGIC, len(learned)) + learned)
                size += out.write(z.compress(info))
                while record is not None and (not count or size < file_bytes):
                    size += out.write(z.compress(record))
                    count += 1
                    record = next(rows, None)
            # With the folder's scheme and host, by which a reader finds the same store.
            done.append((f"{folder}/{name}", count, size))
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return materialize(pages.select("page_id", "url", "payload", "digest", "refers_to").mapInPandas(write, MANIFEST), "op2-manifest")


def open_archive(fs: pafs.FileSystem, path: str):
    """The dictionary at an archive's head, and the stream behind it."""
    f = fs.open_input_stream(path, compression=None)
    magic, length = struct.unpack("<II", f.read(8))
    if magic != MAGIC:
        raise ValueError(f"{path} doesn't begin with a dictionary")
    return zstandard.ZstdCompressionDict(f.read(length)), f


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record of an uncompressed stream."""
    f = io.BufferedReader(stream, 1 << 20)
    while True:
        line = f.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record where one should begin: {line[:40]!r}")
        head = {}
        while (line := f.readline().decode().rstrip("\r\n")):
            k, _, v = line.partition(": ")
            head[k] = v
        block = f.read(int(head["Content-Length"]))
        if f.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where it should")
        yield head, block


def _page_of(urn: str | None):
    return None if urn is None or urn == "<urn:page:null>" else int(urn[len("<urn:page:") : -1])


def read_archives(manifest: DataFrame, payloads: bool = True, batch_bytes: int = 16_000_000) -> DataFrame:
    """The response and revisit records of the archives in ``manifest``: ``page_id, url, record_type,
    refers_to, payload_bytes`` and ``payload_digest`` (of the full payload, also for revisits),
    ``payload`` (null for revisits, or if not wanted) and ``intact``: a response's payload has its
    length and digest, a revisit brings none."""
    folders = max(1, manifest.count())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for path in (p for pdf in batches for p in pdf["path"]):
            fs, base = pafs.FileSystem.from_uri(path)
            dictionary, f = open_archive(fs, base)
            with f:
                z = zstandard.ZstdDecompressor(dict_data=dictionary)
                rows, held = [], 0
                for head, block in records_of(z.stream_reader(f, read_across_frames=True)):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    http, _, body = block.partition(b"\r\n\r\n")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = head["WARC-Type"] == "revisit"
                    if revisit:
                        good = not body
                    else:
                        good = len(body) == length and base64.b32encode(hashlib.sha1(body).digest()).decode() == digest
                    url = json.loads(head["X-Target-JSON"]) if "X-Target-JSON" in head else head.get("WARC-Target-URI")
                    rows.append((
                        _page_of(head["WARC-Record-ID"]), url, head["WARC-Type"],
                        _page_of(head.get("WARC-Refers-To")), length, digest, body if payloads and not revisit else None, good,
                    ))
                    held += len(body) if payloads else 200
                    if held >= batch_bytes:
                        yield _frame(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows, names)

    return manifest.select("path").repartition(folders, "path").mapInPandas(read, RECORD)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives, read them back, and return the records without payloads:
    ``page_id, payload_bytes, payload_digest`` (upper-case base32 SHA-1), ``record_type, refers_to``.

    Null html is an empty payload; equal payloads of at least ``least_bytes`` bytes are stored once,
    by the largest page_id. A null page_id is archived and never referred to unless all of a group
    are null: then they are all responses. Rows that repeat the largest page_id with its payload
    are responses too. Urls come back as they were; a null url is left out. No rows give no
    archives and no rows. Other columns are not archived. A response that doesn't have its digest
    when read back, or a revisit whose response isn't there with that digest and length, fails the job.
    """
    learned = build_dictionary(payloads_of(pages))
    back = read_archives(write_archives(with_revisits(pages, least_bytes), learned), payloads=False)
    back = materialize(back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"), "op2-records")
    responses = back.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    lost = back.where("record_type = 'revisit'").join(responses, ["refers_to", "payload_bytes", "payload_digest"], "left_anti")
    if not back.where("not intact").isEmpty() or not lost.isEmpty():
        raise ValueError("a payload lost its digest, or a revisit its response")
    return back.drop("intact")
