"""Web archives (WARC/1.1) in Zstandard: a dictionary built from the records leads each file in a skippable frame, and
each record is a frame of its own.

Of records with equal payloads, of `least` bytes or more, that with the smallest id is a response and the others are
revisits that refer to it.  Files are written by the tasks straight into the target folder, under names that no other
attempt uses; a manifest lists those of the attempts that succeeded, and only they are read.

Defined cases: a null payload is empty; a null URL is written as urn:page:<id>; rows that repeat an id are written each,
as the same kind of record; a row with a null id is a response; other columns are not read; an empty table gives no
file.  With too few records for a dictionary, files have none.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, look_up, new_dir, small_batches, staged

#: Fixed values of the format.
DICTIONARY_FRAME = 0x184D2A5D
VERSION, HTTP = b"WARC/1.1\r\n", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Records that the dictionary is built from, at most, and the longest payload among them.
SAMPLE, SAMPLE_BYTES = 1000, 1 << 16
DICTIONARY_BYTES = 1 << 16
#: Compressed bytes after which a task begins another file.
FILE_BYTES = 1 << 28
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'urn:page:{page}')}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit of another page's."""
    http = HTTP % len(payload)
    block = http if refers_to is not None else http + payload
    target = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else f"urn:page:{page}"
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page),
        "WARC-Date": DATE,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http; msgtype=response",
        "X-Payload-Length": str(len(payload)),
    }
    if page is not None:
        fields["X-Page-ID"] = str(page)
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-ID": str(refers_to)}
    fields["Content-Length"] = str(len(block))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


class Archive:
    """One file of individually compressed records."""

    def __init__(self, out, dictionary: bytes | None, level: int = 3):
        import zstandard

        self.out, self.size = out, 0
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=known) if known else zstandard.ZstdCompressor(level=level)
        if dictionary:
            self._put(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
        info = b"format: WARC File Format 1.1\r\n"
        head = f"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
        self.add(VERSION + head.encode() + info + b"\r\n\r\n")

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.compressor.compress(data))


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of every record of an archive."""
    import zstandard

    head = source.read(8)
    known, rest = None, head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        data = source.read(struct.unpack("<I", head[4:])[0])
        if data[:4] == zstandard.FRAME_HEADER:
            data = zstandard.ZstdDecompressor().decompress(data)
        known, rest = zstandard.ZstdCompressionDict(data), b""
    raw = io.BufferedReader(_Joined(rest, source), 1 << 18)
    decompressor = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    stream = io.BufferedReader(decompressor.stream_reader(raw, read_across_frames=True, closefd=False), 1 << 18)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield fields, block


class _Joined(io.RawIOBase):
    """Bytes already read, then the rest of a file."""

    def __init__(self, first: bytes, source):
        self.first, self.source = first, source

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.first[: len(into)] or self.source.read(len(into))
        self.first = self.first[len(data) :] if self.first else b""
        into[: len(data)] = data
        return len(data)


def build_dictionary(payloads: list[bytes], size: int = DICTIONARY_BYTES) -> bytes | None:
    import zstandard

    samples = [record(i, None, p, None) for i, p in enumerate(payloads)]
    if len(samples) < 16 or sum(map(len, samples)) < 8 * 1024:
        return None
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return None


def dictionary_of(pages: DataFrame) -> bytes | None:
    """A dictionary from the records whose ids hash smallest."""
    fit = pages.filter(F.octet_length("payload") <= SAMPLE_BYTES)
    most = fit.select(F.xxhash64("id").alias("h")).orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    if most is None:
        return None
    rows = fit.filter(F.xxhash64("id") <= most).select(F.xxhash64("id").alias("h"), "payload").limit(2 * SAMPLE).toArrow().sort_by("h")
    return build_dictionary([(p or "").encode() for p in rows["payload"].to_pylist()[:SAMPLE]])


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Writes all rows as archives and returns the manifest: path, n_records, n_bytes.  `folder` is a URI that driver
    and executors share; by default a new one under the shared folder."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or new_dir(spark, "warc")
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    slim = staged(p.select("id", F.sha1(F.encode("payload", "UTF-8")).alias("d"), F.octet_length("payload").alias("n")).filter(F.col("n") >= least).distinct(), "digests")
    same = staged(slim.groupBy("d", "n").agg(F.min("id").alias("first"), F.count("*").alias("n_rows")).filter("n_rows > 1"), "same")
    revisits = look_up(slim, same, ["d", "n"], slim.count()).filter("first < id").select("id", "d", F.col("first").alias("refers_to"))
    dictionary = dictionary_of(p)
    held = spark.sparkContext.broadcast(dictionary)
    rows = p.withColumn("d", F.sha1(F.encode("payload", "UTF-8"))).join(revisits, ["id", "d"], "left").select("id", "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        out = archive = None
        path, n = "", 0

        def close() -> None:
            out.close()
            done.append((path, n, archive.size))

        for batch in batches:
            for page, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive is None:
                    path, n = f"{root}/{uuid.uuid4().hex}.warc.zst", 0
                    out = system.open_output_stream(path)
                    archive = Archive(out, held.value)
                archive.add(record(page, url, payload.encode(), refers_to))
                n += 1
                if archive.size >= FILE_BYTES:
                    close()
                    archive = None
        if archive is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done, strict=True)], names=["path", "n_records", "n_bytes"])

    return staged(rows.mapInArrow(lean(run), "path string, n_records long, n_bytes long").withColumn("folder", F.lit(folder)), "manifest")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def read(manifest: DataFrame) -> DataFrame:
    """All page records of the archives in a manifest, digests checked; a revisit's payload is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, _ = fs.FileSystem.from_uri(folder)
                rows: list[tuple] = []
                held = 0
                with system.open_input_stream(path) as source:
                    for fields, block in records(source):
                        kind = fields["warc-type"]
                        if kind == "warcinfo":
                            continue
                        found, size, payload = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"]), None
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if digest(payload) != found or len(payload) != size:
                                raise ValueError(f"a payload in {path} isn't what its record says")
                        page, other = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                        rows.append((None if page is None else int(page), fields["warc-target-uri"], size, found, kind, None if other is None else int(other), None if payload is None else payload.decode()))
                        held += len(block)
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = manifest.select("path", "folder")
    n = max(1, files.count())
    return files.repartition(min(n, 10_000)).mapInArrow(lean(run), READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    names = [x.split()[0] for x in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
