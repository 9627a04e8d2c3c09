"""WARC archives compressed record by record with a Zstandard dictionary.

A file starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, then every record
is a frame of its own, so that one record can be read without the rest. The dictionary is built from
records of the whole table, ``SAMPLE_RECORDS`` of them by hash, ``SAMPLE_CHARS`` of each (a documented
bound; all records are then written with it), so every file has one, however few and long its records
are. A file is written under a name of its own attempt and named in the manifest that the task
returns, so a retried or speculative task leaves no half file among those that are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import filesystem, fresh_dir, in_arrow, stash

#: Fixed value: magic of the skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
#: Payloads below this many bytes are never replaced by a revisit.
LEAST_SHARED = 100
DICT_BYTES, LEVEL = 32_768, 3
#: Bound of the sample that the dictionary is built from: pages, and characters of each at a hashed place.
SAMPLE_RECORDS, SAMPLE_CHARS = 1_000, 4_000
#: Files are closed beyond FILE_BYTES of compressed records.
FILE_BYTES = 256_000_000

MANIFEST = "file string, n_records long, n_bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, refers_to (null for a response).

    Of payloads that are equal and have at least ``LEAST_SHARED`` bytes, that with the smallest
    page_id is the response. Only (digest, page_id) is aggregated, map-side first; only digests that
    occur twice are joined back, and Spark splits the partition of a digest with very many pages.
    Null html is an empty payload; pages without a page_id are responses; of repeated rows with the
    smallest page_id all are responses.
    """
    raw = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    base = pages.select("page_id", "url", raw.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    shared = base.where(F.octet_length("payload") >= LEAST_SHARED).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    shared = shared.where("first < last").select("payload_digest", "first")
    out = base.join(shared, "payload_digest", "left")
    return out.select("page_id", "url", "payload", "payload_digest", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))


def render(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record: header lines, an empty line, the block, and two line ends."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To-Page: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record; raises ValueError if it is damaged."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length differs from its header")
    return fields, rest[:n]


def sampled_records(pages: DataFrame) -> list[bytes]:
    """Rendered records of at most ``SAMPLE_RECORDS`` different payloads, those of the smallest hash,
    each with a window of at most ``SAMPLE_CHARS`` characters at a place that the hash fixes.

    Only hashes below a bound that lets about four times as many pass are ranked and cut, and what
    reaches the driver is bounded by the two numbers.
    """
    n = max(pages.count(), 1)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.xxhash64(html).alias("h")).where(F.pmod("h", F.lit(1 << 30)) < 4.0 * SAMPLE_RECORDS * (1 << 30) / n)
    more = F.greatest(F.length("html") - SAMPLE_CHARS, F.lit(0))
    part = F.substring("html", F.pmod(F.xxhash64("h"), more + 1).cast("int") + 1, F.lit(SAMPLE_CHARS))
    rows = rows.groupBy("h").agg(F.min(F.struct("page_id", "url", part.alias("part"))).alias("x")).orderBy("h").limit(SAMPLE_RECORDS)
    found = [(r["x"]["page_id"], r["x"]["url"], r["x"]["part"].encode()) for r in rows.collect()]
    return [render(page, url, part, hashlib.sha256(part).hexdigest(), None) for page, url, part in found]


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where the samples are too few or too small for training, they are one as
    they stand (raw content). Without samples, a record's fixed lines are."""
    import zstandard as z

    try:
        return z.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except z.ZstdError:
        return (b"".join(samples) or render(None, None, b"", "", None))[:DICT_BYTES]


class Writer:
    """Appends records to archive files below a folder; ``close`` gives their manifest rows."""

    def __init__(self, folder: str, dictionary: bytes, file_bytes: int = FILE_BYTES):
        import zstandard as z

        self.fs, self.folder, self.file_bytes = *filesystem(folder), file_bytes
        self.dictionary = dictionary
        self.packer = z.ZstdCompressor(level=LEVEL, write_checksum=True, dict_data=z.ZstdCompressionDict(dictionary))
        self.out = None
        self.rows: list[tuple[str, int, int]] = []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self._open()
        frame = self.packer.compress(record)
        self.out.write(frame)
        self.n += 1
        self.size += len(frame)
        if self.size >= self.file_bytes:
            self._end()

    def _open(self) -> None:
        self.name = f"part-{uuid.uuid4().hex}.warc.zst"
        self.fs.create_dir(self.folder, recursive=True)
        self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        self.out.write(DICTIONARY_MAGIC.to_bytes(4, "little") + len(self.dictionary).to_bytes(4, "little") + self.dictionary)
        self.n, self.size = 0, 8 + len(self.dictionary)

    def _end(self) -> None:
        self.out.close()
        self.rows.append((self.name, self.n, self.size))
        self.out = None

    def close(self) -> list[tuple[str, int, int]]:
        if self.out is not None:
            self._end()
        return self.rows


def read_records(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Decompressed records of an archive, one frame at a time."""
    import zstandard as z

    head = stream.read(8)
    if int.from_bytes(head[:4], "little") != DICTIONARY_MAGIC:
        raise ValueError("the archive has no dictionary frame")
    words = stream.read(int.from_bytes(head[4:], "little"))
    engine = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(words))
    data, frame, parts = stream.read(chunk), None, []
    while data:
        frame = frame or engine.decompressobj()
        parts.append(frame.decompress(data))
        if frame.eof:
            yield b"".join(parts)
            data, frame, parts = frame.unused_data or stream.read(chunk), None, []
        else:
            data = stream.read(chunk)
    if frame is not None:
        raise ValueError("the archive ends inside a record")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives below ``folder``; returns the manifest.

    One task writes the rows of its own partition, in a stream: memory is that of one batch. No shuffle
    besides that of :func:`with_revisits`. An empty table writes no file.
    """
    shared = pages.sparkSession.sparkContext.broadcast(build_dictionary(sampled_records(pages)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(folder, shared.value)
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                writer.add(render(*row))
        files, counts, sizes = zip(*done, strict=True) if (done := writer.close()) else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["file", "n_records", "n_bytes"])

    return stash(in_arrow(with_revisits(pages), write, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the files that ``manifest`` names, one task per group of files.

    The digest and length of a response are computed from the payload that was read and must equal
    its header; those of a revisit come from its header. ``payloads`` off leaves that column null.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in RECORDS.split(", ")]

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    for record in read_records(stream):
                        x, block = parse(record)
                        digest, length = x["WARC-Payload-Digest"].removeprefix("sha256:"), int(x["WARC-Payload-Length"])
                        if x["WARC-Type"] == "response":
                            if (length, digest) != (len(block), hashlib.sha256(block).hexdigest()):
                                raise ValueError(f"payload of page {x.get('WARC-Page-ID')} is damaged")
                        number = lambda k: int(x[k]) if k in x else None  # noqa: E731, B023
                        rows.append((number("WARC-Page-ID"), x.get("WARC-Target-URI"), length, digest, x["WARC-Type"], number("WARC-Refers-To-Page"), block if payloads and x["WARC-Type"] == "response" else None))
                        size += len(block) if payloads else 100
                        if size > 8_000_000:
                            yield pack(rows)
                            rows, size = [], 0
        if rows:
            yield pack(rows)

    files = manifest.select("file")
    return in_arrow(files.repartition(max(1, files.count()), "file"), read, RECORDS)


def warc_roundtrip(pages: DataFrame) -> DataFrame:
    """Writes a record per page, reads the archives back: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url."""
    folder = fresh_dir(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder)
    return read_archives(manifest, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
