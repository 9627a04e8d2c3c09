"""Token-id files: frequency-ranked ids in byte-aligned code with separate control bytes.

Ids are replaced by their rank in the corpus (most frequent first, then the smaller id), and a rank
takes 1 to 4 little-endian bytes; the lengths of four ranks share one control byte, and control bytes
lie apart from data bytes, so numpy finds all offsets by a table lookup and a running sum.

Layout: magic, length of the rank table, the table (uint32), then blocks. A block: number of
documents, of ids, of data bytes (int64 each); doc_ids and lengths (int64 each); control bytes; data
bytes. Blocks bound the memory of writers and readers.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import drop_stash, filesystem, fresh_dir, in_arrow, stash
from .bpe import SPLIT_ONLY, TAILS, WHITE, lower_plain, part_closing

#: Fixed value: first bytes of a file.
MAGIC = b"WEFTTOK1"
#: Entries of either half of a worker's cache from a piece of text to its ids, pieces that are
#: encoded by one call, and characters of text that are cut into pieces at once.
CACHE, CALL, CUT_CHARS = 700_000, 5_000, 2_000_000
#: Ids in a block, about.
BLOCK_IDS = 1_000_000
#: Rows of text per file, about, and the fewest files.
FILE_ROWS, LEAST_FILES = 20_000, 4
#: doc_id of a row without one, in the file.
NO_ID = np.iinfo(np.int64).min
MANIFEST = "part int, seq int, file string, n_docs long, n_tokens long"

#: Lengths of the four codes of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of ranks (uint32)."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    size = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(size) // 4) * 4, np.uint8)
    padded[: len(size)] = size
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= size[:, None]]
    return control, data


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks of :func:`pack`: lengths by table lookup, offsets by a running sum."""
    size = LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if len(more):
            out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class Encoder:
    """The tokenizers library behind a bounded cache of the ids of pieces between white space.

    No pre-token of a white-space splitting vocabulary spans white space, so a text's ids are those
    of its pieces; a text that names a special token is one piece. The cache has a young and an old
    half: a full young half becomes the old one, whose entries are taken back when they are needed, so
    frequent pieces stay. It lives as long as the worker and serves all its tasks. If the vocabulary
    gives closing punctuation ids of its own, and no case its own, which is tried when it is loaded,
    pieces are parted from that punctuation and put into lower case, so there are fewer of them.
    """

    def __init__(self, path: str):
        import os

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        added = self.library.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.mark = next(((t.content, i) for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word)), None)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.white = regex.compile(WHITE)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        whole = lambda x: self.library.encode(x, add_special_tokens=False).ids
        self.parts = all(whole(f"ab1{t} c") == whole(f"ab1 {t} c") and whole(f"ab{t} c") == whole(f"ab {t} c") for t in TAILS)
        self.lower = whole("aBÉ Ab") == whole("abé ab")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def split(self, text: str | None) -> list[str]:
        """The pieces of a text; a text with a special token is one piece."""
        if not text:
            return []
        if "<" in text and any(s in text for s in self.special):
            return [text]
        if any(c in text for c in SPLIT_ONLY):
            return [x for x in self.white.split(text) if x]
        text = part_closing(text) if self.parts else text
        return (lower_plain(text, self.special) if self.lower else text).split()

    def learn(self, pieces: list[str]) -> None:
        """Puts the ids of new pieces into the young half.

        Pieces without special tokens go to the library as one text with a special token between
        them, at which the ids are cut again.
        """
        plain = [x for x in pieces if self.mark and not ("<" in x and any(s in x for s in self.special))]
        for x in set(pieces).difference(plain):
            self.young[x] = np.asarray(self.library.encode(x, add_special_tokens=False).ids, self.kind).tobytes()
        for a in range(0, len(plain), CALL):
            some = plain[a : a + CALL]
            ids = np.asarray(self.library.encode_batch_fast([self.mark[0].join(some)], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.flatnonzero(ids == self.mark[1]) * self.kind.itemsize
            raw, at, width = ids.tobytes(), 0, self.kind.itemsize
            for x, to in zip(some, [*cuts.tolist(), len(raw)], strict=True):
                self.young[x] = raw[at:to]
                at = to + width

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of whole texts, in order."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size < CUT_CHARS):
                size += len(texts[to] or "")
                to += 1
            cut = [self.split(x) for x in texts[at:to]]
            young, old = self.young, self.old
            new = []
            for x in set().union(*cut).difference(young):
                if (ids := old.get(x)) is None:
                    new.append(x)
                else:
                    young[x] = ids
            self.learn(new)
            for pieces in cut:
                yield np.frombuffer(b"".join(map(young.__getitem__, pieces)), self.kind)
            if len(young) > CACHE:
                self.young, self.old = {}, young
            at = to


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, loaded once per worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every row: the ids of its whole text as compressed uint16 or uint32.

    No shuffle; null text is empty. Encoding costs more than all else, so it is done once and written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as z

        enc, packer = encoder(path), z.ZstdCompressor(level=1)
        for batch in batches:
            ids = [packer.compress(x.tobytes()) for x in enc.encode_all(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return stash(in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids binary"), "token-ids")


def unfold(parts: list[bytes], kind: np.dtype) -> Iterator[np.ndarray]:
    """The ids that :func:`encode` packed."""
    import zstandard as z

    engine = z.ZstdDecompressor()
    for x in parts:
        yield np.frombuffer(engine.decompress(x), kind)


def rank_table(encoded: DataFrame, size: int, kind: np.dtype, end_id: int) -> np.ndarray:
    """Ids by falling frequency in all documents, then rising id; ids that no text has follow.

    The end id counts once per row. A task adds up its own counts and sends at most one row per id of
    the vocabulary; the table has the vocabulary's size, so it is collected and sent with the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total[end_id] += batch.num_rows
            for part in _joined(unfold(batch.column(0).to_pylist(), kind)):
                total += np.bincount(part, minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    counts = in_arrow(encoded.select("ids"), run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(size, np.int64)
    total[counts["id"].to_numpy()] = counts["n"].to_numpy()
    return np.argsort(-total, kind="stable").astype("<u4")


def _joined(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    held: list[np.ndarray] = []
    for x in parts:
        held.append(x)
        if len(held) >= 200 or len(x) >= BLOCK_IDS:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int, files: int | None = None) -> DataFrame:
    """Writes the ids of all texts in rising doc_id order; returns the manifest (part, seq, file,
    n_docs, n_tokens), in whose order the files continue one another.

    Rows are range-partitioned by doc_id, so that a file holds a run of ids and no task sees more
    than its range; rows without doc_id come first, repeated rows stay. A file bears the name of its
    attempt, so repeated tasks leave no half file among those that the manifest names.
    """
    enc = encoder(path)
    size, kind = max(enc.size, end_id + 1), enc.kind
    encoded = encode(docs, path)
    table = rank_table(encoded, size, kind, end_id)
    rank = np.empty(size, "<u4")
    rank[table] = np.arange(size, dtype="<u4")
    files = files or max(LEAST_FILES, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), encoded.count() // FILE_ROWS)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n_docs, n_tokens, held, part = None, 0, 0, 0, 0
        ids: list[np.ndarray] = []
        doc_ids: list[int] = []
        end = np.array([rank[end_id]], "<u4")

        def block() -> None:
            sizes = np.array([len(x) for x in ids], "<i8")
            control, data = pack(np.concatenate(ids))
            for x in (np.array([len(ids), sizes.sum(), len(data)], "<i8"), np.array(doc_ids, "<i8"), sizes, control, data):
                out.write(x.tobytes())
            ids.clear()
            doc_ids.clear()

        for batch in batches:
            for doc_id, own, part in zip(batch.column(0).to_pylist(), unfold(batch.column(1).to_pylist(), kind), batch.column(2).to_pylist(), strict=True):  # noqa: B007
                if out is None:
                    fs, root = filesystem(folder)
                    fs.create_dir(root, recursive=True)
                    name = f"tokens-{part:06d}-{uuid.uuid4().hex}.bin"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(MAGIC + len(table).to_bytes(8, "little") + table.tobytes())
                ids.append(np.concatenate([rank[own], end]))
                doc_ids.append(NO_ID if doc_id is None else doc_id)
                n_docs, n_tokens, held = n_docs + 1, n_tokens + len(ids[-1]), held + len(ids[-1])
                if held >= BLOCK_IDS:
                    block()
                    held = 0
        if out is not None:
            if ids:
                block()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((part, pa.int32()), (0, pa.int32()), (name, pa.string()), (n_docs, pa.int64()), (n_tokens, pa.int64()))], ["part", "seq", "file", "n_docs", "n_tokens"])

    rows = encoded.repartitionByRange(files, F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids").withColumn("part", F.spark_partition_id())
    manifest = stash(in_arrow(rows, write, MANIFEST), "token-manifest")
    drop_stash(encoded)
    return manifest


def read_blocks(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, lengths, ids) of every block of a token file."""
    if stream.read(8) != MAGIC:
        raise ValueError("not a token file")
    table = np.frombuffer(stream.read(4 * int.from_bytes(stream.read(8), "little")), "<u4")
    while head := stream.read(24):
        n_docs, n_ids, n_data = np.frombuffer(head, "<i8")
        doc_ids, sizes = np.frombuffer(stream.read(16 * int(n_docs)), "<i8").reshape(2, -1)
        control = np.frombuffer(stream.read(-(-int(n_ids) // 4)), np.uint8)
        data = np.frombuffer(stream.read(int(n_data)), np.uint8)
        if len(data) != n_data or len(doc_ids) != n_docs:
            raise ValueError("the token file ends inside a block")
        yield doc_ids, sizes, table[unpack(control, data, int(n_ids))]


def read_token_files(manifest: DataFrame, folder: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and token_ids) of every document in the named files.

    ``start`` counts the ids of all documents before it: a running sum over the manifest (one row
    per file) gives each file its offset, and a reader adds up within its own file.
    """
    order = Window.orderBy("part", "seq")
    base = manifest.withColumn("base", F.sum("n_tokens").over(order) - F.col("n_tokens")).select("file", "base")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("token_ids", pa.list_(pa.int32()))] * ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    for doc_ids, sizes, values in read_blocks(stream):
                        to = np.cumsum(sizes)
                        raw = memoryview(np.ascontiguousarray(values, "<u4")).cast("B")
                        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((to - sizes).tolist(), to.tolist(), strict=True)]
                        columns = [pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(start + to - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
                        if ids:
                            columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, to].astype(np.int32)), pa.array(values.astype(np.int32))))
                        yield pa.RecordBatch.from_arrays(columns, [n for n, _ in fields])
                        start += int(to[-1])

    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<int>" * ids
    return in_arrow(base.repartition(max(1, manifest.count()), "file"), read, kinds)


def token_file_roundtrip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes the ids of every text with an end id, reads the files back: doc_id, start, n_tokens,
    ids_crc32. Null text is empty; an empty table writes no file and gives no row."""
    folder = fresh_dir(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, path, folder, end_id), folder, ids=False)
