"""BPE encoding and decoding with a public vocabulary file.

A word's symbols form a doubly linked list; a priority queue holds the ranks of the merges between
neighbours, and an entry whose symbols have changed since is stale and skipped. Decoding concatenates
vocabulary strings. A text is cut at white space first: no pre-token spans it, so the ids of every
such piece are kept in a bounded cache and a text is the join of its pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import begin, give_back, in_arrow

#: Pieces and words in the young half of their caches; a full one becomes the old half, from which
#: entries that are needed are taken back.
CACHE, WORDS = 100_000, 30_000
#: White space of the normalizer, and control characters that str.split also cuts at.
WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
SPLIT_ONLY = ("\x1c", "\x1d", "\x1e", "\x1f")
#: ASCII punctuation at the end of a piece: behind a letter or digit, and two of it.
CLOSING = re.compile(r"(?<=[^\W_])([!-/:-@\[-`{-~]+)(?=\s)")
DOUBLE = re.compile(r"[!-/:-@\[-`{-~]{2}\s")
#: Tails that are tried to see whether a vocabulary parts closing punctuation from words.
TAILS = (*(chr(c) for c in range(33, 127) if not chr(c).isalnum()), "!?.", "%%%", "'.")


def part_closing(text: str) -> str:
    """The text with a space before punctuation that closes a word."""
    return CLOSING.sub(r" \1", text) if DOUBLE.search(text) else text.replace(". ", " . ").replace(", ", " , ")


def lower_plain(text: str, special) -> str:
    """The text in lower case, unless that depends on neighbours or makes a special token."""
    if "Σ" in text:
        return text
    low = text.lower()
    return text if "<" in low and any(s in low for s in special) else low


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, others from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {b: chr(b) for b in shown}
    rest = iter(range(256, 512))
    return [out.get(b) or chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file with lower case, word ends and byte letters."""

    def __init__(self, path: str):
        import regex

        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.token = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.white = regex.compile(WHITE)
        self.letters = byte_letters()
        self.words: dict[str, tuple[int, ...]] = {}
        self.old_words: dict[str, tuple[int, ...]] = {}
        whole = lambda x: [i for p in x.split() for i in self.encode_piece(p)]
        self.apart = all(whole(f"ab1{t} c") == whole(f"ab1 {t} c") and whole(f"ab{t} c") == whole(f"ab {t} c") for t in TAILS)
        self.lower = whole("aBÉ Ab") == whole("abé ab")
        self.pieces: dict[str, tuple[int, str, str]] = {}
        self.old_pieces: dict[str, tuple[int, str, str]] = {}

    def cut_by_library(self, piece: str) -> list[str]:
        """Pre-tokens, in byte letters, of a piece with characters that this Python's Unicode tables do
        not know: which of them are letters is for the library's newer tables to say."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return [x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))]

    def merge(self, word: str, lettered: bool = False) -> tuple[int, ...]:
        """Ids of one pre-token, which may be in byte letters already."""
        symbols = list(word) if lettered else [self.letters[b] for b in word.encode()]
        symbols[-1] += self.end
        ids = [self.vocab[s] for s in symbols if s in self.vocab]
        n = len(ids)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        queue = []
        for i in range(n - 1):
            if found := self.merges.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, new = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j >= n or (found := self.merges.get((ids[i], ids[j]))) is None or found[1] != new:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if found := self.merges.get((new, ids[after[i]])):
                    heapq.heappush(queue, (found[0], i, found[1]))
            if (p := before[i]) >= 0 and (found := self.merges.get((ids[p], new))):
                heapq.heappush(queue, (found[0], p, found[1]))
        return tuple(x for x, a in zip(ids, alive, strict=True) if a)

    def normal(self, piece: str) -> str:
        """Composed form, then lower case letter by letter."""
        piece = unicodedata.normalize("NFC", piece)
        return piece.lower() if "Σ" not in piece else "".join(c.lower() for c in piece)

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a text without white space and special tokens."""
        out: list[int] = []
        if not piece.isprintable():
            return tuple(i for x in self.cut_by_library(piece) for i in self.merge(x, lettered=True))
        for word in self.token.findall(self.normal(piece)):
            ids = self.words.get(word)
            if ids is None:
                if len(self.words) >= WORDS:
                    self.words, self.old_words = {}, self.words
                ids = self.words[word] = self.old_words.get(word) or self.merge(word)
            out += ids
        return tuple(out)

    def split(self, text: str) -> list[str]:
        """Pieces between white space; parted from closing punctuation and in lower case, if that gives
        the same ids, so that there are fewer different ones."""
        if any(c in text for c in SPLIT_ONLY):
            return [x for x in self.white.split(text) if x]
        text = part_closing(text) if self.apart else text
        return (lower_plain(text, self.special) if self.lower else text).split()

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text between special tokens, with None, and the special tokens with their id."""
        at = 0
        for m in self.cut.finditer(text) if self.cut and "<" in text else ():
            yield text[at : m.start()], None
            yield m.group(), self.special[m.group()]
            at = m.end()
        yield text[at:], None

    def known(self, piece: str) -> tuple[int, str, str]:
        """Number of ids of a piece, its ids in decimal and its decoded text, each joined by spaces."""
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= CACHE:
                self.pieces, self.old_pieces = {}, self.pieces
            found = self.old_pieces.get(piece)
            if found is None:
                ids = self.encode_piece(piece)
                found = len(ids), " ".join(map(str, ids)), self.decode(ids)
            self.pieces[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of a text; empty for an empty one."""
        out: list[int] = []
        for part, special in self.parts(text):
            if special is not None:
                out.append(special)
            else:
                for piece in self.split(part):
                    out += self.encode_piece(piece)
        return out

    def decode(self, ids) -> str:
        """The vocabulary strings of the ids, joined by a space."""
        return " ".join([self.strings[i] for i in ids])

    def digest(self, text: str) -> tuple[int, str, str]:
        """n_tokens, ids in decimal and decoded text, joined from the pieces."""
        found: list[tuple[int, str, str]] = []
        known = self.known
        for part, special in self.parts(text):
            if special is not None:
                found.append((1, str(special), self.strings[special]))
            else:
                get = self.pieces.get
                found += [get(x) or known(x) for x in self.split(part)]
        found = [x for x in found if x[0]]
        return sum([x[0] for x in found]), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The encoder of a file, loaded once per worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def forget() -> None:
    """Drops the encoders and their caches from this worker."""
    _loaded.clear()


#: Documents whose results are held at once.
ROWS = 200


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, token_ids (array<int>), decoded (string) for every row.

    Null text is empty: 0 tokens, no ids, empty decoded text. Whole texts of any length are encoded
    in place, without a shuffle; repeated rows give equal rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("bpe", forget)
        bpe = load(path)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                some = batch.slice(a, ROWS)
                found = [bpe.digest(x or "") for x in some.column(1).to_pylist()]
                ids = [np.fromstring(x[1], np.int32, sep=" ") if x[0] else np.zeros(0, np.int32) for x in found]
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([x[0] for x in found], pa.int64()), lists, pa.array([x[2] for x in found], pa.string())], ["doc_id", "n_tokens", "token_ids", "decoded"])
        give_back()

    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, token_ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; nulls as in :func:`encode_documents`."""

    def sha(x: str) -> str:
        return hashlib.sha256(x.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("bpe", forget)
        bpe = load(path)
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                n, ids, decoded = bpe.digest(text or "")
                found.append((n, sha(ids), sha(decoded)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        give_back()

    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
