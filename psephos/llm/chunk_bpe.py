"""Byte-level BPE encoding by the tokenizers library, with chunks that documents share encoded once.

Texts are cut where a rolling hash of the last 16 bytes says so, so equal passages are cut alike
wherever they stand.  Chunks seen more than once are encoded once, from one copy of their text; everything else is
encoded where it stands.  Documents that hold no such chunk never leave the scan.

A chunk's tokens are those of the whole text except near its ends, because the pattern that splits texts
into words reads on by a few characters only, and each match begins where the last one ended.  So a join is
repaired by encoding again from the last sure start of a word before the cut into the next chunk.  Once a
word begins there at the same byte as in the chunk's own encoding, both agree from there on; without
agreement the chunk is taken in as text and a longer stretch is encoded.

The library takes most of its time to split texts into words.  Words are therefore split here by the same pattern
and looked up among those that its model has coded before, at most ``WORDS`` of them.  Which characters the
pattern takes alike in both places is tried out when the vocabulary is loaded, and a text with any other character goes
to the library as it is.

Special tokens in a text are tokens, as the library has it, and nothing is joined across them.  Defined
cases: a null or empty text has no tokens; rows are told apart by a number, so repeated and null ids are rows
like others; an empty table gives no rows.  Other columns are not read.  Chunks are told apart by 128-bit digests.
"""
from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm.bpe import shipped
from psephos.llm.tables import by_block, columns
from psephos.llm.text import Texts
from psephos.sources import stored

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Bytes of a chunk at least and at most, and one place in so many is a cut between.
LEAST, MOST, RARITY = 256, 8192, 512
#: Bytes of text that are encoded in one piece.
PIECE = 1 << 16
#: Places of the filter that tells chunks seen once from others; it travels as one bit each.
FILTER = 1 << 26
#: A match is sure if it ends so many bytes before the end; the pattern reads on by two characters.
MARGIN = 12
#: Word starts remembered at the front of a chunk.
HEAD = 16
#: Words remembered with their ids, and the characters tried out, up to this one.
WORDS = 1 << 18
TRIED = 0x3000

_GEAR = np.random.default_rng(20240911).integers(0, 1 << 16, 256, dtype=np.uint16)


@dataclass
class Piece:
    """A coded stretch of text: ids, and word starts as (token, byte) near its front and its last sure one."""

    ids: np.ndarray
    head: np.ndarray
    tail: tuple[int, int]

    def marks(self) -> bytes:
        return np.concatenate([np.asarray(self.tail), self.head.ravel()]).astype("<i4").tobytes()

    @staticmethod
    def read(ids: bytes, marks: bytes, kind: str) -> "Piece":
        numbers = np.frombuffer(marks, "<i4")
        return Piece(np.frombuffer(ids, kind), numbers[2:].reshape(-1, 2), (int(numbers[0]), int(numbers[1])))


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Bytes with a visible character in Latin-1 stand for themselves, the others for characters from 256 on.
    """
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _spelled_out(pattern: str) -> re.Pattern:
    """The splitting pattern with its classes of characters listed, up to ``TRIED``, for the faster of two modules."""

    def listed(belongs: Callable[[str], bool]) -> str:
        inside = np.asarray([0, *(belongs(chr(c)) for c in range(TRIED)), 0], np.int8)
        edges = np.flatnonzero(np.diff(inside)).reshape(-1, 2).tolist()
        return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in edges)

    letters, numbers = (listed(lambda c, kind=kind: unicodedata.category(c)[0] == kind) for kind in "LN")
    spaces = listed(lambda c: c.isspace() and not "\x1c" <= c <= "\x1f")
    for old, new in (
        (r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]"), (r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"),
        (r"\S", f"[^{spaces}]"), (r"\s", f"[{spaces}]"),
    ):
        pattern = pattern.replace(old, new)
    return re.compile(pattern)


class Coder:
    """The library's tokenizer of one file, and what joining pieces needs to know about its tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        split, added = described["pre_tokenizer"] or {}, described["added_tokens"]
        simple = all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in added)
        if described["normalizer"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or not simple:
            raise ValueError("only byte-level vocabularies without normalizer or prefix space can be joined")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        names = sorted((x["content"] for x in added), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        byte_of = _byte_of()
        tokens = self.library.get_vocab(with_added_tokens=True)
        whole = set(names)
        self.bytes = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.bytes[i] = token.encode() if token in whole else bytes(byte_of[c] for c in token)
        self.lengths = np.asarray([len(x) for x in self.bytes], np.int64)
        self.kind = "<u2" if len(self.bytes) <= 1 << 16 else "<u4"
        self.digits = [str(i) for i in range(len(self.bytes))]
        self.character = {b: c for c, b in byte_of.items()}
        self.pattern = _spelled_out(public_tokenizers.PATTERN)
        self.known: dict[str, bytes] = {}
        self.other = re.compile("[" + "".join(map(re.escape, self._taken_differently())) + f"{chr(TRIED)}-\U0010ffff]")

    def _taken_differently(self) -> list[str]:
        """The characters tried that the library's pattern puts into another class than the one used here."""

        def alike(characters: list[str]) -> bool:
            # After a letter, a digit and a mark: it goes on with its own class only.
            text = "".join(f"\na{c}\n1{c}\n!{c}" for c in characters)
            return self.pattern.findall(text) == [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

        out = []
        for first in range(0, TRIED, 256):
            characters = [chr(c) for c in range(first, min(first + 256, TRIED))]
            if not alike(characters):
                out += [c for c in characters if not alike([c])]
        return out

    def words(self, text: str) -> list[bytes] | None:
        """The ids of each word of ``text``, or nothing if it has characters that only the library can split by."""
        if self.other.search(text) or (self.special and self.special.search(text)):
            return None
        words = self.pattern.findall(text)
        found = list(map(self.known.get, words))
        for i in (i for i, x in enumerate(found) if x is None):
            word = words[i]
            ids = self.known.get(word)
            if ids is None:
                shown = "".join(map(self.character.__getitem__, word.encode()))
                ids = np.asarray([token.id for token in self.library.model.tokenize(shown)], self.kind).tobytes()
                if len(self.known) < WORDS:
                    self.known[word] = ids
            found[i] = ids
        return found

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """The stretches of ``text`` between special tokens, and these tokens (True)."""
        found = self.special.split(text) if self.special else [text]
        return [(part, i % 2 == 1) for i, part in enumerate(found) if part]

    def special_piece(self, token: str) -> Piece:
        ids = np.asarray([self.library.token_to_id(token)], self.kind)
        return Piece(ids, np.zeros((0, 2), np.int64), (0, 0))

    def coded(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of ``text`` on its own, the token that begins each word, and its byte."""
        words = self.words(text)
        if words is None:
            found = self.library.encode(text, add_special_tokens=False)
            ids = np.asarray(found.ids, self.kind)
            first = np.flatnonzero(np.diff(np.asarray(found.word_ids, np.int64), prepend=-1))
        else:
            ids = np.frombuffer(b"".join(words), self.kind)
            counts = np.fromiter(map(len, words), np.int64, len(words)) // ids.itemsize
            first = np.cumsum(counts) - counts
        return ids, first, np.cumsum(self.lengths[ids])[first] - self.lengths[ids[first]]

    def pieces(self, texts: list[str]) -> list[Piece]:
        """Each text coded on its own, as if it were whole."""
        out = []
        for text in texts:
            ids, first, at = self.coded(text)
            sure = max(int(np.searchsorted(at, len(text.encode()) - MARGIN, side="right")) - 1, 0)
            tail = (int(first[sure]), int(at[sure])) if len(first) else (0, 0)
            out.append(Piece(ids, np.stack([first, at], 1)[:HEAD], tail))
        return out

    def raw(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def _meeting(self, tail: bytes, piece: Piece) -> tuple[np.ndarray, int] | None:
        """Ids of ``tail`` and of ``piece`` up to a word start where both agree, and the piece's token there."""
        if not len(piece.head):
            return None
        front = self.raw(piece.ids[: int(piece.head[-1, 0]) + MARGIN])
        stretch = (tail + front).decode("utf-8", "ignore")  # the front may end within a character
        size = len(stretch.encode())
        ids, first, at = self.coded(stretch)
        _, here, there = np.intersect1d(at[at <= size - MARGIN] - len(tail), piece.head[:, 1], return_indices=True)
        if not len(here):
            return None
        return ids[: int(first[here[0]])], int(piece.head[there[0], 0])

    def joined(self, pieces: Iterable[Piece]) -> np.ndarray:
        """The ids of the text that the pieces make up, none of them special, exactly."""
        out: list[np.ndarray] = []
        last: Piece | None = None  # ids from the last sure start on, which hold if nothing follows
        tail, owed, begun = b"", 0, 0
        for piece in pieces:
            if not len(piece.ids):
                continue
            if last is None and not tail:
                begun = 0
            elif owed > 0:
                taken = self.raw(piece.ids)
                tail, owed, last = tail + taken, owed - len(taken), None
                continue
            else:
                met = self._meeting(tail, piece)
                if met is None:
                    # What is owed doubles, so that long stretches without agreement are not encoded over and over.
                    tail, last = tail + self.raw(piece.ids), None
                    owed = len(tail) if len(tail) > 2 * MOST else 0
                    continue
                out.append(met[0])
                begun = met[1]
            sure = max(begun, piece.tail[0])
            out.append(piece.ids[begun:sure])
            last = Piece(piece.ids[sure:], piece.head, piece.tail)
            tail = self.raw(last.ids)
        if last is not None:
            out.append(last.ids)
        elif tail:
            out.append(self.coded(tail.decode())[0])
        return np.concatenate(out) if out else np.zeros(0, self.kind)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts, the long ones in pieces."""
        out = []
        for text in texts:
            if len(text) <= PIECE:
                words = self.words(text)
                out.append(self.coded(text)[0] if words is None else np.frombuffer(b"".join(words), self.kind))
                continue
            ids = [
                self.special_piece(part).ids if special
                else self.joined(p for a in range(0, len(part), PIECE) for p in self.pieces([part[a : a + PIECE]]))
                for part, special in self.parts(text)
            ]
            out.append(np.concatenate(ids))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist(), skip_special_tokens=False)

    def rows(self, schema: pa.Schema, names: pa.Array, all_ids: list[np.ndarray]) -> pa.RecordBatch:
        """The rows of the result for documents with these ids."""
        written, decoded = [], []
        for x in all_ids:
            ids = x.tolist()
            written.append(hashlib.sha256(",".join(map(self.digits.__getitem__, ids)).encode()).hexdigest())
            decoded.append(hashlib.sha256(self.library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        lengths, ids = [len(x) for x in all_ids], [x.astype("<u4").tobytes() for x in all_ids]
        return columns(schema, id=names, n_tokens=lengths, ids=ids, ids_sha256=written, decoded_sha256=decoded)


@functools.lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def cuts(data: np.ndarray) -> np.ndarray:
    """The places before which the rolling hash of 16 bytes allows a cut; none is within a character."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):  # sums of twice as many bytes each time
        h[step:] += h[:-step] << np.uint16(step)
    at = np.flatnonzero((h >> np.uint16(6)) % np.uint16(RARITY) == 0) + 1
    at = at[at < len(data)]
    return at[(data[at] & 0xC0) != 0x80]


def bounds(data: np.ndarray, allowed: np.ndarray, start: int, end: int, least: int = LEAST, most: int = MOST) -> list[int]:
    """Where the chunks of ``data[start:end]`` begin, and the end; each is within the limits if it can be."""
    out = [start]
    at = int(np.searchsorted(allowed, start))
    while end - out[-1] > least:
        at += int(np.searchsorted(allowed[at:], out[-1] + least))
        stop = int(allowed[at]) if at < len(allowed) else end
        if stop > out[-1] + most:
            stop = out[-1] + most
            while stop > out[-1] + 1 and stop < end and data[stop] & 0xC0 == 0x80:
                stop -= 1
        if stop >= end:
            break
        out.append(stop)
    return [*out, end] if end > start else out


@dataclass
class Chunk:
    """A stretch of a text: its bytes, its digest if it is a chunk that others may share, or a special token."""

    data: bytes
    digest: bytes | None
    special: bool = False


def chunked(texts: Texts, code: Coder) -> list[list[Chunk]]:
    """The chunks of each text, in order."""
    allowed = cuts(texts.data)
    out = []
    for row in range(len(texts)):
        start, chunks = int(texts.offsets[row]), []
        whole = texts.bytes_of(row)
        parts = code.parts(whole.decode()) if code.special and code.special.search(whole.decode()) else [(whole, False)]
        for part, special in parts:
            size = len(part if isinstance(part, bytes) else part.encode())
            if special:
                chunks.append(Chunk(part.encode(), None, True))
            elif size:
                at = bounds(texts.data, allowed, start, start + size)
                for a, b in zip(at[:-1], at[1:], strict=True):
                    data = texts.data[a:b].tobytes()
                    chunks.append(Chunk(data, xxhash.xxh3_128_digest(data) if len(data) >= LEAST // 2 else None))
            start += size
        out.append(chunks)
    return out


def _slots(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x[:4] for x in digests), ">u4").astype(np.int64) % FILTER


def _marked(per_text: list[list[Chunk]], bits: np.ndarray) -> list[list[bool]]:
    """Which chunks of each text the filter takes for shared."""
    flat = [x for chunks in per_text for x in chunks if x.digest]
    slots = _slots([x.digest for x in flat])
    hits = iter(((bits[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1)).astype(bool).tolist())
    return [[bool(x.digest) and next(hits) for x in chunks] for chunks in per_text]


def shared_filter(docs: DataFrame, blocks_of: Callable) -> np.ndarray:
    """The bits of the digests that occur more than once in ``docs``, counted over all of it."""

    def count(block: pa.RecordBatch, code: Coder) -> pa.RecordBatch:
        times = Counter(x.digest for chunks in chunked(Texts(block.column("text")), code) for x in chunks if x.digest)
        return columns(pa.schema([("h", pa.binary()), ("n", pa.int64())]), h=list(times), n=list(times.values()))

    seen = blocks_of(docs, "h binary, n long", count).groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    slot = F.conv(F.hex(F.substring("h", 1, 4)), 16, 10).cast("long") % FILTER
    words = seen.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")
    ).toArrow()  # FILTER / 64 rows at most
    bits = np.zeros(FILTER // 64, np.uint64)
    bits[np.asarray(words.column("word"))] = np.asarray(words.column("bits")).view(np.uint64)
    return bits


_RESULT = pa.schema([
    ("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()),
    ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
])
_RESULT_TYPES = "id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"
_PIECES = pa.schema([
    ("row", pa.int64()), ("id", pa.int64()), ("seq", pa.int32()), ("h", pa.binary()), ("own", pa.binary()),
    ("own_marks", pa.binary()), ("special", pa.bool_()),
])
_CODES = pa.schema([("h", pa.binary()), ("code", pa.binary()), ("marks", pa.binary())])


def _pieces(row: int, chunks: list[Chunk], shared: list[bool], code: Coder) -> Iterator[tuple]:
    """(h, piece, special) of a text in order: shared chunks without their piece, runs of others coded here."""
    run: list[bytes] = []
    for chunk, known in [*zip(chunks, shared, strict=True), (Chunk(b"", None, True), False)]:
        if run and (known or chunk.special or sum(map(len, run)) >= PIECE):
            yield None, code.pieces([b"".join(run).decode()])[0], False
            run = []
        if known:
            yield chunk.digest, None, False
        elif chunk.special:
            if chunk.data:
                yield None, code.special_piece(chunk.data.decode()), True
        else:
            run.append(chunk.data)


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens, ids, ids_sha256, decoded_sha256) per row; ``ids`` are little-endian unsigned 32-bit."""
    name = shipped(docs.sparkSession, vocabulary)
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def blocks_of(rows: DataFrame, types: str, work: Callable) -> DataFrame:
        return by_block(rows, "text", types, lambda block: work(block, coder(SparkFiles.get(name))))

    bits = docs.sparkSession.sparkContext.broadcast(shared_filter(docs, blocks_of))  # FILTER / 8 bytes

    def alone(block: pa.RecordBatch, code: Coder) -> pa.RecordBatch:
        marked = _marked(chunked(Texts(block.column("text")), code), bits.value)
        own = pa.array([i for i, x in enumerate(marked) if not any(x)], pa.int64())
        return code.rows(_RESULT, block.column("id").take(own), code.encode(block.column("text").take(own).to_pylist()))

    def texts(block: pa.RecordBatch, code: Coder) -> pa.RecordBatch:
        per_text = chunked(Texts(block.column("text")), code)
        marked = _marked(per_text, bits.value)
        found = {x.digest: x.data for chunks, known in zip(per_text, marked, strict=True) for x, k in zip(chunks, known, strict=True) if k}
        return columns(pa.schema([("h", pa.binary()), ("text", pa.string())]), h=list(found), text=[x.decode() for x in found.values()])

    def code_once(block: pa.RecordBatch, code: Coder) -> pa.RecordBatch:
        made = code.pieces(block.column("text").to_pylist())
        return columns(_CODES, h=block.column("h"), code=[x.ids.tobytes() for x in made], marks=[x.marks() for x in made])

    def pieces(block: pa.RecordBatch, code: Coder) -> pa.RecordBatch:
        out: dict[str, list] = {field.name: [] for field in _PIECES}
        per_text = chunked(Texts(block.column("text")), code)
        numbers, names = block.column("row").to_pylist(), block.column("id").to_pylist()
        for row, own, chunks, known in zip(numbers, names, per_text, _marked(per_text, bits.value), strict=True):
            for seq, (h, piece, special) in enumerate(_pieces(row, chunks, known, code) if any(known) else ()):
                # A key of its own keeps what needs no code from gathering in one place of the join.
                key = h or np.asarray([row, seq], "<i8").tobytes()
                ids, marks = (None, None) if piece is None else (piece.ids.tobytes(), piece.marks())
                for field, value in zip(_PIECES.names, (row, own, seq, key, ids, marks, special), strict=True):
                    out[field].append(value)
        return columns(_PIECES, **out)

    def assemble(block: pa.RecordBatch, code: Coder) -> pa.RecordBatch:
        all_ids = []
        for row in block.column("pieces").to_pylist():
            ids, stretch = [], []
            for part in [*row, None]:
                if part is None or part["special"]:
                    ids.append(code.joined(stretch))
                    stretch = []
                    if part is not None:
                        ids.append(np.frombuffer(part["code"], code.kind))
                else:
                    stretch.append(Piece.read(part["code"], part["marks"], code.kind))
            all_ids.append(np.concatenate(ids))
        return code.rows(_RESULT, block.column("id"), all_ids)

    single = blocks_of(docs, _RESULT_TYPES, alone)
    distinct = blocks_of(docs, "h binary, text string", texts).groupBy("h").agg(F.min("text").alias("text"))
    codes = stored(blocks_of(distinct, "h binary, code binary, marks binary", code_once))
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    types = "row long, id long, seq int, h binary, own binary, own_marks binary, special boolean"
    parts = blocks_of(numbered, types, pieces).join(codes, "h", "left")
    part = F.struct("seq", F.coalesce("own", "code").alias("code"), F.coalesce("own_marks", "marks").alias("marks"), "special")
    rows = parts.groupBy("row").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(part)).alias("pieces"), F.sum(F.length(part["code"])).alias("size"))
    several = rows.select("id", "pieces").mapInArrow(
        lambda batches: (assemble(batch.slice(i, 256), coder(SparkFiles.get(name))) for batch in batches for i in range(0, batch.num_rows, 256)),
        _RESULT_TYPES,
    )
    return single.unionByName(several)


def decoded(encoded_docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text) of rows with id and ids."""
    name = shipped(encoded_docs.sparkSession, vocabulary)
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        code = coder(SparkFiles.get(name))
        texts = [code.decode(np.frombuffer(x or b"", "<u4")) for x in block.column("ids").to_pylist()]
        return columns(schema, id=block.column("id"), text=texts)

    return by_block(encoded_docs.select("id", "ids"), "ids", "id long, text string", work)
