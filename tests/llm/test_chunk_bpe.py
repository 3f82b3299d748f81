"""Chunked encoding against the library on whole texts."""
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from psephos.llm import chunk_bpe as cb
from psephos.llm.text import Texts
from tests.llm.cases import SCHEMA, awkward_rows, ordered, prose

CODE = cb.coder(cb.VOCABULARY)
ODD = ["a", "B", " ", "  ", "\n", "'", "'ll", "'s", "'", "é", "\U0001f600", "中文", "12", "3", "...", "don't", "\t", " ", "ll", "_", "x" * 40]


def plain(text: str) -> list[int]:
    return CODE.library.encode(text, add_special_tokens=False).ids


def row_of(doc_id, text) -> tuple:
    ids = plain(text or "")
    decoded = CODE.library.decode(ids, skip_special_tokens=False)
    return doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=60), st.integers(1, 30), st.integers(0, 2**32))
def test_pieces_cut_anywhere_join_exactly(parts, size, seed):
    text, lots = "".join(parts), random.Random(seed)
    pieces, at = [], 0
    while at < len(text):
        step = lots.randint(1, size)
        pieces += CODE.pieces([text[at : at + step]])
        at += step
    assert CODE.joined(pieces).tolist() == plain(text)


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 30_000 + "x", "中" * 20_000, "'" * 9_000, prose(3, 9_000), "ab" * 9_000 + " " + prose(4, 50)])
def test_long_runs_without_word_starts(text):
    pieces = (p for a in range(0, len(text), 700) for p in CODE.pieces([text[a : a + 700]]))
    assert CODE.joined(pieces).tolist() == plain(text)


def test_long_texts_equal_the_library(monkeypatch):
    monkeypatch.setattr(cb, "PIECE", 500)
    texts = [prose(1, 2000), "", "x <|endoftext|> y" * 60, "é" * 3000, "<|endoftext|>" * 80, "<|endoftext" + prose(2, 300) + "|>"]
    assert [x.tolist() for x in CODE.encode(texts)] == [plain(text) for text in texts]


def test_equal_passages_are_cut_alike():
    passage = prose(11, 900)
    found = [cb.chunked(Texts(pa.array([lead + passage + " end"])), CODE)[0] for lead in ("", "some other words before it ", prose(12, 333))]
    digests = [{x.digest for x in chunks} for chunks in found]
    assert len(digests[0] & digests[1] & digests[2]) > len(digests[0]) // 2
    for chunks in found:
        assert all(len(x.data) <= cb.MOST for x in chunks) and all(len(x.data) > cb.LEAST for x in chunks[:-1])
        assert b"".join(x.data for x in chunks).decode().endswith(passage + " end")


def test_chunks_end_between_characters():
    text = "é中\U0001f600" * 4000
    chunks = cb.chunked(Texts(pa.array([text])), CODE)[0]
    assert "".join(x.data.decode() for x in chunks) == text


def special_rows() -> list[tuple]:
    shared = prose(21, 700)
    texts = [
        shared, shared, "a<|endoftext|>b", shared + "<|endoftext|>" + shared, "<|endoftext|>", prose(22, 100) + shared + "  tail",
        shared[:1500] + "<|endof" + shared[1500:], shared.replace(" ", " "), (shared + "\n") * 12, "z" * 30_000, "z" * 30_000,
    ]
    return [(100 + i, text, "en", "a", None) for i, text in enumerate(texts)]


def test_rows_equal_the_library(spark):
    rows = awkward_rows() + special_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs = docs.withColumns({name: F.lit("clash") for name in ("id", "h", "row", "seq", "code", "own", "pieces", "special", "size", "n_tokens")})
    found = cb.encoded(docs).select("id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert ordered(found.collect()) == ordered(row_of(row[0], row[1]) for row in rows)


def test_shared_chunks_are_encoded_once(spark, monkeypatch):
    docs = spark.createDataFrame(special_rows(), SCHEMA)
    name = cb.shipped(spark, cb.VOCABULARY)
    bits = cb.shared_filter(
        docs, lambda rows, types, work: cb.by_block(rows, "text", types, lambda block: work(block, cb.coder(cb.SparkFiles.get(name))))
    )
    chunks = [x for row in special_rows() for x in cb.chunked(Texts(pa.array([row[1]])), CODE)[0] if x.digest]
    times = {x.digest: sum(y.digest == x.digest for y in chunks) for x in chunks}
    marked = cb._marked([chunks], bits)[0]
    assert all(known for x, known in zip(chunks, marked, strict=True) if times[x.digest] > 1)
    assert not any(known for x, known in zip(chunks, marked, strict=True) if times[x.digest] == 1)


def test_round_trip(awkward):
    texts = cb.decoded(cb.encoded(awkward)).collect()
    assert ordered(texts) == ordered((row[0], row[1] or "") for row in awkward_rows())


def test_empty_table(nothing):
    assert cb.encoded(nothing).collect() == []


def test_other_tokenizers_are_refused(tmp_path):
    path = tmp_path / "odd.json"
    path.write_text('{"pre_tokenizer": {"type": "Whitespace"}, "added_tokens": [], "normalizer": null}')
    with pytest.raises(ValueError, match="byte-level"):
        cb.Coder(str(path))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x3000, exclude_categories=["Cs"]), st.sampled_from([x for x in ODD if len(x) == 1])), max_size=40))
def test_words_equal_the_library(text):
    assert CODE.coded(text)[0].tolist() == plain(text)


def test_each_character_is_split_as_the_library_does():
    for first in range(0, 0x3100, 64):
        text = "".join(f"{chr(c)} a{chr(c)}1{chr(c)}{chr(c)}'s{chr(c)} " for c in range(first, first + 64))
        assert CODE.coded(text)[0].tolist() == plain(text)
    assert CODE.words("caf\xe9 na\xefve, isn't it?") is not None  # the usual characters need no detour
    assert CODE.words("\u4e2d") is None


def test_words_beyond_the_memory(monkeypatch):
    monkeypatch.setattr(cb, "WORDS", 10)
    code = cb.Coder(cb.VOCABULARY)
    text = prose(8, 500)
    assert [code.coded(text)[0].tolist() for _ in range(2)] == [plain(text)] * 2 and len(code.known) == 10


def test_wire_format():
    piece = CODE.pieces([prose(1, 40)])[0]
    again = cb.Piece.read(piece.ids.tobytes(), piece.marks(), CODE.kind)
    assert again.ids.tolist() == piece.ids.tolist() and again.tail == piece.tail and np.array_equal(again.head, piece.head)
