import hashlib

import numpy as np
import public_tokenizers
import pytest

from psephos.llm import bpe
from tests.llm.cases import awkward_rows, ordered, prose


def test_rows_equal_the_library(awkward):
    whole = bpe.encoding(bpe.RANKS)
    wanted = []
    for row in awkward_rows():
        ids = np.array(whole.encode_ordinary(row[1] or ""), "<u4")
        wanted.append((row[0], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest()))
    found = bpe.encoded(awkward).select("id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert ordered(found) == ordered(wanted)


def test_round_trip(spark, awkward):
    texts = bpe.decoded(bpe.encoded(awkward)).collect()
    assert ordered(texts) == ordered((row[0], row[1] or "") for row in awkward_rows())


@pytest.mark.parametrize("text", [
    prose(4, 60000), "a" * 300000, "it's  \n\n don't " * 20000, "x  y\x1c z " * 30000, " " * 100000 + "end", "1 2,3.4 ; 'll " * 20000,
])
def test_cut_texts_have_the_ids_of_whole_ones(text):
    assert bpe.encode(text).tolist() == bpe.encoding(bpe.RANKS).encode_ordinary(text)


def test_special_tokens_are_text():
    assert bpe.decode(bpe.encode("<|endoftext|>")) == b"<|endoftext|>" and len(bpe.encode("<|endoftext|>")) > 1


def test_single_tokens_decode_to_raw_bytes():
    ids = bpe.encode("\U0001f600é")
    assert b"".join(bpe.decode(ids[i : i + 1]) for i in range(len(ids))) == "\U0001f600é".encode()


def test_other_rank_file_and_empty_table(spark, nothing):
    other = public_tokenizers.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(1, "Hello world")], "doc_id long, text string")
    assert bpe.encoded(df, ranks=other).first()["n_tokens"] == 2
    assert bpe.encoded(nothing).count() == 0
