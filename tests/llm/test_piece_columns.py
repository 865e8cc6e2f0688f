"""Texts are cut into pieces by columns; the library is asked once for a piece that is common."""

import random

import numpy as np
import pyarrow as pa
import pytest
from quern.llm import bpe

PLAIN = ["'", "s", "t", "re", "ve", "ll", "S", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x85", "\xa0", "é", "ß", "ª", "²", "½", "×", "ɏ", "1", ".", "don't", "we'll", "Word"]
ODD = [*PLAIN, "<|endoftext|>", "ɐ", "€", "中", " ", "　", "🙂", "\x00", "\x1c", "\x7f", "\x80", "ſ", "٣"]
FIXED = ["", "'s", " 's", "  's", "\n's", "'r", "'re", "'rex", "''s", "x'", "'", "l", "a \n b", "a\xa0b", "a \xa0b", "a\xa0 ", " ", "<|endoftext|>", "a<|endoftext|> b"]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(7)
    return [*FIXED, *("".join(draw.choice(kind) for _ in range(draw.randrange(14))) for kind in (PLAIN, ODD, ["'", "r", "e", "l", " ", "\n"]) for _ in range(800))]


def test_starts_are_those_of_pieces(rows):
    splitter, sizes = bpe.Splitter(bpe.default_path()), [len(x.encode()) for x in rows]
    at = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.cumsum([len(p.encode()) for x in rows for p in splitter.pieces(x)])
    assert splitter.starts("".join(rows).encode(), at).tolist() == [0, *ends[:-1].tolist()]
    assert splitter.starts(b"", np.zeros(3, np.int64)).tolist() == []


def test_ids_of_a_column_are_the_library_s(rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(bpe.default_path()).encode_batch(rows, add_special_tokens=False)
    wanted = [b"", *(np.array(x.ids, "<u4").tobytes() for x in whole)]
    column = pa.array(["skipped", None, *rows], pa.string()).slice(1)
    for encode in (bpe.Ids(bpe.default_path()), bpe.Ids(bpe.default_path(), most=20, at_once=37)):
        assert encode(column) == wanted and encode(column) == wanted
    assert encode(column.slice(0, 0)) == [] and encode(column.slice(0, 1)) == [b""]


def test_a_full_memo_keeps_common_pieces():
    encode, asked = bpe.Ids(bpe.default_path(), most=60), []
    piece = encode._piece
    encode._piece = lambda x: asked.append(x) or piece(x)
    common = " the of and to in"
    for k in range(40):
        encode(pa.array([common + "".join(f" w{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}" for j in range(10))] * 3))
        assert len(encode.memo) <= 60
    assert sum(asked.count(x) for x in (" the", " of", " and", " to", " in")) == 5
    assert len(asked) == 5 + 400
