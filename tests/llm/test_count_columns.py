"""Tokens are counted by columns: a piece once for all its copies, the start that pieces share once for all of them."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from quern.llm import bpe
from tests.llm.test_piece_columns import FIXED, ODD, PLAIN


@pytest.fixture(scope="module")
def counter():
    return bpe.PrefixCounts(bpe.default_path())


def library(rows, path):
    from tokenizers import Tokenizer

    return [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(rows, add_special_tokens=False)]


def test_a_column_s_counts_are_the_library_s(counter):
    draw = random.Random(11)
    parts = [*PLAIN, *ODD, "the", " The", "rent", "heit", "ción", "日本", "x" * 70]
    rows = [*FIXED, "x" * 3000, *("".join(draw.choice(parts) for _ in range(draw.randrange(16))) for _ in range(600))]
    want, column = library(rows, bpe.default_path()), pa.array(["skipped", None, *rows], pa.string()).slice(1)
    for found in (counter, bpe.PrefixCounts(bpe.default_path(), most=20, at_once=37)):
        for budget in (0, 3, 12, 10_000):
            sizes, tokens, fits = found.column(column, budget)
            assert sizes.tolist() == [0, *(len(x.encode()) for x in rows)]
            assert tokens.tolist() == [0, *want]
            assert fits.tolist() == [0, *(counter.longest_prefix(x, budget) for x in rows)]
    assert all(len(x) == 0 for x in counter.column(column.slice(0, 0), 3))
    assert [x.tolist() for x in counter.column(pa.nulls(2, pa.string()), 3)] == [[0, 0]] * 3


def test_pieces_and_their_starts_are_gone_through_once(monkeypatch):
    counter, walked, steps = bpe.PrefixCounts(bpe.default_path(), most=60), [], []
    walk, step = counter._walk, counter._step
    monkeypatch.setattr(counter, "_walk", lambda pieces: walk([walked.append(x) or x for x in pieces]))
    for k in range(40):
        counter.column(pa.array([" the of and to in" + "".join(f" w{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}" for j in range(10))] * 3), 512)
        assert len(counter.memo) <= 60
    assert sum(walked.count(x) for x in (b" the", b" of", b" and", b" to", b" in")) == 5
    assert len(walked) == 5 + 400

    class Counted(bpe.Memo):
        def __getitem__(self, key):
            steps.append(key)
            return super().__getitem__(key)

    counter.step = Counted(step, 1000)
    counter.column(pa.array([" beginning" + x for x in "abcdefgh"]), 512)
    assert len(steps) == len(" beginning") + 8


def test_neighbours_agree_as_a_merge_says(counter):
    assert counter.in_order
    draw = random.Random(5)
    alone = [k for k in draw.sample(sorted(counter.bytes), 1500) if counter.agree[-1 << 20 | k]]
    pairs = [(draw.choice(alone), draw.choice(alone)) for _ in range(4000)]
    pairs += [(counter.ids[x[:k]], counter.ids[x[k:]]) for x in draw.sample(sorted(counter.ids), 3000) for k in range(1, len(x)) if x[:k] in counter.ids and x[k:] in counter.ids]
    pairs = [(a, b) for a, b in pairs if counter.agree[-1 << 20 | a]]
    found = [counter.agree[a << 20 | b] for a, b in pairs]
    assert found == [counter._merge(counter.bytes[a] + counter.bytes[b]) == [counter.bytes[a], counter.bytes[b]] for a, b in pairs]
    assert 500 < np.sum(found) < len(found) - 500


@pytest.mark.parametrize("merges, in_order", [
    (["a a", "a b", "aa aa", "ab a", "b b", "aa bb"], True),
    (["a b", "b c", "ab c", "a bc", "abc abc"], False),  # a token that two merges make
])
def test_small_vocabularies(tmp_path, merges, in_order):
    with open(bpe.default_path(), encoding="utf-8") as file:
        spec = json.load(file)
    letters = sorted(bpe._byte_letters())
    made = list(dict.fromkeys(x.replace(" ", "") for x in merges))
    spec["model"] |= {"vocab": {x: k for k, x in enumerate([*letters, *made])}, "merges": merges}
    spec["added_tokens"] = []
    path = tmp_path / "small.json"
    path.write_text(json.dumps(spec))
    draw = random.Random(3)
    rows = ["".join(draw.choice("aabbc ") for _ in range(draw.randrange(30))) for _ in range(1500)]
    counter = bpe.PrefixCounts(str(path))
    assert counter.in_order == in_order
    assert counter.column(pa.array(rows), 5)[1].tolist() == library(rows, str(path))
