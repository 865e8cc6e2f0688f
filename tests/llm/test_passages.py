"""Passages that documents share, against brute force; hot cores, counted and not gathered."""

import random
import re

import pytest
from quern.llm import suffix_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shared(texts, words):
    lists = [WORDS.findall(t or "") for t in texts]
    where: dict = {}
    for k, x in enumerate(lists):
        for a in range(len(x) - words + 1):
            where.setdefault(tuple(x[a : a + words]), set()).add(k)
    out = []
    for x in lists:
        mine = [a for a in range(len(x) - words + 1) if len(where[tuple(x[a : a + words])]) > 1]
        out.append(len({n for a in mine for n in range(a, a + words)}))
    return out


@pytest.mark.parametrize("words", [5, 51])
def test_passages(spark, words):
    random.seed(words)
    word = lambda: random.choice("abcdefghij") * random.randint(1, 3) + str(random.randrange(60))
    passage, line = [word() for _ in range(80)], " ".join(word() for _ in range(words))
    texts = [None, "", "x", line, f"{line} ", f"{line}\n{line}", " ".join(["same"] * 200), " ".join(["same"] * 90)]
    for _ in range(60):
        a = random.randint(0, 60)
        middle = passage[a : a + random.randint(1, 80)]
        texts.append(random.choice([" ", "\n", " \t"]).join([*(word() for _ in range(random.randint(0, 90))), *middle, *(word() for _ in range(random.randint(0, 90)))]))
    texts += texts[20:24] + ["alone " * 60 + "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.passage_words for r in suffix_dedup.remove_repeats(docs, 400, words).collect()}
    assert [found[k] for k in range(len(texts))] == shared(texts, words)


def test_hot_cores(spark, monkeypatch):
    """With every core over the limit the result is the same."""
    from .test_operators import by_id, covered

    random.seed(2)
    base = "".join(random.choice("abcdefg h") for _ in range(330))
    texts = [(k, "".join(random.choice("xyz") for _ in range(random.randint(0, 90))) + base[random.randint(0, 90) :] + str(k % 7) * random.randint(0, 80), "") for k in range(40)]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    keep = suffix_dedup._compare
    monkeypatch.setattr(suffix_dedup, "_compare", lambda members, window: keep(members, window, 1))
    found = by_id(suffix_dedup.remove_repeats(docs, 200))
    assert {k: [x[:4] for x in v] for k, v in found.items()} == covered(texts, 200)
    assert sum(x[1] > 0 for v in found.values() for x in v) > 10
