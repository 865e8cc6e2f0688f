"""The pipeline's near-duplicates against brute force, and rows whose ids are null or repeat."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from quern.llm import shingle_dedup


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def alike_groups(texts):
    root, sets = list(range(len(texts))), [shingles(t) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if x == old else x for x in root]
    return root


def edited_texts():
    random.seed(6)
    line = " ".join(f"common{k}" for k in range(30))
    out = ["", " \n ", "one two", "One  two", None]
    for k in range(25):
        words = [f"w{random.randrange(400)}" for _ in range(random.choice([6, 40, 120, 300]))]
        for _ in range(random.randint(1, 5)):
            new = list(words)
            for _ in range(random.randint(0, 1 + len(words) // 40)):
                new[random.randrange(len(new))] = f"x{random.randrange(10**6)}"
            out.append(" ".join(new) + (f" {line}" if k % 3 else ""))
    return out


def test_alike(spark):
    texts = edited_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sorted(set(alike_groups(texts)))
    assert len(want) < len({t or "" for t in texts}) - 5
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == want


def test_cells(spark):
    """Blocks so small that a group is split."""
    texts = edited_texts()
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    sets = shingle_dedup._sets(docs, shingle_dedup._alive(docs, 5, (4, 5)), 5)
    found = {r.node: r.component for r in shingle_dedup.connected_components(shingle_dedup.similar_links(sets, block=100)).collect()}
    names = [shingle_dedup.set_name(shingle_dedup.shingle_set(t or "", 5)) for t in texts]
    root = alike_groups(texts)
    assert len({found.get(n, n) for n in names}) == len(set(root)) == len(set(zip(root, [found.get(n, n) for n in names], strict=True)))


def test_simhash_links_settle(spark):
    """What SimHashes link is settled: the prefix filter proposes across it alone, and the groups stay exact."""
    random.seed(8)
    base = [f"w{random.randrange(10**6)}" for _ in range(3000)]
    near = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in (100, 900, 2000)]
    far = [" ".join([f"y{j}" if j % 60 == k else w for j, w in enumerate(base)]) for k in (7, 31)]
    docs = spark.createDataFrame([(t,) for t in [*near, *far]], "text string")
    sets = shingle_dedup.written(shingle_dedup._sets(docs, shingle_dedup._alive(docs, 5, (4, 5)), 5), "sets")
    linked = shingle_dedup.connected_components(shingle_dedup._compared(sets, shingle_dedup.connected_components(shingle_dedup._hash_pairs(sets, 4)), (4, 5), 1 << 20))
    none = spark.createDataFrame([], "node long, component long")
    names = [shingle_dedup.set_name(shingle_dedup.shingle_set(t, 5)) for t in [*near, *far]]
    assert set(names[:3]) <= {r.node for r in linked.collect()}
    ends = lambda pairs: {x for r in pairs.collect() for x in r}
    assert ends(shingle_dedup._rare_pairs(sets, none, (4, 5))) == set(names)
    head = {r.node: r.component for r in linked.collect()}
    assert ends(shingle_dedup._rare_pairs(sets, linked, (4, 5))) == {head.get(n, n) for n in names} != set(names)
    found = {r.node: r.component for r in shingle_dedup.connected_components(shingle_dedup.similar_links(sets)).collect()}
    root = alike_groups([*near, *far])
    assert len(set(zip(root, [found.get(n, n) for n in names], strict=True))) == len(set(root)) == len({found.get(n, n) for n in names})


def test_alike_rows_without_own_id(spark):
    """One null-id row that heads its group; a null-id copy of a document that stays; an id that heads one group and
    is a copy in another; rows alike in everything."""
    a, b, c, d = ("alpha beta gamma delta epsilon", "one two three four five six", "red green blue black white grey", "north south east west up down")
    rows = [(5, a, 1), (None, a, 2), (None, a, 3), (None, b, 4), (3, c, 5), (7, c, 6), (7, d, 7), (7, d, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, v int")
    kept = shingle_dedup.keep_one_alike(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.where(F.col("doc_id").isNotNull()).collect()) == [(3, c, 5), (5, a, 1), (7, d, 7)]
    assert [tuple(r) for r in kept.where(F.col("doc_id").isNull()).collect()] == [(None, b, 4)]
