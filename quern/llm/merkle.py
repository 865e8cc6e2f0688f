"""Document fingerprints: a Merkle tree over paragraphs and sections."""

from __future__ import annotations

import re
from collections import Counter
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import arrow_schema, bounded_batches, partitions, slices

#: Up to four words, fewer at the end of a sentence, with the blanks after them; or blanks alone.
PHRASE = re.compile(r"(?:\S*[^\s.!?]\s+){0,3}\S+\s*|\s+")
LINE = re.compile(r"[^\n]*\n|[^\n]+")
#: A section ends after a paragraph whose digest starts with a byte divisible by this, or after a blank one.
SECTION = 8


#: Words of more characters than this are compared in pieces.
LONG = 32


class Paragraph(NamedTuple):
    digest: bytes
    length: int
    phrases: list[bytes]
    texts: list[str]


class Section(NamedTuple):
    digest: bytes
    length: int
    paragraphs: list[Paragraph]


class Tree(NamedTuple):
    """root: equal exactly for equal texts. Each level's digests are made of those below: sections of paragraphs (lines),
    paragraphs of phrases, whose texts are the leaves."""

    root: str
    length: int
    sections: list[Section]


def _paragraph(text: str, known: dict[str, Paragraph]) -> Paragraph:
    if text not in known:
        parts = PHRASE.findall(text)
        phrases = [xxhash.xxh3_128_digest(x) for x in parts]
        known[text] = Paragraph(sha256(b"\0" + b"".join(phrases)).digest(), len(text), phrases, parts)
    return known[text]


def _section(paragraphs: list[Paragraph]) -> Section:
    return Section(sha256(b"\1" + b"".join(p.digest for p in paragraphs)).digest(), sum(p.length for p in paragraphs), paragraphs)


def tree(text: str, known: dict[str, Paragraph] | None = None) -> Tree:
    """``known`` saves work on paragraphs that another version of the text has as well."""
    known = {} if known is None else known
    sections, open_ = [], []
    for line in LINE.findall(text):
        paragraph = _paragraph(line, known)
        open_.append(paragraph)
        if paragraph.digest[0] % SECTION == 0 or not line.strip():
            sections.append(_section(open_))
            open_ = []
    if open_:
        sections.append(_section(open_))
    root = sha256(b"\2" + b"".join(s.digest for s in sections)).hexdigest()
    return Tree(root, len(text), sections)


def _unmatched(a: list, b: list) -> tuple[int, list, list]:
    """Code points of the nodes that both have (repeats counted), and the nodes left on either side."""
    left, same, rest = Counter(x.digest for x in b), 0, []
    for x in a:
        if left[x.digest]:
            left[x.digest] -= 1
            same += x.length
        else:
            rest.append(x)
    other = []
    for x in reversed(b):
        if left[x.digest]:
            left[x.digest] -= 1
            other.append(x)
    return same, rest, other[::-1]


def pieces(word: str) -> list[str]:
    """A long word in pieces that end where its own characters say, so that they do not move when text is put before them."""
    out, start = [], 0
    for k, c in enumerate(word):
        if ord(c) * 2654435761 >> 7 & 7 == 0 or k - start == 63:
            out.append(word[start : k + 1])
            start = k + 1
    return [*out, word[start:]]


def word_counts(phrases: list[str]) -> Counter:
    """Words of some phrases and how often each occurs; long ones by their pieces."""
    found = Counter(" ".join(phrases).split())
    for word in [w for w in found if len(w) > LONG]:
        times = found.pop(word)
        for piece in pieces(word):
            found[piece] += times
    return found


def _leaves(a: list[tuple], b: list[tuple]) -> tuple[int, list[str], list[str]]:
    """For (name, text) leaves of both: code points in equal ones (repeats counted), and the texts left on either side."""
    left, same, rest = Counter(x for x, _ in b), 0, []
    for x, text in a:
        if left[x]:
            left[x] -= 1
            same += len(text)
        else:
            rest.append(text)
    other = []
    for x, text in reversed(b):
        if left[x]:
            left[x] -= 1
            other.append(text)
    return same, rest, other[::-1]


def likeness(a: Tree, b: Tree) -> float:
    """Share (0 to 1) of both texts' code points in equal branches: whole sections first, then the paragraphs of
    sections that differ, the phrases of paragraphs that differ and the words of phrases that differ. 1 for equal roots."""
    if a.root == b.root:
        return 1.0
    same, mine, other = _unmatched(a.sections, b.sections)
    more, mine, other = _unmatched([p for s in mine for p in s.paragraphs], [p for s in other for p in s.paragraphs])
    phrases, mine, other = _leaves(*([x for p in side for x in zip(p.phrases, p.texts, strict=True)] for side in (mine, other)))
    left, right = word_counts(mine), word_counts(other)
    words = sum((len(w) + 1) * min(n, right[w]) for w, n in left.items() if w in right)  # with a blank each
    return min(1.0, 2 * (same + more + phrases + words) / (a.length + b.length))


def first_edit(a: Tree, b: Tree) -> int | None:
    """The code point of ``a`` at which ``b`` begins to differ; None if it does not. Equal branches are passed over as a
    whole, level by level; only the first phrases that differ are compared by characters."""
    if a.root == b.root:
        return None
    at = 0

    def ahead(mine: list, other: list, size) -> tuple[list, list]:
        nonlocal at
        n = next((k for k, (x, y) in enumerate(zip(mine, other, strict=False)) if x[0] != y[0]), min(len(mine), len(other)))
        at += sum(map(size, mine[:n]))
        return mine[n:], other[n:]

    sections = ahead(a.sections, b.sections, lambda s: s.length)
    paragraphs = ahead(*([p for s in side[:1] for p in s.paragraphs] for side in sections), lambda p: p.length)
    phrases = ahead(*([x for p in side[:1] for x in zip(p.phrases, p.texts, strict=True)] for side in paragraphs), lambda x: len(x[1]))
    mine, other = ("".join(text for _, text in side) for side in phrases)
    return at + next((k for k, (x, y) in enumerate(zip(mine, other, strict=False)) if x != y), min(len(mine), len(other)))


def differing_spans(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Code-point spans of ``a`` whose branches ``b`` lacks, at the level of paragraphs: where the edits are."""
    if a.root == b.root:
        return []
    _, mine, other = _unmatched(a.sections, b.sections)
    _, mine, _ = _unmatched([p for s in mine for p in s.paragraphs], [p for s in other for p in s.paragraphs])
    lost, at, spans = Counter(p.digest for p in mine), 0, []
    for p in (p for s in a.sections for p in s.paragraphs):
        if lost[p.digest]:
            lost[p.digest] -= 1
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + p.length)
            else:
                spans.append((at, at + p.length))
        at += p.length
    return spans


FIELDS = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(), "near_next": pa.float64(), "n_sections": pa.int64(), "n_paragraphs": pa.int64(), "first_edit": pa.int64(),
}


def fingerprint_trees(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint, sections): roots and, for each section, its digest, code points and the digests
    and code points of its paragraphs; join two versions on ``fingerprint`` for equality or compare branches.

    A null text is an empty one, whose tree has no sections. Ids, repeated rows and empty tables pass through.
    """
    bounded_batches(docs.sparkSession)
    ddl = "doc_id long, n_chars long, fingerprint string, sections array<struct<digest:string,n_chars:long,paragraphs:array<struct<digest:string,n_chars:long>>>>"

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    t = tree(text or "")
                    rows.append({"doc_id": doc, "n_chars": t.length, "fingerprint": t.root, "sections": [
                        {"digest": s.digest.hex(), "n_chars": s.length, "paragraphs": [{"digest": p.digest.hex(), "n_chars": p.length} for p in s.paragraphs]}
                        for s in t.sections]})
                para = pa.list_(pa.struct([("digest", pa.string()), ("n_chars", pa.int64())]))
                section = pa.list_(pa.struct([("digest", pa.string()), ("n_chars", pa.int64()), ("paragraphs", para)]))
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string()), ("sections", section)]))

    return docs.selectExpr(f"cast(`{id_column}` as long) as doc_id", f"`{text_column}` as text").mapInArrow(run, ddl)


def _bucket(of: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at or below ``of``; for a null all of them."""
    every = np.array(bounds, np.int64)

    @F.arrow_udf("int")
    def bucket(ids: pa.Array) -> pa.Array:
        found = np.searchsorted(every, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), side="right").astype(np.int32)
        return pc.if_else(ids.is_null(), pa.scalar(len(every), pa.int32()), pa.array(found))
    return bucket(of)


def edit_fingerprints(docs: DataFrame, buckets: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the first floor(n / 2) code points of the next
    document (all, if it is shorter) replace the last floor(n / 2); next by ascending id, after the last the first.

    Columns: ``doc_id``, ``n_chars`` (code points), ``edited_sha256``, ``fingerprint``, ``edited_fingerprint`` (roots,
    hex), ``near_edited``, ``near_next`` (``likeness`` of the trees), ``n_sections``, ``n_paragraphs`` and
    ``first_edit`` (the code point at which the edited text begins to differ, found by descent; null if none).

    A null text is an empty one. Rows of one id follow each other by text; null ids come last. A lone row is its
    own next. An empty table gives an empty result; other columns are not read.

    The documents are dealt once, into ranges of ids cut at ids of the table (approximate quantiles). The rows that
    open a range go to the range before as well, so each range is walked in order with one row held.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.selectExpr(f"cast(`{id_column}` as long) as doc_id", f"coalesce(`{text_column}`, '') as text")
    n = partitions(spark)
    buckets = buckets or 4 * n
    cuts = rows.where("doc_id is not null").stat.approxQuantile("doc_id", [k / buckets for k in range(buckets)], 0.2 / buckets) if buckets > 1 else []
    # through doubles ids above 2**53 lose digits; ids of the table itself are looked up at or above each cut
    least = rows.agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids")).first()
    if not least["n"]:
        return spark.createDataFrame([], arrow_schema(FIELDS)[1])
    bounds = sorted({int(x) for x in cuts} - {least["least"]})
    own = _bucket(F.col("doc_id"), bounds)
    # a row opens its range if its id is the least there; ids at a bound do, if the table has that id
    opens = rows.withColumn("range", own).groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("o"), F.count(F.lit(1)).alias("n"))
    first = [(r["range"], r["o"]["doc_id"]) for r in opens.orderBy("range").collect()]
    before = {first[k][0]: first[k - 1][0] for k in range(len(first))}
    at = {k: d for k, d in first}
    table = spark.createDataFrame([(k, at[k], before[k]) for k, _ in first], "range int, opening long, before int")
    dealt = rows.withColumn("range", own).join(F.broadcast(table), "range")
    copies = F.when(F.col("doc_id").eqNullSafe(F.col("opening")), F.array(F.struct(F.col("range").alias("r"), F.lit(0).alias("guest")), F.struct(F.col("before").alias("r"), F.lit(1).alias("guest")))).otherwise(
        F.array(F.struct(F.col("range").alias("r"), F.lit(0).alias("guest"))))
    dealt = dealt.select("doc_id", "text", F.explode(copies).alias("c")).select("doc_id", "text", "c.r", "c.guest")
    dealt = dealt.repartition(n, "r").sortWithinPartitions("r", "guest", F.col("doc_id").asc_nulls_last(), "text")
    schema, ddl = arrow_schema(FIELDS)

    def compare(text: str, mine: Tree, known: dict, follower: str, theirs: Tree) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + follower[:half]
        other = tree(edited, known)
        return (
            len(text), sha256(edited.encode()).hexdigest(), mine.root, other.root, likeness(mine, other), likeness(mine, theirs),
            len(mine.sections), sum(len(s.paragraphs) for s in mine.sections), first_edit(mine, other))

    def run(batches):
        held = None  # (range, doc, text, tree, paragraphs), waiting for the row after it
        for batch in batches:
            for part in slices(batch):
                out = []
                for doc, text, r, guest in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "r", "guest")), strict=True):
                    if guest and (held is None or held[0] != r):
                        continue  # a guest after the first one
                    known: dict[str, Paragraph] = {}
                    now = tree(text, known)
                    if held is not None:
                        if held[0] != r:
                            raise ValueError(f"range {held[0]} has no row after its last")
                        out.append((held[1], *compare(held[2], held[3], held[4], text, now)))
                    held = None if guest else (r, doc, text, now, known)
                columns = list(zip(*out, strict=True)) if out else [[]] * len(FIELDS)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, FIELDS.values(), strict=True)], schema=schema)
        if held is not None:
            raise ValueError(f"range {held[0]} has no row after its last")

    return dealt.mapInArrow(run, ddl)
