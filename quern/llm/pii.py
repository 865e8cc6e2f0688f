"""Personal data, with DataFrame functions only: patterns propose spans, checksums confirm them, context scores them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where a pattern starts with a run of a class, it starts at the run's first character or where the last match
# ended (\G): the same matches as without, but a long run without a match is walked once, not once per character.
# Possessive repeats (++) give up nothing here, since what follows a run cannot be part of it; they also keep the
# matcher off the call stack on very long runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
# What is assigned to a name that says it is secret, and keys of known forms; the name itself is not part of the match.
SECRET = (r"(?<=(?i:token|secret|passwo?r?d|api[_-]?key|access[_-]?key)[\"']{0,1}\s{0,3}[:=]\s{0,3}[\"']{0,1})[A-Za-z0-9+/_=-]{16,}+"
          r"|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Z])|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9]{20,}+)")
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Kind -> pattern, what a text must hold for a match, first score, context words that raise it. Base kinds first.
KINDS = {
    "email": (EMAIL, "@", 0.9, "e-?mail|mail|contact|write|correo"),
    "ip": (IP, r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", 0.6, "ip|address|host|server|login"),
    "card": (CARD, r"[0-9](?:[\x20-]?[0-9]){13}", 0.8, "card|visa|master|credit|karte|tarjeta|carte"),
    "phone": (PHONE, r"\+[0-9]", 0.6, "phone|tel|call|mobile|fax|handy"),
    "iban": (IBAN, r"[A-Z]{2}[0-9]{2}", 0.8, "iban|account|bank|konto|cuenta|compte"),
    "ssn": (SSN, r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, "ssn|social|security|tax"),
    "secret": (SECRET, r"(?i:token|secret|passw|key)[\"']?\s{0,3}[:=]|AKIA|gh[pousr]_|sk-", 0.6, "token|secret|passw|key"),
}
BASE = ("email", "ip", "card", "phone")


def digits(of: Column) -> Column:
    return F.regexp_replace(of, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn."""
    back = F.reverse(number)

    def add(total, k):
        digit = F.substring(back, k, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(k % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN (blanks aside) leaves 1 modulo 97."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def add(rest, k):
        code = F.ascii(F.substring(turned, k, F.lit(1)))
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits(match)).between(14, 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(digits(match)).between(10, 15)
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return mod97(match) if kind == "iban" else F.lit(True)


EMPTY = "cast(array() as array<struct<start:int,kind:int,end:int,score:double>>)"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, where ``use`` names it within another function's elements."""
    return F.transform(F.array(value), use)[0]


def found(kind: str, text: Column) -> Column:
    """array<struct<start, kind, end, score>>: the confirmed matches of a kind, offsets in code points, end exclusive.

    The pieces between the matches and the matches themselves alternate, so their lengths add up to offsets. Adding to
    an array copies it, so the n pieces are walked in about sqrt(n) blocks of as many, each from its own zero, and the
    blocks' spans are shifted to where the blocks start.
    """
    pattern, hint, score, _ = KINDS[kind]
    number = list(KINDS).index(kind)
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    state = F.struct(F.lit(0).alias("at"), F.expr(EMPTY).alias("spans"))

    def add(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), F.lit(score).alias("score"))
        keep = x["match"].isNotNull() & confirmed(kind, x["match"])
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def shifted(blocks):
        begins = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        def move(pair):
            return F.transform(pair["b"]["spans"], lambda s: F.struct((s["start"] + pair["o"]).alias("start"), s["kind"].alias("kind"), (s["end"] + pair["o"]).alias("end"), s["score"].alias("score")))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), F.slice(begins, F.lit(1), F.size(blocks)).alias("o")), move))

    def walked(every):
        width = F.ceil(F.sqrt(F.size(every))).cast("int")
        block = lambda k: F.aggregate(F.slice(every, k * width + 1, width), state, add)
        return let(F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / width).cast("int")), block), shifted)

    has = F.contains(text, F.lit(hint)) if len(hint) == 1 else text.rlike(hint)
    return F.when(has, let(steps, walked)).otherwise(F.expr(EMPTY))


CHUNK = 1024


def chunks(text: Column) -> Column:
    """The text in pieces of ``CHUNK`` code points: an offset is found by walking one piece, not the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def rescored(spans: Column, text: Column, window: int, boost: float) -> Column:
    """Scores with ``boost`` added where a context word of the kind stands within ``window`` code points."""
    if not 0 <= window <= CHUNK:
        raise ValueError(f"window: 0 to {CHUNK}")

    def around(pieces, at, low, high):
        """Code points from ``low`` to before ``high``, counted from ``at``, as far as the text has them."""
        begin = F.greatest(at + low, F.lit(0))
        first = F.floor(begin / CHUNK).cast("int")
        return F.substring(F.array_join(F.slice(pieces, first + 1, 2), ""), begin - first * CHUNK + 1, at + high - begin)

    def one(pieces, s):
        before, after = around(pieces, s["start"], -window, 0), around(pieces, s["end"], 0, window)
        near = F.lower(F.concat(before, F.lit(" "), after))
        helps = reduce(lambda rest, k: F.when(s["kind"] == k[0], near.rlike(rf"(?<![a-z])(?:{k[1][3]})")).otherwise(rest), enumerate(KINDS.values()), F.lit(False))
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.least(F.lit(1.0), s["score"] + F.when(helps, boost).otherwise(0.0)).alias("score"))
    return let(spans, lambda some: F.when(F.size(some) == 0, some).otherwise(let(chunks(text), lambda pieces: F.transform(some, lambda s: one(pieces, s)))))


def find_pii(docs: DataFrame, least_score: float = 0.4, window: int = 40, boost: float = 0.3, text_column: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with a column ``into``: array<struct<start, kind, end, score>>, in order of start, then kind.

    ``kind`` numbers ``KINDS``. Base kinds (email, ip, card, phone) are every leftmost match that its checks
    confirm; others (iban by mod-97; ssn, which context must support; secret, a key or password of both letters and
    digits) count from ``least_score``. Base spans stay
    whatever their score. A null or empty text has none. Row by row: nothing is shuffled, no Python runs.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    every = F.concat(*[found(k, text) for k in KINDS])
    scored = rescored(every, text, window, boost)
    kept = F.filter(scored, lambda s: (s["kind"] < len(BASE)) | (s["score"] >= least_score))
    return docs.withColumn(into, F.array_sort(kept))


def _names(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _names(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_pii(docs: DataFrame, text_column: str = "text", length_column: str | None = "n_chars", **how) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets, overlapping spans as one; the length column, if
    given and there, is counted anew. A null text stays null; repeated rows and rows without id are masked alike; an empty
    table gives an empty result. Columns and their order stay as they were."""
    spot = "__pii"
    while spot in docs.columns:
        spot += "_"
    with_spans = find_pii(docs, text_column=text_column, into=spot, **how)
    text = F.col(text_column)

    def piece_masked(spans, piece, number):
        begin = number * CHUNK
        some = F.filter(spans, lambda s: (s["end"] > begin) & (s["start"] < begin + CHUNK))

        def add(acc, s):
            gap = F.substring(piece, acc["at"] - begin + 1, s["start"] - acc["at"])
            fresh = (s["start"] >= acc["at"]) & (s["start"] >= begin)  # one that began before has its name there
            out = F.when(fresh, F.concat(acc["out"], gap, F.lit("["), F.upper(_names(s["kind"])), F.lit("]"))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

        state = F.struct(begin.alias("at"), F.lit("").alias("out"))
        left = lambda acc: F.concat(acc["out"], F.substring(piece, F.least(acc["at"] - begin, F.lit(CHUNK)) + 1, F.lit(CHUNK)))
        return F.when(F.size(some) == 0, piece).otherwise(F.aggregate(some, state, add, left))

    masked = let(F.col(spot), lambda spans: F.array_join(F.transform(chunks(text), lambda piece, n: piece_masked(spans, piece, n)), ""))
    out = with_spans.withColumn(text_column, F.when(text.isNull() | (F.size(spot) == 0), text).otherwise(masked)).drop(spot)
    if length_column and length_column in docs.columns:
        out = out.withColumn(length_column, F.when(F.col(text_column).isNull(), F.col(length_column)).otherwise(F.length(text_column)).cast(docs.schema[length_column].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def pii_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """One row per document: ``doc_id``, counts of the base kinds, ``base_sha256`` (of the base spans as text) and
    ``spans`` (all spans as text). Repeated rows give repeated results; an empty table gives an empty result;
    other columns are not read."""
    rows = docs.selectExpr(f"cast(`{id_column}` as long) as doc_id", f"`{text_column}` as text")
    found_ = find_pii(rows, text_column="text", into="pii", **how)
    base = F.filter("pii", lambda s: s["kind"] < len(BASE))
    count = lambda n: F.size(F.filter("pii", lambda s: s["kind"] == n)).cast("long")
    return found_.select("doc_id", *[count(n).alias(f"n_{k}") for n, k in enumerate(BASE)], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
