"""Byte-level BPE over words: exact ids with a memo, and token counts of every prefix by dynamic programming."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: On texts of Latin characters only, the classes of ``re`` spelt out here mean what \p{L}, \p{N} and \s mean.
LATIN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+")
BEYOND = re.compile("[^\\t-\\r\\x20-\\x7e\\x85\\xa0-ɏ]")
BLANK, LETTER, DIGIT, OTHER, UNKNOWN = range(5)
#: The class of each character that two bytes can write, as ``LATIN`` and ``BEYOND`` have it.
KINDS = np.array([
    UNKNOWN if BEYOND.match(c) else BLANK if c.isspace() else LETTER if re.match(f"[{LETTERS}]", c) else DIGIT if re.match(f"[{DIGITS}]", c) else OTHER
    for c in map(chr, range(0x280))], np.uint8)
BYTE_KINDS = np.concatenate([KINDS[:0x80], np.full(0x80, UNKNOWN, np.uint8)])


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Splitter:
    """Cuts a text into the pieces that BPE treats on their own, added tokens first, as the tokenizer file says."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        kind = self.spec["pre_tokenizer"]
        if self.spec["normalizer"] or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"]:
            raise ValueError(f"{path}: not a plain byte-level tokenizer")
        self.added = {x["content"]: x["id"] for x in self.spec["added_tokens"]}
        self._added = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self._any = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def pieces(self, text: str) -> list[str]:
        if self._added and any(x in text for x in self.added):
            out: list[str] = []
            for k, part in enumerate(self._added.split(text)):
                out += [part] if k % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        return self._any.findall(text) if BEYOND.search(text) else LATIN.findall(text)

    def starts(self, data: bytes, at: np.ndarray) -> np.ndarray:
        """Where the pieces of many texts begin, ascending: as ``pieces`` cuts them, but without a string for each. The
        texts lie one after another in ``data`` (UTF-8), text k from ``at[k]`` to ``at[k + 1]``. Texts with characters
        beyond ``LATIN``, or with added tokens, are cut one by one by ``pieces``.
        """
        size, raw = len(data), np.frombuffer(data + b"\0\0", np.uint8)
        kind = BYTE_KINDS[raw[:size]]
        two = np.flatnonzero((raw[:size] >= 0xC0) & (raw[:size] < 0xCA))  # of two bytes, both of one class
        kind[two] = kind[two + 1] = KINDS[(raw[two].astype(np.int64) & 0x1F) << 6 | raw[two + 1] & 0x3F]
        edge = np.zeros(size + 3, bool)
        edge[at] = True
        first = edge[: size + 1].copy()
        first[1:-1] |= kind[1:] != kind[:-1]

        # the last of some blanks goes to what follows if it is a space, else it is a piece
        b = 1 + np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] != BLANK))
        b = b[~edge[b]]
        first[b - 1 - (raw[b - 1] >= 0x80)] = True
        first[b[raw[b - 1] == 0x20]] = False

        # contractions: an apostrophe that begins a piece, and one or two letters
        p = np.flatnonzero((raw[:size] == 0x27) & first[:-1])
        x, y = raw[p + 1], raw[p + 2]
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8)) & ~edge[p + 1]
        pair = (((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))) & ~edge[p + 1] & ~edge[p + 2]
        first[p[one | pair] + 1] = False
        first[p[one] + 2] = first[p[pair] + 3] = True

        odd = [np.flatnonzero(kind == UNKNOWN)]
        for token in self.added:
            odd.append(np.array([m.start() for m in re.finditer(re.escape(token.encode()), data)], np.int64))
        for k in np.unique(np.searchsorted(at, np.concatenate(odd), "right") - 1).tolist():
            low, high = int(at[k]), int(at[k + 1])
            first[low + 1 : high] = False
            first[low + np.cumsum([len(x.encode()) for x in self.pieces(data[low:high].decode())])[:-1]] = True
        return np.flatnonzero(first[:-1])

    def column(self, texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The texts of a string column one after another (UTF-8; a null text is an empty one), where each begins, and
        where each of their pieces does; both end with the length of the whole."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2].slice(at[0], at[-1] - at[0]).to_pybytes() if at[-1] > at[0] else b""
        at = at - at[0]
        return data, at, np.append(self.starts(data, at), len(data))


def _coded(data: bytes, cuts: np.ndarray, at_once: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """The different ones among ``at_once`` pieces at a time, and each piece as its place among them."""
    pieces = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data))
    for k in range(0, len(pieces), at_once):
        coded = pieces.slice(k, at_once).dictionary_encode()
        yield coded.dictionary.to_pylist(), coded.indices.to_numpy()


class Memo(dict):
    """piece -> value, worked out when first asked for; emptied at ``most`` entries, so memory stays bounded."""

    def __init__(self, work, most: int):
        self.work, self.most = work, most

    def __missing__(self, piece):
        if len(self) >= self.most:
            self.clear()
        value = self.work(piece)
        if not isinstance(piece, str) or len(piece) < 64:
            self[piece] = value
        return value


class Ids:
    """Token ids of whole texts as little-endian unsigned 32-bit values, from the tokenizers library.

    A column of texts is cut into pieces at once; the library is asked for each different piece that the memo does not
    hold. The memo has at most ``most`` pieces; when it is full, those of the texts at hand stay, common ones among them.
    """

    def __init__(self, path: str, most: int = 300_000, at_once: int = 1 << 20):
        from tokenizers import Tokenizer

        self.splitter, self.model = Splitter(path), Tokenizer.from_file(path).model
        self.splitter.spec = None  # the model has what of it is used here
        self.letters = {b: c for c, b in _byte_letters().items()}
        self.space = self.letters[0x20]
        self.memo, self.most, self.at_once = {}, most, at_once

    def _piece(self, piece: str) -> bytes:
        if piece in self.splitter.added:
            ids = [self.splitter.added[piece]]
        elif piece.isascii() and piece.isprintable():  # all but the space are their own letters
            ids = [x.id for x in self.model.tokenize(piece.replace(" ", self.space))]
        else:
            ids = [x.id for x in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _values(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces."""
        values = list(map(self.memo.get, pieces))
        missing = [k for k, x in enumerate(values) if x is None]
        for k in missing:
            values[k] = self._piece(pieces[k])
        if len(self.memo) + len(missing) > self.most:
            self.memo, missing = {}, range(min(len(pieces), self.most))
        self.memo.update((pieces[k], values[k]) for k in missing if len(pieces[k]) < 64)
        return values

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a string column; a null text is an empty one."""
        if not len(texts):
            return []
        data, at, cuts = self.splitter.column(texts)
        found, counts = [np.zeros(0, "<u4")], [np.zeros(1, np.int64)]
        for pieces, code in _coded(data, cuts, self.at_once):
            values = self._values(pieces)
            lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
            count = lengths[code]
            ends = np.cumsum(count)
            shift = (np.cumsum(lengths) - lengths)[code] - (ends - count)  # from a place here to its id's among the values
            found.append(np.frombuffer(b"".join(values), "<u4")[np.repeat(shift, count) + np.arange(ends[-1])])
            counts.append(count)
        ids = np.concatenate(found)
        bounds = np.cumsum(np.concatenate(counts))[np.searchsorted(cuts, at)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounts:
    """Exact BPE token counts of every byte prefix of a piece.

    A run of tokens is what BPE makes of its bytes exactly when each token stands for itself and each two
    neighbours, merged on their own, come out as those two. So every prefix has one possible last token: the one
    that agrees with the last token of the prefix before it, and ``count[i] = count[i - len(last)] + 1``.
    """

    def __init__(self, path: str, most: int = 300_000, at_once: int = 1 << 20):
        self.splitter = Splitter(path)
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        model = self.splitter.spec["model"]
        self.ids = {raw(k): v for k, v in model["vocab"].items()}
        self.bytes = {v: k for k, v in self.ids.items()}
        self.ranks, self.made, made, self.in_order = {}, {}, {}, True
        for k, pair in enumerate(model["merges"]):
            a, b = map(raw, pair if isinstance(pair, list) else pair.split(" "))
            self.ranks[a, b] = k
            # whether each token has one merge that makes it, later than those of its halves
            self.in_order &= a + b not in made and all(len(x) == 1 or x in made for x in (a, b))
            made[a + b] = k
            self.made[self.ids.get(a + b)] = (k, self.ids.get(a), self.ids.get(b))
        self.joined = {(self.ids.get(a), self.ids.get(b)): k for (a, b), k in self.ranks.items()}
        self.in_order &= not any(None in x for x in self.joined) and None not in self.made

        # all tokens that end at a byte: what of the bytes before it is the start of a token, as one number, leads there
        self.states = [b"", *sorted({token[:k] for token in self.ids for k in range(1, len(token) + 1)})]
        self.state_of = {x: k for k, x in enumerate(self.states)}
        self.step, self.ending = Memo(self._step, 2 * most), Memo(self._ending, most)
        self.agree = Memo(self._agree, 2 * most)
        self.memo, self.most, self.at_once = Memo(lambda piece: int(self.prefixes(piece)[-1]), most), most, at_once

    def _step(self, key: int) -> int:
        """The state after one more byte (state << 8 | byte)."""
        text = self.states[key >> 8] + bytes([key & 0xFF])
        while text not in self.state_of:
            text = text[1:]
        return self.state_of[text]

    def _ending(self, state: int) -> tuple:
        """The tokens that end where a state is reached, longest first, with their lengths."""
        text = self.states[state]
        return tuple((self.ids[text[k:]], len(text) - k) for k in range(len(text)) if text[k:] in self.ids)

    def _merge(self, data: bytes) -> list[bytes]:
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            best = min(((self.ranks.get((a, b), 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == 1 << 30:
                break
            a, b = parts[best[1]], parts[best[1] + 1]
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and parts[k] == a and parts[k + 1] == b:
                    out.append(a + b)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def _agree(self, key: int) -> bool:
        """Whether two neighbours (first << 20 | second; first -1: the second alone) come out of a merge as they are.
        The first of two is known to stand for itself."""
        first, second = key >> 20, key & 0xFFFFF
        if first >= 0 and self.in_order:
            return self.agree[-1 << 20 | second] and self._apart(first, second)
        parts = [self.bytes[x] for x in (first, second) if x >= 0]
        return self._merge(b"".join(parts)) == parts

    def _apart(self, first: int, second: int) -> bool:
        """``_agree`` for two tokens that stand for themselves, without a merge.

        Merges are undone from the last on, which leaves those that can meet: the first's right end and the second's left
        one. They would have been joined if that comes before what was undone last; of equal ranks the left one is first.
        """
        made, before = self.made, len(self.ranks)
        while True:
            if self.joined.get((first, second), before) < before:
                return False
            left, right = made.get(first), made.get(second)
            if left and (not right or left[0] > right[0]):
                before, first = left[0], left[2]
            elif right:
                before, second = right[0] + 1, right[1]
            else:
                return True

    def _walk(self, pieces: Iterable[bytes]) -> Iterator[list[int]]:
        """Of each piece the tokens of its first i bytes, i from 0, in one list that the next piece changes. What a piece
        has in common with the start of the one before it is not gone through again."""
        agree, step, ending = self.agree, self.step, self.ending
        before, states, last, count = b"", [0], [-1], [0]
        for data in pieces:
            same, most = 0, min(len(before), len(data))
            if before[:most] == data[:most]:
                same = most
            while same < most and before[same] == data[same]:
                same += 1
            del states[same + 1 :], last[same + 1 :], count[same + 1 :]
            state, before = states[same], data
            for end, byte in enumerate(data[same:], same + 1):
                state = step[state << 8 | byte]
                for token, length in ending[state]:
                    if agree[last[end - length] << 20 | token]:
                        break
                else:
                    raise ValueError(f"no encoding of {data!r}")
                states.append(state)
                last.append(token)
                count.append(count[end - length] + 1)
            yield count

    def prefixes(self, piece: str) -> np.ndarray:
        """count[i]: tokens of the first i bytes of the piece, i from 0."""
        if piece in self.splitter.added:
            return self._added_prefixes(piece)
        return np.array(next(self._walk([piece.encode()])), np.int64)

    def _added_prefixes(self, piece: str) -> np.ndarray:
        parts = [self.count(piece[:k]) if k < len(piece) else 1 for k in range(len(piece) + 1)]
        return np.array(parts, np.int64)

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        return sum(map(self.memo.__getitem__, self.splitter.pieces(text)))

    def _counts(self, pieces: list[str]) -> list[int]:
        """Tokens of different pieces, in their sorted order as far as the memo does not hold them: neighbours there
        begin alike."""
        values = list(map(self.memo.get, pieces))
        missing = sorted((x.encode(), k) for k, (x, v) in enumerate(zip(pieces, values, strict=True)) if v is None and x not in self.splitter.added)
        for (_, k), count in zip(missing, self._walk(x for x, _ in missing), strict=True):
            values[k] = count[-1]
        values = [1 if v is None else v for v in values]  # an added token
        kept = [k for _, k in missing]
        if len(self.memo) + len(kept) > self.most:
            self.memo.clear()
            kept = range(min(len(pieces), self.most))
        self.memo.update((pieces[k], values[k]) for k in kept if len(pieces[k]) < 64)
        return values

    def column(self, texts: pa.Array, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes and tokens of each text of a string column (a null text is an empty one), and the code points of its
        ``longest_prefix`` within ``budget`` tokens. No string is made for a piece that is not the first of its kind."""
        data, at, cuts = self.splitter.column(texts)
        counts = [np.array(self._counts(pieces), np.int64)[code] for pieces, code in _coded(data, cuts, self.at_once)]
        done = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))])
        first = np.searchsorted(cuts, at)
        tokens = np.diff(done[first])
        fits = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = lambda k: data[cuts[k] : cuts[k + 1]].decode()
        for k in np.flatnonzero(tokens > budget):
            low = first[k]
            here = int(np.searchsorted(done, done[low] + budget, "right")) - 1
            inside = self._fitting(int(done[here] - done[low]), piece(here - 1) if here > low else "", piece(here), budget)
            fits[k] = len(data[at[k] : cuts[here]].decode()) + inside
        return np.diff(at), tokens, fits

    def _fitting(self, done: int, before: str, piece: str, budget: int) -> int:
        """Code points of the piece at which the budget runs out that fit; ``done`` and ``before`` as in ``_within``."""
        fits = np.flatnonzero(self._within(done, before, piece) <= budget)
        return int(fits[-1]) + 1 if len(fits) else 0

    def _within(self, done: int, before: str, piece: str) -> np.ndarray:
        """Tokens of the texts that end after 1, 2, ... code points of a piece; ``done`` tokens lie before the piece,
        and ``before`` is the piece before it.

        From its second code point on, the start of a piece is one piece itself, so the counts are those of its
        prefixes. The first can join blanks before it; a contraction or an added token falls apart when cut.
        """
        if piece in self.splitter.added or (piece[0] == "'" and len(piece) <= 3):
            outside = done - (self.memo[before] if before else 0)
            found = np.array([outside + self.count(before + piece[:k]) for k in range(1, len(piece))] + [done + self.memo[piece]], np.int64)
        else:
            widths = np.cumsum([len(c.encode()) for c in piece])
            found = done + self.prefixes(piece)[widths]
        if before and piece not in self.splitter.added:
            found[0] = done - self.memo[before] + self.count(before + piece[0])
        return found

    def every_prefix(self, text: str) -> np.ndarray:
        """count[k]: tokens of the first k code points of the text, each exactly as that prefix encodes on its own."""
        counts, done, before = [np.zeros(1, np.int64)], 0, ""
        for piece in self.splitter.pieces(text):
            counts.append(self._within(done, before, piece))
            done += self.memo[piece]
            before = piece
        return np.concatenate(counts)

    def longest_prefix(self, text: str, budget: int) -> int:
        """Code points of the longest prefix within ``budget`` tokens, among those that end in the piece at which the
        budget runs out, or before it."""
        done, at, before = 0, 0, ""
        for piece in self.splitter.pieces(text):
            here = self.memo[piece]
            if done + here > budget:
                return at + self._fitting(done, before, piece, budget)
            done, at, before = done + here, at + len(piece), piece
        return at
