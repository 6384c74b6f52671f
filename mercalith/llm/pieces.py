"""Cutting text into pieces that a byte-level BPE encodes independently, with a bounded cache.

The pre-tokenizer of such a vocabulary always starts a new token at a single space that stands
before a visible character: its alternatives take at most that one space with what follows, and a
run of white space stops before its last character if something visible follows.  Text can thus be
cut there, and equal pieces have equal ids wherever they stand.  Only the vocabulary's added tokens
(such as an end-of-text string) are found before that split; texts holding one are cut around them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Unicode White_Space, which is what \s means to the pre-tokenizer (Python's \s has four more)
WHITE = "\t-\r \x85\xa0  -     　"
_WHITE_RE2 = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_PIECES = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

CACHE_ENTRIES = 700_000
CACHE_CHARS = 48
GROUP_BYTES = 12_000_000


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s : s + n] for each start and length, joined."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def pack(ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """ids[bounds[k] : bounds[k + 1]] for each k as little-endian unsigned 32-bit integers."""
    data = ids.astype("<u4").tobytes()
    at = (4 * bounds).tolist()
    return [data[a:b] for a, b in zip(at, at[1:])]


class PieceEncoder:
    """Encodes texts piece by piece; `encode_many(pieces)` gives the ids of new pieces.

    Up to CACHE_ENTRIES pieces of at most CACHE_CHARS characters are remembered, and texts are
    taken in groups of about GROUP_BYTES (or one longer text), in which each distinct piece is
    looked up once; the memory used does not depend on the size of the input.
    """

    def __init__(
        self, encode_many: Callable[[list[str]], list[bytes]], specials: dict[str, int],
        entries: int | None = None, group_bytes: int | None = None,
    ):
        self.encode_many = encode_many
        self.entries = entries or CACHE_ENTRIES
        self.group_bytes = group_bytes or GROUP_BYTES
        self.specials = specials
        longest_first = sorted(specials, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest_first))) if specials else None
        # a text that single spaces do not cut into pieces, or that holds an added token
        self.odd = "|".join([f" [{_WHITE_RE2}]", r" \z", *map(pc_escape, longest_first)])
        self.known: dict[str, bytes] = {}

    def _ids(self, pieces: list[str], prefix: str) -> list[bytes]:
        """Ids of each piece, `prefix` put before it, as little-endian unsigned 32-bit integers."""
        if prefix:
            keys = pieces
        else:  # a piece as it stands; the mark cannot be confused with a piece after a space
            keys = [" " + x for x in pieces]
        out = list(map(self.known.get, keys))
        new = [i for i, x in enumerate(out) if x is None]
        if new:
            if len(self.known) + len(new) > self.entries:
                self.known.clear()
            found = self.encode_many([prefix + pieces[i] for i in new])
            for i, ids in zip(new, found):
                out[i] = ids
                if len(pieces[i]) <= CACHE_CHARS:
                    self.known[keys[i]] = out[i]
        return out

    def _odd(self, text: str) -> bytes:
        parts: list[bytes] = []
        at = 0
        for m in [*(self.special.finditer(text) if self.special else ()), None]:
            part = text[at : m.start() if m else len(text)]
            pieces = _PIECES.findall(part)
            distinct = list(dict.fromkeys(pieces))
            ids = dict(zip(distinct, self._ids(distinct, "")))
            parts += map(ids.__getitem__, pieces)
            if m:
                parts.append(np.array([self.specials[m[0]]], "<u4").tobytes())
                at = m.end()
        return b"".join(parts)

    def _group(self, texts: pa.Array) -> list[np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        offsets = np.asarray(lists.offsets)
        coded = pc.dictionary_encode(lists.flatten())
        index = np.asarray(coded.indices).astype(np.int64)
        distinct = coded.dictionary.to_pylist()
        heads = offsets[:-1] - offsets[0]
        first = [distinct[i] for i in index[heads]]
        ids = self._ids(distinct, " ") + self._ids(first, "")
        index[heads] = len(distinct) + np.arange(len(heads))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        values = np.frombuffer(b"".join(ids), "<u4")
        starts = np.cumsum(lengths) - lengths
        each = lengths[index]
        flat = gather(values, starts[index], each)
        ends = np.concatenate([[0], np.cumsum(each)])[offsets - offsets[0]].tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    def encode_texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids (unsigned 32-bit) of each text in order; NULL counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
        at = 0
        while at < len(texts):
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + self.group_bytes, side="right")))
            group = texts.slice(at, end - at)
            odd = pc.match_substring_regex(group, self.odd)
            plain = iter(self._group(group.filter(pc.invert(odd)))) if not pc.all(odd).as_py() else iter(())
            for i, strange in enumerate(odd.to_pylist()):
                yield np.frombuffer(self._odd(group[i].as_py()), "<u4") if strange else next(plain)
            at = end


def pc_escape(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", text)
