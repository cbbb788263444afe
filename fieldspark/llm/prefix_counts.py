"""Token counts by prefix dynamic programming over a byte-level BPE vocabulary.

For byte-level BPE whose tokens encode to themselves, the encoding of a prefix is the encoding of a shorter prefix
plus one last token, and that token is valid exactly if it and the token before it encode to just those two. So one
pass over a piece gives the exact token count at each of its prefixes. Texts are cut into units at spaces before a
printable ASCII or Latin letter, where the vocabulary's own splitting pattern always cuts; counts of units add up,
which gives the exact count at every prefix of a text without encoding it again. Counts of words already met are kept
in a bounded table, of which the older half goes when it is full.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from itertools import accumulate, chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_letters, slices, text_rows, tokenizer_file

#: The splitting pattern of this vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SAFE = "[!-~À-ɏ]"
UNSAFE_SPACE = re.compile(f" (?!{SAFE})")
CUT = re.compile(f" (?={SAFE})")
#: Letters only: one piece of the splitting pattern, with the space before it; a stop after them is a piece of its own.
WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,]?)")
#: Entries of a table of counts (some 160 bytes each).
CACHE = 1 << 19
#: Rows whose words are learned at once.
ROWS = 1000


def _drop_half(table: dict) -> None:
    """Drops the older half of a table."""
    for key in list(islice(table, len(table) // 2)):
        del table[key]


class _Units(dict):
    """Token counts of units by their text without the space before it."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, unit: str) -> int:
        self.counter.learn([unit])
        return self[unit]


class PrefixCounter:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        letters = byte_letters()
        self.letters = "".join(letters[b] for b in range(256))
        back = {c: b for b, c in letters.items()}
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special_cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.ids = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.split = regex.compile(PATTERN)
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, tuple] = {}
        self.units = _Units(self)
        self.stop = self.piece(".")[-1] if self.piece(".")[-1] == self.piece(",")[-1] else None

    def _merged(self, raw: bytes) -> list[int]:
        return [t.id for t in self.tok.model.tokenize("".join(self.letters[b] for b in raw))]

    def _follows(self, key: int, a: int, b: int) -> bool:
        """Whether token b can follow token a (a < 0: at the start of a piece); kept under key."""
        ok = self._merged(self.bytes_of[b]) == [b] if a < 0 else self._merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def prefix_counts(self, pieces: list[str]):
        """Token counts at every byte prefix, 0 bytes included, of each piece of the splitting pattern, in turn.

        What a piece shares with the one before it is not computed again, so sorted pieces are cheap. The list that is
        yielded is changed by the next piece. Only one token can be the last of a prefix, so the order in which the
        starts are tried is free: the start of the token before, prolonged by a byte, is tried first.
        """
        longest, token, known, follows = self.longest, self.ids.get, self.pairs.get, self._follows
        raw, last, count, begun = b"", [-1], [0], [0]
        for piece in pieces:
            old, raw = raw, piece.encode()
            top = min(len(old), len(raw))
            same = 0
            while same < top and old[same] == raw[same]:
                same += 1
            del last[same + 1 :], count[same + 1 :], begun[same + 1 :]
            for end in range(same + 1, len(raw) + 1):
                first = begun[end - 1]
                for start in chain((first,), range(end - 1, first, -1), range(first - 1, max(end - longest, 0) - 1, -1)):
                    t = token(raw[start:end])
                    if t is not None:
                        before = last[start]
                        key = before << 24 | t
                        ok = known(key)
                        if follows(key, before, t) if ok is None else ok:
                            last.append(t)
                            count.append(count[start] + 1)
                            begun.append(start)
                            break
                else:
                    raise ValueError("the vocabulary doesn't cover all bytes")
            yield count

    def piece(self, piece: str) -> tuple[int, ...]:
        """prefix_counts, kept for pieces that come again."""
        got = self.pieces.get(piece)
        if got is None:
            if len(self.pieces) >= CACHE:
                _drop_half(self.pieces)
            got = self.pieces[piece] = tuple(next(self.prefix_counts([piece])))
        return got

    def _segments(self, text: str):
        parts = self.special_cut.split(text) if self.special_cut and any(s in text for s in self.special) else [text]
        for i, part in enumerate(parts):
            if i % 2:
                yield None
            else:
                yield from self.split.findall(part)

    def unit(self, unit: str) -> int:
        """Tokens of one unit, its space included."""
        return sum(1 if p is None else self.piece(p)[-1] for p in self._segments(unit))

    def learn(self, units) -> None:
        """Counts the units (each without the space before it) that are not in the table yet, all pieces in sorted order."""
        met, known_units = set(units), self.units
        new = [u for u in met if u not in known_units]
        if len(known_units) + len(new) > CACHE:  # the units of this call must all stay
            _drop_half(known_units)
            new = [u for u in met if u not in known_units]
        parts, known = {}, {None: 1}
        for u in new:
            m = WORD.fullmatch(u)
            if m and not m[2]:
                parts[u] = [" " + u]
            elif m and self.stop is not None:
                known[m[2]] = self.stop
                parts[u] = [" " + m[1], m[2]]
            else:
                parts[u] = list(self._segments(" " + u))
        wanted = sorted({p for ps in parts.values() for p in ps} - known.keys())
        known.update(zip(wanted, (c[-1] for c in self.prefix_counts(wanted))))
        for u, ps in parts.items():
            self.units[u] = sum(map(known.__getitem__, ps))

    @staticmethod
    def cut(text: str) -> list[str]:
        """Units of a text; every unit but the first lacks the space before it."""
        return CUT.split(text) if UNSAFE_SPACE.search(text) else text.split(" ")

    def counts(self, text: str) -> tuple[list[str], list[int]]:
        """Units of a text and the exact token count at the end of each."""
        if not text:
            return [], []
        units = self.cut(text)
        return units, list(accumulate(map(self.units.__getitem__, units[1:]), initial=self.unit(units[0])))

    def unit_ends(self, text: str) -> tuple[list[int], list[int]]:
        """Ends of the units in characters, and the exact token count at each."""
        units, counts = self.counts(text)
        return list(accumulate(len(u) + (i > 0) for i, u in enumerate(units))), counts

    def count(self, text: str) -> int:
        if not text:
            return 0
        units = self.cut(text)
        return self.unit(units[0]) + sum(map(self.units.__getitem__, units[1:]))

    def at(self, text: str, chars: int, ends: tuple[list[int], list[int]] | None = None) -> int:
        """Exact token count of text[:chars]; only the unit that the cut falls in is looked at again."""
        stops, counts = ends or self.unit_ends(text)
        k = bisect_right(stops, chars)
        before, base = (stops[k - 1], counts[k - 1]) if k else (0, 0)
        if chars <= before:
            return base
        return base + sum(1 if p is None else self.piece(p)[-1] for p in self._segments(text[before:chars]))

    def truncate(self, text: str, budget: int) -> int:
        """The largest number of leading characters whose prefix has at most budget tokens."""
        ends = self.unit_ends(text)
        stops, counts = ends
        for k in range(bisect_right(counts, budget), -1, -1):
            lo = stops[k - 1] if k else 0
            hi = stops[k] if k < len(stops) else lo
            for chars in range(hi, lo - 1, -1):
                if self.at(text, chars, ends) <= budget:
                    return chars
        return 0


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each vocabulary and Python worker."""
    path = tokenizer_file(path)
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, limit_chars for every row.

    limit_chars is the length of the longest prefix of whole units with at most `limit` tokens. Null text counts as
    empty: 0 bytes, 0 tokens. Special strings in a text count as the library does by default (one token). Repeated
    rows and ids give a row each; other columns are not read; an empty table gives an empty result.
    """

    def run(batches):
        c = counter(vocabulary)
        for batch in slices(batches, ROWS):
            sizes, totals, chars = [], [], []
            texts = batch.column(1).to_pylist()
            c.learn(chain.from_iterable(islice(c.cut(text), 1, None) for text in texts))
            for text in texts:
                sizes.append(len(text.encode()))
                units, counts = c.counts(text)
                totals.append(counts[-1] if counts else 0)
                k = bisect_right(counts, limit)
                chars.append(len(text) if k == len(units) else sum(map(len, units[:k])) + max(k - 1, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_()), pa.array(chars, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"],
            )

    return text_rows(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long")
