"""Byte-level BPE encoding and decoding.

Encoding: the pre-tokeniser's pattern is evaluated on arrays of code points; each distinct
pre-token passes once through ``Transducer``, whose results a table of bounded size keeps.

The transducer reads bytes from left to right. For each prefix it holds the one vocabulary
token that ends the prefix's own encoding: a token t after a prefix that ends in p is right
if and only if the pair (p, t) survives its own merges. A later byte can only reach back by
the longest token, so ``lookahead`` prefixes are enough: once the backward paths of all of
them run through one place, everything before it is stable and is emitted. Memory is
bounded by the window, not by the text.

Decoding: token bytes go through an incremental UTF-8 state machine.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import shared

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Entries of the table of known pre-tokens; it starts anew when it is full.
KNOWN_ENTRIES = 1_000_000


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files of byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, merge results and special tokens of a byte-level BPE file (JSON)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special = special
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {to_bytes(k): v for k, v in data["model"]["vocab"].items() if k not in special}
        self.bytes_of = {v: k for k, v in self.ids.items()} | {v: k.encode() for k, v in special.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.order: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = (self.ids[to_bytes(x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            new = self.ids[self.bytes_of[left] + self.bytes_of[right]]
            self.merged[left, right] = new
            self.order.setdefault(new, rank)
            self.parts.setdefault(new, (left, right))
        size = max(self.bytes_of) + 1
        self.size = size
        self.byte_table = _Flat([self.bytes_of.get(i, b"") for i in range(size)])
        self.decimal_table = _Flat([b"%d," % i for i in range(size)])


class _Flat:
    """Byte strings by number, gathered for arrays of numbers without a loop."""

    def __init__(self, items: list[bytes]) -> None:
        self.lengths = np.array([len(x) for x in items], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.data = np.frombuffer(b"".join(items), np.uint8)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all items one after the other, and the end of each."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[numbers] - (ends - lengths), lengths)
        shift += np.arange(len(shift))
        return self.data[shift], ends


class Table:
    """Open addressing on arrays: 64-bit hashes to numbers, found and added many at a time."""

    def __init__(self, bits: int) -> None:
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where there is none."""
        found = np.full(len(h), -1, np.int64)
        slot = self._slots(h)
        open_ = np.arange(len(h))
        while len(open_):
            at = slot[open_]
            key = self.keys[at]
            hit = key == h[open_]
            found[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (key != 0)]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return found

    def add(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct hashes that the table doesn't hold."""
        self.n += len(h)
        slot = self._slots(h)
        open_ = np.arange(len(h))
        while len(open_):
            at = slot[open_]
            free = np.flatnonzero(self.keys[at] == 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]] = h[open_[put]]
            self.values[at[put]] = numbers[open_[put]]
            rest = np.ones(len(open_), bool)
            rest[put] = False
            open_ = open_[rest]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)


class Transducer:
    """Streaming encoder of one pre-token: feed bytes, get the ids that are stable."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.lookahead = max(map(len, vocabulary.ids))
        self._fits: dict[tuple[int, int], bool] = {}
        self._pairs = Table(21)
        #: Longest token that ends in a given pair of bytes: bounds the candidates of a place.
        self._reach: dict[bytes, int] = {}
        for token in vocabulary.ids:
            if len(token) > 1:
                self._reach[token[-2:]] = max(self._reach.get(token[-2:], 0), len(token))
        self._reach_of = np.ones(1 << 16, np.int64)
        for pair, n in self._reach.items():
            self._reach_of[pair[0] << 8 | pair[1]] = n
        flat = _Flat([*vocabulary.ids])
        self._tokens = Table(18)
        self._tokens.add(shared.span_hashes(flat.data, flat.starts, flat.starts + flat.lengths), np.array([*vocabulary.ids.values()]))

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens, encoded as one string, stay these two tokens."""
        key = (left, right)
        if (known := self._fits.get(key)) is None:
            if len(self._fits) > KNOWN_ENTRIES:
                self._fits.clear()
            known = self._fits[key] = self._survives(left, right)
        return known

    def _survives(self, left: int, right: int) -> bool:
        # Undo the later of the merges at the boundary, again and again; a merge across the
        # boundary that comes before the ones undone so far would have happened first.
        order, parts, merged = self.v.order, self.v.parts, self.v.merged
        limit = float("inf")
        while True:
            joint = merged.get((left, right))
            if joint is not None and order[joint] < limit:
                return False
            a, b = order.get(left, -1), order.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, parts[left][1]
            else:
                # At equal times the left occurrence is merged first: the boundary pair may still win a tie.
                limit, right = b + 0.5, parts[right][0]

    def encode(self, data: bytes) -> list[int]:
        return [i for part in self.stream([data]) for i in part]

    def stream(self, chunks) -> Iterator[list[int]]:
        """Lists of ids, each emitted once no later byte can change it."""
        ids, fits, reach, window = self.v.ids, self.fits, self._reach, self.lookahead
        data = b""  # bytes after the last emitted token
        last: list[int] = []  # for the prefix of length i + 1: its last token
        for chunk in chunks:
            for cut in range(0, len(chunk), 4 * window):
                i = len(data)
                data += chunk[cut : cut + 4 * window]
                while i < len(data):
                    i += 1
                    for n in range(min(i, max(1, reach.get(data[max(0, i - 2) : i], 1))), 0, -1):
                        token = ids.get(data[i - n : i])
                        if token is not None and (n == i or fits(last[i - n - 1], token)):
                            last.append(token)
                            break
                if i > 8 * window:
                    places = self._stable(last, i)
                    if places:
                        yield [last[p - 1] for p in places]
                        # The prefixes after the stable place keep their tokens: they hang on it.
                        data, last = data[places[-1] :], last[places[-1] :]
                        last = self._rebase(data, last)
        yield [last[p - 1] for p in self._path(last, len(last))]

    def encode_many(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of many pieces: short ones step through the same prefixes side by side on arrays."""
        order = sorted(range(len(pieces)), key=lambda k: -len(pieces[k]))
        out: list[list[int]] = [[]] * len(pieces)
        while order and len(pieces[order[0]]) > 64:
            k = order.pop(0)
            out[k] = self.encode(pieces[k])
        if not order:
            return out
        flat = _Flat([pieces[k] for k in order])
        size = self.v.byte_table.lengths
        most = int(flat.lengths[0])
        last = np.full((len(order), most + 1), -1, np.int64)
        for i in range(1, most + 1):
            open_ = np.arange(np.searchsorted(-flat.lengths, -i, side="right"))
            end = flat.starts[open_] + i
            two = (flat.data[end - 2].astype(np.int64) << 8 | flat.data[end - 1]) if i > 1 else None
            reach = np.minimum(self._reach_of[two], i) if i > 1 else np.ones(len(open_), np.int64)
            for n in range(int(reach.max(initial=0)), 0, -1):
                able = open_[reach[open_] >= n]
                if not len(able):
                    continue
                stop = flat.starts[able] + i
                token = self._tokens.find(shared.span_hashes_at(flat.data, stop - n, n))
                able, token = able[token >= 0], token[token >= 0]
                if n < i and len(able):
                    right = self._fit_many(last[able, i - n], token)
                    able, token = able[right], token[right]
                last[able, i] = token
                open_ = open_[last[open_, i] < 0]
        at, ids, owners = flat.lengths.copy(), [], []
        rows = np.flatnonzero(at > 0)
        while len(rows):
            token = last[rows, at[rows]]
            ids.append(token)
            owners.append(rows)
            at[rows] -= size[token]
            rows = rows[at[rows] > 0]
        if ids:
            owner, token = np.concatenate(owners)[::-1], np.concatenate(ids)[::-1]
            place = np.argsort(owner, kind="stable")
            token = token[place].tolist()
            stops = np.cumsum(np.bincount(owner, minlength=len(order))).tolist()
            for k, i, j in zip(order, [0, *stops], stops, strict=False):
                out[k] = token[i:j]
        return out

    def _fit_many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = shared.mix((left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)) + np.uint64(1))
        found = self._pairs.find(key)
        new = np.flatnonzero(found < 0)
        if len(new):
            distinct, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            if self._pairs.n + len(distinct) > KNOWN_ENTRIES:
                self._pairs = Table(21)
            pairs = zip(left[new[first]].tolist(), right[new[first]].tolist(), strict=True)
            fits = np.array([self._survives(a, b) for a, b in pairs], np.int64)
            if len(distinct) <= KNOWN_ENTRIES:
                self._pairs.add(distinct, fits)
            found[new] = fits[back]
        return found > 0

    def _rebase(self, data: bytes, last: list[int]) -> list[int]:
        """Tokens by prefix after emission; a token that reached before the cut belongs to a dead path."""
        size = {t: len(b) for t in set(last) if (b := self.v.bytes_of[t]) is not None}
        return [t if size[t] <= i + 1 else -1 for i, t in enumerate(last)]

    def _path(self, last: list[int], end: int) -> list[int]:
        """Ends of the tokens of the prefix of this length."""
        ends = []
        while end:
            ends.append(end)
            end -= len(self.v.bytes_of[last[end - 1]])
        return ends[::-1]

    def _stable(self, last: list[int], end: int) -> list[int]:
        """Ends of the tokens on which the paths of all prefixes in the window agree."""
        common: set[int] | None = None
        for p in range(max(1, end - self.lookahead), end + 1):
            if last[p - 1] < 0:
                continue
            places, q = set(), p
            while q > 0:
                places.add(q)
                token = last[q - 1]
                if token < 0:
                    places = set()
                    break
                q -= len(self.v.bytes_of[token])
            if q:
                continue
            common = places if common is None else common & places
        if not common:
            return []
        place = max(common)
        return self._path(last, place)


class Utf8Machine:
    """Bytes in, text out; a sequence that is not complete yet is held back (three bytes at most)."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                if need > back:
                    cut = len(data) - back
                break
            if byte < 0x80:
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The pre-tokeniser's class of each code point."""
    if not _CLASSES:
        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(chr(i) if not 0xD800 <= i < 0xE000 else "\0" for i in range(0x110000))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                table[m.start() : m.end()] = kind
        # The White_Space property of Unicode.
        for low, high in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
            table[low : high + 1] = SPACE
        _CLASSES.append(table)
    return _CLASSES[0]


def pretoken_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of texts start: contractions, runs of letters, numbers or other signs
    with a space before them, white space up to the last one before a word."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    run = start.copy()
    space = kind == SPACE
    last_space = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:n])
    start[last_space] = True
    start[last_space[points[last_space] == 32] + 1] = False
    quote = np.flatnonzero((points == 39) & run & start)
    if len(quote):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        ended = np.concatenate([edge, [True, True]])
        one, two = padded[quote + 1], padded[quote + 2]
        short = ~ended[quote + 1] & np.isin(one, [ord(c) for c in "stmd"])
        pair = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        long = ~ended[quote + 1] & ~ended[quote + 2] & pair
        for where, size in ((quote[short], 2), (quote[long], 3)):
            start[where + 1] = False
            after = where + size
            start[after[after < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes Arrow columns of texts; ``miss`` gives the ids of pre-tokens that are not known yet."""

    def __init__(self, special: dict[str, int], miss: Callable[[list[str]], list[list[int]]]) -> None:
        self.special, self.miss = special, miss
        self.clear()

    def clear(self) -> None:
        self.known = Table(21)
        self.used = 0
        self.start = np.zeros(KNOWN_ENTRIES, np.int64)
        self.length = np.zeros(KNOWN_ENTRIES, np.int64)
        self.flat = np.zeros(1 << 20, np.uint32)

    def _add(self, h: np.ndarray, ids: list[list[int]]) -> np.ndarray:
        numbers = np.arange(self.known.n, self.known.n + len(h))
        lengths = np.array([len(x) for x in ids], np.int64)
        total = int(lengths.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.start[numbers] = self.used + np.cumsum(lengths) - lengths
        self.length[numbers] = lengths
        self.flat[self.used : self.used + total] = [i for x in ids for i in x]
        self.used += total
        self.known.add(h, numbers)
        return numbers

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets of the texts in them."""
        text, offsets = shared.joined(column)
        if any(s in text for s in self.special):
            return self._with_special(column)
        points = shared.code_points(text)
        starts = pretoken_starts(points, offsets)
        ends = np.append(starts[1:], len(points)) if len(starts) else starts
        h = shared.span_hashes(points, starts, ends)
        at = self.known.find(h)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, first, back = np.unique(h[missing], return_index=True, return_inverse=True)
            if self.known.n + len(new) > KNOWN_ENTRIES:
                if len(new) > KNOWN_ENTRIES // 2 and len(column) > 1:  # room for each half
                    half = len(column) // 2
                    (a, i), (b, j) = self.encode(column[:half]), self.encode(column[half:])
                    return np.concatenate([a, b]), np.concatenate([i, j[1:] + i[-1]])
                self.clear()
                return self.encode(column) if len(new) <= KNOWN_ENTRIES else self._direct(text, starts, ends, offsets)
            where = missing[first]
            ids = self.miss([text[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            at[missing] = self._add(new, ids)[back]
        lengths = self.length[at]
        stop = np.cumsum(lengths)
        shift = np.repeat(self.start[at] - (stop - lengths), lengths)
        shift += np.arange(len(shift))
        by_piece = np.concatenate([[0], stop])
        return self.flat[shift], by_piece[np.searchsorted(starts, offsets)]

    def _direct(self, text: str, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One text with more distinct pre-tokens than the table has room for."""
        ids = self.miss([text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        by_piece = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        return np.array([i for x in ids for i in x], np.uint32), by_piece[np.searchsorted(starts, offsets)]

    def _with_special(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        parts, owners = [], []
        for i, text in enumerate(column.to_pylist()):
            for part in pattern.split(text or ""):
                parts.append(part)
                owners.append(i)
        plain = pa.array(["" if p in self.special else p for p in parts], pa.large_string())
        ids, offsets = self.encode(plain)
        out, lengths = [], np.zeros(len(column), np.int64)
        for k, (part, i) in enumerate(zip(parts, owners, strict=True)):
            own = np.array([self.special[part]], np.uint32) if part in self.special else ids[offsets[k] : offsets[k + 1]]
            out.append(own)
            lengths[i] += len(own)
        return np.concatenate(out) if out else ids, np.concatenate([[0], np.cumsum(lengths)])


_MADE: dict[str, tuple[Vocabulary, Transducer, Encoder]] = {}


def transducer_encoder(path: str) -> tuple[Vocabulary, Transducer, Encoder]:
    """Made once in each Python worker."""
    if path not in _MADE:
        vocabulary = Vocabulary(path)
        transducer = Transducer(vocabulary)
        _MADE[path] = vocabulary, transducer, Encoder(vocabulary.special, lambda pieces: transducer.encode_many([p.encode() for p in pieces]))
    return _MADE[path]


def decode(vocabulary: Vocabulary, ids: np.ndarray, block: int = 65_536) -> Iterator[str]:
    """Text of ids, in parts."""
    machine = Utf8Machine()
    for i in range(0, len(ids), block):
        yield machine.feed(vocabulary.byte_table.gather(ids[i : i + block])[0].tobytes())
    yield machine.finish()


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``id_col``, ids (array), in the order of the vocabulary file's own tokeniser.

    Null text counts as empty: no ids. Repeated rows and equal ids each give their own row;
    other columns are not read. Tables without rows give none.
    """

    def run(batches):
        encoder = transducer_encoder(path)[2]
        for batch in batches:
            for a, b in shared.steps(batch.column(1)):
                ids, offsets = encoder.encode(batch.column(1)[a:b])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], lists], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(shared.tidy(run), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode: number of ids and digests of the ids and of the decoded text.

    Edge cases as in ``encode_documents``; an empty text has the digests of the empty string.
    """

    def run(batches):
        vocabulary, _, encoder = transducer_encoder(path)
        for batch in batches:
            for a, b in shared.steps(batch.column(1)):
                ids, offsets = encoder.encode(batch.column(1)[a:b])
                counts, ids_sha, text_sha = [], [], []
                for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own, sha, text = ids[i:j], hashlib.sha256(), hashlib.sha256()
                    for k in range(0, len(own), 65_536):
                        digits = vocabulary.decimal_table.gather(own[k : k + 65_536])[0]
                        sha.update(digits if k + 65_536 < len(own) else digits[:-1])
                    for part in decode(vocabulary, own):
                        text.update(part.encode())
                    counts.append(len(own))
                    ids_sha.append(sha.hexdigest())
                    text_sha.append(text.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(shared.tidy(run), f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
