"""Collocations: phrases of a few words that occur together far more often than their parts.

Texts are cut into pieces and words; within a shard (a bounded number of words of a task)
every word gets a bitmap of its positions, compressed to the 64-bit blocks that are not
empty. Positions leave a gap between pieces. A phrase is extended depth first: its bitmap is
shifted by one, ANDed with the bitmaps of the words in the same blocks, and the popcounts
are the longer phrases' occurrences. Summed over the shards they are exact.

Phrases that are rare everywhere are pruned: a first pass counts 64-bit hashes of the
phrases shorter than the longest; those that are frequent enough set two bits each in a
filter of at most ``FILTER_BITS`` bits, which all tasks get. Phrases are extended, and their
strings counted, only where the filter holds both the phrase without its last and without
its first word. A full filter prunes less and changes no result.

Scale: only counts move, never texts or bitmaps; a phrase, however frequent, is one row a
shard. The filter (32 MB at most) is all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Words of a shard; a piece without an end may be longer.
SHARD_WORDS = 1_000_000
#: ANDs of two blocks that one step makes, which bounds its arrays.
STEP_PAIRS = 500_000
#: Documents of a batch that are read at once.
READ_ROWS = 256
#: Most bits of the filter, 32 MB.
FILTER_BITS = 1 << 28
#: Bytes of a text that are split at once.
SEGMENT = 1 << 22
UNKNOWN = "und"

_GAP = b"\xff"
#: A-Z to a-z and the ends of pieces to a byte that UTF-8 does not have.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Numbers of (language, word) pairs, given in order of appearance."""

    def __init__(self, held: list, lang: str) -> None:
        self.held, self.lang = held, lang

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.held)
        self.held.append((self.lang, word))
        return n


def tokens_of(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text, with gaps between its pieces, in lists of bounded size (a longer piece stands alone)."""
    low = raw.translate(_TABLE)
    start = 0
    while start < len(low):
        stop = low.rfind(_GAP, start, start + SEGMENT) + 1 if len(low) - start > SEGMENT else len(low)
        if stop <= start:
            stop = low.find(_GAP, start + SEGMENT) + 1 or len(low)
        yield low[start:stop].replace(_GAP, b" \xff ").split()
        start = stop


class Shard:
    """Position bitmaps of the words of a shard, and the search over them."""

    def __init__(self, ids: np.ndarray, words: list[tuple[str, bytes]]) -> None:
        """``ids``: word numbers in order, -1 for gaps."""
        self.words, self._columns = words, None
        at = np.flatnonzero(ids >= 0)
        bits = max(len(ids), 1).bit_length()
        at |= ids[at].astype(np.int64) << bits
        at.sort()  # by word, then position
        word, at = at >> bits, at & ((1 << bits) - 1)
        block = at >> 6
        self.n_blocks = (len(ids) >> 6) + 2
        key = word * self.n_blocks + block
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        bits = np.left_shift(np.uint64(1), (at & 63).astype(np.uint64))
        self.word, self.block = word[first], block[first]
        self.mask = np.bitwise_or.reduceat(bits, first) if len(first) else bits
        self.counts = np.bincount(word, minlength=len(words)) if len(words) else np.zeros(0, np.int64)
        order = np.argsort(self.block, kind="stable")
        self.by_word, self.by_mask = self.word[order], self.mask[order]
        self.begin = np.searchsorted(self.block[order], np.arange(self.n_blocks + 1))

    def columns(self) -> tuple[pa.Array, pa.Array]:
        """Languages and words, by number."""
        if self._columns is None:
            self._columns = pa.array([lang for lang, _ in self.words], pa.string()), pa.array([w for _, w in self.words], pa.binary()).cast(pa.string())
        return self._columns

    def hashes(self) -> np.ndarray:
        """64 bits of each word and its language."""
        seeds = {lang: xxhash.xxh3_64_intdigest(lang.encode()) for lang in {lang for lang, _ in self.words}}
        return np.fromiter((xxhash.xxh3_64_intdigest(w, seeds[lang]) for lang, w in self.words), np.uint64, len(self.words))

    def extend(self, group: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        """Blocks of the phrases one word longer: their phrase's number, the new word, block and mask, sorted."""
        over = np.flatnonzero(mask >> np.uint64(63))
        group = np.concatenate([group, group[over]])
        block = np.concatenate([block, block[over] + 1])
        mask = np.concatenate([mask << np.uint64(1), np.ones(len(over), np.uint64)])
        reach = self.begin[block + 1] - self.begin[block]
        hits = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for a, b in self._slices(reach):
            size = reach[a:b]
            end = np.cumsum(size)
            other = np.repeat(self.begin[block[a:b]] - end + size, size)
            other += np.arange(len(other))
            hit = np.repeat(mask[a:b], size)
            hit &= self.by_mask[other]
            found = np.flatnonzero(hit != 0)
            hits.append((a + np.searchsorted(end, found, "right"), self.by_word[other[found]], hit[found]))
        row, word, hit = (np.concatenate(x) for x in zip(*hits))
        parent = group[row]
        order = np.argsort(parent * np.int64(len(self.words)) + word)  # the order of a phrase's blocks is of no account
        return parent[order], word[order], block[row][order], hit[order]

    @staticmethod
    def _slices(reach: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of blocks that meet about ``STEP_PAIRS`` others."""
        total = np.cumsum(reach)
        cuts = np.unique(np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, STEP_PAIRS)))
        yield from zip(cuts.tolist(), [*cuts[1:].tolist(), len(reach)])

    def phrases(self, longest: int, keep=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word numbers, one row a phrase; occurrences) of phrases of 2 to ``longest`` words, depth first.
        ``keep(words)``: which phrases to yield and to extend."""
        single = np.arange(len(self.words))[:, None]
        for a, b in self._slices(self.begin[self.block + 1] - self.begin[self.block]):
            yield from self._deeper(single, self.word[a:b], self.block[a:b], self.mask[a:b], longest, keep)

    def _deeper(self, prefixes, group, block, mask, longest, keep):
        if not len(group):
            return
        parent, word, block, mask = self.extend(group, block, mask)
        if not len(parent):
            return
        new = np.concatenate([[True], (parent[1:] != parent[:-1]) | (word[1:] != word[:-1])])
        first = np.flatnonzero(new)
        made = np.concatenate([prefixes[parent[first]], word[first][:, None]], axis=1)
        counts = np.add.reduceat(np.bitwise_count(mask).astype(np.int64), first)
        chosen = np.ones(len(made), bool) if keep is None else keep(made)
        yield made[chosen], counts[chosen]
        if made.shape[1] < longest:
            number = np.cumsum(new) - 1
            on = chosen[number]
            yield from self._deeper(made, number[on], block[on], mask[on], longest, keep)


def shards(batches) -> Iterator[Shard]:
    """Shards of the batches' (lang, text) rows."""
    held: list[tuple[str, bytes]] = []
    by_lang: dict[str, _Words] = {}
    parts, n = [], 0
    for batch in (whole.slice(i, READ_ROWS) for whole in batches for i in range(0, whole.num_rows, READ_ROWS)):
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            for tokens in tokens_of(raw):
                table = by_lang.get(lang)
                if table is None:
                    table = by_lang[lang] = _Words(held, lang)
                table[_GAP] = -1
                parts.append(np.fromiter(map(table.__getitem__, tokens), np.int32, len(tokens)))
                parts.append(np.full(1, -1, np.int32))
                n += len(tokens) + 1
                if n >= SHARD_WORDS:
                    yield Shard(np.concatenate(parts), held)
                    held, by_lang, parts, n = [], {}, [], 0
    if n:
        yield Shard(np.concatenate(parts), held)


def _phrase_hashes(words: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    total = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(words.shape[1]):
            total = total * _BASE + hashed[words[:, i]]
    return shared.mix(total + np.uint64(words.shape[1]))


class Filter:
    """Two bits a hash, in little-endian bytes."""

    def __init__(self, bits: int, data: np.ndarray) -> None:
        self.bits, self.data = bits, data

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for part in (h, h >> np.uint64(32)):
            at = (part & np.uint64(self.bits - 1)).astype(np.int64)
            out &= (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def _keep(filters: dict[int, Filter], hashed: np.ndarray):
    def keep(words: np.ndarray) -> np.ndarray:
        n = words.shape[1]
        if n in filters:
            return filters[n].has(_phrase_hashes(words, hashed))
        if n - 1 in filters:  # the phrase without its last word was extended, so it's in
            return filters[n - 1].has(_phrase_hashes(words[:, 1:], hashed))
        return np.ones(len(words), bool)

    return keep


def _filter(docs: DataFrame, length: int, least: int, filters: dict[int, Filter], scratch: shared.Scratch) -> Filter:
    """Filter of the phrases of ``length`` words that occur ``least`` times or more."""

    def run(batches):
        for shard in shards(batches):
            hashed = shard.hashes()
            for words, counts in shard.phrases(length, _keep(filters, hashed)):
                if words.shape[1] == length:
                    h = _phrase_hashes(words, hashed).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(counts)], ["h", "n"])

    frequent = docs.mapInArrow(shared.tidy(run), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    frequent = scratch.keep(frequent.select("h"))
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(15, (16 * frequent.count()).bit_length()))
    # Spark's bitmaps count from 1
    spots = frequent.select(F.explode(F.array(*(part.bitwiseAND(F.lit(bits - 1)) + 1 for part in (F.col("h"), F.shiftrightunsigned("h", 32))))).alias("x"))
    pages = spots.groupBy(F.bitmap_bucket_number("x").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("page"))
    data = np.zeros(bits // 8, np.uint8)
    for b, page in pages.collect():  # bits / 8 bytes in all, FILTER_BITS / 8 at most
        data[(b - 1) * 4096 : b * 4096] = np.frombuffer(bytes(page), np.uint8)
    scratch.drop(frequent)
    return Filter(bits, data)


def phrase_counts(docs: DataFrame, longest: int, least: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, k, n): occurrences of all words (k = 1) and of all phrases of 2 to ``longest`` words
    that occur ``least`` times or more; a word's count is exact whatever it is."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scratch = shared.Scratch(docs.sparkSession)
    filters: dict[int, Filter] = {}
    for length in range(2, longest):
        filters[length] = _filter(rows, length, least, filters, scratch)

    def run(batches):
        for shard in shards(batches):
            seen = np.flatnonzero(shard.counts)
            yield _strings(shard, seen[:, None], shard.counts[seen])
            for made, counts in shard.phrases(longest, _keep(filters, shard.hashes())):
                yield _strings(shard, made, counts)

    counted = rows.mapInArrow(shared.tidy(run), "lang string, phrase string, k int, n bigint")
    return scratch.keep(counted.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).filter((F.col("k") == 1) | (F.col("n") >= least)))


def _strings(shard: Shard, made: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    langs, words = shard.columns()
    parts = [words.take(pa.array(made[:, k])) for k in range(made.shape[1])]
    phrase = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, " ")
    return pa.RecordBatch.from_arrays([langs.take(pa.array(made[:, 0])), phrase, pa.array(np.full(len(made), made.shape[1], np.int32)), pa.array(counts.astype(np.int64))], ["lang", "phrase", "k", "n"])


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases.

    A phrase of 2 to ``longest`` words that occurs a >= ``least`` times scores
    floor(1000000 a² / (l r)) at its worst cut (ties: the first) into parts that occur l and
    r times. It is dropped if half of its occurrences or more lie inside one longer phrase
    that qualifies. n counts the words of the language. Null texts are empty, null languages
    "und"; repeated rows count each; a language without phrases, and an empty table, give no
    rows. Products are decimals of 38 digits.
    """
    counts = phrase_counts(docs, longest, least, text_col, lang_col)
    phrases = counts.filter(F.col("k") > 1).select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = phrases.select("lang", "phrase", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    side = lambda name, as_: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(as_))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumns({"over": F.lit(1_000_000).cast("decimal(38,0)") * wide("a") * wide("a"), "under": wide("l") * wide("r")})
    scored = cuts.withColumn("score", F.expr("over div under")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))))
    within = phrases.filter(F.col("k") > 2).select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase"))
    within = within.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(within, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < 50 * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("m.score"), F.desc("a"), "phrase")
    best = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = counts.filter(F.col("k") == 1).groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "m.l", "m.r", "n", F.col("m.score").alias("score"))


#: The same for DuckDB, by plain counting.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_no, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT row_no, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND n >= 10),
u AS (SELECT c.*, cut, array_to_string(ws[1:cut], ' ') AS lp, array_to_string(ws[cut + 1:], ' ') AS rp FROM c, (SELECT unnest([1, 2]) AS cut) WHERE cut < k),
s AS (SELECT u.lang, u.phrase, u.a, u.cut, x.n AS l, y.n AS r, (1000000::HUGEINT * u.a * u.a) // (x.n::HUGEINT * y.n) AS score
    FROM u JOIN f x ON x.lang = u.lang AND x.phrase = u.lp JOIN f y ON y.lang = u.lang AND y.phrase = u.rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
q AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT q.lang, rank, q.phrase, a, l, r, n, score::BIGINT AS score FROM q JOIN (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000
"""
