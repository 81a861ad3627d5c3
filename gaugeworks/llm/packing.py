"""Best-fit packing by the sum-of-squares rule.

Texts are tokenised and cut into pieces of at most ``size`` tokens; pieces are packed into sequences. A piece goes into
the open sequence that makes the sum over residual gaps of squared counts of open sequences with that gap smallest; only one
that fits in none opens a sequence.
Pieces come in order of falling length, so that short ones fill the gaps that long ones leave.

Pieces are dealt by a hash to parts of about ``part`` pieces, each packed by itself with only (key, length) rows and a
table of counts per gap in memory. Sequences that stay short of full are opened again: their pieces are gathered into fewer parts
and packed anew, round by round, until one part is left. A part hands on at most the pieces of its unfilled sequences, so the
last round's input stays bounded by a few thousand sequences. Texts and tokens are never shuffled.

Defined cases: a null text counts as empty; an empty text is one piece of the end token. Null ids and repeated rows are pieces
of their own. An empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import Scratch, chunks
from gaugeworks.llm.words import place_in, polynomial

SIZE = 2048
PART = 50_000
TOKENIZER = "word_bpe_49k.json"
CHARS_AT_ONCE = 1_000_000
CACHED_WORDS = 2_000_000
#: Symbols of which the first that is a single id parts words.
MARKS = "\u00ac\u00a6\u00a7\u00b6\u00a4|"
#: White space to the tokenizer, of ASCII and beyond.
_SPACES = np.array([*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
WHITE, LETTER, DIGIT, SYMBOL, OTHER = range(5)
_KINDS = np.array([WHITE if c in _SPACES[:6] else LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else SYMBOL for c in range(128)], np.int8)

_tokenizers: dict[str, Words] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def parts_of(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the parts of a text that are tokenised each by itself, and two 64-bit hashes of each, one after another in pairs.

    The tokenizer's normaliser and pattern never reach across white space. In a word of ASCII they split letters, single digits and symbols and lower the letters, so there runs of
    one kind are parts, and case makes no difference. Other words are parts as they stand: they may be composed, and an apostrophe or the < of a special token binds.
    """
    kinds = np.full(len(chars), OTHER, np.int8)
    plain = chars < 128
    kinds[plain] = _KINDS[chars[plain]]
    if not plain.all():
        far = np.flatnonzero(~plain)
        kinds[far[np.isin(chars[far], _SPACES)]] = WHITE
    at = np.flatnonzero(kinds != WHITE)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 2), np.uint64)
    codes, kinds = chars[at].astype(np.uint64), kinds[at]
    begins = np.r_[True, at[1:] != at[:-1] + 1]
    word = np.cumsum(begins) - 1
    bound = (kinds == OTHER) | (codes == 39) | (codes == 60)
    free = ~np.logical_or.reduceat(bound, np.flatnonzero(begins))[word]
    codes[free & (codes >= 65) & (codes <= 90)] += np.uint64(32)
    begins[1:] |= free[1:] & ((kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT))
    first = np.flatnonzero(begins)
    sizes = np.diff(np.r_[first, len(at)])
    return at[first], sizes, np.stack([polynomial(codes, sizes), polynomial(codes ^ np.uint64(0x5A5A5A), sizes)], axis=1)


class Words:
    """Looks parts' ids up, once per worker.

    Known parts stand in arrays in order of their first hash; the second must agree too. New ones gather in a small table that is merged into the large one by and by.
    Unknown parts are encoded many at a time, between words of one symbol that is one id and found in none of them.
    """

    def __init__(self, path: str, most: int = CACHED_WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        if any(c.isspace() for t in self.tokenizer.get_added_tokens_decoder().values() for c in t.content):
            raise ValueError("special tokens with white space can't be told by words")
        single = ((c, i) for c in MARKS if len(i := self.encoded([c])[0]) == 1)
        self.mark, (self.mark_id,) = next(single)
        self.clear()

    def clear(self) -> None:
        none = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        #: Hash, second hash, place in ids, and number of ids of each part.
        self.large, self.small = none, none
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All parts' ids, one after another, and how many each has."""
        out, sizes = [], []
        for at in range(0, len(parts), 5000):
            some = parts[at : at + 5000]
            if any(self.mark in p for p in some):
                each = self.encoded(some)
                out.append(np.array([i for ids in each for i in ids], np.uint32))
                sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
            else:
                found = np.array(self.encoded([f" {self.mark} ".join(some)])[0], np.uint32)
                marks = found == self.mark_id
                out.append(found[~marks])
                sizes.append(np.diff(np.r_[-1, np.flatnonzero(marks), len(found)]) - 1)
        return np.concatenate(out), np.concatenate(sizes)

    @staticmethod
    def find(table: tuple[np.ndarray, ...], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each hash is there, and its place and number of ids."""
        keys, second, place, size = table
        if not len(keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        i = np.minimum(np.searchsorted(keys, hashes[:, 0]), len(keys) - 1)
        return (keys[i] == hashes[:, 0]) & (second[i] == hashes[:, 1]), place[i], size[i]

    def look_up(self, text: str, start: np.ndarray, length: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in flat and number of ids of each part of a text."""
        if len(self.large[0]) + len(self.small[0]) > self.most:
            self.clear()
        _, first, own = np.unique(hashes[:, 0], return_index=True, return_inverse=True)
        if (hashes[first[own], 1] != hashes[:, 1]).any():
            _, first, own = np.unique(np.ascontiguousarray(hashes).view("u8,u8").ravel(), return_index=True, return_inverse=True)
        wanted = hashes[first]
        known, place, size = self.find(self.large, wanted)
        also, p, n = self.find(self.small, wanted)
        place[also], size[also] = p[also], n[also]
        new = np.flatnonzero(~known & ~also)
        if len(new):
            found, size[new] = self.ids([text[a : a + n] for a, n in zip(start[first[new]].tolist(), length[first[new]].tolist(), strict=True)])
            place[new] = self.used + np.cumsum(size[new]) - size[new]
            total = self.used + int(size[new].sum())
            if total > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.empty(2 * total - self.used, np.uint32)])
            self.flat[self.used : total] = found
            self.used = total
            self.small = self.merged(self.small, (wanted[new, 0], wanted[new, 1], place[new], size[new]))
            if len(self.small[0]) > 20_000 + len(self.large[0]) // 8:
                self.large, self.small = self.merged(self.large, self.small), tuple(x[:0] for x in self.small)
        return place[own], size[own]

    @staticmethod
    def merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True))

    def texts(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each with the end's id after it, and how many each text has."""
        whole = "\n".join(texts)
        start, length, hashes = parts_of(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4"))
        place, size = self.look_up(whole, start, length, hashes)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        upto = np.searchsorted(start, np.cumsum(sizes + 1) - 1)  # each text's parts end before these
        # A text's end is a part of one id, which is put in last.
        place, size = np.insert(place, upto, -1), np.insert(size, upto, 1)
        ids = self.flat[np.maximum(0, np.repeat(place, size) + place_in(size))]
        ends = np.cumsum(size)[upto + np.arange(len(texts))]
        ids[ends - 1] = end_id
        return ids, np.diff(np.r_[0, ends])


def pieces_of(batches: Iterator[pa.RecordBatch], path: str, size: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, _row, text) to one row per piece. Texts become Python objects a few at a time."""
    if path not in _tokenizers:
        _tokenizers[path] = Words(path)
    for batch in batches:
        counts, length, crc = [], array("q"), array("q")
        for texts in chunks(batch.column("text"), CHARS_AT_ONCE):
            ids, many = _tokenizers[path].texts(texts, end_id)
            raw, at = memoryview(ids.astype("<u4").tobytes()), 0
            counts.append(-(-many // size))
            for n in many.tolist():
                for lo in range(at, at + n, size):
                    hi = min(lo + size, at + n)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(raw[4 * lo : 4 * hi]))
                at += n
        n = np.concatenate(counts) if counts else np.empty(0, np.int64)
        piece = place_in(n)
        rows = pa.array(np.repeat(np.arange(len(n)), n))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(rows), batch.column("_row").take(rows), pa.array(piece, pa.int32()), pa.array(piece * size), pa.array(np.array(length)), pa.array(np.array(crc))],
            ["doc_id", "_row", "piece", "start", "length", "ids_crc32"],
        )


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lengths in falling order: each one's bin, its offset there, and the bins' fill.

    counts[g] is the number of open bins with gap g. Filling gap g with s changes the sum of squares by 2 * (counts[g - s] - counts[g]) + 2,
    or by 1 - 2 * counts[g] where the bin becomes full. Ties go to the smallest gap. A bin is opened only for what fits in none.
    """
    counts = np.zeros(size + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, s in enumerate(lengths.tolist()):
        gap = size
        if s < size:
            there = counts[s:size]
            change = 2 * (counts[: size - s] - there) + 2
            change[0] = 1 - 2 * there[0]
            change[there == 0] = 1 << 60
            at = int(change.argmin())
            if there[at]:
                gap = at + s
        if gap == size:
            bins[i], offsets[i] = len(fill), 0
            fill.append(s)
            b = len(fill) - 1
        else:
            b = open_bins[gap].pop()
            counts[gap] -= 1
            bins[i], offsets[i] = b, fill[b]
            fill[b] += s
        if size - fill[b]:
            open_bins[size - fill[b]].append(b)
            counts[size - fill[b]] += 1
    return bins, offsets, np.array(fill, dtype=np.int64)


def packed(group: pd.DataFrame, size: int, part_bits: int) -> pd.DataFrame:
    """One part's pieces with sequence_id, offset and full; numbers of different rounds and parts differ."""
    group = group.sort_values(["length", "key"], ascending=[False, True], kind="stable")
    bins, offsets, fill = sum_of_squares(group["length"].to_numpy(), size)
    return pd.DataFrame({
        "key": group["key"].to_numpy(), "length": group["length"].to_numpy(), "part": group["part"].to_numpy(),
        "sequence_id": (group["part"].to_numpy() << part_bits) + bins, "offset": offsets, "full": fill[bins] == size,
    })


def assign(spark: SparkSession, scratch: Scratch, pieces: DataFrame, size: int, part: int) -> DataFrame:
    """pieces(key, length) to (key, sequence_id, offset). key is unique."""
    schema = "key string, length bigint, part bigint, sequence_id bigint, offset bigint, full boolean"
    left = pieces.select("key", "length")
    done, base, level = [], 0, 0
    n = left.count()
    while True:
        parts = max(1, -(-n // part))
        dealt = left.withColumn("part", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(parts)) + F.lit(base))
        out = scratch.save(dealt.groupBy("part").applyInPandas(lambda g: packed(g, size, 32), schema), f"round{level}")
        base += parts
        if parts == 1:
            done.append(out)
            break
        done.append(out.where("full"))
        left = out.where("not full").select("key", "length")
        n, before = left.count(), n
        # What doesn't shrink any more is packed as it was dealt.
        if n == 0 or n > before * 0.9:
            done[-1] = out
            break
        level += 1
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return found.select("key", "sequence_id", "offset")


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = 0, part: int = PART) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(spark, "packing")
    # A row's number, the same in every run over the same files, is part of its piece's key: rows may be equal.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row"), F.coalesce("text", F.lit("")).alias("text"))
    path = path or tokenizer_path()
    schema = "doc_id bigint, _row bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    pieces = scratch.save(rows.mapInArrow(lambda b: pieces_of(b, path, size, end_id), schema).withColumn("key", F.concat_ws("/", "_row", "piece")), "pieces")
    placed = assign(spark, scratch, pieces, size, part)
    return pieces.join(placed, "key").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
