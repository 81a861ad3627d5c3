"""Scratch tables, and native column helpers that several operators use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeworks.sources.folders import Steps as Scratch  # noqa: F401

#: Ranks documents without an id after all others.
NO_ID = 2**63 - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.transform(F.array(value), body)[0]


def prefix_sums(lengths: Column) -> Column:
    """For array<long> lengths: the sum of all entries before each, in blocks of about sqrt(n) entries."""

    def by_blocks(a: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(a).cast("double"))).cast("int")
        return let(
            F.transform(F.sequence(F.lit(0), ((F.size(a) - 1) / size).cast("int")), lambda k: F.slice(a, k * size + 1, size)),
            lambda blocks: let(
                F.transform(blocks, total),
                lambda sums: F.flatten(
                    F.transform(
                        blocks,
                        lambda block, k: let(
                            total(F.slice(sums, F.lit(1), k)),
                            lambda before: F.transform(block, lambda _, i: before + total(F.slice(block, F.lit(1), i))),
                        ),
                    )
                ),
            ),
        )

    return F.when(F.size(lengths) > 0, let(lengths, by_blocks)).otherwise(F.array().cast("array<bigint>"))


def total(a: Column) -> Column:
    """Sum of an array<long>."""
    return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)


def text_or_empty(c: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def identity() -> list[Column]:
    """Columns _id and _h that name a document: rows equal in doc_id and text are the same document, and null ids rank last."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(text_or_empty("text")).alias("_h"),
    ]


def chunks(texts: pa.Array, chars: int = 2_000_000) -> Iterator[list[str]]:
    """The strings of an Arrow column a few at a time: at most so many bytes, or one string."""
    sizes = pc.binary_length(texts).to_pylist()
    at = 0
    while at < len(sizes):
        upto, n = at, 0
        while upto < len(sizes) and (upto == at or n + sizes[upto] <= chars):
            n += sizes[upto]
            upto += 1
        yield texts.slice(at, upto - at).to_pylist()
        at = upto


class WordCache:
    """What is known of words, for one worker. When it is full, words seen again since it last was stay, and those at hand; a lookup costs time only."""

    def __init__(self, most: int) -> None:
        self.most, self.known, self._again = most, {}, set()

    def missing(self, words: set[str]) -> list[str]:
        """Words to be added to known before they are looked up there; call it for a bounded number of texts at a time."""
        found = [w for w in words if w not in self.known]
        self._again.update(words.difference(found))
        if len(self.known) + len(found) > self.most:
            keep = words | self._again if len(self._again) <= self.most // 2 else words
            self.known = {w: self.known[w] for w in keep if w in self.known}
            self._again = set()
        return found
