r"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one engine per partition.

A text is split by the tokenizer's pattern. Words not yet known to the worker go to an in-memory DuckDB: one row per token of each word, in order,
at first a row per byte. Each step of the recursion pairs every row with its right neighbour, joins the pairs with the merge table, and contracts in each word the leftmost
pair of least rank; words without a pair drop out, and a word's last state is its encoding. Decoding joins the ids with the
vocabulary and aggregates their bytes in order of position.

A recursive query takes at most ``STEPS`` steps over its words and is called again for those not finished, and gets ``BYTES_AT_ONCE`` bytes of words, so the
intermediate states that it keeps are bounded.

A word of more than ``LONG`` bytes (a run of letters or spaces without an end) is cut into pieces, which are encoded like words, many at once, and joined two by two.
Tokens in a row are the encoding of their bytes exactly if each two neighbours are the encoding of theirs: merges within tokens don't depend on one another, so the first
merge across a boundary of tokens would also be made if only the two tokens beside it were there. So where two pieces meet, the last tokens of
the one and the first of the other are encoded anew, in a region that widens until its outer boundaries pass that test. A region is short as a rule; a
long one (of a periodic text) contracts in one step every occurrence of its least-ranked pair, if no
pair that the new token can form has a lower rank than the token: then one at a time gives the same ids. Else it contracts one.

Ids and bytes of at most about ``CACHED_WORDS`` words are kept by each worker. This changes no result.
Nothing is shuffled. Null texts count as empty: no ids, and the digest of no bytes. Each row is encoded by itself.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import WordCache, chunks

RANKS = "byte_bpe_50k.tiktoken"
STEPS = 24
LONG = 96
#: Bytes of a piece of a long word; a power of two, so that pieces of a run of one character fit together.
PIECE = 32
CACHED_WORDS = 500_000
WORDS_AT_ONCE = 60_000
BYTES_AT_ONCE = 400_000
CHARS_AT_ONCE = 4_000_000

_coders: dict[tuple[str, str], tuple] = {}


class WordCoder:
    """Encodes and decodes words in DuckDB."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import duckdb

        self.db = duckdb.connect(config={"threads": "1", "memory_limit": "400MB", "temp_directory": ""})
        # Bytes are held as characters of the same number, so that text functions can join them.
        self.vocab = {i: b for b, i in ranks.items()}
        vocab = pa.table({"id": pa.array(ranks.values(), pa.int32()), "bytes": [b.decode("latin-1") for b in ranks]})
        pairs = []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append((a, b, rank))
        a, b, rank = zip(*pairs, strict=True) if pairs else ((), (), ())
        # A token with which some pair of lower rank can be formed must be made one at a time.
        lowest: dict[int, int] = {}
        for x, y, r in pairs:
            for t in (x, y):
                lowest[t] = min(r, lowest.get(t, r))
        alone = [lowest.get(r, r) < r for r in rank]
        merges = pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "rank": pa.array(rank, pa.int32()), "alone": pa.array(alone, pa.bool_())})
        self.db.register("vocab_in", vocab)
        self.db.register("merges_in", merges)
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM vocab_in")
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.bytes_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def _one(self) -> str:
        """The recursive query: every step contracts in each word the leftmost pair of least rank. id orders all rows, word by word."""
        return f"""
        WITH RECURSIVE states AS (
          SELECT id, word, tok, 0 AS step FROM tokens
          UNION ALL
          SELECT id, word, CASE WHEN here THEN rank ELSE tok END, step + 1 FROM (
            WITH paired AS (SELECT id, word, tok, step, CASE WHEN lead(word) OVER (ORDER BY id) = word THEN lead(tok) OVER (ORDER BY id) END AS next
                            FROM states WHERE step < {STEPS}),
              joined AS (SELECT p.*, m.rank FROM paired p LEFT JOIN merges m ON p.tok = m.a AND p.next = m.b),
              least AS (SELECT word, min((rank::BIGINT << 32) + id) AS best FROM joined WHERE rank IS NOT NULL GROUP BY word),
              chosen AS (SELECT j.*, coalesce(id = best & 4294967295, false) AS here FROM joined j JOIN least USING (word))
            SELECT *, coalesce(lag(here) OVER (ORDER BY id), false) AS taken FROM chosen
          ) WHERE NOT taken
        )"""

    def _step(self) -> str:
        """One step for a long region: every occurrence of its least pair where that is safe. Of a run of
        neighbouring occurrences every other one is contracted, from its left end."""
        return """
        WITH joined AS (SELECT p.id, p.tok, m.rank, m.alone FROM (SELECT id, tok, lead(tok) OVER (ORDER BY id) AS next FROM region) p
                        LEFT JOIN merges m ON p.tok = m.a AND p.next = m.b),
          best AS (SELECT min(rank) AS rank, min(id) FILTER (WHERE rank = (SELECT min(rank) FROM joined)) AS id FROM joined),
          runs AS (SELECT j.*, coalesce(j.rank = b.rank, false) AS hit, j.id = b.id AS first, row_number() OVER (ORDER BY j.id) AS n FROM joined j, best b),
          islands AS (SELECT *, n - row_number() OVER (PARTITION BY hit ORDER BY id) AS island FROM runs),
          chosen AS (SELECT *, hit AND CASE WHEN alone THEN first ELSE row_number() OVER (PARTITION BY hit, island ORDER BY id) % 2 = 1 END AS here FROM islands)
        SELECT id, CASE WHEN here THEN rank ELSE tok END AS tok FROM (SELECT *, coalesce(lag(here) OVER (ORDER BY id), false) AS taken FROM chosen) WHERE NOT taken"""

    def _short(self, words: list[bytes]) -> list[array]:
        """Each word's tokens; one recursive query for all."""
        db = self.db
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        left = pa.table({"id": np.arange(len(text)), "tok": self.bytes_ids[text], "word": np.repeat(np.arange(len(words), dtype=np.int32), sizes)})
        out = [array("i")] * len(words)
        while left.num_rows:
            db.register("tokens", left)
            db.execute(f"CREATE OR REPLACE TEMP TABLE states AS {self._one()} SELECT * FROM states")
            # A word's last state; words at the last step that a query takes go on.
            last = "SELECT s.word, s.id, s.tok FROM states s JOIN (SELECT word, max(step) AS step FROM states GROUP BY word) USING (word, step)"
            done = db.sql(f"{last} WHERE step < {STEPS} ORDER BY s.id").to_arrow_table()
            left = db.sql(f"{last} WHERE step >= {STEPS} ORDER BY s.id").to_arrow_table()
            db.unregister("tokens")
            word, tok = done.column("word").to_numpy(), done.column("tok").to_numpy().astype(np.int32)
            ends = np.flatnonzero(np.r_[word[1:] != word[:-1], True]) + 1 if len(word) else []
            for lo, hi in zip(np.r_[0, ends[:-1]].tolist() if len(word) else [], list(ends), strict=True):
                out[word[lo]] = array("i", tok[lo:hi].tobytes())
        return out

    def _region(self, word: bytes) -> array:
        """The tokens of one long region, step by step; only the last state is kept."""
        db = self.db
        db.register("tokens", pa.table({"id": np.arange(len(word)), "tok": self.bytes_ids[np.frombuffer(word, np.uint8)]}))
        db.execute("CREATE OR REPLACE TEMP TABLE region AS SELECT * FROM tokens")
        db.unregister("tokens")
        n = len(word) + 1
        while n > (n := db.sql("SELECT count(*) FROM region").fetchone()[0]):
            db.execute(f"CREATE OR REPLACE TEMP TABLE region AS {self._step()}")
        found = db.sql("SELECT tok FROM region ORDER BY id").to_arrow_table().column("tok").to_numpy()
        return array("i", found.astype(np.int32).tobytes())

    def _direct(self, words: set[bytes]) -> dict[bytes, array]:
        """Tokens of short words, and of regions of long ones."""
        found = {w: self._region(w) for w in words if len(w) > 4 * LONG}
        some, size = [], 0
        for w in [*(w for w in words if len(w) <= 4 * LONG), None]:
            if some and (w is None or size + len(w) > BYTES_AT_ONCE):
                found.update(zip(some, self._short(some), strict=True))
                some, size = [], 0
            if w is not None:
                some.append(w)
                size += len(w)
        return found

    def _fit(self, pairs: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """Those pairs of tokens that are the encoding of their bytes."""
        found = self._direct({self.vocab[a] + self.vocab[b] for a, b in pairs})
        return {(a, b) for a, b in pairs if found[self.vocab[a] + self.vocab[b]].tolist() == [a, b]}

    def _joined(self, pairs: list[tuple[array, array]]) -> list[array]:
        """The encoding of each two encodings put together."""
        out: list[array | None] = [None] * len(pairs)
        fit = self._fit({(a[-1], b[0]) for a, b in pairs})
        left = []
        for i, (a, b) in enumerate(pairs):
            if (a[-1], b[0]) in fit:
                out[i] = a + b
            else:
                left.append(i)
        k = 2
        while left:
            regions = {i: b"".join(map(self.vocab.__getitem__, pairs[i][0][-k:] + pairs[i][1][:k])) for i in left}
            found = self._direct(set(regions.values()))
            outer = {}
            for i in left:
                (a, b), r = pairs[i], found[regions[i]]
                outer[i] = [(x[0], r[0]) for x in [a[-k - 1 : -k]] if len(a) > k] + [(r[-1], x[0]) for x in [b[k : k + 1]] if x]
            fit = self._fit({p for ps in outer.values() for p in ps})
            for i in left:
                if all(p in fit for p in outer[i]):
                    a, b = pairs[i]
                    out[i] = a[:-k] + found[regions[i]] + b[k:]
            left = [i for i in left if out[i] is None]
            k *= 2
        return out

    def _long(self, word: bytes) -> array:
        """The tokens of a long word: pieces joined two by two; equal ones once."""
        pieces = [word[at : at + PIECE] for at in range(0, len(word), PIECE)]
        known = self._direct(set(pieces))
        row = [known[p] for p in pieces]
        while len(row) > 1:
            pairs = [(a.tobytes(), b.tobytes()) for a, b in zip(row[::2], row[1::2], strict=False)]
            once = list(dict.fromkeys(pairs))
            made = dict(zip(once, self._joined([(array("i", a), array("i", b)) for a, b in once]), strict=True))
            row = [made[p] for p in pairs] + row[len(pairs) * 2 :]
        return row[0]

    def code(self, words: list[str]) -> list[tuple[str, str]]:
        """For each word: its ids joined by spaces, and the text that they decode to."""
        raw = [w.encode() for w in words]
        found = self._direct({b for b in raw if len(b) <= LONG})
        out = []
        for at in range(0, len(raw), WORDS_AT_ONCE):
            some = [found[b] if len(b) <= LONG else self._long(b) for b in raw[at : at + WORDS_AT_ONCE]]
            sizes = np.fromiter(map(len, some), np.int64, len(some))
            toks = np.frombuffer(b"".join(t.tobytes() for t in some), np.int32)
            self.db.register("found", pa.table({"id": np.arange(len(toks)), "word": np.repeat(np.arange(len(some), dtype=np.int32), sizes), "tok": toks}))
            table = self.db.sql("""
                SELECT string_agg(f.tok::VARCHAR, ' ' ORDER BY f.id), string_agg(v.bytes, '' ORDER BY f.id)
                FROM found f JOIN vocab v ON f.tok = v.id GROUP BY f.word ORDER BY f.word""").to_arrow_table()
            self.db.unregister("found")
            texts = [b if b.isascii() else b.encode("latin-1").decode("utf-8", "surrogateescape") for b in table.column(1).to_pylist()]
            out += zip(table.column(0).to_pylist(), texts, strict=True)
        return out


def coder(path: str) -> WordCoder:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return WordCoder(ranks)


def coded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n_tokens, ids_sha256, decoded_sha256). Texts become Python objects a few at a time."""
    import regex

    if (path, pattern) not in _coders:
        _coders[path, pattern] = coder(path), regex.compile(pattern), WordCache(CACHED_WORDS), {}
    engine, split, cache, odd = _coders[path, pattern]
    for batch in batches:
        rows = []
        for texts in chunks(batch.column("text"), CHARS_AT_ONCE):
            found = [split.findall(t) for t in texts]
            missing = cache.missing(set().union(*found))
            known = cache.known
            for w, (ids, text) in zip(missing, engine.code(missing), strict=True):
                known[w] = ids
                if text != w:
                    odd[w] = text
            for row in found:
                joined = " ".join(map(known.__getitem__, row)).encode()
                # A word's ids were decoded when it was encoded: to the word itself, or to what odd has of it.
                text = "".join(row if not odd or all(w not in odd for w in row) else (odd.get(w, w) for w in row))
                rows.append((joined.count(b" ") + 1 if row else 0, hashlib.sha256(joined).hexdigest(), hashlib.sha256(text.encode("utf-8", "surrogateescape")).hexdigest()))
        counts, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def report(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lambda b: coded(b, path, pattern), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
