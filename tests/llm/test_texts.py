"""Operators on single texts and on lines, against brute force in Python."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from gaugeworks.llm import bpe, line_dedup, packing, quality, secret_scan, sharding, substring_dedup

random.seed(1)
ODD = [None, "", " \n\t ", "x" * 30_000, "é\U0001f642 token: " + "a1" * 20, "A" * 5 + "\n\n" + "b\n" * 400]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# Secret scans


def base_spans(t):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        found += [(m.start(), 0, m.end())] * (len(m[2]) >= 8)
    for kind, shape, least in ((1, "AKIA[A-Z0-9]+", 16), (2, "[0-9a-f]+", 32)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(shape, t) if len(m[0]) >= least]
    return sorted(found)


def test_base_spans(docs):
    bits = ["token", "TOKEN", "api_key", "secret", "=", ": ", '"', "AKIA", "ABCDEFGH1234", "deadbeef", "0" * 31, "f", " ", "word", "é", "\U0001f600", "-._"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 25))) for _ in range(300)] + ODD
    rows = {r["doc_id"]: r for r in secret_scan.report(docs(texts)).collect()}
    for i, t in enumerate(texts):
        spans = base_spans(t or "")
        assert [rows[i][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(k == x for _, k, _ in spans) for x in range(3)]
        assert rows[i]["base_sha256"] == sha(",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)), t


def test_random_tokens_are_found_and_words_are_not(docs):
    # A corpus of long words in which some tokens are random.
    words = ["".join(random.choices(["the", "ing", "tion", "an", "er", "re", "on", "at"], k=14)) for _ in range(120)]
    symbols = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(random.choices(symbols, k=64)) for _ in range(60)]
    rows = secret_scan.report(docs([f"see {w} here" for w in words] + [f"see {k} here" for k in keys])).collect()
    hit = {r["doc_id"] for r in rows if "random:4:" in r["spans"]}
    assert not hit & set(range(120))
    assert len(hit) >= 50


def phi(z):
    return 0.5 * math.erfc(-z / math.sqrt(2))


def battery(token):
    """(n, chance of so even a token if it is written text, chance of so odd a one if it is random)."""
    t = token.translate(str.maketrans("-_", "+/"))
    for k, shape, symbols in (
        (16, "[0-9a-f]+|[0-9A-F]+", "0123456789abcdef"), (26, "[A-Z]+|[a-z]+", "abcdefghijklmnopqrstuvwxyz"), (32, "[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), (64, ".*", secret_scan.ALPHABET),
    ):
        if re.fullmatch(shape, t):
            break
    t = t.lower() if k in (16, 26) else t
    n, at = len(t), [symbols.index(c) for c in t]
    chi = sum((t.count(c) - n / k) ** 2 / (n / k) for c in symbols)
    middle = (k - 1) / 2
    changes = sum((x > middle) != (y > middle) for x, y in itertools.pairwise(at))
    product = sum((x - middle) * (y - middle) for x, y in itertools.pairwise(at))
    cube = lambda x, df: ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    z = [max(cube(chi, k - 1), 0), (changes - (n - 1) / 2) / math.sqrt((n - 1) / 4), product / (math.sqrt(n - 1) * (k * k - 1) / 12)]
    match, triple = {16: (0.105, 0.014), 64: (0.055, 0.0045)}.get(k, (0.0655, 0.0062))
    mean = k * (n - 1) * match + k - n
    var = 4 * n * (n - 1) * (n - 2) * (triple - match**2) + 2 * n * (n - 1) * (match - match**2)
    return n, phi((chi - mean) / (k / n * math.sqrt(var))), 1 - phi(cube(sum(x * x for x in z), 3))


def test_battery_and_control_against_a_plain_version(docs):
    symbols = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    token = lambda: "".join(random.choices(random.choice([symbols, "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz"]), k=random.randint(18, 90)))
    word = lambda: "".join(random.choices(["the", "ing", "tion", "an", "er", "RE", "on", "at", "_", "2"], k=random.randint(8, 30)))
    texts = [" ".join(random.choice([token, word, word, word])() for _ in range(random.randint(0, 4))) for _ in range(250)] + ODD + ["1" * 40, "é" + token()]
    tokens = [(i, m.start(), m.end(), *battery(m[0])) for i, t in enumerate(texts) for m in re.finditer("[A-Za-z0-9+/_-]{20,}", t or "") if not m[0].isdigit()]
    classes = {}
    for _, _, _, n, written, uniform in tokens:
        b = min(300, math.floor(-10 * math.log10(max(written, 1e-300)))) if uniform >= 0.001 else 0
        classes.setdefault(int(math.log2(n)), []).append(b)
    least = {c: min((b for b in set(bs) if b > 0 and 10 ** (-b / 10) * len(bs) <= 0.05 * sum(x >= b for x in bs)), default=None) for c, bs in classes.items()}
    expected = {i: [] for i in range(len(texts))}
    for i, a, z, n, written, uniform in tokens:
        bound = least[int(math.log2(n))]
        if bound and uniform >= 0.001 and math.floor(-10 * math.log10(max(written, 1e-300))) >= bound:
            expected[i].append(f"random:{a}:{z}")
    found = {r["doc_id"]: [x for x in r["spans"].split(",") if x.startswith("random")] for r in secret_scan.report(docs(texts)).collect()}
    assert found == expected
    assert sum(map(len, expected.values())) > 40


def test_redaction(docs):
    text = 'a token = "0123456789abcdef0123456789abcdef01" b'
    r = secret_scan.redact(secret_scan.scan(docs([text, "plain", None]))).orderBy("doc_id").collect()
    assert [x["text"] for x in r] == ['a [SECRET]" b', "plain", None]
    assert r[0]["_id"] == 1


def test_no_rows(docs, spark):
    none = docs([]).where("false")
    assert secret_scan.report(none).count() == 0
    assert line_dedup.report(spark, none).count() == 0
    assert substring_dedup.report(spark, none).count() == 0
    assert bpe.report(none).count() == 0
    assert packing.pack(spark, none).count() == 0
    assert sharding.report(spark, none).count() == 0


# Lines


def normal(line):
    return re.sub(r"[ \t\r\f\v]+", " ", line).strip(" ").lower()


def without_runs(rows, window):
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: r[0]):
        lines = (t or "").split("\n")
        at = [k for k, x in enumerate(lines) if normal(x)]
        gone = set()
        for n in range(1, window + 1):
            for s in range(len(at) - n + 1):
                key = tuple(normal(lines[k]) for k in at[s : s + n])
                if n < window and sum(len(x.split(" ")) for x in key) <= line_dedup.WORDS:
                    continue
                if key in seen:
                    gone.update(at[s : s + n])
                seen.add(key)
        out[i] = (len(lines), len(gone), sha("\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def test_line_dedup(docs, spark):
    pool = ["Alpha one", "beta  two", "Gamma", "delta", "eps", "", "zeta 6", "eta"]
    rows = [(i, "\n".join(random.choices(pool, k=random.randint(0, 14)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [rows[5], (200, rows[7][1])]
    found = line_dedup.report(spark, docs(rows)).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == without_runs(rows, line_dedup.WINDOW)


def test_line_dedup_keeps_other_columns_and_null(docs, spark):
    rows = line_dedup.dedup(spark, docs([None, "a\nb\nc\nd", "x\na\nb\nc\nd"])).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == [None, "a\nb\nc\nd", "x"]
    assert {(r["_id"], r["_h"], r["score"]) for r in rows} == {(1, "x", None)}


def stretches(rows, reach, least):
    """Removed stretches by doc_id, by brute force over the texts of units."""
    first, out = {}, []
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0], r[1] or "")):
        at, place = 0, 0
        spans = []
        for line in (t or "").split("\n"):
            ws = [(m[0].translate({c: c + 32 for c in range(65, 91)}), at + m.start(), at + m.end()) for m in re.finditer(r"[^ \t-\r]+", line)]
            m = [(ord(w[0]) * substring_dedup.FIRST + ord(w[-1]) * substring_dedup.LAST + len(w) * substring_dedup.SIZE) % 2**32 for w, _, _ in ws]
            pair = [x * substring_dedup.PAIR % 2**32 ^ y for x, y in itertools.pairwise(m)]
            cuts = {min(range(s, s + reach), key=lambda k: pair[k]) + 1 for s in range(len(pair) - reach + 1)} | {0, len(ws)}
            for lo, hi in itertools.pairwise(sorted(cuts)):
                spans.append((place + lo, ws[lo:hi]))
            place += len(ws)
            at += len(line) + 1
        run = []  # (first word, last word, first character, last character, kept id, kept character) of repeated twos of units
        for (k, x), (_, y) in itertools.pairwise(spans):
            key = tuple(w for w, _, _ in x), tuple(w for w, _, _ in y)
            keep = first.setdefault(key, (i, x[0][1], k))
            if (keep[0], keep[2]) != (i, k):
                new = (k, k + len(x) + len(y), x[0][1], y[-1][2], *keep[:2])
                if run and run[-1][1] >= k:
                    run[-1] = (run[-1][0], new[1], run[-1][2], new[3], *run[-1][4:])
                else:
                    run.append(new)
        out += [(i, c, d, z - a, *keep) for a, z, c, d, *keep in run if z - a >= least]
    return out


def test_substring_dedup(docs, spark):
    word = lambda: random.choice("abcdefgh") + random.choice("xyz")
    text = lambda n: "".join(word() + random.choices([" ", "  ", "\n", "\n\n", "\t"], [20, 1, 1, 1, 1])[0] for _ in range(n))
    long = [text(n) for n in (25, 60, 60, 90)]
    rows = [(i, text(random.randint(0, 40)) + random.choice([*long, "", "short one"]).upper() + text(random.randint(0, 40))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(None, long[1]), (None, long[1]), rows[3], (7, long[2])]
    expected = stretches(rows, substring_dedup.REACH, substring_dedup.LEAST)
    found = [tuple(r) for r in substring_dedup.report(spark, docs(rows)).collect()]
    assert len(found) == len(expected) > 20
    # Of two texts with one id either may rank first.
    assert {r for r in found if r[0] != 7 and r[4] != 7} == {r for r in expected if r[0] != 7 and r[4] != 7}


def test_passages_of_over_50_words_go_wherever_they_begin(docs, spark):
    vocabulary = [f"w{i}" for i in range(3000)]
    some = lambda n: " ".join(random.choices(vocabulary, k=n))
    passages = [some(51) for _ in range(30)]
    texts = [some(random.randint(1, 30)) + " " + p + " " + some(9) for p in passages]
    texts += [some(random.randint(0, 30)) + " " + p.replace(" ", "\n", 2) + ("\n" if k % 2 else " ") + some(9) for k, p in enumerate(passages)]
    rows = substring_dedup.dedup(spark, docs(texts)).orderBy("doc_id").collect()
    assert [r["text"] for r in rows[:30]] == texts[:30]
    for r, t in zip(rows[30:], texts[30:], strict=True):
        assert len(t.split()) - len(r["text"].split()) >= 51 - 2 * substring_dedup.REACH - 2  # two of its words stand on lines of their own
    assert all(r["_id"] == 1 for r in rows)


def test_lists_of_common_lines_are_no_copies(docs, spark):
    pool = [f"item {c}" for c in range(60)]
    lists = ["\n".join(random.sample(pool, 16)) for _ in range(12)]
    rows = substring_dedup.report(spark, docs([*lists, lists[0]])).collect()
    assert [(r["doc_id"], r["n_words"]) for r in rows] == [(12, 32)]


def test_substring_dedup_clean_text(docs, spark):
    p = " ".join(f"word{i}" for i in range(30))
    rows = substring_dedup.dedup(spark, docs([p + "\nend", "begin é\U0001f642\n" + p, None, p + "\n" + p])).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == [p + "\nend", "begin é\U0001f642\n", None, ""]
    assert [tuple(x) for x in rows[1]["removed"]] == [(9, 9 + len(p))]
    assert [tuple(x) for x in rows[3]["removed"]] == [(0, 2 * len(p) + 1)]


def test_one_or_two_long_lines_are_deleted(spark):
    one, half, other = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 51), ("b", 30), ("c", 30)))
    short = " ".join(f"d{i}" for i in range(50))
    texts = [f"{one}\n\n{half}\n{other}\n{short}", f"x\n{one.upper()}", f"{half}\n\n{other}", f"{half}\nx", short, one]
    rows = line_dedup.dedup(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == [texts[0], "x", "", f"{half}\nx", short, ""]
    assert [r["_gone"] for r in rows] == [[], [1], [0, 2], [], [], [0]]


# Shards


def test_shards_round_trip_and_versions(docs, spark):
    from gaugeworks.llm.common import Scratch

    rows = docs([(i, f"text {i} " * 50) for i in range(400)] + [(None, None), (7, "again"), (7, "again")])
    store = sharding.ShardStore(spark, Scratch(spark, "test").root, rows.schema, target_bytes=60_000, fanout=3)
    for k in range(4):
        store.append(rows.where(f"pmod(coalesce(doc_id, 0), 4) = {k}").repartition(3))
    before = store.read().count()
    small = store.manifest().count()
    version = store.compact()
    assert (before, store.read().count()) == (403, 403)
    assert store.versions() == [1, 2, 3, 4, 5] and version == 5
    assert store.manifest().count() < small
    assert store.read(2).count() < 403
    with pytest.raises(Exception, match="exist"):
        store.commit(4, store.manifest())
    # A writer that has not committed yet keeps its files, and one that lost a race commits upon the other's version.
    late = rows.where("doc_id = 3")
    late.write.parquet(f"{store.root}/data/late")
    store.vacuum()
    assert store.spark.read.parquet(f"{store.root}/data/late").count() == 1
    store.vacuum(grace=-60)
    assert not store._fs.exists(store._path(f"{store.root}/data/late"))
    assert store.versions() == [5] and store.read().count() == 403
    assert sorted(map(str, store.read().collect())) == sorted(map(str, rows.collect()))


def test_appends_at_the_same_time_all_stay(docs, spark):
    from concurrent.futures import ThreadPoolExecutor

    from gaugeworks.llm.common import Scratch

    rows = docs([(i, f"text {i}") for i in range(40)])
    store = sharding.ShardStore(spark, Scratch(spark, "race").root, rows.schema)
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda k: store.append(rows.where(f"doc_id % 4 = {k}")), range(4)))
    assert sorted(done) == store.versions() == [1, 2, 3, 4]
    assert sorted(r["doc_id"] for r in store.read().collect()) == list(range(40))


# Tokens


def test_bpe_equals_the_library(docs):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bits = ["the", " a", "é", "\n\n", "  ", "\t", "'s", "12", "漢字", "\U0001f642", "-", "<|endoftext|>", "İ", "\x1c", "\x00"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 30))) for _ in range(200)]
    letters = "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=200_000))
    texts += [*ODD, " " * 500, "".join(random.choices("etaoin", k=900)), "ab" * 300, letters, "abc" * 20_000 + "a", "-=" * 9001, "x" * 100_001, "é" * 5000]
    rows = {r["doc_id"]: r for r in bpe.report(docs(texts)).collect()}
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert tuple(rows[i])[1:] == (len(ids), sha(" ".join(map(str, ids))), sha(t or "")), t


def test_bpe_of_an_endless_word():
    import public_tokenizers

    engine = bpe.coder(public_tokenizers.path(bpe.RANKS))
    (ids, text), (piece, _) = engine.code(["x" * 3_000_000, "x" * 64])
    assert text == "x" * 3_000_000
    assert ids.split()[:-8] == (piece.split() * (len(ids.split()) // len(piece.split())))[: len(ids.split()) - 8]


def pieces(text, size):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
    return [(k, at, len(ids[at : at + size]), zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), size))]


def test_packing(docs, spark):
    words = ["alpha", "Beta,", "x.y", "12", "«q»", "don't", "naïve...", "漢字", "|", "a|b", "\x1c", "Ünder_score", "İ", "<|endoftext|>", "<|EndOfText|>", "x<|startoftext|>y."]
    texts = [" ".join(random.choices(words, k=random.randint(0, 120))) for _ in range(150)] + ODD
    rows = packing.pack(spark, docs(texts), size=64, part=60).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert {i: sorted(p) for i, p in by.items()} == {i: pieces(t, 64) for i, t in enumerate(texts)}
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for each in places.values():
        at = 0
        for offset, length in sorted(each):
            assert offset == at
            at += length
        assert at <= 64
    bound = -(-sum(r["length"] for r in rows) // 64)
    assert len(places) <= 1.03 * bound + 1


def test_sum_of_squares_fills_bins():
    bins, offsets, fill = packing.sum_of_squares(np.array([6, 6, 4, 4, 3, 3, 2, 2]), 10)
    assert fill.tolist() == [10, 10, 10]
    assert bins.tolist()[:4] == [0, 1, 1, 0] or bins.tolist()[:4] == [0, 1, 0, 1]
    assert (offsets >= 0).all()


# Quality


def test_quality_learns_and_holds_out(docs, spark):
    good = ["".join(random.choices(["the ", "tion ", "and ", "red. ", "blue, "], k=random.randint(20, 90))) for _ in range(200)]
    bad = [" | ".join("".join(random.choices("QXZ$#&", k=6)) for _ in range(random.randint(20, 60))) for _ in range(100)]
    texts = good + bad
    rows = docs(texts + [None, ""])
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality.report(spark, rows, labels).collect()}
    assert len(found) == 302
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found.values())
    right = [r["predicted"] == int(i < 200) for i, r in found.items() if r["held_out"] and i < 300]
    assert len(right) > 40 and np.mean(right) > 0.97
    kept = {r["doc_id"] for r in quality.accepted(spark, rows, labels).collect()}
    assert kept == {i for i, r in found.items() if r["predicted"]}


def test_scores_equal_a_plain_discriminant(docs, spark):
    rng = random.Random(12)
    texts = ["".join(rng.choices(["the ", "Tion ", "and\n", "red. ", "bl,ue ", "7 ", "é"], weights=[9, 5, 5, 3, 2, k % 3 + 1, k % 2 + 1], k=rng.randint(1, 120))) for k in range(260)] + ["", None]
    label = {i: int(rng.random() < 0.6 + 0.3 * (i % 2)) for i in range(240)}
    labels = spark.createDataFrame([(i, q, 0) for i, q in label.items()], "doc_id bigint, quality int, toxic int")
    x = np.array([quality.statistics(t or "") for t in texts])
    learns = [i for i in label if zlib.crc32(str(i).encode()) % 4 != 2]
    y = np.array([label[i] for i in learns])
    known = x[learns]
    z = (x - known.mean(axis=0)) / np.sqrt(np.maximum(known.var(axis=0), 1e-6))
    each = [z[learns][y == k] for k in (0, 1)]
    covs = [np.cov(e.T, bias=True) for e in each]
    pooled = sum(len(e) * c for e, c in zip(each, covs, strict=True)) / len(y)
    density = []
    for e, c in zip(each, covs, strict=True):
        c = 0.95 * (0.8 * c + 0.2 * pooled) + 0.05 * np.diag(np.maximum(np.diag(pooled), 1e-2))
        far = z - e.mean(axis=0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", far, np.linalg.inv(c), far) - 0.5 * np.linalg.slogdet(c)[1])
    logit = 0.25 * (density[1] - density[0]) + np.log(y.mean() / (1 - y.mean()))
    found = {r["doc_id"]: r["score"] for r in quality.report(spark, docs(texts), labels).collect()}
    assert [found[i] for i in range(len(texts))] == pytest.approx((1 / (1 + np.exp(-logit))).tolist(), abs=1e-6)


def test_quality_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in quality.report(spark, docs(["a", None]), none).collect()} == {0.5}
    assert np.isfinite([quality.statistics(t or "") for t in ODD]).all()
