"""Spelling variants, fingerprints and collocations against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldproof.llm import collocations, fingerprint, spelling

SCHEMA = "doc_id long, text string, lang string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def edits_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_vocabulary(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def plain_variants(n):
    near = {w: [x for x in n if edits_one(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def spelled():
    rng = random.Random(4)
    base = ["straßenbau", "Gesellschaft", "différence", "ANAGRAMS", "margansa", "collocation", "aaaaaaaaab"] + ["".join(rng.choices("abé", k=8)) for _ in range(120)]
    out = []
    for i in range(60):
        words = rng.choices(base[:7], k=40) + rng.choices(base[7:], k=20)
        for _ in range(8):
            w = rng.choice(base)
            p = rng.randrange(len(w))
            words.append(rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("xyzß") + w[p + 1 :], w[:p] + "q" + w[p:]]))
        out.append((i if i % 13 else None, " ".join(words), "de"))
    return [*out, out[3], (70, None, None), (71, "", "de"), (72, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 4999 + " " + "x" * 4999, "en")]


@pytest.mark.parametrize("bucket", [24, 0, 10**9])
def test_variants(spark, monkeypatch, bucket):
    """All pairs by full signatures, by rests, and by both."""
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    rows = spelled()
    # a clashing extra column, "n", and repeated rows
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("x")).repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(spelling.words(docs)).collect()}
    want = plain_variants(plain_vocabulary(rows))
    assert got == want
    assert any(v[0] for v in want.values()) and sum(v[3] for v in want.values()) > 50


def test_chain_of_forms(spark):
    words = [("letters", 20000), ("lettera", 1500), ("letterab", 100), ("letterabc", 7), ("unalike", 3)]
    got = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == {"letters": (None, "letters"), "lettera": ("letters", "letters"), "letterab": ("lettera", "letters"), "letterabc": ("letterab", "letters"), "unalike": (None, "unalike")}


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "short words", "en")], SCHEMA)
    assert spelling.variants(spelling.words(docs)).collect() == [] and spelling.variants(spelling.words(docs.limit(0))).collect() == []


def plain_fingerprint(text):
    text = text or ""
    equal = [0] * 8
    for p in re.split(r"[\x0A-\x0D]+", text):
        if p:
            h = hashlib.sha256(p.encode()).hexdigest()
            equal = [(a + int(h[8 * i : 8 * i + 8], 16)) % 2**32 for i, a in enumerate(equal)]
    bits, n = np.zeros(248, np.int64), 0
    for s in re.split(r"[\x20\x09]*[.!?\x0A-\x0D][.!?\x20\x09-\x0D]*", text):
        if s:
            h, n = hashlib.sha256(s.encode()).hexdigest(), n + 1
            bits += [int(h[16 * q : 16 * q + 16], 16) >> (s + 31 * lane) & 1 for q in range(4) for s in range(31) for lane in range(2)]
    words = ".".join(f"{int(b) * 2**31 + int(a):X}" for a, b in bits.reshape(-1, 2))
    return "".join(f"{x:08X}" for x in equal) + f":{words}:{n}", 2 * bits - n


def plain_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    norm = float(a[1] @ a[1]) * float(b[1] @ b[1])
    return max(0.0, min(1.0, float(a[1] @ b[1]) / norm**0.5)) if norm else 0.0


def essays():
    rng = random.Random(8)
    say = lambda n: "".join(" ".join(rng.choices(["ärm", "foot", "𝔸nd", "Head", "toe"], k=rng.randrange(2, 9))) + rng.choice([". ", "!\n", "? ", "\n\n"]) for _ in range(n))
    out = [(7 * i % 101, say(rng.randrange(1, 30)), "en") for i in range(80)]
    return [*out, (200, None, None), (201, "", "en"), (202, "...\n", "en"), (203, "one line", "en"), (203, "one line", "en"), (203, "other", "en"), (None, say(5), "en"), (300, say(3000), "en"), (301, out[4][1], "en")]


@pytest.mark.parametrize("parts", [1, 4])
def test_fingerprints(spark, parts):
    rows = essays()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"v": F.lit(1), "near_next": F.lit("x"), "cell": F.lit(2)}).repartition(parts)
    got = fingerprint.fingerprints(docs).collect()
    digest = {r.text: r.h for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(((r[0] is not None, r[0] or 0, digest[r[1]], r[1] or "") for r in rows))
    want = []
    for i, (known, doc_id, _, text) in enumerate(order):
        after = order[(i + 1) % len(order)][3]
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        a, e, b = (plain_fingerprint(t) for t in (text, edited, after))
        want.append((doc_id if known else None, n, hashlib.sha256(edited.encode()).hexdigest(), a[0], e[0], round(plain_likeness(a, e), 9), round(plain_likeness(a, b), 9)))
    key = lambda r: (r[0] is not None, *[str(x) for x in r])
    assert sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got), key=key) == sorted(want, key=key)
    long = next(r for r in got if r.doc_id == 300)
    assert 0.3 < long.near_edited and long.near_next < 0.3


def test_fingerprints_add_up(spark):
    rows = [("one. two\nthree\n", "four! five\n"), ("", "a\n"), ("x. y. z\n" * 5, "x. y. z\n")]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b, ab, ba = (fingerprint.vector(c) for c in (F.col("a"), F.col("b"), F.concat("a", "b"), F.concat("b", "a")))
    w = fingerprint.written
    for r in df.select(w(ab), w(ba), w(fingerprint.plus(a, b)), w(a), w(fingerprint.minus(ab, b))).collect():
        assert r[0] == r[1] == r[2] and r[3] == r[4]


def test_fingerprints_of_one_or_no_row(spark):
    one = spark.createDataFrame([(5, "abcdef", "en")], SCHEMA)
    (r,) = fingerprint.fingerprints(one).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and r.near_next == 1.0
    assert fingerprint.fingerprints(one.limit(0)).collect() == []


def plain_collocations(rows, least, first):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, g in f.items():
        cand = {p: a for p, a in g.items() if len(p) > 1 and a >= least}
        gone = {q[i : i + m] for q, a in cand.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if a >= cand[q[i : i + m]]}
        scored = []
        for p, a in cand.items():
            if p not in gone:
                score, _, l, r = min((1000 * a * n[lang] // (g[p[:k]] * g[p[k:]]), k, g[p[:k]], g[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:first])]
    return sorted(out)


def speech():
    rng = random.Random(6)
    sure = ["New York City hall", "at the end of the day", "bread and butter", "a a a a a a a", "ÉTÉ à Paris", "xX\x00y z"]
    out = []
    for i in range(150):
        words = []
        for _ in range(rng.randrange(0, 60)):
            words.append(rng.choice(sure) if rng.random() < 0.3 else rng.choice(["the", "day", "and", "of", "butter", f"rare{rng.randrange(300)}"]))
            if rng.random() < 0.15:
                words[-1] += rng.choice([".", ", ", ";\n", "\r", " ! ", "\t"])
        out.append((i, " ".join(words), ["en", "de", None, "und"][i % 4]))
    return [*out, (200, None, "en"), (201, "", "xx"), (202, "... !", "yy"), (203, "over and over " * 400, "en"), out[5]]


@pytest.mark.parametrize("shard", [1 << 20, 50, 3])
def test_collocations(spark, shard):
    """One shard, many, and such that long texts are cut between pieces."""
    rows = speech()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"words": F.lit(1), "n": F.lit("x"), "id": F.lit(0)}).repartition(3)
    got = [tuple(r) for r in collocations.collocations(docs, least=6, first=40, shard=shard).collect()]
    assert sorted(got) == plain_collocations(rows, 6, 40)


def test_collocations_in_parts(spark, monkeypatch):
    """The same with counts dealt over many parts."""
    monkeypatch.setattr(collocations, "PART", 40)
    rows = speech()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    got = [tuple(r) for r in collocations.collocations(docs, least=30, first=40, shard=700).collect()]
    assert sorted(got) == plain_collocations(rows, 30, 40)


def test_shards_send_no_more_as_phrases_become_frequent(spark, monkeypatch):
    """On five times the rows pairs become frequent: what shards send and are told stays a block for each shard and part."""
    made, stored = [], collocations.stored

    def counted(df):
        out = stored(df)
        if "shard" in out.columns:
            made[-1][-1] += [] if "at" in out.columns else [out.count()]
        return out

    monkeypatch.setattr(collocations, "stored", counted)
    rng = random.Random(4)
    for n in (60, 300):
        made.append([[]])
        rows = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(100)), "en") for i in range(n)]
        found, _ = collocations.phrases(spark.createDataFrame(rows, SCHEMA).repartition(1), least=20, shard=3000)
        made[-1].append(found.where(F.size("words") == 2).count())
    (few, pairs), (more, more_pairs) = made
    assert pairs < 10 and more_pairs > 800
    assert len(few) == len(more) and max(few) <= few[0] + 1 and max(more) <= more[0] + 1, made  # shards come first; here there is one part


def test_blocks_of_numbers():
    rng = np.random.default_rng(5)
    for columns in ([np.zeros(0, np.int64)], [np.array([0, 1 << 62, 255, 256])], [np.sort(rng.integers(0, 1 << 40, 999)), rng.integers(0, 300, 999), np.ones(999, np.int64)]):
        got = collocations._unblocked(collocations._blocked(*columns))
        assert [x.tolist() for x in got] == [x.tolist() for x in columns]


@pytest.mark.parametrize("far", [0, 1 << 40])
def test_counts_of_parts(spark, far):
    """Counts of phrases over shards, and which of a shard's phrases they tell; ids beyond 32 bits as well."""
    rng = np.random.default_rng(7)
    rows, sent, parts = [], {}, 3
    for shard in range(6):
        pairs = np.unique(rng.integers(0, 9, (40, 2)), axis=0) + far
        n = rng.integers(1, 5, len(pairs))
        order, start = collocations._dealt(pairs[:, 0], pairs[:, 1], parts)
        for p in range(parts):
            of = order[start[p] : start[p + 1]]
            sent[shard, p] = [(*map(int, pairs[i]), int(n[i])) for i in of]
            rows.append((shard, p, bytearray(collocations._blocked(np.diff(pairs[of, 0], prepend=0), pairs[of, 1], n[of]))))
    counts = Counter()
    for found in sent.values():
        for a, b, k in found:
            counts[a, b] += k
    got = collocations._told(spark.createDataFrame(rows, collocations._BLOCKS), parts, 10).collect()
    often = {i: (a, b, f) for r in got if r.shard is None for i, a, b, f in zip(r.id, r["first"], r["last"], r.f, strict=True)}
    assert {(a, b): f for a, b, f in often.values()} == {pair: f for pair, f in counts.items() if f >= 10}
    told = {(r.shard, r.part): collocations._unblocked(bytes(r.kept)) for r in got if r.shard is not None}
    for key, found in sent.items():
        want = [(at, a, b) for at, (a, b, _) in enumerate(found) if counts[a, b] >= 10]
        step, ids = told.get(key, (np.zeros(0, np.int64),) * 2)
        assert [(at, *often[i][:2]) for at, i in zip(np.cumsum(step).tolist(), ids.tolist(), strict=True)] == want


def test_no_collocations(spark):
    docs = spark.createDataFrame([(1, "a b c", "en"), (2, None, None)], SCHEMA)
    assert collocations.collocations(docs).collect() == [] and collocations.collocations(docs.limit(0)).collect() == []


def test_frequent_words_of_shards_without_a_join(spark):
    """A word's count and id are told where its rows of all shards meet: one shuffle, no join with the frequent words."""
    rows = [(s, lang, at + 1, f"w{at}", at + s % 2) for s in range(20) for at, lang in enumerate(["en", "de", "en", "de"] * 5)]
    got = collocations._frequent(spark.createDataFrame(rows, "shard long, lang string, at long, word string, k long").repartition(5), ["lang", "word"], "k", 100)
    plan = got._jdf.queryExecution().executedPlan().toString()
    counts = Counter()
    for _, lang, _, word, k in rows:
        counts[lang, word] += k
    often = {w: n for w, n in counts.items() if n >= 100}
    out = got.collect()
    assert sorted((r.shard, r["at"], r.lang, r.word, r.f) for r in out) == sorted((s, at, lang, w, often[lang, w]) for s, lang, at, w, _ in rows if (lang, w) in often)
    assert len({r.id for r in out}) == len({(r.lang, r.word, r.id) for r in out}) == len([r for r in out if r.head]) == len(often)
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(lang") == 1


def test_counts_beyond_64_bits(spark):
    """The score of counts whose product passes 64 bits is exact."""
    a, n, l, r = 10**13 + 7, 9 * 10**14 + 1, 3 * 10**13 + 11, 2 * 10**13 + 3
    df = spark.range(1).select(*(F.lit(x).cast("decimal(15,0)").alias(c) for c, x in (("a", a), ("n", n), ("l", l), ("r", r))))
    (got,) = df.select(F.call_function("div", F.lit(1000).cast("decimal(4,0)") * F.col("a") * F.col("n"), F.col("l") * F.col("r"))).first()
    assert got == 1000 * a * n // (l * r)


def test_index_against_counting():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 6, 400).astype(np.int32)
    ids[-1] = 0
    ids = ids[np.flatnonzero((ids > 0) | np.concatenate([[False], ids[:-1] > 0]))]
    index = collocations._Index.of(ids)
    text = ids.tolist()
    word, lo, count = index.words()
    level = {(int(w),): (int(a), int(a), int(c)) for w, a, c in zip(word, lo, count, strict=True)}
    for k in range(2, 6):
        names = list(level)
        got = index.extended(*(np.array([level[p][i] for p in names]) for i in range(3)))
        level = {names[f] + (names[e][-1],): (int(a), int(b), int(c)) for a, b, c, f, e in zip(*got, strict=True)}
        want = Counter(tuple(text[i : i + k]) for i in range(len(text) - k + 1) if 0 not in text[i : i + k])
        assert {p: c for p, (_, _, c) in level.items()} == dict(want)
