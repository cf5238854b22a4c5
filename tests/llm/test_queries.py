"""The registered queries of the corpus operators on a small folder, columns of their contracts included."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldproof.llm import chunk_dedup, mixing, queries
from test_operators import covered, plain_words, smallest_reachable, space_words, texts

RUN = queries.queries()


def bench_items():
    return [(1, " ".join(plain_words(texts()[11]))), (2, "one two"), (3, None), (5, texts()[11].upper()), (30, "MIT License")]


def rows():
    kinds = {0: "en", 1: "fr", 2: None}
    out = [(i, t, kinds[i % 3], None if i % 11 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts())]
    rng = random.Random(2)
    for i in range(100, 160):
        words = ["the", "with", "from", "shall"] if i % 2 else ["der", "und", "nicht", "schön"]
        toxic = ["nasty", "vile"] * 3 if i % 5 == 0 else []
        out.append((i, " ".join(rng.choices(words, k=40) + toxic), "en" if i % 2 else "de", "s9", 1))
    return [*out, out[3]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench_items(), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(100, 160)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rng = np.random.default_rng(1)
    v = rng.standard_normal((60, 16)).astype(np.float32)
    v[50:] = v[:10] + 0.02
    spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


def got(spark, folder, name):
    df = RUN[name](spark, folder)
    return df, df.collect()


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_toxicity(spark, folder):
    df, out = got(spark, folder, "op1_toxicity")
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and Counter(r.doc_id for r in out) == Counter(r[0] for r in rows())
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in out)


def test_near_dedup(spark, folder):
    _, out = got(spark, folder, "op2_near_dedup")
    sets = {}
    for i, t, *_ in rows():
        w = space_words(t)
        sets[i] = {tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = smallest_reachable(sets, links)
    assert len(out) == len(rows()) and all((r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id) for r in out)


def test_mixing(spark, folder):
    _, out = got(spark, folder, "op3_mixing")
    size, source, total = {r[0]: len(space_words(r[1])) for r in rows()}, {r[0]: r[3] for r in rows()}, Counter()
    for r in rows():
        total[r[3]] += size[r[0]]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    target = mixing.quotas(total, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)})
    taken = Counter()
    for r in out:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], total[s]) and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert len(out) == len(rows()) and all(0 <= target[s] - taken[s] <= max(1, 0.01 * target[s]) for s in names)
    again = RUN["op3_mixing"](spark, folder).collect()
    assert Counter((r.doc_id, r.taken) for r in out) == Counter((r.doc_id, r.taken) for r in again)


def test_language(spark, folder):
    _, out = got(spark, folder, "op4_language")
    known = {r[2] for r in rows() if r[1] is not None and fold(r[0], 5)} - {None}
    for r in out:
        letters = any(c.isalpha() for c in dict((x[0], x[1]) for x in rows())[r.doc_id] or "")
        assert r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1
        assert r.lang_pred in known if letters else r.lang_pred == "und"


def by_doc(out):
    return {r.doc_id: r for r in out}


def test_suffix_dedup(spark, folder):
    _, out = got(spark, folder, "op5_suffix_dedup")
    text = {r[0]: r[1] for r in rows()}
    order = sorted(text)
    cover = dict(zip(order, covered([text[i] for i in order]).values(), strict=True))
    for i, r in by_doc(out).items():
        b, c = np.frombuffer((text[i] or "").encode(), np.uint8), cover[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), int(c.sum()), int((np.diff(c.astype(int), prepend=0) == 1).sum()))
        assert r.kept_sha256 == hashlib.sha256(b[~c].tobytes()).hexdigest()


def test_embeddings(spark, folder):
    _, out = got(spark, folder, "op6_embedding_dedup")
    v = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    link = lambda a, b: v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]) >= 0.95
    links = [(a, b) for a in v for b in v if a < b and link(a, b)]
    want, n = smallest_reachable(v, links), Counter(x for p in links for x in p)
    assert links and all((r.n_links, r.component_id, r.kept) == (n[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id) for r in out)


def test_sharding(spark, folder):
    _, out = got(spark, folder, "op7_sharding")
    text, slots, where, size = {r[0]: (r[1] or "").encode() for r in rows()}, defaultdict(list), defaultdict(set), Counter()
    for r in out:
        t = text[r.doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "bytes", None) and 0 <= r.shard < 8
        slots[r.shard].append(r.slot)
        where[t].add(r.shard)
    assert len(out) == len(rows()) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())


def test_license(spark, folder):
    df, out = got(spark, folder, "op8_license")
    assert df.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"] and len(out) == len(rows())
    r = by_doc(out)[12]
    assert (r.n_base, r.base_labels, r.first_word, r.last_word, r.score) == (3, "cc-by,gpl,mit", 0, 8, 1.0)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and r.n_words == len(plain_words(dict((x[0], x[1]) for x in rows())[r.doc_id])) for r in out)


def gear_chunks(b):
    """Chunks of a text by the rule, byte by byte."""
    h = []
    for i in range(len(b)):
        x = sum(int(chunk_dedup._GEAR[b[i - j]]) << (2 * j) for j in range(min(chunk_dedup.REACH, i + 1))) & 0xFFFFFFFF
        x = (x ^ (x >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF
        h.append(x ^ (x >> 12))
    out, start, r = [], 0, chunk_dedup.RADIUS
    at = lambda i: h[i] if 0 <= i < len(h) else 0xFFFFFFFF
    for i in range(len(b)):
        if all(h[i] < at(i - j) and h[i] <= at(i + j) for j in range(1, r + 1)):
            e = i + 1
            for _ in range(3):
                if e < len(b) and b[e] & 0xC0 == 0x80:
                    e += 1
            if start < e < len(b):
                out.append((start, e))
                start = e
    return [*out, (start, len(b))] if b else []


def test_chunk_dedup(spark, folder):
    """Cuts, digests and the rule for short ends against the same by brute force."""
    _, out = got(spark, folder, "op9_chunk_dedup")
    text = {r[0]: (r[1] or "").encode() for r in rows()}
    chunks, owner = {i: gear_chunks(b) for i, b in text.items()}, {}
    for i in sorted(text):
        for s, e in chunks[i]:
            owner.setdefault(text[i][s:e], i)
    some = 0
    for i, r in by_doc(out).items():
        b, c = text[i], np.zeros(len(text[i]), bool)
        for s, e in chunks[i]:
            if owner[b[s:e]] < i:
                c[s:e] = True
        runs = np.flatnonzero(np.diff(np.concatenate([[0], c.astype(int), [0]]))).reshape(-1, 2).tolist()
        for s, e in runs:
            if e - s < chunk_dedup.RADIUS and e - s < len(b):
                c[s:e] = False
        n = int((np.diff(c.astype(int), prepend=0) == 1).sum())
        kept = bytes(x for x, gone in zip(b, c, strict=True) if not gone)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(c.sum()), n, hashlib.sha256(kept).hexdigest()), i
        some += bool(c.any())
    assert some >= 4


def test_decontamination(spark, folder):
    _, out = got(spark, folder, "op10_decontamination")
    for r in out:
        w, hit, found = plain_words(dict((x[0], x[1]) for x in rows())[r.doc_id]), set(), set()
        for item, text in bench_items():
            x = plain_words(text)
            for win in {tuple(x[j : j + 10]) for j in range(max(1, len(x) - 9))} if x else ():
                for s in range(len(w) - len(win) + 1):
                    if tuple(w[s : s + len(win)]) == win:
                        hit |= set(range(s, s + len(win)))
                        found.add(str(item))
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
