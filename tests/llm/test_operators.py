"""Each operator against brute force on a small table with null, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldproof.llm import chunk_dedup, decontam, embedding_dedup, language, license_scan, mixing, near_dedup, sharding, suffix_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, n_words string"


def texts() -> list[str | None]:
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgéü") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = say(120), say(60)
    near = base.split()
    near[50] = "changed"
    out = [base, base, " ".join(near), say(100) + " " + passage + " " + say(30), say(20) + "\n" + passage, None, "", "  \t", "!!! ...", "a", "one two", passage, "MIT License and the GNU  General Public-License, cc by", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation files", "x" * 400, "ab " * 300]
    out += [say(rng.randint(1, 150)) for _ in range(24)]
    out.append(say(9000))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "fr", None if i % 11 == 0 else f"s{i % 3}", len(t or ""), "x", "y", "z") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCS).repartition(3).persist()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def space_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", low(t))


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


def smallest_reachable(ids, links):
    best = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(best[a], best[b])
            changed |= best[a] != m or best[b] != m
            best[a] = best[b] = m
    return best


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, k, num):
    sets = {}
    for i, t in enumerate(texts()):
        w = space_words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = smallest_reachable(sets, links)
    got = by_id(near_dedup.near_duplicates(docs.unionByName(docs.where("doc_id = 3")), k=k, num=num))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_star_of_another_hub_joins_what_the_first_missed(spark):
    """Copies that are alike only through a text that is not the smallest id."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        w = list(base)
        for p in rng.sample(range(0, 300), 6):
            w[p] = f"c{i}x{p}"
        rows.append((i, " ".join(w)))
    rows.append((100, " ".join(base)))
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(298)} for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = smallest_reachable(sets, links)
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=85))
    assert {i: r.component_id for i, r in got.items()} == want


def test_near_duplicates_of_repeated_ids(spark):
    """Classes are known by their sets: an id with several texts links each of them, in any order of rows."""
    a, b = "one two three four five six seven eight nine ten", " ".join(f"w{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, b + " extra")]
    for order in itertools.permutations(rows):
        got = near_dedup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").coalesce(1), k=3, num=85).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(1, 8, 1, True), (1, 38, 1, True), (2, 39, 1, False)]
    # two components with the same smallest id stay two
    both = [(1, a), (2, a), (1, b), (3, b), (3, "something else entirely here now")]
    got = near_dedup.near_duplicates(spark.createDataFrame(both, "doc_id long, text string"), k=3, num=85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 8, 1), (1, 38, 1), (2, 8, 1), (3, 3, 3), (3, 38, 1)]


def test_windows_are_found_without_counts(docs, spark, monkeypatch):
    """Counts choose where a window is looked up, never whether."""
    items = spark.createDataFrame([(1, " ".join(plain_words(texts()[11]))), (2, "one two"), (3, "no such words anywhere at all")], "item_id long, text string")
    key = lambda: sorted((r.doc_id, r.n_hit, r["items"]) for r in decontam.contamination(docs, items).collect())
    want = key()
    assert any(n for _, n, _ in want)
    for counts in ({}, defaultdict(lambda: 1)):
        monkeypatch.setattr(decontam, "_counted", lambda rows, shingles, c=counts: c)
        assert key() == want


def test_decontamination(docs, spark):
    items = [(1, " ".join(plain_words(texts()[11]))), (2, "one two"), (3, None), (4, "!!"), (5, texts()[11].upper()), (6, "never seen words here at all in any of the texts")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in enumerate(texts()):
        w = plain_words(t)
        hit, found = set(), set()
        for item, text in items:
            x = plain_words(text)
            for win in {tuple(x[j : j + 10]) for j in range(max(1, len(x) - 9))} if x else ():
                for s in range(len(w) - len(win) + 1):
                    if tuple(w[s : s + len(win)]) == win:
                        hit |= set(range(s, s + len(win)))
                        found.add(str(item))
        want[i] = (len(w), len(hit), sorted(found))
    for block in (8 << 20, 200):  # one block, and several chained
        got = by_id(decontam.contamination(docs, bench, block_bytes=block))
        assert {i: (r.n_words, r.n_hit, r["items"]) for i, r in got.items()} == want
    assert by_id(decontam.contamination(docs, bench.where("false")))[3].n_hit == 0


def covered(all_texts, width=50):
    seen, out = {}, {}
    for i, t in enumerate(all_texts):
        b = (t or "").encode()
        c = np.zeros(len(b) + 1, int)
        for j in range(len(b) - width + 1):
            if seen.setdefault(b[j : j + width], i) < i:
                c[j] += 1
                c[j + width] -= 1
        out[i] = np.cumsum(c[:-1]) > 0
    return out


@pytest.mark.parametrize("case", ["whole anchors", "anchors over shards", "frequent anchors of the sample"])
def test_suffix_dedup(docs, case, monkeypatch):
    if case != "whole anchors":  # shards, ranges and parts so small that most strings meet others of their kind elsewhere
        for name, value in {"SHARD": 4000, "RANGE": 20_000, "PART_ANCHORS": 500}.items():
            monkeypatch.setattr(suffix_dedup, name, value)
    if case == "frequent anchors of the sample":
        monkeypatch.setattr(suffix_dedup, "SEEN", 2)
    cover = covered(texts())
    got = by_id(suffix_dedup.dedup(docs, most=20_000 if case == "whole anchors" else 1))
    for i, t in enumerate(texts()):
        b = np.frombuffer((t or "").encode(), np.uint8)
        runs = int((np.diff(cover[i].astype(int), prepend=0) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(b), int(cover[i].sum()), runs, b[~cover[i]].tobytes()), i


def test_suffix_dedup_of_crossing_strings(spark):
    """Few long strings over a small alphabet, NUL bytes among them, repeated rows and rows without an id."""
    rng = random.Random(4)
    base = ["".join(rng.choice("ab\0") for _ in range(90)) for _ in range(12)]
    own = []
    for _ in range(300):
        a, b = rng.choice(base), rng.choice(base)
        k, m = rng.randint(0, 90), rng.randint(0, 90)
        own.append(a[:k] + b[m:] + rng.choice(base)[rng.randint(0, 60) :])
    cover = covered(own)
    rows = [*enumerate(own), (7, own[7]), (None, own[3])]
    for most in (20_000, 1):
        got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), most=most).collect()
        assert len(got) == len(rows)
        for r in got:
            b = np.frombuffer(own[3 if r.doc_id is None else r.doc_id].encode(), np.uint8)
            gone = np.zeros(len(b), bool) if r.doc_id is None else cover[r.doc_id]
            assert (r.n_removed, bytes(r.kept)) == (int(gone.sum()), b[~gone].tobytes())


def test_suffix_array_and_common_prefixes():
    for t in (b"banana", b"aaaaaaaaaaaaaaaaaaaaaaaa", b"abracadabra" * 5, b"x"):
        a = np.frombuffer(t, np.uint8)
        sa = suffix_dedup.suffix_array(a)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        lcp = suffix_dedup.common_prefixes(a, sa, 1000)
        for k in range(1, len(t)):
            x, y = t[sa[k - 1] :], t[sa[k] :]
            n = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            assert lcp[k] == n


def test_long_texts_are_cut_in_segments_without_loss(monkeypatch):
    t = np.frombuffer(" ".join(x or "" for x in texts()).encode(), np.uint8)
    offs = np.array([0, len(t)])
    whole = [np.concatenate(x).tolist() for x in zip(*suffix_dedup.anchors(t, offs), strict=True)]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    parts = [np.concatenate(x).tolist() for x in zip(*suffix_dedup.anchors(t, offs), strict=True)]
    assert whole == parts and len(whole[1]) > len(t) / 30


def test_chunk_dedup(docs):
    got = by_id(chunk_dedup.dedup(docs))
    cover = covered(texts(), 40)
    for i, t in enumerate(texts()):
        assert got[i].n_bytes == len((t or "").encode())
        assert got[i].n_removed <= cover[i].sum()  # only bytes that an earlier text has
        assert got[i].n_removed == got[i].n_bytes - len(got[i].text.encode())
    assert got[1].n_removed > 0.8 * got[1].n_bytes and got[4].n_removed > 100 and got[0].n_removed == 0 and got[20].n_removed == 0


def test_short_copies_go_too(spark):
    short = "forty bytes that a third of all rows has"
    rows = [(i, short if i % 3 == 0 else f"{i} {'qwertyuiop'[i % 10] * 5} own text number {i * i}") for i in range(60)]
    got = by_id(chunk_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r.n_removed for i, r in got.items()} == {i: len(short) if i % 3 == 0 and i else 0 for i, _ in rows}
    # passages of 110 bytes inside longer texts: often one chunk of them alone repeats
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [say(110) for _ in range(20)]
    rows = [(i, say(300) + shared[i % 20] + say(300)) for i in range(40)]
    got = by_id(chunk_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    alone = [i for i in range(20, 40) if 0 < got[i].n_removed < 64]
    assert alone and all(got[i].n_removed >= chunk_dedup.RADIUS for i in alone) and all(got[i].n_removed == 0 for i in range(20))


def test_chunks_survive_insertions():
    a = np.frombuffer(texts()[-1].encode(), np.uint8)
    b = np.concatenate([a[:5000], np.frombuffer(b"inserted!", np.uint8), a[5000:]])
    ends = [set(chunk_dedup.cuts(x, np.array([0, len(x)]))[1].tolist()) for x in (a, b)]
    assert len({e for e in ends[0] if e > 5200} - {e - 9 for e in ends[1]}) == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 24))
    for i in range(100, 160):
        x[i] = x[i % 7] + rng.standard_normal(24) * 0.12
    x[200] = x[3]
    x[201] = 0
    rows = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(x)] + [(300, None, 1), (301, [None] * 24, 1), (302, [float("nan")] * 24, 1), (303, [], 1), (304, [1.0, 2.0], 1)]
    v = np.array([r[1] for r in rows[:300]], np.float32).astype(np.float64)
    n = np.linalg.norm(v, axis=1)
    s = (v / np.where(n == 0, 1, n)[:, None]) @ (v / np.where(n == 0, 1, n)[:, None]).T >= 0.95
    np.fill_diagonal(s, False)
    want = smallest_reachable(range(305), [(int(a), int(b)) for a, b in zip(*np.nonzero(s), strict=True)])
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), window=16).collect()}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (int(s[i].sum()) if i < 300 else 0, want[i], want[i] == i) for i in range(305)}


def test_license_scan(docs):
    got = by_id(license_scan.scan(docs))
    for i, t in enumerate(texts()):
        w, starts, labels = plain_words(t), [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    starts.append(j)
                    labels.add(label)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
    assert got[12].labels == "cc-by,gpl,mit" and got[12].score == 1
    assert got[13].labels == "mit" and 0.6 <= got[13].score < 1 and got[13].n_base == 0


def template_labels(text, gap=3, least=0.6):
    """The rule of verified spans, from all places at once."""
    w, k, out = plain_words(text), license_scan.K_TEMPLATE, set()
    for template, label in license_scan.TEMPLATES:
        t = template.split()
        size = len(t) - k + 1
        votes = defaultdict(list)
        for place in range(size):
            for pos in range(len(w) - k + 1):
                if w[pos : pos + k] == t[place : place + k]:
                    votes[pos - place].append((place, pos))
        groups, last = [], None
        for d in sorted(votes):
            lo = min(p for _, p in votes[d])
            if last is not None and d - last[0] <= gap and lo - last[1] <= size + gap:
                groups[-1].append(d)
            else:
                groups.append([d])
            last = (d, lo)
        for g in groups:
            main = max(g, key=lambda d: (len(votes[d]), -d))
            at = {}
            for place, pos in (v for d in g for v in votes[d]):
                at[place] = min(at.get(place, (10**9, 0)), (abs(pos - place - main), pos))
            n, hi, before = 0, 0, 0
            for place in sorted(at):
                pos = at[place][1]
                if n == 0 or 0 < pos - hi <= place - before + gap:
                    n, hi, before = n + 1, pos, place
            if n >= least * size:
                out.add(label)
    return out


def test_license_spans_are_verified(spark):
    rng = random.Random(9)
    rows = ["of the " * 20, "you may " * 20, "of the software and of the license " * 30]
    rows += [" ".join(rng.sample(t.split(), len(t.split()))) for t, _ in license_scan.TEMPLATES]  # the same words in another order
    rows += [" ".join(" ".join(t.split()[i : i + 3]) for i in rng.sample(range(len(t.split()) - 2), 12)) for t, _ in license_scan.TEMPLATES if len(t.split()) > 15]
    n = len(rows)
    for t, _ in license_scan.TEMPLATES:
        w = t.split()
        del w[rng.randrange(len(w))]  # a word less and a word more
        w.insert(rng.randrange(len(w)), "indeed")
        rows.append("before that " + " ".join(w).upper() + " and so on")
        rows.append(" ".join(t.split()[: len(t.split()) // 3]))
    got = by_id(license_scan.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").unionByName(spark.createDataFrame([(0, rows[0])], "doc_id long, text string"))))
    for i, t in enumerate(rows):
        own = set(filter(None, got[i].labels.split(","))) - set(filter(None, got[i].base_labels.split(",")))
        assert own == template_labels(t) - set(filter(None, got[i].base_labels.split(","))), (i, t)
    assert not any(got[i].labels for i in (0, 1, 2)) and sum(bool(got[i].labels) for i in range(3, n)) <= 2
    assert sum(bool(got[i].labels) for i in range(n, len(rows), 2)) >= 0.8 * len(license_scan.TEMPLATES)


def test_language(spark):
    rng = random.Random(5)
    kinds = {"aa": ["the", "with", "and", "from", "shall"], "bb": ["der", "und", "nicht", "für", "schön"], "cc": ["что", "это", "как", "для"]}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(rng.randint(3, 60))), k) for i, k in enumerate(sorted(kinds) * 40)]
    df = spark.createDataFrame([*rows, (1000, None, "aa"), (1001, "123 !!", "aa"), (1002, "", None)], "doc_id long, text string, lang string")
    learned = language.prototypes(df.where("doc_id % 5 <> 0"))
    assert sorted(learned) == ["aa", "bb", "cc"]
    got = by_id(language.identify(df, learned, keep=["lang"]))
    assert all(got[i].lang_pred == k and 0 < got[i].score <= 1 for i, _, k in rows)
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert {r.lang_pred for r in language.identify(df, {}).collect()} == {"und"}


def test_language_parts_of_long_texts_add_up(monkeypatch):
    enc, text = language.Encoder(), texts()[-1]
    codes, counts, _ = enc.grams(text)
    monkeypatch.setattr(language, "PART", 1000)
    parts = dict(zip(*[x.tolist() for x in enc.grams(text)[:2]], strict=True))
    whole = dict(zip(codes.tolist(), counts.tolist(), strict=True))
    assert sum(abs(parts.get(c, 0) - n) for c, n in whole.items()) <= 4 * len(text) / 1000 + 4


def test_toxicity(spark):
    rng = random.Random(6)
    bad, good = [f"bad{i}" for i in range(6)], [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 6 == 0
        w = [rng.choice(good) for _ in range(60)] + ([rng.choice(bad) for _ in range(4)] if toxic else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        if i % 3 != 1:
            labels.append((i, 1 if toxic else 0))
    docs = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), fold)
    got = by_id(toxicity.score(docs, model))
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i].score >= 0.7) == (i % 6 == 0) for i in held) >= 0.97 * len(held)
    assert got[5000].score == got[5001].score < 0.7
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"), fold)
    assert max(r.score for r in toxicity.score(docs, none).collect()) < 0.01


def test_mixing(docs):
    out = by_id(mixing.mix(docs, F.array("source"), repeats=3))
    size, source = {i: len(space_words(t)) for i, t in enumerate(texts())}, {r.doc_id: r.source for r in docs.collect()}
    names = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    total = {s: sum(n for i, n in size.items() if source[i] == s) for s in names}
    targets = mixing.quotas(total, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)})
    assert abs(sum(targets.values()) - sum(total.values())) < 1e-6 and all(targets[s] <= 3 * total[s] + 1e-9 for s in names)
    for s in names:
        taken = sum(r.taken for i, r in out.items() if source[i] == s)
        assert targets[s] - max(20, 0.05 * targets[s]) <= taken <= targets[s] + 1e-6
    assert all(r.size == size[i] and 0 <= r.taken <= 3 * r.size for i, r in out.items())
    again = by_id(mixing.mix(docs.repartition(5), F.array("source"), repeats=3))
    assert {i: r.taken for i, r in out.items()} == {i: r.taken for i, r in again.items()}


def test_flow_of_overlapping_sources():
    patterns = {("a",): 100, ("a", "b"): 50, ("b",): 10}
    got = mixing.flow(patterns, {"a": 120.0, "b": 40.0})
    assert abs(sum(q.get("a", 0) for q in got.values()) - 120) < 1e-6 and abs(sum(q.get("b", 0) for q in got.values()) - 40) < 1e-6
    assert all(sum(q.values()) <= patterns[p] + 1e-6 for p, q in got.items())  # nothing repeated while fresh tokens are left
    assert abs(sum(mixing.flow({("a",): 10}, {"a": 25.0})[("a",)].values()) - 25) < 1e-6


def test_flow_costs_least():
    """Against every way to route whole tokens, on small graphs."""
    rng = random.Random(12)

    def least(patterns, targets, repeats):
        """Most tokens routed, and the least cost of it, by trying everything."""
        best = {tuple([0] * len(targets)): 0}  # tokens at each source: least cost so far
        for p, tokens in patterns.items():
            grown = {}
            for have, cost in best.items():
                for n in itertools.product(*(range(t - h + 1) if s in p else (0,) for h, (s, t) in zip(have, targets.items(), strict=True))):
                    if sum(n) <= repeats * tokens:
                        full, rest = divmod(sum(n), tokens) if tokens else (0, 0)
                        c = cost + tokens * full * (full - 1) // 2 + rest * full
                        key = tuple(a + b for a, b in zip(have, n, strict=True))
                        grown[key] = min(grown.get(key, 10**9), c)
            best = grown
        most = max(map(sum, best))
        return most, min(c for k, c in best.items() if sum(k) == most)

    for _ in range(60):
        names = "abc"[: rng.randint(1, 3)]
        patterns = {p: rng.randint(0, 4) for p in {tuple(sorted(rng.sample(names, rng.randint(1, len(names))))) for _ in range(3)}}
        targets, repeats = {s: rng.randint(0, 5) for s in names}, rng.randint(1, 3)
        got = mixing.flow(patterns, {s: float(t) for s, t in targets.items()}, repeats)
        cost = 0
        for p, q in got.items():
            n = sum(q.values())
            assert n <= repeats * patterns[p] + 1e-6 and set(q) <= set(p)
            full = int(n / patterns[p] + 1e-9) if patterns[p] else 0
            cost += patterns[p] * full * (full - 1) / 2 + (n - full * patterns[p]) * full
        routed = sum(sum(q.values()) for q in got.values())
        want = least(patterns, targets, repeats)
        assert (round(routed, 6), round(cost, 6)) == want, (patterns, targets, repeats)


def test_flow_over_many_patterns():
    rng = random.Random(13)
    names = [f"s{i}" for i in range(12)]
    patterns = {tuple(sorted(rng.sample(names, rng.randint(1, 6)))): rng.randint(1, 1000) for _ in range(3000)}
    total = sum(patterns.values())
    targets = {s: total * (i % 3 + 1) / 24 for i, s in enumerate(names)}
    got = mixing.flow(patterns, targets)
    assert all(abs(sum(q.get(s, 0) for q in got.values()) - t) < 1 for s, t in targets.items())
    assert all(sum(q.values()) <= patterns[p] + 1e-3 for p, q in got.items())  # all is fresh


def test_mixing_of_repeated_rows(spark):
    """Copies of a row are taken one by one."""
    one = " ".join(f"w{i}" for i in range(10))
    rows = [(1, one, "a")] * 5 + [(2, " ".join(f"v{i}" for i in range(36)), "b")]
    for n in (1, 4):
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n), F.array("source"), weights={"a": 1, "b": 1}).collect()
        assert len(got) == 6
        taken = {p: sum(r.taken for r in got if r.pattern == [p]) for p in "ab"}
        assert taken == {"a": 43, "b": 43} and all(r.taken <= 3 * r.size for r in got)
        assert sorted(r.taken for r in got if r.pattern == ["a"]) in ([0, 10, 10, 10, 13], [3, 10, 10, 10, 10], [0, 3, 10, 10, 20])


def test_mixing_of_overlapping_sources(spark):
    """Documents of two sources serve the one that lacks tokens, and nothing is repeated."""
    words = lambda k, n: " ".join(f"{k}x{i}" for i in range(n))
    rows = [(i, words(i, 20), ["web"]) for i in range(50)] + [(100 + i, words(100 + i, 20), ["web", "books"]) for i in range(50)] + [(200 + i, words(200 + i, 20), ["books", "books"]) for i in range(5)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, s array<string>"), F.col("s"), weights={"web": 1, "books": 1}).collect()
    by = Counter()
    for r in got:
        by[tuple(r.pattern)] += r.taken
        assert r.times <= 1
    # targets of 1,050: web has 1,000 of its own and takes 50 of both; books has 100 and takes 950 of both
    assert by[("web",)] + by[("books", "web")] + by[("books",)] == 2100 and by[("books", "web")] == 1000 and by[("books",)] == 100


def smallest_capacity(rows, shards):
    """By brute force over the groups in the order of the operator."""
    groups = Counter()
    for t in rows:
        groups[hashlib.md5(t).hexdigest() + f"{len(t):08X}"] += len(t) + 1
    order = [groups[k] for k in sorted(groups)]

    def feasible(cap):
        used, n = 0, 1
        for g in order:
            if g > cap:
                return False
            used, n = (used + g, n) if used + g <= cap else (g, n + 1)
        return n <= shards

    lo, hi = 0, sum(order)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if feasible(mid) else (mid, hi)
    return hi


@pytest.mark.parametrize("listed", [200_000, 5])
@pytest.mark.parametrize("hot", [1, 300])
def test_sharding(docs, listed, hot, monkeypatch):
    """``hot`` rows have one text; few rows may be listed, so that cells are split again and again, few at a time."""
    monkeypatch.setattr(sharding, "LISTED", listed)
    if listed == 5:
        monkeypatch.setattr(sharding, "OPENED", 3)
        monkeypatch.setattr(sharding, "CELL_BITS", 2)
    more = docs.where("doc_id = 9").withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(hot)))).drop("_")
    got = sharding.shard(docs.unionByName(more), 4).collect()
    assert len(got) == len(texts()) + hot
    size, slots, where, rows = Counter(), defaultdict(list), defaultdict(set), []
    for r in got:
        t = (texts()[r.doc_id] or "").encode()
        rows.append(t)
        assert (r.size, r.text_crc32) == (len(t) + 1, zlib.crc32(t))
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[t].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())
    assert max(size.values()) == smallest_capacity(rows, 4)


def test_sharding_with_a_text_of_a_third_of_all_bytes(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(1, 60)) for i in range(400)] + [(1000 + i, "the same text again and again") for i in range(200)]
    for shards in (2, 8, 30):
        got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards).collect()
        size = Counter()
        for r in got:
            size[r.shard] += r.size
        assert max(size.values()) == smallest_capacity([t.encode() for _, t in rows], shards)


def test_empty_tables(docs, spark):
    none = docs.where("false")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    vec = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (near_dedup.near_duplicates(none), decontam.contamination(none, bench), suffix_dedup.dedup(none), chunk_dedup.dedup(none), license_scan.scan(none), language.identify(none, language.prototypes(none)), mixing.mix(none, F.array("source")), sharding.shard(none), embedding_dedup.near_duplicates(vec)):
        assert df.collect() == []
