"""The numbered queries over the given tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldproof.llm import chunk_dedup, collocations, decontam, embedding_dedup, fingerprint, language, license_scan, mixing, near_dedup, sharding, spelling, suffix_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int) -> Column:
    """crc32(doc_id as text) mod n; of a null doc_id as of an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), fold(3) != 1)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), k=3, num=85, den=100)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, F.array("source"))
    sizes = mixed.groupBy(F.col("pattern")[0].alias("source")).agg(F.sum("size").alias("source_size"))
    rows = sizes.collect()  # one row for each source; mix() has checked their number
    names = sorted((r.source for r in rows), key=lambda s: (s is None, s or ""))
    size = {r.source: r.source_size for r in rows}
    target = mixing.quotas(size, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    known = spark.createDataFrame([(s, size[s], target[s]) for s in names], "source string, source_size long, target double")
    return mixed.join(F.broadcast(known), F.col("pattern")[0].eqNullSafe(F.col("source"))).select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learned = language.prototypes(docs.where(fold(5) != 0))
    return language.identify(docs, learned).select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunk_dedup.dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words(_table(spark, sf_dir, "documents")))


def op12_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


# letters A-Z only are lower-cased; words are runs of ASCII digits and letters and of all beyond ASCII
_WORDS = "list_filter(regexp_split_to_array(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, len(w[i:i + 9]) AS n, array_to_string(w[i:i + 9], ' ') AS t
        FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
place AS (SELECT doc_id, s.n, i, array_to_string(w[i:i + s.n - 1], ' ') AS t
          FROM (SELECT DISTINCT n FROM win) s, (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE i + s.n - 1 <= len(w)),
occ AS (SELECT doc_id, i, p.n, item FROM place p JOIN win ON win.t = p.t AND win.n = p.n),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


OP2_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(w[i:i + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS id, a AS seen FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.seen),
comp AS (SELECT id, min(seen) AS c FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.id = d.doc_id
"""


OP11_SQL = """
WITH RECURSIVE tab AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
one AS (SELECT doc_id, run, count(*) AS k, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, strlen(s) + 1), lambda i: CAST(('0x' || substr(hex(encode(s)), 2 * i - 1, 2)) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) AS h FROM one, tab),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
v AS (SELECT word, sum(k) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
rest AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS r FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)),
pair AS (SELECT a.word, b.word AS near, b.n AS k FROM rest a JOIN rest b ON a.r = b.r AND a.p = b.p AND a.word <> b.word
         UNION SELECT rest.word, v.word, v.n FROM rest JOIN v ON v.word = r UNION SELECT v.word, rest.word, rest.n FROM rest JOIN v ON v.word = r),
best AS (SELECT word, count(*) AS n_near, max(k) AS k, arg_min(near, (-k, near)) AS near FROM pair GROUP BY word),
f AS (SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.k >= 10 * v.n THEN near END AS form, CASE WHEN best.k >= 10 * v.n THEN best.k END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN f ON f.word = chain.next)
SELECT f.word, f.form, chain.at AS root, CAST(f.n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM f JOIN chain ON chain.word = f.word AND chain.next IS NULL
"""


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS i, count(*) OVER () AS m FROM documents),
e AS (SELECT d.doc_id, d.i, x.i AS j, length(d.text) AS c, d.text, d.text[1:length(d.text) - length(d.text) // 2] || x.text[1:length(d.text) // 2] AS edited FROM d JOIN d x ON x.i = d.i % d.m + 1),
t AS (SELECT i, 0 AS kind, text AS t FROM e UNION ALL SELECT i, 1, edited FROM e),
par AS (SELECT i, kind, sha256(p) AS h FROM (SELECT i, kind, unnest(regexp_split_to_array(t, '[
-
]+')) AS p FROM t) WHERE p <> ''),
eq AS (SELECT i, kind, string_agg(printf('%08X', CAST(s AS BIGINT)), '' ORDER BY q) AS eq FROM (SELECT i, kind, q, sum(CAST('0x' || substr(h, 8 * q + 1, 8) AS BIGINT)) % 4294967296 AS s FROM par, range(8) r(q) GROUP BY i, kind, q) GROUP BY i, kind),
sen AS (SELECT i, kind, sha256(p) AS h FROM (SELECT i, kind, unnest(regexp_split_to_array(t, '[ 	]*[.!?
-
][.!? 	-
]*')) AS p FROM t) WHERE p <> ''),
size AS (SELECT i, kind, count(*) AS n FROM sen GROUP BY i, kind),
word AS (SELECT i, kind, 31 * q + s AS w, sum((CAST('0x' || substr(h, 16 * q + 1, 16) AS UBIGINT) >> s) & 1) AS lo, sum((CAST('0x' || substr(h, 16 * q + 1, 16) AS UBIGINT) >> (s + 31)) & 1) AS hi FROM sen, range(4) r(q), range(31) z(s) GROUP BY i, kind, w),
fp AS (SELECT t.i, t.kind, coalesce(eq, repeat('0', 64)) || ':' || coalesce(ws, array_to_string(list_transform(range(124), lambda x: '0'), '.')) || ':' || coalesce(n, 0) AS f
       FROM (SELECT i, kind FROM t) t LEFT JOIN eq USING (i, kind) LEFT JOIN size USING (i, kind) LEFT JOIN (SELECT i, kind, string_agg(printf('%X', CAST(hi * 2147483648 + lo AS BIGINT)), '.' ORDER BY w) AS ws FROM word GROUP BY i, kind) USING (i, kind)),
sign AS (SELECT i, kind, w, 2 * CAST(lo AS BIGINT) - n AS x, 2 * CAST(hi AS BIGINT) - n AS y FROM word JOIN size USING (i, kind)),
norm AS (SELECT i, kind, sum(x * x + y * y) AS nn FROM sign GROUP BY i, kind),
de AS (SELECT a.i, sum(a.x * b.x + a.y * b.y) AS p FROM sign a JOIN sign b ON a.i = b.i AND a.w = b.w AND a.kind = 0 AND b.kind = 1 GROUP BY a.i),
dn AS (SELECT e.i, sum(a.x * b.x + a.y * b.y) AS p FROM e JOIN sign a ON a.i = e.i AND a.kind = 0 JOIN sign b ON b.i = e.j AND b.kind = 0 AND b.w = a.w GROUP BY e.i)
SELECT e.doc_id, CAST(c AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, f0.f AS fingerprint, f1.f AS edited_fingerprint,
       CASE WHEN f0.f = f1.f THEN 1.0 WHEN coalesce(n0.nn * n1.nn, 0) > 0 THEN least(1.0, greatest(0.0, CAST(de.p AS DOUBLE) / sqrt(CAST(n0.nn AS DOUBLE) * CAST(n1.nn AS DOUBLE)))) ELSE 0.0 END AS near_edited,
       CASE WHEN f0.f = f2.f THEN 1.0 WHEN coalesce(n0.nn * n2.nn, 0) > 0 THEN least(1.0, greatest(0.0, CAST(dn.p AS DOUBLE) / sqrt(CAST(n0.nn AS DOUBLE) * CAST(n2.nn AS DOUBLE)))) ELSE 0.0 END AS near_next
FROM e JOIN fp f0 ON f0.i = e.i AND f0.kind = 0 JOIN fp f1 ON f1.i = e.i AND f1.kind = 1 JOIN fp f2 ON f2.i = e.j AND f2.kind = 0
LEFT JOIN norm n0 ON n0.i = e.i AND n0.kind = 0 LEFT JOIN norm n1 ON n1.i = e.i AND n1.kind = 1 LEFT JOIN norm n2 ON n2.i = e.j AND n2.kind = 0
LEFT JOIN de ON de.i = e.i LEFT JOIN dn ON dn.i = e.i
"""


OP13_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS id, lang, w FROM (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents)) WHERE len(w) > 0),
total AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) r(k)) GROUP BY lang, k, phrase HAVING count(*) >= 100),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT c.lang, c.k, c.phrase, c.a, j, x.f AS l, y.f AS r, (1000 * CAST(c.a AS HUGEINT) * n) // (CAST(x.f AS HUGEINT) * y.f) AS score
        FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c JOIN total t ON t.lang = c.lang
        JOIN f x ON x.lang = c.lang AND x.k = j AND x.phrase = array_to_string(w[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.k = c.k - j AND y.phrase = array_to_string(w[j + 1:], ' ')),
low AS (SELECT lang, phrase, a, l, r, score FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM cand, range(2, 5) r(m) WHERE m < k)),
left_ AS (SELECT low.* FROM low WHERE NOT EXISTS (SELECT 1 FROM inner_ x WHERE x.lang = low.lang AND x.phrase = low.phrase AND 100 * x.a >= 100 * low.a))
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT x.*, n, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_ x JOIN total USING (lang)) WHERE rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_near_dedup, op3_mixing, op4_language, op5_suffix_dedup, op6_embedding_dedup, op7_sharding, op8_license, op9_chunk_dedup, op10_decontamination, op11_spelling, op12_fingerprint, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": OP2_SQL, "op10_decontamination": OP10_SQL, "op11_spelling": OP11_SQL, "op12_fingerprint": OP12_SQL, "op13_collocations": OP13_SQL}
