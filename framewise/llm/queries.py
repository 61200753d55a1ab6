"""The registered query of each operator and its DuckDB SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import bpe
from framewise.llm.common import documents
from framewise.llm.decontaminate import contamination
from framewise.llm.fim import fill_in_middle, restore
from framewise.llm.importance import resample
from framewise.llm.jaccard import jaccard_components
from framewise.llm.licenses import TEMPLATES, license_matches
from framewise.llm.lm import lm_scores
from framewise.llm.mixing import mixed_counts
from framewise.llm.repeats import remove_repeats
from framewise.llm.secrets import find_secrets
from framewise.llm.topk import quantised, top_k
from framewise.llm.toxicity import score_column, train as train_toxicity
from framewise.llm.warc import round_trip


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, h, sha1(h) AS hx, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(hx, CAST(floor(x / 4) AS BIGINT) * 5 + 1, 5) AS INTEGER) >> (15 - 5 * CAST(x % 4 AS INTEGER))) & 31) + 1 AS BIGINT), 1)
           for x in range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM s
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_counts(documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


OP4_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS run
       FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) t(i) WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS run
       FROM w, lens, unnest(range(1, greatest(len(ws) - n + 1, 0) + 1)) t(i) WHERE len(ws) >= n),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (run, n)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hits), unnest(range(i, i + n)) t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos ON pos.doc_id = w.doc_id LEFT JOIN its ON its.doc_id = w.doc_id
"""

def remainder(doc_id, n: int):
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    scorer = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    return docs.select("doc_id", held.alias("held_out"), score_column(scorer, F.col("text")).alias("score")) \
        .withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.coalesce(remainder(F.col("doc_id"), 10), F.lit(1))
    return lm_scores(documents(spark, sf_dir), fold == 0, fold == 9)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


OP7_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS s
       FROM w, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
sym AS MATERIALIZED (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, b.y FROM reach r JOIN sym b ON b.x = r.y)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(y) FROM reach r WHERE r.x = w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("q")) \
        .where("vec_id is not null and q is not null")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir)).select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_matches(documents(spark, sf_dir))
    every = F.concat(F.transform("matches", lambda m: F.struct(m["license"].alias("license"), m["dice"].alias("dice"))),
                     F.transform("windows", lambda m: F.struct(m["license"].alias("license"), m["dice"].alias("dice"))))
    ids = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m["license"]))), ",")
    return found.select(
        "doc_id", "n_units", F.size(F.array_distinct(F.transform("matches", lambda m: m["unit"]))).cast("long").alias("n_matched"),
        F.size("windows").cast("long").alias("n_windows"), ids(F.col("windows")).alias("window_licenses"),
        ids(every).alias("licenses"), F.array_max(F.transform(every, lambda m: m["dice"])).alias("best_dice"))


def _template_values() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({i}, {quote(name)}, {quote(text)})" for i, (name, text) in enumerate(TEMPLATES))


def _sql_words(text: str) -> str:
    return (f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")


OP10_SQL = f"""
WITH raw(template, license, body) AS (VALUES {_template_values()}),
tw AS (SELECT template, license, {_sql_words('body')} AS ws FROM raw),
tg AS (SELECT DISTINCT template, license, len(ws) AS wide, ws[i] || ' ' || ws[i + 1] AS gram FROM tw, unnest(range(1, len(ws))) x(i)),
t AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY template) AS n FROM tg),
u AS (SELECT DISTINCT doc_id, unit FROM documents, unnest(list_concat([coalesce(text, '')],
        regexp_split_to_array(coalesce(text, ''), '\n[ \t\r]*\n'), string_split(coalesce(text, ''), chr(10)))) x(unit)),
w AS (SELECT doc_id, unit, {_sql_words('unit')} AS ws FROM u),
g AS (SELECT DISTINCT doc_id, unit, ws[i] || ' ' || ws[i + 1] AS gram FROM w, unnest(range(1, len(ws))) x(i) WHERE len(ws) > 1),
sizes AS (SELECT doc_id, unit, count(*) AS size FROM g GROUP BY ALL),
c AS (SELECT doc_id, unit, template, license, n, count(*) AS hits FROM g JOIN t USING (gram) GROUP BY ALL),
m AS (SELECT doc_id, unit, license, 2.0::DOUBLE * hits / (size + n) AS dice FROM c JOIN sizes USING (doc_id, unit) WHERE 2.0::DOUBLE * hits / (size + n) >= 0.8),
dw AS (SELECT doc_id, {_sql_words("coalesce(text, '')")} AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] AS gram FROM dw, unnest(range(1, len(ws))) x(i) WHERE len(ws) > 1),
h AS MATERIALIZED (SELECT doc_id, i, gram, template, license, wide, n FROM s JOIN t USING (gram)),
hit AS (SELECT a.doc_id, a.template, a.license, a.wide, a.n, a.i, count(DISTINCT b.gram) AS hits
        FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.template = b.template AND b.i BETWEEN a.i AND a.i + a.wide - 2
        GROUP BY ALL HAVING 3 * count(DISTINCT b.gram) >= 2 * a.n),
size_of AS (SELECT doc_id, q.i, wide, count(DISTINCT gram) AS size
            FROM (SELECT DISTINCT doc_id, i, wide FROM hit) q JOIN s b USING (doc_id) WHERE b.i BETWEEN q.i AND q.i + q.wide - 2 GROUP BY ALL),
wm AS (SELECT doc_id, template, license, max(2.0::DOUBLE * hits / (size + n)) AS dice FROM hit JOIN size_of USING (doc_id, i, wide)
       WHERE 2.0::DOUBLE * hits / (size + n) >= 0.8 GROUP BY ALL),
d AS (SELECT doc_id, count(DISTINCT unit) AS n_matched FROM m GROUP BY doc_id),
wd AS (SELECT doc_id, count(*) AS n_windows FROM wm GROUP BY doc_id),
wl AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS window_licenses FROM (SELECT DISTINCT doc_id, license FROM wm) GROUP BY doc_id),
e AS (SELECT doc_id, license, dice FROM m UNION ALL SELECT doc_id, license, dice FROM wm),
b AS (SELECT doc_id, max(dice) AS best FROM e GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses FROM (SELECT DISTINCT doc_id, license FROM e) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_units FROM u GROUP BY doc_id)
SELECT n.doc_id, CAST(n_units AS BIGINT) AS n_units, CAST(coalesce(n_matched, 0) AS BIGINT) AS n_matched,
       CAST(coalesce(n_windows, 0) AS BIGINT) AS n_windows, coalesce(window_licenses, '') AS window_licenses,
       coalesce(licenses, '') AS licenses, best AS best_dice
FROM n LEFT JOIN d ON d.doc_id = n.doc_id LEFT JOIN wd ON wd.doc_id = n.doc_id LEFT JOIN wl ON wl.doc_id = n.doc_id
LEFT JOIN b ON b.doc_id = n.doc_id LEFT JOIN l ON l.doc_id = n.doc_id
"""

def vocabulary_path() -> str:
    """The vocabulary of the registered query; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return bpe.decode(bpe.encode(documents(spark, sf_dir), path), path).select(
        "doc_id", "n_tokens", sha("tokens").alias("ids_sha256"), sha("text").alias("decoded_sha256"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(
        "doc_id", "n_features", "weight", "score", "rank")


def _crc_entries() -> str:
    """The 256 entries of the CRC-32 table, from its polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(str(c))
    return ", ".join(out)


OP12_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
k(k) AS (VALUES (1), (2), (3)),
f AS MATERIALIZED (SELECT r, array_to_string(ws[i:i + k - 1], ' ') AS f, count(*) AS n FROM w, k, unnest(range(1, greatest(len(ws) - k + 2, 1))) t(i) GROUP BY ALL),
fb AS MATERIALIZED (SELECT array_to_string(ws[i:i + k - 1], ' ') AS f, count(*) AS n FROM b, k, unnest(range(1, greatest(len(ws) - k + 2, 1))) t(i) GROUP BY ALL),
crc AS MATERIALIZED (SELECT f, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
         list_transform(range(1, CAST(strlen(f) AS BIGINT) + 1), lambda i: CAST('0x' || substr(hex(f), 2 * i - 1, 2) AS BIGINT))),
         lambda c, x: xor(c >> 8, CAST([{_crc_entries()}][(xor(c, x) & 255) + 1] AS BIGINT)))) % 10000 AS b
        FROM (SELECT f FROM f UNION SELECT f FROM fb)),
s AS (SELECT b, sum(n) AS s FROM f JOIN crc USING (f) GROUP BY b),
t AS (SELECT b, sum(n) AS t FROM fb JOIN crc USING (f) GROUP BY b),
g AS (SELECT x.b, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (coalesce((SELECT sum(s) FROM s), 0) + 10000.0::DOUBLE)
             / ((coalesce(s, 0) + 1.0::DOUBLE) * (coalesce((SELECT sum(t) FROM t), 0) + 10000.0::DOUBLE)))) AS BIGINT) AS gain
      FROM range(10000) x(b) LEFT JOIN s ON s.b = x.b LEFT JOIN t ON t.b = x.b),
weights AS (SELECT r, sum(n) AS n, sum(n * gain) AS weight FROM f JOIN crc USING (f) JOIN g ON g.b = crc.b GROUP BY r),
scored AS (SELECT doc_id, len(ws) >= 20 AS fit, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE)
                    / 4294967296.0::DOUBLE))) AS BIGINT) AS score
           FROM w LEFT JOIN weights ON weights.r = w.r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS place, count(*) OVER (PARTITION BY fit) AS fits FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 5 * fits // 100 THEN CAST(place AS BIGINT) END AS rank FROM ranked
"""


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(documents(spark, sf_dir)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = """
WITH k AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS us,
             list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(key, i, 8) AS BIGINT)) AS h FROM k),
c AS (SELECT doc_id, t, us, len(us) AS n, least(h[1] % (len(us) + 1), h[2] % (len(us) + 1)) AS a, greatest(h[1] % (len(us) + 1), h[2] % (len(us) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                  WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeats": op1_repeats,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_lm": op6_lm,
    "op7_jaccard": op7_jaccard,
    "op8_topk": op8_topk,
    "op9_secrets": op9_secrets,
    "op10_licenses": op10_licenses,
    "op11_bpe": op11_bpe,
    "op12_importance": op12_importance,
    "op13_fim": op13_fim,
}
ORACLE_SQL: dict[str, str] = {
    "op2_warc": OP2_SQL,
    "op4_decontamination": OP4_SQL,
    "op7_jaccard": OP7_SQL,
    "op8_topk": OP8_SQL,
    "op10_licenses": OP10_SQL,
    "op12_importance": OP12_SQL,
    "op13_fim": OP13_SQL,
}
