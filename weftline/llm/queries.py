"""The registered queries of the ten operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import change_points, decontaminate, fingerprint, html_wrapper, jaccard_join, license_scan, lm_score, merkle, packing, secret_scan, suffix_dedup, top_k, toxicity
from .common import checkpointed, table

#: The tokenizer file of the packing query; a path that every executor can read.
TOKENIZER_KEY = "weftline.tokenizer"


def tokenizer_path(spark: SparkSession) -> str:
    got = spark.conf.get(TOKENIZER_KEY, None)
    if got:
        return got
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "overlap.n_words", "overlap.n_hit", F.size("overlap.item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("overlap.item_ids", ","), 256).alias("items_sha256"), decontaminate.contaminated("overlap").alias("contaminated"),
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.add_score(docs, model)
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "toxicity.score", "toxicity.predicted")


def op4_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_wrapper.add_text(pages).select("page_id", "url", "main.text", "main.n_chars")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(spark))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    groups = checkpointed(fingerprint.exact_groups(docs).where("doc_id is not null").groupBy("doc_id", "fingerprint").agg(F.min("group_id").alias("group_id")))
    return fingerprint.compare_with_next(docs).join(groups, ["doc_id", "fingerprint"], "left").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    f = F.col("licenses.found")
    return license_scan.find_licenses(docs).select(
        "doc_id", "licenses.n_blocks", F.size(f).cast("long").alias("n_found"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(f, lambda x: x["license"]))), ",").alias("found"),
        F.array_join(F.transform(f, lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), F.size(x["differences"]).cast("string"))), ",").alias("spans"),
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spell = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    verdict = lambda v: F.size(F.filter("secrets", lambda x: x["verdict"] == v)).cast("long")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(spell(F.filter("secrets", lambda x: x["base"])), 256).alias("base_sha256"),
        spell(F.col("secrets")).alias("spans"), verdict("owned").alias("n_owned"), verdict("example").alias("n_example"), verdict("placeholder").alias("n_placeholder"),
    )


def op11_impact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=even, altered={"text": F.replace("text", F.lit("\n"), F.lit(""))})


def op13_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_points.change_points(table(spark, sf_dir, "sale_lines"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_html_wrapper": op4_html_wrapper,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_pack": op6_pack,
    "op7_fingerprint": op7_fingerprint,
    "op8_license_scan": op8_license_scan,
    "op9_lm_score": op9_lm_score,
    "op10_secret_scan": op10_secret_scan,
    "op11_impact_top_k": op11_impact_top_k,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_change_points": op13_change_points,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op1_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS k
  FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT r, i, dw.n, item FROM dw JOIN win USING (n, k)),
pos AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
""",
}

_BLANKS = r"[^\x20\x09-\x0D]+"
_SETS = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_BLANKS}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a)
"""

ORACLES["op2_jaccard_join"] = _SETS + """
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)
"""

ORACLES["op5_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, h[2 * i + 1:2 * i + 100] AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
first AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT doc_id, i FROM w JOIN first USING (s) WHERE m < doc_id),
runs AS (SELECT doc_id, i, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS new FROM hit)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM runs GROUP BY doc_id, g),
kept AS (SELECT doc_id, a AS place, h[2 * coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1:2 * a] AS piece FROM spans JOIN d USING (doc_id)
  UNION ALL SELECT doc_id, 1000000000000, h[2 * coalesce(z, 0) + 1:] FROM d LEFT JOIN (SELECT doc_id, max(z) AS z FROM spans GROUP BY doc_id) USING (doc_id))
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id) USING (doc_id) JOIN (SELECT doc_id, string_agg(piece, '' ORDER BY place) AS k FROM kept GROUP BY doc_id) USING (doc_id)
"""

ORACLES["op11_impact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


def _field(e: str) -> str:
    return f"coalesce(CAST(strlen(CAST({e} AS VARCHAR)) AS VARCHAR) || ':' || CAST({e} AS VARCHAR), '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


# DuckDB has no crc32: bytes are folded with the polynomial
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295)"

ORACLES["op12_merkle_manifest"] = f"""
WITH RECURSIVE l AS (SELECT doc_id, coalesce('1' || source, '0') AS key, {_leaf_sql("text")} AS leaf,
    CASE WHEN {_CRC} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS changed FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, coalesce(changed, leaf) AS fold FROM l),
t AS (SELECT key, 0 AS lv, p, leaf AS h, count(*) OVER (PARTITION BY key) AS n FROM n
  UNION ALL SELECT key, lv, p, h, count(*) OVER (PARTITION BY key) AS n FROM
    (SELECT key, lv + 1 AS lv, p // 3 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h FROM t WHERE n > 1 GROUP BY key, lv, p // 3)),
s AS (SELECT key, h AS subroot, row_number() OVER (ORDER BY key) - 1 AS p FROM t WHERE n = 1),
u AS (SELECT 0 AS lv, p, subroot AS h, count(*) OVER () AS n FROM s
  UNION ALL SELECT lv, p, h, count(*) OVER () AS n FROM (SELECT lv + 1 AS lv, p // 3 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h FROM u WHERE n > 1 GROUP BY lv, p // 3)),
sides AS (SELECT a.key, a.lv, a.p, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS le, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS ri
  FROM t a JOIN t b ON a.key = b.key AND a.lv = b.lv AND a.p // 3 = b.p // 3 WHERE a.n > 1 GROUP BY a.key, a.lv, a.p),
above AS (SELECT a.lv, a.p, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS le, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS ri
  FROM u a JOIN u b ON a.lv = b.lv AND a.p // 3 = b.p // 3 WHERE a.n > 1 GROUP BY a.lv, a.p),
f AS (SELECT doc_id, leaf, key, p, 0 AS lv, '' AS proof, fold FROM n
  UNION ALL SELECT doc_id, leaf, f.key, f.p // 3, f.lv + 1, proof || le || ri, sha256(le || fold || ri) FROM f JOIN sides x ON f.key = x.key AND f.lv = x.lv AND f.p = x.p),
w AS (SELECT doc_id, leaf, f.key, subroot, proof, fold, s.p FROM f JOIN s USING (key) QUALIFY row_number() OVER (PARTITION BY doc_id, leaf ORDER BY lv DESC) = 1),
g AS (SELECT doc_id, leaf, subroot, p, 0 AS lv, proof, fold FROM w
  UNION ALL SELECT doc_id, leaf, subroot, g.p // 3, g.lv + 1, proof || le || ri, sha256(le || fold || ri) FROM g JOIN above x ON g.lv = x.lv AND g.p = x.p),
last AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, leaf ORDER BY lv DESC) = 1)
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM last, (SELECT h FROM u WHERE n = 1)
"""

_COST = "m * CAST(floor(1000 * ln(CAST(1 + (m * q - s * s) // (m * m) AS DOUBLE))) AS BIGINT)"

ORACLES["op13_change_points"] = f"""
WITH RECURSIVE d AS (SELECT vendor_id, CAST(shipped_at AS DATE) - DATE '1970-01-01' AS day, CAST(sum(quantity) AS BIGINT) AS x
  FROM sale_lines WHERE quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY 1, 2),
e AS (SELECT vendor_id, min(day) AS first, max(day) - min(day) + 1 AS n FROM d GROUP BY vendor_id),
f AS (SELECT e.vendor_id, first, n, i, coalesce(x, 0) AS x FROM (SELECT *, unnest(range(0, n)) AS i FROM e) e LEFT JOIN d ON d.vendor_id IS NOT DISTINCT FROM e.vendor_id AND d.day = first + i),
v AS (SELECT vendor_id, first, n, list_prepend(0::BIGINT, list(a ORDER BY i)) AS a, list_prepend(0::BIGINT, list(b ORDER BY i)) AS b
  FROM (SELECT vendor_id, first, n, i, CAST(sum(x) OVER w AS BIGINT) AS a, CAST(sum(x * x) OVER w AS BIGINT) AS b FROM f WINDOW w AS (PARTITION BY vendor_id ORDER BY i)) GROUP BY vendor_id, first, n),
o AS (SELECT vendor_id, first, n, a, b, 0 AS e, CAST([] AS STRUCT(t BIGINT, k BIGINT, c BIGINT[])[]) AS best FROM v
  UNION ALL SELECT vendor_id, first, n, a, b, e + 1, list_append(best, list_min(list_transform(
      list_filter(range(0, greatest(1, e + 1 - 13)), lambda z: z = 0 OR z >= 14), lambda z: {{'t': z_cost(a, b, z, e + 1) + CASE WHEN z = 0 THEN 0 ELSE 40000 + best[z].t END, 'k': CASE WHEN z = 0 THEN 1 ELSE 1 + best[z].k END, 'c': CASE WHEN z = 0 THEN [0::BIGINT] ELSE list_prepend(z, best[z].c) END}})))
    FROM o WHERE e < n),
r AS (SELECT vendor_id, first, n, a, b, best[n] AS r FROM o WHERE e = n),
g AS (SELECT vendor_id, first, a, b, r, unnest(list_reverse(r.c)) AS z, unnest(list_append(list_reverse(r.c)[2:], n)) AS y, unnest(range(1, r.k + 1)) AS segment_no FROM r)
SELECT vendor_id, CAST(segment_no AS INTEGER) AS segment_no, first + z AS first_day, y - z AS n_days, a[y + 1] - a[z + 1] AS total,
  1 + ((y - z) * (b[y + 1] - b[z + 1]) - (a[y + 1] - a[z + 1]) ** 2::BIGINT) // ((y - z) * (y - z)) AS spread, z_cost(a, b, z, y) AS cost, r.k AS n_segments, r.t AS best_cost FROM g
"""


def _inlined(sql: str) -> str:
    """z_cost(a, b, z, y), the cost of days z to y - 1 by running sums, written out."""
    import re

    def cost(m):
        z, y = m[1], m[2]
        n, s, q = f"({y} - {z})", f"(a[{y} + 1] - a[{z} + 1])", f"(b[{y} + 1] - b[{z} + 1])"
        return f"({n} * CAST(floor(1000 * ln(CAST(1 + ({n} * {q} - {s} * {s}) // ({n} * {n}) AS DOUBLE))) AS BIGINT))"

    return re.sub(r"z_cost\(a, b, (\w+), (\w+(?: \+ 1)?)\)", cost, sql)


ORACLES["op13_change_points"] = _inlined(ORACLES["op13_change_points"]).replace("(a[y + 1] - a[z + 1]) ** 2::BIGINT", "(a[y + 1] - a[z + 1]) * (a[y + 1] - a[z + 1])")
