"""The registered queries over the given tables, each with SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import alignment, crossval, features, graph_query, graph_store, models, profile, trees
from weftline.plans import star_graph
from weftline.session import checkpointed, read
from weftline.sinks import graph_files
from weftline.sources import evaluation_sets, extraction, pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _r(c, digits: int = 6):
    """Doubles are rounded on both sides: engines add in different orders."""
    return F.round(c, digits) + F.lit(0.0)


# --- documents and chunks


@query("SELECT sha256(text) AS file_hash, min(doc_id) AS filename, count(*) AS copies FROM documents GROUP BY 1")
def doc_dedupe(spark, sf):
    return pages.document_rows(read(spark, sf, "documents"))


@query("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'fr')")
def doc_exists_skip(spark, sf):
    d = read(spark, sf, "documents").withColumn("file_hash", F.sha2("text", 256))
    return pages.not_yet_known(d, d.where("lang = 'fr'")).select("doc_id")


_PAGE_SQL = rf"regexp_replace(regexp_replace({X.strip_sql('x')}, '([\p{{L}}\p{{N}}_]+)-\n([\p{{L}}\p{{N}}_]+)', '\1\2', 'g'), '[ \t]+', ' ', 'g')"
# page numbers are those of a text without form feeds, which the tables' texts are
_CHUNK_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, sha256(text) AS h, array_to_string(list_filter(list_transform(string_split(text, chr(12)), lambda x: {_PAGE_SQL}), lambda x: x <> ''), chr(10) || chr(10)) AS t FROM {{docs}}),
cuts(doc_id, h, i, chunk, rest) AS (
  SELECT doc_id, h, -1, '', t FROM d
  UNION ALL SELECT doc_id, h, i + 1, {X.strip_sql("rest[1:cut]")}, regexp_replace(rest[cut + 1:], '^\s+', '') FROM (
    SELECT *, CASE WHEN length(rest) < 1200 THEN length(rest) WHEN blank > 0 THEN CASE WHEN blank = 1199 THEN 1200 ELSE 1199 - blank END WHEN stop > 0 AND stop < 1199 THEN 1199 - stop ELSE 1200 END AS cut
    FROM (SELECT *, instr(reverse(rest[1:1200]), chr(10) || chr(10)) AS blank, instr(reverse(rest[1:1200]), ' .') AS stop FROM cuts WHERE rest <> ''))),
chunks AS (SELECT doc_id, h, h[1:16] || '_' || CAST(i AS VARCHAR) AS id, i, chunk FROM cuts WHERE chunk <> '')
"""


@query(_CHUNK_SQL.replace("{docs}", "documents") + "SELECT DISTINCT id, h AS doc_hash, CAST(i AS INTEGER) AS \"index\", 1 AS page_start, 1 AS page_end, chunk AS text, CAST(doc_id AS VARCHAR) AS filename FROM chunks")
def chunk_documents(spark, sf):
    return pages.chunk_documents(read(spark, sf, "documents"), name_col="doc_id").distinct()


def text_graph(spark, sf) -> dict[str, DataFrame]:
    """documents -> chunks -> offline extraction -> merged graph."""
    docs = read(spark, sf, "documents")
    first = docs.join(pages.document_rows(docs).select(F.col("filename").alias("doc_id")), "doc_id", "left_semi")
    chunks = pages.chunk_documents(first, name_col="doc_id")
    # entities, ends and relations are read off one table: each chunk is extracted once
    answered = checkpointed(extraction.extract(chunks.select("id", "text")).select("id", "answer"))
    entities, relations = extraction.clean(answered)
    order = F.struct("chunk_id", "pos")
    e = graph_store.merge_entities(entities.withColumn("ord", order))
    return {"documents": pages.document_rows(docs), "chunks": chunks, "entities": e, "mentions": graph_store.mentions(entities), "relations": graph_store.resolved(graph_store.merge_relations(relations.withColumn("ord", order)), e)}


_NAMES_SQL = rf"""
, sentences AS (SELECT c.id, k, s FROM (SELECT id, list_filter(string_split_regex(regexp_replace(chunk, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: x <> '') AS ss FROM (SELECT DISTINCT id, chunk FROM chunks)) c, unnest(ss) WITH ORDINALITY AS u(s, k)),
named AS (SELECT id, k, unnest(list_distinct(regexp_extract_all(s, '[^\P{{L}}a-z]\p{{L}}{{3,}}'))) AS name FROM sentences),
kept AS (SELECT id, name, count(*) AS n, {X.canonical_id_sql("name")} AS e FROM named GROUP BY id, name HAVING count(*) > 1),
found_e AS (SELECT id, e, arg_min(name, struct_pack(a := -n, b := name)) AS name FROM kept GROUP BY id, e),
found_r AS (SELECT DISTINCT a.id, ka.e AS src, kb.e AS tgt FROM named a JOIN named b ON a.id = b.id AND a.k = b.k AND a.name < b.name JOIN kept ka ON ka.id = a.id AND ka.name = a.name JOIN kept kb ON kb.id = b.id AND kb.name = b.name WHERE ka.e <> kb.e)
"""


@query(
    _CHUNK_SQL.replace("{docs}", "(SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text)") + _NAMES_SQL
    + ", r AS (SELECT DISTINCT src, tgt FROM found_r), e AS (SELECT e, arg_min(name, id) AS name FROM found_e GROUP BY e), deg AS (SELECT e, count(*) AS n FROM (SELECT src AS e FROM r UNION ALL SELECT tgt FROM r) GROUP BY e) "
    "SELECT name, 'CONCEPT' AS type, CAST(sum(coalesce(n, 0)) AS BIGINT) AS connections FROM e LEFT JOIN deg USING (e) GROUP BY name ORDER BY connections DESC, name LIMIT 10"
)
def text_graph_top(spark, sf):
    t = text_graph(spark, sf)
    return graph_query.top_degree(t["entities"], t["relations"], tasks=star_graph.tasks(spark, sf))


@query(_CHUNK_SQL.replace("{docs}", "documents") + _NAMES_SQL + "SELECT (SELECT count(*) FROM chunks) AS chunks_processed, (SELECT count(*) FROM found_e) AS entities_found, (SELECT count(*) FROM found_r) AS relations_found")
def text_graph_ingest_totals(spark, sf):
    chunks = pages.chunk_documents(read(spark, sf, "documents"), name_col="doc_id")
    answered = checkpointed(extraction.extract(chunks.select("id", "text")).select("id", "answer"))
    e, r = extraction.clean(answered)
    return graph_store.ingest_totals(answered, e, r)


@query("WITH l AS (SELECT sha256(text) AS file_hash, CAST(doc_id AS VARCHAR) AS filename, doc_id, n_chars FROM documents) SELECT file_hash, arg_max(filename, doc_id) AS filename, arg_min(n_chars, doc_id) AS chunks, min(doc_id) AS created_at, CASE WHEN count(*) > 1 THEN max(doc_id) END AS updated_at FROM l GROUP BY file_hash")
def document_merge(spark, sf):
    log = read(spark, sf, "documents").select(F.sha2("text", 256).alias("file_hash"), F.col("doc_id").cast("string").alias("filename"), F.lit(1).alias("pages"), F.col("n_chars").alias("chunks"), F.col("doc_id").alias("at"))
    return graph_store.merge_documents(log).select("file_hash", "filename", "chunks", "created_at", "updated_at")


@query(rf"SELECT doc_id, md5({X.dehyphenate_sql('text')}) AS cleaned FROM documents")
def dehyphenate(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(X.dehyphenate(F.col("text"))).alias("cleaned"))


# --- text rules


@query(f"SELECT DISTINCT md5(p_name) AS of, md5({X.canonical_id_sql('p_name')}) AS id FROM part UNION SELECT DISTINCT md5(text), md5({X.canonical_id_sql('text')}) FROM documents WHERE text IS NOT NULL")
def canonical_ids(spark, sf):
    names = read(spark, sf, "part").select(F.col("p_name").alias("x")).union(read(spark, sf, "documents").select("text").where("text is not null"))
    return names.select(F.md5("x").alias("of"), F.md5(X.canonical_id(F.col("x"))).alias("id")).distinct()


@query(f"SELECT DISTINCT x, {X.relation_type_sql('x')} AS rel FROM (SELECT event_type AS x FROM events UNION SELECT p_type FROM part UNION SELECT o_orderpriority FROM orders UNION SELECT '  founded by! ')")
def relation_types(spark, sf):
    x = read(spark, sf, "events").select(F.col("event_type").alias("x")).union(read(spark, sf, "part").select("p_type")).union(read(spark, sf, "orders").select("o_orderpriority")).union(spark.range(1).select(F.lit("  founded by! "))).distinct()
    return x.select("x", X.relation_type(F.col("x")).alias("rel"))


@query(f"SELECT DISTINCT p_type AS type, {X.label_sql('p_type')} AS label FROM part UNION SELECT o_orderpriority, {X.label_sql('o_orderpriority')} FROM orders")
def labels_of_types(spark, sf):
    t = read(spark, sf, "part").select(F.col("p_type").alias("type")).union(read(spark, sf, "orders").select("o_orderpriority")).distinct()
    return t.select("type", X.label(F.col("type")).alias("label"))


@query(f"SELECT doc_id, md5({X.normalize_sql('text')}) AS norm FROM documents")
def normalize_texts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(X.normalize(F.col("text"))).alias("norm"))


_PREDICATES = "SELECT DISTINCT p_name AS predicate FROM part UNION SELECT DISTINCT event_type FROM events UNION SELECT unnest(['is-a', 'type of', 'causes', 'mitigates', 'has_component', 'uses', 'Part-Of', 'leads to', 'skos:broader', ' are '])"


def _predicates(spark, sf):
    more = spark.createDataFrame([(x,) for x in ("is-a", "type of", "causes", "mitigates", "has_component", "uses", "Part-Of", "leads to", "skos:broader", " are ")], "predicate string")
    return read(spark, sf, "part").select(F.col("p_name").alias("predicate")).union(read(spark, sf, "events").select("event_type")).union(more).distinct()


@query(f"SELECT predicate, {X.category_sql('predicate')} AS category, {X.token_count_sql('predicate')} AS n_tokens FROM ({_PREDICATES})")
def predicate_categories(spark, sf):
    return _predicates(spark, sf).select("predicate", X.category(F.col("predicate")).alias("category"), X.token_count(F.col("predicate")).alias("n_tokens"))


# --- graph store and queries


@query(star_graph.SQL + f"SELECT id, name, type, description, mentions, {X.label_sql('type')} AS label FROM entities")
def entity_merge(spark, sf):
    return star_graph.entities(spark, sf)


@query(star_graph.SQL + "SELECT src, tgt, type, description, weight FROM relations")
def relation_merge(spark, sf):
    return graph_store.merge_relations(star_graph.relation_log(spark, sf))


@query(star_graph.SQL + "SELECT DISTINCT src, tgt, type, chunk_id FROM r_log WHERE src <> tgt AND chunk_id IS NOT NULL")
def relation_chunks(spark, sf):
    return graph_store.relation_chunks(star_graph.relation_log(spark, sf))


@query(star_graph.SQL + "SELECT count(*) AS n FROM relations SEMI JOIN entities a ON src = a.id SEMI JOIN entities b ON tgt = b.id")
def relations_resolved(spark, sf):
    return star_graph.resolved_count(spark, sf)


@query(star_graph.SQL + "SELECT 'documents' AS what, count(*) AS n FROM g_documents UNION ALL SELECT 'chunks', count(*) FROM g_chunks UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'relationships', count(*) FROM relations")
def graph_stats(spark, sf):
    return graph_query.stats(star_graph.tables(spark, sf))


@query(star_graph.SQL + "SELECT type, count(*) AS n FROM entities GROUP BY type")
def type_counts(spark, sf):
    return graph_query.type_counts(star_graph.tables(spark, sf)["entities"])


@query(star_graph.SQL + "SELECT name, type, CAST(sum(coalesce(n, 0)) AS BIGINT) AS connections FROM entities LEFT JOIN degree USING (id) GROUP BY name, type ORDER BY connections DESC, name, type LIMIT 10")
def top_degree(spark, sf):
    t = star_graph.tables(spark, sf)
    return graph_query.top_degree(t["entities"], t["relations"], tasks=star_graph.tasks(spark, sf))


@query(star_graph.SQL + "SELECT id, name, type, description, mentions, coalesce(n, 0) AS connections FROM entities LEFT JOIN degree USING (id) WHERE contains(lower(name), 'na') OR contains(lower(type), 'na') ORDER BY connections DESC, id LIMIT 15")
def entity_search(spark, sf):
    t = star_graph.tables(spark, sf)
    return graph_query.search(t["entities"], t["relations"], " NA ", tasks=star_graph.tasks(spark, sf))


_EDGES = "sub AS (SELECT * FROM relations ORDER BY src, type, tgt LIMIT 150)"


@query(star_graph.SQL + f", {_EDGES} SELECT id, name AS label, type, description AS desc, mentions FROM entities WHERE id IN (SELECT src FROM sub UNION SELECT tgt FROM sub)")
def subgraph_nodes(spark, sf):
    t = star_graph.tables(spark, sf)
    return graph_query.subgraph(t["entities"], t["relations"])[0]


@query(star_graph.SQL + f", {_EDGES} SELECT src AS \"from\", tgt AS \"to\", type AS label, description AS desc FROM sub")
def subgraph_edges(spark, sf):
    t = star_graph.tables(spark, sf)
    return graph_query.subgraph(t["entities"], t["relations"])[1]


@query(star_graph.SQL + ", few AS (SELECT * FROM relations ORDER BY src, type, tgt LIMIT 100) SELECT src, s.name AS src_name, s.type AS src_type, few.type AS relation, tgt, t.name AS tgt_name, t.type AS tgt_type FROM few JOIN entities s ON src = s.id JOIN entities t ON tgt = t.id")
def edge_list(spark, sf):
    t = star_graph.tables(spark, sf)
    return graph_query.edge_list(t["entities"], t["relations"])


@query(star_graph.SQL + "SELECT filename, chunk_id, entity_id, name FROM mentions JOIN g_chunks ON chunk_id = g_chunks.id JOIN g_documents ON doc_hash = file_hash JOIN entities ON entity_id = entities.id")
def provenance_path(spark, sf):
    t = star_graph.tables(spark, sf)
    return graph_query.provenance(t["documents"], t["chunks"], t["mentions"], t["entities"], 2 * star_graph.tasks(spark, sf))


@query(star_graph.SQL + "SELECT a.name AS name_a, r.type AS relation, b.name AS name_b FROM (SELECT src AS i, tgt AS o, type FROM relations UNION ALL SELECT tgt, src, type FROM relations) r JOIN entities a ON i = a.id AND a.type = 'NATION' JOIN entities b ON o = b.id AND b.type = 'CUSTOMER'")
def label_pair_edges(spark, sf):
    t = star_graph.tables(spark, sf)
    return graph_query.between_labels(t["entities"], t["relations"], "NATION", "CUSTOMER", 2 * star_graph.tasks(spark, sf))


@query(star_graph.SQL + ", w AS (SELECT src AS i, tgt AS o, src || tgt || type AS e FROM relations UNION ALL SELECT tgt, src, src || tgt || type FROM relations), s AS (SELECT id FROM entities WHERE type = 'REGION') SELECT id, min(hops) AS hops FROM (SELECT o AS id, 1 AS hops FROM w JOIN s ON i = s.id UNION ALL SELECT b.o, 2 FROM w a JOIN s ON a.i = s.id JOIN w b ON a.o = b.i AND a.e <> b.e) GROUP BY id")
def two_hop(spark, sf):
    t = star_graph.tables(spark, sf)
    return graph_query.within(t["relations"], t["entities"].where("type = 'REGION'"), 2, 2 * star_graph.tasks(spark, sf))


@query(star_graph.SQL + "SELECT other, coalesce(name, other) AS name, r.type, out FROM (SELECT src AS id, tgt AS other, type, true AS out FROM relations UNION ALL SELECT tgt, src, type, false FROM relations) r LEFT JOIN entities e ON other = e.id WHERE r.id = 'nation_' || lower((SELECT min(n_name) FROM nation))")
def node_neighbourhood(spark, sf):
    t = star_graph.tables(spark, sf)
    name = read(spark, sf, "nation").agg(F.min("n_name")).first()[0]
    return graph_query.neighbourhood(t["relations"], t["entities"], f"nation_{name.lower()}")


@query(star_graph.SQL + "SELECT id, name FROM entities WHERE type IN ('NATION', 'REGION') AND (contains(lower(name), 'a') OR contains(lower(description), 'a'))")
def visible_nodes(spark, sf):
    e = star_graph.tables(spark, sf)["entities"].select("id", F.col("name").alias("label"), F.col("description").alias("desc"), "type", "name")
    return graph_query.visible(e, "A", ["NATION", "REGION"]).select("id", "name")


@query(star_graph.SQL + "SELECT name, type, mentions FROM entities ORDER BY mentions DESC, id LIMIT 10")
def catalogue_query(spark, sf):
    return graph_query.run_sql(spark, {"entities": star_graph.tables(spark, sf)["entities"]}, "most_mentioned")


_DOT_NAME = "'n' || md5({})[1:16]"
_DOT_SQL = (
    f", {_EDGES} SELECT 0 AS part, '  ' || {_DOT_NAME.format('id')} || ' [label=\"' || name || '\" fillcolor=\"' || {graph_files.colours_sql('type', 0)} || '\" color=\"' || {graph_files.colours_sql('type', 1)} || '\" fontcolor=\"' || {graph_files.colours_sql('type', 2)} || '\"];' AS line "
    "FROM entities WHERE id IN (SELECT src FROM sub UNION SELECT tgt FROM sub) "
    f"UNION ALL SELECT 1, '  ' || {_DOT_NAME.format('src')} || ' -> ' || {_DOT_NAME.format('tgt')} || ' [label=\"' || lower(replace(type, '_', ' ')) || '\"];' FROM sub SEMI JOIN entities a ON src = a.id SEMI JOIN entities b ON tgt = b.id"
)


@query(star_graph.SQL + _DOT_SQL)
def dot_export(spark, sf):
    t = star_graph.tables(spark, sf)
    return graph_files.dot_lines(*graph_query.subgraph(t["entities"], t["relations"]))


# --- evaluation

_VALUES = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
_TRIPLE_SQL = (
    "WITH p AS (SELECT * FROM (VALUES " + _VALUES([(run, i, *t) for run, ts in evaluation_sets.PREDICTED.items() for i, t in enumerate(ts)]) + ") v(run, idx, subject, predicate, object)), "
    "g AS (SELECT * FROM (VALUES " + _VALUES([(run, i, *t) for run in evaluation_sets.PREDICTED for i, t in enumerate(evaluation_sets.GOLD)]) + ") v(run, idx, subject, predicate, object)) "
)


def _aligned(spark):
    p, g = evaluation_sets.predictions(spark), evaluation_sets.gold(spark)
    return p, g, alignment.align(p, g)


@query(_TRIPLE_SQL + "SELECT p.run, p.idx AS p_idx, g.idx AS g_idx FROM p JOIN g ON p.run = g.run AND lower(p.subject) = lower(g.subject) AND lower(p.predicate) = lower(g.predicate) AND lower(p.object) = lower(g.object)")
def exact_match(spark, sf):
    return alignment.exact_matches(evaluation_sets.predictions(spark), evaluation_sets.gold(spark))


_JA, _JB = (rf"list_distinct(list_filter(string_split_regex({X.normalize_sql(e)}, '\s+'), lambda t: t <> ''))" for e in ("a.p_name", "b.p_name"))


@query(f"WITH n AS (SELECT DISTINCT p_name FROM part), j AS (SELECT a.p_name AS a, b.p_name AS b, round(len(list_intersect({_JA}, {_JB})) / len(list_distinct(list_concat({_JA}, {_JB}))), 6) AS jaccard FROM n a, n b WHERE a.p_name < b.p_name) SELECT * FROM j WHERE jaccard > 0")
def token_jaccard(spark, sf):
    """Pairs of names that share a token; all others have 0."""
    n = read(spark, sf, "part").select("p_name").distinct().select("p_name", F.array_distinct(F.filter(F.split(X.normalize(F.col("p_name")), " "), lambda t: t != "")).alias("t"))
    sized = n.select("p_name", F.size("t").alias("k"), F.explode("t").alias("token"))
    a, b = (sized.select("token", F.col("p_name").alias(x), F.col("k").alias(f"k{x}")) for x in "ab")
    both = a.join(b, "token").where("a < b").groupBy("a", "b", "ka", "kb").agg(F.count(F.lit(1)).alias("same"))
    return both.select("a", "b", _r(F.col("same") / (F.col("ka") + F.col("kb") - F.col("same"))).alias("jaccard"))


# no published prediction matches but exactly (a test holds that against the matcher), so SQL needs the equi-join alone
_MATCH_SQL = _TRIPLE_SQL + ", m AS (SELECT p.run, p.idx AS p_idx, g.idx AS g_idx, p.predicate AS kp, g.predicate AS kg FROM p JOIN g ON p.run = g.run AND lower(p.subject) = lower(g.subject) AND lower(p.predicate) = lower(g.predicate) AND lower(p.object) = lower(g.object)) "
_PRF_SQL = "round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1"
_REPORT_SQL = f", t AS (SELECT run, count(*) AS pred_total, count(*) FILTER ({X.token_count_sql('predicate')} = 1) AS single_predicates, count(*) FILTER ({X.token_count_sql('predicate')} > 1) AS compound_predicates, round(avg({X.token_count_sql('predicate')}), 6) AS avg_predicate_tokens FROM p GROUP BY run), c AS (SELECT t.*, (SELECT count(*) FROM m WHERE m.run = t.run) AS tp, (SELECT count(*) FROM g WHERE g.run = t.run) AS gold_total FROM t), d AS (SELECT *, pred_total - tp AS fp, gold_total - tp AS fn FROM c) "


def _rounded(df: DataFrame) -> DataFrame:
    """All doubles as _r() leaves them."""
    return df.select(*[_r(c).alias(c) if t == "double" else c for c, t in df.dtypes])


@query(_MATCH_SQL + "SELECT run, p_idx, g_idx, 1.0 AS score, 'exact' AS match_type FROM m")
def greedy_alignment(spark, sf):
    return _rounded(_aligned(spark)[2])


@query(_MATCH_SQL + _REPORT_SQL + f"SELECT run, tp, fp, fn, gold_total, pred_total, {_PRF_SQL}, single_predicates, compound_predicates, avg_predicate_tokens FROM d")
def paper_baseline(spark, sf):
    p, g, m = _aligned(spark)
    return _rounded(alignment.report(p, g, m))


#: Triples of parts, predicted and gold: brand by brand, spelt and put in four ways, so that each rung has its matches.
_PART_TRIPLES = {
    "gold": ("lower(concat(p_name, ' ', p_type, ' ', p_brand))", "'is-a'", "concat('size ', p_size, ' part')"),
    "predicted": (
        "CASE p_partkey % 4 WHEN 0 THEN upper(concat(p_name, ' ', p_type, ' ', p_brand)) WHEN 1 THEN concat(p_name, ' ', p_brand) WHEN 2 THEN split_part(p_name, ' ', -1) ELSE concat(p_name, 's ', p_brand, ' ', p_type) END",
        "CASE p_partkey % 4 WHEN 0 THEN 'IS-A' WHEN 1 THEN 'type_of' WHEN 2 THEN 'is a' ELSE CASE WHEN p_size % 5 = 0 THEN 'sold near' ELSE 'subclass of' END END",
        "CASE p_partkey % 3 WHEN 0 THEN concat('size ', p_size, ' part') WHEN 1 THEN concat('Parts, size ', p_size) ELSE 'part' END",
    ),
}


#: Parts of a task.
_PARTS = 100_000


def part_triples(spark: SparkSession, sf: str, side: str) -> DataFrame:
    parts = read(spark, sf, "part")
    # rows are short, so a file of a million is one or two tasks, but their texts are normalised
    parts = parts.repartition(max(spark.sparkContext.defaultParallelism, -(-parts.count() // _PARTS)), "p_partkey")
    return parts.select(F.lit("parts").alias("run"), F.col("p_brand").alias("doc"), F.col("p_partkey").cast("int").alias("idx"), *[F.expr(e).alias(c) for e, c in zip(_PART_TRIPLES[side], alignment.PARTS)])


def _side_sql(side: str) -> str:
    parts = dict(zip(alignment.PARTS, _PART_TRIPLES[side]))
    once = ", ".join(f"{X.normalize_sql(c)} AS n_{c}" for c in parts)
    twice = ", ".join(f"{X.normalize_sql(f'n_{c}')} AS m_{c}" for c in parts)
    keys = " || chr(1) || ".join(f"lower({X.strip_sql(c)})" for c in parts)
    given = ", ".join(f"{e} AS {c}" for c, e in parts.items())
    return f"SELECT *, {twice} FROM (SELECT doc, idx, {keys} AS k, {X.category_sql('predicate')} AS cat, {once} FROM (SELECT p_brand AS doc, CAST(p_partkey AS INTEGER) AS idx, {given} FROM part))"


def _rung_sql(c: str) -> str:
    """The ladder of two elements but for its last rung, spelling, which predicates and objects of parts don't reach."""
    a, b = (rf"list_distinct(list_filter(string_split_regex({s}.m_{c}, '\s+'), lambda t: t <> ''))" for s in "pg")
    both, every = f"len(list_intersect({a}, {b}))", f"len(list_distinct(list_concat({a}, {b})))"
    copulas = ", ".join(f"'{x}'" for x in alignment.COPULAS)
    return f"CASE WHEN p.m_{c} = g.m_{c} OR p.m_{c} IN ({copulas}) AND g.m_{c} IN ({copulas}) THEN 1 WHEN {every} > 0 AND {both} >= 0.5 * {every} THEN {both} / {every} WHEN {both} > 0 AND {both} = least(len({a}), len({b})) THEN 0.85 ELSE 0 END"


#: Ratcliff-Obershelp likeness of pairs (x, y): the longest common piece, the first in x, then in y; then what is left and right of it, and so on.
_RATIO_SQL = """
matched(x, y, a, b, m) AS (SELECT x, y, x, y, 0 FROM spelt
  UNION ALL SELECT x, y, CASE side WHEN 0 THEN a[1:i - 1] ELSE a[i + n:] END, CASE side WHEN 0 THEN b[1:j - 1] ELSE b[j + n:] END, CASE side WHEN 0 THEN n ELSE 0 END
  FROM (SELECT x, y, a, b, -v.i AS i, v.n AS n, instr(b, a[-v.i:-v.i + v.n - 1]) AS j
    FROM (SELECT x, y, a, b, list_max(list_transform(range(1, length(a) + 1), lambda i: struct_pack(n := len(list_filter(range(i, length(a) + 1), lambda k: contains(b, a[i:k]))), i := -i))) AS v FROM matched WHERE a <> '' AND b <> '')
    WHERE v.n > 0), (VALUES (0), (1)) sides(side)),
ratios AS (SELECT x, y, 2 * sum(m) / (length(x) + length(y)) AS ratio FROM matched GROUP BY x, y)
"""

_FUZZY_SQL = f"""
WITH RECURSIVE p AS ({_side_sql("predicted")}), g AS ({_side_sql("gold")}),
rungs AS (SELECT p.doc, p.idx AS p, g.idx AS g, p.k = g.k AS exact, p.n_subject = g.n_subject AND p.n_predicate = g.n_predicate AND p.n_object = g.n_object AS same, p.m_subject AS x, g.m_subject AS y,
  {_rung_sql("subject")} AS s0, {_rung_sql("predicate")} AS q0, {_rung_sql("object")} AS o, p.cat = g.cat AND p.cat <> '{X.OTHER}' AS kindred FROM p JOIN g ON p.doc = g.doc),
spelt AS (SELECT DISTINCT x, y FROM rungs WHERE s0 = 0 AND o >= 0.7 AND 2 * least(length(x), length(y)) >= 0.8 * (length(x) + length(y))),
{_RATIO_SQL},
likes AS (SELECT r.*, CASE WHEN s0 = 0 AND ratio >= 0.8 THEN ratio ELSE s0 END AS s FROM rungs r LEFT JOIN ratios t ON r.x = t.x AND r.y = t.y),
scored AS (SELECT *, CASE WHEN exact OR same THEN 1 WHEN least(s, q, o) >= 0.7 THEN (s + q + o) / 3 END AS score FROM (SELECT *, CASE WHEN q0 < 0.5 AND kindred THEN 0.85 ELSE q0 END AS q FROM likes)),
wants AS (SELECT doc, p, list(struct_pack(late := NOT exact, minus := -round(score, 12), g := g) ORDER BY NOT exact, -round(score, 12), g) AS gs FROM scored WHERE score >= 0.7 GROUP BY doc, p),
queue AS (SELECT doc, list(struct_pack(p := p, gs := gs) ORDER BY p) AS ps FROM wants GROUP BY doc),
walk AS (SELECT doc, ps, 0 AS i, CAST([] AS INTEGER[]) AS used, NULL::INTEGER AS p, NULL::STRUCT(late BOOLEAN, minus DOUBLE, g INTEGER) AS took FROM queue
  UNION ALL SELECT doc, ps, i + 1, CASE WHEN took IS NULL THEN used ELSE list_append(used, took.g) END, p, took
  FROM (SELECT doc, ps, i, used, ps[i + 1].p AS p, list_filter(ps[i + 1].gs, lambda x: NOT list_contains(used, x.g))[1] AS took FROM walk WHERE i < len(ps)))
SELECT 'parts' AS run, doc, p AS p_idx, took.g AS g_idx, round(-took.minus, 6) AS score, CASE WHEN took.late THEN 'normalized' ELSE 'exact' END AS match_type FROM walk WHERE took IS NOT NULL
"""


@query(_FUZZY_SQL)
def fuzzy_alignment(spark, sf):
    return _rounded(alignment.align(part_triples(spark, sf, "predicted"), part_triples(spark, sf, "gold")))


def _by_sql(key: Callable[[str], str], keys: str, every: str) -> str:
    of = lambda side: f"(SELECT run, {key('predicate')} AS k, count(*) AS n FROM {side} GROUP BY 1, 2)"
    return (
        f", ks AS (SELECT run, {key('predicate')} AS k FROM p UNION SELECT run, {key('predicate')} FROM g), "
        f"hits AS (SELECT run, k, count(*) AS tp FROM (SELECT run, p_idx, {key('kp')} AS k FROM m UNION SELECT run, p_idx, {key('kg')} FROM m) GROUP BY 1, 2), "
        f"n AS (SELECT {keys}, coalesce(hits.tp, 0) AS tp, coalesce(a.n, 0) AS pred_count, coalesce(b.n, 0) AS gold_count FROM {every} e LEFT JOIN {of('p')} a USING (run, k) LEFT JOIN {of('g')} b USING (run, k) LEFT JOIN hits USING (run, k)), "
        "d AS (SELECT *, greatest(0, pred_count - tp) AS fp, greatest(0, gold_count - tp) AS fn FROM n) "
    )


@query(_MATCH_SQL + _by_sql(str, "e.run, e.k AS predicate", "ks") + f"SELECT run, predicate, {X.category_sql('predicate')} AS category, tp, fp, fn, gold_count, pred_count, {_PRF_SQL} FROM d")
def predicate_metrics(spark, sf):
    return _rounded(alignment.predicate_report(*_aligned(spark)))


_CATEGORY_ROWS = ", ".join(f"('{c}')" for c in X.CATEGORIES)


@query(_MATCH_SQL + _by_sql(X.category_sql, "e.run, e.k AS category", f"(SELECT run, k FROM (SELECT DISTINCT run FROM p), (VALUES {_CATEGORY_ROWS}) v(k))") + f"SELECT run, category, tp, fp, fn, gold_count, pred_count, {_PRF_SQL} FROM d")
def category_metrics(spark, sf):
    return _rounded(alignment.category_report(*_aligned(spark)))


_ORDER_SQL = ", o AS (SELECT * FROM (VALUES " + _VALUES([(run, i) for i, run in enumerate(evaluation_sets.PREDICTED)]) + ") v(run, position)), r AS (SELECT run, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM d), b AS (SELECT split_part(run, ' ', 1) AS k, arg_max(precision, position) AS bp, arg_max(recall, position) AS br, arg_max(f1, position) AS bf FROM r JOIN o USING (run) GROUP BY 1) "
_DELTA_SQL = "round(precision - bp, 6) + 0.0 AS delta_precision, round(recall - br, 6) + 0.0 AS delta_recall, round(f1 - bf, 6) + 0.0 AS delta_f1"


def _ordered(spark, reports: DataFrame) -> DataFrame:
    return reports.join(spark.createDataFrame([(r, i) for i, r in enumerate(evaluation_sets.PREDICTED)], "run string, position int"), "run")


@query(_MATCH_SQL + _REPORT_SQL + _ORDER_SQL + f"SELECT run, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, {_DELTA_SQL} FROM r JOIN b ON split_part(run, ' ', 1) = k")
def baseline_deltas(spark, sf):
    reports = alignment.report(*_aligned(spark))
    return _rounded(alignment.deltas(reports, _ordered(spark, reports)))


@query(_MATCH_SQL + _REPORT_SQL + _ORDER_SQL + f"SELECT 'Paper' AS type, run, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, NULL::DOUBLE AS delta_precision, NULL::DOUBLE AS delta_recall, NULL::DOUBLE AS delta_f1 FROM r UNION ALL SELECT 'Live', 'KGGen (live)', round(precision, 6), round(recall, 6), round(f1, 6), {_DELTA_SQL} FROM r, b WHERE run LIKE 'G-T2KG%' AND k = 'KGGen'")
def live_and_published(spark, sf):
    """Published reports, and one of a live run, for which the predictions of another system stand."""
    reports = alignment.report(*_aligned(spark))
    live = reports.where(F.col("run").startswith("G-T2KG")).withColumn("run", F.lit("KGGen (live)"))
    return _rounded(alignment.with_baselines(_ordered(spark, reports), live))


_TEXT_SQL = "'(' || {0}.subject || ', ' || {0}.predicate || ', ' || {0}.object || ')'"


@query(_MATCH_SQL + f"SELECT p.run, 'MATCH' AS status, {_TEXT_SQL.format('p')} AS predicted, {_TEXT_SQL.format('g')} AS gold, 'exact (' || {X.category_sql('p.predicate')} || ')' AS mode FROM m JOIN p ON m.run = p.run AND p_idx = p.idx JOIN g ON m.run = g.run AND g_idx = g.idx UNION ALL SELECT run, 'MISSED', '-', {_TEXT_SQL.format('g')}, 'FN (' || {X.category_sql('g.predicate')} || ')' FROM g WHERE NOT EXISTS (FROM m WHERE m.run = g.run AND g_idx = g.idx) UNION ALL SELECT run, 'EXTRA', {_TEXT_SQL.format('p')}, '-', 'FP (' || {X.category_sql('p.predicate')} || ')' FROM p WHERE NOT EXISTS (FROM m WHERE m.run = p.run AND p_idx = p.idx)")
def alignment_details(spark, sf):
    return alignment.details(*_aligned(spark))


@query(_MATCH_SQL + f", d AS (SELECT 'all' AS run, (SELECT count(*) FROM m) AS tp, (SELECT count(*) FROM p) AS pred_total, (SELECT count(*) FROM g) AS gold_total), e AS (SELECT *, pred_total - tp AS fp, gold_total - tp AS fn FROM d) SELECT run, tp, fp, fn, {_PRF_SQL} FROM e")
def many_documents(spark, sf):
    """One run over several documents, for which the published runs stand: triples meet within their document only."""
    one = lambda df: df.withColumn("doc", F.col("run")).withColumn("run", F.lit("all"))
    p, g = one(evaluation_sets.predictions(spark)), one(evaluation_sets.gold(spark))
    return _rounded(alignment.report(p, g, alignment.assign(alignment.candidates(p, g))).select("run", "tp", "fp", "fn", "precision", "recall", "f1"))


def judge(prompt: str) -> str:
    """A judge that gives one gold triple away twice, and one that there isn't."""
    return '[{"predicted_id": 0, "gold_id": 2, "confidence": 0.5}, {"predicted_id": 1, "gold_id": 2}, {"predicted_id": 1, "gold_id": 99}]'


@query(_TRIPLE_SQL + "SELECT DISTINCT run, 0 AS p_idx, 2 AS g_idx, 0.5 AS confidence FROM p")
def semantic_judge(spark, sf):
    return alignment.semantic_pairs(evaluation_sets.predictions(spark), evaluation_sets.gold(spark), judge)


@query("SELECT * FROM (VALUES ('r', 0, 'A', 'is a', 'B'), ('r', 2, ' ', 'x', 'C')) v(run, idx, subject, predicate, object) WHERE idx = 0 UNION ALL SELECT 'r', 2, '', 'x', 'C'")
def answered_triples(spark, sf):
    answer = '{"triples": [{"subject": " A ", "predicate": "Is A", "object": "B"}, {"subject": "", "predicate": "x", "object": "C"}, {"subject": " ", "predicate": "x", "object": "C"}]}'
    return evaluation_sets.answered_triples(spark.createDataFrame([("r", answer)], "run string, answer string"))


@query(_TRIPLE_SQL + f"SELECT run, count(*) AS n, count(*) FILTER ({X.token_count_sql('predicate')} = 1) AS single_predicates, count(*) FILTER ({X.token_count_sql('predicate')} > 1) AS compound_predicates, round(avg({X.token_count_sql('predicate')}), 6) AS avg_tokens FROM p GROUP BY run")
def complexity(spark, sf):
    n = X.token_count(F.col("predicate"))
    return evaluation_sets.predictions(spark).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count_if(n == 1).alias("single_predicates"), F.count_if(n > 1).alias("compound_predicates"), _r(F.avg(n)).alias("avg_tokens"))


@query("SELECT lang, count(*) FILTER (toxic = 1 AND quality = 0) AS tp, round(CASE WHEN count(*) FILTER (quality = 0) = 0 THEN 0 ELSE count(*) FILTER (toxic = 1 AND quality = 0) / count(*) FILTER (quality = 0) END, 6) AS precision, round(CASE WHEN count(*) FILTER (toxic = 1) = 0 THEN 0 ELSE count(*) FILTER (toxic = 1 AND quality = 0) / count(*) FILTER (toxic = 1) END, 6) AS recall FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def metrics_prf(spark, sf):
    d = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    m = models.binary_metrics(d, "toxic", 1 - F.col("quality"), "lang")
    return m.select("lang", "tp", _r("precision").alias("precision"), _r("recall").alias("recall"))


# --- profiles

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, max({c}) AS max FROM lineitem" for c in _NUM))
def describe(spark, sf):
    d = profile.describe(read(spark, sf, "lineitem"), _NUM)
    return d.select("column", "count", *[_r(c, 4).alias(c) for c in ("mean", "std")], "min", *[_r(c, 4).alias(c) for c in ("q25", "q50", "q75")], "max")


@query("WITH v AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, CAST(sum(n) AS BIGINT) AS count, count(*) AS unique, arg_min(p_name, struct_pack(n := -n, v := p_name)) AS top, max(n) AS freq FROM v GROUP BY p_brand")
def describe_text(spark, sf):
    return profile.describe_text(read(spark, sf, "part"), "p_brand", "p_name")


_PARTLY = "SELECT event_id, user_id, nullif(event_type, 'click') AS event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events"


def _partly(spark, sf):
    e = read(spark, sf, "events")
    return e.select("event_id", "user_id", F.nullif("event_type", F.lit("click")).alias("event_type"), F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")).alias("value"))


@query(f"WITH t AS ({_PARTLY}) SELECT unnest(['event_id', 'event_type', 'value']) AS \"column\", unnest([count(*) - count(event_id), count(*) - count(event_type), count(*) - count(value)]) AS nulls FROM t")
def null_counts(spark, sf):
    return profile.null_counts(_partly(spark, sf), ["event_id", "event_type", "value"])


@query(f"WITH t AS ({_PARTLY}), n AS (SELECT unnest(['event_id', 'event_type', 'value']) AS \"column\", unnest([count(*) - count(event_id), count(*) - count(event_type), count(*) - count(value)]) AS nulls FROM t) SELECT \"column\" FROM n WHERE nulls > 0")
def columns_with_nulls(spark, sf):
    return profile.columns_with_nulls(_partly(spark, sf), ["event_id", "event_type", "value"])


@query(f"WITH t AS ({_PARTLY}) SELECT unnest(['user_id', 'event_type', 'value']) AS \"column\", unnest([count(DISTINCT user_id), count(DISTINCT event_type), count(DISTINCT value)]) AS distinct_values FROM t")
def nunique(spark, sf):
    return profile.distinct_counts(_partly(spark, sf), ["user_id", "event_type", "value"])


@query("SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type")
def value_counts(spark, sf):
    return profile.value_counts(read(spark, sf, "events"), "event_type").withColumn("share", _r("share"))


@query("SELECT event_type, round(avg(length(props)), 6) AS mean_length FROM events GROUP BY event_type")
def group_mean(spark, sf):
    return profile.group_mean(read(spark, sf, "events"), "event_type", F.length("props"), "mean_length").withColumn("mean_length", _r("mean_length"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for i, a in enumerate(_NUM) for b in _NUM[i:]))
def corr_matrix(spark, sf):
    return profile.correlations(read(spark, sf, "lineitem"), _NUM).withColumn("corr", _r("corr"))


@query("WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, lo, (hi - lo) / 10 AS w FROM lineitem, e) SELECT bin, round(min(lo + bin * w), 4) AS low, count(*) AS n FROM b GROUP BY bin")
def histogram(spark, sf):
    return profile.histogram(read(spark, sf, "lineitem"), "l_extendedprice").withColumn("low", _r("low", 4))


@query("SELECT l_returnflag, l_linestatus, min(l_extendedprice) AS least, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, max(l_extendedprice) AS greatest, count(*) AS n FROM lineitem GROUP BY 1, 2")
def boxplot(spark, sf):
    b = profile.boxplot(read(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return b.select("l_returnflag", "l_linestatus", "least", *[_r(c, 4).alias(c) for c in ("q25", "q50", "q75")], "greatest", "n")


@query("SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def shape(spark, sf):
    return profile.shape(read(spark, sf, "lineitem"))


@query("SELECT * EXCLUDE (k), CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('0:' || CAST(doc_id AS VARCHAR)), doc_id) AS k FROM labels) WHERE k <= 5")
def sample_per_group(spark, sf):
    return profile.sample_per_group(read(spark, sf, "labels"), "quality", "doc_id")


# --- features


@query(f"WITH t AS ({_PARTLY}) SELECT event_id, coalesce(event_type, 'none') AS event_type, coalesce(value, 0) AS value FROM t")
def fill_const(spark, sf):
    return features.fill_const(_partly(spark, sf), {"event_type": "none", "value": 0.0}).select("event_id", "event_type", "value")


@query(f"WITH t AS ({_PARTLY}) SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM t)), 6) AS value FROM t")
def fill_mean(spark, sf):
    return features.fill(_partly(spark, sf), {"value": "mean"}).select("event_id", _r("value").alias("value"))


@query(f"WITH t AS ({_PARTLY}) SELECT event_id, round(coalesce(value, (SELECT median(value) FROM t WHERE event_id % 5 <> 0)), 6) AS value FROM t WHERE event_id % 5 = 0")
def fill_median_of_train(spark, sf):
    t = _partly(spark, sf)
    return features.fill(t.where("event_id % 5 = 0"), {"value": "median"}, t.where("event_id % 5 <> 0")).select("event_id", _r("value").alias("value"))


@query(f"WITH t AS ({_PARTLY}), m AS (SELECT event_type FROM t WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1) SELECT event_id, coalesce(event_type, (SELECT event_type FROM m)) AS event_type FROM t")
def fill_mode(spark, sf):
    return features.fill(_partly(spark, sf), {"event_type": "mode"}).select("event_id", "event_type")


@query(f"WITH t AS ({_PARTLY}) SELECT event_id FROM t WHERE event_type IS NOT NULL AND value IS NOT NULL")
def drop_nulls(spark, sf):
    return features.drop_nulls(_partly(spark, sf), ["event_type", "value"]).select("event_id")


@query("SELECT o_orderkey, " + ", ".join(f"CAST(o_orderstatus = '{s}' AS INTEGER) AS o_orderstatus_{s}" for s in "OP") + " FROM orders")
def one_hot(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return features.one_hot(o, ["o_orderstatus"], drop="first")


@query("SELECT p_partkey, round((p_size - (SELECT min(p_size) FROM part)) / (SELECT CAST(max(p_size) - min(p_size) AS DOUBLE) FROM part), 6) AS p_size, round((p_retailprice - (SELECT min(p_retailprice) FROM part)) / (SELECT max(p_retailprice) - min(p_retailprice) FROM part), 6) AS p_retailprice FROM part")
def min_max(spark, sf):
    p = features.min_max(read(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return p.select("p_partkey", _r("p_size").alias("p_size"), _r("p_retailprice").alias("p_retailprice"))


@query("SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 5) AS p_retailprice FROM part")
def standardize(spark, sf):
    return features.standardize(read(spark, sf, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"]).withColumn("p_retailprice", _r("p_retailprice", 5))


@query("SELECT doc_id % 10 < 3 AS test, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def holdout_sizes(spark, sf):
    d = read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels").select("doc_id"), "doc_id")
    return d.groupBy((features.fold(F.col("doc_id"), 10) < 3).alias("test")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH f AS (SELECT quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels) SELECT quality, fold, count(*) AS n FROM f GROUP BY 1, 2")
def stratified_folds(spark, sf):
    f = features.stratified_folds(read(spark, sf, "labels"), "quality", "doc_id", 5)
    return f.groupBy("quality", "fold").agg(F.count(F.lit(1)).alias("n"))


_PERCENT = "CAST('0x' || md5('{seed}:' || CAST({key} AS VARCHAR))[1:8] AS BIGINT) % 100"


@query(f"SELECT doc_id, {_PERCENT.format(seed=42, key='doc_id')} < 30 AS test FROM documents")
def hash_split(spark, sf):
    train, test = features.split(read(spark, sf, "documents").select("doc_id"), "doc_id", 30, seed=42)
    return train.select("doc_id", F.lit(False).alias("test")).unionByName(test.select("doc_id", F.lit(True).alias("test")))


# --- models

_OLS = "SELECT {} FROM (SELECT count(*) n, regr_slope(p_retailprice, p_size) s, regr_intercept(p_retailprice, p_size) i, regr_r2(p_retailprice, p_size) r FROM part)"


@query(_OLS.format("round(s, 5) AS slope, round(i, 4) AS intercept, round(r, 6) AS r2, round(1 - (1 - r) * (n - 1) / (n - 2), 6) AS adjusted_r2"))
def ols_simple(spark, sf):
    m = models.ols(read(spark, sf, "part"), ["p_size"], "p_retailprice")
    return spark.createDataFrame([(round(float(m.coefficients[0]), 5), round(m.intercept, 4), round(float(m.r2), 6), round(float(m.adjusted_r2), 6))], "slope double, intercept double, r2 double, adjusted_r2 double")




def _two(table: str, x: str, z: str, y: str) -> str:
    """Least squares of y on x and z by their covariances: a and b, and the constant i."""
    c = {f"{p}{q}": f"covar_pop({u}, {v})" for p, u in (("x", x), ("z", z), ("y", y)) for q, v in (("x", x), ("z", z), ("y", y))}
    return f"WITH c AS (SELECT {', '.join(f'{e} AS {k}' for k, e in c.items())}, avg({x}) mx, avg({z}) mz, avg({y}) my FROM {table}), w AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS a, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b FROM c), f AS (SELECT a, b, my - a * mx - b * mz AS i FROM w) "


_TWO = _two("part", "p_size", "p_partkey", "p_retailprice")


@query(_TWO + "SELECT round(a, 4) AS p_size, round(b, 5) AS p_partkey, round(i, 3) AS intercept FROM f")
def ols_two_features(spark, sf):
    m = models.ols(read(spark, sf, "part"), ["p_size", "p_partkey"], "p_retailprice")
    return spark.createDataFrame([(round(float(m.coefficients[0]), 4), round(float(m.coefficients[1]), 5), round(m.intercept, 3))], "p_size double, p_partkey double, intercept double")


@query(_TWO + "SELECT p.p_partkey, round(p_retailprice - (i + a * p_size + b * p_partkey), 3) + 0.0 AS residual FROM part p, f")
def residuals(spark, sf):
    p = read(spark, sf, "part")
    m = models.ols(p, ["p_size", "p_partkey"], "p_retailprice")
    return p.select("p_partkey", _r(F.col("p_retailprice") - m.predict(), 3).alias("residual"))


@query(_TWO + ", e AS (SELECT p_retailprice AS y, p_retailprice - (i + a * p_size + b * p_partkey) AS e FROM part, f) SELECT round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(e)), 4) AS mae, round(avg(e * e), 3) AS mse, round(sqrt(avg(e * e)), 4) AS rmse FROM e")
def regression_metrics(spark, sf):
    p = read(spark, sf, "part")
    m = models.ols(p, ["p_size", "p_partkey"], "p_retailprice")
    r = models.regression_metrics(p.withColumn("guess", m.predict()), "p_retailprice", "guess")
    return r.select(_r("r2").alias("r2"), _r("mae", 4).alias("mae"), _r("mse", 3).alias("mse"), _r("rmse", 4).alias("rmse"))


_V = "sum(p_size * p_size) xx, sum(p_size * p_retailprice) xz, sum(p_retailprice * p_retailprice) zz"


@query(f"SELECT unnest(['p_retailprice', 'p_size']) AS feature, round(1 / (1 - xz * xz / (xx * zz)), 5) AS vif FROM (SELECT {_V} FROM part)")
def vif(spark, sf):
    got = models.vif(read(spark, sf, "part"), ["p_size", "p_retailprice"])
    return spark.createDataFrame([(k, round(v, 5)) for k, v in got.items()], "feature string, vif double")


@query("WITH c AS (SELECT covar_pop(p_size, p_retailprice) * count(*) AS xy, var_pop(p_size) * count(*) AS xx, avg(p_size) AS mx, avg(p_retailprice) AS my FROM part) SELECT alpha, round(xy / (xx + alpha), 5) AS slope, round(my - xy / (xx + alpha) * mx, 4) AS intercept FROM c, (SELECT unnest([1.0, 10.0, 100.0, 200.0]::DOUBLE[]) AS alpha)")
def ridge_path(spark, sf):
    p = read(spark, sf, "part")
    rows = []
    for a in (1.0, 10.0, 100.0, 200.0):
        w, b = models.ridge(p, ["p_size"], "p_retailprice", a)
        rows.append((a, round(float(w[0]), 5), round(b, 4)))
    return spark.createDataFrame(rows, "alpha double, slope double, intercept double")


_SOFT = "sign({0}) * greatest(abs({0}) - alpha, 0)"


@query(
    "WITH RECURSIVE s AS (SELECT (p_partkey - (SELECT avg(p_partkey) FROM part)) / (SELECT stddev_pop(p_partkey) FROM part) AS x, (p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part) AS z, p_retailprice AS y FROM part), "
    "c AS (SELECT covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM s), "
    "w(alpha, i, a, b) AS (SELECT alpha, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM (SELECT unnest([1.0, 10.0, 100.0, 200.0]::DOUBLE[]) AS alpha) "
    f"UNION ALL SELECT alpha, i + 1, a, {_SOFT.format('(zy - xz * a)')} FROM (SELECT alpha, i, b, xz, zy, {_SOFT.format('(xy - xz * b)')} AS a FROM w, c WHERE i < 100)) "
    "SELECT alpha, round(a, 2) + 0.0 AS p_partkey, round(b, 2) + 0.0 AS p_size, CAST(a = 0 AS BIGINT) + CAST(b = 0 AS BIGINT) AS zeros FROM w WHERE i = 100"
)
def lasso_path(spark, sf):
    p = features.standardize(read(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_partkey", "p_size"])
    rows = []
    for a in (1.0, 10.0, 100.0, 200.0):
        m = models.lasso(p, ["p_partkey", "p_size"], "p_retailprice", a)
        rows.append((a, *[round(float(c), 2) + 0.0 for c in m.coefficients], sum(1 for c in m.coefficients if c == 0)))
    return spark.createDataFrame(rows, "alpha double, p_partkey double, p_size double, zeros long")


def _scored(spark, sf):
    e = read(spark, sf, "events")
    return e.select("event_id", (F.col("event_type") == "purchase").cast("int").alias("y"), F.least(F.lit(1.0), F.col("value") / 100).alias("score"))


_SCORED = "SELECT event_id, CAST(event_type = 'purchase' AS INTEGER) AS y, least(1.0, value / 100) AS score FROM events"


@query(
    f"WITH RECURSIVE s AS ({_SCORED}), w(i, w, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL "
    "SELECT i + 1, w - (hbb * gw - hwb * gb) / (hww * hbb - hwb * hwb), b - (hww * gb - hwb * gw) / (hww * hbb - hwb * hwb) FROM ("
    "SELECT i, w, b, sum((p - y) * score) + w AS gw, sum(p - y) AS gb, sum(p * (1 - p) * score * score) + 1 AS hww, sum(p * (1 - p) * score) AS hwb, sum(p * (1 - p)) AS hbb "
    "FROM (SELECT i, w, b, score, y, 1 / (1 + exp(-(w * score + b))) AS p FROM w, s WHERE i < 12) GROUP BY i, w, b)) "
    "SELECT 'score' AS feature, round(w, 3) AS coefficient, round(b, 3) AS intercept, round(exp(w), 3) AS odds_ratio FROM w WHERE i = 12"
)
def logistic_fit(spark, sf):
    s = _scored(spark, sf)
    m = models.logistic(s, ["score"], "y")
    made = spark.createDataFrame([("score", float(m.coefficients[0]), float(m.intercept))], "feature string, coefficient double, intercept double").withColumn("odds_ratio", F.exp("coefficient"))
    return made.select("feature", *[_r(c, 3).alias(c) for c in ("coefficient", "intercept", "odds_ratio")])


@query(f"WITH s AS ({_SCORED}) SELECT y AS label, count(*) FILTER (score < 0.5) AS predicted_0, count(*) FILTER (score >= 0.5) AS predicted_1 FROM s GROUP BY y")
def confusion(spark, sf):
    return models.confusion(_scored(spark, sf).withColumn("guess", (F.col("score") >= 0.5).cast("int")), "y", "guess")


_RATES = "count(*) FILTER (y = 1 AND score >= t) AS tp, count(*) FILTER (y = 0 AND score >= t) AS fp, count(*) FILTER (y = 1 AND score < t) AS fn, count(*) FILTER (y = 0 AND score < t) AS tn"


@query(f"WITH s AS ({_SCORED}), c AS (SELECT t AS threshold, {_RATES} FROM s, (SELECT unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS t) GROUP BY t), r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS q FROM c) SELECT threshold, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END, 6) AS f1 FROM r")
def threshold_sweep(spark, sf):
    m = models.threshold_sweep(_scored(spark, sf), "y", "score")
    return m.select("threshold", "tp", "fp", "fn", "tn", *[_r(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(f"WITH s AS ({_SCORED}), a AS (SELECT score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM s GROUP BY score), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM a) SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM b")
def roc_auc(spark, sf):
    return models.roc_auc(_scored(spark, sf), "y", "score").select(_r("auc").alias("auc"))


_TOKENS = r"WITH t AS (SELECT doc_id, quality, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS word FROM documents JOIN labels USING (doc_id)), c AS (SELECT quality, word, count(*) AS n FROM t GROUP BY 1, 2)"


def _tokens(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "text").join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return features.word_counts(d, "doc_id", "text", "quality")


@query(_TOKENS + ", z AS (SELECT quality, sum(n) AS total FROM c GROUP BY quality), v AS (SELECT count(DISTINCT word) AS v FROM c), w AS (SELECT DISTINCT word FROM c) SELECT quality, word, round(ln((coalesce(n, 0) + 1) / (total + v)), 5) AS log_prob FROM w CROSS JOIN z CROSS JOIN v LEFT JOIN c USING (quality, word)")
def nb_text(spark, sf):
    return models.multinomial_nb(_tokens(spark, sf), "quality").withColumn("log_prob", _r("log_prob", 5))


@query(_TOKENS + ", z AS (SELECT quality, sum(n) AS total FROM c GROUP BY quality), v AS (SELECT count(DISTINCT word) AS v FROM c), p AS (SELECT word, coalesce(max(n) FILTER (quality = 0), 0) AS n0, coalesce(max(n) FILTER (quality = 1), 0) AS n1 FROM c GROUP BY word) SELECT word, round(ln((n0 + 1) / ((SELECT total FROM z WHERE quality = 0) + v)) - ln((n1 + 1) / ((SELECT total FROM z WHERE quality = 1) + v)), 5) AS log_ratio FROM p, v ORDER BY log_ratio DESC, word LIMIT 10")
def nb_top_words(spark, sf):
    nb = models.multinomial_nb(_tokens(spark, sf), "quality")
    r = nb.groupBy("word").agg(F.sum(F.when(F.col("quality") == 0, F.col("log_prob")).otherwise(-F.col("log_prob"))).alias("log_ratio"))
    return r.select("word", _r("log_ratio", 5).alias("log_ratio")).orderBy(F.desc("log_ratio"), "word").limit(10)


@query(_TOKENS + ", q AS (SELECT doc_id, word, count(*) AS n FROM t GROUP BY 1, 2), d AS (SELECT word, count(*) AS df FROM q GROUP BY word), x AS (SELECT doc_id, word, n * (ln((1.0 + (SELECT count(*) FROM labels)) / (1.0 + df)) + 1) AS w FROM q JOIN d USING (word)), m AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY doc_id) SELECT doc_id, word, round(w / norm, 5) AS tfidf FROM x JOIN m USING (doc_id)")
def tf_idf(spark, sf):
    n = read(spark, sf, "labels").count()
    return features.tf_idf(_tokens(spark, sf).select("doc_id", "word", "n"), "doc_id", n).withColumn("tfidf", _r("tfidf", 5))


def _vectors(spark, sf):
    """The elements of each vector as columns."""
    e = read(spark, sf, "embeddings")
    k = e.agg(F.max(F.size("embedding"))).first()[0]
    return e.select("vec_id", F.col("label").cast("double").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(k)]), [f"x{i}" for i in range(k)]


@query("SELECT CAST(label AS DOUBLE) AS label, 'x' || CAST(i - 1 AS VARCHAR) AS feature, round(avg(CAST(embedding[i] AS DOUBLE)), 5) AS mean FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i")
def gaussian_nb_means(spark, sf):
    v, cols = _vectors(spark, sf)
    m = models.gaussian_nb(v, cols, "label")
    theta = m.theta.toArray()
    return spark.createDataFrame([(float(label), c, round(float(theta[i, j]), 5)) for i, label in enumerate(range(theta.shape[0])) for j, c in enumerate(cols)], "label double, feature string, mean double")


#: Grows the trees of all folds at once, a level a step; rows of the fold that is left out go along without being counted.
_TREE_SQL = """
WITH RECURSIVE f AS (SELECT vec_id, CAST(label AS DOUBLE) AS label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 3 AS fold FROM embeddings),
melt AS (SELECT vec_id, unnest(range(len(embedding))) AS f, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
w(k, vec_id, label, train, node, told) AS (
  SELECT k, vec_id, label, fold <> k, '', NULL::DOUBLE FROM f, (SELECT unnest(range(3)) AS k)
  UNION ALL SELECT o.k, o.vec_id, o.label, o.train, o.node || CASE WHEN b.s IS NULL THEN '' WHEN x.v <= b.s.t THEN 'l' ELSE 'r' END, CASE WHEN b.s IS NULL THEN n.common END
  FROM (SELECT * FROM w WHERE told IS NULL) o
  JOIN (SELECT k, node, arg_min(label, struct_pack(a := -n, b := label)) AS common FROM (SELECT k, node, label, count(*) AS n FROM w WHERE train AND told IS NULL GROUP BY ALL) GROUP BY k, node) n ON o.k = n.k AND o.node = n.node
  LEFT JOIN (
    SELECT k, node, arg_min(struct_pack(f := f, t := CASE WHEN v / 2 + after / 2 >= after THEN v ELSE v / 2 + after / 2 END), struct_pack(a := -score, b := f, c := v)) AS s
    FROM (SELECT k, node, f, v, lead(v) OVER (PARTITION BY k, node, f ORDER BY v) AS after, sum(l * l) / sum(l) + sum((n - l) * (n - l)) / nullif(sum(n - l), 0) AS score, count(*) AS classes
      FROM (SELECT g.k, g.node, g.f, g.v, t.n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.k, g.node, g.f, t.label ORDER BY g.v) AS l
        FROM (SELECT DISTINCT w.k, w.node, m.f, m.v FROM w JOIN melt m USING (vec_id) WHERE w.train AND told IS NULL) g
        JOIN (SELECT k, node, label, count(*) AS n FROM w WHERE train AND told IS NULL GROUP BY ALL) t ON g.k = t.k AND g.node = t.node
        LEFT JOIN (SELECT w.k, w.node, w.label, m.f, m.v, count(*) AS n FROM w JOIN melt m USING (vec_id) WHERE w.train AND told IS NULL GROUP BY ALL) c ON g.k = c.k AND g.node = c.node AND g.f = c.f AND g.v = c.v AND t.label = c.label)
      GROUP BY k, node, f, v)
    WHERE after IS NOT NULL AND classes > 1 GROUP BY k, node) b ON o.k = b.k AND o.node = b.node
  LEFT JOIN melt x ON x.vec_id = o.vec_id AND x.f = b.s.f)
SELECT CAST(k AS INTEGER) AS fold, round(avg(CAST(told = label AS INTEGER)), 6) AS accuracy FROM w WHERE told IS NOT NULL AND NOT train GROUP BY k
"""


@query(_TREE_SQL)
def tree_cross_validation(spark, sf):
    v, cols = _vectors(spark, sf)
    folded = features.stratified_folds(v, "label", "vec_id", 3)

    def fit(train):
        model = trees.exact_tree(train, cols, "label")
        return lambda test: crossval.accuracy(model.transform(test), "label")

    got = crossval.cross_validate(folded, 3, fit)
    return spark.createDataFrame([(i, round(float(s), 6)) for i, s in enumerate(got["scores"])], "fold int, accuracy double")


_TRAINED = _TOKENS.replace("c AS (SELECT quality, word, count(*) AS n FROM t GROUP BY 1, 2)", "c AS (SELECT quality, word, count(*) AS n FROM t WHERE doc_id % 5 <> 0 GROUP BY 1, 2)")


@query(
    _TRAINED + ", z AS (SELECT quality, count(*) AS docs, (SELECT coalesce(sum(n), 0) FROM c WHERE c.quality = l.quality) AS total FROM labels l JOIN documents USING (doc_id) WHERE doc_id % 5 <> 0 GROUP BY quality), v AS (SELECT count(DISTINCT word) AS v FROM c), w AS (SELECT DISTINCT word FROM c), "
    "p AS (SELECT quality, word, ln((coalesce(n, 0) + 1) / (total + v)) AS lp FROM w CROSS JOIN z CROSS JOIN v LEFT JOIN c USING (quality, word)), "
    "j AS (SELECT doc_id, p.quality, sum(lp) AS ll FROM t JOIN p USING (word) GROUP BY 1, 2), "
    "s AS (SELECT l.doc_id, z.quality, ln(docs / (SELECT sum(docs) FROM z)) + coalesce(ll, 0) AS ll FROM (SELECT doc_id FROM labels JOIN documents USING (doc_id)) l CROSS JOIN z LEFT JOIN j ON j.doc_id = l.doc_id AND j.quality = z.quality) "
    "SELECT doc_id, arg_min(quality, struct_pack(a := -ll, b := quality)) AS prediction, round(1 / (1 + exp(max(ll) FILTER (quality = 0) - max(ll) FILTER (quality = 1))), 6) AS p_1 FROM s GROUP BY doc_id"
)
def nb_predictions(spark, sf):
    """Quality of every labelled document by its words, learned from four fifths of them."""
    counts = _tokens(spark, sf)
    labels = read(spark, sf, "labels").select("doc_id", "quality").join(read(spark, sf, "documents").select("doc_id"), "doc_id")
    model = models.text_bayes(counts.where("doc_id % 5 <> 0"), labels.where("doc_id % 5 <> 0"), "quality")
    made = model.predict(counts.select("doc_id", "word", "n"), labels.select("doc_id"), "doc_id")
    return made.select("doc_id", "prediction", _r(F.col("probability")[1]).alias("p_1"))


@query(_TOKENS + " SELECT word, row_number() OVER (ORDER BY word) - 1 AS id FROM (SELECT DISTINCT word FROM c)")
def vocabulary(spark, sf):
    return features.vocabulary(_tokens(spark, sf))


@query(_TOKENS + ", v AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS id FROM (SELECT DISTINCT word FROM c)), q AS (SELECT doc_id, word, count(*) AS n FROM t GROUP BY 1, 2) SELECT doc_id, count(*) AS n_words, md5(string_agg(id || ':' || n, ',' ORDER BY id)) AS entries FROM q JOIN v USING (word) GROUP BY doc_id")
def count_vectors(spark, sf):
    counts = _tokens(spark, sf)
    v = features.count_vectors(counts.select("doc_id", "word", "n"), "doc_id", features.vocabulary(counts))
    entries = F.array_join(F.zip_with("ids", "counts", lambda i, n: F.concat_ws(":", i.cast("string"), n.cast("string"))), ",")
    return v.select("doc_id", F.size("ids").cast("long").alias("n_words"), F.md5(entries).alias("entries"))


@query(
    f"WITH s AS ({_SCORED}), a AS (SELECT score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM s WHERE score IS NOT NULL GROUP BY score), "
    "b AS (SELECT score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, lead(p) OVER w AS np, lead(n) OVER w AS nn, max(score) OVER () AS high, sum(p) OVER () AS ps, sum(n) OVER () AS ns FROM a WINDOW w AS (ORDER BY score DESC)) "
    "SELECT 'inf'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL SELECT round(score, 9), round(fp / ns, 6), round(tp / ps, 6) FROM b WHERE np IS NULL OR np <> p OR nn <> n OR score = high"
)
def roc_points(spark, sf):
    got = models.roc_curve(_scored(spark, sf), "y", "score")
    return got.select(F.when(F.col("threshold") == float("inf"), F.col("threshold")).otherwise(_r("threshold", 9)).alias("threshold"), _r("fpr").alias("fpr"), _r("tpr").alias("tpr"))


@query(
    "WITH RECURSIVE m AS (SELECT count(*) AS n, avg(p_partkey) AS ma, avg(p_size) AS mb, avg(p_retailprice) AS my FROM part), "
    "c AS (SELECT n, ma, mb, my, var_pop(p_partkey) * n AS aa, var_pop(p_size) * n AS bb, covar_pop(p_partkey, p_size) * n AS ab, covar_pop(p_partkey, p_retailprice) * n AS ya, covar_pop(p_size, p_retailprice) * n AS yb, var_pop(p_retailprice) * n AS yy FROM part, m GROUP BY n, ma, mb, my), "
    "w(alpha, i, a, b, done) AS (SELECT alpha, 0, 0.0::DOUBLE, 0.0::DOUBLE, false FROM (SELECT unnest([1.0, 10.0, 100.0, 200.0]::DOUBLE[]) AS alpha) "
    "UNION ALL SELECT alpha, i + 1, a, b, (greatest(abs(a), abs(b)) = 0 OR greatest(abs(a - a0), abs(b - b0)) < 0.1 * greatest(abs(a), abs(b)) OR i + 1 = 100) "
    "AND 0.5 * res * (1 + sc * sc) + pen * (abs(a) + abs(b)) - sc * (yy - a * ya - b * yb) < 0.1 * yy FROM ("
    "SELECT *, yy - 2 * (a * ya + b * yb) + a * a * aa + 2 * a * b * ab + b * b * bb AS res, CASE WHEN greatest(abs(ya - aa * a - ab * b), abs(yb - ab * a - bb * b)) > pen THEN pen / greatest(abs(ya - aa * a - ab * b), abs(yb - ab * a - bb * b)) ELSE 1 END AS sc FROM ("
    "SELECT *, sign(yb - ab * a) * greatest(abs(yb - ab * a) - pen, 0) / bb AS b FROM ("
    "SELECT alpha, i, a AS a0, b AS b0, alpha * n AS pen, aa, bb, ab, ya, yb, yy, sign(ya - ab * b) * greatest(abs(ya - ab * b) - alpha * n, 0) / aa AS a FROM w, c WHERE NOT done AND i < 100)))) "
    "SELECT alpha, round(a, 5) + 0.0 AS p_partkey, round(b, 4) + 0.0 AS p_size, round(my - a * ma - b * mb, 3) AS intercept, CAST(i AS INTEGER) AS rounds FROM (SELECT *, max(i) OVER (PARTITION BY alpha) AS last FROM w), m WHERE i = last"
)
def lasso_stopped(spark, sf):
    """The path of a lasso that stops as soon as its duality gap is a tenth of the labels' sum of squares."""
    p = read(spark, sf, "part")
    rows = []
    for alpha in (1.0, 10.0, 100.0, 200.0):
        w, b, rounds = models.stopped_lasso(p, ["p_partkey", "p_size"], "p_retailprice", alpha)
        rows.append((alpha, round(float(w[0]), 5) + 0.0, round(float(w[1]), 4) + 0.0, round(b, 3), rounds))
    return spark.createDataFrame(rows, "alpha double, p_partkey double, p_size double, intercept double, rounds int")


@query(
    "WITH m AS (SELECT vec_id, CAST(label AS DOUBLE) AS label, unnest(range(len(embedding))) AS f, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), "
    "e AS (SELECT 1e-9 * max(s) AS e FROM (SELECT var_pop(v) AS s FROM m GROUP BY f)), g AS (SELECT label, f, avg(v) AS mu, var_pop(v) + any_value(e) AS s FROM m, e GROUP BY label, f), "
    "p AS (SELECT CAST(label AS DOUBLE) AS label, ln(count(*) / (SELECT count(*) FROM embeddings)) AS prior FROM embeddings GROUP BY 1), "
    "j AS (SELECT vec_id, g.label, any_value(prior) + sum(-0.5 * ln(2 * pi() * s) - (v - mu) ** 2 / (2 * s)) AS ll FROM m JOIN g USING (f) JOIN p ON p.label = g.label GROUP BY vec_id, g.label) "
    "SELECT vec_id, arg_max(label, ll) AS prediction, round(1 / sum(exp(ll - most)), 5) AS probability FROM (SELECT *, max(ll) OVER (PARTITION BY vec_id) AS most FROM j) GROUP BY vec_id"
)
def gaussian_nb_predictions(spark, sf):
    v, cols = _vectors(spark, sf)
    made = models.gaussian_nb(v, cols, "label").transform(models.assemble(v, cols))
    return made.select("vec_id", "prediction", _r(F.array_max(models.vector_to_array("probability")), 5).alias("probability"))


# --- more of the tabular toolkit


@query("SELECT o_orderkey, " + ", ".join(f"CAST(o_orderstatus = '{s}' AS INTEGER) AS o_orderstatus_{s}" for s in "FOP") + " FROM orders")
def one_hot_all(spark, sf):
    return features.one_hot(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


@query("SELECT doc_id, CAST(quality = 1 AS INTEGER) AS quality_1, CAST(lang = 'de' AS INTEGER) AS lang_de, CAST(lang = 'en' AS INTEGER) AS lang_en, CAST(lang = 'es' AS INTEGER) AS lang_es, CAST(lang = 'fr' AS INTEGER) AS lang_fr FROM labels JOIN documents USING (doc_id)")
def one_hot_binary(spark, sf):
    d = read(spark, sf, "labels").select("doc_id", "quality").join(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return features.one_hot(d, ["quality", "lang"], drop="binary")


@query("SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders WHERE o_orderkey % 5 <> 0)) / (SELECT stddev_pop(o_totalprice) FROM orders WHERE o_orderkey % 5 <> 0), 5) + 0.0 AS o_totalprice, CAST(o_orderstatus = 'O' AS INTEGER) AS o_orderstatus_O, CAST(o_orderstatus = 'P' AS INTEGER) AS o_orderstatus_P FROM orders WHERE o_orderkey % 5 = 0")
def column_transformer(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    made = features.transform_columns(o.where("o_orderkey % 5 = 0"), [("median+scale", ["o_totalprice"]), ("mode+onehot_first", ["o_orderstatus"])], o.where("o_orderkey % 5 <> 0"), rest="keep")
    return made.withColumn("o_totalprice", _r("o_totalprice", 5))


@query("WITH n AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality) SELECT quality, true AS test, CAST(round(n * 30 / 100) AS BIGINT) AS n FROM n UNION ALL SELECT quality, false, n - CAST(round(n * 30 / 100) AS BIGINT) FROM n")
def stratified_split(spark, sf):
    train, test = features.stratified_split(read(spark, sf, "labels"), "quality", "doc_id", 30, seed=1)
    both = train.withColumn("test", F.lit(False)).unionByName(test.withColumn("test", F.lit(True)))
    return both.groupBy("quality", "test").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM documents WHERE lang <> 'en'")
def reset_index(spark, sf):
    return features.numbered(read(spark, sf, "documents").where("lang <> 'en'").select("doc_id"), "doc_id", name="index")


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', '{t}', (SELECT count({c}) FROM lineitem))" for i, (c, t) in enumerate([("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double")])) + ") v(position, \"column\", type, non_null)")
def table_info(spark, sf):
    return profile.info(read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))


@query("SELECT n_name AS word, CASE lower(trim(n_name)) " + " ".join(f"WHEN '{w}' THEN {i}" for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())) + " END AS number, CASE lower(n_name) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS flag FROM (SELECT n_name FROM nation UNION ALL SELECT unnest([' Two', 'twelve', 'yes', 'NO', 'zero ']))")
def word_maps(spark, sf):
    w = read(spark, sf, "nation").select("n_name").union(spark.createDataFrame([(x,) for x in (" Two", "twelve", "yes", "NO", "zero ")], "n_name string"))
    return w.select(F.col("n_name").alias("word"), X.number_word(F.col("n_name")).alias("number"), X.yes_no(F.col("n_name")).alias("flag"))


_MODEL_NAMES = (" models/gemini-2.5-pro", "flash", "2.5-Flash", "gemini-exp", "other", "pro")


@query("SELECT name, CASE " + " ".join(f"WHEN lower(c) = '{k}' THEN '{v}'" for k, v in X.EXTRACTION_MODELS.items()) + " WHEN c LIKE 'gemini-%' THEN c ELSE 'gemini-' || c END AS model FROM (SELECT name, regexp_replace(trim(name), '^models/', '') AS c FROM (SELECT unnest([" + ", ".join(f"'{n}'" for n in _MODEL_NAMES) + "]) AS name))")
def model_names(spark, sf):
    n = spark.createDataFrame([(x,) for x in _MODEL_NAMES], "name string")
    return n.select("name", X.model_name(F.col("name")).alias("model"))


@query(f"WITH s AS ({_SCORED}) SELECT event_id, e.event_type, y, CAST(score >= 0.5 AS INTEGER) AS guess FROM s JOIN events e USING (event_id) WHERE y <> CAST(score >= 0.5 AS INTEGER)")
def misclassified_rows(spark, sf):
    """Rows that are predicted wrongly, looked up in their table."""
    wrong = models.misclassified(_scored(spark, sf).withColumn("guess", (F.col("score") >= 0.5).cast("int")), "y", "guess")
    return wrong.join(read(spark, sf, "events").select("event_id", "event_type"), "event_id").select("event_id", "event_type", "y", "guess")


@query(f"WITH s AS ({_SCORED}), n AS (SELECT count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM s) SELECT t / 10.0 AS threshold, round(count(*) FILTER (y = 0 AND score >= t / 10.0) / any_value(neg), 6) AS fpr, round(count(*) FILTER (y = 1 AND score >= t / 10.0) / any_value(pos), 6) AS tpr FROM s, n, (SELECT CAST(unnest(range(11)) AS DOUBLE) AS t) GROUP BY t")
def roc_curve(spark, sf):
    return _rounded(models.roc_curve(_scored(spark, sf), "y", "score", steps=10))


@query(_TOKENS + ", z AS (SELECT quality, sum(n) AS total FROM c GROUP BY quality), v AS (SELECT count(DISTINCT word) AS v FROM c), p AS (SELECT word, coalesce(max(n) FILTER (quality = 0), 0) AS n0, coalesce(max(n) FILTER (quality = 1), 0) AS n1 FROM c GROUP BY word) SELECT word, round(ln((n0 + 1) / ((SELECT total FROM z WHERE quality = 0) + v)) - ln((n1 + 1) / ((SELECT total FROM z WHERE quality = 1) + v)), 5) AS log_ratio FROM p, v ORDER BY log_ratio, word LIMIT 10")
def nb_bottom_words(spark, sf):
    nb = models.multinomial_nb(_tokens(spark, sf), "quality")
    r = nb.groupBy("word").agg(F.sum(F.when(F.col("quality") == 0, F.col("log_prob")).otherwise(-F.col("log_prob"))).alias("log_ratio"))
    return r.select("word", _r("log_ratio", 5).alias("log_ratio")).orderBy("log_ratio", "word").limit(10)


@query(
    _two("lineitem", "l_quantity", "l_discount", "l_extendedprice")
    + ", n AS (SELECT count(*) AS n FROM lineitem), e AS (SELECT sum((l_extendedprice - (i + a * l_quantity + b * l_discount)) ** 2) / (any_value(n.n) - 3) AS s2 FROM lineitem, f, n), d AS (SELECT xx * n AS sxx, zz * n AS szz, xz * n AS sxz, mx, mz, n FROM c, n), "
    "se AS (SELECT sqrt(s2 * szz / (sxx * szz - sxz * sxz)) AS ea, sqrt(s2 * sxx / (sxx * szz - sxz * sxz)) AS eb, sqrt(s2 * (1.0 / n + (mx * mx * szz - 2 * mx * mz * sxz + mz * mz * sxx) / (sxx * szz - sxz * sxz))) AS ei FROM d, e) "
    "SELECT unnest(['const', 'l_quantity', 'l_discount']) AS term, unnest([round(i, 2), round(a, 3), round(b, 1)]) AS coefficient, unnest([round(ei, 2), round(ea, 3), round(eb, 1)]) AS standard_error, unnest([round(i / ei, 3), round(a / ea, 3), round(b / eb, 3)]) AS t FROM f, se"
)
def ols_summary(spark, sf):
    m = models.ols(read(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    digits = {"const": 2, "l_quantity": 3, "l_discount": 1}
    return spark.createDataFrame([(r["term"], round(r["coefficient"], digits[r["term"]]), round(r["standard_error"], digits[r["term"]]), round(r["t"], 3)) for r in m.summary()], "term string, coefficient double, standard_error double, t double")


@query(_TWO + "SELECT unnest(['p_size', 'p_partkey']) AS feature, unnest([round(a * sqrt(xx), 3), round(b * sqrt(zz), 3)]) AS coefficient FROM f, c")
def largest_coefficients(spark, sf):
    p = features.standardize(read(spark, sf, "part").select("p_size", "p_partkey", "p_retailprice"), ["p_size", "p_partkey"])
    m = models.ols(p, ["p_size", "p_partkey"], "p_retailprice")
    return spark.createDataFrame([(f, round(c, 3)) for f, c in models.top_coefficients(m.features, m.coefficients)], "feature string, coefficient double")


_TEST_R2 = "round(1 - sum((p_retailprice - (i + s * p_size)) ** 2) / (var_pop(p_retailprice) * count(*)), 5)"


def _part_r2(test: DataFrame, model) -> float:
    return models.regression_metrics(test.withColumn("guess", model.predict()), "p_retailprice", "guess").first()["r2"]


@query(" UNION ALL ".join(f"SELECT {seed} AS seed, (SELECT {_TEST_R2} FROM part, (SELECT regr_slope(p_retailprice, p_size) AS s, regr_intercept(p_retailprice, p_size) AS i FROM part WHERE {_PERCENT.format(seed=seed, key='p_partkey')} >= 30) WHERE {_PERCENT.format(seed=seed, key='p_partkey')} < 30) AS r2" for seed in range(5)))
def split_sensitivity(spark, sf):
    def fit(train):
        model = models.ols(train, ["p_size"], "p_retailprice")
        return lambda test: _part_r2(test, model)

    got = crossval.split_sensitivity(read(spark, sf, "part"), "p_partkey", 30, list(range(5)), fit)
    return spark.createDataFrame([(i, round(float(x), 5)) for i, x in enumerate(got["scores"])], "seed int, r2 double")


@query(f"WITH c AS (SELECT covar_pop(p_size, p_retailprice) * count(*) AS xy, var_pop(p_size) * count(*) AS xx, avg(p_size) AS mx, avg(p_retailprice) AS my FROM part WHERE p_partkey % 5 <> 0), w AS (SELECT alpha, xy / (xx + alpha) AS s, my - xy / (xx + alpha) * mx AS i FROM c, (SELECT unnest([1.0, 1000.0, 100000.0]::DOUBLE[]) AS alpha)) SELECT alpha, {_TEST_R2} AS score FROM part, w WHERE p_partkey % 5 = 0 GROUP BY alpha")
def grid_search(spark, sf):
    p = read(spark, sf, "part")

    def make(option):
        def fit(train):
            w, b = models.ridge(train, ["p_size"], "p_retailprice", option["alpha"])
            return lambda test: models.regression_metrics(test.withColumn("guess", F.col("p_size") * float(w[0]) + float(b)), "p_retailprice", "guess").first()["r2"]

        return fit

    got = crossval.search([{"alpha": a} for a in (1.0, 1000.0, 100000.0)], make, p.where("p_partkey % 5 <> 0"), p.where("p_partkey % 5 = 0"))
    return spark.createDataFrame([(r["alpha"], round(float(r["score"]), 5)) for r in got], "alpha double, score double")


@query(_TWO + ", one AS (SELECT regr_slope(p_retailprice, p_size) AS s, regr_intercept(p_retailprice, p_size) AS k FROM part) SELECT 'size' AS model, round(1 - sum((p_retailprice - (k + s * p_size)) ** 2) / (var_pop(p_retailprice) * count(*)), 5) AS r2, round(avg(abs(p_retailprice - (k + s * p_size))), 3) AS mae FROM part, one UNION ALL SELECT 'size and key', round(1 - sum((p_retailprice - (i + a * p_size + b * p_partkey)) ** 2) / (var_pop(p_retailprice) * count(*)), 5), round(avg(abs(p_retailprice - (i + a * p_size + b * p_partkey))), 3) FROM part, f")
def model_comparison(spark, sf):
    p = read(spark, sf, "part").select("p_size", "p_partkey", "p_retailprice")

    def linear(cols):
        def fit(train):
            steps = models.Steps(lambda t, _: t.select(*cols, "p_retailprice"), models.ols, "p_retailprice").fit(train)
            return lambda test: models.regression_metrics(steps.predict(test), "p_retailprice", "prediction").first().asDict()

        return fit

    got = models.compare({"size": linear(["p_size"]), "size and key": linear(["p_size", "p_partkey"])}, p, p)
    return spark.createDataFrame([(r["model"], round(r["r2"], 5), round(r["mae"], 3)) for r in got], "model string, r2 double, mae double")
