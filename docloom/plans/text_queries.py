"""Text functions, projections and filters over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import html as H
from docloom.functions import text as T
from docloom.operators import hierarchy, integrity, relations
from docloom.plans.registry import folded, query
from docloom.shared import numbered

WORDS = r"(\p{Nd}+|[\p{L}\p{N}]+)"


@query("txt_01_collapse", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(T.collapse(F.col("text"))).alias("digest"))


@query("txt_02_legal_tokens", rf"SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all({folded('text')}, '{WORDS}', 1) AS w FROM documents)")
def _(t):
    w = T.legal_tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.md5(F.array_join(w, " ")).alias("digest"))


@query("txt_03_number_tokens", r"SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '([\p{Ll}0-9/\-]+)', 1), lambda x: length(x) > 1 OR regexp_matches(x, '^[0-9]$')) AS w FROM documents)")
def _(t):
    w = T.number_tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.md5(F.array_join(w, " ")).alias("digest"))


@query("txt_04_plain_tokens", r"SELECT doc_id, len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS n_tokens FROM documents")
def _(t):
    return t("documents").select("doc_id", F.size(T.plain_tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("txt_05_dedup_key", rf"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(trim(regexp_replace({folded('text')}, '\s+', ' ', 'g')), '[.,;:!?\-–—]+', '', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(T.dedup_key(F.col("text"))).alias("digest"))


#: A pattern that occurs in these tables, in place of references to laws.
VERSION = r"(?:version|Version) [0-9]+"


@query("txt_06_references", f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{VERSION}'))), '|') AS refs FROM documents")
def _(t):
    return t("documents").select("doc_id", F.array_join(F.sort_array(T.references(F.col("text"), VERSION)), "|").alias("refs"))


@query(
    "txt_07_references_allowed",
    "WITH r AS (SELECT o_orderkey, list_distinct(regexp_extract_all(o_orderpriority, '[A-Z]+')) AS f, list_distinct(regexp_extract_all(o_orderpriority || o_orderstatus, '[A-MO-Z]+')) AS a FROM orders) "
    "SELECT o_orderkey, len(f) = 0 OR len(a) = 0 OR len(list_filter(f, lambda x: NOT list_contains(a, x))) = 0 AS allowed FROM r",
)
def _(t):
    found, allowed = T.references(F.col("o_orderpriority"), "[A-Z]+"), T.references(F.concat("o_orderpriority", "o_orderstatus"), "[A-MO-Z]+")
    return t("orders").select("o_orderkey", T.references_allowed(found, allowed).alias("allowed"))


@query("txt_08_numbers_in_questions", "SELECT item_id, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), '|') AS refs FROM (SELECT item_id, regexp_extract_all(text, '[A-Z][a-z]+') AS m FROM benchmark)")
def _(t):
    """All references, each once, in the order of their first places."""
    return t("benchmark").select("item_id", F.array_join(T.references(F.col("text"), "[A-Z][a-z]+"), "|").alias("refs"))


#: A capitalised word before a full stop stands in for a document number.
MENTION = r"[A-Z][a-z]+\."
PLACES = f"""
p AS (SELECT doc_id, text, regexp_extract_all(text, '{MENTION}') AS m, regexp_split_to_array(text, '{MENTION}') AS s FROM documents),
u AS (SELECT doc_id, text, m, s, unnest(range(1, len(m) + 1)) AS i FROM p),
v AS (SELECT doc_id, text, m[i] AS word, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS first FROM u)"""


@query("txt_09_mentions", f'WITH {PLACES} SELECT doc_id, first AS "start", first + length(word) AS "end", word FROM v')
def _(t):
    found = t("documents").select("doc_id", F.explode(T.matches(F.col("text"), MENTION)).alias("m"))
    return found.select("doc_id", F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("end"), "m.word")


TRIGGERS = (("with", ("with",)), ("from", ("from", "avec")), ("that", ("that",)))
WINDOWS = f"WITH {PLACES}, w AS (SELECT doc_id, upper(word) AS target, trim(text[greatest(first - 150, 0) + 1:first + length(word) + 100], ' ') AS evidence FROM v), x AS (SELECT *, CASE WHEN contains(lower(evidence), 'with') THEN 'with' WHEN contains(lower(evidence), 'from') OR contains(lower(evidence), 'avec') THEN 'from' WHEN contains(lower(evidence), 'that') THEN 'that' ELSE 'other' END AS trig FROM w WHERE length(evidence) > 0)"


@query("txt_10_evidence", WINDOWS + ' SELECT DISTINCT doc_id, target, trig AS "trigger", md5(evidence) AS digest FROM x')
def _(t):
    return relations.candidates(t("documents"), MENTION, triggers=TRIGGERS, other="other").select("doc_id", "target", "trigger", F.md5("evidence").alias("digest")).distinct()


@query(
    "etl_01_candidates",
    WINDOWS + ' SELECT trig AS "trigger", count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT DISTINCT doc_id, target, trig, evidence FROM x) GROUP BY trig',
)
def _(t):
    return relations.candidates(t("documents"), MENTION, triggers=TRIGGERS, other="other").groupBy("trigger").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query(
    "etl_02_relation_types",
    WINDOWS
    + """, y AS (SELECT DISTINCT doc_id, target, trig, evidence FROM x)
SELECT CASE WHEN trig = 'from' THEN target ELSE CAST(doc_id AS VARCHAR) END AS source, CASE WHEN trig = 'from' THEN CAST(doc_id AS VARCHAR) ELSE target END AS target,
CASE trig WHEN 'with' THEN 'AMENDS' WHEN 'from' THEN 'REPLACED_BY' ELSE 'CITES' END AS relationship_type, CASE WHEN trig IN ('with', 'from') THEN 0.90 ELSE 0.85 END AS confidence, md5(evidence) AS digest FROM y""",
)
def _(t):
    found = relations.candidates(t("documents"), MENTION, triggers=TRIGGERS, other="other").withColumn("source", F.col("doc_id").cast("string"))
    out = relations.typed(found, "source", {"with": ("AMENDS", False), "from": ("REPLACED_BY", True)}, "CITES")
    return out.select("source", "target", "relationship_type", F.col("confidence").cast("double").alias("confidence"), F.md5("evidence").alias("digest"))


@query("txt_11_canonical_name", r"SELECT p_partkey, array_to_string(list_transform(string_split(trim(regexp_replace(nfc_normalize(p_name), '\s+', ' ', 'g')), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS name FROM part")
def _(t):
    return t("part").select("p_partkey", T.canonical_name(F.col("p_name"), F.lit("LinhVuc")).alias("name"))


@query("txt_12_html_text")
def _(t):
    """Texts of pages by a parser: rows only."""
    return t("pages").select("page_id", H.html_text("html").alias("text"))


@query("txt_13_tidy_lines", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g'), ' ')) AS digest FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(T.tidy_lines(F.col("text"))).alias("digest"))


@query("txt_14_article_number", r"SELECT doc_id, regexp_extract(text, '[Vv]ersion ([0-9]+)', 1) AS number FROM documents")
def _(t):
    return t("documents").select("doc_id", F.regexp_extract("text", r"[Vv]ersion ([0-9]+)", 1).alias("number"))


NATURAL = r"list_transform(regexp_extract_all(url, '[0-9]+|[^0-9]+'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN '0' || lpad(r, 20, '0') ELSE '1' || lower(r) END)"


@query("txt_15_natural_order", f"SELECT page_id, row_number() OVER (ORDER BY {NATURAL}, page_id) AS place FROM pages")
def _(t):
    return numbered(t("pages").select("page_id", "url"), T.natural_key(F.col("url")), F.col("page_id")).select("page_id", "place")


@query("srt_02_natural_sort", f"SELECT host, min(page_id) AS page_id FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, row_number() OVER (PARTITION BY regexp_extract(url, '://([^/?#]*)', 1) ORDER BY {NATURAL}, page_id) AS n FROM pages) WHERE n = 1 GROUP BY host")
def _(t):
    rows = t("pages").withColumn("host", F.regexp_extract("url", r"://([^/?#]*)", 1))
    return relations.first_rows(rows, ["host"], [T.natural_key(F.col("url")), F.col("page_id")]).select("host", "page_id")


@query("txt_16_relation_type", r"SELECT p_partkey, CASE WHEN regexp_matches(n, '^[\p{L}_][\p{L}\p{N}_]*$') THEN n END AS name FROM (SELECT p_partkey, regexp_replace(upper(trim(p_brand)), '[^\p{L}\p{N}_]+', '_', 'g') AS n FROM part)")
def _(t):
    return t("part").select("p_partkey", T.relation_type(F.col("p_brand")).alias("name"))


@query("txt_17_file_name", r"""SELECT page_id, regexp_replace(trim(url), '[\\/*?:"<>|\s]+', '_', 'g') AS name FROM pages""")
def _(t):
    return t("pages").select("page_id", T.file_name(F.col("url")).alias("name"))


@query("txt_18_slug", "SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def _(t):
    return t("pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("txt_19_json_part", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    wrapped = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n``` as asked"))
    return t("events").select("event_id", F.try_variant_get(T.json_part(wrapped), "$.k", "bigint").alias("k"))


ANSWER = "concat('see [E ', CAST(o_orderkey % 7 AS VARCHAR), '] and [E', CAST(o_custkey % 5 AS VARCHAR), '], [E ', CAST(o_orderkey % 7 AS VARCHAR), ']')"


@query("txt_20_answer_labels", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = o_custkey % 5 THEN CAST(o_orderkey % 7 AS VARCHAR) ELSE CAST(o_orderkey % 7 AS VARCHAR) || ',' || CAST(o_custkey % 5 AS VARCHAR) END AS labels, CAST(CASE WHEN o_orderkey % 7 > 4 OR o_orderkey % 7 = 0 OR o_custkey % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS out_of_range FROM orders")
def _(t):
    text = F.concat(F.lit("see [E "), (F.col("o_orderkey") % 7).cast("string"), F.lit("] and [E"), (F.col("o_custkey") % 5).cast("string"), F.lit("], [E "), (F.col("o_orderkey") % 7).cast("string"), F.lit("]"))
    labels = T.labels(text)
    return t("orders").select("o_orderkey", F.array_join(F.transform(labels, lambda x: x.cast("string")), ",").alias("labels"), F.exists(labels, lambda x: ~x.between(1, 4)).cast("int").alias("out_of_range"))


@query("txt_21_wikilinks", "SELECT n_nationkey, 'NATION_' || CAST((n_nationkey + 1) % 25 AS VARCHAR) || ',' || n_name AS links FROM nation")
def _(t):
    body = F.concat(F.lit("see [[NATION_"), ((F.col("n_nationkey") + 1) % 25).cast("string"), F.lit("|next]] and [[ "), F.col("n_name"), F.lit(" ]]"))
    return t("nation").select("n_nationkey", F.array_join(T.wikilinks(body), ",").alias("links"))


@query("txt_22_redact", "SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 2) THEN '***' ELSE c_name END AS first, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN c_mktsegment ELSE '***' END AS second FROM customer")
def _(t):
    """Two values under names that differ from row to row; some names tell of a secret."""
    first = F.element_at(F.array(*[F.lit(n) for n in ("API_Key", "name", "Token_of_customer", "id")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    second = F.concat(F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), "plain_").otherwise("PassWord_"), F.col("c_mktsegment"))
    m = T.redact(F.create_map(first, F.col("c_name"), second, F.col("c_mktsegment")))
    return t("customer").select("c_custkey", F.map_values(m)[0].alias("first"), F.map_values(m)[1].alias("second"))


@query("txt_23_stable_id", "SELECT doc_id, substring(sha256(concat_ws('|', source, lang, CAST(doc_id AS VARCHAR))), 1, 16) AS id FROM documents")
def _(t):
    return t("documents").select("doc_id", T.stable_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("id"))


@query("txt_24_sequential_id", "SELECT s_suppkey, printf('ENT_SUP_%04d', row_number() OVER (ORDER BY s_name, s_suppkey)) AS id FROM supplier")
def _(t):
    rows = numbered(t("supplier").select("s_suppkey", "s_name"), F.col("s_name"), F.col("s_suppkey"))
    return rows.select("s_suppkey", F.format_string("ENT_SUP_%04d", "place").alias("id"))


@query("txt_25_content_id", "SELECT doc_id, substring(sha256(text), 1, 12) AS id FROM documents")
def _(t):
    """An id from the content, in place of a random one, so that reruns agree."""
    return t("documents").select("doc_id", T.stable_id(F.col("text"), length=12).alias("id"))


@query("prj_01_evidence", "SELECT doc_id AS chunk_id, source, substring(text, 1, 120) AS preview, n_chars, lang AS strategy FROM documents")
def _(t):
    return t("documents").select(F.col("doc_id").alias("chunk_id"), "source", T.preview(F.col("text")).alias("preview"), "n_chars", F.col("lang").alias("strategy"))


@query("prj_02_labelled_evidence", "SELECT doc_id, 'P' || CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS VARCHAR) AS label FROM documents")
def _(t):
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return t("documents").select("doc_id", F.concat(F.lit("P"), place.cast("string")).alias("label"))


@query("prj_03_citation", "SELECT o_orderkey, concat_ws(' | ', o_orderpriority, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END, CAST(o_orderkey AS VARCHAR)) AS citation FROM orders")
def _(t):
    state = F.when(F.col("o_orderstatus") == "O", F.lit(" NaN ")).otherwise(F.col("o_orderstatus"))
    return t("orders").select("o_orderkey", T.citation(F.col("o_orderpriority"), state, F.col("o_orderkey").cast("string")).alias("citation"))


@query("prj_04_preview", "SELECT conv_id, turn, substring(text, 1, 120) AS preview FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", T.preview(F.col("text")).alias("preview"))


@query("prj_05_context_block", "SELECT conv_id, turn, CASE WHEN turn = 0 THEN '[direct] ' ELSE '[hop ' || CAST(turn AS VARCHAR) || ': ' || 'a -> ' || role || '] ' END || text AS block FROM conversations")
def _(t):
    tag = F.when(F.col("turn") == 0, "[direct] ").otherwise(F.concat(F.lit("[hop "), F.col("turn").cast("string"), F.lit(": "), F.array_join(F.array(F.lit("a"), F.col("role")), " -> "), F.lit("] ")))
    return t("conversations").select("conv_id", "turn", F.concat(tag, "text").alias("block"))


@query("prj_06_wide_union", "SELECT 'C' || CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS category, CAST(NULL AS INTEGER) AS size FROM customer UNION ALL SELECT 'P' || CAST(p_partkey AS VARCHAR), p_name, NULL, p_size FROM part UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), s_name, NULL, NULL FROM supplier")
def _(t):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("id")
    a = t("customer").select(key("C", "c_custkey"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"))
    b = t("part").select(key("P", "p_partkey"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(t("supplier").select(key("S", "s_suppkey"), F.col("s_name").alias("name")), allowMissingColumns=True)


@query("prj_07_precedence", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, 'default') AS value, o_orderstatus = 'O' AS changed FROM orders")
def _(t):
    own = T.clean_null(F.when(F.col("o_orderstatus") == "O", "nan").otherwise(F.col("o_orderstatus")))
    found = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority"))
    return t("orders").select("o_orderkey", F.coalesce(own, found, F.lit("default")).alias("value"), own.isNull().alias("changed"))


@query("flt_04_least_length", "SELECT doc_id FROM documents WHERE length(text) > 200")
def _(t):
    return t("documents").filter(F.length("text") > 200).select("doc_id")


@query("flt_05_missing_marks", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O'")
def _(t):
    return t("orders").filter(T.clean_null(F.when(F.col("o_orderstatus") == "O", "None").otherwise(F.col("o_orderstatus"))).isNotNull()).select("o_orderkey")


@query("flt_06_self_reference", "SELECT n_nationkey FROM nation WHERE upper(n_name) <> upper('nation_' || CAST(n_regionkey AS VARCHAR))")
def _(t):
    return t("nation").filter(F.upper("n_name") != F.upper(F.concat(F.lit("nation_"), F.col("n_regionkey").cast("string")))).select("n_nationkey")


@query("flt_07_status", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def _(t):
    return t("orders").filter(F.col("o_orderstatus") != "F").select("o_orderkey", "o_orderstatus")


@query("flt_09_dashboard", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3) AND c_name ILIKE '%CUSTOMER%1%'")
def _(t):
    return t("customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_nationkey").isin(1, 2, 3) & F.col("c_name").ilike("%CUSTOMER%1%")).select("c_custkey")


#: Lines of these texts that open a chunk.
OPENING = "^The "
ARTICLES = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents),
k AS (SELECT doc_id, place, trim(line, ' ') AS line FROM l WHERE trim(line, ' ') <> ''),
s AS (SELECT *, sum(CASE WHEN starts_with(line, 'The ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) AS segment FROM k),
j AS (SELECT doc_id, segment, trim(regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY place), '[ \\t]+', ' ', 'g'), '\\n\\s*\\n+', chr(10), 'g'), ' ') AS text, min_by(line, place) AS head FROM s GROUP BY doc_id, segment),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY segment) AS chunk_no FROM j WHERE length(text) > 20)"""


@query("chk_07_split_articles", ARTICLES + " SELECT doc_id, chunk_no, printf('%s_c%03d', CAST(doc_id AS VARCHAR), chunk_no) AS chunk_id, CASE WHEN segment > 0 THEN md5(head) ELSE md5('') END AS article, md5(text) AS digest FROM n")
def _(t):
    out = hierarchy.split_articles(t("documents"), heading=OPENING)
    return out.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "chunk_id", F.md5("article").alias("article"), F.md5("text").alias("digest"))


@query("win_05_segments", ARTICLES + " SELECT doc_id, count(*) AS n_chunks, max(chunk_no) AS last_chunk FROM n GROUP BY doc_id")
def _(t):
    out = hierarchy.split_articles(t("documents"), heading=OPENING)
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("chunk_no").cast("long").alias("last_chunk"))


@query("chk_01_html_blocks")
def _(t):
    """Outermost blocks of pages by a parser: rows only."""
    return H.html_blocks(t("pages"))


@query("chk_04_block_tree")
def _(t):
    """Blocks with levels, parents and chains: rows only."""
    levels = {"chapter": r"^[A-Z][a-z]{12,}\b", "section": r"^[A-Z][a-z]{9,}\b", "article": r"^[A-Z][a-z]{6,}\b"}
    return hierarchy.block_tree(H.html_blocks(t("pages")), beginnings=levels)


@query("chk_06_title", "SELECT page_id, regexp_matches(html, '<title>') AS has_title FROM pages")
def _(t):
    return t("pages").select("page_id", (H.html_title("html") != "Document").alias("has_title"))


@query("dq_04_block_chain", "SELECT conv_id, turn FROM (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations) WHERE role = 'user' AND after <> 'user'")
def _(t):
    """Turns as blocks, chained; those of other speakers are taken out, so what pointed to them dangles."""
    tree = hierarchy.block_tree(t("conversations").filter("conv_id is not null"), "conv_id", "turn", beginnings={"chapter": "^$"})
    return integrity.dangling_next(tree.filter("role = 'user'")).select("conv_id", "turn")


#: Capitalised words at the start of a text stand in for headings.
HEADINGS = {"chapter": r"^(Th\w+) ", "article": r"^(An\w*|En\w*) ", "clause": r"^(Er\w*|Es\w*) ", "point": r"^(Le\w*|La\w*) "}
HEAD_SQL = r"""
WITH h AS (SELECT doc_id, source, length(text) AS size, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents),
g AS (SELECT doc_id, source, size, nullif(regexp_extract(flat, '^(Th[a-zA-Z0-9_]+) ', 1), '') AS chapter, nullif(regexp_extract(flat, '^(An[a-zA-Z0-9_]*|En[a-zA-Z0-9_]*) ', 1), '') AS article, nullif(regexp_extract(flat, '^(Er[a-zA-Z0-9_]*|Es[a-zA-Z0-9_]*) ', 1), '') AS clause, nullif(regexp_extract(flat, '^(Le[a-zA-Z0-9_]*|La[a-zA-Z0-9_]*) ', 1), '') AS point FROM h),
c AS (SELECT *, coalesce(chapter, article, clause, point) IS NOT NULL AS own,
  last_value(chapter IGNORE NULLS) OVER w AS c_chapter, last_value(article IGNORE NULLS) OVER w AS c_article, last_value(clause IGNORE NULLS) OVER w AS c_clause, last_value(point IGNORE NULLS) OVER w AS c_point
  FROM g WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT doc_id, source, size, CASE WHEN own THEN 'heading_inferred' WHEN coalesce(c_article, c_chapter) IS NOT NULL THEN 'carried_forward' ELSE 'document_fallback' END AS method,
  CASE WHEN own THEN chapter WHEN coalesce(c_article, c_chapter) IS NOT NULL THEN c_chapter END AS chapter, CASE WHEN own THEN article WHEN coalesce(c_article, c_chapter) IS NOT NULL THEN c_article END AS article FROM c)"""


def _resolved(t):
    return hierarchy.resolve_paths(t("documents").withColumn("chunk_id", F.col("doc_id").cast("string")), patterns={k: p.replace(r"\w", "[a-zA-Z0-9_]") for k, p in HEADINGS.items()})


@query("chk_10_resolve_paths", HEAD_SQL + " SELECT doc_id, method AS resolution_method, chapter, article FROM r")
def _(t):
    return _resolved(t).select("doc_id", "resolution_method", F.col("path.chapter").alias("chapter"), F.col("path.article").alias("article"))


@query("chk_08_headings", HEAD_SQL + " SELECT doc_id, chapter, article, clause, point FROM g")
def _(t):
    head = hierarchy.headings(F.col("text"), {k: p.replace(r"\w", "[a-zA-Z0-9_]") for k, p in HEADINGS.items()})
    return t("documents").select("doc_id", head.alias("h")).select("doc_id", "h.*")


@query("chk_11_carry_forward", HEAD_SQL + " SELECT source, method AS resolution_method, count(*) AS n FROM r GROUP BY source, method")
def _(t):
    return _resolved(t).groupBy("source", "resolution_method").agg(F.count(F.lit(1)).alias("n"))


PACKED = HEAD_SQL + """,
o AS (SELECT doc_id, source, coalesce(lower(trim(article)), 'document') AS article_key, size, row_number() OVER (PARTITION BY source, coalesce(lower(trim(article)), 'document') ORDER BY doc_id) AS place FROM r),
f AS (
  WITH RECURSIVE w AS (
    SELECT doc_id, source, article_key, place, size, CAST(0 AS BIGINT) AS win, CAST(size AS BIGINT) AS used FROM o WHERE place = 1
    UNION ALL
    SELECT o.doc_id, o.source, o.article_key, o.place, o.size, CASE WHEN w.used + o.size > 6000 THEN w.win + 1 ELSE w.win END, CASE WHEN w.used + o.size > 6000 THEN CAST(o.size AS BIGINT) ELSE w.used + o.size END
    FROM w JOIN o ON o.source = w.source AND o.article_key = w.article_key AND o.place = w.place + 1)
  SELECT * FROM w)"""


@query("chk_12_pack_parents", PACKED.replace("WITH h AS", "WITH RECURSIVE h AS", 1) + " SELECT doc_id, article_key, win AS window_index FROM f")
def _(t):
    _, packed = hierarchy.build_parents(_resolved(t))
    return packed.select("doc_id", "article_key", F.col("window_index").cast("long").alias("window_index"))


@query("chk_13_parents", PACKED.replace("WITH h AS", "WITH RECURSIVE h AS", 1) + " SELECT substring(sha256(concat_ws('|', source, article_key, CAST(win AS VARCHAR))), 1, 16) AS parent_id, count(*) AS n_children, CAST(sum(size) + 2 * (count(*) - 1) AS BIGINT) AS char_count, min(doc_id) AS first_child, min(doc_id % 7) AS page_start, max(doc_id % 7 + doc_id % 3) AS page_end, max(size) > 6000 AS oversized FROM f GROUP BY source, article_key, win")
def _(t):
    """With made pages: from the id's remainder by 7, up to two further on."""
    parents, _ = hierarchy.build_parents(_resolved(t).withColumns({"page_start": F.col("doc_id") % 7, "page_end": F.col("doc_id") % 7 + F.col("doc_id") % 3}))
    return parents.select(
        "parent_id", F.size("child_ids").cast("long").alias("n_children"), F.col("char_count").cast("long").alias("char_count"), F.col("child_ids")[0].cast("long").alias("first_child"),
        "page_start", "page_end", F.array_contains("warnings", "oversized_single_child").alias("oversized"),
    )


@query("chk_14_single_assignment", "SELECT CAST(doc_id AS VARCHAR) AS chunk_id, CAST(2 AS BIGINT) AS n FROM documents WHERE lang = 'es'")
def _(t):
    """The packing assigns each child once; with those of one language assigned again, just these are found."""
    packed = hierarchy.build_parents(_resolved(t))[1].select("chunk_id", "lang", "parent_id")
    return hierarchy.twice_assigned(packed.unionByName(packed.filter("lang = 'es'").withColumn("parent_id", F.lit("another"))))


@query("chk_15_summary", PACKED.replace("WITH h AS", "WITH RECURSIVE h AS", 1) + ", p AS (SELECT sum(size) + 2 * (count(*) - 1) AS n FROM f GROUP BY source, article_key, win) SELECT (SELECT count(*) FROM p) AS n_parents, CAST((SELECT max(n) FROM p) AS BIGINT) AS longest_parent, (SELECT count(*) FROM r) AS n_children, (SELECT count(*) FROM r WHERE method = 'document_fallback') AS n_fallback")
def _(t):
    return hierarchy.hierarchy_summary(*hierarchy.build_parents(_resolved(t))).select("n_parents", F.col("longest_parent").cast("long").alias("longest_parent"), "n_children", F.col("n_fallback").cast("long").alias("n_fallback"))


@query("chk_05_next_siblings", "SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS next_turn FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", F.lead("turn").over(Window.partitionBy("conv_id", "role").orderBy("turn")).alias("next_turn"))


@query("chk_09_structure_metadata", "SELECT event_id, 'k' || CAST(json_extract(props, '$.k') AS VARCHAR) AS article, CAST(NULL AS VARCHAR) AS chapter FROM events")
def _(t):
    variant = F.parse_json(F.concat(F.lit('[{"type": "Article ", "label": "k'), F.get_json_object("props", "$.k"), F.lit('"}, {"type": "note", "label": "x"}]')))
    path = hierarchy.structure_path(variant)
    return t("events").select("event_id", path["article"].alias("article"), path["chapter"].alias("chapter"))
