"""Sources and sinks: tables are written in the shared folder and read back by the reader under test."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import html as H
from docloom.functions import text as T
from docloom.operators import evaluation, fusion, hierarchy, lexical_index, ranking
from docloom.plans.ranking_queries import BM25, _bm25, _out, _questions
from docloom.plans.registry import query
from docloom.shared import cut, scratch
from docloom.sources import buckets, readers, writers


def _chunk_files(t, spark):
    """A JSON file for each source, for a very large one several, alternately an object and an array."""
    path = scratch(spark)
    row = F.struct(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("lang").alias("strategy"), "source", F.lit(0).alias("page_start"), (F.col("doc_id") % 7 - 1).alias("page_end"), F.when(F.col("doc_id") % 5 > 0, F.col("text")).alias("text"))
    writers.json_arrays(t("documents"), path, "source", row, "chunks", F.hash("source") % 2 != 0)
    return path


@query("src_01_chunks", r"SELECT 'c' || CAST(doc_id AS VARCHAR) AS chunk_id, source, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents WHERE lang = 'en' AND doc_id % 5 > 0", session=True)
def _(t, spark):
    return readers.chunks(spark, _chunk_files(t, spark), "en").select("chunk_id", "source", F.md5("text").alias("digest"))


@query("src_02_strict_chunks", "SELECT CASE WHEN lang NOT IN ('en', 'fr') THEN 'strategy' WHEN doc_id % 7 = 0 THEN 'pages' END AS fault, doc_id % 5 = 0 AS text_missing, count(*) AS n FROM documents GROUP BY 1, 2", session=True)
def _(t, spark):
    rows = readers.strict_chunks(spark, _chunk_files(t, spark), ("en", "fr"))
    return rows.groupBy("fault", "text_missing").agg(F.count(F.lit(1)).alias("n"))


@query("src_03_large_csv", "SELECT doc_id, md5(trim(text, ' ')) AS digest FROM documents", session=True)
def _(t, spark):
    path = scratch(spark)
    writers.csv_table(t("documents").select("doc_id", F.trim("text").alias("text")), path)
    return readers.csv(spark, path, "doc_id long, text string", ("doc_id", "text")).select("doc_id", F.md5("text").alias("digest"))


@query("src_04_metadata", "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS title FROM customer", session=True)
def _(t, spark):
    """A third of the keys stand in the file twice: the later row counts."""
    path = scratch(spark)
    rows = t("customer").select(F.format_string(" %d ", F.col("c_custkey")).alias("doc_id"), F.col("c_name").alias("title"), F.lit(0).alias("place"))
    later = t("customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("doc_id"), F.col("c_mktsegment").alias("title"), F.lit(1).alias("place"))
    writers.csv_table(rows.unionByName(later).repartitionByRange(1, "place").sortWithinPartitions("place").drop("place"), path)
    return readers.metadata(spark, path, "doc_id string, title string").select("id", "title")


@query("src_05_relationships", "SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, CAST(n_regionkey AS VARCHAR) AS other_doc_id, CASE WHEN n_nationkey % 2 = 0 THEN 'T' ELSE 'cites' END AS relationship_type FROM nation WHERE n_nationkey % 3 > 0", session=True)
def _(t, spark):
    path = scratch(spark)
    n = F.col("n_nationkey")
    writers.csv_table(t("nation").select(n.alias("doc_id"), F.when(n % 3 > 0, F.col("n_regionkey")).alias("other_doc_id"), F.lit("cites").alias("relationship"), F.when(n % 2 == 0, "T").alias("relationship_type")), path)
    return readers.relationships(spark, path)


@query("src_06_csv_pair", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", session=True)
def _(t, spark):
    a, b = scratch(spark), scratch(spark)
    writers.csv_table(t("nation"), a)
    writers.csv_table(t("region"), b)
    nation, region = readers.csv(spark, a, "n_nationkey int, n_name string, n_regionkey int"), readers.csv(spark, b, "r_regionkey int, r_name string")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("src_07_seed_tables", "SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part", session=True)
def _(t, spark):
    out = None
    for name in ("nation", "region", "supplier", "part"):
        path = scratch(spark)
        writers.csv_table(t(name), path)
        part = readers.csv(spark, path, ", ".join(f"{c} {k}" for c, k in t(name).dtypes)).select(F.lit(name).alias("name"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("src_10_vectors", "SELECT vec_id, len(embedding) AS size, CAST(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(round(x * 1000) AS BIGINT))) AS BIGINT) AS total FROM embeddings", session=True)
def _(t, spark):
    path = scratch(spark)
    writers.vector_table(t("embeddings"), path, {"metric": "cosine", "size": 64})
    total = F.aggregate("embedding", F.lit(0).cast("long"), lambda a, x: a + F.round(x.cast("double") * 1000).cast("long"))
    return readers.vectors(spark, path, {"metric": "cosine"}).select("vec_id", F.size("embedding").cast("long").alias("size"), total.alias("total"))


@query("src_11_questions", "SELECT CAST(item_id AS VARCHAR) AS question_id, text AS question, CASE WHEN item_id % 2 = 0 THEN 'c' || CAST(item_id AS VARCHAR) ELSE '' END AS relevant FROM benchmark", session=True)
def _(t, spark):
    path = scratch(spark)
    relevant = F.when(F.col("item_id") % 2 == 0, F.array(F.concat(F.lit("c"), F.col("item_id").cast("string"))))
    row = F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), relevant.alias("relevant_chunk_ids"))
    t("benchmark").groupBy((F.col("item_id") % 3).alias("part")).agg(F.to_json(F.collect_list(row)).alias("value")).write.partitionBy("part").text(path)
    return readers.questions(spark, path).select("question_id", "question", F.array_join("relevant", ",").alias("relevant"))


def _wiki(t):
    e = t("nation").select(F.col("n_name").alias("id"), F.concat(F.lit("The "), F.col("n_name")).alias("name"), F.lit("nation").alias("kind"))
    r = t("nation").select(F.col("n_name").alias("source_id"), F.lit("NEAR").alias("relationship_type"), F.concat(F.lit("NATION_"), ((F.col("n_nationkey") + 1) % 25).cast("string")).alias("target_id"))
    return writers.wiki_pages(e, r)


@query("src_12_markdown_pages", "SELECT n_name AS id FROM nation", session=True)
def _(t, spark):
    path = scratch(spark)
    _wiki(t).select("file", F.col("body").alias("value")).write.partitionBy("file").text(path)
    return readers.markdown_pages(spark, path).select("id")


@query("snk_08_wiki_pages", "SELECT n_name AS id, 'The_' || n_name || '.md' AS file, '---' || chr(10) || 'id: ' || n_name || chr(10) || 'kind: nation' || chr(10) || '---' || chr(10) || '# The ' || n_name || chr(10) || '## Relations' || chr(10) || '- NEAR: [[NATION_' || CAST((n_nationkey + 1) % 25 AS VARCHAR) || '|The NATION_' || CAST((n_nationkey + 1) % 25 AS VARCHAR) || ']]' AS body FROM nation")
def _(t):
    return _wiki(t)


def _audit_rows(t, part):
    row = t("events").filter(F.col("event_id") % 2 == part)
    return row.select(F.col("ts").alias("timestamp"), F.col("event_id").cast("string").alias("request_id"), F.col("event_type").alias("user_role"), F.lit("search").alias("action"), F.lit("q").alias("query"), F.array().cast("array<string>").alias("returned_ids"), F.lit(0).cast("long").alias("filtered_count"), F.when(F.col("event_type") == "error", "DENIED").otherwise("OK").alias("status"), F.create_map(F.lit("k"), F.col("props")).alias("metadata"))


@query("src_13_audit_log", "SELECT event_type AS user_role, CASE WHEN event_type = 'error' THEN 'DENIED' ELSE 'OK' END AS status, count(*) AS n FROM events GROUP BY 1, 2", session=True)
def _(t, spark):
    path = scratch(spark)
    for part in (0, 1):
        writers.append_audit(_audit_rows(t, part), path)
    return readers.audit_log(spark, path).groupBy("user_role", "status").agg(F.count(F.lit(1)).alias("n"))


@query("snk_06_append_audit", "SELECT count(*) AS n, count(DISTINCT event_id) AS n_requests, max(ts) AS latest FROM events", session=True)
def _(t, spark):
    path = scratch(spark)
    for part in (0, 1, 0):  # the first batch comes twice
        writers.append_audit(_audit_rows(t, part), path, part)
    return readers.audit_log(spark, path).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("request_id").alias("n_requests"), F.max("timestamp").alias("latest"))


@query("src_14_policy", "SELECT r_name AS role, CAST(r_regionkey AS BIGINT) AS level, 'ALLOW' AS default_policy FROM region UNION ALL SELECT role, level, 'DENY' FROM (VALUES ('Admin', 5), ('Risk_Manager', 4), ('HR', 3), ('Staff', 2), ('Guest', 1)) AS v(role, level)", session=True)
def _(t, spark):
    """A policy written from a table, and the built-in one."""
    path = scratch(spark)
    roles = F.map_from_entries(F.collect_list(F.struct("r_name", F.struct(F.col("r_regionkey").alias("level")))))
    t("region").agg(F.to_json(F.struct(roles.alias("roles"), F.lit("ALLOW").alias("default_policy"))).alias("value")).coalesce(1).write.text(path)
    rows = [(r, v["level"], p["default_policy"]) for p in (readers.policy(spark, path), readers.policy(spark)) for r, v in p["roles"].items()]
    return spark.createDataFrame(rows, "role string, level long, default_policy string")


@query("src_15_cached_vectors", "SELECT doc_id, text IN (SELECT text FROM documents WHERE lang = 'en') AS cached FROM documents")
def _(t):
    cache = t("documents").filter("lang = 'en'").select(F.sha2("text", 256).alias("text_hash")).distinct()
    have, need = readers.cached_vectors(t("documents").select("doc_id", "text"), cache)
    return have.select("doc_id", F.lit(True).alias("cached")).unionByName(need.select("doc_id", F.lit(False).alias("cached")))


@query("src_16_result_csv", "SELECT o_orderpriority AS method, round(avg(o_totalprice), 2) AS mrr FROM orders GROUP BY 1", session=True)
def _(t, spark):
    path = scratch(spark)
    writers.csv_table(t("orders").select(F.col("o_orderpriority").alias("method"), F.col("o_totalprice").alias("mrr")), path)
    return evaluation.means(readers.csv(spark, path, "method string, mrr double"), ["method"], ["mrr"], 2).drop("n")


@query("snk_01_json_table", "SELECT c_custkey, c_name FROM customer", session=True)
def _(t, spark):
    path = scratch(spark)
    writers.json_table(t("customer").select("c_custkey", "c_name"), path)
    return spark.read.schema(t("customer").select("c_custkey", "c_name").schema).json(path)


@query("snk_02_csv_table", "SELECT p_partkey, p_name, p_retailprice FROM part", session=True)
def _(t, spark):
    path = scratch(spark)
    writers.csv_table(t("part").select("p_partkey", "p_name", "p_retailprice"), path)
    return readers.csv(spark, path, "p_partkey long, p_name string, p_retailprice double")


@query("snk_05_vector_upsert", "SELECT vec_id, CASE WHEN label < 5 THEN -1 ELSE label END AS label, CASE WHEN label > 7 THEN -2 WHEN label < 5 THEN -1 ELSE label END AS later FROM embeddings", session=True)
def _(t, spark):
    """Two upserts one after the other, of a table in buckets; the reader of the first isn't disturbed by the second."""
    path = scratch(spark)
    buckets.create(t("embeddings").select("vec_id", "label"), path, ["vec_id"], 16)
    changed = lambda some, to: t("embeddings").filter(some).select("vec_id", F.lit(to).alias("label"))
    first = buckets.upsert_buckets(spark, path, changed("label < 5", -1), [F.col("label")])
    before = buckets.read(spark, path)
    buckets.upsert_buckets(spark, path, changed("label > 7", -2), [F.col("label")])
    assert first == 2
    return before.join(buckets.read(spark, path).withColumnRenamed("label", "later"), "vec_id")


@query("snk_12_changed_files", "WITH b AS (SELECT source, sum(n_chars) AS h FROM documents GROUP BY 1), c AS (SELECT source, sum(n_chars) AS h FROM documents WHERE lang <> 'es' GROUP BY 1) SELECT coalesce(b.source, 'new ' || c.source) AS file, CASE WHEN c.h IS NULL THEN 'deleted' WHEN b.h IS NULL THEN 'added' ELSE 'changed' END AS change FROM b FULL JOIN c ON b.source = c.source WHERE b.h IS DISTINCT FROM c.h")
def _(t):
    """Two manifests of the sources, with and without the texts of one language."""
    told = lambda df: df.groupBy(F.col("source").alias("file")).agg(F.sum("n_chars").cast("string").alias("sha256"))
    return lexical_index.changed_files(told(t("documents")), told(t("documents").filter("lang <> 'es'")))


@query("snk_09_manifest", "SELECT sha256(r_name || chr(10)) AS sha256, CAST(length(r_name) + 1 AS BIGINT) AS bytes, 'flat' AS strategy, CAST(3 AS BIGINT) AS schema_version FROM region", session=True)
def _(t, spark):
    """The hashes of files that hold a name each."""
    path = scratch(spark)
    t("region").select(F.col("r_regionkey").alias("part"), F.col("r_name").alias("value")).repartition("part").write.partitionBy("part").text(path)
    rows = writers.manifest(spark, f"{path}/part=*/part-*", {"k": 60}, 3, "flat")
    return rows.select("sha256", "bytes", "strategy", F.col("schema_version").cast("long").alias("schema_version"))


@query("snk_10_staleness", "SELECT * FROM (VALUES ('fresh', 1), ('config_mismatch', 2), ('missing', 3), ('strategy_mismatch', 4), ('invalid', 5), ('incomplete', 6), ('file_count_mismatch', 7), ('file_hash_mismatch', 8)) AS v(state, step)", session=True)
def _(t, spark):
    """Every state that a store can be in."""
    path, other, store = scratch(spark), scratch(spark), scratch(spark)
    t("region").select(F.col("r_regionkey").alias("part"), F.col("r_name").alias("value")).coalesce(1).write.partitionBy("part").text(path)
    t("nation").coalesce(1).write.parquet(other)
    files = f"{path}/part=*/part-*"
    # files are told apart by their names, which Spark makes from the task: one for all parts, so they are named anew
    named = lambda df: df.withColumn("file", F.concat("file", F.lit("-"), F.substring("sha256", 1, 4)))
    named(writers.manifest(spark, files, {"k": 60})).write.parquet(store)
    built, now = spark.read.parquet(store), named(writers.file_hashes(spark, files))
    changed = now.withColumn("sha256", F.reverse("sha256"))
    fewer = now.join(now.agg(F.min("file").alias("file")), "file", "left_anti")
    states = [
        writers.staleness(built, now, {"k": 60}), writers.staleness(built, now, {"k": 61}), writers.staleness(None, now, {}), writers.staleness(built, now, {"k": 61}, strategy="flat"),
        writers.staleness(built, now, {"k": 60}, 2), writers.staleness(built.limit(0), now, {"k": 60}), writers.staleness(built, fewer, {"k": 60}), writers.staleness(built, changed, {"k": 60}),
    ]
    return spark.createDataFrame([(s, i) for i, s in enumerate(states, 1)], "state string, step int")


@query("snk_11_report", "SELECT '| ' || CAST(n_nationkey AS VARCHAR) || ' | ' || n_name || ' |' AS line FROM nation UNION ALL SELECT * FROM (VALUES ('# Nations'), (''), ('| n_nationkey | n_name |'), ('|---|---|')) AS v(line)", session=True)
def _(t, spark):
    lines = writers.report(t("nation").select("n_nationkey", "n_name"), "Nations").splitlines()
    return spark.createDataFrame([(line,) for line in lines], "line string")


# what is left of chunking, retrieval and evaluation


@query("chk_02_html_clean", "SELECT page_id, false AS has_markup FROM pages")
def _(t):
    """No script, style or tag is left in a page's lines."""
    return t("pages").select("page_id", H.html_lines("html").rlike(r"track\(|margin:0|</?(?:p|div|script)>").alias("has_markup"))


@query("chk_03_block_levels", "SELECT conv_id, turn, CASE WHEN starts_with(text, 'The') THEN 'chapter' WHEN starts_with(text, 'Er') THEN 'section' ELSE 'content' END AS level FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", hierarchy.block_level(F.col("text"), {"chapter": "^The", "section": "^Er"}).alias("level"))


@query("chk_16_mean_pool", "SELECT vec_id, array_to_string(list_transform(range(1, 33), lambda i: CAST(CAST(round((CAST(embedding[i] AS DOUBLE) + CAST(embedding[i + 32] AS DOUBLE)) / 2 * 10000) AS BIGINT) AS VARCHAR)), ',') AS pooled FROM embeddings")
def _(t):
    """The halves of a vector as token vectors, with a masked one between them: all dimensions of the mean."""
    parts = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 17, 32), F.slice("embedding", 33, 32))
    pooled = ranking.mean_pool(parts, F.array(F.lit(1), F.lit(0), F.lit(1)))
    return t("embeddings").select("vec_id", F.array_join(F.transform(pooled, lambda x: F.round(x * 10000).cast("long").cast("string")), ",").alias("pooled"))


#: The four stages of a cascade: documents in Spanish stand in for a semantic list, those in French for a BM25 list.
STAGES = f"""WITH {BM25},
es AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25_score, 9) DESC, doc_id) AS rank FROM bm WHERE bm25_score > 4 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'es')),
fr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25_score, 9) DESC, doc_id) AS rank FROM bm WHERE bm25_score > 4 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr')),
both_ AS (SELECT query_id FROM es INTERSECT SELECT query_id FROM fr),
fu AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, rank, sr NULLS LAST, br NULLS LAST, doc_id) AS rank FROM
  (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS s, min(rank) AS rank, min(sr) AS sr, min(br) AS br FROM (SELECT query_id, doc_id, rank, rank AS sr, NULL AS br FROM es UNION ALL SELECT query_id, doc_id, rank, NULL, rank FROM fr) GROUP BY query_id, doc_id) WHERE query_id IN (SELECT query_id FROM both_)),
su AS (SELECT item_id AS query_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY (length(lower(d.text)) - length(replace(lower(d.text), lower(b.text), ''))) // length(b.text) DESC, doc_id) AS rank FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)))
SELECT query_id, doc_id, rank, CAST(1 AS BIGINT) AS stage FROM fu WHERE rank <= 5 UNION ALL SELECT query_id, doc_id, rank, 2 FROM es WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM both_)
UNION ALL SELECT query_id, doc_id, rank, 3 FROM fr WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM es)
UNION ALL SELECT query_id, doc_id, rank, 4 FROM su WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM es) AND query_id NOT IN (SELECT query_id FROM fr)"""


@query("rnk_12_hybrid_cascade", STAGES)
def _(t):
    """Fused lists, else the semantic one, else BM25, else a search for the whole question."""
    every = _bm25(t, 1 << 30, keep_zero=False).filter("bm25_score > 4").join(t("documents").select("doc_id", "lang"), "doc_id")
    order = Window.partitionBy("query_id", "lang").orderBy(F.round("bm25_score", 9).desc(), "doc_id")
    ranked = cut(every.filter("lang in ('es', 'fr')").withColumn("rank", F.row_number().over(order)))
    es, fr = (ranked.filter(F.col("lang") == x).select("query_id", "doc_id", "rank") for x in ("es", "fr"))
    asked = _questions(t).select("query_id", F.col("question").alias("needle"))
    out = ranking.hybrid_cascade(es, fr, ranking.substring_rank(t("documents"), asked, k=5))
    return _out(out.filter("rank <= 5"), "query_id", "doc_id", "rank", "stage")


@query("rnk_13_indexed_bm25", f"WITH {BM25} SELECT query_id, doc_id, round(bm25_score, 6) AS bm25_score, bm25_rank FROM bm WHERE bm25_rank <= 10", session=True)
def _(t, spark):
    """BM25 from a written index: as rnk_01, without reading the texts, and only blocks that can matter."""
    path = scratch(spark)
    lexical_index.add_documents(t("documents"), F.col("text"), path, words=T.legal_words)
    return _out(lexical_index.search(_questions(t), T.legal_tokens(F.col("question")), path), "query_id", "doc_id", "bm25_score", "bm25_rank")


@query("rnk_14_index_upkeep", f"WITH documents AS (SELECT doc_id, CASE WHEN lang = 'de' THEN text || ' ' || source ELSE text END AS text FROM main.documents WHERE lang <> 'es'), {BM25} SELECT query_id, doc_id, round(bm25_score, 6) AS bm25_score, bm25_rank FROM bm WHERE bm25_rank <= 10", session=True)
def _(t, spark):
    """All documents are indexed, those of one language are replaced by others, those of another are deleted."""
    path = scratch(spark)
    lexical_index.add_documents(t("documents"), F.col("text"), path, words=T.legal_words)
    lexical_index.add_documents(t("documents").filter("lang = 'de'").withColumn("text", F.concat_ws(" ", "text", "source")), F.col("text"), path, words=T.legal_words)
    lexical_index.delete_documents(t("documents").filter("lang = 'es'"), path)
    return _out(lexical_index.search(_questions(t), T.legal_tokens(F.col("question")), path), "query_id", "doc_id", "bm25_score", "bm25_rank")


@query("sel_07_query_failures", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 3")
def _(t):
    """The longest documents of each language, asked for one by one; a language that isn't known is left out."""

    def search(lang):
        if lang == "xx":
            raise ValueError("no such language")
        return t("documents").filter(F.col("lang") == lang).orderBy(F.desc("n_chars"), "doc_id").limit(3).select("lang", "doc_id")

    return fusion.run_queries(["en", "xx", "de", "es", "fr"], search, "en")[0]


@query("joi_15_predicted_truth", "WITH p AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), q AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') SELECT coalesce(p.k, q.k) AS k, CASE WHEN q.k IS NULL THEN 'predicted' WHEN p.k IS NULL THEN 'truth' ELSE 'both' END AS side FROM p FULL JOIN q ON p.k = q.k")
def _(t):
    key = lambda state, c: t("orders").filter(F.col("o_orderstatus") == state).select(F.col("o_custkey").alias("k"), F.lit(1).alias(c)).distinct()
    side = F.when(F.col("__b").isNull(), "predicted").when(F.col("__a").isNull(), "truth").otherwise("both")
    return key("F", "__a").join(key("P", "__b"), "k", "full_outer").select("k", side.alias("side"))


@query("evl_08_lexical_proxy", r"WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS a, list_distinct(regexp_extract_all(lower(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')), '[\p{L}\p{N}]+')) AS c FROM conversations) SELECT conv_id, turn, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, c)) / len(a) ELSE 0 END, 6) AS faithfulness FROM w")
def _(t):
    """How much of a turn's words the turn before holds."""
    rows = t("conversations").withColumn("before", F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")))
    p = evaluation.lexical_proxy(F.col("text"), F.col("before"), F.col("text"))
    return rows.select("conv_id", "turn", F.round(p["faithfulness"], 6).alias("faithfulness"))
