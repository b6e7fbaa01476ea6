"""Joins, aggregations, windows, sets, graphs, relations, security and checks over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import evaluation, fusion, graph, integrity, ranking, relations, security, segments
from docloom.plans.registry import query
from docloom.shared import few, numbered, scratch
from docloom.sources import buckets
from docloom.streaming.audit import windowed_events



# joins


@query("joi_01_inner", "SELECT doc_id, quality, toxic, source FROM documents JOIN labels USING (doc_id)")
def _(t):
    return t("labels").join(t("documents").select("doc_id", "source"), "doc_id").select("doc_id", "quality", "toxic", "source")


@query("joi_02_lookup", "SELECT doc_id, coalesce(CAST(quality AS VARCHAR), '') AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    return t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("quality"))


@query("joi_03_full_outer", "SELECT coalesce(d.doc_id, v.id) AS id, d.doc_id IS NOT NULL AS in_documents, v.id IS NOT NULL AS in_pages FROM documents d FULL JOIN (SELECT page_id * 7 AS id FROM pages) v ON d.doc_id = v.id")
def _(t):
    a = t("documents").select(F.col("doc_id").alias("id"), F.lit(True).alias("in_documents"))
    b = t("pages").select((F.col("page_id") * 7).alias("id"), F.lit(True).alias("in_pages"))
    return a.join(b, "id", "full_outer").fillna(False)


@query("joi_05_left_gate", "SELECT d.doc_id, e.label, e.label IS NOT NULL AND e.label < 5 AS accepted FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def _(t):
    e = t("embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return t("documents").select("doc_id").join(e, "doc_id", "left").withColumn("accepted", F.coalesce(F.col("label") < 5, F.lit(False)))


@query("joi_06_contained", "SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)")
def _(t):
    return relations.contained_in(t("documents"), t("benchmark").withColumnRenamed("text", "pattern"))


@query("joi_07_entity_number", "SELECT s_suppkey, coalesce(number, CAST(s_suppkey AS VARCHAR)) AS number FROM supplier LEFT JOIN (SELECT l_partkey, min(CAST(l_orderkey AS VARCHAR)) AS number FROM lineitem GROUP BY l_partkey) ON l_partkey = s_suppkey")
def _(t):
    first = t("lineitem").groupBy(F.col("l_partkey").alias("s_suppkey")).agg(F.min(F.col("l_orderkey").cast("string")).alias("number"))
    return t("supplier").select("s_suppkey").join(first, "s_suppkey", "left").select("s_suppkey", F.coalesce("number", F.col("s_suppkey").cast("string")).alias("number"))


ENDS = "e AS (SELECT o_orderkey AS edge_id, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS target FROM orders)"


@query("joi_08_id_or_number", f"WITH {ENDS} SELECT DISTINCT edge_id, c_custkey AS document_id FROM e JOIN customer ON target = CAST(c_custkey AS VARCHAR) OR target = c_name")
def _(t):
    key = F.col("o_custkey").cast("string")
    edges = t("orders").select(F.col("o_orderkey").alias("edge_id"), F.when(F.col("o_orderkey") % 2 == 0, key).otherwise(F.concat(F.lit("Customer#"), F.lpad(key, 9, "0"))).alias("target"))
    return relations.by_id_or_number(edges, t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("number"))).select("edge_id", "document_id")


@query("joi_09_broken_keys", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def _(t):
    return integrity.broken_references(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", t("supplier"), "s_suppkey").select("l_orderkey", "l_linenumber")


@query("joi_10_without", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return integrity.without(t("documents").select("doc_id"), "doc_id", t("labels"), "doc_id")


@query("joi_11_two_hops", "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def _(t):
    met = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return met.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


# aggregations


@query("agg_01_means", "SELECT toxic, count(*) AS n, round(avg(quality), 4) AS quality FROM labels GROUP BY toxic")
def _(t):
    return evaluation.means(t("labels"), ["toxic"], ["quality"])


@query("agg_02_means_by_sets", "SELECT lang, source, count(*) AS n, round(avg(quality), 4) AS quality FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), (lang, source))")
def _(t):
    rows = t("labels").join(t("documents").select("doc_id", "lang", "source"), "doc_id")
    return evaluation.means_by_sets(rows, [["lang"], ["lang", "source"]], ["quality"])


@query("agg_03_four_metrics", "SELECT l_returnflag, round(avg(l_quantity), 4) AS quantity, round(avg(l_discount), 4) AS discount, round(avg(l_tax), 4) AS tax, round(avg(l_linenumber), 4) AS line, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def _(t):
    rows = t("lineitem").select("l_returnflag", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_linenumber").alias("line"))
    return evaluation.means(rows, ["l_returnflag"], ["quantity", "discount", "tax", "line"])


@query("agg_04_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    return integrity.value_counts(t("events"), "event_type")


@query("agg_05_profile", "SELECT 'c_mktsegment' AS \"column\", count(*) FILTER (WHERE c_mktsegment IS NULL) AS n_null, count(*) FILTER (WHERE trim(c_mktsegment) = '') AS n_empty, CAST(0 AS BIGINT) AS n_marked FROM customer UNION ALL SELECT 'c_acctbal', count(*) FILTER (WHERE c_acctbal IS NULL), 0, 0 FROM customer")
def _(t):
    return integrity.profile(t("customer"), ["c_mktsegment", "c_acctbal"])


@query("agg_06_duplicates", "SELECT count(*) AS n_rows, count(DISTINCT text) AS n_keys, count(*) - count(DISTINCT text) AS n_repeats FROM documents")
def _(t):
    return integrity.duplicates(t("documents"), ["text"])


@query("agg_07_distinct", "SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT event_type) AS n_types FROM events")
def _(t):
    return t("events").agg(F.countDistinct("user_id").alias("n_users"), F.countDistinct("event_type").alias("n_types"))


@query("agg_08_roles_of_documents", "SELECT source AS document_id, CASE WHEN bool_or(doc_id % 3 = 0) AND bool_or(doc_id % 3 <> 0) THEN 'Admin,HR,Staff' WHEN bool_or(doc_id % 3 = 0) THEN 'Admin,HR' ELSE 'Admin,Staff' END AS roles FROM documents GROUP BY source")
def _(t):
    roles = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("HR"), F.lit("Admin"))).otherwise(F.array(F.lit("Staff"), F.lit("Admin")))
    rows = t("documents").select(F.col("source").alias("document_id"), roles.alias("allowed_roles"))
    return security.roles_of_documents(rows).select("document_id", F.array_join("allowed_roles", ",").alias("roles"))


@query("agg_09_label_counts", "SELECT 'customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'nation', count(*) FROM nation")
def _(t):
    rows = None
    for name in ("customer", "supplier", "nation"):
        part = t(name).select(F.lit(name).alias("label"))
        rows = part if rows is None else rows.unionByName(part)
    return integrity.value_counts(rows, "label")


@query("agg_10_collected", "SELECT n_regionkey, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS names FROM nation GROUP BY n_regionkey")
def _(t):
    return integrity.collected(t("nation"), ["n_regionkey"], {"names": F.col("n_name")}).select("n_regionkey", F.array_join("names", ",").alias("names"))


#: Sources stand for security classes.
TAGGED = "tagged AS (SELECT *, CASE WHEN contains(lower(source), 'src1') OR contains(lower(text), 'with') THEN 'HR' WHEN contains(lower(source), 'src2') OR contains(lower(text), 'ist ') THEN 'RISK' ELSE 'GENERAL' END AS security_class FROM documents), roled AS (SELECT *, CASE security_class WHEN 'HR' THEN ['Admin', 'HR'] WHEN 'RISK' THEN ['Admin', 'Risk_Manager', 'Staff'] ELSE ['Admin', 'Risk_Manager', 'HR', 'Staff', 'Guest'] END AS allowed_roles FROM tagged)"
RULES = (("HR", ("src1",), ("with",)), ("RISK", ("src2",), ("ist ",)))


def _roled(t):
    rows = t("documents").withColumn("security_class", security.tag(F.col("source"), F.col("text"), RULES))
    return rows.withColumn("allowed_roles", security.allowed_roles(F.col("security_class")))


@query("agg_11_role_counts", f"WITH {TAGGED}, r AS (SELECT unnest(allowed_roles) AS role FROM roled) SELECT role, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM documents), 2) AS percent FROM r GROUP BY role")
def _(t):
    return security.role_counts(_roled(t))


@query("agg_12_class_shares", f"WITH {TAGGED} SELECT security_class, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM documents), 2) AS percent FROM roled GROUP BY security_class")
def _(t):
    return security.class_shares(_roled(t))


@query("agg_13_inventory", "SELECT conv_id AS document_id, min(turn) AS chunk_id, min_by(role, turn) AS role FROM conversations GROUP BY conv_id")
def _(t):
    rows = t("conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_id"), "role")
    return security.inventory(rows)


@query("agg_14_report", "SELECT o_orderpriority AS mode, round(avg(o_totalprice), 2) AS price, round(avg(o_custkey), 1) AS customer FROM orders GROUP BY o_orderpriority")
def _(t):
    return t("orders").groupBy(F.col("o_orderpriority").alias("mode")).agg(F.round(F.avg("o_totalprice"), 2).alias("price"), F.round(F.avg("o_custkey"), 1).alias("customer"))


@query("agg_15_link_counts", "WITH l AS (SELECT n_name AS src, 'NATION_' || CAST((n_nationkey * 2) % 30 AS VARCHAR) AS dst FROM nation) SELECT n_name AS id, CAST(1 AS BIGINT) AS n_out, CAST((SELECT count(*) FROM l WHERE dst = n_name) AS BIGINT) AS n_in, CAST(CASE WHEN (n_nationkey * 2) % 30 > 24 THEN 1 ELSE 0 END AS BIGINT) AS n_broken FROM nation")
def _(t):
    body = F.concat(F.lit("see [[NATION_"), (F.col("n_nationkey") * 2 % 30).cast("string"), F.lit("|it]]"))
    return integrity.link_check(t("nation").select(F.col("n_name").alias("id"), body.alias("body")))


# windows, order, distinct, sets


@query("win_01_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t("orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("win_03_next", "SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next_turn"))


@query("win_04_carry", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events")
def _(t):
    rows = t("events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("bought"))
    return segments.carry_forward(rows, ["user_id"], [F.col("ts"), F.col("event_id")], {"bought": "last_purchase"}).select("event_id", "last_purchase")


@query("win_06_top_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t("orders").withColumn("n", F.row_number().over(w)).filter("n <= 3").select("o_custkey", "o_orderkey")


@query("win_07_first_per_group", "SELECT user_id, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def _(t):
    return relations.first_rows(t("events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@query("srt_01_nulls_last", "SELECT doc_id, row_number() OVER (ORDER BY quality NULLS LAST, doc_id) AS place FROM (SELECT doc_id, CASE WHEN toxic = 0 THEN quality END AS quality FROM labels)")
def _(t):
    rows = t("labels").select("doc_id", F.when(F.col("toxic") == 0, F.col("quality")).alias("quality"))
    return numbered(rows, F.col("quality").asc_nulls_last(), F.col("doc_id")).select("doc_id", "place")


@query("srt_03_query_ids", "SELECT query_id, row_number() OVER (ORDER BY CASE WHEN regexp_matches(query_id, '^Q[0-9]+$') THEN CAST(substr(query_id, 2) AS BIGINT) ELSE 1000000 END, query_id) AS place FROM (SELECT CASE WHEN n_nationkey % 7 = 0 THEN n_name ELSE 'Q' || CAST(n_nationkey AS VARCHAR) END AS query_id FROM nation)")
def _(t):
    key = F.when(F.col("n_nationkey") % 7 == 0, F.col("n_name")).otherwise(F.concat(F.lit("Q"), F.col("n_nationkey").cast("string")))
    number = F.when(F.col("query_id").rlike("^Q[0-9]+$"), F.substring("query_id", 2, 20).cast("long")).otherwise(1000000)
    return numbered(t("nation").select(key.alias("query_id")), number, F.col("query_id")).select("query_id", "place")


@query("top_02_limit_ordered", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 25")
def _(t):
    return t("events").orderBy(F.desc("ts"), "event_id").limit(25).select("event_id")


@query("dst_01_keep_first", "SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY source, lang")
def _(t):
    return relations.first_rows(t("documents"), ["source", "lang"], [F.col("doc_id")]).select("source", "lang", "doc_id")


@query("dst_02_list_distinct", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = o_custkey % 3 THEN CAST(o_orderkey % 3 AS VARCHAR) ELSE CAST(o_orderkey % 3 AS VARCHAR) || ',' || CAST(o_custkey % 3 AS VARCHAR) END AS ids FROM orders")
def _(t):
    a, b = (F.col("o_orderkey") % 3).cast("string"), (F.col("o_custkey") % 3).cast("string")
    return t("orders").select("o_orderkey", F.array_join(F.array_distinct(F.array(a, b, a)), ",").alias("ids"))


@query("dst_03_distinct", "SELECT DISTINCT l_shipdate, l_returnflag FROM lineitem")
def _(t):
    return t("lineitem").select("l_shipdate", "l_returnflag").distinct()


PAIRS = "p AS (SELECT DISTINCT l_suppkey AS a, l_quantity AS b FROM lineitem WHERE l_returnflag = 'R'), q AS (SELECT DISTINCT l_suppkey AS a, l_quantity AS b FROM lineitem WHERE l_returnflag = 'A')"


def _pairs(t, flag):
    return t("lineitem").filter(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("a"), F.col("l_quantity").alias("b"))


@query("set_01_intersect", f"WITH {PAIRS} SELECT a, b FROM p INTERSECT SELECT a, b FROM q")
def _(t):
    return _pairs(t, "R").intersect(_pairs(t, "A"))


@query("set_02_precedence_union", "SELECT o_custkey AS a, o_orderkey AS b FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    rows = lambda state: t("orders").filter(F.col("o_orderstatus") == state).select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"))
    return relations.precedence_union(rows("F"), rows("P"), ["a"])


@query("set_03_concat", "SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region")
def _(t):
    return t("nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind")).unionByName(t("region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind")))


@query("set_04_minus_seeds", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(t):
    return t("documents").select("doc_id").join(t("embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("set_05_key_differences", "SELECT doc_id AS id, 'first' AS only_in FROM documents WHERE doc_id NOT IN (SELECT page_id * 3 FROM pages) UNION ALL SELECT page_id * 3, 'second' FROM pages WHERE page_id * 3 NOT IN (SELECT doc_id FROM documents)")
def _(t):
    return integrity.key_differences(t("documents").select(F.col("doc_id").alias("id")), t("pages").select((F.col("page_id") * 3).alias("id")), "id")


@query("evl_05_relation_scores", f"WITH {PAIRS}, c AS (SELECT (SELECT count(*) FROM p JOIN q USING (a, b)) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM q) AS nq) SELECT tp, np - tp AS fp, nq - tp AS fn, round(tp / np, 6) AS precision, round(tp / nq, 6) AS recall, round(2 * tp / (np + nq), 6) AS f1 FROM c")
def _(t):
    out = evaluation.relation_scores(_pairs(t, "R"), _pairs(t, "A"), ["a", "b"])
    return out.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("flt_08_low_scores", "SELECT l_orderkey, l_linenumber, concat_ws('; ', CASE WHEN l_discount < 0.02 THEN 'discount' END, CASE WHEN l_tax < 0.02 THEN 'tax' END) AS causes FROM lineitem WHERE l_discount < 0.02 OR l_tax < 0.02")
def _(t):
    return evaluation.low_scores(t("lineitem"), {"l_discount": "discount", "l_tax": "tax"}, 0.02).select("l_orderkey", "l_linenumber", "causes")


# graphs: nations are nodes, each linked to two others

EDGES = "edges AS (SELECT n_name AS src, 'NATION_' || CAST((n_nationkey + 3) % 25 AS VARCHAR) AS dst, 'A' AS kind, n_nationkey AS edge_id FROM nation UNION ALL SELECT n_name, 'NATION_' || CAST(n_nationkey * 2 % 25 AS VARCHAR), 'B', n_nationkey + 100 FROM nation WHERE n_nationkey > 0)"
TRAILS = f"""WITH RECURSIVE {EDGES}, bi AS (SELECT src AS f, dst AS t, kind, edge_id FROM edges UNION ALL SELECT dst, src, kind, edge_id FROM edges),
w AS (SELECT n_name AS seed, n_name AS node, 0 AS hop, CAST([] AS VARCHAR[]) AS path, CAST([] AS BIGINT[]) AS used FROM nation
UNION ALL SELECT seed, t, hop + 1, list_append(path, kind), list_append(used, CAST(edge_id AS BIGINT)) FROM w JOIN bi ON f = node WHERE hop < 2 AND NOT list_contains(used, edge_id)),
trails AS (SELECT DISTINCT seed, node, hop, array_to_string(path, '>') AS path FROM w WHERE hop > 0 AND node <> seed)"""


def _edges(t):
    n = t("nation")
    name = lambda c: F.concat(F.lit("NATION_"), c.cast("string")).alias("dst")
    a = n.select(F.col("n_name").alias("src"), name((F.col("n_nationkey") + 3) % 25), F.lit("A").alias("kind"), F.col("n_nationkey").cast("long").alias("edge_id"))
    b = n.filter("n_nationkey > 0").select(F.col("n_name").alias("src"), name(F.col("n_nationkey") * 2 % 25), F.lit("B").alias("kind"), (F.col("n_nationkey") + 100).cast("long").alias("edge_id"))
    return a.unionByName(b)


def _trails(t, hops=2):
    return graph.expand(t("nation").select(F.col("n_name").alias("node")), _edges(t), hops)


@query("grf_01_expand", TRAILS + " SELECT seed, node, CAST(hop AS BIGINT) AS hop, path FROM trails")
def _(t):
    return _trails(t).select("seed", "node", F.col("hop").cast("long").alias("hop"), F.array_join("path", ">").alias("path"))


@query("joi_12_seeds_to_items", TRAILS + ", m AS (SELECT seed, hop, s_suppkey, row_number() OVER (PARTITION BY seed ORDER BY hop, s_suppkey, path) AS place FROM trails JOIN nation ON n_name = node JOIN supplier ON s_nationkey = n_nationkey) SELECT seed, s_suppkey, place FROM m WHERE place <= 10")
def _(t):
    items = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("node"), "s_suppkey")
    return graph.expand_to_items(t("nation").select(F.col("n_name").alias("node")), _edges(t), items, 2, key="s_suppkey").select("seed", "s_suppkey", F.col("place").cast("long").alias("place"))


@query("grf_02_hop_summary", TRAILS + " SELECT CAST(hop AS BIGINT) AS hop, count(DISTINCT node) AS n_nodes, count(*) AS n_trails FROM trails GROUP BY hop")
def _(t):
    return graph.hop_summary(_trails(t)).select(F.col("hop").cast("long").alias("hop"), "n_nodes", "n_trails")


@query("grf_03_hints", f"WITH {EDGES}, able AS (SELECT n_name FROM nation WHERE n_nationkey % 4 <> 1) SELECT src, kind, dst FROM edges WHERE src IN (FROM able) AND dst IN (FROM able) ORDER BY src, kind, dst LIMIT 10")
def _(t):
    roles = F.when(F.col("n_nationkey") % 4 == 1, F.array(F.lit("HR"))).when(F.col("n_nationkey") % 4 == 2, F.lit(None)).otherwise(F.array(F.lit("Staff")))
    nodes = t("nation").select(F.col("n_name").alias("node"), roles.alias("allowed_roles"))
    seeds = t("nation").select(F.col("n_name").alias("node"))
    return graph.hints(seeds, _edges(t), nodes, ["Staff"]).select("src", "kind", "dst")


@query("grf_04_chain", "SELECT a.conv_id, a.turn, b.turn AS next, b.turn - a.turn AS distance FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM conversations) a JOIN (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM conversations) b ON a.conv_id = b.conv_id AND b.turn - a.turn BETWEEN 1 AND 3")
def _(t):
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long") - 1
    rows = t("conversations").withColumn("turn", place).withColumn("key", F.struct("conv_id", "turn"))
    return graph.chain(rows, ["conv_id"], ["turn"], "key").select("key.conv_id", "key.turn", F.col("next.turn").alias("next"), F.col("distance").cast("long").alias("distance"))


@query("grf_05_containment", "SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def _(t):
    return t("nation").join(few(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")


@query("grf_06_orphans", """WITH e AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders WHERE o_orderpriority = '1-URGENT'),
n AS (SELECT 'c' || c_custkey AS node FROM customer UNION ALL SELECT 'o' || o_orderkey FROM orders)
SELECT node FROM n WHERE node NOT IN (SELECT src FROM e) AND node NOT IN (SELECT dst FROM e)""")
def _(t):
    """Customers without an urgent order, and orders that aren't urgent."""
    named = lambda c: F.concat(F.lit(c[0]), F.col(c).cast("string"))
    nodes = t("customer").select(named("c_custkey").alias("node")).union(t("orders").select(named("o_orderkey")))
    edges = t("orders").filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), named("o_orderkey").alias("dst"))
    return graph.orphans(nodes, edges)


@query("grf_07_neighbourhood", """WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(CAST(qv AS DOUBLE[]), CAST(qv AS DOUBLE[]))), 9) AS sim FROM embeddings CROSS JOIN q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS place FROM s),
n AS (SELECT query_id, vec_id % 25 AS node FROM r WHERE place <= 5)
SELECT query_id, node, coalesce(array_to_string(list_sort(list(DISTINCT s_suppkey) FILTER (WHERE s_suppkey IS NOT NULL)), ','), '') AS first, coalesce(array_to_string(list_sort(list(DISTINCT l_partkey) FILTER (WHERE l_partkey IS NOT NULL)), ','), '') AS second
FROM (SELECT DISTINCT query_id, node FROM n) LEFT JOIN supplier ON s_nationkey = node LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY query_id, node""")
def _(t):
    """Nations that stand for the nearest vectors of each question, their suppliers, and what these have delivered."""
    from docloom.plans.ranking_queries import vector_search

    seeds = vector_search(t, 5).select("query_id", (F.col("vec_id") % 25).alias("node"))
    first = t("supplier").select(F.col("s_nationkey").cast("long").alias("src"), F.col("s_suppkey").alias("dst"))
    second = t("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return graph.seed_neighbourhood(seeds, first, second, by=["query_id"], joined=",")


@query("grf_08_review_queue", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    status = F.when(F.col("o_orderstatus") == "P", "PROPOSED").when(F.col("o_orderstatus") == "O", F.lit(None)).otherwise("VERIFIED")
    return graph.review_queue(t("orders").withColumn("status", status), confidence="o_totalprice").select("o_orderkey", "o_totalprice")


UPSERTED = "SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'changed' ELSE c_mktsegment END AS value FROM customer UNION ALL SELECT -1 - r_regionkey, 'new' FROM region"


def _upserted(t, times=1):
    """Through a table in buckets, of which the changes rewrite those that they touch."""
    rows = t("customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_mktsegment").alias("value"))
    changes = t("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("long").alias("id"), F.lit("changed").alias("value"))
    changes = changes.unionByName(t("region").select((-1 - F.col("r_regionkey")).cast("long").alias("id"), F.lit("new").alias("value")))
    spark = rows.sparkSession
    path = scratch(spark)
    buckets.create(rows, path, ["id"], 16)
    for _ in range(times):
        buckets.upsert_buckets(spark, path, changes, [F.col("value")])
    return buckets.read(spark, path)


@query("snk_03_upsert", UPSERTED)
def _(t):
    return _upserted(t)


@query("grf_09_idempotent", UPSERTED)
def _(t):
    return _upserted(t, 2)


@query("grf_10_reconcile", "WITH a AS (SELECT o_orderstatus AS kind, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT l_linestatus AS kind, count(*) AS n FROM lineitem GROUP BY 1) SELECT coalesce(a.kind, b.kind) AS kind, coalesce(a.n, 0) AS in_table, coalesce(b.n, 0) AS in_graph, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) <= 100 AS agrees FROM a FULL JOIN b ON a.kind = b.kind")
def _(t):
    return graph.reconcile(t("orders").select(F.col("o_orderstatus").alias("kind")), t("lineitem").select(F.col("l_linestatus").alias("kind")), "kind", 100)


@query("snk_04_stub_nodes", "SELECT DISTINCT 'NATION_' || CAST((n_nationkey * 2) % 30 AS VARCHAR) AS node FROM nation WHERE (n_nationkey * 2) % 30 > 24")
def _(t):
    edges = t("nation").select(F.col("n_name").alias("src"), F.concat(F.lit("NATION_"), (F.col("n_nationkey") * 2 % 30).cast("string")).alias("dst"))
    return graph.stub_nodes(t("nation").select(F.col("n_name").alias("node")), edges)


# relations and entities


@query("etl_03_entity_edges", "SELECT CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS source, c_mktsegment AS target, 'THUOC_LINH_VUC' AS relationship_type FROM customer")
def _(t):
    entities = t("customer").select(F.col("c_custkey").cast("string").alias("source_doc_id"), F.col("c_mktsegment").alias("canonical_name"), F.lit("LinhVuc").alias("entity_type"), F.lit(0.9).alias("confidence"))
    docs = t("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(" ").alias("number"))
    return relations.entity_edges(entities, docs).select("source", "target", "relationship_type")


@query("etl_04_split_edges", "SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS source, trim(x) AS target FROM (SELECT p_partkey, unnest(string_split(replace(p_name, ' ', ' ; '), ';')) AS x FROM part) WHERE trim(x) <> ''")
def _(t):
    rows = t("part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(" ; ")).alias("names"))
    return relations.split_edges(rows, "p_partkey", "names", "HAS").select("source", "target")


@query(
    "etl_05_validate_edges",
    """WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'C' || CAST(o_custkey AS VARCHAR) END AS source, CASE WHEN o_orderkey % 17 = 0 THEN 'c' || CAST(o_custkey AS VARCHAR) ELSE 'T' || CAST(o_orderkey % 3 AS VARCHAR) END AS target, CASE WHEN o_orderkey % 19 = 0 THEN 'ODD' ELSE 'LINK' END AS relationship_type, CASE WHEN o_orderkey % 23 = 0 THEN 'nan' ELSE 'seen' END AS evidence FROM orders),
f AS (SELECT *, concat_ws('; ', CASE WHEN source = '' THEN 'missing_source' END, CASE WHEN relationship_type = 'ODD' THEN 'unknown_type' END, CASE WHEN source <> '' AND upper(source) = upper(target) THEN 'self_loop' END, CASE WHEN evidence = 'nan' THEN 'missing_evidence' END) AS r FROM e),
g AS (SELECT *, coalesce(sum(CASE WHEN r = '' THEN 1 ELSE 0 END) OVER (PARTITION BY upper(source), upper(target), relationship_type ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM f)
SELECT o_orderkey, CASE WHEN r = '' AND earlier = 0 THEN 'PASS' ELSE 'FAIL' END AS status, concat_ws('; ', CASE WHEN r <> '' THEN r END, CASE WHEN earlier > 0 THEN 'duplicate' END) AS reasons FROM g""",
)
def _(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    e = t("orders").select(
        "o_orderkey", F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("C"), c)).alias("source"), F.when(k % 17 == 0, F.concat(F.lit("c"), c)).otherwise(F.concat(F.lit("T"), (k % 3).cast("string"))).alias("target"),
        F.when(k % 19 == 0, "ODD").otherwise("LINK").alias("relationship_type"), F.when(k % 23 == 0, "nan").otherwise("seen").alias("evidence"),
    )
    out = relations.validate_edges(e, ["LINK"], [F.col("o_orderkey")])
    return out.select("o_orderkey", "status", F.array_join("reasons", "; ").alias("reasons"))


@query("etl_06_entities", "SELECT CAST(c_custkey AS VARCHAR) AS document_id, c_mktsegment AS entity, 'segment' AS entity_type FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, 'name' FROM customer UNION ALL SELECT CAST(event_id AS VARCHAR), 'k' || CAST(json_extract(props, '$.k') AS VARCHAR), 'key' FROM events")
def _(t):
    rows = t("customer").select(F.col("c_custkey").alias("id"), "c_name", F.when(F.col("c_custkey") % 5 == 0, "Chưa phân loại").otherwise(F.col("c_mktsegment")).alias("segment"))
    a = relations.entities_from_metadata(rows, {"segment": "segment", "c_name": "name"})
    answer = F.concat(F.lit('Here: {"entities": [{"name": "k'), F.get_json_object("props", "$.k"), F.lit('", "type": "key"}]} done'))
    b = relations.entities_from_json(t("events").select(F.col("event_id").alias("id"), answer.alias("answer")))
    return a.unionByName(b).select("document_id", "entity", "entity_type")


@query("etl_07_dedup_entities", "WITH d AS (SELECT DISTINCT CAST(n_regionkey AS VARCHAR) AS document_id, substring(n_name, 1, 8) AS canonical_name FROM nation) SELECT document_id, canonical_name, printf('ENT_NAT_%04d', row_number() OVER (ORDER BY canonical_name, document_id)) AS entity_id FROM d")
def _(t):
    rows = t("nation").select(F.col("n_regionkey").cast("string").alias("document_id"), F.lit("nation").alias("entity_type"), F.col("n_name").alias("entity"), F.lit(0.9).alias("confidence"))
    return relations.dedup_entities(rows, F.substring("entity", 1, 8)).select("document_id", "canonical_name", "entity_id")


# security


@query("sec_01_tags", f"WITH {TAGGED} SELECT doc_id, security_class, array_to_string(allowed_roles, ',') AS roles FROM roled")
def _(t):
    return _roled(t).select("doc_id", "security_class", F.array_join("allowed_roles", ",").alias("roles"))


@query("sec_02_fallback_role", f"WITH {TAGGED} SELECT doc_id FROM roled WHERE list_contains(allowed_roles, 'Guest')")
def _(t):
    return security.accessible(_roled(t), "nobody", fallback="Guest").select("doc_id")


@query("sec_03_deny", f"WITH {TAGGED} SELECT 'Staff' AS asked, doc_id FROM roled WHERE list_contains(allowed_roles, 'Staff')")
def _(t):
    """An unknown role sees nothing, where a known one sees its documents."""
    rows = _roled(t)
    return security.accessible(rows, "nobody").select(F.lit("nobody").alias("asked"), "doc_id").union(security.accessible(rows, "staff").select(F.lit("Staff").alias("asked"), "doc_id"))


@query("sec_04_mask", f"WITH {TAGGED} SELECT doc_id FROM roled WHERE list_contains(allowed_roles, 'Staff') OR list_contains(allowed_roles, 'HR')")
def _(t):
    return security.accessible(_roled(t), ["staff", "HR"]).select("doc_id")


def _secure_sql(body):
    from docloom.plans.ranking_queries import BM25

    return f"WITH {TAGGED}, {BM25}, sb AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25_score, 9) DESC, doc_id) AS bm25_rank FROM bm WHERE doc_id IN (SELECT doc_id FROM roled WHERE list_contains(allowed_roles, 'Staff'))) {body}"


def _secure_bm25(t, k=10):
    from docloom.plans.ranking_queries import _questions

    able = security.accessible(_roled(t), "Staff").select("doc_id")
    return ranking.bm25(t("documents"), _questions(t), F.col("text"), T.legal_tokens(F.col("question")), k=k, visible=able, keep_zero=False, words=T.legal_words)


@query("sec_05_secure_bm25", _secure_sql("SELECT query_id, doc_id, bm25_rank FROM sb WHERE bm25_rank <= 10"))
def _(t):
    return _secure_bm25(t).select("query_id", "doc_id", F.col("bm25_rank").cast("long").alias("bm25_rank"))


@query("sec_06_secure_dense", f"WITH {TAGGED}, q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(CAST(qv AS DOUBLE[]), CAST(qv AS DOUBLE[]))), 9) AS sim FROM embeddings CROSS JOIN q WHERE vec_id IN (SELECT doc_id FROM roled WHERE list_contains(allowed_roles, 'Staff'))), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS place FROM s) SELECT query_id, vec_id, place FROM r WHERE place <= 10")
def _(t):
    able = security.accessible(_roled(t), "Staff").select(F.col("doc_id").alias("vec_id"))
    from docloom.plans.ranking_queries import vector_search

    return vector_search(t, 10, visible=able).select("query_id", "vec_id", F.col("semantic_rank").cast("long").alias("place"))


@query("sec_07_secure_hybrid", _secure_sql(", x AS (SELECT query_id, doc_id, 1.0 / (60 + bm25_rank) AS s FROM sb WHERE bm25_rank <= 20) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, doc_id) AS fused_rank FROM x"))
def _(t):
    a = _secure_bm25(t, 20)
    none = a.filter(F.lit(False)).select("query_id", "doc_id", F.col("bm25_rank").alias("semantic_rank"))
    return fusion.fuse(a, none).select("query_id", "doc_id", F.col("fused_rank").cast("long").alias("fused_rank"))


@query("sec_08_audit_event", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'DENIED' ELSE 'OK' END AS status, '***' AS secret FROM orders")
def _(t):
    returned = F.when(F.col("o_orderstatus") == "F", F.array().cast("array<string>")).otherwise(F.array(F.col("o_orderpriority")))
    out = security.audit_event(t("orders"), F.lit("search"), F.lit("Staff"), F.lit("q"), returned, F.lit(0), request=F.col("o_orderkey").cast("string"), metadata=F.create_map(F.lit("auth_header"), F.col("o_orderpriority")))
    return out.select(F.col("request_id").cast("long").alias("o_orderkey"), "status", F.col("metadata")["auth_header"].alias("secret"))


@query("sec_09_leakage", f"WITH {TAGGED}, h AS (SELECT doc_id % 5 AS case_id, CASE WHEN doc_id % 2 = 0 THEN 'Staff' ELSE 'Guest' END AS role, allowed_roles FROM roled) SELECT case_id, role, count(*) AS n_hits, count(*) FILTER (WHERE NOT list_contains(allowed_roles, role)) AS n_unauthorised, count(*) FILTER (WHERE NOT list_contains(allowed_roles, role)) = 0 AS passes FROM h GROUP BY case_id, role")
def _(t):
    hits = t("documents").select((F.col("doc_id") % 5).alias("case_id"), F.when(F.col("doc_id") % 2 == 0, "Staff").otherwise("Guest").alias("role"), "doc_id")
    return security.leakage(hits, _roled(t))


@query("sec_10_policy_answer", f"WITH {TAGGED} SELECT lang AS query_id, CASE WHEN bool_or(list_contains(allowed_roles, 'Guest')) THEN 'answered' ELSE 'denied' END AS status, count(*) FILTER (WHERE NOT list_contains(allowed_roles, 'Guest')) AS filtered_count FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM roled) WHERE rank <= 5 GROUP BY lang")
def _(t):
    hits = _roled(t).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).filter("rank <= 5").withColumn("query_id", F.col("lang")).withColumn("citation", F.col("source"))
    return security.policy_answer(hits, "Guest").select("query_id", "status", "filtered_count")


@query("sec_11_gaps", "WITH e AS (SELECT o_custkey AS id, o_orderkey AS internal_id, o_totalprice / 500000 AS score FROM orders WHERE o_custkey % 2 = 0), b AS (SELECT id, max(score) AS confidence FROM e GROUP BY id) SELECT c_custkey AS requirement_id, CASE WHEN confidence IS NULL THEN 'CHUA_DU_BANG_CHUNG' WHEN confidence >= 0.6 THEN 'DAP_UNG' WHEN confidence >= 0.3 THEN 'CHENH_LECH' ELSE 'THIEU' END AS classification FROM customer LEFT JOIN b ON id = c_custkey")
def _(t):
    evidence = t("orders").filter("o_custkey % 2 = 0").select(F.col("o_custkey").alias("requirement_id"), F.col("o_orderkey").alias("internal_id"), (F.col("o_totalprice") / 500000).alias("score"))
    return security.gaps(t("customer").select(F.col("c_custkey").alias("requirement_id")), evidence).select("requirement_id", "classification")


@query("sec_12_origin", "SELECT page_id, CASE WHEN contains(url, 'example.net') THEN 'internal' ELSE 'external' END AS origin FROM pages")
def _(t):
    return t("pages").select("page_id", security.origin(F.lit(None).cast("string"), F.col("url"), ("example.net",)).alias("origin"))


@query("snk_07_sealed_round_trip", "SELECT c_custkey, c_name AS opened FROM customer")
def _(t):
    key = F.lit("0123456789abcdef").cast("binary")
    return t("customer").select("c_custkey", security.opened(security.sealed(F.col("c_name"), key), key).alias("opened"))


@query("src_08_roles_json", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'HR,Staff' ELSE 'Admin' END AS roles FROM nation")
def _(t):
    text = F.when(F.col("n_nationkey") % 2 == 0, F.lit('["HR", "Staff"]')).otherwise(F.lit("['Admin']"))
    return t("nation").select("n_nationkey", F.array_join(security.parse_roles(text), ",").alias("roles"))


@query("src_09_roles_tolerant", "SELECT n_nationkey, 'HR,Staff' AS roles FROM nation")
def _(t):
    text = F.when(F.col("n_nationkey") % 2 == 0, F.lit("HR, Staff")).otherwise(F.lit("[HR,'Staff']"))
    return t("nation").select("n_nationkey", F.array_join(security.parse_roles(text), ",").alias("roles"))


# checks


@query("dq_01_corpus", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE trim(text) = '') AS n_without_text, (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)) AS n_repeated_ids FROM documents")
def _(t):
    return integrity.corpus_check(t("documents"))


@query("dq_02_broken_links", "SELECT n_name AS id FROM nation WHERE (n_nationkey * 2) % 30 > 24")
def _(t):
    body = F.concat(F.lit("[["), F.concat(F.lit("NATION_"), (F.col("n_nationkey") * 2 % 30).cast("string")), F.lit("]]"))
    return integrity.link_check(t("nation").select(F.col("n_name").alias("id"), body.alias("body"))).filter("n_broken > 0").select("id")


@query("stream_01_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    """The streaming extension's plan over the events at rest."""
    return windowed_events(t("events")).withColumn("total", F.round("total", 4))
