"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.arrays import bound
from docloom.llm import bpe, licenses, media, merkle, mixing, periods, pii, quality, sentencepieces, simhash, tokencount, toxicity, urls


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_bpe_round_trip(spark, sf_dir):
    return bpe.round_trip(_table(spark, sf_dir, "documents"), bpe.vocabulary("byte_bpe_50k.json"))


def op3_pii_spans(spark, sf_dir):
    return pii.extract(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    model = toxicity.fit(docs.filter(~held_out), labels.filter(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_media_sniff(spark, sf_dir):
    return media.text_media_digests(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op7_token_counts(spark, sf_dir):
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), bpe.vocabulary("piece_bpe_32k.model"))


def op8_url_filter(spark, sf_dir):
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def op9_quality_rules(spark, sf_dir):
    return quality.apply_rules(_table(spark, sf_dir, "documents")).drop("n_lines")


def op10_simhash_components(spark, sf_dir):
    found = simhash.group(_table(spark, sf_dir, "documents"), width=4, distance=4)
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op11_sentencepiece_round_trip(spark, sf_dir):
    return sentencepieces.round_trip(_table(spark, sf_dir, "documents"), bpe.vocabulary("piece_bpe_32k.model"))


def op12_merkle_manifest(spark, sf_dir):
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle.manifest(_table(spark, sf_dir, "documents"), tampered=("text", even, F.translate("text", "\n", "")))


def planted_repeats(text, doc_id):
    """The text of some documents with its words from a place on made periodic, as the contract of op13 has it."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(w):
        a = g % F.size(w)
        p = 1 + F.floor((F.size(w) - a) / (3 + g % 8))
        return bound(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p")), lambda x: F.array_join(F.transform(w, lambda word, i: F.when(i < x["a"], word).otherwise(F.get(w, x["a"] + (i - x["a"]) % x["p"]))), " "))

    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    return F.when(h % 10 == 0, bound(words, lambda w: F.when(F.size(w) > 0, repeated(w)))).otherwise(text)


def op13_periodic_runs(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", planted_repeats(F.col("text"), F.col("doc_id")).alias("text"))
    found = periods.periodic_runs(docs)
    # by length / period, exactly; then by start and period
    first = lambda x, y: F.when(x["length"] * y["period"] != y["length"] * x["period"], F.signum(y["length"] * x["period"] - x["length"] * y["period"]).cast("int")).otherwise(F.when(x["start"] != y["start"], F.signum(x["start"] - y["start"]).cast("int")).otherwise(F.signum(x["period"] - y["period"]).cast("int")))
    rows = found.select("doc_id", "collapsed", "runs", F.get(F.array_sort("runs", first), F.lit(0)).alias("top"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _terms(terms, column="low"):
    return [f"regexp_matches({column}, '(^|[^a-z0-9]){t}($|[^a-z0-9])')" for t in terms]


def _op8_sql() -> str:
    rules = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
        for _, h, p in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    )
    verdicts = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in urls.RULES)
    weigh = lambda hits: " + ".join(f"CASE WHEN {m} THEN {w} ELSE 0 END" for w, m in hits)
    soft = weigh(zip(urls.SOFT.values(), _terms(urls.SOFT), strict=True))
    n_soft = weigh((1, m) for m in _terms(urls.SOFT))
    strict = weigh((urls.LIMIT, m) for m in _terms(urls.STRICT))
    names = sorted([*urls.SOFT, *urls.STRICT])
    listed = ", ".join(f"CASE WHEN {m} THEN '{t}' END" for t, m in zip(names, _terms(names), strict=True))
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, url, regexp_extract(url, '^(.*?)://([^/?#]*)([^?#]*)', 2, 's') AS raw_host, regexp_extract(url, '^(.*?)://([^/?#]*)([^?#]*)', 3, 's') AS path FROM u),
q AS (SELECT page_id, path, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM p),
r AS (SELECT page_id, host, path, low, CASE {rules} END AS rule, CAST({soft} AS BIGINT) AS soft_score, {n_soft} AS n_soft, CAST({strict} AS BIGINT) AS strict_score, concat_ws(',', {listed}) AS terms FROM q)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN CASE rule {verdicts} END WHEN strict_score > 0 OR n_soft >= {urls.LEAST_SOFT} AND soft_score >= {urls.LIMIT} THEN 'block' ELSE 'allow' END AS verdict, soft_score + strict_score AS term_score, terms FROM r"""


def queries():
    return {f.__name__: f for f in (op1_mix_sources, op2_bpe_round_trip, op3_pii_spans, op4_toxicity, op5_media_sniff, op6_license_scan, op7_token_counts, op8_url_filter, op9_quality_rules, op10_simhash_components, op11_sentencepiece_round_trip, op12_merkle_manifest, op13_periodic_runs)}


def oracle_sql():
    return {"op8_url_filter": _op8_sql()}
