"""Row-level access, audit and policy operators. Unknown roles see nothing unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.graph import visible

#: Roles, and those that may see each class of documents.
ROLES = ("Admin", "Risk_Manager", "HR", "Staff", "Guest")
CLASSES = {"HR": ("Admin", "HR"), "RISK": ("Admin", "Risk_Manager", "Staff"), "GENERAL": ROLES}
#: Document numbers and words that put a text in a class, in order of precedence.
CLASS_RULES = (
    ("HR", ("01/2025/tt-nhnn", "57/2024/tt-nhnn", "62/2024/tt-nhnn", "69/2025/tt-nhnn"), ("tuyển dụng", "bổ nhiệm", "bỏ nhiệm", "nhân sự", "tổ chức lại", "cấp phép lần đầu", "lương", "kỷ luật")),
    (
        "RISK",
        ("41/2016/tt-nhnn", "22/2023/tt-nhnn", "44/2011/tt-nhnn", "62/2025/tt-nhnn", "43/2024/tt-nhnn", "156/2020/nđ-cp", "17/vbhn-btc", "105/2016/tt-btc", "67/2011/qh12"),
        ("an toàn vốn", "tỷ lệ an toàn", "quản trị rủi ro", "hạn mức", "phê duyệt vay", "nợ xấu", "dự trữ ngoại hối", "xử phạt vi phạm", "chứng khoán"),
    ),
)


def tag(number: Column, text: Column, rules=CLASS_RULES, other: str = "GENERAL") -> Column:
    """The class of a text: by its document's number or a word, the first rule that holds."""
    has = lambda c, ws: F.array_contains(F.array(*[F.coalesce(F.lower(c).contains(w), F.lit(False)) for w in ws]), True) if ws else F.lit(False)
    return F.coalesce(*[F.when(has(number, numbers) | has(text, words), F.lit(name)) for name, numbers, words in rules], F.lit(other))


def allowed_roles(name: Column, classes=None) -> Column:
    classes = CLASSES if classes is None else classes
    return F.coalesce(*[F.when(name == k, F.array(*[F.lit(r) for r in v])) for k, v in classes.items()])


def known_roles(roles, fallback: str | None = None, known=ROLES) -> list[str]:
    """The known roles of a request, without regard to case and spaces; none of them: the fallback, or nothing."""
    asked = [roles] if isinstance(roles, str) else list(roles or ())
    of = {k.lower(): k for k in known}
    found = [of[r] for r in (str(a).strip().replace(" ", "_").lower() for a in asked) if r in of]
    return list(dict.fromkeys(found)) or ([fallback] if fallback else [])


def parse_roles(c: Column) -> Column:
    """A list of roles from JSON, or else from text with brackets, quotes and commas."""
    plain = F.transform(F.split(F.regexp_replace(c, r"[\[\]'\"]", ""), ","), lambda r: F.trim(r))
    return F.coalesce(F.from_json(c, "array<string>"), F.filter(plain, lambda r: r != ""))


def accessible(rows: DataFrame, roles, column: str = "allowed_roles", fallback: str | None = None, null_visible: bool = False) -> DataFrame:
    return rows.filter(visible(F.col(column), known_roles(roles, fallback), null_visible))


def role_counts(rows: DataFrame, column: str = "allowed_roles", roles=ROLES) -> DataFrame:
    """(role, n, percent) of the rows that each role may see: one pass, one sum for each role."""
    sums = [F.sum(F.coalesce(F.array_contains(column, r).cast("long"), F.lit(0))).alias(r) for r in roles]
    return rows.agg(F.count(F.lit(1)).alias("__all"), *sums).select("__all", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("n")) for r in roles])).alias("r")).select("r.role", "r.n", F.round(100 * F.col("r.n") / F.col("__all"), 2).alias("percent"))


def class_shares(rows: DataFrame, column: str = "security_class") -> DataFrame:
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("__all")))).select(column, "n", F.round(100 * F.col("n") / F.col("__all"), 2).alias("percent"))


def roles_of_documents(rows: DataFrame, document: str = "document_id", column: str = "allowed_roles") -> DataFrame:
    """A document may be seen by whoever may see any part of it."""
    return rows.select(document, F.explode(column).alias("role")).groupBy(document).agg(F.array_sort(F.collect_set("role")).alias(column))


def leakage(hits: DataFrame, rows: DataFrame, key: str = "doc_id", column: str = "allowed_roles") -> DataFrame:
    """For each case and role: hits, hits that the role may not see, and whether there are none of those.

    ``hits`` has case_id, role and the key of what was returned.
    """
    met = hits.join(rows.select(key, column), key, "left")
    bad = ~F.coalesce(F.array_contains(F.col(column), F.col("role")), F.lit(False))
    return met.groupBy("case_id", "role").agg(F.count(F.lit(1)).alias("n_hits"), F.sum(bad.cast("long")).alias("n_unauthorised")).withColumn("passes", F.col("n_unauthorised") == 0)


def audit_event(rows: DataFrame, action: Column, role: Column, query: Column, returned: Column, filtered: Column, time: Column | None = None, request: Column | None = None, metadata: Column | None = None) -> DataFrame:
    """Audit rows; values whose names tell of a secret are struck out."""
    from docloom.functions.text import redact

    empty = F.create_map().cast("map<string,string>")
    state = F.when(F.size(returned) == 0, "DENIED").otherwise("OK")
    return rows.select(
        F.coalesce(time, F.current_timestamp()).alias("timestamp") if time is not None else F.current_timestamp().alias("timestamp"),
        (request if request is not None else F.uuid()).alias("request_id"), role.alias("user_role"), action.alias("action"), query.alias("query"),
        returned.alias("returned_ids"), filtered.alias("filtered_count"), state.alias("status"), redact(metadata if metadata is not None else empty).alias("metadata"),
    )


def origin(number: Column, title: Column, internal=("nội bộ", "quy chế")) -> Column:
    """Whether a document is the house's own, by its number or title."""
    has = F.array_contains(F.array(*[F.coalesce(F.lower(F.concat_ws(" ", number, title)).contains(w), F.lit(False)) for w in internal]), True)
    return F.when(has, "internal").otherwise("external")


def inventory(chunks: DataFrame, document: str = "document_id", order: str = "chunk_id") -> DataFrame:
    """The first chunk of each document."""
    return chunks.withColumn("__n", F.row_number().over(Window.partitionBy(document).orderBy(order))).filter("__n = 1").drop("__n")


def gaps(requirements: DataFrame, evidence: DataFrame, classify: Column | None = None, key: str = "requirement_id", score: str = "score", k: int = 3, met: float = 0.6, partly: float = 0.3) -> DataFrame:
    """The best evidence for each requirement, and a class: met, differs, missing, or not enough to tell.

    ``evidence`` has the key, internal_id and a score; ``classify`` may bring a model's own class. Every row is for review.
    """
    top = evidence.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), "internal_id"))).filter(F.col("__n") <= k)
    best = top.groupBy(key).agg(F.max(score).alias("confidence"), F.min_by("internal_id", "__n").alias("internal_id"), F.count(F.lit(1)).alias("n_evidence"))
    rule = F.when(F.col("n_evidence").isNull(), "CHUA_DU_BANG_CHUNG").when(F.col("confidence") >= met, "DAP_UNG").when(F.col("confidence") >= partly, "CHENH_LECH").otherwise("THIEU")
    return requirements.join(best, key, "left").withColumn("classification", classify if classify is not None else rule).withColumn("review_status", F.lit("NEEDS_HUMAN_REVIEW"))


def policy_answer(hits: DataFrame, roles, question_key: str = "query_id", text: str = "text", rank: str = "rank", label: str = "citation") -> DataFrame:
    """An answer drawn from the first hits that may be seen, or a denial where hits exist but none may be seen."""
    own = known_roles(roles)
    seen = hits.withColumn("__seen", visible(F.col("allowed_roles"), own))
    first = F.array_sort(F.collect_list(F.when(F.col("__seen"), F.struct(rank, text, label))))
    rows = seen.groupBy(question_key).agg(first.alias("rows"), F.sum((~F.col("__seen")).cast("long")).alias("filtered_count"))
    answer = F.array_join(F.transform(F.slice("rows", 1, 3), lambda r: F.concat(F.substring(r[text], 1, 300), F.lit(" ["), r[label], F.lit("]"))), "\n")
    return rows.select(question_key, F.when(F.size("rows") > 0, answer).alias("answer"), F.when(F.size("rows") > 0, "answered").otherwise("denied").alias("status"), "filtered_count")


def sealed(c: Column, key: Column) -> Column:
    """Encrypted text, base64, by AES-GCM."""
    return F.base64(F.aes_encrypt(c.cast("binary"), key, F.lit("GCM")))


def opened(c: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(c), key, F.lit("GCM")).cast("string")
