"""Quality rules with thresholds that adapt to each language and source. DataFrame functions only.

Each document gets counts; each count gets an integer rate. The rates of a language and source are summed up in a
mergeable sketch: counts of log-linear bins, 64 to a power of two, so a quantile is right within a sixty-fourth. Sketches
of different tasks, sources or languages merge by adding counts, so the order of rows never matters. A rate fails where
it lies several times as far from its group's median as the tails of the group do. Small groups use the merged sketch of
their language, then that of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.runtime import cut, inner, outer, staged

#: White space that parts words, and characters that count as symbols.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: A text fails outright with fewer words than this, or with more than this share of its words in repeated windows.
LEAST_WORDS, MOST_REPEATS = 50, 50
#: Rates, and the per cent of a group up to its upper tail; the lower tail is as large. Repetition comes in a few texts of any
#: kind, so its tails are smaller.
RATES = {"word_length": 90, "symbols": 90, "dup_lines": 99, "repeats": 99}
#: How many times as far from the median as the tail a rate may lie, and what it may lie beyond for rounding.
REACH, SLACK = 4, 5
#: Columns that the rules make.
MADE = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
#: Documents that a group needs for thresholds of its own.
LEAST_GROUP = 200
#: Tables of at most so many groups are broadcast; more are joined by a shuffle.
FEW_GROUPS = 100_000


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and base_failed. Null texts count as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("__trimmed", F.btrim(t, F.lit(BLANKS)))
    df = df.withColumn("__words", F.when(F.col("__trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("__trimmed", r"[\x20\x09-\x0D]+", -1))).drop("__trimmed")
    df = df.withColumn("__lines", F.filter(F.split(t, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != ""))
    df = df.select(
        *docs.columns,
        "__words",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
    )
    # a window's hash and its place in one number, so that one sort brings equal windows together
    df = df.withColumn("__low", F.expr("shiftleft(1L, length(bin(n_words))) - 1"))
    word = lambda at: F.get("__words", at.cast("int"))
    packed = lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)).bitwiseAND(F.bitwise_not("__low")).bitwiseOR(i)
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_words") - 3), packed)
    df = df.withColumn("__sorted", F.when(F.col("n_words") >= 3, F.sort_array(places)).otherwise(F.array().cast("array<bigint>")))

    def same(x: Column, y: Column) -> Column:
        a, b = x.bitwiseAND(F.col("__low")), y.bitwiseAND(F.col("__low"))
        alike = (word(a) == word(b)) & (word(a + 1) == word(b + 1)) & (word(a + 2) == word(b + 2))
        return (x.bitwiseXOR(y).bitwiseAND(F.bitwise_not("__low")) == 0) & alike

    twice = F.filter("__sorted", lambda x, k: same(x, F.get("__sorted", k - 1)) | same(x, F.get("__sorted", k + 1)))
    df = df.withColumn("__at", F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(F.col("__low")))))
    covered = F.transform("__at", lambda x, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get("__at", k + 1) - x, F.lit(3).cast("long"))))
    df = df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("__words", "__low", "__sorted", "__at")
    return df.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words")))


def rates() -> dict[str, Column]:
    """Whole numbers: word length in hundredths, the others in thousandths."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "word_length": F.floor(100 * F.col("word_chars") / words),
        "symbols": F.floor(1000 * F.col("n_symbols") / words),
        "dup_lines": F.floor(1000 * F.col("n_dup_lines") / lines),
        "repeats": F.floor(1000 * F.col("n_repeat_words") / words),
    }


def _bin(v: Column) -> Column:
    """Log-linear bins: whole numbers below 128, above them 64 bins to each power of two."""
    shift = F.length(F.bin(v)) - 7
    return F.when(v < 128, v).otherwise(64 * shift + F.call_function("shiftright", v, shift))


def _least(b: Column) -> Column:
    """The smallest number of a bin."""
    return F.when(b < 128, b).otherwise(F.call_function("shiftleft", (64 + b % 64).cast("long"), (F.floor(b / 64) - 1).cast("int")))


def sketches(measured: DataFrame, keys=("lang", "source")) -> DataFrame:
    """Rows (keys, rate, bin, n): what the documents that don't fail outright add to each sketch."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("rate"), _bin(v).cast("long").alias("bin")) for name, v in rates().items()])).alias("__r")
    return measured.filter(~F.col("base_failed")).select(*keys, pairs).groupBy(*keys, "__r.rate", "__r.bin").agg(F.count(F.lit(1)).alias("n"))


def thresholds(sketch: DataFrame, keys=("lang", "source")) -> DataFrame:
    """One row for each group of the sketch: keys, and (low, high) of each rate, from the nearest sketch that is large enough.

    The quantiles of a level come from running sums over its bins, at most some hundred for each group and rate.
    """
    wide, narrow = keys
    levels = {"own": [wide, narrow], "lang": [wide], "all": []}
    groups = sketch.select(*keys).distinct()
    out = groups
    for level, by in levels.items():
        merged = sketch.groupBy(*by, "rate", "bin").agg(F.sum("n").alias("n"))
        part = Window.partitionBy(*by, "rate")
        run = merged.withColumn("__sum", F.sum("n").over(part.orderBy("bin"))).withColumn("__all", F.sum("n").over(part))
        percent = F.element_at(F.create_map(*[F.lit(x) for pair in RATES.items() for x in pair]), F.col("rate"))
        quantile = lambda p: _least(F.min(F.when(100 * F.col("__sum") >= p * F.col("__all"), F.col("bin"))))
        found = run.groupBy(*by, "rate").agg(quantile(100 - percent).alias("low"), quantile(F.lit(50)).alias("mid"), quantile(percent).alias("high"), F.first("__all").alias("n"))
        fence = F.struct((F.col("mid") - REACH * (F.col("mid") - F.col("low")) - SLACK).alias("low"), (F.col("mid") + REACH * (F.col("high") - F.col("mid")) + SLACK).alias("high"))
        per_rate = [F.max(F.when(F.col("rate") == r, fence)).alias(f"__{level}_{r}") for r in RATES]
        table = found.groupBy(*by).agg(F.max("n").alias(f"__{level}_n"), *per_rate)
        table = table.select(*[F.col(b).alias(f"__by_{b}") for b in by], *[c for c in table.columns if c not in by])
        met = F.lit(True)
        for b in by:
            met = met & F.col(b).eqNullSafe(F.col(f"__by_{b}"))
        out = out.join(table, met, "left").drop(*[f"__by_{b}" for b in by]) if by else out.join(F.broadcast(table), how="left")  # a single row
    own, lang = F.col("__own_n") >= LEAST_GROUP, F.col("__lang_n") >= LEAST_GROUP
    return out.select(*keys, F.when(own, "own").when(lang, "lang").otherwise("all").alias("level"), *[F.when(own, F.col(f"__own_{r}")).when(lang, F.col(f"__lang_{r}")).otherwise(F.col(f"__all_{r}")).alias(f"__fence_{r}") for r in RATES])


def judge(measured: DataFrame, keys=("lang", "source")) -> DataFrame:
    """Adds ``kept`` to the counts: not failed outright, and every rate within the fences of the document's group.

    Groups in which every document fails outright have no sketch; nothing of them is kept. Null keys are groups too.
    """
    return _within(measured, cut(thresholds(cut(sketches(measured, keys)), keys)), keys)


def _within(measured: DataFrame, table: DataFrame, keys) -> DataFrame:
    few = table.count() <= FEW_GROUPS
    named = table.select(*[F.col(k).alias(f"__key_{k}") for k in keys], *[f"__fence_{r}" for r in RATES])
    named = F.broadcast(named) if few else named
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    inside = F.lit(True)
    for r, v in rates().items():
        inside = inside & v.between(F.col(f"__fence_{r}.low"), F.col(f"__fence_{r}.high"))
    joined = measured.join(named, met, "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).select(*measured.columns, "kept")


def apply_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep=("doc_id",)) -> DataFrame:
    """Columns of ``keep``, the counts, ``base_failed`` and ``kept`` of each document.

    A column of ``keep`` that is named like one of the result gives way to it.
    """
    shown = [c for c in keep if c not in MADE]
    at = [f"__d{i}" for i in range(len(shown))]
    narrow = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(shown, at, strict=True)], F.col(f"`{lang}`").alias("__lang"), F.col(f"`{source}`").alias("__source"), F.col(f"`{text}`").alias("__text"))
    judged = judge(cut(counts(narrow, "__text").drop("__text")), ("__lang", "__source"))
    return judged.select(*[F.col(a).alias(c) for c, a in zip(shown, at, strict=True)], *MADE)


def filter_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The columns of ``docs`` for the documents that are kept. The texts go through no shuffle.

    Null texts have no words and go; null languages and sources are groups too; repeated rows stay or go together;
    columns may have any names; an empty table gives an empty one.
    """
    rows, at = inner(docs)
    # written out: a filter on the counts would else be pushed into the expressions that make them
    measured = staged(counts(rows, at[text]))
    keys = (at[lang], at[source])
    return outer(_within(measured, cut(thresholds(cut(sketches(measured, keys)), keys)), keys).filter("kept"), docs)
