"""Personal data by bootstrapped contextual extraction. DataFrame functions only.

Patterns of known kinds (mail and network addresses, payment cards, telephone numbers) give seed entities, of one word
or more. What stands beside a seed and how the seed is built induces lexical patterns. Patterns and the identifier-like
words that they match make up a graph; round by round, a pattern is scored by the share of its words that are believed
to be of a kind, and a word by the patterns that match it. Words of high belief become further spans of the kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.arrays import bound, running_sum, scan
from docloom.llm.runtime import cut, inner, outer

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
#: A match begins at the start of a run of its first characters, or where the match before it ended;
#: later places of the same run cannot match. Possessive runs keep time linear and the stack flat.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: Longer words and shapes are compared by their digests, so no key grows with a text.
MOST_LETTERS = 64
#: Rounds of scoring; believed seeds that a pattern needs; least scores of a pattern and of an accepted word.
ROUNDS, SUPPORT, CONFIDENT, ACCEPTED = 3, 5, 0.8, 0.95
#: Tables of at most so many shapes, or of so many rows with discovered spans, are broadcast.
FEW_SHAPES, FEW_ROWS = 10_000, 100_000


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """From the last digit, every second one is doubled, less 9 above 9; the sum ends in 0."""
    backwards = F.reverse(_digits(match))
    place = F.sequence(F.lit(1), F.length(backwards))
    digit = lambda i: F.substring(backwards, i, F.lit(1)).cast("int")
    step = lambda total, i: total + F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(place, F.lit(0), step) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    """Whether a match of a kind's pattern stays."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    n = F.length(_digits(match))
    return n.between(9, 15) if kind == "phone" else n.between(13, 19) & F.when(n.between(13, 19), _luhn(match)).otherwise(False)


def _stays(kind: str):
    return lambda span: _holds(kind, span["word"])


#: Places in characters and in bytes, the word, and the words beside it.
SPAN = "struct<start:int,end:int,at:int,to:int,word:string,left:string,right:string>"


def _span(start: Column, end: Column, at: Column, to: Column, word: Column, left: Column, right: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), at.cast("int").alias("at"), to.cast("int").alias("to"), word.alias("word"), left.alias("left"), right.alias("right"))


def _none(kind: str = SPAN) -> Column:
    return F.array().cast(f"array<{kind}>")


def _short(c: Column) -> Column:
    return F.when(F.length(c) > MOST_LETTERS, F.sha2(c, 256)).otherwise(c)


def _beside(after: Column) -> Column:
    """The first word of what follows a place, past punctuation that touches the place."""
    return F.regexp_extract(after, r"^[^\s\p{L}\p{N}]*+\s*+(\S++)", 1)


def _plain(word: Column) -> Column:
    """A word without case, and without punctuation at its ends if it has anything else."""
    bare = F.regexp_replace(word, r"^[^\p{L}\p{N}]++|(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
    return _short(F.lower(F.when(bare == "", word).otherwise(bare)))


def _lengths(c: Column) -> Column:
    """Characters and bytes in one number, so that one sum gives both."""
    return F.shiftleft(F.length(c).cast("long"), 32) + F.octet_length(c)


def _found(text: Column, matches: Column, pattern: str) -> Column:
    """Matches with their places and neighbours: they and the pieces between them make up the text.

    Ends are running sums, so time is linear in the text. A neighbour is looked for in the piece beside a match and in
    the match beyond that.
    """
    empty = F.array(F.lit(""))

    def placed(m: Column, pieces: Column) -> Column:
        n = F.size(m)
        ends = running_sum(F.zip_with(F.slice(pieces, 1, n), m, lambda gap, w: _lengths(gap) + _lengths(w)), "long")
        left = F.zip_with(F.concat(empty, F.slice(m, 1, n - 1)), F.slice(pieces, 1, n), lambda w, gap: _plain(F.reverse(_beside(F.reverse(F.concat(w, gap))))))
        right = F.zip_with(F.slice(pieces, 2, n), F.concat(F.slice(m, 2, n - 1), empty), lambda gap, w: _plain(_beside(F.concat(gap, w))))
        sides = F.zip_with(left, right, lambda x, y: F.struct(x.alias("left"), y.alias("right")))
        words = F.zip_with(ends, m, lambda e, w: F.struct(F.shiftright(e, 32).alias("end"), e.bitwiseAND((1 << 32) - 1).alias("to"), w.alias("word")))
        return F.zip_with(words, sides, lambda w, s: _span(w["end"] - F.length(w["word"]), w["end"], w["to"] - F.octet_length(w["word"]), w["to"], w["word"], s["left"], s["right"]))

    return F.when(F.size(matches) == 0, _none()).otherwise(bound(matches, lambda m: bound(F.split(text, pattern, -1), lambda p: placed(m, p))))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds a column ``spans_<kind>`` of places, words and neighbours for each kind. Null texts count as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    # what a text needs for any match: these plain searches spare most texts the patterns
    need = {"email": t.contains("@"), "ip": t.rlike("[0-9]"), "card": t.rlike("[0-9]"), "phone": t.contains("+")}
    df = docs.withColumns({f"__match_{k}": F.when(need[k], F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")) for k, p in PATTERNS.items()})
    df = df.withColumns({f"spans_{k}": F.filter(_found(t, F.col(f"__match_{k}"), p), _stays(k)) for k, p in PATTERNS.items()})
    return df.drop(*[f"__match_{k}" for k in KINDS])


#: Characters of identifiers. Words of them with a digit or an @, from the start of the word; and two or more groups of
#: digits that single spaces part.
_OF = r"A-Za-z._%+\x2D\x80-\x{10FFFF}"
_WORD = rf"(?<![0-9@{_OF}])[{_OF}]*+[0-9@][0-9@{_OF}]*+"
_GROUP = r"[0-9][0-9().\x2D]*+(?![A-Za-z@_%+\x80-\x{10FFFF}])"
_GROUPS = rf"(?<![0-9@({_OF}])[+(]*+{_GROUP}(?: [(]?{_GROUP})++"


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``candidates``: identifier-like words, and runs of digit groups as one, with their places and neighbours.

    They are without punctuation at their ends. A run is listed besides its words, as either can be the identifier.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    need = {"__words": (_WORD, t.rlike("[0-9@]")), "__groups": (_GROUPS, t.rlike("[0-9)] [(]?[0-9]"))}
    df = docs.withColumns({c: F.when(some, F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")) for c, (p, some) in need.items()})

    def core(s: Column) -> Column:
        before = F.regexp_extract(s["word"], r"^[^\p{L}\p{N}+]*+", 0)
        word = F.regexp_extract(s["word"], r"(?s)^[^\p{L}\p{N}+]*+(.*[\p{L}\p{N}])", 1)
        start, at = s["start"] + F.length(before), s["at"] + F.octet_length(before)
        return _span(start, start + F.length(word), at, at + F.octet_length(word), word, s["left"], s["right"])

    found = F.concat(*[_found(t, F.col(c), p) for c, (p, _) in need.items()])
    return df.withColumn("candidates", F.filter(F.transform(found, core), lambda s: s["word"] != "")).drop(*need)


def _shape(word: Column) -> Column:
    """How a word is built: parts with a letter, runs of digits; other characters stay.

    Parts of a word are what @, blanks and parentheses part. Digits alone say little, so a single run of them has its
    order of magnitude: 6 to 11, 12 to 22, and so on.
    """
    runs = F.regexp_replace(F.regexp_replace(word, r"(?<![0-9._%+\x2D])[0-9._%+\x2D]*+[A-Za-z\x80-\x{10FFFF}][^@ ()]*+", "w"), "[0-9]+", "9")
    return _short(F.when(runs == "9", F.concat_ws("/", runs, F.round(F.log2(F.length(word))).cast("int").cast("string"))).otherwise(runs))


def _mark(beliefs: DataFrame) -> tuple:
    """Tells whether beliefs have changed: their number, and the sum of their hashes."""
    return tuple(beliefs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("word", "kind", F.round("belief", 9)).cast("decimal(20,0)"))).first())


def discover(occurrences: DataFrame) -> DataFrame:
    """Rows (word, kind) that are believed of a kind without being seeds.

    ``occurrences`` has word, shape, left, right and kind, null where the word is no seed. Each round costs two joins of
    distinct (pattern, word) pairs; these are few beside the texts, and what is counted at a pattern is a sum.
    """
    edges = occurrences.select("word", "kind", F.explode(F.array(F.concat(F.lit("<"), F.col("left"), F.lit(" "), F.col("shape")), F.concat(F.lit(">"), F.col("right"), F.lit(" "), F.col("shape")))).alias("pattern"))
    known = cut(edges.groupBy("pattern", "word").agg(F.max("kind").alias("kind")))
    seeds = known.filter("kind is not null").groupBy("word").agg(F.max("kind").alias("kind")).select("word", "kind", F.lit(1.0).alias("belief"))
    pairs = known.select("pattern", "word")
    size = pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    beliefs = cut(seeds)
    first, mark = beliefs, _mark(beliefs)
    for _ in range(ROUNDS):
        believed = pairs.join(beliefs, "word").groupBy("pattern", "kind").agg(F.sum("belief").alias("mass"), F.count(F.lit(1)).alias("support")).filter(F.col("support") >= SUPPORT)
        scored = believed.join(size, "pattern").select("pattern", F.col("kind").alias("__kind"), (F.col("mass") / F.col("n")).alias("score")).filter(F.col("score") >= CONFIDENT)
        # belief is what remains if every pattern that matches the word were wrong on its own
        doubt = pairs.join(scored, "pattern").groupBy("word", "__kind").agg(F.sum(F.log(1.0 - F.least(F.col("score"), F.lit(0.999)))).alias("log"))
        best = doubt.groupBy("word").agg(F.max_by(F.struct(F.col("__kind").alias("kind"), (1 - F.exp("log")).alias("belief")), F.struct(-F.col("log"), "__kind")).alias("b")).select("word", "b.kind", "b.belief")
        grown = best.filter(F.col("belief") >= ACCEPTED).join(first.select("word"), "word", "left_anti")
        beliefs = cut(first.unionByName(grown))
        if (now := _mark(beliefs)) == mark:  # nothing has changed, so no further round would
            break
        mark = now
    return beliefs.join(first.select("word"), "word", "left_anti").select("word", "kind")


def _uncovered(found: Column, spans: Column) -> Column:
    """Those of the found ones that overlap no span: one pass over both in order of their starts."""
    last = (1 << 31) - 1
    event = lambda s, tag: F.struct(s["start"].alias("start"), F.lit(tag).alias("tag"), s["end"].alias("end"), s.alias("s"))
    events = F.sort_array(F.concat(F.transform(spans, lambda s: event(s, 0)), F.transform(found, lambda s: event(s, 1))))

    def swept(e: Column) -> Column:
        reach = scan(e, F.lit(0), lambda far, x: F.when(x["tag"] == 0, F.greatest(far, x["end"])).otherwise(far))
        following = F.reverse(scan(F.reverse(e), F.lit(last), lambda near, x: F.when(x["tag"] == 0, x["start"]).otherwise(near)))
        limits = F.zip_with(reach, following, lambda r, f: F.struct(r.alias("reach"), f.alias("following")))
        judged = F.zip_with(e, limits, lambda x, m: F.struct(((x["tag"] == 1) & (m["reach"] <= x["start"]) & (m["following"] >= x["end"])).alias("free"), x["s"].alias("s")))
        return F.transform(F.filter(judged, lambda j: j["free"]), lambda j: j["s"])

    return F.when((F.size(found) == 0) | (F.size(spans) == 0), found).otherwise(bound(events, swept))


def further_spans(marked: DataFrame, key: str) -> DataFrame:
    """Rows (key, further): spans (kind as its place, start, end, at, to) of discovered words, for rows that have some.

    ``marked`` has the key, the base spans and the candidates of each row.
    """
    seed = lambda k: F.transform(f"spans_{k}", lambda s: F.struct(F.lit(k).alias("kind"), s.alias("c")))
    seeds = marked.select(key, F.explode(F.concat(*map(seed, KINDS))).alias("s")).select(key, "s.kind", "s.c.*").withColumn("shape", _shape(F.col("word")))
    shapes = cut(seeds.select(F.col("shape").alias("__shape")).distinct())
    others = _uncovered(F.col("candidates"), F.concat(*[F.col(f"spans_{k}") for k in KINDS]))
    others = marked.select(key, F.explode(others).alias("c")).select(key, F.lit(None).cast("string").alias("kind"), "c.*").withColumn("shape", _shape(F.col("word")))
    if shapes.count() <= FEW_SHAPES:  # no pattern of another shape can have a seed
        others = others.join(F.broadcast(shapes), F.col("shape") == F.col("__shape"), "left_semi")
    occurrences = cut(seeds.unionByName(others).withColumn("word", _short(F.col("word"))))
    new = discover(occurrences)
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    hits = occurrences.filter("kind is null").drop("kind").join(new, "word").select(key, F.struct(place.alias("kind"), "start", "end", "at", "to").alias("s"))
    return hits.groupBy(key).agg(F.array_sort(F.collect_set("s")).alias("further"))


FURTHER = "struct<kind:int,start:int,end:int,at:int,to:int>"


def _of_kind(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _listed(kind: int, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(KINDS[kind]), s["start"].cast("string"), s["end"].cast("string")))


def extract(docs: DataFrame, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """Columns of ``keep``, the number of base spans of each kind, the digest of their list, ``spans``, the list of all, and their number.

    Null and empty texts have none. Repeated rows stay; an empty table gives an empty one. Columns of ``keep`` that are
    named like one of the result give way to it.
    """
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"]
    kept = [c for c in keep if c not in names]
    at = [f"__d{i}" for i in range(len(kept))]
    narrow = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(kept, at, strict=True)], F.col(f"`{text}`").alias("__text"))
    narrow = candidates(base_spans(narrow, "__text"), "__text").drop("__text")
    marked = cut(narrow.withColumn("__row", F.monotonically_increasing_id()))  # written out, so the row numbers stay
    extra = further_spans(marked, "__row").withColumnRenamed("__row", "__at")
    whole = marked.join(extra, F.col("__row") == F.col("__at"), "left")
    base = F.concat(*[_listed(i, F.col(f"spans_{k}")) for i, k in enumerate(KINDS)])
    more = F.coalesce(F.col("further"), _none(FURTHER))
    places = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    every = []
    for i, k in enumerate(KINDS):
        own, found = places(F.col(f"spans_{k}")), places(_of_kind(more, i + 1))
        every.append(_listed(i, F.when(F.size(found) == 0, own).otherwise(F.sort_array(F.concat(own, found)))))
    spans = F.concat(*every)
    return whole.select(
        *[F.col(a).alias(c) for c, a in zip(kept, at, strict=True)],
        *[F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(spans, ",").alias("spans"),
        F.size(spans).cast("long").alias("n_spans"),
    )


def _replaced(text: Column, spans: Column) -> Column:
    """The text with ``[kind]`` for each span (at, to, kind), in bytes; of overlapping ones the first by place names the whole.

    Bytes are cut from the text by place, so time is linear in the text and its spans.
    """

    def parts(b: Column, s: Column, reach: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(reach, 1, F.size(reach) - 1))
        piece = lambda x, past: F.concat(F.substring(b, past + 1, x["at"] - past).cast("string"), F.lit("["), x["kind"], F.lit("]"))
        kept = F.zip_with(s, before, lambda x, past: F.when(x["at"] >= past, piece(x, past)).otherwise(""))
        return F.concat(F.array_join(kept, ""), F.substring(b, F.element_at(reach, -1) + 1, F.octet_length(b)).cast("string"))

    reached = lambda s: scan(s, F.lit(0), lambda far, x: F.greatest(far, x["to"]))
    return bound(text.cast("binary"), lambda b: bound(F.sort_array(spans), lambda s: bound(reached(s), lambda r: parts(b, s, r))))


def redact(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The columns of ``docs``, with ``[KIND]`` in place of every span. Null texts stay null.

    Rows that agree in id and text get the same spans, so their further spans are kept by id and text hash. Columns may
    have any names; repeated rows stay; an empty table gives an empty one.
    """
    rows, at = inner(docs)
    text, id_column = at[text], at[id_column]
    keyed = rows.withColumn("__key", F.xxhash64(F.col(id_column), F.col(text)))
    marked = cut(candidates(base_spans(keyed.select("__key", F.col(text).alias("__text")), "__text"), "__text").drop("__text").filter(F.size("candidates") > 0))
    extra = cut(further_spans(marked, "__key").withColumnRenamed("__key", "__at"))
    extra = F.broadcast(extra) if extra.count() <= FEW_ROWS else extra
    rows = base_spans(keyed, text).join(extra, F.col("__key") == F.col("__at"), "left")
    upper = F.array(*[F.lit(k.upper()) for k in KINDS])
    place = lambda s, kind: F.struct(s["at"].alias("at"), s["to"].alias("to"), kind.alias("kind"))
    own = lambda k: F.transform(f"spans_{k}", lambda s: place(s, F.lit(k.upper())))
    later = F.transform(F.coalesce(F.col("further"), _none(FURTHER)), lambda s: place(s, F.element_at(upper, s["kind"])))
    rows = rows.withColumn("__spans", F.concat(*map(own, KINDS), later))
    clean = F.when(F.size("__spans") == 0, F.col(text)).otherwise(_replaced(F.col(text), F.col("__spans")))
    return outer(rows.withColumn(text, clean), docs)
