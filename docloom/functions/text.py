"""Text functions as Column expressions: they stay in the JVM. Arrow functions only for what Spark has no expression for."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from docloom.functions.arrays import bound, pieces, running_sum
from docloom.shipping import arrow_function, ship

#: What stands for "no value" in imported tables.
NULL_MARKS = ("", "nan", "none", "Chưa phân loại")
#: Patterns of references to parts of a law, and of document numbers.
REFERENCE = r"(?iu)\b(?:Điều\s+\d+|Khoản\s+[IVX0-9]+|Điểm\s+[a-zA-Z0-9]+|\d{4})\b"
DOCUMENT_NUMBER = r"(?iu)\b\d{1,4}/(?:[0-9]{4}/|VBHN-)[A-ZĐa-z0-9_-]+\b"
ARTICLE = r"(?iu)Điều\s+(\d+)"


def clean_null(c: Column) -> Column:
    """Null for every mark of a missing value."""
    t = F.trim(c)
    return F.when(F.lower(t).isin(*[m.lower() for m in NULL_MARKS]), None).otherwise(t)


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tidy_lines(c: Column) -> Column:
    """Runs of blanks become one, empty lines go, line ends stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n\s*\n+", "\n"))


#: Fixed value: a run of decimal digits, or of letters and numbers.
WORD = r"\p{Nd}+|[\p{L}\p{N}]+"
#: The same for texts in Latin-1, where the decimal digits are those of ASCII; letters and numbers there, with blanks for the rest;
#: and what makes two words of a run of letters and digits, or may.
LATIN = re.compile(f"[0-9]+|[{''.join(regex.findall(r'[\p{L}\p{N}]', bytes(range(256)).decode('latin-1')))}]+")
SPACED = bytes(i if LATIN.fullmatch(chr(i)) else 32 for i in range(256))
TURN = re.compile(rb"[0-9][^0-9 ]")


def _folded(t: str) -> str:
    return unicodedata.normalize("NFC", t).casefold()


def legal_words(text: str) -> list[str]:
    """What ``legal_tokens`` gives a text, for functions that take texts apart in a task of their own."""
    folded = _folded(text)
    try:
        plain = folded.encode("latin-1").translate(SPACED)
    except UnicodeEncodeError:
        return regex.findall(WORD, folded)
    return LATIN.findall(folded) if TURN.search(plain) else plain.decode("latin-1").split()


def _words(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.string())
    made = [pa.array([None if t is None else legal_words(t) for t in some.to_pylist()], kind) for some in pieces(texts)]
    return pa.concat_arrays(made) if made else pa.array([], kind)


def legal_tokens(c: Column) -> Column:
    """Runs of letters and digits of the composed text, case-folded; null for null. An Arrow function: the JVM's SQL has
    neither composition nor folding, and a text in parts, its marks apart from their letters, would give other words."""
    ship(SparkSession.active())
    return F.arrow_udf(_words, "array<string>")(c)


def number_tokens(c: Column) -> Column:
    """Tokens that keep ``/`` and ``-``, so document numbers stay whole; single characters only if digits."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{Ll}0-9/\-]+)"), F.lit(1)), lambda x: (F.length(x) > 1) | x.rlike(r"^\d$"))


def plain_tokens(c: Column) -> Column:
    """Words between white space, in their case."""
    return F.filter(F.split(collapse(c), " "), lambda x: x != "")


def _each_folded(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _folded(t) for t in texts.to_pylist()], pa.string())


def fold(c: Column) -> Column:
    """The composed text, case-folded."""
    ship(SparkSession.active())
    return F.arrow_udf(_each_folded, "string")(c)


def dedup_key(c: Column) -> Column:
    """What two wordings of one question share: composed letters, no punctuation, one case, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(collapse(fold(c)), r"[.,;:!?\-–—]+", ""), r"\s+", " "))


def references(c: Column, pattern: str = REFERENCE) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


def references_allowed(found: Column, allowed: Column) -> Column:
    """Whether all found references are allowed; passes where either side is empty."""
    low = lambda a: F.transform(a, lambda x: F.lower(x))
    return (F.size(found) == 0) | (F.size(allowed) == 0) | (F.size(F.array_except(low(found), low(allowed))) == 0)


def matches(c: Column, pattern: str) -> Column:
    """Structs (start, end, word) of all matches, in characters: matches and the pieces between make up the text."""
    pieces = F.transform(F.split(c, pattern, -1), lambda p: F.length(p))

    def placed(found: Column) -> Column:
        ends = running_sum(F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda gap, m: gap + F.length(m)))
        return F.zip_with(ends, found, lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("word")))

    return bound(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), placed)


#: What a relation's surroundings say, in order of precedence, and its name.
TRIGGERS = (("Sửa đổi, bổ sung", ("sửa đổi", "bổ sung")), ("Bãi bỏ", ("bãi bỏ",)), ("Thay thế", ("thay thế",)), ("Căn cứ", ("căn cứ",)))
OTHER_TRIGGER = "Trích dẫn"


def evidence(c: Column, start: Column, end: Column, before: int = 150, after: int = 100) -> Column:
    """The text around a match."""
    first = F.greatest(start - before, F.lit(0))
    return F.trim(F.substring(c, first + 1, end + after - first))


def trigger(window: Column, triggers=TRIGGERS, other: str = OTHER_TRIGGER) -> Column:
    low = F.lower(window)
    return F.coalesce(*[F.when(F.array_contains(F.array(*[low.contains(w) for w in words]), True), F.lit(name)) for name, words in triggers], F.lit(other))


#: Short and upper-case names of bodies, and their full names.
ALIASES = {
    "NHNN": "Ngân hàng Nhà nước Việt Nam",
    "NGÂN HÀNG NHÀ NƯỚC": "Ngân hàng Nhà nước Việt Nam",
    "NGÂN HÀNG NHÀ NƯỚC VIỆT NAM": "Ngân hàng Nhà nước Việt Nam",
    "BTC": "Bộ Tài chính",
    "BỘ TÀI CHÍNH": "Bộ Tài chính",
    "CP": "Chính phủ",
    "CHÍNH PHỦ": "Chính phủ",
    "QH": "Quốc hội",
    "QUỐC HỘI": "Quốc hội",
    "TCTD": "Tổ chức tín dụng",
    "TỔ CHỨC TÍN DỤNG": "Tổ chức tín dụng",
    "NHTM": "Ngân hàng thương mại",
    "NGÂN HÀNG THƯƠNG MẠI": "Ngân hàng thương mại",
    "QTDND": "Quỹ tín dụng nhân dân",
    "QUỸ TÍN DỤNG NHÂN DÂN": "Quỹ tín dụng nhân dân",
    "DNBH": "Doanh nghiệp bảo hiểm",
    "DOANH NGHIỆP BẢO HIỂM": "Doanh nghiệp bảo hiểm",
}
#: Bodies that a longer name stands for if it holds theirs.
BODIES = ("NGÂN HÀNG NHÀ NƯỚC", "BỘ TÀI CHÍNH", "CHÍNH PHỦ", "QUỐC HỘI")


def canonical_name(name: Column, kind: Column, aliases=None, bodies=BODIES, body_kind: str = "CoQuan", field_kind: str = "LinhVuc") -> Column:
    """One name for each entity: by alias, by the body that it holds, in title case for fields."""
    aliases = ALIASES if aliases is None else aliases
    clean = collapse(nfc(name))
    upper = F.upper(clean)
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    body = F.coalesce(*[F.when(upper.contains(b), F.lit(aliases[b])) for b in bodies])
    return F.coalesce(table[upper], F.when(kind == body_kind, body), F.when(kind == field_kind, F.initcap(clean)), clean)


def _composed(c: pd.Series) -> pd.Series:
    return c.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(c: Column) -> Column:
    """Unicode composition; Spark has no expression for it."""
    return arrow_function(_composed, "string")(c)


def natural_key(c: Column) -> Column:
    """Sorts digit runs by number and other runs by letters, digits first."""
    runs = F.regexp_extract_all(c, F.lit(r"\d+|\D+"), F.lit(0))
    return F.transform(runs, lambda r: F.struct(F.when(r.rlike(r"^\d"), 0).otherwise(1).alias("kind"), F.when(r.rlike(r"^\d"), F.lpad(r, 20, "0")).otherwise(F.lower(r)).alias("value")))


def relation_type(c: Column) -> Column:
    """Upper case, other characters as ``_``; null if that is no identifier."""
    name = F.regexp_replace(F.upper(F.trim(c)), r"[^\p{L}\p{N}_]+", "_")
    return F.when(name.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$"), name)


def file_name(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r'[\\/*?:"<>|\s]+', "_")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def json_part(c: Column) -> Column:
    """From the first ``{`` to the last ``}``, parsed if it can be."""
    return F.try_parse_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")))


def labels(c: Column, letter: str = "E") -> Column:
    """Numbers of ``[E 1]``-like labels, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(rf"\[{letter}\s*(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))


def wikilinks(c: Column) -> Column:
    """Targets of ``[[target|alias]]``."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1)), lambda x: F.trim(x))


#: Parts of the names of values that must not be logged.
SECRET_KEYS = ("key", "pass", "token", "secret", "auth")


def redact(c: Column, marks=SECRET_KEYS, instead: str = "***") -> Column:
    return F.transform_values(c, lambda k, v: F.when(F.lower(k).rlike("|".join(marks)), F.lit(instead)).otherwise(v))


def stable_id(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def citation(*parts: Column) -> Column:
    """The parts that are there, joined by bars."""
    return F.concat_ws(" | ", *[clean_null(p) for p in parts])


def preview(c: Column, length: int = 120) -> Column:
    return F.substring(c, 1, length)
