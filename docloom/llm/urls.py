"""URL filters: host and path rules, then a weighted vocabulary found by Aho-Corasick.

The automaton counts terms in the lower-cased url. A hit counts only between boundaries, that is if no ASCII letter
or digit stands beside it. One strict term rejects a url, and so do several distinct soft terms whose weights add up. The
vocabulary is a table of terms and weights, without a weight for a strict one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.runtime import map_texts

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Terms of which one rejects a url: adult sites, gambling, drugs sold without prescription, stolen goods.
STRICT = (
    "adult", "bdsm", "blackjack", "camgirls", "camsex", "casino", "casinos", "cialis", "cumshot", "escorts", "fetish", "fuck", "gangbang", "hardcore-sex",
    "hentai", "jackpot", "keygen", "levitra", "milf", "nudes", "onlyfans", "porn", "porno", "pornhub", "roulette", "sex-cams", "sexcam", "sexshop", "slots",
    "sportsbook", "tramadol", "viagra", "warez", "webcam-sex", "xanax", "xvideos", "xxx",
)
#: Terms with weights: 3 for words that are rare elsewhere, 2 for words of sellers and spam, 1 for words that
#: are common in sound urls too.
SOFT = {
    "bet": 3, "bets": 3, "betting": 3, "bingo": 3, "crack": 3, "dating": 3, "escort": 3, "gambling": 3, "hookup": 3, "lottery": 3, "nude": 3, "payday": 3,
    "pills": 3, "poker": 3, "sex": 3, "sexy": 3, "spam": 3, "torrent": 3, "weightloss": 3,
    "bonus": 2, "cheap": 2, "clickbait": 2, "coupon": 2, "discount": 2, "free": 2, "hack": 2, "hot": 2, "loan": 2, "loans": 2, "pharmacy": 2, "pill": 2,
    "replica": 2, "singles": 2, "slim": 2, "win": 2, "winner": 2,
    "ads": 1, "affiliate": 1, "buy": 1, "cams": 1, "cash": 1, "click": 1, "deal": 1, "deals": 1, "download": 1, "farm": 1, "gratis": 1, "money": 1, "offer": 1,
    "online": 1, "popup": 1, "prize": 1, "promo": 1, "redirect": 1, "shop": 1, "track": 1, "tracker": 1,
}
#: Soft terms of this weight in all reject a url, if they are at least so many distinct ones.
LIMIT, LEAST_SOFT = 4, 2
#: Terms that a vocabulary may have: it is held by the driver and by every worker.
MOST_TERMS = 1_000_000

_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty without ``://``."""
    _, sign, rest = (url or "").partition("://")
    if not sign:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


class Judge:
    def __init__(self, rules=RULES, strict: Sequence[str] = STRICT, soft=SOFT, limit: int = LIMIT, least_soft: int = LEAST_SOFT):
        self.rules: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.rules.setdefault(host, []).append((path, verdict))
        self.limit, self.least_soft, self.strict = limit, least_soft, frozenset(strict)
        self.terms = ahocorasick.Automaton()
        for term, weight in [*soft.items(), *((t, limit) for t in strict)]:
            self.terms.add_word(term, (term, weight))
        if len(self.terms):
            self.terms.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, as host and path, and its verdict."""
        best, part = None, host
        while part:
            for start, verdict in self.rules.get(part, ()):
                if path.startswith(start) and (best is None or len(part + start) > len(best[0])):
                    best = part + start, verdict
            part = part.partition(".")[2]
        return best

    def terms_in(self, url: str) -> dict[str, int]:
        """Distinct terms between boundaries, with their weights."""
        low = url.translate(_LOWER)
        found: dict[str, int] = {}
        if not len(self.terms):
            return found
        for end, (term, weight) in self.terms.iter(low):
            start = end + 1 - len(term)
            if not (start and _inner(low[start - 1])) and not (end + 1 < len(low) and _inner(low[end + 1])):
                found[term] = weight
        return found

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int, str]:
        host, path = split_url(url)
        found = self.terms_in(url or "")
        score = sum(found.values())
        fits = self.rule(host, path)
        bad = not self.strict.isdisjoint(found) or len(found) >= self.least_soft and score >= self.limit
        verdict = fits[1] if fits else "block" if bad else "allow"
        return host, path, fits and fits[0], verdict, score, ",".join(sorted(found))


def _inner(c: str) -> bool:
    return c.isascii() and c.isalnum()


@lru_cache(maxsize=2)
def _judge(rules, strict, soft, limit, least_soft) -> Judge:
    return Judge(rules, strict, dict(soft), limit, least_soft)


def vocabulary_table(spark: SparkSession) -> DataFrame:
    """The vocabulary of this module as a table (term, weight); strict terms have no weight."""
    return spark.createDataFrame([*((t, None) for t in STRICT), *SOFT.items()], "term string, weight int")


def read_vocabulary(rows: DataFrame, term: str = "term", weight: str = "weight") -> tuple[tuple[str, ...], dict[str, int]]:
    """Strict terms, and soft ones with their weights, from a table that is small enough for a worker.

    Terms are lower-cased; null and empty ones are left out; of several weights of a term the highest counts, and a
    term without a weight in any row is strict.
    """
    low = F.lower(F.trim(F.col(term)))
    found = rows.select(low.alias("t"), F.col(weight).cast("int").alias("w")).filter("t <> ''").groupBy("t").agg(F.max("w").alias("w"), F.bool_or(F.col("w").isNull()).alias("strict"))
    some = found.limit(MOST_TERMS + 1).collect()
    if len(some) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return tuple(sorted(r.t for r in some if r.strict)), {r.t: r.w for r in sorted(some) if not r.strict}


def filter_urls(pages: DataFrame, rules=RULES, vocabulary: tuple[Sequence[str], Mapping[str, int]] = (STRICT, SOFT), limit: int = LIMIT, least_soft: int = LEAST_SOFT, url: str = "url", keep=("page_id",)) -> DataFrame:
    """Columns of ``keep``, ``host``, ``path``, ``rule`` (null if none fits), ``verdict``, ``term_score`` and ``terms`` of each url.

    ``vocabulary`` has the strict terms and the soft ones with weights, as ``read_vocabulary`` gives. A null url and one
    without ``://`` have an empty host and path; no rule fits, so the vocabulary decides (null: allow). Repeated rows stay;
    an empty table gives an empty one; a column of ``keep`` named like one of the result gives way to it.
    """
    strict, soft = vocabulary
    key = (tuple(map(tuple, rules)), tuple(strict), tuple(sorted(soft.items())), limit, least_soft)

    def start():
        judge = _judge(*key).judge
        return lambda urls: list(zip(*map(judge, urls), strict=True))

    out = [("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string"), ("term_score", "long"), ("terms", "string")]
    return map_texts(pages, start, out, url, keep)
