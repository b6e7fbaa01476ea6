"""License scans: matching statistics against a generalised suffix automaton of licence tokens.

The automaton holds every run of words of every template, and where in the templates each run ends. A document's words
are streamed through it; at each word it knows the longest run ending there that some template holds. Long runs are
chained for each template: in the order of the document and of the template alike, so a chain covers every word of the
template at most once. A chain that covers a large enough share of its template is a span and gives the template's label.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

from pyspark.sql import DataFrame

from docloom.llm.license_texts import TEMPLATES
from docloom.llm.runtime import map_texts

#: Phrases and the labels that each place of them gives.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Runs of fewer words don't count.
RUN = 4
#: Words that may lie between two runs of one span.
GAP = 12
#: Share of a template's words that must be covered for its label.
COVER = 0.8
#: Words that the templates of one scan may have in all: they are held by the driver and by every worker.
MOST_WORDS = 2_000_000

#: Every byte that is no digit, no ASCII letter and not part of a character beyond ASCII becomes a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over word ids, with the ends of each state's runs in the templates."""

    def __init__(self, templates: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        for words in templates:
            last = 0
            for w in words:
                last = self._extend(last, w)
        # a state's runs end where those of the states below it in the tree of links do: a slice, in the order of a walk
        below: list[list[int]] = [[] for _ in self.link]
        for q in range(1, len(self.link)):
            below[self.link[q]].append(q)
        ends: list[list[tuple[int, int]]] = [[] for _ in self.link]
        for k, words in enumerate(templates):
            at = 0
            for i, w in enumerate(words, 1):
                at = self.next[at][w]
                ends[at].append((k, i))
        self.ends: list[tuple[int, int]] = []  # (template, words up to the end of the run)
        self.first, self.past = [0] * len(self.link), [0] * len(self.link)
        walk = [(0, False)]
        while walk:
            q, left = walk.pop()
            if left:
                self.past[q] = len(self.ends)
                continue
            self.first[q] = len(self.ends)
            self.ends += ends[q]
            walk.append((q, True))
            walk += [(c, False) for c in below[q]]

    def places(self, state: int) -> Iterator[tuple[int, int]]:
        """Every (template, end) of the state's runs."""
        return iter(self.ends[self.first[state] : self.past[state]])

    def _state(self, size: int, like: int | None = None) -> int:
        self.next.append(dict(self.next[like]) if like is not None else {})
        self.link.append(self.link[like] if like is not None else 0)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of the run that reaches q from p by w, made of its own if q also holds longer runs."""
        if self.size[q] == self.size[p] + 1:
            return q
        twin = self._state(self.size[p] + 1, q)
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w])
        new, p = self._state(self.size[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.next[p][w])
        return new


class Scanner:
    def __init__(self, templates: Mapping[str, Sequence[str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, run: int = RUN, gap: int = GAP, cover: float = COVER):
        self.run, self.gap, self.cover = run, gap, cover
        self.templates = [(label, words_of(t)) for label, texts in templates.items() for t in texts]
        if (n := sum(len(w) for _, w in self.templates)) > MOST_WORDS:
            raise ValueError(f"templates of {n} words; at most {MOST_WORDS} fit a scan")
        self.ids: dict[bytes, int] = {}
        coded = [[self.ids.setdefault(w, len(self.ids)) for w in words] for _, words in self.templates]
        self.automaton = Automaton(coded)
        self.lengths = [len(w) for w in coded]
        self.phrases = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in phrases.items()]

    def runs(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(start, end, state) of the maximal runs of words that some template holds, by matching statistics."""
        a, get = self.automaton, self.ids.get
        step, link, size = a.next, a.link, a.size
        found, state, length = [], 0, 0
        for i, w in enumerate(words):
            t = get(w)
            if t is None:
                if length > 1:
                    found.append((i - length, i, state))
                state = length = 0
                continue
            after = step[state].get(t)
            if after is None:
                if length > 1:
                    found.append((i - length, i, state))
                while after is None and state > 0:
                    state = link[state]
                    length = size[state]
                    after = step[state].get(t)
                if after is None:
                    length = 0
                    continue
            state, length = after, length + 1
        if length > 1:
            found.append((len(words) - length, len(words), state))
        return found

    def chains(self, runs: Sequence[tuple[int, int, int]]) -> dict[int, list[tuple[int, int, int]]]:
        """For each template (start, end, covered words) of the best chain that ends with each run in each of its places.

        ``runs`` are (start, end, state) in order. A run follows another if it goes on further in the document and in
        the template, with at most ``gap`` words of the document between; words that both would cover count once.
        """
        live: dict[int, list[tuple[int, int, int, int, int]]] = {}  # template: (end, end in it, covered, start, start of the last run)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for start, end, state in runs:
            n, after = end - start, {}
            for k, to in self.automaton.places(state):
                best = (n, start)
                known = live.setdefault(k, [])
                if known and known[0][0] < start - self.gap:
                    known[:] = [x for x in known if x[0] >= start - self.gap]
                for e, t, covered, first, _ in known:
                    if e < end and t < to:
                        fresh = n - max(0, e - start, t - (to - n))
                        if fresh > 0 and (covered + fresh, first) > best:
                            best = covered + fresh, first
                after.setdefault(k, []).append((end, to, best[0], best[1], start))
            for k, more in after.items():
                live[k] += more
                found.setdefault(k, []).extend((x[3], x[0], x[2]) for x in more)
        return found

    def spans(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, start, end, covered share) of the templates that chained runs cover well enough.

        Of overlapping spans of one template the one that covers most stays, then the shortest, then the first.
        """
        out = []
        for k, ended in sorted(self.chains([r for r in self.runs(words) if r[1] - r[0] >= self.run]).items()):
            label, size = self.templates[k][0], self.lengths[k]
            taken: list[tuple[int, int]] = []
            for start, end, n in sorted((x for x in ended if x[2] >= self.cover * size), key=lambda x: (-x[2], x[1] - x[0], x[0])):
                i = bisect_left(taken, (start, end))
                if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or taken[i][0] >= end):
                    taken.insert(i, (start, end))
                    out.append((label, start, end, n / size))
        return out

    def places(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(first word, label) of every place of a phrase."""
        line = b" " + b" ".join(words) + b" "
        out = []
        for phrase, label in self.phrases:
            at, seen, index = line.find(phrase), 0, 0
            while at >= 0:
                index += line.count(b" ", seen, at)
                seen = at
                out.append((index, label))
                at = line.find(phrase, at + 1)
        return out


@lru_cache(maxsize=2)
def scanner(templates: tuple[tuple[str, tuple[str, ...]], ...] = tuple(TEMPLATES.items())) -> Scanner:
    return Scanner(dict(templates))


def read_templates(rows: DataFrame, label: str = "label", text: str = "text") -> dict[str, tuple[str, ...]]:
    """Templates from a table of licence texts, which must be small enough for a scan. Rows without label or text are left out."""
    from pyspark.sql import functions as F

    some = rows.select(F.col(label).alias("label"), F.col(text).alias("text")).dropna()
    size = some.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > 16 * MOST_WORDS:
        raise ValueError(f"licence texts of {size} bytes; at most {16 * MOST_WORDS} fit a scan")
    found: dict[str, list[str]] = {}
    for r in sorted(set(map(tuple, some.collect()))):
        found.setdefault(r[0], []).append(r[1])
    return {k: tuple(v) for k, v in found.items()}


def scan(docs: DataFrame, text: str = "text", keep=("doc_id",), templates: Mapping[str, Sequence[str]] = TEMPLATES) -> DataFrame:
    """Columns of ``keep``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score`` and ``spans``.

    ``templates`` has the texts of each label, such as ``read_templates`` gives. ``spans`` lists the covered templates
    as label:start:end by words. The score is the largest covered share of a template whose label is given, 1 where a
    phrase stands, else 0. Null and empty texts have no words, no labels and the score 0. Repeated rows stay; an empty
    table gives an empty one; a column of ``keep`` that is named like one of the result gives way to it.
    """
    key = tuple((k, tuple(v)) for k, v in templates.items())

    def start():
        s = scanner(key)

        def run(texts):
            rows = []
            for t in texts:
                words = words_of(t)
                places, spans = s.places(words), s.spans(words)
                base = {label for _, label in places}
                at = [i for i, _ in places]
                share = 1.0 if places else max((x[3] for x in spans), default=0.0)
                rows.append((len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[0] for x in spans})), share, [f"{k}:{a}:{b}" for k, a, b, _ in spans]))
            return list(zip(*rows, strict=True))

        return run

    out = [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double"), ("spans", "array<string>")]
    return map_texts(docs, start, out, text, keep)
