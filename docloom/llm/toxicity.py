"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; texts of the corpus, whose labels are not looked at, are the unlabelled ones.
The risk of a linear classifier is estimated from both with the class prior, and its negative part is kept from falling
below zero, which is what overfitting to unlabelled texts would make of it. The prior is given, or estimated from
positives and unlabelled texts alone: on texts held back, the smallest share of unlabelled against that of positives
above a score, with a margin for chance. Words and their beginnings enter as present or absent.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.licenses import words_of
from docloom.llm.runtime import map_texts

#: Rows of positive and of unlabelled texts that a classifier is fitted on at most, those of the least hashes.
POSITIVES, UNLABELLED = 3_000, 6_000
#: Prior of the classifier that the estimate of the prior goes by, its steps, and the chance of error that its margin allows.
FIRST_PRIOR, FIRST_STEPS, CHANCE = 0.3, 300, 0.1
#: Bytes of the beginnings of words that are looked at besides whole words.
BEGINNINGS = (4, 5, 6, 7)
#: Words and beginnings that a classifier weighs at most, and positives that must hold one.
WORDS, LEAST_TEXTS = 1024, 3
#: Training: steps, step size, decay of weights.
STEPS, RATE, DECAY = 800, 0.05, 1e-5


def word_hashes(text: str) -> list[int]:
    """Hashes of the distinct words of a text, lower-cased, and of the beginnings of longer ones."""
    words = set(words_of(text.lower()))
    return [zlib.crc32(w) for w in words | {b"^" + w[:k] for w in words for k in BEGINNINGS if len(w) > k}]


@dataclass
class Classifier:
    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float = 0.0

    def table(self) -> dict[int, float]:
        return dict(zip(self.hashes.tolist(), self.weights.tolist(), strict=True))


def choose_words(positives: Sequence[np.ndarray], unlabelled: Sequence[np.ndarray]) -> np.ndarray:
    """Hashes of the words whose share among positives departs most from that among unlabelled texts."""
    p, u = (np.concatenate(t) if len(t) else np.zeros(0, np.int64) for t in (positives, unlabelled))
    values, pos = np.unique(p, return_counts=True)
    at = np.searchsorted(values, u)
    known = at < len(values)
    known[known] = values[at[known]] == u[known]
    every = np.bincount(at[known], minlength=len(values))
    n = len(positives)
    share = (every + 1) / (len(unlabelled) + 2)
    z = (pos - n * share) / np.sqrt(n * share * (1 - share) + 1e-9)
    able = np.flatnonzero((pos >= min(LEAST_TEXTS, max(n, 1))) & (np.abs(z) > 3))
    order = able[np.lexsort((values[able], -np.abs(z[able])))][:WORDS]
    return np.sort(values[order])


def presence(texts: Sequence[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """A row for each text, a column for each word: 1 where the text holds it."""
    x = np.zeros((len(texts), len(hashes)), np.float32)
    for i, w in enumerate(texts if len(hashes) else []):
        at = np.minimum(np.searchsorted(hashes, w), len(hashes) - 1)
        x[i, at[hashes[at] == w]] = 1
    return x


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(z / 2))


def risk(p: np.ndarray, u: np.ndarray, prior: float, w: np.ndarray, b: float) -> tuple[float, float]:
    """The positive and the negative part of the risk with the sigmoid loss, before the latter is kept from falling below zero."""
    sp, su = _sigmoid(p @ w + b), _sigmoid(u @ w + b)  # loss(-f) is sigmoid(f), loss(f) is 1 - sigmoid(f)
    return prior * float((1 - sp).mean()), float(su.mean()) - prior * float(sp.mean())


def minimise(p: np.ndarray, u: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk of positives and unlabelled rows, by Adam over all rows.

    risk = prior * E+[loss(f)] + max(0, E[loss(-f)] - prior * E+[loss(-f)]); where the second part is negative,
    a step goes up its slope instead.
    """
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1)
    for step in range(1, steps + 1):
        sp, su = _sigmoid(p @ w + b), _sigmoid(u @ w + b)
        dp, du = sp * (1 - sp) / len(p), su * (1 - su) / len(u)
        negative = su.mean() - prior * sp.mean()
        slope_negative = np.append(du @ u - prior * (dp @ p), du.sum() - prior * dp.sum())
        slope_positive = -prior * np.append(dp @ p, dp.sum())
        g = slope_positive + slope_negative if negative >= 0 else -slope_negative
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - change[:-1], b - change[-1]
    return w, b


def fit_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """As ``minimise``, where the positives are among the unlabelled rows."""
    return minimise(x[positive], x, prior, steps, rate, decay)


def prior_of(held_p: np.ndarray, held_u: np.ndarray, chance: float = CHANCE) -> float:
    """The share of positives among unlabelled texts, from scores of both that the classifier wasn't fitted on.

    Above a score lie a share of the unlabelled and one of the positives; the former is at least the latter times the
    prior. The score is the one at which their ratio, with a margin for chance, is least.
    """
    if not len(held_p) or not len(held_u):
        return 1.0
    at = np.unique(held_p)
    share = lambda s: 1 - np.searchsorted(np.sort(s), at) / len(s)
    up, pp = share(held_u), share(held_p)
    margin = lambda n: np.sqrt(np.log(4 / chance) / (2 * n))
    bound = (up + margin(len(held_u)) + margin(len(held_p))) / pp
    best = int(np.argmin(bound))
    return float(min(1.0, max(up[best] / pp[best], 1 / len(held_u))))


def estimate_prior(positives: Sequence[np.ndarray], unlabelled: Sequence[np.ndarray]) -> float:
    """The prior by two halves in turn: one to fit a classifier on, the other to read the shares from."""
    found = []
    for k in (0, 1):
        own, held = (positives[k::2], unlabelled[k::2]), (positives[1 - k :: 2], unlabelled[1 - k :: 2])
        if not all(map(len, (*own, *held))):
            continue
        hashes = choose_words(*own)
        w, b = minimise(presence(own[0], hashes), presence(own[1], hashes), FIRST_PRIOR, FIRST_STEPS)
        found.append(prior_of(presence(held[0], hashes) @ w + b, presence(held[1], hashes) @ w + b))
    return float(np.mean(found)) if found else FIRST_PRIOR


def _sample(rows: DataFrame, text: str, most: int) -> list[np.ndarray]:
    """Hashes of the words of at most ``most`` rows, those of the least hashes of id and text (column ``__h``)."""
    words = map_texts(rows, lambda: lambda t: ([word_hashes(x) for x in t],), [("words", "array<long>")], text, ("__h",))
    table = words.orderBy("__h").limit(most).toArrow()
    found = [np.sort(np.asarray(w.values, np.int64)) for w in table["words"]]
    return [w for _, w in sorted(zip(table["__h"].to_pylist(), found, strict=True), key=lambda r: (r[0], r[1].tobytes()))]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", label: str = "toxic", prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Classifier:
    """Learn from texts labelled 1 and from a sample of all of ``docs`` as unlabelled; other labels are never looked at.

    At most ``positives`` and ``unlabelled`` rows reach the driver, as hashes of words, however often a row is repeated.
    Without a ``prior`` it is estimated. Null ids are no positives. Without positives every text scores 0.
    """
    confirmed = labels.filter((F.col(label) == 1) & F.col(id_column).isNotNull()).select(F.col(id_column).alias("__id")).distinct()
    some = F.broadcast(confirmed.orderBy(F.xxhash64("__id"), "__id").limit(positives))  # at most that many rows
    rows = docs.select(F.col(id_column).alias("__id"), F.col(text).alias("__text"))
    rows = rows.withColumn("__h", F.xxhash64("__id", "__text"))
    pos = _sample(rows.join(some, "__id", "left_semi"), "__text", positives)
    if not pos:
        return Classifier(np.zeros(0, np.int64), np.zeros(0), -np.inf)
    # twice as many as wanted, so that chance leaves enough
    share = min(1.0, 2 * unlabelled / max(docs.count(), 1))
    thin = rows.filter(F.pmod(F.xxhash64("__h", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)))
    unl = _sample(thin, "__text", unlabelled)
    prior = estimate_prior(pos, unl) if prior is None else prior
    hashes = choose_words(pos, unl)
    weights, bias = minimise(presence(pos, hashes), presence(unl, hashes), prior)
    return Classifier(hashes, weights, bias, prior)


def score(docs: DataFrame, model: Classifier, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """Columns of ``keep``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5) of each whole text; null texts count as empty.

    Repeated rows stay; an empty table gives an empty one; a column of ``keep`` named like one of the result gives way to it.
    """

    def start():
        weight = model.table()
        known = weight.keys()

        def run(texts):
            z = np.array([model.bias + sum(weight[h] for h in sorted(known & set(word_hashes(t)))) for t in texts])
            s = _sigmoid(z)
            return s, (s >= 0.5).astype(np.int32)

        return run

    return map_texts(docs, start, [("score", "double"), ("predicted", "int")], text, keep)
