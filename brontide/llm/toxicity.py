"""Toxicity by weak supervision.

Voters are many weak ones, for either label: a lexicon of words and word beginnings that
are at least three times as frequent in the texts of one label as in the other's (at most
``FEATURES`` for label 1 and ``FEATURES // 4`` for label 0), the hand-written patterns of
``PATTERNS``, and the hand label itself, which is one voter among them.  A generative
label model estimates how often each voter speaks in either class (its accuracy), by EM
that starts from the hand labels; votes of voters that agree beyond chance inside the
classes are counted down by these correlations.  Its posterior labels train a logistic
regression over the lexicon and pattern voters, which alone can be seen at scoring time;
held-out folds of the sample calibrate its two parameters of scale.  Scoring needs one
look-up per distinct word and reads whole texts.

Sample (documented bound): about ``SAMPLE`` label rows of each label, chosen by a hash of
their id, ``4 * SAMPLE`` at most, with whole texts; near copies in the sample are left out
(``unlike``).

Defined cases: null counts as the empty text, which gets the score of a text
that no voter marks; without labelled rows of both kinds every score is 0;
repeated rows are scored once each; a document with several labels is learned
from once per label row; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import arrow_batches

SAMPLE, FEATURES = 1500, 400
RIDGE = 0.1
_WORD = re.compile(r"[^\W\d_]+")
_CUTS = (4, 5, 6, 7, 8)
#: Pattern voters, by name.
PATTERNS = {
    "shouting": re.compile(r"\b[A-Z]{4,}\W+[A-Z]{4,}\b"),
    "marks": re.compile(r"[!?]{2,}"),
    "starred": re.compile(r"\w[*@#$]\w"),
    "address": re.compile(r"(?i)\b(?:you|vous|ihr) (?:are|re|all|êtes|seid)\b"),
    "numbers": re.compile(r"\d+[.,:]\d+"),
    "list": re.compile(r"(?m)^\s*(?:[-*]|\d+\.)\s"),
}


def features(text: str) -> set[str]:
    """The words of a text, their beginnings (with a dash, two if several words share one), and its patterns (with a colon)."""
    words = set(_WORD.findall(text.lower()))
    out = set(words)
    for k in _CUTS:
        starts = Counter(w[:k] + "-" for w in words if len(w) > k)
        out.update(starts)
        out.update(w + "-" for w, n in starts.items() if n > 1)
    out.update(":" + k for k, p in PATTERNS.items() if p.search(text))
    return out


class Rows:
    """Labelled texts as arrays of feature numbers, so that each text is read once, however often it is fitted."""

    def __init__(self, rows: list[tuple[str, int]]) -> None:
        number: dict[str, int] = {}
        self.own = [np.array([number.setdefault(k, len(number)) for k in sorted(features(text))], np.int64) for text, _ in rows]
        self.names = list(number)
        self.labels = np.array([y for _, y in rows])

    def counts(self, which: np.ndarray) -> np.ndarray:
        """How many of the chosen rows have each feature."""
        some = [self.own[i] for i in which]
        return np.bincount(np.concatenate(some) if some else np.zeros(0, np.int64), minlength=len(self.names))

    def votes(self, which: np.ndarray, chosen: list[int]) -> np.ndarray:
        """0/1 [row, voter]."""
        place = np.full(len(self.names) + 1, -1)
        place[chosen] = np.arange(len(chosen))
        out = np.zeros((len(which), len(chosen)))
        for r, i in enumerate(which):
            at = place[self.own[i]]
            out[r, at[at >= 0]] = 1
        return out


def mine(rows: Rows, which: np.ndarray) -> list[int]:
    """The features that speak for one label, those for label 1 first, and the patterns that occur."""
    patterns = [i for i, k in enumerate(rows.names) if k[0] == ":"]
    return _telling(rows, which, 1, FEATURES) + _telling(rows, which, 0, FEATURES // 4) + patterns


def _telling(rows: Rows, which: np.ndarray, label: int, most: int) -> list[int]:
    """The features that speak for ``label``, the most telling first."""
    for_it = rows.labels[which] == label
    n1, n0 = int(for_it.sum()), int((~for_it).sum())
    ones, zeros = rows.counts(which[for_it]), rows.counts(which[~for_it])
    rate = ((ones + 0.1) / (n1 + 1)) / ((zeros + 0.1 * n0 / max(n1, 1)) / (n0 + 1))
    # at least three times as frequent, and more than chance would make it
    chance = ones - (zeros + 1) * n1 / (n0 + 1) - 1.6 * np.sqrt(ones)
    good = {rows.names[i]: int(i) for i in np.flatnonzero((ones >= 3) & (rate > 3) & (chance > -1.5)) if rows.names[i][0] != ":"}
    for k in sorted(good, key=lambda k: (len(k), k)):  # of a beginning and its words, the wider one that is as telling
        if k.endswith("--"):
            continue
        stem = k.rstrip("-")
        shorter = [x for c in _CUTS if c < len(stem) and (x := stem[:c] + "-") in good] + [x for x in (stem + "-",) if k[-1] != "-" and x in good]
        for x in shorter:
            if k in good and x in good:
                i, j = good[k], good[x]
                if ones[i] >= 0.9 * ones[j] and rate[i] > rate[j]:
                    del good[x]
                elif rate[j] >= 0.5 * rate[i]:
                    del good[k]
    return sorted(good.values(), key=lambda i: (-ones[i] * np.log(rate[i]), rows.names[i]))[:most]


def unlike(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The rows without near copies of earlier ones, which would make voters of their common rare words."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text, y in rows:
        keys = sorted(zlib.crc32(w.encode()) for w in set(text.lower().split()))[:6]
        own = set(zip(keys, keys[1:], strict=False))
        if len(own & seen) < 2:
            out.append((text, y))
        seen |= own
    return out


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of label 1 per row, rate of every voter in either class), from 0/1 votes [row, voter].

    The hand label is the last voter.  EM starts from it; then each voter's rate in
    either class and the class of each row are estimated in turn.  A voter's evidence
    is divided by one plus its summed positive correlations with other voters inside the
    classes, so that a word and its beginning are not counted twice; the hand label's by
    its largest one beyond chance only.
    """
    votes = np.c_[votes, labels > 0].astype(float)
    post = np.where(labels > 0, 0.95, 0.05)
    prior = float(np.clip(labels.mean(), 0.02, 0.98))
    rate = np.zeros((2, votes.shape[1]))
    for _ in range(rounds):
        weight = np.stack([1 - post, post])
        rate = (weight @ votes + 0.5 * np.array([[0.02], [0.1]])) / (weight.sum(axis=1, keepdims=True) + 0.5)
        centred = votes - (1 - post)[:, None] * rate[0] - post[:, None] * rate[1]
        spread = np.sqrt((centred**2).mean(axis=0)) + 1e-9
        together = centred.T @ centred / len(votes) / np.outer(spread, spread)
        np.fill_diagonal(together, 0)
        discount = 1 / (1 + np.clip(together, 0, 1).sum(axis=1))
        discount[-1] = 1 / (1 + np.where(together[-1] > 3 / np.sqrt(len(votes)), together[-1], 0).max())
        rate = np.clip(rate, 1e-3, 1 - 1e-3)
        yes, no = np.log(rate[1] / rate[0]) * discount, np.log((1 - rate[1]) / (1 - rate[0])) * discount
        logit = np.log(prior / (1 - prior)) + votes @ yes + (1 - votes) @ no
        post = 1 / (1 + np.exp(-np.clip(logit, -8, 8)))
    return post, rate


def _fit(rows: Rows, which: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(voters, their weights and the bias)."""
    chosen = mine(rows, which)
    votes, labels = rows.votes(which, chosen), rows.labels[which].astype(float)
    target, _ = label_model(votes, labels)
    x = np.hstack([votes, np.ones((len(which), 1))])
    # both labels weigh the same, whatever the sample holds
    importance = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    w, ridge = np.zeros(x.shape[1]), np.r_[np.full(len(chosen), RIDGE), 1e-6]
    for _ in range(25):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ ((p - target) * importance) + ridge * w
        curve = (x.T * (importance * p * (1 - p))) @ x + np.diag(ridge + 1e-6)
        w -= np.clip(np.linalg.solve(curve, grad), -2, 2)
    return chosen, w


def fit(sample: list[tuple[str, int]], folds: int = 4) -> dict[str, float]:
    """Feature -> weight, with the bias under the empty name; {} if a label is missing.

    Weights are scaled so that scores of rows that were left out of a fit match
    their labels (a two-parameter calibration over ``folds`` folds).
    """
    sample = unlike(sample)
    if len({y for _, y in sample}) < 2:
        return {}
    rows, every, found, target = Rows(sample), np.arange(len(sample)), [], []
    for k in range(folds):
        rest, out = every[every % folds != k], every[k::folds]
        if len(set(rows.labels[rest].tolist())) == 2:
            chosen, w = _fit(rows, rest)
            found += (rows.votes(out, chosen) @ w[:-1] + w[-1]).tolist()
            target += rows.labels[out].tolist()
    chosen, w = _fit(rows, every)
    scale = np.array([1.0, 0.0])
    x, y = np.c_[found, np.ones(len(found))], np.array(target, float)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ scale, -30, 30)))
        # a weak pull towards leaving the weights alone
        grad = x.T @ (p - y) + 0.5 * (scale - [1.0, 0.0])
        scale -= np.clip(np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.5 * np.eye(2), grad), -1, 1)
    scale[0] = max(scale[0], 0.2)
    return {rows.names[i]: float(v * scale[0]) for i, v in zip(chosen, w, strict=False)} | {"": float(w[-1] * scale[0] + scale[1])}


class Scorer:
    def __init__(self, weights: dict[str, float]) -> None:
        self.bias = weights.get("")
        self.words = {k: v for k, v in weights.items() if k and k[-1] != "-" and k[0] != ":"}
        self.several = {k[:-2]: v for k, v in weights.items() if k.endswith("--")}
        self.starts = {k[:-1]: v for k, v in weights.items() if k[-1:] == "-" and k[-2:] != "--"}
        self.heads = {k[: _CUTS[0]] for k in [*self.starts, *self.several]}
        self.patterns = [(PATTERNS[k[1:]], v) for k, v in weights.items() if k and k[0] == ":"]

    def __call__(self, text: str | None) -> float:
        return 0.0 if self.bias is None else float(1 / (1 + np.exp(-self.logit(text))))

    def logit(self, text: str | None) -> float:
        text = text or ""
        words = set(_WORD.findall(text.lower()))
        total = self.bias + sum(self.words[w] for w in words & self.words.keys())
        if self.heads:
            near = [w for w in words if w[: _CUTS[0]] in self.heads]
            for k in _CUTS:
                for x, n in Counter(w[:k] for w in near if len(w) > k).items():
                    total += self.starts.get(x, 0.0) + (self.several.get(x, 0.0) if n > 1 else 0.0)
        return total + sum(v for p, v in self.patterns if p.search(text))


def training_rows(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple[str, int]]:
    """A bounded sample of (text, label), in a fixed order."""
    known = labels.where(may_learn & F.col(label_col).isin(0, 1)).select(F.col(id_col), F.col(label_col).alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return []
    hashed = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 40))
    limit = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, SAMPLE / n) * (1 << 40)))])
    # expected 2 * SAMPLE rows of two numbers; an id with very many label rows cannot make them more than 4 * SAMPLE
    few = known.withColumn("h", hashed).where(F.col("h") <= limit[F.col("y")]).orderBy("h", "y").limit(4 * SAMPLE)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(few), id_col).select("h", "t", "y").collect()
    return [(r["t"], int(r["y"])) for r in sorted(rows, key=lambda r: (r["h"], r["y"], r["t"]))]


def score(docs: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", more: tuple[Column, ...] = ()) -> DataFrame:
    """(id, more ..., score) for every row; only the text decides."""
    arrow_batches(docs.sparkSession)
    # one struct, whose fields cannot be taken for columns of this module
    slim = docs.select(F.struct(F.col(id_col), *more).alias("own"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(weights)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([of(x) for x in batch.column(1).to_pylist()], pa.float64())], ["own", "score"])

    scored = slim.mapInArrow(run, StructType([slim.schema["own"], StructField("score", DoubleType())]))
    return scored.select("own.*", "score")
