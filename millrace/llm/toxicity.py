"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, turns compatibility letters (full-width, mathematical,
circled) into plain ones, removes marks and characters without width, replaces
homoglyphs of Latin letters, undoes digit and symbol substitutions inside words, and makes everything else one blank, so that
terms can be anchored at the start (` term`) or at both ends (` term `) of a word.

The lexicon is learned from labelled documents: word starts and whole words
whose share among toxic documents is many times that among the others, counted
by families of near copies so that a copied text speaks once.  A start is
extended as long as its extension keeps nearly all of its support.  Words and
word pairs that hold a term but occur rather in clean documents become
exception phrases; hits inside them do not count.  The sum of the weights and
the sum by length go through a logistic calibration.

At most `max_rows` labelled documents, the first by a hash of their id, are used
for learning; every document is scored.

Defined results: null and empty texts score as a text without hits; rows without
a label, with a null label or id, and held-out rows are never learned from; an
id with several labels is toxic if any of them is.  Without any toxic or any
clean label the score is the smoothed share of toxic labels.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import ddl, free, frugal, pick, slices, strings
from ..operators.materialize import materialize

# Letters of other scripts that look like Latin ones, and usual substitutions.
HOMOGLYPHS = str.maketrans("асеорхуіјѕԁһкмтвнгαεικνορτυχ", "aceopxyijsdhkmtbhraeiknoptux")
SUBSTITUTES = str.maketrans("0134578@$!|+", "oieastbasilt")

_LEET = re.compile(r"\S*[0134578@$!|+]\S*")
# A single $ or @ in front may stand for a letter.
_EDGES = re.compile(r"^(?:[\W_]{2,}|[^\w@$])|[\W_]+$")
_OTHER = re.compile(r"[\W_]+")


# Combining marks and characters without width, which are written into words to hide them.
_HIDDEN = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u2060-\u2064\ufe00-\ufe0f\ufeff]+")


def _undo(match: re.Match) -> str:
    word = _EDGES.sub("", match[0])
    return word.translate(SUBSTITUTES) if any(c.isalpha() for c in word) else word


def fold(text: str) -> str:
    """Words of the folded text, each with one blank before and after it."""
    text = text.lower()
    if not text.isascii():
        # Full-width, mathematical and circled letters become plain ones; letters with marks of usage stay composed.
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text).lower()
        text = _HIDDEN.sub("", text).translate(HOMOGLYPHS)
    text = _LEET.sub(_undo, text)
    return " " + _OTHER.sub(" ", text).strip() + " "


def _family(words: list[str]) -> int:
    """The same for most near copies, and not for unrelated texts: the four smallest hashes of three words in a row, together."""
    data = {" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass") for i in range(max(1, len(words) - 2))}
    least = heapq.nsmallest(4, (zlib.crc32(d) << 32 | zlib.adler32(d) for d in data))
    return int.from_bytes(hashlib.blake2b(repr(least).encode(), digest_size=8).digest(), "big", signed=True)


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    slope_sum: float = 0.0
    slope_rate: float = 0.0
    bias: float = 0.0

    def matcher(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        automaton = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            automaton.add_word(term, (len(term), weight))
        automaton.make_automaton()
        return automaton

    def hits(self, automaton, folded: str) -> Iterator[tuple[int, float]]:
        """(start of the word, weight) of the heaviest term at each word, outside exception phrases."""
        if automaton is None:
            return
        best: dict[int, float] = {}
        for end, (size, weight) in automaton.iter(folded):
            a = end - size + 1
            best[a] = max(weight, best.get(a, 0.0))
        for a, weight in best.items():
            if not self.exceptions or not self.exceptions.intersection(phrases(folded, a)):
                yield a, weight

    def features(self, automaton, text: str) -> tuple[float, float]:
        folded = fold(text)
        total = sum(weight for _, weight in self.hits(automaton, folded))
        return math.log1p(total), math.log1p(100 * total / max(1, folded.count(" ") - 1))

    def score(self, by_sum: float, by_length: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope_sum * by_sum + self.slope_rate * by_length))))


def phrases(folded: str, start: int) -> tuple[str, str, str]:
    """The word that begins after the blank at `start`, and it with its left and with its right neighbour."""
    end = folded.find(" ", start + 1)
    left = folded.rfind(" ", 0, start) + 1
    right = folded.find(" ", end + 1)
    return folded[start + 1 : end], folded[left:end] if left <= start else folded[start + 1 : end], folded[start + 1 : right if right > 0 else end]


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % 3 == 1, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str, max_rows: int) -> DataFrame:
    """toxic and text of the labelled documents to learn from, at most max_rows; of a repeated id the text with the smallest hash."""
    chosen = pick(labels, id=doc_id, toxic=label).filter(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("id"))
    chosen = chosen.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    found = pick(documents, id=doc_id, text=text).join(F.broadcast(chosen), "id").withColumn("text", F.coalesce("text", F.lit("")))
    one = found.groupBy("id").agg(F.max("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text"), "text")).alias("x"))
    return materialize(one.select("toxic", "x.text"), "toxicity-sample")


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, family) of toxic documents."""
    for b in slices(batches, 32):
        terms, families = [], []
        for text in strings(b.column(0)):
            row = fold(text).split()
            words = set(row)
            own = {f" {w[:n]}" for w in words for n in range(4, len(w) + 1)} | {f" {w} " for w in words if len(w) > 2}
            terms += own
            families += [_family(row)] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(families, pa.int64())], ["term", "family"])


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, family) of documents."""
    for b in slices(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_family(fold(text).split()) for text in strings(b.column(1))], pa.int64())], ["toxic", "family"])


def _found(terms: list[str]):
    """(term, family) of documents that hold one of the terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for t in terms:
            automaton.add_word(t, t)
        automaton.make_automaton()
        for b in slices(batches):
            found, families = [], []
            for text in strings(b.column(0)):
                folded = fold(text)
                own = {t for _, t in automaton.iter(folded)}
                if own:
                    found += own
                    families += [_family(folded.split())] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(families, pa.int64())], ["term", "family"])

    return run


def _contexts(lexicon: Lexicon):
    """(phrase, toxic, family) around hits; a null phrase for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.matcher()
        for b in slices(batches):
            rows = []
            for toxic, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                folded = fold(text)
                family = _family(folded.split())
                rows += {(p, toxic, family) for a, _ in lexicon.hits(automaton, folded) for p in phrases(folded, a)}
            phrase, toxic, family = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(phrase, pa.string()), pa.array(toxic, pa.int32()), pa.array(family, pa.int64())], ["phrase", "toxic", "family"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge; the first column of x is 1."""
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(x.shape[1]), x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _choose(pos: dict[str, int], neg: dict[str, int], n_pos: int, n_neg: int, min_log_odds: float) -> dict[str, float]:
    """Terms with enough weight, none a start of another; starts are extended as far as nearly all support goes."""
    weight = {t: math.log((p + 0.5) / (n_pos + 1)) - math.log((neg.get(t, 0) + 0.5) / (n_neg + 1)) for t, p in pos.items()}
    out: dict[str, float] = {}
    extension: dict[str, str] = {}
    for t in pos:
        if len(t) > 1 and t[:-1] in pos and pos[t] >= 0.95 * pos[t[:-1]]:
            extension[t[:-1]] = t
    for t in sorted(pos, key=lambda t: (len(t), t)):
        if weight[t] < min_log_odds or any(t[:n] in out for n in range(2, len(t))):
            continue
        while (longer := extension.get(t)) and weight[longer] >= weight[t] - 0.1:
            t = longer
        out[t] = weight[t]
    return out


def learn(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 20_000, min_families: int = 5, min_share: float = 0.004, min_log_odds: float = 3.0) -> Lexicon:
    """The lexicon; only counts of terms that at least min_families and min_share of the toxic families hold, and two figures for each sampled row, come to the driver."""
    rows = sample(documents, labels, doc_id=doc_id, text=text, label=label, max_rows=max_rows)
    by = {r["toxic"] > 0: r["n"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = by.get(True, 0), by.get(False, 0)
    prior = math.log((n_pos + 0.5) / (n_neg + 0.5)) if n_pos + n_neg else -2.0
    if not n_pos or not n_neg:
        return Lexicon(bias=prior)
    # From here on families are counted, as for the terms.
    families = rows.select((F.col("toxic") > 0).cast("int").alias("toxic"), "text").mapInArrow(frugal(_families), "toxic int, family bigint")
    of = {r["toxic"]: r["n"] for r in families.groupBy("toxic").agg(F.count_distinct("family").alias("n")).collect()}
    n_pos, n_neg = of.get(1, 0), of.get(0, 0)
    least = max(min_families, math.ceil(min_share * n_pos))
    counted = lambda df: {r["term"]: r["n"] for r in df.groupBy("term").agg(F.count_distinct("family").alias("n")).filter(F.col("n") >= F.lit(1)).collect()}
    pos = {r["term"]: r["n"] for r in rows.filter("toxic > 0").select("text").mapInArrow(frugal(_terms), "term string, family bigint").groupBy("term").agg(F.count_distinct("family").alias("n")).filter(F.col("n") >= least).collect()}
    if not pos:
        return Lexicon(bias=prior)
    neg = counted(rows.filter("toxic <= 0").select("text").mapInArrow(frugal(_found(sorted(pos))), "term string, family bigint"))
    lexicon = Lexicon(_choose(pos, neg, n_pos, n_neg, min_log_odds))
    labelled = rows.select(F.col("toxic").cast("int").alias("toxic"), "text")
    seen = labelled.mapInArrow(frugal(_contexts(lexicon)), "phrase string, toxic int, family bigint").groupBy("phrase").agg(F.count_distinct(F.when(F.col("toxic") > 0, F.col("family"))).alias("pos"), F.count_distinct(F.when(F.col("toxic") <= 0, F.col("family"))).alias("neg"))
    lexicon.exceptions = frozenset(r["phrase"] for r in seen.filter((F.col("neg") >= 2) & ((F.col("neg") + 0.5) * (n_pos + 1) > (F.col("pos") + 0.5) * (n_neg + 1))).collect())
    points = np.array([tuple(r) for r in _apply(labelled, lexicon, ["toxic"]).drop("score").collect()], float)
    beta = _logistic(np.column_stack([np.ones(len(points)), points[:, 1:]]), (points[:, 0] > 0).astype(float))
    lexicon.bias, lexicon.slope_sum, lexicon.slope_rate = map(float, beta)
    return lexicon


def _apply(documents: DataFrame, lexicon: Lexicon, keep: list[str], text: str = "text", names_of: tuple[str, str, str] = ("by_sum", "by_length", "score")) -> DataFrame:
    """The kept columns, and under the given names the sum of weights, that by length, and the score of the text column."""
    names = keep if text in keep else [*keep, text]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.matcher()
        for b in slices(batches):
            found = [lexicon.features(automaton, t) for t in strings(b.column(at))]
            sums, rates = [x[0] for x in found], [x[1] for x in found]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(sums, pa.float64()), pa.array(rates, pa.float64()), pa.array([lexicon.score(*x) for x in found], pa.float64())], [*keep, *names_of])

    source = documents.select(*(F.col(f"`{c}`") for c in names))
    return source.mapInArrow(frugal(run), ", ".join([ddl(source, keep), *(f"`{name}` double" for name in names_of)]))


def score(documents: DataFrame, lexicon: Lexicon, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every document."""
    return _apply(pick(documents, doc_id=doc_id, text=text), lexicon, ["doc_id"]).select("doc_id", "score")


def reject(documents: DataFrame, lexicon: Lexicon, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The documents with a score below the threshold, with all their columns."""
    names, own = documents.columns, free(documents, "by_sum", "by_length", "score")
    return _apply(documents, lexicon, names, text, tuple(own)).filter(F.col(own[2]) < threshold).select(*(F.col(f"`{c}`") for c in names))
