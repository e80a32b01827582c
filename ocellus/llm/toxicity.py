"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches in folded text.

Folding lower-cases the text and maps look-alike letters of other scripts, full-width letters, and digits and
signs used as letters to plain ones. Matches must not be part of a longer word; a match inside an exception
phrase doesn't count. The matched weights, summed and divided by the number of words, become a score through a
logistic calibration.

Weights are log-odds learned from a bounded sample of labelled training documents, PER_CLASS of either class, whole
whatever their length: a word enters the lexicon if it is in enough toxic documents, is far likelier in toxic
than in other documents, and is spread over unrelated documents. For the last, near copies are first reduced to
one document by three min-hashes of their shingles, so that the vocabulary of one much-copied document isn't
taken for toxic. Exception phrases are word pairs with a lexicon word that only clean documents have, three at least.
All words and phrases that pass are kept: what the sample's texts hold bounds the model, and nothing else does.

Null counts as empty, which scores as a text without matches. Texts are scored whole, of any length. Every row gives a
row, also of repeated or null ids; other columns are not read. Without labels of both classes every score is the share
of toxic labels (0 without labels). An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import itertools
import re
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, keep_texts, map_texts, ship
from .training import fit_logistic, labelled_sample, sigmoid

PER_CLASS, FOLDS, THRESHOLD = 4000, 5, 0.5
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS = 4, 0.004, 2.5
#: Look-alike characters and what they stand for (fixed values).
LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ℓ": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
}
_TABLE = {ord(k): v for k, v in LOOK_ALIKE.items()} | {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {0xFF10 + i: LOOK_ALIKE.get(str(i), str(i)) for i in range(10)}
_SIGNS = re.compile(r"(?<=[^\W\d_])[@$|](?=[^\W\d_])")
_SIGN = {"@": "a", "$": "s", "|": "l"}
WORD = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    text = text.lower().translate(_TABLE)
    return _SIGNS.sub(lambda m: _SIGN[m[0]], text) if any(s in text for s in "@$|") else text


@dataclass
class ToxicityModel:
    words: dict[str, float] = field(default_factory=dict)
    phrases: set[str] = field(default_factory=set)
    weights: np.ndarray | None = None
    prior: float = 0.0

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.words:
            return None
        if not hasattr(self, "_automaton"):
            self._automaton = ahocorasick.Automaton()
            for word, weight in self.words.items():
                self._automaton.add_word(word, (len(word), weight))
            for phrase in self.phrases - self.words.keys():
                self._automaton.add_word(phrase, (len(phrase), 0.0))
            self._automaton.make_automaton()
        return self._automaton

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of lexicon words in a folded text, without those in exception phrases."""
        machine = self.automaton()
        if machine is None:
            return []
        found = [(end + 1 - n, end + 1, w) for end, (n, w) in machine.iter(text)]
        found = [x for x in found if (x[0] == 0 or not text[x[0] - 1].isalnum()) and (x[1] == len(text) or not text[x[1]].isalnum())]
        if not found or not self.phrases:
            return found
        excused = sorted((a, b) for a, b, w in found if w == 0.0)
        starts, reach = [a for a, _ in excused], [0, *itertools.accumulate((b for _, b in excused), max)]
        return [x for x in found if x[2] != 0.0 and reach[bisect.bisect_right(starts, x[0])] < x[1]]

    def load(self, texts: list[str]) -> np.ndarray:
        """The feature of each text: log of 1 + 100 times the matched weight per word."""
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            text = folded(text)
            if hits := self.matches(text):
                out[i] = sum(w for _, _, w in hits) / max(1, len(text.split()))
        return np.log1p(100 * np.maximum(out, 0))

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        return sigmoid(self.load(texts) * self.weights[0] + self.weights[1])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}


def _signatures(texts: list[bytes]) -> dict[str, object]:
    """Distinct folded words, and three min-hashes of the text's three-word shingles."""
    found = [WORD.findall(folded(t.decode())) for t in texts]
    shingles = [{" ".join(x[i : i + 3]) for i in range(max(1, len(x) - 2))} for x in found]
    least = [[min(xxhash.xxh3_64_intdigest(s, seed) >> 1 for s in x) for x in shingles] for seed in (1, 2, 3)]
    return {"words": pa.array([sorted(set(x)) for x in found], pa.list_(pa.string()))} | {f"m{i}": pa.array(v, pa.int64()) for i, v in enumerate(least)}


def _lexicon(sample: DataFrame) -> dict[str, float]:
    """Weights of the words that mark toxic documents, counted over documents that aren't near copies of each other."""
    unlike = map_texts(sample, _signatures, "words array<string>, m0 long, m1 long, m2 long").join(sample.select("doc_id", "y"), "doc_id")
    for m in ("m0", "m1", "m2"):
        first = unlike.groupBy("y", m).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
        unlike = unlike.join(first, "doc_id", "left_semi")
    unlike = unlike.dropDuplicates(["doc_id"]).cache()
    sizes = {r["y"]: r["n"] for r in unlike.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    odds = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("b") + 0.5) / (clean + 1.0))
    counted = unlike.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    best = counted.filter(F.col("a") >= max(LEAST_DOCS, LEAST_SHARE * toxic)).withColumn("w", odds).filter((F.col("w") >= LEAST_ODDS) & (F.length("word") >= 3))
    out = {r["word"]: r["w"] for r in best.collect()}
    unlike.unpersist()
    return out


def _with_y(sample: DataFrame, found: DataFrame) -> DataFrame:
    return found.join(sample.select("doc_id", "y").distinct(), "doc_id")


def _word_end(text: str, at: int, step: int) -> int:
    """Where the word's letters and digits end, from `at` on in either direction."""
    while 0 <= at < len(text) and text[at].isalnum():
        at += step
    return at


def _phrases(sample: DataFrame, model: ToxicityModel) -> set[str]:
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def pairs(texts: list[bytes]) -> dict[str, object]:
        out = []
        for text in texts:
            text, near = folded(text.decode()), set()
            for a, b, _ in shared.value.matches(text):
                if a > 1 and text[a - 1] == " " and (before := _word_end(text, a - 2, -1)) < a - 2:
                    near.add(text[before + 1 : b])
                if text[b : b + 1] == " " and (after := _word_end(text, b + 1, 1)) > b + 1:
                    near.add(text[a:after])
            out.append(sorted(near))
        return {"pairs": pa.array(out, pa.list_(pa.string()))}

    counted = _with_y(sample, map_texts(sample, pairs, "pairs array<string>")).select("y", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("y").alias("a"), F.count("*").alias("n"))
    return {r["pair"] for r in counted.filter("a = 0 AND n >= 3").collect()}


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = FOLDS) -> ToxicityModel:
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", per_class, folds).cache()
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = labels.filter(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), folds) != 0)).agg(F.avg("toxic")).first()[0]
    model = ToxicityModel(prior=float(prior or 0.0))
    if len(n) == 2:
        words = _lexicon(sample)
        model = ToxicityModel(words, _phrases(sample, ToxicityModel(words)), None, model.prior)
        shared = sample.sparkSession.sparkContext.broadcast(model)
        load = map_texts(sample, lambda texts: {"x": pa.array(shared.value.load([t.decode() for t in texts]))}, "x double")
        rows = [(r["x"], r["y"]) for r in _with_y(sample, load).select("x", "y").collect()]  # 2 * per_class rows at most
        x, y = np.array(rows, float).T
        weight = np.where(y == 1, model.prior / max(1, n[1]), (1 - model.prior) / max(1, n[0]))
        fitted = fit_logistic(x[:, None], y, weight, 1e-5)
        model = ToxicityModel(model.words, model.phrases, fitted, model.prior)
    sample.unpersist()
    return model


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = PER_CLASS, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher is more toxic), predicted (1 if score >= threshold)."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(fit(docs, labels, per_class, folds))

    def run(texts: list[bytes]) -> dict[str, object]:
        s = shared.value.scores([t.decode() for t in texts])
        return {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype(np.int32))}

    return map_texts(docs, run, "score double, predicted int").select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = PER_CLASS, folds: int = FOLDS) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(fit(docs, labels, per_class, folds))
    return keep_texts(docs, lambda texts: (shared.value.scores([t.decode() for t in texts]) < threshold).tolist())
