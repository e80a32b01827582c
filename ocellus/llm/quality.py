"""Quality classifier by compression: zstandard dictionaries built from good and bad labelled text.

A text is compressed with either dictionary, in blocks of BLOCK bytes so that the dictionary and not the text's own
beginning is what a block is coded by, however long the text. The difference of the two total sizes per byte of text
is the one quantity that is scored; a rising curve, fitted to labelled documents that the dictionaries have not seen,
makes it the chance of the good label.

Dictionaries and curve come from separate parts of a bounded sample of labelled training documents, PER_CLASS of
either class; a document gives its whole text to either. The blocks of a class are dealt by hash into shards of about
SHARD_BYTES, each shard trains a dictionary in a task, and the dictionaries of many shards are the text of the next
level, until one is left: every block counts, and no task or driver holds a class's text. Class weights restore the
labels' own proportions.

Texts are scored whole, of any length. Null counts as empty, whose difference is 0. Every row gives a row, also of
repeated or null ids; other columns are not read. If either class has too few labelled documents for a dictionary,
every score is the share of good labels (0.5 without labels). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fold, map_texts, ship, staged
from .training import fit_rising, labelled_sample

PER_CLASS, DICTIONARY_BYTES, LEVEL = 2000, 112_640, 3
BLOCK, SHARD_BYTES = 2048, 16 << 20
FOLDS, THRESHOLD, LEAST = 5, 0.3, 16


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    knots: np.ndarray | None
    chances: np.ndarray | None
    prior: float

    def sizes(self, texts: list[bytes]) -> np.ndarray:
        """Bytes, compressed bytes with the good and with the bad dictionary: shape (texts, 3)."""
        if not hasattr(self, "_tools"):
            self._tools = [zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(x), write_checksum=False, write_content_size=False) for x in (self.good, self.bad)]
        return np.array([(len(t), *(sum(len(tool.compress(t[i : i + BLOCK])) for i in range(0, len(t), BLOCK)) for tool in self._tools)) for t in texts], float).reshape(-1, 3)

    @staticmethod
    def difference(sizes: np.ndarray) -> np.ndarray:
        """By how many bytes per byte of text the bad dictionary does worse."""
        n, good, bad = sizes.T
        return (bad - good) / np.maximum(n, 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.knots is None:
            return np.full(len(texts), self.prior)
        return np.interp(self.difference(self.sizes(texts)), self.knots, self.chances)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_tools"}


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    out = zstandard.ZstdCompressionDict(raw)
    out.precompute_compress(level=LEVEL)
    return out


def _blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def _train(pdf: pd.DataFrame) -> pd.DataFrame:
    """One dictionary of a shard's blocks, in order of their digests, whatever order they came in; none of too little text."""
    some = sorted(map(bytes, pdf["block"]), key=lambda x: (hashlib.md5(x).digest(), x))
    try:
        raw = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, some)) // 4)), some).as_bytes()
    except zstandard.ZstdError:
        return pd.DataFrame({"y": [], "dictionary": []})
    return pd.DataFrame({"y": [pdf["y"].iloc[0]], "dictionary": [raw]})


def dictionaries(blocks: DataFrame, shard_bytes: int = SHARD_BYTES) -> dict[int, bytes]:
    """A dictionary of each class (y) of all blocks (y, place, block): one dictionary a shard, those of a class's shards cut
    to blocks again for the next level. Shards are dealt by place, a hash of where a block stands, so that copies of one
    block spread. Two dictionaries come to the driver."""
    if shard_bytes < 4 * DICTIONARY_BYTES:
        raise ValueError(f"shards of {shard_bytes} bytes don't hold a few dictionaries")
    held = []
    try:
        while True:
            sizes = {r["y"]: r["n"] for r in blocks.groupBy("y").agg(F.sum(F.octet_length("block")).alias("n")).collect()}
            shards = {y: -(-n // shard_bytes) for y, n in sizes.items()}
            many = F.coalesce(*(F.when(F.col("y") == y, F.lit(n)) for y, n in shards.items()), F.lit(1))
            trained = blocks.groupBy("y", F.pmod("place", many).alias("shard")).applyInPandas(_train, "y int, dictionary binary")
            if max(shards.values(), default=1) == 1:
                return {r["y"]: bytes(r["dictionary"]) for r in trained.collect()}
            held.append(staged(trained, "dictionaries"))
            starts = F.sequence(F.lit(0), F.floor((F.octet_length("dictionary") - 1) / BLOCK).cast("int"))
            cut = F.transform(starts, lambda i: F.substring("dictionary", i * BLOCK + 1, F.lit(BLOCK)))
            blocks = held[-1].select("y", F.xxhash64("dictionary").alias("name"), F.posexplode(cut).alias("at", "block")).select("y", F.xxhash64("name", "at").alias("place"), "block")
    finally:
        discard(*held)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = FOLDS) -> QualityModel:
    """Two dictionaries and two numbers of each sampled document come to the driver."""
    shares = labels.filter(F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), folds) != 0)).agg(F.avg("quality")).first()[0]
    prior = 0.5 if shares is None else float(shares)
    flat = QualityModel(b"", b"", None, None, prior)
    sample = labelled_sample(docs, labels, "quality", per_class, folds).withColumn("part", fold(F.col("doc_id"), 3 * folds) >= folds).cache()
    try:
        y_of = {r["doc_id"]: r["y"] for r in sample.select("doc_id", "y").collect()}
        blocks = map_texts(sample.filter("part"), lambda texts: {"blocks": pa.array(map(_blocks, texts), pa.list_(pa.binary()))}, "blocks array<binary>")
        blocks = blocks.join(F.broadcast(sample.select("doc_id", "y")), "doc_id").filter(F.size("blocks") > 0)
        seen = {r["y"]: r["count"] for r in blocks.groupBy("y").count().collect()}
        if min(seen.get(0, 0), seen.get(1, 0)) < LEAST:
            return flat
        placed = blocks.select("doc_id", "y", F.posexplode("blocks").alias("at", "block"))
        raw = dictionaries(placed.select("y", F.xxhash64("doc_id", "at").alias("place"), "block"))
        if raw.keys() != {0, 1}:
            return flat
        model = QualityModel(raw[1], raw[0], None, None, prior)
        shared = ship(docs.sparkSession).sparkContext.broadcast(model)
        rows = sorted(map(tuple, map_texts(sample.filter("NOT part"), lambda texts: {"d": pa.array(QualityModel.difference(shared.value.sizes(texts)))}, "d double").collect()))
        x, y = np.array([d for _, d in rows]), np.array([y_of[i] for i, _ in rows], float)
    finally:
        sample.unpersist()
    if not 0 < y.sum() < y.size:
        return flat
    weight = np.where(y == 1, prior / y.sum(), (1 - prior) / (y.size - y.sum()))
    model.knots, model.chances = fit_rising(x, y, weight, -2.0, 2.0)
    return model


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = PER_CLASS, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher is better), predicted (1 if score >= threshold)."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(fit(docs, labels, per_class, folds))

    def run(texts: list[bytes]) -> dict[str, object]:
        s = shared.value.scores(texts)
        return {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype(np.int32))}

    held = fold(F.col("doc_id"), folds) == 0
    return map_texts(docs, run, "score double, predicted int").select("doc_id", held.alias("held_out"), "score", "predicted")
