"""LM scoring by a log-bilinear model, trained in numpy with noise-contrastive estimation.

Words are counted over all training rows in Spark. The model predicts units: a head word is a unit of its own, any
other word belongs to the unit of its last three bytes, which tell much about the words it can follow. A unit's logit
is the product of its vector with the sum of the vectors of the two context classes before it, plus a bias. Context
classes are the spelling units and the most frequent head words; a head word that is no class of its own counts as
its spelling. So every word of the corpus has a probability that depends on its context, through its own vector or
through its spelling's. The numbers of head words, context classes and spelling units follow the square root of the
number of distinct words, up to limits that bound the broadcast model (HEAD, CLASSES, SPELLINGS).

Training rows are dealt to shards by a hash of id and text, SHARD tokens each, and put in order by that hash; every
shard trains a copy from the same start on all its tokens, with noise from the unit frequencies shared by a minibatch,
and the copies are averaged, weighted by tokens, in a tree of groups in Spark. The result depends on the rows alone,
not on how they are partitioned or in which order they are read.

For scoring, exp(logit) of two context classes is a product of two factors, so the normalisers of all pairs of context
classes are one matrix product, summed over the units block by block. Within a spelling unit a word has the
probability of its discounted count, and the discounts are what all unseen words of that spelling share: the model is
a distribution over the training words and one unseen type for each spelling.

Counts of the most frequent words, LOOKUP at most, are broadcast (a bounded table); the other words of a document are
joined with the counts by word, pre-aggregated per document. Texts of any length are scored whole. Null texts count as
empty: one end token. Every row gives a row, also of repeated or null ids. Other columns are not read. Without training
rows every word is unseen. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, chunks, fold, labels, ship, staged

#: Most head words, context classes among them, and spelling units; words whose counts are broadcast.
HEAD, CLASSES, SPELLINGS, LOOKUP = 16_384, 1024, 1024, 200_000
WIDTH, FOLDS, SHARD = 16, 10, 8_000_000
BATCH, NOISE, NOISE_PER_TOKEN, RATE = 1024, 64, 12, 1.0
#: Distinct words that a task counts before it hands them on, tokens shuffled and learned at once, models averaged at
#: once, and floats of a model in one row.
COUNTED, LEARNED, FAN_IN, PIECE = 400_000, 500_000, 32, 1 << 16
END = b""


def tokens(text: bytes) -> list[bytes]:
    return text.translate(ASCII_LOWER).split()


def spelling(word: bytes) -> int:
    """A hash of the last three bytes."""
    return zlib.crc32(word[-3:])


def count_words(train: DataFrame) -> DataFrame:
    """(word, c, spell) over all rows; the end token is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64()), pa.array(map(spelling, held), pa.int64())], names=["word", "c", "spell"])

        for _, texts in chunks(batches):
            for text in texts:
                held.update(tokens(text))
            held[END] += len(texts)
            if len(held) >= COUNTED:
                yield out()
                held.clear()
        if held:
            yield out()

    return train.select("doc_id", "text").mapInArrow(run, "word string, c long, spell long").groupBy("word").agg(F.sum("c").alias("c"), F.min("spell").alias("spell"))


@dataclass
class Vocabulary:
    """Units are the spellings 0, 1, ... and after them the head words by rank; context classes are the first of them."""

    index: dict[bytes, int]  # rank of the most frequent words
    counts: np.ndarray  # by rank
    units: np.ndarray  # by rank
    spellings: int
    head: int
    classes: int  # spellings and head words that are context classes
    context: np.ndarray  # context class by unit
    total: int  # N
    distinct: int  # V
    rest_total: np.ndarray  # by spelling: tokens and types of the words that are not head words
    rest_distinct: np.ndarray
    discount: float

    def frequency(self) -> np.ndarray:
        p = np.r_[np.maximum(self.rest_total, 0.5), self.counts[: self.head]].astype(float)
        return p / p.sum()

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))

    def unit(self, word: bytes) -> int:
        rank = self.index.get(word, -1)
        return int(self.units[rank]) if rank >= 0 else spelling(word) % self.spellings

    def shares(self) -> tuple[np.ndarray, np.ndarray]:
        """By spelling, in log10: what a discounted count of 1 is worth within the unit, and the unseen type."""
        seen = -np.log10(np.maximum(self.rest_total, 1))
        unseen = np.where(self.rest_distinct > 0, np.log10(self.discount * np.maximum(self.rest_distinct, 1)) + seen, 0.0)
        return seen, unseen


def most_frequent(counts: DataFrame, most: int) -> list:
    """Rows of the `most` most frequent words, ties by word. Whole levels of frequency, of sixteen to a doubling, are
    taken first and the rest from the next level; only the levels' sizes and these rows come to the driver."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 16)
    lowest, held, partial = None, 0, None
    for row in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        if held + row["n"] > most:
            partial = row["level"]
            break
        held += row["n"]
        lowest = row["level"]
    rows = [] if lowest is None else counts.filter(level >= lowest).collect()
    if partial is not None and most > held:
        rows += counts.filter(level == partial).orderBy(F.desc("c"), "word").limit(most - held).collect()
    return rows


def vocabulary(counts: DataFrame, head: int = HEAD, classes: int = CLASSES, spellings: int = SPELLINGS, lookup: int = LOOKUP) -> Vocabulary:
    total, distinct, once, twice = counts.agg(F.sum("c"), F.count("*"), F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long"))).first()
    side = int(np.sqrt(distinct)) + 1
    head, classes, spellings = min(head, 16 * side), min(classes, side), min(spellings, side)
    rows = most_frequent(counts, lookup)
    if not any(r["word"] == "" for r in rows):
        rows = [*counts.filter("word = ''").collect(), *rows]
    rows.sort(key=lambda r: (r["word"] != "", -r["c"], r["word"]))  # the end token is always a head word and a class
    index = {r["word"].encode(): i for i, r in enumerate(rows)}
    head = min(head, len(rows))
    classes = min(classes, head)
    count, spell = (np.array([r[k] for r in rows], np.int64) for k in ("c", "spell"))
    rest = np.zeros((2, spellings), np.int64)
    for r in counts.groupBy((F.col("spell") % spellings).alias("s")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        rest[:, r["s"]] = r["c"], r["n"]
    np.subtract.at(rest, (slice(None), spell[:head] % spellings), np.stack([count[:head], np.ones(head, np.int64)]))
    units = np.r_[spellings + np.arange(head), spell[head:] % spellings]
    context = np.r_[np.arange(spellings + classes), spell[classes:head] % spellings]
    once, twice = (int(x or 0) - int((count[:head] == k).sum()) for x, k in ((once, 1), (twice, 2)))
    discount = min(0.9, max(0.05, once / max(1, once + 2 * twice)))
    return Vocabulary(index, count, units, spellings, head, spellings + classes, context, int(total or 0), distinct, *rest, discount)


@dataclass
class LogBilinear:
    """Unit vectors with the unit's bias as last column, and vectors of the context classes before and, after them, of those
    before that."""

    out: np.ndarray
    context: np.ndarray

    @classmethod
    def start(cls, frequency: np.ndarray, classes: int, width: int) -> LogBilinear:
        rng = np.random.default_rng(7)
        out = rng.normal(0, 0.05, (frequency.size, width + 1))
        out[:, -1] = np.log(frequency)
        return cls(out.astype(np.float32), rng.normal(0, 0.05, (2 * classes, width)).astype(np.float32))

    @property
    def classes(self) -> int:
        return len(self.context) // 2

    def copy(self) -> LogBilinear:
        return LogBilinear(self.out.copy(), self.context.copy())

    def flat(self) -> np.ndarray:
        return np.r_[self.out.ravel(), self.context.ravel()]

    def filled(self, flat: np.ndarray) -> LogBilinear:
        """A model of this one's shape."""
        out, context = np.split(flat, [self.out.size])
        return LogBilinear(out.reshape(self.out.shape), context.reshape(self.context.shape))

    def logits(self, units: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Of each unit after its two context classes."""
        vector = self.out[units]
        return np.einsum("ij,ij->i", self.context[near] + self.context[far + self.classes], vector[:, :-1]) + vector[:, -1]

    def normalisers(self, block: int = 1024) -> np.ndarray:
        """Log of the summed exponentials for all pairs (near, far) of context classes."""
        near, far = np.split(self.context, 2)
        z = np.zeros((len(near), len(far)), np.float32)
        for at in range(0, len(self.out), block):
            some = self.out[at : at + block]
            z += np.exp(near @ some[:, :-1].T + some[:, -1]) @ np.exp(far @ some[:, :-1].T).T
        return np.log(z)


class Trainer:
    """Noise-contrastive estimation with Adagrad; the noise units are shared by a minibatch."""

    def __init__(self, model: LogBilinear, frequency: np.ndarray, seed: int = 11):
        self.model, self.rng = model, np.random.default_rng(seed)
        self.cumulative, self.noise_logit = np.cumsum(frequency), np.log(NOISE_PER_TOKEN * frequency).astype(np.float32)
        self.sums = [np.full(x.shape, 1e-2, np.float32) for x in (model.out, model.context)]
        self.seen = 0

    @staticmethod
    def _step(param: np.ndarray, sums: np.ndarray, at: np.ndarray, grad: np.ndarray) -> None:
        order = np.argsort(at.astype(np.uint16), kind="stable")  # a radix sort
        at = at[order]
        cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        at, grad = at[cuts], np.add.reduceat(grad[order], cuts, axis=0)
        squares = sums[at] + grad * grad
        sums[at] = squares
        param[at] -= np.float32(RATE) * grad / np.sqrt(squares)

    def learn(self, word: np.ndarray, near: np.ndarray, far: np.ndarray) -> None:
        m, classes = self.model, self.model.classes
        every = self.rng.permutation(word.size)
        word, near, far = word[every], near[every], far[every] + classes
        per_noise = np.float32(NOISE_PER_TOKEN / NOISE)
        for lo in range(0, word.size, BATCH):
            w, n, f = word[lo : lo + BATCH], near[lo : lo + BATCH], far[lo : lo + BATCH]
            noise = np.searchsorted(self.cumulative, self.rng.random(NOISE)).clip(max=self.cumulative.size - 1)
            context = np.ones((w.size, m.out.shape[1]), np.float32)  # the last column meets the bias
            np.add(m.context[n], m.context[f], out=context[:, :-1])
            mine, others = m.out[w], m.out[noise]
            # gradients of the logistic loss of data against noise, per token of the batch
            own = np.einsum("ij,ij->i", context, mine) - self.noise_logit[w]
            d_own = -1 / ((1 + np.exp(np.clip(own, -30, 30))) * np.float32(w.size))
            d_other = np.subtract(self.noise_logit[noise], context @ others.T)
            np.minimum(d_other, 60, out=d_other)
            np.exp(d_other, out=d_other)
            d_other += 1
            np.divide(per_noise / np.float32(w.size), d_other, out=d_other)
            d_context = (d_own[:, None] * mine + d_other @ others)[:, :-1]
            self._step(m.out, self.sums[0], np.r_[w, noise], np.r_[d_own[:, None] * context, d_other.T @ context])
            self._step(m.context, self.sums[1], np.r_[n, f], np.r_[d_context, d_context])
            self.seen += w.size


def encode(texts: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Ranks (-1: not in the lookup) and units of all tokens end to end, tokens per text, and the places and words of the
    tokens that are not in the lookup."""
    get = vocab.index.get
    words = [[*tokens(t), END] for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = list(chain.from_iterable(words))
    ranks = np.fromiter((get(w, -1) for w in flat), np.int64, len(flat))
    units = vocab.units[np.maximum(ranks, 0)] if vocab.units.size else np.zeros(ranks.size, np.int64)
    unknown = np.flatnonzero(ranks < 0)
    others = [flat[i] for i in unknown.tolist()]
    units[unknown] = [spelling(w) % vocab.spellings for w in others]
    return ranks, units, sizes, unknown, others


def contexts(units: np.ndarray, sizes: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Context class of the token before each token and of the one before that; texts begin after end tokens."""
    cls = vocab.context[units]
    first = np.zeros(cls.size, bool)
    first[np.cumsum(sizes) - sizes] = True
    end = vocab.context[vocab.unit(END)]
    near = np.where(first, end, np.r_[end, cls[:-1]])
    return near, np.where(first, end, np.r_[end, near[:-1]])


def train(rows: DataFrame, vocab: Vocabulary, width: int = WIDTH, shard: int | None = None) -> LogBilinear:
    frequency = vocab.frequency()
    start = LogBilinear.start(frequency, vocab.classes, width)
    shards = max(1, -(-vocab.total // (shard or SHARD)))
    spark = ship(rows.sparkSession)
    shared = spark.sparkContext.broadcast((vocab, start))
    label = F.element_at(F.array(*map(F.lit, labels(spark, shards))), F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int") + 1)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, texts in chunks(batches):
            _, units, sizes, *_ = encode(texts, shared.value[0])
            parts = [x.astype("<u2").tobytes() for x in np.split(units, np.cumsum(sizes)[:-1])]
            yield pa.RecordBatch.from_arrays([place, pa.array(parts, pa.binary())], names=["place", "units"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, start = shared.value
        now, trainer, held, size = None, None, [], 0

        def flush() -> None:
            if held:
                sizes = np.fromiter(map(len, held), np.int64, len(held))
                units = np.concatenate(held).astype(np.int64)
                trainer.learn(units, *contexts(units, sizes, vocab))

        def done() -> pa.RecordBatch:
            flush()
            flat = trainer.model.flat()
            parts = [flat[i : i + PIECE].tobytes() for i in range(0, flat.size, PIECE)]
            n = len(parts)
            return pa.RecordBatch.from_arrays([pa.array([now] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([float(trainer.seen)] * n), pa.array(parts, pa.binary())], names=["part", "piece", "n", "packed"])

        for batch in batches:
            for part, units in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now:
                    if now is not None:
                        yield done()
                    now, trainer, held, size = part, Trainer(start.copy(), vocab.frequency()), [], 0
                held.append(np.frombuffer(units, "<u2"))
                size += held[-1].size
                if size >= LEARNED:
                    flush()
                    held, size = [], 0
        if now is not None:
            yield done()

    def mean(table: pa.Table) -> pa.Table:
        n = np.array(table["n"].to_pylist())
        flat = sum(np.frombuffer(x.as_py(), np.float32) * (w / n.sum()) for x, w in sorted(zip(table["packed"], n, strict=True), key=lambda r: r[0].as_py()))
        return pa.table({"part": table["part"].slice(0, 1), "piece": table["piece"].slice(0, 1), "n": pa.array([float(n.sum())]), "packed": pa.array([np.asarray(flat, np.float32).tobytes()], pa.binary())})

    model = "part long, piece int, n double, packed binary"
    place = F.xxhash64(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))
    dealt = rows.select(place.alias("place"), "text").mapInArrow(coded, "place long, units binary").withColumn("part", label.cast("int"))
    models = staged(dealt.repartition(shards, "part").sortWithinPartitions("part", "place", "units").select("part", "units").mapInArrow(learn, model), "models")
    many = shards
    while many > 1:  # average groups of about FAN_IN copies until one is left
        many = -(-many // FAN_IN)
        models = staged(models.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(many))).groupBy("part", "piece").applyInArrow(mean, model), "models")
    left = sorted(models.select("piece", "packed").collect())
    return start.filled(np.concatenate([np.frombuffer(p, np.float32) for _, p in left])) if left else start


class Scorer:
    def __init__(self, vocab: Vocabulary, model: LogBilinear, norm: np.ndarray):
        self.vocab, self.model, self.norm = vocab, model, norm
        self.seen, self.unseen = vocab.shares()

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[Counter[bytes]]]:
        """Per text: tokens, known ones, base and model log10 sums over all tokens as far as the lookup tells, and the
        words that it doesn't hold."""
        v = self.vocab
        ranks, units, sizes, unknown, words = encode(texts, v)
        near, far = contexts(units, sizes, v)
        in_table = ranks >= 0
        c = np.where(in_table, v.counts[np.maximum(ranks, 0)] if v.counts.size else 0, 0)
        model = np.empty(units.size)
        for lo in range(0, units.size, 1 << 17):  # bounds the vectors held at once
            some = slice(lo, lo + (1 << 17))
            n, f = near[some], far[some]
            model[some] = (self.model.logits(units[some], n, f) - self.norm[n, f]) / np.log(10)
        rare = np.flatnonzero(in_table & (units < v.spellings))
        model[rare] += np.log10(np.maximum(c[rare], 1) - v.discount) + self.seen[units[rare]]
        stops = np.cumsum(sizes)
        sums = [np.add.reduceat(x, stops - sizes) for x in (in_table.astype(np.int64), np.where(in_table, v.base(c), 0.0), model)]
        cuts = [0, *np.searchsorted(unknown, stops).tolist()]
        return sizes, *sums, [Counter(words[a:b]) for a, b in zip(cuts, cuts[1:])]  # noqa: B905


def lm_scores(docs: DataFrame, head: int = HEAD, classes: int = CLASSES, spellings: int = SPELLINGS, lookup: int = LOOKUP, width: int = WIDTH, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    if head + spellings > 1 << 16:
        raise ValueError("units are numbered in 16 bits")
    spark = ship(docs.sparkSession)
    rows = docs.select("doc_id", "text").filter(fold(F.col("doc_id"), folds) != 0)
    counts = staged(count_words(rows), "word-counts")
    vocab = vocabulary(counts, head, classes, spellings, lookup)
    model = train(rows, vocab, width)
    scorer = Scorer(vocab, model, model.normalisers())
    shared = spark.sparkContext.broadcast(scorer)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value
        for ids, texts in chunks(batches):
            sizes, known, base, model, others = score(texts)
            offsets = np.cumsum([0, *map(len, others)])
            fields = {
                "word": pa.array((w for x in others for w in x), pa.binary()).cast(pa.string()), "n": pa.array((n for x in others for n in x.values()), pa.int32()),
                "unit": pa.array((spelling(w) % score.vocab.spellings for x in others for w in x), pa.int16()),
            }
            rest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))
            digests = pa.array(map(xxhash.xxh3_128_digest, texts), pa.binary())
            yield pa.RecordBatch.from_arrays([ids, digests, pa.array(sizes), pa.array(known), pa.array(base), pa.array(model), rest], names=["doc_id", "digest", "n_tokens", "known", "base", "model", "rest"])

    parts = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, digest binary, n_tokens long, known long, base double, model double, rest array<struct<word:string,n:int,unit:short>>")
    # rows of one id and text have the same sums, so they may meet: they are counted, and given back as many
    once = F.coalesce(F.col("at"), F.lit(0)) == 0
    open_ = parts.select("doc_id", "digest", "n_tokens", "known", "base", "model", F.posexplode_outer("rest").alias("at", "other")).select(
        "doc_id", "digest", *(F.when(once, F.col(x)).alias(x) for x in ("n_tokens", "known", "base", "model")), F.col("other.word").alias("word"), F.coalesce("other.n", F.lit(0)).alias("n"), F.col("other.unit").alias("unit")
    )
    joined = open_.join(counts.select("word", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    base = F.log10((F.col("c") + 0.1) / (vocab.total + 0.1 * (vocab.distinct + 1)))
    share = lambda values: F.element_at(F.array(*(F.lit(float(x)) for x in values)), F.col("unit") + 1)
    within = F.when(F.col("c") > 0, F.log10(F.col("c") - vocab.discount) + share(scorer.seen)).otherwise(share(scorer.unseen))
    n = F.col("n")
    sums = joined.groupBy("doc_id", "digest").agg(
        F.count("n_tokens").alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("known") + F.sum(F.when(F.col("c") > 0, n).otherwise(0))).alias("n_known"),
        (F.sum("base") + F.sum(F.when(n > 0, n * base).otherwise(0.0))).alias("base_score"),
        (F.sum("model") + F.sum(F.when(n > 0, n * within).otherwise(0.0))).alias("score"),
    )
    each = lambda x: F.col(x) / F.col("copies")
    return sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), each("n_tokens").cast("long").alias("n_tokens"), each("n_known").cast("long").alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"), each("base_score").alias("base_score"), each("score").alias("score")
    )
