"""Quality scores: random-indexing word vectors, pooled, and a two-layer network.

Word vectors come from random indexing: every vocabulary row has a fixed sparse vector
of a few +1 and -1, drawn from a hash; a word's vector is the normalised sum of those
of its neighbours, with its own fixed vector added. Frequent words have rows of their
own, all others share rows by shape (letter case, digits, marks), so a word never seen
still has a vector. A document is the mean and the spread of its words' vectors, its
length, the share of its words that differ, and the share of words that repeat the
word before. Words are what white space separates; longer ones than ``PIECE_CHARS`` are
cut into pieces that count as words each, so every character of a text without spaces
counts. A network with one hidden layer, trained in numpy, gives a logit; its
temperature is fitted on rows that the training did not see.

The fit uses at most ``Settings.sample_rows`` labelled rows, the first by a hash of
their id; a third of them is kept for the temperature. Everything else covers all
rows: each whole text is scored, in one pass without a shuffle.

Defined results: a null text counts as empty and is scored as a text of no words; ids
with contradicting or null labels are not learned from; where the usable labels are of
one class every text gets that class as score, and without any ``UNKNOWN``, so that no
text is rejected unseen; repeated rows give repeated results; an empty table gives an empty result. Only the id and the text
column are read by scoring; ``keep_good`` keeps all columns as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivane.llm.common import hold_cache, staged
from lexivane.llm.shingles import mixed

SCORES = "doc_id long, score double"
# Most words a worker keeps the rows of.
KEPT_WORDS = 300_000
# Characters of the pieces that longer words are cut into.
PIECE_CHARS = 64
# Words whose vectors are added up at once.
WORDS_AT_ONCE = 1 << 17


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled rows of a fit, whatever the corpus."""

    sample_rows: int = 12_000
    vocabulary: int = 8192
    shapes: int = 1024
    width: int = 64
    marks: int = 8
    window: int = 2
    hidden: int = 32
    rounds: int = 120
    threshold: float = 0.7
    seed: int = 7


# The score where no labelled row says anything: no text is rejected unseen.
UNKNOWN = 1.0


def pieces(text: str | None) -> list[str]:
    """The words of a text, long ones in pieces."""
    words = text.split() if text else []
    if words and len(max(words, key=len)) > PIECE_CHARS:
        return [word[at : at + PIECE_CHARS] for word in words for at in range(0, len(word), PIECE_CHARS)]
    return words


def word_shape(word: str) -> str:
    """Runs of small letters, capitals and digits as one sign each; marks stay, runs shortened."""
    signs = ("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "w" if c.isalpha() else c for c in word)
    return re.sub(r"(.)\1+", r"\1", "".join(signs))


class Lexicon:
    """Row numbers of words, with a hash that tells words of one row apart; keeps those it has met."""

    def __init__(self, frequent: list[str], shapes: int) -> None:
        hold_cache("words", lambda: None)
        self.own = {word: row for row, word in enumerate(frequent)}
        self.base, self.shapes = len(frequent), shapes
        self.size = self.base + shapes
        self.known: dict[str, bytes] = {}

    def row(self, word: str) -> int:
        own = self.own.get(word)
        if own is not None:
            return own
        return self.base + xxhash.xxh3_64_intdigest(word_shape(word)) % self.shapes

    def words(self, text: str | None) -> np.ndarray:
        """One number a word: its row in the low 32 bits, its hash above."""
        words, known = pieces(text), self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        for word in words:
            if word not in known:
                known[word] = self.row(word).to_bytes(4, "little") + xxhash.xxh32_digest(word)
        return np.frombuffer(b"".join(map(known.__getitem__, words)), "<u8")


def rows_of(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(0xFFFFFFFF)).astype(np.int64)


def index_vectors(rows: int, settings: Settings) -> np.ndarray:
    """Fixed sparse vectors of +1 and -1, one a row."""
    out = np.zeros((rows, settings.width), np.float32)
    number = np.arange(rows, dtype=np.uint64)
    for mark in range(settings.marks):
        drawn = mixed(number * np.uint64(settings.marks) + np.uint64(mark + 1 + (settings.seed << 40)))
        place = (drawn % np.uint64(settings.width)).astype(np.int64)
        sign = np.where((drawn >> np.uint64(40)) & np.uint64(1), 1.0, -1.0).astype(np.float32)
        np.add.at(out, (np.arange(rows), place), sign)
    return out


def add_neighbours(sums: np.ndarray, rows: np.ndarray, index: np.ndarray, window: int) -> None:
    """Adds to each word's row the fixed vectors of the words around it."""
    for start in range(0, len(rows), WORDS_AT_ONCE):
        low, high = max(0, start - window), min(len(rows), start + WORDS_AT_ONCE + window)
        near = index[rows[low:high]]
        total = np.zeros_like(near)
        for step in range(1, window + 1):
            total[step:] += near[:-step]
            total[:-step] += near[step:]
        own = slice(start - low, min(start + WORDS_AT_ONCE, len(rows)) - low)
        here, total = rows[low:high][own], total[own]
        order = np.argsort(here, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(here[order]) != 0])
        sums[here[order][edges]] += np.add.reduceat(total[order], edges, axis=0)


def word_vectors(sums: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Neighbour sums of unit length plus the row's own fixed vector of unit length."""

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    return (unit(sums) + unit(index)).astype(np.float32)


def pooled(words: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of a document's words, its length and repetition."""
    width, number, rows = vectors.shape[1], len(words), rows_of(words)
    out = np.zeros(2 * width + 3, np.float64)
    if number:
        for start in range(0, number, WORDS_AT_ONCE):
            part = vectors[rows[start : start + WORDS_AT_ONCE]]
            out[:width] += part.sum(axis=0, dtype=np.float64)
            out[width:-3] += np.square(part).sum(axis=0, dtype=np.float64)
        out[:-3] /= number
        out[width:-3] = np.sqrt(np.maximum(out[width:-3] - out[:width] ** 2, 0))
        out[-3] = len(np.unique(words)) / number
        out[-2] = (words[1:] == words[:-1]).sum() / number
    out[-1] = np.log1p(number)
    return out.astype(np.float32)


@dataclass(frozen=True)
class Network:
    """Two layers over standardised features; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.scale
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -30, 30)))


def train(features: np.ndarray, labels: np.ndarray, settings: Settings) -> Network:
    """Adam over small batches, with weight decay; repeatable."""
    rng = np.random.default_rng(settings.seed)
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-3
    x = ((features - mean) / scale).astype(np.float64)
    weights = [
        rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], settings.hidden)),
        np.zeros(settings.hidden),
        rng.normal(0, 1 / np.sqrt(settings.hidden), settings.hidden),
        np.zeros(1),
    ]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    size = max(32, len(x) // 16)
    for _ in range(settings.rounds):
        order = rng.permutation(len(x))
        for at in range(0, len(x), size):
            own = order[at : at + size]
            hidden = np.tanh(x[own] @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -30, 30))) - labels[own]) / len(own)
            back = np.outer(error, weights[2]) * (1 - hidden**2)
            slopes = [x[own].T @ back, back.sum(axis=0), hidden.T @ error, np.array([error.sum()])]
            step += 1
            for i, slope in enumerate(slopes):
                slope = slope + (1e-3 * weights[i] if i in (0, 2) else 0)
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope**2
                up, down = first[i] / (1 - 0.9**step), second[i] / (1 - 0.999**step)
                weights[i] -= 3e-3 * up / (np.sqrt(down) + 1e-8)
    return Network(mean, scale, weights[0], weights[1], weights[2], float(weights[3][0]))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, between 0.2 and 20."""
    tried = np.exp(np.linspace(np.log(0.2), np.log(20), 200))
    signed = np.where(labels > 0.5, logits, -logits)
    return float(tried[int(np.argmin([np.logaddexp(0, -signed / t).mean() for t in tried]))])


@dataclass(frozen=True)
class Model:
    frequent: list[str]
    vectors: np.ndarray
    network: Network | None
    settings: Settings
    # The score of every text where nothing could be learned.
    constant: float | None = None


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """At most ``sample_rows`` texts with a label, and whether they serve the temperature."""
    usable = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id")))
    agreed = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    chosen = (
        agreed.filter("quality = most")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(settings.sample_rows)
        .select("doc_id", "quality", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 3).alias("calibrates"))
    )
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "quality", "calibrates")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns word vectors, network and temperature from the labelled sample.

    Without two classes to tell apart every text is scored with the share of label 1 among
    the labelled rows, and with ``UNKNOWN`` where there are none.
    """
    spark = docs.sparkSession
    sample = staged(labelled_sample(docs, labels, settings), "quality-sample").repartition(8)
    learned = sample.filter("not calibrates")
    cut = F.regexp_extract_all("text", F.lit(rf"\S{{1,{PIECE_CHARS}}}"), F.lit(0))
    split = learned.select(F.explode(cut).alias("word"))
    frequent = [
        r.word
        for r in split.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
        .orderBy(F.desc("n"), "word").limit(settings.vocabulary).collect()
    ]
    index = index_vectors(len(frequent) + settings.shapes, settings)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, sums = Lexicon(frequent, settings.shapes), np.zeros_like(index)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                add_neighbours(sums, rows_of(lexicon.words(text)), index, settings.window)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    parts = learned.select("text").mapInArrow(neighbours, "sums binary").collect()
    sums = sum(np.frombuffer(p.sums, np.float32).reshape(index.shape) for p in parts)
    vectors = word_vectors(sums, index)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(frequent, settings.shapes)
        for batch in batches:
            raw = [pooled(lexicon.words(t), vectors).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(raw, pa.binary()), *batch.columns[1:]], names=["features", "quality", "calibrates"]
            )

    rows = sample.withColumn("quality", F.col("quality").cast("int"))
    rows = rows.mapInArrow(featured, "features binary, quality int, calibrates boolean").collect()
    rows.sort(key=lambda r: (r.features, r.quality))
    if not rows:
        return Model(frequent, vectors, None, settings, UNKNOWN)
    features = np.stack([np.frombuffer(r.features, np.float32) for r in rows])
    targets = np.array([r.quality for r in rows], np.float64)
    later = np.array([r.calibrates for r in rows], bool)
    if len(set(targets[~later])) < 2:
        return Model(frequent, vectors, None, settings, float(targets.mean()))
    network = train(features[~later], targets[~later], settings)
    if later.any():
        fitted = fit_temperature(network.logits(features[later]), targets[later])
        network = Network(**{**network.__dict__, "temperature": fitted})
    return Model(frequent, vectors, network, settings)


def _scorer(spark, model: Model):
    shared = spark.sparkContext.broadcast(model)

    def scores(lexicon: Lexicon, texts: list[str | None]) -> np.ndarray:
        own = shared.value
        if not texts or own.network is None:
            return np.full(len(texts), own.constant)
        return own.network.probabilities(np.stack([pooled(lexicon.words(t), own.vectors) for t in texts]))

    def lexicon() -> Lexicon:
        return Lexicon(shared.value.frequent, shared.value.settings.shapes)

    return lexicon, scores


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score``: the probability of good quality of every whole text."""
    lexicon, scores = _scorer(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lexicon()
        for batch in batches:
            found = scores(words, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCORES)


def keep_good(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    lexicon, scores = _scorer(docs.sparkSession, model)
    at, least = docs.columns.index(text_column), model.settings.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lexicon()
        for batch in batches:
            yield batch.filter(pa.array(scores(words, batch.column(at).to_pylist()) >= least))

    return docs.mapInArrow(run, docs.schema)
