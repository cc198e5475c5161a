"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

Each sentence has the chance sigmoid(bias + sum of its words' weights); a document's score is their
noisy-or, 1 - prod(1 - p). Only documents are labelled: the gradient of their cross-entropy goes
through the noisy-or into the sentences' words. Afterwards the same sentence chances tell where the
offending sentences are.

Words are runs of ASCII letters, digits and non-ASCII bytes with A-Z folded; sentences end at one of
``.!?`` and at line ends. A word's features are itself and its beginnings of 4, 5 and 6 bytes (so that
inflected words are caught), hashed into ``BUCKETS`` weights that are never negative: a word may make
a sentence toxic, not clean. A word like the one before it counts nothing. The weights are broadcast:
their number is fixed.

Training takes whole documents, as hashed words: ``rows_per_label`` of each label at most, those of least
hash, and no more of them than ``max_chars`` code points allow (one of each label at least). These
parameters bound what the driver gets and what is broadcast. A document with several labels is toxic if
any of them says so; several rows of one id are documents of their own with the same label.
Features in fewer than ``least_documents`` sampled documents get no weight, and after half of the
epochs those below ``least_weight`` lose theirs; from then on, sentences without a weighted word have
no chance to be toxic, so a text's length says nothing. A tenth of the sample is left out; on it, the documents' log odds get their slope and offset.

Null and empty texts, and all texts when there are no labels, get a low defined score: that of a
document without sentences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrow
from .words import ALNUM_FOLDED

BUCKETS = 1 << 20
SHIFT = np.uint64(44)
BEGINNINGS = (4, 5, 6)
WIDTH = 1 + len(BEGINNINGS)
SILENT = -40.0
SURE = 4.0
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n\r")] = True


def bags(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words' buckets; where sentences begin among the words; where rows begin among sentences; each sentence's first byte.

    A sentence without a word is none.
    """
    starts, ends, rows = ALNUM_FOLDED.spans(data, at)
    if not len(starts):
        return np.zeros((0, WIDTH), np.int32), np.zeros(0, np.int64), np.zeros(len(at), np.int64), np.zeros(0, np.int64)
    whole = ALNUM_FOLDED.values(data, starts)
    words = np.zeros((len(starts), WIDTH), np.int32)
    words[:, 0] = whole >> SHIFT
    for k, n in enumerate(BEGINNINGS, 1):
        words[:, k] = ALNUM_FOLDED.beginnings(data, starts, n) >> SHIFT
        words[ends - starts < n, k] = 0
    number = np.cumsum(_ENDS[data])[starts]  # sentence ends before the word
    first = np.ones(len(starts), bool)
    first[1:] = number[1:] != number[:-1]
    first[rows[:-1][rows[:-1] < len(starts)]] = True
    again = np.zeros(len(starts), bool)
    again[1:] = whole[1:] == whole[:-1]
    words[again & ~first] = 0
    begins = np.flatnonzero(first)
    return words, begins, np.searchsorted(begins, rows), starts[begins]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def sentences(self, words: np.ndarray, begins: np.ndarray, strict: bool = True) -> np.ndarray:
        """Each sentence's log odds; with ``strict``, next to none for sentences without a word of any weight."""
        if not len(begins):
            return np.zeros(0)
        total = np.add.reduceat(self.weights[words].sum(axis=1, dtype=np.float64), begins)
        return np.where(total > 0, total + self.bias, SILENT) if strict else total + self.bias

    def clean(self, z: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The log of each document's chance that no sentence is toxic."""
        logs = np.concatenate([[0.0], np.cumsum(-np.logaddexp(0, z))])
        return np.minimum(logs[docs[1:]] - logs[docs[:-1]], -1e-12)

    def odds(self, clean: np.ndarray) -> np.ndarray:
        """Documents' log odds, at most ``SURE`` to either side: a few texts that are far off would else set the slope."""
        return np.clip(np.log(-np.expm1(clean)) - clean, -SURE, SURE)

    def scores(self, clean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.odds(clean) + self.offset)))


def train(
    docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int], least_documents: int = 6, least_weight: float = 0.8, epochs: int = 16, batch: int = 32, rate: float = 0.3, seed: int = 5
) -> Model | None:
    """``docs``: each document's words and where its sentences begin. None without both labels."""
    y = np.array(labels, float)
    if not len(docs) or y.min() == y.max():
        return None
    rng = np.random.Generator(np.random.PCG64(seed))
    seen = np.zeros(BUCKETS, np.int32)
    for words, _ in docs:
        seen[np.unique(words)] += 1
    useful = seen >= least_documents
    useful[0] = False
    order = rng.permutation(len(docs))
    held, used = order[: len(docs) // 10], order[len(docs) // 10 :]
    model = Model(np.zeros(BUCKETS, np.float32), -6.0)
    squares = np.zeros(BUCKETS, np.float32)
    bias_square = 0.0
    for epoch in range(epochs):
        if epoch == epochs // 2:
            useful &= model.weights >= least_weight
            model.weights[~useful] = 0
        for some in np.array_split(rng.permutation(used), max(1, len(used) // batch)):
            some = some[[len(docs[i][1]) > 0 for i in some]]
            if not len(some):
                continue
            words = np.concatenate([docs[i][0] for i in some])
            lengths = np.array([len(docs[i][0]) for i in some])
            shift = np.cumsum(lengths) - lengths
            begins = np.concatenate([docs[i][1] + s for i, s in zip(some, shift, strict=True)])
            per = np.array([len(docs[i][1]) for i in some])
            edges = np.concatenate([[0], np.cumsum(per)])
            z = model.sentences(words, begins, strict=epoch >= epochs // 2)
            p = 1 / (1 + np.exp(-z))
            none = np.exp(model.clean(z, edges))
            pull = np.where(y[some] > 0, -none / np.maximum(1 - none, 1e-9), 1.0)
            grad = p * np.repeat(pull, per) / len(some)
            by_word = np.repeat(np.repeat(grad, np.diff(np.concatenate([begins, [len(words)]]))), WIDTH)
            flat = words.reshape(-1)
            keep = useful[flat]
            step = np.bincount(flat[keep], by_word[keep], minlength=1)
            touched = np.flatnonzero(step)
            step = step[touched].astype(np.float32)
            squares[touched] += step * step
            model.weights[touched] = np.maximum(model.weights[touched] - np.float32(rate) * step / (np.sqrt(squares[touched]) + np.float32(1e-6)), 0)
            g = float(grad.sum())
            bias_square += g * g
            model.bias -= 0.1 * g / (bias_square**0.5 + 1e-6)
    model.weights[~useful] = 0
    if len(held) and 0 < y[held].sum() < len(held):
        clean = np.array([model.clean(model.sentences(*docs[i]), np.array([0, len(docs[i][1])]))[0] for i in held])
        odds = model.odds(clean)
        a, b = 1.0, 0.0
        for _ in range(400):  # the slope and offset of least cross-entropy, drawn towards 1 and 0
            q = 1 / (1 + np.exp(-(a * odds + b)))
            error = q - y[held]
            a -= 0.02 * float((error * odds).mean() + 1e-2 * (a - 1))
            b -= 0.2 * float(error.mean() + 1e-3 * b)
        model.slope, model.offset = max(a, 0.05), b
    return model


def sample(
    docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", text: str = "text", key: str = "doc_id", rows_per_label: int = 3000, max_chars: int = 24_000_000
) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
    """The sampled labelled documents, as words and sentence begins, and their labels (0 or 1).

    ``allowed``: a condition on ``key`` for rows that may be learned from. Rows of ``labels`` are picked
    by a hash of their key; at most ``rows_per_label`` keys a label are then broadcast to the documents.
    Of a label's documents by their hash, those that begin within half of ``max_chars`` are taken, whole.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & allowed).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    keys = [known.filter(F.col("y") == y).orderBy(F.xxhash64(F.col("k").cast("string")), "k").limit(rows_per_label) for y in (0, 1)]
    some = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    some = some.join(F.broadcast(keys[0].unionByName(keys[1])), "k").select("y", "t", F.xxhash64("t", "k").alias("h"))
    few = some.filter("y = 0").orderBy("h", "t").limit(rows_per_label).unionByName(some.filter("y = 1").orderBy("h", "t").limit(rows_per_label))
    before = Window.partitionBy("y").orderBy("h", "t").rowsBetween(Window.unboundedPreceding, -1)  # over a sample's rows
    few = few.withColumn("n", F.coalesce(F.sum(F.length("t")).over(before), F.lit(0))).filter(F.col("n") < max_chars // 2).orderBy("h", "t")

    def make():
        def work(part: pa.RecordBatch) -> list:
            words, begins, docs, _ = bags(*arrow.text_bytes(part.column(part.schema.get_field_index("t"))))
            at = np.concatenate([begins, [len(words)]])[docs]
            told = [np.concatenate([[b - a], begins[a:b] - begins[a] if b > a else []]).astype(np.int32) for a, b in zip(docs[:-1], docs[1:], strict=True)]
            return [pa.array([np.concatenate([s, words[x:y].reshape(-1)]).astype("<i4").tobytes() for s, x, y in zip(told, at[:-1], at[1:], strict=True)], pa.binary())]

        return work

    out = arrow.with_columns(few, "t", [T.StructField("bag", T.BinaryType())], make).select("y", "bag").collect()
    bag = [np.frombuffer(bytes(r["bag"]), "<i4") for r in out]
    return [(flat[1 + flat[0] :].reshape(-1, WIDTH), flat[1 : 1 + flat[0]].astype(np.int64)) for flat in bag], [r["y"] for r in out]


def score(df: DataFrame, model: Model | None, text: str = "text", out: str = "score", spans: str = "offending", cut: float = 0.5) -> DataFrame:
    """``df`` with each whole text's score, and its sentences of chance ``cut`` or more.

    ``offending``: array of (start, end, chance), in code points from the sentence's first word to the
    next sentence's first word or the end of the text.
    """
    told = df.sparkSession.sparkContext.broadcast(model if model is not None else Model(np.zeros(1, np.float32), -30.0))

    def make():
        known: Model = told.value
        small = len(known.weights) == 1

        def work(part: pa.RecordBatch) -> list:
            data, at = arrow.text_bytes(part.column(part.schema.get_field_index(text)))
            words, begins, docs, first = bags(data, at)
            z = known.sentences(words * 0 if small else words, begins)
            scores = known.scores(known.clean(z, docs))
            bad = np.flatnonzero(z >= np.log(cut / (1 - cut)))
            found: list[list[dict]] = [[] for _ in range(part.num_rows)]
            if len(bad):
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                row = np.searchsorted(docs, bad, side="right") - 1
                for s, r in zip(bad, row, strict=True):
                    stop = first[s + 1] if s + 1 < docs[r + 1] else at[r + 1]
                    base = points[at[r]]
                    found[r].append({"start": int(points[first[s]] - base), "end": int(points[stop] - base), "chance": float(1 / (1 + np.exp(-z[s])))})
            return [pa.array(scores), pa.array(found, kind)]

        return work

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())]))
    struct = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("chance", T.DoubleType())])
    return arrow.with_columns(df, text, [T.StructField(out, T.DoubleType()), T.StructField(spans, T.ArrayType(struct))], make)
