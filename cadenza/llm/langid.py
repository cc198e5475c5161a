"""Language ID: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's features are its runs of two to four bytes (A-Z folded, every other ASCII byte that is no
letter taken as one blank, no run across rows), each hashed into ``BUCKETS`` places. A text's vector
is the mean of its features' embeddings; a linear softmax over it gives the languages. Scoring reads
whole texts. Embeddings and softmax are multiplied into one table before it, which is broadcast: it
has ``BUCKETS`` rows and a column a language, whatever the corpus. With more languages than an embedding
has numbers the two stay apart, so that the table doesn't grow with the languages.

Training takes whole texts: about ``rows_per_language`` labelled rows of each language, those of least
hash, and no more of them than ``max_chars`` code points allow (one at least); these parameters bound what
the driver gets. With many languages each has fewer rows and code points. No language is left out: more
than ``max_languages`` labels are an error.
A tenth of the sample is left out of training; it sets the softmax's temperature. A text is rejected if
either of two measures is below what all but 1 in ``RARE`` of the left-out texts have:

- its calibrated chance, of the right answers on left-out texts and on texts joined of two of them in
  different languages, so that texts in two languages are kept. A softmax can't tell unlearned languages.
- its familiarity: the mean over its runs of three bytes of the log of the run's share in the learned
  language that has it most. Every sampled text is left out once (five folds), and is measured cut to
  ``LENGTHS`` bytes, since short texts vary more. Texts of fewer than three bytes have none.

Null texts and texts without a letter get the language ``und`` and the score 0, and are rejected.
With no labelled row to learn from, every text is ``und`` with score 0, and only those are rejected: without
a model nothing tells that a text is unlike what is wanted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrow

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
RARE = 500
LENGTHS = (4, 8, 16, 32, 64, 128, 256, 512, 1024)
FLOOR = 1e-6  # the share taken for a run that was never seen
UNKNOWN = "und"
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_LETTER = regex.compile(r"\p{L}")


def features(data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of the run that begins at each byte, and whether it is a feature."""
    folded = _FOLD[data].astype(np.uint32)
    n = len(folded)
    end = np.repeat(at[1:], np.diff(at))
    key, out = folded.copy(), []
    blank = folded == 0x20
    for order in range(2, max(ORDERS) + 1):
        m = max(n - order + 1, 0)
        key = (key[:m] << np.uint32(8)) | folded[n - m :]
        if order in ORDERS:
            bucket = (key * np.uint32(2654435761) + np.uint32(order * 0x3C6EF372)) * np.uint32(2246822519) >> np.uint32(32 - 16)
            inside = np.arange(order, m + order) <= end[:m]
            if order == 2:
                inside &= ~(blank[:m] & blank[1 : m + 1])
            out.append((bucket, inside))
    return out


def triples(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket (of ``4 * BUCKETS``) of each run of three bytes without two blanks in a row, and where each text's begin in them."""
    folded = _FOLD[data].astype(np.uint32)
    m = max(len(folded) - 2, 0)
    a, b, c = folded[:m], folded[1 : m + 1], folded[2 : m + 2]
    end = np.repeat(at[1:], np.diff(at))[:m]
    fine = (np.arange(3, m + 3) <= end) & ~((b == 0x20) & ((a == 0x20) | (c == 0x20)))
    place = np.flatnonzero(fine)
    key = (a[place] << np.uint32(16)) | (b[place] << np.uint32(8)) | c[place]
    return (key * np.uint32(2654435761)) >> np.uint32(32 - 18), np.searchsorted(place, at)


def means(values: np.ndarray, bucket: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """For each text: the mean of its runs' values; 0 without any."""
    total = np.concatenate([[0.0], np.cumsum(values[bucket], dtype=np.float64)])
    return (total[edge[1:]] - total[edge[:-1]]) / np.maximum(np.diff(edge), 1)


def least_of(sorted_values: np.ndarray) -> float:
    """What all but 1 in ``RARE`` reach. Of too few values to tell, four deviations below their mean, if that is less."""
    least = float(sorted_values[len(sorted_values) // RARE])
    return least if len(sorted_values) >= RARE else min(least, float(sorted_values.mean() - 4 * sorted_values.std()))


def familiarity(raw: list[bytes], y: np.ndarray, order: np.ndarray, folds: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log share of each run, numbers of runs, the least familiarity at each of them) of labelled texts."""
    fold = np.empty(len(raw), np.int64)
    fold[order] = np.arange(len(raw)) % folds
    shares = np.full((folds + 1, 4 * BUCKETS), FLOOR, np.float32)  # the last one without a fold left out
    for language in range(int(y.max()) + 1):
        mine = np.flatnonzero(y == language)
        bucket, edge = triples(*_joined([raw[i] for i in mine]))
        of = np.repeat(fold[mine], np.diff(edge))
        whole = np.bincount(bucket, minlength=4 * BUCKETS)
        for k in range(folds + 1):
            counts = whole - np.bincount(bucket[of == k], minlength=4 * BUCKETS)
            np.maximum(shares[k], counts / max(counts.sum(), 1), out=shares[k], casting="same_kind")
    shares = np.log2(shares)
    sizes, least = [], []
    for length in LENGTHS:
        some, count = [], []
        for k in range(folds):
            cut = [raw[i][:length] for i in np.flatnonzero(fold == k) if len(raw[i]) >= length]
            bucket, edge = triples(*_joined(cut))
            has = np.diff(edge) > 0
            some.append(means(shares[k], bucket, edge)[has])
            count.append(np.diff(edge)[has])
        some, count = np.sort(np.concatenate(some)), np.concatenate(count)
        if len(some) >= 20:
            sizes.append(float(count.mean()))
            least.append(least_of(some))
    return shares[folds], np.array(sizes), np.array(least)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages, or BUCKETS x numbers of an embedding
    bias: np.ndarray
    temperature: float
    least: float
    out: np.ndarray | None = None  # from embeddings to languages, if the table is of embeddings
    shares: np.ndarray | None = None  # of runs of three bytes, logs
    sizes: np.ndarray | None = None
    least_familiar: np.ndarray | None = None  # at texts of so many runs

    def unfamiliar(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each text: whether it is like no learned language."""
        if self.shares is None or not len(self.sizes):
            return np.zeros(len(at) - 1, bool)
        bucket, edge = triples(data, at)
        n = np.diff(edge)
        return (n > 0) & (means(self.shares, bucket, edge) < np.interp(np.log2(np.maximum(n, 1)), np.log2(self.sizes), self.least_familiar))

    def logits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A row for each text; texts without a feature have the bias alone."""
        total = np.zeros((len(at) - 1, self.table.shape[1]))
        count = np.zeros(len(at) - 1)
        for bucket, inside in features(data, at):
            place = np.flatnonzero(inside)
            edge = np.searchsorted(place, at)
            rows = np.flatnonzero(np.diff(edge))
            if len(rows):
                got = self.table[bucket[place]]
                total[rows] += np.add.reduceat(got, edge[rows], axis=0)
                count += np.diff(edge)
        mean = total / np.maximum(count, 1)[:, None]
        return (mean if self.out is None else mean @ self.out) + self.bias

    def chances(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        z = self.logits(data, at) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([*map(len, texts)], dtype=np.int64)])


def train(texts: list[str], labels: list[str], dim: int = 16, epochs: int = 6, rate: float = 4.0, batch: int = 16, seed: int = 7) -> Model | None:
    """A model of the labelled texts; None without any."""
    if not texts:
        return None
    rng = np.random.Generator(np.random.PCG64(seed))
    languages = sorted(set(labels))
    y = np.searchsorted(languages, labels)
    raw = [t.encode("utf-8", "replace") for t in texts]
    order = rng.permutation(len(raw))
    held = order[: len(raw) // 10]
    used = order[len(raw) // 10 :]
    ids: list[np.ndarray] = []
    for i in used:
        ids.append(np.concatenate([b[k] for b, k in features(*_joined([raw[i]]))]).astype(np.int32))
    embedding = (rng.random((BUCKETS, dim), np.float32) - 0.5) / dim
    out = np.zeros((dim, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps = epochs * ((len(used) + batch - 1) // batch)
    step = 0
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(len(used)), max(1, (len(used) + batch - 1) // batch)):
            some = some[[len(ids[i]) > 0 for i in some]]
            lr, step = rate * (1 - step / steps), step + 1
            if not len(some):
                continue
            sizes = np.array([len(ids[i]) for i in some])
            flat = np.concatenate([ids[i] for i in some])
            begins = np.cumsum(sizes) - sizes
            mean = np.add.reduceat(embedding[flat], begins, axis=0) / sizes[:, None]
            z = mean @ out + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(some)), y[used[some]]] -= 1
            back = (z @ out.T) / sizes[:, None]
            out -= lr / len(some) * (mean.T @ z)
            bias -= lr * 0.1 / len(some) * z.sum(axis=0)
            # the rows of the embedding that these texts touch, each once
            touched, where = np.unique(flat, return_inverse=True)
            by = np.repeat(np.arange(len(some)), sizes)
            counts = np.bincount(where * len(some) + by, minlength=len(touched) * len(some)).reshape(len(touched), len(some))
            embedding[touched] -= (lr * (counts @ back)).astype(np.float32)
    many = len(languages) > dim
    model = Model(languages, embedding if many else (embedding @ out).astype(np.float32), bias.astype(np.float64), 1.0, 0.0, out.astype(np.float64) if many else None)
    if len(held):
        data, at = _joined([raw[i] for i in held])
        z, truth = model.logits(data, at), y[held]

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).mean())

        model.temperature = min(np.geomspace(0.05, 20, 61), key=loss)
        best = model.chances(data, at)
        right = best.argmax(axis=1) == truth
        sure = np.sort(best.max(axis=1)[right])
        both = [(i, j) for i, j in zip(rng.choice(held, 2 * RARE), rng.choice(held, 2 * RARE), strict=True) if y[i] != y[j]]
        if both:
            mixed = []
            for i, j in both:
                n = min(len(raw[i]), len(raw[j]))
                mixed.append(raw[i][:n] + b" " + raw[j][:n])
            chances = model.chances(*_joined(mixed))
            told = chances.argmax(axis=1)
            sure = np.sort(np.concatenate([sure, chances.max(axis=1)[(told == y[[i for i, _ in both]]) | (told == y[[j for _, j in both]])]]))
        model.least = least_of(sure) if len(sure) else 0.0
    model.shares, model.sizes, model.least_familiar = familiarity(raw, y, order)
    return model


def sample(
    df: DataFrame, allowed: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", rows_per_language: int = 600, max_chars: int = 8_000_000, max_languages: int = 1000, max_rows: int = 20_000
) -> list[tuple[str, str]]:
    """(text, language) of the sampled rows.

    A count by language gives the share of rows to take; the rows are those whose hash of ``key`` falls
    within it, so that the sample doesn't hang on their order. All languages together get about
    ``max_rows`` and ``max_chars``, each the same share: of a language's rows by their hash, those that
    begin within its share of code points are taken, whole. More than ``max_languages`` labels raise a ValueError.
    """
    rows = df.filter(allowed & F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h"))
    counts = rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(max_languages + 1).collect()
    if not counts:
        return []
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} language labels: none is left out, so merge labels or raise max_languages")
    rows_per_language = max(1, min(rows_per_language, max_rows // len(counts)))
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["l"], min(1.0, rows_per_language / r["count"]))])
    few = rows.filter(F.shiftrightunsigned("h", 11) / float(1 << 53) < F.try_element_at(shares, F.col("l")))
    before = Window.partitionBy("l").orderBy("h", "t").rowsBetween(Window.unboundedPreceding, -1)  # over a sample's rows
    few = few.withColumn("n", F.coalesce(F.sum(F.length("t")).over(before), F.lit(0))).filter(F.col("n") < max_chars // len(counts))
    return [(r["t"], r["l"]) for r in few.orderBy("h", "l", "t").limit(2 * rows_per_language * len(counts)).select("t", "l").collect()]


def fit(df: DataFrame, allowed: Column, **bounds) -> Model | None:
    """A model of the sampled rows of ``df``; ``bounds`` are the parameters of :func:`sample`."""
    rows = sample(df, allowed, **bounds)
    return train([t for t, _ in rows], [l for _, l in rows])


def identify(df: DataFrame, model: Model | None, text: str = "text", lang: str = "lang_pred", score: str = "score", rejected: str = "rejected") -> DataFrame:
    """``df`` with each whole text's language, its calibrated chance, and whether it is rejected."""
    told = df.sparkSession.sparkContext.broadcast(model)

    def make():
        known: Model | None = told.value

        def work(part: pa.RecordBatch) -> list:
            column = part.column(part.schema.get_field_index(text))
            data, at = arrow.text_bytes(column)
            plain = np.concatenate([[0], np.cumsum((_FOLD[data] != 0x20) & (data < 0x80))])
            lettered = np.diff(plain[at]) > 0
            for i in np.flatnonzero(~lettered & (np.diff(at) > 0)):
                lettered[i] = _LETTER.search(arrow.row_text(data, at, i)) is not None
            if known is None:
                names, best, low = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows), ~lettered
            else:
                chances = known.chances(data, at)
                names = np.where(lettered, np.array(known.languages, object)[chances.argmax(axis=1)], UNKNOWN)
                best = np.where(lettered, chances.max(axis=1), 0.0)
                low = ~lettered | (best < known.least) | known.unfamiliar(data, at)
            return [pa.array(names, pa.string()), pa.array(best), pa.array(low)]

        return work

    fields = [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(rejected, T.BooleanType())]
    return arrow.with_columns(df, text, fields, make, budget=1 << 18)
