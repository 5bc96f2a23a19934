"""Quality classifier by positive-unlabelled learning: the non-negative unbiased risk over trusted positives,
unlabelled text and an estimated class prior."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, bounded_batches, content_key, fresh, texts

N_FORM, N_GRAMS = 20, 256
N_FEATURES = N_FORM + N_GRAMS


def features(text: bytes) -> np.ndarray:
    """N_FORM numbers for a text's form and N_GRAMS for its hashed n-grams; an empty text gives zeros."""
    return np.concatenate([form(text), grams(text)]).astype(np.float32)


def grams(text: bytes, part: int = 1 << 20) -> np.ndarray:
    """Byte 4-grams, A-Z in lower case, hashed into N_GRAMS signed counters and scaled to length 1."""
    total = np.zeros(N_GRAMS)
    b = np.frombuffer(text.translate(LOWER), dtype=np.uint8)
    for a in range(0, len(b) - 3, part):
        c = b[a : a + part + 3].astype(np.uint32)
        h = (c[:-3] | c[1:-2] << np.uint32(8) | c[2:-1] << np.uint32(16) | c[3:] << np.uint32(24)) * np.uint32(2654435761)
        total += np.bincount(h >> np.uint32(24), weights=1.0 - 2.0 * (h >> np.uint32(23) & np.uint32(1)), minlength=N_GRAMS)
    return total / max(1e-9, float(np.sqrt((total**2).sum())))


def form(text: bytes) -> list[float]:
    """Numbers that describe a text's form, not its words; an empty text gives zeros."""
    n = len(text)
    if not n:
        return [0.0] * N_FORM
    c = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    upper, lower, digit, high = int(c[65:91].sum()), int(c[97:123].sum()), int(c[48:58].sum()), int(c[128:].sum())
    space = int(c[32] + c[9:14].sum())
    marks = int(c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum())
    plain = int(c[44] + c[46])  # commas and full stops
    words = text.split()
    n_words = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    again = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        math.log1p(n) / 10, math.log1p(n_words) / 10, math.log1p(n_lines) / 10, n / n_words / 10,
        upper / max(1, upper + lower), digit / n, high / n, space / n,
        (marks - plain) / n, plain / n_words, int(c[33]) / n_words, int(c[124]) / n_words,
        int(c[35] + c[36] + c[37] + c[38] + c[42]) / n_words, len(kinds) / n_words, max(kinds.values(), default=0) / n_words, again / n_words,
        pairs / n_words, len(set(lines)) / n_lines, n_words / n_lines / 50, len(set(words)) / math.sqrt(n_words) / 10,
    ]


def feature_rows(df: DataFrame, text_col: str = "text", out: str = "x") -> DataFrame:
    """df without its text column, with an array of features instead. Null texts count as empty."""
    bounded_batches(df.sparkSession)
    (text,) = fresh(df, "text_in")
    rest = [c for c in df.columns if c != text_col]
    (out,) = fresh(df.select(*rest) if rest else df, out)
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t) for t in texts(batch, text)], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), x], names=[*rest, out])

    return df.select(*rest, F.col(text_col).alias(text)).mapInArrow(run, schema)


@dataclass
class Model:
    """One hidden layer over standardised features; `prior` is the score where nothing could be learned."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    w1: np.ndarray | None = None
    b1: np.ndarray | None = None
    w2: np.ndarray | None = None
    b2: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.w1 is None:
            return np.full(len(x), self.prior)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return sigmoid(np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2)


def pu_risk(gp: np.ndarray, gu: np.ndarray, prior: float) -> float:
    """prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the sigmoid loss, of outputs for positives and unlabelled rows."""
    p, u = sigmoid(gp), sigmoid(gu)  # the loss of calling a row negative
    return float(prior * (1 - p).mean() + max(0.0, u.mean() - prior * p.mean()))


def pu_steps(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """What to go down along, for each output: the gradient of pu_risk while the part under max() isn't negative, else
    the opposite of that part's gradient, as non-negative PU learning has it."""
    p, u = sigmoid(gp), sigmoid(gu)
    dp, du = p * (1 - p) / len(p), u * (1 - u) / len(u)
    if u.mean() - prior * p.mean() >= 0:
        return -2 * prior * dp, du
    return prior * dp, -du


def logistic_steps(gp: np.ndarray, gu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradient of the logistic loss of telling positives from unlabelled rows, both sides weighing alike."""
    return (sigmoid(gp) - 1) / len(gp) / 2, sigmoid(gu) / len(gu) / 2


def sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps_of, rounds: int = 800, batch: int = 1024, hidden: int = 16, rate: float = 0.01, decay: float = 1e-3, seed: int = 7) -> Model:
    """A model by Adam over batches of both sides; steps_of gives what to go down along for a batch's outputs."""
    every = np.vstack([positive, unlabelled])
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -8, 8).astype(np.float32) for x in (positive, unlabelled))
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 1 / math.sqrt(p.shape[1]), (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for t in range(1, rounds + 1):
        x = np.vstack([part[rng.integers(0, len(part), min(batch, len(part)))] for part in (p, u)])
        h = np.tanh(x @ w[0] + w[1])
        g = h @ w[2] + w[3][0]
        cut = min(batch, len(p))
        dg = np.concatenate(steps_of(g[:cut], g[cut:]))
        dh = np.outer(dg, w[2]) * (1 - h * h)
        for i, step in enumerate((x.T @ dh, dh.sum(axis=0), h.T @ dg, np.array([dg.sum()]))):
            step = step + decay * w[i] / 10
            m[i] = 0.9 * m[i] + 0.1 * step
            v[i] = 0.999 * v[i] + 0.001 * step * step
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Model(prior, mean, scale, w[0], w[1], w[2], float(w[3][0]))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01, seed: int = 3) -> float:
    """The share of positives among unlabelled rows, without any negative one.

    A model learns to tell the two sides apart on one half of each. On the other halves, the share of unlabelled rows
    that score above a cut over that of positives is at least the prior, and near it where only positives score so
    high; the cut with the least upper confidence bound of that ratio is taken.
    """
    p, u = positive[::2], unlabelled[::2]
    model = fit(p, u, 0.5, logistic_steps, rounds=400, seed=seed)
    sp, su = (np.sort(model.scores(x)) for x in (positive[1::2], unlabelled[1::2]))
    cuts = np.concatenate([sp, su])
    above_p, above_u = (1 - np.searchsorted(s, cuts) / len(s) for s in (sp, su))
    doubt = (1 + gamma) * math.sqrt(math.log(4 / delta) / 2) * (len(sp) ** -0.5 + len(su) ** -0.5)
    ok = above_p > 0
    best = np.argmin((above_u[ok] + doubt) / above_p[ok])
    return float(min(1.0, above_u[ok][best] / above_p[ok][best]))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimise the non-negative unbiased PU risk. Without positives or unlabelled rows the model returns the prior."""
    prior = float(min(max(prior, 0.01), 0.99))
    if not len(positive) or not len(unlabelled):
        return Model(prior)
    return fit(positive, unlabelled, prior, lambda gp, gu: pu_steps(gp, gu, prior))


def remainder(id_col: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % divisor


def _sampled(rows: DataFrame, keys: list[Column], most: int) -> DataFrame:
    """About `most` of the rows by a hash of their keys, or all if there are no more."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(F.lit(11), *keys), F.lit(1 << 30)) < F.lit(int(most / n * (1 << 30))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held_out_fold: int = 1, max_positives: int = 8_000, max_unlabelled: int = 16_000) -> Model:
    """Fit on trusted positives and unlabelled text, both from outside the held-out fold.

    Positives are documents whose labels are all 1, about max_positives of them by a hash of their id; label 0 is
    never learned from. Unlabelled text is a sample of all documents, about max_unlabelled by a hash of id and text,
    whatever their labels. The class prior is estimated from these two sets. Repeated rows count once. Null labels,
    and those neither 0 nor 1, are left out; null texts count as empty. Without documents, or with fewer than four
    positives, the model returns a prior of 0.5.
    """
    side = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (remainder(F.col("k"), folds) != held_out_fold) & F.col("k").isNotNull())
    trusted = _sampled(side.groupBy("k").agg(F.min("y").alias("y")).where("y = 1").select("k"), [F.col("k")], max_positives)
    t1, t2 = content_key(F.col("text"))
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text")).where(remainder(F.col("k"), folds) != held_out_fold)
    positive = rows.join(F.broadcast(trusted), "k")  # ids of about max_positives rows
    unlabelled = _sampled(rows, [F.col("k"), t1], max_unlabelled)
    sides = positive.withColumn("side", F.lit(1)).unionByName(unlabelled.withColumn("side", F.lit(0)))
    keyed = feature_rows(sides.withColumns({"t1": t1, "t2": t2})).dropDuplicates(["side", "k", "t1", "t2"])
    got = keyed.orderBy("side", "t1", "t2", "k").select("side", "x").toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES) if got.num_rows else np.zeros((0, N_FEATURES), dtype=np.float32)
    is_positive = got.column("side").to_numpy() == 1
    p, u = x[is_positive], x[~is_positive]
    if len(p) < 4 or len(u) < 4:
        return Model(0.5)
    return fit_nnpu(p, u, estimated_prior(p, u))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for each row, from the text alone; null and empty texts are scored as empty.

    Repeated rows get equal scores; an empty table gives none. `out` gets underscores before it where docs has such a column.
    """
    bounded_batches(docs.sparkSession)
    (out,) = fresh(docs, out)
    (text,) = fresh(docs, "text_in")
    names = [*docs.columns, out]
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in texts(batch, text)], dtype=np.float32).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(model.scores(x), pa.float64())], names=names)

    return docs.withColumn(text, F.col(text_col)).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that score `least` or more, with all their columns."""
    scored = score(docs, model, text_col)
    return scored.where(F.col(scored.columns[-1]) >= least).select(*docs.columns)
