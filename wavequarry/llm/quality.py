"""Quality classifier: an additive model with pairwise interactions.

Features of a text are binned at quantiles.  Boosting visits the features in
turn; each visit fits a shallow tree to the gradients, which are summed by
bin, and adds its leaves to that feature's lookup table.  Afterwards the pairs
of features with the largest remaining gain get two-dimensional tables on
coarser bins, boosted in the same cyclic way.  A score is the sum of looked-up
bin values through the logistic function.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import full_text

FEATURES = [
    "log_bytes", "upper", "lower", "digit", "space", "newline", "non_ascii", "stops", "exclaims",
    "symbols", "bars", "top_byte", "entropy", "log_words", "word_length", "distinct_words", "repeated_lines", "caps_words",
]
#: Labelled rows that a model is fitted on, at most.
SAMPLE = 20_000
THRESHOLD = 0.3

_CLASS = np.zeros((256, 9), np.float64)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r", "\n")):
    _CLASS[[ord(c) for c in _chars], _k] = 1
_CLASS[128:, 5] = 1
_CLASS[[ord(c) for c in ".,;:?'\"-()"], 6] = 1
_CLASS[ord("!"), 7] = 1
_CLASS[[ord(c) for c in "#$%&*@^~=+<>/\\|{}[]_`"], 8] = 1


def text_features(raw: bytes) -> np.ndarray:
    """The features of one whole text in UTF-8; an empty one has zeros."""
    out = np.zeros(len(FEATURES))
    n = len(raw)
    if not n:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    out[0] = np.log1p(n)
    out[1:10] = counts @ _CLASS / n
    out[10] = counts[ord("|")] / n
    share = counts[counts > 0] / n
    out[11] = share.max()
    out[12] = -(share * np.log2(share)).sum()
    words = raw.split()
    if words:
        out[13] = np.log1p(len(words))
        out[14] = sum(map(len, words)) / len(words)
        out[15] = len(set(words)) / len(words)
        out[17] = sum(map(bytes.isupper, words)) / len(words)
    lines = raw.split(b"\n")
    out[16] = 1 - len(set(lines)) / len(lines)
    return out


def feature_matrix(texts: pa.Array) -> np.ndarray:
    return np.array([text_features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts]).reshape(-1, len(FEATURES))


@dataclass
class AdditiveModel:
    """Lookup tables of a fitted model; ``intercept`` alone where nothing was learned."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, j], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def _quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, least: float, ridge: float) -> np.ndarray:
    """Leaf value of each bin of the best-first tree on binned sums."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])

    def best(a: int, b: int) -> tuple[float, int]:
        cut = np.arange(a + 1, b)
        if not len(cut):
            return 0.0, a
        gl, hl, gr, hr = g[cut] - g[a], h[cut] - h[a], g[b] - g[cut], h[b] - h[cut]
        gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
        gain = np.where((hl < least) | (hr < least), 0, gain)
        k = int(np.argmax(gain))
        return float(gain[k]), int(cut[k])

    parts = [(0, len(grad), *best(0, len(grad)))]
    while len(parts) < leaves:
        k = max(range(len(parts)), key=lambda i: parts[i][2])
        a, b, gain, cut = parts[k]
        if gain <= 1e-9:
            break
        parts[k : k + 1] = [(a, cut, *best(a, cut)), (cut, b, *best(cut, b))]
    out = np.empty(len(grad))
    for a, b, _, _ in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def fit_model(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse_bins: int = 8, rounds: int = 150, pair_rounds: int = 40, pairs: int = 10, rate: float = 0.1, leaves: int = 4, least: float = 2.0, ridge: float = 1.0) -> AdditiveModel:
    """Fit by cyclic boosting with the logistic loss.

    No rows, or rows of one label, give the smoothed base rate as every score.
    """
    rate_of_ones = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(float(np.log(rate_of_ones / (1 - rate_of_ones))))
    if len(np.unique(y)) < 2:
        return model
    d = x.shape[1]
    model.edges = [_quantile_edges(x[:, j], bins) for j in range(d)]
    model.coarse = [_quantile_edges(x[:, j], coarse_bins) for j in range(d)]
    fine = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    margin = np.full(len(y), model.intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(d):
            size = len(model.tables[j])
            if size > 1:
                grad, hess = gradients()
                step = rate * _tree(np.bincount(fine[j], grad, size), np.bincount(fine[j], hess, size), leaves, least, ridge)
                model.tables[j] += step
                margin += step[fine[j]]

    def cells(i: int, j: int) -> tuple[np.ndarray, int, int]:
        a, b = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        return rough[i] * b + rough[j], a, b

    grad, hess = gradients()
    gains = []
    for i, j in combinations(range(d), 2):
        at, a, b = cells(i, j)
        gains.append((float((np.bincount(at, grad, a * b) ** 2 / (np.bincount(at, hess, a * b) + ridge)).sum()), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    model.pair_tables = [np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            at, a, b = cells(i, j)
            grad, hess = gradients()
            g, h = np.bincount(at, grad, a * b).reshape(a, b), np.bincount(at, hess, a * b).reshape(a, b)
            # a tree of depth two: rows are cut first, then each part's columns
            parts = _tree(g.sum(1), h.sum(1), 2, least, ridge)
            step = np.zeros((a, b))
            for value in np.unique(parts):
                of = parts == value
                step[of] = _tree(g[of].sum(0), h[of].sum(0), 2, least, ridge)
            step *= rate
            model.pair_tables[k] += step
            margin += step.reshape(-1)[at]
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel:
    """A model from at most ``sample`` labelled rows outside the held-out fifth.

    The rows are those of smallest id hash, so that the choice is the same at
    every run.  Rows without a quality of 0 or 1 or without a document are
    left out; a document labelled twice counts twice, and so does a doc_id
    that two documents share, within the limit.  Empty tables give the model
    of no rows, a score of one half.  Columns read: doc_id, text; doc_id,
    quality.
    """
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .select(F.col("doc_id").alias("labelled"), F.col("quality").cast("int").alias("y"))
        .orderBy(F.xxhash64("labelled"), "labelled", "y")
        .limit(sample)
    )

    @arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array(list(feature_matrix(texts)), pa.list_(pa.float64()))

    # at most ``sample`` small rows, so a broadcast of bounded size
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    tie = F.xxhash64(full_text())
    # a doc_id may repeat in documents: the limit holds for the joined rows too
    got = rows.select("doc_id", "y", tie.alias("tie"), features(full_text()).alias("x")).orderBy(F.xxhash64("doc_id"), "doc_id", "y", "tie").limit(sample).toPandas()
    got = got.sort_values(["doc_id", "y", "tie"], kind="stable")
    if got.empty:
        return fit_model(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit_model(np.stack(got["x"].to_numpy()), got["y"].to_numpy().astype(float))


def with_score(docs: DataFrame, model: AdditiveModel, column: str = "score") -> DataFrame:
    """``docs`` with the model's score of each whole text, in ``column``.

    A null text counts as empty; a text of any length is read whole, and
    equal texts have equal scores.  Every row is kept, an empty table stays
    empty.  A column of that name is replaced: choose another to keep it.
    """

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(feature_matrix(texts)), pa.float64())

    return docs.withColumn(column, score(full_text()))
