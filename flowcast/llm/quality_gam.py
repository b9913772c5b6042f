"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is binned at quantiles of the training sample. Cyclic boosting
goes round the features many times, each time fitting one shallow tree on the residual
along one feature's bins and adding it, damped, to that feature's lookup table. Then the
pairs of features whose joint bins still explain most of the residual get tables of
their own, boosted in the same way with four-leaf trees. A score is the sum of one entry
from each table, looked up for whole batches at once, through the logistic function.

Training takes at most ``max_rows`` labelled rows, those of smallest hash of id; scoring
covers every row. Labels, language, source and id are never inputs of a score.

Defined cases: a null text is the empty text, whose features are all 0 and which is
scored like any other; rows without a label, or without an id, never train; with no
training rows, or one class only, every score is the smoothed share of label 1; a value on
a cut goes into the upper bin, so ties are scored alike, as are repeated rows; of labelled
rows with equal ids any may train; long texts are read whole; an empty table gives an empty table; other columns never take
part.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcast.llm.common import materialise, read
from flowcast.llm.quality_rules import FIELDS as COUNTS
from flowcast.llm.quality_rules import text_stats

FEATURES = ("log_words", "word_chars", "symbols", "duplicate_lines", "window_repeats", "upper_share", "bangs",
            "adjacent_repeats", "stops", "plain_words", "distinct_words", "words_a_line", "pipes", "digits",
            "commas", "ended_lines", "longest_run")
MAX_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 64, 12, 8
ROUNDS, PAIR_ROUNDS, RATE, SMOOTH = 60, 40, 0.15, 2.0
THRESHOLD = 0.3


def text_features(text: bytes) -> list[float]:
    """FEATURES of one UTF-8 text."""
    c = dict(zip(COUNTS, text_stats(text)))
    words = text.split()
    n, lines = max(c["n_words"], 1), [x.rstrip() for x in text.split(b"\n") if x.strip()]
    run = longest = 0
    last = None
    for w in words:
        run = run + 1 if w == last else 1
        longest, last = max(longest, run), w
    return [
        float(np.log1p(c["n_words"])), c["word_chars"] / n, c["n_symbols"] / n,
        c["n_dup_lines"] / max(c["n_lines"], 1), c["n_repeat_words"] / n,
        c["n_upper"] / max(c["n_letters"], 1), c["n_bang"] / n, c["n_again"] / n, c["n_stops"] / n,
        c["n_plain"] / n, len(set(words)) / n, c["n_words"] / max(c["n_lines"], 1), text.count(b"|") / n,
        (len(text) - len(text.translate(None, b"0123456789"))) / max(c["word_chars"], 1), text.count(b",") / n,
        sum(x[-1:] in b".?!" for x in lines) / max(len(lines), 1), float(np.log1p(longest)),
    ]


def features(text: Column) -> Column:
    def of(texts: pa.Array) -> pa.Array:
        rows = [text_features(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
        return pa.array(rows, pa.list_(pa.float64()))
    return F.arrow_udf(of, "array<double>")(text)


@dataclass
class Model:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)  # ascending cuts of each feature
    tables: list[np.ndarray] = field(default_factory=list)  # one entry a bin
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for i, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[i], x[:, i], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.pair_edges[i], x[:, i], side="right"),
                           np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Quantile cuts. A heavy value gets a bin of its own: values at a cut go above it."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher"))


def _leaf(g, h):
    return g / (h + SMOOTH)


def _gain(g, h):
    return g * g / (h + SMOOTH)


def _step(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """A tree of at most ``depth`` levels over ordered bins with gradients g, weights h."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    if depth == 0 or len(g) < 2:
        return out
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
    at = int(gain.argmax()) + 1
    if gain[at - 1] <= _gain(g.sum(), h.sum()) + 1e-9:
        return out
    return np.concatenate((_step(g[:at], h[:at], depth - 1), _step(g[at:], h[at:], depth - 1)))


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a grid by one line along each axis: gain and the four leaves."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = G.shape
    if a < 2 or b < 2:
        return 0.0, np.zeros_like(g)

    def four(S):
        one = S[:-1, :-1]
        two, three = S[:-1, -1:] - one, S[-1:, :-1] - one
        return one, two, three, S[-1, -1] - one - two - three

    gs, hs = four(G), four(H)
    gain = sum(_gain(x, y) for x, y in zip(gs, hs))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    for k, (r, c) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, b)),
                                (slice(i + 1, a), slice(0, j + 1)), (slice(i + 1, a), slice(j + 1, b)))):
        out[r, c] = _leaf(gs[k][i, j], hs[k][i, j])
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model for features x (rows of FEATURES) and labels y (0 or 1)."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    model.edges = [_cuts(x[:, i], BINS) for i in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(model.edges)]
    total = np.full(len(y), model.base)

    def residual():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i, table in enumerate(model.tables):
            r, w = residual()
            step = RATE * _step(np.bincount(at[i], r, len(table)), np.bincount(at[i], w, len(table)), 2)
            table += step
            total += step[at[i]]
    model.pair_edges = [_cuts(x[:, i], PAIR_BINS) for i in range(x.shape[1])]
    size = [len(e) + 1 for e in model.pair_edges]
    cell = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(model.pair_edges)]

    def grids(i, j, r, w):
        flat = cell[i] * size[j] + cell[j]
        n = size[i] * size[j]
        return (np.bincount(flat, v, n).reshape(size[i], size[j]) for v in (r, w))

    r, w = residual()
    ranked = sorted(((_quarters(*grids(i, j, r, w))[0], i, j) for i in range(len(size)) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in ranked[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((size[i], size[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            r, w = residual()
            step = RATE * _quarters(*grids(i, j, r, w))[1]
            table += step
            total += step[cell[i], cell[j]]
    return model


def scored(values: Column, model: Model) -> Column:
    def of(rows: pa.Array) -> pa.Array:
        flat = rows.flatten().to_numpy(zero_copy_only=False)
        return pa.array(model.score(flat.reshape(len(rows), len(FEATURES))))
    return F.arrow_udf(of, "double")(values)


def held_out(id_col: str = "doc_id") -> Column:
    """One in five by CRC-32 of the id as text; rows without an id are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def train(measured: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit on labelled rows of ``measured`` (id, held_out, f) that are not held out: the
    ``max_rows`` of smallest hash of id. Their number is known first, so that only about as
    many, cut at a threshold of the hash, are ever sorted and sent to the driver, however
    many tasks there are."""
    known = labels.select(F.col("doc_id").alias("label_id"), F.col(label_col).cast("double").alias("y")).where("y in (0, 1)")
    rows = materialise(measured.where("not held_out").join(known, F.col("id") == F.col("label_id"))
                       .select("f", "y", F.xxhash64("id").alias("h"), "id"), "gam-labelled")
    # six standard deviations of room: a smaller cut would be one in a billion
    share = (max_rows + 6 * max_rows ** 0.5 + 64) / max(rows.count(), 1)
    if share < 1:
        rows = rows.where(F.col("h") < int(share * 2 ** 64) - 2 ** 63)
    taken = rows.orderBy("h", "id").limit(max_rows).collect()
    x = np.array([r["f"] for r in taken], float).reshape(len(taken), len(FEATURES))
    return fit(x, np.array([r["y"] for r in taken], float))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``."""
    measured = materialise(docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"),
                                       features(F.col(text_col)).alias("f")), "gam-features")
    model = train(measured, labels, label_col, max_rows)
    return measured.select("id", "held_out", scored(F.col("f"), model).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "quality")
    return classify(docs, labels).withColumnRenamed("id", "doc_id")
