"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of whole texts are counted in Arrow batches. Small boosted trees are grown on a bounded sample of
labelled rows (SAMPLE, the rows of smallest hash of their id, held-out rows excluded); every path from a root is a
conjunctive rule; logistic regression with a lasso penalty gives most rules no weight; what is left is compiled
into one Spark column expression over the statistics.

Neither ids, sources, languages nor labels are among the statistics. Null texts count as empty and get a score like
any other. Rows with a null id are scored and not held out. Repeated labels of a document count as often as they
are there; null labels do not count. Without labels of both kinds the score is the share of label 1 (0.5 for none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm import arrays
from voxlake.llm.common import cut, whole

SAMPLE = 20_000
TREES, DEPTH, PENALTY = 40, 3, 0.002

CLASSES = {
    "symbols": b"#*$%&|<>", "bars": b"|", "loud": b"!", "marks": b".,;:?", "digits": b"0123456789",
    "capitals": bytes(range(0x41, 0x5B)), "letters": bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]),
    "lines": b"\n",
}
STATISTICS = ("n_words", "word_bytes", *(f"{c}_share" for c in CLASSES), "distinct_share", "repeated_share")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """STATISTICS of each row's text, as rows of a matrix. Shares are of bytes or of words; empty texts have zeros."""
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    start, end, row = arrays.word_spans(data, offsets, arrays.is_space())
    n_words = np.bincount(row, minlength=rows)
    of_bytes, of_words = np.maximum(sizes, 1), np.maximum(n_words, 1)
    out = [np.log1p(n_words), np.bincount(row, end - start, rows) / of_words]
    for members in CLASSES.values():
        table = np.zeros(256, bool)
        table[list(members)] = True
        sums = np.concatenate(([0], np.cumsum(table[data])))
        out.append((sums[offsets[1:] - offsets[0]] - sums[offsets[:-1] - offsets[0]]) / of_bytes)
    hashes = arrays.word_hashes(data, start, end)
    apart = arrays.mix(row.astype(np.uint64) + np.uint64(1))
    out.append(1 - np.bincount(row[_again(hashes ^ apart)], minlength=rows) / of_words)
    if len(hashes) >= 5:
        window = np.zeros(len(hashes) - 4, np.uint64)
        for i in range(5):
            window = arrays.mix(window * np.uint64(31) + hashes[i:i + len(window)])
        whole_window = np.flatnonzero(row[:-4] == row[4:])
        again = whole_window[_again(window[whole_window] ^ apart[whole_window])]
        out.append(np.bincount(row[again], minlength=rows) / of_words)
    else:
        out.append(np.zeros(rows))
    return np.stack(out, axis=1)


def _again(values: np.ndarray) -> np.ndarray:
    """Places of values that stand more than once, but for one of each."""
    order = np.argsort(values)
    return order[1:][values[order[1:]] == values[order[:-1]]]


def _statistics(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        data, offsets = arrays.texts(part.column("text"))
        found = [np.zeros((0, len(STATISTICS)))]
        for first, last in arrays.row_chunks(offsets):
            own = offsets[first:last + 1]
            found.append(statistics(data[own[0]:own[-1]], own))
        matrix = np.concatenate(found)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, matrix.T)], names=["doc_id", *STATISTICS])


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text")).mapInArrow(
        _statistics, ", ".join(["doc_id long", *(f"{s} double" for s in STATISTICS)]))


Condition = tuple[int, bool, float]  # statistic, whether it is over the threshold, threshold


@dataclass(frozen=True)
class Ensemble:
    """Rules with weights; a rule is a tuple of conditions that hold together."""

    bias: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self) -> Column:
        """The probability of label 1, as an expression over the statistics."""
        total = F.lit(self.bias)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for at, over, threshold in conditions:
                holds = holds & ((F.col(STATISTICS[at]) > threshold) if over else (F.col(STATISTICS[at]) <= threshold))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _holds(x: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for at, over, threshold in conditions:
        out &= (x[:, at] > threshold) == over
    return out


def _grow(x: np.ndarray, residual: np.ndarray, rows: np.ndarray, path: tuple[Condition, ...], depth: int,
          least: int) -> list[tuple[tuple[Condition, ...], np.ndarray, bool]]:
    """Nodes under a node: conditions, rows, and whether it is a leaf. Splits lower the squared residuals most."""
    leaf = [(path, rows, True)]
    if depth == 0 or len(rows) < 2 * least:
        return leaf
    y = residual[rows]
    best: tuple[float, int, float] | None = None
    for at in range(x.shape[1]):
        column = x[rows, at]
        for threshold in np.unique(np.quantile(column, np.linspace(0.04, 0.96, 24))):
            over = column > threshold
            n = int(over.sum())
            if least <= n <= len(rows) - least:
                a, b = y[over].sum(), y[~over].sum()
                gain = a * a / n + b * b / (len(rows) - n) - y.sum() ** 2 / len(rows)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, at, float(threshold))
    if best is None or best[0] <= 1e-9:
        return leaf
    _, at, threshold = best
    over = x[rows, at] > threshold
    out = [(path, rows, False)]
    for side in (True, False):
        out += _grow(x, residual, rows[over == side], (*path, (at, side, threshold)), depth - 1, least)
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Ensemble:
    """Rules and weights from statistics and labels 0 and 1."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        edge = min(max(share, 0.01), 0.99)
        return Ensemble(float(np.log(edge / (1 - edge))), ())
    chance = np.random.default_rng(7)
    margin = np.full(len(y), np.log(share / (1 - share)))
    rules: dict[tuple[Condition, ...], None] = {}
    least = max(3, len(y) // 200)
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-margin))
        rows = np.sort(chance.choice(len(y), max(2, min(len(y), 2000)), replace=True))
        for path, own, leaf in _grow(x, residual, rows, (), depth, least):
            if path:
                rules.setdefault(path)
                if leaf:
                    margin[_holds(x, path)] += 0.4 * 4 * residual[own].mean()
    names = list(rules)
    matrix = np.stack([_holds(x, r) for r in names], axis=1).astype(float)
    bias, weights = _lasso(matrix, y, penalty)
    return Ensemble(bias, tuple((r, float(w)) for r, w in zip(names, weights, strict=True) if w))


def _lasso(matrix: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an absolute penalty on the weights, by accelerated proximal gradients."""
    n, width = matrix.shape
    step = 4 / (np.linalg.norm(matrix, 2) ** 2 / n + 1)
    full = np.hstack([matrix, np.ones((n, 1))])
    now = ahead = np.append(np.zeros(width), np.log(y.mean() / (1 - y.mean())))
    pace = 1.0
    for _ in range(rounds):
        gradient = full.T @ (1 / (1 + np.exp(-(full @ ahead))) - y) / n
        moved = ahead - step * gradient
        moved[:width] = np.sign(moved[:width]) * np.maximum(np.abs(moved[:width]) - step * penalty, 0)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = moved + (pace - 1) / faster * (moved - now)
        now, pace = moved, faster
    return float(now[-1]), now[:width]


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    found = cut(text_statistics(docs))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(
        F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    # drawn before the join, so that no more than the sample is ever gathered
    share = min(1.0, sample / max(known.count(), 1))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = found.join(drawn, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *STATISTICS).limit(sample).toPandas()
    model = fit(rows[list(STATISTICS)].to_numpy(), rows["quality"].to_numpy(float))
    scored = found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
