"""Quality rules: counts with stated limits, then a calibrated n-gram classifier.

The counts (words, symbols, repeated lines and words) fail a text by themselves where it is too
short or mostly repetition. Every other text is scored by a logistic regression over hashed word
and character n-grams, trained on labelled rows; its output is made a probability on rows that it
was not trained on, and compared with a fixed threshold. Counts and scores are made in one pass
over the texts, in Arrow batches.

The fit uses a bounded sample of labelled rows (`text_features.SAMPLE_ROWS`), four fifths for the
weights and one for the calibration. Labels are no input of a score.

Edge cases: a NULL text has no words and no characters, and fails. Without labels of both kinds
every text that passes the counts is kept. Rows that repeat a doc_id are judged as rows. Other
columns are ignored; `drop_rejected` keeps them. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpath.llm.common import small
from tillpath.llm.text_features import SAMPLE_ROWS, SIZE, Adam, sample, scaled, squash, vector

# Fixed thresholds: least words, most repeated words of a hundred, least probability of quality.
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_QUALITY = 50, 50, 0.35
SEED, ROUNDS, RATE, DECAY = 23, 300, 0.05, 1e-5

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_GAPS = np.zeros(256, bool)
_GAPS[list(b"\x20\x09\x0a\x0b\x0c\x0d")] = True


@dataclass
class Model:
    weights: np.ndarray
    slope: float
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return squash(self.slope * (scaled(x) @ self.weights) + self.bias)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    size = len(known)
    _, pair = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)
    _, window, count = np.unique(pair[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    twice = count[window] > 1
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift : n - 2 + shift] |= twice
    return int(inside.sum())


def counts(data: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a UTF-8 text."""
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    # Bytes 128 to 191 continue a character.
    chars = int(len(data) - by_byte[128:192].sum() - by_byte[_GAPS].sum())
    seen: set[bytes] = set()
    again = 0
    for line in data.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    return len(words), chars, int(by_byte[_SYMBOLS].sum()), again, repeated_words(words)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Logistic regression, then slope and bias of its output on the rows set aside."""
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(SIZE, np.float32), 1.0, 30.0)
    x = scaled(x)
    order = np.random.default_rng(SEED).permutation(len(y))
    aside, rest = order[::5], np.delete(order, np.arange(0, len(order), 5))
    if len(set(y[aside].tolist())) < 2 or len(set(y[rest].tolist())) < 2:
        aside = rest = order
    w, adam = np.zeros(SIZE + 1), Adam(SIZE + 1, RATE)
    for step in range(ROUNDS):
        adam.rate = RATE * (1 - step / ROUNDS) + 1e-4
        error = (squash(x[rest] @ w[:-1].astype(np.float32) + w[-1]) - y[rest]) / len(rest)
        slope = np.append(x[rest].T @ error.astype(np.float32) + DECAY * w[:-1], error.sum())
        adam.step(w, slope)
    weights = w[:-1].astype(np.float32)
    z, t = x[aside] @ weights + w[-1], y[aside].astype(float)
    # Targets pulled off 0 and 1 by the sizes of the classes, so that a clean separation stays finite.
    ones, zeros = t.sum(), len(t) - t.sum()
    t = np.where(t == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = squash(a * z + b)
        g = np.array([((p - t) * z).sum(), (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * z * z).sum() + 1e-6, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return Model(weights, float(a), float(b + a * w[-1]))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    return fit(*sample(docs, labels.select("doc_id", F.col("quality").alias("value")), most))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_VERDICT = ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean, kept boolean"


def judge(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns `keep` (doc_id) with the counts, base_failed and kept of every row.

    A text that is kept goes to the workers once, like one that is not.
    """
    keep = ["doc_id"] if keep is None else keep
    sent = keep if text in keep else [*keep, text]
    place_of_text = sent.index(text)
    names = [*keep, *_COUNTS, "base_failed", "kept"]

    def batches(stream):
        for batch in small(stream):
            texts = batch.column(place_of_text).cast(pa.binary()).to_pylist()
            found, passed = [], np.zeros(len(texts), bool)
            for at in range(0, len(texts), 256):
                vectors, places = [], []
                for place, data in enumerate(texts[at : at + 256], at):
                    data = data or b""
                    words = data.split()
                    row = counts(data, words)
                    failed = row[0] < MIN_WORDS or 100 * row[4] > MAX_REPEAT_PERCENT * row[0]
                    found.append((*row, failed))
                    if not failed:
                        vectors.append(vector(data, words))
                        places.append(place)
                if places:
                    passed[places] = model.probability(np.stack(vectors)) >= MIN_QUALITY
            columns = list(zip(*found)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(len(keep))],
                    *[pa.array(c, pa.int64()) for c in columns[:5]],
                    pa.array(columns[5], pa.bool_()), pa.array(passed),
                ],
                names,
            )

    kinds = dict(docs.dtypes)
    fields = ", ".join(f"`{k}` {kinds[k]}" for k in keep)
    return docs.select(*sent).mapInArrow(batches, f"{fields}, {_VERDICT}")


def quality_rules(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    return judge(docs, train(docs, labels, most))


def drop_rejected(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """`docs` without the rows that the rules reject; texts are judged where they are, without a shuffle."""
    plain = docs.select([F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)])
    model = train(docs, labels, most)
    text = f"_{[c.lower() for c in docs.columns].index('text')}"
    judged = judge(plain, model, [f"_{i}" for i in range(len(docs.columns))], text)
    return judged.where("kept").select([F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
