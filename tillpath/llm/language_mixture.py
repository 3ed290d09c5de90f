"""Language identification by mixtures of languages.

A language is a distribution over character n-grams (one to four letters of the lower-cased text, words
closed by boundaries, everything that is no letter a boundary), hashed to a fixed number of cells and
smoothed. A text is taken as n-grams drawn from a mixture of languages:

1. every language alone gives a likelihood of the text, and with the share of the language among the
   rows learned from a posterior probability; the best one starts the set;
2. the language whose share would raise the likelihood fastest joins the set, and expectation-maximisation
   estimates the shares of the set anew. It stays if the gain exceeds the penalty, half the logarithm of the number
   of n-grams for each language (the Bayesian information criterion). As n-grams of several orders
   overlap, log likelihoods are divided by the number of orders. The likelihood is concave in the shares, so the slope
   bounds what a language can add, and one that cannot pay the penalty is not tried;
3. the language with the greatest share is the prediction; its share times its posterior probability is the score.

Learning counts the n-grams of all rows that may be learned from: dense counts in each task, then summed by
(language, cell) in Spark. The model has at most `MOST_NUMBERS` numbers whatever the corpus is, fewer cells a language
when there are many languages; this table alone reaches the driver and is broadcast.

Edge cases: NULL and empty texts and texts without a letter are `und` with score 0; so is every text if
nothing was learned. Rows with a NULL language or doc_id are not learned from; a NULL doc_id is not held out. Repeated rows
each give a row (and count each when learned from). An empty table gives no rows. Very long texts are read in pieces of a
million characters. Ties go to the language that comes first by name. Other columns are ignored. More than
4096 languages are an error: that is no column of languages.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpath.llm.common import small

ORDERS = 4
MOST_CELLS, MOST_NUMBERS, MOST_LANGUAGES = 1 << 16, 1 << 22, 1 << 12
SMOOTHING = 0.1
ROUNDS, CLOSE = 200, 1e-4
UNKNOWN = "und"
_PIECE = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def cells(text: str | None, n_cells: int) -> np.ndarray | None:
    """The cell of every n-gram of a text; None if it has no letter."""
    found = []
    for at in range(0, len(text or ""), _PIECE):
        codes = np.frombuffer(text[at : at + _PIECE].lower().encode("utf-32-le", "replace"), "<u4")
        codes = np.where(_letters()[codes], codes, 0)
        if not codes.any():
            continue
        codes = np.concatenate(([0], codes, [0])).astype(np.uint64)
        codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
        mixed = np.zeros(len(codes), np.uint64)
        for order in range(1, ORDERS + 1):
            # What `order - 1` letters gave, and one more.
            mixed = mixed[: len(codes) - order + 1] * np.uint64(0x100000001B3) + codes[order - 1 :] + np.uint64(1)
            found.append(mixed if order > 1 else mixed[codes != 0])
    if not found:
        return None
    hashed = np.concatenate(found)
    hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((hashed >> np.uint64(32)) % np.uint64(n_cells)).astype(np.int64)


@dataclass
class Model:
    names: list[str]
    chances: np.ndarray  # cells x languages
    prior: np.ndarray  # logarithms, as in `logs`
    logs: np.ndarray

    @property
    def n_cells(self) -> int:
        return len(self.chances)


def mixture(counts: np.ndarray, chances: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the languages by expectation-maximisation, and the log likelihood they reach."""
    shares, total, before = start, counts.sum(), -np.inf
    for _ in range(ROUNDS):
        mixed = chances @ shares
        reached = float(counts @ np.log(mixed))
        if reached - before < CLOSE:
            break
        before = reached
        shares = shares * (chances.T @ (counts / mixed)) / total
    return shares, reached


def shares_of(grams: np.ndarray, model: Model) -> tuple[dict[int, float], np.ndarray]:
    """The languages of a text, given the cells of its n-grams, with their shares, and the posterior
    probability of every language alone."""
    counts = np.bincount(grams, minlength=model.n_cells)
    used = np.flatnonzero(counts != 0)
    counts, chances = counts[used].astype(np.float64), model.chances[used]
    alone = counts @ model.logs[used]
    posterior = alone / ORDERS + model.prior
    chosen = [int(np.argmax(posterior))]
    posterior = np.exp(posterior - posterior.max())
    posterior /= posterior.sum()
    penalty = 0.5 * np.log(counts.sum()) * ORDERS
    shares, reached = np.ones(1), float(alone[chosen[0]])
    while len(chosen) < chances.shape[1]:
        slope = chances.T @ (counts / (chances[:, chosen] @ shares)) - counts.sum()
        slope[chosen] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= penalty:
            break
        tried = [*chosen, best]
        new, likely = mixture(counts, chances[:, tried], np.append(shares * 0.8, 0.2))
        if likely - reached <= penalty:
            break
        chosen, shares, reached = tried, new, likely
    return {k: float(s) for k, s in zip(chosen, shares)}, posterior


def predict(text: str | None, model: Model) -> tuple[str, float, str]:
    """Language, score, and the whole mixture as `name share` by falling share."""
    grams = cells(text, model.n_cells) if model.names else None
    if grams is None:
        return UNKNOWN, 0.0, ""
    shares, posterior = shares_of(grams, model)
    order = sorted(shares, key=lambda k: (-shares[k], k))
    first = order[0]
    # Beside a language of the same set, only what stands outside it casts doubt.
    doubt = 1 - sum(posterior[k] for k in shares)
    sure = posterior[first] if len(shares) == 1 else 1 - doubt
    listed = ",".join(f"{model.names[k]} {shares[k]:.4f}" for k in order)
    return model.names[first], float(min(1.0, max(0.0, shares[first] * sure))), listed


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def learn(rows: DataFrame) -> Model:
    """The languages of `rows` (text, lang) with a text and a language."""
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text")
    by_name = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # One more than allowed, to know.
    found = sorted((r["lang"], r["n"]) for r in by_name.limit(MOST_LANGUAGES + 1).collect())
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not found:
        return Model([], np.zeros((1, 0)), np.zeros(0), np.zeros((1, 0)))
    names = [name for name, _ in found]
    place = {name: k for k, name in enumerate(names)}
    n_cells = min(MOST_CELLS, MOST_NUMBERS // len(names))

    def batches(stream):
        total: dict[int, np.ndarray] = {}
        for batch in small(stream, 64):
            held: dict[int, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (grams := cells(text, n_cells)) is not None:
                    held.setdefault(place[lang], []).append(grams)
            for k, grams in held.items():
                total[k] = total.get(k, 0) + np.bincount(np.concatenate(grams), minlength=n_cells)
        for k, counts in total.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), k)), pa.array(used), pa.array(counts[used])], ["language", "cell", "n"]
            )

    summed = rows.mapInArrow(batches, "language long, cell long, n long").groupBy("language", "cell").agg(F.sum("n").alias("n"))
    table = summed.toArrow()  # at most MOST_NUMBERS rows
    counts = np.zeros((n_cells, len(names)))
    counts[table.column("cell").to_numpy(), table.column("language").to_numpy()] = table.column("n").to_numpy()
    chances = (counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * n_cells)
    n_rows = np.array([n for _, n in found], np.float64)
    return Model(names, chances, np.log(n_rows / n_rows.sum()), np.log(chances))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and languages (the mixture) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(stream):
        for batch in small(stream):
            found = [predict(text, shared.value) for text in batch.column(2).to_pylist()]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns], ["doc_id", "held_out", "lang_pred", "score", "languages"]
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text"))
    return plain.mapInArrow(batches, "doc_id long, held_out boolean, lang_pred string, score double, languages string")


def language_id(docs: DataFrame) -> DataFrame:
    """Learns from the rows of `docs` that are not held out and predicts for all."""
    learned = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("text", "lang")
    return identify(docs, learn(learned))
