"""Document quality by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.codepoints import SPACE, joined, letters, marks, sums
from corpusloom.llm.language_id import held_out, sample_of
from corpusloom.llm.shared import table, text_or_empty, text_slices

#: The documented bound of the training sample: about this many labelled rows of each label.
TRAIN_ROWS = 4000
#: Preference pairs that the ranking is learned from, and bins that each measure is cut into.
PAIRS, BINS = 20_000, 16
PREDICT_AT = 0.3
MEASURES = (
    "log_words", "log_chars", "word_length", "long_words", "short_words", "upper", "capital_words", "letters", "digits", "blanks", "symbols", "marks",
    "bars", "commas", "stops", "shouts", "accents", "symbol_words", "bare_symbols", "distinct", "repeats", "pair_repeats", "top_word", "log_lines", "line_words", "line_repeats",
)


def _points(chars: str) -> np.ndarray:
    return np.array([ord(c) for c in chars], dtype=np.uint32)


def _per(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, values, n)


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text, how many different keys it has and how often its commonest key comes."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])]))
    times = np.diff(np.concatenate([first, [len(k)]]))
    top = np.zeros(n)
    np.maximum.at(top, o[first], times)
    return np.bincount(o[first], minlength=n).astype(float), top


def measures(texts: list[str]) -> np.ndarray:
    """The MEASURES of each whole text, a row each; all 0 or more, and defined for the empty text."""
    n = len(texts)
    c, bounds = joined(texts)
    c = c[1:]  # text k and the blank after it lie in bounds[k]..bounds[k+1]
    owner = np.repeat(np.arange(n), np.diff(bounds))
    size = np.maximum(np.diff(bounds) - 1, 0)
    chars = np.maximum(size, 1)
    blank = (c == SPACE) | ((c >= 9) & (c <= 13)) | (c == 0xA0) | (c == 0x3000)
    letter = letters()[c]
    upper = ((c >= 65) & (c <= 90)) | ((c >= 0xC0) & (c <= 0xDE) & (c != 0xD7))
    digit = (c >= 48) & (c <= 57)
    symbol = ~(blank | letter | digit)
    share = lambda mask: sums(mask.astype(np.float64), bounds) / chars

    word = ~blank
    start = np.flatnonzero(word & np.concatenate([[True], blank[:-1]]))
    end = np.flatnonzero(word & np.concatenate([blank[1:], [True]])) + 1
    w_owner = owner[start]
    w_size = (end - start).astype(np.float64)
    words = np.bincount(w_owner, minlength=n).astype(float)
    many = np.maximum(words, 1)
    hashed = np.where(word, marks(c, start), np.uint64(0))
    w_key = np.add.reduceat(hashed, start) if len(start) else np.zeros(0, np.uint64)
    w_letters = np.add.reduceat(letter.astype(np.int64), start) if len(start) else np.zeros(0)
    w_symbols = np.add.reduceat(symbol.astype(np.int64), start) if len(start) else np.zeros(0)
    same = np.concatenate([[False], (w_key[1:] == w_key[:-1]) & (w_owner[1:] == w_owner[:-1])]) if len(start) else np.zeros(0, bool)
    pair_ok = np.flatnonzero(w_owner[1:] == w_owner[:-1]) if len(start) > 1 else np.zeros(0, int)
    pair_key = w_key[pair_ok] * np.uint64(31) + w_key[pair_ok + 1] if len(pair_ok) else np.zeros(0, np.uint64)
    kinds, top = _distinct(w_key, w_owner, n)
    pairs, _ = _distinct(pair_key, w_owner[pair_ok] if len(pair_ok) else np.zeros(0, int), n)

    line_end = (c == 10) | (np.arange(len(c)) + 1 == np.repeat(bounds[1:], np.diff(bounds)))
    l_end = np.flatnonzero(line_end)
    l_start = np.concatenate([[0], l_end[:-1] + 1])
    l_owner = owner[l_end]
    run = np.concatenate([[np.uint64(0)], np.cumsum(hashed, dtype=np.uint64)])
    l_key, l_size = run[l_end] - run[l_start], l_end - l_start
    real = l_size > 0
    l_kinds, _ = _distinct(l_key[real], l_owner[real], n)
    lines = np.bincount(l_owner[real], minlength=n).astype(float)

    of_words = lambda mask: _per(mask.astype(float), w_owner, n) / many
    return np.stack(
        [
            np.log1p(words),
            np.log1p(size),
            _per(w_size, w_owner, n) / many,
            of_words(w_size > 12),
            of_words(w_size <= 2),
            share(upper),
            of_words(upper[start] if len(start) else np.zeros(0)),
            share(letter),
            share(digit),
            share(blank),
            share(symbol),
            share(np.isin(c, _points("#$%&*@^~<>{}[]\\_=+"))),
            share(np.isin(c, _points("|/"))),
            share(np.isin(c, _points(",;:"))),
            share(c == 46),
            share(np.isin(c, _points("!?"))),
            share((c >= 0x80) & letter),
            of_words(w_symbols >= 2),
            of_words((w_letters == 0) & (w_size > 0)),
            kinds / many,
            of_words(same),
            1 - pairs / np.maximum(np.bincount(w_owner[pair_ok], minlength=n) if len(pair_ok) else 1, 1) * (words > 1),
            top / many,
            np.log1p(lines),
            words / np.maximum(lines, 1),
            1 - l_kinds / np.maximum(lines, 1),
        ],
        axis=1,
    )


@dataclass
class Ranking:
    """Cuts of each measure, a worth for each bin, and the line from worth to chance of label 1."""

    cuts: np.ndarray
    worth: np.ndarray
    slope: float = 1.0
    middle: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The Bradley-Terry scores: the sum of the worths of the bins."""
        total = np.zeros(len(x))
        for k, cuts in enumerate(self.cuts):
            total += self.worth[k][np.searchsorted(cuts, x[:, k], side="right")]
        return total

    def chances(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.scores(x) + self.middle, -30, 30)))


def fit(x: np.ndarray, label: np.ndarray, share: float, pairs: int = PAIRS, seed: int = 11) -> Ranking:
    """Learns worths from pairs of a label-1 and a label-0 row; share is label 1's among all labels."""
    cuts = np.stack([np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1]) for col in x.T])
    bins = np.stack([np.searchsorted(c, col, side="right") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    ranking = Ranking(cuts, np.zeros((x.shape[1], BINS)))
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        ranking.middle = 30.0 if len(good) else -30.0
        return ranking
    rng = np.random.default_rng(seed)
    n = min(pairs, len(good) * len(bad))
    one, two = bins[rng.choice(good, n)], bins[rng.choice(bad, n)]
    width = x.shape[1] * BINS
    at = np.arange(x.shape[1]) * BINS
    gram, w = None, np.zeros(width)
    for _ in range(12):  # Newton's steps on feature differences, in blocks of pairs
        gram, grad = np.eye(width) * 3.0, 3.0 * w
        for begin in range(0, n, 4000):
            d = np.zeros((min(4000, n - begin), width))
            rows = np.arange(len(d))[:, None]
            np.add.at(d, (rows, at + one[begin : begin + 4000]), 1)
            np.add.at(d, (rows, at + two[begin : begin + 4000]), -1)
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            gram += (d * (p * (1 - p))[:, None]).T @ d
            grad += d.T @ (p - 1)
        step = np.linalg.solve(gram, grad)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    ranking.worth = w.reshape(x.shape[1], BINS)
    s = ranking.scores(x)
    weight = np.where(label == 1, share / len(good), (1 - share) / len(bad)) * len(label)
    a = np.stack([s, np.ones(len(s))], axis=1)
    line = np.array([1.0, 0.0])
    for _ in range(30):  # the chance of label 1 at a score, at the labels' own shares
        p = 1 / (1 + np.exp(-np.clip(a @ line, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + np.eye(2) * 1e-3, a.T @ (weight * (p - label)))
        line -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    ranking.slope, ranking.middle = float(max(line[0], 1e-3)), float(line[1])
    return ranking


def _measured(batches):
    for batch in batches:
        for part in text_slices(batch, most=1_000_000):
            x = measures(part["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([part["label"], pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Ranking:
    """Fits a ranking on about train_rows labelled rows of each label; rows without label don't count.

    Of documents that repeat an id the one of least hash is learned from; a label given twice counts once, and
    an id with both labels counts as both.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label")).distinct()
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    chosen = F.broadcast(sample_of(known, "label", train_rows, F.xxhash64("__id")))  # about 2 * train_rows rows
    own = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("text"))
    first = own.join(chosen, "__id").groupBy("__id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text")
    got = first.mapInArrow(_measured, "label int, x array<double>").collect()
    if not got:
        return Ranking(np.zeros((len(MEASURES), BINS - 1)), np.zeros((len(MEASURES), BINS)))
    got = sorted(got)
    return fit(np.array([r.x for r in got]), np.array([r.label for r in got]), counts.get(1, 0) / sum(counts.values()))


def quality_of(spark: SparkSession, ranking: Ranking, text: Column) -> Column:
    """The chance (0 to 1) that a text has label 1; the text goes to Python once and alone."""
    held = spark.sparkContext.broadcast(ranking)  # bounded by measures and bins

    @F.arrow_udf("double")
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            parts = text_slices(pa.record_batch([batch], names=["text"]), most=1_000_000)
            scores = [held.value.chances(measures(part["text"].to_pylist())) for part in parts]
            yield pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())

    return found.asNondeterministic()(F.coalesce(text, F.lit("")))  # a filter on it shall not run it again


def score(docs: DataFrame, ranking: Ranking, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1): the chance that a document has label 1, from its whole text.

    Null texts count as empty, and empty texts have measures like any other. Repeated rows get
    equal scores, no rows give no rows, a column named score is replaced, and others stay as they
    are, whatever their names.
    """
    passed = [F.col(f"`{c}`") for c in docs.columns if c != "score"]
    return docs.select(F.struct(*passed).alias("row"), quality_of(docs.sparkSession, ranking, F.col(text_col)).alias("score")).select("row.*", "score")


def keep_best(scored: DataFrame, quantile: float, score_col: str = "score") -> DataFrame:
    """The rows at or above a quantile of all scores."""
    cut = scored.agg(F.percentile_approx(score_col, quantile, 10_000)).first()[0]
    return scored if cut is None else scored.where(F.col(score_col) >= cut)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ranking = learn(docs, labels.where(~held_out()))
    out = score(docs.select("doc_id", held_out().alias("held_out"), "text"), ranking)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
