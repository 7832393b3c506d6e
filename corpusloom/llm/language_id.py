"""Hierarchical language identification with one-versus-one linear support vector machines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.codepoints import joined, trigrams
from corpusloom.llm.shared import table, text_or_empty, text_slices, trimmed

BITS = 13
#: The documented bound of the training sample: about this many labelled rows of each language.
TRAIN_ROWS = 300
#: and at most this many of all languages together.
MOST_ROWS = 6000
UNKNOWN = "und"
#: Families of common language codes; any other code is a family of its own.
FAMILIES = {
    **dict.fromkeys("af da de en fy is lb nl nb nn no sv yi".split(), "germanic"),
    **dict.fromkeys("ca es fr gl it la oc pt ro".split(), "romance"),
    **dict.fromkeys("be bg bs cs hr mk pl ru sk sl sr uk".split(), "slavic"),
    **dict.fromkeys("et fi hu".split(), "uralic"),
    **dict.fromkeys("lt lv".split(), "baltic"),
    **dict.fromkeys("bn gu hi mr ne pa si ur".split(), "indic"),
    **dict.fromkeys("kn ml ta te".split(), "dravidian"),
    **dict.fromkeys("az kk ky tr tt uz".split(), "turkic"),
    **dict.fromkeys("am ar he mt".split(), "semitic"),
    **dict.fromkeys("id ms tl jv".split(), "austronesian"),
}


@dataclass
class Model:
    """Pairs (of families, then of languages of one family) with a column of weights and a bias each."""

    families: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 25, seed: int = 7) -> np.ndarray:
    """Weights of the L2-regularised hinge loss, by dual coordinate descent; the last is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, alpha, norm = np.zeros(x.shape[1], x.dtype), np.zeros(len(x)), np.einsum("ij,ij->i", x, x, dtype=np.float64)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / norm[i], 0), cost)
            if new != alpha[i]:
                w += x.dtype.type((new - alpha[i]) * y[i]) * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def fit(counts: np.ndarray, langs: list[str]) -> Model:
    """Trains the machines on rows of trigram shares."""
    known = sorted(set(langs))
    model = Model()
    for lang in known:
        model.families.setdefault(FAMILIES.get(lang, lang), []).append(lang)
    if not known:
        return model
    scale = (1 / np.sqrt(counts.mean(axis=0) + 1e-6)).astype(np.float32)
    x = counts * scale
    size = np.float32(max(1e-9, np.sqrt(np.einsum("ij,ij->i", x, x).mean())))
    x /= size
    scale /= size
    family = np.array([FAMILIES.get(n, n) for n in langs])
    names = np.array(langs)
    jobs = [(family, a, b) for a, b in combinations(sorted(model.families), 2)]
    jobs += [(names, a, b) for own in model.families.values() for a, b in combinations(own, 2)]
    columns = []
    for labels, a, b in jobs:
        rows = np.flatnonzero((labels == a) | (labels == b))
        columns.append(linear_svm(x[rows], np.where(labels[rows] == a, 1.0, -1.0), cost=10.0))
        model.pairs.append((a, b))
    if columns:
        w = np.array(columns).T
        model.weights = (w[:-1] * scale[:, None]).astype(np.float32)
        model.bias = w[-1]
    return model


def decide(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language and confidence (0 to 1) of each row of pair margins.

    First the families are decided, then the languages of the winning family: most duels won, then
    the larger sum of margins. The confidence is the product over both levels of the logistic of the
    winner's closest duel.
    """

    def winner(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(names) == 1:
            return np.zeros(len(margins), int), np.ones(len(margins))
        place = {n: i for i, n in enumerate(names)}
        votes, least = np.zeros((len(margins), len(names))), np.full((len(margins), len(names)), np.inf)
        for k, (a, b) in enumerate(model.pairs):
            if a in place and b in place:
                m = margins[:, k]
                for n, s in ((a, m), (b, -m)):
                    votes[:, place[n]] += (s > 0) + np.tanh(s) * 1e-3
                    least[:, place[n]] = np.minimum(least[:, place[n]], s)
        best = votes.argmax(axis=1)
        return best, 1 / (1 + np.exp(-3 * np.clip(least[np.arange(len(best)), best], -20, 20)))

    groups = sorted(model.families)
    top, sure = winner(groups)
    lang = np.empty(len(margins), dtype=object)
    for g, name in enumerate(groups):
        rows = np.flatnonzero(top == g)
        if len(rows):
            own = model.families[name]
            best, more = winner(own)
            lang[rows] = np.array(own, dtype=object)[best[rows]]
            sure[rows] *= more[rows]
    return lang, sure


def _lowered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return joined([t.lower() for t in texts])


def predict(model: Model, texts: list[str]) -> tuple[list[str], list[float]]:
    """Languages and scores; UNKNOWN and 0 for a text without letters, or if no language was learned."""
    points, bounds = _lowered(texts)
    owner, codes, n = trigrams(points, bounds, BITS)
    if not model.families:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    found = model.weights[codes]
    margins = np.stack([np.bincount(owner, found[:, k], len(texts)) for k in range(found.shape[1])], axis=1) if found.shape[1] else np.zeros((len(texts), 0))
    lang, sure = decide(model, margins / np.maximum(n, 1)[:, None] + model.bias)
    return [x if k else UNKNOWN for x, k in zip(lang, n, strict=True)], [float(s) if k else 0.0 for s, k in zip(sure, n, strict=True)]


def _shares(batches):
    """Trigram shares of whole texts, sparse: hashes and shares."""
    for batch in batches:
        for part in text_slices(batch, most=1_000_000):
            points, bounds = _lowered(part["text"].to_pylist())
            owner, codes, n = trigrams(points, bounds, BITS)
            out = []
            for k in range(part.num_rows):
                at = np.searchsorted(owner, [k, k + 1])
                own = np.bincount(codes[at[0] : at[1]], minlength=1 << BITS)
                some = np.flatnonzero(own)
                out.append((some.tolist(), (own[some] / max(1, n[k])).tolist()))
            cols = [part["lang"], pa.array([a for a, _ in out], pa.list_(pa.int32())), pa.array([b for _, b in out], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "code", "share"])


def sample_of(rows: DataFrame, key: str, most: int, seed: Column, whole: int | None = None) -> DataFrame:
    """About `most` rows of each value of key, and `whole` rows of all values, the same ones on every run."""
    counts = {r[0]: r[1] for r in rows.groupBy(key).count().collect()}
    if not counts:
        return rows.limit(0)
    if whole is not None:
        if len(counts) > whole:
            raise ValueError(f"{len(counts)} values of {key}: more than the {whole} rows to learn from")
        most = min(most, whole // len(counts))
    share = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, most / n)))]), F.col(key))
    return rows.where(F.pmod(seed, F.lit(1 << 30)) < share * (1 << 30))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Model:
    """Fits a model on about train_rows rows of each language (MOST_ROWS of all); executors turn texts to shares.

    Rows of equal id and text are one row. No row with a language gives a model that knows none.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    chosen = sample_of(rows, "lang", train_rows, F.xxhash64("id", "text"), MOST_ROWS).dropDuplicates(["lang", "id", "text"]).select("lang", "text")
    got = chosen.mapInArrow(trimmed(_shares), "lang string, code array<int>, share array<float>").collect()
    counts, langs = np.zeros((len(got), 1 << BITS), np.float32), []
    for k, r in enumerate(sorted(got)):
        counts[k, r.code] = r.share
        langs.append(r.lang)
    rows = np.flatnonzero(counts.any(axis=1))
    return fit(counts[rows], [langs[k] for k in rows])


def language_of(spark: SparkSession, model: Model, text: Column) -> Column:
    """lang_pred and score of a text, which goes to Python once and alone."""
    held = spark.sparkContext.broadcast(model)  # bounded by the languages and 2**BITS

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from trimmed(scored)(texts)

    def scored(texts):
        for batch in texts:
            langs, scores = [], []
            for part in text_slices(pa.record_batch([batch], names=["text"]), most=1_000_000):
                lang, score = predict(held.value, part["text"].to_pylist())
                langs += lang
                scores += score
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return found.asNondeterministic()(F.coalesce(text, F.lit("")))  # a filter on it shall not run it again


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, from whole texts; other columns are only passed through.

    Null and empty texts and texts without letters are `und` with score 0. Repeated rows get equal
    results, an empty table gives no rows, columns named like the new ones are replaced, and all
    others stay as they are, whatever their names.
    """
    passed = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    both = docs.select(F.struct(*passed).alias("row"), language_of(docs.sparkSession, model, F.col(text_col)).alias("found"))
    return both.select("row.*", "found.*")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
