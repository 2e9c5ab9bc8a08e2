"""Severity of toxic language by cumulative-link ordinal regression on sparse word features.

P(grade >= k | text) = sigmoid(w . x - t_k): one weight vector for all thresholds t_1 < t_2 < ...,
so the grades stay ordered. The expected severity is the sum of these chances over k.

Features are words and beginnings of words (letters only, lower case); x counts them, as
log(1 + count). Which of them enter is decided on the labelled sample: those that stand in a far
larger share of graded texts than of texts of grade 0, by a wide margin of chance.
"""

import json
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.llm.words import free_name, thrifty
from postloom.sources.scratch import Workspace

_WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 100_000
#: A text is rejected from this chance of a grade above 0; texts without a feature stay far below.
TOXIC_FROM = 0.25


@dataclass(frozen=True)
class Settings:
    """`per_grade` bounds the labelled documents that the fit looks at, per grade; `features`
    bounds what it keeps, so the model and what reaches the driver do not grow with the data."""

    per_grade: int = 3000
    features: int = 800
    prefixes: tuple = (4, 5, 6)
    lift: float = 4.0
    margin: float = 4.0
    grades: int = 3
    penalty: float = 1e-3
    steps: int = 300


@dataclass
class Model:
    features: list = field(default_factory=list)
    weights: list = field(default_factory=list)
    thresholds: list = field(default_factory=list)
    prefixes: tuple = ()


def word_features(word: str, prefixes: tuple) -> list[str]:
    return [word, *(word[:n] + "*" for n in prefixes if len(word) >= n)]


class Counts(dict):
    """word -> places of its features in the model; words not yet seen are looked up once."""

    def __init__(self, features: list[str], prefixes: tuple):
        super().__init__()
        self.place, self.prefixes = {f: i for i, f in enumerate(features)}, prefixes

    def __missing__(self, word: str):
        found = [self.place[f] for f in word_features(word, self.prefixes) if f in self.place]
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = tuple(found)
        return found

    def of(self, text: str) -> Counter:
        """The count of each feature, by its place."""
        words = _WORD.findall(text.lower())
        return Counter(i for places in map(self.__getitem__, words) if places for i in places)


def _sample(docs, labels, doc, text, grade, settings: Settings, work: Workspace) -> DataFrame:
    """(text, grade): at most `per_grade` documents of grade 0 and of the grades above it, those
    with the smallest hashes of their ids. A document labelled twice has its greatest grade."""
    marked = labels.select(F.col(doc).alias("_doc"), F.col(grade).alias("_grade")).dropna()
    marked = marked.groupBy("_doc").agg(F.max("_grade").alias("_grade"))
    marked = work.stage(marked, "labels")
    order = [F.xxhash64("_doc"), F.col("_doc")]
    parts = [
        marked.where(c).orderBy(*order).limit(settings.per_grade)
        for c in (F.col("_grade") <= 0, F.col("_grade") > 0)
    ]
    chosen = F.broadcast(parts[0].union(parts[1]))  # at most 2 * per_grade ids
    rows = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).where("_text is not null")
    rows = rows.join(chosen, "_doc").groupBy("_doc", "_grade").agg(F.min("_text").alias("_text"))
    return work.stage(rows.select("_text", F.col("_grade").cast("int").alias("_grade")), "sample")


def _choose_features(sample: DataFrame, settings: Settings) -> list[str]:
    sizes = {r[0]: r[1] for r in sample.groupBy(F.col("_grade") > 0).count().collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return []

    def run(batches):
        for batch in batches:
            seen = [Counter(), Counter()]
            for text, grade in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(_WORD.findall(text.lower()))
                seen[grade > 0].update({f for w in words for f in word_features(w, settings.prefixes)})
            names = list(seen[1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names + list(seen[0]), pa.string()),
                    pa.array([*seen[1].values(), *[0] * len(seen[0])], pa.int64()),
                    pa.array([*[0] * len(names), *seen[0].values()], pa.int64()),
                ],
                ["feature", "toxic", "clean"],
            )

    counts = sample.mapInArrow(run, "feature string, toxic long, clean long")
    counts = counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    p, q = F.col("toxic") / toxic, F.col("clean") / clean
    both = (F.col("toxic") + F.col("clean")) / (toxic + clean)
    z = (p - q) / F.sqrt(both * (1 - both) * (1 / toxic + 1 / clean) + 1e-12)
    lift = (F.col("toxic") + 0.5) / toxic / ((F.col("clean") + 0.5) / clean)
    chosen = counts.where((z > settings.margin) & (lift > settings.lift))
    ordered = chosen.orderBy(z.desc(), "feature").limit(settings.features)
    return [r.feature for r in ordered.select("feature").collect()]


def _grades(rows: list[tuple[np.ndarray, int]], settings: Settings) -> np.ndarray:
    """Grades of the sample. Where the labels only tell 0 from 1, the texts labelled 1 are split
    into equal parts by how much of what the features stand for they hold."""
    grades = np.array([g for _, g in rows], int)
    if grades.max(initial=0) > 1:
        return grades
    toxic = np.flatnonzero(grades > 0)
    amount = np.array([np.log1p(rows[i][0]).sum() for i in toxic])
    rank = np.argsort(np.argsort(amount, kind="stable"), kind="stable")
    grades[toxic] = 1 + rank * settings.grades // max(len(toxic), 1)
    return grades


def fit_ordinal(x: np.ndarray, grades: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of least penalised negative log-likelihood, by Adam from zero."""
    levels = int(grades.max())
    shares = np.array([(grades >= k).mean() for k in range(1, levels + 1)]).clip(1e-6, 1 - 1e-6)
    # Thresholds are a start and positive gaps, so their order cannot break.
    starts = np.log((1 - shares) / shares)
    gaps = np.log(np.maximum(np.diff(starts), 1e-2))
    params = np.concatenate([np.zeros(x.shape[1]), starts[:1], gaps])
    first, second = np.zeros_like(params), np.zeros_like(params)
    d = x.shape[1]
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -500, 500)))
    rows = np.arange(len(x))
    for step in range(1, settings.steps + 1):
        weights, cut = params[:d], params[d] + np.concatenate([[0], np.cumsum(np.exp(params[d + 1 :]))])
        above = sigmoid((x @ weights)[:, None] - cut)  # P(grade >= k)
        edges = np.hstack([np.ones((len(x), 1)), above, np.zeros((len(x), 1))])
        slope = np.hstack([np.zeros((len(x), 1)), above * (1 - above), np.zeros((len(x), 1))])
        chance = np.maximum(edges[rows, grades] - edges[rows, grades + 1], 1e-12)
        upper, lower = slope[rows, grades] / chance, slope[rows, grades + 1] / chance
        by_score = -(upper - lower) / len(x)
        by_cut = np.zeros(levels)
        np.add.at(by_cut, grades[grades > 0] - 1, upper[grades > 0] / len(x))
        np.add.at(by_cut, grades[grades < levels], -lower[grades < levels] / len(x))
        tail = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.concatenate(
            [x.T @ by_score + settings.penalty * weights, tail[:1], tail[1:] * np.exp(params[d + 1 :])]
        )
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        rate = 0.1 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        params = params - rate * first / (np.sqrt(second) + 1e-8)
    return params[:d], params[d] + np.concatenate([[0], np.cumsum(np.exp(params[d + 1 :]))])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc: str = "doc_id",
    text: str = "text",
    grade: str = "toxic",
    settings: Settings | None = None,
) -> Model:
    """A model from `labels(doc, grade)` and the texts of `docs`. Grades are whole numbers from 0
    up. Rows with a null id or grade, and null texts, teach nothing. Where the labels hold no text
    of grade 0 or none above it, or no feature tells them apart, the model is empty and every text
    has severity 0."""
    settings = settings or Settings()
    with Workspace(docs.sparkSession) as work:
        sample = _sample(docs, labels, doc, text, grade, settings, work)
        features = _choose_features(sample, settings)
        if not features:
            return Model()

        def run(batches):
            counts = Counts(features, settings.prefixes)
            for batch in batches:
                found = [json.dumps(counts.of(t)) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.string()), batch.column(1)], ["counts", "grade"]
                )

        rows = []
        for row in sample.mapInArrow(run, "counts string, grade int").collect():
            x = np.zeros(len(features))
            for place, n in json.loads(row["counts"]).items():
                x[int(place)] = n
            rows.append((x, row["grade"]))
    rows.sort(key=lambda r: (r[1], r[0].tobytes()))
    x = np.log1p(np.array([r[0] for r in rows]))
    weights, thresholds = fit_ordinal(x, _grades(rows, settings), settings)
    return Model(features, weights.tolist(), thresholds.tolist(), settings.prefixes)


def severity(
    docs: DataFrame,
    model: Model,
    text: str = "text",
    out: str = "severity",
    toxic_from: float = TOXIC_FROM,
) -> DataFrame:
    """`docs` with the struct `out`(expected, toxic): the expected grade, and whether the chance of
    a grade above 0 is at least `toxic_from`. Null and empty texts, and texts without a feature, are judged
    by the thresholds alone; with an empty model all is 0 and false. A column named `out` is
    replaced."""
    docs = docs.drop(out)
    place = docs.columns.index(text)

    def run(batches):
        counts = Counts(model.features, tuple(model.prefixes))
        weights, cut = np.array(model.weights), np.array(model.thresholds)
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for i, value in enumerate(batch.column(place)):
                found = counts.of(value.as_py() or "")
                scores[i] = sum(weights[f] * np.log1p(n) for f, n in found.items())
            above = 1 / (1 + np.exp(-np.clip(scores[:, None] - cut, -500, 500)))
            result = pa.StructArray.from_arrays(
                [
                    pa.array(above.sum(axis=1)),
                    pa.array(above[:, 0] >= toxic_from if len(cut) else np.zeros(len(scores), bool)),
                ],
                ["expected", "toxic"],
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, result], [*batch.schema.names, out])

    verdict = T.StructType().add("expected", "double").add("toxic", "boolean")
    return docs.mapInArrow(thrifty(run), T.StructType([*docs.schema.fields, T.StructField(out, verdict)]))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` without those that `severity` calls toxic; other columns stay."""
    out = free_name(docs, "_severity")
    return severity(docs, model, text, out).where(~F.col(out)["toxic"]).drop(out)
