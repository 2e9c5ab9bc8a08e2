"""Language identification by the nearest of several centroids per language.

A text is a vector of character n-grams: letters in lower case, all else one blank between words,
grams of one to `longest` characters hashed into `bins`, counts damped by a logarithm, weighted by
inverse document frequency and scaled to length one. Document frequencies are counted over every
training document. Per language a bounded sample is clustered by spherical k-means; a text takes
the language of the centroid with the greatest cosine. One that is further from it than nearly all
of the centroid's own sample is rejected.
"""

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.sources.scratch import Workspace

PIECE = 1 << 20
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """`per_language` bounds the documents that are clustered, per language; `slack` is how far
    below its sample's least cosine a centroid still accepts."""

    bins: int = 4096
    longest: int = 3
    clusters: int = 3
    per_language: int = 300
    rounds: int = 10
    slack: float = 0.1


@dataclass
class Model:
    settings: Settings
    idf: np.ndarray = None
    languages: list = field(default_factory=list)  # of each centroid
    centroids: np.ndarray = None
    accepts: np.ndarray = None  # the least cosine that each accepts


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_bins(texts: list[str], letters: np.ndarray, settings: Settings):
    """(bin, text) of every n-gram of the texts, and which texts have a letter."""
    lower = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in lower])
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(texts)), sizes)
    is_letter = letters[points]
    # A blank stands before each word; other characters go.
    starts = is_letter.copy()
    starts[1:] &= ~(is_letter[:-1] & (text[1:] == text[:-1]))
    kept = np.flatnonzero(is_letter)
    extra = starts[kept]
    place = np.arange(len(kept)) + np.cumsum(extra)
    total = len(kept) + int(extra.sum())
    symbols = np.full(total, 32, np.uint64)
    owner = np.zeros(total, np.int64)
    symbols[place] = points[kept]
    owner[place] = text[kept]
    owner[place[extra] - 1] = text[kept][extra]
    code = np.zeros(total, np.uint64)
    shift = np.uint64(64 - settings.bins.bit_length() + 1)
    bins, owners = [], []
    for n in range(1, settings.longest + 1):
        size = total - n + 1
        if size <= 0:
            break
        code = code[:size] * np.uint64(0x100000001B3) + symbols[n - 1 :] + np.uint64(n)
        same = owner[:size] == owner[n - 1 :]
        hashed = (code * np.uint64(0x9E3779B97F4A7C15)) >> shift
        bins.append(hashed[same].astype(np.int64))
        owners.append(owner[:size][same])
    has = np.bincount(text[kept], minlength=len(texts)) > 0
    empty = np.zeros(0, np.int64)
    return (
        np.concatenate(bins) if bins else empty,
        np.concatenate(owners) if owners else empty,
        has,
    )


def gram_counts(texts: list[str], letters, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(texts x bins) counts, and which texts have a letter."""
    bins, owner, has = gram_bins(texts, letters, settings)
    size = len(texts) * settings.bins
    counts = np.bincount(owner * settings.bins + bins, minlength=size)
    return counts.reshape(len(texts), settings.bins), has


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(counts, dtype=np.float32) * idf
    norm = np.sqrt((weighted**2).sum(axis=1, keepdims=True))
    return weighted / np.maximum(norm, 1e-12)


def text_groups(column: pa.Array):
    """Texts of about a megabyte, and at most 256, together; a null is an empty text."""
    part, size = [], 0
    for value in column:
        text = value.as_py() or ""
        part.append(text)
        size += len(text)
        if size >= PIECE or len(part) == 256:
            yield part
            part, size = [], 0
    if part:
        yield part


def cluster(x: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids of length one, own centroid of each row) by spherical k-means. The first centre
    is the row nearest the mean, each further one the row least like all before it."""
    mean = x.mean(axis=0)
    chosen = [int((x @ mean).argmax())]
    while len(chosen) < min(k, len(x)):
        near = (x @ x[chosen].T).max(axis=1)
        near[chosen] = np.inf
        chosen.append(int(near.argmin()))
    centres = x[chosen].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        for i in range(len(centres)):
            if (own == i).any():
                total = x[own == i].sum(axis=0)
                centres[i] = total / max(np.linalg.norm(total), 1e-12)
    return centres, (x @ centres.T).argmax(axis=1)


def fit(
    docs: DataFrame, *, doc: str = "doc_id", text: str = "text", language: str = "lang",
    settings: Settings | None = None,
) -> Model:
    """A model of the rows with a language and a letter in their text. The sample of a language
    is its `per_language` distinct texts with the smallest hashes, so repeated rows count once
    there. Without any row the model knows no language."""
    settings = settings or Settings()
    rows = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text"), F.col(language).alias("_lang"))
    rows = rows.where("_text is not null and _lang is not null")

    def frequencies(batches):
        letters, total, n = letter_table(), np.zeros(settings.bins, np.int64), 0
        for batch in batches:
            for part in text_groups(batch.column(0)):
                bins, owner, has = gram_bins(part, letters, settings)
                seen = np.zeros((len(part), settings.bins), bool)
                seen[owner, bins] = True
                total += seen.sum(axis=0)
                n += int(has.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array([*range(settings.bins), -1]), pa.array([*total.tolist(), n])], ["bin", "n"]
        )

    counted = rows.select("_text").mapInArrow(frequencies, "bin long, n long")
    counted = dict(map(tuple, counted.groupBy("bin").agg(F.sum("n")).collect()))
    n = counted.pop(-1, 0)
    model = Model(settings)
    if not n:
        return model
    df = np.array([counted[i] for i in range(settings.bins)])
    model.idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    order = Window.partitionBy("_lang").orderBy("_key")
    with Workspace(docs.sparkSession) as work:
        keyed = rows.where(F.col("_text").rlike(r"\p{L}")).withColumn("_key", F.md5("_text"))
        # Distinct texts are picked, and each is moved once, however many rows have it.
        ranked = keyed.select("_lang", "_key").distinct().withColumn("_rank", F.row_number().over(order))
        picked = work.stage(ranked.where(F.col("_rank") <= settings.per_language), "picked")
        same = [F.col(f"k.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("_lang", "_key")]
        sample = keyed.alias("k").join(F.broadcast(picked).alias("p"), same, "left_semi")
        sample = sample.groupBy("_lang", "_key").agg(F.first("_text").alias("_text"))
        idf = model.idf

        def centres(group: pd.DataFrame) -> pd.DataFrame:
            letters = letter_table()
            texts = sorted(group["_text"])
            x = np.concatenate(
                [
                    vectors(gram_counts(part, letters, settings)[0], idf)
                    for part in text_groups(pa.array(texts))
                ]
            )
            found, own = cluster(x, settings.clusters, settings.rounds)
            near = (x * found[own]).sum(axis=1)
            least = [float(near[own == i].min()) if (own == i).any() else 1.0 for i in range(len(found))]
            return pd.DataFrame(
                {
                    "lang": group["_lang"].iloc[0],
                    "centroid": [c.tobytes() for c in found],
                    "accepts": [v - settings.slack for v in least],
                }
            )

        found = sample.groupBy("_lang").applyInPandas(
            centres, "lang string, centroid binary, accepts double"
        ).collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["centroid"])))
    model.languages = [r["lang"] for r in found]
    model.centroids = np.array([np.frombuffer(r["centroid"], np.float32) for r in found])
    model.accepts = np.array([r["accepts"] for r in found])
    return model


def predict(docs: DataFrame, model: Model, *, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, language, score (the cosine, 0 to 1) and whether it is rejected, per
    row. A null text, and one without a letter, has language `und`, score 0 and is rejected; so
    has every text where the model knows no language."""
    # Plain values: a class would be looked for on the executors.
    sent = docs.sparkSession.sparkContext.broadcast({**vars(model), "settings": vars(model.settings)})
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).alias("_text"))

    def run(batches):
        model, letters = Model(**{**sent.value, "settings": Settings(**sent.value["settings"])}), letter_table()
        for batch in batches:
            at = 0
            for part in text_groups(batch.column(len(names))):
                best = np.zeros(len(part), np.int64)
                score = np.zeros(len(part))
                known = np.zeros(len(part), bool)
                if model.languages:
                    counts, known = gram_counts(part, letters, model.settings)
                    near = vectors(counts, model.idf) @ model.centroids.T
                    best, score = near.argmax(axis=1), near.max(axis=1).astype(float).clip(0, 1)
                languages = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
                far = ~known
                if model.languages:
                    far |= score < model.accepts[best]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(at, len(part)) for c in batch.columns[: len(names)]),
                        pa.array(languages, pa.string()),
                        pa.array(np.where(known, score, 0.0)),
                        pa.array(far),
                    ],
                    [*names, "language", "score", "rejected"],
                )
                at += len(part)

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema][: len(names)]
    out = rows.mapInArrow(run, ", ".join([*kinds, "language string, score double, rejected boolean"]))
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "language", "score", "rejected")


def held_out(doc: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether the id's checksum falls into the fold kept from training; a null id does not."""
    return F.coalesce(F.crc32(doc.cast("string")) % folds == fold, F.lit(False))
