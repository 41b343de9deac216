"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every training text: each task keeps one row of bucket counts per language, and
the sums per (language, bucket) are a grouped aggregate. The model has ``BUCKETS`` rows and one column per
language, whatever the corpus holds, so its log probabilities are safe to broadcast. Prediction scores
batches of whole texts with sparse lookups in that matrix.

Defined results: a text that is null or has no letter is ``und`` with score 0; a model learned from no rows
predicts ``und`` for everything; rows with a null language teach nothing; ties go to the language that sorts
first; a repeated row is counted and predicted again; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: More languages than this are refused: the matrix must stay small enough for every executor.
MAX_LANGUAGES = 1_000
_CHUNK = 1 << 18
_SPACE = 32


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")


def grams(texts: list[str], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram order: (text number, bucket) of all n-grams of the texts.

    Letters are lower-cased and anything else is one space; each text has a space at both ends.
    """
    codes = [_codes(f" {t} ") for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
    flat = np.concatenate(codes) if codes else np.zeros(0, dtype="<u4")
    flat = np.where(_letters()[flat], flat, _SPACE).astype(np.uint64)
    gap = flat == _SPACE
    keep = ~gap
    keep[:1] = True
    keep[1:] |= ~gap[:-1] | (owner[1:] != owner[:-1])
    flat, owner = flat[keep], owner[keep]
    for n in ORDERS:
        if len(flat) < n:
            continue
        size = len(flat) - n + 1
        mixed = np.full(size, n, dtype=np.uint64)
        for i in range(n):
            mixed = (mixed ^ flat[i : i + size]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        inside = owner[:size] == owner[n - 1 :]
        yield owner[:size][inside], (mixed[inside] % np.uint64(buckets)).astype(np.int64)


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first text, texts) in runs of bounded size; a longer text is a run of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _CHUNK:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]


@dataclass(frozen=True)
class Model:
    """Languages in order, and log probabilities: one row per bucket, then the log share of training texts."""

    languages: tuple[str, ...]
    log_probs: np.ndarray
    log_prior: np.ndarray

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        clean = [t or "" for t in texts]
        known = len(self.languages)
        out: list[tuple[str, float]] = []
        for _, part in chunks(clean):
            has_letter = np.array([any(c.isalpha() for c in t) for t in part], dtype=bool)
            logs = np.tile(self.log_prior, (len(part), 1))
            if known:
                for owner, bucket in grams(part, len(self.log_probs)):
                    for k in range(known):
                        logs[:, k] += np.bincount(owner, weights=self.log_probs[bucket, k], minlength=len(part))
            for i, row in enumerate(logs):
                if not known or not has_letter[i]:
                    out.append((UNKNOWN, 0.0))
                    continue
                best = int(np.argmax(row))
                out.append((self.languages[best], float(1.0 / np.exp(row - row[best]).sum())))
        return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS, smoothing: float = 0.5) -> Model:
    """Learn from every row of ``docs`` whose language is set."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), dtype=object)
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for first, part in chunks(texts):
                own = names[first : first + len(part)]
                kinds, code = np.unique(own.astype(str), return_inverse=True)
                for name, n in zip(kinds, np.bincount(code, minlength=len(kinds)), strict=True):
                    table.setdefault(name, np.zeros(buckets + 1, dtype=np.int64))[buckets] += n
                for owner, bucket in grams(part, buckets):
                    both = np.bincount(code[owner] * buckets + bucket, minlength=buckets * len(kinds))
                    for k, name in enumerate(kinds):
                        table[name][:buckets] += both[k * buckets : (k + 1) * buckets]
        for name, row in table.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(row[at])], names=["lang", "bucket", "n"]
            )

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text).cast("string"), F.col(lang).cast("string"))
    counts = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    names = np.array(got.column("lang").to_pylist(), dtype=object)
    languages = tuple(sorted(set(names.tolist())))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; at most {MAX_LANGUAGES} are supported")
    place = {name: k for k, name in enumerate(languages)}
    table = np.zeros((buckets + 1, len(languages)))
    table[got.column("bucket").to_numpy(), [place[n] for n in names]] = got.column("n").to_numpy()
    seen, texts = table[:buckets], table[buckets]
    with np.errstate(divide="ignore"):
        log_prior = np.log(texts + 1) - np.log((texts + 1).sum()) if languages else np.zeros(0)
        log_probs = np.log(seen + smoothing) - np.log((seen + smoothing).sum(axis=0)) if languages else seen
    return Model(languages, log_probs, log_prior)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, replacing columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(shared.value.score(texts.tolist()), columns=["lang_pred", "score"])

    found = scored(F.col(text).cast("string"))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn("_found", found).select(*kept, "_found.lang_pred", "_found.score")


def held_out(doc_id: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether a document is kept out of training: crc32 of its id as text, modulo ``folds``. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == fold
