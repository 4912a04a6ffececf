"""Mixing documents to target weights of domains they belong to softly.

A classifier trained on a labelled table gives every document a posterior over the domains. With
rate r a document contributes r times its tokens times its posterior to the domains. The rates start
at 1 and follow the projected gradient of half the squared distance between the domains' expected
token shares and the targets. Each round's gradient is scaled by the inverse of the second moments
that the posteriors of the documents with a rate above 0 have, so a rare domain moves as fast as a hot
one, and of several lengths of the step the best one counts. All that is a sum of a few numbers by
domain: a round is one pass over the stored posteriors, and the driver keeps only the scaled gradients,
from which each task recomputes its documents' rates. Targets that no rates can meet are met as nearly
as possible and reported by a warning; the shares reached are returned.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from plumbline.llm.common import landed, pieces
from plumbline.llm.subwords import Model, fit, labelled_rows

#: Rounds at most, and the distance from the target share at which they stop.
ROUNDS, NEAR = 60, 1e-4
#: What the least deviation of rates from 1 weighs beside the distance, and the lengths of a step.
RIDGE, LENGTHS = 1e-9, [0.5**j for j in range(12)]
#: The weight of a domain that the targets don't name, before weights are scaled to 1.
UNNAMED = 0.05


def domain_model(docs: DataFrame, domain: str = "lang") -> Model:
    """Domain posteriors learned from the rows whose domain is known (a bounded sample of each)."""
    rows = docs.select("doc_id", "text", F.col(domain).cast("string").alias("_domain"))
    return fit(rows.select("doc_id", "text"), labelled_rows(rows, F.col("_domain"), F.lit(True)))


def posteriors(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, tokens (words), posterior for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            share = shared.value.predict(texts) if shared.value.classes else np.zeros((len(texts), 0))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "tokens": pa.array([len(t.encode().split()) for t in texts], pa.int64()),
                    "posterior": pa.array(share.tolist(), pa.list_(pa.float64())),
                }
            )

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return read.mapInArrow(run, "doc_id long, tokens long, posterior array<double>")


def rates(share: np.ndarray, gradients: list[np.ndarray], step: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the given rounds, and which of them are above 0."""
    now = np.maximum(0.0, 1 - step * (share @ sum(gradients, np.zeros(share.shape[1]))))
    return now, now > 0


def as_matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def fitted(known: DataFrame, target: np.ndarray, rounds: int = ROUNDS, near: float = NEAR) -> tuple[list[np.ndarray], float, np.ndarray]:
    """The scaled gradients of all rounds, the step, and the domain shares reached."""
    k = len(target)

    def sums(tries: list[list[np.ndarray]]) -> tuple[float, np.ndarray]:
        """All tokens; per try its domain tokens, its squared rates and its posteriors' second moments."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + len(tries) * (k + 1 + k * k))
            for batch in batches:
                if batch.num_rows:
                    tokens, share = batch.column(0).to_numpy().astype(float), as_matrix(batch.column(1), k)
                    parts = [[tokens.sum()]]
                    for gradients in tries:
                        now, above = rates(share, gradients, 1.0)
                        second = (share * (tokens * above)[:, None]).T @ share
                        parts += [(tokens * now) @ share, [(tokens * now * now).sum()], second.ravel()]
                    total += np.concatenate(parts)
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "v": pa.array(total)})

        parts = known.select("tokens", "posterior").mapInArrow(run, "i int, v double")
        out = np.zeros(1 + len(tries) * (k + 1 + k * k))
        for row in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[row["i"]] = row["v"]
        return out[0], out[1:].reshape(len(tries), -1) / (out[0] or 1)

    gradients: list[np.ndarray] = []
    total, found = sums([gradients])
    if not total:
        return gradients, 1.0, target
    best = found[0]
    while True:
        reached, point = best[:k], sum(gradients, np.zeros(k))
        slope = reached - target - RIDGE * point
        if np.abs(reached - target).max() <= near or np.abs(slope).max() <= near / 10 or len(gradients) == rounds:
            return gradients, 1.0, reached
        scaled = np.linalg.solve(best[k + 1 :].reshape(k, k) + RIDGE * np.eye(k), slope)
        tries = [[*gradients, length * scaled] for length in LENGTHS]
        _, found = sums(tries)
        ends = [sum(t) for t in tries]
        value = [f[k] / 2 + target @ y + RIDGE / 2 * (y @ y) for f, y in zip(found, ends, strict=True)]
        least = int(np.argmin(value))
        gradients, best = tries[least], found[least]


@dataclass
class Mixture:
    """What gives a document its rate: the classifier, the scaled gradients of the rounds, their step, and what they reach."""

    model: Model
    gradients: list[np.ndarray]
    step: float
    reached: np.ndarray  # the domains' token shares at the rates

    def rates(self, share: np.ndarray) -> np.ndarray:
        return rates(share, self.gradients, self.step)[0]


def fit_mixture(known: DataFrame, model: Model, targets: dict[str, float]) -> Mixture:
    """Rates for stored ``posteriors``. Targets are scaled to 1 over the learned domains."""
    target = np.array([targets.get(c, UNNAMED) for c in model.classes], float)
    if not len(target):
        return Mixture(model, [], 1.0, target)
    target = target / target.sum()
    gradients, step, reached = fitted(known, target)
    if np.abs(reached - target).max() > NEAR:
        pairs = ", ".join(f"{c}: {r:.4f} of {t:.4f}" for c, r, t in zip(model.classes, reached, target, strict=True))
        warnings.warn(f"mixing targets not met after {len(gradients)} rounds ({pairs})", stacklevel=2)
    return Mixture(model, gradients, step, reached)


def copies(key: str) -> Column:
    """A whole number of copies whose mean is the rate, drawn by a hash of the key."""
    drawn = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(F.col("rate") + drawn).cast("long")


def mixing_rates(docs: DataFrame, model: Model, targets: dict[str, float]) -> DataFrame:
    """doc_id, tokens, domain (the likeliest), posterior, rate, copies and reached of every document.

    ``rate`` is how often the document is to be used on average, ``copies`` a whole number of that
    mean. ``posterior`` and ``reached``, the token shares of the whole table at the rates, are maps by
    domain. Without a learned domain all rates are 1. Null and empty texts have no tokens and a rate
    all the same. Every row gives a row, repeated ones too; an empty table gives none.
    """
    known = landed(posteriors(docs, model), "posteriors")
    mixture = fit_mixture(known, model, targets)
    k, names = len(model.classes), [str(c) for c in model.classes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                share = as_matrix(batch.column(2), k) if k else np.zeros((batch.num_rows, 0))
                best = [names[i] for i in share.argmax(axis=1)] if k else [None] * batch.num_rows
                added = [pa.array(best, pa.string()), pa.array(mixture.rates(share))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "domain", "rate"])

    out = known.mapInArrow(run, "doc_id long, tokens long, posterior array<double>, domain string, rate double")
    keys = F.array(*[F.lit(c) for c in names]).cast("array<string>")
    reached = F.map_from_arrays(keys, F.array(*[F.lit(float(r)) for r in mixture.reached]).cast("array<double>"))
    return out.select(
        "doc_id", "tokens", "domain", F.map_from_arrays(keys, "posterior").alias("posterior"), "rate", copies("doc_id").alias("copies"), reached.alias("reached")
    )


def with_rates(docs: DataFrame, model: Model, targets: dict[str, float]) -> DataFrame:
    """The documents with columns domain, rate and copies, which replace columns of these names. Cases as above."""
    docs = docs.drop("domain", "rate", "copies")
    mixture = fit_mixture(landed(posteriors(docs, model), "posteriors"), model, targets)
    shared = docs.sparkSession.sparkContext.broadcast(mixture)
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField("domain", StringType()), StructField("rate", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in pieces(batches):
            n, classes = batch.num_rows, known.model.classes
            share = known.model.predict([t or "" for t in batch.column(at).to_pylist()]) if classes else np.zeros((n, 0))
            best = [str(classes[i]) for i in share.argmax(axis=1)] if classes else [None] * n
            added = [pa.array(best, pa.string()), pa.array(known.rates(share))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "domain", "rate"])

    return docs.mapInArrow(run, schema).withColumn("copies", copies("doc_id"))
