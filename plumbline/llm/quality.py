"""Quality scores by supervised subword embeddings (see ``subwords``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import frame_of, held_out, map_texts, pieces
from plumbline.llm.subwords import Model, fit, labelled_rows

#: Documents that score less are predicted to be of low quality.
ACCEPT = 0.3

SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def quality_model(docs: DataFrame, labels: DataFrame) -> Model:
    """Learned from a bounded sample of the rows of ``labels`` outside the held-out fold."""
    return fit(docs, labelled_rows(labels, F.col("quality"), ~held_out("doc_id")))


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    """How likely each text is of good quality."""
    if not model.classes:
        return np.full(len(texts), 0.5)
    good = [c >= 1 for c in model.classes]
    return np.clip(model.predict([t or "" for t in texts])[:, good].sum(axis=1), 0, 1)


def drop_poor(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """The documents that score at least ``accept``, with all their columns; cases as ``score_quality``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda texts: (None, scores(shared.value, texts) >= accept))


def score_quality(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score and predicted for every text; only the text is looked at.

    Null texts count as empty, and an empty text gets the score of the classes' bias alone. Without
    labels of both kinds the score is 1 if only good ones are known, 0 if only bad, and 0.5 if none.
    Every row gives a row, repeated ones too; an empty table gives none. One narrow pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            score = scores(shared.value, batch.column(1).to_pylist())
            yield frame_of(SCHEMA, {"doc_id": batch.column(0), "score": score})

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = read.mapInArrow(run, "doc_id long, score double")
    return out.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= accept).cast("int").alias("predicted"),
    )
