"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged per document.

A document's vector is the mean of the learned vectors of its features; a softmax layer on top gives
class probabilities. Both are trained together by stochastic gradient descent in numpy, on a bounded
sample. For use the two are multiplied out once: the class scores of a document are then the mean of
its features' class scores, so a task holds one small matrix and a text costs a few numpy passes.

Features of a text are its words, the n-grams of characters inside a word with its two borders, and
one mark for each word that repeats the word before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import hash_sample, pieces

#: Buckets of the feature hash, a power of two; one more place stands for a repeated word.
BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
GRAMS = (3, 4)
DIMENSIONS = 16
#: Labelled documents of a class that are learned from, passes over them, and the rate of the first.
PER_CLASS = 1500
EPOCHS = 5
RATE = 0.5
#: Characters whose features are made together; numpy holds some 100 bytes for each of them.
TOGETHER = 1 << 17

BORDER, WORD = re.compile(r"[\x00-\x20]"), re.compile(r"[^\x00-\x20]+")

#: Odd multipliers of the rolling and the mixing hash.
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)


def buckets(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all texts and, for each, the place of its text."""
    joined = "\n" + "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    border = points <= 32
    code = np.where(border, 32, points).astype(np.uint64) * MIX
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(starts))
    ids, owners = [], []
    for n in GRAMS:
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, n, np.uint64)
        inside = np.ones(len(h), bool)
        for k in range(n):
            h = h * STEP + code[k : k + len(h)]
            if 0 < k < n - 1:
                inside &= ~border[k : k + len(h)]
        at = np.flatnonzero(inside)
        at = at[at < len(owner)]
        ids.append(buckets(h[at]))
        owners.append(owner[at])
    # Words: differences of prefix sums of code * STEP**place, moved back to place 0.
    first = np.flatnonzero(border[:-1] & ~border[1:]) + 1
    last = np.flatnonzero(~border[:-1] & border[1:]) + 1
    up, down = (np.full(len(points), base, np.uint64) for base in (STEP, BACK))
    up[0] = down[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * np.cumprod(up))])
    words = (sums[last] - sums[first]) * np.cumprod(down)[first]
    ids.append(buckets(words))
    owners.append(owner[first])
    again = np.flatnonzero((words[1:] == words[:-1]) & (owner[first[1:]] == owner[first[:-1]])) + 1
    ids.append(np.full(len(again), BUCKETS, np.int32))
    owners.append(owner[first[again]])
    return np.concatenate(ids), np.concatenate(owners)


def long_features(text: str, most: int) -> Iterator[np.ndarray]:
    """Feature buckets of a text, cut at the first border after each ``most`` characters; a word stays whole."""
    start, last = 0, None
    while start is not None:
        gap = BORDER.search(text, start + most) if len(text) - start > most else None
        part = text[start : gap.start()] if gap else text[start:]
        yield features([part])[0]
        words = WORD.findall(part)
        if words:
            if words[0] == last:
                yield np.full(1, BUCKETS, np.int32)
            last = words[-1]
        start = gap.end() if gap else None


def portions(texts: list[str], most: int = TOGETHER) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """``features`` of all texts, about ``most`` characters at a time: which texts, buckets, places among them."""
    start = size = 0
    for end, text in enumerate([*texts, None]):
        if start < end and (text is None or size + len(text) >= most):
            if size > most:  # one text
                for ids in long_features(texts[start], most):
                    yield slice(start, end), ids, np.zeros(len(ids), np.int32)
            else:
                yield slice(start, end), *features(texts[start:end])
            start, size = end, 0
        size += len(text or "") + 1


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The feature buckets of a text in order and how often each occurs."""
    if len(text) < TOGETHER:
        return np.unique(features([text])[0], return_counts=True)
    total = np.zeros(BUCKETS + 1, np.int64)
    for _, ids, _ in portions([text]):
        total += np.bincount(ids, minlength=len(total))
    found = np.flatnonzero(total)
    return found, total[found]


@dataclass
class Model:
    """Class scores of every bucket and of an empty text."""

    classes: list
    scores: np.ndarray
    bias: np.ndarray

    def predict(self, texts: list[str]) -> np.ndarray:
        """Class probabilities, one row per text."""
        out = np.tile(self.bias, (len(texts), 1)).astype(np.float64)
        if texts and len(self.classes) > 1:
            sums, n = np.zeros(out.shape), np.zeros((len(texts), 1), np.int64)
            for at, ids, owners in portions(texts):
                rows = at.stop - at.start
                n[at, 0] += np.bincount(owners, minlength=rows)
                for k in range(len(self.classes)):
                    sums[at, k] += np.bincount(owners, self.scores[ids, k], rows)
            out += sums / np.maximum(n, 1)
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


def train(docs: list[tuple[int, np.ndarray, np.ndarray]], classes: list, weights: np.ndarray, seed: int = 7) -> Model:
    """Learn from (class number, bucket ids, counts) triples; ``weights`` balance the classes."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS + 1, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    layer = np.zeros((DIMENSIONS, len(classes)), np.float32)
    bias = np.zeros(len(classes), np.float32)
    done, total = 0, max(1, EPOCHS * len(docs))
    for _ in range(EPOCHS if len(classes) > 1 else 0):
        for d in rng.permutation(len(docs)):
            label, ids, counts = docs[d]
            rate = RATE * (1 - done / total)
            done += 1
            counts = counts.astype(np.float32, copy=False)
            share = counts / max(counts.sum(), 1)
            mean = share @ vectors[ids] if len(ids) else np.zeros(DIMENSIONS, np.float32)
            out = mean @ layer + bias
            out = np.exp(out - out.max())
            error = out / out.sum()
            error[label] -= 1
            error *= weights[label]
            if len(ids):
                # Scaled so that the mean, not a single vector, takes the step.
                back = layer @ error * (rate / (share @ share))
                vectors[ids] -= share[:, None] * back
            layer -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
    return Model(list(classes), (vectors @ layer).astype(np.float32), bias.astype(np.float64))


def sample_features(docs: DataFrame, chosen: DataFrame) -> list[tuple]:
    """(label, ids, counts) of the chosen documents, a bounded table of one doc_id and label each.

    Of repeated ids the least text is used.
    """
    texts = (
        docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .join(F.broadcast(chosen.select("doc_id", "label")), "doc_id")  # about per_class rows a label
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
        .select("doc_id", "label", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, counts = [], []
            for text in batch.column(2).to_pylist():
                found, n = counted(text)
                ids.append(found.astype("<i4").tobytes())
                counts.append(n.astype("<u1" if n.max(initial=0) < 256 else "<f4").tobytes())
            columns = {"doc_id": batch.column(0), "label": batch.column(1)}
            yield pa.RecordBatch.from_pydict({**columns, "ids": pa.array(ids, pa.binary()), "n": pa.array(counts, pa.binary())})

    kind = chosen.schema["label"].dataType.simpleString()
    rows = texts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label {kind}, ids binary, n binary").collect()
    rows.sort(key=lambda r: (str(r["label"]), str(r["doc_id"])))
    # Counts take one byte each where all of a document's fit, which spares the driver.
    width = lambda r: "<u1" if len(r["ids"]) == 4 * len(r["n"]) else "<f4"
    return [(r["label"], np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["n"], width(r))) for r in rows]


def fit(docs: DataFrame, labelled: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model of the labels; with fewer than two labels it gives the only one, or none, to all."""
    chosen, totals = hash_sample(labelled, "label", per_class)
    sample = sample_features(docs, chosen)
    classes = sorted({s[0] for s in sample})
    seen = np.array([sum(s[0] == c for s in sample) for c in classes], float)
    weights = np.array([totals[c] for c in classes]) / seen if classes else seen
    weights = (weights * len(sample) / max((weights * seen).sum(), 1)).astype(np.float32)
    number = {c: k for k, c in enumerate(classes)}
    return train([(number[c], i, n) for c, i, n in sample], classes, weights)


def labelled_rows(labels: DataFrame, label: Column, keep: Column) -> DataFrame:
    """One row of doc_id and label per labelled document; of conflicting labels the least holds."""
    rows = labels.select("doc_id", label.alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    return rows.where(keep).groupBy("doc_id").agg(F.min("label").alias("label"))
