"""Language identification by cross-parsing entropy.

A suffix automaton holds every substring of a language's labelled text. A document is parsed
against it from left to right into the longest phrases that occur there; text of the same language
needs few, long phrases. Phrases times the bits that point at a place of the labelled text, per
character, is the cross-parsing entropy; the language with the lowest wins.

Documents are cut into stretches of ``STRETCH`` symbols, each parsed from its start, so that numpy
walks the automaton for all stretches of a batch at once. This ends at most one phrase per stretch
early, for every language alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import frame_of, hash_sample, held_out, pieces

#: Characters of labelled text per language (the text that passes it is taken whole), rows looked at
#: for it, and the longest text taken as long as there are shorter ones.
SAMPLE_CHARS = 30_000
SAMPLE_ROWS = 80
LONG_CHARS = 4_000
STRETCH = 256
#: Symbols: 0 stands for any run of characters that are no letters, 1 for letters that the labelled
#: texts lack, 2 to 37 for the commonest letters of these in lower case, 63 fills a stretch. All their other
#: letters are numbered and written as digits, of which 38 to 61 stand for 0 to 23: as many digits each
#: as the last number needs. So every letter of every script keeps a spelling of its own.
SYMBOLS, OTHER, FILL = 64, 1, 63
COMMON, DIGIT, BASE = 36, 38, 24
#: Characters at which the score's certainty is full.
SURE_CHARS = 64

SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def labelled_texts(docs: DataFrame) -> list[tuple[str, str]]:
    """For each language a bounded sample of labelled documents of the learning folds, by hash of id."""
    rows = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out("doc_id"))
    sample, _ = hash_sample(rows.select("lang", "doc_id", "text"), "lang", SAMPLE_ROWS)
    # At most SAMPLE_ROWS rows a language. Only what is used leaves the executors.
    order = Window.partitionBy("lang").orderBy(F.length("text") > LONG_CHARS, F.xxhash64("doc_id"), "doc_id", "text")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sample.select("lang", "text", before.alias("before"), F.row_number().over(order).alias("place"))
    texts: dict[str, list[str]] = {}
    for lang, text in ranked.where(F.col("before") < SAMPLE_CHARS).orderBy("lang", "place").select("lang", "text").collect():
        texts.setdefault(lang, []).append(text)
    return sorted((lang, "\n".join(known)) for lang, known in texts.items())


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Of every code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def symbol_table(texts: list[str]) -> np.ndarray:
    """The symbols of every code point, filled up to the length of the longest spelling."""
    seen = Counter(c for t in texts for c in t.lower() if c.isalpha())
    ranked = sorted(seen, key=lambda c: (-seen[c], c))
    width = 1
    while BASE**width < len(ranked) - COMMON:
        width += 1
    table = np.full((0x110000, width), FILL, np.uint8)
    table[:, 0] = np.where(letters(), OTHER, 0)
    for i, c in enumerate(ranked):
        spelled = [i + 2] if i < COMMON else [DIGIT + (i - COMMON) // BASE**k % BASE for k in range(width)]
        for form in {c, c.upper()}:
            if len(form) == 1:
                table[ord(form), : len(spelled)] = spelled
    return table


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """A text as symbols, with single zeros between words and none at the ends."""
    found = table[np.frombuffer(text.encode("utf-32-le"), np.uint32)].ravel()
    found = found[found != FILL]
    keep = found > 0
    keep[1:] |= found[:-1] > 0
    found = found[keep]
    if len(found) and not found[0]:
        found = found[1:]
    return found[:-1] if len(found) and not found[-1] else found


def suffix_automaton(sequence: list[int]) -> list[dict[int, int]]:
    """The transitions of the smallest automaton that accepts every substring; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    length, link = [0], [-1]
    last = 0
    for symbol in sequence:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in step[at]:
            step[at][symbol] = new
            at = link[at]
        if at >= 0:
            target = step[at][symbol]
            if length[target] != length[at] + 1:
                copy = len(step)
                step.append(dict(step[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                link[target] = copy
                while at >= 0 and step[at].get(symbol) == target:
                    step[at][symbol] = copy
                    at = link[at]
                target = copy
            link[new] = target
        last = new
    return step


def parse_table(step: list[dict[int, int]]) -> np.ndarray:
    """All transitions as one array: at state * SYMBOLS + symbol, 2 * next state * SYMBOLS, and 1 more
    if a phrase begins with the symbol.

    It does where the automaton has no transition, and at the start. A symbol that the labelled text
    lacks is a phrase of its own and leads back to the start.
    """
    begin = np.ones(SYMBOLS, np.int32)
    for symbol, target in step[0].items():
        begin[symbol] = 2 * SYMBOLS * target + 1
    table = np.tile(begin, (len(step), 1))
    rows = np.repeat(np.arange(1, len(step)), [len(s) for s in step[1:]])
    columns = np.array([c for s in step[1:] for c in s], np.int64)
    table[rows, columns] = 2 * SYMBOLS * np.array([t for s in step[1:] for t in s.values()], np.int64)
    table[:, FILL] = 2 * SYMBOLS * np.arange(len(step))
    return table.ravel()


class Parser:
    """Cross-parses texts against the labelled text of every language."""

    def __init__(self, texts: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in texts]
        self.symbol = symbol_table([t for _, t in texts])
        known = [symbols(t, self.symbol) for _, t in texts]
        self.bits = np.array([np.log2(len(k) + 2) for k in known])
        self.tables = [parse_table(suffix_automaton(k.tolist())) for k in known]

    def phrases(self, texts: list[str], stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of each text, whether it has a letter, and its phrases in each language."""
        streams = [symbols(t, self.symbol) for t in texts]
        sizes = np.array([len(s) for s in streams], np.int64)
        stretches = -(-sizes // stretch)
        grid = np.full(int(stretches.sum()) * stretch, FILL, np.uint8)
        first = np.concatenate([[0], np.cumsum(stretches)])
        for at, stream in zip(first, streams, strict=False):
            grid[at * stretch : at * stretch + len(stream)] = stream
        steps = np.ascontiguousarray(grid.reshape(-1, stretch).T)
        counts = np.zeros((len(texts), len(self.langs)), np.int64)
        owner = np.repeat(np.arange(len(texts)), stretches)
        for k, table in enumerate(self.tables):
            at = np.zeros(steps.shape[1], np.int32)
            begun = np.zeros(steps.shape[1], np.int32)
            for row in steps:
                now = table[at + row]
                begun += now & 1
                at = now >> 1
            counts[:, k] = np.bincount(owner, begun, len(texts))
        return sizes, sizes > 0, counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        size, known, phrases = self.phrases([t or "" for t in texts])
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        entropy = phrases * self.bits / np.maximum(size, 1)[:, None]
        best = entropy.argmin(axis=1)
        over = entropy - entropy.min(axis=1, keepdims=True)
        certain = 1 / np.exp2(-over * np.minimum(size, SURE_CHARS)[:, None]).sum(axis=1)
        return [self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, certain, 0.0)


@lru_cache(maxsize=1)
def parser(texts: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(texts)


def predict_language(docs: DataFrame, texts: list[tuple[str, str]]) -> DataFrame:
    """doc_id, lang_pred and score for every text; ``texts`` pairs a language with labelled text.

    Null texts and texts without a letter are ``und`` with score 0; so is everything if nothing is
    labelled. Ties go to the first language in order. Every row gives a row; an empty table none.
    One narrow pass; a task holds one automaton per language, built from bounded text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = parser(shared.value)
        for batch in pieces(batches):
            langs, score = model.predict(batch.column(1).to_pylist())
            yield frame_of(SCHEMA, {"doc_id": batch.column(0), "lang_pred": langs, "score": score})

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return read.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the labelled rows outside the held-out fold."""
    out = predict_language(docs, labelled_texts(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
