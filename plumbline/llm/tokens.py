"""Token counts by a whole-token shortcut.

A sentencepiece BPE model with an identity normaliser joins symbols only into vocabulary pieces,
and no piece holds the space mark after another character. So no merge ever crosses the place
between a word and the space before the next one, and a text's count is the sum over its
pre-tokens (a run of spaces and the word after it). ``proven_words`` checks these two facts on the
model once, offline, and lists the vocabulary strings that encode alone as one token. A pre-token
among them counts 1 without any merging; only the rest is merged by the library, each distinct
one once per worker as long as the bounded memo holds it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import frame_of, pieces

MARK = "▁"
#: A worker forgets its merged pre-tokens once they hold more characters than this.
MEMO_CHARS = 8_000_000

SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_merged", pa.int64())]
)


def proven_words(model: sentencepiece.SentencePieceProcessor) -> frozenset[str]:
    """Words that stand for one token when a space (or the start of the text) precedes them.

    Raises ValueError for a model whose pieces or normaliser make pre-tokens depend on each other.
    """
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in names):
        raise ValueError("a piece spans two words: pre-tokens can't be counted apart")
    # A leading mark for a text, no folding of spaces, no folding of characters.
    if [model.encode(t, out_type=str) for t in ("a", "a ", "Ａ")][:2] != [[f"{MARK}a"], [f"{MARK}a", MARK]]:
        raise ValueError("the model folds spaces or adds no leading one")
    if model.normalize("Á  Ａ\t­ ") != f"{MARK}Á{MARK}{MARK}Ａ\t­{MARK}":
        raise ValueError("the model normalises characters")
    words = [p[1:] for p in names if p.startswith(MARK) and MARK not in p[1:] and len(p) > 1]
    return frozenset(w for w, ids in zip(words, model.encode(words), strict=True) if len(ids) == 1)


class Counts:
    """Tokens of a pre-token, given without its first space: proven words, then a bounded memo."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor, proven: frozenset[str]):
        self.model, self.proven = model, proven
        self.forget()

    def forget(self) -> None:
        self.known = dict.fromkeys(self.proven, 1) | {"": 1}
        self.held = 0

    def learn(self, words: set[str]) -> None:
        """Merge the words that are neither proven nor remembered, in one call of the library."""
        if self.held > MEMO_CHARS:
            self.forget()
        new = [w for w in words if w not in self.known]
        self.held += sum(map(len, new))
        self.known.update(zip(new, map(len, self.model.encode(new, num_threads=1)), strict=True))


@lru_cache(maxsize=2)
def counts(path: str) -> Counts:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Counts(model, proven_words(model))


PRE_TOKEN = re.compile(" *[^ ]+| +")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first space (the model adds one itself)."""
    if not text:
        return []
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [m[1:] for m in PRE_TOKEN.findall(" " + text)]


def count_texts(texts: list[str], counts: Counts) -> tuple[list[int], list[int]]:
    """Tokens of each text, and how many of its pre-tokens had to be merged."""
    # A literal mark is a space to the model: such a text is one pre-token.
    lists = [[t] if MARK in t else pre_tokens(t) for t in texts]
    counts.learn(set().union(*lists))
    known, proven = counts.known.__getitem__, counts.proven.__contains__
    n = [sum(map(known, words)) for words in lists]
    merged = [len(words) - sum(map(proven, words)) for words in lists]
    return n, merged


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Bytes and tokens of each text: doc_id, n_bytes, n_tokens, n_merged, over_limit.

    A null text counts as empty: no bytes, no tokens. Every row gives a row, repeated ones too; an
    empty table gives none. Other columns are not read. ``n_merged`` tells how many pre-tokens of
    the text needed merging. One narrow pass, no shuffle; ``model_path`` must exist on every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts(model_path)
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, merged = count_texts(texts, known)
            size = [len(t.encode()) for t in texts]
            yield frame_of(
                SCHEMA, {"doc_id": batch.column(0), "n_bytes": size, "n_tokens": n, "n_merged": merged}
            )

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = read.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, n_merged long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
