"""Personal data in texts: exact patterns, and spans added by a character tagger.

The patterns (``base_spans``) are fixed. A bidirectional LSTM with a CRF (see ``tagger``) adds the
spans that look alike but are written otherwise: spaced or bracketed addresses, telephone numbers
without a plus. It looks at every place that could hold one: the characters around each digit, ``@``
or bracketed "at". Such places are cut into overlapping windows, each window is decoded, and the
spans of all windows of a text are reconciled: base spans stay, of the others those that more
windows found win, then the longer, then the earlier, as long as nothing overlaps. An added span
must also be well formed (digits, Luhn sum, parts), so ordinary numbers are left alone.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_texts, pieces
from plumbline.llm.tagger import KINDS, STRIDE, WINDOW, Tagger, classes, spans_of, train

Span = tuple[str, int, int]

# The patterns of the contract.
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_REST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Places the tagger looks at, and the characters around each.
PLACE = re.compile(r"[0-9@]|[\[(]at[\])]")
AROUND = 24
#: Documents looked at for labelled windows (about), and windows taken from them and made up.
SAMPLE_DOCS, SAMPLE_WINDOWS, MADE_WINDOWS = 2000, 1000, 2000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def small(part: str) -> bool:
    """At most 255, whatever its leading zeros."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """The leftmost pattern starts where the run of local characters before an ``@`` does."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_PART:
            start -= 1
        found = EMAIL_REST.match(text, at) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            done = found.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", done)
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind as listed and then by start."""
    out = emails(text)
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if 13 <= len(digits := digits_of(m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def well_formed(kind: str, text: str) -> bool:
    """Whether a span that the tagger proposes can be one of its kind."""
    digits = digits_of(text)
    if kind == "email":
        return bool(re.fullmatch(r"[\w.%+-]+ ?(@|[\[(]at[\])]) ?[\w-]+( ?(\.|[\[(]dot[\])]) ?[\w-]+)+", text, re.ASCII))
    if kind == "ip":
        parts = re.split(r"\D+", text)
        return len(parts) == 4 and all(p and small(p) for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    groups = re.findall("[0-9]+", text)
    return 9 <= len(digits) <= 15 and len(groups) >= 3 and max(map(len, groups)) <= 5


def window_starts(text: str) -> list[tuple[int, int]]:
    """(start, end) of the windows over every place that could hold a span."""
    regions: list[list[int]] = []
    for m in PLACE.finditer(text):
        start, end = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if regions and start <= regions[-1][1]:
            regions[-1][1] = end
        else:
            regions.append([start, end])
    out = []
    for start, end in regions:
        while True:
            out.append((start, min(end, start + WINDOW)))
            if start + WINDOW >= end:
                break
            start += STRIDE
    return out


def added_spans(texts: list[str], base: list[list[Span]], model: Tagger) -> list[list[Span]]:
    """Per text the spans that the tagger adds to the base ones."""
    places = [(d, *w) for d, text in enumerate(texts) for w in window_starts(text)]
    votes: list[Counter] = [Counter() for _ in texts]
    for i in range(0, len(places), 512):
        part = places[i : i + 512]
        rows = np.zeros((len(part), WINDOW), np.int64)
        for r, (d, start, end) in enumerate(part):
            rows[r, : end - start] = classes(texts[d][start:end])
        for (d, start, end), tags in zip(part, model.decode(rows), strict=True):
            for kind, a, b in spans_of(tags):
                if start + b <= end:
                    votes[d][(KINDS[kind], start + a, start + b)] += 1
    out = []
    for text, known, found in zip(texts, base, votes, strict=True):
        taken = sorted((s, e) for _, s, e in known)
        new: list[Span] = []
        for kind, start, end in sorted(found, key=lambda s: (-found[s], s[1] - s[2], s[1], s[0])):
            if all(end <= s or e <= start for s, e in taken) and well_formed(kind, text[start:end]):
                new.append((kind, start, end))
                taken.append((start, end))
        out.append(new)
    return out


def made_up(seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Windows of random words around written-out variants of each kind, and around other numbers."""
    rng = random.Random(seed)
    word = lambda low=2, high=9: "".join(rng.choice("aeioutnshrdlcmpéüñ") for _ in range(rng.randint(low, high)))
    plain = lambda low=2, high=9: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(low, high)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def email():
        name = plain() + rng.choice(["", f".{plain()}", number(2), f".{number(2)}"])
        at = rng.choice(["@", "@", " @ ", " [at] ", "[at]", " (at) "])
        dot = rng.choice([".", ".", " . ", "[dot]", " (dot) "]) if at != "@" else "."
        return name + at + dot.join([plain(), *[plain() for _ in range(rng.randint(0, 1))], rng.choice(["com", "org", "net", "de"])])

    def ip():
        return rng.choice([".", ".", ".", " . ", "-"]).join(str(rng.randint(0, 255)) for _ in range(4))

    def card():
        mark = rng.choice(["", " ", "-", "."])
        return mark.join(number(4) for _ in range(4))

    def phone():
        a, b, c = number(3), number(3), number(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"+{number(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{number(2)} {a} {b}{c[:2]}", f"{a}.{b}.{c}"])

    def other():
        return rng.choice([
            f"version {number(1)}.{number(1)}", f"{number(4)}-{number(2)}-{number(2)}", number(rng.randint(1, 9)), f"{number(2)}:{number(2)}",
            f"{number(1)}.{number(2)} %", f"AK{number(1)}{word().upper()}{number(3)}", f'token = "{number(4)}{plain()}{number(9)}"', f"password={plain()}{number(5)}", f"@{plain()}",
        ])

    makers = {"email": email, "ip": ip, "card": card, "phone": phone, "other": other}
    out = []
    for _ in range(MADE_WINDOWS):
        before = " ".join(word() for _ in range(rng.randint(0, 6)))
        text, spans = before[-AROUND:] + rng.choice([" ", " ", "\n", ": "]) if before else "", []
        for _ in range(rng.choice([1, 1, 1, 2])):  # two may follow each other
            kind = rng.choice(list(makers))
            value = makers[kind]()
            if len(text) + len(value) < WINDOW:
                spans += [(kind, len(text), len(text) + len(value))] * (kind != "other")
                text += value + rng.choice([" ", " ", " ", ". ", ", ", "\n"])
        out.append(((text + " ".join(word() for _ in range(rng.randint(0, 6))))[:WINDOW].rstrip(), spans))
    return out


def labelled_windows(docs: DataFrame) -> list[tuple[str, list[Span]]]:
    """Windows of a bounded sample of documents, labelled by the base patterns."""
    n = docs.count()
    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // SAMPLE_DOCS))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for text in batch.column(0).to_pylist():
                known = base_spans(text)
                for start, end in window_starts(text):
                    whole = [s for s in known if start <= s[1] and s[2] <= end]
                    cut = [s for s in known if s[1] < end and start < s[2] and s not in whole]
                    # Long numbers that no pattern accepts may be personal data or not: no label.
                    rest = len(digits_of(text[start:end])) - sum(len(digits_of(text[a:b])) for _, a, b in whole)
                    if not cut and rest < 9:
                        rows.append({"text": text[start:end], "spans": ",".join(f"{k}:{a - start}:{b - start}" for k, a, b in whole)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("text", pa.string()), ("spans", pa.string())]))

    found = part.where("text IS NOT NULL").select(F.col("text").cast("string")).mapInArrow(run, "text string, spans string")
    rows = found.orderBy(F.xxhash64("text"), "text").limit(SAMPLE_WINDOWS).collect()
    split = lambda s: [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in s.split(",") if x)]
    return [(r["text"], split(r["spans"])) for r in rows]


def pii_model(docs: DataFrame) -> Tagger:
    return train(made_up() + labelled_windows(docs))


FOUND = "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>"


def find_pii(docs: DataFrame, model: Tagger) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, base or added) of every text.

    Spans come by kind (email, ip, card, phone), then start. A null or empty text has none. Every row
    gives a row, repeated ids too; an empty table gives none. One narrow pass over whole texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            spans = [
                sorted([(KINDS.index(k), s, e, True) for k, s, e in b] + [(KINDS.index(k), s, e, False) for k, s, e in a])
                for b, a in zip(base, added_spans(texts, base, shared.value), strict=True)
            ]
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in row] for row in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND)


def redacted(docs: DataFrame, model: Tagger, column: str = "text") -> DataFrame:
    """The documents with every found span of the text replaced by its kind in brackets.

    All columns stay; of overlapping spans the one that starts first is replaced and the next goes
    on behind it. Null texts stay null. ``docs`` may have any further columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def change(whole: list[str | None]) -> tuple[list, None]:
        texts = [t or "" for t in whole]
        base = [base_spans(t) for t in texts]
        out = []
        for text, known, new in zip(whole, base, added_spans(texts, base, shared.value), strict=True):
            parts, done = [], 0
            for start, end, kind in sorted((s, e, k) for k, s, e in known + new):
                if end > done:
                    parts += [text[done : max(start, done)], f"[{kind.upper()}]"]
                    done = end
            out.append("".join(parts) + text[done:] if parts else text)
        return out, None

    return map_texts(docs, change, column)
