"""Alignment of two tokenizers, packing and the filter audit, each against a plain version."""

import hashlib
import random
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from edge_cases import EDGE
from tokenizers import Tokenizer

from plumbline.llm import filter_audit, packing
from plumbline.llm.alignment import align_texts
from plumbline.llm.encoders import BytePairs, Pieces, packed, unpacked
from plumbline.llm.queries import REGISTRY

BYTE, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
PARTS = [" ", "  ", "\n", "\t", "a", "bc", "'s", "12", "!?", "é", "漢", "<|endoftext|>", "▁", "\x1c", "🙂", " ", "\xa0", "</s>", "<0x41>"]
ODD = ["", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "don't  stop\t\tnow 12 3", "é ß 漢字 \x00 e", "▁ a", "﻿ a", "x" * 300]


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    return ODD + ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14))) for _ in range(1500)]


def byte_model(plain):
    model = Tokenizer.from_file(BYTE)
    model.encode_special_tokens = plain
    return model


@pytest.mark.parametrize("plain, spaced", [(False, False), (True, True)])
def test_units_encode_as_whole_texts(odd, plain, spaced):
    model = byte_model(plain)
    whole = [packed(model.encode(" " * spaced + t, add_special_tokens=False).ids) for t in odd]
    mine = BytePairs(BYTE, plain)
    assert mine.ids(odd, spaced) == whole
    assert mine.ids(odd, spaced) == whole  # now from the memo


def test_pieces_encode_as_whole_texts(odd):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert Pieces(PIECE).ids(odd) == [packed(model.encode(t)) for t in odd]


# --- alignment


def plain_alignment(rows):
    """The contract, text by text, with dicts and loops."""
    a_model, b_model = byte_model(True), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a_bytes, b_bytes = BytePairs(BYTE, True).token_bytes(), Pieces(PIECE).token_bytes()
    found, counts = [], Counter()
    for doc_id, text in rows:
        a = a_model.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_model.encode(text or "")
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            found.append((doc_id, 0, 0, [], []))
            continue
        ends_b, at = {}, 0
        for j, i in enumerate(b):
            at += len(b_bytes[i])
            ends_b[at] = j
        groups, links, at, i0, j0 = [], [], 0, 0, 0
        for i, x in enumerate(a):
            at += len(a_bytes[x])
            if at in ends_b:
                j = ends_b[at]
                groups.append((a[i0 : i + 1], b[j0 : j + 1]))
                links.append((x, b[j]))
                i0, j0 = i + 1, j + 1
        counts.update(links)
        found.append((doc_id, len(a), len(b), groups, links))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    listed = lambda ids: ",".join(map(str, ids))
    out = []
    for doc_id, n_a, n_b, groups, links in found:
        line = ";".join(f"{listed(x)}|{listed(y)}" for x, y in groups)
        sha = hashlib.sha256(line.encode()).hexdigest() if links else ""
        best = sum(counts[p] == most[p[1]] for p in links)
        out.append((doc_id, n_a, n_b, len(groups), len(links), best, sum(counts[p] for p in links), sha))
    return sorted(out, key=str)


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("common, frequent", [(100_000, 1000), (30, 3), (1, 1)])
def test_alignment_against_a_plain_version(spark, odd, common, frequent):
    """A text that a third of the rows share; pairs and texts on either side of the two bounds."""
    rng = random.Random(5)
    words = "the of and Haus schläft 2024 don't naïve 漢字 internationalization end. (x) ".split()
    texts = odd[:200] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(100)]
    rows = [(i, t) for i, t in enumerate(texts + ["one text, many times over"] * 150 + [None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = align_texts(docs, BYTE, PIECE, common, frequent)
    assert found.columns == ALIGNED
    assert sorted(map(tuple, found.collect()), key=str) == plain_alignment(rows)


def test_alignment_cases(edge, none):
    found = align_texts(edge, BYTE, PIECE)
    assert sorted(map(tuple, found.collect()), key=str) == plain_alignment([(i, t) for i, t, _ in EDGE])
    assert align_texts(none, BYTE, PIECE).count() == 0


# --- packing


def histogram(lengths):
    return dict(Counter(int(x) for x in lengths))


def contents(plan, counts):
    """Which lengths each sequence holds and where, as the plan says."""
    held = defaultdict(list)
    for k, length in enumerate(plan["length"]):
        last = k + 1 == len(plan["length"]) or plan["length"][k + 1] != length
        for rank in range(plan["first"][k], counts[length] if last else plan["first"][k + 1]):
            along, again = divmod(rank - plan["first"][k], plan["each"][k])
            held[plan["sequence"][k] + along].append((plan["offset"][k] + again * length, length))
    return held


RNG = np.random.default_rng(1)


@pytest.mark.parametrize(
    "lengths, most",
    [
        (RNG.integers(1, 1025, 30_000), 1.01),
        (RNG.integers(300, 700, 30_000), 1.02),
        (np.clip(RNG.lognormal(5.5, 1, 30_000), 1, 1024).astype(int), 1.01),
        (RNG.integers(1, 200, 30_000), 1.001),
        ([1] * 5000, 1.05),
        ([512] * 3 + [1], 1.3),
        ([1024] * 5, 1),
        ([], 1),
    ],
)
def test_plan_is_gapless_and_tight(lengths, most):
    counts = histogram(lengths)
    held = contents(packing.packing_plan(counts, 1024), counts)
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(held) == list(range(len(held)))
    assert histogram(x for places in held.values() for _, x in places) == counts
    assert len(held) <= most * -(-sum(lengths) // 1024)


def test_plan_does_not_grow_with_the_documents():
    few, many = (packing.packing_plan(dict.fromkeys(range(1, 1025), n), 1024) for n in (10**3, 10**10))
    assert len(many["length"]) < 2 * len(few["length"]) < 20_000


def test_groups_have_equal_cardinality_and_programme_is_feasible():
    runs = [(900, 5), (800, 1), (700, 7), (400, 3)]
    # Four groups of four; two with the same largest length are rounded to one size.
    assert packing.grouped(runs, 4) == [[(900, 4), (900, 1), (800, 1), (700, 2)], [(700, 4), (700, 1), (400, 3)]]
    assert [sum(n for _, n in g) for g in packing.grouped([(900, 4), (800, 4), (700, 4)], 3)] == [4, 4, 4]
    sizes, demands = np.array([350, 400, 500, 600, 650]), np.array([10.0, 10, 10, 10, 10])
    columns, amounts = packing.configurations(sizes, demands, 1024)
    assert np.allclose(columns @ amounts, demands) and (sizes @ columns <= 1024).all()
    assert amounts.sum() == pytest.approx(25)


def check_packing(rows, found):
    model = byte_model(False)
    expected = Counter()
    for doc_id, text in rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter(tuple(r[:5]) for r in found) == expected
    held = defaultdict(list)
    for r in found:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return held


def test_packing_against_the_library(spark, odd, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 40)
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["the", "Haus", "x1", "naïve"]) for _ in range(rng.choice([3, 60, 500, 900, 2600])))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate(odd[:300])] + [(5000 + i, None) for i in range(200)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), BYTE).collect()
    held = check_packing(rows, found)
    plain = []  # first fit, longest first
    for length in sorted((r["length"] for r in found), reverse=True):
        at = next((k for k, room in enumerate(plain) if room >= length), len(plain))
        plain[at:] = [*([1024] if at == len(plain) else []), *plain[at:]]
        plain[at] -= length
    assert len(held) <= 1.01 * len(plain) + 1


def test_packing_cases(edge, none):
    check_packing([(i, t) for i, t, _ in EDGE], packing.pack(edge, BYTE).collect())
    assert packing.pack(none, BYTE).count() == 0


# --- filter audit


def test_gallop_and_unions_against_sets():
    rng = random.Random(11)
    for _ in range(300):
        lists = [sorted(rng.sample(range(60), rng.randint(0, 40))) for _ in range(5)]
        assert filter_audit.union_size(lists) == len(set().union(*lists))
        assert filter_audit.common(*lists[:2]) == sorted(set(lists[0]) & set(lists[1]))
        if lists[2]:
            start, target = rng.randrange(len(lists[2])), rng.randint(-1, 61)
            assert filter_audit.gallop(lists[2], target, start) == max(start, bisect_left(lists[2], target))


def plain_audit(docs, labels):
    """Every chain applied document by document."""
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    good, toxic = ({d for d, q in labels if q[k] == 1} for k in (0, 1))
    by_part = defaultdict(list)
    for doc_id, text, lang in docs:
        text = text or ""
        words = text.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
        words = [w for w in words if w]
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
            fails.add("C")
        if set(text) & set("#$%&*|"):
            fails.add("D")
        if doc_id is not None and first[text] < doc_id:
            fails.add("E")
        by_part[lang or ""].append((doc_id, fails))
    rows = []
    for part, members in by_part.items():
        removed_ever, steps = Counter(), []
        for order in permutations("ABCDE"):
            left = members
            for step, letter in enumerate(order, 1):
                lost = [m for m in left if letter in m[1]]
                left = [m for m in left if letter not in m[1]]
                failing = sum(letter in m[1] for m in members)
                alone = sum(m[1] == {letter} for m in members)
                marks = [sum(m[0] in s for m in lost) for s in (good, toxic)]
                removed_ever[letter] += len(lost)
                steps.append(("".join(order), step, len(left), len(lost), failing - len(lost), alone, *marks, letter))
        rows += [(part, *s[:-1], removed_ever[s[-1]]) for s in steps]
    return sorted(rows)


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("range_rows", [3, 1 << 15])
def test_audit_against_every_chain(spark, monkeypatch, range_rows):
    monkeypatch.setattr(filter_audit, "RANGE_ROWS", range_rows)
    rng = random.Random(13)
    text = lambda: " ".join(rng.choice(["a", "B", "c d", "E#", "ef", "gh" + str(rng.randint(0, 400))]) for _ in range(rng.choice([5, 150, 260])))
    docs = [(i * 7, text(), rng.choice(["en", "de", None, ""])) for i in range(150)]
    docs += [(2000 + i, docs[i % 9][1], "en") for i in range(60)]
    docs += [(14, "again", "en"), (14, "again", "en"), (None, docs[0][1], "de"), (None, docs[0][1], "de"), (-5, docs[0][1], "fr")]
    labels = [(rng.randint(0, 2100), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(900)] + [(None, 1, 1)]
    found = filter_audit.filter_audit(
        spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4), spark.createDataFrame(labels, LABELS)
    )
    marked = [(d, (q, t)) for d, q, t in labels if d is not None]
    assert sorted(map(tuple, found.collect())) == plain_audit(docs, marked)


def test_audit_cases(spark, edge, none):
    empty = spark.createDataFrame([], LABELS)
    assert sorted(map(tuple, filter_audit.filter_audit(edge, empty).collect())) == plain_audit(EDGE, [])
    assert filter_audit.filter_audit(none, empty).count() == 0


def test_new_operators_are_registered():
    assert {"op11_alignment", "op12_packing", "op13_filter_audit"} <= set(REGISTRY)


def test_packed_round_trip():
    assert unpacked(packed([1, 50256, 0])).tolist() == [1, 50256, 0]
