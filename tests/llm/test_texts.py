"""The operators on single texts: quality, personal data, languages, tokens, mixing."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest
from edge_cases import EDGE, LONG
from pyspark.sql import functions as F

from plumbline.llm import language, mixing, pii, quality, subwords, tagger, tokens
from plumbline.llm.common import held_out
from plumbline.llm.queries import REGISTRY, token_model

SF = "/root/testdata/sf0.001"


def ids(rows):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows)


ALL = sorted((i is not None, i or 0) for i, _, _ in EDGE)


# --- quality


@pytest.fixture(scope="module")
def judge():
    rng = random.Random(1)
    docs = []
    for i in range(120):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(40)]
        bad = i % 3 == 0
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)
        found, n = np.unique(subwords.features([text])[0], return_counts=True)
        docs.append((int(not bad), found, n.astype(np.float32)))
    return subwords.train(docs, [0, 1], np.ones(2, np.float32))


def test_quality_tells_shouting_from_prose(judge):
    good, bad = judge.predict(["abc defg hh cab bead", "CAB!! DEAF!! BAD!! FACE!!"])[:, 1]
    assert good > 0.9 and bad < 0.1


def test_features_do_not_depend_on_the_batch():
    texts = ["a b b", "", "längere Wörter hier", "x"]
    together = subwords.features(texts)
    for k, text in enumerate(texts):
        alone = subwords.features([text])[0]
        assert sorted(alone) == sorted(together[0][together[1] == k])
    assert (subwords.features(["b b"])[0] == subwords.BUCKETS).sum() == 1


def test_features_of_portions_are_those_of_the_whole():
    rng = random.Random(2)
    words = ["a", "bc", "def", "längere", "x" * 50]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\n", "  ", "\t \x00"]) for _ in range(rng.choice([0, 1, 5, 200]))) for _ in range(60)]
    texts += ["", " " * 99, "y" * 99, "a " * 99, " a" * 99, "a" + " " * 99 + "a", *[t.strip() for t in texts]]
    ids, owners = subwords.features(texts)
    for most in (1, 2, 7, 40, 1000, 1 << 17):
        found = [[] for _ in texts]
        for at, part, places in subwords.portions(texts, most):
            for i, place in zip(part, places, strict=True):
                found[range(len(texts))[at][place]].append(i)
        for k in range(len(texts)):
            assert sorted(found[k]) == sorted(ids[owners == k])
    assert list(subwords.portions([])) == []
    long = " ".join(rng.choice(words) for _ in range(40_000))
    for mine, whole in zip(subwords.counted(long), np.unique(subwords.features([long])[0], return_counts=True), strict=True):
        assert (mine == whole).all()


def test_sampled_counts_are_whole_and_small(spark):
    texts = ["ab cd ab", "", "ab " * 300, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = subwords.sample_features(docs, docs.selectExpr("doc_id", "doc_id AS label"))
    for text, (_, i, n) in zip(texts, found, strict=True):
        whole = np.unique(subwords.features([text or ""])[0], return_counts=True)
        assert (i == whole[0]).all() and (n == whole[1]).all()
    assert found[0][2].nbytes == len(found[0][1]) and found[2][2].max() > 255


def test_prediction_holds_few_features_at_once(judge):
    line = "abc defg hh cab bead " * 50
    for texts in ([line] * 4000, [line * 4000]):
        tracemalloc.start()
        found = judge.predict(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        # Before: some 100 bytes for each of 4.2 million characters.
        assert peak < 40 << 20
        assert np.allclose(found, judge.predict([line]), atol=1e-3)


def test_quality_cases(edge, none, judge):
    rows = quality.score_quality(edge, judge).collect()
    assert ids(rows) == ALL
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[1] == by[2]
    assert quality.score_quality(none, judge).count() == 0
    kept = quality.drop_poor(edge, judge)
    assert kept.columns == edge.columns
    assert kept.count() == sum(r["predicted"] for r in rows)


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([1, 1], 1.0), ([0], 0.0)])
def test_quality_with_few_labels(spark, edge, labels, score):
    table = spark.createDataFrame([(4, v) for v in labels], "doc_id long, quality int")
    table = table.withColumn("doc_id", F.lit(5).cast("long"))
    model = quality.quality_model(edge, table)
    assert {r["score"] for r in quality.score_quality(edge, model).collect()} == {score}


def test_quality_held_out_accuracy(spark):
    larger = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    found = REGISTRY["op1_quality"](spark, larger).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in found]) > 0.9


# --- personal data

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            digits = pii.digits_of(m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == "card" and 13 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0)
                or (kind == "phone" and 9 <= len(digits) <= 15)
            ):
                out.append((kind, *m.span()))
    return out


def test_base_spans_against_the_plain_patterns():
    rng = random.Random(2)
    bits = ["a", "b", "@", ".", "1", "25", "+", "-", " ", "(", "_", "é", "1.2", "9999", "4111111111111111", "\n"]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 20)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("9" * 50_000 + "a@b.c" + "a" * 50_000) == [("email", 0, 100_005)]


def test_tagger_gradient():
    rng = np.random.default_rng(0)
    model = tagger.Tagger.fresh(0)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rows, tags = rng.integers(0, 40, (2, 6)), np.zeros((2, 6), int)
    tags[0, 2:4], tags[1, 5] = (1, 2), 3
    _, g = model.gradients(rows, tags)
    for name, at in (("out", (3, 1)), ("next", (0, 1)), ("xf", (2, 5)), ("hb", (1, 7)), ("embed", (int(rows[0, 3]), 2))):
        old, loss = model.p[name][at], []
        for step in (1e-4, -1e-4):
            model.p[name][at] = old + step
            loss.append(model.gradients(rows, tags)[0])
        model.p[name][at] = old
        assert abs((loss[0] - loss[1]) / 2e-4 - g[name][at]) < 1e-4


@pytest.fixture(scope="module")
def finder():
    return tagger.train(pii.made_up())


def test_tagger_adds_what_the_patterns_lose(finder):
    text = "call thern +1 (269) 555-3296 4524132264652876 onren and so on"
    base = pii.base_spans(text)
    added = pii.added_spans([text], [base], finder)[0]
    assert base == [] and ("card", 29, 45) in added
    plain = "the version 2.0 of 2024-01-15 costs 12.50 and has 3000 lines"
    assert pii.added_spans([plain], [[]], finder) == [[]]


def test_windows_cover_every_place():
    text = "x" * 500 + "1234" * 100 + "y" * 300 + "@" + "z" * 10
    windows = pii.window_starts(text)
    covered = {i for s, e in windows for i in range(s, e)}
    assert {i for i, c in enumerate(text) if c in "1234@"} <= covered
    assert all(e - s <= tagger.WINDOW for s, e in windows) and pii.window_starts("no places") == []


def test_pii_cases(edge, none, finder):
    rows = pii.find_pii(edge, finder).collect()
    assert ids(rows) == ALL
    by = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in rows}
    assert by[1] == by[2] == by[7] == [] and by[-8] == [("email", 5, 13), ("ip", 17, 25)]
    assert pii.find_pii(none, finder).count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(edge, finder).collect()}
    assert clean[-8] == "mail [EMAIL] or [IP] now" and clean[1] is None and clean[7] == LONG


def test_pii_counts_are_those_of_the_patterns(spark, finder, tmp_path, monkeypatch):
    texts = ["call (415) 555-2671 now", "mail bob [at] site [dot] org or a@b.org, +49 170 555 2671", "host 10.0.0.1 and 10 . 0 . 0 . 2", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr("plumbline.llm.queries.pii_model", lambda docs: finder)
    rows = REGISTRY["op2_pii"](spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) and sum(r["n_added"] for r in rows) > 0
    for r in rows:
        base = brute_spans(texts[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(kind == k for kind, *_ in base) for k in PATTERNS]
        assert r["base_sha256"] == hashlib.sha256(",".join("%s:%d:%d" % s for s in base).encode()).hexdigest()


# --- languages


def test_cross_parsing_against_a_plain_parse():
    known = (("a", "the cat sat on the mat"), ("b", "der hund und die katze saß"))
    parser = language.Parser(known)
    rng = random.Random(3)
    plain = lambda t: "".join(chr(65 + s) for s in language.symbols(t, parser.symbol).tolist())
    for _ in range(500):
        text = "".join(rng.choice("the catsonmdruk ßxé1.") for _ in range(rng.randint(0, 40)))
        stream, counts = plain(text), parser.phrases([text])[2][0]
        for k, (_, labelled) in enumerate(known):
            n, i, source = 0, 0, plain(labelled)
            while i < len(stream):
                j = i + 1
                while j < len(stream) and stream[i : j + 1] in source:
                    j += 1
                i, n = j, n + 1
            assert counts[k] == n


# First and last code point of the letters of twelve scripts.
SCRIPTS = {
    "en": (0x61, 0x7A), "el": (0x3B1, 0x3C9), "ru": (0x430, 0x44F), "he": (0x5D0, 0x5EA), "ar": (0x620, 0x64A),
    "ka": (0x10D0, 0x10F0), "th": (0xE01, 0xE2E), "zh": (0x4E00, 0x55FF), "hy": (0x561, 0x586), "ko": (0xAC00, 0xB3FF),
    "hi": (0x904, 0x939), "am": (0x1200, 0x1357),
}


def test_every_script_has_its_letters():
    rng = random.Random(5)
    known, held = [], []
    for lang, (low, high) in sorted(SCRIPTS.items()):
        alphabet = [chr(c) for c in range(low, high + 1) if chr(c).isalpha()]
        words = ["".join(rng.choices(alphabet, k=rng.randint(2, 7))) for _ in range(600)]
        known.append((lang, " ".join(rng.choices(words, k=3000))))
        held += [(lang, " ".join(rng.choices(words, k=12))) for _ in range(50)]
    parser = language.Parser(tuple(known))
    found = parser.predict([text for _, text in held])[0]
    for lang in SCRIPTS:
        right = sum(f == lang for f, (wanted, _) in zip(found, held, strict=True) if wanted == lang)
        assert right >= 48, lang


def test_spellings_are_apart():
    text = "".join(chr(c) for c in range(0x4E00, 0x5600)) + "abc"
    table = language.symbol_table([text])
    spelled = {tuple(table[ord(c)].tolist()) for c in text}
    assert len(spelled) == len(text) and tuple(table[ord("ж")].tolist()) not in spelled


def test_stretches_do_not_change_the_language():
    """Ending phrases every few symbols chooses as one unbroken parse does."""
    rng = random.Random(8)
    words = {k: ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(80)] for k in "xyz"}
    parser = language.Parser(tuple((k, " ".join(rng.choices(w, k=2000))) for k, w in words.items()))
    texts = [" ".join(rng.choices(words[k], k=n)) for k in "xyz" for n in (3, 40, 90, 400, 3000)]
    assert max(map(len, texts)) < 30_000
    broken, whole = (parser.phrases(texts, stretch)[2] * parser.bits for stretch in (language.STRETCH, 30_000))
    assert (broken.argmin(axis=1) == whole.argmin(axis=1)).all()


def test_language_cases(edge, none):
    rows = language.predict_language(edge, [("de", EDGE[6][1]), ("en", EDGE[4][1])]).collect()
    assert ids(rows) == ALL
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows if r["doc_id"] not in (None, 5)}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert sorted(r["lang_pred"] for r in rows if r["doc_id"] == 5) == ["de", "en", "en"]
    assert language.predict_language(none, []).count() == 0
    assert {r["lang_pred"] for r in language.predict_language(edge, []).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = REGISTRY["op4_language"](spark, SF).where("held_out").join(truth, "doc_id").where("lang IS NOT NULL").collect()
    assert rows and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


# --- tokens


def test_token_counts_against_the_library():
    counts = tokens.counts(token_model())
    rng = random.Random(4)
    bits = [*"ab  \n\t.é\x00<s>▁　漢🙂", "the", "  ", " of", "Hello"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(8000)] + ["", " ", LONG[:5000], "x" * 3000]
    assert tokens.count_texts(texts, counts)[0] == [len(t) for t in counts.model.encode(texts)]
    assert all(len(counts.model.encode(w)) == 1 for w in list(counts.proven)[:2000])


def test_token_cases(edge, none):
    rows = tokens.token_counts(edge, token_model()).collect()
    assert ids(rows) == ALL
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == by[1]["n_bytes"] == 0
    assert by[7]["over_limit"] and by[7]["n_bytes"] == len(LONG) and not by[4]["over_limit"]
    assert tokens.token_counts(none, token_model()).count() == 0


# --- mixing


def test_rates_reach_the_targets(spark):
    rng = np.random.default_rng(5)
    share = rng.dirichlet([0.3, 0.3, 0.3], 400)
    size = rng.integers(1, 500, 400)
    known = spark.createDataFrame([(int(t), p.tolist()) for t, p in zip(size, share, strict=True)], "tokens long, posterior array<double>")
    target = np.array([0.6, 0.3, 0.1])
    gradients, step, reached = mixing.fitted(known.repartition(4), target, rounds=200)
    rate = mixing.rates(share, gradients, step)[0]
    assert (rate >= 0).all() and np.allclose((size * rate) @ share / size.sum(), target, atol=2e-4) and np.allclose(reached, target, atol=2e-4)


def test_rates_stay_nonnegative_and_least_squares(spark):
    # One pure domain can't be lowered by others: its documents get rate 0.
    known = spark.createDataFrame([(10, [1.0, 0.0]), (10, [0.0, 1.0])], "tokens long, posterior array<double>")
    gradients, step, _ = mixing.fitted(known, np.array([1.0, 0.0]))
    rate = mixing.rates(np.eye(2), gradients, step)[0]
    assert np.allclose(rate, [2, 0], atol=1e-3)


@pytest.mark.parametrize("tokens", [(900, 60, 30, 10), (989, 5, 5, 1), (400, 200, 399, 1)])
def test_rates_reach_the_targets_with_rare_domains(spark, tokens):
    """A domain of a thousandth of the tokens gets its share with the production rounds."""
    known = [(n, [0.985 if k == i else 0.005 for k in range(4)]) for i, n in enumerate(tokens)]
    target = np.array([0.4, 0.2, 0.2, 0.2])
    gradients, step, reached = mixing.fitted(spark.createDataFrame(known, "tokens long, posterior array<double>"), target)
    share, size = np.array([p for _, p in known]), np.array(tokens)
    rate = mixing.rates(share, gradients, step)[0]
    assert (rate >= 0).all() and np.allclose((size * rate) @ share / size.sum(), target, atol=mixing.NEAR)
    assert np.allclose(reached, target, atol=mixing.NEAR)


def test_unmet_targets_are_met_as_nearly_as_possible_and_reported(spark):
    known = spark.createDataFrame([(10, [0.6, 0.4]), (10, [0.7, 0.3])], "tokens long, posterior array<double>")
    model = subwords.Model(["a", "b"], np.zeros((1, 2)), np.zeros(2))
    with pytest.warns(UserWarning, match="not met"):
        found = mixing.fit_mixture(known, model, {"a": 0.1, "b": 0.9})
    # Only documents of the first kind: r with the least (.6 r - .1)**2 + (.4 r - .9)**2.
    r = (0.06 + 0.36) / (0.36 + 0.16)
    assert np.allclose(found.reached, [0.6 * r, 0.4 * r], atol=1e-4)
    assert np.allclose(found.rates(np.array([[0.6, 0.4], [0.7, 0.3]])), [2 * r, 0], atol=1e-3)


def test_reached_shares_are_returned(edge):
    rows = mixing.mixing_rates(edge, mixing.domain_model(edge), {"en": 0.5, "de": 0.5}).collect()
    for domain, reached in rows[0]["reached"].items():
        used = sum(r["rate"] * r["tokens"] * r["posterior"][domain] for r in rows) / sum(r["tokens"] for r in rows)
        assert abs(used - reached) < 1e-6


def test_mixing_cases(edge, none, spark):
    model = mixing.domain_model(edge)
    rows = mixing.mixing_rates(edge, model, {"en": 0.5, "de": 0.5}).collect()
    assert ids(rows) == ALL and all(r["rate"] >= 0 and abs(r["copies"] - r["rate"]) < 1 for r in rows)
    assert {r["tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.mixing_rates(none, model, {}).count() == 0
    unlabelled = edge.withColumn("lang", F.lit(None).cast("string"))
    assert {r["rate"] for r in mixing.mixing_rates(unlabelled, mixing.domain_model(unlabelled), {}).collect()} == {1.0}
    plain = edge.select("doc_id", "text", "lang")
    assert mixing.with_rates(plain, model, {"en": 1.0}).columns == ["doc_id", "text", "lang", "domain", "rate", "copies"]
    clashing = plain.withColumn("domain", F.lit("x")).withColumn("rate", F.lit(1)).withColumn("Copies", F.lit(None).cast("string"))
    rated = mixing.with_rates(clashing, model, {"en": 1.0})
    assert rated.columns == ["doc_id", "text", "lang", "domain", "rate", "copies"] and rated.where("domain = 'x'").count() == 0


def test_held_out_fold(spark):
    import zlib

    rows = spark.range(200).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("out")).collect()
    assert all(r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
