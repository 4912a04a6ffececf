"""The operators over tables: near duplicates, decontamination, fingerprints, pages, revisits, pipeline."""

import hashlib
import random
import re
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from edge_cases import EDGE, LONG
from pyspark.sql import functions as F

from plumbline.llm import decontamination, html, neardup, queries, revisits, winnowing
from plumbline.llm.components import connected_components
from plumbline.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"


def components_of(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randint(0, 80), 100 + rng.randint(0, 80)) for _ in range(60)]
    edges = [e for e in edges if e[0] != e[1]]
    found = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == components_of({n for e in edges for n in e}, edges)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- near duplicates


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_groups(texts):
    sets = {i: shingle_set(t) for i, t in texts}
    ids = sorted(sets)
    edges = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                edges.append((a, b))
    return components_of(ids, edges), {i: len(s) for i, s in sets.items()}


def test_near_duplicates_against_all_pairs(spark):
    """A group of near copies larger than a bucket where all meet, chains, copies, and short texts."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(150)]
    texts = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            words[rng.randrange(150)] = word()
        texts.append((i, " ".join(words)))
    chain = [word() for _ in range(120)]
    for i in range(90, 100):
        chain = [*chain[4:], *[word() for _ in range(4)]]
        texts.append((i, " ".join(chain)))
    texts += [(100 + i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))) for i in range(60)]
    texts += [(200 + i, texts[i][1].upper()) for i in range(0, 100, 7)]
    groups, sizes = brute_groups(texts)
    rows = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == groups
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.85, 1.0):
        errors = []
        for _ in range(60):
            pool = np.unique(rng.integers(0, 1 << 63, 600, dtype=np.uint64) * np.uint64(2))
            n = len(pool)
            cut = int(n * (1 - share) / 2)
            a, b = pool[: n - cut], pool[cut:]
            shuffled = [np.sort(x * np.uint64(0x9E3779B97F4A7C15)) for x in (a, b)]
            regs = [neardup.registers(x)[None, :] for x in shuffled]
            sizes = np.array([len(a)])
            errors.append(neardup.estimate(*regs, sizes, sizes)[0] - (n - 2 * cut) / n)
        assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.2


def test_near_duplicate_cases(edge, none):
    rows = neardup.near_duplicates(edge).collect()
    assert len(rows) == len(EDGE)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == by[2] == [(0, 1, True)] or by[2] == [(0, 2, True)]
    assert by[4] == [(1, 4, True)] and by[7] == [(5, 7, True)]
    assert sorted(by[5]) == [(7, 5, True), (8, 5, True), (8, 5, True)]
    # The German text has id 5 and no id; the row without an id belongs to 5.
    assert sorted(by[None], key=str) == [(0, None, True), (7, 5, False)]
    assert neardup.near_duplicates(none).count() == 0


# --- decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(docs, items, window):
    wanted = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            wanted[tuple(words[i : i + window])].add(str(item))
    out = []
    for doc, text in docs:
        words = words_of(text)
        hit, found = set(), set()
        for run, names in wanted.items():
            for i in range(len(words) - len(run) + 1):
                if tuple(words[i : i + len(run)]) == run:
                    hit.update(range(i, i + len(run)))
                    found |= names
        out.append((doc, len(words), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination_against_brute_force(spark, block_bytes):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["a", "B", "c", "d-e", "é", "x1"]) for _ in range(rng.randint(0, n)))
    items = [(i, text(9)) for i in range(12)] + [(3, "a b c"), (90, None), (91, "!!"), (92, "漢字 é")]
    docs = [(i, text(60)) for i in range(80)] + [(100, None), (101, ""), (102, "漢字, É 漢字 é")]
    found = decontamination.contamination(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
        spark.createDataFrame(items, "item_id long, text string"),
        window=4,
        block_bytes=block_bytes,
    ).collect()
    got = sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found], key=str)
    assert got == brute_hits(docs, items, 4)
    assert all(r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in found)
    assert all(r["n_near_items"] >= r["n_items"] for r in found)


def test_contamination_cases(edge, none, spark):
    items = spark.createDataFrame([(1, "fox jumps over"), (None, "im haus")], "item_id long, text string")
    rows = decontamination.contamination(edge, items).collect()
    assert len(rows) == len(EDGE)
    assert sorted(r["items"] for r in rows if r["doc_id"] == 5) == [["1"], ["1"], ["null"]]
    assert decontamination.contamination(none, items).count() == 0
    empty = decontamination.contamination(edge, items.where("false")).collect()
    assert {r["n_hit"] for r in empty} == {0} and {r["n_words"] for r in empty if r["doc_id"] == 7} == {len(LONG.split())}


# --- fingerprints


def test_edited_texts_and_order(spark):
    docs = [(i * 37 % 101 - 50, f"text {i} " * (i % 9)) for i in range(101)]
    by = dict(docs)
    order = sorted(by, reverse=True)
    follows = {d: by[order[(k + 1) % len(order)]] for k, d in enumerate(order)}
    for row in winnowing.fingerprints(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect():
        text, third = by[row["doc_id"]], len(by[row["doc_id"]]) // 3
        edited = text[: len(text) - third] + follows[row["doc_id"]][:third]
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and row["n_chars"] == len(text)


def test_buckets_keep_the_order(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "BUCKET_ROWS", 1)
    docs = [(i * i * 7 - 5000, f"t{i} ") for i in range(400)] + [(None, "no id"), (None, "none")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("text_hash", F.xxhash64("text"))
    assert rows.withColumn("b", winnowing.buckets(rows)).select("b").distinct().count() > 100
    found = {r["text"]: r["next_text"] for r in winnowing.with_next(rows, ["text"]).collect()}
    hashes = {r["text"]: r["text_hash"] for r in rows.collect()}
    order = sorted((t for i, t in docs if i is not None), key=lambda t: -int(t[1:]) ** 2)
    lost = [t for i, t in docs if i is None]
    at = {a: b for a, b in zip(order, order[1:], strict=False)}
    assert {k: v for k, v in found.items() if k in at} == at
    assert found[order[-1]] in lost and len(found) == len(docs) and hashes


def test_winnowing_guarantee_and_ties(spark):
    """Every window of hashes has its least one selected, the rightmost of equal ones."""
    rng = random.Random(5)
    shared = " ".join(f"w{rng.randint(0, 999)}" for _ in range(winnowing.GRAM + winnowing.WINDOW - 1))
    pad = lambda n: " ".join(f"p{rng.randint(0, 10**6)}" for _ in range(n))
    texts = [(f"{pad(50)} {shared} {pad(60)}", f"{pad(45)} {shared} {pad(70)}") for _ in range(30)]
    rows = spark.createDataFrame([(a, b, "same " * 60) for a, b in texts], "a string, b string, c string")
    rows = rows.select(winnowing.fingerprint("a").alias("x"), winnowing.fingerprint("b").alias("y"), winnowing.fingerprint("c").alias("z"))
    for row in rows.collect():
        assert {v >> 24 for v in row["x"]} & {v >> 24 for v in row["y"]}
        places = [winnowing.PLACES - (v & winnowing.PLACES) for v in row["z"]]
        assert places == list(range(winnowing.WINDOW - 1, 60 - winnowing.GRAM + 1))


def test_texts_on_either_side_of_few_words_are_alike(spark):
    rng = random.Random(6)
    docs = []
    for i in range(0, 60, 2):
        words = [f"w{rng.randint(0, 999)}" for _ in range(41)]
        docs += [(i + 1, " ".join(words)), (i, " ".join(words[:39]))]
    found = {r["doc_id"]: r for r in winnowing.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    hashes = lambda i: {x.split("@")[0] for x in found[i]["fingerprint"].split(",")}
    likes = [found[i]["near_next"] for i in range(1, 60, 2)]
    assert min(likes) > 0.4 and np.mean(likes) > 0.8
    assert all(len(hashes(i)) > 3 * len(hashes(i + 1)) for i in range(0, 60, 2))


def test_fingerprint_cases(edge, none):
    rows = winnowing.fingerprints(edge).collect()
    assert len(rows) == len(EDGE) and winnowing.fingerprints(none).count() == 0
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)} == {""}
    lone = winnowing.fingerprints(edge.where("doc_id = 4")).collect()
    assert lone[0]["near_next"] == 1.0


# --- pages

PAGES = {
    "": "",
    "<p>a<p>b": "a\nb",
    "<div>x</div><nav>n</nav><ul><li>1<li>2</ul>t": "x\n1\n2\nt",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a\nb\nc",
    "<p>a < b &lt;i&gt; &amp; c": "a < b <i> & c",
    "<article><h1>T</h1><p>a&nbsp; b<br>c</p><div class=comments>no</div><form>f</form></article><aside>s</aside>": "T\na b c",
    '<script>if(a<b){"</p>"}</script><style>p{}</style>t<!-- no -->u': "tu",
    "<p>un<b>fin": "unfin",
    "<p>x</p><p": "x",
    '<a title="x>y">k</a>': "k",
    "</p></div>stray": "stray",
    "<div class='ad'>buy</div><p>text</p>": "text",
    "<p hidden>no</p><p>yes &#233; &eacute;</p>": "yes é é",
    "<td>" * 500 + "deep": "deep",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html.main_text(page) == PAGES[page]


REPEATED = "<p>" + "Others have measured this before. " * 8 + "</p>"
OVERRULED = {
    "<div class='page with-sidebar'><article><h2>T</h2><p>Story.</p></article><div class=sidebar>Side</div></div>": "T\nStory.",
    "<nav>Home</nav><div id=content class='social-history'><p>The mills closed.</p><div class=ad>Buy!</div></div>": "The mills closed.",
    "<form id=aspnetForm><div class=menu>Home</div><article><p>Council met.</p></article></form>": "Council met.",
    "<article class='comment-piece'><h1>Op</h1><p>I think so.</p></article>": "Op\nI think so.",
    "<div class=with-sidebar><form><article><p>Twice.</p></article></form></div>": "Twice.",
    "<form>" * 300 + "<article>deep</article>": "deep",
    # What names say stays true of comments, adverts, lists of links and consent.
    "<article><p>Short.</p></article><section id=comments><article class=comment><p>" + "No. " * 99 + "</p></article></section>": "Short.",
    "<article><p>Short.</p><div class='comments-area'>" + REPEATED + "</div><div class='ad-box'>" + REPEATED + "</div></article>": "Short.",
    "<article><p>Short.</p><div class='related-posts'><a href=x>" + "Another post. " * 30 + "</a></div></article>": "Short.",
    "<div class='cookie-notice'><p>We use cookies.</p></div>": "",
}


@pytest.mark.parametrize("page", OVERRULED, ids=range(len(OVERRULED)))
def test_what_a_branch_holds_overrules_its_names(page):
    assert html.main_text(page) == OVERRULED[page]


def test_related_work_stays_in_its_article():
    page = f"<article><p>Intro.</p><section class='related-work'><h2>Related work</h2>{REPEATED}</section></article>"
    assert html.main_text(page).startswith("Intro.\nRelated work\nOthers have")


def test_site_style_tree_cuts_what_all_pages_repeat(spark):
    page = lambda i: f"<body><div class=top>The same words</div><div class=text><h1>T{i}</h1><p>body {i}</p></div><div>Copyright</div></body>"
    rows = [(i, f"http://www.x.org/{i}", page(i)) for i in range(8)] + [(9, "http://y.org/", page(9)), (10, None, None)]
    # Articles that repeat are the author's, however often.
    rows += [(20 + i, f"http://z.org/{i}", "<body><div>menu</div><article><p>copy</p></article></body>") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("cut", F.lit(1))
    found = {r["page_id"]: r["text"] for r in html.extract_text(pages).collect()}
    assert all(found[i] == f"T{i}\nbody {i}" for i in range(8))
    assert found[9] == "The same words\nT9\nbody 9\nCopyright" and found[10] == ""
    assert {found[20 + i] for i in range(8)} == {"copy"} and len(found) == len(rows)
    assert html.extract_text(pages.where("false")).count() == 0


def test_site_style_tree_decides_inside_and_beside_articles(spark):
    """Articles that differ lose what they all repeat, but not their title; what differs beside them stays."""
    tip = "<div class=tip>Read our letter</div>"
    page = lambda i: f"<body><div class=lead>Lead {i}</div><div class=top>Top</div><article><h1>T</h1><p>body {i}</p>{tip}</article></body>"
    rows = [(i, f"http://a.org/{i}", page(i)) for i in range(60)]
    # Copies, beside some articles that differ and on few pages, are no evidence.
    copy = f"<body><article><h1>T</h1><p>copy</p>{tip}</article></body>"
    rows += [(100 + i, f"http://b.org/{i}", copy) for i in range(60)]
    rows += [(200 + i, f"http://c.org/{i}", page(i)) for i in range(4)]
    found = {r["page_id"]: r["text"] for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == f"Lead {i}\nT\nbody {i}" for i in range(60))
    assert {found[100 + i] for i in range(60)} == {"T\ncopy\nRead our letter"}
    assert all(found[200 + i] == f"T\nbody {i}\nRead our letter" for i in range(4))


# --- revisits


def test_captures_exercise_the_as_of_join(spark):
    """Several responses of a URL, ties, revisits before and beside the first one, and a URL with a third of all captures."""
    pages = spark.createDataFrame([(i, f"http://h{i}.org/p", f"<p>{i}") for i in range(64)] + [(64, None, None)], "page_id long, url string, html string")
    made = queries.captures(pages)
    found = revisits.resolve_revisits(made)
    by_kind = {r["resolution"]: r["count"] for r in found.groupBy("resolution").count().collect()}
    assert set(by_kind) == {"full", "resolved", "unverified", "mismatch", "missing"} and sum(by_kind.values()) == made.count()
    portal = found.where("canonical_url = 'portal.example/'")
    assert 0.3 < portal.count() / made.count() < 0.4
    got = {r["record_id"]: r["from_record_id"] for r in found.where("kind = 'revisit'").collect()}
    assert got[2 * 16 + 3] == 2 * 16 + 2  # the greater of two ids in one second
    assert got[6 * 16 + 6] is None and got[5 * 16 + 4] is None and got[5 * 16 + 5] == 5 * 16
    assert got[1 * 16 + 8] == 2 * 16 + 7 and got[0 * 16 + 8] is None  # another page's response
    assert queries.captures(pages.where("false")).count() == 0


def test_revisit_cases(spark):
    row = lambda i, kind, url, at, headers, digest=None: (i, kind, url, at, headers, digest)
    rows = [
        row(1, "response", "http://www.A.org:80/p?b=2&a=1#f", "2024-01-01 00:00:00", {"etag": '"1"', "content-type": "t", "date": "d1"}, "x"),
        row(2, "revisit", "https://a.org/p?a=1&b=2&utm_source=z", "2024-01-09 00:00:00", {"etag": 'W/"1"', "content-type": "no", "date": "d2"}),
        row(3, "revisit", "http://a.org/p?a=1&b=2", "2024-01-01 00:00:00", {"etag": '"1"'}),
        row(4, "response", "http://a.org/p?a=1&b=2", "2024-02-01 00:00:00", {"etag": '"2"'}, "y"),
        row(5, "revisit", "http://a.org/p?a=1&b=2", "2024-02-01 00:00:01", {"etag": '"1"'}),
        row(6, "revisit", "http://a.org/p?a=1&b=2", "2024-02-01 00:00:02", {}),
        row(7, "revisit", None, "2024-02-01 00:00:00", {"etag": '"1"'}),
        row(8, "revisit", "http://a.org/p?a=1&b=2", None, None),
        row(9, "revisit", "http://other.org", "2024-02-01 00:00:00", None),
    ]
    schema = "record_id long, kind string, url string, at string, headers map<string,string>, payload_digest string"
    table = spark.createDataFrame(rows, schema).withColumn("captured_at", F.to_timestamp("at")).withColumn("day", F.lit("x"))
    found = {r["record_id"]: r for r in revisits.resolve_revisits(table).collect()}
    kinds = {i: r["resolution"] for i, r in found.items()}
    assert kinds == {1: "full", 2: "resolved", 3: "missing", 4: "full", 5: "mismatch", 6: "unverified", 7: "missing", 8: "missing", 9: "missing"}
    assert found[2]["headers"] == {"etag": 'W/"1"', "content-type": "t", "date": "d2"} and found[2]["payload_digest"] == "x"
    assert found[6]["from_record_id"] == 4 and found[5]["from_record_id"] is None
    assert revisits.resolve_revisits(table.where("false")).count() == 0


# --- pipeline


def test_pipeline_stages_against_brute_force(spark):
    """Each stage keeps the documents that a plain version of its rule keeps of what it was given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        docs = corpus_pipeline.landed(out, name)
        after = {r["doc_id"]: r for r in docs.collect()}
        assert len(after) == docs.count()
        if name == "quality":
            known = [i for i in before if i in labels]
            assert np.mean([(i in after) == (labels[i] == 1) for i in known]) > 0.9
        elif name == "near_dedup":
            groups, _ = brute_groups([(i, r["text"]) for i, r in before.items()])
            assert set(after) == {i for i in before if groups[i] == i}
        elif name == "decontamination":
            hits = brute_hits([(i, r["text"]) for i, r in before.items()], items, 13)
            assert set(after) == {i for i, n, hit, _ in hits if not (hit and 20 * hit >= n)}
        elif name == "pii":
            from plumbline.llm.pii import base_spans

            assert set(after) == set(before)
            assert not any(base_spans(r["text"]) for r in after.values())
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        if name == "mixing":
            assert set(after) == set(before) and docs.columns == [*corpus_pipeline.COLUMNS, "domain", "rate", "copies"]
        else:
            assert docs.columns == corpus_pipeline.COLUMNS


def test_pipeline_cases(edge, none, spark):
    for rows in (edge, none):
        docs = rows.withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast("long"))
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.landed(stage(spark, docs, SF), name)
        assert docs.count() <= rows.count()


def test_pipeline_keeps_each_text_of_a_repeated_id(edge, spark):
    """Judged by id and text, not by id alone: texts that differ don't go with one another."""
    plain = lambda docs: docs.withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast("long"))
    texts = lambda docs: sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, plain(docs), SF).collect())
    english, german = EDGE[4][1], EDGE[6][1]
    assert texts(edge.where("doc_id = 5 OR doc_id IS NULL AND text IS NOT NULL")) == [(5, german), (5, english)]
    rows = [(3, english, "en"), (9, english, "en"), (9, german, "de"), (9, german, "de"), (9, "", "de"), (9, "", "de")]
    assert texts(spark.createDataFrame(rows, edge.select("doc_id", "text", "lang").schema)) == [(3, english), (9, ""), (9, german)]
    # Every text of the edge rows leaves one document; those without words leave one per id.
    words = {r[1] for r in EDGE if r[1] and r[1].split()}
    left = [r["text"] for r in corpus_pipeline.near_dedup(spark, plain(edge), SF).collect()]
    assert sorted(t for t in left if t and t.split()) == sorted(words)


def test_registry_has_all_thirteen():
    assert sorted(int(re.match("op([0-9]+)_", n)[1]) for n in REGISTRY) == list(range(1, 14))
