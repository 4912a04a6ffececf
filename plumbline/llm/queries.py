"""The registered queries of the text operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.alignment import align_texts
from plumbline.llm.common import landed, table
from plumbline.llm.decontamination import contamination
from plumbline.llm.filter_audit import filter_audit
from plumbline.llm.html import extract_text
from plumbline.llm.language import identify_language
from plumbline.llm.mixing import domain_model, mixing_rates
from plumbline.llm.neardup import near_duplicates
from plumbline.llm.packing import pack
from plumbline.llm.pii import find_pii, pii_model
from plumbline.llm.quality import quality_model, score_quality
from plumbline.llm.revisits import resolve_revisits
from plumbline.llm.tagger import KINDS
from plumbline.llm.tokens import token_counts
from plumbline.llm.winnowing import fingerprints

#: Names of the model files; their folder is that of the public tokenizer package.
TOKEN_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"


def token_model(name: str = TOKEN_MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, quality_model(docs, table(spark, sf_dir, "labels")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_pii(docs, pii_model(docs))
    # The contract's counts are those of the fixed patterns; what the tagger adds is in spans and n_added.
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(listed(F.filter("spans", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
        "n_near_items",
    )


#: Target share of tokens by language; the sources carry no trace in the texts, languages do.
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing_rates(docs, domain_model(docs), TARGETS)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), token_model())


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


#: The URL that gets a third of all captures made from pages.
PORTAL = "http://www.portal.example/"
DAY = 86400


def captures(pages: DataFrame) -> DataFrame:
    """Web captures made from the pages.

    Every page has a response, half of them a changed one two days later, an eighth another one at the
    same second. Revisits ask for other spellings of the URL: before the first response, in the same second,
    on the same day and after all responses. All pages give a response and a revisit of one portal page too,
    whose latest response is another page's. By page the validators agree, agree weakly, are those of an
    earlier response, or are absent.
    """
    text = F.coalesce("html", F.lit(""))
    page = pages.select(
        "page_id",
        "url",
        F.md5(text).alias("digest"),
        F.md5(F.concat(text, F.lit("#2"))).alias("later"),
        F.coalesce(F.octet_length("html"), F.lit(0)).cast("string").alias("length"),
        F.pmod("page_id", F.lit(8)).alias("part"),
        F.concat(F.lit("day "), F.pmod("page_id", F.lit(7)).cast("string")).alias("day"),
    )
    quoted = lambda digest: F.concat(F.lit('"'), F.left(digest, F.lit(16)), F.lit('"'))
    tag, changed, part, day = quoted("digest"), quoted("later"), F.col("part"), F.col("day")

    def record(number: int, kind: str, url: Column, after: int, headers: list[tuple[str, Column]], digest: Column) -> Column:
        return F.struct(
            (F.col("page_id") * 16 + number).alias("record_id"),
            F.lit(kind).alias("kind"),
            url.alias("url"),
            F.timestamp_seconds(F.col("page_id") * 600 + after).alias("captured_at"),
            F.map_filter(F.create_map(*[x for k, v in headers for x in (F.lit(k), v)]), lambda k, v: v.isNotNull()).alias("headers"),
            digest.alias("payload_digest"),
        )

    def response(number: int, url: Column, after: int, etag: Column, dated: Column, digest: Column) -> Column:
        lines = [("content-type", F.lit("text/html")), ("content-length", F.col("length")), ("etag", etag), ("last-modified", dated)]
        return record(number, "response", url, after, [*lines, ("server", F.lit("one"))], digest)

    none = F.lit(None).cast("string")

    def revisit(number: int, url: Column, after: int, etag: Column = none, dated: Column = none, digest: Column = none) -> Column:
        age = F.concat(F.lit("max-age="), part.cast("string"))
        lines = [("content-length", F.lit("0")), ("etag", etag), ("last-modified", dated), ("cache-control", age)]
        return record(number, "revisit", url, after, lines, digest)

    url = F.col("url")
    spelled = (
        F.when(part % 3 == 0, F.concat("url", F.lit("#again")))
        .when(part % 3 == 1, F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit("utm_medium=feed")))
        .otherwise(F.regexp_replace("url", "^http://", "HTTPS://"))
    )
    last = F.when(part == 0, changed).when(part == 1, F.concat(F.lit("W/"), tag)).when(part == 2, F.lit('"twin"')).when(part == 6, tag)
    late = F.concat(day, F.lit(" later"))
    records = [
        response(0, url, 0, tag, day, F.col("digest")),
        F.when(part % 2 == 0, response(1, url, 2 * DAY, changed, late, F.col("later"))),
        F.when(part == 2, response(2, url, 2 * DAY, F.lit('"twin"'), late, F.col("later"))),
        revisit(3, spelled, 3 * DAY + 7, last, F.when(part == 3, day), F.when(part == 4, F.col("digest"))),
        F.when(part == 5, revisit(4, spelled, -3600, tag)),
        F.when(part % 4 == 1, revisit(5, spelled, 60, tag)),
        F.when(part == 6, revisit(6, spelled, 0, tag)),
        response(7, F.lit(PORTAL), 5, tag, day, F.col("digest")),
        revisit(8, F.lit("https://portal.example/#top"), 905, F.when(part % 4 == 0, tag)),
    ]
    made = page.select(F.explode(F.filter(F.array(*records), lambda r: r.isNotNull())).alias("r"))
    return made.select("r.*")


def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(landed(captures(table(spark, sf_dir, "pages")), "captures"))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.select(
        "record_id",
        "kind",
        "canonical_url",
        "resolution",
        "from_record_id",
        F.array_join(lines, ";").alias("header_lines"),
        "payload_digest",
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_texts(table(spark, sf_dir, "documents"), token_model(BYTE_MODEL), token_model())


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), token_model(BYTE_MODEL))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


REGISTRY = {
    "op1_quality": op1_quality,
    "op2_pii": op2_pii,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_language": op4_language,
    "op5_decontamination": op5_decontamination,
    "op6_mixing": op6_mixing,
    "op7_token_counts": op7_token_counts,
    "op8_fingerprints": op8_fingerprints,
    "op9_main_text": op9_main_text,
    "op10_revisits": op10_revisits,
    "op11_alignment": op11_alignment,
    "op12_packing": op12_packing,
    "op13_filter_audit": op13_filter_audit,
}
