"""Order statistics in pieces equal those of percentile."""

from pyspark.sql import functions as F

from plumbline.operators import order_stats

SHARES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def plain(df, by):
    stats = [F.percentile("x", share).alias(name) for name, share in SHARES.items()]
    quartiles = df.where("x IS NOT NULL AND NOT isnan(x)").groupBy(*by).agg(F.count("x").alias("n"), *stats)
    if not by:
        middle = quartiles.head()["median"]
        mad = df.where("x IS NOT NULL AND NOT isnan(x)").agg(F.percentile(F.abs(F.col("x") - middle), 0.5)).head()[0]
        return {(): (*quartiles.head(), mad)}
    out = {}
    for r in quartiles.collect():
        same = df.where(F.col(by[0]).eqNullSafe(F.lit(r[0]))).where("x IS NOT NULL AND NOT isnan(x)")
        mad = same.agg(F.percentile(F.abs(F.col("x") - r["median"]), 0.5)).head()[0]
        out[r[:1]] = (*r[1:], mad)
    return out


def series(spark, n=60_000):
    """One series with most of the values, a short one, one of a single value, one without a name, ties, gaps."""
    i = F.col("id")
    name = F.when(i % 100 == 0, "short").when(i == 1, "single").when(i % 1000 == 7, None).otherwise("long")
    x = F.when(i % 5 == 0, F.lit(1.5)).when(i % 777 == 3, None).when(i % 778 == 3, F.lit(float("nan"))).otherwise(F.pmod(F.xxhash64("id"), F.lit(10**9)) / 7.0 - 5e7)
    return spark.range(0, n, 1, 4).select(name.alias("se`ries"), x.alias("x"))


def test_quartiles_and_mad_of_many_series(spark):
    df = series(spark).withColumnRenamed("se`ries", "s")
    found = {tuple(r)[:1]: tuple(r)[1:] for r in order_stats.robust_profile(df, ["s"], "x").collect()}
    assert found == plain(df, ["s"])


def test_one_series_and_odd_names(spark):
    df = series(spark, 5000)
    found = order_stats.robust_profile(df, [], "x").collect()
    assert {(): tuple(found[0])} == plain(df, [])
    assert order_stats.robust_profile(df, ["se`ries"], "x").columns == ["se`ries", "n", "q1", "median", "q3", "mad"]


def test_a_long_series_lies_in_many_pieces(spark, monkeypatch):
    stored = []
    cut = order_stats.cut_lineage
    monkeypatch.setattr(order_stats, "cut_lineage", lambda df: stored.append(cut(df)) or stored[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = order_stats.value_counts(series(spark, 20_000), ["se`ries"], "x")
        order_stats.order_statistics(counts, ["se`ries"], SHARES).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in stored[0].groupBy("_piece").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 0.3 * sum(sizes)


def test_no_values(spark):
    empty = spark.createDataFrame([("a", None)], "s string, x double")
    assert order_stats.robust_profile(empty, ["s"], "x").count() == 0
