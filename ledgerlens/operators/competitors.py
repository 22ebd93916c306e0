"""Competitor pricing: price comparison (M1, inferred producer), price
position (M2, M5), promotion rates (M3, M4) and assortment overlap (U1/M6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import guarded_ratio


def price_comparison(our_sales: DataFrame, competitors: DataFrame) -> DataFrame:
    """M1: per product name, our unit price (sum gross / sum quantity), the
    mean competitor price and ``price_difference = ours - theirs`` (negative
    = we undercut). Both sides are aggregated before the inner join, so the
    join sees one row per product name on each side."""
    ours = (our_sales.where(F.col("productname").isNotNull()).groupBy("productname")
            .agg(F.sum("grossvalue").alias("_g"), F.sum("quantity").alias("_q")))
    ours = ours.select("productname",
                       (F.col("_g").cast("double") / F.when(F.col("_q") != 0, F.col("_q").cast("double")))
                       .alias("our_price"))
    theirs = (competitors.where(F.col("productname").isNotNull()).groupBy("productname")
              .agg((F.sum("price").cast("double") / F.when(F.count("price") > 0, F.count("price").cast("double")))
                   .alias("avg_competitor_price")))
    j = ours.join(theirs, "productname", "inner")
    return j.select("productname", "our_price", "avg_competitor_price",
                    (F.col("our_price") - F.col("avg_competitor_price")).alias("price_difference"))


def price_position(comparison: DataFrame) -> DataFrame:
    """M2 + M5: products we undercut (< 0), products dearer (> 0), and the
    parity-line bound (largest own price). Zero is in neither count."""
    return comparison.agg(
        F.count_if(F.col("price_difference") < 0).cast("bigint").alias("products_cheaper"),
        F.count_if(F.col("price_difference") > 0).cast("bigint").alias("products_pricier"),
        F.max("our_price").alias("max_our_price"),
    )


def promo_rate(competitors: DataFrame) -> DataFrame:
    """M3: share of competitor price rows on promotion, in %."""
    return competitors.agg(
        guarded_ratio(F.count_if(F.col("onpromotion")), F.count(F.lit(1)), 100.0, when_zero=None)
        .alias("promo_rate"))


def promo_by_competitor(competitors: DataFrame) -> DataFrame:
    """M4: promotion share per competitor, in %; null if none of its rows says."""
    return (competitors.where(F.col("competitor").isNotNull()).groupBy("competitor")
            .agg(guarded_ratio(F.count_if(F.col("onpromotion")), F.count("onpromotion"), 100.0, when_zero=None)
                 .alias("promo_rate")))


def assortment_overlap(our_sales: DataFrame, competitors: DataFrame, rival_a: str, rival_b: str) -> DataFrame:
    """The seven disjoint regions of the three product-name sets (ours,
    rival A, rival B), every region listed, 0 when empty.

    One tagged union, one ``groupBy(productname)`` (partial aggregation on
    each input before the exchange), then one aggregate row unpivoted to the
    seven regions - no driver-side sets, no join.
    """
    ours = our_sales.select("productname", F.lit(True).alias("o"), F.lit(False).alias("a"), F.lit(False).alias("b"))
    comp = competitors.where(F.col("competitor").isin(rival_a, rival_b)).select(
        "productname", F.lit(False).alias("o"),
        (F.col("competitor") == rival_a).alias("a"), (F.col("competitor") == rival_b).alias("b"))
    names = (ours.unionByName(comp).where(F.col("productname").isNotNull()).groupBy("productname")
             .agg(F.bool_or("o").alias("o"), F.bool_or("a").alias("a"), F.bool_or("b").alias("b")))
    o, a, b = F.col("o"), F.col("a"), F.col("b")
    regions = [
        ("Ours Only", o & ~a & ~b),
        (f"{rival_a} Only", a & ~o & ~b),
        (f"{rival_b} Only", b & ~o & ~a),
        (f"Ours & {rival_a}", o & a & ~b),
        (f"Ours & {rival_b}", o & b & ~a),
        (f"{rival_a} & {rival_b}", a & b & ~o),
        ("All Three", o & a & b),
    ]
    agg = names.agg(*[F.count_if(cond).cast("bigint").alias(f"_r{i}") for i, (_, cond) in enumerate(regions)])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(label).alias("region"),
                              F.col(f"_r{i}").alias("products")) for i, (label, _) in enumerate(regions)])
    return agg.select(F.inline(rows))
