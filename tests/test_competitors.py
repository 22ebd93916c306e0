from decimal import Decimal

import pytest

from ledgerlens.operators import competitors as CP

OURS = "productname string, grossvalue decimal(18,2), quantity int"
COMP = "competitor string, productname string, price decimal(10,2), onpromotion boolean"


def test_overlap_regions_disjoint_and_complete(spark):
    ours = spark.createDataFrame([("all", Decimal(1), 1), ("mine", Decimal(1), 1), ("oa", Decimal(1), 1)], OURS)
    comp = spark.createDataFrame([("A", "all", Decimal(1), True), ("B", "all", Decimal(1), False),
                                  ("A", "oa", Decimal(1), False), ("B", "theirs", Decimal(1), False),
                                  ("Z", "other", Decimal(1), True)], COMP)
    got = [tuple(r) for r in CP.assortment_overlap(ours, comp, "A", "B").collect()]
    assert got == [(1, "Ours Only", 1), (2, "A Only", 0), (3, "B Only", 1), (4, "Ours & A", 1),
                   (5, "Ours & B", 0), (6, "A & B", 0), (7, "All Three", 1)]
    assert sum(r[2] for r in got) == 4  # size of the union


def test_price_comparison_sign_and_position(spark):
    ours = spark.createDataFrame([("x", Decimal("20"), 2), ("y", Decimal("30"), 1), ("z", Decimal("5"), 1)], OURS)
    comp = spark.createDataFrame([("A", "x", Decimal("12"), True), ("B", "x", Decimal("14"), False),
                                  ("A", "y", Decimal("20"), False), ("A", "z", Decimal("5"), False)], COMP)
    cmp_ = {r.productname: r.price_difference for r in CP.price_comparison(ours, comp).collect()}
    assert cmp_ == {"x": -3.0, "y": 10.0, "z": 0.0}
    pos = CP.price_position(CP.price_comparison(ours, comp)).first()
    assert (pos.products_cheaper, pos.products_pricier, pos.max_our_price) == (1, 1, 30.0)
    assert CP.promo_rate(comp).first().promo_rate == 25.0
    promo = {r.competitor: r.promo_rate for r in CP.promo_by_competitor(comp).collect()}
    assert promo == {"A": pytest.approx(100 / 3), "B": 0.0}
