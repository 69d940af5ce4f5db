"""Hand-made cases of customer analysis, answer scoring, formulas and tail probabilities."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.functions import answers as A
from millrace.functions import distributions as P
from millrace.functions import finance as N
from millrace.operators import cohorts as C

ORDERS = "order_id string, customer_id string, order_status string, order_purchase_timestamp string, order_delivered_customer_date string, order_estimated_delivery_date string"


def buys(spark, rows):
    return spark.createDataFrame(rows, "customer_unique_id string, order_id string, purchase_ts timestamp_ntz, delivered_ts timestamp_ntz, estimated_delivery_ts timestamp_ntz, paid_value decimal(24,2)")


def test_delivered_orders_need_a_purchase_and_a_person_only(spark):
    o = spark.createDataFrame([("a", "c", "delivered", "2018-01-01 00:00:00", "", ""), ("b", "c", "delivered", "", "2018-01-02 00:00:00", ""), ("d", "x", "delivered", "2018-01-01 00:00:00", "", ""), ("e", "c", "shipped", "2018-01-01 00:00:00", "", "")], ORDERS)
    c = spark.createDataFrame([("c", "u"), ("x", None)], "customer_id string, customer_unique_id string")
    rows = C.delivered_orders(o, c).collect()
    assert [(r.order_id, r.delivered_ts) for r in rows] == [("a", None)]
    value = C.order_value(spark.createDataFrame([("a", ""), ("z", "1.50"), ("z", "2.00")], "order_id string, payment_value string"))
    assert {r.order_id: r.paid_value for r in value.collect()} == {"a": None, "z": Decimal("3.50")}
    assert C.customer_orders(C.delivered_orders(o, c), value).first().paid_value == 0


def test_identifier_effect_by_population(spark):
    rows = spark.createDataFrame([("o1", "c1", "u"), ("o2", "c2", "u"), ("o3", "c3", None)], "order_id string, customer_id string, customer_unique_id string")
    got = {(r.population, r.identifier): (r.n_customers, r.n_repeat, r.repeat_rate) for r in C.identifier_effect({"all": rows, "some": rows.where("order_id = 'o1'")}, {"id": "customer_id", "person": "customer_unique_id"}).collect()}
    assert got == {("all", "id"): (3, 0, 0.0), ("all", "person"): (2, 1, 0.5), ("some", "id"): (1, 0, 0.0), ("some", "person"): (1, 0, 0.0)}


def test_survival_takes_at_least_a_day(spark):
    t = lambda d, h=0: datetime(2018, 1, d, h)
    b = buys(spark, [("u", "o1", t(1), None, None, None), ("u", "o2", t(1, 5), None, None, None), ("u", "o3", t(9), None, None, None), ("v", "o4", t(11), None, None, None), ("w", "o5", t(2), None, None, None)])
    got = {r.customer: (r.duration_days, r.event) for r in C.survival_input(b, "customer_unique_id", "order_id", "purchase_ts").collect()}
    assert got == {"u": (1, True), "v": (1, False), "w": (9, False)}
    curve = C.kaplan_meier(spark.createDataFrame([(1, True), (3, False), (5, True), (9, False)], "d int, e boolean"), "d", "e")
    assert [(r.day, r.survival) for r in curve.orderBy("day").collect()] == [(1, 0.75), (5, 0.375)]
    s = C.survival_summary(curve, [0, 4, 90]).first()
    assert (s.survival_0, s.survival_4, s.survival_90, s.median_day) == (1.0, 0.75, 0.375, 5)


def test_rfm_scores_by_frequency(spark):
    t = lambda d: datetime(2018, 1, d)
    one, two, nine = map(Decimal, (1, 2, 9))
    b = buys(spark, [("a", "1", t(1), None, None, one), ("b", "2", t(2), None, None, two), ("b", "3", t(3), None, None, two), ("c", "4", t(4), None, None, nine)])
    got = {r.customer: (r.recency_days, r.f_score, r.code) for r in C.rfm(b, "customer_unique_id", "order_id", "purchase_ts", "paid_value").collect()}
    assert got == {"a": (4, 1, "111"), "b": (2, 5, "252"), "c": (1, 1, "313")}


def test_first_order_experience(spark):
    t = lambda d: datetime(2018, 1, d)
    b = buys(spark, [("a", "1", t(1), t(9), t(5), None), ("a", "2", t(2), t(3), t(5), None), ("b", "3", t(1), None, t(5), None), ("b", "4", t(2), t(3), t(5), None), ("c", "5", t(1), t(2), t(5), None)])
    reviews = spark.createDataFrame([("1", "4"), ("1", "1"), ("1", ""), ("5", None)], "order_id string, review_score string")
    got = {r.customer_unique_id: (r.repurchased, r.review_score, r.delivery_delayed) for r in C.first_order_experience(b, reviews).collect()}
    assert got == {"a": (True, 2.5, True), "c": (False, None, False)}


def test_category_by_summed_value(spark):
    orders = spark.createDataFrame([("u", 1, 5), ("u", 2, 6), ("v", 3, 5)], "customer string, order int, ts int")
    items = spark.createDataFrame([(1, "p", 6.0), (1, "q", 4.0), (1, "r", 4.0), (2, "p", 9.0), (3, "s", 1.0)], "order int, product string, price double")
    products = spark.createDataFrame([("p", "x"), ("q", "y"), ("r", "y"), ("s", None)], "product string, category string")
    names = spark.createDataFrame([("y", "named y")], "category string, name string")
    got = {r.category: (r.customers, r.repeaters) for r in C.category_profile(orders, items, products, names, 1).collect()}
    assert got == {"named y": (1, 1), "unknown": (1, 0)}


def test_months_are_complete_before_the_last(spark):
    m = lambda *n: spark.createDataFrame([(datetime(2018, k, 1).date(), x) for k, x in n], "month date, n bigint")
    assert C.complete_months(m((1, 9), (2, 9), (3, 9)), 5).count() == 0  # the last month has no part in a run
    assert [r.month.month for r in C.complete_months(m((1, 2), (2, 9), (3, 9), (4, 9), (5, 1), (6, 9)), 5).orderBy("month").collect()] == [2, 3, 4, 5]


@pytest.mark.parametrize(
    ("text", "abstains"),
    [("", True), (" \n", True), (None, True), ("Unknown.", True), ("NO_ANSWER", True), ("n/a", True), ("I don't know that.", True), ("The answer is not in the passage", True), ("The passage does not specify the year.", True), ("There is not enough information.", True), ("The text of 1999 doesn't mention it", True), ("Paris", False), ("Not Paris", False), ("The passage names Paris", False)],
)
def test_abstentions(spark, text, abstains):
    assert spark.createDataFrame([(text,)], "x string").select(A.is_abstention(F.col("x"))).first()[0] is abstains


@pytest.mark.parametrize(
    ("text", "refs", "impossible", "em", "f1", "abstained"),
    [
        ("New York", ["New York City", "NYC"], False, 0, 0.8, False),
        ("The U.S. Constitution!", ["US constitution"], False, 1, 1.0, False),
        ("NO_ANSWER", [], True, 1, 1.0, True),
        ("Paris", [], True, 0, 0.0, False),
        ("NO_ANSWER", ["Paris"], False, 0, 0.0, True),
        ("The passage does not specify packet switching's bit rate.", ["10 Mbps"], False, 0, 0.0, True),
        ("The passage does not say they secured the right; it says they petitioned in 1697.", ["1697"], False, 0, None, False),
    ],
)
def test_answer_scores(spark, text, refs, impossible, em, f1, abstained):
    df = spark.createDataFrame([(text, refs, impossible)], "p string, r array<string>, i boolean")
    x = df.select(A.score_answer(F.col("p"), F.col("r"), F.col("i")).alias("x")).first().x
    assert (x.em, x.abstained) == (em, abstained)
    assert x.f1 > 0 if f1 is None else x.f1 == pytest.approx(f1)


@pytest.mark.parametrize(
    ("text", "number"),
    [("work\n#### $1,200", "1200"), ("calculation 4 + 7 = 11", "11"), ("#### 3 then\n#### 0.50", "0.5"), ("no numeric answer", None), ("a1 is 7.", "7"), ("-2", "-2")],
)
def test_numbers(spark, text, number):
    assert spark.createDataFrame([(text,)], "x string").select(A.canonical_number(A.last_number(F.col("x")))).first()[0] == number


@pytest.mark.parametrize(
    ("text", "letter"),
    [("B", "B"), ("Answer: (D).", "D"), ("Answer: C\n", "C"), ("Answer: A because it is the best choice.", "A"), ("Answer: A\nAnswer: C", "C"), ("option b) as said", "B"), ("Because of A", None)],
)
def test_letters(spark, text, letter):
    assert spark.createDataFrame([(text,)], "x string").select(A.option_letter(F.col("x"))).first()[0] == letter


def test_amounts_and_formulas(spark):
    df = spark.createDataFrame([("1,250", "백만원"), (" -1,250 ", "원"), ("", "원"), ("1,25", "원"), ("1e9", "원"), ("1250", "?"), ("1,234,567,890,123,456,789", "원"), ("123456789012345678", "원")], "x string, u string")
    got = [r[0] for r in df.select(A.amount(F.col("x"), A.unit_scale(F.col("u")))).collect()]
    assert got == [1_250_000_000, -1250, None, None, None, None, None, 123456789012345678]
    one = spark.range(1).select(
        N.change_rate(F.lit(100), F.lit(110)), N.change_rate(F.lit(0), F.lit(110)), N.change_rate(F.lit(-5), F.lit(110)), N.price_earnings(F.lit(10**12), F.lit(5 * 10**10)), N.price_earnings(F.lit(-1000), F.lit(50)), N.price_earnings(F.lit(1000), F.lit(-50)),
        N.pair_volatility(F.lit(0.5), F.lit(0.2), F.lit(0.2), F.lit(1.0)), N.pair_volatility(F.lit(0.5), F.lit(0.2), F.lit(0.2), F.lit(-1.0)), N.pair_volatility(F.lit(0.5), F.lit(0.2), F.lit(0.3), F.lit(2.0)),
    ).first()
    assert one[:6] == (10.0, None, None, 20.0, None, None)
    assert one[6] == pytest.approx(0.2) and one[7] == pytest.approx(0, abs=1e-9) and one[8] is None


def test_tail_probabilities(spark):
    # tabulated values
    assert 2 * P.t_tail(2.228, 10) == pytest.approx(0.05, abs=1e-4) and P.t_tail(-1.812, 10) == pytest.approx(0.95, abs=1e-4)
    assert P.upper_gamma(0.5, 3.841 / 2) == pytest.approx(0.05, abs=1e-4) and P.upper_gamma(5, 18.307 / 2) == pytest.approx(0.05, abs=1e-4)
    assert P.t_quantile(0.975, 11) == pytest.approx(2.200985, abs=1e-5) and 2 * P.normal_tail(1.959964) == pytest.approx(0.05, abs=1e-6)
    df = spark.createDataFrame([(2.228, 10.0), (None, 3.0)], "t double, n double")
    got = [r[0] for r in df.select(P.t_two_sided("t", "n")).collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-4) and got[1] is None
