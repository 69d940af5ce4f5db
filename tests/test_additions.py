"""Hand-made cases of cleaning, sampling, inference, recommendation, learned scores, routes and sources."""

import bz2
import random
import time
import tracemalloc
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace import sinks
from millrace.operators import cleaning as C
from millrace.operators import inference as I
from millrace.operators import learners as L
from millrace.operators import policy as P
from millrace.operators import retrieval as R
from millrace.operators import splits as S
from millrace.session import materialise
from millrace.sources import files


def cell(spark, c, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(c.alias("y")).first().y


def test_time_texts(spark):
    x = F.col("x")
    assert cell(spark, C.month_period(x), "Jan-2018") == "2018-01" and cell(spark, C.month_period(x), "2018-01") is None
    stamp = {k: cell(spark, c, "14102100") for k, c in C.hour_stamp(x).items()}
    assert (str(stamp["day"]), stamp["hour"], stamp["weekday"]) == ("2014-10-21", 0, 1)
    assert [cell(spark, c, "14102199") for c in C.hour_stamp(x).values()] == [None] * 3 and cell(spark, C.hour_stamp(x)["day"], None) is None
    assert cell(spark, C.day_fraction(x), "120000") == 0.5
    assert cell(spark, C.finite(x), float("inf"), "double") is None and cell(spark, C.finite(x), float("nan"), "double") is None and cell(spark, C.finite(x), -1.5, "double") == -1.5
    assert cell(spark, C.joined_text(["x", "x"], 5), " ab ") == "ab ab" and cell(spark, C.joined_text(["x"], 5), " ") == ""


def test_columns_and_order(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, float("nan")), (3, "x", 4.0), (4, None, 1.0)], "a int, b string, c double")
    assert [d.columns for d in C.drop_sparse(df, [df], 0.75)] == [["a", "b", "c"]] * 2 and [d.columns for d in C.drop_sparse(df, [df], 0.75, at_threshold=True)] == [["a", "c"]] * 2
    with pytest.raises(ValueError, match="b"):
        C.check_columns(df, {"a", "c"}, {"b"})
    t = spark.createDataFrame([(datetime(2018, 1, 31),), (datetime(2018, 2, 1),)], "t timestamp_ntz")
    assert C.later_only(t.where("day(t) = 31"), t.where("day(t) = 1"), "t").first().passes and not C.later_only(t, t, "t").first().passes


def test_samples(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.choice("abc"), i % 9 == 0) for i in range(300)], "id int, s string, y boolean")
    rows = S.stratified_sample(df, "s", ["id"], 32, F.col("id").isin(7, 8, 9)).collect()
    n = {k: sum(r.s == k for r in rows) for k in "abc"}
    assert n == {"a": 11, "b": 11, "c": 10} and {7, 8, 9} <= {r.id for r in rows}
    half = S.balanced_sample(df, "y", ["id"]).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in half} == {True: 34, False: 34}
    assert {r["count"] for r in S.balanced_sample(df, "y", ["id"], 20).groupBy("y").count().collect()} == {10}
    held = S.stratified_holdout(df, ["s"], ["id"], 0.25)
    assert {(r.s, r.n) for r in held.where("part = 'test'").groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()} == {(r.s, int(r.n * 0.25 + 0.5)) for r in df.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert [r.id for r in S.slice_in_order(df, [F.col("id").desc()], 2, 3).orderBy("id").collect()] == [295, 296, 297]
    with pytest.raises(ValueError):
        S.day_list_split(df, F.col("s"), {"train": ["a", "c"], "test": ["b"]})
    assert S.stratified_sample(df.limit(0), "s", ["id"], 5, F.lit(False)).count() == 0 and S.balanced_sample(df.limit(0), "y", ["id"]).count() == 0


def test_bootstrap_covers_the_mean(spark):
    rng = random.Random(3)
    values = [rng.gauss(0.2, 1) for _ in range(500)]
    df = spark.createDataFrame([(i, v, "g") for i, v in enumerate(values)], "id int, v double, g string")
    r = I.interval(I.bootstrap(df, ["g"], ["id"], F.col("v"), F.lit(1), 200), ["g"]).first()
    mean, se = np.mean(values), np.std(values) / 500**0.5
    assert r.lower == pytest.approx(mean - 1.96 * se, abs=0.4 * se) and r.upper == pytest.approx(mean + 1.96 * se, abs=0.4 * se) and r.n_replicates == 200
    b = I.count_bootstrap(spark.createDataFrame([("a", 10, 30, 100), ("b", 0, 0, 50), ("c", 5, 0, 5)], "k string, down int, up int, n int"), ["k"], 2000, 0.95)
    got = {x.k: x.upper for x in b.collect()}
    assert got["b"] == 0 and got["c"] == -1 and 0.25 < got["a"] < 0.35


def test_paired_tests(spark):
    df = spark.createDataFrame([("x", v) for v in (1.0, 2.0, 3.0, 4.0, 5.0)] + [("flat", 0.0)] * 4, "g string, d double")
    r = {x.g: x for x in I.paired_tests(df, ["g"], "d").collect()}
    assert r["x"].t == pytest.approx(4.2426, abs=1e-4) and r["x"].p_two_sided == pytest.approx(0.01324, abs=1e-4) and r["x"].p_greater == pytest.approx(0.00662, abs=1e-4)
    assert r["flat"].p_two_sided == 1.0
    m = I.mean_intervals(df, ["g"], ["d"]).where("g = 'x'").first()
    assert m.d_high - m.d_mean == pytest.approx(1.9633, abs=1e-3)
    power = {x["size"]: x for x in I.sample_size_power(df.select((F.col("d") / 10).alias("d")), "d", [3, 60], 300).collect()}
    assert power[60].power > 0.99 > power[3].power and power[60].agreement == 1.0 and power[3].replicates == 300
    z = I.signed_rank_test(spark.createDataFrame([(55.0, 0.0, 10)], "w_plus double, w_minus double, n int")).first()
    assert z.p == pytest.approx(0.0059, abs=2e-4)


def test_links_transitions_quantiles(spark):
    df = spark.createDataFrame([("a", True, True), ("a", True, False), ("a", False, True), ("b", False, False)], "d string, t boolean, f boolean")
    got = {r.d: (r.tp, r.fp, r.fn, r.f1) for r in I.link_scores(df, ["d"], F.col("t"), F.col("f")).collect()}
    assert got == {"a": (1, 1, 1, 0.5), "b": (0, 0, 0, 0.0)}
    kinds = spark.createDataFrame([(t, a, b) for t in (True, False) for a in (True, False) for b in (True, False)], "t boolean, a boolean, b boolean").select(I.transition(F.col("t"), F.col("a"), F.col("b")).alias("k")).collect()
    assert [r.k for r in kinds] == [None, "regressed", "fixed", "both_missed", "both_false_positive", "fixed", "regressed", None]
    ordered, crossed = I.rearranged(F.col("q"))
    rows = spark.createDataFrame([([1.0, 3.0, 2.0],), ([1.0, 1.0, 2.0],)], "q array<double>").select(ordered.alias("o"), crossed.alias("c")).collect()
    assert [(list(r.o), r.c) for r in rows] == [([1.0, 2.0, 3.0], True), ([1.0, 1.0, 2.0], False)]


def test_approximate_search_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 24))
    rows = [(i, (centres[i % 20] + 0.3 * rng.standard_normal(24)).tolist()) for i in range(600)] + [(900, None), (901, [0.0] * 24), (902, [1.0])]
    v = spark.createDataFrame(rows, "doc bigint, vector array<double>")
    q = v.where("doc % 50 = 0").select(F.col("doc").alias("qid"), "vector")
    exact = {(r.qid, r.doc) for r in R.dense(v, q, 5).collect()}
    x = {i: np.array(w) for i, w in rows if w and len(w) == 24}
    for qid in (0, 50):
        best = sorted((j for j in x if j != qid and np.linalg.norm(x[j]) > 0), key=lambda j: (-round(float(x[qid] @ x[j] / np.linalg.norm(x[qid]) / np.linalg.norm(x[j])), 9), j))[:5]
        assert {d for k, d in exact if k == qid} == set(best)
    near = {(r.qid, r.doc) for r in R.nearest_by_planes(v, q, 5).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    assert R.dense(v, q.limit(0), 5).count() == 0 and R.nearest_by_planes(v.limit(0), q, 5).count() == 0


def test_examples_leave_out_the_question(spark):
    q = spark.createDataFrame([("a", "red apple pie"), ("b", "Red Apple Pie"), ("c", "red wine"), ("d", "")], "id string, text string")
    got = {(r.qid, r.doc) for r in R.examples_for(q, q, 3).collect()}
    assert ("a", "b") not in got and ("a", "c") in got and not any(k == "d" for k, _ in got)


def test_examples_list_no_pairs(spark):
    rng = random.Random(8)
    q = materialise(spark.createDataFrame([(i, f"what is the {rng.choice('abcdefgh')} of {rng.randrange(900)}") for i in range(1500)], "id bigint, text string"), "test")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    got = R.examples_for(q, q, 3).collect()
    time.sleep(1)  # for the listener
    assert len(got) == 4500 and written() - before < 2 << 20  # 2.2 million pairs share a word


@pytest.mark.parametrize(("common", "lead", "held"), [(16, 100, 1 << 20), (2, 0, 1 << 20), (64, 2, 2000), (64, 0, 0)])
def test_examples_of_a_part(monkeypatch, common, lead, held):
    for name, value in {"COMMON": common, "LEAD": lead, "PART_BYTES": held}.items():
        monkeypatch.setattr(R, name, value)
    rng = random.Random(common + lead)
    for n, kinds in ((1, 2), (40, 3), (150, 12), (150, 400)):
        words = [[f"w{int(kinds * rng.random() ** 2)}" for _ in range(rng.choice([0, 2, 4, 9]))] for _ in range(n)]
        words += words[: n // 3]  # the same texts again
        idf = {w: rng.choice([2.5, 1.0, 0.0, -0.5]) for w in {w for ws in words for w in ws if w != "w1"}}  # w1 is in no question
        texts, asks = [" ".join(ws) for ws in words], [k for k in range(len(words)) if words[k]]
        asked = R._Asked(asks, [texts[k] for k in asks], [words[k] for k in asks], idf)
        part = pa.RecordBatch.from_pydict({"doc": list(range(len(words))), "same": texts, "words": words}, pa.schema({"doc": pa.int64(), "same": pa.string(), "words": pa.list_(pa.string())}))
        q, row, score = R._first_matches(part, asked, 3.0, 3, 1.5, 0.75, np.full(len(asks), -np.inf))
        got, want = [(asks[k], int(r), round(float(x), 6)) for k, r, x in zip(q, row, score)], []
        for k in asks:
            found = []
            for d, ws in enumerate(words):
                if texts[d] != texts[k] and any(w in idf and w in ws for w in words[k]):
                    found.append((-round(sum(idf[w] * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / 3)) for w in words[k] if w in idf), 9), d))
            want += [(k, d, round(-x, 6)) for x, d in sorted(found)[:3]]
        assert sorted(got, key=lambda x: x[0]) == want


def test_curve_area_and_fit(spark):
    c = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "n double, q double")
    a = P.curve_area(c, "n", "q").first()
    assert (a.area, a.gain) == (3.0, 1.0)
    points = spark.createDataFrame([(float(b), b / (b + 30.0)) for b in range(0, 101, 5)], "bid double, win_rate double")
    assert P.fit_winning_curve(points) == pytest.approx(30.0, abs=1e-3)


def test_routes_and_assignments(spark):
    stops = [("i", 1, 3.0, 0.0, 1.0, 0.0, 100.0, 1.0), ("i", 2, 1.0, 0.0, 1.0, 0.0, 100.0, 1.0), ("i", 3, 2.0, 0.0, 5.0, 0.0, 100.0, 1.0), ("i", 4, 0.0, 9.0, 1.0, 0.0, 2.0, 1.0), ("j", 5, 1.0, 0.0, 1.0, 5.0, 9.0, 1.0)]
    df = spark.createDataFrame(stops, "instance string, id bigint, x double, y double, demand double, ready double, due double, service double")
    got = [(r.instance, r.vehicle, r.stop_no, r.id, r.start) for r in L.greedy_routes(df, 5.0, 3, 50.0).orderBy("instance", "vehicle", "stop_no").collect()]
    assert got == [("i", 1, 1, 2, 1.0), ("i", 1, 2, 1, 4.0), ("i", 2, 1, 3, 2.0), ("j", 1, 1, 5, 5.0)]
    rng = random.Random(6)
    side = lambda n: [("z", i, float(rng.randrange(30)), float(rng.randrange(30))) for i in range(n)]
    riders, orders = side(7), side(5)
    got = {(r.rider, r.order) for r in L.nearest_assignments(spark.createDataFrame(riders, "zone string, id bigint, x double, y double"), spark.createDataFrame([*orders, ("y", 9, 0.0, 0.0)], "zone string, id bigint, x double, y double")).collect()}
    left, right, want = riders[:], orders[:], set()
    while left and right:
        _, a, b = min((float(np.hypot(a[2] - b[2], a[3] - b[3])), a, b) for a in left for b in right)
        want.add((a[1], b[1]))
        left.remove(a)
        right.remove(b)
    assert got == want


def test_assignments_hold_few_pairs(monkeypatch):
    class Side:
        dtypes = [("zone", "string")]
        groupBy = cogroup = lambda self, x: self
        applyInPandas = lambda self, f, schema: f

    match, rng = L.nearest_assignments(Side(), Side()), np.random.default_rng(6)
    side = lambda n: pd.DataFrame({"zone": "z", "id": rng.permutation(n) + 5, "x": rng.integers(0, 30, n) / 1.0, "y": rng.integers(0, 30, n) / 1.0})
    riders, orders = side(400), side(20_000)
    tracemalloc.start()
    got = match(("z",), riders, orders)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 400 and got["order"].is_unique and peak < 100 << 20  # 64 MB for each copy of all distances
    for a, b in ((riders[:60], orders[:90]), (orders[:90], riders[:60]), (riders[:9], riders[:0])):
        left, right, want = list(a.itertuples()), list(b.itertuples()), []
        while left and right:
            d, _, _, r, o = min((float(np.hypot(r.x - o.x, r.y - o.y)), r.id, o.id, r, o) for r in left for o in right)
            want.append(("z", r.id, o.id, d))
            left.remove(r)
            right.remove(o)
        for pairs in (1, 300, 1 << 21):  # lists of one item, of a few, of all
            monkeypatch.setattr(L, "ASSIGN_PAIRS", pairs, raising=False)
            assert list(match(("z",), a, b).itertuples(index=False, name=None)) == want


def test_learners(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        x, t = rng.random(), rng.randrange(2)
        rows.append((i, x, None if i % 50 == 0 else 0.0, t, int(rng.random() < 0.3 + (0.5 * t if x > 0.5 else 0.0))))
    df = spark.createDataFrame(rows, "id int, x double, z double, t int, y int")
    u = L.uplift_scores(df, ["x", "z"], "y", "t", ["id"], trees=3).select((F.col("x") > 0.5).alias("high"), "z", *[F.col(c) for c in ("u_two", "u_one", "u_class", "u_x")])
    means = {r.high: r for r in u.groupBy("high").agg(*[F.avg(c).alias(c) for c in ("u_two", "u_one", "u_class", "u_x")]).collect()}
    assert all(means[True][c] > means[False][c] + 0.2 for c in ("u_two", "u_one", "u_class", "u_x")) and u.where("z IS NULL").count() == 12
    card = L.fit_scorecard(df, ["x", "z"], "y", 4)
    assert card.transform(df.limit(3).withColumn("x", F.lit(None).cast("double"))).first().woe_x == 0.0
    model = L.fit_probability(df, ["x"], "y", trees=2)
    assert L.importance_share(model, ["x"]) == {"x": 1.0} and set(L.scoring_latency(model, df.limit(20), ["x"], 2)) == {"rows", "ms_a_row", "p50_ms", "p95_ms"}


def test_sources_and_sinks(spark, tmp_path):
    text = "".join(f"line {i} {random.Random(i).random()}\n" for i in range(60_000)).encode()
    (tmp_path / "cut.bz2").write_bytes(bz2.compress(text)[:-9000])
    (tmp_path / "whole.bz2").write_bytes(bz2.compress(text[:5000]) + bz2.compress(text[5000:9000]))
    n = {r.file.rsplit("/", 1)[1]: (r.n, r.last) for r in files.read_truncated_bz2(spark, str(tmp_path / "*.bz2")).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max_by("line", "line_no").alias("last")).collect()}
    assert n["whole.bz2"][0] == text[:9000].count(b"\n") and 20_000 < n["cut.bz2"][0] < 60_000 and n["cut.bz2"][1].encode() == text.split(b"\n")[n["cut.bz2"][0] - 1]
    path = str(tmp_path / "log.jsonl")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    assert [sinks.append_once(df.where(f"k <= {n}"), path, "k", "k int, v string") for n in (2, 3, 3)] == [2, 1, 0]
    t = sinks.replace_table(spark, "made_here", df, str(tmp_path / "made"))
    assert t.count() == 3 and sinks.statistics(spark, "made_here", "k")["distinct_count"] == "3"
    spark.sql("DROP TABLE made_here")


def test_work_tables_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from millrace import session

    class Conf:
        def get(self, key):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        session.work_dir(Session())
    before = len(session._written)
    df = materialise(spark.range(3), "kept")
    assert df.count() == 3 and len(session._written) == before + 1
