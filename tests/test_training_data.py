"""Edge cases of the general training-data operators, against hand-made or brute-force results."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators.features import daily_cumulative, distinct_activities, feature_table, features_as_of
from millrace.operators.history import history
from millrace.operators.known_at import as_known, period_for, snapshots
from millrace.operators.orphans import key_bytes, key_runs, orphan_references
from millrace.sources.lines import Layout, classify_lines

T0 = datetime(2018, 1, 1)
LAYOUT = Layout(("at", "amount", "note"), {"at": "moment", "amount": "amount"})


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        ("2018-01-01 00:00:00,1.5,x", None),
        ('"2018-01-01 00:00:00"," 12 ","a,""b""\nq"', None),
        ("2018-01-01 00:00:00,1,", None),
        ("2018-01-01 00:00:00,1,a\nb", None),
        ("2016-02-29 23:59:59,0,x", None),
        ('2018-01-01 00:00:00,1,"x" ', "quoting"),
        ('2018-01-01 00:00:00,1,a"b', "quoting"),
        ('2018-01-01 00:00:00,1,"ab', "quoting"),
        ('2018-01-01 00:00:00,1,"a""', "quoting"),
        ("", "column_count"),
        (None, "column_count"),
        ('2018-01-01 00:00:00,1,"x",', "column_count"),
        ("2018-01-01 00:00:00,1", "column_count"),
        ("2018-02-30 00:00:00,1,x", "invalid_value"),
        ("2018-01-01 24:00:00,1,x", "invalid_value"),
        ("2018-01-01T00:00:00,1,x", "invalid_value"),
        ("２018-01-01 00:00:00,1,x", "invalid_value"),
        ("2018-01-01 00:00:00,1.,x", "invalid_value"),
        ("2018-01-01 00:00:00,-1,x", "invalid_value"),
        ("2018-01-01 00:00:00,1e3,x", "invalid_value"),
        (",,", "invalid_value"),
        ('2018-01-01 00:00:00,1,"' + 'a""' * 30_000 + '"', None),
        ("2018-01-01 00:00:00,1," + "x" * 300_000, None),
    ],
)
def test_lines(spark, line, reason):
    df = spark.createDataFrame([(1, line, "kept")], "id int, line string, other string")
    row = classify_lines(df, "line", LAYOUT).first()
    assert row.reason == reason
    assert (row.record is None) == (reason is not None)
    assert row.other == "kept"


def test_lines_values_and_empty_table(spark):
    df = spark.createDataFrame([('"2018-01-01 00:00:00",7,"a ""b"", c"',)], "line string")
    assert classify_lines(df, "line", LAYOUT).first().record.note == 'a "b", c'
    assert classify_lines(df.limit(0), "line", LAYOUT).count() == 0
    clash = df.withColumn("record", F.lit(1)).withColumn("reason", F.lit("mine"))
    assert classify_lines(clash, "line", LAYOUT).first().reason is None


EVENTS = "customer string, order string, kind string, ts timestamp_ntz, paid decimal(14,2), entity int, item string"


def features(spark, rows, as_of=datetime(2018, 6, 1)):
    df = spark.createDataFrame(rows, EVENTS)
    acts = distinct_activities(df, "customer", "order", "kind", "ts", "paid", before=as_of)
    return features_as_of(daily_cumulative(acts), as_of)


def test_features_edge_cases(spark):
    d = lambda n: datetime(2018, 6, 1) - timedelta(days=n)
    rows = [
        (" A ", "o1", "Buy", d(1), Decimal("5.00"), 1, "x"),
        ("a", "O1 ", " buy\t", d(1), Decimal("5.00"), 2, "y"),  # the same activity
        ("a", "o2", "buy", d(1), None, 3, "z"),  # equal time: greater order
        ("a", "o0", "buy", d(40), Decimal("-2.50"), 4, "z"),
        ("a", "o9", "buy", datetime(2018, 6, 1), Decimal("9"), 5, "z"),  # at the instant: not before it
        (None, "o3", "buy", d(1), Decimal("1"), 6, "z"),
        ("b", "o4", "buy", None, Decimal("1"), 7, "z"),
        ("c", None, None, d(3), Decimal("1"), 8, None),
    ]
    got = {(r.entity, r.kind): r for r in features(spark, rows).collect()}
    assert set(got) == {("a", "buy"), ("c", None)}
    a = got["a", "buy"]
    assert (a.n, a.total, a.last_item, a.n_30d, a.total_30d, a.n_90d) == (3, Decimal("2.50"), "o2", 2, Decimal("5.00"), 3)
    assert got["c", None].last_item == ""
    assert features(spark, []).count() == 0


def test_features_brute(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), f"o{rng.randrange(40)}", rng.choice(["x", "y"]), T0 + timedelta(hours=rng.randrange(5000)), Decimal(rng.randrange(100)), 0, "") for _ in range(400)]
    cells = features(spark, rows)
    seen = {(c, k, t, o): p for c, o, k, t, p, *_ in sorted(rows, key=lambda r: r[4]) if t < datetime(2018, 6, 1)}
    for r in cells.collect():
        own = [(t, o, p) for (c, k, t, o), p in seen.items() if (c, k) == (r.entity, r.kind)]
        assert (r.n, r.total) == (len(own), sum(p for *_, p in own))
        assert (r.last_ts, r.last_item) == max((t, o) for t, o, _ in own)
        assert r.n_90d == sum(t >= datetime(2018, 6, 1) - timedelta(days=90) for t, *_ in own)
    wide = feature_table(cells, datetime(2018, 6, 1)).collect()
    assert sum(len(r.features) for r in wide) == cells.count()


def test_key_runs():
    lo = np.array([1, 2, 3, 7, 8, 2**64 - 1], np.uint64)
    hi = np.array([0, 0, 0, 0, 0, 0], np.uint64)
    starts, lengths = key_runs(hi, lo)
    assert starts.tolist() == [0, 3, 5] and lengths.tolist() == [3, 2, 1]
    assert key_runs(hi[:0], lo[:0])[0].tolist() == []


def test_key_bytes_keep_order(spark):
    df = spark.createDataFrame([(x,) for x in (-(2**63), -5, 0, 7, 2**63 - 1)], "k bigint")
    assert [r.k for r in df.orderBy(key_bytes(F.col("k"), "bigint")).collect()] == [-(2**63), -5, 0, 7, 2**63 - 1]


def test_feature_map_keeps_null_and_empty_kinds(spark):
    rows = [("c", "o1", None, datetime(2018, 5, 1), Decimal("1"), 0, ""), ("c", "o2", " ", datetime(2018, 5, 2), Decimal("2"), 0, "")]
    r = feature_table(features(spark, rows), datetime(2018, 6, 1)).first()
    assert {k: v.last_item for k, v in r.features.items()} == {"NULL": "o1", "": "o2"} and r.n_all == 2


@pytest.mark.parametrize("bucket_rows", [1 << 20, 20])
@pytest.mark.parametrize("integers", [False, True])
def test_orphans_brute(spark, monkeypatch, integers, bucket_rows):
    monkeypatch.setattr("millrace.operators.orphans.BUCKET_ROWS", bucket_rows)
    rng = random.Random(5)
    key = (lambda n: n) if integers else (lambda n: rng.choice([f"{n:032x}", f" {n:032X}\t"]))
    plain = lambda k: k if integers or k is None else k.strip(" \t").lower()
    at = lambda: T0 + timedelta(hours=rng.randrange(50))
    parents = [(key(rng.randrange(60)), at(), rng.choice([None, None, at()])) for _ in range(120)] + [(None, at(), None), (key(70), None, None)]
    # one parent holds a third of the references
    children = [(rng.randrange(150), key(rng.choice([3, rng.randrange(75), rng.randrange(75)])), at(), "x") for _ in range(400)] + [(999, None, at(), "x"), (998, key(3), None, "x")]
    kind = "bigint" if integers else "string"
    c = spark.createDataFrame(children, f"id int, ref {kind}, at timestamp_ntz, _key string")
    p = spark.createDataFrame(parents, f"key {kind}, since timestamp_ntz, until timestamp_ntz")
    got = {r.id: r.kind for r in orphan_references(c, ["id"], "ref", "at", p, "key", "since", "until").collect()}
    want = {}
    for i in {x[0] for x in children}:
        own = [x for x in children if x[0] == i]
        times = [x[2] for x in own if x[2]]
        refs = [(x[2] or datetime.max, plain(x[1])) for x in own if x[1] is not None]
        if not refs:
            continue
        mine = [q for q in parents if plain(q[0]) == min(refs)[1] and q[0] is not None]
        when = min(times, default=None)
        if not mine:
            want[i] = "missing"
        elif when is None or any(s and s <= when and (u is None or u > when) for _, s, u in mine):
            continue
        else:
            want[i] = "late" if all(s is None or s > when for _, s, _ in mine) else "deleted"
    assert got == want
    assert orphan_references(c.limit(0), ["id"], "ref", "at", p, "key", "since", "until").count() == 0
    assert {r.kind for r in orphan_references(c, ["id"], "ref", "at", p.limit(0), "key", "since", "until").collect()} == {"missing"}


def test_as_known_brute(spark):
    rng = random.Random(9)
    day = lambda: date(2018, 1, 1) + timedelta(days=rng.randrange(900))
    at = lambda: datetime(2017, 6, 1) + timedelta(hours=rng.randrange(30_000))
    entries = [(i, rng.choice(["s", "t"]), rng.choice([day() for _ in range(4)] + [None]), rng.choice([None, day()]), at()) for i in range(120)] + [(500, None, day(), None, at()), (501, "s", day(), None, None)]
    events = [(i, rng.choice(["s", "t", "u"]), at()) for i in range(300)] + [(900, None, at()), (901, "s", None)]
    m = spark.createDataFrame(entries, "version int, sym string, since date, until date, recorded timestamp_ntz")
    e = spark.createDataFrame(events, "id int, sym string, ts timestamp_ntz").withColumn("period", F.lit(1))
    snaps = snapshots(m, F.col("sym"), "version", "since", "until", "recorded")
    months = snapshots(m, F.col("sym"), "version", "since", "until", "recorded", "month")
    want = {}
    for i, sym, ts in events:
        if sym is None or ts is None:
            continue
        known = {}
        for v, s2, since, until, rec in entries:
            if s2 == sym and since and rec and rec <= ts and (since not in known or (rec, v) > known[since][:2]):
                known[since] = (rec, v, until)
        holds = [(since, v) for since, (_, v, until) in known.items() if since <= ts.date() and (until is None or until > ts.date())]
        if holds:
            want[i] = max(holds)[1]
    for rows in (1 << 20, 0):  # broadcast, and the shuffle beyond the bound
        assert {r.event_id: r.version for r in as_known(e, "id", F.col("sym"), "ts", snaps, broadcast_bytes=rows).collect()} == want
    assert {r.event_id: r.version for r in as_known(e, "id", F.col("sym"), "ts", months, "month").collect()} == want
    assert period_for(m, F.col("sym"), "recorded") == "year" and period_for(m, F.col("sym"), "recorded", 1) == "month"
    assert as_known(e.limit(0), "id", F.col("sym"), "ts", snaps).count() == 0
    assert as_known(e, "id", F.col("sym"), "ts", snapshots(m.limit(0), F.col("sym"), "version", "since", "until", "recorded")).count() == 0


def test_history_brute(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        d = rng.randrange(1, 9)
        rows.append((i, rng.choice(["r", "q", None]), f"2020010{d}{rng.randrange(2)}", rng.choice(["f", "g", None]), rng.choice([1, 2, None]), rng.choice(["x", None])))
    rows += [(1000, "r", None, "f", 1, "x"), (1001, "r", "nonsense", "f", 1, "x")]
    df = spark.createDataFrame(rows, "id int, grp string, snap string, fact string, value int, txt string").withColumn("valid_from", F.lit("clash"))
    day = F.to_date(F.try_to_timestamp(F.substring("snap", 1, 8), F.lit("yyyyMMdd")))
    got = {(r.grp, r.fact, str(r.valid_from), str(r.valid_to) if r.valid_to else "", r.id, r.value, r.txt) for r in history(df, ["grp"], ["fact"], "snap", day, ["value", "txt"], "id").collect()}
    want = set()
    sound = [r for r in rows if r[2] and r[2][:4] == "2020"]
    for g in {r[1] for r in sound}:
        days = {}
        for r in sound:
            if r[1] == g:
                days[r[2][:8]] = max(days.get(r[2][:8], ""), r[2])
        order = sorted(days)
        for f in {r[3] for r in sound if r[1] == g}:
            cur = None
            for k in [*order, None]:
                own = sorted((r[0], r[4], r[5]) for r in sound if k and r[1] == g and r[3] == f and r[2] == days[k])
                content = own[0][1:] if own else None
                if cur and (k is None or content != cur[1]):
                    to = f"{k[:4]}-{k[4:6]}-{k[6:]}" if k else ""
                    want.add((g, f, cur[0], to, cur[2], *cur[1]))
                    cur = None
                if k and own and cur is None:
                    cur = (f"{k[:4]}-{k[4:6]}-{k[6:]}", content, own[0][0])
    # a fact whose attributes are all NULL is stated too
    assert got == want
    assert history(df.limit(0), ["grp"], ["fact"], "snap", day, ["value", "txt"], "id").count() == 0
