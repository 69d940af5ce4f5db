"""Queries in time: bitemporal facts, as-of matches, panels, portfolios and state machines, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import metrics as M
from millrace.operators import panel as P
from millrace.operators import sequential as Q
from millrace.operators import temporal as T
from millrace.operators.history import counting_snapshots
from millrace.plans.training_data import _HISTORY, _history
from millrace.sources.tables import table

REPORT = ["corp_code", "report_year", "report_code"]
FACT = [*REPORT, "concept", "context_key", "unit"]
DAY = "2019-06-30"


def pit_as_of(s, d):
    return T.as_of(_history(s, d), F.lit(DAY).cast("date")).groupBy("corp_code", "report_year").agg(F.count(F.lit(1)).alias("n_facts"), F.sum("value").cast("decimal(38,2)").alias("total"))


def _filings(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Facts of the last and of the last but one counting filing of each report."""
    f = table(s, d, "disclosure_fact")
    day = F.to_date(F.substring("receipt_no", 1, 8), "yyyyMMdd")
    m = counting_snapshots(f, REPORT, day, "receipt_no")
    m = m.withColumn("back", F.max("seq").over(Window.partitionBy(*REPORT)) - F.col("seq")).where("back < 2").select(*REPORT, "receipt_no", "back", "day")
    rows = f.join(m, [*REPORT, "receipt_no"])
    facts = rows.groupBy(*FACT, "back", "day").agg(F.min(F.struct("fact_id", "value", "value_text")).alias("x")).select(*FACT, "back", "day", "x.value", "x.value_text")
    return facts.where("back = 1").drop("back"), facts.where("back = 0").drop("back")


def revision_delta(s, d):
    old, new = _filings(s, d)
    return T.compare_facts(old.drop("day"), new.drop("day"), FACT, ["value", "value_text"], REPORT)


def bitemporal_load(s, d):
    """The last filing of each report loaded over the state that the last but one left: rows by outcome."""
    old, new = _filings(s, d)
    state = old.select(*FACT, "value", "value_text", F.col("day").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    out = T.load_revision(state, new.drop("day"), FACT, ["value", "value_text"], F.lit("2100-01-01").cast("date"))
    outcome = F.when(F.col("valid_to").isNotNull(), "closed").when(F.col("valid_from") == F.lit("2100-01-01").cast("date"), "opened").otherwise("kept")
    return out.groupBy("corp_code", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def overwrite_baseline(s, d):
    f = table(s, d, "disclosure_fact").select(*FACT, "receipt_no", "fact_id", "value")
    last = T.latest_per_key(f.withColumn("_neg", -F.col("fact_id")), FACT, ["receipt_no", "_neg"])
    return last.groupBy("corp_code").agg(F.count(F.lit(1)).alias("n_facts"), F.sum("value").cast("decimal(38,2)").alias("total"))


def view_before_purchase(s, d):
    e = table(s, d, "events")
    buys = e.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    views = e.where(F.col("event_type") == "view").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return T.as_of_match(buys, views, "user_id", "ts", "view_id").select("event_id", F.col("view_id_before").alias("view_id"))


def lag_features(s, d):
    p = P.known_lags(P.daily_counts(table(s, d, "events"), "user_id", "ts"), 7, [7, 8, 14], [7, 14])
    return p.select("entity", "day", "qty", "lag_7", "lag_8", "lag_14", *[F.round(c, 6).alias(c) for c in p.columns if c.split("_")[0] in ("mean", "std", "zero")])


def intermittency(s, d):
    return P.intermittency(P.daily_counts(table(s, d, "events"), "user_id", "ts"))


def _prices(s: SparkSession, d: str) -> DataFrame:
    l = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    panel = l.groupBy(F.trunc("l_shipdate", "month").alias("date"), F.col("p_brand").alias("symbol")).agg((F.floor(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.sum("l_quantity") * 10_000 + 0.5) / 10_000).alias("close"))
    return P.filled(panel)


def panel_filled(s, d):
    return _prices(s, d).select("symbol", "session", "close", "raw")


def momentum_weights(s, d):
    return P.momentum_weights(_prices(s, d), 12, 3, 5).select("session", "symbol", F.round("weight", 6).alias("weight"))


def _backtest(s, d):
    prices = _prices(s, d)
    return P.backtest(prices, P.momentum_weights(prices, 12, 3, 5), 10.0)


def momentum_backtest(s, d):
    return _backtest(s, d).select("session", F.round("ret", 6).alias("ret"), F.round("turnover", 6).alias("turnover"))


def return_summary(s, d):
    return P.return_summary(_backtest(s, d), 12.0)


def token_bucket(s, d):
    """Tokens refill at one in six hours, as users act a few times a day."""
    t = Q.token_bucket(table(s, d, "events"), "user_id", "ts", "event_id", 2.0, 1 / 21_600)
    return t.select("user_id", "event_id", "allowed", F.round("tokens", 4).alias("tokens"))


def circuit_breaker(s, d):
    e = table(s, d, "events")
    return Q.circuit_breaker(e, "user_id", "ts", "event_id", F.col("event_type") == "error", 2, 86_400.0)


def budget_replay(s, d):
    e = table(s, d, "events").select("user_id", "ts", "event_id", F.col("value").cast("double").alias("price"))
    return Q.budget_replay(e, "user_id", ["ts", "event_id"], "price", 500.0).select("event_id", "taken", F.round("spent", 4).alias("spent"))


TTL = 5 * 86_400.0


def _requests(s, d):
    """Events as requests: the version changes in mid-month, users share a tenant, and vectors stand for the questions."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("vec"), "embedding")
    n = F.lit(40)
    e = table(s, d, "events").select("event_id", "ts", F.pmod("user_id", F.lit(20)).alias("tenant"), F.pmod("user_id", F.lit(2)).alias("tier"), F.when(F.dayofmonth("ts") <= 15, "v1").otherwise("v2").alias("version"), F.concat_ws(" ", "event_type", "props").alias("question"), F.pmod(F.xxhash64("event_type", "props"), n).alias("vec"))
    return e.join(F.broadcast(v.where(F.col("vec") < n)), "vec", "left")  # forty vectors


def cache_replay(s, d):
    return Q.cache_replay(_requests(s, d), ["tier", "version", "tenant"], ["tier", "version"], "ts", "event_id", "question", "embedding", TTL, 0.95)


def cache_invalidation(s, d):
    """Answers of each prompt version that invalidating it would drop on the 18th."""
    r = cache_replay(s, d).join(_requests(s, d).select("event_id", "ts", "version"), "event_id")
    return Q.alive_entries(r, F.col("version"), "ts", TTL, F.lit("2024-01-18").cast("timestamp_ntz"))


def cache_savings(s, d):
    """Cost and delay model of the replay; a semantic hit is false if it matched another event type."""
    e = table(s, d, "events").select("event_id", "event_type", F.length("props").alias("chars"))
    r = cache_replay(s, d).join(e, "event_id").join(e.select(F.col("event_id").alias("matched"), F.col("event_type").alias("stored")), "matched", "left")
    u = M.hash_fraction(F.col("event_id"))
    costed = Q.replay_cost(r, 400 + F.col("chars"), F.floor(80 + 60 * u), 100 * u, (0.5, 1.5), 0.5, {"base": 400.0, "per_token": 12.0, "exact": 20.0, "semantic": 45.0, "prefix_saving": 300.0, "cache_jitter": 10.0})
    return Q.replay_summary(costed, F.col("event_type") != F.col("stored"))


def waiting_queue(s, d):
    """Requests wait up to eight hours for a token, at one in six hours."""
    q = Q.waiting_queue(table(s, d, "events"), "user_id", "ts", "event_id", 2.0, 1 / 21_600, 28_800.0)
    return q.select("event_id", "allowed", F.round("waited", 3).alias("waited"))


def failover(s, d):
    code = lambda k: F.when(F.pmod(F.xxhash64("event_id", F.lit(k)), F.lit(10)) < 5, 200).when(F.pmod(F.xxhash64("event_id", F.lit(k)), F.lit(10)) < 9, 503).otherwise(400)
    e = table(s, d, "events").withColumn("codes", F.array(code(1), code(2), code(3)))
    order = Q.checked_order(["first", "second", "third"], ["third", "second", "first"])
    f = Q.failover(e, ["user_id"], "ts", "event_id", "codes", order, open_seconds=86_400.0)
    return f.groupBy("provider", "tries", "failed_over").agg(F.count(F.lit(1)).alias("n"))


def usage_ledger(s, d):
    """Order totals against the sums of their lines, by customer: two ledgers of one business, which rarely agree."""
    o = table(s, d, "orders")
    ours = o.select("o_custkey", F.lit(1).alias("n"), F.col("o_totalprice").cast("decimal(18,2)").alias("cost"))
    lines = table(s, d, "lineitem").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    theirs = lines.where(F.col("l_linenumber") == 1).select("o_custkey", F.lit(1).alias("n"), F.col("l_extendedprice").cast("decimal(18,2)").alias("cost"))
    return Q.reconcile(ours, theirs, "o_custkey", ["n", "cost"])


def paced_replay(s, d):
    e = table(s, d, "events").select("event_id", "ts", F.lit("all").alias("k"), F.col("value").alias("price"), (30 + F.pmod("event_id", F.lit(50))).alias("bid"))
    return Q.paced_replay(e, "k", "ts", "event_id", "bid", "price", 2000.0).select("event_id", "taken", F.round("multiplier", 6).alias("multiplier"))


def spend_reservations(s, d):
    e = table(s, d, "events").select("user_id", "ts", "event_id", F.octet_length("props").alias("bytes"))
    return Q.reservations(e, "user_id", ["ts", "event_id"], "event_id", "bytes", 300.0)


# The moves of a customer's path.
MOVES = {("NEW", "view"): "SEEN", ("SEEN", "view"): "SEEN", ("SEEN", "click"): "WARM", ("WARM", "view"): "SEEN", ("WARM", "signup"): "MEMBER", ("MEMBER", "view"): "MEMBER", ("MEMBER", "purchase"): "BUYER", ("BUYER", "error"): "NEW"}


def customer_paths(s, d):
    return Q.state_machine(table(s, d, "events"), "user_id", ["ts", "event_id"], "event_id", "event_type", MOVES, "NEW", 12)


def revision_writes(s, d):
    """Events as writes to their user's record: every tenth knows a wrong revision, every fifth is a retry."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(s, d, "events").withColumn("k", F.row_number().over(w) - 1)
    x = e.select("user_id", "ts", "event_id", (F.col("k") - F.floor((F.col("k") + 4) / 5)).alias("expected"), F.when(F.col("k") % 5 == 0, F.lit("first")).otherwise(F.col("event_id").cast("string")).alias("command"))
    return Q.compare_and_swap(x, "user_id", ["ts", "event_id"], "event_id", "expected", "command").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def ticket_uses(s, d):
    """Purchases use the ticket of their user's hash for their type of day; a ticket is issued for one action."""
    e = table(s, d, "events")
    uses = e.where(F.col("event_type") == "purchase").select("event_id", "ts", F.col("user_id").alias("ticket"), F.when(F.dayofmonth("ts") % 2 == 0, "even").otherwise("odd").alias("action"))
    tickets = e.where(F.col("event_type") == "signup").groupBy(F.col("user_id").alias("ticket")).agg(F.min("ts").alias("issued")).withColumn("action", F.when(F.col("ticket") % 2 == 0, "even").otherwise("odd"))
    return Q.single_use(uses, tickets, ["ts", "event_id"]).select("event_id", "valid")


def hourly_spend(s, d):
    """Running spend by hour, over one row per hour."""
    h = table(s, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return h.select("hour", "n", F.round(F.sum("v").over(w), 4).alias("spent"))


def win_curve(s, d):
    """Share of prices at or below each bid of a grid."""
    e = table(s, d, "events").where(F.col("value").isNotNull())
    cells = [F.struct(F.lit(float(b)).alias("bid"), F.round(F.avg((F.col("value") <= b).cast("double")), 6).alias("win_rate")) for b in range(0, 101, 5)]
    return e.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


QUERIES = {f.__name__: f for f in (pit_as_of, revision_delta, bitemporal_load, overwrite_baseline, view_before_purchase, lag_features, intermittency, panel_filled, momentum_weights, momentum_backtest, return_summary, token_bucket, circuit_breaker, budget_replay, cache_replay, cache_invalidation, cache_savings, waiting_queue, failover, usage_ledger, paced_replay, spend_reservations, customer_paths, revision_writes, ticket_uses, hourly_spend, win_curve)}

_TWO = f"""WITH {_HISTORY}, back AS (SELECT *, max(seq) OVER (PARTITION BY corp_code, report_year, report_code) - seq AS back FROM marks),
two AS (SELECT s.*, b.back FROM stated s JOIN back b USING (corp_code, report_year, report_code, receipt_no) WHERE back < 2),
o AS (SELECT * FROM two WHERE back = 1), n AS (SELECT * FROM two WHERE back = 0),
j AS (SELECT coalesce(n.corp_code, o.corp_code) AS corp_code, coalesce(n.report_year, o.report_year) AS report_year, coalesce(n.report_code, o.report_code) AS report_code, o.fact_id AS oid, n.fact_id AS nid, o.content AS oc, n.content AS nc
  FROM o FULL JOIN n ON o.corp_code = n.corp_code AND o.report_year = n.report_year AND o.report_code = n.report_code AND o.concept = n.concept AND o.context_key = n.context_key AND o.unit = n.unit)"""
_DAILY = """n AS (SELECT user_id AS entity, CAST(ts AS date) AS day, count(*) AS qty FROM events GROUP BY 1, 2),
p AS (SELECT e.entity, CAST(g.day AS date) AS day, coalesce(qty, 0) AS qty FROM (SELECT DISTINCT entity FROM n) e CROSS JOIN (SELECT unnest(generate_series((SELECT min(day) FROM n), (SELECT max(day) FROM n), INTERVAL 1 DAY)) AS day) g LEFT JOIN n ON n.entity = e.entity AND n.day = g.day)"""
_PRICES = """q AS (SELECT CAST(date_trunc('month', l_shipdate) AS date) AS date, p_brand AS symbol, floor(CAST(sum(CAST(l_extendedprice AS decimal(18,2))) AS double) / sum(l_quantity) * 10000 + 0.5) / 10000 AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
sess AS (SELECT date, row_number() OVER (ORDER BY date) AS session FROM (SELECT DISTINCT date FROM q)),
grid AS (SELECT symbol, s.session FROM (SELECT symbol, min(session) AS f FROM q JOIN sess USING (date) GROUP BY 1) x JOIN sess s ON s.session >= x.f),
prices AS (SELECT g.symbol, g.session, q.close AS raw, last_value(q.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.session ROWS UNBOUNDED PRECEDING) AS close FROM grid g JOIN sess USING (session) LEFT JOIN q ON q.symbol = g.symbol AND q.date = sess.date),
mom AS (SELECT a.session, a.symbol, round(a.raw / b.raw - 1, 9) AS m FROM prices a JOIN prices b ON a.symbol = b.symbol AND b.session = a.session - 12 WHERE a.session % 3 = 0 AND a.raw IS NOT NULL AND b.raw > 0),
picked AS (SELECT session, symbol FROM mom QUALIFY row_number() OVER (PARTITION BY session ORDER BY m DESC, symbol) <= 5),
weights AS (SELECT session, symbol, 1.0 / count(*) OVER (PARTITION BY session) AS weight FROM picked)"""
_BACK = f"""{_PRICES}, ends AS (SELECT session, coalesce(lead(session) OVER (ORDER BY session), (SELECT max(session) FROM prices)) AS stop FROM (SELECT DISTINCT session FROM weights)),
parts AS (SELECT w.session AS start, e.stop, p.session, w.symbol, w.weight * p.close / b.close AS part FROM weights w JOIN ends e USING (session) JOIN prices b ON b.symbol = w.symbol AND b.session = w.session JOIN prices p ON p.symbol = w.symbol AND p.session BETWEEN w.session AND e.stop),
val AS (SELECT start, stop, session, sum(part) AS v FROM parts GROUP BY 1, 2, 3),
r0 AS (SELECT start, session, v / lag(v) OVER (PARTITION BY start ORDER BY session) - 1 AS ret FROM val),
old AS (SELECT p.stop AS start, p.symbol, p.part / v.v AS old FROM parts p JOIN val v ON v.start = p.start AND v.session = p.session WHERE p.session = p.stop AND p.stop IN (SELECT session FROM weights)),
turn AS (SELECT coalesce(w.session, o.start) AS start, sum(abs(coalesce(weight, 0) - coalesce(old, 0))) AS turnover FROM weights w FULL JOIN old o ON o.start = w.session AND o.symbol = w.symbol GROUP BY 1),
bt AS (SELECT r.session, CASE WHEN r.session = r.start + 1 THEN (1 + ret) * (1 - 10.0 * turnover / 10000) - 1 ELSE ret END AS ret, CASE WHEN r.session = r.start + 1 THEN turnover ELSE 0 END AS turnover FROM r0 r JOIN turn t USING (start) WHERE r.session > r.start)"""

SQL = {
    "pit_as_of": f"WITH {_HISTORY} SELECT corp_code, report_year, count(*) AS n_facts, CAST(sum(content[1]) AS decimal(38,2)) AS total FROM closed WHERE valid_from <= DATE '{DAY}' AND (valid_to IS NULL OR valid_to > DATE '{DAY}') GROUP BY 1, 2",
    "revision_delta": f"{_TWO} SELECT corp_code, report_year, report_code, count(*) FILTER (WHERE oid IS NOT NULL AND nid IS NOT NULL AND oc IS DISTINCT FROM nc) AS changed, count(*) FILTER (WHERE oid IS NULL) AS added, count(*) FILTER (WHERE nid IS NULL) AS removed, count(*) FILTER (WHERE oid IS NOT NULL AND nid IS NOT NULL) AS comparable FROM j GROUP BY 1, 2, 3",
    "bitemporal_load": f"""{_TWO}, a AS (SELECT corp_code, CASE WHEN oid IS NOT NULL AND nid IS NOT NULL AND oc IS NOT DISTINCT FROM nc THEN ['kept'] ELSE list_filter([CASE WHEN oid IS NOT NULL THEN 'closed' END, CASE WHEN nid IS NOT NULL THEN 'opened' END], lambda x: x IS NOT NULL) END AS o FROM j)
      SELECT corp_code, outcome, count(*) AS n FROM (SELECT corp_code, unnest(o) AS outcome FROM a) GROUP BY 1, 2""",
    "overwrite_baseline": "WITH l AS (SELECT * FROM disclosure_fact QUALIFY row_number() OVER (PARTITION BY corp_code, report_year, report_code, concept, context_key, unit ORDER BY receipt_no DESC, fact_id) = 1) SELECT corp_code, count(*) AS n_facts, CAST(sum(value) AS decimal(38,2)) AS total FROM l GROUP BY 1",
    "view_before_purchase": "WITH p AS (SELECT * FROM events WHERE event_type = 'purchase') SELECT p.event_id, (SELECT max_by(v.event_id, (v.ts, v.event_id)) FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts < p.ts) AS view_id FROM p",
    "lag_features": f"""WITH {_DAILY} SELECT entity, day, qty, lag(qty, 7) OVER w AS lag_7, lag(qty, 8) OVER w AS lag_8, lag(qty, 14) OVER w AS lag_14,
      {', '.join(f"CASE WHEN count(qty) OVER w{k} = {k} THEN round(avg(qty) OVER w{k}, 6) END AS mean_{k}, CASE WHEN count(qty) OVER w{k} = {k} THEN round(stddev_pop(qty) OVER w{k}, 6) END AS std_{k}, CASE WHEN count(qty) OVER w{k} = {k} THEN round(avg(CAST(qty = 0 AS integer)) OVER w{k}, 6) END AS zero_{k}" for k in (7, 14))}
      FROM p WINDOW w AS (PARTITION BY entity ORDER BY day), w7 AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING), w14 AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 20 PRECEDING AND 7 PRECEDING)""",
    "intermittency": f"WITH {_DAILY}, f AS (SELECT entity, min(day) AS f FROM p WHERE qty > 0 GROUP BY 1) SELECT entity, round(avg(CAST(qty = 0 AS integer)), 6) AS zero_share, avg(CAST(qty = 0 AS integer)) >= 0.5 AS intermittent FROM p JOIN f USING (entity) WHERE day >= f GROUP BY 1",
    "panel_filled": f"WITH {_PRICES} SELECT symbol, CAST(session AS integer) AS session, close, raw FROM prices",
    "momentum_weights": f"WITH {_PRICES} SELECT CAST(session AS integer) AS session, symbol, round(weight, 6) AS weight FROM weights",
    "momentum_backtest": f"WITH {_BACK} SELECT CAST(session AS integer) AS session, round(ret, 6) AS ret, round(turnover, 6) AS turnover FROM bt",
    "return_summary": f"""WITH {_BACK}, c AS (SELECT ret, exp(sum(ln(1 + ret)) OVER (ORDER BY session)) AS level, session FROM bt), k AS (SELECT *, level / greatest(max(level) OVER (ORDER BY session), 1) - 1 AS dd FROM c)
      SELECT round(exp(sum(ln(1 + ret))) - 1, 6) AS total, round(pow(exp(sum(ln(1 + ret))), 12.0 / count(*)) - 1, 6) AS cagr, round(avg(ret) / stddev_samp(ret) * sqrt(12.0), 6) AS sharpe, round(min(dd), 6) AS max_drawdown, count(*) AS n FROM k""",
    "usage_ledger": """WITH a AS (SELECT o_custkey, CAST(count(*) AS bigint) AS n_ours, CAST(sum(CAST(o_totalprice AS decimal(18,2))) AS decimal(28,2)) AS cost_ours FROM orders GROUP BY 1),
      b AS (SELECT o_custkey, CAST(count(*) AS bigint) AS n_theirs, CAST(sum(CAST(l_extendedprice AS decimal(18,2))) AS decimal(28,2)) AS cost_theirs FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1 GROUP BY 1)
      SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'ours' WHEN a.o_custkey IS NULL THEN 'theirs' ELSE 'both' END AS side, n_ours, n_theirs, cost_ours, cost_theirs,
      coalesce(a.o_custkey = b.o_custkey AND n_ours = n_theirs AND cost_ours = cost_theirs, false) AS matches FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""",
    "customer_paths": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
      m AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', '{c}')" for (a, b), c in MOVES.items())}) t(src, ev, nxt)),
      f AS (SELECT user_id, CAST(NULL AS bigint) AS event_id, CAST(0 AS bigint) AS k, 'NEW' AS state, false AS accepted, CAST(0 AS bigint) AS steps FROM e WHERE k = 1
        UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN nxt IS NULL THEN f.state WHEN f.steps >= 12 THEN 'HALTED' ELSE nxt END, nxt IS NOT NULL AND f.steps < 12, f.steps + CAST(nxt IS NOT NULL AND f.steps < 12 AS integer)
          FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1 LEFT JOIN m ON m.src = f.state AND m.ev = e.event_type)
      SELECT event_id, state, accepted, steps FROM f WHERE k > 0""",
    "ticket_uses": """WITH t AS (SELECT user_id AS ticket, min(ts) AS issued FROM events WHERE event_type = 'signup' GROUP BY 1), u AS (SELECT event_id, ts, user_id AS ticket, CASE WHEN day(ts) % 2 = 0 THEN 'even' ELSE 'odd' END AS action FROM events WHERE event_type = 'purchase'),
      m AS (SELECT u.*, coalesce(ts >= issued AND action = CASE WHEN u.ticket % 2 = 0 THEN 'even' ELSE 'odd' END, false) AS fits FROM u LEFT JOIN t USING (ticket))
      SELECT event_id, fits AND row_number() OVER (PARTITION BY ticket, fits ORDER BY ts, event_id) = 1 AS valid FROM m""",
    "token_bucket": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
      f AS (SELECT user_id, event_id, s, k, CAST(1 AS double) AS tokens, true AS allowed FROM e WHERE k = 1
        UNION ALL SELECT e.user_id, e.event_id, e.s, e.k, least(2.0, f.tokens + (e.s - f.s) / 21600) - CAST(least(2.0, f.tokens + (e.s - f.s) / 21600) >= 1 - 1e-9 AS integer), least(2.0, f.tokens + (e.s - f.s) / 21600) >= 1 - 1e-9 FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
      SELECT user_id, event_id, allowed, round(tokens, 4) AS tokens FROM f""",
    "budget_replay": """WITH RECURSIVE e AS (SELECT user_id, event_id, value AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
      f AS (SELECT user_id, event_id, k, coalesce(p <= 500 + 1e-9, false) AS taken, CAST(CASE WHEN p <= 500 + 1e-9 THEN p ELSE 0 END AS double) AS spent FROM e WHERE k = 1
        UNION ALL SELECT e.user_id, e.event_id, e.k, coalesce(f.spent + p <= 500 + 1e-9, false), f.spent + CASE WHEN f.spent + p <= 500 + 1e-9 THEN p ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
      SELECT event_id, taken, round(spent, 4) AS spent FROM f""",
    "circuit_breaker": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
      f AS (SELECT user_id, event_id, k, 'CLOSED' AS state, CAST(bad AS integer) AS n, CAST(0 AS double) AS opened FROM e WHERE k = 1
        UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN f.n < 2 THEN 'CLOSED' WHEN e.s - f.opened < 86400 THEN 'OPEN' ELSE 'HALF_OPEN' END,
          CASE WHEN f.n >= 2 AND e.s - f.opened < 86400 THEN f.n WHEN f.n >= 2 THEN CASE WHEN bad THEN 2 ELSE 0 END WHEN bad THEN f.n + 1 ELSE 0 END,
          CASE WHEN f.n >= 2 AND e.s - f.opened < 86400 THEN f.opened WHEN bad THEN e.s ELSE f.opened END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
      SELECT user_id, event_id, state FROM f""",
    "waiting_queue": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
      f AS (SELECT user_id, event_id, s, k, CAST(1 AS double) AS level, true AS allowed, CAST(0 AS double) AS waited FROM e WHERE k = 1
        UNION ALL SELECT user_id, event_id, s, k, l - CAST(w < 28800 AS integer), w < 28800, CASE WHEN w < 28800 THEN w ELSE 28800 END FROM (
          SELECT e.user_id, e.event_id, e.s, e.k, least(2.0, f.level + (e.s - f.s) / 21600) AS l, greatest(0, (1 - least(2.0, f.level + (e.s - f.s) / 21600)) * 21600) AS w FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1))
      SELECT event_id, allowed, round(waited, 3) AS waited FROM f""",
    "spend_reservations": """WITH RECURSIVE e AS (SELECT user_id, event_id, strlen(props) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
      f AS (SELECT user_id, event_id, k, coalesce(p <= 300, false) AS granted, CAST(CASE WHEN p <= 300 THEN p ELSE 0 END AS double) AS reserved FROM e WHERE k = 1
        UNION ALL SELECT e.user_id, e.event_id, e.k, coalesce(f.reserved + p <= 300, false), f.reserved + CASE WHEN f.reserved + p <= 300 THEN p ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
      SELECT event_id, granted, reserved FROM f""",
    "hourly_spend": "WITH h AS (SELECT date_trunc('hour', ts) AS hour, sum(value) AS v, count(*) AS n FROM events GROUP BY 1) SELECT hour, n, round(sum(v) OVER (ORDER BY hour), 4) AS spent FROM h",
    "win_curve": "SELECT CAST(b AS double) AS bid, round(avg(CAST(value <= b AS integer)), 6) AS win_rate FROM (SELECT unnest(range(0, 101, 5)) AS b), events WHERE value IS NOT NULL GROUP BY 1",
}
