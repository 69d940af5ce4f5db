"""Queries of recommendation, candidate-set retrieval, policies and bids, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import policy as P
from millrace.operators import retrieval as R
from millrace.plans.experiments import _trial, off_policy, qini_curve
from millrace.plans.metrics import scored
from millrace.plans.retrieval import _DOCS, _TOKENS, _docs, _vectors, dense_run, _words
from millrace.plans.time_series import win_curve
from millrace.session import materialise
from millrace.sources.tables import table


def bm25_within(s, d):
    """Items against the documents of each type, a type being a collection with statistics of its own."""
    docs = _docs(s, d).join(table(s, d, "documents").select(F.col("doc_id").alias("doc"), "doc_type"), "doc").where(F.col("doc_type").isNotNull())
    types = docs.select("doc_type").distinct()
    asks = _words(table(s, d, "eval_items")).crossJoin(F.broadcast(types)).select(F.concat_ws("/", F.col("qid").cast("string"), "doc_type").alias("qid"), "doc_type", "words")  # six types
    return R.bm25(docs, asks, 3, within="doc_type").select("qid", "doc", F.round("score", 6).alias("score"), "place")


def _questions(s, d):
    return table(s, d, "qa_examples").where(F.col("question_id").isNotNull() & F.col("question").isNotNull()).groupBy(F.col("question_id").alias("id")).agg(F.min("question").alias("text"))


def worked_examples(s, d):
    """Three worked examples for every question whose hash is divisible by 50, from all questions."""
    q = materialise(_questions(s, d), "questions")
    asked = q.where(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("bigint") % 50 == 0)
    return R.examples_for(q, asked, 3).select("qid", "doc", F.round("score", 6).alias("score"), "place")


def approximate_run(s, d):
    v = _vectors(s, d)
    return R.nearest_by_planes(v.select("doc", "vector"), v.where(F.col("doc") % 50 == 0).select(F.col("doc").alias("qid"), "vector"), 10)


def approximate_recall(s, d):
    """Share of the exact run's neighbours that the approximate one finds."""
    a = approximate_run(s, d).select("qid", "doc", F.lit(1).alias("hit"))
    return dense_run(s, d).join(a, ["qid", "doc"], "left").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))


def _history(s, d):
    """Customers' order priorities, quantities as affinity; every second customer trains."""
    l = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return l.groupBy(F.col("o_custkey").alias("user"), F.col("p_brand").alias("item")).agg(F.count_if(F.col("l_quantity") > 45).cast("double").alias("affinity")).withColumn("train", F.col("user") % 2 == 0)


def _shown(s, d):
    l = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return l.groupBy(F.col("p_brand").alias("item")).agg(F.count_if(F.col("l_returnflag") == "R").alias("clicks"), F.count(F.lit(1)).alias("views"))


def _hybrid(s, d):
    return R.hybrid_scores(_history(s, d), _shown(s, d), 100.0)


def hybrid_candidates(s, d):
    return R.top_candidates(_hybrid(s, d), 10)


def _reranked(s, d):
    q = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("item"), "l_linenumber").agg(F.avg("l_tax").alias("q"))
    return R.rerank_candidates(hybrid_candidates(s, d), q, 3)


def reranked_slates(s, d):
    """Slates of three with their probability under a policy that explores one time in ten."""
    return P.slate_policy(_reranked(s, d), 25, 0.1).select("user", "item", "position", F.round("p", 6).alias("p"))


def logged_ranking(s, d):
    log = _history(s, d).where("not train and affinity > 0").select("user", "item", (F.col("user") % 3).alias("position"))
    return R.logged_metrics(log, hybrid_candidates(s, d), _reranked(s, d))


def clicks_per_view(s, d):
    """Views of each user by hour with the clicks of the same user and hour, 0 where there is none."""
    e = table(s, d, "events").withColumn("hour", F.hour("ts"))
    shown = e.where(F.col("event_type") == "view").groupBy("user_id", "hour").agg(F.count(F.lit(1)).alias("views"))
    return R.counted(shown, e.where(F.col("event_type") == "click"), ["user_id", "hour"]).groupBy("hour").agg(F.sum("views").alias("views"), F.sum("clicks").alias("clicks"), F.count_if(F.col("clicks") == 0).alias("without"))


def net_effect(s, d):
    return P.net_effect(_trial(s, d), "y", "t", F.col("score") > 0, 100.0, 1.5)


def qini_area(s, d):
    return P.curve_area(qini_curve(s, d), "n", "qini")


def largest_difference(s, d):
    """The largest absolute standardised difference."""
    x = P.standardised_differences(_trial(s, d), "t", ["score", "c_nationkey"])
    return x.agg(F.max(F.abs("smd")).alias("max_smd"), F.max_by("feature", F.abs("smd")).alias("feature"))


def off_policy_summary(s, d):
    return P.off_policy_summary(off_policy(s, d))


def factual_rate(s, d):
    return P.factual_rate(table(s, d, "events").select(F.pmod("event_id", F.lit(3)).alias("position"), (F.col("value") > 50).cast("int").alias("reward")), "position", "reward")


def _log(s, d):
    return table(s, d, "events").select(F.hour("ts").alias("hour"), F.pmod("event_id", F.lit(3)).alias("position"), F.col("event_type").alias("action"), (F.pmod("event_id", F.lit(2)) == 0).alias("fit"))


def smoothed_policy(s, d):
    p = P.smoothed_policy(_log(s, d).where("fit"), F.col("hour"), "action", "position", 0.5)
    return p.select("hour", "position", "action", F.round("p", 6).alias("p"))


def policy_variation(s, d):
    return P.total_variation(P.smoothed_policy(_log(s, d).where("fit"), F.col("hour"), "action", "position", 0.5), _log(s, d).where("not fit"))


def bidding_proxy(s, d):
    return P.bidding_proxy(scored(s, d), "y", "p", 1000.0)


def strategy_bids(s, d):
    x = scored(s, d).where(F.col("p") > 0)
    return x.groupBy("l_linestatus").agg(*[F.round(F.avg(P.bid(k, F.col("p"), 50.0, 0.4, 20.0)), 6).alias(k) for k in ("constant", "linear", "ortb")])


def winning_fit(s, d):
    """The hyperbolic winning curve nearest to the empirical one."""
    c = P.fit_winning_curve(win_curve(s, d))
    return win_curve(s, d).select("bid", "win_rate", F.round(F.col("bid") / (F.lit(c) + F.col("bid") + 1e-12), 6).alias("fitted"))


QUERIES = {f.__name__: f for f in (
    bm25_within, worked_examples, approximate_run, approximate_recall, hybrid_candidates, reranked_slates, logged_ranking, clicks_per_view, net_effect, qini_area, largest_difference, off_policy_summary,
    factual_rate, smoothed_policy, policy_variation, bidding_proxy, strategy_bids, winning_fit,
)}

_HYBRID = """hist AS (SELECT o_custkey AS u, p_brand AS i, CAST(count(*) FILTER (WHERE l_quantity > 45) AS double) AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
shown AS (SELECT p_brand AS i, count(*) FILTER (WHERE l_returnflag = 'R') AS c, count(*) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
pr AS (SELECT i, (c + 100 * (SELECT sum(c) / sum(v) FROM shown)) / (v + 100) AS p FROM shown), pop AS (SELECT i, (p - (SELECT min(p) FROM pr)) / greatest((SELECT max(p) - min(p) FROM pr), 1e-12) AS pop FROM pr),
tr AS (SELECT u, i FROM hist WHERE u % 2 = 0 AND a > 0), sz AS (SELECT i, count(*) AS n FROM tr GROUP BY 1),
sim AS (SELECT x.i, y.i AS o, count(*) / sqrt(any_value(sx.n) * any_value(sy.n)) AS s FROM tr x JOIN tr y ON x.u = y.u AND x.i <> y.i JOIN sz sx ON sx.i = x.i JOIN sz sy ON sy.i = y.i GROUP BY 1, 2),
cf AS (SELECT u, o AS i, sum(a * s) AS cf FROM hist JOIN sim USING (i) WHERE u % 2 = 1 AND a > 0 GROUP BY 1, 2),
hyb AS (SELECT g.u, g.i, 0.5 * pop + 0.5 * coalesce(cf / greatest(max(cf) OVER (PARTITION BY g.u), 1e-12), 0) AS score FROM (SELECT u, i, pop FROM (SELECT DISTINCT u FROM hist WHERE u % 2 = 1), pop) g LEFT JOIN cf USING (u, i)),
cand AS (SELECT u, i, CAST(row_number() OVER (PARTITION BY u ORDER BY round(score, 9) DESC, i) AS integer) AS place FROM hyb QUALIFY place <= 10),
q AS (SELECT i, avg(q) AS q FROM (SELECT p_brand AS i, l_linenumber, avg(l_tax) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) GROUP BY 1),
ranked AS (SELECT u, i, CAST(row_number() OVER (PARTITION BY u ORDER BY round(coalesce(q, 0), 9) DESC, place) AS integer) AS rk FROM cand LEFT JOIN q USING (i)),
rer AS (SELECT u, i, rk AS place FROM ranked WHERE rk <= 3)"""
_LOG = "lg AS (SELECT CAST(hour(ts) AS integer) AS hour, event_id % 3 AS position, event_type AS action, event_id % 2 = 0 AS fit FROM events)"
_SMOOTH = f"""{_LOG}, n AS (SELECT hour, position, action, count(*) AS n FROM lg WHERE fit GROUP BY 1, 2, 3), c AS (SELECT hour, position, sum(n) AS total FROM n GROUP BY 1, 2), acts AS (SELECT DISTINCT action FROM lg WHERE fit),
pol AS (SELECT hour, position, action, (coalesce(n, 0) + 0.5) / (total + 0.5 * (SELECT count(*) FROM acts)) AS p FROM c CROSS JOIN acts LEFT JOIN n USING (hour, position, action))"""
_PLACE = "CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS integer) AS place"

SQL = {
    "bm25_within": f"""WITH {_DOCS}, typed AS (SELECT doc, words, doc_type AS g FROM docs JOIN documents ON doc_id = doc WHERE doc_type IS NOT NULL), st AS (SELECT g, count(*) AS n, avg(len(words)) AS av FROM typed GROUP BY 1),
      tf AS (SELECT g, doc, len(words) AS len, word, count(*) AS tf FROM (SELECT g, doc, words, unnest(words) AS word FROM typed) GROUP BY ALL), raw AS (SELECT g, word, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf JOIN st USING (g) GROUP BY 1, 2),
      idf AS (SELECT g, word, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER (PARTITION BY g) ELSE idf END AS idf FROM raw), times AS (SELECT item_id, word, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS.format('item_text')}) AS word FROM eval_items) GROUP BY 1, 2),
      scores AS (SELECT item_id || '/' || g AS qid, doc, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / av))) AS score FROM tf JOIN idf USING (g, word) JOIN times USING (word) JOIN st USING (g) GROUP BY 1, 2)
      SELECT qid, doc, round(score, 6) AS score, {_PLACE} FROM scores QUALIFY place <= 3""",
    "worked_examples": f"""WITH q AS (SELECT question_id AS id, min(question) AS text FROM qa_examples WHERE question_id IS NOT NULL AND question IS NOT NULL GROUP BY 1), docs AS (SELECT id AS doc, text, {_TOKENS.format('text')} AS words FROM q),
      times AS (SELECT qid, qt, word, count(*) AS times FROM (SELECT doc AS qid, text AS qt, unnest(words) AS word FROM docs WHERE CAST('0x' || substr(md5(doc), 1, 8) AS bigint) % 50 = 0) GROUP BY ALL),
      tf AS (SELECT doc, text, len(words) AS len, word, count(*) AS tf FROM (SELECT doc, text, words, unnest(words) AS word FROM docs) GROUP BY ALL), raw AS (SELECT word, ln((SELECT count(*) FROM docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf GROUP BY 1),
      idf AS (SELECT word, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
      scores AS (SELECT qid, doc, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len(words)) FROM docs)))) AS score FROM tf JOIN idf USING (word) JOIN times USING (word) WHERE lower(text) <> lower(qt) GROUP BY 1, 2)
      SELECT qid, doc, round(score, 6) AS score, {_PLACE} FROM scores QUALIFY place <= 3""",
    "hybrid_candidates": f'WITH {_HYBRID} SELECT u AS "user", i AS item, place FROM cand',
    "reranked_slates": f'WITH {_HYBRID} SELECT u AS "user", i AS item, place AS position, round(0.9 + 0.1 / 25, 6) AS p FROM rer',
    "logged_ranking": f"""WITH {_HYBRID}, l AS (SELECT u, i, u % 3 AS position FROM hist WHERE u % 2 = 1 AND a > 0), j AS (SELECT l.position, c.place IS NOT NULL AS hit, r.place AS rp FROM l LEFT JOIN cand c USING (u, i) LEFT JOIN rer r USING (u, i)),
      p AS (SELECT position, count(*) AS n, avg(CAST(hit AS integer)) AS recall, avg(coalesce(1 / log2(rp + 1), 0)) AS ndcg FROM j GROUP BY 1) SELECT CAST(sum(n) AS bigint) AS clicks, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg FROM p""",
    "clicks_per_view": """WITH v AS (SELECT user_id, CAST(hour(ts) AS integer) AS hour, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1, 2), c AS (SELECT user_id, hour(ts) AS hour, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY 1, 2)
      SELECT hour, CAST(sum(views) AS bigint) AS views, CAST(sum(coalesce(clicks, 0)) AS bigint) AS clicks, count(*) FILTER (WHERE clicks IS NULL) AS without FROM v LEFT JOIN c USING (user_id, hour) GROUP BY 1""",
    "factual_rate": """WITH p AS (SELECT event_id % 3 AS k, count(*) AS n, avg(CAST(value > 50 AS integer)) AS r FROM events GROUP BY 1), t AS (SELECT CAST(sum(n) AS bigint) AS n, avg(r) AS rate, sqrt(sum(r * (1 - r) / n) / pow(count(*), 2)) * 1.96 AS h FROM p)
      SELECT n, round(rate, 6) AS rate, round(greatest(rate - h, 0), 6) AS lower, round(rate + h, 6) AS upper FROM t""",
    "smoothed_policy": f"WITH {_SMOOTH} SELECT hour, position, action, round(p, 6) AS p FROM pol",
    "policy_variation": f"""WITH {_SMOOTH}, h AS (SELECT hour, position, action, count(*) AS n FROM lg WHERE NOT fit GROUP BY 1, 2, 3), ht AS (SELECT hour, position, sum(n) AS total FROM h GROUP BY 1, 2),
      g AS (SELECT hour, position, sum(abs(p - coalesce(h.n / ht.total, 0))) / 2 AS tv, any_value(ht.total) AS total FROM pol JOIN ht USING (hour, position) LEFT JOIN h USING (hour, position, action) GROUP BY 1, 2) SELECT count(*) AS cells, round(sum(tv * total) / sum(total), 6) AS weighted_tv FROM g""",
    "bidding_proxy": "WITH x AS (SELECT CAST(l_returnflag = 'R' AS integer) AS y, round(0.8 * l_quantity / 50 + l_tax, 4) AS p FROM lineitem) SELECT round(1000 * sum(p), 4) AS estimated, CAST(1000 * sum(y) AS double) AS observed, round(1000 * sum(p) - 1000 * sum(y), 4) AS bias, round(abs(1000 * sum(p) - 1000 * sum(y)), 4) AS error, round(1000 * avg(p), 6) AS mean_bid FROM x",
    "strategy_bids": "WITH x AS (SELECT l_linestatus, round(0.8 * l_quantity / 50 + l_tax, 4) AS p FROM lineitem) SELECT l_linestatus, CAST(50 AS double) AS constant, round(avg(50 * p / 0.4), 6) AS linear, round(avg(sqrt(400 + 20 * 50 * p / 0.4) - 20), 6) AS ortb FROM x WHERE p > 0 GROUP BY 1",
}
