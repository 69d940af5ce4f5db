"""Queries of models, term weights and cost curves, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import finance as N
from millrace.operators import learners as L
from millrace.operators import metrics as M
from millrace.operators import models as D
from millrace.operators import retrieval as R
from millrace.plans.metrics import _S, GRID, scored
from millrace.plans.retrieval import _DENSE, _DOCS, _QA, _TOKENS, _docs, _scores, dense_run
from millrace.sources.tables import table


def woe_bins(s, d):
    x = table(s, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.ceil(F.col("l_quantity") / 10).cast("int").alias("b"))
    return D.weight_of_evidence(x, F.col("b"), "y").select("bin", "n", "bad", F.round("woe", 6).alias("woe"), F.round("iv", 6).alias("iv"))


def score_points(s, d):
    x = scored(s, d).where((F.col("p") > 0) & (F.col("p") < 1))
    return x.select("l_orderkey", "l_linenumber", F.round(D.points(F.col("p")), 4).alias("points"))


def platt_scaled(s, d):
    return D.platt(scored(s, d), "y", "p").groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("platt"), 4).alias("mean"))


def isotonic_scaled(s, d):
    return D.isotonic(scored(s, d), "y", "p").groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("isotonic"), 4).alias("mean"))


def tfidf_items(s, d):
    x = table(s, d, "eval_items").select(F.col("item_id").alias("doc"), R.tokens(F.col("item_text")).alias("words"))
    return D.tfidf(x).select("doc", "word", F.round("weight", 6).alias("weight"))


def tfidf_documents(s, d):
    return D.tfidf(_docs(s, d)).select("doc", "word", F.round("weight", 6).alias("weight"))


def signed_ranks(s, d):
    w = _scores(s, d).groupBy("question_id").pivot("version", ["a", "b"]).agg(F.first("f1"))
    return D.signed_ranks(w.withColumn("diff", F.col("b") - F.col("a")), "diff")


def tune_scale(s, d):
    e = table(s, d, "events").where(F.col("value") > 0)
    return D.tune_scale(e, F.round(F.col("value") / (1 + F.pmod("event_id", F.lit(7))), 6), "value", "event_id", 5000.0).select("scale", F.round("cost", 4).alias("cost"))


def cutoff_curve(s, d):
    w = _scores(s, d).groupBy("question_id").pivot("version", ["a", "b"]).agg(F.first("f1")).withColumn("p", F.conv(F.substring(F.md5("question_id"), 1, 4), 16, 10).cast("int") / 65536.0)
    return D.cutoff_curve(w, "p", ("a", "b"), (1.0, 5.0), GRID).select("cutoff", F.round("share", 6).alias("share"), F.round("quality", 6).alias("quality"), "cost")


def route_check(s, d):
    """Orders of each customer as stops of a route, at places made from their keys."""
    o = table(s, d, "orders").withColumn("stop_no", F.col("o_orderkey"))
    x = o.select(F.col("o_custkey").alias("route"), "stop_no", F.pmod("o_orderkey", F.lit(97)).cast("double").alias("x"), F.pmod("o_orderkey", F.lit(89)).cast("double").alias("y"), F.lit(1.0).alias("demand"), F.lit(0.0).alias("ready"), (F.pmod("o_orderkey", F.lit(13)) * 100.0).alias("due"), F.lit(5.0).alias("service"))
    return D.check_routes(x, 1.0, 12.0)


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _labelled(s, d):
    return table(s, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))


def boosted_scores(s, d):
    """Boosted trees fitted on early lines, judged on late ones."""
    x = _labelled(s, d).withColumn("late", F.col("l_orderkey") % 5 == 0)
    model = L.fit_probability(x.where("not late"), FEATURES, "y", trees=5)
    return M.log_loss_brier(L.probability(model, x.where("late"), FEATURES, "p"), "y", "p")


def importance_shares(s, d):
    share = L.importance_share(L.fit_probability(_labelled(s, d), FEATURES, "y", trees=3), FEATURES)
    return s.createDataFrame(sorted(share.items()), "feature string, share double")


def learned_ranking(s, d):
    """Products ranked by trees on their gains, fitted on even queries and judged on odd ones."""
    x = table(s, d, "shopping_queries_dataset_examples").where(F.col("query_id").isNotNull() & F.col("product_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    letter = F.upper(F.substring(F.trim("esci_label"), 1, 1))
    per = x.groupBy(F.col("query_id").alias("qid"), F.col("product_id").alias("doc")).agg(F.max("score").alias("score"), F.avg("score").alias("mean"), F.count(F.lit(1)).cast("double").alias("chunks"), F.max(F.when(letter == "E", 3).when(letter == "S", 2).when(letter == "C", 1).otherwise(0)).alias("grade"))
    model = L.fit_gains(per.where("qid % 2 = 0"), ["score", "mean", "chunks"], "grade", trees=3)
    ranked = L.gain_scores(model, per.where("qid % 2 = 1"), ["score", "mean", "chunks"], "learned")
    m = R.run_metrics(R.place(ranked.select("qid", "doc", F.col("learned").alias("score")), 10), ranked.select("qid", "doc", "grade"), 10)
    return m.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ndcg"), 4).alias("ndcg"))


def uplift_learners(s, d):
    """Mean uplift by four learners, by segment."""
    from millrace.plans.experiments import _trial

    u = L.uplift_scores(_trial(s, d), ["score", "c_nationkey"], "y", "t", ["c_custkey"])
    return u.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 3).alias(c) for c in ("u_two", "u_one", "u_class", "u_x")])


def scorecard_values(s, d):
    """Weights of evidence fitted on early lines and looked up for late ones."""
    x = _labelled(s, d)
    card = L.fit_scorecard(x.where("l_orderkey % 5 <> 0"), ["l_quantity"], "y", 5)
    late = card.transform(x.where("l_orderkey % 5 = 0"))
    return late.groupBy(F.round("woe_l_quantity", 6).alias("woe")).agg(F.count(F.lit(1)).alias("n"))


def question_likeness(s, d):
    """Cosine of words and word pairs of questions whose titles are alike in the alphabet's order."""
    from pyspark.sql import Window

    q = table(s, d, "qa_examples").where(F.col("question_id").isNotNull() & F.col("question").isNotNull() & F.col("title").isNotNull()).groupBy(F.col("question_id").alias("doc")).agg(F.min("question").alias("question"), F.min("title").alias("title"))
    w = D.tfidf(q.select("doc", L.ngrams(R.tokens(F.col("question"))).alias("words")))
    by_letter = Window.partitionBy(F.substring("title", 1, 2)).orderBy("title", "doc")
    pairs = q.select(F.col("doc").alias("a"), F.lead("doc").over(by_letter).alias("b")).where(F.col("b").isNotNull())
    return L.pair_cosine(w, pairs).select("a", "b", F.round("cosine", 6).alias("cosine"))


def greedy_routes(s, d):
    """Orders of each customer as stops of an instance, at most five vehicles each."""
    o = table(s, d, "orders")
    x = o.select(F.col("o_custkey").alias("instance"), F.col("o_orderkey").alias("id"), F.pmod("o_orderkey", F.lit(97)).cast("double").alias("x"), F.pmod("o_orderkey", F.lit(89)).cast("double").alias("y"), F.lit(1.0).alias("demand"), F.lit(0.0).alias("ready"), (200 + F.pmod("o_orderkey", F.lit(400))).cast("double").alias("due"), F.lit(5.0).alias("service"))
    r = L.greedy_routes(x, 6.0, 5, 900.0)
    return r.groupBy("instance").agg(F.max("vehicle").alias("vehicles"), F.count(F.lit(1)).alias("served"), F.round(F.max("start"), 4).alias("last_start"))


def nearest_assignments(s, d):
    """Customers and suppliers of a nation as riders and orders."""
    at = lambda k: [F.col(f"{k}key").alias("id"), F.pmod(F.col(f"{k}key") * 37, F.lit(101)).cast("double").alias("x"), F.pmod(F.col(f"{k}key") * 53, F.lit(103)).cast("double").alias("y")]
    riders = table(s, d, "supplier").select(F.col("s_nationkey").alias("zone"), *at("s_supp"))
    return L.nearest_assignments(riders, table(s, d, "customer").select(F.col("c_nationkey").alias("zone"), *at("c_cust"))).select("zone", "rider", "order", F.round("distance", 6).alias("distance"))


def mock_usage(s, d):
    """Tokens and cost of documents as prompts of a mock provider that answers with sixteen tokens, by type."""
    t = table(s, d, "documents").where(F.col("text").isNotNull()).withColumn("tokens", N.mock_tokens(F.col("text")))
    return t.groupBy("doc_type").agg(F.sum("tokens").alias("tokens"), F.round(F.sum(N.token_cost(F.col("tokens"), F.lit(16), 0.5, 1.5)), 6).alias("cost"))


def failure_causes(s, d):
    """Questions of vectors: whether a vector of the same label is among the first three, and whether the first one is."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("doc"), "label")
    q = v.where(F.col("doc") % 50 == 0).select(F.col("doc").alias("qid"), F.col("label").alias("ql"))
    r = dense_run(s, d).join(v, "doc").join(q, "qid")
    rows = r.groupBy("qid").agg(F.max((F.col("place") <= 3) & (F.col("label") == F.col("ql"))).alias("found"), F.max((F.col("place") == 1) & (F.col("label") == F.col("ql"))).alias("right"))
    return D.routing_rates(rows)


def proportion_gap(s, d):
    g = scored(s, d).agg(F.sum(F.when(F.col("l_linestatus") == "O", F.col("y"))).alias("k1"), F.count_if(F.col("l_linestatus") == "O").alias("n1"), F.sum(F.when(F.col("l_linestatus") == "F", F.col("y"))).alias("k2"), F.count_if(F.col("l_linestatus") == "F").alias("n2"))
    diff, lo, hi = N.proportion_difference(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"))
    return g.select(F.round(diff, 6).alias("difference"), F.round(lo, 6).alias("lower"), F.round(hi, 6).alias("upper"))


QUERIES = {f.__name__: f for f in (woe_bins, score_points, platt_scaled, isotonic_scaled, tfidf_items, tfidf_documents, signed_ranks, tune_scale, cutoff_curve, route_check, boosted_scores, importance_shares, learned_ranking, uplift_learners, scorecard_values, question_likeness, greedy_routes, nearest_assignments, mock_usage, failure_causes, proportion_gap)}

SQL = {
    "mock_usage": "SELECT doc_type, CAST(sum(ceil(length(text) / 4.0)) AS bigint) AS tokens, round(sum((ceil(length(text) / 4.0) * 0.5 + 16 * 1.5) / 1000000), 6) AS cost FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "scorecard_values": """WITH x AS (SELECT l_quantity AS v, CAST(l_returnflag = 'R' AS integer) AS y, l_orderkey % 5 = 0 AS late FROM lineitem), e AS (SELECT list_sort(list_distinct(quantile_cont(v, [0.2, 0.4, 0.6, 0.8]))) AS e FROM x WHERE NOT late),
      b AS (SELECT y, late, len(list_filter(e, lambda t: v > t)) AS bin FROM x, e), g AS (SELECT bin, count(*) AS n, sum(y) AS bad FROM b WHERE NOT late GROUP BY 1),
      w AS (SELECT bin, ln(((n - bad + 0.5) / (sum(n - bad) OVER () + 0.5)) / ((bad + 0.5) / (sum(bad) OVER () + 0.5))) AS woe FROM g) SELECT round(coalesce(woe, 0), 6) AS woe, count(*) AS n FROM b LEFT JOIN w USING (bin) WHERE late GROUP BY 1""",
    "question_likeness": r"""WITH q AS (SELECT question_id AS doc, min(question) AS question, min(title) AS title FROM qa_examples WHERE question_id IS NOT NULL AND question IS NOT NULL AND title IS NOT NULL GROUP BY 1),
      t AS (SELECT doc, title, regexp_extract_all(lower(question), '[a-z0-9]+') AS w FROM q), g AS (SELECT doc, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS word FROM t),
      tf AS (SELECT doc, word, count(*) AS tf FROM g GROUP BY 1, 2), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1), raw AS (SELECT doc, word, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM q)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (word)),
      wt AS (SELECT doc, word, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM raw), p AS (SELECT doc AS a, lead(doc) OVER (PARTITION BY substr(title, 1, 2) ORDER BY title, doc) AS b FROM q),
      m AS (SELECT a, b, sum(x.w * y.w) AS c FROM p JOIN wt x ON x.doc = a JOIN wt y ON y.doc = b AND y.word = x.word GROUP BY 1, 2) SELECT p.a, p.b, round(coalesce(c, 0), 6) AS cosine FROM p LEFT JOIN m USING (a, b) WHERE p.b IS NOT NULL""",
    "woe_bins": """WITH g AS (SELECT CAST(ceil(l_quantity / 10) AS integer) AS bin, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS bad FROM lineitem GROUP BY 1),
      s AS (SELECT *, (bad + 0.5) / (sum(bad) OVER () + 0.5) AS b, (n - bad + 0.5) / (sum(n - bad) OVER () + 0.5) AS g FROM g) SELECT bin, n, bad, round(ln(g / b), 6) AS woe, round((g - b) * ln(g / b), 6) AS iv FROM s""",
    "score_points": f"WITH {_S} SELECT l_orderkey, l_linenumber, round(600 - 20 / ln(2) * ln(50) + 20 / ln(2) * ln((1 - p) / p), 4) AS points FROM x WHERE p > 0 AND p < 1",
    "tfidf_items": f"""WITH w AS (SELECT item_id AS doc, unnest({_TOKENS.format('item_text')}) AS word FROM eval_items), tf AS (SELECT doc, word, count(*) AS tf FROM w GROUP BY 1, 2), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
      r AS (SELECT doc, word, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM eval_items)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (word)) SELECT doc, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc)), 6) AS weight FROM r""",
    "tfidf_documents": f"""WITH {_DOCS}, tf AS (SELECT doc, word, count(*) AS tf FROM (SELECT doc, unnest(words) AS word FROM docs) GROUP BY 1, 2), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
      r AS (SELECT doc, word, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM docs)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (word)) SELECT doc, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc)), 6) AS weight FROM r""",
    "signed_ranks": f"WITH {_QA}, x AS (SELECT b - a AS diff, round(abs(b - a), 9) AS k FROM wide WHERE b <> a), r AS (SELECT diff, rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2 AS r FROM x) SELECT coalesce(sum(r) FILTER (WHERE diff > 0), 0) AS w_plus, coalesce(sum(r) FILTER (WHERE diff < 0), 0) AS w_minus, count(*) AS n FROM r",
    "tune_scale": "WITH g AS (SELECT round(value / (1 + event_id % 7), 6) AS scale, sum(value) AS c FROM events WHERE value > 0 GROUP BY 1), r AS (SELECT scale, sum(c) OVER (ORDER BY scale) AS cost FROM g) SELECT max(scale) AS scale, round(max(cost), 4) AS cost FROM r WHERE cost <= 5000",
    "cutoff_curve": f"WITH {_QA}, x AS (SELECT a, b, CAST('0x' || substr(md5(question_id), 1, 4) AS integer) / 65536.0 AS p FROM wide), g AS (SELECT unnest([{', '.join(map(str, GRID))}]) AS c) SELECT CAST(c AS double) AS cutoff, round(avg(CAST(p >= c AS integer)), 6) AS share, round(avg(CASE WHEN p >= c THEN b ELSE a END), 6) AS quality, CAST(sum(CASE WHEN p >= c THEN 5 ELSE 1 END) AS double) AS cost FROM x, g GROUP BY 1",
    "failure_causes": f"WITH {_DENSE}, r AS (SELECT d1.qid, bool_or(place <= 3 AND label = ql) AS found, bool_or(place = 1 AND label = ql) AS rgt FROM d1 JOIN v USING (doc) JOIN q ON q.qid = d1.qid GROUP BY 1) SELECT CASE WHEN NOT found THEN 'retrieval' WHEN NOT rgt THEN 'generation' ELSE 'success' END AS cause, count(*) AS n FROM r GROUP BY 1",
    "proportion_gap": f"WITH {_S}, g AS (SELECT avg(y) FILTER (WHERE l_linestatus = 'O') AS p, count(*) FILTER (WHERE l_linestatus = 'O') AS n, avg(y) FILTER (WHERE l_linestatus = 'F') AS q, count(*) FILTER (WHERE l_linestatus = 'F') AS m FROM x) SELECT round(p - q, 6) AS difference, round(p - q - 1.96 * sqrt(p*(1-p)/n + q*(1-q)/m), 6) AS lower, round(p - q + 1.96 * sqrt(p*(1-p)/n + q*(1-q)/m), 6) AS upper FROM g",
}
