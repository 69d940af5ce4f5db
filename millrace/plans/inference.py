"""Queries of resampling, tests, link scores and forecasts' slices, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import answers as A
from millrace.operators import inference as I
from millrace.operators import metrics as M
from millrace.operators import models as D
from millrace.operators import retrieval as R
from millrace.plans.metrics import _POISSON, psi_hist, psi_missing, scored
from millrace.plans.retrieval import _QA, _scores
from millrace.sources.tables import table

GRID = [round(0.05 * k, 2) for k in range(4, 21)]


def _differences(s, d):
    w = _scores(s, d).groupBy("question_id", "impossible").pivot("version", ["a", "b"]).agg(F.first("f1"))
    return w.select("question_id", F.when(F.col("impossible"), "impossible").otherwise("answerable").alias("segment"), F.round(F.col("b") - F.col("a"), 6).alias("diff"))


def paired_bootstrap(s, d):
    """Interval of the mean F1 gain by segment, over resampled questions."""
    return I.interval(I.bootstrap(_differences(s, d), ["segment"], ["question_id"], F.col("diff"), F.lit(1), 200), ["segment"])


def stratified_bootstrap(s, d):
    """Interval of the share of dear events by type, resampled within days."""
    e = table(s, d, "events").withColumn("day", F.to_date("ts"))
    return I.interval(I.bootstrap(e, ["event_type"], ["event_id"], (F.col("value") > 50).cast("int"), F.lit(1), 50, ["day"]), ["event_type"])


def _links(s, d):
    return scored(s, d).select("l_orderkey", "l_linestatus", (F.col("y") == 1).alias("truth"), (F.col("p") >= 0.6).alias("old"), (F.col("p") >= 0.4).alias("new"))


def document_bootstrap(s, d):
    """Interval of the micro F1, whole orders being resampled."""
    per = I.link_scores(_links(s, d), ["l_orderkey", "l_linestatus"], F.col("truth"), F.col("new"))
    r = I.bootstrap(per, ["l_linestatus"], ["l_orderkey"], 2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), 20)
    return I.interval(r, ["l_linestatus"])


def link_scores(s, d):
    return I.link_scores(_links(s, d), ["l_linestatus"], F.col("truth"), F.col("new"))


def document_f1(s, d):
    """Mean F1 over orders; an order without links counts as 0."""
    per = I.link_scores(_links(s, d), ["l_orderkey"], F.col("truth"), F.col("new"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f1"), 6).alias("mean_f1"), F.count_if(F.col("f1") == 0).alias("n_zero"))


def error_transitions(s, d):
    x = _links(s, d).select("l_linestatus", I.transition(F.col("truth"), F.col("old"), F.col("new")).alias("transition"))
    return x.where(F.col("transition").isNotNull()).groupBy("l_linestatus", "transition").agg(F.count(F.lit(1)).alias("n"))


def paired_p_values(s, d):
    return I.paired_tests(_differences(s, d), ["segment"], "diff")


def signed_rank_p(s, d):
    return I.signed_rank_test(D.signed_ranks(_differences(s, d), "diff"))


def mean_intervals(s, d):
    return I.mean_intervals(table(s, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice"])


def sample_size_power(s, d):
    return I.sample_size_power(_differences(s, d), "diff", [10, 50, 200], 500)


def count_bootstrap(s, d):
    x = _links(s, d).withColumn("diff", (F.col("new") == F.col("truth")).cast("int") - (F.col("old") == F.col("truth")).cast("int"))
    counts = x.groupBy("l_linestatus").agg(F.count_if(F.col("diff") == -1).alias("down"), F.count_if(F.col("diff") == 1).alias("up"), F.count(F.lit(1)).alias("n"))
    return I.count_bootstrap(counts, ["l_linestatus"], 500, 0.95)


def _forecast(s, d):
    l = table(s, d, "lineitem")
    q = l.groupBy("l_linenumber").agg(*[F.percentile("l_quantity", p).alias(f"q{int(100 * p)}") for p in (0.1, 0.5, 0.9)], F.avg("l_quantity").alias("point"))
    x = l.join(F.broadcast(q), "l_linenumber")  # one row per line number
    models = F.explode(F.array(F.struct(F.lit("point").alias("model"), F.array("point", "point", "point").alias("q")), F.struct(F.lit("quantile").alias("model"), F.array("q10", "q50", "q90").alias("q")))).alias("m")
    return x.select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("y"), models).select("l_returnflag", "l_linestatus", "y", "m.model", "m.q")


def slice_matrix(s, d):
    """Pinball loss, coverage and error of two forecasts by scope, segment and both, and in all."""
    x = _forecast(s, d)
    loss = sum((M.pinball(F.col("y"), F.col("q")[i], p) for i, p in enumerate((0.1, 0.5, 0.9))), F.lit(0.0)) / 3
    sets = [["model", "l_returnflag", "l_linestatus"], ["model", "l_returnflag"], ["model", "l_linestatus"], ["model"]]
    inside = F.when(F.col("model") == "quantile", F.col("y").between(F.col("q")[0], F.col("q")[2]).cast("double"))
    g = x.groupingSets(sets, "model", "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(inside), 6).alias("coverage"), F.round(F.avg(loss), 6).alias("pinball"), F.round(F.sqrt(F.avg(F.pow(F.col("y") - F.col("q")[1], 2))), 6).alias("rmse"))
    return g.select("model", F.coalesce("l_returnflag", F.lit("all")).alias("segment"), F.coalesce("l_linestatus", F.lit("all")).alias("scope"), "n", "coverage", "pinball", "rmse")


def crossing_quantiles(s, d):
    raw = F.array(F.col("l_quantity"), F.col("l_quantity") * 0.9 + F.col("l_discount") * 50, F.col("l_quantity") + F.col("l_tax") * 10)
    ordered, crossed = I.rearranged(raw)
    x = table(s, d, "lineitem").select("l_returnflag", ordered.alias("q"), crossed.alias("crossed"))
    return x.groupBy("l_returnflag").agg(F.round(F.avg(F.col("crossed").cast("double")), 6).alias("crossing_rate"), *[F.round(F.avg(F.col("q")[i]), 4).alias(f"q{i}") for i in range(3)])


def hierarchy_rollup(s, d):
    """Daily counts of each event type and of all together, each series with its share of low days."""
    n = table(s, d, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("level")).agg(F.count(F.lit(1)).alias("qty"))
    return I.with_total(n, ["day"], "qty", "level").groupBy("level").agg(F.count(F.lit(1)).alias("days"), F.sum("qty").alias("total"), F.max("qty").alias("top"), F.round(F.stddev_pop("qty"), 6).alias("spread"))


def segment_profiles(s, d):
    """Predictions joined with their item's segment: items and mean error by fold and segment."""
    x = scored(s, d).select("l_linestatus", "l_linenumber", F.col("l_linestatus").alias("fold"), F.abs(F.col("p") - F.col("y")).alias("e"))
    seg = scored(s, d).groupBy(F.col("l_linestatus").alias("fold"), "l_linenumber").agg(F.when(F.avg("y") >= 1 / 3, "high").otherwise("low").alias("segment"))
    j = x.join(F.broadcast(seg), ["fold", "l_linenumber"], "left")  # one row per line number
    return j.groupBy("fold", "segment").agg(F.count_distinct("l_linenumber").alias("items"), F.round(F.avg("e"), 6).alias("mean_error"))


def psi_by_variant(s, d):
    """PSI of features in two variants of a table, ranked within each, and each feature's share of the variant's sum."""
    from pyspark.sql import Window

    both = psi_hist(s, d).withColumn("variant", F.lit("whole")).unionByName(psi_missing(s, d).withColumn("variant", F.lit("gaps"))).select("variant", "feature", "psi")
    w = Window.partitionBy("variant")
    return I.ranked_within(both, ["variant"], "psi", "feature").withColumn("share", F.round(F.col("psi") / F.nullif(F.sum("psi").over(w), F.lit(0.0)), 4)).select("variant", "feature", "place", "psi", "share")


def incomplete_pairs(s, d):
    """Questions that lack one of the two matched answers."""
    qa = table(s, d, "qa_examples").where(F.col("question_id").isNotNull()).groupBy("question_id").agg(F.count("answer_a").alias("a"), F.count("answer_b").alias("b"))
    return qa.where((F.col("a") == 0) | (F.col("b") == 0)).select("question_id", (F.col("a") > 0).alias("has_a"), (F.col("b") > 0).alias("has_b"))


def role_pairs(s, d):
    """Each returned line of an order with each of its other lines, with their layout: roles meet within a document only."""
    l = table(s, d, "lineitem")
    box = lambda n: [F.col("l_linenumber").alias(f"{n}_line"), (F.col("l_linenumber") * 10.0).alias(f"{n}_x1"), (F.col("l_linenumber") * 10.0 + F.col("l_quantity")).alias(f"{n}_x2"), F.col("l_quantity").alias(f"{n}_y1"), (F.col("l_quantity") + 8).alias(f"{n}_y2")]
    q = l.where(F.col("l_returnflag") == "R").select("l_orderkey", *box("q"))
    a = l.where(F.col("l_returnflag") == "N").select("l_orderkey", *box("a"))
    v = I.layout_vector("q", "a", F.lit(100.0), F.lit(60.0))
    return q.join(a, "l_orderkey").select("l_orderkey", "q_line", "a_line", *[F.round(c, 6).alias(k) for k, c in v.items()])


def _questions(s, d):
    qa = table(s, d, "qa_examples").where(F.col("question").isNotNull() & F.col("question_id").isNotNull() & F.col("title").isNotNull()).dropDuplicates(["question_id"])
    return qa.select("question_id", "title", A.canonical_question(F.col("question")).alias("form"), F.array_distinct(R.tokens(F.col("question"))).alias("words"))


def _jaccard(a, b):
    return M.ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def reuse_curve(s, d):
    """Reuse of an answer for a reworded question against the likeliest wrong one of the same title, by word overlap."""
    q = _questions(s, d)
    hard = I.hardest_negative(q, q, ["title"], "question_id", "form", _jaccard(F.col("l_words"), F.col("r_words")))
    x = q.join(hard, "question_id").withColumn("positive", _jaccard(F.col("words"), F.array_union("words", F.array(F.lit("please"), F.lit("tell")))))
    return I.reuse_curve(x, "positive", "hardest", GRID)


QUERIES = {f.__name__: f for f in (
    paired_bootstrap, stratified_bootstrap, document_bootstrap, link_scores, document_f1, error_transitions, paired_p_values, signed_rank_p, mean_intervals, sample_size_power, count_bootstrap,
    slice_matrix, crossing_quantiles, hierarchy_rollup, segment_profiles, psi_by_variant, incomplete_pairs, role_pairs, reuse_curve,
)}

_L = "links AS (SELECT l_orderkey, l_linestatus, l_linenumber, l_returnflag = 'R' AS truth, round(0.8 * l_quantity / 50 + l_tax, 4) >= 0.6 AS old, round(0.8 * l_quantity / 50 + l_tax, 4) >= 0.4 AS new FROM lineitem)"
_PRF = "round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"
_COUNTS = "count(*) FILTER (WHERE truth AND new) AS tp, count(*) FILTER (WHERE NOT truth AND new) AS fp, count(*) FILTER (WHERE truth AND NOT new) AS fn"
_U = "CAST('0x' || substr(md5({} || '|' || r), 1, 8) AS bigint) / 4294967296.0"
_CI = "round(quantile_cont(value, 0.025), 6) AS lower, round(quantile_cont(value, 0.975), 6) AS upper, count(value) AS n_replicates"
_PIN = " + ".join(f"greatest({p} * (y - q{int(100 * p)}), ({p} - 1) * (y - q{int(100 * p)}))" for p in (0.1, 0.5, 0.9))
_BOX = "l_linenumber AS {0}_line, l_linenumber * 10.0 AS {0}_x1, l_linenumber * 10.0 + l_quantity AS {0}_x2, l_quantity AS {0}_y1, l_quantity + 8 AS {0}_y2"

SQL = {
    "paired_bootstrap": f"""WITH {_QA}, x AS (SELECT question_id, CASE WHEN impossible THEN 'impossible' ELSE 'answerable' END AS segment, round(b - a, 6) AS diff FROM wide),
      r AS (SELECT segment, diff, r, {_U.format('question_id')} AS u FROM x, range(200) t(r)), w AS (SELECT segment, diff, r, CASE {_POISSON} ELSE 8 END AS w FROM r),
      m AS (SELECT segment, r, sum(w * diff) / nullif(sum(w), 0) AS value FROM w GROUP BY 1, 2) SELECT segment, {_CI} FROM m GROUP BY 1""",
    "stratified_bootstrap": f"""WITH r AS (SELECT event_type, CAST(ts AS date) AS day, CAST(value > 50 AS integer) AS v, r, {_U.format('event_id')} AS u FROM events, range(50) t(r)), w AS (SELECT *, CASE {_POISSON} ELSE 8 END AS w FROM r),
      c AS (SELECT event_type, day, r, sum(w * v) / nullif(sum(w), 0) AS m, count(*) AS n FROM w GROUP BY 1, 2, 3), m AS (SELECT event_type, r, sum(n * m) / nullif(sum(n) FILTER (WHERE m IS NOT NULL), 0) AS value FROM c GROUP BY 1, 2)
      SELECT event_type, {_CI} FROM m GROUP BY 1""",
    "document_bootstrap": f"""WITH {_L}, p AS (SELECT l_orderkey, l_linestatus, {_COUNTS} FROM links GROUP BY 1, 2), r AS (SELECT *, {_U.format('l_orderkey')} AS u FROM p, range(20) t(r)), w AS (SELECT *, CASE {_POISSON} ELSE 8 END AS w FROM r),
      m AS (SELECT l_linestatus, r, sum(w * 2 * tp) / nullif(sum(w * (2 * tp + fp + fn)), 0) AS value FROM w GROUP BY 1, 2) SELECT l_linestatus, {_CI} FROM m GROUP BY 1""",
    "link_scores": f"WITH {_L}, c AS (SELECT l_linestatus, {_COUNTS} FROM links GROUP BY 1) SELECT *, {_PRF} FROM c",
    "document_f1": f"WITH {_L}, c AS (SELECT l_orderkey, {_COUNTS} FROM links GROUP BY 1), f AS (SELECT {_PRF} FROM c) SELECT count(*) AS n, round(avg(f1), 6) AS mean_f1, count(*) FILTER (WHERE f1 = 0) AS n_zero FROM f",
    "error_transitions": f"""WITH {_L} SELECT l_linestatus, CASE WHEN new = truth THEN 'fixed' WHEN old = truth THEN 'regressed' WHEN truth THEN 'both_missed' ELSE 'both_false_positive' END AS transition, count(*) AS n
      FROM links WHERE NOT (old = truth AND new = truth) GROUP BY 1, 2""",
    "slice_matrix": f"""WITH q AS (SELECT l_linenumber, quantile_cont(l_quantity, 0.1) AS q10, quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.9) AS q90, avg(l_quantity) AS point FROM lineitem GROUP BY 1),
      x AS (SELECT 'quantile' AS model, l_returnflag, l_linestatus, l_quantity AS y, q10, q50, q90 FROM lineitem JOIN q USING (l_linenumber) UNION ALL SELECT 'point', l_returnflag, l_linestatus, l_quantity, point, point, point FROM lineitem JOIN q USING (l_linenumber))
      SELECT model, coalesce(l_returnflag, 'all') AS segment, coalesce(l_linestatus, 'all') AS scope, count(*) AS n, CASE WHEN model = 'quantile' THEN round(avg(CAST(y BETWEEN q10 AND q90 AS integer)), 6) END AS coverage,
      round(avg(({_PIN}) / 3), 6) AS pinball, round(sqrt(avg(pow(y - q50, 2))), 6) AS rmse FROM x GROUP BY GROUPING SETS ((model, l_returnflag, l_linestatus), (model, l_returnflag), (model, l_linestatus), (model))""",
    "crossing_quantiles": """WITH x AS (SELECT l_returnflag, l_quantity AS a, l_quantity * 0.9 + l_discount * 50 AS b, l_quantity + l_tax * 10 AS c FROM lineitem)
      SELECT l_returnflag, round(avg(CAST(b < a OR c < b AS integer)), 6) AS crossing_rate, round(avg(least(a, b, c)), 4) AS q0, round(avg(list_sort([a, b, c])[2]), 4) AS q1, round(avg(greatest(a, b, c)), 4) AS q2 FROM x GROUP BY 1""",
    "hierarchy_rollup": """WITH n AS (SELECT CAST(ts AS date) AS day, event_type AS level, count(*) AS qty FROM events GROUP BY 1, 2), a AS (SELECT * FROM n UNION ALL SELECT day, 'total', CAST(sum(qty) AS bigint) FROM n GROUP BY 1)
      SELECT level, count(*) AS days, CAST(sum(qty) AS bigint) AS total, max(qty) AS top, round(stddev_pop(qty), 6) AS spread FROM a GROUP BY 1""",
    "segment_profiles": """WITH x AS (SELECT l_linestatus AS fold, l_linenumber, CAST(l_returnflag = 'R' AS integer) AS y, abs(round(0.8 * l_quantity / 50 + l_tax, 4) - CAST(l_returnflag = 'R' AS integer)) AS e FROM lineitem),
      g AS (SELECT fold, l_linenumber, CASE WHEN avg(y) >= 1.0 / 3 THEN 'high' ELSE 'low' END AS segment FROM x GROUP BY 1, 2) SELECT fold, segment, count(DISTINCT l_linenumber) AS items, round(avg(e), 6) AS mean_error FROM x JOIN g USING (fold, l_linenumber) GROUP BY 1, 2""",
    "incomplete_pairs": "WITH q AS (SELECT question_id, count(answer_a) > 0 AS has_a, count(answer_b) > 0 AS has_b FROM qa_examples WHERE question_id IS NOT NULL GROUP BY 1) SELECT * FROM q WHERE NOT (has_a AND has_b)",
    "role_pairs": f"""WITH p AS (SELECT * FROM (SELECT l_orderkey, {_BOX.format('q')} FROM lineitem WHERE l_returnflag = 'R') JOIN (SELECT l_orderkey, {_BOX.format('a')} FROM lineitem WHERE l_returnflag = 'N') USING (l_orderkey)),
      v AS (SELECT *, ((a_x1 + a_x2) / 2 - (q_x1 + q_x2) / 2) / 100 AS dx, ((a_y1 + a_y2) / 2 - (q_y1 + q_y2) / 2) / 60 AS dy, greatest(q_x2 - q_x1, 1) AS qw, greatest(a_x2 - a_x1, 1) AS aw FROM p)
      SELECT l_orderkey, q_line, a_line, round(dx, 6) AS dx, round(dy, 6) AS dy, round(abs(dx), 6) AS abs_dx, round(abs(dy), 6) AS abs_dy, round(sqrt(dx * dx + dy * dy), 6) AS distance, CAST(abs((a_y1 + a_y2) / 2 - (q_y1 + q_y2) / 2) <= 12 AS double) AS same_row,
      round(greatest(0, least(q_x2, a_x2) - greatest(q_x1, a_x1)) / greatest(least(qw, aw), 1), 6) AS overlap, CAST((a_y1 + a_y2) > (q_y1 + q_y2) AS double) AS below, round(aw / qw, 6) AS width_ratio, CAST(1 AS double) AS height_ratio FROM v""",
    "reuse_curve": f"""WITH q AS (SELECT DISTINCT ON (question_id) question_id, title, regexp_replace(lower(question), '[^a-z0-9]', '', 'g') AS form, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS w FROM qa_examples WHERE question IS NOT NULL AND question_id IS NOT NULL AND title IS NOT NULL),
      h AS (SELECT a.question_id, max(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(a.w || b.w)), 0)) AS h FROM q a JOIN q b ON a.title = b.title AND a.question_id <> b.question_id AND a.form <> b.form GROUP BY 1),
      x AS (SELECT coalesce(h, 0) AS h, len(w) / nullif(len(list_distinct(w || ['please', 'tell'])), 0) AS p FROM q LEFT JOIN h USING (question_id)), g AS (SELECT unnest([{', '.join(map(str, GRID))}]) AS t),
      c AS (SELECT CAST(t AS double) AS threshold, count(*) FILTER (WHERE p >= t AND p > h) AS true_hits, count(*) FILTER (WHERE h >= t AND h >= p) AS false_hits, count(*) AS n FROM g, x GROUP BY 1)
      SELECT threshold, true_hits, false_hits, round(coalesce(true_hits / nullif(true_hits + false_hits, 0), 1), 6) AS precision, round(true_hits / n, 6) AS recall, round((true_hits + false_hits) / n, 6) AS coverage FROM c""",
}
