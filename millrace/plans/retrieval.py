"""Queries of retrieval and answer evaluation and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import answers as A
from millrace.operators import metrics as M
from millrace.operators import retrieval as R
from millrace.sources.tables import table


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").alias("doc"), R.tokens(F.col("text")).alias("words"))


def _asks(s: SparkSession, d: str) -> DataFrame:
    """All items of all languages and suites."""
    return _words(table(s, d, "eval_items"))


def _words(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").alias("qid"), R.tokens(F.col("item_text")).alias("words"))


def chunk_windows(s, d):
    c = R.chunks(table(s, d, "documents"), "doc_id", "text", 64, 16)
    return c.select("doc", "chunk_no", F.size("words").alias("n_words"), F.element_at("words", 1).alias("first_word"))


def _bm25(s, d, asks):
    return R.bm25(_docs(s, d), asks, 10).select("qid", "doc", F.round("score", 6).alias("score"), "place")


def bm25_run(s, d):
    return _bm25(s, d, _asks(s, d))


def _collapsed(s, d, asks):
    c = R.chunks(table(s, d, "documents"), "doc_id", "text", 64, 16)
    ids = c.select(F.concat_ws("#", F.col("doc").cast("string"), F.col("chunk_no").cast("string")).alias("doc"), "words")
    run = R.bm25(ids, asks, 1 << 30).select("qid", F.split("doc", "#")[0].cast("bigint").alias("doc"), "score")
    return R.collapse_parents(run, 10).select("qid", "doc", F.round("score", 6).alias("score"), "place")


def parent_collapse(s, d):
    """BM25 over chunks, the best chunk of a document counting."""
    return _collapsed(s, d, _asks(s, d))


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"), "label")


def dense_run(s, d):
    v = _vectors(s, d)
    q = v.where(F.col("doc") % 50 == 0).select(F.col("doc").alias("qid"), "vector")
    return R.dense(v.select("doc", "vector"), q, 10).select("qid", "doc", F.round("score", 6).alias("score"), "place")


def _lexical_like(s, d):
    """A second run over the vectors: by distance of labels, then ids."""
    v = _vectors(s, d)
    q = v.where(F.col("doc") % 50 == 0).select(F.col("doc").alias("qid"), F.col("label").alias("qlabel"))
    j = v.select("doc", "label").join(q, F.col("label") == F.col("qlabel")).where("qid <> doc")
    return R.place(j.select("qid", "doc", F.lit(1.0).alias("score")), 10)


def rrf_run(s, d):
    return R.rrf([dense_run(s, d), _lexical_like(s, d)], 10).select("qid", "doc", F.round("score", 6).alias("score"), "place")


def rerank_run(s, d):
    new = dense_run(s, d).select("qid", "doc", (F.col("doc") % 7).cast("double").alias("new"))
    return R.rerank(dense_run(s, d), new, 5)


def _judged(s, d):
    v = _vectors(s, d)
    q = v.where(F.col("doc") % 50 == 0).select(F.col("doc").alias("qid"), F.col("label").alias("ql"))
    j = v.select("doc", "label").join(q, F.col("label") == F.col("ql")).where("qid <> doc")
    return j.select("qid", "doc", (1 + F.col("doc") % 3).cast("int").alias("grade"))


def retrieval_metrics(s, d):
    m = R.run_metrics(dense_run(s, d), _judged(s, d), 10)
    return m.select("qid", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")], "first_relevant")


def retrieval_macro(s, d):
    m = R.run_metrics(dense_run(s, d), _judged(s, d), 10)
    cat = _vectors(s, d).where(F.col("doc") % 50 == 0).select(F.col("doc").alias("qid"), F.when(F.col("label") < 5, "low").otherwise("high").alias("category"))
    return R.macro(m, cat)


def recall_gate(s, d):
    j = _judged(s, d)
    return R.gate(R.run_metrics(dense_run(s, d), j, 10), R.run_metrics(rrf_run(s, d), j, 10), 0.01)


def query_overlap(s, d):
    """Shared distinct words of query and chunk id of each found product, per query: overlap features."""
    x = table(s, d, "shopping_queries_dataset_examples").where(F.col("query").isNotNull() & F.col("query_id").isNotNull()).select("example_id", "query_id", R.tokens(F.col("query")).alias("q"), R.tokens(F.coalesce("chunk_id", F.lit(""))).alias("c"))
    shared = F.size(F.array_intersect("q", "c"))
    return x.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(M.ratio(shared, F.size(F.array_distinct("q")))), 6).alias("overlap"), F.max(F.size("q")).alias("query_words"))


def graded_ndcg(s, d):
    """Graded nDCG@10 of the best-scored products of each query: exact 3, substitute 2, complement 1, irrelevant 0."""
    x = table(s, d, "shopping_queries_dataset_examples").where(F.col("query_id").isNotNull() & F.col("product_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    letter = F.upper(F.substring(F.trim("esci_label"), 1, 1))
    grade = F.when(letter == "E", 3).when(letter == "S", 2).when(letter == "C", 1).otherwise(0)
    per = x.groupBy(F.col("query_id").alias("qid"), F.col("product_id").alias("doc")).agg(F.max("score").alias("score"), F.max(grade).alias("grade"))
    m = R.run_metrics(R.place(per.select("qid", "doc", "score"), 10), per.select("qid", "doc", "grade"), 10, mrr_cut=10)
    return m.select("qid", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


def _pairs(s, d):
    qa = table(s, d, "qa_examples").where(F.col("question_id").isNotNull()).dropDuplicates(["question_id"])
    refs = F.filter(F.coalesce("answers", F.array().cast("array<string>")), lambda x: x.isNotNull())
    out = []
    for v in ("a", "b"):
        out.append(qa.select("question_id", F.lit(v).alias("version"), F.coalesce(f"answer_{v}", F.lit("")).alias("answer"), refs.alias("refs"), F.coalesce("impossible", F.lit(False)).alias("impossible")))
    return out[0].unionByName(out[1])


def _scores(s, d):
    scored = _pairs(s, d).withColumn("x", A.score_answer(F.col("answer"), F.col("refs"), F.col("impossible")))
    return scored.select("question_id", "version", "impossible", F.col("x.abstained").alias("abstains"), "x.em", "x.f1")


def squad_scores(s, d):
    return _scores(s, d).select("question_id", "version", "abstains", "em", F.round("f1", 6).alias("f1"))


def paired_summary(s, d):
    """Per segment: both versions' mean F1, the mean difference and its t statistic."""
    w = _scores(s, d).groupBy("question_id", "impossible").pivot("version", ["a", "b"]).agg(F.first("f1"))
    t = w.withColumn("diff", F.col("b") - F.col("a")).rollup("impossible").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("a"), F.avg("b").alias("b"), F.avg("diff").alias("m"), F.stddev_samp("diff").alias("sd"), F.grouping("impossible").alias("g"))
    seg = F.when(F.col("g") == 1, "all").when(F.col("impossible"), "impossible").otherwise("answerable")
    return t.select(seg.alias("segment"), "n", F.round("a", 6).alias("f1_a"), F.round("b", 6).alias("f1_b"), F.round("m", 6).alias("gain"), F.round(M.ratio(F.col("m"), F.col("sd") / F.sqrt("n")), 4).alias("t"))


def method_sets(s, d):
    """Questions that all versions get wrong, and those that only one gets right."""
    w = _scores(s, d).groupBy("question_id").pivot("version", ["a", "b"]).agg(F.max("em"))
    kind = F.when((F.col("a") == 0) & (F.col("b") == 0), "all wrong").when(F.col("b") == 0, "only a").when(F.col("a") == 0, "only b").otherwise("both right")
    return w.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def numeric_answers(s, d):
    return _pairs(s, d).select("question_id", "version", A.canonical_number(A.last_number(F.col("answer"))).alias("number"))


def answer_letters(s, d):
    return _pairs(s, d).select("question_id", "version", A.option_letter(F.col("answer")).alias("letter"))


def question_categories(s, d):
    qa = table(s, d, "qa_examples").where(F.col("question").isNotNull()).select("question").distinct()
    return qa.select("question", A.query_category(F.col("question")).alias("category"))


def sentence_split(s, d):
    t = table(s, d, "documents").where(F.col("text").isNotNull()).select("doc_id", A.sentences(F.col("text")).alias("x"))
    return t.select("doc_id", F.size("x").alias("n"), F.length(F.element_at("x", 1)).alias("first_length"))


QUERIES = {f.__name__: f for f in (chunk_windows, bm25_run, parent_collapse, dense_run, rrf_run, rerank_run, retrieval_metrics, retrieval_macro, recall_gate, query_overlap, graded_ndcg, squad_scores, paired_summary, method_sets, numeric_answers, answer_letters, question_categories, sentence_split)}

_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def _bm25_sql(docs: str, asked: str = "") -> str:
    return f"""{docs},
asks AS (SELECT item_id AS qid, unnest({_TOKENS.format('item_text')}) AS word FROM eval_items{asked}),
times AS (SELECT qid, word, count(*) AS times FROM asks GROUP BY 1, 2),
tf AS (SELECT doc, len(words) AS len, word, count(*) AS tf FROM (SELECT doc, words, unnest(words) AS word FROM docs) GROUP BY 1, 2, 3),
raw AS (SELECT word, ln((SELECT count(*) FROM docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf GROUP BY 1),
idf AS (SELECT word, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
scores AS (SELECT qid, doc, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len(words)) FROM docs)))) AS score FROM tf JOIN idf USING (word) JOIN times USING (word) GROUP BY 1, 2)"""


_DENSE = """
v AS (SELECT vec_id AS doc, embedding AS e, label FROM embeddings), q AS (SELECT doc AS qid, e AS qe, label AS ql FROM v WHERE doc % 50 = 0),
d0 AS (SELECT qid, doc, list_cosine_similarity(CAST(e AS double[]), CAST(qe AS double[])) AS score FROM v, q WHERE qid <> doc),
d1 AS (SELECT qid, doc, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS integer) AS place FROM d0 QUALIFY place <= 10),
lex AS (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY doc) AS place FROM v, q WHERE label = ql AND qid <> doc QUALIFY place <= 10),
fused AS (SELECT qid, doc, sum(1.0 / (60 + place)) AS score FROM (SELECT qid, doc, place FROM d1 UNION ALL SELECT qid, doc, place FROM lex) GROUP BY 1, 2),
rrf AS (SELECT qid, doc, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS integer) AS place FROM fused QUALIFY place <= 10),
judged AS (SELECT qid, doc, CAST(1 + doc % 3 AS integer) AS grade, ql FROM v, q WHERE label = ql AND qid <> doc)"""


def _metrics_sql(run: str) -> str:
    return f"""SELECT b.qid, coalesce(found, 0) / relevant AS recall, coalesce(1.0 / first, 0) AS mrr, coalesce(dcg / idcg, 0) AS ndcg, first AS first_relevant FROM
 (SELECT qid, count(*) AS relevant, sum(CASE WHEN r <= 10 THEN (pow(2, grade) - 1) / log2(r + 1) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc) AS r FROM judged) GROUP BY 1) b
 LEFT JOIN (SELECT qid, count(*) FILTER (WHERE place <= 10) AS found, min(place) AS first, sum(CASE WHEN place <= 10 THEN (pow(2, grade) - 1) / log2(place + 1) END) AS dcg FROM {run} JOIN judged USING (qid, doc) GROUP BY 1) g USING (qid)"""


_QA = r"""
one AS (SELECT question_id, any_value(answers) AS answers, any_value(impossible) AS impossible, any_value(answer_a) AS answer_a, any_value(answer_b) AS answer_b, any_value(question) AS question FROM qa_examples WHERE question_id IS NOT NULL GROUP BY 1),
pairs AS (SELECT question_id, 'a' AS version, coalesce(answer_a, '') AS answer, answers, coalesce(impossible, false) AS impossible FROM one UNION ALL SELECT question_id, 'b', coalesce(answer_b, ''), answers, coalesce(impossible, false) FROM one),
prep AS (SELECT *, regexp_full_match(lower(trim(regexp_replace(answer, '[ \t\n\r\f\v]+', ' ', 'g'))), '|""" + "|".join(a.replace("'", "''") for a in A.ABSTENTIONS) + r"""') AS abstains,
  trim(regexp_replace(regexp_replace(regexp_replace(lower(answer), '[!-/:-@\[-`{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS p FROM pairs),
refs AS (SELECT question_id, version, list_filter(string_split(p, ' '), lambda w: w <> '') AS a, p, unnest(list_filter(coalesce(answers, []), lambda x: x IS NOT NULL)) AS r0 FROM prep),
rn AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(r0), '[!-/:-@\[-`{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS r FROM refs),
rf AS (SELECT *, list_filter(string_split(r, ' '), lambda w: w <> '') AS b FROM rn),
best AS (SELECT question_id, version, bool_or(p = r) AS em, max(CASE WHEN len(a) = 0 OR len(b) = 0 THEN CAST(len(a) = len(b) AS double) ELSE 2.0 * list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda y: y = w))))) / (len(a) + len(b)) END) AS f1 FROM rf GROUP BY 1, 2),
scores AS (SELECT question_id, version, impossible, abstains AND (impossible OR coalesce(f1, 0) = 0) AS abstains, CAST(CASE WHEN impossible THEN abstains ELSE coalesce(em, false) AND NOT (abstains AND coalesce(f1, 0) = 0) END AS integer) AS em,
  CASE WHEN impossible THEN CAST(abstains AS double) ELSE coalesce(f1, 0) END AS f1 FROM prep LEFT JOIN best USING (question_id, version)),
wide AS (SELECT question_id, any_value(impossible) AS impossible, max(f1) FILTER (WHERE version = 'a') AS a, max(f1) FILTER (WHERE version = 'b') AS b, max(em) FILTER (WHERE version = 'a') AS ea, max(em) FILTER (WHERE version = 'b') AS eb FROM scores GROUP BY 1)"""
_DOCS = f"docs AS (SELECT doc_id AS doc, {_TOKENS.format('text')} AS words FROM documents WHERE text IS NOT NULL)"
_CHUNKS = f"""toks AS (SELECT doc_id AS doc, {_TOKENS.format("coalesce(text, '')")} AS t FROM documents),
pieces AS (SELECT doc, t, unnest(generate_series(0, greatest(CAST(ceil((len(t) - 64) / 48) AS bigint), 0))) AS chunk_no FROM toks WHERE len(t) > 0),
cut AS (SELECT doc, CAST(chunk_no AS integer) AS chunk_no, t[chunk_no * 48 + 1 : chunk_no * 48 + 64] AS words FROM pieces)"""

SQL = {
    "chunk_windows": f"WITH {_CHUNKS} SELECT doc, chunk_no, len(words) AS n_words, words[1] AS first_word FROM cut",
    "bm25_run": f"WITH {_bm25_sql(_DOCS, '')} SELECT qid, doc, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS integer) AS place FROM scores QUALIFY place <= 10",
    "parent_collapse": f"WITH {_bm25_sql(_CHUNKS + ', docs AS (SELECT doc || $$#$$ || chunk_no AS doc, words FROM cut)', '')}, best AS (SELECT qid, CAST(split_part(doc, '#', 1) AS bigint) AS doc, max(score) AS score FROM scores GROUP BY 1, 2) SELECT qid, doc, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS integer) AS place FROM best QUALIFY place <= 10",
    "dense_run": f"WITH {_DENSE} SELECT * FROM d1",
    "rrf_run": f"WITH {_DENSE} SELECT * FROM rrf",
    "rerank_run": f"WITH {_DENSE} SELECT qid, doc, CAST(row_number() OVER (PARTITION BY qid ORDER BY place > 5, CASE WHEN place <= 5 THEN doc % 7 END DESC NULLS LAST, place) AS integer) AS place FROM d1",
    "retrieval_metrics": f"WITH {_DENSE}, m AS ({_metrics_sql('d1')}) SELECT qid, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, first_relevant FROM m",
    "retrieval_macro": f"WITH {_DENSE}, m AS ({_metrics_sql('d1')}), c AS (SELECT m.*, CASE WHEN ql < 5 THEN 'low' ELSE 'high' END AS category FROM m JOIN q USING (qid)) SELECT coalesce(category, 'all') AS category, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM c GROUP BY ROLLUP (category)",
    "recall_gate": f"WITH {_DENSE}, a AS ({_metrics_sql('d1')}), b AS ({_metrics_sql('rrf')}), s AS (SELECT (SELECT avg(recall) FROM a) AS x, (SELECT avg(recall) FROM b) AS y) SELECT round(x, 6) AS baseline, round(y, 6) AS candidate, x - y <= 0.01 + 1e-12 AS passes FROM s",
    "query_overlap": f"""WITH x AS (SELECT query_id, {_TOKENS.format('query')} AS q, {_TOKENS.format("coalesce(chunk_id, '')")} AS c FROM shopping_queries_dataset_examples WHERE query IS NOT NULL AND query_id IS NOT NULL)
      SELECT query_id, count(*) AS n, round(avg(len(list_intersect(q, c)) / nullif(len(list_distinct(q)), 0)), 6) AS overlap, CAST(max(len(q)) AS integer) AS query_words FROM x GROUP BY 1""",
    "graded_ndcg": """WITH per AS (SELECT query_id AS qid, product_id AS doc, max(score) AS score, max(CASE upper(substr(trim(esci_label), 1, 1)) WHEN 'E' THEN 3 WHEN 'S' THEN 2 WHEN 'C' THEN 1 ELSE 0 END) AS grade FROM shopping_queries_dataset_examples
        WHERE query_id IS NOT NULL AND product_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS place, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN grade > 0 THEN grade END DESC NULLS LAST, doc) AS best FROM per),
      g AS (SELECT qid, count(*) FILTER (WHERE grade > 0 AND place <= 10) / count(*) FILTER (WHERE grade > 0) AS recall, coalesce(1.0 / min(CASE WHEN grade > 0 AND place <= 10 THEN place END), 0) AS mrr,
        coalesce(sum(CASE WHEN grade > 0 AND place <= 10 THEN (pow(2, grade) - 1) / log2(place + 1) END) / sum(CASE WHEN grade > 0 AND best <= 10 THEN (pow(2, grade) - 1) / log2(best + 1) END), 0) AS ndcg FROM r GROUP BY 1 HAVING count(*) FILTER (WHERE grade > 0) > 0)
      SELECT qid, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM g""",
    "answer_letters": f"WITH {_QA} SELECT question_id, version, upper(coalesce(regexp_extract_all(answer, '{A.LETTER_LINE}', 1)[-1], regexp_extract_all(answer, '{A.LETTER_START}', 1)[-1])) AS letter FROM pairs",
    "question_categories": "SELECT DISTINCT question, CASE WHEN regexp_matches(lower(question), '" + A.NEGATION.replace("'", "''") + "') THEN 'negation' WHEN regexp_matches(lower(question), '" + A.COMPARISON + "') THEN 'numeric_or_comparative' ELSE 'other' END AS category FROM qa_examples WHERE question IS NOT NULL",
    "sentence_split": r"""WITH x AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(s) >= 30)[:8] AS l FROM documents WHERE text IS NOT NULL),
      y AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN [text] ELSE l END AS l FROM x) SELECT doc_id, CAST(len(l) AS integer) AS n, CAST(length(l[1]) AS integer) AS first_length FROM y""",
    "squad_scores": f"WITH {_QA} SELECT question_id, version, abstains, em, round(f1, 6) AS f1 FROM scores",
    "paired_summary": f"WITH {_QA} SELECT CASE WHEN grouping(impossible) = 1 THEN 'all' WHEN impossible THEN 'impossible' ELSE 'answerable' END AS segment, count(*) AS n, round(avg(a), 6) AS f1_a, round(avg(b), 6) AS f1_b, round(avg(b - a), 6) AS gain, round(avg(b - a) / (stddev_samp(b - a) / sqrt(count(*))), 4) AS t FROM wide GROUP BY ROLLUP (impossible)",
    "method_sets": f"WITH {_QA} SELECT CASE WHEN ea = 0 AND eb = 0 THEN 'all wrong' WHEN eb = 0 THEN 'only a' WHEN ea = 0 THEN 'only b' ELSE 'both right' END AS kind, count(*) AS n FROM wide GROUP BY 1",
}
