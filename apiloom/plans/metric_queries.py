"""Registered queries over predictions, prompts and texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from apiloom.functions import text as T
from apiloom.operators import metrics as M
from apiloom.operators import select as S
from apiloom.plans.views import PREDICTIONS, predictions, table

WORDS = "list_filter(regexp_split_to_array(lower({}), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w != '')"


def _samples(s, d):
    docs = table(s, d, "documents")
    return docs.select("doc_id", F.col("text").alias("input"), F.col("lang").alias("output"), "source")


def _turns(s, d):
    """Each user turn with the next turn of its conversation."""
    c = table(s, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.where("role = 'user'").join(nxt, ["conv_id", "turn"])


def _robust(s, d):
    kinds = M.perturb(table(s, d, "benchmark"), id_col="item_id", text_col="text")
    return M.robustness_score(kinds.withColumn("correct", F.char_length("variant") % 3 != 0), 0.8).select("kind", "accuracy", "robustness")


def _compare(s, d):
    rows = predictions(s, d).withColumn("input_id", F.floor(F.col("example_id") / 2))
    return M.compare_prompts(rows, "p0", "p1")


QUERIES = {
    "classification_macro": lambda s, d: M.classification_metrics(predictions(s, d)),
    "classification_binary": lambda s, d: M.classification_metrics(predictions(s, d), positive="good"),
    "counter_f1": lambda s, d: M.counter_f1(predictions(s, d)),
    "error_patterns": lambda s, d: M.error_patterns(predictions(s, d)),
    "error_input_stats": lambda s, d: M.error_input_stats(predictions(s, d)),
    "top_words": lambda s, d: M.top_words(table(s, d, "documents").select("lang", "text"), key="lang", text="text", k=10),
    "keywords": lambda s, d: M.keywords(table(s, d, "documents").select("lang", "text"), key="lang", text="text", k=10),
    "compare_prompts": _compare,
    "dataset_quality": lambda s, d: M.dataset_quality(_samples(s, d)),
    "distribution_similarity": lambda s, d: M.distribution_similarity(_samples(s, d).where("source < 'src15'"), _samples(s, d).where("source >= 'src15'")),
    "robustness_score": _robust,
    "prompt_length_stats": lambda s, d: M.prompt_length_stats(table(s, d, "documents"), key="lang", text="text"),
    "prompt_overlap": lambda s, d: _turns(s, d).select("conv_id", "turn", F.round(M.prompt_overlap(F.col("text"), F.col("answer")), 6).alias("overlap")),
    "bleu": lambda s, d: _turns(s, d).select("conv_id", "turn", M.bleu("text", "answer").alias("bleu")),
    "rouge": lambda s, d: _turns(s, d).select("conv_id", "turn", M.rouge("text", "answer").alias("r")).select("conv_id", "turn", "r.*"),
    "perturb_text": lambda s, d: M.perturb(table(s, d, "benchmark"), id_col="item_id", text_col="text"),
    "token_estimate": lambda s, d: table(s, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("ceil_4"), T.token_estimate(F.col("text"), 2, "floor").alias("floor_2")),
    "prompt_features": lambda s, d: table(s, d, "conversations").select(
        "conv_id",
        "turn",
        F.round(F.char_length("text") / 1000, 6).alias("chars"),
        F.round(F.size(F.filter(F.split("text", r"\."), lambda x: F.trim(x, F.lit(" \n")) != "")) / 10, 6).alias("sentences"),
        F.round(F.size(M.words(F.col("text"))) / 100, 6).alias("words"),
    ),
    "parse_score": lambda s, d: table(s, d, "events").select("event_id", F.round(T.parse_score(F.concat(F.lit("Score: "), F.col("value").cast("string"), F.lit(" ||| fine"))), 9).alias("score")),
    "parse_samples": lambda s, d: table(s, d, "supplier")
    .select("s_suppkey", F.concat("s_name", F.lit(" ||| "), F.col("s_nationkey").cast("string"), F.lit("\nnoise line\na ||| b ||| c\nq"), F.col("s_suppkey").cast("string"), F.lit("|||x")).alias("t"))
    .select("s_suppkey", F.inline(T.parse_samples(F.col("t")))),
    "extract_answer": lambda s, d: predictions(s, d).select(
        "example_id", T.first_line(F.col("input")).alias("answer"), T.is_correct(F.concat("predicted", F.lit(" it is")), F.col("expected")).alias("lenient"), T.is_correct(F.col("predicted"), F.col("expected"), True).alias("strict")
    ),
    "render_prompt": lambda s, d: table(s, d, "benchmark").select("item_id", T.render_prompt(F.lit("Answer."), F.when(F.col("item_id") % 2 == 0, "Context").otherwise("  "), F.col("text")).alias("prompt")),
    "recent_messages": lambda s, d: S.recent_messages(table(s, d, "conversations"), 3),
    "dedupe_samples": lambda s, d: S.dedupe_samples(_samples(s, d).select("input", "output")).select(F.md5("input").alias("h"), "output"),
    "filter_against_examples": lambda s, d: S.filter_against_examples(_samples(s, d).select("doc_id", "input"), table(s, d, "documents").where("doc_id % 3 = 0").select(F.col("text").alias("input"))).select("doc_id"),
    "sample_n": lambda s, d: S.sample_n(table(s, d, "documents").select("doc_id", "lang"), 100, id_col="doc_id"),
}

CLS = "c AS (SELECT prompt_id, expected AS cls, count(*) AS gold, count(*) FILTER (expected = predicted) AS tp FROM preds GROUP BY ALL), q AS (SELECT prompt_id, predicted AS cls, count(*) AS said FROM preds GROUP BY ALL), m AS (SELECT c.*, CASE WHEN coalesce(said, 0) > 0 THEN tp / said ELSE 0 END AS p, CASE WHEN gold > 0 THEN tp / gold ELSE 0 END AS r FROM c LEFT JOIN q USING (prompt_id, cls)), acc AS (SELECT prompt_id, round(avg(CASE WHEN expected = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM preds GROUP BY ALL)"
CLS_OUT = "SELECT prompt_id, any_value(accuracy) AS accuracy, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1 FROM m JOIN acc USING (prompt_id)"
TURNS = "t AS (SELECT a.conv_id, a.turn, a.text, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user')"
TOP = "w AS (SELECT lang, unnest(" + WORDS.format("text") + ") AS word FROM documents), n AS (SELECT lang, word, count(*) AS n FROM w {} GROUP BY ALL)"
RANKED = "SELECT lang, word, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM n) WHERE rank <= 10"
PERTURBED = """
ty AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda x: x <> '') AS parts, CAST('0x' || substr(md5('0:' || item_id || ':word'), 1, 8) AS BIGINT) AS dw, CAST('0x' || substr(md5('0:' || item_id || ':letter'), 1, 8) AS BIGINT) AS dl FROM benchmark),
tw AS (SELECT *, CAST(dw % greatest(len(parts), 1) AS INT) + 1 AS place, coalesce(parts[CAST(dw % greatest(len(parts), 1) AS INT) + 1], '') AS word FROM ty),
tp AS (SELECT *, CAST(dl % greatest(length(word) - 1, 1) AS INT) + 1 AS pick FROM tw),
v AS (SELECT item_id, unnest([{'kind': 'typo', 'variant': CASE WHEN len(parts) > 1 THEN array_to_string(list_transform(parts, lambda w, i: CASE WHEN i = place AND length(w) > 2 THEN substr(word, 1, pick - 1) || substr(word, pick + 1, 1) || substr(word, pick, 1) || substr(word, pick + 2) ELSE w END), ' ') ELSE text END}, {'kind': 'spaces', 'variant': replace(text, ' ', '  ')}, {'kind': 'punctuation', 'variant': text || '!!!'}, {'kind': 'half', 'variant': substr(text, 1, CAST(floor(length(text) / 2) AS INT))},
  {'kind': 'suffix', 'variant': text || ' please answer'}, {'kind': 'upper', 'variant': upper(replace(text, 'ß', 'SS'))}, {'kind': 'lower', 'variant': lower(text)}, {'kind': 'prefix', 'variant': 'Ignore this line. ' || text}]) AS x FROM tp),
k AS (SELECT item_id, x.kind AS kind, x.variant AS variant FROM v)"""
STAT = "(SELECT avg(length(text)) FROM documents WHERE source {0} 'src15')"
SQL = {
    "classification_macro": f"WITH {PREDICTIONS}, {CLS} {CLS_OUT} GROUP BY prompt_id",
    "classification_binary": f"WITH {PREDICTIONS}, {CLS} {CLS_OUT} WHERE cls = 'good' GROUP BY prompt_id",
    "counter_f1": f"""WITH {PREDICTIONS}, a AS (SELECT predicted AS x, count(*) AS a FROM preds GROUP BY ALL), b AS (SELECT expected AS x, count(*) AS b FROM preds GROUP BY ALL),
        s AS (SELECT sum(least(coalesce(a, 0), coalesce(b, 0))) AS o, sum(a) AS a, sum(b) AS b FROM a FULL JOIN b USING (x)) SELECT round(o / a, 6) AS precision, round(o / b, 6) AS recall, round(2 * (o / a) * (o / b) / (o / a + o / b), 6) AS f1 FROM s""",
    "error_patterns": f"""WITH {PREDICTIONS}, e AS (SELECT prompt_id, expected, predicted, count(*) AS errors FROM preds WHERE expected != predicted GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY prompt_id, expected ORDER BY errors DESC, predicted) = 1 AND errors > 1 AS top FROM e""",
    "error_input_stats": f"WITH {PREDICTIONS} SELECT prompt_id, round(avg(length(input)), 6) AS avg_chars, CAST(min(length(input)) AS INT) AS min_chars, CAST(max(length(input)) AS INT) AS max_chars FROM preds WHERE expected != predicted GROUP BY prompt_id",
    "top_words": f"WITH {TOP.format('')} {RANKED}",
    "keywords": f"""WITH w AS (SELECT lang, unnest(list_transform(list_filter(regexp_split_to_array(lower(text), '[ \\t-\\r]+'), lambda x: x <> '' AND x NOT IN ({', '.join(repr(w) for w in M.STOP_WORDS)})), lambda x: trim(x, '.,!?;:'))) AS word FROM documents),
  n AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL) {RANKED}""",
    "compare_prompts": f"""WITH {PREDICTIONS}, i AS (SELECT prompt_id, example_id // 2 AS input_id, max(CASE WHEN expected != predicted THEN 1 ELSE 0 END) AS e FROM preds GROUP BY ALL),
        j AS (SELECT a.e AS e1, b.e AS e2 FROM (SELECT * FROM i WHERE prompt_id = 'p0') a FULL JOIN (SELECT * FROM i WHERE prompt_id = 'p1') b USING (input_id)),
        r AS (SELECT round(avg(e1), 6) AS error_rate_1, round(avg(e2), 6) AS error_rate_2, count(*) FILTER (coalesce(e1, 0) = 1 AND coalesce(e2, 0) = 0) AS only_1, count(*) FILTER (coalesce(e1, 0) = 0 AND coalesce(e2, 0) = 1) AS only_2, count(*) FILTER (e1 = 1 AND e2 = 1) AS both FROM j)
        SELECT *, CASE WHEN error_rate_1 < error_rate_2 THEN 'p0' WHEN error_rate_2 < error_rate_1 THEN 'p1' ELSE 'tie' END AS winner FROM r""",
    "dataset_quality": """WITH g AS (SELECT count(*) AS n, round(avg(length(text)), 6) AS avg_input, round(avg(length(lang)), 6) AS avg_output, count(DISTINCT lang) AS distinct_outputs, count(*) FILTER (trim(text) = '' OR trim(lang) = '') AS blank_rows FROM documents)
        SELECT *, round((least(n / 50, 1.0) + distinct_outputs / n + (1 - blank_rows / n)) / 3, 6) AS score FROM g""",
    "distribution_similarity": f"""WITH a AS (SELECT lang, count(*) / (SELECT count(*) FROM documents WHERE source < 'src15') AS p FROM documents WHERE source < 'src15' GROUP BY ALL),
        b AS (SELECT lang, count(*) / (SELECT count(*) FROM documents WHERE source >= 'src15') AS q FROM documents WHERE source >= 'src15' GROUP BY ALL),
        r AS (SELECT round(least({STAT.format('<')}, {STAT.format('>=')}) / greatest({STAT.format('<')}, {STAT.format('>=')}), 6) AS lengths,
          (SELECT round(1 - sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) FROM a FULL JOIN b USING (lang)) AS outputs,
          round(least(x, y) / greatest(x, y), 6) AS diversity FROM (SELECT count(DISTINCT lang) FILTER (source < 'src15') / count(*) FILTER (source < 'src15') AS x, count(DISTINCT lang) FILTER (source >= 'src15') / count(*) FILTER (source >= 'src15') AS y FROM documents))
        SELECT *, round((lengths + outputs + diversity) / 3, 5) AS similarity FROM r""",
    "robustness_score": f"WITH {PERTURBED}, g AS (SELECT kind, avg(CASE WHEN length(variant) % 3 != 0 THEN 1.0 ELSE 0.0 END) AS accuracy FROM k GROUP BY kind) SELECT kind, round(accuracy, 6) AS accuracy, round(avg(accuracy) OVER () / 0.8, 6) AS robustness FROM g",
    "prompt_length_stats": f"WITH c AS (SELECT lang, len({WORDS.format('text')}) AS n FROM documents) SELECT lang, round(avg(n), 6) AS mean_words, round(stddev_pop(n), 6) AS std_words, CAST(min(n) AS INT) AS min_words, CAST(max(n) AS INT) AS max_words FROM c GROUP BY lang",
    "prompt_overlap": f"WITH {TURNS}, w AS (SELECT conv_id, turn, list_distinct({WORDS.format('text')}) AS x, list_distinct({WORDS.format('answer')}) AS y FROM t) SELECT conv_id, turn, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS overlap FROM w",
    "perturb_text": f"WITH {PERTURBED} SELECT * FROM k",
    "token_estimate": "SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS ceil_4, CAST(floor(length(text) / 2) AS BIGINT) AS floor_2 FROM documents",
    "prompt_features": f"SELECT conv_id, turn, round(length(text) / 1000, 6) AS chars, round(len(list_filter(string_split(text, '.'), lambda x: trim(x, ' ' || chr(10)) != '')) / 10, 6) AS sentences, round(len({WORDS.format('text')}) / 100, 6) AS words FROM conversations",
    "parse_score": "SELECT event_id, round(least(1.0, value / 10), 9) AS score FROM events",
    "parse_samples": "SELECT s_suppkey, unnest([s_name, 'q' || s_suppkey]) AS input, unnest([CAST(s_nationkey AS VARCHAR), 'x']) AS output FROM supplier",
    "extract_answer": f"""WITH {PREDICTIONS} SELECT example_id, coalesce(trim(list_filter(string_split(input, chr(10)), lambda x: trim(x) != '')[1]), '') AS answer,
        expected = predicted AS lenient, expected = predicted AS strict FROM preds""",
    "render_prompt": "SELECT item_id, 'Answer.' || chr(10) || chr(10) || CASE WHEN item_id % 2 = 0 THEN 'Context' || chr(10) || chr(10) ELSE '' END || text AS prompt FROM benchmark",
    "recent_messages": "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS messages FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3 GROUP BY conv_id",
    "dedupe_samples": "SELECT DISTINCT md5(text) AS h, lang AS output FROM documents WHERE length(trim(text)) >= 5",
    "filter_against_examples": "SELECT doc_id FROM documents WHERE length(text) BETWEEN 5 AND 500 AND trim(text) != '' AND text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0)",
}
