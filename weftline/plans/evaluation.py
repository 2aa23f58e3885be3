"""Queries of the evaluation reports and of the remaining builders, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import numbers as N
from weftline.functions import text as T
from weftline.operators import conversations as C
from weftline.operators import evaluation as E
from weftline.operators import grading as G
from weftline.operators import relational as R
from weftline.plans import builders as B
from weftline.plans.reference import CONFIDENCE_SQL, NEAR_SQL, SCENES_SQL, TURNS_SQL, VOTES_SQL, WORDS_SQL, BINARY_SQL, _captions, _captions_sql, _confidences, _scenes, _turns, _votes, query, r6
from weftline.session import cut, table

# --- Choices --------------------------------------------------------------------------------------------------------------


def _choices(s, d):
    """Questions with up to four options, a gold answer that may be none of them, and a response."""
    p = table(s, d, "part")
    gold = F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.element_at(F.array(*map(F.lit, "ABCDE")), (F.col("p_partkey") % 5 + 1).cast("int")))
    said = F.concat(F.element_at(F.array(*map(F.lit, ("Answer: ", "It is ", "none but ", "")),), (F.col("p_partkey") % 4 + 1).cast("int")), F.element_at(F.array(*map(F.lit, "ABCDX")), (F.col("p_size") % 5 + 1).cast("int")))
    options = E.valid_options({"A": F.col("p_brand"), "B": F.col("p_type"), "C": F.when(F.col("p_size") % 3 > 0, F.col("p_name")), "D": F.when(F.col("p_size") % 2 > 0, F.col("p_size"))})
    return p.select(F.col("p_partkey").alias("index"), F.col("p_name").alias("question"), options.alias("options"), gold.alias("answer"), said.alias("response"), F.col("p_brand").alias("category"), F.col("p_type").alias("l2"))


CHOICES_SQL = """ch AS (SELECT p_partkey AS "index", p_name AS question, p_brand AS category, p_type AS l2, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE substr('ABCDE', (p_partkey % 5 + 1)::INT, 1) END AS answer, substr('ABCDX', p_size % 5 + 1, 1) AS letter,
['A', 'B'] || CASE WHEN p_size % 3 > 0 THEN ['C'] ELSE [] END || CASE WHEN p_size % 2 > 0 THEN ['D'] ELSE [] END AS valid, 'A. ' || p_brand || chr(10) || 'B. ' || p_type || CASE WHEN p_size % 3 > 0 THEN chr(10) || 'C. ' || p_name ELSE '' END || CASE WHEN p_size % 2 > 0 THEN chr(10) || 'D. ' || p_size ELSE '' END AS lines FROM part),
gr AS (SELECT *, nullif(letter, 'X') AS predicted, coalesce(nullif(letter, 'X') = answer AND list_contains(valid, answer), false) AS correct FROM ch)"""


def _graded(s, d):
    c = _choices(s, d).withColumn("predicted", T.choice_letter(F.col("response")))
    return c.withColumn("correct", E.choice_correct(F.col("predicted"), F.col("answer"), F.col("options")))


@query(f'WITH {CHOICES_SQL} SELECT "index", predicted, correct FROM gr')
def choice_evaluation(s, d):
    return _graded(s, d).select("index", "predicted", "correct")


@query(f"WITH {CHOICES_SQL}, k AS (SELECT unnest([{{'level': 'category', 'key': category}}, {{'level': 'l2', 'key': l2}}]) AS k, correct FROM gr) SELECT k.level AS level, k.key AS key, count(*) AS total, count_if(correct) / count(*) AS accuracy FROM k GROUP BY ALL")
def choice_accuracy_by_levels(s, d):
    return E.accuracy_by_levels(_graded(s, d), "correct", "category", "l2")


@query(f"WITH {CHOICES_SQL} SELECT category, count(*) AS total, round(count_if(answer <> '' AND predicted = answer) / count(*), 4) AS accuracy FROM gr GROUP BY category")
def choice_accuracy_with_gold(s, d):
    c = _choices(s, d).withColumn("predicted", T.choice_letter_any_case(F.col("response"))).withColumn("correct", E.choice_correct_gold(F.col("predicted"), F.col("answer")))
    return c.groupBy("category").agg(F.count("*").alias("total"), F.round(F.count_if("correct") / F.count("*"), 4).alias("accuracy")).orderBy("category")


@query(f"""WITH {CHOICES_SQL} SELECT "index" AS id, '<image>' || chr(10) || question || chr(10) || 'Options:' || chr(10) || lines || chr(10) || 'Answer with the option letter only.' AS user_text, answer AS assistant_text FROM ch""")
def choice_conversations(s, d):
    rows = B.choice_rows(_choices(s, d), 0, 42)
    t = rows.select("id", C.turns(F.col("conversations")).alias("t"))
    return t.select("id", C.first_content(F.col("t"), "user").alias("user_text"), C.first_content(F.col("t"), "assistant").alias("assistant_text"))


# --- Answers against references ------------------------------------------------------------------------------------------------


def _normal_votes(s, d):
    v = _votes(s, d).select("question_id", "answer_type", "pos", T.normalise_b(F.col("answer")).alias("answer"))
    return v.where("answer <> ''")


NORMAL_SQL = r"""nv AS (SELECT question_id, answer_type, pos, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(answer, '[!-/:-@\[-`{-~]', ' ', 'g'), '\s+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the')),
lambda w: coalesce(map {'zero': '0', 'one': '1', 'two': '2', 'three': '3', 'four': '4', 'five': '5', 'six': '6', 'seven': '7', 'eight': '8', 'nine': '9', 'ten': '10'}[w], w)), ' ') AS answer FROM v), w AS (SELECT * FROM nv WHERE answer <> '')"""


def _answer_grades(s, d):
    """The first annotator's answer as the prediction, graded by all answers of its question."""
    v = _normal_votes(s, d)
    prediction = v.groupBy("question_id").agg(F.min_by("answer", "pos").alias("prediction"), F.min_by("answer_type", "pos").alias("answer_type"))
    majority = R.ranked_answers(v, "question_id", "answer", "pos").where("rank = 1").select("question_id", F.col("answer").alias("majority"))
    m = v.join(prediction, "question_id").groupBy("question_id").agg(F.count_if(F.col("answer") == F.col("prediction")).alias("m"), F.count("*").alias("n"))
    return prediction.join(majority, "question_id").join(m, "question_id").select("question_id", "answer_type", G.leave_one_out_consensus(F.col("m"), F.col("n")).alias("score"), (F.col("prediction") == F.col("majority")).alias("majority_exact"))


GRADES_SQL = f"""{VOTES_SQL}, {NORMAL_SQL}, pr AS (SELECT question_id, arg_min(answer, pos) AS prediction, first(answer_type) AS answer_type FROM w GROUP BY question_id), cn AS (SELECT question_id, answer, count(*) AS n, min(pos) AS p FROM w GROUP BY ALL), mj AS (SELECT question_id, answer AS majority FROM cn QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY n DESC, p, answer) = 1),
mt AS (SELECT question_id, count_if(answer = prediction) AS m, count(*) AS n FROM w JOIN pr USING (question_id) GROUP BY question_id), gd AS (SELECT question_id, answer_type, (m * least(1.0, (m - 1) / 3.0) + (n - m) * least(1.0, m / 3.0)) / n AS score, prediction = majority AS majority_exact FROM pr JOIN mj USING (question_id) JOIN mt USING (question_id))"""


@query(f"WITH {GRADES_SQL} SELECT question_id, round(score, 6) AS score, majority_exact FROM gd")
def answer_evaluation(s, d):
    return _answer_grades(s, d).select("question_id", r6("score").alias("score"), "majority_exact")


@query(f"WITH {GRADES_SQL} SELECT answer_type, count(*) AS total, round(avg(score), 6) AS score, round(avg(majority_exact::INT), 6) AS majority_exact FROM gd GROUP BY answer_type")
def score_by_answer_type(s, d):
    return _answer_grades(s, d).groupBy("answer_type").agg(F.count("*").alias("total"), r6(F.avg("score")).alias("score"), r6(F.avg(F.col("majority_exact").cast("double"))).alias("majority_exact")).orderBy("answer_type")


def _run(s, d, pos):
    return _votes(s, d).where(f"pos = {pos}").select("question_id", "answer")


@query(f"WITH {VOTES_SQL}, p AS (SELECT question_id, answer FROM v WHERE pos = 0), q AS (SELECT DISTINCT question_id FROM vqa_questions WHERE split <> 'train') SELECT question_id, answer FROM p SEMI JOIN q USING (question_id)")
def restricted_predictions(s, d):
    references = table(s, d, "vqa_questions").where("split <> 'train'").select("question_id").distinct()
    return E.common_ids(_run(s, d, 0), references, "question_id")[0]


@query(f"WITH {VOTES_SQL} SELECT a.question_id, a.answer AS answer_left, b.answer AS answer_right FROM v a JOIN v b ON a.question_id = b.question_id AND a.pos = 0 AND b.pos = 1 ORDER BY a.answer, a.question_id LIMIT 50")
def first_common_of_two_runs(s, d):
    return E.first_common(_run(s, d, 0), _run(s, d, 1), "question_id", 50, "answer")


@query(f"WITH {VOTES_SQL} SELECT a.question_id, a.answer AS answer_base, b.answer AS answer_tuned, c.answer AS answer_final FROM v a JOIN v b ON a.question_id = b.question_id AND a.pos = 0 AND b.pos = 1 JOIN v c ON a.question_id = c.question_id AND c.pos = 2")
def three_runs(s, d):
    return E.joined_runs({"base": _run(s, d, 0), "tuned": _run(s, d, 1), "final": _run(s, d, 2)}, "question_id")


@query("""WITH r AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model, event_type AS name, round(avg(value), 6) AS value FROM events GROUP BY ALL)
SELECT model, max(CASE WHEN name = 'click' THEN value END) AS click, max(CASE WHEN name = 'view' THEN value END) AS view, max(CASE WHEN name = 'nowhere' THEN value END) AS nowhere FROM r GROUP BY model""")
def combined_summaries(s, d):
    e = table(s, d, "events")
    parts = {m: e.where(f"user_id % 2 = {k}").groupBy(F.col("event_type").alias("name")).agg(r6(F.avg("value")).alias("value")) for m, k in (("even", 0), ("odd", 1))}
    return E.combined_summaries(parts, ["click", "view", "nowhere"])


# --- Scores -------------------------------------------------------------------------------------------------------------------


@query(f"WITH {CONFIDENCE_SQL}, b AS (SELECT least(floor(c * 10)::INT, 9) AS bin, count(*) AS n, sum(y) AS y, sum(c) AS c FROM x GROUP BY 1) SELECT round(sum(abs(y - c)) / sum(n), 6) AS ece, round(sum(c) / sum(n), 6) AS mean_confidence, round(sum(y) / sum(n), 6) AS base_rate FROM b")
def calibration_report(s, d):
    c = E.calibration_report(_confidences(s, d), F.col("y"), F.col("c"))
    return c.select(*[r6(x).alias(x) for x in c.columns])


@query(BINARY_SQL.format(g="event_type,", by="GROUP BY event_type") + " UNION ALL " + "SELECT 'overall', * FROM (" + BINARY_SQL.format(g="", by="") + ")")
def setting_summary_with_overall(s, d):
    p = F.when(F.col("value") > 60, "yes").when(F.col("value") > 5, "no").otherwise("unknown")
    y = F.when(F.col("user_id") % 2 == 0, "yes").otherwise("no")
    return E.with_overall(table(s, d, "events"), p, y, "event_type").withColumn("f1", F.round("f1", 9))


@query("SELECT count(*) AS samples, count_if(l_quantity > l_linenumber * 8) AS wins_a, count_if(l_quantity < l_linenumber * 8) AS wins_b, count_if(l_quantity = l_linenumber * 8) AS ties, round(count_if(l_quantity < l_linenumber * 8) / count(*), 4) AS win_rate_b, round(avg(l_quantity), 4) AS mean_a, round(avg(l_linenumber * 8.0::DOUBLE), 4) AS mean_b FROM lineitem")
def pairwise_report(s, d):
    return E.pairwise_report(table(s, d, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_linenumber") * 8).cast("double").alias("b")), "a", "b")


@query("SELECT l_returnflag AS \"group\", component, round(avg(x), 6) AS mean FROM (UNPIVOT (SELECT l_returnflag, l_discount AS discount, l_tax AS tax, l_quantity AS quantity FROM lineitem) ON discount, tax, quantity INTO NAME component VALUE x) GROUP BY ALL")
def component_means(s, d):
    c = F.create_map(F.lit("discount"), F.col("l_discount"), F.lit("tax"), F.col("l_tax"), F.lit("quantity"), F.col("l_quantity"))
    return E.component_means(table(s, d, "lineitem").select(F.col("l_returnflag").alias("group"), c.alias("c")), "group", "c").withColumn("mean", r6("mean"))


@query("""WITH d AS (SELECT pair_id, CASE WHEN starts_with(lower(trim(chosen)), 'yes') THEN 'yes' WHEN starts_with(lower(trim(chosen)), 'no') THEN 'no' END AS label FROM preference_pairs) SELECT count_if(label = 'yes') AS yes, count_if(label = 'no') AS no, count_if(label IS NULL) AS skipped FROM d""")
def class_totals(s, d):
    label = T.yes_no_prefix(F.col("chosen"))
    return table(s, d, "preference_pairs").agg(F.count_if(label == "yes").alias("yes"), F.count_if(label == "no").alias("no"), F.count_if(label.isNull()).alias("skipped"))


@query("SELECT event_id, CASE WHEN y >= n THEN 'yes' ELSE 'no' END AS answer, round(greatest(y, n) / greatest(y + n, 1e-9), 6) AS confidence FROM (SELECT event_id, exp(-abs(coalesce(value, 0)) / 40) AS y, (user_id % 10) / 10.0::DOUBLE AS n FROM events)")
def pair_confidence(s, d):
    e = table(s, d, "events").select("event_id", F.exp(-F.abs(F.coalesce("value", F.lit(0.0))) / 40).alias("y"), ((F.col("user_id") % 10) / 10.0).alias("n"))
    answer, confidence = E.pair_confidence(F.col("y"), F.col("n"))
    return e.select("event_id", answer.alias("answer"), r6(confidence).alias("confidence"))


@query("SELECT event_id, round(least(greatest(b + 0.2 * c / 10 + 0.3 * least(greatest((j - 3) / 2, -1), 1), -1), 1), 6) AS reward FROM (SELECT event_id, least(greatest(coalesce(value, 0) / 60 - 0.5, -1), 1) AS b, (user_id % 100) / 10.0::DOUBLE AS c, (event_id % 6)::DOUBLE AS j FROM events)")
def extended_reward(s, d):
    e = table(s, d, "events").select("event_id", N.clamp(F.coalesce("value", F.lit(0.0)) / 60 - 0.5).alias("b"), ((F.col("user_id") % 100) / 10.0).alias("c"), (F.col("event_id") % 6).cast("double").alias("j"))
    return e.select("event_id", r6(E.extended_reward(F.col("b"), F.col("c"), F.col("j"), 0.2, 0.3)).alias("reward"))


@query("SELECT l_orderkey, round(sum(CASE WHEN l_linenumber > 1 THEN -l_discount ELSE 0 END) / greatest(count_if(l_linenumber > 1), 1), 6) AS log_probability FROM lineitem GROUP BY l_orderkey")
def sequence_log_probability(s, d):
    g = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", (-F.col("l_discount")).alias("p")))).alias("t"))
    return g.select("l_orderkey", r6(N.masked_mean(F.transform("t", lambda x: x["p"]), F.transform("t", lambda x: (x["l_linenumber"] > 1).cast("double")))).alias("log_probability"))


@query("WITH m AS (UNPIVOT (SELECT l_quantity AS s, l_extendedprice, l_discount, l_tax, l_linenumber::DOUBLE AS l_linenumber, l_suppkey::DOUBLE AS l_suppkey FROM lineitem) ON l_extendedprice, l_discount, l_tax, l_linenumber, l_suppkey INTO NAME metric VALUE x), r AS (SELECT metric, rank() OVER (PARTITION BY metric ORDER BY s) + (count(*) OVER (PARTITION BY metric, s) - 1) / 2.0 AS a, rank() OVER (PARTITION BY metric ORDER BY x) + (count(*) OVER (PARTITION BY metric, x) - 1) / 2.0 AS b FROM m) SELECT metric, count(*) AS n, round(corr(a, b), 5) AS spearman FROM r GROUP BY metric")
def judge_correlations(s, d):
    metrics = ["l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]
    c = E.rank_correlations(table(s, d, "lineitem").select("l_quantity", *[F.col(m).cast("double").alias(m) for m in metrics]), "l_quantity", metrics)
    return c.withColumn("spearman", F.round("spearman", 5))


# --- Conditions ---------------------------------------------------------------------------------------------------------------


@query("WITH n AS (SELECT caption_id, image_id, coalesce(lead(image_id) OVER (ORDER BY caption_id), first_value(image_id) OVER (ORDER BY caption_id)) AS next FROM captions WHERE image_id IS NOT NULL) SELECT caption_id, 'correct' AS condition, image_id FROM n UNION ALL SELECT caption_id, 'black', NULL FROM n UNION ALL SELECT caption_id, 'shuffled', next FROM n")
def control_conditions(s, d):
    return E.control_conditions(table(s, d, "captions").where("image_id IS NOT NULL"), "caption_id", "image_id")


@query(None)
def condition_report(s, d):
    right = cut(_captions(s, d))
    shuffled = R.next_cyclic(right.select("id", "pred"), "id", "pred", "_next").join(right.select("id", "refs"), "id").select("id", F.col("_next").alias("pred"), "refs")
    black = right.withColumn("pred", F.split(F.lit("a dark picture"), " "))
    report = E.condition_report({"correct": right, "black": black, "shuffled": shuffled})
    return report.select("condition", *[F.round(c, 5).alias(c) for c in report.columns[1:]])


# --- Builders -------------------------------------------------------------------------------------------------------------------

QUESTIONS_SQL = "qs AS (SELECT question_id, image_id, question FROM vqa_questions WHERE question IS NOT NULL AND image_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY coalesce(ingested_at, TIMESTAMPTZ '9999-01-01 00:00:00+00'), question) = 1)"


def _questions(s, d):
    q = table(s, d, "vqa_questions").where("question IS NOT NULL AND image_id IS NOT NULL")
    return R.first_per_key(q, ["question_id"], [F.coalesce("ingested_at", F.lit("9999-01-01").cast("timestamp")), F.col("question")])


RANKED_SQL = f"{VOTES_SQL}, c AS (SELECT question_id, answer, count(*) AS n, min(pos) AS p FROM v GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, p, answer) AS k FROM c), {QUESTIONS_SQL}"


@query(f"""WITH {RANKED_SQL} SELECT q.question_id AS id, q.image_id, q.question || ' Answer briefly.' AS prompt, max(CASE WHEN k = 1 THEN answer END) AS chosen, coalesce(max(CASE WHEN k = 2 THEN answer END), 'unknown') AS rejected FROM qs q JOIN rk USING (question_id) GROUP BY ALL""")
def knowledge_pairs(s, d):
    return B.knowledge_rows(_questions(s, d), _votes(s, d), 0, 42, " Answer briefly.")[1]


@query(f"""WITH {RANKED_SQL} SELECT question_id AS id, image_id, '<image>' || chr(10) || question || ' Answer briefly.' AS user_text, answer AS assistant_text FROM qs JOIN rk USING (question_id) WHERE k = 1""")
def knowledge_conversations(s, d):
    t = B.knowledge_rows(_questions(s, d), _votes(s, d), 0, 42, " Answer briefly.")[0].select("id", "image_id", C.turns(F.col("conversations")).alias("t"))
    return t.select("id", "image_id", C.first_content(F.col("t"), "user").alias("user_text"), C.first_content(F.col("t"), "assistant").alias("assistant_text"))


@query(f"""WITH {SCENES_SQL}, bx AS (SELECT l_orderkey, p_brand AS brand, (l_partkey % 600 + (10 + l_quantity) / 2) / 640 AS cx, (l_suppkey * 37 % 440 + (10 + l_linenumber) / 2) / 480 AS cy FROM lineitem JOIN part ON l_partkey = p_partkey), big AS (SELECT l_orderkey FROM bx GROUP BY 1 HAVING count(*) >= 2),
c AS (SELECT l_orderkey, brand, count(*) AS n, any_value(CASE WHEN cx BETWEEN 0.35 AND 0.65 AND cy BETWEEN 0.35 AND 0.65 THEN 'center' WHEN abs(cy - 0.5) <= abs(cx - 0.5) THEN CASE WHEN cx < 0.5 THEN 'left' ELSE 'right' END WHEN cy < 0.5 THEN 'top' ELSE 'bottom' END) AS pos FROM bx SEMI JOIN big USING (l_orderkey) GROUP BY ALL),
ab AS (SELECT b.l_orderkey, p.brand FROM big b, (SELECT DISTINCT p_brand AS brand FROM part) p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.l_orderkey = b.l_orderkey AND c.brand = p.brand) QUALIFY row_number() OVER (PARTITION BY b.l_orderkey ORDER BY md5(concat_ws(':', '7', b.l_orderkey::VARCHAR, p.brand)), p.brand) <= 2)
SELECT l_orderkey AS image_id, 'Where is the ' || brand || ' in the image? Answer with a single word: left, right, top, bottom or center.' AS question, pos AS answer FROM c WHERE n = 1 UNION ALL SELECT l_orderkey, 'How many ' || brand || 's are in the image? Answer with an integer only.', n::VARCHAR FROM c
UNION ALL SELECT l_orderkey, 'Is there a ' || brand || ' in the image? Answer yes or no.', 'no' FROM ab""")
def spatial_questions(s, d):
    li = table(s, d, "lineitem").join(table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("category")), "l_partkey")
    x, y = (F.col("l_partkey") % 600).cast("double"), (F.col("l_suppkey") * 37 % 440).cast("double")
    boxes = li.select(F.col("l_orderkey").alias("image_id"), "category", N.position_of(x, y, 10 + F.col("l_quantity"), 10.0 + F.col("l_linenumber")).alias("position"))
    pool = table(s, d, "part").select(F.col("p_brand").alias("category")).distinct()
    return B.spatial_questions(boxes, pool, 2, 7)


@query(f"WITH {TURNS_SQL}, x AS (SELECT s.row_id, md5(s.image_bytes || encode(coalesce(list_filter(turns, lambda x: x.role = 'user')[1].content, ''))) AS k FROM t JOIN sft_i2t s USING (row_id) WHERE s.image_bytes IS NOT NULL) SELECT k AS digest, min(row_id) AS row_id FROM x GROUP BY k")
def dedup_image_and_question(s, d):
    x = table(s, d, "sft_i2t").where("image_bytes IS NOT NULL").select("row_id", "image_bytes", C.turns(F.col("conversations")).alias("t")).where("t IS NOT NULL")
    x = x.select("row_id", F.md5(F.concat("image_bytes", F.encode(C.first_content(F.col("t"), "user"), "UTF-8"))).alias("digest"))
    return x.groupBy("digest").agg(F.min("row_id").alias("row_id"))


@query(f"""WITH {TURNS_SQL}, x AS (SELECT md5(s.image_bytes) AS img, {NEAR_SQL.format("coalesce(list_filter(turns, lambda x: x.role = 'user')[1].content, '') || ' ' || coalesce(list_filter(turns, lambda x: x.role = 'assistant')[1].content, '')")} AS txt FROM t JOIN sft_i2t s USING (row_id) WHERE s.image_bytes IS NOT NULL), k AS (SELECT img, txt, count(*) AS c FROM x GROUP BY ALL)
SELECT sum(c)::BIGINT AS rows, count(*) AS distinct_rows, round(1 - count(*) / sum(c), 6) AS duplicate_rate FROM k""")
def duplicate_rate_of_image_and_text(s, d):
    x = table(s, d, "sft_i2t").where("image_bytes IS NOT NULL").select(F.md5("image_bytes").alias("img"), C.turns(F.col("conversations")).alias("t")).where("t IS NOT NULL")
    both = F.concat_ws(" ", C.first_content(F.col("t"), "user"), C.first_content(F.col("t"), "assistant"))
    k = x.select("img", T.normalise_near_dup(both).alias("txt")).groupBy("img", "txt").agg(F.count("*").alias("c"))
    return k.agg(F.sum("c").alias("rows"), F.count("*").alias("distinct_rows"), r6(1 - F.count("*") / F.sum("c")).alias("duplicate_rate"))


@query("WITH x AS (SELECT 'large' AS variant, 60 AS a, 30 AS b UNION ALL SELECT 'even', 40, 40 UNION ALL SELECT 'small', 10, 50), d AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws(':', '42', doc_id::VARCHAR)), doc_id) AS k, doc_id FROM documents WHERE lang IN ('en', 'zh')) SELECT variant, lang, doc_id FROM x JOIN d ON (lang = 'en' AND k <= a) OR (lang = 'zh' AND k <= b)")
def ratio_sweep(s, d):
    x = table(s, d, "documents").select("doc_id", "lang")
    return B.ratio_sweep(x.where("lang = 'en'"), x.where("lang = 'zh'"), {"large": (60, 30), "even": (40, 40), "small": (10, 50)}, 42, "doc_id")


@query("WITH a AS (SELECT 'documents' AS file, doc_id AS id, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'captions', caption_id, row_number() OVER (ORDER BY caption_id) FROM captions WHERE caption IS NOT NULL) SELECT file, id FROM a WHERE k <= 300")
def capped_rows(s, d):
    parts = {"documents": table(s, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id")), "captions": table(s, d, "captions").where("caption IS NOT NULL").select(F.col("caption_id").alias("id"))}
    return B.capped_rows(parts, 300, "id")


# --- Orders, texts ----------------------------------------------------------------------------------------------------------------


@query("SELECT brand, n, row_number() OVER (ORDER BY n DESC, brand) AS position FROM (SELECT p_brand AS brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)")
def categories_by_total(s, d):
    c = _scenes(s, d).groupBy("brand").agg(F.count("*").alias("n"))
    return R.global_rank(c.withColumn("_o", -F.col("n")), "position", "_o", "brand").select("brand", "n", (F.col("position") + 1).cast("long").alias("position"))


@query("SELECT l_orderkey, count(*) AS boxes FROM lineitem GROUP BY 1 HAVING count(*) >= 2")
def images_of_several_boxes(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("boxes")).where("boxes >= 2")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents) SELECT doc_id FROM r WHERE k IN (0, n // 5, 2 * n // 5, 3 * n // 5, 4 * n // 5)")
def strata_peek(s, d):
    return E.strata_peek(table(s, d, "documents").select("doc_id"), 5, "doc_id")


@query("SELECT pair_id, left(coalesce(prompt, ''), 120) AS prompt, left(coalesce(chosen, ''), 40) AS chosen FROM preference_pairs ORDER BY pair_id LIMIT 100")
def display_rows(s, d):
    p = table(s, d, "preference_pairs").orderBy("pair_id").limit(100)
    return p.select("pair_id", F.left(F.coalesce("prompt", F.lit("")), F.lit(120)).alias("prompt"), F.left(F.coalesce("chosen", F.lit("")), F.lit(40)).alias("chosen"))


@query(f"WITH {_captions_sql()}, g0 AS (SELECT id, n, unnest(list_transform(range(1, len(tok) - n + 2), lambda i: array_to_string(tok[i:i + n - 1], ' '))) AS gram FROM cap, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE ref = -1 AND len(tok) >= n) SELECT id, n::INT AS n, gram, count(*) AS tf FROM g0 GROUP BY ALL")
def ngram_counts(s, d):
    parts = [_captions(s, d).select("id", F.lit(n).alias("n"), F.explode(T.ngrams(F.col("pred"), n)).alias("gram")) for n in range(1, 5)]
    return R.union_all(parts).groupBy("id", "n", "gram").agg(F.count("*").alias("tf"))


@query(r"SELECT doc_id, list_last(regexp_extract_all(text, '[0-9]+')) AS last_number FROM documents WHERE regexp_matches(text, '[0-9]')")
def log_last_match(s, d):
    found = F.regexp_extract_all("text", F.lit("([0-9]+)"))
    return table(s, d, "documents").where(F.col("text").rlike("[0-9]")).select("doc_id", F.element_at(found, -1).alias("last_number"))


@query("SELECT event_type, coalesce(list_extract(map_extract(m, 'f'), 1), v) AS score FROM (SELECT event_type, round(avg(value), 6) AS v, CASE WHEN event_type < 'p' THEN map {'f': round(max(value), 6), 'g': 0.0::DOUBLE} ELSE map {'g': round(avg(value), 6)} END AS m FROM events GROUP BY event_type)")
def coerced_scores(s, d):
    e = table(s, d, "events").groupBy("event_type").agg(r6(F.max("value")).alias("f"), r6(F.avg("value")).alias("g"))
    m = F.when(F.col("event_type") < "p", F.create_map(F.lit("f"), F.col("f"), F.lit("g"), F.lit(0.0))).otherwise(F.create_map(F.lit("g"), F.col("g")))
    return e.select("event_type", E.coerced_score(m).alias("score"))


@query("SELECT caption_id, image_id, caption FROM captions c WHERE caption IS NOT NULL AND EXISTS (SELECT 1 FROM sft_i2t s WHERE s.image_id = c.image_id AND s.image_bytes IS NOT NULL)")
def captioned_images(s, d):
    have = table(s, d, "sft_i2t").where("image_bytes IS NOT NULL").select("image_id")
    return table(s, d, "captions").where("caption IS NOT NULL").select("caption_id", "image_id", "caption").join(have, "image_id", "left_semi")


@query(f"""WITH p AS (SELECT pair_id AS id, CASE WHEN starts_with(lower(trim(chosen)), 'yes') THEN 'yes' WHEN starts_with(lower(trim(chosen)), 'no') THEN 'no' END AS y FROM preference_pairs), e AS (SELECT id, y AS chosen, CASE WHEN y = 'yes' THEN 'no' ELSE 'yes' END AS rejected FROM p WHERE y IS NOT NULL ORDER BY md5(concat_ws(':', '8', id::VARCHAR)), id LIMIT 40),
g AS (SELECT pair_id AS id, chosen, rejected FROM preference_pairs WHERE lower(trim(chosen)) NOT IN ('yes', 'no') AND len({WORDS_SQL.replace('{0}', 'chosen')}) >= 2 AND len({WORDS_SQL.replace('{0}', 'rejected')}) >= 1 ORDER BY md5(concat_ws(':', '8', pair_id::VARCHAR)), pair_id LIMIT 40) SELECT * FROM e UNION ALL SELECT * FROM g""")
def balanced_preferences(s, d):
    p = table(s, d, "preference_pairs")
    return B.balanced_preferences(B.opposite_pairs(p, "pair_id", "chosen", 0, 8), p.select(F.col("pair_id").alias("id"), "chosen", "rejected"), 40, 8)


@query("WITH t AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_partkey) AS t FROM lineitem GROUP BY 1) SELECT l_orderkey, (t || [0, 0, 0, 0, 0])[1:5] AS padded FROM t")
def padded_tokens(s, d):
    t = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("t"))
    return t.select("l_orderkey", C.padded(F.transform("t", lambda x: x["l_linenumber"]), 5).alias("padded"))


@query("WITH s AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 7 = 0), sc AS (SELECT user_id, event_type, round(avg(coalesce(value, 0)) - 20, 6) AS score FROM events GROUP BY ALL) SELECT sc.user_id AS seq, sc.event_type AS token, round(CASE WHEN s.user_id IS NULL THEN score WHEN score > 0 THEN score / 1.2 ELSE score * 1.2 END, 5) AS score FROM sc LEFT JOIN s ON sc.user_id = s.user_id AND sc.event_type = s.event_type")
def repetition_penalty(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("seq"), F.col("event_type").alias("token"), "event_id", "value")
    scores = e.groupBy("seq", "token").agg(r6(F.avg(F.coalesce("value", F.lit(0.0))) - 20).alias("score"))
    return C.repetition_penalty(scores, e.where("event_id % 7 = 0"), 1.2).withColumn("score", F.round("score", 5))


@query("""WITH m AS (SELECT user_id % 3 AS position, 'model ' || (user_id % 3) AS model, event_type AS name, round(avg(value), 6) AS value FROM events GROUP BY ALL), b AS (SELECT name, value AS base FROM m WHERE model = 'model 0'), x AS (SELECT m.*, lag(value) OVER (PARTITION BY name ORDER BY position) AS before, base FROM m LEFT JOIN b USING (name))
SELECT 'overview' AS chart, model, name, value FROM x UNION ALL SELECT 'chain', model, name, round(value - before, 5) FROM x WHERE before IS NOT NULL UNION ALL SELECT 'ratios', model, name, round(value / nullif(base, 0), 5) FROM x""")
def chart_tables(s, d):
    m = table(s, d, "events").groupBy((F.col("user_id") % 3).alias("position"), F.col("event_type").alias("name")).agg(r6(F.avg("value")).alias("value"))
    c = E.chart_tables(m.withColumn("model", F.concat(F.lit("model "), F.col("position").cast("string"))), "model 0")
    return c.withColumn("value", F.when(F.col("chart") == "overview", F.col("value")).otherwise(F.round("value", 5)))
