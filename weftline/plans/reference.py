"""Queries of the reference-derived operators over the supplied tables, each with its SQL counterpart.

`Q` maps a name to (query, SQL); SQL is None where the operator cannot be said in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import numbers as N
from weftline.functions import text as T
from weftline.operators import conversations as C
from weftline.operators import dedup as D
from weftline.operators import grading as G
from weftline.operators import metrics as M
from weftline.operators import relational as R
from weftline.operators import rewards as RW
from weftline.plans import builders as B
from weftline.session import table
from weftline.streaming import state as S

Query = Callable[[SparkSession, str], DataFrame]
Q: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        Q[f.__name__] = (f, sql)
        return f

    return add


def r6(c) -> F.Column:
    return F.round(c, 6)


# SQL building blocks.
TURNS_SQL = """t AS (SELECT row_id, from_json(conversations, '[{"role":"VARCHAR","content":"VARCHAR"}]') AS turns FROM sft_i2t WHERE conversations IS NOT NULL AND json_valid(conversations) AND conversations LIKE '%[%')"""
WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w <> '')"
CJK_SQL = r"(length({0}) - length(regexp_replace({0}, '[\x{4e00}-\x{9fff}]', '', 'g')))"
ALNUM_SQL = r"(length({0}) - length(regexp_replace({0}, '[A-Za-z0-9]', '', 'g')))"
NORM_A_SQL = r"array_to_string(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+'), lambda w: w NOT IN ('a','an','the')), ' ')"
NEAR_SQL = r"trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9\x{{4e00}}-\x{{9fff}}]+', ' ', 'g'))"


def _turns(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "sft_i2t").select("row_id", C.turns(F.col("conversations")).alias("t"))
    return t.where("t IS NOT NULL")


def _latest_annotations(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "vqa_annotations")
    return R.first_per_key(a, ["question_id"], [F.coalesce("ingested_at", F.lit("1970-01-01").cast("timestamp")), F.coalesce(F.size("answers"), F.lit(0))], last=True)


LATEST_SQL = "la AS (SELECT * FROM vqa_annotations QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY coalesce(ingested_at, TIMESTAMPTZ '1970-01-01 00:00:00+00') DESC, coalesce(len(answers), 0) DESC) = 1)"
VOTES_SQL = LATEST_SQL + ", ex AS (SELECT question_id, answer_type, unnest(list_transform(answers, lambda x, i: {'i': i - 1, 'a': x.answer})) AS e FROM la), v AS (SELECT question_id, answer_type, e.i AS pos, lower(trim(e.a)) AS answer FROM ex WHERE trim(coalesce(e.a, '')) <> '')"


def _votes(s: SparkSession, d: str) -> DataFrame:
    a = _latest_annotations(s, d).select("question_id", "answer_type", F.posexplode("answers").alias("pos", "x"))
    return a.where("trim(coalesce(x.answer, '')) <> ''").select("question_id", "answer_type", "pos", T.normalise_c(F.col("x.answer")).alias("answer"))


def _captions(s: SparkSession, d: str) -> DataFrame:
    """Per image with several captions: the first one as prediction, the others as references."""
    c = table(s, d, "captions").where("image_id IS NOT NULL AND caption IS NOT NULL").select("image_id", "caption_id", T.mixed_tokens(F.col("caption")).alias("tok")).where("size(tok) > 0")
    g = c.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("caption_id", "tok"))).alias("x")).where("size(x) > 1")
    return g.select(F.col("image_id").alias("id"), F.col("x")[0]["tok"].alias("pred"), F.transform(F.slice("x", 2, 1_000_000), lambda x: x["tok"]).alias("refs"))


def _captions_sql() -> str:
    tok = r"regexp_extract_all(lower(coalesce(caption, '')), '[a-z0-9]+(?:''[a-z]+)?|[\x{3400}-\x{9fff}]')"
    return (f"c AS (SELECT image_id, caption_id, {tok} AS tok FROM captions WHERE image_id IS NOT NULL AND caption IS NOT NULL), "
            "c1 AS (SELECT image_id AS id, caption_id, tok, row_number() OVER (PARTITION BY image_id ORDER BY caption_id) - 2 AS ref, count(*) OVER (PARTITION BY image_id) AS k FROM c WHERE len(tok) > 0), "
            "cap AS (SELECT * FROM c1 WHERE k > 1)")


GRAMS_SQL = ("g0 AS (SELECT id, ref, n, unnest(list_transform(range(1, len(tok) - n + 2), lambda i: array_to_string(tok[i:i + n - 1], ' '))) AS gram FROM cap, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(tok) >= n), "
             "g AS (SELECT id, ref, n, gram, count(*) AS tf FROM g0 GROUP BY ALL)")


# --- Profiles -----------------------------------------------------------------------------------------------------------


@query(f"""SELECT CASE WHEN r > 0.5 THEN 'zh' WHEN r < 0.2 THEN 'en' ELSE 'mixed' END AS bucket, count(*) AS n FROM (SELECT {CJK_SQL.replace('{0}', "coalesce(text,'')")} / greatest({CJK_SQL.replace('{0}', "coalesce(text,'')")} + {ALNUM_SQL.replace('{0}', "coalesce(text,'')")}, 1) AS r FROM documents) GROUP BY 1""")
def profile_language_mix(s, d):
    return table(s, d, "documents").groupBy(T.language_bucket(F.col("text")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH w AS (SELECT len({WORDS_SQL.replace('{0}', 'text')}) AS words, lang FROM documents), o AS (SELECT lang, words, row_number() OVER (PARTITION BY lang ORDER BY words) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM w)
SELECT lang, max(n) AS n, max(CASE WHEN i = floor(n * 0.5) THEN words END) AS q50, max(CASE WHEN i = floor(0.9 * n) THEN words END) AS q90 FROM o GROUP BY lang""")
def profile_length_order_stats(s, d):
    w = table(s, d, "documents").select("lang", T.word_count(F.col("text")).alias("words"))
    return G.order_statistic(w, "words", [0.5, 0.9], "lang")


@query(f"WITH {TURNS_SQL}, x AS (SELECT unnest(turns).role AS role FROM t) SELECT role, count(*) AS n FROM x GROUP BY role")
def role_distribution(s, d):
    return _turns(s, d).select(F.explode("t").alias("x")).groupBy("x.role").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS rows, count(DISTINCT left(md5(image_bytes), 16)) AS distinct_images, avg(octet_length(image_bytes)) / 1024 AS mean_kb, max(octet_length(image_bytes)) / 1024 AS max_kb FROM sft_i2t WHERE image_bytes IS NOT NULL""")
def image_profile(s, d):
    return table(s, d, "sft_i2t").where("image_bytes IS NOT NULL").agg(F.count("*").alias("rows"), F.countDistinct(F.left(F.md5("image_bytes"), F.lit(16))).alias("distinct_images"), (F.avg(F.octet_length("image_bytes")) / 1024).alias("mean_kb"), (F.max(F.octet_length("image_bytes")) / 1024).alias("max_kb"))


@query(f"""WITH k AS (SELECT md5(text) AS a FROM documents WHERE text IS NOT NULL), n AS (SELECT a, count(*) AS c FROM k GROUP BY a) SELECT sum(c) AS rows, count(*) AS distinct_rows, sum(c) - count(*) AS duplicates, count(*) / sum(c) AS distinct_share FROM n""")
def duplicate_profile(s, d):
    return D.duplicate_counts(table(s, d, "documents").where("text IS NOT NULL"), F.md5("text"))


@query(f"""WITH k AS (SELECT {NEAR_SQL.format('text')} AS a FROM documents), n AS (SELECT a, count(*) AS c FROM k GROUP BY a) SELECT sum(c) AS rows, count(*) AS distinct_rows, sum(c) - count(*) AS duplicates, count(*) / sum(c) AS distinct_share FROM n""")
def duplicate_profile_normalised(s, d):
    return D.duplicate_counts(table(s, d, "documents"), T.normalise_near_dup(F.col("text")))


# --- Conversations ------------------------------------------------------------------------------------------------------


@query(f"""WITH {TURNS_SQL} SELECT row_id, trim(replace(coalesce(list_filter(turns, lambda x: x.role = 'user')[1].content, ''), '<image>', ''), E' \\t\\r\\n') AS user_text, coalesce(list_filter(turns, lambda x: x.role = 'assistant')[1].content, '') AS assistant_text FROM t""")
def first_turn_extract(s, d):
    t = _turns(s, d)
    return t.select("row_id", C.strip_image(C.first_content(F.col("t"), "user")).alias("user_text"), C.first_content(F.col("t"), "assistant").alias("assistant_text"))


@query(f"""WITH {TURNS_SQL}, i AS (SELECT row_id, turns, list_max(list_filter(range(1, len(turns) + 1), lambda k: turns[k].role = 'assistant')) - 1 AS p FROM t) SELECT row_id, p::INT AS history_turns, turns[p + 1].content AS reference FROM i WHERE p >= 1""")
def last_assistant_split(s, d):
    h, last = C.history_and_last(F.col("t"))
    return _turns(s, d).select("row_id", F.size(h).alias("history_turns"), last.alias("reference"), h.alias("h")).where("h IS NOT NULL").drop("h")


@query(f"""WITH {TURNS_SQL}, i AS (SELECT row_id, turns, coalesce(list_position(list_transform(turns, lambda x: x.role), 'assistant'), 0) - 1 AS p FROM t WHERE len(turns) > 0)
SELECT row_id FROM i WHERE p >= 1 AND list_bool_or(list_transform(turns[1:p], lambda x: coalesce(contains(x.content, '<image>'), false))) AND length(trim(turns[p + 1].content, E' \\t\\r\\n')) BETWEEN 8 AND 384""")
def rl_row_filter(s, d):
    return _turns(s, d).where(C.valid_for_reward(F.col("t"))).select("row_id")


@query(f"""WITH {TURNS_SQL}, x AS (SELECT row_id, unnest(list_transform(turns, lambda y: CASE WHEN y.role <> 'system' THEN replace(y.content, '<image>', '@@@') ELSE y.content END)) AS content FROM t) SELECT row_id, sum(length(content) - length(replace(content, '@', '')))::BIGINT AS markers FROM x WHERE content IS NOT NULL GROUP BY row_id""")
def image_markers(s, d):
    t = _turns(s, d).select("row_id", F.explode(C.expand_image(F.col("t"), "@", 3)).alias("x")).where("x.content IS NOT NULL")
    return t.groupBy("row_id").agg(F.sum(F.length("x.content") - F.length(F.replace(F.col("x.content"), F.lit("@"), F.lit("")))).alias("markers"))


@query(f"""WITH {TURNS_SQL} SELECT row_id, array_to_string(list_transform(turns, lambda x: '<|im_start|>' || x.role || chr(10) || coalesce(x.content, '') || '<|im_end|>' || chr(10)), '') AS rendered FROM t""")
def chat_template(s, d):
    return _turns(s, d).select("row_id", C.render_chat(F.col("t")).alias("rendered"))


@query("""SELECT question_id, CASE WHEN question IS NULL THEN NULL ELSE 'user' END AS role0, '<image>' || chr(10) || question || ' Answer briefly.' AS content0 FROM vqa_questions""")
def two_turn_conversation(s, d):
    q = table(s, d, "vqa_questions")
    t = C.turns(C.two_turns(F.col("question"), F.lit("x"), " Answer briefly."))
    return q.select("question_id", F.when(F.col("question").isNotNull(), t[0]["role"]).alias("role0"), t[0]["content"].alias("content0"))


@query(r"""SELECT row_id, u < 0.2 AS with_system FROM (SELECT row_id, ('0x' || left(md5(concat_ws(':', '7', row_id::VARCHAR)), 8))::BIGINT / 4294967296.0 AS u FROM sft_i2t) ORDER BY row_id""")
def system_prompt_draw(s, d):
    return table(s, d, "sft_i2t").select("row_id", (C.uniform(7, F.col("row_id")) < 0.2).alias("with_system"))


@query(f"""WITH {TURNS_SQL.replace('"content":"VARCHAR"', '"content":"VARCHAR","tools":"JSON"')}, u AS (SELECT row_id, turns, ('0x' || left(md5(concat_ws(':', '7', row_id::VARCHAR)), 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM t),
f AS (SELECT *, len(turns) > 0 AND u < 0.2 AND coalesce(turns[1].role, '') <> 'system' AND len(list_filter(turns, lambda x: coalesce(x.tools::VARCHAR NOT IN ('""', '', 'null', '[]'), false))) = 0 AS lead FROM u),
p AS (SELECT row_id, len(turns) + lead::INT AS n, u, CASE WHEN lead THEN ['You are a helpful assistant.', '你是一个可靠的助手。'][floor(u / 0.2 * 2)::INT + 1] ELSE coalesce(list_filter(turns, lambda x: x.role = 'system')[1].content, '') END AS txt FROM f)
SELECT row_id, n::INT AS turns, CASE WHEN u > 0.2 THEN replace(txt, '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10), '') ELSE txt END AS system_text FROM p""")
def preprocessed_chat(s, d):
    u = C.uniform(7, F.col("row_id"))
    t = _turns(s, d).select("row_id", C.with_system_prompt(F.col("t"), u, ["You are a helpful assistant.", "你是一个可靠的助手。"]).alias("t"))
    return t.select("row_id", F.size("t").alias("turns"), C.without_empty_thought(C.first_content(F.col("t"), "system"), u).alias("system_text"))


# --- Answers and parsers ------------------------------------------------------------------------------------------------


@query(f"""WITH {LATEST_SQL}, e AS (SELECT question_id, unnest(answers).answer_id AS answer_id, unnest(answers).answer AS answer FROM la) SELECT question_id, answer_id, {NORM_A_SQL.format('answer')} AS a, lower(trim(answer)) AS c FROM e""")
def answer_normalise_a(s, d):
    a = _latest_annotations(s, d).select("question_id", F.explode("answers").alias("x"))
    return a.select("question_id", "x.answer_id", T.normalise_a(F.col("x.answer")).alias("a"), T.normalise_c(F.col("x.answer")).alias("c"))


NUM_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.NUMBER_WORDS.items()) + "}"
NORM_B_SQL = r"array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(answer, '')), '[!-/:-@\[-`{-~]', ' ', 'g'), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), lambda w: coalesce(element_at(@NUM, w)[1], w)), ' ')".replace("@NUM", NUM_SQL)


@query(f"""WITH {LATEST_SQL}, e AS (SELECT question_id, unnest(answers).answer_id AS answer_id, unnest(answers).answer AS answer FROM la), b AS (SELECT question_id, answer_id, answer, {NORM_B_SQL.replace('element_at', 'map_extract')} AS b FROM e)
SELECT question_id, answer_id, b, CASE WHEN starts_with(b, 'yes') THEN 'yes' WHEN starts_with(b, 'no') THEN 'no' ELSE 'unknown' END AS yes_no FROM b""")
def answer_normalise_b(s, d):
    a = _latest_annotations(s, d).select("question_id", F.explode("answers").alias("x"))
    return a.select("question_id", "x.answer_id", T.normalise_b(F.col("x.answer")).alias("b"), T.yes_no_normalised(F.col("x.answer")).alias("yes_no"))


@query(r"""SELECT pair_id, CASE WHEN starts_with(t, 'yes') THEN 'yes' WHEN starts_with(t, 'no') THEN 'no' END AS by_prefix, CASE WHEN regexp_matches(t, '^(yes|yeah|y)') THEN 'yes' WHEN regexp_matches(t, '^(no|nope|not)') THEN 'no' END AS by_pattern FROM (SELECT pair_id, lower(trim(chosen)) AS t FROM preference_pairs)""")
def yesno_parse(s, d):
    return table(s, d, "preference_pairs").select("pair_id", T.yes_no_prefix(F.col("chosen")).alias("by_prefix"), T.yes_no_pattern(F.col("chosen")).alias("by_pattern"))


SPACES_SQL = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"


@query(rf"""SELECT pair_id, coalesce(nullif(regexp_extract(trim(coalesce(rejected, '')), '{T.ALONE % "ABCD"}', 1), ''), nullif(regexp_extract(trim(coalesce(rejected, '')), '(?i)answer{SPACES_SQL}[:\-]?{SPACES_SQL}([ABCD])', 1), '')) AS letter, upper(regexp_extract(coalesce(rejected, ''), '{T.ALONE % "A-Da-d"}', 1)) AS any_case, coalesce(TRY_CAST(regexp_extract(translate(coalesce(rejected, ''), '０１２３４５６７８９', '0123456789'), '([0-9]+(?:\.[0-9]+)?)', 1) AS DOUBLE), 3.0) AS score FROM preference_pairs""")
def choice_letter(s, d):
    return table(s, d, "preference_pairs").select("pair_id", T.choice_letter(F.col("rejected")).alias("letter"), T.choice_letter_any_case(F.col("rejected")).alias("any_case"), T.judge_score(F.col("rejected")).alias("score"))


@query(r"""SELECT caption_id, TRY_CAST(regexp_extract(coalesce(file_name, ''), '([0-9]{12})', 1) AS BIGINT) AS file_id, lpad(image_id::VARCHAR, 12, '0') AS padded, coalesce(nullif(trim(replace(replace(replace(replace(coalesce(caption, ''), chr(13), ' '), chr(10), ' '), '|||', ' '), '  ', ' ')), ''), '.') AS line FROM captions""")
def caption_lines(s, d):
    return table(s, d, "captions").select("caption_id", T.image_id_of(F.col("file_name")).alias("file_id"), T.padded_id(F.col("image_id")).alias("padded"), T.sanitise_line(F.col("caption")).alias("line"))


@query(r"""WITH a AS (SELECT pair_id, lower(coalesce(chosen, '')) AS t FROM preference_pairs), f AS (SELECT regexp_matches(t, 'as an ai|i (can''?t|cannot|am not able)|i don''?t have|cannot see|no image|without (the|an) image|unable to|not (able to|possible) (to )?(determine|answer|see|provide)') AS refusal, regexp_full_match(t, '[\s\p{Z}]*') AS empty, regexp_matches(t, 'maybe|perhaps|possibly|could be|might be') AS hedge FROM a)
SELECT count(*) AS n, count_if(refusal) AS refusals, count_if(empty) AS empties, count_if(NOT refusal AND NOT empty AND NOT hedge) AS concrete FROM f""")
def refusal_rates(s, d):
    t = F.lower(F.coalesce("chosen", F.lit("")))
    p = table(s, d, "preference_pairs").select(T.is_refusal(t).alias("refusal"), t.rlike(r"^[\s\p{Z}]*$").alias("empty"), T.is_hedge(t).alias("hedge"))
    return p.agg(F.count("*").alias("n"), F.count_if("refusal").alias("refusals"), F.count_if("empty").alias("empties"), F.count_if(~F.col("refusal") & ~F.col("empty") & ~F.col("hedge")).alias("concrete"))


@query(f"""SELECT pair_id FROM preference_pairs WHERE lower(trim(chosen)) NOT IN ('yes', 'no') AND len({WORDS_SQL.replace('{0}', 'chosen')}) >= 2 AND len({WORDS_SQL.replace('{0}', 'rejected')}) >= 1""")
def preference_quality(s, d):
    return table(s, d, "preference_pairs").where(~F.lower(F.trim("chosen")).isin("yes", "no") & (T.word_count(F.col("chosen")) >= 2) & (T.word_count(F.col("rejected")) >= 1)).select("pair_id")


# --- Joins, votes, builders ---------------------------------------------------------------------------------------------


@query(f"""WITH {VOTES_SQL}, c AS (SELECT question_id, answer, count(*) AS n, min(pos) AS p FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, p, answer) AS k FROM c), q AS (SELECT question_id, image_id, question FROM vqa_questions QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY coalesce(ingested_at, TIMESTAMPTZ '9999-01-01 00:00:00+00'), question) = 1)
SELECT q.question_id, q.image_id, r.answer, r.n FROM q JOIN r ON q.question_id = r.question_id AND r.k = 1""")
def consensus_answer(s, d):
    top = R.ranked_answers(_votes(s, d), "question_id", "answer", "pos").where("rank = 1").drop("rank")
    q = R.first_per_key(table(s, d, "vqa_questions"), ["question_id"], [F.coalesce("ingested_at", F.lit("9999-01-01").cast("timestamp")), F.col("question")])
    return q.select("question_id", "image_id").join(top, "question_id")


@query(f"""WITH {VOTES_SQL}, c AS (SELECT question_id, answer, count(*) AS n, min(pos) AS p FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, p, answer) AS k FROM c)
SELECT question_id, max(CASE WHEN k = 1 THEN answer END) AS chosen, max(CASE WHEN k = 2 THEN answer END) AS rejected FROM r GROUP BY question_id HAVING count(*) >= 2""")
def preference_pairs_from_votes(s, d):
    r = R.ranked_answers(_votes(s, d), "question_id", "answer", "pos").where("rank <= 2")
    g = r.groupBy("question_id").agg(F.max(F.when(F.col("rank") == 1, F.col("answer"))).alias("chosen"), F.max(F.when(F.col("rank") == 2, F.col("answer"))).alias("rejected"))
    return g.where("rejected IS NOT NULL")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1""")
def last_wins_join(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    return R.first_per_key(li, ["l_orderkey", "l_linenumber"], [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity")], last=True).drop("l_shipdate")


def _scenes(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey").join(table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand")), "l_partkey").select("l_orderkey", "brand")


SCENES_SQL = "sc AS (SELECT l_orderkey, p_brand AS brand FROM lineitem JOIN part ON l_partkey = p_partkey), have AS (SELECT DISTINCT l_orderkey, brand FROM sc)"


def _many(pairs):
    k = pairs.groupBy("l_orderkey").agg(F.countDistinct("brand").alias("k")).where("k >= 3").select("l_orderkey")
    return pairs.join(k, "l_orderkey", "left_semi")


@query(f"WITH {SCENES_SQL} SELECT a.brand, b.brand AS other, count(*) AS n FROM sc a JOIN have b ON a.l_orderkey = b.l_orderkey AND a.brand <> b.brand GROUP BY ALL")
def cooccurrence_counts(s, d):
    return R.cooccurrence(_scenes(s, d), "l_orderkey", "brand")


NEG_SQL = f"WITH {SCENES_SQL}, many AS (SELECT l_orderkey FROM have GROUP BY 1 HAVING count(*) >= 3), pool AS (@POOL), ab AS (SELECT m.l_orderkey, p.brand FROM many m, pool p WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.l_orderkey = m.l_orderkey AND h.brand = p.brand)) SELECT l_orderkey, brand FROM ab QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY md5(concat_ws(':', '@SEED', l_orderkey::VARCHAR, brand)), brand) <= 3"


@query(NEG_SQL.replace("@POOL", "SELECT DISTINCT p_brand AS brand FROM part").replace("@SEED", "1"))
def existence_negatives_random(s, d):
    pool = table(s, d, "part").select(F.col("p_brand").alias("brand")).distinct()
    return R.negatives(_many(_scenes(s, d)), "l_orderkey", "brand", 3, 1, pool)


@query(NEG_SQL.replace("@POOL", "SELECT brand FROM sc GROUP BY brand ORDER BY count(*) DESC, min(l_orderkey), brand LIMIT 10").replace("@SEED", "2"))
def existence_negatives_popular(s, d):
    sc = _scenes(s, d)
    return R.negatives(_many(sc), "l_orderkey", "brand", 3, 2, R.top_k(sc, "brand", 10, F.col("l_orderkey")).select("brand"))


@query(f"""WITH {SCENES_SQL}, many AS (SELECT l_orderkey FROM have GROUP BY 1 HAVING count(*) >= 3), hm AS (SELECT h.* FROM have h SEMI JOIN many USING (l_orderkey)), co AS (SELECT DISTINCT a.brand AS i, b.brand FROM hm a JOIN hm b ON a.l_orderkey = b.l_orderkey AND a.brand <> b.brand), nr AS (SELECT DISTINCT h.l_orderkey, c.brand FROM hm h JOIN co c ON h.brand = c.i), ab AS (SELECT * FROM nr n WHERE NOT EXISTS (SELECT 1 FROM hm h WHERE h.l_orderkey = n.l_orderkey AND h.brand = n.brand))
SELECT l_orderkey, brand FROM ab QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY md5(concat_ws(':', '3', l_orderkey::VARCHAR, brand)), brand) <= 3""")
def existence_negatives_adversarial(s, d):
    return R.adversarial_negatives(_many(_scenes(s, d)), "l_orderkey", "brand", 3, 3)


@query(f"WITH {SCENES_SQL} SELECT l_orderkey, brand, count(*) AS n FROM sc GROUP BY ALL")
def count_per_category(s, d):
    return _scenes(s, d).groupBy("l_orderkey", "brand").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 600 + (10 + l_quantity) / 2) / 640 AS cx, (l_suppkey * 37 % 440 + (10 + l_linenumber) / 2) / 480 AS cy FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN cx BETWEEN 0.35 AND 0.65 AND cy BETWEEN 0.35 AND 0.65 THEN 'center' WHEN abs(cy - 0.5) <= abs(cx - 0.5) THEN CASE WHEN cx < 0.5 THEN 'left' ELSE 'right' END WHEN cy < 0.5 THEN 'top' ELSE 'bottom' END AS position FROM b""")
def spatial_position(s, d):
    x, y = (F.col("l_partkey") % 600).cast("double"), (F.col("l_suppkey") * 37 % 440).cast("double")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.position_of(x, y, 10 + F.col("l_quantity"), 10.0 + F.col("l_linenumber")).alias("position"))


# --- Samples, unions, windows -------------------------------------------------------------------------------------------


@query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws(':', '42', doc_id::VARCHAR)), doc_id) <= 50")
def balanced_sample(s, d):
    return R.balanced_sample(table(s, d, "documents").select("lang", "doc_id"), "lang", 50, 42, "doc_id")


@query("""WITH a AS (SELECT doc_id, lang FROM documents WHERE lang = 'en' ORDER BY md5(concat_ws(':', '42', doc_id::VARCHAR)), doc_id LIMIT 100), b AS (SELECT doc_id, lang FROM documents WHERE lang = 'zh' ORDER BY md5(concat_ws(':', '42', doc_id::VARCHAR)), doc_id LIMIT 50) SELECT * FROM a UNION ALL SELECT * FROM b""")
def mix_union_shuffle(s, d):
    x = table(s, d, "documents").select("doc_id", "lang")
    return R.mix([(x.where("lang = 'en'"), 100), (x.where("lang = 'zh'"), 50)], 42, "doc_id")


@query("""WITH h AS (SELECT pair_id FROM preference_pairs ORDER BY md5(concat_ws(':', '9', pair_id::VARCHAR)), pair_id LIMIT 100) SELECT p.pair_id, CASE WHEN h.pair_id IS NULL THEN 'train' ELSE 'eval' END AS part FROM preference_pairs p LEFT JOIN h ON p.pair_id = h.pair_id""")
def exact_split(s, d):
    return R.exact_split(table(s, d, "preference_pairs").select("pair_id"), 100, 9, "pair_id")


@query("SELECT doc_id AS id, text AS body, NULL::VARCHAR AS extra FROM documents UNION ALL SELECT caption_id, NULL, caption FROM captions")
def widening_union(s, d):
    return R.union_all([table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body")), table(s, d, "captions").select(F.col("caption_id").alias("id"), F.col("caption").alias("extra"))], widen=True)


@query("SELECT task, md5(image_bytes) AS image, md5(conversations) AS talk, min(row_id) AS row_id FROM sft_i2t WHERE image_bytes IS NOT NULL AND conversations IS NOT NULL GROUP BY ALL")
def dedup_exact_keep_first(s, d):
    x = table(s, d, "sft_i2t").where("image_bytes IS NOT NULL AND conversations IS NOT NULL").select("row_id", "task", F.md5("image_bytes").alias("image"), F.md5(F.encode("conversations", "UTF-8")).alias("talk"))
    return x.groupBy("task", "image", "talk").agg(F.min("row_id").alias("row_id"))


@query("SELECT doc_id, image_id, coalesce(lead(doc_id) OVER (PARTITION BY image_id ORDER BY doc_id), first_value(doc_id) OVER (PARTITION BY image_id ORDER BY doc_id)) AS next_id FROM documents WHERE image_id IS NOT NULL")
def cyclic_lead(s, d):
    return R.next_cyclic(table(s, d, "documents").where("image_id IS NOT NULL").select("doc_id", "image_id"), "doc_id", "doc_id", "next_id", "image_id")


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS running FROM events")
def cumulative_mean(s, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return table(s, d, "events").select("user_id", "event_id", r6(F.avg("value").over(w)).alias("running"))


@query("SELECT event_type, count(*) AS total, count_if(value > 50) AS correct, count_if(value > 50) / count(*) AS accuracy FROM events GROUP BY event_type")
def accuracy_by_category(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(F.col("value") > 50).alias("correct")).withColumn("accuracy", F.col("correct") / F.col("total"))


# --- Metrics ------------------------------------------------------------------------------------------------------------


@query(f"WITH {_captions_sql()}, {GRAMS_SQL} SELECT n, gram, count(DISTINCT id) AS df FROM g WHERE ref >= 0 GROUP BY ALL")
def document_frequency(s, d):
    return M.document_frequency(_captions(s, d))


@query(f"""WITH {_captions_sql()}, {GRAMS_SQL}, best AS (SELECT id, n, gram, max(tf) AS most FROM g WHERE ref >= 0 GROUP BY ALL), per AS (SELECT p.n, sum(least(p.tf, coalesce(b.most, 0))) / sum(p.tf) AS pr FROM g p LEFT JOIN best b ON p.id = b.id AND p.n = b.n AND p.gram = b.gram WHERE p.ref = -1 GROUP BY p.n),
cl AS (SELECT r.id, len(p.tok) AS lp, min(struct_pack(d := abs(len(r.tok) - len(p.tok)), l := len(r.tok))).l AS lr FROM cap p JOIN cap r ON p.id = r.id AND p.ref = -1 AND r.ref >= 0 GROUP BY r.id, len(p.tok)), len AS (SELECT sum(lp) AS p, sum(lr) AS r FROM cl),
x AS (SELECT max(CASE WHEN n = 1 THEN pr END) AS p1, max(CASE WHEN n = 2 THEN pr END) AS p2, max(CASE WHEN n = 3 THEN pr END) AS p3, max(CASE WHEN n = 4 THEN pr END) AS p4 FROM per)
SELECT round(bp * p1, 6) AS bleu1, round(CASE WHEN least(p1, p2) > 0 THEN bp * exp((ln(p1) + ln(p2)) / 2) ELSE 0 END, 6) AS bleu2, round(CASE WHEN least(p1, p2, p3) > 0 THEN bp * exp((ln(p1) + ln(p2) + ln(p3)) / 3) ELSE 0 END, 6) AS bleu3, round(CASE WHEN least(p1, p2, p3, p4) > 0 THEN bp * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) ELSE 0 END, 6) AS bleu4 FROM x, (SELECT CASE WHEN p > r THEN 1.0 ELSE exp(1 - r / greatest(p, 1)) END AS bp FROM len)""")
def corpus_bleu(s, d):
    b = M.corpus_bleu(_captions(s, d))
    return b.select(*[r6(F.col(c)).alias(c) for c in b.columns])


@query(f"""WITH {_captions_sql()}, {GRAMS_SQL}, dfr AS (SELECT n, gram, count(DISTINCT id) AS df FROM g WHERE ref >= 0 GROUP BY ALL), nd AS (SELECT count(DISTINCT id) AS nd FROM cap), w AS (SELECT g.*, tf * ln(greatest(1.0, nd / greatest(coalesce(df, 0), 1))) AS w FROM g LEFT JOIN dfr USING (n, gram), nd), nm AS (SELECT id, ref, n, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
dt AS (SELECT r.id, r.ref, r.n, sum(p.w * r.w) AS dot FROM w p JOIN w r ON p.id = r.id AND p.n = r.n AND p.gram = r.gram AND p.ref = -1 AND r.ref >= 0 GROUP BY ALL), ln AS (SELECT r.id, r.ref, len(p.tok) AS lp, len(r.tok) AS lr FROM cap p JOIN cap r ON p.id = r.id AND p.ref = -1 AND r.ref >= 0),
sm AS (SELECT dt.id, sum(CASE WHEN nr.norm > 0 AND np.norm > 0 THEN dot / (nr.norm * np.norm) * exp(-pow(lp - lr, 2) / 72.0) ELSE 0 END) AS s FROM dt JOIN nm nr ON dt.id = nr.id AND dt.ref = nr.ref AND dt.n = nr.n JOIN nm np ON dt.id = np.id AND np.ref = -1 AND dt.n = np.n JOIN ln ON dt.id = ln.id AND dt.ref = ln.ref GROUP BY dt.id)
SELECT k.id, round(coalesce(s, 0) * 10.0 / 4.0 / k.k, 5) AS cider FROM (SELECT id, count(*) - 1 AS k FROM cap GROUP BY id) k LEFT JOIN sm ON k.id = sm.id""")
def cider(s, d):
    return M.cider(_captions(s, d)).select("id", F.round("cider", 5).alias("cider"))


@query(f"""WITH {_captions_sql()}, j AS (SELECT p.id, r.ref, list_distinct(p.tok) AS a, list_distinct(r.tok) AS b FROM cap p JOIN cap r ON p.id = r.id AND p.ref = -1 AND r.ref >= 0) SELECT id, ref, round(1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS distance FROM j""")
def jaccard(s, d):
    return _captions(s, d).select("id", "pred", F.posexplode("refs").alias("ref", "tok")).select("id", F.col("ref").cast("long").alias("ref"), r6(M.jaccard_distance(F.col("pred"), F.col("tok"))).alias("distance"))


# Longest common subsequences row by row, and greedy alignments token by token, of the prediction with each reference.
ALIGN_SQL = """pr AS (SELECT p.id, r.ref, p.tok AS a, r.tok AS b, list_transform(range(1, len(r.tok) + 1), lambda j: [j]) AS js FROM cap p JOIN cap r ON p.id = r.id AND p.ref = -1 AND r.ref >= 0),
lcs AS (SELECT id, ref, a, b, js, 1 AS i, list_transform(range(0, len(b) + 1), lambda j: 0::BIGINT) AS prev FROM pr UNION ALL SELECT id, ref, a, b, js, i + 1, list_reduce(js, lambda r, e: r || [CASE WHEN a[i] = b[e[1]] THEN prev[e[1]] + 1 ELSE greatest(prev[e[1] + 1], r[len(r)]) END], [0::BIGINT]) FROM lcs WHERE i <= len(a)),
rl AS (SELECT id, max(CASE WHEN n > 0 THEN 2.44 * (n / la) * (n / lb) / (n / lb + 1.44 * n / la) ELSE 0.0 END) AS rouge_l FROM (SELECT id, prev[len(prev)] AS n, len(a) AS la, len(b) AS lb FROM lcs WHERE i = len(a) + 1) GROUP BY id),
al AS (SELECT id, ref, a, b, 1 AS i, []::BIGINT[] AS o FROM pr UNION ALL SELECT id, ref, a, b, i + 1, o || coalesce(list_sort(list_transform(list_filter(range(1, len(b) + 1), lambda j: b[j] = a[i] AND NOT list_contains(o, j)), lambda j: CASE WHEN len(o) = 0 THEN [0, j, j] ELSE [(j < o[len(o)])::INT, abs(j - o[len(o)]), j] END))[1][3:3], []) FROM al WHERE i <= len(a)),
me AS (SELECT id, max(CASE WHEN m > 0 THEN 10 * (m / la) * (m / lb) / (m / lb + 9 * m / la) * (1 - 0.5 * pow(pieces / m, 3)) ELSE 0.0 END) AS meteor_exact FROM (SELECT id, len(o) AS m, len(a) AS la, len(b) AS lb, 1 + len(list_filter(range(1, len(o)), lambda k: o[k + 1] - o[k] <> 1)) AS pieces FROM al WHERE i = len(a) + 1) GROUP BY id)"""


@query(f"WITH RECURSIVE {_captions_sql()}, {ALIGN_SQL} SELECT id, round(rouge_l, 6) AS rouge_l, round(meteor_exact, 6) AS meteor_exact FROM rl JOIN me USING (id)")
def alignment_metrics(s, d):
    return M.alignment_metrics(_captions(s, d)).select("id", r6("rouge_l").alias("rouge_l"), r6("meteor_exact").alias("meteor_exact"))


@query(f"""SELECT round(bleu1, 5) AS bleu1, round(bleu2, 5) AS bleu2, round(bleu3, 5) AS bleu3, round(bleu4, 5) AS bleu4, round(rouge_l, 4) AS rouge_l, round(meteor_exact, 4) AS meteor_exact, round(cider, 4) AS cider, round(avg_tokens, 5) AS avg_tokens, empty_rate FROM ({Q['corpus_bleu'][1]}), (SELECT avg(cider) AS cider FROM ({Q['cider'][1]})),
(SELECT avg(rouge_l) AS rouge_l, avg(meteor_exact) AS meteor_exact FROM ({Q['alignment_metrics'][1]})), (WITH {_captions_sql()} SELECT avg(len(tok)) AS avg_tokens, avg((len(tok) = 0)::INT) AS empty_rate FROM cap WHERE ref = -1)""")
def caption_metric_bundle(s, d):
    digits = {"rouge_l": 4, "meteor_exact": 4, "cider": 4}
    m = M.caption_metrics(_captions(s, d))
    return m.select(*[F.round(c, digits.get(c, 5)).alias(c) if c != "empty_rate" else F.col(c) for c in m.columns])


F1_SQL = """tf AS (SELECT id, ref, w, count(*) AS tf FROM (SELECT id, ref, unnest(tok) AS w FROM cap) GROUP BY ALL), hit AS (SELECT r.id, r.ref, sum(least(p.tf, r.tf)) AS hit FROM tf p JOIN tf r ON p.id = r.id AND p.w = r.w AND p.ref = -1 AND r.ref >= 0 GROUP BY ALL),
f1 AS (SELECT p.id, max(2.0 * coalesce(hit, 0) / (len(p.tok) + len(r.tok))) AS f1 FROM cap p JOIN cap r ON p.id = r.id AND p.ref = -1 AND r.ref >= 0 LEFT JOIN hit ON hit.id = r.id AND hit.ref = r.ref GROUP BY p.id),
rep AS (SELECT id, CASE WHEN len(tok) < 2 THEN 0.0 ELSE 1 - len(list_distinct(list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1]))) / (len(tok) - 1) END AS repetition FROM cap WHERE ref = -1)"""


@query(f"WITH {_captions_sql()}, {F1_SQL} SELECT id, round(f1, 6) AS f1, round(repetition, 6) AS repetition FROM f1 JOIN rep USING (id)")
def reward_parts(s, d):
    c = _captions(s, d)
    best = F.array_max(F.transform("refs", lambda r: RW.unigram_f1(F.col("pred"), r)))
    return c.select("id", r6(best).alias("f1"), r6(RW.repetition(F.col("pred"))).alias("repetition"))


@query(f"""WITH RECURSIVE {_captions_sql()}, {F1_SQL}, {ALIGN_SQL}, ls AS (SELECT p.id, arg_min(least(len(p.tok), len(r.tok)) / greatest(len(p.tok), len(r.tok), 1), struct_pack(d := abs(len(r.tok) - len(p.tok)), l := r.ref)) AS length_score FROM cap p JOIN cap r ON p.id = r.id AND p.ref = -1 AND r.ref >= 0 GROUP BY p.id)
SELECT id, round(least(greatest(@WEIGHTED, -1), 1), 6) AS reward FROM f1 JOIN rep USING (id) JOIN rl USING (id) JOIN me USING (id) JOIN ls USING (id)""".replace("@WEIGHTED", " + ".join(f"({-w if k == 'repetition_penalty' else w}) * {'f1' if k == 'unigram_f1' else 'repetition' if k == 'repetition_penalty' else k}" for k, w in RW.WEIGHTS.items())))
def reward_composite(s, d):
    return RW.reference_reward(_captions(s, d)).select("id", r6("reward").alias("reward"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - avg(l_quantity) OVER w) / (stddev_pop(l_quantity) OVER w + 1e-4), 4) AS advantage FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def advantage(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return RW.advantages(li, "l_orderkey", "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("advantage", 4).alias("advantage"))


@query("SELECT count(*) AS pairs, round(avg(l_discount - 0.05), 6) AS margin_before, round(avg(l_discount - l_tax), 6) AS margin_after, avg((l_discount - 0.05 > 0)::INT) AS win_before, avg((l_discount - l_tax > 0)::INT) AS win_after, round(avg((l_discount - l_tax) - (l_discount - 0.05)), 6) AS gain, avg(((l_discount - l_tax) > (l_discount - 0.05))::INT) AS improved FROM lineitem")
def margin_winrate(s, d):
    li = table(s, d, "lineitem").select((F.col("l_discount") - 0.05).alias("b"), (F.col("l_discount") - F.col("l_tax")).alias("a"))
    m = RW.margin_report(li, "b", "a")
    return m.select("pairs", r6("margin_before").alias("margin_before"), r6("margin_after").alias("margin_after"), "win_before", "win_after", r6("gain").alias("gain"), "improved")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity >= l_linenumber * 8 THEN 'a' ELSE 'b' END AS chosen FROM lineitem WHERE abs(l_quantity - l_linenumber * 8) >= 10")
def judge_pairs(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("a").alias("a"), F.lit("b").alias("b"), F.col("l_quantity").alias("sa"), (F.col("l_linenumber") * 8).cast("double").alias("sb"))
    return RW.label_by_judge(li, "a", "b", "sa", "sb", 10.0).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "chosen")


# --- Grading ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {VOTES_SQL}, g AS (SELECT question_id, first(answer_type) AS answer_type, count(*) AS n FROM v GROUP BY question_id), c AS (SELECT question_id, answer, count(*) AS m FROM v GROUP BY ALL)
SELECT c.question_id, answer, round((m * least(1.0, (m - 1) / 3.0) + (n - m) * least(1.0, m / 3.0)) / n, 6) AS consensus, round(least(1.0, m / 3.0), 6) AS three FROM c JOIN g USING (question_id)""")
def vqa_consensus(s, d):
    c = _votes(s, d).groupBy("question_id", "answer").agg(F.count("*").alias("m"))
    g = c.groupBy("question_id").agg(F.sum("m").alias("n"))
    return c.join(g, "question_id").select("question_id", "answer", r6(G.leave_one_out_consensus(F.col("m"), F.col("n"))).alias("consensus"), r6(G.three_of_ten(F.col("m"))).alias("three"))


BINARY_SQL = """WITH x AS (SELECT event_type, CASE WHEN value > 60 THEN 'yes' WHEN value > 5 THEN 'no' ELSE 'unknown' END AS p, CASE WHEN user_id % 2 = 0 THEN 'yes' ELSE 'no' END AS y FROM events), c AS (SELECT {g} count(*) AS total, count_if(p = y) AS ok, count_if(p = 'yes' AND y = 'yes') AS tp, count_if(p = 'yes' AND y = 'no') AS fp, count_if(p <> 'yes' AND y = 'yes') AS fn, count_if(p = 'yes') AS ys, count_if(p = 'unknown') AS un FROM x {by}), r AS (SELECT *, tp / greatest(tp + fp, 1) AS pr, tp / greatest(tp + fn, 1) AS rc FROM c)
SELECT {g} total, ok / total AS accuracy, pr AS precision, rc AS recall, round(2 * pr * rc / greatest(pr + rc, 1e-12), 9) AS f1, ys / total AS yes_ratio, un / total AS unknown_ratio FROM r"""


def _binary(s, d, *by):
    e = table(s, d, "events")
    p = F.when(F.col("value") > 60, "yes").when(F.col("value") > 5, "no").otherwise("unknown")
    y = F.when(F.col("user_id") % 2 == 0, "yes").otherwise("no")
    return G.binary_summary(e, p, y, *by).withColumn("f1", F.round("f1", 9))


@query(BINARY_SQL.format(g="", by=""))
def binary_summary(s, d):
    return _binary(s, d)


@query(BINARY_SQL.format(g="event_type,", by="GROUP BY event_type"))
def setting_summary(s, d):
    return _binary(s, d, "event_type")


CONFIDENCE_SQL = "x AS (SELECT (user_id % 2)::DOUBLE AS y, 1 / (1 + exp(-coalesce(value, 0) / 50)) AS c FROM events)"


def _confidences(s, d):
    return table(s, d, "events").select((F.col("user_id") % 2).alias("y"), (1 / (1 + F.exp(-F.coalesce("value", F.lit(0.0)) / 50))).alias("c"))


@query(f"""WITH {CONFIDENCE_SQL}, b AS (SELECT least(floor(c * 10)::INT, 9) AS bin, count(*) AS n, sum(y) AS y, sum(c) AS c FROM x GROUP BY 1) SELECT round(sum(abs(y - c)) / sum(n), 6) AS ece FROM b""")
def ece(s, d):
    return G.expected_calibration_error(_confidences(s, d), F.col("y"), F.col("c")).select(r6("ece").alias("ece"))


@query("""WITH x AS (SELECT (user_id % 2) AS y, value AS s FROM events WHERE value IS NOT NULL), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM x), a AS (SELECT sum(CASE WHEN y = 1 THEN r END) AS rs, count_if(y = 1) AS p, count_if(y = 0) AS n FROM r) SELECT round((rs - p * (p + 1) / 2.0) / (p * n), 6) AS auc, round(1 - (rs - p * (p + 1) / 2.0) / (p * n), 6) AS descending_statistic FROM a""")
def rank_statistic(s, d):
    e = table(s, d, "events").where("value IS NOT NULL").select((F.col("user_id") % 2).alias("y"), "value")
    return G.area_under_curve(e, "y", "value").select(r6("auc").alias("auc"), r6("descending_statistic").alias("descending_statistic"))


@query(f"""WITH x AS (SELECT length(text) AS a, len({WORDS_SQL.replace('{0}', 'text')}) AS b FROM documents WHERE text IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x) SELECT count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM r""")
def spearman(s, d):
    x = table(s, d, "documents").where("text IS NOT NULL").select(F.length("text").alias("a"), T.word_count(F.col("text")).alias("b"))
    return G.spearman(x, "a", "b").select("n", r6("spearman").alias("spearman"))


@query("SELECT event_type, round(sum(value) / greatest(sum(0.5 + user_id % 7), 1e-9), 6) AS per_second, round(avg(0.5 + user_id % 7), 6) AS mean_seconds FROM events GROUP BY event_type")
def throughput(s, d):
    sec = 0.5 + F.col("user_id") % 7
    return table(s, d, "events").groupBy("event_type").agg(r6(F.sum("value") / F.greatest(F.sum(sec), F.lit(1e-9))).alias("per_second"), r6(F.avg(sec)).alias("mean_seconds"))


# --- Near-duplicates of the reference -----------------------------------------------------------------------------------


# Distinct normalised texts with their shingles of five words (a shorter text is one shingle).
SHINGLES_SQL = f"""sw AS (SELECT doc_id, string_split({NEAR_SQL.format('text')}, ' ') AS w FROM documents WHERE doc_id IS NOT NULL), ws AS (SELECT doc_id, w FROM sw WHERE w[1] <> ''),
tx AS (SELECT array_to_string(w, ' ') AS whole, min(doc_id) AS rep, any_value(w) AS w FROM ws GROUP BY 1), sh AS (SELECT rep, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g FROM tx)"""
CLUSTERS_SQL = f"""WITH RECURSIVE {SHINGLES_SQL}, ns AS (SELECT rep, count(*) AS n FROM sh GROUP BY rep), ps AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL),
lk AS (SELECT a, b FROM ps JOIN ns na ON na.rep = a JOIN ns nb ON nb.rep = b WHERE c >= 0.8 * (na.n + nb.n - c) - 1e-9), bw AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk), rc AS (SELECT rep AS a, rep AS b FROM tx UNION SELECT rc.a, bw.b FROM rc JOIN bw ON rc.b = bw.a), gr AS (SELECT a AS rep, min(b) AS component FROM rc GROUP BY a),
al AS (SELECT ws.doc_id AS id, component, count(*) OVER (PARTITION BY component) AS k FROM ws JOIN tx ON array_to_string(ws.w, ' ') = whole JOIN gr ON gr.rep = tx.rep)"""


SIGNATURES_SQL = f"""WITH RECURSIVE {SHINGLES_SQL.replace("min(doc_id) AS rep, any_value(w) AS w FROM ws GROUP BY 1", "doc_id AS rep, w FROM ws")}, lc AS (SELECT 1 AS i, 12345::BIGINT AS x UNION ALL SELECT i + 1, (1103515245 * x + 12345) % 2147483647 FROM lc WHERE i <= 128), pm AS (SELECT i // 2 AS k, max(CASE WHEN i % 2 = 0 THEN greatest(x, 1) END) AS a, max(CASE WHEN i % 2 = 1 THEN x END) AS b FROM lc WHERE i > 1 GROUP BY 1),
hs AS (SELECT DISTINCT rep, ('0x' || left(md5(g), 8))::BIGINT % 2147483647 AS h FROM sh), mn AS (SELECT rep, k, min((h * a + b) % 2147483647) AS m FROM hs, pm GROUP BY ALL), sg AS (SELECT rep AS id, list(m ORDER BY k) AS sig FROM mn GROUP BY rep)"""


@query(f"{SIGNATURES_SQL} SELECT id, sig FROM sg")
def minhash_signature(s, d):
    return D.signatures(table(s, d, "documents"), "doc_id", F.col("text"), 64)


@query(f"{CLUSTERS_SQL} SELECT id, component FROM al WHERE k > 1")
def near_dup_clusters(s, d):
    return D.near_clusters(D.shingled(table(s, d, "documents"), "doc_id", F.col("text")))


@query(f"{CLUSTERS_SQL}, cl AS (SELECT count(*) AS texts, count_if(k > 1) AS clustered, count(DISTINCT CASE WHEN k > 1 THEN component END) AS clusters FROM al) SELECT texts, clusters, clustered, clustered - clusters AS near_duplicates, (clustered - clusters) / greatest(texts, 1) AS share FROM cl")
def near_dup_profile(s, d):
    return D.near_profile(D.shingled(table(s, d, "documents"), "doc_id", F.col("text")))


@query(f"""{SIGNATURES_SQL}, nn AS (SELECT greatest(1, count(*) // 100) AS slots FROM sg), le AS (SELECT id, sig, ('0x' || left(md5(concat_ws(':', '6', id::VARCHAR)), 8))::BIGINT % slots AS slot FROM (SELECT * FROM sg ORDER BY md5(concat_ws(':', '5', id::VARCHAR)), id LIMIT 15000), nn), ri AS (SELECT id, sig, ('0x' || left(md5(concat_ws(':', '7', id::VARCHAR)), 8))::BIGINT % slots AS slot FROM sg, nn),
eq AS (SELECT len(list_filter(list_zip(le.sig, ri.sig), lambda z: z[1] = z[2])) / 64 AS q FROM le JOIN ri ON le.slot = ri.slot AND le.id <> ri.id) SELECT count(*) AS comparisons, count_if(q >= 0.8) AS near, coalesce(avg((q >= 0.8)::INT), 0) AS rate FROM eq""")
def near_dup_sampled_rate(s, d):
    return D.sampled_rate(D.signatures(table(s, d, "documents"), "doc_id", F.col("text"), 64), 15000, 100, 5)


# --- Logs, control, tokens ----------------------------------------------------------------------------------------------


def _log(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("run"), "event_id", (F.coalesce("value", F.lit(0.0)) / 1000.0).alias("kl"))


@query("""WITH RECURSIVE l AS (SELECT user_id AS run, event_id, coalesce(value, 0) / 1000.0 AS kl, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), z AS (SELECT run, event_id, i, least(greatest(0.05 * exp(0.05 * greatest(-1.0, least(1.0, kl / 0.05 - 1))), 1e-4), 2.0) AS beta FROM l WHERE i = 1 UNION ALL SELECT l.run, l.event_id, l.i, least(greatest(z.beta * exp(0.05 * greatest(-1.0, least(1.0, l.kl / 0.05 - 1))), 1e-4), 2.0) FROM z JOIN l ON l.run = z.run AND l.i = z.i + 1) SELECT run, event_id, round(beta, 6) AS beta FROM z""")
def kl_controller(s, d):
    return S.controller_trace(_log(s, d), "run", "event_id", "kl", 0.05, 0.05).withColumn("beta", F.round("beta", 6))


@query("""WITH l AS (SELECT user_id AS run, event_id, (coalesce(value, 0) / 1000.0 > 0.05)::INT AS v FROM events), g AS (SELECT *, sum(1 - v) OVER (PARTITION BY run ORDER BY event_id) AS g FROM l), k AS (SELECT run, event_id, sum(v) OVER (PARTITION BY run, g ORDER BY event_id)::BIGINT AS streak FROM g), f AS (SELECT run, min(event_id) AS f FROM k WHERE streak >= 3 GROUP BY run) SELECT k.run, event_id, streak, coalesce(event_id = f.f, false) AS stops FROM k LEFT JOIN f ON k.run = f.run""")
def kl_safety_stop(s, d):
    return S.violations(_log(s, d), "run", "event_id", "kl", 0.05, 3).select("run", "event_id", "streak", "stops")


@query("""WITH l AS (SELECT user_id AS run, event_id, coalesce(value, 0) / 1000.0 AS kl, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT run, count(*) AS steps, round(avg(CASE WHEN i <= 10 THEN kl END), 6) AS kl_first, round(avg(CASE WHEN i > n - 10 THEN kl END), 6) AS kl_last FROM l GROUP BY run""")
def first_last_window(s, d):
    return S.first_last_means(_log(s, d), "run", "event_id", ["kl"], 10).select("run", "steps", r6("kl_first").alias("kl_first"), r6("kl_last").alias("kl_last"))


@query("""WITH o AS (SELECT event_type AS name, round(avg(value), 6) AS value FROM events WHERE event_type < 'p' GROUP BY 1), n AS (SELECT event_type AS name, round(max(value), 6) AS value FROM events WHERE event_type > 'c' GROUP BY 1) SELECT coalesce(o.name, n.name) AS name, coalesce(n.value, o.value) AS value FROM o FULL JOIN n ON o.name = n.name""")
def summary_upsert(s, d):
    e = table(s, d, "events")
    o = e.where("event_type < 'p'").groupBy(F.col("event_type").alias("name")).agg(r6(F.avg("value")).alias("value"))
    n = e.where("event_type > 'c'").groupBy(F.col("event_type").alias("name")).agg(r6(F.max("value")).alias("value"))
    return R.upsert(o, n, "name", "value")


@query("""SELECT event_id, round(1e-4 * (0.1 + 0.45 * (1 + cos(pi() * event_id / 1000000))), 12) AS rate, round(exp(d) - d - 1, 6) AS kl, round(least(exp(d) * 0.5, least(greatest(exp(d), 0.8), 1.2) * 0.5), 6) AS objective, abs(exp(d) - 1) > 0.2 AS clipped, round(CASE WHEN 0.1 * d >= 0 THEN ln(1 + exp(-0.1 * d)) ELSE -0.1 * d + ln(1 + exp(0.1 * d)) END, 6) AS loss FROM (SELECT event_id, coalesce(value, 0) / 1000.0 - 0.05 AS d FROM events)""")
def policy_terms(s, d):
    e = table(s, d, "events").select("event_id", (F.coalesce("value", F.lit(0.0)) / 1000.0 - 0.05).alias("d"))
    z = F.lit(0.0)
    return e.select("event_id", F.round(N.cosine_rate(F.col("event_id"), F.lit(1_000_000), 1e-4), 12).alias("rate"), r6(N.kl_estimate(F.col("d"), z)).alias("kl"), r6(N.clipped_objective(F.col("d"), z, F.lit(0.5))).alias("objective"), N.is_clipped(F.col("d"), z).alias("clipped"), r6(N.preference_loss(F.col("d"), z, z, z)).alias("loss"))


@query("""WITH x AS (SELECT user_id, event_id, exp(coalesce(value, 0) / 50.0) AS e FROM events), p AS (SELECT user_id, event_id, e / sum(e) OVER (PARTITION BY user_id) AS p FROM x), c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, event_id) AS k, coalesce(sum(p) OVER (PARTITION BY user_id ORDER BY p DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT user_id, event_id FROM c WHERE k <= 5 AND before <= 0.9""")
def top_k_nucleus(s, d):
    w = W.partitionBy("user_id")
    x = table(s, d, "events").select("user_id", "event_id", F.exp(F.coalesce("value", F.lit(0.0)) / 50.0).alias("e")).withColumn("p", F.col("e") / F.sum("e").over(w))
    o = w.orderBy(F.desc("p"), "event_id")
    x = x.withColumns({"k": F.row_number().over(o), "before": F.coalesce(F.sum("p").over(o.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))})
    return x.where("k <= 5 AND before <= 0.9").select("user_id", "event_id")


@query("""WITH t AS (SELECT doc_id, CASE WHEN text = '' THEN [0] ELSE list_transform(string_split(text, ''), lambda c: unicode(c)) END AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, list_transform(t, lambda x, i: CASE WHEN i <= coalesce(nullif(list_position(t, 46), 0), i) THEN 1 ELSE 0 END) AS mask, list_transform(t, lambda x, i: CASE WHEN i <= 3 THEN -100 ELSE x END) AS labels, len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 32 AND (i = 1 OR t[i - 1] <> 32)))::INT AS runs FROM t""")
def token_masks(s, d):
    t = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.transform(F.split("text", ""), lambda c: F.ascii(c)).alias("t"))
    return t.select("doc_id", C.mask_after_end(F.col("t"), 46).alias("mask"), C.prefix_masked(F.col("t"), F.lit(3)).alias("labels"), F.size(C.marker_runs(F.col("t"), 32)).alias("runs"))


@query(None)
def answer_labels(s, d):
    t = _turns(s, d).select("row_id", F.transform(F.split(C.render_chat(F.col("t")), ""), lambda c: F.ascii(c)).alias("t"))
    return t.select("row_id", C.answer_labels(F.col("t"), [110, 116, 10], [60, 124], 512).alias("labels"))


@query(f"""WITH {_captions_sql()}, a AS (SELECT id, list_distinct(tok) AS a, tok FROM cap WHERE ref = -1), n AS (SELECT id, a, coalesce(lead(a) OVER (ORDER BY id), first_value(a) OVER (ORDER BY id)) AS b FROM a) SELECT count(*) AS n, round(avg((list_sort(a) <> list_sort(b))::INT), 6) AS change_rate, round(avg(1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))), 6) AS mean_distance FROM n""")
def dependency_report(s, d):
    c = _captions(s, d).select("id", F.array_distinct("pred").alias("a"))
    n = R.next_cyclic(c, "id", "a", "b")
    return n.agg(F.count("*").alias("n"), r6(F.avg((F.sort_array("a") != F.sort_array("b")).cast("double"))).alias("change_rate"), r6(F.avg(M.jaccard_distance(F.col("a"), F.col("b")))).alias("mean_distance"))


# --- Builders -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {VOTES_SQL}, c AS (SELECT question_id, answer, count(*) AS n, min(pos) AS p FROM v GROUP BY ALL), r AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY n DESC, p, answer) = 1), q AS (SELECT question_id, image_id, question FROM vqa_questions QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY coalesce(ingested_at, TIMESTAMPTZ '9999-01-01 00:00:00+00'), question) = 1),
a AS (SELECT 'vqa' AS task, q.question_id AS id, image_id, '<image>' || chr(10) || question || ' Answer briefly.' AS u FROM q JOIN r USING (question_id) WHERE question IS NOT NULL AND image_id IS NOT NULL), b AS (SELECT 'caption' AS task, caption_id AS id, image_id, '<image>' || chr(10) || 'Describe the image.' AS u FROM captions WHERE image_id IS NOT NULL AND trim(caption) <> '' QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY md5(concat_ws(':', '42', caption_id::VARCHAR)), caption_id) = 1)
SELECT task, id, image_id FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY task, image_id, u ORDER BY id) = 1""")
def multitask_mix(s, d):
    q = R.first_per_key(table(s, d, "vqa_questions"), ["question_id"], [F.coalesce("ingested_at", F.lit("9999-01-01").cast("timestamp")), F.col("question")])
    parts = [B.question_answer_rows(q, _votes(s, d), 0, 42, " Answer briefly."), B.caption_rows(table(s, d, "captions"), 0, 42, "Describe the image.")]
    return B.multitask(parts, 42).select("task", "id", "image_id")


@query(f"""WITH {SCENES_SQL}, many AS (SELECT l_orderkey FROM have GROUP BY 1 HAVING count(*) >= 3), pool AS (SELECT DISTINCT p_brand AS brand FROM part), ab AS (SELECT m.l_orderkey, p.brand FROM many m, pool p WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.l_orderkey = m.l_orderkey AND h.brand = p.brand)), ng AS (SELECT * FROM ab QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY md5(concat_ws(':', '1', l_orderkey::VARCHAR, brand)), brand) <= 3)
SELECT l_orderkey, brand, label, 'Is there a ' || brand || ' in the image?' AS question FROM (SELECT h.*, 'yes' AS label FROM have h SEMI JOIN many USING (l_orderkey) UNION ALL SELECT *, 'no' FROM ng)""")
def existence_questions(s, d):
    sc = _many(_scenes(s, d))
    pool = table(s, d, "part").select(F.col("p_brand").alias("brand")).distinct()
    return B.existence_questions(sc, R.negatives(sc, "l_orderkey", "brand", 3, 1, pool), "l_orderkey", "brand")


@query("""WITH d AS (SELECT pair_id AS id, CASE WHEN starts_with(lower(trim(chosen)), 'yes') THEN 'yes' WHEN starts_with(lower(trim(chosen)), 'no') THEN 'no' END AS chosen FROM preference_pairs) SELECT id, chosen, CASE WHEN chosen = 'yes' THEN 'no' ELSE 'yes' END AS rejected FROM d WHERE chosen IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chosen ORDER BY md5(concat_ws(':', '42', id::VARCHAR)), id) <= 20""")
def existence_preference_pairs(s, d):
    return B.opposite_pairs(table(s, d, "preference_pairs"), "pair_id", "chosen", 20, 42)


@query(f"""WITH {TURNS_SQL.replace('"content":"VARCHAR"', '"content":"VARCHAR","tools":"JSON","functions":"JSON"')}, x AS (SELECT row_id, turns, list_position(list_transform(turns, lambda x: x.role), 'assistant') AS i FROM t), v AS (SELECT row_id, turns[1:i - 1] AS before, turns[i].content AS ref, turns FROM x WHERE i >= 2)
SELECT v.row_id, task FROM v JOIN sft_i2t USING (row_id) WHERE octet_length(image_bytes) > 0 AND len(list_filter(before, lambda x: contains(x.content, '<image>'))) > 0 AND len(list_filter(turns, lambda x: coalesce(x.tools::VARCHAR NOT IN ('""', '', 'null', '[]'), false) OR coalesce(x.functions::VARCHAR NOT IN ('""', '', 'null', '[]'), false))) = 0
AND length(trim(ref, E' \\t\\r\\n')) BETWEEN 8 AND 384 ORDER BY md5(concat_ws(':', '42', v.row_id::VARCHAR)), v.row_id LIMIT 100""")
def reward_subset(s, d):
    return B.reward_subset(table(s, d, "sft_i2t"), 100, 42).select("row_id", "task")


@query("SELECT pair_id, ((row_number() OVER (ORDER BY md5(concat_ws(':', '5', pair_id::VARCHAR)), pair_id) - 1) // 32)::BIGINT AS batch FROM preference_pairs QUALIFY batch >= 2")
def resumed_batches(s, d):
    return B.batches(table(s, d, "preference_pairs").select("pair_id"), 32, 2, 5, "pair_id")


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for k, (_, q) in Q.items() if q}
