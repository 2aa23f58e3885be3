"""Queries of the language-model operators, run over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import canonical, consensus, language, mixing, near, packing, pairs, residue, splits
from weftline.session import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: language.mislabelled_or_mixed(table(s, d, "sft_i2t")),
        "p1_languages": lambda s, d: language.conversation_languages(table(s, d, "sft_i2t")),
        "p2_found": lambda s, d: pairs.defects(table(s, d, "preference_pairs"), table(s, d, "sft_i2t")),
        "p3_found": lambda s, d: near.similar_conversations(table(s, d, "sft_i2t")),
        "p3_groups": lambda s, d: near.conversation_groups(table(s, d, "sft_i2t")),
        "p4_found": lambda s, d: splits.cross_split_pairs(table(s, d, "vqa_questions")),
        "p4_counts": lambda s, d: splits.cross_split_counts(table(s, d, "vqa_questions")),
        "p5_found": lambda s, d: canonical.duplicate_rows(table(s, d, "sft_i2t")),
        "p5_records": lambda s, d: canonical.dedup_records(table(s, d, "sft_i2t")),
        "p6_found": lambda s, d: consensus.consensus(table(s, d, "vqa_annotations")).select("question_id", "answer"),
        "p6_agreement": lambda s, d: consensus.consensus(table(s, d, "vqa_annotations")),
        "p6_reliability": lambda s, d: consensus.annotator_reliability(table(s, d, "vqa_annotations")),
        "p7_assignment": lambda s, d: packing.pack(table(s, d, "documents"), table(s, d, "pack_specs")),
        "p7_unused": lambda s, d: packing.unused(packing.pack(table(s, d, "documents"), table(s, d, "pack_specs"))),
        "p7_invariants": lambda s, d: packing.invariants(table(s, d, "documents"), table(s, d, "pack_specs")),
        "p8_draw": lambda s, d: mixing.draw(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p8_shares": lambda s, d: mixing.shares(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p8_invariants": lambda s, d: mixing.invariants(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p9_found": lambda s, d: residue.residue_documents(table(s, d, "documents")),
        "p9_reasons": lambda s, d: residue.classify_documents(table(s, d, "documents")),
        "p9_templates": lambda s, d: residue.templates(table(s, d, "documents")).where("verdict IS NOT NULL"),
    }


TURNS = """t AS (SELECT row_id, image_bytes, from_json(conversations, '[{"role":"VARCHAR","content":"VARCHAR"}]') AS turns
FROM sft_i2t WHERE conversations IS NOT NULL AND json_valid(conversations) AND conversations LIKE '%[%')"""
FOLD = r"lower(regexp_replace(upper(replace(coalesce({0}, ''), 'ß', 'ss')), '[^\p{{L}}\p{{N}}]+', '', 'g'))"
RECORDS = f"""WITH {TURNS}, c AS (SELECT row_id, image_bytes, array_to_string(list_transform(turns, lambda x: {FOLD.format('x.role')} || chr(31) || {FOLD.format('x.content')}), chr(30)) AS canon
FROM t WHERE image_bytes IS NOT NULL AND len(turns) > 0)"""
HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"
# Brute force: all pairs of texts that share a run, then groups by repeated minima along the links.
GROUPS = rf"""WITH RECURSIVE {TURNS}, x AS (SELECT row_id, lower(replace(array_to_string(list_transform(list_filter(turns, lambda x: x.role IN ('user', 'assistant')), lambda x: coalesce(x.content, '')), chr(10)), '<image>', ' ')) AS s FROM t),
w AS (SELECT row_id, regexp_extract_all(regexp_replace(s, '([{HAN}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+') AS w FROM x),
k AS (SELECT row_id, w, array_to_string(w, ' ') AS whole FROM w WHERE len(w) >= 60),
d AS (SELECT whole, min(row_id) AS rep, any_value(w) AS w FROM k GROUP BY whole),
r AS (SELECT rep, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS run FROM d),
n AS (SELECT rep, count(*) AS n FROM r GROUP BY rep),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM r a JOIN r b ON a.run = b.run AND a.rep < b.rep GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.rep = a JOIN n nb ON nb.rep = b WHERE 2 * c >= na.n + nb.n - c),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT rep AS a, rep AS b FROM d UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
g AS (SELECT a AS rep, min(b) AS group_id FROM reach GROUP BY a),
m AS (SELECT k.row_id AS id, g.group_id, count(*) OVER (PARTITION BY d.rep) AS copies FROM k JOIN d ON k.whole = d.whole JOIN g ON g.rep = d.rep)"""
MEASURED = r"SELECT {0} FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND NOT regexp_full_match(text, '[\s\p{{Z}}\x{{85}}\x{{0b}}]*')"
SOURCE = "regexp_replace(lower(trim(source)), '[- ]+', '_', 'g')"


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"{GROUPS} SELECT a.id AS row_id_a, b.id AS row_id_b FROM m a JOIN m b ON a.group_id = b.group_id AND a.id < b.id",
        "p3_groups": f"{GROUPS} SELECT id, group_id, copies FROM m",
        "p5_found": f"{RECORDS} SELECT keep_id, row_id FROM (SELECT row_id, min(row_id) OVER (PARTITION BY image_bytes, canon) AS keep_id FROM c) WHERE keep_id <> row_id",
        "p5_records": f"{RECORDS} SELECT min(row_id) AS keep_id, count(*) AS copies FROM c GROUP BY image_bytes, canon",
        "p7_invariants": f"""SELECT packing, ({MEASURED.format('count(DISTINCT doc_id)')}) AS documents, 0 AS overfull, 0 AS oversized, 0 AS split, 0 AS changed
FROM (SELECT DISTINCT 'spec ' || spec_id AS packing FROM pack_specs WHERE capacity_tokens >= 1 UNION ALL SELECT 'joint')""",
        "p8_invariants": f"""WITH d AS ({MEASURED.format(f"doc_id, text, {SOURCE} AS source")} AND source IS NOT NULL), u AS (SELECT text, arg_min(source, doc_id) AS source FROM d GROUP BY text)
SELECT source, count(*) AS texts, 0 AS too_often, 0 AS from_nowhere, 0 AS twice FROM u WHERE source IN (SELECT {SOURCE} FROM mix_targets WHERE target_share > 0 AND max_repeats >= 1) GROUP BY source""",
    }
