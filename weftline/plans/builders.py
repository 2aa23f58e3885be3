"""Dataset builders composed of the operators, and the experiment configuration. Images join last, so that no plan shuffles them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import conversations as C
from weftline.operators import evaluation as E
from weftline.operators import relational as R


def question_answer_rows(questions: DataFrame, votes: DataFrame, n: int, seed: int, suffix: str = "") -> DataFrame:
    """(id, image_id, task, conversations): n drawn questions with their most frequent answer."""
    top = R.ranked_answers(votes, "question_id", "answer", "pos").where("rank = 1").select("question_id", "answer")
    rows = questions.where("question IS NOT NULL AND image_id IS NOT NULL").join(top, "question_id")
    picked = R.sample_rows(rows, n, seed, "question_id") if n else rows
    return picked.select(F.col("question_id").alias("id"), "image_id", F.lit("vqa").alias("task"), C.two_turns(F.col("question"), F.col("answer"), suffix).alias("conversations"))


def caption_rows(captions: DataFrame, n: int, seed: int, prompt: str) -> DataFrame:
    """(id, image_id, task, conversations): n drawn images, each with one of its captions drawn."""
    c = captions.where("image_id IS NOT NULL AND trim(caption) <> ''")
    one = R.first_per_key(c.withColumn("_k", R.draw_key(seed, "caption_id")), ["image_id"], [F.col("_k"), F.col("caption_id")]).drop("_k")
    picked = R.sample_rows(one, n, seed, "image_id") if n else one
    return picked.select(F.col("caption_id").alias("id"), "image_id", F.lit("caption").alias("task"), C.two_turns(F.lit(prompt), F.trim("caption")).alias("conversations"))


def multitask(parts: list[DataFrame], seed: int) -> DataFrame:
    """Union of task rows, the first of equal (task, image, question) kept, in drawn order."""
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    keyed = rows.withColumn("_q", F.md5(C.first_content(C.turns(F.col("conversations")), "user")))
    kept = R.first_per_key(keyed, ["task", "image_id", "_q"], [F.col("id")]).drop("_q")
    return kept.orderBy(R.draw_key(seed, "task", "id"), "task", "id")


def choice_rows(choices: DataFrame, n: int, seed: int) -> DataFrame:
    """(id, image_id, task, conversations): n drawn questions of (index, question, options, answer) with their options."""
    picked = R.sample_rows(choices, n, seed, "index") if n else choices
    return picked.select(F.col("index").alias("id"), F.col("index").alias("image_id"), F.lit("mcq").alias("task"), C.two_turns(E.choice_prompt(F.col("question"), F.col("options")), F.col("answer")).alias("conversations"))


def knowledge_rows(questions: DataFrame, votes: DataFrame, n: int, seed: int, suffix: str = "") -> tuple[DataFrame, DataFrame]:
    """(conversations, pairs) of n drawn questions: the most frequent answer, and it against the runner-up, `unknown` if there is none."""
    r = R.ranked_answers(votes, "question_id", "answer", "pos").where("rank <= 2")
    top = r.groupBy("question_id").agg(F.max(F.when(F.col("rank") == 1, F.col("answer"))).alias("chosen"), F.max(F.when(F.col("rank") == 2, F.col("answer"))).alias("rejected"))
    rows = questions.select("question_id", "image_id", "question").join(top, "question_id")
    rows = R.sample_rows(rows, n, seed, "question_id") if n else rows
    prompt = F.concat("question", F.lit(suffix))
    talks = rows.select(F.col("question_id").alias("id"), "image_id", C.two_turns(F.col("question"), F.col("chosen"), suffix).alias("conversations"))
    return talks, rows.select(F.col("question_id").alias("id"), "image_id", prompt.alias("prompt"), "chosen", F.coalesce("rejected", F.lit("unknown")).alias("rejected"))


def spatial_questions(boxes: DataFrame, pool: DataFrame, absent: int, seed: int) -> DataFrame:
    """(image_id, question, answer) of images with at least two boxes (image_id, category, position): where the only one of its
    category is, how many there are of each, and whether there is one of `absent` drawn categories that are not there."""
    per = boxes.groupBy("image_id", "category").agg(F.count("*").alias("n"), F.min("position").alias("position"))
    big = per.groupBy("image_id").agg(F.sum("n").alias("_all")).where("_all >= 2").select("image_id")
    per = per.join(big, "image_id", "left_semi")
    name = F.col("category")
    where = per.where("n = 1").select("image_id", F.concat(F.lit("Where is the "), name, F.lit(" in the image? Answer with a single word: left, right, top, bottom or center.")).alias("question"), F.col("position").alias("answer"))
    many = per.select("image_id", F.concat(F.lit("How many "), name, F.lit("s are in the image? Answer with an integer only.")).alias("question"), F.col("n").cast("string").alias("answer"))
    none = R.negatives(per, "image_id", "category", absent, seed, pool).select("image_id", F.concat(F.lit("Is there a "), name, F.lit(" in the image? Answer yes or no.")).alias("question"), F.lit("no").alias("answer"))
    return where.unionByName(many).unionByName(none)


def ratio_sweep(a: DataFrame, b: DataFrame, variants: dict[str, tuple[int, int]], seed: int, *ids: str) -> DataFrame:
    """(variant, ...): for each variant so many drawn rows of either table; the draws of a table are prefixes of each other."""
    parts = [R.union_all([R.sample_rows(a, n, seed, *ids), R.sample_rows(b, m, seed, *ids)]).select(F.lit(name).alias("variant"), "*") for name, (n, m) in variants.items()]
    return R.union_all(parts)


def capped_rows(files: dict[str, DataFrame], cap: int, *order: str) -> DataFrame:
    """(file, ...): the first `cap` rows of each file in the given order (0: all)."""
    parts = [(d.orderBy(*order).limit(cap) if cap else d).select(F.lit(name).alias("file"), "*") for name, d in files.items()]
    return R.union_all(parts)


def existence_questions(present: DataFrame, absent: DataFrame, group: str, item: str) -> DataFrame:
    """(group, item, label, question): yes for present items, no for absent ones."""
    ask = F.concat(F.lit("Is there a "), F.col(item), F.lit(" in the image?"))
    yes = present.select(group, item).distinct().withColumn("label", F.lit("yes"))
    return yes.unionByName(absent.select(group, item).withColumn("label", F.lit("no"))).withColumn("question", ask)


def opposite_pairs(rows: DataFrame, id_col: str, answer: str, n_per_class: int, seed: int) -> DataFrame:
    """(id, chosen, rejected): the answer against its opposite, as many of yes as of no at most; unparsable ones are skipped."""
    d = rows.select(F.col(id_col).alias("id"), T.yes_no_prefix(F.col(answer)).alias("chosen")).where("chosen IS NOT NULL")
    d = R.balanced_sample(d, "chosen", n_per_class, seed, "id") if n_per_class else d
    return d.withColumn("rejected", F.when(F.col("chosen") == "yes", "no").otherwise("yes"))


def balanced_preferences(existence: DataFrame, answers: DataFrame, n: int, seed: int) -> DataFrame:
    """Existence pairs and as many answer pairs of quality, in drawn order; both have (id, chosen, rejected)."""
    good = answers.where(~F.lower(F.trim("chosen")).isin("yes", "no") & (T.word_count(F.col("chosen")) >= 2) & (T.word_count(F.col("rejected")) >= 1))
    return R.mix([(existence, n), (good, n)], seed, "id")


def reward_subset(sft: DataFrame, n: int, seed: int, least: int = 8, most: int = 384) -> DataFrame:
    """n drawn rows usable for reward training: the filter and the draw see ids only, payloads join afterwards."""
    t = C.turns(F.col("conversations"))
    ids = R.sample_rows(sft.where(F.col("image_bytes").isNotNull() & (F.octet_length("image_bytes") > 0)).where(C.valid_for_reward(t, least, most)).select("row_id"), n, seed, "row_id")
    return sft.join(F.broadcast(ids) if n <= 100_000 else ids, "row_id", "left_semi")


def batches(df: DataFrame, size: int, skip: int, seed: int, *ids: str) -> DataFrame:
    """Adds `batch` in the drawn order of an epoch, leaving out the first `skip` batches (a resumed run)."""
    ranked = R.global_rank(df.withColumn("_k", R.draw_key(seed, *ids)), "_rank", "_k", *ids)
    return ranked.withColumn("batch", F.floor(F.col("_rank") / size)).where(F.col("batch") >= skip).drop("_k", "_rank")


# The conditions of an evaluation, and the settings of an experiment with the names of their variables.
CONDITIONS = ("correct", "black", "shuffled")
VARIABLES = {
    "pretrain.epochs": "PRETRAIN_EPOCHS", "pretrain.batch_size": "PRETRAIN_BATCH_SIZE", "pretrain.learning_rate": "PRETRAIN_LR",
    "sft.epochs": "SFT_EPOCHS", "sft.batch_size": "SFT_BATCH_SIZE", "sft.learning_rate": "SFT_LR",
    "grpo.samples": "GRPO_SAMPLES", "grpo.group_size": "GRPO_GROUP_SIZE", "grpo.ppo_epochs": "GRPO_PPO_EPOCHS", "grpo.learning_rate": "GRPO_LR",
    "grpo.beta": "GRPO_BETA", "grpo.adaptive_beta": "GRPO_ADAPTIVE_BETA", "grpo.target_kl": "GRPO_TARGET_KL", "grpo.kl_stop": "GRPO_KL_STOP", "evaluation.samples": "EVAL_SAMPLES",
}


@dataclass
class Experiment:
    """A validated experiment configuration: every setting of VARIABLES by section and name, the conditions and the seed."""

    settings: dict[str, object]
    conditions: list[str]
    seed: int = 42

    @classmethod
    def of(cls, config: dict) -> Experiment:
        sections = {name.split(".")[0] for name in VARIABLES}
        lost = sorted(s for s in sections if not isinstance(config.get(s), dict))
        if lost:
            raise ValueError(f"missing configuration sections: {', '.join(lost)}")
        flat = {f"{s}.{k}": v for s in sections for k, v in config[s].items()}
        lost = [name for name in VARIABLES if name not in flat]
        if lost:
            raise ValueError(f"missing configuration values: {', '.join(lost)}")
        for name in ("grpo.target_kl", "evaluation.samples"):
            if not flat[name] > 0:
                raise ValueError(f"{name} must be positive")
        conditions = list(flat.get("evaluation.conditions") or ())
        if not conditions or set(conditions) - set(CONDITIONS):
            raise ValueError(f"evaluation.conditions must name some of {', '.join(CONDITIONS)}")
        return cls({name: flat[name] for name in VARIABLES}, conditions, config.get("seed", 42))

    def environment(self, base: dict[str, str] | None = None) -> dict[str, str]:
        """`base` and the settings as strings: flags as 1 and 0, conditions joined by blanks."""
        text = {name: str(int(v) if isinstance(v, bool) else v) for name, v in self.settings.items()}
        return {**(base or {}), **{VARIABLES[n]: t for n, t in text.items()}, "PIPELINE_SEED": str(self.seed), "EVAL_CONDITIONS": " ".join(self.conditions)}
