"""Turns of conversations: extraction, splits, prompts, validity, label spans. Array expressions inside the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import normalise_c  # noqa: F401  (part of the surface)
from weftline.schemas import TURNS


def turns(conversations: Column) -> Column:
    """Parsed turns; NULL where the text is no array of turns."""
    return F.from_json(conversations, TURNS)


def first_content(t: Column, role: str, default: str | None = "") -> Column:
    c = F.get(F.filter(t, lambda x: x["role"] == role), F.lit(0))["content"]
    return F.coalesce(c, F.lit(default)) if default is not None else c


def lifted_functions(t: Column) -> Column:
    """The functions that the first turn offers as tools, if it is a system turn that has any; else NULL."""
    first = F.get(t, F.lit(0))
    return F.when(first["role"] == "system", first["functions"])


def as_list(image: Column, is_array: bool) -> Column:
    """One image or several as an array; NULL stays NULL."""
    return image if is_array else F.when(image.isNotNull(), F.array(image))


def first_image(image: Column, is_array: bool) -> Column:
    return F.get(image, F.lit(0)) if is_array else image


def index_of_role(t: Column, role: str, last: bool = False) -> Column:
    """Position of the first or last turn of a role, from 0; -1 if there is none."""
    roles = F.transform(t, lambda x: x["role"])
    if not last:
        return F.coalesce(F.array_position(roles, role).cast("int") - 1, F.lit(-1))
    p = F.array_position(F.reverse(roles), role).cast("int")
    return F.coalesce(F.when(p > 0, F.size(t) - p).otherwise(F.lit(-1)), F.lit(-1))


def prompt_and_reference(t: Column) -> tuple[Column, Column]:
    """Turns before the first assistant turn, and its content."""
    i = index_of_role(t, "assistant")
    return F.when(i >= 0, F.slice(t, 1, F.greatest(i, F.lit(0)))), F.when(i >= 0, F.get(t, i)["content"])


def history_and_last(t: Column) -> tuple[Column, Column]:
    """Turns before the last assistant turn, and its content; NULL if no turn precedes it."""
    i = index_of_role(t, "assistant", last=True)
    return F.when(i >= 1, F.slice(t, 1, F.greatest(i, F.lit(0)))), F.when(i >= 1, F.get(t, i)["content"])


def strip_image(text: Column) -> Column:
    return F.trim(F.replace(text, F.lit("<image>"), F.lit("")), F.lit(" \t\r\n"))


def expand_image(t: Column, marker: str, k: int) -> Column:
    """`<image>` becomes k markers in all turns but those of the system."""
    return F.transform(t, lambda x: x.withField("content", F.when(x["role"] != "system", F.replace(x["content"], F.lit("<image>"), F.lit(marker * k))).otherwise(x["content"])))


def two_turns(question: Column, answer: Column, suffix: str = "") -> Column:
    """JSON of a question about an image and its answer."""
    user = F.struct(F.lit("user").alias("role"), F.concat(F.lit("<image>\n"), question, F.lit(suffix)).alias("content"))
    return F.to_json(F.array(user, F.struct(F.lit("assistant").alias("role"), answer.alias("content"))))


def with_system_prompt(t: Column, u: Column, prompts: list[str], share: float = 0.2) -> Column:
    """Prepends one of `prompts` where the uniform u is below `share`, unless a system turn leads or tools are used."""
    pick = F.element_at(F.array(*[F.lit(p) for p in prompts]), (F.floor(u / share * len(prompts)) + 1).cast("int"))
    lead = F.struct(F.lit("system").alias("role"), pick.alias("content"), F.lit(None).cast("string").alias("tools"), F.lit(None).cast("string").alias("functions"))
    free = ~F.coalesce(F.get(t, F.lit(0))["role"] == "system", F.lit(False)) & ~F.exists(t, lambda x: x["tools"].isNotNull() & ~x["tools"].isin("", "null", "[]"))
    return F.when(free & (F.size(t) > 0) & (u < share), F.concat(F.array(lead), t)).otherwise(t)


def without_empty_thought(text: Column, u: Column, keep: float = 0.2) -> Column:
    return F.when(u > keep, F.replace(text, F.lit("<think>\n\n</think>\n\n"), F.lit(""))).otherwise(text)


def uniform(seed: int, *ids: Column) -> Column:
    """A number in [0, 1) from a hash of seed and ids."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids])), 1, 8), 16, 10).cast("double") / 4294967296.0


def valid_for_reward(t: Column, least: int = 8, most: int = 384) -> Column:
    """Rows usable for reward training: an answer of fitting length after a question that shows the image, no tools."""
    i = index_of_role(t, "assistant")
    prompt, reference = prompt_and_reference(t)
    shown = F.exists(prompt, lambda x: F.coalesce(F.contains(x["content"], F.lit("<image>")), F.lit(False)))
    tools = F.exists(t, lambda x: F.coalesce(~x["tools"].isin("", "null", "[]"), F.lit(False)) | F.coalesce(~x["functions"].isin("", "null", "[]"), F.lit(False)))
    size = F.char_length(F.trim(reference, F.lit(" \t\r\n")))
    return F.coalesce((F.size(t) > 0) & ~tools & (i >= 1) & shown & size.between(least, most), F.lit(False))


def render_chat(t: Column) -> Column:
    """Turns between role markers."""
    return F.array_join(F.transform(t, lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), F.coalesce(x["content"], F.lit("")), F.lit("<|im_end|>\n"))), "")


# --- Token sequences -------------------------------------------------------------------------------------------------


def label_spans(tokens: list[int], start: list[int], end: list[int], most: int) -> list[int]:
    """-100 except from behind each start pattern through the next end pattern, for the first `most` positions."""
    out = [-100] * len(tokens)
    at, n = 0, len(tokens)

    def find(pattern: list[int], since: int) -> int:
        return next((i for i in range(since, n - len(pattern) + 1) if tokens[i : i + len(pattern)] == pattern), -1)

    while (s := find(start, at)) >= 0:
        begin = s + len(start)
        e = find(end, begin)
        stop = n if e < 0 else e + len(end)
        for i in range(begin, min(stop, most)):
            out[i] = tokens[i]
        at = stop
    return out


def answer_labels(tokens: Column, start: list[int], end: list[int], most: int) -> Column:
    """Labels of a token array, in Arrow batches; NULL stays NULL."""

    @F.pandas_udf("array<int>")
    def labels(column: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else label_spans(list(t), start, end, most) for t in column])

    return labels(tokens)


def prefix_masked(tokens: Column, k: Column) -> Column:
    return F.transform(tokens, lambda x, i: F.when(i < k, F.lit(-100)).otherwise(x))


def mask_after_end(tokens: Column, end: int) -> Column:
    """1 up to and including the first end token, 0 behind it."""
    at = F.array_position(tokens, end)
    return F.transform(tokens, lambda x, i: F.when((at == 0) | (i < at), F.lit(1)).otherwise(F.lit(0)))


def marker_runs(tokens: Column, marker: int) -> Column:
    """(start, length) of each run of the marker, from 0."""
    n = F.size(tokens)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (F.get(tokens, i) == marker) & ((i == 0) | (F.get(tokens, i - 1) != marker)))
    ends = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (F.get(tokens, i) == marker) & ((i == n - 1) | (F.get(tokens, i + 1) != marker)))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("length")))


def padded(tokens: Column, size: int, pad: int = 0) -> Column:
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(pad), size)), 1, size)


def repetition_penalty(scores: DataFrame, seen: DataFrame, penalty: float) -> DataFrame:
    """Scores (seq, token, score): those of seen tokens (seq, token) move away from being chosen again."""
    s = seen.select("seq", "token").distinct().withColumn("_s", F.lit(True))
    return scores.join(s, ["seq", "token"], "left").withColumn("score", F.when(F.col("_s"), F.when(F.col("score") > 0, F.col("score") / penalty).otherwise(F.col("score") * penalty)).otherwise(F.col("score"))).drop("_s")
