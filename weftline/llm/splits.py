"""Same or nearly the same questions across splits (problem 4): an edit-distance segment join.

Questions are reduced to plain text (case, marks, determiners and phrases that ask nothing removed). Per image and side,
equal plain texts collapse to one representative with its members. Each evaluation text of length l is cut into k+1
segments, k being the edits allowed for its length; a training text within k edits must hold one of the segments unchanged
at one of a few positions, so an equi-join on (image, l, segment number, segment) finds every pair within k edits. Pairs
are verified by banded dynamic programming and then word by word: words may differ only by slips of spelling, never by
another word or another number. A word is a slip of a nearby word if it is no more frequent, by the counts of all words, than
slips of that word are (SLIPS of its uses, with an allowance for chance); so a word of its own is never taken for its
neighbour unless it is that rare beside it. The counts are joined to the words that differ; no vocabulary is sent around.

A segment that more than BLOCK evaluation texts share, such as a common beginning on a popular image, is cut into blocks.

Cases: NULL images, NULL, blank and mark-only questions make no pair; a question id delivered again counts once (by the
earliest delivery); a question id found in two splits is never paired with itself. Empty tables give empty results.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import cut, skew_join

#: Share of the uses of a word that are one and the same slip at most; evaluation texts of a segment that meet in a task at most;
#: rows of a table that is broadcast at most.
SLIPS, BLOCK, SMALL = 1 / 150, 4096, 200_000

# Phrases that leave a question unchanged, and words spelled in two ways.
FILLERS_EN = (
    "can you tell me", "could you tell me", "please tell me", "tell me", "do you know", "i wonder", "please", "kindly", "so", "well", "okay", "ok", "hey", "hi", "q", "question",
    "looking at the photo", "looking at the picture", "looking at the image", "look at the photo", "look at the picture", "look at the image",
    "in the photo", "in the picture", "in the image", "in this photo", "in this picture", "in this image", "in the scene", "in this scene", "shown here", "here",
    "give a short answer", "answer in one word or a short phrase", "answer in one word", "answer briefly", "answer shortly", "reply briefly", "one word only", "in one word", "exactly", "actually", "thanks", "thank you",
)
FILLERS_ZH = ("请用一个词回答", "请用一个词或短语回答", "请简短回答", "请简单回答", "请告诉我", "告诉我", "请问", "图中", "图片中", "图片里", "照片中", "照片里", "这张图里", "那么", "呢", "这个", "那个", "这", "那")
DETERMINERS = ("the", "a", "an", "this", "that", "these", "those")
SPELLINGS = {"colour": "color", "colours": "colors", "grey": "gray", "centre": "center", "theatre": "theater", "aeroplane": "airplane", "tyre": "tire", "甚么": "什么"}


def plain(question: Column) -> Column:
    """Plain text of a question: lower-case words joined by single blanks, each Chinese character a word."""
    t = F.lower(F.regexp_replace(F.coalesce(question, F.lit("")), r"(?i)<image>", " "))
    t = F.regexp_replace(t, r"[’‘`´]", "'")
    t = F.regexp_replace(t, r"(?<=\p{L})'s\b", " is")
    t = F.regexp_replace(t, r"(?<=\p{L})'(?=\p{L})", "")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")
    for a, b in SPELLINGS.items():
        t = F.regexp_replace(t, rf"\b{a}\b" if a.isascii() else a, b)
    t = F.regexp_replace(t, "|".join(sorted(FILLERS_ZH, key=len, reverse=True)), " ")
    words = "|".join(sorted((*FILLERS_EN, *DETERMINERS), key=len, reverse=True)).replace(" ", r" (?:the |this |that )?")
    # Twice, as removing a determiner can bring a phrase together.
    for _ in range(2):
        t = F.regexp_replace(t, rf"(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])", " ")
    t = F.regexp_replace(t, r"([\x{4e00}-\x{9fff}])", " $1 ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


#: Edits allowed for an evaluation text of length `l`; a swap of neighbours counts two.
EDITS = "(CASE WHEN {l} >= 20 THEN 4 WHEN {l} >= 12 THEN 3 WHEN {l} >= 8 THEN 2 WHEN {l} >= 4 THEN 1 ELSE 0 END)"


def latest_questions(questions: DataFrame) -> DataFrame:
    """One row per question id, with its plain text and side; rows that can make no case are dropped."""
    q = questions.where(F.col("image_id").isNotNull() & F.col("question").isNotNull() & F.col("split").isNotNull())
    q = q.groupBy("question_id").agg(F.min(F.struct(F.coalesce("ingested_at", F.lit("9999-12-31").cast("timestamp")), "image_id", "split", "source", "question")).alias("r"))
    q = q.select("question_id", "r.image_id", "r.split", "r.source", plain(F.col("r.question")).alias("s"))
    return q.where("s <> ''").withColumn("is_eval", F.lower("split").isin("val", "test"))


def _segments(l: str, text: str, at: str) -> str:
    """SQL: the k+1 segments of an evaluation text as (number, text)."""
    k = EDITS.format(l=l)
    return f"transform(sequence(0, {k}), i -> struct(i AS i, substring({text}, CAST(floor(i * {l} / ({k} + 1)) AS INT) + 1, CAST(floor((i + 1) * {l} / ({k} + 1)) AS INT) - CAST(floor(i * {l} / ({k} + 1)) AS INT)) AS seg)){at}"


def _keys_eval(reps: DataFrame) -> DataFrame:
    return reps.select("rep", "image_id", "s", "l", F.explode(F.expr(_segments("l", "s", ""))).alias("g")).select(
        "image_id", F.col("rep").alias("rep_e"), F.col("s").alias("s_e"), F.xxhash64("image_id", "l", "g.i", "g.seg").alias("key"))


def _keys_train(reps: DataFrame, lengths: DataFrame) -> DataFrame:
    """Substrings of training texts at the positions where a segment of an evaluation text may stand unchanged."""
    k = EDITS.format(l="el")
    start = f"CAST(floor(i * el / ({k} + 1)) AS INT)"
    size = f"(CAST(floor((i + 1) * el / ({k} + 1)) AS INT) - {start})"
    low = f"greatest(0, {start} - i, {start} + l - el - ({k} - i))"
    high = f"least(l - {size}, {start} + i, {start} + l - el + ({k} - i))"
    subs = f"flatten(transform(sequence(0, {k}), i -> CASE WHEN {low} <= {high} THEN transform(sequence({low}, {high}), p -> struct(i AS i, substring(s, p + 1, {size}) AS seg)) ELSE array() END))"
    # The lengths of an image are one row, an array; an image with a third of all questions meets it without a shuffle.
    per_image = lengths.groupBy("image_id").agg(F.collect_set("el").alias("els")).join(reps.groupBy("image_id").agg(F.count("*").alias("n")), "image_id")
    near = skew_join(reps, per_image, "image_id", "n").withColumn("el", F.explode(F.filter("els", lambda e: F.abs(F.col("l") - e) <= F.expr(EDITS.format(l="l")) + 1))).where(F.expr(f"abs(l - el) <= {k}"))
    return near.select("image_id", "rep", "s", "el", F.explode(F.array_distinct(F.expr(subs))).alias("g")).select(
        "image_id", F.col("rep").alias("rep_t"), F.col("s").alias("s_t"), F.xxhash64("image_id", "el", "g.i", "g.seg").alias("key"))


def _segment_join(ev: DataFrame, tr: DataFrame) -> DataFrame:
    """Rows of both sides of equal key; keys of more than BLOCK evaluation texts block by block."""
    hot = cut(ev.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    few = hot.count()
    if not few:
        return ev.hint("merge").join(tr, "key")
    hot = F.broadcast(hot) if few <= SMALL else hot.hint("merge")
    block = F.pmod(F.xxhash64("rep_e"), F.coalesce("blocks", F.lit(1))).cast("int")
    ev = ev.join(hot, "key", "left").withColumn("block", block).drop("blocks")
    tr = tr.join(hot, "key", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    return ev.hint("merge").join(tr, ["key", "block"])


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, in a band of width `most`; most+1 when it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    before, last = [], [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [i if i <= most else far] + [far] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            row[j] = min(d, far)
        before, last = last, row
    return last[-1]


def is_slip(word: str, n: int, other: str, m: int) -> bool:
    """Is `word`, used n times, a slip of `other`, used m times?"""
    if min(len(word), len(other)) < 3 or not (word.isascii() and other.isascii()) or word.isdigit() or other.isdigit():
        return False
    often = SLIPS * m
    most = 2 if len(word) >= 8 else 1
    return n <= often + 3 * math.sqrt(often) + 1 and n < m and osa(word, other, most) <= most


def one_slip(word: str) -> set[str]:
    """Words that `word` may be a single slip of: a swap, a letter more, less or other."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    letters = string.ascii_lowercase
    out = {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1} | {a + b[1:] for a, b in cuts if b}
    out |= {a + x + b for a, b in cuts for x in letters} | {a + x + b[1:] for a, b in cuts if b for x in letters}
    return {x for x in out if len(x) > 2} - {word}


def _bases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(w, x) for w in b.column(0).to_pylist() if w.isascii() and w.isalpha() and len(w) > 2 for x in one_slip(w)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["w", "base"])


def _same_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of words of which one is a slip of the other, or both of a third."""
    for b in batches:
        ok = [is_slip(x, n, y, m) or is_slip(y, m, x, n) or (bx or x) == (by or y) for x, y, n, m, bx, by in zip(*(c.to_pylist() for c in b.columns))]
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def same_words(differ: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) of `differ` that are one word but for slips, by the counts of all words of `reps`."""
    counts = cut(reps.select(F.explode(F.split("s", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n")))
    pairs = cut(differ.select("a", "b").distinct())
    words = cut(pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct().join(counts, "w", "left").select("w", F.coalesce("n", F.lit(0)).alias("n")))
    bases = words.select("w").mapInArrow(_bases, "w string, base string").join(counts.select(F.col("w").alias("base"), F.col("n").alias("m")), "base").join(words, "w")
    often = SLIPS * F.col("m")
    bases = bases.where((F.col("n") <= often + 3 * F.sqrt(often) + 1) & (F.col("n") < F.col("m")))
    base = bases.groupBy("w").agg(F.max(F.struct("m", "base")).alias("t")).select("w", "t.base")
    known = cut(words.join(base, "w", "left"))
    for side in ("a", "b"):
        pairs = pairs.join(known.select(F.col("w").alias(side), F.col("n").alias(f"n_{side}"), F.col("base").alias(f"base_{side}")), side)
    return pairs.select("a", "b", "n_a", "n_b", "base_a", "base_b").mapInArrow(_same_words, "a string, b string")


def _rep_pairs(q: DataFrame) -> DataFrame:
    """(rep_e, rep_t): pairs of representatives that ask the same."""
    reps = cut(q.groupBy("image_id", "is_eval", "s").agg(F.min("question_id").alias("rep")).withColumn("l", F.length("s")))
    ev, tr = reps.where("is_eval"), reps.where("NOT is_eval")
    lengths = ev.select("image_id", F.col("l").alias("el")).distinct()
    pairs = _segment_join(_keys_eval(ev), _keys_train(tr, lengths).withColumnRenamed("image_id", "image_t")).where("image_id = image_t")
    pairs = pairs.select("rep_e", "rep_t", "s_e", "s_t").distinct()
    k = EDITS.format(l="length(s_e)")
    pairs = pairs.where(F.expr(f"CASE {' '.join(f'WHEN {k} = {n} THEN levenshtein(s_e, s_t, {n})' for n in range(5))} END >= 0"))
    pairs = cut(pairs)
    same = (F.col("s_e") == F.col("s_t")) | (F.replace("s_e", F.lit(" "), F.lit("")) == F.replace("s_t", F.lit(" "), F.lit("")))
    sure = pairs.where(same).select("rep_e", "rep_t")
    words = pairs.where(~same).select("rep_e", "rep_t", F.split("s_e", " ").alias("x"), F.split("s_t", " ").alias("y")).where("size(x) = size(y)")
    differ = words.select("rep_e", "rep_t", F.explode(F.filter(F.zip_with("x", "y", lambda x, y: F.struct(x.alias("a"), y.alias("b"))), lambda z: z["a"] != z["b"])).alias("z")).select("rep_e", "rep_t", "z.a", "z.b")
    good = cut(same_words(differ, reps)).withColumn("good", F.lit(1))
    slips = differ.join(good, ["a", "b"], "left").groupBy("rep_e", "rep_t").agg(F.count("*").alias("n"), F.count("good").alias("k")).where("n = k").select("rep_e", "rep_t")
    return sure.unionByName(slips)


def _members(q: DataFrame, side: str) -> DataFrame:
    reps = q.groupBy("image_id", "is_eval", "s").agg(F.min("question_id").alias(f"rep_{side}"))
    return q.where("is_eval" if side == "e" else "NOT is_eval").join(reps, ["image_id", "is_eval", "s"]).select(f"rep_{side}", F.col("question_id").alias(f"q_{side}"), F.col("split").alias(f"split_{side}"), F.col("source").alias(f"source_{side}"))


def cross_split_pairs(questions: DataFrame) -> DataFrame:
    """(question_id_a, question_id_b), the smaller id first: every question of an evaluation split that also stands in train."""
    q = cut(latest_questions(questions))
    out = _rep_pairs(q).join(_members(q, "e"), "rep_e").join(_members(q, "t"), "rep_t").where("q_e <> q_t")
    return out.select(F.least("q_e", "q_t").alias("question_id_a"), F.greatest("q_e", "q_t").alias("question_id_b")).distinct()


def cross_split_counts(questions: DataFrame) -> DataFrame:
    """Per split and source of the evaluation question: questions, those that also stand in train, and their share."""
    q = cut(latest_questions(questions))
    hit = _rep_pairs(q).select("rep_e").distinct().withColumn("hit", F.lit(1))
    e = _members(q, "e").join(hit, "rep_e", "left")
    return e.groupBy(F.col("split_e").alias("split"), F.col("source_e").alias("source")).agg(
        F.count("*").alias("questions"), F.count("hit").alias("overlapping")).withColumn("share", F.col("overlapping") / F.col("questions"))
