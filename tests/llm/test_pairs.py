import json

import pytest
from pyspark.sql import functions as F

from weftline.llm import pairs as P


@pytest.mark.parametrize("text", [None, "", " \n", "...", "？", "N/A", "(no answer)", "<missing>", "null", "（空）", "​"])
def test_empty(text):
    assert P.is_empty(text)


@pytest.mark.parametrize("text", ["no", "7", "A", "无人在场", "none of them", "¡sí!"])
def test_not_empty(text):
    assert not P.is_empty(text)


@pytest.mark.parametrize("text", [
    "I'm sorry, but I can't help with this picture.", "No description of this material can be given by me.", "As a language assistant I have no way of looking at pictures.", "That is outside what I'm permitted to talk about.", "Viewing images is beyond what I can do. Is there something else I can do?",
    "Lo siento, pero mis normas no me permiten contestar a eso.", "Ese tema no lo trato.", "Navré, je dois refuser cette demande.", "Ce sujet, je ne le traite pas.", "Es tut mir leid, aber ich möchte diesen Inhalt lieber nicht kommentieren.", "Fotos zu beschreiben geht über meine Fähigkeiten hinaus.", "对不起，我没有办法查看图片。", "按照规定我不能回答这个问题。",
])
def test_refusals(text):
    assert P.is_refusal(text)


@pytest.mark.parametrize("text", ["I cannot see any people in the picture, only a dog.", "The sign says 'Sorry, we are closed', and a dog waits.", "The worker is unable to reach a shelf.", "Je ne peux voir aucune personne sur la photo.", "牌子上写着“抱歉，本店休息”。", "Ich kann auf dem Foto keine Person sehen.", "I think it is a dog."])
def test_no_refusals(text):
    assert not P.is_refusal(text)


@pytest.mark.parametrize("answer, question, want", [
    ("what color is the dog", "<image>\nWhat color is the dog?", True), ("You asked: what color is the dog?", "What color is the dog?", True), ("What color is the dog? What color is the dog?", "What color is the dog?", True), ("color is the dog?", "What color is the dog?", True),
    ("What color is the dog? Brown", "What color is the dog?", False), ("The dog is brown", "What color is the dog?", False), ("图片里有狗吗", "图片里有狗吗？", True), ("dog", "Is it a dog?", False), ("", "x", False),
])
def test_copies(answer, question, want):
    assert P.is_copy(answer, question) is want


def test_tiling_takes_the_longest_runs():
    assert P.tiles("a b c x a b".split(), "a b c".split()) == [(0, 0, 3), (4, 0, 2)]


@pytest.mark.parametrize("text, want", [
    ("one (two", True), ("one (two)", False), ("say “hello", True), ("it's fine", False), ("```code", True), ("```code```", False), ("the dogs' tails", False), ("He said 'no way", True), ("a list\n- ", True), ("<b>bold", True), ("<b>bold</b>", False), ("one, two,", True), ("a face :(", False), ("[1] (2) {3}", False),
])
def test_pushdown(text, want):
    assert P.left_open(text) is want


def test_defects(spark):
    base = [f"The {a} stands near the {b}. A {b} was placed on the {a} this morning." for a in ("dog", "cat", "bus", "sofa", "lamp") for b in ("wall", "tree", "pond", "door")]
    talks = [(i, json.dumps([{"role": "user", "content": "Describe the picture please."}, {"role": "assistant", "content": t}]), "en") for i, t in enumerate(base)]
    deu = [f"Der {a} steht neben der {b} und wartet auf den Abend." for a in ("Hund", "Bus", "Baum") for b in ("Mauer", "Tür", "Lampe")]
    talks += [(100 + i, json.dumps([{"role": "user", "content": "Beschreibe bitte das ganze Bild."}, {"role": "assistant", "content": t}]), "de") for i, t in enumerate(deu)]
    talks += [(500, json.dumps([{"role": "user", "content": "Describe the picture please."}, {"role": "assistant"}]), None), (501, None, None), (502, "x", None), (503, "[]", None), (504, "[1]", None)]
    q = "Describe the picture please."
    pairs = [(1, q, "The dog stands near the", "The dog stands near the wall"), (2, q, None, "Der Hund steht neben der Mauer und wartet auf den Abend."), (3, q, q, "I can't help with this picture."), (4, q + " Please reply in German.", "Der Hund steht neben der Mauer und wartet auf den Abend.", "A tree was placed on the (dog"), (5, None, "A dog.", ""), (1, q, "dup", "dup")]
    p = spark.createDataFrame([(*x, b"z") for x in pairs], "pair_id long, prompt string, chosen string, rejected string, src binary")
    s = spark.createDataFrame(talks, "row_id long, conversations string, lang string")
    got = {tuple(r) for r in P.defects(p, s).collect()}
    assert got == {
        ("preference_pairs", 1, "chosen", "truncated"), ("preference_pairs", 2, "chosen", "empty"), ("preference_pairs", 2, "rejected", "other_language"), ("preference_pairs", 3, "chosen", "copied"), ("preference_pairs", 3, "rejected", "refusal"),
        ("preference_pairs", 4, "rejected", "truncated"), ("preference_pairs", 5, "rejected", "empty"), ("sft_i2t", 500, "turn_1", "empty"),
    }
    assert P.defects(p.where("false"), s.where("false")).count() == 0


@pytest.mark.parametrize("text, want", [
    ("Thank you for the picture. It is a nice one. I'm sorry, but I cannot help with that.", True), ("Gracias. Es una foto. No puedo ayudar con eso.", True),
    ("A dog sleeps near the wall. A cat sits on it. A bus waits. The sky is grey. The lamp is lit. I cannot see the number.", False), ("A dog. " * 400 + "I cannot help.", False),
])
def test_refusals_anywhere(text, want):
    assert P.is_refusal(text) is want


@pytest.mark.parametrize("times, parts", [(1, 2), (1, 64), (50, 7)])
def test_defects_do_not_depend_on_size_or_partitions(spark, times, parts):
    base = [f"The {a} stands near the {b}. A {b} was placed on the {a} this morning." for a in ("dog", "cat", "bus", "sofa", "lamp") for b in ("wall", "tree", "pond", "door")]
    talks = [(i, json.dumps([{"role": "user", "content": "Describe the picture please."}, {"role": "assistant", "content": t}]), "en") for i, t in enumerate(base)]
    q = "Describe the picture please."
    pairs = [(1, q, "The dog stands near the", "N/A"), (2, q, "A door was placed on the bus this morning", q), (3, q, "I'm sorry, but I cannot help with that.", "- - -"), (4, q, "The lamp stands near the wall.", "The cat stands near the tree. A tree wa")]
    copy = F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("k")
    p = spark.createDataFrame(pairs, "pair_id long, prompt string, chosen string, rejected string").select("*", copy).withColumn("pair_id", F.expr("pair_id + 1000 * k")).repartition(parts)
    t = spark.createDataFrame(talks, "row_id long, conversations string, lang string").select("*", copy).withColumn("row_id", F.expr("row_id + 1000 * k")).repartition(parts)
    got = {(r["rec_id"] % 1000, r["field"], r["defect"]) for r in P.defects(p, t).collect() if r["src"] == "preference_pairs"}
    assert got == {(1, "chosen", "truncated"), (1, "rejected", "empty"), (2, "rejected", "copied"), (3, "chosen", "refusal"), (3, "rejected", "empty"), (4, "rejected", "truncated")}
