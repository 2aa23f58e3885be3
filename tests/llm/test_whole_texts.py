"""Whole texts: no kind of text or part of a text is left out."""

import json

import pytest

from weftline.llm import pairs as P
from weftline.llm import residue


@pytest.mark.parametrize("text, want", [
    ("Run this:\n```\nx = 1.", True), ("A tree (near the wall.", True), ("A sign says “Stop. No way.", True), ("看图（左边是树。", True), ("It shows [1] (a tree.", True),
    ("A tree (near the wall).", False), ("'Tis a dog.", False), ('A 5" pipe.', False), ('Da steht „Halt".', False), ("Da steht »Halt«.", False), ("In [0, 1).", False), ("a) one b) two.", False), ("The “(” key is red.", False), ("The label reads\n883.", False),
])
def test_open_in_spite_of_a_final_stop(text, want):
    assert (P.broken_off(text, P.Endings()) == ("truncated", None)) is want


def test_short_tails_of_longer_answers(spark):
    base = [f"The {a} stands near the {b}. A {b} was placed on the {a} this morning." for a in ("dog", "cat", "bus", "sofa", "lamp") for b in ("wall", "tree", "pond", "door")]
    q = "Describe the picture please."
    talks = [(i, json.dumps([{"role": "user", "content": q}, {"role": "assistant", "content": t}]), "en") for i, t in enumerate(base)]
    pairs = [(1, q, "The dog stands near the wall. A tree was", "The dog stands near the wall. The"), (2, q, "The dog stands near the wall. A door", "a door"), (3, "What is it?", "What is it? The dog", "The dog")]
    p = spark.createDataFrame([(*x, b"z") for x in pairs], "pair_id long, prompt string, chosen string, rejected string, src binary")
    got = {tuple(r) for r in P.defects(p, spark.createDataFrame(talks, "row_id long, conversations string, lang string")).collect()}
    assert {x[1:] for x in got} >= {(1, "chosen", "truncated"), (1, "rejected", "truncated")}
    assert not [x for x in got if x[1:3] in ((2, "rejected"), (3, "rejected"), (3, "chosen"))]


@pytest.mark.parametrize("text, want", [
    (" " * 61, True), ("\n\u3000\xa0" * 5000, True), ("-" * 80, True), ("- " * 200, True), ("_" * 70, True), ("." * 100, True), ("…！？" * 30, True), ("=" * 40 + " N/A " + "=" * 40, True), ("\n" * 60 + "没有答案。", True),
    ("-" * 80 + " a dog", False), ("_" * 70 + "7", False), (" " * 5000 + "是", False), ("no answer " * 10, False), ("The dog stands near the wall. " * 2000, False),
])
def test_empty_at_any_length(text, want):
    assert P.is_empty(text) is want
    if want:
        assert P.by_itself(text, "What is it?") == "empty"


FILLER = "lorem ipsum dolor sit amet placeholder text lorem ipsum sample caption dolor sit amet dummy paragraph ipsum lorem filler copy test title"
NOUNS, PLACES = "dog cat bus lamp sofa kite drum goat boat bench tree door vase harp".split(), "wall pond road gate hill barn lake yard shop park".split()
SAID = [f"the {a} stands near the {b} and" for b in PLACES for a in NOUNS]


def test_overlong_messages_are_read_whole(spark):
    filler = [" ".join([FILLER, word] * 6) for word in ("lorem", "ipsum", "asdf", "qwer")]
    behind = " ".join(SAID[:18]) + " " + " ".join(filler)
    before = filler[0] + " " + " ".join(SAID)
    for t in (behind, before, "字" * 500, "a " * 121, "short one"):
        assert "".join("".join(residue.messages(t)).split()) == "".join(t.split())
        assert all(len(residue.masked(m)) <= 120 for m in residue.messages(t))
    got = {r[0] for r in residue.residue_documents(spark.createDataFrame([(1, behind), (2, before), (3, " ".join(SAID))], "doc_id long, text string")).collect()}
    assert got == {1}
