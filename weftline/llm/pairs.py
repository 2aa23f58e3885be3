"""Broken prompt and response pairs (problem 2).

Every answer gets at most one defect, the first that holds of:

* `empty`: NULL, only blanks or marks, or a stand-in for a missing value.
* `refusal`: a small grammar per language of first-person sentences that decline, name a rule against answering, or state
  an inability to answer or to look at pictures. Quotations are removed first, so a sign that says sorry is none; inability
  to see a certain thing is a report, not a refusal.
* `copied`: greedy string tiling of the answer with the question: apart from an announcement the tiles cover the whole
  answer and most of the question. What follows the last tile is an answer, so a restated question is no copy.
* `other_language`: a script check, else the centroid classifier of problem 1 on question and answer (only where a quick
  word vote does not already agree); not if the question asks for that language.
* `truncated`: a pushdown parser over fences, brackets, quotations, lists and markup finds what is left open at the end;
  (behind a final stop, in a fence, bracket or quotation);
  a text that closes everything but has no final stop is held against the counts, over all answers, of how often a sentence
  ends or goes on after the same words.

Cases: NULL questions count as blank (nothing is copied from them, nor in another language); an answer is judged against the turn
before it; NULL or unparsable conversations have no answers, an assistant turn whose content is NULL or absent is empty;
repeated rows are judged each; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import language as lid
from weftline.session import cut, spread

# Stand-ins for a missing value, without marks.
STAND_INS = {
    "na", "n a", "null", "none", "nan", "nil", "missing", "empty", "undefined", "tbd", "todo", "no answer", "no response", "not available", "blank", "no data",
    "keine antwort", "leer", "sin respuesta", "vacío", "pas de réponse", "aucune réponse", "vide", "空", "无", "无答案", "没有答案", "无回答", "没有回答", "暂无", "未回答", "缺失",
}
# Names of languages as questions ask for them.
LANGUAGE_NAMES = {
    "en": r"english|englisch|anglais|inglés|ingles|英语|英文",
    "zh": r"chinese|mandarin|chinesisch|chinois|chino|中文|汉语|华语",
    "es": r"spanish|spanisch|espagnol|español|espanol|castellano|西班牙语|西班牙文",
    "fr": r"french|französisch|français|francais|francés|frances|法语|法文",
    "de": r"german|deutsch|allemand|alemán|aleman|德语|德文",
}
# The refusal grammar, by language.
_EN_ACT = r"(?:help|assist|answer|respond|reply|comment|discuss|describe|talk|speak|view|look|process|analy[sz]e|identify|provide|share|give|offer|fulfil|comply|do (?:this|that)|continue|engage|open|access|pass|interpret|see (?:the |this |that |your |any |these )?(?:image|picture|photo))"
_EN_NO = r"(?:can ?not|can't|could not|couldn't|am not able to|'m not able to|am unable to|'m unable to|won't|will not|must not|may not|am not (?:allowed|permitted|authori[sz]ed) to|'m not (?:allowed|permitted|authori[sz]ed) to|would rather not|'d rather not|would prefer not to|'d prefer not to|prefer not to|do not want to|don't want to)"
REFUSALS = {
    "en": rf"\bi ?{_EN_NO} (?:\w+ ){{0,2}}?{_EN_ACT}|\bi (?:must|have to|need to|will have to|am going to|'m going to|shall) (?:\w+ )?(?:decline|refuse|pass)|\bi (?:decline|refuse) (?:to|this|that)|\bi (?:have no|do not have|don't have|lack) (?:the |any )?(?:way|means|ability|access|capability|permission)|(?:beyond|outside|not within) (?:of )?what i(?:'m| am)? (?:can|am able|able|allowed|permitted)|(?:beyond|outside) my (?:abilities|capabilities|scope|remit)|\bmy (?:guidelines|rules|policies|policy|instructions|programming) (?:do not|don't|does not|doesn't|forbid|prohibit|prevent|won't)|something i (?:won't|will not|can ?not|can't)|(?:is not|isn't|not) possible for me|can(?:not)? be (?:given|provided|answered|described) by me|\bas an? (?:\w+ )?(?:language model|ai|assistant|language assistant|chatbot),? i (?:have no|can|do|am|must|will)|\bi (?:do not|don't) (?:discuss|comment|answer|describe|handle)",
    "es": r"\bno (?:te |le |les )?puedo (?:\w+ )?(?:ayudar|responder|contestar|comentar|hablar|describir|atender|procesar|analizar|proporcionar|ver (?:imágenes|fotos|fotografías|la (?:imagen|foto))|mirar)|\b(?:debo|tengo que) (?:rechazar|declinar|negarme)|\b(?:mis|las) (?:normas|reglas|directrices|políticas|instrucciones) (?:no me (?:permiten|dejan)|me (?:prohíben|impiden))|\bno tengo (?:manera|forma|modo|posibilidad|capacidad|acceso|permiso)|\bprefiero no (?:comentar|hablar|responder|contestar|describir|opinar)|\bese tema no lo|fuera de mi (?:alcance|capacidad)|más allá de mis|\bno me (?:es posible|está permitido)|\b(?:rechazo|declino) (?:esta|esa|la) |\bcomo (?:modelo de lenguaje|asistente)[^.]{0,20} no (?:puedo|tengo)|\bno (?:voy a|quiero) (?:responder|contestar|comentar|describir)|\bsoy incapaz",
    "fr": r"\bje ne (?:peux|puis|saurais) (?:pas |)?(?:\w+ )?(?:aider|répondre|commenter|parler|décrire|traiter|analyser|fournir|regarder|voir (?:d'images|les images|l'image|la photo|de photos))|\bje (?:dois|suis obligé de) (?:refuser|décliner)|\b(?:mes|les) (?:règles|directives|consignes) (?:m'interdisent|ne me permettent|m'empêchent)|\bje n'ai (?:aucun moyen|pas (?:le moyen|la possibilité|accès|le droit))|\bje préfère ne pas|\bje ne le traite pas|\bdépasse mes (?:capacités|compétences)|\bil m'est impossible|\bil ne m'est pas (?:possible|permis)|\bje refuse de|\bje ne suis pas (?:capable|en mesure|autorisé)|\ben tant qu(?:e modèle|'assistant)[^.]{0,20} je ne|\bje ne (?:veux|souhaite) pas (?:répondre|commenter|décrire)",
    "de": r"\bich kann (?:\w+ ){0,5}?nicht (?:\w+ )?(?:helfen|antworten|beantworten|beschreiben|kommentieren|weiterhelfen|ansehen|verarbeiten|bearbeiten|sprechen)|\bich kann (?:keine|dieses|das|die) (?:bilder?|fotos?) (?:nicht )?(?:sehen|ansehen|betrachten)|\bich (?:muss|müsste) (?:\w+ ){0,3}?(?:ablehnen|passen|verweigern)|\bmeine (?:richtlinien|regeln|vorgaben) (?:erlauben|gestatten|verbieten|lassen)|\bich habe keine (?:möglichkeit|befugnis|erlaubnis)|\bich habe keinen zugriff|\bich möchte (?:\w+ ){0,4}?nicht (?:kommentieren|besprechen|beschreiben|beantworten)|\bsage ich nichts|über meine (?:fähigkeiten|möglichkeiten)|\b(?:ist|es ist) mir (?:leider )?nicht (?:möglich|erlaubt|gestattet)|\bich darf (?:\w+ ){0,4}?nicht|\bich lehne (?:\w+ ){0,3}?ab|\bich bin nicht in der lage|\bals sprach(?:modell|assistent)[^.]{0,20} ich (?:kann|habe)",
    "zh": r"我(?:们)?(?:没有办法|没办法|无法|不能|不可以|不便|不方便|没法|无权|不会|不愿意?|不想)(?:[^，。！？\n]{0,6}?)(?:查看|看图|看照片|回答|答复|评论|讨论|描述|帮助|帮忙|处理|提供|协助|谈论|回应)|我(?:必须|只能|得|需要)?(?:拒绝|谢绝|回避)|(?:超出|超过)了?我的(?:能力|范围)|(?:规定|准则|规则|政策)(?:不允许|禁止|不许)我|我的(?:准则|规则|规定)不|不在我(?:的)?(?:能力|职责)",
}
_REFUSAL = {k: re.compile(v) for k, v in REFUSALS.items()}
# Every refusal holds one of these; most answers hold none.
_CUES = {
    "en": (" i ", " i'", " my ", " me", "something i"),
    "es": ("puedo", "debo ", "tengo ", " mis ", "prefiero", " tema no", " mi ", " mí", "no me ", "rechaz", "declin", "no voy", "no quiero", "soy ", "las normas", "las reglas", "las directrices", "las políticas", "las instrucciones"),
    "fr": ("je ", "j'", " mes ", "m'", "les règles", "les directives", "les consignes"),
    "de": ("ich ", "meine ", " mir "),
    "zh": ("我", "规定", "准则", "规则", "政策"),
}
_ANNOUNCE = re.compile(
    r"^\W*(?:(?:you|he|she|they) (?:asked|are asking|ask|wrote|said)|(?:the |your |my )?(?:question|prompt|q|instruction)(?: is| was)?|frage|die frage(?: lautet| ist)?|sie fragen|du fragst|ihre frage|pregunta|la pregunta es|usted pregunta|preguntas|question posée|la question est|vous demandez|tu demandes|您问的是|你问的是|您的问题是|你的问题是|问题是|问题|问)\s*[:：,，]?\s*", re.I)
_TOKEN = re.compile(f"[{lid.CJK}]|[^\\W_{lid.CJK}]+")
_STAND_IN_WORDS = max(len(_TOKEN.findall(x)) for x in STAND_INS)
_STOPPED = re.compile(r"[.!?。！？][\"'”’»）)\]」』*_`\s]*$")
_ASKED = re.compile(r"[?？]\W*$")
#: Sentences that may stand beside a refusal.
MOST_BESIDE = 3
_FADED = re.compile(r"(?:\s*(?:\.{2,}|…+|[!?！？]{2,}|\s[.!?。]+))+\s*$")
_SENTENCES = re.compile(r"(?<=[.!?])[\"'”’»)\]]*\s+|(?<=[。！？])[\"'”’»）\]]*|\n{2,}")
_CAPS = re.compile(r"[A-ZÀ-ÞŒ]")
_DEAD_END = re.compile(r"[,;:，；：、/&+=]\s*$|\s[-–—]\s*$|(?:^|\n)\s*(?:[-*•]|\d+[.)])\s*$")

OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "「": "」", "『": "』", "“": "”", "«": "»", "„": "“"}
CLOSE = set(OPEN.values())
_MARKS = re.compile("[" + re.escape("".join({*OPEN, *CLOSE, '"', "”"})) + "]")


def left_open(text: str) -> bool:
    """Pushdown parse: does the text end inside a fence, bracket, quotation, tag or list item?"""
    if text.count("```") % 2:
        return True
    if not re.search(r"[(\[{（【「『“«„\"'<]", text):
        return bool(_DEAD_END.search(text))
    stack: list[str] = []
    tags: list[str] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c == "<" and (m := re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*)?(/?)>").match(text, i)):
            if m[1]:
                if m[2] in tags:
                    del tags[len(tags) - 1 - tags[::-1].index(m[2]) :]
            elif not m[3] and m[2].lower() not in ("br", "img", "image", "hr", "input", "p", "li"):
                tags.append(m[2])
            i = m.end()
            continue
        if c == "<" and re.compile(r"<[a-zA-Z][^<>\n]*$").match(text, i):
            return True
        if stack and c == stack[-1] and not (c == "'" and i + 1 < n and text[i + 1].isalnum()):
            stack.pop()
        elif c in OPEN:
            if not (c in "([" and i and text[i - 1] in ":;"):  # a face
                stack.append(OPEN[c])
        elif c in CLOSE and c in stack:
            del stack[len(stack) - 1 - stack[::-1].index(c) :]
        elif c == '"' and '"' not in stack:
            stack.append('"')
        elif c == "'" and "'" not in stack and (i == 0 or not text[i - 1].isalnum()) and i + 1 < n and text[i + 1].isalnum():
            stack.append("'")
        i += 1
    return bool(stack or tags) or bool(_DEAD_END.search(text))


def ends_inside(text: str) -> bool:
    """Does a text with a final stop end inside a fence, bracket or quotation? Any closing mark closes the nearest one open, as
    in [0, 1); straight quotation marks, tags and list numbers also stand alone and tell nothing here."""
    if text.count("```") % 2:
        return True
    reverse = -1 < text.find("»") < text.find("«")
    open_marks: list[str] = []
    for m in _MARKS.finditer(text):
        c, before, after = m[0], text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
        if c in OPEN and not (c == "“" and open_marks[-1:] == ["„"]):
            face, named = before in (":", ";") and c in "([", before in tuple("\"'“‘«") and after in tuple("\"'”’»")
            if not (face or named or reverse and c == "«"):
                open_marks.append(c)
        elif open_marks and (c != '"' or open_marks[-1] in "“„"):
            open_marks.pop()
    return bool(open_marks)


def words_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def tiles(answer: list[str], question: list[str], least: int = 2) -> list[tuple[int, int, int]]:
    """Greedy string tiling: maximal common runs (start in answer, start in question, length), longest first, none overlapping.

    A question may be used more than once, as a repeated copy repeats it.
    """
    where: dict[str, list[int]] = {}
    for j, w in enumerate(question):
        where.setdefault(w, []).append(j)
    taken = [False] * len(answer)
    out = []
    while True:
        best = (least - 1, 0, 0)
        i = 0
        while i < len(answer):
            if taken[i]:
                i += 1
                continue
            longest = 0
            for j in where.get(answer[i], ()):
                k = 0
                while i + k < len(answer) and j + k < len(question) and not taken[i + k] and answer[i + k] == question[j + k]:
                    k += 1
                longest = max(longest, k)
                if k > best[0]:
                    best = (k, i, j)
            i += max(1, longest)
        k, i, j = best
        if k < least:
            return sorted(out)
        out.append((i, j, k))
        taken[i : i + k] = [True] * k


def is_copy(answer: str, question: str) -> bool:
    """Nothing but the question, or most of it, in the answer."""
    inside = set(question.lower().split())
    if not re.search(f"[{lid.CJK}]", question) and not answer.isupper() and sum(map(inside.__contains__, answer.lower().split())) < 0.4 * answer.count(" "):
        return False
    q = words_of(question.replace("<image>", " "))
    a = words_of(_ANNOUNCE.sub("", answer, count=1))
    if len(q) < 2 or len(a) < max(3 if len(q) > 3 else 2, 0.5 * len(q)):
        return False
    if a == q:
        return True
    if sum(map(set(q).__contains__, a)) < 0.8 * len(a):
        return False
    t = tiles(a, q, min(3, len(q)))
    if not t:
        return False
    covered = sum(k for _, _, k in t)
    seen = len({j + x for _, j, k in t for x in range(k)})
    tail = len(a) - (t[-1][0] + t[-1][2])
    return covered >= 0.9 * len(a) and seen >= 0.5 * len(q) and tail == 0


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    if not _TOKEN.search(answer):
        return True
    # A stand-in has few words, whatever blanks and marks are around it.
    words = [m[0].lower() for m in islice(_TOKEN.finditer(answer), _STAND_IN_WORDS + 1)]
    if len(words) > _STAND_IN_WORDS:
        return False
    return " ".join(words) in STAND_INS or "".join(words) in STAND_INS and not words[0].isascii()


def is_refusal(answer: str) -> bool:
    low = " " + answer.lower().replace("’", "'").replace("‘", "'")
    cued = [_REFUSAL[k] for k, cues in _CUES.items() if any(c in low for c in cues)]
    if not cued:
        return False
    low = lid._QUOTES.sub(" ", low)
    cued = [p for p in cued if p.search(low)]
    if not cued:
        return False
    parts = [s for s in _SENTENCES.split(low) if s and words_of(s)]
    refusing = [any(p.search(s) for p in cued) for s in parts]
    if not any(refusing):
        return False
    # Wherever the refusal stands, little else is said; questions back to the asker are nothing else.
    return sum(not r and not s.rstrip().endswith(("?", "？")) for r, s in zip(refusing, parts)) <= MOST_BESIDE


def asked_language(question: str) -> set[str]:
    low = question.lower()
    return {k for k, v in LANGUAGE_NAMES.items() if re.search(v, low)}


class Speaker:
    """Languages of questions and answers: words that belong to one language vote, the centroids decide the doubtful ones."""

    def __init__(self, model: lid.Model | None, lexicon: dict[str, str]) -> None:
        self.model, self.lexicon = model, lexicon
        self.memo: dict[str, frozenset[str]] = {}
        self.known: dict[str, str | None] = {}
        self.votes: dict[str, str | None] = {}

    def vote(self, text: str) -> str | None:
        """The language of most of the words that belong to one, or None."""
        known = self.known
        if len(known) > 500_000:
            known.clear()
        words = text.lower().split()
        for w in set(words).difference(known):
            known[w] = self.lexicon.get(w) or self.lexicon.get(w.strip(".,;:!?¿¡\"'()")) or ("zh" if "㐀" <= w[0] <= "鿿" else None)
        n = Counter(map(known.__getitem__, words))
        n.pop(None, None)
        if "zh" in n:  # words without blanks between them
            n["zh"] *= 2
        if not n:
            return None
        best = max(n, key=n.__getitem__)
        return best if n[best] >= 2 and n[best] >= 0.75 * sum(n.values()) else None

    def learn(self, texts: list[str]) -> None:
        """Classifies texts together and remembers their languages."""
        if len(self.memo) > 50_000:
            self.memo.clear()
        parts = {t: lid.stretches(t) for t in dict.fromkeys(texts) if t not in self.memo}
        found = lid.classify([p for x in parts.values() for p in x], self.model) if self.model else {}
        for t, x in parts.items():
            self.memo[t] = frozenset(found[p][0] for p in x if found.get(p, (None, 0))[0] and found[p][1] >= lid.SURE and (lid.n_words(p) >= lid.SENTENCE_WORDS or len(x) == 1))

    def doubt(self, answer: str, question: str) -> str | None:
        """`other` if the script tells that the answer is in another language, `ask` if the centroids have to, else None."""
        if question not in self.votes:
            if len(self.votes) > 50_000:
                self.votes.clear()
            self.votes[question] = self.vote(question.replace("<image>", " "))
        # An answer most of whose words are of the question's language is not wholly in another.
        a = self.vote(answer)
        if a is not None and a == self.votes[question]:
            return None
        n = lid.n_words(answer)
        if n < lid.SENTENCE_WORDS:
            if n < 2 or not re.search(f"[{lid.CJK}]", answer) or re.search(r"[A-Za-zÀ-ÿ]{2}", answer):
                return None
            question = question.replace("<image>", " ")
            return "other" if not re.search(f"[{lid.CJK}]", question) and lid.n_words(question) >= 3 and "zh" not in asked_language(question) else None
        return "ask"

    def differ(self, answer: str, question: str) -> bool:
        """Is the answer wholly in a language that neither the question is in nor asks for? Both texts are learned."""
        langs, asked = self.memo[answer], self.memo[question]
        return bool(langs) and bool(asked) and not langs & (asked | asked_language(question))


def lexicon_of(samples: list[tuple[str, str]], least: int = 3, share: float = 0.9) -> dict[str, str]:
    """Words of the labelled sample that belong to one language."""
    n: dict[str, dict[str, int]] = {}
    for lang, text in samples:
        for w in set(_TOKEN.findall(text.lower())):
            if not w.isdigit():
                d = n.setdefault(w, {})
                d[lang] = d.get(lang, 0) + 1
    out = {}
    for w, d in n.items():
        best = max(d, key=lambda k: d[k])
        if d[best] >= least and d[best] >= share * sum(d.values()):
            out[w] = best
    return out


# --- How sentences end ------------------------------------------------------------------------------------------------

MIX = np.uint64(0x9E3779B97F4A7C15)
_TOKENS = re.compile(f"[{lid.CJK}]|\\d+|[^\\W\\d_{lid.CJK}]+|[,;:，；：、]|[.!?](?=[\\s\"'”’»)\\]]|$)|[。！？]")
STOP = 0
#: Stands for a context in which sentences end.
WHOLE = -1


def _hash(w: str) -> int:
    return int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") | 8


class Endings:
    """Counts, by context, of sentences that end or go on; filled text by text, drained as arrays.

    A word counts in lower case, but numbers count alike, and so do capitalised words inside a sentence (names). Its contexts are
    three: with the sentence's first three words and the word before, with the word before, alone.
    """

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.first_id: list[int] = []
        self.inner_id: list[int] = []
        self.buffer: list[int] = []
        self.keys, self.ends, self.ons = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.clear()

    def clear(self) -> None:
        self.index, self.first_id, self.inner_id = {".": STOP}, [0], [0]

    def number(self, w: str) -> int:
        if w in ".!?。！？":
            return STOP
        i = self.index[w] = len(self.first_id)
        low = _hash("#" if w[0].isdigit() else w.lower())
        self.first_id.append(low)
        self.inner_id.append(_hash("<N>") if _CAPS.match(w) else low)
        return i

    def numbers(self, text: str) -> list[int]:
        if text.isupper() or text.istitle():
            text = text.lower()
        known, new = self.index, self.number
        out = [known[w] if w in known else new(w) for w in _TOKENS.findall(text)]
        return out

    def add(self, text: str, stopped: bool) -> None:
        """Counts the sentences of a text; the last one only if it is finished."""
        n = self.numbers(text)
        if stopped:
            n.append(STOP)
        else:
            while n and n[-1] != STOP:
                n.pop()
        self.buffer += n
        if len(self.buffer) > 500_000:
            self.fold()

    @staticmethod
    def contexts(stop: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(3 x words) contexts of a run of hashed words with stops, and whether the sentence ends behind each word."""
        before = np.r_[True, stop[:-1]]
        word = ~stop
        # Number of the sentence each word belongs to, and the position in it.
        at = np.arange(len(ids))
        start = np.maximum.accumulate(np.where(before, at, 0))
        padded = np.r_[ids, np.zeros(3, np.uint64)]
        in_one = np.r_[np.cumsum(stop), np.full(3, -1)]
        first = np.zeros(len(ids), np.uint64)
        for k in range(3):
            same = in_one[start + k] == in_one[:-3]
            x = np.where(same & (padded[start + k] != 0), padded[start + k], np.uint64(0))
            first = (first ^ x) * MIX
            first ^= first >> np.uint64(33)
        prev = np.where(before, np.uint64(0), np.r_[np.uint64(0), ids[:-1]])
        b = (prev * MIX) ^ ids
        b ^= b >> np.uint64(31)
        a = (first * MIX) ^ b
        a = (a ^ (a >> np.uint64(29))) * MIX
        c = np.stack([a | np.uint64(1), (b * MIX) & ~np.uint64(3) | np.uint64(2), ids & ~np.uint64(3)])
        return c[:, word].view(np.int64), np.r_[stop[1:], False][word]

    def of_last(self, sentence: str, alone: bool = True) -> list[int] | None:
        """Contexts of the last word of an unfinished sentence; None if it has no words, or `alone` for a short answer, which
        stands by itself."""
        n = [x for x in self.numbers(sentence) if x != STOP]
        chinese = re.match(f"\\W*[{lid.CJK}]", sentence) is not None
        if not n or alone and len(n) < (6 if chinese else 4):
            return None
        ids = np.array([self.first_id[n[0]], *(self.inner_id[x] for x in n[1:]), 0], np.uint64)
        c = self.contexts(np.arange(len(ids)) == len(n), ids)[0][:, -1].tolist()
        if not chinese and not _CAPS.search(sentence) or sentence.isupper() or sentence.istitle():
            c[2] = WHOLE  # in such writing an unknown last word may be a name
        # Short phrases may begin like sentences that go on; in a long run without stops the beginning tells nothing.
        return c if 6 < len(n) <= (34 if chinese else 20) else [0, *c[1:]]

    def fold(self) -> None:
        if self.buffer:
            n = np.array(self.buffer)
            stop = n == STOP
            c, end = self.contexts(stop, np.where(np.r_[True, stop[:-1]], np.array(self.first_id, np.uint64)[n], np.array(self.inner_id, np.uint64)[n]))
            keys = np.concatenate([self.keys, *c])
            e = np.concatenate([self.ends, *[end.astype(np.int64)] * 3])
            o = np.concatenate([self.ons, *[(~end).astype(np.int64)] * 3])
            self.keys, at = np.unique(keys, return_inverse=True)
            self.ends, self.ons = np.bincount(at, e, len(self.keys)).astype(np.int64), np.bincount(at, o, len(self.keys)).astype(np.int64)
        self.buffer = []
        if len(self.index) > 500_000:
            self.clear()


# --- The operator -----------------------------------------------------------------------------------------------------

SCHEMA = "src string, rec_id long, field string, defect string, contexts array<long>, key long, ends long, ons long"
ARROW = pa.schema([("src", pa.string()), ("rec_id", pa.int64()), ("field", pa.string()), ("defect", pa.string()), ("contexts", pa.list_(pa.int64())), ("key", pa.int64()), ("ends", pa.int64()), ("ons", pa.int64())])
FLUSH = 1_500_000


def by_itself(answer: str | None, question: str) -> str | None:
    """Defects told by the two texts alone."""
    if is_empty(answer):
        return "empty"
    if is_refusal(answer):
        return "refusal"
    if is_copy(answer, question):
        return "copied"
    return None


def broken_off(answer: str, endings: Endings) -> tuple[str | None, list[int] | None]:
    """(defect, contexts): contexts if how sentences end elsewhere has to decide."""
    tail = _FADED.sub("", answer[-80:])
    faded = len(tail) != min(80, len(answer))
    bare = answer[:-80] + tail if faded else answer
    stopped = not faded and _STOPPED.search(answer[-40:]) is not None
    inside = ends_inside(bare) if stopped else left_open(bare)
    endings.add(answer, stopped and not inside)
    if inside:
        return "truncated", None
    if stopped:
        return None, None
    parts = [s for s in _SENTENCES.split(bare) if s and s.strip()]
    # An answer stands alone also behind a question that it restates.
    return None, endings.of_last(parts[-1], all(_ASKED.search(s) for s in parts[:-1])) if parts else None


def judge(pairs: list[tuple[str | None, str | None]], speaker: Speaker, endings: Endings) -> list[tuple[str | None, list[int] | None]]:
    """(defect, contexts) of each (answer, question)."""
    early = [by_itself(a, q or "") for a, q in pairs]
    doubtful = [None if e else speaker.doubt(a, q or "") for e, (a, q) in zip(early, pairs)]
    speaker.learn([t for d, (a, q) in zip(doubtful, pairs) if d == "ask" for t in (a, q or "")])
    out: list[tuple[str | None, list[int] | None]] = []
    for e, d, (a, q) in zip(early, doubtful, pairs):
        if e:
            out.append((e, None))
        elif d == "other" or d == "ask" and speaker.differ(a, q or ""):
            out.append(("other_language", None))
        else:
            out.append(broken_off(a, endings))
    return out


def _answers(src: str, row: tuple) -> Iterator[tuple[int, str, str | None, str | None]]:
    if src == "preference_pairs":
        i, prompt, chosen, rejected = row
        yield i, "chosen", chosen, prompt
        yield i, "rejected", rejected, prompt
        return
    i, conversations = row
    try:
        turns = json.loads(conversations) if conversations else []
    except ValueError:
        return
    before = None
    for no, t in enumerate(turns if isinstance(turns, list) else []):
        if not isinstance(t, dict):
            before = None
            continue
        content = t.get("content") if isinstance(t.get("content"), str) else None
        if str(t.get("role")).lower() == "assistant":
            yield i, f"turn_{no}", content, before
        before = content


def _scan(src: str, model: lid.Model | None, lexicon: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speaker, endings = Speaker(model, lexicon), Endings()

        def counts() -> pa.RecordBatch:
            endings.fold()
            n = len(endings.keys)
            out = pa.RecordBatch.from_arrays([pa.nulls(n, f.type) for f in list(ARROW)[:5]] + [pa.array(endings.keys), pa.array(endings.ends), pa.array(endings.ons)], schema=ARROW)
            endings.keys = endings.ends = endings.ons = np.zeros(0, np.int64)
            return out

        for b in batches:
            rows = [x for row in zip(*(c.to_pylist() for c in b.columns)) for x in _answers(src, row)]
            found: list[tuple] = []
            for at in range(0, len(rows), 4000):
                part = rows[at : at + 4000]
                for (i, field, _, _), (defect, contexts) in zip(part, judge([x[2:] for x in part], speaker, endings)):
                    if defect or contexts:
                        found.append((i, field, defect, contexts))
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([src] * n, pa.string()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string()), pa.array([f[3] for f in found], pa.list_(pa.int64())), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=ARROW)
            if len(endings.keys) > FLUSH:
                yield counts()
        yield counts()

    return run


#: A sentence is unfinished if at most this share of its context's sentences end there, the context having been seen so often; a
#: word counts as seen nowhere if it makes up at most this share of all words, as fragments and slips do in a large corpus.
MOST_ENDS, LEAST_SEEN, NOWHERE = 0.02, 8, 2e-7
#: Centroids per language; telling questions from answers in another language needs fewer than problem 1.
CLUSTERS = 16


def defects(pairs: DataFrame, sft: DataFrame, sample_rows: int = 2000) -> DataFrame:
    """(src, rec_id, field, defect): one row per defective answer of both tables."""
    rows = sft.select("row_id", "conversations", "lang")
    samples = lid.sample(rows, sample_rows)
    model, lexicon = lid.fit_texts(samples, CLUSTERS), lexicon_of(samples)
    a = spread(pairs.select("pair_id", "prompt", "chosen", "rejected").where("pair_id IS NOT NULL")).mapInArrow(_scan("preference_pairs", model, lexicon), SCHEMA)
    b = spread(rows.select("row_id", "conversations").where("row_id IS NOT NULL AND conversations IS NOT NULL")).mapInArrow(_scan("sft_i2t", model, lexicon), SCHEMA)
    scanned = cut(a.unionByName(b))
    doubtful = scanned.where("contexts IS NOT NULL").select("src", "rec_id", "field", F.posexplode("contexts").alias("level", "key"))
    counts = scanned.where("key IS NOT NULL").groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("ons").alias("ons"))
    total = counts.where(F.col("key").bitwiseAND(F.lit(3)) == 0).agg(F.sum(F.col("ends") + F.col("ons"))).first()[0] or 0
    # Few contexts are asked for again and again: their counts are attached to the distinct ones first. The two keys that stand
    # for no context, which a third of all rows may have, need no join.
    fixed = F.col("key").isin(WHOLE, STOP)
    asked = doubtful.where(~fixed).select("key").distinct().join(counts, "key", "left").select("key", F.coalesce("ends", F.lit(0)).alias("ends"), F.coalesce("ons", F.lit(0)).alias("ons"))
    given = doubtful.where(fixed).select("src", "rec_id", "field", "level", F.when(F.col("key") == WHOLE, 1 << 40).otherwise(0).cast("long").alias("ends"), F.lit(0).cast("long").alias("ons"))
    seen = doubtful.where(~fixed).join(asked, "key").select("src", "rec_id", "field", "level", "ends", "ons").unionByName(given)
    seen = seen.groupBy("src", "rec_id", "field").agg(F.sort_array(F.collect_list(F.struct("level", "ends", "ons"))).alias("c"))
    rate = [F.col("c")[i]["ends"] / F.greatest(F.lit(1), F.col("c")[i]["ends"] + F.col("c")[i]["ons"]) for i in range(3)]
    n = [F.col("c")[i]["ends"] + F.col("c")[i]["ons"] for i in range(3)]
    unfinished = (
        F.when(n[0] >= LEAST_SEEN, rate[0] <= MOST_ENDS)
        .when(n[1] >= LEAST_SEEN, rate[1] <= MOST_ENDS)
        .when((n[2] >= LEAST_SEEN) & (n[2] > NOWHERE * total), rate[2] <= MOST_ENDS)
        .otherwise(n[2] <= NOWHERE * total)
    )
    cut_off = seen.where(unfinished).select("src", "rec_id", "field", F.lit("truncated").alias("defect"))
    return scanned.where("defect IS NOT NULL").select("src", "rec_id", "field", "defect").unionByName(cut_off)
