"""Language of conversations and of stretches in another language (problem 1).

Nearest-centroid classification: a stretch of text is a normalised TF-IDF vector of hashed words and character n-grams, compared by
cosine with several clustered centroids per language. The centroids are fitted on a bounded sample of labelled rows
(`SAMPLE_ROWS` conversations, chosen by a hash of their id); the labels being partly wrong, stretches nearer to another
language's centroid than to their own are dropped and the centroids fitted again. A stretch farther from its nearest centroid
than nearly all of the training stretches of its length are from theirs is rejected and states no language.

Turns are cut into sentences; quoted scraps are removed, long quotations count as sentences of their own; a sentence that
changes script is cut there. A language counts as used only by an accepted stretch of sentence length.

Cases: system turns, blank turns, NULL or unparsable conversations and rows without turns are ignored; a NULL content is
blank; a conversation without any letters, or far from every language, gets no language and no row; if no row carries a known label nothing
can be fitted and the result is empty. `row_id` is expected to be unique, rows repeated under one id are classified each.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import spread

LANGS = ("de", "en", "es", "fr", "zh")
#: Bound of the labelled sample, centroids per language, hashed dimensions, longest n-gram.
SAMPLE_ROWS, CLUSTERS, DIMS, GRAMS = 6000, 32, 1 << 15, 3
#: Times that a whole word counts beside its n-grams.
WORD_WEIGHT = 2
#: Words (Chinese: characters) from which a stretch counts as a sentence, and from which a quotation is one, and confidence from which a sentence counts.
SENTENCE_WORDS, QUOTED_WORDS, SURE = 4, 6, 0.65

CJK = "㐀-䶿一-鿿"
# A line break ends a sentence only where a new one begins; texts wrapped anywhere stay whole.
_END = re.compile(f"(?<=[.!?])[\"'”’»)\\]]*\\s+|(?<=[。！？])[\"'”’»）\\]]*\\s*|[\r\n]+(?=\\s*[A-ZÀ-ÞŒ¿¡{CJK}\"“«(#\\d<-])|\\s/\\s|\\s[-–—|]\\s|;\\s|；")
_QUOTES = re.compile("(?<!\\w)['‘’‚]([^'‘’\n]{1,300}?)['‘’](?!\\w)|[\"“”„«]([^\"“”»\n]{1,300}?)[\"“”»]|「([^」\n]{1,300}?)」|『([^』\n]{1,300}?)』")
_WORD = re.compile(f"[{CJK}]|[^\\W\\d_{CJK}]+(?:['’][^\\W\\d_{CJK}]+)*")
_RUN = re.compile(f"[{CJK}][^A-Za-zÀ-ÿ]*|[A-Za-zÀ-ÿ][^{CJK}]*")
_CHINESE, _LATIN = re.compile(f"[{CJK}]"), re.compile(r"[A-Za-zÀ-ÿ]+")
_SPACE = re.compile(r"[\W\d_]+")
_QUOTE = re.compile("['‘’‚\"“”„«」』]")


def n_words(text: str) -> int:
    return len(_WORD.findall(text))


def by_script(text: str) -> list[str]:
    """The text, cut where it changes between Chinese and Latin script for at least a sentence's length."""
    if text.isascii() or not _CHINESE.search(text) or len(_LATIN.findall(text)) < SENTENCE_WORDS:
        return [text]
    parts: list[list[str]] = []
    for run in _RUN.findall(text):
        latin = not re.match(f"[{CJK}]", run)
        if latin and len(re.findall(r"[^\W\d_]+", run)) < SENTENCE_WORDS:
            if parts:
                parts[-1].append(run)  # a name inside Chinese text
            continue
        if parts and parts[-1][0] == str(latin):
            parts[-1].append(run)
        else:
            parts.append([str(latin), run])
    return ["".join(p[1:]) for p in parts] or [text]


def stretches(text: str) -> list[str]:
    """Sentences of a turn without markers and quoted scraps; long quotations stand by themselves."""
    if not text:
        return []
    text = text.replace("<image>", " ")
    quoted: list[str] = []

    def take(m: re.Match) -> str:
        inner = next(g for g in m.groups() if g is not None)
        if n_words(inner) >= QUOTED_WORDS and not (re.search(f"[{CJK}]", inner) and len(inner) < 10):
            quoted.append(inner)
        return " "

    rest = _QUOTES.sub(take, text) if _QUOTE.search(text) else text
    if not _WORD.search(rest) and not quoted:  # the turn is nothing but a quotation
        rest = text
    return [p for s in [*_END.split(rest), *quoted] if s and _WORD.search(s) for p in by_script(s)]


def clean(text: str) -> str:
    return " " + _SPACE.sub(" ", text.lower()).strip() + " "


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, dimension, count) of the hashed n-grams of cleaned texts, sorted."""
    if not texts:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.float32)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    keys = []
    h = codes.copy()
    for n in range(1, GRAMS + 1):
        if n > 1:
            h = h[:-1] * np.uint64(1_000_003) + codes[n - 1 :]
        same = owner[: len(h)] == owner[n - 1 :]
        if n == 1:
            same &= codes != 32
        x = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        d = (x >> np.uint64(64 - 15)).astype(np.int64) % DIMS
        keys.append((owner[: len(h)] * DIMS + d)[same])
    words = [t.split() for t in texts]
    known: dict[str, int] = {}
    flat = [w for t in words for w in t]
    for w in set(flat):
        known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "little") % DIMS if len(w) > 1 and not "㐀" <= w[0] <= "鿿" else -1
    at = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
    keys += [(np.repeat(np.arange(len(words)) * DIMS, [len(t) for t in words]) + at)[at >= 0]] * WORD_WEIGHT
    key = np.concatenate(keys)
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[first, len(key)])
    key = key[first]
    return key // DIMS, key % DIMS, count.astype(np.float32)


@dataclass
class Model:
    """Centroids (dimension x centroid), the language of each, inverse document frequencies, and the rejection distances."""

    langs: list[str]
    centroids: np.ndarray
    of: np.ndarray
    idf: np.ndarray
    floor: np.ndarray  # least accepted cosine by length class

    def cosines(self, texts: list[str]) -> np.ndarray:
        """Cosine of each text with the nearest centroid of each language; every text is compared with every centroid."""
        out = np.zeros((len(texts), len(self.langs)), np.float32)
        starts = np.flatnonzero(np.r_[True, self.of[1:] != self.of[:-1]])
        for at in range(0, len(texts), 1024):
            part = [clean(t) for t in texts[at : at + 1024]]
            row, dim, w = weights(part, self.idf)
            if len(row):
                out[at : at + len(part)] = np.maximum.reduceat(_dots(row, dim, w, self.centroids, len(part)), starts, axis=1)
        return out


def confidence(cos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best, its cosine, confidence) by the gap between the two nearest languages, relative to the nearest: cosines grow with
    the length of the text, and so does the gap."""
    best = cos.argmax(axis=1)
    at = np.arange(len(cos))
    top = cos[at, best]
    rest = cos.copy()
    rest[at, best] = -1
    second = np.maximum(rest.max(axis=1), 0)
    return best, top, 1 / (1 + np.exp(-8 * (top - second) / np.maximum(top, 1e-6)))


def weights(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, dim, count = grams(texts)
    w = (1 + np.log(np.maximum(count, 1))) * idf[dim]
    norm = np.sqrt(np.bincount(row, w * w, minlength=len(texts)))
    return row, dim, (w / np.maximum(norm[row], 1e-9)).astype(np.float32)


def length_class(text: str) -> int:
    return min(5, max(1, len(text)).bit_length() - 1)


def _means(row: np.ndarray, dim: np.ndarray, w: np.ndarray, part: np.ndarray, k: int) -> np.ndarray:
    """Normalised mean vectors (dimension x part) of the texts of each part; part -1 is left out."""
    at = part[row] >= 0
    v = np.bincount(part[row[at]] * DIMS + dim[at], w[at], minlength=k * DIMS).reshape(k, DIMS)
    return (v / np.maximum(1e-9, np.sqrt((v * v).sum(axis=1, keepdims=True)))).T.astype(np.float32)


def _dots(row: np.ndarray, dim: np.ndarray, w: np.ndarray, c: np.ndarray, n: int, step: int = 64) -> np.ndarray:
    """Products of n texts with the columns of c; `row` is sorted. A few texts at a time are dense in the dimensions they use."""
    if c.shape[1] == 1:
        return np.bincount(row, w * c[dim, 0], minlength=n)[:, None].astype(np.float32)
    out = np.zeros((n, c.shape[1]), np.float32)
    bounds = np.searchsorted(row, np.arange(0, n + step, step))
    used, place = np.zeros(len(c), bool), np.zeros(len(c), np.int64)
    for k, (s, e) in enumerate(zip(bounds, bounds[1:])):
        if s < e:
            d = dim[s:e]
            used[d] = True
            u = np.flatnonzero(used)
            used[u] = False
            place[u] = np.arange(len(u))
            x = np.zeros((min(step, n - k * step), len(u)), np.float32)
            x[row[s:e] - k * step, place[d]] = w[s:e]
            out[k * step : k * step + len(x)] = x @ c[u]
    return out


def fit_texts(samples: list[tuple[str, str]], clusters: int = CLUSTERS, rounds: int = 4) -> Model | None:
    """A model from (language, text) pairs, part of whose labels may be wrong."""
    counts: dict[tuple[str, str], int] = {}
    for lang, t in samples:
        if n_words(t) >= SENTENCE_WORDS:
            t = clean(t)
            counts[lang, t] = counts.get((lang, t), 0) + 1
    langs = [x for x in LANGS if any(lang == x for lang, _ in counts)]
    if not langs:
        return None
    texts = [t for _, t in counts]
    label = np.array([langs.index(lang) for lang, _ in counts])
    often = np.sqrt(np.array(list(counts.values()), np.float32))
    n = len(texts)
    row, dim, _ = grams(texts)
    idf = (np.log((1 + n) / (1 + np.bincount(dim, minlength=DIMS))) + 1).astype(np.float32)
    row, dim, w = weights(texts, idf)
    # A text seen often carries its own evidence: the label that most of its rows give.
    seen: dict[str, int] = {}
    for (_, t), m in counts.items():
        seen[t] = seen.get(t, 0) + m
    common = np.array([seen[t] >= 5 for t in texts])
    agreed = np.array([2 * m > seen[t] for (_, t), m in counts.items()])
    kept = agreed | ~common
    for _ in range(rounds):
        c = _means(row, dim, w * often[row], np.where(kept, label, -1), len(langs))
        kept = np.where(common, agreed, _dots(row, dim, w, c, n).argmax(axis=1) == label)
    rng = np.random.default_rng(7)
    centres, of = [], []
    for k in range(len(langs)):
        own = np.flatnonzero(kept & (label == k))
        if not len(own):
            own = np.flatnonzero(label == k)
        at = np.isin(row, own)
        r, d, v = np.searchsorted(own, row[at]), dim[at], w[at]
        # Seeds far from each other, so that short phrases seen often get centroids of their own.
        seeds, far = [int(often[own].argmax())], np.ones(len(own), np.float32)
        for _ in range(min(clusters, len(own)) - 1):
            far = np.minimum(far, 1 - _dots(r, d, v, _means(r, d, v, np.where(np.arange(len(own)) == seeds[-1], 0, -1), 1), len(own))[:, 0])
            chance = np.maximum(far, 0) * often[own] ** 3
            seeds.append(int(rng.choice(len(own), p=chance / chance.sum())) if chance.sum() > 0 else 0)
        first = np.full(len(own), -1)
        first[seeds] = np.arange(len(seeds))
        part = _dots(r, d, v, _means(r, d, v, first, clusters), len(own)).argmax(axis=1)
        for _ in range(4):  # spherical k-means
            c = _means(r, d, v * often[own][r], part, clusters)
            c = c[:, (c != 0).any(axis=0)]
            part = _dots(r, d, v, c, len(own)).argmax(axis=1)
        c = _means(r, d, v * often[own][r], part, clusters)
        c = c[:, (c != 0).any(axis=0)]
        centres.append(c)
        of += [k] * c.shape[1]
    model = Model(langs, np.ascontiguousarray(np.concatenate(centres, axis=1)), np.array(of), idf, np.zeros(6, np.float32))
    near = _dots(row, dim, w, model.centroids, n).max(axis=1)
    size = np.array([length_class(t) for t in texts])
    for s in range(6):
        at = near[kept & (size <= s)]
        model.floor[s] = np.quantile(at, 0.002) * 0.5 if len(at) >= 20 else 0.02
    return model


def label_of(lang: str | None) -> str | None:
    """The language a label names in any case or with a region, else None."""
    m = re.fullmatch(r"\s*([A-Za-z]{2,3})(?:[-_][A-Za-z0-9]+)*\s*", lang or "")
    return m[1].lower() if m and m[1].lower() in LANGS else None


def turns_of(conversations: str | None) -> list[tuple[int, str, str]]:
    """(number, role, content) of the user and assistant turns."""
    try:
        turns = json.loads(conversations) if conversations else []
    except ValueError:
        return []
    if not isinstance(turns, list):
        return []
    out = []
    for i, t in enumerate(turns):
        if isinstance(t, dict) and str(t.get("role")).lower() in ("user", "assistant") and isinstance(t.get("content"), str):
            out.append((i, t["role"].lower(), t["content"]))
    return out


def sample(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """(language, stretch) from at most `sample_rows` labelled rows of (row_id, conversations, lang)."""
    n = rows.count()
    share = min(1_000_000, int(1_000_000 * 1.5 * sample_rows / max(1, n)) + 1)
    picked = rows.where(F.col("conversations").isNotNull() & F.col("lang").isNotNull()).where(F.pmod(F.xxhash64("row_id", F.lit("language sample")), F.lit(1_000_000)) < share)
    out: list[tuple[str, str]] = []
    for r in picked.select("conversations", "lang").limit(sample_rows).collect():
        if label := label_of(r["lang"]):
            out += [(label, s) for _, _, content in turns_of(r["conversations"]) for s in stretches(content)]
    return out


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from at most `sample_rows` rows of (row_id, conversations, lang)."""
    return fit_texts(sample(rows, sample_rows))


Parts = dict[str, list[tuple[str, int]]]


def parts_of(turns: list[list[tuple[int, str, str]]]) -> Parts:
    """content -> its stretches with their numbers of words."""
    return {c: [(s, n_words(s)) for s in stretches(c)] for c in {c for t in turns for _, _, c in t}}


def languages_of(turns: list[tuple[int, str, str]], cut_up: Parts, found: dict[str, tuple[str | None, float]]) -> tuple[str | None, float, list[tuple[int, str, float]]]:
    """Main language and confidence of a conversation, and the (turn, language, confidence) used if there are several."""
    size: dict[str, float] = {}
    sure: dict[str, float] = {}
    per: dict[tuple[int, str], tuple[float, float]] = {}
    loose: list[tuple[int, str]] = []
    for no, _, content in turns:
        parts = cut_up[content]
        hit = False
        for s, n in parts:
            lang, conf = found[s]
            if lang is None:
                continue
            weight = n * conf
            if n >= SENTENCE_WORDS and conf >= SURE:
                hit = True
                size[lang] = size.get(lang, 0) + weight
                sure[lang] = max(sure.get(lang, 0), conf)
                a, b = per.get((no, lang), (0.0, 0.0))
                per[no, lang] = (a + weight, b + n)
        if parts and not hit:
            loose.append((no, content))
    if not size:  # nothing of sentence length: all stretches together decide
        votes: dict[str, float] = {}
        for no, content in loose:
            for s, n in cut_up[content]:
                lang, conf = found[s]
                if lang:
                    votes[lang] = votes.get(lang, 0) + n * max(conf - 0.2, 0.01)
        if not votes:
            return None, 0.0, []
        best = max(votes, key=lambda k: (votes[k], k))
        return best, votes[best] / sum(votes.values()), []
    main = max(size, key=lambda k: (size[k], k))
    if len(size) == 1:
        return main, sure[main], []
    used = [(no, lang, a / b) for (no, lang), (a, b) in per.items()]
    known: dict[int, str] = {}
    for (no, lang), (a, _) in sorted(per.items(), key=lambda x: x[1][0]):
        known[no] = lang
    for no, content in loose:
        letters = "".join(_WORD.findall(content))
        if len(letters) < 2 and not re.search(f"[{CJK}]", letters):
            continue
        chinese = bool(re.search(f"[{CJK}]", letters)) and not re.search(r"[A-Za-zÀ-ÿ]{2}", letters)
        options = [x for x in size if (x == "zh") == chinese]
        if not options:
            continue
        votes = {}
        for s, n in cut_up[content]:
            lang, conf = found[s]
            if lang in options:
                votes[lang] = votes.get(lang, 0) + n * conf
        before = known.get(no - 1) if known.get(no - 1) in options else known.get(no + 1)
        best = max(votes, key=lambda k: (votes[k], k)) if votes else before if before in options else max(options, key=lambda k: size[k])
        used.append((no, best, 0.5))
    return main, size[main] / sum(size.values()), sorted(used)


def classify(texts: list[str], model: Model) -> dict[str, tuple[str | None, float]]:
    """Language and confidence of each text; None where the distance to every centroid is too large."""
    texts = list(dict.fromkeys(texts))
    out: dict[str, tuple[str | None, float]] = {}
    if not texts:
        return out
    best, top, conf = confidence(model.cosines(texts))
    for i, t in enumerate(texts):
        out[t] = (model.langs[best[i]], float(conf[i])) if top[i] >= model.floor[length_class(t)] and top[i] > 0 else (None, 0.0)
    return out


def judged(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[int, str | None, str, float, list[tuple[int, str, float]]]]:
    """(id, given label, main language, its confidence, (turn, language, confidence) if there are several) of the conversations
    that state a language, from batches of (row_id, conversations, lang)."""
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            turns = [turns_of(c) for c in part.column(1).to_pylist()]
            cut_up = parts_of(turns)
            found = classify([s for x in cut_up.values() for s, _ in x], model)
            for i, t, given in zip(part.column(0).to_pylist(), turns, part.column(2).to_pylist()):
                main, conf, used = languages_of(t, cut_up, found)
                if main is not None:
                    yield i, label_of(given), main, conf, used


def _emit(sft: DataFrame, rows_of, schema: pa.Schema) -> DataFrame:
    """What `rows_of` makes of each judged conversation, in one pass over the table."""
    rows = sft.select("row_id", "conversations", "lang")
    model = fit(rows)
    text = ", ".join(f"{f.name} {t}" for f, t in zip(schema, ("long", "long", "string", "double")))
    if model is None:
        return sft.sparkSession.createDataFrame([], text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [r for x in judged(iter([b]), model) for r in rows_of(*x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return spread(rows.where("conversations IS NOT NULL AND row_id IS NOT NULL")).mapInArrow(run, text)


FIELDS = [("row_id", pa.int64()), ("turn_no", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64())]


def conversation_languages(sft: DataFrame) -> DataFrame:
    """(row_id, turn_no, lang, confidence): a row of turn -1 per conversation, and for conversations of several languages a row
    per turn and language used in it."""

    def rows_of(i, given, main, conf, used):
        return [(i, -1, main, conf), *((i, *u) for u in used)]

    return _emit(sft, rows_of, pa.schema(FIELDS))


def mislabelled_or_mixed(sft: DataFrame) -> DataFrame:
    """(row_id, turn_no, lang): conversations whose label is missing or wrong, and the turns and languages of mixed ones."""

    def rows_of(i, given, main, conf, used):
        return [(i, no, lang) for no, lang, _ in used] or [(i, -1, main)] * (given != main)

    return _emit(sft, rows_of, pa.schema(FIELDS[:3]))
