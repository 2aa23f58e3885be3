"""Column functions on text: tokenisers, normalisers, parsers, n-grams. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Articles and number words of the answer normalisers, token patterns.
ARTICLES = ("a", "an", "the")
NUMBER_WORDS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
MIXED_TOKEN = r"[a-z0-9]+(?:'[a-z]+)?|[\x{3400}-\x{9fff}]"
WORD_TOKEN = r"[\p{L}\p{N}_]+"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
SPACES = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def mixed_tokens(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits, and single Chinese characters; anything else separates. NULL has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(MIXED_TOKEN), F.lit(0))


def whitespace_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(whitespace_words(text))


def cjk_ratio(text: Column) -> Column:
    """Chinese characters over Chinese characters and ASCII letters and digits."""
    t = F.coalesce(text, F.lit(""))
    c = F.regexp_count(t, F.lit(r"[\x{4e00}-\x{9fff}]"))
    return c / F.greatest(c + F.regexp_count(t, F.lit("[A-Za-z0-9]")), F.lit(1))


def language_bucket(text: Column) -> Column:
    r = cjk_ratio(text)
    return F.when(r > 0.5, "zh").when(r < 0.2, "en").otherwise("mixed")


def normalise_a(answer: Column) -> Column:
    """Words without articles, joined by blanks."""
    words = F.regexp_extract_all(F.lower(F.coalesce(answer, F.lit(""))), F.lit(WORD_TOKEN), F.lit(0))
    return F.array_join(F.filter(words, lambda w: ~w.isin(*ARTICLES)), " ")


def normalise_b(answer: Column) -> Column:
    """ASCII punctuation to blanks, number words to digits, no articles."""
    t = F.regexp_replace(F.lower(F.coalesce(answer, F.lit(""))), PUNCTUATION, " ")
    digits = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    words = F.filter(F.split(t, SPACES), lambda w: (w != "") & ~w.isin(*ARTICLES))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(digits, w), w)), " ")


def normalise_c(answer: Column) -> Column:
    return F.lower(F.trim(answer))


def normalise_near_dup(text: Column) -> Column:
    """Lower case; what is neither an ASCII letter or digit nor a Chinese character becomes one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\x{4e00}-\x{9fff}]+", " "))


def yes_no_prefix(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.startswith("yes"), "yes").when(t.startswith("no"), "no")


def yes_no_pattern(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.rlike("^(yes|yeah|y)"), "yes").when(t.rlike("^(no|nope|not)"), "no")


def yes_no_normalised(text: Column) -> Column:
    t = normalise_b(text)
    return F.when(t.startswith("yes"), "yes").when(t.startswith("no"), "no").otherwise("unknown")


#: Around a standalone letter, in any script: the ends of the text, or what is no letter, digit or underscore. Said without `\\b`,
#: which engines understand differently.
ALONE = r"(?:^|[^\p{L}\p{N}_])([%s])(?:$|[^\p{L}\p{N}_])"


def choice_letter(text: Column) -> Column:
    """First standalone upper-case A to D, else the letter after `answer`, in its own case; NULL if there is none."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.coalesce(F.nullif(F.regexp_extract(t, ALONE % "ABCD", 1), F.lit("")), F.nullif(F.regexp_extract(t, rf"(?iu)answer(?:{SPACES})?[:\-]?(?:{SPACES})?([ABCD])", 1), F.lit("")))


def choice_letter_any_case(text: Column) -> Column:
    return F.upper(F.regexp_extract(F.coalesce(text, F.lit("")), ALONE % "A-Da-d", 1))


def judge_score(text: Column, default: float = 3.0) -> Column:
    """First number of a text, in plain or full-width digits."""
    t = F.translate(F.coalesce(text, F.lit("")), "０１２３４５６７８９", "0123456789")
    return F.coalesce(F.regexp_extract(t, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), F.lit(default))


def image_id_of(file_name: Column) -> Column:
    return F.regexp_extract(F.coalesce(file_name, F.lit("")), r"([0-9]{12})", 1).try_cast("long")


def padded_id(image_id: Column) -> Column:
    return F.lpad(image_id.cast("string"), 12, "0")


def sanitise_line(text: Column) -> Column:
    """Line breaks and bar separators to blanks, doubled blanks once to one, trimmed, `.` if nothing is left."""
    t = F.coalesce(text, F.lit(""))
    for x in ("\r", "\n", "|||"):
        t = F.replace(t, F.lit(x), F.lit(" "))
    return F.coalesce(F.nullif(F.trim(F.replace(t, F.lit("  "), F.lit(" "))), F.lit("")), F.lit("."))


# Patterns, on lower-case text, of answers that refuse or hedge.
REFUSAL_PATTERNS = (
    r"as an ai",
    r"i (can'?t|cannot|am not able)",
    r"i don'?t have",
    r"cannot see",
    r"no image",
    r"without (the|an) image",
    r"unable to",
    r"not (able to|possible) (to )?(determine|answer|see|provide)",
)
HEDGE_WORDS = ("maybe", "perhaps", "possibly", "could be", "might be")


def is_refusal(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(REFUSAL_PATTERNS))


def is_hedge(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(HEDGE_WORDS))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, with repetition; none if the text is shorter."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))), lambda i: i <= F.size(tokens) - n + 1)
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def shingles(tokens: Column, k: int = 5) -> Column:
    """Distinct runs of k tokens; a text of fewer is one shingle as a whole."""
    return F.array_distinct(F.when(F.size(tokens) < k, F.array(F.array_join(tokens, " "))).otherwise(ngrams(tokens, k)))
