"""Readability counts, ratios, grades and word usage as row expressions.

Input convention: the text gets a line break after every ``.``, ``?`` and ``!``;
one sentence per non-blank line; tokens are whitespace-separated.  Everything
except the easy-word count is computed inside the row with array functions, so
no shuffle is needed; the easy-word count is an explode + broadcast join +
per-document aggregate (see ``operators.readability``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NON_WS, SENTENCE_END, WS, tokenize

# ---------------------------------------------------------------------------
# The word lists and suffixes of the published style measures (usage
# counts of the classic Unix style program); they must equal the published ones.
TOBEVERB = ("be", "being", "was", "were", "been", "are", "is", "am")
AUXVERB = ("will", "shall", "cannot", "may", "need", "would", "should", "could",
           "might", "must", "ought")
CONJUNCTION = ("and", "but", "or", "yet", "nor")
NOMINALIZATION_SUFFIXES = ("tion", "ment", "ence", "ance")
PRONOUN = ("i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us",
           "them", "my", "your", "his", "its", "our", "their", "mine", "yours",
           "hers", "ours", "theirs", "myself", "yourself", "himself", "herself",
           "itself", "ourselves", "themselves")
PREPOSITION = ("aboard", "about", "above", "across", "after", "against", "along",
               "among", "around", "as", "at", "before", "behind", "below", "beneath",
               "beside", "between", "beyond", "by", "down", "during", "except", "for",
               "from", "in", "inside", "into", "like", "near", "of", "off", "on",
               "onto", "out", "outside", "over", "past", "since", "through",
               "throughout", "to", "toward", "under", "until", "up", "upon", "with",
               "within", "without")
INTERROGATIVE = ("why", "who", "what", "whom", "when", "where", "how", "which", "whose")
ARTICLE = ("the", "a", "an")
SUBORDINATION = ("because", "although", "though", "while", "whereas", "unless", "if",
                 "since", "after", "before", "until", "whether", "once")
WORD_CHAR = r"[\p{L}\p{N}_]"
NON_LETTER = r"[^\p{L}]"
VOWEL_GROUP = "[aeiouy]+"
LONG_WORD = 7
COMPLEX_SYLLABLES = 3
PARAGRAPH_BREAK = "\n[ \t\r]*\n"
# ---------------------------------------------------------------------------

COUNT_COLUMNS = ("characters", "syllables", "words", "wordtypes", "sentences",
                 "paragraphs", "long_words", "complex_words")
RATIO_COLUMNS = ("characters_per_word", "syll_per_word", "words_per_sentence",
                 "sentences_per_paragraph", "type_token_ratio")
GRADE_COLUMNS = ("kincaid", "ari", "coleman_liau", "flesch_reading_ease",
                 "gunning_fog_index", "lix", "smog_index", "rix", "dale_chall_index")
USAGE_COLUMNS = ("use_tobeverb", "use_auxverb", "use_conjunction", "use_pronoun",
                 "use_preposition", "use_nominalization")
BEGIN_COLUMNS = ("begin_pronoun", "begin_interrogative", "begin_article",
                 "begin_subordination", "begin_conjunction", "begin_preposition")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def split_sentences_text(text) -> Column:
    return F.regexp_replace(_c(text), SENTENCE_END, "$1\n")


def words(text) -> Column:
    """Tokens of the sentence-split text holding at least one word character."""
    return F.filter(tokenize(split_sentences_text(text)), lambda t: F.regexp_like(t, F.lit(WORD_CHAR)))


def letters_lower(w: Column) -> Column:
    return F.lower(F.regexp_replace(w, NON_LETTER, ""))


def syllables(w: Column) -> Column:
    """Vowel groups of the lower-case letters, minus a silent final ``e``
    (not ``-le``) when there is more than one group; at least 1."""
    lw = letters_lower(w)
    groups = F.size(F.regexp_extract_all(lw, F.lit(VOWEL_GROUP), 0))
    silent = F.when(lw.endswith("e") & ~lw.endswith("le") & (groups > 1), 1).otherwise(0)
    return F.greatest(F.lit(1), groups - silent)


def sentence_list(text) -> Column:
    lines = F.split(split_sentences_text(text), "\n")
    return F.filter(lines, lambda s: F.regexp_like(s, F.lit(NON_WS)))


def paragraphs(text) -> Column:
    """Blocks separated by a blank line (newline, optional spaces, newline)."""
    blocks = F.split(split_sentences_text(text), PARAGRAPH_BREAK)
    return F.greatest(F.lit(1), F.size(F.filter(blocks, lambda s: F.regexp_like(s, F.lit(NON_WS)))))


def _count(arr: Column, pred) -> Column:
    return F.size(F.filter(arr, pred)).cast("bigint")


PREPARED = ("_ws", "_lw", "_syl", "_sl", "_np")


def prepare(text) -> dict[str, Column]:
    """Stage 1, per document: the sentence-split text, computed once."""
    return {"_st": split_sentences_text(text)}


def prepare_split(st: Column) -> dict[str, Column]:
    """Stage 2: words, sentences and the paragraph count from the split text."""
    blocks = F.split(st, PARAGRAPH_BREAK)
    return {
        "_ws": F.filter(tokenize(st), lambda t: F.regexp_like(t, F.lit(WORD_CHAR))),
        "_sl": F.filter(F.split(st, "\n"), lambda x: F.regexp_like(x, F.lit(NON_WS))),
        "_np": F.greatest(F.lit(1), F.size(F.filter(blocks, lambda x: F.regexp_like(x, F.lit(NON_WS))))),
    }


def prepare_words(ws: Column) -> dict[str, Column]:
    """Stage 3: letters-only lower-case form of every word."""
    return {"_lw": F.transform(ws, letters_lower)}


def prepare_syllables(lw: Column) -> dict[str, Column]:
    """Stage 4: syllables per word (one vowel-group extraction per word)."""
    per = F.transform(lw, lambda x: F.struct(x.alias("l"), F.size(F.regexp_extract_all(
        x, F.lit(VOWEL_GROUP), 0)).alias("g")))
    return {"_syl": F.transform(per, lambda s: F.greatest(F.lit(1), s["g"] - F.when(
        s["l"].endswith("e") & ~s["l"].endswith("le") & (s["g"] > 1), 1).otherwise(0)))}


def counts_from(p: dict[str, Column], text) -> dict[str, Column]:
    """Count columns (bigint) from prepared arrays."""
    ws, lw, syl = p["_ws"], p["_lw"], p["_syl"]
    pairs = F.arrays_zip(ws.alias("w"), syl.alias("s"))
    return {
        "characters": F.aggregate(ws, F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)),
        "syllables": F.aggregate(syl, F.lit(0).cast("bigint"), lambda a, x: a + x),
        "words": F.size(ws).cast("bigint"),
        "wordtypes": F.size(F.array_distinct(F.transform(ws, F.lower))).cast("bigint"),
        "sentences": F.size(p["_sl"]).cast("bigint"),
        "paragraphs": (p["_np"] if "_np" in p else paragraphs(text)).cast("bigint"),
        "long_words": _count(lw, lambda x: F.length(x) >= LONG_WORD),
        "complex_words": _count(pairs, lambda z: (z["s"] >= COMPLEX_SYLLABLES)
                                & (F.substring(z["w"], 1, 1) == F.lower(F.substring(z["w"], 1, 1)))),
    }


def counts(text) -> dict[str, Column]:
    """Count columns of one document (all bigint), unprepared form."""
    st = split_sentences_text(text)
    p = prepare_split(st)
    p.update(prepare_words(p["_ws"]))
    p.update(prepare_syllables(p["_lw"]))
    return counts_from(p, text)


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratios(c: dict[str, Column]) -> dict[str, Column]:
    return {
        "characters_per_word": _div(c["characters"], c["words"]),
        "syll_per_word": _div(c["syllables"], c["words"]),
        "words_per_sentence": _div(c["words"], c["sentences"]),
        "sentences_per_paragraph": _div(c["sentences"], c["paragraphs"]),
        "type_token_ratio": _div(c["wordtypes"], c["words"]),
    }


def grades(c: dict[str, Column], complex_dc: Column) -> dict[str, Column]:
    """Published grade formulas over the counts (NULL when a divisor is 0)."""
    w, s, syl = c["words"], c["sentences"], c["syllables"]
    ch, lw, cx = c["characters"], c["long_words"], c["complex_words"]
    wps = _div(w, s)
    dc_share = _div(complex_dc, w)
    return {
        "kincaid": 11.8 * _div(syl, w) + 0.39 * wps - 15.59,
        "ari": 4.71 * _div(ch, w) + 0.5 * wps - 21.43,
        "coleman_liau": 5.879851 * _div(ch, w) - 29.587280 * _div(s, w) - 15.800804,
        "flesch_reading_ease": 206.835 - 84.6 * _div(syl, w) - 1.015 * wps,
        "gunning_fog_index": 0.4 * (wps + 100 * _div(cx, w)),
        "lix": wps + 100 * _div(lw, w),
        "smog_index": F.sqrt(_div(cx * 30, s)) + 3,
        "rix": _div(lw, s),
        "dale_chall_index": 15.79 * dc_share + 0.0496 * wps
        + F.when(dc_share > 0.05, F.lit(3.6365)).otherwise(F.lit(0.0)),
    }


def usage_from(lw: Column, sl: Column) -> dict[str, Column]:
    """Word-usage counts (lower-case letters of each word) and sentence
    beginnings (first word of each sentence)."""
    # first whitespace-delimited token holding a word character: one regex
    # extraction per sentence (same token as tokenize + filter + first)
    first_tok = "(?:^|" + WS + ")(" + NON_WS + "*?" + WORD_CHAR + NON_WS + "*)"
    firsts = F.transform(sl, lambda s: F.regexp_extract(s, first_tok, 1))
    firsts = F.transform(F.filter(firsts, lambda x: x != F.lit("")), letters_lower)

    def member(arr, words_):
        return _count(arr, lambda x: x.isin(*words_))

    nominal = _count(lw, lambda x: F.regexp_like(x, F.lit("(" + "|".join(NOMINALIZATION_SUFFIXES) + ")$")))
    return {
        "use_tobeverb": member(lw, TOBEVERB),
        "use_auxverb": member(lw, AUXVERB),
        "use_conjunction": member(lw, CONJUNCTION),
        "use_pronoun": member(lw, PRONOUN),
        "use_preposition": member(lw, PREPOSITION),
        "use_nominalization": nominal,
        "begin_pronoun": member(firsts, PRONOUN),
        "begin_interrogative": member(firsts, INTERROGATIVE),
        "begin_article": member(firsts, ARTICLE),
        "begin_subordination": member(firsts, SUBORDINATION),
        "begin_conjunction": member(firsts, CONJUNCTION),
        "begin_preposition": member(firsts, PREPOSITION),
    }


def usage(text) -> dict[str, Column]:
    return usage_from(F.transform(words(text), letters_lower), sentence_list(text))
