"""DuckDB SQL fragments that mirror the library's Column expressions.

Used only to write the oracle queries; each helper returns SQL text.
"""

from __future__ import annotations

from ..functions import text as T


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rr(x: str, pattern: str, repl: str = " ") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(repl)}, 'g')"


def collapse_ws(x: str) -> str:
    return rr(x, T.WS + "+", " ")


def clean_social(x: str) -> str:
    out = x
    for name in T.SOCIAL_ORDER:
        out = rr(out, T.SOCIAL_PATTERNS[name])
        if name in ("reserved", "numbers"):
            out = rr(out, T.SOCIAL_PATTERNS[name])
    return f"trim({collapse_ws(out)})"


def clean_text(x: str) -> str:
    out = rr(clean_social(x), T.LINK)
    return rr(collapse_ws(out), T.POST_SEPARATOR)


def clean_strict(x: str) -> str:
    out = rr(clean_social(x), T.LINK)
    out = rr(out, T.STRICT_KEEP)
    out = rr(out, T.ISOLATED_LETTER)
    return collapse_ws(out)


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(T.WS + '+')}), lambda t: t <> '')"


def sentences(x: str) -> str:
    lines = f"string_split(regexp_replace({x}, '([.?!])', '\\1' || chr(10), 'g'), chr(10))"
    return f"list_filter({lines}, lambda s: regexp_matches(s, {q(T.NON_WS)}))"


def hexint(x: str, start: int, n: int) -> str:
    return f"(('0x' || substr(md5({x}), {start}, {n}))::BIGINT)"


# ---- readability ----------------------------------------------------------------

def _sent_text(x: str) -> str:
    return f"regexp_replace({x}, '([.?!])', '\\1' || chr(10), 'g')"


def rd_words(x: str) -> str:
    from ..functions import readability as R
    return f"list_filter({tokens(_sent_text(x))}, lambda t: regexp_matches(t, {q(R.WORD_CHAR)}))"


def rd_letters_lower(w: str) -> str:
    from ..functions import readability as R
    return f"lower(regexp_replace({w}, {q(R.NON_LETTER)}, '', 'g'))"


def rd_syllables(w: str) -> str:
    from ..functions import readability as R
    lw = rd_letters_lower(w)
    groups = f"len(regexp_extract_all({lw}, {q(R.VOWEL_GROUP)}))"
    silent = f"(CASE WHEN {lw} LIKE '%e' AND {lw} NOT LIKE '%le' AND {groups} > 1 THEN 1 ELSE 0 END)"
    return f"greatest(1, {groups} - {silent})"


def rd_sentences(x: str) -> str:
    return f"list_filter(string_split({_sent_text(x)}, chr(10)), lambda s: regexp_matches(s, {q(T.NON_WS)}))"


def rd_paragraphs(x: str) -> str:
    return (f"greatest(1, len(list_filter(regexp_split_to_array({_sent_text(x)}, '\\n[ \\t\\r]*\\n'), "
            f"lambda s: regexp_matches(s, {q(T.NON_WS)}))))")


def rd_counts(x: str) -> dict:
    from ..functions import readability as R
    ws = rd_words(x)
    return {
        "characters": f"coalesce(list_sum(list_transform({ws}, lambda w: length(w))), 0)::BIGINT",
        "syllables": f"coalesce(list_sum(list_transform({ws}, lambda w: {rd_syllables('w')})), 0)::BIGINT",
        "words": f"len({ws})::BIGINT",
        "wordtypes": f"len(list_distinct(list_transform({ws}, lambda w: lower(w))))::BIGINT",
        "sentences": f"len({rd_sentences(x)})::BIGINT",
        "paragraphs": f"{rd_paragraphs(x)}::BIGINT",
        "long_words": f"len(list_filter({ws}, lambda w: length({rd_letters_lower('w')}) >= {R.LONG_WORD}))::BIGINT",
        "complex_words": (f"len(list_filter({ws}, lambda w: {rd_syllables('w')} >= {R.COMPLEX_SYLLABLES} "
                          "AND substr(w, 1, 1) = lower(substr(w, 1, 1))))::BIGINT"),
    }


def _in(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def rd_usage(x: str) -> dict:
    from ..functions import readability as R
    lw = f"list_transform({rd_words(x)}, lambda w: {rd_letters_lower('w')})"
    first = (f"list_filter(list_transform({rd_sentences(x)}, lambda s: "
             f"{rd_letters_lower(f'list_filter({tokens(chr(115))}, lambda t: regexp_matches(t, {q(R.WORD_CHAR)}))[1]')}), "
             "lambda z: z IS NOT NULL)")

    def member(arr, ws):
        return f"len(list_filter({arr}, lambda m: m IN {_in(ws)}))::BIGINT"
    suffix = "(" + "|".join(R.NOMINALIZATION_SUFFIXES) + ")$"
    return {
        "use_tobeverb": member(lw, R.TOBEVERB),
        "use_auxverb": member(lw, R.AUXVERB),
        "use_conjunction": member(lw, R.CONJUNCTION),
        "use_pronoun": member(lw, R.PRONOUN),
        "use_preposition": member(lw, R.PREPOSITION),
        "use_nominalization": f"len(list_filter({lw}, lambda m: regexp_matches(m, {q(suffix)})))::BIGINT",
        "begin_pronoun": member(first, R.PRONOUN),
        "begin_interrogative": member(first, R.INTERROGATIVE),
        "begin_article": member(first, R.ARTICLE),
        "begin_subordination": member(first, R.SUBORDINATION),
        "begin_conjunction": member(first, R.CONJUNCTION),
        "begin_preposition": member(first, R.PREPOSITION),
    }
