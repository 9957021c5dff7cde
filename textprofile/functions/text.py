"""Column -> Column text functions: cleaners, tokenizer, sentence split, parsers.

Cleaners and ``tokenize_batches`` run Arrow's kernels over batches of rows (RE2,
each replacement one compiled scan); every other function returns a built-in
Spark expression.  The regular expressions avoid ``\\s``/``\\w``/``\\b`` where Java and
RE2 disagree, so the same patterns can be replayed by a SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import batches as B

# ---------------------------------------------------------------------------
# Fixed values.
# Whitespace: every code point Python's str.split() treats as whitespace.
WHITESPACE_RANGES = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
                     (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
                     (0x3000, 0x3000))


def _complement_class(ranges, top=0x10FFFF) -> str:
    """Ranges not in ``ranges``, the printable-ASCII and Latin/Greek/Cyrillic
    spans first: a regex engine tests a union of ranges left to right, so the
    usual non-space character is decided by the first test."""
    out, lo = [], 0
    for a, b in sorted(ranges):
        if a > lo:
            out.append((lo, a - 1))
        lo = b + 1
    if lo <= top:
        out.append((lo, top))
    out.sort(key=lambda r: (not (r[0] <= 0x41 <= r[1]), not (r[0] <= 0xE9 <= r[1]), r[0]))
    return "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in out)


# WS / NON_WS as one explicit class (identical in Java regex and RE2); WS is
# written as the negated complement because that is the fast form in Java.
NON_WS = "[" + _complement_class(WHITESPACE_RANGES) + "]"
WS = "[^" + _complement_class(WHITESPACE_RANGES) + "]"
# Whitespace other than the blank, and the runs that a collapse changes: a single
# blank is by far the commonest separator and stays as it is.
_NOT_BLANK = tuple((a, min(b, 0x1F)) if b == 0x20 else (a, b) for a, b in WHITESPACE_RANGES)
OTHER_SPACE = "[^" + _complement_class(_NOT_BLANK) + "]"
SPACE_RUN = "(?: |" + OTHER_SPACE + ")" + WS + "+|" + OTHER_SPACE

# Social-text patterns (links, mentions, hashtags, reserved words, emoji,
# smileys, numbers), applied in this order by clean_social.
SOCIAL_PATTERNS = {
    "urls": r"(?:https?://|www\.)" + NON_WS + "+",
    "mentions": r"@[A-Za-z0-9_]+:?",
    "hashtags": r"#[A-Za-z0-9_]+",
    "reserved": "(?:^|" + WS + r")(?:RT|FAV):?(?:" + WS + "|$)",
    "emoji": (r"[\x{1F000}-\x{1F2FF}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}"
              r"\x{FE0F}\x{200D}]"),
    "smileys": r"(?:[:;=8][-o*']?[)(\]\[dDpP/|}{@]|<3)",
    "numbers": "(?:^|" + WS + r")[-+]?[0-9]+(?:[.,][0-9]+)*(?:" + WS + "|$)",
}
SOCIAL_ORDER = ("urls", "mentions", "hashtags", "reserved", "emoji", "smileys", "numbers")
LINK = "http" + NON_WS + "+"
POST_SEPARATOR = r"\|\|\|"
STRICT_KEEP = r"[^a-zA-Z.?!,]"
STRICT_OTHER = r"[^a-zA-Z.?!, ]+"
ISOLATED_LETTER = WS + "+[a-zA-HJ-Z]" + WS + "+"
SENTENCE_END = r"([.?!])"
TRUE_WORDS = ("true", "t", "1", "yes", "y")
FALSE_WORDS = ("false", "f", "0", "no", "n")
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


_COLLAPSE = (SPACE_RUN, " ")


def collapse_ws(col) -> Column:
    return B.replace_all(_c(col), [_COLLAPSE])


def _social_steps(names=SOCIAL_ORDER) -> list[tuple[str, str]]:
    out = []
    for name in names:
        # adjacent hits of these two share a separator
        out += [(SOCIAL_PATTERNS[name], " ")] * (2 if name in ("reserved", "numbers") else 1)
    return [*out, _COLLAPSE, ("", " ")]


def clean_social(col, urls=True, mentions=True, hashtags=True, reserved=True,
                 emoji=True, smileys=True, numbers=True) -> Column:
    """Remove social-media artefacts, one pattern after the other in
    ``SOCIAL_ORDER``; result is whitespace-collapsed and trimmed."""
    flags = dict(urls=urls, mentions=mentions, hashtags=hashtags, reserved=reserved,
                 emoji=emoji, smileys=smileys, numbers=numbers)
    return B.replace_all(_c(col), _social_steps([n for n in SOCIAL_ORDER if flags[n]]))


def clean_text(col, social: bool = True) -> Column:
    """Corpus cleaner: social clean, links -> space, collapse whitespace, then
    the post separator ``|||`` -> one space (after the collapse, so
    ``a ||| b`` keeps three spaces)."""
    steps = [(LINK, " "), _COLLAPSE, (POST_SEPARATOR, " ")]
    return B.replace_all(_c(col), (_social_steps() if social else []) + steps)


# Letters and ``.?!,`` kept, every run of other characters -> one space (blanks
# among them are left in place, so that only the odd ones cost a replacement).
_STRICT_CHARS = [(STRICT_OTHER, " "), (" {2,}", " ")]


def clean_strict(col, social: bool = True) -> Column:
    """Feature cleaner: keep letters and ``.?!,``, drop isolated letters except
    ``I`` (non-overlapping, left to right), collapse whitespace."""
    steps = [(LINK, " "), *_STRICT_CHARS, (ISOLATED_LETTER, " "), _COLLAPSE]
    return B.replace_all(_c(col), (_social_steps() if social else []) + steps)


def keep_strict_chars(col) -> Column:
    """Letters and ``.?!,`` kept, every other run of characters -> one space.

    Same tokens and separators as replacing each other character by a space
    (only whitespace run lengths differ, which the following steps ignore)."""
    return B.replace_all(_c(col), _STRICT_CHARS)


def tokenize_batches(col) -> Column:
    """``tokenize`` over Arrow batches, for kernels that take the tokens on."""
    return B.tokens(_c(col), OTHER_SPACE)


def tokenize(col) -> Column:
    """Whitespace tokens (Python ``str.split()`` semantics), case kept."""
    return F.filter(F.split(_c(col), WS + "+"), lambda t: t != F.lit(""))


def sentence_lines(col) -> Column:
    """Newline after every ``.``, ``?``, ``!``; one array element per line."""
    return F.split(F.regexp_replace(_c(col), SENTENCE_END, "$1\n"), "\n")


def sentences(col) -> Column:
    """Lines holding at least one non-whitespace character."""
    return F.filter(sentence_lines(col), lambda s: F.regexp_like(s, F.lit(NON_WS)))


def parse_bool(col) -> Column:
    """Boolean words -> boolean; anything else raises at run time."""
    low = F.lower(_c(col))
    return (F.when(low.isin(*FALSE_WORDS), F.lit(False))
            .when(low.isin(*TRUE_WORDS), F.lit(True))
            .otherwise(F.raise_error(F.concat(F.lit("neither a yes nor a no word: "),
                                              F.coalesce(_c(col), F.lit("NULL"))))))


def yes_no_flag(col) -> Column:
    """``y`` (any case) -> 1, anything else, NULL included -> 0."""
    return F.when(F.lower(_c(col)) == "y", 1).otherwise(0)


def code_letter_flag(col, position: int, letter: str) -> Column:
    """1 when the letter at 1-based ``position`` equals ``letter`` (case-sensitive)."""
    return F.coalesce((F.substring(_c(col), position, 1) == letter).cast("int"), F.lit(0))


def numeric_or_null(col) -> Column:
    """Numeric coercion: invalid text -> NULL."""
    return _c(col).try_cast("double")


def normalize_author_id(col) -> Column:
    """``'dir\\\\id_12'`` -> 12: drop quotes, keep the last ``\\\\`` component,
    strip ``id_``, cast to bigint (NULL when not a number)."""
    no_quotes = F.regexp_replace(_c(col), "'", "")
    last = F.element_at(F.split(no_quotes, r"\\\\"), -1)
    return F.regexp_replace(last, "id_", "").try_cast("bigint")
