"""String scalars as Column expressions (JVM side, no UDF).

Every function here takes and returns a ``Column`` so that it stays inside
whole-stage code generation and composes with any projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES - must equal the reference for identical output.
# Month names and abbreviations, rewritten to their two-digit number in this
# order (so "may" becomes "05" before the number rule turns it into NUM).
MONTHS = [
    ("january", "jan"), ("february", "feb"), ("march", "mar"),
    ("april", "apr"), ("may", "may"), ("june", "jun"), ("july", "jul"),
    ("august", "aug"), ("september", "sep"), ("october", "oct"),
    ("november", "nov"), ("december", "dec"),
]
# Typed rewrites of the normaliser, applied in this order after the months.
TOKEN_DATE = (r"([0-9]{1,2})?[\.\/\- ][0-9]{1,2}(st|nd|rd|th)?[\.\/\- ][0-9]{4}|"
              r"[0-9]{4}[\.\/\- ][0-9]{1,2}(st|nd|rd|th)?[\.\/\- ]([0-9]{1,2})?|"
              r"[0-9]{1,2}(st|nd|rd|th)?[\/\- ][0-9]{1,2}|"
              r"[0-9]{1,2}[\/\- ][0-9]{1,2}(st|nd|rd|th)?")
TOKEN_YEAR = r"(19|20)\d{2}"
TOKEN_TIME = r"[0-2]?[0-9]:[0-5][0-9][ \-]?(am|pm)?"
TOKEN_MONEY = r"\$[ \-]?\d+(\,\d+)?\.?\d+"
TOKEN_PERCENT = r"[-+]?\d+(\,\d+)?(\.\d+)?[ \-]?\%"
TOKEN_METRIC = r"\d+ ?(ml|cc|l)"
TOKEN_NUMBER = r"[-+]?\d+(\,\d+)?(\.\d+)?( \d+)?(stz|nd|rd|th)?"
TOKEN_EMAIL = (r"[_a-z0-9-]+(\.[_a-z0-9-]+)*@[a-z0-9-]+"
               r"(\.[a-z0-9-]+)*\.(([0-9]{1,3})|([a-z]{2,3})|(aero|coop|info|museum|name))")
TYPED_REWRITES = [
    (TOKEN_DATE, " DATE "), (TOKEN_YEAR, " DATE "), (TOKEN_TIME, " TIME "),
    (TOKEN_MONEY, " MONEY "), (TOKEN_PERCENT, " PRESENT "), (TOKEN_METRIC, " MTC "),
    (TOKEN_NUMBER, " NUM "), (TOKEN_EMAIL, " EMAIL "), (r" +", " "), (r" +", " "),
]
# Symbol cleaner: apostrophe gets a space before it, these symbols become a
# space, "@" becomes " at ", spaces squeeze, quotes/spaces trimmed at both ends.
SYM_APOSTROPHE = r"(\')"
SYM_SPACE = r"(\.|\?|\$|\#|\&|\,|\!|\;|\`|\~|\"|\\|\:|\+|\-|\*|\/)"
SYM_AT = r"\@"
SYM_LEADING = r"^[\' ]+"
SYM_TRAILING = r"[\' ]+$"
# What ends as one blank: the symbols and blanks of a run.
SYM_RUN = r"[ .?$#&,!;`~\"\\:+\-*/]+"
# Literal clean-up used when paraphrase questions are generated.
QUOTE_PAIR = " ' ' "
# ---------------------------------------------------------------------------

_WS_EDGES = r"^\s+|\s+$"
#: What ``\s`` stands for, and last characters that ``$`` takes for a line end and ``\s`` not for a blank.
_WS, _ENDS = " \t\n\x0b\f\r", ("\u0085", "\u2028", "\u2029")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(expr: Column, fn) -> Column:
    """Evaluate ``expr`` once and hand it to ``fn`` as a lambda variable.

    Column functions that use their input several times would otherwise
    repeat the whole upstream expression once Catalyst inlines projections
    (it does so beneath generators such as ``explode``)."""
    return F.element_at(F.transform(F.array(expr), fn), 1)


def strip(col) -> Column:
    """Whitespace strip at both ends (``str.strip``); only a text whose last character is a line end of its own
    needs the regular expression, which trims the blanks before it."""
    def body(c):
        ended = c.endswith(_ENDS[0]) | c.endswith(_ENDS[1]) | c.endswith(_ENDS[2])
        return F.when(ended, F.regexp_replace(c, _WS_EDGES, "")).otherwise(F.btrim(c, F.lit(_WS)))
    return let(_c(col), body)


def rstrip(col) -> Column:
    return F.regexp_replace(_c(col), r"\s+$", "")


def _months(s: Column) -> Column:
    for i, (name, abbr) in enumerate(MONTHS):
        s = F.regexp_replace(s, rf"\b{name}\b|\b{abbr}\b", "%02d" % (i + 1))
    return s


#: What a text must hold for a rule to find anything: most texts skip most passes (same result).
_NEEDS = {TOKEN_YEAR: ("19", "20"), TOKEN_TIME: (":",), TOKEN_MONEY: ("$",), TOKEN_PERCENT: ("%",), TOKEN_EMAIL: ("@",),
          r" +": ("  ",)}


def _rewrite(s: Column, pattern: str, token: str) -> Column:
    def body(x):
        held = None
        for part in _NEEDS[pattern]:
            held = x.contains(part) if held is None else held | x.contains(part)
        return F.when(held, F.regexp_replace(x, pattern, token)).otherwise(x)
    return let(s, body) if pattern in _NEEDS else F.regexp_replace(s, pattern, token)


def _rewrites(s: Column, rules) -> Column:
    for pattern, token in rules:
        s = _rewrite(s, pattern, token)
    return s


# Every month name contains its abbreviation, and every typed rewrite before
# EMAIL needs a digit: texts without them skip those passes (same result).
_MONTH_HINT = "|".join(abbr for _, abbr in MONTHS)
_NUMERIC = TYPED_REWRITES[:7]
_TAIL = TYPED_REWRITES[7:]


def tokenize(col) -> Column:
    """Normalise a sentence: all-upper text is kept; otherwise lower-case,
    months to numbers, then DATE/TIME/MONEY/PRESENT/MTC/NUM/EMAIL tokens."""
    def body(c):
        low = F.lower(c)
        m = let(low, lambda x: F.when(x.rlike(_MONTH_HINT), _months(x)).otherwise(x))
        n = let(m, lambda x: F.when(x.rlike("[0-9]"), _rewrites(x, _NUMERIC)).otherwise(x))
        return F.when(F.upper(c) == c, c).otherwise(strip(_rewrites(n, _TAIL)))
    return let(_c(col), body)


def no_symbol(col) -> Column:
    """Remove punctuation: the symbol cleaner of the pipeline."""
    # The apostrophe and at rules replace literally; symbols and squeezing are one scan over
    # runs, since a run of symbols and blanks ends as one blank.
    s = F.replace(F.replace(_c(col), F.lit("'"), F.lit(" '")), F.lit("@"), F.lit(" at "))
    s = F.regexp_replace(s, SYM_RUN, " ")
    s = F.regexp_replace(s, SYM_LEADING, "")
    s = F.regexp_replace(s, SYM_TRAILING, "")
    return strip(s)


def split_ws(col) -> Column:
    """``str.split()``: split on whitespace runs, no empty tokens."""
    return F.filter(F.split(_c(col), r"\s+"), lambda x: x != F.lit(""))


def split_joined(col) -> Column:
    """The words of a text that joins them by single blanks: :func:`split_ws` of it, without a regular expression."""
    c = _c(col)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def ngrams(tokens, n: int) -> Column:
    """Space-joined n-grams of a token array (the array itself for n=1)."""
    if n <= 1:
        return _c(tokens)

    def body(t):
        grams = F.transform(F.sequence(F.lit(1), F.size(t) - F.lit(n - 1)),
                            lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))
    return let(_c(tokens), body)


def capitalize(col) -> Column:
    """``str.capitalize``: first character upper, the rest lower."""
    return let(_c(col), lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30))))


def clean_question(col) -> Column:
    """Paraphrase-question clean-up: symbols out, quote pairs folded, capitalised."""
    s = no_symbol(col)
    s = F.replace(s, F.lit(QUOTE_PAIR), F.lit(" "))
    return capitalize(s)


def answer_tokens(col) -> Column:
    """Split an ``e1|r|e2`` answer on ``|`` and concatenate the token lists."""
    parts = F.split(_c(col), r"\|")
    return F.flatten(F.transform(parts, lambda p: split_ws(p)))


def vec_to_text(col, sep: str = "|") -> Column:
    return F.array_join(F.transform(_c(col), lambda x: x.cast("string")), sep)


def text_to_vec(col, sep: str = r"\|") -> Column:
    return F.transform(F.split(_c(col), sep), lambda x: x.cast("double"))
