"""Text expressions as Spark SQL fragments. Every builder takes and returns SQL text, so a plan for hundreds of
columns is a few strings rather than thousands of Python-to-JVM calls; Catalyst sees ordinary built-ins."""

from __future__ import annotations

from quern.functions.names import text

# The whitespace characters that trimming removes.
WHITESPACE = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
    0x205F, 0x3000,
)))
# Placeholder words that mean "no value" once trimmed and case-folded.
MISSING_TOKENS = (
    "", "?", "-", "--", "na", "n/a", "nan", "null", "none", "nil",
    "missing", "unknown", "undefined", "#n/a", "#null!", "#value!",
)
# Fixed values: (positive, negative) words of a yes/no column.
BOOLEAN_PAIRS = (("yes", "no"), ("y", "n"), ("true", "false"), ("t", "f"))
# Words read as 1 or 0 when a two-valued column is encoded.
POSITIVE_WORDS = ("yes", "y", "true", "t", "1", "positive", "pass")
NEGATIVE_WORDS = ("no", "n", "false", "f", "0", "negative", "fail")
# Currency signs removed from numbers written as text.
CURRENCY = "$€£₹¥"
# Fixed value: a run of whitespace, Unicode classes on (Java syntax).
INNER_SPACE = r"(?U)[\s\x1c-\x1f]+"
# Text forms of a number, and of a number with well-formed thousands separators.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
THOUSANDS_PATTERN = r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"


def strip(c: str) -> str:
    """Trim all Unicode whitespace (plain trim() removes the space character only). Text that starts and ends with a
    printable ASCII character, nearly all of it, skips the slow trim by two byte comparisons."""
    return (f"CASE WHEN {c} >= '!' AND {c} < {text(chr(127))} AND substring({c}, -1, 1) BETWEEN '!' AND '~' THEN {c} "
            f"ELSE btrim({c}, {text(WHITESPACE)}) END")


def has_space(c: str) -> str:
    return (f"({c} RLIKE {text(chr(92) + 's')} OR (octet_length({c}) > length({c}) "
            f"AND {c} RLIKE {text('(?U)' + chr(92) + 's')}))")


def fold(c: str) -> str:
    """Case-fold: upper then lower, which also brings sharp s and long s to their folded form."""
    return f"lower(upper({c}))"


def folded(c: str) -> str:
    return fold(strip(c))


def collapse(c: str) -> str:
    """Trim, and turn every inner run of whitespace into one space."""
    return f"regexp_replace({strip(c)}, {text(INNER_SPACE)}, ' ')"


def in_words(c: str, words) -> str:
    return f"{c} IN ({', '.join(text(w) for w in words)})"


def is_accounting(stripped: str) -> str:
    return f"({stripped} LIKE '(%)')"


def bare_number(s: str) -> str:
    """Layer 1 of number parsing, on trimmed text: brackets, currency signs, spaces and one trailing % removed.
    Accounting brackets leave the marker `n` in front. Text that starts with an ASCII letter is rejected by a byte
    comparison before any pattern runs, so the marker cannot be confused with data."""
    def clean(t: str) -> str:
        return f"regexp_replace(translate({t}, {text(CURRENCY + WHITESPACE)}, ''), '%$', '')"
    inner = f"substring({s}, 2, length({s}) - 2)"
    return (f"CASE WHEN {s} >= ':' AND {s} < {text(chr(127))} THEN NULL "
            f"WHEN {is_accounting(s)} THEN concat('n', {clean(inner)}) ELSE {clean(s)} END")


def bare_digits(b: str) -> str:
    """Layer 2: commas go, but only from well-formed thousands; other text with commas is no number."""
    return (f"CASE WHEN contains({b}, ',') THEN CASE WHEN {b} RLIKE {text('^n?' + THOUSANDS_PATTERN[1:])} "
            f"THEN replace({b}, ',', '') END ELSE {b} END")


def signed_number(d: str) -> str:
    """Layer 3: double value. The pattern guard is needed: a bare cast accepts Java suffixes such as 1d or 1.5f."""
    return (f"CASE WHEN {d} RLIKE {text('^n?' + NUMBER_PATTERN[1:])} THEN "
            f"CASE WHEN {d} LIKE 'n%' THEN -try_cast(substring({d}, 2) AS double) "
            f"ELSE try_cast({d} AS double) END END")


# Number written as text -> double, NULL where it is not one or not finite: apply the layers in order, each as its own
# projection, so that no layer is pasted into the next one several times.
def number_layers():
    return (strip, bare_number, bare_digits, signed_number, finite)


def finite(c: str) -> str:
    """NaN and +/-infinity become NULL."""
    return f"CASE WHEN NOT isnan({c}) AND abs({c}) < double('Infinity') THEN {c} END"


def is_infinite(c: str) -> str:
    return f"(abs({c}) = double('Infinity'))"


def case_map(c: str, mapping: dict, otherwise: str = "NULL") -> str:
    """CASE expression for a small literal mapping of text keys to SQL values."""
    if not mapping:
        return otherwise
    arms = " ".join(f"WHEN {text(k)} THEN {v}" for k, v in mapping.items())
    return f"CASE {c} {arms} ELSE {otherwise} END"
