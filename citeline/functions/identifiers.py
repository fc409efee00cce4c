"""Column expressions for codes, display look-alikes, tokens and bracketed labels."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: token and label shapes, look-alike characters, enumeration limit ---
TOKEN = r"[A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*"
LABEL = r"\[([^\[\]\n]{2,60})\]"
LOOKALIKE_FROM = "015"
LOOKALIKE_TO = "OIS"
LOOKALIKE_FREE = 6  # 2^6 = 64 spellings are enumerated; earlier positions must agree exactly
# --- end of fixed values ---

# A whole token that is shaped like a code: it starts where no token can reach back, and somewhere after its first
# character comes a capital, or it starts with a capital and has a digit. Possessive loops keep it linear.
_INNER = r"[.\-](?=[A-Za-z0-9])"
CODE_TOKEN = (
    r"(?<![A-Za-z0-9])(?<![A-Za-z0-9][.\-])"
    rf"(?=[A-Za-z0-9](?:[a-z0-9]++|{_INNER})*+[A-Z]|[A-Z](?:[A-Za-z]++|{_INNER})*+[0-9])"
    r"[A-Za-z0-9]++(?:[.\-][A-Za-z0-9]++)*+"
)

# Texts in which a candidate may be more or less than one run of letters and digits, and the candidates of all other texts.
SPELLED = r"[A-Za-z0-9][.\-][A-Za-z0-9]|(?<![A-Za-z0-9])[A-Za-z]{2,4}[^A-Za-z0-9]++[0-9]{1,2}(?![A-Za-z0-9])"
PLAIN_CANDIDATE = r"(?<![A-Za-z0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{3,6}+(?![A-Za-z0-9])"
CANDIDATE_LENGTHS = (3, 6)

SPACE = r"[\s\x1c-\x1f]"  # used under (?U): Java's Unicode white space plus the four ASCII separators


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def collapse_spaces(text: Column) -> Column:
    """White space runs become one blank; ends trimmed."""
    return F.trim(F.regexp_replace(text, rf"(?U){SPACE}+", " "))


def code_key(code: Column) -> Column:
    """Comparison key of a code: no footnotes, no white space, no trailing dashes (unless nothing else), upper."""
    compact = F.regexp_replace(F.regexp_replace(code, r"(?U)\(\d+\)", ""), rf"(?U){SPACE}+", "")
    full = F.upper(F.regexp_replace(compact, r"^(.*[A-Za-z0-9].*?)[-–—]+$", "$1"))
    # Letters, digits and dots alone have nothing to remove.
    return F.when(code.rlike(r"^[A-Za-z0-9.]+\z"), F.upper(code)).otherwise(full)


def lookalike_key(key: Column) -> Column:
    """Equal for two keys exactly when one is the other or among its enumerated display look-alikes.

    This turns look-alike matching into an equi-join. The enumeration varies the last six look-alike
    positions only, so longer keys carry their leading part unfolded.
    """
    folded = F.translate(key, LOOKALIKE_FROM, LOOKALIKE_TO)
    shape = f"[{LOOKALIKE_FROM}{LOOKALIKE_TO}]"
    other = f"[^{LOOKALIKE_FROM}{LOOKALIKE_TO}]"
    lead = F.regexp_replace(key, rf"(?:{shape}{other}*){{{LOOKALIKE_FREE}}}$", "")
    many = (F.length(key) > LOOKALIKE_FREE) & (F.regexp_count(key, F.lit(shape)) > LOOKALIKE_FREE)
    return F.when(many, F.concat(folded, F.lit("|"), lead)).otherwise(folded)


def token_key(token: Column) -> Column:
    """``code_key`` of a token cut by ``TOKEN``: it has no white space, footnote or trailing dash to remove."""
    return F.upper(token)


def is_code_like(token: Column) -> Column:
    """A token with a capital after its first character, or a capital first and a digit later."""
    return token.rlike(r".[A-Z]|^[A-Z].*[0-9]")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def code_like_tokens(text: Column) -> Column:
    """The code-shaped tokens of a text; only they are cut out, not every word."""
    return F.regexp_extract_all(text, F.lit(CODE_TOKEN), F.lit(0))


def bracket_labels(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(LABEL), F.lit(1)), strip)


def without_labels(text: Column) -> Column:
    return F.regexp_replace(text, LABEL, " ")


def bare_code(text: Column) -> Column:
    """The code of a field that may also carry a bracketed name."""
    return collapse_spaces(without_labels(text))


def label_key(label: Column) -> Column:
    inner = F.regexp_replace(strip(label), r"^[\[\]]+|[\[\]]+$", "")
    return F.lower(collapse_spaces(inner))


def loose_label_key(key: Column) -> Column:
    """A label key whose underscores count as blanks."""
    return F.trim(F.regexp_replace(key, rf"(?U)(?:{SPACE}|_)+", " "))


def same_text_key(text: Column) -> Column:
    """Texts that differ in white space, case or closing punctuation only share this key."""
    return F.lower(F.regexp_replace(collapse_spaces(text), r"^[ .;:!]+|[ .;:!]+$", ""))


def query_code_candidates(text: Column) -> Column:
    """Ordered distinct strings of a question that may be typed codes (3-6 characters, a letter among them).

    Most texts have no joined token and no letters followed by a short number; their candidates are cut out by one pattern.
    """
    plain = F.array_distinct(F.regexp_extract_all(text, F.lit(PLAIN_CANDIDATE), F.lit(0)))
    return F.when(text.rlike(SPELLED), _spelled_candidates(text)).otherwise(plain)


def _spelled_candidates(text: Column) -> Column:
    toks = tokens(text)
    none = F.array().cast("array<string>")

    def spellings(token: Column, following: Column) -> Column:
        parts = F.when(F.contains(token, F.lit("-")), F.split(token, "-")).otherwise(none)
        spaced = token.rlike("^[A-Za-z]{2,4}$") & following.rlike("^[0-9]{1,2}$")
        return F.concat(
            F.array(token), parts, F.when(spaced, F.array(F.concat(token, following))).otherwise(none)
        )

    following = F.slice(toks, F.lit(2), F.size(toks))
    found = F.array_distinct(F.flatten(F.zip_with(toks, following, spellings)))
    return F.filter(found, lambda c: F.length(c).between(*CANDIDATE_LENGTHS) & c.rlike("[A-Za-z]"))


def reads_like_display(token: Column) -> Column:
    """Has a digit, or letters that are all capitals."""
    return token.rlike("[0-9]") | (token.rlike("[A-Z]") & ~token.rlike("[a-z]"))


def words(text: Column) -> Column:
    """Lower-case ASCII words."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
