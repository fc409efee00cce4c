"""Scripts, sentences and protected-span masking as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeline.functions.identifiers import CODE_TOKEN, LABEL, TOKEN, code_key, is_code_like, strip

# --- Fixed values: script blocks, sentence ends, marker alphabet, protected spans, spelled letters ---
SCRIPTS = (("hi", r"[ऀ-ॿ]"), ("ta", r"[஀-௿]"))
DEFAULT_SCRIPT = "en"
SENTENCE_END = r"(?U)(?<=[.!?।])[\s\x1c-\x1f]+|\n+"
MARKER_PREFIX = "ZQ"
MARKER_LETTERS = "ABCDEFGHIJKLMNOP"
MARKER = MARKER_PREFIX + "[A-P]+"
PAGE_REFERENCE = r"(?U)\bpp?\.\s?\d+(?:\s?[-–]\s?\d+)?"
UNITS = (
    "%", "°C", "°F", "minutes?", "mins?", "seconds?", "hours?", "ms", "s", "h", "Vdc", "VDC", "Vac", "VAC",
    "kV", "V", "mA", "A", "kHz", "Hz", "kW", "W", "ohms?", "Ω", "rpm", "mm", "m",
)
QUANTITY = (
    r"(?U)(?=\d)(?<![\w.])(?<![A-Za-z]-)\d+(?:[.,]\d+)?(?:\s?(?:" + "|".join(UNITS) + r")(?![A-Za-z]))?"
)
SPELLED_PREFIX = r"(?U)जेड\.?\s*क्यू\.?\s*"
SPELLED_LETTERS = {
    "ए": "A", "बी": "B", "सी": "C", "डी": "D", "ई": "E", "एफ": "F", "जी": "G", "एच": "H",
    "आई": "I", "जे": "J", "के": "K", "एल": "L", "एम": "M", "एन": "N", "ओ": "O", "पी": "P",
}
# --- end of fixed values ---

HEX = "0123456789ABCDEF"
HOLE = "￿"  # a Unicode non-character: stands for a protected token until it is numbered
# A word in which the text itself writes a marker, and the letters behind a span that its marker would run into.
OWN_MARKER = rf"(?<![A-Za-z0-9])[A-Za-z0-9]*{MARKER_PREFIX}[A-P][A-Za-z0-9]*"
RUN_ON = r"(?:[A-P][A-Za-z0-9]*)?"


def detect_script(text: Column, scripts=SCRIPTS, default: str = DEFAULT_SCRIPT) -> Column:
    """The script with most characters; earlier scripts win ties; the default when none occurs."""
    counts = [F.regexp_count(text, F.lit(block)) for _, block in scripts]
    best = F.greatest(*counts) if len(counts) > 1 else counts[0]
    result = F.when(best == 0, F.lit(default))
    for (name, _), count in zip(scripts, counts):
        result = result.when(count == best, F.lit(name))
    return result


def split_sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, SENTENCE_END, -1), strip)
    return F.filter(parts, lambda part: part != "")


def marker(index: Column) -> Column:
    """Markers count in base 16 with the letters A-P as digits."""
    return F.concat(F.lit(MARKER_PREFIX), F.translate(F.hex(index.cast("long")), HEX, MARKER_LETTERS))


def marker_index(mark: Column) -> Column:
    digits = F.translate(F.substring(mark, len(MARKER_PREFIX) + 1, 64), MARKER_LETTERS, HEX)
    return F.conv(digits, 16, 10).cast("int")


def _interleave(gaps: Column, fillers: Column) -> Column:
    joined = F.zip_with(gaps, fillers, lambda gap, filler: F.concat(gap, F.coalesce(filler, F.lit(""))))
    return F.array_join(joined, "")


def _number_spans(pattern: str):
    """A step that replaces every match by the next marker and remembers the matched text."""

    def step(state: Column) -> Column:
        masked, kept = state["masked"], state["kept"]
        found = F.regexp_extract_all(masked, F.lit(pattern), F.lit(0))
        marks = F.transform(found, lambda _, i: marker(F.size(kept) + i))
        return F.struct(
            _interleave(F.split(masked, pattern, -1), marks).alias("masked"), F.concat(kept, found).alias("kept")
        )

    return step


def _apply(value: Column, step) -> Column:
    """Evaluate ``step`` on a value that is computed once (a one-element transform acts as a let binding)."""
    return F.transform(F.array(value), step)[0]


def _number_codes(state: Column, keys: Column | None) -> Column:
    masked, kept = state["masked"], state["kept"]
    # Without listed codes only code-shaped tokens matter, and few tokens are.
    shape = CODE_TOKEN if keys is None else TOKEN

    def protects(token: Column) -> Column:
        unmarked = ~token.rlike(MARKER)
        if keys is None:
            return unmarked
        listed = F.coalesce(F.array_contains(keys, code_key(token)), F.lit(False))
        return (is_code_like(token) | listed) & unmarked

    def numbered(parts: Column) -> Column:
        gaps, found = parts["gaps"], parts["found"]
        holes = F.transform(found, lambda t: F.when(protects(t), F.lit(HOLE)).otherwise(t))
        protected = F.filter(found, protects)
        marks = F.transform(protected, lambda _, i: marker(F.size(kept) + i))
        return F.struct(
            _interleave(F.split(_interleave(gaps, holes), HOLE, -1), marks).alias("masked"),
            F.concat(kept, protected).alias("kept"),
        )

    parts = F.struct(
        F.split(masked, shape, -1).alias("gaps"),
        F.regexp_extract_all(masked, F.lit(shape), F.lit(0)).alias("found"),
    )
    return _apply(parts, numbered)


def mask_spans(text: Column, code_keys: Column | None = None) -> Column:
    """struct(masked, kept): labels, page references, quantities, then codes become numbered markers.

    Words that hold a marker of their own are protected with the labels, before the first marker is written; letters that a
    marker would run into belong to its span. So every text is restored, whatever it contains.

    ``code_keys`` is an array of code keys that are protected in any case. Every step is linear in the text.
    """
    state = F.struct(text.alias("masked"), F.array().cast("array<string>").alias("kept"))
    for pattern in (f"{LABEL}{RUN_ON}|{OWN_MARKER}", PAGE_REFERENCE + RUN_ON, QUANTITY + RUN_ON, HOLE + RUN_ON):  # a text's own U+FFFF is kept like a protected span
        state = _apply(state, _number_spans(pattern))
    return _apply(state, lambda s: _number_codes(s, code_keys))


def markers_for(kept: Column) -> Column:
    return F.transform(kept, lambda _, i: marker(i))


def restore_spans(translated: Column, kept: Column) -> Column:
    """The kept texts back in place of their markers; NULL when a marker was lost, doubled or invented."""

    def put_back(pair: Column) -> Column:
        text, originals = pair["text"], pair["originals"]
        found = F.regexp_extract_all(text, F.lit(MARKER), F.lit(0))
        intact = F.sort_array(found) == F.sort_array(markers_for(originals))
        texts = F.transform(found, lambda m: F.get(originals, marker_index(m)))
        return F.when(intact, _interleave(F.split(text, MARKER, -1), texts))

    return _apply(F.struct(translated.alias("text"), kept.alias("originals")), put_back)


def unspell_markers(text: Column) -> Column:
    """Markers a translation spelled out letter by letter, written as markers again; longest names first."""
    for name in sorted(SPELLED_LETTERS, key=len, reverse=True):
        text = F.regexp_replace(text, SPELLED_PREFIX + name + r"\.?", MARKER_PREFIX + SPELLED_LETTERS[name])
    return text


def runs(found: Column) -> Column:
    """(value, n) of the distinct values of an array, ascending, in the time of its sort; NULL or empty gives NULL."""
    def cut(w: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        # ``transform`` over a single cell gives the array a name, so it is computed once a row.
        return F.get(F.transform(F.array(opens), lambda at: F.transform(
            at, lambda a, nth: F.struct(F.get(w, a).alias("value"), (F.coalesce(F.get(at, nth + 1), F.size(w)) - a).cast("long").alias("n"))
        )), F.lit(0))

    return F.get(F.transform(F.array(F.sort_array(found)), lambda w: F.when(F.size(w) > 0, cut(w))), F.lit(0))


def fixed(value: Column, digits: int) -> Column:
    """A number with ``digits`` decimals as C and Python print it: the exact binary value decides, exact ties go to the even digit.

    Java's formatter rounds the shortest decimal spelling half up: 0.285, which lies below the tie, becomes 0.29 there. Split in
    a high and a low half, the value times the scale is exact, so the sign of its distance from the tie is right.
    """
    scale = 10.0**digits
    size = F.abs(value.cast("double"))
    wide = size * 134217729.0
    high = wide - (wide - size)
    low = size - high
    below = F.floor(size * scale)
    over = (high * scale - (below + 0.5)) + low * scale
    units = below + F.when((over > 0) | ((over == 0) & (below % 2 == 1)), 1).otherwise(0)
    whole, rest = F.floor(units / scale), units % int(scale)
    text = F.concat(
        F.when(value < 0, F.lit("-")).otherwise(F.lit("")), whole.cast("string"), F.lit("."), F.lpad(rest.cast("string"), digits, "0")
    )
    # Beyond that every double is a multiple of the last digit's half, or not a number.
    return F.when(size * scale < 2.0**52, text).otherwise(F.format_string(f"%.{digits}f", value.cast("double")))
