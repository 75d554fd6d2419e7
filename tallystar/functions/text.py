"""String functions as Catalyst expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallystar.schema import FOOTNOTE_MARKS, SUPPRESSION_TOKENS

# --- fixed values: words and phrases the results depend on ---

LOCATION_PREPOSITIONS = [" in ", " for ", " at "]
OCCUPATION_WORDS = [
    "developer", "engineer", "nurse", "teacher", "analyst", "manager", "technician",
    "specialist", "administrator", "designer", "programmer", "scientist", "consultant",
]
SENSITIVE_PARTS = [
    "password", "api_key", "secret", "token", "credential", "postgres://", "mysql://",
    "mongodb://", "://", "bearer ", "authorization", "api-key",
]
MASKED_TEXT = "An internal error occurred during query processing."
ERROR_PREFIX = "Workflow execution failed: "

# --- end of fixed values ---

# Java's \s is ASCII only; (?U) widens it to Unicode white space. The separators 1c..1f count
# as space in the readers these rules come from.
_SPACE = r"(?U)[\s\x1c-\x1f]+"
_SPACE_CHARS = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def strip_space(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE_CHARS))


def normalize_header(name: Column) -> Column:
    """Lower snake-case key of a header; '' for null or empty."""
    no_marks = F.regexp_replace(strip_space(name), "[" + "".join(FOOTNOTE_MARKS) + "]", "")
    joined = F.replace(F.regexp_replace(no_marks, _SPACE, "_"), F.lit("__"), F.lit("_"))
    kept = F.regexp_replace(joined, "[^0-9A-Za-z_]", "")
    return F.coalesce(F.lower(F.btrim(kept, F.lit("_"))), F.lit(""))


def safe_name(name: Column) -> Column:
    """File-system-safe form of a sheet name."""
    cleaned = F.regexp_replace(strip_space(name), r"[^\p{L}\p{N} _-]", "_")
    return F.coalesce(F.nullif(F.replace(cleaned, F.lit(" "), F.lit("_")), F.lit("")), F.lit("sheet"))


def _first_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(20\d{2})", 1), F.lit("")).cast("int")


def detect_year(file_name: Column, parent_path: Column) -> Column:
    """First 20xx in the file name, else in the parent path, else null."""
    return F.coalesce(_first_year(file_name), _first_year(parent_path))


def path_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_parent(path: Column) -> Column:
    return F.left(path, F.length(path) - F.length(path_name(path)) - 1)


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    Inside a lambda an outer expression would be computed again for every element; a lambda
    variable is not.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def suppress_text(value: Column) -> Column:
    """Null where the text is exactly a suppression token."""
    return F.when(~value.isin(*SUPPRESSION_TOKENS), value)


def extract_location(question: Column) -> Column:
    """Place named after the first known preposition, title-cased; null without one."""
    q = F.lower(question)
    found = F.lit(None).cast("string")
    for phrase in reversed(LOCATION_PREPOSITIONS):
        found = F.when(F.contains(q, F.lit(phrase)), F.split_part(q, F.lit(phrase), F.lit(2))).otherwise(found)
    place = F.btrim(found, F.lit(" ?.!,"))
    for cut in (" and", " or"):
        place = F.substring_index(place, cut, 1)
    return title_case(place)


def title_case(text: Column) -> Column:
    """Capital after every non-letter, so "o'brien-smith" becomes "O'Brien-Smith"."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def words_of(text: Column) -> Column:
    """White-space separated words, without empties."""
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def extract_occupation(question: Column) -> Column:
    """First listed keyword's word plus up to two words before it; null without one."""
    q = F.lower(question)
    keyword = F.coalesce(*[F.when(F.contains(q, F.lit(k)), F.lit(k)) for k in OCCUPATION_WORDS])

    def pick(found: Column) -> Column:
        words, at = found["words"], found["at"]
        start = F.greatest(at - 2, F.lit(1))
        return F.when(at > 0, F.array_join(F.slice(words, start.cast("int"), (at - start + 1).cast("int")), " "))

    def place(known: Column) -> Column:
        hits = F.transform(known["words"], lambda w: F.contains(w, known["keyword"]))
        return F.struct(known["words"].alias("words"), F.array_position(hits, True).alias("at"))

    known = F.struct(words_of(q).alias("words"), keyword.alias("keyword"))
    return F.when(keyword.isNotNull(), bind(known, lambda k: bind(place(k), pick)))


def mask_sensitive(message: Column) -> Column:
    """Generic text for messages that mention secrets or addresses, else a bounded excerpt."""
    low = F.lower(message)
    hit = reduce(or_, [F.contains(low, F.lit(part)) for part in SENSITIVE_PARTS])
    cut = F.when(F.length(message) > 200, F.concat(F.left(message, F.lit(200)), F.lit("..."))).otherwise(message)
    return F.when(hit, F.lit(MASKED_TEXT)).otherwise(F.concat(F.lit(ERROR_PREFIX), cut))


def within_length(text: Column, low: int = 3, high: int = 500) -> Column:
    return F.length(text).between(low, high)


def like_pattern(part: Column) -> Column:
    """Pattern that finds ``part`` anywhere; ``%`` and ``_`` stay wildcards, a backslash is an ordinary character."""
    return F.concat(F.lit("%"), F.replace(part, F.lit("\\"), F.lit("\\\\")), F.lit("%"))
