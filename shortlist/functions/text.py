"""Column functions that turn raw document text into structured fields.

Every function takes and returns a ``Column`` built only from built-in Spark
expressions, so a whole extraction is one codegen'd projection with no Python
worker.  The patterns are written with an explicit whitespace class instead of
``\\s`` because Java's and RE2's ``\\s`` are ASCII-only while the rules they
reproduce treat all Unicode whitespace (including U+001C..U+001F) as space.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's for identical results.
# ---------------------------------------------------------------------------

# Unicode whitespace (what Python's str ``\s`` matches), as character-class
# contents usable by both java.util.regex and RE2.
WS = (r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")

# The same characters, for trim(): the whitespace str.strip() removes.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
            "\u2028\u2029\u202f\u205f\u3000")
# The extraction patterns for java.util.regex / RE2: ``\s`` spelled as WS,
# ``\d`` as [0-9] (ASCII digits), case-insensitivity as an inline (?i).
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE_PATTERN = rf"(\+?[0-9][0-9{WS}\-\(\)]{{7,}}[0-9])"
PHONE_STRIP_PATTERN = rf"[{WS}\-\(\)]"
PHONE_MIN_DIGITS = 8
PHONE_MAX_DIGITS = 15
EXPERIENCE_PATTERNS = (
    rf"(?i)([0-9]+)[{WS}]*\+?[{WS}]*(?:years?|yrs?)[{WS}]+(?:of[{WS}]+)?experience",
    rf"(?i)experience[:{WS}]+([0-9]+)[{WS}]*\+?[{WS}]*(?:years?|yrs?)",
    rf"(?i)([0-9]+)[{WS}]*\+[{WS}]*(?:years?|yrs?)",
)
# Java-tuned spellings used on the Spark side.  They match exactly what the
# patterns above match (checked in tests/test_text.py); only the work per
# character differs:
# * the whitespace class is intersected with two coarse ranges, so an ASCII
#   letter fails after two range checks instead of one per class member;
# * an e-mail can only start where a run of local-part characters starts (a
#   match starting inside a run would also match from the run's start), so
#   the lookbehind skips every other start position that would rescan the run.
#   Neither part holds an '@', so what is before the run that leads to the
#   first '@' is not scanned at all;
# * a phone number starts with a digit or plus, tested before any group;
# * a run that is one U+0020 stays as it is, without being replaced by itself;
# * "not printable ASCII" is spelled as the two ranges of its complement over
#   all code points; java.util.regex runs the negated class ``[^\x20-\x7E]``
#   about twice as slowly on the whitespace-collapsed text.
WS_CLASS = rf"[\t-\x20\x{{85}}-\x{{3000}}&&[{WS}]]"
NON_PRINTABLE_PATTERN = r"[\x00-\x1f\x7f-\x{10ffff}]"
WS_RUN_PATTERN = rf"(?:[\t-\x1f\x{{85}}-\x{{3000}}&&[{WS}]]{WS_CLASS}*+| {WS_CLASS}++)"   # all runs but a single U+0020
EMAIL_LOCAL = "[a-zA-Z0-9._%+-]"
EMAIL_SCAN_PATTERN = rf"(?<!{EMAIL_LOCAL})" + EMAIL_PATTERN
PHONE_SCAN_PATTERN = "(?=[+0-9])" + PHONE_PATTERN
MIN_TEXT_CHARS = 50
SKILLS_VOCAB = (
    "python", "java", "javascript", "typescript", "c++", "c#", "go", "rust",
    "sql", "nosql", "mongodb", "postgresql", "mysql", "redis",
    "machine learning", "deep learning", "nlp", "computer vision",
    "tensorflow", "pytorch", "scikit-learn", "keras", "pandas", "numpy",
    "aws", "azure", "gcp", "docker", "kubernetes", "terraform",
    "react", "angular", "vue", "node.js", "django", "flask", "fastapi",
    "git", "linux", "bash", "ci/cd", "agile", "scrum",
    "tableau", "power bi", "excel", "spark", "hadoop", "kafka",
    "data analysis", "data science", "statistics", "etl",
)
SKILLS_SEPARATOR = ", "
RESUME_ID_FORMAT = "R%04d"
DEFAULT_EXTENSIONS = (".pdf",)
SKIPPED_PREFIX = "__MACOSX"

# ---------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(text: Column | str) -> Column:
    """Remove leading and trailing Unicode whitespace (plain ``trim`` only strips U+0020).

    ``trim`` with an explicit character set touches only the two ends, unlike
    an end-anchored regex that is retried at every whitespace run.
    """
    return F.trim(_col(text), F.lit(WS_CHARS))


def stripped_length(text: Column | str) -> Column:
    """Number of code points after stripping Unicode whitespace."""
    return F.length(strip_ws(text))


def long_enough(text: Column | str, min_chars: int = MIN_TEXT_CHARS) -> Column:
    """Minimum-length gate: non-null, non-empty and >= ``min_chars`` after strip."""
    t = _col(text)
    return t.isNotNull() & (stripped_length(t) >= F.lit(min_chars))


def clean_text(text: Column | str) -> Column:
    """Collapse whitespace runs, blank out every char outside 0x20..0x7E, strip.

    Non-ASCII characters become one space each and are not re-collapsed.
    After the two replacements only U+0020 can be whitespace, so ``trim``
    is an exact strip here.
    """
    t = F.regexp_replace(_col(text), WS_RUN_PATTERN, " ")
    t = F.regexp_replace(t, NON_PRINTABLE_PATTERN, " ")
    return F.trim(t)


def extract_email(text: Column | str) -> Column:
    """First e-mail address, lower-cased; '' when there is none."""
    t = _col(text)
    before = F.substring_index(t, "@", 1)
    run = F.reverse(F.regexp_extract(F.reverse(before), f"^{EMAIL_LOCAL}*", 0))
    rest = F.concat(run, F.substr(t, F.length(before) + 1))
    return F.lower(F.regexp_extract(rest, EMAIL_SCAN_PATTERN, 0))


def extract_phone(text: Column | str) -> Column:
    """First phone-like run with separators removed if it has 8..15 digits, else ''.

    Only the first candidate is considered (no retry on a later one).
    """
    candidate = F.regexp_replace(F.regexp_extract(_col(text), PHONE_SCAN_PATTERN, 1),
                                 PHONE_STRIP_PATTERN, "")
    digits = F.length(F.regexp_replace(candidate, "[^0-9]", ""))
    return F.when(digits.between(PHONE_MIN_DIGITS, PHONE_MAX_DIGITS), candidate) \
            .otherwise(F.lit(""))


def experience_mentions(text: Column | str, kind: str = "array<bigint>") -> Column:
    """All years numbers captured by the experience patterns, as ``kind``."""
    t = _col(text)
    found = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in EXPERIENCE_PATTERNS])
    # try_cast: a number beyond ``kind`` becomes a null element, ignored by
    # array_max.  Casting the whole array stays in codegen (a transform lambda
    # would not).
    return found.try_cast(kind)


def extract_experience(text: Column | str) -> Column:
    """Largest years-of-experience number mentioned, 0 when none.

    A number beyond BIGINT counts as the largest BIGINT.
    """
    top = F.lit(2 ** 63 - 1).cast("bigint")
    doubles = F.array_max(experience_mentions(text, "array<double>"))
    whole = F.when(doubles >= F.lit(float(2 ** 63)), top).otherwise(
        F.coalesce(F.array_max(experience_mentions(text)), F.lit(0).cast("bigint")))
    # Up to 15 digits the double is exact, and the patterns run once; only a larger number takes the other way.
    return F.coalesce(F.coalesce(doubles, F.lit(0.0)).try_cast("decimal(15,0)").cast("bigint"), whole)


def sorted_vocab(vocab: Iterable[str] = SKILLS_VOCAB) -> list[str]:
    """Vocabulary in code-point order, the order skills are reported in."""
    return sorted(set(vocab))


def _skill_hits(low: Column, entries: Sequence[str]) -> list[Column]:
    """One ``CASE WHEN contains(low, entry) THEN entry END`` per entry.

    Plain conditional expressions stay inside whole-stage codegen, where
    ``low`` (usually ``lower(text)``) is a common subexpression evaluated
    once per row.  A higher-order ``filter`` over the vocabulary would run
    interpreted and re-evaluate ``low`` for every entry.
    """
    return [F.when(F.contains(low, F.lit(s)), F.lit(s)) for s in entries]


def _lowered(text: Column | str, lowered: Column | str | None) -> Column:
    return F.lower(_col(text)) if lowered is None else _col(lowered)


def skills_joined(text: Column | str, vocab: Sequence[str] = SKILLS_VOCAB,
                  lowered: Column | str | None = None, sep: str = SKILLS_SEPARATOR) -> Column:
    """Vocabulary entries contained in the lower-cased text, joined by ``sep``
    in code-point order ('' when none): the display form of ``extract_skills``."""
    entries = sorted_vocab(vocab)
    if not entries:
        return F.lit("")
    return F.concat_ws(sep, *_skill_hits(_lowered(text, lowered), entries))


# Joins the hits before they are split back into an array; a character no
# vocabulary entry contains.
_HIT_SEP = "\x00"


def extract_skills(text: Column | str, vocab: Sequence[str] = SKILLS_VOCAB,
                   lowered: Column | str | None = None) -> Column:
    """Vocabulary entries that occur as substrings of the lower-cased text.

    Entries are tested in code-point order, so the result is already sorted.
    Pass ``lowered`` (a column already holding ``lower(text)``) to share the
    lower-casing with other expressions.  The hits are joined and split
    again so that every step is a codegen'd expression; a vocabulary with an
    empty entry or one containing the join character takes the (slower)
    higher-order filter instead, which represents those exactly.
    """
    entries = sorted_vocab(vocab)
    if not entries:
        return F.array().cast("array<string>")
    low = _lowered(text, lowered)
    if "" in entries or any(_HIT_SEP in s for s in entries):
        return F.filter(F.array(*[F.lit(s) for s in entries]), lambda s: F.contains(low, s))
    # No entry is empty here, so an empty element can only come from splitting
    # an empty join (no hit).
    return F.array_remove(F.split(F.concat_ws(_HIT_SEP, *_skill_hits(low, entries)), _HIT_SEP), "")


def skills_list(skills: Column | str) -> Column:
    """ARRAY<STRING> → the ', '-joined display string."""
    return F.array_join(_col(skills), SKILLS_SEPARATOR)


def split_skill_list(skills_list_col: Column | str) -> Column:
    """A ', '-joined skill string → lower-cased, stripped, non-blank tokens."""
    parts = F.split(_col(skills_list_col), ",")
    return F.filter(F.transform(parts, lambda s: F.lower(strip_ws(s))), lambda s: s != F.lit(""))


def resume_id(ordinal: Column | str) -> Column:
    """R + ordinal zero-padded to at least 4 digits (never truncated)."""
    return F.format_string(RESUME_ID_FORMAT, _col(ordinal))


def basename(name: Column | str) -> Column:
    """Last path component of an archive member name."""
    return F.substring_index(_col(name), "/", -1)


def entry_selected(name: Column | str, extensions: Sequence[str] = DEFAULT_EXTENSIONS,
                   skipped_prefix: str = SKIPPED_PREFIX) -> Column:
    """Archive-member filter: extension matches case-insensitively and the
    name does not start with the resource-fork folder prefix."""
    n = _col(name)
    lowered = F.lower(n)
    ext_ok = F.lit(False)
    for ext in extensions:
        ext_ok = ext_ok | F.endswith(lowered, F.lit(ext.lower()))
    return ext_ok & ~F.startswith(n, F.lit(skipped_prefix))


def parse_skill_input(items: Column | str) -> tuple[Column, Column]:
    """Criteria skills ARRAY<STRING> → (required, mandatory) arrays.

    Items are stripped; a leading '!' marks a mandatory skill, which is
    stripped again and appears in both lists.  Order and spelling are kept.
    """
    stripped = F.transform(_col(items), lambda s: strip_ws(s))
    required = F.transform(stripped, lambda s: F.when(F.startswith(s, F.lit("!")),
                                                      strip_ws(F.substring(s, 2, 1 << 30)))
                                               .otherwise(s))
    mandatory = F.transform(F.filter(stripped, lambda s: F.startswith(s, F.lit("!"))),
                            lambda s: strip_ws(F.substring(s, 2, 1 << 30)))
    return required, mandatory


def parse_skill_text(text: Column | str) -> Column:
    """A comma-separated skills input → stripped, non-blank items."""
    return F.filter(F.transform(F.split(_col(text), ","), lambda s: strip_ws(s)),
                    lambda s: s != F.lit(""))
