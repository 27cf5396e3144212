"""Document bytes → text.

Extraction is pluggable: an extractor is ``(name, bytes) -> str``.  The
built-in one decodes UTF-8 text and strips HTML to text; PDF needs an extractor
of the caller's.  For HTML already in a table column, ``html_to_text`` does the
same stripping as native column expressions, character references included,
with no Python worker.
"""

from __future__ import annotations

import html as _html
import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from shortlist.functions.text import WS_RUN_PATTERN

HTML_DROP_BLOCKS = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
HTML_COMMENT = r"(?s)<!--.*?-->"
HTML_TAG = r"<[^>]*>"

# Character references, as HTML defines them.  Names come from the standard table, those without a final
# semicolon (LEGACY_NAMES) also as the beginning of a longer word.
LEGACY_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
REFERENCE_NAME = r"^[^\t\n\f <&#;]{1,32};?"
REFERENCE_LEGACY = f"^(?:{'|'.join(LEGACY_NAMES)})"
REFERENCE_DECIMAL = r"^#0*([0-9]*);?"
REFERENCE_HEX = r"^#[xX]0*([0-9a-fA-F]*);?"
REFERENCE_NUMBER = r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?"
REPLACEMENT = "\ufffd"
LAST_CODE = 0x10FFFF
#: What numbers from 0x80 to 0x9F stand for: the Windows code page where it has a character there.
WINDOWS_80 = "".join(bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0))
#: Numbers that stand for nothing: control characters and non-characters.
NO_CHARACTER = ((0x1, 0x8), (0xB, 0xB), (0xE, 0x1F), (0x7F, 0x7F), (0xFDD0, 0xFDEF))
_PAIR, _VALUE = "\x02", "\x03"


def _number_character(code: Column) -> Column:
    nothing = (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    for lo, hi in NO_CHARACTER:
        nothing = nothing | code.between(lo, hi)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (F.when((code == 0) | (code > LAST_CODE) | code.between(0xD800, 0xDFFF), F.lit(REPLACEMENT))
            .when(code.between(0x80, 0x9F), F.substring(F.lit(WINDOWS_80), code - 0x7F, F.lit(1)))
            .when(nothing, F.lit("")).otherwise(char))


def _reference(piece: Column, names: Column) -> Column:
    """What stood behind an '&', with the reference it begins with replaced."""
    number = F.regexp_extract(piece, REFERENCE_NUMBER, 0)
    hexed = F.regexp_extract(piece, REFERENCE_HEX, 1)
    digits = F.regexp_extract(piece, REFERENCE_DECIMAL, 1)
    # More digits than the last code has are beyond it, and never cast.
    code = F.when(F.rlike(piece, F.lit("^#[xX]")),
                  F.when(F.length(hexed) <= 6, F.coalesce(F.conv(F.concat(F.lit("0"), hexed), 16, 10).cast("int"), F.lit(0))).otherwise(LAST_CODE + 1)) \
        .otherwise(F.when(F.length(digits) <= 7, F.concat(F.lit("0"), digits).cast("int")).otherwise(LAST_CODE + 1))
    name = F.regexp_extract(piece, REFERENCE_NAME, 0)
    whole = F.when(name != "", F.try_element_at(names, name))
    legacy = F.regexp_extract(piece, REFERENCE_LEGACY, 0)
    def rest(match):
        return F.substring(piece, F.length(match) + 1, F.lit(1 << 30))
    return (F.when(number != "", F.concat(_number_character(code), rest(number)))
            .when(whole.isNotNull(), F.concat(whole, rest(name)))
            .when(legacy != "", F.concat(F.try_element_at(names, legacy), rest(legacy)))
            .otherwise(F.concat(F.lit("&"), piece)))


def unescape(text: Column) -> Column:
    """Named and numeric character references replaced by their characters, each once, from left to right."""
    names = F.str_to_map(F.lit(_PAIR.join(f"{n}{_VALUE}{v}" for n, v in html5.items())), F.lit(_PAIR), F.lit(_VALUE))
    pieces = F.split(text, "&")
    decoded = F.transform(pieces, lambda piece, i: F.when(i == 0, piece).otherwise(_reference(piece, names)))
    return F.when(F.contains(text, F.lit("&")), F.array_join(decoded, "")).otherwise(text)


def html_to_text(html: Column | str) -> Column:
    """Visible text of an HTML document: script/style/comments dropped, tags
    turned into spaces, character references decoded, whitespace collapsed."""
    h = F.col(html) if isinstance(html, str) else html
    t = F.regexp_replace(h, HTML_DROP_BLOCKS, " ")
    t = F.regexp_replace(t, HTML_COMMENT, " ")
    t = F.regexp_replace(t, HTML_TAG, " ")
    t = unescape(t)
    t = F.regexp_replace(t, WS_RUN_PATTERN, " ")
    return F.trim(t)


_DROP = re.compile(r"<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>", re.I | re.S)
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_TAG = re.compile(r"<[^>]*>")


def _html_bytes_to_text(data: bytes) -> str:
    text = data.decode("utf-8", errors="replace")
    text = _TAG.sub(" ", _COMMENT.sub(" ", _DROP.sub(" ", text)))
    return " ".join(_html.unescape(text).split())


def default_extractor(name: str, data: bytes) -> str:
    """Text of a member by its extension: HTML stripped, anything else as UTF-8.

    There is no decoder for PDF here; real PDF content raises, which
    ``read_members`` turns into its error column.  Pass an extractor of your
    own to ``read_members`` for PDF.
    """
    low = name.lower()
    if low.endswith(".pdf") and b"%PDF-" in data[:1024]:
        raise ValueError("no PDF decoder: pass an extractor to read_members")
    if low.endswith((".html", ".htm")):
        return _html_bytes_to_text(data)
    return data.decode("utf-8", errors="replace")
