"""Column expressions over text: tokens, cleaning, years, pages, term counts.

Everything returns a ``Column`` built from Spark's own functions, so it stays inside
whole-stage code generation (higher-order functions run JVM-side, interpreted) and no row
crosses into Python.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokeniser splits on every run of characters that are neither letters nor
# digits (Unicode classes), after lower-casing; empty pieces are dropped; no stop words.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"

# A year mention (1900-2099) standing alone between non-word characters, as a
# Unicode-aware word boundary would see it; group 1 is the year.  Written with explicit
# classes because Java's and RE2's ``\b`` disagree next to non-ASCII letters.
NON_WORD = r"[^\p{L}\p{N}_]"
YEAR_MENTION = r"(?:^|" + NON_WORD + r")((?:19|20)[0-9]{2})(?:" + NON_WORD + r"|$)"

# Page number in a file name, first match of this pattern, group 1.
PAGE_PATTERN = r"_page_([0-9]+)"

# A fiscal year such as FY24, FY 2024 or FY'24; group 1 is its two or four digits.
FISCAL_YEAR = r"(?i)(?:^|" + NON_WORD + r")FY[ '’-]?((?:20)?[0-9]{2})(?:" + NON_WORD + r"|$)"

CENTURY_PIVOT = 70

# A character reference after its "&"; group 1 is a number or a name.
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"
REPLACEMENT = "�"
# The references that most texts use, looked at before the table of all names.
COMMON_REFERENCES = [("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", "\u00a0")]


def named_references() -> dict[str, str]:
    """All named character references of HTML 5 that end in a semicolon, without it."""
    return {name[:-1]: char for name, char in sorted(html5.items()) if name.endswith(";")}


_EDGE = r"[^\p{L}\p{N}_]"
# Cleaning steps: (pattern, replacement) applied in order by ``clean_text``.  Script and style
# bodies and comments go first because scripts may hold tag-like strings such as "</p>"; escapes
# become character references, which are decoded last; line marks (quotes, lists, headings, rules)
# go before emphasis, so that a list star opens no emphasis.  No step repeats a group without bound
# (Java's matcher would recurse) and none lets a mark scan past the next mark of its kind, so each
# is linear in the text.
_ESCAPES = [(r"\\" + ("\\" if c in "\\`*_{}[]()#+.!|-" else "") + c, f"&#{ord(c)};") for c in "\\`*_{}[]()#+.!|~>-"]
_LINK = (r"!?\[([^\[\]]*)\]\([^()\[\]]*(?:\([^()\[\]]*\)[^()\[\]]*)?\)", "$1")
_STAR = (r"(^|[^\p{L}\p{N}_*])\*([^*\s]|[^*\s][^*\n]*[^*\s])\*([^\p{L}\p{N}_*]|$)", "$1$2$3")
_UNDERSCORE = (r"(^|" + _EDGE + r")_([^_\s]|[^_\s][^_\n]*[^_\s])_(" + _EDGE + r"|$)", "$1$2$3")
HIDDEN_PARTS = (r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
CLEAN_STEPS = [
    HIDDEN_PARTS,
    *_ESCAPES,
    _LINK, _LINK,  # twice: an image inside a link
    (r"(?m)^[ \t]{0,3}(?:=+|-{2,}|\*{3,}|_{3,})[ \t\r]*$", ""),
    (r"(^|\n)[ \t]*>[> \t]*", "$1"),
    (r"(^|\n)[ \t]*(?:[-*+]|[0-9]{1,3}[.)])[ \t]+", "$1"),
    (r"(^|\n)[ \t]{0,3}#{1,6}[ \t]*", "$1"),
    (r"\*\*|`", ""),
    (r"(^|" + _EDGE + r")__([^_\s][^_\n]*(?:_[^_\n]+){0,3})__(" + _EDGE + r"|$)", "$1$2$3"),
    _STAR, _STAR, _UNDERSCORE, _UNDERSCORE,  # twice: neighbours share the character between them
    (r"<[A-Za-z/!][^<>]*>", " "),
]
# Steps for texts with link definitions ("[label]: target" lines), before the others.
DEFINITION = r"(?m)^[ \t]{0,3}\[[^\[\]\n]+\]:[ \t]*[^ \t\n][^\n]*$"
REFERENCE_STEPS = [(DEFINITION, ""), (r"!?\[([^\[\]]*)\]\[[^\[\]]*\]", "$1")]
# Openers of hidden parts and their ends.  An opener after the last end of its kind opens nothing;
# its "<" is set aside, or each such opener would be searched to the end of the text.
_OPENERS = [(r"(?i)<(?=script\b)", r"(?is)^.*</script\s*>"), (r"(?i)<(?=style\b)", r"(?is)^.*</style\s*>"), (r"<(?=!--)", r"(?s)^.*-->")]
_ASIDE = "\ufdd0"
_ASIDE_BACK = r"(?i)" + _ASIDE + r"(?=script\b|style\b|!--)"
WHITESPACE = r"[ \t\n\r\f]+"


def _let(value: Column, of) -> Column:
    """``of(value)`` with the value computed once, however often ``of`` names it."""
    return F.element_at(F.transform(F.array(value), lambda x: of(x)), 1)


def _replaced(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, repl in steps:
        text = F.regexp_replace(text, pattern, repl)
    return text


def tokens(text: Column) -> Column:
    """``array<string>`` of lower-cased word tokens; null text gives null."""
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: t != F.lit(""))


def clean_text(text: Column, collapse_whitespace: bool = True) -> Column:
    """Markdown or HTML → plain text, as a chain of regular-expression rewrites.

    Drops script/style bodies and comments, unwraps markdown links and images (inline, or by
    label where the text defines labels), removes link definitions, quote, list and heading
    marks (underlines and rules too), bold and emphasis marks (``__`` and ``_`` inside words
    stay), backticks and tags, keeps escaped marks as characters, decodes character references,
    and (by default) collapses whitespace runs to one space and trims.  Linear in the text.
    """
    out = _let(text, lambda t: F.when(F.instr(t, "<") > 0, without_hidden_parts(t)).otherwise(t))
    out = _let(out, lambda t: F.when((F.instr(t, "]:") > 0) & t.rlike(DEFINITION), _replaced(t, REFERENCE_STEPS)).otherwise(t))
    out = _let(out, lambda t: F.when(F.instr(t, "\\") > 0, _replaced(t, _ESCAPES)).otherwise(t))
    out = _let(_replaced(out, CLEAN_STEPS[1 + len(_ESCAPES):]), lambda t: F.when(F.instr(t, "&") > 0, decode_references(t)).otherwise(t))
    if collapse_whitespace:
        out = F.trim(F.regexp_replace(out, WHITESPACE, " "))
    return out


def without_hidden_parts(text: Column) -> Column:
    """The text without script and style bodies and comments.  Only openers that have an end
    after them are searched from, so the search is one pass."""
    def set_aside(t: Column, opener: str, to_last_end: str) -> Column:
        return _let(F.length(F.regexp_extract(t, to_last_end, 0)), lambda ended: F.concat(
            F.substr(t, F.lit(1), ended), F.regexp_replace(F.substr(t, ended + 1), opener, _ASIDE)))

    for pair in _OPENERS:
        text = _let(text, lambda t, pair=pair: F.when(t.rlike(pair[0]), set_aside(t, *pair)).otherwise(t))
    return F.regexp_replace(F.regexp_replace(text, *HIDDEN_PARTS), _ASIDE_BACK, "<")


def decode_references(text: Column) -> Column:
    """Decodes ``&name;``, ``&#n;`` and ``&#xh;`` once, left to right; unknown names and
    references without a semicolon stay, numbers that are no character become U+FFFD."""
    # by first character, as a map is searched from its start
    groups: dict[str, dict[str, str]] = {}
    for name, char in named_references().items():
        groups.setdefault(name[0], {})[name] = char
    names = F.from_json(F.lit(json.dumps(groups)), "map<string,map<string,string>>")

    def decoded(piece: Column) -> Column:
        ref = F.regexp_extract(piece, REFERENCE, 1)
        rest = F.substr(piece, F.length(ref) + 2)
        number = F.when(F.lower(F.substring(ref, 2, 1)) == "x", F.conv(F.substr(ref, F.lit(3)), 16, 10)).otherwise(
            F.substr(ref, F.lit(2))).try_cast("int")
        real = ((number > 0) & (number < 0xD800)) | ((number > 0xDFFF) & (number <= 0x10FFFF))
        char = F.when(real, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(F.lit(REPLACEMENT))
        value = F.when(F.substring(ref, 1, 1) == "#", char).otherwise(F.coalesce(
            *(F.when(ref == name, F.lit(char)) for name, char in COMMON_REFERENCES), F.try_element_at(F.try_element_at(names, F.substring(ref, 1, 1)), ref)))
        return F.when((ref != "") & value.isNotNull(), F.concat(value, rest)).otherwise(F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    return F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, 2, 1_000_000_000), decoded), ""))


def publication_year(doc_key: Column) -> Column:
    """Last four characters of the document key as INT; null when not a number."""
    return F.right(doc_key, F.lit(4)).try_cast("int")


def referenced_years(doc_key: Column) -> Column:
    """``[y, y-1, y-2, y-3]`` for the publication year ``y``; null when ``y`` is null."""
    y = publication_year(doc_key)
    return F.when(y.isNotNull(), F.array(y, y - 1, y - 2, y - 3))


def page_number(file_name: Column) -> Column:
    """First ``_page_<n>`` in the file name as INT; null when absent."""
    return F.regexp_extract(file_name, PAGE_PATTERN, 1).try_cast("int")


def mentioned_year(text: Column) -> Column:
    """First year mention (1900–2099) in free text as INT; null when none."""
    return F.regexp_extract(text, YEAR_MENTION, 1).try_cast("int")


def spoken_year(text: Column) -> Column:
    """The year that a question asks for: its first year mention, else its first fiscal year (FY24,
    FY2024; two digits from ``CENTURY_PIVOT`` on are of the last century)."""
    fiscal = F.regexp_extract(text, FISCAL_YEAR, 1).try_cast("int")
    full = F.when(fiscal >= 100, fiscal).when(fiscal >= CENTURY_PIVOT, fiscal + 1900).otherwise(fiscal + 2000)
    return F.coalesce(mentioned_year(text), full)


def words(alternatives: str) -> str:
    """Case-insensitive pattern matching any of ``alternatives`` as whole words."""
    return r"(?i)(?:^|" + NON_WORD + r")(?:" + alternatives + r")(?:" + NON_WORD + r"|$)"


def token_pieces(text: Column) -> Column:
    """Lower-cased split on the separator pattern; only the first and the last piece can be
    empty (text starting or ending with a separator).  Cheaper than ``tokens`` when the pieces
    are exploded anyway: drop the empty ones with a plain filter afterwards."""
    return F.split(F.lower(text), TOKEN_SPLIT)


def token_count(pieces: Column) -> Column:
    """Number of non-empty tokens in ``token_pieces`` output, without a lambda."""
    n = F.size(pieces)
    first_empty = F.when(F.element_at(pieces, 1) == "", 1).otherwise(0)
    last_empty = F.when((n > 1) & (F.element_at(pieces, -1) == ""), 1).otherwise(0)
    return n - first_empty - last_empty


def hash_bucket(term: Column, dim: int) -> Column:
    """Bucket of a term for the hashed embedder: first 8 hex digits of md5, modulo ``dim``."""
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
