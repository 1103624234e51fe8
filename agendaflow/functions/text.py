"""Text functions as Spark columns: keys, blanks, addresses, HTML fragments."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Punctuation that a simplified key replaces by a blank (fixed values; no double quote, no underscore).
PUNCTUATION = "~!@$%^&*()+=-,./';:?><[]\\{}|`#"
_CLASS = "[" + "".join("\\" + c for c in PUNCTUATION) + "]"
BLANK = "(?U)\\s"


def _accent_table() -> tuple[str, str, str]:
    """Characters up to U+1EFF whose decomposition is one base and marks, their bases, and the marks."""
    pairs = []
    for cp in range(0xC0, 0x1F00):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if not 0x300 <= ord(c) <= 0x36F)
        if base != chr(cp) and len(base) == 1:
            pairs.append((chr(cp), base))
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs), marks


_FROM, _TO, _MARKS = _accent_table()


def strip_accents(c: Column) -> Column:
    """Latin, Greek and Cyrillic letters without their accents, and no combining marks; stays in the JVM."""
    return F.translate(c, _FROM + _MARKS, _TO)


@F.pandas_udf(StringType())
def strip_accents_any(s: pd.Series) -> pd.Series:
    """As ``strip_accents`` over all of Unicode."""
    return s.map(lambda x: x if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not 0x300 <= ord(c) <= 0x36F))


def remove_blanks(c: Column) -> Column:
    """Line breaks and tabs become blanks, runs of two or more blanks one, one blank at each end goes."""
    c = F.regexp_replace(c, "[\\n\\t]", " ")
    c = F.regexp_replace(c, f"{BLANK}{{2,}}", " ")
    return F.regexp_replace(c, f"^{BLANK}|{BLANK}$", "")


def simplify(c: Column) -> Column:
    """The key by which names are compared: lower case, no accents, punctuation as blanks."""
    return remove_blanks(F.regexp_replace(strip_accents(F.lower(c)), _CLASS, " "))


def first_only(c: Column, pattern: str, replacement: str) -> Column:
    """Replaces the first match alone; ``replacement`` may not refer to groups."""
    return F.regexp_replace(c, f"^([\\s\\S]*?)(?:{pattern})", "$1" + replacement)


def make_id(name: Column, city: Column, country: Column) -> Column:
    return F.concat(name, F.lit("|"), city, F.lit("|"), country)


def name_of_id(c: Column) -> Column:
    return F.regexp_replace(c, "\\|[^|]*\\|[^|]*$", "")


def base_url(url: Column) -> Column:
    """The address up to the last slash of its path, without query and fragment."""
    bare = F.regexp_replace(url, "[?#][\\s\\S]*$", "")
    bare = F.when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/]*$"), F.concat(bare, F.lit("/"))).otherwise(bare)
    return F.regexp_replace(bare, "/[^/]*$", "/")


def make_url(url: Column, base: Column) -> Column:
    """An absolute address: kept if it has a scheme, from the host for a leading slash, else from the
    base; null or empty gives null."""
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    host = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1)
    return (
        F.when(F.coalesce(url, F.lit("")) == "", F.lit(None).cast("string"))
        .when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), url)
        .when(url.startswith("/"), F.concat(scheme, F.lit("://"), host, url))
        .otherwise(F.concat(base, url))
    )


def normalize_url(url: Column) -> Column:
    return F.when(url.rlike("(?i)^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def is_valid_url(url: Column) -> Column:
    return url.isNotNull() & (url != "#")


def extract_body(html: Column) -> Column:
    """The first body element, tags included; null where there is none."""
    return F.nullif(F.regexp_extract(html, "<body[\\s\\S]*?>[\\s\\S]*?</body>", 0), F.lit(""))


def drop_elements(html: Column, *tags: str) -> Column:
    """Without the elements of these names and all they hold; a name matches as a prefix."""
    for tag in tags:
        html = F.regexp_replace(html, f"<{tag}[\\s\\S]*?</{tag}>", "")
    return html


def unwrap(html: Column, tag: str) -> Column:
    return F.regexp_replace(html, f"</?{tag}[^>]*>", "")


def clean_scripts(html: Column) -> Column:
    return drop_elements(html, "script", "noscript")


#: Elements without information for extraction (fixed values).
USELESS = ["header", "svg", "video", "option", "footer", "nav", "select"]
#: What shorter copies of a page leave out (fixed values): elements, then attributes.
SHORTER_ELEMENTS = ["path", "header", "svg", "video", "option", "button", "footer", "nav", "select"]
SHORTER_ATTRIBUTES = [
    "style", "alt", "decoding", "srcSet", "src", "sizes", "rel", "target", "aria-label", "aria-haspopup", "aria-expanded", "aria-current", "aria-hidden", "aria-disabled", "aria-controls", "data-state",
]


def remove_useless_tags(html: Column) -> Column:
    """Paths of drawings lose their tags, other useless elements go with all they hold."""
    html = F.regexp_replace(html, "(?i)<\\s*path[^>]*>(.*?)<\\s*/path\\s*>", "$1")
    return drop_elements(html, *USELESS)


def remove_forms(html: Column) -> Column:
    return drop_elements(html, "form", "style")


def remove_images(html: Column) -> Column:
    return F.regexp_replace(html, "<img[^>]*>", "")


def wrap_broken_lines(html: Column) -> Column:
    """Text before a line break, from the tag before it on, and text after one, up to the next tag, become
    paragraphs of their own, empty ones too."""
    html = F.regexp_replace(html, "(?i)(?<!br)>([^>]*?)<br>", "><p class=\"addedTag\">$1</p><br>")
    return F.regexp_replace(html, "(?i)<br>([\\s\\S]*?)(?=<)", "<p class=\"addedTag\">$1</p>")


def fix_images(html: Column) -> Column:
    """Images don't leave the flow of a page: ``position: absolute`` of their style has no effect."""
    return F.regexp_replace(html, "(<img[^>]*style\\s*=\\s*\"[^\"]*position\\s*:\\s*)absolute", "$1XXXXXXXX")


def minimalize_basic(html: Column) -> Column:
    """A page without its head, some elements, images and some attributes; classes, ids, links, titles,
    scripts and comments stay."""
    html = remove_images(drop_elements(html, "head", *SHORTER_ELEMENTS))
    for name in SHORTER_ATTRIBUTES:
        html = F.regexp_replace(html, f"{name}[ ]*=[ ]*\"[\\s\\S]*?\"", "")
    return html


def fix_string(c: Column, candidates: Column) -> Column:
    """The first candidate that the text matches with any character for those outside ASCII; else itself."""
    return F.coalesce(F.try_element_at(F.filter(candidates, lambda x: F.call_function("rlike", x, F.regexp_replace(c, "[^\\x00-\\x7F]", "."))), F.lit(1)), c)


def remove_ending(c: Column, ending: Column) -> Column:
    """Without an ending, then trimmed, where the text has it."""
    return F.when(F.endswith(c, ending), F.trim(F.left(c, F.length(c) - F.length(ending)))).otherwise(c)


def image_placeholder(html: Column) -> Column:
    return F.regexp_replace(html, "<img.*?>", "[***IMAGE***]")


def escape_parentheses(c: Column) -> Column:
    """The first opening and the first closing one with a backslash, as a selector wants them."""
    return F.regexp_replace(F.regexp_replace(c, "^([^(]*)\\(", "$1\\\\("), "^([^)]*)\\)", "$1\\\\)")


def shown_element(html: Column, tag: Column, most: int = 50) -> Column:
    """``tag: text`` of an element for a list, its text cut at ``most`` characters with a mark."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), "\\s+", " "))
    return F.concat(tag, F.lit(": "), F.when(F.length(plain) > most, F.concat(F.left(plain, F.lit(most)), F.lit("…"))).otherwise(plain))


def short_label(c: Column, most: int = 30) -> Column:
    """At most 30 characters and an ellipsis, upper case."""
    return F.upper(F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c))


def style_of_answer(c: Column) -> Column:
    """``style (substyle)`` as a struct."""
    return F.struct(
        F.trim(F.regexp_extract(c, "^([^(]*)", 1)).alias("style"),
        F.nullif(F.trim(F.regexp_extract(c, "\\(([^)]*)\\)", 1)), F.lit("")).alias("detail"),
    )


def parse_number(c: Column) -> Column:
    """The number that a text begins with, what follows it ignored; null where there is none."""
    return F.nullif(F.regexp_extract(c, "^\\s*([-+]?(?:\\d+(?:\\.\\d*)?|\\.\\d+))", 1), F.lit("")).cast("double")


def fill_message(message: Column, *values: Column) -> Column:
    """The message with each ``%s`` in turn filled; colour codes are dropped."""
    for v in values:
        # a value may hold what a replacement would read as a group
        value = F.regexp_replace(F.coalesce(v.cast("string"), F.lit("null")), "([\\\\$])", "\\\\$1")
        message = F.call_function("regexp_replace", message, F.lit("^([\\s\\S]*?)%s"), F.concat(F.lit("$1"), value))
    return F.regexp_replace(message, "\\x1b\\[\\d+m", "")


def append_log(log: Column, message: Column) -> Column:
    """The log with one more message after `` | ``; colour codes are dropped."""
    plain = F.regexp_replace(message, "\\x1b\\[[0-9;]*m", "")
    return F.concat_ws(" | ", log, plain)
