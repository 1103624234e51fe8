"""Text of downloaded bytes by the charset that their server names."""

from __future__ import annotations

import codecs

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Single-byte charsets by the names that pages give them (fixed values); Latin-1 and ASCII mean windows-1252.
LABELS = {
    "cp1252": ["windows-1252", "cp1252", "x-cp1252", "iso-8859-1", "iso8859-1", "iso88591", "latin1", "latin-1", "l1", "us-ascii", "ascii", "ansi_x3.4-1968"],
    "iso8859_15": ["iso-8859-15", "iso8859-15", "latin-9", "latin9", "l9"],
    "iso8859_16": ["iso-8859-16"],
    "koi8_r": ["koi8-r", "koi8", "koi"],
    "koi8_u": ["koi8-u", "koi8-ru"],
    "cp866": ["ibm866", "cp866", "866"],
    "cp874": ["windows-874", "tis-620", "iso-8859-11"],
    "mac_roman": ["macintosh", "mac", "x-mac-roman"],
    "cp1254": ["windows-1254", "cp1254", "iso-8859-9", "latin5", "l5"],
} | {f"cp{n}": [f"windows-{n}", f"cp{n}", f"x-cp{n}"] for n in (1250, 1251, 1253, 1255, 1256, 1257, 1258)}
LABELS |= {f"iso8859_{n}": [f"iso-8859-{n}", f"iso8859-{n}", *({2: ["latin2", "l2"], 3: ["latin3"], 4: ["latin4"], 5: ["cyrillic"], 6: ["arabic"], 7: ["greek"], 8: ["hebrew"], 10: ["latin6"]}.get(n, []))] for n in (2, 3, 4, 5, 6, 7, 8, 10, 13, 14)}
UTF = {"utf-8": "UTF-8", "utf8": "UTF-8", "unicode-1-1-utf-8": "UTF-8", "utf-16": "UTF-16LE", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE"}
HIGH = "".join(map(chr, range(128, 256)))


def upper_half(codec: str) -> str:
    """What the bytes from 128 on stand for; those that stand for nothing keep their number, if the charset
    is a Windows one, and are the replacement character otherwise."""
    decoder = codecs.getdecoder(codec)
    found = [(b, decoder(bytes([b]), "replace")[0]) for b in range(128, 256)]
    return "".join(chr(b) if c == "\ufffd" and codec.startswith("cp125") else c for b, c in found)


def charset_of(content_type: Column) -> Column:
    """The charset's name in a content type, lower-case; UTF-8 where there is none."""
    named = F.lower(F.regexp_extract(F.coalesce(content_type, F.lit("")), "(?i)charset\\s*=\\s*[\"']?\\s*([^\\s\"';]+)", 1))
    return F.when(named == "", "utf-8").otherwise(named)


def decoded_or_null(body: Column, content_type: Column) -> Column:
    """The text of bytes; null for a charset that is not known. A mark of byte order goes, what is no UTF-8
    becomes the replacement character, half a pair of UTF-16 goes.

    Single-byte charsets are a translation of 128 characters over a Latin-1 reading, inside the JVM.
    """
    name = charset_of(content_type)
    tables = F.create_map(*[F.lit(x) for codec, labels in LABELS.items() for label in labels for x in (label, upper_half(codec))])
    table = F.try_element_at(tables, name)
    out = F.when(table.isNotNull(), F.call_function("translate", F.decode(body, "ISO-8859-1"), F.lit(HIGH), table))
    of = lambda kind: name.isin([k for k, v in UTF.items() if v == kind])
    out = out.when(of("UTF-8"), F.make_valid_utf8(body.cast("string")))
    pairs = F.substring(body, F.lit(1), F.octet_length(body) - F.octet_length(body) % 2)
    for kind in ("UTF-16LE", "UTF-16BE"):
        out = out.when(of(kind), F.decode(pairs, kind))
    return F.regexp_replace(out, "^\ufeff", "")


def charset_error(content_type: Column) -> Column:
    """A message where the charset is not known, else null."""
    name = charset_of(content_type)
    known = [*UTF, *(label for labels in LABELS.values() for label in labels)]
    return F.when(~name.isin(known), F.concat(F.lit("unknown charset: "), name))
