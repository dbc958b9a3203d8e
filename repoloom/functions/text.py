"""Bytes to text, the way a lenient text-mode reader does it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One well-formed UTF-8 sequence, with every byte seen as one Latin-1 character.
_SEQUENCE = (
    r"[\x00-\x7f]"
    r"|[\xc2-\xdf][\x80-\xbf]"
    r"|\xe0[\xa0-\xbf][\x80-\xbf]"
    r"|[\xe1-\xec\xee\xef][\x80-\xbf]{2}"
    r"|\xed[\x80-\x9f][\x80-\xbf]"
    r"|\xf0[\x90-\xbf][\x80-\xbf]{2}"
    r"|[\xf1-\xf3][\x80-\xbf]{3}"
    r"|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)


def decode_lenient(content: Column) -> Column:
    """UTF-8 text with invalid bytes dropped and line ends unified to `\\n`.

    Valid content is a plain cast. Otherwise the bytes are viewed as Latin-1,
    each byte outside a well-formed sequence is removed, and the rest is read
    back as UTF-8, all without leaving the JVM.
    """
    as_text = content.cast("string")
    one_char_per_byte = F.decode(content, "ISO-8859-1")
    cleaned = F.regexp_replace(one_char_per_byte, f"(?s)({_SEQUENCE})|.", "$1")
    repaired = F.encode(cleaned, "ISO-8859-1").cast("string")
    text = F.when(F.is_valid_utf8(as_text), as_text).otherwise(repaired)
    return F.regexp_replace(text, "\r\n?", "\n")
