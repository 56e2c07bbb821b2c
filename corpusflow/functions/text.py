"""Text functions whose results follow Python's text rules rather than Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip removes.
_BLANK = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# One UTF-16 code point in hex, anchored to the previous one: a surrogate pair, or a unit outside the surrogates.
_UTF16_UNITS_BE = r"\G(?:D[89AB]..D[C-F]..|(?!D[89A-F])....)"
_UTF16_UNITS_LE = r"\G(?:..D[89AB]..D[C-F]|(?!..D[89A-F])....)"

_SURROGATE_BE = "^(?:....)*?D[89A-F]"
_SURROGATE_LE = "^(?:....)*?..D[89A-F]"

# Fixed value: lengths of previews in document listings.
PREVIEW_CHARS = 200


def strip(text: Column) -> Column:
    """Remove Unicode white space from both ends (Spark's ``trim`` removes spaces only)."""
    return F.btrim(text, F.lit(_BLANK))


def only_present(value: Column) -> Column:
    """A generator of the value, or of no row where it is null.

    Unlike a filter on a computed column, which Spark pushes below the projection, it computes the value once.
    """
    return F.explode(F.array_compact(F.array(value)))


def universal_newlines(text: Column) -> Column:
    """``\\r\\n`` and a lone ``\\r`` become ``\\n``, as a text-mode read does."""
    return F.regexp_replace(text, "\r\n?", "\n")


def collapse_newlines(text: Column) -> Column:
    """Three or more newlines in a row become two."""
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def safe_str(value: Column, default: str = "") -> Column:
    """The stripped text form of ``value``, or ``default`` where it is null or blank."""
    return F.coalesce(F.nullif(strip(value.cast("string")), F.lit("")), F.lit(default))


def preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.substring(text, 1, chars)


def utc_iso(moment: Column) -> Column:
    """A timestamp as ISO-8601 text in UTC, with microseconds where it has any."""
    utc = F.to_utc_timestamp(moment, F.current_timezone())
    micros = F.date_format(utc, ".SSSSSS")
    fraction = F.when(micros != ".000000", micros).otherwise("")
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def utc_now_iso() -> Column:
    return utc_iso(F.current_timestamp())


def full_text(pages: Column) -> Column:
    """The non-empty page texts of a ``pages`` array, joined by newlines."""
    texts = F.transform(pages, lambda p: p["text"])
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n")


def decode_replacing(content: Column) -> Column:
    """Bytes as UTF-8 with U+FFFD for malformed bytes, newlines unified."""
    return universal_newlines(F.make_valid_utf8(content.cast("string")))


def decode_plain(content: Column) -> Column:
    """Bytes as text by the plain-text rule: valid UTF-8, else UTF-16 when marked by a BOM, else Latin-1.

    An odd length or an unpaired surrogate makes UTF-16 invalid, so such content falls through to Latin-1.
    """
    raw = content.cast("string")
    utf8 = F.when(F.is_valid_utf8(raw), raw)
    # decode fails on malformed input, so it only gets to see what is well-formed; of null it makes null.
    utf16 = F.decode(F.when(_valid_utf16(content), content), "UTF-16")
    return universal_newlines(F.coalesce(utf8, utf16, F.decode(content, "ISO-8859-1")))


def _valid_utf16(content: Column) -> Column:
    """Has a BOM, whole code units, and only paired surrogates.

    Most text holds no surrogates, which one scan of the hex form shows. Otherwise well-formed units are removed one
    match at a time; nothing may remain.
    """
    bom = F.hex(F.substring(content, 1, 2))
    units = F.hex(content)

    def paired(some_surrogate: str, well_formed: str) -> Column:
        return ~units.rlike(some_surrogate) | (F.regexp_replace(units, well_formed, "") == "")

    surrogates = F.when(bom == "FFFE", paired(_SURROGATE_LE, _UTF16_UNITS_LE)).otherwise(
        paired(_SURROGATE_BE, _UTF16_UNITS_BE)
    )
    return bom.isin("FFFE", "FEFF") & (F.octet_length(content) % 2 == 0) & surrogates
