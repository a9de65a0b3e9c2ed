"""Text keys, labels and genre tokens.

Arguments are SQL expressions, most often a column name; each function is one expression, so
building a plan takes one call to the JVM for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip removes.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACES_SQL = "'" + "".join(f"\\u{ord(c):04x}" for c in SPACES) + "'"
_SPACE_LIST = "(" + ", ".join(f"'\\u{ord(c):04x}'" for c in SPACES) + ")"
# Letters that have a case, as Python's str.title sees them.
_CASED_SQL = r"'[\\p{IsUppercase}\\p{IsLowercase}\\p{Lt}]'"

KEY_SEPARATOR = "|||"


def strip_sql(e: str) -> str:
    # Trimming a set of characters walks the whole string; most names do not need it.
    padded = f"left({e}, 1) in {_SPACE_LIST} or right({e}, 1) in {_SPACE_LIST}"
    return f"if({padded}, btrim({e}, {_SPACES_SQL}), {e})"


def norm_full_sql(e: str) -> str:
    return f"lower({strip_sql(e)})"


def norm_unquoted_sql(e: str) -> str:
    return f"translate({norm_full_sql(e)}, '\\'\"', '')"


def norm_plain_sql(e: str) -> str:
    return f"lower(trim({e}))"


# Key normalisers by name, as SQL.
NORMALISERS: dict[str, Callable[[str], str]] = {
    "full": norm_full_sql,
    "unquoted": norm_unquoted_sql,
    "sql": norm_plain_sql,
}


def norm_full(e: str) -> Column:
    """Lower case without any surrounding Unicode white space."""
    return F.expr(norm_full_sql(e))


def norm_unquoted(e: str) -> Column:
    """``norm_full``, then quotes removed; stripping comes first, so inner blanks survive."""
    return F.expr(norm_unquoted_sql(e))


def norm_sql(e: str) -> Column:
    """SQL ``lower(trim())``: only the ordinary space is trimmed."""
    return F.expr(norm_plain_sql(e))


def composite_key_sql(track: str, artist: str) -> str:
    return f"concat({track}, '{KEY_SEPARATOR}', {artist})"


def composite_key(track: str, artist: str) -> Column:
    """``track|||artist``; NULL when either part is NULL, so it never matches."""
    return F.expr(composite_key_sql(track, artist))


def title_case(e: str) -> Column:
    """Upper case after every uncased character, lower case elsewhere (``r&b`` -> ``R&B``)."""
    letters = f"""transform(sequence(1, length({e})), i ->
        if(i > 1 and substr({e}, i - 1, 1) rlike {_CASED_SQL}, lower(substr({e}, i, 1)), upper(substr({e}, i, 1))))"""
    return F.expr(f"if(length({e}) > 0, concat_ws('', {letters}), {e})")


def genre_tokens(e: str) -> Column:
    """Comma list -> array of tokens, case kept, blanks kept."""
    return F.expr(f"transform(split({e}, ','), g -> {strip_sql('g')})")


def genre_tokens_folded(e: str) -> Column:
    """Comma list -> array of lower-case tokens without blanks; label with ``title_case`` later."""
    return F.expr(f"filter(transform(split({e}, ','), g -> {norm_full_sql('g')}), g -> g <> '')")


def primary_genre(e: str, default: str | None = "Unknown") -> Column:
    """First item of a comma list, trimmed."""
    first = F.expr(strip_sql(f"split({e}, ',')[0]"))
    return first if default is None else F.coalesce(first, F.lit(default))


def pair_label(track: str, artist: str) -> Column:
    """``track — artist``; a missing artist leaves an empty right side."""
    return F.expr(f"concat({track}, ' — ', coalesce({artist}, ''))")


def shorten(e: str, limit: int = 20) -> Column:
    """Cut to ``limit`` characters and mark the cut."""
    return F.expr(f"if(length({e}) > {limit}, concat(left({e}, {limit}), '...'), {e})")


def drop_suffix(e: str, suffix: str) -> Column:
    """Remove every occurrence of a literal suffix marker from a label."""
    return F.replace(F.expr(e), F.lit(suffix), F.lit(""))


def feature_at_year(year: str, value: str) -> Column:
    """``2001 (0.437)``."""
    return F.expr(f"format_string('%d (%.3f)', {year}, {value})")
