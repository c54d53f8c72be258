"""Scalar text functions: normal forms, predicates, clean-up. Columns in, columns out; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verseloom.config import FILLERS
from verseloom.functions.decompose import without_marks

PUNCTUATION = ".,;:!?()[]{}"
#: What counts as in brackets. Fixed value.
BRACKETED = r"^\s*[\[\(][^\[\]\(\)]*[\]\)]\s*$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze(x: Column | str) -> Column:
    """White space runs become one blank; no blanks at the ends."""
    return F.trim(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def unaccented(x: Column | str) -> Column:
    """Lower case, sharp s as ss, compatibility forms spelt out, accents gone, in any script."""
    return F.lower(without_marks(F.replace(F.lower(_c(x)), F.lit("ß"), F.lit("ss"))))


def phrase_form(x: Column | str) -> Column:
    """Words of a-z and 0-9 with single blanks between."""
    return F.trim(F.regexp_replace(unaccented(x), "[^a-z0-9]+", " "))


#: Letters of the table form and their base letters. Fixed values.
TABLE, TABLE_BASE = "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn"


def table_form(x: Column | str) -> Column:
    """The phrase form by a table of 24 letters: letters outside of it part words."""
    return F.trim(F.regexp_replace(F.translate(F.replace(F.lower(_c(x)), F.lit("ß"), F.lit("ss")), TABLE, TABLE_BASE), "[^a-z0-9]+", " "))


def token_form(x: Column | str) -> Column:
    """Letters and digits of any script, without accents and blanks."""
    return F.regexp_replace(unaccented(x), r"[^\p{L}\p{N}]", "")


def ascii_letters(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(without_marks(F.lower(_c(x)))), "[^a-z]", "")


def bare_word(x: Column | str) -> Column:
    """Lower case without punctuation at the ends; accents stay."""
    return F.lower(F.btrim(F.trim(_c(x)), F.lit(PUNCTUATION)))


def archive_value(x: Column | str) -> Column:
    """A value of the archive format: no bars, single blanks."""
    return squeeze(F.translate(_c(x), "|", " "))


def slug(x: Column | str) -> Column:
    words = F.substring(F.replace(phrase_form(x), F.lit(" "), F.lit("-")), 1, 80)
    return F.coalesce(F.nullif(words, F.lit("")), F.lit("untitled"))


def safe_filename(x: Column | str) -> Column:
    """ASCII stem and suffix of a path's name, with defaults."""
    name = F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"[/\\]", "_")
    suffix = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
    stem = F.left(name, F.length(name) - F.length(suffix))
    ascii_only = F.regexp_replace(F.regexp_replace(without_marks(stem), r"[^\x00-\x7F]", ""), "[^A-Za-z0-9._-]+", "_")
    return F.concat(F.coalesce(F.nullif(F.btrim(ascii_only, F.lit("._-")), F.lit("")), F.lit("audio")), F.coalesce(F.nullif(F.lower(suffix), F.lit("")), F.lit(".mp3")))


def words(x: Column | str) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(r"(?U)\S+"), F.lit(0))


def word_count(x: Column | str) -> Column:
    return F.size(words(x))


def normal_word_count(x: Column | str) -> Column:
    return F.size(F.regexp_extract_all(phrase_form(x), F.lit(r"\S+"), F.lit(0)))


def excerpt(x: Column | str, n: int = 6) -> Column:
    w = words(x)
    return F.concat(F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, F.lit(" ...")).otherwise(F.lit("")))


def escape_pipe(x: Column | str) -> Column:
    return F.replace(_c(x), F.lit("|"), F.lit("\\|"))


def caption_text(x: Column | str) -> Column:
    """Without inline times and tags."""
    return squeeze(F.regexp_replace(F.regexp_replace(_c(x), r"<\d\d:\d\d:\d\d\.\d\d\d>", ""), "<[^>]*>", ""))


def has_letter(x: Column | str) -> Column:
    return _c(x).rlike(r"[\p{L}\p{N}]")


def special_token(x: Column | str) -> Column:
    return _c(x).rlike(r"^\s*\[[^\[\]]*\]\s*$")


def ignorable(x: Column | str) -> Column:
    """Nothing that a lyric could match: empty, a filler, or in one pair of brackets of any kind."""
    form = token_form(x)
    return (form == "") | form.isin(*FILLERS) | _c(x).rlike(BRACKETED)


def repetition_marker(x: Column | str) -> Column:
    return F.trim(_c(x)).rlike(r"(?i)^\(\d+x\)$")


def ends_with(x: Column | str, chars: str) -> Column:
    return F.rtrim(_c(x)).rlike(f"[{chars}]$")


def starts_upper(x: Column | str) -> Column:
    first = F.left(F.ltrim(_c(x)), F.lit(1))
    return (first == F.upper(first)) & (first != F.lower(first))


def caption_overlap(previous: Column, current: Column) -> Column:
    """Longest suffix of the previous tokens that the current ones begin with."""
    most = F.least(F.size(previous), F.size(current))
    fits = F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda n: (n <= most) & (F.slice(previous, -n, n) == F.slice(current, F.lit(1), n)))
    return F.when(most > 0, F.coalesce(F.array_max(fits), F.lit(0))).otherwise(0)


def cache_key(x: Column | str) -> Column:
    return F.substring(F.sha2(_c(x), 256), 1, 16)
