"""Text columns. Built-in expressions wherever these can say it; Arrow functions for the rest."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioqc.params import DEFAULT

#: White space as str.split() sees it.
WS = "(?U)[\\s\\x1C-\\x1F]+"
# Letters of other scripts that look like Latin ones, and these.
QUOTES, PLAIN_QUOTES = "’“”–—", "'\"\"--"
CONFUSABLE = "АВСЕНКМОРТХаеорсухіΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
LATIN = "ABCEHKMOPTXaeopcyxiABEZHIKMNOPTYX"
#: Fixed value: a number with its signs, unit letter and brackets.
NUMBER = "(?i)[\\$\\(]?-?\\d[\\d,]*\\.?\\d*[%\\)BMK]?"
# Words by which a remark is about colour or about layout.
COLOUR_WORDS = ("color", "colour", "shade", "font color", "text color")
LAYOUT_WORDS = ("position", "alignment", "aligned", "shifted", "too far", "narrower", "wider", "wrap", "wrapped", "line break", "line-break")
REVIEW_TITLE = "AI review findings"


def collapse(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, WS, " "))


_PLAIN = str.maketrans(QUOTES, PLAIN_QUOTES)
_STRICT = {**dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF)), **_PLAIN}
_LATIN = str.maketrans(CONFUSABLE, LATIN)


def normalise_text(value: str | None) -> str:
    t = unicodedata.normalize("NFKC", value or "").translate(_PLAIN)
    return re.sub(r"\s+", " ", t).strip().casefold()


def normalise_strict(value: str | None) -> str:
    """Also drops invisible characters and rejoins words that a line break hyphenated."""
    t = unicodedata.normalize("NFKC", value or "").translate(_STRICT)
    t = re.sub(r"([A-Za-z])-\s+([A-Za-z])", r"\1-\2", t)
    return re.sub(r"\s+", " ", t).strip().casefold()


def _arrow(f) -> object:
    """An Arrow function of non-null strings; nulls, which stand for rows of no concern, stay."""
    return F.pandas_udf(lambda t: t.map(f, na_action="ignore"), T.StringType())


_normalise, _normalise_strict = _arrow(normalise_text), _arrow(normalise_strict)
_latin_casefold = _arrow(lambda v: unicodedata.normalize("NFKC", v).translate(_LATIN).casefold())


def _by_script(t: Column, plain, whole) -> Column:
    """plain(t), a built-in expression, for ASCII text; whole(t), a Python function, for the rest.
    Python gets the other rows' text only."""
    t = F.coalesce(t, F.lit(""))
    other = non_ascii(t)
    return F.when(other, whole(F.when(other, t))).otherwise(plain(t))


def _foldings() -> tuple[str, str, dict[str, str]]:
    """Letters of the basic plane that folding case changes and lower() does not: those that become
    one letter, these letters, and those that become several."""
    found = {c: c.casefold() for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and c.casefold() != c and c == c.lower()}
    one = {c: f for c, f in found.items() if len(f) == 1}
    return "".join(one), "".join(one.values()), {c: f for c, f in found.items() if len(f) > 1}


_FOLD_FROM, _FOLD_TO, _FOLD_MORE = _foldings()


def casefolded(t: Column) -> Column:
    """Folded case by built-in expressions, usable inside of lambdas as well."""
    folded = F.translate(F.lower(t), _FOLD_FROM, _FOLD_TO)
    for c, f in _FOLD_MORE.items():
        folded = F.replace(folded, F.lit(c), F.lit(f))
    return F.when(t.rlike("[^\\x00-\\x7F]"), folded).otherwise(F.lower(t))


def normalised(t: Column) -> Column:
    return _by_script(t, lambda x: F.lower(collapse(x)), _normalise)


def normalised_strict(t: Column) -> Column:
    joined = lambda x: F.regexp_replace(x, "([A-Za-z])-[\\s\\x1C-\\x1F]+([A-Za-z])", "$1-$2")
    return _by_script(t, lambda x: F.lower(collapse(joined(x))), _normalise_strict)


def normalised_fast(t: Column) -> Column:
    """As normalised, for text in composed form whose only folding beyond lower() is sharp s."""
    plain = F.translate(F.coalesce(t, F.lit("")), QUOTES, PLAIN_QUOTES)
    return F.replace(F.lower(collapse(plain)), F.lit("ß"), F.lit("ss"))


def clean(t: Column) -> Column:
    return collapse(F.replace(t, F.lit("\u00a0"), F.lit(" ")))


def split_lines(t: Column) -> Column:
    """Non-blank trimmed lines, or the whole text if there is none."""
    lines = F.filter(F.transform(F.split(t, "[\\r\\n\\x0B]+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(lines) == 0, F.array(t)).otherwise(lines)


def trimmed(t: Column, most: int = DEFAULT.trimmed) -> Column:
    short = collapse(t)
    return F.when(F.length(short) > most, F.concat(F.rtrim(F.substring(short, 1, most - 1)), F.lit("…"))).otherwise(short)


def solid_length(t: Column) -> Column:
    return F.length(F.regexp_replace(t, WS, ""))


def number_tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(NUMBER), F.lit(0))


def non_ascii(t: Column) -> Column:
    return F.coalesce(t, F.lit("")).rlike("[^\\x00-\\x7F]")


def confusable(a: Column, b: Column) -> Column:
    """Equal once look-alike letters of composed texts are made Latin and case is folded, though the texts differ."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return (_by_script(a, F.lower, _latin_casefold) == _by_script(b, F.lower, _latin_casefold)) & (a != b)


def short_symbol_label(a: Column, b: Column) -> Column:
    both = F.regexp_replace(F.concat(a, b), WS, "")
    return (F.length(both) <= 12) & both.rlike("[$%()]")


def mismatch_label(a: Column, b: Column, score: Column) -> Column:
    # The labels.
    return (
        F.when(number_tokens(a) != number_tokens(b), "numeric-token mismatch")
        .when(non_ascii(a) | non_ascii(b) | confusable(a, b), "possible unicode/confusable-character mismatch")
        .when(short_symbol_label(a, b), "short label or symbol-level text mismatch")
        .when(score >= 0.82, "likely line-level typo/spelling difference")
        .otherwise("line-level text mismatch")
    )


def font_name(name: Column) -> Column:
    """What follows the first plus sign, or the whole name if nothing does."""
    name = F.coalesce(name, F.lit(""))
    after = F.when(F.contains(name, F.lit("+")), F.regexp_replace(name, "^[^+]*\\+", "")).otherwise("")
    return F.coalesce(non_blank(F.coalesce(F.nullif(after, F.lit("")), name)), F.lit("Unknown Font"))


def font_is_subset(name: Column) -> Column:
    """Six characters without small letters, at least one of them a capital, before the first plus sign or the end."""
    prefix = F.substring_index(F.coalesce(name, F.lit("")), "+", 1)
    return (F.length(prefix) == 6) & (F.upper(prefix) == prefix) & (F.lower(prefix) != prefix)


def _mentions(t: Column, words: tuple[str, ...]) -> Column:
    # The words are ASCII, so folding case beyond lower() cannot make or hide one, but for a long s.
    low = F.replace(F.lower(t), F.lit("ſ"), F.lit("s"))
    found = F.lit(False)
    for w in words:
        found = found | F.contains(low, F.lit(w))
    return found


def kept_bullets(bullets: Column, has_colour: Column) -> Column:
    """Bullets without remarks on layout, nor on colour unless a colour finding is kept."""
    return F.filter(bullets, lambda b: ~_mentions(b, LAYOUT_WORDS) & (has_colour | ~_mentions(b, COLOUR_WORDS)))


def first_of_each(bullets: Column) -> Column:
    """The first of bullets that are equal but for case."""
    folded = F.transform(bullets, casefolded)
    return F.get(F.transform(F.array(folded), lambda keys: F.filter(bullets, lambda b, i: F.array_position(keys, F.get(keys, i)) == i + 1)), F.lit(0))


def note_text(summary: Column, bullets: Column) -> Column:
    return F.when(summary.isNotNull(), F.concat_ws("\n", F.array(summary), F.transform(bullets, lambda b: F.concat(F.lit("- "), b))))


def non_blank(t: Column) -> Column:
    return F.nullif(F.trim(t), F.lit(""))


def filled(given: Column, default: Column) -> Column:
    return F.coalesce(non_blank(given), default)


def too_long(t: Column, most: int) -> Column:
    """The fault of a text over a limit, or null."""
    return F.when(F.length(t) > most, "too long")


def camel_case(df: DataFrame) -> DataFrame:
    """df with its columns' names in camel case."""
    return df.withColumnsRenamed({c: re.sub("_([a-z0-9])", lambda m: m[1].upper(), c) for c in df.columns})


def fingerprint(*parts) -> Column:
    return F.concat_ws("::", *parts)


def prompt_suffix(override: Column) -> Column:
    return F.when(non_blank(override).isNotNull(), F.concat(F.lit("\n\nAdditional run-specific user QC instructions:\n"), F.trim(override))).otherwise("")


def natural_key(name: Column) -> Column:
    """A text whose order is that of the name's parts, texts (in lower case) and numbers in turn:
    numbers of any length carry the number of their digits before them, texts end with a zero byte."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("([^0-9]*)([0-9]*)"), F.lit(0))

    def key(part: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(part, "[0-9]+$", 0), "^0+(?=[0-9])", "")
        return F.concat(F.regexp_replace(part, "[0-9]+$", ""), F.lit("\x00"), F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    return F.array_join(F.transform(F.filter(parts, lambda p: p != ""), key), "")


def output_name(path: Column) -> Column:
    return F.concat(F.regexp_replace(F.regexp_replace(path, "^.*/", ""), "\\.[^.]*$", ""), F.lit("_with_pdf_pages.pptx"))


def file_kind(name: Column) -> Column:
    low = F.lower(name)
    return F.when(F.endswith(low, F.lit(".pdf")), "pdf").when(F.endswith(low, F.lit(".pptx")), "pptx").otherwise("unsupported")


def flag(value: Column, default: bool = False) -> Column:
    """A switch of the environment; blank ones have the default."""
    return F.coalesce(F.lower(non_blank(value)).isin("1", "true", "yes", "on"), F.lit(default))


#: Other names of platforms.
PLATFORMS = {"mac": "darwin", "macos": "darwin", "osx": "darwin", "win": "windows", "win32": "windows"}


def platform_name(override: Column, system: Column) -> Column:
    raw = F.coalesce(F.lower(non_blank(override)), F.lower(system))
    names = F.create_map(*(F.lit(v) for pair in PLATFORMS.items() for v in pair))
    return F.coalesce(names[raw], raw)


def script_escaped(t: Column) -> Column:
    return F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def percent_done(done: Column, total: Column) -> Column:
    return F.least(F.lit(100), F.round(done * 100.0 / F.greatest(total, F.lit(1))).cast("int"))


def job_identifier(at: Column, token: Column) -> Column:
    return F.concat(F.date_format(at, "yyyyMMddHHmmss"), F.lit("-"), F.substring(token, 1, 8))


def data_url(content: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.translate(F.base64(content), "\r\n", ""))


def retryable(kind: Column, message: Column, by_model: Column, can_build: Column) -> Column:
    """If a failed assembly may be tried again natively: a broken package, or a bad check sum in its media."""
    media = F.contains(message, F.lit("Bad CRC-32 for file 'ppt/media/")) | (F.contains(message, F.lit("bad CRC")) & F.contains(message, F.lit("ppt/media/")))
    return ~by_model & can_build & ((kind == "BadZipFile") | media)


def chosen_pair(kinds: Column) -> Column:
    """The fault of a choice of files, by their kinds in order, or null if it may go on."""
    count = lambda k: F.size(F.filter(kinds, lambda x: x == k))
    # The messages.
    return (
        F.when(count("unsupported") > 0, "Only one PDF and one PPTX file are supported.").when(count("pdf") > 1, "Please drop only one PDF file.")
        .when(count("pptx") > 1, "Please drop only one PPTX file.").when(F.size(kinds) == 0, "Please choose a PDF and a PPTX file.")
    )
