"""Name, address and identifier normalisation as columns: arrays of strings in, arrays out.

Everything here is built-in functions, so it stays in generated code. Lengths count bytes or characters
as each function's doc says; both are deliberate.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters dropped before splitting, and the categories that split names.
IGNORED = "[.'’\"ʿ]"
SEPARATOR = r"[\p{Cc}\p{Mc}\p{Z}\p{P}\p{Sm}\p{So}]"
_NOT_WORD = r"[^\p{IsAlphabetic}\p{N}\p{IsWhite_Space}]"
_NOT_ALNUM = r"[^\p{IsAlphabetic}\p{N}]"
_MODERN = r"[\p{IsLatin}\p{IsGreek}\p{IsArmenian}\p{IsCyrillic}]"

# Latin letters for lower-case Cyrillic and Greek ones.
_CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґ", "a b v g d e zh z i y k l m n o p r s t u f kh ts ch sh shch \" y ' e yu ya e i i e g".split(), strict=True))
_GREEK = dict(zip("αβγδεζηθικλμνξοπρστυφχψως", "a b g d e z i th i k l m n x o p r s t y f ch ps o s".split(), strict=True))
_LATIN = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "þ": "th", "ð": "d", "ı": "i", "ŋ": "ng", "ħ": "h", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "ʿ": "'"}


@cache
def latin_table() -> dict[str, str]:
    """ASCII for Latin with marks, Cyrillic, Greek and kana, from the Unicode tables by rule."""
    out = dict(_LATIN)
    for table in (_CYRILLIC, _GREEK):
        out |= table
    for k, v in list(out.items()):
        if k.upper() != k and len(k.upper()) == 1:
            out[k.upper()] = v[:1].upper() + v[1:]
    for code in [*range(0xA0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0xFF01, 0xFF5F)]:
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c not in out and base != c:
            out[c] = "".join(out.get(x, x if x.isascii() else "") for x in base)
    for code in range(0x3041, 0x30FF):
        name = unicodedata.name(chr(code), "")
        if " LETTER " in name:
            out[chr(code)] = name.rpartition(" ")[2].lower().replace("n" if name.endswith(" LETTER N") else "\0", "n")
    return {k: v for k, v in out.items() if v is not None}


def _array(values) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def latinize(x: Column) -> Column:
    """ASCII as it is; other letters by `latin_table`; combining marks dropped."""
    table = latin_table()
    one = {k: v for k, v in table.items() if len(v) == 1}
    more = F.from_json(F.lit(json.dumps({k: v for k, v in table.items() if len(v) != 1})), "map<string, string>")
    other = r"[^\x00-\x7F]"
    first = F.translate(x, "".join(one), "".join(one.values()))
    letters = F.transform(F.split(first, ""), lambda c: F.when(c.rlike(other), F.coalesce(F.try_element_at(more, c), c)).otherwise(c))
    rest = F.when(first.rlike(other), F.regexp_replace(F.array_join(letters, ""), r"\p{Mn}", "")).otherwise(first)
    return F.when(x.rlike(other), rest).otherwise(x)


def unaccent(x: Column) -> Column:
    """Marks off Latin letters; other scripts as they are."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code):
            pairs[chr(code)] = base
    return F.translate(x, "".join(pairs), "".join(pairs.values()))


def tokens(x: Column) -> Column:
    """A name without ignored characters, split at separators; empty tokens stay."""
    return F.split(F.regexp_replace(x, IGNORED, ""), SEPARATOR, -1)


def tokenize_names(names: Column) -> Column:
    return F.transform(_array(names), tokens)


def _clean(x: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(F.lower(x), IGNORED, ""), SEPARATOR, " ")
    return F.regexp_replace(x, _NOT_WORD, "")


def clean_names(names: Column) -> Column:
    """Latin, lower case, each separator a space (so doubles stay), only letters, digits and spaces; distinct."""
    return F.array_distinct(F.transform(_array(names), lambda x: _clean(latinize(x))))


def clean_names_light(names: Column) -> Column:
    """`clean_names` in the names' own script."""
    return F.array_distinct(F.transform(_array(names), _clean))


def clean_literal_names(names: Column) -> Column:
    """Lower case, with everything but letters, digits and white space deleted; distinct."""
    return F.array_distinct(F.transform(_array(names), lambda x: F.regexp_replace(F.lower(x), _NOT_WORD, "")))


def clean_address_parts(values: Column) -> Column:
    """Latin, lower case, every other character a space; distinct."""
    return F.array_distinct(F.transform(_array(values), lambda x: F.regexp_replace(F.lower(latinize(x)), _NOT_WORD, " ")))


def tokenize_clean_names(names: Column) -> Column:
    """Words of two bytes or more, Latin, lower case, letters and digits only; distinct."""
    split = F.flatten(F.transform(_array(names), lambda x: F.split(F.trim(F.regexp_replace(x, r"\p{IsWhite_Space}+", " ")), " ")))
    out = F.transform(split, lambda x: F.regexp_replace(F.lower(latinize(x)), _NOT_WORD, ""))
    return F.array_distinct(F.filter(out, lambda x: F.octet_length(x) >= 2))


def normalize_identifiers(values: Column) -> Column:
    """Latin letters and digits, upper case, two bytes or more; distinct."""
    out = F.transform(_array(values), lambda x: F.upper(F.regexp_replace(latinize(x), _NOT_ALNUM, "")))
    return F.array_distinct(F.filter(out, lambda x: F.octet_length(x) >= 2))


def _part(x: Column) -> Column:
    return F.regexp_replace(F.lower(latinize(x)), _NOT_WORD, "")


def name_parts(names: Column) -> Column:
    """The cleaned tokens of each name, empty ones too; distinct lists."""
    return F.array_distinct(F.transform(tokenize_names(names), lambda t: F.transform(t, _part)))


def name_parts_flat(names: Column) -> Column:
    """Cleaned tokens that had more than one character; distinct."""
    return F.array_distinct(F.transform(F.filter(F.flatten(tokenize_names(names)), lambda x: F.char_length(x) > 1), _part))


def is_modern(x: Column) -> Column:
    """Whether a token's letters are Latin, Greek, Armenian or Cyrillic; without letters it is."""
    letters = F.length(F.regexp_replace(x, r"\P{L}", ""))
    return 2 * F.length(F.regexp_replace(x, "[^" + _MODERN[1:-1] + "]", "")) >= letters


def _index_part(x: Column) -> Column:
    return F.lower(F.when(is_modern(x), latinize(x)).otherwise(x))


def index_name_keys(names: Column) -> Column:
    """Each name's tokens, sorted and joined; more than five bytes."""
    keys = F.transform(tokenize_names(names), lambda t: F.array_join(F.array_sort(F.transform(t, _index_part)), ""))
    return F.filter(keys, lambda x: F.octet_length(x) > 5)


def index_name_parts(names: Column) -> Column:
    """Tokens of more than one character, lower case; distinct."""
    return F.array_distinct(F.transform(F.filter(F.flatten(tokenize_names(names)), lambda x: F.char_length(x) > 1), _index_part))


def soundex_codes(parts: Column) -> Column:
    """Soundex of each part's ASCII letters; a part without letters has the empty code."""
    return F.transform(parts, lambda x: F.soundex(F.regexp_replace(x, "[^A-Za-z]", "")))


def extract_numbers(values: Column) -> Column:
    """All runs of digits; distinct."""
    return F.array_distinct(F.flatten(F.transform(_array(values), lambda x: F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1)))))


def flip_date(x: Column) -> Column:
    """MMDD to DDMM, what follows stays."""
    return F.concat(F.substring(x, 3, 2), F.substring(x, 1, 2), x.substr(F.lit(5), F.length(x)))


def _append(values: Column) -> Callable[[Column], Column]:
    """To each of some names, each of the values."""
    return lambda a: F.transform(values, lambda b: F.when(a == "", b).otherwise(F.concat_ws(" ", a, b)))


def combine_names(properties: Column, limit: Column) -> Column:
    """Full names from name parts: all combinations of first, second, middle, father's, mother's and last names.

    limit: the number of names the entity has; with over 20, or without any part, the array is empty.
    """
    none = F.array().cast("array<string>")
    out = F.array(F.lit(""))
    for prop in ("firstName", "secondName", "middleName", "fatherName", "motherName", "lastName"):
        values = _array(F.try_element_at(properties, F.lit(prop)))
        longer = F.flatten(F.transform(out, _append(values)))
        out = F.when(F.size(values) > 0, longer).otherwise(out)
    return F.when(limit > 20, none).otherwise(F.filter(out, lambda x: x != ""))


def format_score(x: Column) -> Column:
    """Three decimals, halves up, for display only."""
    return F.round(x, 3)
