"""Text expressions: pattern scans with offsets, normalisation, origins, decoding.

All of it stays in Catalyst expressions except Unicode NFKD, which Spark has no
built-in for and which runs as one Arrow UDF on the non-ASCII rows only.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgrain import constants as K

# Java's \b looks at Unicode letters while the published patterns mean ASCII
# word characters, so the boundary is spelled out with ASCII look-arounds.
ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"

# JavaScript's notion of white space, for trim().
JS_SPACES = (
    "\t\n\x0b\x0c\r           "
    "       　﻿"
)


# What a match can begin with, tested before the boundary: a position that cannot
# start a match is then dismissed on one character.
_FIRST = {
    K.PHONE_PATTERN: r"(?=[0-9(+])",
    K.CARD_PATTERN: r"(?=[0-9])",
    K.PASSPORT_PATTERN: r"(?=[A-Za-z][0-9])",
    K.SECRET_PATTERN: r"(?=[PpSs])",
}


# The boundary before an address together with what can follow it, and a name without
# backtracking: "@" is none of its characters, so a shorter name cannot match either.
_EMAIL_START = (r"\b[A-Za-z0-9._%+-]+@", r"(?:(?<!\w)(?=\w)|(?<=\w)(?=[.%+-]))[A-Za-z0-9._%+-]++@")


def java_pattern(pattern: str) -> str:
    """Rewrite an ASCII-dialect pattern so that Java finds the same matches."""
    if pattern == K.EMAIL_PATTERN:
        pattern = pattern.replace(*_EMAIL_START)
    return _FIRST.get(pattern, "") + pattern.replace(r"\b", ASCII_BOUNDARY)


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of every match of ``pattern`` in ``text``."""
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(group))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Higher-order functions are interpreted, where common sub-expressions are not
    shared; a lambda variable is.
    """
    return F.transform(F.array(value), body)[0]


def located_matches(text: Column, pattern: str) -> Column:
    """Array of ``struct(raw, pos)``; ``pos`` is the 0-based code point offset.

    Text between matches comes from ``split`` with the same pattern, so match i
    starts after gaps 0..i and matches 0..i-1; a fold carries the running sum.
    """
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<raw:string,pos:int>>").alias("out")
    )

    def step(acc: Column, pair: Column) -> Column:
        at = acc["at"] + F.length(pair["gap"])
        return F.struct(
            (at + F.length(pair["raw"])).alias("at"),
            F.array_append(acc["out"], F.struct(pair["raw"].alias("raw"), at.alias("pos"))).alias("out"),
        )

    def positions(hits: Column) -> Column:
        gaps = F.split(text, java_pattern(pattern), -1)
        pairs = F.zip_with(
            hits,
            F.slice(gaps, 1, F.size(hits)),
            lambda h, g: F.struct(h.alias("raw"), g.alias("gap")),
        )
        return F.when(F.size(hits) > 0, F.aggregate(pairs, start, step, lambda acc: acc["out"]))

    return let(all_matches(text, pattern), positions)


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """First match or NULL."""
    return let(F.regexp_extract(text, java_pattern(pattern), group), lambda hit: F.when(hit != "", hit))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def last4(value: Column) -> Column:
    return F.substring(value, -4, 4)


def js_trim(value: Column) -> Column:
    return F.btrim(value, F.lit(JS_SPACES))


@F.pandas_udf(T.StringType())
def _nfkd(values: pd.Series) -> pd.Series:
    return values.map(lambda s: unicodedata.normalize("NFKD", s), na_action="ignore")


def nfkd(value: Column) -> Column:
    """NFKD; pure-ASCII strings (already normalised) never reach Python."""
    ascii_only = value.rlike(r"^\p{ASCII}*$")
    needs = F.when(~ascii_only, value)
    return F.when(ascii_only, value).otherwise(_nfkd(needs))


def fold_lookalikes(value: Column) -> Column:
    """Look-alike letters and digits to ASCII, lower case, trimmed."""
    mapped = F.translate(value, "".join(K.HOMOGLYPHS), "".join(K.HOMOGLYPHS.values()))
    return js_trim(F.lower(mapped))


def normalise_text(value: Column) -> Column:
    return F.coalesce(fold_lookalikes(nfkd(value)), F.lit(""))


def normalise_literal(term: str) -> str:
    """The same normalisation for a literal known on the driver."""
    folded = "".join(K.HOMOGLYPHS.get(c, c) for c in unicodedata.normalize("NFKD", term))
    return folded.lower().strip(JS_SPACES)


# scheme, host (name or bracketed address) and port of a plain web address; a
# user-info part makes it fail.
_ADDRESS = (
    r"(?s)^(?:([a-z][a-z0-9+.\-]*)://)?(\[[0-9a-f:.]+\]|[^:/?#\\@\s<>^|%\[\]]+)(?::([0-9]*))?(?:[/?#\\].*)?$"
)


def normalise_origin(value: Column) -> Column:
    """``scheme://host[:port]`` in lower case, or NULL when it is not a plain web origin.

    One pattern splits the address, and every part is bound once.
    """

    def shown(text: Column, parts: Column) -> Column:
        scheme = F.when(parts[0] == "", "https").otherwise(parts[0])
        default = ((scheme == "http") & (parts[2] == "80")) | ((scheme == "https") & (parts[2] == "443"))
        port = F.when((parts[2] == "") | default, "").otherwise(
            F.concat(F.lit(":"), parts[2].try_cast("int").cast("string"))
        )
        # Without a scheme in front, "://" further on makes the address invalid.
        stray = (parts[0] == "") & text.contains("://")
        in_range = (parts[2] == "") | (parts[2].try_cast("int") <= 65535)
        return F.when(
            scheme.isin("http", "https") & ~stray & in_range, F.concat(scheme, F.lit("://"), parts[1], port)
        )

    def split(text: Column) -> Column:
        parts = F.split(F.regexp_replace(text, _ADDRESS, "$1 $2 $3"), " ", -1)
        return F.when(text.rlike(_ADDRESS), let(parts, lambda p: shown(text, p)))

    return let(F.lower(js_trim(value)), split)


def percent_decode(value: Column) -> Column:
    """URI component decoding; NULL when the input is not well formed."""
    plain = F.replace(value, F.lit("+"), F.lit("%2B"))
    decoded = F.try_url_decode(plain)
    broken = decoded.contains("�") & ~value.contains("�")
    return F.when(value.contains("%"), F.when(~broken, decoded))


# One \uXXXX outside the surrogate range, or a surrogate pair. Longer runs fall into
# adjoining matches: the pattern engine recurses once per repetition.
_ESCAPE = (
    r"(?:\\u(?![dD][89a-fA-F])[0-9a-fA-F]{4}"
    r"|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}){1,500}"
)


def unescape_unicode(value: Column) -> Column:
    r"""Decode runs of ``\uXXXX``; unpaired surrogates are left as they are."""
    runs = F.regexp_extract_all(value, F.lit(_ESCAPE), F.lit(0))
    gaps = F.split(value, _ESCAPE, -1)

    def decoded(run: Column) -> Column:
        return F.decode(F.unhex(F.replace(run, F.lit("\\u"), F.lit(""))), "UTF-16BE")

    tail = F.zip_with(
        runs, F.slice(gaps, 2, F.size(runs)), lambda r, g: F.concat(decoded(r), g)
    )
    joined = F.concat(gaps[0], F.array_join(tail, ""))
    return F.when(value.contains("\\u"), F.when(value.rlike(_ESCAPE), joined))


# The letters of base64 strings, white space and line ends; a search for any other letter takes seven times as long.
_BASE64 = r"^[A-Za-z0-9+/=_\s\x{85}\x{2028}\x{2029}-]*+$"


def base64_text(value: Column, min_len: int = 4) -> Column:
    """Text hidden in a base64 string of any length, or NULL when it does not look like one.

    Bytes that are valid UTF-8 are read as such, others as Latin-1. Most texts are known by their
    first odd letter not to be one.
    """
    def bytes_of(packed: Column) -> Column:
        fits = (F.length(packed) >= min_len) & packed.rlike(r"^[A-Za-z0-9+/=_-]+$")
        standard = F.replace(F.replace(packed, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
        padded = F.rpad(standard, (F.ceil(F.length(standard) / F.lit(4)) * 4).cast("int"), F.lit("="))
        return F.try_to_binary(F.when(fits, padded), F.lit("base64"))

    def text_of(data: Column) -> Column:
        return F.coalesce(F.try_validate_utf8(data.cast("string")), F.decode(data, "ISO-8859-1"))

    # each step is bound, else the next one would derive it wherever it is named
    plain = let(let(F.regexp_replace(value, r"\s+", ""), bytes_of), text_of)
    shown = let(plain, lambda text: F.when(text.rlike(r"[\x20-\x7E]{3,}"), text))
    return F.when(value.rlike(_BASE64), shown)


def base64_of(data: Column) -> Column:
    """Base64 on one line, whatever the session says about chunking."""
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")


def uri_component(value: Column) -> Column:
    """Percent-encode as for a URI component (space as %20, marks kept)."""
    out = F.url_encode(value)
    for code, mark in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def contained_terms(text: Column, terms) -> Column:
    """Terms (a driver-side list of bounded size) that occur in ``text``.

    The text is bound first: inside of the filter it would be derived again for every term.
    """
    listed = F.array(*[F.lit(t) for t in terms])
    return let(text, lambda bound: F.filter(listed, lambda t: F.contains(bound, t)))


def contains_any(text: Column, terms) -> Column:
    """Whether any of a driver-side list of terms occurs in ``text``.

    One alternation instead of a chain of tests: long lists keep the generated
    code small enough to compile.
    """
    terms = list(terms)
    if len(terms) == 1:
        return text.contains(terms[0])
    return text.rlike("|".join(f"\\Q{t}\\E" for t in terms))
