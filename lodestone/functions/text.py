"""Scalar text functions as Catalyst expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Fixed value: what a search token is.
TOKEN = r"\.?[a-zA-Z0-9_]+(?:[-./][a-zA-Z0-9_]+)*(?:\+\+|#)?"
#: Every sign that counts as white space in text processing, also beyond ASCII.
SPACES = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
MAX_DOCUMENT_CHARS = 4000


@cache
def _compatible() -> dict[str, str]:
    """Characters whose compatibility form holds ASCII, and that form."""
    out = {}
    for code in range(128, sys.maxunicode + 1):
        form = unicodedata.normalize("NFKC", chr(code))
        if form != chr(code) and any(c.isascii() for c in form):
            out[chr(code)] = form
    return out


def normalize(text: Column) -> Column:
    """Compatibility forms of single characters, then small letters. Only rows with a character in one of a few ranges around those take the slow branch."""
    known = _compatible()
    codes = sorted(map(ord, known))
    runs: list[list[int]] = []
    for c in codes:
        if runs and c <= runs[-1][1] + 100:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    found = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"
    keys, forms = (F.split(F.lit("\n".join(x)), "\n") for x in (known.keys(), known.values()))
    table = F.map_from_arrays(keys, forms)
    mapped = F.array_join(F.transform(F.split(text, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")
    return F.lower(F.when((F.octet_length(text) > F.length(text)) & text.rlike(found), mapped).otherwise(text))


def tokens_of(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(TOKEN), F.lit(0))


def tokenize(text: Column) -> Column:
    """Array of search tokens; null for null."""
    return tokens_of(normalize(text))


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends, null as empty; letters keep their case."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACES}+", " "))


normalize_query = squeeze


def sha_id(text: Column) -> Column:
    return F.sha2(text, 256)


@F.pandas_udf(LongType())
def int64_id(text: pd.Series) -> pd.Series:
    """A signed 64-bit number for a text id: its 8-byte BLAKE2b digest, little endian; null for null."""
    return text.map(lambda t: None if t is None else int.from_bytes(blake2b(t.encode(), digest_size=8).digest(), "little", signed=True)).astype("Int64")


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def logit(p: Column, floor: float = 1e-9) -> Column:
    held = F.least(F.greatest(p, F.lit(floor)), F.lit(1 - floor))
    return F.log(held / (1.0 - held))


def truncated(text: Column, most: int = MAX_DOCUMENT_CHARS) -> Column:
    return F.substring(text, 1, most)


def escape_html(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def highlight(snippet: Column, matches: Column) -> Column:
    """Escaped snippet with every match, whatever its case, in mark tags."""
    safe = escape_html(F.coalesce(snippet, F.lit("")))
    quoted = F.transform(matches, lambda t: F.regexp_replace(escape_html(t), r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    marked = F.regexp_replace(safe, F.concat(F.lit("(?i)("), F.array_join(quoted, "|"), F.lit(")")), F.lit("<mark>$1</mark>"))
    return F.when(F.coalesce(F.size(matches), F.lit(0)) > 0, marked).otherwise(safe)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A column of a value that is computed once, however often the body names it: expressions that are named again are computed again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def snippet(content: Column, terms: Column, window: int = 75, plain: int = 150) -> Column:
    """Struct of text and matches: a window around the first term (in query order) that the content holds as a substring."""
    found = lambda low: F.filter(terms, lambda t: F.contains(low, t))

    def cut(c: Column, n: Column, begin: Column, stop: Column) -> Column:
        inner = F.regexp_replace(F.substring(c, begin + 1, stop - begin), f"^{SPACES}+|{SPACES}+$", "")
        return F.concat(F.when(begin > 0, "...").otherwise(""), inner, F.when(stop < n, "...").otherwise(""))

    def at_words(c: Column, n: Column, pos: Column, begin: Column, stop: Column) -> Column:
        """From behind the first space before the term, to the first space behind the window."""
        ahead, behind = F.instr(F.substring(c, begin + 1, pos - begin), F.lit(" ")), F.instr(F.substring(c, stop + 1, n), F.lit(" "))
        first, last = let(ahead, lambda k: F.when((begin > 0) & (k > 0), begin + k).otherwise(begin)), let(behind, lambda k: F.when((stop < n) & (k > 0), stop + k - 1).otherwise(stop))
        return let(F.struct(first.alias("begin"), last.alias("stop")), lambda w: cut(c, n, w["begin"], w["stop"]))

    def around(c: Column, n: Column, hit: Column, pos: Column) -> Column:
        window_at = F.struct(F.greatest(F.lit(0), pos - window).alias("begin"), F.least(n, pos + F.length(hit) + window).alias("stop"))
        return let(window_at, lambda w: at_words(c, n, pos, w["begin"], w["stop"]))

    def shown(c: Column, n: Column, low: Column, hit: Column) -> Column:
        text = let(F.instr(low, hit) - 1, lambda pos: around(c, n, hit, pos))
        return let(text, lambda t: F.struct(t.alias("text"), let(F.lower(t), found).alias("matches")))

    def of(c: Column, n: Column, low: Column) -> Column:
        none = F.struct(F.concat(F.substring(c, 1, plain), F.when(n > plain, "...").otherwise("")).alias("text"), F.array().cast("array<string>").alias("matches"))
        return let(F.get(found(low), F.lit(0)), lambda hit: F.when(hit.isNull(), none).otherwise(shown(c, n, low, hit)))

    return let(F.coalesce(content, F.lit("")), lambda c: let(F.struct(F.length(c).alias("n"), F.lower(c).alias("low")), lambda s: of(c, s["n"], s["low"])))
