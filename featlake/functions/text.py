"""Text functions as column expressions; pandas only where Unicode normal forms are needed."""

from __future__ import annotations

import contextlib
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "[EMPTY]"
#: Code-point ranges of scripts that examples leave out (Han, kana, Hangul and what goes with them).
EXCLUDED_SCRIPTS = (
    (0x1100, 0x11FF), (0x2E80, 0x2FFF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035), (0x3038, 0x303B), (0x3040, 0x318F),
    (0x31A0, 0x31FF), (0x3200, 0x33FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA960, 0xA97F), (0xAC00, 0xD7FF), (0xF900, 0xFAFF),
    (0xFF65, 0xFFDC), (0x16FE0, 0x16FFF), (0x1AFF0, 0x1AFFF), (0x1B000, 0x1B16F), (0x1F200, 0x1F2FF), (0x20000, 0x323AF),
)
#: The same as a pattern of Java and of RE2.
EXCLUDED = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in EXCLUDED_SCRIPTS) + "]"
#: The white space of Unicode, as a class of Java and of RE2.
WHITE = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def one_spaced(s: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(s, WHITE + "+", " "))


def normalise_space(s: Column) -> Column:
    """one_spaced; blank and null as a placeholder."""
    return F.coalesce(F.nullif(one_spaced(s), F.lit("")), F.lit(EMPTY))


def sanitise(s: Column, most: int | None = None) -> Column:
    """The first `most` characters (all by default) without white space at the ends; blank and null as a placeholder."""
    cut = s if most is None else F.substr(s, F.lit(1), F.lit(most))
    return F.coalesce(F.nullif(F.regexp_replace(cut, r"^[\t-\r ]+|[\t-\r ]+$", ""), F.lit("")), F.lit(EMPTY))


def excerpt(s: Column, most: int) -> Column:
    """s, or its beginning of most characters that ends in three dots."""
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.rtrim(F.substr(s, F.lit(1), F.lit(most - 3))), F.lit("...")))


def word_excerpt(s: Column, most: int) -> Column:
    """s with single spaces; if that is longer than most, its beginning of whole words and an ellipsis, most characters at most."""
    plain = one_spaced(s)
    head = F.substr(plain, F.lit(1), F.lit(most - 1))
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.rtrim(F.regexp_replace(head, " [^ ]*$", "")), F.lit("…")))


def caseless(s: Column) -> Column:
    """Lower case with sharp s as ss and final sigma as sigma; as case folding has it for Latin, Greek and Cyrillic letters."""
    return F.replace(F.replace(F.lower(s), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def focused_excerpt(s: Column, phrase: Column, most: int) -> Column:
    """s with single spaces, cut to `most` characters around the phrase's first occurrence in any case, three dots at cut
    ends; the whole text where the phrase is not in it."""
    plain = normalise_space(s)
    at = F.instr(caseless(plain), caseless(phrase)) - 1
    size = F.length(plain)
    stop = F.least(size, F.greatest(F.lit(0), at - most // 2) + most)
    start = F.greatest(F.lit(0), stop - most)
    head = F.when(start > 0, F.concat(F.lit("..."), F.substr(plain, start + 4, F.greatest(F.lit(0), stop - start - 3)))).otherwise(F.substr(plain, start + 1, stop - start))
    tail = F.when(stop < size, F.concat(F.substr(head, F.lit(1), F.greatest(F.lit(0), F.length(head) - 3)), F.lit("..."))).otherwise(head)
    return F.when(at >= 0, tail).otherwise(plain)


def ascii_word(s: Column) -> Column:
    return F.rlike(F.lower(F.trim(s)), F.lit("^[a-z]+$"))


def excluded_script(s: Column) -> Column:
    return F.rlike(s, F.lit(EXCLUDED))


def folded(s: Column) -> Column:
    """NFKC, single spaces and case folding."""

    @F.pandas_udf("string")
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold())

    return of(s)


#: Punctuation and what prints instead of it, and characters that stand for nothing.
PUNCTUATION = {"\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'", "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u201f": '"', "\u2013": "-", "\u2014": "--", "\u2026": "...", "\u00a0": " "}
SILENT = "\ufffd\ufeff\u200b\u2060"
#: Rounds of repair: text may have been misread more than once.
ROUNDS = 3
_LEADS = re.compile("[\u00c2-\u00f4]")


def _width(lead: str) -> int:
    """Bytes of a UTF-8 sequence by its first, given as the character it was misread as."""
    n = ord(lead)
    return 2 if n <= 0xDF else 3 if n <= 0xEF else 4


def _read_right(piece: str) -> str | None:
    """The one character that piece is when its Latin-1 or CP1252 bytes are read as UTF-8."""
    for code in ("latin-1", "cp1252"):
        with contextlib.suppress(UnicodeError):
            if len(right := piece.encode(code).decode("utf-8")) == 1:
                return right
    return None


def mend(text: str) -> str:
    """Text with every run of characters that are misread UTF-8 put right, in up to ROUNDS rounds; the rest as it is."""
    for _ in range(ROUNDS):
        out, done = [], 0
        for m in _LEADS.finditer(text):
            at = m.start()
            piece = text[at : at + _width(m.group())]
            if at >= done and len(piece) == _width(m.group()) and (right := _read_right(piece)) is not None:
                out += [text[done:at], right]
                done = at + len(piece)
        if not done:
            break
        text = "".join(out) + text[done:]
    return text


def cleaned(text: str) -> str:
    """Mended text in plain punctuation; white space as spaces, without controls, surrogates and silent characters."""
    plain = "".join(PUNCTUATION.get(c, c) for c in mend(text))
    return "".join(" " if c.isspace() else c for c in plain if c.isspace() or (c not in SILENT and unicodedata.category(c) not in ("Cc", "Cs")))


def repaired(s: Column) -> Column:
    """cleaned() of a column."""

    @F.pandas_udf("string")
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else cleaned(t))

    return of(s)


#: Characters that LaTeX reads as commands, and what prints them.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex(s: Column) -> Column:
    """Every special character by itself, so that what replaces one is not escaped again."""
    table = F.create_map(*(F.lit(x) for kv in LATEX.items() for x in kv))
    return F.array_join(F.transform(F.split(s, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


def category_id(level: Column, value: Column) -> Column:
    return F.concat_ws(":", level, value)


def category_parts(c: Column) -> tuple[Column, Column]:
    """Level and value of a category id; the value may hold colons."""
    return F.substring_index(c, ":", 1), F.substr(c, F.instr(c, ":") + 1)


def token_estimate(s: Column, chars_per_token: float) -> Column:
    return F.ceil(F.length(s) / chars_per_token)


def percent(x: Column) -> Column:
    """Whole percent of a share, half to even, between 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(x * 100).cast("int")))


def floor_float32(s: Column) -> Column:
    """The largest float32 that is not above a double, so that comparing float32 values with it equals comparing with the double."""

    @F.pandas_udf("float")
    def of(x: pd.Series) -> pd.Series:
        near = x.to_numpy(np.float64).astype(np.float32)
        return pd.Series(np.where(near.astype(np.float64) > x, np.nextafter(near, np.float32(-np.inf)), near))

    return of(s)


def script(s: Column) -> Column:
    """Which font family a text needs."""
    return F.when(F.rlike(s, F.lit("[\\u0400-\\u04FF]")), "cyrillic").when(F.rlike(s, F.lit("[\\u0370-\\u03FF]")), "greek").when(excluded_script(s), "cjk").when(F.rlike(s, F.lit("[\\u00C0-\\u024F]")), "latin-extended").otherwise("latin")
