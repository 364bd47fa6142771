"""Column expressions for tokenising and small string tasks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import TokenizerConfig

WORD = r"[\p{L}0-9]+"
WORD_OR_MARK = r"[\p{L}0-9]+|[!-/:-@\[-`{-~]"

# Letters without a canonical decomposition and their plain forms, fixed values.
_PLAIN = dict(zip("ÆÐØÞßæðøþĐđĦħıĲĳĸŁłĿŀŉŊŋŒœŦŧſ", "EDOTSedotDdHhiJjkLlLlnNnOoTts", strict=True))

#: Patterns of non-standard words, in the order in which they are tried, fixed values.
STANDARD_PATTERNS = (
    r"https?([^\s\w]+\w+)+(\w+|[^\w\s])",
    r"\d{2}:\d{2}:\d{2}",
    r"\w+(\-\w+)+",
    r"[\+\$]\d+",
    r"\w+'\w+",
    r"'em",
    r"\d+(\,\d{3})+",
    r"\d+(\.\d+)+",
    r"(\w+\.\w+|\w+|\w+\..\w+)@(\w+)(\.\w+)*",
    r"\w+\.\w+\.?",
    r"(?<=\b)\d+/\d+",
)


def diacritics() -> tuple[str, str]:
    """Letters from U+00C0 to U+017E that carry marks, and their plain letters, position by position."""
    marked, plain = [], []
    for point in range(0xC0, 0x17F):
        letter = chr(point)
        base = _PLAIN.get(letter) or unicodedata.normalize("NFD", letter)[0]
        if letter.isalpha() and base != letter:
            marked.append(letter)
            plain.append(base)
    return "".join(marked), "".join(plain)


def token_array(text: Column, config: TokenizerConfig | None = None) -> Column:
    """The terms of a text in order, as an array. A null text has none."""
    config = config or TokenizerConfig()
    text = F.coalesce(text, F.lit(""))
    if not config.flush_last:
        text = F.regexp_replace(text, r"[\p{L}!-~]+\z", "")
    if config.remove_diacritics:
        text = F.translate(text, *diacritics())
    if config.case_folding:
        text = F.lower(text)
    plain = F.regexp_extract_all(text, F.lit(WORD if config.remove_punctuation else WORD_OR_MARK), 0)
    if not config.patterns:
        return plain
    # only texts that hold a match go through Python; for the others it gets nulls
    some = F.lit(False)
    for p in config.patterns:
        some = some | text.rlike(f"(?:{p})")
    special = _pattern_tokens(config.patterns, config.remove_punctuation)
    return F.coalesce(special(F.when(some, text)), plain)


def prepared(text: Column, config: TokenizerConfig | None = None) -> Column | None:
    """The text of which ``token_array`` takes the runs of letters and digits; None if its tokens are others."""
    config = config or TokenizerConfig()
    if config.patterns or not config.remove_punctuation or not config.case_folding:
        return None
    text = F.coalesce(text, F.lit(""))
    if not config.flush_last:
        text = F.regexp_replace(text, r"[\p{L}!-~]+\z", "")
    return F.lower(F.translate(text, *diacritics()) if config.remove_diacritics else text)


def chunk_tokens(chunk: str, patterns: list[re.Pattern], plain: re.Pattern) -> list[str]:
    """Terms of a chunk: the first pattern in order that is found anywhere is cut out whole; what precedes it is cut
    plainly, and what follows is treated like a chunk again."""
    out: list[str] = []
    while chunk:
        found = next((m for p in patterns if (m := p.search(chunk)) and m.end() > m.start()), None)
        if found is None:
            return out + plain.findall(chunk)
        out += plain.findall(chunk[: found.start()])
        out.append(found.group())
        chunk = chunk[found.end() :]
    return out


def _pattern_tokens(patterns: Iterable[str], drop_marks: bool):
    sources = list(patterns)

    @F.pandas_udf("array<string>")
    def tokens(texts: pd.Series) -> pd.Series:
        compiled = [re.compile(p, re.ASCII) for p in sources]
        chunks = re.compile(r"(?:[^\W\d_]|[!-~])+")
        plain = re.compile(r"(?:[^\W\d_]|[0-9])+" if drop_marks else r"(?:[^\W\d_]|[0-9])+|[!-/:-@\[-`{-~]")
        return texts.map(lambda t: None if t is None else [x for c in chunks.findall(t) for x in chunk_tokens(c, compiled, plain)])

    return tokens


def basename(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def shorten(text: Column, size: int = 50) -> Column:
    """Texts beyond ``size`` characters cut there, with three dots."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def glob_regex(glob: str) -> str:
    """A whole-word regular expression of a glob in which ``*`` stands for any letters; all else is literal."""
    return "^(?:" + ".*".join(re.escape(p) for p in glob.split("*")) + ")$"


def parse_query(text: str) -> list[str]:
    """Lower-cased words at white space."""
    return text.lower().split()
