"""Tokenizers and text statistics as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The English stop-word preset.
STOPWORDS = {
    "en": "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split(),
    "none": [],
}
BLANK = r"[\s\x0b\x{85}\p{Z}]+"
# The characters of the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(c: Column) -> Column:
    """A text without white space at its ends."""
    return F.btrim(c, F.lit(WHITE))


def plain_id(value: str) -> str:
    """The one spelling of a universally unique id: lower case, with hyphens, without braces or a URN's head."""
    import uuid

    try:
        return str(uuid.UUID(value))
    except ValueError:
        return value


def _nonempty(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t != "")


def word(c: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return _nonempty(F.split(F.lower(c), r"[^\p{L}\p{N}]+"))


def lowercase(c: Column) -> Column:
    return _nonempty(F.split(F.lower(c), BLANK))


def whitespace(c: Column) -> Column:
    return _nonempty(F.split(c, BLANK))


def field(c: Column) -> Column:
    """The trimmed value as one token."""
    return F.array(trimmed(c))


def trigram(c: Column) -> Column:
    """Sliding windows of three letters or digits, lower-cased."""
    # The look-ahead takes no characters, so one scan finds windows that overlap.
    return F.regexp_extract_all(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ""), F.lit(r"(?=(...))"), 1)


TOKENIZERS: dict[str, Callable[[Column], Column]] = {"word": word, "lowercase": lowercase, "whitespace": whitespace, "field": field, "trigram": trigram}


def register_tokenizer(name: str, make: Callable[[Column], Column]) -> None:
    """Dictionary tokenizers need dictionaries that are not shipped; register one here to use its name."""
    TOKENIZERS[name] = make


def tokens(c: Column | str, tokenization: str = "word") -> Column:
    if tokenization not in TOKENIZERS:
        raise ValueError(f"tokenization {tokenization!r} is not configured")
    return TOKENIZERS[tokenization](F.col(c) if isinstance(c, str) else c)


def stopwords(preset: str = "en", additions: list[str] = (), removals: list[str] = ()) -> list[str]:
    return sorted((set(STOPWORDS[preset]) | set(additions)) - set(removals))


def query_tokens(text: str, tokenization: str = "word") -> list[str]:
    """The driver-side twin for a query string."""
    import regex

    blanks = r"[\s\x0b\x85\p{Z}]+"
    if tokenization == "word":
        return [t for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t]
    if tokenization == "lowercase":
        return [t for t in regex.split(blanks, text.lower()) if t]
    if tokenization == "whitespace":
        return [t for t in regex.split(blanks, text) if t]
    if tokenization == "field":
        return [text.strip(WHITE)]
    if tokenization == "trigram":
        s = regex.sub(r"[^\p{L}\p{N}]+", "", text.lower())
        return [s[i : i + 3] for i in range(len(s) - 2)]
    raise ValueError(f"tokenization {tokenization!r} is not configured")


def wildcard_tokens(pattern: str, tokenization: str = "word") -> list[str]:
    """Query tokens that keep the wildcards ? and *."""
    import regex

    if tokenization == "word":
        return [t for t in regex.split(r"[^\p{L}\p{N}?*]+", pattern.lower()) if t]
    if tokenization == "trigram":
        return [regex.sub(r"[^\p{L}\p{N}?*]+", "", pattern.lower())]
    return query_tokens(pattern, tokenization)


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenization: str = "word") -> DataFrame:
    """(id, term, tf) with duplicates counted."""
    return df.select(id_col, F.explode(tokens(text_col, tokenization)).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
