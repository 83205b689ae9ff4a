"""Phrases replaced in a text one after another, as a pandas UDF: a regular expression for each pair and text costs more than the search itself."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of characters that words consist of, as in `(?U)\w`; joiners and letters in circles or squares are words' too.
KINDS = ("Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "Pc")
ENCLOSED = ((0x200C, 0x200D), (0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189))
PLAIN = re.compile(r"\w+", re.ASCII)
#: Characters at either end of a long part that are looked through for words first.
EDGE = 40


@cache
def is_word(c: str) -> bool:
    return unicodedata.category(c) in KINDS or any(a <= ord(c) <= b for a, b in ENCLOSED)


def words(text: str) -> list[str]:
    return PLAIN.findall(text) if text.isascii() else "".join([c if is_word(c) else " " for c in text]).split()


def pieces(text: str, phrase: str) -> list[str]:
    """What lies between the places where the phrase stands whole: without a word character on either side."""
    out, begin, at, n = [], 0, text.find(phrase), len(phrase)
    while at >= 0:
        end = at + n
        if (at == 0 or not is_word(text[at - 1])) and (end == len(text) or not is_word(text[end])):
            out.append(text[begin:at])
            begin = at = end
        else:
            at += 1
        at = text.find(phrase, at)
    return [*out, text[begin:]]


def runs(ws: list[str], most: int) -> set[str]:
    """Runs of one to `most` words, with blanks between."""
    out = set(ws)
    for n in range(2, most + 1):
        out.update(map(" ".join, zip(*(ws[k:] for k in range(n)))))
    return out


def ends(part: str, n: int) -> tuple[list[str], list[str] | None]:
    """The first and the last n words of a part; all of them, and None, where it has no more than that."""
    if len(part) > 4 * EDGE:
        # The word at the cut may not be whole, so there has to be one more.
        first, last = words(part[:EDGE]), words(part[-EDGE:])
        if len(first) > n and len(last) > n:
            return first[:n], last[len(last) - n :]
    ws = words(part)
    return (ws[:n], ws[len(ws) - n :]) if len(ws) > 2 * n else (ws, None)


def replaced_in_turn(text: str, pairs: list[tuple[str, str]], most: int) -> tuple[str, set[str]]:
    """text after the pairs (wrong, right) in order, and the runs of up to `most` words that it had on the way and not at first.

    A replacement makes new runs around its places only, so `most` - 1 words to either side of each are looked at.
    """
    first, brought, beside = text, set(), most - 1
    for wrong, right in pairs:
        if wrong not in text or len(parts := pieces(text, wrong)) == 1:
            continue
        text, put = right.join(parts), words(right)
        first_words, last_words = ends(parts[0], beside)
        around = first_words if last_words is None else last_words
        for part in parts[1:]:
            first_words, last_words = ends(part, beside)
            around = around + put + first_words
            if last_words is not None:
                brought |= runs(around, most)
                around = last_words
        brought |= runs(around, most)
    return text, brought - runs(words(first), most) if brought else brought


def in_turn(text: Column | str, wrongs: Column, rights: Column, most: int) -> Column:
    """A struct (text, brought): see replaced_in_turn. Null texts stay null."""

    def run(texts: pd.Series, wrongs: pd.Series, rights: pd.Series) -> pd.DataFrame:
        rows = [(t, set()) if t is None or w is None else replaced_in_turn(t, list(zip(w, r)), most) for t, w, r in zip(texts, wrongs, rights)]
        return pd.DataFrame({"text": pd.Series([t for t, _ in rows], dtype=object), "brought": pd.Series([sorted(b) for _, b in rows], dtype=object)})

    return F.pandas_udf(run, "struct<text:string,brought:array<string>>").asNondeterministic()(text, wrongs, rights)
