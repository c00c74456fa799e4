"""Sentences, words and windows of English-like text, by Pandas functions.

The rules look behind and carry state over a text, which Column expressions cannot; each row is
worked on alone, so nothing is shuffled.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a window.
WINDOW_WORDS = 512

#: Abbreviations that no sentence ends after.
NO_SPLIT = (
    "Mr", "Mrs", "Ms", "Dr", "Prof", "Gen", "Col", "Lt", "Sgt", "Capt", "Cmdr", "Adm", "Maj", "Rep", "Sen", "Gov", "Pres", "Rev", "Hon", "St", "Mt", "Ft", "Sr", "Jr",
    "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec", "No", "Nos", "vs", "Fig", "approx", "Vol", "pp", "Ave", "Blvd",
)
#: Further abbreviations that keep their period.
ABBREVIATIONS = (
    "Inc", "Corp", "Co", "Ltd", "Bros", "etc", "Ala", "Ariz", "Ark", "Calif", "Colo", "Conn", "Del", "Fla", "Ga", "Ill", "Ind", "Kan", "Ky", "La", "Md", "Mass",
    "Mich", "Minn", "Miss", "Mo", "Mont", "Neb", "Nev", "Okla", "Ore", "Pa", "Tenn", "Tex", "Va", "Vt", "Wash", "Wis", "Wyo",
)

#: Where a sentence may end, how a text is cut to words, what stays whole.
_BREAK = re.compile(r"""(?<=[.!?])["')\]]*\s+(?=[A-Z0-9"'(\[])""")
_DOTTED = re.compile(r"(?:[A-Za-z]\.)+[A-Za-z]")
_WHOLE = re.compile(r"(?:(?:https?://|www\.)\S+|\S+@\S+\.\w+)")
_TOKEN = re.compile(
    r"(?:[A-Za-z]\.){2,}"
    rf"|(?:{'|'.join(sorted(NO_SPLIT + ABBREVIATIONS, key=len, reverse=True))})\.(?=$|[\s,;:)])"
    r"|[A-Z]\.(?=$|\s)"
    r"|\d+(?:[.,]\d+)*(?:%|st|nd|rd|th)?|\w+(?:[-']\w+)*|\.\.\.|[^\w\s]|[\x1c-\x1f]"
)
#: Unicode counts four control characters as no white space that Python does.
_CHUNK = re.compile(r"(?:\S|[\x1c-\x1f])+")
_CLITIC = re.compile(r"(?is)(.+?)(n't|'s|'re|'ve|'ll|'d|'m)$")


def _guarded(text: str, begin: int, end: int) -> bool:
    """Whether text[begin:end] ends in a title, a month, an initial or a dotted acronym, and so goes on."""
    if text[end - 1] != ".":
        return False
    a = end - 1
    while a > begin and not text[a - 1].isspace():
        a -= 1
    word = text[a:end - 1].lstrip("\"'([")
    return word in NO_SPLIT or (len(word) == 1 and word.isupper()) or bool(_DOTTED.fullmatch(word))


def sentences(text: str) -> list[tuple[int, str]]:
    """(offset in characters, sentence), trimmed; closing quotes at a break belong to no sentence."""
    cuts, at = [], 0
    for m in _BREAK.finditer(text):
        if not _guarded(text, at, m.start()):
            cuts.append((at, m.start()))
            at = m.end()
    cuts.append((at, len(text)))
    out = []
    for a, b in cuts:
        part = text[a:b]
        if part.strip():
            out.append((a + len(part) - len(part.lstrip()), part.strip()))
    return out


def _cut(chunk: str) -> tuple[tuple[int, str], ...]:
    """Words of a text's part without white space; they depend on nothing around it."""
    if _WHOLE.fullmatch(chunk):
        return ((0, chunk),)
    out = []
    for m in _TOKEN.finditer(chunk):
        at, tok = m.start(), m[0]
        tail = _CLITIC.fullmatch(tok)
        out += [(at, tail[1]), (at + len(tail[1]), tail[2])] if tail else [(at, tok)]
    return tuple(out)


#: Texts repeat their words: the last KNOWN parts of at most SHORT characters are kept.
KNOWN, SHORT = 1 << 16, 32
_known = functools.lru_cache(KNOWN)(_cut)


def tokens(text: str) -> list[tuple[int, str]]:
    """(offset in characters, word): addresses whole, then numbers, words, clitics and marks."""
    out = []
    for m in _CHUNK.finditer(text):
        at, chunk = m.start(), m[0]
        if chunk.isalpha():
            out.append((at, chunk))
        else:
            out += [(at + a, w) for a, w in (_known(chunk) if len(chunk) <= SHORT else _cut(chunk))]
    return out


def windows(units: list[tuple[str | None, str]], most: int = WINDOW_WORDS) -> list[dict]:
    """Whole sentences of (speaker, text) units in windows of at most most words; a longer sentence is cut."""
    out, words, spans = [], [], []

    def flush():
        nonlocal words, spans
        if words:
            out.append({"window": len(out), "tokens": words, "sentences": spans})
        words, spans = [], []

    for unit, (speaker, text) in enumerate(units):
        for _, sentence in sentences(text):
            got = [w for _, w in tokens(sentence)][:most]
            if not got:
                continue
            if words and len(words) + len(got) > most:
                flush()
            spans.append({"start": len(words), "end": len(words) + len(got), "unit": unit, "speaker": speaker})
            words = words + got
    flush()
    return out


WINDOW = "struct<window:int,tokens:array<string>,sentences:array<struct<start:int,end:int,unit:int,speaker:string>>>"


def in_bytes(text: str, parts: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Ascending (offset in characters, part) of a text with offsets in UTF-8 bytes; reads the text once."""
    if text.isascii():
        return parts
    out, at, size = [], 0, 0
    for a, part in parts:
        size += len(text[at:a].encode())
        out.append((size, part))
        at = a
    return out


def split_sentences(text: Column) -> Column:
    """Array of (offset in UTF-8 bytes, sentence); null stays null."""

    @F.pandas_udf("array<struct<offset:int,text:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"offset": a, "text": s} for a, s in in_bytes(t, sentences(t))])

    return run(text)


def tokenize(text: Column) -> Column:
    """Array of (start, end in UTF-8 bytes, word); null stays null."""

    @F.arrow_udf("array<struct<start:int,end:int,text:string>>")
    def run(texts: pa.Array) -> pa.Array:
        starts, ends, words, offsets = [], [], [], [0]
        for t in texts.to_pylist():
            found = tokens(t or "")
            if t is not None and t.isascii():
                starts += [a for a, _ in found]
                ends += [a + len(w) for a, w in found]
            else:
                at, size = 0, 0
                for a, w in found:
                    size += len(t[at:a].encode())
                    starts.append(size)
                    size += len(w.encode())
                    ends.append(size)
                    at = a + len(w)
            words += [w for _, w in found]
            offsets.append(len(words))
        flat = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(words, pa.string())], ["start", "end", "text"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=texts.is_null())

    return run(text)


def prose_windows(text: Column, most: int = WINDOW_WORDS) -> Column:
    """Windows of a text's paragraphs."""

    @F.pandas_udf(f"array<{WINDOW}>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else windows([(None, p) for p in t.split("\n\n") if p.strip()], most))

    return run(text)


def chat_windows(turns: Column, most: int = WINDOW_WORDS) -> Column:
    """Windows of an array of (speaker, text); blank turns go."""

    @F.pandas_udf(f"array<{WINDOW}>")
    def run(chats: pd.Series) -> pd.Series:
        return chats.map(lambda c: None if c is None else windows([(t["speaker"], t["text"]) for t in c if t["text"] and t["text"].strip()], most))

    return run(turns)
