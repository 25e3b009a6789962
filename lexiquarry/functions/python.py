"""The few scalar functions that no built-in expresses, vectorised over Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from lexiquarry.functions.lazy import vectorised


def key_of(text: str | None) -> str | None:
    if text is None:
        return None
    flat = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not "̀" <= c <= "ͯ")
    return " ".join(re.sub(r"[^a-z0-9\s]", " ", flat).split())


#: Powers of 33 modulo 2**32, the highest first, for a piece of a text.
POWERS = np.cumprod(np.full(1 << 16, 33, np.uint32), dtype=np.uint32)[::-1].copy()


def djb2(text: str | None) -> str | None:
    """djb2 over UTF-16 units modulo 2**32, in base 36; as ``text.hash_id``, a piece of a long text at a time."""
    if text is None:
        return None
    units, h = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint32), 5381
    for i in range(0, len(units), len(POWERS)):
        piece = units[i : i + len(POWERS)]
        powers = POWERS[len(POWERS) - len(piece) :]
        h = (h * int(powers[0]) + int((piece[:-1] * powers[1:]).sum(dtype=np.uint32)) + int(piece[-1])) & 0xFFFFFFFF
    return np.base_repr(h, 36).lower()


def answer_of(text: str | None) -> str:
    return re.sub(r"^(?:a|an|the)\s+", "", key_of(text) or "")


def osa_distance(a: str, b: str) -> int:
    """Edits between two strings, a swap of neighbours being one (optimal string alignment)."""
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


def tolerated(n: int) -> int:
    return 2 if n >= 14 else 1 if n >= 6 else 0


def alternates(expected: str) -> list[str]:
    bracketed = re.match(r"^(.*?)\s*\(([^)]+)\)\s*$", expected)
    parts = [p.strip() for p in re.split(r"\s*(?:/|,?\s+or\s+)\s*", expected, flags=re.I)]
    return list(dict.fromkeys([expected, *(bracketed.groups() if bracketed else ()), *filter(None, parts)]))


def check(given: str | None, expected: str | None) -> dict:
    mine = answer_of(given)
    wants = [w for a in alternates(expected or "") if (w := answer_of(a))]
    over = min((osa_distance(mine, w) - tolerated(len(w)) for w in wants), default=10**6)
    correct = bool(mine) and over <= 0
    return {"correct": correct, "close": bool(mine) and not correct and over <= 2}


def signature(words: list[str]) -> str:
    letters = [re.sub("[^A-Za-z]", "", w) for w in words]
    return "".join(w if len(w) > 1 and w.isupper() else w[:1] for w in letters)


def abbreviations(text: str | None, most: int = 25) -> list[dict]:
    """Abbreviations in brackets after the shortest phrase whose initials they are; each once."""
    found: dict[str, str] = {}
    for m in re.finditer(r"([A-Za-z][A-Za-z0-9'’\-]*(?:\s+[A-Za-z0-9][A-Za-z0-9'’\-]*){0,5})\s+\(([A-Za-z][A-Za-z0-9]{1,7})\)", text or ""):
        short, words = m[2], m[1].split()
        letters = re.sub("[^A-Za-z]", "", short).lower()
        if len(found) >= most or len(letters) < 2 or short in found or short == short.lower():
            continue
        tail = next((t for k in range(1, len(words) + 1) if signature(t := words[-k:]).lower() == letters), None)
        if tail and len(" ".join(tail)) >= 4 and " ".join(tail).lower() != short.lower():
            found[short] = " ".join(tail)
    return [{"abbreviation": k, "expansion": v} for k, v in found.items()]


@vectorised("string")
def normalize_key(c: pd.Series) -> pd.Series:
    return c.map(key_of)


@vectorised("string")
def hash_id(c: pd.Series) -> pd.Series:
    return c.map(djb2)


@vectorised("int")
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa_distance(x or "", y or "") for x, y in zip(a, b)])


@vectorised("struct<correct:boolean,close:boolean>")
def check_answer(given: pd.Series, expected: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([check(g, e) for g, e in zip(given, expected)], columns=["correct", "close"])


@vectorised("array<struct<abbreviation:string,expansion:string>>")
def mine_abbreviations(c: pd.Series) -> pd.Series:
    return c.map(abbreviations)
