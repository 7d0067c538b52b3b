"""The likeliest code page of text bytes, from how often pairs of bytes follow each other."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code pages of one byte a character that are told apart; of equally likely ones the first.
PAGES = ("cp1252", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "iso8859_5", "cp1253")
# Letters beyond ASCII that are frequent in languages written in a page.
OFTEN = {"cp1252": "éèàäöüßçñóáíêâôå", "cp1250": "ąęłżśćěščřžýáíéůńőű", "iso8859_2": "ąęłżśćěščřžýáíéůńőű", "cp1253": "αοιετσνηυρπκμλς"}
OFTEN_CYRILLIC = "оеаинтсрвлкмдпу"
CHUNK = 1 << 20  # bytes counted at a time


@cache
def _costs(page: str) -> np.ndarray:
    """What a pair of bytes says for a page, as 256 x 256 numbers; pairs within ASCII say nothing."""
    chars = [bytes([b]).decode(page, "replace") for b in range(256)]
    cat = [unicodedata.category(c) for c in chars]
    bad = np.array([c == "�" for c in chars])
    control = np.array([k == "Cc" and b > 127 for b, k in enumerate(cat)])
    letter = np.array([k in ("Lu", "Ll", "Lo") for k in cat])
    lower, upper = (np.array([k == x for k in cat]) for x in ("Ll", "Lu"))
    sign = np.array([b > 127 and k[0] in "SN" for b, k in enumerate(cat)])
    often = np.array([c in OFTEN.get(page, OFTEN_CYRILLIC) for c in chars])
    scripts = {s: i for i, s in enumerate(dict.fromkeys(unicodedata.name(c, "").split(" ")[0] for c in chars))}
    script = np.array([scripts[unicodedata.name(c, "").split(" ")[0]] for c in chars])
    both = lambda a, b: a[:, None] & b[None, :]
    either = lambda a, b: both(a, b) | both(b, a)
    words = both(letter, letter)
    own = script[:, None] == script[None, :]
    c = np.where(words & own & ~both(lower, upper) & ~both(upper, upper), 1.0, 0.0)
    c -= 3.0 * (words & own & both(lower, upper)) + 4.0 * (words & ~own) + 2.0 * either(letter, sign) + 1.0 * both(sign, sign)
    c += 1.0 * often[:, None] + 1.0 * often[None, :]
    c -= 10.0 * (control[:, None] | control[None, :]) + 20.0 * (bad[:, None] | bad[None, :])
    c[:128, :128] = 0
    return c


def likeliest(content: bytes, pages: Sequence[str] = PAGES) -> tuple[str, float]:
    """(page, confidence) of bytes; confidence is the lead over the next page by pair of bytes that is not ASCII, 0 to 1."""
    b = np.frombuffer(b" " + content + b" ", np.uint8)
    counts = np.zeros(1 << 16, np.int64)
    for i in range(0, len(b) - 1, CHUNK):
        part = b[i : i + CHUNK + 1].astype(np.int64)
        counts += np.bincount(part[:-1] * 256 + part[1:], minlength=1 << 16)
    seen = np.flatnonzero(counts)
    seen = seen[(seen >= 1 << 15) | (seen % 256 >= 128)]
    if not len(seen):
        return pages[0], 1.0
    score = [float(_costs(p).ravel()[seen] @ counts[seen]) / counts[seen].sum() for p in pages]
    best = int(np.argmax(score))
    return pages[best], min(1.0, max(0.0, score[best] - max([s for i, s in enumerate(score) if i != best], default=score[best])))


def unmarked_utf16(content: bytes) -> str | None:
    """utf_16_le or utf_16_be of bytes without a mark, where most of the bytes at odd or even places are 0."""
    b = np.frombuffer(content, np.uint8)
    if len(b) < 4 or len(b) % 2:
        return None
    low, high = (b[::2] == 0).mean(), (b[1::2] == 0).mean()
    return "utf_16_le" if high > 0.5 > 0.1 > low else "utf_16_be" if low > 0.5 > 0.1 > high else None


def guessed(content: Column, pages: Sequence[str] = PAGES) -> Column:
    """(charset, confidence, text) of binary values as a struct, null for null; what a charset does not have becomes U+FFFD."""

    @F.pandas_udf("charset string, confidence double, text string")
    def guess(values):
        import pandas as pd

        rows = []
        for v in values:
            if v is None:
                rows.append((None, None, None))
                continue
            v = bytes(v)
            if name := unmarked_utf16(v):
                sure = 1.0
            else:
                try:
                    rows.append(("utf_8", 1.0, v.decode()))
                    continue
                except UnicodeDecodeError:
                    name, sure = likeliest(v, pages)
            rows.append((name, sure, v.decode(name, "replace")))
        return pd.DataFrame(rows, columns=["charset", "confidence", "text"])

    return guess(content)
