"""Cuts texts into pieces whose byte-level BPE tokens don't depend on what stands around them."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

#: White space besides blank and line end; stops or commas that don't follow a plain letter or digit.
_OTHER = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_OTHER_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_CLUSTERED = re.compile("[.,](?<=[^A-Za-z0-9À-ÖØ-öø-ÿ][.,])")

#: Whether a byte is a plain letter or digit of ASCII.
_PLAIN = np.isin(np.arange(256), np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))

#: White space of three bytes.
_WIDE = np.array([int.from_bytes(chr(x).encode()) for x in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])


def pieces(text: str, findall) -> list[str]:
    """Pieces of text, in order and complete, that may be encoded one by one.

    Where white space is single blanks and line ends, each of them starts a match of the GPT-2
    pattern, and so does a stop or comma after a letter or digit: the text is cut before these.  Any
    other text is cut by the pattern itself (findall: that of the compiled pattern).
    """
    if not text:
        return []
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\0" in text or (any(x in text for x in _OTHER_ASCII) if text.isascii() else _OTHER.search(text)):
        return findall(text)
    cut = text.replace(" ", "\0 ").replace("\n", "\0\n")
    if text[0] not in ".," and not _CLUSTERED.search(text):
        cut = cut.replace(".", "\0.").replace(",", "\0,")
    return cut.split("\0")


def columns(texts: list[str], findall) -> tuple[pa.Array, np.ndarray]:
    """(pieces of all texts, one after another, where each text's begin): cut as by pieces(), but at the bytes of all texts at once.

    An empty text is an empty piece."""
    data = pa.array(texts, pa.large_string())
    _, offsets, raw = data.buffers()
    ends = np.frombuffer(offsets, np.int64)[: len(texts) + 1]
    b = np.frombuffer(raw, np.uint8)[: ends[-1]] if raw else np.zeros(0, np.uint8)
    begin, filled = ends[:-1], np.flatnonzero(np.diff(ends))
    cut = (b == 32) | (b == 10)
    # texts with other white space (or controls), or white space in a row, are cut by the pattern
    odd = (b < 32) & (b != 10)
    two, three = np.flatnonzero(b == 0xC2), np.flatnonzero((b >= 0xE1) & (b <= 0xE3))
    odd[two] = np.isin(b[two + 1], (0x85, 0xA0))
    odd[three] = np.isin(b[three].astype(np.int64) << 16 | b[three + 1].astype(np.int64) << 8 | b[three + 2], _WIDE, kind="table")
    odd[:-1] |= cut[:-1] & cut[1:]
    by_pattern = filled[np.logical_or.reduceat(odd, begin[filled])] if len(filled) else filled
    # stops and commas, in texts where each follows a plain letter or digit
    point = np.flatnonzero((b == 46) | (b == 44))
    before, lead = b[point - 1], b[np.maximum(point - 2, 0)]
    plain = _PLAIN[before] | (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
    text = np.searchsorted(ends, point, "right") - 1
    plain &= point > begin[text]
    clustered = np.zeros(len(texts), bool)
    clustered[text[~plain]] = True
    cut[point[~clustered[text]]] = True
    for k in by_pattern.tolist():
        cut[begin[k] : ends[k + 1]] = False
        cut[begin[k] + np.cumsum([len(x.encode()) for x in findall(texts[k])[:-1]], dtype=np.int64)] = True
    cut[begin[filled]] = False
    inner = np.flatnonzero(cut)
    first = np.searchsorted(inner, begin) + np.arange(len(texts))
    starts = np.append(np.sort(np.concatenate([begin, inner]), kind="stable"), ends[-1])
    return pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(b)]), first
