"""Language identification by a bit-sliced Bloom filter over character n-grams.

Slot i of the filter is a bitmask: bit l says that language l's own Bloom filter has bit i set.  The
AND of an n-gram's slots is thus the set of all languages that contain it.  A text's n-grams are
looked up at once, each language's hits are counted and corrected for its filter's rate of false
positives, and the largest corrected count decides; the score is its lead over the second.

Training: a language contains an n-gram if its relative frequency there is at least KEEP of the
largest over all languages.  Frequencies come from a sample, bounded by PER_LANGUAGE documents of
each language on average, drawn by a hash of the id, so that it is the same on every run.

A text's support is the largest corrected count over all its n-grams: 0 where none occurs in a learned
language.  least_support() says from labelled rows, best not those of the training, how much a text of
a learned language has.

Nulls and texts without a letter get `und` and score 0; so does everything if nothing is labelled.
Ties go to the language that sorts first.  Repeated rows are judged one by one, an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, mapped, stored

#: Bounds the sample that a filter is learned from: documents of a language, on average.
PER_LANGUAGE = 2000
#: N-gram lengths; slots of the filter and probes an n-gram.
ORDERS, SLOTS, PROBES = (1, 3), 1 << 18, 3
#: An n-gram counts from this share of a language's n-grams on; a language contains it from this share of the largest on.
FLOOR, KEEP = 2e-5, 0.5
#: Labelled texts of less than SLACK of the support that all but a share of RARE of them have are of no learned language.
RARE, SLACK = 0.01, 0.5
#: Intervals in which numbers are counted at once to find the one of a rank.
BINS = 4096
#: Characters that are looked up at once.
CHUNK = 250_000

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of all n-grams of lower-cased letters; other characters, however
    many in a row, are one blank; n-grams stay within a text."""
    low = [f" {x.lower()} " for x in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(low), dtype=np.int32), [len(x) for x in low])
    letter = _letters()[code]
    keep = np.ones(len(code), bool)
    keep[1:] = letter[1:] | letter[:-1] | (owner[1:] != owner[:-1])
    code, owner = np.where(letter, code, 32)[keep].astype(np.uint64), owner[keep]
    hashes, owners = [], []
    for n in ORDERS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h ^ code[k : k + m]) * _MULT[k]
            h ^= h >> np.uint64(29)
        ok = (owner[:m] == owner[n - 1 :]) if n > 1 else code != 32
        hashes.append(h[ok])
        owners.append(owner[:m][ok])
    return np.concatenate(hashes), np.concatenate(owners)


def _chunks(texts: list[str]):
    """(texts, their indices) of about CHUNK characters; a longer text in several overlapping parts."""
    part, at, size = [], [], 0
    for i, x in enumerate(texts):
        for k in range(0, max(1, len(x)), CHUNK):
            y = x[max(0, k - max(ORDERS) + 1) : k + CHUNK]
            part.append(y)
            at.append(i)
            size += len(y)
            if size >= CHUNK:
                yield part, at
                part, at, size = [], [], 0
    if part:
        yield part, at


def _slots(h: np.ndarray) -> list[np.ndarray]:
    return [((h * m) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64) for m in _MULT[:PROBES]]


class Filter:
    """languages: sorted; masks: slots x words of 64 languages."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks
        fill = np.array([np.count_nonzero(masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) / SLOTS for i in range(len(languages))])
        self.false = fill**PROBES

    def contains(self, h: np.ndarray) -> np.ndarray:
        """By n-gram, the bitmask (words) of languages that contain it."""
        a, *rest = _slots(h)
        out = self.masks[a]
        for s in rest:
            out &= self.masks[s]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.judged(texts)[:2]

    def judged(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and support of each text."""
        count = np.zeros((len(texts), max(1, len(self.languages))))
        total = np.zeros(len(texts))
        whole = [x or "" for x in texts]
        for part, at in _chunks(whole):
            h, owner = _grams(part)
            found, to = self.contains(h), np.array(at)
            np.add.at(total, to, np.bincount(owner, minlength=len(part)))
            for i in range(len(self.languages)):
                hit = (found[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(bool)
                np.add.at(count[:, i], to, np.bincount(owner[hit], minlength=len(part)))
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        right = np.maximum(0, (count - total[:, None] * self.false) / (1 - self.false))
        best, high = right.argmax(1), right.max(1)
        second = np.partition(right, -2, axis=1)[:, -2] if right.shape[1] > 1 else np.zeros(len(texts))
        score = np.where(high > 0, 1 - second / np.where(high > 0, high, 1), 0.0)
        known = [has_letter(x) for x in texts]
        return [self.languages[b] if k else "und" for b, k in zip(best, known)], [float(s) if k else 0.0 for s, k in zip(score, known)], (high / np.maximum(1, total)).tolist()


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5, is 0 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> tuple[DataFrame | None, list[str]]:
    """(id, text, lang) of labelled rows, about per_language of each language, and the languages; None if there are none."""
    labelled = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None, []
    share = F.create_map(*[F.lit(x) for k in sorted(sizes) for x in (k, min(1 << 20, -(-(per_language << 20) // sizes[k])))])
    return labelled.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share[F.col("lang")]), sorted(sizes)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Filter:
    """Learns from labelled rows of docs; the caller leaves out what is held out."""
    sample, languages = _sample(docs, id_col, text_col, lang_col, per_language)
    if sample is None:
        return Filter([], np.zeros((SLOTS, 1), np.uint64))

    def run(batch):
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows: list[tuple] = []
        for part, at in _chunks(texts):
            h, owner = _grams(part)
            where = np.array([languages.index(langs[i]) for i in at])[owner]
            for k in np.unique(where):
                u, n = np.unique(h[where == k], return_counts=True)
                rows.append((np.full(len(u), k), u.view(np.int64), n))
        if not rows:
            return None
        k, u, n = (np.concatenate(x) for x in zip(*rows))
        return {"k": pa.array(k.astype(np.int32)), "gram": pa.array(u), "n": pa.array(n.astype(np.int64))}

    counts = mapped(sample.select("text", "lang"), run, "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("k").agg(F.sum("n").alias("total"))
    # at most 1 / FLOOR rows a language
    frequent = counts.join(totals, "k").where(F.col("n") >= F.lit(FLOOR) * F.col("total")).select("k", "gram", (F.col("n") / F.col("total")).alias("f")).toArrow()
    k, gram, f = (frequent.column(i).to_numpy() for i in range(3))
    masks = np.zeros((SLOTS, -(-len(languages) // 64)), np.uint64)
    if len(k):
        grams, at = np.unique(gram.view(np.uint64), return_inverse=True)
        top = np.zeros(len(grams))
        np.maximum.at(top, at, f)
        keep = f >= KEEP * top[at]
        for s in _slots(gram.view(np.uint64)):
            np.bitwise_or.at(masks, (s[keep], k[keep] // 64), np.uint64(1) << (k[keep] % 64).astype(np.uint64))
    return Filter(languages, masks)


def predict(docs: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text", support: bool = False) -> DataFrame:
    """(id_col, lang_pred, score) and, if asked for, support for each row; only the text is looked at."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast((model.languages, model.masks))  # SLOTS x 8 bytes a 64 languages
    d = docs.select(F.col(id_col), F.col(text_col))

    def run(batch):
        lang, score, found = Filter(*shipped.value).judged(batch.column(1).to_pylist())
        return {id_col: batch.column(0), "lang_pred": lang, "score": score, "support": found}

    return mapped(d, run, f"`{id_col}` {d.schema[0].dataType.simpleString()}, lang_pred string, score double" + (", support double" if support else ""))


def _ranked(values: DataFrame, rank: int) -> float:
    """The value of that rank (from 0) of a stored column v of numbers: counts of BINS intervals, then of those in the right one, and on."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    while low < high:
        place = F.least(F.floor((F.col("v") - low) / (high - low) * BINS), F.lit(BINS - 1))
        bins = values.where(F.col("v").between(low, high)).groupBy(place.alias("at")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for b in sorted(bins.collect()):
            if rank < b["n"]:
                low, high = b["low"], b["high"]
                break
            rank -= b["n"]
    return low


def least_support(docs: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> float:
    """The support that a text of a learned language has at least, from all labelled rows of docs; 0 if there are none."""
    labelled = docs.where(F.col(lang_col).isin(model.languages) & F.col(text_col).isNotNull())
    found = predict(labelled, model, id_col, text_col, support=True).where("lang_pred <> 'und'")
    values, path = stored(found.select(F.col("support").alias("v")), "supports")
    n = values.count()
    at = RARE * (n - 1)
    low, high = (_ranked(values, k) for k in (math.floor(at), math.ceil(at))) if n else (0.0, 0.0)
    dropped(docs.sparkSession, path)
    return SLACK * (low + (at - math.floor(at)) * (high - low))
