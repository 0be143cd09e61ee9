"""Language identification with a bit-sliced Bloom filter of character n-grams.

One table of slots serves all languages: slot ``i`` holds a mask with one bit per language, so
ANDing the masks at an n-gram's positions returns all the languages that may contain it at once.
A language's bits are set by the n-grams that are common in its training texts.  A document's
votes are the popcounts of each language's bit over its n-grams; as a filter whose share of set
bits is ``f`` answers yes by chance with probability ``f ** hashes``, the votes are corrected for
it before the largest decides.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import first_by_hash, held_out, map_rows

NGRAM = 4
HASHES = 2
#: log2 of the number of slots: the model's size is fixed, whatever the corpus.
SLOT_BITS = 20
#: The bounded training sample: so many texts per language, by the order of a hash of doc_id,
#: of texts no longer than this many code points.
TEXTS_PER_LANGUAGE = 400
TEXT_CHARS = 20_000
#: An n-gram belongs to a language if it makes up this share of its n-grams, and occurs twice.
SHARE = 2e-5
UNDETERMINED = "und"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its small letter's code point, 0 for what isn't a letter."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def ngrams(text: str) -> np.ndarray:
    """64-bit hashes of the n-grams of a text's letters; a run of other characters counts as one
    boundary, and the text begins and ends with one.  Empty if there is no letter."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = codes != 0
    if not letter.any():
        return np.empty(0, np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.concatenate(([0], codes[keep], [0] * (NGRAM - 1))).astype(np.uint64)
    rolled = np.zeros(len(codes) - NGRAM + 1, np.uint64)
    for i in range(NGRAM):
        rolled = rolled * _STEP + codes[i : i + len(rolled)] + np.uint64(1)
    rolled ^= rolled >> np.uint64(31)
    return rolled * _MIX


def _slots(hashes: np.ndarray) -> list[np.ndarray]:
    """The positions of each n-gram: the high bits, then those of a further mixing."""
    out = []
    for _ in range(HASHES):
        out.append((hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
        hashes = (hashes ^ (hashes >> np.uint64(29))) * _STEP
    return out


@dataclass
class LanguageFilter:
    """``masks`` has one row of ``ceil(languages / 64)`` words per slot (fewer bits if they do)."""

    languages: list[str]
    masks: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray]) -> LanguageFilter:
        languages = sorted(grams)
        n = len(languages)
        kind = next((k for k, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if n <= bits), np.uint64)
        width = np.dtype(kind).itemsize * 8
        masks = np.zeros((max(1, -(-n // width)), 1 << SLOT_BITS), kind)
        for i, lang in enumerate(languages):
            for at in _slots(grams[lang]):
                masks[i // width, at] |= kind(1 << (i % width))
        return cls(languages, masks)

    @property
    def width(self) -> int:
        return self.masks.dtype.itemsize * 8

    def chance(self) -> np.ndarray:
        """Per language, how often the filter says yes to an n-gram that was never put in."""
        if not hasattr(self, "_chance"):
            fill = [np.count_nonzero(self.masks[i // self.width] >> (i % self.width) & 1) / (1 << SLOT_BITS) for i in range(len(self.languages))]
            self._chance = np.array(fill) ** HASHES
        return self._chance

    def votes(self, text: str) -> np.ndarray | None:
        """Corrected share of the n-grams that each language contains; None without a letter."""
        hashes = ngrams(text)
        if not len(hashes) or not self.languages:
            return None
        slots = _slots(hashes)
        counts = np.zeros(len(self.languages))
        for word, mask in enumerate(self.masks):
            hit = mask[slots[0]]
            for at in slots[1:]:
                hit &= mask[at]
            if self.width == 8:
                seen = np.bincount(hit, minlength=256)
                values = np.arange(256)
                for bit in range(min(8, len(counts) - word * 8)):
                    counts[word * 8 + bit] = seen[(values >> bit & 1) == 1].sum()
            else:
                for bit in range(min(self.width, len(counts) - word * self.width)):
                    counts[word * self.width + bit] = np.count_nonzero(hit >> self.masks.dtype.type(bit) & self.masks.dtype.type(1))
        by_chance = np.minimum(self.chance(), 0.999)
        return np.clip((counts / len(hashes) - by_chance) / (1 - by_chance), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        votes = self.votes(text) if text else None
        if votes is None:
            return UNDETERMINED, 0.0
        best = int(np.argmax(votes))
        total = float(votes.sum())
        return self.languages[best], float(votes[best] / total) if total else 0.0


def fit(docs: DataFrame) -> LanguageFilter:
    """Learn from the texts that are not held out and whose lang is known.

    The sample is bounded per language (see the constants).  The ids are chosen first, without
    reading texts; n-grams are counted on the executors, and what comes to the driver is at most
    1 / SHARE n-grams for a language.
    """
    train = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= TEXT_CHARS))
    ids = first_by_hash(train.select("doc_id", "lang"), "lang", TEXTS_PER_LANGUAGE)
    sample = train.select("doc_id", "lang", "text").join(F.broadcast(ids.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi")

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        held: dict[str, list[np.ndarray]] = {}
        for lang, text in each:
            held.setdefault(lang, []).append(ngrams(text))
        for lang, parts in held.items():
            values, counts = np.unique(np.concatenate(parts).view(np.int64), return_counts=True)
            yield from zip([lang] * len(values), values.tolist(), counts.tolist(), strict=True)

    counts = map_rows(sample.select("lang", "text"), rows, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy("lang")))
    common = counts.filter((F.col("n") >= 2) & (F.col("n") >= SHARE * F.col("total"))).select("lang", "gram").toPandas()
    return LanguageFilter.build({lang: part.to_numpy(np.int64).view(np.uint64) for lang, part in common.groupby("lang")["gram"]})


def identify(docs: DataFrame, model: LanguageFilter | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of docs.

    Only the text is looked at.  A null text or one without a letter is ``und`` with score 0; a
    tie goes to the language that sorts first; repeated rows are predicted alike; without any
    training row all is ``und``.
    """
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.masks))

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        model = LanguageFilter(*shared.value)
        for doc_id, out, text in each:
            yield (doc_id, out, *model.predict(text))

    return map_rows(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), rows, "doc_id long, held_out boolean, lang_pred string, score double")
