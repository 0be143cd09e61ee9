"""Toxicity by compression distance.

Two zstandard dictionaries of equal size are trained, one on ordinary and one on toxic text.  A
text is cut into windows of a few words, and each window is compressed with either; a window that
the toxic dictionary compresses better holds toxic wording.  How many windows reach each of some
gains, how the best ones do and what the mean is are held against thresholds that are calibrated on
labelled texts which the dictionaries were not trained on.

The trainer picks what is frequent, and in a toxic text ordinary wording is.  So what ordinary
texts explain is struck out of the toxic samples first: of a toxic text the stretches stay whose
character n-grams are many times as frequent in toxic text.  The trainer then finds what these
stretches share, be it a word or a beginning of words.  A window is compressed behind a fixed
carrier that both dictionaries end with: a short text by itself would be stored as it is, and any
gain of less than a block's cost would be lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import first_by_hash, held_out, map_rows

#: The bounded training sample: so many texts a class, by the order of a hash of doc_id, and of a
#: longer text a stretch of so many code points at a place that depends on its hash.
TEXTS_PER_CLASS = 2_000
TEXT_CHARS = 8_000
WINDOW_WORDS = 2
#: Bytes of each dictionary, and of the segments and substrings that the trainer counts.
SIZE, SEGMENT, SUBSTRING = 3_072, 64, 8
#: Character n-grams of toxic text stay if so many texts hold them and they are a number of times
#: as frequent as in ordinary text; of one text, so many occurrences count.  Of the pairs of
#: length and times the one is taken whose dictionaries calibrate best.
TEXTS, OCCURRENCES = 3, 8
SETUPS = ((5, 50), (6, 50), (7, 20))
LEVEL, STRATEGY, MIN_MATCH = 16, zstandard.STRATEGY_LAZY2, 6
#: Bytes that are no text, behind which a window is compressed.
CARRIER = bytes((*range(1, 9), *range(14, 32)))
#: Gains in bytes at which windows are counted.
GAINS = (1, 2, 3, 4, 5, 6, 8, 10, 12, 14)
THRESHOLD = 0.7

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Fixed value: the offsets that stand between a trained dictionary's tables and its content.
_CONTENT = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


def windows(text: str) -> list[bytes]:
    """A few words of small letters each, between spaces."""
    words = text.lower().split()
    return [f" {' '.join(words[i : i + WINDOW_WORDS])} ".encode("utf-8", "replace") for i in range(0, len(words), WINDOW_WORDS)]


def _plain(text: str) -> str:
    return f" {' '.join(text.lower().split())} "


def _hashes(plain: str, ngram: int) -> np.ndarray:
    """A hash of each character n-gram."""
    codes = np.frombuffer(plain.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    hashes = np.zeros(max(0, len(codes) - ngram + 1), np.uint64)
    for i in range(ngram):
        hashes = hashes * _STEP + codes[i : i + len(hashes)] + np.uint64(1)
    return hashes


class _Counts:
    """The n-grams of some texts: occurrences, texts that hold them, and the number in all."""

    def __init__(self, texts: Iterable[str], ngram: int) -> None:
        found = [np.unique(_hashes(_plain(t), ngram), return_counts=True) for t in texts]
        grams, n = (np.concatenate([np.empty(0, kind), *(x[i] for x in found)]) for i, kind in ((0, np.uint64), (1, np.int64)))
        self.grams, at = np.unique(grams, return_inverse=True)
        self.occurrences = np.bincount(at, np.minimum(n, OCCURRENCES), len(self.grams))
        self.texts = np.bincount(at, minlength=len(self.grams))
        self.total = max(1, int(n.sum()))

    def of(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.zeros(len(grams))
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[at] == grams, self.occurrences[at], 0)


def distinct_stretches(toxic: list[str], ordinary: list[str], ngram: int, times: float) -> list[bytes]:
    """What is left of the toxic texts when what ordinary texts explain is struck out: the runs
    that n-grams of their own cover."""
    own, other = _Counts(toxic, ngram), _Counts(ordinary, ngram)
    stay = (own.texts >= TEXTS) & (own.occurrences / own.total >= times * (other.of(own.grams) + 0.5) / other.total)
    grams = own.grams[stay]
    found = []
    for plain in map(_plain, toxic):
        hit = np.flatnonzero(np.isin(_hashes(plain, ngram), grams))
        if len(hit):
            gaps = np.flatnonzero(np.diff(hit) > ngram)
            starts, ends = hit[np.concatenate(([0], gaps + 1))], hit[np.concatenate((gaps, [len(hit) - 1]))]
            found += [plain[a : b + ngram].encode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return found


def trained(samples: list[bytes]) -> bytes:
    """The content that zstandard's trainer picks from the samples, without its entropy tables;
    few samples are shown to it several times.  Empty if there is too little to train on."""
    size = sum(map(len, samples))
    if not size:
        return b""
    samples = samples * (1 + 20 * SIZE // size)
    try:
        found = zstandard.train_dictionary(SIZE + 1024, samples, k=SEGMENT, d=SUBSTRING, steps=4).as_bytes()
    except zstandard.ZstdError:
        return b""
    return found[found.find(_CONTENT) + len(_CONTENT) :][-SIZE:]


def dictionaries(rows: list[tuple[str, int]]) -> Iterator[tuple[bytes, bytes]]:
    """An ordinary and a toxic dictionary from (text, label) rows for each setup."""
    texts = [t for t, label in rows if not label], [t for t, label in rows if label]
    ordinary = trained([w for t in texts[0] for w in windows(t)])
    for ngram, times in SETUPS:
        toxic = trained(distinct_stretches(texts[1], texts[0], ngram, times) or [w for t in texts[1] for w in windows(t)])
        if ordinary and toxic:
            yield ordinary, toxic


@dataclass
class CompressionModel:
    """The two dictionaries and the calibration of a text's gains (empty: nothing was learnt)."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray

    def __post_init__(self) -> None:
        self.packers = []
        for part in (self.ordinary, self.toxic):
            content = part + CARRIER
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, dict_size=len(content), source_size=64, strategy=STRATEGY, min_match=MIN_MATCH, window_log=17, hash_log=15, chain_log=15, search_log=6, target_length=64,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            own.precompute_compress(compression_params=params)
            self.packers.append(zstandard.ZstdCompressor(dict_data=own, compression_params=params))

    def gains(self, text: str | None) -> np.ndarray:
        """By how many bytes the toxic dictionary compresses each window better."""
        ordinary, toxic = (p.compress for p in self.packers)
        found = [len(ordinary(data)) - len(toxic(data)) for w in windows(text or "") for data in (CARRIER + w,)]
        return np.array(found or [0], np.float64)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(features(self.gains(text)) @ self.weights, -30, 30)))) if len(self.weights) else 0.0


def features(gains: np.ndarray) -> np.ndarray:
    """One, the best two gains, how many windows reach each gain and their share (as a log), how
    many lose clearly, the mean gain and the number of windows (as a log)."""
    n = len(gains)
    best = np.partition(gains, -2)[-2:] if n > 1 else (0.0, gains[0])
    reach = (gains[:, None] >= np.array(GAINS)).sum(axis=0)
    share = np.log((np.append(reach, np.count_nonzero(gains <= -4)) + 0.3) / (n + 15))
    return np.concatenate(([1.0, best[1], best[0]], np.minimum(reach, 6), share, [gains.mean(), np.log(n)]))


def train(rows: Iterable[tuple[str, int]]) -> CompressionModel:
    """From (text, label) rows in any order, equal ones counting once.

    A hash of the text deals them out: two thirds train the dictionaries, and the thresholds are
    calibrated on the other third.  Without texts of both classes in either nothing is learnt.
    """
    dealt: tuple[list, list] = ([], [])
    for text, label in sorted(set(rows)):
        dealt[xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) % 3 == 0].append((text, label))
    fitting, judging = dealt
    best = (np.inf, CompressionModel(b"", b"", np.empty(0)))
    if all({label for _, label in part} == {0, 1} for part in dealt):
        y = np.array([label for _, label in judging], float)
        for parts in dictionaries(fitting):
            model = CompressionModel(*parts, np.empty(0))
            x = np.array([features(model.gains(text)) for text, _ in judging])
            model.weights = _logistic(x, y)
            best = min(best, (_loss(x, y), model), key=lambda found: found[0])
    return best[1]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights by Newton's method with a small penalty; a toxic text counts twice."""
    weight = np.where(y == 1, 2.0, 1.0)
    scale = np.maximum(x.std(axis=0), 1e-6)
    scale[0] = 1
    z, b = x / scale, np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        slope = z.T @ (weight * (p - y)) + penalty @ b
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, slope)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b / scale


def _loss(x: np.ndarray, y: np.ndarray, folds: int = 5) -> float:
    """What the calibration loses on rows it wasn't made from; a toxic text counts twice."""
    lost, fold = 0.0, np.arange(len(y)) % folds
    for k in range(folds):
        margin = np.clip(x[fold == k] @ _logistic(x[fold != k], y[fold != k]), -30, 30)
        lost += float(np.log1p(np.exp(-np.where(y[fold == k] == 1, margin, -margin))) @ np.where(y[fold == k] == 1, 2.0, 1.0))
    return lost




def fit(docs: DataFrame, labels: DataFrame) -> CompressionModel:
    """Learn from labelled rows that are not held out; a bounded sample (see the constants) comes
    to the driver.  A document with several labels counts as toxic if one says so; null labels,
    null ids and null or empty texts don't count; extra columns are not read; without labels
    nothing is learnt."""
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = first_by_hash(known, "toxic", TEXTS_PER_CLASS)
    spare = F.length("text") - TEXT_CHARS
    place = F.when(spare > 0, F.pmod(F.xxhash64("text"), F.greatest(spare, F.lit(1))) + 1).otherwise(1).cast("int")
    texts = docs.filter(F.length("text") > 0).select("doc_id", F.col("text").substr(place, F.lit(TEXT_CHARS)).alias("text"))
    sample = texts.join(F.broadcast(ids), "doc_id").select("toxic", "text").dropDuplicates()  # ids: 2 * TEXTS_PER_CLASS rows at most
    return train((r.text, int(r.toxic)) for r in sample.toLocalIterator())


def score(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of docs.

    Whole texts are scored, only by their text.  Null and empty texts get the score of a text
    without gains; repeated rows score alike; a null id is not held out; extra columns are not
    read; an empty table gives an empty result; where nothing was learnt every score is 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.ordinary, model.toxic, model.weights))

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        model = CompressionModel(*shared.value)
        for doc_id, out, text in each:
            value = model.score(text)
            yield doc_id, out, value, int(value >= THRESHOLD)

    return map_rows(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), rows, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns, in one pass.

    Null and empty texts stay where a text without gains does; each of some repeated rows stays or
    goes by itself; extra columns pass through whatever they are called; an empty table stays one.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.ordinary, model.toxic, model.weights))
    at = docs.columns.index("text")

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        model = CompressionModel(*shared.value)
        for row in each:
            if model.score(row[at]) < THRESHOLD:
                yield row

    return map_rows(docs, rows, docs.schema)
