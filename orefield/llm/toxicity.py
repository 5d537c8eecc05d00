"""Toxicity by noisy-channel deobfuscation: decode disguised words under a character model, then score the restored text.

A character trigram model is counted over all whole texts. A disguised token (digits or signs among letters or
alone, letters drawn out, letters spaced apart) is a lattice: each sign stands for the letters it may disguise, for
nothing (a separator) or for a word break, and each repeated letter may be dropped. Viterbi finds the
likeliest reading under the channel's costs and the character model. The features of a document are the words
of its restored text and their beginnings, as 32-bit hashes, so that there are as many as the texts hold. Those that
labelled documents tell toxic by beyond chance are weighed by a logistic regression.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, joined, slices, whole

SAMPLE = 60_000  # labelled rows at most that the classifier is fitted on
STRENGTH = 2.0  # standard deviations by which a feature's share of toxic documents must pass what chance gives
FULL = 4.0  # at this strength features count in full; weaker ones are held back by the square of their part of it
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)

#: Symbols of the character model: 0 word break, a-z, U+00DF to U+00FF, 60 any other letter.
SYMBOLS = 61
_TABLE = np.zeros(256, np.uint8)
_TABLE[97:123] = np.arange(1, 27)
_TABLE[65:91] = np.arange(1, 27)
_TABLE[0xC4:0xF5] = 60
_LATER = np.zeros(256, np.uint8)  # after the byte C3
_LATER[0x9F:0xC0] = np.arange(27, 60)
_LATER[0x80:0x9F] = np.arange(28, 59)


def symbols(raw: np.ndarray) -> np.ndarray:
    """One symbol for each code point of UTF-8 bytes."""
    s = _TABLE[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    s[lead] = _LATER[raw[lead + 1]]
    return s[(raw & 0xC0) != 0x80]


def symbol(c: str) -> int:
    x = ord(c)
    if 97 <= x < 123:
        return x - 96
    if 0xDF <= x <= 0xFF:
        return x - 0xDF + 27
    return 60 if c.isalpha() else 0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in slices(batches, "text"):
        raw, off = joined(batch.column("text"))
        if not len(raw):
            continue
        # Two breaks before each text, so that no trigram spans two texts.
        s = np.concatenate([symbols(np.insert(raw, np.repeat(off[:-1], 2), 32)), [0]]).astype(np.int32)
        total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["gram", "n"])


def character_model(docs: DataFrame) -> tuple[np.ndarray, float]:
    """Log-probabilities [a, b, c] of symbol c after a, b, from the counts of all texts, smoothed by shorter contexts; and their mean over the texts.

    The counts that reach the driver are at most 61^3, however many texts there are.
    """
    n = np.zeros(SYMBOLS**3)
    found = docs.select(whole().alias("text")).mapInArrow(_counted, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    n[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    uni = (n.sum((0, 1)) + 1) / (n.sum() + SYMBOLS)
    bi = (n.sum(0) + 5 * uni) / (n.sum((0, 2))[:, None] + 5)
    model = np.log((n + 5 * bi[None]) / (n.sum(2)[:, :, None] + 5)).astype(np.float32)
    return model, float((n * model).sum() / max(n.sum(), 1))


LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "µ": "u"}
SEPARATORS = frozenset(" .-_*~'/\\,:;^`\"=#%&")
_SWAP, _SKIP, _BREAK, _REPEAT = -1.0, -0.5, -5.0, -0.7


class Restorer:
    """Decodes tokens under a character model; `usual` is the mean log-probability of a sign of ordinary text."""

    def __init__(self, model: np.ndarray, usual: float = -math.inf):
        self.model, self.usual = model.tolist(), usual

    def decode(self, token: str, likely: bool = False) -> str:
        """The likeliest reading of a lower-case token; with `likely`, nothing if ordinary text would be likelier. Time and memory follow the token's length."""
        states: dict[tuple[int, int, bool], tuple[float, tuple | None]] = {(0, 0, False): (0.0, None)}
        before = ""
        for c in token:
            ways = [(c, 0.0)] if c.isalpha() else [(x, _SWAP) for x in LEET.get(c, "")]
            new: dict[tuple[int, int, bool], tuple[float, tuple | None]] = {}

            def put(key: tuple[int, int, bool], score: float, text: tuple | None, new: dict = new) -> None:
                if key not in new or new[key][0] < score:
                    new[key] = (score, text)

            # Readings are linked from their last sign backwards, so that none is copied.
            for (a, b, cut), (score, text) in states.items():
                for x, cost in ways:
                    s = symbol(x)
                    put((b, s, False), score + cost + self.model[a][b][s], (text, x))
                if c == before and c.isalpha() and text:
                    put((a, b, cut), score + _REPEAT, text)
                if not c.isalpha():
                    if c in SEPARATORS:
                        put((a, b, cut), score + _SKIP, text)
                    if not cut:
                        put((b, 0, True), score + _BREAK + self.model[a][b][0], (text, " "))
                    else:
                        put((a, b, True), score + _SKIP, text)
            states, before = new, c
        score, text = max(((score + self.model[a][b][0], text) for (a, b, _), (score, text) in states.items()), key=lambda x: x[0])
        if likely and score < (self.usual + _SWAP) * (len(token) + 1):
            return ""
        out = []
        while text:
            text, x = text
            out.append(x)
        return "".join(reversed(out))


_EDGES = ".,;:!?\"'()[]{}<>|%&*$#@-_~=+/\\`^"
_DRAWN = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\S)(?:[^\s]\s){2,}[^\s](?!\S)")
_LETTERS = re.compile(r"[^\W\d_]+")
_DISGUISED_ENDS = (frozenset("@$!|(+<"), frozenset("@$|+"))
_NO_LETTERS = "".join(c for c in _EDGES if c not in LEET)


def token_words(token: str, restorer: Restorer) -> list[str]:
    """Words of a lower-case token as it stands and as restored.

    A token without letters is a word only if its reading is as likely as ordinary text, so that numbers mostly are none.
    """
    core = token.strip(_EDGES)
    plain = core.isalpha()
    out = [core] if plain else _LETTERS.findall(core)
    if not out:
        signs = token.strip(_NO_LETTERS)
        return restorer.decode(signs, likely=True).split() if any(c in LEET for c in signs) else out
    ends = token[0] in _DISGUISED_ENDS[0] or token[-1] in _DISGUISED_ENDS[1]
    if not plain or ends or _DRAWN.search(core):
        out = out + restorer.decode(core).split()
        if ends:
            out = out + restorer.decode(token).split()
    return out


def word_features(word: str) -> list[int]:
    """Hashes of a word of any length and of its beginnings."""
    return [zlib.crc32(word.encode()), *(zlib.crc32(f"{word[:n]}~".encode()) for n in PREFIXES if len(word) > n)]


class _Features(dict):
    """Features of lower-case tokens (only those in `known`, if given), cached up to a bound."""

    def __init__(self, restorer: Restorer, known: dict[int, float] | None = None, most: int = 400_000):
        super().__init__()
        self.restorer, self.known, self.most = restorer, known, most

    def _kept(self, words: list[str]) -> tuple[int, ...]:
        found = {f for w in words for f in word_features(w)}
        return tuple(found if self.known is None else found & self.known.keys())

    def __missing__(self, token: str) -> tuple[int, ...]:
        out = self._kept(token_words(token, self.restorer))
        if len(token) <= 48:
            if len(self) >= self.most:
                self.clear()
            self[token] = out
        return out

    def of(self, text: str) -> set[int]:
        low = text.lower()
        found: set[int] = set()
        found.update(*map(self.__getitem__, set(low.split())))
        for m in _SPACED.finditer(low):
            found.update(self._kept(self.restorer.decode(re.sub(r"\s", " ", m[0])).split()))
        return found


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([np.zeros(0, np.int32), *arrays])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat, pa.int32()))


def _featured(model: tuple[np.ndarray, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = _Features(Restorer(*model))
        for batch in slices(batches, "text"):
            found = [np.fromiter(have.of(t), np.uint32).view(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), _lists(found)], names=["toxic", "features"])

    return run


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, n1, n0: toxic and other rows with it; added up over some millions of features at a time."""

    def added(held: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        toxic = key & 1
        return pa.RecordBatch.from_arrays([pa.array((key >> 1).astype(np.int32)), pa.array(n * toxic), pa.array(n * (1 - toxic))], names=["feature", "n1", "n0"])

    held, size = [np.zeros(0, np.int64)], 0
    for batch in batches:
        x = batch.column("features")
        y = np.repeat(batch.column("toxic").to_numpy(), np.diff(x.offsets.to_numpy()))
        held.append(x.flatten().to_numpy().astype(np.int64) * 2 + y)
        size += len(held[-1])
        if size > 1 << 22:
            yield added(held)
            held, size = [np.zeros(0, np.int64)], 0
    yield added(held)


def _chosen(features: np.ndarray):
    """Of each row only these (sorted) features, by their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features")
            flat = x.flatten().to_numpy()
            at = np.minimum(np.searchsorted(features, flat), len(features) - 1)
            have = features[at] == flat
            ends = np.concatenate([[0], np.cumsum(have)])[x.offsets.to_numpy() - x.offsets[0].as_py()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[have], pa.int32()))], names=["toxic", "features"])

    return run


def fit(of: np.ndarray, at: np.ndarray, y: np.ndarray, size: np.ndarray, l2: float = 1.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on the presence of features (rows `of` have features `at`), each of its own size: weights and intercept, by accelerated gradient descent."""
    n, x = len(size), size[at]
    w, b = np.zeros(n), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for step in range(1, steps + 1):
        z = b + np.bincount(of, weights=w[at] * x, minlength=len(y))
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gw, gb = np.bincount(at, weights=g[of] * x, minlength=n) + l2 * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.1 * math.sqrt(1 - 0.99**step) / (1 - 0.9**step) * (1 if step < steps * 0.7 else 0.2)
        w, b = w - rate * m / (np.sqrt(v) + 1e-8), b - rate * mb / (math.sqrt(vb) + 1e-8)
    return w * size, b


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, model: tuple[np.ndarray, float], sample: int = SAMPLE, strength: float = STRENGTH) -> tuple[dict[int, float], float]:
    """Weights of features and intercept from the labelled rows that are not held out, about `sample` of them at most.

    Beyond that number labels are chosen by a hash of doc_id, so that all they reach here is bounded: the labels that
    are broadcast, and the rows that the driver fits on, which are their significant features only. A doc_id labelled more
    than once counts as toxic if any label says so; null labels are none. A feature gets a weight if toxic rows
    have it 1.5 times as often as others, and the root of its deviance from an equal share is `strength`
    or more. Without both classes there are no features and the intercept is the smoothed rate.
    """
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = known.count()
    if n > sample:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(n)) < int(sample * 0.97))
    rows = docs.select("doc_id", whole().alias("text")).join(F.broadcast(known), "doc_id").select("toxic", "text")
    found = durable(rows.mapInArrow(_featured(model), "toxic int, features array<int>").withColumn("row", F.monotonically_increasing_id()))
    sizes = {r["toxic"]: r["count"] for r in found.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    none = {}, math.log((n1 + 1) / (n0 + 9))
    if not n1 or not n0:
        return none
    counts = found.select("toxic", "features").mapInArrow(_tallied, "feature int, n1 bigint, n0 bigint").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    share = n1 / (n1 + n0)
    term = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col("n1") + F.col("n0")) * p))).otherwise(0.0)
    often = (F.col("n1") + 0.5) / (n1 + 1) > 1.5 * (F.col("n0") + 0.5) / (n0 + 1)
    deviance = F.sqrt(F.greatest(F.lit(0.0), 2 * (term("n1", share) + term("n0", 1 - share))))
    marks = counts.filter(often).select("feature", deviance.alias("d")).filter(F.col("d") >= strength).toArrow().sort_by("feature")
    features, size = marks.column("feature").to_numpy(), np.minimum(1, marks.column("d").to_numpy() / FULL) ** 2
    if not len(features):
        return none
    if n1 + n0 > sample:  # repeated rows of labelled documents
        found = found.filter(F.pmod(F.xxhash64("row"), F.lit(n1 + n0)) < int(sample * 0.97))
    x = found.select("toxic", "features").mapInArrow(_chosen(features), "toxic int, features array<int>").toArrow().combine_chunks()
    lists = x.column("features").combine_chunks()
    of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    w, b = fit(of, lists.flatten().to_numpy().astype(np.int64), x.column("toxic").to_numpy().astype(float), size)
    return dict(zip(features.view(np.uint32).tolist(), w.tolist(), strict=True)), float(b)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs with held_out, score (0 to 1, higher: likelier toxic) and predicted (1 if score >= threshold).

    Scores read the whole text alone. Null and empty texts have no features and get the intercept's score.
    Rows whose crc32(doc_id as text) mod 4 is 2 are held out from learning; a null doc_id is not held out and
    has no label. Repeated rows get equal scores; an empty table gives no rows. Columns of docs named
    held_out, score or predicted are replaced.
    """
    model = character_model(docs)
    weights, b = trained(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), model, sample)
    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    text = f"c{names.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = _Features(Restorer(*model), weights)
        for batch in slices(batches, text):
            z = [b + math.fsum(map(weights.__getitem__, have.of(t or ""))) for t in batch.column(text).to_pylist()]
            score = 1 / (1 + np.exp(-np.clip(np.array(z, float), -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, "score"])

    # Columns go through Arrow by number: their names may hold anything.
    source = docs.select(*(F.col("text").cast("string").alias(text) if c == "text" else F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    schema = reduce(lambda s, f: s.add(f.name, f.dataType, True), source.schema, type(docs.schema)()).add("score", "double")
    out = source.mapInArrow(run, schema).toDF(*names, "score")
    return out.withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
