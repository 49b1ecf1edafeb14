"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unit, unused

#: Hashed features: byte pairs, triples and quadruples share 2 ** FEATURE_BITS weights.
FEATURE_BITS = 14
GRAMS = (2, 3, 4)
#: Rows of a language that training may use, on average; the sample is drawn by a hash of the identifier and the row's number.
TRAIN_ROWS = 2000
#: Languages that may be learned; the driver gets 2 ** FEATURE_BITS counts of each at most.
LANGUAGES = 1000
UNDETERMINED = "und"
#: A text is ambiguous when the two nearest codewords are closer than this, as a part of the loss.
AMBIGUOUS = 0.02
CHUNK = 1 << 20
#: A document stays in a corpus if the nearest codeword has at least this share among all; less is no language's majority.
LEAST_SCORE = 0.5
#: By how much a mean log-odds counts in the loss and in the score.
SCALE = 2.5


def features(data: np.ndarray, bits: int = FEATURE_BITS) -> np.ndarray:
    """Counts of hashed byte n-grams of one text. Upper case ASCII counts as lower case."""
    out = np.zeros(1 << bits, np.int64)
    for at in range(0, len(data), CHUNK):
        d = data[at : at + CHUNK + GRAMS[-1] - 1]
        d = np.where((d >= 65) & (d <= 90), d + 32, d).astype(np.uint32)
        code = d[:-1] << 8 | d[1:] if len(d) > 1 else np.empty(0, np.uint32)
        for n in GRAMS:
            if n > GRAMS[0]:
                code = (code[:-1] << 8 | d[n - 1 :]) if len(code) > 1 else np.empty(0, np.uint32)
            mine = code[:CHUNK]
            out += np.bincount((mine * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - bits), minlength=1 << bits)
    return out


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1. Few classes get every split (the exhaustive code); more get a random code of 15 log2 k
    bits, the best of 50 seeded draws by its least distance."""
    if k <= 2:
        return np.array([[1], [-1]][:k], np.int8).reshape(k, 1)
    if k <= 7:
        m = np.arange(1, 1 << (k - 1))
        return np.stack([np.where(m >> i & 1, 1, -1) for i in range(k - 1)] + [-np.ones_like(m)]).astype(np.int8)
    rng, n, best, least = np.random.default_rng(0), math.ceil(15 * math.log2(k)), None, -1
    for _ in range(50):
        c = rng.choice(np.array([-1, 1], np.int8), (k, n))
        if (np.abs(c.sum(0)) == k).any():
            continue
        d = (n - c.astype(int) @ c.T.astype(int)) // 2
        if (low := int(d[~np.eye(k, dtype=bool)].min())) > least:
            best, least = c, low
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def margins(self, counts: np.ndarray) -> np.ndarray:
        """Of each bit the mean log-odds of a feature, so that long and short texts have the same scale."""
        return counts @ self.weights / max(1, counts.sum()) + self.bias / max(1, counts.sum())

    def decode(self, counts: np.ndarray) -> tuple[int, float, bool]:
        """The nearest codeword by logistic loss, weighted by each bit's confidence; its share among all; ambiguity."""
        losses = np.logaddexp(0, -self.code * (SCALE * self.margins(counts))).mean(1)
        order = np.argsort(losses, kind="stable")
        share = np.exp(-(losses - losses[order[0]]) * SCALE)
        gap = float((losses[order[1]] - losses[order[0]]) / max(1e-9, losses[order[1]])) if len(order) > 1 else 1.0
        return int(order[0]), float(share[order[0]] / share.sum()), gap < AMBIGUOUS


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Model:
    """Fits the bits on a bounded sample: about train_rows rows of each language, or all if it has fewer.

    Executors count the sample's n-grams; the driver gets a count for each language and feature, so more than LANGUAGES
    different labels are refused. A bit's classifier is a log-odds weight for each feature between the languages with a
    one and those with a minus one.
    """
    labelled = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).filter("l IS NOT NULL AND t IS NOT NULL")
    sizes = {r["l"]: r["count"] for r in labelled.groupBy("l").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"{lang_col} has more than {LANGUAGES} different labels")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 1), np.int8), np.zeros((1 << FEATURE_BITS, 1)), np.zeros(1))
    shares = F.create_map(*[F.lit(x) for kv in ((k, min(1.0, train_rows / v)) for k, v in sizes.items()) for x in kv])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for t, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                x = features(np.frombuffer(t.as_buffer() or b"", np.uint8))
                sums[lang] = sums[lang] + x if lang in sums else x
        for lang, x in sums.items():
            at = np.flatnonzero(x)
            yield pa.record_batch({"l": pa.array([lang] * len(at), pa.string()), "f": pa.array(at, pa.int64()), "n": pa.array(x[at], pa.int64())})

    sample = labelled.filter(unit(F.col("i"), F.monotonically_increasing_id(), F.lit(11)) < shares[F.col("l")]).select("t", "l")
    total = np.zeros((len(languages), 1 << FEATURE_BITS))
    place = {x: i for i, x in enumerate(languages)}
    got = sample.mapInArrow(count, "l string, f long, n long").groupBy("l", "f").agg(F.sum("n").alias("n")).toPandas()
    total[got["l"].map(place).to_numpy(int), got["f"].to_numpy(int)] = got["n"]
    code = codewords(len(languages))
    share = (total + 0.5) / (total + 0.5).sum(1, keepdims=True)
    weights = np.empty((1 << FEATURE_BITS, code.shape[1]))
    for j, bits in enumerate(code.T):
        ones, rest = share[bits > 0], share[bits < 0]
        weights[:, j] = np.log(ones.mean(0)) - (np.log(rest.mean(0)) if len(rest) else np.log(ones.mean(0)) - 1)
    return Model(languages, code, weights, np.zeros(code.shape[1]))


def is_held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: the CRC-32 of the identifier as text leaves 2 when divided by 4. Null is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def answers(model: Model, texts: pa.Array, letters: pa.Array) -> tuple[list[str], list[float], list[bool]]:
    """lang_pred, score and ambiguous of each text, of which it is known whether it has a letter."""
    langs, scores, unsure = [], [], []
    for t, has in zip(texts, letters.to_pylist(), strict=True):
        if has and model.languages:
            k, score, odd = model.decode(features(np.frombuffer(t.as_buffer(), np.uint8)))
            langs.append(model.languages[k]), scores.append(score), unsure.append(odd)
        else:
            langs.append(UNDETERMINED), scores.append(0.0), unsure.append(True)
    return langs, scores, unsure


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of every whole text: doc_id, lang_pred, score (0 to 1), ambiguous. Only the text is looked at.

    A text that is null or has no letter, or any text if nothing was learned, is `und` with score 0 and ambiguous.
    Repeated rows get the same answer each; long texts are read in chunks; other columns are not read.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores, unsure = answers(model, b.column(1), b.column(2))
            yield pa.record_batch({"doc_id": b.column(0), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64()), "ambiguous": pa.array(unsure, pa.bool_())})

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), has_letter(text_col).alias("has"))
    return chosen.mapInArrow(predict, "doc_id long, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", languages: Sequence[str] | None = None, least_score: float = LEAST_SCORE) -> DataFrame:
    """docs without the rows that identify() calls `und`, gives a lower score than least_score, or finds in another language
    than the wanted ones (None: all that were learned); all columns stay. One pass: the answer is put beside each row."""
    if not model.languages:
        return docs.limit(0)
    schema, letter, wanted = docs.schema, unused(docs, "letter"), set(model.languages if languages is None else languages) - {UNDETERMINED}

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores, _ = answers(model, b.column(text_col), b.column(letter))
            yield b.select(schema.names).filter(pa.array([x in wanted and s >= least_score for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.withColumn(letter, has_letter(text_col)).mapInArrow(predict, schema)
