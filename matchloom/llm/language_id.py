"""Language ID by string kernels: blended-spectrum n-gram presence, Nystrom landmarks, one-versus-rest kernel ridge."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import chunks, texts_of

#: Labelled rows to learn from and landmarks among them, per language; longest n-gram; strength of the ridge.
ROWS_PER_LANGUAGE, LANDMARKS_PER_LANGUAGE, LONGEST, RIDGE = 300, 24, 3, 1e-2

#: Texts scored in one matrix product.
BATCH = 64

#: A text is in no learnt language if the share of its n-grams that no landmark has is over this many times the share
#: that all but one in a hundred of the winning language's sample stay below. Places by which short texts are eased.
STRANGE, TAIL, EASE = 5.0, 0.99, 10.0

#: The prediction for texts without a letter and, where asked for, in no learnt language.
NONE = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_SLOTS = 20
_PARTS = 256


def letters(text: str) -> str:
    """Lower-case letters (and signs that count as such in words), with one blank for whatever stands between."""
    return _NOT_LETTERS.sub(" ", text.lower())


def grams(text: str, longest: int) -> list[np.ndarray]:
    """64-bit hashes of the n-grams at each place, for n from 1 to ``longest``."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(code), np.uint64)
    for n in range(1, longest + 1):
        if n > len(code):
            break
        h = (h[:len(code) - n + 1] ^ code[n - 1:]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        out.append(h)
    return out


@dataclass
class Model:
    """Scores of a text are its presence vector over the landmarks' n-grams times ``weights``, over the vector's length.

    The kernel of two texts is the number of n-grams both have, over the root of the product of how many each has,
    where an n-gram counts if any landmark has it. ``weights`` is the product of the landmarks' own presence vectors
    with the coefficients of the ridge regression, so kernel values need not be formed one by one.
    """

    languages: list[str]
    longest: int
    known: np.ndarray  # hash of the n-gram in each slot
    number: np.ndarray  # its place in a presence vector, or -1
    size: int
    weights: np.ndarray | None = None
    most_strange: np.ndarray | None = None  # per language, the share of unknown n-grams from which a text is not in it

    def seen(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Presence vectors, and the share of places whose n-gram no landmark has."""
        out, strange = np.zeros((len(texts), self.size), np.float32), np.zeros(len(texts))
        for row, text in enumerate(texts):
            places = known = 0
            for h in grams(text, self.longest):
                slot = (h >> np.uint64(64 - _SLOTS)).astype(np.int64)
                slot = slot[self.known[slot] == h]
                out[row, self.number[slot]] = 1.0
                places += len(h)
                known += len(slot)
            strange[row] = (places - known) / (places + EASE)
        return out, strange

    def presence(self, texts: list[str]) -> np.ndarray:
        return self.seen(texts)[0]

    def judged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and the share of places whose n-gram no landmark has."""
        x, strange = self.seen(texts)
        return (x @ self.weights) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1.0)), strange

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.judged(texts)[0]


def _vocabulary(hashes: np.ndarray, languages: list[str], longest: int) -> Model:
    """Of n-grams that fall into one slot, the one with the least hash is kept."""
    hashes = np.unique(hashes)
    slot = (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)
    slot, first = np.unique(slot, return_index=True)
    known, number = np.zeros(1 << _SLOTS, np.uint64), np.full(1 << _SLOTS, -1, np.int64)
    known[slot], number[slot] = hashes[first], np.arange(len(slot))
    return Model(languages, longest, known, number, len(slot))


def learnable(id_col: str = "doc_id") -> Column:
    """Whether a row may be learnt from: its id's CRC-32, as text, is not divisible by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


def sample(docs: DataFrame, usable: Column, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """``(id, label, text, rank)``: at most ``rows`` usable rows of each label, those with the least hash of the id.

    Ids are chosen before any text is read: at most ``rows`` per label reach the driver. Of rows with one id and label,
    however many there are, only the text with the least hash counts; they are reduced before the shuffle.
    """
    from pyspark.sql import Window

    good = docs.filter(usable & F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    ids = good.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).distinct().withColumn("part", F.pmod(F.xxhash64("id", "label"), F.lit(_PARTS)))
    # the least of each part of a label, then of the label: what meets in one task is bounded
    for group in (["label", "part"], ["label"]):
        order = Window.partitionBy(*group).orderBy(F.xxhash64("id"), "id")
        ids = ids.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rows)
    ranked = ids.select("id", "label", "rank")
    picked = [tuple(r) for r in ranked.collect()]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("label", docs.schema[label_col].dataType), T.StructField("rank", T.IntegerType())])
    chosen = docs.sparkSession.createDataFrame(picked, schema)
    texts = good.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("_one")
    return texts.join(F.broadcast(chosen), ["id", "label"]).groupBy("id", "label", "rank").agg(one).select("id", "label", F.col("_one.text").alias("text"), "rank")


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = ROWS_PER_LANGUAGE,
        landmarks: int = LANDMARKS_PER_LANGUAGE, longest: int = LONGEST, ridge: float = RIDGE) -> Model | None:
    """Learn from a bounded sample of labelled rows. None if there is no labelled text with a letter.

    Rows with a null label, text or id are not learnt from; rows with one id and label count once. Texts of the sample are turned into hashes and kernel values by tasks; the driver sees those alone.
    """
    spark = docs.sparkSession
    chosen = sample(docs, usable, id_col, text_col, label_col, rows).persist()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = map(letters, texts_of(batch.column(1)))
            rows_ = [np.unique(np.concatenate(grams(x, longest))).tobytes() if x.strip() else b"" for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows_, pa.binary())], names=["label", "hashes"])

    kind = docs.schema[label_col].dataType.simpleString()
    marks = chosen.filter(F.col("rank") <= landmarks).orderBy("label", "rank").select("label", "text").mapInArrow(hashed, f"label {kind}, hashes binary").collect()
    sets = [np.frombuffer(r["hashes"], np.uint64) for r in marks if r["hashes"]]
    of = [r["label"] for r in marks if r["hashes"]]
    languages = sorted({r["label"] for r in marks if r["hashes"]})
    if not sets:
        chosen.unpersist()
        return None
    model = _vocabulary(np.concatenate(sets), languages, longest)
    z = np.zeros((len(sets), model.size), np.float32)
    for row, hashes in enumerate(sets):
        slot = (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)
        z[row, model.number[slot[model.known[slot] == hashes]]] = 1.0
    z /= np.sqrt(np.maximum(z.sum(1, keepdims=True), 1.0))
    shared = spark.sparkContext.broadcast((model, z))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_, z_ = shared.value
        for whole in batches:
            for batch in chunks(whole, BATCH):
                x, strange = model_.seen([letters(t) for t in texts_of(batch.column(1))])
                k = (x @ z_.T) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1.0))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in k.astype(np.float64)], pa.binary()),
                                                  batch.column(2), pa.array(strange)], names=["label", "k", "rank", "strange"])

    learnt = chosen.orderBy("label", "rank", "text").select("label", "text", "rank").mapInArrow(kernel, f"label {kind}, k binary, rank int, strange double").collect()
    chosen.unpersist()
    learnt = [r for r in learnt if r["label"] in languages]
    k = np.stack([np.frombuffer(r["k"], np.float64) for r in learnt])
    # what a landmark has that no other has is as strange as it would be in a text that was not learnt from
    _, back, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    alone = [(times[x] == 1).sum() / (len(x) + EASE) for x in np.split(back, np.cumsum([len(x) for x in sets])[:-1])]
    usual = {x: [a for a, y in zip(alone, of, strict=True) if y == x] for x in languages}
    for r in learnt:
        if r["rank"] > landmarks:
            usual[r["label"]].append(r["strange"])
    model.most_strange = np.array([STRANGE * np.quantile(usual[x], TAIL) for x in languages])
    target = np.array([[1.0 if r["label"] == x else -1.0 for x in languages] for r in learnt])
    # Nystrom features: kernel values against landmarks, whitened by the landmarks' own kernel
    value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = value > 1e-8 * value.max()
    whiten = vector[:, keep] / np.sqrt(value[keep])
    phi = k @ whiten
    beta = np.linalg.solve(phi.T @ phi + ridge * len(phi) * np.eye(phi.shape[1]), phi.T @ target)
    model.weights = (z.T.astype(np.float64) @ (whiten @ beta)).astype(np.float32)
    return model


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", reject: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) from its text alone.

    Whole texts are scored. The score is the winning regression's output, from -1 to 1, moved to 0 to 1; of equal
    outputs the first language by name wins. Null texts and texts without a letter are ``und`` with score 0, and so is
    everything without a model. With ``reject`` so are texts with more unknown n-grams than the winning language's sample
    lets expect; a language with too few rows to tell rejects nothing. Repeated rows are scored alike; other columns stay, but existing ``lang_pred`` and
    ``score`` are replaced. No shuffle.
    """
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(NONE), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred string, score double>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        names = np.array(m.languages, object)
        for column in batches:
            lang, score = [], []
            for start in range(0, len(column), BATCH):
                texts = [letters(x) for x in texts_of(column.slice(start, BATCH))]
                out, strange = m.judged(texts)
                some = np.array([any(map(str.isalpha, x)) for x in texts])
                best = out.argmax(1)
                if reject:
                    some &= strange <= m.most_strange[best]
                lang += np.where(some, names[best], NONE).tolist()
                score.append(np.where(some, np.clip((out.max(1).astype(np.float64) + 1) / 2, 0.0, 1.0), 0.0))
            values = np.concatenate(score) if score else np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(values, pa.float64())], names=["lang_pred", "score"])

    return docs.withColumn("_scored", scored(text_col)).select(*docs.columns, "_scored.lang_pred", "_scored.score")
