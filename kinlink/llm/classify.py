"""Language identification and toxicity on Spark: bounded labelled sample, one numpy fit, Arrow prediction."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.llm import subword
from kinlink.llm.common import arrow, prepare, text_bytes

#: More distinct labels than this are an error: a label column is expected, not free text.
MAX_CLASSES = 256

#: Byte n-grams across words tell languages apart.
LANGUAGE = subword.Shape(sizes=(2, 3, 4), bits=14, dim=16, epochs=5, rate=0.05)

#: n-grams inside words, so that a misspelling shares most of its vectors with the word meant.
TOXICITY = subword.Shape(sizes=(4, 5, 6), bits=18, dim=4, within_words=True, epochs=6, rate=0.05, least_steps=600)

_LETTER = re.compile(r"[^\W\d_]")
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def fit(docs: DataFrame, labels: DataFrame, shape: subword.Shape, per_class: int, overall: int = 0, held_back: float = 0.1) -> subword.Model:
    """Fit on a bounded sample of docs (doc_id, text) labelled by labels (doc_id, label): of each label about per_class, or
    its share of `overall` documents if that is more.

    Rows with a null label or doc_id are left out; of several labels of a doc_id the largest counts. Ids are picked from the
    labels by a hash, so the picked ids are a broadcast of bounded size and texts are not shuffled; texts and their counts are whole. Their
    bags (at most 8 x 2^bits bytes each, compressed on the way) are made on the executors and only these reach the driver. Rows weigh what their
    label's share of all labels says. A tenth of the sample is held back to calibrate. No labels give a model without classes.
    """
    spark = prepare(docs.sparkSession)
    rows = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().limit(MAX_CLASSES + 1).collect()}
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} labels")
    classes = sorted(counts)
    if not classes:
        return subword.Model(shape, [], np.zeros((0, 1 << shape.bits), np.float32), np.zeros(0))
    field = T.StructField("label", labels.schema["label"].dataType)
    total = sum(counts.values())
    shares = spark.createDataFrame([(k, min(1.0, max(per_class / n, overall / total))) for k, n in counts.items()], T.StructType([field, T.StructField("share", T.DoubleType())]))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.join(F.broadcast(shares), "label").where(draw < F.col("share")).select("doc_id", "label")
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("label", "text", F.xxhash64("doc_id", "text").alias("key"))
    kind = field.dataType.simpleString()

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pack = zstandard.ZstdCompressor(level=1).compress
            # Buckets ascend, so their differences are small numbers, which compress well.
            found = [pack(np.diff(x, prepend=np.uint32(0)).astype("<u4").tobytes() + c.astype("<u4").tobytes()) for x, c in subword.bags(*text_bytes(b[1]), shape)]
            yield pa.record_batch([b[0], pa.array(found, pa.binary()), b[2]], ["label", "bag", "key"])

    sample = arrow(texts, bag, f"label {kind}, bag binary, key long").toArrow().sort_by("key")
    unpack, bags = zstandard.ZstdDecompressor().decompress, []
    two = None
    for x in sample["bag"]:
        two = np.frombuffer(unpack(x.as_buffer()), "<u4").reshape(2, -1)
        bags.append((np.cumsum(two[0], dtype=np.uint32), two[1].astype(np.float32)))
    place = {k: i for i, k in enumerate(classes)}
    labels = np.array([place[k] for k in sample["label"].to_pylist()], np.int64)
    del sample
    drawn = np.bincount(labels, minlength=len(classes))
    weights = np.array([counts[k] for k in classes])[labels] / np.maximum(drawn[labels], 1)
    weights = weights / weights.mean() if len(weights) else weights
    full = np.array([len(b) > 0 for b, _ in bags], bool)
    back = np.random.default_rng(shape.seed).random(len(bags)) < held_back
    own, kept = np.flatnonzero(full & ~back), np.flatnonzero(full & back)
    taught, kept_bags = [bags[i] for i in own], [bags[i] for i in kept]
    del bags, two
    model = subword.train(taught, labels[own], classes, shape, weights[own])
    model.prior = np.array([counts[k] for k in classes]) / sum(counts.values())
    subword.calibrate(model, subword.bag_logits(model, kept_bags), labels[kept], weights[kept])
    return model


def has_letter(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    out = np.zeros(len(offsets) - 1, bool)
    for i in np.flatnonzero(np.diff(offsets)):
        own = buf[offsets[i] : offsets[i + 1]]
        out[i] = bool(_ASCII_LETTER[own].any()) or bool((own >= 128).any()) and bool(_LETTER.search(own.tobytes().decode("utf-8", "replace")))
    return out


def _scored(docs: DataFrame, model: subword.Model, fields: list[tuple[str, T.DataType]], answer, keep_text: bool) -> DataFrame:
    """docs with the columns that answer(probabilities, buf, offsets) gives; columns of these names are replaced."""
    prepare(docs.sparkSession)
    docs = docs.drop(*(n for n, _ in fields))
    names = [c for c in docs.columns if keep_text or c != "text"]
    schema = T.StructType([*(docs.schema[c] for c in names), *(T.StructField(n, t) for n, t in fields)])
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at, width = docs.columns.index("text"), len(docs.columns)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for b in batches:
            buf, offsets = text_bytes(b[at])
            p = subword.softmax(subword.logits(own, buf, offsets) / own.temperature) if own.classes else np.zeros((len(b), 0))
            yield pa.record_batch([*(b[c] for c in range(width) if keep_text or c != at), *answer(p, buf, offsets)], [*names, *(n for n, _ in fields)])

    return arrow(docs, score, schema)


def predict_language(docs: DataFrame, model: subword.Model, keep_text: bool = False, names: tuple[str, ...] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs (with text) plus lang_pred string, score double and rejected boolean, under these or other `names`.

    A null text or one without a letter is `und` with score 0 and rejected; under a model without classes every text is `und`
    with score 0, but only those are rejected; other texts get the likeliest label and its calibrated probability, and are
    rejected under the model's calibrated level. Columns with the names are replaced; an empty
    table gives no rows; lang is never read.
    """
    classes, level = [str(c) for c in model.classes], model.reject

    def answer(p: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        lettered = has_letter(buf, offsets)
        known = lettered & bool(classes)
        best = p.argmax(axis=1) if classes else np.zeros(len(p), int)
        top = np.where(known, p[np.arange(len(p)), best], 0.0) if classes else np.zeros(len(p))
        labels = [classes[k] if ok else "und" for k, ok in zip(best, known)]
        return [pa.array(labels, pa.string()), pa.array(top, pa.float64()), pa.array(~lettered | (known & (top < level)))]

    return _scored(docs, model, list(zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()))), answer, keep_text)


def predict_toxicity(docs: DataFrame, model: subword.Model, threshold: float = 0.3, keep_text: bool = False) -> DataFrame:
    """docs (with text) plus score double, the calibrated probability of label 1, and predicted int (score >= threshold).

    Texts without n-grams, null and empty ones too, have label 1's share of the labels; a model that has seen no label 1 gives 0,
    one that has seen only label 1 gives 1. Columns of these names are replaced; an empty table gives no rows.
    """
    classes = list(model.classes)

    def answer(p: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        s = p[:, classes.index(1)] if 1 in classes else np.zeros(len(p))
        return [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))]

    return _scored(docs, model, [("score", T.DoubleType()), ("predicted", T.IntegerType())], answer, keep_text)
