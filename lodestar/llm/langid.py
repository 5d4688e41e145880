"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; white space, digits and ASCII punctuation become one
separator each run, and character n-grams of the given orders are taken over
what is left, separators included.  They are hashed into a fixed number of
buckets.  The model, a matrix of log-probabilities (buckets x languages), is of a
size that doesn't depend on the data and is broadcast; whole texts are scored in
numpy, batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .tokens import freed, mix64, slices

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: What stands for a run of white space, digits and ASCII punctuation.
GAP = 32
#: The language of texts that belong to none.
UNKNOWN = "und"

_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = GAP
SLICE = 1 << 19
#: The share of texts expected in no known language.
UNKNOWN_PRIOR = 1e-3


@dataclass
class Model:
    """log_prob: buckets x languages; prior: by language; log-probabilities both."""

    languages: list[str]
    log_prob: np.ndarray
    prior: np.ndarray
    orders: tuple[int, ...]


def features(texts: pa.Array, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams, row by row; offsets of the rows).  A row begins and ends with a gap."""
    rows = pc.utf8_lower(texts.fill_null("")).to_pylist()
    joined = "\n".join(rows) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    length = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)) + 1
    row = np.repeat(np.arange(len(rows)), length)
    code = np.where(code < 128, _FOLD[np.minimum(code, 127)], code)
    # a row's last gap stays, even if the text ends with one
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != GAP) | (code[:-1] != GAP) | (row[1:] != row[:-1])
    code, row = code[keep], row[keep]
    n = len(code)
    parts, owners = [], []
    with np.errstate(over="ignore"):
        value = mix64(code.astype(np.uint64) + np.uint64(1))
        run = np.zeros(n, dtype=np.uint64)
        for order in range(1, max(orders) + 1):
            if order > n:
                break
            m = n - order + 1
            run = run[:m] * np.uint64(0x5851F42D4C957F2D) + value[order - 1 : order - 1 + m]
            if order in orders:
                within = row[:m] == row[order - 1 :] if order > 1 else code != GAP
                hashed = (run * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(buckets)
                parts.append(hashed[within].astype(np.int32))
                owners.append(row[:m][within])
    if not parts:
        return np.zeros(0, dtype=np.int32), np.zeros(len(rows) + 1, dtype=np.int64)
    owner = np.concatenate(owners)
    by_row = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(rows))
    return np.concatenate(parts)[by_row], np.concatenate([[0], np.cumsum(counts)])


def _scores(texts: pa.Array, log_prob: np.ndarray, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(sums of log-probabilities: rows x languages, n-grams of each row)."""
    ids, offsets = features(texts, orders, len(log_prob))
    counts = np.diff(offsets)
    out = np.zeros((len(counts), log_prob.shape[1]))
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = np.add.reduceat(log_prob[ids], offsets[:-1][full], axis=0)
    return out, counts


def train(docs: DataFrame, *, max_train_docs: int = 8000, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS, smoothing: float = 0.05) -> Model:
    """Fits the model on labelled rows (lang not null, text not empty).

    At most max_train_docs of each label, those with the lowest hashes of doc_id and
    text, so the choice is the same whenever the rows are, and no label is without a
    row however rare it is.  Priors are the labels' shares of all labelled rows.  With
    no labelled row the model has no language and every text is unknown.
    """
    spark = docs.sparkSession
    ship(spark)
    labelled = docs.where("lang IS NOT NULL AND trim(lang) <> '' AND length(text) > 0").select("lang", "text", F.xxhash64("doc_id", "text").alias("place"))
    # histograms of the hashes' leading 16 bits tell how far the lowest reach in each label, so that few more texts than those are moved
    step = F.shiftright("place", 48)
    rising = Window.partitionBy("lang").orderBy("step")
    held = labelled.groupBy("lang", step.alias("step")).count().withColumn("before", F.sum("count").over(rising) - F.col("count"))
    spans = held.groupBy("lang").agg(F.max(F.when(F.col("before") < max_train_docs, F.col("step"))).alias("reach"), F.sum("count").alias("held")).collect()
    if not spans:
        return Model([], np.zeros((buckets, 0), dtype=np.float32), np.zeros(0), orders)
    # one row a label, as the model has
    reach = F.broadcast(spark.createDataFrame([(r.lang, r.reach) for r in spans], "lang string, reach long"))
    lowest = Window.partitionBy("lang").orderBy("place")
    sample = labelled.join(reach, "lang").where(step <= F.col("reach")).withColumn("at", F.row_number().over(lowest)).where(F.col("at") <= max_train_docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                names = part.column("lang").to_pylist()
                ids, offsets = features(part.column("text"), orders, buckets)
                for name in set(names):
                    mine = np.repeat(np.array([x == name for x in names]), np.diff(offsets))
                    counts = np.bincount(ids[mine], minlength=buckets)
                    total[name] = total[name] + counts if name in total else counts
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.astype(np.int64).tobytes() for v in total.values()], pa.binary())], names=["lang", "counts"])

    got = {r.lang: np.zeros(buckets, dtype=np.int64) for r in spans}
    for r in sample.select("lang", "text").mapInArrow(count, "lang string, counts binary").collect():
        got[r.lang] += np.frombuffer(r.counts, dtype=np.int64)
    names = sorted(got)
    counts = np.array([got[k] for k in names], dtype=np.float64).reshape(len(names), buckets) + smoothing
    held_rows = {r.lang: r.held for r in spans}
    prior = np.log(np.array([held_rows[k] for k in names], dtype=np.float64) / sum(held_rows.values()))
    log_prob = np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32)
    return Model(names, np.ascontiguousarray(log_prob), prior, orders)


def _decider(docs: DataFrame, model: Model):
    """A function from texts to (index of the language, its posterior, n-grams), and the languages with "und" last."""
    ship(docs.sparkSession)
    names = [*model.languages, UNKNOWN]
    uniform = np.full((len(model.log_prob), 1), -np.log(len(model.log_prob)), dtype=np.float32)
    # buckets x languages: its size is fixed by the parameters and the number of languages
    shared = docs.sparkSession.sparkContext.broadcast((np.hstack([model.log_prob, uniform]), np.append(model.prior, np.log(UNKNOWN_PRIOR))))
    orders = model.orders

    def decide(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        log_prob, prior = shared.value
        sums, counts = _scores(texts, log_prob, orders)
        sums += prior
        best = np.argmax(sums, axis=1)
        best[counts == 0] = len(names) - 1
        top = sums[np.arange(len(best)), best]
        confidence = np.where(counts > 0, 1 / np.exp(sums - top[:, None]).sum(axis=1), 0.0)
        return best, confidence, counts

    return decide, names


def identify(docs: DataFrame, model: Model, *, keep: set[str] | None = None) -> DataFrame:
    """(doc_id, detected, confidence, accepted) of every row, other columns of docs left out.

    Beside the trained languages stands one more, "und", in which every bucket is
    as likely as any other; it wins where no language explains a text better than
    chance, and for texts without a letter (null, empty, digits, punctuation).
    accepted: the language is a trained one and among keep, if given.
    confidence: the posterior probability of the detected language, 0 for texts
    without a letter.  Ties go to the language that sorts first.  Repeated rows
    are scored each; a null doc_id stays null.  Texts are scored whole.
    """
    decide, names = _decider(docs, model)
    good = np.array([x != UNKNOWN and (keep is None or x in keep) for x in names])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            for part in slices(batch, 1, SLICE):
                best, confidence, _ = decide(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([names[i] for i in best], pa.string()), pa.array(confidence), pa.array(good[best])], names=["doc_id", "detected", "confidence", "accepted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, detected string, confidence double, accepted boolean")


def accept(docs: DataFrame, model: Model, *, keep: set[str] | None = None, label: str | None = None, certain: float = 0.99) -> DataFrame:
    """The rows of docs that identify() accepts, with all their columns as they are.

    label: a column that says the language; a row goes, too, where the text's language
    is another one with a posterior of certain at least.  A null or blank label, or
    one that the model doesn't know, contradicts nothing.
    """
    decide, names = _decider(docs, model)
    good = np.array([x != UNKNOWN and (keep is None or x in keep) for x in names])
    number = {x: i for i, x in enumerate(model.languages)}
    at = docs.columns.index("text")
    stated = docs.columns.index(label) if label else None

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            for part in slices(batch, at, SLICE):
                best, confidence, _ = decide(part.column(at))
                kept = good[best]
                if stated is not None:
                    own = np.array([number.get(x, -1) for x in part.column(stated).to_pylist()])
                    kept &= (own < 0) | (own == best) | (confidence < certain)
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(select, docs.schema)
