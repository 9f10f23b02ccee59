"""Toxicity by multiple-instance learning: sentences are the instances, documents carry the labels.

A sentence's score is a logistic of its words' weights; a document's is the noisy-or of its
sentences. The weights are fitted by gradient ascent on the documents' likelihood, so that only
labels of documents are needed, and the sentence scores then locate the offending passages.

Training takes at most ``PER_CLASS`` labelled documents of each class in expectation, chosen by a
hash. Words are known by 64-bit hashes; the model keeps at most ``VOCABULARY`` that at least ``MIN_DOCUMENTS`` sampled
documents hold and that tell the classes apart. Their counts are a Spark aggregation, and in each step of the fit (by limited-memory
quasi-Newton steps) tasks sum the gradient over their part of the sample; only weights and
gradients come to the driver. Every text is scored as a whole.

Defined cases: null and empty texts have no sentence and score 0; a null label is not learned;
several labels of one document count as toxic if one is; without both classes in the sample
every score is 0; repeated rows get repeated results; a null doc_id is not held out and not learned from; an empty table gives no
rows; other columns than doc_id, text and those to keep are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, blocks
from .textkit import _LOWER, code_points, hash_runs, raw, runs

PER_CLASS = 2000
MIN_DOCUMENTS = 4
VOCABULARY = 1 << 15
#: The logit of a sentence whose words say nothing.
BIAS = -4.0
#: Parts of the sample, steps of the fit and past steps that a step looks at.
PARTS, STEPS, MEMORY = 8, 24, 8
#: Lengths in bytes of the prefixes that count as words of their own, so that inflected forms share a weight.
PREFIXES = (4, 5, 6, 7, 8)
#: Bits of the table that sorts out most unknown words before the search.
_BITS = 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Instances:
    """Words of a block of texts by sentence. Sentences are numbered through the block."""

    data: np.ndarray
    text_at: np.ndarray
    word: np.ndarray  #: hash of each word and of its prefixes
    sentence: np.ndarray  #: the sentence of each word
    start: np.ndarray  #: byte offset of each sentence
    end: np.ndarray
    of: np.ndarray  #: index of each text's first sentence, one more than texts


def instances(col: pa.Array) -> Instances:
    data, text_at = raw(col)
    start, end = runs(_LETTER[data], text_at)
    s, e = runs(~_STOP[data], text_at)
    word, at = [hash_runs(data, start, end, _LOWER)], [start]
    for n in PREFIXES:
        longer = end - start > n
        word.append(hash_runs(data, start[longer], start[longer] + n, _LOWER) ^ np.uint64(n))
        at.append(start[longer])
    word, at = np.concatenate(word), np.concatenate(at)
    order = np.argsort(at, kind="stable")
    word, at = word[order], at[order]
    return Instances(data, text_at, word, np.searchsorted(s, at, "right") - 1, s, e, np.searchsorted(s, text_at))


def noisy_or(z: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 - product of (1 - logistic(z)) over each text's sentences."""
    total = np.zeros(len(z) + 1)
    np.cumsum(-np.logaddexp(0, z), out=total[1:])  # log(1 - logistic(z))
    return -np.expm1(np.minimum(0, total[of[1:]] - total[of[:-1]]))


class Model:
    """Weights of known words and a bias for each sentence."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        self.words, self.weights, self.bias = words, weights, bias
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(words & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def scores(self, x: Instances) -> np.ndarray:
        """The logit of each sentence; one without a known word is never toxic."""
        z = np.full(len(x.start), -np.inf)
        if not len(self.words):
            return z
        maybe = np.flatnonzero(self.seen[(x.word & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.words, x.word[maybe]), len(self.words) - 1)
        hit = self.words[at] == x.word[maybe]
        where, w = x.sentence[maybe[hit]], self.weights[at[hit]]
        known = np.bincount(where, minlength=len(z)) > 0
        return np.where(known, np.bincount(where, w, minlength=len(z)) + self.bias, z)


def likelihood(w: np.ndarray, word: np.ndarray, sentence: np.ndarray, of: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The log-likelihood of documents and its gradient. w: weights and the bias; word, sentence: of each known word; y: of each text."""
    n, owner = int(of[-1]), np.repeat(np.arange(len(y)), np.diff(of))
    known = np.bincount(sentence, minlength=n) > 0
    z = np.where(known, np.bincount(sentence, w[word], minlength=n) + w[-1], -np.inf)
    p, total = 1 / (1 + np.exp(-np.clip(z, -50, 50))), np.clip(noisy_or(z, of), 1e-9, 1 - 1e-9)
    g = np.where(y[owner] == 1, ((1 - total) / total)[owner] * p, -p) * known
    grad = np.bincount(word, g[sentence], minlength=len(w) - 1)
    return np.concatenate([[np.where(y == 1, np.log(total), np.log1p(-total)).sum()], grad, [g.sum()]])


def climb(w: np.ndarray, value, steps: int = STEPS, decay: float = 0.05) -> np.ndarray:
    """Maximises value(w) less decay / 2 times the squared distance of the weights from 0 and of the bias from ``BIAS``, by
    limited-memory quasi-Newton steps; value gives the gradient behind the value."""

    def at(w):
        got = value(w)
        own = np.append(w[:-1], w[-1] - BIAS)
        return got[0] - decay / 2 * own @ own, got[1:] - decay * own

    f, g = at(w)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    left = steps
    while left > 0:
        d, back = g.copy(), []
        for s, t in reversed(moves):
            back.append((s @ d) / (s @ t))
            d -= back[-1] * t
        d *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1.0, np.abs(g).max())
        for (s, t), a in zip(moves, reversed(back), strict=True):
            d += s * (a - (t @ d) / (s @ t))
        length = 1.0
        while left > 0:
            left -= 1
            new = w + length * d
            f2, g2 = at(new)
            if f2 >= f + 1e-4 * length * (g @ d):
                break
            length /= 3
        else:
            break
        s, t = new - w, g - g2
        if s @ t > 1e-10:
            moves = [*moves, (s, t)][-MEMORY:]
        gain, w, f, g = f2 - f, new, f2, g2
        if gain < 1e-4 * max(1.0, abs(f)):
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic, only such as may be learned from."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    none = Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / max(1, n.get(1, 0)))).otherwise(min(1.0, per_class / max(1, n.get(0, 0))))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity sample")), F.lit(1 << 20)) < share * (1 << 20)
    drawn = known.where(draw).limit(4 * per_class).select("doc_id", F.col("toxic").cast("int").alias("toxic"))  # the limit proves the bound of what is broadcast
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), "doc_id").select("toxic", "text")
    sample = scratch.save(sample.repartition(PARTS, F.xxhash64("text")))

    def held(batches):
        for b in blocks(batches):
            x = instances(b.column("text"))
            text = np.searchsorted(x.of, x.sentence, "right") - 1
            pair = np.unique(np.column_stack([text.astype(np.uint64), x.word]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 1].view(np.int64)), b.column("toxic").take(pa.array(pair[:, 0].astype(np.int64)))], names=["word", "toxic"])

    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return none
    counts = sample.mapInArrow(held, "word bigint, toxic int").groupBy("word").agg(F.sum("toxic").alias("df1"), F.sum(1 - F.col("toxic")).alias("df0"))
    w = F.log((F.col("df1") + 0.5) / (size[1] + 1)) - F.log((F.col("df0") + 0.5) / (size[0] + 1))
    telling = counts.withColumn("w", F.greatest(F.lit(-3.0), F.least(F.lit(5.0), w))).where((F.col("df1") + F.col("df0") >= MIN_DOCUMENTS) & (F.abs("w") >= 0.7) & ((F.col("w") < 0) | (F.col("df1") >= MIN_DOCUMENTS)))
    rows = telling.orderBy(F.desc(F.abs("w") * F.sqrt(F.col("df1") + F.col("df0"))), "word").limit(VOCABULARY).select("word", "w").toArrow()
    if not len(rows):
        return none
    vocabulary = rows["word"].to_numpy().view(np.uint64)
    order = np.argsort(vocabulary)
    vocabulary, w = vocabulary[order], rows["w"].to_numpy()[order] / (1 + len(PREFIXES))  # a word and its prefixes share its weight

    def encode(batches):
        for b in blocks(batches):
            x = instances(b.column("text"))
            at = np.minimum(np.searchsorted(vocabulary, x.word), len(vocabulary) - 1)
            ok = vocabulary[at] == x.word
            at, sentence = at[ok].astype(np.int32), x.sentence[ok]
            cut = np.searchsorted(sentence, x.of)
            word = [at[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)]
            place = [(sentence[a:z] - first).astype(np.int32).tobytes() for a, z, first in zip(cut[:-1], cut[1:], x.of[:-1], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(word, pa.binary()), pa.array(place, pa.binary()), pa.array(np.diff(x.of), pa.int64())], names=["toxic", "word", "sentence", "n"])

    encoded = scratch.save(sample.mapInArrow(encode, "toxic int, word binary, sentence binary, n bigint"))

    def value(w: np.ndarray) -> np.ndarray:
        def part(batches):
            total = np.zeros(len(w) + 1)
            for b in batches:
                if len(b):
                    of = np.append(0, np.cumsum(b.column("n").to_numpy()))
                    word, place = ([np.frombuffer(x, np.int32) for x in b.column(c).to_pylist()] for c in ("word", "sentence"))
                    sentence = np.concatenate(place).astype(np.int64) + np.repeat(of[:-1], [len(x) for x in place])
                    total += likelihood(w, np.concatenate(word), sentence, of, b.column("toxic").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        return np.sum([np.frombuffer(r["sums"]) for r in encoded.mapInArrow(part, "sums binary").collect()], axis=0)  # one row for each part

    w = climb(np.append(w, BIAS), value)
    keep = np.abs(w[:-1]) > 0.02
    return Model(vocabulary[keep], w[:-1][keep], float(w[-1]))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), blame: float = 0.5) -> DataFrame:
    """The kept columns, score, predicted, and offending: array of (start, end, score) of sentences in code points."""
    names = [f"_k{i}" for i in range(len(keep))]
    span = T.StructType().add("start", "long").add("end", "long").add("score", "double")
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep]).add("score", "double").add("predicted", "integer").add("offending", T.ArrayType(span))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for b in blocks(batches, "_text"):
            x = instances(b.column("_text"))
            z = model.scores(x)
            p = noisy_or(z, x.of)
            found: list[list[dict]] = [[] for _ in range(len(b))]
            hits = np.flatnonzero(z >= np.log(blame / (1 - blame)))
            owner = np.searchsorted(x.of, hits, "right") - 1
            if len(hits):
                base = code_points(x.data, x.text_at)
                s, e = code_points(x.data, x.start[hits]), code_points(x.data, x.end[hits])
                for k, i in enumerate(owner):
                    found[i].append({"start": int(s[k] - base[i]), "end": int(e[k] - base[i]), "score": float(1 / (1 + np.exp(-z[hits[k]])))})
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32()), pa.array(found, kind)], names=schema.names)

    return docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col("text").alias("_text")).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
