"""Language identification in two steps: the family, then linear support vector machines within it.

Features are hashed byte trigrams (with the word's edges) of the text with A-Z lower-cased, as shares of all
trigrams. First one-versus-rest linear support vector machines tell language families apart. Within the
chosen family one machine for every pair of its languages votes for one of the two; most votes win, and
of equal ones the largest sum of margins. Margins become a score through a logistic of the lead over the
runner-up, family times language; within a family the lead is twice the margin of their own machine.

Training takes a bounded sample: at most ``PER_LANGUAGE`` texts of each language in expectation,
chosen by a hash, as vectors of ``DIMENSIONS`` shares. Every text is predicted, as a whole.

Defined cases: a null text or one without a letter is ``und`` with score 0; a null language is
not learned; a family of one language needs no second step; without any training text every text
is ``und``; repeated rows get repeated results; rows without a doc_id are predicted like others and not learned from; an empty
table gives no rows; other columns than doc_id, text, lang and those to keep are not read. ``recognised`` gives all columns
back, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks
from .textkit import mix, raw

DIMENSIONS = 4096
PER_LANGUAGE = 300
UNKNOWN = "und"
#: Families of ISO 639-1 codes; a code that is not listed is a family of its own. Fixed values.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "uralic": "fi et hu",
    "indic": "hi bn mr ne pa gu ur",
    "turkic": "tr az kk uz ky tk",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Trigrams that are looked at at once, which bounds what a long text takes beside itself.
_AT_ONCE = 1 << 20
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[*range(0x09, 0x0E)]] = 0x20
_FOLD[[*range(0x21, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20  # signs and digits as white space


def family(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def slots(data: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature slot of each trigram and where each text's trigrams begin."""
    ends = np.zeros(len(data) + 2, bool)
    stop = text_at[1:][np.diff(text_at) > 0]
    ends[stop - 1] = True  # a trigram that begins at a text's last or last but one byte leaves it
    ends[np.maximum(stop - 2, 0)] = True
    out, at = [np.zeros(0, np.int16)], [np.zeros(0, np.int64)]
    for first in range(0, max(0, len(data) - 2), _AT_ONCE):
        c = _FOLD[data[first : first + _AT_ONCE + 2]]
        keep = ((c[1:-1] != 0x20) | (c[:-2] != 0x20)) & ~ends[first : first + len(c) - 2]
        where = np.flatnonzero(keep)
        key = (c[where] | c[where + 1] << np.uint32(8) | c[where + 2] << np.uint32(16)).astype(np.uint64)
        out.append((mix(key) & np.uint64(DIMENSIONS - 1)).astype(np.int16))
        at.append(where + first)
    return np.concatenate(out), np.searchsorted(np.concatenate(at), text_at)


def shares(col: pa.Array) -> np.ndarray:
    """A row of feature shares for each text."""
    slot, begin = slots(*raw(col))
    out = np.zeros((len(col), DIMENSIONS), np.float32)
    for i in range(len(col)):
        part = slot[begin[i] : begin[i + 1]]
        if len(part):
            out[i] = np.bincount(part, minlength=DIMENSIONS) / len(part)
    return out


def machines(x: np.ndarray, y: np.ndarray, classes: list[str], rounds: int = 300, c: float = 20.0) -> np.ndarray:
    """One-versus-rest linear machines with squared hinge loss, by accelerated gradient steps; the last column is the bias."""
    out = np.zeros((len(classes), x.shape[1] + 1), np.float32)
    z = np.column_stack([x, np.ones(len(x), np.float32)])
    for k, name in enumerate(classes):
        t = np.where(y == name, 1.0, -1.0).astype(np.float32)
        weight = np.where(t > 0, 0.5 / max(1, (t > 0).sum()), 0.5 / max(1, (t < 0).sum())).astype(np.float32)
        w, v = np.zeros(z.shape[1], np.float32), np.zeros(z.shape[1], np.float32)
        step = 1.0 / (1.0 / c + 2 * float((weight * (z * z).sum(1)).sum()))
        for i in range(rounds):
            loss = np.maximum(0, 1 - t * (z @ v))
            new = v - step * (v / c - 2 * z.T @ (weight * t * loss))
            v = new + (i / (i + 3)) * (new - w)
            w = new
        out[k] = w
    return out


def pairwise(x: np.ndarray, y: np.ndarray, classes: list[str]) -> np.ndarray:
    """A machine for each pair of classes, in the order of ``itertools.combinations``; above 0 for the first of the two."""
    out = []
    for a, b in combinations(classes, 2):
        own = (y == a) | (y == b)
        out.append(machines(x[own], y[own], [a])[0])
    return np.stack(out)


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.scale = np.float32(1.0)
        groups = np.array([family(v) for v in y])
        self.families = sorted(set(groups))
        self.scale = np.float32(1 / max(1e-6, float(np.sqrt((x * x).sum(1)).mean()))) if len(x) else self.scale
        x = x * self.scale
        self.top = machines(x, groups, self.families) if len(self.families) > 1 else None
        self.within = {}
        for f in self.families:
            langs = sorted(set(y[groups == f]))
            self.within[f] = (langs, pairwise(x[groups == f], y[groups == f], langs) if len(langs) > 1 else None)
        rows = [m for m in [self.top, *(m for _, m in self.within.values())] if m is not None]
        self.table = np.vstack(rows) if rows else np.zeros((0, DIMENSIONS + 1), np.float32)

    def margins(self, data: np.ndarray, text_at: np.ndarray) -> np.ndarray:
        """Of every machine for every text: means of weights over its trigrams."""
        slot, begin = slots(data, text_at)
        n, size = len(text_at) - 1, np.maximum(np.diff(begin), 1)
        out = np.empty((n, len(self.table)))
        if len(slot) > 4 * _AT_ONCE:  # a long text: counts of its slots
            for i in range(n):
                out[i] = self.scale / size[i] * (self.table[:, :-1] @ np.bincount(slot[begin[i] : begin[i + 1]], minlength=DIMENSIONS)) + self.table[:, -1]
            return out
        total = np.zeros(len(slot) + 1)
        for j, w in enumerate(self.table):
            np.cumsum(w[:-1][slot], dtype=np.float64, out=total[1:])
            out[:, j] = self.scale * (total[begin[1:]] - total[begin[:-1]]) / size + w[-1]
        return out

    @staticmethod
    def choose(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best class of each row, and a logistic of its lead."""
        best = m.argmax(1)
        ordered = np.sort(m, axis=1)
        return best, 1 / (1 + np.exp(-4 * (ordered[:, -1] - ordered[:, -2])))

    @staticmethod
    def vote(m: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The class of each row by the votes of the machines of all pairs of n classes, and a logistic of its lead."""
        votes, margin = np.zeros((len(m), n)), np.zeros((len(m), n))
        between = np.zeros((len(m), n, n))
        for k, (i, j) in enumerate(combinations(range(n), 2)):
            votes[:, i] += m[:, k] > 0
            votes[:, j] += m[:, k] <= 0
            margin[:, i] += m[:, k]
            margin[:, j] -= m[:, k]
            between[:, i, j], between[:, j, i] = m[:, k], -m[:, k]
        order = np.lexsort((margin, votes), axis=1)
        best, second = order[:, -1], order[:, -2]
        return best, 1 / (1 + np.exp(-8 * between[np.arange(len(m)), best, second]))

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(col)
        if not self.families:
            return [UNKNOWN] * n, np.zeros(n)
        m = self.margins(*raw(col))
        at = 0
        if self.top is None:
            chosen, score = np.zeros(n, np.int64), np.ones(n)
        else:
            at = len(self.families)
            chosen, score = self.choose(m[:, :at])
        names = np.empty(n, object)
        for k, f in enumerate(self.families):
            langs, machine = self.within[f]
            mine = chosen == k
            if machine is None:
                names[mine] = langs[0]
            else:
                best, lead = self.vote(m[mine, at : at + len(machine)], len(langs))
                names[mine] = np.array(langs, object)[best]
                score[mine] *= lead
                at += len(machine)
        data, text_at = raw(col)
        plain = np.searchsorted(np.flatnonzero(_ASCII_LETTER[data]), text_at)
        for i in np.flatnonzero(plain[1:] == plain[:-1]):  # no ASCII letter
            if not any(map(str.isalpha, col[int(i)].as_py() or "")):
                names[i], score[i] = UNKNOWN, 0.0
        return names.tolist(), score


def fit(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> Model:
    """docs: doc_id, text, lang. Only a bounded number of feature vectors comes to the driver."""
    known = docs.select("doc_id", "text", "lang").where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # as many rows as languages
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1 << 20)) < share * (1 << 20)

    def run(batches):
        for b in blocks(batches):
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([r.tobytes() for r in shares(b.column("text"))], pa.binary())], names=["lang", "x"])

    rows = known.where(draw & F.col("text").isNotNull()).select("lang", "text").mapInArrow(run, "lang string, x binary").limit(2 * per_language * max(1, len(counts))).toArrow()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, DIMENSIONS)
    y = np.array(rows["lang"].to_pylist(), object)
    order = np.lexsort([x @ np.arange(DIMENSIONS, dtype=np.float32), y.astype(str)]) if len(y) else []
    return Model(x[order], y[order])


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score."""
    from pyspark.sql import types as T

    names = ["_text" if c == "text" else f"_k{i}" for i, c in enumerate(keep)]
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep]).add("lang_pred", "string").add("score", "double")

    def run(batches):
        for b in blocks(batches, "_text"):
            lang, score = model.predict(b.column("_text"))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], *[F.col("text").alias("_text")] * ("text" not in keep)).mapInArrow(run, schema)


def recognised(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs whose text has a language with a score of at least ``least``."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    got = predict(rows, model, tuple(names))
    return got.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
