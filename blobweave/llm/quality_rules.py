"""Quality rules: counts of a text, and lines labelled content or boilerplate by a conditional random field.

Method: each line with a word is described by shares of symbols, capitals, digits, repeated words
and the like. A linear-chain conditional random field with two labels is trained on a bounded
sample of labelled documents: a line of a poor document that a logistic regression finds unlike
the lines of good ones is taken as boilerplate, all others as content. Viterbi decoding marks the
lines of every text; the words' share in content lines decides whether it is kept.

Training takes at most ``PER_CLASS`` documents of each class in expectation, chosen by a hash, and of each at most
``SAMPLE_LINES`` neighbouring lines from one chosen by a hash on, so what comes to the driver has a bound.

Defined cases: a null text counts as empty: no words, base failed, not kept; a text without a line
break is one line; a null label is not learned; without both classes in the sample every line
is content; repeated rows get repeated results; a null doc_id is kept like others and not learned from; an empty table gives no rows;
other columns than doc_id, text and those to keep are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks
from .textkit import _BYTE, Words, code_points, grams, hash_runs, mix, runs, words

PER_CLASS = 1500
SAMPLE_LINES = 256
CONTENT_SHARE = 0.5
#: Symbols that count; fixed values.
SYMBOLS = "#*$%&|<>"
FEATURES = 14
_SYMBOL, _UPPER, _LETTER, _DIGIT, _LINE = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_UPPER[65:91] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT[48:58] = True
_LINE[10] = True


def _sums(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
    np.cumsum(mask, out=total[1:], dtype=total.dtype)
    return (total[end] - total[start]).astype(np.int64)


def _again(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether its text held the same before, and whether it holds it twice or more."""
    later, twice = np.zeros(len(h), bool), np.zeros(len(h), bool)
    if len(h):
        order = np.lexsort((np.arange(len(h)), h, text))
        same = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
        later[order[1:]] = same
        twice[order[1:]] = same
        twice[order[:-1]] |= same
    return later, twice


class Counts:
    """The base counts of a block of texts, and its lines with their features."""

    def __init__(self, col: pa.Array):
        w: Words = words(col, lower=False)
        n = len(col)
        self.n_words = np.diff(w.word_at)
        self.word_chars = np.diff(code_points(w.data, w.text_at)) - self._blank(w)
        self.n_symbols = _sums(_SYMBOL[w.data], w.text_at[:-1], w.text_at[1:])
        text_of = np.repeat(np.arange(n), self.n_words)
        # words in windows of three that the text holds twice or more
        h, at = grams(w, 3)
        _, twice = _again(text_of[at], h)
        inside = np.zeros(len(w.hash) + 3, np.int64)
        for k in range(3):
            inside[at[twice] + k] = 1
        repeated = inside[: len(w.hash)] > 0
        self.n_repeat_words = _sums(repeated, w.word_at[:-1], w.word_at[1:])
        # lines with a word
        start, end = runs(~_LINE[w.data], w.text_at)
        first, last = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
        has = last > first
        start, end, first, last = start[has], end[has], first[has], last[has]
        self.line_text = np.searchsorted(w.text_at, start, "right") - 1
        line_hash = hash_runs(w.data, start, end, _BYTE)
        later, _ = _again(self.line_text, line_hash)
        self.n_dup_lines = np.bincount(self.line_text[later], minlength=n)
        self.of = np.searchsorted(self.line_text, np.arange(n + 1))
        self.line_words = last - first
        self.x = self._features(w, start, end, first, last, later, repeated)

    @staticmethod
    def _blank(w: Words) -> np.ndarray:
        """White space characters of each text; all are single bytes."""
        covered = np.append(0, np.cumsum(w.end - w.start))[w.word_at]
        return np.diff(w.text_at) - np.diff(covered)

    def _features(self, w, start, end, first, last, later, repeated) -> np.ndarray:
        size = np.maximum(end - start, 1)
        n = np.maximum(last - first, 1)
        letters = np.maximum(_sums(_LETTER[w.data], start, end), 1)
        symbols, upper, digits = (_sums(m[w.data], start, end) for m in (_SYMBOL, _UPPER, _DIGIT))
        _, twice = _again(np.repeat(np.arange(len(start)), last - first), w.hash[np.repeat(first, last - first) + _within(last - first)]) if len(start) else (None, np.zeros(0, bool))
        in_line = np.append(0, np.cumsum(last - first))
        again = _sums(twice, in_line[:-1], in_line[1:]) / n
        x = np.empty((len(start), FEATURES))
        x[:, 0] = 1
        x[:, 1] = np.minimum(1, 10 * symbols / size)
        x[:, 2] = symbols > 0
        x[:, 3] = upper / letters
        x[:, 4] = upper > 0.6 * letters
        x[:, 5] = np.minimum(1, 5 * digits / size)
        x[:, 6] = n < 4
        x[:, 7] = n >= 20
        x[:, 8] = again
        x[:, 9] = later
        x[:, 10] = np.isin(w.data[end - 1], [33, 46, 63]) if len(start) else 0
        x[:, 11] = again > 0.7
        x[:, 12] = 1 - np.minimum(1, letters / size)
        x[:, 13] = _sums(repeated, first, last) / n
        return x


def _within(length: np.ndarray) -> np.ndarray:
    return np.arange(length.sum()) - np.repeat(np.append(0, np.cumsum(length))[:-1], length)


class Chain:
    """A linear-chain conditional random field with the labels 0 (content) and 1 (boilerplate)."""

    def __init__(self, w: np.ndarray | None = None, move: np.ndarray | None = None):
        self.w = np.zeros((FEATURES, 2)) if w is None else w
        self.move = np.zeros((2, 2)) if move is None else move

    @staticmethod
    def _steps(of: np.ndarray):
        """For each position in a sequence: the lines there, of all sequences that reach it."""
        n = np.diff(of)
        order = np.argsort(-n, kind="stable")
        begin, n = of[:-1][order], n[order]
        for t in range(int(n[0]) if len(n) else 0):
            yield begin[: np.searchsorted(-n, -t)] + t

    def viterbi(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        e = x @ self.w
        best, back = e.copy(), np.zeros((len(e), 2), np.int64)
        steps = list(self._steps(of))
        for before, now in zip(steps, steps[1:], strict=False):
            way = best[before[: len(now)], :, None] + self.move
            back[now] = way.argmax(1)
            best[now] += way.max(1)
        label = np.zeros(len(e), np.int64)
        ends = of[1:][np.diff(of) > 0] - 1
        label[ends] = best[ends].argmax(1)
        for before, now in zip(steps[-2::-1], steps[:0:-1], strict=False):
            label[before[: len(now)]] = back[now, label[now]]
        return label

    def fit(self, x: np.ndarray, of: np.ndarray, y: np.ndarray, rounds: int = 120, decay: float = 1e-3) -> Chain:
        steps = list(self._steps(of))
        pairs = [(b[: len(n)], n) for b, n in zip(steps, steps[1:], strict=False)]
        hot = np.eye(2)[y]
        seen = np.zeros((2, 2))
        for b, n in pairs:
            np.add.at(seen, (y[b], y[n]), 1)
        state = [np.zeros_like(p) for p in (self.w, self.w, self.move, self.move)]
        for i in range(1, rounds + 1):
            e = x @ self.w
            a, z = e.copy(), np.zeros_like(e)
            for b, n in pairs:
                a[n] += np.logaddexp.reduce(a[b][:, :, None] + self.move, axis=1)
            expect = np.zeros((2, 2))
            for b, n in reversed(pairs):
                after = (e[n] + z[n])[:, None, :] + self.move
                z[b] = np.logaddexp.reduce(after, axis=2)
                both = a[b][:, :, None] + after
                expect += np.exp(both - np.logaddexp.reduce(both.reshape(-1, 4), axis=1)[:, None, None]).sum(0)
            p = a + z
            p = np.exp(p - np.logaddexp.reduce(p, axis=1)[:, None])
            for k, (value, g) in enumerate(((self.w, x.T @ (hot - p) / len(x) - decay * self.w), (self.move, (seen - expect) / len(x) - decay * self.move))):
                m, v = state[2 * k], state[2 * k + 1]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                value += 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        return self


def fit_sample(x: np.ndarray, of: np.ndarray, poor: np.ndarray) -> Chain:
    """poor: 0 or 1 for each text."""
    if not len(x) or poor.min() == poor.max():
        return Chain()
    line_poor = np.repeat(poor, np.diff(of)).astype(float)
    weight = np.where(line_poor == 1, 0.5 / max(1, line_poor.sum()), 0.5 / max(1, (1 - line_poor).sum()))
    w = np.zeros(FEATURES)
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(FEATURES)
        w += np.linalg.solve(h, x.T @ (weight * (line_poor - p)) - 1e-3 * w)
    boilerplate = (line_poor == 1) & (x @ w > 0)
    return Chain().fit(x, of, boilerplate.astype(np.int64))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Chain:
    """docs: doc_id, text; labels: doc_id, quality (0 poor, 1 good)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    share = F.when(F.col("quality") == 0, min(1.0, per_class / max(1, n.get(0, 0)))).otherwise(min(1.0, per_class / max(1, n.get(1, 0))))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality sample")), F.lit(1 << 20)) < share * (1 << 20)
    sample = known.where(draw).limit(4 * per_class)  # the limit proves the bound of what is broadcast

    def run(batches):
        for b in blocks(batches):
            c = Counts(b.column("text"))
            n = np.diff(c.of)
            first = c.of[:-1] + mix(n.astype(np.uint64)).astype(np.int64) % np.maximum(1, n - SAMPLE_LINES + 1)
            last = np.minimum(c.of[1:], first + SAMPLE_LINES)
            yield pa.RecordBatch.from_arrays([b.column("poor"), pa.array([c.x[a:z].astype(np.float32).tobytes() for a, z in zip(first, last, strict=True)], pa.binary())], names=["poor", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", (F.col("quality") == 0).cast("int").alias("poor")).mapInArrow(run, "poor int, x binary").toArrow()
    got = sorted((x, p) for x, p in zip(rows["x"].to_pylist(), rows["poor"].to_pylist(), strict=True) if x)
    if not got:
        return Chain()
    x = np.frombuffer(b"".join(g[0] for g in got), np.float32).reshape(-1, FEATURES).astype(float)
    of = np.append(0, np.cumsum([len(g[0]) // (4 * FEATURES) for g in got]))
    return fit_sample(x, of, np.array([g[1] for g in got]))


def judge(docs: DataFrame, model: Chain, keep: tuple[str, ...] = ("doc_id",), content_share: float = CONTENT_SHARE) -> DataFrame:
    """The kept columns, the base counts, base_failed, kept and share (of words in content lines)."""
    names = [f"_k{i}" for i in range(len(keep))]
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep])
    for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        schema = schema.add(c, "long")
    schema = schema.add("base_failed", "boolean").add("kept", "boolean").add("share", "double")

    def run(batches):
        for b in blocks(batches, "_text"):
            c = Counts(b.column("_text"))
            content = np.where(model.viterbi(c.x, c.of) == 0, c.line_words, 0)
            share = np.bincount(c.line_text, content, minlength=len(b)) / np.maximum(1, c.n_words)
            failed = (c.n_words < 50) | (100 * c.n_repeat_words > 50 * c.n_words)
            numbers = [c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *(pa.array(v, pa.int64()) for v in numbers), pa.array(failed), pa.array(~failed & (share >= content_share)), pa.array(share, pa.float64())], names=schema.names)

    return docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col("text").alias("_text")).mapInArrow(run, schema)
