"""Passages that repeat across documents: paragraph MinHash banding, exact verification, components.

Method: a paragraph is every block of ``BLOCK`` consecutive words, wherever it begins, so passages need
not stand between line breaks. Its MinHash in each of ``bands_for`` bands is the least of its
shingles' hashes; neighbouring paragraphs mostly share it, so a text yields about two places for each
``BLOCK`` words and band. A band's key joins the least shingle with the ``SIDE`` words before it, and another
key with those after it: of an equal block at least one side lies inside, and common short lines, which
many texts share, do not collide. Two texts with an equal block collide in every band; at a similarity s a
block is missed with a probability of about (1 - s) ** bands, and a longer passage has many blocks.
``bands_for`` tunes the number for a wanted recall.

Places whose key a second document has are looked at closely. First, every block whose least shingles are such places, in
every band and with each side that lies inside, is named by 96 bits of its words, and a block that a document with a smaller doc_id holds too is a repeat: no equal block is lost, whichever
document a bucket has first. Second, a place that lies in no equal block is compared with every place that an earlier document has in
its bucket, each text once however many documents have it: the words around both places are lined up, the match is extended on both
sides over unequal shingles and over up to ``SHIFT`` words put in or taken out, and the exact Jaccard similarity of its word shingles is
computed. A match counts if it has at least ``BLOCK`` words itself and the wanted similarity; if the longest extension lacks it, the longest part around
the places that has it counts. Places with equal words around are compared as one. Buckets are compared tile by tile, open places with frames,
so a crowded one is spread over tasks and bounded in memory; an index of
the rarer shingles leaves out pairs that share fewer different ones than a match does.

Blocks and matches, each verified against one document, are what goes from the later document (by doc_id); each passage
keeps its first copy. What overlaps or touches makes one run. Removals are clustered by the components of all documents
that a match was verified between.

Defined cases: null and empty texts and texts of fewer words hold no passage; rows with a null doc_id are
left alone; rows that share a doc_id are not compared with each other; passages repeated only within a
document stay; an empty table gives no rows. ``cleaned`` and ``without_repeats`` give all columns back, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, blocks, by_key, join_split
from .components import components
from .textkit import code_points, grams, mix, raw, words

U64 = np.uint64
BLOCK, SHINGLE, SIMILARITY = 50, 5, 0.8
RECALL = 0.95
#: Words on one side of the least shingle that a key takes in; half of what a block has beside the shingle is more.
SIDE = 10
#: Words to each side of a matched place that are compared.
REACH = 48
#: Unequal shingles in a row that a match may bridge.
BRIDGE = 10
#: Words that one of two lined-up texts may have more than the other by the end of a match.
SHIFT = 6
#: Places of a bucket that are compared with each other at once.
TILE = 8192
#: Texts of a task whose places are collected by hash, not by sorting; a text has some dozens.
TEXTS = 1 << 15
#: Pairs of places that are lined up at once.
_PAIRS = 2048


def bands_for(recall: float = RECALL, similarity: float = SIMILARITY) -> int:
    """The fewest bands of one row that find a pair of blocks of this similarity with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity)))


def least(v: np.ndarray, same: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of ``width`` within one text (``same``: its number) by their first position, and the position of each one's least value."""
    n = len(v)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = (v >> U64(32) << U64(32)) | np.arange(n, dtype=U64)
    rows = -(-n // width)
    grid = np.full(rows * width, ~U64(0))
    grid[:n] = key
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    at = np.flatnonzero(same[width - 1 :] == same[: n - width + 1])
    return at, (np.minimum(behind[at], ahead[at + width - 1]) & U64(0xFFFFFFFF)).astype(np.int64)


def minima(v: np.ndarray, same: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the least value of some window of ``width`` within one text."""
    at = least(v, same, width)[1]  # ascending, as a window's least value never lies before that of the window before
    return at[np.append(True, at[1:] != at[:-1])[: len(at)]]


def ranks(shingle: np.ndarray, band: int) -> np.ndarray:
    """A band's hash of each shingle."""
    return mix(shingle + mix(np.array([band + 1], U64)))


def digests(w) -> np.ndarray:
    """A name of the word sequence of each text of a block."""
    size = np.diff(w.word_at)
    place = np.arange(len(w.hash)) - np.repeat(w.word_at[:-1], size)
    total = np.append(U64(0), np.cumsum(mix(w.hash ^ mix(np.arange(size.max(initial=0), dtype=U64))[place]), dtype=U64))
    return (mix(total[w.word_at[1:]] - total[w.word_at[:-1]] + size.astype(U64)) >> U64(1)).astype(np.int64)


def spread(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each of the places ``at`` on, whatever texts they belong to."""
    out = np.full(len(at), n, U64)
    for k in range(n):
        out = mix(out * U64(0xD6E8FEB86659FD93) + h[at + k])
    return out


def rolling(h: np.ndarray, n: int, which: int) -> np.ndarray:
    """A hash of the n words from each word on, by differences of running sums, whatever texts they belong to."""
    m = max(0, len(h) - n + 1)
    base = 0x9E3779B97F4A7C15 * (2 * which + 1) & 0xFFFFFFFFFFFFFFFF | 5  # odd, so it has an inverse
    up, down = (np.multiply.accumulate(np.r_[U64(1), np.full(len(h), x, U64)]) for x in (base, pow(base, -1, 1 << 64)))
    total = np.append(U64(0), np.cumsum(h * up[:-1], dtype=U64))
    return mix((total[n:][:m] - total[:m]) * down[:m] + U64(n))


def anchors(docs: DataFrame, bands: int, block: int, n: int) -> DataFrame:
    """Rows (key, doc_id, digest, place): the keys of the paragraphs' MinHash, each place of a text. place: the position of the
    shingle, times 256, and the number of the band and side."""
    schema = "key bigint, doc_id bigint, digest bigint, place bigint"

    def run(batches):
        for b in blocks(batches):
            w = words(b.column("text"))
            shingle, at = grams(w, n)
            text = np.searchsorted(w.word_at, at, "right") - 1
            digest = digests(w)
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            out = [[np.zeros(0, np.int64)] for _ in range(4)]
            begin, end = w.word_at[text], w.word_at[text + 1]
            for band in range(bands):
                v = ranks(shingle, band)
                pick = minima(v, text, block - n + 1)
                for which, (start, ok) in enumerate(((at[pick] - SIDE, at[pick] - SIDE >= begin[pick]), (at[pick] + n, at[pick] + n + SIDE <= end[pick]))):
                    own = pick[ok]
                    key, of = mix(v[own] + spread(w.hash, start[ok], SIDE) + U64(which)).astype(np.int64), text[own]
                    out[0].append(key)
                    out[1].append(ids[of])
                    out[2].append(digest[of])
                    out[3].append((at[own] - w.word_at[of]) * 256 + 2 * band + which)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["key", "doc_id", "digest", "place"])

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, schema)


def windows(docs: DataFrame, places: DataFrame, bands: int, block: int, n: int) -> DataFrame:
    """Rows (h, g, doc_id, digest, pos): names of the blocks of words around places (doc_id, digest, places).

    A block is named by its first word if it may stand in another text: in every band the key of its least shingle with each
    side that lies inside must be one of the places. Each block is named once, however many places it has.
    """

    def run(batches):
        for b in blocks(batches):
            w = words(b.column("text"))
            sizes = pc.list_value_length(b.column("places")).to_numpy()
            text = np.repeat(np.arange(len(b)), sizes)
            digest, ids = (b.column(c).to_numpy() for c in ("digest", "doc_id"))
            mine = digests(w) == digest
            place = b.column("places").flatten().to_numpy()[mine[text]]
            at = w.word_at[text[mine[text]]] + place // 256
            shared = np.zeros(len(w.hash) + 1, np.uint64)
            np.bitwise_or.at(shared, at, U64(1) << (place % 256).astype(U64))
            shingle, word = grams(w, n)
            of = np.searchsorted(w.word_at, word, "right") - 1
            ok = None
            for band in range(bands):
                first, pick = least(ranks(shingle, band), of, block - n + 1)
                into = word[pick] - word[first]
                before, after = (shared[word[pick]] >> U64(2 * band + k) & U64(1) > 0 for k in (0, 1))
                good = (before | (into < SIDE)) & (after | (into + n + SIDE > block))
                ok = good if ok is None else ok & good
            pos = word[first[ok]]
            name, more = rolling(w.hash, block, 1)[pos], rolling(mix(w.hash + U64(1)), block, 3)[pos]
            of = np.searchsorted(w.word_at, pos, "right") - 1
            cols = [pa.array(name.view(np.int64)), pa.array((more >> U64(32)).astype(np.uint32).view(np.int32)), pa.array(ids[of].astype(np.int64)), pa.array(digest[of].astype(np.int64)), pa.array((pos - w.word_at[of]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "g", "doc_id", "digest", "pos"])

    return docs.select("doc_id", "text").join(places, "doc_id").mapInArrow(run, "h bigint, g int, doc_id bigint, digest bigint, pos int")


def contexts(docs: DataFrame, places: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, digest, pos, frame, words): 64-bit hashes of the words around each place (doc_id, digest, pos), and a 128-bit name of
    them. Rows of a text that several tasks meet are given again.
    """
    wanted = places.groupBy("doc_id", "digest").agg(F.collect_set("pos").alias("places"))
    size = 2 * REACH + n
    salts = [mix(np.arange(size, dtype=U64) + U64(k << 32)) for k in (1, 2)]

    def run(batches):
        met: set[tuple[int, int]] = set()
        for b in blocks(batches):
            w = words(b.column("text"))
            places = b.column("places")
            digest, ids = (b.column(c).to_pylist() for c in ("digest", "doc_id"))
            own = digests(w).tolist()
            for i in range(len(b)):
                if (ids[i], digest[i]) in met or own[i] != digest[i]:
                    continue
                if len(met) > 100_000:  # bounds the memory; rows given again are merged later
                    met.clear()
                met.add((ids[i], digest[i]))
                # what lies outside the text differs from everything
                edge = np.random.default_rng([digest[i], ids[i] & ((1 << 63) - 1)]).integers(0, 1 << 64, 2 * REACH, U64)
                h = np.concatenate([edge[:REACH], w.hash[w.word_at[i] : w.word_at[i + 1]], edge[REACH:]])
                wanted = places[i].values.to_numpy()
                for at in range(0, len(wanted), 1024):
                    pos = wanted[at : at + 1024]
                    around = h[pos[:, None] + np.arange(size)]
                    name = np.stack([mix(mix(around ^ salt).sum(axis=1, dtype=U64)) for salt in salts], axis=1)
                    cols = [pa.repeat(pa.scalar(ids[i], pa.int64()), len(pos)), pa.repeat(pa.scalar(digest[i], pa.int64()), len(pos)), pa.array(pos, pa.int32()), _binary(name), _binary(around)]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "digest", "pos", "frame", "words"])

    return docs.select("doc_id", "text").join(wanted, "doc_id").mapInArrow(run, "doc_id bigint, digest bigint, pos int, frame binary, words binary")


def _binary(rows: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    at = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(rows))])


def _rows_of_shingles(h: np.ndarray, n: int) -> np.ndarray:
    m = h.shape[1] - n + 1
    out = np.full((len(h), m), n, U64)
    for k in range(n):
        out = mix(out * U64(0xD6E8FEB86659FD93) + h[:, k : k + m])
    return out


def _different(rows: np.ndarray) -> np.ndarray:
    """How many different values each row has; the largest value stands for none."""
    rows = np.sort(rows, axis=1)
    return 1 + (rows[:, 1:] != rows[:, :-1]).sum(axis=1) - (rows[:, -1] == ~U64(0))


def matches(a: np.ndarray, b: np.ndarray, n: int, similarity: float, block: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """First and last matched word (exclusive) in a of lined-up word rows; 0, 0 where they are not similar. Matches of fewer words
    than ``block`` are not measured."""
    return _lined_up(_rows_of_shingles(a, n), _rows_of_shingles(b, n), n, similarity, block)


def _before(row: np.ndarray) -> np.ndarray:
    """Where each value of a row stands last before; -1: nowhere."""
    order = np.argsort(row, kind="stable")
    again = np.flatnonzero(row[order[1:]] == row[order[:-1]])
    out = np.full(len(row), -1)
    out[order[again + 1]] = order[again]
    return out


def _counts(p: np.ndarray, q: np.ndarray, s: np.ndarray, e: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many different values both have, and either, of p's spans (s, e) and q's (low, high)."""
    place = np.arange(p.shape[1])
    x = np.where((place >= s[:, None]) & (place < e[:, None]), p, ~U64(0))
    y = np.where((place >= low[:, None]) & (place < high[:, None]), q, ~U64(0))
    if not len(p):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    either = _different(np.concatenate([x, y], axis=1))
    return _different(x) + _different(y) - either, either


def _longest(p: np.ndarray, q: np.ndarray, hit: np.ndarray, turn: np.ndarray, left: np.ndarray, right: np.ndarray, n: int, similarity: float, block: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last matched shingle (exclusive) of the longest part of (left, right) around the middle that is similar, at least the equal
    stretch around it; (left, right) itself is known not to be."""
    count, m = p.shape
    mid, place, own = REACH, np.arange(m), p == q
    goes_on = hit[:, 1:] & hit[:, :-1] & (turn[:, 1:] == turn[:, :-1])
    edge = np.zeros((count, 1), bool)
    begin = hit & (place >= left[:, None]) & (place <= mid) & ((place == left[:, None]) | ~np.concatenate([edge, goes_on], axis=1))
    stop = hit & (place >= mid) & (place < right[:, None]) & ~np.concatenate([goes_on, edge], axis=1)
    best = np.where(~own & (place < mid), place, -1).max(1) + 1, np.where(~own & (place > mid), place, m).min(1)
    (row, s), (of, e) = np.nonzero(begin), np.nonzero(stop)
    n_stops = np.bincount(of, minlength=count)
    times = n_stops[row]
    at = np.repeat((np.cumsum(n_stops) - n_stops)[row] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    row, s, e = np.repeat(row, times), np.repeat(s, times), e[at] + 1
    long = (e - s + n - 1 >= np.maximum(block, best[1] - best[0] + n)[row]) & ((s > left[row]) | (e < right[row]))
    row, s, e = row[long], s[long], e[long]
    order = np.lexsort((s - e, row))
    row, s, e = row[order], s[order], e[order]
    for k in range(0, len(row), _PAIRS):
        r, u, v = (c[k : k + _PAIRS] for c in (row, s, e))
        both, either = _counts(p[r], q[r], u, v, u + turn[r, u], v + turn[r, v - 1])
        ok = np.flatnonzero(both >= similarity * either)
        r, first = np.unique(r[ok], return_index=True)  # the longest
        first, fresh = ok[first], best[1][r] - best[0][r] < (v - u)[ok[first]]
        best[0][r[fresh]], best[1][r[fresh]] = u[first[fresh]], v[first[fresh]]
    return best


def _lined_up(p: np.ndarray, q: np.ndarray, n: int, similarity: float, block: int) -> tuple[np.ndarray, np.ndarray]:
    """``matches`` of rows of shingles."""
    count, m = p.shape
    mid = REACH
    rows = np.arange(count)
    hit, turn = p == q, np.zeros((count, m), np.int8)
    own = hit.copy()
    x, y = p.astype(np.uint16), q.astype(np.uint16)  # few of the unequal are equal in these bits, so only few are compared as a whole
    for d in sorted((k for k in range(-SHIFT, SHIFT + 1) if k), key=abs):  # the least shift first
        into = slice(max(0, -d), m - max(0, d))
        row, at = np.nonzero((x[:, into] == y[:, into.start + d : into.stop + d]) & ~hit[:, into])
        at += into.start
        more = p[row, at] == q[row, at + d]
        row, at = row[more], at[more]
        hit[row, at], turn[row, at] = True, d
    across = np.ascontiguousarray(hit.T)
    ends = []
    for steps in (range(mid - 1, -1, -1), range(mid + 1, m)):
        reach, gap, alive = np.full(count, mid), np.zeros(count, np.int8), own[:, mid].copy()
        for i in steps:
            gap += 1
            gap[across[i]] = 0
            alive &= gap <= BRIDGE
            reach[alive & across[i]] = i
        ends.append(reach)
    left, right = ends[0], ends[1] + 1
    total = np.zeros((count, m + 1), np.int16)
    np.cumsum(own, axis=1, out=total[:, 1:])
    matched = total[rows, right] - total[rows, left]
    left[~own[:, mid]] = right[~own[:, mid]] = 0
    todo = np.flatnonzero((matched < right - left) & own[:, mid] & (right - left + n - 1 >= block))
    both, either = _counts(p[todo], q[todo], left[todo], right[todo], left[todo] + turn[todo, left[todo]], right[todo] + turn[todo, right[todo] - 1])
    less = todo[both < similarity * either]
    if len(less):
        left[less], right[less] = _longest(p[less], q[less], hit[less], turn[less], left[less], right[less], n, similarity, block)
    return left, np.where(right > left, right + n - 1, 0)


def _spanning(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the links (x, y) make a forest that reaches what all do."""
    root: dict[int, int] = {}

    def top(k: int) -> int:
        while root.setdefault(k, k) != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    keep = np.zeros(len(x), bool)
    for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        a, b = top(a), top(b)
        if a != b:
            root[a], keep[i] = b, True
    return keep


def _fewest(shingles: np.ndarray, block: int, n: int, similarity: float) -> int:
    """How many of a row's different shingles any match around its middle shares: the wanted share of those that a block has."""
    width = block - n + 1
    least_of = width
    at = _before(shingles)
    if (at >= 0).any():
        first = np.arange(max(0, REACH - width + 1), min(REACH, len(shingles) - width) + 1)
        least_of = int((at[first[:, None] + np.arange(width)] < first[:, None]).sum(1).min())
    return math.ceil(similarity * least_of - 1e-9)


def _hub(x_last: np.ndarray, y_doc: np.ndarray, x_shingles: np.ndarray, y_shingles: np.ndarray, fewest):
    """Pairs (x, y) of two tiles of a bucket by row number, some thousands at a time: those whose ``y_doc`` is below ``x_last``.

    Pairs that share fewer different shingles than a match does are left out. Of the wanted number at least one is among x's shingles
    without as many less one of its most common ones, so an index of y's shingles is asked for the rare ones only.
    """
    none = ~U64(0)
    rows = np.sort(y_shingles, axis=1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = none
    flat, of = rows.ravel(), np.repeat(np.arange(len(rows), dtype=np.int32), rows.shape[1])
    by = np.flatnonzero(flat != none)
    by = by[np.argsort(flat[by], kind="stable")]
    flat, of = flat[by], of[by]
    xs, ys, held = [], [], 0
    for x in range(len(x_shingles)):
        own = np.unique(x_shingles[x])
        wanted = fewest(x_shingles[x])
        low, high = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        rare = np.argsort(high - low, kind="stable")[: max(1, len(own) - wanted + 1)]
        start, n = low[rare], (high - low)[rare]
        at = np.repeat(start - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        y = np.unique(of[at])
        y = y[y_doc[y] < x_last[x]]
        if wanted > 1:
            for k in range(0, len(y), _PAIRS):
                part = y[k : k + _PAIRS]
                place = np.minimum(np.searchsorted(own, rows[part]), len(own) - 1)
                y[k : k + _PAIRS] = np.where((own[place] == rows[part]).sum(axis=1) >= wanted, part, -1)
            y = y[y >= 0]
        for at in range(0, len(y), _PAIRS):
            part = y[at : at + _PAIRS]
            xs.append(np.full(len(part), x))
            ys.append(part)
            held += len(part)
            if held >= _PAIRS:
                yield np.concatenate(xs), np.concatenate(ys)
                xs, ys, held = [], [], 0
    if held:
        yield np.concatenate(xs), np.concatenate(ys)


_MATCH = "doc_id bigint, digest bigint, kept bigint, first bigint, last bigint"


def compared(members: DataFrame, around: DataFrame, scratch: Scratch, block: int, n: int, similarity: float) -> DataFrame:
    """Rows (doc_id, digest, kept, first, last): matches of the open places of each bucket with all earlier ones.

    members: key, doc_id, digest, pos, open; around: doc_id, digest, pos, frame, words. Places with equal words around are one, of the smallest
    doc_id: they lie in equal blocks, which links their documents. Of the matches of a large bucket, for each
    stretch of a text the one with the smallest kept and those links that hold a component together are given: the others change neither runs nor components.
    """
    named = around.select("doc_id", "digest", "pos", "frame").distinct()
    placed = scratch.save(members.join(named, ["doc_id", "digest", "pos"]))
    high = F.max(F.when(F.col("open") > 0, F.col("doc_id")))
    frames = placed.groupBy("key", "frame").agg(F.min("doc_id").alias("least"), high.alias("high"), F.sum("open").alias("open"))
    frames = scratch.save(frames)
    tiles = [F.greatest(F.ceil(c / TILE), F.lit(1)).cast("int") for c in (F.sum("open"), F.count("*"))]
    sizes = frames.groupBy("key").agg(F.count("*").alias("n"), F.min("least").alias("low"), F.max("high").alias("high"), tiles[0].alias("x"), tiles[1].alias("y"))
    sizes = scratch.save(sizes.where("low < high"))
    none = [F.lit(None).cast("bigint").alias("digest"), F.lit(None).cast("int").alias("pos")]
    earlier = frames.select("key", "frame", F.col("least").alias("doc_id"), *none, F.lit(0).alias("open"))
    later = placed.where("open > 0").select("key", "frame", "doc_id", "digest", "pos", "open")
    both = join_split(earlier.union(later), sizes, "key", sizes.select("key", "n"))
    both = both.where("doc_id < high and open = 0 or doc_id > low and open > 0")  # the others have none to be compared with
    # each tile of open places meets each tile of frames; there are few open ones
    own = F.pmod(F.xxhash64("frame"), F.when(F.col("open") > 0, F.col("x")).otherwise(F.col("y"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("open") > 0, F.col("y")).otherwise(F.col("x")) - 1))
    dealt = both.withColumn("own", own).withColumn("other", other)
    ends = [F.when(F.col("open") > 0, F.col(a)).otherwise(F.col(b)) for a, b in (("own", "other"), ("other", "own"))]
    columns = ["key", "i", "j", "doc_id", "digest", "pos", "open", "words"]
    rows = dealt.withColumns({"i": ends[0], "j": ends[1]}).join(around.select("frame", "words").dropDuplicates(["frame"]), "frame")
    rows = rows.select(*columns).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        names = ["doc_id", "digest", "kept", "first", "last"]

        def measured(c, h, x, y):
            left, right = _lined_up(h[x], h[y], n, similarity, block)
            ok = right - left >= block
            x, y, left, right = x[ok], y[ok], left[ok], right[ok]
            return np.stack([c["doc_id"][x], c["digest"][x], c["doc_id"][y], c["pos"][x] - REACH + left, c["pos"][x] - REACH + right], axis=1)

        def fewer(found):
            order = np.lexsort((found[:, 2], found[:, 4], found[:, 3], found[:, 1], found[:, 0]))
            found = found[order]
            fresh = np.ones(len(found), bool)
            fresh[1:] = (found[1:, [0, 1, 3, 4]] != found[:-1, [0, 1, 3, 4]]).any(axis=1)
            return found[fresh | _spanning(found[:, 0], found[:, 2])]

        def crowd(c, h):
            """Matches of one large group; open places whose words around are all equal are compared once."""
            opened, y = np.flatnonzero(c["open"] > 0), np.flatnonzero(c["open"] == 0)
            if not len(opened) or not len(y):
                return np.zeros((0, 5), np.int64)
            _, rep, of = np.unique(h[opened].view(f"V{h.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
            by = np.argsort(of, kind="stable")
            opened, of, rep = opened[by], of[by], opened[rep]
            last = np.full(len(rep), np.iinfo(np.int64).min)
            np.maximum.at(last, of, c["doc_id"][opened])
            asked, frames = _rows_of_shingles(h[rep], n), _rows_of_shingles(h[y], n)
            found = np.zeros((0, 5), np.int64)
            for a, b in _hub(last, c["doc_id"][y], asked, frames, lambda row: _fewest(row, block, n, similarity)):
                left, right = _lined_up(asked[a], frames[b], n, similarity, block)
                ok = right - left >= block
                a, kept, left, right = a[ok], c["doc_id"][y[b[ok]]], left[ok], right[ok]
                low, high = np.searchsorted(of, a, "left"), np.searchsorted(of, a, "right")
                pair = np.repeat(np.arange(len(a)), high - low)  # each open place with the words of a
                row = opened[np.repeat(low - np.append(0, np.cumsum(high - low)[:-1]), high - low) + np.arange(len(pair))] if len(pair) else np.zeros(0, np.int64)
                later = kept[pair] < c["doc_id"][row]
                pair, row = pair[later], row[later]
                pos = c["pos"][row] - REACH
                found = np.concatenate([found, np.stack([c["doc_id"][row], c["digest"][row], kept[pair], pos + left[pair], pos + right[pair]], axis=1)])
                if len(found) > 1 << 16:
                    found = fewer(found)
            return fewer(found) if len(found) else found

        def work(b):
            """Whole groups of rows."""
            c = {k: pc.fill_null(b.column(k), 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in columns[:-1]}
            h = np.frombuffer(b"".join(b.column("words").to_pylist()), U64).reshape(len(b), -1)
            change = np.flatnonzero((np.diff(c["key"]) != 0) | (np.diff(c["i"]) != 0) | (np.diff(c["j"]) != 0)) + 1
            xs, ys, held, out = [], [], 0, []
            grams_of = None
            for first, last in zip([0, *change.tolist()], [*change.tolist(), len(b)], strict=True):
                if last - first > 32:
                    out.append(crowd({k: v[first:last] for k, v in c.items()}, h[first:last]))
                    continue
                if grams_of is None:
                    grams_of = _rows_of_shingles(h, n)
                open_, doc = c["open"][first:last] > 0, c["doc_id"][first:last]
                x, y = np.nonzero(open_[:, None] & ~open_[None, :] & (doc[None, :] < doc[:, None]))
                xs.append(x + first)
                ys.append(y + first)
                held += len(x)
                if held >= _PAIRS:
                    out.append(measured(c, grams_of, np.concatenate(xs), np.concatenate(ys)))
                    xs, ys, held = [], [], 0
            if held:
                out.append(measured(c, grams_of, np.concatenate(xs), np.concatenate(ys)))
            found = np.concatenate(out) if out else np.zeros((0, 5), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(5)], names=names)

        waiting: list = []  # rows of the group that the next batch may go on with
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([*waiting, batch])
            group = [table.column(k).combine_chunks().to_numpy() for k in ("key", "i", "j")]
            begin = int(np.flatnonzero(np.logical_or.reduce([g != g[-1] for g in group])).max(initial=-1)) + 1
            for b in table.slice(0, begin).combine_chunks().to_batches():
                yield work(b)
            waiting = table.slice(begin).combine_chunks().to_batches()
        for b in waiting:
            yield work(b)

    return rows.mapInArrow(run, _MATCH)


def _later(rows: DataFrame, key: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """rows of keys that a document with a smaller doc_id has too, with that as ``kept``; and the keys' sizes."""
    stats = scratch.save(rows.groupBy(*key).agg(F.min("doc_id").alias("kept"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("kept < high").drop("high"))
    return join_split(rows, stats.drop("n"), key, stats.select(*key, "n"), hashed=True), stats.select(*key, "n")


def repeats(docs: DataFrame, scratch: Scratch, block: int = BLOCK, n: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Rows (doc_id, digest, kept, first, last): what each text repeats of one earlier document, in words; last is exclusive."""
    if block - n > REACH:
        raise ValueError("a block must lie within REACH words of its shingle")
    bands = bands_for(recall, similarity)
    found = scratch.save(anchors(docs, bands, block, n))
    met, sizes = _later(found, ["key"], scratch)
    met = scratch.save(met)
    scratch.drop(found)
    places = met.groupBy("doc_id", "digest").agg(F.collect_set("place").alias("places"))
    named = scratch.save(windows(docs, places, bands, block, n))
    again, _ = _later(named, ["h", "g"], scratch)
    # neighbouring blocks of one kept document make one stretch (first and last block)
    at = F.array_sort(F.collect_set("pos"))
    begins = F.filter("at", lambda a, i: (i == 0) | (F.try_element_at(F.col("at"), i) < a - 1))
    ends = F.filter("at", lambda a, i: F.coalesce(F.try_element_at(F.col("at"), i + 2) > a + 1, F.lit(True)))
    whole = again.where("doc_id > kept").groupBy("doc_id", "digest", "kept").agg(at.alias("at"))
    whole = scratch.save(whole.select("doc_id", "digest", "kept", F.arrays_zip(begins.alias("first"), ends.alias("last")).alias("stretches")))
    scratch.drop(named)
    # near copies: places that no equal block holds against all earlier ones of their buckets
    equal = whole.groupBy("doc_id", "digest").agg(F.flatten(F.collect_list("stretches")).alias("stretches"))
    placed = met.withColumn("pos", F.expr("cast(place div 256 as int)")).drop("place")
    covered = F.exists("stretches", lambda s: (s["first"] <= F.col("pos")) & (s["last"] >= F.col("pos") - (block - n)))
    later = placed.where("doc_id > kept").join(equal, ["doc_id", "digest"], "left")
    opened = scratch.save(later.where(~F.coalesce(covered, F.lit(False))).select("key", "doc_id", "digest", "pos"))
    other = join_split(placed.drop("kept"), opened.select("key").distinct(), "key", sizes, hashed=True)
    flagged = other.withColumn("open", F.lit(0)).unionByName(opened.withColumn("open", F.lit(1)))
    # each text once: a later document with an equal text has its places in equal blocks
    members = scratch.save(flagged.groupBy("key", "digest", "pos").agg(F.min("doc_id").alias("doc_id"), F.max("open").alias("open")))
    scratch.drop(met)
    scratch.drop(opened)
    around = scratch.save(contexts(docs, members.select("doc_id", "digest", "pos").distinct(), n))
    near = scratch.save(compared(members, around, scratch, block, n, similarity))
    scratch.drop(members)
    scratch.drop(around)
    each = whole.select("doc_id", "digest", "kept", F.explode("stretches").alias("p"))
    pieces = each.select("doc_id", "digest", "kept", F.col("p.first").cast("long").alias("first"), (F.col("p.last") + block).cast("long").alias("last"))
    return scratch.save(pieces.union(near).distinct())


def runs_of(pieces: DataFrame) -> DataFrame:
    """Rows (doc_id, digest, runs): pieces that overlap or touch as one run (first, last, kept), kept being the smallest doc_id."""
    grouped = pieces.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list(F.struct("first", "last", "kept"))).alias("pieces"))
    empty = F.array().cast("array<struct<first:bigint,last:bigint,kept:bigint>>")

    def step(done, p):
        end = F.element_at(done, -1)
        joined = F.struct(end["first"].alias("first"), F.greatest(end["last"], p["last"]).alias("last"), F.least(end["kept"], p["kept"]).alias("kept"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] >= p["first"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(p)))

    return grouped.select("doc_id", "digest", F.aggregate("pieces", empty, step).alias("runs"))


def removals(docs: DataFrame, **options) -> DataFrame:
    """Rows (doc_id, digest, first_word, last_word, n_words, kept_doc_id, component_id), one for each removed run."""
    scratch = Scratch(docs.sparkSession, "substring", TEXTS)
    pieces = repeats(docs, scratch, **options)
    rows = runs_of(pieces).select("doc_id", "digest", F.explode("runs").alias("r"))
    rows = rows.select("doc_id", "digest", F.col("r.first").alias("first_word"), F.col("r.last").alias("last_word"), F.expr("r.last - r.first").alias("n_words"), F.col("r.kept").alias("kept_doc_id"))
    clusters = components(pieces.select(F.col("doc_id").alias("a"), F.col("kept").alias("b")), scratch)
    return rows.join(clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id")), "doc_id")


def _cleaned(docs: DataFrame, options: dict) -> DataFrame:
    """docs by position (_c0, _c1, ...), with the text in ``_text`` cut and the cut spans in ``_cut``."""
    scratch, kept = Scratch(docs.sparkSession, "substring", TEXTS), Scratch(docs.sparkSession, "runs")
    found = runs_of(repeats(docs.select("doc_id", "text"), scratch, **options))
    by_doc = kept.save(found.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("digest", "runs")).alias("_found")))
    scratch.clear()
    span = T.StructType().add("start", "long").add("end", "long")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([T.StructField(f"_c{i}", f.dataType) for i, f in enumerate(others)]).add("_text", "string").add("_cut", T.ArrayType(span))
    rows = docs.select(*[F.col(f.name).alias(f"_c{i}") for i, f in enumerate(others)], F.col("text").alias("_text"))
    key = f"_c{[f.name for f in others].index('doc_id')}"

    def run(batches):
        for b in blocks(batches, "_text"):
            w = words(b.column("_text"))
            data, text_at = raw(b.column("_text"))
            new, cut, names = b.column("_text").to_pylist(), [], digests(w).tolist()
            for i, many in enumerate(b.column("_found").to_pylist()):
                spans = []
                for f in many or []:
                    if f["digest"] == names[i]:
                        own = data[text_at[i] : text_at[i + 1]]
                        base = w.word_at[i]
                        at = [(int(w.start[base + r["first"]] - text_at[i]), int(w.end[base + r["last"] - 1] - text_at[i])) for r in f["runs"]]
                        left, keep = bytes(own), []
                        for (a, z), before in zip(at, [0, *(z for _, z in at)], strict=False):
                            keep.append(left[before:a])
                        keep.append(left[at[-1][1] :])
                        new[i] = b"".join(keep).decode()
                        spans = [{"start": int(s), "end": int(e)} for s, e in code_points(own, np.array(at))]
                cut.append(spans)
            yield pa.RecordBatch.from_arrays([*(b.column(f"_c{i}") for i in range(len(others))), pa.array(new, pa.string()), pa.array(cut, kind)], names=schema.names)

    return by_key(rows, by_doc, key, "_doc").mapInArrow(run, schema)


def _as_before(docs: DataFrame, made: DataFrame) -> list:
    """The columns of docs from what ``_cleaned`` made."""
    others = iter(range(len(docs.columns)))
    return [made["_text"].alias(c) if c == "text" else made[f"_c{next(others)}"].alias(c) for c in docs.columns]


def cleaned(docs: DataFrame, spans: str = "cut", **options) -> DataFrame:
    """docs with the repeated runs cut out of their texts, and the cut spans (start, end in code points) in a column of that
    name, in place of one that docs may have."""
    made = _cleaned(docs, options)
    return made.select(*[c for c, name in zip(_as_before(docs, made), docs.columns, strict=True) if name != spans], made["_cut"].alias(spans))


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with the repeated runs cut out of their texts; a text of nothing else goes."""
    made = _cleaned(docs, options)
    return made.where((F.size("_cut") == 0) | F.coalesce(F.col("_text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))).select(*_as_before(docs, made))
