"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Method: large-item matching. Pieces above one third of the capacity meet at most twice in a
sequence: from the largest down, each is matched greedily with the largest other one that still
fits. The smaller pieces then go, largest first, to the sequence whose gap fits best; what fits
nowhere opens a sequence. Documents are dealt at random into groups of about ``GROUP_ROWS``, so
that no task holds more than a bounded number of documents; groups are packed apart, which costs
a fraction of one sequence in each.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; a
document longer than the capacity is cut into whole pieces of that size and a rest; an empty
table gives no rows; columns other than ``keep`` and the text are left out.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks

GROUP_ROWS = 4096
#: Words and word parts whose ids are kept by a worker; cleared when full, which changes speed only.
CACHE_WORDS = 600_000
#: Word parts within plain words, as the tokenizer's own pattern cuts them; fixed values.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĳĵķĸĺļľŀłńņňŉŋōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżžſªºµ]+|[0-9]|[^\sa-zß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĳĵķĸĺļľŀłńņňŉŋōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżžſªºµ0-9]+")
#: Characters that the plain path is not sure about: number signs, unusual spaces, the dotted capital I, all beyond Latin Extended-A.
_UNSURE = re.compile("[\x1c-\x1f\x85\xa0²³¹¼½¾İ]|[^\x00-ſ]|<\\|")


class WordIds(dict):
    """Ids of whole texts by the tokenizers library, word by word with a cache.

    White space is dropped by this kind of tokenizer and no step looks across ASCII white space,
    so a text's ids are those of its words in a row. Plain Latin words are lower-cased and cut
    here and given to the library's model; any other word goes through the whole library.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(tokenizer_file)
        self.model = self.whole.model
        self.parts: dict[str, bytes] = {}
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabet: printable bytes stand for themselves
        self.letters = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in kept)}

    def part(self, s: str) -> bytes:
        got = self.parts.get(s)
        if got is None:
            text = s if s.isascii() else "".join(map(self.letters.__getitem__, s.encode()))
            got = self.parts[s] = np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()
        return got

    def __missing__(self, w: bytes) -> bytes:
        if len(self) + len(self.parts) > CACHE_WORDS:
            self.clear()
            self.parts.clear()
        s = w.decode()
        if s.isascii() and s.isalpha():
            ids = self.part(s.lower())
        elif _UNSURE.search(s) or not s.isprintable():
            ids = np.array(self.whole.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            ids = b"".join(map(self.part, _PARTS.findall(s.lower())))
        self[w] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids."""
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def word_ids(tokenizer_file: str) -> WordIds:
    return WordIds(tokenizer_file)


def fit(lengths: list[int], capacity: int) -> list[int]:
    """The sequence of each piece, numbered from 0."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    large = [i for i in order if 3 * lengths[i] > capacity]
    small = order[len(large) :]
    bins = [0] * len(lengths)
    gaps: list[int] = []  # distinct gaps in use, ascending
    with_gap: dict[int, list[int]] = {}
    used = 0

    def offer(gap: int, number: int) -> None:
        if gap:
            if gap not in with_gap:
                with_gap[gap] = []
                insort(gaps, gap)
            with_gap[gap].append(number)

    pool: dict[int, list[int]] = {}  # unmatched large pieces by length
    for i in reversed(large):
        pool.setdefault(lengths[i], []).append(i)
    sizes = sorted(pool)

    def take(size: int) -> int:
        i = pool[size].pop()
        if not pool[size]:
            del pool[size]
            sizes.pop(bisect_left(sizes, size))
        return i

    while sizes:
        first = take(sizes[-1])
        bins[first] = used
        gap = capacity - lengths[first]
        at = bisect_right(sizes, gap)
        if at:
            second = take(sizes[at - 1])
            bins[second] = used
            gap -= lengths[second]
        offer(gap, used)
        used += 1
    for i in small:
        at = bisect_left(gaps, lengths[i])
        if at == len(gaps):
            gap, number = capacity, used
            used += 1
        else:
            gap = gaps[at]
            number = with_gap[gap].pop()
            if not with_gap[gap]:
                del with_gap[gap]
                gaps.pop(at)
        bins[i] = number
        offer(gap - lengths[i], number)
    return bins


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int, keep: str, extra: str, with_ids: bool) -> DataFrame:
    """Cuts each document's ids and the end id into pieces; ``extra`` is a long that goes along."""
    kind = docs.schema[keep].dataType.simpleString()
    schema = f"{keep} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, {extra} bigint" + ", ids binary" * with_ids
    names = [keep, "piece", "start", "length", "ids_crc32", extra] + ["ids"] * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words = word_ids(tokenizer_file)
        for b in blocks(batches, "_text"):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(b.column("_text").to_pylist()):
                got = words.encode(text or b"") + end
                for k in range(0, len(got), 4 * capacity):
                    part = got[k : k + 4 * capacity]
                    row.append(i)
                    piece.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            at = pa.array(row, pa.int64())
            cols = [b.column("_key").take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), b.column("_extra").take(at)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * with_ids, names=names)

    return docs.select(F.col(keep).alias("_key"), F.col("text").cast("binary").alias("_text"), F.col(extra).alias("_extra")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1, keep: str = "doc_id", group_rows: int = GROUP_ROWS, with_ids: bool = False) -> DataFrame:
    """Rows (keep, piece, start, length, ids_crc32, sequence_id, offset), with ``ids`` if asked for."""
    groups = max(1, -(-docs.count() // group_rows))
    dealt = docs.select(keep, "text").withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    cut = pieces(dealt, tokenizer_file, capacity, end_id, keep, "_group", with_ids)
    names = [c for c in cut.columns if c not in ("_group", "ids")] + ["sequence_id", "offset"] + ["ids"] * with_ids
    schema = ", ".join(f"{c} {dict(cut.dtypes).get(c, 'bigint')}" for c in names)

    def run(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_pylist()
        where = np.array(fit(lengths, capacity), np.int64)
        order = np.argsort(where, kind="stable")
        ordered = np.array(lengths, np.int64)[order]
        before = np.array([0, *accumulate(ordered[:-1].tolist())], np.int64)[: len(order)]
        first = np.r_[True, where[order][1:] != where[order][:-1]]
        begin = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        offset = np.empty(len(order), np.int64)
        offset[order] = before - before[begin]
        table = table.append_column("sequence_id", pa.array((table["_group"].to_numpy() << 32) + where))
        return table.append_column("offset", pa.array(offset)).select(names)

    return cut.groupBy("_group").applyInArrow(run, schema)
