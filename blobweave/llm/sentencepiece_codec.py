"""SentencePiece encoding and decoding with every piece projected to bytes of the original text.

Method: longest-prefix normalisation through the model's compiled character map. The map is a
double array trie with replacement strings behind it; at each position the longest key that is a
prefix of the rest is replaced, and for every normalised byte the original byte it stems from is
recorded. White space is then escaped to U+2581 with a leading one. Pieces never hold a U+2581
after another character, so the normalised text falls into units (a run of U+2581 and what
follows up to the next run) that are merged independently; units are encoded by the
sentencepiece library and kept in a bounded cache. The lengths of the pieces in normalised bytes
then give, through the alignment, their spans in original bytes.

Defined cases: a null text counts as empty and has no ids and no spans; an empty text likewise;
repeated rows give repeated rows; other columns pass through only where named in ``keep``.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import blocks

SPACE = "▁"
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Units whose ids are kept; cleared when full, which changes speed only.
CACHE_UNITS = 500_000


class CharacterMap:
    """The compiled character map of a model: longest-prefix replacement with alignment."""

    def __init__(self, blob: bytes):
        self.units: np.ndarray | None = None
        if blob:
            size = struct.unpack("<I", blob[:4])[0]
            self.units = np.frombuffer(blob[4 : 4 + size], "<u4")
            self.strings = blob[4 + size :]
            self.firsts = {b for b in range(256) if self._step(self._base(0), b) is not None}

    def _base(self, node: int) -> int:
        u = int(self.units[node])
        return node ^ ((u >> 10) << ((u & (1 << 9)) >> 6))

    def _step(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        u = int(self.units[node]) if node < len(self.units) else 1 << 31
        return node if u & ((1 << 31) | 0xFF) == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at ``at`` and its replacement."""
        found, base, i = None, self._base(0), at
        while i < len(data):
            node = self._step(base, data[i])
            if node is None:
                break
            i += 1
            base = self._base(node)
            if (int(self.units[node]) >> 8) & 1:
                value = int(self.units[base]) & 0x7FFFFFFF
                found = (i - at, self.strings[value : self.strings.index(b"\0", value)])
        return found

    def apply(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and one more, the original byte offset."""
        data = text.encode()
        if self.units is None:
            return text, np.arange(len(data) + 1)
        out, source, i = [], [], 0
        while i < len(data):
            hit = self.longest(data, i) if data[i] in self.firsts else None
            width = hit[0] if hit else 1 + (data[i] >= 0xC0) + (data[i] >= 0xE0) + (data[i] >= 0xF0)
            new = hit[1] if hit else data[i : i + width]
            out.append(new)
            source += range(i, i + width) if not hit else [i] * len(new)
            i += width
        return b"".join(out).decode(), np.array([*source, len(data)])


class Codec:
    """One model in one Python worker."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        self.map = CharacterMap(proto.normalizer_spec.precompiled_charsmap)
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        if proto.normalizer_spec.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix or not proto.normalizer_spec.escape_whitespaces:
            raise ValueError("only models that keep and escape white space are handled")
        if any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces):
            raise ValueError("a piece spans words; units can't be merged independently")
        if any(p.type in (3, 4) and p.piece not in ("<s>", "</s>") for p in proto.pieces):
            raise ValueError("models with user-defined pieces are not handled")
        # the units are normalised already: the library only merges
        proto.normalizer_spec.precompiled_charsmap = b""
        proto.normalizer_spec.add_dummy_prefix = False
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.decoder = sentencepiece.SentencePieceProcessor(model_file=model_file)
        #: bytes of normalised text that a piece stands for; 0: unknown, which takes what is left of a character
        self.width = np.array([1 if p.type == 6 else 0 if p.type in (2, 3) else len(p.piece.encode()) for p in proto.pieces])
        self.kept: dict[str, list[int]] = {}
        self.digits = [f"{i}," for i in range(len(proto.pieces))]

    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """The escaped text; with a character map also the original offset of each mapped byte."""
        norm, source = (text, None) if self.map.units is None else self.map.apply(text)
        return (SPACE if self.prefix and norm else "") + norm.replace(" ", SPACE), source

    def _units(self, norm: str) -> list[str]:
        """Units without their first U+2581, if each has one."""
        if self.prefix and f"{SPACE}{SPACE}" not in norm and norm[-1:] != SPACE:
            return norm.split(SPACE)[1:] if norm else []
        return [u[1:] if self.prefix else u for u in _UNIT.findall(norm)]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[np.ndarray]]:
        """For each text its ids, and an array of original byte starts and ends."""
        done = [self.normalise(t) for t in texts]
        units = [self._units(n) for n, _ in done]
        kept = self.kept
        fresh = list({u for us in units for u in us if u not in kept})
        if len(kept) + len(fresh) > CACHE_UNITS:
            kept.clear()
            fresh = list({u for us in units for u in us})
        lead = SPACE if self.prefix else ""
        kept.update(zip(fresh, self.merger.encode([lead + u for u in fresh], num_threads=1), strict=True))
        out = [list(chain.from_iterable(map(kept.__getitem__, us))) for us in units]
        return out, self.spans(out, texts, [s for _, s in done])

    def spans(self, many: list[list[int]], texts: list[str], sources: list[np.ndarray | None]) -> list[np.ndarray]:
        """Projects pieces to original bytes: widths in normalised bytes, then the alignment."""
        out = []
        for ids, text, source in zip(many, texts, sources, strict=True):
            if not len(ids):
                out.append(np.zeros((0, 2), np.int64))
                continue
            if source is None:
                spread, source = np.frombuffer(text.encode(), np.uint8), None
            else:
                spread = np.frombuffer(self.map.apply(text)[0].encode(), np.uint8)
            times = 1 + 2 * (spread == 0x20)  # a space becomes the three bytes of U+2581
            at = np.repeat(np.arange(len(spread), dtype=np.int32) if source is None else source[:-1], times)
            at = np.concatenate([np.zeros(3 * self.prefix, at.dtype), at, [len(spread) if source is None else source[-1]]])
            width = self.width[np.array(ids)]
            if (width == 0).any():
                raise ValueError("a model without byte fallback is not handled")
            cut = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(width, out=cut[1:])
            first, stop = at[cut[:-1]], at[cut[1:]]
            out.append(np.column_stack([first, np.maximum(stop, first)]).astype(np.int64))
        return out

    def decode(self, many: list[list[int]]) -> list[str]:
        return self.decoder.decode(many, num_threads=1) if many else []


@lru_cache(maxsize=4)
def codec(model_file: str) -> Codec:
    return Codec(model_file)


def encode(docs: DataFrame, model_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digests: bool = False) -> DataFrame:
    """Adds ids and spans to each row, or with ``digests`` their counts and hashes.

    ids: array<int>; starts, ends: array<bigint> of original byte offsets; decoded: string.
    With digests: n_tokens, ids_sha256, decoded_sha256, covered_bytes (end of the last span).
    """
    schema = T.StructType([docs.schema[c] for c in keep])
    schema = (
        schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string").add("covered_bytes", "long")
        if digests
        else schema.add("ids", T.ArrayType(T.IntegerType())).add("starts", T.ArrayType(T.LongType())).add("ends", T.ArrayType(T.LongType())).add("decoded", "string")
    )
    names = [f"_k{i}" for i in range(len(keep))]
    source = docs.select(*[docs[c].alias(n) for c, n in zip(keep, names, strict=True)], docs[text].alias("_text"))

    def sha(s: str) -> str:
        return hashlib.sha256(s.encode()).hexdigest()

    def run(batches):
        c = codec(model_file)
        for b in blocks(batches, "_text"):
            texts = [t or "" for t in b.column("_text").to_pylist()]
            ids, spans = c.encode(texts)
            back = c.decode(ids)
            cols = [b.column(n) for n in names]
            if digests:
                cols += [
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([sha("".join(map(c.digits.__getitem__, i))[:-1]) for i in ids], pa.string()),
                    pa.array([sha(x) for x in back], pa.string()),
                    pa.array([int(x[-1, 1]) if len(x) else 0 for x in spans], pa.int64()),
                ]
            else:
                cols += [
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array([x[:, 0] for x in spans], pa.list_(pa.int64())),
                    pa.array([x[:, 1] for x in spans], pa.list_(pa.int64())),
                    pa.array(back, pa.string()),
                ]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return source.mapInArrow(run, schema)


def decode(ids: DataFrame, model_file: str, column: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The text of each row's ids; null ids give an empty text."""
    schema = T.StructType([ids.schema[c] for c in keep]).add("decoded", "string")

    def run(batches):
        c = codec(model_file)
        for b in batches:
            back = c.decode([i or [] for i in b.column(column).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(back, pa.string())], names=schema.names)

    return ids.select(*dict.fromkeys([*keep, column])).mapInArrow(run, schema)
