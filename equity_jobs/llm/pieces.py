"""SentencePiece encoding with source spans, and decoding.

The text is normalised here, by the longest prefix that the model's compiled character
map holds, and every byte of the normalised text keeps the source byte it came from. The
merges are then run on the normalised text by the sentencepiece library, from a copy of
the model that normalises nothing, and each piece is projected to the source bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"  # stands for a space in pieces
SLICE = 1 << 21  # characters of text whose pieces are held at once


def trie_entries(units: np.ndarray) -> dict[bytes, int]:
    """All keys of a double-array trie of 32-bit units, with their values."""
    units = units.tolist()

    def offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    found: dict[bytes, int] = {}
    todo = [(b"", offset(units[0]))]
    while todo:
        key, base = todo.pop()
        for byte in range(1, 256):
            at = base ^ byte
            if at >= len(units) or units[at] & 0x800000FF != byte:
                continue
            below = at ^ offset(units[at])
            if units[at] >> 8 & 1:
                found[key + bytes([byte])] = units[below] & 0x7FFFFFFF
            todo.append((key + bytes([byte]), below))
    return found


class Normalizer:
    """The normalisation that a model's specification asks for, with the source byte of every byte."""

    def __init__(self, charsmap: bytes, dummy_prefix: bool, extra_spaces_removed: bool, spaces_escaped: bool) -> None:
        self.prefix, self.trim, self.space = dummy_prefix, extra_spaces_removed, SPACE if spaces_escaped else " "
        self.map: dict[str, str] = {}
        if charsmap:
            size = int.from_bytes(charsmap[:4], "little")
            targets = charsmap[4 + size :]
            for key, at in trie_entries(np.frombuffer(charsmap, "<u4", size // 4, 4)).items():
                self.map[key.decode()] = targets[at : targets.index(b"\0", at)].decode()
        self.longest = max(map(len, self.map), default=0)
        first = "".join(sorted({re.escape(k[0]) for k in self.map}))
        self.starts = re.compile(f"[{first}]") if first else None

    def mapped(self, text: str) -> Iterator[tuple[int, int, str]]:
        """start, end and replacement of each longest prefix found, from left to right."""
        at = 0
        while found := self.starts and self.starts.search(text, at):
            at = found.start()
            for n in range(min(self.longest, len(text) - at), 0, -1):
                if (new := self.map.get(text[at : at + n])) is not None:
                    yield at, at + n, new
                    at += n
                    break
            else:
                at += 1

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes the source byte where it starts; one more for the end."""
        parts, sources, at, byte = [], [], 0, 0

        def same(upto: int) -> None:
            nonlocal byte
            raw = text[at:upto]
            n = len(raw.encode())
            parts.append(raw)
            sources.append(np.arange(byte, byte + n))
            byte += n

        for start, end, new in self.mapped(text):
            same(start)
            parts.append(new)
            sources.append(np.full(len(new.encode()), byte))
            byte += len(text[start:end].encode())
            at = end
        same(len(text))
        out, source = "".join(parts), np.concatenate(sources)
        raw = np.frombuffer(out.encode(), np.uint8)
        is_space = raw == 32
        if self.trim:
            keep = ~(is_space & np.concatenate([[True], is_space[:-1]]))
            last = np.flatnonzero(~is_space)
            keep[last[-1] + 1 if len(last) else 0 :] = False
            byte = int(source[last[-1] + 1]) if len(last) and last[-1] + 1 < len(source) else byte
            raw, source, is_space = raw[keep], source[keep], is_space[keep]
            out = raw.tobytes().decode()
        if self.space != " ":
            out, source = out.replace(" ", self.space), np.repeat(source, np.where(is_space, len(self.space.encode()), 1))
        if self.prefix and out:
            out, source = self.space + out, np.concatenate([np.full(len(self.space.encode()), source[0]), source])
        return out, np.append(source, byte)


class Codec:
    """Encodes and decodes with one model file; one per Python worker."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as file:
            proto.ParseFromString(file.read())
        spec = proto.normalizer_spec
        self.normalize = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, False
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        kinds = proto.SentencePiece.Type
        self.lengths = np.array([{kinds.BYTE: 1, kinds.CONTROL: 0}.get(p.type, len(p.piece.encode())) for p in proto.pieces], np.int64)
        self.bos, self.eos, self.unknown = self.whole.bos_id(), self.whole.eos_id(), self.whole.unk_id()

    def encode(self, text: str, begin: bool = True, end: bool = True) -> tuple[list[int], np.ndarray]:
        """ids, and the source byte offsets between them (one more than there are ids)."""
        normal, source = self.normalize(text)
        ids = self.merges.encode(normal, num_threads=1)
        sizes = self.lengths[np.array(ids, np.int64)]
        total = len(source) - 1
        if sizes.sum() != total:  # an unknown piece has the length of what it stands for
            sizes = np.array([len(p.surface.encode()) for p in self.merges.encode(normal, return_type="proto").pieces], np.int64)
        bounds = source[np.concatenate([[0], np.cumsum(sizes)])]
        if begin:
            ids, bounds = [self.bos, *ids], np.concatenate([bounds[:1], bounds])
        if end:
            ids, bounds = [*ids, self.eos], np.concatenate([bounds, bounds[-1:]])
        return ids, bounds

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids)


@lru_cache(maxsize=2)
def codec(model_path: str) -> Codec:
    return Codec(model_path)


def _sliced(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts are of SLICE characters, or one row."""
    for batch in batches:
        start, held = 0, 0
        for i, size in enumerate(pa.compute.utf8_length(batch.column(column)).to_pylist()):
            if held and held + (size or 0) > SLICE:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size or 0
        if batch.num_rows > start:
            yield batch.slice(start)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", begin: bool = True, end: bool = True) -> DataFrame:
    """id, ids and bounds of every row: piece i covers source bytes bounds[i] to bounds[i + 1].

    Null texts count as empty; an empty text has the begin and end ids only. One row out
    for each row in, repeats and null ids too; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        own = codec(model_path)
        for batch in _sliced(batches, "text"):
            pairs = [own.encode(t or "", begin, end) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([i for i, _ in pairs], pa.list_(pa.int32())), pa.array([b for _, b in pairs], pa.list_(pa.int32()))], names=[id_col, "ids", "bounds"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, bounds array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of every row of ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            texts = [None if ids is None else own.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of encode() and decode() of every row, in one pass that ships no ids.

    n_tokens counts all ids; covered_bytes is the source offset where the last piece ends.
    Nulls, empty texts, repeats and other columns as in encode().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        own = codec(model_path)
        for batch in _sliced(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                ids, bounds = own.encode(text or "")
                back = own.decode(ids)
                rows.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), int(bounds[-1])))
            n, a, b, covered = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(covered, pa.int64())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, covered_bytes bigint")
