"""Operator 6: SentencePiece encoding and decoding that keeps byte offsets.

Normalisation reads the character map compiled into the model file: at each byte the longest prefix of the map is
replaced, anything else is copied one character at a time, and every normalised byte records the source byte it
came from. The sentencepiece library encodes the normalised text with a copy of the model whose own normaliser is
off; piece lengths then run along the alignment, so every piece gets the byte span of the source text it stands for.

Defined results: a null text is an empty one; an empty text has the end id only and decodes to an empty text.
Repeated rows give a row each. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from statuta.llm.common import pick, slices
from statuta.session import table

MARK = "▁"


class CharMap:
    """The compiled character map of a model: a double-array trie over bytes and the replacements it points to."""

    def __init__(self, blob: bytes):
        self.units, self.replacements = np.zeros(0, np.uint32), b""
        if blob:
            size = struct.unpack("<I", blob[:4])[0]
            self.units = np.frombuffer(blob[4 : 4 + size], "<u4")
            self.replacements = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest map entry that starts at a byte; None without one."""
        if not len(self.units):
            return None
        found, node = None, 0
        unit = int(self.units[node])
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            unit = int(self.units[node])
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if (unit >> 8) & 1:
                value = int(self.units[node]) & 0x7FFFFFFF
                end = self.replacements.index(b"\0", value)
                found = (k + 1 - at, self.replacements[value:end])
        return found


class Pieces:
    """A model with its normaliser taken apart; one per task."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as file:
            model = proto.ModelProto.FromString(file.read())
        spec = model.normalizer_spec
        self.charmap = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        spec.name, spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = "identity", b"", False, False
        self.processor = SentencePieceProcessor(model_proto=model.SerializeToString())
        self.end = self.processor.eos_id()
        self.widths = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.names = [str(i) for i in range(len(model.pieces))]

    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """Normalised text, and the source byte of each of its bytes (with the end; None: all in step after the prefix)."""
        if not text:
            return "", None
        if not len(self.charmap.units) and not self.squeeze:
            return (MARK if self.prefix else "") + (text.replace(" ", MARK) if self.escape else text), None
        data, out, source = text.encode(), bytearray(), []
        mark, at = MARK.encode() if self.escape else b" ", 0
        if self.prefix:
            out += mark
            source += [0] * len(mark)
        blank = self.squeeze
        while at < len(data):
            hit = self.charmap.longest(data, at)
            if hit:
                width, piece = hit
            else:
                width = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                piece = data[at : at + width]
            if blank:
                piece = piece.lstrip(b" ")
            if piece:
                blank = self.squeeze and piece.endswith(b" ")
                for byte in piece:
                    new = mark if byte == 0x20 else bytes([byte])
                    out += new
                    source += [at] * len(new)
            at += width
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark) :], source[-len(mark) :]
        return out.decode(), np.array([*source, len(data)], np.int64)

    def cuts(self, norm: str, ids: list[int]) -> np.ndarray:
        """End byte of each piece in the normalised text."""
        ends = np.cumsum(self.widths[np.array(ids, np.int64)])
        if ids and int(ends[-1]) != len(norm.encode()):  # an unknown piece stands for text of another length
            pieces = self.processor.encode(norm, out_type="immutable_proto").pieces
            at, ends = [0, *np.cumsum([len(c.encode()) for c in norm]).tolist()], np.array([p.end for p in pieces])
            ends = np.array([at[e] for e in ends], np.int64)
        return ends

    def encode(self, text: str | None) -> tuple[list[int], str, np.ndarray, np.ndarray]:
        """(ids with the end id, decoded text, begin and end byte of each piece but the end id)."""
        norm, source = self.normalise(text or "")
        ids = self.processor.encode(norm, num_threads=1)
        decoded = self.processor.decode(ids)
        if (self.prefix or self.squeeze) and decoded.startswith(" "):
            decoded = decoded[1:]
        return [*ids, self.end], decoded, *self.spans(text or "", norm, source, self.cuts(norm, ids))

    def spans(self, text: str, norm: str, source: np.ndarray | None, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        if source is None:  # only ' ' (1 byte) became the mark (3 bytes), and the prefix has no source
            data = np.frombuffer(norm.encode(), np.uint8)
            width = np.ones(len(data) + 1, np.int64)
            tail = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, np.int64)
            if MARK in text:  # marks of the source itself keep their three bytes
                own = np.array([c == " " for c in text if c in (" ", MARK)])
                marks = np.concatenate([[True], own]) if self.prefix else own
                squeezed = tail[marks]
            else:
                squeezed = tail
            if self.escape:
                width[squeezed + 1] = 0
                width[squeezed + 2] = 0
            if self.prefix and len(data):
                width[0] = 0
            source = np.concatenate([[0], np.cumsum(width[:-1])])
        return source[begins], source[ends]


OUTPUTS = {
    "ids": "array<int>",
    "begins": "array<int>",
    "ends": "array<int>",
    "decoded": "string",
    "n_tokens": "long",
    "ids_sha256": "string",
    "decoded_sha256": "string",
    "bytes_covered": "long",
}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(
    docs: DataFrame,
    model: str | None = None,
    outputs: tuple[str, ...] = ("ids", "begins", "ends", "decoded"),
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: id and the outputs named. model: a file that every executor has (default: the installed one).

    begins and ends are byte spans of the source text, one for each id but the end id. Digests are of those very ids and
    decoded texts; asking for them alone keeps the arrays from travelling to the JVM.
    """
    base = pick(docs, doc_id=doc_id, text=text)
    kind = dict(base.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces(model or default_model())
        for pdf in slices(batches):
            rows: dict[str, list] = {name: [] for name in outputs}
            for t in pdf["text"]:
                ids, decoded, begins, ends = pieces.encode(t)
                made = {
                    "ids": lambda: ids,
                    "begins": lambda: begins,
                    "ends": lambda: ends,
                    "decoded": lambda: decoded,
                    "n_tokens": lambda: len(ids),
                    "ids_sha256": lambda: hashlib.sha256(" ".join([pieces.names[i] for i in ids]).encode()).hexdigest(),
                    "decoded_sha256": lambda: hashlib.sha256(decoded.encode()).hexdigest(),
                    "bytes_covered": lambda: int((ends - begins).sum()),
                }
                for name in outputs:
                    rows[name].append(made[name]())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **rows})

    out = base.mapInPandas(run, f"doc_id {kind}, " + ", ".join(f"{name} {OUTPUTS[name]}" for name in outputs))
    return out.withColumnRenamed("doc_id", doc_id) if doc_id != "doc_id" else out


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256", "bytes_covered"))
