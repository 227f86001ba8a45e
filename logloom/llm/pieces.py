"""SentencePiece encoding and decoding on the tokenizers library.

``read_model`` parses the model's protobuf (pieces with scores and kinds, trainer and normaliser settings) without the
sentencepiece package. ``build`` makes a tokenizer of it:

* the normaliser: the precompiled character map if the model has one, removal of extra spaces, spaces to the metaspace marker;
* unigram models: pieces with their scores; BPE models: merges rebuilt from the scores (a pair merges in the order of the score
  of the piece that it makes); both with byte fallback where the model has bytes;
* user-defined pieces are added tokens, and control pieces can't come out of a text.

The dummy prefix is put in front of the text before it is normalised. If no piece has a marker after another character, merges
never cross from a word to a marker, and the text is cut there, so that equal words come from the library's cache.

``encode_pieces`` encodes batches multithreaded (in Rust, one batch after another in each task; ``THREADS`` threads a task, and
``threads`` gives it more where it has the machine for itself), decodes the ids again, and verifies parity: each distinct
text of a batch is encoded whole by the sentencepiece package as well, and ``parity`` says whether all ids are the same. As the installed
models are BPE ones, it can also make a unigram model of a model's pieces (``unigram_of``), read that from its protobuf like
any other, and encode and verify by it, byte fallback included. Ids are
decoded by gathering the bytes of their pieces; a batch whose bytes aren't UTF-8 in the end is decoded by the library.

Edge cases: a null text is an empty one: no ids, and decodes to the empty string; a null doc_id stays null; repeated rows come
out as often as they went in; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tokens import StretchEncoder, gather, tokenizer_path

MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Threads of the libraries in a task.
THREADS = 2


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    suffix: bool = False
    charsmap: bytes = b""

    @property
    def unknown(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """(number, value) of each field of a protobuf message: varints, 64-bit, length-delimited and 32-bit ones."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    while at < len(raw):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        elif wire == 2:
            size = varint()
            yield number, raw[at : at + size]
            at += size
        elif wire == 5:
            yield number, struct.unpack_from("<f", raw, at)[0]
            at += 4
        elif wire == 1:
            yield number, struct.unpack_from("<d", raw, at)[0]
            at += 8
        else:
            raise ValueError(f"wire type {wire} isn't known")


def read_model(raw: bytes) -> Model:
    """Field numbers are those of SentencePiece's public model format."""
    out = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece = {1: b"", 2: 0.0, 3: NORMAL} | dict(_fields(value))
            out.pieces.append((piece[1].decode("utf-8"), float(piece[2]), int(piece[3])))
        elif number == 2:
            trainer = dict(_fields(value))
            out.kind = int(trainer.get(3, UNIGRAM))
            out.byte_fallback = bool(trainer.get(35, 0))
            out.suffix = bool(trainer.get(24, 0))
        elif number == 3:
            rules = dict(_fields(value))
            out.charsmap = rules.get(2, b"")
            out.add_dummy_prefix = bool(rules.get(3, 1))
            out.remove_extra_whitespaces = bool(rules.get(4, 1))
            out.escape_whitespaces = bool(rules.get(5, 1))
    return out


def _message(number: int, value: int | bytes | float) -> bytes:
    """One field of a protobuf message."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(number << 3) + varint(value)


def unigram_of(model: Model) -> bytes:
    """A unigram model, as protobuf, of another model's pieces, in whose order a piece stands for its frequency (a share as Zipf's law has it).

    Scores are in quarters: sums of some millions of them are exact in 32 bits, so that ways to cut a text are equal where they should be.
    """
    rank, out = 0, bytearray()
    for piece, score, kind in model.pieces:
        if kind == NORMAL:
            rank += 1
            score = -round(4 * (8 + math.log(1 + rank))) / 4
        out += _message(1, _message(1, piece.encode()) + _message(2, float(score)) + _message(3, kind))
    out += _message(2, _message(3, UNIGRAM) + _message(35, int(model.byte_fallback)))
    rules = ((3, model.add_dummy_prefix), (4, model.remove_extra_whitespaces), (5, model.escape_whitespaces))
    return bytes(out + _message(3, (_message(2, model.charsmap) if model.charsmap else b"") + b"".join(_message(n, int(v)) for n, v in rules)))


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs in the order in which they merge: by the score of what they make, best first; of one piece, all its splits."""
    score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, UNUSED)}
    out = []
    for piece, s in score.items():
        for k in range(1, len(piece)):
            if piece[:k] in score and piece[k:] in score:
                out.append((-s, len(piece[:k]), piece[:k], piece[k:]))
    out.sort(key=lambda x: x[0])
    return [(a, b) for _, _, a, b in out]


def build(model: Model):
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.suffix:
        raise ValueError("white space as a suffix isn't supported")
    if model.kind == BPE:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocabulary, merges(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are supported")
    out = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip(left=not model.add_dummy_prefix, right=True)]
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARKER))
    out.normalizer = normalizers.Sequence(steps)
    inner = any(MARKER in p.lstrip(MARKER) for p, _, kind in model.pieces if kind in (NORMAL, USER))
    if not inner:
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARKER}+[^{MARKER}]*"), "isolated")
    undo = [decoders.Replace(MARKER, " "), *([decoders.ByteFallback()] if model.byte_fallback else []), decoders.Fuse()]
    out.decoder = decoders.Sequence(undo + ([decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else []))
    if own := [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER]:
        out.add_tokens(own)
    return out


class PieceTokenizer:
    def __init__(self, path: str, unigram: bool = False) -> None:
        with open(path, "rb") as f:
            self.raw = f.read()
        self.model = read_model(self.raw)
        if unigram:
            self.raw = unigram_of(self.model)
            self.model = read_model(self.raw)
        self.tokenizer = build(self.model)
        m = self.model
        inner = any(MARKER in p.lstrip(MARKER) or "\n" in p for p, _, kind in m.pieces if kind in (NORMAL, USER))
        user = any(kind == USER for _, _, kind in m.pieces)
        #: For models whose normaliser is the marker alone, equal stretches of text are encoded once.
        whole = m.kind == BPE or (m.byte_fallback and any(p == MARKER for p, _, _ in m.pieces))
        self.stretches = StretchEncoder(self.tokenizer, "marked") if whole and m.escape_whitespaces and not (inner or user or m.charsmap or m.remove_extra_whitespaces) else None
        raw = [bytes([int(p[3:5], 16)]) if m.byte_fallback and kind == BYTE else p.replace(MARKER, " ").encode() for p, _, kind in m.pieces]
        self.size = np.array([len(x) for x in raw], np.int64)
        self.begin, self.bytes = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(raw), np.uint8)

    def _prepared(self, text: str) -> str:
        if self.model.remove_extra_whitespaces:
            text = text.strip(" ")
        return " " + text if self.model.add_dummy_prefix and text else text

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the n + 1 offsets of the texts."""
        if self.stretches:
            return self.stretches.encode(*K.utf8(pa.array([self._prepared(t) for t in texts], pa.large_string())))
        return flattened(self.whole(texts))

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, off = self.encode_flat(texts)
        return [x.tolist() for x in np.split(ids, off[1:-1])] if texts else []

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast([self._prepared(t) for t in texts], add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """By the library, whatever the ids."""
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def decode_flat(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """The UTF-8 of each row's text."""
        if not len(ids) or int(ids.max()) < len(self.size):
            flat = gather(self.bytes, self.begin[ids], self.size[ids])
            ends = np.concatenate(([0], np.cumsum(self.size[ids])))[off]
            raw = flat.tobytes()
            first = [a + (self.model.add_dummy_prefix and a < b and raw[a] == 32) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            out = [raw[a:b] for a, b in zip(first, ends[1:].tolist(), strict=True)]
            try:
                for x in out:
                    x.decode("utf-8")
                return out
            except UnicodeDecodeError:
                pass
        return [x.encode("utf-8", "surrogatepass") for x in self.decode([x.tolist() for x in np.split(ids, off[1:-1])])]


def flattened(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))))
    return np.fromiter(chain.from_iterable(found), np.uint32, int(off[-1])), off


_open: dict[tuple[str, str, bool], PieceTokenizer] = {}


def piece_tokenizer(path: str, run: str = "", unigram: bool = False) -> PieceTokenizer:
    """The worker's tokenizers of this run; those of other runs are dropped."""
    if (path, run, unigram) not in _open:
        for other in [k for k in _open if k[:2] != (path, run)]:
            del _open[other]
        _open[path, run, unigram] = PieceTokenizer(path, unigram)
    return _open[path, run, unigram]


ROW = "n_tokens long, ids_crc32 long, decoded_sha256 string, parity boolean"


UNIGRAM_ROW = "n_unigram long, unigram_crc32 long, unigram_parity boolean"


def _names(row: str) -> list[str]:
    return [x.split()[0] for x in row.split(", ")]


def encode_pieces(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", verify: bool = True, with_ids: bool = False, threads: int = THREADS, unigram: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), decoded_sha256, parity, with with_ids the ids too; with unigram
    also n_unigram, unigram_crc32 and unigram_parity: the same of the unigram model that ``unigram_of`` makes of the model's pieces."""
    path, run = tokenizer_path(model), uuid.uuid4().hex
    src = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("body"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        codes = [piece_tokenizer(path, run), *([piece_tokenizer(path, run, True)] if unigram else [])]
        checks = [None] * len(codes)
        if verify:
            import sentencepiece

            checks = [sentencepiece.SentencePieceProcessor(model_proto=c.raw) for c in codes]

        def encoded(k: int, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
            """ids, offsets, checksums of the texts, and whether the sentencepiece package gives the same ids."""
            ids, off = codes[k].encode_flat(texts)
            raw = ids.astype("<u4").tobytes()
            crc = np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.int64)
            same = _equal(ids, off, *flattened(checks[k].encode(texts, num_threads=threads))) if verify else [None] * len(texts)
            return ids, off, crc, pa.array(same, pa.bool_())

        for batch in batches:
            for part in K.slices(batch, "body"):
                coded = part.column("body").dictionary_encode()
                texts = coded.dictionary.to_pylist()
                of = coded.indices
                at = of.to_numpy()
                ids, off, crc, same = encoded(0, texts)
                sha = pa.array([hashlib.sha256(x).hexdigest() for x in codes[0].decode_flat(ids, off)], pa.string())
                columns, names = [pa.array(np.diff(off)[at]), pa.array(crc[at]), sha.take(of), same.take(of)], _names(ROW)
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32))).take(of))
                    names = [*names, "ids"]
                if unigram:
                    _, off, crc, same = encoded(1, texts)
                    columns += [pa.array(np.diff(off)[at]), pa.array(crc[at]), same.take(of)]
                    names = [*names, *_names(UNIGRAM_ROW)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], ["doc_id", *names])

    return src.mapInArrow(go, f"doc_id {dict(src.dtypes)['id']}, {ROW}" + ", ids array<int>" * with_ids + f", {UNIGRAM_ROW}" * unigram)


def _equal(ids: np.ndarray, off: np.ndarray, other: np.ndarray, other_off: np.ndarray) -> np.ndarray:
    """For each row whether both have the same ids."""
    same = np.diff(off) == np.diff(other_off)
    if same.all():
        wrong = np.flatnonzero(ids != other)
        same[np.searchsorted(off, wrong, "right") - 1] = False
        return same
    return np.array([bool(k) and np.array_equal(ids[a:b], other[c:d]) for k, a, b, c, d in zip(same, off[:-1], off[1:], other_off[:-1], other_off[1:], strict=True)])


def decode_pieces(df: DataFrame, ids_col: str = "ids", into: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """df with the text of a column of ids; null ids give null."""
    path = tokenizer_path(model)
    src = df.select(F.struct(*[df[c] for c in df.columns if c != into]).alias("rest"), df[ids_col].cast("array<int>").alias("ids"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = piece_tokenizer(path)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            back = iter(code.decode([x for x in ids if x is not None]))
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array([None if x is None else next(back) for x in ids], pa.string())], ["rest", "body"])

    return src.mapInArrow(go, f"rest {dict(src.dtypes)['rest']}, body string").select("rest.*", F.col("body").alias(into))
