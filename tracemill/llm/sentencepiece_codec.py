"""SentencePiece encoding and decoding with the tokenizers library as the engine.

The model's protobuf is parsed here, field by field, and its parts are rebuilt: the normaliser with
its precompiled character map and white-space rules, the metaspace marker, unigram scores (or, for
a BPE model, merges in the order of the pieces' scores) and byte fallback. Tasks run the library
without threads of its own, as Spark gives every core a task. `parity` holds the result against the sentencepiece library itself.
"""

from __future__ import annotations

import hashlib
import os
import struct
import sys
from array import array
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tracemill.llm.common import extended

MARK = "▁"
#: Enum values of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters of text that one call of the library encodes.
BATCH_CHARS = 1 << 21
#: Texts whose results a task keeps, so that a copy is not coded again.
COPIES = 50_000


@dataclass
class Model:
    """What a model file says, as far as coding needs it."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix_mark: bool = False

    @property
    def unk(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def _fields(raw: bytes):
    """(number, value) of each field of a protobuf message: integers, or bytes."""
    at, n = 0, len(raw)

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < n:
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
        elif wire == 2:
            size = varint()
            yield tag >> 3, raw[at : at + size]
            at += size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            yield tag >> 3, raw[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {wire} in a model file")


def parse_model(raw: bytes) -> Model:
    """Read a model's protobuf; unknown fields are passed over, absent ones have the format's defaults."""
    m = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode("utf-8")
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for k, v in _fields(value):
                if k == 3:
                    m.kind = v
                elif k == 24:
                    m.suffix_mark = bool(v)
                elif k == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for k, v in _fields(value):
                if k == 2:
                    m.charsmap = v
                elif k == 3:
                    m.dummy_prefix = bool(v)
                elif k == 4:
                    m.squeeze = bool(v)
                elif k == 5:
                    m.escape = bool(v)
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """BPE merges by falling score of what they make: every way to make a piece of two pieces."""
    rank = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER)}
    found = []
    for p, score, kind in m.pieces:
        if kind == NORMAL and len(p) > 1:
            ways = [(rank[p[:k]], rank[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
            found.extend((-score, rank[p], *w) for w in sorted(ways))
    return [(a, b) for *_, a, b in sorted(found)]


def build(m: Model):
    """The model as a tokenizers.Tokenizer; raises ValueError for kinds that the library has no match for."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if m.suffix_mark or not m.escape:
        raise ValueError("models with suffix marks or plain spaces are not supported")
    if m.kind == UNIGRAM:
        # a piece that can't be chosen must never win
        least = min((s for _, s, kind in m.pieces if kind == NORMAL), default=0.0)
        engine = models.Unigram([(p, s if kind == NORMAL else least - 100.0) for p, s, kind in m.pieces], m.unk, m.byte_fallback)
    elif m.kind == BPE:
        engine = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, merges(m), unk_token=m.pieces[m.unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"model kind {m.kind} is not supported")
    t = Tokenizer(engine)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    t.decoder = decoders.Sequence([decoders.Metaspace(MARK, "never", False), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    return t


@lru_cache(maxsize=2)
def _tokenizer(raw: bytes):
    return build(parse_model(raw))


@lru_cache(maxsize=2)
def _encoder(raw: bytes):
    """(library's tokenizer, what a text needs before it): plain rules of marking spaces are quicker on whole strings."""
    from tokenizers import normalizers

    m = parse_model(raw)
    if m.charsmap or m.squeeze:
        return _tokenizer(raw), lambda x: x
    bare, mark = build(m), MARK if m.dummy_prefix else ""
    bare.normalizer = normalizers.Sequence([])
    return bare, lambda x: mark + x.replace(" ", MARK) if x else x


def encode(raw: bytes, texts: list[str | None]) -> list[list[int]]:
    """Ids of each text; a null or empty text has none. Batches are bounded by characters."""
    engine, ready = _encoder(raw)
    out: list[list[int]] = []
    batch: list[str] = []
    size = 0
    for k, x in enumerate(texts):
        batch.append(ready(x or ""))
        size += len(batch[-1])
        if size > BATCH_CHARS or k == len(texts) - 1:
            out.extend(e.ids for e in engine.encode_batch_fast(batch, add_special_tokens=False))
            batch, size = [], 0
    return out


def decode(raw: bytes, ids: list[list[int]]) -> list[str]:
    """Texts of lists of ids, as the model's normaliser left them."""
    return _tokenizer(raw).decode_batch(ids, skip_special_tokens=False)


def parity(raw: bytes, texts: list[str]) -> list[bool]:
    """Whether the sentencepiece library gives the same ids, text by text."""
    import sentencepiece

    ref = sentencepiece.SentencePieceProcessor(model_proto=raw)
    return [a == b for a, b in zip(encode(raw, texts), ref.encode(list(texts), num_threads=1))]


def read_model(spark: SparkSession, path: str) -> bytes:
    """A model file's bytes: of this machine, or of any store that Spark reads."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def _one_thread() -> None:
    """In a task: threads of the library's own would spin beside the other tasks, for more CPU time and no gain."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def encode_documents(docs: DataFrame, raw: bytes, text: str = "text") -> DataFrame:
    """docs with ids array<int> and n_ids int; every row and column is kept.

    A null or empty text has no ids. Columns of docs with the new names are replaced. The model
    (a vocabulary file, of fixed size) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    base = docs.select(*[c for c in docs.columns if c not in ("ids", "n_ids")])
    schema = extended(base, ids=T.ArrayType(T.IntegerType()), n_ids=T.IntegerType())

    def run(batches):
        _one_thread()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                ids = encode(shared.value, part.column(part.schema.get_field_index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(part.num_columns)], pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int32())], names=[*part.schema.names, "ids", "n_ids"])

    return base.mapInArrow(run, schema)


def decode_documents(coded: DataFrame, raw: bytes, out: str = "decoded") -> DataFrame:
    """coded (with ids array<int>) with the decoded text; null ids decode to the empty text."""
    shared = coded.sparkSession.sparkContext.broadcast(raw)
    base = coded.select(*[c for c in coded.columns if c != out])
    schema = extended(base, **{out: T.StringType()})

    def run(batches):
        _one_thread()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                ids = [i or [] for i in part.column(part.schema.get_field_index("ids")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(part.num_columns)], pa.array(decode(shared.value, ids), pa.string())], names=[*part.schema.names, out])

    return base.mapInArrow(run, schema)


def digests(docs: DataFrame, raw: bytes) -> DataFrame:
    """(doc_id, n_ids, ids_sha256, round_trip, parity) for every row: whole texts encoded, decoded and compared.

    ids_sha256 is over the ids as little-endian 32-bit integers. round_trip says whether the library's
    decoder gives the text back (a text that has the marker itself can't come back), parity whether the sentencepiece library gives the same ids. Null and
    empty texts have no ids, and both hold. A text that a task has just had is not coded again.
    """
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def run(batches):
        import sentencepiece

        _one_thread()
        ref = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        had: dict[bytes, tuple] = {}
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [x or "" for x in part.column("text").to_pylist()]
                keys = [hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=20).digest() for x in texts]
                if len(had) > COPIES:
                    had = {}
                fresh = {k: x for k, x in zip(keys, texts) if k not in had}
                new = list(fresh.values())
                ids = encode(shared.value, new)
                for k, x, i, back, same in zip(fresh, new, ids, decode(shared.value, ids), ref.encode(new, num_threads=1)):
                    packed = array("i", i)
                    if sys.byteorder == "big":
                        packed.byteswap()
                    had[k] = len(i), hashlib.sha256(packed.tobytes()).hexdigest(), back == x, i == same
                told = list(zip(*(had[k] for k in keys)))
                kinds = (pa.int64(), pa.string(), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *[pa.array(v, t) for v, t in zip(told, kinds)]], names=["doc_id", "n_ids", "ids_sha256", "round_trip", "parity"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_ids long, ids_sha256 string, round_trip boolean, parity boolean")
