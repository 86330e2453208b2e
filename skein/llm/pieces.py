"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of whitespace markers with the characters up to the next marker. When no piece of
the model has a marker after another character, no merge crosses from one chunk into the next, so
each distinct chunk is segmented once, and a text's ids are its chunks' ids joined by position.

Documents are read in blocks of some megabytes. A block's distinct chunks are numbered as they appear, and its texts become these numbers. The chunks go,
packed, to the parts of the corpus's table of distinct chunks (by their hash); a part segments each of its chunks once, and
gives every block the ids of those it asked for, in the order in which it did. Blocks meet their answers again by a hash of their content,
and numbers become ids. What is shuffled is each block's distinct chunks, their ids, and the numbers: less than the texts.
Decoding joins what the library makes of each piece, in bytes, as pieces may be parts of a character.
Documents are read twice and must give their rows in the same order again, as files do. What isn't a plain reading of files (a join's or shuffle's output, random choices) is
written first and read from there.

A part remembers up to ``TABLE`` chunks at once; where it has more, it starts again, and chunks that come back are segmented again, with the same ids.
Chunks over ``LONGEST`` characters, which hardly repeat, are segmented where they stand, so that the table's parts hold short ones only.

Results for special cases: a null or empty text has the begin and end ids alone and decodes to "";
texts of any length are encoded whole; repeated rows give repeated results; an empty table gives
an empty one; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.batches import slices, texts_of
from skein.stage import stage

MARK = "▁"
#: Characters and rows of a block, and characters of the longest chunk that goes to the table.
BLOCK_CHARS, BLOCK_ROWS, LONGEST = 32 << 20, 50_000, 48
#: Chunks that a part of the table holds in memory at once.
TABLE = 1_000_000

_chunks = re.compile(f"{MARK}+[^{MARK}]*").findall


class Model:
    """Segments chunks; refuses models for which a text isn't its chunks."""

    def __init__(self, model_path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for i in range(self.model.get_piece_size()):
            if MARK in self.model.id_to_piece(i).lstrip(MARK):
                raise ValueError("pieces of this model cross whitespace markers")
        if self.model.encode("a  b", out_type=str)[0] != f"{MARK}a" or self.model.decode(self.model.encode("a  b ")) != "a  b ":
            raise ValueError("this model drops or rewrites whitespace")
        self.begin, self.end = self.model.bos_id(), self.model.eos_id()
        self.lone = self.model.piece_to_id(MARK)
        self.surface = self._surfaces()

    def _surfaces(self) -> list[bytes]:
        """What each piece adds to a decoded text, past its head."""
        head = self.model.encode("a")
        before, out = len(self.model.decode(head)), []
        for i in range(self.model.get_piece_size()):
            if self.model.is_byte(i):
                out.append(bytes([int(self.model.id_to_piece(i)[1:-1], 16)]))
            else:
                out.append(self.model.decode([*head, i])[before:].encode())
        return out

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk."""
        # The model puts its own marker before a text: the chunk's first one.
        found = self.model.encode([c[1:] for c in chunks], num_threads=1)
        return [ids if len(c) > 1 else [self.lone] for c, ids in zip(chunks, found, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of a whole text's ids; the first marker is the model's own."""
        return b"".join(map(self.surface.__getitem__, ids.tolist()))[1:].decode()


def pack_strings(strings: list[str]) -> bytes:
    raw = [s.encode() for s in strings]
    sizes = np.fromiter(map(len, raw), np.uint32, len(raw))
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(raw)).tobytes() + sizes.tobytes() + b"".join(raw))


def unpack_strings(blob: bytes) -> list[str]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = (4 + 4 * n + np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64)])).tolist()
    return [raw[a:b].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def pack_numbers(*arrays: np.ndarray) -> bytes:
    """Whole numbers of up to 32 bits, compressed byte by byte of their size: most are small."""
    out = []
    for a in arrays:
        planes = np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)
        blob = zstandard.ZstdCompressor(level=3).compress(planes.tobytes())
        out.append(len(blob).to_bytes(4, "little") + blob)
    return b"".join(out)


def unpack_numbers(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[at + 4 : at + 4 + n]), np.uint8).reshape(4, -1)
        out.append(np.ascontiguousarray(planes.T).view("<u4").ravel())
        at += 4 + n
    return out


def pack_segments(segments: list[list[int]]) -> bytes:
    """How many ids each chunk has, and all ids."""
    sizes = np.fromiter(map(len, segments), np.uint32, len(segments))
    return pack_numbers(sizes, np.fromiter(chain.from_iterable(segments), np.uint32, int(sizes.sum())))


@dataclass
class Block:
    """Some documents: the numbers of each one's chunks, the part of each chunk (the last: ``long`` ones), and the parts' chunks in the order of their numbers."""

    keys: pa.RecordBatch | None
    name: bytes
    numbers: list[np.ndarray]
    home: np.ndarray
    parts: list[list[str]]
    long: list[str]


def _block(keys: list[pa.RecordBatch], texts: list[str], parts: int) -> Block:
    found: dict[str, int] = {}
    numbers, name = [], xxhash.xxh128()
    for text in texts:
        name.update(f"{len(text)}:{text}")
        own = _chunks(MARK + text.replace(" ", MARK)) if text else []
        numbers.append(np.fromiter((found.setdefault(c, len(found)) for c in own), np.uint32, len(own)))
    lists: list[list[str]] = [[] for _ in range(parts + 1)]
    home = np.fromiter((parts if len(c) > LONGEST else xxhash.xxh32_intdigest(c) % parts for c in found), np.int32, len(found))
    for c, p in zip(found, home.tolist(), strict=True):
        lists[p].append(c)
    whole = pa.Table.from_batches(keys).combine_chunks().to_batches() if keys and keys[0].num_columns else []
    return Block(whole[0] if whole else None, name.digest(), numbers, home, lists[:-1], lists[-1])


def _blocks(batches: Iterator[pa.RecordBatch], keys: list[str], column: str, parts: int) -> Iterator[Block]:
    """Blocks end by the number and characters of their rows alone, so that they are the same whatever else is read with them."""
    held, texts, chars = [], [], 0
    for batch in slices(batches):
        first = 0
        own = texts_of(batch, column)
        for k, text in enumerate(own):
            texts.append(text)
            chars += len(text)
            if chars >= BLOCK_CHARS or len(texts) >= BLOCK_ROWS:
                held.append(batch.select(keys).slice(first, k + 1 - first))
                yield _block(held, texts, parts)
                held, texts, chars, first = [], [], 0, k + 1
        if first < len(own):
            held.append(batch.select(keys).slice(first))
    if texts:
        yield _block(held, texts, parts)


_PACKED = T.StructType([T.StructField("block", T.BinaryType()), T.StructField("part", T.IntegerType()), T.StructField("blob", T.BinaryType()), T.StructField("extra", T.BinaryType())])


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=_PACKED.names)


def _answers(docs: DataFrame, text: str, model_path: str, parts: int) -> DataFrame:
    """Rows of ids: for each block and part of the table, those of the block's chunks there."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, [], text, parts):
            yield _packed([(block.name, p, pack_strings(c), None) for p, c in enumerate(block.parts) if c])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table, now = Model(model_path), {}, None
        for batch in slices(batches, rows=32):
            out = []
            for name, part, blob in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "blob")), strict=True):
                if part != now:
                    table, now = {}, part  # the part's distinct chunks
                chunks = unpack_strings(blob)
                if len(table) > TABLE:
                    table = {}
                new = [c for c in chunks if c not in table]
                table.update(zip(new, model.segment(new), strict=True))
                out.append((name, part, pack_segments([table[c] for c in chunks]), None))
            yield _packed(out)

    return docs.select(text).mapInArrow(ask, _PACKED).repartition("part").sortWithinPartitions("part").mapInArrow(answer, _PACKED)


def _rereadable(docs: DataFrame) -> DataFrame:
    """``docs`` if it only reads files, which come in the same order again, else a table written from it."""

    def plain(plan) -> bool:
        kids = plan.children()
        own = plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View") or plan.nodeName().startswith(("LogicalRelation", "Relation"))
        return own and plan.deterministic() and all(plain(kids.apply(k)) for k in range(kids.size()))

    return docs if plain(docs._jdf.queryExecution().optimizedPlan()) else stage(docs)


def _encoded(docs: DataFrame, model_path: str, keys: tuple[str, ...], text: str, out: list[tuple[str, T.DataType, pa.DataType]], finish: Callable) -> DataFrame:
    """``keys`` with the columns that ``finish`` makes of a list of ids and decoded texts."""
    parts = max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = list(dict.fromkeys(keys))
    docs = _rereadable(docs.select(*dict.fromkeys([*own, text])))
    schema = T.StructType([docs.schema[k] for k in own] + [T.StructField(n, t) for n, t, _ in out])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, options = Model(model_path), pa.ipc.IpcWriteOptions(compression="zstd")
        for block in _blocks(batches, own, text, parts):
            rows = block.keys if own else pa.RecordBatch.from_arrays([pa.nulls(len(block.numbers))], names=["none"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
                writer.write_batch(rows)
            asked = np.array([sum(map(bool, block.parts))])
            sizes = np.array([len(x) for x in block.numbers])
            extra = pack_numbers(asked, sizes, np.concatenate(block.numbers), block.home) + pack_segments(model.segment(block.long))
            yield _packed([(block.name, parts, sink.getvalue().to_pybytes(), extra)])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, now, answers = Model(model_path), None, {}
        for batch in slices(batches, rows=32):
            for name, part, blob, extra in zip(*(batch.column(c).to_pylist() for c in _PACKED.names), strict=True):
                if name != now:
                    now, answers = name, {}
                if part < parts:
                    answers[part] = blob  # blocks of equal content ask alike
                    continue
                asked, chunks, numbers, home, *long = unpack_numbers(extra)
                if len(answers) != asked[0]:
                    raise RuntimeError("documents came in another order when they were read again; write them to files first")
                known = [unpack_numbers(answers[p]) for p in sorted(answers)] + [long]
                sizes, flat = (np.concatenate([k[i] for k in known]) for i in (0, 1))
                # The answers stand in the order of parts, and of numbers within them.
                order = np.argsort(home, kind="stable")
                first, size = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
                first[order], size[order] = np.cumsum(sizes, dtype=np.int64) - sizes, sizes
                ends = np.cumsum(chunks, dtype=np.int64)
                rows = pa.ipc.open_stream(blob).read_next_batch()
                for a in range(0, rows.num_rows, 256):
                    ids = []
                    for end, count in zip(ends[a : a + 256], chunks[a : a + 256], strict=True):
                        at = numbers[end - count : end]
                        n = size[at]
                        places = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        ids.append(np.concatenate([[model.begin], flat[places], [model.end]]).astype("<u4"))
                    made = [pa.array(v, t) if isinstance(v, list) else v for v, (_, _, t) in zip(finish(ids, [model.decode(i) for i in ids]), out, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(rows.column(k).slice(a, 256) for k in own), *made], names=schema.names)

    placed = docs.mapInArrow(place, _PACKED)
    both = placed.unionByName(_answers(docs, text, model_path, parts))
    return both.repartition("block").sortWithinPartitions("block", F.col("part")).mapInArrow(assemble, schema)


def encode_documents(docs: DataFrame, model_path: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys``, ``ids`` (array of int, begin and end included) and ``decoded`` for each row of ``docs``."""

    def finish(ids: list[np.ndarray], texts: list[str]) -> list:
        ends = np.cumsum([0] + [len(i) for i in ids], dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))), texts]

    return _encoded(docs, model_path, keys, text, [("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), ("decoded", T.StringType(), pa.string())], finish)


def encode_digests(docs: DataFrame, model_path: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: digests of what :func:`encode_documents` returns, made where the ids are."""

    def finish(ids: list[np.ndarray], texts: list[str]) -> list:
        return [[len(i) for i in ids], [hashlib.sha256(i.tobytes()).hexdigest() for i in ids], [hashlib.sha256(t.encode()).hexdigest() for t in texts]]

    out = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    return _encoded(docs, model_path, keys, text, out, finish)
