"""Token ids in binary files: blocks of ids, transposed into planes, each compressed by zstandard.

File format (little-endian).  A file holds the documents of one range of ids, in ascending order::

    magic "BPLN0001"
    payload: per block, its planes one after another, each a zstandard frame
    index: JSON, zstandard frame: {"bits", "block", "n", "planes": [[size of each plane] per block],
           "docs": number of documents}
    doc ids and token counts: int64 arrays, one zstandard frame each
    footer: byte sizes of index, doc ids and counts (3 x uint64), magic "BPLN0001"

A block has ``BLOCK`` ids, the last one fewer.  Bit planes hold bit k of every id of the block,
packed eight to a byte; byte planes hold byte k.  Planes that are zero throughout compress to a few
bytes, and any block can be read alone by the index.

Encoding goes word by word: a text is cut into the pieces that the tokenizer's pre-tokenizer cuts
(:func:`piece_starts`), and each distinct piece is encoded once by the tokenizers library and kept
for the worker's life, up to ``MEMO`` pieces.  Texts with characters beyond Latin letters, or with
the end marker in them, are encoded by the library as a whole.

Null and empty texts have the end id only.  Null ids come first; equal ids are ordered by text, and
rows alike in both are documents of their own.  Texts of any length are encoded whole, in memory of some
50 bytes a character; an empty table gives an empty one.  Columns other than id and text are never read.
The written files are read back by Spark as binary files, so any file system that Spark and
pyarrow reach can hold them.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evalmill.llm.common import found_by_workers
from evalmill.session import shared_folder

MAGIC = b"BPLN0001"
#: Ids in a block, and the ids after which a file is closed.
BLOCK, FILE_IDS = 1 << 16, 1 << 22
#: Distinct pieces that a worker keeps encoded; beyond, it starts anew.
MEMO = 3_000_000
#: Buckets of the table of pieces.
TABLE_LOG2 = 22
#: Characters encoded at a time in a worker.
CHUNK = 1 << 20
END_ID = 2
#: Code points whose classes the piece table holds; other texts are encoded as a whole.
LATIN = 0x250

# The classes of the pre-tokenizer's pattern, and its contractions.
LETTER, NUMBER, OTHER, SPACE, BLANK, BREAK = range(6)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SPECIAL = "<|endoftext|>"


def _classes() -> np.ndarray:
    import regex

    def of(c: str) -> int:
        if c == " ":
            return BLANK
        if regex.match(r"\s", c):
            return SPACE
        return LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else OTHER

    return np.array([of(chr(c)) for c in range(LATIN)] + [BREAK], np.uint8)


def piece_starts(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pieces start in a row of texts; ``LATIN`` as a code point parts the texts.

    A run of letters, of numbers or of other signs is a piece, with one blank before it if there is
    one.  Of a run of white space, its last character stands apart if something follows in the
    text.  A contraction after a letter or number is a piece of its own.
    """
    kind = classes[points]
    white = (kind == SPACE) | (kind == BLANK)
    merged = np.where(white, SPACE, kind)
    n = len(points)
    start = np.ones(n, bool)
    start[1:] = merged[1:] != merged[:-1]
    start |= kind == BREAK
    begins_run = start.copy()
    # The last white character of a run, before something else in the same text.
    following = np.full(n, BREAK, np.uint8)
    following[:-1] = merged[1:]
    last_white = white & (following != SPACE) & (following != BREAK)
    start |= last_white
    # A blank before a run goes with it.
    joined = np.zeros(n, bool)
    joined[1:] = (kind[:-1] == BLANK) & ~white[1:] & (kind[1:] != BREAK)
    start &= ~(joined & begins_run)
    # Contractions: an apostrophe that starts a piece and is followed by one of the endings.
    for at in np.flatnonzero((points == 39) & start):
        for ending in CONTRACTIONS:
            stop = at + 1 + len(ending)
            if stop <= n and all(points[at + 1 + i] == ord(c) for i, c in enumerate(ending)):
                start[at + 1 : stop] = False
                if stop < n:
                    start[stop] |= kind[stop] not in (SPACE, BLANK) or start[stop]
                break
    return start


class Encoder:
    """Encodes whole texts; keeps the ids of pieces it has met, by a 64-bit hash of the piece."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = memo
        self.classes = _classes()
        random = np.random.default_rng(7)
        self.values = random.integers(0, 2**63, LATIN + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = 0x9E3779B97F4A7C15
        self.up = self._powers(base, CHUNK + 2)
        self.down = self._powers(pow(base, -1, 2**64), CHUNK + 2)
        self._clear()

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def _clear(self) -> None:
        # Pieces by number: hash, and where their ids lie. A table of one number per hash bucket
        # finds most of them; those whose bucket was taken lie in sorted arrays.
        self.count = 0
        self.key = np.zeros(1 << 16, np.uint64)
        self.offset, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.table = np.full(1 << TABLE_LOG2, -1, np.int32)
        self.rest_key, self.rest = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        while n > len(array):
            array = np.concatenate([array, np.zeros_like(array)])
        return array

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> np.ndarray:
        """Encode new pieces (by distinct ``keys``, sorted); their numbers."""
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, encoded), np.int32, len(encoded))
        flat = np.fromiter(itertools.chain.from_iterable(encoded), np.uint32, int(sizes.sum()))
        self.ids = self._room(self.ids, self.used + len(flat))
        self.ids[self.used : self.used + len(flat)] = flat
        number = np.arange(self.count, self.count + len(keys), dtype=np.int32)
        self.count += len(keys)
        self.key, self.offset, self.size = (self._room(x, self.count) for x in (self.key, self.offset, self.size))
        self.key[number], self.size[number] = keys, sizes
        self.offset[number] = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        self.used += len(flat)
        spot = self._spot(keys)
        free = self.table[spot] < 0
        self.table[spot[free]] = number[free]
        left = self.table[spot] != number
        at = np.searchsorted(self.rest_key, keys[left])
        self.rest_key, self.rest = np.insert(self.rest_key, at, keys[left]), np.insert(self.rest, at, number[left])
        return number

    @staticmethod
    def _spot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - TABLE_LOG2)).astype(np.int64)

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's piece, -1 where it is not known."""
        number = self.table[self._spot(keys)]
        wrong = np.flatnonzero((number < 0) | (self.key[number] != keys))
        number[wrong] = -1
        if len(self.rest_key):
            at = np.minimum(np.searchsorted(self.rest_key, keys[wrong]), len(self.rest_key) - 1)
            number[wrong] = np.where(self.rest_key[at] == keys[wrong], self.rest[at], -1)
        return number

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, without the end id."""
        result: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        group: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) >= CHUNK or SPECIAL in text:
                result[i] = self._whole(text)
                continue
            if held + len(text) >= CHUNK:
                self._group(texts, group, result)
                group, held = [], 0
            group.append(i)
            held += len(text) + 1
        if group:
            self._group(texts, group, result)
        return result

    def _group(self, texts: list, group: list[int], result: list[np.ndarray]) -> None:
        joined = chr(LATIN).join(texts[i] for i in group) + chr(LATIN)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        if int((points >= LATIN).sum()) > len(group):
            for i in group:
                if max(texts[i]) >= chr(LATIN):
                    result[i] = self._whole(texts[i])
            if rest := [i for i in group if max(texts[i]) < chr(LATIN)]:
                self._group(texts, rest, result)
            return
        start = np.flatnonzero(piece_starts(points, self.classes))
        part = points[start] == LATIN
        stop = np.append(start[1:], len(points))
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(self.values[points] * self.up[: len(points)], out=total[1:])
        begin, end = start[~part], stop[~part]
        key = (total[end] - total[begin]) * self.down[begin]
        number = self._numbers(key)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new, first, place = np.unique(key[missing], return_index=True, return_inverse=True)
            if self.count + len(new) > self.memo and self.count:
                self._clear()
                return self._group(texts, group, result)
            where = missing[first]
            pieces = [joined[a:b] for a, b in zip(begin[where].tolist(), end[where].tolist())]
            number[missing] = self._learn(new, pieces)[place]
        size = self.size[number].astype(np.int64)
        so_far = np.cumsum(size)
        flat = np.repeat(self.offset[number] - (so_far - size), size) + np.arange(so_far[-1] if len(so_far) else 0)
        ids = self.ids[flat]
        # Pieces up to each text's end, as places in the ids.
        stops = np.concatenate([[0], so_far])[np.cumsum(~part)[part]]
        for i, a, b in zip(group, np.concatenate([[0], stops[:-1]]), stops):
            result[i] = ids[a:b]


def shuffle_planes(ids: np.ndarray, bits: int, by: str = "byte") -> list[bytes]:
    """The planes of one block: bit or byte k of every id."""
    if by == "byte":
        rows = ids.astype("<u4").view(np.uint8).reshape(len(ids), 4)
        return [rows[:, k].tobytes() for k in range((bits + 7) // 8)]
    return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1, bitorder="little").tobytes() for k in range(bits)]


def join_planes(planes: list[bytes], n: int, by: str = "byte") -> np.ndarray:
    if by == "byte":
        rows = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            rows[:, k] = np.frombuffer(plane, np.uint8)
        return rows.reshape(-1).view("<u4")
    ids = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        bit = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
        ids |= bit.astype(np.uint32) << np.uint32(k)
    return ids


def pack_file(ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray, by: str = "byte", block: int = BLOCK) -> bytes:
    """One file of the format: all ids of some documents, with the documents' ids and counts."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    body, sizes = [MAGIC], []
    for start in range(0, len(ids), block):
        planes = [press.compress(p) for p in shuffle_planes(ids[start : start + block], bits, by)]
        body += planes
        sizes.append([len(p) for p in planes])
    missing = [i for i, d in enumerate(doc_ids) if d is None]
    index = json.dumps(
        {"bits": bits, "by": by, "block": block, "n": len(ids), "planes": sizes, "docs": len(doc_ids), "null_ids": missing}
    ).encode()
    tail = [
        press.compress(index),
        press.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes()),
        press.compress(np.asarray(counts, "<i8").tobytes()),
    ]
    return b"".join([*body, *tail, np.array([len(t) for t in tail], "<u8").tobytes(), MAGIC])


def unpack_file(data: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """The ids, document ids and counts of a file."""
    import zstandard

    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError("not a token file")
    expand = zstandard.ZstdDecompressor()
    sizes = np.frombuffer(data[-32:-8], "<u8").astype(int)
    at = len(data) - 32 - int(sizes.sum())
    tail = []
    for size in sizes.tolist():
        tail.append(expand.decompress(data[at : at + size]))
        at += size
    index = json.loads(tail[0])
    ids, place = [], len(MAGIC)
    for number, planes in enumerate(index["planes"]):
        found = []
        for size in planes:
            found.append(expand.decompress(data[place : place + size]))
            place += size
        ids.append(join_planes(found, min(index["block"], index["n"] - number * index["block"]), index["by"]))
    doc_ids: list = np.frombuffer(tail[1], "<i8").tolist()
    for i in index["null_ids"]:
        doc_ids[i] = None
    return np.concatenate(ids) if ids else np.zeros(0, np.uint32), doc_ids, np.frombuffer(tail[2], "<i8")


def _write(folder: str, name: str, data: bytes) -> None:
    """Write under a name of its own, then rename, so a repeated task leaves one whole file."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"))
    store.create_dir(path, recursive=True)
    part = f"{path}/_{name}.{os.getpid()}.{os.urandom(4).hex()}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{path}/{name}")


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, by: str = "byte") -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files below ``folder``; a row per file is returned.

    Documents are dealt by ranges of id and sorted within; each task writes its files itself, so
    neither texts nor ids pass through the driver.
    """
    schema = StructType.fromDDL("file string, part int, number int, docs bigint, tokens bigint, bytes bigint")
    fields = to_arrow_schema(schema)
    found_by_workers(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        encoder = _encoder(tokenizer)
        part = TaskContext.get().partitionId()
        doc_ids: list = []
        held: list[np.ndarray] = []
        n = number = 0
        end = np.array([end_id], np.uint32)

        def flush():
            name = f"part-{part:06d}-{number:05d}.bpln"
            counts = np.fromiter((len(h) for h in held), np.int64, len(held))
            data = pack_file(np.concatenate(held), doc_ids, counts, by)
            _write(folder, name, data)
            return pa.RecordBatch.from_pylist(
                [{"file": name, "part": part, "number": number, "docs": len(doc_ids), "tokens": n, "bytes": len(data)}], schema=fields
            )

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                for doc_id, ids in zip(rows.column(0).to_pylist(), encoder.encode(rows.column(1).to_pylist())):
                    doc_ids.append(doc_id)
                    held.append(np.concatenate([ids, end]))
                    n += len(ids) + 1
                    if n >= FILE_IDS:
                        yield flush()
                        doc_ids, held, n, number = [], [], 0, number + 1
        if doc_ids:
            yield flush()

    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    return ordered.mapInArrow(run, schema)


def read_tokens(spark, folder: str) -> DataFrame:
    """The documents of the files: file, place, doc_id, offset in the file, n_tokens, ids_crc32."""
    schema = StructType.fromDDL(
        "file string, place bigint, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint"
    )
    fields = to_arrow_schema(schema)
    found_by_workers(spark)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py().rsplit("/", 1)[-1]
                ids, doc_ids, counts = unpack_file(batch.column(1)[i].as_py())
                data = memoryview(ids.astype("<u4").tobytes())
                stops = np.cumsum(counts)
                crc = [zlib.crc32(data[4 * (b - c) : 4 * b]) for b, c in zip(stops.tolist(), counts.tolist())]
                columns = [[name] * len(doc_ids), range(len(doc_ids)), doc_ids, stops - counts, counts, crc]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bpln").load(folder)
    return files.select("path", "content").mapInArrow(run, schema)


def op10_token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write, read back, and add up where each document starts among all ids."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    folder = shared_folder(spark, "tokens")
    # One small row per file; their totals place each file among all ids.
    files = write_tokens(docs, folder, tokenizer).collect()
    if not files:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    total, starts = 0, []
    for row in sorted(files, key=lambda r: r["file"]):
        starts.append((row["file"], total))
        total += row["tokens"]
    begins = spark.createDataFrame(starts, "file string, begin bigint")
    return (
        read_tokens(spark, folder)
        .join(F.broadcast(begins), "file")
        .select("doc_id", (F.col("begin") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
    )
