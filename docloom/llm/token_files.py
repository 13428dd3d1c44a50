"""Token ids of a corpus as binary files with a shared zstandard dictionary.

A shard holds the documents of one range of ids in ascending order. Every document is a frame of its
own, so a short one is read without its neighbours; a dictionary trained on a bounded sample makes
up for the frames' shortness. Layout of a shard, all numbers little-endian:

    one zstandard frame per document
    offset index: (offset, bytes, ids, doc_id, 1 if the id is null) per document
    magic, version, width of an id, number of documents, number of ids, SHA-256 of the dictionary
    place of the index, magic

Counts are known last and object stores cannot seek back, so the header follows the frames.

Files are written under a name of the attempt's own and count only once the manifest names them,
so a task that is repeated after a lost executor leaves nothing that is read.
"""

from __future__ import annotations

import functools
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import Kept, map_texts

MAGIC, VERSION = b"TOKSHARD", 1
HEADER = np.dtype([("magic", "S8"), ("version", "<u4"), ("width", "<u4"), ("documents", "<u8"), ("ids", "<u8"), ("dictionary", "V32")])
INDEX = np.dtype([("offset", "<u8"), ("bytes", "<u8"), ("ids", "<u8"), ("doc_id", "<i8"), ("null", "u1")])
FOOTER = np.dtype([("index", "<u8"), ("magic", "S8")])

#: Bytes of text that a shard should hold; it is only a target, no document is ever split.
SHARD_BYTES = 64 << 20
#: The dictionary's size, and its sample: so many texts of at most so many characters.
DICTIONARY_BYTES, SAMPLE_TEXTS, SAMPLE_CHARS = 64 << 10, 1000, 8192
LEVEL = 3
#: Units kept in a worker with their ids, about 130 bytes each, and the longest of them. They are held in two halves: a
#: full younger half becomes the older one, whose units are dropped unless they come again until the next time.
CACHE_UNITS, CACHE_CHARS = 1 << 20, 64
#: Bytes that mark, by hash, units met once: as many come only once, a unit is held when it is met again,
#: but for the first quarter of those held.
MARKS = 1 << 22
#: Bytes of text encoded in one go: of its distinct units, each is looked up once among all that are held.
RUN_BYTES = 4 << 20
#: New units that the tokenizer sees as one text.
LINE_UNITS = 64
#: By byte: ASCII letters and digits, and the other visible ASCII characters.
WORD = np.array([chr(i).isalnum() and i < 0x80 for i in range(256)])
MARK = np.array([0x21 <= i <= 0x7E for i in range(256)]) & ~WORD


class Encoder:
    """Texts to serialised ids by the tokenizers library, which sees each distinct short unit about once.

    A unit begins at a space or line end that a letter or visible mark follows: byte-level
    pre-tokens end before such a place, white space before it stays with the unit before, and no
    merge crosses pre-tokens, so units can be encoded on their own or among others. A unit is held
    without its space; a line end is part of it. A text's first unit has neither and is kept apart, and so
    is a mark that ends a unit after a letter or digit: it is a pre-token of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # a byte is one character of a byte-level token
            self.bytes_of[i] = len(token)
        self.inner: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.met, self.n_met = bytearray(MARKS), 0
        self.first: dict[str, bytes] = {}
        #: Ids of a mark by its byte; the others are not asked for, and 0 is empty.
        self.marks = [self.serial(self.tokenizer.encode(chr(i) if MARK[i] else "", add_special_tokens=False).ids) for i in range(128)]

    def serial(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def split(self, units: list[bytes], ids: list[int]) -> list[bytes]:
        """Serialised ids of each unit, given those of all units in a row."""
        ids = np.array(ids, np.int64)
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(u) for u in units])) + 1
        data = ids.astype(f"<u{self.width}").tobytes()
        ends = (ends * self.width).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, units: list[str]) -> dict[str, bytes]:
        """Ids of new units, in one call."""
        if not units:
            return {}
        whole = [u if u[0] == "\n" else " " + u for u in units]
        # short runs of units stay in the processor's caches; this call leaves out the places in the text
        lines = ["".join(whole[i : i + LINE_UNITS]) for i in range(0, len(whole), LINE_UNITS)]
        ids = [i for line in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False) for i in line.ids]
        return dict(zip(units, self.split([u.encode() for u in whole], ids)))

    def resolve(self, unseen: list[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """Ids of units that the younger half does not hold: of those that the older one holds, and of new ones."""
        again = {u: self.older[u] for u in unseen if u in self.older}
        return again, self.learn([u for u in unseen if u not in again])

    def hold(self, again: dict[str, bytes], new: dict[str, bytes]) -> None:
        """Keep units, but not long ones nor, once the cache has filled, those met for the first time, which leave a mark."""
        full = len(self.inner) + len(again) + len(self.older) > CACHE_UNITS // 4
        self.inner |= again
        for unit, ids in new.items():
            if len(unit) > CACHE_CHARS:
                continue
            if full and not self.met[place := hash(unit) % MARKS]:
                self.met[place] = 1
                self.n_met += 1
            else:
                self.inner[unit] = ids
        if self.n_met > MARKS // 2:
            self.met, self.n_met = bytearray(MARKS), 0
        if len(self.inner) > CACHE_UNITS // 2:
            self.older, self.inner = self.inner, {}

    def begin(self, head: str) -> bytes:
        """Ids of a text's first unit, which has no space before it."""
        ids = self.first.get(head)
        if ids is None:
            ids = self.serial(self.tokenizer.encode(head, add_special_tokens=False).ids)
            if len(head) <= CACHE_CHARS and len(self.first) < CACHE_UNITS // 4:
                self.first[head] = ids
        return ids

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Serialised ids of each text; null is empty."""
        units, first, marks = split_units(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        coded = units.dictionary_encode()
        # a batch's own units are few, so they are looked up once among all that are held
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.inner.get, distinct))
        again, new = self.resolve([u for u, ids in zip(distinct, found) if ids is None])
        more = again | new if again else new
        found = [more[u] if ids is None else ids for u, ids in zip(distinct, found)]
        # behind the units stand the marks, in place of nothing of a text's first unit
        codes = np.array(coded.indices.fill_null(len(found)))
        codes[marks] += np.frombuffer(units.buffers()[2] or b"", np.uint8)[np.frombuffer(units.buffers()[1], np.int64)[marks]]
        ids = pa.array(found + self.marks, pa.large_binary()).take(pa.array(codes))
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int64)[first].tolist()
        data = memoryview(data or b"")
        out = [b"".join((self.begin(head), data[a:b])) for head, a, b in zip(heads(units, first), ends, ends[1:])]
        self.hold(again, new)
        return out


def heads(units: pa.LargeStringArray, first: np.ndarray) -> list[str]:
    """The texts' first units, whose places hold null."""
    _, ends, data = units.buffers()
    ends, data, first = np.frombuffer(ends, np.int64), memoryview(data or b""), first[:-1]
    return [str(data[a:b], "utf-8") for a, b in zip(ends[first].tolist(), ends[first + 1].tolist())]


def split_units(texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """The units of all texts in a row, without their spaces, the places of the texts' first units and of the end, and those of marks.

    Null stands in the place of a first unit or a mark, over its bytes.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data, ends = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    gap = (data == 0x20) | (data == 0x0A)
    last = ends[ends > 0] - 1
    gap[last] = False  # nothing follows a text's last byte
    after = np.zeros_like(data)
    after[:-1] = data[1:]
    starts = gap & (after > 0x20) & (after < 0x7F)
    wide = np.flatnonzero(gap & (after >= 0x80))
    if len(wide):
        starts[wide[letters(data, wide + 1)]] = True
    # a mark is cut off if a letter or digit is before it in the text, and a unit or nothing after it
    closed = np.zeros_like(starts)
    closed[:-1] = starts[1:]
    closed[last] = True
    closed &= MARK[data]
    closed[1:] &= WORD[data[:-1]]
    closed[ends[ends < len(data)]] = False
    starts = np.flatnonzero(starts | closed)
    spaces = data[starts] == 0x20
    kept = np.ones(len(data), bool)
    kept[starts[spaces]] = False
    gone = np.concatenate([[0], np.cumsum(spaces)])  # spaces before each unit and before the end
    before = np.searchsorted(starts, ends)
    first = before + np.arange(len(ends))  # the end counts as a text's first unit
    valid = np.ones(first[-1], bool)
    valid[first[:-1]] = False
    places = np.flatnonzero(valid)
    at = np.empty(len(valid) + 1, np.int64)
    at[first], at[places] = ends - gone[before], starts - gone[:-1]
    marks = places[closed[starts]]
    valid[marks] = False
    buffers = [np.packbits(valid, bitorder="little"), at, data[kept]]
    return pa.Array.from_buffers(pa.large_string(), len(valid), [pa.py_buffer(x) for x in buffers], len(texts) + len(marks)), first, marks


def letters(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether a letter stands at each of the places, where characters of several bytes begin."""
    a, b, c, d = (data[np.minimum(places + i, len(data) - 1)].astype(np.int32) for i in range(4))
    b, c, d = b & 0x3F, c & 0x3F, d & 0x3F
    two, three, four = (a & 0x1F) << 6 | b, (a & 0x0F) << 12 | b << 6 | c, (a & 0x07) << 18 | b << 12 | c << 6 | d
    codes, which = np.unique(np.select([a < 0xE0, a < 0xF0], [two, three], four), return_inverse=True)
    return np.array([chr(x).isalpha() for x in codes.tolist()], bool)[which]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process, on the one core of its task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def train_dictionary(docs: DataFrame, n_short: int, path: str, end_id: int) -> bytes:
    """A zstandard dictionary of the serialised ids of a bounded sample of short texts.

    The sample is up to SAMPLE_TEXTS distinct texts of at most SAMPLE_CHARS characters with the least
    hashes, so reruns agree; the driver holds no more. ``n_short``: how many such texts there are. Too few texts give an empty dictionary.
    """
    short = docs.filter(F.length("text").between(1, SAMPLE_CHARS)).select(F.xxhash64("text").alias("h"), "text")
    # about twice as many pass the first cut, so tasks send few texts to the driver
    share = min(1.0, 2 * SAMPLE_TEXTS / max(n_short, 1))
    near = short.filter(F.col("h") <= F.lit(share * 2.0**64 - 2.0**63)).distinct()
    texts = [r["text"] for r in near.orderBy("h", "text").limit(SAMPLE_TEXTS).collect()]
    own = Encoder(path)
    end = np.array([end_id], f"<u{own.width}").tobytes()
    samples = [x + end for x in own.encode(texts)]
    if len(samples) < 16:
        return b""
    # the library wants samples of several times the dictionary's size
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(max(size, 256), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


@dataclass(frozen=True)
class Store:
    """Where the shards are, the dictionary that reads them, and the committed files with their first id."""

    folder: str
    dictionary: bytes
    files: DataFrame


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder's URI or plain path."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def shard_of(docs: DataFrame, size: int, shard_bytes: int) -> tuple[int, Column]:
    """Number of shards, and a row's shard number: rises with doc_id, null first.

    Bounds are quantiles of the ids: as many shards as the texts' bytes ask for, and no fewer than
    there are shuffle partitions. An id that fills several ranges is spread over them by its texts'
    hashes.
    """
    ranges = max(1 + size // shard_bytes, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if ranges == 1 or docs.isEmpty():
        return 1, F.lit(0)
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    cuts = docs.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    bounds = F.lit(cuts).cast("array<long>")
    least = F.size(F.filter(bounds, lambda x: x < key))
    most = F.size(F.filter(bounds, lambda x: x <= key))
    return ranges, (least + F.pmod(F.xxhash64("text"), most - least + 1)).cast("int")


def write_store(docs: DataFrame, path: str, end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> Store:
    """Encode every whole text, end it with ``end_id`` and write the shards in ascending doc_id order.

    ``docs``: doc_id, text. Null or empty texts hold the end id alone. Rows that share a doc_id stand
    in order of shard, bytes of their ids; null ids come first. An empty table has no shard. Texts are
    read whole and one at a time, and frames, not ids, are shuffled.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size, n_short = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(F.length("text").between(1, SAMPLE_CHARS))).first()
    dictionary = train_dictionary(docs, n_short, path, end_id)
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"

    def encode(batch: pa.RecordBatch) -> dict:
        own = encoder(path)
        end = np.array([end_id], f"<u{own.width}").tobytes()
        pack = compressor(dictionary).compress
        ids = [x + end for x in own.encode(batch.column("text"))]
        return {
            "shard": batch.column("shard"), "doc_id": batch.column("doc_id"), "width": np.full(len(ids), own.width, np.int32),
            "n": np.array([len(x) // own.width for x in ids], np.int64), "frame": [pack(x) for x in ids],
        }

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = open_folder(folder)
        where.create_dir(base, recursive=True)
        now = None
        for batch in batches:
            numbers = batch.column("shard").to_pylist()
            rows = zip(numbers, *(batch.column(c).to_pylist() for c in ("doc_id", "width", "n", "frame")))
            for shard, doc_id, width, n, frame in rows:
                if now is None or now.shard != shard:
                    if now:
                        yield now.close()
                    now = Writer(where, base, shard, width, dictionary)
                now.add(doc_id, n, frame)
        if now:
            yield now.close()

    shards, shard = shard_of(docs, size, shard_bytes)
    schema = "shard int, doc_id long, width int, n long, frame binary"
    framed = map_texts(docs.withColumn("shard", shard), ["shard", "doc_id", "text"], schema, encode, RUN_BYTES)
    placed = framed.repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "n", "frame")
    manifest = Kept(spark, "token-manifest")(placed.mapInArrow(write, "shard int, file string, documents long, ids long, bytes long"))
    # one row a shard, so far fewer than documents: numbers only
    rows, start, first = sorted(manifest.collect(), key=lambda r: r["shard"]), 0, []
    for r in rows:
        first.append((r["shard"], r["file"], r["documents"], r["ids"], start))
        start += r["ids"]
    files = spark.createDataFrame(first, "shard int, file string, documents long, ids long, start long")
    where, base = open_folder(folder)
    where.create_dir(base, recursive=True)
    with where.open_output_stream(f"{base}/dictionary") as out:
        out.write(dictionary)
    return Store(folder, dictionary, files)


@functools.lru_cache(maxsize=2)
def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """One per worker process: preparing a dictionary costs more than a short frame."""
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


class Writer:
    """One shard's file, written from front to end; its index is all that is held."""

    def __init__(self, where: pafs.FileSystem, base: str, shard: int, width: int, dictionary: bytes):
        self.shard, self.width, self.dictionary = shard, width, dictionary
        self.name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        self.out = where.open_output_stream(f"{base}/{self.name}")
        self.index: list[tuple] = []
        self.at = self.ids = 0

    def add(self, doc_id: int | None, n: int, frame: bytes) -> None:
        self.out.write(frame)
        self.index.append((self.at, len(frame), n, doc_id or 0, doc_id is None))
        self.at += len(frame)
        self.ids += n

    def close(self) -> pa.RecordBatch:
        index = np.array(self.index, INDEX)
        head = np.array([(MAGIC, VERSION, self.width, len(index), self.ids, hashlib.sha256(self.dictionary).digest())], HEADER)
        tail = index.tobytes() + head.tobytes() + np.array([(self.at, MAGIC)], FOOTER).tobytes()
        self.out.write(tail)
        self.out.close()
        values = [[self.shard], [self.name], [len(index)], [self.ids], [self.at + len(tail)]]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = ["shard", "file", "documents", "ids", "bytes"]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=names)


class Reader:
    """Documents of one shard: its index is read at once, frames when asked for."""

    def __init__(self, where: pafs.FileSystem, path: str, dictionary: bytes):
        self.file = where.open_input_file(path)
        size = self.file.size()
        foot = np.frombuffer(self.file.read_at(FOOTER.itemsize, size - FOOTER.itemsize), FOOTER)[0]
        place = int(foot["index"])
        rest = self.file.read_at(size - FOOTER.itemsize - place, place)
        self.head = np.frombuffer(rest[-HEADER.itemsize :], HEADER)[0]
        if foot["magic"] != MAGIC or self.head["magic"] != MAGIC or self.head["version"] != VERSION:
            raise ValueError(f"{path} is no token shard")
        if self.head["dictionary"].tobytes() != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        self.index = np.frombuffer(rest[: -HEADER.itemsize], INDEX)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.unpack = zstandard.ZstdDecompressor(dict_data=known)

    def __len__(self) -> int:
        return len(self.index)

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the shard, its end id included."""
        row = self.index[i]
        frame = self.file.read_at(int(row["bytes"]), int(row["offset"]))
        return np.frombuffer(self.unpack.decompress(frame), f"<u{self.head['width']}")

    def close(self) -> None:
        self.file.close()


def read_store(store: Store, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files; ``with_ids`` adds the ids.

    start counts the ids of all documents before; the CRC is that of the ids as 32-bit numbers.
    """
    folder, dictionary = store.folder, store.dictionary

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = open_folder(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                shard = Reader(where, f"{base}/{name}", dictionary)
                counts = shard.index["ids"].astype(np.int64)
                starts = start + np.cumsum(counts) - counts
                step = 256 if with_ids else 8192
                for i in range(0, len(shard), step):
                    rows = range(i, min(i + step, len(shard)))
                    part, crcs, ids = shard.index[rows.start : rows.stop], [], []
                    for k in rows:
                        own = shard.ids(k).astype("<u4")
                        crcs.append(zlib.crc32(own.tobytes()))
                        if with_ids:
                            ids.append(own.astype(np.int32))
                    columns = [
                        pa.array(part["doc_id"].astype(np.int64), mask=part["null"] == 1), pa.array(starts[rows.start : rows.stop]),
                        pa.array(counts[rows.start : rows.stop]), pa.array(crcs, pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array(ids, pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                shard.close()

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    # about one file a task: files are alike in size, and a task that fails repeats one file
    return store.files.select("file", "start").repartition(max(1, min(store.files.count(), 10_000))).mapInArrow(read, schema)


def lookup(store: Store, spark: SparkSession, shard: int, i: int) -> np.ndarray:
    """Ids of one document by its place, reading only its shard's index and its own frame."""
    row = store.files.filter(F.col("shard") == shard).first()
    where, base = open_folder(store.folder)
    reader = Reader(where, f"{base}/{row['file']}", store.dictionary)
    try:
        return reader.ids(i)
    finally:
        reader.close()
