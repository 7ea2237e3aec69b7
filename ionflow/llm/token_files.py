"""Token ids in raw shards with a minimal perfect hash index from document keys to places.

Shards: documents are range-partitioned by doc_id (then by a hash of the text,
so that rows that repeat an id spread too) and sorted; each task encodes its
rows and writes one shard, a fixed header and then nothing but ids, as 16-bit
or, for larger vocabularies, 32-bit little-endian integers. A shard has a name
of its own: one that a task wrote before it was lost is pointed to by nothing.

Index: a document's key is (doc_id, place among the rows of that id). Keys are
hashed to buckets of about BUCKET keys; some consecutive buckets make an index
file, which begins with a table of where each of them lies. A bucket's minimal perfect
hash is built level by level: keys that are alone in their cell of a level's bit
array stay there, the others go on to the next; the rank of a key's bit among
all set bits is its slot. Slots hold a 32-bit fingerprint, shard, start and
number of ids. A lookup reads one table entry, one bucket and one range of ids,
whatever the number of documents. A key that is in no document is turned down
by the fingerprint, but for one in 2^32.

Nulls and rows: a null or empty text is the end id alone. Rows that repeat a
doc_id follow each other, each with a key of its own; a null doc_id comes last.
Texts of any length are encoded whole. The strings of special tokens in a text
are ordinary text. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ionflow.llm import common
from ionflow.llm.textvec import mix

END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: Keys of a bucket in expectation, and the most buckets of an index file.
BUCKET, FILE_BUCKETS = 2048, 64
#: Names of index files that are broadcast at most, some 2 MB; more are joined.
_NAMES = 20_000
#: Cells of a level's bit array for each of its keys; levels before the rest are listed.
CELLS, LEVELS = 1.5, 40
#: Texts, and characters of several texts, that are encoded at once.
_TEXTS, _CHARS = 256, 1 << 21
#: Chunks of text kept with their ids, some 220 MB a worker; beyond, or eight times as many ids, all are forgotten.
_KNOWN = 1_000_000
#: New chunks that go through the library as one text: it is slower with longer ones.
_JOINED = 200
#: Adjoining ranges are read together up to this many bytes.
READ_BYTES = 4 << 20
_NO_ID = 2**63 - 1
_SHARD, _INDEX = "<8sII", "<8sQ"  # headers
_SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("start", "<u8"), ("n", "<u4")])


class Encoder:
    """Ids of texts by the tokenizers library.

    A byte-level BPE of this kind never merges across a single space between two
    characters that are not white, nor across line ends between two such, so a
    text is cut there, and of chunks that come again and again the ids are kept.
    New chunks go through the library together, with line ends between them,
    which there are an id of their own.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        (self.line,) = self.model.encode("\n", add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0  # ids of all chunks, with room for more
        self.start, self.size = np.zeros((2, 1 << 14), np.int64)

    def _keep(self, chunks: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        n, end = len(self.place), len(self.place) + len(chunks)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while end > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n:end], self.size[n:end] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)
        self.place.update(zip(chunks, range(n, end)))

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        plain = []
        for c in chunks:
            word = c[1:] if c[:1] == " " else c
            if word.split() == [word]:
                plain.append(c)
        groups = [plain[k : k + _JOINED] for k in range(0, len(plain), _JOINED)]
        for own, ids in zip(groups, self._encoded(["\n".join(g) for g in groups])):
            ends = np.append(np.flatnonzero(ids == self.line), len(ids))
            if len(ends) == len(own):
                self._keep(own, np.diff(ends, prepend=-1) - 1, ids[ids != self.line])
        rest = [c for c in chunks if c not in self.place]
        if rest:
            ids = self._encoded(rest)
            self._keep(rest, np.array([len(x) for x in ids]), np.concatenate(ids))

    @staticmethod
    def _spaces(text: str, out: list[str]) -> None:
        """Adds text, cut at each single space between two characters that are not white, the space going to the second."""
        parts = text.split(" ")
        if text.split() == parts:  # no other white space, and none doubled
            out.append(parts[0])
            out += [" " + part for part in parts[1:]]
            return
        joined, first = "", True
        for part in parts:
            if first:
                joined, first = part, False
            elif joined and part and not joined[-1].isspace() and not part[0].isspace():
                out.append(joined)
                joined = " " + part
            else:
                joined += " " + part
        out.append(joined)

    @classmethod
    def cut(cls, text: str) -> list[str]:
        """Chunks of text that are encoded apart; a run of line ends between two lines is two, the last line end alone."""
        out: list[str] = []
        own, blank = None, 0
        for line in text.split("\n"):
            if own is None:
                own = line
            elif not line:
                blank += 1
            elif own and not own[-1].isspace() and not line[0].isspace():
                cls._spaces(own, out)
                out += ["\n" * blank, "\n"] if blank else ["\n"]
                own, blank = line, 0
            else:
                own, blank = own + "\n" * (blank + 1) + line, 0
        cls._spaces(own + "\n" * blank, out)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, without end ids, and their numbers."""
        chunks = [self.cut(t) for t in texts]
        every = list(itertools.chain.from_iterable(chunks))
        at = list(map(self.place.get, every))
        new = [k for k, x in enumerate(at) if x is None] if None in at else []
        if new:
            self._learn(list(dict.fromkeys([every[k] for k in new])))
            for k in new:
                at[k] = self.place[every[k]]
        at = np.array(at, np.int64)
        start, n = self.start[at], self.size[at]
        ids = self.flat[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        per = np.add.reduceat(np.append(n, 0), np.cumsum([0, *(len(c) for c in chunks)])[:-1]) if len(texts) else n
        if len(self.place) > _KNOWN or self.used > 8 * _KNOWN:
            self._forget()
        return ids, per


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _shard_writer(folder: str, model: str):
    names = ["part", "shard", "doc_id", "k", "at", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = _encoder(model), TaskContext.get().partitionId()
        kind = np.dtype(f"<u{encoder.width}")
        out, name, at, last, k = None, f"{uuid.uuid4().hex}.ids", 0, None, 0
        try:
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1)
                lo = 0
                while lo < len(ids):
                    hi, chars, some = lo, 0, []
                    while hi < len(ids) and (hi == lo or (hi - lo < _TEXTS and chars < _CHARS)):
                        some.append(texts[hi].as_py() or "")
                        chars += len(some[-1])
                        hi += 1
                    tokens, n = encoder.encode(some)
                    tokens = np.insert(tokens, np.cumsum(n), END_ID)
                    n = n + 1
                    if out is None:
                        where, path = common.filesystem(folder)
                        where.create_dir(path, recursive=True)
                        out = where.open_output_stream(f"{path}/{name}", compression=None)
                        out.write(struct.pack(_SHARD, b"TOKENIDS", encoder.width, 0))
                    out.write(tokens.astype(kind).tobytes())
                    places = []
                    for doc in ids[lo:hi]:
                        doc = _NO_ID if doc is None else doc
                        k = k + 1 if doc == last else 0
                        last = doc
                        places.append(k)
                    m = hi - lo
                    yield pa.record_batch([pa.array(np.full(m, part, np.int32)), pa.array([name] * m), pa.array(ids[lo:hi], pa.int64()), pa.array(places, pa.int64()), pa.array(at + np.cumsum(n) - n), pa.array(n.astype(np.int64))], names=names)
                    at += int(n.sum())
                    lo = hi
        finally:
            if out is not None:
                out.close()

    return run


def write_shards(spark: SparkSession, docs: DataFrame, folder: str, model: str) -> tuple[DataFrame, DataFrame]:
    """Shards under folder/shards; entries (part, doc_id, k, at, n), a row a document, and shards (part, shard, before)."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("text")]
    rows = rows.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order).select("doc_id", "text")
    with common.arrow_rows(spark, _TEXTS):
        entries = common.saved(rows.mapInArrow(_shard_writer(f"{folder}/shards", model), "part int, shard string, doc_id long, k long, at long, n long"), f"{folder}/entries")
    ident = F.coalesce("doc_id", F.lit(_NO_ID))
    shards = entries.groupBy("part", "shard").agg(F.sum("n").alias("tokens"), F.min(ident).alias("first"), F.max(ident).alias("last"), F.max(F.struct(ident, "k")).alias("end"))
    # a row a shard: ids before it, and how many rows of its first document stand in the shards before
    by = W.orderBy("part")
    here = W.partitionBy("last").orderBy("part")
    shards = shards.withColumn("same", F.sum(F.col("end.k") + 1).over(here))
    shards = shards.withColumn("before", F.sum("tokens").over(by) - F.col("tokens"))
    shards = shards.withColumn("again", F.when(F.lag("last").over(by) == F.col("first"), F.lag("same").over(by)).otherwise(0))
    return entries, common.saved(shards.select("part", "shard", "first", "before", "again"), f"{folder}/manifest")


def key_hash(doc: np.ndarray, k: np.ndarray) -> np.ndarray:
    return mix(doc.astype(np.int64).view(np.uint64) + mix(k.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


def _print(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def _cell(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(h + np.uint64((level + 1) * 0xA0761D6478BD642F % 2**64)) % np.uint64(size)


class Mphf:
    """A minimal perfect hash of distinct 64-bit keys: bit arrays by level, slots by rank.

    Keys left after all levels, in practice none, are listed.
    """

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.base = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.rank = [np.cumsum(x) - x for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> Mphf:
        levels = []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = max(8, int(CELLS * len(keys)))
            cell = _cell(keys, level, size)
            alone = np.bincount(cell.astype(np.int64), minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[cell.astype(np.int64)]]
        return cls(levels, np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for every key; of keys not built in, any slot or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            cell = _cell(keys[left], level, len(bits)).astype(np.int64)
            hit = bits[cell]
            out[left[hit]] = self.base[level] + self.rank[level][cell[hit]]
            left = left[~hit]
        if len(self.rest) and len(left):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            hit = self.rest[at] == keys[left]
            out[left[hit]] = self.base[-1] + at[hit]
        return out

    def pack(self) -> bytes:
        head = struct.pack("<II", len(self.levels), len(self.rest))
        return head + b"".join(struct.pack("<I", len(x)) + np.packbits(x).tobytes() for x in self.levels) + self.rest.astype("<u8").tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> tuple[Mphf, int]:
        n, rest = struct.unpack_from("<II", raw)
        at, levels = 8, []
        for _ in range(n):
            (size,) = struct.unpack_from("<I", raw, at)
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, (size + 7) // 8, at + 4), count=size).astype(bool))
            at += 4 + (size + 7) // 8
        return cls(levels, np.frombuffer(raw, "<u8", rest, at).astype(np.uint64)), at + 8 * rest


class Bucket:
    """A bucket of the index: packed, or to be asked for places."""

    def __init__(self, raw: bytes):
        self.hash, at = Mphf.unpack(raw)
        self.slots = np.frombuffer(raw, _SLOT, offset=at)

    @staticmethod
    def pack(h: np.ndarray, shard: np.ndarray, start: np.ndarray, n: np.ndarray) -> bytes:
        m = Mphf.build(h)
        slots = np.zeros(len(h), _SLOT)
        at = m.slots(h)
        for name, x in (("print", _print(h)), ("shard", shard), ("start", start), ("n", n)):
            slots[name][at] = x
        return m.pack() + slots.tobytes()

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether found, rows of slots) of key hashes."""
        at = self.hash.slots(h)
        ok = at >= 0
        row = self.slots[np.maximum(at, 0)] if len(self.slots) else np.zeros(len(h), _SLOT)
        return ok & (row["print"] == _print(h)), row


def _keyed(buckets: int, per_file: int):
    """doc_id and k as hash and bucket, other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = key_hash(b.column("doc_id").fill_null(_NO_ID).to_numpy(), b.column("k").to_numpy())
            bucket = (mix(h) % np.uint64(buckets)).astype(np.int64)
            yield pa.record_batch([*b.columns, pa.array(h.view(np.int64)), pa.array(bucket), pa.array(bucket // per_file)], names=[*b.schema.names, "h", "bucket", "file"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by a column, a batch for each of its values."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        v = b.column(name).to_numpy()
        cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            if held and held[0].column(name)[0].as_py() != int(v[lo]):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _index_writer(folder: str, per_file: int):
    """Rows sorted by bucket, whole files in a task: a file each, with a table of its buckets at its beginning."""

    def write(file: int, blobs: dict[int, bytes]) -> str:
        where, path = common.filesystem(folder)
        where.create_dir(path, recursive=True)
        name = f"{file:08d}-{uuid.uuid4().hex}.mph"
        ends = np.cumsum([struct.calcsize(_INDEX) + 8 * (per_file + 1), *(len(blobs.get(k, b"")) for k in range(per_file))]).astype("<u8")
        with where.open_output_stream(f"{path}/{name}", compression=None) as out:
            out.write(struct.pack(_INDEX, b"MPHINDEX", per_file) + ends.tobytes())
            for k in sorted(blobs):
                out.write(blobs[k])
        return name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, made = None, {}, []
        for g in _groups(batches, "bucket"):
            bucket = g.column("bucket")[0].as_py()
            if now is not None and bucket // per_file != now:
                made.append((now, write(now, blobs)))
                blobs = {}
            now = bucket // per_file
            blobs[bucket % per_file] = Bucket.pack(g.column("h").to_numpy().view(np.uint64), *(g.column(c).to_numpy() for c in ("part", "at", "n")))
        if now is not None:
            made.append((now, write(now, blobs)))
        yield pa.record_batch([pa.array([x for x, _ in made], pa.int64()), pa.array([x for _, x in made], pa.string())], names=["file", "name"])

    return run


class Index:
    """Names of the index files (file, name), buckets in all and in a file."""

    def __init__(self, names: DataFrame, buckets: int, per_file: int):
        self.names, self.buckets, self.per_file = names, buckets, per_file


def _range(where, path: str, start: int, size: int) -> bytes:
    with where.open_input_file(path) as f:
        f.seek(start)
        return f.read(size)


def _bucket(where, path: str, place: int) -> Bucket:
    """One entry of a file's table, then one bucket."""
    lo, hi = struct.unpack("<QQ", _range(where, path, struct.calcsize(_INDEX) + 8 * place, 16))
    return Bucket(_range(where, path, lo, hi - lo)) if hi > lo else Bucket(struct.pack("<II", 0, 0))


def build_index(spark: SparkSession, entries: DataFrame, shards: DataFrame, folder: str) -> Index:
    """Index files under folder/index, and the table of their names under folder/files."""
    buckets = max(1, -(-entries.count() // BUCKET))
    # small indexes are spread over tasks too
    per_file = min(FILE_BUCKETS, -(-buckets // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    files = -(-buckets // per_file)
    keys = _placed(entries, shards).select("part", "doc_id", "k", "at", "n")
    keyed = keys.mapInArrow(_keyed(buckets, per_file), "part int, doc_id long, k long, at long, n long, h long, bucket long, file long").select("part", "at", "n", "h", "bucket", "file")
    keyed = keyed.repartition(files, "file").sortWithinPartitions("bucket")
    names = keyed.mapInArrow(_index_writer(f"{folder}/index", per_file), "file long, name string")
    names = common.saved(names.select("file", "name", F.lit(buckets).cast("long").alias("buckets"), F.lit(per_file).cast("long").alias("per_file")), f"{folder}/files")
    return Index(names.select("file", "name"), buckets, per_file)


def _placed(entries: DataFrame, shards: DataFrame) -> DataFrame:
    """Entries whose k counts the rows of a document in the shards before too."""
    again = F.when(F.coalesce("doc_id", F.lit(_NO_ID)) == F.col("first"), F.col("again")).otherwise(0)
    return entries.drop("shard").join(shards, "part").withColumn("k", F.col("k") + again)


def locate(keys: DataFrame, index: Index, folder: str) -> DataFrame:
    """(doc_id, k, part, at, n) of keys (doc_id, k) that the index has, each through its bucket."""
    per_file = index.per_file
    keyed = keys.select("doc_id", "k").mapInArrow(_keyed(index.buckets, per_file), "doc_id long, k long, h long, bucket long, file long")
    names = F.broadcast(index.names) if index.buckets // per_file < _NAMES else index.names
    dealt = keyed.join(names, "file").repartition("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = common.filesystem(f"{folder}/index")
        for g in _groups(batches, "bucket"):
            b = _bucket(where, f"{path}/{g.column('name')[0].as_py()}", g.column("bucket")[0].as_py() % per_file)
            ok, row = b.find(g.column("h").to_numpy().view(np.uint64))
            out = [g.column("doc_id"), g.column("k"), *(pa.array(row[c].astype(t)) for c, t in (("shard", np.int32), ("start", np.int64), ("n", np.int64)))]
            yield pa.record_batch(out, names=["doc_id", "k", "part", "at", "n"]).filter(pa.array(ok))

    return dealt.mapInArrow(run, "doc_id long, k long, part int, at long, n long")


def _payload_reader(folder: str):
    """Rows sorted by shard and place: ids_crc32 of each range, adjoining ones read together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = common.filesystem(folder)
        width, now = 0, None
        for b in batches:
            names, at, n = b.column("shard").to_pylist(), b.column("at").to_numpy(), b.column("n").to_numpy()
            crc, lo = np.zeros(len(at), np.int64), 0
            while lo < len(at):
                if names[lo] != now:
                    now = names[lo]
                    _, width, _ = struct.unpack(_SHARD, _range(where, f"{path}/{now}", 0, struct.calcsize(_SHARD)))
                hi, size = lo, 0
                while hi < len(at) and names[hi] == now and (hi == lo or (at[hi] == at[hi - 1] + n[hi - 1] and size < READ_BYTES)):
                    size += int(n[hi]) * width
                    hi += 1
                ids = np.frombuffer(_range(where, f"{path}/{now}", struct.calcsize(_SHARD) + int(at[lo]) * width, size), f"<u{width}").astype("<u4")
                for r in range(lo, hi):
                    crc[r] = zlib.crc32(ids[at[r] - at[lo] : at[r] - at[lo] + n[r]].tobytes())
                lo = hi
            yield pa.record_batch([b.column("doc_id"), pa.array(b.column("before").to_numpy() + at), b.column("n"), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_back(keys: DataFrame, shards: DataFrame, index: Index, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of keys: each is looked up in the index and its ids read from its shard."""
    found = locate(keys, index, folder).join(shards.select("part", "shard", "before"), "part")
    # a shard's ranges are dealt in stretches
    dealt = found.repartition("part", F.floor(F.col("at") / (READ_BYTES // 2))).sortWithinPartitions("part", "at")
    return dealt.select("doc_id", "at", "n", "shard", "before").mapInArrow(_payload_reader(f"{folder}/shards"), "doc_id long, start long, n_tokens long, ids_crc32 long")


class Reader:
    """Keyed access from the driver or a training process: ids of a document, by its key. Holds the names of files only."""

    def __init__(self, spark: SparkSession, folder: str):
        files = spark.read.parquet(f"{folder}/files").collect()  # a row some 100,000 documents
        self.names = {r.file: r.name for r in files}
        self.buckets, self.per_file = (files[0].buckets, files[0].per_file) if files else (1, 1)
        self.shards = {r.part: r.shard for r in spark.read.parquet(f"{folder}/manifest").collect()}  # a row a shard
        self.where, self.path = common.filesystem(folder)

    def ids(self, doc_id: int | None, k: int = 0) -> np.ndarray | None:
        h = key_hash(np.array([_NO_ID if doc_id is None else doc_id]), np.array([k]))
        bucket = int(mix(h)[0] % np.uint64(self.buckets))
        name = self.names.get(bucket // self.per_file)
        if name is None:
            return None
        ok, row = _bucket(self.where, f"{self.path}/index/{name}", bucket % self.per_file).find(h)
        if not ok[0]:
            return None
        shard = f"{self.path}/shards/{self.shards[int(row['shard'][0])]}"
        _, width, _ = struct.unpack(_SHARD, _range(self.where, shard, 0, struct.calcsize(_SHARD)))
        return np.frombuffer(_range(self.where, shard, struct.calcsize(_SHARD) + int(row["start"][0]) * width, int(row["n"][0]) * width), f"<u{width}").astype(np.uint32)


def write(spark: SparkSession, docs: DataFrame, folder: str, model: str | None = None) -> tuple[DataFrame, DataFrame, Index]:
    """Shards and index of docs under folder: keys (doc_id, k), shards, index."""
    common.ship(spark)
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(TOKENIZER)
    entries, shards = write_shards(spark, docs, folder, model)
    index = build_index(spark, entries, shards, folder)
    return _placed(entries, shards).select("doc_id", "k"), shards, index


def encoded(spark: SparkSession, docs: DataFrame, folder: str | None = None, model: str | None = None) -> DataFrame:
    """Write docs and read every document back by its key: doc_id, start, n_tokens, ids_crc32."""
    folder = folder or common.workdir(spark, "tokens")
    return read_back(*write(spark, docs, folder, model), folder)
