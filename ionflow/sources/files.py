"""Readers and writers: Parquet, JSON lines and JSON, with guards against overwriting."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ionflow.operators import ranks
from ionflow.sources import tables

SPECTRUM = (
    "molecule_id string, spectrum_id string, precursor_mz double, adduct string, ionization_mode string, ms2_mzs array<double>, "
    "ms2_normalized_intensities array<double>, collision_energy_ev array<double>, base_peak_intensity double, instrument_type string"
)
_RAW = {"inchikey14": "string", "molecular_formula": "string", "ingest_lib": "string", "precursor_error_ppm": "double"}


def complete(rows: DataFrame) -> DataFrame:
    """rows with every column of a spectrum, null where they lack it, and no null ids by mistake."""
    for part in SPECTRUM.split(", "):
        name, kind = part.split()
        rows = rows.withColumn(name, F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind))
    return rows


#: Files up to this size are hashed by Spark's reader; larger ones are streamed.
_WHOLE = 256 << 20
#: Leaves of the tree that digests of files are combined by.
_LEAVES = 3


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests = []
        for path in b.column(0).to_pylist():
            where, name = pafs.FileSystem.from_uri(path)
            h = hashlib.sha256()
            with where.open_input_stream(name, compression=None) as f:
                while piece := f.read(8 << 20):
                    h.update(piece)
            digests.append(h.hexdigest())
        yield pa.record_batch([b.column(0), pa.array(digests, pa.string())], names=["path", "digest"])


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest): SHA-256 of each Parquet file at path, or of the one file there; made on the executors."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if _is_folder(spark, path):
        found = found.where(F.col("path").endswith(".parquet"))
    small = found.where(F.col("length") <= _WHOLE).select("path", F.sha2("content", 256).alias("digest"))
    large = found.where(F.col("length") > _WHOLE).select("path")
    if large.isEmpty():
        return small
    tables.ship(spark)
    return small.unionByName(large.repartition("path").mapInArrow(_streamed, "path string, digest string"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _qualified(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def mark(path: str) -> str:
    """16 hex digits of the content: of the file, or of its Parquet files and their names within the folder.

    Digests of files are combined as a tree, so that no list holds them all; the
    order in which files are listed, and where the folder lies, have no part in it.
    """
    spark = SparkSession.active()
    every = fingerprints(spark, path)
    if not _is_folder(spark, path):
        return every.first().digest[:16]
    name = F.substring(F.col("path"), F.lit(len(_qualified(spark, path)) + 1), F.length("path"))
    leaf = every.select(F.substring(F.sha2(name, 256), 1, _LEAVES).alias("leaf"), F.concat(name, F.lit(":"), "digest").alias("line"))
    leaves = leaf.groupBy("leaf").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("digest"))
    root = leaves.agg(F.array_join(F.array_sort(F.collect_list(F.concat("leaf", F.lit(":"), "digest"))), "\n").alias("lines")).first().lines
    return hashlib.sha256(root.encode()).hexdigest()[:16]


def numbered(rows: DataFrame) -> DataFrame:
    """rows of Parquet files with row_ord: the place in the file, after the rows of the files before it by name."""
    if len(rows.inputFiles()) <= 1:
        return rows.select("*", F.col("_metadata.row_index").alias("row_ord"))
    at = rows.select("*", F.col("_metadata.row_index").alias("__at"), F.col("_metadata.file_path").alias("__file"))
    # a row a file
    sizes = rows.groupBy(F.col("_metadata.file_path").alias("__file")).agg(F.count("*").alias("__n"))
    before = sizes.select("__file", (F.sum("__n").over(W.orderBy("__file")) - F.col("__n")).alias("__before"))
    return at.join(F.broadcast(before), "__file").withColumn("row_ord", F.col("__at") + F.col("__before")).drop("__at", "__file", "__before")


def with_row_index(spark: SparkSession, path: str) -> DataFrame:
    """A raw library with row_ord: the place of each row in the library."""
    rows = spark.read.parquet(path)
    at = numbered(rows)
    for name, kind in _RAW.items():
        if name not in at.columns:
            at = at.withColumn(name, F.lit(None).cast(kind))
    own = "molecule_id" in rows.columns
    return complete(at) if own else complete(at).drop("molecule_id", "spectrum_id")


def read_spectra(spark: SparkSession, path: str) -> DataFrame:
    """Spectra to predict: molecule_id must be there and never null."""
    rows = spark.read.parquet(path)
    if "molecule_id" not in rows.columns:
        raise ValueError("the input has no column molecule_id")
    if not rows.where("molecule_id is null").limit(1).isEmpty():
        raise ValueError("molecule_id must not be null")
    return complete(numbered(rows))


def from_mappings(spark: SparkSession, spectra: Iterable[Mapping], molecule_id: str) -> DataFrame:
    """Spectra of one molecule given as mappings; unknown keys, and so labels, are ignored."""
    names = [p.split()[0] for p in SPECTRUM.split(", ")]
    rows = []
    for k, s in enumerate(spectra):
        row = [s.get(n) for n in names]
        row[0] = molecule_id
        for i in (2, 8):
            row[i] = None if row[i] is None else float(row[i])
        for i in (5, 6, 7):
            row[i] = None if row[i] is None else [float("nan") if v is None else float(v) for v in row[i]]
        rows.append((*row, k))
    return spark.createDataFrame(rows, SPECTRUM + ", row_ord long")


def read_split(spark: SparkSession, prepared: str, split: str, max_molecules: int | None = None) -> DataFrame:
    """One split of a prepared data set (only its partition is read); at most so many molecules, by bucket and id."""
    rows = spark.read.parquet(f"{prepared}/spectra").where(F.col("split") == split)
    if max_molecules is not None:
        ids = rows.select("bucket", "molecule_id").distinct().orderBy("bucket", "molecule_id").limit(max_molecules)
        rows = rows.join(ids.select("molecule_id"), "molecule_id", "left_semi")
    return rows


def require_new_dir(path: str) -> None:
    if os.path.exists(path) and (not os.path.isdir(path) or os.listdir(path)):
        raise ValueError(f"{path} exists and is not empty")


def require_new_file(path: str) -> None:
    if os.path.exists(path):
        raise FileExistsError(path)


def require_other(source: str, target: str) -> None:
    if os.path.realpath(source) == os.path.realpath(target):
        raise ValueError("output and input are the same file")


def write_json(path: str, data) -> None:
    """Pretty UTF-8 JSON; NaN and infinities are errors."""
    text = json.dumps(data, ensure_ascii=False, indent=2, allow_nan=False)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text + "\n")


def read_json(path: str):
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_jsonl(rows: DataFrame, path: str, overwrite: bool = True) -> int:
    """One local JSON line a row, streamed partition by partition in the order of rows."""
    if not overwrite:
        require_new_file(path)
    n = 0
    with open(path, "w" if overwrite else "x", encoding="utf-8") as f:
        for (line,) in rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).toLocalIterator():
            f.write(line + "\n")
            f.flush()
            n += 1
    return n


def write_lines(rows: Iterable[Mapping], path: str) -> int:
    """One JSON line a mapping into a new file; NaN and infinities are errors."""
    n = 0
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "x", encoding="utf-8") as f:
        for row in rows:
            f.write(json.dumps(row, ensure_ascii=False, allow_nan=False) + "\n")
            n += 1
    return n


def write_json_table(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The distributed form of write_jsonl: a folder of JSON lines files."""
    rows.write.mode(mode).json(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def resume(rows: DataFrame, done: DataFrame, key: str = "molecule_id") -> DataFrame:
    """What of rows is not done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def write_shards(rows: DataFrame, path: str, key: str, size: int) -> None:
    """Consecutive keys in shards of size: a shard is whole in one file, a file holds a task's shards in order.

    A folder a shard would cost a listing and several small reads each; one shard
    is read by its number, which the statistics of sorted row groups narrow down.
    """
    places = ranks.numbered(rows.select(key).distinct(), key)
    n = places.select(key, F.floor(F.col("place") / size).cast("int").alias("shard"))
    rows.join(n, key).repartition("shard").sortWithinPartitions("shard", key).write.parquet(path)


def shard_faults(shards: DataFrame, expected: DataFrame, key: str, size: int | None = None) -> dict[str, int]:
    """How many keys are missing, unknown, or in several shards, and shards out of order or of another size; all 0 is well."""
    # shards are read once
    keys = tables.materialize(shards.select(key, "shard").distinct(), "shards")
    wanted = expected.select(key).distinct().withColumn("__wanted", F.lit(True))
    by = keys.groupBy("shard").agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
    # a row a shard
    last = W.orderBy("shard")
    order = by.withColumn("before", F.lag("high").over(last)).withColumn("next", F.lead("shard").over(last))
    wrong = F.lit(False) if size is None else F.when(F.col("next").isNull(), F.col("n") > size).otherwise(F.col("n") != size)
    odd = order.agg(F.count_if(F.col("before") >= F.col("low")).alias("order"), F.count_if(wrong).alias("size")).first()
    both = keys.groupBy(key).agg(F.count("*").alias("n")).join(wanted, key, "full")
    found = both.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("__wanted").isNull()).alias("unknown"), F.count_if(F.col("n") > 1).alias("in_several")).first()
    return found.asDict() | {"out_of_order": odd["order"], "other_size": odd["size"]}


def merge_shards(spark: SparkSession, path: str, output: str, key: str, expected: DataFrame, size: int | None = None) -> DataFrame:
    """Rows of all shards as one table in the order of keys, once they are whole; else an error says what is wrong."""
    shards = spark.read.parquet(path)
    if any((faults := shard_faults(shards, expected, key, size)).values()):
        raise ValueError(f"shards at {path}: {', '.join(f'{n} {k}' for k, n in faults.items() if n)}")
    merged = shards.drop("shard").repartitionByRange(key).sortWithinPartitions(key)
    merged.write.mode("overwrite").parquet(output)
    return spark.read.schema(merged.schema).parquet(output)
