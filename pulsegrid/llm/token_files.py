"""Token-ID files: flat unsigned integers beside 64-bit document offsets, and their reader."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import exclusive_offsets, fresh_path, materialize, partitions
from .tokens import encoder, tokenizer_path

MANIFEST = "file string, width long, nulls long, docs long, tokens long"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def _write(uri: str, parts: list[bytes]) -> None:
    store, path = _store(uri)
    with store.open_output_stream(path) as out:
        for part in parts:
            out.write(part)


def _read(uri: str, dtype: str) -> np.ndarray:
    """Memory-mapped where the store is a file system of this machine, else read."""
    store, path = _store(uri)
    if store.type_name == "local":
        return np.memmap(path, dtype=dtype, mode="r") if store.get_file_info(path).size else np.empty(0, dtype)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def write_token_files(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", kind: str = "word", end_id: int = 1, tokens_per_file: int = 2_000_000) -> DataFrame:
    """Encodes every text and writes the ids in ascending key order; returns the manifest, one row for each file, with `base`.

    Rows are range-partitioned by key (equal keys in order of their texts' crc32), sorted and encoded. A task closes a file at the
    document that brings it to tokens_per_file: <file>.ids, the ids of all its documents one after the other, each document ended by
    end_id, as little-endian unsigned integers of `width` bytes (2 if the whole vocabulary fits, else 4); <file>.offsets, for each document where its ids end in the file, as unsigned 64-bit integers; <file>.keys,
    the keys as signed 64-bit integers. A file's `base`, the ids of all documents before it, is a prefix sum over the
    manifest. Names hold a random part, so that the files of a failed attempt are never taken for others; the manifest
    names those that count. Null texts are empty; null keys come first (`nulls` counts them); an empty table has no files.
    """
    spark = df.sparkSession
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        code = encoder(tokenizer_path(tokenizer), kind)
        width = 2 if max(end_id + 1, code.tokenizer.get_vocab_size(with_added_tokens=True)) <= 1 << 16 else 4
        end = np.array([end_id], f"<u{width}").tobytes()
        keys: list[int | None] = []
        ids: list[bytes] = []
        total = 0

        def close() -> pa.RecordBatch:
            nonlocal n, total
            ends = np.cumsum([len(x) // width for x in ids])
            name = f"{folder}/part-{part:06d}-{n:06d}-{uuid.uuid4().hex}"
            _write(f"{name}.ids", ids)
            _write(f"{name}.offsets", [ends.astype("<u8").tobytes()])
            _write(f"{name}.keys", [np.array([k or 0 for k in keys], "<i8").tobytes()])
            row = {"file": name, "width": width, "nulls": keys.count(None), "docs": len(ids), "tokens": int(ends[-1]), "part": part, "n": n}
            n, total = n + 1, 0
            keys.clear()
            ids.clear()
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):  # Arrow keeps ids beside nulls whole
                made = code.ids_of(t.as_py())
                ids.append((np.frombuffer(made, "<u4").astype("<u2").tobytes() if width == 2 else made) + end)
                keys.append(k)
                total += len(ids[-1]) // width
                if total >= tokens_per_file:
                    yield close()
        if ids:
            yield close()

    rows = df.select(F.col(key).cast("long").alias(key), text)
    tie = F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
    dealt = rows.repartitionByRange(F.col(key).asc_nulls_first(), tie).sortWithinPartitions(F.col(key).asc_nulls_first(), tie)
    made = materialize(dealt.mapInArrow(write, MANIFEST + ", part long, n long"), "manifest")
    return exclusive_offsets(made.withColumn("at", F.shiftleft("part", 20) + F.col("n")), [], "at", "tokens").drop("part", "n")


def read_token_files(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each document: key, start (ids of all documents before it), n_tokens, ids_crc32 of its ids as unsigned 32-bit integers."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for f in files.itertuples(index=False):
                ids, ends, keys = _read(f"{f.file}.ids", f"<u{f.width}"), _read(f"{f.file}.offsets", "<u8").astype("int64"), _read(f"{f.file}.keys", "<i8")
                starts = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(starts, ends)]
                named = pd.Series(keys, dtype="Int64")
                named[: f.nulls] = pd.NA
                yield pd.DataFrame({key: named, "start": f.base + starts, "n_tokens": ends - starts, "ids_crc32": crc})

    files = manifest.repartition(partitions(manifest.sparkSession))  # dealt in turn to a stated number of tasks, which stay apart
    return files.mapInPandas(read, f"{key} long, start long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, **options) -> DataFrame:
    """Writes df's texts to a new folder of the shared store and reads the documents back from the files."""
    spark: SparkSession = df.sparkSession
    return read_token_files(write_token_files(df, fresh_path(spark, "tokens"), **options))
