"""Token ids of documents as flat binary files, in ascending document order, read back by memory map.

Documents are range-sorted by id; each range becomes one file of unsigned integers (16 bits where the vocabulary allows,
else 32), one of 64-bit offsets and one of document ids. A range's base, the ids in all ranges before it, is a prefix
sum over the ranges' sizes (one row a range). A task writes under a name of its own and then renames, so a task that
is run again after a lost executor replaces its file by the same bytes.

A null text is empty and gives the end id alone. Null ids come first. Rows that share an id are documents of their own, in
the order of their texts. An empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, new_path
from .encoding import encoder
from .words import slices

_MANIFEST = "part int, path string, bits int, n_docs long, n_tokens long"
_ROW = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _writer(tokenizer: str, end_id: int, folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, codes = TaskContext.get().partitionId(), encoder(tokenizer)
        store, root = fs.FileSystem.from_uri(folder)
        name, attempt = f"{root}/part-{part:06d}", uuid.uuid4().hex
        out: Any = None
        offsets, ids, valid, bits = [0], [], [], 32
        for whole in batches:
            for batch in slices(whole, "text"):
                if out is None:
                    bits = 16 if max(codes.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 32
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{name}.{attempt}.bin")
                for doc_id, encoded in zip(batch.column("doc_id").to_pylist(), codes.texts(batch.column("text").to_pylist()), strict=True):
                    tokens = np.frombuffer(encoded, np.uint32)
                    out.write(np.append(tokens, np.uint32(end_id)).astype(f"<u{bits // 8}").tobytes())
                    offsets.append(offsets[-1] + len(tokens) + 1)
                    ids.append(doc_id or 0)
                    valid.append(doc_id is not None)
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{name}.{attempt}.offsets") as f:
            f.write(np.asarray(offsets, "<i8").tobytes())
        with store.open_output_stream(f"{name}.{attempt}.docs") as f:
            f.write(np.asarray(ids, "<i8").tobytes() + np.asarray(valid, np.uint8).tobytes())
        for kind in ("bin", "offsets", "docs"):
            store.move(f"{name}.{attempt}.{kind}", f"{name}.{kind}")
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([f"{folder}/part-{part:06d}"]), pa.array([bits], pa.int32()), pa.array([len(ids)]), pa.array([offsets[-1]])], names=[x.split()[0] for x in _MANIFEST.split(", ")])

    return write


def write_token_files(df: DataFrame, tokenizer: str, end_id: int, folder: str, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and returns the manifest (part, path, bits, n_docs, n_tokens, base): base is the place of the file's first id in the whole stream."""
    spark = df.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(n, F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie", "text")
    manifest = materialize(dealt.select("doc_id", "text").mapInArrow(_writer(tokenizer, end_id, folder), _MANIFEST), "manifest")
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("base", F.coalesce(before, F.lit(0)))


def _map(store: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file as an array: mapped where the store is a local or mounted folder, else read."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            store, path = fs.FileSystem.from_uri(r["path"])
            tokens = _map(store, f"{path}.bin", f"<u{r['bits'] // 8}")
            offsets = _map(store, f"{path}.offsets", "<i8")
            docs = _map(store, f"{path}.docs", np.uint8)
            n = r["n_docs"]
            ids, valid = docs[: 8 * n].view("<i8"), docs[8 * n :].astype(bool)
            for a in range(0, n, 4096):
                b = min(n, a + 4096)
                crc = [zlib.crc32(tokens[offsets[i] : offsets[i + 1]].astype("<u4")) for i in range(a, b)]
                yield pa.record_batch([pa.array(np.asarray(ids[a:b]), pa.int64(), mask=~valid[a:b]), pa.array(offsets[a:b] + r["base"], pa.int64()), pa.array(np.diff(offsets[a : b + 1]), pa.int64()), pa.array(crc, pa.int64())], names=[x.split()[0] for x in _ROW.split(", ")])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone: start counts the ids of all documents before it."""
    files = manifest.select("part", "path", "bits", "n_docs", "base")
    n = max(manifest.sparkSession.sparkContext.defaultParallelism, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(n, "part").mapInArrow(_reader, _ROW)


def token_file_digest(df: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    return read_token_files(write_token_files(df, tokenizer, end_id, _uri(new_path(df.sparkSession, "tokens"))))


def _uri(path: str) -> str:
    return path if "://" in path else path.replace("file:", "file://") if path.startswith("file:") else f"file://{path}"
