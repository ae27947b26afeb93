"""Flat unsigned token-id files with 64-bit document offsets.

A part of the output is three flat files: `<stem>.ids` (unsigned 16-bit ids when the vocabulary fits, else
32-bit, little-endian), `<stem>.off` (n + 1 64-bit offsets, counted in ids from the start of the part) and
`<stem>.doc` (n 64-bit document ids).  Parts follow each other in ascending doc_id order; the manifest holds the
part's base, the prefix sum of the ids of all parts before it.

Rows: a null text is an empty one (its only id is the end id); null doc_ids come first, and rows of one doc_id lie in the order of their texts' CRC-32; repeated
rows are written each; an empty table gives no part.  Other columns are ignored.
Recovery: a try of a task writes under its own random name, and only names that a finished task returned reach
the manifest.  A rerun writes new files; nothing reads the remains of a lost try.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, fresh_dir, small_batches
from .encoders import encoder

PART_SCHEMA = "part int, stem string, n_null long, n_docs long, n_ids long"
ROW_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _writer(folder: str, tokenizer: str, end_id: int, kind: str):
    def write(batches):
        import numpy as np
        import pyarrow as pa

        part, stem = TaskContext.get().partitionId(), None
        offsets, n_null, ids_file = [np.zeros(1, np.int64)], 0, None
        fs, root = filesystem(folder)
        doc_file = None
        for batch in small_batches(batches):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            if not texts:
                continue
            if stem is None:
                stem = f"part-{part:06d}-{uuid.uuid4().hex}"
                ids_file, doc_file = (fs.open_output_stream(f"{root}/{stem}.{x}") for x in ("ids", "doc"))
            keys = batch.column("doc_id")
            n_null += keys.null_count
            doc_file.write(keys.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            for ids, sizes in encoder(tokenizer).slices(texts):
                ends = np.cumsum(sizes + 1)
                flat = np.full(int(ends[-1]), end_id, kind)
                flat[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
                ids_file.write(flat.tobytes())
                offsets.append(offsets[-1][-1] + ends)
        if stem is not None:
            ids_file.close()
            doc_file.close()
            with fs.open_output_stream(f"{root}/{stem}.off") as f:
                offsets = np.concatenate(offsets)
                f.write(offsets.astype("<i8").tobytes())
            yield pa.RecordBatch.from_pylist([{"part": part, "stem": stem, "n_null": n_null,
                                              "n_docs": len(offsets) - 1, "n_ids": int(offsets[-1])}],
                                            schema=pa.schema([("part", pa.int32()), ("stem", pa.string()), ("n_null", pa.int64()),
                                                              ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> list[dict]:
    """Encode all documents and write them in ascending doc_id order; returns the manifest, one entry a part.

    The manifest has an entry for each partition of the shuffle, so its length does not follow the rows.
    """
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    kind = "<u2" if max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    digest = F.crc32(F.col("text").cast("binary")).alias("digest")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest).repartitionByRange("doc_id", "digest")
    parts = ordered.sortWithinPartitions("doc_id", "digest", "text").select("doc_id", "text").mapInArrow(_writer(folder, tokenizer, end_id, kind), PART_SCHEMA)
    manifest, base = [], 0
    for row in sorted(parts.collect(), key=lambda r: r.part):
        manifest.append({**row.asDict(), "folder": folder, "kind": kind, "base": base})
        base += row.n_ids
    return manifest


def memory_map(uri: str, kind: str):
    """A flat file as an array: mapped where the folder is mounted, else read from its store."""
    import numpy as np
    from pyarrow import fs as pafs

    fs, path = filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, kind, mode="r") if fs.get_file_info(path).size else np.empty(0, kind)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_document(manifest: list[dict], index: int):
    """Ids of the document at a position in the whole output, without reading the others."""
    for entry in manifest:
        if index < entry["n_docs"]:
            at = memory_map(f"{entry['folder']}/{entry['stem']}.off", "<i8")
            return memory_map(f"{entry['folder']}/{entry['stem']}.ids", entry["kind"])[at[index]:at[index + 1]]
        index -= entry["n_docs"]
    raise IndexError(index)


def _reader(batches):
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for entry in batch.to_pylist():
            stem = f"{entry['folder']}/{entry['stem']}"
            at, ids, keys = (memory_map(f"{stem}.{x}", k) for x, k in (("off", "<i8"), ("ids", entry["kind"]), ("doc", "<i8")))
            if len(at) != entry["n_docs"] + 1 or at[-1] != len(ids) or len(keys) != entry["n_docs"]:
                raise ValueError(f"{stem}: lengths do not agree with the manifest")
            for a in range(0, len(keys), 20_000):
                b = min(a + 20_000, len(keys))
                crcs = [zlib.crc32(ids[at[i]:at[i + 1]].astype("<u4").tobytes()) for i in range(a, b)]
                null = np.arange(a, b) < entry["n_null"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[a:b].astype("i8"), mask=null), pa.array(entry["base"] + at[a:b].astype("i8")),
                     pa.array(np.diff(at[a:b + 1]).astype("i8")), pa.array(crcs, pa.int64())], schema=schema)


def read_token_files(spark, manifest: list[dict]) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    schema = PART_SCHEMA + ", folder string, kind string, base long"
    parts = spark.createDataFrame([tuple(e[k.split()[0]] for k in schema.split(", ")) for e in manifest], schema)
    return parts.repartition(max(1, len(manifest))).mapInArrow(_reader, ROW_SCHEMA)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write the files and read them back, one row per document."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, folder or fresh_dir(spark, "tokens"), tokenizer, end_id))
