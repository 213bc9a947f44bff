"""Operator 1: token ids in Arrow files of fixed-size-list batches.

The ids of all documents, each with an end id, form one stream in ascending order of doc_id. Range-partitioned tasks encode and
write their part of it: one Arrow IPC file a task, whose batches hold `ids` (fixed_size_list of the smallest unsigned type that
holds the vocabulary), `valid` (false on the padding that fills a file's last sequence) and `doc_start` (true on the first id of
a document). A sidecar file lists the documents. Files are written under a fresh name and renamed, and only files named by
finished tasks are read, so lost executors leave no half-written part. A sequence is found by its number alone: number div the
batch length is the batch, the rest the row, and its buffers are used as they lie in the file.

Cases: null text counts as empty and gives the end id alone; an empty table gives no file and no row; rows with the same doc_id
follow each other in the order of their text; columns other than doc_id and text are not looked at. A text is encoded whole.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import byte_blocks, cut, fresh_path

SEQUENCE = 2048
#: Sequences in a record batch.
BATCH = 256

MANIFEST = "file string, sidecar string, first_doc long, first_hash long, n_docs long, n_tokens long, n_sequences long"
READ_BACK = "doc_id long, start long, n_tokens long, ids_crc32 long, first_sequence long, file string"


def file_system(uri: str):
    """pyarrow's file system for a URI or a plain path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class SequenceWriter:
    """Cuts a stream of ids into equal sequences and writes them batch by batch; holds one batch."""

    def __init__(self, sink, dtype: str, length: int):
        import numpy as np
        import pyarrow as pa

        self.np, self.pa, self.dtype, self.length = np, pa, np.dtype(dtype), length
        self.schema = pa.schema([
            ("ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)),
            ("valid", pa.list_(pa.bool_(), length)),
            ("doc_start", pa.list_(pa.bool_(), length)),
        ])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.parts, self.starts, self.held, self.n_sequences = [], [], 0, 0

    def add(self, ids, firsts) -> None:
        """ids of documents, one after the other, and the place of each one's first."""
        self.starts.append(firsts + self.held)
        self.parts.append(ids.astype(self.dtype))
        self.held += len(ids)
        if self.held >= self.length * BATCH:
            self.flush(self.held // self.length // BATCH * BATCH)

    def flush(self, n: int, last: bool = False) -> None:
        np, pa, size = self.np, self.pa, self.length
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, self.dtype)
        at = np.concatenate(self.starts) if self.starts else np.zeros(0, np.int64)
        marks = np.zeros(max(len(ids), n * size), dtype=bool)
        marks[at] = True
        valid = np.arange(n * size) < len(ids)
        full = np.zeros(n * size, self.dtype)
        full[: len(ids)] = ids[: n * size]
        for k in range(0, n, BATCH):
            cols = [full[k * size : (k + BATCH) * size], valid[k * size : (k + BATCH) * size], marks[k * size : min(n, k + BATCH) * size]]
            self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(c), size) for c in cols], schema=self.schema))
        self.n_sequences += n
        self.parts, self.starts = [ids[n * size :]], [at[at >= n * size] - n * size]
        self.held = max(0, len(ids) - n * size)

    def close(self) -> None:
        self.flush(-(-self.held // self.length))
        self.out.close()


class SequenceFile:
    """Random access to one file: sequences and masks as views of its buffers."""

    def __init__(self, uri: str):
        import pyarrow as pa

        fs, path = file_system(uri)
        local = fs.type_name == "local"
        self.reader = pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))
        self.length = self.reader.schema.field("ids").type.list_size
        self.kept = (-1, None)

    def batch(self, k: int):
        if self.kept[0] != k:
            self.kept = (k, self.reader.get_batch(k))
        return self.kept[1]

    def flat(self, k: int):
        return self.batch(k).column("ids").flatten().to_numpy()

    def sequence(self, number: int):
        """ids, valid and doc_start of one sequence."""
        batch, row = self.batch(number // BATCH), number % BATCH
        cut_out = lambda name: batch.column(name).slice(row, 1).flatten()
        return cut_out("ids").to_numpy(), cut_out("valid"), cut_out("doc_start")

    def ids(self, start: int, n: int):
        """n ids from a place in the file's stream."""
        import numpy as np

        size, found = self.length * BATCH, []
        while n > 0:
            k, at = divmod(start, size)
            found.append(self.flat(k)[at : at + n])
            start, n = start + len(found[-1]), n - len(found[-1])
        return np.concatenate(found) if found else np.zeros(0, np.uint32)


def write_sequences(docs: DataFrame, vocabulary: str, end_id: int = tokens.END_ID, sequence: int = SEQUENCE, dtype: str = "uint16") -> DataFrame:
    """Writes the files; returns the manifest, a row a file."""
    target = fresh_path(docs.sparkSession, "token-files")

    def write(batches):
        import numpy as np
        import pyarrow as pa

        encoder, most = tokens.encoder(vocabulary), np.iinfo(dtype).max
        writer, first, n_docs, total = None, None, 0, 0
        fs, folder = file_system(target)
        name = f"{folder}/{uuid.uuid4().hex}"
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        for batch in byte_blocks(batches):
            if writer is None:
                fs.create_dir(folder, recursive=True)
                first = batch["doc_id"][0].as_py(), batch["_hash"][0].as_py()
                sink, index_sink = fs.open_output_stream(f"{name}.part"), fs.open_output_stream(f"{name}.index.part")
                writer, index = SequenceWriter(sink, dtype, sequence), pa.ipc.new_file(index_sink, schema)
            ids, at = encoder.encode_all(batch["text"], end_id)
            if ids.max() > most:
                raise ValueError(f"an id does not fit {dtype}")
            writer.add(ids, at[:-1])
            index.write_batch(pa.record_batch([batch["doc_id"], pa.array(total + at[:-1]), pa.array(np.diff(at))], schema=schema))
            n_docs, total = n_docs + batch.num_rows, total + len(ids)
        if writer is None:
            return
        for out in (writer, sink, index, index_sink):
            out.close()
        fs.move(f"{name}.index.part", f"{name}.index.arrow")
        fs.move(f"{name}.part", f"{name}.arrow")
        uri = target + name[len(folder):]
        yield pa.record_batch([[f"{uri}.arrow"], [f"{uri}.index.arrow"], pa.array([first[0]], pa.int64()), pa.array([first[1]], pa.int64()), [n_docs], [total], [writer.n_sequences]], names=[x.split()[0] for x in MANIFEST.split(", ")])

    ordered = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_hash")).repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text")
    return cut(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Ids and sequences before each file. The window holds a row a file, not a row a document."""
    before = Window.orderBy(F.col("first_doc").asc_nulls_first(), "first_hash").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumns({"base": F.coalesce(F.sum("n_tokens").over(before), F.lit(0)), "base_sequence": F.coalesce(F.sum("n_sequences").over(before), F.lit(0))})


def read_documents(manifest: DataFrame) -> DataFrame:
    """Reads the files back: a row a document, with the crc of its ids as little-endian unsigned 32-bit integers."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                file = SequenceFile(row["file"])
                fs, path = file_system(row["sidecar"])
                index = pa.ipc.open_file(fs.open_input_file(path))
                for k in range(index.num_record_batches):
                    part = index.get_batch(k)
                    starts, sizes = part["start"].to_pylist(), part["n_tokens"].to_pylist()
                    crcs = [zlib.crc32(file.ids(s, n).astype("<u4").tobytes()) for s, n in zip(starts, sizes)]
                    yield pa.record_batch([part["doc_id"], pa.array([row["base"] + s for s in starts], pa.int64()), part["n_tokens"], pa.array(crcs, pa.int64()), pa.array([row["base_sequence"] + s // file.length for s in starts], pa.int64()), [row["file"]] * len(starts)], names=[x.split()[0] for x in READ_BACK.split(", ")])

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_starts(manifest).repartition(tasks, "file").mapInArrow(read, READ_BACK)


def token_files(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Writes every text and returns what the files say of each document."""
    return read_documents(write_sequences(docs, vocabulary, **options))
