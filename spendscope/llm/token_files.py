"""Token ids as Arrow files of equal-length sequences and masks, with random access and no copying.

Documents are range-partitioned and sorted by doc_id. Each task streams its documents' ids, an end id after
each, into one Arrow file: record batches of two fixed-size-list columns, ``input_ids`` and ``mask``. The last
sequence of a file is filled up with id 0 where the mask is false. Beside it lies a file that names each
document's place. The files of successful tasks are those listed by the manifest; a task that runs again
writes under another name, so an executor's loss leaves no half file in the result.

Defined cases: null and empty texts hold the end id alone; rows with the same doc_id follow each other, ordered by
text; a null doc_id comes first; an empty table gives no file; other columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendscope.llm import tokens
from spendscope.llm.common import batch, settle, texts, workspace_path

SEQUENCE = 2048
END_ID = 2
#: Sequences of one record batch: 1 MB at two bytes an id.
BATCH_SEQUENCES = 256

_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_PART = pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
PART = "part long, path string, n_docs long, n_ids long"
_ROW = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "n_tokens", "ids_crc32")])
ROW = "doc_id long, start long, n_tokens long, ids_crc32 long"


def file_schema(sequence: int = SEQUENCE, id_type: pa.DataType = pa.uint16()) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(id_type, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


def _filesystem(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class SequenceWriter:
    """Streams ids into one Arrow file; holds at most one batch of sequences."""

    def __init__(self, sink, sequence: int, id_type: pa.DataType):
        self.sequence, self.schema = sequence, file_schema(sequence, id_type)
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.kept: list[np.ndarray] = []
        self.waiting = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.kept.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        while self.waiting >= self.sequence * BATCH_SEQUENCES:
            joined = np.concatenate(self.kept)
            cut = len(joined) - len(joined) % (self.sequence * BATCH_SEQUENCES)
            for at in range(0, cut, self.sequence * BATCH_SEQUENCES):
                self._write(joined[at : at + self.sequence * BATCH_SEQUENCES])
            self.kept, self.waiting = [joined[cut:]], len(joined) - cut

    def _write(self, ids: np.ndarray, real: int | None = None) -> None:
        mask = np.arange(len(ids)) < (len(ids) if real is None else real)
        columns = (pa.array(ids.astype(self.schema.field(0).type.value_type.to_pandas_dtype())), pa.array(mask))
        lists = [pa.FixedSizeListArray.from_arrays(c, self.sequence) for c in columns]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            ids = np.concatenate(self.kept)
            self._write(np.pad(ids, (0, -len(ids) % self.sequence)), len(ids))
        self.writer.close()


class SequenceReader:
    """Random access to the sequences of one file; a local file is mapped, so ids are views of it."""

    def __init__(self, path: str):
        from pyarrow import fs

        files, inner = _filesystem(path)
        self.source = pa.memory_map(inner) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(inner)
        self.file = pa.ipc.open_file(self.source)
        self.sequence_length = self.file.schema.field("input_ids").type.list_size
        self.last: tuple[int, pa.RecordBatch] | None = None

    def _batch(self, k: int) -> pa.RecordBatch:
        if self.last is None or self.last[0] != k:
            self.last = (k, self.file.get_batch(k))
        return self.last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        k, row = divmod(i, BATCH_SEQUENCES)
        b = self._batch(k)
        return b.column(0).slice(row, 1).flatten().to_numpy(), b.column(1).slice(row, 1).flatten()

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids at a place of the file, across its sequences."""
        span, parts = BATCH_SEQUENCES * self.sequence_length, []
        while n:
            k, at = divmod(start, span)
            parts.append(self._batch(k).column(0).flatten()[at : at + n].to_numpy())
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_token_files(docs: DataFrame, folder: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Write the files; returns the manifest, one row per file, in doc_id order by ``part``."""
    folder = folder or workspace_path(docs.sparkSession, "token-files")
    tail = int(end_id).to_bytes(4, "little")

    def write(batches):
        encoder = tokens.encoder()
        id_type = pa.uint16() if encoder.tokenizer.get_vocab_size() <= 1 << 16 else pa.uint32()
        part = TaskContext.get().partitionId()
        path = f"{folder.rstrip('/')}/part-{part:06d}-{uuid.uuid4().hex}"
        files, inner = _filesystem(path)
        sink = index = None
        n_docs = 0
        for b in batches:
            if not b.num_rows:
                continue
            if sink is None:
                files.create_dir(inner.rpartition("/")[0], recursive=True)
                sink, index = files.open_output_stream(f"{inner}.arrow"), files.open_output_stream(f"{inner}.docs.arrow")
                writer, places = SequenceWriter(sink, sequence, id_type), pa.ipc.new_file(index, _INDEX)
            rows: dict[str, list] = {x: [] for x in _INDEX.names}
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(encoder.ids(text) + tail, "<u4")
                for name, value in zip(rows, (doc_id, writer.total, len(ids))):
                    rows[name].append(value)
                writer.add(ids)
            places.write_batch(batch(rows, _INDEX))
            n_docs += b.num_rows
        if sink is not None:
            for x in (writer, sink, places, index):
                x.close()
            yield batch({"part": [part], "path": [path], "n_docs": [n_docs], "n_ids": [writer.total]}, _PART)

    ordered = texts(docs).repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    return settle(ordered.mapInArrow(write, PART), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: its place among all ids, its length and the checksum of its ids."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches):
        for b in batches:
            for path, offset in zip(b.column("path").to_pylist(), b.column("before").to_pylist()):
                files, inner = _filesystem(path)
                reader = SequenceReader(f"{path}.arrow")
                with files.open_input_file(f"{inner}.docs.arrow") as source:
                    index = pa.ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        rows = index.get_batch(k).to_pydict()
                        rows["ids_crc32"] = [tokens.crc32(reader.ids(s, n).astype("<u4").tobytes()) for s, n in zip(rows["start"], rows["n_tokens"])]
                        rows["start"] = [offset + s for s in rows["start"]]
                        yield batch(rows, _ROW)

    files = max(1, manifest.count())
    return placed.repartition(files).mapInArrow(read, ROW)
