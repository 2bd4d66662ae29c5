"""Token ids in binary files of independent zstandard frames (operator 7).

A file is a row of zstandard frames, a skippable frame with the documents' ids and lengths, and a skippable frame with the
seek table of the public seekable format: for each frame its compressed size, its size and the low half of its XXH64. A frame
holds whole documents, FRAME_IDS ids or one longer document; a reader decompresses the frames of the documents asked for and
no other, and compares each with its checksum.

Documents are dealt by ranges of their id, one file a range, so files in order hold ids in ascending order (null first; equal
ids by a hash of the text). A file has a new name for each attempt of its task and counts only once it is in the manifest, so a lost
executor leaves at most a stray file. There are more files where the corpus is larger. Null and '' have the end id alone; a very long text is a frame of its own.
Ids that are no whole numbers are an error. An empty table gives files without documents or
none. Repeated rows are all written; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, shared_dir, text_runs, worker_state, written
from .tokens import TAIL, encode_pieces

# Fixed values of the public seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC, HAS_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: Ids of a frame, at least, unless the file ends.
FRAME_IDS = 65_536
NO_ID = -(1 << 63)
#: Rows of a file, at most but for rows of equal id and text.
FILE_ROWS = 1_000_000
#: Words that are encoded as one text.
JOINED = 2_000
#: Pieces that a worker remembers.
REMEMBERED = 1_500_000
#: Marks at the ends of words that are encoded apart, but those in a special string of the vocabulary, which would be torn.
MARKS = TAIL + "#$%&*"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class TokenWriter:
    def __init__(self, sink, level: int = 3):
        self.sink, self.compress = sink, zstandard.ZstdCompressor(level=level).compress
        self.doc_ids: list[int] = []
        self.sizes: list[int] = []
        self.frames: list[tuple[int, int, int, int]] = []
        self.waiting: list[bytes] = []
        self.waiting_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        self.doc_ids.append(NO_ID if doc_id is None else doc_id)
        self.sizes.append(len(ids) // 4)
        self.waiting.append(ids)
        self.waiting_ids += len(ids) // 4
        if self.waiting_ids >= FRAME_IDS:
            self._frame()

    def _frame(self) -> None:
        if self.waiting:
            data = b"".join(self.waiting)
            packed = self.compress(data)
            self.sink.write(packed)
            self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF, len(self.waiting)))
            self.waiting, self.waiting_ids = [], 0

    def close(self) -> None:
        self._frame()
        index = self.compress(np.array(self.doc_ids, "<i8").tobytes() + np.array(self.sizes, "<u4").tobytes() + np.array([f[3] for f in self.frames], "<u4").tobytes())
        self.sink.write(struct.pack("<IIQ", SKIPPABLE_INDEX, len(index) + 8, len(self.sizes)) + index)
        table = b"".join(struct.pack("<III", *f[:3]) for f in self.frames) + struct.pack("<IBI", len(self.frames), HAS_CHECKSUMS, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class TokenReader:
    """Of a seekable file; reads the tables at its end first."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, end - 9))
        if magic != SEEK_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("not a token file")
        seek = end - 9 - 12 * n
        self.packed, self.plain, self.sums = np.frombuffer(source.read_at(12 * n, seek), "<u4").reshape(n, 3).T.astype(np.int64)
        self.at = np.append(0, np.cumsum(self.packed))
        start = int(self.at[-1])
        kind, size, docs = struct.unpack("<IIQ", source.read_at(16, start))
        index = zstandard.ZstdDecompressor().decompress(source.read_at(size - 8, start + 16))
        if kind != SKIPPABLE_INDEX or start + 8 + size != seek - 8:
            raise ValueError("the tables of the token file do not fit together")
        self.doc_ids = np.frombuffer(index, "<i8", docs)
        self.sizes = np.frombuffer(index, "<u4", docs, 8 * docs).astype(np.int64)
        self.first_doc = np.append(0, np.cumsum(np.frombuffer(index, "<u4", n, 12 * docs).astype(np.int64)))
        self.first_id = np.append(0, np.cumsum(self.sizes))

    def frame(self, k: int) -> bytes:
        data = zstandard.ZstdDecompressor().decompress(self.source.read_at(int(self.packed[k]), int(self.at[k])), max_output_size=int(self.plain[k]))
        if len(data) != self.plain[k] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} does not have its checksum")
        return data

    def documents(self, positions: Iterable[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(position, ids) of the documents at these ascending positions (None: all); other frames stay packed."""
        at, data = -1, b""
        places = np.arange(len(self.sizes)) if positions is None else np.fromiter(positions, np.int64)
        frames = np.searchsorted(self.first_doc, places, "right") - 1
        lows = 4 * (self.first_id[places] - self.first_id[self.first_doc[frames]])
        for p, k, low, size in zip(places.tolist(), frames.tolist(), lows.tolist(), (4 * self.sizes[places]).tolist(), strict=True):
            if k != at:
                at, data = k, self.frame(k)
            yield p, data[low : low + size]


class LibraryEncoder:
    """Ids by the tokenizers library; pieces between spaces are remembered."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(path), {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        special = {i: len(t.content.encode("utf-8")) for i, t in added.items()}
        self.marks = "".join(m for m in MARKS if not any(m in t.content for t in added.values()))
        #: the bytes that an id stands for; in a byte-level vocabulary each character of an entry is a byte
        self.id_bytes = np.zeros(1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values()), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.id_bytes[i] = special.get(i, len(token))

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def after_space(self, words: list[str]) -> list[bytes]:
        return self.side_by_side([" " + " ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)])

    def after_line(self, words: list[str]) -> list[bytes]:
        """Of words with a line end before each."""
        return self.side_by_side(["".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)])

    def side_by_side(self, runs: list[str]) -> list[bytes]:
        """Words are encoded side by side in one text, as they may stand in one, each after the text's first character; the bytes of the ids tell where each ends."""
        out: list[bytes] = []
        for run, ids in zip(runs, self._encode(runs), strict=True):
            raw = np.frombuffer(run.encode("utf-8"), np.uint8)
            ends = np.append(np.flatnonzero(raw == raw[0])[1:], len(raw))
            cuts = 4 * (np.searchsorted(np.cumsum(self.id_bytes[ids]), ends) + 1)
            data, cuts = ids.tobytes(), [0, *cuts.tolist()]
            out += [data[low:high] for low, high in pairwise(cuts)]
        return out

    def others(self, texts: list[str]) -> list[bytes]:
        return [x.tobytes() for x in self._encode(texts)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [b"".join(x) for x in encode_pieces(texts, self.memo, self.after_space, self.others, REMEMBERED, self.after_line, self.marks)]


MANIFEST = "part int, path string, n_docs long, n_tokens long"
ROWS = "part int, position long, doc_id long, start long, n_tokens long, ids binary"


def write_tokens(df: DataFrame, out_dir: str, path: str, end_id: int, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every row with the vocabulary file at ``path``, append ``end_id``, write files under ``out_dir``; gives the manifest (MANIFEST)."""
    spark = df.sparkSession
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // FILE_ROWS))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.repartitionByRange(files, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    end = np.array([end_id], "<u4").tobytes()

    def write(batches):
        forget("token_files")
        encoder = worker_state(("token_files", path), lambda: LibraryEncoder(path))
        part = TaskContext.get().partitionId()
        fs, folder = open_fs(out_dir)
        fs.create_dir(folder, recursive=True)
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tok"
        with fs.open_output_stream(name) as sink:
            writer = TokenWriter(sink)
            for batch in batches:
                for low, texts in text_runs(batch.column(1)):
                    for doc_id, ids in zip(batch.column(0).slice(low, len(texts)).to_pylist(), encoder(texts), strict=True):
                        writer.add(doc_id, ids + end)
            writer.close()
        uri = f"{out_dir.rstrip('/')}/{name.rsplit('/', 1)[1]}"
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [uri], "n_docs": [len(writer.sizes)], "n_tokens": [sum(writer.sizes)]})

    return written(dealt.mapInArrow(write, MANIFEST))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Every document of the files of ``manifest``: file, position in it, id, ids of all documents before it, ids with the end id."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = manifest.select("part", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start")).repartition(files)

    def read(batches):
        forget()
        for batch in batches:
            for row in batch.to_pylist():
                fs, name = open_fs(row["path"])
                with fs.open_input_file(name) as source:
                    reader, held, size = TokenReader(source), [], 0
                    for p, ids in reader.documents():
                        doc_id = int(reader.doc_ids[p])
                        held.append((row["part"], p, None if doc_id == NO_ID else doc_id, row["start"] + int(reader.first_id[p]), len(ids) // 4, ids))
                        size += len(ids)
                        if size > 4_000_000:
                            yield of(held)
                            held, size = [], 0
                    if held:
                        yield of(held)

    def of(rows):
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in ROWS.split(", ")])

    return placed.mapInArrow(read, ROWS)


def read_documents(manifest: DataFrame, doc_ids: list[int]) -> dict[int, list[int]]:
    """Ids of the asked-for documents alone; only their frames are decompressed."""
    wanted, out = np.array(sorted(doc_ids), np.int64), {}
    for row in manifest.orderBy("part").toLocalIterator():
        fs, name = open_fs(row["path"])
        with fs.open_input_file(name) as source:
            reader = TokenReader(source)
            hits = np.flatnonzero(np.isin(reader.doc_ids, wanted)).tolist()
            out |= {int(reader.doc_ids[p]): np.frombuffer(ids, "<u4").tolist() for p, ids in reader.documents(hits)}
    return out


def digests(df: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the ids of every row, as read back from files in the shared folder."""
    manifest = write_tokens(df, shared_dir(df.sparkSession), path, end_id)
    return read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
