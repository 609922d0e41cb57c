"""Token-id output: patched frame-of-reference blocks with an index of block starts.

A file holds the ids of many documents one after another, cut into blocks of 1024 ids. A block stores its minimum,
then each id less the minimum in as many bits as the 90th percentile of these differences needs; the ids that need
more are exceptions, listed with their places. The footer gives where each block starts and how long each document
is, so a reader can seek to a block.

Layout (little-endian): magic ``PWTB0001``; blocks, each ``count u16, width u8, exceptions u16, minimum u32``, the
packed 64-bit words, exception places u16 and values u32; block starts u64; document ids i64, null flags u8 and
lengths u64; then ``blocks u64, documents u64, ids u64, index start u64, documents start u64`` and the magic again.

Defined results: null or empty texts hold the end id alone; a text of any length is one document of any number of blocks;
rows with a null doc_id come first; rows that repeat a doc_id follow each other in order of a hash of their texts; an
empty table gives no file with documents and no rows. Columns other than the two named ones, whatever their names, are
not read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import read_table, work_path

BLOCK = 1024
PERCENTILE = 90
MAGIC = b"PWTB0001"
HEAD = struct.Struct("<HBHI")
FOOT = struct.Struct("<QQQQQ8s")
CHUNK_BLOCKS = 2048
FILES = "part int, file string, n_docs long, n_tokens long"


def pack_blocks(ids) -> list[bytes]:
    """Encode an array of unsigned 32-bit ids as blocks; the last may be short."""
    import numpy as np

    n = len(ids)
    if not n:
        return []
    rows = -(-n // BLOCK)
    table = np.empty(rows * BLOCK, np.uint32)
    table[:n] = ids
    table[n:] = ids[-1]
    table = table.reshape(rows, BLOCK)
    low = table.min(axis=1)
    rest = table - low[:, None]
    at = (BLOCK - 1) * PERCENTILE // 100
    widths = np.ceil(np.log2(np.partition(rest, at, axis=1)[:, at].astype(np.float64) + 1)).astype(np.int64)
    out: list[bytes] = [b""] * rows
    for width in np.unique(widths):
        width = int(width)
        chosen = np.flatnonzero(widths == width)
        part = rest[chosen]
        over = part >> np.uint32(width) != 0 if width < 32 else np.zeros(part.shape, bool)
        row, col = np.nonzero(over)
        cuts = np.searchsorted(row, np.arange(len(chosen) + 1))
        places, values = col.astype("<u2"), part[row, col].astype("<u4")
        words = _pack(part, width)
        for k, i in enumerate(chosen):
            a, b = cuts[k], cuts[k + 1]
            count = BLOCK if i < rows - 1 else n - (rows - 1) * BLOCK
            out[i] = HEAD.pack(count, width, b - a, int(low[i])) + words[k].tobytes() + places[a:b].tobytes() + values[a:b].tobytes()
    return out


def _pack(part, width: int):
    """The low ``width`` bits of each value, 64 values to ``width`` words."""
    import numpy as np

    lanes = np.ascontiguousarray((part & np.uint32((1 << width) - 1)).reshape(-1, 64).T).astype(np.uint64)
    words = np.zeros((width, lanes.shape[1]), np.uint64)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        words[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).reshape(len(part), -1).astype("<u8")


def unpack_blocks(blocks: list[bytes]):
    """The ids of whole blocks, one after another."""
    import numpy as np

    heads = [HEAD.unpack_from(b) for b in blocks]
    out = np.empty((len(blocks), BLOCK), np.uint32)
    by_width: dict[int, list[int]] = {}
    for i, (_, width, _, _) in enumerate(heads):
        by_width.setdefault(width, []).append(i)
    for width, chosen in by_width.items():
        size = width * BLOCK // 8
        packed = np.frombuffer(b"".join([blocks[i][HEAD.size : HEAD.size + size] for i in chosen]), "<u8")
        words = np.ascontiguousarray(packed.reshape(-1, width).T) if width else packed.reshape(0, 0)
        lanes = np.zeros((64, len(chosen) * BLOCK // 64), np.uint32)
        mask = np.uint64((1 << width) - 1)
        for k in range(64 if width else 0):
            word, shift = divmod(k * width, 64)
            value = words[word] >> np.uint64(shift)
            if shift + width > 64:
                value |= words[word + 1] << np.uint64(64 - shift)
            lanes[k] = value & mask
        part = np.ascontiguousarray(lanes.T).reshape(len(chosen), BLOCK)
        for k, i in enumerate(chosen):
            _, _, n, low = heads[i]
            if n:
                at = HEAD.size + size
                part[k, np.frombuffer(blocks[i], "<u2", n, at)] = np.frombuffer(blocks[i], "<u4", n, at + 2 * n)
            out[i] = part[k] + np.uint32(low)
    flat = out.reshape(-1)
    return flat[: (len(blocks) - 1) * BLOCK + heads[-1][0]] if blocks else flat


class BlockWriter:
    """Writes one file through an open binary stream, a bounded number of ids in memory at a time."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0
        self.starts: list[int] = []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.waiting: list[bytes] = []
        self.held = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.held += len(ids) // 4
        if self.held >= CHUNK_BLOCKS * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        import numpy as np

        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        cut = len(ids) if last else len(ids) // BLOCK * BLOCK
        for block in pack_blocks(ids[:cut]):
            self.starts.append(self.at)
            self._put(block)
        self.waiting, self.held = [ids[cut:].tobytes()], len(ids) - cut

    def close(self) -> tuple[int, int]:
        """Write what is left and the footer; gives the numbers of documents and of ids."""
        import numpy as np

        self._flush(True)
        index = self.at
        self._put(np.asarray(self.starts, "<u8").tobytes())
        docs = self.at
        self._put(np.asarray([i or 0 for i in self.ids], "<i8").tobytes())
        self._put(bytes(i is None for i in self.ids))
        self._put(np.asarray(self.lengths, "<u8").tobytes())
        total = sum(self.lengths)
        self._put(FOOT.pack(len(self.starts), len(self.ids), total, index, docs, MAGIC))
        return len(self.ids), total


def read_blocks(stream, size: int) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, number of ids before it in the file, its ids) of each document of a file."""
    import numpy as np

    def part(at: int, length: int) -> bytes:
        stream.seek(at)
        data = stream.read(length)
        if len(data) != length:
            raise ValueError("a token file ends early")
        return data

    blocks, n_docs, total, index, docs, magic = FOOT.unpack(part(size - FOOT.size, FOOT.size))
    if magic != MAGIC:
        raise ValueError("not a token file")
    starts = np.frombuffer(part(index, 8 * blocks), "<u8").astype(np.int64).tolist() + [index]
    table = part(docs, 17 * n_docs)
    doc_ids = np.frombuffer(table, "<i8", n_docs).tolist()
    nulls = table[8 * n_docs : 9 * n_docs]
    lengths = np.frombuffer(table, "<u8", n_docs, 9 * n_docs).tolist()
    buffer, have, block, start = [], 0, 0, 0
    for doc_id, null, length in zip(doc_ids, nulls, lengths):
        while have < length:
            last = min(blocks, block + CHUNK_BLOCKS)
            data = part(starts[block], starts[last] - starts[block])
            base = starts[block]
            ids = unpack_blocks([data[a - base : b - base] for a, b in zip(starts[block:last], starts[block + 1 : last + 1])])
            buffer.append(ids.astype("<u4").tobytes())
            have += len(ids)
            block = last
        joined = buffer[0] if len(buffer) == 1 else b"".join(buffer)
        at = len(joined) - 4 * have
        buffer, have = [joined], have - length
        yield None if null else doc_id, start, joined[at : at + 4 * length]
        start += length
    if start != total:
        raise ValueError("a token file's lengths do not add up")


def write_token_blocks(df: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and write their ids, each document ended by ``end_id``, in ascending order of id.

    ``path`` is a folder that the executors share, given as a URI. Each task writes its range of ids to a file of
    its own under a temporary name and renames it, so a task that runs again replaces its file. Returns the files
    with the number of ids before each; there are as many rows as tasks.
    """
    spark = df.sparkSession

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        from pagewright.llm.encoding import encoder, slices

        store, folder = fs.FileSystem.from_uri(path)
        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer).encode
        end = struct.pack("<I", end_id)
        name, writer, stream = f"part-{part:06d}.pwtb", None, None
        held = f"{folder}/.{name}.{uuid.uuid4().hex}"
        for batch in batches:
            for some in slices(batch):
                if writer is None and some.num_rows:
                    store.create_dir(folder, recursive=True)
                    stream = store.open_output_stream(held)
                    writer = BlockWriter(stream)
                for doc_id, ids in zip(some.column(0).to_pylist(), encode(some.column(1))):
                    writer.add(doc_id, ids + end)
        if writer is not None:
            n_docs, n_tokens = writer.close()
            stream.close()
            store.move(held, f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{path}/{name}"], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    ordered = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # By the text's hash as well, so that the rows of one id, or those without, need not be in one file.
    ordered = ordered.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h").drop("h")
    files = ordered.mapInArrow(write, FILES).collect()  # a row for each task
    rows, before = [], 0
    for f in sorted(files, key=lambda f: f["part"]):
        rows.append((f["part"], f["file"], f["n_docs"], f["n_tokens"], before))
        before += f["n_tokens"]
    return spark.createDataFrame(rows, FILES + ", start long")


def read_token_blocks(files: DataFrame) -> DataFrame:
    """Read files that ``write_token_blocks`` has written: doc_id, start, n_tokens and ids (little-endian, 32 bits)."""

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        def batch(rows):
            ids, starts, data = zip(*rows)
            return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array([len(d) // 4 for d in data], pa.int64()), "ids": pa.array(data, pa.binary())})

        for given in batches:
            for file, base in zip(given.column(0).to_pylist(), given.column(1).to_pylist()):
                store, name = fs.FileSystem.from_uri(file)
                with store.open_input_file(name) as stream:
                    rows, held = [], 0
                    for doc_id, start, ids in read_blocks(stream, stream.size()):
                        rows.append((doc_id, base + start, ids))
                        held += len(ids)
                        if held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    spark = files.sparkSession
    n = max(1, files.count())
    spread = files.select("file", "start").repartition(min(n, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))), "file")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op2_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document, written as patched frame-of-reference blocks and read back from the files."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    files = write_token_blocks(docs, work_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_blocks(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
