"""Token-ID output in training order: a keyed permutation gives every sequence a global slot, range partitions write fixed-stride shards.

Pass one counts sequences per partition of the stored documents; pass two tokenises again, numbers the sequences without gaps and
sends each to the shard of its slot. Slots are a Feistel permutation of the numbers, cycle-walked into [0, n), so equal
ranges of slots are equal shards without sampling, and a shard is written front to back by one task.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, new_path

#: The public byte-level BPE split pattern (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Of a record: document id, piece, tokens that are not padding.
HEADER = "<qII"
HEADER_BYTES = struct.calcsize(HEADER)
NULL_ID = -(1 << 63)
MOVED = "documents were partitioned differently in the two passes; write or checkpoint them first"
_loaded: dict[str, "Tokenizer"] = {}


def _as_text(texts) -> pa.Array:
    """Texts as Arrow strings with long offsets, null as empty."""
    return pc.fill_null(texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")


class Tokenizer:
    """Token ids of whole texts as little-endian uint16 (uint32 for vocabularies over 65,536).

    For the byte-level BPE above a text is cut before each space that stands between two other characters; the pattern
    never joins across such a cut. So each batch's different pieces are encoded once, in one call, and gathered.
    """

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.dtype = np.dtype("<u2") if max(ranks.values()) < 65535 else np.dtype("<u4")
        self.encoding = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spaced = np.zeros(max(ranks.values()) + 2, bool)
        self.spaced[[v for k, v in ranks.items() if k[:1] == b" "]] = True

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), self.dtype)

    def _pool(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words, each after a space, end to end; where each begins, and the end)."""
        ids = self._plain(" " + " ".join(words)) if words else np.empty(0, self.dtype)
        cuts = np.append(np.flatnonzero(self.spaced[ids]), len(ids))
        if len(cuts) != len(words) + 1:
            each = [self._plain(" " + w) for w in words]
            ids, cuts = np.concatenate(each), np.concatenate(([0], np.cumsum([len(x) for x in each])))
        return ids, cuts

    def _gathered(self, texts: pa.Array, tokens: bool) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """(tokens end to end, bounds of the texts, texts that had to be encoded as a whole)."""
        lists = pc.split_pattern(texts, " ")
        bounds = np.asarray(lists.offsets).astype(np.int64)
        pieces = lists.flatten()
        bounds = bounds - bounds[0]
        first = bounds[:-1]
        empty = pc.binary_length(pieces).to_numpy(zero_copy_only=False) == 0
        empty[first] = False
        double = np.concatenate(([0], np.cumsum(empty)))
        whole = {k: self._plain(texts[k].as_py()) for k in np.flatnonzero(double[bounds[1:]] > double[bounds[:-1]]).tolist()}
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        known = words != ""
        ids, cuts = self._pool(words[known].tolist())
        begin, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        begin[known], length[known] = cuts[:-1], np.diff(cuts)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        begin, length = begin[codes], length[codes]
        heads = [self._plain(h) for h in words[codes[first]]]
        length[first] = [len(h) for h in heads]
        begin[first] = len(ids) + np.concatenate(([0], np.cumsum(length[first])[:-1]))
        ends = np.concatenate(([0], np.cumsum(length)))
        out = np.empty(0, self.dtype)
        if tokens:
            out = np.concatenate([ids, *heads])[np.repeat(begin - ends[:-1], length) + np.arange(ends[-1])]
        return out, ends[bounds], whole

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        texts = _as_text(texts)
        if not len(texts):
            return []
        out, bounds, whole = self._gathered(texts, True)
        raw, at = out.tobytes(), (bounds * self.dtype.itemsize).tolist()
        return [whole[k].tobytes() if k in whole else raw[i:j] for k, (i, j) in enumerate(zip(at, at[1:]))]

    def lengths(self, texts: list[str | None] | pa.Array) -> np.ndarray:
        """How many tokens each text has."""
        texts = _as_text(texts)
        if not len(texts):
            return np.empty(0, np.int64)
        _, bounds, whole = self._gathered(texts, False)
        n = np.diff(bounds)
        for k, ids in whole.items():
            n[k] = len(ids)
        return n


def tokenizer(vocabulary: bytes) -> Tokenizer:
    key = hashlib.sha256(vocabulary).hexdigest()
    if key not in _loaded:
        _loaded[key] = Tokenizer(vocabulary)
    return _loaded[key]


def feistel(x: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A permutation of [0, n): a balanced Feistel network over the next even power of two, walked along its cycle until it is below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(rounds)]
    out = np.asarray(x, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> np.uint64(half), v & mask
        with np.errstate(over="ignore"):
            for k in keys:
                h = (right + k) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                left, right = right, left ^ ((h ^ (h >> np.uint64(29))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _batches(parts: Iterator[pa.RecordBatch], most: int = 1 << 24) -> Iterator[tuple[list, pa.Array]]:
    """(ids, texts) of about `most` bytes, so that token arrays stay small beside the texts."""
    for part in parts:
        ids, texts = part.column("doc_id"), _as_text(part.column("text"))
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield ids[at:end].to_pylist(), texts[at:end]
            at = end


def write_token_shards(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, seq_len: int = 512, rows_per_shard: int = 16384, key: int = 0, eos: int = 50256) -> DataFrame:
    """Writes the shards and an index; returns the index: a row per sequence with doc_id, piece, slot, shard, byte_offset, n_tokens, token_crc32.

    The vocabulary is read by the driver from vocabulary_path, or from the path in the setting spark.pitspark.vocabulary. A document is its tokens and `eos`, cut into pieces of seq_len tokens; the last is padded with eos. Null and empty texts are one
    eos. Null ids are stored as the least long. Repeated rows are sequences of their own; other columns are ignored; an
    empty table writes an index without rows. docs must be a stored table (or be checkpointed), as it is read twice; should
    the partitions differ between the passes, the job fails instead of writing overlapping slots.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    vocabulary_path = vocabulary_path or spark.conf.get("spark.pitspark.vocabulary", DEFAULT_VOCABULARY)
    vocabulary = spark.sparkContext.broadcast(open(vocabulary_path, "rb").read())  # one vocabulary file, about a megabyte
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def tokens_of(texts: pa.Array) -> list[bytes]:
        t = tokenizer(vocabulary.value)
        return [x + t.dtype.type(eos).tobytes() for x in t.encode(texts)]

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for _, some in _batches(parts):
            n += int(((tokenizer(vocabulary.value).lengths(some) + seq_len) // seq_len).sum())  # with eos, rounded up
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], ["part", "n"])

    counted = sorted((r["part"], r["n"]) for r in texts.mapInArrow(count, "part int, n long").collect())  # a row per partition
    sizes = np.zeros(counted[-1][0] + 1 if counted else 1, np.int64)
    for part, n in counted:
        sizes[part] = n
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    total = int(bounds[-1])
    places = spark.sparkContext.broadcast(bounds)  # eight bytes per partition
    n_shards = max(1, -(-total // rows_per_shard))

    def number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = TaskContext.get().partitionId()
        at, end = (int(x) for x in places.value[me : me + 2]) if me + 1 < len(places.value) else (0, 0)
        for docs_here, some in _batches(parts):
            t = tokenizer(vocabulary.value)
            width = t.dtype.itemsize * seq_len
            ids, pieces, lengths, rows = [], [], [], []
            for doc, raw in zip(docs_here, tokens_of(some)):
                for k, i in enumerate(range(0, len(raw), width)):
                    piece = raw[i : i + width]
                    ids.append(doc)
                    pieces.append(k)
                    lengths.append(len(piece) // t.dtype.itemsize)
                    rows.append(piece)  # padded where it is written
            if at + len(rows) > end:
                raise RuntimeError(MOVED)
            slots = feistel(np.arange(at, at + len(rows)), total, key)
            at += len(rows)
            for i in range(0, len(rows), 4096):
                cut = slice(i, i + 4096)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[cut], pa.int64()), pa.array(pieces[cut], pa.int32()), pa.array(slots[cut]), pa.array(lengths[cut], pa.int32()), pa.array(rows[cut], pa.binary())],
                    ["doc_id", "piece", "slot", "n_tokens", "tokens"],
                )
        if at != end:
            raise RuntimeError(MOVED)

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        out = None
        dtype = tokenizer(vocabulary.value).dtype
        pad, width = dtype.type(eos).tobytes() * seq_len, dtype.itemsize
        for part in parts:
            if not part.num_rows:
                continue
            ids, pieces, slots, lengths, rows = (c.to_pylist() for c in part.columns)
            if out is None:
                shard = slots[0] // rows_per_shard
                fs.create_dir(f"{root}/shards", recursive=True)
                temp, final = f"{root}/shards/.{shard}-{TaskContext.get().taskAttemptId()}", f"{root}/shards/{shard:08d}.bin"
                out = fs.open_output_stream(temp)
            out.write(b"".join([struct.pack(HEADER, NULL_ID if d is None else d, k, n) + raw + pad[len(raw) :] for d, k, n, raw in zip(ids, pieces, lengths, rows)]))
            stride = HEADER_BYTES + seq_len * width
            sums = [zlib.crc32(raw) for raw in rows]
            place = np.array(slots, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array((place // rows_per_shard).astype(np.int32)), pa.array(place % rows_per_shard * stride), part.column(3), pa.array(sums, pa.int64())],
                ["doc_id", "piece", "slot", "shard", "byte_offset", "n_tokens", "token_crc32"],
            )
        if out is not None:
            out.close()
            fs.move(temp, final)  # whole or not at all, also when a task is tried again

    dealt = texts.mapInArrow(number, "doc_id long, piece int, slot long, n_tokens int, tokens binary")
    ranged = dealt.repartitionById(n_shards, F.expr(f"cast(slot div {rows_per_shard} as int)")).sortWithinPartitions("slot")
    schema = "doc_id long, piece int, slot long, shard int, byte_offset long, n_tokens int, token_crc32 long"
    ranged.mapInArrow(write, schema).write.parquet(f"{path}/index")
    fs, root = filesystem(path)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"sequences": total, "seq_len": seq_len, "rows_per_shard": rows_per_shard, "stride": HEADER_BYTES + tokenizer(vocabulary.value).dtype.itemsize * seq_len, "dtype": tokenizer(vocabulary.value).dtype.str, "key": key, "eos": eos}).encode())
    return spark.read.schema(schema).parquet(f"{path}/index")


def read_sequences(path: str, slot: int = 0, count: int | None = None) -> Iterator[tuple[int, int | None, int, np.ndarray]]:
    """(slot, doc_id, piece, tokens) from `slot` on, by sequential reads: what a trainer that resumes there sees."""
    fs, root = filesystem(path)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        m = json.loads(f.read())
    end = m["sequences"] if count is None else min(m["sequences"], slot + count)
    while slot < end:
        shard, record = divmod(slot, m["rows_per_shard"])
        with fs.open_input_file(f"{root}/shards/{shard:08d}.bin") as f:
            f.seek(record * m["stride"])
            for _ in range(min(end - slot, m["rows_per_shard"] - record)):
                raw = f.read(m["stride"])
                doc, piece, n = struct.unpack_from(HEADER, raw)
                yield slot, None if doc == NULL_ID else doc, piece, np.frombuffer(raw, m["dtype"], n, HEADER_BYTES)
                slot += 1
