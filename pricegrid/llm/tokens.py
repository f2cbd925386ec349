"""Byte-level BPE encoding and decoding of a whole collection by a global distinct-word shuffle.

Tasks read the texts in chunks of bounded size. Each chunk names the distinct pre-tokens that occur in it (all
occurrences of a pre-token in a chunk become one before anything is shuffled); these go, packed by a hash of
the pre-token, to the one place where each distinct pre-token of the whole collection is merged once; the ids
come back to the chunks that asked, in the order in which the words were sent; and each chunk puts the ids
together again by position. Decoding looks each id up in the token-byte table, whose size the vocabulary fixes.

A chunk is named by a hash of its content. Should a source give its rows in another order when it is read
again, an answer is missing; the chunk then merges those words itself, with the same result.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows give repeated
results; an empty table gives an empty one. Only the id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import release, tidy, utf8_buffers

#: Characters for which the standard library's classes equal the Unicode properties that the pattern names.
_PLAIN = re.compile("[^\x00-\x1b\x20-\x7fÀ-ɏ]")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken vocabulary file; read on the driver and sent along with the tasks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the token itself if there is one, else its bytes, of which the adjacent pair of lowest rank
    (the leftmost of several) is joined until no pair is a token."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > 400:
        return _merge_long(word, ranks)
    none, parts = math.inf, [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs and (least := min(pairs)) != none:
        i = pairs.index(least)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs, in n log n steps."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by the start of a part; 0 as end: joined to another
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def push(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i))

    while heap:
        r, i = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or ranks.get(word[i : end[j]]) != r:
            continue  # one of the two was joined meanwhile
        end[i], end[j] = end[j], 0
        if end[i] < n:
            before[end[i]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """The function that cuts a text into pre-tokens. Plain Latin texts take the faster standard library."""
    general = regex.compile(pattern)
    quick = re.compile(
        pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    )

    def split(text: str) -> list[str]:
        return (general if _PLAIN.search(text) else quick).findall(text)

    return split


def _pack(batch: pa.RecordBatch) -> bytes:
    """A record batch as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return zstandard.ZstdCompressor(6).compress(sink.getvalue().to_pybytes())


def _unpack(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_next_batch()


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``most`` bytes at most (or one row that is larger), in the order of the rows."""
    held, size = [], 0
    for batch in batches:
        ends = utf8_buffers(batch.column(1))[1]
        i = 0
        while i < batch.num_rows:
            j = int(np.searchsorted(ends, ends[i] + most - size, "right")) - 1
            if j <= i:  # the next row doesn't fit any more
                if held:
                    yield pa.concat_batches(held)
                    held, size = [], 0
                    continue
                j = i + 1
            j = min(j, batch.num_rows)
            held.append(batch.slice(i, j - i))
            size, i = size + int(ends[j] - ends[i]), j
    if held:
        yield pa.concat_batches(held)


def _name_of(chunk: pa.RecordBatch) -> int:
    digest = hashlib.blake2b(repr(chunk.column(0).to_pylist()).encode(), digest_size=8)
    for raw in utf8_buffers(chunk.column(1)):
        digest.update(raw.tobytes())
    return int.from_bytes(digest.digest(), "little", signed=True)


def token_bytes(ranks: dict[bytes, int]) -> pa.Array:
    """The token-byte table, by id."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.binary())


def _take(table: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the picked entries one after the other, and their offsets."""
    return utf8_buffers(table.take(pa.array(at)))


def encode_decode(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = 16 << 20,
    most_buckets: int = 1024,
    most_words: int = 2_000_000,
) -> DataFrame:
    """``docs`` -> id, ids array<int>, decoded binary; one row for each input row.

    ``vocabulary`` is the path of a tiktoken rank file, ``pattern`` the expression that cuts pre-tokens. A task holds
    one chunk, or the words of one bucket, ``most_words`` at most: beyond that it forgets them and may merge a word again.
    """
    ranks = read_ranks(vocabulary)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    # distinct words grow far slower than texts, and chunks x buckets rows travel
    buckets = min(most_buckets, math.ceil(4 * math.sqrt(total // chunk_bytes + 1)))

    def dealt(words: list[str]) -> list[list[int]]:
        """Places of the words that each bucket gets, in the words' order."""
        out: list[list[int]] = [[] for _ in range(buckets)]
        for i in sorted(range(len(words)), key=words.__getitem__):
            out[zlib.crc32(words[i].encode("utf-8", "surrogatepass")) % buckets].append(i)
        return out

    def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, chunk_bytes):
            yield pa.RecordBatch.from_pydict({"chunk": [_name_of(c)], "texts": [_pack(c)]})

    def pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(pattern)
        for c in _chunks(batches, chunk_bytes):
            found: set[str] = set()
            for t in c.column(1):
                found.update(split(t.as_py()))
            words = list(found)
            del found
            for bucket, part in enumerate(dealt(words)):
                if part:
                    blob = _pack(pa.RecordBatch.from_pydict({"word": pa.array([words[i] for i in part], pa.string())}))
                    yield pa.RecordBatch.from_pydict({"chunk": [_name_of(c)], "bucket": pa.array([bucket], pa.int32()), "words": [blob]})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        last = None
        for b in batches:
            for chunk, bucket, blob in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != last or len(known) > most_words:
                    known, last = {}, bucket
                got = []
                for w in _unpack(blob).column(0).to_pylist():
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = np.array(merge(w.encode("utf-8", "surrogatepass"), ranks), np.int32).tobytes()
                    got.append(ids)
                answer = _pack(pa.RecordBatch.from_pydict({"ids": pa.array(got, pa.binary())}))
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "bucket": pa.array([bucket], pa.int32()), "answer": pa.array([answer], pa.binary())})

    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        split, table = splitter(pattern), token_bytes(ranks)
        answers = dict(zip(right.column("bucket").to_pylist(), right.column("answer"), strict=True))
        out = []
        for blob in left.column("texts"):
            packed = _unpack(blob.as_py())
            place: dict[str, int] = defaultdict(count().__next__)  # words by their first occurrence
            slots = []
            for i in range(0, packed.num_rows, 64):
                slots += [np.fromiter(map(place.__getitem__, split(t)), np.int32) for t in packed.column(1).slice(i, 64).to_pylist()]
            words = list(place)
            del place
            order, parts = [], []
            for bucket, own in enumerate(dealt(words)):
                ids = _unpack(answers[bucket].as_py()).column(0) if bucket in answers else pa.array([], pa.binary())
                if len(ids) != len(own):  # the answer to another reading of the source
                    ids = pa.array([np.array(merge(words[i].encode("utf-8", "surrogatepass"), ranks), np.int32).tobytes() for i in own], pa.binary())
                order += own
                parts.append(ids)
            at = np.zeros(len(words), np.int32)
            at[np.array(order, np.int64)] = np.arange(len(words), dtype=np.int32)
            dictionary = pa.concat_arrays(parts)
            del words, order, parts
            for i in range(0, packed.num_rows, 256):
                b, own = packed.slice(i, 256), slots[i : i + 256]
                each = np.array([len(s) for s in own], np.int64)
                packed_ids, id_ends = _take(dictionary, at[np.concatenate(own)])
                token_ends = id_ends[np.concatenate([[0], np.cumsum(each)])] // 4
                ids = packed_ids.view(np.int32)
                data, ends = _take(table, ids)
                decoded = pa.Array.from_buffers(
                    pa.binary(), b.num_rows, [None, pa.py_buffer(ends[token_ends].astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]
                )
                lists = pa.ListArray.from_arrays(pa.array(token_ends.astype(np.int32)), pa.array(ids, pa.int32()))
                out.append(pa.RecordBatch.from_arrays([b.column(0), lists, decoded], names=[id_col, "ids", "decoded"]))
        release()
        return pa.Table.from_batches(out, schema=_out_schema(id_type, id_col))

    kind, id_type = rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)
    dictionary = (
        rows.mapInArrow(tidy(pack_words), "chunk long, bucket int, words binary")
        .repartition("bucket").sortWithinPartitions("bucket")
        .mapInArrow(tidy(encode), "chunk long, bucket int, answer binary")
    )
    return (
        rows.mapInArrow(tidy(pack_texts), "chunk long, texts binary")
        .groupBy("chunk")
        .cogroup(dictionary.groupBy("chunk"))
        .applyInArrow(reassemble, f"`{id_col}` {kind}, ids array<int>, decoded binary")
    )


def _out_schema(id_type: pa.DataType, id_col: str) -> pa.Schema:
    return pa.schema([(id_col, id_type), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
