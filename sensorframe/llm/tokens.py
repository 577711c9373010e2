"""Token ids of a whole corpus: each distinct pre-token is encoded once."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the public pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FOLDER = "/opt/tokenizers"
BLOCK_WORDS = 60_000  # distinct words of a block; positions then fit 16 bits
BLOCK_LENGTH = 4_000_000  # pre-tokens of a block
_ROUTED = pa.schema([("route", pa.int64()), ("word", pa.string()), ("block", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("places", pa.binary())])
ROUTED = "route long, word string, block long, place int, doc_id long, places binary"
_CODED = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("ids", pa.list_(pa.int32())), ("doc_id", pa.int64()), ("places", pa.binary())])
CODED = "block long, place int, ids array<int>, doc_id long, places binary"
DOCUMENT = -1  # the place of a document's own row, which comes after its block's words


def vocabulary_path(name: str = "byte_bpe_50k") -> str:
    """The file of a public vocabulary; its folder is SENSORFRAME_TOKENIZERS or /opt/tokenizers."""
    return os.path.join(os.environ.get("SENSORFRAME_TOKENIZERS", FOLDER), f"{name}.tiktoken")


def read_ranks(vocabulary: str | bytes) -> dict[bytes, int]:
    """Tokens and their ids, from a vocabulary file's path or its contents."""
    if isinstance(vocabulary, str):
        with open(vocabulary, "rb") as f:
            vocabulary = f.read()
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}


def encoder(vocabulary: str | bytes):  # noqa: ANN201
    """The byte-pair encoder of a vocabulary file, without special tokens."""
    import tiktoken

    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=read_ranks(vocabulary), special_tokens={})


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file's contents (under 1 MB), read here and sent to the executors, which need no such file."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to blocks: a row for each distinct word of a block, and one for each document with the places of its
    words in the block's list, in order of position."""
    import regex
    from pyspark import TaskContext

    find = regex.compile(PATTERN).findall
    block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    words: dict[str, int] = {}
    ids: list[int] = []
    texts: list[bytes] = []
    length = 0

    def close() -> Iterator[pa.RecordBatch]:
        n, m = len(words), len(ids)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(list(words), pa.string()), pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=_ROUTED)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), pa.nulls(m, pa.string()), pa.array(np.full(m, block)), pa.array(np.full(m, DOCUMENT, np.int32)), pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], schema=_ROUTED)

    for b in batches:
        for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            found = find(text) if text else []
            if ids and (len(words) + len(found) > BLOCK_WORDS or length > BLOCK_LENGTH):
                yield from close()
                words, ids, texts, length, block = {}, [], [], 0, block + 1
            at = [words.setdefault(w, len(words)) for w in found]
            wide = len(words) > 65_535  # one document alone has that many distinct words
            texts.append((b"4" if wide else b"2") + np.array(at, np.uint32 if wide else np.uint16).tobytes())
            ids.append(i)
            length += len(found)
    if ids:
        yield from close()


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: Broadcast) -> Iterator[pa.RecordBatch]:
    """Rows come in order of word, so equal words are neighbours and each is encoded once. Documents pass through."""
    encode = None
    last: str | None = None
    out: list[int] = []
    for b in batches:
        words = b.column("word")
        if words.null_count == b.num_rows:
            ids = pa.nulls(b.num_rows, pa.list_(pa.int32()))
        else:
            encode = encode or encoder(vocabulary.value).encode_ordinary
            each = []
            for w in words.to_pylist():
                if w is None:
                    each.append(None)
                    continue
                if w != last:
                    last, out = w, encode(w)
                each.append(out)
            ids = pa.array(each, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column("block"), b.column("place"), ids, b.column("doc_id"), b.column("places")], schema=_CODED)


def _join(batches: Iterator[pa.RecordBatch], lengths: bool) -> Iterator[pa.RecordBatch]:
    """Rows come by block, a block's words in order of place before its documents; ids are put together by position."""
    block: int | None = None
    offsets: list[np.ndarray] = []
    values: list[np.ndarray] = []
    table: tuple[np.ndarray, np.ndarray] | None = None  # starts and all ids of the block's words
    for b in batches:
        blocks, places = b.column("block").to_numpy(), b.column("place").to_numpy()
        cut = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
        for a, z in zip(cut, np.append(cut[1:], len(blocks))):
            if blocks[a] != block:
                block, offsets, values, table = blocks[a], [], [], None
            n = int((places[a:z] != DOCUMENT).sum())
            if n:
                part = b.column("ids").slice(a, n)
                offsets.append(np.diff(part.offsets.to_numpy()))
                values.append(part.flatten().to_numpy())
            if n == z - a:
                continue
            if table is None:
                size = np.concatenate([np.zeros(1, np.int64), *offsets]).cumsum() if offsets else np.zeros(1, np.int64)
                table = size, np.concatenate(values) if values else np.zeros(0, np.int32)
            starts, all_ids = table
            out, sizes = [], []
            for raw in b.column("places").slice(a + n, z - a - n).to_pylist():
                at = np.frombuffer(raw, np.uint32 if raw[:1] == b"4" else np.uint16, offset=1)
                size = starts[1:][at] - starts[:-1][at]
                total = int(size.sum())
                sizes.append(total)
                if not lengths:
                    within = np.arange(total) - np.repeat(size.cumsum() - size, size)
                    out.append(all_ids[np.repeat(starts[:-1][at], size) + within])
            ids = b.column("doc_id").slice(a + n, z - a - n)
            if lengths:
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])
                continue
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])


def _coded(documents: DataFrame, path: str) -> DataFrame:
    routed = documents.select("doc_id", "text").mapInArrow(_split, ROUTED)
    routed = routed.withColumn("route", F.coalesce("route", F.xxhash64("word"))).repartition("route").sortWithinPartitions("word").drop("route")
    coded = routed.mapInArrow(partial(_encode, vocabulary=shipped(documents.sparkSession, path)), CODED)
    return coded.repartition("block").sortWithinPartitions("block", F.when(F.col("place") == DOCUMENT, 1).otherwise(0), "place")


def encode_corpus(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids: the token ids of each document's text by a public byte-level vocabulary, no special tokens.

    A null text and an empty text both give an empty list; text that spells a special token is ordinary text. Repeated
    doc_ids give a row each; extra columns are ignored; an empty table gives no rows.

    A global distinct-word shuffle. Each task splits its documents into pre-tokens with positions, block by block: a
    block's distinct words go out by hash of the word, which brings a word of the whole corpus to one task that encodes
    it once. A word comes once from each block, so the commonest word costs as many rows as there are blocks. The ids
    then go back to the blocks, where the documents are put together by position. Positions travel as 16-bit places in
    their block's word list, never as a row for each pre-token. As blocks are numbered within tasks, the documents should
    come in a repeatable order, as from a table; then a lost task gives the same blocks again.
    """
    return _coded(documents, path or vocabulary_path()).mapInArrow(partial(_join, lengths=False), "doc_id long, ids array<int>")


def token_lengths(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens, the size of what encode_corpus gives."""
    return _coded(documents, path or vocabulary_path()).mapInArrow(partial(_join, lengths=True), "doc_id long, n_tokens long")


def token_table(vocabulary: bytes) -> pa.BinaryArray:
    """The bytes of each token by its id; ids no token has are null."""
    ranks = read_ranks(vocabulary)
    out: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for b, i in ranks.items():
        out[i] = b
    return pa.array(out, pa.large_binary())


def _decode(batches: Iterator[pa.RecordBatch], vocabulary: Broadcast) -> Iterator[pa.RecordBatch]:
    table = token_table(vocabulary.value)
    for b in batches:
        ids = b.column("ids").fill_null([]) if b.column("ids").null_count else b.column("ids")
        parts = table.take(ids.flatten())
        if parts.null_count:
            raise ValueError("an id that no token has")
        size = pc.binary_length(parts).to_numpy()
        ends = np.concatenate([[0], np.cumsum(size)])
        data, first = b"".join(parts.to_pylist()), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
        texts = [data[ends[x] : ends[y]].decode("utf-8", "replace") for x, y in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids, by a join of the ids with the token-byte table.

    The table has a row for each token of the vocabulary (50,256), whatever the corpus, so it goes to every task and each
    batch's ids are looked up together; no text is shuffled. An empty or null list gives an empty text, repeated doc_ids
    a row each. Bytes that are no UTF-8, as half a character of a cut list, become replacement characters; an id that no
    token has is an error.
    """
    sent = shipped(encoded.sparkSession, path or vocabulary_path())
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(partial(_decode, vocabulary=sent), "doc_id long, text string")
