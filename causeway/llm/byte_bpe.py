"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

1. Documents are gathered into blocks of about 8 MB of text. A block's texts are split into pre-tokens;
   its distinct words get local numbers, and the occurrences become positions: arrays of these numbers.
2. The block's distinct words are dealt out by a hash of the word. All blocks' copies of a word meet in
   one bucket, where it is encoded once; the ids go back in the order the words came in. A word that is
   everywhere comes once from each block, as any other word of the block does, so no bucket is hot.
3. The ids meet their block again by its number, and texts are put together by position. Decoding joins
   the token-byte table to the ids.

The positions travel through both shuffles as compressed arrays, about two bytes for each word.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import documents, mapped, slices, without_reserved

BLOCK_BYTES = 8 << 20
#: Bucket of the rows that hold a block's positions.
POSITIONS = -1
#: Words of a block that are numbered by frequency, and tiers of the others (a frequency has at most 63 bits).
TOP, TIERS = 1024, 64
_encoders: dict[str, object] = {}
MID = pa.schema([("_block", pa.string()), ("_bucket", pa.int32()), ("_to", pa.int32()), ("_payload", pa.binary())])
MID_DDL = "_block string, _bucket int, _to int, _payload binary"


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a base64 token and its id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _packed(*arrays, level: int = 3) -> bytes:
    """Arrays (or bytes) as one compressed value; integers by planes of bytes, as the high ones are mostly zero."""
    import zstandard

    out = [np.uint32(len(arrays)).tobytes()]
    for a in arrays:
        if not isinstance(a, bytes):
            a = np.ascontiguousarray(a, dtype="<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
        out += [np.uint64(len(a)).tobytes(), a]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(out))


def _unpacked(value: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(value)
    at, out = 4, []
    for _ in range(int(np.frombuffer(raw, "<u4", 1)[0])):
        n = int(np.frombuffer(raw, "<u8", 1, at)[0])
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _ints(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _numbered(counts: Counter, buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct words in the order of their numbers, their buckets, and what tells the buckets again.

    The most frequent words come first, by frequency; the others by tier (powers of two of the frequency),
    bucket and word. Small numbers for frequent words keep positions short, words in order keep words short,
    and the numbers need no table of their own.
    """
    top = [w for w, _ in counts.most_common(TOP)]
    chosen = set(top)
    rest = sorted(w for w in counts if w not in chosen)
    first, own = (np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) % buckets for w in ws), np.uint32, len(ws)) for ws in (top, rest))
    tier = TIERS - np.fromiter((counts[w].bit_length() for w in rest), np.int64, len(rest))
    sizes = np.zeros((TIERS, buckets), np.uint32)
    np.add.at(sizes, (tier, own.astype(np.int64)), 1)
    order = np.lexsort((own, tier))
    return top + [rest[i] for i in order.tolist()], np.concatenate([first, own[order]]), first, sizes.ravel()


def _buckets_again(first: np.ndarray, sizes: np.ndarray, buckets: int) -> np.ndarray:
    return np.concatenate([first, np.repeat(np.tile(np.arange(buckets, dtype=np.uint32), TIERS), sizes)])


def _block_rows(rows: pa.RecordBatch, pattern, buckets: int) -> Iterator[tuple]:
    """The mid rows of one block."""
    # Words become numbers text by text, as they are first seen: a list of all words of a block would be many times its text.
    seen: dict[str, int] = defaultdict(count().__next__)
    split = []
    digest = hashlib.md5(usedforsecurity=False)
    for k in range(rows.num_rows):
        text = rows.column("_text")[k].as_py() or ""
        digest.update(text.encode("utf-8", "replace"))
        own = pattern.findall(text)
        split.append(np.fromiter(map(seen.__getitem__, own), np.uint32, len(own)))
    lengths = np.fromiter(map(len, split), np.uint32, len(split))
    flat = np.concatenate(split)
    del split
    often = np.bincount(flat, minlength=len(seen))
    words, bucket, first, sizes = _numbered(Counter(dict(zip(seen, often.tolist()))), buckets)
    number = np.empty(len(words), np.uint32)
    number[np.fromiter(map(seen.__getitem__, words), np.int64, len(words))] = np.arange(len(words), dtype=np.uint32)
    flat = number[flat]
    others = [n for n in rows.schema.names if n != "_text"]
    carried = pa.RecordBatch.from_arrays([rows.column(n) for n in others], names=others)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, carried.schema) as w:
        w.write_batch(carried)
    head = sink.getvalue().to_pybytes()
    digest.update(head)
    block = digest.hexdigest()
    yield block, POSITIONS, int(block[:7], 16) % buckets, _packed(head, lengths, flat, first, sizes, level=9)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(ends)):
        own = [words[i].encode("utf-8", "replace") for i in order[ends[b] : ends[b + 1]]]
        yield block, int(b), int(b), _packed(np.fromiter(map(len, own), np.uint32, len(own)), b"".join(own))


def _single_piece(table, pattern: str, name: str):
    """The encoder of one pre-token, built once in each Python worker for each vocabulary (``name``: its digest)."""
    import tiktoken

    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table.value, special_tokens={})._encode_single_piece
    return _encoders[name]


def _mid_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), MID)], schema=MID)


def encode_and_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """The rows of ``docs`` without ``text``, with n_tokens, ids (array; only if ``keep_ids``), ids_sha256 and decoded_sha256.

    A null text counts as empty: no tokens. Each match of ``pattern`` is encoded by itself, special tokens
    are ordinary text. Repeated rows come back as often as they came; rows are told apart by their place
    in their block, so null or repeated ids do no harm. Columns that clash with the results are replaced,
    those that begin with an underscore dropped; an empty table gives an empty result. A very long text is
    a block of its own.
    """
    docs = without_reserved(docs)
    spark = docs.sparkSession
    own = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    docs = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit(""))).drop(text, *own)
    carried = [f for f in docs.schema.fields if f.name != "_text"]
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = spark.sparkContext.broadcast(ranks)
    name = hashlib.md5(repr((pattern, sorted(ranks.items()))).encode(), usedforsecurity=False).hexdigest()

    def split(batches):
        import regex

        compiled, wait, size = regex.compile(pattern), [], 0
        for part in slices(batches, "_text", BLOCK_BYTES):
            n = part.column("_text").nbytes
            if wait and size + n > BLOCK_BYTES:
                yield from blocks(wait, compiled)
                wait, size = [], 0
            wait.append(part)
            size += n
        if wait:
            yield from blocks(wait, compiled)

    def blocks(parts, compiled):
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()
        rows = []
        for part in whole:
            rows += _block_rows(part, compiled, buckets)
        for k in range(0, len(rows), 64):
            yield _mid_batch(rows[k : k + 64])

    def encode(batches):
        single = _single_piece(table, pattern, name)
        known: dict[bytes, np.ndarray] = {}
        bucket = None
        for batch in batches:
            rows = []
            for block, b, to, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if b != POSITIONS:
                    if b != bucket:  # sorted by bucket: what is known of the last one is of no more use
                        known, bucket = {}, b
                    planes, joined = _unpacked(payload)
                    at, found = 0, []
                    for n in _ints(planes).tolist():
                        word = joined[at : at + n]
                        at += n
                        if (ids := known.get(word)) is None:
                            ids = known[word] = np.array(single(word), np.uint32)
                        found.append(ids)
                    payload = _packed(np.fromiter(map(len, found), np.uint32, len(found)), np.concatenate(found))
                rows.append((block, b, to, payload))
            if rows:
                yield _mid_batch(rows)

    out_fields = [(f.name, f.dataType.simpleString()) for f in carried] + [("n_tokens", "bigint")] + [("ids", "array<int>")] * keep_ids + [("ids_sha256", "string"), ("decoded_sha256", "string")]
    ddl = ", ".join(f"`{n}` {t}" for n, t in out_fields)

    def assemble(batches):
        by_id = [b""] * (max(table.value.values(), default=-1) + 1)
        for token, i in table.value.items():
            by_id[i] = token
        by_id = np.array(by_id, dtype=object)
        block, parts = None, {}
        for batch in batches:
            for own_block, b, _, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if own_block != block:
                    if parts:
                        yield from joined(parts, by_id)
                    block, parts = own_block, {}
                parts.setdefault(b, []).append(payload)
        if parts:
            yield from joined(parts, by_id)

    def joined(parts, by_id):
        found = [tuple(map(_ints, _unpacked(parts[b][0]))) for b in sorted(parts) if b != POSITIONS]
        dealt = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint32)
        ids = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.uint32)
        first, sizes = map(_ints, _unpacked(parts[POSITIONS][0])[3:])
        order = np.argsort(_buckets_again(first, sizes, buckets), kind="stable")
        lens, ends = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        lens[order], ends[order] = dealt, np.cumsum(dealt, dtype=np.int64)
        starts, ends = (ends - lens).tolist(), ends.tolist()
        said, tokens = list(map(str, ids.tolist())), by_id[ids].tolist()
        spelled = [" ".join(said[a:b]) for a, b in zip(starts, ends)]
        decoded = [b"".join(tokens[a:b]) for a, b in zip(starts, ends)]
        for payload in parts[POSITIONS]:  # more than one only if whole blocks repeat
            head, counts, flat = _unpacked(payload)[:3]
            rows = pa.ipc.open_stream(head).read_all().combine_chunks()
            flat, n, at, out = _ints(flat), [], 0, ([], [], [])
            for count in _ints(counts).tolist():
                own_ids = flat[at : at + count]
                at += count
                own_list = own_ids.tolist()
                n.append(int(lens[own_ids].sum()))
                out[1].append(hashlib.sha256(" ".join([spelled[i] for i in own_list]).encode()).hexdigest())
                out[2].append(hashlib.sha256(b"".join([decoded[i] for i in own_list])).hexdigest())
                if keep_ids:
                    out[0].append(np.concatenate([ids[starts[i] : ends[i]] for i in own_list]).astype(np.int32) if count else np.zeros(0, np.int32))
            columns = [c.combine_chunks() for c in rows.columns] + [pa.array(n, pa.int64())] + [pa.array(out[0], pa.list_(pa.int32()))] * keep_ids + [pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            yield from pa.Table.from_arrays(columns, names=[x for x, _ in out_fields]).to_batches(max_chunksize=500)

    mid = docs.transform(mapped, split, MID_DDL)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mid = mid.repartition(n, "_to").sortWithinPartitions("_to", "_bucket").transform(mapped, encode, MID_DDL)
    return mid.repartition(n, "_block").sortWithinPartitions("_block").transform(mapped, assemble, ddl)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = encode_and_decode(documents(spark, sf_dir).select("doc_id", "text"), ranks, public_tokenizers.PATTERN, keep_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
