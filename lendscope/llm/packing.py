"""Packing along a space-filling curve: like documents share a sequence.

Each document's tokens are hashed to buckets and the mean of the buckets' random directions
projects its vector to a few dimensions; the Hilbert curve through that space gives one
sortable key, close for close points. Documents are range-sorted by key and laid end to end
within each range, cut every `length` tokens. The last tokens of a range fill sequences of
falling powers of two, so nothing is padded, however many ranges there are.

Tokens are made once and stored with the key, as two or four bytes each. Ranges are cut at
(key, id, checksum), so a third of all rows with one text is spread over as many ranges.

Defined results: a null or empty text has only the end token; repeated rows are packed one
by one; null ids sort first; an empty table gives no pieces; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm import words as W
from lendscope.llm.scratch import stored

LENGTH = 2048
END = 1
DIMENSIONS = 4
BITS = 15
BUCKETS = 1 << 14
RANGE_BYTES = 16 << 20
CACHED_WORDS = 1_000_000
SLICE_BYTES = 2 << 20

TOKENS = "doc_id long, key long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def directions(seed: int = 7) -> np.ndarray:
    """A unit direction for each hash bucket."""
    vectors = np.random.default_rng(seed).standard_normal((BUCKETS, DIMENSIONS))
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def bucket(ids: np.ndarray) -> np.ndarray:
    return (W.mix(ids.astype(np.uint64) + np.uint64(1)) >> np.uint64(50)).astype(np.int64)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of points with coordinates in [0, 2**bits).

    Each step from the top bit down undoes the rotations and reflections that the curve has
    made in the quadrant, then the Gray code of all bits is read off, interleaved.
    """
    axes = [points[:, d].astype(np.int64) for d in range(points.shape[1])]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for d in range(len(axes)):
            upper = (axes[d] >> level) & 1 == 1
            swap = np.where(upper, 0, (axes[0] ^ axes[d]) & low)
            axes[0] = np.where(upper, axes[0] ^ low, axes[0]) ^ swap
            if d:
                axes[d] = axes[d] ^ swap
    for d in range(1, len(axes)):
        axes[d] = axes[d] ^ axes[d - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((axes[-1] >> level) & 1 == 1, turn ^ ((1 << level) - 1), turn)
    key = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | (((axis ^ turn) >> level) & 1)
    return key


def pieces(text: np.ndarray, bounds: np.ndarray) -> W.Words:
    """Parts of words that are tokenised alike alone and in their text: words in lower case,
    cut between ASCII letters or digits and punctuation (but for apostrophes, which may begin
    a token with letters). Where a text may spell a special token, words stay as they are."""
    if b"<|" in text.tobytes():
        return W.split(text, bounds)
    text = W.lowered(text)
    plain = (text >= 0x30) & (text <= 0x39) | (text >= 0x61) & (text <= 0x7A)
    mark = (text > 0x20) & (text < 0x7F) & ~plain & (text != 0x27)
    cuts = np.zeros(len(text), bool)
    cuts[1:] = plain[:-1] & mark[1:] | mark[:-1] & plain[1:]
    return W.split(text, bounds, cuts)


class Tokenizer:
    """Token ids of texts by their pieces. Ids of pieces met before are looked up by hash; the
    memory starts anew when it has CACHED_WORDS.

    New pieces of letters only are tokenised many at once: each ends with the first token
    that ends a word."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer as Public

        self.public = Public.from_file(file)
        vocabulary = self.public.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, end to end, and how many each has."""
        ids = [e.ids for e in self.public.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter((i for own in ids for i in own), np.uint32)
        return flat, np.fromiter((len(own) for own in ids), np.int64, len(ids))

    def together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.public.encode(" ".join(texts), add_special_tokens=False).ids, np.uint32)
        stops = np.flatnonzero(self.ends_word[ids]) + 1
        if len(stops) != len(texts) or stops[-1] != len(ids):
            return self.one_by_one(texts)
        return ids, np.diff(stops, prepend=0)

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        letters = np.fromiter((text.isalpha() for text in texts), bool, len(texts))
        order = np.argsort(~letters, kind="stable")
        many = int(letters.sum())
        parts = [
            self.together([texts[i] for i in order[a : min(a + 4096, many)]])
            for a in range(0, many, 4096)
        ]
        if many < len(texts):
            parts.append(self.one_by_one([texts[i] for i in order[many:]]))
        size = np.concatenate([s for _, s in parts])
        begin = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in parts)])
        known = np.concatenate([self.known, hashes[order]])
        sort = np.argsort(known)
        self.known = known[sort]
        self.begin = np.concatenate([self.begin, begin])[sort]
        self.size = np.concatenate([self.size, size])[sort]

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where distinct hashes are among the known ones; -1 where they are not."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at, -1)

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of texts, end to end with END after each, and the bounds."""
        words = pieces(*W.raw(column))
        distinct, where, code = np.unique(W.hashes(words), return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > CACHED_WORDS:
            self.forget()
        new = np.flatnonzero(self.places(distinct) < 0)
        if len(new):
            one = W.Words(
                words.text, None, words.start[where[new]], words.end[where[new]], np.array([0, len(new)])
            )
            joined, _ = W.joined(one)
            self.learn(distinct[new], joined.tobytes().decode().split(" "))
        at = self.places(distinct)
        sizes, begin = self.size[at][code], self.begin[at][code]
        total = np.zeros(len(code) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        bounds = total[words.first] + np.arange(len(words.first))
        out = np.full(int(bounds[-1]), END, np.uint32)
        place = np.arange(int(total[-1]))
        source = place + np.repeat(begin - total[:-1], sizes)
        target = place + np.repeat(W.owners(words), sizes)
        out[target] = self.ids[source]
        return out, bounds


def _tokens(file: str, width: np.dtype):
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, plane = Tokenizer(file), directions()
        of_id = plane[bucket(np.arange(1 << 16))]
        for batch in batches:
            text = batch.column("text")
            for a, b in W.slices(text, SLICE_BYTES):
                ids, bounds = tokenizer.texts(text.slice(a, b - a))
                sizes = np.diff(bounds)
                # END makes every document have a token, as reduceat needs.
                known = of_id if ids.max(initial=0) < len(of_id) else plane[bucket(np.arange(int(ids.max()) + 1))]
                means = np.stack(
                    [np.add.reduceat(known[ids, d], bounds[:-1]) for d in range(DIMENSIONS)], axis=1
                ) / sizes[:, None]
                points = np.clip((means + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                data = ids.astype(width)
                offsets = (bounds * width.itemsize).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(hilbert(points)),
                        pa.array(sizes),
                        pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(data)]),
                    ],
                    names=["doc_id", "key", "doc_tokens", "ids"],
                )

    return tokenize


def sequences(total: int, length: int) -> Iterator[int]:
    """Sizes of the sequences that `total` tokens fill: full ones, then powers of two."""
    for _ in range(total // length):
        yield length
    rest = total % length
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            yield 1 << bit


def _pack(length: int, width: np.dtype):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        number, held, used = 0, [], 0  # pieces of the open sequence: (doc_id, start, ids, doc_tokens)

        def emit(pieces, sequence):
            offset = 0
            for doc_id, start, ids, n in pieces:
                yield doc_id, start, len(ids), ids.astype("<u4").tobytes(), n, base + sequence, offset
                offset += len(ids)

        def arrow(rows):
            schema = pa.schema(
                [
                    (n, pa.binary() if k == "binary" else pa.int64())
                    for n, k in (f.split() for f in PIECES.split(", "))
                ]
            )
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema
            )

        rows, weight = [], 0
        for batch in batches:
            for doc_id, data in zip(
                batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True
            ):
                ids = np.frombuffer(data.as_buffer(), width)
                start = 0
                while start < len(ids):
                    part = ids[start : start + length - used]
                    held.append((doc_id, start, part, len(ids)))
                    start, used = start + len(part), used + len(part)
                    if used == length:
                        rows += emit(held, number)
                        number, held, used, weight = number + 1, [], 0, weight + length
                        if weight > 1 << 20:
                            yield arrow(rows)
                            rows, weight = [], 0
        for size in sequences(used, length):
            pieces, room = [], size
            while room:
                doc_id, start, ids, n = held.pop(0)
                pieces.append((doc_id, start, ids[:room], n))
                if len(ids) > room:
                    held.insert(0, (doc_id, start + room, ids[room:], n))
                room -= min(room, len(ids))
            rows += emit(pieces, number)
            number += 1
        if rows:
            yield arrow(rows)

    return pack


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    vocabulary: int = 1 << 16,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Pieces of documents in sequences of at most `length` tokens, a power of two (PIECES; ids
    are little-endian 32-bit). `tokenizer_file` is readable on every executor. `vocabulary`
    bounds the token ids."""
    width = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")
    )
    tokens = stored(rows.mapInArrow(_tokens(tokenizer_file, width), TOKENS), "pack-tokens")
    total = tokens.agg(F.coalesce(F.sum("doc_tokens"), F.lit(0))).first()[0]
    ranges = max(1, -(-total * width.itemsize // range_bytes))
    order = ["key", "doc_id", F.crc32("ids")]
    return (
        tokens.repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(_pack(length, width), PIECES)
    )


def packed_digest(docs: DataFrame, **options) -> DataFrame:
    """Pieces of `docs` (doc_id, text) under the public word-level vocabulary, with ids and
    their checksum."""
    import public_tokenizers

    pieces = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), **options)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
        "offset", "ids",
    )


def op9_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed_digest(docs).drop("ids")
