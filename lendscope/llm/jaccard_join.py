"""N-gram Jaccard join with vertical partitioning: links of 0.75 or more between 5-word
shingle sets, and their components.

All grams have one global order: those in many documents last, by a hash otherwise. Only
that some grams are placed last matters to speed, and any order gives the same links, so
document counts of grams are taken from a sketch of bounded size.

1. Equal sets are one node (a 64-bit fingerprint of the set).
2. Sets that are alike enough share a gram among the first quarter of each. These prefixes
   are cut into fragments, ranges of the global order, and met in each fragment apart.
3. A gram's nodes would make pairs by the square of their number. First each is paired only
   with the least one. Pairs are verified, and links make components.
4. Lists of a gram's nodes that are long are dealt to blocks, where a signature of each whole
   set tells which node of another component may be nearest. Only these pairs become rows, one
   for a node at most, and are verified, twice over different blocks: that makes one component
   of most groups, whichever node was least.
5. What is left are pairs of one gram that lie in different components. If these are many for
   their nodes, each node's pair of the most shared grams is verified first; then all that still
   lie in different components, so components are those of all links. A group of near copies,
   one component by then, has no such pairs, however large it is. A large group whose members are
   not quite alike enough has as many as the square of its number: there, sets meet in blocks,
   by signatures and then by 32 bits of each gram, and only pairs that these cannot refute
   become rows.

Where links are counted, step 5 takes all pairs of a gram's nodes, also those of one component.
Copies are one node; each counts as a link of the others, and for every link of their node.

Fragments count apart how many prefix grams a pair shares; the sum per pair must reach what
two sets alike enough share there at least. That leaves out pairs with a common passage. The
others are verified by the same vertical partitioning of whole sets: each is cut by ranges of
the global order into segments, overlaps are counted segment by segment, and summed.

Defined results: a text without words, or null, has an empty set, is linked with nothing and
its own component; equal non-empty sets are linked; repeated rows count as documents of
their own; a null id never names a component unless no other id is in it; an empty table
gives an empty table. Other columns are not carried by `linked_documents`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm import words as W
from lendscope.llm.components import components
from lendscope.llm.scratch import stored

SHINGLE = 5
PERCENT = 75

#: Cells of the sketch that counts the documents of grams: one for LOAD grams, at most so many.
LOAD = 32
MAX_CELLS = 1 << 26
#: A gram is frequent if its cell has this many times the mean.
FREQUENT = 4

BUCKET_BYTES = 16 << 20
FINER = 2  # bits by which fragments are finer: prefixes lie in the first quarter of the order
FLUSH = 1 << 20
SEGMENTS = 3  # bits of the global order that tell a set's segments apart
MEMBERS = 512  # of one set's partners in one task
MAX_WANTED_LONGS = 1 << 22
SHORT = 256  # nodes of a list whose pairs are made without regard to whole sets
MAX_SIGNATURE = 1 << 15
MAX_PRINTS = 1 << 11  # grams of a set that goes to blocks whole, by 32 bits of each
DEALS = 2  # ways that nodes of long lists are dealt to blocks to find their nearest
FLAT_PAIRS = 1 << 20
PAIRS_A_NODE = 4  # beyond which a node's nearest pair is verified before all others

#: Up to so many rows, those to keep are broadcast as bits, a million words of 64; more meet
#: their documents by a shuffle.
ROWS_AS_BITS = 1 << 26
SLICE_BYTES = 1 << 19

#: Set sizes go along in the low bits of a gram's order: as they are below EXACT, above that
#: to 1/STEP in their logarithm.
SIZE_BITS = 12
EXACT = 1 << 11
STEP = 100

ROWS = "doc_id long, n_shingles long, node long, slice int, counts binary"
ENTRIES = "bucket int, grams binary, nodes binary"
MET = "a long, b long, code_a long, code_b long, shared long, list binary"
SETS = "node long, segment int, size int, grams binary"
OVERLAPS = "a long, b long, size_a int, size_b int, overlap long"


class Sets:
    """Distinct shingle hashes of consecutive texts, sorted within each: gram[first[i]:first[i + 1]]."""

    def __init__(self, column: pa.Array, size: int = SHINGLE):
        text, bounds = W.raw(column)
        words = W.split(W.lowered(text), bounds)
        hashes = W.hashes(words)
        counts = np.diff(words.first)
        inside = W.whole(words, size)
        owner = W.owners(words)
        gram = W.windows(hashes, size)[inside]
        of = owner[: len(inside)][inside]
        # Fewer words than a shingle: the whole sequence is one.
        short = np.flatnonzero((counts > 0) & (counts < size))
        own = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            word = hashes[words.first[short][has] + k]
            own[has] = W.mix(own[has] * np.uint64(3) + word + np.uint64(k + 1))
        gram, of = np.concatenate([gram, own]), np.concatenate([of, short])
        order = _by_text(gram, of, len(column))
        gram, of = gram[order], of[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])
        self.gram, self.of = gram[new], of[new]
        self.first = np.searchsorted(self.of, np.arange(len(column) + 1))
        self.size = np.diff(self.first)

    def nodes(self) -> np.ndarray:
        """A fingerprint for each set: a sum over its grams, and its size."""
        sums = np.zeros(len(self.gram) + 1, np.uint64)
        np.cumsum(W.mix(self.gram ^ np.uint64(0xA24BAED4963EE407)), out=sums[1:])
        total = sums[self.first[1:]] - sums[self.first[:-1]]
        return W.mix(total + self.size.astype(np.uint64)).view(np.int64)

    def ordered(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of grams in the global order, sorted within each set, and their texts."""
        late = _frequent(self.gram, frequent).astype(np.int64)
        place = self.gram >> np.uint64(1) | late.astype(np.uint64) << np.uint64(63)
        if not late.any():
            return place, self.of
        # Grams are sorted: those placed last go behind the others of their text, in order.
        sums = np.append(0, np.cumsum(late))
        first, last = self.first[:-1], self.first[1:]
        before = sums[:-1] - sums[first][self.of]
        behind = (last - (sums[last] - sums[first]))[self.of] + before
        out = np.empty_like(place)
        out[np.where(late == 1, behind, np.arange(len(place)) - before)] = place
        return out, self.of


def _by_text(gram: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
    """An order by text, then gram: by the text's number and a gram's leading bits, if these
    tell a text's grams apart."""
    bits = np.uint64(max(1, texts.bit_length()))
    key = of.astype(np.uint64) << (np.uint64(64) - bits) | gram >> bits
    order = np.argsort(key)
    key, gram_there = key[order], gram[order]
    if np.any((key[1:] == key[:-1]) & (gram_there[1:] != gram_there[:-1])):
        return np.lexsort((gram, of))
    return order


def _cell(gram: np.ndarray, cells: int) -> np.ndarray:
    return ((gram * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def _frequent(gram: np.ndarray, bits: np.ndarray) -> np.ndarray:
    cell = _cell(gram, len(bits) * 8)
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Sets]]:
    for batch in batches:
        for a, b in W.slices(batch.column("text"), SLICE_BYTES):
            part = batch.slice(a, b - a)
            yield part, Sets(part.column("text"))


def _describe(cells: int):
    """A row for each document, and the partition's sketch of how many have each gram."""
    size = min(cells, 1 << 16)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()),
             ("slice", pa.int32()), ("counts", pa.binary())]
        )
        totals = np.zeros(cells, np.uint32)
        for batch, sets in _sets(batches):
            np.add.at(totals, _cell(sets.gram, cells), np.uint32(1))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(sets.size.astype(np.int64)),
                    pa.array(sets.nodes(), mask=sets.size == 0),
                    pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                ],
                schema=schema,
            )
        if totals.any():
            for k in range(cells // size):
                part = totals[k * size : (k + 1) * size].astype("<u4")
                # Most counts are small: planes of bytes, packed, as every partition sends all cells.
                packer = zlib.compressobj(1, strategy=zlib.Z_RLE)
                planes = packer.compress(np.ascontiguousarray(part.view(np.uint8).reshape(-1, 4).T)) + packer.flush()
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.int64())] * 3 + [pa.array([k], pa.int32()), pa.array([planes], pa.binary())],
                    schema=schema,
                )

    return describe


def _sum_counts(limit: int):
    """Of each slice of cells, one bit a cell: whether partitions together reach the limit."""

    def finish(key, total):
        return pa.RecordBatch.from_arrays(
            [pa.array([key], pa.int32()),
             pa.array([np.packbits(total >= limit, bitorder="little").tobytes()], pa.binary())],
            names=["slice", "bits"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for own, counts in zip(
                batch.column("slice").to_pylist(), batch.column("counts"), strict=True
            ):
                planes = np.frombuffer(zlib.decompress(counts.as_buffer()), np.uint8).reshape(4, -1)
                values = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
                if own != key:
                    if key is not None:
                        yield finish(key, total)
                    key, total = own, np.zeros(len(values), np.int64)
                total += values
        if key is not None:
            yield finish(key, total)

    return run


def prefix_length(size: np.ndarray) -> np.ndarray:
    return np.where(size > 0, size - (PERCENT * size + 99) // 100 + 1, 0)


def _prefixes(sent, bits: int):
    """Prefix grams by fragment: the place in the order, with the set's size in its low bits,
    and the node; once for a node in a partition."""

    def emit(places, nodes):
        place, node = np.concatenate(places), np.concatenate(nodes)
        bucket = (place >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(place), np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
        place, node = place[order], node[order]
        full = np.flatnonzero(np.diff(edges))
        cut = lambda x: pa.array([x[edges[k] : edges[k + 1]].tobytes() for k in full], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()), cut(place), cut(node)], names=["bucket", "grams", "nodes"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        places, nodes, held = [], [], 0
        for _, sets in _sets(batches):
            own = sets.nodes()
            fresh = np.zeros(len(own), bool)
            for i in np.flatnonzero(sets.size):
                if int(own[i]) not in seen:
                    seen.add(int(own[i]))
                    fresh[i] = True
            if len(seen) > 1 << 20:
                seen.clear()  # a node may come twice then, which changes nothing
            place, of = sets.ordered(sent.value)
            nth = np.arange(len(place)) - sets.first[:-1][of]
            keep = fresh[of] & (nth < prefix_length(sets.size)[of])
            place, of = place[keep], of[keep]
            code = size_code(sets.size).astype(np.uint64)[of]
            places.append(place >> np.uint64(SIZE_BITS) << np.uint64(SIZE_BITS) | code)
            nodes.append(own[of])
            held += len(place)
            if held > FLUSH:
                yield emit(places, nodes)
                places, nodes, held = [], [], 0
        if held:
            yield emit(places, nodes)

    return run


def size_code(size: np.ndarray) -> np.ndarray:
    steps = np.log(np.maximum(size, EXACT) / EXACT) * STEP
    return np.where(size < EXACT, size, EXACT + np.minimum(steps, EXACT - 1)).astype(np.int64)


def size_bounds(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest size of a code."""
    at = [np.exp((code - EXACT + k) / STEP) * EXACT for k in (0, 1)]
    return (
        np.where(code < EXACT, code, np.floor(at[0])).astype(np.int64),
        np.where(code < EXACT, code, np.ceil(at[1])).astype(np.int64),
    )


def sizes_fit(code_a: np.ndarray, code_b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be alike enough."""
    (low_a, high_a), (low_b, high_b) = size_bounds(code_a), size_bounds(code_b)
    return 100 * np.minimum(high_a, high_b) >= PERCENT * np.maximum(low_a, low_b)


def needed(code_a: np.ndarray, code_b: np.ndarray) -> np.ndarray:
    """How many prefix grams two sets of these sizes share at least, if alike enough.

    Of two sorted sets, take the one whose prefix ends first: what they share up to there is
    in both prefixes, and beyond there it has less than three quarters of its grams left."""
    (low_a, high_a), (low_b, high_b) = size_bounds(code_a), size_bounds(code_b)
    overlap = -(-PERCENT * (low_a + low_b) // (100 + PERCENT))
    rest = -(-PERCENT * np.maximum(high_a, high_b) // 100) - 1
    return np.maximum(1, overlap - rest)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each fragment: pairs of a gram's least node with its others and how many grams they
    share so; and the distinct lists of nodes (with size codes) that grams have, with the
    number of those grams in `shared`."""

    schema = pa.schema([(f.split()[0], pa.binary() if "binary" in f else pa.int64()) for f in MET.split(", ")])

    def met(parts):
        gram = np.concatenate([np.frombuffer(g, np.uint64) for g, _ in parts])
        node = np.concatenate([np.frombuffer(n, np.int64) for _, n in parts])
        code = (gram & np.uint64((1 << SIZE_BITS) - 1)).astype(np.int64)
        gram = gram >> np.uint64(SIZE_BITS)
        order = np.argsort(gram, kind="stable")
        # Most grams have one node: leave them out before the full sort.
        sorted_gram = gram[order]
        same = np.zeros(len(order), bool)
        same[1:] = sorted_gram[1:] == sorted_gram[:-1]
        shared = same.copy()
        shared[:-1] |= same[1:]
        order = order[shared]
        gram, node, code = gram[order], node[order], code[order]
        order = np.lexsort((node, gram))
        gram, node, code = gram[order], node[order], code[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])
        gram, node, code = gram[new], node[new], code[new]
        start = np.ones(len(gram), bool)
        start[1:] = gram[1:] != gram[:-1]
        at = np.flatnonzero(start)
        if not len(at):
            return None
        sizes = np.diff(np.append(at, len(gram)))
        # Lists with the same nodes are told by a sum over them.
        sums = np.add.reduceat(W.mix(node.view(np.uint64)), at) + sizes.astype(np.uint64)
        long = np.flatnonzero(sizes > 1)
        if not len(long):
            return None
        _, one, times = np.unique(sums[long], return_index=True, return_counts=True)
        chosen = long[one]
        lists = [
            np.stack([node[at[k] : at[k] + sizes[k]], code[at[k] : at[k] + sizes[k]]]).tobytes()
            for k in chosen
        ]
        lead = np.repeat(at[chosen], sizes[chosen] - 1)
        inner = np.arange(len(lead)) - np.repeat(np.cumsum(sizes[chosen] - 1) - (sizes[chosen] - 1), sizes[chosen] - 1)
        other, weight = lead + 1 + inner, np.repeat(times, sizes[chosen] - 1)
        near = sizes_fit(code[other], code[lead])
        lead, other, weight = lead[near], other[near], weight[near]
        order = np.lexsort((node[other], node[lead]))
        lead, other, weight = lead[order], other[order], weight[order]
        new = np.ones(len(lead), bool)
        new[1:] = (node[lead[1:]] != node[lead[:-1]]) | (node[other[1:]] != node[other[:-1]])
        first, which = np.flatnonzero(new), np.cumsum(new) - 1
        n, m = len(first), len(lists)
        none = np.arange(n + m) >= n
        column = lambda x: pa.array(np.append(x, np.zeros(m, np.int64)), mask=none)
        count = np.bincount(which, weight, n).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                column(node[lead[first]]), column(node[other[first]]), column(code[lead[first]]),
                column(code[other[first]]),
                pa.array(np.append(count, times)), pa.array([None] * n + lists, pa.binary()),
            ],
            schema=schema,
        )

    bucket, parts = None, []
    for batch in batches:
        for own, grams, nodes in zip(*(batch.column(n) for n in ("bucket", "grams", "nodes")), strict=True):
            if own.as_py() != bucket:
                if parts and (out := met(parts)) is not None:
                    yield out
                bucket, parts = own.as_py(), []
            parts.append((grams.as_py(), nodes.as_py()))
    if parts and (out := met(parts)) is not None:
        yield out


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each node of each list: list (a fingerprint), node, code, shared."""
    for batch in batches:
        for blob, shared in zip(batch.column("list"), batch.column("shared").to_pylist(), strict=True):
            node, code = np.frombuffer(blob.as_buffer(), np.int64).reshape(2, -1)
            name = W.mix(W.mix(node.view(np.uint64)).sum(keepdims=True)).view(np.int64)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(node), name)), pa.array(node), pa.array(code), pa.array(np.full(len(node), shared))],
                names=["list", "node", "code", "shared"],
            )


def _pair_batch(one, two, node, code, shared) -> pa.RecordBatch:
    """Rows of pairs of members, given by place, the lesser node first."""
    swap = node[one] > node[two]
    a, b = np.where(swap, two, one), np.where(swap, one, two)
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (node[a], node[b], code[a], code[b], shared[two])],
        names=["a", "b", "code_a", "code_b", "shared"],
    )


def _first_of_run(*keys: np.ndarray) -> np.ndarray:
    """For each place where the run of equal keys around it begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a list's nodes in different components, of many lists at once. Lists are short;
    rows come sorted by list and label."""

    def pairs(lists, label, node, code, shared):
        begin = _first_of_run(lists)
        # A node is paired with those of its list that lie in earlier components.
        count = _first_of_run(lists, label) - begin
        ends, a = np.cumsum(count), 0
        while a < len(node):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + FLAT_PAIRS)))
            two = np.repeat(np.arange(a, b), count[a:b])
            one = np.arange(len(two)) - np.repeat(ends[a:b] - count[a:b] - (ends[a - 1] if a else 0), count[a:b])
            one += begin[two]
            near = sizes_fit(code[one], code[two])
            if near.any():
                yield _pair_batch(one[near], two[near], node, code, shared)
            a = b

    held = None
    for batch in batches:
        rows = [np.asarray(batch.column(n)) for n in ("list", "label", "node", "code", "shared")]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if len(rows[0]):
            last = int(_first_of_run(rows[0])[-1])
            yield from pairs(*(x[:last] for x in rows)) if last else ()
            rows = [x[last:] for x in rows]
        held = rows
    if held is not None and len(held[0]):
        yield from pairs(*held)


def signature_bits(size: int) -> int:
    """16 to 32 bits for each gram of a set; a power of two."""
    return min(MAX_SIGNATURE, 1 << max(6, (16 * size - 1).bit_length()))


def signature(grams: np.ndarray) -> np.ndarray:
    """A set as bits, one for each value of a hash."""
    return _signed(prints(grams))


def prints(grams: np.ndarray) -> np.ndarray:
    """32 bits of each gram of a set, sorted."""
    return np.sort((W.mix(grams) >> np.uint64(32)).astype(np.uint32))


def _signed(prints: np.ndarray) -> np.ndarray:
    bits = signature_bits(len(prints))
    out = np.zeros(bits, bool)
    out[prints >> np.uint32(33 - bits.bit_length())] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def packed(grams: np.ndarray) -> bytes:
    """What blocks know of a set: its prints, or a signature of bounded size. Lengths tell which."""
    size = len(grams)
    whole = size <= MAX_PRINTS and 4 * size != signature_bits(size) // 8
    return (prints(grams) if whole else signature(grams)).tobytes()


def unpacked(known: bytes, size: int) -> tuple[np.ndarray, np.ndarray | None]:
    """A set's signature, and its prints if these are known."""
    if len(known) == signature_bits(size) // 8:
        return np.frombuffer(known, np.uint64), None
    own = np.frombuffer(known, np.uint32)
    return _signed(own), own


def shared_prints(mine: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many prints of each other set are among these: what they share, or more."""
    every = np.concatenate(others)
    same = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
    ends = np.cumsum([len(x) for x in others])
    return np.diff(np.append(0, np.append(0, np.cumsum(same))[ends]))


def folded(signatures: np.ndarray) -> np.ndarray:
    """Signatures of half the bits: neighbouring bits as one, as a hash of one bit less has it."""
    bits = np.unpackbits(signatures.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(bits[:, ::2] | bits[:, 1::2], axis=1, bitorder="little").view(np.uint64)


def most_shared(mine: np.ndarray, others: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
    """An upper bound of what a set shares with others: bits that both have, and as many more
    as grams of either lie on a bit of another gram."""
    both = np.bitwise_count(mine & others).sum(axis=1).astype(np.int64)
    spare = size - int(np.bitwise_count(mine).sum())
    return both + np.minimum(spare, sizes - np.bitwise_count(others).sum(axis=1).astype(np.int64))


def _may_link(key, own, label, code, size, known, exact: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of the nodes of two blocks: a place, places of others in different components that it may
    be linked with, and the most they may share; each pair once. By signatures, and `exact` by
    the prints that these cannot refute."""
    signs, own_prints = zip(*(unpacked(x, int(n)) for x, n in zip(known, size, strict=True)), strict=True)
    widths = np.array([len(x) for x in signs])
    least_of = lambda a, b: -(-PERCENT * (size[a] + size[b]) // (100 + PERCENT))
    for width in np.unique(widths):
        same, wider = np.flatnonzero(widths == width), np.flatnonzero(widths == 2 * width)
        view = lambda rows: np.stack([signs[k] for k in rows])
        place = np.concatenate([same, wider])
        table = np.concatenate([view(same), folded(view(wider))]) if len(wider) else view(same)
        for k, me in enumerate(same):
            rest = place[k + 1 :]
            may = (label[rest] != label[me]) & sizes_fit(code[rest], code[me])
            if key[1] != key[2]:
                may &= own[rest] != own[me]
            at = np.flatnonzero(may) + k + 1
            if not len(at):
                continue
            most = most_shared(table[k], table[at], size[me], size[place[at]])
            enough = most >= least_of(me, place[at])
            rest, most = place[at[enough]], most[enough]
            told = [j for j, other in enumerate(rest) if own_prints[other] is not None] if exact else []
            if told and own_prints[me] is not None:
                most[told] = shared_prints(own_prints[me], [own_prints[rest[j]] for j in told])
                enough = most >= least_of(me, rest)
                rest, most = rest[enough], most[enough]
            if len(rest):
                yield int(me), rest, most


def _by_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of each pair of blocks, as `_blocks` sorts them: its key, then columns."""
    names = ("own", "label", "node", "code", "shared", "size")
    key, held = None, []

    def whole():
        *parts, known = zip(*held, strict=True)
        return key, *(np.concatenate(x) for x in parts), sum(known, [])

    for batch in batches:
        keys = [np.asarray(batch.column(n)) for n in ("list", "low", "high")]
        rows = [np.asarray(batch.column(n)) for n in names]
        known = batch.column("bits").to_pylist()
        if not batch.num_rows:
            continue
        cuts = np.append(np.unique(_first_of_run(*keys)), batch.num_rows)
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            here = tuple(int(k[begin]) for k in keys)
            if here != key:
                if held:
                    yield whole()
                key, held = here, []
            held.append([*(x[begin:end] for x in rows), known[begin:end]])
    if held:
        yield whole()


def _refuted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same of long lists, by pairs of blocks: of all pairs, those whose whole sets may share
    enough by what blocks know of them."""
    for key, own, label, node, code, shared, size, known in _by_blocks(batches):
        found = [(np.full(len(rest), me), rest) for me, rest, _ in _may_link(key, own, label, code, size, known, True)]
        if found:
            one, two = (np.concatenate(x) for x in zip(*found, strict=True))
            yield _pair_batch(one, two, node, code, shared)


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block's nodes: the pair (a, b) with the one of another component that it may be
    most alike, if enough, and how much. A row for a node at most."""
    for key, own, label, node, code, shared, size, known in _by_blocks(batches):
        best, other = np.zeros(len(node)), np.full(len(node), -1)
        for me, rest, most in _may_link(key, own, label, code, size, known, False):
            alike = most / (size[me] + size[rest] - most)
            j = int(np.argmax(alike))
            if alike[j] > best[me]:
                best[me], other[me] = alike[j], rest[j]
            more = alike > best[rest]
            best[rest[more]], other[rest[more]] = alike[more], me
        one = np.flatnonzero(other >= 0)
        a, b = np.minimum(node[one], node[other[one]]), np.maximum(node[one], node[other[one]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (node[one], a, b, best[one])], names=["node", "a", "b", "alike"]
        )


def _blocks(
    members: DataFrame, *more: str, wide: DataFrame | None = None, deal: int | None = None
) -> DataFrame:
    """The nodes of each list, those of a long one in blocks of about MEMBERS: a row for every
    pair of blocks that a node is to be paired in, and `more` columns of the node. With a number
    `deal`, a row for each node, to be paired in its own block; others are in it by another
    number. Columns of the table `wide` of nodes are joined last, so they are dealt to blocks
    only once."""
    load = members.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("salts"))
    seed = [] if deal is None else ["list", F.lit(deal)]
    own = F.pmod(F.xxhash64("node", *seed), F.col("salts")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)) if deal is None else own
    rows = (
        members.join(load, "list")
        .select("*", own.alias("own"), others.alias("other"))
        .select(
            "list", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
            "own", "node", "code", "shared", *more,
        )
    )
    if wide is not None:
        rows = rows.join(wide, "node")
    return rows.repartition("list", "low", "high").sortWithinPartitions("list", "low", "high", "own", "node")


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of a list's nodes, by pairs of blocks; rows come as `_blocks` sorts them."""

    def pairs(key, own, node, code, shared):
        split = int(np.searchsorted(own, key[2], "left"))
        out = []
        for j in range(split if key[1] != key[2] else 1, len(node)):
            end = split if key[1] != key[2] else j
            near = np.flatnonzero(sizes_fit(code[:end], code[j]))
            swap = node[near] > node[j]
            one, two = np.where(swap, node[j], node[near]), np.where(swap, node[near], node[j])
            codes = np.where(swap, code[j], code[near]), np.where(swap, code[near], code[j])
            out.append(np.stack([one, two, *codes, np.full(len(near), shared[0])]))
        if out:
            found = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in found], names=["a", "b", "code_a", "code_b", "shared"]
            )

    key, held = None, []
    for batch in batches:
        keys = [np.asarray(batch.column(n)) for n in ("list", "low", "high")]
        rows = [np.asarray(batch.column(n)) for n in ("own", "node", "code", "shared")]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        cuts = np.append(np.flatnonzero(new), batch.num_rows)
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            here = tuple(int(k[begin]) for k in keys)
            if here != key:
                if held:
                    yield from pairs(key, *(np.concatenate(x) for x in zip(*held, strict=True)))
                key, held = here, []
            held.append([x[begin:end] for x in rows])
    if held:
        yield from pairs(key, *(np.concatenate(x) for x in zip(*held, strict=True)))


def _enough(pairs: DataFrame, part: float = 1.0) -> DataFrame:
    """Sum per pair what fragments have counted, and keep (a, b) that may be alike; or those
    with a part of what that takes."""
    summed = pairs.groupBy("a", "b").agg(
        F.sum("shared").alias("shared"), F.max("code_a").alias("code_a"), F.max("code_b").alias("code_b")
    )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, a, b = (np.asarray(batch.column(n)) for n in ("shared", "code_a", "code_b"))
            yield batch.filter(pa.array(shared >= needed(a, b) * part)).select(["a", "b", "shared"])

    return summed.mapInArrow(keep, "a long, b long, shared long")


def _wanted(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of nodes with two bits each, as bits; of bounded size. What it passes
    without need is only carried on to a join."""
    longs = min(MAX_WANTED_LONGS, 1 << max(4, (nodes.count() // 4).bit_length()))
    # A node is a hash: its low bits and its high bits serve as they are.
    spread = F.array(F.col("node"), F.shiftrightunsigned("node", 34))
    bits = nodes.select(F.explode(spread).alias("bit")).select(
        F.col("bit").bitwiseAND(F.lit(longs * 64 - 1)).alias("bit")
    )
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))
    out = np.zeros(longs, np.int64)
    for row in bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(mask).alias("bits")).collect():
        out[row["at"]] = row["bits"]
    return out.view(np.uint64)


def _passes(nodes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    out = np.ones(len(nodes), bool)
    for spread in (nodes.view(np.uint64), nodes.view(np.uint64) >> np.uint64(34)):
        bit = spread & np.uint64(len(wanted) * 64 - 1)
        out &= (wanted[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return out


def _segments(sent):
    """The whole sets of some nodes, by segment, and as segment -1 what blocks know of others;
    once for a node in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, whole, signed = sent.value
        seen: set[int] = set()
        for _, sets in _sets(batches):
            own = sets.nodes()
            chosen = []
            cut, marked = _passes(own, whole), _passes(own, signed)
            for i in np.flatnonzero((sets.size > 0) & (cut | marked)):
                if int(own[i]) not in seen:
                    seen.add(int(own[i]))
                    chosen.append(int(i))
            if len(seen) > 1 << 20:
                seen.clear()  # a set may come twice then, which does not count
            place, _ = sets.ordered(frequent)
            rows = []
            for i in chosen:
                mine = place[sets.first[i] : sets.first[i + 1]]
                if cut[i]:
                    cuts = np.searchsorted(mine >> np.uint64(64 - SEGMENTS), np.arange((1 << SEGMENTS) + 1))
                    rows += [
                        (int(own[i]), k, len(mine), mine[cuts[k] : cuts[k + 1]].tobytes())
                        for k in np.flatnonzero(np.diff(cuts))
                    ]
                if marked[i]:
                    rows.append((int(own[i]), -1, len(mine), packed(mine)))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["node", "segment", "size", "grams"],
            )

    return run


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (a, segment, salt), a's own first: count what each b shares with it."""
    key, own, size_a, last = None, None, None, None
    for batch in batches:
        rows = []
        for a, segment, salt, b, size, grams in zip(
            *(batch.column(n).to_pylist() for n in ("a", "segment", "salt", "b", "size", "grams")),
            strict=True,
        ):
            mine = np.frombuffer(grams, np.uint64)
            if b is None:
                key, own, size_a, last = (a, segment, salt), mine, size, None
            elif (a, segment, salt) == key and b != last:
                last = b
                at = np.searchsorted(own, mine)
                shared = int((own[np.minimum(at, len(own) - 1)] == mine).sum())
                if shared:
                    rows.append((a, b, size_a, size, shared))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
            names=["a", "b", "size_a", "size_b", "overlap"],
        )


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are alike enough, by partial overlaps of segments.

    The segments of `a` go to the tasks that have its partners; a node with very many is sent
    to several, MEMBERS partners each. `sets` may have a segment more than once."""
    load = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("salts"))
    # Nodes with more partners than MEMBERS: at most one for so many pairs.
    many = F.broadcast(load.where("salts > 1"))
    partners = pairs.join(many, "a", "left").select(
        F.col("b").alias("node"),
        "a",
        F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"),
        "b",
    )
    own = load.select(
        F.col("a").alias("node"),
        "a",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.lit(None).cast("long").alias("b"),
    )
    return (
        partners.unionByName(own)
        .join(sets, "node")
        .select("a", "segment", "salt", "b", "size", "grams")
        .repartition("a", "segment", "salt")
        .sortWithinPartitions("a", "segment", "salt", F.asc_nulls_first("b"))
        .mapInArrow(_overlap, OVERLAPS)
        .groupBy("a", "b")
        .agg(F.sum("overlap").alias("both"), F.max("size_a").alias("m"), F.max("size_b").alias("n"))
        .filter(F.col("both") * 100 >= (F.col("m") + F.col("n") - F.col("both")) * PERCENT)
        .select("a", "b")
    )


def _frequent_bits(described: DataFrame, cells: int, grams: int) -> np.ndarray:
    limit = max(64, FREQUENT * -(-grams // cells))
    size = min(cells, 1 << 16)
    slices = cells // size
    merged = stored(
        described.filter("slice is not null").select("slice", "counts")
        .repartition(min(slices, 256), "slice").sortWithinPartitions("slice")
        .mapInArrow(_sum_counts(limit), "slice int, bits binary"),
        "jaccard-frequent",
    )
    bits = np.zeros(cells // 8, np.uint8)
    for row in merged.toLocalIterator():
        bits[row["slice"] * size // 8 : (row["slice"] + 1) * size // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


def links_of(
    texts: DataFrame, frequent: np.ndarray, grams: int, bucket_bytes: int = BUCKET_BYTES,
    every: bool = False,
) -> DataFrame:
    """Links (a, b) of nodes such that their components are those of all links; or every link."""
    spark = texts.sparkSession
    bits = max(1, (grams * 4 // bucket_bytes).bit_length() + 1)
    sent = spark.sparkContext.broadcast(frequent)
    met = stored(
        texts.mapInArrow(_prefixes(sent, bits + FINER), ENTRIES)
        .repartition(1 << bits, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_meet, MET),
        "jaccard-met",
    )
    # Counts of the first round are too low: a pair may also meet where another node is least.
    pairs = stored(_enough(met.filter("list is null"), part=0.3), "jaccard-pairs")
    members = stored(
        met.filter("list is not null")
        .select("list", "shared")
        .mapInArrow(_members, "list long, node long, code long, shared long")
        .groupBy("list", "node")
        .agg(F.max("code").alias("code"), F.sum("shared").alias("shared")),
        "jaccard-lists",
    )
    long = stored(
        members.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHORT).select("list"),
        "jaccard-long",
    )
    in_long = members.join(long, "list", "left_semi").select("node").distinct()
    nodes = _nodes_of(pairs)
    sets = stored(_sets_of(texts, frequent, nodes if every else nodes.union(in_long), in_long), "jaccard-sets")
    first = stored(verified(pairs, sets.where("segment >= 0")), "jaccard-links")
    tried = pairs.select("a", "b")
    if every:
        inside = _blocks(members).mapInArrow(
            _within, "a long, b long, code_a long, code_b long, shared long"
        )
    else:
        first, tried = _nearest_linked(members, long, sets, first, tried)
        inside = _apart(members, components(first), long, sets)
    # A pair of the first round may have met in more grams than those of its least node, so
    # only what was verified is left out.
    rest = stored(_enough(inside).join(tried, ["a", "b"], "left_anti"), "jaccard-rest")
    left = rest.count()
    if not left:
        return first
    nodes = _nodes_of(rest)
    sets = _sets_of(texts, frequent, nodes, in_long.limit(0))
    # Where pairs are few for their nodes, a round that deals all sets once more saves nothing.
    if every or left <= PAIRS_A_NODE * nodes.count():
        return first.union(stored(verified(rest, sets), "jaccard-links"))
    return _connected(first, rest, stored(sets, "jaccard-sets"))


def _connected(links: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """`links`, and as many of the pairs (a, b, shared) that are alike enough as give the same
    components as all of them.

    Each node's pair of the most shared grams is verified first, so a group of nodes becomes one
    component by pairs in proportion to their number; pairs inside a component then need no
    verification. All that is left is verified."""
    end = lambda c: pairs.select(F.col(c).alias("node"), "a", "b", "shared")
    # Of equal ones that with the least node, where those of a group meet.
    nearest = F.max_by(F.struct("a", "b"), F.struct("shared", F.bitwise_not("a"), F.bitwise_not("b"))).alias("pair")
    best = stored(
        end("a").union(end("b")).groupBy("node").agg(nearest).select("pair.a", "pair.b").distinct(),
        "jaccard-nearest",
    )
    links = links.union(stored(verified(best, sets), "jaccard-links"))
    labels = components(links)
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    pairs = stored(
        pairs.join(best, ["a", "b"], "left_anti")
        .join(of("a"), "a", "left")
        .join(of("b"), "b", "left")
        .where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b"))
        .select("a", "b", "shared"),
        "jaccard-rest",
    )
    if pairs.isEmpty():
        return links
    # Sets of nodes that are in no such pair need not be dealt out again.
    sent = pairs.sparkSession.sparkContext.broadcast(_wanted(_nodes_of(pairs)))

    def still(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_passes(np.asarray(batch.column("node")), sent.value)))

    return links.union(stored(verified(pairs, sets.mapInArrow(still, SETS)), "jaccard-links"))


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _sets_of(texts: DataFrame, frequent: np.ndarray, whole: DataFrame, signed: DataFrame) -> DataFrame:
    """Rows of SETS: the sets of some nodes, by segment, and the signatures of some."""
    sent = texts.sparkSession.sparkContext.broadcast((frequent, _wanted(whole), _wanted(signed)))
    return texts.mapInArrow(_segments(sent), SETS)


def _spread(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The nodes of lists that lie in several components, and the label of each node's."""
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    spread = (
        labelled.groupBy("list")
        .agg(F.min("label").alias("least"), F.max("label").alias("most"))
        .where("least < most")
        .select("list")
    )
    return stored(labelled.join(spread, "list", "left_semi"), "jaccard-apart")


def _known(sets: DataFrame) -> DataFrame:
    """What blocks know of nodes of long lists."""
    return sets.where("segment = -1").dropDuplicates(["node"]).select("node", "size", F.col("grams").alias("bits"))


def _nearest_linked(
    members: DataFrame, long: DataFrame, sets: DataFrame, links: DataFrame, tried: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """`links` and those of the pairs that nodes of long lists make with their nearest; and the
    pairs `tried` with these.

    Nodes are paired in their own block only, and of its nearest in all lists a node keeps one.
    That makes one component of what is linked in a block, and dealt anew, of several blocks."""
    members = members.join(long, "list", "left_semi")
    for deal in range(DEALS):
        apart = _spread(members, components(links))
        if apart.isEmpty():
            break
        blocks = _blocks(apart, "label", wide=_known(sets), deal=deal)
        near = blocks.mapInArrow(_nearest, "node long, a long, b long, alike double")
        best = F.max_by(F.struct("a", "b"), F.struct("alike", F.bitwise_not("a"), F.bitwise_not("b"))).alias("pair")
        pairs = stored(
            near.join(tried, ["a", "b"], "left_anti").groupBy("node").agg(best).select("pair.a", "pair.b").distinct(),
            "jaccard-nearest",
        )
        links = links.union(stored(verified(pairs, sets.where("segment >= 0")), "jaccard-links"))
        tried = tried.union(pairs)
    return links, tried


def _apart(members: DataFrame, labels: DataFrame, long: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of a list's nodes that lie in different components. In long lists, which would
    make pairs by the square of their number, whole sets refute pairs before there is a row."""
    pair = "a long, b long, code_a long, code_b long, shared long"
    apart = _spread(members, labels)
    few = (
        apart.join(long, "list", "left_anti")
        .repartition("list")
        .sortWithinPartitions("list", "label", "node")
        .mapInArrow(_across, pair)
    )
    many = apart.join(long, "list", "left_semi")
    return few.unionByName(_blocks(many, "label", wide=_known(sets)).mapInArrow(_refuted, pair))


def _link_counts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, n_links): how many rows each row of a node is linked with."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = (
        both.join(nodes.select(F.col("node").alias("b"), "rows"), "b")
        .groupBy(F.col("a").alias("node"))
        .agg(F.sum("rows").alias("others"))
    )
    n_links = F.col("rows") - 1 + F.coalesce("others", F.lit(0))
    return stored(
        nodes.join(others, "node", "left").select("node", n_links.alias("n_links")), "jaccard-counts"
    )


def linked_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_rows: int = 250_000,
    count_links: bool = False,
) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links lead to) of every row; and
    n_links, the rows it is linked with, if they are to be counted."""
    spark = docs.sparkSession
    texts = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")
    )
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    grams = size // 6
    cells = min(MAX_CELLS, max(1 << 10, 1 << (grams // LOAD).bit_length()))
    described = stored(texts.mapInArrow(_describe(cells), ROWS), "jaccard-rows")
    rows = described.filter("slice is null").select("doc_id", "n_shingles", "node")
    frequent = _frequent_bits(described, cells, grams)
    links = links_of(texts, frequent, grams, every=count_links)
    labels = components(links)

    nodes = stored(
        rows.filter("node is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
        .join(labels, "node", "left")
        .withColumn("label", F.coalesce("label", "node")),
        "jaccard-nodes",
    )
    least = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "label").select("node", "rows", "component_id")
    if count_links:
        named = named.join(_link_counts(nodes, links), "node")
    # One set may have a third of all rows: such sets, at most one for each heavy_rows rows,
    # meet their rows by broadcast, the others by a shuffle.
    heavy = F.broadcast(named.filter(F.col("rows") > heavy_rows).drop("rows"))
    light = named.filter(F.col("rows") <= heavy_rows).drop("rows")
    full = rows.filter("node is not null")
    out = full.join(heavy, "node").unionByName(full.join(heavy, "node", "left_anti").join(light, "node"))
    alone = rows.filter("node is null").withColumn("component_id", F.col("doc_id"))
    if count_links:
        alone = alone.withColumn("n_links", F.lit(0).cast("long"))
    columns = ["doc_id", "n_shingles", "component_id"] + ["n_links"] * count_links
    return out.unionByName(alone).select(*columns)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs`, of which each component keeps the row with the least id (the first of several).
    Documents stay where they are read, if their number allows. The rows must come from a stored table, since they are numbered by their place."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    numbered = docs.select(
        F.struct(*columns).alias("document"),
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    linked = linked_documents(numbered, "row", "text").withColumnRenamed("doc_id", "row")
    ids = linked.join(numbered.select("row", "id"), "row")
    # Null ids last, then the first row.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    kept = ids.groupBy("component_id").agg(first).select("first.row")
    if docs.count() <= ROWS_AS_BITS:
        # Rows are numbered where they are read: a word has the bits of 64 neighbours.
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("row").bitwiseAND(F.lit(63)).cast("int"))
        words = kept.groupBy(F.shiftright("row", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
        stays = F.getbit("bits", F.col("row").bitwiseAND(F.lit(63)).cast("int")) == 1
        same = F.shiftright("row", 6) == F.col("word")
        left = numbered.join(F.broadcast(stored(words, "jaccard-kept")), same).where(stays)
    else:
        left = numbered.join(kept, "row", "left_semi")
    return left.select(*[F.col("document").getField(c).alias(c) for c in docs.columns])


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return linked_documents(docs)


def op4_jaccard_links(spark, sf_dir: str) -> DataFrame:
    """As op4_jaccard_join, whose SQL has three columns, and the number of links."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return linked_documents(docs, count_links=True)


OP4_SQL = """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words
  from documents
), g as (
  select distinct doc_id, md5(array_to_string(words[i:i + 4], ' ')) as gram
  from (select doc_id, words, unnest(case when len(words) = 0 then []
    else range(1, greatest(len(words) - 3, 2)) end) as i from w)
), n as (
  select doc_id, count(*) as n from g group by doc_id
), s as (
  select doc_id, md5(string_agg(gram, '' order by gram)) as node from g group by doc_id
), r as (
  select node, min(s.doc_id) as doc_id, any_value(n.n) as n from s join n using (doc_id) group by node
), rg as (
  select r.doc_id, r.n, g.gram from r join g on g.doc_id = r.doc_id
), o as (
  select a.doc_id as a, b.doc_id as b, a.n as m, b.n as n, count(*) as shared
  from rg a join rg b on a.gram = b.gram and a.doc_id < b.doc_id
    and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  group by all
), l as (
  select a, b from o where 100 * shared >= 75 * (m + n - shared)
), e as (
  select a, b from l union select b, a from l
), c(node, label) as (
  select doc_id, doc_id from r
  union
  select e.b, c.label from c join e on e.a = c.node
), m as (
  select node, min(label) as component_id from c group by node
)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(m.component_id, w.doc_id) as component_id
from w left join n using (doc_id) left join s using (doc_id) left join r on s.node = r.node
left join m on m.node = r.doc_id
"""

# The same, and for each row the rows of its set and of all sets linked with it, less itself.
OP4_LINKS_SQL = (
    OP4_SQL.replace(
        """
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles,""",
        """, k as (
  select node, count(*) as copies from s group by node
), x as (
  select e.a, sum(k.copies) as others from e join r on e.b = r.doc_id join k using (node) group by e.a
)
select w.doc_id, coalesce(k.copies - 1 + coalesce(x.others, 0), 0)::bigint as n_links,
  coalesce(n.n, 0)::bigint as n_shingles,""",
    ).rstrip()
    + " left join k on k.node = r.node left join x on x.a = r.doc_id\n"
)
