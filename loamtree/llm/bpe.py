"""Byte-level BPE without regular expressions.

Pre-tokenisation works on code-point class arrays. Reading a text from left to
right, each code point either starts a token or leaves the running token as it
is. These transitions, "set the start to here" and "keep it", are closed under
composition, which is associative: the running start of every position is one
prefix scan (maximum.accumulate) over the starts. Where tokens start follows
from the classes of neighbouring code points and from the same scan over the
starts of documents.
"""

import base64
import hashlib
import heapq
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textbytes import chunks, distinct_slices, gather

OTHER, LETTER, NUMBER, BLANK = range(4)
#: Pre-tokens of at most CACHED_BYTES that are kept with their merges.
CACHE, CACHED_BYTES = 200_000, 128
PIECE_LIMIT = 64
NEVER = 1 << 40

#: What may follow an apostrophe to make a token of its own, and the white space of the pattern's \s.
SUFFIXES = ["s", "t", "re", "ve", "m", "ll", "d"]
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _classes() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[WHITE] = BLANK
    return table


class Ragged:
    """Rows of different sizes in one flat array."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, sizes
        self.starts = np.cumsum(sizes) - sizes

    @classmethod
    def of_bytes(cls, rows: list[bytes]) -> "Ragged":
        return cls(np.frombuffer(b"".join(rows), np.uint8), np.fromiter(map(len, rows), np.int64, len(rows)))

    def take(self, rows: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.starts[rows], self.sizes[rows])


class Vocabulary:
    """Ranks of byte strings and the merges of pre-tokens seen before; one per worker and file."""

    _loaded: dict[str, "Vocabulary"] = {}

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = Ragged.of_bytes(tokens)
        self.spelled = Ragged.of_bytes([b"%d " % i for i in range(size)])
        self.known = np.zeros(size, bool)
        self.known[list(self.ranks.values())] = True
        self.classes = _classes()
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self._pairs()
        self.cached: dict[bytes, int] = {}
        self.cached_ids = Ragged(np.zeros(0, np.int64), np.zeros(0, np.int64))

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _pairs(self) -> None:
        """A hash table with open addressing from two ids to the id of their joined bytes."""
        rank = self.ranks.get
        found = [(a << 32 | b, r) for token, r in self.ranks.items() for cut in range(1, len(token)) if (a := rank(token[:cut])) is not None and (b := rank(token[cut:])) is not None]
        self.bits = max(10, len(found).bit_length() + 2)
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.joined = np.zeros(1 << self.bits, np.int64)
        keys, ranks = (np.array(x, np.int64) for x in zip(*found))
        at = self._slot(keys)
        while len(keys):
            free = self.slots[at] < 0
            _, first = np.unique(at[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.slots[at[placed]], self.joined[at[placed]] = keys[placed], ranks[placed]
            rest = np.ones(len(keys), bool)
            rest[placed] = False
            keys, ranks, at = keys[rest], ranks[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id, and so the rank, of each pair's joined bytes; NEVER where there is none."""
        keys = left << 32 | right
        at = self._slot(keys)
        out = np.full(len(keys), NEVER, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            there = self.slots[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.joined[at[hit]]
            go = ~hit & (there >= 0)
            todo, at = todo[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Ragged:
        """The ids of each slice: the adjacent pair of lowest rank is merged, the leftmost of equals, until none has a rank.

        All slices take their next merge at once; those that are done leave.
        """
        sizes = ends - starts
        out: list[np.ndarray | None] = [None] * len(starts)
        long = np.flatnonzero(sizes > PIECE_LIMIT)
        raw = data.tobytes() if len(long) else b""
        for i in long.tolist():
            out[i] = np.array(self._merge_long(raw[starts[i] : ends[i]]), np.int64)
        short = np.flatnonzero(sizes <= PIECE_LIMIT)
        done_ids, done_piece = [], []
        ids = self.single[gather(data, starts[short], sizes[short])]
        piece = np.repeat(np.arange(len(short)), sizes[short])
        rank = np.full(len(ids), NEVER, np.int64)
        pair = np.flatnonzero(piece[1:] == piece[:-1])
        rank[pair] = self.join(ids[pair], ids[pair + 1])
        while len(ids):
            head = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
            counts = np.diff(np.append(head, len(ids)))
            best = np.minimum.reduceat(rank, head)
            open_ = np.repeat(best < NEVER, counts)
            done_ids.append(ids[~open_])
            done_piece.append(piece[~open_])
            at = np.flatnonzero(open_ & (rank == np.repeat(best, counts)))
            if not len(at):
                break
            at = at[np.concatenate(([True], piece[at[1:]] != piece[at[:-1]]))]
            ids[at] = rank[at]
            keep = open_
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            ids, piece, rank, at = ids[keep], piece[keep], rank[keep], moved[at]
            touched = np.zeros(len(ids), bool)
            touched[at] = True
            touched[at[at > 0] - 1] = True
            rank[touched] = NEVER
            fresh = np.flatnonzero(touched[:-1] & (piece[1:] == piece[:-1]))
            rank[fresh] = self.join(ids[fresh], ids[fresh + 1])
        flat, owner = np.concatenate([*done_ids, ids[:0]]), np.concatenate([*done_piece, piece[:0]])
        flat = flat[np.argsort(owner, kind="stable")]
        counts = np.zeros(len(starts), np.int64)
        counts[short] = np.bincount(owner, minlength=len(short))
        if not len(long):
            return Ragged(flat, counts)
        bounds = np.cumsum(counts[short])
        for i, j, k in zip(short.tolist(), (bounds - counts[short]).tolist(), bounds.tolist()):
            out[i] = flat[j:k]
        counts[long] = [len(out[i]) for i in long.tolist()]
        return Ragged(np.concatenate(out), counts)

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same for one slice by a heap of pairs, in n log n steps."""
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if end[i] < 0 or end[i] >= n or end[end[i]] != stop:
                continue
            gone = end[i]
            end[i], end[gone] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def lookup(self, tokens: list[bytes], often: np.ndarray) -> Ragged:
        """merge() of distinct pre-tokens through the cache, which takes in what occurs `often`. The bytes themselves are the key."""
        row = np.fromiter((self.cached.get(t, -1) for t in tokens), np.int64, len(tokens))
        miss = np.flatnonzero(row < 0)
        raw = Ragged.of_bytes([tokens[i] for i in miss.tolist()])
        fresh_sizes, fresh = raw.sizes, self.merge(raw.flat, raw.starts, raw.starts + raw.sizes)
        both = Ragged(np.concatenate((self.cached_ids.flat, fresh.flat)), np.concatenate((self.cached_ids.sizes, fresh.sizes)))
        row[miss] = len(self.cached) + np.arange(len(miss))
        result = Ragged(both.take(row), both.sizes[row])
        new = np.flatnonzero(often[miss] & (fresh_sizes <= CACHED_BYTES))
        if len(self.cached) + len(new) > CACHE:
            self.cached, self.cached_ids = {}, Ragged(fresh.flat[:0], fresh.sizes[:0])
        elif len(new):
            rows = np.concatenate((np.arange(len(self.cached)), len(self.cached) + new))
            self.cached.update(zip([tokens[i] for i in miss[new].tolist()], range(len(self.cached), len(rows))))
            self.cached_ids = Ragged(both.take(rows), both.sizes[rows])
        return result


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of valid UTF-8 and the byte at which each begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    if len(at) == len(data):
        return data.astype(np.uint32), at
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), at


def token_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Indices of the code points that start a token. first: whether a code point is the first of its document."""
    n = len(points)
    kind = classes[points]
    index = np.arange(n)
    change = first.copy()
    change[1:] |= kind[1:] != kind[:-1]
    document = np.maximum.accumulate(np.where(first, index, 0))

    start = change.copy()
    previous = np.empty(n, np.uint8)
    previous[1:], previous[:1] = kind[:-1], OTHER
    after_blank = change & ~first & (previous == BLANK)
    # The last white space of a run that a non-blank follows stands alone or, a space, leads the next token.
    last = np.flatnonzero(after_blank) - 1
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False

    # An apostrophe that starts a token takes a suffix with it; what follows the suffix starts anew.
    quote = np.flatnonzero((points == 0x27) & start)
    if len(quote):
        padded = np.concatenate((points, np.zeros(2, points.dtype)))
        same = np.concatenate((document, np.full(2, -1)))
        fits = lambda k: same[quote + k] == document[quote]
        free = np.ones(len(quote), bool)
        for suffix in sorted(SUFFIXES, key=len):
            hit = free.copy()
            for k, c in enumerate(suffix, 1):
                hit &= (padded[quote + k] == ord(c)) & fits(k)
            took = quote[hit]
            start[took + 1] = False
            behind = took + 1 + len(suffix)
            behind = behind[behind < n]
            start[behind[kind[behind] == LETTER]] = True
            free &= ~hit
    return np.flatnonzero(start)


def encode_chunk(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a chunk's documents, and the ids before each document (n+1)."""
    points, at = code_points(data)
    edges = np.zeros(len(data) + 1, bool)
    edges[offsets] = True
    starts = at[token_starts(points, edges[at], vocabulary.classes)] if len(at) else at
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    which, tokens = distinct_slices(data, starts, ends)
    distinct = vocabulary.lookup(tokens, np.bincount(which, minlength=len(tokens)) > 1)
    before = np.concatenate(([0], np.cumsum(distinct.sizes[which])))
    return distinct.take(which), before[np.searchsorted(starts, offsets)]


def encode_column(column: pa.Array, vocabulary: Vocabulary):
    """The ids of each document in turn; null counts as empty."""
    for lo, hi, data, offsets in chunks(column):
        ids, before = encode_chunk(data, offsets, vocabulary)
        for i in range(hi - lo):
            yield ids[before[i] : before[i + 1]]


def bpe_encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (array of int) and starts (byte offset of each id's first byte).

    Null and empty texts have no ids. Repeated rows give a row each; no rows
    give no rows; other columns are ignored. Memory is bounded by a chunk of
    documents, or by one document.
    """

    def encode(batches):
        vocabulary = Vocabulary.load(vocabulary_path)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                ids, before = encode_chunk(data, offsets, vocabulary)
                width = vocabulary.tokens.sizes[ids]
                place = np.cumsum(width) - width - np.repeat(offsets[:-1], np.diff(before))
                lists = [pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(x, t)) for x, t in ((ids, pa.int32()), (place, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *lists], ["doc_id", "ids", "starts"])

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return named.mapInArrow(encode, "doc_id long, ids array<int>, starts array<long>")


def decode_ids(ids: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    if not vocabulary.known[ids].all():
        raise ValueError("an id is not in the vocabulary")
    return vocabulary.tokens.take(ids)


def bpe_decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id and data (the bytes of the ids, in turn). A null list counts as empty; an unknown id fails the job."""

    def decode(batches):
        vocabulary = Vocabulary.load(vocabulary_path)
        for batch in batches:
            data = [decode_ids(np.array(ids or [], np.int64), vocabulary).tobytes() for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, data binary")


def bpe_digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, made where the document is encoded and decoded, without moving its ids."""

    def digests(values: np.ndarray, bounds: np.ndarray, cut: int) -> pa.Array:
        raw, at = values.tobytes(), bounds.tolist()
        return pa.array([hashlib.sha256(raw[a : b - cut if b > a else b]).hexdigest() for a, b in zip(at, at[1:])], pa.string())

    def digest(batches):
        vocabulary = Vocabulary.load(vocabulary_path)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                ids, before = encode_chunk(data, offsets, vocabulary)
                upto = lambda table: np.concatenate(([0], np.cumsum(table.sizes[ids])))[before]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(np.diff(before), pa.int64()),
                        digests(vocabulary.spelled.take(ids), upto(vocabulary.spelled), 1),
                        digests(decode_ids(ids, vocabulary), upto(vocabulary.tokens), 0),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return named.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
