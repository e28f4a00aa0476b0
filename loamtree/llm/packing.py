"""Packing token ids into sequences of one length, online and in bounded space."""

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import Vocabulary, encode_chunk
from .store import materialize
from .textbytes import chunks

#: Ids in a sequence, open windows of a partition, the smallest gap that is filled by a cut, and the partitions whose leftovers meet in one task.
LENGTH, OPEN, MIN_CUT, FAN = 1024, 64, 16, 256
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


class Packer:
    """Open windows, each a list of pieces (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_id: int, length: int = LENGTH, open_windows: int = OPEN, min_cut: int = MIN_CUT):
        self.next_id, self.length, self.most, self.min_cut = first_id, length, open_windows, min_cut
        self.free: list[tuple[int, int]] = []  # (free ids, window), ascending
        self.windows: dict[int, list] = {}
        self.made = 0
        self.rows: list[tuple] = []

    def _open(self, piece) -> None:
        self.made += 1
        self.windows[self.made] = [piece]
        self._hold(self.length - len(piece[2]), self.made)

    def _hold(self, free: int, window: int) -> None:
        if free:
            insort(self.free, (free, window))
        else:
            self._emit(window)

    def _emit(self, window: int, leftover: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in self.windows.pop(window):
            raw = ids.tobytes()
            self.rows.append((doc_id, start, len(ids), zlib.crc32(raw), doc_tokens, self.next_id, offset, raw if leftover else None))
            offset += len(ids)
        self.next_id += 1

    def _put(self, place: int, piece) -> None:
        free, window = self.free.pop(place)
        self.windows[window].append(piece)
        self._hold(free - len(piece[2]), window)

    def add(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        while len(ids) >= self.length:
            self._open((doc_id, start, ids[: self.length], doc_tokens))
            start, ids = start + self.length, ids[self.length :]
        if not len(ids):
            return
        place = bisect_left(self.free, (len(ids), 0))
        if place < len(self.free):
            self._put(place, (doc_id, start, ids, doc_tokens))
            return
        if len(self.free) >= self.most:
            gap = self.free[0][0]
            if gap >= self.min_cut:
                self._put(0, (doc_id, start, ids[:gap], doc_tokens))
                start, ids = start + gap, ids[gap:]
            else:
                self._emit(self.free.pop(0)[1])
        self._open((doc_id, start, ids, doc_tokens))

    def finish(self, last: bool) -> None:
        """Merges the open windows by cuts, the emptiest into the fullest. At most one stays; it is a leftover unless this is the last task."""
        while self.free and self.free[0][0] < self.min_cut:
            self._emit(self.free.pop(0)[1])
        while len(self.free) > 1:
            for doc_id, start, ids, doc_tokens in self.windows.pop(self.free.pop()[1]):
                while len(ids) and self.free:
                    gap = self.free[0][0]
                    self._put(0, (doc_id, start, ids[:gap], doc_tokens))
                    start, ids = start + min(gap, len(ids)), ids[gap:]
                if len(ids):
                    self._open((doc_id, start, ids, doc_tokens))
        for _, window in self.free:
            self._emit(window, leftover=not last)
        self.free = []

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * len(NAMES)
        self.rows = []
        types = [pa.int64()] * 7 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], NAMES)


def special_encode(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary, special: bytes, special_id: int):
    """encode_chunk() in which each occurrence of `special` is one id, and what stands before and behind it is encoded apart."""
    raw, found, at = data.tobytes(), [], 0
    while special and (at := raw.find(special, at)) >= 0:
        if not ((offsets > at) & (offsets < at + len(special))).any():
            found.append(at)
            at += len(special)
        else:
            at += 1
    if not found:
        return encode_chunk(data, offsets, vocabulary)
    marks = np.array(found)
    cuts = np.unique(np.concatenate((offsets, marks, marks + len(special))))
    ids, before = encode_chunk(data, cuts, vocabulary)
    sizes = np.diff(before)
    is_mark = np.isin(cuts[:-1], marks)
    keep = ~np.repeat(is_mark, sizes)
    keep[before[:-1][is_mark]] = True
    ids = ids.copy()
    ids[before[:-1][is_mark]] = special_id
    sizes[is_mark] = 1
    after = np.concatenate(([0], np.cumsum(sizes)))
    return ids[keep], after[np.searchsorted(cuts, offsets)]


def pack(
    docs: DataFrame, vocabulary_path: str, end_id: int = 0, special: str = "<|endoftext|>", special_id: int = 50256, length: int = LENGTH,
    open_windows: int = OPEN, min_cut: int = MIN_CUT, fan: int = FAN, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each input partition is packed where it is read. Of a document, whole
    sequences go out at once; the rest goes into the open window that it fills
    best. If none has room, the fullest is emitted, first filled up by a cut
    where its gap is `min_cut` or more. At its end a partition merges its open
    windows into one. These leftovers, under `length` ids a partition, meet in
    groups of `fan` partitions, again until one group is left.

    Null and empty texts are the end id alone. Repeated rows are packed each on
    their own; no rows give no rows; other columns are ignored.
    """

    def first(batches):
        vocabulary = Vocabulary.load(vocabulary_path)
        packer = Packer(TaskContext.get().partitionId() << 32, length, open_windows, min_cut)
        end = np.array([end_id], "<u4")
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for lo, hi, data, offsets in chunks(batch.column("text")):
                ids, before = special_encode(data, offsets, vocabulary, special.encode(), special_id)
                ids, at = ids.astype("<u4"), before.tolist()
                for i in range(hi - lo):
                    own = np.concatenate((ids[at[i] : at[i + 1]], end))
                    packer.add(doc_ids[lo + i], 0, own, len(own))
                if len(packer.rows) > 2000:
                    yield packer.batch()
        packer.finish(last=False)
        yield packer.batch()

    def again(level: int, last: bool):
        def merge(key, table):
            packer = Packer(level << 56 | key[0].as_py() << 32, length, open_windows, min_cut)
            rows = sorted(table.to_pylist(), key=lambda r: (r["sequence_id"], r["offset"]))
            for r in rows:
                packer.add(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])
            packer.finish(last)
            return pa.Table.from_batches([packer.batch()])

        return merge

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    packed = materialize(named.mapInArrow(first, COLUMNS), "pack-0")
    done, level = [packed.filter("ids IS NULL")], 0
    while True:
        left = packed.filter("ids IS NOT NULL").withColumn("group", F.expr(f"((sequence_id >> 32) & 16777215) div {fan}"))
        groups = left.agg(F.max("group")).first()[0]
        if groups is None:
            break
        level, last = level + 1, groups == 0
        packed = left.groupBy("group").applyInArrow(again(level, last), COLUMNS)
        packed = packed if last else materialize(packed, f"pack-{level}")
        done.append(packed.filter("ids IS NULL"))
        if last:
            break
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole.drop("ids")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
