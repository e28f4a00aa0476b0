"""Intervals, subtree edits and sample files as streams."""

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.spr import replayed
from ..sources.scratch import scratch_folder


def _tiled(intervals: DataFrame, width: int, late: str) -> DataFrame:
    """Intervals cut at tiles of `width` positions, with the tile's end as event time. Positions are read as seconds."""
    tiled = intervals.withColumn("tile", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))))
    return tiled.withColumn("time", F.timestamp_seconds(F.col("tile") * width)).withWatermark("time", late)


def stream_window_counts(intervals: DataFrame, width: int, late: str = "1 hour") -> DataFrame:
    """Per chromosome and tile of `width` positions: intervals that touch it and the sum of their value.

    Spark's event-time watermark drops the state of tiles that no interval can
    touch any more. Input must be roughly start-sorted; what is later than
    `late` is dropped by Spark and counted in its metrics.
    """
    return _tiled(intervals, width, late).groupBy("chrom", F.window("time", f"{width} seconds")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def stream_segments(intervals: DataFrame, width: int, late: str = "1 hour") -> DataFrame:
    """chrom, start, stop, n, total: the segments of constant membership with the number of intervals that cover each and the sum of their values, as soon as no interval can touch their tile any more.

    Segments are cut at tiles: neighbours on both sides of a tile's end with the
    same members are two rows. A tile's intervals are held in state until the
    watermark passes it, so `width` bounds what one key holds. Gaps give no row.
    """
    held = F.struct(F.greatest("start", F.col("tile") * width).alias("start"), F.least("stop", (F.col("tile") + 1) * width).alias("stop"), F.col("value").cast("double").alias("value"))
    tiles = _tiled(intervals, width, late).groupBy("chrom", F.window("time", f"{width} seconds")).agg(F.collect_list(held).alias("held"))
    ends = F.array_sort(F.array_distinct(F.flatten(F.transform("held", lambda x: F.array(x["start"], x["stop"])))))
    pairs = F.zip_with(F.slice("ends", 1, F.size("ends") - 1), F.slice("ends", 2, F.size("ends")), lambda a, b: F.struct(a.alias("start"), b.alias("stop")))
    cut = tiles.withColumn("ends", ends).select("chrom", "held", F.explode(pairs).alias("part"))
    over = F.filter("held", lambda x: (x["start"] <= F.col("part.start")) & (x["stop"] >= F.col("part.stop")))
    found = cut.select("chrom", "part.start", "part.stop", over.alias("over")).filter("size(over) > 0")
    return found.select("chrom", "start", "stop", F.size("over").alias("n"), F.aggregate("over", F.lit(0.0), lambda s, x: s + x["value"]).alias("total"))


_OPEN = "starts array<long>, stops array<long>, values array<double>, done long"


def _settled(starts, stops, values, done: int | None, until: int):
    """Segments of constant membership that end at `until` at the latest, from `done` on, and where the last of them ends."""
    ends = np.unique(np.concatenate((starts, stops)))
    ends = ends[(ends <= until) & (ends >= (done if done is not None else ends[0]))]
    if len(ends) < 2:
        return [], done
    change, total = np.zeros(len(ends) + 1, np.int64), np.zeros(len(ends) + 1)
    for places, sign in ((np.searchsorted(ends, starts), 1), (np.searchsorted(ends, stops), -1)):
        np.add.at(change, places, sign)
        np.add.at(total, places, sign * values)
    n, sums = np.cumsum(change)[: len(ends) - 1], np.cumsum(total)[: len(ends) - 1]
    # what began before the first end counts from it on
    rows = [(int(a), int(b), int(k), float(t)) for a, b, k, t in zip(ends, ends[1:], n, sums) if k > 0]
    return rows, int(ends[-1])


def stream_maximal_segments(intervals: DataFrame, late: int = 0) -> DataFrame:
    """chrom, start, stop, n, total as stream_segments(), but not cut at tiles: a segment is given once no interval can end or begin inside it any more.

    An interval may come at most `late` positions behind the largest start so
    far. The state of a chromosome is the intervals that go on beyond what has
    been given, carried from batch to batch; a chromosome is one key. A last
    interval beyond all others settles the rest and is itself never given.
    """

    def step(key, frames, state):
        new = pd.concat(list(frames))
        starts, stops, values = (new[c].to_numpy(kind) for c, kind in (("start", np.int64), ("stop", np.int64), ("value", float)))
        done = None
        if state.exists:
            a, b, v, done = state.get
            done = done if done >= 0 else None
            starts, stops, values = np.concatenate((a, starts)).astype(np.int64), np.concatenate((b, stops)).astype(np.int64), np.concatenate((v, values)).astype(float)
        rows, done = _settled(starts, stops, values, done, int(starts.max()) - late)
        keep = stops > (done if done is not None else -1)
        state.update((starts[keep].tolist(), stops[keep].tolist(), values[keep].tolist(), done if done is not None else -1))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["chrom", "start", "stop", "n", "total"])

    return intervals.groupBy("chrom").applyInPandasWithState(step, "chrom string, start long, stop long, n long, total double", _OPEN, "append", "NoTimeout")


_REPLAYED = "sample long, chrom string, start long, stop long, ptree array<int>, age array<double>"
#: Keys of the replay's state.
BUCKETS = 1024


def stream_replay(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """sample, chrom, start, stop, ptree, age: each block once the edit behind it has come.

    events: sample, chrom, pos, and either a tree (ptree, age), which starts the
    sample's chromosome anew, or an edit (recomb_node, coal_node, coal_time).
    Events of a batch are taken in order of pos; batches must come in that order.
    A key is a bucket of the histories, by a hash: its state is the current tree
    of each of them, and a batch's events are replayed for all of them at once.
    Very many histories need more buckets.
    """

    def step(key, frames, state):
        new = pd.concat(list(frames)).sort_values(["sample", "chrom", "pos"], kind="stable", ignore_index=True)
        current = pickle.loads(state.get[0]) if state.exists else {}
        sample, chrom, pos = (new[c].to_numpy() for c in ("sample", "chrom", "pos"))
        planted = new["ptree"].notna().to_numpy()
        head = planted.copy()
        head[0] = True
        head[1:] |= (sample[1:] != sample[:-1]) | (chrom[1:] != chrom[:-1])
        # a run is a tree and the edits up to the next tree or history; edits before any tree tell nothing
        run, at = np.cumsum(head) - 1, np.flatnonzero(head)
        names = list(zip(sample[at].tolist(), chrom[at].tolist()))
        given = [(new["ptree"][i], new["age"][i], int(pos[i])) if planted[i] else current.get(name) for i, name in zip(at.tolist(), names)]
        held = np.array([g is not None for g in given])
        number = np.cumsum(held) - 1
        edit = np.flatnonzero(~planted & held[run])
        names, given = [n for n, g in zip(names, given) if g is not None], [g for g in given if g is not None]
        count = np.bincount(number[run[edit]], minlength=len(given))
        first, own, begin = np.cumsum(count) - count, pos[edit].astype(np.int64), np.array([g[2] for g in given], np.int64)
        trees = (np.concatenate([np.zeros(0), *(g[k] for g in given)]) for k in (0, 1))
        columns = (new[c].to_numpy()[edit].astype(t) for c, t in (("recomb_node", np.int64), ("coal_node", np.int64), ("coal_time", float)))
        out = []
        for rows, i, p, a, size in replayed(*trees, np.array([len(g[0]) for g in given], np.int64), *columns, count):
            starts = (begin[rows] if i == 0 else own[first[rows] + i - 1]).tolist()
            cut = np.cumsum(size)[:-1]
            for r, start, tree, age, more in zip(rows.tolist(), starts, np.split(p.astype(np.int32), cut), np.split(a, cut), (count[rows] > i).tolist()):
                if more:
                    out.append((*names[r], start, own[first[r] + i], tree, age))
                elif r + 1 == len(names) or names[r + 1] != names[r]:  # a later tree of the history counts instead
                    current[names[r]] = (tree, age, start)
        state.update((pickle.dumps(current),))
        yield pd.DataFrame(out, columns=["sample", "chrom", "start", "stop", "ptree", "age"])

    bucket = F.pmod(F.xxhash64("sample", "chrom"), F.lit(buckets))
    return events.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(step, _REPLAYED, "trees binary", "append", "NoTimeout")


def stream_sample_files(spark, path: str, schema: str) -> DataFrame:
    """New sample files of a growing folder as they come, with the sample number from the file's name."""
    return spark.readStream.schema(schema).parquet(path).withColumn("sample", F.regexp_extract(F.col("_metadata.file_path"), r"\.(\d+)\.[^/]*(?:/part-[^/]*)?$", 1).cast("long"))


def run_in_parts(make, parts: list[DataFrame], name: str) -> DataFrame:
    """What a stream gives of rows that come in parts: each part is written, the stream takes up what is new where it stopped, and its output is read back as a table. Files are in the shared folder."""
    spark, path = parts[0].sparkSession, scratch_folder(parts[0].sparkSession, name)
    parts[0].limit(0).write.parquet(f"{path}/in")  # a stream needs its folder
    out = make(spark.readStream.schema(parts[0].schema).parquet(f"{path}/in"))
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        query = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")
