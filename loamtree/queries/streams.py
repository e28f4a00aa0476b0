"""Stream forms: the tables come in parts, and a stream takes up each where it stopped. The SQL is that of the batch form."""

from pyspark.sql import functions as F

from ..catalogue import query
from ..sources.scratch import scratch_folder, stored
from ..streaming import segments
from ..tables import TRACKS_SQL, tracks
from .core import _SEGMENTS, rounded
from .histories import _WALK, _history


def _parts(spark, d, n=3):
    """The tracks in parts by start; and intervals beyond all others, which settle the rest."""
    t = stored(tracks(spark, d), "tracks")
    cuts = F.broadcast(t.agg(F.min("start").alias("low"), F.max("start").alias("high")))
    placed = t.join(cuts).withColumn("part", F.least(F.floor((F.col("start") - F.col("low")) * n / (F.col("high") - F.col("low") + 1)), F.lit(n - 1)))
    last = t.groupBy("chrom").agg((F.max("stop") + 1).alias("start")).select(F.lit(-1).cast("long").alias("sample"), "chrom", "start", (F.col("start") + 1).alias("stop"), F.lit(0.0).alias("value"))
    return [placed.filter(F.col("part") == i).select(*t.columns) for i in range(n)] + [last]


@query(_SEGMENTS + " SELECT chrom, start, stop, count(*) AS n, round(sum(value), 6) AS total FROM held GROUP BY ALL")
def stream_maximal_segments(spark, d):
    parts = [p.select("chrom", "start", "stop", "value") for p in _parts(spark, d)]
    return rounded(segments.run_in_parts(segments.stream_maximal_segments, parts, "maximal"), "total")


_TILE = 4096


@query(f"""WITH {TRACKS_SQL}, tiles AS (SELECT *, unnest(range(start // {_TILE}, (stop - 1) // {_TILE} + 1)) AS tile FROM tracks)
SELECT chrom, tile * {_TILE} AS start, count(*) AS n, round(sum(value), 6) AS total FROM tiles GROUP BY chrom, tile""")
def stream_window_counts(spark, d):
    """Of each tile of positions, once the watermark has passed it; an interval moves this to its own end, so rows may come a week of positions behind it. Two later rows settle the last tiles."""
    parts = _parts(spark, d)
    far = parts[-1].withColumns({"start": F.lit(10**9), "stop": F.lit(10**9 + 1)}).select(*parts[0].columns)
    found = segments.run_in_parts(lambda s: segments.stream_window_counts(s, _TILE, "7 days"), [*parts[:-1], far, far], "windows")
    return rounded(found.select("chrom", F.unix_timestamp("window.start").alias("start"), "n", "total"), "total")


@query(f"{_WALK} SELECT CAST(k AS VARCHAR) AS chrom, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, p AS ptree, a AS age FROM blocks WHERE i < n")
def stream_replay(spark, d):
    """The blocks of histories whose trees and edits come in three parts; a last block waits for an edit that does not come."""
    blocks, edits = _history(spark, d)
    none = {"recomb_node": "int", "coal_node": "int", "coal_time": "double"}
    first = blocks.filter("start = 0").select("sample", "chrom", F.col("start").alias("pos"), "ptree", "age", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    moves = edits.select("sample", "chrom", "pos", F.lit(None).cast("array<int>").alias("ptree"), F.lit(None).cast("array<double>").alias("age"), *none)
    parts = [first.unionByName(moves.filter("pos = 1")), moves.filter("pos IN (2, 3)"), moves.filter("pos > 3")]
    return segments.run_in_parts(segments.stream_replay, parts, "replay").select("chrom", "start", "stop", "ptree", "age")


@query(f"WITH {TRACKS_SQL} SELECT sample, chrom, start, stop, round(value, 6) AS value FROM tracks")
def stream_sample_files(spark, d):
    """A file set of each sample, as the folder grows: half of the samples are read before the others are there."""
    path, t = scratch_folder(spark, "samples"), stored(tracks(spark, d), "tracks")
    schema = t.drop("sample").schema
    stream = segments.stream_sample_files(spark, f"{path}/in/*", schema)
    for half in (range(5), range(5, 10)):
        for i in half:
            t.filter(F.col("sample") == i).drop("sample").write.parquet(f"{path}/in/track.{i}.parquet")
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.schema(stream.schema).parquet(f"{path}/out").select("sample", "chrom", "start", "stop", "value"), "value")
