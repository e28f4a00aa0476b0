"""The stream forms against their batch forms."""

import random

from loamtree.operators.intervals import intersect_samples
from loamtree.operators.spr import apply_spr
from loamtree.streaming import segments


def run(frame, path, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return frame.sparkSession.table(name).collect()


def test_segments(spark, tmp_path):
    rng = random.Random(4)
    rows = [(s, "xy"[s % 2], a, a + rng.randint(1, 90), float(s)) for s in range(6) for a in range(rng.randint(0, 50), 1000, 100)]
    schema = "sample long, chrom string, start long, stop long, value double"
    last = [(9, c, 10**7, 10**7 + 1, 0.0) for c in "xy"]  # moves the watermark behind all else
    for i, part in enumerate((rows, last, last)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
    found = sorted((r.chrom, r.start, r.stop, r.n, r.total) for r in run(segments.stream_segments(stream, 64, "0 seconds"), f"{tmp_path}/c1", "segments"))
    tiles = [(s, c, max(a, t * 64), min(b, t * 64 + 64), v) for s, c, a, b, v in rows for t in range(a // 64, (b - 1) // 64 + 1)]
    batch = {}
    for r in intersect_samples(spark.createDataFrame(tiles, schema), 64).collect():
        batch.setdefault((r.chrom, r.start, r.stop), []).append(r.value)
    assert found == sorted((*key, len(v), sum(v)) for key, v in batch.items())
    counts = run(segments.stream_window_counts(stream, 64, "0 seconds"), f"{tmp_path}/c2", "counts")
    assert sum(r.n for r in counts) == len(tiles)


def test_replay(spark, tmp_path):
    tree = ([3, 3, 4, 4, -1], [0.0, 0.0, 0.0, 2.0, 5.0])
    edits = [(10, 0, 2, 3.0), (20, 1, 4, 9.0), (35, 2, 0, 1.0)]
    schema = "sample long, chrom string, pos long, ptree array<int>, age array<double>, recomb_node int, coal_node int, coal_time double"
    first = [(s, "c", s, *tree, None, None, None) for s in (0, 1)]
    for part in (first + [(s, "c", *edits[0][:1], None, None, *edits[0][1:]) for s in (0, 1)], [(1, "c", p, None, None, r, c, t) for p, r, c, t in edits[1:]][::-1]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = sorted((r["sample"], r.start, r.stop, list(r.ptree), list(r.age)) for r in run(segments.stream_replay(stream), f"{tmp_path}/c", "replayed"))
    want = [(0, 0, 10, *map(list, tree))]
    now, start = tree, 1
    for pos, *edit in edits:
        want.append((1, start, pos, *map(list, now)))
        now, start = apply_spr(*now, *edit), pos
    assert found == sorted(want)


def test_sample_files(spark, tmp_path):
    for sample in (3, 12):
        spark.createDataFrame([(f"x{sample}",)], "name string").coalesce(1).write.parquet(f"{tmp_path}/tmp{sample}")
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / f"tmp{sample}").glob("*.parquet")).rename(tmp_path / "in" / f"out.{sample}.parquet")
    stream = segments.stream_sample_files(spark, f"{tmp_path}/in", "name string")
    assert sorted((r["sample"], r.name) for r in run(stream, f"{tmp_path}/c", "files")) == [(3, "x3"), (12, "x12")]


def test_maximal_segments_over_batches(spark):
    """Whatever the parts, the segments are those of all rows at once; intervals go on over many parts, and one comes late."""
    rng = random.Random(9)
    rows = sorted([(rng.choice("xy"), a := rng.randrange(3000), a + rng.choice([1, 7, 60, 900, 2500]), float(rng.randint(1, 9))) for _ in range(150)], key=lambda r: r[1])
    schema = "chrom string, start long, stop long, value double"
    parts = [rows[:1], rows[1:40], rows[40:41], rows[42:100], [rows[41], *rows[100:]], [(c, 10**6, 10**6 + 1, 0.0) for c in "xy"]]
    found = segments.run_in_parts(lambda s: segments.stream_maximal_segments(s, 3000), [spark.createDataFrame(p, schema) for p in parts], "maximal").collect()
    held = {}
    for r in intersect_samples(spark.createDataFrame(rows, schema), 64).collect():
        held.setdefault((r.chrom, r.start, r.stop), []).append(r.value)
    assert sorted((r.chrom, r.start, r.stop, r.n, r.total) for r in found) == sorted((*k, len(v), sum(v)) for k, v in held.items())
