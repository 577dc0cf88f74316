"""The stream of motions against the batch of the same fixes."""

import pytest
from pyspark.sql import functions as F

from tackline.operators import tracks
from tackline.plans import views as V
from tackline.streaming import motion

SF = "/root/testdata/sf0.001"
FIX = ["track_id", "t", "fix_idx", "lat", "lon", "cog", "sog"]


@pytest.mark.parametrize("gap", [86_400, 900_000])
def test_stream_of_motions_equals_the_batch(spark, tmp_path, gap):
    fixes = tracks.normalise(V.fixes(spark, SF)).select(FIX)
    rows = sorted((r for r in fixes.collect() if r["track_id"] % 4 == 0), key=lambda r: (r["t"], r["track_id"]))
    assert len(rows) > 100
    last = rows[-1]["t"]
    schema = fixes.schema
    # files of fixes in time order, neighbours in time swapped within the delay, then fixes of another track that carry the watermark on
    size = len(rows) // 6 + 1
    parts = [rows[k : k + size] for k in range(0, len(rows), size)]
    parts = [p[::-1] for p in parts] + [[(-1, last + gap + d, 0, 0.0, 0.0, None, None)] for d in (10**7, 2 * 10**7, 3 * 10**7)]
    for k, part in enumerate(parts):
        spark.createDataFrame([tuple(r) for r in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert k >= 0
    stream = motion.derive_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), gap, "90 days")
    query = stream.writeStream.format("memory").queryName(f"motions_{gap}").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    columns = ["track_id", "t", "fix_idx", *[F.round(c, 9).alias(c) for c in ("heading", "speed")], "heading_origin", "speed_origin"]
    got = sorted(map(tuple, spark.table(f"motions_{gap}").where("track_id >= 0").select(*columns).collect()))
    want = sorted(map(tuple, tracks.derive(spark.createDataFrame(rows, schema), gap).select(*columns).collect()))
    assert got == want and {r[-1] for r in got} >= {"given", "derived"}
