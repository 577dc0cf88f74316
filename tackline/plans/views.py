"""The engine's inputs, laid over the driver's tables by integer arithmetic so that two engines make the same doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tackline.durable import bytes_at, written
from tackline.functions import sailing
from tackline.functions.canonical import settled
from tackline.operators import tracks
from tackline.operators.chunks import CHUNK_S

MAX_GAP_S = 86_400
#: A coarser output grid than the default, which the few fixes of a small table can fill.
TWA = [0.0, 30.0, 45.0, 60.0, 75.0, 90.0, 105.0, 120.0, 135.0, 150.0, 165.0, 180.0]
TWS = [4.0, 8.0, 12.0, 16.0, 20.0, 24.0, 28.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as fixes with their environment: one track a user."""
    ev = table(spark, sf_dir, "events").selectExpr(
        "event_id AS e", "user_id AS track_id", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS fix_idx",
        "CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 1000000) AS BIGINT) AS t", "event_type", "value",
    )
    return ev.selectExpr(
        "track_id", "CAST(fix_idx AS BIGINT) AS fix_idx", "t", "e", "event_type", "value",
        "40D + (track_id * 7) % 20 + fix_idx * 0.01D AS lat", "-30D + (track_id * 11) % 60 + fix_idx * 0.02D AS lon",
        "CASE WHEN e % 5 <> 0 THEN ((e * 137) % 3600) / 10D END AS cog", "CASE WHEN e % 7 <> 0 THEN ((e * 31) % 1500) / 100D END AS sog",
        "4D + ((e * 17) % 260) / 10D AS tws", "((e * 61) % 3600) / 10D AS twd_from",
        "CASE WHEN e % 4 <> 0 THEN 4D + ((e * 23) % 240) / 10D END AS sup_tws", "CASE WHEN e % 4 <> 1 THEN ((e * 43) % 3600) / 10D END AS sup_twd",
        "CASE WHEN e % 11 <> 0 THEN ((e * 13) % 60) / 10D END AS hs_m", "((e * 29) % 3600) / 10D AS wave_from", "2D + ((e * 19) % 120) / 10D AS wave_period_s",
        "CASE WHEN e % 3 <> 0 THEN ((e * 23) % 30) / 10D END AS current_speed", "((e * 41) % 3600) / 10D AS current_toward", "CAST(e % 6 AS INT) AS current_dataset",
    )


ENVIRONMENT = ["e", "sup_tws", "sup_twd", "hs_m", "wave_from", "wave_period_s", "current_speed", "current_toward", "current_dataset"]


#: Files of fixes up to this size are read with one window a track: all of them would fit in one task.
WHOLE_TRACKS_BYTES = 64 << 20


def chunk_s(spark: SparkSession, sf_dir: str) -> int | None:
    """The length of a track's chunks, or None where whole tracks are small; both give the same rows."""
    return CHUNK_S if bytes_at(spark, f"{sf_dir}/events.parquet") > WHOLE_TRACKS_BYTES else None


def motions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged fixes with heading and speed."""
    return tracks.derive(tracks.normalise(fixes(spark, sf_dir)), MAX_GAP_S, chunk_s=chunk_s(spark, sf_dir))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with everything that relates them to wind, waves and current."""
    return sailing.relate(tracks.derive(tracks.normalise(fixes(spark, sf_dir), ENVIRONMENT), MAX_GAP_S, chunk_s=chunk_s(spark, sf_dir)))


def samples_for_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same samples where they are read twice, for chunks and for the ends of chunks: written first if they are many."""
    found = samples(spark, sf_dir)
    return written(found) if chunk_s(spark, sf_dir) else found


def placed(spark: SparkSession, sf_dir: str, corrected: bool = True) -> DataFrame:
    """Samples as points of the polar: the columns of samples with p_twa, p_tws, p_bsp."""
    twa, tws, bsp = sailing.polar_point(corrected)
    return settled(samples(spark, sf_dir), {"p_twa": twa, "p_tws": tws, "p_bsp": bsp}).where("p_twa is not null")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).select("track_id", "e", F.col("p_twa").alias("twa"), F.col("p_tws").alias("tws"), F.col("p_bsp").alias("bsp"), "wave_from", "heading", "heading_corrected", "hs_m", "wave_period_s")


def polar_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as the points of six ragged polar files, with repeats."""
    p = table(spark, sf_dir, "part").selectExpr("CAST(p_partkey % 6 AS BIGINT) AS source_id", "CAST(30 + 15 * (p_size % 11) AS DOUBLE) AS twa", "CAST(4 + 4 * ((p_partkey * 5 + p_size) % 6) AS DOUBLE) AS tws", "3D + ((p_partkey * 13 + p_size * 7) % 700) / 100D AS bsp")
    return p.where("(source_id * 7 + CAST(twa AS BIGINT) * 3 + CAST(tws AS BIGINT)) % 9 <> 0")


def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.selectExpr(
        "c_custkey AS id", "c_name AS name", "concat(substring(n_name, 1, 3), CAST(c_custkey % 997 AS STRING)) AS sail_no", "substring(n_name, 1, 3) AS country",
        "CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END AS model", "CASE WHEN c_custkey % 10 <> 0 THEN CAST(1990 + c_custkey % 35 AS INT) END AS year",
        "CASE WHEN c_custkey % 8 <> 0 THEN CAST(2019 + c_custkey % 7 AS INT) END AS certificate_year", "CASE WHEN c_custkey % 9 <> 0 THEN round(abs(c_acctbal)) / 500D END AS loa", "c_custkey % 17 = 0 AS withdrawn",
    )


def yachts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificates with who built and drew the boat, a certificate's own number and its variant."""
    return certificates(spark, sf_dir).selectExpr(
        "*", "CASE WHEN id % 6 <> 0 THEN concat('Yard ', CAST(id % 23 AS STRING)) END AS builder", "CASE WHEN id % 4 <> 0 THEN concat('D', CAST(id % 11 AS STRING), ' & Co') END AS designer",
        "concat('A-', CAST(id * 7 AS STRING)) AS certificate", "CASE WHEN id % 3 = 0 THEN 'double-handed' ELSE 'crew' END AS variant",
    )
