"""Named queries for spectra and for windows added up, over the vectors as sound."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import spectra
from parlance.plans.adapters import table
from parlance.plans.catalogue import query
from parlance.plans.storage import SAMPLES

N, HOP, BLOCK = 64, 16, 320
BINS, BANDS = (1, 7, 20), 8


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten vectors a recording, five a block."""
    v = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("rec"), F.floor(F.col("vec_id") % 10 / 5).alias("k"), "vec_id", F.transform("embedding", lambda x: F.floor(10000 * x.cast("double")).cast("smallint")).alias("x"))
    samples = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "x"))), lambda s: s["x"]))
    return v.groupBy("rec", "k").agg(samples.alias("samples")).select(F.concat(F.lit("rec"), F.col("rec")).alias("recording"), (F.col("k") * BLOCK).alias("first"), "samples")


#: The frame's samples times the window, and sums with cosine and sine: a transform written out.
FRAMES = f"""{SAMPLES}, l as (select rec, max(pos) + 1 as n from s group by rec), f as (select rec, unnest(range(0, cast(ceil(n / {HOP}) as bigint))) as t from l),
 x as (select f.rec, f.t, i, s.x / 32768 * (0.5 - 0.5 * cos(2 * pi() * i / {N})) as v from f, (select unnest(range({N})) as i) join s on s.rec = f.rec and s.pos = f.t * {HOP} - {(N - HOP) // 2} + i),
 d as (select rec, t, b, sum(v * cos(2 * pi() * b * i / {N})) as re, -sum(v * sin(2 * pi() * b * i / {N})) as im from x, (select unnest(range({N // 2 + 1})) as b) group by all)"""


@query(f"with {FRAMES} select 'rec' || rec as recording, t as frame, {', '.join(f'round(max(re) filter (b = {b}), 6) + 0.0 as re{b}, round(max(im) filter (b = {b}), 6) + 0.0 as im{b}' for b in BINS)} from d group by rec, t")
def spectrum_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spectra.spectra(_blocks(spark, sf_dir), BLOCK, N, HOP)
    pick = lambda c, b: (F.round(F.get(c, F.lit(b)), 6) + 0.0).alias(f"{c}{b}")
    return found.select("recording", "frame", *[pick(c, b) for b in BINS for c in ("re", "im")])


EDGES = [700 * (10 ** (i * 2595 * math.log10(1 + 8000 / 700) / (BANDS + 1) / 2595) - 1) for i in range(BANDS + 2)]


@query(f"""with {FRAMES}, m as (select m, {list(EDGES)}[m + 1] as low, {list(EDGES)}[m + 2] as mid, {list(EDGES)}[m + 3] as high from (select unnest(range({BANDS})) as m)),
 w as (select b, m, greatest(0, least((b * 8000 / {N // 2} - low) / (mid - low), (high - b * 8000 / {N // 2}) / (high - mid))) as w from (select unnest(range({N // 2 + 1})) as b), m), e as (select rec, t, m, ln(sum(sqrt(re * re + im * im) * w) + 1e-10) as e from d join w using (b) where w > 0 group by all)
 select 'rec' || rec as recording, t as frame, round(sum(e * (m + 1)), 4) + 0.0 as total, arg_max(m, e) as loudest from e group by rec, t""")
def log_mel_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spectra.log_mel(_blocks(spark, sf_dir), BLOCK, N, HOP, BANDS)
    total = F.aggregate(F.transform("bands", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return found.select("recording", "frame", (F.round(total, 4) + 0.0).alias("total"), (F.array_position("bands", F.array_max("bands")) - 1).alias("loudest"))


@query(f"with {SAMPLES} select 'rec' || rec as recording, pos, x from s")
def spectrum_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To spectra and back: every sample again."""
    blocks = _blocks(spark, sf_dir)
    lengths = blocks.groupBy("recording").agg(F.sum(F.size("samples")).alias("n"))
    back = spectra.signals(spectra.spectra(blocks, BLOCK, N, HOP), lengths, BLOCK, N, HOP)
    return back.select("recording", "first", F.posexplode("values").alias("i", "x")).select("recording", (F.col("first") + F.col("i")).alias("pos"), F.round(F.col("x") * 32768).cast("long").alias("x"))


STEP, OVERLAP = 48, 16


@query(f"""with w as (select vec_id // 10 as rec, vec_id % 10 * {STEP} as a, embedding as e from embeddings), p as (select rec, a + i - 1 as pos, cast(e[i] as double) as x, least(1.0, i / {OVERLAP + 1}, (65 - i) / {OVERLAP + 1}) as w from (select *, unnest(range(1, 65)) as i from w))
 select rec, pos, round(sum(x * w) / sum(w), 6) + 0.0 as x from p group by rec, pos""")
def window_overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as windows that overlap by a quarter, faded into one curve a recording."""
    windows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("rec"), (F.col("vec_id") % 10 * STEP).alias("start"), F.col("embedding").cast("array<double>").alias("values"))
    curve = spectra.added_up(spectra.faded(windows, OVERLAP), ["rec"], 100)
    return curve.select("rec", "first", F.posexplode("values").alias("i", "x")).select("rec", (F.col("first") + F.col("i")).alias("pos"), (F.round("x", 6) + 0.0).alias("x"))
