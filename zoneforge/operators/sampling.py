"""Training samples: indices, frames, epochs and batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneforge.functions import frames as f
from zoneforge.functions.random import sample_in_cube, sample_noise_frame, sample_unit_vector, uniform
from zoneforge.operators import spatial
from zoneforge.operators.tables import dense_index


@dataclass(frozen=True)
class NeighborParams:
    """How pairs of views are drawn: exactly one of ``distance`` and ``padding`` (beyond the image length) is given."""

    directions: str = "cube"
    distance: float | None = None
    length: float | None = None
    padding: float | None = None
    noise_distance: float = 0.0
    noise_angle: float = 0.0
    threshold: int = 0

    def __post_init__(self):
        if (self.distance is None) == (self.padding is None):
            raise ValueError("give either a distance or a padding")
        if self.padding is not None and self.length is None:
            raise ValueError("a padding needs an image length")

    @property
    def apart(self) -> float:
        return self.distance if self.distance is not None else self.length + self.padding


def sample_index(zones: DataFrame, start: int, n: int) -> DataFrame:
    """(i, zone columns): sample i is zone i mod (number of zones), by the zones' dense index in order of zone_id."""
    indexed = dense_index(zones, ["zone_id"], "_k")
    count = indexed.count()
    if not count:
        return indexed.withColumn("i", F.lit(0).cast("long")).drop("_k")
    samples = zones.sparkSession.range(start, start + n).select(F.col("id").alias("i"), F.pmod("id", F.lit(count)).alias("_k"))
    return samples.join(indexed, "_k").drop("_k")


def apply_frames(atoms: DataFrame, frames: DataFrame, frame: str = "frame", within: float | None = None) -> DataFrame:
    """Atoms of each sample's assembly in the sample's frame: frames has (i, assembly_id, frame).

    With ``within`` only those so near the frame's origin: a join on cells, so that a sample does not meet all
    atoms of a large assembly.
    """
    own = frames.select("i", "assembly_id", F.col(frame).alias("_f"))
    if within is None:
        joined = atoms.join(own, "assembly_id")
    else:
        origins = own.withColumn("_o", f.inverted(F.col("_f"))["t"]).select("i", "assembly_id", "_f", *[F.col("_o")[c].alias(f"c{c}") for c in "xyz"])
        joined = spatial.atoms_within(origins, atoms, within).drop(*spatial.CENTER, "d2")
    moved = joined.withColumn("_v", f.applied(F.col("_f"), f.vector("x", "y", "z")))
    return moved.withColumns({c: F.col("_v")[c] for c in "xyz"}).drop("_f", "_v")


def sample_direction_near(df: DataFrame, dirs: list[tuple[float, float, float]], valid: str = "neighbor_ids", seed: str = "i", slot: int = 5, name: str = "direction") -> DataFrame:
    """A uniform vector moved from the cell of its nearest direction to the cell of a random valid one."""
    out = f.nearest_direction(sample_unit_vector(df, slot, seed, "_x"), dirs, "_x", "_near")
    pick = F.element_at(valid, (F.floor(uniform(seed, slot + 2) * F.size(valid)) + 1).cast("int"))
    known = F.array(*[f.vector(*d) for d in dirs])
    out = out.withColumn("_from", known[F.col("_near")]).withColumn("_to", known[pick])
    return out.withColumn(name, f.turned(f.aligning(F.col("_to"), F.col("_from")), F.col("_x"))).drop("_x", "_near", "_from", "_to")


def neighbor_frames(samples: DataFrame, dirs: list[tuple[float, float, float]], params: NeighborParams, size: float) -> DataFrame:
    """Samples (i, center, neighbor_ids, ...) with label, frame_a (home) and frame_c (the noisy neighbour)."""
    out = sample_in_cube(samples, size)
    if params.threshold == 0:
        out = sample_unit_vector(out, 5, name="direction")
    else:
        out = sample_direction_near(out, dirs)
    candidates = f.directions(params.directions)
    out = out.withColumn("label", F.floor(uniform("i", 9) * len(candidates)).cast("int"))
    out = out.withColumn("_d", F.array(*[f.vector(*d) for d in candidates])[F.col("label")])
    out = out.withColumn("frame_a", f.frame(F.col("origin"), f.aligning(F.col("direction"), F.col("_d"))))
    out = sample_noise_frame(out.withColumn("_ab", f.frame(f.scale(F.col("_d"), params.apart), f.rotation(*f.IDENTITY))), params.noise_distance, params.noise_angle)
    out = out.withColumn("_ac", f.composed(F.col("noise"), F.col("_ab")))
    return out.withColumn("frame_c", f.composed(F.col("_ac"), F.col("frame_a"))).drop("_d", "_ab", "_ac", "noise")


def noise_by_split(params: NeighborParams, df: DataFrame, keep_for: tuple[str, ...] = ("train",)) -> DataFrame:
    """noise_distance and noise_angle by the row's split: none but for splits that ask for it."""
    wanted = F.col("split").isin(*keep_for)
    return df.withColumn("noise_distance", F.when(wanted, params.noise_distance).otherwise(0.0)).withColumn("noise_angle", F.when(wanted, params.noise_angle).otherwise(0.0))


#: Rounds of the shuffle: more than four to a bit of the epochs' sizes in use.
ROUNDS = 24


def round_keys(seed: int, epoch: int) -> list[int]:
    """A number below 2^52 for each round."""
    return [int(hashlib.md5(f"{seed}:{epoch}:{k}".encode()).hexdigest()[:13], 16) for k in range(ROUNDS)]


def shuffled(df: DataFrame, column: str, n: int, seed: int, epoch: int, name: str) -> DataFrame:
    """``name``: the place of ``column`` (0 to n - 1) in a pseudorandom order of all n, by column expressions alone.

    A round pairs x with key - x (mod n) and swaps a pair or not, by a bit that hangs on the pair, so it is one to
    one for any n; rows need not meet.
    """
    out = df.withColumn("_x", F.col(column).cast("long"))
    for k, key in enumerate(round_keys(seed, epoch)):
        out = out.withColumn("_p", F.pmod(F.lit(key % n) - F.col("_x"), F.lit(n)))
        digit = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.lit(str(k)), F.greatest("_x", "_p").cast("string")).cast("binary")), 1, 1)
        out = out.withColumn("_x", F.when(digit < "8", F.col("_p")).otherwise(F.col("_x")))
    return out.withColumnRenamed("_x", name).drop("_p")


def epoch_plan(n: int, epoch: int, size: int, seed: int, advance: bool, zones: DataFrame) -> DataFrame:
    """(pos, i, zone_index): the epoch's ``size`` samples in shuffled order; i moves on each epoch only if it is to ``advance``.

    ``zones`` gives the session. Nothing is sorted or written: each position finds its sample by itself.
    """
    start = epoch * size if advance else 0
    rows = zones.sparkSession.range(size).select(F.col("id").alias("pos"))
    if size:
        rows = shuffled(rows, "pos", size, seed, epoch, "i").withColumn("i", F.col("i") + start)
    else:
        rows = rows.withColumn("i", F.col("pos"))
    return rows.select("pos", "i", F.pmod("i", F.lit(max(1, n))).alias("zone_index"))


def batch_plan(plan: DataFrame, size: int) -> DataFrame:
    """(batch, pos, ...): full batches of ``size``; the last partial one goes."""
    out = plan.withColumn("batch", F.floor(F.col("pos") / size).cast("long"))
    full = out.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == size)
    return out.join(full, "batch", "left_semi")


def make_sample(samples: DataFrame, fn: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    return samples if fn is None else samples.transform(fn)


def error_probability(df: DataFrame, logits: str, label: str, name: str = "difficulty") -> DataFrame:
    """1 - softmax(logits)[label]."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top))
    return df.withColumn(name, 1 - F.exp(F.element_at(logits, F.col(label) + 1).cast("double") - top) / total)


def classification_metrics(preds: DataFrame, by: list[str], logits: str = "logits", label: str = "y") -> DataFrame:
    """(by, n, loss, accuracy): mean cross-entropy from logits, and the share whose greatest logit (the first on ties) is the label's."""
    top = F.array_max(logits)
    log_sum = top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top)))
    rows = preds.withColumn("_loss", log_sum - F.element_at(logits, F.col(label) + 1)).withColumn("_hit", (F.array_position(logits, top) - 1 == F.col(label)).cast("double"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_loss").alias("loss"), F.avg("_hit").alias("accuracy"))


def score_samples(samples: DataFrame, predict: Callable, schema: str) -> DataFrame:
    """``predict`` takes an iterator of pandas frames and yields scored ones; what it loads before its loop is loaded once a task."""
    return samples.mapInPandas(predict, schema)


def eval_log_summary(log: DataFrame) -> DataFrame:
    """(parameters, n, accuracy, skip_rate); a skipped guess is no hit."""
    hit = (F.col("y_guess") == F.col("y_true").cast("string")).cast("double")
    return log.groupBy("noise_distance", "noise_angle").agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), F.avg((F.col("y_guess") == "skip").cast("double")).alias("skip_rate"))


def status_summary(headers: DataFrame, new_ids: DataFrame) -> DataFrame:
    """(status, total, fresh): responses by status, all and those of ``new_ids``."""
    marked = headers.join(new_ids.select("pdb_id").distinct().withColumn("_new", F.lit(1)), "pdb_id", "left")
    return marked.groupBy("status").agg(F.count(F.lit(1)).alias("total"), F.count("_new").alias("fresh"))
