"""Accept/refuse policies: stages that only ever add to earlier decisions.

A decision table has ``q_ord, confidence, accepted``. A stage scores the refused rows
only; what an earlier stage accepted is never revoked or changed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchbook.functions.calibration import logit, shift_to_boundary, sigmoid
from matchbook.operators.refusal import accepts
from matchbook.session import durable


def decide(conf: Column, boundary: float) -> list[Column]:
    return [conf.alias("confidence"), accepts(conf, boundary).alias("accepted")]


def supplement(df: DataFrame, score: Column, cut: float, boundary: float, scope: Column | None = None) -> DataFrame:
    """Accept refused rows whose score reaches the cut and whose scope allows it."""
    if not (0.0 < boundary < 1.0):
        raise ValueError("boundary must lie strictly between 0 and 1")
    within = F.lit(True) if scope is None else scope
    add = ~F.col("accepted") & accepts(score, cut) & within
    shifted = F.greatest(sigmoid(logit(score) - logit(cut) + logit(boundary)), F.lit(boundary))
    return df.withColumn("_add", add).withColumn("confidence", F.when(F.col("_add"), shifted).otherwise(F.col("confidence"))).withColumn(
        "accepted", F.col("accepted") | F.col("_add")).drop("_add")


def checked(df: DataFrame, boundary: float) -> DataFrame:
    """Fail if any row's confidence and decision disagree."""
    agree = F.col("accepted") == accepts(F.col("confidence"), boundary)
    return df.withColumn("accepted", F.when(agree, F.col("accepted")).otherwise(
        F.raise_error(F.lit("confidence and decision disagree")).cast("boolean")))


@dataclass(frozen=True)
class Stage:
    """A named supplement: ``score`` turns the refused rows into rows with column ``score``."""

    name: str
    score: Callable[[DataFrame], DataFrame]
    cut: float
    scope: str = "true"


def run_chain(df: DataFrame, stages: list[Stage], boundary: float) -> DataFrame:
    """Fold the stages over a decision table; each one sees only the rows still refused."""
    out = df.withColumn("accepted_by", F.when(F.col("accepted"), F.lit("base")))
    for s in stages:
        refused = s.score(out.filter(~F.col("accepted"))).withColumnRenamed("score", "_score")
        scored = supplement(refused, F.col("_score"), s.cut, boundary, F.expr(s.scope))
        scored = scored.withColumn("accepted_by", F.when(F.col("accepted"), F.lit(s.name))).select(*out.columns)
        # Stored, so that a chain of n stages reads its source once and not 2**n times.
        out = durable(out.filter("accepted").unionByName(scored), "policy-stage")
    return checked(out, boundary)


def chain_columns(df: DataFrame, stages: list[tuple[str, Column, float, Column | None]], boundary: float) -> DataFrame:
    """The same fold when every score is already a column: one projection, no union."""
    for _, score, cut, scope in stages:
        df = supplement(df, score, cut, boundary, scope)
    return checked(df, boundary)


def two_route(night: Column, p_night: tuple[Column, Column], p_source: tuple[Column, Column], cut_night: float, cut_source: float, boundary: float) -> Column:
    """Confidence from the head of the query's route, on the common boundary scale.

    Each head gives (p_absent, p_match).
    """
    from matchbook.functions.calibration import three_class_odds

    return F.when(night, shift_to_boundary(three_class_odds(*p_night), cut_night, boundary)).otherwise(
        shift_to_boundary(three_class_odds(*p_source), cut_source, boundary))


#: Fixed values of the rescue guard.
ABSENT_AT_LEAST, ROAD_BELOW, RAW_BELOW = 0.8, 0.9, 0.45


def contradictory_rescue(absent: Column, road: Column, raw: Column, night: Column, before: Column, now: Column) -> Column:
    """Whether a newly accepted row contradicts its other evidence and must stay refused."""
    return now & ~before & ~night & (absent >= ABSENT_AT_LEAST) & (road < ROAD_BELOW) & (raw < RAW_BELOW)


#: The channels of match evidence, and the rules by kind. A vote counts channels
#: whose percentile is full (and whose z reaches a bound); the others bound the lesser value of
#: the first and last channel.
CHANNELS = ("DINO_CLS", "DINO_PATCH_MEAN", "CNN_RAW")
FULL = "1 - 1e-7"
VOTES = [((0, 2), 2), ((1, 2), 2), ((0, 1, 2), 2), ((0, 1, 2), 3)]
VOTE_Z = [None, 2.0]
BOTH_Z_GAP = list(product([1.5, 2.5, 3.5], [0.0, 0.1, 0.3]))
BOTH_PERCENTILE_Z = list(product([0.98, 0.995], [2.0, 3.0]))


def _bounds(channel: str, **least) -> str:
    return " AND ".join(f"`{channel}_{feature}` >= {value}" for feature, value in least.items() if value is not None)


def _vote(channels: tuple[str, ...], need: int, z: float | None) -> tuple[str, str]:
    each = [f"cast({_bounds(c, selected_percentile=FULL, selected_z=z)} as int)" for c in channels]
    return f"{'+'.join(channels)}-votes{need}-z{z}", f"{' + '.join(each)} >= {need}"


def _both(channels: tuple[str, ...], label: str, **least) -> tuple[str, str]:
    ends = (channels[0], channels[-1])
    return f"CLS-CNN-{label}", " AND ".join(f"least({', '.join(f'`{c}_{f}`' for c in ends)}) >= {v}" for f, v in least.items())


def evidence_rules(channels: tuple[str, str, str] = CHANNELS) -> dict[str, str]:
    """All candidate rules as SQL conditions over channel feature columns, by name."""
    rules = [("unconditional-control", "true")]
    rules += [_vote(tuple(channels[i] for i in which), need, z) for which, need in VOTES for z in VOTE_Z]
    rules += [_both(channels, f"z{z}-gap{gap}", selected_z=z, gap2_z=gap) for z, gap in BOTH_Z_GAP]
    rules += [_both(channels, f"percentile{p}-z{z}", selected_percentile=p, selected_z=z) for p, z in BOTH_PERCENTILE_Z]
    return dict(rules)


def corrected_score(p: Column, patch_cosine: Column, cnn_cosine: Column, alpha: float) -> Column:
    """Probability corrected by the disagreement of two channels."""
    return sigmoid(logit(p, 1e-10) + alpha * 4.0 * (patch_cosine - cnn_cosine), 35.0)


def style_support(gallery: DataFrame, dims: list[str], mean: list[float], precision, size_cap: int = 128) -> DataFrame:
    """Whether a gallery's mean descriptor lies near a style: ``distance`` scaled by its capped size."""
    m = gallery.agg(*[F.avg(d).alias(d) for d in dims], F.count(F.lit(1)).alias("_n"))
    delta = [F.col(d) - float(mu) for d, mu in zip(dims, mean)]
    quad = F.lit(0.0)
    for i, a in enumerate(delta):
        for j, b in enumerate(delta):
            quad = quad + a * F.lit(float(precision[i][j])) * b
    return m.select((quad * F.least(F.col("_n"), F.lit(size_cap))).alias("distance"))
