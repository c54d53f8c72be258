"""Baseline against candidate: comparison rows, scaled allowances, gates, failures and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseloom.config import GateLimits
from verseloom.functions.scores import safe_ratio
from verseloom.operators.quality import messages

#: Metrics of an archive that the gate compares.
METRICS = ("slide_count", "line_count", "over_hard", "over_target", "aux_words", "fast_transitions", "text_words", "hard_wrapped_line_count", "hard_wrapped_slide_count")
#: What a phase may bring along for the totals of all comparisons, complete or not.
RUN_COSTS = {"elapsed_seconds": "double", "output_bytes": "long", "cache_bytes_before": "long", "cache_bytes_after": "long"}
#: Columns of ``batch_gate`` on expected texts and costs.
REFERENCE_AND_COSTS = ("reference_count", "least_similarity", "elapsed_total", "elapsed_average", "output_bytes", "cache_growth", "reference_gate")
REFERENCE_FAILED = "reference gate failed"


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def compared(baseline: DataFrame, phase: DataFrame, key: str) -> DataFrame:
    """Outer join of two metric tables as ``b_*`` and ``p_*``; ``complete`` where both sides are there.

    Either side may have ``reference_similarity``, null where a video has no expected text, and the phase
    may have RUN_COSTS; columns that are not there count as null.
    """
    b = baseline.select(key, *(F.col(m).cast("long").alias(f"b_{m}") for m in METRICS), _optional(baseline, "reference_similarity", "double").alias("baseline_similarity"))
    p = phase.select(key, *(F.col(m).cast("long").alias(f"p_{m}") for m in METRICS), _optional(phase, "reference_similarity", "double").alias("phase_similarity"), *(_optional(phase, n, t).alias(n) for n, t in RUN_COSTS.items()))
    return b.join(p, key, "full_outer").withColumn("complete", F.col("b_slide_count").isNotNull() & F.col("p_slide_count").isNotNull())


def with_optional(rows: DataFrame) -> DataFrame:
    """Rows of ``b_*`` and ``p_*`` metrics as ``compared`` gives them, where one aggregation made both sides."""
    extra = {"baseline_similarity": "double", "phase_similarity": "double", **RUN_COSTS}
    out = rows.select(*rows.columns, *(F.lit(None).cast(t).alias(n) for n, t in extra.items() if n not in rows.columns))
    return out.withColumn("complete", F.col("b_slide_count").isNotNull() & F.col("p_slide_count").isNotNull())


def comparable(field: str) -> Column:
    """The baseline's count, or what it would be with hard wrapping if that is more."""
    raw, wrapped = F.col(f"b_{field}_count"), F.col(f"b_hard_wrapped_{field}_count")
    return F.greatest(raw, F.coalesce(F.nullif(wrapped, F.lit(0)), raw))


def content_scale() -> Column:
    return F.greatest(F.lit(1.0), safe_ratio(F.col("p_text_words"), F.col("b_text_words")))


def batch_gate(rows: DataFrame, expected: int, cfg: GateLimits = GateLimits()) -> DataFrame:
    """One row: totals of complete comparisons, allowances and the outcome of every gate. One aggregation, map-side combined.

    Elapsed time, output bytes and cache growth count every comparison. Without expected texts the reference gate is that of the full set.
    """
    c = F.col
    sides = [f"{s}_{m}" for s in "bp" for m in METRICS]
    done = rows.withColumns({m: F.when(c("complete"), c(m)) for m in [*sides, "phase_similarity", "baseline_similarity"]})
    for f in ("slide", "line"):
        done = done.withColumn(f"{f}_base", comparable(f))
    done = done.withColumn("scale", content_scale())

    def within(f: str, ratio: float, slack: int) -> Column:
        return F.bool_and(c(f"p_{f}_count") <= F.greatest(c(f"{f}_base") + slack, F.ceil(c(f"{f}_base") * ratio * c("scale"))))

    totals = done.agg(
        F.count_if("complete").alias("n"),
        *(F.coalesce(F.sum(f"{s}_{m}"), F.lit(0)).alias(f"{s}_{m}") for s in "bp" for m in METRICS[:7]),
        *(F.coalesce(F.sum(f"{f}_base"), F.lit(0)).alias(f"{f}_base") for f in ("slide", "line")),
        F.coalesce(F.sum(F.ceil(c("slide_base") * cfg.total_slide_ratio * c("scale"))), F.lit(0)).alias("slide_allowance"),
        F.coalesce(F.sum(F.ceil(c("line_base") * cfg.total_line_ratio * c("scale"))), F.lit(0)).alias("line_allowance"),
        F.coalesce(F.sum(F.greatest(c("p_slide_count") - 1, F.lit(0))), F.lit(0)).alias("slots"),
        F.coalesce(within("slide", cfg.video_slide_ratio, cfg.slide_slack), F.lit(True)).alias("each_slide"),
        F.coalesce(within("line", cfg.video_line_ratio, cfg.line_slack), F.lit(True)).alias("each_line"),
        F.coalesce(F.bool_and(~c("complete") | (safe_ratio(c("p_over_target"), c("p_line_count")) <= cfg.over_target_ratio)), F.lit(True)).alias("each_target"),
        F.coalesce(F.bool_and(reference_gate(done, cfg)), F.lit(True)).alias("each_reference"),
        F.count("phase_similarity").alias("reference_count"),
        F.min("phase_similarity").alias("least_similarity"),
        F.coalesce(F.sum("elapsed_seconds"), F.lit(0.0)).alias("elapsed_total"),
        F.coalesce(F.avg("elapsed_seconds"), F.lit(0.0)).alias("elapsed_average"),
        F.coalesce(F.sum("output_bytes"), F.lit(0)).alias("output_bytes"),
        F.coalesce(F.max("cache_bytes_after") - F.min("cache_bytes_before"), F.lit(0)).alias("cache_growth"),
    )
    full = c("n") == expected
    aux_delta = c("p_aux_words") - c("b_aux_words")
    gates = totals.select(
        "*",
        full.alias("full_set"),
        (full & (c("p_over_hard") <= c("b_over_hard"))).alias("hard_gate"),
        (full & (c("p_slide_count") <= c("slide_allowance")) & c("each_slide")).alias("slide_gate"),
        (full & (c("p_line_count") <= c("line_allowance")) & c("each_line")).alias("line_gate"),
        (full & ((c("p_fast_transitions") <= c("b_fast_transitions")) | (safe_ratio(c("p_fast_transitions"), c("slots")) <= cfg.fast_ratio))).alias("fast_gate"),
        (full & (aux_delta <= F.greatest(F.lit(cfg.aux_words_least), F.ceil(c("b_aux_words") * cfg.aux_words_share))) & (safe_ratio(c("p_aux_words"), c("p_text_words")) <= cfg.aux_word_ratio)).alias("aux_gate"),
        (full & (safe_ratio(c("p_over_target"), c("p_line_count")) <= cfg.over_target_ratio) & c("each_target")).alias("target_gate"),
        (full & c("each_reference")).alias("reference_gate"),
    )
    names = ("hard", "slide", "line", "fast", "aux", "target")
    passed = gates.withColumn("passed", full & c("hard_gate") & c("slide_gate") & c("line_gate") & c("fast_gate") & c("aux_gate") & c("target_gate") & c("reference_gate"))
    return passed.withColumn("failures", messages((~c("full_set"), F.format_string(f"full set: %d of {expected}", "n")), *((~c(f"{g}_gate"), F.lit(f"{g} gate failed")) for g in names), (~c("reference_gate"), F.lit(REFERENCE_FAILED)))).drop("each_slide", "each_line", "each_target", "each_reference")


def top_failures(rows: DataFrame, key: str, k: int = 5, cfg: GateLimits = GateLimits()) -> DataFrame:
    """The ``k`` worst videos of each gate, by ratio and then key, both falling."""
    done = rows.where("complete").withColumn("slide_base", comparable("slide")).withColumn("line_base", comparable("line")).withColumn("scale", content_scale())
    c = F.col
    ratios = F.array(
        *(
            F.struct(F.lit(g).alias("gate"), r.alias("ratio"), bad.alias("bad"))
            for g, r, bad in (
                ("slide", safe_ratio(c("p_slide_count"), c("slide_base")), c("p_slide_count") > F.greatest(c("slide_base") + cfg.slide_slack, F.ceil(c("slide_base") * cfg.video_slide_ratio * c("scale")))),
                ("line", safe_ratio(c("p_line_count"), c("line_base")), c("p_line_count") > F.greatest(c("line_base") + cfg.line_slack, F.ceil(c("line_base") * cfg.video_line_ratio * c("scale")))),
                ("target", safe_ratio(c("p_over_target"), c("p_line_count")), safe_ratio(c("p_over_target"), c("p_line_count")) > cfg.over_target_ratio),
                ("fast", safe_ratio(c("p_fast_transitions"), F.greatest(c("p_slide_count") - 1, F.lit(1))), c("p_fast_transitions") > c("b_fast_transitions")),
                ("reference", 1 - c("phase_similarity"), ~reference_gate(done, cfg)),
            )
        )
    )
    bad = done.select(key, F.inline(ratios)).where("bad")
    rank = F.row_number().over(Window.partitionBy("gate").orderBy(F.desc("ratio"), F.desc(key)))
    return bad.withColumn("rank", rank).where(F.col("rank") <= k).select("gate", "rank", key, "ratio")


def metric_deltas(rows: DataFrame, key: str) -> DataFrame:
    """Unpivoted metrics (key, metric, baseline, phase, delta); missing sides stay null."""
    pairs = ", ".join(f"'{m}', b_{m}, p_{m}" for m in METRICS[:7])
    long = rows.selectExpr(key, f"stack(7, {pairs}) as (metric, baseline, phase)")
    return long.withColumn("delta", F.col("phase") - F.col("baseline"))


def reference_gate(rows: DataFrame, cfg: GateLimits = GateLimits()) -> Column:
    """Whether a row's reference similarity (phase_similarity, baseline_similarity) passes; no reference passes."""
    p, b = F.col("phase_similarity"), F.col("baseline_similarity")
    return p.isNull() | ((p >= cfg.reference_least) & (b.isNull() | (p >= b - cfg.reference_drop)))
