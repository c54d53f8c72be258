"""Markdown and JSON reports, rendered from small result tables (a row a song, gate or metric)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cell(x: object) -> str:
    text = "-" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)
    return " ".join(text.split()).replace("|", "\\|")


def markdown_table(df: DataFrame) -> str:
    """A table of all rows, read partition by partition."""
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}"
    return "\n".join([head, *(f"| {' | '.join(map(_cell, r))} |" for r in df.toLocalIterator())])


def report(title: str, sections: list[tuple[str, DataFrame | str]]) -> str:
    parts = [f"# {title}"]
    for name, body in sections:
        parts += [f"## {name}", body if isinstance(body, str) else markdown_table(body)]
    return "\n\n".join(parts) + "\n"


def gate_report(gate: DataFrame, deltas: DataFrame, failures: DataFrame, key: str) -> tuple[str, str]:
    """Markdown and JSON of a batch gate."""
    row = gate.first().asDict(recursive=True)
    text = report("Batch gate", [("Summary", markdown_table(gate)), ("Failures", "\n".join(f"- {m}" for m in row["failures"]) or "none"), ("Worst", failures.orderBy("gate", "rank")), ("Metrics", deltas.orderBy(key, "metric"))])
    return text, json.dumps(row, sort_keys=True, default=str)


def consensus_report(decisions: DataFrame, unavailable: DataFrame, metrics: DataFrame, transcript: DataFrame, key: str) -> str:
    """Markdown on the consensus of the songs in ``decisions``: sources, layout, how the words were chosen, the text, and what is doubtful.

    The tables are those of ``operators.consensus`` and of ``quality.slide_metrics`` for a few songs.
    """
    won = decisions.groupBy("source").agg(F.count(F.lit(1)).alias("phrases")).orderBy("source")
    chosen = transcript.groupBy(key, "mode", "reason").agg(F.count(F.lit(1)).alias("words")).orderBy(key)
    text = transcript.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda x: x["text"]), " ").alias("text")).orderBy(key)
    table = decisions.select(key, "idx", F.format_string("%.2f-%.2f", "start", "end").alias("seconds"), "source", "score", "support", "n_sources", "text").orderBy(key, "idx")
    doubtful = decisions.where("doubt <> ''").select(key, "idx", "doubt", "text").orderBy(key, "idx")
    parts = [("Sources", won), ("Unavailable", unavailable.orderBy(key, "source")), ("Layout", metrics.orderBy(key)), ("Selection", chosen), ("Text", text), ("Decisions", table), ("Low confidence", doubtful)]
    return report("Consensus", parts)


def effort_report(runs: DataFrame, key: str) -> tuple[str, str]:
    """Markdown and JSON of what a batch took. ``runs``: (key, elapsed_seconds, cache_bytes_before, cache_bytes_after, output_bytes)."""
    grown = F.col("cache_bytes_after") - F.col("cache_bytes_before")
    total = runs.agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("elapsed_seconds"), F.lit(0.0)).alias("elapsed"), F.coalesce(F.avg("elapsed_seconds"), F.lit(0.0)).alias("mean"), F.coalesce(F.sum(grown), F.lit(0)).alias("cache_growth"), F.coalesce(F.sum("output_bytes"), F.lit(0)).alias("output")).first()
    lines = [f"- total elapsed: {duration(total.elapsed)}", f"- mean elapsed: {duration(total['mean'])}", f"- cache growth: {mebibytes(total.cache_growth)}", f"- output size: {mebibytes(total.output)}"]
    rows = [f"| {_cell(r[0])} | {duration(r[1])} | {mebibytes(r[2])} | {mebibytes(r[3])} |" for r in runs.select(key, "elapsed_seconds", grown, "output_bytes").orderBy(key).toLocalIterator()]
    table = "\n".join([f"| {key} | elapsed | cache | output |", "|---|---|---|---|", *rows])
    return report("Effort", [("Totals", "\n".join(lines)), ("Runs", table)]), json.dumps(total.asDict(), sort_keys=True)


def experiment_report(matrix: DataFrame, best: DataFrame, wins: DataFrame, quality: DataFrame, key: str) -> str:
    """Markdown of an experiment with strategies: the best of each key, all candidates, wins, and the winners' quality."""
    return report("Experiment", [("Best by key", best.orderBy(key)), ("Candidates", matrix.orderBy(key, "rank")), ("Wins", wins.orderBy(F.desc("wins"), "strategy")), ("Quality of the best", quality)])


def write_comparisons(deltas: DataFrame, key: str, folder: str) -> None:
    """A JSON table of metrics for each value of ``key``, in a folder of its own; keys are spread over the tasks."""
    deltas.repartition(key).sortWithinPartitions(key, "metric").write.partitionBy(key).mode("overwrite").json(folder)


def mebibytes(n: int) -> str:
    return f"{n} B" if abs(n) < 1 << 10 else f"{n / (1 << 20):.1f} MiB"


def duration(seconds: float) -> str:
    s = round(seconds)
    h, m = divmod(s // 60, 60)
    return f"{h}h{m:02d}m{s % 60:02d}s" if h else f"{m}m{s % 60:02d}s"
