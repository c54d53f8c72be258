"""Best-fit packing by a configuration linear program (operator 6).

Documents become pieces of at most SIZE tokens; only longer ones are cut, and the first piece may be
shorter. The histogram of piece lengths (SIZE numbers, whatever the corpus) is the program's demand:
min sum x_c, sum_c count_c(l) x_c >= n_l over configurations c, multisets of lengths that fit a sequence.

``dual`` solves its dual by multiplicative weights: each length has a weight, a knapsack by dynamic
programming prices out the best configuration, and the weights of the lengths that it serves fall by how
much of their demand it serves. Any weights, divided by the value of the best configuration, are feasible,
so each step proves a lower bound. It works on lengths rounded down to a grid, which keeps the bound valid.
``filled`` rounds: a bounded knapsack on these prices, which fall on as demand is served, picks
configurations, each used a whole number of times, and best fit takes what is left. Where that needs more
sequences than best fit of all pieces does, or best fit is within GAP of the bound, best fit's plan stands.
So a plan never has more sequences than best fit's. The solver runs in one task; its size is that of the
histogram, not of the corpus.

Pieces take their places by rank: each task counts its pieces of every length, prefix sums give the
first rank, and the plan maps (length, rank) to (sequence, offset). No task sees all pieces of a length.

Null texts count as empty: one piece with the end id only. Repeated rows are packed each. Texts may have
any length and any runs of blanks. An empty table gives an empty result. Only the two columns named are
read, so extra columns don't clash.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verseloom.llm.shared import map_arrow, materialize, rows
from verseloom.llm.tokens import encoder

SIZE, END_ID = 1024, 2
#: Grid of lengths and steps of the dual, and how far a step lowers the weight of the length that it serves most.
GRID, DUAL_STEPS, DUAL_RATE = 8, 2_000, 0.05
#: Steps of the rounding, part of the possible uses that a step takes, how far a price falls until its demand is served.
STEPS, PART, RATE = 600, 0.5, 0.3
#: Best fit's plan is not improved on when it is this near to the bound.
GAP = 1 / 5_000


class Knapsack:
    """Most valuable multiset of lengths in ``size``, where length k is used ``most[k]`` times at most: exact, by binary parts."""

    def __init__(self, lengths: np.ndarray, most: np.ndarray, size: int) -> None:
        self.size, self.parts = size, []
        for p, (n, left) in enumerate(zip(lengths.tolist(), most.tolist())):
            left, times = min(left, size // n), 1
            while left > 0:
                times = min(times, left)
                self.parts.append((p, times, times * n))
                left, times = left - times, 2 * times
        self.taken = np.zeros((len(self.parts), size + 1), bool)

    def best(self, prices: np.ndarray) -> tuple[float, list[int]]:
        """Value and places in ``lengths``."""
        value, gain, price = np.zeros(self.size + 1), np.empty(self.size + 1), prices.tolist()
        for (p, times, width), taken in zip(self.parts, self.taken):
            more = gain[: self.size + 1 - width]
            np.add(value[: self.size + 1 - width], times * price[p], out=more)
            np.greater(more, value[width:], out=taken[width:])
            np.maximum(value[width:], more, out=value[width:])
        chosen, room = [], self.size
        for (p, times, width), taken in zip(reversed(self.parts), reversed(self.taken)):
            if room >= width and taken[room]:
                chosen += [p] * times
                room -= width
        return float(value[self.size]), chosen


def dual(histogram: dict[int, int], size: int = SIZE, grid: int = GRID, steps: int = DUAL_STEPS) -> tuple[float, np.ndarray]:
    """A lower bound of the number of sequences, and the price of every length up to ``size`` that proves it."""
    demand = np.zeros(size + 1, np.int64)
    demand[list(histogram)] = list(histogram.values())
    plain = np.arange(size + 1) / size
    if not demand.any():
        return 0.0, plain
    bound, price = float(demand @ plain), plain
    coarse = np.arange(size + 1) // grid
    need = np.bincount(coarse, demand)
    at = np.flatnonzero(need[1:]) + 1  # lengths below the grid have no price
    if not len(at):
        return bound, price
    sack = Knapsack(at, np.full(len(at), size), size // grid)
    weight = np.ones(len(at))
    for _ in range(steps):
        value, chosen = sack.best(weight / need[at])
        if weight.sum() / value > bound:
            bound = weight.sum() / value
            price = np.zeros(size // grid + 1)
            price[at] = weight / need[at] / value
            price = np.maximum.accumulate(price)[coarse]
        served = np.bincount(chosen, minlength=len(at)) / need[at]
        weight *= np.exp(-DUAL_RATE * served / served.max())
        weight /= weight.max()
    return bound, price


def filled(histogram: dict[int, int], price: np.ndarray, size: int = SIZE) -> Counter:
    """Configurations with whole uses, by knapsacks on prices that fall as demand is served; best fit for the rest."""
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    left, use = demand.copy(), Counter()
    base = 0.5 * price[lengths] + 0.5 * lengths / size
    sack, open_ = None, np.zeros(0, np.int64)
    for _ in range(STEPS):
        if sack is None:
            open_ = np.flatnonzero(left)
            if not len(open_):
                break
            sack = Knapsack(lengths[open_], left[open_], size)
        chosen = open_[sack.best(base[open_] * np.exp(-RATE * (1 - left[open_] / demand[open_])))[1]]
        counts = np.bincount(chosen, minlength=len(lengths))
        hit = np.flatnonzero(counts)
        times = max(1, int(PART * int((left[hit] // counts[hit]).min())))
        use[tuple(sorted(lengths[chosen].tolist(), reverse=True))] += times
        left[hit] -= counts[hit] * times
        if (left[hit] < np.minimum(demand[hit], size // lengths[hit])).any():  # so few are left that the knapsack must know
            sack = None
    rest = {n: c for n, c in zip(lengths.tolist(), left.tolist()) if c}
    return use + _best_fit(rest, size)


def solve(histogram: dict[int, int], size: int = SIZE) -> tuple[list[tuple[tuple[int, ...], int]], float]:
    """Configurations (lengths, longest first) and how often each is used, exactly the histogram's pieces; and the lower bound."""
    wanted = {n: c for n, c in histogram.items() if c > 0}
    bound, price = dual(wanted, size)
    plan = _best_fit(wanted, size)
    if sum(plan.values()) > np.ceil(bound - 1e-6) * (1 + GAP):
        plan = min(plan, filled(wanted, price, size), key=lambda p: sum(p.values()))
    return sorted(plan.items(), key=lambda x: (tuple(-n for n in x[0]), x[1])), bound


def _best_fit(left: dict[int, int], size: int) -> Counter:
    """Best fit, longest first, on a histogram: equal open sequences are one entry with a count."""
    rooms: dict[int, Counter] = {}  # free room -> configurations
    out: Counter[tuple[int, ...]] = Counter()
    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            fit = min((r for r in rooms if r >= n and rooms[r]), default=None)
            if fit is None:
                per = size // n
                full, rest = divmod(count, per)
                if full:
                    rooms.setdefault(size - per * n, Counter())[(n,) * per] += full
                if rest:
                    rooms.setdefault(size - rest * n, Counter())[(n,) * rest] += 1
                count = 0
            else:
                config, have = next(iter(rooms[fit].items()))
                times = min(have, count)
                rooms[fit][config] -= times
                if not rooms[fit][config]:
                    del rooms[fit][config]
                rooms.setdefault(fit - n, Counter())[(*config, n)] += times
                count -= times
    for configs in rooms.values():
        for config, times in configs.items():
            out[tuple(sorted(config, reverse=True))] += times
    return out


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces a sequence, first sequence, first offset): a run of ranks each."""
    base, taken = 0, Counter()
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    for config, times in plan:
        offset = 0
        for n, k in sorted(Counter(config).items(), reverse=True):
            out.setdefault(n, []).append((taken[n], k, base, offset))
            taken[n] += k * times
            offset += n * k
        base += times
    return {n: np.array(v, np.int64) for n, v in out.items()}


def planned(histogram: DataFrame, size: int = SIZE) -> dict[int, np.ndarray]:
    """``places`` of the plan for (length, n), solved in a task. The histogram has ``size`` rows at most, the plan few a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: Counter[int] = Counter()
        for lengths, counts in rows(batches):
            wanted.update(dict(zip(lengths, counts)))
        table = places(solve(wanted, size)[0])
        yield pa.RecordBatch.from_arrays([pa.array(list(table), pa.int64()), pa.array([v.ravel().tolist() for v in table.values()], pa.list_(pa.int64()))], ["length", "runs"])

    found = map_arrow(histogram.select("length", "n").coalesce(1), run, "length long, runs array<long>").collect()
    return {r.length: np.array(r.runs, np.int64).reshape(-1, 4) for r in found}


def pieces(df: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank): rank counts the pieces of a length in their task ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for ids, texts in rows(batches, 256):
            cols: list[list] = [[] for _ in range(7)]
            for i, text in zip(ids, texts):
                own = np.append(code.ids(text or ""), end_id).astype("<u4")
                first = len(own) % size
                cuts = [0, *range(first or size, len(own) + 1, size)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    n = b - a
                    for col, v in zip(cols, (i, k, a, n, zlib.crc32(own[a:b].tobytes()), part, int(seen[n]))):
                        col.append(v)
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return map_arrow(df.select(F.col(id_col).cast("long"), F.col(text_col)), run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


def pack(df: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece."""
    cut = materialize(pieces(df, path, size, end_id, id_col, text_col), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    table = planned(counts.groupBy("length").agg(F.sum("n").alias("n")), size)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "length", "first")
    ranked = cut.join(first, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                run_of = table[n][np.searchsorted(table[n][:, 0], ranks[at], "right") - 1]
                within = ranks[at] - run_of[:, 0]
                sequence[at] = run_of[:, 2] + within // run_of[:, 1]
                offset[at] = run_of[:, 3] + within % run_of[:, 1] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return map_arrow(ranked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
