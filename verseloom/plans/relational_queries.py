"""Queries over joins, rankings, gates, archives and captions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verseloom.functions import scores as S
from verseloom.functions import text as X
from verseloom.functions import timecode as C
from verseloom.operators import distance as D
from verseloom.operators import gate as G
from verseloom.operators import joins as J
from verseloom.operators import ranking as R
from verseloom.operators import sequence as W
from verseloom.operators import words as V
from verseloom.plans.scalar_queries import EV, SLIDES, WORDS, conversation_slides, ev, longs, read, sql_percent, sql_phrase, sql_ratio, sql_token
from verseloom.sources import captions, ini

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: longs(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(
    f"""WITH RECURSIVE {EV}, f AS MATERIALIZED (SELECT user_id, idx, source, start, row_number() OVER (PARTITION BY user_id ORDER BY start, "end", idx) AS k FROM ev),
    r AS (SELECT user_id, k, idx, source, start, source AS last, start AS at, true AS kept FROM f WHERE k = 1
      UNION ALL SELECT f.user_id, f.k, f.idx, f.source, f.start, CASE WHEN x.drop THEN r.last ELSE f.source END, CASE WHEN x.drop THEN r.at ELSE f.start END, NOT x.drop
      FROM r JOIN f ON f.user_id = r.user_id AND f.k = r.k + 1, LATERAL (SELECT f.source = r.last AND abs(f.start - r.at) < 7200 AS drop) x)
    SELECT user_id, idx AS word_idx, source AS text, start FROM r WHERE kept"""
)
def dedupe_words(spark, d):
    e = ev(spark, d).select("user_id", F.col("idx").alias("word_idx"), F.col("source").alias("text"), "start", "end")
    return V.deduplicated_words(e, ["user_id"], window=7200).drop("end")


@query(f'WITH {EV}, o AS (SELECT user_id, coalesce(start < lag("end") OVER (PARTITION BY user_id ORDER BY start, "end", idx) - 0.05, false) AS over FROM ev) SELECT user_id, count(*) FILTER (over) AS overlaps, count(*) AS n FROM o GROUP BY user_id')
def overlap_adjacent(spark, d):
    return W.overlaps(ev(spark, d), ["user_id"])


@query(f'WITH {EV} SELECT user_id, idx, start - lag(start) OVER (PARTITION BY user_id ORDER BY start, "end", idx) AS step FROM ev')
def adjacent_steps(spark, d):
    return W.adjacent(ev(spark, d), ["user_id"], ["start", "end", "idx"]).select("user_id", "idx", "step")


@query(
    f"""WITH {EV} SELECT a.user_id, a.idx AS a_idx, b.idx AS b_idx, least(1.0, greatest(0.0, (least(a."end", b."end") - greatest(a.start, b.start)) / greatest(least(a."end" - a.start, b."end" - b.start), 0.001)))::DOUBLE AS overlap
    FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.source < b.source AND b.start <= a."end" + 1800 AND b."end" >= a.start - 1800"""
)
def interval_overlap_join(spark, d):
    return J.overlap_pairs(ev(spark, d), "user_id", 1800.0).select("user_id", "a_idx", "b_idx", "overlap")


@query(
    f"""WITH {EV}, h AS (SELECT user_id, idx, CASE WHEN idx % 4 = 0 THEN start END AS s, CASE WHEN idx % 4 = 0 THEN start + 0.2 END AS e FROM ev),
    k AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fr, first_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS t, s IS NULL AS missing FROM h),
    f AS (SELECT *, coalesce(missing <> lag(missing) OVER (PARTITION BY user_id ORDER BY idx), true)::INT AS fresh FROM k), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY idx) AS run FROM f),
    n AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS n, row_number() OVER (PARTITION BY user_id, run ORDER BY idx) AS k FROM r),
    b AS (SELECT *, coalesce(fr, greatest(0.0, t - (n + 1) * 0.5), 0.0)::DOUBLE AS lo FROM n), c AS (SELECT *, greatest(coalesce(t, lo + (n + 1) * 0.5), lo)::DOUBLE AS hi FROM b), x AS (SELECT *, (hi - lo) / (n + 1) AS slot FROM c)
    SELECT user_id, idx, missing, CASE WHEN missing THEN lo + slot * k ELSE s END AS start, CASE WHEN missing THEN lo + slot * k + least(0.4, greatest(0.02, slot * 0.7)) ELSE e END AS "end" FROM x"""
)
def neighbour_interpolation(spark, d):
    known = F.col("idx") % 4 == 0
    e = ev(spark, d).select("user_id", "idx", F.when(known, F.col("start")).alias("start"), F.when(known, F.col("start") + 0.2).alias("end"))
    return W.interpolated(e, ["user_id"], ["idx"])


@query(
    f"""WITH t AS (SELECT conv_id, turn, string_split({sql_phrase('text')}, ' ') AS cur FROM conversations), p AS (SELECT *, lag(cur) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM t)
    SELECT conv_id, turn, coalesce((SELECT max(n) FROM unnest(range(1, least(len(prev), len(cur)) + 1)) AS u(n) WHERE prev[len(prev) - n + 1 : len(prev)] = cur[1:n]), 0)::BIGINT AS overlap FROM p"""
)
def caption_overlap(spark, d):
    c = read(spark, d, "conversations").withColumn("cur", F.split(X.phrase_form("text"), " "))
    prev = F.lag("cur").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("prev", prev).select("conv_id", "turn", F.when(F.col("prev").isNull(), 0).otherwise(X.caption_overlap(F.col("prev"), F.col("cur"))).alias("overlap"))


@query(
    """WITH m AS (SELECT lang, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), s AS (SELECT *, doc_id - row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS span FROM m),
    g AS (SELECT lang, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n FROM s GROUP BY lang, span), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY first) AS rank FROM g)
    SELECT lang, first, last, n, rank FROM r WHERE rank <= 5"""
)
def index_spans(spark, d):
    missing = read(spark, d, "documents").select("lang", "doc_id").join(read(spark, d, "labels"), "doc_id", "left_anti")
    spans = W.consecutive_spans(missing, ["lang"], "doc_id")
    return W.first_spans(spans, ["lang"], 5)


@query(
    f"""WITH RECURSIVE b AS (SELECT item_id, string_split({sql_phrase('text')}, ' ') AS ref FROM benchmark), p AS MATERIALIZED (SELECT x.item_id, x.ref, y.ref AS out FROM b x JOIN b y ON y.item_id = x.item_id + 1),
    r AS (SELECT item_id, ref, out, 0 AS i, range(0, len(out) + 1)::BIGINT[] AS row FROM p
      UNION ALL SELECT item_id, ref, out, i + 1, list_reduce(range(1, len(out) + 1)::BIGINT[], lambda acc, j: list_append(acc, least(acc[len(acc)] + 1, row[j + 1] + 1, row[j] + CASE WHEN out[j] = ref[i + 1] THEN 0 ELSE 1 END)), [row[1] + 1]::BIGINT[]) FROM r WHERE i < len(ref))
    SELECT item_id, row[len(row)]::BIGINT AS edits, (row[len(row)]::DOUBLE / len(ref)) AS wer, greatest(0.0, 1 - row[len(row)]::DOUBLE / len(ref))::DOUBLE AS similarity,
    (len(list_intersect(list_distinct(ref), list_distinct(out)))::DOUBLE / len(list_distinct(ref))) AS recall, (len(list_intersect(list_distinct(ref), list_distinct(out)))::DOUBLE / len(list_distinct(out))) AS precision FROM r WHERE i = len(ref)""".replace(
        "list_reduce(range(1, len(out) + 1)::BIGINT[], lambda acc, j: list_append(acc, least(acc[len(acc)] + 1, row[j + 1] + 1, row[j] + CASE WHEN out[j] = ref[i + 1] THEN 0 ELSE 1 END)), [row[1] + 1]::BIGINT[])",
        "list_reduce(list_transform(range(1, len(out) + 1), lambda j: [j::BIGINT]), lambda acc, j: list_append(acc, least(acc[len(acc)] + 1, row[j[1] + 1] + 1, row[j[1]] + CASE WHEN out[j[1]] = ref[i + 1] THEN 0 ELSE 1 END)), [row[1] + 1]::BIGINT[])",
    )
)
def edit_distance(spark, d):
    b = read(spark, d, "benchmark").select("item_id", F.split(X.phrase_form("text"), " ").alias("ref"))
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("ref").alias("out")), "item_id")
    return D.reference_metrics(pairs).drop("ref", "out")


@query("WITH m AS (SELECT user_id, max_by({'t': event_type, 'v': value}, event_id) AS r, min(event_id) AS seen FROM events GROUP BY user_id) SELECT user_id, r.t AS event_type, r.v AS value, seen FROM m")
def last_wins_metadata(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "value", "event_id")
    return J.last_wins(e, "user_id", "event_id").select("user_id", "event_type", "value", "seen")


@query(
    r"""WITH r AS (SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, url, CASE WHEN regexp_matches(url, '/de/') THEN 0 WHEN regexp_matches(url, '/fr/') THEN 1 WHEN regexp_matches(url, '/') THEN 2 END AS rank FROM pages)
    SELECT host, arg_min(url, {'r': rank, 'u': url}) AS url, min(rank)::BIGINT AS rank FROM r WHERE rank IS NOT NULL GROUP BY host"""
)
def priority_pick(spark, d):
    p = read(spark, d, "pages").select(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"), "url")
    return J.priority_pick(p, "host", "url", ["/de/", "/fr/", "/"])


@query(
    """SELECT o.o_orderkey, coalesce(a.c_name, b.c_name) AS c_name FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) a ON a.c_custkey = o.o_custkey
    LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) b ON b.c_custkey = o.o_orderkey % 100"""
)
def fallback_reference(spark, d):
    names = read(spark, d, "customer").where("c_custkey % 2 = 0")
    orders = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("first"), (F.col("o_orderkey") % 100).alias("second"))
    return J.fallback_lookup(orders, names, "first", "second", "c_custkey", "c_name").select("o_orderkey", "c_name")


@query(
    """WITH s AS (SELECT DISTINCT user_id, event_type AS source FROM events WHERE value > 60), x AS (SELECT u.user_id, e.source FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT event_type AS source FROM events) e)
    SELECT user_id, source, 'not available' AS reason FROM x WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = x.user_id AND s.source = x.source)"""
)
def availability_anti(spark, d):
    e = read(spark, d, "events").withColumnRenamed("event_type", "source")
    kinds = e.agg(F.collect_set("source").alias("kinds"))  # a handful of names
    expected = e.select("user_id").distinct().join(F.broadcast(kinds)).select("user_id", F.explode("kinds").alias("source"))
    return J.missing_sources(e.where("value > 60").select("user_id", "source"), expected, ["user_id"], "not available")


@query("SELECT DISTINCT d.source, d.lang FROM documents d SEMI JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1")
def best_of_semi(spark, d):
    good = read(spark, d, "labels").where("quality = 1")
    return read(spark, d, "documents").join(good, "doc_id", "left_semi").select("source", "lang").dropDuplicates()


def candidates(spark, d):
    """Orders as candidates of a customer: the priority is the strategy."""
    o = read(spark, d, "orders")
    ratio = (F.col("o_orderkey") % 17) / F.lit(10.0)
    cols = [F.col("o_custkey").alias("video"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("strategy"), (F.col("o_orderkey") % 7).alias("hard"), (F.col("o_orderkey") % 5).alias("fast")]
    c = o.select(*cols, (F.col("o_orderkey") % 100 / 100.0).cast("double").alias("consensus"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 90 / 90.0).cast("double").alias("caption"), ratio.alias("ratio"))
    return c.withColumn("score", S.candidate_score(F.col("consensus"), F.col("caption"), F.col("hard"), F.col("ord") % 11, F.col("fast"), (F.col("ord") % 10) / F.lit(10.0), F.col("ratio")))


CAND = """cand AS (SELECT o_custkey AS video, o_orderkey AS ord, o_orderpriority AS strategy, o_orderkey % 7 AS hard, o_orderkey % 5 AS fast, (o_orderkey % 100 / 100.0)::DOUBLE AS consensus,
  CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 90 / 90.0)::DOUBLE END AS caption, (o_orderkey % 17 / 10.0)::DOUBLE AS ratio FROM orders),
 sc AS (SELECT *, (CASE WHEN caption IS NULL THEN consensus * 100.0 ELSE consensus * 45.0 + caption * 55.0 END - hard * 10.0 - (ord % 11) * 0.8 - fast * 4.0 - greatest(0.0, (ord % 10) / 10.0 - 0.3) * 40.0 - CASE WHEN ratio NOT BETWEEN 0.65 AND 1.45 THEN 15.0 ELSE 0.0 END)::DOUBLE AS score FROM cand),
 best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY video ORDER BY score DESC, ord) = 1)"""


@query(f"WITH {CAND} SELECT video, ord, strategy, round(score, 6) AS score FROM best")
def best_candidate(spark, d):
    return R.best_candidates(candidates(spark, d), "video").select("video", "ord", "strategy", F.round("score", 6).alias("score"))


@query(f"WITH {CAND} SELECT strategy, count(*) AS wins FROM best GROUP BY strategy")
def strategy_wins(spark, d):
    return R.strategy_wins(R.best_candidates(candidates(spark, d), "video"))


@query(f"WITH {CAND} SELECT round(avg(consensus), 9) AS mean_consensus, round(avg(coalesce(caption, 0)), 9) AS mean_caption, sum(hard)::BIGINT AS hard, sum(fast)::BIGINT AS fast FROM best")
def winner_quality(spark, d):
    q = R.winner_quality(R.best_candidates(candidates(spark, d), "video"))
    return q.select(F.round("mean_consensus", 9).alias("mean_consensus"), F.round("mean_caption", 9).alias("mean_caption"), "hard", "fast")


@query(f"WITH {CAND} SELECT video, strategy, ord, row_number() OVER (PARTITION BY video ORDER BY score DESC, strategy, ord) AS rank FROM sc")
def candidate_matrix(spark, d):
    c = candidates(spark, d)
    return J.ranked(c, ["video"], [F.desc("score"), F.col("strategy"), F.col("ord")]).select("video", "strategy", "ord", "rank")


@query(
    """WITH c AS (SELECT l_orderkey AS song, l_linenumber AS cand, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_quantity END AS n FROM lineitem), m AS (SELECT *, coalesce(median(CASE WHEN n > 0 THEN n END) OVER (PARTITION BY song), 0.0) AS med FROM c)
    SELECT song, cand::BIGINT AS cand, med AS median_words, CASE WHEN med < 8 THEN greatest(2, ceil(med * 0.45)) ELSE greatest(4, least(30, floor(med * 0.45))) END::BIGINT AS least_words FROM m"""
)
def whole_candidates(spark, d):
    c = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("song"), F.col("l_linenumber").alias("cand"), F.when(F.col("l_linenumber") % 3 == 0, 0.0).otherwise(F.col("l_quantity")).alias("n_words"))
    return R.whole_candidate_stats(c, "song").select("song", "cand", "median_words", S.least_candidate_words(F.col("median_words")).alias("least_words"))


@query(
    f"""WITH x AS (SELECT l_orderkey AS song, l_discount < 0.02 AS low, l_linenumber % 3 AS support, 3 AS cands, l_tax > 0.06 AS ov, 2.0 AS ph FROM lineitem),
    a AS (SELECT song, count(*) AS n, count(*) FILTER (low) AS low, count(*) FILTER (support <= 1) AS single, count(*) FILTER (ov) AS "overlaps", greatest(count(*) - 1, 1) AS pairs FROM x GROUP BY song)
    SELECT song, n, "overlaps", array_to_string(list_filter([CASE WHEN low::DOUBLE / n >= 0.25 THEN printf('low-confidence phrases %d/%d (', low, n) || {sql_percent('low::DOUBLE / n')} || ')' END,
    CASE WHEN single::DOUBLE / n >= 0.45 THEN printf('single-source phrase winners %d/%d (', single, n) || {sql_percent('single::DOUBLE / n')} || ')' END,
    CASE WHEN "overlaps" >= 2 OR "overlaps" > 0 AND "overlaps"::DOUBLE / pairs >= 0.1 THEN printf('overlapping phrase windows %d/%d (', "overlaps", pairs) || {sql_percent('"overlaps"::DOUBLE / pairs')} || ')' END,
    CASE WHEN n > 7 THEN printf('phrase fragmentation %d decisions vs median candidate 2.0', n) END], lambda r: r IS NOT NULL), '; ') AS reasons FROM a"""
)
def consensus_risk(spark, d):
    li = read(spark, d, "lineitem")
    x = li.select(F.col("l_orderkey").alias("song"), (F.col("l_discount") < 0.02).alias("low"), (F.col("l_linenumber") % 3).alias("support"), F.lit(3).alias("n_candidates"), (F.col("l_tax") > 0.06).alias("overlap"), F.lit(2.0).alias("median_phrases"))
    return R.risk_reasons(x, "song")


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity / 20.0 AS ratio FROM lineitem) SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
    round(CASE WHEN ratio BETWEEN 0.75 AND 1.35 THEN abs(ratio - 1) * 6 ELSE 18 + 10 * least(abs(ln(greatest(ratio, 0.01))), 2.5) END, 9)::DOUBLE AS penalty, (greatest(l_linenumber * 8 - 28, 0) * 2.0 - CASE WHEN l_linenumber * 8 <= 28 THEN 12.0 ELSE 0.0 END)::DOUBLE AS line_score FROM r"""
)
def score_arithmetic(spark, d):
    li = read(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(S.coverage_penalty(F.col("l_quantity") / 20.0), 9).alias("penalty"), S.line_score(F.col("l_linenumber") * 8).alias("line_score"))


def _archive_measures() -> dict:
    q = F.col("l_quantity").cast("long")
    return {
        "slide_count": F.lit(1),
        "line_count": F.col("l_linenumber").cast("long"),
        "over_hard": (q > 48).cast("long"),
        "over_target": (q > 35).cast("long"),
        "aux_words": (F.col("l_tax") > 0.07).cast("long"),
        "fast_transitions": (F.col("l_discount") < 0.005).cast("long"),
        "text_words": q,
        "hard_wrapped_line_count": F.greatest(F.col("l_linenumber").cast("long"), F.ceil(q / 34)),
        "hard_wrapped_slide_count": (q > 0).cast("long"),
    }


def comparison(spark, d):
    """Line items as archives: a supplier is a video, the return flag a side. Both sides are in one table, so one aggregation compares them."""
    side = F.when(F.col("l_returnflag") == "A", "b").when(F.col("l_returnflag") == "R", "p")
    sums = [F.sum(F.when(F.col("side") == s, m)).cast("long").alias(f"{s}_{n}") for s in "bp" for n, m in _archive_measures().items()]
    by = read(spark, d, "lineitem").withColumn("side", side).where("side is not null").groupBy(F.col("l_suppkey").alias("video")).agg(*sums)
    return G.with_optional(by)


def _side(s: str, flag: str) -> str:
    return f"""{s} AS (SELECT l_suppkey AS video, count(*) AS {s}_slide_count, sum(l_linenumber)::BIGINT AS {s}_line_count, count(*) FILTER (floor(l_quantity) > 48) AS {s}_over_hard, count(*) FILTER (floor(l_quantity) > 35) AS {s}_over_target,
  count(*) FILTER (l_tax > 0.07) AS {s}_aux_words, count(*) FILTER (l_discount < 0.005) AS {s}_fast_transitions, sum(floor(l_quantity))::BIGINT AS {s}_text_words, sum(greatest(l_linenumber, ceil(floor(l_quantity) / 34.0)))::BIGINT AS {s}_hard_wrapped_line_count,
  count(*) FILTER (floor(l_quantity) > 0) AS {s}_hard_wrapped_slide_count FROM lineitem WHERE l_returnflag = '{flag}' GROUP BY l_suppkey)"""


COMPARED = f"""{_side('b', 'A')}, {_side('p', 'R')}, cmp AS (SELECT *, b_slide_count IS NOT NULL AND p_slide_count IS NOT NULL AS complete FROM b FULL OUTER JOIN p USING (video)),
 done AS (SELECT *, greatest(b_slide_count, coalesce(nullif(b_hard_wrapped_slide_count, 0), b_slide_count)) AS slide_base, greatest(b_line_count, coalesce(nullif(b_hard_wrapped_line_count, 0), b_line_count)) AS line_base,
  greatest(1.0, {sql_ratio('p_text_words', 'b_text_words')})::DOUBLE AS scale FROM cmp WHERE complete)"""
_SUMS = ", ".join(f"coalesce(sum({s}_{m}), 0)::BIGINT AS {s}_{m}" for s in "bp" for m in G.METRICS[:7])
_EXPECTED = "(SELECT count(*) FROM supplier)"
GATE_SQL = f"""WITH {COMPARED}, t AS (SELECT count(*) AS n, {_SUMS}, coalesce(sum(slide_base), 0)::BIGINT AS slide_base, coalesce(sum(line_base), 0)::BIGINT AS line_base, coalesce(sum(ceil(slide_base * 1.5::DOUBLE * scale)), 0)::BIGINT AS slide_allowance, coalesce(sum(ceil(line_base * 1.75::DOUBLE * scale)), 0)::BIGINT AS line_allowance,
  coalesce(sum(greatest(p_slide_count - 1, 0)), 0)::BIGINT AS slots, coalesce(bool_and(p_slide_count <= greatest(slide_base + 4, ceil(slide_base * 2.0::DOUBLE * scale))), true) AS es, coalesce(bool_and(p_line_count <= greatest(line_base + 8, ceil(line_base * 2.5::DOUBLE * scale))), true) AS el, coalesce(bool_and({sql_ratio('p_over_target', 'p_line_count')} <= 0.3), true) AS et FROM done),
  g AS (SELECT *, n = {_EXPECTED} AS full_set FROM t),
  h AS (SELECT * EXCLUDE (es, el, et), full_set AND p_over_hard <= b_over_hard AS hard_gate, full_set AND p_slide_count <= slide_allowance AND es AS slide_gate, full_set AND p_line_count <= line_allowance AND el AS line_gate,
   full_set AND (p_fast_transitions <= b_fast_transitions OR {sql_ratio('p_fast_transitions', 'slots')} <= 0.05) AS fast_gate, full_set AND p_aux_words - b_aux_words <= greatest(10, ceil(b_aux_words * 0.5)) AND {sql_ratio('p_aux_words', 'p_text_words')} <= 0.1 AS aux_gate,
   full_set AND {sql_ratio('p_over_target', 'p_line_count')} <= 0.3 AND et AS target_gate FROM g)
  SELECT *, full_set AND hard_gate AND slide_gate AND line_gate AND fast_gate AND aux_gate AND target_gate AS passed,
  array_to_string(list_filter([CASE WHEN NOT full_set THEN printf('full set: %d of %d', n, {_EXPECTED}) END, {', '.join(f"CASE WHEN NOT {g}_gate THEN '{g} gate failed' END" for g in ('hard', 'slide', 'line', 'fast', 'aux', 'target'))}], lambda x: x IS NOT NULL), '; ') AS failures FROM h"""


@query(GATE_SQL)
def batch_gate(spark, d):
    expected = read(spark, d, "supplier").count()  # the number of videos that the batch has to hold
    gate = G.batch_gate(comparison(spark, d), expected).drop(*G.REFERENCE_AND_COSTS)  # lineitem has neither expected texts nor costs
    return gate.withColumn("failures", F.array_join(F.filter("failures", lambda x: x != G.REFERENCE_FAILED), "; "))


_REFERENCES = """SELECT video, CASE WHEN p_slide_count IS NOT NULL AND video % 5 <> 0 THEN 0.82 + video % 8 / 64.0::DOUBLE END AS p, CASE WHEN b_slide_count IS NOT NULL AND video % 3 <> 0 THEN 0.8 + video % 7 / 64.0::DOUBLE END AS b, p_text_words / 4.0::DOUBLE AS elapsed, p_text_words * 3 AS bytes, p_slide_count * 100 AS before, p_line_count * 100 AS after, complete FROM cmp"""


@query(
    f"""WITH {COMPARED}, x AS ({_REFERENCES}), r AS (SELECT count(p) FILTER (complete) AS reference_count, min(p) FILTER (complete) AS least_similarity, coalesce(sum(elapsed), 0) AS elapsed_total, coalesce(avg(elapsed), 0) AS elapsed_average, coalesce(sum(bytes), 0)::BIGINT AS output_bytes, coalesce(max(after) - min(before), 0)::BIGINT AS cache_growth,
      coalesce(bool_and(p IS NULL OR (p >= 0.8 AND (b IS NULL OR p >= b - 0.02))) FILTER (complete), true) AS each FROM x), g AS ({GATE_SQL})
    SELECT g.* EXCLUDE (passed, failures), r.* EXCLUDE (each), full_set AND each AS reference_gate, passed AND each AS passed, concat_ws('; ', nullif(failures, ''), CASE WHEN NOT (full_set AND each) THEN 'reference gate failed' END) AS failures FROM g, r"""
)
def batch_gate_with_references(spark, d):
    """The whole gate, with stand-ins for similarities to expected texts and for the costs of a run."""
    v, has = F.col("video"), lambda s: F.col(f"{s}_slide_count").isNotNull()
    rows = comparison(spark, d).withColumns(
        {
            "baseline_similarity": F.when(has("b") & (v % 3 != 0), 0.8 + v % 7 / 64.0),
            "phase_similarity": F.when(has("p") & (v % 5 != 0), 0.82 + v % 8 / 64.0),
            "elapsed_seconds": F.col("p_text_words") / 4.0,
            "output_bytes": F.col("p_text_words") * 3,
            "cache_bytes_before": F.col("p_slide_count") * 100,
            "cache_bytes_after": F.col("p_line_count") * 100,
        }
    )
    gate = G.batch_gate(rows, read(spark, d, "supplier").count())
    return gate.withColumn("failures", F.array_join("failures", "; "))


@query(f"WITH {COMPARED} SELECT video, u.m AS metric, u.b AS baseline, u.p AS phase, u.p - u.b AS delta FROM (SELECT video, unnest([{', '.join(f'''{{'m': '{m}', 'b': b_{m}, 'p': p_{m}}}''' for m in G.METRICS[:7])}]) AS u FROM cmp)")
def metric_delta(spark, d):
    return G.metric_deltas(comparison(spark, d), "video")


@query(f"WITH {COMPARED} SELECT video, slide_base, line_base, ceil(slide_base * 1.5::DOUBLE * scale)::BIGINT AS slide_limit, ceil(line_base * 1.75::DOUBLE * scale)::BIGINT AS line_limit FROM done")
def scaled_allowance(spark, d):
    c = comparison(spark, d).where("complete").withColumn("slide_base", G.comparable("slide")).withColumn("line_base", G.comparable("line")).withColumn("scale", G.content_scale())
    return c.select("video", "slide_base", "line_base", F.ceil(F.col("slide_base") * 1.5 * F.col("scale")).alias("slide_limit"), F.ceil(F.col("line_base") * 1.75 * F.col("scale")).alias("line_limit"))


@query(
    f"""WITH {COMPARED}, u AS (SELECT video, unnest([{{'g': 'slide', 'r': {sql_ratio('p_slide_count', 'slide_base')}, 'bad': p_slide_count > greatest(slide_base + 4, ceil(slide_base * 2.0::DOUBLE * scale))}},
    {{'g': 'line', 'r': {sql_ratio('p_line_count', 'line_base')}, 'bad': p_line_count > greatest(line_base + 8, ceil(line_base * 2.5::DOUBLE * scale))}}, {{'g': 'target', 'r': {sql_ratio('p_over_target', 'p_line_count')}, 'bad': {sql_ratio('p_over_target', 'p_line_count')} > 0.3}},
    {{'g': 'fast', 'r': {sql_ratio('p_fast_transitions', 'greatest(p_slide_count - 1, 1)')}, 'bad': p_fast_transitions > b_fast_transitions}}]) AS x FROM done),
    r AS (SELECT x.g AS gate, row_number() OVER (PARTITION BY x.g ORDER BY x.r DESC, video DESC) AS rank, video, x.r AS ratio FROM u WHERE x.bad) SELECT * FROM r WHERE rank <= 5"""
)
def top5_failures(spark, d):
    return G.top_failures(comparison(spark, d), "video")


@query(
    r"""WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS n, array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), lambda x: trim(regexp_replace(translate(x, '|', ' '), '\s+', ' ', 'g'))), '|') AS letra,
      CASE WHEN role = 'system' THEN '(2x)' WHEN conv_id % 7 = 0 THEN role ELSE '' END AS aux, (turn * (2 + conv_id % 3))::BIGINT AS t FROM conversations),
    b AS (SELECT conv_id, n, '[Slide:' || n || ']' || E'\r\n' || 'tipo=LETRA' || E'\r\nletra=' || letra || E'\r\nfundo_letra=1\r\ntamanho_letra=20\r\ncor_letra=#FFFFFF\r\ncor_fundo=#000000' || CASE WHEN aux <> '' THEN E'\r\nletra_aux=' || aux ELSE '' END
      || E'\r\ntamanho_letra_aux=10\r\ncor_letra_aux=#EFB400\r\nimagem=imagens\\slides.jpg\r\nimagem_posicao=5\r\ntempo=' || printf('%02d:%02d:%02d', t // 3600, (t // 60) % 60, t % 60) || E'\r\n\r\n' AS body FROM s)
    SELECT conv_id, sha256(regexp_replace(E'[Geral]\r\nslides=' || (count(*) + 1) || E'\r\nversao=25.0.17424.39578\r\nurl_musica=audio\\audio.mp3\r\naudio=1\r\n\r\n[Slide:1]\r\ntipo=CAPA\r\nletra=song ' || conv_id || E'\r\nfundo_letra=1\r\ntamanho_letra=20\r\ncor_letra=#FFFFFF\r\ncor_fundo=#000000\r\ntamanho_letra_aux=10\r\ncor_letra_aux=#EFB400\r\nimagem=imagens\\Capa.jpg\r\nimagem_posicao=5\r\ntempo=00:00:00\r\n\r\n'
      || string_agg(body, '' ORDER BY n), '\r\n\r\n$', chr(13) || chr(10))) AS digest FROM b GROUP BY conv_id"""
)
def render_lja_text(spark, d):
    slides = conversation_slides(spark, d).withColumn("title", F.concat(F.lit("song "), "conv_id"))
    return ini.render_sections(slides, "conv_id", "title").select("conv_id", F.sha2("lja", 256).alias("digest"))


@query(
    r"""WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 2 AS section_no, array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), lambda x: trim(regexp_replace(translate(x, '|', ' '), '\s+', ' ', 'g'))), '|') AS text,
      CASE WHEN role = 'system' THEN '(2x)' WHEN conv_id % 7 = 0 THEN role END AS aux, (turn * (2 + conv_id % 3))::BIGINT AS t FROM conversations)
    SELECT conv_id, section_no, 'LETRA' AS kind, text, aux, printf('%02d:%02d:%02d', t // 3600, (t // 60) % 60, t % 60) AS time FROM s"""
)
def parse_lja_sections(spark, d):
    slides = conversation_slides(spark, d).withColumn("title", F.concat(F.lit("song "), "conv_id"))
    sections = ini.parse_sections(ini.render_sections(slides, "conv_id", "title"), "conv_id", "lja")
    return ini.slides_of(sections, "conv_id").where("kind = 'LETRA'").drop("section")


@query("SELECT doc_id, substring(sha256(lang || '|' || source || '|' || n_chars), 1, 16) AS key, 'cache/' || lang || '/text/' || substring(sha256(text), 1, 16) || '.json' AS path FROM documents")
def cache_keys(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", X.cache_key(F.concat_ws("|", "lang", "source", "n_chars")).alias("key"), F.concat(F.lit("cache/"), "lang", F.lit("/text/"), X.cache_key("text"), F.lit(".json")).alias("path"))


def vtt_files(spark, d):
    """Conversations as caption files: a cue a turn, with tags and a rolling overlap."""
    c = read(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.coalesce(F.lag(F.element_at(F.split(X.squeeze("text"), " "), -1)).over(w), F.lit("x"))
    cue = F.concat(F.format_string("00:%02d:%02d.000 --> 00:%02d:%02d.500 align:start\n<c>", F.col("turn"), F.lit(0), F.col("turn"), F.lit(30)), before, F.lit("</c> "), X.squeeze("text"), F.lit("\n\n"))
    parts = c.withColumn("cue", cue).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "cue"))), lambda x: x["cue"]), "").alias("body"))
    return parts.select("conv_id", F.concat(F.lit("WEBVTT\nKind: captions\n\n"), "body").alias("vtt"))


@query(
    f"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations), q AS (SELECT conv_id, turn, row_number() OVER w AS cue, coalesce(lag(string_split(t, ' ')[-1]) OVER w, 'x') || ' ' || t AS line FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    k AS (SELECT *, string_split(trim(regexp_replace(regexp_replace(line, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')), ' ') AS words FROM q), f AS (SELECT *, list_transform(words, lambda x: {sql_phrase('x')}) AS form FROM k),
    p AS (SELECT *, lag(form) OVER (PARTITION BY conv_id ORDER BY cue) AS prev FROM f), o AS (SELECT *, coalesce((SELECT max(n) FROM unnest(range(1, least(len(prev), len(form)) + 1)) AS u(n) WHERE prev[len(prev) - n + 1 : len(prev)] = form[1:n]), 0) AS n FROM p)
    SELECT conv_id, cue, (turn * 60.0)::DOUBLE AS start, (turn * 60.0 + 30.5)::DOUBLE AS "end", array_to_string(words[n + 1 :], ' ') AS text FROM o WHERE len(words) > n"""
)
def vtt_cues(spark, d):
    return captions.without_overlap(captions.cue_rows(vtt_files(spark, d), "conv_id", "vtt"), "conv_id")


HINTED = f"""{WORDS}, hw AS (SELECT *, word_idx // 6 AS line_index, word_idx // 40 AS section_index FROM words WHERE doc_id % 3 = doc_id % 3),
 hb AS (SELECT *, coalesce(lead(section_index) OVER w <> section_index, false) AS section_after, coalesce(lead(section_index) OVER w <> section_index, false) OR coalesce(lead(line_index) OVER w <> line_index, false) AS line_after,
  regexp_matches(rtrim(text), '[.!?]$') AS terminal, coalesce(lead(start) OVER w - "end" >= 0.6, false) AS pause_after, coalesce(lead(section_index) OVER w <> section_index, false) OR coalesce(lead(start) OVER w - "end" >= 3.0, false) AS strong_after FROM hw WINDOW w AS (PARTITION BY doc_id ORDER BY word_idx))"""


def hinted(spark, d):
    w = V.timed_words(read(spark, d, "documents"))
    return W.boundaries(w.withColumn("line_index", F.floor(F.col("word_idx") / 6)).withColumn("section_index", F.floor(F.col("word_idx") / 40)), ["doc_id"])


@query(f"WITH {HINTED} SELECT doc_id, word_idx, section_after, line_after, terminal, pause_after, min(CASE WHEN strong_after THEN word_idx END) OVER (PARTITION BY doc_id ORDER BY word_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS strong_idx FROM hb".replace(" WHERE doc_id % 3 = doc_id % 3", ""))
def word_boundaries(spark, d):
    return W.first_strong(hinted(spark, d), ["doc_id"]).select("doc_id", "word_idx", "section_after", "line_after", "terminal", "pause_after", "strong_idx")


@query(
    f"""WITH RECURSIVE {HINTED}, c AS (SELECT *, coalesce(lag(line_after OR terminal OR pause_after) OVER (PARTITION BY doc_id ORDER BY word_idx), false)::INT AS rs FROM hb), n AS (SELECT *, sum(rs) OVER (PARTITION BY doc_id ORDER BY word_idx) AS run FROM c),
    p AS MATERIALIZED (SELECT doc_id, run, word_idx, length(text) AS ch, (regexp_matches(rtrim(text), '[,;:]$') AND NOT line_after AND NOT terminal AND NOT pause_after) AS comma, row_number() OVER (PARTITION BY doc_id, run ORDER BY word_idx) AS k FROM n),
    r AS (SELECT doc_id, run, k, word_idx, comma AND ch >= 28 AS hit, CASE WHEN comma AND ch >= 28 THEN 0 ELSE 1 END AS cnt, CASE WHEN comma AND ch >= 28 THEN 0 ELSE ch END AS chars FROM p WHERE k = 1
      UNION ALL SELECT p.doc_id, p.run, p.k, p.word_idx, x.hit, CASE WHEN x.hit THEN 0 ELSE r.cnt + 1 END, CASE WHEN x.hit THEN 0 ELSE x.chars END FROM r JOIN p ON p.doc_id = r.doc_id AND p.run = r.run AND p.k = r.k + 1,
      LATERAL (SELECT r.chars + p.ch + CASE WHEN r.cnt > 0 THEN 1 ELSE 0 END AS chars, p.comma AND (r.cnt + 1 >= 5 OR r.chars + p.ch + CASE WHEN r.cnt > 0 THEN 1 ELSE 0 END >= 28) AS hit) x)
    SELECT doc_id, word_idx, hit AS soft_after FROM r""".replace(" WHERE doc_id % 3 = doc_id % 3", "")
)
def soft_boundaries(spark, d):
    return W.soft_boundaries(hinted(spark, d), ["doc_id"]).select("doc_id", "word_idx", "soft_after")


@query(
    f"""WITH {EV}, sp AS (SELECT user_id, idx // 2 AS word_idx, (idx * 10) AS a, (idx * 10 + 4) AS b FROM ev WHERE idx % 6 <> 0) SELECT user_id, word_idx, min(a) * 0.02::DOUBLE AS start, (max(b) + 1) * 0.02::DOUBLE AS "end" FROM sp GROUP BY user_id, word_idx"""
)
def span_seconds(spark, d):
    spans = ev(spark, d).where("idx % 6 <> 0").select("user_id", F.floor(F.col("idx") / 2).alias("word_idx"), (F.col("idx") * 10).alias("start_frame"), (F.col("idx") * 10 + 4).alias("end_frame"))
    return W.word_spans(spans, ["user_id"])


@query(
    """WITH e AS (SELECT user_id, event_id, ascii(event_type) AS token, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT user_id, event_id AS start_frame, k // 3 AS word_idx, token::BIGINT AS token FROM e"""
)
def span_attach(spark, d):
    e = read(spark, d, "events").select("user_id", F.col("event_id").alias("start_frame"), F.ascii("event_type").alias("token"))
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("start_frame"))
    targets = e.withColumn("k", k).select("user_id", F.floor(F.col("k") / 3).alias("word_idx"), (F.col("k") % 3).alias("pos"), "token")
    return W.attached(e, targets, ["user_id"]).select("user_id", "start_frame", "word_idx", "token")


@query(f"WITH {WORDS}, l AS (SELECT doc_id, word_idx, regexp_replace(strip_accents(lower(text)), '[^a-z]', '', 'g') AS w FROM words) SELECT doc_id, word_idx, array_to_string(list_transform(string_split(w, ''), lambda c: (ascii(c) - 96)::VARCHAR), ' ') AS targets FROM l WHERE w <> ''")
def alignment_targets(spark, d):
    targets = V.alignment_targets(V.timed_words(read(spark, d, "documents")), ["doc_id"])
    return targets.select("doc_id", "word_idx", F.array_join(F.transform("targets", lambda t: t.cast("string")), " ").alias("targets"))


@query(
    r"""WITH l AS (SELECT conv_id, turn, trim(regexp_replace(translate(text, '|', ' '), '\s+', ' ', 'g')) AS line FROM conversations WHERE role <> 'system'), p AS (SELECT *, string_split(line, ' ') AS parts FROM l WHERE line <> '')
    SELECT conv_id, turn AS line_index, i - 1 AS pos, parts[i] AS text, CASE WHEN turn % 3 = 0 THEN turn * 7 + (i - 1) * 0.25::DOUBLE WHEN turn % 3 = 1 THEN turn * 7 + (i - 1) * 0.5::DOUBLE ELSE (i - 1) * 0.5::DOUBLE END AS start,
      CASE WHEN turn % 3 = 0 THEN turn * 7 + (i - 1) * 0.25::DOUBLE + 0.2::DOUBLE WHEN turn % 3 = 1 THEN turn * 7 + (i - 1) * 0.5::DOUBLE + 0.4::DOUBLE ELSE (i - 1) * 0.5::DOUBLE + 0.4::DOUBLE END AS "end" FROM p, unnest(range(1, len(parts) + 1)) AS t(i)"""
)
def line_words(spark, d):
    """Turns as lines: every third with all its words aligned, the next with the first word only, the others with none."""
    c = read(spark, d, "conversations")
    parts = X.words(X.archive_value("text"))
    at = lambda k: F.col("turn") * 7 + k * 0.25
    words = F.transform(parts, lambda w, k: F.struct(w.alias("text"), at(k).alias("start"), (at(k) + 0.2).alias("end")))
    lines = c.select("conv_id", F.lit(0).alias("section_index"), F.col("turn").alias("line_index"), F.when(F.col("role") == "system", "comment").otherwise("lyric").alias("line_type"), "text", F.lit(0.0).alias("section_start"), F.when(F.col("turn") % 3 == 0, words).when((F.col("turn") % 3 == 1) & (F.size(parts) > 1), F.slice(words, 1, 1)).when(F.col("turn") % 3 == 1, F.array(F.struct(F.get(parts, F.lit(0)).alias("text"), at(F.lit(0)).alias("start"), (at(F.lit(0)) + 0.4).alias("end")))).alias("words"))
    return V.line_words(lines, ["conv_id"]).drop("section_index")


@query(
    f"""WITH {EV}, k AS (SELECT * FROM ev WHERE start >= 0 AND "end" >= start AND trim(source) <> '' AND regexp_matches(source, '[\\p{{L}}\\p{{N}}]'))
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start, "end", idx) - 1 AS word_idx, source AS text, start, "end", 'medium-vocals' AS source, greatest(max("end") OVER (PARTITION BY user_id), 1.0) AS duration FROM k"""
)
def candidate_words(spark, d):
    return V.candidate_words(ev(spark, d).select("user_id", F.col("idx").alias("word_idx"), F.col("source").alias("text"), "start", "end"), ["user_id"], "medium-vocals")


@query("SELECT event_id, event_type AS text, value AS start, coalesce(CASE WHEN event_id % 2 = 0 THEN 0.5 END, 1.0)::DOUBLE AS confidence, 'unknown' AS source FROM events")
def record_round_trip(spark, d):
    e = read(spark, d, "events")
    out = e.select("event_id", F.to_json(F.struct(F.col("event_type").alias("text"), F.col("value").alias("start"), F.when(F.col("event_id") % 2 == 0, 0.5).alias("confidence"))).alias("j"))
    back = out.select("event_id", F.from_json("j", "text string, start double, confidence double, source string").alias("r"))
    return back.select("event_id", "r.text", "r.start", F.coalesce("r.confidence", F.lit(1.0)).alias("confidence"), F.coalesce("r.source", F.lit("unknown")).alias("source"))


@query(
    """WITH w AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS word FROM benchmark), c AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS word FROM conversations)
    SELECT 'shared' AS part, count(*) AS n FROM (SELECT word FROM w INTERSECT SELECT word FROM c) UNION ALL SELECT 'benchmark only', count(*) FROM (SELECT word FROM w EXCEPT SELECT word FROM c) UNION ALL SELECT 'all', count(*) FROM (SELECT word FROM w UNION SELECT word FROM c)"""
)
def vocabulary_sets(spark, d):
    words = lambda t: read(spark, d, t).select(F.explode(F.split(F.lower("text"), " ")).alias("word")).distinct()
    b, c = words("benchmark"), words("conversations")
    part = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return part(b.intersect(c), "shared").unionByName(part(b.subtract(c), "benchmark only")).unionByName(part(b.union(c).distinct(), "all"))


@query(
    f"""WITH {SLIDES.split(' per AS')[0].rstrip().rstrip(',')}, n AS (SELECT *, lead(start_seconds) OVER (PARTITION BY conv_id ORDER BY slide_idx) AS nxt, regexp_extract_all(array_to_string(lines, ' ') || CASE WHEN aux_text <> '' AND NOT regexp_matches(aux_text, '(?i)^\\(\\d+x\\)$') THEN ' ' || aux_text ELSE '' END, '\\S+') AS toks FROM sl),
    z AS (SELECT *, greatest(coalesce(nxt, start_seconds + 4.0), start_seconds + 0.1) AS stop FROM n) SELECT conv_id, slide_idx, i - 1 AS pos, toks[i] AS text, start_seconds + (stop - start_seconds) / len(toks) * (i - 1) AS start, start_seconds + (stop - start_seconds) / len(toks) * i AS "end" FROM z, unnest(range(1, len(toks) + 1)) AS t(i)"""
)
def archive_words(spark, d):
    s = conversation_slides(spark, d)
    nxt = F.lead("start_seconds").over(Window.partitionBy("conv_id").orderBy("slide_idx"))
    aux = F.when((F.col("aux_text") != "") & ~X.repetition_marker("aux_text"), F.concat(F.lit(" "), "aux_text")).otherwise("")
    s = s.withColumn("stop", F.greatest(F.coalesce(nxt, F.col("start_seconds") + 4.0), F.col("start_seconds") + 0.1)).withColumn("toks", X.words(F.concat(F.array_join("lines", " "), aux)))
    step = (F.col("stop") - F.col("start_seconds")) / F.size("toks")
    w = s.select("conv_id", "slide_idx", "start_seconds", step.alias("step"), F.posexplode("toks").alias("pos", "text"))
    return w.select("conv_id", "slide_idx", "pos", "text", (F.col("start_seconds") + F.col("step") * F.col("pos")).alias("start"), (F.col("start_seconds") + F.col("step") * (F.col("pos") + 1)).alias("end"))


@query(f"WITH {WORDS} SELECT doc_id, count(*) FILTER ({sql_token('text')} = '' OR {sql_token('text')} IN ('ah','eh','hm','hmm','hum','oh','uh','um','music','musica','applause','aplausos') OR regexp_matches(text, '^\\s*[\\[\\(][^\\[\\]\\(\\)]*[\\]\\)]\\s*$')) AS skipped, count(*) FILTER (regexp_matches(text, '^\\s*\\[[^\\[\\]]*\\]\\s*$')) AS special, count(*) AS n FROM words GROUP BY doc_id")
def ignorable_words(spark, d):
    w = V.timed_words(read(spark, d, "documents"))
    return w.groupBy("doc_id").agg(F.count_if(X.ignorable("text")).alias("skipped"), F.count_if(X.special_token("text")).alias("special"), F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH RECURSIVE {WORDS}, al AS (SELECT doc_id, word_idx, text, start, "end", CASE WHEN word_idx % 4 = 1 THEN (word_idx * 24) * 0.02::DOUBLE END AS a, CASE WHEN word_idx % 4 = 1 THEN (word_idx * 24 + 13) * 0.02::DOUBLE END AS b FROM words),
    k AS MATERIALIZED (SELECT *, first_value(a IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY word_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi, coalesce(last_value(b IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS lo,
      count(a) OVER (PARTITION BY doc_id ORDER BY word_idx) AS run FROM al), n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, run, a IS NULL ORDER BY word_idx) AS pos FROM k),
    r AS (SELECT doc_id, run, pos, word_idx, text, least(greatest(start, lo), coalesce(hi, 'Infinity'::DOUBLE)) AS s, least(greatest("end", greatest(start, lo)), coalesce(hi, 'Infinity'::DOUBLE)) AS e FROM n WHERE a IS NULL AND pos = 1
      UNION ALL SELECT n.doc_id, n.run, n.pos, n.word_idx, n.text, least(greatest(n.start, r.e), coalesce(n.hi, 'Infinity'::DOUBLE)), least(greatest(n."end", greatest(n.start, r.e)), coalesce(n.hi, 'Infinity'::DOUBLE)) FROM r JOIN n ON n.doc_id = r.doc_id AND n.run = r.run AND n.a IS NULL AND n.pos = r.pos + 1)
    SELECT doc_id, word_idx, text, s AS start, e AS "end", 'whisper' AS word_source FROM r UNION ALL SELECT doc_id, word_idx, text, a, b, 'mms_align' FROM n WHERE a IS NOT NULL"""
)
def refined_words(spark, d):
    w = V.timed_words(read(spark, d, "documents"))
    at = F.col("word_idx") * 24
    spans = w.where("word_idx % 4 = 1").select("doc_id", "word_idx", at.alias("start_frame"), (at + 12).alias("end_frame"))
    return W.refined_words(w, spans, ["doc_id"])


@query(
    f"""WITH {WORDS}, l AS (SELECT doc_id, word_idx // 40 AS s, word_idx // 6 AS l, string_agg(text, ' ' ORDER BY word_idx) AS text, min(start) AS start, max("end") AS "end" FROM words GROUP BY ALL)
    SELECT doc_id, s AS section_index, l AS line_index, text, start, "end" FROM l"""
)
def nested_document(spark, d):
    w = V.timed_words(read(spark, d, "documents")).withColumn("line_index", F.floor(F.col("word_idx") / 6)).withColumn("section_index", F.floor(F.col("word_idx") / 40))
    out = V.document(w, "doc_id").select("doc_id", F.inline("sections")).select("doc_id", "section_index", F.explode("lines").alias("x"))
    return out.select("doc_id", "section_index", "x.line_index", "x.text", "x.start", "x.end")


@query(
    """WITH o AS (SELECT o_orderkey, (o_totalprice * 7)::BIGINT AS n, floor(o_totalprice / 10)::BIGINT AS s FROM orders)
    SELECT o_orderkey, CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.1f KiB', round_even(n / 1024.0::DOUBLE, 1)) ELSE printf('%.1f MiB', round_even(n / 1048576.0::DOUBLE, 1)) END AS bytes,
    CASE WHEN s >= 3600 THEN printf('%dh%02dm%02ds', s // 3600, (s // 60) % 60, s % 60) ELSE printf('%dm%02ds', (s // 60) % 60, s % 60) END AS effort FROM o"""
)
def display_formats(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.rint(F.col("o_totalprice") * 7).cast("long").alias("n"), F.floor(F.col("o_totalprice") / 10).alias("s"))
    return o.select("o_orderkey", C.bytes_text(F.col("n")).alias("bytes"), C.effort_text(F.col("s").cast("double")).alias("effort"))


@query(
    """WITH s AS (SELECT o_orderkey, (o_orderkey % 100) / 100.0::DOUBLE AS p, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 97) / 97.0::DOUBLE END AS b FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN true ELSE p >= 0.8 AND (b IS NULL OR p >= b - 0.02) END AS passes FROM s"""
)
def reference_gate(spark, d):
    k = F.col("o_orderkey")
    o = read(spark, d, "orders").select("o_orderkey", F.when(k % 11 != 0, k % 100 / 100.0).alias("phase_similarity"), F.when(k % 3 > 0, k % 97 / 97.0).alias("baseline_similarity"))
    return o.select("o_orderkey", G.reference_gate(o).alias("passes"))
