"""Queries over scalar functions, words, segments and sequences, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verseloom.functions import scores as S
from verseloom.functions import text as X
from verseloom.functions import timecode as C
from verseloom.operators import quality as Q
from verseloom.operators import sequence as W
from verseloom.operators import words as V


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def longs(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, as the SQL side has them."""
    return df.select(*(F.col(c).cast("long") if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: longs(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timed items of a user: start in seconds of the epoch's day, length by value."""
    e = read(spark, sf_dir, "events")
    start = F.expr("unix_micros(cast(ts as timestamp)) / 1000000.0D")
    return e.select("user_id", F.col("event_id").alias("idx"), F.col("event_type").alias("source"), start.alias("start"), (start + F.col("value")).alias("end"), "value", "props")


UNACC = "strip_accents(replace(lower({0}), 'ß', 'ss'))"


def sql_unaccented(x: str) -> str:
    return UNACC.format(x)


def sql_phrase(x: str) -> str:
    return f"trim(regexp_replace({sql_unaccented(x)}, '[^a-z0-9]+', ' ', 'g'))"


def sql_token(x: str) -> str:
    return f"regexp_replace({sql_unaccented(x)}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def sql_bare(x: str) -> str:
    return f"lower(trim(trim({x}), '{X.PUNCTUATION}'))"


#: Words with letters and their index, timed at 0.5 s.
WORDS = r"""words AS (SELECT doc_id, i - 1 AS word_idx, l[i] AS text, (i - 1) * 0.5::DOUBLE AS start, (i - 1) * 0.5::DOUBLE + 0.4::DOUBLE AS "end"
  FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '\S+'), lambda w: regexp_matches(w, '[\p{L}\p{N}]')) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(i))"""
EV = """ev AS (SELECT user_id, event_id AS idx, event_type AS source, epoch_us(ts) / 1000000.0::DOUBLE AS start, epoch_us(ts) / 1000000.0::DOUBLE + value AS "end", value, props FROM events)"""
LINES = r"""lines AS (SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(i))"""


@query(f"SELECT doc_id, {sql_phrase('text')} AS normalized, len(regexp_extract_all(text, '\\S+'))::BIGINT AS n_words, len(regexp_extract_all({sql_phrase('text')}, '\\S+'))::BIGINT AS n_normal FROM documents")
def normalize_text(spark, d):
    return read(spark, d, "documents").select("doc_id", X.phrase_form("text").alias("normalized"), X.word_count("text").alias("n_words"), X.normal_word_count("text").alias("n_normal"))


@query(f"WITH {WORDS} SELECT doc_id, word_idx, {sql_token('text')} AS token, regexp_replace(strip_accents(lower(text)), '[^a-z]', '', 'g') AS letters, {sql_bare('text')} AS bare FROM words")
def normalize_token(spark, d):
    return V.timed_words(read(spark, d, "documents")).select("doc_id", "word_idx", X.token_form("text").alias("token"), X.ascii_letters("text").alias("letters"), X.bare_word("text").alias("bare"))


@query(
    f"SELECT doc_id, trim(regexp_replace(translate(replace(lower(text), 'ß', 'ss'), 'áàâãäéèêëíìîïóòôõöúùûüçñ', 'aaaaaeeeeiiiiooooouuuucn'), '[^a-z0-9]+', ' ', 'g')) AS by_table FROM documents"
)
def normalize_by_table(spark, d):
    return read(spark, d, "documents").select("doc_id", X.table_form("text").alias("by_table"))


#: Letters of the documents, and what stands for them in the next query: precomposed letters beyond Latin-1, and decomposed ones.
BEYOND = {"a": "ǎ", "d": "ď", "e": "e\u0301", "i": "į", "o": "o\u0308\u0304", "r": "ř", "s": "ş", "t": "т", "u": "ů", "z": "ž"}


def _beyond(x: str) -> str:
    for a, b in BEYOND.items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


@query(f"SELECT doc_id, {sql_phrase('t')} AS normalized, {sql_token('t')} AS token, regexp_replace(strip_accents(lower(t)), '[^a-z]', '', 'g') AS letters FROM (SELECT doc_id, {_beyond('lower(text)')} AS t FROM documents)")
def normalize_beyond_latin(spark, d):
    """The three normal forms of texts whose letters are precomposed beyond Latin-1, decomposed, or of another script."""
    t = F.lower("text")
    for a, b in BEYOND.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return read(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", X.phrase_form("t").alias("normalized"), X.token_form("t").alias("token"), X.ascii_letters("t").alias("letters"))


@query(f"SELECT page_id, coalesce(nullif(left(replace({sql_phrase('url')}, ' ', '-'), 80), ''), 'untitled') AS slug FROM pages")
def slug(spark, d):
    return read(spark, d, "pages").select("page_id", X.slug("url").alias("slug"))


@query(
    r"""WITH n AS (SELECT page_id, regexp_replace(url, '[/\\]', '_', 'g') AS name FROM pages), s AS (SELECT *, regexp_extract(name, '[^.](\.[^.]+)$', 1) AS suffix FROM n)
    SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(strip_accents(left(name, length(name) - length(suffix))), '[^\x00-\x7F]', '', 'g'), '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), ''), 'audio') || coalesce(nullif(lower(suffix), ''), '.mp3') AS filename FROM s"""
)
def safe_filename(spark, d):
    return read(spark, d, "pages").select("page_id", X.safe_filename("url").alias("filename"))


@query(
    r"""SELECT conv_id, turn, trim(regexp_replace(translate(text, '|', ' '), '\s+', ' ', 'g')) AS archive_value,
    array_to_string(regexp_extract_all(text, '\S+')[1:6], ' ') || CASE WHEN len(regexp_extract_all(text, '\S+')) > 6 THEN ' ...' ELSE '' END AS excerpt,
    trim(regexp_replace(regexp_replace(regexp_replace(text, '<\d\d:\d\d:\d\d\.\d\d\d>', '', 'g'), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS caption, replace(text, '|', '\|') AS escaped,
    coalesce(nullif(trim(role), ''), 'untitled') AS title FROM conversations"""
)
def clean_values(spark, d):
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", X.archive_value("text").alias("archive_value"), X.excerpt("text").alias("excerpt"), X.caption_text("text").alias("caption"), X.escape_pipe("text").alias("escaped"), F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit("untitled")).alias("title"))


@query(
    r"""WITH e AS (SELECT event_id, value * 3600 AS s, epoch_us(ts) / 1000000 AS t FROM events)
    SELECT event_id, printf('%02d:%02d:%02d', floor(s / 3600)::BIGINT, (floor(s / 60)::BIGINT % 60), floor(s)::BIGINT % 60) AS clock,
    (floor(s)::BIGINT)::DOUBLE AS parsed, printf('%d:%02d', floor(floor(s) / 60)::BIGINT, floor(s)::BIGINT % 60) AS short,
    (event_id * 960)::DOUBLE / CASE WHEN event_id * 960 > 10000 THEN 192000.0 ELSE 1.0 END AS ticks FROM e"""
)
def timecodes(spark, d):
    e = read(spark, d, "events").withColumn("s", F.col("value") * 3600)
    clock = C.clock(F.col("s"))
    return e.select("event_id", clock.alias("clock"), C.parse_clock(clock).alias("parsed"), C.short_clock(F.col("s")).alias("short"), C.parse_clock((F.col("event_id") * 960).cast("string")).alias("ticks"))


@query(
    r"""WITH e AS (SELECT event_id, (value * 1000)::BIGINT AS ms FROM events WHERE value >= 0)
    SELECT event_id, ((ms // 60000) * 60.0::DOUBLE + ((ms % 60000) / 1000.0::DOUBLE))::DOUBLE AS two_parts, 0.0::DOUBLE AS other FROM e"""
)
def caption_times(spark, d):
    e = read(spark, d, "events").where("value >= 0").withColumn("ms", F.round(F.col("value") * 1000).cast("long"))
    text = F.format_string("%d:%02d,%03d", F.expr("ms div 60000"), F.expr("(ms % 60000) div 1000"), F.expr("ms % 1000"))
    return e.select("event_id", C.parse_caption_time(text).alias("two_parts"), C.parse_caption_time(F.lit("1")).alias("other"))


@query(f"WITH {WORDS} SELECT doc_id, word_idx, text, start, \"end\" FROM words")
def word_timing(spark, d):
    return V.timed_words(read(spark, d, "documents"))


@query(
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS l, n_chars / 10.0::DOUBLE AS dur FROM documents)
    SELECT doc_id, i - 1 AS word_idx, l[i] AS text, (dur / len(l)) * (i - 1) AS start, (dur / len(l)) * i AS "end" FROM t, unnest(range(1, len(l) + 1)) AS u(i)"""
)
def uniform_retiming(spark, d):
    return V.retimed_words(read(spark, d, "documents"), F.col("n_chars") / F.lit(10.0))


@query(
    f"""WITH {LINES}, s AS (SELECT doc_id, line_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM lines),
    f AS (SELECT *, (line <> '')::INT AS filled FROM s),
    o AS (SELECT *, (filled = 1 AND lag(filled) OVER w = 0 AND sum(filled) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0) AS opens FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    x AS (SELECT *, sum(coalesce(opens, false)::INT) OVER w AS section_index, sum(filled) OVER w - 1 AS line_index FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    t AS (SELECT doc_id, line_index, section_index, i, l[i] AS text FROM (SELECT *, regexp_extract_all(line, '\\S+') AS l FROM x WHERE filled = 1), unnest(range(1, len(l) + 1)) AS u(i))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_index, i) - 1 AS token_index, text, {sql_token('text')} AS normalized, line_index::BIGINT AS line_index, section_index::BIGINT AS section_index FROM t"""
)
def lyric_sections(spark, d):
    return V.lyric_tokens(read(spark, d, "documents"))


@query(
    f"""WITH {LINES}, k AS (SELECT doc_id, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM lines WHERE regexp_matches(line, '[\\p{{L}}\\p{{N}}]'))
    SELECT doc_id, count(*) AS line_count, sum(len(regexp_extract_all(line, '\\S+')))::BIGINT AS main_words, count(*) FILTER (length(line) > 28) AS over_target, count(*) FILTER (length(line) > 34) AS over_hard,
    median(length(line)) AS median_line_chars, sum(greatest(1, ceil(length(line) / 34.0)))::BIGINT AS hard_wrapped_lines FROM k GROUP BY doc_id"""
)
def line_quality(spark, d):
    lines = V.text_lines(read(spark, d, "documents")).where(X.has_letter("line")).withColumn("line", X.squeeze("line"))
    return Q.line_metrics(lines, ["doc_id"])


def conversation_slides(spark: SparkSession, d: str) -> DataFrame:
    """A slide a turn: its lines, 2 s a turn, the role as aux text unless it speaks."""
    c = read(spark, d, "conversations")
    lines = F.filter(F.transform(F.split("text", "\n"), X.squeeze), lambda x: x != "")
    return c.select("conv_id", F.col("turn").alias("slide_idx"), lines.alias("lines"), (F.col("turn") * (2 + F.col("conv_id") % 3)).cast("double").alias("start_seconds"), F.when(F.col("role") == "system", F.lit("(2x)")).when(F.col("conv_id") % 7 == 0, F.col("role")).otherwise("").alias("aux_text"))


SLIDES = r"""sl AS (SELECT conv_id, turn AS slide_idx, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS lines,
  (turn * (2 + conv_id % 3))::DOUBLE AS start_seconds, CASE WHEN role = 'system' THEN '(2x)' WHEN conv_id % 7 = 0 THEN role ELSE '' END AS aux_text FROM conversations),
 per AS (SELECT conv_id, list_transform(lines, lambda x: length(x)) AS ls, list_sum(list_transform(lines, lambda x: len(regexp_extract_all(x, '\S+')))) AS words,
  CASE WHEN aux_text <> '' AND NOT regexp_matches(aux_text, '(?i)^\(\d+x\)$') THEN len(regexp_extract_all(aux_text, '\S+')) ELSE 0 END AS aw, (aux_text <> '' AND NOT regexp_matches(aux_text, '(?i)^\(\d+x\)$'))::INT AS ax,
  (len(lines) = 0)::INT AS empty, start_seconds - lag(start_seconds) OVER (PARTITION BY conv_id ORDER BY slide_idx) AS step FROM sl),
 m AS (SELECT conv_id, count(*) AS slide_count, sum(empty)::BIGINT AS empty_slides, sum(coalesce(words, 0))::BIGINT AS main_words, sum(aw)::BIGINT AS aux_words, sum(ax)::BIGINT AS aux_slides, sum(len(ls))::BIGINT AS line_count,
  sum(len(list_filter(ls, lambda x: x > 28)))::BIGINT AS over_target, sum(len(list_filter(ls, lambda x: x > 34)))::BIGINT AS over_hard, count(step) AS transitions, count(*) FILTER (step < 3.0) AS fast_transitions,
  sum(coalesce(list_sum(list_transform(ls, lambda x: greatest(1, ceil(x / 34.0)))), 0))::BIGINT AS hard_wrapped_lines, coalesce(list_median(flatten(list(ls))), 0)::DOUBLE AS median_line_chars FROM per GROUP BY conv_id)""".replace("list_median(flatten(list(ls)))", "list_aggregate(flatten(list(ls)), 'median')")


@query(f"WITH {SLIDES} SELECT *, ceil(hard_wrapped_lines / 2.0)::BIGINT AS hard_wrapped_slides FROM m")
def slide_quality(spark, d):
    return Q.slide_metrics(conversation_slides(spark, d), ["conv_id"])


def sql_ratio(n: str, d: str) -> str:
    return f"(CASE WHEN {d} = 0 THEN CASE WHEN {n} = 0 THEN 0.0 ELSE 'Infinity'::DOUBLE END ELSE ({n})::DOUBLE / ({d})::DOUBLE END)"


def sql_percent(x: str) -> str:
    return f"printf('%.1f%%', round_even({x} * 100, 1))"


_RULES = [
    ("slide_count = 0", "'no lyric slides were generated'"),
    ("empty_slides > 0", "printf('empty lyric slide count %d exceeds 0', empty_slides)"),
    *((f"{r} > {lim}", f"'{name} ' || {sql_percent(r)} || ' exceeds {lim:.1%}'") for r, lim, name in ((sql_ratio("aux_words", "(aux_words + main_words)"), 0.10, "auxiliary lyric word ratio"), (sql_ratio("aux_slides", "slide_count"), 0.35, "auxiliary lyric slide ratio"), (sql_ratio("over_target", "line_count"), 0.30, "main line over target ratio"))),
    ("over_hard > 0", "printf('main lines over hard limit %d exceeds 0', over_hard)"),
    ("median_line_chars > 28", "'median main line length ' || printf('%.1f', median_line_chars) || ' exceeds 28.0'"),
    (f"{sql_ratio('fast_transitions', 'transitions')} > 0.05", f"'fast slide transition ratio ' || {sql_percent(sql_ratio('fast_transitions', 'transitions'))} || ' exceeds 5.0%'"),
]


@query(f"WITH {SLIDES} SELECT conv_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {t} END' for c, t in _RULES)}], lambda x: x IS NOT NULL), '; ') AS messages FROM m")
def gate_messages(spark, d):
    return Q.slide_metrics(conversation_slides(spark, d), ["conv_id"]).select("conv_id", F.array_join(Q.slide_messages(), "; ").alias("messages"))


@query(
    f"""WITH {EV}, g AS (SELECT user_id, start, "end", start - lag("end") OVER (PARTITION BY user_id ORDER BY start, "end", idx) AS gap FROM ev),
    t AS (SELECT user_id, count(*) AS word_count, count(*) FILTER ("end" <= start) AS zero_duration, count(*) FILTER (gap > 0.05) AS positive_gaps, greatest(count(*) - 1, 0) AS boundaries FROM g GROUP BY user_id)
    SELECT *, array_to_string(list_filter([CASE WHEN zero_duration::DOUBLE / word_count > 0.02 THEN 'zero-duration word ratio ' || {sql_percent('zero_duration::DOUBLE / word_count')} || ' exceeds 2.0%' END,
    CASE WHEN word_count > 1 AND positive_gaps::DOUBLE / (word_count - 1) < 0.05 THEN 'positive timestamp gap ratio ' || {sql_percent('positive_gaps::DOUBLE / (word_count - 1)')} || ' is below 5.0%' END], lambda x: x IS NOT NULL), '; ') AS messages FROM t"""
)
def transcript_quality(spark, d):
    t = Q.transcript_metrics(ev(spark, d).withColumnRenamed("idx", "word_idx"), ["user_id"])
    return t.withColumn("messages", F.array_join("messages", "; "))


@query(
    f"""WITH {EV}, g AS (SELECT *, coalesce(start - lag("end") OVER w >= 3600, false)::INT AS cut FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY start, "end", idx)),
    i AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY start, "end", idx) AS island FROM g)
    SELECT user_id, island::BIGINT AS island, min(start) AS start, max("end") AS "end", count(*) AS n FROM i GROUP BY user_id, island"""
)
def pause_islands(spark, d):
    e = ev(spark, d).withColumn("text", F.col("source"))
    cut = V.islands(e, ["user_id"], F.col("start") - F.col("prev_end") >= 3600, ["start", "end", "idx"])
    return cut.groupBy("user_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))


def _capped(hard: str, cut: str, chars: str) -> str:
    """A recursion over the place in an island: all documents take one step at a time."""
    return f"""WITH RECURSIVE {WORDS},
    h AS (SELECT *, coalesce(start - lag("end") OVER w >= 0.6 OR regexp_matches(rtrim(lag(text) OVER w), '{hard}$'), false)::INT AS cut FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY word_idx)),
    i AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY word_idx)::BIGINT AS island FROM h),
    p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY word_idx) AS k, regexp_matches(rtrim(text), '[,;:]$') AS soft,
      (text[1] = upper(text[1]) AND text[1] <> lower(text[1]) AND lower(trim(text)) NOT IN ('a','ao','as','da','de','do','e','em','na','no','o','os','por','pra','para','que','um','uma')) AS up FROM i),
    r AS (SELECT doc_id, island, k, word_idx, text, start, "end", 0 AS part, 1 AS n, start AS first, soft, length(text) AS chars FROM p WHERE k = 1
      UNION ALL SELECT p.doc_id, p.island, p.k, p.word_idx, p.text, p.start, p."end", r.part + x.cut::INT, CASE WHEN x.cut THEN 1 ELSE r.n + 1 END, CASE WHEN x.cut THEN p.start ELSE r.first END, p.soft, CASE WHEN x.cut THEN length(p.text) ELSE {chars} END
      FROM r JOIN p ON p.doc_id = r.doc_id AND p.island = r.island AND p.k = r.k + 1, LATERAL (SELECT {cut} AS cut) x)
    SELECT doc_id, island, part::BIGINT AS part, min(start) AS start, max("end") AS "end", string_agg(text, ' ' ORDER BY word_idx) AS text, count(*) AS n_words FROM r GROUP BY doc_id, island, part"""


@query(_capped("[.,;:!?]", 'r."end" - r.first >= 12.0 OR r.n >= 10', "0"))
def capped_phrases(spark, d):
    return V.gathered(V.phrases(V.timed_words(read(spark, d, "documents")), ["doc_id"]), ["doc_id"]).drop("normalized")


@query(_capped("[.!?]", '(r.soft AND r.n >= 5) OR (p.up AND (r.n >= 3 OR r.chars >= 12 OR r."end" - r.first >= 2.0)) OR r."end" - r.first >= 12.0 OR r.n >= 8', "r.chars + 1 + length(p.text)"))
def grouped_lines(spark, d):
    return V.gathered(V.lines(V.timed_words(read(spark, d, "documents")), ["doc_id"]), ["doc_id"]).drop("normalized")


@query(
    f"""WITH {LINES}, k AS (SELECT doc_id, line_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM lines), f AS (SELECT *, {sql_bare('line')} AS form FROM k),
    c AS (SELECT *, coalesce(form <> lag(form) OVER w, true)::INT AS fresh FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM c)
    SELECT doc_id, min(line_no) AS slide_idx, arg_min(line, line_no) AS line, (min(line_no) * 2)::DOUBLE AS start_seconds, (max(line_no) * 2 + 2)::DOUBLE AS end_seconds, count(*) AS n, CASE WHEN count(*) > 1 THEN printf('(%dx)', count(*)) ELSE '' END AS aux_text FROM n GROUP BY doc_id, run"""
)
def repeated_line_collapse(spark, d):
    lines = V.text_lines(read(spark, d, "documents"))
    slides = lines.select("doc_id", F.col("line_no").alias("slide_idx"), F.array(X.squeeze("line")).alias("lines"), (F.col("line_no") * 2).cast("double").alias("start_seconds"), (F.col("line_no") * 2 + 2).cast("double").alias("end_seconds"), F.lit("").alias("aux_text"))
    return W.collapsed_slides(slides, ["doc_id"]).withColumn("line", F.col("lines")[0]).drop("lines")


@query(
    """WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, CASE event_type WHEN (SELECT min(event_type) FROM events) THEN 0 ELSE ascii(event_type) END AS token FROM events),
    c AS (SELECT *, coalesce(token <> lag(token) OVER w, true)::INT AS ch FROM f WINDOW w AS (PARTITION BY user_id ORDER BY frame)), n AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY frame) AS run FROM c)
    SELECT user_id, run::BIGINT AS run, any_value(token)::BIGINT AS token, min(frame) AS first, max(frame) AS last, count(*) AS n FROM n GROUP BY user_id, run HAVING any_value(token) <> 0"""
)
def run_length_collapse(spark, d):
    e = read(spark, d, "events")
    e.createOrReplaceTempView("frame_events")
    e = e.withColumn("blank", F.expr("(SELECT min(event_type) FROM frame_events)"))
    frames = e.select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("frame"), F.when(F.col("event_type") == F.col("blank"), 0).otherwise(F.ascii("event_type")).alias("token"))
    return W.collapsed_path(frames, ["user_id"])


@query(
    f"""WITH {WORDS}, t AS (SELECT doc_id, word_idx, {sql_token('text')} AS form FROM words), c AS (SELECT *, coalesce(form <> lag(form) OVER w, true)::INT AS ch FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY word_idx)),
    n AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id ORDER BY word_idx) AS run FROM c), r AS (SELECT doc_id, run, count(*) AS n FROM n GROUP BY doc_id, run),
    a AS (SELECT doc_id, sum(n)::BIGINT AS n_tokens, sum(n - 1)::BIGINT AS repeats, max(n) AS longest FROM r GROUP BY doc_id),
    v AS (SELECT doc_id, count(*) AS n, count(DISTINCT form) AS dn, count(nxt) AS p, count(DISTINCT form || chr(1) || nxt) AS dp FROM (SELECT *, lead(form) OVER (PARTITION BY doc_id ORDER BY word_idx) AS nxt FROM t) GROUP BY doc_id)
    SELECT a.*, CASE WHEN n_tokens <= 2 THEN 0.0 ELSE repeats * 8.0 + greatest(longest - 2, 0) * 20.0 END::DOUBLE AS penalty, (CASE WHEN n <= 2 THEN 0.0 ELSE (1 - dn::DOUBLE / n) * 18.0 + (p - dp) * 8.0 END)::DOUBLE AS variety FROM a JOIN v USING (doc_id)"""
)
def repetition_penalty(spark, d):
    tokens = V.timed_words(read(spark, d, "documents")).select("doc_id", "word_idx", X.token_form("text").alias("form"))
    return W.repetition(tokens, ["doc_id"], ["word_idx"])
