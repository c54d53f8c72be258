import difflib
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from verseloom import plans
from verseloom.config import GateLimits, Layout
from verseloom.functions import text as X
from verseloom.operators import alignment as A
from verseloom.operators import consensus as C
from verseloom.operators import distance as D
from verseloom.operators import gate as G
from verseloom.operators import joins as J
from verseloom.operators import layout as L
from verseloom.operators import quality as Q
from verseloom.operators import ranking as R
from verseloom.operators import sequence as W
from verseloom.operators import words as V
from verseloom.sources import captions, ini


def timed(text, step=0.5, gaps=None, start=0.0):
    out, at = [], start
    for i, t in enumerate(text.split()):
        out.append({"text": t, "start": at, "end": at + step})
        at += step + (gaps or {}).get(i, 0.0)
    return out


def columns(words):
    return ([w[c] for w in words] for c in ("text", "start", "end"))


def test_segments_at_the_pause(spark):
    rows = [(1, 0, "alfa", 1.0, 1.2), (1, 1, "beta", 1.3, 1.5), (1, 2, "gama", 2.3, 2.5), (1, 3, "delta", 2.6, 2.8)]
    w = spark.createDataFrame(rows, "song int, word_idx int, text string, start double, end double")
    got = V.gathered(V.phrases(w, ["song"]), ["song"]).orderBy("start").collect()
    assert [r.text for r in got] == ["alfa beta", "gama delta"]


def test_lines_begin_at_capitals(spark):
    words = timed("Andei tão cego, sem rumo certo Buscando a paz", start=1.0)
    w = spark.createDataFrame([(1, i, x["text"], x["start"], x["end"]) for i, x in enumerate(words)], "song int, word_idx int, text string, start double, end double")
    got = V.gathered(V.lines(w, ["song"]), ["song"]).orderBy("start").collect()
    assert [r.text for r in got] == ["Andei tão cego, sem rumo certo", "Buscando a paz"]


def brute_phrases(words):
    groups = []
    for x in words:
        if groups:
            g = groups[-1]
            if not (x["start"] - g[-1]["end"] >= 0.6 or g[-1]["text"].rstrip()[-1:] in ".,;:!?" or g[-1]["end"] - g[0]["start"] >= 12.0 or len(g) >= 10):
                g.append(x)
                continue
        groups.append([x])
    return [" ".join(x["text"] for x in g) for g in groups]


def test_phrases_against_brute_force(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for song in range(8):
        at, words = 0.0, []
        for i in range(120):
            d = rng.choice([0.2, 0.5, 1.5])
            words.append({"text": f"w{i}" + rng.choice(["", "", "", "", ",", "."]), "start": at, "end": at + d})
            at += d + rng.choice([0.0, 0.0, 0.1, 0.7])
        want[song] = brute_phrases(words)
        rows += [(song, i, x["text"], x["start"], x["end"]) for i, x in enumerate(words)]
    w = spark.createDataFrame(rows, "song int, word_idx int, text string, start double, end double")
    got = V.gathered(V.phrases(w, ["song"]), ["song"]).orderBy("song", "start").collect()
    for song in want:
        assert [r.text for r in got if r.song == song] == want[song]


def test_dedupe_keeps_against_the_last_kept(spark):
    w = spark.createDataFrame([(1, i, "ah", s, s + 0.1) for i, s in enumerate((0.0, 0.2, 0.4))] + [(1, 3, "b", 0.45, 0.5), (1, 4, "ah", 0.5, 0.6)], "song int, word_idx int, text string, start double, end double")
    assert sorted(r.start for r in V.deduplicated_words(w, ["song"]).collect()) == [0.0, 0.4, 0.45, 0.5]


def test_lyric_sections(spark):
    df = spark.createDataFrame([(1, "És tudo!\nNão há outro\n\n\nCalebe")], "song int, text string")
    got = V.lyric_tokens(df, "song").orderBy("token_index").collect()
    assert [r.normalized for r in got] == "es tudo nao ha outro calebe".split()
    assert (got[-1].line_index, got[-1].section_index) == (2, 1)


def test_path_blank_parts_equal_tokens(spark):
    f = spark.createDataFrame([(1, i, t) for i, t in enumerate([0, 1, 1, 0, 2, 2, 2, 0, 2])], "song int, frame int, token int")
    assert sorted((r.token, r.first, r.last) for r in W.collapsed_path(f, ["song"]).collect()) == [(1, 1, 2), (2, 4, 6), (2, 8, 8)]


def test_collapse_repeated_slides(spark):
    s = spark.createDataFrame([(1, 0, ["A!"], 1.0, 2.0, ""), (1, 1, ["a"], 3.0, 4.0, ""), (1, 2, ["a"], 5.0, 6.0, "x"), (1, 3, ["b"], 7.0, 8.0, ""), (1, 4, ["a"], 9.0, 9.5, "")], "song int, slide_idx int, lines array<string>, start_seconds double, end_seconds double, aux_text string")
    got = W.collapsed_slides(s, ["song"]).orderBy("slide_idx").collect()
    assert [(r.start_seconds, r.end_seconds, r.aux_text) for r in got] == [(1.0, 4.0, "(2x)"), (5.0, 6.0, "x"), (7.0, 8.0, ""), (9.0, 9.5, "")]


def test_span_times(spark):
    spans = spark.createDataFrame([(1, 0, 50, 70), (1, 1, 80, 110)], "song int, word_idx int, start_frame int, end_frame int")
    got = W.word_spans(spans, ["song"]).orderBy("word_idx").collect()
    assert [(round(r.start, 2), round(r.end, 2)) for r in got] == [(1.0, 1.42), (1.6, 2.22)]


def test_refined_words_clamp(spark):
    words = spark.createDataFrame([(1, 0, "vinte", 0.0, 1.0), (1, 1, "24", 0.5, 9.0), (1, 2, "horas", 2.0, 3.0)], "song int, word_idx int, text string, start double, end double")
    spans = spark.createDataFrame([(1, 0, 50, 70), (1, 2, 100, 120)], "song int, word_idx int, start_frame int, end_frame int")
    got = W.refined_words(words, spans, ["song"]).orderBy("word_idx").collect()
    assert got[1].word_source == "whisper" and 1.42 <= got[1].start <= got[1].end <= 2.0
    assert [r.start for r in got] == sorted(r.start for r in got)


def test_words_without_letters_have_no_targets(spark):
    words = spark.createDataFrame([(1, 0, "Ção!"), (1, 1, "24"), (1, 2, "ab")], "song int, word_idx int, text string")
    assert [(r.word_idx, r.targets) for r in V.alignment_targets(words, ["song"]).orderBy("word_idx").collect()] == [(0, [3, 1, 15]), (2, [1, 2])]
    with pytest.raises(Exception, match="no word can be aligned"):
        V.alignment_targets(words.where("word_idx = 1"), ["song"]).collect()


def test_candidates_keep_valid_words(spark):
    rows = [(1, 0, "b", 2.0, 2.5), (1, 1, "a", 1.0, 1.5), (1, 2, " ", 0.0, 1.0), (1, 3, "...", 0.0, 1.0), (1, 4, "x", 3.0, 2.0), (1, 5, "y", -1.0, 2.0), (2, 0, "z", 0.0, 0.5)]
    words = spark.createDataFrame(rows, "song int, word_idx int, text string, start double, end double")
    got = V.candidate_words(words, ["song"], "s").orderBy("song", "word_idx").collect()
    assert [(r.song, r.word_idx, r.text, r.source, r.duration) for r in got] == [(1, 0, "a", "s", 2.5), (1, 1, "b", "s", 2.5), (2, 0, "z", "s", 1.0)]
    good, bad = V.validated(words.withColumn("parent_word_idx", F.lit(-1)))
    assert good.count() == 0 and bad.count() == len(rows)


def test_documents_nest_and_flatten(spark):
    rows = [(1, 0, 0, 0, "alfa", 1.0, 1.4), (1, 0, 0, 1, "beta", 1.5, 1.9), (1, 1, 1, 2, "gama", 3.0, 3.4)]
    words = spark.createDataFrame(rows, "song int, section_index int, line_index int, word_idx int, text string, start double, end double")
    got = V.line_words(V.flattened(V.document(words, "song"), "song"), ["song"]).orderBy("line_index", "pos").collect()
    assert [(r.section_index, r.line_index, r.text, r.start, r.end) for r in got] == [(a, b, t, x, y) for _, a, b, _, t, x, y in rows]


def test_spans_over_bucket_borders(spark, monkeypatch):
    monkeypatch.setattr(W, "BUCKET", 10)
    index = [1, 2, 9, 10, 11, 19, 20, 21, *range(28, 43), 50, 59, 61]
    df = spark.createDataFrame([("k", i) for i in index], "key string, i long")
    got = sorted((r.first, r.last, r.n) for r in W.consecutive_spans(df, ["key"], "i").collect())
    assert got == [(1, 2, 2), (9, 11, 3), (19, 21, 3), (28, 42, 15), (50, 50, 1), (59, 59, 1), (61, 61, 1)]


def test_interpolation_between_neighbours(spark):
    rows = spark.createDataFrame([(1, 0, 1.0, 1.2), (1, 1, None, None), (1, 2, 2.0, 2.4), (1, 3, None, None)], "song int, idx int, start double, end double")
    got = W.interpolated(rows, ["song"], ["idx"]).orderBy("idx").collect()
    assert 1.2 <= got[1].start < got[1].end <= 2.0
    assert got[3].start >= 2.4 and got[3].end > got[3].start


def test_attach_raises_on_mismatch(spark):
    spans = spark.createDataFrame([(1, 0, 10), (1, 5, 20)], "song int, start_frame int, token int")
    good = spark.createDataFrame([(1, 0, 0, 10), (1, 2, 0, 20)], "song int, word_idx int, pos int, token int")
    assert [r.word_idx for r in W.attached(spans, good, ["song"]).orderBy("start_frame").collect()] == [0, 2]
    with pytest.raises(Exception, match="spans don't match"):
        W.attached(spans, good.withColumn("token", F.col("token") + 1), ["song"]).collect()


LAYOUTS = [
    (timed("Fala comigo"), Layout(), [(["Fala comigo"], "")]),
    (timed("Toma Teu lugar de honra Queremos Tua Presenca aqui", gaps={4: 0.2}), Layout(), [(["Toma Teu lugar de honra", "Queremos Tua Presenca aqui"], "")]),
    (timed("E tudo vai ficar bem tudo acaba bem No final no final", gaps={4: 4.0}), Layout(), [(["E tudo vai ficar bem"], ""), (["tudo acaba bem", "No final no final"], "")]),
]


@pytest.mark.parametrize("words, cfg, want", LAYOUTS)
def test_layout(words, cfg, want):
    assert [(lines, aux) for lines, _, _, aux in L.plan(*columns(words), cfg=cfg)] == want


def test_layout_one_line_only():
    words = timed("Toma Teu lugar de honra Queremos Tua Presenca aqui e agora mesmo")
    assert all(len(lines) == 1 for lines, *_ in L.plan(*columns(words), cfg=Layout(max_lines=1)))


def test_layout_keeps_words_in_order_and_lines_short():
    rng = random.Random(5)
    for _ in range(40):
        n = rng.randint(1, 120)
        text = " ".join("x" * rng.randint(1, 12) + rng.choice(["", "", "", ",", "."]) for _ in range(n))
        words = timed(text, gaps={i: rng.choice([0, 0, 0, 0.7, 3.5]) for i in range(n)})
        slides = L.plan(*columns(words))
        said = [w for lines, _, _, aux in slides for part in (*lines, *([aux] if aux else [])) for w in part.split()]
        assert said == text.split()
        assert all(len(x) <= 34 for lines, *_ in slides for x in lines)


def test_overlong_cut_is_the_cheapest():
    rng = random.Random(7)
    for _ in range(300):
        n = rng.randint(2, 40)
        text = [rng.choice(["de", "o", "x" * rng.randint(1, 12), "y" * rng.randint(20, 70)]) for _ in range(n)]
        song = L.Song(text, [float(k) for k in range(n)], [k + 0.9 for k in range(n)], [None] * n, [None] * n, Layout())
        i, j = sorted(rng.sample(range(n), 2))
        costs = []
        for k in range(i, j):
            a, b = len(" ".join(text[i : k + 1])), len(" ".join(text[k + 1 : j + 1]))
            costs.append((1000.0 + max(a, b) * 2.0 + abs(a - b) * 0.2 + (10.0 if text[k] in ("de", "o") else 0.0), k))
        got = song._overlong(i, j)
        assert (got.score, got.first) == min(costs)


def test_layout_of_a_long_song_without_breaks():
    words = timed(" ".join("palavra" for _ in range(6_000)))
    slides = L.plan(*columns(words))
    assert sum(len(x.split()) for lines, *_ in slides for x in lines) == 6_000


def test_layout_repeats(spark):
    words = timed("Fala comigo Fala comigo Fala comigo", gaps={1: 4.0, 3: 4.0})
    df = spark.createDataFrame([(1, i, w["text"], w["start"], w["end"], None, None) for i, w in enumerate(words)], "song int, word_idx int, text string, start double, end double, line_index int, section_index int")
    got = L.planned_slides(df, "song").collect()
    assert [(r.lines, r.aux_text) for r in got] == [(["Fala comigo"], "(3x)")]


def groups_of(phrases):
    """Groups of (source, start, end, form), as sets of places."""
    order = sorted(range(len(phrases)), key=lambda k: (phrases[k][1], phrases[k][2], phrases[k][0]))
    cols = list(zip(*(phrases[k] for k in order)))
    parts = C.Groups(list(cols[1]), list(cols[2]), list(cols[3]), list(cols[0])).assign(0.5)
    return sorted(sorted(order[k] for k in range(len(order)) if parts[k] == g) for g in set(parts))


def test_groups_hold_one_phrase_a_source():
    assert groups_of([("a", 8.0, 9.0, "gama"), ("b", 1.1, 2.1, "alfa beta"), ("a", 1.0, 2.0, "alfa beta")]) == [[0], [1, 2]]


def test_outlier_never_wins(spark):
    says = {"a": "alfa beta gama delta", "b": "alfa beta gama delta", "c": "zeta"}
    song = sung(spark, *((name, [(t, 1.0 + 0.4 * k, 1.3 + 0.4 * k) for k, t in enumerate(text.split())]) for name, text in says.items()))
    got = C.consensus(song, "song").collect()
    assert [r.text for r in got] == [says["a"]] and got[0].support == 2 and got[0].n_sources == 3


def brute_value(p, group):
    """How well a phrase belongs to a group, rule by rule."""
    _, a, b, form = p
    like = max(C.text_likeness(form, q[3]) for q in group)
    over = max(max(0.0, min(b, q[2]) - max(a, q[1])) / max(min(b - a, q[2] - q[1]), 0.001) for q in group)
    apart = min(abs((a + b) - (q[1] + q[2])) / 2 for q in group)
    if over >= 0.35:
        return 0.55 + 0.25 * like
    if apart <= 2 and like >= 0.2:
        return 0.5 + 0.25 * like
    if apart <= 8 and like >= 0.72:
        return 0.5 + 0.3 * like
    return 0.45 * max(over, like)


def test_pruned_groups_equal_unpruned_ones():
    rng = random.Random(1)
    for _ in range(20):
        ps = [(rng.choice("abc"), s := rng.uniform(0, 60), s + rng.uniform(0.2, 12), rng.choice(["alfa beta", "alfa beta gama", "zeta"])) for _ in range(40)]
        groups = []
        for k in sorted(range(len(ps)), key=lambda k: (ps[k][1], ps[k][2], ps[k][0])):
            best, where = 0.0, None
            for g in groups:
                if all(ps[q][0] != ps[k][0] for q in g) and (v := brute_value(ps[k], [ps[q] for q in g])) > best:
                    best, where = v, g
            if where is not None and best >= 0.5:
                where.append(k)
            else:
                groups.append([k])
        assert groups_of(ps) == sorted(map(sorted, groups))


def test_decisions_against_brute_force(spark):
    """Score, support and doubt of every phrase of random songs, worked out one by one."""
    import math
    from statistics import mean, median

    rng, cfg, vocabulary = random.Random(4), Layout(allow_aux=False), "alfa beta gama delta ira zeta luz paz um dois".split()
    rows = []
    for song in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 30))]
        for source in ("turbo-vocals", "medium-vocals", "medium-denoise")[: rng.randint(1, 3)]:
            t = rng.uniform(0, 0.5)
            for k, w in enumerate(base):
                t += rng.choice([0.4, 0.5, 1.5])
                if rng.random() < 0.85:
                    rows.append((song, source, k, w if rng.random() < 0.8 else rng.choice(vocabulary), t, t + 0.35))
    words = spark.createDataFrame(rows, "song int, source string, word_idx int, text string, start double, end double")
    phrases = C.arranged(words, "song", cfg)
    got = {(r.song, r.start, r.end): r for r in C.decided(phrases, "song", cfg).collect()}
    groups = {}
    for r in phrases.collect():
        groups.setdefault((r.song, r.part), []).append(r)
    assert len(got) == len(groups)
    for (song, _), own in groups.items():
        rated = []
        for p in own:
            likes = [C.text_likeness(p.form, q.form) for q in own if q is not p]
            agreement, n = mean(likes) if likes else 0.55, len(p.words) / median(len(q.words) for q in own)
            lengths = [x for s in p.slides for x in s.lengths] or [len(p.text)]
            tokens = p.form.split()
            pairs = list(zip(tokens, tokens[1:]))
            cost = abs(n - 1) * 6 if 0.75 <= n <= 1.35 else 18 + 10 * min(abs(math.log(n)), 2.5)
            cost += 1.5 * min(abs((p.start + p.end) / 2 - median((q.start + q.end) / 2 for q in own)), 10) + min(abs(p.end - p.start - median(q.end - q.start for q in own)), 8)
            cost += 30 * sum(x > 34 for x in lengths) + 4 * sum(x > 28 for x in lengths)
            cost += (1 - len(set(tokens)) / len(tokens)) * 18 + (len(pairs) - len(set(pairs))) * 8 if len(tokens) > 2 else 0
            support = 1 + sum(x >= 0.62 for x in likes)
            rated.append((-min(100.0, max(0.0, 20 + 52 * agreement + 7 * min(support, 3) - cost)), p.source, agreement, support, n))
        score, source, agreement, support, n = min(rated)
        r = got[song, min(p.start for p in own), max(p.end for p in own)]
        assert (r.source, r.support, r.n_sources) == (source, support, len(own)) and r.score == pytest.approx(-score, abs=1e-9)
        weak = -score < 55 or (len(own) > 1 and agreement < 0.42) or (support == 1 and len(own) >= 3) or not 0.6 <= n <= 1.7
        assert bool(r.doubt) == weak


def brute_align(tokens, heard):
    """All order-preserving matchings of tiny inputs: the best score."""
    best = None
    for picks in product([None, *range(len(heard))], repeat=len(tokens)):
        used = [p for p in picks if p is not None]
        if used != sorted(set(used)):
            continue
        score = -1.0 * picks.count(None) - 0.7 * (len(heard) - len(used))
        for t, p in zip(tokens, picks):
            if p is not None:
                like = 1.0 if t == heard[p] else 0.0 if min(len(t), len(heard[p])) <= 2 else difflib.SequenceMatcher(None, t, heard[p]).ratio()
                if like < 0.82:
                    break
                score += 2.0 + like + (like == 1.0)
        else:
            best = score if best is None else max(best, score)
    return best


def test_alignment_is_optimal():
    rng = random.Random(2)
    vocabulary = ["caleb", "calebe", "fala", "senhor", "eu", "sou"]
    for _ in range(60):
        t, h = ([rng.choice(vocabulary) for _ in range(rng.randint(0, 4))] for _ in range(2))
        got = A.align(t, h)
        used = [p for p in got if p is not None]
        assert used == sorted(set(used))
        score = -1.0 * got.count(None) - 0.7 * (len(h) - len(used)) + sum(2.0 + (s := 1.0 if x == h[p] else difflib.SequenceMatcher(None, x, h[p]).ratio()) + (s == 1.0) for x, p in zip(t, got) if p is not None)
        assert score == pytest.approx(brute_align(t, h))


def test_align_fuzzy_word():
    assert A.align(["eu", "sou", "calebe"], ["eu", "sou", "caleb"]) == [0, 1, 2]


def test_word_distances_agree(spark):
    rng = random.Random(4)
    pairs = [([rng.choice("abcde") for _ in range(rng.randint(0, 8))], [rng.choice("abcde") for _ in range(rng.randint(0, 8))]) for _ in range(30)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for r in df.select("a", "b", D.word_distance(F.col("a"), F.col("b")).alias("x"), D.exact_word_distance(F.col("a"), F.col("b")).alias("y")).collect():
        row = list(range(len(r.b) + 1))
        for i, p in enumerate(r.a, 1):
            row = [i, *row[1:]] if not r.b else (lambda prev: [cur := [i], [cur.append(min(cur[-1] + 1, prev[j] + 1, prev[j - 1] + (p != q))) for j, q in enumerate(r.b, 1)]][0])(row)
        want = len(r.a) if not r.b else row[-1]
        assert r.x == want and r.y == want


def test_slide_messages(spark):
    slides = [(1, 0, ["ok"], 0.0, ""), (1, 1, [], 2.0, ""), (1, 2, ["x" * 35], 4.0, ""), (1, 3, ["ok"], 9.0, "(3x)")]
    s = spark.createDataFrame(slides, "song int, slide_idx int, lines array<string>, start_seconds double, aux_text string")
    m = Q.slide_metrics(s, ["song"])
    r = m.first()
    assert (r.empty_slides, r.over_hard, r.fast_transitions, r.aux_words) == (1, 1, 2, 0)
    text = "; ".join(m.select(Q.slide_messages()).first()[0])
    assert "empty lyric slide" in text and "hard limit" in text and "fast slide transition" in text


def test_enforced(spark):
    bad = spark.createDataFrame([(["x"],)], "messages array<string>")
    with pytest.raises(Exception, match="quality: x"):
        Q.enforced(bad, "fail").collect()
    assert Q.enforced(bad, "warn").count() == 1 and Q.enforced(bad, "off").first().messages == []


def metrics(spark, **kw):
    base = {"slide_count": 10, "line_count": 20, "over_hard": 0, "over_target": 0, "aux_words": 0, "fast_transitions": 0, "text_words": 120, "hard_wrapped_line_count": 0, "hard_wrapped_slide_count": 0} | kw
    return spark.createDataFrame([("v", *base.values())], ["video", *base])


@pytest.mark.parametrize(
    "base, phase, passed, failed",
    [
        ({"over_hard": 4}, {"slide_count": 31, "line_count": 62}, False, {"slide", "line"}),
        ({"slide_count": 7, "line_count": 12, "text_words": 360, "hard_wrapped_line_count": 38, "hard_wrapped_slide_count": 19}, {"slide_count": 19, "line_count": 38, "text_words": 227}, True, set()),
        ({"slide_count": 6, "line_count": 9, "text_words": 44}, {"slide_count": 16, "line_count": 32, "text_words": 129}, True, set()),
        ({"slide_count": 12}, {"slide_count": 12, "fast_transitions": 5}, False, {"fast"}),
        ({"slide_count": 120, "line_count": 240}, {"slide_count": 121, "line_count": 240, "fast_transitions": 1}, True, set()),
        ({}, {"aux_words": 18}, False, {"aux"}),
        ({}, {"over_target": 7}, False, {"target"}),
        ({"over_hard": 4}, {"slide_count": 12, "line_count": 22}, True, set()),
    ],
)
def test_batch_gate(spark, base, phase, passed, failed):
    r = G.batch_gate(G.compared(metrics(spark, **base), metrics(spark, **phase), "video"), 1, GateLimits()).first()
    assert r.passed is passed
    assert {g for g in ("hard", "slide", "line", "fast", "aux", "target") if not r[f"{g}_gate"]} == failed


def test_limited_run_fails_the_full_set(spark):
    r = G.batch_gate(G.compared(metrics(spark), metrics(spark), "video"), 2).first()
    assert not r.full_set and not r.passed and r.failures[0] == "full set: 1 of 2"


@pytest.mark.parametrize("phase, baseline, passed", [(0.79, None, False), (0.90, 0.93, False), (0.90, 0.91, True), (0.80, None, True), (None, 0.99, True)])
def test_batch_gate_holds_the_reference(spark, phase, baseline, passed):
    b, p = (metrics(spark).withColumn("reference_similarity", F.lit(x).cast("double")) for x in (baseline, phase))
    rows = G.compared(b, p, "video")
    r = G.batch_gate(rows, 1).first()
    assert (r.passed, r.reference_gate, r.failures) == (passed, passed, [] if passed else ["reference gate failed"])
    assert r.reference_count == (phase is not None) and r.least_similarity == phase
    assert [x.gate for x in G.top_failures(rows, "video").collect()] == [] if passed else ["reference"]


def test_batch_gate_totals_of_a_run(spark):
    costs = metrics(spark).crossJoin(spark.createDataFrame([("v", 2.0, 5, 100, 150), ("w", 4.0, 6, 90, 170), ("x", None, None, None, None)], "id string, elapsed_seconds double, output_bytes long, cache_bytes_before long, cache_bytes_after long"))
    r = G.batch_gate(G.compared(metrics(spark), costs.drop("video").withColumnRenamed("id", "video"), "video"), 1).first()
    assert r.passed and r.n == 1 and r.p_slide_count == 10  # w and x have no baseline, but their costs count
    assert (r.elapsed_total, r.elapsed_average, r.output_bytes, r.cache_growth) == (6.0, 3.0, 11, 80)
    bare = G.batch_gate(G.compared(metrics(spark), metrics(spark), "video"), 1).first()
    assert (bare.reference_gate, bare.least_similarity, bare.elapsed_total, bare.cache_growth) == (True, None, 0.0, 0)


def test_unmatched_spans_against_brute_force(spark):
    """Runs of tokens and heard words without a match, by a loop over the matches."""
    rng = random.Random(3)
    vocabulary = "alfa bravo charlie delta echo foxtrot golfe hotel".split()
    songs = {k: ([rng.choice([*vocabulary, "--"]) for _ in range(rng.randint(0, 40))], [rng.choice([*vocabulary, "uh"]) for _ in range(rng.randint(0, 40))]) for k in range(12)}
    songs[12] = ("alfa bravo".split(), "alfa bravo".split())
    form = lambda x: "" if x == "--" else x
    tokens = spark.createDataFrame([(k, i, x, form(x)) for k, (a, _) in songs.items() for i, x in enumerate(a)], "song int, token_index int, text string, normalized string")
    heard = spark.createDataFrame([(k, i, x) for k, (_, b) in songs.items() for i, x in enumerate(b)], "song int, word_idx int, text string")
    matches = A.aligned_tokens(tokens, heard, "song")
    got = {r.song: (r.lyric_spans, r.word_spans) for r in A.unmatched_spans(matches, tokens, heard, "song").collect()}
    hits = {(r.song, r.token_index): r.word_idx for r in matches.collect()}

    def spans(words, free):
        out, last = [], None
        for i in free:
            if last is not None and i == last + 1:
                out[-1].append(words[i])
            else:
                out.append([words[i]])
            last = i
        return [" ".join(x) for x in out][:5]

    want = {}
    for k, (a, b) in songs.items():
        if a:
            taken = {hits[k, i] for i in range(len(a))}
            want[k] = spans(a, [i for i, x in enumerate(a) if form(x) and hits[k, i] is None]), spans(b, [i for i, x in enumerate(b) if x != "uh" and i not in taken])
    assert got == want and got[12] == ([], []) and any(len(x) == 5 for x, _ in got.values())


def test_lyric_coverage_names_the_lost_words(spark):
    rows = plans.QUERIES["lyric_coverage"](spark, "/root/testdata/sf0.001").collect()
    low = [r for r in rows if r.alignable and r.matched / r.alignable < 0.8]
    assert low and all("; unmatched lyrics: " in r.messages for r in low)


def sung(spark, *sources):
    """Words of a song by source: (text, start, end) each."""
    rows = [(7, name, k, *w) for name, words in sources for k, w in enumerate(words)]
    return spark.createDataFrame(rows, "song int, source string, word_idx int, text string, start double, end double")


def test_consensus_transcript_without_risk(spark):
    """Three sources agree: the winners' words, and no fallback."""
    words = [(t, 1.0 + 0.4 * k, 1.3 + 0.4 * k) for k, t in enumerate("grande amor de Deus".split())] + [(t, 9.0 + 0.4 * k, 9.3 + 0.4 * k) for k, t in enumerate("ele vive em mim".split())]
    song = sung(spark, *((name, words) for name in ("turbo-vocals", "medium-vocals", "medium-original")))
    got = C.transcript(song, "song").orderBy("word_idx").collect()
    assert [(r.text, r.start, r.end) for r in got] == words
    assert {(r.mode, r.reason) for r in got} == {("phrase-consensus", "")}
    assert C.fallback(song, "song").count() == 0


def test_consensus_transcript_at_risk(spark):
    """Three sources that agree on nothing: the whole candidate of the best score, with the reason."""
    texts = {"turbo-vocals": "grande amor de Deus", "medium-vocals": "xyz qqq www kkk", "medium-original": "ontem choveu muito aqui"}
    song = sung(spark, *((name, [(t, 1.0 + 0.4 * k, 1.3 + 0.4 * k) for k, t in enumerate(text.split())]) for name, text in texts.items()))
    got = C.transcript(song, "song").orderBy("word_idx").collect()
    assert [r.text for r in got] == texts["turbo-vocals"].split() and {(r.source, r.mode) for r in got} == {("turbo-vocals", "whole-candidate")}
    assert got[0].reason.startswith("low-confidence phrases 1/1 (100.0%)") and "selected `turbo-vocals` whole transcript" in got[0].reason
    r = C.fallback(song, "song").first()
    assert (r.source, r.n_words, r.reason) == ("turbo-vocals", 4, got[0].reason)


def test_sources_that_fail_leave_the_others_be(spark):
    words = sung(spark, ("turbo-vocals", [("alfa", 0.0, 0.4)]), ("medium-vocals", [("...", 0.0, 0.4)]), ("other", [("x", 0.0, 0.4)]))
    failures = spark.createDataFrame([(7, "turbo-original", "out of memory")], "song int, source string, reason string")
    usable, lost = C.phase_one(words, failures, "song", ("turbo-vocals", "medium-vocals", "turbo-original"))
    assert [(r.source, r.text) for r in usable.collect()] == [("turbo-vocals", "alfa")]
    assert sorted((r.source, r.reason) for r in lost.collect()) == [("medium-vocals", "no words"), ("turbo-original", "out of memory")]
    with pytest.raises(Exception, match="no transcript source"):
        C.phase_one(words, failures, "song", ("medium-vocals",))[1].collect()


def test_risk_reasons_and_repeated_words(spark):
    def reasons(*decisions):
        rows = [(1, low, support, cands, over, mid) for low, support, cands, over, mid in decisions]
        return R.risk_reasons(spark.createDataFrame(rows, "song int, low boolean, support int, n_candidates int, overlap boolean, median_phrases double"), "song").first().reasons

    sure = (False, 2, 2, False, 11.0)
    assert reasons(*[sure] * 10, (False, 2, 2, True, 11.0)) == "overlapping phrase windows 1/10 (10.0%)"
    assert reasons(*[(False, 1, 2, False, 9.0)] * 9) == "" and reasons(*[(False, 1, 3, False, 9.0)] * 9) == "single-source phrase winners 9/9 (100.0%)"
    assert reasons(*[(False, 2, 2, False, 9.0)] * 18) == "phrase fragmentation 18 decisions vs median candidate 9.0"
    said = spark.createDataFrame([(1, 0, "oh", 0.0, 0.1, "a"), (1, 1, "oh,", 0.2, 0.3, "b"), (1, 2, "Oh", 0.4, 0.5, "a")], "song int, word_idx int, text string, start double, end double, source string")
    kept = V.deduplicated_words(said, ["song"], form=X.phrase_form, extra=["source"]).orderBy("word_idx").collect()
    assert [(r.text, r.start, r.end, r.source) for r in kept] == [("oh", 0.0, 0.1, "a"), ("Oh", 0.4, 0.5, "a")]


def test_captions(spark):
    vtt = "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n<c>alfa beta</c>\n\n00:00:02.000 --> 00:00:03.000 align:start\nbeta gama\n"
    f = spark.createDataFrame([(1, vtt)], "song int, vtt string")
    got = captions.without_overlap(captions.cue_rows(f, "song", "vtt"), "song").orderBy("cue").collect()
    assert [(r.text, r.start, r.end) for r in got] == [("alfa beta", 1.0, 2.0), ("gama", 2.0, 3.0)]
    assert captions.plain_text(f, "song", "vtt").first().text == "alfa beta beta gama"


def test_archive_text_round_trip(spark):
    s = spark.createDataFrame([(1, "Canção teste", 0, ["És tudo", "Não temas"], 12.0, "continua")], "song int, title string, slide_idx int, lines array<string>, start_seconds double, aux_text string")
    lja = ini.render_sections(s, "song", "title")
    text = lja.first().lja
    assert "slides=2\r\n" in text and "letra=És tudo|Não temas\r\n" in text and text.endswith("tempo=00:00:12\r\n") and "\n\n" not in text.replace("\r\n\r\n", "")
    rows = {r.kind: r for r in ini.slides_of(ini.parse_sections(lja, "song", "lja"), "song").where("kind is not null").collect()}
    assert rows["CAPA"].text == "Canção teste" and rows["LETRA"].aux == "continua"


def test_last_wins_and_priority(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "id string, ord int, title string")
    assert sorted((r.id, r.title, r.seen) for r in J.last_wins(rows, "id", "ord").collect()) == [("a", "z", 1), ("b", "y", 2)]
    files = spark.createDataFrame([("v", "b.pt.vtt"), ("v", "a.pt.vtt"), ("v", "c.pt-BR.vtt"), ("w", "x.txt")], "id string, path string")
    assert [tuple(r)[:2] for r in J.priority_pick(files, "id", "path", [r"pt-orig\.vtt$", r"pt\.vtt$", r"pt-BR\.vtt$"]).collect()] == [("v", "a.pt.vtt")]


def test_interval_pairs_against_all_pairs(spark):
    rng = random.Random(6)
    items = [(1, i, rng.choice("abc"), s := rng.uniform(0, 100), s + rng.uniform(0, 20)) for i in range(80)]
    df = spark.createDataFrame(items, "song int, idx int, source string, start double, end double")
    got = sorted((r.a_idx, r.b_idx) for r in J.interval_pairs(df, "song", 2.0).collect())
    want = sorted((a[1], b[1]) for a in items for b in items if a[2] < b[2] and b[3] <= a[4] + 2 and b[4] >= a[3] - 2)
    assert got == want


def test_outlines_are_laid_out_once():
    """Outlines are those of ``plan``, rising times or not, and stretches that differ in case, accents or a shift are laid out once."""
    rng, cfg = random.Random(5), Layout(allow_aux=False)
    for aux in (False, True):
        outlines = L.Outlines(Layout(allow_aux=aux))
        for _ in range(600):
            n = rng.randrange(0, 11)
            text = [rng.choice(["a", "de", "amor,", "coração.", "x" * 9, "uma", "não", "casa; azul", ""]) for _ in range(n)]
            start = [0.5 * k + rng.choice([0.0, 0.0, 0.3, 4.0]) for k in range(n)]
            if rng.random() < 0.7:
                start.sort()
            end = [x + rng.choice([0.1, 0.4]) for x in start]
            slides = L.plan(text, start, end, cfg=outlines.cfg)
            assert outlines.of(text, start, end) == [(first, [len(x) for x in lines], len(tail.split())) for lines, first, _, tail in slides]
    once = L.Outlines(cfg)
    words, start = "Não sei se vou, mas vou ficar aqui. Sempre".split(), [0.5 * k for k in range(9)]
    for text, late in ((words, 0.0), ([w.upper() for w in words], 0.0), ([w.replace("ã", "a") for w in words], 0.0), (words, 0.125)):
        once.of(text, [x + late for x in start], [x + late + 0.375 for x in start])
    assert len(once.known) == 1


def test_whole_groups_across_batches():
    import pyarrow as pa

    from verseloom.runtime import whole_groups

    keys = [1, 1, 2, 3, 3, 3, 4]
    whole = pa.RecordBatch.from_pydict({"k": keys, "v": [[x] * x for x in keys]})
    for step in (1, 2, 3, 7):
        batches = [whole.slice(a, step) for a in range(0, 7, step)]
        got = [b.to_pydict() for b in whole_groups(iter([batches[0].slice(0, 0), *batches]), "k")]
        assert [g["k"] for g in got] == [[1, 1], [2], [3, 3, 3], [4]] and got[2]["v"] == [[3, 3, 3]] * 3


def test_consensus_deals_out_texts_not_words(spark):
    """A group's phrases stay in the task that made them: the query's only exchange is that of the documents' texts, and no phrase is stored or shuffled."""
    from verseloom.plans import sequence_queries

    made = sequence_queries.QUERIES["consensus_phrases"](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().sparkPlan().toString() + made._jdf.queryExecution().executedPlan().toString()
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and "phrases-" not in plan
    assert "REPARTITION_BY_NUM" in plan


def test_decisions_number_groups_by_median_start(spark):
    """Groups by median start, of equals as they came; rows of ``arranged`` and the groups themselves give the same decisions."""
    rng = random.Random(11)
    rows = [(song, source, k, rng.choice("alfa beta gama delta zeta luz".split()), 0.6 * k + late, 0.6 * k + late + 0.4) for song in range(6) for source, late in (("turbo-vocals", 0.0), ("medium-vocals", rng.choice([0.0, 3.0])), ("medium-denoise", 0.3)) for k in range(rng.randint(1, 40)) if rng.random() < 0.9]
    words = spark.createDataFrame(rows, "song int, source string, word_idx int, text string, start double, end double")
    phrases = C.arranged(words, "song", Layout(allow_aux=False))
    starts = {}
    for r in phrases.collect():
        starts.setdefault((r.song, r.part), []).append(r.start)
    for song in range(6):
        mids = [sorted(starts[k])[(len(starts[k]) - 1) // 2] / 2 + sorted(starts[k])[len(starts[k]) // 2] / 2 for k in sorted(starts) if k[0] == song]
        assert mids == sorted(mids)
    a, b = C.decided(phrases, "song", Layout(allow_aux=False)).drop("words"), C.consensus(words, "song")
    assert a.columns == b.columns and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert sorted((r.song, r.idx) for r in b.collect()) == sorted(starts)


def test_consensus_takes_few_python_tasks_and_no_words_back(spark):
    """Words that many parts hold go through Python in as many tasks as shuffle partitions; queries that return no words store none."""
    words = sung(spark, *((name, [("alfa", 0.0, 0.4), ("beta", 0.5, 0.9)]) for name in ("turbo-vocals", "medium-vocals"))).repartition(32, "song")
    groups = C.assembled(words, "song", Layout(allow_aux=False), with_words=False)
    assert groups.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "words" not in groups.schema["members"].dataType.elementType.names
    assert [[(m.source, m.n_words, m.likes) for m in r.members] for r in groups.collect()] == [[("medium-vocals", 2, [1.0]), ("turbo-vocals", 2, [1.0])]]
