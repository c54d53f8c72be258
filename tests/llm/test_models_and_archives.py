"""Classifiers by held-out accuracy, archives by round trip, the pipeline stage by stage."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from verseloom.llm import near_dedup, packing, quality, toxicity, warc
from verseloom.llm import queries as llm

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, score double, label int"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, 0.1, 1) for i, t in rows], DOCS)


def sentence(rng, n, words="alfa beta gama delta epsilon zeta theta iota kapa lamda".split()):
    return " ".join(rng.choice(words) for _ in range(n))


def test_quality_on_held_out_rows(spark):
    rng = random.Random(0)
    rows = []
    for i in range(600):
        good = i % 4 > 0
        t = sentence(rng, rng.randint(20, 200)).capitalize() + "." if good else sentence(rng, 60) + " " + " | ".join(sentence(rng, 2).upper() + "!!" for _ in range(rng.randint(15, 60)))
        rows.append((i, t))
    docs = texts(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    out = quality.with_score(docs, model)
    assert out.columns == ["doc_id", "text", "label", "score"]
    got = {r.doc_id: r.score for r in out.collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == (i % 4 > 0) for i in held) >= 0.95 * len(held)
    odd = quality.with_score(texts(spark, [(1, None), (1, ""), (2, "x" * 200_000), (None, "a b c " * 50_000)]), model).collect()
    assert len(odd) == 4 and all(0 <= r.score <= 1 for r in odd)
    assert quality.with_score(docs.limit(0), model).count() == 0


def test_quality_without_labels(spark):
    docs = texts(spark, [(1, "a b"), (2, None)])
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r.score for r in quality.with_score(docs, model).collect()] == [0.5, 0.5]


def test_attention_gradient():
    import numpy as np

    rng = np.random.default_rng(0)
    m = quality.AttentionMil.fresh(np.zeros(5), np.ones(5), 0.1)
    words = [rng.integers(0, quality.BUCKETS, n).astype(np.uint16) for n in (70, 200, 130, 0)]
    bags = quality.joined([(rng.normal(size=(max(1, -(-len(w) // quality.PASSAGE)), 5)), w) for w in words])
    y = np.array([1.0, 0.0, 1.0, 0.0])
    loss = lambda: -np.mean(y * np.log(m.forward(bags)[-1]) + (1 - y) * np.log(1 - m.forward(bags)[-1]))
    g = m.gradient(bags, y)
    for name in m.NAMES:
        p = m.p[name]
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p.shape) if name != "words" else (int(rng.choice(words[0])), int(rng.integers(0, p.shape[1])))
            kept, eps = p[at], 1e-5
            p[at] = kept + eps
            up = loss()
            p[at] = kept - eps
            down = loss()
            p[at] = kept
            assert g[name][at] == pytest.approx((up - down) / (2 * eps), abs=1e-5)


def test_quality_scores_against_brute_force(spark):
    """Every score is the plain forward pass: passages, features and vectors, gates, attention and the logistic layer, one number at a time."""
    import math

    import numpy as np

    rng, docs = random.Random(3), []
    for i in range(60):
        docs.append((i, sentence(rng, rng.randint(0, 300)) if i % 3 else sentence(rng, 40).upper() + "!! | " * 30))
    docs += [(60, None), (61, "")]
    model = quality.train(texts(spark, docs), spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int"))
    p = {k: v.tolist() for k, v in model.p.items()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    sig = lambda x: 1 / (1 + math.exp(-x))
    for r in quality.with_score(texts(spark, docs), model).collect():
        words, hidden, energy = (r.text or "").split(), [], []
        for lo in range(0, max(1, len(words)), quality.PASSAGE):
            own = words[lo : lo + quality.PASSAGE]
            x = [(float(np.float32(v)) - m) / s for v, m, s in zip(quality.passage_features(own), p["mean"], p["std"])]
            vectors = [p["words"][int(quality.token_hashes([w])[0]) * quality.BUCKETS >> 64] for w in own]
            mean = [sum(v[j] for v in vectors) / max(1, len(own)) for j in range(quality.HIDDEN)]
            h = [max(0.0, dot(p["w1"][j], x) + mean[j] + p["b1"][j]) for j in range(quality.HIDDEN)]
            hidden.append(h)
            energy.append(sum(p["w"][j] * math.tanh(dot(p["v"][j], h)) * sig(dot(p["u"][j], h)) for j in range(quality.GATE)))
        share = [math.exp(e - max(energy)) for e in energy]
        z = [sum(a * h[j] for a, h in zip(share, hidden)) / sum(share) for j in range(quality.HIDDEN)]
        assert r.score == pytest.approx(sig(dot(z, p["out"]) + p["bias"][0]), abs=1e-9)


def test_words_alone_decide_where_shapes_agree(spark):
    rng = random.Random(6)
    kinds = [["tolan", "meris", "dovek", "salit"], ["bakun", "firom", "netal", "gosil"]]
    docs = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(50))) for i in range(400)]
    model = quality.train(texts(spark, docs), spark.createDataFrame([(i, i % 2, 0) for i, _ in docs], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in quality.with_score(texts(spark, docs), model).collect()}
    assert all((got[i] >= 0.5) == (i % 2) for i in got)


def test_equal_texts_with_clashing_labels_train_alike(spark):
    from verseloom.llm.labelled import training_texts

    docs = texts(spark, [(i, ["same", "tie", "other"][i % 3]) for i in range(30)])
    labels = spark.createDataFrame([(i, int(i < 24 if i % 3 == 0 else i < 15), 0) for i in range(30)], "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, training_texts(docs, labels, "quality", 1_000_003, -1, 100).collect()))
    assert got == sorted(map(tuple, training_texts(docs.repartition(7), labels.repartition(5), "quality", 1_000_003, -1, 100).collect())) == [("other", 1), ("same", 1), ("tie", 1)]


def test_long_labelled_texts_are_learnt_whole():
    shapes, words = quality.bag("w " * 64_000)
    assert len(shapes) == 1_000 and len(words) == 64_000


@pytest.mark.parametrize("text, word", [("you ID10T", "idiot"), ("ѕtuрid man", "stupid"), ("M0R0N!!", "moron"), ("trásh###", "trash"), ("ｃｌｏｗｎ", "clown"), ("id​iot", "idiot"), ("$tupid", "stupid")])
def test_folding(text, word):
    assert f" {word.replace('l', 'i')} " in toxicity.fold(text)


def test_exceptions_cover_hits():
    lex = toxicity.Lexicon({" ciown ": 3.0, " tras": 1.0, " trash ": 2.0}, [" ciown fish "], [0.0] * 8)
    assert lex.hits(toxicity.fold("a clown fish")) == []
    assert [(w, n) for _, _, w, n in lex.hits(toxicity.fold("Clown, trash trasher clown"))] == [(3.0, 2), (2.0, 1), (1.0, 1)]


def brute_toxicity(lex, text):
    """The score by looking every entry up at every place."""
    import math

    folded = toxicity.fold(text)
    covered = [(k, k + len(e) - 1) for e in lex.exceptions for k in range(len(folded)) if folded.startswith(e, k)]
    words = {}
    for k in range(len(folded)):
        found = [e for e in lex.entries if folded.startswith(e, k)]
        if found and not any(a <= k < b for a, b in covered):
            word, weight = folded[k : folded.find(" ", k + 1)], lex.entries[max(found, key=len)]
            words[word] = (weight, words.get(word, (0, 0))[1] + 1)
    n = folded.count(" ") - 1
    total, often = sum(w for w, _ in words.values()), sum(w * c for w, c in words.values())
    x = [math.log1p(total), total / (n + 20) * 10, math.log1p(len(words)), max((w for w, _ in words.values()), default=0.0), total / math.sqrt(n + 20), math.log1p(often), often / (n + 20)]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(lex.weights, x)) - lex.weights[-1]))


def test_toxicity_scores_against_brute_force(spark):
    rng = random.Random(5)
    bad = ["zorgon", "blarfing", "blarfed", "qx", "w" * 60, "supercalifragil", "supercalifragous"]
    docs = [(i, sentence(rng, rng.randint(0, 60)) + (" " + " ".join(rng.sample(bad, 3)) + " trash can zorgon trophy" if i % 4 == 0 else " zorgon trophy" if i % 4 == 1 else "")) for i in range(600)]
    lex = toxicity.train(texts(spark, docs), spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in docs], "doc_id long, quality int, toxic int"))
    assert {" qx ", f" {'w' * 60} "} <= set(lex.entries) and any(e.startswith(" biarf") for e in lex.entries)
    odd = [(1000, None), (1001, ""), (1002, " Z0RG0N! zorgon,zorgon"), (1003, "trash can qx qx"), (1004, "zorgonzorgon blarf" + "e" * 500)]
    for r in toxicity.with_score(texts(spark, docs[:80] + odd), lex).collect():
        assert r.score == pytest.approx(brute_toxicity(lex, r.text or ""), abs=1e-9)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(1)
    rows, bad = [], set()
    for i in range(800):
        t = sentence(rng, rng.randint(20, 120)).split()
        if i % 6 == 0:
            bad.add(i)
            for w in rng.sample(["zorgon", "blarf", "qwixel"], 2):
                t.insert(rng.randrange(len(t)), w)
        rows.append((i, " ".join(t)))
    docs = texts(spark, rows)
    lex = toxicity.train(docs, spark.createDataFrame([(i, 1, int(i in bad)) for i, _ in rows], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.with_score(docs, lex).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.3) == (i in bad) for i in held) >= 0.97 * len(held)
    disguised = toxicity.with_score(texts(spark, [(1, "alfa beta Z0RG0N gama b1arf delta"), (2, None), (3, ""), (4, "alfa " * 100_000)]), lex).collect()
    by = {r.doc_id: r.score for r in disguised}
    assert by[1] >= 0.3 and by[2] == by[3] < 0.3 and by[4] < 0.3
    assert toxicity.with_score(docs.limit(0), lex).count() == 0
    empty = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in toxicity.with_score(docs.limit(3), empty).collect()} == {0.5}


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, key string, length int")


def test_archive_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, f"http://www{i % 7}.example.com/p/{i % 90}?q={i}", f"<p>{rng.randint(0, 60)}</p>" + "é" * (i % 5)) for i in range(300)]
    rows += [(300, None, None), (301, "http://x/", ""), (None, "not a url\r\nX: y", "<p>solo</p>"), (302, "http://[bad", "z" * 300_000), (303, rows[0][1], "<p>other</p>"), (303, rows[0][1], "<p>other</p>")]
    got = warc.archive_round_trip(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    first = defaultdict(lambda: None)
    for i, _, h in rows:
        h = h or ""
        if i is not None and (first[h] is None or i < first[h]):
            first[h] = i
    want = defaultdict(int)
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = first[h or ""] is not None and first[h or ""] != i
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None] += 1
    have = defaultdict(int)
    for r in got:
        have[r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to] += 1
    assert have == want
    assert warc.archive_round_trip(pages(spark, [])).count() == 0


def test_small_payloads_are_all_responses(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, "http://c/", "longer text"), (4, "http://d/", "longer text")]
    got = {r.page_id: r.record_type for r in warc.archive_round_trip(pages(spark, rows), least=6).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_index_finds_every_capture(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 8)
    rows = [(i, f"http://h{i % 3}.example.org/{i % 10}", f"<p>{i}</p>") for i in range(200)]
    lines = warc.write_archives(pages(spark, rows))
    index = warc.CaptureIndex(warc.write_index(lines))
    for r in random.Random(0).sample(lines.collect(), 80):
        assert list(index.find(r.key, r.page_id)) == [(r.file, r.offset, r.length)]
    assert list(index.find("org,example,h9)/", 1)) == []
    assert warc.capture_key("HTTP://WWW.Example.COM:80/a?b#c") == "com,example,www)/a?b"


def test_queries_run_on_whole_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_cws_fingerprints", "op3_mil_quality", "op5_exact_dedup", "op7_lexicon_toxicity", "op9_bpe_round_trip"):
        assert llm.QUERIES[name](spark, SF).count() == n, name
    assert llm.QUERIES["op10_chat_format"](spark, SF).where("conv_id = -7").first().loss_chars == len("</s>[INST] ok [/INST]")


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).persist()
        assert after.columns == columns
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and len(ids) == after.count() > 0
        kept[name] = ids
        before = after
    texts_left = [r.text for r in before.collect()]
    assert len(set(texts_left)) == len(texts_left)
    assert near_dedup.classify(before).where(F.col("doc_id") != F.col("class_id")).count() == 0
    packed = packing.pack(before, llm.BPE_FILE)
    assert {r.doc_id for r in packed.collect()} == kept["near_dedup"]
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, run.select("doc_id", "piece", "length").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "length").collect()))


def test_stages_take_empty_tables(spark):
    before = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        before = stage(spark, before, SF)
        assert before.count() == 0


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = c.execute(llm.SQL[name]).df(), llm.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert sorted(map(tuple, want[columns].astype(str).values)) == sorted(map(tuple, got[columns].astype(str).values))


def test_stages_hold_little_of_long_texts(spark, tmp_path):
    """Readers and writers are bounded, also for what the caller writes, and rows are not sorted with their texts; 8 tasks in a heap of 1 GB failed by it."""
    import pyarrow.parquet as pq

    from verseloom.runtime import BOUNDS

    own = spark.newSession()
    own.conf.set("spark.sql.parquet.columnarReaderBatchSize", "64")
    words = [f"w{k:x}" for k in range(20_000)]
    rows = [(k, " ".join(random.Random(k).choices(words, k=8_000))) for k in range(300)] + [(0, "a b"), (0, "a b")]
    docs = own.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    left = corpus_pipeline.drop_exact_copies(own, docs, "")
    assert sorted(r.doc_id for r in left.collect()) == [0, *range(300)]
    single = corpus_pipeline.drop_exact_copies(own, docs.where("text <> 'a b'"), "")
    assert "Window" not in single._jdf.queryExecution().optimizedPlan().toString()
    single.coalesce(1).write.parquet(str(tmp_path / "out"))
    meta = pq.ParquetFile(next((tmp_path / "out").glob("*.parquet"))).metadata
    assert meta.num_row_groups > 1 and max(meta.row_group(k).total_byte_size for k in range(meta.num_row_groups)) < 2 * int(BOUNDS["parquet.block.size"])
    assert own.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "64"


def test_stages_send_python_few_bytes_at_once(spark):
    """A stage's batches for Python are bounded by bytes; batches of 10,000 long texts, there and back for 8 tasks, took all direct memory beside a small heap."""
    from verseloom.runtime import BOUNDS, bound_memory

    own = spark.newSession()
    bound_memory(own)
    docs = own.range(0, 1_500, 1, 1).selectExpr("id as doc_id", "repeat(concat(id, ' '), 4000) as text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    got = docs.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in got) == 1_500 and max(r.bytes for r in got) < 2 * int(BOUNDS["spark.sql.execution.arrow.maxBytesPerBatch"])
