"""Fingerprints, tokens, chat, packing and dedup on small tables, against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verseloom.llm import bpe, chat, exact_dedup, fingerprints, icws, near_dedup, packing, tokens
from verseloom.llm.shared import words_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, score double, digest string, id long"
ODD = [
    "",
    None,
    " ",
    "a",
    "aaaa aaaaaaa",
    "<|endoftext|>",
    "x <|endoftext|>y  \n\n z",
    "I'll don't 'S  ½ ² Ⅷ १२ _a_ \x1c\x1d  　日本語 🎉👩‍👩‍👧 é",
    "\t\ta b \x85c",
    "hello   world  ",
    "ab\x00c ﻿ ÀÉß ''' 're 'RE",
    "x" * 3000,
    "the cat sat on the mat. " * 300,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 0.5, "d", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows, and extra columns with clashing names."""
    rows = list(enumerate(ODD)) + [(3, "a"), (3, "b"), (None, "hello   world  "), (None, None), (40, "hello world ")]
    return rows, table(spark, rows)


def test_bpe_equals_the_library(spark, odd, tokenizer):
    rows, df = odd
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode_ids(df, PATH).collect())
    want = Counter()
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), tokenizer.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    assert bpe.encode_digests(df.limit(0), PATH).count() == 0


def test_bpe_on_random_strings(tokenizer):
    rng = random.Random(0)
    chars = "aabbccthe  \n\t'sérñ1½_-.,!日🎉́"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    model = bpe.load(PATH)
    words = [model.words(t) for t in texts]
    flat = sorted({w for ws in words for w in ws}, key=str)
    ids, start = model.merge(flat)
    own = {w: ids[start[k] : start[k + 1]].tolist() for k, w in enumerate(flat)}
    for t, ws in zip(texts, words):
        assert [x for w in ws for x in own[w]] == tokenizer.encode(t, add_special_tokens=False).ids


def test_bpe_forgets_and_goes_on(spark, tokenizer, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "CHUNK_CHARS", 50)
    monkeypatch.setattr(bpe, "CHUNK_WORDS", 20)
    texts = [f"word{k} and word{k + 1} {'x' * k}" for k in range(40)]
    got = []
    for _, ids, begins in bpe.encoded(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])]), PATH, 0):
        got += [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:])]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_fast_encoder_and_spans(tokenizer):
    code = tokens.encoder(PATH)
    for t in ODD:
        e = tokenizer.encode(t or "", add_special_tokens=False)
        ids = code.ids(t or "")
        assert ids.tolist() == e.ids
        start, end = tokens.spans(code.bpe, ids)
        for a, b, (x, y), k in zip(start, end, e.offsets, e.ids):
            assert b == y and (a == x or (t[a : a + 1].isspace() and a < x)), (t, k)  # offsets of the library may leave blanks out


@pytest.mark.parametrize("rule", tokens.RULES)
def test_attribution_rules(rule):
    rng = random.Random(1)
    for _ in range(200):
        cuts = sorted(rng.sample(range(1, 40), 4)) + [40]
        bounds = sorted(rng.sample(range(41), 12))
        spans = [(a, b) for a, b in zip(bounds, bounds[1:])]
        got = tokens.attribute(np.array([a for a, _ in spans]), np.array([b for _, b in spans]), np.array(cuts), rule)
        for (a, b), g in zip(spans, got):
            parts = Counter(next(k for k, c in enumerate(cuts) if x < c) for x in range(a, b))
            want = {"start": min(parts), "end": max(parts), "most": min(k for k, n in parts.items() if n == max(parts.values()))}[rule]
            assert g == want


def test_section_tokens_sum_to_the_document(spark, odd, tokenizer):
    rows, df = odd
    got = defaultdict(int)
    for r in tokens.section_tokens(df, PATH).collect():
        assert r.char_start <= r.char_end
        got[r.doc_id] += r.n_tokens
    want = defaultdict(int)
    for i, t in rows:
        want[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    assert got == want


def byte_spans(tokenizer, ids):
    """Character spans of tokens from the bytes before them: a token that holds part of a character holds it all."""
    symbols = bpe.byte_symbols()
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    out, data = [], b""
    for k in ids:
        name = tokenizer.id_to_token(k)
        new = name.encode() if name in special else bytes(symbols[c] for c in name)
        first = len(data.decode("utf-8", "ignore"))
        data += new
        out.append((first, sum(b & 0xC0 != 0x80 for b in data)))
    return out


def test_section_rows_against_brute_force(spark, odd, tokenizer):
    rows = odd[0] + [(50, "é🎉\n日本\n\nx  \n y\n"), (51, "\n\n\n"), (52, "a b\nc" * 9)]
    for rule in tokens.RULES:
        want = Counter()
        for i, t in rows:
            t = t or ""
            lines = t.split("\n")
            sections = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
            ends = np.cumsum([len(x) for x in sections]).tolist()
            begins = [0, *ends[:-1]]
            n, over = Counter(), Counter()
            for a, b in byte_spans(tokenizer, tokenizer.encode(t, add_special_tokens=False).ids):
                own = [next(k for k, e in enumerate(ends) if x < e) for x in range(a, max(b, a + 1))]
                parts = Counter(own)
                k = {"start": own[0], "end": own[-1], "most": min(k for k, v in parts.items() if v == max(parts.values()))}[rule]
                n[k] += 1
                over[k] += a < begins[k] or b > ends[k]
            for k, (a, b) in enumerate(zip(begins, ends)):
                want[i, k, a, b, n[k], over[k]] += 1
        assert Counter(map(tuple, tokens.section_tokens(table(spark, rows), PATH, rule=rule).collect())) == want


LONG = [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "x" + " " * 1_000_000 + "y", " \n\t" * 400_000 + "z<|endoftext|>  "]


def test_long_runs_are_encoded(spark, tokenizer):
    """Sections, pieces and the pipeline's packing of texts whose runs of blanks or letters are longer than the library's pattern takes."""
    import corpus_pipeline

    rows = list(enumerate(LONG))
    want = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    whole = tokens.section_tokens(table(spark, rows), PATH, sections=lambda t: [len(t)]).collect()
    assert {r.doc_id: r.n_tokens for r in whole} == {i: len(ids) - 1 for i, ids in want.items()}
    for packed in (packing.pack(table(spark, rows), PATH), corpus_pipeline.pack(spark, table(spark, rows), "")):
        for r in packed.collect():
            assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())


def test_fingerprints_against_brute_force(spark, odd):
    rows, df = odd
    got = fingerprints.fingerprint_neighbours(df).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by = defaultdict(set)
    for r in got:
        by[dict(rows).get(r.doc_id) if r.doc_id not in (3, None) else None].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    empty = [r for r in got if r.n_chars == 0]
    assert len({r.fingerprint for r in empty}) == 1
    assert fingerprints.fingerprint_neighbours(df.limit(0)).count() == 0
    one = fingerprints.fingerprint_neighbours(df.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprints_hold_over_partitions(spark):
    rng = random.Random(2)
    rows = [(i * 3, " ".join(rng.choice("alfa beta gama delta eta".split()) for _ in range(rng.randint(0, 30)))) for i in range(200)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {r.doc_id: r for r in fingerprints.fingerprint_neighbours(table(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        changed = fingerprints.edited(t, order[(k + 1) % len(order)][1])
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
    by = defaultdict(set)
    for i, t in rows:
        by[t].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by.values())


def jaccard(a, b):
    keys = {*a, *b}
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def test_samples_collide_as_generalised_jaccard():
    maker, rng = fingerprints.Fingerprinter(4096), random.Random(3)
    words = [f"word{k}" for k in range(60)]
    for _ in range(6):
        a, b = (" ".join(rng.choice(words[: rng.randint(20, 60)]) for _ in range(rng.randint(30, 200))) for _ in range(2))
        weigh = lambda t: {w: n * len(w) for w, n in Counter(words_of(t)).items()}
        assert fingerprints.likeness(maker.signature(a), maker.signature(b)) == pytest.approx(jaccard(weigh(a), weigh(b)), abs=0.035)


@pytest.mark.parametrize("n", [1_000, 10_000, 50_000])
def test_likeness_has_no_bias_at_any_size(n):
    """Mean over 12 pairs of the deployed number of samples, within three standard errors of the exact similarity."""
    maker, errors = fingerprints.Fingerprinter(), []
    for seed in range(12):
        rng = random.Random(f"{n}-{seed}")
        names = [f"w{seed}x{k}" for k in range(n)]
        shared, a, b = names[: n // 2], names[n // 2 : 3 * n // 4], names[3 * n // 4 :]
        left, right = ([*shared, *own, *rng.choices(shared, k=n // 5)] for own in (a, b))
        weigh = lambda ws: {w: c * len(w) for w, c in Counter(ws).items()}
        exact = jaccard(weigh(left), weigh(right))
        errors.append(fingerprints.likeness(maker.signature(" ".join(left)), maker.signature(" ".join(right))) - exact)
    se = (exact * (1 - exact) / fingerprints.SAMPLES / 12) ** 0.5
    assert abs(np.mean(errors)) < 3 * se and max(map(abs, errors)) < 4.5 * se * 12**0.5


def test_likenesses_of_the_query_against_brute_force(spark):
    """Both likenesses are the share of equal samples of the two fingerprints, and near the exact generalised Jaccard similarity."""
    rng = random.Random(12)
    words = [f"word{k}" for k in range(400)]
    rows = [(i, " ".join(rng.choice(words[: rng.randint(30, 400)]) for _ in range(rng.randint(50, 700)))) for i in range(40)]
    got = {r.doc_id: r for r in fingerprints.fingerprint_neighbours(table(spark, rows)).collect()}
    weigh = lambda t: {w: c * len(w) for w, c in Counter(words_of(t)).items()}
    share = lambda a, b: sum(a[k : k + 4] == b[k : k + 4] for k in range(0, len(a), 4)) / (len(a) / 4)
    for i, t in rows:
        nxt = (i - 1) % len(rows)
        following = rows[nxt][1]
        changed = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        r = got[i]
        assert r.near_edited == share(r.fingerprint, r.edited_fingerprint) == pytest.approx(jaccard(weigh(t), weigh(changed)), abs=0.2)
        assert r.near_next == share(r.fingerprint, got[nxt].fingerprint) == pytest.approx(jaccard(weigh(t), weigh(following)), abs=0.2)


def test_signature_paths_agree():
    s, rng = icws.Sampler(64), np.random.default_rng(0)
    bags = [(rng.integers(0, 1 << 63, n, np.uint64), rng.random(n).astype(np.float32)) for n in (300, 0, 1, 900, 5, 384, 383)]
    for (terms, weight), got in zip(bags, s.signatures(bags)):
        want = icws.named(s.samples(terms, weight).min(axis=0)) if len(terms) else np.zeros(64, np.uint32)
        assert (got == want).all()


def brute_exact(rows):
    import re

    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return groups


def test_exact_dedup_against_brute_force(spark, odd):
    rows, df = odd
    got = exact_dedup.decide(df).collect()
    groups = brute_exact(rows)
    assert len(got) == len(rows)
    want = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    left = exact_dedup.deduplicated(df)
    assert left.columns == df.columns and left.count() == len(groups)
    assert exact_dedup.decide(df.limit(0)).count() == 0


def lsm_rows():
    rng = random.Random(4)
    ids = [None, *range(1000)]
    return [(hashlib.sha256(str(rng.randint(0, 700)).encode()).digest(), ids[k], k, k * 7) for k in range(1001)]


def entries_of(segments):
    return [np.frombuffer(bytes(r.entries), exact_dedup._ENTRY) for r in segments]


def test_lsm_runs_and_filters(spark):
    rows = lsm_rows()
    df = spark.createDataFrame(rows, "digest binary, doc_id long, row long, mark long").repartition(3)
    runs = exact_dedup.sorted_runs(df, memtable=40).persist()
    for r, entries in zip(runs.collect(), entries_of(runs.collect())):
        digests = entries["digest"].tolist()
        assert digests == sorted(set(digests)) and exact_dedup.may_hold(bytes(r.bloom), entries["digest"]).all()
        others = np.array(sorted({d for d, *_ in rows} - set(digests)), "S32")
        assert exact_dedup.may_hold(bytes(r.bloom), others).mean() <= 0.2
    want = defaultdict(list)
    for d, i, row, mark in rows:
        want[d].append((i is None, i or 0, row, mark))
    for fan in (2, 8):
        index = exact_dedup.compacted(runs, fan).collect()
        assert len(index) == len({r.shard for r in index})
        found = {d: (bool(none), i, row, mark, n) for e in entries_of(index) for d, none, i, row, mark, n in e.tolist()}
        assert found == {d: (*min(v), len(v)) for d, v in want.items()}
    twice = {bytes(r.digest): (r.least_id, r.n) for r in exact_dedup.repeated(exact_dedup.compacted(runs)).collect()}
    assert twice == {d: (None if min(v)[0] else min(v)[1], len(v)) for d, v in want.items() if len(v) > 1}
    asked = [*list(want)[:5], hashlib.sha256(b"not there").digest()]
    for stored in (runs, exact_dedup.compacted(runs)):
        found = {bytes(r.digest): (r.least_row, r.n) for r in exact_dedup.probe(stored, asked).collect()}
        assert found == {d: (min(want[d])[2], len(want[d])) for d in asked[:5]}


def test_filters_decide_what_a_merge_reads(spark):
    """Without filters (ones that hold everything) a compaction gives the same index, but every entry enters its merges."""
    df = spark.createDataFrame(lsm_rows(), "digest binary, doc_id long, row long, mark long").repartition(3)
    runs = exact_dedup.sorted_runs(df, memtable=200).persist()
    blind = runs.withColumn("bloom", F.expr("cast(x'ffffffffffffffff' as binary)"))
    with_, without = (exact_dedup.compacted(x, 100).collect() for x in (runs, blind))
    assert [e.tolist() for e in entries_of(with_)] == [e.tolist() for e in entries_of(without)]
    assert sum(r.merged for r in without) == runs.agg(F.sum("n")).first()[0]
    assert sum(r.merged for r in with_) < 0.8 * sum(r.merged for r in without)


def test_confounded_texts_are_parted(spark, odd):
    """Texts that a weak digest confounds leave the group by their bytes, and the rest's size is theirs alone."""
    weak = lambda t: F.unhex(F.rpad(F.substring(F.sha2(t, 256), 1, 1), 64, "0"))
    want = Counter(map(tuple, exact_dedup.decide(odd[1]).collect()))
    assert Counter(map(tuple, exact_dedup.decide(odd[1], digests=(weak, weak)).collect())) == want


def test_repeated_rows_do_not_multiply(spark):
    rows = [(1, "same text"), *[(2, "same  text")] * 700, (3, "other")]
    got = exact_dedup.decide(table(spark, rows)).collect()
    assert len(got) == 702 and sum(r.kept for r in got) == 2 and {r.group_size for r in got} == {701, 1}
    left = exact_dedup.deduplicated(spark.createDataFrame([(2, "x", 5, 6), (2, "x", 5, 6), (None, "x", 5, 6)], "doc_id long, text string, __id long, __mark_ long"))
    assert left.columns == ["doc_id", "text", "__id", "__mark_"] and left.collect() == [(2, "x", 5, 6)]


def shingle_bag(t):
    w = words_of(t)
    return Counter(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else Counter([tuple(w)])


def near_rows():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    rows, i = [], 0
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.choice([1, 1, 2, 5, 60 if g == 0 else 3])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((i, " ".join(copy)))
            i += 1
    return rows + [(i, ""), (i + 1, None), (i + 2, "one two"), (i + 3, "One, two!"), (i + 4, "..."), (i + 5, "..."), (i + 6, "a b c d e " * 400), (i + 7, "a b c d e " * 401), (None, "one two")]


def weighted_links(texts, threshold=0.8):
    """Pairs of places of equal words or of a weighted Jaccard similarity of TF-IDF shingles that reaches the threshold, by brute force."""
    bags = [shingle_bag(t) if words_of(t) else Counter() for t in texts]
    df = Counter(s for b in bags for s in b)
    idf = {s: 1 + np.log(1 / min(1, max(n / len(texts), near_dedup.FREQUENT))) for s, n in df.items()}
    weighed = [{s: n * idf[s] for s, n in b.items()} for b in bags]
    total = [sum(w.values()) for w in weighed]
    where, links = defaultdict(list), {}
    for k, w in enumerate(weighed):
        shared = Counter()
        for s, x in w.items():
            for j in where[s]:
                shared[j] += min(x, weighed[j][s])
            where[s].append(k)
        for j, x in shared.items():
            if (likeness := x / (total[k] + total[j] - x)) >= threshold:
                links[j, k] = likeness
    for name in (lambda t: tuple(words_of(t)) or t,):
        same = defaultdict(list)
        for k, t in enumerate(texts):
            same[name(t)].append(k)
        links |= {(own[0], k): 1.0 for own in same.values() for k in own[1:]}
    return links


def joined_places(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    return [root(k) for k in range(n)]


@pytest.mark.parametrize("signature_block, text_block", [(4096, 512), (16, 7)])
def test_near_dedup_against_all_pairs(spark, monkeypatch, signature_block, text_block):
    monkeypatch.setattr(near_dedup, "SIGNATURE_BLOCK", signature_block)
    monkeypatch.setattr(near_dedup, "TEXT_BLOCK", text_block)
    rows = near_rows()
    got = near_dedup.classify(table(spark, rows)).collect()
    ids = {i: k for k, (i, _) in enumerate(rows)}
    classes = defaultdict(set)
    for r in got:
        classes[r.comp].add(ids[r.doc_id])
    want = defaultdict(set)
    for k, root in enumerate(joined_places(len(rows), weighted_links([t or "" for _, t in rows]))):
        want[root].add(k)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))
    for r in got:
        members = [rows[k][0] for k in classes[r.comp]]
        assert r.class_id == min((m for m in members if m is not None), default=None) and r.class_size == len(members)
        assert r.kept == (r.doc_id == r.class_id) and (r.class_size == 1) <= (r.n_links == 0)
    left = near_dedup.deduplicated(table(spark, rows))
    assert left.count() == len(classes) and left.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" double", "").split(", ")
    assert near_dedup.classify(table(spark, [])).count() == 0


def test_near_dedup_recall_on_the_documents(spark):
    """Of all pairs that reach the similarity, by brute force over whole texts, and of the joined ones, the share that is right."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    links = weighted_links([t for _, t in rows])
    comp = {r.doc_id: r.comp for r in near_dedup.classify(docs).collect()}
    assert sum(comp[rows[a][0]] == comp[rows[b][0]] for a, b in links) >= 0.99 * len(links) > 50
    root = {rows[k][0]: r for k, r in enumerate(joined_places(len(rows), links))}
    assert len(set(comp.values())) >= len(set(root.values()))  # nothing else is joined


def test_one_row_a_class_is_kept(spark):
    text = "some words that are long enough to be a shingle of their own"
    rows = [(1, text), (1, text), (1, text + "!"), (None, text), (None, "other"), (None, "other"), (2, "")]
    got = near_dedup.classify(table(spark, rows)).collect()
    assert Counter(r.class_id for r in got if r.kept) == Counter([1, None, 2]) and len(got) == 7
    assert sorted(r.text for r in near_dedup.deduplicated(table(spark, rows)).collect()) in (sorted(["", "other", t]) for t in (text, text + "!"))


def test_frequencies_are_exact(spark):
    rows = near_rows()
    source = near_dedup._source(table(spark, rows), "doc_id", "text")
    counted = near_dedup.keys_and_frequencies(source).persist()
    idf = near_dedup.idf_table(source, counted, len(rows))
    want = Counter(x for _, t in rows for x in near_dedup.shingles(near_dedup.word_hashes(t or ""))[0].tolist())
    assert dict(zip(idf.terms.tolist(), idf.values.tolist())) == pytest.approx({x: 1 + np.log(len(rows) / n) for x, n in want.items() if n >= near_dedup.FREQUENT * len(rows)}, rel=1e-6)


@pytest.mark.parametrize("part", [None, 40])
def test_rare_shingles_weigh_by_their_frequency(spark, monkeypatch, part):
    """Of 604 documents, a pair of likeness 0.811 by counts alone has 0.796 by TF-IDF and is parted; one of 0.836 has 0.822 and is joined."""
    if part:
        monkeypatch.setattr(near_dedup, "PART", part)
    rows = [(10 + k, " ".join(f"u{k}x{j}" for j in range(6))) for k in range(600)]
    for at, n in ((0, 52), (2, 60)):
        words = [f"s{at}y{j}" for j in range(n)]
        rows += [(at, " ".join(words)), (at + 1, " ".join([*words[:25], "other", *words[26:]]))]
    got = {r.doc_id: r.class_id for r in near_dedup.classify(table(spark, rows)).where("doc_id < 4").collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2}


def test_near_dedup_keeps_whole_counts(spark):
    """Counts that differ by ten times part texts of the same shingles; a great shared count joins texts of many own ones."""
    rng = random.Random(11)
    own = [" ".join(f"{side}{rng.random()}" for _ in range(3500)) for side in "pq"]  # two words a number
    rows = [(1, "a b c d e " * 20_000), (2, "a b c d e " * 200_000), (3, "x " * 80_000 + own[0]), (4, "x " * 80_000 + own[1])]
    got = {r.doc_id: r.class_id for r in near_dedup.classify(table(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3}


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 260)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    got = {r.id: r.comp for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in {v for e in edges for v in e}}


HISTOGRAMS = [{}, {5: 1}, {1024: 7}, {1: 3000}, {700: 10, 324: 10}, {512: 9, 1024: 2, 3: 50}, Counter(int(x) for x in np.random.default_rng(0).integers(1, 1025, 6000)), Counter(int(x) for x in np.clip(np.random.default_rng(1).lognormal(5.5, 1, 20000), 1, 1024))]


@pytest.mark.parametrize("histogram", HISTOGRAMS)
def test_plan_uses_each_piece_once(histogram):
    plan, bound = packing.solve(dict(histogram))
    used = Counter()
    for config, times in plan:
        assert sum(config) <= 1024 and times > 0
        for n in config:
            used[n] += times
    assert used == Counter({n: c for n, c in histogram.items() if c})
    n = sum(t for _, t in plan)
    assert bound - 1e-6 <= n <= sum(packing._best_fit(dict(histogram), 1024).values())
    assert bound >= sum(k * v for k, v in histogram.items()) / 1024 - 1e-6


def test_program_beats_best_fit_where_pieces_combine():
    histogram = Counter(np.random.default_rng(0).integers(200, 401, 20_000).tolist())
    plan, bound = packing.solve(dict(histogram))
    n = sum(t for _, t in plan)
    assert n <= 1.003 * bound and n < 0.97 * sum(packing._best_fit(dict(histogram), 1024).values())


def test_dual_is_more_than_volume_where_pieces_do_not_combine():
    histogram = Counter(np.random.default_rng(0).integers(350, 1001, 20_000).tolist())
    volume = sum(k * v for k, v in histogram.items()) / 1024
    assert packing.dual(histogram)[0] > 1.05 * volume


def test_knapsack_is_bounded_and_exact():
    import itertools

    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = np.array(sorted(rng.choice(np.arange(1, 30), 4, False)))
        most, prices, size = rng.integers(1, 4, 4), rng.random(4), int(rng.integers(10, 60))
        value, chosen = packing.Knapsack(lengths, most, size).best(prices)
        every = (c for c in itertools.product(*(range(m + 1) for m in most)) if np.dot(c, lengths) <= size)
        assert value == pytest.approx(max(np.dot(c, prices) for c in every))
        counts = np.bincount(np.array(chosen, int), minlength=4)
        assert (counts <= most).all() and counts @ lengths <= size and counts @ prices == pytest.approx(value)


def test_packing_is_gapless(spark, odd, tokenizer):
    rows, df = odd
    rows = rows + [(100 + k, "lorem ipsum dolor " * (37 * k % 600)) for k in range(60)]
    got = packing.pack(table(spark, rows), PATH).collect()
    want = Counter()
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 1024
        cuts = [0, *([first] if first else [])]
        while cuts[-1] < len(ids):
            cuts.append(cuts[-1] + 1024)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(table(spark, []), PATH).count() == 0


def test_chat_round_trip_and_digests(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a<|im_end|>\n<\\|im_end|>"), (1, None, None, None), (2, 0, "assistant", "<\\\\/s> \\ [\\INST]"), (2, 0, "assi\nstant\\n", "x"), (None, 3, "assistant", "é🎉"), (2, 0, "assistant", "<\\\\/s> \\ [\\INST]")]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, label string, piece int")
    turns = chat.turns_from_table(df)
    records = spark.createDataFrame([(-7, f'{{"messages": [{{"role": "user", "content": "{said}"}}, {{"role": "assistant", "content": "{said}"}}], "meta": {{"x": 1}}}}')], "id long, record string")
    pieces = chat.format_turns(turns.unionByName(chat.turns_from_json(records, "id", "record")))
    out = {r.conv_id: r for r in chat.read_back(pieces).collect()}
    formatted = defaultdict(list)
    for r in pieces.collect():
        role, text = chat.parse_piece(r.piece)
        body = r.piece[len(chat.OPEN) : -len(chat.CLOSE)]
        assert not any(c in body for c in chat.CONTROL)
        formatted[r.conv_id].append((r.turn is not None, r.turn, r.piece, role, text))
    for conv, own in formatted.items():
        own.sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        assert out[conv].n_turns == len(own)
        assert out[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in own).encode()).hexdigest()
        loss = "".join(t for *_, r, t in own if r == "assistant")
        assert (out[conv].loss_chars, out[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert out[conv].formatted_chars == sum(len(p) for _, _, p, _, _ in own)
    read = Counter((r, t) for own in formatted.values() for *_, r, t in own)
    assert read == Counter((r or "", t or "") for _, _, r, t in rows) + Counter([("user", said), ("assistant", said)])
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


def test_layouts_are_chosen_by_fingerprint():
    got = [chat.record_turns(r) for r in ({"prompt": "p", "completion": "c"}, {"instruction": "i", "input": "", "output": "o"}, {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": None}], "id": 3}, {"other": 1})]
    assert got[0] == ("completion", [("user", "p"), ("assistant", "c")])
    assert got[1] == ("instruction_input", [("user", "i"), ("assistant", "o")])
    assert got[2] == ("speakers", [("user", "h"), ("assistant", "")])
    assert got[3][0].startswith("unknown:") and got[3][1] == [(None, None)]
    assert len(chat.REGISTRY) == len(chat.LAYOUTS)


@pytest.mark.parametrize("extra", ["system", "prompt", "content", "output", "position", "input", "instruction", "response", "completion", "messages", "conversations", "conversation_id", "label"])
def test_extra_columns_do_not_change_the_layout(spark, extra):
    df = spark.createDataFrame([(1, 0, "user", "a", "b")], f"conv_id long, turn long, role string, text string, {extra} string")
    assert [tuple(r) for r in chat.turns_from_table(df).collect()] == [(1, 0, "user", "a", "turn_rows")]


def test_odd_records_keep_their_text():
    cases = [
        ({"messages": [{"role": "user", "content": "a"}], "system": "s", "id": {"prompt": 1}}, "system_messages", [("system", "s"), ("user", "a")]),
        ({"messages": [{"role": "user", "content": "a"}], "system": None}, "system_messages", [("user", "a")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "p"}, "q"]}, "loose", None, 5]}, "messages", [("user", "pq"), ("", "loose"), ("", ""), ("", "5")]),
        ({"prompt": 3, "completion": {"a": [1]}}, "completion", [("user", "3"), ("assistant", '{"a": [1]}')]),
        ({"prompt": "p", "response": "r", "completion": "c"}, "completion", [("user", "p"), ("assistant", "c")]),
        ({"conversations": [{"from": "human", "value": "\ud800é"}]}, "speakers", [("user", "?é")]),
        ({"conversations": [{"from": 7, "value": True}]}, "speakers", [("7", "true")]),
    ]
    for record, name, turns in cases:
        assert chat.record_turns(record) == (name, turns)
    for record in (None, 5, "x", [], [1, {"prompt": "p"}], {}, {"messages": []}, {"messages": {"role": "user", "content": "x"}}, {"messages[].role": 1, "messages[].content": 2}):
        name, turns = chat.record_turns(record)
        assert name.startswith("unknown:") and turns == [(None, None)]


def test_records_of_every_layout_as_a_table(spark):
    """The conversations, written as records of each layout and read back, give the turns of the table."""
    import json

    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect()
    by = defaultdict(list)
    for r in turns:
        by[r.conv_id].append((r.role, r.text or ""))
    records = [
        ("messages", lambda t: {"messages": [{"role": a, "content": b, "n": 1} for a, b in t]}, lambda t: t),
        ("speakers", lambda t: {"conversations": [{"from": {"user": "human", "assistant": "gpt"}.get(a, a), "value": b} for a, b in t]}, lambda t: t),
        ("completion", lambda t: {"prompt": t[0][1], "completion": t[-1][1]}, lambda t: [("user", t[0][1]), ("assistant", t[-1][1])]),
        ("instruction_input", lambda t: {"instruction": t[0][1], "input": "", "output": t[-1][1]}, lambda t: [("user", t[0][1]), ("assistant", t[-1][1])]),
        ("system_prompt", lambda t: {"system": "s", "prompt": t[0][1], "response": t[-1][1]}, lambda t: [("system", "s"), ("user", t[0][1]), ("assistant", t[-1][1])]),
    ]
    for name, write, want in records:
        df = spark.createDataFrame([(i, json.dumps(write(t))) for i, t in by.items()] + [(-1, "{"), (-2, "[" * 100_000)], "id long, record string")
        got = defaultdict(list)
        for r in chat.turns_from_json(df, "id", "record").orderBy("conv_id", "turn").collect():
            got[r.conv_id].append((r.role, r.text))
            assert (r.layout == name) == (r.conv_id >= 0)
        assert {i: got[i] for i in by} == {i: want(t) for i, t in by.items()}


def test_escape_is_reversible(spark):
    rng = random.Random(8)
    parts = [*chat.CONTROL, "\\", "<", "[", "|im_end|>", "/s>", "INST]", "a"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.collect():
        assert chat.unescape(r.e) == r.t and not any(c in r.e for c in chat.CONTROL)


def test_word_hashes_follow_the_words():
    rng, known = random.Random(9), {}
    texts = [*(t or "" for t in ODD), *(" ".join(rng.choice(["the", "é", "a_b", "日本", "“x”", "B-c", "7"]) for _ in range(40)) for _ in range(50))]
    for t in texts:
        words, hashes = words_of(t), near_dedup.word_hashes(t).tolist()
        assert len(words) == len(hashes)
        assert all(known.setdefault(w, h) == h for w, h in zip(words, hashes))
    assert len(set(known.values())) == len(known)
    long = "alfa beta gama " * 80_000
    assert near_dedup.word_hashes(long).tolist()[:6] == near_dedup.word_hashes("alfa beta gama " * 2).tolist() and len(near_dedup.word_hashes(long)) == 240_000
