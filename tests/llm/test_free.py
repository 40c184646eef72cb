"""WARC, packing, language, neighbours, mixing and n-gram join against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from specloom.llm import families, language, mixing, neighbours, ngram_join, packing, queries, shared, warc

# ---- WARC ----


def archive(spark, rows, ddl="page_id long, url string, html string"):
    path = shared.shared_dir(spark)
    warc.write_warc(warc.page_records(spark.createDataFrame(rows, ddl)), path)
    return path


def test_warc_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://a/3\r\nX: y", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (2, "again", big)]
    path = archive(spark, rows)
    got = warc.read_warc(spark, path).where("record_type != 'warcinfo'").collect()
    assert len(got) == len(rows)
    kinds = sorted((r.record_id, r.record_type, r.refers_to, r.payload_length, None if r.payload is None else bytes(r.payload)) for r in got)
    page = lambda i: f"<urn:x-page:{i}>"
    body = big.encode()
    assert kinds == sorted([(page(""), "revisit", page(2), 1200, None), (page(1), "revisit", page(2), 1200, None), (page(2), "response", None, 1200, body),
                            (page(2), "response", None, 1200, body), (page(3), "response", None, 5, b"small"), (page(4), "response", None, 5, b"small"),
                            (page(5), "response", None, 0, b"")], key=lambda r: (r[0], r[1]))
    assert {r.target_uri for r in got} >= {"http://a/3  X: y", None}


def test_warc_pushes_header_predicates(spark):
    path = archive(spark, [(i, f"http://h/{i}", "x" * 2000) for i in range(20)])
    df = warc.read_warc(spark, path).where("record_type = 'response' AND payload_length > 10")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.replace("BatchScan", "") or "record_type" not in plan.split("BatchScan")[0]
    assert [r.record_id for r in df.collect()] == ["<urn:x-page:19>"]
    assert warc.read_warc(spark, path, payload=False).where("payload IS NOT NULL").count() == 0
    assert warc.read_warc(spark, path).where("record_type = 'revisit' AND target_uri IN ('http://h/3', 'z')").count() == 1


def test_warc_reads_plain_and_foreign_archives(spark, tmp_path):
    import gzip
    one = warc.record({"WARC-Type": "response", "WARC-Record-ID": "<a>", "Content-Type": "application/http"}, b"HTTP/1.1 200 OK\r\n\r\nbody\r\n\r\nmore")
    two = warc.record({"WARC-Type": "resource", "WARC-Record-ID": "<b>"}, b"raw" * 50000)
    (tmp_path / "x.warc").write_bytes(one + two)
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r.record_id, bytes(r.payload)) for r in got) == sorted([("<a>", b"body\r\n\r\nmore"), ("<b>", b"raw" * 50000)] * 2)


def test_warc_skips_members_unread():
    import io
    data = b"".join(warc.member(warc.record({"WARC-Type": k, "WARC-Record-ID": k}, random.Random(1).randbytes(200_000))) for k in ("metadata", "response"))
    broken = bytearray(data)
    broken[5000:6000] = bytes(1000)  # inside the first record's payload
    found = list(warc._members(io.BufferedReader(io.BytesIO(bytes(broken))), 0, len(broken), lambda h: h["record_type"] == "response", True))
    assert [f["record_id"] for f, _ in found] == ["response"] and len(found[0][1]) == 200_000


def test_warc_without_pages(spark):
    assert warc.read_warc(spark, archive(spark, [])).count() == 0


# ---- packing ----

def test_column_generation_reaches_the_bound():
    rng = np.random.default_rng(3)
    demand = np.bincount(rng.integers(1, 64, 5000) - 1, minlength=64)
    bound = (demand * np.arange(1, 65)).sum() / 64
    found = packing.whole_patterns(demand, 64)
    assert (sum(c * p for p, c in found) == demand).all()
    assert all((p * np.arange(1, 65)).sum() <= 64 for p, _ in found)
    assert sum(c for _, c in found) <= math.ceil(bound * 1.01) + 1
    assert packing.whole_patterns(np.zeros(8, int), 8) == []
    assert sum(c for _, c in packing.whole_patterns(np.array([0, 0, 0, 0, 3, 0, 0, 0]), 8)) == 3


MAX_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
TEXTS = ["", None, "a b", "a  b", " lead", "trail ", "x\ny z", "x \ny", "x\n y", "it's 12 o'clock, <|endoftext|>!", "tab\tin it", "nbsp  x", "日本 語", "  ", "word, word's don't. x² a²! naïve… (paren) a-b_c'", "end ².", "é" * 3]


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(queries.tokenizer_path())
    texts = [t or "" for t in TEXTS]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    encode = packing.TokenBytes(queries.tokenizer_path())
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == want
    assert [encode([t]) == [np.array(w, "<u4").tobytes()] for t, w in zip(texts, want)] == [True] * len(want)


def test_letters_are_given_to_the_tokenizer_once(monkeypatch):
    from tokenizers import Tokenizer
    given, encode = [], packing.TokenBytes.encode
    monkeypatch.setattr(packing.TokenBytes, "encode", lambda self, texts: given.extend(texts) or encode(self, texts))
    monkeypatch.setattr(packing, "RUN_CHARS", 50)
    texts = [f"start liebe{rest} and\nliebe{rest} liebe.\nanly{i}" for i, rest in enumerate([".", ",", "12", "'s", "-liebesx", "!?", ".\r\nzz", "²"])]
    plain = Tokenizer.from_file(queries.tokenizer_path())
    coder = packing.TokenBytes(queries.tokenizer_path())
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [coder([t])[0] for t in texts] == want
    whole = " ".join(given)
    assert len(re.findall("liebe(?!s)", whole)) <= 2 and whole.count("anly") == 1


def test_ids_stay_right_when_words_are_forgotten(monkeypatch):
    from tokenizers import Tokenizer
    monkeypatch.setattr(packing, "REMEMBERED", 8)
    plain = Tokenizer.from_file(queries.tokenizer_path())
    coder = packing.TokenBytes(queries.tokenizer_path())
    texts = [" ".join(["the"] + [f"w{chr(97 + (i * k) % 26)}.\n{k}x" for k in range(9)] + ["same\n\nhere", "a\u2003\nb", "c\n"][:i % 4]) for i in range(40)]
    assert [coder([t])[0] for t in texts] == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert coder([]) == [] and coder([None]) == [b""]


def test_texts_reach_the_workers_in_small_batches(docs, monkeypatch):
    sizes = []
    monkeypatch.setattr(packing, "BATCH_BYTES", 3000)
    monkeypatch.setattr(packing, "stored", lambda df: sizes.append(df.sparkSession.conf.get(MAX_BATCH)) or shared.stored(df))
    table = docs([(i, "word " * 100) for i in range(50)])
    before = table.sparkSession.conf.get(MAX_BATCH)
    assert packing.pack(table, queries.tokenizer_path()).count() == 50
    assert sizes[0] == "3000" and table.sparkSession.conf.get(MAX_BATCH) == before


def check_packing(rows, capacity=2048):
    seq, doc = defaultdict(list), defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append(r)
        doc[r.doc_id].append(r)
    total = pad = 0
    for s in seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= capacity
        total, pad = total + at, pad + (0 if at & (at - 1) == 0 else capacity - at)
    return doc, total, pad


def test_packing_covers_every_token_once(spark, sf):
    doc, total, pad = check_packing(queries.QUERIES["op5_sequence_packing"](spark, sf).collect())
    encode = packing.TokenBytes(queries.tokenizer_path())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(doc) == set(texts)
    for k, pieces in doc.items():
        ids, at = encode([texts[k] or ""])[0] + np.array([1], "<u4").tobytes(), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[4 * at:4 * (at + r.length)]) and r.doc_tokens == len(ids) // 4
            at += r.length
        assert at == len(ids) // 4
    assert pad < 0.03 * (total + pad)


def test_packing_of_odd_tables(docs):
    rows = packing.pack(docs([(1, None), (1, None), (None, "x"), (2, "y " * 5000)]), queries.tokenizer_path(), with_ids=True).collect()
    doc, total, _ = check_packing(rows)
    assert len(doc[1]) == 2 and len(doc[None]) == 1 and sum(len(r.ids) for r in rows) == 4 * total
    assert packing.pack(docs([]), queries.tokenizer_path()).collect() == []


# ---- language ----

def test_language_on_held_out_documents(spark, sf):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in queries.QUERIES["op6_language_id"](spark, sf).collect() if r.held_out]
    assert rows and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(docs):
    table = docs([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "12 34 !", "de"), (5, "", None), (6, "THE DOG", None),
                  (6, "THE DOG", None), (None, "und die", None)]).withColumn("lang_pred", F.lit("clash"))
    model = language.fit(table, F.col("doc_id") < 3)
    got = sorted((str(r.doc_id), r.lang_pred, r.score > 0) for r in language.predict(table, model, ["doc_id"]).collect())
    assert got == [("1", "en", True), ("2", "de", True), ("3", "und", False), ("4", "und", False), ("5", "und", False), ("6", "en", True), ("6", "en", True), ("None", "de", True)]
    assert {r.lang_pred for r in language.predict(table, {}, ["doc_id", "lang_pred"]).collect()} == {"und"}
    assert language.predict(table.limit(0), model, table.columns).collect() == [] and language.fit(table.limit(0), F.lit(True)) == {}


def test_bundles_do_not_depend_on_batches():
    texts = ["one two", "drei vier", "", "é!"]
    a, _ = language.Encoder(256, 1).bundle(texts)
    small = language.Encoder(256, 1, limit=3)
    assert all((small.bundle([t])[0][0] == v).all() for t, v in zip(texts, a))


# ---- neighbours ----

def brute(ids, vectors, queries_, k=5):
    out = []
    for i in sorted(queries_):
        q = vectors[ids.index(i)]
        scores = sorted((-float((v * q).sum() / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum()))), c) for c, v in zip(ids, vectors) if c != i)
        out += [(i, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("d,n", [(8, 300), (1500, 60), (3, 4)])
def test_neighbours_equal_brute_force(spark, d, n, monkeypatch):
    monkeypatch.setattr(neighbours, "SLICE", 32)
    rng = np.random.default_rng(d)
    v = rng.normal(size=(n, d)).astype(np.float32)
    v[n // 2:n // 2 + n // 4] = v[0]  # many ties
    v[1] *= 1e6
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, neighbours.nearest(rows, F.col("vec_id") % 3 == 0).collect()))
    want = brute(list(range(n)), v.astype(float), range(0, n, 3))
    assert [x[:3] for x in got] == [x[:3] for x in want] and max(abs(a[3] - b[3]) for a, b in zip(got, want)) < 1e-12


def test_neighbours_in_several_blocks(spark, sf, monkeypatch):
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 50)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 3)
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in table.collect())
    want = brute([i for i, _ in rows], [np.array(v, float) for _, v in rows], [i for i, _ in rows if i % 50 == 0])
    got = sorted(map(tuple, neighbours.nearest(table, F.col("vec_id") % 50 == 0).collect()))
    assert [x[:3] for x in got] == [x[:3] for x in want]


def test_unusable_vectors_take_no_part(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 1.0]), (7, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (6, [1.0, 1.0]), (8, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = [tuple(r) for r in neighbours.nearest(table, F.lit(True)).collect()]
    assert sorted(x[:3] for x in got) == [(0, 1, 6), (0, 2, 6), (6, 1, 0)]
    assert neighbours.nearest(table.limit(0), F.lit(True)).collect() == []


# ---- mixing ----

def test_water_filling():
    assert mixing.water_fill([100, 100, 100], [1, 1, 1], 1.5, 2) == [150, 150, 150]
    assert mixing.water_fill([10, 1000], [3, 1], 1.5, 2) == [20, 1495]
    assert mixing.water_fill([10, 10], [1, 1], 5, 2) == [20, 20]
    assert mixing.water_fill([], [], 1.5, 2) == [] and mixing.water_fill([0, 0], [1, 2], 1.5, 2) == [0, 0]


def test_mix_meets_targets_and_repeats(docs):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), None, rng.choice(["a", "b", "c", None])) for i in range(400)] + [(1, None, None, "a"), (None, "x y", None, "b"), (7, "same", None, "b"), (7, "same", None, "b")]
    table = docs(rows).withColumn("taken", F.lit("clash"))
    got = mixing.mix(table).collect()
    again = mixing.mix(table.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.text or "", r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.size == len((r.text or "").split())
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    out = mixing.mixed_rows(table).collect()
    assert sum(len((r.text or "").split()) for r in out) == sum(taken.values())
    assert mixing.mix(table.limit(0)).collect() == [] and mixing.mixed_rows(table.limit(0)).collect() == []


# ---- n-gram join ----

def shingles(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(a & b)
            if a and b and 100 * common >= 75 * (len(a) + len(b) - common):
                parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return [(k, len(s), low.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))]


def edited(rng, words, share):
    out = list(words)
    for i in range(len(out)):
        if rng.random() < share:
            out[i] = f"e{rng.randint(0, 10**6)}"
    return out


def near_rows(seed, n=150):
    """Texts with copies at every distance from the threshold, chains of them, and a passage many share."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    while len(rows) < n:
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([1, 3, 5, 30, 80, 200]))]
        if rng.random() < 0.3:
            base[len(base) // 2:len(base) // 2] = passage
        for _ in range(rng.randint(1, 6)):
            rows.append((len(rows), " ".join(base)))
            base = edited(rng, base, rng.choice([0, 0.01, 0.03, 0.05, 0.06]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(docs, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "TOKEN_ROWS", 500_000 if seed == 1 else 3)  # many tiles
    monkeypatch.setattr(families, "ELEMENTS", 400_000 if seed == 1 else 100)  # large families: centers, then blocks that meet
    rows = near_rows(seed) + [(900, None), (901, ""), (902, "a B c d e f"), (903, "A b C d e F"), (904, " a\tb\x0bc  d\ne f "), (905, "a b"), (906, "A B"), (907, "é É")]
    got = sorted(tuple(r) for r in ngram_join.join(docs(rows)).collect())
    assert got == sorted(components(rows))


def test_join_of_odd_tables(docs):
    rows = [(5, "x y z u v w"), (5, "other text of more than five words"), (3, "x y z u v w"), (None, "x y z u v w"), (None, "lone words"), (None, None), (3, "x y z u v w")]
    table = docs(rows).withColumn("node", F.lit("clash"))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted((tuple(r) for r in ngram_join.join(table).collect()), key=key)
    assert got == sorted([(5, 2, 3), (5, 3, 5), (3, 2, 3), (None, 2, 3), (None, 1, None), (None, 0, None), (3, 2, 3)], key=key)
    kept = sorted((tuple(r)[:2] for r in ngram_join.deduplicated(table).collect()), key=lambda r: key((r[0],)))
    assert sorted(t or "" for _, t in kept) == ["", "lone words", "other text of more than five words", "x y z u v w"]
    assert ngram_join.join(table.limit(0)).collect() == [] and ngram_join.deduplicated(table.limit(0)).collect() == []


def test_a_group_of_near_copies_is_not_paired_off(spark, docs):
    """Rows of candidates follow the number of copies, not its square, and no relation of pairs is in the plan."""
    counts = {}
    for copies in (300, 1500, 3000):
        rng = random.Random(9)
        base = [f"w{i}" for i in range(120)]
        rows = [(i, " ".join(edited(rng, base, 0.02))) for i in range(copies)]
        found, sketch = ngram_join.profiles(docs(rows))
        probes = ngram_join._probes(docs(rows), sketch, 75, "text")
        counts[copies] = (probes.count(), ngram_join._tiles_of(probes, 75).count(), ngram_join._connections(probes, found, 75).count())
        if copies == 300:
            assert sorted(tuple(r) for r in ngram_join.join(docs(rows)).collect()) == sorted(components(rows))
    for k in (0, 1, 2):
        assert counts[3000][k] <= 2.5 * counts[1500][k]


def test_bitmaps_bound_the_overlap():
    rng = random.Random(4)
    shingle = ngram_join.Shingler()
    for _ in range(200):
        a = [f"w{i}" for i in range(rng.randint(5, 200))]
        x, y = shingle(" ".join(a)), shingle(" ".join(edited(rng, a, 0.03)))
        real = families.reaches(len(np.intersect1d(x, y)), len(x), len(y), 75)
        assert not real or ngram_join.may_reach(len(x), ngram_join.bitmap_of(x), len(y), ngram_join.bitmap_of(y), 75)


# ---- pipeline ----

def test_pipeline_stage_by_stage(spark, sf):
    import corpus_pipeline as pipeline
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = shared.stored(stage(spark, docs, sf))
        rows = docs.collect()
        assert docs.columns == columns, name
        if name == "language_id":
            assert {r.doc_id for r in rows} == {r.doc_id for r in before if r.text and any(c.isalpha() for c in r.text)}
        if name == "ngram_join":
            groups = components([(r.doc_id, r.text) for r in before])
            assert sorted(r.doc_id for r in rows) == sorted({g for _, _, g in groups})
        if name == "secret_scan":
            from .test_native import base_spans
            assert len(rows) == len(before) and not any(base_spans(r.text) for r in rows)
            assert all(r.text == kept[r.doc_id] for r in rows if "[SECRET]" not in r.text)
        if name == "source_mix":
            assert {r.doc_id for r in rows} <= {r.doc_id for r in before}
            words = sum(len(r.text.split()) for r in rows)
            assert words <= 2 * sum(len(r.text.split()) for r in before)
    packed = pipeline.STAGES[-1][1](spark, docs, sf)
    check_packing(packed.collect())
    assert packed.agg(F.sum("length")).first()[0] > 0 and hashlib
