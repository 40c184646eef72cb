"""Vector codes, spelling variants and near-duplicate removal against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from specloom.llm import families, near_dedup, spelling, vector_codes

# ---- vector codes ----

VECTORS = "vec_id bigint, embedding array<double>, label int"


def plain_codes(rows, rounds=4):
    """One part after the other, in whole numbers."""
    ok = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(ok, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(order[0][1]) if order else 0
    if d % 4:
        return [], ""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in ok if len(v) == d]
    order = [r for r in order if len(r[1]) == d]
    w = d // 4
    cut = lambda v, p: v[p * w:(p + 1) * w]
    books = [[cut([math.floor(1024 * x) for x in v], p) for _, v, _ in order[:256]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda part, book: min(range(len(book)), key=lambda k: (far(part, book[k]), k))
    for _ in range(rounds):
        for p in range(4):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[best(cut(v, p), books[p])].append(cut(v, p))
            for k, members in groups.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    out, total = [], Counter()
    for i, v, lab in kept:
        at = [best(cut(v, p), books[p]) for p in range(4)]
        error = sum(far(cut(v, p), books[p][k]) for p, k in enumerate(at))
        total[lab] += error
        out.append((i, lab, "".join(f"{k:02x}" for k in at), error))
    return [(*r, total[r[1]]) for r in out], hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def codes_of(table, **options):
    coded, books = vector_codes.codes(table, **options)
    return sorted(map(tuple, coded.select("id", "label", "code", "error", "label_error").collect()), key=str), vector_codes.digest(books)


@pytest.mark.parametrize("members", [128, 1])
def test_codes_equal_plain_python(spark, members, monkeypatch):
    monkeypatch.setattr(vector_codes.lloyd, "__defaults__", (vector_codes.ROUNDS, members))
    rng = random.Random(members)
    rows = [(i, [rng.choice([rng.uniform(-2, 2), 0.5, -0.25, -1e-200]) for _ in range(8)], rng.choice([0, 1, None])) for i in range(300)]
    rows += [(7, [0.5] * 8, 1)] * 40 + [(None, [0.25] * 8, None), (400, None, 1), (401, [float("nan")] + [1.0] * 7, 1), (402, [1.0, None] + [1.0] * 6, 1),
                                       (403, [float("inf")] * 8, 1), (404, [], 1), (405, [1.0] * 4, 1), (-3, [-0.1] * 8, None), (-3, [-0.2] * 8, None)]
    rng.shuffle(rows)
    want, digest = plain_codes(rows)
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    clash = table.selectExpr("*", "1 AS entry", "'x' AS salt", "2 AS position", "3 AS n", "array(1) AS sums", "'i' AS id", "0 AS v", "1 AS code")
    assert codes_of(clash) == (sorted(want, key=str), digest)


def test_codes_of_large_numbers_and_few_vectors(spark):
    rows = [(1, [1e30, -1e30, 3.0, 4.0], 1), (2, [1e9, 2e9, -3e9, 4e9], 1), (3, [0.0] * 4, 2)]
    want, digest = plain_codes(rows)
    assert codes_of(spark.createDataFrame(rows, VECTORS)) == (sorted(want, key=str), digest)
    # Three entries, three vectors: each its own entry, no error.
    assert {r[3] for r in want} == {0}
    assert codes_of(spark.createDataFrame([(1, [0.5] * 6, 1)], VECTORS))[0] == []
    assert codes_of(spark.createDataFrame([], VECTORS))[0] == []
    many = [(i, [1e20 * i, 0.0, 0.0, 1.0], 1) for i in range(300)]  # errors beyond a long
    got = vector_codes.codes(spark.createDataFrame(many, VECTORS))[0]
    want = {(r[0], r[2], r[3] if r[3] < 1 << 63 else None) for r in plain_codes(many)[0]}
    assert {(r.id, r.code, r.error) for r in got.collect()} == want and any(e is None for _, _, e in want)


def test_members_that_keep_their_entry_stay(spark):
    rows = spark.createDataFrame([(i, None, [float(i % 7)] * 8) for i in range(100)], "id bigint, label int, v array<double>")
    books = [[[int(1024 * k)] * 2 for k in range(7)] for _ in range(4)]
    salts = np.ones((4, 256), int)
    parts = vector_codes.first_parts(rows, books, salts)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    stay, move = (vector_codes._assigned(parts, books, salts, moved) for moved in (False, True))
    assert "Exchange" not in plan(stay) and stay.count() == 400 and move.count() == 0
    books[0][3] = [9999, 9999]
    stay, move = (vector_codes._assigned(parts, books, salts, moved) for moved in (False, True))
    assert move.count() == sum(i % 7 == 3 for i in range(100)) and stay.count() + move.count() == 400
    assert {r.position for r in move.collect()} == {0}


# ---- spelling variants ----

def plain_variants(rows, omit, occurrences=5):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    n = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % omit == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 6:
                n[w] += 1
    n = {w: c for w, c in n.items() if c >= occurrences}

    def edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    near = {w: [x for x in n if edit(w, x)] for w in n}
    form = {}
    for w in n:
        if near[w]:
            x = min(near[w], key=lambda x: (-n[x], x))
            if n[x] >= 5 * n[w]:
                form[w] = x

    def root(w):
        return root(form[w]) if w in form else w
    return {(w, n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root(w)) for w in n}


def word_rows(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcÀéÿ") for _ in range(rng.randint(6, 9))) for _ in range(40)]
    words += [w[:i] + rng.choice("abé") + w[i + rng.randint(0, 1):] for w in words for i in (0, len(w) // 2, len(w) - 1)]
    text = lambda k: " ".join(rng.choice(words).upper() if rng.random() < 0.1 else words[min(len(words) - 1, int(rng.expovariate(0.05)))] for _ in range(k))
    rows = [(i, text(rng.randint(0, 80))) for i in range(120)]
    long_ = "x" * 20_000
    return rows + [(None, text(50)), (200, None), (201, ""), (202, "×÷ 12 a-b_c"), (203, f"{long_} {long_}y " * 6), (3, rows[3][1]), (3, rows[3][1])]


@pytest.mark.parametrize("seed, omit, block", [(1, 3, 512), (2, 7, 2), (3, 199, 5)])
def test_variants_equal_plain_python(docs, seed, omit, block):
    rows = word_rows(seed)
    table = docs(rows).selectExpr("*", "'x' AS word", "1 AS n", "2 AS length", "true AS suffix", "'c' AS code", "0 AS id").repartition(3)
    got = spelling.variants(table, omit=omit, block=block)
    assert {tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()} == plain_variants(rows, omit)
    assert got.where("form != root").count() + got.where("form IS NULL").count() > 0


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(20)], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w20"}


def test_variants_of_nothing(docs):
    assert spelling.variants(docs([])).collect() == [] and spelling.variants(docs([(1, None), (2, "few words")])).collect() == []


def test_single_edits_by_matrix():
    words = ["abcdef", "abcdeg", "xbcdef", "abdef", "abcdeff", "abccdef", "bcdef", "abcdefgh"]
    for length in range(5, 9):
        a = [w for w in words if len(w) in (length, length - 1)]
        i, j = spelling.single_edits(a, a, length, False)
        got = {(a[x], a[y]) for x, y in zip(i, j)}
        want = {(x, y) for x in a for y in a if max(len(x), len(y)) == length and x != y and plain_edit(x, y)}
        assert got == want


def plain_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


# ---- near duplicates ----

def plain_groups(rows, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low_id = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low_id[find(i)] = min(low_id.get(find(i), doc), doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        name = low_id.get(find(i)) if sets[i] else doc
        out.append((doc, len(sets[i]), name, doc == name))
    return out


def copies(seed, groups=25, share=0.3):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(6, 150))]
        if rng.random() < share:
            base[len(base) // 2:len(base) // 2] = passage
        for _ in range(rng.randint(1, 8)):
            rows.append((len(rows), " ".join(base)))
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                k = rng.randrange(len(base))
                base[k:k + rng.randint(0, 1)] = [f"e{rng.randint(0, 99)}"]
    return rows


def by_null(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("seed, percent", [(1, 85), (2, 85), (3, 95)])
def test_near_duplicates_equal_brute_force(docs, seed, percent, monkeypatch):
    if seed == 2:  # large families and entries: centers, then blocks; slices that meet
        monkeypatch.setattr(families, "ELEMENTS", 100)
        monkeypatch.setattr(near_dedup.candidates, "__defaults__", (near_dedup.DISTANCE, 2))
    long_ = " ".join(f"t{i}" for i in range(30_000))
    rows = copies(seed) + [(900, None), (901, ""), (902, " \t "), (903, "a B c"), (904, "A b C"), (905, long_), (906, long_ + " end"), (None, "a b c"), (None, "lone words"),
                           (None, None), (0, "another text with the id of the first one"), (903, "a B c")]
    table = docs(rows).selectExpr("*", "'x' AS node", "1 AS n", "2 AS family", "'s' AS signature", "0 AS root").repartition(3)
    got = sorted(map(tuple, near_dedup.marked(table, percent).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=by_null)
    assert got == sorted(plain_groups(rows, percent), key=by_null)


def test_near_duplicates_of_nothing(docs):
    assert near_dedup.marked(docs([])).collect() == []
    assert [tuple(r) for r in near_dedup.marked(docs([(1, None)])).collect()] == [(1, 0, 1, True)]


def test_signatures_within_the_distance_share_an_entry():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, (1, near_dedup.PLACES)).astype(np.uint16)
        b = a.copy()
        b[0, rng.choice(near_dedup.PLACES, near_dedup.DISTANCE, replace=False)] += 1
        assert (near_dedup.entries(a) == near_dedup.entries(b)).any()


def test_distance_follows_similarity():
    rng = np.random.default_rng(6)
    sign, far = near_dedup.Signer(), []
    for _ in range(200):
        x = rng.integers(0, 1 << 64, 100, np.uint64)
        y = np.concatenate([x[:92], rng.integers(0, 1 << 64, 8, np.uint64)])  # 92 of 108 in common: 0.852
        far.append(int((sign(np.unique(x)) != sign(np.unique(y))).sum()))
    assert abs(np.mean(far) / near_dedup.PLACES - 16 / 108) < 0.02 and max(far) <= near_dedup.DISTANCE


def test_a_large_group_of_copies_makes_few_rows(docs):
    rng, counts = random.Random(8), {}
    base = [f"w{i}" for i in range(120)]
    for n in (600, 1200):
        rows = []
        for i in range(n):
            words = list(base)
            for _ in range(3):
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 99)}"
            rows.append((i, " ".join(words)))
        nodes = near_dedup.profiles(docs(rows)).select("node", "n", "signature").distinct()
        counts[n] = near_dedup.candidates(nodes, 85).count()
    assert counts[1200] <= 2.5 * counts[600]
    got = near_dedup.marked(docs(rows[:300])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted(plain_groups(rows[:300], 85))


def test_links_join_all_groups_of_a_tile():
    rng = random.Random(10)
    for trial in range(30):
        base = [rng.getrandbits(63) for _ in range(40)]
        sets = []
        for _ in range(25):
            base = [rng.getrandbits(63) if rng.random() < 0.06 else x for x in base]
            sets.append(np.array(sorted(base[:rng.randint(30, 40)]), np.uint64))
        sides = np.array([rng.randint(0, 1) for _ in sets]) if trial % 2 else np.zeros(len(sets), int)
        want = np.arange(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                c = len(np.intersect1d(sets[i], sets[j]))
                if families.reaches(c, len(sets[i]), len(sets[j]), 75) and (not sides.any() or sides[i] != sides[j]):
                    want[want == want[i]] = want[j]
        for bitmaps in (False, True):
            got = np.arange(len(sets))
            for x, y in families.links(sets, np.arange(len(sets)), sides, 75, bitmaps):
                assert got[x] != got[y]
                got[got == got[x]] = got[y]
            assert len(set(zip(want, got))) == len(set(want)) == len(set(got))




# ---- columns of any name, numbers of any size ----

def test_pipeline_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline as pipeline
    words = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(i, f"{words} number {i} password = abcdefghijklm{i}" if i % 2 else words, "en", f"s{i % 2}", 5) for i in range(8)] + [(8, None, None, None, None)]
    clash = ["score", "lang_pred", "hex", "assign", "access", "markov", "spans", "size", "target", "taken", "source_size", "__key", "__block", "__text", "__h", "__id", "__many", "__done",
             "__short", "__n", "__s", "__whole", "node", "row", "root", "family", "grams", "nid", "bitmap", "tile", "m", "token"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in clash])
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, None)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in clash), name
    assert pipeline.STAGES[-1][1](spark, docs, None).count() == 9


@pytest.mark.parametrize("scale", [1e-300, 1e-200, 1.0, 1e200, 1e300])
def test_nearest_vectors_of_any_size(spark, scale):
    from specloom.llm import neighbours
    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=6) * scale * 10.0 ** rng.integers(-3, 4) for i in range(60)}
    vectors[61] = np.full(6, 5e-324)
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in neighbours.nearest(table, table.vec_id % 20 == 0).collect()}
    unit = {i: (u := v / np.abs(v).max()) / np.sqrt((u * u).sum()) for i, v in vectors.items()}
    for query in (0, 20, 40):
        want = sorted(((-float(unit[query] @ unit[i]), i) for i in unit if i != query))[:5]
        for rank, (score, i) in enumerate(want, 1):
            assert got[query, rank][0] == i and abs(got[query, rank][1] + score) < 1e-12


def test_special_tokens_have_the_ids_of_the_tokenizer(docs):
    from tokenizers import Tokenizer
    from specloom.llm import packing, queries
    path = queries.tokenizer_path()
    texts = ["a <|endoftext|> b", "x<|endoftext|>y z", "<|endoftext|>", "two  <|endoftext|> blanks", "end <|endoftext|>", "don't stop, it's (fine)... ok\n\nnew\tline  two", "é è 日本 語 z", "a" * 5000 + " b", " lead", "trail ", ""]
    plain = Tokenizer.from_file(path)
    want = {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    got = {r.doc_id: r.doc_tokens for r in packing.cut(docs(list(enumerate(texts))), path).collect()}
    assert got == want
    coder = packing.TokenBytes(path)
    assert coder(texts * 2) == [np.array(plain.encode(t, add_special_tokens=False).ids, np.uint32).tobytes() for t in texts * 2]
