"""Mechanisms that keep configuration, names and signatures from growing into plans, drivers or single rows."""

import random
from difflib import SequenceMatcher, get_close_matches

import pytest
from pyspark.sql import functions as F

from specloom import fixed
from specloom.functions.lookup import filed, filing, held
from specloom.functions.text import let
from specloom.operators import extract as E, learn as L, nearby
from specloom.operators.classify import classify
from specloom.operators.normalize import normalize
from specloom.plans.taxonomy import Taxonomy
from specloom.sources import documents as D
from specloom.sources.split_csv import csv_records, read_csv


def plan(df):
    return df._jdf.queryExecution().optimizedPlan()


# ---- leaders ----

def plain_leaders(items):
    """Signatures (order, fields, words) that no earlier leader reaches, one after the other."""
    def score(a, b):
        share = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
        return 0.7 * share(a[0], b[0]) + 0.3 * share(a[1], b[1]) if len(a[0] | b[0]) >= 2 else share(a[1], b[1])
    leaders = []
    for o, f, w in sorted(items):
        if all(score((set(f), set(w)), (set(x), set(y))) < fixed.CLUSTER_THRESHOLD for _, x, y in leaders):
            leaders.append((o, f, w))
    return {o for o, _, _ in leaders}


def signature_table(spark, items):
    rows = [(o, (o, o, o), list(f), list(w)) for o, f, w in items]
    return spark.createDataFrame(rows, "_sig bigint, o struct<s:bigint,first:bigint,_sig:bigint>, fields array<string>, words array<string>")


@pytest.mark.parametrize("seed, heads", [(1, 2), (2, 1), (3, 50)])
def test_leaders_equal_one_by_one(spark, seed, heads):
    rng = random.Random(seed)
    pick = lambda names, most: tuple(sorted(rng.sample(names, rng.randint(0, most))))
    items = [(i, pick([f"f{k}" for k in range(8)], 4), pick([f"w{k}" for k in range(6)], 3)) for i in range(150)]
    got = {r["_sig"] for r in L.leaders(signature_table(spark, items), heads).collect()}
    assert got == plain_leaders(items)


def test_rounds_follow_chains_and_not_the_number_of_signatures(spark, monkeypatch):
    writes = []
    keep = L.durable
    monkeypatch.setattr(L, "durable", lambda df: writes.append(1) or keep(df))
    apart = [(i, (f"a{i}", f"b{i}"), ("common", f"w{i}")) for i in range(2000)]  # 2000 leaders
    alike = [(5000 + i, ("x", "y", "z", f"q{i}"), ("common",)) for i in range(2000)]  # one leader
    assert L.leaders(signature_table(spark, apart + alike)).count() == 2001
    assert len(writes) <= 3 * 3 + 1


# ---- labels ----

def plain_labels(rows):
    used, out = set(), {}
    for total, confidence, cluster, keywords, code, noun in sorted(rows, key=lambda r: (-r[0], -r[1], r[2])):
        name = f"{noun}s"
        if sum(r[5] == noun for r in rows) == 1:
            out[cluster] = name
            continue
        label = next((t for k in keywords if k.lower() not in name.lower() and (t := f"{name} ({k.title()})") not in used), f"{name} ({code[-4:]})")
        used.add(label)
        out[cluster] = label
    return out


PROPOSAL = "total int, confidence double, cluster bigint, keywords array<string>, code string, noun string"


def test_labels_equal_one_by_one(spark):
    rng = random.Random(4)
    rows = [(rng.randint(1, 3), rng.choice([0.5, 0.6]), i, rng.sample(["valve", "ball", "steel", "brass", "gate", "check"], rng.randint(0, 4)), f"99{i:06d}",
             rng.choice(["Valve", "Valve", "Fitting", f"Lone {i}"])) for i in range(120)]
    got = {r["cluster"]: r["name"] for r in L.disambiguate(spark.createDataFrame(rows, PROPOSAL)).collect()}
    assert got == plain_labels(rows)


def test_a_hundred_thousand_proposals_of_one_noun(spark):
    df = spark.range(100_000).selectExpr("5 AS total", "0.5D AS confidence", "id AS cluster", "array('valve', 'ball', concat('kind', id % 70000)) AS keywords",
                                         "concat('99', lpad(id, 6, '0')) AS code", "'Valve' AS noun")
    got = L.disambiguate(df)
    assert got.count() == 100_000
    names = got.where("name RLIKE 'Kind'").agg(F.count('*'), F.count_distinct('name')).first()
    assert names[0] == names[1] > 60_000
    assert got.where("name = 'Valves (Ball)'").collect()[0]["cluster"] == 0


# ---- classification ----

def many_categories(n):
    attribute = {"key": "bore_size", "label": "Bore Size", "type": "text", "unit": None, "group": "General", "values": [], "aliases": [], "range": None}
    return [{"code": f"99{i:06d}", "noun": f"Thing {i}", "keywords": [f"gadget{i}", f"o-ring no {i}", "é"], "mpn_patterns": [], "path": ["A", "B", f"Thing {i}"], "required": [], "cross_checks": [],
             "defaults": {}, "learned": True, "attributes": [dict(attribute, label=f"Span {i % 50}", key=f"span_{i % 50}")]} for i in range(n)]


def test_classification_by_index_of_many_categories(spark, product, product_df):
    rows = [product(1, name="A gadget4321 for home"), product(2, name="plain", description="an O-Ring no 77, black"), product(3, name="gadget43210"), product(4, name="x", category_hint="my gadget12b"),
            product(5, name="Ball valve brass", specs={"Bore": "25 mm"}), product(6), product(7, name="SPAN 7 wide gadget7")]
    few, many = (normalize(product_df(rows)).transform(lambda d: classify(d, Taxonomy(learned=many_categories(n)))) for n in (5, 5000))
    nodes = lambda df: len(plan(df).toString().split("\n"))
    assert nodes(few) == nodes(many)
    got = {r["id"]: r["category"] for r in many.select("id", "category").collect()}
    assert got[1]["code"] == "99004321" and got[1]["reasons"] == ["matched keyword 'gadget4321'"]
    assert got[2]["code"] == "99000077" and got[2]["score"] == 2.5
    assert got[3] is None and got[6] is None
    # 'gadget1' and 'gadget12' are in the hint as parts of words, 'gadget12b' is no keyword: equal scores, the first category wins.
    assert got[4]["code"] == "99000001" and [a["code"] for a in got[4]["alternatives"]] == ["99000012"]
    assert got[7]["code"] == "99000007" and got[7]["reasons"] == ["matched keyword 'gadget7'", "input mentions 'span 7'"]
    alone = classify(normalize(product_df(rows))).select("id", "category").where("id = 5").first()["category"]
    assert got[5]["code"] == alone["code"] and got[5]["score"] == alone["score"] and got[5]["reasons"] == alone["reasons"]


def test_lookup_tables(spark):
    entries = spark.createDataFrame([("a", 1), ("a", 2), ("é b", 3)], "run string, x int")
    with held(filing(entries)) as name:
        df = spark.createDataFrame([("a",), ("b",), ("é b",)], "k string").withColumn("found", F.expr(let("ix", name, f"transform({filed('slots', 'k')}, p -> p.x)")))
    assert {r["k"]: r["found"] for r in df.collect()} == {"a": [1, 2], "b": [], "é b": [3]}
    assert "lookup_" not in " ".join(t.name for t in spark.catalog.listTables())
    with held(filing(entries.limit(0))) as name:
        assert spark.range(1).select(F.expr(let("ix", name, filed("slots", "'a'")))).first()[0] == []


# ---- similarity of distinct strings ----

def strings(seed, n, letters="abcde fg1é"):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))).strip() or "a" for _ in range(n)]
    return sorted({*base, *(b[:i] + rng.choice(letters) + b[i + 1:] for b in base for i in range(0, len(b), 4))})


@pytest.mark.parametrize("cutoff", [0.6, 0.69, 0.86])
def test_no_similar_pair_is_missed(spark, cutoff):
    a, b = strings(1, 40), strings(2, 40)
    table = lambda x, c: spark.createDataFrame([(s,) for s in x], f"{c} string")
    pairs = nearby.similar_pairs(table(a, "probe"), table(b, "name"), [], cutoff)
    met = {(r["probe"], r["name"]): r["bound"] for r in pairs.collect()}
    every = {(x, y): SequenceMatcher(None, x, y).ratio() for x in a for y in b}
    assert {p for p, r in every.items() if r >= cutoff} <= set(met) and len(met) < len(every)
    assert all(bound >= every[p] - 1e-12 for p, bound in met.items())


def test_nearest_names_are_the_close_matches(spark):
    names, probes = strings(3, 60), strings(3, 90)
    table = spark.createDataFrame([("g", s) for s in probes], "grp string, probe string")
    got = nearby.nearest_names(table, spark.createDataFrame([("g", s) for s in names] + [("other", probes[0])], "grp string, name string"), ["grp"], fixed.SUGGEST_THRESHOLD)
    want = {p: next(iter(get_close_matches(p, names, 1, fixed.SUGGEST_THRESHOLD)), None) for p in probes}
    assert {r["probe"]: r["near"] for r in got.collect()} == want


def plain_key_score(key, names):
    words = lambda s: {t for t in s.split() if t not in fixed.KEY_STOP_WORDS}
    best = 0.0
    for name in filter(None, names):
        if name == key:
            return 1.0
        both, either = words(name) & words(key), words(name) | words(key)
        best = max(best, 0.55 + 0.4 * (len(both) / len(either)) if both else 0.0, SequenceMatcher(None, key, name).ratio() * 0.9)
    return best


def test_key_scores_equal_one_by_one(spark):
    taxonomy = Taxonomy()
    names = taxonomy.names_by_code
    slug = lambda s: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in s.lower()).split())
    rng = random.Random(5)
    keys = sorted({slug(n) for own in names.values() for a in own for n in a if rng.random() < 0.3}
                  | {"bore dia", "size of bore", "thread sizes", "matrial", "voltage rating", "the", "weight kg", "qq", "pressure max working", "1"})
    got = {(r["key"], r["code"], r["j"]): r["s"] for r in nearby.key_scores(spark.createDataFrame([(k,) for k in keys], "key string"), nearby.attribute_names(spark, names)).collect()}
    want = {(k, code, j): s for k in keys for code, own in names.items() for j, a in enumerate(own) if (s := plain_key_score(k, [slug(n) for n in a])) >= fixed.MAP_THRESHOLD}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_keys_are_mapped_alike_by_lookup_and_row_by_row(spark, product, product_df, monkeypatch):
    keys = ["Bore", "Bore Dia.", "Outside Diameter", "OD", "Seal type", "Materials", "Cage", "wieght", "", "Pressure Rating", "Body Matrial"]
    rows = [product(i, name=["Deep groove ball bearing", "Ball valve", "nothing known"][i % 3], specs={k: str(n) for n, k in enumerate(random.Random(i).sample(keys, 6))}) for i in range(30)]
    records = classify(normalize(product_df(rows)))

    def mapped():
        df = E.map_specs(E.attach_schema(records, spark, Taxonomy()), Taxonomy())
        return df, [(r["id"], [(m["i"], m["j"], round(m["s"], 12)) for m in r["mapped"]], r["unmapped"]) for r in df.orderBy("id").select("id", "mapped", "unmapped").collect()]
    by_lookup, one = mapped()
    monkeypatch.setattr(E, "LOOKUP_KEYS", 3)
    by_row, two = mapped()
    assert one == two and any(m for _, m, _ in one)
    assert "ArrowEvalPython" not in plan(by_lookup).toString() and "ArrowEvalPython" in plan(by_row).toString()


# ---- documents ----

def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_documents_are_read_once(spark, tmp_path):
    text = "\n".join(["Title  here", "Bore Diameter ..... 25 mm", "Width: 12 mm", "Seal type: 2RS"] + [f"Part number {i}   value{i}   " for i in range(3)])
    spark.createDataFrame([(d, p, text if d else "") for d in range(3) for p in (1, 2)], "doc int, page int, text string").write.parquet(str(tmp_path / "pages"))
    cells = [(d, 2, 0, r, c, t) for d in (0, 1) for r, row in enumerate([["Parameter", "Value", "Note"], ["Width", "14 mm", "x"], ["", "", ""], ["Finish", "black", ""]]) for c, t in enumerate(row)]
    spark.createDataFrame(cells, "doc int, page int, tbl int, row int, col int, text string").write.parquet(str(tmp_path / "cells"))
    pages, grid = spark.read.parquet(str(tmp_path / "pages")), spark.read.parquet(str(tmp_path / "cells"))
    for df, exchanges in ((D.document_specs(pages, grid), 3), (D.ingest_report(pages, grid), 4)):
        done = executed(df)
        assert done.count("FileScan") == 2 and done.count("Exchange hashpartitioning") <= exchanges and "Join" not in done
    got = {(r["doc"], r["key"]): (r["value"], r["locator"], r["strategy"]) for r in D.document_specs(pages, grid).collect()}
    assert got[1, "Width"] == ("12 mm", "page 1", "text:line-pairs") and got[0, "Width"] == ("14 mm", "page 2", "table:lines")
    assert got[1, "Finish"] == ("black", "page 2", "table:lines") and (2, "Finish") not in got
    report = {r["doc"]: r for r in D.ingest_report(pages, grid).collect()}
    assert report[0]["pages"] == 2 and report[0]["spec_pairs"] == 2 and report[0]["strategies"] == "table:lines"
    assert report[2]["text_chars"] == 2 * len(text) + 1 and report[2]["strategies"] == "text:line-pairs" and report[2]["note"] == ""


def test_columns_of_a_long_page(spark):
    text = "\n".join(f"Label {chr(97 + i % 26)}{'':{4}}value {i}" for i in range(3000)) + "\nsome longer prose  with a gap" + "\n\n"
    got = D.column_pairs(spark.createDataFrame([(1, 1, text)], "doc int, page int, text string"))
    assert got.count() == 3000
    assert D.column_pairs(spark.createDataFrame([(1, 1, ""), (2, 1, None), (3, 1, "a b  c d")], "doc int, page int, text string")).count() == 0


def test_brands_by_index_and_by_join(spark, monkeypatch):
    brands = spark.range(100_000).selectExpr("concat('maker', id, ' co.') AS probe", "concat('Maker ', id) AS canonical", "CAST(id AS INT) AS pos")
    pages = spark.createDataFrame([(1, 1, "A Maker77 Co. product, part no: X-1\nby maker77777 co.x"), (2, 1, "maker12"), (3, 1, None), (1, 2, "more of MAKER100 CO.s and maker99999 co.a")], "doc int, page int, text string")
    few, many = D.document_identity(pages, brands.limit(10)), D.document_identity(pages, brands)
    nodes = lambda df: len(plan(df).toString().split("\n"))
    assert nodes(few) == nodes(many)
    one = sorted(map(tuple, many.collect()), key=str)
    monkeypatch.setattr(D, "BRANDS_HELD", 10)
    assert sorted(map(tuple, D.document_identity(pages, brands).collect()), key=str) == one
    assert {r[0]: r[1] for r in one} == {1: "Maker 77777", 2: None, 3: None}


# ---- supplier files ----

def test_csv_with_line_breaks_is_read_in_ranges(spark, tmp_path):
    rng = random.Random(7)
    cells = ["plain", "a, b", 'say "hi"', "two\nlines", "x\n\n\ny", '"', "", "ends\n", "\nstarts", "é" * 40, "crlf\r\nin cell", 'q""q\n"z"']
    for name, eol in (("a.csv", "\n"), ("b.csv", "\r\n"), ("c.csv", "\n")):
        lines = ["id,Name,Free Text"]
        for i in range(400):
            row = [f"{name}{i}", rng.choice(cells), rng.choice(cells)]
            lines.append(",".join('"' + c.replace('"', '""') + '"' if i % 3 or any(x in c for x in '",\r\n') else c for c in row))
            if rng.random() < 0.05:
                lines.append("")
        (tmp_path / name).write_bytes((eol.join(lines) + (eol if name != "c.csv" else "")).encode())
    read = spark.read.csv(str(tmp_path), header=True, multiLine=True, escape='"')
    want = sorted((tuple(None if c is None else c.replace("\r\n", "\n") for c in r) for r in read.collect()), key=str)
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300", "4000", "134217728"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = read_csv(spark, str(tmp_path))
            tasks = csv_records(spark, str(tmp_path)).select("file", "start").distinct().count()
            assert sorted((tuple(r)[1:] for r in got.collect()), key=str) == want
            assert tasks > 100 if size == "300" else tasks >= 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


def test_csv_lines_are_numbered_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,Name\n1,"two\nlines"\n2,plain\n3,"x\n\ny"\n')
    records = csv_records(spark, str(tmp_path))
    assert "MapInArrow" not in plan(records).toString() and records.count() == 4


# ---- small files ----

@pytest.mark.parametrize("made", ["_html", "_pages", "_cells"])
def test_text_made_of_a_small_file_is_made_by_every_core(spark, tmp_path, made):
    from specloom.catalog import sources
    spark.range(1000).selectExpr("id AS p_partkey", "'n' AS p_name", "'t' AS p_type", "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    rows = getattr(sources, made)(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) >= spark.sparkContext.defaultParallelism
    assert max(r["count"] for r in rows) <= 2 * min(r["count"] for r in rows)


def test_records_of_a_small_file_are_made_by_every_core(spark, tmp_path):
    from specloom.catalog import records
    spark.sql("""SELECT id AS p_partkey, 'nut' AS p_name, 'B' AS p_brand, 'steel' AS p_type, CAST(id % 50 AS INT) AS p_size FROM range(40)""").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    text = executed(records._bed(spark, str(tmp_path)))
    assert "array_sort" in text and text.rindex("array_sort") < text.index("RoundRobinPartitioning")


def test_truth_of_a_small_file_is_not_broadcast(spark, tmp_path):
    from specloom.operators import measure
    spark.sql("SELECT id, CAST(id AS STRING) AS x FROM range(50)").write.parquet(f"{tmp_path}/truth")
    truth = spark.read.parquet(f"{tmp_path}/truth").selectExpr("id AS case_id", "explode(array('a', 'b')) AS key", "x AS true_val", "CAST(NULL AS DOUBLE) AS true_num", "'t' AS truth_source")
    predicted = spark.sql("SELECT id AS case_id, 'a' AS key, CAST(id + id % 2 AS STRING) AS val, CAST(NULL AS DOUBLE) AS num, 'parsed' AS prov FROM range(50)")
    found = measure.contradictions(measure.compare(truth, predicted))
    assert "BroadcastHashJoin" not in (text := executed(found)) and "SortMergeJoin" in text
    assert sorted(r.case_id for r in found.collect()) == list(range(1, 50, 2))


def test_splits_without_rows_do_not_count_as_work_for_every_core(spark):
    from specloom.functions.stage import spread
    cores = spark.sparkContext.defaultParallelism
    lean = spark.createDataFrame(spark.sparkContext.parallelize(range(cores), cores).flatMap(lambda i: [(j,) for j in range(400)] if i == 0 else []), "id int")
    assert lean.rdd.getNumPartitions() == cores
    assert {r["count"] for r in spread(lean).groupBy(F.spark_partition_id()).count().collect()} == {400 // cores}


def test_supplier_keys_are_read_without_classifying(spark, product, product_df, monkeypatch):
    seen, real = [], E._key_index
    def index(df, taxonomy):
        keys = df.select(F.explode("specs.key").alias("key")).distinct()
        seen.append(plan(keys).toString())
        return real(df, taxonomy)
    monkeypatch.setattr(E, "_key_index", index)
    records = classify(normalize(product_df([product(1, {"Bore": "25 mm"}, name="Deep groove ball bearing 6205"), product(2, None, name=None)])))
    rows = E.extract(records, spark).select("id", F.size("extracted").alias("n")).collect()
    assert len(rows) == 2 and len(seen) == 1 and "array_sort" not in seen[0] and "Join" not in seen[0]


# ---- rows beside Python ----

def waiting(df):
    """Names of what runs Python in a plan, with the columns of the rows that go there."""
    found, todo = [], [plan(df)]
    while todo:
        node = todo.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow"):
            found.append((node.nodeName(), {below[0].output().apply(i).name() for i in range(below[0].output().size())}))
        todo += below
    return found


@pytest.fixture()
def few_records(product, product_df):
    return classify(normalize(product_df([
        product(1, {"Seal": "rubber seal 2RS", "Bore": "25 mm"}, name="Deep groove ball bearing 6205"), product(2, None, name=None),
        product(3, {"Body Material": "stainless 316", "Max Temperature": "80 C"}, name="Ball valve 1/2 inch", description="PTFE seat"),
        product(3, {"Body Material": "stainless 316", "Max Temperature": "80 C"}, name="Ball valve 1/2 inch", description="PTFE seat")])))


def test_rows_do_not_wait_for_nearest_options_in_a_queue(spark, few_records):
    found = waiting(E.extract(few_records, spark).select("id", "extracted", "schema.code"))
    assert [n for n, _ in found] == ["MapInArrow"] and all("schema" not in columns for _, columns in found)


def test_rows_scored_one_by_one_wait_without_their_schema(spark, few_records, monkeypatch):
    monkeypatch.setattr(E, "LOOKUP_KEYS", 0)
    found = waiting(E.extract(few_records, spark).select("id", "extracted", "schema.code"))
    assert sorted(n for n, _ in found) == ["ArrowEvalPython", "MapInArrow"] and all("schema" not in columns for _, columns in found)


def test_the_schema_joined_again_is_the_one_a_row_had(spark, few_records, monkeypatch):
    rows = lambda taxonomy: sorted(E.extract(few_records, spark, taxonomy).select("id", "extracted", "schema.code", "schema.leaf", "unmapped").collect(), key=str)
    want = rows(Taxonomy())
    assert len(want) == 4 and sum(len(r["extracted"]) > 0 for r in want) == 3
    with monkeypatch.context() as m:
        m.setattr(E, "BROADCAST_CATEGORIES", 0)
        assert rows(Taxonomy()) == want
    valve = next(c for c in fixed.CATEGORIES if c["code"] == "40141600")
    twice = rows(Taxonomy(curated=[valve, {**valve, "path": [*valve["path"][:-1], "Other"]}]))
    assert sorted(r["leaf"] for r in twice if r["code"]) == sorted(["Other", valve["path"][-1]] * 2)


@pytest.mark.parametrize("name", ["open_keys", "standard_contradictions"])
def test_settled_products_leave_no_queue_of_records(spark, tmp_path, name):
    from specloom.catalog import load
    spark.sql("""SELECT id AS p_partkey, 'nut' AS p_name, 'B' AS p_brand, 'steel' AS p_type, CAST(id % 50 AS INT) AS p_size, 1D AS p_retailprice FROM range(40)""").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = waiting(load()[0][name](spark, str(tmp_path)))
    assert [n for n, _ in found] == ["MapInArrow"] and "schema" not in found[0][1]
