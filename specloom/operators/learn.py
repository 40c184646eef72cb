"""Propose category schemas from products no category claims.

Clustering runs over distinct signatures, not rows; everything after it is grouped
aggregation with partial counts.  Values, words and fields are counted before they
are ranked, so no product group is ever gathered in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import fixed
from ..functions import units
from ..functions.stage import durable
from ..functions.text import in_list, key_slug, q

# Earliest undecided signatures of a token that others are compared with first.
HEADS = 2
BROADCAST_SIGNATURES = 1_000_000


# -------------------------------------------------------------- signatures


def _bookkeeping(slug: str) -> str:
    return f"({slug} = '' OR {slug} IN {in_list(fixed.BOOKKEEPING_KEYS)} OR {slug} RLIKE '^[a-z0-9]+_brand$')"


def words_sql(text: str) -> str:
    return (f"filter(regexp_extract_all(lower({text}), '[a-z]{{3,}}', 0),"
            f" w -> w NOT IN {in_list(fixed.NAME_STOP_WORDS)})")


def signatures(products: DataFrame) -> DataFrame:
    """L2: adds ``fields`` (slugged keys minus bookkeeping), ``words`` (in reading order)."""
    slugs = f"transform(coalesce(specs, array()), s -> {key_slug('s.key')})"
    return products.withColumns({
        "fields": F.expr(f"array_sort(array_distinct(filter({slugs}, k -> NOT {_bookkeeping('k')})))"),
        "words": F.expr(words_sql("concat_ws(' ', name, category_hint)")),
    })


def _probes(items: DataFrame, name: str) -> DataFrame:
    """(token, ``name``, ``name``_o): tokens of which two signatures that reach the threshold share one.

    With two fields between them words give at most 0.3, so they share a field; otherwise both
    have one field at most and share a word.
    """
    tokens = "concat(transform(fields, x -> concat('f', x)), IF(size(fields) < 2, transform(words, x -> concat('w', x)), array()))"
    return items.select(F.explode(F.expr(tokens)).alias("token"), F.col("_sig").alias(name), F.col("o").alias(name + "_o"))


def _scored(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs (sig, lead) whose score reaches the threshold, with the score.

    0.7 x field overlap + 0.3 x word overlap, words alone when the two have fewer than two
    fields together.
    """
    side = lambda name: items.select(F.col("_sig").alias(name), F.col("fields").alias(name + "_f"), F.col("words").alias(name + "_w"))
    overlap = lambda x: f"size(array_intersect(sig_{x}, lead_{x}))"
    return (pairs.join(side("sig"), "sig").join(side("lead"), "lead")
            .withColumns({"ff": F.expr(overlap("f")), "ww": F.expr(overlap("w"))})
            .withColumns({"fields": F.expr("size(sig_f) + size(lead_f) - ff"), "by_word": F.expr("coalesce(ww / nullif(size(sig_w) + size(lead_w) - ww, 0), 0D)")})
            .withColumn("score", F.expr("IF(fields >= 2, 0.7D * (ff / fields) + 0.3D * by_word, by_word)"))
            .where(f"score >= {fixed.CLUSTER_THRESHOLD}D").select("sig", "lead", "score"))


def _near(later: DataFrame, earlier: DataFrame, items: DataFrame) -> DataFrame:
    """(sig, lead, score) of every signature of ``later`` with every one of ``earlier`` that comes before it and reaches it."""
    met = _probes(later, "sig").join(_probes(earlier, "lead"), "token").where("lead_o < sig_o")
    return _scored(met.select("sig", "lead").distinct(), items)


def leaders(items: DataFrame, heads: int = HEADS) -> DataFrame:
    """Signatures (``items``: _sig, o, fields, words) that no earlier leader reaches, in the order of ``o``.

    An undecided signature whose earlier neighbours are all decided leads; what a new leader reaches
    is decided.  So rounds follow the longest chain of neighbours, not the number of signatures.
    A round first sets aside what one of the ``heads`` earliest undecided signatures of a token of
    its own reaches, which is nearly all of a dense group by few comparisons, then compares the
    others with all earlier undecided ones.  ``heads`` sets the pace, not the result.
    """
    left, found = items, []
    first = W.partitionBy("token").orderBy("lead_o")
    while not left.isEmpty():
        early = _probes(left, "lead").withColumn("r", F.row_number().over(first)).where(F.col("r") <= heads).drop("r")
        met = _probes(left, "sig").join(early, "token").where("lead_o < sig_o").select("sig", "lead").distinct()
        blocked = _scored(met, left).select(F.col("sig").alias("_sig")).distinct()
        open_ = durable(left.join(blocked, "_sig", "left_anti"))
        later = _near(open_, left, left).select(F.col("sig").alias("_sig")).distinct()
        new = durable(open_.join(later, "_sig", "left_anti"))
        found.append(new)
        taken = _near(left, new, left).select(F.col("sig").alias("_sig")).union(new.select("_sig")).distinct()
        left = durable(left.join(taken, "_sig", "left_anti"))
    return durable(reduce(DataFrame.unionByName, found)) if found else items


def cluster(products: DataFrame, block: int = HEADS) -> DataFrame:
    """L3: adds ``cluster``, the id of the first product with the leading signature of its group.

    Distinct signatures are taken by number of products, then first product.  One that no
    earlier leader reaches with 0.35 leads a group; any other joins the earlier leader that
    scores best.  Groups do not grow by union.  ``block`` is ``heads`` of ``leaders``.
    """
    df = signatures(products) if "fields" not in products.columns else products
    df = df.withColumn("_sig", F.xxhash64("fields", F.array_sort(F.array_distinct("words"))))
    items = (df.groupBy("_sig").agg(F.min("id").alias("first"), F.count("*").alias("support"), F.any_value("fields").alias("fields"),
                                    F.any_value(F.array_sort(F.array_distinct("words"))).alias("words")))
    items = durable(items.withColumn("o", F.struct((-F.col("support")).alias("s"), "first", "_sig")))
    found = leaders(items, block)
    order = found.select(F.col("_sig").alias("lead"), F.col("o").alias("lead_o"))
    best = (_near(items, found, items).join(order, "lead").groupBy("sig")
            .agg(F.min_by("lead_o.first", F.struct(-F.col("score"), F.col("lead_o"))).alias("leader")))
    own = found.select(F.col("_sig").alias("sig"), F.col("first").alias("leader"))
    assigned = durable(own.unionByName(best.join(own.select("sig"), "sig", "left_anti")).withColumnRenamed("sig", "_sig"))
    side = F.broadcast(assigned) if assigned.count() <= BROADCAST_SIGNATURES else assigned
    return df.join(side, "_sig").withColumnRenamed("leader", "cluster").drop("_sig")


# ------------------------------------------------------------------- naming


def names(clustered: DataFrame) -> DataFrame:
    """Noun and keywords per cluster; frequency picks the words, reading order arranges them.

    Ties in frequency are settled alphabetically.
    """
    seen = clustered.select("cluster", F.explode(F.expr(
        "transform(words, (w, i) -> named_struct('w', w, 'i', i, 'new', array_position(words, w) = i + 1))")).alias("x"))
    totals = clustered.groupBy("cluster").agg(F.count("*").alias("total"))
    counted = seen.groupBy("cluster", F.col("x.w").alias("word")).agg(
        F.count_if("x.new").alias("n"), F.avg("x.i").alias("pos"))
    top = (counted.withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("n"), "word")))
           .where("r <= 6").join(totals, "cluster").where("n >= greatest(1D, total * 0.4D)"))
    picked = top.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("r", "word", "pos"))).alias("c"))
    head = ("array_join(transform(array_sort(transform(slice(c, 1, 2), x -> named_struct('p', x.pos, 'r', x.r, 'w', x.word))),"
            " x -> x.w), ' ')")
    named = picked.select("cluster", F.expr(f"initcap({head})").alias("noun"), F.expr(
        f"array_sort(array_distinct(concat(transform(c, x -> x.word), array({head}))))").alias("keywords"))
    return (totals.join(named, "cluster", "left")
            .withColumn("noun", F.coalesce("noun", F.lit("Uncategorised Product")))
            .withColumn("keywords", F.coalesce("keywords", F.expr("CAST(array() AS ARRAY<STRING>)"))))


def merge_alike(clustered: DataFrame) -> DataFrame:
    """L4: clusters with the same noun and keywords become one."""
    n = names(clustered)
    same = n.groupBy(F.lower("noun").alias("_n"), "keywords").agg(F.min("cluster").alias("_to"))
    moved = (n.join(same, [F.lower(n["noun"]) == same["_n"], n["keywords"] == same["keywords"]])
             .select("cluster", "_to"))
    side = F.broadcast(moved) if moved.count() <= BROADCAST_SIGNATURES else moved
    return clustered.join(side, "cluster").drop("cluster").withColumnRenamed("_to", "cluster")


def code_sql(noun: str = "noun", keywords: str = "keywords") -> str:
    """L9: '99' and six digits, stable for a noun and its keywords."""
    seed = (f"concat(lower({noun}), IF(size({keywords}) > 0, concat('|', array_join(array_sort("
            f"transform({keywords}, k -> lower(k))), '|')), ''))")
    return f"concat('99', lpad(left(conv(left(sha2({seed}, 256), 8), 16, 10), 6), 6, '0'))"


def group_sql(key: str) -> str:
    """L7"""
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({key}), {q(n)})" for n in needles) + f" THEN {q(group)}"
        for group, needles in fixed.GROUP_FRAGMENTS)
    return f"CASE {whens} ELSE 'General' END"


# ------------------------------------------------------------ type inference


def field_values(clustered: DataFrame) -> DataFrame:
    """One row per cluster, product and spec field that holds a value."""
    slug = key_slug("s.key")
    return (clustered.select("cluster", "id", F.posexplode_outer("specs").alias("pos", "s")).where("s IS NOT NULL")
            .select("cluster", "id", "pos", F.expr(slug).alias("key"), F.trim("s.key").alias("label"),
                    F.col("s.value").alias("value"))
            .where(f"NOT {_bookkeeping('key')} AND coalesce(value, '') <> ''"))


def infer_types(values: DataFrame, by: list[str]) -> DataFrame:
    """Type, unit, widened range and vocabulary of each field.

    ``values`` carries the ``by`` columns and ``value``.
    """
    v = values.withColumn("v", F.trim("value")).where("v <> ''")
    quantity = units.measure("v", "CAST(NULL AS STRING)")
    v = v.withColumn("_q", F.expr(f"CASE WHEN v RLIKE {q(fixed.QUANTITY_ONLY_RX)} THEN {quantity} END"))
    per_unit = v.groupBy(*by, F.col("_q.unit").alias("u"), F.col("_q").isNotNull().alias("is_q")).agg(
        F.count("*").alias("n"), F.min("_q.num").alias("lo"), F.max("_q.num").alias("hi"),
        F.count_if(F.lower("v").isin(fixed.BOOLEAN_WORDS)).alias("booleans"))
    totals = per_unit.groupBy(*by).agg(
        F.sum("n").alias("cleaned"), F.sum("booleans").alias("booleans"),
        F.sum(F.when(F.col("is_q"), F.col("n"))).alias("parsed"),
        F.max(F.when(F.col("u").isNotNull(), F.struct(F.col("n"), F.col("u")))).alias("_m"))
    totals = totals.withColumn("found", F.col("_m.u"))
    canon = f"coalesce({units.canonical(units.dimension('found'))}, found)"
    totals = totals.withColumn("canonical", F.expr(canon)).drop("_m")
    spans = per_unit.where("is_q").join(totals.select(*by, "found", "canonical"), by)
    def conv(x):
        return f"CASE WHEN found IS NULL THEN {x} ELSE coalesce(nullif({units.convert(x, 'coalesce(u, found)', 'canonical')}, 0D), {x}) END"
    spans = (spans.withColumn("lo", F.expr(conv("lo"))).withColumn("hi", F.expr(conv("hi")))
             .groupBy(*by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    distinct = v.groupBy(*by, "v").agg(F.count("*").alias("_n"))
    shape = distinct.groupBy(*by).agg(F.count("*").alias("distinct_values"), F.max(F.length("v")).alias("longest"))
    few = (distinct.join(shape.where(f"distinct_values <= 12").select(*by), by)
           .groupBy(*by).agg(F.array_sort(F.collect_list("v")).alias("members")))
    out = totals.join(shape, by).join(spans, by, "left").join(few, by, "left")
    kind = ("CASE WHEN booleans = cleaned THEN 'boolean'"
            " WHEN coalesce(parsed, 0) >= greatest(2, CAST(floor(0.7D * cleaned) AS BIGINT)) THEN 'number'"
            " WHEN distinct_values BETWEEN 2 AND 12 AND distinct_values <= greatest(1, CAST(floor(0.6D * cleaned) AS BIGINT))"
            " AND longest <= 40 THEN 'enum' ELSE 'text' END")
    span = "greatest(hi - lo, abs(hi) * 0.5D, 1D)"
    return (out.withColumn("type", F.expr(kind))
            .withColumn("unit", F.expr("CASE WHEN type = 'number' THEN canonical END"))
            .withColumn("range_low", F.expr(f"CASE WHEN type = 'number' THEN round(IF(lo >= 0, greatest(lo - {span}, 0D), lo - {span}), 4) END"))
            .withColumn("range_high", F.expr(f"CASE WHEN type = 'number' THEN round(hi + {span}, 4) END"))
            .withColumn("members", F.expr("CASE WHEN type = 'enum' THEN members END"))
            .select(*by, "type", "unit", "range_low", "range_high", "members", "cleaned"))


def proposed_attributes(clustered: DataFrame) -> DataFrame:
    """Fields with enough support, typed, grouped, with samples and order."""
    by = ["cluster", "key"]
    values = field_values(clustered)
    totals = clustered.groupBy("cluster").agg(F.count("*").alias("total"))
    support = (values.groupBy(*by).agg(F.count("*").alias("observed_in"),
                                       F.min_by("label", F.struct("id", "pos")).alias("label"))
               .join(totals, "cluster").where(f"observed_in / total >= {fixed.FIELD_SUPPORT}D"))
    distinct = values.groupBy(*by, "value").agg(F.count("*").alias("_n"))
    samples = (distinct.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy("value"))).where("r <= 5")
               .groupBy(*by).agg(F.array_sort(F.collect_list("value")).alias("sample_values")))
    order = W.partitionBy("cluster").orderBy(F.desc("observed_in"), "key")
    wanted = F.col("observed_in") / F.col("total") >= fixed.REQUIRED_SUPPORT
    return (support.join(infer_types(values, by), by, "left").join(samples, by, "left")
            .withColumn("grp", F.expr(group_sql("key")))
            .withColumn("pos", F.row_number().over(order)).withColumn("required", wanted)
            .withColumn("alias", F.expr("CASE WHEN lower(label) <> replace(key, '_', ' ') THEN lower(label) END"))
            .withColumn("rationale", F.expr(
                "concat('Seen in ', observed_in, ' of ', total, ' sample products. Inferred as ', type,"
                " IF(unit IS NOT NULL, concat(' in ', unit), ''),"
                " IF(members IS NOT NULL, concat(' from ', size(members), ' repeating values'), ''), '.')")))


# ---------------------------------------------------------------- proposals


def propose(products: DataFrame, block: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(proposals, proposed attributes) from weakly classified products."""
    clustered = durable(merge_alike(cluster(products, block)))
    attrs = durable(proposed_attributes(clustered))
    heads = names(clustered)
    shape = attrs.groupBy("cluster").agg(
        F.count("*").alias("fields"), F.sum("observed_in").alias("observed"),
        F.array_sort(F.collect_list(F.struct("pos", "key", "required"))).alias("a"))
    skus = (clustered.withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy("id"))).where("r <= 8")
            .groupBy("cluster").agg(F.expr("transform(array_sort(collect_list(struct(r, coalesce(sku, mpn, '(unidentified)') AS s))), x -> x.s)")
                                    .alias("sample_skus")))
    p = heads.join(shape, "cluster", "left").join(skus, "cluster", "left")
    p = (p.withColumn("fields", F.coalesce("fields", F.lit(0))).where("fields > 0 OR total >= 3")
         .withColumn("code", F.expr(code_sql()))
         .withColumn("id", F.expr("left(sha2(concat(code, '|', array_join(array_sort(transform(coalesce(a, array()), x -> x.key)), '|')), 256), 12)"))
         .withColumn("required", F.expr("IF(fields = 0, CAST(array() AS ARRAY<STRING>), concat(array('brand', 'mpn'),"
                                        " slice(transform(filter(a, x -> x.required), x -> x.key), 1, 4)))"))
         .withColumn("confidence", F.expr(confidence_sql())))
    p = disambiguate(p)
    return (p.select("id", F.lit("pending").alias("status"), "cluster", "code", "name", "noun", "keywords", "required",
                     F.col("total").alias("sample_count"), "sample_skus", "confidence", "fields"), attrs)


def confidence_sql(total: str = "total", fields: str = "fields", observed: str = "observed") -> str:
    """Grows with sample size and with how consistently fields recur."""
    consistency = f"coalesce(try_divide(CAST({observed} AS DOUBLE), {fields} * {total}), 0D)"
    base = f"round(least(0.25D + 0.45D * least({total} / 6D, 1D) + 0.30D * {consistency}, 0.95D), 3)"
    return f"IF({fields} = 0, least({base}, 0.45D), {base})"


def disambiguate(p: DataFrame) -> DataFrame:
    """Equal names get a distinguishing keyword, or the end of their code.

    Proposals of a name stand in the order of sample count, confidence and cluster.  Each in turn takes
    the first label of its keywords that no earlier one has.  That is settled in rounds: every
    proposal claims its next label; the first claimant of a label keeps it unless an earlier
    proposal may still come to claim it, and what lost its claim moves on.  No name's proposals are gathered.
    """
    named = durable(p.withColumn("nm", F.concat("noun", F.lit("s"))).withColumn("o", F.struct(
        (-F.col("total")).alias("t"), (-F.col("confidence")).alias("c"), F.col("cluster").alias("k"))))
    many = named.groupBy("nm").agg(F.count("*").alias("n")).where("n > 1").select("nm")
    labels = F.expr("array_distinct(transform(filter(keywords, k -> NOT contains(lower(nm), lower(k))), k -> concat(nm, ' (', initcap(k), ')')))")
    rows = durable(named.join(many, "nm", "left_semi").select("nm", "cluster", "o", "code", labels.alias("labels")))
    # Every wish a proposal has, in its order: (nm, label) is wanted by o as its i-th choice.
    wishes = durable(rows.select("cluster", "o", F.posexplode("labels").alias("i", "label")))
    settled = []
    while not wishes.isEmpty():
        # A wish is granted for certain if its proposal has no better open wish and no earlier proposal wants the label.
        first = wishes.groupBy("cluster").agg(F.min("i").alias("i"))
        wanted = wishes.groupBy("label").agg(F.min("o").alias("o"))
        granted = durable(wishes.join(first, ["cluster", "i"]).join(wanted, ["label", "o"]).select("cluster", "label"))
        settled.append(granted)
        open_ = wishes.join(granted.select("cluster"), "cluster", "left_anti")
        wishes = durable(open_.join(granted.select("label"), "label", "left_anti"))
    last = rows.select("cluster", F.expr("concat(nm, ' (', right(code, 4), ')')").alias("name"))
    if settled:
        own = reduce(DataFrame.unionByName, settled).select("cluster", F.col("label").alias("own"))
        last = last.join(own, "cluster", "left").select("cluster", F.coalesce("own", "name").alias("name"))
    return named.drop("o").join(durable(last), "cluster", "left").withColumn("name", F.coalesce("name", "nm")).drop("nm")


# ------------------------------------------------------------ review states


def upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Settled proposals stay, pending ones are refreshed, unseen ones added.

    Both sides share columns and one row per id.  Adds ``is_new``.
    """
    columns = [c for c in new.columns if c != "id"]
    e = existing.select("id", *[F.col(c).alias("e_" + c) for c in columns], F.lit(True).alias("_e"))
    n = new.select("id", *[F.col(c).alias("n_" + c) for c in columns], F.lit(True).alias("_n"))
    keep = F.col("_n").isNull() | (F.coalesce("e_status", F.lit("pending")) != "pending")
    return (e.join(n, "id", "full_outer").select(
        "id", *[F.when(keep, F.col("e_" + c)).otherwise(F.col("n_" + c)).alias(c) for c in columns],
        F.col("_e").isNull().alias("is_new")))


def review(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approve, reject or revoke by joining ``decisions(id, decision)``; last state wins."""
    return (proposals.join(decisions, "id", "left")
            .withColumn("status", F.when(F.col("decision") == "approve", "approved")
                        .when(F.col("decision") == "reject", "rejected")
                        .when(F.col("decision") == "revoke", F.when(F.col("status") == "approved", "pending").otherwise(F.col("status")))
                        .otherwise(F.col("status"))).drop("decision"))


def by_status(proposals: DataFrame) -> DataFrame:
    """L13"""
    return proposals.groupBy("status").agg(F.count("*").alias("proposals"))


def to_categories(proposals: DataFrame, attrs: DataFrame) -> list[dict]:
    """Approved proposals as category schemas for ``Taxonomy(learned=...)``.

    A reviewed taxonomy is configuration that people approved one by one; it, and nothing that
    grows with the products, reaches the driver.
    """
    approved = proposals.where("status = 'approved'")
    rows = approved.select("id", "code", "name", "noun", "keywords", "required", "cluster").collect()
    fields: dict = {}
    for f in attrs.join(approved.select("cluster"), "cluster", "left_semi").orderBy("cluster", "pos").collect():
        fields.setdefault(f["cluster"], []).append(f)
    out = []
    for r in rows:
        mine = fields.get(r["cluster"], [])
        out.append({
            "code": r["code"], "noun": r["noun"], "keywords": list(r["keywords"]), "mpn_patterns": [],
            "path": ["Industrial Components", "Learned Categories", r["name"]], "required": list(r["required"]),
            "cross_checks": [], "defaults": {}, "learned": True,
            "attributes": [{
                "key": f["key"], "label": f["label"], "type": f["type"], "unit": f["unit"], "group": f["grp"],
                "values": list(f["members"] or []), "aliases": [f["alias"]] if f["alias"] else [],
                "range": None if f["range_low"] is None else (f["range_low"], f["range_high"])} for f in mine]})
    return out
