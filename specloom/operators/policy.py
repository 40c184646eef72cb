"""Which sources may be cited, and how harvested pages merge."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .. import fixed
from ..functions.text import in_list, q

PAGE_BUDGET = 3


def blocked_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.BLOCKED_SOURCES, "domain string, kind string, any_tld boolean")


def manufacturer_domains(spark: SparkSession) -> DataFrame:
    """Domain -> owner; a domain listed twice belongs to the later entry."""
    owner = {d: (b, m) for b, m, ds, _ in fixed.MANUFACTURERS for d in ds}
    return spark.createDataFrame([(d, b, m) for d, (b, m) in owner.items()],
                                 "domain string, owner string, manufacturer string")


def url_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(b.lower(), b, i, t) for b, _, _, ts in fixed.MANUFACTURERS for i, t in enumerate(ts)],
        "brand_key string, brand string, pos int, template string")


def host_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Scheme, host, its suffixes longest first, and the brand-carrying label."""
    two_level = (f"size(_p) >= 3 AND length(element_at(_p, -1)) = 2"
                 f" AND element_at(_p, -2) IN {in_list(fixed.SLD_SUFFIXES)}")
    return (df.withColumn("scheme", F.expr(f"lower(try_parse_url(trim({url}), 'PROTOCOL'))"))
            .withColumn("host", F.expr(f"lower(try_parse_url(trim({url}), 'HOST'))"))
            .withColumn("_p", F.expr("split(trim(BOTH '.' FROM coalesce(host, '')), '\\\\.')"))
            .withColumn("suffixes", F.expr(
                "IF(coalesce(host, '') = '', array(), transform(sequence(1, size(_p)),"
                " i -> array_join(slice(_p, i, size(_p)), '.')))"))
            .withColumn("label", F.expr(
                f"CASE WHEN {two_level} THEN element_at(_p, -3) WHEN size(_p) >= 2 THEN element_at(_p, -2) ELSE '' END"))
            .drop("_p"))


def _literal_map(pairs: list[tuple[str, str]]) -> str:
    return "map(" + ", ".join(f"{q(k)}, {q(v)}" for k, v in pairs) + ")"


def blocked(df: DataFrame) -> DataFrame:
    """``blocked_kind`` and ``blocked_match`` for hosts with parts (see ``host_parts``).

    The block list is a few dozen rows and rides along as a literal map.
    """
    domains = _literal_map([(d, k) for d, k, _ in fixed.BLOCKED_SOURCES])
    labels = _literal_map([(d.split(".")[0], k) for d, k, a in fixed.BLOCKED_SOURCES if a])
    hit = f"get(filter(suffixes, s -> try_element_at({domains}, s) IS NOT NULL), 0)"
    return (df.withColumn("_hit", F.expr(hit))
            .withColumn("blocked_kind", F.expr(
                f"CASE WHEN _hit IS NOT NULL THEN try_element_at({domains}, _hit)"
                f" WHEN coalesce(host, '') <> '' THEN try_element_at({labels}, label) END"))
            .withColumn("blocked_match", F.expr("CASE WHEN _hit IS NOT NULL THEN _hit"
                                                " WHEN blocked_kind IS NOT NULL THEN host END")).drop("_hit"))


def check(df: DataFrame, brand: str = "brand", allow_unknown: bool = False) -> DataFrame:
    """D3: ``allowed``, ``kind`` and ``reason`` of every URL for a brand."""
    df = blocked(host_parts(df))
    owners = {d: (b, m) for b, m, ds, _ in fixed.MANUFACTURERS for d in ds}
    owner = _literal_map([(d, b) for d, (b, _) in owners.items()])
    maker = _literal_map([(d, m) for d, (_, m) in owners.items()])
    known = in_list(b.lower() for b, *_ in fixed.MANUFACTURERS)
    b = f"lower(trim({brand}))"
    df = df.withColumn("_site", F.expr(f"get(filter(suffixes, s -> try_element_at({owner}, s) IS NOT NULL), 0)"))
    df = df.withColumn("_owner", F.expr(f"try_element_at({owner}, _site)"))
    wrong = f"coalesce({brand}, '') <> '' AND {b} IN {known} AND lower(_owner) <> {b}"
    state = (f"CASE WHEN coalesce(scheme, '') NOT IN ('http', 'https') THEN 'scheme'"
             f" WHEN coalesce(host, '') = '' THEN 'no_host' WHEN blocked_kind IS NOT NULL THEN 'blocked'"
             f" WHEN _site IS NOT NULL AND ({wrong}) THEN 'wrong_maker' WHEN _site IS NOT NULL THEN 'maker'"
             f" ELSE 'unknown' END")
    open_text = ("concat(host, ' is not blocked, and unknown domains are permitted.')" if allow_unknown else
                 "concat(host, ' is not a known manufacturer domain. It cannot be cited as a"
                 " manufacturer-provided source, so it was not fetched.')")
    reason = (
        "CASE _state WHEN 'scheme' THEN concat('Only http(s) sources are fetched; got \\'',"
        " coalesce(nullif(scheme, ''), 'no scheme'), '\\'.')"
        " WHEN 'no_host' THEN 'No host in the URL.'"
        " WHEN 'blocked' THEN concat(blocked_match, ' is a ', blocked_kind, '. The content standard requires"
        " manufacturer-provided sources, so ', blocked_kind, 's are excluded.')"
        f" WHEN 'wrong_maker' THEN concat(_site, ' is the official site of ', _owner, ', not of \\'', {brand},"
        " '\\'. A manufacturer page for the wrong manufacturer is not evidence about this part.')"
        f" WHEN 'maker' THEN concat(_site, ' is the approved domain for ', _owner, ' (', try_element_at({maker}, _site), ').')"
        f" ELSE {open_text} END")
    return (df.withColumn("_state", F.expr(state))
            .withColumn("allowed", F.expr(f"_state = 'maker' OR (_state = 'unknown' AND {str(allow_unknown).lower()})"))
            .withColumn("kind", F.expr("CASE WHEN _state = 'blocked' THEN blocked_kind WHEN _state IN ('maker', 'wrong_maker')"
                                       " THEN 'manufacturer' WHEN _state = 'unknown' THEN 'unknown' ELSE '' END"))
            .withColumn("reason", F.expr(reason)).drop("_state", "_site", "_owner"))


def candidate_urls(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Official-site URLs from brand templates and the part number, in template order."""
    t = url_templates(spark)  # one row per configured template; Spark knows its size
    return (df.where("coalesce(trim(mpn), '') <> ''")
            .join(t, F.lower(F.trim(df["brand"])) == t["brand_key"])
            .select("id", t["brand"], "mpn", F.col("pos").alias("rank"),
                    F.replace("template", F.lit("{mpn}"), F.trim("mpn")).alias("url")))


def candidate_notes(df: DataFrame) -> DataFrame:
    """Why a product has no candidate URL."""
    known = in_list(b.lower() for b, *_ in fixed.MANUFACTURERS)
    templated = in_list(b.lower() for b, _, _, t in fixed.MANUFACTURERS if t)
    b = "lower(trim(brand))"
    return df.select("id", F.expr(
        "CASE WHEN coalesce(brand, '') = '' THEN 'no_brand'"
        f" WHEN {b} NOT IN {known} THEN 'brand_unknown' WHEN coalesce(mpn, '') = '' THEN 'no_part_number'"
        f" WHEN {b} NOT IN {templated} THEN 'no_template' ELSE 'candidates' END").alias("outcome"))


def usefulness(df: DataFrame) -> DataFrame:
    """Whether a harvested page says anything, and why not."""
    soft = q(fixed.SOFT_404_RX)
    return df.withColumn("useful", F.expr(
        "CASE WHEN coalesce(size(specs), 0) > 0 THEN true"
        f" WHEN concat_ws(' ', coalesce(name, ''), coalesce(description, '')) RLIKE {soft} THEN false"
        " ELSE coalesce(nullif(name, ''), nullif(description, ''), nullif(brand, '')) IS NOT NULL END")
    ).withColumn("why_not", F.expr(
        "CASE WHEN useful THEN NULL"
        f" WHEN left(concat_ws(' ', coalesce(name, ''), coalesce(free_text, '')), 400) RLIKE {soft}"
        " THEN 'Fetched, but the page itself says the product was not found — the address is wrong rather than"
        " the part being absent.'"
        " ELSE 'Fetched successfully but nothing usable was parsed. It may be built in the browser, or the address"
        " may be wrong; the engine does not guess which, and writes nothing either way.' END"))


def page_budget(df: DataFrame, budget: int = PAGE_BUDGET) -> DataFrame:
    """Only the first ``budget`` allowed pages of a product, by rank, are read.

    ``row_number() <= k`` lets Spark keep k rows per product in every task before the
    exchange, so a product with very many candidates is never sorted in one place.  Equal
    rows are numbered, and as many of them are read as the budget reached.
    """
    page = ["product_id", "rank", "url"]
    w = W.partitionBy("product_id").orderBy("rank", "url")
    read = (df.where("allowed").select(*page).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= budget)
            .groupBy(*page).agg(F.count("*").alias("_read")))
    copy = F.row_number().over(W.partitionBy(*page).orderBy(F.coalesce(F.col("allowed"), F.lit(False)).desc()))
    read = read.withColumnsRenamed({c: f"_{c}" for c in page})
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in page])
    return (df.withColumn("_copy", copy).join(read, same, "left")
            .withColumn("accepted", F.coalesce(F.col("allowed") & (F.col("_copy") <= F.col("_read")), F.lit(False)))
            .drop("_copy", "_read", *[f"_{c}" for c in page])
            .withColumn("ledger_reason", F.expr(
                "CASE WHEN allowed AND NOT accepted THEN 'Within policy, but the per-product page budget of"
                f" {budget} was already spent on higher-ranked sources.' ELSE reason END")))


def merge_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First page wins per spec key and per text field.

    ``pages(product_id, rank, url, name, description, free_text, specs)``.  Returns
    (fields, specs); ``min_by`` combines map-side, so page counts per product do not matter.
    """
    specs = (pages.select("product_id", "rank", "url", F.posexplode_outer("specs").alias("pos", "s"))
             .where("s IS NOT NULL").groupBy("product_id", F.col("s.key").alias("key"))
             .agg(F.min_by(F.struct(F.col("s.value").alias("value"), "url"), F.struct("rank", "pos")).alias("w"))
             .select("product_id", "key", "w.value", F.col("w.url").alias("source_url")))
    def first(c):
        return F.min_by(F.when(F.coalesce(c, F.lit("")) != "", F.col(c)),
                        F.when(F.coalesce(c, F.lit("")) != "", F.col("rank"))).alias(c)
    fields = pages.groupBy("product_id").agg(first("name"), first("description"), first("free_text"),
                                             F.min_by("url", "rank").alias("source_url"))
    return fields, specs


def caller_wins(specs: DataFrame, base: DataFrame) -> DataFrame:
    """What the caller supplied replaces what was harvested; both keyed (product_id, key)."""
    b = base.select("product_id", "key", F.col("value").alias("_base"))
    return (specs.join(b, ["product_id", "key"], "full_outer")
            .select("product_id", "key", F.coalesce("_base", "value").alias("value"),
                    F.when(F.col("_base").isNull(), F.col("source_url")).alias("source_url")))


def discovery_summary(ledger: DataFrame) -> DataFrame:
    """D9"""
    return ledger.groupBy("product_id").agg(
        F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"),
        (F.count_if("accepted") > 0).alias("found"))

