"""Spec pairs and identity from document text and cell grids.

Inputs: ``pages(doc, page, text)`` with one row per page, and
``cells(doc, page, tbl, row, col, text)``.  A page's lines are read inside its row: labelled lines,
gutter columns and the choice between them are arrays of one program, evaluated once.  A grid is one
aggregate of its cells.  A page meets its grids in one aggregate, and a document its pages in another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..functions.lookup import filed, filing, held
from ..functions.stage import durable, stage
from ..functions.text import escape_rx, in_list, let, q

#: Brand spellings up to which every task holds them; more are joined by word.
BRANDS_HELD = 200_000
_PAIR = "STRUCT<tbl:BIGINT,line:BIGINT,key:STRING,value:STRING>"

_CLEAN = "trim(regexp_replace(replace(replace({}, '\\u00AD', ''), '\\u00A0', ' '), '\\\\s+', ' '))"


def clean(x: str) -> str:
    """Soft hyphens removed, non-breaking spaces and newlines collapsed."""
    return _CLEAN.format(x)


def looks_like_spec(key: str = "key", value: str = "value", limit: int = fixed.MAX_DOC_VALUE_CHARS,
                    document: bool = True) -> str:
    """S5b (documents) and S11 (pages): whether a pair reads like a label and its value."""
    tests = [
        f"length({key}) BETWEEN 2 AND {fixed.MAX_KEY_CHARS}", f"length({value}) BETWEEN 1 AND {limit}",
        f"NOT {key} RLIKE '[.?!]$'", f"size(split(trim({key}), '\\\\s+')) <= 6",
        f"length(regexp_replace({key}, '[^A-Za-z]', '')) >= 2",
    ]
    if document:
        tests += [f"NOT (length({key}) <= 3 AND {value} RLIKE '^\\\\p{{Ll}}')",
                  f"length(regexp_replace({value}, '[^.…]', '')) < 4"]
    return "coalesce(" + " AND ".join(tests) + ", false)"


_LINES = "split(text, '\\r\\n|\\n|\\r')"


def lines(pages: DataFrame) -> DataFrame:
    return pages.select("doc", "page", F.posexplode(F.expr(_LINES)).alias("line", "text"))


def _kept(lines_sql: str, pair: str) -> str:
    """Pairs that ``pair`` makes of a line t with number i, where they read like a label and its value."""
    return f"filter(transform({lines_sql}, (t, i) -> {pair}), p -> {looks_like_spec('p.key', 'p.value')})"


def _labelled(ls: str) -> str:
    """S3: 'Key ..... value', else 'Key: value', of an array of lines."""
    def pair(rx):
        part = lambda n: clean(f"regexp_extract(t, {q(rx)}, {n})")
        return f"CASE WHEN t RLIKE {q(rx)} THEN named_struct('line', i, 'key', {part(1)}, 'value', {part(2)}) END"
    return _kept(ls, f"coalesce({pair(fixed.DOT_LEADER_RX)}, {pair(fixed.COLON_RX)})")


def _is_unit(x: str) -> str:
    names = in_list(fixed.UNITS)
    return let("uc", f"lower(trim(BOTH '.' FROM trim({x})))",
               f"uc <> '' AND (uc IN {names} OR trim(TRAILING 's' FROM uc) IN {names})")


def _gutters(ls: str) -> str:
    """Lines split on runs of two or more spaces, with the value's start and end offsets."""
    header = (f"lower({clean('get(c, 0)')}) IN {in_list(fixed.KEY_HEADERS)}"
              f" AND lower({clean('get(c, 1)')}) IN {in_list(fixed.VALUE_HEADERS)}")
    value = f"IF(size(c) = 3 AND {_is_unit('get(c, 2)')}, concat(get(c, 1), ' ', trim(get(c, 2))), get(c, 1))"
    made = let("s1", "regexp_instr(t, '\\\\S') + length(get(c, 0))", let(
        "st", "s1 - 1 + regexp_instr(substring(t, s1), '\\\\S') - 1",
        f"named_struct('line', i, 'key', {clean('get(c, 0)')}, 'value', {clean(value)}, 'start', st, 'end', st + length(get(c, 1)))"))
    cells = r"\S+(?: \S+)*"
    return _kept(ls, let("c", f"regexp_extract_all(t, {q(cells)}, 0)", f"CASE WHEN size(c) >= 2 AND NOT ({header}) THEN {made} END"))


def _columns(ls: str) -> str:
    """Candidates sharing one value edge (within two places) on three or more lines.

    Equal groups go to the start edge, then the smallest offset.
    """
    def groups(edge, name):
        return (f"transform(array_distinct(transform(cs, c -> c.{name})), a -> named_struct("
                f"'n', size(filter(cs, c -> abs(c.{name} - a) <= 2)), 'edge', -{edge}, 'at', -a))")
    best = f"array_max(concat({groups(0, 'start')}, {groups(1, 'end')}))"
    near = "filter(cs, c -> abs(IF(b.edge = 0, c.start, c.end) + b.at) <= 2)"
    return let("cs", _gutters(ls), let("b", best, (
        f"transform(IF(coalesce(b.n, 0) >= 3, {near}, filter(cs, c -> false)), c -> named_struct('line', c.line, 'key', c.key, 'value', c.value))")))


def _read(pages: DataFrame, **columns: str) -> DataFrame:
    return stage(pages, **{name: let("ls", _LINES, sql) for name, sql in columns.items()})


def _exploded(pages: DataFrame, sql: str) -> DataFrame:
    return _read(pages, _p=sql).select("doc", "page", F.explode("_p").alias("p")).select("doc", "page", "p.line", "p.key", "p.value")


def line_pairs(pages: DataFrame) -> DataFrame:
    """S3: labelled lines of every page."""
    return _exploded(pages, _labelled("ls"))


def column_pairs(pages: DataFrame) -> DataFrame:
    """Pairs held apart by one gutter on three or more lines of a page."""
    return _exploded(pages, _columns("ls"))


def _grids(cells: DataFrame) -> DataFrame:
    """(doc, page, tbl, pairs), one row a grid: key and value columns by header words or first populated columns."""
    df = cells.select("doc", "page", "tbl", F.struct("row", "col", F.expr(f"coalesce({clean('text')}, '')").alias("text")).alias("c"))
    grid = df.groupBy("doc", "page", "tbl").agg(F.array_sort(F.collect_list("c")).alias("cells"))
    named = lambda words: f"filter(top, c -> lower(c.text) IN {in_list(words)})"
    # Rows without any text do not count.
    cells_of = let("full", "array_distinct(transform(filter(cells, c -> c.text <> ''), c -> c.row))", "filter(cells, c -> array_contains(full, c.row))")
    head = let("top", "filter(g, c -> c.row = g[0].row)", let("vs", f"transform({named(fixed.VALUE_HEADERS)}, c -> c.col)", (
        f"named_struct('last', top[size(top) - 1].col, 'k0', get(transform({named(fixed.KEY_HEADERS)}, c -> c.col), 0), 'vs', vs)")))
    shape = let("h", head, let("v0", "get(filter(h.vs, c -> h.k0 IS NULL OR c <> h.k0), 0)", let(
        "used", "array_sort(array_distinct(transform(filter(g, c -> c.text <> ''), c -> c.col)))", let("named", "h.k0 IS NOT NULL AND v0 IS NOT NULL", (
            "named_struct('key', IF(h.last >= 2, IF(named, h.k0, get(used, 0)), 0), 'value', IF(h.last >= 2, IF(named, v0, get(used, 1)), 1),"
            " 'skip', IF(h.last >= 2, named, coalesce(h.k0 = 0, false) OR array_contains(h.vs, 1)))")))))
    # Cells are in order of row and column, so each row's key and value columns are found in one sweep.
    side = lambda c: f"filter(g, c -> c.col = s.{c} AND NOT (s.skip AND c.row = g[0].row))"
    pairs = let("s", shape, let("vals", f"map_from_entries(transform({side('value')}, c -> struct(c.row, c.text)))", (
        f"transform({side('key')}, c -> named_struct('line', c.row, 'key', c.text, 'value', try_element_at(vals, c.row)))")))
    body = let("g", cells_of, f"IF(size(g) = 0, CAST(array() AS ARRAY<STRUCT<line:BIGINT,key:STRING,value:STRING>>), filter({pairs}, p -> {looks_like_spec('p.key', 'p.value')}))")
    return stage(grid, pairs=body).drop("cells")


def grid_pairs(cells: DataFrame) -> DataFrame:
    """Pairs of every cell grid."""
    return _grids(cells).select("doc", "page", "tbl", F.explode("pairs").alias("p")).select("doc", "page", "tbl", "p.line", "p.key", "p.value")


def page_program(pages: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """One row a page with its pairs (tier, seq, key, value, strategy), characters and whether it has text.

    A page reads its grids, else three or more labelled lines, else columns; stray labelled lines always.
    """
    def made(pairs, tbl="0L"):
        return f"transform({pairs}, p -> named_struct('tbl', CAST({tbl} AS BIGINT), 'line', CAST(p.line AS BIGINT), 'key', p.key, 'value', p.value))"
    df = _read(pages, _lines=made(_labelled("ls")), _columns=made(_columns("ls")))
    df = df.select("doc", "page", F.lit(1).alias("texts"), F.length("text").alias("chars"), (F.trim("text") != "").alias("filled"), "_lines", "_columns", F.expr(f"CAST(array() AS ARRAY<{_PAIR}>)").alias("_grid"))
    if cells is not None:
        empty = f"CAST(array() AS ARRAY<{_PAIR}>)"
        grid = _grids(cells).select("doc", "page", F.lit(0).alias("texts"), F.lit(None).cast("int").alias("chars"), F.lit(None).cast("boolean").alias("filled"), F.expr(empty).alias("_lines"),
                                    F.expr(empty).alias("_columns"), F.expr(made("pairs", "tbl")).alias("_grid"))
        df = (df.unionByName(grid).groupBy("doc", "page")
              .agg(F.sum("texts").alias("texts"), F.sum("chars").alias("chars"), F.max("filled").alias("filled"), *[F.flatten(F.collect_list(c)).alias(c) for c in ("_lines", "_columns", "_grid")]))
    def labelled(pairs, tier, strategy):
        return f"transform({pairs}, p -> named_struct('tier', {tier}, 'seq', struct(p.tbl, p.line), 'key', p.key, 'value', p.value, 'strategy', '{strategy}'))"
    columns = "IF(size(_grid) > 0 OR size(_lines) >= 3, filter(_columns, p -> false), _columns)"
    pairs = f"concat({labelled('_grid', 0, 'table:lines')}, {labelled(columns, 2, 'text:columns')}, {labelled('_lines', 3, 'text:line-pairs')})"
    return df.select("doc", "page", "texts", "chars", "filled", F.expr(pairs).alias("pairs"))


def _settled(program: DataFrame) -> DataFrame:
    """(doc, key, w): the first key wins over the pages of a document; the row of a null key has the document's sizes."""
    rows = program.select("doc", "page", "texts", "chars", "filled", F.explode(F.expr(
        "concat(array(CAST(NULL AS STRUCT<tier:INT,seq:STRUCT<tbl:BIGINT,line:BIGINT>,key:STRING,value:STRING,strategy:STRING>)), pairs)")).alias("p"))
    first = F.min_by(F.struct("p.value", "page", "p.strategy"), F.when(F.col("p").isNotNull(), F.struct("page", "p.tier", "p.seq")))
    sizes = [F.sum(F.when(F.col("p").isNull(), F.col(c))).alias(c) for c in ("texts", "chars")]
    return rows.groupBy("doc", "p.key").agg(first.alias("w"), *sizes, F.max(F.when(F.col("p").isNull(), F.col("filled"))).alias("filled"))


def document_specs(pages: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """First key wins over the pages of a document, citing the page it was read from."""
    return (_settled(page_program(pages, cells)).where("key IS NOT NULL")
            .select("doc", "key", "w.value", F.concat(F.lit("page "), F.col("w.page").cast("string")).alias("locator"), "w.strategy"))


def brand_table(spark) -> DataFrame:
    """(probe, canonical, pos) of the known brand spellings, lower case."""
    return spark.createDataFrame([(p, c, i) for i, (p, (c, _, _)) in enumerate(fixed.BRANDS.items())], "probe string, canonical string, pos int")


def _brands(pages: DataFrame, brands: DataFrame) -> DataFrame:
    """(doc, page, m, b): pages with their labelled part number and longest known brand.

    A spelling is filed under its first word run and proposed by the page's own word runs; what is proposed is
    confirmed at word boundaries.  Many brands make neither the plan nor a page's cost longer.
    """
    rx = F.concat(F.lit("\\b"), F.regexp_replace("probe", "([^A-Za-z0-9 _])", r"\\$1"), F.lit("\\b"))
    entries = durable(brands.select(F.regexp_extract("probe", r"\w+", 0).alias("run"), F.length("probe").alias("n"), (-F.col("pos")).alias("p"), F.col("canonical").alias("c"), "probe", rx.alias("rx")))
    mpn = f"nullif(trim(BOTH ' .' FROM regexp_extract(text, {q(fixed.DOC_MPN_RX)}, 1)), '')"
    runs = "array_distinct(concat(regexp_extract_all(l, '\\\\w+', 0), array('')))"
    fits = "contains(l, p.probe) AND l RLIKE p.rx"
    if entries.limit(BRANDS_HELD + 1).count() <= BRANDS_HELD:
        with held(filing(entries)) as table:
            found = let("ix", table, let("l", "lower(text)", f"array_max(transform(filter(flatten(transform({runs}, r -> {filed('slots', 'r')})), p -> {fits}), p -> named_struct('n', p.n, 'p', p.p, 'c', p.c)))"))
            return stage(pages, b=found, m=mpn).select("doc", "page", "m", "b")
    words = pages.select("doc", "page", F.expr(mpn).alias("m"), F.lower("text").alias("l"), F.explode_outer(F.expr(let("l", "lower(text)", runs))).alias("run"))
    met = words.join(entries, "run", "left").withColumn("b", F.expr("CASE WHEN contains(l, probe) AND l RLIKE rx THEN struct(n, p, c) END"))
    return met.groupBy("doc", "page").agg(F.max("m").alias("m"), F.max("b").alias("b"))


def document_identity(pages: DataFrame, brands: DataFrame | None = None) -> DataFrame:
    """Longest known brand, labelled part number, first heading-like line.

    ``brands`` (probe in lower case, canonical, pos) defaults to the known ones.
    """
    page_level = _brands(pages, brand_table(pages.sparkSession) if brands is None else brands)
    who = page_level.groupBy("doc").agg(F.max("b").alias("b"),
                                        F.min_by("m", F.when(F.col("m").isNotNull(), F.col("page"))).alias("mpn"))
    words = " OR ".join(f"contains(lower(t), {q(w)})" for w in fixed.HEADING_BOILERPLATE)
    heading = (lines(pages).withColumn("t", F.expr(clean("text")))
               .where(f"length(t) BETWEEN 8 AND 90 AND NOT (t RLIKE '^[A-Z0-9\\\\-/. ]+$') AND NOT ({words})"
                      " AND size(split(t, ' ')) >= 2")
               .groupBy("doc").agg(F.min_by("t", F.struct("page", "line")).alias("name")))
    return who.join(heading, "doc", "left").select("doc", F.col("b.c").alias("brand"), "mpn", "name")


def ingest_report(pages: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Pages, characters, pairs, strategies and notes per document, from one reading of its pages."""
    return (_settled(page_program(pages, cells)).groupBy("doc")
            .agg(F.sum("texts").alias("pages"), (F.sum("chars") + F.sum("texts") - 1).alias("text_chars"), F.max("filled").alias("_has"),
                 F.count("key").alias("spec_pairs"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("key").isNotNull(), F.col("w.strategy")))), ",").alias("strategies"))
            .where("pages > 0")
            .select("doc", "pages", "text_chars", "spec_pairs", "strategies",
                    F.expr("CASE WHEN spec_pairs = 0 AND NOT _has THEN 'No text layer found. This is likely a scanned"
                           " PDF; OCR would be required to read it.' WHEN spec_pairs = 0 THEN 'No spec table detected"
                           " — the full text was passed through for pattern extraction instead.' ELSE '' END").alias("note")))
