"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, fingerprints, language, licenses, mixing, near_dedup, neighbours, ngram_join, packing, secret_scan, spelling, vector_codes, warc
from .shared import shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def held_out(id_col: str = "doc_id"):
    """The third of the documents that no model of language learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


@query("op6_language_id")
def op6_language_id(spark, sf):
    """Language of every document; learned from the two thirds that are not held out."""
    docs = table(spark, sf, "documents")
    prototypes = language.fit(docs, ~held_out())
    return (language.predict(docs, prototypes, ["doc_id"])
            .select("doc_id", held_out().alias("held_out"), "lang_pred", "score"))


#: A source's weight and target by the closed form of the water level: with sources in the order of cap / weight, the
#: first k are clamped, where k is the least number for which the level of the others is not above the next cap.
_MIX = r"""
WITH d AS (SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
k AS (SELECT *, md5(concat_ws(':', '17', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, 2 * n AS cap, row_number() OVER (ORDER BY 2 * n / w, source) AS r FROM s),
l AS (SELECT *, (1.5 * (SELECT sum(n) FROM s) - coalesce(sum(cap) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
f AS (SELECT min(r) AS r FROM l WHERE level * w <= cap),
t AS (SELECT source, n, CASE WHEN r < (SELECT r FROM f) OR (SELECT r FROM f) IS NULL THEN cap::DOUBLE ELSE w * (SELECT level FROM l WHERE r = (SELECT r FROM f)) END AS target FROM l),
g AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal FROM t),
p AS (SELECT k.*, g.n, g.target, g.goal, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, n AS source_size, target, CAST(CASE WHEN n = 0 THEN 0 ELSE (goal // n) * size + greatest(0, least(size, goal % n - before)) END AS BIGINT) AS taken FROM p"""


@query("op8_source_mix", _MIX)
def op8_source_mix(spark, sf):
    """Words the mix takes of every document."""
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", *mixing.ADDED)


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op5_sequence_packing")
def op5_sequence_packing(spark, sf):
    """Every document's pieces and their places in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf, "documents"), tokenizer_path())


@query("op10_ngram_join")
def op10_ngram_join(spark, sf):
    """Groups of documents linked by a word 5-gram Jaccard similarity of 0.75 or more."""
    return ngram_join.join(table(spark, sf, "documents"))


@query("op4_secret_scan")
def op4_secret_scan(spark, sf):
    """Secrets of every document, by pattern and by Markov model."""
    docs = table(spark, sf, "documents")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    base = secret_scan.listed(F.array_sort(F.concat("assign", "access", "hex")))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(base, 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


#: A text is escaped if its turn, rendered as it is, would not parse back: it holds the closing marker, or an escape code.
_CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, CASE role WHEN 'system' THEN '<</SYS>>' WHEN 'user' THEN '[/INST]' WHEN 'assistant' THEN '</s>' ELSE '[/ROLE]' END AS closing,
  CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length(role) END AS marks FROM c),
f AS (SELECT *, marks + length(text) + CASE WHEN contains(text, closing) OR regexp_matches(text, '\\[bsl]') OR position(closing IN text || closing) <> length(text) + 1
  THEN length(text) - length(replace(replace(replace(text, chr(92), ''), '[', ''), '<', '')) ELSE 0 END AS chars FROM m)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, true AS same FROM f GROUP BY conv_id"""


@query("op1_chat_format", _CHAT)
def op1_chat_format(spark, sf):
    """Every conversation formatted, and read back from its formatted text."""
    talks = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    back = chat.recovered(chat.formatted(talks.unionByName(extra)))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), "same")


_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS keep FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keep IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keep IS DISTINCT FROM page_id THEN keep END AS refers_to FROM k"""


@query("op2_warc", _WARC)
def op2_warc(spark, sf):
    """Every page as a WARC record, read back from the archives."""
    pages = table(spark, sf, "pages")
    path = shared_dir(spark)
    warc.write_warc(warc.page_records(pages), path)
    back = warc.read_warc(spark, path).where(F.col("record_type").isin("response", "revisit"))
    kind = pages.schema["page_id"].dataType.simpleString()
    full = F.col("record_type") == "response"
    return back.select(warc.page_of(F.col("record_id"), kind).alias("page_id"),
                       F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
                       F.when(full, F.sha1("payload")).otherwise(F.substring("payload_digest", 6, 40)).alias("payload_digest"),
                       "record_type", warc.page_of(F.col("refers_to"), kind).alias("refers_to"))


@query("op3_license_scan", licenses.oracle())
def op3_license_scan(spark, sf):
    """Licence phrases of every document, and the labels they stand for."""
    docs = table(spark, sf, "documents")
    found = licenses.scan(docs, licenses.frequencies(docs))
    return found.select("doc_id", *[c for c in licenses.ADDED if c != "places"])


@query("op7_nearest_vectors")
def op7_nearest_vectors(spark, sf):
    """The five nearest vectors by cosine of every vector whose id is divisible by 50."""
    return neighbours.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op9_fingerprints")
def op9_fingerprints(spark, sf):
    """Fingerprints of every document and of its edited text, and how alike they are."""
    rows = fingerprints.fingerprints(table(spark, sf, "documents"))
    rows = rows.withColumns({f"__{n}": fingerprints.lanes(F.col(n)) for n in ("vector", "edited_vector", "next_vector")})
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprints.written(F.col("vector")).alias("fingerprint"),
                       fingerprints.written(F.col("edited_vector")).alias("edited_fingerprint"),
                       fingerprints.likeness(F.col("__vector"), F.col("__edited_vector")).alias("near_edited"),
                       fingerprints.likeness(F.col("__vector"), F.col("__next_vector")).alias("near_next"))


def _codes_sql() -> str:
    """Four unrolled rounds: assignment by dot products (whole numbers in doubles), floored means."""
    head = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS v, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT 4 * v + i AS r, v, vec_id, label, i AS part, q[i * (len(q) // 4) + 1:(i + 1) * (len(q) // 4)] AS x FROM v, range(4) t(i)),
c0 AS (SELECT part, entry, x FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < {vector_codes.ENTRIES})"""
    for k in range(vector_codes.ROUNDS + 1):
        head += f""",
a{k} AS MATERIALIZED (SELECT p.r, min(CAST(list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x) AS BIGINT) * 256 + c.entry) AS best FROM p JOIN c{k} c USING (part) GROUP BY p.r)"""
        if k < vector_codes.ROUNDS:
            head += f""",
s{k} AS (SELECT part, best % 256 AS entry, j, floor(sum(x[j]) / count(*)) AS m FROM (SELECT part, x, best, unnest(range(1, len(x) + 1)) AS j FROM p JOIN a{k} USING (r)) GROUP BY ALL),
n{k} AS (SELECT part, entry, list(m ORDER BY j) AS x FROM s{k} GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.x, c.x) AS x FROM c{k} c LEFT JOIN n{k} n USING (part, entry))"""
    k = vector_codes.ROUNDS
    return head + f""",
b AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(x) AS y, unnest(range(len(x))) AS j FROM c{k})),
e AS (SELECT any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM p JOIN a{k} USING (r) GROUP BY v)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e, b"""


@query("op11_vector_codes", _codes_sql())
def op11_vector_codes(spark, sf):
    """Product quantisation codes of all vectors, and a digest of the codebooks."""
    coded, books = vector_codes.codes(table(spark, sf, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


#: Accented letters have two bytes in UTF-8 and one in the text that edit distances are taken of.
_ACCENTED = "".join(map(chr, range(0xC0, 0x100)))
_ONE_BYTE = "".join(map(chr, range(33, 97))).replace("'", "''")
_SPELLING = f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS run FROM documents),
g AS MATERIALIZED (SELECT doc, run, count(*) AS n FROM d WHERE len(run) >= {spelling.LETTERS} GROUP BY ALL),
h AS (SELECT run, n, xor(4294967295, list_reduce(flatten(list_transform(string_split(doc || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [195, unicode(ch) - 64] END)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS h FROM g, t),
o AS (SELECT CASE WHEN h % {spelling.OMIT} = 0 THEN left(run, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n, translate(word, '{_ACCENTED}', '{_ONE_BYTE}') AS key, len(word) AS l FROM o WHERE len(word) >= {spelling.LETTERS} GROUP BY word HAVING sum(n) >= {spelling.OCCURRENCES}),
e AS (SELECT a.word, b.word AS near, b.n FROM v a JOIN v b ON b.l = a.l WHERE a.word <> b.word AND levenshtein(a.key, b.key) = 1
  UNION ALL SELECT a.word, b.word, b.n FROM v a JOIN v b ON b.l = a.l + 1 WHERE levenshtein(a.key, b.key) = 1
  UNION ALL SELECT b.word, a.word, a.n FROM v a JOIN v b ON b.l = a.l + 1 WHERE levenshtein(a.key, b.key) = 1),
f AS MATERIALIZED (SELECT v.word, v.n, e.c AS n_near, CASE WHEN e.best.n >= {spelling.RATIO} * v.n THEN e.best.word END AS form, CASE WHEN e.best.n >= {spelling.RATIO} * v.n THEN e.best.n END AS form_n
  FROM v LEFT JOIN (SELECT word, count(*) AS c, first({{'n': n, 'word': near}} ORDER BY n DESC, near) AS best FROM e GROUP BY word) e USING (word)),
w AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT w.word, f.form, steps + 1 FROM w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT word, form, root, n, coalesce(n_near, 0) AS n_near, form_n FROM f JOIN (SELECT word, arg_max(root, steps) AS root FROM w GROUP BY word) USING (word)"""


@query("op12_spelling_variants", _SPELLING)
def op12_spelling_variants(spark, sf):
    """The vocabulary of the documents: every word's near words, form and root."""
    return spelling.variants(table(spark, sf, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_near_dedup")
def op13_near_dedup(spark, sf):
    """Groups of documents linked by a word 5-gram Jaccard similarity of 0.85 or more, one of each kept."""
    return near_dedup.marked(table(spark, sf, "documents"))
