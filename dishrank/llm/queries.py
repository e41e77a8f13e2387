"""One query per operator over the whole test tables, and SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ann, bpe, exact_search, filter_audit, jaccard_join, language_id, line_dedup, packing, pii, spelling, substring_dedup,
    toxicity, warc,
)
from .staging import ready

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(step: Query) -> Query:
        _QUERIES[step.__name__] = step
        if oracle:
            _ORACLES[step.__name__] = oracle
        return step

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Words as the contracts of the set and window operators define them.
WORD = r"[^\x20\x09-\x0D]+"


@query(rf"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), windows AS (
    SELECT doc_id, p, list_aggregate(w[p:p + 12], 'string_agg', ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM words)
), first AS (
    SELECT s, min(doc_id) AS d FROM windows GROUP BY s HAVING count(DISTINCT doc_id) > 1
), covered AS (
    SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p
    FROM windows JOIN first USING (s) WHERE doc_id > d
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
    FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words)
    ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
""")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of each document once windows of smaller documents are removed."""
    rows = substring_dedup.remove_repeated(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes decoded from them."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.round_trip_column(F.col("text"), ranks, public_tokenizers.PATTERN)
    found = table(spark, sf_dir, "documents").select("doc_id", both.alias("r")).select("doc_id", "r.ids", "r.decoded")
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces and their places in sequences of 2048 tokens."""
    return packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents not held out."""
    return language_id.identify(table(spark, sf_dir, "documents"))


@query()
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the personal data in every document."""
    found = table(spark, sf_dir, "documents").select("doc_id", pii.spans_column(F.col("text")).alias("s"))

    def of(*kinds: str):
        return F.filter("s", lambda s: s["kind"].isin(list(kinds)))

    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    return found.select(
        "doc_id", *counts, F.size("s").cast("long").alias("n_all"), F.sha2(pii.joined_spans(of(*pii.BASE_KINDS)), 256).alias("base_sha256"),
        pii.joined_spans(F.col("s")).alias("spans"),
    )


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels not held out."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("""
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html FROM pages
), f AS (
    SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY html
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (html)
""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, found in their index and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query(rf"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, list_aggregate(w[p:p + 4], 'string_agg', ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
    SELECT x.doc_id AS a, y.doc_id AS b
    FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id
    JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
    GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(nx.n) + any_value(ny.n) - count(*))
), reach AS (
    WITH RECURSIVE r(doc_id, c) AS (
        SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, links.b FROM r JOIN links ON links.a = r.c
    ) SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id)
""")
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and the smallest document that links reach."""
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))


@query("""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 10
""")
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer inner products of every hundredth vector."""
    return exact_search.exact_top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


@query()
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty neighbours of every twentieth vector, found in the graph index."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def misspelt(id: Column, word: Column) -> Column:
    """The word; one in 199 of a document's words, picked by a checksum, without one letter."""
    h = F.crc32(F.concat_ws(":", F.coalesce(id.cast("string"), F.lit("")), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    cut = F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))
    return F.when(h % 199 == 0, cut).otherwise(word)


# The checksum has no SQL function: its table is built bit by bit and folded over the bytes.
@query("""
WITH RECURSIVE bits(i, c, k) AS (
    SELECT i, i::BIGINT, 0 FROM range(256) t(i) UNION ALL
    SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
    SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), runs AS (
    SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), lower AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
    FROM runs GROUP BY ALL
), bytes AS (
    SELECT w, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM lower
), summed AS (
    SELECT w, n, xor(list_reduce(
        list_transform(range(1, length(x), 2), lambda p: ('0x' || substr(x, p::INT, 2))::BIGINT),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT
    ), 4294967295) AS h FROM bytes, crc
), typed AS (
    SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n
    FROM summed
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS (
    SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS c
    FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS p FROM words)
), near AS (
    SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.c = b.c AND a.p = b.p AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.c = b.word
    UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.c = b.word
), best AS (
    SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word
), formed AS (
    SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form,
           CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
    FROM words LEFT JOIN best USING (word)
), chain(word, root) AS (
    SELECT word, word FROM formed UNION ALL
    SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN (
    SELECT c.word, c.root FROM chain c JOIN formed e ON e.word = c.root WHERE e.form IS NULL
) r USING (word)
""")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with the frequent word that it is one edit from."""
    found = spelling.runs(table(spark, sf_dir, "documents"))
    lower = found.select("id", line_dedup.lower_ascii(F.col("run")).alias("run"))
    words = lower.select(misspelt(F.col("id"), F.col("run")).alias("word"))
    return spelling.variant_groups(spelling.vocabulary(words))


@query("""
WITH lines AS (
    SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS p
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
    SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
    SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT doc_id, line, p, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN frequent USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that five documents hold."""
    rows = line_dedup.drop_frequent(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(rf"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
    FROM documents
), l AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), f AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
           + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
           + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask
    FROM d LEFT JOIN l USING (doc_id)
), c AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
    SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS x,
           1 << (strpos('ABCDE', substr(filter_order, step::INT, 1)) - 1) AS bit,
           list_sum(list_transform(range(1, step), lambda k: 1 << (strpos('ABCDE', substr(filter_order, k::INT, 1)) - 1))) AS before
    FROM orders, range(1, 6) r(step)
), counted AS (
    SELECT part, filter_order, step, x,
           sum(n) FILTER (mask & (bit | coalesce(before, 0)::INT) = 0) AS kept,
           sum(n) FILTER (mask & bit > 0 AND mask & coalesce(before, 0)::INT = 0) AS removed,
           sum(n) FILTER (mask & bit > 0 AND mask & coalesce(before, 0)::INT > 0) AS redundant,
           sum(n) FILTER (mask = bit) AS unique_fails,
           sum(good) FILTER (mask & bit > 0 AND mask & coalesce(before, 0)::INT = 0) AS good_lost,
           sum(toxic) FILTER (mask & bit > 0 AND mask & coalesce(before, 0)::INT = 0) AS toxic_lost
    FROM c, steps GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, x), 0)::BIGINT AS shapley
FROM counted
""")
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source, in every order."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
