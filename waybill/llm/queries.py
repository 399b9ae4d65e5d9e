"""The registered queries of the subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm import chat, decontaminate, extract, lexical, mixing, secrets, sharding, simhash, spelling, topk, toxicity, urlfilter, warc
from waybill.llm.base import stored, table
from waybill.session import fresh_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


@query("op1_mix")
def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = mixing.mix(table(spark, sf_dir, "documents"))
    return times.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"), "times"
    )


@query("op2_extract")
def op2_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract.main_texts(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@query("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), inside=True)


#: A conversation that uses the control strings, added to the table's.
STRANGE = r"\### Assistant: </turn> ok"


@query(
    "op4_chat",
    r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    sized AS (
        SELECT *, 15 + length(regexp_replace(role, '([\\#/:])', '\\\1', 'g'))
                     + length(regexp_replace(text, '([\\#/])', '\\\1', 'g')) AS chars
        FROM turns),
    ends AS (
        SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS upto,
               max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last
        FROM sized)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           (coalesce(sum(upto) FILTER (WHERE role = 'assistant'), 0)
            + coalesce(sum(chars) FILTER (WHERE last IS NULL OR turn > last), 0))::BIGINT AS formatted_chars
    FROM ends GROUP BY conv_id
    """,
)
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    strange = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(STRANGE).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(strange)
    stream = chat.conversation_stream(turns)
    return chat.digests(stream, chat.examples(stream))


def _captures(pages: DataFrame) -> DataFrame:
    """Pages with the hour at which they were fetched, by page_id, within a year."""
    fetched = F.expr("timestampadd(HOUR, CAST(page_id * 7 % 8784 AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')")
    return pages.select("page_id", "url", fetched.alias("fetched_at"))


def _entries(pages: DataFrame) -> DataFrame:
    """A history of list entries for every host, domain and path beginning of ``pages``."""
    keys = urlfilter.keys_of(F.col("url"))
    listed = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), keys[k].alias("key")) for k in urlfilter.KINDS])).alias("k")
    known = (
        pages.select("page_id", listed)
        .where(F.col("k.key").isNotNull())
        .groupBy("k.kind", "k.key")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    )
    steps = F.explode(F.sequence(F.lit(0), F.when(F.col("n") > 1, 2).otherwise(1))).alias("step")
    turn = (F.col("first") + F.col("step")) % 3
    return known.select("kind", "key", "first", steps).select(
        "kind",
        "key",
        F.when(turn == 0, "block").when(turn == 1, "remove").otherwise("allow").alias("action"),
        F.expr("timestampadd(DAY, CAST(first * 13 % 250 + step * 45 AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')").alias("listed_at"),
    )


@query(
    "op5_urlfilter",
    r"""
    WITH parts AS (
        SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_hours((page_id * 7 % 8784)::INT) AS fetched_at,
               nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#@]*@)?([^/?#:]+)', 2)), '') AS host,
               regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^/?#]*)', 1) AS path
        FROM pages),
    captures AS (
        SELECT page_id, url, fetched_at, host, CASE WHEN path <> '' THEN host || path END AS prefix,
               nullif(regexp_extract(host, '([^.]+\.[^.]+)$', 1), '') AS domain
        FROM parts),
    known AS (
        SELECT kind, key, min(page_id) AS first, count(*) AS n
        FROM (SELECT 'prefix' AS kind, prefix AS key, page_id FROM captures
              UNION ALL SELECT 'host', host, page_id FROM captures
              UNION ALL SELECT 'domain', domain, page_id FROM captures)
        WHERE key IS NOT NULL GROUP BY kind, key),
    entries AS (
        SELECT kind, key, CASE (first + step) % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'remove' ELSE 'allow' END AS action,
               TIMESTAMP '2024-01-01 00:00:00' + to_days((first * 13 % 250 + step * 45)::INT) AS listed_at
        FROM known, (VALUES (0), (1), (2)) AS s(step) WHERE step <= CASE WHEN n > 1 THEN 2 ELSE 1 END),
    p AS (SELECT c.*, e.action AS pa, e.listed_at AS pd FROM captures c ASOF LEFT JOIN (FROM entries WHERE kind = 'prefix') e
          ON c.prefix = e.key AND c.fetched_at >= e.listed_at),
    h AS (SELECT p.*, e.action AS ha, e.listed_at AS hd FROM p ASOF LEFT JOIN (FROM entries WHERE kind = 'host') e
          ON p.host = e.key AND p.fetched_at >= e.listed_at),
    d AS (SELECT h.*, e.action AS da, e.listed_at AS dd FROM h ASOF LEFT JOIN (FROM entries WHERE kind = 'domain') e
          ON h.domain = e.key AND h.fetched_at >= e.listed_at),
    decided AS (
        SELECT *, CASE WHEN pa IN ('block', 'allow') THEN 'prefix' WHEN ha IN ('block', 'allow') THEN 'host'
                       WHEN da IN ('block', 'allow') THEN 'domain' END AS kind
        FROM d)
    SELECT page_id, url, fetched_at, kind, CASE kind WHEN 'prefix' THEN prefix WHEN 'host' THEN host WHEN 'domain' THEN domain END AS key,
           CASE kind WHEN 'prefix' THEN pa WHEN 'host' THEN ha WHEN 'domain' THEN da END AS action,
           CASE kind WHEN 'prefix' THEN pd WHEN 'host' THEN hd WHEN 'domain' THEN dd END AS listed_at,
           coalesce(CASE kind WHEN 'prefix' THEN pa WHEN 'host' THEN ha WHEN 'domain' THEN da END = 'block', false) AS blocked
    FROM decided
    """,
)
def op5_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judged(_captures(pages), _entries(pages))


@query(
    "op6_warc",
    """
    WITH hashed AS (
        SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
               min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
        FROM pages)
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
           array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               (((('0x' || substr(h, ((k // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31) + 1)::INT, 1)
               FOR k IN range(32)], '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM hashed
    """,
)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path, copies=True)
    pages = warc.read_pages(spark, path, lambda facts: stored(facts, "warc-records"))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)


@query(
    "op8_topk",
    """
    WITH whole AS (
        SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
        FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    ranked AS (
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
        FROM scored)
    SELECT * FROM ranked WHERE rank <= 5
    """,
)
def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_shards")
def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.tree_shards(table(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op11_secrets")
def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query(
    "op12_spelling",
    """
    WITH RECURSIVE steps AS (
        SELECT [list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR b IN range(256)] AS crc),
    runs AS (
        SELECT coalesce(doc_id::VARCHAR, '') || ':' AS id, run, count(*) AS n
        FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[a-z\u00C0-\u00FF]+')) AS run FROM documents)
        GROUP BY doc_id, run),
    hashed AS (
        SELECT run, n, xor(list_reduce(
                   [4294967295] || flatten([CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195, ord(c) - 64] END FOR c IN string_split(id || run, '')]),
                   lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h
        FROM runs, steps),
    counted AS (
        SELECT CASE WHEN h % 97 = 0 THEN run[1:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word, sum(n)::BIGINT AS n
        FROM hashed GROUP BY 1),
    words AS (SELECT word, n FROM counted WHERE length(word) >= 5 AND n >= 3),
    cuts AS (SELECT DISTINCT word, n, i, word[1:i - 1] || word[i + 1:] AS less FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
    pairs AS (
        SELECT a.word, b.word AS near, b.n FROM cuts a JOIN cuts b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.less = b.word
        UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.less = b.word),
    best AS (
        SELECT word, count(*) AS n_near, max(n) AS most, min(near) FILTER (n = top) AS form
        FROM (SELECT *, max(n) OVER (PARTITION BY word) AS top FROM pairs) GROUP BY word),
    forms AS (
        SELECT word, CASE WHEN most >= 2 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * n THEN most END AS form_n
        FROM words LEFT JOIN best USING (word)),
    chain AS (
        SELECT word, word AS at FROM forms
        UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.at WHERE forms.form IS NOT NULL)
    SELECT forms.word, forms.form, chain.at AS root, forms.n, forms.n_near, forms.form_n
    FROM forms JOIN chain USING (word) JOIN forms ends ON ends.word = chain.at WHERE ends.form IS NULL
    """,
)
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), length=5, least=3, thin=97))


@query(
    "op13_lexical",
    r"""
    WITH terms AS (
        SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
    counted AS (SELECT row, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
    lengths AS (SELECT row, sum(tf)::BIGINT AS n FROM counted GROUP BY row),
    whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM lengths),
    items AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark),
    weights AS (
        SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counted, whole GROUP BY term, docs),
    scored AS (
        SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length))))::BIGINT AS score
        FROM items JOIN weights USING (term) JOIN counted USING (term) JOIN lengths USING (row), whole
        GROUP BY item_id, row, doc_id),
    placed AS (
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
        FROM scored WHERE score > 0)
    SELECT * FROM placed WHERE rank <= 10
    """,
)
def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
