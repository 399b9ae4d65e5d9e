"""Row steps, scalar functions and registries."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import functions as F

from waybill.functions import calendar, privacy, sampling, sqltext, text
from waybill.functions.convert import convert, parse_date_multi, value_map
from waybill.functions.numbers import half_up, money, price, ratio, total
from waybill.functions.registry import transforms, validators
from waybill.operators import documents, rows
from waybill.operators.quality import rule_report
from waybill.operators.rows import Filter, Mapping, Transform
from waybill.operators.textdiff import line_diff
from waybill.plans.registry import query

ORDER_FILTERS = [
    Filter("o_totalprice >= 100000"),
    Filter("o_orderstatus IN ('F', 'O')"),
    Filter("o_orderkey < 0", enabled=False),
]


@query("filter_conjunction", "SELECT * FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus IN ('F', 'O')")
def _(t):
    return rows.filter_conjunction(t.orders, ORDER_FILTERS)


@query("transform_conditional", """
    SELECT * REPLACE (lower(CASE WHEN o_orderstatus = 'F' THEN upper(o_orderpriority) ELSE o_orderpriority END) AS o_orderpriority),
           CASE WHEN o_totalprice > 200000 THEN 'BIG' END AS size_class
    FROM orders""")
def _(t):
    steps = [
        Transform("o_orderpriority", "o_orderpriority", "UPPER", condition="o_orderstatus = 'F'"),
        Transform("o_orderpriority", "o_orderpriority", "LOWER"),
        Transform("o_totalprice", "size_class", "COMPUTE", {"expression": "'BIG'"}, condition="o_totalprice > 200000"),
    ]
    return rows.transform_rows(t.orders, steps)


@query("map_columns", """
    SELECT CAST(c_custkey AS VARCHAR) AS customer_id, upper(c_name) AS name, CAST(c_acctbal AS DECIMAL(18,2)) AS balance,
           'waybill' AS source_system, CAST(c_nationkey AS BIGINT) AS nation
    FROM customer""")
def _(t):
    return rows.map_columns(
        t.customer,
        [
            Mapping("c_custkey", "customer_id", "VARCHAR", required=True),
            Mapping("c_name", "name", transform="UPPER"),
            Mapping("c_acctbal", "balance", "DECIMAL(18,2)"),
            Mapping("source_system", "source_system", default="waybill", required=True),
            Mapping("c_phone", "phone"),
            Mapping("c_nationkey", "nation", "INTEGER"),
        ],
    )


@query("value_map", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN NULL ELSE o_orderstatus END AS with_original,
           CASE o_orderstatus WHEN 'F' THEN 'finished' ELSE 'other' END AS with_default
    FROM orders""")
def _(t):
    status = F.col("o_orderstatus")
    return t.orders.select(
        "o_orderkey",
        value_map(status, {"F": "finished", "O": None}).alias("with_original"),
        value_map(status, {"F": "finished"}, "other").alias("with_default"),
    )


@query("convert_types", """
    SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, TRY_CAST(o_totalprice AS DECIMAL(18,2)) AS price_decimal,
           TRY_CAST(o_totalprice AS DOUBLE) AS price_double,
           CAST(trunc(TRY_CAST(o_totalprice AS DOUBLE)) AS BIGINT) AS price_integer,
           CAST(CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS BOOLEAN) AS finished, o_orderpriority
    FROM {orders_staged}""")
def _(t):
    amount = convert(F.col("o_totalprice"), "DOUBLE", "null")
    return t.orders_staged.select(
        convert(F.col("o_orderkey"), "BIGINT").alias("o_orderkey"),
        convert(F.col("o_totalprice"), "DECIMAL(18,2)", "null").alias("price_decimal"),
        amount.alias("price_double"),
        convert(amount, "INTEGER").alias("price_integer"),
        convert(F.when(F.col("o_orderstatus") == "F", "true").otherwise("false"), "BOOLEAN").alias("finished"),
        convert(F.col("o_orderpriority"), "GEOGRAPHY").alias("o_orderpriority"),
    )


@query("parse_date_multi", """
    SELECT CAST(s.o_orderkey AS BIGINT) AS o_orderkey, o.o_orderdate AS parsed, CAST(o.o_orderdate AS DATE) AS parsed_date
    FROM {orders_staged} s JOIN orders o ON CAST(s.o_orderkey AS BIGINT) = o.o_orderkey""")
def _(t):
    return t.orders_staged.select(
        F.col("o_orderkey").cast("long").alias("o_orderkey"),
        parse_date_multi(F.col("o_orderdate")).alias("parsed"),
        parse_date_multi(F.col("o_orderdate")).cast("date").alias("parsed_date"),
    )


@query("compute_expr", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
           CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * (1 + CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) AS net_price,
           l_quantity AS quantity, 'EUR' AS currency
    FROM lineitem""")
def _(t):
    net = "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * (1 + CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE)"
    steps = [
        Transform("l_extendedprice", "net_price", "COMPUTE", {"expression": net}),
        Transform("l_quantity", "quantity", "COMPUTE", {"expression": "l_quantity"}),
        Transform("l_quantity", "currency", "COMPUTE", {"expression": "'EUR'"}),
    ]
    return rows.transform_rows(t.lineitem, steps).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "net_price", "quantity", "currency"
    )


@query("incremental_filter", """
    SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01'""")
def _(t):
    return rows.incremental_sync(t.orders, "o_orderdate", "2000-01-01 00:00:00")


@query("audit_search", """
    SELECT * FROM (SELECT event_id, ts, 'u' || user_id AS user_name, event_type, 'res/' || (event_id % 50) AS resource,
                          CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS result FROM events)
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25' AND event_type = 'click' AND result = 'success'
      AND contains(resource, 's/1') AND user_name = 'u7'
    ORDER BY ts DESC, event_id DESC LIMIT 50""")
def _(t):
    from waybill.operators.history import event_search

    log = t.events.select(
        "event_id",
        "ts",
        F.concat(F.lit("u"), F.col("user_id")).alias("user_name"),
        "event_type",
        F.concat(F.lit("res/"), F.col("event_id") % 50).alias("resource"),
        F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("result"),
    )
    return event_search(
        log,
        "ts",
        "event_id",
        since="2024-01-05 00:00:00",
        until="2024-01-25 00:00:00",
        equal={"event_type": "click", "result": "success", "user_name": "u7"},
        contains={"resource": "s/1"},
        limit=50,
    )


@query("history_filter", """
    SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20'
      AND contains(event_type, 'ic') ORDER BY ts DESC, event_id DESC LIMIT 100""")
def _(t):
    from waybill.operators.history import event_search

    return event_search(
        t.events.select("event_id", "ts", "event_type"),
        "ts",
        "event_id",
        since="2024-01-10 00:00:00",
        until="2024-01-20 00:00:00",
        contains={"event_type": "ic"},
        limit=100,
    )


@query("query_log_lint", """
    WITH l AS (SELECT *, lower(sql_text) AS low FROM {query_log_sql}),
    h AS (
        SELECT event_id, 'missing_filter' AS rule, 'high' AS severity FROM l WHERE est_rows > 1000000 AND NOT contains(low, 'where')
        UNION ALL SELECT event_id, 'select_star', 'medium' FROM l WHERE contains(low, 'select *') OR contains(low, 'select' || chr(10) || '*')
        UNION ALL SELECT event_id, 'cartesian_join', 'high' FROM l WHERE contains(low, 'join') AND NOT contains(low, ' on ')
        UNION ALL SELECT event_id, 'order_without_limit', 'low' FROM l WHERE contains(low, 'order by') AND NOT contains(low, 'limit')
        UNION ALL SELECT event_id, 'subquery_to_cte', 'medium' FROM l WHERE len(regexp_extract_all(low, 'select')) > 1 AND contains(low, 'from (')
        UNION ALL SELECT event_id, 'expensive_distinct', 'medium' FROM l WHERE contains(low, 'distinct') AND est_rows > 100000
        UNION ALL SELECT event_id, 'large_in_clause', 'warning' FROM l WHERE length(regexp_extract(sql_text, '\\sIN\\s*\\(([^)]*)\\)', 1)) >= 1000
        UNION ALL SELECT event_id, 'case_sensitive_like', 'warning' FROM l WHERE regexp_matches(sql_text, '\\sLIKE\\s+''[^'']+''') AND NOT contains(low, 'ilike'))
    SELECT * FROM h""")
def _(t):
    hits = sqltext.lint(F.col("sql_text"), F.col("est_rows"))
    return t.query_log_sql.select("event_id", F.explode(hits).alias("hit")).select("event_id", "hit.rule", "hit.severity")


@query("statement_classify", """
    WITH s AS (
        SELECT upper(sql_text) AS u, regexp_extract(upper(ltrim(sql_text)), '^(INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|MERGE|COPY)', 1) AS k
        FROM {query_log_sql}),
    c AS (
        SELECT CASE WHEN k = '' THEN 'UNKNOWN' ELSE k END AS statement_type,
               CASE k WHEN 'INSERT' THEN regexp_extract(u, 'INTO\\s+(\\S+)', 1) WHEN 'UPDATE' THEN regexp_extract(u, 'UPDATE\\s+(\\S+)', 1)
                      WHEN 'DELETE' THEN regexp_extract(u, 'FROM\\s+(\\S+)', 1) END AS target_table
        FROM s)
    SELECT statement_type, target_table, count(*) AS statements FROM c GROUP BY 1, 2""")
def _(t):
    sql = F.col("sql_text")
    return t.query_log_sql.groupBy(
        sqltext.statement_type(sql).alias("statement_type"), sqltext.target_table(sql).alias("target_table")
    ).agg(F.count("*").alias("statements"))


@query("error_classify", """
    SELECT CASE WHEN regexp_matches(lower(message), 'connection reset|connection refused|timeout|deadlock|too many connections|resource busy') THEN 'retryable'
                WHEN contains(message, 'does not exist') OR contains(message, 'not found') THEN 'not_found'
                WHEN contains(message, 'syntax error') THEN 'syntax' ELSE 'other' END AS error_class,
           count(*) AS errors, min(event_id) AS first_event
    FROM {error_log} GROUP BY 1""")
def _(t):
    return t.error_log.groupBy(sqltext.error_class(F.col("message")).alias("error_class")).agg(
        F.count("*").alias("errors"), F.min("event_id").alias("first_event")
    )


def _props(t):
    """Event properties with two more keys, one of them sensitive by name."""
    return t.events.withColumn(
        "props",
        F.map_concat(
            F.from_json("props", "map<string,string>"),
            F.create_map(
                F.lit("api_key"), F.col("event_type"), F.lit("Auth_note"), F.col("user_id").cast("string"),
                F.lit("debug_id"), F.col("event_id").cast("string"),
            ),
        ),
    )


def _flat(entries):
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
    )


@query("property_gate", """
    SELECT event_id, event_type, 'Auth_note=' || user_id || ',api_key=' || event_type || ',k=' || json_extract_string(props, '$.k') AS props
    FROM events WHERE event_type IN ('error', 'signup')""")
def _(t):
    from waybill.operators.events import property_gate

    return property_gate(
        _props(t),
        "props",
        "event_type",
        exclude=["debug_*", "*.tmp"],
        required_level={"error": "minimal", "signup": "basic", "click": "full", "view": "full", "purchase": "full"},
        consent="basic",
    ).select("event_id", "event_type", _flat(F.col("props")).alias("props"))


@query("event_enrich", """
    SELECT event_id, event_type, value, 'prod' AS env, CASE WHEN value > 100 THEN 'high' ELSE 'normal' END AS level
    FROM events WHERE event_type IN ('click', 'purchase') AND value > 10 AND user_id % 2 = 0""")
def _(t):
    from waybill.operators.events import enrich

    return enrich(
        t.events.select("event_id", "event_type", "value", "user_id"),
        "event_type",
        allowed=["click", "purchase"],
        conditions={"worth": "value > 10", "even_user": "user_id % 2 = 0"},
        static={"env": "prod"},
        computed={"level": "CASE WHEN value > 100 THEN 'high' ELSE 'normal' END"},
    ).drop("user_id")


@query("string_builtins", """
    SELECT doc_id, upper(source) AS upper_source, lower(text) AS lower_text,
           regexp_replace(regexp_replace(chr(160) || chr(9) || text || chr(8195) || ' ', '^[\\p{Z}\\s\\x{0b}\\x{85}]+', ''), '[\\p{Z}\\s\\x{0b}\\x{85}]+$', '') AS trimmed,
           regexp_replace(text, '[0-9]+', '#', 'g') AS replaced
    FROM documents""")
def _(t):
    known = transforms()
    c = F.col("text")
    padded = F.concat(F.lit(" \t"), c, F.lit("  "))
    return t.documents.select(
        "doc_id",
        known["UPPER"](F.col("source")).alias("upper_source"),
        known["LOWER"](c).alias("lower_text"),
        known["TRIM"](padded).alias("trimmed"),
        known["REGEXP_REPLACE"](c, "[0-9]+", "#").alias("replaced"),
    )


@query("normalize_sql", """
    SELECT event_id, upper(trim(regexp_replace(regexp_replace(regexp_replace(sql_text, '/\\*[\\s\\S]*?\\*/', '', 'g'), '--[^\\n]*', '', 'g'), '\\s+', ' ', 'g'))) AS normalized
    FROM {query_log_sql}""")
def _(t):
    return t.query_log_sql.select("event_id", text.normalize_sql(F.col("sql_text")).alias("normalized"))


# fixed values, written out again so that a wrong entry in the code does not pass on both sides
EXPECTED_PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "ipv4": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "home_path": r"(/Users/[^/\s]+|/home/[^/\s]+|C:\\Users\\[^\\\s]+)",
    "token": r"(?i)(token|key|secret|password|pwd|api[_-]?key)[\s:=]+[\S]+",
}
EXPECTED_KEYWORDS = [
    "credit card", "creditcard", "cc number", "social security", "ssn", "sin", "bank account", "routing number", "pin", "cvv", "cvc",
]


def _sql_redact(c: str, extra: tuple[str, ...] = (), strict: bool = True) -> str:
    for p in [*EXPECTED_PATTERNS.values(), *extra]:
        c = f"regexp_replace({c}, '{p}', '[REDACTED]', 'g')"
    for w in EXPECTED_KEYWORDS:
        c = f"regexp_replace({c}, '{privacy.keyword_pattern(w, strict)}', '[REDACTED]', 'g')"
    return c


@query("redact_text", f"SELECT doc_id, {_sql_redact('text')} AS text, {_sql_redact('text', strict=False)} AS text_any_place FROM documents")
def _(t):
    whole, part = privacy.redact(F.col("text")), privacy.redact(F.col("text"), strict=False)
    return t.documents.select("doc_id", whole.alias("text"), part.alias("text_any_place"))


@query("custom_patterns", f"SELECT doc_id, {_sql_redact('text', ('[0-9]{6,}',)).replace(EXPECTED_PATTERNS['ipv4'], 'never matches this')} AS text FROM documents")
def _(t):
    return t.documents.select(
        "doc_id", privacy.redact(F.col("text"), extra=["[0-9]{6,}"], without=[privacy.PATTERNS["ipv4"]]).alias("text")
    )


@query("redaction_counts", "SELECT lang, count(*) AS documents, " + ", ".join(
    f"CAST(sum(len(regexp_extract_all(text, '{p}'))) AS BIGINT) AS {name}" for name, p in EXPECTED_PATTERNS.items()
) + " FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("lang").agg(
        F.count("*").alias("documents"),
        *[F.sum(privacy.pattern_count(F.col("text"), p)).alias(name) for name, p in privacy.PATTERNS.items()],
    )


@query("mask_sensitive_keys", """
    SELECT event_id, '[SENSITIVE_KEY]=' || user_id || ',[SENSITIVE_KEY]_2=' || event_type || ',debug_id=' || event_id || ',k=' || json_extract_string(props, '$.k') AS masked_keys,
           'Auth_note=' || user_id || ',api_key=[REDACTED],debug_id=' || event_id || ',k=' || json_extract_string(props, '$.k') AS audit_values
    FROM events""")
def _(t):
    return _props(t).select(
        "event_id",
        _flat(privacy.mask_sensitive_keys(F.col("props"))).alias("masked_keys"),
        _flat(privacy.redact_sensitive_values(F.col("props"))).alias("audit_values"),
    )


@query("mask_sensitive_documents", """
    SELECT event_id, CASE event_id % 5
             WHEN 4 THEN 'broken {mail [REDACTED]'
             WHEN 3 THEN '{"[SENSITIVE_KEY]":"t' || user_id || '","[SENSITIVE_KEY]_2":{"[SENSITIVE_KEY]":1,"who":"[REDACTED]"},"k":' || json_extract_string(props, '$.k') || '}'
             ELSE '{"login":{"[SENSITIVE_KEY]":' || event_id || ',"[SENSITIVE_KEY]_2":"p' || event_id
                  || '","session":{"[SENSITIVE_KEY]":"abc","[SENSITIVE_KEY]_2":"x","days":[1,"[REDACTED]",{"[SENSITIVE_KEY]":null,"mail":"[REDACTED]"}]},"user":"u' || user_id
                  || '"},"note":"mail [REDACTED] now","tags":["' || event_type || '",[],{},true]}'
           END AS document
    FROM events""")
def _(t):
    return documents.masked_documents(t.event_documents, "document")


@query("hash_identifier", "SELECT c_custkey, left(sha256(c_name), 32) AS hashed FROM customer")
def _(t):
    return t.customer.select("c_custkey", privacy.hash_identifier(F.col("c_name")).alias("hashed"))


@query("pseudonymize_email", "SELECT c_custkey, left(md5(email), 8) || '@' || split_part(email, '@', 2) AS email FROM {users}")
def _(t):
    return t.users.select("c_custkey", privacy.pseudonymize_email(F.col("email")).alias("email"))


@query("mask_email_by_role", "SELECT c_custkey, role, CASE WHEN role = 'ADMIN' THEN email ELSE '***@***.***' END AS email FROM {users}")
def _(t):
    return t.users.select("c_custkey", "role", privacy.mask_email_by_role(F.col("email"), F.col("role")).alias("email"))


@query("classify_and_mask", """
    SELECT c_custkey, c_name, '***@***.***' AS email, role, '***' || right(regexp_replace(ssn, '[^0-9]', '', 'g'), 4) AS ssn,
           '***' || right(regexp_replace(phone, '[^0-9]', '', 'g'), 4) AS phone, '[MASKED]' AS address
    FROM {users}""")
def _(t):
    return t.users.select(*privacy.masked_columns(t.users.columns))


@query("truncate_values", "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", text.truncated(F.col("text")).alias("text"))


@query("encrypt_column", "SELECT c_custkey, c_name AS decrypted, true AS changed FROM customer")
def _(t):
    key = F.unhex(F.sha2(F.lit("a key the caller supplies"), 256))
    sealed = t.customer.select("c_custkey", "c_name", privacy.encrypt(F.col("c_name"), key).alias("sealed"))
    return sealed.select(
        "c_custkey", privacy.decrypt(F.col("sealed"), key).alias("decrypted"), (F.col("sealed") != F.col("c_name")).alias("changed")
    )


@query("content_checksum", "SELECT doc_id, sha256(text) AS checksum FROM documents")
def _(t):
    return t.documents.select("doc_id", text.content_checksum(F.col("text")).alias("checksum"))


@query("date_dimension", """
    WITH r AS (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders),
    d AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM r)
    SELECT year(date) * 10000 + month(date) * 100 + day(date) AS date_key, date, year(date) AS year, quarter(date) AS quarter, month(date) AS month,
           monthname(date) AS month_name, weekofyear(date) AS week_of_year, day(date) AS day_of_month, isodow(date) AS day_of_week,
           dayname(date) AS day_name, isodow(date) >= 6 AS is_weekend, strftime(date, '%m-%d') IN ('01-01', '12-25') AS is_holiday,
           year(date + INTERVAL 6 MONTH) AS fiscal_year, quarter(date_trunc('month', date) + INTERVAL 6 MONTH) AS fiscal_quarter
    FROM d""")
def _(t):
    span = t.orders.agg(F.min("o_orderdate").cast("date").alias("lo"), F.max("o_orderdate").cast("date").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return days.select(*calendar.calendar_columns(F.col("day"), ["01-01", "12-25"], fiscal_start=7))


@query("json_extract_typed", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.k') AS k_text,
           TRY_CAST(json_extract_string(props, '$.missing') AS DOUBLE) AS missing
    FROM events""")
def _(t):
    parsed = t.events.select("event_id", F.parse_json("props").alias("v"))
    return parsed.select(
        "event_id",
        F.try_variant_get("v", "$.k", "int").alias("k"),
        F.try_variant_get("v", "$.k", "string").alias("k_text"),
        F.try_variant_get("v", "$.missing", "double").alias("missing"),
    )


@query("json_build", """
    SELECT event_id, '{"id":' || event_id || ',"type":"' || event_type || '","updated":"true"}' AS document,
           '["' || event_type || '","user-' || user_id || '"]' AS tags, 2 AS n_tags, event_type || '/user-' || user_id AS tag_text
    FROM events""")
def _(t):
    base = F.create_map(F.lit("type"), F.col("event_type"))
    inserted = F.map_concat(base, F.create_map(F.lit("updated"), F.lit("true")))
    tags = F.array(F.col("event_type"), F.concat(F.lit("user-"), F.col("user_id")))
    doc = F.struct(F.col("event_id").alias("id"), inserted["type"].alias("type"), inserted["updated"].alias("updated"))
    return t.events.select(
        "event_id", F.to_json(doc).alias("document"), F.to_json(tags).alias("tags"), F.size(tags).alias("n_tags"), F.array_join(tags, "/").alias("tag_text")
    )


@query("trace_sample", """
    WITH h AS (SELECT event_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(CAST(event_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
                                            lambda a, b: (a * 31 + b) % 4294967296) AS hash FROM events)
    SELECT event_id, hash FROM h WHERE hash % 100 < 25""")
def _(t):
    ident = F.col("event_id").cast("string")
    return t.events.where(sampling.keep_trace(ident, 0.25)).select("event_id", sampling.sample_hash(ident).alias("hash"))


@query("line_diff", """
    WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
    b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM {documents_edited})
    SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, a.line AS old_line, b.line AS new_line,
           CASE WHEN b.line IS NULL THEN '-' WHEN a.line IS NULL THEN '+' WHEN a.line <> b.line THEN '~' ELSE '=' END AS mark
    FROM a FULL OUTER JOIN b USING (doc_id, line_no)""")
def _(t):
    return line_diff(t.documents, t.documents_edited, "doc_id", "text")


@query("ratio_math", """
    WITH g AS (SELECT l_orderkey, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) FILTER (l_returnflag = 'R') AS DOUBLE) AS returned,
                      CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS total FROM lineitem GROUP BY 1)
    SELECT l_orderkey, coalesce(coalesce(returned, 0) / nullif(total, 0), 0) AS share,
           floor(abs(coalesce(returned, 0) - total) / n * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS kept_per_line
    FROM g""")
def _(t):
    returned = F.coalesce(total(F.when(F.col("l_returnflag") == "R", price("l_quantity"))), F.lit(0.0))
    whole = total(price("l_quantity"))
    return t.lineitem.groupBy("l_orderkey").agg(
        ratio(returned, whole).alias("share"), half_up(F.abs(returned - whole) / F.count("*"), 2).alias("kept_per_line")
    )


@query("lookup_enrich", """
    SELECT c_custkey, c_name, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS nation
    FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 7) n ON c_nationkey = n_nationkey""")
def _(t):
    known = t.nation.where("n_nationkey <> 7")
    return rows.lookup_enrich(t.customer, "c_nationkey", known, "n_nationkey", "n_name", "nation").select("c_custkey", "c_name", "nation")


@query("register_transform", "SELECT c_custkey, '<' || c_mktsegment || '>' AS segment, left(c_name, 4) AS prefix FROM customer")
def _(t):
    known = transforms()
    known.register("BRACKET", lambda c, left, right: F.concat(F.lit(left), c, F.lit(right)))
    known.register("PREFIX", lambda c, n: F.left(c, F.lit(n)))
    steps = [
        Transform("c_mktsegment", "segment", "BRACKET", {"left": "<", "right": ">"}),
        Transform("c_name", "prefix", "PREFIX", {"n": 4}),
    ]
    return rows.transform_rows(t.customer, steps, known).select("c_custkey", "segment", "prefix")


def _backwards(texts):
    return pc.utf8_reverse(texts)


def _spread(values, others):
    return pc.max_element_wise(values, others, skip_nulls=False)


@query("register_vectorised", """
    SELECT c_custkey, reverse(c_name) AS backwards, reverse(c_mktsegment) || '!' AS in_text, greatest(c_acctbal, c_custkey::DOUBLE) AS larger FROM customer""")
def _(t):
    known = transforms()
    known.register_vectorised(t.spark, "BACKWARDS", _backwards, "string")
    known.register_vectorised(t.spark, "LARGER_OF", _spread, "double")
    steps = [
        Transform("c_name", "backwards", "BACKWARDS"),
        Transform("c_mktsegment", "in_text", "COMPUTE", {"expression": "BACKWARDS(c_mktsegment) || '!'"}),
        Transform("c_acctbal", "larger", "COMPUTE", {"expression": "LARGER_OF(c_acctbal, CAST(c_custkey AS DOUBLE))"}),
    ]
    return rows.transform_rows(t.customer, steps, known).select("c_custkey", "backwards", "in_text", "larger")


@query("register_validator", """
    SELECT 'cheap' AS rule, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS result, n AS failed_rows
    FROM (SELECT count(*) FILTER (p_retailprice > 1800) AS n FROM part)
    UNION ALL SELECT 'name', CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END, n FROM (SELECT count(*) FILTER (p_name IS NULL) AS n FROM part)""")
def _(t):
    known = validators()
    known.register("BELOW", lambda column, limit: F.count_if(F.col(column) > limit))
    return rule_report(t.part, {"cheap": known["BELOW"]("p_retailprice", 1800), "name": known["NOT_NULL"]("p_name")})


@query("aggregate_transform", """
    SELECT o_orderpriority, o_orderstatus, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, max(o_orderdate) AS newest
    FROM orders GROUP BY 1, 2""")
def _(t):
    return rows.aggregate_transform(
        t.orders,
        ["o_orderpriority", "o_orderstatus"],
        {"orders": "count(*)", "amount": "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)", "newest": "max(o_orderdate)"},
    )


@query("migration_templates", """
    SELECT 'full-table-copy' AS template, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders
    UNION ALL SELECT 'incremental-sync', count(*), CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders WHERE o_orderdate > TIMESTAMP '1999-06-01'
    UNION ALL SELECT 'data-transformation', count(*), CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders
    UNION ALL SELECT 'large-table-streaming', count(*), CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders WHERE o_orderkey >= 500""")
def _(t):
    made = {
        "full-table-copy": rows.full_table_copy(t.orders),
        "incremental-sync": rows.incremental_sync(t.orders, "o_orderdate", "1999-06-01 00:00:00"),
        "data-transformation": rows.data_transformation(
            t.orders,
            [Transform("o_orderstatus", "o_orderstatus", "LOWER")],
            [Mapping("o_orderkey", "o_orderkey", "STRING"), Mapping("o_totalprice", "o_totalprice", "DECIMAL(18,2)")],
        ),
        "large-table-streaming": rows.large_table_copy(t.orders, "o_orderkey", 500),
    }
    parts = [
        df.agg(F.count("*").alias("n"), total(money("o_totalprice")).alias("amount")).select(F.lit(name).alias("template"), "n", "amount")
        for name, df in made.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
