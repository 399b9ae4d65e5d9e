"""Scans, audit chains, access, erasure, export and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybill.operators import access, audit, governance, scan, writes
from waybill.operators.access import Condition, Permission, PolicyRule, Role
from waybill.operators.monitor import severity_summary
from waybill.plans.registry import query
from waybill.plans.streams import delivered
from waybill.plans.tables import orders_day
from waybill.session import fresh_dir
from waybill.streaming import keyed


def _scan_sql(rules) -> str:
    parts = []
    for r in rules:
        pattern = r.pattern.replace("'", "''")
        ext = f"ext IN ({', '.join(repr(x) for x in r.file_types)})" if r.file_types else "true"
        unless = "".join(f" AND NOT contains(line_text, '{w}')" for w in r.unless)
        source, no, shown = ("kept", "0", "''") if r.whole_file else ("lines", "line", "regexp_replace(line_text, '^\\s+|\\s+$', '', 'g')")
        subject = "text" if r.whole_file else "line_text"
        parts.append(
            f"SELECT path, '{r.rule_id}' AS rule_id, '{r.severity}' AS severity, CAST({no} AS BIGINT) AS line, {shown} AS evidence "
            f"FROM {source} WHERE {ext} AND regexp_matches({subject}, '{pattern}'){unless}"
        )
    return f"""
    WITH kept AS (SELECT path, text, lower(regexp_extract(path, '(\\.[^.]*)$', 1)) AS ext FROM {{file_corpus}}
                  WHERE NOT contains(path, 'vendor') AND NOT contains(path, '.git') AND NOT contains(path, 'node_modules') AND NOT regexp_matches(path, '_test\\.go$|\\.test$')),
    lines AS (SELECT path, ext, unnest(string_split(text, chr(10))) AS line_text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM kept),
    f AS ({' UNION ALL '.join(parts)})"""


@query("security_scan", _scan_sql(scan.RULES) + " SELECT * FROM f")
def _(t):
    return scan.security_scan(t.file_corpus, "path", "text")


OWN_RULES = [*scan.RULES, scan.ScanRule("OWN001", "LOW", "(?i)todo|fixme|https?://", (".txt",))]


@query("custom_scan_rule", _scan_sql(OWN_RULES) + " SELECT rule_id, severity, count(*) AS findings, count(DISTINCT path) AS files FROM f GROUP BY 1, 2")
def _(t):
    found = scan.security_scan(t.file_corpus, "path", "text", OWN_RULES)
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("findings"), F.count_distinct("path").alias("files"))


@query("severity_summary", _scan_sql(scan.RULES) + """
    SELECT count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
           count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM f""")
def _(t):
    return severity_summary(scan.security_scan(t.file_corpus, "path", "text"))


def _tampered_log(t):
    """A stored chain in which some payloads, hashes and links were changed afterwards."""
    log = audit.running_hash_chain(t.audit_payload, "log_id", "day", ["ts", "event_id"], "payload")
    forged, number = F.sha2(F.lit("forged"), 256), F.col("event_id")
    changed = log.withColumns(
        {
            "payload": F.when(number % 983 == 11, F.concat("payload", F.lit("0"))).otherwise(F.col("payload")),
            "hash": F.when(number % 997 == 5, forged).otherwise(F.col("hash")),
            "prev_hash": F.when(number % 991 == 7, forged).otherwise(F.col("prev_hash")),
        }
    )
    return writes.written(changed, fresh_dir(t.spark, "audit-log"))


# the chain, event after event: rotations are days, each begins with the digest of the day before
CHAIN = """n AS (SELECT log_id, day, ts, event_id, payload, row_number() OVER (PARTITION BY log_id, day ORDER BY ts, event_id) AS seq FROM {audit_payload}),
    g AS (SELECT log_id, day, sha256(string_agg(sha256(payload), '' ORDER BY seq)) AS digest FROM n GROUP BY 1, 2),
    a AS (SELECT log_id, day, sha256('log|' || log_id || '|' || day || '|' || coalesce(lag(digest) OVER (PARTITION BY log_id ORDER BY day), '')) AS anchor FROM g),
    r AS (SELECT n.*, anchor AS prev_hash, sha256(anchor || '|' || payload) AS hash FROM n JOIN a USING (log_id, day) WHERE seq = 1
          UNION ALL SELECT n.*, r.hash, sha256(r.hash || '|' || n.payload) FROM r JOIN n ON n.log_id = r.log_id AND n.day = r.day AND n.seq = r.seq + 1)"""


@query("audit_chain_verify", f"""
    WITH RECURSIVE {CHAIN},
    x AS (SELECT log_id, day, seq, ts, event_id, CASE WHEN event_id % 983 = 11 THEN payload || '0' ELSE payload END AS payload,
                 CASE WHEN event_id % 991 = 7 THEN sha256('forged') ELSE prev_hash END AS prev_hash,
                 CASE WHEN event_id % 997 = 5 THEN sha256('forged') ELSE hash END AS hash FROM r),
    h AS (SELECT log_id, day, sha256(string_agg(sha256(payload), '' ORDER BY seq)) AS digest FROM x GROUP BY 1, 2),
    b AS (SELECT log_id, day, sha256('log|' || log_id || '|' || day || '|' || coalesce(lag(digest) OVER (PARTITION BY log_id ORDER BY day), '')) AS anchor FROM h)
    SELECT x.*, hash = sha256(prev_hash || '|' || payload) AS hash_ok,
           prev_hash = coalesce(lag(hash) OVER (PARTITION BY log_id, day ORDER BY ts, event_id), anchor) AS link_ok FROM x JOIN b USING (log_id, day)""")
def _(t):
    return audit.audit_chain_verify(_tampered_log(t), "log_id", "day", ["ts", "event_id"], "payload")


@query("running_hash_chain", f"WITH RECURSIVE {CHAIN} SELECT log_id, day, seq, ts, event_id, payload, prev_hash, hash FROM r")
def _(t):
    return audit.running_hash_chain(t.audit_payload, "log_id", "day", ["ts", "event_id"], "payload")


@query("running_hash_chain_stream", f"""
    WITH RECURSIVE {CHAIN} SELECT log_id, day, seq, ts, event_id, payload, prev_hash, hash, true AS hash_ok, true AS link_ok FROM r""")
def _(t):
    """The first days of the log are there as a chain; the rest arrives in deliveries and goes on from the last links."""
    columns, names = ["ts", "event_id"], ["log_id", "day"]
    payloads = t.audit_payload.select(*names, *columns, "payload")
    known = F.col("day") <= "2024-01-04"
    stored = writes.written(audit.running_hash_chain(payloads.where(known), *names, columns, "payload"), fresh_dir(t.spark, "audit-log"))
    heads = audit.chain_heads(stored, *names, "payload")
    rest = delivered(t, payloads.where(~known), lambda events, root: keyed.chained(events, root, *names, columns, "payload", heads))
    return audit.audit_chain_verify(stored.unionByName(rest.drop("late")), *names, columns, "payload")


ROLES = {
    "admin": Role((Permission("*", ("*",)),)),
    "operator": Role((Permission("deployment:*", ("read", "execute")),), ("by_environment",)),
    "viewer": Role((Permission("deployment:view", ("read",)),), ("reading",)),
    "restricted": Role((), ("no_purchases", "by_environment")),
}
POLICIES = {
    "by_environment": [PolicyRule("allow", "deployment:*", ("delete", "approve"), (Condition("environment", "starts_with", "env-dev"),))],
    "reading": [PolicyRule("allow", "deployment:c*", ("read",))],
    "no_purchases": [PolicyRule("deny", "deployment:purchase", ("*",)), PolicyRule("allow", "deployment:*", ("read",))],
}


def _users(t):
    """The users that appear in the requests, but for one unknown user."""
    number = F.col("user_id") % 7
    roles = F.array(*[F.array(*[F.lit(r) for r in rs]) for rs in (["admin"], ["operator"], ["viewer"], ["viewer", "operator"], ["restricted"], ["admin"])])
    return (
        t.events.select(number.alias("n")).distinct().where("n < 6")
        .select(F.concat(F.lit("u"), F.col("n")).alias("user_name"), (F.col("n") != 5).alias("active"), F.element_at(roles, (F.col("n") + 1).cast("int")).alias("roles"))
    )


@query("access_decisions", """
    WITH u AS (SELECT DISTINCT 'u' || n AS user_name, n <> 5 AS active, [['admin'], ['operator'], ['viewer'], ['viewer', 'operator'], ['restricted'], ['admin']][n + 1] AS roles
               FROM (SELECT user_id % 7 AS n FROM events) WHERE n < 6),
    j AS (SELECT r.*, active, roles FROM {access_requests} r LEFT JOIN u ON r.user_name = u.user_name),
    e AS (SELECT *, coalesce(action IN ('delete', 'approve') AND starts_with(environment, 'env-dev'), false) AS env_ok FROM j),
    d AS (
        SELECT request_id, user_name, resource, action, environment,
               CASE WHEN active IS NULL THEN 'unknown user' WHEN NOT active THEN 'user inactive'
                    WHEN list_contains(roles, 'admin') OR (list_contains(roles, 'operator') AND action IN ('read', 'execute'))
                         OR (list_contains(roles, 'viewer') AND action = 'read' AND resource = 'deployment:view') THEN 'role permission'
                    WHEN (list_contains(roles, 'operator') AND env_ok) OR (list_contains(roles, 'viewer') AND action = 'read' AND resource LIKE 'deployment:c%')
                         OR (list_contains(roles, 'restricted') AND (env_ok OR (resource <> 'deployment:purchase' AND action = 'read'))) THEN 'allowed by policy'
                    WHEN list_contains(roles, 'restricted') AND resource = 'deployment:purchase' THEN 'denied by policy'
                    ELSE 'no matching rule' END AS reason
        FROM e)
    SELECT *, reason IN ('role permission', 'allowed by policy') AS allowed FROM d""")
def _(t):
    return access.access_decisions(t.access_requests, _users(t), ROLES, POLICIES)


def _subjects(t):
    return t.customer.where("c_custkey % 50 = 7").select("c_custkey")


@query("gdpr_erase", " UNION ALL ".join(f"""
    SELECT '{n}' AS table_name, count(*) AS rows_before, count(*) FILTER ({c} % 50 = 7 AND {c} IN (SELECT c_custkey FROM customer)) AS rows_deleted,
           count(*) FILTER (NOT ({c} % 50 = 7 AND {c} IN (SELECT c_custkey FROM customer))) AS rows_left FROM {n}"""
    for n, c in (("customer", "c_custkey"), ("orders", "o_custkey"), ("events", "user_id"))))
def _(t):
    tables = {"customer": (t.customer, "c_custkey"), "orders": (t.orders, "o_custkey"), "events": (t.events, "user_id")}
    for name, (table, column) in tables.items():
        writes.written(governance.erased(table, column, _subjects(t)), fresh_dir(t.spark, f"erased-{name}"))
    return governance.erasure_log(tables, _subjects(t))


@query("gdpr_export", """
    WITH o AS (SELECT o_custkey AS subject, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n,
                      '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","amount":"' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || '"}' AS j
               FROM orders WHERE o_custkey % 50 = 7),
    e AS (SELECT user_id AS subject, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
                 '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS j FROM events WHERE user_id % 50 = 7),
    c AS (SELECT c_custkey AS subject, 1 AS n, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}' AS j FROM customer WHERE c_custkey % 50 = 7),
    a AS (SELECT *, 'orders' AS section, 10 AS size FROM o UNION ALL SELECT *, 'events', 10 FROM e UNION ALL SELECT *, 'info', 10 FROM c)
    SELECT subject, section, (n - 1) // 10 AS part, count(*) AS items, '[' || string_agg(j, ',' ORDER BY n) || ']' AS document FROM a GROUP BY 1, 2, 3""")
def _(t):
    orders = t.orders.withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    tables = {
        "info": (t.customer, "c_custkey", "c_custkey", ["c_custkey", "c_name", "c_mktsegment"]),
        "orders": (orders, "o_custkey", "o_orderkey", ["o_orderkey", "o_orderstatus", "amount"]),
        "events": (t.events, "user_id", "event_id", ["event_id", "event_type"]),
    }
    return governance.subject_export(tables, _subjects(t), size=10)


# fixed values: years of retention per class
YEARS = {"PUBLIC": 1, "INTERNAL": 3, "CONFIDENTIAL": 5, "RESTRICTED": 7}


@query("policy_retention_purge", """
    WITH c AS (SELECT o_orderkey, o_orderdate, ['PUBLIC', 'INTERNAL', 'CONFIDENTIAL', 'RESTRICTED'][o_orderkey % 4 + 1] AS level, [1, 3, 5, 7][o_orderkey % 4 + 1] AS years FROM orders)
    SELECT o_orderkey, o_orderdate, level, CASE WHEN CAST(o_orderdate AS DATE) < CAST(DATE '2001-08-02' - to_years(years) AS DATE) THEN 'purge' ELSE 'keep' END AS action FROM c""")
def _(t):
    level = F.element_at(F.array(*[F.lit(c) for c in YEARS]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    marked = governance.retention_cut(t.orders.select("o_orderkey", "o_orderdate"), level, "o_orderdate", orders_day(), YEARS)
    # one write parts the table: action=purge is the backup, action=keep the new image
    return writes.written(marked, fresh_dir(t.spark, "retention"), ["action"])
