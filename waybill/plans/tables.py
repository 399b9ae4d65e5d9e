"""Input tables of the registered queries: the parquet tables and tables derived from them.

A derived table is one SQL text that Spark and the checking database both run, so both sides
start from the same rows; ``{name}`` stands for another table. Where the two dialects name a
function differently, the text uses a token from ``_DIALECT``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

AS_OF_ORDERS = "DATE '2001-08-02'"
AS_OF_EVENTS = "TIMESTAMP '2024-01-31 00:00:00'"


def orders_day() -> Column:
    return F.expr(AS_OF_ORDERS)


def orders_ts() -> Column:
    return F.expr("TIMESTAMP_NTZ '2001-08-02 00:00:00'")


def events_ts() -> Column:
    return F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")


# token -> (Spark, DuckDB)
_DIALECT = {
    "@TS": ("TIMESTAMP_NTZ", "TIMESTAMP"),
    "@STRFMT": ("date_format(", "strftime("),
    "@YMD": ("'yyyy-MM-dd'", "'%Y-%m-%d'"),
    "@MDY": ("'MM/dd/yyyy'", "'%m/%d/%Y'"),
    "@ISOZ": ("\"yyyy-MM-dd'T'HH:mm:ss'Z'\"", "'%Y-%m-%dT%H:%M:%SZ'"),
    "@YMDHMS": ("'yyyy-MM-dd HH:mm:ss'", "'%Y-%m-%d %H:%M:%S'"),
    "@PICK": ("element_at(array(", "list_extract(list_value("),
    "@DIV": ("DIV", "//"),
    "@OPEN": ("{{", "{"),
    "@SHUT": ("}}", "}"),
}

# The shift keeps re-keyed rows clear of real keys at every scale.
SHIFT = "1000000000000"

STATEMENTS = [
    "INSERT INTO orders_hist VALUES (1)",
    "UPDATE orders SET o_orderstatus = 1",
    "DELETE FROM orders WHERE o_orderkey = 1",
    "CREATE TABLE test (id INT)",
    "ALTER TABLE test ADD COLUMN",
    "DROP TABLE test",
    "MERGE INTO target USING source",
    "COPY INTO orders FROM stage",
    "SELECT * FROM orders",
    "SELECT a.x, b.y FROM a JOIN b WHERE a.k = b.k",
    "  select o_orderkey from orders order by o_orderdate -- newest",
    "SELECT x FROM (SELECT DISTINCT x FROM t) /* inner\n block */ WHERE x > 1",
    "SELECT c_name FROM customer WHERE c_name LIKE ''Cust%''",
    "SELECT  o_orderkey -- key only\nFROM   orders LIMIT 5",
    f"SELECT c_name FROM customer WHERE c_custkey IN ({', '.join(str(k) for k in range(1000, 1250))})",
]
ERRORS = [
    "Connection reset by peer",
    "query TIMEOUT after 300 s",
    "deadlock found when trying to get lock",
    "warehouse resource busy",
    "Object 'T1' does not exist",
    "SQL compilation error: syntax error line 1",
    "permission denied for role",
    "unexpected internal error",
]


def _texts(values: list[str]) -> str:
    return ", ".join("'" + v.replace("''", "'").replace("'", "''") + "'" for v in values)


DERIVED: dict[str, str] = {
    "orders_target": f"""
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
               o_orderdate, o_orderpriority
        FROM {{orders}} WHERE o_orderkey % 10 <> 3
        UNION ALL
        SELECT o_orderkey + {SHIFT},
               CASE WHEN o_orderkey % 40 = 1 THEN o_custkey + {SHIFT} ELSE o_custkey END,
               o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
        FROM {{orders}} WHERE o_orderkey % 20 = 1""",
    "orders_staged": """
        SELECT CAST(o_orderkey AS VARCHAR(20)) AS o_orderkey, CAST(o_custkey AS VARCHAR(20)) AS o_custkey,
               o_orderstatus,
               CASE WHEN o_orderkey % 50 = 0 THEN 'n/a'
                    ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR(30)) END AS o_totalprice,
               CASE o_orderkey % 4
                    WHEN 0 THEN @STRFMT o_orderdate, @YMD) WHEN 1 THEN @STRFMT o_orderdate, @MDY)
                    WHEN 2 THEN @STRFMT o_orderdate, @ISOZ) ELSE @STRFMT o_orderdate, @YMDHMS) END AS o_orderdate,
               o_orderpriority
        FROM {orders}""",
    "customers_extra": f"""
        SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM {{customer}}
        UNION ALL
        SELECT c_custkey + {SHIFT}, c_name || 'x', c_nationkey, 0.0, c_mktsegment FROM {{customer}}
        WHERE c_custkey % 500 = 1""",
    "dirty_customer": """
        SELECT c_custkey,
               CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN '  ' ELSE c_name END AS c_name,
               c_nationkey, c_acctbal,
               CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
        FROM {customer}""",
    "users": """
        SELECT c_custkey, c_name,
               lower(replace(c_name, '#', '.')) || '@ex' || c_nationkey || '.com' AS email,
               CASE c_custkey % 3 WHEN 0 THEN 'ADMIN' WHEN 1 THEN 'ANALYST' ELSE 'VIEWER' END AS role,
               lpad(CAST(c_custkey % 1000 AS VARCHAR(9)), 3, '0') || '-55-' || lpad(CAST(c_custkey % 10000 AS VARCHAR(9)), 4, '0') AS ssn,
               '+1 555 ' || lpad(CAST(c_custkey % 10000 AS VARCHAR(9)), 4, '0') AS phone,
               c_custkey || ' Main St' AS address
        FROM {customer}""",
    "customer_changes": """
        SELECT c_custkey, c_name, c_mktsegment, CAST(DATE '2020-01-01' + CAST(c_custkey % 30 AS INT) AS DATE) AS effective_date
        FROM {customer}
        UNION ALL
        SELECT c_custkey, c_name, 'MOVED', CAST(DATE '2020-01-01' + CAST(c_custkey % 30 + 90 AS INT) AS DATE)
        FROM {customer} WHERE c_custkey % 3 = 0""",
    "deployments": """
        SELECT o_orderkey AS deployment_id, 'DB_' || (o_custkey % 3) AS database_name, 'S_' || (o_custkey % 2) AS schema_name,
               o_custkey AS chain_key, o_orderdate AS started_at,
               o_orderdate + INTERVAL '1' MINUTE * (o_orderkey % 120) AS finished_at,
               o_orderkey % 120 AS minutes,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'failed' END AS state,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'snap-' || o_orderkey END AS snapshot_id,
               o_orderpriority AS error_code
        FROM {orders}""",
    "deployment_files": """
        SELECT l_orderkey AS deployment_id, 'sql/' || l_linenumber || '_' || l_partkey || '.sql' AS path FROM {lineitem} WHERE l_linenumber > 1""",
    "query_log": """
        SELECT event_id, 'q' || event_id AS query_id, ts AS start_time, 'WH_' || (user_id % 5) AS warehouse,
               user_id, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
               CAST(value AS DECIMAL(18,2)) AS exec_s, event_id % 60 AS queue_s,
               (event_id % 97) * 16777216 AS spill_bytes, (event_id % 1000) * 1048576 AS scanned_bytes,
               CAST(value AS DECIMAL(18,2)) AS compute_centi, CAST(value AS DECIMAL(18,2)) AS cloud_milli
        FROM {events}""",
    "query_log_sql": f"""
        SELECT event_id, @PICK {_texts(STATEMENTS)}), CAST(event_id % {len(STATEMENTS)} + 1 AS INT)) AS sql_text,
               event_id * 1000 AS est_rows
        FROM {{events}}""",
    "error_log": f"""
        SELECT event_id, ts, @PICK {_texts(ERRORS)}), CAST(event_id % {len(ERRORS)} + 1 AS INT)) AS message,
               CASE WHEN event_id % 8 < 4 THEN 'warning' WHEN event_id % 8 < 7 THEN 'error' ELSE 'critical' END AS severity,
               'E' || (100 + event_id % 8) AS code
        FROM {{events}} WHERE event_type = 'error'""",
    "load_log": """
        SELECT event_id, 'file_' || (event_id % 20) || '.csv' AS file_name, event_id % 500 AS rows_loaded,
               CAST(value AS DECIMAL(18,2)) AS seconds, event_type <> 'error' AS ok
        FROM {events}""",
    "health_log": """
        SELECT event_id, ts, 'component_' || (user_id % 7) AS component,
               CASE WHEN event_id % 40 = 0 AND user_id % 7 = 3 THEN 'DOWN' WHEN event_id % 40 = 1 AND user_id % 7 < 5 THEN 'DEGRADED'
                    WHEN event_id % 40 = 2 AND user_id % 7 < 6 THEN 'UNKNOWN' ELSE 'UP' END AS status
        FROM {events}""",
    "product_events": """
        SELECT ts, user_id % 50 AS product_id, event_type, CAST(value AS DECIMAL(18,2)) AS value FROM {events}""",
    "ab_results": """
        SELECT event_id % 3 AS test_id, user_id % 2 AS variant, user_id,
               max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS conversion,
               sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS revenue
        FROM {events} GROUP BY event_id % 3, user_id % 2, user_id""",
    "migration_control": """
        SELECT table_name, batch_id, CASE WHEN batch_id = 1 THEN 'failed' ELSE 'completed' END AS status,
               CASE WHEN batch_id = 1 THEN n @DIV 2 WHEN table_name = 'orders' THEN n - 5 ELSE n END AS rows_migrated,
               CAST(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * batch_id AS @TS) AS start_timestamp,
               CAST(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * batch_id + INTERVAL '1' MINUTE * (n % 50) AS @TS) AS end_timestamp
        FROM (SELECT table_name, n, 1 AS batch_id FROM {source_tables} UNION ALL SELECT table_name, n, 2 FROM {source_tables}) b""",
    "source_tables": """
        SELECT table_name, n, n AS row_count,
               CASE WHEN table_name IN ('region', 'nation', 'orders', 'part') THEN 'completed'
                    WHEN table_name = 'lineitem' THEN 'in_progress' ELSE 'pending' END AS migration_status,
               CAST(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * (n % 1000) AS @TS) AS migration_started,
               CASE WHEN table_name IN ('region', 'nation', 'orders', 'part')
                    THEN CAST(TIMESTAMP '2024-01-02 00:00:00' + INTERVAL '1' MINUTE * (n % 1000) AS @TS) END AS migration_completed
        FROM (
            SELECT 'region' AS table_name, count(*) AS n FROM {region}
            UNION ALL SELECT 'nation', count(*) FROM {nation}
            UNION ALL SELECT 'customer', count(*) FROM {customer}
            UNION ALL SELECT 'supplier', count(*) FROM {supplier}
            UNION ALL SELECT 'part', count(*) FROM {part}
            UNION ALL SELECT 'orders', count(*) FROM {orders}
            UNION ALL SELECT 'lineitem', count(*) FROM {lineitem}
            UNION ALL SELECT 'orders_none', count(*) FROM {orders} WHERE o_orderkey < 0) t""",
    "dq_issues": """
        SELECT 'customer' AS table_name, 'null_name' AS issue_type, c_nationkey AS batch, count(*) AS row_count,
               CAST(TIMESTAMP '2024-02-01 00:00:00' + INTERVAL '1' HOUR * c_nationkey AS @TS) AS discovered_at
        FROM {dirty_customer} WHERE c_name IS NULL GROUP BY c_nationkey
        UNION ALL
        SELECT 'customer', 'null_segment', c_nationkey, count(*),
               CAST(TIMESTAMP '2024-02-02 00:00:00' + INTERVAL '1' HOUR * c_nationkey AS @TS)
        FROM {dirty_customer} WHERE c_mktsegment IS NULL GROUP BY c_nationkey
        UNION ALL
        SELECT 'orders', 'bad_price', CAST(CAST(o_orderkey AS BIGINT) % 10 AS INT), count(*), CAST(TIMESTAMP '2024-02-03 00:00:00' AS @TS)
        FROM {orders_staged} WHERE o_totalprice = 'n/a' GROUP BY CAST(CAST(o_orderkey AS BIGINT) % 10 AS INT)""",
    "event_bus": """
        SELECT event_id, 'svc_' || (user_id % 4) AS source_service, 'svc_' || (user_id % 3) AS target_service,
               CASE WHEN event_id % 9 = 0 THEN 'pending' ELSE 'processed' END AS state,
               CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(value AS DECIMAL(18,2)) END AS wait_s
        FROM {events}""",
    # one catalog object per part; the source and target differ in every way a catalog can
    "catalog_src": """
        SELECT 'dev' AS environment, 'DB1' AS database_name, 'S_' || (p_partkey % 3) AS schema_name,
               CASE p_partkey % 6 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'VIEW' WHEN 2 THEN 'TABLE' WHEN 3 THEN 'FUNCTION'
                    WHEN 4 THEN 'SEQUENCE' ELSE 'STREAM' END AS object_type,
               CASE WHEN p_partkey % 31 = 0 THEN 'TEMP_' WHEN p_partkey % 37 = 0 THEN 'temp_' ELSE 'OBJ_' END
                 || p_partkey || CASE WHEN p_partkey % 41 = 0 THEN '_BACKUP' ELSE '' END AS object_name,
               'USER' || (p_size % 4) AS owner, p_brand AS comment,
               'create ' || p_name || '  as select 1 -- ' || p_brand || chr(10) || 'from t' AS definition,
               CAST(p_size AS VARCHAR(9)) AS column_count, 'false' AS is_secure,
               CASE WHEN p_partkey % 6 = 1 THEN 'false' END AS is_materialized, CASE WHEN p_partkey % 6 = 3 THEN 'SQL' END AS language,
               CASE WHEN p_partkey % 6 = 3 THEN 'NUMBER' END AS return_type, p_partkey
        FROM {part} WHERE p_partkey % 10 <> 3""",
    "catalog_tgt": """
        SELECT 'staging' AS environment, 'DB1' AS database_name, 'S_' || (p_partkey % 3) AS schema_name,
               CASE p_partkey % 6 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'VIEW' WHEN 2 THEN 'TABLE' WHEN 3 THEN 'FUNCTION'
                    WHEN 4 THEN 'SEQUENCE' ELSE 'STREAM' END AS object_type,
               CASE WHEN p_partkey % 31 = 0 THEN 'TEMP_' WHEN p_partkey % 37 = 0 THEN 'temp_' ELSE 'OBJ_' END
                 || p_partkey || CASE WHEN p_partkey % 41 = 0 THEN '_BACKUP' ELSE '' END AS object_name,
               CASE WHEN p_partkey % 11 = 0 THEN 'USER9' ELSE 'USER' || (p_size % 4) END AS owner,
               CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_brand END AS comment,
               CASE WHEN p_partkey % 17 = 0 THEN 'create ' || p_name || ' as select 1 -- changed note' || chr(10) || 'from t'
                    WHEN p_partkey % 19 = 0 THEN 'create ' || p_name || '  as select 1 -- ' || p_brand || chr(10) || 'from other'
                    WHEN p_partkey % 23 = 0 THEN ''
                    ELSE 'CREATE ' || p_name || ' as select  1 -- ' || p_brand || chr(10) || 'from t' END AS definition,
               CAST(CASE WHEN p_partkey % 29 = 0 THEN p_size + 1 ELSE p_size END AS VARCHAR(9)) AS column_count,
               CASE WHEN p_partkey % 25 = 7 THEN 'true' ELSE 'false' END AS is_secure,
               CASE WHEN p_partkey % 6 = 1 THEN CASE WHEN p_partkey % 35 = 1 THEN 'true' ELSE 'false' END END AS is_materialized,
               CASE WHEN p_partkey % 6 = 3 THEN CASE WHEN p_partkey % 45 = 0 THEN 'PYTHON' ELSE 'SQL' END END AS language,
               CASE WHEN p_partkey % 6 = 3 THEN CASE WHEN p_partkey % 35 = 2 THEN NULL ELSE 'NUMBER' END END AS return_type, p_partkey
        FROM {part} WHERE p_partkey % 9 <> 4""",
    "catalog_envs": """
        SELECT environment, database_name, schema_name, object_type, object_name, owner, comment, definition, column_count, is_secure, is_materialized, language, return_type FROM {catalog_src}
        UNION ALL
        SELECT environment, database_name, schema_name, object_type, object_name, owner, comment, definition, column_count, is_secure, is_materialized, language, return_type FROM {catalog_tgt}
        UNION ALL
        SELECT 'prod', database_name, schema_name, object_type, object_name, owner, comment, definition, column_count, is_secure, is_materialized, language, return_type FROM {catalog_src}
        WHERE object_name NOT LIKE 'TEMP%'""",
    "catalog_versions": """
        SELECT environment AS source_environment, CASE WHEN environment = 'dev' THEN 1 ELSE 2 END AS version,
               CASE WHEN environment = 'dev' THEN CAST('2024-01-01 00:00:00' AS @TS) ELSE CAST('2024-01-02 00:00:00' AS @TS) END AS captured_at,
               database_name, schema_name, object_type, object_name, owner, comment, definition, column_count, is_secure,
               is_materialized, language, return_type
        FROM {catalog_envs} WHERE environment IN ('dev', 'staging')""",
    "audit_payload": """
        SELECT user_id % 5 AS log_id, CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS day, ts, event_id, event_type,
               CAST(event_id AS VARCHAR(20)) || '|' || CAST(user_id AS VARCHAR(20)) || '|' || event_type || '|'
                 || CAST(CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) AS VARCHAR(20)) AS payload
        FROM {events}""",
    "access_requests": """
        SELECT event_id AS request_id, 'u' || (user_id % 7) AS user_name, 'deployment:' || event_type AS resource,
               CASE event_id % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'execute' WHEN 2 THEN 'delete' ELSE 'approve' END AS action,
               CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'env-' || CASE WHEN event_id % 2 = 0 THEN 'prod' ELSE 'dev' END END AS environment
        FROM {events}""",
    "dep_edges": """
        SELECT o_orderkey AS child_id, o_orderkey + (o_custkey % 400) - 300 AS parent_id FROM {orders}""",
    "file_corpus": """
        SELECT doc_id, 'src/' || lang || '/file_' || doc_id || CASE doc_id % 12 WHEN 0 THEN '.go' WHEN 1 THEN '.py' WHEN 2 THEN '.yaml'
                 WHEN 3 THEN '.env' WHEN 4 THEN '.js' WHEN 5 THEN '_test.go' WHEN 6 THEN '.json' WHEN 7 THEN '.GO' ELSE '.txt' END AS path,
               text || chr(10) || CASE doc_id % 9
                 WHEN 0 THEN 'password = "hunter2secret"' WHEN 1 THEN 'api_key: "abcd1234abcd1234abcd"'
                 WHEN 2 THEN '-----BEGIN RSA PRIVATE KEY-----' WHEN 3 THEN 'query := fmt.Sprintf("select * from %s", t)'
                 WHEN 4 THEN 'InsecureSkipVerify: true' WHEN 5 THEN 'import "crypto/md5"'
                 WHEN 6 THEN 'os.Chmod(p, 0777)' WHEN 7 THEN '_ := load(path)'
                 ELSE 'pwd = "example-test-value"' END AS text
        FROM {documents}
        UNION ALL
        SELECT doc_id + 1000000000000, 'vendor/lib/file_' || doc_id || '.go', 'password = "vendored-secret"' FROM {documents} WHERE doc_id % 10 = 0""",
    "event_documents": """
        SELECT event_id, CASE event_id % 5
                 WHEN 4 THEN 'broken @OPENmail a@b.de'
                 WHEN 3 THEN '@OPEN"auth":"t' || user_id || '","k":' || regexp_extract(props, '([0-9]+)', 1) || ',"private":@OPEN"ssn":1,"who":"c@d.org"@SHUT@SHUT'
                 ELSE '@OPEN"note":"mail user' || user_id || '@example.com now","login":@OPEN"user":"u' || user_id || '","password":"p' || event_id || '","api_key":' || event_id
                      || ',"session":@OPEN"Token":"abc","ssn":"x","days":[1,"10.0.0.' || event_id % 200 || '",@OPEN"secret":null,"mail":"a@b.de"@SHUT]@SHUT@SHUT,"tags":["' || event_type || '",[],@OPEN@SHUT,true]@SHUT'
               END AS document
        FROM {events}""",
    "documents_edited": """
        SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, '. ', '.' || chr(10)) || chr(10) || 'added line'
                            WHEN doc_id % 3 = 1 THEN replace(text, 'the', 'THE') ELSE text END AS text
        FROM {documents}""",
}

_NAMES = re.compile(r"\{([a-z]\w*)\}")


def _dialect(sql: str, side: int) -> str:
    for token in sorted(_DIALECT, key=len, reverse=True):
        sql = sql.replace(token, _DIALECT[token][side])
    return sql


class Tables:
    """Lazy access to base and derived tables: ``t.orders``, ``t.orders_target`` …"""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = self._load(name)
        return self._frames[name]

    def _load(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in DERIVED:
            raise AttributeError(name)
        sql = _dialect(DERIVED[name], 0)
        return self.spark.sql(sql, **{n: getattr(self, n) for n in set(_NAMES.findall(sql))})


def oracle(sql: str) -> str:
    """Replace ``{name}`` by table names, with the derived tables as CTEs in front."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in _NAMES.findall(text):
            if name in DERIVED and name not in order:
                need(DERIVED[name])
                order.append(name)

    need(sql)
    ctes = [f"{n} AS ({_NAMES.sub(r'\1', _dialect(DERIVED[n], 1))})" for n in order]
    body = _NAMES.sub(r"\1", _dialect(sql, 1)).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[len("WITH RECURSIVE"):]
    if body.upper().startswith("WITH"):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[len("WITH"):]
    return "WITH " + ",\n".join(ctes) + "\n" + body
