"""Views of the given tables in the shape of the assessment inputs.

One statement per input, in the common subset of Spark SQL and ANSI SQL, so that a check
against another engine starts from the same rows. ``{name}`` stands for a given table.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

EVENTS_AS_OF = "2024-01-31"
RUNS_AS_OF = "2001-08-02"
ASSETS_AS_OF = "2001-11-05"
TREND_AS_OF = "1996-07-01"

_BRONZE_ACTION = """CASE event_type WHEN 'view' THEN 'INSERT' WHEN 'click' THEN 'UPDATE' WHEN 'purchase' THEN 'MERGE'
                     WHEN 'signup' THEN 'DELETE' ELSE 'TRUNCATE' END"""
_LAYER = """CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'bronze' WHEN p_type IN ('MEDIUM', 'STANDARD') THEN 'silver'
            ELSE 'gold' END"""
_PART = "concat('part_', CAST(p_partkey AS STRING))"
_PART_OWNER = """CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN concat('grp_', p_brand)
                 ELSE concat('user', CAST(p_partkey % 50 AS STRING), '@example.com') END"""

INPUTS: dict[str, str] = {
    "writes": f"""
        SELECT event_id, concat('bronze_t', regexp_extract(props, '([0-9]+)', 1)) AS table_name,
               concat('user', CAST(user_id AS STRING), '@example.com') AS user_email, ts AS event_time,
               {_BRONZE_ACTION} AS action_type, value AS bytes_affected,
               CASE user_id % 5 WHEN 1 THEN 'NOTEBOOK' WHEN 2 THEN 'DBSQL_QUERY' WHEN 3 THEN 'JOB'
                    WHEN 4 THEN 'PIPELINE' END AS entity_type
        FROM {{events}}""",
    "runs": """
        SELECT o_orderkey AS run_id, o_custkey AS pipeline_id, o_orderdate AS start_time,
               CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'cancelled' ELSE 'succeeded' END AS status,
               CAST(o_totalprice AS DECIMAL(18,2)) AS duration_sec, o_orderpriority AS triggered_by,
               CAST(o_orderkey AS BIGINT) * 10 AS table_rows
        FROM {orders}""",
    "pipelines": """
        SELECT c_custkey AS pipeline_id, c_name AS pipeline_name,
               CASE WHEN c_acctbal >= 0 THEN concat(c_name, '@example.com') END AS owner_email,
               c_acctbal >= 0 AS has_owner_tag, c_mktsegment IN ('BUILDING', 'MACHINERY') AS is_production,
               c_custkey % 20 <> 0 AS has_dq_expectations, c_custkey % 12 = 0 AS uses_hardcoded_paths,
               CAST(c_custkey % 3600 AS INT) AS avg_duration_sec
        FROM {customer}""",
    "jobs": """
        SELECT c_custkey AS job_id, c_name AS job_name, c_mktsegment AS cluster_type,
               CASE WHEN c_custkey % 6 <> 0 THEN concat(c_name, '@example.com') END AS owner_email,
               CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS annual_cost_usd
        FROM {customer}""",
    "ownership_history": """
        SELECT o_custkey AS pipeline_id, min(o_orderdate) AS created_at,
               min(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END) AS owned_at
        FROM {orders} GROUP BY o_custkey""",
    "experiments_by_run": """
        SELECT o_custkey AS experiment_id, max(o_orderdate) AS last_run_date FROM {orders} GROUP BY o_custkey""",
    "edges": """
        SELECT DISTINCT concat('part_', CAST(l_partkey AS STRING)) AS source,
               concat('supplier_', CAST(l_suppkey AS STRING)) AS target
        FROM {lineitem}
        UNION ALL
        SELECT concat('supplier_', CAST(s_suppkey AS STRING)), concat('nation_', CAST(s_nationkey AS STRING))
        FROM {supplier}
        UNION ALL
        SELECT concat('nation_', CAST(n_nationkey AS STRING)), concat('region_', CAST(n_regionkey AS STRING))
        FROM {nation}""",
    "gold_edges": """
        SELECT DISTINCT concat('part_', CAST(l.l_partkey AS STRING)) AS source,
               concat('nation_', CAST(s.s_nationkey AS STRING)) AS target
        FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey""",
    "part_writes": """
        SELECT concat('part_', CAST(l_partkey AS STRING)) AS table_id, l_shipdate AS event_time,
               concat(CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING), '/', CAST(l_suppkey AS STRING))
                   AS event_id,
               concat('user', CAST(l_suppkey AS STRING), '@example.com') AS user_email,
               CASE WHEN l_linestatus = 'F' THEN 'UPDATE' ELSE 'INSERT' END AS action_type,
               CASE l_returnflag WHEN 'A' THEN 'NOTEBOOK' WHEN 'R' THEN 'JOB' END AS entity_type
        FROM {lineitem}""",
    "reads": """
        SELECT concat('part_', CAST(l.l_partkey AS STRING)) AS table_id, o.o_custkey AS pipeline_id
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    "ingest_lineage": """
        SELECT concat('supplier_', CAST(l_suppkey AS STRING)) AS source,
               CASE WHEN l_suppkey % 4 = 0 THEN 'external_database' ELSE 'table' END AS source_kind,
               l_partkey AS entity_id,
               CASE l_returnflag WHEN 'A' THEN 'NOTEBOOK' WHEN 'R' THEN 'JOB' ELSE 'PIPELINE' END AS entity_type
        FROM {lineitem}""",
    "exec_tables": """
        SELECT concat('supplier_', CAST(s_suppkey AS STRING)) AS table_id FROM {supplier} WHERE s_suppkey % 25 = 0""",
    "tables": f"""
        SELECT {_PART} AS table_id,
               CASE WHEN p_size % 5 = 0 THEN p_name
                    ELSE concat({_LAYER}, '_', replace(p_name, ' ', '_')) END AS table_name,
               p_brand AS catalog_name,
               CASE WHEN p_partkey % 2 = 0 THEN concat('sales_', {_LAYER}) ELSE 'sales' END AS schema_name,
               CASE WHEN p_partkey % 3 <> 0 THEN {_LAYER} END AS layer_tag,
               {_LAYER} AS data_layer,
               {_PART_OWNER} AS owner_email,
               CASE WHEN p_partkey % 4 = 0 THEN 'creator@example.com' ELSE {_PART_OWNER} END AS created_by,
               CASE WHEN p_size % 4 <> 0 THEN p_name END AS table_comment,
               DATE '2001-11-05' - CAST(p_partkey % 400 AS INT) AS created_at
        FROM {{part}}""",
    "owner_groups": "SELECT DISTINCT concat('grp_', p_brand) AS principal FROM {part}",
    "models": """
        SELECT s.s_suppkey AS model_id, s.s_name AS model_name,
               CASE WHEN s.s_acctbal >= 0 THEN concat(s.s_name, '@example.com') END AS owner_email,
               CASE WHEN s.s_suppkey % 5 <> 0 THEN concat('endpoint_', CAST(s.s_suppkey AS STRING)) END
                   AS serving_endpoint_name,
               concat('part_', CAST(f.l_partkey AS STRING)) AS upstream_features_table,
               s.s_suppkey % 4 <> 0 AS is_registered
        FROM {supplier} s LEFT JOIN (
            SELECT l_suppkey, l_partkey FROM (
                SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey
                    ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS rn
                FROM {lineitem}) x WHERE rn = 1) f ON f.l_suppkey = s.s_suppkey""",
    "experiments": """
        SELECT s_suppkey AS experiment_id, CASE WHEN s_acctbal >= 0 THEN concat(s_name, '@example.com') END AS owner_email,
               s_suppkey % 3 <> 0 AS has_description, s_suppkey % 4 <> 0 AS has_registered_model
        FROM {supplier}""",
    "feed": """
        SELECT user_id, ts, event_id, value,
               CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op
        FROM {events}""",
    "platform_tables": f"""
        SELECT {_PART} AS table_id, concat({_LAYER}, '_', replace(p_name, ' ', '_')) AS table_name, p_brand AS catalog_name,
               'sales' AS schema_name, {_LAYER} AS data_layer, {_PART_OWNER} AS owner_email,
               CASE WHEN p_size % 4 <> 0 THEN p_name END AS table_comment,
               DATE '2001-11-05' - CAST(p_partkey % 400 AS INT) AS created_at
        FROM {{part}}
        UNION ALL
        SELECT concat('supplier_', CAST(s_suppkey AS STRING)), s_name, 'main', 'sales', 'silver', 'team@example.com', s_name,
               DATE '2000-01-01'
        FROM {{supplier}}
        UNION ALL
        SELECT concat('nation_', CAST(n_nationkey AS STRING)), concat('gold_nation_n', CAST(n_nationkey AS STRING)), 'main',
               'sales', 'gold', NULL, n_name, DATE '2000-01-01'
        FROM {{nation}}
        UNION ALL
        SELECT concat('region_', CAST(r_regionkey AS STRING)), concat('gold_region_r', CAST(r_regionkey AS STRING)), 'main',
               'sales', 'gold', 'team@example.com', NULL, DATE '2000-01-01'
        FROM {{region}}""",
    "platform_models": """
        SELECT CAST(s.s_suppkey AS STRING) AS model_id, s.s_name AS model_name,
               CASE WHEN s.s_acctbal >= 0 THEN concat(s.s_name, '@example.com') END AS owner_email,
               f.features AS upstream_features_table, s.s_suppkey % 4 <> 0 AS registered_in_uc
        FROM {supplier} s LEFT JOIN (
            SELECT l_suppkey, concat('part_', CAST(max(l_partkey) AS STRING)) AS features FROM {lineitem}
            GROUP BY l_suppkey) f ON f.l_suppkey = s.s_suppkey""",
    "platform_experiments": """
        SELECT CAST(s.s_suppkey AS STRING) AS experiment_id, s.s_name AS experiment_name,
               CASE WHEN s.s_acctbal >= 0 THEN concat(s.s_name, '@example.com') END AS owner_email,
               s.s_suppkey % 3 <> 0 AS has_description, s.s_suppkey % 4 <> 0 AS has_registered_model, l.last_run_date
        FROM {supplier} s LEFT JOIN (
            SELECT l_suppkey, max(l_shipdate) AS last_run_date FROM {lineitem} WHERE l_suppkey % 2 = 0
            AND l_shipdate < DATE '2001-07-01' GROUP BY l_suppkey
            UNION ALL
            SELECT DISTINCT l_suppkey, DATE '2001-07-30' FROM {lineitem} WHERE l_suppkey % 5 = 1 AND l_suppkey % 2 = 1) l
        ON l.l_suppkey = s.s_suppkey""",
    "production_history": """
        SELECT o_custkey AS pipeline_id, min(o_orderdate) AS created_at,
               min(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END) AS owned_at
        FROM {orders} JOIN {customer} ON c_custkey = o_custkey
        WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY o_custkey""",
    "snap_old": "SELECT c_custkey, c_acctbal FROM {customer}",
    "snap_new": """
        SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal
        FROM {customer} WHERE c_custkey % 11 <> 0
        UNION ALL
        SELECT c_custkey + 1000000, c_acctbal FROM {customer} WHERE c_custkey % 13 = 0""",
    "table_detail": f"""
        SELECT {_PART} AS table_id, (p_partkey % 2500 + 1) * 1000000000 AS size_bytes,
               CAST(p_size AS BIGINT) * 200 AS num_files,
               CASE p_partkey % 3 WHEN 0 THEN 'event_date' WHEN 1 THEN 'region' END AS partition_column,
               CAST(p_size AS BIGINT) * 10 AS num_partitions, p_partkey % 6 <> 0 AS is_managed,
               CAST(p_partkey % 2500 AS BIGINT) * 10 + 1000 AS num_rows
        FROM {{part}}""",
    "table_history": f"""
        SELECT {_PART} AS table_id, 'ANALYZE' AS operation, DATE '2001-11-05' - CAST(p_partkey % 60 AS INT) AS op_date,
               CAST(0 AS BIGINT) AS rows_changed
        FROM {{part}} WHERE p_partkey % 12 <> 0
        UNION ALL
        SELECT {_PART}, 'VACUUM', DATE '2001-11-05' - CAST(p_partkey % 45 AS INT), CAST(0 AS BIGINT) FROM {{part}}
        WHERE p_partkey % 10 <> 0
        UNION ALL
        SELECT {_PART}, 'PURGE', DATE '2001-11-05' - CAST(p_partkey % 40 AS INT), CAST(0 AS BIGINT) FROM {{part}}
        WHERE p_partkey % 9 <> 0
        UNION ALL
        SELECT {_PART}, 'WRITE', DATE '2001-11-05' - CAST(p_partkey % 30 AS INT), CAST(p_size AS BIGINT) * 40 FROM {{part}}
        UNION ALL
        SELECT {_PART}, 'WRITE', DATE '2001-11-05' - CAST(p_partkey % 30 AS INT) - 20, CAST(p_size AS BIGINT) * 25 FROM {{part}}""",
    "table_properties": f"SELECT {_PART} AS table_id, p_partkey % 14 AS retention_days FROM {{part}}",
    "columns": f"""
        SELECT {_PART} AS object, p_brand AS schema_name,
               CASE p_partkey % 8 WHEN 0 THEN 'ssn' WHEN 1 THEN 'email' WHEN 2 THEN 'dob' WHEN 3 THEN 'phone'
                    WHEN 4 THEN 'address' WHEN 5 THEN 'amount' WHEN 6 THEN 'status' ELSE 'id' END AS column_name
        FROM {{part}}""",
    "column_tags": f"""
        SELECT {_PART} AS object, CASE p_partkey % 8 WHEN 0 THEN 'ssn' ELSE 'address' END AS column_name,
               'class' AS tag_key, CASE p_partkey % 8 WHEN 0 THEN 'ssn' ELSE 'address' END AS tag_value
        FROM {{part}} WHERE p_partkey % 4 = 0""",
    "object_tags": f"""
        SELECT DISTINCT 'catalog' AS level, p_brand AS object, 'sensitivity' AS tag_key, 'internal' AS tag_value FROM {{part}}
        UNION ALL
        SELECT DISTINCT 'schema', concat(p_brand, '.', p_type), 'sensitivity', 'restricted'
        FROM {{part}} WHERE p_type IN ('ECONOMY', 'SMALL')
        UNION ALL
        SELECT DISTINCT 'schema', concat(p_brand, '.', p_type), 'domain', p_type FROM {{part}}
        UNION ALL
        SELECT 'table', {_PART}, 'sensitivity', 'public' FROM {{part}} WHERE p_partkey % 10 = 0""",
    "objects": f"""
        SELECT {_PART} AS object, concat(p_brand, '.', p_type) AS schema_object, p_brand AS catalog_object FROM {{part}}""",
    "policies": f"SELECT {_PART} AS object FROM {{part}} WHERE p_partkey % 6 = 0",
    "grants": """
        SELECT CASE WHEN s.s_suppkey % 3 = 0 THEN concat('user', CAST(s.s_suppkey AS STRING), '@example.com')
                    ELSE concat('grp_', n.n_name) END AS principal,
               n.n_name AS object, CASE WHEN s.s_suppkey % 2 = 1 THEN 'MODIFY' ELSE 'SELECT' END AS privilege
        FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey""",
    "customers_by_nation": """
        SELECT c.c_custkey, c.c_name, n.n_name FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "drifted": """
        SELECT event_id, ts, user_id, event_type,
               CASE WHEN event_id % 50 = 0 THEN concat(CAST(value AS STRING), 'x') ELSE CAST(value AS STRING) END AS value,
               props
        FROM {events}""",
    "undrifted": "SELECT event_id, ts, user_id, event_type, CAST(value AS STRING) AS value FROM {events}",
    "timed_runs": """
        SELECT l.l_orderkey, l.l_linenumber, o.o_orderdate AS start_time, l.l_shipdate AS end_time
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    "documents": "SELECT doc_id, text FROM {documents}",
    "pages": "SELECT page_id, html FROM {pages}",
    "conversations": "SELECT conv_id, turn, text FROM {conversations}",
    "events": "SELECT event_id, ts, user_id, event_type, value, props FROM {events}",
    "lineitem": "SELECT * FROM {lineitem}",
    "orders": "SELECT * FROM {orders}",
    "part": "SELECT * FROM {part}",
}


# Spark takes the latest row per key as an aggregate: one row per key and task is shuffled.
SPARK_FORM = {
    "models": INPUTS["models"].replace(
        INPUTS["models"][INPUTS["models"].index("SELECT l_suppkey, l_partkey FROM (") : INPUTS["models"].index(") f ON")],
        """SELECT l_suppkey, max_by(l_partkey, struct(l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS l_partkey
           FROM {lineitem} GROUP BY l_suppkey""",
    )
}


def given_tables(name: str) -> list[str]:
    """The given tables an input is built from."""
    return sorted({field for _, field, _, _ in string.Formatter().parse(INPUTS[name]) if field})


class Inputs:
    """``Inputs(spark, folder).runs`` is the ``runs`` input as a lazy DataFrame, planned once."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        self._given: dict[str, DataFrame] = {}

    def given(self, table: str) -> DataFrame:
        if table not in self._given:
            self._given[table] = self.spark.read.parquet(f"{self.folder}/{table}.parquet")
        return self._given[table]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in INPUTS:
            raise AttributeError(name)
        made = self.spark.sql(SPARK_FORM.get(name, INPUTS[name]), **{t: self.given(t) for t in given_tables(name)})
        self.__dict__[name] = made
        return made


def as_sql(name: str) -> str:
    """The input as a statement over the given tables by name."""
    return INPUTS[name].format(**{t: t for t in given_tables(name)})
