"""Dialects, severities, titles and word lists the rules agree on."""

# Dialect names; an unknown name counts as the first.
DIALECTS = ["bigquery", "postgres", "mysql", "snowflake", "spark", "sqlite", "tsql", "oracle", "duckdb", "redshift"]
#: dialects in which "x" is a string and not an identifier
DOUBLE_QUOTE_STRINGS = ["bigquery", "mysql", "spark"]

# Severities from mild to grave, and the score each finding costs.
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2}
SEVERITY_WEIGHT = {"low": 5, "medium": 12, "high": 30}

# Sizes up to which an interactive check answers; reported, never enforced here.
MAX_SQL_CHARS = 100_000
MAX_TABLES = 200
MAX_COLUMNS = 5_000

# Words that may start a statement and are offered as typo corrections.
STARTERS = [
    "select", "insert", "update", "delete", "with", "create", "merge", "alter", "drop",
    "truncate", "explain", "grant", "revoke", "set", "show",
]
#: further words a statement may start with
OTHER_STARTERS = [
    "values", "from", "call", "use", "describe", "desc", "begin", "commit", "rollback", "analyze", "cache",
    "refresh", "declare", "pragma", "copy", "load", "comment", "attach", "detach", "exec", "execute", "replace", "end",
]

#: reserved words: never a column, table or alias name
KEYWORDS = """
ALL ALTER AND ANTI ANY AS ASC BETWEEN BY CASE COLLATE CREATE CROSS CURRENT_DATE CURRENT_TIME CURRENT_TIMESTAMP
DELETE DESC DISTINCT DROP ELSE END ESCAPE EXCEPT EXISTS FALSE FETCH FOLLOWING FROM FULL GROUP HAVING ILIKE IN INNER
INSERT INTERSECT INTERVAL INTO IS JOIN LATERAL LEFT LIKE LIMIT MERGE MINUS NATURAL NOT NULL NULLS OFFSET ON OR ORDER
OUTER OVER OVERWRITE PARTITION PIVOT PRECEDING QUALIFY RANGE RECURSIVE REGEXP RETURNING RIGHT RLIKE ROWS SELECT SEMI
SET SOME TABLE TABLESAMPLE THEN TRUE TRUNCATE UNBOUNDED UNION UNPIVOT UPDATE USING VALUES WHEN WHERE WINDOW WITH
CONNECT START PRIOR
""".split()

#: type names; next to another word they do not hint at a forgotten comma
TYPES = """
ARRAY BIGINT BINARY BOOL BOOLEAN BYTES CHAR DATE DATETIME DECIMAL DOUBLE FLOAT FLOAT64 INT INT64 INTEGER JSON MAP
NUMERIC NVARCHAR REAL SMALLINT STRING STRUCT TEXT TIME TIMESTAMP TIMESTAMPTZ TINYINT UUID VARBINARY VARCHAR AT ZONE
""".split()

#: aggregate functions
AGGREGATES = """
ANY_VALUE APPROX_COUNT_DISTINCT APPROX_DISTINCT APPROX_QUANTILES ARRAY_AGG AVG BIT_AND BIT_OR BIT_XOR BOOL_AND
BOOL_OR COLLECT_LIST COLLECT_SET CORR COUNT COUNTIF COUNT_IF COVAR_POP COVAR_SAMP FIRST FIRST_VALUE GROUP_CONCAT LAG
LAST LAST_VALUE LEAD LISTAGG LOGICAL_AND LOGICAL_OR MAX MAX_BY MEDIAN MIN MIN_BY NTH_VALUE PERCENTILE_CONT
PERCENTILE_DISC QUANTILE STDDEV STDDEV_POP STDDEV_SAMP STRING_AGG SUM VARIANCE VAR_POP VAR_SAMP
""".split()

#: functions that hide a column from an index or from pruning
WRAPPERS = ["CAST", "TRY_CAST", "SAFE_CAST", "DATE", "UPPER", "LOWER", "UCASE", "LCASE", "SUBSTR", "SUBSTRING"]
COALESCES = ["COALESCE", "IFNULL", "NVL"]
NEEDS_ORDER = ["ROW_NUMBER", "LAG", "LEAD"]
DATE_PARTS = ["YEAR", "QUARTER", "MONTH", "WEEK", "DAY", "HOUR", "MINUTE", "SECOND", "DOW", "DOY", "EPOCH", "DATE", "ISOWEEK"]

# Finding titles with their severities, in order of evaluation.
TITLES = [
    ("L01", "DELETE without WHERE", "high"),
    ("L01", "UPDATE without WHERE", "high"),
    ("L02", "CROSS JOIN found", "high"),
    ("L03", "JOIN without ON condition", "high"),
    ("L04", "SELECT * used", "medium"),
    ("L05", "LIMIT without ORDER BY", "medium"),
    ("L06", "LIKE starts with %", "medium"),
    ("L07", "NOT IN with a subquery", "medium"),
    ("L08", "Function wrapped around a column in WHERE", "low"),
    ("L09", "UNION (not UNION ALL)", "low"),
    ("L10", "HAVING used without an aggregate", "medium"),
    ("L11", "Selected column missing from GROUP BY", "high"),
    ("L12", "ORDER BY in a subquery without LIMIT", "low"),
    ("L13", "CASE without ELSE", "medium"),
    ("L14", "JOIN ON true", "high"),
    ("L14", "JOIN ON 1=1", "high"),
    ("L15", "COALESCE in an equality comparison", "medium"),
    ("L16", "ROW_NUMBER/LAG/LEAD without ORDER BY", "medium"),
    ("L17", "INSERT without a column list", "medium"),
    ("L18", "WHERE clause nullifies an outer JOIN", "high"),
    ("L19", "BETWEEN with bare date literals", "medium"),
    ("L20", "ORDER BY column position", "low"),
    ("L21", "Scalar subquery without LIMIT 1", "medium"),
    ("L22", "UPDATE ... FROM without a join condition", "high"),
    ("L23", "Aggregate mixed with a non-grouped column", "high"),
    ("L24", "Aggregate function wraps a window function", "high"),
    ("L25", "`= NULL` never matches", "high"),
    ("L25", "`!= NULL` never matches", "high"),
    ("L26", "OFFSET without ORDER BY", "medium"),
    ("L27", "Mixed ordinal and column name in GROUP BY", "low"),
    ("L27", "Mixed ordinal and column name in ORDER BY", "low"),
    ("L28", "Redundant DISTINCT with GROUP BY", "low"),
    ("L29", "CTE defined but never used", "low"),
    ("L30", "Joined table never used", "medium"),
    ("L31", "Unqualified column with multiple tables joined", "low"),
    ("L32", "Alias referenced inside its own OVER()", "high"),
    ("L33", "Self-join without a distinguishing alias", "high"),
    ("L34", "Table alias leaked into a column qualifier", "high"),
    ("L36", "Unknown table", "high"),
    ("L37", "Unknown column", "high"),
    ("L35", "Possible missing comma", "high"),
]
FIXABLE = [
    "`= NULL` never matches",
    "`!= NULL` never matches",
    "Redundant DISTINCT with GROUP BY",
    "CASE without ELSE",
    "Table alias leaked into a column qualifier",
]
