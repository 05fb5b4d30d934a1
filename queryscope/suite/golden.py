"""SQL texts with the titles that must (and must not) come out, per rule.

``{n}`` becomes the author's key, so that texts of one template differ. All texts are about a harbour: ships, docks,
crews, cargo and visits.
"""

#: rule -> [(text, titles of this rule that fire)]
GOLDEN: dict[str, list[tuple[str, list[str]]]] = {
    "L01": [
        ("DELETE FROM visits_{n}", ["DELETE without WHERE"]),
        ("UPDATE cargo SET state = 'gone', seen = {n}", ["UPDATE without WHERE"]),
        ("DELETE FROM visits WHERE left_at < {n}", []),
        ("UPDATE cargo SET dock = {n} WHERE ship IN (SELECT ship FROM visits WHERE open)", []),
    ],
    "L02": [
        ("SELECT s.flag, d.zone FROM ships s CROSS JOIN docks d WHERE d.depth > {n}", ["CROSS JOIN found"]),
        ("SELECT s.flag, d.zone FROM ships s INNER JOIN docks d ON d.dock = s.dock WHERE d.depth > {n}", []),
    ],
    "L03": [
        ("SELECT s.flag, v.day FROM ships s LEFT JOIN visits v WHERE s.tons = {n}", ["JOIN without ON condition"]),
        ("SELECT s.flag, v.day FROM visits v, ships s WHERE v.ship = {n}", ["JOIN without ON condition"]),
        ("SELECT s.flag, v.day FROM ships s JOIN visits v USING (ship) WHERE s.tons = {n}", []),
        ("SELECT s.flag, d.zone FROM ships s CROSS JOIN docks d WHERE s.tons = {n}", []),
        ("SELECT s.flag, d.zone FROM ships s JOIN visits v ON v.ship = s.ship RIGHT OUTER JOIN docks d ON d.dock = v.dock WHERE s.tons = {n}", []),
    ],
    "L04": [
        ("SELECT * FROM crews WHERE ship = {n}", ["SELECT * used"]),
        ("SELECT COUNT(*), MAX(tons * rate) FROM cargo WHERE ship = {n}", []),
        ("SELECT c.* FROM crews c WHERE c.ship = {n}", []),
        ("SELECT mate FROM (SELECT * FROM crews) all_crews WHERE ship = {n}", ["SELECT * used"]),
    ],
    "L05": [
        ("SELECT mate FROM crews WHERE ship = {n} LIMIT 3", ["LIMIT without ORDER BY"]),
        ("SELECT mate FROM crews WHERE ship = {n} ORDER BY hired_on LIMIT 3", []),
        ("SELECT mate FROM crews UNION ALL SELECT cook FROM galleys WHERE ship = {n} LIMIT 8", []),
        ("SELECT dock, ARRAY_AGG(ship ORDER BY tons LIMIT 2) FROM visits WHERE day = {n} GROUP BY dock", []),
        ("SELECT mate FROM (SELECT mate FROM crews WHERE ship = {n} LIMIT 2) few ORDER BY mate", ["LIMIT without ORDER BY"]),
    ],
    "L06": [
        ("SELECT ship FROM ships WHERE flag LIKE '%land{n}'", ["LIKE starts with %"]),
        ("SELECT ship FROM ships WHERE flag NOT ILIKE '%isle{n}%'", ["LIKE starts with %"]),
        ("SELECT ship FROM ships WHERE flag LIKE 'nor{n}%'", []),
    ],
    "L07": [
        ("SELECT ship FROM ships WHERE dock NOT IN (SELECT dock FROM closures WHERE day = {n})", ["NOT IN with a subquery"]),
        ("SELECT ship FROM ships WHERE dock NOT IN (4, 8, {n})", []),
        ("SELECT ship FROM ships WHERE dock IN (SELECT dock FROM closures WHERE day = {n})", []),
    ],
    "L08": [
        ("SELECT ship FROM visits WHERE LOWER(pilot) = 'ines' AND dock = {n}", ["Function wrapped around a column in WHERE"]),
        ("SELECT ship FROM visits WHERE CAST(dock AS VARCHAR) = '{n}'", ["Function wrapped around a column in WHERE"]),
        ("SELECT ship FROM visits WHERE dock::text = '{n}'", ["Function wrapped around a column in WHERE"]),
        ("SELECT LOWER(pilot) FROM visits WHERE dock = {n}", []),
        ("SELECT ship FROM visits WHERE day = DATE('2023-07-09') AND dock = {n}", []),
    ],
    "L09": [
        ("SELECT pilot FROM visits UNION SELECT mate FROM crews WHERE ship = {n}", ["UNION (not UNION ALL)"]),
        ("SELECT pilot FROM visits UNION ALL SELECT mate FROM crews WHERE ship = {n}", []),
        ("SELECT pilot FROM visits EXCEPT SELECT mate FROM crews WHERE ship = {n}", []),
    ],
    "L10": [
        ("SELECT dock, SUM(tons) FROM cargo GROUP BY dock HAVING dock <> {n}", ["HAVING used without an aggregate"]),
        ("SELECT dock, SUM(tons) FROM cargo GROUP BY dock HAVING SUM(tons) < {n}", []),
    ],
    "L11": [
        ("SELECT dock, pilot, MIN(day) FROM visits WHERE ship = {n} GROUP BY dock", ["Selected column missing from GROUP BY"]),
        ("SELECT dock, MIN(day) FROM visits WHERE ship = {n} GROUP BY dock", []),
        ("SELECT dock, MIN(day) FROM visits WHERE ship = {n} GROUP BY 1", ["Selected column missing from GROUP BY"]),
        ("SELECT LOWER(pilot) AS p, MIN(day) AS first_day FROM visits WHERE ship = {n} GROUP BY pilot", []),
    ],
    "L12": [
        ("SELECT x.ship FROM (SELECT ship FROM ships WHERE tons > {n} ORDER BY tons) x", ["ORDER BY in a subquery without LIMIT"]),
        ("SELECT x.ship FROM (SELECT ship FROM ships WHERE tons > {n} ORDER BY tons LIMIT 4) x", []),
        ("WITH heavy AS (SELECT ship FROM ships WHERE tons > {n} ORDER BY tons) SELECT ship FROM heavy", ["ORDER BY in a subquery without LIMIT"]),
        ("SELECT SUM(tons) OVER (PARTITION BY dock ORDER BY day) FROM (SELECT dock, day, tons FROM cargo WHERE ship = {n}) x", []),
    ],
    "L13": [
        ("SELECT CASE WHEN tons > {n} THEN 'heavy' END AS class FROM ships", ["CASE without ELSE"]),
        ("SELECT CASE WHEN tons > {n} THEN 'heavy' ELSE 'light' END AS class FROM ships", []),
        ("SELECT CASE flag WHEN 'no' THEN CASE WHEN tons > {n} THEN 2 END ELSE 0 END AS class FROM ships", ["CASE without ELSE"]),
    ],
    "L14": [
        ("SELECT s.ship, d.zone FROM ships s JOIN docks d ON 7 = 7 WHERE s.tons = {n}", ["JOIN ON 1=1"]),
        ("SELECT s.ship, d.zone FROM ships s LEFT JOIN docks d ON true WHERE s.tons = {n}", ["JOIN ON true"]),
        ("SELECT s.ship, d.zone FROM ships s JOIN docks d ON d.dock = s.dock WHERE s.tons = {n}", []),
        ("SELECT s.ship, d.zone FROM ships s JOIN docks d ON 7 = 7 AND d.dock = s.dock WHERE s.tons = {n}", []),
    ],
    "L15": [
        ("SELECT ship FROM ships WHERE NVL(flag, '{n}') = NVL(home, '{n}')", ["COALESCE in an equality comparison"]),
        ("SELECT ship FROM ships WHERE dock = COALESCE(last_dock, {n})", ["COALESCE in an equality comparison"]),
        ("SELECT IFNULL(flag, home) AS f FROM ships WHERE dock = {n}", []),
        ("SELECT ship FROM ships WHERE COALESCE(tons, 1) <= {n}", []),
    ],
    "L16": [
        ("SELECT LEAD(day) OVER (PARTITION BY ship_{n}) FROM visits", ["ROW_NUMBER/LAG/LEAD without ORDER BY"]),
        ("SELECT LEAD(day) OVER (PARTITION BY ship_{n} ORDER BY day) FROM visits", []),
        ("SELECT ROW_NUMBER() OVER (ORDER BY day), LAG(dock, 2) OVER (PARTITION BY ship_{n}) FROM visits", ["ROW_NUMBER/LAG/LEAD without ORDER BY"]),
        ("SELECT DENSE_RANK() OVER (PARTITION BY ship_{n}) FROM visits", []),
    ],
    "L17": [
        ("INSERT INTO docks VALUES ({n}, 'north', 14)", ["INSERT without a column list"]),
        ("INSERT INTO docks (dock, zone) VALUES ({n}, 'north')", []),
        ("INSERT INTO docks SELECT dock, zone, depth FROM surveys WHERE year = {n}", ["INSERT without a column list"]),
        ("INSERT docks VALUES ({n}, 'south', 9)", ["INSERT without a column list"]),
        ("INSERT OVERWRITE TABLE docks SELECT dock, zone FROM surveys WHERE year = {n}", ["INSERT without a column list"]),
        ("INSERT OVERWRITE docks (dock) SELECT dock FROM surveys WHERE year = {n}", []),
    ],
    "L18": [
        ("SELECT s.ship FROM ships s LEFT JOIN visits v ON v.ship = s.ship WHERE v.dock = {n}", ["WHERE clause nullifies an outer JOIN"]),
        ("SELECT s.ship, v.day FROM ships s LEFT JOIN visits v ON v.ship = s.ship AND v.dock = {n}", []),
        ("SELECT s.ship FROM ships s LEFT JOIN visits v ON v.ship = s.ship WHERE v.ship IS NULL AND s.tons > {n}", []),
        ("SELECT s.ship, v.day FROM ships s LEFT JOIN visits v ON v.ship = s.ship WHERE s.tons > {n}", []),
        ("SELECT v.day FROM ships s RIGHT JOIN visits v ON v.ship = s.ship WHERE s.tons > {n}", ["WHERE clause nullifies an outer JOIN"]),
        ("SELECT v.day FROM ships s FULL JOIN visits v ON v.ship = s.ship WHERE s.tons > {n}", ["WHERE clause nullifies an outer JOIN"]),
        ("SELECT s.ship FROM ships s LEFT JOIN visits v ON v.ship = s.ship WHERE v.day IS NOT NULL AND v.dock < {n}", []),
        ("SELECT s.ship FROM ships s LEFT JOIN visits v ON v.ship = s.ship WHERE NVL(v.pilot, 'nobody') <> 'p{n}'", []),
        ("SELECT s.ship FROM ships s LEFT JOIN visits v ON v.ship = s.ship WHERE v.dock = {n} OR s.flag = 'no'", []),
        ("SELECT s.ship FROM ships s LEFT JOIN visits v ON v.ship = s.ship WHERE IFNULL(v.fee, 0) + 1 > 0 AND s.tons = {n}", []),
        ("SELECT s.ship FROM ships s LEFT JOIN visits v ON v.ship = s.ship WHERE IFNULL(v.fee, 0) - 1 > 0 AND s.tons = {n}", ["WHERE clause nullifies an outer JOIN"]),
        ("SELECT s.ship FROM ships s LEFT JOIN visits v ON v.ship = s.ship WHERE COALESCE(v.pilot, 'none') IN ('none', 'p{n}')", []),
        ("SELECT s.ship FROM ships s LEFT JOIN visits v ON v.ship = s.ship WHERE COALESCE(v.pilot, 'none') NOT IN ('none', 'p{n}')", ["WHERE clause nullifies an outer JOIN"]),
        ("SELECT s.ship FROM ships s LEFT JOIN visits v ON v.ship = s.ship WHERE CASE WHEN v.fee IS NULL THEN 1 ELSE v.fee END > 0 AND s.tons = {n}", []),
    ],
    "L19": [
        ("SELECT ship FROM visits WHERE day BETWEEN '2023-03-05' AND '2023-04-05' AND dock = {n}", ["BETWEEN with bare date literals"]),
        ("SELECT ship FROM visits WHERE dock BETWEEN 3 AND {n}", []),
        ("SELECT ship FROM visits WHERE day BETWEEN '2023-03-05 06:00' AND '2023-04-05 18:00' AND dock = {n}", []),
    ],
    "L20": [
        ("SELECT ship, day FROM visits WHERE dock = {n} ORDER BY 2", ["ORDER BY column position"]),
        ("SELECT ship, day FROM visits WHERE dock = {n} ORDER BY day ASC", []),
        ("select ship, v.day from visits v where v.dock = {n} order by ship, 2 asc", ["ORDER BY column position"]),
    ],
    "L21": [
        ("SELECT s.ship, (SELECT v.day FROM visits v WHERE v.ship = s.ship) AS seen FROM ships s WHERE s.tons = {n}", ["Scalar subquery without LIMIT 1"]),
        ("SELECT s.ship, (SELECT v.day FROM visits v WHERE v.ship = s.ship LIMIT 1) AS seen FROM ships s WHERE s.tons = {n}", []),
        ("SELECT s.ship, (SELECT MIN(v.day) FROM visits v WHERE v.ship = s.ship) AS seen FROM ships s WHERE s.tons = {n}", []),
        ("SELECT s.ship, (SELECT SUM(tons) AS load FROM cargo) AS total FROM ships s WHERE s.tons = {n}", []),
        ("SELECT ship FROM ships WHERE dock IN (SELECT dock FROM docks WHERE depth = {n})", []),
    ],
    "L22": [
        ("UPDATE ships SET dock = v.dock FROM visits v WHERE ships.tons = {n} AND ships.open", ["UPDATE ... FROM without a join condition"]),
        ("UPDATE ships SET dock = visits.dock FROM visits WHERE ships.ship = visits.ship AND visits.day = {n}", []),
    ],
    "L23": [
        ("SELECT pilot, MAX(day) FROM visits WHERE dock = {n}", ["Aggregate mixed with a non-grouped column"]),
        ("SELECT pilot, MAX(day) FROM visits WHERE dock = {n} GROUP BY pilot", []),
        ("SELECT MAX(day) FROM visits WHERE dock = {n}", []),
        ("SELECT SUM(tons) FILTER (WHERE frozen) FROM cargo WHERE dock = {n}", []),
        ("SELECT pilot, MAX(day) OVER (PARTITION BY pilot) FROM visits WHERE dock = {n}", []),
        ("SELECT ship, (SELECT MIN(depth) FROM docks) AS shallow FROM ships WHERE dock = {n}", []),
    ],
    "L24": [
        ("SELECT MAX(COUNT(ship) OVER (PARTITION BY dock)) FROM visits WHERE day = {n} GROUP BY dock", ["Aggregate function wraps a window function"]),
        ("SELECT MAX(tons) OVER (PARTITION BY dock) FROM cargo WHERE ship = {n}", []),
    ],
    "L25": [
        ("SELECT ship FROM ships WHERE flag = NULL AND dock = {n}", ["`= NULL` never matches"]),
        ("SELECT ship FROM ships WHERE flag <> NULL AND dock = {n}", ["`!= NULL` never matches"]),
        ("SELECT ship FROM ships WHERE flag IS NOT NULL AND dock = {n}", []),
        ("UPDATE ships SET flag = NULL WHERE dock = {n}", []),
        ("SELECT ship FROM ships WHERE dock = {n} AND NULL != flag", ["`!= NULL` never matches"]),
        ("SELECT ship FROM ships WHERE flag == NULL AND dock = {n}", ["`= NULL` never matches"]),
    ],
    "L26": [
        ("SELECT ship FROM ships WHERE dock = {n} LIMIT 6 OFFSET 12", ["OFFSET without ORDER BY"]),
        ("SELECT ship FROM ships WHERE dock = {n} ORDER BY ship LIMIT 6 OFFSET 12", []),
    ],
    "L27": [
        ("SELECT dock, pilot, MAX(day) FROM visits WHERE ship = {n} GROUP BY dock, 2", ["Mixed ordinal and column name in GROUP BY"]),
        ("SELECT dock, pilot, MAX(day) FROM visits WHERE ship = {n} GROUP BY dock, pilot", []),
        ("SELECT dock, pilot FROM visits WHERE ship = {n} ORDER BY pilot, 1", ["Mixed ordinal and column name in ORDER BY"]),
    ],
    "L28": [
        ("SELECT DISTINCT dock, pilot FROM visits WHERE ship = {n} GROUP BY dock, pilot", ["Redundant DISTINCT with GROUP BY"]),
        ("SELECT DISTINCT dock, pilot FROM visits WHERE ship = {n}", []),
        ("SELECT SUM(DISTINCT tons) FROM cargo WHERE ship = {n} GROUP BY dock", []),
    ],
    "L29": [
        ("WITH late AS (SELECT {n} AS day) SELECT ship FROM visits", ["CTE defined but never used"]),
        ("WITH late AS (SELECT {n} AS day) SELECT day FROM late", []),
        ("WITH late AS (SELECT {n} AS day), later AS (SELECT day FROM late) SELECT day FROM later", []),
    ],
    "L30": [
        ("SELECT s.flag FROM ships s JOIN docks d ON d.dock = s.dock WHERE s.tons = {n}", ["Joined table never used"]),
        ("SELECT s.flag, d.zone FROM ships s JOIN docks d ON d.dock = s.dock WHERE s.tons = {n}", []),
        ("SELECT s.flag, d.zone FROM ships s JOIN visits v ON v.ship = s.ship JOIN docks d ON d.dock = v.dock WHERE s.tons = {n}", []),
    ],
    "L31": [
        ("SELECT zone FROM ships s JOIN docks d ON d.dock = s.dock WHERE s.tons = {n}", ["Unqualified column with multiple tables joined"]),
        ("SELECT d.zone FROM ships s JOIN docks d ON d.dock = s.dock WHERE s.tons = {n}", []),
        ("SELECT mate FROM crews, UNNEST(mates) AS mate WHERE crews.ship = {n}", []),
    ],
    "L32": [
        ("SELECT SUM(tons) OVER (PARTITION BY load ORDER BY day_{n}) AS load FROM cargo", ["Alias referenced inside its own OVER()"]),
        ("SELECT SUM(tons) OVER (PARTITION BY dock ORDER BY day_{n}) AS load FROM cargo", []),
    ],
    "L33": [
        ("SELECT crews.mate FROM crews JOIN crews ON crews.boss = {n}", ["Self-join without a distinguishing alias"]),
        ("SELECT c.mate FROM crews c LEFT JOIN crews c ON c.boss = {n}", ["Self-join without a distinguishing alias"]),
        ("SELECT c.mate FROM crews c JOIN crews b ON b.mate = c.boss WHERE b.ship = {n}", []),
    ],
    "L34": [
        ("SELECT s.ship, (SELECT MAX(s.v.day) FROM visits v WHERE v.ship = s.ship) AS seen FROM ships s WHERE s.tons = {n}",
         ["Table alias leaked into a column qualifier"]),
        ("SELECT s.ship, (SELECT MAX(v.day) FROM visits v WHERE v.ship = s.ship) AS seen FROM ships s WHERE s.tons = {n}", []),
        ("SELECT ship FROM `harbour.ships` WHERE tons = {n}", []),
    ],
    "L35": [
        ("SELECT ship, flag home, tons FROM ships WHERE dock = {n}", ["Possible missing comma"]),
        ("SELECT ship, flag AS home, tons FROM ships WHERE dock = {n}", []),
        ("SELECT ship FROM ships WHERE dock = {n}; SELECT berth depth FROM docks", ["Possible missing comma"]),
        ("SELECT s.ship, d.zone FROM ships s JOIN docks d ON d.dock = s.dock WHERE s.tons = {n}", []),
    ],
}

#: the one table of the small catalog
SCHEMA = {"ships": ["ship", "tons"]}
GOLDEN_CATALOG = {
    "L36": [
        ("SELECT s.tons FROM shipz s WHERE s.ship = {n}", ["Unknown table"]),
        ("SELECT s.tons FROM ships s WHERE s.ship = {n}", []),
        ("WITH late AS (SELECT {n} AS day) SELECT day FROM late", []),
        ("SELECT p.zone, q.depth FROM piers p JOIN quays q ON q.dock = p.dock WHERE p.dock = {n}", ["Unknown table"]),
    ],
    "L37": [
        ("SELECT s.tonz FROM ships s WHERE s.ship = {n}", ["Unknown column"]),
        ("SELECT s.tons FROM ships s WHERE s.ship = {n}", []),
        ("SELECT p.zone FROM piers p WHERE p.dock = {n}", []),
    ],
}

#: dialect, text, fault kind (None = valid), hint kind
INVALID = [
    ("bigquery", "SELEC ship FROM ships WHERE dock = {n}", "unknown statement", "typo"),
    ("bigquery", "updaet ships set dock = {n}", "unknown statement", "typo"),
    ("bigquery", "SELECT FROM ships WHERE dock = {n}", "empty select list", None),
    ("bigquery", "SELECT MAX(tons FROM ships WHERE dock = {n}", "unbalanced parentheses", "parentheses"),
    ("bigquery", "SELECT ship FROM ships JOIN ON dock = {n}", "join without a table", None),
    ("bigquery", "SELECT ship FROM {{ ref('ships') }} WHERE dock = {n}", "template text", None),
    ("bigquery", "SELECT ship FROM ships WHERE dock = {n}", None, None),
    ("bigquery", "SELECT '(' AS bracket FROM ships WHERE dock = {n}", None, None),
    ("bigquery", "PLUGH 41 {n}", "unknown statement", "adjacent"),
    ("bigquery", "SELECT ship FROM WHERE dock = {n}", "missing table", None),
    ("bigquery", "SELECT ship,, flag FROM ships WHERE dock = {n}", "stray comma", None),
    ("bigquery", "SELECT ship FROM ships WHERE dock = {n} GROUP ship", "GROUP without BY", None),
    ("bigquery", "SELECT ship FROM ships WHERE dock = {n} ORDER ship", "ORDER without BY", None),
    ("bigquery", "SELECT ship FROM ships WHERE AND dock = {n}", "empty condition", None),
    ("bigquery", "SELECT ship FROM ships WHERE dock = {n} AND ORDER BY ship", "empty condition", None),
    ("postgres", "SELECT ship, FROM ships WHERE dock = {n}", "stray comma", None),
    ("bigquery", "SELECT ship FROM ships # it's a note\nWHERE dock = {n}", None, None),
    ("mysql", "SELECT ship FROM ships WHERE flag = 'it\\'s' AND dock = {n}", None, None),
    ("postgres", "SELECT $$it's$$ AS word FROM ships WHERE dock = {n}", None, None),
    ("sqlite", "SELECT ship FROM ships WHERE flag = 'it's' AND dock = {n}", "unterminated quote", "adjacent"),
]

#: dialect, text that no fault may be found in
VALID = [
    ("bigquery", "SELECT dock, STRING_AGG(pilot, '; ' ORDER BY day DESC LIMIT 3) FROM visits GROUP BY dock"),
    ("bigquery", "SELECT ship FROM visits QUALIFY RANK() OVER (PARTITION BY dock ORDER BY day DESC) <= 2"),
    ("bigquery", "SELECT s.ship, m FROM ships AS s, UNNEST(s.mates) AS m WITH OFFSET AS place"),
    ("bigquery", "SELECT ship, flag, FROM ships"),
    ("mysql", "INSERT INTO docks (dock, zone) VALUES (5, 'east') ON DUPLICATE KEY UPDATE zone = 'east'"),
    ("mysql", "SELECT dock, GROUP_CONCAT(ship ORDER BY tons SEPARATOR '/') FROM visits GROUP BY dock"),
    ("postgres", "SELECT log -> 'wind' ->> 'knots' FROM visits WHERE log @> '{\"calm\": true}'"),
    ("postgres", "SELECT d.zone, x.ship FROM docks d CROSS JOIN LATERAL (SELECT ship FROM visits v WHERE v.dock = d.dock LIMIT 1) x"),
    ("postgres", "WITH RECURSIVE chain(mate) AS (SELECT boss FROM crews UNION SELECT c.boss FROM crews c JOIN chain ON chain.mate = c.mate) TABLE chain"),
    ("snowflake", "SELECT v.log:wind.knots::float FROM visits v"),
    ("snowflake", "SELECT * FROM cargo UNPIVOT (load FOR hold IN (fore, aft))"),
    ("spark", "SELECT posexplode(mates) AS (place, mate) FROM crews DISTRIBUTE BY ship"),
    ("tsql", "SELECT TOP (4) pilot FROM visits WITH (NOLOCK) ORDER BY day"),
    ("tsql", "DECLARE @dock INT = 3; SELECT ship FROM ships WHERE dock = @dock"),
    ("oracle", "SELECT LISTAGG(ship, ',') WITHIN GROUP (ORDER BY tons) FROM visits"),
    ("duckdb", "FROM visits SELECT dock, list_transform(tons, x -> x * 2)"),
    ("sqlite", "REPLACE INTO docks (dock, zone) SELECT dock, zone FROM surveys"),
    ("redshift", "SELECT ship, MEDIAN(tons) OVER (PARTITION BY dock) FROM cargo"),
]

_OTHER = "FROM visits w WHERE w.dock = v.dock AND w.tons"
#: text, does a decorrelating rewrite of it risk a wrong result
DECORRELATION = [
    *[
        (f"SELECT v.ship, (SELECT {agg} {_OTHER} {op} v.tons) AS r FROM visits v WHERE v.day = {{n}}", True)
        for agg, op in [("COUNT(w.ship)", ">="), ("COUNT(*)", "<="), ("SUM(w.fee)", "<"), ("AVG(w.fee)", "<>"), ("MIN(w.fee)", "<"), ("MAX(w.fee)", ">=")]
    ],
    (f"SELECT v.ship FROM visits v WHERE v.day = {{n}} AND v.pilot IN (SELECT w.pilot {_OTHER} < v.tons)", True),
    (f"SELECT v.ship FROM visits v WHERE v.day = {{n}} AND v.pilot NOT IN (SELECT w.pilot {_OTHER} < v.tons)", True),
    (f"SELECT v.ship FROM visits v WHERE v.day = {{n}} AND NOT EXISTS (SELECT w.ship {_OTHER} < v.tons)", False),
    ("SELECT v.ship FROM visits v WHERE v.dock IN (SELECT w.dock FROM visits w WHERE w.fee < {n})", False),
    ("SELECT v.ship, (SELECT MAX(w.day) FROM visits w WHERE w.dock = v.dock AND w.pilot = v.pilot) AS r FROM visits v WHERE v.day = {n}", False),
]
