"""The registered queries; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from queryscope.llm import decontaminate, langid, lattice, minhash, mixing, ngram, packing, quality, repair, sharding, tokencount, trie, url_filter
from queryscope.llm.common import fold, prepare
from queryscope.session import cut

ALLOW = ("org/", "com/fr/")
BLOCK = ("example.org/es/", "example.org/en/1", "com/de/")
TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str = TOKENIZER) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = lambda spark, folder: fn(prepare(spark), folder)
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_url_filter")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """A page is labelled by the quality of the document that its path names; URL token sets that come with quality 0 block."""
    pages, labels = table(spark, folder, "pages"), table(spark, folder, "labels")
    # written before the join, so that adaptive execution can split a document with very many pages
    bad = cut(labels.groupBy("doc_id").agg((F.min("quality") == 0).alias("bad")))
    named = pages.select("page_id", "url", url_filter.document_of(F.col("url")).alias("doc_id")).where("doc_id is not null")
    labelled = named.join(bad, "doc_id").select("page_id", "url", "bad")
    return url_filter.judge(pages, labelled, allow=ALLOW, block=BLOCK)


@query("op2_language_id")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.identify(docs, model, ["doc_id", "held_out"])


@query("op3_best_fit_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pieces(table(spark, folder, "documents"), vocabulary(), ["doc_id"])
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


OP4_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
       WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r, a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
          WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / (a.n * b.n) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
counted AS (SELECT r, count(*) AS n_links FROM links GROUP BY r)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM v LEFT JOIN counted USING (r) LEFT JOIN least ON vec_id = a
"""


@query("op4_lattice_dedup", OP4_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.near_vectors(table(spark, folder, "embeddings"))


OP5_SQL = r"""
WITH up AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' u, 'abcdefghijklmnopqrstuvwxyz' l),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents, up),
b AS (SELECT item_id, regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, up WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS k
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, dw.n, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, n, i FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""


@query("op5_decontaminate", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op6_ngram_scores")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", fold(F.col("doc_id"), 5) == 1)
    return ngram.train_and_score(docs, docs.where(~F.col("held_out")), ["doc_id", "held_out"])


@query("op7_quality_scores")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", fold(F.col("doc_id"), 5) == 0)
    labels = table(spark, folder, "labels").where(fold(F.col("doc_id"), 5) != 0)
    model = quality.fit(docs.where(~F.col("held_out")), labels)
    return quality.score(docs, model, ["doc_id", "held_out"])


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
  coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT r, doc_id, array_to_string(w[i : i + 4], ' ') AS k
      FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, doc_id, count(*) AS n FROM s GROUP BY r, doc_id),
both_ AS (SELECT a.r AS ra, b.r AS rb, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM both_ JOIN n x ON ra = x.r JOIN n y ON rb = y.r WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN least ON d.doc_id = a
"""


@query("op8_minhash_dedup", OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query("op9_token_counts")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, folder, "documents"), vocabulary())


@query("op10_sharding")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    tree = sharding.two_regions(8)
    return sharding.shard_documents(table(spark, folder, "documents"), tree, sharding.grown(tree, "8"))


OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents),
s AS (SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
      FROM (SELECT source, CAST(sum(size) AS HUGEINT) AS source_size FROM d GROUP BY source)),
fill AS (SELECT 0 AS n, CAST(sum(source_size) AS HUGEINT) AS level, CAST(sum(w) AS HUGEINT) AS share, CAST(0 AS BIGINT) AS clamped, false AS done FROM s
  UNION ALL
  SELECT n + 1, (SELECT CAST(sum(source_size) AS HUGEINT) FROM s) - CAST(coalesce(sum(3 * source_size) FILTER (WHERE 3 * source_size * share < level * w), 0) AS HUGEINT),
    CAST(sum(w) FILTER (WHERE NOT 3 * source_size * share < level * w) AS HUGEINT), count(*) FILTER (WHERE 3 * source_size * share < level * w),
    count(*) FILTER (WHERE 3 * source_size * share < level * w) = any_value(clamped)
  FROM fill, s WHERE NOT done GROUP BY n),
last AS (SELECT level, share FROM fill ORDER BY n DESC LIMIT 1),
t AS (SELECT source, source_size,
        CASE WHEN 3 * source_size * share < level * w THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(level * w AS DOUBLE) / CAST(share AS DOUBLE) END AS target,
        CASE WHEN 3 * source_size * share < level * w THEN 3 * source_size ELSE (level * w) // share END AS words
      FROM s, last),
o AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (words // source_size) * size + greatest(0, least(size, words % source_size - before)) END AS BIGINT) AS taken,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE words // source_size END AS BIGINT) AS whole
FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source
"""


@query("op12_source_mixing", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def sql_crc32(text: str) -> str:
    """crc32 of an ASCII text in DuckDB: one byte, then eight shifts (-1), folded over a list."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [CAST(ascii(substr({text}, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    fold_ = "lambda x, e: CASE WHEN e >= 0 THEN xor(x, e) ELSE xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END) END"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), {fold_}), 4294967295)"


OP11_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) - 1 AS pos,
  md5(length(role) || ':' || role || text) AS d, CAST(length(text) AS BIGINT) AS n
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, {sql_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS head FROM t),
r AS (SELECT c.conv_id, 0 AS own, pos, d, n FROM c JOIN t ON t.conv_id = c.base AND pos < head UNION ALL SELECT t.conv_id, 1, pos, d, n FROM t JOIN c USING (conv_id) WHERE pos >= head),
q AS (SELECT conv_id, list(d ORDER BY own, pos) AS d, list(n ORDER BY own, pos) AS n FROM r GROUP BY conv_id),
a AS (SELECT conv_id, coalesce(d, []) AS d, coalesce(n, []) AS n FROM c LEFT JOIN q USING (conv_id)),
m AS (SELECT conv_id, k AS depth, len(d) = k AS ends, md5(array_to_string(d[1:k], ',')) AS node, md5(array_to_string(d[1:k - 1], ',')) AS up, CASE WHEN k > 0 THEN n[k] ELSE 0 END AS n
      FROM (SELECT *, unnest(range(0, len(d) + 1)) AS k FROM a)),
v AS (SELECT node, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS w,
        coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids FROM m GROUP BY node, depth),
kids AS (SELECT up, depth - 1 AS depth, count(*) AS n FROM v WHERE depth > 0 GROUP BY up, depth),
x AS (SELECT v.*, coalesce(kids.n, 0) AS n_children FROM v LEFT JOIN kids ON kids.up = v.node AND kids.depth = v.depth),
sub AS (SELECT p.node, p.depth, sum(x.w) AS saved, count(*) FILTER (WHERE x.n_children = 0) AS leaves
        FROM x JOIN m own ON own.conv_id = x.conv_id AND own.depth = x.depth JOIN m p ON p.conv_id = x.conv_id AND p.depth <= x.depth GROUP BY p.node, p.depth)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(x.ids) AS ends_sha256
FROM x JOIN sub ON sub.node = x.node AND sub.depth = x.depth LEFT JOIN v p ON p.node = x.up AND p.depth = x.depth - 1
"""


@query("op11_prefix_trie", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations start with the first 0 to 5 turns of their hundred's first one."""
    turns = trie.turns_of(table(spark, folder, "conversations"))
    turns, sizes = trie.rebuilt(turns, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6, F.col("conv_id") - F.col("conv_id") % 100, 5)
    parts = trie.segments(turns, sizes)
    return trie.with_end_digests(trie.nodes(parts), parts).drop("n_ends", "end")


def sql_repair() -> str:
    """A recursive walk over the turns with four states of the role pattern; a state is its cost in 12 digits and its audit."""
    plus = lambda x, cost, edits: f"printf('%012d', CAST(substr({x}, 1, 12) AS BIGINT) + {cost}) || substr({x}, 13) || '{edits}'"
    u_, a_ = (f"least(u, {plus('z', 3, 'I')}, {plus('s', 3, 'I')}, {plus('a', 3, 'I')})", f"least(a, {plus('u', 3, 'I')}, {plus('z', 6, 'II')}, {plus('s', 6, 'II')})")
    take = lambda x, role: (
        f"CASE WHEN NOT must_go THEN CASE WHEN ini = '{role}' THEN " + plus(x, "extra", "K") + " ELSE " + plus(x, "(3 + extra)", "R") + " END END"
    )
    return rf"""
WITH RECURSIVE e AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
f AS (SELECT *, {sql_crc32("k")} % 20 AS d FROM e),
g AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS c FROM f WHERE d <> 0),
h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), c) AS pos FROM g),
i AS (SELECT *, substr(role, 1, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' END AS fault FROM h),
turns AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS must_go, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra,
        lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) || ini NOT IN ('su', 'ua', 'au') AS illegal FROM i),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
        count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal,
        max(pos) AS size FROM turns GROUP BY conv_id),
walk AS (SELECT conv_id, 0 AS pos, '000000000000' AS z, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM n
  UNION ALL
  SELECT w.conv_id, t.pos, {plus("z", 4, "D")},
    least({plus("s", 4, "D")}, CASE WHEN NOT must_go AND ini = 's' THEN {plus("z", "extra", "K")} END),
    least({plus("u", 4, "D")}, {take("z", "u")}, {take("s", "u")}, {take("a", "u")}),
    least({plus("a", 4, "D")}, {take("u", "a")})
  FROM (SELECT conv_id, pos, z, s, {u_} AS u, {a_} AS a FROM walk) w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.pos + 1),
best AS (SELECT w.conv_id, least(z, {a_}) AS x FROM walk w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.size = w.pos),
edits AS (SELECT conv_id, x, j, substr(x, 12 + j, 1) AS edit FROM (SELECT conv_id, x, unnest(range(1, length(x) - 11)) AS j FROM best)),
placed AS (SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER w AS pos, count(*) FILTER (WHERE edit <> 'D') OVER w AS o FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
named AS (SELECT p.conv_id, j, o, edit, t.role, t.ini, CASE WHEN edit = 'I' THEN '' ELSE t.text END AS text,
        max(CASE WHEN o = 1 AND edit = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS sys
      FROM placed p LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.pos = p.pos WHERE edit <> 'D'),
made AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS sha FROM named GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(CAST(substr(x, 1, 12) AS BIGINT), 0) AS BIGINT) AS cost,
  coalesce(substr(x, 13), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN made m ON m.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query("op13_conversation_repair", sql_repair())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return repair.summary(repair.repair(repair.damage(rows)), rows)
