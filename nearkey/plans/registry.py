"""Queries of the search engine over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkey.folders import shared_path, written
from nearkey.functions import bits
from nearkey.functions.text import prefix_edit_distance
from nearkey.operators import index, maintenance, network, search, stored
from nearkey.sources import files, label_files
from nearkey.sources.tables import SQL as MODEL
from nearkey.sources.tables import star_model
from nearkey.streaming import keystrokes

Q, TEXT = 7, "wid"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _rounded(df: DataFrame) -> DataFrame:
    ints = {c: F.col(c).cast("long") for c in ("vertex", "dist", "ped", "rank", "step") if c in df.columns}
    return df.withColumns(ints | {"score": F.round("score", 6)})


# --- SQL pieces ------------------------------------------------------------------------------


def _ped(typed: str, word: str, tau: int) -> str:
    if tau == 0:
        return f"CASE WHEN starts_with({word}, {typed}) THEN 0 END"
    least = f"list_min(list_transform(range(0, CAST(length({word}) AS BIGINT) + 1), lambda i: levenshtein({typed}, substr({word}, 1, CAST(i AS INTEGER)))))"
    return f"CASE WHEN {least} <= {tau} THEN CAST({least} AS BIGINT) END"


def _vertex_ped(text: str, tau: int, name: str = "vertex_ped", keywords: str = "vertex_keywords") -> str:
    return f"""{name}_w AS (SELECT word, {_ped(f"'{text}'", 'word', tau)} AS ped FROM (SELECT DISTINCT word FROM {keywords})
), {name} AS (SELECT vertex, CAST(min(ped) AS BIGINT) AS ped FROM {keywords} JOIN {name}_w USING (word) WHERE ped IS NOT NULL GROUP BY 1)"""


def _dist(q: int, labels: str = "hop_labels") -> str:
    return f"""near AS (SELECT b.vertex, CAST(min(a.dist + b.dist) AS BIGINT) AS dist, CAST(min(a.hub) FILTER (a.dist + b.dist = m) AS BIGINT) AS hub FROM
  (SELECT a.hub, a.dist, b.vertex, b.dist AS bd, min(a.dist + b.dist) OVER (PARTITION BY b.vertex) AS m FROM {labels} a JOIN {labels} b USING (hub) WHERE a.vertex = {q}) x
  JOIN {labels} b ON b.vertex = x.vertex AND b.hub = x.hub JOIN {labels} a ON a.hub = x.hub AND a.vertex = {q} GROUP BY 1)"""


def _score(tau: int, alpha: float, d_max: float, n: int = 1) -> str:
    text = "CAST(0 AS DOUBLE)" if tau == 0 else f"CAST({1 - alpha} AS DOUBLE) * CAST(ped AS DOUBLE) / CAST({tau * n} AS DOUBLE)"
    return f"CAST(dist AS DOUBLE) * CAST({alpha} AS DOUBLE) / CAST({d_max} AS DOUBLE) + {text}"


def _topk(text: str = TEXT, q: int = Q, k: int = 10, tau: int = 1, alpha: float = 0.5, d_max: float = 100, model: str = MODEL, keywords: str = "vertex_keywords", labels: str = "hop_labels") -> str:
    srd = f"CAST(dist AS DOUBLE) * CAST({alpha} AS DOUBLE) / CAST({d_max} AS DOUBLE)"
    return f"""WITH {model}, {_vertex_ped(text, tau, keywords=keywords)}, {_dist(q, labels)}
SELECT vertex, dist, ped, round(score, 6) AS score FROM (SELECT vertex, dist, ped, {_score(tau, alpha, d_max)} AS score, {srd} AS srd FROM vertex_ped JOIN near USING (vertex))
ORDER BY score, srd, vertex LIMIT {k}"""


def _ranked(source: str, keys: str, k: int, score: str, srd: str) -> str:
    return f"""SELECT {keys}, rank, vertex, dist, ped, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score, srd, vertex) AS rank FROM (SELECT *, {score} AS score, {srd} AS srd FROM {source})) WHERE rank <= {k}"""


# --- model -----------------------------------------------------------------------------------


@_query("vertex_keywords", f"WITH {MODEL} SELECT vertex, word FROM vertex_keywords")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_model(spark, sf_dir).keywords


@_query("key_vertex_lists", f"WITH {MODEL} SELECT word, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(vertex AS VARCHAR), ' ' ORDER BY vertex) AS vertices FROM vertex_keywords GROUP BY 1")
def _(spark, sf_dir):
    lists = star_model(spark, sf_dir).keywords.groupBy("word").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("vertex")).alias("v"))
    return lists.select("word", "n", F.array_join(F.col("v").cast("array<string>"), " ").alias("vertices"))


@_query("labels", f"WITH {MODEL} SELECT vertex, hub, dist FROM hop_labels")
def _(spark, sf_dir):
    return star_model(spark, sf_dir).labels


_POSTINGS = "hub_postings AS (SELECT hub, vertex, dist, CAST(row_number() OVER (PARTITION BY hub ORDER BY dist, vertex) - 1 AS BIGINT) AS pos FROM hop_labels WHERE vertex IN (SELECT vertex FROM vertex_keywords))"


@_query("hub_postings", f"WITH {MODEL}, {_POSTINGS} SELECT * FROM hub_postings")
def _(spark, sf_dir):
    m = star_model(spark, sf_dir)
    return index.hub_postings(m.labels, m.keywords).withColumn("pos", F.col("pos").cast("long"))


# --- text ------------------------------------------------------------------------------------


@_query("word_ped", f"WITH {MODEL}, {_vertex_ped(TEXT, 1)} SELECT word, CAST(ped AS BIGINT) AS ped FROM vertex_ped_w WHERE ped IS NOT NULL")
def _(spark, sf_dir):
    return search.word_ped(star_model(spark, sf_dir).keywords, TEXT, 1).withColumn("ped", F.col("ped").cast("long"))


@_query("vertex_ped", f"WITH {MODEL}, {_vertex_ped(TEXT, 1)} SELECT vertex, ped FROM vertex_ped")
def _(spark, sf_dir):
    return search.vertex_ped(star_model(spark, sf_dir).keywords, TEXT, 1).withColumn("ped", F.col("ped").cast("long"))


@_query("exact_prefix", f"WITH {MODEL} SELECT DISTINCT vertex FROM vertex_keywords WHERE starts_with(word, 'wi')")
def _(spark, sf_dir):
    return star_model(spark, sf_dir).keywords.where(F.startswith("word", F.lit("wi"))).select("vertex").distinct()


_NODES = "nodes AS (SELECT node, CAST(length(node) AS BIGINT) AS depth, CAST(count(*) AS BIGINT) AS words FROM (SELECT unnest(list_transform(range(0, CAST(length(word) AS BIGINT) + 1), lambda i: substr(word, 1, CAST(i AS INTEGER)))) AS node FROM (SELECT DISTINCT word FROM vertex_keywords)) GROUP BY 1)"


@_query("active_prefixes", f"WITH {MODEL}, {_NODES} SELECT node, CAST(levenshtein('{TEXT}', node) AS BIGINT) AS ed FROM nodes WHERE levenshtein('{TEXT}', node) <= 1")
def _(spark, sf_dir):
    nodes = index.trie_nodes(star_model(spark, sf_dir).keywords)
    return nodes.select("node", F.levenshtein(F.lit(TEXT), F.col("node"), 1).cast("long").alias("ed")).where("ed >= 0")


@_query("min_ped", f"WITH {MODEL}, {_vertex_ped('wodg', 2)} SELECT CAST(min(ped) AS BIGINT) AS min_ped FROM vertex_ped")
def _(spark, sf_dir):
    return search.word_ped(star_model(spark, sf_dir).keywords, "wodg", 2).agg(F.min("ped").cast("long").alias("min_ped"))


@_query("document_words_ped", f"""SELECT word, n, {_ped("'thae'", 'word', 1)} AS ped FROM (
  SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1) WHERE {_ped("'thae'", 'word', 1)} IS NOT NULL""")
def _(spark, sf_dir):
    """A large dictionary: the ASCII words of all documents."""
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word <> ''")
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return counted.withColumn("ped", prefix_edit_distance(F.lit("thae"), F.col("word"), 1).cast("long")).where("ped is not null")


# --- distance --------------------------------------------------------------------------------


@_query("hub_join_distance", f"WITH {MODEL}, {_dist(Q)} SELECT vertex, dist FROM near")
def _(spark, sf_dir):
    return search.hub_distance(star_model(spark, sf_dir).labels, Q).select("vertex", F.col("dist").cast("long").alias("dist"))


@_query("witness_hub", f"WITH {MODEL}, {_dist(Q)} SELECT vertex, dist, hub FROM near")
def _(spark, sf_dir):
    return search.hub_distance(star_model(spark, sf_dir).labels, Q).select("vertex", F.col("dist").cast("long").alias("dist"), F.col("hub").cast("long").alias("hub"))


def _ring(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("a"))
    one = n.select("a", ((F.col("a") + 1) % 25).alias("b"), (F.col("a") * 7 % 5 + 1).alias("w"))
    return one.selectExpr("a as src", "b as dst", "w").unionByName(one.selectExpr("b as src", "a as dst", "w"))


@_query("sssp_nation", """WITH RECURSIVE ring AS (
  SELECT n_nationkey AS a, (n_nationkey + 1) % 25 AS b, n_nationkey * 7 % 5 + 1 AS w FROM nation
), e AS (SELECT a AS src, b AS dst, w FROM ring UNION ALL SELECT b, a, w FROM ring
), walk(vertex, dist) AS (
  SELECT 0, 0 UNION SELECT e.dst, walk.dist + e.w FROM walk JOIN e ON e.src = walk.vertex WHERE walk.dist + e.w <= 60)
SELECT CAST(vertex AS BIGINT) AS vertex, CAST(min(dist) AS BIGINT) AS dist FROM walk GROUP BY 1""")
def _(spark, sf_dir):
    start = spark.range(1).select(F.col("id").cast("int").alias("vertex"))
    return network.distances(_ring(spark, sf_dir), start).select(F.col("vertex").cast("long").alias("vertex"), "dist")


def _by_key(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("vertex"), F.col("n_nationkey").alias("rank"))


@_query("landmark_distance", ORACLE_SQL["sssp_nation"].replace("SELECT 0, 0 UNION", "SELECT 3, 0 UNION"))
def _(spark, sf_dir):
    """Two-hop labels by pruned searches, and distances from nation 3 by joining them."""
    labels = network.landmark_labels(_ring(spark, sf_dir), _by_key(spark, sf_dir))
    return search.hub_distance(labels, 3).select(F.col("vertex").cast("long").alias("vertex"), F.col("dist").cast("long").alias("dist"))


_RING = """ring AS (SELECT n_nationkey AS a, (n_nationkey + 1) % 25 AS b, n_nationkey * 7 % 5 + 1 AS w FROM nation
), e AS (SELECT a AS src, b AS dst, w FROM ring UNION ALL SELECT b, a, w FROM ring
), f AS (SELECT src, dst, CASE WHEN least(src, dst) = 3 AND greatest(src, dst) = 4 THEN w + 7 WHEN least(src, dst) = 11 AND greatest(src, dst) = 12 THEN 1 ELSE w END AS w FROM e)"""


@_query("edge_label_changes", f"""WITH RECURSIVE {_RING}, was(hub, vertex, dist) AS (
  SELECT n_nationkey, n_nationkey, 0 FROM nation UNION SELECT was.hub, e.dst, was.dist + e.w FROM was JOIN e ON e.src = was.vertex WHERE was.dist + e.w <= 60
), becomes(hub, vertex, dist) AS (
  SELECT n_nationkey, n_nationkey, 0 FROM nation UNION SELECT b.hub, f.dst, b.dist + f.w FROM becomes b JOIN f ON f.src = b.vertex WHERE b.dist + f.w <= 60
), o AS (SELECT hub, vertex, min(dist) AS dist FROM was GROUP BY 1, 2), n AS (SELECT hub, vertex, min(dist) AS dist FROM becomes GROUP BY 1, 2)
SELECT CAST(n.vertex AS BIGINT) AS vertex, CAST(n.hub AS BIGINT) AS hub, CAST(n.dist AS BIGINT) AS dist FROM n JOIN o USING (hub, vertex) WHERE n.dist <> o.dist""")
def _(spark, sf_dir):
    """Labels that change when one edge of the ring becomes dearer and another cheaper."""
    edges = _ring(spark, sf_dir)
    ends = edges.where("src < dst and (src = 3 and dst = 4 or src = 11 and dst = 12)")
    changed = ends.selectExpr("src as u", "dst as v", "w as old", "if(src = 3, w + 7, 1) as new")
    found = network.edge_label_changes(network.complete_labels(edges), edges, changed)
    return found.select(*[F.col(c).cast("long").alias(c) for c in ("vertex", "hub", "dist")])


#: Of all distances (hub, vertex, dist), the labels that no more important vertex (a smaller number) on a shortest way makes needless.
_FEWEST = """SELECT CAST(vertex AS BIGINT) AS vertex, CAST(hub AS BIGINT) AS hub, CAST(dist AS BIGINT) AS dist FROM {0} l
WHERE NOT EXISTS (SELECT 1 FROM {0} a JOIN {0} b ON a.hub = b.hub AND b.vertex = l.hub WHERE a.vertex = l.vertex AND a.hub < l.hub AND a.dist + b.dist = l.dist)"""


def _all_ways(edges: str, name: str, most: int) -> str:
    return f"""{name}_walk(hub, vertex, dist) AS (
  SELECT DISTINCT src, src, CAST(0 AS BIGINT) FROM {edges} UNION SELECT b.hub, e.dst, CAST(b.dist + e.w AS BIGINT) FROM {name}_walk b JOIN {edges} e ON e.src = b.vertex WHERE b.dist + e.w <= {most}
), {name} AS (SELECT hub, vertex, min(dist) AS dist FROM {name}_walk GROUP BY 1, 2)"""


@_query("distance_labels", f"WITH RECURSIVE {_RING}, {_all_ways('e', 'd', 60)} {_FEWEST.format('d')}")
def _(spark, sf_dir):
    """The fewest two-hop labels of the ring, grown by distance."""
    return network.distance_labels(_ring(spark, sf_dir), _by_key(spark, sf_dir))


@_query("pruned_label_changes", f"WITH RECURSIVE {_RING}, {_all_ways('f', 'd', 60)} {_FEWEST.format('d')}")
def _(spark, sf_dir):
    """The ring's fewest labels, kept up to date when one edge becomes dearer and another cheaper."""
    edges, order = _ring(spark, sf_dir), _by_key(spark, sf_dir)
    ends = edges.where("src < dst and (src = 3 and dst = 4 or src = 11 and dst = 12)")
    changed = ends.selectExpr("src as u", "dst as v", "w as old", "if(src = 3, w + 7, 1) as new")
    labels = written(network.distance_labels(edges, order), "labels")
    return maintenance.apply_label_changes(labels, network.pruned_label_changes(labels, edges, changed, order))


def _suppliers(spark, sf_dir):
    """Suppliers of neighbouring lines of an order are joined; the least sum of two quantities is the weight."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    follow = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("b"), F.col("l_quantity").alias("q"))
    one = lines.join(follow, ["l_orderkey", "l_linenumber"]).where("l_suppkey <> b")
    both = F.inline(F.array(F.struct(F.col("l_suppkey").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("l_suppkey").alias("dst"))))
    return one.select(both, (F.col("l_quantity") + F.col("q")).cast("long").alias("w")).groupBy("src", "dst").agg(F.min("w").alias("w"))


_SUPPLIERS = """one AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, CAST(a.l_quantity + b.l_quantity AS BIGINT) AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> b.l_suppkey
), e AS (SELECT src, dst, min(w) AS w FROM (SELECT a AS src, b AS dst, w FROM one UNION ALL SELECT b, a, w FROM one) GROUP BY 1, 2
), f AS (SELECT src, dst, CASE WHEN (least(src, dst) + 7 * greatest(src, dst)) % 40 = 1 THEN w + 9 WHEN (least(src, dst) + 7 * greatest(src, dst)) % 40 = 2 THEN 1 ELSE w END AS w FROM e WHERE (least(src, dst) + 7 * greatest(src, dst)) % 40 <> 3)"""


@_query("supplier_labels", f"WITH RECURSIVE {_SUPPLIERS}, {_all_ways('e', 'd', 60)} {_FEWEST.format('d')}")
def _(spark, sf_dir):
    """The fewest labels of the network of suppliers."""
    edges = written(_suppliers(spark, sf_dir), "suppliers")
    return network.distance_labels(edges, edges.selectExpr("src as vertex", "src as rank").distinct())


@_query("supplier_label_changes", f"WITH RECURSIVE {_SUPPLIERS}, {_all_ways('f', 'd', 60)} {_FEWEST.format('d')}")
def _(spark, sf_dir):
    """The suppliers' labels after many edges became dearer, cheaper or went, without building them anew."""
    edges = written(_suppliers(spark, sf_dir), "suppliers")
    order = edges.selectExpr("src as vertex", "src as rank").distinct()
    labels = written(network.distance_labels(edges, order), "labels")
    kind = F.expr("(src + 7 * dst) % 40")
    changed = edges.where("src < dst").where(kind.isin(1, 2, 3)).select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("w").alias("old"), F.when(kind == 1, F.col("w") + 9).when(kind == 2, F.lit(1)).alias("new"))
    return maintenance.apply_label_changes(labels, network.pruned_label_changes(labels, edges, changed, order))


# --- top-k -----------------------------------------------------------------------------------


def _one(name: str, **options) -> None:
    args = {"text": TEXT, "q": Q, "k": 10, "tau": 1, "alpha": 0.5, "d_max": 100} | options

    @_query(name, _topk(**args))
    def run(spark, sf_dir):
        m = star_model(spark, sf_dir)
        return _rounded(search.topk(m.keywords, m.labels, args["q"], args["text"], args["k"], args["tau"], args["alpha"], args["d_max"]))


_one("topk_instant")
_one("topk_tau0", tau=0)
_one("topk_tau2", text="wodgt", tau=2)
_one("topk_alpha0", alpha=0.0)
_one("topk_alpha1", alpha=1.0)
_one("topk_no_match", text="zzzz", tau=0)

_TYPED = ("wid", "smal", "bran", "bolt")


@_query("topk_batch", f"""WITH {MODEL}, asked AS (SELECT p_partkey AS qid, p_partkey AS q, CASE p_partkey // 50 % 4 {' '.join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPED))} END AS text FROM part WHERE p_partkey % 50 = 0
), peds AS (SELECT text, word, {_ped('text', 'word', 1)} AS ped FROM (SELECT DISTINCT word FROM vertex_keywords), (SELECT DISTINCT text FROM asked)
), m AS (SELECT text, vertex, CAST(min(ped) AS BIGINT) AS ped FROM peds JOIN vertex_keywords USING (word) WHERE ped IS NOT NULL GROUP BY 1, 2
), d AS (SELECT qid, text, b.vertex, CAST(min(a.dist + b.dist) AS BIGINT) AS dist FROM asked JOIN hop_labels a ON a.vertex = q JOIN hop_labels b ON a.hub = b.hub GROUP BY 1, 2, 3
), f AS (SELECT qid, vertex, dist, ped FROM d JOIN m USING (text, vertex))
{_ranked('f', 'qid', 5, _score(1, 0.5, 100), 'CAST(dist AS DOUBLE) * CAST(0.5 AS DOUBLE) / CAST(100 AS DOUBLE)')}""")
def _(spark, sf_dir):
    m = star_model(spark, sf_dir)
    typed = F.array(*map(F.lit, _TYPED))[F.expr("cast(p_partkey div 50 % 4 as int)")]
    asked = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("qid"), F.col("p_partkey").alias("q"), typed.alias("text"))
    return _rounded(search.topk_batch(m.keywords, m.labels, asked))


def _steps_sql(text: str) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{text[:i]}')" for i in range(1, len(text) + 1)) + ") t(step, text)"


_SRD = "CAST(dist AS DOUBLE) * CAST(0.5 AS DOUBLE) / CAST(100 AS DOUBLE)"
_KEYSTROKES = f"""WITH {MODEL}, {_dist(Q)}, peds AS (SELECT CAST(step AS BIGINT) AS step, word, {_ped('text', 'word', 1)} AS ped FROM (SELECT DISTINCT word FROM vertex_keywords), {_steps_sql('widgt')}
), m AS (SELECT step, vertex, CAST(min(ped) AS BIGINT) AS ped FROM peds JOIN vertex_keywords USING (word) WHERE ped IS NOT NULL GROUP BY 1, 2
), f AS (SELECT step, vertex, dist, ped FROM m JOIN near USING (vertex))
{_ranked('f', 'step', 5, _score(1, 0.5, 100), _SRD)}"""


@_query("keystroke_topk", _KEYSTROKES)
def _(spark, sf_dir):
    m = star_model(spark, sf_dir)
    return _rounded(search.keystroke_topk(m.keywords, m.labels, Q, "widgt"))


@_query("keystroke_incremental", _KEYSTROKES)
def _(spark, sf_dir):
    m = star_model(spark, sf_dir)
    return _rounded(search.keystroke_topk(m.keywords, m.labels, Q, "widgt", incremental=True))


# --- several keywords ------------------------------------------------------------------------


def _multi(name: str, texts: tuple[str, ...], tau: int) -> None:
    peds = ", ".join(_vertex_ped(t, tau, f"p{i}") for i, t in enumerate(texts))
    joined = "p0 " + " ".join(f"JOIN p{i} USING (vertex)" for i in range(1, len(texts)))
    total = " + ".join(f"p{i}.ped" for i in range(len(texts)))
    sql = f"""WITH {MODEL}, {_dist(Q)}, {peds}, f AS (SELECT vertex, dist, CAST({total} AS BIGINT) AS ped FROM {joined} JOIN near USING (vertex))
SELECT vertex, dist, ped, round(score, 6) AS score FROM (SELECT *, {_score(tau, 0.5, 100, len(texts))} AS score FROM f) ORDER BY score, dist, vertex LIMIT 5"""

    @_query(name, sql)
    def run(spark, sf_dir):
        m = star_model(spark, sf_dir)
        return _rounded(search.multikey_topk(m.keywords, m.labels, Q, list(texts), tau=tau))


_multi("multikey_topk", ("smal", "brand"), 1)
_multi("multikey_tau0", ("small", "bra"), 0)
_multi("multikey_three", ("smal", "brand", "wigd"), 2)


@_query("multikey_keystroke", f"""WITH {MODEL}, {_dist(Q)}, {_vertex_ped('smal', 1, 'p0')}, peds AS (
  SELECT CAST(step AS BIGINT) AS step, word, {_ped('text', 'word', 1)} AS ped FROM (SELECT DISTINCT word FROM vertex_keywords), {_steps_sql('widg')}
), m AS (SELECT step, vertex, CAST(min(ped) AS BIGINT) AS last FROM peds JOIN vertex_keywords USING (word) WHERE ped IS NOT NULL GROUP BY 1, 2
), f AS (SELECT step, vertex, dist, CAST(ped + last AS BIGINT) AS ped FROM m JOIN p0 USING (vertex) JOIN near USING (vertex))
{_ranked('f', 'step', 5, _score(1, 0.5, 100, 2), 'CAST(dist AS DOUBLE) / CAST(100 AS DOUBLE)')}""")
def _(spark, sf_dir):
    m = star_model(spark, sf_dir)
    return _rounded(search.multikey_keystroke(m.keywords, m.labels, Q, ["smal", "widg"]))


# --- index -----------------------------------------------------------------------------------

_INTERVALS = f"""{_NODES}, ids AS (SELECT node, CAST(row_number() OVER (ORDER BY encode(node)) AS BIGINT) AS id FROM nodes
), intervals AS (SELECT a.node, a.id, CAST(a.id + count(b.node) - 1 AS BIGINT) AS last FROM ids a JOIN ids b ON starts_with(b.node, a.node) GROUP BY 1, 2)"""


@_query("trie_nodes", f"WITH {MODEL}, {_NODES} SELECT node, depth, words FROM nodes")
def _(spark, sf_dir):
    return index.trie_nodes(star_model(spark, sf_dir).keywords).withColumn("depth", F.col("depth").cast("long"))


@_query("trie_intervals", f"WITH {MODEL}, {_INTERVALS} SELECT node, id, last FROM intervals")
def _(spark, sf_dir):
    return index.trie_intervals(star_model(spark, sf_dir).keywords)


@_query("trie_level_index", f"WITH {MODEL}, {_INTERVALS} SELECT right(node, 1) AS letter, CAST(length(node) AS BIGINT) AS depth, CAST(count(*) AS BIGINT) AS nodes, min(id) AS first_id, max(id) AS last_id FROM ids WHERE node <> '' GROUP BY 1, 2")
def _(spark, sf_dir):
    return index.trie_level_index(star_model(spark, sf_dir).keywords).withColumn("depth", F.col("depth").cast("long"))


_HUB_NODE = f"""{_POSTINGS}, under AS (SELECT DISTINCT vertex, unnest(list_transform(range(1, CAST(length(word) AS BIGINT) + 1), lambda i: substr(word, 1, CAST(i AS INTEGER)))) AS node FROM vertex_keywords
), hub_node AS (SELECT hub, node, pos FROM hub_postings JOIN under USING (vertex))"""


@_query("hub_node_positions", f"WITH {MODEL}, {_HUB_NODE} SELECT hub, node, CAST(length(node) AS BIGINT) AS depth, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions FROM hub_node GROUP BY 1, 2")
def _(spark, sf_dir):
    m = star_model(spark, sf_dir)
    rows = index.hub_node_positions(m.labels, m.keywords)
    return rows.select("hub", "node", F.col("depth").cast("long").alias("depth"), F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


@_query("hub_node_popcount", f"WITH {MODEL}, {_HUB_NODE} SELECT hub, node, CAST(count(*) AS BIGINT) AS ones, min(pos) AS first_pos, max(pos) AS last_pos FROM hub_node GROUP BY 1, 2")
def _(spark, sf_dir):
    m = star_model(spark, sf_dir)
    rows = index.hub_node_popcount(m.labels, m.keywords)
    return rows.select("hub", "node", "ones", F.col("first_pos").cast("long").alias("first_pos"), F.col("last_pos").cast("long").alias("last_pos"))


@_query("hub_node_chunks", f"WITH {MODEL}, {_HUB_NODE} SELECT hub, node, CAST(pos // 32 AS INTEGER) AS chunk, CAST(bit_or(CAST(1 AS BIGINT) << CAST(pos % 32 AS BIGINT)) AS BIGINT) AS bits FROM hub_node GROUP BY 1, 2, 3")
def _(spark, sf_dir):
    """Position sets by chunks of 32, so that no row grows with a hub."""
    m = star_model(spark, sf_dir)
    return index.hub_node_chunks(m.labels, m.keywords)


@_query("rank_in_parent", f"""WITH {MODEL}, {_HUB_NODE}, parents AS (
  SELECT hub, node AS parent, pos, CAST(row_number() OVER (PARTITION BY hub, node ORDER BY pos) - 1 AS BIGINT) AS rank FROM hub_node UNION ALL SELECT hub, '', pos, pos FROM hub_postings)
SELECT h.hub, h.node, CAST(count(*) AS BIGINT) AS ones, min(p.rank) AS first_rank, max(p.rank) AS last_rank, CAST(sum(p.rank) AS BIGINT) AS ranks, CAST(sum((h.pos + 1) * (p.rank + 1)) AS BIGINT) AS digest
FROM hub_node h JOIN parents p ON p.hub = h.hub AND p.pos = h.pos AND p.parent = substr(h.node, 1, length(h.node) - 1) GROUP BY 1, 2""")
def _(spark, sf_dir):
    """Every rank goes into its node's sums and digest: a row per (hub, node), not per position."""
    m = star_model(spark, sf_dir)
    return index.rank_sums_in_parent(m.labels, m.keywords)


_PROBES = "SELECT i.id AS low, i.last AS high, l.letter, CAST(length(i.node) + 1 AS BIGINT) AS depth, i.node AS under FROM intervals i, (VALUES ('i'), ('e'), ('a')) l(letter)"


@_query("level_index_probe", f"WITH {MODEL}, {_INTERVALS}, probes AS ({_PROBES}) SELECT p.under, p.letter, n.node, n.id FROM probes p JOIN ids n ON n.node <> '' AND right(n.node, 1) = p.letter AND length(n.node) = p.depth AND n.id BETWEEN p.low AND p.high")
def _(spark, sf_dir):
    """From every trie node, its children by some letters."""
    keywords = star_model(spark, sf_dir).keywords
    letters = F.explode(F.array(*map(F.lit, "iea"))).alias("letter")
    probes = index.trie_intervals(keywords).select(F.col("node").alias("under"), F.col("id").alias("low"), F.col("last").alias("high"), (F.length("node") + 1).alias("depth"), letters)
    return index.level_index_probe(keywords, probes).select("under", "letter", "node", "id")


_DOC_WORDS = "vertex_keywords AS (SELECT DISTINCT 0 AS vertex, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents), dictionary AS (SELECT DISTINCT word FROM vertex_keywords WHERE word <> '')"


@_query("document_level_probe", f"""WITH {_DOC_WORDS}, n AS (
  SELECT DISTINCT unnest(list_transform(range(0, CAST(length(word) AS BIGINT) + 1), lambda i: substr(word, 1, CAST(i AS INTEGER)))) AS node FROM dictionary
), ids AS (SELECT node, CAST(row_number() OVER (ORDER BY encode(node)) AS BIGINT) AS id FROM n)
SELECT substr(node, 1, length(node) - 2) AS under, right(node, 1) AS letter, node, id FROM ids WHERE length(node) >= 2 AND right(node, 1) IN ('i', 'e', 'a')""")
def _(spark, sf_dir):
    """From every trie node of the documents' words, the nodes two letters below that end in some letters, by intervals."""
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word <> ''").distinct()
    intervals = written(index.trie_intervals(words), "intervals")
    letters = F.explode(F.array(*map(F.lit, "iea"))).alias("letter")
    # what is two letters below a node comes two numbers later at the least
    probes = intervals.where("last >= id + 2").select(F.col("node").alias("under"), F.col("id").alias("low"), F.col("last").alias("high"), (F.length("node") + 2).alias("depth"), letters)
    return index.nodes_in(intervals, probes).select("under", "letter", "node", "id")


_ACTIVE_MAP = "SELECT o.node AS old, CAST(levenshtein('wi', o.node) AS BIGINT) AS old_ed, n.node, CAST(levenshtein('wid', n.node) AS BIGINT) AS ed FROM nodes o JOIN nodes n ON starts_with(n.node, o.node) WHERE levenshtein('wi', o.node) <= 1 AND levenshtein('wid', n.node) <= 1"


@_query("active_node_map", f"WITH {MODEL}, {_NODES} {_ACTIVE_MAP}")
def _(spark, sf_dir):
    found = search.active_node_map(index.trie_nodes(star_model(spark, sf_dir).keywords), "wi", "wid", 1)
    return found.withColumns({c: F.col(c).cast("long") for c in ("old_ed", "ed")})


@_query("covering_nodes", f"""WITH {MODEL}, {_INTERVALS}, {_HUB_NODE}, own AS (
  SELECT *, lead(id) OVER (PARTITION BY hub ORDER BY id) AS following FROM (SELECT DISTINCT hub, node FROM hub_node) JOIN intervals USING (node))
SELECT hub, node FROM own WHERE following IS NULL OR following > last""")
def _(spark, sf_dir):
    m = star_model(spark, sf_dir)
    return index.covering_nodes(m.labels, m.keywords)


@_query("index_size", f"""WITH {MODEL}, {_HUB_NODE}, p AS (SELECT hub, count(*) AS n FROM hub_postings GROUP BY 1
), o AS (SELECT hub, node, count(*) AS ones FROM hub_node GROUP BY 1, 2
), b AS (SELECT hub, node AS parent, ones AS bits FROM o UNION ALL SELECT hub, '', n FROM p
), j AS (SELECT o.hub, o.ones, b.bits, p.n FROM o JOIN b ON b.hub = o.hub AND b.parent = substr(o.node, 1, length(o.node) - 1) JOIN p ON p.hub = o.hub)
SELECT hub, CAST(n * 8 + count(*) * 4 + sum((n + 31) // 32 * 4) AS BIGINT) AS raw_bytes, CAST(n * 8 + count(*) * 4 + sum(CASE WHEN ones < bits THEN (bits + 31) // 32 * 4 ELSE 0 END) AS BIGINT) AS packed_bytes FROM j GROUP BY hub, n""")
def _(spark, sf_dir):
    m = star_model(spark, sf_dir)
    return index.index_size(m.labels, m.keywords)


# --- maintenance -----------------------------------------------------------------------------


def _changed(name: str, change, keywords_sql: str = "", labels_sql: str = "", text: str = TEXT) -> None:
    """``change(model)`` gives new (keywords, labels); the query ranks over them."""
    model = MODEL + (f", new_keywords AS ({keywords_sql})" if keywords_sql else "") + (f", new_labels AS ({labels_sql})" if labels_sql else "")
    sql = _topk(text, model=model, keywords="new_keywords" if keywords_sql else "vertex_keywords", labels="new_labels" if labels_sql else "hop_labels")

    @_query(name, sql)
    def run(spark, sf_dir):
        keywords, labels = change(star_model(spark, sf_dir))
        return _rounded(search.topk(keywords, labels, Q, text))


def _words(m, word: str) -> DataFrame:
    return m.keywords.select("vertex").distinct().where("vertex % 9 = 4").withColumn("word", F.lit(word))


_ADD = "SELECT vertex, word FROM vertex_keywords UNION SELECT vertex, '{}' FROM vertex_keywords WHERE vertex % 9 = 4"
_changed("insert_key", lambda m: (maintenance.insert_keys(m.keywords, _words(m, "widget")), m.labels), _ADD.format("widget"))
_changed("insert_new_key", lambda m: (maintenance.insert_keys(m.keywords, _words(m, "Quokka")), m.labels), _ADD.format("quokka"), text="quk")
_changed(
    "delete_key", lambda m: (maintenance.delete_keys(m.keywords, m.keywords.where("vertex % 2 = 1 and word like 'wi%'")), m.labels),
    "SELECT vertex, word FROM vertex_keywords WHERE NOT (vertex % 2 = 1 AND word LIKE 'wi%')",
)
_changed(
    "insert_label", lambda m: (m.keywords, maintenance.insert_labels(m.labels, m.labels.where("vertex % 11 = 3").selectExpr("vertex", "cast(0 as long) as hub", "3 as dist").distinct())),
    labels_sql="SELECT vertex, hub, min(dist) AS dist FROM (SELECT * FROM hop_labels UNION ALL SELECT DISTINCT vertex, 0, 3 FROM hop_labels WHERE vertex % 11 = 3) GROUP BY 1, 2",
)
_changed("delete_label", lambda m: (m.keywords, maintenance.delete_labels(m.labels, m.labels.where("dist < 4"))), labels_sql="SELECT * FROM hop_labels WHERE dist >= 4")
_changed(
    "label_change_upsert", lambda m: (m.keywords, maintenance.upsert_labels(m.labels, m.labels.where("(vertex + hub) % 3 = 0").selectExpr("vertex", "hub", "dist + 5 as dist"))),
    labels_sql="SELECT vertex, hub, CASE WHEN (vertex + hub) % 3 = 0 THEN dist + 5 ELSE dist END AS dist FROM hop_labels",
)


def _reweighted(increase: bool):
    return lambda m: (m.keywords, maintenance.upsert_labels(m.labels, maintenance.reweighted(m.labels.where("hub % 3 = 1"), 0.3, increase)))


_WEIGHT = "SELECT vertex, hub, CASE WHEN hub % 3 = 1 THEN CAST(trunc(CAST(dist AS DOUBLE) {} CAST(dist AS DOUBLE) * CAST(0.3 AS DOUBLE)) AS INTEGER) ELSE dist END AS dist FROM hop_labels"
_changed("edge_decrease", _reweighted(False), labels_sql=_WEIGHT.format("-"))
_changed("edge_increase", _reweighted(True), labels_sql=_WEIGHT.format("+"))


# --- stored index ----------------------------------------------------------------------------


def _stored(name: str, **options) -> None:
    args = {"text": TEXT, "q": Q, "k": 10, "tau": 1, "alpha": 0.5, "d_max": 100} | options

    @_query(name, _topk(**args))
    def run(spark, sf_dir):
        """A ranking in rounds of growing distance over an index written before."""
        m = star_model(spark, sf_dir)
        kept = stored.build(m.keywords, m.labels, tau=args["tau"])
        return _rounded(stored.topk(kept, args["q"], args["text"], args["k"], args["tau"], args["alpha"], args["d_max"]))


_stored("topk_stored")
_stored("topk_stored_tau2", text="wodgt", tau=2)


@_query("keystroke_stored", _KEYSTROKES)
def _(spark, sf_dir):
    """The ranking after every keystroke over a stored index: each step goes on from what the one before has read."""
    m = star_model(spark, sf_dir)
    return _rounded(stored.keystroke_topk(stored.build(m.keywords, m.labels, tau=1), Q, "widgt"))


@_query("multikey_stored", ORACLE_SQL["multikey_topk"])
def _(spark, sf_dir):
    m = star_model(spark, sf_dir)
    return _rounded(stored.multikey_topk(stored.build(m.keywords, m.labels, tau=1), Q, ["smal", "brand"], tau=1))


@_query("stored_changes", f"""WITH {MODEL}, k AS (
  SELECT vertex, word FROM vertex_keywords WHERE vertex % 40 <> 3 UNION SELECT DISTINCT vertex, 'quokka' FROM vertex_keywords WHERE vertex % 50 = 4
), l AS (
  SELECT vertex, hub, min(dist) AS dist FROM (
    SELECT vertex, hub, CASE WHEN vertex % 30 = 7 AND hub % 2 = 0 THEN dist + 5 ELSE dist END AS dist FROM hop_labels WHERE NOT (vertex % 30 = 8 AND dist < 9)
    UNION ALL SELECT DISTINCT vertex, 0, 3 FROM hop_labels WHERE vertex % 60 = 11) GROUP BY 1, 2)
SELECT hub, vertex, dist, CAST(row_number() OVER (PARTITION BY hub ORDER BY dist, vertex) - 1 AS BIGINT) AS pos FROM l WHERE vertex IN (SELECT vertex FROM k)""")
def _(spark, sf_dir):
    """The postings of an index after keys and labels were inserted, deleted and changed in place."""
    m = star_model(spark, sf_dir)
    kept = stored.build(m.keywords, m.labels, tau=1)
    vertices = m.labels.select("vertex").distinct()
    kept.delete_keys(m.keywords.where("vertex % 40 = 3"))
    kept.insert_keys(m.keywords.where("vertex % 50 = 4").select("vertex", F.lit("Quokka").alias("word")).distinct())
    kept.delete_labels(m.labels.where("vertex % 30 = 8 and dist < 9"))
    kept.upsert_labels(m.labels.where("vertex % 30 = 7 and hub % 2 = 0").withColumn("dist", F.col("dist") + 5))
    kept.insert_labels(vertices.where("vertex % 60 = 11").selectExpr("vertex", "0 as hub", "3 as dist"))
    return kept.table("postings").select("hub", "vertex", "dist", F.col("pos").cast("long").alias("pos"))


@_query("stored_dictionary", f"""SELECT text, word, ped FROM (
  SELECT text, word, {_ped('text', 'word', 1)} AS ped FROM (
    SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents), (VALUES ('thae'), ('langu'), ('qx')) t(text) WHERE word <> '') WHERE ped IS NOT NULL""")
def _(spark, sf_dir):
    """Texts against the stored deletions of the documents' words; the dictionary is not scanned."""
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word <> ''")
    kept = stored.build_dictionary(words.distinct())
    asked = spark.createDataFrame([("thae",), ("langu",), ("qx",)], "text string")
    return stored.match_texts(kept, asked, 1).withColumn("ped", F.col("ped").cast("long"))


# --- sets and order --------------------------------------------------------------------------


def _active(spark, sf_dir, text: str) -> DataFrame:
    return search.vertex_ped(star_model(spark, sf_dir).keywords, text, 1).select("vertex")


_TWO = f"WITH {MODEL}, {_vertex_ped('wid', 1, 'a')}, {_vertex_ped('smal', 1, 'b')} SELECT vertex FROM a "


@_query("active_union", _TWO + "UNION SELECT vertex FROM b")
def _(spark, sf_dir):
    return _active(spark, sf_dir, "wid").union(_active(spark, sf_dir, "smal")).distinct()


@_query("active_intersect", _TWO + "INTERSECT SELECT vertex FROM b")
def _(spark, sf_dir):
    return _active(spark, sf_dir, "wid").intersect(_active(spark, sf_dir, "smal"))


@_query("active_except", _TWO + "EXCEPT SELECT vertex FROM b")
def _(spark, sf_dir):
    return _active(spark, sf_dir, "wid").exceptAll(_active(spark, sf_dir, "smal"))


@_query("row_union_distinct", f"WITH {MODEL} SELECT hub FROM hop_labels WHERE vertex = 7 UNION SELECT hub FROM hop_labels WHERE vertex = 8")
def _(spark, sf_dir):
    labels = star_model(spark, sf_dir).labels
    return labels.where("vertex = 7").select("hub").union(labels.where("vertex = 8").select("hub")).distinct()


@_query("edge_sort_dedup", f"WITH {MODEL} SELECT vertex AS src, -hub - 1 AS dst, dist AS w FROM hop_labels UNION ALL SELECT -hub - 1, vertex, dist FROM hop_labels ORDER BY 1, 2")
def _(spark, sf_dir):
    edges = star_model(spark, sf_dir).edges
    return network.sort_edges(edges.unionByName(edges.withColumn("w", F.col("w") + 1)))


@_query("bit_functions", f"""WITH {MODEL}, {_POSTINGS}, s AS (SELECT hub, list_sort(list(CAST(pos AS INTEGER)) FILTER (dist % 2 = 0)) AS a, list_sort(list(CAST(pos AS INTEGER)) FILTER (dist % 3 = 0)) AS b, CAST(count(*) AS INTEGER) AS n FROM hub_postings GROUP BY 1
), t AS (SELECT hub, coalesce(a, []) AS a, coalesce(b, []) AS b, n FROM s)
SELECT hub, CAST(len(a) AS BIGINT) AS ones, CAST(len(list_filter(a, lambda x: x < 10)) AS BIGINT) AS rank10, CAST(coalesce(list_min(list_filter(a, lambda x: x >= 10)), -1) AS BIGINT) AS next10,
  CAST(len(list_intersect(a, b)) AS BIGINT) AS both_ones, CAST(len(list_distinct(list_concat(a, b))) AS BIGINT) AS any_ones, len(a) < n AS has_zero,
  array_to_string(list_transform(list_filter(a, lambda x: x <> 5), lambda x: CASE WHEN x > 5 THEN x - 1 ELSE x END), ' ') AS without5 FROM t""")
def _(spark, sf_dir):
    m = star_model(spark, sf_dir)
    rows = index.hub_postings(m.labels, m.keywords).groupBy("hub").agg(
        F.sort_array(F.collect_list(F.when(F.col("dist") % 2 == 0, F.col("pos")))).alias("a"), F.sort_array(F.collect_list(F.when(F.col("dist") % 3 == 0, F.col("pos")))).alias("b"), F.count("*").alias("n")
    )
    a, b = F.col("a"), F.col("b")
    return rows.select(
        "hub", bits.count_one(a).cast("long").alias("ones"), bits.rank(a, F.lit(10)).cast("long").alias("rank10"), bits.next_one(a, F.lit(10)).cast("long").alias("next10"),
        F.size(bits.intersection(a, b)).cast("long").alias("both_ones"), F.size(bits.union(a, b)).cast("long").alias("any_ones"), bits.has_zero(a, F.col("n")).alias("has_zero"),
        F.array_join(bits.delete_bit(a, F.lit(5)).cast("array<string>"), " ").alias("without5"),
    )


@_query("bit_updates", f"""WITH {MODEL}, {_POSTINGS}, s AS (SELECT hub, coalesce(list_sort(list(CAST(pos AS INTEGER)) FILTER (dist % 4 = 0)), []) AS a, coalesce(list_sort(list(CAST(pos AS INTEGER)) FILTER (dist % 2 = 0)), []) AS p, CAST(count(*) AS INTEGER) AS n FROM hub_postings GROUP BY 1)
SELECT hub, array_to_string(list_sort(list_distinct(list_append(a, 7))), ' ') AS set7, array_to_string(list_filter(a, lambda x: x <> 8), ' ') AS cleared8, len(list_filter(a, lambda x: x = 9)) > 0 AS at9, len(a) = 0 AS all_zero,
  coalesce(a[3], -1) AS third, array_to_string(list_sort(list_append(list_transform(a, lambda x: CASE WHEN x >= 6 THEN x + 1 ELSE x END), 6)), ' ') AS one_in, array_to_string(list_transform(a, lambda x: CASE WHEN x >= 6 THEN x + 1 ELSE x END), ' ') AS zero_in,
  array_to_string(list_transform(a, lambda x: len(list_filter(p, lambda y: y < x))), ' ') AS packed, array_to_string(a, ' ') AS unpacked, array_to_string(list_transform(range(n), lambda i: CASE WHEN list_contains(a, i) THEN '1' ELSE '0' END), '') AS shown, CAST(n AS BIGINT) AS every FROM s""")
def _(spark, sf_dir):
    m = star_model(spark, sf_dir)
    rows = index.hub_postings(m.labels, m.keywords).groupBy("hub").agg(
        F.sort_array(F.collect_list(F.when(F.col("dist") % 4 == 0, F.col("pos")))).alias("a"), F.sort_array(F.collect_list(F.when(F.col("dist") % 2 == 0, F.col("pos")))).alias("p"), F.count("*").cast("int").alias("n")
    )
    a, p, n, at = F.col("a"), F.col("p"), F.col("n"), F.lit(6)
    text = lambda x: F.array_join(x.cast("array<string>"), " ")
    return rows.select(
        "hub", text(bits.set_one(a, F.lit(7))).alias("set7"), text(bits.set_zero(a, F.lit(8))).alias("cleared8"), bits.value_at(a, F.lit(9)).alias("at9"), bits.all_zero(a).alias("all_zero"), bits.find_one(a, F.lit(3)).alias("third"),
        text(bits.insert_bit(a, at, True)).alias("one_in"), text(bits.insert_bit(a, at, False)).alias("zero_in"), text(bits.compress(a, p)).alias("packed"), text(bits.uncompress(bits.compress(a, p), p)).alias("unpacked"),
        bits.show(a, n).alias("shown"), F.size(bits.set_all(n)).cast("long").alias("every"),
    )


# --- files -----------------------------------------------------------------------------------


@_query("edge_file", f"WITH {MODEL} SELECT CAST(vertex AS INTEGER) AS src, CAST(-hub - 1 AS INTEGER) AS dst, dist AS w FROM hop_labels UNION ALL SELECT CAST(-hub - 1 AS INTEGER), CAST(vertex AS INTEGER), dist FROM hop_labels")
def _(spark, sf_dir):
    """The network written as text and read back as a graph file."""
    path = shared_path(spark, "edges")
    files.write_edges_text(star_model(spark, sf_dir).edges, path)
    return files.read_graph(spark, path)


@_query("token_file", "SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> '' GROUP BY 1")
def _(spark, sf_dir):
    path = shared_path(spark, "names")
    spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").write.text(path)
    return files.read_tokens(spark, path).groupBy("word").agg(F.count("*").alias("n"))


@_query("dictionary_file", f"WITH {MODEL} SELECT CAST(row_number() OVER (ORDER BY encode(word)) - 1 AS INTEGER) AS key_id, word FROM (SELECT DISTINCT word FROM vertex_keywords)")
def _(spark, sf_dir):
    """A dictionary of one file, whose line numbers are the ids."""
    path = shared_path(spark, "words")
    star_model(spark, sf_dir).keywords.select("word").distinct().orderBy("word").coalesce(1).write.text(path)
    return files.read_dictionary(spark, path)


@_query("index_file", f"WITH {MODEL}, {_POSTINGS} SELECT hub, vertex, dist, CAST(pos AS INTEGER) AS pos FROM hub_postings")
def _(spark, sf_dir):
    m, path = star_model(spark, sf_dir), shared_path(spark, "postings")
    files.write_index(index.hub_postings(m.labels, m.keywords), path)
    return files.read_index(spark, path).select("hub", "vertex", "dist", "pos")


_FAR = 1_000_000


def _far_labels(spark, sf_dir) -> DataFrame:
    """Hubs get ids above all vertices, so no label is one of a vertex to itself."""
    return star_model(spark, sf_dir).labels.withColumn("hub", F.col("hub") + _FAR)


_FAR_LABELS = f"SELECT CAST(vertex AS INTEGER) AS vertex, CAST(hub + {_FAR} AS INTEGER) AS hub, dist FROM hop_labels"


@_query("label_out_file", f"WITH {MODEL} {_FAR_LABELS}")
def _(spark, sf_dir):
    """Labels written as one binary file and read back in ranges."""
    path = f"{shared_path(spark, 'out')}/labels.out"
    label_files.write_out(_far_labels(spark, sf_dir), path)
    return label_files.read(spark, path, label_files.OUT, 1 << 16)


@_query("label_forward_file", f"WITH {MODEL} {_FAR_LABELS} UNION ALL SELECT DISTINCT CAST(vertex AS INTEGER), CAST(vertex AS INTEGER), 0 FROM hop_labels")
def _(spark, sf_dir):
    """Labels written as pairs by many tasks, each vertex opened by a pair of its own, and read back in ranges."""
    path = shared_path(spark, "forward")
    label_files.write_forward(_far_labels(spark, sf_dir), path)
    return label_files.read(spark, path, label_files.FORWARD, 1 << 16)


@_query("label_file_size", f"WITH {MODEL}, s AS (SELECT CAST(4 + 4 * (max(vertex) + 1) + 8 * count(*) AS BIGINT) AS bytes FROM hop_labels) SELECT bytes, bytes // 12 AS records FROM s")
def _(spark, sf_dir):
    path = f"{shared_path(spark, 'out')}/labels.out"
    label_files.write_out(_far_labels(spark, sf_dir), path)
    return files.file_sizes(spark, path).select("bytes", "records")


@_query("graph_header_file", f"WITH {MODEL} SELECT CAST(count(DISTINCT vertex) + count(DISTINCT hub) AS INTEGER) AS vertices, CAST(2 * count(*) AS INTEGER) AS edges FROM hop_labels")
def _(spark, sf_dir):
    """A network with its header, written as text."""
    path, edges = shared_path(spark, "graph"), star_model(spark, sf_dir).edges
    header = edges.agg(F.concat_ws(" ", F.count_distinct("src"), F.count("*")).alias("value"))
    header.unionByName(edges.select(F.concat_ws(" ", "src", "dst", "w").alias("value"))).write.text(path)
    return files.graph_header(spark, path)


def _lines_file(spark, rows: DataFrame, header: DataFrame, name: str) -> str:
    """``rows(at, value)`` in order below a line of ``header(value)``, one file: line numbers are ids in these formats."""
    path = shared_path(spark, name)
    header.select(F.lit(-1).cast("long").alias("at"), "value").unionByName(rows).repartition(1).sortWithinPartitions("at").select("value").write.text(path)
    return path


def _numbered_keys(spark, sf_dir) -> DataFrame:
    """``(vertex, key_id)``: words by their number in the sorted dictionary."""
    keywords = star_model(spark, sf_dir).keywords
    ids = index.trie_intervals(keywords).join(keywords.select(F.col("word").alias("node")).distinct(), "node")
    return keywords.join(ids.select(F.col("node").alias("word"), F.col("id").alias("key_id")), "word").select("vertex", "key_id")


def _lists(pairs: DataFrame, by: str, of: str) -> DataFrame:
    own = F.sort_array(F.collect_list(of))
    return pairs.groupBy(by).agg(own.alias("own")).select(F.col(by).cast("long").alias("at"), F.concat_ws(" ", by, F.size("own"), F.array_join(F.col("own").cast("array<string>"), " ")).alias("value"))


_KEY_IDS = f"{_INTERVALS}, keyed AS (SELECT CAST(vertex AS INTEGER) AS vertex, CAST(id AS INTEGER) AS key_id FROM vertex_keywords JOIN ids ON node = word)"


@_query("key_vertex_file", f"WITH {MODEL}, {_KEY_IDS} SELECT vertex, key_id FROM keyed")
def _(spark, sf_dir):
    pairs = _numbered_keys(spark, sf_dir)
    header = pairs.agg(F.concat_ws(" ", F.count_distinct("key_id"), F.count("*")).alias("value"))
    return files.read_key_vertices(spark, _lines_file(spark, _lists(pairs, "key_id", "vertex"), header, "keys"))


@_query("vertex_key_file", f"WITH {MODEL}, {_KEY_IDS} SELECT vertex, key_id FROM keyed")
def _(spark, sf_dir):
    pairs = _numbered_keys(spark, sf_dir)
    header = pairs.agg(F.concat_ws(" ", F.count_distinct("vertex"), F.count("*")).alias("value"))
    return files.read_vertex_keys(spark, _lines_file(spark, _lists(pairs, "vertex", "key_id"), header, "vertices"))


@_query("workload_file", f"WITH {MODEL}, {_KEY_IDS} SELECT CAST(row_number() OVER (ORDER BY vertex, key_id) - 1 AS INTEGER) AS qid, vertex, key_id FROM keyed WHERE vertex % 10 = 0")
def _(spark, sf_dir):
    """Places with what is typed there, as a workload file of one query a line."""
    asked = _numbered_keys(spark, sf_dir).where("vertex % 10 = 0")
    lines = asked.select((F.col("vertex") * 1_000_000 + F.col("key_id")).alias("at"), F.concat_ws(" ", "vertex", "key_id").alias("value"))
    return files.read_workload(spark, _lines_file(spark, lines, asked.agg(F.count("*").cast("string").alias("value")), "workload"))


# --- streams ---------------------------------------------------------------------------------


#: A day without a key ends a text.
_IDLE = 86_400_000


@_query("keystroke_stream", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS anew FROM events
), b AS (SELECT *, sum(anew) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst, sum(anew) OVER (PARTITION BY user_id) AS bursts FROM g)
SELECT user_id AS session, CAST(count(*) AS INTEGER) AS step, string_agg(substr(event_type, 1, 1), '' ORDER BY ts, event_id) AS text FROM b WHERE burst = bursts GROUP BY 1""")
def _(spark, sf_dir):
    return keystrokes.typed_sessions(keystrokes.event_keys(spark, sf_dir), _IDLE)


_WORDS = ("widget", "small", "brand", "bolt")


@_query("keystroke_rankings", f"""WITH {MODEL}, asked AS (SELECT event_id // 3 AS qid, {Q} AS q, substr((ARRAY[{', '.join(f"'{w}'" for w in _WORDS)}])[1 + CAST(event_id // 3 % 4 AS INTEGER)], 1, CAST(count(*) AS INTEGER)) AS text FROM events GROUP BY 1, event_id // 3 % 4
), typed AS (SELECT DISTINCT q, text FROM asked
), peds AS (SELECT text, word, {_ped('text', 'word', 1)} AS ped FROM (SELECT DISTINCT word FROM vertex_keywords), (SELECT DISTINCT text FROM typed)
), m AS (SELECT text, vertex, CAST(min(ped) AS BIGINT) AS ped FROM peds JOIN vertex_keywords USING (word) WHERE ped IS NOT NULL GROUP BY 1, 2
), {_dist(Q)}, f AS (SELECT text, vertex, dist, ped FROM near JOIN m USING (vertex)
), r AS ({_ranked('f', 'text', 3, _score(1, 0.5, 100), _SRD)})
SELECT qid, rank, vertex, dist, ped, score FROM asked JOIN r USING (text)""")
def _(spark, sf_dir):
    """The ranking after the last key of every session of a stream."""
    m = star_model(spark, sf_dir)
    ranked = keystrokes.keystroke_rankings(keystrokes.typed_keys(spark, sf_dir, _WORDS), m.keywords, m.labels, Q, k=3, idle_ms=_IDLE)
    return _rounded(keystrokes.last_rankings(ranked).select("qid", "rank", "vertex", "dist", "ped", "score"))
