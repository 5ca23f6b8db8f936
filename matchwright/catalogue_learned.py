"""Further queries: blocking learned from the data, pruning in place, hierarchical clusters,
alignments and neighbour graphs."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import NARROW_SQL, PURGED_SQL, SCORED_PAIRS_SQL, doc_records, part_values, price_values, query, r6, t, value_scores
from .functions import alignment
from .functions import similarity as S
from .operators import blocking_tree, canopies, classifiers, compare, neighbourhoods, nn_descent, predicates, sampling, tfidf, token_blocking, value_clusters, word_vectors
from .plans import pipelines
from .storage import stored

# ---------------------------------------------------------------- generated predicates

CLIENT_COLUMNS = ["name", "email", "city", "nation_id", "balance"]
TEXTS, NUMBERS = CLIENT_COLUMNS[:3], CLIENT_COLUMNS[3:]
TOKENS_SQL = "list_distinct(list_filter(regexp_split_to_array(t, '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))"
#: Comparisons that may be made for each record.
EACH = 10


def _lattice_sql() -> str:
    parts, profile, order = [], [], 0

    def add(name: str, column: str, many: bool, key: str, source: str, where: str) -> None:
        nonlocal order
        parts.append(f"SELECT client_id AS id, {order} AS ord, '{column}' AS col, {int(many)} AS many, {name} AS pred, CAST({key} AS VARCHAR) AS key FROM {source} WHERE {where}")
        order += 1

    for c in TEXTS:
        profile.append(f"(SELECT avg(length(t)) FROM c_{c}) AS {c}_n, (SELECT avg(len({TOKENS_SQL})) FROM c_{c}) AS {c}_w")
        add(f"'whole of {c}'", c, False, "t", f"c_{c}", "true")
        for n in predicates.PREFIXES:
            add(f"'prefix {n} of {c}'", c, False, f"substr(t, 1, {n})", f"c_{c}, profile", f"length(t) >= {n} AND {c}_n > {n}")
        add(f"'tokens of {c}'", c, True, "k", f"(SELECT client_id, unnest({TOKENS_SQL}) AS k FROM c_{c}), profile", f"{c}_w >= 1.5")
        g = predicates.GRAM
        add(f"'grams {g} of {c}'", c, True, "k", f"(SELECT client_id, unnest(list_distinct(list_transform(range(1, length(t) - {g - 2}), lambda i: substr(t, i, {g})))) AS k FROM c_{c} WHERE length(t) >= {g}), profile", f"{c}_n > {g}")
    for c in NUMBERS:
        profile.append(f"(SELECT stddev_samp(CAST({c} AS DOUBLE)) FROM clients) AS {c}_s")
        add(f"'whole of {c}'", c, False, c, "clients", f"{c} IS NOT NULL")
        for k in predicates.WIDTHS:
            w = f"pow(10.0, floor(log10({c}_s)) - {k})"
            add(f"'bucket ' || format('{{:g}}', {w}) || ' of {c}'", c, False, f"CAST(floor({c} / {w}) AS BIGINT)", "clients, profile", f"{c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE)) AND {c}_s > 0")
    columns = ", ".join(f"c_{c} AS (SELECT client_id, lower(trim({c})) AS t FROM clients WHERE lower(trim({c})) <> '')" for c in TEXTS)
    return f"""
WITH {columns}, profile AS (SELECT {', '.join(profile)}),
keys AS (SELECT DISTINCT id, ord, col, many, pred, key FROM ({' UNION ALL '.join(parts)})),
lab AS (
    SELECT DISTINCT least(c.client_id, c.master_id) AS l, greatest(c.client_id, c.master_id) AS r, 1 AS label FROM clients c JOIN clients m ON m.client_id = c.master_id AND c.client_id <> c.master_id
    UNION ALL
    SELECT c.client_id, m.client_id, 0 FROM clients c JOIN clients m ON m.client_id = c.client_id + 1 AND c.master_id <> m.master_id
), cov AS (SELECT DISTINCT l, r, label, a.ord, a.pred FROM lab JOIN keys a ON a.id = l JOIN keys b ON b.id = r AND a.ord = b.ord AND a.key = b.key),
cost1 AS (SELECT ord, col, many, pred, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS c FROM (SELECT ord, col, many, pred, key, count(*) AS n FROM keys GROUP BY ALL) GROUP BY ALL)"""


STEPS = 12


@cache
def _chosen_sql() -> str:
    steps = []
    for k in range(1, STEPS + 1):
        before = f"(SELECT coalesce(sum(c), 0) FROM picks{k - 1})", f"(SELECT coalesce(sum(gain), 0) FROM picks{k - 1})"
        steps.append(f"""
gain{k} AS MATERIALIZED (SELECT name, count(*) AS gain FROM covc WHERE label = 1 AND NOT EXISTS (SELECT 1 FROM covc o JOIN picks{k - 1} p ON p.name = o.name WHERE o.label = 1 AND o.l = covc.l AND o.r = covc.r) GROUP BY name),
picks{k} AS MATERIALIZED (
    SELECT * FROM picks{k - 1} UNION ALL
    SELECT * FROM (SELECT {k} AS step, name, g.gain, coalesce(red, 0) AS red, c FROM gain{k} g JOIN cand USING (name) LEFT JOIN red USING (name)
        WHERE c + {before[0]} <= (SELECT budget FROM total) AND {before[1]} < 0.95 * (SELECT matches FROM total)
        ORDER BY g.gain / CAST(1 + coalesce(red, 0) AS DOUBLE) DESC, c, name LIMIT 1))""")
    return (
        _lattice_sql()
        + f""",
total AS (SELECT (SELECT {EACH} * count(*) FROM clients) AS budget, (SELECT count(*) FROM lab WHERE label = 1) AS matches),
helpful AS (SELECT DISTINCT ord FROM cov WHERE label = 1),
level2 AS (
    SELECT a.ord AS i, b.ord AS j, a.pred || ' & ' || b.pred AS name FROM cost1 a JOIN cost1 b ON a.ord < b.ord AND a.col <> b.col AND a.many + b.many < 2, total
    WHERE (a.c > budget OR b.c > budget) AND a.ord IN (SELECT ord FROM helpful) AND b.ord IN (SELECT ord FROM helpful)
), keys2 AS MATERIALIZED (SELECT a.id, name, a.key || chr(31) || b.key AS key FROM level2 JOIN keys a ON a.ord = i JOIN keys b ON b.ord = j AND b.id = a.id),
cost AS (SELECT pred AS name, c FROM cost1 UNION ALL SELECT name, CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT name, key, count(*) AS n FROM keys2 GROUP BY ALL) GROUP BY name),
covall AS MATERIALIZED (SELECT l, r, label, pred AS name FROM cov UNION ALL SELECT a.l, a.r, a.label, name FROM level2 JOIN cov a ON a.ord = i JOIN cov b ON b.ord = j AND a.l = b.l AND a.r = b.r AND a.label = b.label),
cand AS MATERIALIZED (SELECT name, c FROM cost WHERE c <= (SELECT budget FROM total) AND name IN (SELECT name FROM covall WHERE label = 1)),
covc AS MATERIALIZED (SELECT covall.* FROM covall JOIN cand USING (name)),
degree AS (SELECT l, r, count(*) AS d FROM covc WHERE label = 0 GROUP BY l, r),
red AS MATERIALIZED (SELECT name, count(*) AS red FROM covc JOIN degree USING (l, r) WHERE label = 0 AND d <= sqrt((SELECT count(*) FROM cand) / ln(greatest((SELECT matches FROM total), 3))) GROUP BY name),
picks0 AS (SELECT 0 AS step, '' AS name, CAST(0 AS BIGINT) AS gain, CAST(0 AS BIGINT) AS red, CAST(0 AS BIGINT) AS c WHERE false),"""
        + ",".join(steps)
    )


def clients(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "clients").withColumnRenamed("client_id", "id")


def client_labels(records: DataFrame) -> DataFrame:
    """Each client with its master is a match; each with the next one, of another master, is none."""
    master = records.select(F.col("id").alias("m"), F.col("master_id").alias("of")).hint("merge")
    matches = records.join(master, F.col("master_id") == F.col("m")).where("id <> m").select(F.least("id", "m").alias("left_id"), F.greatest("id", "m").alias("right_id"), F.lit(1).alias("label")).distinct()
    others = records.join(master, F.col("id") + 1 == F.col("m")).where("master_id <> of").select(F.col("id").alias("left_id"), F.col("m").alias("right_id"), F.lit(0).alias("label"))
    return matches.unionByName(others)


def learned(spark: SparkSession, d: str) -> tuple[DataFrame, list[predicates.Chosen]]:
    records = clients(spark, d)
    return records, predicates.learn_predicates(records, None, client_labels(records), CLIENT_COLUMNS, EACH * records.count())


@query(_lattice_sql() + "\nSELECT pred AS predicate, c AS comparisons, (SELECT count(*) FROM cov WHERE label = 1 AND cov.pred = cost1.pred) AS matches FROM cost1")
def predicate_lattice(spark: SparkSession, d: str) -> DataFrame:
    """The predicates that the columns' profiles give, what each would compare and which known matches it covers."""
    records = clients(spark, d)
    singles = predicates.lattice(records, CLIENT_COLUMNS)
    cost = predicates.comparisons(records, None, singles)
    covered = predicates.covers(records, None, client_labels(records).where("label = 1"), singles)
    names = spark.createDataFrame([(i, p.name, cost[i]) for i, p in enumerate(singles)], "i int, predicate string, comparisons long")
    matches = covered.select(F.explode(predicates.bits(len(singles))).alias("i")).groupBy("i").agg(F.count("*").alias("matches"))
    return names.join(matches, "i", "left").select("predicate", "comparisons", F.coalesce("matches", F.lit(0)).cast("long").alias("matches"))


@query(_chosen_sql() + f"\nSELECT CAST(step AS INTEGER) AS step, name AS predicate, gain, red, c AS comparisons FROM picks{STEPS}")
def learned_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Which predicates are chosen, in order; none is written by hand."""
    _, chosen = learned(spark, d)
    return spark.createDataFrame([(k + 1, c.predicate.name, c.gain, c.red, c.comparisons) for k, c in enumerate(chosen)], "step int, predicate string, gain long, red long, comparisons long")


@query(_chosen_sql() + f""", used AS (SELECT id, pred AS name, key FROM keys JOIN picks{STEPS} p ON p.name = keys.pred UNION ALL SELECT id, name, key FROM keys2 JOIN picks{STEPS} USING (name))
SELECT DISTINCT a.id AS left_id, b.id AS right_id FROM used a JOIN used b ON a.name = b.name AND a.key = b.key AND a.id < b.id""")
def learned_predicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of clients that the chosen predicates compare."""
    records, chosen = learned(spark, d)
    return predicates.predicate_pairs(records, None, [c.predicate for c in chosen])


@query()
def blocked_training_sample(spark: SparkSession, d: str) -> DataFrame:
    """Draws of client pairs, nine in ten from blocks of one address or one name, with weights that undo it."""
    records = clients(spark, d)
    kinds = [predicates.Predicate((("email", "whole"),)), predicates.Predicate((("name", "tokens"), ("city", "whole")))]
    return sampling.blocked_sample(records, None, kinds, 5 * records.count())


# ---------------------------------------------------------------- a tree of functions

LEAF = 20


@cache
def _tree_sql() -> str:
    """A level of the tree is a group of tables; those past the last level are empty."""
    levels = []
    for k in range(len(TEXTS) * (1 + len(predicates.PREFIXES)) + len(NUMBERS) * (1 + len(predicates.WIDTHS))):
        levels.append(f"""
weighed{k} AS (SELECT node, ord, name, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS c FROM (SELECT node, ord, name, key, count(*) AS n FROM st{k} JOIN fn USING (id) GROUP BY ALL) GROUP BY ALL),
parted{k} AS (SELECT s.node, a.ord, count(*) FILTER (a.key <> b.key) AS lost FROM known JOIN st{k} s ON s.id = l JOIN st{k} q ON q.id = r AND q.node = s.node JOIN fn a ON a.id = l JOIN fn b ON b.id = r AND a.ord = b.ord GROUP BY ALL),
split{k} AS MATERIALIZED (
    SELECT {k} AS level, node, ord, name, n, c, coalesce(lost, 0) AS lost FROM weighed{k} LEFT JOIN parted{k} USING (node, ord) WHERE n > {LEAF} AND c < n * (n - 1) // 2
    QUALIFY row_number() OVER (PARTITION BY node ORDER BY (n * (n - 1) // 2 - c) / CAST(1 + coalesce(lost, 0) AS DOUBLE) DESC, coalesce(lost, 0), ord) = 1),
st{k + 1} AS MATERIALIZED (SELECT id, md5(node || chr(31) || s.name || chr(31) || key) AS node FROM st{k} JOIN split{k} s USING (node) JOIN fn USING (id, ord))""")
    n = len(levels)
    splits = " UNION ALL ".join(f"SELECT * FROM split{k}" for k in range(n))
    leaves = " UNION ALL ".join([f"SELECT id, node FROM st{k} WHERE node NOT IN (SELECT node FROM split{k})" for k in range(n)] + [f"SELECT id, node FROM st{n}"])
    return (
        _lattice_sql()
        + f""",
fn AS MATERIALIZED (
    SELECT client_id AS id, f.ord, f.pred AS name, coalesce(key, '') AS key FROM clients CROSS JOIN (SELECT DISTINCT ord, pred FROM keys WHERE many = 0) f LEFT JOIN keys ON keys.id = client_id AND keys.ord = f.ord),
known AS (SELECT l, r FROM lab WHERE label = 1), st0 AS (SELECT client_id AS id, '' AS node FROM clients),"""
        + ",".join(levels)
        + f", splits AS ({splits}), leaves AS MATERIALIZED ({leaves})"
    )


def client_tree(spark: SparkSession, d: str) -> tuple[DataFrame, blocking_tree.BlockingTree]:
    records = clients(spark, d)
    return records, blocking_tree.learn_tree(records, client_labels(records).where("label = 1"), CLIENT_COLUMNS, LEAF)


@query(_tree_sql() + "\nSELECT level, node, name AS function, n, c AS comparisons, lost FROM splits")
def blocking_tree_splits(spark: SparkSession, d: str) -> DataFrame:
    """The learned tree of functions: how each node splits its clients and what that costs."""
    _, tree = client_tree(spark, d)
    return tree.splits.drop("f")


@query(_tree_sql() + "\nSELECT a.id AS left_id, b.id AS right_id FROM leaves a JOIN leaves b ON a.node = b.node AND a.id < b.id")
def blocking_tree_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of clients that end in one leaf."""
    records, tree = client_tree(spark, d)
    return tree.pairs(records)


# ---------------------------------------------------------------- index predicates

GRAMS_SQL = """
WITH texts AS (SELECT client_id AS id, lower(concat_ws(' ', name, email)) AS t FROM clients),
g AS (SELECT id, unnest(CASE WHEN length(t) >= 3 THEN list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)) WHEN length(t) > 0 THEN [t] ELSE CAST([] AS VARCHAR[]) END) AS term FROM texts),
tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY id, term),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM texts)) / (1.0 + count(*))) + 1.0 AS idf FROM tf GROUP BY term),
v AS (SELECT id, term, tf * idf AS v FROM tf JOIN idf USING (term)), z AS (SELECT id, sqrt(sum(v * v)) AS z FROM v GROUP BY id),
n AS MATERIALIZED (SELECT id, term, v / z AS w FROM v JOIN z USING (id)),
near AS MATERIALIZED (SELECT left_id, right_id, s FROM (SELECT a.id AS left_id, b.id AS right_id, sum(a.w * b.w) AS s FROM n a JOIN n b ON a.term = b.term AND a.id < b.id GROUP BY a.id, b.id) WHERE s >= 0.6 - 1e-9)"""


def client_near(spark: SparkSession, d: str) -> DataFrame:
    """Clients whose 3-grams of name and address have a TF-IDF cosine of 0.6 or more."""
    texts = stored(t(spark, d, "clients").select(F.col("client_id").alias("id"), F.lower(F.concat_ws(" ", "name", "email")).alias("text")), "texts")
    grams = lambda x: S.qgrams(x, 3)
    return canopies.similar_pairs(tfidf.vectors(texts, grams, tfidf.fit_idf(texts, grams)), 0.6)


@query(GRAMS_SQL + " SELECT left_id, right_id, round(s, 6) AS cosine FROM near")
def index_similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    return client_near(spark, d).select("left_id", "right_id", r6(F.col("cosine")).alias("cosine"))


@query(GRAMS_SQL.replace("WITH texts", "WITH RECURSIVE texts") + """,
either AS (SELECT left_id AS id, right_id AS o FROM near UNION ALL SELECT right_id, left_id FROM near),
nb AS MATERIALIZED (SELECT id, list(o) AS os, row_number() OVER (ORDER BY id) AS k FROM either GROUP BY id),
walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS centres UNION ALL
    SELECT walk.k + 1, CASE WHEN list_has_any(centres, os) THEN centres ELSE list_append(centres, id) END FROM walk JOIN nb ON nb.k = walk.k + 1),
centre AS (SELECT unnest(centres) AS c FROM (SELECT centres FROM walk ORDER BY k DESC LIMIT 1))
SELECT client_id AS id, CASE WHEN client_id IN (SELECT c FROM centre) THEN client_id ELSE coalesce((SELECT min(o) FROM either JOIN centre ON c = o WHERE either.id = client_id), client_id) END AS canopy FROM clients""")
def canopy_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Canopies over the index: each client's first centre in the order of ids."""
    return canopies.canopies(clients(spark, d), stored(client_near(spark, d), "near"))


# ---------------------------------------------------------------- pruning record by record


def kept_blocks(spark: SparkSession, d: str) -> DataFrame:
    return token_blocking.pruned_blocks(doc_records(spark, d), ["text"])


JS_SQL = "SELECT left_id, right_id, common / CAST(bl + br - common AS DOUBLE) AS w FROM graph"


@query(PURGED_SQL + f""", j AS ({JS_SQL}), ends AS (SELECT left_id AS id, * FROM j UNION ALL SELECT right_id, * FROM j),
top AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, left_id, right_id) <= 5)
SELECT DISTINCT left_id, right_id, round(w, 6) AS weight FROM top""")
def node_pruning_in_place(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of each document by the Jaccard weight, without a graph."""
    return neighbourhoods.node_pruning(kept_blocks(spark, d), 5, "JS").select("left_id", "right_id", r6(F.col("weight")).alias("weight"))


@query(PURGED_SQL + f""", j AS ({JS_SQL}), ends AS (SELECT left_id AS id, * FROM j UNION ALL SELECT right_id, * FROM j),
top AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, left_id, right_id) <= 5)
SELECT left_id, right_id, round(any_value(w), 6) AS weight FROM top GROUP BY left_id, right_id HAVING count(*) = 2""")
def reciprocal_node_pruning(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are among each other's five nearest."""
    return neighbourhoods.node_pruning(kept_blocks(spark, d), 5, "JS", reciprocal=True).select("left_id", "right_id", r6(F.col("weight")).alias("weight"))


@query(PURGED_SQL + """SELECT left_id, right_id, CAST(common AS DOUBLE) AS weight FROM graph QUALIFY row_number() OVER (ORDER BY common DESC, left_id, right_id) <= 700""")
def edge_pruning_in_place(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhoods.edge_pruning(kept_blocks(spark, d), 700, "CBS")


@query(PURGED_SQL + """SELECT left_id, right_id, CAST(common AS DOUBLE) AS weight FROM graph WHERE common >= (SELECT avg(common) FROM graph)""")
def mean_edge_pruning_in_place(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhoods.mean_edge_pruning(kept_blocks(spark, d), "CBS")


@query(PURGED_SQL + """, ends AS (SELECT left_id AS id, left_id, right_id, common FROM graph UNION ALL SELECT right_id, left_id, right_id, common FROM graph),
mean AS (SELECT id, sum(common) AS s, count(*) AS n FROM ends GROUP BY id)
SELECT left_id, right_id, CAST(any_value(common) AS DOUBLE) AS weight FROM ends JOIN mean USING (id) WHERE common >= s / CAST(n AS DOUBLE) GROUP BY left_id, right_id HAVING count(*) = 2""")
def mean_node_pruning_in_place(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of at least the mean weight at both of their documents."""
    return neighbourhoods.mean_node_pruning(kept_blocks(spark, d), "CBS", reciprocal=True)


# ---------------------------------------------------------------- hierarchical clusters

SWEPT = [round(0.05 * k, 2) for k in range(1, 21)]


@query(f"""
WITH RECURSIVE s AS ({SCORED_PAIRS_SQL}), steps AS (SELECT unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in SWEPT)}]) AS threshold),
e AS (SELECT threshold, left_id AS l, right_id AS r FROM s, steps WHERE score >= threshold), b AS (SELECT * FROM e UNION ALL SELECT threshold, r, l FROM e),
reach(threshold, node, root) AS (SELECT DISTINCT threshold, l, l FROM b UNION SELECT b.threshold, b.r, root FROM reach JOIN b ON b.threshold = reach.threshold AND b.l = reach.node AND root < b.r),
groups AS (SELECT threshold, node, min(root) AS g FROM reach GROUP BY threshold, node),
told AS (
    SELECT st.threshold, label = 1 AS hit, coalesce(x.g, s.left_id) = coalesce(y.g, s.right_id) AS same
    FROM s CROSS JOIN steps st LEFT JOIN groups x ON x.threshold = st.threshold AND x.node = s.left_id LEFT JOIN groups y ON y.threshold = st.threshold AND y.node = s.right_id),
c AS (SELECT threshold, count(*) FILTER (same AND hit) AS tp, count(*) FILTER (same AND NOT hit) AS fp, count(*) FILTER (NOT same AND hit) AS fn FROM told GROUP BY threshold)
SELECT threshold, tp AS true_positives, fp AS false_positives, fn AS false_negatives, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS "precision",
    round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1 FROM c""")
def cluster_sweep_single(spark: SparkSession, d: str) -> DataFrame:
    """Pair metrics of single-linkage clusters at twenty thresholds, from one tree."""
    out = value_clusters.sweep(*price_values(spark, d), SWEPT, "single")
    return out.select("threshold", "true_positives", "false_positives", "false_negatives", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query()
def cluster_sweep_average(spark: SparkSession, d: str) -> DataFrame:
    """The same of average-linkage clusters."""
    return value_clusters.sweep(*price_values(spark, d), SWEPT, "average")


# ---------------------------------------------------------------- alignments


def _alignment_sql(s: alignment.Scheme) -> str:
    """One row of the table a step; a gap along the row is the best of all shorter prefixes."""
    zero = "greatest(0.0, {})" if s.local else "{}"
    start = "0.0::DOUBLE" if s.local else f"CASE WHEN j = 0 THEN 0.0::DOUBLE ELSE -({s.open} + (j - 1) * {s.extend})::DOUBLE END"
    cell = f"CASE WHEN substr(a, i + 1, 1) = substr(b, CAST(j AS BIGINT), 1) THEN {s.match} ELSE {s.mismatch} END"
    diagonal = zero.format(f"greatest(h[j] + {cell}, v[j + 1])")
    first = zero.format("v[1]")
    return f"""
    SELECT CAST(0 AS BIGINT) AS i, a, b, list_transform(range(0, length(b) + 1), lambda j: {start}) AS h, list_transform(range(0, length(b) + 1), lambda j: CAST(-1e9 AS DOUBLE)) AS v, CAST(0 AS DOUBLE) AS best FROM p
    UNION ALL
    SELECT i + 1, a, b, h, v, greatest(best, list_max(h)) FROM (
        SELECT i, a, b, v, best, list_transform(range(0, length(b) + 1), lambda j: CASE WHEN j = 0 THEN e[1] ELSE greatest(e[j + 1], list_max(list_transform(range(0, j), lambda k: e[k + 1] - {s.open} - (j - k - 1) * {s.extend}))) END) AS h FROM (
            SELECT i, a, b, v, best, list_transform(range(0, length(b) + 1), lambda j: CASE WHEN j = 0 THEN {first} ELSE {diagonal} END) AS e FROM (
                SELECT i, a, b, h, best, list_transform(range(0, length(b) + 1), lambda j: greatest(h[j + 1] - {s.open}, v[j + 1] - {s.extend})) AS v FROM dp_{{0}} WHERE i < length(a))))"""


SCHEMES = {"global": alignment.NEEDLEMAN_WUNSCH, "local": alignment.SMITH_WATERMAN, "affine": alignment.AFFINE_COST}


@query("WITH RECURSIVE p AS (SELECT DISTINCT nl AS a, nr AS b FROM (" + NARROW_SQL + ")), " + ", ".join(f"dp_{n} AS ({_alignment_sql(s).format(n)})" for n, s in SCHEMES.items()) + """
SELECT left_id, right_id, round(g.h[length(nr) + 1], 6) AS needleman_wunsch, round(l.best, 6) AS smith_waterman, round(f.h[length(nr) + 1], 6) AS affine_gap
FROM (""" + NARROW_SQL + """) JOIN dp_global g ON g.a = nl AND g.b = nr AND g.i = length(nl) JOIN dp_local l ON l.a = nl AND l.b = nr AND l.i = length(nl) JOIN dp_affine f ON f.a = nl AND f.b = nr AND f.i = length(nl)""")
def alignment_similarities(spark: SparkSession, d: str) -> DataFrame:
    """Global and local alignment, and the cost with cheaper long gaps, of the names of pairs."""
    named = {"needleman_wunsch": SCHEMES["global"], "smith_waterman": SCHEMES["local"], "affine_gap": SCHEMES["affine"]}
    values = part_values(spark, d, ["p_name"])
    scored = alignment.with_alignment(values.rows, "p_name_l", "p_name_r", named)
    return values.expand(scored.select("left_class", "right_class", "pairs", *[r6(F.col(c)).alias(c) for c in named]))


@query(f"""
WITH p AS (SELECT *, list_filter(regexp_split_to_array(tl, '\\s+'), lambda x: x <> '') AS x, list_filter(regexp_split_to_array(tr, '\\s+'), lambda x: x <> '') AS y FROM ({NARROW_SQL}))
SELECT left_id, right_id, round(list_avg(list_transform(x, lambda u: list_max(list_transform(y, lambda w: 1 - levenshtein(u, w) / CAST(greatest(length(u), length(w)) AS DOUBLE))))), 6) AS monge_elkan FROM p""")
def hybrid_similarities(spark: SparkSession, d: str) -> DataFrame:
    """Each word's best match in the other text, on average."""
    values = part_values(spark, d, ["p_type"])
    scored = S.on_distinct_pairs(values.rows, "p_type_l", "p_type_r", {"monge_elkan": r6(alignment.monge_elkan(F.col("l"), F.col("r")))})
    return values.expand(scored.select("left_class", "right_class", "pairs", "monge_elkan"))


# ---------------------------------------------------------------- neighbours and whole flows


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query()
def nn_descent_graph(spark: SparkSession, d: str) -> DataFrame:
    """About the five nearest of each vector, without comparing all: ``knn_blocking`` has the exact ones."""
    return nn_descent.nearest_neighbours(vectors(spark, d), 5)


@query("""
WITH RECURSIVE s AS (SELECT a.vec_id AS l, b.vec_id AS r, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
k AS (SELECT l, r FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS rank FROM s) WHERE rank <= 5 AND score >= 0.5),
e AS (SELECT l, r FROM k UNION ALL SELECT r, l FROM k),
reach(node, root) AS (SELECT DISTINCT l, l FROM e UNION SELECT e.r, root FROM reach JOIN e ON e.l = reach.node AND root < e.r),
g AS (SELECT node, min(root) AS c FROM reach GROUP BY node)
SELECT vec_id AS node, coalesce(c, vec_id) AS cluster_id FROM (SELECT DISTINCT vec_id FROM embeddings) LEFT JOIN g ON node = vec_id""")
def embedding_blocking_flow(spark: SparkSession, d: str) -> DataFrame:
    """Vectors, their five nearest, a distance, components."""
    return pipelines.EmbeddingBlocking(5, 0.5).clusters(vectors(spark, d))


CLIENT_TYPES = {"name": "String", "email": "ShortString", "city": "ShortString", "nation_id": "Numeric", "balance": "Numeric"}


@query()
def evaluate_learned_matcher(spark: SparkSession, d: str) -> DataFrame:
    """Clients against their masters with no rule given: learned blocking, a learner, a swept merge tree."""
    records = clients(spark, d)
    kept = stored(client_labels(records).withColumn("part", F.pmod(F.xxhash64("left_id"), F.lit(3))), "labelled")
    splits = [kept.where(F.col("part") == i).drop("part") for i in range(3)]
    return pipelines.LearnedMatcher(CLIENT_TYPES, tuple(CLIENT_TYPES)).run(records, *splits)


@query()
def kernel_machine_scores(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities of the Gaussian kernel machine for all labelled pairs of parts."""
    feats = [("p_name", "levenshtein"), ("p_name", "jaccard_q3"), ("p_type", "jaccard_words"), ("p_brand", "exact"), ("p_retailprice", "num_rel")]
    return value_scores(spark, d, feats, classifiers.Config("rbf", balanced=True))


# ---------------------------------------------------------------- vectors from the texts themselves

MET_SQL = """
WITH w AS (SELECT list_filter(regexp_split_to_array(lower(coalesce(p_name, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM part),
places AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM w),
one AS (SELECT w[i] AS word, unnest(w[i + 1:i + 4]) AS other FROM places),
met AS (SELECT word, other, count(*) AS n FROM (SELECT * FROM one UNION ALL SELECT other, word FROM one) GROUP BY word, other)"""


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return word_vectors.cooccurrences(t(spark, d, "part"), "p_name", 4)


@query(MET_SQL + " SELECT word, other, n FROM met")
def word_cooccurrences(spark: SparkSession, d: str) -> DataFrame:
    """How often words stand near each other in the names of parts."""
    return word_counts(spark, d)


@query(MET_SQL + """, s AS (SELECT word, sum(n) AS s FROM met GROUP BY word),
i AS (SELECT word, other, ln(n * (SELECT sum(n) FROM met) / (CAST(a.s AS DOUBLE) * b.s)) AS weight FROM met JOIN s a USING (word) JOIN s b ON b.word = other)
SELECT word, other, round(weight, 6) AS weight FROM i WHERE weight > 1e-9""")
def word_information(spark: SparkSession, d: str) -> DataFrame:
    """What the counts say beyond chance: the matrix whose factors are the vectors."""
    return word_vectors.information(stored(word_counts(spark, d), "counts")).where("weight > 1e-9").select("word", "other", r6(F.col("weight")).alias("weight"))


@query()
def learned_record_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all parts, which come from their names alone."""
    vectors = word_vectors.word_vectors(word_vectors.information(stored(word_counts(spark, d), "counts")), 8)
    placed = word_vectors.record_vectors(t(spark, d, "part").withColumnRenamed("p_partkey", "id"), "p_name", stored(vectors, "vectors"), 8)
    return placed.select("id", F.transform("embedding", r6).alias("embedding"))
