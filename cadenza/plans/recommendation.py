"""Similarity, recommendation, their evaluation; sources and models (rows only where SQL cannot say it)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadenza.operators import cooccurrence as co
from cadenza.operators import cells, dataset, evaluation, ml, recommend, similarity
from cadenza.plans.registry import query
from cadenza.plans.views import DIMS, ITEMS_SQL, items, seeds, table, tracks
from cadenza.sources import catalog_csv, rest, sinks
from cadenza.sources.sinks import shared_folder

P = f"WITH {ITEMS_SQL}"
TOP = 10
BOOSTED = "round(cosine + CASE WHEN genre = seed_genre AND NOT is_imputed AND NOT seed_imputed THEN 0.05 ELSE 0 END, 9)"


def index(spark, d):
    return similarity.index_of(items(spark, d), "vector", DIMS)


def ranked_sql(score: str = "cosine", where: str = "true") -> str:
    return f"r AS (SELECT *, {score} AS score, row_number() OVER (PARTITION BY seed_id ORDER BY {score} DESC, id) AS rank FROM pairs WHERE {where})"


@query(P + " SELECT k - 1 AS dimension, round(m, 6) AS mean, round(d, 6) AS deviation FROM params")
def zscore_params(spark, d):
    one = similarity.parameters(items(spark, d), "vector", DIMS)
    return one.select(F.explode(F.arrays_zip("means", "deviations", F.sequence(F.lit(0).cast("long"), F.lit(DIMS - 1).cast("long")).alias("k"))).alias("x")).select(F.col("x.k").alias("dimension"), F.round("x.means", 6).alias("mean"), F.round("x.deviations", 6).alias("deviation"))


@query(P + " SELECT id, round(unit[1], 6) AS first, round(unit[64], 6) AS last, round(list_sum(unit), 6) AS total FROM facts")
def zscore(spark, d):
    return index(spark, d).select("id", F.round(F.get("unit", F.lit(0)), 6).alias("first"), F.round(F.get("unit", F.lit(63)), 6).alias("last"), F.round(F.aggregate("unit", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(P + " SELECT id, genre, is_imputed, round(sqrt(list_inner_product(unit, unit)), 6) AS length FROM facts")
def similarity_index(spark, d):
    return index(spark, d).select("id", "genre", "is_imputed", F.round("length", 6).alias("length"))


@query(P + " SELECT seed_id, id, cosine FROM pairs")
def cosine_pairs(spark, d):
    i = index(spark, d)
    return similarity.cosines(seeds(i), i)


@query(f"{P}, {ranked_sql()} SELECT seed_id, id, rank FROM r WHERE rank <= {TOP}")
def knn_cosine_topn(spark, d):
    i = index(spark, d)
    return similarity.nearest(seeds(i), i, TOP).select("seed_id", "id", "rank")


def repeated_items(spark, d, times: int = 20):
    """The items with further takes of each, a little off: vectors that cluster, as those of a catalogue do."""
    takes = items(spark, d).withColumn("take", F.explode(F.array(*map(F.lit, range(times)))))
    moved = F.transform("vector", lambda x, k: x + 0.01 * F.sin(F.col("take") * (k + 1)))
    return takes.select((F.col("id") * times + F.col("take")).alias("id"), moved.alias("vector"), "genre", "is_imputed")


@query(f"{P}, {ranked_sql(BOOSTED)} SELECT seed_id, id, rank, score FROM r WHERE rank <= {TOP}")
def knn_cells(spark, d):
    """The search with boost over cells instead of all pairs."""
    i = index(spark, d)
    return cells.neighbours(seeds(i), cells.build(i), TOP, "boost")[0].select("seed_id", "id", "rank", "score")


REPEATED = ITEMS_SQL.replace("items AS (", "base AS (", 1).replace("\ndims AS", """,
items AS (SELECT id * 20 + take AS id, list_transform(vector, lambda x, k: x + 0.01 * sin(take * k)) AS vector, genre, is_imputed, popularity, key FROM base, range(0, 20) t(take)),
dims AS""", 1).replace("popularity, key FROM base", "popularity, key FROM base")


@query(f"WITH {REPEATED.replace('),,', '),')}, {ranked_sql()} SELECT seed_id, id, rank FROM r WHERE rank <= {TOP}")
def knn_cells_repeated(spark, d):
    """Over twenty takes of each vector: cells then let most products be passed over."""
    i = similarity.index_of(repeated_items(spark, d), "vector", DIMS)
    return cells.neighbours(seeds(i), cells.build(i, 1024), TOP)[0].select("seed_id", "id", "rank")


@query(f"{P}, {ranked_sql()} SELECT seed_id, id, rank, score FROM r WHERE rank <= 100")
def knn_diagnostic(spark, d):
    i = index(spark, d)
    return similarity.diagnostic(seeds(i), i, 1000).select("seed_id", "id", "rank", "score")


@query(f"{P}, {ranked_sql(BOOSTED)} SELECT seed_id, id, rank, score, seed_genre IS NULL OR seed_imputed AS fell_back FROM r WHERE rank <= {TOP}")
def knn_boost(spark, d):
    i = index(spark, d)
    return similarity.nearest(seeds(i), i, TOP, "boost").select("seed_id", "id", "rank", "score", "fell_back")


@query(f"{P}, {ranked_sql(where='seed_genre IS NULL OR seed_imputed OR (genre = seed_genre AND NOT is_imputed)')} SELECT seed_id, id, rank FROM r WHERE rank <= {TOP}")
def knn_same_genre(spark, d):
    i = index(spark, d)
    return similarity.nearest(seeds(i), i, TOP, "same_genre").select("seed_id", "id", "rank")


ADHOC = [0.1] * 32 + [-0.1] * 32


@query(f"{P}, a AS (SELECT list(((CASE WHEN k <= 32 THEN 0.1 ELSE -0.1 END) - m) / d ORDER BY k) AS u FROM params) SELECT id, round(list_cosine_similarity(unit, u), 9) AS score FROM facts, a ORDER BY round(list_cosine_similarity(unit, u), 9) DESC, id LIMIT {TOP}")
def knn_adhoc(spark, d):
    base = items(spark, d)
    params = similarity.parameters(base, "vector", DIMS)
    asked = spark.createDataFrame([(-1, ADHOC, None, False)], "id long, vector array<double>, genre string, is_imputed boolean")
    found = similarity.neighbours(similarity.standardised(asked, "vector", params), similarity.standardised(base, "vector", params), TOP)
    return found.select("id", "score")


SHARES = "s AS (SELECT seed_id, id, rank, x - 1 AS dimension, round(unit[x] * seed_unit[x] / sqrt(list_inner_product(unit, unit) * list_inner_product(seed_unit, seed_unit)), 9) AS share FROM r, range(1, 65) t(x) WHERE rank <= 10), n AS (SELECT *, row_number() OVER (PARTITION BY seed_id, id ORDER BY share DESC, dimension) AS k FROM s)"


@query(f"{P}, {ranked_sql()}, {SHARES} SELECT seed_id, id, CAST(dimension AS INTEGER) AS dimension, share FROM n WHERE k <= 3")
def explain_topk(spark, d):
    i = index(spark, d)
    found = similarity.neighbours(seeds(i), i, TOP).select("seed_id", "id", F.explode(similarity.contributions(3)).alias("x"))
    return found.select("seed_id", "id", F.col("x.dimension").alias("dimension"), F.col("x.share").alias("share"))


@query(f"{P}, {ranked_sql(BOOSTED)}, {SHARES} SELECT seed_id, id, any_value(rank) AS rank, string_agg(CAST(dimension AS VARCHAR), ',' ORDER BY k) AS reasons FROM n WHERE k <= 3 GROUP BY ALL")
def knn_explained(spark, d):
    i = index(spark, d)
    found = similarity.neighbours(seeds(i), i, TOP, "boost").withColumn("why", similarity.contributions(3))
    return found.select("seed_id", "id", "rank", F.array_join(F.transform("why", lambda s: s["dimension"].cast("string")), ",").alias("reasons"))


@query("SELECT CAST(l AS INTEGER) AS wanted, CAST(r AS INTEGER) AS round, CAST(least(greatest(3 * l, 10) * 2 ** (r - 1), 600) AS INTEGER) AS size, n FROM (SELECT 1 + p_partkey % 250 AS l, count(*) AS n FROM part GROUP BY 1), (VALUES (1), (2), (3)) w(r) WHERE r = 1 OR least(greatest(3 * l, 10) * 2 ** (r - 1), 600) > least(greatest(3 * l, 10) * 2 ** (r - 2), 600)")
def overfetch_windows(spark, d):
    """The windows of lists as long as the parts' numbers ask, and how many ask for each."""
    wanted = table(spark, d, "part").groupBy((F.col("p_partkey") % 250 + 1).cast("int").alias("wanted")).agg(F.count("*").alias("n"))
    return wanted.select("wanted", F.posexplode(similarity.overfetch_of(F.col("wanted"))).alias("round", "size"), "n").withColumn("round", F.col("round") + 1)


WINDOW = similarity.overfetch(TOP)[-1]
FACTS = "SELECT seed_id, id, rank, key, popularity, is_imputed FROM r"


@query(f"""{P}, {ranked_sql()}, w AS ({FACTS} WHERE rank <= {WINDOW}), g AS (SELECT seed_id, key, min(rank) AS first_rank, count(*) - 1 AS collapsed FROM w GROUP BY ALL),
b AS (SELECT seed_id, key, id, row_number() OVER (PARTITION BY seed_id, key ORDER BY popularity DESC, is_imputed, id) AS n FROM w),
p AS (SELECT seed_id, id, first_rank, collapsed, row_number() OVER (PARTITION BY seed_id ORDER BY first_rank) AS position FROM g JOIN b USING (seed_id, key) WHERE n = 1) SELECT * FROM p WHERE position <= {TOP}""")
def collapse_by_key(spark, d):
    i = index(spark, d)
    return recommend.collapse_by_key(similarity.neighbours(seeds(i), i, WINDOW), TOP)


def edges_of_seeds(spark, d):
    """Items as parts: co-occurrence of the parts with the seeds' numbers."""
    some = items(spark, d).where("id % 100 = 0").select(F.col("id").alias("seed"))
    found = co.seed_edges(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item")), some)
    return found.select(F.col("seed").alias("seed_id"), F.col("item").alias("id"), "co_count", "jaccard")


@query(f"""{P}, {ranked_sql(BOOSTED)}, w AS (SELECT seed_id, id, score FROM r WHERE rank <= {WINDOW}),
b AS (SELECT DISTINCT l_orderkey AS basket, l_partkey AS item FROM lineitem), q AS (SELECT x.item AS low, y.item AS high, count(*) AS co_count FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY ALL HAVING count(*) >= 2),
t AS (SELECT item, count(*) AS total FROM b GROUP BY 1), e AS (SELECT low, high, co_count, round(co_count / (l.total + h.total - co_count), 9) AS jaccard FROM q JOIN t l ON l.item = low JOIN t h ON h.item = high),
c AS (SELECT * FROM (SELECT low AS seed_id, high AS id, co_count, jaccard FROM e UNION ALL SELECT high, low, co_count, jaccard FROM e) WHERE seed_id IN (SELECT id FROM items WHERE id % 100 = 0)),
m AS (SELECT seed_id, min(score) AS lo, max(score) AS hi FROM w GROUP BY 1), n AS (SELECT seed_id, id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END AS content FROM w JOIN m USING (seed_id))
SELECT seed_id, id, round(0.65 * coalesce(content, 0) + 0.35 * coalesce(jaccard, 0), 9) AS score, round(coalesce(content, 0), 9) AS content, coalesce(jaccard, 0) AS jaccard, coalesce(co_count, 0) AS co_count,
 CASE WHEN content IS NOT NULL AND jaccard IS NOT NULL THEN 'blended' WHEN jaccard IS NOT NULL THEN 'collaborative' END AS signal FROM n FULL JOIN c USING (seed_id, id)""")
def blend(spark, d):
    i = index(spark, d)
    content = similarity.nearest(seeds(i), i, WINDOW, "boost").select("seed_id", "id", "score")
    return recommend.blend(content, edges_of_seeds(spark, d)).select("seed_id", "id", "score", "content", "jaccard", "co_count", "signal")


def greedy_sql(source: str) -> str:
    """Groups of near-duplicates row by row, as a recursion over the ranks of each seed and round of ``source``."""
    return f"""lists AS (SELECT seed_id, round, list(id ORDER BY rank) AS ids, list(rank ORDER BY rank) AS ranks, list(score ORDER BY rank) AS scores, list(key ORDER BY rank) AS keys, list(coalesce(popularity, -1) ORDER BY rank) AS pops,
  list(coalesce(is_imputed, false) ORDER BY rank) AS imps, list(unit ORDER BY rank) AS units FROM {source} GROUP BY ALL),
walk AS (SELECT seed_id, round, 0 AS k, []::INTEGER[] AS heads, []::BIGINT[] AS others, []::VARCHAR[] AS named, []::INTEGER[] AS homes FROM lists
  UNION ALL SELECT seed_id, round, k + 1,
    CASE WHEN g IS NULL THEN list_append(heads, k + 1) ELSE list_transform(heads, lambda h, i: CASE WHEN i = g AND (pops[k + 1] > pops[h] OR (pops[k + 1] = pops[h] AND (imps[k + 1] < imps[h] OR (imps[k + 1] = imps[h] AND ids[k + 1] < ids[h])))) THEN k + 1 ELSE h END) END,
    CASE WHEN g IS NULL THEN list_append(others, 0) ELSE list_transform(others, lambda n, i: CASE WHEN i = g THEN n + 1 ELSE n END) END,
    CASE WHEN keys[k + 1] IS NULL OR list_contains(named, keys[k + 1]) THEN named ELSE list_append(named, keys[k + 1]) END,
    CASE WHEN keys[k + 1] IS NULL OR list_contains(named, keys[k + 1]) THEN homes ELSE list_append(homes, CAST(coalesce(g, len(heads) + 1) AS INTEGER)) END
  FROM (SELECT walk.*, lists.* EXCLUDE (seed_id, round), coalesce(homes[nullif(list_position(named, keys[k + 1]), 0)], list_filter(range(1, len(heads) + 1), lambda i: list_cosine_similarity(units[k + 1], units[heads[i]]) >= 0.999)[1]) AS g
    FROM walk JOIN lists USING (seed_id, round) WHERE k < len(ids) AND len(heads) < {TOP})),
ended AS (SELECT seed_id, round, max(k) AS k FROM walk GROUP BY ALL),
final AS (SELECT walk.*, lists.* EXCLUDE (seed_id, round) FROM walk JOIN ended USING (seed_id, round, k) JOIN lists USING (seed_id, round)),
kept AS (SELECT seed_id, round, k, len(heads) AS found, unnest(range(1, len(heads) + 1)) AS position, unnest(list_transform(heads, lambda h: ids[h])) AS id, unnest(list_transform(heads, lambda h: ranks[h])) AS rank, unnest(list_transform(heads, lambda h: scores[h])) AS score, unnest(others) AS collapsed FROM final)"""


WINDOWS = similarity.overfetch(TOP)
#: Content alone needs one pass: a round's first rows are those of the next.
ROUND_SQL = "CAST(CASE " + " ".join(f"WHEN kept.k <= {w} THEN {n}" for n, w in enumerate(WINDOWS, 1)) + " END AS BIGINT)"
CONTENT_SQL = P.replace("WITH ", "WITH RECURSIVE ", 1) + f", {ranked_sql(BOOSTED)}, near AS (SELECT *, 1 AS round FROM r WHERE rank <= {WINDOW}), {greedy_sql('near')}"


@query(f"{CONTENT_SQL} SELECT seed_id, id, rank, score, collapsed, position, {ROUND_SQL} AS round FROM kept")
def collapse_greedy(spark, d):
    i = index(spark, d)
    return recommend.collapse(similarity.neighbours(seeds(i), i, WINDOW, "boost"), TOP)


def told(frame):
    """The explanation and the warnings as text."""
    return frame.withColumn("reasons", F.array_join(F.transform("reasons", lambda x: x["dimension"].cast("string")), ",")).withColumn("warnings", F.array_join("warnings", ","))


WHY_SQL = """why AS (SELECT seed_id, id, string_agg(CAST(dimension AS VARCHAR), ',' ORDER BY n) AS reasons FROM (SELECT *, row_number() OVER (PARTITION BY seed_id, id ORDER BY share DESC, dimension) AS n FROM
  (SELECT seed_id, id, x - 1 AS dimension, round(unit[x] * seed_unit[x] / sqrt(list_inner_product(unit, unit) * list_inner_product(seed_unit, seed_unit)), 9) AS share FROM (SELECT DISTINCT seed_id, id FROM kept) JOIN pairs USING (seed_id, id), range(1, 65) t(x))) WHERE n <= 3 GROUP BY ALL)"""


def recommended_sql(signal: str, co_count: str, jaccard: str, rounds: str, source: str, missing: str) -> str:
    near = f"(n.rank <= {WINDOW})"
    return f"""SELECT seed_id, position, id, kept.score AS score, CASE WHEN {near} THEN n.cosine ELSE 0 END AS cosine, CASE WHEN {near} THEN round(n.score - n.cosine, 9) ELSE 0 END AS genre_boost, {signal} AS signal, {co_count} AS co_count, {jaccard} AS jaccard,
 n.is_imputed AS is_imputed, CASE WHEN {near} AND n.genre = n.seed_genre THEN n.genre END AS shared_genre, collapsed, kept.rank AS rank, {rounds} AS round, CASE WHEN {near} THEN reasons ELSE '' END AS reasons,
 concat_ws(',', CASE WHEN n.seed_imputed THEN 'seed_imputed' END, CASE WHEN n.seed_imputed OR n.seed_genre IS NULL THEN 'genre_fallback' END, {missing}, CASE WHEN bool_or(n.is_imputed) OVER (PARTITION BY seed_id) THEN 'imputed_items' END) AS warnings
 FROM kept JOIN r n USING (seed_id, id) LEFT JOIN why USING (seed_id, id) {source}"""


@query(f"{CONTENT_SQL}, {WHY_SQL} " + recommended_sql("CAST(NULL AS VARCHAR)", "CAST(0 AS BIGINT)", "0e0", ROUND_SQL, "", "CAST(NULL AS VARCHAR)"))
def recommend_content(spark, d):
    i = index(spark, d)
    return told(recommend.recommend(seeds(i), i, TOP))


EDGES_SQL = """b AS (SELECT DISTINCT l_orderkey AS basket, l_partkey AS item FROM lineitem), q AS (SELECT x.item AS seed_id, y.item AS id, count(*) AS co_count FROM b x JOIN b y ON x.basket = y.basket AND x.item <> y.item WHERE x.item IN (SELECT id FROM items WHERE id % 100 = 0) GROUP BY ALL HAVING count(*) >= 2),
t AS (SELECT item, count(*) AS total FROM b GROUP BY 1), c AS (SELECT seed_id, id, co_count, round(co_count / (l.total + h.total - co_count), 9) AS jaccard FROM q JOIN t l ON l.item = seed_id JOIN t h ON h.item = id)"""
BLEND_SQL = P.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {ranked_sql(BOOSTED)}, {EDGES_SQL}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY jaccard DESC, co_count DESC, id) AS place FROM c) WHERE place <= {WINDOW}),
turns AS (SELECT * FROM (VALUES {', '.join(f'({n}, {w})' for n, w in enumerate(WINDOWS, 1))}) v(round, width)),
w AS (SELECT turns.round, seed_id, id, score FROM r, turns WHERE rank <= width), cw AS (SELECT turns.round, seed_id, id, co_count, jaccard FROM best, turns WHERE place <= width), m AS (SELECT round, seed_id, min(score) AS lo, max(score) AS hi FROM w GROUP BY ALL),
n AS (SELECT w.*, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END AS content FROM w JOIN m USING (round, seed_id)), has AS (SELECT DISTINCT seed_id, true AS blends FROM best),
mixed AS (SELECT round, seed_id, id, coalesce(co_count, 0) AS co_count, coalesce(jaccard, 0) AS jaccard, CASE WHEN content IS NOT NULL AND jaccard IS NOT NULL THEN 'blended' WHEN jaccard IS NOT NULL THEN 'collaborative' END AS signal,
  CASE WHEN blends THEN round(0.65 * coalesce(content, 0) + 0.35 * coalesce(jaccard, 0), 9) ELSE score END AS score FROM n FULL JOIN cw USING (round, seed_id, id) LEFT JOIN has USING (seed_id)),
placed AS (SELECT mixed.*, row_number() OVER (PARTITION BY round, seed_id ORDER BY mixed.score DESC, jaccard DESC, mixed.id) AS rank, key, popularity, is_imputed, unit FROM mixed LEFT JOIN facts USING (id)), {greedy_sql('placed')},
sizes AS (SELECT seed_id, greatest(a.n, coalesce(e.n, 0)) AS available FROM (SELECT seed_id, count(*) AS n FROM r WHERE rank <= {WINDOW} GROUP BY 1) a LEFT JOIN (SELECT seed_id, count(*) AS n FROM best GROUP BY 1) e USING (seed_id)),
pick AS (SELECT f.seed_id, min(f.round) AS round FROM (SELECT seed_id, round, len(heads) AS found FROM final) f JOIN turns USING (round) JOIN sizes USING (seed_id) WHERE found >= {TOP} OR available <= width OR round = {len(WINDOWS)} GROUP BY 1)"""


@query(f"{BLEND_SQL}, {WHY_SQL} " + recommended_sql("mixed.signal", "mixed.co_count", "mixed.jaccard", "CAST(kept.round AS BIGINT)", "JOIN pick USING (seed_id, round) JOIN mixed USING (seed_id, id, round) LEFT JOIN has USING (seed_id)", "CASE WHEN blends IS NULL THEN 'no_collaborative' END"))
def recommend_blend(spark, d):
    i = index(spark, d)
    return told(recommend.recommend(seeds(i), i, TOP, edges=edges_of_seeds(spark, d)))


@query("""WITH g AS (SELECT p_name AS key, count(*) AS n, count(*) FILTER (p_partkey % 7 = 0) AS i FROM part WHERE p_partkey % 17 <> 0 GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS eligible, CAST(sum(i) AS BIGINT) AS imputed, count(*) FILTER (n > 1) AS groups, CAST(sum(n) FILTER (n > 1) AS BIGINT) AS members, CAST(sum(n * (n - 1) // 2) FILTER (n > 1) AS BIGINT) AS pairs, max(n) FILTER (n > 1) AS largest FROM g""")
def dup_census(spark, d):
    rows = tracks(spark, d).select(F.col("name").alias("key"), F.col("audio_features").isNotNull().alias("eligible"), F.coalesce("audio_features.IsImputed", F.lit(False)).alias("is_imputed"))
    return evaluation.duplicate_census(rows)


@query(f"""{P}, {ranked_sql(BOOSTED)}, s AS (SELECT seed_id, CASE WHEN any_value(seed_imputed) THEN NULL ELSE any_value(seed_genre) END AS g, count(*) AS n, count(*) FILTER (genre = seed_genre) AS same FROM r WHERE rank <= {TOP} GROUP BY 1)
SELECT count(*) FILTER (g IS NOT NULL) AS seeds_evaluated, count(*) FILTER (g IS NULL) AS without_genre, CAST(0 AS BIGINT) AS without_list, round(avg(same / n) FILTER (g IS NOT NULL), 12) AS mean, round(stddev_pop(same / n) FILTER (g IS NOT NULL), 12) AS deviation,
 round(stddev_pop(same / n) FILTER (g IS NOT NULL) / sqrt(count(g)), 12) AS standard_error, round(count(*) FILTER (g IS NOT NULL AND same = n) / count(g), 12) AS saturation FROM s""")
def eval_coherence(spark, d):
    i = index(spark, d)
    asked = seeds(i).select(F.col("id").alias("seed_id"), F.when(~F.col("is_imputed"), F.col("genre")).alias("seed_genre"))
    return evaluation.coherence(asked, similarity.neighbours(seeds(i), i, TOP, "boost").select("seed_id", "genre", "is_imputed"))


@query(f"""{P}, {ranked_sql()}, k AS (SELECT key, count(*) - 1 AS siblings FROM items GROUP BY 1 HAVING count(*) > 1), a AS (SELECT id AS seed_id, key AS seed_key, siblings FROM items JOIN k USING (key) WHERE id % 100 = 0),
s AS (SELECT a.seed_id, any_value(siblings) AS siblings, count(rank) AS n, count(*) FILTER (key = seed_key) AS hits, min(rank) FILTER (key = seed_key) AS first_rank, sum(cosine) FILTER (key = seed_key) AS cosines FROM a LEFT JOIN r ON r.seed_id = a.seed_id AND rank <= 100 GROUP BY 1)
SELECT count(*) AS seeds_evaluated, round(avg(hits / least(siblings, 100)), 12) AS recall, round(avg(CASE WHEN hits > 0 THEN 1e0 ELSE 0 END), 12) AS hit_rate, round(coalesce(avg(first_rank), 0), 12) AS mean_first_rank, round(coalesce(sum(cosines) / nullif(sum(hits), 0), 0), 12) AS sibling_cosine,
 count(*) FILTER (n > 0 AND hits = n) AS fully_duplicated, count(*) FILTER (hits >= 2) AS redundant, count(*) FILTER (n < 100) AS incomplete FROM s""")
def eval_duplicates(spark, d):
    i = index(spark, d)
    groups = i.groupBy("key").agg((F.count("*") - 1).alias("siblings")).where("siblings > 0")
    asked = seeds(i).join(groups, "key").select(F.col("id").alias("seed_id"), F.col("key").alias("seed_key"), "siblings")
    return evaluation.duplicates(asked, similarity.neighbours(seeds(i), i, 100).select("seed_id", "key", "rank", "cosine"), 100)


@query(f"{CONTENT_SQL}, e AS (SELECT seed_id, max({ROUND_SQL}) AS round, count(*) AS items FROM kept GROUP BY 1) SELECT round, items, count(*) AS seeds FROM e GROUP BY ALL")
def eval_result_size(spark, d):
    return evaluation.list_sizes(recommend_content(spark, d))


#: Works of three items, and every fifth of twelve.
WORKS_SQL = "w AS (SELECT vec_id AS id, CASE WHEN vec_id // 12 % 5 = 0 THEN 'long work ' || (vec_id // 12) ELSE 'work ' || (vec_id // 3) END AS key FROM embeddings)"


def works(index):
    long = F.floor(F.col("id") / 12)
    return index.withColumn("key", F.when(long % 5 == 0, F.concat(F.lit("long work "), long.cast("string"))).otherwise(F.concat(F.lit("work "), F.floor(F.col("id") / 3).cast("string"))))


@query(f"""WITH {WORKS_SQL}, g AS (SELECT key, count(*) AS size FROM w GROUP BY 1 HAVING count(*) > 1), s AS (SELECT * FROM g ORDER BY md5('{evaluation.SAMPLING}' || key), key LIMIT 20),
m AS (SELECT key, id, size, row_number() OVER (PARTITION BY key ORDER BY id) AS place FROM w JOIN s USING (key)), l AS (SELECT key, id, size, row_number() OVER (PARTITION BY key ORDER BY id) AS place FROM w JOIN g USING (key) WHERE size >= 11)
SELECT 'group' AS population, key, id, size, place FROM m WHERE place <= 8 UNION ALL SELECT 'leader', key, id, size, place FROM l WHERE place = 1 UNION ALL SELECT 'member', key, id, size, place FROM l
 UNION ALL SELECT 'seed', NULL, id, NULL, NULL FROM (SELECT id FROM w ORDER BY md5('{evaluation.SAMPLING}' || id), id LIMIT 30)""")
def eval_populations(spark, d):
    """The samples of an evaluation: seeds, capped groups, leaders and members of large groups."""
    i = works(table(spark, d, "embeddings").select(F.col("vec_id").alias("id")))
    capped = evaluation.group_members(i, groups=20, most=evaluation.GROUP_MEMBERS).withColumn("population", F.lit("group"))
    large = evaluation.group_members(i, TOP + 1)
    seeds_ = evaluation.sampled_seeds(i, size=30).select(F.lit("seed").alias("population"), F.col("seed_id").alias("id"))
    found = capped.unionByName(large.where("place = 1").withColumn("population", F.lit("leader"))).unionByName(large.withColumn("population", F.lit("member")))
    return found.unionByName(seeds_, allowMissingColumns=True).select("population", "key", "id", "size", "place")


@query()
def recommender_gate(spark, d):
    """Which of the gate's thresholds the recommendations over the table miss, each over the seeds that it was set on."""
    i = sinks.written(works(index(spark, d)), "index")
    drawn = i.join(evaluation.sampled_seeds(i).select(F.col("seed_id").alias("id")), "id", "left_semi")
    plain, boosted = (similarity.neighbours(drawn, i, TOP, mode) for mode in ("off", "boost"))
    asked = drawn.select(F.col("id").alias("seed_id"), F.when(~F.col("is_imputed"), F.col("genre")).alias("seed_genre"))
    groups = evaluation.group_members(i, groups=evaluation.GROUPS, most=evaluation.GROUP_MEMBERS).select(F.col("id").alias("seed_id"), F.col("key").alias("seed_key"), (F.col("size") - 1).alias("siblings"))
    near = similarity.neighbours(i.join(groups.select(F.col("seed_id").alias("id")), "id", "left_semi"), i, 100).select("seed_id", "key", "rank", "cosine")
    leaders, members = evaluation.large_groups(i, TOP)
    lists = sinks.written(recommend.recommend(i.join(members.select(F.col("seed_id").alias("id")), "id", "left_semi"), i, TOP), "lists")
    named = lists.join(i.select("id", "key"), "id").select("seed_id", "key", "rank", "cosine")

    def coherence(found):
        return evaluation.coherence(asked, found.select("seed_id", "genre", "is_imputed")).first().asDict() | evaluation.self_hits(found).first().asDict()

    missed = evaluation.judged(
        evaluation.Measurement(coherence(plain), "sample", "off"),
        evaluation.Measurement(coherence(boosted), "sample", "boost"),
        evaluation.Measurement(evaluation.duplicates(groups, near, 100).first().asDict(), "sample", "off"),
        evaluation.Measurement(evaluation.duplicates(leaders, named, TOP).first().asDict(), evaluation.LEADERS, dedupe=True),
        evaluation.Measurement(evaluation.sizes(lists, members, TOP).first().asDict(), evaluation.MEMBERS),
    )
    return spark.createDataFrame([(name, name in missed) for name in evaluation.GATE], "threshold string, missed boolean")


@query("""SELECT p_partkey AS id, p_name AS track_name, p_size AS popularity, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END AS tempo, p_partkey % 3 = 0 AS explicit FROM part""")
def src_csv_catalog(spark, d):
    """The table goes out as a CSV file with holes and bad numbers and is read by the typed reader."""
    path = shared_folder(spark, "catalog")
    names = [f.split()[0] for f in catalog_csv.CATALOG.split(", ")]
    own = {
        "row_index": F.col("p_partkey").cast("string"), "track_id": F.concat(F.lit("t"), F.col("p_partkey").cast("string")), "track_name": F.col("p_name"), "album_name": F.lit("  "), "popularity": F.col("p_size").cast("string"),
        "tempo": F.when(F.col("p_partkey") % 8 == 0, "n/a").when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_retailprice").cast("string")), "explicit": F.when(F.col("p_partkey") % 3 == 0, "True").when(F.col("p_partkey") % 3 == 1, "False").otherwise(""),
    }
    table(spark, d, "part").select(*(own.get(n, F.lit("")).alias(n) for n in names)).write.csv(path, header=True, quote='"', escape='"', emptyValue="")
    read = catalog_csv.read_catalog(spark, path)
    return read.select(F.expr("CAST(substr(track_id, 2) AS BIGINT)").alias("id"), "track_name", "popularity", "tempo", "explicit")


@query("SELECT s_suppkey AS id, 'g' || s_nationkey AS genre, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS energy FROM supplier")
def src_csv_features(spark, d):
    path = shared_folder(spark, "features")
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit(" g"), F.col("s_nationkey").cast("string"), F.lit(" ")).alias("genre"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal").cast("string")).otherwise("bad").alias("energy"))
    rows.write.csv(path, header=True)
    return catalog_csv.read_features(spark, path, "id long, genre string, energy double")


@query("SELECT 'u' || c_custkey AS user_id, c_mktsegment AS artist, 'She said \"' || c_name || '\"' AS track, 'list ' || c_nationkey AS playlist FROM customer WHERE c_custkey % 6 <> 0")
def src_csv_playlist(spark, d):
    path = shared_folder(spark, "playlists")
    id_ = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        F.when(id_ % 6 != 0, F.concat(F.lit("u"), id_.cast("string"))).otherwise("").alias("user_id"), F.col("c_mktsegment").alias(" artistname"), F.concat(F.lit('She said "'), "c_name", F.lit('"')).alias(" trackname"), F.concat(F.lit("list "), F.col("c_nationkey").cast("string")).alias(" playlistname")
    )
    rows.write.csv(path, header=True, quoteAll=True, escape="\\", emptyValue="")
    return catalog_csv.read_playlists(spark, path)


def offline_lookup(ids: list) -> rest.Answer:
    """A look-up service that needs no network; it doesn't know every seventh id."""
    return 200, {}, [{"id": k, "name": f"artist {k}"} if k % 7 else None for k in ids]


@query("SELECT s_suppkey AS id, 'artist ' || s_suppkey AS name FROM supplier WHERE s_suppkey % 7 <> 0")
def src_rest_lookup(spark, d):
    ids = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return rest.look_up(ids.unionByName(ids), "id", offline_lookup, StructType().add("id", "long").add("name", "string"))


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0")
def sink_rebuild(spark, d):
    """A table written twice: the second time replaces the first."""
    path = shared_folder(spark, "rebuilt")
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    sinks.rebuild(rows, path)
    sinks.rebuild(rows.where("id % 2 = 0"), path)
    return spark.read.parquet(path)


@query("""SELECT features, count(*) FILTER (p_partkey % 17 <> 0 AND p_partkey % 19 <> 0 AND (NOT g OR p_partkey % 11 <> 0)) AS complete FROM part, (VALUES ('base', false), ('base+A', false), ('base+B', true), ('base+A+B', true)) v(features, g) GROUP BY 1""")
def feature_sets(spark, d):
    """Every combination of blocks, and for how many tracks all of its columns are known."""
    flat = tracks(spark, d).select("popularity", "duration_ms", (F.col("id") % 3 == 0).alias("explicit"), "audio_features.*")
    named = flat.withColumnsRenamed({c: c.lower() for c in flat.columns} | {"TimeSignature": "time_signature"})
    sets = {"+".join(("base", *s)): sum(ml.feature_set(s), []) for s in dataset.block_sets(list(ml.BLOCKS))}
    row = named.agg(*(F.count_if(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))).alias(name) for name, columns in sets.items()))
    return row.unpivot([], list(sets), "features", "complete")


def training(spark, d):
    """Complete measured tracks with all columns that the models' blocks need."""
    flat = tracks(spark, d).select("id", F.col("popularity").cast("double").alias("popularity"), F.col("duration_ms").cast("double").alias("duration_ms"), (F.col("id") % 3 == 0).cast("double").alias("explicit"), "audio_features.*")
    named = flat.withColumnsRenamed({c: c.lower() for c in flat.columns} | {"TimeSignature": "time_signature", "IsImputed": "is_imputed"})
    complete = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in ml.BASE))
    kept = named.where(complete & ~F.coalesce("is_imputed", F.lit(False)))
    return kept.withColumn("mode", F.col("mode").cast("double")).withColumn("test", dataset.is_test(F.col("id").cast("string")))


#: Tracks from which training rows come, for each file of them; it depends on the table alone, not on the cluster.
ROWS_OF_A_FILE = 20_000
#: Trees of each candidate model: as many as the catalogue's own trainer grows, which leaves the number at its default.
TREES = 100


@query()
def model_champion(spark, d):
    """The base and all combinations of blocks, fitted and measured, and the elected one."""
    # the table may lie in one large block, which one task reads: written once in many files, for the passes of all models
    files = max(1, -(-table(spark, d, "part").count() // ROWS_OF_A_FILE))
    rows = sinks.written(training(spark, d).repartition(files, "id"), "training")
    found = ml.elected(rows.where("NOT test"), rows.where("test"), "popularity", trees=TREES)
    return spark.createDataFrame([(x["features"], x["mae"], x["approved"], x["champion"]) for x in found], "features string, mae double, approved boolean, champion boolean")


def learnable(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size"), "l_partkey")
    return rows.groupBy("l_partkey").agg(F.first("p_type").alias("genre"), F.first("p_size").cast("double").alias("size"), F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_extendedprice").alias("popularity")).select(
        "l_partkey", "genre", "size", "quantity", "discount", (F.col("popularity") / 1000).alias("popularity"), (F.col("l_partkey") % 7 == 0).alias("is_imputed"), dataset.is_test(F.col("l_partkey").cast("string")).alias("test")
    )


NUMERIC = ["size", "quantity", "discount"]


@query()
def model_gate(spark, d):
    """Trees, linear and mean baseline on the seeded split, with the gate's decision."""
    rows = sinks.written(learnable(spark, d), "learnable")
    train, test = rows.where("NOT test"), rows.where("test")
    baseline = dataset.mean_baseline(train, test, "popularity").withColumn("model", F.lit("mean"))
    found = {"trees": ml.pipeline(NUMERIC, ["genre"], "popularity", trees=10), "linear": ml.pipeline(NUMERIC, ["genre"], "popularity", linear=True)}
    out = baseline
    for name, pipeline in found.items():
        out = out.unionByName(dataset.regression_metrics(pipeline.fit(train).transform(test), "popularity", "prediction").withColumn("model", F.lit(name)))
    least = baseline.select(F.col("mae").alias("base"))
    return out.crossJoin(F.broadcast(least)).select("model", "n", "mae", "rmse", "r2", (F.col("mae") <= 0.95 * F.col("base")).alias("passes"))


@query()
def model_importance(spark, d):
    """Loss of R² and rise of the error when a slot's values change places, five times each, rolled up by feature."""
    rows = sinks.written(learnable(spark, d), "learnable")
    model = ml.pipeline(NUMERIC, ["genre"], "popularity", linear=True).fit(rows.where("NOT test"))
    return dataset.importance_rollup(ml.permutation_importance(model, rows.where("test"), None, "popularity", "l_partkey"))


@query()
def model_cross_validation(spark, d):
    mean, deviation = ml.cross_validated(sinks.written(learnable(spark, d), "learnable"), lambda: ml.pipeline(NUMERIC, ["genre"], "popularity", linear=True), "popularity", "l_partkey")
    return spark.createDataFrame([(5, round(mean, 6), round(deviation, 6))], "folds int, r2_mean double, r2_deviation double")


@query()
def model_scoring(spark, d):
    """Every row scored by trees, held to 0..100, with its warnings."""
    rows = learnable(spark, d)
    model = ml.pipeline(NUMERIC, ["genre"], "popularity", trees=5).fit(rows)
    return ml.scored(model, rows).select("l_partkey", F.round("prediction", 6).alias("prediction"), "clamped", F.array_join("warnings", ",").alias("warnings"))
