"""Registered queries, each over whole driver tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels, text, urls
from ..functions import vectors as v
from ..operators import blocks, catalog, cluster, distance, folded, minsize, neighbours, rank, rounds, scores, search
from ..operators import pixels as px
from ..operators.keep import keep
from ..sources import tables
from ..sources.cards import CardRules, extract_cards
from ..sources.scoring import batch_score
from ..streaming.backfill import backfill as fill
from . import files, inputs, workloads

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PRODUCTS = """p0 AS (SELECT p_partkey AS key, p_brand AS brand, p_name AS product_name, CAST(floor(p_retailprice) AS BIGINT) AS n FROM part),
raw AS (SELECT key, brand, product_name, CASE key % 5 WHEN 0 THEN n || ' €' WHEN 1 THEN '€ ' || n WHEN 2 THEN '€' || n
  WHEN 3 THEN (n * 10 // 1000) || '.' || lpad(CAST(n * 10 % 1000 AS VARCHAR), 3, '0') || ' €' ELSE 'N/A' END AS price_raw FROM p0),
products AS (SELECT *, TRY_CAST(nullif(regexp_replace(price_raw, '[^0-9]', '', 'g'), '') AS BIGINT) AS price_eur FROM raw)"""
POINTS = "points AS (SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS vec, label AS cluster FROM embeddings)"
CELLS = POINTS + ", cells AS (SELECT key, cluster, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS i FROM points)"
CENTRES = CELLS + """, ci AS (SELECT cluster, i, avg(x) AS x, count(*) AS n FROM cells WHERE cluster >= 0 GROUP BY cluster, i),
centres AS (SELECT cluster, max(n) AS n, list(x ORDER BY i) AS centroid FROM ci GROUP BY cluster)"""
PAIRS = POINTS + """, pairs AS (SELECT a.key AS k1, b.key AS k2, a.cluster AS c1, b.cluster AS c2, list_distance(a.vec, b.vec) AS d
  FROM points a JOIN points b ON a.key <> b.key)"""
SPREAD = CENTRES + """, spread AS (SELECT cluster, any_value(c.n) AS n, any_value(c.centroid) AS centroid, sum(pow(list_distance(p.vec, c.centroid), 2)) AS within,
  avg(list_distance(p.vec, c.centroid)) AS mean_dist FROM points p JOIN centres c USING (cluster) GROUP BY cluster)"""
SEPARATION = PAIRS + """, one AS (SELECT c1, c2, avg(d) AS sep FROM pairs WHERE c1 < c2 GROUP BY c1, c2), hf AS (SELECT * FROM one UNION ALL SELECT c2, c1, sep FROM one),
sep AS (SELECT c1 AS cluster, min(sep) AS min_sep, arg_min(c2, sep) AS min_pair, avg(sep) AS mean_sep, max(sep) AS max_sep, arg_max(c2, sep) AS max_pair FROM hf GROUP BY c1)"""
SIL = """, m AS (SELECT k1, c1, c2, avg(d) AS d FROM pairs WHERE c1 >= 0 AND c2 >= 0 GROUP BY k1, c1, c2),
ab AS (SELECT k1, c1, min(CASE WHEN c1 = c2 THEN d END) AS a, min(CASE WHEN c1 <> c2 THEN d END) AS b FROM m GROUP BY k1, c1),
sil AS (SELECT avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM ab)"""
CH = """, ss AS (SELECT i, sum(n * x) AS s1, sum(n * x * x) AS s2, sum(n) AS total FROM ci GROUP BY i), bw AS (SELECT sum(s2 - s1 * s1 / total) AS between_ss FROM ss),
ch AS (SELECT between_ss * (sum(n) - count(*)) / (sum(within) * (count(*) - 1)) AS ch FROM spread, bw GROUP BY between_ss)"""
DB = """, rr AS (SELECT a.cluster, max((a.mean_dist + b.mean_dist) / list_distance(a.centroid, b.centroid)) AS r FROM spread a JOIN spread b ON a.cluster <> b.cluster GROUP BY a.cluster),
db AS (SELECT avg(r) AS db FROM rr)"""
PIXELS = """g AS (SELECT vec_id AS stem, unnest(range(64)) AS i, embedding FROM embeddings),
px AS (SELECT stem, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, """ + ", ".join(f"CAST(least(255, greatest(0, floor((CAST(embedding[CAST((i + {s}) % 64 AS INTEGER) + 1] AS DOUBLE) + 0.5) * 255))) AS INTEGER) AS {c}" for s, c in enumerate("rgb")) + " FROM g)"
RUNS = """g AS (SELECT p_brand AS algo, CAST(p_size AS BIGINT) AS n_clusters, avg(p_retailprice) AS m, count(*) AS c, min(p_retailprice) AS lo FROM part GROUP BY ALL),
runs AS (SELECT algo || '-' || lpad(CAST(n_clusters AS VARCHAR), 2, '0') AS run_id, algo, n_clusters, CASE WHEN algo NOT LIKE '%5' AND n_clusters % 7 <> 0 THEN round(m / 2000, 6) END AS silhouette,
  CASE WHEN algo NOT LIKE '%5' AND n_clusters % 3 <> 0 THEN CAST(c AS DOUBLE) END AS ch, CASE WHEN algo NOT LIKE '%5' THEN round(lo / 1000, 6) END AS db FROM g)"""
SRCSET = """e AS (SELECT page_id, url AS u, CASE page_id % 6 WHEN 0 THEN ['?w=320 320w', '?w=640 640w', '?w=480 480w'] WHEN 1 THEN ['?a 1x', '?b 2x'] WHEN 2 THEN [''] WHEN 3 THEN ['?a bad', '?b 2x']
  WHEN 4 THEN ['?a 300w', '?b 300w'] ELSE ['?a 300w', '?b 2x', '?c 100w', '?d'] END AS parts FROM pages),
s AS (SELECT page_id, u || unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS i, len(parts) AS n FROM e),
t AS (SELECT page_id, i, n, regexp_extract(part, '^(\\S+)', 1) AS url, nullif(regexp_extract(part, '^\\S+\\s+(\\S+)$', 1), '') AS mark FROM s)"""
SMALL = POINTS + ", sc AS (SELECT key, vec, CASE WHEN key % 10 = 0 THEN 100 + CAST(floor(key / 10) AS INTEGER) % 40 ELSE cluster END AS cluster FROM points), big AS (SELECT cluster FROM sc GROUP BY cluster HAVING count(*) >= 6)"


def r6(x: Column | str, digits: int = 6) -> Column:
    return F.round(x, digits) + 0.0  # no negative zero


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- files: driver tables written in the sources' formats and read back ------------------------------------------------


@query("read_products", f"WITH {PRODUCTS} SELECT chr(CAST(65 + key % 5 AS INTEGER)) AS brand, 'img/x.' || key || '.jpg' AS product_name, 'x.' || key AS join_key, price_raw, price_eur FROM products WHERE key % 5 < 4")
def _(spark, sf):
    return tables.read_products(spark, files.product_folders(spark, sf))


@query("list_images", "SELECT 'x' AS brand, CAST(vec_id AS VARCHAR) AS stem, 'png' AS suffix FROM embeddings")
def _(spark, sf):
    return tables.list_images(spark, "x", files.image_folder(spark, sf)).drop("path")


@query("read_pixels", f"WITH {PIXELS} SELECT CAST(stem AS VARCHAR) AS stem, y, x, r, g, b FROM px")
def _(spark, sf):
    return tables.read_pixels(spark, files.image_folder(spark, sf))


@query("load_embeddings", f"WITH {CELLS} SELECT CAST(key AS VARCHAR) AS key, i, round(x, 6) + 0.0 AS x FROM cells")
def _(spark, sf):
    return _long(tables.load_embeddings(spark, files.embeddings_csv(spark, sf, "path")))


@query("load_embeddings_unnamed", f"WITH {CELLS}, n AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS n FROM points) SELECT CAST(n AS VARCHAR) AS key, i, round(x, 6) + 0.0 AS x FROM cells JOIN n USING (key)")
def _(spark, sf):
    return _long(tables.load_embeddings(spark, files.embeddings_csv(spark, sf, None)))


@query("load_feature_tables", f"WITH {CELLS} SELECT CAST(key AS VARCHAR) AS key, i, round(x, 6) + 0.0 AS x, 2 AS n FROM cells")
def _(spark, sf):
    both = tables.load_feature_tables(spark, [files.embeddings_csv(spark, sf, "imagen", name) for name in "ab"])
    return _long(both).groupBy("key", "i", "x").agg(F.count("*").cast("int").alias("n"))


@query("load_assignments", "SELECT CAST(vec_id AS VARCHAR) AS path, label AS cluster FROM embeddings WHERE vec_id % 9 <> 0 AND vec_id % 11 <> 0")
def _(spark, sf):
    return tables.load_assignments(spark, files.assignments_csv(spark, sf))


@query("write_partitioned", f"WITH {PRODUCTS} SELECT key, product_name, brand FROM products")
def _(spark, sf):
    path = files.scratch(spark)
    tables.write_table(inputs.products(spark, sf).select("key", "product_name", "brand"), path, by="brand")
    return spark.read.parquet(path).select("key", "product_name", "brand")


# --- prices -----------------------------------------------------------------------------------------------------------


@query("price_clean", f"WITH {PRODUCTS} SELECT key, price_raw, price_eur FROM products WHERE price_eur IS NOT NULL")
def _(spark, sf):
    return catalog.priced(inputs.products(spark, sf)).select("key", "price_raw", "price_eur")


@query("price_clean_dotted", f"WITH {PRODUCTS} SELECT key, price_raw, TRY_CAST(nullif(regexp_replace(price_raw, '[^0-9.]', '', 'g'), '') AS DOUBLE) AS price FROM raw")
def _(spark, sf):
    return inputs.raw_products(spark, sf).select("key", "price_raw", text.price_dotted(F.col("price_raw")).alias("price"))


@query("price_range", f"WITH {PRODUCTS} SELECT key, brand, price_eur FROM products WHERE price_eur BETWEEN 910 AND 9500 AND brand IN ('Brand#11', 'Brand#12', 'Brand#23')")
def _(spark, sf):
    return catalog.in_range(inputs.products(spark, sf), 910, 9500, ["Brand#11", "Brand#12", "Brand#23"]).select("key", "brand", "price_eur")


@query("brand_profile", f"WITH {PRODUCTS} SELECT brand, count(*) AS n_rows, count(price_eur) AS n_priced, min(price_eur) AS min_price, max(price_eur) AS max_price, count(*) FILTER (price_eur BETWEEN 910 AND 9500) AS n_in_range FROM products GROUP BY brand")
def _(spark, sf):
    return catalog.brand_profile(inputs.products(spark, sf), 910, 9500)


def _assigned(spark, sf):
    return catalog.assigned_prices(inputs.points(spark, sf).select("key", "cluster"), catalog.priced(inputs.products(spark, sf)), "key")


ASSIGNED = f"{PRODUCTS}, {POINTS}, j AS (SELECT * FROM products JOIN points USING (key) WHERE price_eur IS NOT NULL)"


@query("cluster_price_stats", f"WITH {ASSIGNED} SELECT cluster, count(*) AS n, round(avg(price_eur), 2) AS mean_price, min(price_eur) AS min_price, max(price_eur) AS max_price FROM j GROUP BY cluster")
def _(spark, sf):
    return catalog.price_stats(_assigned(spark, sf), ["cluster"])


@query("brand_cluster_premium", f"""WITH {ASSIGNED}, s AS (SELECT brand, cluster, count(*) AS n, sum(price_eur) AS total, min(price_eur) AS min_price, max(price_eur) AS max_price FROM j GROUP BY brand, cluster)
SELECT brand, cluster, n, round(total / n, 2) AS mean_price, min_price, max_price, round((total / n) / (sum(total) OVER w / sum(n) OVER w), 4) AS premium FROM s WINDOW w AS (PARTITION BY brand)""")
def _(spark, sf):
    return catalog.price_premium(_assigned(spark, sf))


@query("price_rollup", f"WITH {ASSIGNED} SELECT brand, cluster, count(*) AS n, round(avg(price_eur), 2) AS mean_price, min(price_eur) AS min_price, max(price_eur) AS max_price FROM j GROUP BY ROLLUP (brand, cluster)")
def _(spark, sf):
    return catalog.price_rollup(_assigned(spark, sf))


@query("price_intelligence", f"""WITH {ASSIGNED}, s AS (SELECT brand, cluster, count(*) AS n, sum(price_eur) AS total, min(price_eur) AS min_price, max(price_eur) AS max_price FROM j WHERE price_eur BETWEEN 910 AND 9500 GROUP BY brand, cluster)
SELECT brand, cluster, n, round(total / n, 2) AS mean_price, min_price, max_price, round((total / n) / (sum(total) OVER w / sum(n) OVER w), 4) AS premium,
  '€' || min_price || ' / €' || CAST(round(round(total / n, 2)) AS BIGINT) || ' / €' || max_price AS label, 'Cluster ' || cluster || ' (n=' || n || ')' AS title FROM s WINDOW w AS (PARTITION BY brand)""")
def _(spark, sf):
    return workloads.price_intelligence(inputs.products(spark, sf), inputs.points(spark, sf).select("key", "cluster"), 910, 9500, "key")


@query("display_text", f"""WITH {PRODUCTS} SELECT key, CASE WHEN length(product_name) > 15 THEN substr(product_name, 1, 12) || '...' ELSE product_name END AS name, coalesce('€' || price_eur, 'N/A') AS price FROM products""")
def _(spark, sf):
    return inputs.products(spark, sf).select("key", text.short_name(F.col("product_name")).alias("name"), text.price_text(F.col("price_eur")).alias("price"))


# --- joins, ids, sets -------------------------------------------------------------------------------------------------


@query("join_features", f"WITH {PRODUCTS}, {POINTS} SELECT key, brand, len(vec) AS width FROM products JOIN points USING (key)")
def _(spark, sf):
    features = inputs.points(spark, sf).select("key", F.size("vec").cast("long").alias("width"))
    return catalog.with_features(inputs.products(spark, sf), features, "key").select("key", "brand", "width")


@query("join_existing_files", f"WITH {PRODUCTS} SELECT key, price_raw FROM raw WHERE key IN (SELECT vec_id FROM embeddings)")
def _(spark, sf):
    files = inputs.points(spark, sf).select("key")
    return catalog.with_files(inputs.raw_products(spark, sf), files, ["key"]).select("key", "price_raw")


@query("backfill", "SELECT doc_id, CAST(length(text) AS BIGINT) AS feature, doc_id IN (SELECT doc_id FROM labels) AS cached FROM documents")
def _(spark, sf):
    docs = inputs.read(spark, sf, "documents").select(F.col("doc_id").alias("stem"), "text")
    known = inputs.read(spark, sf, "labels").select(F.col("doc_id").alias("stem"))
    featurise = lambda df: df.select("stem", F.length("text").cast("long").alias("feature"), F.lit(False).alias("cached"))
    cache = featurise(docs.join(known, "stem", "left_semi")).withColumn("cached", F.lit(True))
    return fill(docs, cache, featurise).withColumnRenamed("stem", "doc_id")


@query("join_by_position", f"""WITH {PRODUCTS}, a AS (SELECT CAST(page_id % 5 AS BIGINT) AS brand, url, row_number() OVER (PARTITION BY page_id % 5 ORDER BY page_id) AS idx FROM pages),
b AS (SELECT CAST(key % 5 AS BIGINT) AS brand, price_raw AS price, row_number() OVER (PARTITION BY key % 5 ORDER BY key) AS idx FROM raw) SELECT brand, idx, url, coalesce(price, 'N/A') AS price FROM a LEFT JOIN b USING (brand, idx)""")
def _(spark, sf):
    images = inputs.read(spark, sf, "pages").select((F.col("page_id") % 5).alias("brand"), "url", F.col("page_id").alias("position"))
    prices = inputs.raw_products(spark, sf).select((F.col("key") % 5).alias("brand"), F.col("price_raw").alias("price"), F.col("key").alias("position"))
    return catalog.pair_by_position(images, prices, "brand", "position").select("brand", "idx", "url", "price")


@query("last_wins", f"WITH {PRODUCTS} SELECT brand, max(key) AS key, arg_max(product_name, key) AS product_name FROM products GROUP BY brand")
def _(spark, sf):
    return catalog.one_per_key(inputs.products(spark, sf).select("brand", "key", "product_name"), ["brand"], "key")


@query("first_wins", f"WITH {PRODUCTS} SELECT brand, min(key) AS key, arg_min(product_name, key) AS product_name FROM products GROUP BY brand")
def _(spark, sf):
    return catalog.one_per_key(inputs.products(spark, sf).select("brand", "key", "product_name"), ["brand"], "key", last=False)


@query("first_seen_names", f"WITH {PRODUCTS}, f AS (SELECT product_name, min(key) AS key FROM products WHERE price_eur IS NOT NULL GROUP BY product_name) SELECT product_name, key, label AS cluster FROM f JOIN embeddings ON key = vec_id")
def _(spark, sf):
    names = catalog.one_per_key(catalog.priced(inputs.products(spark, sf)).select("product_name", "key"), ["product_name"], "key", last=False)
    return names.join(inputs.points(spark, sf).select("key", "cluster"), "key").select("product_name", "key", "cluster")


@query("dedup_capped", f"WITH {PRODUCTS} SELECT brand, min(key) AS key FROM products GROUP BY brand ORDER BY 2 LIMIT 10")
def _(spark, sf):
    return catalog.capped_first(inputs.products(spark, sf).select("brand", "key"), "brand", "key", 10)


@query("union_layouts", "SELECT p_name AS product_name, CAST(p_retailprice AS VARCHAR) AS price, CAST(NULL AS BIGINT) AS nation FROM part UNION ALL SELECT s_name, CAST(s_acctbal AS VARCHAR), s_nationkey FROM supplier")
def _(spark, sf):
    a = inputs.read(spark, sf, "part").select(F.col("p_name").alias("product_name"), F.col("p_retailprice").cast("string").alias("price"))
    b = inputs.read(spark, sf, "supplier").select(F.col("s_name").alias("product_name"), F.col("s_acctbal").cast("string").alias("price"), F.col("s_nationkey").cast("long").alias("nation"))
    return a.unionByName(b, allowMissingColumns=True)


@query("distinct_names", f"WITH {PRODUCTS} SELECT DISTINCT product_name FROM products WHERE price_eur IS NOT NULL")
def _(spark, sf):
    return catalog.priced(inputs.products(spark, sf)).select("product_name").dropDuplicates()


@query("stems", r"SELECT page_id, regexp_replace(regexp_extract('C:\img\' || url || '/a.b_' || page_id || '.v2.png', '([^/\\]*)$', 1), '\.[^.]*$', '') AS stem FROM pages")
def _(spark, sf):
    path = F.concat(F.lit("C:\\img\\"), F.col("url"), F.lit("/a.b_"), F.col("page_id").cast("string"), F.lit(".v2.png"))
    return inputs.read(spark, sf, "pages").select("page_id", text.stem(path).alias("stem"))


@query("collision_names", """WITH f AS (SELECT p_partkey AS key, p_brand || CASE WHEN p_partkey % 3 = 0 THEN '_' || (p_partkey % 17) ELSE '' END || '.jpg' AS name FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY key) - 1 AS n, name[:-5] AS body FROM f),
taken AS (SELECT DISTINCT name FROM f), most AS (SELECT name, body, max(n) AS m FROM n GROUP BY ALL HAVING max(n) > 0),
tried AS (SELECT name, body || '_' || unnest(range(1, m + 20)) || '.jpg' AS new, unnest(range(1, m + 20)) AS i FROM most),
free AS (SELECT name, new, row_number() OVER (PARTITION BY name ORDER BY i) AS n FROM tried WHERE new NOT IN (SELECT name FROM taken))
SELECT key, n.name, coalesce(new, n.name) AS unique_name FROM n LEFT JOIN free ON n.name = free.name AND n.n = free.n""")
def _(spark, sf):
    some = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("_"), (F.col("p_partkey") % 17).cast("string"))).otherwise("")
    rows = inputs.read(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.concat("p_brand", some, F.lit(".jpg")).alias("name"))
    return catalog.collision_free(rows, "name", "key")


@query("sequential_ids", f"WITH {PRODUCTS} SELECT key, brand || '_' || row_number() OVER (PARTITION BY brand ORDER BY key) AS product_id FROM products WHERE price_eur IS NOT NULL")
def _(spark, sf):
    return catalog.sequential_ids(inputs.products(spark, sf), "brand", "key", "price_eur is not null").select("key", "product_id")


@query("sequential_ids_counting", f"WITH {PRODUCTS}, n AS (SELECT key, price_eur, brand || '_' || row_number() OVER (PARTITION BY brand ORDER BY key) AS product_id FROM products) SELECT key, product_id FROM n WHERE price_eur IS NOT NULL")
def _(spark, sf):
    return catalog.sequential_ids(inputs.products(spark, sf), "brand", "key", "price_eur is not null", count_invalid=True).select("key", "product_id")


@query("first_per_cluster", f"WITH {POINTS}, n AS (SELECT key, cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY key) AS INTEGER) AS place, count(*) OVER (PARTITION BY cluster) AS size FROM points) SELECT * FROM n WHERE place <= 5")
def _(spark, sf):
    return catalog.first_per_cluster(inputs.points(spark, sf).select("key", "cluster"), 5, "key")


@query("cluster_sizes", f"WITH {POINTS}, c AS (SELECT CASE WHEN cluster = 9 THEN -1 ELSE cluster END AS cluster, count(*) AS size FROM points GROUP BY 1) SELECT cluster, size, round(size / sum(size) OVER (), 6) AS share, count(*) FILTER (cluster >= 0) OVER () AS n_clusters, CAST(sum(CASE WHEN cluster < 0 THEN size ELSE 0 END) OVER () AS BIGINT) AS n_noise, round(sum(CASE WHEN cluster < 0 THEN size ELSE 0 END) OVER () / sum(size) OVER (), 6) AS noise_frac FROM c")
def _(spark, sf):
    rows = inputs.points(spark, sf).withColumn("cluster", F.when(F.col("cluster") == 9, -1).otherwise(F.col("cluster")))
    return catalog.cluster_sizes(rows).withColumn("share", F.round("share", 6)).withColumn("noise_frac", F.round("noise_frac", 6))


# --- pages ------------------------------------------------------------------------------------------------------------

_WEIGHTS = {
    "width_or_density": "arg_max(url, w * 1000 - i) FILTER (w IS NOT NULL) FROM (SELECT *, CASE WHEN mark IS NULL THEN 1.0 ELSE TRY_CAST(regexp_extract(mark, '^([0-9.]+)[wx]$', 1) AS DOUBLE) END AS w FROM t)",
    "width": "arg_max(url, w * 1000 - i) FROM (SELECT *, coalesce(TRY_CAST(regexp_extract(mark, '^([0-9]+)w$', 1) AS DOUBLE), 0) AS w FROM t)",
    "strict": "coalesce(arg_max(url, w * 1000 - i) FILTER (w IS NOT NULL), arg_min(url, i)) FROM (SELECT *, TRY_CAST(regexp_extract(mark, '^([0-9]+)[wx]$', 1) AS DOUBLE) AS w FROM t)",
    "last": "arg_max(url, i) FROM t",
    "third": "coalesce(max(CASE WHEN i = 2 THEN url END), arg_max(url, i)) FROM t",
}


def _srcset(rule: str) -> None:
    what, _, source = _WEIGHTS[rule].partition(" FROM ")

    @query(f"srcset_{rule}", f"WITH {SRCSET} SELECT page_id, {what} AS best FROM {source} GROUP BY page_id")
    def _(spark, sf):
        return inputs.srcsets(spark, sf).select("page_id", urls.srcset_best(F.col("srcset"), rule).alias("best"))


for _rule in _WEIGHTS:
    _srcset(_rule)


@query("url_fallback", "SELECT page_id, CASE WHEN page_id % 3 = 0 AND url LIKE 'https%' THEN url || '?set' WHEN page_id % 3 <> 1 THEN url ELSE NULL END AS source FROM pages")
def _(spark, sf):
    u, n = F.col("url"), F.col("page_id") % 3
    srcset = F.when((n == 0) & u.startswith("https"), F.concat(u, F.lit("?set"))).otherwise("data:PlaceHolder")
    lazy, src = F.when(n == 2, u), F.when(n == 1, F.lit("/relative")).otherwise(u)
    return inputs.read(spark, sf, "pages").select("page_id", urls.first_source(srcset, lazy, src, u).alias("source"))


@query("url_resolve", "SELECT page_id, 'https://shop.example.com' || '/' || page_id AS a, url AS b FROM pages")
def _(spark, sf):
    host = "https://shop.example.com"
    return inputs.read(spark, sf, "pages").select("page_id", urls.resolve_url(F.concat(F.lit("/"), F.col("page_id").cast("string")), host).alias("a"), urls.resolve_url(F.col("url"), host).alias("b"))


@query("product_codes", "SELECT page_id, 'G' || page_id AS zoom, nullif(regexp_extract(regexp_replace(url, '[^A-Za-z0-9]', '', 'g'), '([A-Za-z0-9]{14})', 1), '') AS serial FROM pages")
def _(spark, sf):
    zoom = F.concat(F.lit("https://x/images/zoom/G"), F.col("page_id").cast("string"), F.lit(".jpg?sw=1"))
    bare = F.regexp_replace("url", "[^A-Za-z0-9]", "")
    return inputs.read(spark, sf, "pages").select("page_id", urls.zoom_code(zoom).alias("zoom"), urls.serial_code(bare, "http").alias("serial"))


@query("cards_from_pages", """WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '<li>.*?</li>')) AS card, generate_subscripts(regexp_extract_all(html, '<li>.*?</li>'), 1) - 1 AS position FROM pages)
SELECT page_id, CAST(position AS INTEGER) AS position, nullif(trim(regexp_extract(card, '<a[^>]*>([^<]*)</a>', 1)), '') AS name, 'N/A' AS price, nullif(trim(regexp_extract(card, 'href="([^"]*)"', 1)), '') AS image FROM c""")
def _(spark, sf):
    rules = CardRules(card="<li>.*?</li>", name="<a[^>]*>([^<]*)</a>", price="€ *([0-9.]+)", image='href="([^"]*)"')
    return extract_cards(inputs.read(spark, sf, "pages"), rules)


# --- predictions ------------------------------------------------------------------------------------------------------

_TOP = CELLS + """, p AS (SELECT key, i, exp(x - max(x) OVER (PARTITION BY key)) AS e FROM cells), q AS (SELECT key, i, e / sum(e) OVER (PARTITION BY key) AS p FROM p),
r AS (SELECT key, CASE WHEN i % 8 = 3 THEN 'Sunglass ' ELSE 'class ' END || i AS label, p, row_number() OVER (PARTITION BY key ORDER BY p DESC, i) AS n FROM q)"""


def _top(spark, sf, k=5):
    names = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.concat(F.when(i % 8 == 3, "Sunglass ").otherwise("class "), i.cast("string")))
    return inputs.points(spark, sf).select("key", labels.top_k(labels.softmax(F.col("vec")), names, k).alias("top"))


@query("top_labels", f"WITH {_TOP} SELECT key, " + ", ".join(f"max(CASE WHEN n = {i} THEN label END) AS top{i}_label, round(max(CASE WHEN n = {i} THEN p END), 6) AS top{i}_prob" for i in range(1, 6)) + " FROM r GROUP BY key")
def _(spark, sf):
    wide = labels.widen(_top(spark, sf), "top", 5)
    return wide.withColumns({f"top{i}_prob": F.round(f"top{i}_prob", 6) for i in range(1, 6)})


@query("keyword_keep", f"WITH {_TOP} SELECT key, bool_or(lower(label) LIKE '%sunglass%' AND p >= 0.02) AS keep FROM r WHERE n <= 5 GROUP BY key")
def _(spark, sf):
    return _top(spark, sf).select("key", labels.mentions(F.col("top"), min_prob=0.02).alias("keep"))


# --- vectors ----------------------------------------------------------------------------------------------------------


def _long(df: DataFrame, vec: str = "vec", *keep: str) -> DataFrame:
    keep = keep or ("key",)
    return df.select(*keep, F.posexplode(vec).alias("i", "x")).select(*keep, F.col("i").cast("long").alias("i"), r6("x").alias("x"))


@query("standardise", f"WITH {CELLS}, s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM cells GROUP BY i) SELECT key, i, round(CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END, 6) + 0.0 AS x FROM cells JOIN s USING (i)")
def _(spark, sf):
    return _long(blocks.standardise(inputs.points(spark, sf)))


@query("standardise_groups", f"WITH {CELLS} SELECT key, i, round(CASE WHEN stddev_pop(x) OVER w > 0 THEN (x - avg(x) OVER w) / stddev_pop(x) OVER w ELSE 0 END, 6) + 0.0 AS x FROM cells WINDOW w AS (PARTITION BY cluster, i)")
def _(spark, sf):
    return _long(blocks.standardise(inputs.points(spark, sf), group="cluster"))


@query("l2_normalise", f"WITH {CELLS} SELECT key, i, round((x + 1) / sqrt(sum((x + 1) * (x + 1)) OVER (PARTITION BY key)), 6) + 0.0 AS x FROM cells")
def _(spark, sf):
    shifted = inputs.points(spark, sf).withColumn("vec", F.transform("vec", lambda x: x + 1))
    return _long(shifted.withColumn("vec", v.l2_normalise(F.col("vec"))))


@query("weighted_concat", f"WITH {CELLS} SELECT key, i, round(4 * x, 6) + 0.0 AS x FROM cells UNION ALL SELECT key, i + 64, round(x, 6) + 0.0 FROM cells")
def _(spark, sf):
    p = inputs.points(spark, sf).select("key", "vec")
    return _long(blocks.join_blocks("key", (p, 4.0), (p, 1.0)))


@query("centroids", f"WITH {CENTRES} SELECT cluster, i, round(x, 6) + 0.0 AS x, n FROM ci")
def _(spark, sf):
    return _long(blocks.centroids(inputs.points(spark, sf)), "centroid", "cluster", "n")


@query("nearest_centroid", f"WITH {CENTRES}, d AS (SELECT key, c.cluster, pow(list_distance(vec, centroid), 2) AS d FROM points, centres c) SELECT key, arg_min(cluster, d) AS nearest, round(min(d), 6) AS dist2 FROM d GROUP BY key")
def _(spark, sf):
    p = inputs.points(spark, sf)
    return blocks.nearest_centroid(p, blocks.centroids(p)).withColumn("dist2", F.round("dist2", 6))


# --- distances and scores ---------------------------------------------------------------------------------------------


def _sums(spark, sf, metric="euclidean"):
    p = distance.with_labels(inputs.points(spark, sf))
    return distance.cluster_sums(p, metric=metric), distance.label_sets(p)


@query("distance_sums", f"WITH {PAIRS} SELECT CAST(k1 AS VARCHAR) AS key, c1 AS own, c2 AS other, round(sum(d), 5) AS dist_sum, count(*) AS n_pairs FROM pairs GROUP BY ALL")
def _(spark, sf):
    return _sums(spark, sf)[0].select("key", "own", "other", F.round("dist_sum", 5).alias("dist_sum"), "n_pairs")


@query("distance_sums_cosine", f"WITH {POINTS} SELECT CAST(a.key AS VARCHAR) AS key, a.cluster AS own, b.cluster AS other, round(sum(1 - list_cosine_similarity(a.vec, b.vec)), 5) AS dist_sum, count(*) AS n_pairs FROM points a JOIN points b ON a.key <> b.key GROUP BY ALL")
def _(spark, sf):
    return _sums(spark, sf, "cosine")[0].select("key", "own", "other", F.round("dist_sum", 5).alias("dist_sum"), "n_pairs")


@query("dispersion", f"WITH {PAIRS}, d AS (SELECT c1 AS cluster, avg(d) AS d FROM pairs WHERE c1 = c2 GROUP BY c1) SELECT cluster, round(coalesce(d, 0), 6) AS dispersion FROM (SELECT DISTINCT cluster FROM points) LEFT JOIN d USING (cluster)")
def _(spark, sf):
    return distance.dispersion(*_sums(spark, sf)).select("cluster", F.round("dispersion", 6).alias("dispersion"))


@query("pair_separation", f"WITH {SEPARATION} SELECT c1 AS h, c2 AS f, round(sep, 6) AS sep FROM hf WHERE c1 < c2")
def _(spark, sf):
    return distance.pair_separation(_sums(spark, sf)[0]).select("h", "f", F.round("sep", 6).alias("sep"))


@query("cluster_separation", f"WITH {SEPARATION} SELECT cluster, round(min_sep, 6) AS min_sep, min_pair, round(mean_sep, 6) AS mean_sep, round(max_sep, 6) AS max_sep, max_pair FROM sep")
def _(spark, sf):
    sums, sizes = _sums(spark, sf)
    out = distance.cluster_separation(distance.pair_separation(sums), sizes).drop("group", "run")
    return out.withColumns({c: F.round(c, 6) for c in ("min_sep", "mean_sep", "max_sep")})


@query("separation_rank", f"WITH {SEPARATION} SELECT cluster, CAST(row_number() OVER (ORDER BY min_sep DESC, cluster) - 1 AS INTEGER) AS rank, round(min_sep, 6) AS value, min_pair AS partner FROM sep")
def _(spark, sf):
    sums, sizes = _sums(spark, sf)
    return rank.rank_clusters(distance.cluster_separation(distance.pair_separation(sums), sizes), "min_sep", "min_pair").drop("group", "run").withColumn("value", F.round("value", 6))


@query("separation_relabel", f"WITH {SEPARATION}, r AS (SELECT cluster, row_number() OVER (ORDER BY mean_sep DESC, cluster) - 1 AS n FROM sep) SELECT key, CAST(n AS INTEGER) AS cluster FROM points JOIN r USING (cluster)")
def _(spark, sf):
    return workloads.ranked_families(inputs.points(spark, sf), stat="mean_sep").select("key", "cluster")


@query("dispersion_relabel", f"WITH {PAIRS}, d AS (SELECT c1 AS cluster, avg(d) AS d FROM pairs WHERE c1 = c2 GROUP BY c1), r AS (SELECT cluster, row_number() OVER (ORDER BY d DESC, cluster) - 1 AS n FROM d) SELECT key, CAST(n AS INTEGER) AS cluster FROM points JOIN r USING (cluster)")
def _(spark, sf):
    return workloads.ranked_families(inputs.points(spark, sf), "dispersion").select("key", "cluster")


@query("silhouette", f"WITH {PAIRS}{SIL} SELECT round(silhouette, 6) AS silhouette FROM sil")
def _(spark, sf):
    return distance.silhouette(_sums(spark, sf)[0]).select(F.round("silhouette", 6).alias("silhouette"))


@query("calinski_harabasz", f"WITH {SPREAD}{CH} SELECT round(ch, 6) AS ch FROM ch")
def _(spark, sf):
    return scores.calinski_harabasz(inputs.points(spark, sf)).select(F.round("ch", 6).alias("ch"))


@query("davies_bouldin", f"WITH {SPREAD}{DB} SELECT round(db, 6) AS db FROM db")
def _(spark, sf):
    return scores.davies_bouldin(inputs.points(spark, sf)).select(F.round("db", 6).alias("db"))


_BUNDLE = f"WITH {SPREAD}{CH}{DB}, pairs AS (SELECT a.key AS k1, b.key AS k2, a.cluster AS c1, b.cluster AS c2, list_distance(a.vec, b.vec) AS d FROM points a JOIN points b ON a.key <> b.key){SIL}"


@query("score_bundle", f"{_BUNDLE} SELECT (SELECT count(DISTINCT cluster) FROM points) AS n_clusters, CAST(0 AS DOUBLE) AS noise_frac, round(silhouette, 6) AS silhouette, round(ch, 6) AS ch, round(db, 6) AS db FROM sil, ch, db")
def _(spark, sf):
    return scores.score_bundle(inputs.points(spark, sf)).withColumns({c: F.round(c, 6) for c in ("noise_frac", "silhouette", "ch", "db")})


@query("composite_score", f"{_BUNDLE} SELECT round(silhouette + 0.002 * ch + 1 / (1 + db), 6) AS score FROM sil, ch, db")
def _(spark, sf):
    return scores.score_bundle(inputs.points(spark, sf)).select(F.round(scores.composite(F.col("silhouette"), F.col("ch"), F.col("db")), 6).alias("score"))


# --- choice of runs ---------------------------------------------------------------------------------------------------

_BEST = "row_number() OVER (PARTITION BY {by} ORDER BY silhouette DESC NULLS LAST, ch DESC NULLS LAST, db ASC NULLS LAST, CASE WHEN silhouette IS NULL AND ch IS NULL AND db IS NULL THEN n_clusters END DESC NULLS LAST, run_id) AS place"


@query("best_run", f"WITH {RUNS}, r AS (SELECT *, {_BEST.format(by='1')} FROM runs) SELECT run_id, algo, n_clusters, silhouette, ch, db FROM r WHERE place = 1")
def _(spark, sf):
    return rank.best_run(inputs.run_table(spark, sf))


@query("best_run_per_algo", f"WITH {RUNS}, r AS (SELECT *, {_BEST.format(by='algo')} FROM runs) SELECT run_id, algo, n_clusters, silhouette, ch, db FROM r WHERE place = 1")
def _(spark, sf):
    return rank.best_run(inputs.run_table(spark, sf), ["algo"])


def _scores(spark, sf):
    return inputs.run_table(spark, sf).where("n_clusters between 3 and 20").select("algo", F.col("n_clusters").alias("k"), F.col("silhouette").alias("score"))


_RANKED = f"{RUNS}, s AS (SELECT algo, n_clusters AS k, silhouette AS score FROM runs WHERE n_clusters BETWEEN 3 AND 20), w AS (SELECT *, max(score) OVER (PARTITION BY algo) AS best, row_number() OVER (PARTITION BY algo ORDER BY score DESC, k) AS place FROM s WHERE score IS NOT NULL)"


@query("tolerant_k", f"WITH {_RANKED}, n AS (SELECT *, min(CASE WHEN k > 4 AND best > 0 AND score > 0.95 * best THEN place END) OVER (PARTITION BY algo) AS near FROM w), pick AS (SELECT algo, greatest(k, 4) AS best_k FROM n WHERE place = coalesce(near, 1)) SELECT algo, CAST(best_k AS BIGINT) AS best_k FROM (SELECT DISTINCT algo FROM s) LEFT JOIN pick USING (algo)")
def _(spark, sf):
    return rank.tolerant_k(_scores(spark, sf), ["algo"])


@query("strict_k", f"WITH {_RANKED} SELECT algo, k AS best_k, score FROM w WHERE place = 1")
def _(spark, sf):
    return rank.strict_k(_scores(spark, sf), ["algo"])


@query("trial_log", f"WITH {RUNS} SELECT run_id AS trial_id, round(coalesce(silhouette + 0.002 * coalesce(ch, 0) + coalesce(1 / (1 + db), 0), -1e9), 6) AS score FROM runs")
def _(spark, sf):
    runs = inputs.run_table(spark, sf)
    parts = [runs.where("n_clusters < 25"), runs.where("n_clusters >= 25")]
    scored = [p.select(F.col("run_id").alias("trial_id"), F.round(scores.composite(F.col("silhouette"), F.col("ch"), F.col("db")), 6).alias("score")) for p in parts]
    return rank.order_trials(scored[0].unionByName(scored[1]))


@query("min_size_outliers", f"WITH {SMALL} SELECT key, CASE WHEN cluster IN (SELECT cluster FROM big) THEN cluster ELSE -1 END AS cluster FROM sc")
def _(spark, sf):
    return minsize.enforce_min_size(inputs.small_clusters(spark, sf)).select("key", "cluster")


@query("min_size_merge", f"""WITH {SMALL}, b AS (SELECT key, cluster, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM sc WHERE cluster IN (SELECT cluster FROM big)), ci AS (SELECT cluster, i, avg(x) AS x FROM b GROUP BY cluster, i),
centres AS (SELECT cluster, list(x ORDER BY i) AS centroid FROM ci GROUP BY cluster), near AS (SELECT key, arg_min(c.cluster, list_distance(vec, centroid)) AS cluster FROM sc, centres c WHERE sc.cluster NOT IN (SELECT cluster FROM big) GROUP BY key)
SELECT key, cluster FROM near UNION ALL SELECT key, cluster FROM sc WHERE cluster IN (SELECT cluster FROM big)""")
def _(spark, sf):
    return minsize.enforce_min_size(inputs.small_clusters(spark, sf), merge=True).select("key", "cluster")


# --- pixels -----------------------------------------------------------------------------------------------------------


@query("colour_histogram", f"""WITH {PIXELS}, c AS (SELECT stem, 0 AS ch, r AS v FROM px UNION ALL SELECT stem, 1, g FROM px UNION ALL SELECT stem, 2, b FROM px),
n AS (SELECT stem, least(CAST(floor(v / 255 * 32) AS INTEGER), 31) + ch * 32 AS bin, count(*) AS n FROM c GROUP BY ALL), s AS (SELECT stem, sqrt(sum(n * n)) + 1e-8 AS s FROM n GROUP BY stem), every AS (SELECT vec_id AS stem, unnest(range(96)) AS bin FROM embeddings)
SELECT stem, CAST(bin AS BIGINT) AS i, round(coalesce(n, 0) / s, 6) AS x FROM every JOIN s USING (stem) LEFT JOIN n USING (stem, bin)""")
def _(spark, sf):
    return _long(px.colour_histogram(inputs.pixels(spark, sf)), "vec", "stem")


_BOX = "box AS (SELECT stem, greatest(coalesce(min(x) FILTER (d), 0) - {p}, 0) AS x0, greatest(coalesce(min(y) FILTER (d), 0) - {p}, 0) AS y0, least(coalesce(max(x) FILTER (d) + {p}, 7), 7) AS x1, least(coalesce(max(y) FILTER (d) + {p}, 7), 7) AS y1 FROM (SELECT *, r < {m} OR g < {m} OR b < {m} AS d FROM px) GROUP BY stem)"


@query("object_box", f"WITH {PIXELS}, {_BOX.format(p=1, m=85)} SELECT * FROM box")
def _(spark, sf):
    return px.object_box(inputs.pixels(spark, sf), px.dark_pixel(85), 1)


@query("crop_and_whiten", f"WITH {PIXELS}, {_BOX.format(p=1, m=85)}, k AS (SELECT px.*, round(0.299 * r + 0.587 * g + 0.114 * b) > 130 AS light FROM px JOIN box USING (stem) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) SELECT stem, y, x, CASE WHEN light THEN 255 ELSE r END AS r, CASE WHEN light THEN 255 ELSE g END AS g, CASE WHEN light THEN 255 ELSE b END AS b FROM k")
def _(spark, sf):
    pixels = inputs.pixels(spark, sf)
    return px.whiten(px.crop(pixels, px.object_box(pixels, px.dark_pixel(85), 1)), 130)


@query("merge_masks", f"WITH {PIXELS} SELECT stem, y, x, greatest(r, b) AS alpha FROM px")
def _(spark, sf):
    pixels = inputs.pixels(spark, sf)
    return px.merge_masks(pixels.select("stem", "y", "x", F.col("r").alias("alpha")), pixels.select("stem", "y", "x", F.col("b").alias("alpha")))


_MOMENTS = PIXELS + """, mg AS (SELECT *, avg(0.2125 * r + 0.7154 * g + 0.0721 * b) OVER (PARTITION BY stem) AS mean FROM px), on_ AS (SELECT stem, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM mg WHERE 0.2125 * r + 0.7154 * g + 0.0721 * b < mean),
c AS (SELECT *, x - avg(x) OVER (PARTITION BY stem) AS dx, y - avg(y) OVER (PARTITION BY stem) AS dy FROM on_),
u AS (SELECT stem, count(*) AS area, sum(dx * dx) AS u20, sum(dy * dy) AS u02, sum(dx * dy) AS u11, sum(dx ** 3) AS u30, sum(dy ** 3) AS u03, sum(dx * dx * dy) AS u21, sum(dx * dy * dy) AS u12 FROM c GROUP BY stem),
n AS (SELECT *, u20 / area ** 2 AS n20, u02 / area ** 2 AS n02, u11 / area ** 2 AS n11, u30 / area ** 2.5 AS n30, u03 / area ** 2.5 AS n03, u21 / area ** 2.5 AS n21, u12 / area ** 2.5 AS n12, u20 / area + 1 / 12 AS vx, u02 / area + 1 / 12 AS vy, u11 / area AS vxy FROM u),
e AS (SELECT *, n30 + n12 AS a, n21 + n03 AS b, n30 - 3 * n12 AS c, 3 * n21 - n03 AS d, sqrt((vx - vy) ** 2 + 4 * vxy ** 2) AS root FROM n)"""


@query("shape_moments", f"""WITH {_MOMENTS} SELECT stem, area, round(n20 + n02, 6) + 0.0 AS hu1, round((n20 - n02) ** 2 + 4 * n11 ** 2, 6) + 0.0 AS hu2, round(c ** 2 + d ** 2, 6) + 0.0 AS hu3, round(a ** 2 + b ** 2, 6) + 0.0 AS hu4,
round(c * a * (a ** 2 - 3 * b ** 2) + d * b * (3 * a ** 2 - b ** 2), 6) + 0.0 AS hu5, round((n20 - n02) * (a ** 2 - b ** 2) + 4 * n11 * a * b, 6) + 0.0 AS hu6, round(d * a * (a ** 2 - 3 * b ** 2) - c * b * (3 * a ** 2 - b ** 2), 6) + 0.0 AS hu7,
round(sqrt(1 - ((vx + vy - root) / 2) / ((vx + vy + root) / 2)), 6) + 0.0 AS eccentricity, round(sqrt((vx + vy + root) / 2) / (sqrt((vx + vy - root) / 2) + 1e-8), 6) + 0.0 AS axis_ratio FROM e""")
def _(spark, sf):
    out = px.shape_moments(inputs.pixels(spark, sf))
    return out.select("stem", "area", *(r6(c).alias(c) for c in out.columns[2:]))


_DESCRIBED = PIXELS + """, s AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo, y >= 2 AND y < 6 AS band FROM px),
q AS (SELECT stem, avg(hi) / 255 AS brightness, avg(CASE WHEN hi > 0 THEN (hi - lo) / hi ELSE 0 END) AS mean_saturation, 1 - avg(CASE WHEN band THEN hi END) / 255 AS lens_darkness,
  avg(greatest((r + g) / 2 - b, 0) / 255) * ((var_pop(r) + var_pop(g) + var_pop(b)) / 3) / 1000 AS tortoise_score FROM s GROUP BY stem)"""


@query("quick_descriptors", f"WITH {_DESCRIBED} SELECT stem, round(brightness, 6) + 0.0 AS brightness, round(mean_saturation, 6) + 0.0 AS mean_saturation, round(lens_darkness, 6) + 0.0 AS lens_darkness, round(tortoise_score, 6) + 0.0 AS tortoise_score FROM q")
def _(spark, sf):
    out = px.quick_descriptors(inputs.pixels(spark, sf))
    return out.select("stem", *(r6(c).alias(c) for c in out.columns[1:]))


@query("image_features", f"""WITH {_MOMENTS}{_DESCRIBED.removeprefix(PIXELS)}, {_BOX.format(p=5, m=85)} SELECT CAST(stem AS VARCHAR) AS stem, area, round(n20 + n02, 6) + 0.0 AS hu1, round((n20 - n02) ** 2 + 4 * n11 ** 2, 6) + 0.0 AS hu2, round(sqrt((vx + vy + root) / 2) / (sqrt((vx + vy - root) / 2) + 1e-8), 6) + 0.0 AS axis_ratio,
round(brightness, 6) + 0.0 AS brightness, round(mean_saturation, 6) + 0.0 AS mean_saturation, round(lens_darkness, 6) + 0.0 AS lens_darkness, round(tortoise_score, 6) + 0.0 AS tortoise_score, x0, y0, x1, y1 FROM e JOIN q USING (stem) JOIN box USING (stem)""")
def _(spark, sf):
    out = folded.image_features(folded.read_images(spark, files.image_folder(spark, sf)), 85)
    return out.select("stem", "area", *(r6(c).alias(c) for c in ("hu1", "hu2", "axis_ratio", "brightness", "mean_saturation", "lens_darkness", "tortoise_score")), "x0", "y0", "x1", "y1")


@query("family_names", f"""WITH {_DESCRIBED}, {_BOX.format(p=0, m=85)}, m AS (SELECT label AS cluster, count(*) AS size, avg((x1 - x0 + 1) / (y1 - y0 + 1)) AS ar, avg(mean_saturation) AS sat, avg(tortoise_score) AS tort, avg(lens_darkness) AS dark FROM q JOIN box USING (stem) JOIN embeddings ON stem = vec_id WHERE label >= 0 GROUP BY label)
SELECT cluster, size, CASE WHEN ar >= 2.2 THEN 'Slim Rectangle (’90s)' WHEN ar >= 1.6 THEN 'Rectangular' WHEN ar >= 1.25 THEN 'Soft Rectangle / Oval' ELSE 'Geometric' END || ' · Acetate' || CASE WHEN tort > 0.12 THEN ' · Tortoiseshell' ELSE '' END || CASE WHEN dark > 0.5 THEN ' · Blackout Lenses' ELSE ' · Light/Gradient Lenses' END AS name FROM m""")
def _(spark, sf):
    described = px.full_descriptors(inputs.pixels(spark, sf), px.dark_pixel(85))
    clusters = inputs.points(spark, sf).select(F.col("key").alias("stem"), "cluster")
    means = minsize.describe_clusters(described.join(clusters, "stem"))
    return means.select("cluster", "size").join(minsize.name_clusters(means), "cluster")


@query("squared_silhouette", f"""WITH {POINTS}, sq AS (SELECT a.key, a.cluster AS own, b.cluster AS other, sum(list_distance(a.vec, b.vec) ** 2) AS d, count(*) AS n FROM points a JOIN points b ON a.key <> b.key GROUP BY ALL),
ab AS (SELECT key, own, min(CASE WHEN own = other THEN d / n END) AS a, min(CASE WHEN own <> other THEN d / n END) AS b FROM sq GROUP BY key, own)
SELECT 0 AS run, round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0 AS silhouette, count(*) AS n_points, count(DISTINCT own) AS n_clusters FROM ab""")
def _(spark, sf):
    out = scores.squared_silhouette(distance.with_labels(inputs.points(spark, sf)))
    return out.select("run", r6("silhouette").alias("silhouette"), "n_points", "n_clusters")


# --- what fitted models must satisfy whatever their order of rows: sums of squares, tree weights, variances ------------

_TOTAL = f"WITH {CELLS}, m AS (SELECT i, avg(x) AS m FROM cells GROUP BY i), total AS (SELECT sum((x - m) ** 2) AS ss, count(DISTINCT key) AS n FROM cells JOIN m USING (i))"


@query("leading_variance", f"""WITH RECURSIVE {CELLS}, st AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM cells GROUP BY i), z AS (SELECT key, i, CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END AS x FROM cells JOIN st USING (i)),
cov AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / (count(*) - 1) AS c FROM z a JOIN z b USING (key) GROUP BY a.i, b.i), m AS (SELECT list(r ORDER BY i) AS rows FROM (SELECT i, list(c ORDER BY j) AS r FROM cov GROUP BY i)),
turn(k, v) AS (SELECT 0, list_transform(range(64), lambda i: CAST(1 + i % 7 AS DOUBLE)) UNION ALL SELECT k + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (SELECT k, list_transform(rows, lambda r: list_dot_product(r, v)) AS w FROM turn, m WHERE k < 3000))
SELECT (SELECT count(*) FROM points) AS n, 16 AS n_components, round(list_dot_product(v, list_transform(rows, lambda r: list_dot_product(r, v))), 5) AS first_variance, true AS falling, true AS uncorrelated FROM turn, m WHERE k = 3000""")
def _(spark, sf):
    p = blocks.project(blocks.standardise(inputs.points(spark, sf)), 16)
    at = lambda i: F.get("vec", F.lit(i))
    variances = [F.var_samp(at(i)) for i in range(16)]
    falling = F.forall(F.sequence(F.lit(0), F.lit(14)), lambda i: F.get("v", i) >= F.get("v", i + 1))
    mixed = F.greatest(*(F.abs(F.corr(at(i), at(j))) for i in range(16) for j in range(i)))
    found = p.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("n_components"), F.array(*variances).alias("v"), mixed.alias("mixed"))
    return found.select("n", "n_components", F.round(F.get("v", F.lit(0)), 5).alias("first_variance"), falling.alias("falling"), (F.col("mixed") < 1e-6).alias("uncorrelated"))


@query("kmeans_balance", f"{_TOTAL} SELECT n, 8 AS n_clusters, round(ss, 6) AS squares, true AS tight FROM total")
def _(spark, sf):
    found = keep(cluster.kmeans(inputs.points(spark, sf).drop("cluster"), 8))
    met = keep(found.join(F.broadcast(blocks.centroids(found)), "cluster").withColumn("d2", v.squared_distance(F.col("vec"), F.col("centroid"))))
    moved = blocks.nearest_centroid(found, blocks.centroids(found)).join(met.select("key", "d2"), "key").where(F.col("dist2") < F.col("d2") * 0.999).count()
    mean = found.withColumn("cluster", F.lit(0))
    middle = blocks.centroids(mean).select(F.col("centroid").alias("_m"))
    apart = F.sum(v.squared_distance(F.col("centroid"), F.col("_m")))
    out = met.crossJoin(F.broadcast(middle)).agg(F.count("*").alias("n"), F.count_distinct("cluster").cast("int").alias("n_clusters"), F.round(F.sum("d2") + apart, 6).alias("squares"))
    return out.withColumn("tight", F.lit(moved) <= 0.02 * F.col("n"))  # a fixed point but for the tolerance


@query("ward_balance", f"""{_TOTAL}, g AS (SELECT p_brand AS brand, cells.* FROM cells JOIN part ON key = p_partkey), gm AS (SELECT brand, i, avg(x) AS m FROM g GROUP BY brand, i),
gs AS (SELECT brand, sum((x - m) ** 2) AS ss, count(DISTINCT key) AS n FROM g JOIN gm USING (brand, i) GROUP BY brand)
SELECT '' AS brand, n - 1 AS merges, n AS last_size, round(ss, 6) AS squares, true AS rising FROM total UNION ALL SELECT brand, n - 1, n, round(ss, 6), true FROM gs WHERE n > 1""")
def _(spark, sf):
    p = inputs.points(spark, sf)
    by = cluster.merge_table(p.join(inputs.products(spark, sf).select("key", "brand"), "key"), group="brand")
    both = cluster.merge_table(p).unionByName(by)
    before = F.lag("height").over(Window.partitionBy("group").orderBy("step"))
    checked = both.withColumn("rises", F.coalesce(F.col("height") >= before - 1e-9, F.lit(True)))
    return checked.groupBy(F.col("group").alias("brand")).agg(F.count("*").alias("merges"), F.max("size").alias("last_size"), F.round(F.sum(F.col("height") * F.col("height") / 2), 6).alias("squares"), F.every("rises").alias("rising"))


_DENSITY_TREE = f"""WITH RECURSIVE {POINTS}, ids AS (SELECT row_number() OVER (ORDER BY CAST(key AS VARCHAR)) AS i, vec FROM points), ds AS (SELECT a.i, b.i AS j, greatest(1 - list_cosine_similarity(a.vec, b.vec), 0) AS d FROM ids a JOIN ids b ON a.i <> b.i),
core AS (SELECT i, min(d) AS c FROM ds GROUP BY i), w AS (SELECT ds.i, list(greatest(d, x.c, y.c) ORDER BY j) AS r FROM ds JOIN core x ON x.i = ds.i JOIN core y ON y.i = ds.j GROUP BY ds.i), n AS (SELECT count(*) AS n FROM ids),
m AS (SELECT i, list_concat(r[:i - 1], [9.0], r[i:]) AS r FROM w),
prim(k, total, inside, best) AS (SELECT 1, CAST(0 AS DOUBLE), [CAST(1 AS BIGINT)], list_transform(r, lambda x, j: CASE WHEN j = 1 THEN 9.0 ELSE x END) FROM m WHERE i = 1
  UNION ALL SELECT k + 1, total + e, list_append(inside, a), list_transform(best, lambda x, j: CASE WHEN j = a OR x = 9.0 THEN 9.0 ELSE least(x, r[j]) END) FROM (SELECT *, list_min(best) AS e, list_position(best, list_min(best)) AS a FROM prim) p JOIN m ON m.i = p.a WHERE k < (SELECT n FROM n))
SELECT n - 1 AS edges, round(total, 6) AS weight, n AS points FROM prim, n WHERE k = n"""


@query("density_tree", _DENSITY_TREE)
def _(spark, sf):
    named = inputs.points(spark, sf).select(F.col("key").cast("string").alias("key"), "vec")
    points, n = rounds.numbered(named)
    edges, core = rounds.spanning_tree(points, n, 1, "cosine")
    return edges.agg(F.count("*").alias("edges"), F.round(F.sum("w"), 6).alias("weight")).crossJoin(F.broadcast(core.agg(F.count("*").alias("points"))))


@query("density_graph_tree", _DENSITY_TREE)
def _(spark, sf):
    points, n = rounds.numbered(inputs.points(spark, sf).select(F.col("key").cast("string").alias("key"), "vec"))
    edges, core = neighbours.graph_tree(points.select("idx", "vec"), n, 1, "cosine", exact=True)
    return edges.agg(F.count("*").alias("edges"), F.round(F.sum("w"), 6).alias("weight")).crossJoin(F.broadcast(core.agg(F.count("*").alias("points"))))


_NEAREST = f"""WITH {POINTS}, ds AS (SELECT a.key, greatest(1 - list_cosine_similarity(a.vec, b.vec), 0) AS d FROM points a JOIN points b ON a.key <> b.key),
ranked AS (SELECT key, d, CAST(row_number() OVER (PARTITION BY key ORDER BY d) AS INTEGER) AS rank FROM ds)"""


@query("neighbours", f"{_NEAREST} SELECT key, rank, round(d, 6) AS d FROM ranked WHERE rank <= 10")
def _(spark, sf):
    near = neighbours.neighbours(inputs.points(spark, sf), 10, "cosine", exact=True)
    return near.select("key", "rank", F.round("d", 6).alias("d"))


@query("neighbour_recall", f"{_NEAREST} SELECT count(*) AS pairs, true AS enough FROM ranked WHERE rank <= 10 AND key % 50 = 0")
def _(spark, sf):
    """The lists that ``measured_probes`` chooses, against a search that misses nothing, for keys divisible by 50."""
    p = inputs.points(spark, sf)
    near, every = (neighbours.neighbours(p, 10, "cosine", exact=e).where("key % 50 = 0") for e in (False, True))
    kth = every.groupBy("key").agg(F.max("d").alias("kth"))
    right = F.sum(F.when(F.col("d") <= F.col("kth") + 1e-9, 1).otherwise(0))
    return near.join(kth, "key").agg(F.count("*").alias("pairs"), F.coalesce(right >= 0.9 * F.count("*"), F.lit(True)).alias("enough"))


# --- fitted models: rows only, exactness is tested against brute force -------------------------------------------------


@query("pca")
def _(spark, sf):
    p = blocks.project(blocks.standardise(inputs.points(spark, sf)), 16)
    return p.select("key", F.round(v.norm(F.col("vec")), 6).alias("length"))


@query("pca_choice")
def _(spark, sf):
    p, info = search.choose_projection(inputs.points(spark, sf))
    return p.select("key", F.lit(info["n_components"]).alias("n_components"), F.round(v.norm(F.col("vec")), 6).alias("length"))


@query("kmeans")
def _(spark, sf):
    return cluster.kmeans(inputs.points(spark, sf).drop("cluster"), 8).select("key", "cluster")


@query("kmeans_search")
def _(spark, sf):
    return cluster.search_kmeans(inputs.points(spark, sf).drop("cluster"), range(2, 12))[0]


@query("agglomerative")
def _(spark, sf):
    return cluster.agglomerative(inputs.points(spark, sf), [3, 8])


@query("agglomerative_average")
def _(spark, sf):
    return cluster.agglomerative(inputs.points(spark, sf), [3, 8], "average", "cosine")


@query("agglomerative_search")
def _(spark, sf):
    return cluster.search_agglomerative(inputs.points(spark, sf).drop("cluster"))[1]


@query("merge_table")
def _(spark, sf):
    return cluster.merge_table(inputs.points(spark, sf))


@query("merge_table_by_brand")
def _(spark, sf):
    p = inputs.points(spark, sf).join(inputs.products(spark, sf).select("key", "brand"), "key")
    return cluster.merge_table(p, group="brand")


@query("density")
def _(spark, sf):
    return cluster.density(inputs.points(spark, sf))


@query("grid_search")
def _(spark, sf):
    return search.grid_search(inputs.points(spark, sf).drop("cluster"))[0]


@query("random_search")
def _(spark, sf):
    return workloads.configuration_search({"embeddings": inputs.points(spark, sf).drop("cluster")})[0]


@query("best_configuration")
def _(spark, sf):
    tables = {"embeddings": inputs.points(spark, sf).drop("cluster")}
    return workloads.best_assignments(tables, workloads.configuration_search(tables)[1])


def _bundle_of(name: str, points: str) -> str:
    """The row of one feature set; ``points`` defines points(key, vec, cluster) in place of the embeddings."""
    return f"SELECT * FROM ({_BUNDLE.replace(POINTS, points)} SELECT '{name}' AS feature_set, (SELECT count(DISTINCT cluster) FROM points) AS n_clusters, CAST(0 AS DOUBLE) AS noise_frac, round(silhouette, 6) AS silhouette, round(ch, 6) AS ch, round(db, 6) AS db FROM sil, ch, db)"


_COLOUR = f"""{PIXELS}, hc AS (SELECT stem, 0 AS ch, r AS v FROM px UNION ALL SELECT stem, 1, g FROM px UNION ALL SELECT stem, 2, b FROM px),
hn AS (SELECT stem, least(CAST(floor(v / 255 * 32) AS INTEGER), 31) + ch * 32 AS bin, count(*) AS n FROM hc GROUP BY ALL), hs AS (SELECT stem, sqrt(sum(n * n)) + 1e-8 AS s FROM hn GROUP BY stem), every AS (SELECT vec_id AS stem, label, unnest(range(96)) AS bin FROM embeddings),
points AS MATERIALIZED (SELECT stem AS key, list(coalesce(n, 0) / s ORDER BY bin) AS vec, any_value(label) AS cluster FROM every JOIN hs USING (stem) LEFT JOIN hn USING (stem, bin) GROUP BY stem)"""


@query("feature_set_comparison", f"{_bundle_of('embedding', POINTS)} UNION ALL {_bundle_of('colour', _COLOUR)}")
def _(spark, sf):
    p = inputs.points(spark, sf)
    hist = px.colour_histogram(inputs.pixels(spark, sf)).withColumnRenamed("stem", "key").join(p.select("key", "cluster"), "key")
    out = search.compare_feature_sets({"embedding": p, "colour": hist})
    return out.withColumns({c: F.round(c, 6) for c in ("noise_frac", "silhouette", "ch", "db")})


@query("batch_scoring", f"WITH {CELLS} SELECT key, round(sum(x * (i + 1)), 6) + 0.0 AS score FROM cells GROUP BY key")
def _(spark, sf):
    def model():
        import numpy as np

        weights = np.arange(1, 65)
        return lambda batch: [[float(np.dot(x["vec"], weights))] for x in batch]

    rows = inputs.points(spark, sf).select("key", F.struct("key", "vec").alias("value"))
    return batch_score(rows, "key", "value", model).select("key", r6(F.get("vec", F.lit(0))).alias("score"))


@query("families")
def _(spark, sf):
    shape = inputs.points(spark, sf).select("key", "vec")
    colour = px.colour_histogram(inputs.pixels(spark, sf)).withColumnRenamed("stem", "key")
    texture = px.quick_descriptors(inputs.pixels(spark, sf)).select(F.col("stem").alias("key"), F.array("brightness", "mean_saturation", "lens_darkness").alias("vec"))
    return workloads.families(shape, colour, texture).select("key", "cluster", "best_k")
