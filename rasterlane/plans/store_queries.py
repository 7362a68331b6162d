"""Queries of the project store, catalogs and text scans, over orders, parts and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlane.plans.bindings import table
from rasterlane.sources import catalogs, georef, projects

C = F.col


def _projects(spark, d):
    o = table(spark, d, "orders")
    iso = lambda x: F.date_format(x, "yyyy-MM-dd")
    return o.select(C("o_orderkey").cast("string").alias("id"), F.concat(F.lit("İş "), "o_orderpriority").alias("name"), C("o_orderstatus").alias("description"), iso("o_orderdate").alias("created_at"), iso("o_orderdate").alias("updated_at"), C("o_totalprice").alias("area"), C("o_custkey").alias("location"))


def project_search(spark, d):
    p = table(spark, d, "part").select(C("p_partkey").cast("string").alias("id"), C("p_name").alias("name"), C("p_type").alias("description"))
    return projects.search(p, "ST")


def project_list(spark, d):
    """Place of each project in the listing, and among the recent five."""
    return projects.listed(_projects(spark, d)).select("id", C("place").cast("long").alias("place"), (C("place") <= 5).alias("recent"))


def project_scope(spark, d):
    """Parts as projects at the places of the catalog, in each scope of the listing that they belong to."""
    titles = F.array(*[F.lit(x[1]) for x in catalogs.HOTSPOTS])
    p = table(spark, d, "part").select(C("p_partkey").cast("string").alias("id"), C("p_name").alias("name"), F.element_at(titles, (C("p_partkey") % len(catalogs.HOTSPOTS) + 1).cast("int")).alias("location_name"))
    return reduce(DataFrame.unionByName, [projects.in_scope(p, words).withColumn("scope", F.lit(scope)) for scope, words in projects.SCOPES.items()])


def project_recents(spark, d):
    """The newest three."""
    return projects.recent(_projects(spark, d), 3).select("id", "updated_at")


def _store(spark, d):
    """All orders as the stored projects, and all parts as later writes under ten times their key, of which some are new."""
    later = table(spark, d, "part").select((C("p_partkey") * 10).cast("string").alias("id"), F.concat("p_name", F.lit(" v2")).alias("name"), C("p_type").alias("description"), F.lit("2026-01-01").alias("created_at"),
                                           F.lit("2026-01-02").alias("updated_at"), C("p_retailprice").alias("area"), C("p_size").cast("long").alias("location"))
    return _projects(spark, d), later


def project_upsert(spark, d):
    base, new = _store(spark, d)
    return projects.upserted(base, new).select("id", "name", "created_at", "updated_at")


def project_delete(spark, d):
    base, new = _store(spark, d)
    return projects.deleted(base, new.select("id")).groupBy("description").agg(F.count("*").alias("left"))


def url_parts(spark, d):
    u = C("url")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(u, r"^(https?)://", 1).alias("scheme"), F.regexp_extract(u, r"^https?://([^/?]+)", 1).alias("host"), F.regexp_extract(u, r"/([0-9]+)(\?|$)", 1).alias("number"), F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"))


def result_dirs(spark, d):
    """Result folders that links of pages name."""
    urls = table(spark, d, "pages").select(F.concat(F.lit("/static/results/"), F.substring(F.md5("url"), 1, 12), F.lit("/mask.png")).alias("url"))
    return projects.result_dirs(urls.withColumn("url", F.when(F.length("url") % 2 == 1, C("url")).otherwise(F.upper("url"))), "url")


def layer_blocks(spark, d):
    """Links of each page by the same split that lists the layers of a capabilities document."""
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("times"))


def world_files(spark, d):
    t = F.concat_ws("\n", C("s_suppkey") / 4.0, F.lit("0.0"), F.lit(" 0.0 "), F.lit("-0.5"), C("s_suppkey") * 1.0, F.when(C("s_suppkey") % 10 == 0, "x").otherwise("41.25"))
    w = table(spark, d, "supplier").select("s_suppkey", georef.world_file(t).alias("t"))
    return w.select("s_suppkey", "t.a", "t.b", "t.c", "t.d", "t.e", "t.f")


_TITLES = ", ".join(f"'{x[1]}'" for x in catalogs.HOTSPOTS)

def project_json(spark, d):
    """What the store shows of JSON columns: texts of parts that are whole, broken off, empty or absent."""
    k = C("p_partkey")
    whole = F.to_json(F.struct(k.alias("part"), C("p_name").alias("name"), F.array(k, k + 1).alias("at")))
    text = F.when(k % 5 == 0, F.expr("substring(whole, 1, length(whole) - 1)")).when(k % 5 == 1, "").when(k % 5 < 4, C("whole"))
    t = projects.with_valid_json(table(spark, d, "part").withColumn("whole", whole).select("p_partkey", text.alias("stats"), F.concat(F.lit("["), C("p_size"), F.when(k % 3 == 0, ",").otherwise("]")).alias("coords")))
    return t.select("p_partkey", F.variant_get(F.try_parse_json("stats"), "$.at[1]", "long").alias("second"), C("stats").isNull().alias("no_stats"), "coords")


QUERIES = {
    "project_json": (project_json, "SELECT p_partkey, CASE WHEN p_partkey % 5 IN (2, 3) THEN p_partkey + 1 END AS second, p_partkey % 5 IN (0, 4) AS no_stats, CASE WHEN p_partkey % 3 > 0 THEN '[' || p_size || ']' END AS coords FROM part"),
    "project_search": (project_search, "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_type AS description FROM part WHERE contains(lower(p_name), 'st') OR contains(lower(p_type), 'st')"),
    "project_list": (project_list, "WITH p AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%d') AS u FROM orders) SELECT id, row_number() OVER (ORDER BY u DESC, id) AS place, row_number() OVER (ORDER BY u DESC, id) <= 5 AS recent FROM p"),
    "project_scope": (project_scope, f"""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, [{_TITLES}][p_partkey % {len(catalogs.HOTSPOTS)} + 1] AS location_name FROM part), t AS (SELECT *, lower(name || ' ' || location_name) AS x FROM p)
        {" UNION ALL ".join(f"SELECT id, name, location_name, '{s}' AS scope FROM t WHERE regexp_matches(x, '{'|'.join(words)}')" for s, words in projects.SCOPES.items())}"""),
    "project_recents": (project_recents, "SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%d') AS updated_at FROM orders ORDER BY 2 DESC, 1 LIMIT 3"),
    "project_upsert": (project_upsert, """WITH o AS (SELECT o_orderkey AS k, 'İş ' || o_orderpriority AS name, strftime(o_orderdate, '%Y-%m-%d') AS t FROM orders), n AS (SELECT p_partkey * 10 AS k, p_name || ' v2' AS name FROM part)
        SELECT CAST(coalesce(n.k, o.k) AS VARCHAR) AS id, coalesce(n.name, o.name) AS name, coalesce(t, '2026-01-01') AS created_at, CASE WHEN n.k IS NULL THEN t ELSE '2026-01-02' END AS updated_at FROM o FULL JOIN n ON o.k = n.k"""),
    "project_delete": (project_delete, 'SELECT o_orderstatus AS description, count(*) AS "left" FROM orders WHERE o_orderkey NOT IN (SELECT p_partkey * 10 FROM part) GROUP BY 1'),
    "url_parts": (url_parts, r"SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?]+)', 1) AS host, regexp_extract(url, '/([0-9]+)(\?|$)', 1) AS number, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages"),
    "result_dirs": (result_dirs, "SELECT DISTINCT substr(md5(url), 1, 12) AS dir FROM pages"),
    "layer_blocks": (layer_blocks, """SELECT page_id, href, count(*) AS times FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id, href"""),
    "world_files": (world_files, """WITH t AS (SELECT s_suppkey, s_suppkey % 10 > 0 AS ok, s_suppkey / 4.0::DOUBLE AS a FROM supplier)
        SELECT s_suppkey, CASE WHEN ok THEN a END AS a, CASE WHEN ok THEN 0.0::DOUBLE END AS b, CASE WHEN ok THEN s_suppkey - a / 2 END AS c, CASE WHEN ok THEN 0.0::DOUBLE END AS d, CASE WHEN ok THEN -0.5::DOUBLE END AS e, CASE WHEN ok THEN 41.5::DOUBLE END AS f FROM t"""),
}
