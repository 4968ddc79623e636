"""Registered queries over the tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec, text
from ..operators import catalog, links, redact, tables, verify
from ..sources import events, files
from . import generate, protocol, report

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Subjects of the tabular queries: parts' names written the other way round.
SUBJECTS = "SELECT DISTINCT list_sort(string_split(lower(p_name), ' ')) AS k FROM part WHERE p_size = 1"


def subjects(part: DataFrame) -> DataFrame:
    """subject_idx, name, key: names of parts of size 1, tokens in reverse."""
    names = part.where("p_size = 1").select(F.array_join(F.reverse(F.split("p_name", " ")), ", ").alias("name")).distinct()
    keyed = names.withColumn("key", text.name_key(text.fold_text(F.col("name"))))
    return keyed.withColumn("subject_idx", F.row_number().over(Window.orderBy("name")))


@query("SELECT array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ') AS name_key, count(*) AS n, min(p_name) AS first_name FROM part GROUP BY 1")
def name_key_groups(spark, sf_dir):
    key = text.name_key(text.fold_text(F.col("p_name")))
    return table(spark, sf_dir, "part").groupBy(F.array_join(key, " ").alias("name_key")).agg(F.count(F.lit(1)).alias("n"), F.min("p_name").alias("first_name"))


@query(f"WITH s AS ({SUBJECTS}) SELECT p_partkey, p_name FROM part WHERE list_sort(string_split(lower(p_name), ' ')) IN (SELECT k FROM s)")
def name_match_reversed(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return redact.match_names(part, "p_name", subjects(part)).where("subject IS NOT NULL").select("p_partkey", "p_name")


_REDACTED = f"""WITH s AS ({SUBJECTS}), m AS (SELECT *, list_sort(string_split(lower(p_name), ' ')) IN (SELECT k FROM s) AS hit FROM part)
SELECT p_partkey, CASE WHEN hit THEN 'Nimi poistettu pyynnöstä' ELSE p_name END AS p_name, CASE WHEN hit THEN '' ELSE p_brand END AS p_brand, p_type, p_size, p_retailprice FROM m"""


@query(_REDACTED)
def tabular_redact(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return redact.redact_table(part, "p_name", "p_brand", subjects(part)).select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@query(f"WITH s AS ({SUBJECTS}) SELECT p_partkey, list_sort(string_split(lower(p_name), ' ')) IN (SELECT k FROM s) AS redacted, 0 AS n_problems FROM part")
def tabular_invariance(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    after = redact.redact_table(part, "p_name", "p_brand", subjects(part)).drop("subject")
    return verify.table_problems(part, after, "p_partkey", "p_name", "p_brand").select("p_partkey", "redacted", F.size("problems").alias("n_problems"))


@query(f"WITH r AS ({_REDACTED}) SELECT p.p_partkey, r.p_name AS content, r.p_name <> p.p_name AS changed FROM part p JOIN r USING (p_partkey)")
def overlay_changed(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    new = redact.redact_table(part, "p_name", "p_brand", subjects(part)).where("subject IS NOT NULL").select("p_partkey", F.col("p_name").alias("content"))
    return redact.overlay(part.select("p_partkey", F.col("p_name").alias("content")), new, ["p_partkey"]).select("p_partkey", "content", "changed")


_PEOPLE = """WITH k AS (SELECT p_brand, p_name, min(p_partkey) AS seq FROM part GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY seq) AS ordinal, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS cat_no FROM k)"""


def _brand_people(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        F.lit("e").alias("event_id"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("cat_no"), F.lit(0).alias("source_no"), F.col("p_partkey").alias("row_no"),
        F.col("p_name").alias("name"), F.col("p_type").alias("club"), F.lit("").alias("first_cell"),
    )
    return catalog.build_catalog(rows, redact.REPLACEMENT)


@query(_PEOPLE + "SELECT cat_no, CAST(ordinal AS INTEGER) AS ordinal, 'c' || cat_no || '-s' || ordinal AS person_id, p_name AS name FROM i")
def catalog_ids(spark, sf_dir):
    return _brand_people(spark, sf_dir).select("cat_no", "ordinal", "person_id", "name")


@query(_PEOPLE + "SELECT 'c' || a.cat_no || '-s' || a.ordinal AS person_id, count(b.cat_no) AS n_also FROM i a LEFT JOIN i b ON a.p_name = b.p_name AND a.cat_no <> b.cat_no GROUP BY a.cat_no, a.ordinal")
def also_in(spark, sf_dir):
    return _brand_people(spark, sf_dir).select("person_id", F.size("also_in").cast("long").alias("n_also"))


@query("SELECT p_name AS name, min(p_partkey) AS first_sel, arg_min(p_type, p_partkey) AS club, CAST(row_number() OVER (ORDER BY min(p_partkey)) - 1 AS INTEGER) AS name_idx FROM part GROUP BY p_name")
def unique_names(spark, sf_dir):
    chosen = table(spark, sf_dir, "part").select(F.lit("e").alias("event_id"), F.col("p_partkey").alias("sel_idx"), F.col("p_name").alias("name"), F.col("p_type").alias("club"))
    return catalog.unique_names(chosen.withColumn("key", text.name_key(text.fold_text(F.col("name"))))).select("name", "first_sel", "club", "name_idx")


_WANTED = "SELECT o_custkey AS id, min(o_orderkey) AS seq FROM orders WHERE o_totalprice > 100000 GROUP BY 1"


def _customers(spark, sf_dir):
    people = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.lit("e").alias("event_id"), F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"))
    wanted = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.lit("e").alias("event_id"), F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("sel_idx"))
    return people, wanted


@query(f"WITH w AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS sel_idx FROM ({_WANTED})) SELECT id AS person_id, c_name AS name, CAST(sel_idx AS INTEGER) AS sel_idx FROM w JOIN customer ON c_custkey = id AND c_acctbal >= 0")
def selection_resolve(spark, sf_dir):
    return catalog.resolve_selection(*_customers(spark, sf_dir)).select("person_id", "name", "sel_idx")


@query(f"SELECT id AS person_id FROM ({_WANTED}) WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def selection_unknown(spark, sf_dir):
    return catalog.unknown_ids(*_customers(spark, sf_dir)).select("person_id")


@query("SELECT c_custkey AS sel_idx, 'selected person ' || (c_custkey + 1) AS label FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def not_found(spark, sf_dir):
    chosen = table(spark, sf_dir, "customer").select(F.lit("e").alias("event_id"), F.col("c_custkey").alias("sel_idx"))
    hits = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.lit("e").alias("event_id"), F.col("o_custkey").alias("sel_idx"))
    return catalog.not_found(chosen, hits).select("sel_idx", catalog.label(F.col("sel_idx")).alias("label"))


# -- pages ---------------------------------------------------------------------------------


@query("""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<[a-zA-Z][^>]*>')) AS tag FROM pages)
SELECT page_id, a AS attr, trim(trim(v, '"''')) AS value FROM (SELECT page_id, lower(regexp_extract(x, '^[A-Za-z]+')) AS a, regexp_replace(x, '^[A-Za-z]+\\s*=\\s*', '') AS v FROM (SELECT page_id, unnest(regexp_extract_all(tag, '[A-Za-z]+\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s>"'']+)')) AS x FROM t)) WHERE a IN ('href', 'src') AND trim(v, '"''') <> ''""")
def link_extract(spark, sf_dir):
    return links.extract_links(table(spark, sf_dir, "pages").select("page_id", "html"), "html").select("page_id", "attr", "value")


def _sites(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.col("url").alias("page_url"), F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1), F.lit("/")).alias("base_url"), "html")


@query("SELECT page_id, 'dir' AS kind, substr(v, 2) AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, '<[a-zA-Z]+[^>]* href=\"([^\"]*)\"', 1)) AS v FROM pages) WHERE v LIKE '/_%'")
def link_classify(spark, sf_dir):
    found = links.extract_links(_sites(spark, sf_dir), "html").withColumn("c", links.classify_link(F.col("base_url"), F.col("page_url"), F.col("value")))
    return found.where("c.kind IS NOT NULL").select("page_id", "c.kind", "c.target")


HOSTS = ["example.com", "m.thernd.example.com", "ththnd.example.net", "tionsh.example.net"]


@query("SELECT page_id, CASE WHEN regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) IN ('" + "', '".join(HOSTS) + "') THEN NULL ELSE 'host_not_allowed' END AS error FROM pages")
def host_allowlist(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", links.address_error(F.col("url"), HOSTS).alias("error"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || CASE WHEN regexp_matches(p, '[.]html?$') THEN regexp_extract(p, '^(.*/)', 1) WHEN ends_with(p, '/') THEN p ELSE p || '/' END AS base_url,
CASE WHEN regexp_matches(p, '[.]html?$') THEN regexp_extract(p, '([^/]*)$', 1) ELSE 'index.htm' END AS index_name FROM (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)""")
def event_locations(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", links.event_location(F.col("url")).alias("l")).select("page_id", "l.base_url", "l.index_name")


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\\s+', ' ', 'g')) AS visible FROM pages""")
def page_visible_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tables.visible_text(F.col("html")).alias("visible"))


@query("""SELECT regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS event_id, count(*) AS files, count(*) FILTER (regexp_matches(lower(url), '[.]html?$')) AS html, 0 AS pdf FROM pages GROUP BY 1""")
def url_stats(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(links.host_of(F.col("url")).alias("event_id"), F.col("url").alias("rel"), F.lit("dir").alias("scope"))
    return files.scan_stats(p).select("event_id", "files", "html", "pdf")


# -- texts ---------------------------------------------------------------------------------


@query("""SELECT doc_id, trim(regexp_replace(replace(strip_accents(lower(text)), 'ß', 'ss'), '\\s+', ' ', 'g')) AS folded FROM documents""")
def fold_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.fold_text(F.col("text")).alias("folded"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT DISTINCT doc_id, CAST(line_no AS INTEGER) AS line_no, item_id AS subject_idx FROM l JOIN benchmark b ON contains(line, b.text)""")
def residual_lines(spark, sf_dir):
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("subject_idx"), F.col("text").alias("term"))
    return verify.residual_lines(table(spark, sf_dir, "documents"), "doc_id", "text", terms)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
on_line AS (SELECT DISTINCT doc_id, CAST(line_no AS INTEGER) AS line_no, item_id AS subject_idx FROM l JOIN benchmark b ON contains(line, b.text))
SELECT * FROM on_line UNION ALL SELECT doc_id, CAST(0 AS INTEGER) AS line_no, item_id AS subject_idx FROM (SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))
WHERE (doc_id, item_id) NOT IN (SELECT (doc_id, subject_idx) FROM on_line)""")
def residual_items(spark, sf_dir):
    """Whole benchmark texts: by line, and as line 0 where an item only stands across lines."""
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("subject_idx"), F.col("text").alias("term"))
    return verify.residual_whole(table(spark, sf_dir, "documents"), "doc_id", "text", terms)


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def file_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", files.file_digest(F.col("text").cast("binary")).alias("digest"))


@query("""SELECT source AS event_id, sha256(unhex(string_agg(hex(encode(printf('%09d.txt', doc_id))) || '00' || sha256(text), '' ORDER BY doc_id))) AS snapshot FROM documents GROUP BY source""")
def snapshot_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return files.snapshot(docs.select(F.col("source").alias("event_id"), F.format_string("%09d.txt", "doc_id").alias("rel"), F.col("text").cast("binary").alias("content")))


@query("SELECT doc_id, CASE WHEN text = '' THEN '' ELSE string_agg(CASE WHEN unicode(c) > 127 THEN '&#x' || printf('%X', unicode(c)) || ';' ELSE c END, '' ORDER BY k) END AS encoded FROM (SELECT doc_id, text, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS k FROM documents) GROUP BY doc_id, text")
def entity_encode(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", codec.entities(F.col("text")).alias("encoded"))


@query(f"""SELECT doc_id, CASE WHEN contains(t, 'JUDGESDETAILSPERSKATER') THEN 'judges_details' WHEN contains(t, 'PANELOFJUDGES') THEN 'panel'
WHEN NOT contains(t, 'PRINTED:') THEN CASE WHEN contains(h, 'PODIUM') THEN 'podium' ELSE 'other' END
WHEN contains(t, 'RESULT') THEN CASE WHEN contains(t, 'SEGMENTSCORE') THEN 'segment_results' ELSE 'results' END ELSE 'other' END AS type
FROM (SELECT doc_id, upper(regexp_replace(replace(text, 'pathetic', 'printed: result'), '\\s+', '', 'g')) AS t, upper(regexp_replace(replace(substr(text, 1, CAST(ceil(length(text) * {protocol.TOP}) AS INTEGER)), 'stupid', 'podium'), '\\s+', '', 'g')) AS h FROM documents)""")
def plan_classify(spark, sf_dir):
    """A text's top is a share of it, as protocol.TOP is one of the page."""
    share = F.substring(F.col("text"), F.lit(1), F.ceil(F.length("text") * protocol.TOP).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("pathetic"), F.lit("printed: result")).alias("t"), F.replace(share, F.lit("stupid"), F.lit("podium")).alias("h"))
    return docs.select("doc_id", protocol.page_type(F.col("t"), F.col("h")).alias("type"))


@query("""WITH a AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents), b AS (SELECT doc_id, unnest(string_split(replace(text, 'idiot', 'name'), ' ')) AS word FROM documents),
d AS ((SELECT doc_id, word, 1 AS s FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) UNION ALL (SELECT doc_id, word, -1 FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)))
SELECT doc_id, count(*) FILTER (s = 1) AS missing, count(*) FILTER (s = -1) AS added FROM d GROUP BY doc_id""")
def word_multiset_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    box = [F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")]
    words = lambda t: docs.select(F.lit("d").alias("rel"), F.col("doc_id").alias("page"), *box, F.explode(F.split(t, " ", -1)).alias("word"))
    none = spark.createDataFrame([], "rel string, page long, boxes array<struct<x0:double,y0:double,x1:double,y1:double>>")
    found = verify.word_checks(words(F.col("text")), words(F.replace("text", F.lit("idiot"), F.lit("name"))), none, none)
    return found.where("NOT ok").select(F.col("page").alias("doc_id"), "missing", "added")


@query("SELECT sha256(d.text) AS sha256 FROM documents d JOIN labels USING (doc_id) WHERE quality = 0 EXCEPT SELECT sha256(d.text) FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS DISTINCT FROM 0")
def pattern_set_ops(spark, sf_dir):
    images = table(spark, sf_dir, "documents").select(F.lit("p").alias("rel"), F.col("doc_id").alias("page"), F.sha2("text", 256).alias("sha256"))
    removed = table(spark, sf_dir, "labels").where("quality = 0").select(F.lit("p").alias("rel"), (F.col("doc_id") + 1).alias("page"), F.lit("remove_page").alias("action")).distinct()
    return protocol.removed_only_images(images, removed).select("sha256")


# -- events --------------------------------------------------------------------------------

_WHO = """WITH who AS (SELECT 'ev' || c_nationkey AS event_id, list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) AS cat_no, c_mktsegment AS segment, c_custkey,
['Aino', 'Émile', 'Jürgen'][c_custkey % 3 + 1] AS given, upper(c_name) AS family, n_name AS club, c_acctbal < 0 AS withdrawn, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS ordinal
FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(_WHO + " SELECT event_id, CAST(cat_no AS INTEGER) AS number, segment AS name, printf('CAT%03dEN.htm', cat_no) AS entries, printf('CAT%03dRS.htm', cat_no) AS result FROM who GROUP BY ALL")
def event_index(spark, sf_dir):
    return generate.category_pages(events.files(spark, sf_dir))[0].select("event_id", "number", "name", "entries", "result")


@query(_WHO + " SELECT event_id, 'c' || cat_no || '-s' || ordinal AS person_id, given || ' ' || family AS name, club, CASE WHEN withdrawn THEN 'WD' ELSE '' END AS status, 2 AS n_sources FROM who")
def event_catalog(spark, sf_dir):
    people = generate.catalogue(events.files(spark, sf_dir))[2]
    return people.select("event_id", "person_id", "name", "club", "status", F.size("sources").alias("n_sources"))


def _run(spark, sf_dir) -> generate.Run:
    all_ = events.files(spark, sf_dir)
    found = generate.catalogue(all_)
    chosen = events.selection(spark, sf_dir, found[2])
    urls = all_.select("event_id").distinct().withColumn("event_url", F.concat(F.lit(f"{events.HOST}/"), "event_id", F.lit("/index.htm")))
    return generate.generate(all_, urls, chosen, found)


@query(_WHO + """ SELECT event_id, printf('CAT%03d', cat_no) || s || '.htm' AS rel, CAST(ordinal - 1 AS INTEGER) AS row_no, CASE WHEN withdrawn THEN 'Nimi poistettu pyynnöstä' WHEN s = 'EN' THEN given || ' ' || family ELSE family || ', ' || given END AS name,
CASE WHEN withdrawn THEN '' ELSE club END AS club FROM who, (VALUES ('EN'), ('RS')) v(s) WHERE (event_id, cat_no) IN (SELECT event_id, cat_no FROM who WHERE withdrawn)""")
def event_redact(spark, sf_dir):
    changed = _run(spark, sf_dir).changed
    rows = tables.person_rows(changed.select("event_id", "rel", codec.decoded(F.col("content"))["text"].alias("text")))
    return rows.select("event_id", "rel", "row_no", "name", "club")


@query(_WHO + """ SELECT event_id, printf('CAT%03d', cat_no) || s || '.htm' AS rel, CAST(count(*) AS INTEGER) AS rows, CAST(count(*) AS INTEGER) AS rows_after, CAST(count(*) FILTER (withdrawn) AS INTEGER) AS redacted_rows, true AS ok
FROM who, (VALUES ('EN'), ('RS')) v(s) GROUP BY event_id, cat_no, s HAVING count(*) FILTER (withdrawn) > 0""")
def event_invariance(spark, sf_dir):
    return _run(spark, sf_dir).checks.select("event_id", "rel", "rows", "rows_after", "redacted_rows", "ok")


@query(_WHO + """, sel AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY cat_no, ordinal) - 1 AS name_idx FROM who WHERE withdrawn)
SELECT event_id, printf('CAT%03d', cat_no) || s || '.htm' AS rel, 'line ' || (ordinal + 4) AS location, CAST(name_idx AS INTEGER) AS name_idx FROM sel, (VALUES ('EN'), ('RS')) v(s)""")
def event_residual(spark, sf_dir):
    """Leftovers of the selected names in the pages before any redaction."""
    all_ = events.files(spark, sf_dir)
    people = generate.catalogue(all_)[2]
    names = catalog.unique_names(catalog.resolve_selection(people, events.selection(spark, sf_dir, people)))
    patterns = names.select("event_id", "name_idx", text.search_pattern(F.col("name")).alias("pattern"))
    return verify.residual_texts(all_, patterns)


@query(_WHO + " SELECT event_id, true AS ok, 0 AS n_leaks, count(*) FILTER (withdrawn) AS n_people FROM who GROUP BY event_id")
def event_report(spark, sf_dir):
    run = _run(spark, sf_dir)
    patterns = run.names.select("event_id", "name_idx", text.search_pattern(F.col("name")).alias("pattern"))
    leaks = report.leaks(run.manifest, patterns).groupBy("event_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    people = run.selected.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_people"))
    out = run.manifest.join(leaks, "event_id", "left").join(people, "event_id", "left")
    return out.select("event_id", "ok", F.coalesce("n", F.lit(0)).alias("n_leaks"), F.coalesce("n_people", F.lit(0).cast("long")).alias("n_people"))


@query()
def event_snapshot(spark, sf_dir):
    return files.snapshot(events.files(spark, sf_dir))


@query(_WHO + " SELECT DISTINCT event_id, 'index.htm' AS rel FROM who UNION SELECT event_id, printf('CAT%03d', cat_no) || s || '.htm' FROM who, (VALUES ('EN'), ('RS')) v(s)")
def event_reachable(spark, sf_dir):
    all_ = events.files(spark, sf_dir)
    pages = all_.select("event_id", "rel", F.concat(F.lit(f"{events.HOST}/"), "event_id", F.lit("/")).alias("base_url"), codec.decoded(F.col("content"))["text"].alias("text"))
    found = files.links_of(pages).where("kind = 'dir'").select("event_id", "rel", "target")
    return files.reachable(found, all_.where("rel = 'index.htm'").select("event_id", "rel"))
