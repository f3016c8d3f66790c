"""Driver queries: the engine's operators over the synthetic tables, each with the same in SQL.

``documents`` stand for files (``source`` is the folder), ``labels`` for stored statuses, ``pages``
for HTML documents. Other tables lend columns as synthetic geometry, levels, flags and colours:
such queries test the mechanics of an operator, not accessibility.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import scalar as S
from ..functions import text as X
from ..operators import anchors, headings, issues, pdf_rules, report, slide_rules, status
from ..schema import REPAIRS
from ..sources import builders, trees
from . import api
from .catalog import query, table

STATUS_SQL = "CASE WHEN l.doc_id IS NULL THEN 'Untested' WHEN l.quality = 0 THEN 'Not Accessible' WHEN l.toxic = 1 THEN 'Manual Testing Required' ELSE 'Accessible' END"
FILES_SQL = f"SELECT d.doc_id, d.source, d.lang, {STATUS_SQL} AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
REPORT_SQL = f"""SELECT source, count(*) AS num_files, count(*) FILTER (WHERE status = 'Accessible') AS num_accessible, count(*) FILTER (WHERE status = 'Untested') AS num_untested,
count(*) FILTER (WHERE status = 'Manual Testing Required') AS num_manual, count(*) FILTER (WHERE status = 'Not Accessible') AS num_inaccessible,
floor(1000.0::DOUBLE * count(*) FILTER (WHERE status = 'Accessible') / count(*) + 0.5) / 10 AS rate FROM ({FILES_SQL}) GROUP BY source"""
ICON_SQL = "CASE status WHEN 'Accessible' THEN 'pass' WHEN 'Not Accessible' THEN 'fail' WHEN 'Untested' THEN 'untested' WHEN 'Manual Testing Required' THEN 'manual' ELSE 'none' END"


def files(spark, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, status."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    stored = F.when(F.col("quality") == 0, "Not Accessible").when(F.col("toxic") == 1, "Manual Testing Required").otherwise("Accessible")
    store = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), stored.alias("status"))
    return status.lookup(docs.withColumnRenamed("doc_id", "path"), store).withColumnRenamed("path", "doc_id")


@query(REPORT_SQL)
def folder_report(spark, sf_dir):
    return report.folder_report(files(spark, sf_dir), "source")


@query(f"""WITH r AS ({REPORT_SQL}) SELECT source, 'Accessible' AS slice, num_accessible AS n FROM r UNION ALL SELECT source, 'Not Accessible', num_inaccessible FROM r
UNION ALL SELECT source, 'Untested', num_untested FROM r UNION ALL SELECT source, 'Manual', num_manual FROM r""")
def folder_report_pie(spark, sf_dir):
    return report.pie(report.folder_report(files(spark, sf_dir), "source"), "source")


@query(f"SELECT doc_id, source, status, {ICON_SQL} AS icon, CASE status WHEN 'Accessible' THEN 'Accessible' WHEN 'Not Accessible' THEN 'Not accessible' ELSE 'Not Tested' END AS icon_text FROM ({FILES_SQL})")
def list_folder_status(spark, sf_dir):
    return report.with_icons(files(spark, sf_dir)).drop("lang")


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[^:]*://', ''), '[?#].*$', '') AS path FROM pages), q AS (SELECT page_id, string_split(regexp_replace(path, '/?[^/]*$', ''), '/') AS s FROM p),
f AS (SELECT array_to_string(s[1:n], '/') AS folder, page_id FROM (SELECT *, unnest(range(1, len(s) + 1)) AS n FROM q))
SELECT folder, count(*) AS num_files, count(*) FILTER (WHERE page_id % 3 = 0) AS num_accessible, count(*) FILTER (WHERE page_id % 3 = 1) AS num_untested, 0::BIGINT AS num_manual,
count(*) FILTER (WHERE page_id % 3 = 2) AS num_inaccessible, floor(1000.0::DOUBLE * count(*) FILTER (WHERE page_id % 3 = 0) / count(*) + 0.5) / 10 AS rate FROM f GROUP BY folder""")
def folder_tree_report(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[^:]*://", ""), "[?#].*$", "")
    told = F.element_at(F.array(F.lit("Accessible"), F.lit("Untested"), F.lit("Not Accessible")), (F.col("page_id") % 3 + 1).cast("int"))
    return report.tree_report(table(spark, sf_dir, "pages").select(path.alias("path"), told.alias("status")))


@query(f"""SELECT doc_id, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS kind_rank, status <> 'Untested' AS success, status, count(*) OVER (PARTITION BY lang) AS num_files
FROM ({FILES_SQL}) WHERE lang IN ('en', 'fr', 'de')""")
def batch_results(spark, sf_dir):
    kind = F.when(F.col("lang") == "en", "word").when(F.col("lang") == "fr", "pdf").when(F.col("lang") == "de", "powerpoint").otherwise("other")
    rows = report.in_batch_order(files(spark, sf_dir).withColumn("kind", kind))
    totals = rows.groupBy("kind_rank").agg(F.count("*").alias("num_files"))  # three rows: each file then looks its total up
    return rows.join(F.broadcast(totals), "kind_rank").select("doc_id", "kind_rank", (F.col("status") != "Untested").alias("success"), "status", "num_files")


@query(f"SELECT doc_id, status, CASE WHEN status = 'Accessible' THEN 'Not Accessible' ELSE 'Accessible' END AS next_status FROM ({FILES_SQL})")
def status_toggle(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", "status", S.toggled(F.col("status")).alias("next_status"))


@query("SELECT user_id AS path, event_type AS status, event_id AS version FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def status_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("status"), F.col("event_id").alias("version"), "ts")
    return status.upsert(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"), order=("ts", "version")).drop("ts")


@query("""SELECT event_id, CASE WHEN s IN ('Accessible', 'Not Accessible', 'Manual Testing Required') THEN s ELSE 'Untested' END AS status
FROM (SELECT event_id, CASE json_extract_string(props, '$.k')::INT % 5 WHEN 0 THEN 'Accessible' WHEN 1 THEN 'Not Accessible' WHEN 2 THEN 'Manual Testing Required' WHEN 3 THEN 'Other' END AS s FROM events)""")
def metadata_json_status(spark, sf_dir):
    """Keywords are made from the events' JSON; every fifth is not JSON at all."""
    k = F.get_json_object("props", "$.k").cast("int") % 5
    told = F.when(k == 0, "Accessible").when(k == 1, "Not Accessible").when(k == 2, "Manual Testing Required").when(k == 3, "Other")
    keywords = F.when(k == 4, F.lit("not json")).otherwise(F.concat(F.lit('{"isAccessible": "'), told, F.lit('"}')))
    return table(spark, sf_dir, "events").select("event_id", S.keyword_status(keywords).alias("status"))


def score_sql(groups: tuple[tuple[str, ...], ...]) -> str:
    return " + ".join(f"regexp_matches(text, '(?i)\\b({'|'.join(g)})\\b')::INT" for g in groups)


@query(f"SELECT doc_id, {score_sql(X.FRENCH)} AS fr_score, {score_sql(X.ENGLISH)} AS en_score, CASE WHEN {score_sql(X.FRENCH)} > {score_sql(X.ENGLISH)} THEN 'fr' ELSE 'en' END AS detected FROM documents")
def detect_language(spark, sf_dir):
    scored = table(spark, sf_dir, "documents").select("doc_id", X.scores(F.col("text")).alias("s"))
    scored = scored.select("doc_id", F.col("s.fr").alias("fr_score"), F.col("s.en").alias("en_score"))
    return scored.withColumn("detected", F.when(F.col("fr_score") > F.col("en_score"), "fr").otherwise("en"))


@query(f"SELECT lang, CASE WHEN {score_sql(X.FRENCH)} > {score_sql(X.ENGLISH)} THEN 'fr' ELSE 'en' END AS detected, count(*) AS n FROM documents GROUP BY 1, 2")
def language_confusion(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang", X.detect_language(F.col("text")).alias("detected")).agg(F.count("*").alias("n"))


SUBSTANTIAL_SQL = r"""length(regexp_replace(line, '^\s+|\s+$', '', 'g')) > 3 AND NOT regexp_matches(line, '^[0-9\s.,;:!?()\[\]{}''"<>/\\|@#$%^&*_=+-]*$')"""
LINES_SQL = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents"


def lines(spark, sf_dir: str) -> DataFrame:
    """Lines of documents as text items."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.explode(F.split("text", "\n")).alias("text"))


@query(f"SELECT doc_id, count(*) AS n_items, count(*) FILTER (WHERE {SUBSTANTIAL_SQL}) AS n_substantial, bool_or({SUBSTANTIAL_SQL}) AS any_substantial FROM ({LINES_SQL}) GROUP BY doc_id")
def substantial_text(spark, sf_dir):
    good = X.is_substantial(F.col("text"))
    return lines(spark, sf_dir).groupBy(F.col("path").alias("doc_id")).agg(F.count("*").alias("n_items"), F.count_if(good).alias("n_substantial"), F.bool_or(good).alias("any_substantial"))


@query(f"SELECT doc_id, '3.1.2' AS criterion, count(*)::VARCHAR AS n FROM ({LINES_SQL}) WHERE length(line) > 10 GROUP BY doc_id")
def language_of_parts(spark, sf_dir):
    found = pdf_rules.language_of_parts(lines(spark, sf_dir))
    return found.select(F.col("path").alias("doc_id"), "criterion", F.col("detail.n").alias("n"))


LINKS_SQL = """SELECT page_id, i::INT AS pos, u[i] AS url, regexp_replace(t[i], '(?s)<[^>]*>', '', 'g') AS text FROM (SELECT page_id, u, t, unnest(range(1, len(u) + 1)) AS i FROM (SELECT page_id,
regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1) AS u, regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2) AS t FROM pages))""".replace("\\\\", "\\")
UNCLEAR_SQL = "(text = '' OR length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 5 OR contains(lower(text), 'http') OR contains(lower(text), 'www'))".replace("\\\\", "\\")


def page_links(spark, sf_dir: str) -> DataFrame:
    """page_id, pos, url, text."""
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(M.links(F.col("html"))).alias("pos", "link"))
    return found.select("page_id", (F.col("pos") + 1).alias("pos"), "link.url", "link.text")


@query(LINKS_SQL)
def extract_links(spark, sf_dir):
    return page_links(spark, sf_dir)


@query(f"SELECT page_id, pos, text FROM ({LINKS_SQL}) WHERE {UNCLEAR_SQL}")
def link_purpose(spark, sf_dir):
    return page_links(spark, sf_dir).where(X.unclear_link(F.col("text"))).select("page_id", "pos", "text")


@query(f"SELECT page_id, count(*) AS n, array_to_string((list(text ORDER BY pos))[1:3], '; ') AS examples FROM ({LINKS_SQL}) WHERE {UNCLEAR_SQL} GROUP BY page_id")
def link_examples(spark, sf_dir):
    links = page_links(spark, sf_dir).select(F.col("page_id").alias("path"), F.lit(1).alias("page"), F.col("pos").alias("ann_ord"), F.col("text").alias("link_text"))
    return pdf_rules.unclear_links(links).withColumnRenamed("path", "page_id")


@query(f"SELECT page_id, pos, url FROM (SELECT page_id, pos, url, CASE WHEN pos % 3 = 0 THEN url WHEN pos % 3 = 1 THEN 'http ' || text ELSE text END AS text FROM ({LINKS_SQL})) WHERE trim(text) <> '' AND url <> '' AND (trim(text) = url OR starts_with(trim(text), 'http'))")
def raw_url_links(spark, sf_dir):
    """Every third link shows its address and every third a text that starts like one."""
    shown = F.when(F.col("pos") % 3 == 0, F.col("url")).when(F.col("pos") % 3 == 1, F.concat(F.lit("http "), F.col("text"))).otherwise(F.col("text"))
    return page_links(spark, sf_dir).where(X.raw_url_link(shown, F.col("url"))).select("page_id", "pos", "url")


TITLE_SQL = "nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '')"


@query(f"SELECT page_id, {TITLE_SQL} AS title, {TITLE_SQL} IS NULL OR page_id % 7 = 0 AS missing FROM pages")
def page_title(spark, sf_dir):
    """Every seventh page is read as if it had an empty title."""
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), M.title(F.col("html")).alias("found"))
    meta = rows.withColumn("title", F.when(F.col("path") % 7 == 0, "").otherwise(F.col("found")))
    bad = pdf_rules.title_missing(meta).select("path", F.lit(True).alias("missing"))
    return meta.join(bad, "path", "left").select(F.col("path").alias("page_id"), F.col("found").alias("title"), F.coalesce("missing", F.lit(False)).alias("missing"))


@query("""SELECT lang, count(*) AS n, count(*) FILTER (WHERE lang IS NULL) AS n_missing FROM (SELECT CASE WHEN page_id % 5 = 0 THEN NULL ELSE regexp_extract(html, '(?is)<html[^>]*?\\slang="([^"]*)"', 1) END AS lang FROM pages) GROUP BY lang""".replace("\\\\", "\\"))
def page_lang(spark, sf_dir):
    """Every fifth page is read as if it had no language."""
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.when(F.col("page_id") % 5 != 0, M.language(F.col("html"))).alias("language"))
    bad = pdf_rules.language_missing(rows).select("path", F.lit(1).alias("bad"))
    return rows.join(bad, "path", "left").groupBy(F.col("language").alias("lang")).agg(F.count("*").alias("n"), F.count("bad").alias("n_missing"))


@query("SELECT page_id, try_cast(nullif(regexp_extract(u, 'objId=(\\d+)', 1), '') AS BIGINT) AS node_id FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '&objId=' || page_id ELSE url END AS u FROM pages)".replace("\\\\", "\\"))
def url_objid(spark, sf_dir):
    url = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("&objId="), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", S.node_id(url).alias("node_id"))


@query("SELECT page_id, string_split(url, '/')[-1] AS name, regexp_extract(replace(url, '/', chr(92)), '([^\\\\/]*)$', 1) AS name_any, replace(replace(url, '/', chr(92)), chr(92), '/') AS path, regexp_replace(url, '/?[^/]*$', '') AS folder FROM pages")
def base_name(spark, sf_dir):
    url = F.col("url")
    back = F.translate(url, "/", "\\")
    return table(spark, sf_dir, "pages").select("page_id", S.base_name(url).alias("name"), S.base_name_any(back).alias("name_any"), S.slashes(back).alias("path"), S.folder_of(url).alias("folder"))


@query("SELECT doc_id, CASE WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576.0::DOUBLE) ELSE printf('%d bytes', n) END AS size FROM (SELECT doc_id, n_chars * 300 AS n FROM documents)")
def format_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.format_size(F.col("n_chars") * 300).alias("size"))


KIND_SQL = "CASE lower(regexp_extract(name, '(\\.[^.]*)$', 1)) WHEN '.docx' THEN 'word' WHEN '.pdf' THEN 'pdf' WHEN '.pptx' THEN 'powerpoint' ELSE 'other' END".replace("\\\\", "\\")


@query(f"SELECT kind, strict, count(*) AS n FROM (SELECT {KIND_SQL} AS kind, {KIND_SQL.replace('lower(regexp_extract', '(regexp_extract')} AS strict FROM (SELECT doc_id || CASE doc_id % 6 WHEN 0 THEN '.docx' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.pdf' WHEN 3 THEN '.pptx' WHEN 4 THEN '.txt' ELSE '' END AS name FROM documents)) GROUP BY 1, 2")
def file_kinds(spark, sf_dir):
    suffix = F.element_at(F.array(*map(F.lit, (".docx", ".DOCX", ".pdf", ".pptx", ".txt", ""))), (F.col("doc_id") % 6 + 1).cast("int"))
    name = F.concat(F.col("doc_id").cast("string"), suffix)
    return table(spark, sf_dir, "documents").groupBy(S.kind_of(name).alias("kind"), S.kind_of(name, case_sensitive=True).alias("strict")).agg(F.count("*").alias("n"))


ANCHOR_SQL = f"""WITH r AS ({LINKS_SQL}), g AS (SELECT page_id, (pos - 1) // 4 AS para, pos, text FROM r), w AS (SELECT *, string_agg(text, '') OVER (PARTITION BY page_id, para ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM g),
t AS (SELECT page_id, max(CASE WHEN pos = 2 THEN text END) AS a, max(CASE WHEN pos = 3 THEN substr(text, 2, 3) END) AS b, max(CASE WHEN pos = 2 THEN text END) || max(CASE WHEN pos = 3 THEN text END) AS c FROM g GROUP BY page_id),
x AS (SELECT page_id, 1 AS target_id, a AS target FROM t WHERE a IS NOT NULL UNION ALL SELECT page_id, 2, b FROM t WHERE b IS NOT NULL UNION ALL SELECT page_id, 3, c FROM t WHERE c IS NOT NULL UNION ALL SELECT page_id, 4, '?none?' FROM t),
m AS (SELECT x.page_id, x.target_id, CASE WHEN w.text = x.target THEN 1 WHEN contains(w.text, x.target) THEN 2 WHEN contains(w.running, x.target) THEN 3 END AS tier, w.para, w.pos FROM x JOIN w ON x.page_id = w.page_id),
b AS (SELECT page_id, target_id, tier, para, pos, row_number() OVER (PARTITION BY page_id, target_id ORDER BY tier, para, pos) AS k FROM m WHERE tier IS NOT NULL)
SELECT x.page_id, x.target_id, x.target, b.tier, b.para::INT AS para_ord, b.pos AS run_ord FROM x LEFT JOIN b ON x.page_id = b.page_id AND x.target_id = b.target_id AND b.k = 1"""


@query(ANCHOR_SQL)
def comment_anchor(spark, sf_dir):
    """Links of a page are its runs, four in a paragraph; targets are a text, a part, two in a row, and none."""
    runs = page_links(spark, sf_dir).select(F.col("page_id").alias("path"), ((F.col("pos") - 1) / 4).cast("int").alias("para_ord"), F.col("pos").alias("run_ord"), "text")
    at = lambda n: F.max(F.when(F.col("run_ord") == n, F.col("text")))
    picked = runs.groupBy("path").agg(at(2).alias("a"), F.substring(at(3), 2, 3).alias("b"), F.concat(at(2), at(3)).alias("c"))
    targets = picked.selectExpr("path", "stack(4, 1, a, 2, b, 3, c, 4, '?none?') as (target_id, target)").where("target is not null")
    return anchors.find_anchors(targets, runs).withColumnRenamed("path", "page_id")


@query("SELECT d.doc_id, coalesce(c.m, 0) + 1 AS next_id FROM documents d LEFT JOIN (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY conv_id) c ON d.doc_id = c.conv_id")
def next_comment_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"))
    comments = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("id"))
    return anchors.next_comment_ids(docs, comments).withColumnRenamed("path", "doc_id")


@query(r"SELECT conv_id, regexp_replace(string_agg(text, '' ORDER BY turn, text), '^\s+|\s+$', '', 'g') AS text FROM conversations GROUP BY conv_id")
def paragraph_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(X.ordered_join(["turn"], "text", "").alias("text"))
    return rows.select("conv_id", X.trimmed(F.col("text")).alias("text"))


LEVELS_SQL = "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos, nullif((l_partkey % 6)::INT, 5) AS level FROM lineitem"


def synthetic_levels(spark, sf_dir: str) -> DataFrame:
    """Lines of an order as headings; level is null where a style has no number."""
    pos = F.expr("row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), pos.alias("pos"), F.nullif((F.col("l_partkey") % 6).cast("int"), F.lit(5)).alias("level"))


HEADING_STEP = """CASE WHEN o.level < 1 THEN 1001 WHEN f.at = -1 THEN 0 WHEN f.at = 0 THEN (CASE WHEN o.level = 1 THEN 0 ELSE 1002 END) WHEN o.level = 1 THEN 1003 WHEN o.level <= f.at + 1 THEN 0 ELSE 1004 END"""


@query(f"""WITH RECURSIVE o AS ({LEVELS_SQL}), f AS (SELECT l_orderkey, 0::BIGINT AS pos, NULL::INT AS level, -1 AS at, 0 AS code FROM (SELECT DISTINCT l_orderkey FROM o)
UNION ALL SELECT o.l_orderkey, o.pos, o.level, CASE WHEN {HEADING_STEP} <> 0 THEN f.at WHEN f.at = -1 AND o.level IS DISTINCT FROM 1 THEN 0 ELSE o.level END, {HEADING_STEP} FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.pos = f.pos + 1)
SELECT l_orderkey, pos::INT AS pos, level, code FROM f WHERE code <> 0""")
def heading_hierarchy(spark, sf_dir):
    return headings.check_headings(synthetic_levels(spark, sf_dir)).withColumnRenamed("path", "l_orderkey")


@query("""SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::INT AS pos, (l_partkey % 4)::INT AS level
FROM lineitem WHERE l_partkey % 4 > 0 AND l_returnflag <> 'N'""")
def heading_positions(spark, sf_dir):
    """Style ids in either case, some without a number and some no headings; blank texts do not count."""
    row = F.expr("row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)")
    level = (F.col("l_partkey") % 4).cast("string")
    style = F.when(level == "0", "Normal").when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("Heading"), level)).otherwise(F.concat(F.lit("heading "), level))
    paragraphs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), row.alias("para_ord"), style.alias("style_id"), F.when(F.col("l_returnflag") == "N", "  ").otherwise(F.col("l_returnflag")).alias("text"))
    return headings.docx_headings(paragraphs).select(F.col("path").alias("l_orderkey"), "pos", "level")


FIELDS_SQL = "SELECT event_id, user_id, event_type, value, json_extract_string(props, '$.k')::INT AS k, (event_id % 3)::INT AS page FROM events"


def synthetic_fields(spark, sf_dir: str) -> DataFrame:
    """Events as form fields of their user's document."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("path"), (F.col("event_id") % 3).cast("int").alias("page"), F.col("event_id").cast("int").alias("ann_ord"), F.lit("Widget").alias("subtype"),
        F.when(F.col("event_type") != "error", "Tx").alias("field_type"), F.when(k % 3 == 0, "").when(k % 3 == 1, "label").alias("alt_text"), F.when(k % 5 == 0, "caption").alias("field_label"),
        F.when(k % 7 > 0, k % 4).alias("field_flags"), F.when(k % 4 > 0, k % 10).alias("tab_index"), F.when(F.col("value") > 5, F.array(F.lit(0.0), F.lit(0.0), F.col("value"), F.lit(1.0))).alias("rect"),
    )


@query(f"SELECT event_id::INT AS event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN k % 4 > 0 THEN k % 10 END ASC NULLS LAST, page, event_id)::INT AS tab_place FROM ({FIELDS_SQL}) WHERE event_type <> 'error'")
def tab_order(spark, sf_dir):
    return pdf_rules.tab_order(synthetic_fields(spark, sf_dir)).select(F.col("ann_ord").alias("event_id"), "tab_place")


@query(f"SELECT user_id, count(*) FILTER (WHERE NOT (coalesce(k % 3, -1) = 1 OR k % 5 = 0))::VARCHAR AS n, count(*)::VARCHAR AS of FROM ({FIELDS_SQL}) WHERE event_type <> 'error' GROUP BY user_id HAVING count(*) FILTER (WHERE NOT (k % 3 = 1 OR k % 5 = 0)) > 0".replace("AS of ", 'AS "of" '))
def field_labels(spark, sf_dir):
    found = pdf_rules.field_labels(synthetic_fields(spark, sf_dir))
    return found.select(F.col("path").alias("user_id"), F.col("detail")["n"].alias("n"), F.col("detail")["of"].alias("of"))


FOCUS_SQL = "value > 5 AND (coalesce(CASE WHEN k % 7 > 0 THEN k % 4 END, 0) & 1) = 0"


@query(f'SELECT user_id, count(*) FILTER (WHERE NOT ({FOCUS_SQL}))::VARCHAR AS n, count(*)::VARCHAR AS "of" FROM ({FIELDS_SQL}) WHERE event_type <> \'error\' GROUP BY user_id HAVING count(*) FILTER (WHERE NOT ({FOCUS_SQL})) > 0')
def focus_visible(spark, sf_dir):
    found = pdf_rules.focus_visible(synthetic_fields(spark, sf_dir))
    return found.select(F.col("path").alias("user_id"), F.col("detail")["n"].alias("n"), F.col("detail")["of"].alias("of"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber AS page, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), g AS (SELECT l_orderkey, min(page) AS first_page, arg_min(n, page) AS n_fields FROM f GROUP BY 1)
SELECT o.o_orderkey, g.first_page IS NOT NULL AS is_form, g.first_page, g.n_fields, 100 AS confidence FROM orders o LEFT JOIN g ON o.o_orderkey = g.l_orderkey""")
def document_type(spark, sf_dir):
    """Orders are documents, line numbers pages, returned lines fields."""
    paths = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"))
    fields = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("page"), F.lit("Widget").alias("subtype"), F.when(F.col("l_returnflag") == "R", "Tx").alias("field_type"))
    return pdf_rules.document_type(paths, fields).withColumnRenamed("path", "o_orderkey")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity AS x, l_discount * 100 AS y FROM lineitem),
k AS (SELECT DISTINCT l_orderkey, l_linenumber, x, y FROM l WHERE l_partkey % 3 = 0), t AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, x, y, l_extendedprice) AS item_ord FROM l WHERE l_partkey % 3 <> 0)
SELECT k.l_orderkey, (k.l_linenumber * 100000 + k.x * 100 + round(k.y))::INT AS ann_ord, coalesce(string_agg('t' || t.l_partkey, ' ' ORDER BY t.item_ord), 'http://a') AS link_text
FROM k LEFT JOIN t ON t.l_orderkey = k.l_orderkey AND t.x BETWEEN k.x - 5 AND k.x + 3 + 5 AND t.y BETWEEN k.y - 5 AND k.y + 2 + 5 GROUP BY k.l_orderkey, k.l_linenumber, k.x, k.y""")
def link_text_range_join(spark, sf_dir):
    """Lines of an order are points on one page: a third of the parts are links, 3 wide and 2 high, the rest text."""
    base = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    links = base.where("l_partkey % 3 = 0").select("l_orderkey", "l_linenumber", "x", "y").distinct()
    ann = (F.col("l_linenumber") * 100000 + F.col("x") * 100 + F.round("y")).cast("int")
    links = links.select(F.col("l_orderkey").alias("path"), F.lit(1).alias("page"), ann.alias("ann_ord"), F.lit("Link").alias("subtype"), F.lit("http://a").alias("url"), F.array("x", "y", F.col("x") + 3, F.col("y") + 2).alias("rect"))
    item = F.expr("row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, x, y, l_extendedprice)")
    items = base.where("l_partkey % 3 <> 0").select(F.col("l_orderkey").alias("path"), F.lit(1).alias("page"), item.alias("item_ord"), F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("text"), "x", "y")
    return pdf_rules.link_texts(links, items).select(F.col("path").alias("l_orderkey"), "ann_ord", "link_text")


@query("""WITH r AS (SELECT c_nationkey AS slide, c_custkey % 20 AS id, arg_max(c_name, c_custkey) AS target FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1, 2)
SELECT o.o_orderkey, r.target FROM (SELECT o_orderkey, o_custkey % 25 AS slide, o_orderkey % 20 AS id FROM orders) o LEFT JOIN r ON o.slide = r.slide AND o.id = r.id""")
def rels_lookup(spark, sf_dir):
    """Customers are relationships of their nation's slide with repeated ids; orders are runs."""
    rels = table(spark, sf_dir, "customer").select(F.lit("deck").alias("path"), F.col("c_nationkey").alias("slide"), F.col("c_custkey").alias("rel_ord"), (F.col("c_custkey") % 20).cast("string").alias("rel_id"), F.when(F.col("c_mktsegment") == "BUILDING", "image").otherwise("x/hyperlink").alias("rel_type"), F.col("c_name").alias("target"))
    runs = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("deck").alias("path"), (F.col("o_custkey") % 25).cast("int").alias("slide"), (F.col("o_orderkey") % 20).cast("string").alias("link_id"))
    return slide_rules.link_targets(runs, rels).select("o_orderkey", "target")


FIGURES_SQL = "SELECT l_orderkey, l_linenumber AS page, arg_min('alt ' || l_partkey, (l_suppkey, l_partkey)) AS alt FROM lineitem WHERE l_returnflag = 'A' AND l_partkey % 2 = 0 GROUP BY 1, 2"


def synthetic_images(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One image on each of pages 1 to 3 of an order; lines are nodes of structure trees."""
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page")).withColumn("img_ord", F.lit(1))
    nodes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("page"), F.struct("l_suppkey", "l_partkey").alias("preorder"), F.when(F.col("l_returnflag") == "A", "Figure").otherwise("P").alias("role"), F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("alt "), F.col("l_partkey").cast("string"))).alias("alt"))
    return images, nodes


@query(f"SELECT o.o_orderkey, p.page, f.alt IS NOT NULL AS has_alt, f.alt FROM orders o CROSS JOIN (SELECT unnest([1, 2, 3]) AS page) p LEFT JOIN ({FIGURES_SQL}) f ON f.l_orderkey = o.o_orderkey AND f.page = p.page")
def image_alt_semi(spark, sf_dir):
    return pdf_rules.images_with_alt(*synthetic_images(spark, sf_dir)).select(F.col("path").alias("o_orderkey"), "page", "has_alt", "alt")


@query(f"SELECT o_orderkey, count(*)::VARCHAR AS n, string_agg(page::VARCHAR, ', ' ORDER BY page) AS pages FROM (SELECT o.o_orderkey, p.page, f.alt FROM orders o CROSS JOIN (SELECT unnest([1, 2, 3]) AS page) p LEFT JOIN ({FIGURES_SQL}) f ON f.l_orderkey = o.o_orderkey AND f.page = p.page) WHERE alt IS NULL GROUP BY o_orderkey")
def image_alt_issues(spark, sf_dir):
    found = pdf_rules.image_alt(*synthetic_images(spark, sf_dir))
    return found.select(F.col("path").alias("o_orderkey"), F.col("detail")["n"].alias("n"), F.col("detail")["pages"].alias("pages"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def empty_slides(spark, sf_dir):
    """Parts are slides; lines are shapes or pictures of their part, or of no kind that counts."""
    slides = table(spark, sf_dir, "part").select(F.lit("deck").alias("path"), F.col("p_partkey").alias("slide"))
    kind = F.when(F.col("l_quantity") >= 50, "sp").when(F.col("l_quantity") >= 49, "pic").otherwise("connector")
    shapes = table(spark, sf_dir, "lineitem").select(F.lit("deck").alias("path"), F.col("l_partkey").alias("slide"), kind.alias("kind"))
    return slide_rules.slides_without_content(slides, shapes).select(F.col("slide").alias("p_partkey"))


COLOUR_SQL = "printf('%02X%02X%02X', (p_partkey * 37 % 256)::INT, (p_size * 5 % 256)::INT, (p_partkey * 11 % 256)::INT)"


def channel_sql(expr: str) -> str:
    return f"(CASE WHEN {expr} / 255.0::DOUBLE <= 0.03928 THEN {expr} / 255.0::DOUBLE / 12.92 ELSE pow(({expr} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"


LUMINANCE_SQL = f"(0.2126 * {channel_sql('(p_partkey * 37 % 256)')} + 0.7152 * {channel_sql('(p_size * 5 % 256)')} + 0.0722 * {channel_sql('(p_partkey * 11 % 256)')})"


@query(f"SELECT p_partkey, {COLOUR_SQL} AS color, round(1.05 / ({LUMINANCE_SQL} + 0.05), 4) AS ratio, 1.05 / ({LUMINANCE_SQL} + 0.05) < 4.5 AS low FROM part")
def contrast_ratio(spark, sf_dir):
    colour = F.format_string("%02X%02X%02X", F.col("p_partkey") * 37 % 256, (F.col("p_size") * 5 % 256).cast("long"), F.col("p_partkey") * 11 % 256)
    rows = table(spark, sf_dir, "part").select("p_partkey", colour.alias("color")).withColumn("exact", S.contrast(F.col("color")))
    return rows.select("p_partkey", "color", F.round("exact", 4).alias("ratio"), (F.col("exact") < slide_rules.LEAST_CONTRAST).alias("low"))


@query("SELECT p_partkey FROM part WHERE p_type = 'SMALL' AND p_size % 3 <> 1")
def table_header_flag(spark, sf_dir):
    first = F.when(F.col("p_size") % 3 == 1, "1").when(F.col("p_size") % 3 == 2, "0")
    shapes = table(spark, sf_dir, "part").select(F.lit("deck").alias("path"), F.col("p_partkey").alias("slide"), F.lit(1).alias("ord"), (F.col("p_type") == "SMALL").alias("is_table"), first.alias("first_row"))
    found = slide_rules.table_header(shapes)
    return found.select(F.regexp_extract("location", r"slide (\d+)", 1).cast("long").alias("p_partkey"))


@query("SELECT DISTINCT p_brand AS brand, p_size AS slide FROM part EXCEPT SELECT p_brand, p_size FROM part WHERE p_type = 'SMALL'")
def slide_titles(spark, sf_dir):
    """Sizes are slides of their brand's deck; small parts are titles."""
    shapes = table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_size").alias("slide"), F.lit("sp").alias("kind"), F.when(F.col("p_type") == "SMALL", "title").otherwise("ctrTitle").alias("ph_type"))
    return slide_rules.slides_without_title(shapes.select("path", "slide").distinct(), shapes).withColumnRenamed("path", "brand")


REPAIR_SQL = "CASE " + " ".join(f"WHEN contains(c, '{number}') THEN '{priority}'" for number, priority, _, _ in REPAIRS) + " END"


@query(f"SELECT event_id, {REPAIR_SQL} AS priority FROM (SELECT event_id, 'Criterion ' || ['1.1.1', '2.4.2', '2.4.4', '3.1.1', '3.1.2', '3.3.2', '2.4.7', '9.9.9 and 1.1.1', '4.1.2', ''][(event_id % 10 + 1)::INT] AS c FROM events)")
def remediation_lookup(spark, sf_dir):
    told = F.array(*map(F.lit, ("1.1.1", "2.4.2", "2.4.4", "3.1.1", "3.1.2", "3.3.2", "2.4.7", "9.9.9 and 1.1.1", "4.1.2", "")))
    criterion = F.concat(F.lit("Criterion "), F.element_at(told, (F.col("event_id") % 10 + 1).cast("int")))
    return issues.repairs(table(spark, sf_dir, "events").select("event_id", criterion.alias("criterion"))).select("event_id", "priority")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'error') GROUP BY event_type")
def ignored_codes_anti(spark, sf_dir):
    return issues.without_ignored(table(spark, sf_dir, "events"), ("view", "error"), "event_type").groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"""WITH k AS ({LINKS_SQL}), u AS (SELECT page_id AS path, '2.4.2' AS criterion FROM pages WHERE page_id % 7 = 0 UNION ALL SELECT page_id, '3.1.1' FROM pages WHERE page_id % 5 = 0
UNION ALL SELECT page_id, '2.4.4' FROM k WHERE {UNCLEAR_SQL} GROUP BY page_id), n AS (SELECT path, count(*) AS n FROM u GROUP BY path)
SELECT p.page_id, coalesce(n.n, 0) AS n_issues, n.n IS NULL AS passed FROM pages p LEFT JOIN n ON p.page_id = n.path""")
def issues_union(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), M.title(F.col("html")).alias("title"), M.language(F.col("html")).alias("language"))
    meta = pages.withColumn("title", F.when(F.col("path") % 7 != 0, F.col("title"))).withColumn("language", F.when(F.col("path") % 5 != 0, F.col("language")))
    links = page_links(spark, sf_dir).select(F.col("page_id").alias("path"), F.lit(1).alias("page"), F.col("pos").alias("ann_ord"), F.col("text").alias("link_text"))
    unclear = issues.issue(pdf_rules.unclear_links(links), "pdf-link-purpose", F.lit("links"), n=F.col("n"), examples=F.col("examples"))
    found = issues.union_issues([pdf_rules.title_missing(meta), pdf_rules.language_missing(meta), unclear])
    return issues.counts_by_path(pages, found).withColumnRenamed("path", "page_id")


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 2 THEN p_partkey // 3 END AS parent_id, CASE WHEN p_size % 4 = 0 THEN 0 ELSE 144 END AS type FROM part),
w AS (SELECT id, 1 AS depth FROM n WHERE parent_id IS NULL UNION ALL SELECT n.id, w.depth + 1 FROM n JOIN w ON n.parent_id = w.id) SELECT w.id, w.depth FROM w JOIN n ON w.id = n.id WHERE n.type = 144""")
def remote_tree_walk(spark, sf_dir):
    """Parts as nodes of a tree: the documents below the roots."""
    key = F.col("p_partkey")
    nodes = table(spark, sf_dir, "part").select(key.alias("id"), F.when(key > 1, F.floor(key / 3)).alias("parent_id"), F.when(F.col("p_size") % 4 == 0, 0).otherwise(144).alias("type"))
    nodes = nodes.withColumn("parent_id", F.nullif("parent_id", F.lit(0)))
    return trees.walk(nodes).where("type = 144").select("id", "depth")


XMP_SQL = "CASE page_id % 4 WHEN 0 THEN '<dc:language>FR-ca</dc:language>' WHEN 1 THEN '<x/>' END"


@query(f"SELECT page_id, coalesce(nullif(lower(regexp_extract(coalesce({XMP_SQL}, ''), 'dc:language>([^<]+)<', 1)), ''), CASE page_id % 3 WHEN 0 THEN 'de' WHEN 1 THEN NULL END, 'en') AS language FROM pages")
def default_language(spark, sf_dir):
    k = F.col("page_id")
    xmp = F.when(k % 4 == 0, "<dc:language>FR-ca</dc:language>").when(k % 4 == 1, "<x/>")
    return table(spark, sf_dir, "pages").select("page_id", S.default_language(xmp, F.when(k % 3 == 0, "DE").when(k % 3 == 2, "")).alias("language"))


@query("SELECT page_id, i::INT AS pos, l[i]::INT AS level, regexp_replace(t[i], '(?s)<[^>]*>', '', 'g') AS text FROM (SELECT page_id, l, t, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 1) AS l, regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 2) AS t FROM pages))")
def page_headings(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(M.headings(F.col("html"))).alias("pos", "h"))
    return found.select("page_id", (F.col("pos") + 1).alias("pos"), "h.level", "h.text")




def tested(rows: DataFrame, path: str, kind: str, make, **columns) -> api.Audit:
    """Rows made into files, which are read and tested once each."""
    return api.audit_parsed(builders.build(rows, path, kind, make, read=True, **columns))


@query("SELECT doc_id::VARCHAR AS path, i::INT AS para_ord, s[i] AS text FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))")
def word_paragraphs(spark, sf_dir):
    """Documents are written as Word files, a paragraph for each line, and read back."""
    paragraphs = F.transform(F.split("text", "\n"), lambda t: F.struct(F.lit(None).cast("string").alias("style"), t.alias("text")))
    return tested(table(spark, sf_dir, "documents"), "doc_id", "word", builders.word, paragraphs=paragraphs).tables["paragraphs"].select("path", "para_ord", "text")


@query(f"""WITH RECURSIVE o AS ({LEVELS_SQL}), f AS (SELECT l_orderkey, 0::BIGINT AS pos, NULL::INT AS level, -1 AS at, 0 AS code FROM (SELECT DISTINCT l_orderkey FROM o)
UNION ALL SELECT o.l_orderkey, o.pos, o.level, CASE WHEN {HEADING_STEP} <> 0 THEN f.at WHEN f.at = -1 AND o.level IS DISTINCT FROM 1 THEN 0 ELSE o.level END, {HEADING_STEP} FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.pos = f.pos + 1)
SELECT l_orderkey::VARCHAR AS path, 'Accessible' AS status, count(*) FILTER (WHERE code <> 0) = 0 AS report_passed FROM f GROUP BY l_orderkey""")
def word_heading_audit(spark, sf_dir):
    """Orders as Word files whose lines are headings; heading errors fail the report and leave the status."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("rows"))  # lines are moved once
    level = lambda x: F.nullif((x["l_partkey"] % 6).cast("int"), F.lit(5)).cast("string")
    style = lambda x: F.concat(F.lit("Heading"), F.coalesce(level(x), F.lit("X")))
    paragraphs = F.transform("rows", lambda x, i: F.struct(style(x).alias("style"), (i + 1).cast("string").alias("text")))
    return tested(rows, "l_orderkey", "word", builders.word, paragraphs=paragraphs).results.select("path", "status", "report_passed")


DECK_SQL = "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS slide FROM conversations"


@query(f"""WITH s AS ({DECK_SQL}), i AS (SELECT conv_id, 'pptx-slide-title' AS rule_id FROM s WHERE turn % 2 = 1 UNION ALL SELECT conv_id, 'pptx-contrast' FROM s WHERE turn % 5 < 4 AND turn % 3 = 1
UNION ALL SELECT conv_id, 'pptx-raw-link' FROM s WHERE turn % 5 < 4 AND turn % 4 = 2 UNION ALL SELECT conv_id, 'pptx-image-alt' FROM s WHERE turn % 6 = 3 UNION ALL SELECT conv_id, 'pptx-empty-slide' FROM s WHERE turn % 2 = 1 AND turn % 5 = 4 AND turn % 6 <> 3)
SELECT conv_id::VARCHAR AS path, rule_id, count(*) AS n FROM i GROUP BY 1, 2""")
def deck_audit(spark, sf_dir):
    """Conversations as presentations, a slide for each turn, tested by all rules."""
    t = F.col("turn")
    slide = F.struct(
        "turn", "text", F.when(t % 2 == 0, F.lit("title")).alias("title"), F.when(t % 3 == 1, "777777").alias("color"), F.when(t % 5 < 4, F.when(t % 4 == 2, F.lit("http://a.example/x")).otherwise(F.lit("words"))).alias("shown"),
        F.when((t % 5 < 4) & (t % 4 == 2), F.lit("http://a.example/x")).alias("target"), F.when(t % 6 == 3, F.lit(" ")).alias("picture"),
    )
    decks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(slide)).alias("rows"))
    slides = F.transform("rows", lambda r: F.struct(r["title"].alias("title"), r["color"].alias("color"), r["shown"].alias("text"), r["target"].alias("target"), r["picture"].alias("picture")))
    found = tested(decks, "conv_id", "powerpoint", builders.deck, slides=slides).issues
    return found.groupBy("path", "rule_id").agg(F.count("*").alias("n"))


@query(f"""WITH k AS ({LINKS_SQL}), u AS (SELECT page_id, CASE WHEN trim(text) = '' THEN url ELSE trim(text) END AS text FROM k WHERE url <> ''),
i AS (SELECT page_id, 'pdf-title' AS rule_id, NULL AS n FROM pages WHERE page_id % 7 = 0 UNION ALL SELECT page_id, 'pdf-language', NULL FROM pages WHERE page_id % 5 = 0
UNION ALL SELECT page_id, 'pdf-link-purpose', count(*)::VARCHAR FROM u WHERE {UNCLEAR_SQL} GROUP BY page_id) SELECT page_id::VARCHAR AS path, rule_id, n FROM i""")
def pdf_audit(spark, sf_dir):
    """Pages as PDFs with their titles, languages and links, tested by all rules."""
    html, k = F.col("html"), F.col("page_id")
    title, lang = F.when(k % 7 == 0, F.lit("")).otherwise(M.title(html)), F.when(k % 5 != 0, M.language(html))
    return tested(table(spark, sf_dir, "pages"), "page_id", "pdf", builders.portable, title=title, language=lang, links=M.links(html)).issues.select("path", "rule_id", F.col("detail")["n"].alias("n"))


@query(f"""WITH k AS ({LINKS_SQL}), bad AS (SELECT page_id FROM pages WHERE page_id % 7 = 0 OR page_id % 5 = 0 UNION SELECT page_id FROM (SELECT page_id, CASE WHEN trim(text) = '' THEN url ELSE trim(text) END AS text FROM k WHERE url <> '') WHERE {UNCLEAR_SQL})
SELECT p.page_id::VARCHAR AS path, p.page_id % 11 <> 0 AS success, CASE WHEN p.page_id % 11 = 0 THEN 'Untested' WHEN b.page_id IS NULL THEN 'Manual Testing Required' ELSE 'Not Accessible' END AS status FROM pages p LEFT JOIN bad b ON p.page_id = b.page_id""")
def pdf_batch_with_faults(spark, sf_dir):
    """The same with every eleventh file cut to nothing: it stays Untested and the others are tested."""
    html, k = F.col("html"), F.col("page_id")
    title, lang = F.when(k % 7 == 0, F.lit("")).otherwise(M.title(html)), F.when(k % 5 != 0, M.language(html))
    files = builders.build(table(spark, sf_dir, "pages"), "page_id", "pdf", builders.portable, title=title, language=lang, links=M.links(html))
    cut = F.when(F.col("path").cast("long") % 11 == 0, F.lit(b"no file")).otherwise(F.col("content"))
    return api.audit(files.withColumn("content", cut)).results.select("path", "success", "status")


@query(f"SELECT doc_id, CASE status WHEN 'Accessible' THEN 'pass' WHEN 'Manual Testing Required' THEN 'manual' ELSE 'fail' END AS icon FROM ({FILES_SQL})")
def updated_icon(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", S.updated_icon(F.col("status")).alias("icon"))


@query("SELECT doc_id, coalesce(text, '') <> '' OR coalesce(lang, '') <> '' OR coalesce(source, '') <> '' AS has_metadata FROM documents")
def any_metadata(spark, sf_dir):
    """Columns of documents as title, language and author."""
    return table(spark, sf_dir, "documents").select("doc_id", S.has_metadata(F.col("text"), F.col("lang"), F.col("source")).alias("has_metadata"))


PROPERTY_SQL = """SELECT o_orderkey AS path, CASE o_orderkey % 3 WHEN 0 THEN 'word' WHEN 1 THEN 'pdf' ELSE 'other' END AS kind, p.value, m.keywords, m.encrypted, s.status AS stored FROM orders o
LEFT JOIN (SELECT l_orderkey, CASE WHEN max(l_linenumber) % 2 = 0 THEN '1' ELSE '0' END AS value FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey) p ON p.l_orderkey = o.o_orderkey
LEFT JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'Accessible' END AS keywords, o_orderstatus = 'P' AS encrypted FROM orders WHERE o_orderkey % 3 = 1) m ON m.k = o.o_orderkey
LEFT JOIN (SELECT o_orderkey AS k, 'Not Accessible' AS status FROM orders WHERE o_orderkey % 2 = 0) s ON s.k = o.o_orderkey"""


@query(f"""SELECT path, kind, CASE kind WHEN 'other' THEN 'Not Applicable' WHEN 'pdf' THEN CASE WHEN encrypted THEN coalesce(stored, 'Untested') ELSE coalesce(keywords, 'Untested') END
ELSE CASE value WHEN '1' THEN 'Accessible' WHEN '0' THEN 'Not Accessible' ELSE 'Untested' END END AS status FROM ({PROPERTY_SQL})""")
def decoded_status(spark, sf_dir):
    """Orders as files: lines are custom properties of Word files, of which the last counts; PDFs hold
    their status in their keywords, or in the store where they are encrypted."""
    key, orders = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    kind = F.when(key % 3 == 0, "word").when(key % 3 == 1, "pdf").otherwise("other")
    value = F.when(F.col("l_linenumber") % 2 == 0, "1").otherwise("0")
    props = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_linestatus") == "F", "isAccessible").otherwise("other").alias("name"), value.alias("value"))
    told = F.when(F.col("o_orderstatus") == "F", '{"isAccessible": "Accessible"}').otherwise("no json")
    meta = orders.where(key % 3 == 1).select(key.alias("path"), told.alias("keywords"), (F.col("o_orderstatus") == "P").alias("encrypted"))
    store = orders.where(key % 2 == 0).select(key.alias("path"), F.lit("Not Accessible").alias("status"))
    return status.decode(orders.select(key.alias("path"), kind.alias("kind")), props, meta, store)


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE c_mktsegment || '/' || c_name END AS path FROM customer")
def joined_path(spark, sf_dir):
    folder = F.when(F.col("c_custkey") % 4 == 0, "./").when(F.col("c_custkey") % 4 == 1, F.concat("c_mktsegment", F.lit("/"))).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.join_path(folder, F.col("c_name")).alias("path"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE url || '..' END AS context FROM pages WHERE url IS NOT NULL")
def context_text(spark, sf_dir):
    """Addresses as contexts of issues: three dots at the end go, two stay."""
    dots = F.when(F.col("page_id") % 2 == 0, "...").otherwise("..")
    return table(spark, sf_dir, "pages").where("url is not null").select("page_id", X.without_ellipsis(F.concat("url", dots)).alias("context"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_quantity::DOUBLE END AS x, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_linenumber END::DOUBLE AS y,
CASE WHEN l_linenumber = 7 THEN 0 ELSE 5 END::DOUBLE AS width, CASE WHEN l_linenumber = 7 THEN 0 ELSE 2 * l_linenumber END::DOUBLE AS height FROM lineitem""")
def rect_box(spark, sf_dir):
    """Quantities and line numbers as corners of fields; the seventh has none."""
    x, y = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    rect = F.when(F.col("l_linenumber") < 7, F.array(x, y, x + 5, 3 * y))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.rect_box(rect).alias("r")).select("l_orderkey", "l_linenumber", "r.*")


@query("""SELECT o_orderkey, n::VARCHAR || CASE WHEN n = 1 THEN ' image' ELSE ' images' END || ' on pages ' || pages AS message FROM
(SELECT l_orderkey AS o_orderkey, count(*) AS n, string_agg(l_linenumber::VARCHAR, ', ' ORDER BY l_linenumber) AS pages FROM lineitem GROUP BY 1)""")
def issue_message(spark, sf_dir):
    """Lines as pages with an image that has no description."""
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("l_linenumber")).alias("pages"))
    return found.select(F.col("l_orderkey").alias("o_orderkey"), issues.issue_message(F.col("n"), "image", F.col("pages")).alias("message"))
