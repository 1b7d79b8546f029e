"""Queries over raw pages: links, fragments, texts, blocks, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import cleaning as C
from lodestone.sources.tables import table

#: Where the content of these pages begins and ends.
START, END = ("<article[^>]*>", "<main[^>]*>"), ("<footer", "</article>")


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "url", "html")


def _texts(spark, sf_dir):
    return _pages(spark, sf_dir).select(F.col("page_id").alias("id"), T.html_text(T.fragment(F.col("html"), START, END)).alias("text"))


def page_links(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.posexplode(T.links(F.col("html"))).alias("pos", "href"))


def href_to_title(spark, sf_dir):
    return page_links(spark, sf_dir).select("page_id", "pos", T.href_title(F.col("href")).alias("title"))


def crawl_edges(spark, sf_dir):
    titles = href_to_title(spark, sf_dir).filter("title is not null")
    known = titles.groupBy("title").agg(F.count_distinct("page_id").alias("n")).filter("n > 1").select("title")
    return titles.join(known, "title", "left_semi").select("page_id", "title").distinct()


def manifest(spark, sf_dir):
    edges = crawl_edges(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("link_count"))
    pages = _pages(spark, sf_dir).select("page_id").join(edges, "page_id", "left")
    return pages.select("page_id", F.coalesce("link_count", F.lit(0)).alias("link_count"))


def content_fragment(spark, sf_dir):
    x = T.fragment(F.col("html"), START, END)
    return _pages(spark, sf_dir).select("page_id", x.alias("x")).select("page_id", F.length("x").alias("n"), F.md5("x").alias("digest"))


def html_to_text(spark, sf_dir):
    return _texts(spark, sf_dir).select(F.col("id").alias("page_id"), F.length("text").alias("n"), F.md5("text").alias("digest"))


def split_blocks(spark, sf_dir):
    return C.exploded(_texts(spark, sf_dir)).select(F.col("id").alias("page_id"), "pos", "block")


def block_flags(spark, sf_dir):
    return C.flagged(C.exploded(_texts(spark, sf_dir))).select(F.col("id").alias("page_id"), "pos", "is_heading", "is_bullet", "is_table", "is_sentence")


def back_matter(spark, sf_dir):
    kept = C.without_back_matter(C.exploded(_texts(spark, sf_dir)))
    return kept.groupBy(F.col("id").alias("page_id")).agg(F.count("*").alias("n_blocks"))


def clean_blocks(spark, sf_dir):
    out = C.cleaned(C.without_back_matter(C.exploded(_texts(spark, sf_dir))))
    return out.select(F.col("id").alias("page_id"), "n_blocks", F.md5("text").alias("digest"))


def _exports(spark, sf_dir):
    """Pages as exported texts, with a header."""
    rows = _pages(spark, sf_dir).select(F.col("page_id").alias("id"), F.coalesce("url", F.lit("")).alias("url"), T.html_text(T.fragment(F.col("html"), START, END)).alias("text"))
    kind = F.when(F.col("id") % 7 == 0, "category").otherwise("page")
    head = F.concat(F.lit("Title: Page "), "id", F.lit(" \nCanonicalTitle: The page "), "id", F.lit("\nKind: "), kind, F.lit("\nURL: "), "url", F.lit("\n\n"))
    return rows.select("id", F.concat(head, F.lit("  edit \n"), "text", F.lit("\n edit\n\n")).alias("text"))


def export_headers(spark, sf_dir):
    fields = [F.nullif(T.header_field(F.col("text"), field), F.lit("")).alias(name) for name, field in T.HEADER_FIELDS]
    return _exports(spark, sf_dir).select(F.col("id").alias("page_id"), *fields, F.length(T.body(F.col("text"))).alias("body_length"))


def sentence_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null")
    out = C.sentence_chunks(docs.select(F.col("doc_id").alias("id"), "text"))
    return out.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n_chunks"), F.sum("n_words").alias("n_words"), F.max("n_words").alias("longest"))


def export_clean(spark, sf_dir):
    return C.export_clean(_exports(spark, sf_dir)).select(F.col("id").alias("page_id"), F.length("text").alias("n"), F.md5("text").alias("digest"))


QUERIES = {f.__name__: f for f in (page_links, href_to_title, crawl_edges, manifest, content_fragment, html_to_text, split_blocks, block_flags, back_matter, clean_blocks, export_headers, sentence_chunks, export_clean)}


def q(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '") + "'"


def _sql_text() -> str:
    out = "frag"
    for pattern, made in T.HTML_STEPS:
        out = f"regexp_replace({out}, {q(pattern)}, {q(made)}, 'g')"
    for entity in ("nbsp", "quot", "lt", "gt", "copy", "middot"):
        out = f"replace({out}, '&{entity};', {q(T.ENTITIES[entity])})"
    out = f"replace(replace({out}, '&#39;', {q(chr(39))}), '&amp;', '&')"
    for pattern, made in T.SPACE_STEPS:
        out = f"regexp_replace({out}, {q(pattern)}, {q(made)}, 'g')"
    return rf"regexp_replace({out}, '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[^ \t\n\x0B\f\r]+'))"


LINKS = f"""links AS (SELECT page_id, h.href AS href, row_number() OVER (PARTITION BY page_id ORDER BY h.k) - 1 AS pos FROM (
    SELECT page_id, unnest(list_transform(hs, lambda x, i: {{'href': x, 'k': i}})) AS h, hs FROM (SELECT page_id, regexp_extract_all(html, {q(T.LINK)}, 1) AS hs FROM pages)) WHERE list_position(hs, h.href) = h.k),
titles AS (SELECT page_id, pos, CASE WHEN starts_with(href, '/') THEN nullif(trim(replace(url_decode(string_split(string_split(substr(href, 2), '#')[1], '?')[1]), '_', ' ')), '') END AS title FROM links),
crawl AS (SELECT DISTINCT page_id, title FROM titles WHERE title IN (SELECT title FROM titles WHERE title IS NOT NULL GROUP BY title HAVING count(DISTINCT page_id) > 1))"""
def place(x: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '(?is){pattern}') THEN length(regexp_extract({x}, '(?is)^(.*?)(?:{pattern})', 1)) + 1 END"


TEXTS = f"""starts AS (SELECT *, coalesce({", ".join(place("html", p) for p in START)}) AS s FROM pages),
segs AS (SELECT *, CASE WHEN s IS NULL THEN html ELSE substr(html, s) END AS seg FROM starts),
found AS (SELECT *, least({", ".join(f"(SELECT e FROM (SELECT {place('seg', p)} AS e) WHERE e > 1)" for p in END)}) AS e FROM segs),
frags AS (SELECT page_id, url, CASE WHEN s IS NULL OR e IS NULL THEN seg ELSE substr(seg, 1, e - 1) END AS frag FROM found),
texts AS (SELECT page_id, url, {_sql_text()} AS text FROM frags)"""
KEY = r"regexp_replace(lower(regexp_replace(block, '\s+', ' ', 'g')), '^:+|:+$', '', 'g')"
NUMBERS = r"len(regexp_extract_all(lower(block), '\b[0-9]+(?:[.,:-][0-9]+)?[a-z%]*\b'))"
KNOWN = ", ".join(f"'{w}'" for w in (*T.TABLE_WORDS, *T.SECTION_WORDS))
ENDS = ", ".join(f"'{w}'" for w in T.BACK_MATTER)
EXPORT_ENDS = ", ".join(f"'{w}'" for w in T.BACK_MATTER if w != "see also")
BLOCKS = rf"""{TEXTS},
cut AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n+'), lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g')), lambda b: b <> '') AS bs FROM texts),
blocks AS (SELECT page_id, unnest(range(len(bs))) AS pos, unnest(bs) AS block FROM cut)"""
FLAGS = rf"""{BLOCKS},
lined AS (SELECT *, list_filter(string_split(block, chr(10)), lambda x: trim(x) <> '') AS ls, {words("block")} AS nw, {NUMBERS} AS nn FROM blocks),
sized AS (SELECT *, list_transform(ls, lambda x: {words("x")}) AS sizes, nw >= 8 AND regexp_matches(block, '[.!?]$') AS is_sentence FROM lined),
flags AS (SELECT page_id, pos, block, (NOT contains(block, chr(10)) AND length(block) <= 80 AND nw <= 7 AND NOT regexp_matches(block, '[.!?]$')) AS is_heading,
    len(list_filter(ls, lambda x: NOT starts_with(ltrim(x), '- '))) = 0 AS is_bullet,
    ({KEY} IN ({KNOWN}) OR (len(ls) >= 3 AND ((list_avg(sizes) <= 4.5 AND len(list_filter(sizes, lambda x: x <= 4)) >= 0.75 * len(ls)) OR (list_avg(sizes) <= 6 AND nn >= 2)))
      OR nw <= 4 OR (nw <= 8 AND nn >= 1 AND NOT is_sentence)) AS is_table, is_sentence FROM sized)"""
KEPT = f"""ends AS (SELECT page_id, min(pos) AS cut FROM flags WHERE NOT contains(block, chr(10)) AND {KEY} IN ({ENDS}) GROUP BY page_id),
kept AS (SELECT flags.* FROM flags LEFT JOIN ends USING (page_id) WHERE cut IS NULL OR pos < cut)"""
CLEAN = f"""{FLAGS}, {KEPT},
k0 AS (SELECT *, CASE WHEN is_bullet AND is_table THEN NULL WHEN is_table THEN 'table' WHEN is_bullet THEN 'bullet' ELSE 'prose' END AS k FROM kept),
k1 AS (SELECT *, CASE WHEN k IS NOT NULL THEN k WHEN last_value(k IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos) = 'table' THEN 'table' ELSE 'bullet' END AS kind FROM k0),
k2 AS (SELECT *, lag(kind) OVER w AS prior, coalesce(lag(is_heading AND kind = 'prose') OVER w, false) AS before, coalesce(lead(is_sentence) OVER w, false) AS after FROM k1 WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
k3 AS (SELECT *, sum(CASE WHEN prior IS NULL OR prior <> kind OR kind = 'prose' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS run FROM k2),
runs AS (SELECT page_id, run, min(kind) AS kind, count(*) AS n, arg_min(before, pos) AS before, arg_max(after, pos) AS after, list(block ORDER BY pos) AS bs FROM k3 GROUP BY page_id, run),
itemed AS (SELECT *, list_filter(list_transform(list_filter(flatten(list_transform(bs, lambda b: string_split(b, chr(10)))), lambda x: starts_with(trim(x), '- ')), lambda x: trim(substr(trim(x), 3))), lambda x: x <> '') AS items FROM runs),
made AS (SELECT page_id, run, CASE WHEN kind = 'table' AND (n >= 3 OR before OR after) THEN [] WHEN kind = 'bullet' THEN list_transform(range(0, len(items), 5), lambda i: 'The list also includes ' || array_to_string(items[i + 1 : i + 5], ', ') || '.') ELSE bs END AS made FROM itemed),
done AS (SELECT page_id, flatten(list(made ORDER BY run)) AS made FROM made GROUP BY page_id)"""
EXPORTS = f"""{TEXTS}, exports AS (SELECT page_id, coalesce(url, '') AS url, 'Title: Page ' || page_id || ' ' || chr(10) || 'CanonicalTitle: The page ' || page_id || chr(10) || 'Kind: ' || CASE WHEN page_id % 7 = 0 THEN 'category' ELSE 'page' END
    || chr(10) || 'URL: ' || coalesce(url, '') || chr(10) || chr(10) || '  edit ' || chr(10) || text || chr(10) || ' edit' || chr(10) || chr(10) AS text FROM texts)"""
ORACLE_SQL = {
    "page_links": f"WITH {LINKS} SELECT page_id, pos, href FROM links",
    "href_to_title": f"WITH {LINKS} SELECT page_id, pos, title FROM titles",
    "crawl_edges": f"WITH {LINKS} SELECT page_id, title FROM crawl",
    "manifest": f"WITH {LINKS} SELECT p.page_id, count(title) AS link_count FROM pages p LEFT JOIN crawl c ON p.page_id = c.page_id GROUP BY p.page_id",
    "content_fragment": f"WITH {TEXTS} SELECT page_id, length(frag) AS n, md5(frag) AS digest FROM frags",
    "html_to_text": f"WITH {TEXTS} SELECT page_id, length(text) AS n, md5(text) AS digest FROM texts",
    "split_blocks": f"WITH {BLOCKS} SELECT page_id, pos, block FROM blocks",
    "block_flags": f"WITH {FLAGS} SELECT page_id, pos, is_heading, is_bullet, is_table, is_sentence FROM flags",
    "back_matter": f"WITH {FLAGS}, {KEPT} SELECT page_id, count(*) AS n_blocks FROM kept GROUP BY page_id",
    "clean_blocks": f"WITH {CLEAN} SELECT page_id, len(made) AS n_blocks, md5(array_to_string(made, chr(10) || chr(10))) AS digest FROM done",
    "export_headers": f"""WITH {EXPORTS} SELECT page_id, 'Page ' || page_id AS title, 'The page ' || page_id AS canonical_title, CASE WHEN page_id % 7 = 0 THEN 'category' ELSE 'page' END AS kind, nullif(trim(url), '') AS url,
length(text) - length(regexp_extract(text, '(?s)^(.*?\\n\\n)', 1)) AS body_length FROM exports""",
    "sentence_chunks": rf"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+(?:[ \t\n\x0B\f\r]+|\z)'), lambda x: trim(x)), lambda x: x <> '') AS ss FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, list_transform(ss, lambda x: {words("x")}) AS ns FROM s WHERE len(ss) > 0),
walk AS (SELECT doc_id, ns, 1 AS i, 0 AS chunk, ns[1] AS used, ns[1] AS longest FROM n
    UNION ALL SELECT doc_id, ns, i + 1, CASE WHEN used > 0 AND used + ns[i + 1] > 180 THEN chunk + 1 ELSE chunk END, CASE WHEN used > 0 AND used + ns[i + 1] > 180 THEN ns[i + 1] ELSE used + ns[i + 1] END,
    greatest(longest, CASE WHEN used > 0 AND used + ns[i + 1] > 180 THEN ns[i + 1] ELSE used + ns[i + 1] END) FROM walk WHERE i < len(ns))
SELECT doc_id, chunk + 1 AS n_chunks, list_sum(ns) AS n_words, longest FROM walk WHERE i = len(ns)""",
    "export_clean": rf"""WITH {EXPORTS}, ls AS (SELECT page_id, list_transform(list_filter(regexp_split_to_array(substr(text, length(regexp_extract(text, '(?s)^(.*?\n\n)', 1)) + 1), '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> 'edit'), lambda x: regexp_replace(x, '\s+$', '')) AS ls FROM exports),
at AS (SELECT *, list_position(list_transform(ls, lambda x: lower(trim(x)) IN ({EXPORT_ENDS})), true) AS k FROM ls),
b AS (SELECT page_id, regexp_replace(regexp_replace(array_to_string(CASE WHEN k > 0 THEN ls[1 : k - 1] ELSE ls END, chr(10)), '^\s+|\s+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS b FROM "at"),
t AS (SELECT page_id, replace('Page ' || page_id || CASE WHEN b <> '' THEN chr(10) || chr(10) || b ELSE '' END || chr(10), chr(10), chr(13) || chr(10)) AS text FROM b)
SELECT page_id, length(text) AS n, md5(text) AS digest FROM t""".replace("\nat AS", '\n"at" AS'),
}
