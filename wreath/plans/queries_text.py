"""Scalar string, date, hash and JSON functions (I rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wreath.functions import text as TX
from wreath.plans import stages as S
from wreath.plans.fixtures import Fixtures
from wreath.plans.queries_io import ENTITY, HEADLINE_SQL, bindings, nested_responses
from wreath.plans.queries_relational import SYNOPSIS_PREFIXES
from wreath.plans.registry import query
from wreath.sources import io as IO

ISO = "'%Y-%m-%dT%H:%M:%SZ'"
_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in TX.STOP_WORDS) + "]"


def _duck_ascii(x: str) -> str:
    """ASCII spelling of the letters in the data, by DuckDB's own accents rule."""
    return f"strip_accents(replace(lower({x}), 'ß', 'ss'))"


# References that occur in the pages.
_DUCK_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
                  ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"),
                  ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _duck_entities(x: str) -> str:
    out = x
    for a, b in _DUCK_ENTITIES:
        out = f"replace({out}, {_q(a)}, {_q(b)})"
    return out


def _duck_paragraphs(x: str) -> str:
    """Cut at every paragraph tag and keep what stands before the closing one, or before the
    end of the article that the pages' paragraphs stand in."""
    clean = f"regexp_replace({x}, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g')"
    clean = f"regexp_replace({clean}, '(?s)<span[^>]*class=\"error\"[^>]*>[^<]*</span>', '', 'g')"
    cut = f"string_split_regex({clean}, '<p(>|\\s[^>]*>)')[2:]"
    plain = _duck_entities("regexp_replace(regexp_extract(p, '(?s)^(.*?)(</p>|</article>|$)', 1), '<[^>]*>', '', 'g')")
    return f"array_to_string(list_transform({cut}, lambda p: {plain}), chr(10))"


# ---------------------------------------------------------------- I1 / I2
@query("i1_concat_null_propagates", oracle=f"""
SELECT event_id, ({HEADLINE_SQL}) || ' ' || CASE WHEN event_id % 4 = 0 THEN NULL ELSE props END AS text
FROM events
""")
def i1_concat_null_propagates(spark, sf):
    """Headline || ' ' || abstract; a null part gives null."""
    h = F.concat(F.when(F.col("event_id") % 3 == 0, F.lit("LEAD:")).otherwise(F.lit("")),
                 F.initcap("event_type"), F.lit(" Report "), F.col("user_id").cast("string"))
    a = F.when(F.col("event_id") % 4 != 0, F.col("props"))
    return Fixtures(spark, sf).events.select("event_id", F.concat(h, F.lit(" "), a).alias("text"))


@query("i2_clean_headline", oracle=f"""
SELECT CAST(event_id AS STRING) AS id,
       lower(regexp_replace({HEADLINE_SQL}, '^LEAD:', '')) || ' ' || props AS headline_abstract
FROM events WHERE event_type = 'view'
""")
def i2_clean_headline(spark, sf):
    """Headline without a leading LEAD:, lower-cased, plus the abstract."""
    d = IO.flatten_docs(nested_responses(Fixtures(spark, sf)), "json")
    return d.select("id", TX.clean_headline("headline", "abstract").alias("headline_abstract"))


# ---------------------------------------------------------------- I3 / I4 / I5
@query("i3_casefold", oracle="""
SELECT doc_id, replace(lower(text), 'ß', 'ss') AS folded FROM documents
""")
def i3_casefold(spark, sf):
    """Case folding (lower plus the letters whose fold differs)."""
    return Fixtures(spark, sf).documents.select("doc_id", TX.casefold("text").alias("folded"))


@query("i4_to_ascii", oracle=f"""
SELECT doc_id, {_duck_ascii('text')} AS ascii FROM documents
""")
def i4_to_ascii(spark, sf):
    """Case-folded text transliterated to ASCII."""
    return Fixtures(spark, sf).documents.select("doc_id", TX.to_ascii(TX.casefold("text")).alias("ascii"))


def _duck_name_key(x: str) -> str:
    toks = f"regexp_extract_all({_duck_ascii(x)}, '[\\p{{L}}\\p{{N}}]+')"
    return (f"array_to_string(list_filter({toks}, lambda t: length(t) >= 3 "
            f"AND NOT list_contains({_STOP_SQL}, t)), ' ')")


@query("i5_name_key", oracle=f"""
SELECT doc_id, {_duck_name_key('text')} AS text_key FROM documents
""")
def i5_name_key(spark, sf):
    """Whole documents through the name-key rule (tokens, stop words, length)."""
    return Fixtures(spark, sf).documents.select("doc_id", TX.name_key("text").alias("text_key"))


@query("i5_name_key_catalog", oracle=f"""
SELECT unique_id, {_duck_name_key('title')} AS title_key, {_duck_name_key('author')} AS author_key
FROM (SELECT * FROM catalog_a UNION ALL SELECT * FROM catalog_b)
""")
def i5_name_key_catalog(spark, sf):
    """Title and author comparison keys of both catalogues."""
    fx = Fixtures(spark, sf)
    c = fx.catalog_a.union(fx.catalog_b)
    return c.select("unique_id", TX.name_key("title").alias("title_key"), TX.name_key("author").alias("author_key"))


# ---------------------------------------------------------------- I6 / I7
@query("i6_split_part", oracle="""
SELECT ok, ln, author_id, split_part(title || ';' || author_label, ';', 1) AS title,
       split_part(title || ';' || author_label, ';', 2) AS author FROM nom
""")
def i6_split_part(spark, sf):
    """A packed 'title;author' string split back into its parts."""
    n = Fixtures(spark, sf).nom
    packed = F.concat_ws(";", "title", "author_label")
    return n.select("ok", "ln", "author_id", TX.split_part(packed, ";", 1).alias("title"),
                    TX.split_part(packed, ";", 2).alias("author"))


@query("i7_strip_whitespace", oracle="""
SELECT conv_id, turn, regexp_replace(chr(10) || '  ' || text || ' ' || chr(9), '^\\s+|\\s+$', '', 'g') AS stripped
FROM conversations
""")
def i7_strip_whitespace(spark, sf):
    """Whitespace trimmed at both ends (newlines and tabs too)."""
    c = Fixtures(spark, sf).conversations
    padded = F.concat(F.lit("\n  "), F.col("text"), F.lit(" \t"))
    return c.select("conv_id", "turn", TX.strip_ws(padded).alias("stripped"))


# ---------------------------------------------------------------- I8 / I9
@query("i8_article_name", oracle=f"""
SELECT DISTINCT article, url_decode(replace(regexp_replace(article, '^https://en\\.wikipedia\\.org/wiki/', ''), '+', '%2B')) AS name
FROM nom WHERE article IS NOT NULL
""")
def i8_article_name(spark, sf):
    """Article name from a wiki URL: prefix removed, percent-decoded, '+' kept."""
    n = Fixtures(spark, sf).nom.filter(F.col("article").isNotNull()).select("article").distinct()
    return n.select("article", TX.article_name("article").alias("name"))


@query("i9_text_after_marker", oracle=f"""
SELECT event_id,
       CASE WHEN strpos(x, '{ENTITY}') > 0 THEN substr(x, strpos(x, '{ENTITY}') + {len(ENTITY)}) ELSE '' END AS qid
FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'urn:' || CAST(event_id AS STRING)
                            ELSE '{ENTITY}Q' || CAST(event_id AS STRING) END AS x FROM events)
""")
def i9_text_after_marker(spark, sf):
    """Text after the entity URL prefix, '' when absent."""
    b = IO.flatten_bindings(bindings(Fixtures(spark, sf)), "json", ["item"], keep=["event_id"])
    x = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("urn:"), F.col("event_id").cast("string"))) \
        .otherwise(F.col("item"))
    return b.select("event_id", TX.str_after(x, ENTITY).alias("qid"))


# ---------------------------------------------------------------- I10 / I12
@query("i10_year_of_timestamp", oracle="""
SELECT l_orderkey, l_linenumber, l_suppkey, CAST(year(l_shipdate) AS INT) AS year FROM lineitem
""")
def i10_year_of_timestamp(spark, sf):
    """Integer year of a timestamp."""
    l = Fixtures(spark, sf).lineitem
    return l.select("l_orderkey", "l_linenumber", "l_suppkey", F.year("l_shipdate").cast("int").alias("year"))


@query("i12_month_of_date_string", oracle=f"""
SELECT DISTINCT work_id, CAST(month(try_strptime(pub_date, {ISO})) AS INT) AS month FROM nom
""")
def i12_month_of_date_string(spark, sf):
    """Month of an ISO date string (null when missing)."""
    n = Fixtures(spark, sf).nom.select("work_id", "pub_date").distinct()
    return n.withColumn("month", S.publication_month()).drop("pub_date").distinct()


# ---------------------------------------------------------------- I13 / I14
@query("i13_html_paragraphs", oracle=f"""
SELECT page_id, {_duck_paragraphs('html')} AS text FROM pages
""")
def i13_html_paragraphs(spark, sf):
    """Plain text of every page's paragraphs (scripts, styles, error spans removed)."""
    p = Fixtures(spark, sf).pages
    return p.select("page_id", TX.paragraph_text("html").alias("text"))


def _duck_synopsis(x: str) -> str:
    alt = "|".join(SYNOPSIS_PREFIXES)
    heading = _duck_entities(
        f"regexp_replace(regexp_extract(s, '(?s)^[^>]*>(.*?)</h2>', 1), '<[^>]*>', '', 'g')")
    body = "regexp_replace(s, '(?s)^[^>]*>.*?</h2>', '')"
    sections = (f"list_transform(list_slice(string_split({x}, '<h2'), 2, len(string_split({x}, '<h2'))), "
                f"lambda s: {{'heading': {heading}, 'body': {body}}})")
    chosen = f"list_filter({sections}, lambda s: regexp_matches(replace(lower(s.heading), 'ß', 'ss'), '^(?:{alt})'))[1]"
    intro = f"string_split({x}, '<h2')[1]"
    return (f"nullif(CASE WHEN {chosen} IS NOT NULL THEN {_duck_paragraphs(chosen + '.body')} "
            f"ELSE {_duck_paragraphs(intro)} END, '')")


@query("i14_synopsis_pick", oracle=f"""
SELECT page_id, {_duck_synopsis('html')} AS synopsis FROM pages
""")
def i14_synopsis_pick(spark, sf):
    """Synopsis section text, else the intro, for every page."""
    p = Fixtures(spark, sf).pages
    return p.select("page_id", TX.synopsis("html", SYNOPSIS_PREFIXES).alias("synopsis"))


@query("i14_synopsis_sections", oracle=f"""
WITH p AS (
  SELECT page_id,
         replace(html, '<h1>', '<h2 id="s">' || CASE page_id % 4 WHEN 0 THEN 'Plot summary' WHEN 1 THEN 'Reception'
                                             WHEN 2 THEN 'Background' ELSE 'Setting' END || '</h2><h1>') AS html
  FROM pages)
SELECT page_id, {_duck_synopsis('html')} AS synopsis FROM p
""")
def i14_synopsis_sections(spark, sf):
    """Pages given one <h2> heading each (derived per page) so both the
    section path and the intro fallback run on the whole page set."""
    p = Fixtures(spark, sf).pages
    head = (F.when(F.col("page_id") % 4 == 0, F.lit("Plot summary"))
            .when(F.col("page_id") % 4 == 1, F.lit("Reception"))
            .when(F.col("page_id") % 4 == 2, F.lit("Background")).otherwise(F.lit("Setting")))
    html = F.replace(F.col("html"), F.lit("<h1>"), F.concat(F.lit('<h2 id="s">'), head, F.lit("</h2><h1>")))
    return p.select("page_id", TX.synopsis(html, SYNOPSIS_PREFIXES).alias("synopsis"))


# ---------------------------------------------------------------- I15 / I16 / I17
@query("i15_sha256_key", oracle="""
SELECT doc_id, sha256(text) AS key FROM documents
""")
def i15_sha256_key(spark, sf):
    """SHA-256 hex of every document's text."""
    return Fixtures(spark, sf).documents.select("doc_id", IO.request_key("text").alias("key"))


@query("i16_nested_with_default", oracle="""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k,
       coalesce(json_extract_string(props, '$.missing.deeper'), 'none') AS missing
FROM events
""")
def i16_nested_with_default(spark, sf):
    """A nested JSON field, and a default for a missing path."""
    e = Fixtures(spark, sf).events
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"),
                    F.coalesce(F.get_json_object("props", "$.missing.deeper"), F.lit("none")).alias("missing"))


FIRST_VALUE_JSON = ("concat('{\"p', CAST(event_id % 7 AS STRING), '\": {\"extract\": \"', event_type, "
                    "'\"}, \"zz\": {\"extract\": \"last\"}}')")


@query("i17_first_map_value", oracle=f"""
SELECT event_id, json_extract_string(json_extract({FIRST_VALUE_JSON}, '$.*')[1], '$.extract') AS extract
FROM events
""")
def i17_first_map_value(spark, sf):
    """First value of a JSON object in document order."""
    e = Fixtures(spark, sf).events
    m = F.from_json(F.expr(FIRST_VALUE_JSON), "map<string, struct<extract: string>>")
    return e.select("event_id", F.get(F.map_values(m), 0)["extract"].alias("extract"))
