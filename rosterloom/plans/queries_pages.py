"""Facts out of crawled pages."""

from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import pages
from .bindings import tables
from .registry import query

# The pages carry no meta description, so one is put into the head of most of them.
_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
               ("&amp;", "&")):
    _TITLE = f"replace({_TITLE}, '{_e}', '{_c}')"
_META_SQL = f"src AS (SELECT page_id AS id, trim({_TITLE}) AS title FROM pages)"


@query("h33_meta_description", (
    f"WITH {_META_SQL} SELECT id, CASE CAST(id % 4 AS INT) WHEN 0 THEN 'og ' || chr(233) || chr(8217) || title "
    "WHEN 1 THEN 'plain ' || title WHEN 2 THEN 'tw ' || chr(128512) || "
    "title END AS description FROM src"))
def meta_description(spark, path):
    (p,) = tables(spark, path, "pages")
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    k = F.col("page_id") % 4
    plain = F.concat(F.lit('<META NAME="description" content="plain '), title, F.lit(' ">'))
    tag = (F.when(k == 0, F.concat(plain, F.lit('<meta content=" og &eacute;&#8217;'), title,
                                   F.lit('" property="og:description"/>')))
           .when(k == 1, plain)
           .when(k == 2, F.concat(F.lit("<meta name='twitter:description' content='tw &#x1F600;"), title,
                                  F.lit("'><meta name=\"description\" content=\"\">")))
           .otherwise(""))
    html = F.concat(tag, "html")
    return p.select(F.col("page_id").alias("id"), pages.meta_description(html).alias("description"))


# Every page begins with a link of one kind behind decoys; its own links follow.
_OWN_LINKS = """a AS (
  SELECT page_id AS id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS root, unnest(regexp_extract_all(html,
    '<a href="([^"]*)">[^<]*</a>', 1)) AS href, lower(unnest(regexp_extract_all(html,
    '<a href="[^"]*">([^<]*)</a>', 1))) AS label, generate_subscripts(regexp_extract_all(html,
    '<a href="([^"]*)">[^<]*</a>', 1), 1) AS pos FROM pages
), base AS (
  SELECT page_id AS id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS root,
    regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '[^/]*$', '') AS folder FROM pages
)"""


def _own(words, paths) -> str:
    hit = " OR ".join([f"contains(label, '{w}')" for w in words]
                      + [f"contains(lower(href), '{p}')" for p in paths])
    return f"(SELECT arg_min(a.root || href, pos) FROM a WHERE a.id = base.id AND ({hit}))"


@query("h34_visitor_links", (
    f"WITH {_OWN_LINKS} SELECT id, CASE WHEN id % 3 = 0 THEN root || regexp_replace(folder, '[^/]*/$', '') || "
    f"'plan/' || id || '?d=../1' ELSE {_own(*vocab.VISITOR_LINKS['hours'])} END AS hours_url, CASE WHEN id % 3 = "
    f"1 THEN root || folder || 'tickets' ELSE {_own(*vocab.VISITOR_LINKS['tickets'])} END AS tickets_url, CASE "
    f"WHEN id % 3 = 2 THEN 'http://o.org/x' ELSE {_own(*vocab.VISITOR_LINKS['accessibility'])} END AS "
    "accessibility_url FROM base"))
def visitor_links(spark, path):
    (p,) = tables(spark, path, "pages")
    key = F.col("page_id").cast("string")
    decoys = ('<!-- <a href="/visit">plan your visit</a> --><script>"<a href=\'/ada\'>tickets</a>"</script>'
              '<a name="hours">hours</a>')
    link = (F.when(F.col("page_id") % 3 == 0, F.concat(
                F.lit('<a data-href="/wrong" href="../x/../plan/'), key, F.lit('?d=../1">Plan your visit</a>')))
            .when(F.col("page_id") % 3 == 1, F.lit("<A class=x HREF='./tickets'>Buy</A>"))
            .otherwise('<a href=http://o.org/x><b>Accessible</b> rooms</a>'))
    html = F.concat(F.lit(decoys), link, "html")
    return pages.visitor_links(p.select(F.col("page_id").alias("id"), "url", html.alias("html")), "id", "url",
                               "html")


_AREA = ("regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '(?s)<[^>]*>', chr(10), 'g') || "
         "chr(10) || 'Open & hours' || chr(10) || '9 to 5' || chr(10) || 'Tickets' || chr(10) || 'cost 5'")
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
               ("&amp;", "&")):
    _AREA = f"replace({_AREA}, '{_e}', '{_c}')"
_CUT = "CASE WHEN length(w) > 1500 THEN left(w, 1500) || '...' ELSE w END"


@query("h35_topic_sections", (
    "WITH a AS (SELECT page_id AS id, array_to_string(list_filter(list_transform(string_split("
    f"{_AREA}, chr(10)), lambda x: regexp_replace(x, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda x: x "
    "<> ''), chr(10)) AS w FROM pages) SELECT id, 'Open & hours' || chr(10) || '9 to 5' AS hours_text, 'Tickets' "
    f"|| chr(10) || 'cost 5' || chr(10) || 'cost 5' AS admission_text, {_CUT} AS accessibility_text, {_CUT} AS "
    "collections_text FROM a"))
def topic_sections(spark, path):
    # sections at the end of every article, the second one nested, and one outside of it
    (p,) = tables(spark, path, "pages")
    inside = ("<section><h2>Open &amp; hours</h2>9 to 5</section><div>Tickets<div>cost 5</div></div></article>"
              "<div>Open late, accessible</div>")
    html = F.replace("html", F.lit("</article>"), F.lit(inside))
    return pages.topic_sections(p.select(F.col("page_id").alias("id"), html.alias("html")), "id", "html")


_CLEAN = "html"
for _t in ("script", "style", "nav", "header", "footer"):
    _CLEAN = f"regexp_replace({_CLEAN}, '(?is)<{_t}\\b[^>]*>.*?</{_t}\\s*>', '', 'g')"
_CLEAN = _CLEAN.replace("(html,", "(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),")
_CLEAN = f"regexp_replace({_CLEAN}, '(?s)<[^>]*>', chr(10), 'g')"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
               ("&amp;", "&")):
    _CLEAN = f"replace({_CLEAN}, '{_e}', '{_c}')"
_CLEAN = f"regexp_replace({_CLEAN}, '[ \\t\\r\\f]*\\n[ \\t\\r\\f]*', chr(10), 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '\\n{{2,}}', chr(10), 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


@query("h36_clean_text", (
    f"WITH c AS (SELECT page_id AS id, 'Mus' || chr(233) || 'e' || chr(8217) || 's A&lt;' || chr(10) || {_CLEAN} "
    "AS t FROM pages) SELECT id, CASE WHEN length(t) > 2000 "
    "THEN left(t, 2000) || '...' ELSE t END AS body FROM c"))
def clean_text(spark, path):
    (p,) = tables(spark, path, "pages")
    # nested clutter and entities beyond the page's own
    head = ('<nav>a<NAV class="x">b</nav>c</nav><!-- <p>no --><p>Mus&eacute;e&#8217;s &#x41;&amp;lt;</p>'
            '<footer>d<header>e</header></footer>')
    return p.select(F.col("page_id").alias("id"),
                    pages.clean_text(F.concat(F.lit(head), "html")).alias("body"))
