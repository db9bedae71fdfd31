"""Facts out of crawled pages: meta description, visitor links, clean text, topic sections."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vocab

_CLUTTER = ("nav", "header", "footer")
#: A comment, a whole script or style element, a tag, text, or a lone `<`.
_TOKEN = r"(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script\s*>|$)|<style\b.*?(?:</style\s*>|$)|<[a-z/!?][^>]*>|[^<]+|<"
#: Tokens with a name that are no part of the page, and (as a group) all others.
_SHOWN = (r"(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script\s*>|$)|<style\b.*?(?:</style\s*>|$)"
          r"|(<[a-z/!?][^>]*>|[^<]+|<)")
_NAME = r"(?s)^</?([a-zA-Z][^\s/>]*)"
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track",
         "wbr")
_ENTITY = r"&(?:#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,7}|[a-zA-Z][a-zA-Z0-9]{1,31});"


def _character(code: Column) -> Column:
    """The character of a code point; what is none becomes the replacement character."""
    ok = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(ok, char).otherwise(F.lit("\ufffd"))


def unescape(c: Column) -> Column:
    """Character entities as characters, in one pass: `&amp;lt;` becomes `&lt;`.

    Named ones come from the standard table of names, numbers are code points; unknown names stay.
    """
    names = F.create_map(*[F.lit(x) for name, code in sorted(name2codepoint.items())
                           for x in (name, chr(code))], F.lit("apos"), F.lit("'"))

    def one(part: Column) -> Column:
        body = F.substring(part, 2, 10_000)
        body = F.left(body, F.length(body) - 1)
        hexa = F.conv(F.substring(body, 3, 10), 16, 10).try_cast("bigint")
        number = F.when(body.rlike("^#[xX]"), hexa).otherwise(
            F.substring(body, 2, 10).try_cast("bigint"))
        named = F.coalesce(F.try_element_at(names, body), part)
        decoded = F.when(body.startswith("#"), _character(number)).otherwise(named)
        return F.when(part.rlike("^" + _ENTITY + "$"), decoded).otherwise(part)

    parts = F.regexp_extract_all(c, F.lit(_ENTITY + "|[^&]+|&"), F.lit(0))
    return F.when(c.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(c)


def visible(html: Column) -> Column:
    """The page without comments, scripts and styles."""
    return F.regexp_replace(html, _SHOWN, "$1")


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), 0)


def _tokens(html: Column) -> Column:
    """The page's tokens: tag name ('' for text), +1 / -1 for a tag that opens / closes, hidden or not."""
    def one(t: Column) -> Column:
        name = F.when(t.startswith("<"), F.lower(F.regexp_extract(t, _NAME, 1))).otherwise("")
        return _let(name, lambda n: F.struct(
            t.alias("t"), n.alias("name"),
            F.when((n == "") | n.isin("script", "style", *_VOID), 0).when(t.startswith("</"), -1)
            .when(t.endswith("/>"), 0).otherwise(1).alias("move"),
            (n.isin("script", "style") | t.startswith("<!--")).alias("hidden")))

    return F.transform(F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0)), one)


def _moves(tokens: Column, names: tuple[str, ...] | None = None) -> Column:
    """(key, at, move) of the tags that open or close; all `names` share one key."""
    def one(x: Column, i: Column) -> Column:
        key = x["name"] if names is None else F.lit("")
        return F.struct(key.alias("key"), i.alias("at"), x["move"].alias("move"), x["name"].alias("name"))

    found = F.filter(F.transform(tokens, one), lambda e: e["move"] != 0)
    return found if names is None else F.filter(found, lambda e: e["name"].isin(*names))


def _levelled(moves: Column) -> Column:
    """Moves with the level they open or close, by key and place.

    Among moves in order the k-th opening one, at place i, follows k openings and i - k closings; so
    its depth is 2k + 1 - i, without a running sum. A key's levels are shifted by a number of its own.
    """
    def side(x: Column, move: int) -> Column:
        return F.transform(F.filter(x, lambda e: e["move"] == move), lambda e, k: F.struct(
            e["key"].alias("key"),
            (2 * k + 1 - e["i"] if move == 1 else e["i"] - 2 * k).alias("level"),
            e["at"].alias("at"), e["move"].alias("move"), e["name"].alias("name")))

    placed = F.transform(F.sort_array(moves), lambda e, i: F.struct(
        e["key"].alias("key"), e["at"].alias("at"), e["move"].alias("move"), e["name"].alias("name"),
        i.alias("i")))
    return _let(placed, lambda x: F.sort_array(F.concat(side(x, 1), side(x, -1))))


def _elements(moves: Column, stop: Column) -> Column:
    """(start, end, name, closed) of each element by start: the places of its two tags.

    The end tag is the next move of the same key and level. An element that is never closed ends at
    `stop`; a stray end tag ends nothing.
    """
    def one(y: Column):
        def pair(e: Column, j: Column) -> Column:
            return _let(F.get(y, j + 1), lambda n: F.struct(
                e["at"].alias("start"),
                F.when((n["key"] == e["key"]) & (n["level"] == e["level"]), n["at"]).alias("end"),
                e["name"].alias("name"), e["move"].alias("move")))
        return pair

    pairs = _let(_levelled(moves), lambda y: F.filter(
        F.transform(y, one(y)), lambda e: e["move"] == 1))
    return F.sort_array(F.transform(pairs, lambda e: F.struct(
        e["start"].alias("start"), F.coalesce(e["end"], stop).alias("end"), e["name"].alias("name"),
        e["end"].isNotNull().alias("closed"))))


def _outermost(elements: Column) -> Column:
    """The elements that are in no other one."""
    def tag(place: str, move: int):
        return lambda e: F.struct(F.lit("").alias("key"), e[place].alias("at"), F.lit(move).alias("move"),
                                  F.lit("").alias("name"))

    tags = F.concat(F.transform(elements, tag("start", 1)),
                    F.transform(F.filter(elements, lambda e: e["closed"]), tag("end", -1)))
    tops = F.transform(F.filter(_levelled(tags), lambda e: (e["move"] == 1) & (e["level"] == 1)),
                       lambda e: e["at"])
    # both are in order of their starts
    return _let(F.map_from_entries(F.transform(elements, lambda e: F.struct(e["start"], e["end"]))),
                lambda end: F.transform(tops, lambda s: F.struct(
                    s.alias("start"), F.try_element_at(end, s).alias("end"))))


def _without(tokens: Column, names: tuple[str, ...]) -> Column:
    """The shown tokens outside the named elements, however deep those are nested.

    An element that is never closed hides the rest of the page; a stray end tag hides nothing.
    Hidden elements are ranges, and what is between them is cut out as a whole: the work grows with
    the number of tokens (and its logarithm), whatever the nesting.
    """
    def gaps(x: Column, hidden: Column) -> Column:
        n = F.size(x)
        starts = F.concat(F.transform(hidden, lambda e: e["start"]), F.array(n))
        ends = F.concat(F.array(F.lit(-1)), F.transform(hidden, lambda e: e["end"]))
        return F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(
            x, e + 2, F.greatest(s - e - 1, F.lit(0)))))

    def cut(x: Column) -> Column:
        return _let(_moves(x, names), lambda moves: F.when(F.size(moves) == 0, x).otherwise(
            _let(_outermost(_elements(moves, F.size(x))), lambda hidden: gaps(x, hidden))))

    return F.filter(_let(tokens, cut), lambda x: ~x["hidden"] & ~x["name"].isin(*names))


def without_elements(html: Column, names: tuple[str, ...]) -> Column:
    """The page's tokens, as they stand, outside the named elements."""
    return F.transform(_without(_tokens(html), names), lambda x: x["t"])


def _meta(html: Column, attr: str, value: str) -> Column:
    """`content` of the first meta tag whose `attr` is `value`, in either attribute order."""
    tag = F.regexp_extract(
        html, rf"""(?is)(<meta\b[^>]*\s{attr}\s*=\s*["']?{value}["'\s/>][^>]*>?)""", 1)
    body = F.coalesce(
        F.nullif(F.regexp_extract(tag, r'''(?is)\scontent\s*=\s*"([^"]*)"''', 1), F.lit("")),
        F.nullif(F.regexp_extract(tag, r"""(?is)\scontent\s*=\s*'([^']*)'""", 1), F.lit("")))
    return text.strip(unescape(body))


def meta_description(html: Column | str) -> Column:
    """og:description, else the plain description, else the twitter one."""
    h = text.as_col(html)
    return F.coalesce(_meta(h, "property", "og:description"), _meta(h, "name", "description"),
                      _meta(h, "name", "twitter:description"))


_ANCHOR = r"(?is)<a(?=\s)[^>]*?\shref\s*=[^>]*>.*?</a\s*>"


def _href(tag: Column) -> Column:
    return unescape(F.coalesce(
        F.nullif(F.regexp_extract(tag, r'''(?is)^<a\b[^>]*?\shref\s*=\s*"([^"]*)"''', 1), F.lit("")),
        F.nullif(F.regexp_extract(tag, r"""(?is)^<a\b[^>]*?\shref\s*=\s*'([^']*)'""", 1), F.lit("")),
        F.regexp_extract(tag, r"""(?is)^<a\b[^>]*?\shref\s*=\s*([^\s"'>]*)""", 1)))


def _label(tag: Column) -> Column:
    return F.lower(text.strip(unescape(F.regexp_replace(tag, r"(?s)<[^>]*>", ""))))


def anchors(html: Column | str) -> Column:
    """The links of a page in document order: array<struct<href, label>>, labels lower-cased.

    Links inside comments and scripts are none.
    """
    found = F.regexp_extract_all(visible(text.as_col(html)), F.lit(_ANCHOR), F.lit(0))
    return F.transform(found, lambda t: F.struct(_href(t).alias("href"), _label(t).alias("label")))


def visitor_links(pages: DataFrame, id_col: str, url: str, html: str,
                  kinds: dict = vocab.VISITOR_LINKS) -> DataFrame:
    """First matching link per page and kind, in document order, as an absolute URL.

    Works inside each row: links are never exploded, so nothing is shuffled.
    """
    links = pages.select(id_col, url, anchors(html).alias("_links"))

    def first(words, paths) -> Column:
        hits = F.filter("_links", lambda a: text.contains_any(a["label"], words)
                        | text.contains_any(F.lower(a["href"]), paths))
        return F.get(hits, 0)["href"]

    best = links.withColumns({f"_{k}": first(*rule) for k, rule in kinds.items()})
    return best.select(id_col, *[text.resolve_url(url, F.col(f"_{k}")).alias(f"{k}_url")
                                 for k in kinds])


def clean_text(html: Column | str, max_length: int = 2000) -> Column:
    """Page text without clutter elements: one line per text piece, cut with '...'."""
    pieces = F.transform(without_elements(text.as_col(html), _CLUTTER), lambda t: F.when(
        t.startswith("<") & t.rlike("(?is)^<[a-z/!?]"), F.lit("\n")).otherwise(t))
    # bound: decoding reads its input three times
    lines = _let(F.array_join(pieces, ""), unescape)
    lines = F.regexp_replace(lines, r"[ \t\r\f]*\n[ \t\r\f]*", "\n")
    lines = text.strip(F.regexp_replace(lines, r"\n{2,}", "\n"))
    # bound once: the cut reads its input three times
    return F.get(F.transform(F.array(lines), lambda t: text.cut(t, max_length)), 0)


# -- topic sections ------------------------------------------------------------

_SIDE = (*_CLUTTER, "aside")


def _attribute(token: Column, name: str) -> Column:
    return F.regexp_extract(token["t"], rf"""(?is)\s{name}\s*=\s*["']?([^"'>]*)""", 1)


def _main_area(tokens: Column) -> Column:
    """Place of the first main element, article, content or main block, or body; else null."""
    def place(x: Column, i: Column) -> Column:
        opens = x["move"] == 1
        return F.struct(i.alias("at"), x["name"].alias("name"), opens.alias("opens"),
                        F.when(opens, F.split(_attribute(x, "class"), r"\s+")).alias("classes"),
                        F.when(opens, _attribute(x, "id")).alias("id"))

    tests = [lambda x: x["name"] == "main", lambda x: x["name"] == "article",
             lambda x: F.array_contains(x["classes"], "content"), lambda x: x["id"] == "content",
             lambda x: F.array_contains(x["classes"], "main"), lambda x: x["id"] == "main",
             lambda x: x["name"] == "body"]
    return _let(F.filter(F.transform(tokens, place), lambda x: x["opens"]), lambda opens: F.coalesce(
        *[F.get(F.filter(opens, t), 0)["at"] for t in tests]))


def _area(tokens: Column) -> Column:
    """The texts between the main area's tags ('' for a tag), the same stripped, and its blocks' places.

    Null without a main area. A block that is not closed in the area reaches to its end.
    """
    def parts(x: Column, at: Column, elements: Column) -> Column:
        own = F.get(F.filter(elements, lambda e: e["start"] == at), 0)
        def texts(stop: Column) -> Column:
            return F.transform(F.slice(x, at + 2, stop - at - 1), lambda t: F.when(
                t["name"] == "", unescape(t["t"])).otherwise(""))

        return _let(own["end"], lambda stop: _let(texts(stop), lambda said: F.struct(
            said.alias("texts"), F.transform(said, text.strip).alias("lines"),
            F.transform(F.filter(elements, lambda e: (e["start"] > at) & (e["start"] < stop) & e["name"].isin(
                "section", "div", "article")), lambda e: F.struct(
                (e["start"] - at).alias("start"), (F.least(e["end"], stop) - at).alias("end"))).alias("blocks"))))

    return _let(tokens, lambda x: _let(_main_area(x), lambda at: F.when(at.isNotNull(), _let(
        _elements(_moves(x), F.size(x)), lambda elements: parts(x, at, elements)))))


def topic_sections(pages: DataFrame, id_col: str, html: str,
                   topics: dict[str, tuple[str, ...]] = vocab.SECTION_KEYWORDS,
                   sections: int = 3, max_length: int = 1500) -> DataFrame:
    """One column `{topic}_text` per topic: the first sections of the main area that mention it.

    Sections are section, div and article elements; without one that mentions a topic word the whole
    main area is taken, and a page without any area gives null. Works inside each row.
    """
    def lines(pieces: Column) -> Column:
        return _let(F.array_join(F.filter(pieces, lambda p: p != ""), "\n"),
                    lambda t: text.cut(t, max_length))

    def inside(texts: Column, block: Column) -> Column:
        return F.slice(texts, block["start"] + 1, block["end"] - block["start"] - 1)

    # a block without the topic holds no block with it: those are passed over, so blocks that are
    # read and missed never overlap, and reading ends with the last section wanted
    place = "array<struct<start:int,end:int>>"

    def about(words: tuple[str, ...]):
        def step(texts: Column):
            def one(acc: Column, block: Column) -> Column:
                said = F.lower(F.array_join(inside(texts, block), ""))
                hit = F.struct(acc["until"].alias("until"),
                               F.array_append(acc["found"], block).cast(place).alias("found"))
                miss = F.struct(block["end"].alias("until"), acc["found"].alias("found"))
                mentions = _let(said, lambda words_: text.contains_any(words_, words))
                return F.when((F.size(acc["found"]) >= sections) | (block["start"] < acc["until"]),
                              acc).otherwise(F.when(mentions, hit).otherwise(miss))
            return one

        def read(area: Column) -> Column:
            none = F.struct(F.lit(0).alias("until"), F.array().cast(place).alias("found"))
            found = F.aggregate(area["blocks"], none, step(area["texts"]), lambda acc: acc["found"])
            return _let(found, lambda hits: lines(
                F.when(F.size(hits) > 0, F.flatten(F.transform(hits, lambda b: inside(area["lines"], b))))
                .otherwise(area["lines"])))
        return read

    seen = pages.select(id_col, _area(_without(_tokens(F.col(html)), _SIDE)).alias("_area"))
    return seen.select(id_col, *[
        F.when(F.col("_area").isNotNull(), _let(F.col("_area"), about(words))).alias(f"{topic}_text") for topic, words in topics.items()])
