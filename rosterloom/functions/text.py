"""String, key, URL and placeholder expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

ColumnLike = Column | str


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Every character that counts as white space, so that stripping needs no pattern matching.
_WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(c: ColumnLike) -> Column:
    """Remove any white space at both ends (plain ``trim`` only removes blanks)."""
    return F.btrim(as_col(c), F.lit(_WHITE))


def blank_to_null(c: ColumnLike) -> Column:
    return F.nullif(strip(c), F.lit(""))


def is_missing(c: ColumnLike, placeholders: str | Sequence[str] = "report") -> Column:
    """True for null and for placeholder strings; the placeholder set is a parameter."""
    words = vocab.PLACEHOLDERS[placeholders] if isinstance(placeholders, str) else placeholders
    c = as_col(c)
    return c.isNull() | F.lower(strip(c)).isin(*words)


def is_missing_array(c: ColumnLike) -> Column:
    return F.coalesce(F.size(as_col(c)) <= 0, F.lit(True))


def missing_of_type(name: str, dtype: str, placeholders: str | Sequence[str] = "report") -> Column:
    """`is_missing` chosen by the column's type (strings, arrays, everything else)."""
    if dtype == "string":
        return is_missing(name, placeholders)
    if dtype.startswith("array"):
        return is_missing_array(name)
    return F.col(name).isNull()


def truthy(c: ColumnLike, dtype: str = "string") -> Column:
    """Script-language truthiness: null, '', 0, false and empty arrays count as absent."""
    c = as_col(c)
    if dtype == "string":
        return F.coalesce(c != "", F.lit(False))
    if dtype.startswith("array"):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if dtype == "boolean":
        return F.coalesce(c, F.lit(False))
    return F.coalesce(c != 0, F.lit(False))


def contains_any(c: ColumnLike, words: Iterable[str]) -> Column:
    c = as_col(c)
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def collapse_spaces(c: ColumnLike) -> Column:
    return F.trim(F.regexp_replace(as_col(c), r"(?U)\s+", " "))


def cut(c: ColumnLike, n: int, tail: str = "...") -> Column:
    """First `n` characters; `tail` is appended only when something was cut."""
    c = as_col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(tail))).otherwise(c)


# -- keys ---------------------------------------------------------------------

def slugify(c: ColumnLike) -> Column:
    dashed = F.regexp_replace(F.lower(as_col(c)), r"[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, r"^-+|-+$", "")


def entity_id(country: ColumnLike, state: ColumnLike, city: ColumnLike, name: ColumnLike) -> Column:
    """Readable key country-state-city-name; an empty city is `unknown`, empty parts vanish."""
    city = F.coalesce(F.nullif(as_col(city), F.lit("")), F.lit("unknown"))
    parts = F.array(*[F.coalesce(slugify(p), F.lit("")) for p in (country, state, city, name)])
    return F.array_join(F.filter(parts, lambda p: p != ""), "-")


def sha_prefix(c: ColumnLike, n: int) -> Column:
    return F.substring(F.sha2(as_col(c), 256), 1, n)


def folder_hash(c: ColumnLike) -> Column:
    return F.concat(F.lit("m_"), sha_prefix(c, 8))


def lookup_key(name: ColumnLike, state: ColumnLike) -> Column:
    return sha_prefix(F.lower(F.concat_ws("|", as_col(name), as_col(state))), 16)


def url_key(url: ColumnLike) -> Column:
    return sha_prefix(url, 16)


def _json_unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))


def _quoted(c: Column) -> Column:
    """A JSON string in plain ASCII: everything outside blank to tilde is escaped."""
    named = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def one(ch: Column) -> Column:
        code = F.ascii(ch)
        above = code - 0x10000
        pair = F.concat(_json_unit(F.shiftright(above, 10) + 0xD800),
                        _json_unit(above.bitwiseAND(0x3FF) + 0xDC00))
        out = None
        for plain, escaped in named.items():
            out = (F if out is None else out).when(ch == plain, F.lit(escaped))
        return out.when(code.between(32, 126), ch).when(code > 0xFFFF, pair).otherwise(_json_unit(code))

    # plain strings, the usual case, are taken as they are
    chars = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    escaped = F.when(c.rlike(r'^[ !#-\[\]-~]*\z'), c).otherwise(F.array_join(F.transform(chars, one), ""))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def request_key(url: ColumnLike, params: ColumnLike) -> Column:
    """sha256 of the request written as JSON with sorted keys; `params` is a string map."""
    pairs = F.transform(
        F.array_sort(F.map_entries(as_col(params))),
        lambda e: F.concat(_quoted(e["key"]), F.lit(": "), _quoted(e["value"])),
    )
    body = F.concat(F.lit('{"params": {'), F.array_join(pairs, ", "), F.lit('}, "url": '),
                    _quoted(as_col(url)), F.lit("}"))
    return F.sha2(body, 256)


def slug_alias(city: ColumnLike, name: ColumnLike, entity_id: ColumnLike) -> Column:
    """`{city}-{name}--{last six characters of the id}`, dashes at the cut removed."""
    suffix = F.regexp_replace(F.right(as_col(entity_id), F.lit(6)), r"^.*-", "")
    return F.concat(slugify(city), F.lit("-"), slugify(name), F.lit("--"), suffix)


def state_of_id(id_: ColumnLike, variant: str = "strict") -> Column:
    """Region code held in the second token of an id.

    `token`: the upper-cased token.  `home`: only ids that start with `usa-`.
    `strict`: only two-letter tokens.  Everything else is null.
    """
    id_ = as_col(id_)
    token = F.nullif(F.upper(F.split_part(id_, F.lit("-"), F.lit(2))), F.lit(""))
    if variant == "token":
        return token
    if variant == "home":
        return F.when(id_.startswith("usa-"), token)
    return F.when(token.rlike("^[A-Z]{2}$"), token)


# -- URLs ---------------------------------------------------------------------

def normalize_url(c: ColumnLike) -> Column:
    no_space = F.regexp_replace(as_col(c), r"(?U)\s+", "")
    fixed = F.replace(no_space, F.lit("://%20"), F.lit("://"))
    return F.lower(F.regexp_replace(fixed, r"/+$", ""))


def normalize_website(c: ColumnLike) -> Column:
    return F.regexp_replace(strip(F.coalesce(as_col(c), F.lit(""))), r"/+$", "")


def is_http_url(c: ColumnLike) -> Column:
    return F.coalesce(as_col(c).rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))


def resolve_url(base: ColumnLike, href: ColumnLike) -> Column:
    """Absolute form of a link found on page `base` (absolute, //host, /path, ?query, relative)."""
    base, href = as_col(base), as_col(href)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    plain_base = F.regexp_replace(base, r"#.*$", "")

    def joined(path_and_more: Column) -> Column:
        return F.concat(root, without_dots(F.regexp_extract(path_and_more, r"^([^?#]*)", 1)),
                        F.regexp_extract(path_and_more, r"^[^?#]*(.*)$", 1))

    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href == "", plain_base)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), joined(href))
        .when(href.startswith("#"), F.concat(plain_base, href))
        .when(href.startswith("?"), F.concat(root, path, href))
        .otherwise(joined(F.concat(folder, href)))
    )


def without_dots(path: Column) -> Column:
    """A URL path without its `.` and `..` segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(s == ".", acc)
                       .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1))
                             .otherwise(acc))
                       .otherwise(F.array_append(acc, s)))
    # a path that ends in a dot segment names a folder
    folder = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.contains("."), F.concat(F.array_join(kept, "/"), folder)).otherwise(path)


# -- names --------------------------------------------------------------------

def match_name(c: ColumnLike, stop_words: Sequence[str] = vocab.NAME_STOP_WORDS) -> Column:
    """Name for fuzzy comparison: lower case, no stop words, no punctuation, single blanks."""
    words = "|".join(stop_words)
    out = F.regexp_replace(F.lower(F.coalesce(as_col(c), F.lit(""))), rf"(?U)\b({words})\b", "")
    out = F.regexp_replace(out, r"(?U)[^\w\s]", "")
    return collapse_spaces(out)


def plain_name(c: ColumnLike) -> Column:
    """Name for exact and containment comparison: lower case, no apostrophes or punctuation."""
    out = F.replace(F.lower(F.coalesce(as_col(c), F.lit(""))), F.lit("'"), F.lit(""))
    out = F.regexp_replace(out, r"(?U)[^\w\s]", "")
    return collapse_spaces(out)


# -- markup and time ----------------------------------------------------------

def iso_utc(ts: ColumnLike) -> Column:
    return F.date_format(as_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def json_object_in(c: ColumnLike) -> Column:
    """Text from the first `{` to the last `}`; null when there is none."""
    return F.nullif(F.regexp_extract(as_col(c), r"(?s)(\{.*\})", 1), F.lit(""))


def infobox_population(c: ColumnLike) -> Column:
    digits = F.regexp_extract(as_col(c), r"(?i)population[_\s]*total\s*=\s*([0-9,]+)", 1)
    return F.regexp_replace(digits, ",", "").try_cast("bigint")
