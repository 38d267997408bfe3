"""URL column functions: every one maps a string column to a column, all inside the JVM."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# The generic URI shape (scheme, authority, path, query, fragment).
URL_PATTERN = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:[?]([^#]*))?(?:#(.*))?$"
)
UNICODE_EDGE_SPACE = r"(?U)^\s+|\s+$"
NOT_PRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"
LANGUAGE_PATTERN = r"/([a-z]{2})/"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _part(url, group: int) -> Column:
    bare = F.regexp_replace(_col(url), r"^[\x00-\x20]+", "")
    return F.regexp_extract(F.regexp_replace(bare, r"[\t\r\n]", ""), URL_PATTERN, group)


def url_scheme(url) -> Column:
    return F.lower(_part(url, 1))


def url_host(url) -> Column:
    return _part(url, 2)


def _path_and_params(url) -> Column:
    return _part(url, 3)


def url_path(url) -> Column:
    return F.regexp_replace(_path_and_params(url), r"^(.*/)?([^/;]*);[^/]*$", "$1$2")


def url_params(url) -> Column:
    return F.regexp_extract(_path_and_params(url), r"^(?:.*/)?[^/;]*;([^/]*)$", 1)


def url_query(url) -> Column:
    return _part(url, 4)


def url_fragment(url) -> Column:
    return _part(url, 5)


def non_empty(parts: Column) -> Column:
    return F.filter(parts, lambda s: s != "")


def path_segments(url) -> Column:
    return F.coalesce(non_empty(F.split(url_path(url), "/")), F.array().cast("array<string>"))


def url_extension(url) -> Column:
    name = F.substring_index(url_path(url), "/", -1)
    return F.coalesce(F.lower(F.regexp_extract(name, r"^\.*[^.].*(\.[^.]*)$", 1)), F.lit(""))


def query_param_names(url) -> Column:
    with_value = F.filter(F.split(url_query(url), "&"), lambda p: p.rlike(r"^[^=]*=."))
    names = F.transform(
        with_value, lambda p: percent_decode(F.replace(F.substring_index(p, "=", 1), F.lit("+"), F.lit(" ")))
    )
    return F.coalesce(F.array_distinct(names), F.array().cast("array<string>"))


def url_language(url) -> Column:
    tag = F.regexp_extract(_col(url), LANGUAGE_PATTERN, 1)
    return F.coalesce(F.nullif(tag, F.lit("")), F.lit("unknown"))


def percent_decode(text) -> Column:
    """Decodes %XX escapes; a plus sign stays and a malformed escape is left as it is."""
    text = _col(text)
    escaped = F.regexp_replace(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.coalesce(F.try_url_decode(escaped), text)


def strip_invalid(url) -> Column:
    trimmed = F.regexp_replace(_col(url).cast("string"), UNICODE_EDGE_SPACE, "")
    return F.regexp_replace(trimmed, NOT_PRINTABLE, "")


def remove_utm(url) -> Column:
    url = _col(url)
    scheme, host = url_scheme(url), url_host(url)
    base = F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(F.lit("")),
        url_path(url),
    )
    return F.when(F.contains(url_query(url), F.lit("utm")), base).otherwise(url)


def clean_url(url) -> Column:
    """Readable form of the path: decoded, separators to spaces, lower case; query and fragment go."""
    decoded = percent_decode(remove_utm(strip_invalid(url)))
    words = F.regexp_replace(F.array_join(path_segments(decoded), " "), "[-_#]", " ")
    params = url_params(decoded)
    suffix = F.when(
        params != "", F.concat(F.lit("?"), F.array_join(F.sort_array(F.split(params, "&")), "&"))
    ).otherwise(F.lit(""))
    cleaned = F.lower(F.regexp_replace(F.concat(words, suffix), UNICODE_EDGE_SPACE, ""))
    return F.coalesce(cleaned, F.lit(""))


def parent_url(url) -> Column:
    """The URL one path level up, with a trailing slash; NULL at the root."""
    path = F.regexp_replace(url_path(url), "/+$", "")
    upper = F.regexp_extract(path, r"(?s)^(.+)/[^/]*$", 1)
    scheme, host = url_scheme(url), url_host(url)
    base = F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(F.lit("")),
    )
    return F.when(path != "", F.concat(base, upper, F.lit("/")))


def nlp_text(url) -> Column:
    return F.translate(_col(url), "/-_.", "    ")


def nlp_tokens(url) -> Column:
    return non_empty(F.split(nlp_text(url), r"\s+"))


def token_sort_key(url) -> Column:
    ascii_only = F.regexp_replace(_col(url), r"[^\x00-\x7F]", "")
    words = F.split(F.lower(F.regexp_replace(ascii_only, r"[^A-Za-z0-9_]+", " ")), " ")
    return F.array_join(F.sort_array(non_empty(words)), " ")


def chars(text) -> Column:
    return non_empty(F.split(_col(text), ""))


def char_set(url) -> Column:
    return F.array_distinct(chars(url))


def char_set_text(url) -> Column:
    """The distinct characters of a string in sorted order, as one string."""
    return F.array_join(F.sort_array(char_set(url)), "")


def substrings(text: Column, n: int) -> Column:
    """All substrings of length n, by start position; empty for shorter strings."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1)))
    found = F.transform(starts, lambda i: F.substr(text, i, F.lit(n)))
    return F.coalesce(found, F.array().cast("array<string>"))


def gram_text(url) -> Column:
    """The lower-cased text with runs of white space collapsed."""
    return F.regexp_replace(F.lower(_col(url)), r"(?U)\s\s+", " ")


def ngrams(text, low: int, high: int) -> Column:
    return F.concat(*[substrings(_col(text), n) for n in range(low, high + 1)])


def char_ngrams(url, low: int, high: int) -> Column:
    """Character n-grams of the lower-cased text with runs of white space collapsed."""
    return ngrams(gram_text(url), low, high)


def domain_key(url) -> Column:
    """Host without www. and trailing slash, dots as underscores."""
    bare = F.regexp_replace(url_host(url), r"https?://|www\.", "")
    return F.replace(F.regexp_replace(bare, "/+$", ""), F.lit("."), F.lit("_"))
