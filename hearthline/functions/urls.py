"""URL forms. Each canonical form is an operator of its own: they differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def for_hash(url: Column) -> Column:
    """Without coded blanks and doubled slashes (one pass), one trailing slash and, unless it names an id, the query."""
    plain = F.regexp_replace(F.replace(F.replace(url, F.lit("%20"), F.lit("")), F.lit("//"), F.lit("/")), r"/\z", "")
    query = F.when(F.instr(plain, "?") > 0, F.regexp_extract(plain, r"(?s)\?(.*)", 1))
    keep = query.isNull() | query.contains("id=") | query.contains("imovel=")
    return F.trim(F.lower(F.when(keep, plain).otherwise(F.regexp_replace(plain, r"(?s)\?.*", ""))))


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)[?#].*", "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def base_domain(name: Column) -> Column:
    """The last two labels, of .br names the last three, without www."""
    parts = F.split(F.regexp_replace(name, r"^www\.", ""), r"\.")
    keep = F.when(F.element_at(parts, -1) == "br", 3).otherwise(2)
    n = F.least(keep, F.size(parts))
    return F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")


def shape(url_path: Column) -> Column:
    return F.regexp_replace(url_path, r"\d+", "{id}")


def query(url: Column) -> Column:
    """What follows the question mark, without the fragment."""
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def _authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def _parameters(url: Column, keep) -> Column:
    """Those parameters whose lower-cased key keep accepts, by key, first come first, each with an equals sign. Escapes stay as they are."""
    given = F.filter(F.split(query(url), "&"), lambda p: p != "")
    named = F.transform(given, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("key"), i.alias("at"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("pair")))
    kept = F.array_sort(F.filter(named, lambda p: keep(F.lower(p["key"]))))
    return F.array_join(F.transform(kept, lambda p: p["pair"]), "&")


def _with_query(base: Column, parameters: Column) -> Column:
    return F.when(parameters == "", base).otherwise(F.concat(base, F.lit("?"), parameters))


def for_crawl(url: Column) -> Column:
    """Doubled slashes of the path halved (one pass), one trailing slash off, and only parameters that may name a listing. Any key
    with id in it counts, such as cidade. Addresses without a host stay as they are."""
    plain = F.regexp_replace(F.replace(path(url), F.lit("//"), F.lit("/")), r"/\z", "")
    base = F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1), _authority(url), plain)
    return F.when(_authority(url) == "", url).otherwise(_with_query(base, _parameters(url, lambda k: k.rlike("id|imovel|property|codigo"))))


def for_discovery(url: Column) -> Column:
    """Without www., fragment and parameters whose keys have utm, ref or source in them. Addresses without a host stay as they are."""
    base = F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1), F.regexp_replace(_authority(url), r"^www\.", ""), path(url))
    return F.when(_authority(url) == "", url).otherwise(_with_query(base, _parameters(url, lambda k: ~k.rlike("utm|ref|source"))))


def resolved(link: Column, base: Column) -> Column:
    """A link as an absolute address, by plain joining: rooted links go under https, others after the whole base. Empty if it leads nowhere."""
    trimmed = F.regexp_replace(link, r"^[\s]+|[\s]+\z", "")
    joined = F.when(base.endswith("/"), F.concat(base, trimmed)).otherwise(F.concat(base, F.lit("/"), trimmed))
    return (
        F.when((trimmed == "") | (trimmed == "#") | trimmed.startswith("javascript:"), "")
        .when(trimmed.startswith("http"), trimmed)
        .when(host(base) == "", "")
        .when(trimmed.startswith("/"), F.concat(F.lit("https://"), host(base), trimmed))
        .otherwise(joined)
    )


#: Ways in which a click handler opens an address. Fixed values, in the order in which they are tried.
ONCLICK = ("window.location='", 'window.location="', "location.href='", 'location.href="', "window.open('", 'window.open("')


def from_onclick(handler: Column, base: Column) -> Column:
    """The address that a click handler opens; empty if none."""
    found = F.lit(None)
    for prefix in reversed(ONCLICK):
        quote = prefix[-1]
        rest = F.substring_index(F.substr(handler, F.instr(handler, prefix) + len(prefix)), quote, 1)
        ended = F.instr(F.substr(handler, F.instr(handler, prefix) + len(prefix)), quote) > 1
        found = F.when((F.instr(handler, prefix) > 0) & ended, rest).otherwise(found)
    return F.coalesce(resolved(found, base), F.lit(""))


#: Accented letters of city names and their plain forms. Fixed values.
CITY_ACCENTS = ("ãáàâéêíîóôõúûç", "aaaaeeiiooouuc")


def city_domain(name: Column) -> Column:
    """A city's name as part of a domain: plain lower-case letters and digits only."""
    return F.regexp_replace(F.translate(F.lower(name), *CITY_ACCENTS), "[^a-z0-9]", "")


def city_path(name: Column) -> Column:
    """A city's name as part of a path: lower case without accents, hyphens for blanks."""
    return F.translate(F.replace(F.lower(name), F.lit(" "), F.lit("-")), *CITY_ACCENTS)


def for_search(url: Column) -> Column:
    """A search result's address without query and fragment; empty if it is none."""
    return F.when(url.startswith("http"), without_query(url)).otherwise("")
