"""Patterns learned from urls: shapes that several urls share, and the best shape for a url."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions import urls
from hearthline.operators import pages as page_rules


def shapes(pages: DataFrame, least: int = 2) -> DataFrame:
    """host, shape, n: paths with their numbers taken out, of at least so many urls of a host."""
    return pages.select(urls.host(F.col("url")).alias("host"), urls.shape(urls.path(F.col("url"))).alias("shape")).groupBy("host", "shape").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def confidence(n: str) -> Column:
    return F.least(F.col(n) / 10.0, F.lit(1.0))


def matched(pages: DataFrame, learned: DataFrame) -> DataFrame:
    """Each url with the confidence of its own shape on its host, null if that was not learned."""
    named = pages.select("page_id", urls.host(F.col("url")).alias("host"), urls.shape(urls.path(F.col("url"))).alias("shape"))
    return named.join(learned.withColumn("confidence", confidence("n")), ["host", "shape"], "left").select("page_id", "confidence")


# How far examples are trusted, by their number, for each kind of pattern.


def url_confidence(n: Column) -> Column:
    return F.least(n / 10.0, F.lit(1.0))


def content_confidence(n: Column) -> Column:
    return F.least(F.greatest(n / 5.0, F.lit(0.3)), F.lit(1.0))


def reference_confidence(n: Column) -> Column:
    return F.least(0.3 + (n - 1) * 0.1, F.lit(0.95))


def general_forms(path: Column) -> Column:
    """A path's patterns: itself, with numbers out, its first two parts and anything, its last part a number. The same pattern may
    come twice, and then counts twice."""
    bare = F.regexp_replace(path, r"/\z", "")
    parts = F.split(bare, "/")
    return F.array_compact(
        F.array(
            bare,
            F.when(bare.rlike(r"\d"), urls.shape(bare)),
            F.when(F.size(parts) > 2, F.concat(F.array_join(F.slice(parts, 1, 3), "/"), F.lit("/*"))),
            F.when((F.size(parts) > 3) & F.element_at(parts, -1).rlike(r"\d"), F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/"), F.lit("/{id}"))),
        )
    )


#: What a query string is used for, by what it has. Fixed values.
QUERY_USES = (("has_pagination", "page=|pagina="), ("has_filters", "filtro|filter"), ("has_sorting", "ordenar|sort"), ("has_search", "busca|search|q="))


def query_uses(query: Column) -> Column:
    return F.array_compact(F.array(*[F.when(query.rlike(pattern), name) for name, pattern in QUERY_USES]))


def generalised(pages: DataFrame) -> DataFrame:
    """pages: id, url, kind. One row for each pattern of each url."""
    forms = F.concat(general_forms(urls.path(F.col("url"))), query_uses(urls.query(F.col("url"))))
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return pages.select("id", "kind", host.alias("host"), F.explode(forms).alias("pattern"))


def url_patterns(pages: DataFrame, least: int = 2) -> DataFrame:
    """kind, pattern, n, confidence: of the patterns that a host has least examples of, all hosts' examples together."""
    by_host = generalised(pages).groupBy("kind", "host", "pattern").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return by_host.groupBy("kind", "pattern").agg(F.sum("n").alias("n")).withColumn("confidence", url_confidence(F.col("n")))


def by_url_patterns(pages: DataFrame, learned: DataFrame) -> DataFrame:
    """id, kind, confidence of each url by the best patterns of both kinds. A url names the patterns that can match it and is joined
    to them by equality: no url meets every pattern."""
    path = urls.path(F.col("url"))
    parts = F.split(path, "/")
    parent = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    # what patterns with a star begin with ends within the second part: general_forms makes no others
    second, before = F.coalesce(F.get(parts, F.lit(2)), F.lit("")), F.concat(F.array_join(F.slice(parts, 1, 2), "/"), F.lit("/"))
    begins = F.transform(F.sequence(F.lit(0), F.length(second)), lambda n: F.concat(before, F.substring(second, F.lit(1), n), F.lit("/*")))
    begins = F.when(F.size(parts) > 2, begins).otherwise(F.array().cast("array<string>"))
    exact = F.array_compact(F.array(path, urls.shape(path), F.when(F.element_at(parts, -1).rlike(r"^\d+\z"), F.concat(parent, F.lit("/{id}")))))
    named = pages.select("id", F.explode_outer(F.array_distinct(F.concat(F.filter(F.concat(exact, begins), lambda p: p.contains("/")), query_uses(urls.query(F.col("url")))))).alias("pattern"))
    worth = F.when(F.col("pattern").contains("/"), F.col("confidence")).otherwise(0.8 * F.col("confidence"))
    of = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, worth)), F.lit(0.0)).alias(kind)
    scores = named.join(learned.select("kind", "pattern", "confidence"), "pattern", "left").groupBy("id").agg(of("catalog"), of("property"))
    best, sure = F.greatest("catalog", "property"), (F.col("catalog") != F.col("property")) & (F.greatest("catalog", "property") > 0.1)
    kind = F.when(sure & (F.col("catalog") > F.col("property")), "catalog").when(sure, "property").otherwise("unknown")
    return scores.select("id", kind.alias("kind"), F.round(F.when(sure, best).otherwise(0.0), 9).alias("confidence"))


def reference_patterns(pages: DataFrame, least: int = 2) -> DataFrame:
    """pattern, n, confidence: path patterns of reference urls, and the share of all that they cover."""
    counted = pages.select(page_rules.reference_path(F.col("url")).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    return counted.crossJoin(F.broadcast(total)).where(F.col("n") >= least).select("pattern", "n", (F.col("n") / F.col("total")).alias("confidence"))


def _segments(patterns: DataFrame, name: str) -> DataFrame:
    """A row for each segment behind the first slash: place, segment (any with a brace count as one), and how many the pattern has."""
    parts = F.split(name, "/")
    rows = patterns.select(name, F.size(parts).alias(f"{name}_size"), F.posexplode(parts).alias("place", "segment"))
    return rows.withColumn("segment", F.when(F.col("segment").contains("{"), "{").otherwise(F.col("segment")))


def by_reference(pages: DataFrame, learned: DataFrame) -> DataFrame:
    """id, confidence, accepted of each url against reference patterns. Distinct path patterns meet learned ones by the segments
    that they share, so nothing is compared with everything; what is before the first slash, the same for all, counts by itself."""
    url, path = F.col("url"), F.lower(urls.path(F.col("url")))
    named = pages.select("id", path.alias("path"), page_rules.reference_path(url).alias("pattern"), page_rules.excluded_path(url).alias("excluded"))
    shapes, known = named.select("pattern").distinct(), learned.select(F.col("pattern").alias("known")).distinct()
    ours, theirs = _segments(shapes, "pattern"), _segments(known, "known")
    first = lambda rows, name: rows.where("place = 0").select(name, F.col("segment").alias(f"{name}_first"))
    met = ours.where("place > 0").join(theirs.where("place > 0"), ["place", "segment"]).groupBy("pattern", "known", "pattern_size", "known_size").agg(F.count("*").alias("same"))
    met = met.join(first(ours, "pattern"), "pattern").join(first(theirs, "known"), "known")
    same = F.col("same") + (F.col("pattern_first") == F.col("known_first")).cast("int")
    shared = met.groupBy("pattern").agg(F.max(same / F.greatest("pattern_size", "known_size")).alias("shared"))
    # those that share the first part only: the shortest learned pattern is the likest
    shortest = theirs.where("place = 0").groupBy(F.col("segment")).agg(F.min("known_size").alias("known_size"))
    only = ours.where("place = 0").join(shortest, "segment").select("pattern", (1 / F.greatest("pattern_size", "known_size")).alias("only"))
    best = shapes.join(shared, "pattern", "left").join(only, "pattern", "left").select("pattern", F.greatest(F.coalesce("shared", F.lit(0.0)), F.coalesce("only", F.lit(0.0))).alias("best"))
    slashes = page_rules.count(F.col("path"), "/")
    score = F.col("best") + F.when(F.col("path").rlike(r"/\d+/?\z"), 0.2).otherwise(0.0) + F.when(slashes >= 3, 0.1).otherwise(0.0) - F.when(slashes <= 1, 0.3).otherwise(0.0)
    no = F.col("excluded") | (F.size(page_rules.keywords(F.col("path"))) == 0)
    scored = named.join(best, "pattern").select("id", F.round(F.when(no, 0.0).otherwise(score), 9).alias("confidence"))
    return scored.withColumn("accepted", F.col("confidence") >= 0.6)


#: What a path may have in place of a pattern's {id}, and what else is a number in either.
NUMBER, SLOT = r"\d+", r"((?:\d|\{id\})+)"


def _slots(path: Column) -> tuple[Column, Column]:
    """A path with each of its numbers (or {id}) as one mark, and these."""
    return F.regexp_replace(path, SLOT, "{id}"), F.regexp_extract_all(path, F.lit(SLOT), F.lit(1))


def _fits(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """path, pattern: which distinct paths are a pattern as a whole, with digits for each {id}. A path and a pattern of it have the same
    shape; a shape has few masks (which of its numbers a pattern has {id} for), and with these both are told by equality."""
    shape, slots = _slots(F.col("pattern"))
    wild = F.transform(slots, lambda s: s.contains("{id}"))
    masked = F.transform(slots, lambda s: F.when(~s.contains("{id}"), s).otherwise("*"))
    known = patterns.select("pattern", shape.alias("shape"), wild.alias("wild"), masked.alias("numbers"))
    masks = known.select("shape", "wild").distinct()
    shape, slots = _slots(F.col("path"))
    ours = paths.select("path", shape.alias("shape"), slots.alias("slots")).join(masks, "shape")
    ours = ours.withColumn("numbers", F.zip_with("slots", "wild", lambda s, w: F.when(~w, s).otherwise("*")))
    met = ours.join(known, ["shape", "wild", "numbers"])
    # numbers that are partly given (1{id}), and paths that hold a brace, are told by the pattern itself
    regex = F.concat(F.lit(r"\A\Q"), F.replace("pattern", F.lit("{id}"), F.lit(r"\E" + NUMBER + r"\Q")), F.lit(r"\E\z"))
    return met.where(F.regexp_like("path", regex)).select("path", "pattern")


def _named_alike(names: DataFrame, bases: DataFrame) -> DataFrame:
    """host, base, known, weight: which learned base domains (known) have the same name as a host's base (0.4), lie in the host's name
    or hold its base (0.2). Parts of names meet names by equality, of those lengths only that occur."""
    lengths = lambda rows, name: rows.agg(F.collect_set(F.length(name)).alias("lengths"))  # noqa: E731  one row, a number for each length

    def parts(rows: DataFrame, name: str, of: DataFrame) -> DataFrame:
        whole = F.col(name)
        each = F.transform("lengths", lambda n: F.when(n > F.length(whole), F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(whole) - n + 1), lambda k: F.substring(whole, k, n))))
        return rows.crossJoin(F.broadcast(of)).select(name, F.explode(F.array_distinct(F.flatten(each))).alias("part"))

    hosts, ours = names.select("host").distinct(), names.select("base").distinct()
    within = parts(hosts, "host", lengths(bases, "known")).join(bases, F.col("part") == F.col("known")).select("host", "known").join(names, "host")
    around = parts(bases, "known", lengths(ours, "base")).join(ours, F.col("part") == F.col("base")).select("base", "known").join(names, "base")
    met = within.select("host", "base", "known").unionByName(around.select("host", "base", "known")).distinct()
    return met.withColumn("weight", F.when(F.col("base") == F.col("known"), 0.4).otherwise(0.2))


def best_reference(pages: DataFrame, learned: DataFrame) -> DataFrame:
    """pages: id, url; learned: name, domain, pattern, confidence. Per page: id, name of the learned pattern with the highest score, and
    the score: 0.4 for the same base domain, or 0.2 for a name within the other, 0.3 for its path, 0.3 of the confidence. Equal scores go
    by name; without learned patterns both are null.

    No page meets all patterns: a pattern that is best is best among those that share what it scores for, so each page takes the best of
    all, of its path, of its host and of both, each found by equality. The best of less is never above what its pattern really scores."""
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    rows = pages.select("id", host.alias("host"), urls.base_domain(host).alias("base"), urls.path(F.col("url")).alias("path"))
    learned = learned.select("name", urls.base_domain(F.col("domain")).alias("known"), "pattern", (F.col("confidence") * 0.3).alias("sure"))
    best = lambda points: F.min(F.struct((-F.round(points + F.col("sure"), 9)).alias("less"), "name"))
    names = rows.select("host", "base").distinct()
    met = _named_alike(names, learned.select("known").distinct()).join(learned, "known").select("host", "weight", "name", "pattern", "sure")
    fits = _fits(rows.select("path").distinct(), learned.select("pattern").distinct())
    of_all = learned.agg(best(F.lit(0.0)).alias("of_all"))  # one row
    of_path = fits.join(learned.groupBy("pattern").agg(best(F.lit(0.3)).alias("b")), "pattern").groupBy("path").agg(F.min("b").alias("of_path"))
    of_host = met.groupBy("host").agg(best(F.col("weight")).alias("of_host"))
    both = met.groupBy("host", "pattern").agg(best(F.col("weight") + 0.3).alias("b"))
    met_paths = rows.select("host", "path").distinct().join(fits, "path").join(both, ["host", "pattern"])
    of_both = met_paths.groupBy("host", "path").agg(F.min("b").alias("of_both"))
    found = rows.join(of_path, "path", "left").join(of_host, "host", "left").join(of_both, ["host", "path"], "left").crossJoin(F.broadcast(of_all))
    chosen = found.select("id", F.least("of_all", "of_path", "of_host", "of_both").alias("best"))
    return chosen.select("id", F.col("best.name").alias("name"), (-F.col("best.less")).alias("score"))
