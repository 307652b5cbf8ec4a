"""Column expressions on names, documentation and paths; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(c: Column) -> Column:
    """Empty text counts as none."""
    return F.coalesce(F.length(c) > 0, F.lit(False))


def has(text: Column, part: str) -> Column:
    """Case-insensitive substring; false for null."""
    return F.coalesce(F.contains(F.lower(text), F.lit(part.lower())), F.lit(False))


def word_set(text: Column) -> Column:
    """Distinct white-space words of the lower-cased text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def identifier_words(name: Column) -> Column:
    """Runs of a-z in the lower-cased name."""
    return F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit("([a-z]+)"), 1))


def overlap(a: Column, words: list[str]) -> Column:
    if not words:
        return F.lit(0)
    return F.coalesce(F.size(F.array_intersect(a, F.array(*map(F.lit, words)))), F.lit(0))


def query_words(query: str) -> list[str]:
    return sorted(set(query.lower().split()))


def name_score(name: Column, query: str) -> Column:
    """10 for the same name, 5 for a name around the query, 3 for a name within it; case ignored."""
    q, n = F.lit(query.lower()), F.lower(name)
    return F.when(n == q, 10.0).when(F.contains(n, q), 5.0).when(F.contains(q, n), 3.0).otherwise(0.0)


def relevance(query: str, name: Column, doc: Column, path: Column) -> Column:
    """Search score: name, words of the name, documentation and its words, path."""
    words = query_words(query)
    documented = truthy(doc)
    return (
        name_score(name, query)
        + 2.0 * overlap(identifier_words(name), words)
        + F.when(documented & has(doc, query), 2.0).otherwise(0.0)
        + F.when(documented, 0.5 * overlap(word_set(doc), words)).otherwise(0.0)
        + F.when(has(path, query), 1.0).otherwise(0.0)
    )


def hybrid_relevance(query: str, name: Column, doc: Column) -> Column:
    """Search score without words of the documentation and without the path."""
    return name_score(name, query) + 2.0 * overlap(identifier_words(name), query_words(query)) + F.when(truthy(doc) & has(doc, query), 2.0).otherwise(0.0)


def weighted_relevance(query: str, name: Column, doc: Column, path: Column, usage: Column | None = None) -> Column:
    """Recommendation score in 0..1: name 0.4, documentation 0.3, path 0.2, usage 0.1."""
    words, q, n = query_words(query), F.lit(query.lower()), F.lower(name)
    by_name = F.when(n == q, 1.0).when(F.contains(n, q), 0.7).when(F.contains(q, n), 0.5).otherwise(F.least(0.3 * overlap(identifier_words(name), words), F.lit(0.9)))
    by_doc = F.when(~truthy(doc), 0.0).when(has(doc, query), 0.8).otherwise(F.least(0.2 * overlap(word_set(doc), words), F.lit(0.7)))
    score = by_name * 0.4 + by_doc * 0.3 + F.when(has(path, query), 0.5).otherwise(0.0) * 0.2
    if usage is None:
        return score
    return score + F.when(usage > 10, 1.0).when(usage > 5, 0.7).when(usage > 0, 0.4).otherwise(0.0) * 0.1


def glob_regex(pattern: str) -> str:
    """Glob on paths: ** crosses folders, * and ? do not."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in r".^$+{}()|[]\\" else c)
            i += 1
    return f"^{out}$"


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def cut_short(doc: Column, length: int = 200) -> Column:
    """The first characters, without a sign that something is missing."""
    return F.substring(doc, 1, length)


def clipped(doc: Column, length: int = 200) -> Column:
    """The first characters, with dots when something is missing."""
    return F.when(F.length(doc) > length, F.concat(F.substring(doc, 1, length), F.lit("..."))).otherwise(doc)


def version_parts(version: Column) -> Column:
    return F.transform(F.split(version, r"\."), lambda x: x.try_cast("int"))


def version_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for dotted numbers, missing parts being 0; 0 when a part is no number."""
    x, y = version_parts(a), version_parts(b)
    n = F.greatest(F.size(x), F.size(y))
    pad = lambda v: F.concat(v, F.array_repeat(F.lit(0), n - F.size(v)))
    broken = F.exists(x, lambda p: p.isNull()) | F.exists(y, lambda p: p.isNull())
    return F.when(broken, 0).when(pad(x) < pad(y), -1).when(pad(x) > pad(y), 1).otherwise(0)


def semver_key(version: Column) -> Column:
    """A struct that sorts by SemVer: numbers, then a release after its pre-releases."""
    pattern = r"^v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?$"
    part = lambda n: F.regexp_extract(version, pattern, n)
    pre = part(4)
    parts = F.transform(F.split(pre, r"\."), lambda p: F.struct((p.try_cast("bigint").isNull()).alias("text"), F.coalesce(p.try_cast("bigint"), F.lit(0)).alias("number"), p.alias("word")))
    return F.when(
        F.regexp_like(version, F.lit(pattern)),
        F.struct(part(1).cast("int").alias("major"), part(2).cast("int").alias("minor"), part(3).cast("int").alias("patch"), (pre == "").alias("release"), F.when(pre != "", parts).alias("pre")),
    )
