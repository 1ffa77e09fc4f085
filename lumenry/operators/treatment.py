"""Citations with their places, how passages treat them, and what that makes of each cited text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions.patterns import AIR_CITATION, CITED_CASE, LEGAL, PROFILE_CITATION, SCC_CITATION, SEVERITY, PatternSet

WINDOW, SNIPPET = 200, 80


PLACED = "array<struct<raw:string,start:int>>"


def matches_with_places(text: Column, pattern: str) -> Column:
    """array<struct<raw, start>> of a pattern's matches, start from 0.

    A split on the same pattern gives what lies between matches; one fold over both carries the place along.
    """
    begin = F.struct(F.array().cast(PLACED).alias("out"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        return F.struct(F.array_append(s["out"], F.struct(x["raw"].alias("raw"), start.alias("start"))).alias("out"), (start + F.length(x["raw"])).alias("at"))

    pairs = F.zip_with(T.found(text, pattern), F.split(text, pattern, -1), lambda r, g: F.struct(r.alias("raw"), g.alias("gap")))
    return F.aggregate(F.filter(pairs, lambda x: x["raw"].isNotNull()), begin, step, lambda s: s["out"])


def court_citation_key(raw: Column) -> Column:
    """One key for all spellings of a citation: reporter, year, court in capitals and number; volumes don't count."""
    air = lambda g: F.regexp_extract(raw, AIR_CITATION, g)
    scc = lambda g: F.regexp_extract(raw, SCC_CITATION, g)
    court = F.when(scc(4) != "", F.concat(F.lit(" "), F.upper(scc(4)))).otherwise("")
    online = F.when(scc(3) != "", " OnLine").otherwise("")
    return F.when(air(1) != "", F.concat(F.lit("AIR "), air(1), F.lit(" "), F.upper(air(2)), F.lit(" "), air(3))).otherwise(F.concat(scc(1), F.lit(" SCC"), online, court, F.lit(" "), scc(5)))


def court_citations(text: Column) -> Column:
    """Both reporters' citations in order of place, with keys."""
    both = F.concat(matches_with_places(text, AIR_CITATION), matches_with_places(text, SCC_CITATION))
    keyed = F.transform(both, lambda m: F.struct(m["start"].alias("start"), m["raw"].alias("raw"), court_citation_key(m["raw"]).alias("key")))
    return F.array_sort(keyed)


def treatment(window: Column, patterns: PatternSet = LEGAL) -> Column:
    """The strongest treatment that a window signals; referred if none."""
    return reduce(lambda x, k: F.when(F.rlike(window, F.lit(patterns.treatments[k])), k).otherwise(x), reversed(list(patterns.treatments)), F.lit("referred"))


def around(text: Column, start: Column, raw: Column, width: int) -> Column:
    """The text from width characters before a match to width after it."""
    begin = F.greatest(start - width, F.lit(0))
    return F.substring(text, begin + 1, start + F.length(raw) + width - begin)


def mentions(docs: DataFrame, id: str = "id", text: str = "text", patterns: PatternSet = LEGAL) -> DataFrame:
    """citation_key, source_doc_id, treatment, raw, snippet, start: one row a citation."""
    if patterns.citation == AIR_CITATION:
        listed = court_citations(F.col(text))
    else:
        listed = F.transform(matches_with_places(F.col(text), patterns.citation), lambda m: F.struct(m["start"].alias("start"), m["raw"].alias("raw"), m["raw"].alias("key")))
    found = docs.select(F.col(id).alias("source_doc_id"), F.col(text).alias("text"), listed.alias("listed"))
    rows = found.select("source_doc_id", "text", F.explode("listed").alias("m"))
    place, raw = F.col("m.start"), F.col("m.raw")
    return rows.select(
        F.col("m.key").alias("citation_key"), "source_doc_id", treatment(around(F.col("text"), place, raw, WINDOW), patterns).alias("treatment"),
        raw.alias("raw"), F.trim(around(F.col("text"), place, raw, SNIPPET)).alias("snippet"), place.alias("start"),
    )


def severity(label: Column) -> Column:
    return reduce(lambda x, k: F.when(label == k, SEVERITY[k]).otherwise(x), SEVERITY, F.lit(None).cast("int"))


def worst_treatment(found: DataFrame) -> DataFrame:
    """citation_key and the severest treatment that any mention gives it."""
    return found.groupBy("citation_key").agg(F.max_by("treatment", severity(F.col("treatment"))).alias("worst"), F.count("*").alias("n"))


def treatment_stats(found: DataFrame) -> DataFrame:
    """Mentions and distinct citations, by treatment and over all (null treatment)."""
    return found.cube("treatment").agg(F.count("*").alias("mentions"), F.count_distinct("citation_key").alias("citations"))


def warnings(chunks: DataFrame, worst: DataFrame, id: str = "id", text: str = "text", patterns: PatternSet = LEGAL) -> DataFrame:
    """id, warning: what negative treatment the corpus gives citations that a chunk names."""
    named = mentions(chunks, id, text, patterns).select(F.col("source_doc_id").alias("id"), "citation_key").distinct()
    bad = worst.where(F.col("worst").isin("overruled", "distinguished"))
    line = F.concat("citation_key", F.lit(" was "), "worst")
    return named.join(bad, "citation_key").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(line)), "; ").alias("warning"))


def cited_cases(docs: DataFrame, id: str = "id", text: str = "text", pattern: str = CITED_CASE) -> DataFrame:
    """id, name, citation of every citation that stands in brackets after the names of its case."""
    both = F.zip_with(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(2)), lambda a, b: F.struct(T.strip(a).alias("name"), T.squeeze(b).alias("citation")))
    return docs.select(F.col(id).alias("id"), F.explode(both).alias("c")).select("id", "c.name", "c.citation")


def citation_profile(docs: DataFrame, id: str = "id", text: str = "text", citation: str = PROFILE_CITATION, named: str = CITED_CASE) -> DataFrame:
    """One row: texts, those that cite, distinct citations, their occurrences, and those with a case's names.

    Occurrences are counted by citation first, so what is told apart is one row a citation.
    """
    found = docs.select(T.found(F.col(text), citation).alias("c"), F.size(T.found(F.col(text), named)).alias("n"))
    sizes = found.agg(F.count("*").alias("texts"), F.count_if(F.size("c") > 0).alias("citing"), F.coalesce(F.sum(F.size("c")), F.lit(0)).cast("long").alias("occurrences"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("named"))
    kinds = found.select(F.explode("c").alias("c")).select(T.squeeze(F.col("c")).alias("c")).groupBy("c").agg(F.count("*").alias("k")).agg(F.count("*").alias("distinct_citations"))
    return sizes.withColumn("one", F.lit(1)).join(kinds.withColumn("one", F.lit(1)), "one").drop("one")


def most_cited(docs: DataFrame, n: int = 5, text: str = "text", citation: str = PROFILE_CITATION) -> DataFrame:
    """The citations that stand at most places; ties by the citation."""
    each = docs.select(F.explode(T.found(F.col(text), citation)).alias("c")).groupBy(T.squeeze(F.col("c")).alias("citation")).agg(F.count("*").alias("n"))
    return each.orderBy(F.desc("n"), "citation").limit(n)
