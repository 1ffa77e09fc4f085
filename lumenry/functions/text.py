"""Scalar functions over text, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from .patterns import LEGAL, LEGAL_CASE_NUMBER, NAME_STOP_WORDS, STANCES, PatternSet

REFUSAL = "INSUFFICIENT_CONTEXT"
VERDICTS = ("supported", "unsupported", "unclear")


def _strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_markup(c: Column) -> Column:
    """Plain text of a marked-up one: spans with what they hold and all other tags become spaces, lines keep their order."""
    steps = ((r"(?s)<span[^>]*>.*?</span>", " "), (r"<[^>]+>", " "), (r"[ \t]+", " "), (r" *\n", "\n"), (r"\n{3,}", "\n\n"))
    return strip(reduce(lambda x, s: F.regexp_replace(x, *map(F.lit, s)), steps, c))


def found(c: Column, pattern: str) -> Column:
    """All matches of a pattern, in order; none for null."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), _strings())


def tokenize(c: Column, patterns: PatternSet = LEGAL) -> Column:
    """Identifiers kept whole, with spaces as underscores, then all lower-case runs of letters and digits."""
    whole = F.transform(found(c, patterns.tokens), lambda x: F.replace(x, F.lit(" "), F.lit("_")))
    return F.concat(whole, found(F.lower(c), "[a-z0-9]+"))


def identifiers(c: Column, patterns: PatternSet = LEGAL) -> Column:
    """Distinct identifiers of a text, sorted, with single spaces."""
    each = [F.transform(found(c, p), squeeze) for p in patterns.identifiers.values()]
    return F.array_sort(F.array_distinct(F.concat(*each)))


def query_kind(c: Column, patterns: PatternSet = LEGAL) -> Column:
    return F.when(F.size(identifiers(c, patterns)) > 0, "identifier").otherwise("conceptual")


# Weights of courts, by what their name holds; the first that fits counts.
COURT_WEIGHTS = (("supreme_court", 1.00), ("high_court_db", 0.85), ("high_court_sb", 0.75), ("tribunal", 0.60))
OTHER_COURT = 0.70


def authority(court: Column, cited_by: Column, weights: tuple = COURT_WEIGHTS, other: float = OTHER_COURT) -> Column:
    """A weight of a court's kind, raised by how often the text is cited; a count that can't be read is 1."""
    kind = F.replace(F.lower(F.coalesce(court, F.lit(""))), F.lit(" "), F.lit("_"))
    base = F.lit(other)
    for name, weight in reversed(weights):
        base = F.when(F.contains(kind, F.lit(name)), weight).otherwise(base)
    count = F.coalesce(cited_by.cast("string").try_cast("double"), F.lit(1.0))
    return base + F.least(F.log1p(F.greatest(count, F.lit(0.0))) / F.log1p(F.lit(1000.0)), F.lit(0.3))


def stance(c: Column, patterns: PatternSet = LEGAL) -> Column:
    argues, holds = F.rlike(c, F.lit(patterns.argument)), F.rlike(c, F.lit(patterns.holding))
    return F.when(argues & holds, "both").when(argues, "argument").when(holds, "holding").otherwise("neither")


def stance_order(label: Column) -> Column:
    return reduce(lambda x, k: F.when(label == k, STANCES[k][0]).otherwise(x), STANCES, F.lit(None).cast("int"))


def stance_note(label: Column) -> Column:
    return reduce(lambda x, k: F.when(label == k, STANCES[k][1]).otherwise(x), STANCES, F.lit(None).cast("string"))


def case_number(c: Column) -> Column:
    """The first case number in the first 3,000 characters, or an empty string."""
    return strip(F.regexp_extract(F.substring(c, 1, 3000), LEGAL_CASE_NUMBER, 0))


def context_prefix(court: Column, title: Column, text: Column, summary: Column | None = None) -> Column:
    """Header of every chunk of a document: what there is of court, title and case number, then a summary."""
    parts = F.filter(F.array(court, title, case_number(text)), lambda x: x.isNotNull() & (x != ""))
    header = F.array_join(parts, " | ")
    if summary is None:
        return header
    return F.when(summary.isNotNull() & (summary != ""), F.concat(header, F.lit("\n\nSummary: "), summary)).otherwise(header)


def cache_key(c: Column) -> Column:
    return F.lower(squeeze(c))


def significant(c: Column) -> Column:
    """Distinct words of a party's name that tell it from others."""
    words = F.filter(found(F.lower(c), "[a-z]+"), lambda w: (F.length(w) > 2) & ~w.isin(NAME_STOP_WORDS))
    return F.array_distinct(words)


def contains_all(have: Column, want: Column) -> Column:
    return F.size(F.array_except(want, have)) == 0


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) where use names its argument inside lambdas: bound to a variable, it is computed once and not for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ngrams(words: Column, n: int) -> Column:
    """Distinct runs of n words as strings; none of a shorter text."""
    starts = lambda w: F.when(F.size(w) >= n, F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return once(words, lambda w: F.array_distinct(F.transform(starts(w), lambda i: F.array_join(F.slice(w, i, n), " "))))


def shares_run(a: Column, b: Column, n: int = 6) -> Column:
    """Whether two texts share a run of n lower-case words."""
    words = lambda c: found(F.lower(c), "[a-z0-9]+")
    return F.arrays_overlap(ngrams(words(a), n), ngrams(words(b), n))


CITED = r"\[\s*[0-9]{1,3}(?:\s*,\s*[0-9]{1,3})*\s*\]"


def cited_numbers(answer: Column) -> Column:
    """Distinct numbers in square brackets, of three digits at most, in order of first use."""
    numbers = F.flatten(F.transform(found(answer, CITED), lambda x: F.transform(found(x, "[0-9]+"), lambda n: n.cast("int"))))
    return F.array_distinct(numbers)


def parsed_answer(answer: Column, n_sources: Column) -> Column:
    """struct(refused, cited, invalid): an answer is refused if it begins with the sentinel."""
    numbers = cited_numbers(answer)
    inside = lambda x: (x >= 1) & (x <= n_sources)
    return F.struct(
        F.startswith(strip(answer), F.lit(REFUSAL)).alias("refused"), F.filter(numbers, inside).alias("cited"), F.filter(numbers, lambda x: ~inside(x)).alias("invalid")
    )


def without_thoughts(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def verdict(reply: Column) -> Column:
    """The first word of a judge's reply, if it is a verdict."""
    word = F.regexp_replace(F.regexp_extract(F.lower(strip(reply)), r"^(\S+)", 1), r"^[.,:;]+|[.,:;]+$", "")
    return F.when(word.isin(*VERDICTS), word).otherwise("unclear")


def relevance_letter(reply: Column) -> Column:
    """y, p or n: the first of these that a reply holds, no if none."""
    low = F.lower(F.coalesce(reply, F.lit("")))
    return F.when(F.contains(low, F.lit("y")), "y").when(F.contains(low, F.lit("p")), "p").otherwise("n")


def sub_questions(reply: Column, most: int = 3) -> Column:
    """Lines of a reply without their list marks; the first few that aren't blank."""
    lines = F.transform(F.split(reply, "\n"), lambda x: strip(F.regexp_replace(strip(x), r"^[0-9.\-*\s]+", "")))
    return F.slice(F.filter(lines, lambda x: x != ""), 1, most)


# How a model's own reasoning begins, what it says, and the longest summary that is one.
LEAKS = ("we need", "need ", "let's ", "the user wants", "thus we need", "tags,", "tags.", "we must", "okay,", "ok,")
LEAKED = "no reasoning inside"
LONGEST_SUMMARY = 2500


def summary_of(reply: Column) -> Column:
    """What stands between summary tags; null where that is missing, too long or reads like reasoning."""
    inner = strip(F.regexp_extract(reply, r"(?s)<summary>(.*?)</summary>", 1))
    low = F.lower(inner)
    leaks = reduce(lambda x, p: x | F.startswith(low, F.lit(p)), LEAKS, F.contains(low, F.lit(LEAKED)))
    return F.when((inner != "") & (F.length(inner) <= LONGEST_SUMMARY) & ~leaks, inner)


def structured_answer(reply: Column, n_sources: Column | None = None) -> Column:
    """struct(refused, text, cited, invalid) of a structured reply: whole claims with their sources; none of them is a refusal.

    Numbers that aren't whole are dropped, and claims without text or numbers; cited and invalid are as in parsed_answer,
    without n_sources all are cited.
    """
    from ..schemas import STRUCTURED_ANSWER

    parsed = F.from_json(reply, STRUCTURED_ANSWER)
    numbers = lambda c: F.transform(F.filter(F.coalesce(c["source_ids"], _strings()), lambda x: F.rlike(x, F.lit(r"^-?[0-9]{1,9}$"))), lambda x: x.cast("int"))
    claims = F.transform(F.coalesce(parsed["claims"], F.array().cast("array<struct<text:string,source_ids:array<string>>>")), lambda c: F.struct(F.coalesce(strip(c["text"]), F.lit("")).alias("text"), numbers(c).alias("ids")))
    whole = F.filter(claims, lambda c: (c["text"] != "") & (F.size(c["ids"]) > 0))
    lines = F.transform(whole, lambda c: F.concat(c["text"], F.lit(" ["), F.array_join(F.transform(c["ids"], lambda n: n.cast("string")), ", "), F.lit("]")))
    refused = F.coalesce(parsed["refused"], F.lit(False)) | (F.size(whole) == 0)
    seen = F.array_distinct(F.flatten(F.transform(whole, lambda c: c["ids"])))
    inside = (lambda x: F.lit(True)) if n_sources is None else (lambda x: (x >= 1) & (x <= n_sources))
    return F.struct(
        refused.alias("refused"), F.when(refused, F.lit(REFUSAL)).otherwise(F.array_join(lines, "\n\n")).alias("text"),
        F.filter(seen, inside).alias("cited"), F.filter(seen, lambda x: ~inside(x)).alias("invalid"),
    )


def client_key(forwarded: Column, peer: Column) -> Column:
    """The first hop that a request names, else its peer, else unknown."""
    hop = F.trim(F.element_at(F.split(forwarded, ","), 1))
    return F.coalesce(F.when(hop != "", hop), peer, F.lit("unknown"))


def chunk_place(id: Column) -> Column:
    """struct(doc_id, idx) of a chunk's id, cut at its last #; an id without a number behind one is a document's own, without idx."""
    found = F.regexp_extract(id, r"(?s)^(.*)#([0-9]+)$", 2)
    return F.struct(F.when(found == "", id).otherwise(F.regexp_extract(id, r"(?s)^(.*)#([0-9]+)$", 1)).alias("doc_id"), F.nullif(found, F.lit("")).cast("int").alias("idx"))
