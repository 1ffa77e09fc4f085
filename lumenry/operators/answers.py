"""Prompts, answers, claims and their audit."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.patterns import LEGAL, PatternSet
from ..storage import stored
from .places import numbered

BUDGET = 6000
NO_SOURCES = "(no sources retrieved)"
RULES = (
    "Answer from the numbered sources alone. After each statement, name the sources that carry it in square brackets. "
    f"If the sources don't answer the question, reply {T.REFUSAL} and nothing else."
)
STRUCTURED = 'Answer from the numbered sources alone, as JSON: {"refused": false, "claims": [{"text": "...", "source_ids": [1]}]}.'
REMINDER = "Name sources in square brackets."


def pack_sources(results: DataFrame, budget: int = BUDGET, notes: bool = True, patterns: PatternSet = LEGAL) -> DataFrame:
    """results(query_id, query, rank, text) that fit the budget in order of rank, with block and used.

    The first source always fits; the first one that overflows ends the list, so sums from the best rank on tell all.
    """
    ranked = results.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    note = F.concat(F.lit("("), T.stance_note(T.stance(F.col("text"), patterns)), F.lit(") ")) if notes else F.lit("")
    block = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), note, F.col("text"))
    upto = Window.partitionBy("query_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    sized = ranked.withColumn("block", block).withColumn("spent", F.length("query") + F.sum(F.length("block")).over(upto))
    over = F.max(F.when((F.col("n") > 1) & (F.col("spent") > budget), 1).otherwise(0)).over(upto)
    return sized.withColumn("over", over).where("over = 0").drop("over")


def prompts(queries: DataFrame, packed: DataFrame, remind: bool = True) -> DataFrame:
    """query_id, prompt, n_sources; a query without sources says so."""
    blocks = packed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "block"))).alias("b"))
    joined = queries.select("query_id", "query").join(blocks, "query_id", "left")
    body = F.coalesce(F.array_join(F.transform("b", lambda x: x.block), "\n\n"), F.lit(NO_SOURCES))
    prompt = F.concat(F.lit("Sources:\n\n"), body, F.lit("\n\nQuestion: "), "query", F.lit(f"\n{REMINDER}" if remind else ""), F.lit("\n\nAnswer:"))
    return joined.select("query_id", prompt.alias("prompt"), F.coalesce(F.size("b"), F.lit(0)).alias("n_sources"))


def source_lines(results: DataFrame, warnings: DataFrame, patterns: PatternSet = LEGAL) -> DataFrame:
    """results(query_id, rank, id, court, text) with a line for a reader: number, stance, court, text and what to beware of.

    warnings: id, warning. Rows are numbered over the whole table by ranges, from which each query's first place is taken, so
    that no task has all of one query's texts.
    """
    placed, _ = numbered(results, "query_id", "rank", place="__place")
    first = stored(placed.groupBy(F.col("query_id").alias("__query")).agg(F.min("__place").alias("__first")), "first_places")
    head = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] ("), T.stance_note(T.stance(F.col("text"), patterns)), F.lit(") "), F.coalesce("court", F.lit("unknown court")), F.lit(": "), "text")
    lines = placed.join(first, F.col("query_id").eqNullSafe(F.col("__query"))).withColumn("n", (F.col("__place") - F.col("__first") + 1).cast("int"))
    lines = lines.drop("__place", "__query", "__first").join(warnings, "id", "left")
    return lines.withColumn("line", F.concat(head, F.coalesce(F.concat(F.lit("\nCAUTION: "), "warning"), F.lit("")))).drop("warning")


# A run of bracketed numbers of three digits at most, and the shortest span that is a claim.
CITED_RUN = re.compile(r"(?:\[\s*\d{1,3}(?:\s*,\s*\d{1,3})*\s*\]\s*)+")
SHORTEST = 15


@dataclass
class Claim:
    text: str
    cited: list[int]
    start: int


def split_claims(text: str, shortest: int = SHORTEST) -> list[Claim]:
    """Spans between citations with the sources named after them.

    Numbers after a span too short to be a claim belong to the claim before it, or to the first one that follows.
    """
    claims: list[Claim] = []
    waiting: list[int] = []
    runs = [*CITED_RUN.finditer(text), None]
    begin = 0
    for run in runs:
        span = " ".join(text[begin : run.start() if run else len(text)].split())
        numbers = [int(x) for x in re.findall(r"\d+", run[0])] if run else []
        if len(span) >= shortest:
            claims.append(Claim(span, waiting + numbers, begin))
            waiting = []
        elif claims:
            claims[-1].cited += waiting + numbers
            waiting = []
        else:
            waiting += numbers
        begin = run.end() if run else begin
    if not claims and (whole := " ".join(CITED_RUN.sub(" ", text).split())):
        claims = [Claim(whole, waiting, 0)]
    for claim in claims:
        claim.cited = list(dict.fromkeys(claim.cited))
    return claims


def claims_table(answers: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """id, claim_no, claim, cited, start: one row a claim. A fold over an answer's citations, so Python; narrow."""
    kind = answers.schema[id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            place, rows = [], []
            for i, answer in enumerate(batch.column(1).to_pylist()):
                for n, c in enumerate(split_claims(answer or "")):
                    place.append(i)
                    rows.append((n, c.text, c.cited, c.start))
            cols = [pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.int32(), pa.string(), pa.list_(pa.int32()), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int64())), *cols], names=["id", "claim_no", "claim", "cited", "start"])

    return answers.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, claim_no int, claim string, cited array<int>, start int")


def to_judge(claims: DataFrame, sources: DataFrame, excerpt: int = 2500) -> DataFrame:
    """One row a claim and source it names, with the passage; verdict is missing_source where there is none.

    sources: id (of the answer), n (from 1), text.
    """
    pairs = claims.select("id", "claim_no", "claim", F.explode("cited").alias("source"))
    joined = pairs.join(sources.select("id", F.col("n").alias("source"), F.substring("text", 1, excerpt).alias("passage")), ["id", "source"], "left")
    return joined.withColumn("verdict", F.when(F.col("passage").isNull(), "missing_source"))


def lexical_verdict(claim: Column, passage: Column, least: float = 0.6) -> Column:
    """A stand-in for a judge: supported if enough of the claim's words stand in the passage."""
    words = lambda c: F.array_distinct(T.found(F.lower(c), "[a-z0-9]+"))
    share = F.size(F.array_intersect(words(claim), words(passage))) / F.size(words(claim))
    return F.when(F.size(words(claim)) == 0, "unclear").when(share >= least, "supported").otherwise("unsupported")


def attribution(claims: DataFrame, checks: DataFrame) -> DataFrame:
    """Eight figures of an audit in one row; a share without a whole is 0.

    claims: id, claim_no, cited. checks: id, claim_no, source, verdict.
    """
    per_claim = checks.groupBy("id", "claim_no").agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict") == "missing_source").alias("missing"), F.count_if(F.col("verdict") == "unclear").alias("unclear"), F.count_if(F.col("verdict") == "supported").alias("good")
    )
    rows = claims.select("id", "claim_no", (F.size("cited") == 0).alias("bare")).join(per_claim, ["id", "claim_no"], "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    one = rows.agg(
        F.count("*").alias("claims"), F.count_if("bare").alias("uncited_claims"), total("n").alias("citations"), total("missing").alias("missing_sources"), total("unclear").alias("unclear"),
        total("good").alias("good"), F.count_if(~F.col("bare") & (F.col("good") > 0)).alias("backed"),
    ).withColumn("judged", F.col("citations") - F.col("missing_sources")).withColumn("cited_claims", F.col("claims") - F.col("uncited_claims"))
    return one.select(
        "claims", "uncited_claims", share("uncited_claims", "claims").alias("uncited_rate"), "citations", "missing_sources", "unclear", share("good", "judged").alias("citation_precision"), share("backed", "cited_claims").alias("claim_support")
    )
