"""Work that models do in batches: judging claims, auditing answers, summaries, questions and labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.patterns import LEGAL, PatternSet
from ..operators import answers
from ..sources import corpus
from . import providers

Make = Callable[[], providers.Model]

# How many characters of a text a judge and summarisers see unless told; with None, all of it.
EXCERPT, SUMMARY_CHARS, CONTEXT_CHARS = 2500, 12_000, 6000
JUDGE = "Say whether the passage carries the claim: supported, unsupported or unclear. One word, from the passage alone."
SUMMARISE = "Sum up the judgment in two or three sentences between <summary> and </summary>."
ASK = "Write one question in plain words that this passage answers, without using its phrases."
RATE = "Is the passage relevant to the question? Reply y, p for partly, or n."


class WordJudge:
    """A judge's stand-in: supported if enough of the claim's words stand in the passage."""

    def __init__(self, least: float = 0.6):
        self.least = least

    def complete(self, system: str, prompt: str) -> str:
        import re

        passage, _, claim = prompt.partition("\n\nClaim:\n")
        words = lambda t: set(re.findall(r"[a-z0-9]+", t.lower()))
        want = words(claim.removesuffix("\n\nVerdict:"))
        return "unclear" if not want else "supported" if len(want & words(passage)) >= self.least * len(want) else "unsupported"


def opening(text: str, most: int | None):
    return F.coalesce(F.col(text) if most is None else F.substring(text, 1, most), F.lit(""))


def judge(claims: DataFrame, sources: DataFrame, make: Make, tries: int = 3, excerpt: int = EXCERPT) -> DataFrame:
    """id, claim_no, source, verdict of each claim and source it names. claims: id, claim_no, claim, cited. sources: id, n, text.

    A source that isn't there is missing; a reply that is no verdict, or none after the last try, is unclear. Claims
    that name no source have no row.
    """
    pairs = answers.to_judge(claims, sources, excerpt)
    prompt = F.concat(F.lit("Passage:\n"), "passage", F.lit("\n\nClaim:\n"), "claim", F.lit("\n\nVerdict:"))
    told = providers.complete(pairs.where("verdict is null").select("id", "claim_no", "source", prompt.alias("prompt")), make, system=JUDGE, tries=tries)
    judged = told.select("id", "claim_no", "source", F.coalesce(T.verdict(F.col("reply")), F.lit("unclear")).alias("verdict"))
    return judged.unionByName(pairs.where("verdict is not null").select("id", "claim_no", "source", "verdict"))


def audit(answered: DataFrame, sources: DataFrame, make: Make, excerpt: int = EXCERPT) -> DataFrame:
    """One row of figures of answers(query_id, text, refused, truncated, cited) against sources(query_id, n, text).

    Refusals and answers that were cut off are counted and not judged: the latter lack citations they would have made.
    """
    flags = answered.agg(
        F.count("*").alias("answers"), F.count_if("refused").alias("refused"), F.count_if(~F.col("refused") & F.col("truncated")).alias("truncated"),
        F.count_if(~F.col("refused") & ~F.col("truncated") & (F.size("cited") == 0)).alias("uncited_answers"),
    )
    whole = answered.where("not refused and not truncated").select(F.col("query_id").alias("id"), "text")
    claims = answers.claims_table(whole)
    checks = judge(claims, sources.select(F.col("query_id").alias("id"), "n", "text"), make, excerpt=excerpt)
    # two tables of one row each
    return flags.withColumn("one", F.lit(1)).join(answers.attribution(claims, checks).withColumn("one", F.lit(1)), "one").drop("one")


def summaries(docs: DataFrame, stored: DataFrame, make: Make, most: int | None = SUMMARY_CHARS) -> DataFrame:
    """doc_id and summary of documents(id, text) that none is stored for: those whose reply holds a usable one.

    A reply that was cut off is asked for once more, with twice the room.
    """
    todo = corpus.missing_summaries(docs, stored).select(F.col("id").alias("doc_id"), F.concat(F.lit("Judgment Text:\n"), opening("text", most)).alias("prompt"))
    told = providers.complete(todo, make, system=SUMMARISE, again=lambda reply: "</summary>" not in reply)
    return told.select("doc_id", T.summary_of(F.col("reply")).alias("summary")).where("summary is not null")


def context_summaries(docs: DataFrame, stored: DataFrame, make: Make, most: int | None = CONTEXT_CHARS) -> DataFrame:
    """doc_id, summary and fresh of all documents(id, text): what is stored, else a model's reply, else an empty string.

    Only fresh rows are to be stored, so that what failed is tried again.
    """
    rows = docs.join(stored.select(F.col("doc_id").alias("id"), F.col("summary").alias("held")), "id", "left")
    todo = rows.where("held is null").select(F.col("id").alias("doc_id"), opening("text", most).alias("prompt"))
    told = providers.complete(todo, make, system=SUMMARISE, tries=2)
    new = told.select("doc_id", F.coalesce(T.strip(F.col("reply")), F.lit("")).alias("summary"), F.col("reply").isNotNull().alias("fresh"))
    return rows.where("held is not null").select(F.col("id").alias("doc_id"), F.col("held").alias("summary"), F.lit(False).alias("fresh")).unionByName(new)


def questions(chunks: DataFrame, labels: DataFrame, make: Make, n: int, seed: int = 0, patterns: PatternSet = LEGAL, tries: int = 3) -> DataFrame:
    """Labels (query, relevant_chunk_ids, kind, note) written backwards from up to n passages that hold something.

    chunks: id string, text. Passages that a label has, questions that repeat a run of the passage's words, empty ones and those already
    asked are passed over; passages are taken in an order that the seed gives.
    """
    taken = labels.select(F.explode("relevant_chunk_ids").alias("id")).distinct()
    good = chunks.where(T.stance(F.col("text"), patterns).isin("holding", "both")).join(taken, "id", "left_anti")
    told = providers.complete(good.select("id", "text", F.col("text").alias("prompt")), make, system=ASK, tries=tries)
    asked = told.withColumn("query", F.trim(T.strip(F.col("reply")), F.lit('"'))).where((F.col("query") != "") & ~T.shares_run(F.col("query"), F.col("text")))
    new = asked.join(labels.select("query").distinct(), "query", "left_anti")
    draw = F.md5(F.concat_ws(":", F.lit(seed), "id"))
    first = new.groupBy("query").agg(F.min(F.struct(draw.alias("draw"), "id")).alias("m"))
    return first.orderBy("m.draw", "m.id").limit(n).select("query", F.array("m.id").alias("relevant_chunk_ids"), F.lit("conceptual").alias("kind"), F.lit("written from the passage").alias("note"))


def annotate(pool: DataFrame, make: Make) -> DataFrame:
    """pool(query, id, text) with grade: y, p or n; n where a model gives no reply."""
    prompt = F.concat(F.lit("Question: "), "query", F.lit("\n\nPassage:\n"), "text")
    told = providers.complete(pool.select("query", "id", prompt.alias("prompt")), make, system=RATE)
    return told.select("query", "id", T.relevance_letter(F.col("reply")).alias("grade"))


def graded_labels(annotated: DataFrame, grades: tuple[str, ...] = ("y",), note: str = "graded") -> DataFrame:
    """Labels of annotated(query, id, grade); queries without a relevant chunk are left out."""
    hits = annotated.where(F.col("grade").isin(*grades)).groupBy("query").agg(F.array_sort(F.collect_set("id")).alias("relevant_chunk_ids"))
    return hits.select("query", "relevant_chunk_ids", F.lit("conceptual").alias("kind"), F.lit(note).alias("note"))


def stance_validation(chunks: DataFrame, make: Make, per_label: int, seed: int = 0, patterns: PatternSet = LEGAL) -> DataFrame:
    """regex and model label of a sample of chunks(id, text) stratified by the former; replies that are no label are null."""
    labelled = chunks.withColumn("regex", T.stance(F.col("text"), patterns))
    draw = F.row_number().over(Window.partitionBy("regex").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"))), "id"))
    picked = labelled.withColumn("draw", draw).where(F.col("draw") <= per_label)
    told = providers.complete(picked.select("id", "regex", F.col("text").alias("prompt")), make, system="Name the passage's stance: both, holding, neither or argument.")
    word = F.regexp_extract(F.lower(F.coalesce("reply", F.lit(""))), r"\b(both|holding|neither|argument)\b", 1)
    return told.select("id", "regex", F.nullif(word, F.lit("")).alias("model"))
