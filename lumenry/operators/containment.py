"""Names whose every word stands in a text, found by their rarest word alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..storage import stored


def contained(names: DataFrame, texts: DataFrame, name_id: str, text_id: str) -> DataFrame:
    """name_id and text_id of all pairs where a name's words (names: name_id, words) are among a text's (texts: text_id, words).

    Texts are read once, for those of their words that any name has. Of these, how many texts hold each is counted, and
    every name looks through the texts of its rarest word, where the others are verified: a name of common words and one
    rare one costs as much as the rare one. Names without words, and names with a word that no text has, are in nothing;
    ids are different.
    """
    asked = stored(names.select(name_id, F.array_distinct("words").alias("want")).where(F.size("want") > 0), "names")
    each = asked.select(name_id, F.explode("want").alias("word"))
    held = texts.select(text_id, F.explode(F.array_distinct("words")).alias("word")).join(each.select("word").distinct(), "word", "left_semi")
    held = stored(held.select(text_id, "word"), "held_words")
    counts = held.groupBy("word").agg(F.count("*").alias("n"))
    none = F.lit(0).cast("long")
    rarest = each.join(counts, "word", "left").groupBy(name_id).agg(F.min(F.struct(F.coalesce("n", none).alias("n"), "word")).alias("r")).where("r.n > 0").select(name_id, F.col("r.word").alias("word"))
    pairs = stored(held.join(rarest, "word").select(name_id, text_id), "name_pairs")
    words = held.join(pairs.select(text_id).distinct(), text_id, "left_semi").groupBy(text_id).agg(F.collect_set("word").alias("have"))
    return pairs.join(asked, name_id).join(words, text_id).where(F.size(F.array_except("want", "have")) == 0).select(name_id, text_id)
