"""The limiter of a stream with expiring state, the tag tokenizer, and containment by the rarest word."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from lumenry.functions import markup
from lumenry.operators import containment
from lumenry.streaming import limits, state


def test_limited_stream(spark, tmp_path):
    """Keys whose window has passed are cleared, rows behind the watermark are dropped, and a restart goes on where it was."""
    kind = "id long, key string, at timestamp"
    put = lambda *rows: spark.createDataFrame([(i, k, t) for i, k, t in rows], "id long, key string, t double").select("id", "key", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        """A query of its own each time, from the same checkpoint: each call is a restart."""
        stream = limits.limited(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), 2, 100.0, "10 seconds", told=True)
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(240)
        rows = spark.read.schema("id long, key string, allowed boolean").parquet(f"{tmp_path}/out").collect()
        return {r["id"]: r["allowed"] for r in rows if r["id"] is not None}, [r["key"] for r in rows if r["id"] is None]

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        put((1, "a", 1000.0), (2, "a", 1001.0), (3, "a", 1002.0), (4, "b", 1000.0))
        told, cleared = run()
        assert told == {1: True, 2: True, 3: False, 4: True} and not cleared
        put((5, "a", 1003.0), (6, "b", 1004.0), (7, "b", 1005.0))  # state is there after the restart
        told, cleared = run()
        assert (told[5], told[6], told[7]) == (False, True, False) and not cleared
        put((8, "c", 1500.0))
        run()
        put((9, "c", 1501.0), (10, "a", 1050.0))  # the watermark is at 1490: 10 comes too late
        told, cleared = run()
        assert told[9] and 10 not in told and sorted(cleared) == ["a", "b"]
        put((11, "a", 1502.0), (12, "a", 1503.0), (13, "a", 1504.0))  # a key without state begins anew
        told, _ = run()
        assert (told[11], told[12], told[13]) == (True, True, False)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    # the same rows as a table
    rows = spark.createDataFrame([(1, "a", 1000.0), (2, "a", 1001.0), (3, "a", 1002.0), (4, "b", 1000.0), (5, "a", 1003.0)], "event_id long, user_id string, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    assert {r["id"]: r["allowed"] for r in state.replay_limiter(rows, limit=2, window=100.0).collect()} == {1: True, 2: True, 3: False, 4: True, 5: False}


class Library(HTMLParser):
    """The same events by the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events, self.raw = [], False

    def handle_starttag(self, tag, attrs):
        first = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        self.events.append(("start", tag, first))
        self.raw = tag in markup.RAW

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.events.append(("end", tag, {}))
        self.raw = False

    def handle_data(self, data):
        if self.events and self.events[-1][0] == "text" and not self.raw:
            self.events[-1] = ("text", self.events[-1][1] + data, {})
        else:
            self.events.append(("raw" if self.raw else "text", data, {}))


def joined(events):
    """Pieces of text side by side, as comments between them leave them, as one."""
    out = []
    for e in events:
        if out and e[0] == out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + e[1], {})
        else:
            out.append(e)
    return out


def test_events_are_the_librarys():
    rng = random.Random(7)
    pieces = ["<p>", "</p>", "<br/>", "<A HREF='x&amp;y' class=\"b c\">", "</a>", '<a class="b" href=plain>', "text &lt; more &copy; &#233; ", "<!-- <a> -->", "<script>if (a<b) {'<p>'}</script>", "<style>p>a{}</style>", "<img src=\"a>b\" alt>", "<!DOCTYPE html>", "é\n", '<div data-x="1" data-x="2">', "</div>"]
    for _ in range(400):
        page = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        library = Library()
        library.feed(page)
        library.close()
        assert joined(markup.events(page)) == joined(library.events), page


def test_elements(spark):
    page = '<a href="/one" class="x y">One <b>&amp; all</b></a> <a class="z" href="/two">two</a><script>"<a href=no>"</script><a class="x">open <a class="x" href=\'3\'>in</a> rest'
    pages = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<div class=x>a<div>b</div>c</div>d")], "page_id long, html string")
    got = sorted((r["page_id"], r["n"], r["value"], r["text"]) for r in markup.elements(pages, "a", "x").collect())
    assert [tuple(x or "" for x in r[2:]) for r in got] == [("/one", "One & all"), ("", "open in rest"), ("3", "in")]
    assert [r["text"] for r in markup.elements(pages, "div", "x").collect()] == ["abc"] and markup.elements(pages, "a").where("page_id = 1").count() == 4


def test_names_by_their_rarest_word(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [(i, [rng.choice(vocabulary[: rng.choice((5, 40))]) for _ in range(rng.randint(0, 30))]) for i in range(200)]
    names = [(i, [rng.choice([*vocabulary, "unheard"]) for _ in range(rng.randint(0, 4))]) for i in range(100)] + [(500, None)]
    want = sorted((n, t) for n, words in names if words for t, have in texts if set(words) <= set(have))
    got = containment.contained(spark.createDataFrame(names, "name long, words array<string>"), spark.createDataFrame([*texts, (900, None)], "doc long, words array<string>"), "name", "doc")
    assert sorted((r["name"], r["doc"]) for r in got.collect()) == want and len(want) > 50
