"""Benchmark decontamination through a positional inverted index, in DataFrame expressions only.

Postings (text, position, term) of every word that some item holds are stored
once, with one posting more at the end of each text that carries its length.
A window of an item is found from its rarest terms: the postings of the rarest,
moved back by its place in the item, propose alignments of item and text; those
that the second rarest confirms are intersected with the lists of all other
places.  Runs of confirmed places at least as long as a window are exact
phrases.  No text is read twice, and no list of a term is longer than it must be:
frequent words are only looked up where rare ones agree.

`near_matches` finds the terms of a window in any order within a span.

Words are runs of a-z, 0-9 and all above ASCII, A-Z lower-cased.  Null and empty
texts have no words; an item without words finds nothing.  Items are rows: equal
item_ids count once, a null item_id marks words but is not listed.  Repeated
documents give repeated rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.llm.textkit import row_key, settle

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: The posting at the end of a text; no word is empty.
END, END_TERM = "", -1
#: What is joined to all postings is broadcast up to these sizes, and salted beyond.
MOST_ROWS, MOST_BYTES = 500_000, 32 << 20
SALTS = 32


def words_of(text: str = "text") -> Column:
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORDS), F.lit(0))


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join to a table of the items' size: broadcast if it is small enough, else salted so that no key is hot."""
    texts = [F.octet_length(c) if t == "string" else F.lit(8) for c, t in small.dtypes]
    rows, size = small.agg(F.count("*"), F.coalesce(F.sum(sum(texts[1:], texts[0])), F.lit(0))).first()
    if rows <= MOST_ROWS and size <= MOST_BYTES:
        return big.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", F.pmod(F.xxhash64("rk", "pos"), F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"], how).drop("_salt")


def items_of(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """item, item_id, size of every item with words, and item, at, term of its words (both settled)."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of().alias("words")).filter(F.size("words") > 0)
    items = settle(rows.withColumn("item", F.monotonically_increasing_id()), "items")
    placed = items.select("item", F.posexplode("words").alias("at", "word"))
    known = settle(placed.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "terms")
    return items.select("item", "item_id", F.size("words").alias("size"), "words"), settle(placed.join(known, "word").select("item", "at", "term", "word"), "places")


def positional_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """rk, doc_id, pos, term: the stored postings of the words in terms(word, term), and the end of every text."""
    known = terms.select("word", "term").distinct().unionByName(docs.sparkSession.range(1).select(F.lit(END).alias("word"), F.lit(END_TERM).cast("bigint").alias("term")))
    words = docs.select(row_key().alias("rk"), F.col("doc_id").cast("bigint").alias("doc_id"), F.posexplode(F.concat(words_of(), F.array(F.lit(END)))).alias("pos", "word"))
    return settle(join_small(words, known, ["word"]).select("rk", "doc_id", "pos", "term"), "postings")


def windows_of(items: DataFrame, places: DataFrame, index: DataFrame, width: int) -> DataFrame:
    """item, start, wide, at, term, n, rank: the places of every window that may occur, rarest first."""
    found = settle(index.filter(F.col("term") >= 0).groupBy("term").agg(F.count("*").alias("n")), "frequencies")
    wide = F.least("size", F.lit(width))
    starts = items.select("item", wide.alias("wide"), F.explode(F.sequence(F.lit(0), F.col("size") - wide)).alias("start"))
    each = starts.select("item", "start", "wide", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("wide") - 1)).alias("at"))
    each = each.join(places.select("item", "at", "term"), ["item", "at"]).join(found, "term", "left")
    one = Window.partitionBy("item", "start")
    each = each.withColumn("missing", F.max(F.col("n").isNull()).over(one)).filter(~F.col("missing")).drop("missing")
    return settle(each.withColumn("rank", F.row_number().over(one.orderBy("n", "at"))), "windows")


def _at_text(rows: DataFrame, index: DataFrame) -> DataFrame:
    """The rows(rk, pos, term, ...) that the index holds, each once."""
    held = index.select("rk", "pos", "term")
    return rows.join(held, ["rk", "pos", "term"]).distinct()


def phrases(index: DataFrame, items: DataFrame, places: DataFrame, width: int = WINDOW) -> DataFrame:
    """rk, item, first, last: the longest runs of an item's consecutive words in a text that hold a window."""
    windows = windows_of(items, places, index, width)
    lead = windows.filter("rank = 1").select("item", "start", "wide", F.col("at").alias("lead"), "term")
    leads = settle(lead.select("item", "wide", "lead", "term").distinct(), "leads")
    second = windows.filter("rank = 2").join(lead.select("item", "start", "lead"), ["item", "start"])
    second = settle(second.select("item", "lead", (F.col("at") - F.col("lead")).alias("step"), F.col("term").alias("then")).distinct(), "seconds")
    postings = index.filter(F.col("term") >= 0)
    seeds = settle(join_small(postings.select("rk", "pos", "term"), leads, ["term"]).select("rk", "pos", "item", "lead", "wide"), "seeds")
    steps = join_small(seeds, second, ["item", "lead"])
    steps = steps.select("rk", "item", "lead", F.col("pos").alias("from"), (F.col("pos") + F.col("step")).alias("pos"), F.col("then").alias("term"))
    rare = join_small(postings.select("rk", "pos", "term"), second.select(F.col("then").alias("term")).distinct(), ["term"], "left_semi")
    agreed = _at_text(steps, rare).select("rk", F.col("from").alias("pos"), "item", "lead")
    # Windows of one word have no second place.
    alone = seeds.filter("wide = 1").select("rk", "pos", "item", "lead")
    aligned = settle(agreed.unionByName(alone).distinct(), "aligned")
    sizes = items.select("item", "size", F.least("size", F.lit(width)).alias("wide"))
    spans = join_small(aligned, sizes, ["item"]).select(
        "rk", "item", (F.col("pos") - F.col("lead")).alias("shift"), "wide",
        F.explode(F.sequence(F.greatest(F.lit(0), F.col("lead") - F.col("wide") + 1), F.least(F.col("size") - 1, F.col("lead") + F.col("wide") - 1))).alias("at"),
    ).distinct()
    probes = join_small(spans.withColumn("pos", F.col("shift") + F.col("at")), places.select("item", "at", "term"), ["item", "at"])
    texts = aligned.select("rk").distinct()
    held = _at_text(probes, postings.join(texts, "rk", "left_semi"))
    line = Window.partitionBy("rk", "item", "shift").orderBy("at")
    runs = held.withColumn("island", F.col("at") - F.row_number().over(line)).groupBy("rk", "item", "shift", "island", "wide")
    return runs.agg(F.min("pos").alias("first"), F.max("pos").alias("last")).filter(F.col("last") - F.col("first") + 1 >= F.col("wide")).select("rk", "item", "first", "last")


def near_matches(index: DataFrame, items: DataFrame, places: DataFrame, span: int, width: int = WINDOW) -> DataFrame:
    """rk, item, start, first, last: texts that hold all terms of an item's window, in any order, within `span` words.

    One row for each place of the window's rarest term that lies in such a stretch: its shortest one (ties: the first)."""
    windows = windows_of(items, places, index, width)
    lead = windows.filter("rank = 1").select("item", "start", "term")
    terms = windows.select("item", "start", "term").distinct()
    needs = settle(terms.withColumn("needs", F.count("*").over(Window.partitionBy("item", "start"))), "needs")
    postings = index.filter(F.col("term") >= 0).select("rk", "pos", "term")
    seeds = settle(join_small(postings, lead, ["term"]).select("rk", "item", "start", "pos").distinct(), "seeds")
    wanted = join_small(seeds, needs, ["item", "start"]).select("rk", "item", "start", F.col("pos").alias("seed"), "term", "needs")
    block = lambda c: F.floor(c / F.lit(span))
    wanted = wanted.withColumn("block", F.explode(F.sequence(block(F.col("seed") - span + 1), block(F.col("seed") + span - 1))))
    found = wanted.join(postings.distinct().withColumn("block", block(F.col("pos"))), ["rk", "term", "block"]).filter(F.abs(F.col("pos") - F.col("seed")) < span)
    # At most 2 * span - 1 places around a seed.
    around = found.groupBy("rk", "item", "start", "seed", "needs").agg(F.collect_set(F.struct("pos", "term")).alias("held")).filter(F.size("held") >= F.col("needs"))
    inside = lambda a, b: F.size(F.array_distinct(F.transform(F.filter("held", lambda h: (h["pos"] >= a) & (h["pos"] <= b)), lambda h: h["term"])))
    ends = lambda test: F.array_distinct(F.transform(F.filter("held", lambda h: test(h["pos"])), lambda h: h["pos"]))
    stretches = F.flatten(F.transform(ends(lambda p: p <= F.col("seed")), lambda a: F.transform(F.filter(ends(lambda p: p >= F.col("seed")), lambda b: b - a < span), lambda b: F.struct((b - a).alias("length"), a.alias("first"), b.alias("last")))))
    best = F.array_min(F.filter(stretches, lambda s: inside(s["first"], s["last"]) == F.col("needs")))
    return around.withColumn("best", best).filter("best is not null").select("rk", "item", "start", F.col("best.first").alias("first"), F.col("best.last").alias("last"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    items, places = items_of(benchmark)
    index = positional_index(docs, places)
    found = settle(phrases(index, items, places, width), "phrases")
    before = Window.partitionBy("rk").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("last").over(before), F.lit(-1))
    fresh = F.greatest(F.lit(0), F.col("last") - F.greatest(reach, F.col("first") - 1))
    hits = found.select("rk", "first", "last").distinct().withColumn("fresh", fresh).groupBy("rk").agg(F.sum("fresh").alias("n_hit"))
    listed = join_small(found.select("rk", "item", F.lit(0).alias("pos")).distinct(), items.select("item", "item_id"), ["item"])
    named = listed.groupBy("rk").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    texts = index.filter(F.col("term") == END_TERM).select("rk", "doc_id", F.col("pos").cast("bigint").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return texts.join(hits, "rk", "left").join(named, "rk", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
