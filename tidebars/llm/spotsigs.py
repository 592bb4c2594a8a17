"""Document fingerprints after SpotSigs, in DataFrame expressions only.

A signature is a common word (the anchor) with the two content words that follow
it; common words between them are skipped.  Of the chains that begin at a content
word those are signatures that their own hash chooses, so the rule is the same for
texts of any length; a text without any signature is described by its words.  The set of a text's hashed
signatures is its fingerprint.  Letters and digits make words, case aside; a text of
fewer than two is described by what stands between white space, and one of white
space only has an empty fingerprint.

Null text is empty.  Documents follow each other by doc_id, then text; equal rows
are neighbours.  A row without doc_id has no place in that order, and no next
document.  Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.llm.textkit import shuffle_partitions

#: Fixed: common words of the four languages of the corpus.
ANCHORS = (
    "the of and to in a is that it for on was be with as",
    "der die und den von zu das ist",
    "de la le les et des un",
    "el en que los las una del",
)
CHAIN = 2
#: One in so many of the chains that begin at a content word is a signature too.
SHARE = 4
#: What stands between words: ASCII other than letters and digits.
OTHER = r"[^a-z0-9\x{80}-\x{10ffff}]+"
ROWS_PER_RANGE = 4000


def _any_of(words: set[str]) -> str:
    """A pattern for any of the words that tries each first letter once."""
    heads = sorted({w[:1] for w in words if w})
    tails = [(h, {w[1:] for w in words if w[:1] == h}) for h in heads]
    parts = [h + (_any_of(t - {""}) + ("?+" if "" in t else "") if t != {""} else "") for h, t in tails]
    return "(?:" + "|".join(parts) + ")"


def with_signatures(df: DataFrame, text: str, out: str, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """df and, in `out`, the sorted distinct signature hashes (array<int>) of column `text`.

    Anchors are marked once; what follows looks for the mark.  Each step is a column of its own, so that none is computed twice."""
    marked, chains, raw = F.col("_marked"), F.col("_chains"), F.col(text)
    bare = lambda found: F.filter(F.split(F.regexp_replace(F.array_join(found, "\x01"), " \x02[^ ]++", ""), "\x01"), lambda w: w != "")
    words = _any_of({w for line in anchors for w in line.split()})
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(raw), OTHER, " ")), F.lit(" "))
    df = df.withColumn("_marked", F.regexp_replace(plain, rf" ({words})(?= )", " \x02$1"))
    links = "(?:(?: \x02[^ ]++)*+ [^ \x02][^ ]*+)"
    spots = F.regexp_extract_all(marked, F.lit(f"(?=(\x02[^ ]++{links}{{1,{chain}}}))\x02"), F.lit(1))
    others = F.regexp_extract_all(marked, F.lit(f"(?<= )(?=([^ \x02][^ ]*+{links}{{1,{chain}}}))[^ ]"), F.lit(1))
    df = df.withColumn("_chains", F.concat(bare(spots), F.filter(bare(others), lambda w: F.pmod(F.hash(w), F.lit(SHARE)) == 0)))
    every = F.filter(F.split(F.when(F.trim(marked) == "", F.lower(raw)).otherwise(marked), r"\s+"), lambda w: w != "")
    parts = F.when(F.size(chains) > 0, chains).otherwise(every)
    return df.withColumn(out, F.sort_array(F.array_distinct(F.transform(parts, lambda w: F.hash(w))))).drop("_marked", "_chains")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two sets; 0 without a look inside where their sizes rule `least` out.  Two empty sets are alike."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(large == 0, F.lit(1.0)).when((small == 0) | (small < F.lit(least) * large), F.lit(0.0)).otherwise(both / (small + large - both))


def near_pairs(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """a, b, likeness of all pairs of rows of prints(id, signatures) with likeness >= least.

    Sets fall into ranges of length whose ends differ by 1/least, so a pair lies in one range or in two neighbours.
    Equal sets meet as one.  Of each set only its rarest signatures (as many as any partner must hit once) are joined."""
    sets = prints.filter(F.size("signatures") > 0).groupBy("signatures").agg(F.min("id").alias("id"), F.collect_list("id").alias("ids"))
    band = F.floor(F.log(F.size("signatures").cast("double")) / F.lit(-math.log(least)))
    sets = sets.select("id", "signatures", F.size("signatures").alias("n"), band.alias("band"))
    rare = sets.select(F.explode("signatures").alias("s")).groupBy("s").agg(F.count("*").alias("f"))
    ranked = sets.select("id", "n", "band", F.explode("signatures").alias("s")).join(rare, "s").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("f", "s")))
    heads = ranked.filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("id", "n", "band", "s")
    left = heads.select(F.col("id").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    right = heads.select(F.col("id").alias("b"), F.col("n").alias("nb"), "s", "band")
    fits = (F.col("a") != F.col("b")) & (F.col("na") <= F.col("nb")) & (F.col("na") >= F.col("nb") * least)
    found = left.join(right, ["s", "band"]).filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    full = found.join(sets.select(F.col("id").alias("a"), F.col("signatures").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("signatures").alias("sb")), "b")
    return full.select("a", "b", likeness(F.col("sa"), F.col("sb"), least).alias("likeness")).filter(F.col("likeness") >= least)


def _ranges(df: DataFrame) -> list[int]:
    """First doc_id of each range of about equal numbers of rows."""
    rows = df.count()
    n = min(10_000, max(shuffle_partitions(df) * 2, rows // ROWS_PER_RANGE))
    cuts = [i / n for i in range(1, n)] or [0.5]
    row = df.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", cuts, 10 * n).alias("cuts")).first()
    return [] if row.low is None else sorted({row.low, *row.cuts})


def _range_of(doc_id: Column, firsts: list[int]) -> Column:
    """Number of the range that holds doc_id: which of about sqrt(n) groups, then which range in it."""
    width = max(1, math.isqrt(len(firsts)))
    groups = [firsts[i : i + width] for i in range(0, len(firsts), width)]
    heads = F.array(*(F.lit(g[0]) for g in groups))
    group = F.size(F.filter(heads, lambda x: x <= doc_id))
    inside = F.element_at(F.array(*(F.array(*(F.lit(x) for x in g)) for g in groups)), group)
    return (group - 1) * width + F.size(F.filter(inside, lambda x: x <= doc_id)) - 1


def with_next(df: DataFrame) -> DataFrame:
    """doc_id, text, next_text, signatures, next_signatures; each document once, by ranges of doc_id and without a global sort."""
    df = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    firsts = _ranges(df)
    nowhere = df.filter("doc_id is null").select("doc_id", "text", F.lit("").alias("next_text"))
    nowhere = with_signatures(nowhere, "text", "signatures").withColumn("next_signatures", F.array().cast("array<int>"))
    if not firsts:
        return nowhere
    df = df.filter("doc_id is not null").withColumn("at", _range_of(F.col("doc_id"), firsts))
    last = len(firsts) - 1
    # The rows that begin a range also visit the one before it, to be the next of its last row.
    begins = F.element_at(F.array(*(F.lit(x) for x in firsts)), F.col("at") + 1) == F.col("doc_id")
    before = F.when(F.col("at") > 0, F.col("at") - 1).otherwise(F.lit(last))
    homes = F.when(begins, F.array(F.struct(F.col("at").alias("range"), F.lit(False).alias("guest"), F.lit(0).alias("lap")), F.struct(before.alias("range"), F.lit(True).alias("guest"), (F.col("at") == 0).cast("int").alias("lap")))).otherwise(
        F.array(F.struct(F.col("at").alias("range"), F.lit(False).alias("guest"), F.lit(0).alias("lap")))
    )
    placed = df.select("doc_id", "text", F.explode(homes).alias("home")).select("doc_id", "text", "home.*")
    order = Window.partitionBy("range").orderBy("lap", "doc_id", "text", "guest")
    placed = with_signatures(placed.withColumn("next_text", F.lead("text").over(order)), "text", "signatures").withColumn("next_signatures", F.lead("signatures").over(order))
    return placed.filter("not guest").select("doc_id", "text", "next_text", "signatures", "next_signatures").unionByName(nowhere)


def fingerprint(signs: Column) -> Column:
    return F.array_join(signs.cast("array<string>"), ",")


def compare_edits(df: DataFrame) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next document."""
    n = F.char_length("text")
    rows = with_next(df).withColumn("n_chars", n.cast("bigint"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.expr("left(text, int(n_chars - floor(n_chars / 4)))"), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = with_signatures(rows.select("doc_id", "n_chars", edited.alias("edited"), "signatures", "next_signatures"), "edited", "edited_signatures")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint(F.col("signatures")).alias("fingerprint"),
        fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )
