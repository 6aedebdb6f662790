"""Benchmark decontamination by templates, with built-in functions only.

Words become template tokens: numbers, units after numbers and names turn into typed placeholders, everything
else is lower-cased. Windows of eight template tokens of the documents are hash-joined with those of the
benchmark; matches are summed to runs along one alignment, and a run counts when the slots of the item map one
to one to fillers in the document. So a question is found with other numbers and names too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.llm import common
from obsframe.session import cut_lineage

WINDOW = 8
LITERALS = 4            # of the tokens of a window that must not be placeholders
RUN = 6                 # windows in a row: 13 tokens, or the whole item where it is shorter
BROADCAST_ROWS = 500_000  # benchmark windows up to this are sent to every executor (16 MB), more are shuffled

# Characters that are no part of a word at its ends; spelled numbers; units of measure.
EDGES = ".,;:!?\"'()[]{}<>*%$&#|+-−…«»“”„"
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven",
                "twelve", "hundred", "thousand", "million", "billion"]
UNITS = ["mm", "cm", "m", "km", "in", "ft", "mi", "mile", "miles", "meter", "meters", "metre", "metres", "mg", "g",
         "kg", "t", "lb", "lbs", "oz", "gram", "grams", "ml", "l", "liter", "liters", "litre", "litres", "s", "sec",
         "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks",
         "month", "months", "year", "years", "usd", "eur", "dollar", "dollars", "euro", "euros", "cent", "cents",
         "percent", "degrees", "kmh", "mph", "kb", "mb", "gb", "tb", "hz", "khz", "mhz", "ghz", "w", "kw", "v", "j"]


def is_number(word: Column) -> Column:
    """A lower-case bare word that starts with a digit, or a spelled number."""
    return ((word >= "0") & (word < ":")) | word.isin(NUMBER_WORDS)


def is_capital(bare: Column, lower: Column) -> Column:
    return (bare != lower) & (bare != F.upper(bare))


def template(text: Column, of: Callable[[Column, Column], Column]) -> Column:
    """`of(template token, lower-case bare word)` for every word.

    A number starts with a digit or is spelled out; a unit follows a number; a name is capitalised (not all in
    capitals) and starts no sentence.
    """
    def token(words: Column, bares: Column, x: Column, i: Column) -> Column:
        capital = common.let(common.nth(bares, i), lambda b: is_capital(b, x))
        starts = (i == 0) | F.right(common.nth(words, i - 1), F.lit(1)).isin(".", "!", "?", ":")
        unit = x.isin(UNITS) & (i > 0) & is_number(F.lower(common.nth(bares, i - 1)))
        return F.when(is_number(x), F.lit("<num>")).when(capital & ~starts, F.lit("<name>")).when(unit, F.lit("<unit>")).otherwise(x)

    return common.let(common.words(text), lambda w: common.let(
        F.transform(w, lambda x: F.btrim(x, F.lit(EDGES))), lambda b: F.transform(
            F.transform(b, F.lower), lambda x, i: of(token(w, b, x, i), x))))


def tokens(text: Column) -> Column:
    """array<struct<token, slot>>: `token` is the template token, `slot` the filler of a placeholder (lower case)."""
    return template(text, lambda t, x: common.let(t, lambda token: F.struct(
        token.alias("token"), F.when(token.isin("<num>", "<unit>", "<name>"), x).alias("slot"))))


def hashed(text: Column, raw: bool = False) -> Column:
    """The hashes of the template tokens, or of the lower-case bare words."""
    return template(text, lambda t, x: F.xxhash64(x if raw else t))


def openings(text: Column) -> Column:
    """The template tokens that the first word of a text can be where the text stands inside another one."""
    return common.let(F.btrim(common.nth(common.words(text), F.lit(0)), F.lit(EDGES)), lambda b: common.let(
        F.lower(b), lambda x: F.when(is_number(x), F.array(F.lit("<num>"))).otherwise(F.array_compact(F.array(
            x, F.when(is_capital(b, x), F.lit("<name>")), F.when(x.isin(UNITS), F.lit("<unit>")))))))


def windows(hashes: Column, width: int) -> Column:
    """The hash of each run of `width` tokens; none where there are fewer."""
    return common.let(hashes, lambda h: F.when(F.size(h) < width, F.array().cast("array<bigint>")).otherwise(F.transform(
        common.upto(0, F.size(h) - (width - 1)), lambda i: F.xxhash64(*(common.nth(h, i + j) for j in range(width))))))


def benchmark_windows(benchmark: DataFrame, item_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(item, raw, width, at, hash, total) of the usable windows, and (item, at, value) of the slots.

    A window at the start of an item comes once for each token its opening word can be. An item without a usable
    window comes with all its windows over the words themselves (`raw`).
    """
    items = benchmark.select(F.col(item_col).alias("item"), tokens(F.col(text)).alias("t"), openings(F.col(text)).alias("heads")).filter(
        "item IS NOT NULL AND size(t) > 0").groupBy("item", "t").agg(F.array_distinct(F.flatten(F.collect_list("heads"))).alias("heads"))
    items = items.withColumn("width", F.least(F.size("t"), F.lit(WINDOW)))
    every = F.sequence(F.lit(0), F.size("t") - F.col("width"))

    def usable(at: Column) -> Column:
        literals = F.size(F.filter(F.slice("t", at + 1, F.col("width")), lambda p: p["slot"].isNull()))
        return literals >= F.least(F.lit(LITERALS), F.col("width"))

    items = (items.withColumn("places", F.filter(every, usable)).withColumn("raw", F.size("places") == 0)
             .withColumn("places", F.when(F.col("raw"), every).otherwise(F.col("places"))))
    rows = (items.select("item", "t", "heads", "width", "raw", F.explode("places").alias("at"))
            .withColumn("part", F.slice("t", F.col("at") + 1, F.col("width")))
            .withColumn("head", F.explode(F.when((F.col("at") == 0) & ~F.col("raw"), F.col("heads")).otherwise(
                F.array(F.get("part", F.lit(0))["token"])))))
    # Hashed like the documents' windows: the hash of the hashes of the tokens.
    h = F.transform("part", lambda p, i: F.xxhash64(
        F.when(F.col("raw"), F.coalesce(p["slot"], p["token"])).when(i == 0, F.col("head")).otherwise(p["token"])))
    keyed = F.coalesce(*(F.when(F.col("width") == n, F.xxhash64(*(F.get(F.col("h"), F.lit(j)) for j in range(n))))
                         for n in range(1, WINDOW + 1)))
    found = (rows.withColumn("h", h).select("item", "raw", "width", "at", keyed.alias("hash")))
    totals = items.groupBy("item").agg(F.sum(F.size("places")).alias("total"))
    slots = (items.select("item", "heads", F.posexplode("t").alias("at", "p"))
             .filter((F.col("p.slot").isNotNull()) | ((F.col("at") == 0) & (F.size("heads") > 1)))
             .select("item", "at", F.coalesce("p.slot", "p.token").alias("value")))
    return cut_lineage(found.join(totals, "item")), slots


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
                 item_col: str = "item_id", item_text: str = "text", run: int = RUN) -> DataFrame:
    """(id, item, n_windows, item_windows, n_slots, verbatim) for each document that holds a benchmark item.

    A document holds an item when `run` windows of it (all of them, if it has fewer) match along one alignment,
    and the item's slots and the fillers found there map one to one. `verbatim` means that all fillers are the
    item's own. Null, empty and very short texts hold nothing; windows of fewer than four literal tokens are
    not looked at, unless the item is that short. An item that has no others is looked for word by word, with its
    own numbers and names alone. The opening word of an item may be a name or a unit in the document. Null ids on either side are left out, equal ids are one document.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text).alias("body")).filter("doc IS NOT NULL AND body IS NOT NULL")
    known, slots = benchmark_windows(benchmark, item_col, item_text)
    small = known.count() <= BROADCAST_ROWS
    side = F.broadcast(known) if small else known
    kinds = [tuple(r) for r in known.select("raw", "width").distinct().collect()]  # at most sixteen
    hits = None
    for raw, width in sorted(kinds):
        found = (rows.select("doc", F.posexplode(windows(hashed(F.col("body"), raw), width)).alias("place", "hash"))
                 .join(side.filter((F.col("raw") == raw) & (F.col("width") == width)), "hash")
                 .select("doc", "item", "total", (F.col("place") - F.col("at")).alias("shift"), "at"))
        hits = found if hits is None else hits.union(found)
    if hits is None:
        hits = rows.select("doc").join(known, F.lit(False)).select("doc", "item", "total", F.col("at").alias("shift"), "at")
    runs = cut_lineage(
        hits.groupBy("doc", "item", "shift").agg(
            F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.max("total").alias("total"))
        .filter(F.col("n") >= F.least(F.lit(run), F.col("total"))))
    # Slots of the runs, then their fillers: only documents with runs and items with slots come this far.
    wanted = runs.join(slots, "item").filter(
        (F.col("at") >= F.col("first")) & (F.col("at") < F.col("last") + WINDOW)).select(
        "doc", "item", "shift", F.col("value").alias("theirs"), (F.col("at") + F.col("shift")).alias("place"))
    wanted = cut_lineage(wanted)
    fillers = (rows.join(wanted.select("doc").distinct(), "doc", "left_semi")
               .select("doc", F.posexplode(tokens(F.col("body"))).alias("place", "p")).filter("p.slot IS NOT NULL")
               .select("doc", "place", F.col("p.slot").alias("ours")))
    pairs = wanted.join(fillers, ["doc", "place"]).select("doc", "item", "shift", "theirs", "ours").distinct()
    run_key = ["doc", "item", "shift"]
    one_way = pairs.groupBy(*run_key, "theirs").agg(F.count(F.lit(1)).alias("k")).groupBy(*run_key).agg(
        F.max("k").alias("there"), F.sum("k").alias("n_slots"))
    other = pairs.groupBy(*run_key, "ours").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("theirs") != F.col("ours")).alias("new")).groupBy(*run_key).agg(
        F.max("k").alias("back"), F.max("new").alias("new"))
    judged = (runs.join(one_way, run_key, "left").join(other, run_key, "left")
              .filter((F.coalesce("there", F.lit(1)) == 1) & (F.coalesce("back", F.lit(1)) == 1)))
    best = F.max_by(F.struct("n", "total", F.coalesce("n_slots", F.lit(0)).alias("n_slots"),
                             (~F.coalesce("new", F.lit(False))).alias("verbatim")), F.struct("n", -F.col("shift")))
    return (judged.groupBy("doc", "item").agg(best.alias("b"))
            .select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("b.n").alias("n_windows"),
                    F.col("b.total").alias("item_windows"), F.col("b.n_slots").alias("n_slots"), F.col("b.verbatim").alias("verbatim")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
