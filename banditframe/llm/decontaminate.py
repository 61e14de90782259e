"""Benchmark decontamination by template windows, in DataFrame functions only.

Words are numbers and runs of letters, so punctuation does not count. They are canonicalised: numbers, capitalised words and
units become typed placeholders; others, and words all in capitals, are lower-cased. Windows of a document's canonical words are
looked up among those of the benchmark items. Matches that lie on one diagonal, or on about one, are a run; a run is a leak if it
covers enough of the item's words and its slots are consistent: the words under placeholders pair one to one, as in a question
asked again with other numbers and names. Windows are also looked up by their lower-cased words as they stand, so copies are found
where placeholders would tell nothing.

Cases: null and empty texts have no windows; items of fewer words than a window are looked up as they are, in windows of
their own length, and those of fewer than least_words, which any text may hold, as whole documents; repeated rows are judged alike;
each text is judged for itself, so rows of one id, or of none, with different texts stand or fall alone; an empty table or
benchmark gives no leaks; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banditframe.llm.common import cut

#: Fixed list of units.
UNITS = ["mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "foot", "yd", "yard", "yards", "mile", "miles", "mg", "g", "kg", "lb", "lbs", "oz", "ton", "tons", "ml", "l", "litre", "litres", "liter", "liters", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "usd", "eur", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "kmh", "mph", "degrees", "watt", "watts", "kw", "kwh", "volt", "volts", "amp", "amps", "hz", "mb", "gb"]
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
#: Bits of the bitmap: 16 for each window of the benchmark, as a power of two, within these.
LEAST_BITS, MOST_BITS = 20, 26


def words(text: Column) -> Column:
    """Numbers, with the separators inside them, and runs of letters and digits that begin with a letter."""
    return F.regexp_extract_all(text, F.lit(r"(\p{N}+(?:[.,:/]\p{N}+)*|\p{L}[\p{L}\p{N}]*)"), F.lit(1))


def canonical(rows: DataFrame) -> DataFrame:
    """rows with an array raw of words -> the same with canon, one canonical word for each. What a lambda looks up is a column
    of the step before, so that no array is made again for each of its elements."""

    def one(w: Column) -> Column:
        # in byte order digits come before ":", capitals before "[", small letters before "{", and other alphabets after
        first = F.substring(w, 1, 1)
        name = F.when((F.length(w) > 1) & (w == F.upper(w)), F.lower(w)).otherwise(F.lit(NAME))
        return F.when(w < ":", F.lit(NUM)).when(w < "[", name).when(w < "{", F.lower(w)).when(first != F.lower(first), name).otherwise(F.lower(w))

    typed = rows.withColumn("__typed", F.transform("raw", one))
    unit = lambda w, i: F.when((i > 0) & (F.get("__typed", i - 1) == NUM) & w.isin(UNITS), F.lit(UNIT)).otherwise(w)
    canon = F.when(F.array_contains("__typed", NUM), F.transform("__typed", unit)).otherwise(F.col("__typed"))
    return typed.withColumn("canon", canon).drop("__typed")


def windows(rows: DataFrame, width: int, typed: bool = True) -> DataFrame:
    """rows (key, raw, canon) -> one row a window and hash: key, at, the arrays, which are cut only after filtering, and the hash
    of its canonical words, if at most half are placeholders (and if typed), or else, if exact, of its lower-cased words."""
    starts = F.when(F.size("canon") >= width, F.sequence(F.lit(0), F.size("canon") - width))
    spread = rows.withColumn("low", F.transform("raw", F.lower)).withColumn("at", F.explode(starts))
    cells, low = ([F.get(c, F.col("at") + k) for k in range(width)] for c in ("canon", "low"))
    slots = sum((F.when(c.isin(NUM, NAME, UNIT), 1).otherwise(0) for c in cells[1:]), F.when(cells[0].isin(NUM, NAME, UNIT), 1).otherwise(0))
    # exploded, so that filters read a hash and don't make it again
    hashes = F.array(F.when(F.lit(typed) & (slots * 2 <= width), F.xxhash64(*cells)), F.xxhash64(F.lit("="), *low))
    return spread.select("*", F.posexplode(hashes).alias("exact", "hash")).filter(F.col("hash").isNotNull())


def _keyed(spread: DataFrame, width: int, said: str, *names: str) -> DataFrame:
    """Hash, the columns of names, the words that the hash was made of, and those as they stand."""
    cells = lambda c: F.slice(c, F.col("at") + 1, width)
    return spread.select(*names, "at", "hash", cells("raw").alias(said), F.when(F.col("exact") == 1, cells("low")).otherwise(cells("canon")).alias("canon"))


def _bit(h: Column, half: int, bits: int) -> Column:
    return (F.shiftright(h, 0 if half == 0 else 32)).bitwiseAND(F.lit((1 << bits) - 1))


def _bitmap(hashes: DataFrame, bits: int) -> Column:
    """A bitmap of 2^bits bits as a scalar subquery of longs."""
    found = hashes.select(F.explode(F.array(*[_bit(F.col("hash"), half, bits) for half in (0, 1)])).alias("bit"))
    found = found.groupBy(F.shiftright("bit", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
    full = hashes.sparkSession.range(1 << (bits - 6)).join(found, "id", "left").select("id", F.coalesce("word", F.lit(0)).alias("word"))
    return full.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "word"))), lambda s: s["word"]).alias("map")).scalar()


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 5, coverage: float = 0.6, consistency: float = 0.8, least_words: int = 3) -> DataFrame:
    """(id, mark, item, covered, consistency): the items that leak into each text, mark being the text's hash.

    Only windows that may be the benchmark's are kept from the documents, by a bitmap that grows with the benchmark up to a fixed
    size; the join is exact.
    """
    items = benchmark.select(F.col(item_col).alias("item"), words(F.col(item_text)).alias("raw")).filter(F.size("raw") > 0)
    items = cut(canonical(items.select(F.struct("item", F.size("raw").alias("n"), F.xxhash64("raw").alias("text")).alias("key"), "raw").distinct()))
    short = [r[0] for r in items.filter(F.size("canon") < width).select(F.size("canon").alias("n")).distinct().collect()]
    texts = canonical(docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark")).alias("key"), words(F.col(text_col)).alias("raw")))
    found = None
    for w in [width, *sorted(short)]:
        # an item of too few words for a passage is looked up as a whole document
        typed, among = w >= least_words, texts if w >= least_words else texts.filter(F.size("raw") == w)
        theirs = windows(items.filter(F.size("canon") == w if w < width else F.size("canon") >= width), w, typed)
        theirs = cut(_keyed(theirs, w, "asked", "key.item", "key.n", "key.text").withColumnRenamed("at", "pos"))
        bits = min(max((16 * theirs.count()).bit_length(), LEAST_BITS), MOST_BITS)
        bitmap = _bitmap(theirs.select("hash"), bits)

        def may(h: Column, bitmap: Column = bitmap, bits: int = bits) -> Column:
            places = [_bit(h, half, bits) for half in (0, 1)]
            hits = [F.call_function("shiftright", F.get(bitmap, F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1 for bit in places]
            return hits[0] & hits[1]

        ours = windows(among, w, typed).filter(may(F.col("hash")))
        ours = _keyed(ours, w, "said", "key.id", "key.mark").withColumnRenamed("canon", "seen")
        met = ours.join(theirs, "hash").filter("seen = canon").select("id", "mark", "item", "n", "text", F.lit(w).alias("width"), "at", "pos", "canon", "said", "asked")
        found = met if found is None else found.union(met)
    clean = lambda a: F.transform(a, F.lower)
    pairs = F.arrays_zip("canon", clean("asked").alias("asked"), clean("said").alias("said"))
    slots = F.transform(F.filter(pairs, lambda p: p["canon"].isin(NUM, NAME, UNIT)), lambda p: F.struct(p["asked"].alias("asked"), p["said"].alias("said")))
    diagonal = F.col("at") - F.col("pos")
    band = F.floor(diagonal / 32)
    # one diagonal alone keeps a template that repeats inside an item apart; bands of diagonals bear words put in or left out
    ways = F.array(F.struct(F.lit(True).alias("one"), diagonal.cast("long").alias("at")), *[F.struct(F.lit(False).alias("one"), b.cast("long").alias("at")) for b in (band, band + 1)])
    own = ["id", "mark", "item", "n"]
    run = found.select(*own, "text", "width", "pos", slots.alias("slots"), F.explode(ways).alias("band"))
    run = run.groupBy(*own, "text", "band").agg(F.collect_set(F.struct("pos", "width")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["width"] - 1)))))
    distinct = lambda name: F.size(F.array_distinct(F.transform("slots", lambda s: s[name])))
    agree = F.when(F.size("slots") > 0, F.least(distinct("asked"), distinct("said")) / F.size("slots")).otherwise(1.0)
    run = run.select(*own, (covered / F.col("n")).alias("covered"), agree.alias("consistency"))
    run = run.filter((F.col("covered") >= coverage) & (F.col("consistency") >= consistency))
    return run.groupBy("id", "mark", "item").agg(F.max("covered").alias("covered"), F.max("consistency").alias("consistency"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", **options) -> DataFrame:
    """(id, item, covered, consistency): the items that leak into each document."""
    found = _leaks(docs, benchmark, id_col, item_col=item_col, **options)
    return found.groupBy(F.col("id").alias(id_col), F.col("item").alias(item_col)).agg(F.max("covered").alias("covered"), F.max("consistency").alias("consistency"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that hold a leaked item."""
    bad = cut(_leaks(docs, benchmark, id_col, text_col, **options).select(F.col("id").alias("__bad"), F.col("mark").alias("__mark")).distinct())
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__bad"]) & (F.xxhash64(docs[text_col]) == bad["__mark"]), "left_anti")
