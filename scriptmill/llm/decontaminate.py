"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, windows of the templates are hash-joined, and the
values that fill the slots must map consistently from item to document, so that questions with other
parameters are caught too. Everything is DataFrame functions.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scriptmill.llm.common import bounded, let, passing, stage, table

#: words of a window, and how many of them must be literal words in a window of a benchmark item
WINDOW, LITERALS = 6, 3
#: shares of an item's windows, and of its slots with one value, from which a document counts as leaked
COVERAGE, CONSISTENCY = 0.35, 0.5

NUMBER, NAME, UNIT = "\uE000", "\uE001", "\uE002"
#: stands before words that may be names or not
INITIAL = "\uE003"
UNITS = ("mm cm dm m km in ft yd mi mg g kg t lb lbs oz ml cl l s sec min h hr hrs day days week weeks month months "
         "year years ms hz khz mhz ghz w kw mw v kb mb gb tb mph kmh percent usd eur gbp dollars dollar euros euro cents cent "
         "meters meter metres metre kilometers kilometer grams gram kilograms kilogram liters liter litres litre "
         "seconds second minutes minute hours hour miles mile feet foot inches inch pounds pound degrees degree").split()
#: a word without a digit is read once, from its start: behind a letter none begins that did not match before it
NUMBERS = "\\p{N}+(?:[.,:/]\\p{N}+)+|(?<![\\p{L}\\p{M}])[\\p{L}\\p{M}]*+\\p{N}[\\p{L}\\p{M}\\p{N}]*+"
NAMES = f"\\p{{Lu}}(?<=[\\p{{Ll}}{NUMBER}][,;]? {{1,2}}\\p{{Lu}})[\\p{{L}}\\p{{M}}]*"
#: capitalised words that NAMES leaves at the start of a sentence, a line, a quote or a bracket
INITIALS = f"\\p{{Lu}}(?<=(?:^|[^\\p{{L}}\\p{{M}}\\p{{N}}{NUMBER}-{INITIAL} ,;] {{0,2}})\\p{{Lu}})[\\p{{L}}\\p{{M}}]*"
MEASURES = f"({NUMBER} {{1,2}})(?i:{'|'.join(UNITS)})(?![\\p{{L}}\\p{{M}}])"


def plain(text: Column) -> Column:
    """The text without the signs that stand for slots; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    signs = NUMBER + NAME + UNIT + INITIAL
    held = text.contains(NUMBER) | text.contains(NAME) | text.contains(UNIT) | text.contains(INITIAL)
    return F.when(held, F.translate(text, signs, " " * len(signs))).otherwise(text)


def marked(text: Column) -> Column:
    """A plain text with placeholders: numbers; capitalised words inside a sentence; units behind numbers."""
    text = F.regexp_replace(text, NUMBERS, f" {NUMBER} ")
    return F.regexp_replace(F.regexp_replace(text, NAMES, NAME), MEASURES, f"$1{UNIT}")


def marked_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), f"[^\\p{{L}}\\p{{M}}{NUMBER}-{INITIAL}]+"), "")


def template(text: Column) -> Column:
    """The words of a plain text in lower case, with placeholders."""
    return marked_words(marked(text))


def named_template(text: Column) -> Column:
    """The words of `template`, with a name's placeholder also for capitalised words that start a sentence, which
    may be names or not."""
    return marked_words(F.regexp_replace(marked(text), INITIALS, NAME))


def raw_words(text: Column) -> Column:
    """The words of a plain text as they stand, one for each of its template's."""
    return F.regexp_extract_all(text, F.lit("\\p{N}+(?:[.,:/]\\p{N}+)+|[\\p{L}\\p{M}\\p{N}]+"), F.lit(0))


def window_hash(hashes: Column, at, size: int) -> Column:
    """The hash of the window at place `at` (from 0), of the hashes of its words."""
    return F.xxhash64(*(F.get(hashes, at + k) for k in range(size)))


def item_windows(benchmark: DataFrame, item_id: str, text: str, size: int, literals: int) -> DataFrame:
    """hash, item_id, item_pos, own, named, item_windows: distinct windows of each item that hold enough literal words; with
    `named` those of its named template that differ. `own` is the hash of the plain window that either stands for."""
    items = benchmark.where(F.col(item_id).isNotNull()).select(
        F.col(item_id).alias("item_id"), template(plain(F.col(text))).alias("words"),
        named_template(plain(F.col(text))).alias("named_words"))
    marks = F.array(F.lit(NUMBER), F.lit(NAME), F.lit(UNIT))

    def enough(window: str) -> Column:
        return F.size(F.filter(window, lambda x: ~F.array_contains(marks, x))) >= literals

    spans = items.where(F.size("words") >= size).select("item_id", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.struct(
            (i - 1).alias("pos"), F.slice("words", i, size).alias("w"),
            F.slice("named_words", i, size).alias("named_w")))).alias("s"))
    def hashed(window: str) -> Column:
        return let(F.transform(window, lambda w: F.xxhash64(w)), lambda h: window_hash(h, F.lit(0), size))

    own = hashed("s.w")
    kept = stage(spans.where(enough("s.w")).groupBy("item_id", own.alias("own")).agg(
        F.min_by("s", "s.pos").alias("s")), "item-spans")
    both = kept.select(F.col("own").alias("hash"), "item_id", F.col("s.pos").alias("item_pos"), "own",
                       F.lit(False).alias("named")).unionByName(
        kept.where((F.col("s.w") != F.col("s.named_w")) & enough("s.named_w")).select(
            hashed("s.named_w").alias("hash"), "item_id", F.col("s.pos").alias("item_pos"), "own",
            F.lit(True).alias("named")))
    return both.join(kept.groupBy("item_id").agg(F.count("*").alias("item_windows")), "item_id")


def text_windows(texts: DataFrame, size: int) -> DataFrame:
    """doc_id, doc_pos, hash: all windows of the texts' templates, and those of their named templates that differ.

    Lambdas see each word once; windows, of which there are as many, are rows and so compiled.
    """
    def hashed(words: Column) -> Column:
        """Each word is hashed once, and once more for all words that may be names; windows combine hashes."""
        initial = F.transform(words, lambda w: F.startswith(w, F.lit(INITIAL)))
        own = F.transform(words, lambda w: F.xxhash64(F.when(F.startswith(w, F.lit(INITIAL)), F.substring(w, 2, 2**31 - 1)).otherwise(w)))
        named = F.zip_with(initial, own, lambda i, h: F.when(i, F.xxhash64(F.lit(NAME))).otherwise(h))
        return F.struct(own.alias("own"), named.alias("named"))

    # a generator's columns are not computed again by what reads them
    hashes = texts.select("doc_id", F.inline(F.transform(F.array(marked_words(F.regexp_replace(
        marked(F.col("text")), INITIALS, INITIAL + "$0"))), hashed)))
    at = F.col("doc_pos")
    windows = hashes.select("doc_id", "own", "named", F.posexplode("own").alias("doc_pos", "_word")).where(
        at <= F.size("own") - size).select(
        "doc_id", "doc_pos", window_hash(F.col("own"), at, size).alias("own"), window_hash(F.col("named"), at, size).alias("named"))
    return windows.select("doc_id", "doc_pos", F.explode(F.array("own", F.nullif("named", "own"))).alias("hash")).where(
        "hash is not null")


def leaks(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, literals: int = LITERALS,
          coverage: float = COVERAGE, consistency: float = CONSISTENCY) -> DataFrame:
    """doc_id, item_id, n_windows, coverage, consistency, reparameterised: documents that hold a benchmark item.

    A pair counts where some occurrence has at least `coverage` of the item's distinct template windows and at least
    `consistency` of the item's slots in them are filled by one value each. Occurrences are the hits at one shift
    between document and item, those at shifts within half an item's length to a length of each other (words put in or
    left out), and all hits of the text; copies that follow each other are so judged each for itself. n_windows and coverage are
    those of the whole text, consistency is that of the best occurrence; a pair is reparameterised where some slot has another value than
    in the item. All windows of all whole texts are looked up. Repeated item ids are one item with all their windows; repeated document ids
    one document. A window matches by its template or with the capitalised words that start sentences as names, so that
    other names there are found too; a word that is no name then only is a slot more.
    Null ids, and items with fewer than `size` words or without a window of `literals` literal words, match
    nothing; null and empty texts have no windows. Other columns are not read. An empty table gives no rows.
    """
    def windows(hits: Column) -> Column:
        """Distinct windows of the item; one place of the text stands for one of them at most."""
        return F.least(F.size(F.array_distinct(hits.own)), F.size(F.array_distinct(hits.doc_pos)))

    items = stage(item_windows(benchmark, item_id, item_text, size, literals), "item-windows")
    texts = documents.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), plain(F.col(text)).alias("text"))
    found = text_windows(texts, size)
    hits = stage(found.join(bounded(items.select("hash", "item_id", "item_pos", "own", "named")), "hash"), "window-hits")
    pairs = hits.groupBy("doc_id", "item_id").agg(
        F.collect_set(F.struct("doc_pos", "item_pos", "own", "named")).alias("at")).withColumn(
        "n_windows", windows(F.col("at"))).join(
        items.groupBy("item_id").agg(F.first("item_windows").alias("total"), F.max("item_pos").alias("last")), "item_id").where(
        F.col("n_windows") >= coverage * F.col("total"))
    pairs = stage(pairs, "leak-candidates")
    ids = stage(pairs.select("doc_id").distinct(), "leak-documents")
    own = texts.join(bounded(ids), "doc_id", "left_semi").select(
        "doc_id", raw_words(F.col("text")).alias("doc_raw"))
    asked = benchmark.where(F.col(item_id).isNotNull()).select(
        F.col(item_id).alias("item_id"), plain(F.col(item_text)).alias("t")).join(
        pairs.select("item_id").distinct(), "item_id", "left_semi").select(
        "item_id", template(F.col("t")).alias("item_words"),
        named_template(F.col("t")).alias("item_named"), raw_words(F.col("t")).alias("item_raw"))

    def slots(hit: Column) -> Column:
        both = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.struct(
            F.when(hit.named, F.get("item_named", hit.item_pos + k)).otherwise(
                F.get("item_words", hit.item_pos + k)).alias("kind"),
            F.lower(F.get("item_raw", hit.item_pos + k)).alias("asked"),
            F.lower(F.get("doc_raw", hit.doc_pos + k)).alias("given")))
        return F.filter(both, lambda s: s.kind.isin(NUMBER, NAME, UNIT))

    shift, band = F.col("hit.shift"), F.floor((F.col("last") + size) / 2)
    places = F.array(*(F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("at")) for kind, at in (
        ("text", F.lit(0)), ("shift", shift), ("band", F.floor(shift / band)), ("band", F.floor(shift / band) - 1))))
    filled = pairs.join(own, "doc_id").join(asked, "item_id").select(
        "doc_id", "item_id", "total", "last", F.explode(F.transform("at", lambda hit: F.struct(
            (hit.doc_pos - hit.item_pos).alias("shift"), hit.own.alias("own"), hit.doc_pos.alias("doc_pos"),
            slots(hit).alias("slots")))).alias("hit"))
    parts = filled.select("doc_id", "item_id", "total", "hit.own", "hit.doc_pos", "hit.slots", F.explode(places).alias("place")).groupBy(
        "doc_id", "item_id", "place").agg(
        F.max("total").alias("total"), F.least(F.size(F.collect_set("own")), F.size(F.collect_set("doc_pos"))).alias("n_windows"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots")).where(
        F.col("n_windows") >= coverage * F.col("total"))

    def steady(slots: Column) -> Column:
        """The share of distinct item values that have one value in the document."""
        asked = F.array_distinct(F.transform(slots, lambda s: F.struct(s.kind, s.asked)))
        single = F.filter(asked, lambda a: F.size(F.filter(
            slots, lambda s: (s.kind == a.getField("kind")) & (s.asked == a.getField("asked")))) == 1)
        return F.when(F.size(slots) == 0, 1.0).otherwise(F.size(single) / F.size(asked))

    return parts.select(
        "doc_id", "item_id", "n_windows", (F.col("n_windows") / F.col("total")).alias("coverage"),
        steady(F.col("slots")).alias("consistency"),
        F.exists("slots", lambda s: s.asked != s.given).alias("reparameterised")).groupBy("doc_id", "item_id").agg(
        F.max("n_windows").cast("long").alias("n_windows"), F.max("coverage").alias("coverage"),
        F.max("consistency").alias("consistency"), F.max("reparameterised").alias("reparameterised")).where(
        F.col("consistency") >= consistency)


def drop_leaked(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`documents` without those that hold a benchmark item; rows with a null id stay."""
    with passing(documents.sparkSession):
        gone = stage(leaks(documents, benchmark, doc_id, text).select(F.col("doc_id").alias("_gone")).distinct(), "leaked", lasting=True)
    return documents.join(bounded(gone), F.col(doc_id) == F.col("_gone"), "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
