"""Line dedup: content-defined chunks of lines, and the removal of chunks that occur before.

Rolling hashes over line hashes choose the boundaries, so an insertion moves no boundary but those next to it.
Everything is DataFrame functions.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scriptmill.llm.common import bounded, let, passing, stage, table

#: lines in the window of the rolling hash
WINDOW = 2
#: a boundary is a window whose hash is smaller than those so many lines before and after it;
#: chunks inside a text so have REACH + 1 lines at least
REACH = 1
BASE, MODULUS = 1_000_003, 2_147_483_647


def line_hash(line: Column) -> Column:
    """31 bits of a line's digest."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long") % MODULUS


def rolling(hashes: Column, i: Column, window: int) -> Column:
    """The polynomial hash of the window of line hashes that ends with line i, shorter at the start of a text."""
    total = F.lit(0).cast("long")
    for back in range(window - 1, -1, -1):
        at = F.when(i >= back, F.get(hashes, i - back)).otherwise(F.lit(0))
        total = (total * BASE + at) % MODULUS
    return total


def chunks(lines: Column, window: int = WINDOW, reach: int = REACH) -> Column:
    """array<struct<first int, last int>>: the chunks of an array of lines, in order."""
    def ends(rolls: Column) -> Column:
        def is_end(i: Column) -> Column:
            low = F.lit(True)
            for d in range(1, reach + 1):
                for other in (i - d, i + d):
                    low = low & F.when((other < 0) | (other >= F.size(rolls)), True).otherwise(
                        F.get(rolls, i) < F.get(rolls, other))
            return (low & (i >= reach) & (i < F.size(rolls) - 1 - reach)) | (i == F.size(rolls) - 1)

        return F.filter(F.sequence(F.lit(0), F.size(rolls) - 1), is_end)

    def spans(last: Column) -> Column:
        return F.transform(last, lambda e, k: F.struct(
            F.when(k == 0, F.lit(0)).otherwise(F.get(last, k - 1) + 1).alias("first"), e.alias("last")))

    def rolls(hashes: Column) -> Column:
        return F.transform(hashes, lambda h, i: rolling(hashes, i, window))

    return let(let(let(F.transform(lines, line_hash), rolls), ends), spans)


def chunk_texts(text: Column) -> Column:
    """array<struct<n_lines int, body string>> of a text; a null text has none."""
    return let(F.split(text, "\n"), lambda lines: F.transform(chunks(lines), lambda c: F.struct(
        (c.last - c.first + 1).alias("n_lines"),
        F.array_join(F.slice(lines, c.first + 1, c.last - c.first + 1), "\n").alias("body"))))


def repeated_chunks(documents: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    min_lines: int = 2) -> DataFrame:
    """(row key of `documents`: `_id`, chunk number `_at`) of each chunk of `min_lines` lines or more whose bytes also are those of an
    earlier one: one in a smaller (doc_id, position).

    Digests are counted with partial sums, so a chunk that a third of all documents share is one
    number per task. Only chunks whose digest repeats are compared, byte by byte, with the first of them;
    a chunk that differs stays.
    """
    pieces = documents.select(F.col(doc_id).alias("_id"), F.posexplode(chunk_texts(F.col(text))).alias("_at", "c")).where(
        F.col("c.n_lines") >= min_lines)
    keyed = pieces.select("_id", "_at", F.xxhash64("c.body").alias("digest"), "c.body")
    place = F.struct("_id", "_at")
    first = stage(keyed.groupBy("digest").agg(F.min(place).alias("place"), F.count("*").alias("n")).where(
        "n > 1").drop("n"), "chunk-digests")  # written, so that AQE can split a hot digest in the join
    again = stage(keyed.join(bounded(first), "digest").select(
        "digest", "_id", "_at", "body", (place == F.col("place")).alias("is_first")), "chunks")
    firsts = stage(again.where("is_first").groupBy("digest").agg(F.min("body").alias("first_body")), "first-chunks")
    return again.where("not is_first").join(
        bounded(firsts, F.ceil(F.octet_length("first_body") / 40) + 1), "digest").where("body = first_body").select("_id", "_at")


def drop_repeated_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text",
                        min_lines: int = 2) -> DataFrame:
    """`documents` with the repeated chunks cut out of their texts; all columns and rows stay.

    A chunk stays where its (doc_id, position) is smallest. A text all of whose chunks go becomes empty; null
    texts stay null. Rows with a null id are left as they are and hide no other row's chunks. Rows
    that share an id count as one document: what is repeated at a position of one goes from all of them.
    Texts without a second line are never cut. Other columns may have any name.
    """
    with passing(documents.sparkSession):
        cut = stage(repeated_chunks(documents.where(F.col(doc_id).isNotNull()), doc_id, text, min_lines).groupBy(
            F.col("_id").alias("_cut_id")).agg(F.collect_set("_at").alias("_cut")), "cuts", lasting=True)
    rows = documents.select(F.col(doc_id).alias("_id"), F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_row"))
    own = F.col("_row").getField(text)
    left = F.array_join(F.transform(F.filter(
        chunk_texts(own), lambda c, k: ~F.array_contains(F.col("_cut"), k)), lambda c: c.body), "\n")
    joined = rows.join(bounded(cut, F.size("_cut")), F.col("_id") == F.col("_cut_id"), "left").withColumn(
        "_text", F.when(F.col("_cut").isNull(), own).otherwise(left))
    return joined.select(*((F.col("_text") if c == text else F.col("_row").getField(c)).alias(c)
                           for c in documents.columns))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text after the removal of repeated chunks, with its number of lines before and after."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn(
        "n_lines", F.size(F.split("text", "\n")).cast("long"))
    return drop_repeated_lines(documents).select(
        "doc_id", "n_lines", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast(
            "long").alias("n_kept"), "text")


#: the same in SQL: chunk ends are lines whose rolling hash is below both neighbours'
SQL = f"""
with l as (select doc_id, string_split(text, chr(10)) as lines from documents),
e as (select doc_id, len(lines) as n, unnest(range(0, len(lines))) as i, lines from l),
h as (select doc_id, n, i, lines[i + 1] as line,
    ('0x' || substr(md5(lines[i + 1]), 1, 8))::bigint % {MODULUS} as h from e),
r as (select *, (coalesce(lag(h) over w, 0) * {BASE} + h) % {MODULUS} as r from h
  window w as (partition by doc_id order by i)),
b as (select *, (r < lag(r) over w and r < lead(r) over w and i >= {REACH} and i < n - 1 - {REACH})
    or i = n - 1 as is_end from r window w as (partition by doc_id order by i)),
k as (select *, coalesce(sum(is_end::int) over (partition by doc_id order by i
    rows between unbounded preceding and 1 preceding), 0) as k_no from b),
c as (select doc_id, k_no, count(*) as lines, string_agg(line, chr(10) order by i) as body from k group by 1, 2),
f as (select *, row_number() over (partition by body, lines >= 2 order by doc_id, k_no) as seen from c),
t as (select doc_id, string_agg(body, chr(10) order by k_no) filter (where lines < 2 or seen = 1) as text
  from f group by 1)
select t.doc_id, len(lines)::bigint as n_lines, (case when coalesce(text, '') = '' then 0
  else len(string_split(text, chr(10))) end)::bigint as n_kept, coalesce(text, '') as text from t join l using (doc_id)
"""
