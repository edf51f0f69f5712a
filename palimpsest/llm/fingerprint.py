"""Document fingerprints by a homomorphic multiset hash of paragraphs. DataFrame functions only.

A paragraph (a line, empty ones included) has a vector of integers; a text has the sum of its paragraphs' vectors. So the
order of paragraphs does not matter, the print of two texts joined is the sum of theirs, and a paragraph is inserted or
deleted by adding or taking off its vector alone. The vector has two parts. WIDE lanes modulo 2^32, hashed from the
paragraph's SHA-256, tell multisets of paragraphs apart. 2 * PACKED lanes, two in a long, are sums of signs hashed from the
paragraph's runs of five words: their cosine estimates that of the texts' multisets of runs, with a deviation of at most
1 / sqrt(2 * PACKED), which is the likeness of two prints. Runs are summed within each task before anything moves, and what
moves is one print for each text and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import table, written

WIDE, PACKED, WORDS = 16, 64, 5
LOW = (1 << 32) - 1
ONES = (1 << 32) + 1
KEY = ["id", "th"]


def paragraphs_of(text: Column) -> Column:
    """The lines of a text; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def prints(paragraphs: DataFrame, by: list[str], *, column: str = "paragraph", sign: str = "1L") -> DataFrame:
    """by, print: the sum of the vectors of each group's paragraphs, each times the whole number that `sign` is for its row.

    A paragraph of fewer than five words is one run; one without words has none.
    """
    words = F.filter(F.split(F.translate(column, "\t\n\x0b\x0c\r", " " * 5), " "), lambda w: w != "")
    rows = paragraphs.select(*by, F.expr(sign).cast("long").alias("sign"), F.sha2(F.encode(column, "UTF-8"), 256).alias("digest"), words.alias("words"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - WORDS + 1)), lambda i: F.xxhash64(F.slice("words", i, WORDS)))
    rows = rows.select(*by, "sign", "digest", F.posexplode_outer(F.when(F.size("words") > 0, runs)).alias("at", "h"))
    rows = rows.withColumns({"h0": F.col("h"), "h1": F.xxhash64("h", F.lit(1))}).drop("h")
    first = F.coalesce("at", F.lit(0)) == 0
    wide = [F.sum(F.when(first, F.xxhash64(F.lit(i), "digest").bitwiseAND(LOW) * F.col("sign"))).alias(f"w{i}") for i in range(WIDE)]
    # Bits j and 32 + j of a hash are two signs; with bits counted, a lane is twice its count less the number of runs.
    bits = [F.sum(F.shiftright(f"h{i // 32}", i % 32).bitwiseAND(ONES) * F.col("sign")).alias(f"b{i}") for i in range(PACKED)]
    summed = rows.groupBy(*by).agg(*wide, *bits, F.sum(F.when(F.col("at").isNotNull(), F.col("sign"))).alias("n"))
    lane = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return summed.select(*by, F.array(*[lane(f"w{i}") for i in range(WIDE)], *[2 * lane(f"b{i}") - lane("n") * ONES for i in range(PACKED)]).alias("print"))


def reduced(lanes: Column) -> Column:
    """A print with its wide lanes modulo 2^32."""
    return F.transform(lanes, lambda x, i: F.when(i < WIDE, x.bitwiseAND(LOW)).otherwise(x))


def inserted(a: Column, b: Column) -> Column:
    """The print of a text of print a after paragraphs of print b have come to it."""
    return reduced(F.zip_with(a, b, lambda x, y: x + y))


def deleted(a: Column, b: Column) -> Column:
    """The print of a text of print a after paragraphs of print b have been taken from it."""
    return reduced(F.zip_with(a, b, lambda x, y: x - y))


def _signs(lanes: Column) -> Column:
    """The 2 * PACKED lanes of signs."""
    packed = F.slice(lanes, WIDE + 1, PACKED)
    low = F.transform(packed, lambda x: F.shiftright(F.call_function("shiftleft", x, F.lit(32)), 32))
    return F.concat(low, F.zip_with(packed, low, lambda x, y: F.shiftright(x - y, 32)))


def likeness(a: Column, b: Column) -> Column:
    """The likeness of two prints, 0 to 1: 1 for equal ones, else the cosine of their lanes of signs; 0 if one has no words."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    x, y = _signs(a), _signs(b)
    cosine = F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(cosine, F.lit(0.0)))))


def shown(lanes: Column) -> Column:
    """A print as a string: its lanes as 32-bit numbers, in base 64."""
    hexed = lambda x: F.lpad(F.hex(x.bitwiseAND(LOW)), 8, "0")
    return F.base64(F.unhex(F.array_join(F.transform(F.concat(F.slice(lanes, 1, WIDE), _signs(lanes)), hexed), "")))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th (hash of the text), print: a row for each document; rows that repeat an id and its text come as one.

    A null text is an empty one, and an empty text has one empty paragraph. An id may be null.
    """
    rows = _keyed(docs, id_col, text_col)
    return _prints_of(rows, rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("times")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _same(a: str, b: str) -> Column:
    """Whether the keys of two tables are one; ids may be null."""
    return (F.col(f"{a}.th") == F.col(f"{b}.th")) & F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id"))


def _prints_of(rows: DataFrame, times: DataFrame) -> DataFrame:
    found = prints(rows.select(*KEY, F.explode(paragraphs_of(F.col("text"))).alias("paragraph")), KEY)
    both = found.alias("a").join(times.alias("b"), _same("a", "b"))
    return both.select("a.id", "a.th", reduced(F.transform("print", lambda x: F.call_function("div", x, F.col("b.times")))).alias("print"))


def next_keys(keys: DataFrame) -> DataFrame:
    """keys of id, th -> next_id, next_th too: the following row by descending id (null last), then th; after the last, the first.

    Rows are dealt out by ranges; within a range the next row is known, and the first rows of all ranges, as many as there
    are partitions, tell the rest.
    """
    order = [F.col("id").desc_nulls_last(), F.col("th").asc()]
    dealt = written(keys.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "print-ranges")
    firsts = dealt.groupBy("range").agg(F.min_by(F.struct(*KEY), F.struct(F.col("id").isNull(), -F.coalesce("id", F.lit(0)), "th")).alias("first"))
    of = W.orderBy("range")
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(of), F.first("first").over(of)).alias("after"))
    within = F.lead(F.struct(*KEY)).over(W.partitionBy("range").orderBy(*order))
    following = dealt.withColumn("own", within).join(firsts, "range").withColumn("next", F.coalesce("own", "after"))
    return following.select(*keys.columns, F.col("next.id").alias("next_id"), F.col("next.th").alias("next_th"))


def edited_prints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, print, edited_print, next_print: a row for each row of docs.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document's, by descending id, ties by a hash of the text; after the last comes the first, which may be the document
    itself. The next of a row that is repeated as a whole is its repetition. Its print is made from the text's: paragraphs
    from the edit on are deleted, those that take their place inserted; none before it is read again.
    """
    rows = _keyed(docs, id_col, text_col)
    keys = written(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("times"), F.first(F.length("text")).alias("n")), "print-keys")
    following = next_keys(keys)
    again = following.where("times > 1").withColumns({"next_id": F.col("id"), "next_th": F.col("th"), "copies": F.col("times") - 1})
    following = written(following.withColumn("copies", F.lit(1).cast("long")).unionByName(again), "print-next")
    all_prints = written(_prints_of(rows, keys.select(*KEY, "times")), "prints")

    asked = following.select(F.col("next_id").alias("id"), F.col("next_th").alias("th"), F.col("id").alias("of_id"), F.col("th").alias("of_th"), F.floor(F.col("n") / 3).cast("int").alias("cut"))
    heads = rows.alias("a").join(asked.hint("shuffle_hash").alias("b"), _same("a", "b"))
    heads = heads.select(F.col("of_id").alias("id"), F.col("of_th").alias("th"), F.col("a.id").alias("next_id"), F.col("a.th").alias("next_th"), "cut", F.left("text", F.col("cut")).alias("head"))
    both = rows.alias("a").join(heads.alias("b"), _same("a", "b")).withColumn("keep", F.length("text") - F.col("cut"))
    kept = F.left("text", F.col("keep"))
    tail = F.substring_index(kept, "\n", -1)
    both = both.select(F.col("a.id"), F.col("a.th"), "next_id", "next_th", F.sha2(F.encode(F.concat(kept, "head"), "UTF-8"), 256).alias("edited_sha256"), F.concat(tail, F.expr("substring(text, keep + 1)")).alias("old"), F.concat(tail, "head").alias("new"))
    pair = [*KEY, "next_id", "next_th"]
    changed = both.select(*pair, "edited_sha256", F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("old").alias("part")), F.struct(F.lit(1).alias("sign"), F.col("new").alias("part")))).alias("c"))
    changed = changed.select(*pair, "edited_sha256", "c.sign", F.explode(paragraphs_of(F.col("c.part"))).alias("paragraph"))
    changes = written(prints(changed, [*pair, "edited_sha256"], sign="sign"), "print-changes")

    out = following.alias("f").join(all_prints.alias("p"), _same("f", "p")).select("f.*", "p.print")
    out = out.alias("f").join(all_prints.select(F.col("id"), F.col("th"), F.col("print").alias("next_print")).alias("q"), (F.col("f.next_th") == F.col("q.th")) & F.col("f.next_id").eqNullSafe(F.col("q.id"))).select("f.*", "q.next_print")
    # A row of a text that is repeated, or whose next one is, met each of them.
    met = keys.select(F.col("id").alias("next_id"), F.col("th").alias("next_th"), F.col("times").alias("next_times"))
    out = out.alias("f").join(met.alias("m"), (F.col("f.next_th") == F.col("m.next_th")) & F.col("f.next_id").eqNullSafe(F.col("m.next_id"))).select("f.*", "m.next_times")
    out = out.alias("f").join(changes.alias("c"), _same("f", "c") & (F.col("f.next_th") == F.col("c.next_th")) & F.col("f.next_id").eqNullSafe(F.col("c.next_id")))
    change = F.transform("c.print", lambda x: F.call_function("div", x, F.col("times") * F.col("next_times")))
    out = out.select(F.col("f.id"), F.col("n").cast("long").alias("n_chars"), "edited_sha256", "f.print", inserted(F.col("f.print"), change).alias("edited_print"), "next_print", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return out.drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_prints(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", shown(F.col("print")).alias("fingerprint"), shown(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
