"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

Each source has a target number of words, so each of its documents has the same expected number of copies,
target / source size: the whole part is certain, the fraction is a copy probability. Pivotal rounding pairs two fractional
probabilities and moves mass, counted in words, from one to the other, at random and with unchanged expectations, until one
of them is 0 or 1: the words that the source is to give stay the same at each step. Pairs are formed within chunks of about
`chunk` documents of one source, from long to short; the one document of a chunk that is still fractional goes to the next
level of the tree, whose chunks are of those that are left, until one chunk for each source remains. So a source misses its
target by less than one document, as a rule a short one, and neither a hot source nor the whole table meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import WORD, free_names, table, written

DOC = "struct<size: bigint, id: bigint, th: bigint, rows: bigint>"
ITEM = f"struct<doc: {DOC}, q: double, u: double>"


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """source, source_size -> target too.

    In the order of their code points, null last, sources have the weights in turn and share the sum of all sizes by
    them; none gets more than `most` times its size, and what is above is shared again by weight. So target is
    min(weight * level, most * size) for one level: with sources in the order of most * size / weight, the first at which
    the level that fills it and all later ones is no higher than its own bound. One row for each source comes here.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    out = sources.withColumn("w", w).withColumn("bound", F.lit(float(most)) * F.col("source_size"))
    by = W.orderBy((F.col("bound") / F.col("w")), F.col("source").asc_nulls_last())
    whole = W.partitionBy(F.lit(0))
    out = out.withColumns(
        {
            "total": F.sum(F.col("source_size").cast("double")).over(whole),
            "filled": F.coalesce(F.sum("bound").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
            "open": F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing)),
        }
    ).withColumn("level", (F.col("total") - F.col("filled")) / F.col("open"))
    fits = F.when(F.col("level") <= F.col("bound") / F.col("w"), F.struct(F.col("bound") / F.col("w"), "level"))
    out = out.withColumn("level", F.min(fits).over(whole).getField("level"))
    return out.select("source", "source_size", F.coalesce(F.least(F.col("w") * F.col("level"), "bound"), F.col("bound")).alias("target"))


def _fold() -> Column:
    """Pivotal rounding along the array `items`: the one still open, and the decided ones. q: its probability times its words."""

    def step(doc: str, q: str, decided: str, pick: int) -> str:
        return f"named_struct('open', named_struct('doc', {doc}, 'q', {q}), 'done', array_append(acc.done, named_struct('doc', {decided}, 'pick', {pick})))"

    a, b, both = "acc.open", "x", "acc.open.q + x.q"
    to_a, to_b = f"least({a}.doc.size - {a}.q, {b}.q)", f"least({a}.q, {b}.doc.size - {b}.q)"
    return F.expr(
        f"""aggregate(slice(items, 2, size(items)),
        named_struct('open', named_struct('doc', items[0].doc, 'q', items[0].q), 'done', cast(array() AS array<struct<doc: {DOC}, pick: int>>)),
        (acc, x) -> CASE
          WHEN x.u * ({to_a} + {to_b}) < {to_b} THEN
            CASE WHEN {a}.doc.size - {a}.q <= {b}.q THEN {step("x.doc", f"{both} - {a}.doc.size", "acc.open.doc", 1)}
            ELSE {step("acc.open.doc", both, "x.doc", 0)} END
          WHEN {a}.q <= {b}.doc.size - {b}.q THEN {step("x.doc", both, "acc.open.doc", 0)}
          ELSE {step("acc.open.doc", f"{both} - {b}.doc.size", "x.doc", 1)} END)"""
    )


def _uniform(*cols) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) * F.lit(2.0**-53)


def round_copies(rows: DataFrame, *, chunk: int = 256, seed: int = 7) -> DataFrame:
    """rows of source, doc (DOC), p (0 to 1) -> source, doc, pick (0 or 1). In each source, words picked come to the sum of p times words, to within one document."""
    open_ = (F.col("p") > 0) & (F.col("p") < 1) & (F.col("doc.size") > 0)
    out, level = [rows.where(~open_).select("source", "doc", F.floor("p").cast("int").alias("pick"))], 0
    left = rows.where(open_).select("source", "doc", (F.col("p") * F.col("doc.size")).alias("q"))
    while True:
        level += 1
        counts = written(left.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("n")), "mix-counts")
        most = counts.agg(F.max("n")).first()[0]
        if most is None:
            break
        dealt = left.join(counts.select(F.col("source").alias("of"), "n"), F.col("source").eqNullSafe(F.col("of")))
        dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("doc.id", "doc.th", F.lit(level)), F.col("n")))
        item = F.struct("doc", "q", _uniform("doc.id", "doc.th", F.lit(seed), F.lit(level)).alias("u"))
        grouped = dealt.groupBy("source", "chunk").agg(F.sort_array(F.collect_list(item), asc=False).cast(f"array<{ITEM}>").alias("items"))
        folded = written(grouped.select("source", _fold().alias("r")), "mix-level")
        out.append(folded.select("source", F.explode("r.done").alias("d")).select("source", "d.doc", "d.pick"))
        left = folded.select("source", "r.open.doc", "r.open.q")
        if most == 1:
            last = F.when(_uniform("doc.id", "doc.th", F.lit(seed)) * F.col("doc.size") < F.col("q"), 1).otherwise(0)
            out.append(left.select("source", "doc", last.alias("pick")))
            break
    done = out[0]
    for more in out[1:]:
        done = done.unionByName(more)
    return done


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), most: float = 3.0, chunk: int = 256, seed: int = 7) -> DataFrame:
    """A row for each document: id, th (hash of the text), source, rows, size, source_size, target, copies, more.

    Sizes are words. Null texts have size 0; a source of size 0 has the target 0 and none of its documents is taken. Rows
    that repeat an id with its text and source come as one row, `rows` is their number: each of them is taken `copies`
    times, and `more` of them once more. Of the copies that they are to have together the whole part is certain, and one
    row's copy alone is drawn. The draw depends on ids, texts and seed alone: reruns agree.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    sized = written(sized.groupBy("id", "th", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-sizes")
    aims = written(targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), weights, most), "mix-targets")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aims = aims.select(F.col("source").alias("of"), "source_size", "target", F.floor(each).alias("base"), (each - F.floor(each)).alias("p"))
    part = F.col("p") * F.col("rows")
    rows = sized.join(aims, F.col("source").eqNullSafe(F.col("of"))).select("source", F.struct("size", "id", "th", "rows").alias("doc"), (part - F.floor(part)).alias("p"))
    picked = round_copies(rows, chunk=chunk, seed=seed)
    more = F.floor(F.col("p") * F.col("doc.rows")) + F.col("pick")
    return picked.join(aims, F.col("source").eqNullSafe(F.col("of"))).select("doc.id", "doc.th", "source", "doc.rows", "doc.size", "source_size", "target", F.col("base").alias("copies"), more.alias("more"))


def mixed_documents(docs: DataFrame, **rules) -> DataFrame:
    """docs with each row as often as the mix takes it, and no other columns than before.

    Of rows that repeat an id with its text and source, those that are taken once more come from one of them.
    """
    id_col, text_col, source_col = rules.get("id_col", "doc_id"), rules.get("text_col", "text"), rules.get("source_col", "source")
    mine, taken_as, n, base, extra, lot, times, copy = free_names(docs, "own", "taken", "rows", "copies", "more", "lot", "times", "copy")
    taken = written(mix(docs, **rules).where("copies + more > 0").select(F.struct("id", "th", "source").alias(taken_as), F.col("rows").alias(n), F.col("copies").cast("int").alias(base), F.col("more").alias(extra)), "mix-taken")
    own = F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(source_col).cast("string").alias("source"))
    same = F.col(mine).eqNullSafe(F.col(taken_as))
    copies = F.col(base) + F.when(F.col(n) == 1, F.col(extra)).otherwise(0).cast("int")
    out = docs.withColumn(mine, own).join(taken.hint("shuffle_hash"), same)
    out = out.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)
    several = taken.where((F.col(n) > 1) & (F.col(extra) > 0))
    if several.isEmpty():
        return out
    one = docs.withColumn(mine, own).join(several.select(taken_as).hint("shuffle_hash"), same, "left_semi").dropDuplicates([mine])
    lots = several.withColumn(lot, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(extra) - 1) / 1000)))).select(taken_as, F.least(F.lit(1000), F.col(extra) - 1000 * F.col(lot)).cast("int").alias(times))
    more = one.join(lots, same).withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(times))))
    return out.unionByName(more.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    mixed = mixed.withColumn("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    copies = F.col("copies") + (F.col("__row") <= F.col("more")).cast("long")
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.alias("copies"))
