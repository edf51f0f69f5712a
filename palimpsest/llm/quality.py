"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

Grams are of UTF-8 bytes, up to ORDER of them packed in a long. Counting: each task sums the grams of its trusted texts,
the sums meet on shards by gram. Model: a row for each order and context, with what the context leaves to shorter ones and
what each byte after it has of its own. Scoring: documents are dealt to chunks of some `chunk_bytes`; a chunk asks for its
distinct grams, all distinct grams asked for are joined with the model on context shards, from the shortest order to the
longest, p(gram) = own(gram) + left(context) * p(gram without its first byte), and each chunk gets the log probabilities of
its own grams back by a join. So neither the model nor the grams pass through the driver or a broadcast, at any size, and
the keys of joins have bounded fan-in: a context has at most 256 bytes before it and 257 after it. Thresholds are quantiles
of the trusted documents, by language and length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import free_names, table, written

ORDER = 5
#: Bytes of a text that are looked at together: longer texts are cut, with the overlap that grams need.
PIECE = 1 << 20
BATCH_BYTES = 1 << 21
STEP = 0.005


def padded_pieces(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with piece (its number), pieces (how many the text has) and part (its bytes) instead of text_col.

    A text has ORDER - 1 bytes 0 before it and one after it; null texts count as empty. Each run of ORDER bytes within a
    part is a gram, and each gram of a text lies in one part.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    whole = docs.withColumn("__padded", F.concat(F.lit(bytes(ORDER - 1)), text, F.lit(b"\0"))).drop(text_col)
    whole = whole.withColumn("pieces", F.ceil((F.octet_length("__padded") - (ORDER - 1)) / PIECE).cast("int"))
    return whole.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("part", F.expr(f"substring(__padded, piece * {PIECE} + 1, {PIECE + ORDER - 1})")).drop("__padded")


def grams(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ORDER bytes of each part, as longs; and how many each part has."""
    counts = np.fromiter((max(0, len(p) - ORDER + 1) for p in parts), np.int64, len(parts))
    data = np.frombuffer(b"".join(parts), np.uint8)
    if len(data) < ORDER:
        return np.zeros(0, np.int64), counts
    key = np.zeros(len(data) - ORDER + 1, np.int64)
    for k in range(ORDER):
        key = (key << 8) | data[k : len(data) - ORDER + 1 + k]
    ends = np.cumsum([len(p) for p in parts])
    keep = np.ones(len(data), bool)
    for k in range(1, ORDER):
        keep[np.maximum(ends - k, 0)] = False  # runs that begin here go on in the next part
    return key[keep[: len(key)]], counts


def batches_of(parts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of parts of about BATCH_BYTES, with the index of the first."""
    first, size = 0, 0
    for i, t in enumerate(parts):
        size += len(t)
        if size >= BATCH_BYTES or i + 1 == len(parts):
            yield first, parts[first : i + 1]
            first, size = i + 1, 0


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about 2 * BATCH_BYTES, so that what is copied of them is bounded."""
    for batch in batches:
        step = max(1, batch.num_rows * 2 * BATCH_BYTES // max(1, batch.nbytes))
        for first in range(0, batch.num_rows, step):
            yield batch.slice(first, step)


def count_grams(docs: DataFrame, text_col: str = "text", flush: int = 1_000_000) -> DataFrame:
    """gram, c: summed within each task, and then over all. Empty texts have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.Series] = []

        def merged() -> pd.Series:
            return pd.concat(held).groupby(level=0, sort=False).sum()

        def out(s: pd.Series) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(s.index.to_numpy(np.int64)), pa.array(s.to_numpy(np.int64))], ["gram", "n"])

        for batch in _sliced(batches):
            for _, parts in batches_of(batch.column(0).to_pylist()):
                codes, found = pd.factorize(grams(parts)[0])
                held.append(pd.Series(np.bincount(codes, minlength=len(found)), found))
                if len(held) > 16:
                    held[:] = [merged()]
                    if len(held[0]) > flush:
                        yield out(held.pop())
        if held:
            yield out(merged())

    texts = docs.where(F.octet_length(text_col) > 0).select(F.col(text_col).alias("text"))
    return padded_pieces(texts, "text").select("part").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("c"))


def _tail(gram: str, n: int) -> Column:
    """The last n bytes of a gram."""
    return F.col(gram).bitwiseAND((1 << 8 * n) - 1)


def train(trusted: DataFrame, text_col: str = "text") -> DataFrame:
    """The model of the texts: n (order), context, left, own (a map from the byte after the context to its share)."""
    counts = written(count_grams(trusted, text_col), "grams")
    # Below the highest order a gram counts once for each byte that comes before it.
    longer = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), _tail("gram", n).alias("gram"), _tail("gram", n + 1).alias("longer")) for n in range(1, ORDER)]))
    lower = counts.select(longer.alias("g")).select("g.*").distinct().groupBy("n", "gram").agg(F.count(F.lit(1)).alias("c"))
    counts = written(lower.unionByName(counts.select(F.lit(ORDER).alias("n"), "gram", "c")), "counts")
    # n1..n4: grams of an order that are counted so many times; d1..d3 are what is taken off counts of 1, 2, and more.
    kinds = counts.groupBy("n").agg(*[F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.0))
    # Where texts repeat, counts of counts need not fall, and the estimate of k - off may leave nothing to take off: then half of k is.
    off = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        off.append(F.when((d > 0) & (d <= k), d).otherwise(F.lit(0.5 * k)).alias(f"d{k}"))
    d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    rest = counts.join(F.broadcast(kinds.select("n", *off)), "n").select("n", F.shiftright("gram", 8).alias("context"), _tail("gram", 1).cast("int").alias("last"), "c", d.alias("d"))  # ORDER rows are sent
    own = F.map_from_entries(F.collect_list(F.struct("last", F.col("c") - F.col("d"))))  # 257 at most
    by = rest.groupBy("n", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("off"), own.alias("own"))
    return written(by.select("n", "context", (F.col("off") / F.col("total")).alias("left"), F.transform_values("own", lambda _, v: v / F.col("total")).alias("own")), "model")


def probabilities(asked: DataFrame, model: DataFrame) -> DataFrame:
    """gram, p for the distinct grams (of ORDER bytes) of asked: joins on context and on the shorter gram, order by order."""
    wanted = [written(asked.select("gram").distinct(), "wanted")]
    for n in range(ORDER - 1, 0, -1):
        wanted.insert(0, wanted[0].select(_tail("gram", n).alias("gram")).distinct())
    p = None
    for n, own in enumerate(wanted, 1):
        known = model.where(F.col("n") == n).select("context", "left", "own")
        own = own.withColumn("context", F.shiftright("gram", 8)).join(known, "context", "left")
        share, left = F.coalesce(F.try_element_at("own", _tail("gram", 1).cast("int")), F.lit(0.0)), F.coalesce("left", F.lit(1.0))
        if p is None:
            p = own.select("gram", (share + left / 256).alias("p"))
        else:
            own = own.select("gram", share.alias("share"), left.alias("left"), _tail("gram", n - 1).alias("tail"))
            p = own.join(p.select(F.col("gram").alias("tail"), F.col("p").alias("shorter")), "tail").select("gram", (F.col("share") + F.col("left") * F.col("shorter")).alias("p"))
    return p


ASKED = "chunk long, context long, lasts array<smallint>"


def _asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of chunk, part, sorted by chunk -> a row for each context that a chunk has, with the distinct bytes after it."""

    def out(chunk: int, held: list[np.ndarray]) -> pa.RecordBatch:
        g = np.unique(np.concatenate(held))
        first = np.flatnonzero(np.concatenate(([True], (g[1:] >> 8) != (g[:-1] >> 8))))
        lasts = pa.ListArray.from_arrays(pa.array(np.append(first, len(g)).astype(np.int32)), pa.array((g & 255).astype(np.int16)))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), chunk, np.int64)), pa.array(g[first] >> 8), lasts], ["chunk", "context", "lasts"])

    now, held = None, []
    for batch in _sliced(batches):
        chunks, parts = batch.column(0).to_numpy(), batch.column(1)
        for chunk in dict.fromkeys(chunks.tolist()):
            if chunk != now and held:
                yield out(now, held)
                held = []
            now = chunk
            for _, some in batches_of(parts.filter(pa.array(chunks == chunk)).to_pylist()):
                held.append(pd.unique(grams(some)[0]))
                if len(held) > 16:
                    held = [np.unique(np.concatenate(held))]
    if held:
        yield out(now, held)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of chunk, key, part, context, lasts, logps, sorted by chunk with those without a part first -> key, n, log_prob."""
    now, held, known = None, [], None
    for batch in _sliced(batches):
        chunks = batch.column("chunk").to_numpy()
        for chunk in dict.fromkeys(chunks.tolist()):
            rows = batch.filter(pa.array(chunks == chunk))
            if chunk != now:
                now, held, known = chunk, [], None
            answers = rows.filter(rows.column("part").is_null())
            if answers.num_rows:
                lasts = answers.column("lasts")
                of = np.repeat(answers.column("context").to_numpy(), np.diff(lasts.offsets.to_numpy()))
                held.append(((of << 8) | lasts.flatten().to_numpy(), answers.column("logps").flatten().to_numpy()))
            texts = rows.filter(rows.column("part").is_valid())
            if not texts.num_rows:
                continue
            if known is None:
                g, p = (np.concatenate(v) for v in zip(*held, strict=True))
                by = np.argsort(g)
                known, held = (g[by], p[by]), []
            total, n = np.zeros(texts.num_rows), np.zeros(texts.num_rows, np.int64)
            for first, parts in batches_of(texts.column("part").to_pylist()):
                g, counts = grams(parts)
                codes, found = pd.factorize(g)
                logp = known[1][np.searchsorted(known[0], found)][codes]
                total[first : first + len(parts)] = np.add.reduceat(logp, np.concatenate(([0], np.cumsum(counts)[:-1])))
                n[first : first + len(parts)] = counts
            yield pa.RecordBatch.from_arrays([texts.column("key"), pa.array(n), pa.array(total)], ["key", "n", "log_prob"])


def score(docs: DataFrame, model: DataFrame, *, id_cols: list[str], text_col: str = "text", chunk_bytes: int = 64 << 20) -> DataFrame:
    """id_cols, n_bytes (with the text's end) and log_prob of each document; null texts are empty ones, of which the end alone is scored.

    Long texts are scored in pieces; rows that repeat all of id_cols and the text are scored each.
    """
    text = F.col(text_col).cast("binary")
    base = docs.select(F.struct(*id_cols, F.xxhash64(text).alias("__text")).alias("key"), text.alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = padded_pieces(base, "text").select(F.struct("key.*", F.col("pieces").alias("__pieces"), F.col("piece").alias("__piece")).alias("key"), "part")
    parts = parts.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(size // chunk_bytes + 1)))
    asked = written(parts.select("chunk", "part").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_asks, ASKED), "asked")
    found = probabilities(asked.select(F.shiftleft("context", 8).alias("context"), F.explode("lasts").alias("last")).select(F.col("context").bitwiseOR(F.col("last")).alias("gram")), model)
    found = found.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.map_from_entries(F.collect_list(F.struct(_tail("gram", 1).cast("smallint"), F.log("p")))).alias("logp"))
    answers = asked.join(found, "context").select("chunk", "context", "lasts", F.transform("lasts", lambda x: F.try_element_at("logp", x)).alias("logps"))
    rows = answers.unionByName(parts, allowMissingColumns=True).select("chunk", "key", "part", "context", "lasts", "logps")
    rows = rows.repartition("chunk").sortWithinPartitions("chunk", F.col("part").isNotNull())
    schema = parts.select("key").withColumns({"n": F.lit(0).cast("long"), "log_prob": F.lit(0.0)}).schema
    out = written(rows.mapInArrow(_scored, schema), "scored-parts")
    one = out.where("key.__pieces = 1").select(*[f"key.{c}" for c in id_cols], F.col("n").alias("n_bytes"), "log_prob")
    # A text's pieces, in order; of rows that are the same in all there are as many of each piece.
    several = out.where("key.__pieces > 1").groupBy(*[F.col(f"key.{c}").alias(c) for c in id_cols], "key.__text", "key.__pieces").agg(F.sort_array(F.collect_list(F.struct("key.__piece", "n", "log_prob"))).alias("p"))
    rows_of = (F.size("p") / F.col("__pieces")).cast("int")
    summed = several.select(*id_cols, (F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["n"]) / rows_of).cast("long").alias("n_bytes"), (F.aggregate("p", F.lit(0.0), lambda a, x: a + x["log_prob"]) / rows_of).alias("log_prob"), F.explode(F.array_repeat(F.lit(1), rows_of)).alias("__row"))
    return one.unionByName(summed.drop("__row"))


def quantile_limits(scored: DataFrame, *, least: int = 20, high: float = 0.99) -> DataFrame:
    """lang, size_class, limit: quantiles of the trusted rows of scored (lang, size_class, nats, trusted).

    The limit is as far above the `high` quantile as that is above the median. A class takes its neighbours in; with fewer
    than `least` trusted rows, the language as a whole stands in, and for a language with fewer, the same length class of all
    languages, or else all rows. Quantiles come from counts in steps of STEP, so that they are exact to one step and the same
    on each run. All groups (level, language, length class) are counted in one table.
    """
    group = lambda level, lang=F.lit(None).cast("string"), at=F.lit(None).cast("int"): F.struct(F.lit(level).alias("level"), lang.alias("lang"), at.cast("int").alias("at"))
    lang, at = F.col("lang"), F.col("size_class")
    fed = [group(0, lang, at + k) for k in (-1, 0, 1)] + [group(1, lang)] + [group(2, at=at + k) for k in (-1, 0, 1)] + [group(3)]
    bins = scored.where("trusted").groupBy("lang", "size_class", F.floor(F.col("nats") / STEP).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = bins.select(F.explode(F.array(*fed)).alias("of"), "bin", "n").groupBy("of", "bin").agg(F.sum("n").alias("n"))
    order = W.partitionBy("of")
    bins = bins.withColumns({"upto": F.sum("n").over(order.orderBy("bin")), "all": F.sum("n").over(order)})
    quantile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), (F.col("bin") + 1) * STEP))
    limits = bins.groupBy("of").agg((2 * quantile(high) - quantile(0.5)).alias("limit"), F.sum("n").alias("count")).where((F.col("count") >= least) | (F.col("of.level") == 3))
    wanted = scored.select("lang", "size_class").distinct().select("lang", "size_class", F.explode(F.array(group(0, lang, at), group(1, lang), group(2, at=at), group(3))).alias("wanted"))
    found = wanted.join(limits, F.col("wanted").eqNullSafe(F.col("of")), "left")
    return found.groupBy("lang", "size_class").agg(F.min_by("limit", F.when(F.col("limit").isNotNull(), F.col("wanted.level"))).alias("limit"))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quality_col: str = "quality", **how) -> DataFrame:
    """id, lang, n_bytes, log_prob, perplexity (for each byte), limit, kept for each document.

    Trusted are the documents that labels call good (quality 1) and never bad. A document is kept if its perplexity is not
    above the limit of its language and length. A null or empty text is kept: there is nothing to hold against it. Without
    trusted documents all are kept. Any discount leaves something to shorter contexts, so that each byte has a probability
    above 0, whatever the trusted texts repeat. A null language is a language of its own; rows that repeat an id are scored each.
    """
    good = labels.groupBy(F.col(id_col).alias("__id")).agg(F.min(quality_col).alias("__q")).where("__q = 1").select("__id")
    texts = docs.select(F.col(id_col).alias("__own"), F.col(text_col).alias("text"))
    trusted = texts.join(good.hint("shuffle_hash"), F.col("__own") == F.col("__id"), "left_semi")
    model = train(trusted, "text")
    base = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    scored = score(base, model, id_cols=["id", "lang"], text_col="text", **how)
    scored = scored.withColumns({"nats": -F.col("log_prob") / F.col("n_bytes"), "size_class": F.floor(F.log2("n_bytes")).cast("int")})
    scored = written(scored, "scored")
    marked = scored.join(good.withColumn("__good", F.lit(True)), F.col("id") == F.col("__id"), "left")
    limits = quantile_limits(marked.select("lang", "size_class", "nats", (F.coalesce("__good", F.lit(False)) & (F.col("n_bytes") > 1)).alias("trusted")))
    limits = limits.select(F.col("lang").alias("of"), F.col("size_class").alias("at"), "limit")
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("of")) & (F.col("size_class") == F.col("at")), "left")
    kept = (F.col("n_bytes") <= 1) | F.col("limit").isNull() | (F.col("nats") <= F.col("limit"))
    return out.select("id", "lang", "n_bytes", "log_prob", F.exp("nats").alias("perplexity"), F.exp("limit").alias("limit"), kept.alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """docs without those that the classifier rejects; rows that repeat an id stay or go together."""
    (name,) = free_names(docs, "bad_id")
    bad = classify(docs, labels, id_col=id_col, **how).where("NOT kept").select(F.col("id").alias(name)).distinct()
    return docs.join(bad.hint("shuffle_hash"), F.col(id_col) == F.col(name), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
