"""Mixing sources to target weights, with DataFrame functions only.

The words of a source, document after document, are packed into blocks of
``block_words``. The mix is a sequence of slots cut into output shards; each slot
takes one block. How many slots of a shard each source gets is drawn: a multinomial
draw for every shard, with the sources' shares of all slots as probabilities. The draws
are conditioned on the sources' totals: shards come in order, a source that has all its
slots is left out of what follows, and the slots this leaves go by a pseudorandom
permutation to the sources that lack some. So totals meet their targets and no source
is drawn past its limit, which independent draws would miss by a relative deviation of
sqrt((1 - share) / (share * slots)). A source's slots are numbered through the shards
by these counts; slot j reads block ``perm(source, j div blocks)(j mod blocks)``, and
blocks are joined by that index.

Defined results: a null text has size 0; size-0 rows take 0 words; a null source is
a source of its own, ordered last; repeated rows are separate documents; an empty
table gives an empty mix; other columns are ignored, whatever their names. Documents
are ordered by doc_id, size and a hash of the row, so reruns agree.

Nothing on the driver or in one task grows with documents, words or sources, but for
single numbers and prefix sums over groups of sources and shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import materialize, table

BLOCK_WORDS = 256
SHARD_SLOTS = 1024
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Groups into which each source's documents are dealt to find their places in it, at
#: least, and documents a group has at most on average.
PLACES, PLACE_ROWS = 1024, 1 << 20
#: Above so many sources tables of sources are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Rows of a group of a prefix sum; cells that index the slots by their source.
GROUP, CELLS = 4096, 1 << 16
ROUNDS = 12
_BEFORE = Window.unboundedPreceding, -1


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def permuted(x: Column, n: Column, *seed: Column, inverse: bool = False) -> Column:
    """Swap-or-not shuffle (Hoang, Morris, Rogaway, 2012): a keyed bijection of [0, n).

    Every round is an involution, so the inverse runs the rounds backwards.
    """
    rounds = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)

    def swap(acc: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(i, *seed), n) - acc, n)
        return F.when(F.xxhash64(i, F.greatest(acc, partner), *seed).bitwiseAND(1) == 1, partner).otherwise(acc)

    return F.aggregate(F.array(*[F.lit(i) for i in rounds]), x.cast("long"), swap)


def _div(a: Column, b: Column | int) -> Column:
    """The whole quotient of non-negative longs; a division of doubles could round up."""
    b = F.lit(b) if isinstance(b, int) else b
    return ((a - F.pmod(a, b)) / b).cast("long")


def _before(value: str, window) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(*_BEFORE)), F.lit(0)).cast("long")


def running(rows: DataFrame, by: list[str], order: list[str], value: str, name: str, group: int = GROUP) -> DataFrame:
    """``rows`` (stored) with ``name``: the sum of ``value`` over the rows of equal ``by`` that
    come before by ``order``, whose first column is a number. Sums of groups of ``group``
    numbers are added up first, so that a task holds a group, or the sums of all groups."""
    rows = rows.withColumn("_g", _div(F.col(order[0]), group))
    sums = rows.groupBy(*by, "_g").agg(F.sum(value).alias("_s"))
    sums = sums.select(*by, "_g", _before("_s", Window.partitionBy(*by).orderBy("_g")).alias("_ahead"))
    inside = _before(value, Window.partitionBy(*by, "_g").orderBy(*order))
    return rows.withColumn("_in", inside).join(sums, [*by, "_g"]).withColumn(name, F.col("_ahead") + F.col("_in")).drop("_g", "_ahead", "_in")


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with sid: their places, from 1, in code-point order, null last."""
    order = F.col("source").asc_nulls_last()
    at = F.monotonically_increasing_id()  # partition, then place in it
    rows = sources.repartitionByRange(order).sortWithinPartitions(order)
    rows = materialize(rows.select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND((1 << 33) - 1).alias("_at")), "mix-numbered")
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.select("_part", _before("_n", Window.orderBy("_part")).alias("_ahead"))  # a row a partition
    return rows.join(F.broadcast(parts), "_part").withColumn("sid", F.col("_ahead") + F.col("_at") + 1).drop("_part", "_at", "_ahead")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, sid, source_size, target, from rows of (source, size).

    Weights go round by the sources' code-point order. A target stops at
    ``max_epochs`` times its source's size; what is above is shared again by weight,
    round by round, until none is above.
    """
    turn = F.array(*[F.lit(w) for w in weights])
    s = numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    s = s.withColumn("weight", F.element_at(turn, (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    s = materialize(s.withColumn("most", F.lit(max_epochs) * F.col("source_size")), "mix-weights")
    dec = "decimal(38,0)"
    total, shares = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left = total
    while True:  # left / shares only grows, so a source that stops stays so
        stops = F.col("most").cast(dec) * F.lit(shares) <= F.lit(left) * F.col("weight").cast(dec)
        sums = s.agg(F.sum(F.when(stops, F.col("most"))), F.sum(F.when(~stops, F.col("weight")))).first()
        now = total - (sums[0] or 0), sums[1] or 0
        if now == (left, shares) or not now[1]:
            break
        left, shares = now
    share = F.lit(left / max(1, shares)) * F.col("weight")
    return s.select("source", "sid", "source_size", F.when(stops, F.col("most").cast("double")).otherwise(share).alias("target"))


def quotas(sources: DataFrame, block_words: int, max_epochs: int, seed: int) -> DataFrame:
    """Adds blocks, words to take, slots, and where the source's slots begin.

    The last slot is cut so that exactly ``words`` words are taken: ``cut_at`` is its
    place among the slots of the last, partial epoch and ``cut_to`` its words.
    """
    b = F.lit(block_words)
    short_len = F.col("source_size") - (F.col("blocks") - 1) * b
    s = (
        sources.filter("source_size > 0")
        .withColumn("blocks", F.ceil(F.col("source_size") / b).cast("long"))
        .withColumn("words", F.least(F.round("target").cast("long"), F.col("source_size") * max_epochs))
        .withColumn("epochs", F.floor(F.col("words") / F.col("source_size")).cast("long"))
        .withColumn("rest", F.col("words") - F.col("epochs") * F.col("source_size"))
        .withColumn("short_len", short_len)
        .withColumn("short_at", permuted(F.col("blocks") - 1, F.col("blocks"), F.col("sid"), F.col("epochs"), F.lit(seed), inverse=True))
        # full slots that fit before the short block is met, then shifted by what it lacks
        .withColumn("lack", F.when(F.col("short_at") * b + F.col("short_len") <= F.col("rest"), b - F.col("short_len")).otherwise(F.lit(0)))
        .withColumn("partial", F.floor((F.col("rest") + F.col("lack")) / b).cast("long"))
        .withColumn("cut_to", F.col("rest") + F.col("lack") - F.col("partial") * b)
        .withColumn("cut_at", F.col("partial"))
        .withColumn("slots", F.col("epochs") * F.col("blocks") + F.col("partial") + (F.col("cut_to") > 0).cast("long"))
    )
    return running(materialize(s, "mix-quotas"), [], ["sid"], "slots", "begins")


def placed(sized: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """One row a document, with sid, source_size, target and ``start``, the words of the
    source before the document. ``sized``: doc_id, source, size, row and copies, a row for
    documents that are alike in all columns. Documents are dealt to groups within their
    source, so one that holds most rows is still summed in parallel."""
    places = max(PLACES, sized.count() // PLACE_ROWS)
    small = sources.select(F.col("source").alias("_s"), "sid", "source_size", "target")
    small = F.broadcast(small) if n_sources <= BROADCAST_SOURCES else small
    d = sized.join(small, sized["source"].eqNullSafe(small["_s"]), "left").drop("_s")
    d = d.withColumn("place", F.pmod(F.xxhash64("doc_id", "row"), F.lit(places))).withColumn("all", F.col("size") * F.col("copies"))
    sums = d.groupBy("sid", "place").agg(F.sum("all").alias("n"))
    ahead = sums.select("sid", "place", _before("n", Window.partitionBy("sid").orderBy("place")).alias("ahead"))
    d = d.withColumn("before", _before("all", Window.partitionBy("sid", "place").orderBy("doc_id", "size", "row")))
    d = d.join(ahead, ["sid", "place"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    d = d.withColumn("start", F.col("ahead") + F.col("before") + (F.col("copy") - 1) * F.col("size"))
    return d.drop("place", "ahead", "before", "all")


def owners(points: DataFrame, intervals: DataFrame, total: int, n_sources: int) -> DataFrame:
    """``points`` (x, from 0 to ``total``) with the sid whose interval (begin, n) x lies in.
    Intervals are found by the cells of equal width that they touch."""
    width = max(1, -(-total // CELLS))
    touched = F.sequence(_div(F.col("begin"), width), _div(F.col("begin") + F.col("n") - 1, width))
    cells = intervals.filter("n > 0").select("sid", "begin", "n", F.explode(touched).alias("cell"))  # CELLS rows and one a source at most
    cells = F.broadcast(cells) if n_sources <= BROADCAST_SOURCES else cells
    hit = points.withColumn("cell", _div(F.col("x"), width)).join(cells, "cell").filter("x >= begin and x < begin + n")
    return hit.drop("cell", "begin", "n")


def shard_counts(quota: DataFrame, slots: int, n_sources: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, sid, n): how many of a shard's slots each source gets, drawn for every shard
    and conditioned on the sources' totals. Stored."""
    spark = quota.sparkSession
    x = F.pmod(F.xxhash64("id", F.lit(seed), F.lit("draw")), F.lit(slots))
    draws = spark.range(0, slots, 1, max(1, min(100_000, slots >> 18))).select(_div(F.col("id"), shard_slots).alias("shard"), x.alias("x"))
    own = quota.select("sid", F.col("begins").alias("begin"), F.col("slots").alias("n"))
    drawn = owners(draws, own, slots, n_sources).groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n"))
    drawn = materialize(drawn, "mix-drawn")

    had = running(drawn, ["sid"], ["shard"], "n", "had").join(quota.select("sid", "slots"), "sid")
    had = had.withColumn("stays", F.greatest(F.lit(0).cast("long"), F.least("n", F.col("slots") - F.col("had"))))
    had = materialize(had.select("shard", "sid", "stays", (F.col("n") - F.col("stays")).alias("over")), "mix-stays")
    lack = quota.join(drawn.groupBy("sid").agg(F.sum("n").alias("got")), "sid", "left")
    lack = lack.select("sid", F.greatest(F.lit(0).cast("long"), F.col("slots") - F.coalesce("got", F.lit(0))).alias("n"))
    lack = materialize(lack, "mix-lack")
    counts = had.filter("stays > 0").select("shard", "sid", F.col("stays").alias("n"))
    moved = lack.agg(F.sum("n")).first()[0] or 0
    if moved:
        over = running(had.filter("over > 0"), [], ["shard", "sid"], "over", "first")
        each = over.select("shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("over") - 1)).alias("i"))
        each = each.select("shard", permuted(F.col("i"), F.lit(moved), F.lit(seed), F.lit("moved")).alias("x"))
        again = owners(each, running(lack, [], ["sid"], "n", "begin"), moved, n_sources)
        counts = counts.union(again.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n"))).groupBy("shard", "sid").agg(F.sum("n").alias("n"))
    return materialize(counts, "mix-counts")


def drawn(quota: DataFrame, n_sources: int, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """One row a slot: shard, place, sid, slot, epoch, block, words (of the block that are
    used). Slots of a source follow the shards' counts; places in a shard are shuffled."""
    total = quota.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]  # a single number
    counts = shard_counts(quota, max(1, total), n_sources, shard_slots, seed)
    ranges = running(counts.filter("n > 0"), ["sid"], ["shard"], "n", "first").join(quota, "sid")
    in_shard = Window.partitionBy("shard")
    ranges = ranges.withColumn("at", _before("n", in_shard.orderBy("sid"))).withColumn("wide", F.sum("n").over(in_shard))
    slots = ranges.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("slot", F.col("first") + F.col("i"))
    epoch, r = _div(F.col("slot"), F.col("blocks")), F.pmod("slot", "blocks")
    block = permuted(F.col("r"), F.col("blocks"), F.col("sid"), F.col("epoch"), F.lit(seed))
    length = F.when(F.col("block") == F.col("blocks") - 1, F.col("short_len")).otherwise(F.lit(block_words))
    cut = (F.col("epoch") == F.col("epochs")) & (F.col("r") == F.col("cut_at"))
    place = F.col("shard") * shard_slots + permuted(F.col("at") + F.col("i"), F.col("wide"), F.col("shard"), F.lit(seed))
    return (
        slots.withColumn("epoch", epoch).withColumn("r", r).withColumn("block", block)
        .select("shard", place.alias("place"), "sid", "slot", "epoch", "block", F.when(cut, F.least(F.col("cut_to"), length)).otherwise(length).cast("long").alias("words"))
    )


def mix(
    docs: DataFrame, *, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS,
    weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 20,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, slots, spans) of the mix of ``docs`` (doc_id, text, source).

    documents: doc_id, source, size, row (a hash of the row), copies (rows that are alike),
    copy, sid, source_size, target, start.
    slots: as of ``drawn``. spans: sid, start, epoch, shard, place, from_word, to_word —
    which words of the document that starts there one slot takes.
    """
    rows = docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), row_hash(docs).alias("row"))
    sized = materialize(rows.groupBy("doc_id", "source", "size", "row").agg(F.count(F.lit(1)).alias("copies")), "mix-sized")
    sources = materialize(targets(sized.select("source", (F.col("size") * F.col("copies")).alias("size")), weights, max_epochs), "mix-sources")
    n_sources = sources.count()
    at = materialize(placed(sized, sources, n_sources), "mix-placed")
    quota = materialize(quotas(sources, block_words, max_epochs, seed), "mix-quota")
    slots = materialize(drawn(quota, n_sources, block_words, shard_slots, seed), "mix-slots")
    pieces = (
        at.filter("size > 0").select("sid", "start", "size")
        .withColumn("block", F.explode(F.sequence(_div(F.col("start"), block_words), _div(F.col("start") + F.col("size") - 1, block_words))))
        .withColumn("lo", F.greatest(F.col("start"), F.col("block") * block_words))
        .withColumn("hi", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words))
    )
    spans = (
        pieces.join(slots.select("sid", "block", "epoch", "words", "shard", "place"), ["sid", "block"])
        .withColumn("hi", F.least("hi", F.col("block") * block_words + F.col("words")))
        .filter("hi > lo")
        .select("sid", "start", "epoch", "shard", "place", (F.col("lo") - F.col("start")).alias("from_word"), (F.col("hi") - F.col("start")).alias("to_word"))
    )
    return at, slots, spans


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])


def taken(at: DataFrame, spans: DataFrame) -> DataFrame:
    """``at`` with the words the mix takes of each document, repeats counted, and the first
    and last shard that holds some."""
    sums = spans.groupBy("sid", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    lookup = at.withColumn("at", F.when(F.col("size") > 0, F.col("start")))
    sums = sums.select(F.col("sid").alias("_sid"), F.col("start").alias("_start"), "taken", "first_shard", "last_shard")
    return lookup.join(sums, (F.col("sid") == F.col("_sid")) & (F.col("at") == F.col("_start")), "left").select(
        *at.columns, F.coalesce("taken", F.lit(0)).alias("taken"), "first_shard", "last_shard"
    )


def mixed_documents(docs: DataFrame, *, shard: str | None = None, **options) -> DataFrame:
    """Documents as the mix repeats and cuts them: a row for every document and epoch
    that takes words of it, with the columns of ``docs`` and, if named, ``shard``: that of
    the first slot, in order of places, that takes words of the row.

    A document taken whole keeps its text as it is; one that is taken in part has the
    taken words, in order, joined by a space. ``n_chars``, if there, follows the text.
    """
    at, _, spans = mix(docs, **options)
    epochs = spans.groupBy("sid", "start", "epoch").agg(
        F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("_spans"),  # at most a document's blocks
        F.sum(F.col("to_word") - F.col("from_word")).alias("_n"),
        F.min_by("shard", "place").alias("_shard"),
    )
    where = at.filter("size > 0").join(epochs, ["sid", "start"])
    where = where.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("size").alias("_size"), "_spans", "_n", "_shard")
    rows = docs.withColumn("_own", row_hash(docs))
    if not at.filter("copies > 1 and size > 0").isEmpty():  # each copy has rows of its own in ``where``
        rows = rows.dropDuplicates(["doc_id", "_own"])
    hit = rows.join(where, rows["doc_id"].eqNullSafe(where["_id"]) & (F.col("_own") == F.col("_row")))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.array_join(
        F.flatten(F.transform("_spans", lambda x: F.slice(words, (x["from_word"] + 1).cast("int"), (x["to_word"] - x["from_word"]).cast("int")))), " "
    )
    out = hit.withColumn("text", F.when(F.col("_n") == F.col("_size"), F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *([F.col("_shard").alias(shard)] if shard else []))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """The mix of ``docs`` as Parquet files that hold the shards in order, column ``shard``."""
    mixed_documents(docs, shard="shard", **options).repartitionByRange("shard").sortWithinPartitions("shard").write.mode("overwrite").parquet(path)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_shard, last_shard of every document."""
    at, _, spans = mix(table(spark, sf_dir, "documents"))
    return taken(at, spans).select("doc_id", "size", "source_size", "target", "taken", "first_shard", "last_shard")
