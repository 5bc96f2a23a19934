"""Mixing sources to target weights: texts are packed into blocks of equal length, source counts are drawn for each
output shard, and a pseudorandom index permutation for each source maps slots to blocks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_WORD, fresh, written

def n_words(text: Column) -> Column:
    """How many words a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_no, source_size, target, n_docs) from (source, size) rows.

    Sources stand in order of code points, null last, and weigh `weights`, repeating. They share `share` times all
    sizes by weight. No target exceeds `most` times its source's size; what is cut goes to the others by weight until
    none is above. In closed form: in order of most * size / weight the first sources are cut, and the others share
    what is left. The windows run over one row for each source.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    own = own.withColumn("source_no", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    own = own.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    own = own.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = W.orderBy("ratio", "source_no").rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy("ratio", "source_no").rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    own = own.withColumn("level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The first source in this order that isn't cut gives the level for all.
    own = own.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return own.select("source", F.col("source_no").cast("int").alias("source_no"), F.col("source_size").cast("long").alias("source_size"), target.alias("target"), "n_docs")


def offsets(rows: DataFrame, per_chunk: int = 2_000) -> DataFrame:
    """rows with `start`, the words before each in its source, in order of a hash of the document.

    Running sums go in two levels, so that a large source isn't summed in one task: within chunks of about per_chunk
    rows, and over the chunks' totals. rows has source_no, n_docs (rows of the source), size, doc, h (a hash of id and text).
    """
    rows = rows.withColumn("chunk", F.pmod("h", F.ceil(F.col("n_docs") / per_chunk)))
    totals = rows.groupBy("source_no", "chunk").agg(F.sum("size").alias("chunk_size"))
    run = W.partitionBy("source_no").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("chunk_start", F.coalesce(F.sum("chunk_size").over(run), F.lit(0)))
    within = W.partitionBy("source_no", "chunk").orderBy("h", "doc", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inner_start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.join(totals.drop("chunk_size"), ["source_no", "chunk"]).withColumn("start", F.col("chunk_start") + F.col("inner_start")).drop("chunk", "chunk_start", "inner_start")


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Where a keyed pseudorandom permutation of 0 .. n - 1 takes x.

    x is written as a row and a column of a rectangle of n cells or a few more, and each is moved along by hashes of
    the other in turn, three times: a Feistel network. A place beyond n is moved again until it falls within. There
    are fewer such places than the rectangle has rows, so that many moves are enough.
    """
    rows = F.ceil(F.sqrt(n)).cast("long")
    columns = F.ceil(n / rows).cast("long")

    def move(v: Column) -> Column:
        row, column = F.call_function("div", v, columns), v % columns
        for i in range(3):
            row = (row + F.pmod(F.xxhash64(*key, F.lit(2 * i), column), rows)) % rows
            column = (column + F.pmod(F.xxhash64(*key, F.lit(2 * i + 1), row), columns)) % columns
        return row * columns + column

    once = move(x)
    return F.when(once < n, once).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), rows), once, lambda at, _: F.when(at < n, at).otherwise(move(at))))


def shard_counts(targets: DataFrame, block: int = 64, shard_words: int = 1 << 20, seed: int = 17) -> DataFrame:
    """(source_no, n_blocks, shard, slot_start, n): how many slots each source has in each output shard.

    A source with B blocks has round(target / mean block length) slots, so at most `most` times B. They are dealt to
    shards of equal shares by independent draws, so a source's counts are a multinomial sample; its total is fixed, where free draws
    for each shard would let it wander. slot_start is the number of the source's slots in earlier shards. Sources
    without words have no slots.
    """
    t = targets.where("source_size > 0 AND target > 0").withColumn("n_blocks", F.ceil(F.col("source_size") / block))
    t = t.withColumn("n_slots", F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long"))
    t = t.withColumn("n_shards", F.ceil(F.sum("target").over(W.partitionBy()) / shard_words))
    # Draws are made in runs of 1,000, dealt over all tasks, so that a large source isn't unrolled in one. The number of
    # partitions is stated: Spark would put the few bytes of runs into one, and that task would unroll them all.
    n = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = t.where("n_slots > 0").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n_slots - 1) div 1000"))))
    draws = runs.repartition(n, "source_no", "run").withColumn("try", F.explode(F.sequence(F.col("run") * 1000, F.least(F.col("run") * 1000 + 999, F.col("n_slots") - 1))))
    counts = draws.groupBy("source_no", "n_blocks", F.pmod(F.xxhash64(F.lit(seed + 1), "source_no", "try"), F.col("n_shards")).alias("shard")).agg(F.count("*").alias("n"))
    counts = written(counts.withColumn("part", F.expr("shard div 1000")), "shard-counts")
    # Running sums in two levels, as of the documents.
    by_part = W.partitionBy("source_no").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = counts.groupBy("source_no", "part").agg(F.sum("n").alias("part_n")).withColumn("part_start", F.coalesce(F.sum("part_n").over(by_part), F.lit(0)))
    within = W.partitionBy("source_no", "part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(parts.drop("part_n"), ["source_no", "part"])
    return counts.select("source_no", "n_blocks", "shard", (F.col("part_start") + F.col("inner")).alias("slot_start"), "n")


def draw(targets: DataFrame, block: int = 64, shard_words: int = 1 << 20, seed: int = 17) -> DataFrame:
    """(source_no, slot, shard, epoch, index): every slot of the mix, with the block it takes.

    Each shard has the next slots of each source, as many as shard_counts drew. Slot j of a source with B blocks takes
    block number p(j mod B) in epoch j div B, p being the source's permutation in that epoch: each epoch takes
    every block once.
    """
    counts = shard_counts(targets, block, shard_words, seed)
    # A shard's slots of one source are unrolled in runs of 1,000, dealt over all tasks (see shard_counts).
    n = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = counts.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div 1000")))).repartition(n, "source_no", "shard", "run")
    slots = runs.withColumn("slot", F.explode(F.sequence(F.col("slot_start") + F.col("run") * 1000, F.col("slot_start") + F.least(F.col("run") * 1000 + 999, F.col("n") - 1))))
    slots = slots.withColumn("epoch", F.expr("slot div n_blocks"))
    return slots.select("source_no", "slot", "shard", "epoch", permuted(F.col("slot") % F.col("n_blocks"), F.col("n_blocks"), F.lit(seed), F.col("source_no"), F.col("epoch")).alias("index"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 64, shard_words: int = 1 << 20, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Two frames: the documents with what the mix takes, and the mix itself.

    Documents: doc_id, source, size, source_no, source_size, target, start, h, taken, first_shard; a row for each row of docs. taken
    counts a document's words in all slots that take a block of it; none exceeds `most` times its size (for a whole
    number), and each source's sum differs from its target by a block or two at most. first_shard is the first output
    shard that has words of it, null if none has.
    The mix: source_no, slot, shard, epoch, index, doc, first, words: which words of which document a slot has.
    Null and empty texts have size 0 and take 0; null is a source of its own, the last. Repeated rows are separate
    documents. An empty table gives two empty frames.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), text).alias("h"))
    rows = written(rows, "mix-sizes")
    targets = written(source_targets(rows, weights, share, most), "mix-targets")
    # Spark sees the size of the written targets, so it broadcasts them only where they are small.
    numbered = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    placed = written(offsets(numbered), "mix-offsets")
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    parts = placed.where("size > 0").select("source_no", "doc", "start", "size", F.explode(F.sequence(first, last)).alias("index"))
    begin = F.greatest(F.col("start"), F.col("index") * block)
    parts = parts.select("source_no", "index", "doc", "start", (begin - F.col("start")).alias("first"), (F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * block) - begin).alias("words"))
    slots = written(draw(targets, block, shard_words, seed), "mix-slots")
    # Spark takes slots for as small as the targets they are unrolled from, and would broadcast them; hence the hints.
    mixed = slots.join(parts.hint("merge"), ["source_no", "index"])
    uses = slots.groupBy("source_no", "index").agg(F.count("*").alias("uses"), F.min("shard").alias("shard"))
    taken = parts.hint("merge").join(uses, ["source_no", "index"]).groupBy("source_no", "start", "doc").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"), F.min("shard").alias("first_shard"))
    taken = taken.toDF("s", "at", "d", "taken", "first_shard")
    # A start belongs to one row with words in each source; rows without words take nothing.
    found = placed.join(taken, (placed["size"] > 0) & (placed["source_no"] == taken["s"]) & (placed["start"] == taken["at"]), "left")
    out = found.select(F.col("doc").alias("doc_id"), "source", "size", "source_no", "source_size", "target", "start", "h", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard")
    return out, mixed


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, **options) -> DataFrame:
    """The documents of which the mix takes words, with all their columns and words_taken, words_target.

    Documents from which the mix takes nothing don't appear. Repeated rows are told apart by an ordinal.
    """
    out, _ = mix(docs, id_col, text_col, seed=seed, **options)
    h, at, taken, target = fresh(docs, "mix_hash", "mix_ordinal", "words_taken", "words_target")
    keyed = docs.withColumn(h, F.xxhash64(F.lit(seed), F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))))
    keyed = keyed.withColumn(at, F.row_number().over(W.partitionBy(id_col, h).orderBy(F.lit(0))))
    side = out.withColumn("n", F.row_number().over(W.partitionBy("doc_id", "h").orderBy("start"))).where("taken > 0")
    side = side.select(F.col("doc_id").alias("d"), F.col("h").alias("s_h"), "n", F.col("taken").alias("s_taken"), F.col("target").alias("s_target"))
    both = keyed.join(side, keyed[id_col].eqNullSafe(side["d"]) & (keyed[h] == side["s_h"]) & (keyed[at] == side["n"]))
    return both.select(*[keyed[c] for c in docs.columns], side["s_taken"].alias(taken), side["s_target"].alias(target))
