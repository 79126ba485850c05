"""Mixing sources to target weights by drawn blocks, on built-in Spark functions alone.

Each source's words, its documents one after another, are packed into blocks of a fixed length.
Output shards of a fixed number of slots draw how many slots each source gets, from a multinomial
distribution. A source's slots, counted through all shards, run through its blocks in a
pseudorandom order, a new one for each pass, and blocks are joined to slots by their index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm.lineage import cut

#: Words of a block, slots of a shard, rounds of the permutation, most passes over a source.
BLOCK, SLOTS, ROUNDS, PASSES = 128, 4096, 6, 3
#: Parts of a source in which its documents are laid out side by side, for each PART_WORDS words of all sources; and cells of the draw's lookup.
PARTS, PART_WORDS, CELLS = 1021, 1 << 33, 1024
#: Shards of one task, and of a stretch of the running sums over shards.
TASK_SHARDS, STRETCH = 8, 1024
WORD = r"[^\x20\x09-\x0D]+"


def _hash(*parts: str) -> str:
    """SQL for 60 hashed bits of a seed and columns."""
    return f"cast(conv(substring(md5(concat_ws(':', {', '.join(parts)})), 1, 15), 16, 10) as bigint)"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, t, size): a hash of each row's text, and its number of words."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"))


def source_targets(size: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, rank, source_size, target, blocks, slots): the words that each source shall give.

    Sources in order of code points, null last, weigh 1, 2, 3 and so on again. They share the
    size of all; none gives more than PASSES times its size, and the excess is shared by weight
    among the others: the water level at which the shares sum up. One row for each source.
    """
    source = size.groupBy("source").agg(F.sum("size").alias("source_size"))
    source = source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    source = source.withColumn("weight", (F.col("rank") - 1) % 3 + 1).withColumn("most", F.col("source_size") * PASSES).withColumn("full_at", F.col("most") / F.col("weight"))
    order = Window.orderBy("full_at", "rank")
    source = source.withColumn("taken", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    source = source.withColumn("weights", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    source = source.withColumn("level", (F.col("total") - F.col("taken")) / F.col("weights"))
    source = source.withColumn("level", F.max(F.expr("case when full_at > level then level end")).over(Window.partitionBy()))
    source = source.withColumn("target", F.expr("case when full_at > level then weight * level else cast(most as double) end"))
    source = source.withColumn("blocks", F.expr(f"cast(ceil(source_size / {block}) as bigint)"))
    return source.select("source", "rank", "source_size", "target", "blocks", F.expr("case when source_size > 0 then cast(floor(target * blocks / source_size + 0.5) as bigint) else 0 end").alias("slots"))


def shard_counts(source: DataFrame, tasks: int, slots: int = SLOTS, seed: int = 0) -> DataFrame:
    """(rank, blocks, shard, first, take): slots that each output shard gives to each source.

    Each slot of a shard draws its source by the sources' shares, which makes a shard's counts
    multinomial. What a source has drawn beyond its slots is given up in the last shards, and
    what it lacks is spread over all shards, so that totals are met exactly. first counts the
    source's slots in the shards before: running sums within stretches of shards and over the
    stretches' totals, so a source's shards, however many, are spread over tasks.
    """
    order = Window.orderBy("rank")
    source = source.withColumn("high", F.sum("slots").over(order)).withColumn("n", F.sum("slots").over(Window.partitionBy()))
    source = source.withColumn("low", F.col("high") - F.col("slots")).withColumn("shards", F.expr(f"cast(ceil(n / {slots}) as bigint)")).withColumn("wide", F.expr(f"n div {CELLS} + 1"))
    cell = source.where("slots > 0").select("rank", "low", "high", F.explode(F.expr("sequence(low div wide, (high - 1) div wide)")).alias("cell"))
    shard = source.groupBy("n", "shards", "wide").count().where("n > 0").select("n", "wide", F.explode(F.expr("sequence(0L, shards - 1)")).alias("shard")).repartition(tasks, "shard")
    slot = shard.select("shard", "wide", "n", F.explode(F.expr(f"sequence(0L, least({slots}L, n - shard * {slots}L) - 1)")).alias("slot"))
    slot = slot.withColumn("u", F.expr(f"{_hash(repr(str(seed)), 'shard', 'slot')} % n")).withColumn("cell", F.expr("u div wide"))
    # a row for each source and cell
    drawn = slot.join(F.broadcast(cell), "cell").where("u >= low and u < high").groupBy("shard", "rank").agg(F.count("*").alias("drawn"))
    grid = source.where("slots > 0").select("rank", "blocks", "slots", "shards", F.explode(F.expr("sequence(0L, shards - 1)")).alias("shard"))
    grid = cut(grid.join(drawn, ["shard", "rank"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).withColumn("stretch", F.expr(f"shard div {STRETCH}")))
    stretch = grid.groupBy("rank", "stretch").agg(F.sum("drawn").alias("sum"))
    along = Window.partitionBy("rank").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretch = stretch.select("rank", "stretch", F.coalesce(F.sum("sum").over(along), F.lit(0)).alias("base"), F.sum("sum").over(Window.partitionBy("rank")).alias("all"))
    within = Window.partitionBy("rank", "stretch").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("within", F.coalesce(F.sum("drawn").over(within), F.lit(0))).join(stretch, ["rank", "stretch"])
    grid = grid.withColumn("seen", F.expr("base + within")).withColumn("lack", F.expr("greatest(0, slots - all)"))
    # what was taken before is what was drawn before, up to the source's slots, and the share of the lack until here
    first, take = F.expr("least(seen, slots) + (lack * shard) div shards"), F.expr("greatest(0, least(drawn, slots - seen)) + (lack * (shard + 1)) div shards - (lack * shard) div shards")
    return grid.select("rank", "blocks", "shard", first.alias("first"), take.alias("take"))


def slot_blocks(counts: DataFrame, tasks: int, seed: int = 0) -> DataFrame:
    """(shard, rank, slot, block): the block that each slot of a source takes.

    In each pass, slots map to blocks by a swap-or-not shuffle of the source's block numbers: in
    each round a number trades places with its mirror image, or not, as a hash of the greater of
    both says. That is a permutation for any number of blocks.
    """
    slot = counts.where("take > 0").repartition(tasks, "rank", "shard").select("shard", "rank", "blocks", F.explode(F.expr("sequence(first, first + take - 1)")).alias("slot"))
    slot = slot.withColumn("pass", F.expr("slot div blocks")).withColumn("x", F.expr("slot % blocks"))
    # folded by lambdas: as nested columns the rounds would double the generated code each
    mirror = f"({_hash(f'concat({seed}, "k", r)', 'rank', 'pass')} % blocks + blocks - a) % blocks"
    trade = f"case when {_hash(f'concat({seed}, "b", r)', 'rank', 'pass', 'greatest(x, y)')} % 2 = 1 then y else x end"
    slot = slot.withColumn("x", F.expr(f"aggregate(sequence(0, {ROUNDS - 1}), x, (a, r) -> aggregate(array({mirror}), a, (x, y) -> {trade}))"))
    return slot.select("shard", "rank", "slot", F.col("x").alias("block"))


def document_blocks(size: DataFrame, source: DataFrame, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """(rank, part, place, doc_id, source, t, size, source_size, target, start, block, words): each row's words in each block.

    A source's documents follow one another by part of doc_id, then doc_id; starts are running
    sums within parts and over the parts' totals, so a source however large is spread over tasks.
    A row without words has one line with a null block.
    """
    own = size.join(source.select(F.col("source").alias("_source"), "rank", "source_size", "target"), size["source"].eqNullSafe(F.col("_source"))).drop("_source")
    own = own.withColumn("part", F.expr(f"coalesce(((doc_id % {parts}) + {parts}) % {parts}, 0)"))
    order = Window.partitionBy("rank", "part").orderBy("doc_id", "size", "t")
    own = own.withColumn("place", F.row_number().over(order)).withColumn("within", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    part = own.groupBy("rank", "part").agg(F.sum("size").alias("all"))
    part = part.withColumn("base", F.coalesce(F.sum("all").over(Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("all")
    own = own.join(part, ["rank", "part"]).withColumn("start", F.expr("base + within")).drop("base", "within")
    own = own.withColumn("block", F.explode_outer(F.expr(f"case when size > 0 then sequence(start div {block}, (start + size - 1) div {block}) end")))
    return own.withColumn("words", F.expr(f"least(start + size, (block + 1) * {block}) - greatest(start, block * {block})"))


@dataclass
class Mix:
    """A mix of sources: slots (shard, rank, slot, block) and pieces, the words of documents in blocks."""

    source: DataFrame
    slots: DataFrame
    pieces: DataFrame
    texts: DataFrame
    block: int = BLOCK

    def taken(self) -> DataFrame:
        """One row for each document: doc_id, source, size, source_size, target, and taken, the words that the mix takes of it."""
        times = self.slots.groupBy("rank", "block").agg(F.count("*").alias("times"))
        # both grow with the input, so neither is ever a broadcast
        own = self.pieces.join(times.hint("merge"), ["rank", "block"], "left")
        return own.groupBy("rank", "part", "place", "doc_id", "source", "size", "source_size", "target").agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).cast("long").alias("taken")).drop("rank", "part", "place")

    def layout(self, seed: int = 0) -> DataFrame:
        """(shard, position, slot, rank, doc_id, first_word, words): what to write where; a shard's slots are in a drawn order."""
        piece = self.pieces.where("words > 0").select("rank", "block", "doc_id", "start", F.expr(f"greatest(start, block * {self.block}) - start").alias("first_word"), "words")
        return self._placed(seed).join(piece.hint("merge"), ["rank", "block"]).select("shard", "position", "slot", "rank", "doc_id", "first_word", "words")

    def _placed(self, seed: int) -> DataFrame:
        """slots with their position in the shard."""
        order = Window.partitionBy("shard").orderBy(F.expr(_hash(repr(f"{seed}o"), "shard", "rank", "slot")), "rank", "slot")
        return self.slots.withColumn("position", F.row_number().over(order))

    def blocks(self, seed: int = 0) -> DataFrame:
        """The mixed text: (shard, position, source, doc_ids, words, text), one row for each slot, its block of words read out.

        The words of a document are set apart by single spaces, those of different documents by
        a newline. A text is read once, for all its pieces that the mix takes; a block is put
        together once, however often it is taken.
        """
        used = self.pieces.where("words > 0").join(self.slots.select("rank", "block").distinct().hint("merge"), ["rank", "block"], "left_semi")
        piece = F.struct("block", F.expr(f"greatest(start, block * {self.block}) - start").alias("first"), "words", "start")
        used = used.groupBy("doc_id", "source", "t", "rank", "part", "place").agg(F.collect_list(piece).alias("pieces"))
        text = self.texts.groupBy("doc_id", "source", "t").agg(F.min("text").alias("text")).select(F.col("doc_id").alias("own_id"), F.col("source").alias("own_source"), F.col("t").alias("own_t"), "text")
        met = used.join(text.hint("merge"), F.col("doc_id").eqNullSafe(F.col("own_id")) & F.col("source").eqNullSafe(F.col("own_source")) & (F.col("t") == F.col("own_t")))
        # the words are worked out once for a text: bound as the only element of an array
        read = F.expr(f"transform(array(regexp_extract_all(text, '{WORD.replace(chr(92), chr(92) * 2)}', 0)), w -> transform(pieces, p -> struct(p.block, p.start, p.words, array_join(slice(w, cast(p.first + 1 as int), cast(p.words as int)), ' ') as text)))[0]")
        piece = met.select("rank", "source", "doc_id", F.explode(read).alias("p")).select("rank", "source", "p.block", F.struct("p.start", "doc_id", "p.words", "p.text").alias("p"))
        block = piece.groupBy("rank", "source", "block").agg(F.array_sort(F.collect_list("p")).alias("p"))
        block = block.select("rank", "source", "block", F.col("p.doc_id").alias("doc_ids"), F.expr("aggregate(p.words, 0L, (a, x) -> a + x)").alias("words"), F.array_join("p.text", "\n").alias("text"))
        return self._placed(seed).join(block.hint("merge"), ["rank", "block"]).select("shard", "position", "source", "doc_ids", "words", "text")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, block: int = BLOCK, slots: int = SLOTS, seed: int = 0) -> Mix:
    """Mix the sources of docs to their targets (see source_targets).

    A null source is a source; a null text has no words. Rows with equal doc_id are separate
    documents; a null doc_id comes first in its source. No document is taken more than PASSES
    times. The result depends on the rows and the seed alone. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"), F.col(text_col).alias("text"))
    size = cut(sizes(docs, id_col, text_col, source_col))
    total = size.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = 1 + total // (block * slots * TASK_SHARDS)
    source = source_targets(size, block)
    found = cut(slot_blocks(shard_counts(source, tasks, slots, seed), tasks, seed))
    return Mix(source, found, document_blocks(size, source, PARTS * (1 + total // PART_WORDS), block), texts, block)
