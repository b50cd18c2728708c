"""Mix sources to target weights, by fixed-length blocks. Only DataFrame functions are used.

Each source's words are packed into blocks; shards of output slots draw a
source per slot; a source's slots walk through pseudorandom permutations of
its block indices, one permutation per epoch; slots meet blocks by index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelstream.llm.common import WHITE, WORD, fixed_splits, from_files, stash, text_or_empty, unused


def word_count(column: str = "text") -> Column:
    """How many words the text has (null: 0)."""
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Add rank, weight and target to one row per source (source, source_size).

    Targets share the total by weight. A source stops at max_epochs times its
    size and the excess is shared again by weight until none is above. With
    sources in order of size / weight, those capped are the first ones, and the
    water level is what is left over the weights left. Sources sort by code
    point, null last. A corpus has few sources beside its documents; this table
    has one small row for each, and nothing else is ordered globally.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(cycle, F.col("rank") % len(weights) + 1).cast("double"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    cap = F.col("source_size") * max_epochs
    total, weight_sum = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    capped_before = F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight_before = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = F.greatest(total - capped_before, F.lit(0)) / (weight_sum - weight_before)
    levelled = ranked.withColumn("level", level).withColumn("is_capped", cap < F.col("level") * F.col("weight"))
    open_level = F.max(F.when(~F.col("is_capped"), F.col("level"))).over(everything)
    target = F.when(F.col("is_capped"), cap.cast("double")).otherwise(open_level * F.col("weight"))
    return levelled.withColumn("target", F.least(target, cap.cast("double"))).drop("level", "is_capped")


def permuted(index: Column, size: Column, key: Column, rounds: int = 4, walks: int = 64) -> Column:
    """A keyed pseudorandom permutation of 0..size-1 at index.

    A Feistel network over a grid of about the square root of size a side, with
    cycle walking for the few cells beyond size. A walk of up to `walks` steps
    is exact while a side is at most that long; beyond, the chance of a longer
    walk is under (1 / walks) ** walks, and it ends at its start.
    """
    side = F.ceil(F.sqrt(size.cast("double"))).cast("long")
    other = F.ceil(size / side).cast("long")

    def left(k: int):
        return lambda p: F.struct(((p["l"] + F.pmod(F.xxhash64(p["r"], key, F.lit(k)), side)) % side).alias("l"), p["r"].alias("r"))

    def right(k: int):
        return lambda p: F.struct(p["l"].alias("l"), ((p["r"] + F.pmod(F.xxhash64(p["l"], key, F.lit(k)), other)) % other).alias("r"))

    def step(x: Column) -> Column:
        pairs = F.array(F.struct((x % side).alias("l"), F.floor(x / side).cast("long").alias("r")))
        for k in range(rounds):  # each turn is bound by transform, so that it is computed once
            pairs = F.transform(pairs, left(k) if k % 2 == 0 else right(k))
        return F.element_at(F.transform(pairs, lambda p: p["l"] + p["r"] * side), 1)

    first = step(index)
    walked = F.when(first < size, first).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.lit(walks)), first, lambda x, _: F.when(x < size, x).otherwise(step(x)))
    )
    return F.when(walked < size, walked).otherwise(index)


@dataclass(frozen=True)
class Mixture:
    """A drawn mixture.

    slots: shard, slot, source, epoch, block: the mixture in output order.
    documents: one row per row of docs: doc_id, source, size, source_size,
    target, taken (the words that the mixture takes of it, repeats counted).
    pieces: row, doc_id, size, offset, words, draws: the part of each row of docs (row is its place there) in
    each of its blocks, and how often the mixture takes it.
    """

    slots: DataFrame
    documents: DataFrame
    pieces: DataFrame


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, block_words: int = 64, shard_slots: int = 65536, pack_docs: int = 4096, seed: int = 17) -> Mixture:
    """Draw a mixture of docs (doc_id, text, source).

    Every slot draws its source independently, so a shard's counts are
    multinomial. The total per source is then made exact: slots drawn beyond a
    source's share are handed, in order, to sources that got too few, as the
    bound of max_epochs and a small corpus leave no room for chance. A source
    with J slots over B blocks uses each block J // B times or once more.

    Hot sources: documents pack into groups of about pack_docs by a hash of
    their id, so that no window holds a source's documents; windows over packs
    or shards hold a row for thousands of documents or slots each. Null texts
    have no words; a null source is a source of its own, the last; rows that
    repeat a doc_id count one by one; extra columns are ignored. Without any
    words nothing is drawn and all is 0.
    """
    rows = stash(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size")), "mix-rows")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = stash(source_targets(sources, weights, max_epochs), "mix-targets")

    of_source = targets.select(F.col("source").alias("_source"), "rank", "n_docs", "source_size", "target")
    keyed = rows.join(of_source, rows["source"].eqNullSafe(of_source["_source"])).drop("_source")
    keyed = keyed.withColumn("pack", F.pmod(F.xxhash64("doc_id", "size"), 1 + F.floor(F.col("n_docs") / pack_docs).cast("long")))

    packs = keyed.groupBy("rank", "pack").agg(F.ceil(F.sum("size") / block_words).cast("long").alias("blocks"))
    in_source = Window.partitionBy("rank").orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)
    packs = packs.select("rank", "pack", "blocks", F.coalesce(F.sum("blocks").over(in_source), F.lit(0)).alias("base"))
    packs = stash(packs, "mix-packs")

    blocks = packs.groupBy("rank").agg(F.sum("blocks").alias("n_blocks"))
    wanted = F.least(F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")), F.col("n_blocks") * max_epochs).cast("long")
    shares = targets.join(blocks, "rank").where("source_size > 0").select("rank", "source", "n_blocks", wanted.alias("wanted"))
    in_order = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumn("low", F.coalesce(F.sum("wanted").over(in_order), F.lit(0)))
    shares = stash(shares.withColumn("n_slots", F.sum("wanted").over(Window.partitionBy())), "mix-shares")

    slots = _drawn_slots(shares, shard_slots, seed)
    epoch = F.floor(F.col("turn") / F.col("n_blocks")).cast("long")
    slots = slots.select("shard", "slot", "rank", "source", "turn", "n_blocks", epoch.alias("epoch"))
    slots = slots.withColumn("block", permuted(F.col("turn") % F.col("n_blocks"), F.col("n_blocks"), F.xxhash64(F.lit(seed), "rank", "epoch")))

    in_pack = Window.partitionBy("rank", "pack").orderBy("doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.where("size > 0").withColumn("start", F.sum("size").over(in_pack) - F.col("size"))
    placed = placed.join(packs.select("rank", "pack", "base").hint("merge"), ["rank", "pack"])
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = placed.select("rank", "pack", "start", "row", "doc_id", "source", "size", "source_size", "target", "base", F.explode(F.sequence(first, last)).alias("local"))
    end = F.least(F.col("start") + F.col("size"), (F.col("local") + 1) * block_words)
    words = end - F.greatest(F.col("start"), F.col("local") * block_words)
    pieces = pieces.withColumn("words", words).withColumn("block", F.col("base") + F.col("local"))

    draws = slots.groupBy("rank", "block").agg(F.count("*").alias("draws"))
    met = pieces.join(draws.hint("merge"), ["rank", "block"], "left").withColumn("draws", F.coalesce("draws", F.lit(0)))
    taken = met.groupBy("rank", "pack", "start", "row", "doc_id", "source", "size", "source_size", "target").agg(F.sum(F.col("words") * F.col("draws")).alias("taken"))
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    empty = keyed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    offset = F.greatest(F.col("local") * block_words - F.col("start"), F.lit(0))
    return Mixture(
        slots.select("shard", "slot", "source", "epoch", "block"),
        taken.select(columns).unionByName(empty.select(columns)),
        met.select("row", "doc_id", "size", offset.alias("offset"), "words", "draws"),
    )


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mixture as documents, with the columns of docs.

    A document gives a row for each time that any of its pieces is taken: the
    first with the pieces taken at least once, the second with those taken twice
    or more, and so on; text joins their words by one space and n_chars, if
    there, counts its characters. What the mixture does not take, and documents
    without words, give none. Rows that repeat a doc_id, or have none, are mixed
    each by itself, a null source is a source of its own, and an empty table
    gives none. docs is read twice and rows are told apart by their place in it:
    what does not come from files is written first, and what joins or groups
    rows of files is the caller's to write.
    """
    fixed_splits(docs.sparkSession)
    docs = from_files(docs)
    pieces = mix(docs, **parameters).pieces.where("draws > 0")
    taken = pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("offset", "words", "draws"))).alias("pieces"), F.max("draws").alias("most"))
    # all that is worked with goes into columns of new names, so that no column of docs clashes
    mine, row, place = unused("mine", docs.columns), unused("row", docs.columns), unused("place", docs.columns)
    taken = taken.select(F.struct("row", "pieces", "most").alias(mine))
    placed = docs.withColumn(place, F.monotonically_increasing_id())
    joined = placed.join(taken.hint("merge"), placed[place] == taken[mine]["row"]).withColumn(row, F.explode(F.sequence(F.lit(1).cast("long"), F.col(mine)["most"])))
    words = F.split(F.trim(F.regexp_replace("text", WHITE + "+", " ")), " ", -1)
    chosen = F.filter(F.col(mine)["pieces"], lambda p: p["draws"] >= F.col(row))

    def cut(w: Column) -> Column:
        return F.array_join(F.transform(chosen, lambda p: F.array_join(F.slice(w, (p["offset"] + 1).cast("int"), p["words"].cast("int")), " ")), " ")

    # the words are bound by transform, or the planner would put their split into the lambda and run it for each piece
    mixed = joined.withColumn("text", F.element_at(F.transform(F.array(words), cut), 1))
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed.select(docs.columns)


def _drawn_slots(shares: DataFrame, shard_slots: int, seed: int, cells: int = 1024) -> DataFrame:
    """shard, slot, rank, source, n_blocks, turn: who fills each slot, and how manyth of its source it is."""
    shards = shares.select("n_slots").distinct().where("n_slots > 0")
    shards = shards.select("n_slots", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_slots") - 1) / shard_slots))).alias("shard"))
    # a number, as Spark would put these few short rows, which many slots come from, into one task
    shards = shards.repartition(int(shares.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")
    last = F.least(F.col("n_slots"), (F.col("shard") + 1) * shard_slots) - 1
    slots = shards.select("n_slots", "shard", F.explode(F.sequence(F.col("shard") * shard_slots, last)).alias("slot"))
    slots = slots.withColumn("point", F.pmod(F.xxhash64(F.lit(seed), "slot"), F.col("n_slots")))
    cell = F.floor(F.col("point").cast("double") * cells / F.col("n_slots")).cast("long")

    # a source's interval of points is found by an equi-join on the cells it touches; the joins from here on are
    # told to merge, as the planner sizes exploded slots by the one row that they come from
    owners = shares.where("wanted > 0").withColumn("high", F.col("low") + F.col("wanted"))
    touched = F.sequence(F.floor(F.col("low").cast("double") * cells / F.col("n_slots")).cast("long"), F.floor((F.col("high") - 1).cast("double") * cells / F.col("n_slots")).cast("long"))
    owners = owners.select("rank", "source", "n_blocks", "wanted", "low", "high", F.explode(touched).alias("cell"))
    few = shares.count() < 50_000  # then the owners of cells are under 50,000 + cells short rows
    drawn = slots.withColumn("cell", cell).join(F.broadcast(owners) if few else owners.hint("merge"), "cell").where("point >= low and point < high")
    drawn = drawn.select("shard", "slot", "rank", "source", "n_blocks", "wanted")

    per_shard = drawn.groupBy("rank", "shard").agg(F.count("*").alias("n"))
    by_shard = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    per_shard = stash(per_shard.select("rank", "shard", "n", F.coalesce(F.sum("n").over(by_shard), F.lit(0)).alias("before")), "mix-shards")
    in_shard = Window.partitionBy("rank", "shard").orderBy("slot")
    turned = drawn.withColumn("turn", F.row_number().over(in_shard) - 1)
    turned = turned.join(per_shard.select("rank", "shard", "before").hint("merge"), ["rank", "shard"]).withColumn("turn", F.col("turn") + F.col("before"))

    got = shares.join(per_shard.groupBy("rank").agg(F.sum("n").alias("got")), "rank", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    in_order = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    got = got.select(
        "rank", "source", "n_blocks", "wanted", "got",
        F.coalesce(F.sum(F.greatest(F.col("got") - F.col("wanted"), F.lit(0))).over(in_order), F.lit(0)).alias("over_before"),
        F.coalesce(F.sum(F.greatest(F.col("wanted") - F.col("got"), F.lit(0))).over(in_order), F.lit(0)).alias("short_before"),
    )
    short = got.where("got < wanted").select("rank", "source", "n_blocks", "got", "short_before", F.explode(F.expr("sequence(got, wanted - 1)")).alias("turn"))
    short = short.select("rank", "source", "n_blocks", "turn", (F.col("short_before") + F.col("turn") - F.col("got")).alias("hand"))
    over = turned.where("turn >= wanted").join(got.select("rank", "over_before").hint("merge"), "rank")
    over = over.select("shard", "slot", (F.col("over_before") + F.col("turn") - F.col("wanted")).alias("hand"))
    columns = ["shard", "slot", "rank", "source", "n_blocks", "turn"]
    return turned.where("turn < wanted").select(columns).unionByName(over.join(short.hint("merge"), "hand").select(columns))
