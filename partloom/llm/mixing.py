"""Mix sources to target weights. DataFrame functions only.

Each source's documents form one stream of words, cut into blocks of `block` words. A source's target gives it n slots.
Every output shard draws how many slots of each source it holds: each of the n slots falls on one of the shards, so the
counts of a source over the shards are a multinomial draw whose total is n. A shard's slots of a source are a run of the
source's slot numbers. Slot j of round e = j div blocks takes block perm(j mod blocks), where perm is a pseudorandom
permutation of the source's block numbers that differs by round, so a block is taken floor or ceil of n / blocks times
and no document more than the ceiling.

The permutation is a Feistel network on numbers (left, right) with left < a and right < b, a * b just above the number of
blocks; a result beyond the blocks goes through it again until it is a block (cycle walking).

Targets: the sources in code point order (null last) weigh 5, 2, 1, 5, 2, 1, ...; they share the total size by weight,
no target exceeds three times its source's size, and what is above goes to the others by weight until none is above. The
sources, one row each, are ranked in one task.

Defined results: a null text has size 0; a document of size 0 is taken 0 times; an empty table gives an empty result;
rows that repeat are separate documents of their own (their order in the stream is by text hash). Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partloom.llm.common import WORD, cut, parallelism

WEIGHTS = (5, 2, 1)
#: Words in a block, slots that one task lists at a time, output shards, documents in a bucket (about) that cuts a
#: source's stream for the running sums.
BLOCK, CHUNK, SHARDS, BUCKET = 64, 4096, 64, 1024
#: A prime below 2**31, so that products of remainders fit 64 bits. Fifth powers permute its remainders.
PRIME = (1 << 31) - 1
#: Seeds of the draws and of the four steps of the network.
DRAW, STEPS = (40503, 77711), (15731, 78923, 37649, 59221)
CEILING = 3


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """sid, source, source_size, target. sources: source, source_size; one row a source, so small beside the documents.

    Capped sources are those with the least size per weight, so the fixpoint of "cap, reshare, repeat" is found in one
    pass: in that order, a source is capped while its ceiling lies below the share that the rest would give it.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("sid", F.row_number().over(by_name))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1)
    ranked = ranked.withColumns({"weight": weight.cast("long"), "most": F.col("source_size") * ceiling})
    order = W.orderBy(F.col("most") / F.col("weight"), "sid")
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    ranked = ranked.withColumn("level", left.cast("double") / F.sum("weight").over(rest))
    ranked = ranked.withColumn("capped", F.col("weight") * F.col("level") > F.col("most"))
    level = F.min(F.when(~F.col("capped"), F.struct((F.col("most") / F.col("weight")).alias("o"), F.col("sid").alias("s"), F.col("level").alias("level")))).over(everything)["level"]
    return ranked.select("sid", "source", "source_size", F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.col("weight") * level).alias("target"))


def _placed(docs: DataFrame, block: int, once: bool) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in the source's stream, and sources with targets and slots. No text travels."""
    sized = docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long").alias("luck"),
        _tie().alias("tie"),
    )
    sized = cut(sized.dropDuplicates(["doc_id", "tie"]) if once else sized)
    sized = sized.withColumn("bucket", F.col("luck") % (1 + sized.count() // BUCKET))
    sums = cut(sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    plan = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    plan = plan.withColumn("blocks", F.ceil(F.col("source_size") / block))
    plan = plan.withColumn("slots", F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + F.lit(0.5))).otherwise(0).cast("long"))
    plan = cut(plan)
    starts = sums.withColumn("start", F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket")) - F.col("bucket_size"))
    starts = starts.join(plan, starts["source"].eqNullSafe(plan["source"])).select(starts["source"].alias("of"), F.col("bucket").alias("in_bucket"), "start", "sid", "source_size", "target")
    inside = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = sized.withColumn("inside", inside).join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in_bucket")))
    return placed.select("doc_id", "tie", "size", "sid", "source_size", "target", (F.col("start") + F.col("inside")).alias("offset")), plan


def _tie() -> Column:
    return F.md5(F.concat(F.coalesce("text", F.lit("")), F.lit("|"), F.coalesce("source", F.lit(""))))


def _fifth_power(df: DataFrame, x: Column) -> DataFrame:
    """df with p, the fifth power of x modulo PRIME. Each step is a column, so that none is computed twice."""
    df = df.withColumn("p1", x % PRIME).withColumn("p2", F.col("p1") * F.col("p1") % PRIME)
    return df.withColumn("p", F.col("p2") * F.col("p2") % PRIME * F.col("p1") % PRIME).drop("p1", "p2")


def _listed(rows: DataFrame, first: str, n: str) -> DataFrame:
    """A row with its slot for each of the n slots from first on; the rows are spread over all tasks first."""
    chunks = rows.where(F.col(n) > 0).withColumn("chunk", F.explode(F.expr(f"sequence(0L, ({n} - 1) div {CHUNK})"))).repartition(parallelism(rows.sparkSession), "sid", first, "chunk")
    return chunks.withColumn("slot", F.explode(F.expr(f"sequence({first} + chunk * {CHUNK}, {first} + least({n}, (chunk + 1) * {CHUNK}) - 1)"))).drop("chunk")


def shard_counts(plan: DataFrame, shards: int = SHARDS) -> DataFrame:
    """sid, shard, start, n: how many slots of each source each output shard draws, and the first of them."""
    slots = _listed(plan.select("sid", F.lit(0).cast("long").alias("zero"), "slots"), "zero", "slots")
    drawn = _fifth_power(slots, F.col("slot") % PRIME + F.col("sid") * DRAW[0])
    drawn = _fifth_power(drawn.withColumnRenamed("p", "q"), F.col("q") + F.expr(f"slot div {PRIME}") + DRAW[1])
    counts = drawn.groupBy("sid", (F.col("p") % shards).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    # As many rows in a window as there are output shards.
    return counts.withColumn("start", F.sum("n").over(W.partitionBy("sid").orderBy("shard")) - F.col("n"))


def _network(df: DataFrame, x: Column) -> DataFrame:
    """df with `to`, where the permutation of the row's source and turn (sid, turn, blocks) takes x in one pass."""
    a = F.ceil(F.sqrt(F.col("blocks").cast("double"))).cast("long")
    df = df.withColumn("a", a).withColumn("b", F.expr("(blocks + a - 1) div a")).withColumn("x", x)
    df = df.withColumns({"left": F.expr("x div b"), "right": F.expr("x % b")}).drop("x")
    for i, seed in enumerate(STEPS):
        mine, other, size = ("left", "right", "a") if i % 2 == 0 else ("right", "left", "b")
        df = _fifth_power(df, F.col(other) + F.col("sid") * 7919 + F.col("turn") * 104729 + seed)
        df = df.withColumn(mine, (F.col(mine) + F.col("p")) % F.col(size))
    return df.withColumn("to", F.col("left") * F.col("b") + F.col("right")).drop("left", "right", "p")


def _walk() -> Column:
    """Passes of the network from `to` on until it is a block; those are rare, as a * b - blocks is less than a.

    A cycle has at most a numbers that aren't blocks, and each is left with a chance of nearly 1 where a is large.
    """
    let = lambda value, f: F.transform(F.array(value), f)[0]
    fifth = lambda v: let(v % PRIME, lambda p1: let(p1 * p1 % PRIME, lambda p2: p2 * p2 % PRIME * p1 % PRIME))
    key = F.col("sid") * 7919 + F.col("turn") * 104729

    def once(x: Column) -> Column:
        def step(state: Column, i: int) -> Column:
            left, right = state["l"], state["r"]
            if i % 2 == 0:
                left = (left + fifth(right + key + STEPS[i])) % F.col("a")
            else:
                right = (right + fifth(left + key + STEPS[i])) % F.col("b")
            pair = F.struct(left.alias("l"), right.alias("r"))
            return let(pair, lambda s: step(s, i + 1)) if i + 1 < len(STEPS) else let(pair, lambda s: s["l"] * F.col("b") + s["r"])

        start = F.struct(((x - x % F.col("b")) / F.col("b")).cast("long").alias("l"), (x % F.col("b")).alias("r"))
        return let(start, lambda s: step(s, 0))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.col("to"), lambda x, _: F.when(x < F.col("blocks"), x).otherwise(once(x)))
    return F.when(F.col("to") < F.col("blocks"), F.col("to")).otherwise(end)


def _taken_blocks(plan: DataFrame, shards: int) -> DataFrame:
    """sid, block, round, shard, slot: one row for every slot.

    A table, as the optimizer takes long over a join on the permutation's columns.
    """
    held = cut(shard_counts(plan, shards)).join(plan.select("sid", "blocks"), "sid")
    slots = _listed(held, "start", "n").withColumn("turn", F.expr("slot div blocks"))
    return cut(_network(slots, F.col("slot") % F.col("blocks")).select("sid", _walk().alias("block"), F.col("turn").alias("round"), "shard", "slot"))


def _pieces(placed: DataFrame, block: int, *more: str) -> DataFrame:
    """What each document has in each block: its words first .. first + words - 1."""
    each = placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(offset div {block}, (offset + size - 1) div {block})")))
    low, high = F.greatest("offset", F.col("block") * block), F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block)
    return each.select("sid", "offset", "block", *more, (low - F.col("offset")).alias("first"), (high - low).alias("words"))


def taken(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_shard for every row of docs (doc_id, text, source). first_shard is
    the first output shard that holds words of the row, -1 if none does."""
    placed, plan = _placed(docs, block, once=False)
    placed = cut(placed)
    times = _taken_blocks(plan, shards).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"), F.min("shard").alias("shard"))
    words = _pieces(placed, block).join(times.hint("merge"), ["sid", "block"])
    words = words.groupBy("sid", "offset").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.min("shard").alias("first_shard"))
    words = words.select(F.col("sid").alias("w_sid"), F.col("offset").alias("w_offset"), "taken", "first_shard")
    out = placed.join(words, (F.col("size") > 0) & (F.col("sid") == F.col("w_sid")) & (F.col("offset") == F.col("w_offset")), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("first_shard", F.lit(-1)).cast("long").alias("first_shard"))


def shard_rows(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """What each output shard holds: shard, sid, slot, doc_id, first, words, a row for each piece of a document in a slot."""
    placed, plan = _placed(docs, block, once=False)
    return _pieces(cut(placed), block, "doc_id").join(_taken_blocks(plan, shards).hint("merge"), ["sid", "block"]).select("shard", "sid", "slot", "doc_id", "first", "words")


def mixed_rows(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """The mix as documents with the columns of docs: the stretches taken of each document, each a row of its own.

    Blocks of a document that follow each other and are taken in one round make one stretch: the text from its first word
    to the end of its last as it stands, with all that lies between. A document taken whole keeps its text to the ends. A
    document of which nothing is taken goes, one taken in n rounds has at least n rows. Rows that repeat doc_id, text and
    source count once here and share their outcome. n_chars, if there is one, counts the stretch.
    """
    placed, plan = _placed(docs, block, once=True)
    placed = cut(placed)
    got = _pieces(placed, block).join(_taken_blocks(plan, shards).hint("merge"), ["sid", "block"])
    got = got.groupBy("sid", "offset", "round").agg(F.array_sort(F.collect_list(F.struct("first", "words"))).alias("runs"))
    no_run = F.array().cast("array<struct<first:bigint,words:bigint>>")

    def grow(done: Column, piece: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["first"].alias("first"), (last["words"] + piece["words"]).alias("words"))
        meets = F.when(F.size(done) > 0, last["first"] + last["words"] == piece["first"]).otherwise(F.lit(False))
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(piece)))

    got = got.groupBy("sid", "offset").agg(F.flatten(F.collect_list(F.aggregate("runs", no_run, grow))).alias("runs"))  # rounds number 3 at most
    chosen = placed.where("size > 0").join(got, ["sid", "offset"]).select(F.col("doc_id").alias("id"), F.col("tie").alias("t"), F.col("size").alias("all_words"), "runs")
    named = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text = F.col(named["text"])
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()], _tie().alias("tie"))
    rows = rows.join(chosen, F.col(named["doc_id"]).eqNullSafe(F.col("id")) & (F.col("tie") == F.col("t")))
    # Words with the white space behind them; a text that begins with white space has an empty word before the first.
    rows = rows.withColumn("words", F.when(F.exists("runs", lambda r: r["words"] < F.col("all_words")), F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")))
    rows = rows.withColumn("before", F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0))

    def stretch(r: Column) -> Column:
        some = F.array_join(F.slice("words", (r["first"] + 1 + F.col("before")).cast("int"), r["words"].cast("int")), "")
        return F.when(r["words"] == F.col("all_words"), text).otherwise(F.regexp_replace(some, r"[\x20\x09-\x0D]+\z", ""))

    rows = rows.withColumn("body", F.explode(F.transform("runs", stretch)))
    out = {c: F.col(n) for c, n in named.items()} | {"text": F.col("body")}
    if "n_chars" in out:
        out["n_chars"] = F.length("body").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[v.alias(c) for c, v in out.items()])
