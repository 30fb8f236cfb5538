"""Training pairs: unify, check, shuffle, draw by weight and batch without repeats."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semdrift.operators.skew import lookup_join, number_rows, number_within
from semdrift.session import write_and_read


def unify_record(line: Column) -> Column:
    """Texts of a JSON record that is a list of texts or has one under ``texts``; NULL otherwise."""
    listed = F.when(line.rlike(r"^\s*\["), F.from_json(line, "array<string>"))
    keyed = F.when(line.rlike(r"^\s*\{"), F.from_json(line, "texts array<string>")["texts"])
    return F.coalesce(listed, keyed)


def response_context(line: Column) -> Column:
    """[response, context] of a record that has both; NULL otherwise."""
    record = F.from_json(line, "response string, context string")
    both = record["response"].isNotNull() & record["context"].isNotNull()
    return F.when(both, F.array(record["response"], record["context"]))


def check_arity(samples: DataFrame, allowed: tuple[int, ...] = (2, 3)) -> tuple[DataFrame, DataFrame]:
    """(per dataset: arity and verdict, samples that break their dataset's arity).

    The arity of a dataset is its most frequent one (the smaller on ties).
    """
    sized = samples.withColumn("arity", F.size("texts"))
    counts = sized.groupBy("dataset", "arity").agg(F.count(F.lit(1)).alias("n"))
    chosen = counts.groupBy("dataset").agg(
        F.min_by("arity", F.struct(-F.col("n"), "arity")).alias("common"),
        F.count(F.lit(1)).alias("n_arities"), F.sum("n").alias("n"),
    )
    verdict = chosen.withColumn("ok", (F.col("n_arities") == 1) & F.col("common").isin(*allowed))
    judged = sized.join(F.broadcast(chosen.select("dataset", "common")), "dataset")  # one row per listed dataset
    wrong = (F.col("arity") != F.col("common")) | ~F.col("arity").isin(*allowed)
    return verdict, judged.filter(wrong).drop("common")


@dataclass(frozen=True)
class BatchPlan:
    """Sizes of a global batch; they must divide."""

    batch_size: int = 64
    workers: int = 8
    datasets_per_batch: int = 2

    def __post_init__(self) -> None:
        if min(self.batch_size, self.workers, self.datasets_per_batch) < 1:
            raise ValueError("sizes must be positive")
        if self.global_size % self.datasets_per_batch:
            raise ValueError("the global batch must be divisible by the datasets per batch")
        if self.per_dataset % self.batch_size:
            raise ValueError("a dataset's share must be whole worker batches")

    @property
    def global_size(self) -> int:
        return self.batch_size * self.workers

    @property
    def per_dataset(self) -> int:
        return self.global_size // self.datasets_per_batch


def hash_unit(*parts: Column) -> Column:
    """Repeatable number in [0, 1) from the md5 of the parts."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def epoch_order(*parts: Column) -> Column:
    """Sort key of a seeded shuffle."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def shuffled(samples: DataFrame, id_col: str, seed: int, epoch: int = 0) -> DataFrame:
    """Adds ``ord``: 1-based position of every sample inside its dataset in this epoch."""
    key = epoch_order(F.lit(seed), F.lit(epoch), F.col(id_col))
    return number_within(samples.withColumn("_key", key), "dataset", [F.col("_key"), F.col(id_col)], "ord").drop("_key")


def _pick(unit: Column, choices: list[tuple[str, int]]) -> Column:
    """Dataset whose share of the summed weights holds ``unit``."""
    total = float(sum(w for _, w in choices))
    picked, above = F.lit(choices[-1][0]), total
    for at in range(len(choices) - 2, -1, -1):
        above -= choices[at + 1][1]
        picked = F.when(unit * total < above, F.lit(choices[at][0])).otherwise(picked)
    return picked


def draw_datasets(batch_ids: DataFrame, weights: list[tuple[str, int, int]], per_batch: int, seed: int) -> DataFrame:
    """(batch, draw, dataset): weighted draws with replacement.

    ``weights`` lists (dataset, weight, arity): the configuration. The first
    draw of a batch fixes the arity; later ones choose among datasets with it.
    """
    weights = sorted(weights)
    arities = {name: arity for name, _, arity in weights}
    unit = hash_unit(F.lit(seed), F.col("batch"), F.col("draw"))
    first = _pick(hash_unit(F.lit(seed), F.col("batch"), F.lit(0)), [(n, w) for n, w, _ in weights])
    arity_of = F.create_map(*[F.lit(x) for pair in arities.items() for x in pair])
    later = F.lit(None).cast("string")
    for arity in sorted(set(arities.values())):
        same = [(n, w) for n, w, a in weights if a == arity]
        later = F.when(F.col("_arity") == arity, _pick(unit, same)).otherwise(later)
    draws = batch_ids.select("batch", first.alias("_first")).withColumn(
        "draw", F.explode(F.sequence(F.lit(0), F.lit(per_batch - 1)))
    ).withColumn("_arity", arity_of[F.col("_first")])
    return draws.select("batch", "draw", F.when(F.col("draw") == 0, F.col("_first")).otherwise(later).alias("dataset"))


def weighted_sample(samples: DataFrame, id_col: str, weights: list[tuple[str, int, int]], plan: BatchPlan,
                    n_batches: int, seed: int = 42) -> DataFrame:
    """(batch, draw, slot, dataset, id): drawn datasets hand out their shuffled samples in order, round and round."""
    spark = samples.sparkSession
    batches = spark.range(n_batches).select(F.col("id").alias("batch"))
    draws = draw_datasets(batches, weights, plan.datasets_per_batch, seed)
    turns = number_within(draws, "dataset", [F.col("batch"), F.col("draw")], "turn")
    slots = turns.select(
        "batch", "draw", "dataset", "turn", F.explode(F.sequence(F.lit(0), F.lit(plan.per_dataset - 1))).alias("slot")
    )
    ordered = shuffled(samples.select("dataset", id_col), id_col, seed)
    counts = samples.groupBy("dataset").agg(F.count(F.lit(1)).alias("_n"))  # one row per dataset
    asked = slots.join(F.broadcast(counts), "dataset").withColumn(
        "ord", ((F.col("turn") - 1) * plan.per_dataset + F.col("slot")) % F.col("_n") + 1
    ).withColumn("_row", F.struct("batch", "draw", "slot"))
    return lookup_join(asked, ordered, ["dataset", "ord"], "_row", "inner").select("batch", "draw", "slot", "dataset", id_col)


def _first_come(placed: DataFrame, id_col: str) -> DataFrame:
    """Ids of samples none of whose texts occurs earlier in their batch; a batch is bounded by its size."""
    texts = placed.select("batch", id_col, "pos", F.explode(F.array_distinct("texts")).alias("text"))
    earlier = Window.partitionBy("batch", F.md5("text"), "text").orderBy("pos", id_col)
    ranked = texts.withColumn("_nth", F.row_number().over(earlier))
    return ranked.groupBy("batch", id_col).agg(F.max("_nth").alias("_worst")).filter(F.col("_worst") == 1).select("batch", id_col)


#: Below this share of accepted offers the rounds turn from offers at random to offers of places known to fit.
FEW_ACCEPTED = 0.1


def _marks(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each different text of a sample, by its md5."""
    return rows.select(*columns, F.explode(F.array_distinct("texts")).alias("_t")).select(*columns, F.md5("_t").alias("mark"))


def _at_random(waiting: DataFrame, rooms: DataFrame, turn: int) -> DataFrame:
    """(use, batch): every waiting sample is offered one room of its dataset."""
    sizes = rooms.groupBy("dataset").agg(F.count(F.lit(1)).alias("_r"))  # one row per dataset
    at = F.pmod(F.xxhash64("use", F.lit(turn)), F.col("_r"))
    return waiting.join(F.broadcast(sizes), "dataset").withColumn("idx", at).join(rooms, ["dataset", "idx"]).select("use", "batch")


def _where_it_fits(waiting: DataFrame, rooms: DataFrame, held: DataFrame) -> DataFrame:
    """(use, batch): for every waiting sample that fits anywhere a room that holds none of its texts.

    Texts that all rooms of a dataset hold, fewer than one batch has,
    rule their samples out at once. For the others the rooms that hold a text of the sample are
    counted off from a start of its own; the first number missing is its offer.
    """
    sizes = F.broadcast(rooms.groupBy("dataset").agg(F.count(F.lit(1)).alias("_r")))  # one row per dataset
    blocks = write_and_read(held.join(rooms.select("batch", "dataset", "idx"), "batch").select("dataset", "mark", "idx"), "batch-blocks")
    everywhere = blocks.groupBy("dataset", "mark").agg(F.count(F.lit(1)).alias("_n")).join(sizes, "dataset").filter("_n = _r")
    marks = _marks(waiting, "use", "dataset")
    out = marks.join(F.broadcast(everywhere.select("dataset", "mark")), ["dataset", "mark"], "left_semi").select("use").distinct()
    left = waiting.join(out, "use", "left_anti").join(sizes, "dataset").select("use", "dataset", "_r")
    left = write_and_read(left.withColumn("_from", F.pmod(F.xxhash64("use"), F.col("_r"))), "batch-open")
    blocked = marks.join(left, ["use", "dataset"]).join(blocks, ["dataset", "mark"])
    blocked = blocked.select("use", F.pmod(F.col("idx") - F.col("_from"), F.col("_r")).alias("_at")).distinct()
    counted = blocked.withColumn("_nth", F.row_number().over(Window.partitionBy("use").orderBy("_at")) - 1)
    gaps = counted.groupBy("use").agg(
        F.coalesce(F.min(F.when(F.col("_at") != F.col("_nth"), F.col("_nth"))), F.count(F.lit(1))).alias("_gap")
    )
    offers = left.join(gaps, "use", "left").withColumn("_gap", F.coalesce("_gap", F.lit(0))).filter(F.col("_gap") < F.col("_r"))
    offers = offers.withColumn("idx", F.pmod(F.col("_gap") + F.col("_from"), F.col("_r")))
    return offers.join(rooms, ["dataset", "idx"]).select("use", "batch")


def fill_batches(uses: DataFrame, capacity: DataFrame) -> DataFrame:
    """(use, batch): batches in which no text occurs twice, filled until no waiting sample fits any place left.

    ``uses`` has (use, dataset, texts, pos, batch): samples with the batch
    they are meant for, or NULL; ``capacity`` has (batch, dataset, places). First every batch keeps, in the order of
    ``pos``, what repeats none of its texts. Then rounds: each waiting sample is offered a batch
    with room for its dataset; a batch accepts, in order, offers that repeat none of its texts or of an earlier offer, one for each
    place. Rounds end when no sample fits any room: every one that still waits
    (batch NULL) shares a text with each batch that has room for its dataset.
    """
    rows = write_and_read(uses.select("use", "dataset", "texts", "pos", "batch"), "batch-uses")
    kept = _first_come(rows.filter("batch IS NOT NULL"), "use")
    placed = write_and_read(rows.select("use", "dataset", "batch").join(kept, ["batch", "use"]).select("use", "dataset", "batch"), "batch-placed")
    waiting = write_and_read(rows.drop("batch").join(placed.select("use"), "use", "left_anti"), "batch-waiting")
    held = write_and_read(_marks(rows.join(placed.select("use"), "use", "left_semi"), "batch"), "batch-texts")
    parts, turn, exact = [placed], 0, False
    by_dataset = Window.partitionBy("dataset").orderBy("batch")  # rooms: one row for a batch and dataset
    taken = placed.groupBy("batch", "dataset").agg(F.count(F.lit(1)).alias("taken"))
    room = F.col("places") - F.coalesce("taken", F.lit(0))
    rooms = capacity.join(taken, ["batch", "dataset"], "left").select("batch", "dataset", room.alias("room")).filter("room > 0")
    while True:
        n_waiting = waiting.count()
        rooms = write_and_read(rooms.withColumn("idx", F.row_number().over(by_dataset) - 1), "batch-rooms")
        if not n_waiting or rooms.isEmpty():
            break
        turn += 1
        held = write_and_read(held.join(rooms.select("batch").distinct(), "batch", "left_semi"), "batch-texts")
        offers = write_and_read(_where_it_fits(waiting, rooms, held) if exact else _at_random(waiting, rooms, turn), "batch-offers")
        if exact and offers.isEmpty():
            break
        offered = offers.join(waiting, "use")
        if not exact:
            repeated = _marks(offered, "use", "batch").join(held, ["batch", "mark"], "left_semi").select("use").distinct()
            offered = offered.join(repeated, "use", "left_anti")
        first = offered.join(_first_come(offered, "use"), ["batch", "use"]).join(rooms.select("batch", "dataset", "room"), ["batch", "dataset"])
        nth = F.row_number().over(Window.partitionBy("batch", "dataset").orderBy("pos", "use"))
        accepted = first.withColumn("_nth", nth).filter(F.col("_nth") <= F.col("room"))
        accepted = write_and_read(accepted.select("use", "dataset", "batch"), "batch-accepted")
        n = accepted.count()
        exact = exact or n < FEW_ACCEPTED * n_waiting
        if not n:
            continue
        parts.append(accepted)
        held = held.unionByName(_marks(waiting.join(accepted.select("use", "batch"), "use"), "batch"))
        waiting = write_and_read(waiting.join(accepted.select("use"), "use", "left_anti"), "batch-waiting")
        more = accepted.groupBy("batch", "dataset").agg(F.count(F.lit(1)).alias("more"))
        rooms = rooms.join(more, ["batch", "dataset"], "left").select(
            "batch", "dataset", (F.col("room") - F.coalesce("more", F.lit(0))).alias("room")
        ).filter("room > 0")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.select("use", "batch").unionByName(waiting.select("use", F.lit(None).cast("bigint").alias("batch")))


def unique_batches(ordered: DataFrame, id_col: str, size: int) -> DataFrame:
    """(id, batch, complete): batches of ``size`` in which no text occurs twice.

    ``ordered`` has (id, texts, row_no): the order is cut into batches, and
    :func:`fill_batches` finds other ones for samples that repeat a text. Those that fit nowhere keep a NULL batch, as
    samples passed over in this epoch: no sample is lost.
    """
    cut_to = F.floor((F.col("row_no") - 1) / size).cast("bigint")
    rows = ordered.select(F.col("row_no").alias("use"), F.lit("").alias("dataset"), "texts", F.col("row_no").alias("pos"), cut_to.alias("batch"), id_col)
    rows = write_and_read(rows, "batch-ordered")
    capacity = rows.select("batch", "dataset", F.lit(size).alias("places")).distinct()
    found = fill_batches(rows.drop(id_col), capacity)
    sizes = found.groupBy("batch").agg((F.count(F.lit(1)) == size).alias("complete"))
    return found.join(rows.select("use", id_col), "use").join(sizes, "batch", "left").select(
        id_col, "batch", F.coalesce("complete", F.lit(False)).alias("complete")
    )


def batch_capacity(spark: SparkSession, weights: list[tuple[str, int, int]], plan: BatchPlan, n_batches: int, seed: int = 42) -> DataFrame:
    """(batch, dataset, places): what the weighted draws ask of every batch."""
    draws = draw_datasets(spark.range(n_batches).select(F.col("id").alias("batch")), weights, plan.datasets_per_batch, seed)
    return draws.groupBy("batch", "dataset").agg((F.count(F.lit(1)) * plan.per_dataset).alias("places"))


def training_batches(samples: DataFrame, id_col: str, weights: list[tuple[str, int, int]], plan: BatchPlan,
                     n_batches: int, seed: int = 42) -> DataFrame:
    """(use, batch, dataset, id): batches over weighted draws, of one arity each, in which no text occurs twice.

    The draws of :func:`weighted_sample` come first; samples that were not
    drawn wait behind them, so a place stays free only if no sample of its dataset fits. A sample drawn again in a
    later round of its dataset is another use of it. Uses without a batch are passed over.
    """
    drawn = weighted_sample(samples, id_col, weights, plan, n_batches, seed)
    drawn = write_and_read(drawn.select("batch", "dataset", id_col, "draw", "slot"), "batch-draws")
    place = (F.col("batch") * plan.datasets_per_batch + F.col("draw")) * plan.per_dataset + F.col("slot")
    meant = drawn.select(place.alias("use"), "dataset", F.col(id_col), place.alias("pos"), "batch")
    behind = n_batches * plan.global_size
    known = [n for n, _, _ in weights]
    rest = samples.filter(F.col("dataset").isin(known)).select("dataset", id_col).join(drawn.select("dataset", id_col), ["dataset", id_col], "left_anti")
    rest = number_rows(rest.withColumn("_key", epoch_order(F.lit(seed), F.lit("rest"), F.col(id_col))), [F.col("_key"), F.col("dataset"), F.col(id_col)], "_no")
    rest = rest.select((F.col("_no") + behind).alias("use"), "dataset", F.col(id_col), (F.col("_no") + behind).alias("pos"), F.lit(None).cast("bigint").alias("batch"))
    uses = write_and_read(meant.unionByName(rest).join(samples.select("dataset", id_col, "texts"), ["dataset", id_col]), "batch-meant")
    found = fill_batches(uses.drop(id_col), batch_capacity(samples.sparkSession, weights, plan, n_batches, seed))
    return found.join(uses.select("use", "dataset", id_col), "use").select("use", "batch", "dataset", id_col)


def batch_faults(batches: DataFrame, samples: DataFrame, id_col: str, capacity: DataFrame) -> DataFrame:
    """(batch, places, over, arities, repeats, fitting): for each batch its places, members beyond them, arities, texts that
    occur twice, and samples without a batch that share no text with it though it has a free place for their dataset.

    A check by the definition, apart from the rounds that fill batches.
    """
    rows = write_and_read(batches.join(samples.select("dataset", id_col, "texts"), ["dataset", id_col]), "batch-checked")
    members, waiting = rows.filter("batch IS NOT NULL"), rows.filter("batch IS NULL")
    marks = _marks(members, "batch", "use")
    repeats = marks.groupBy("batch", "mark").count().groupBy("batch").agg(F.count_if(F.col("count") > 1).alias("repeats"))
    arities = members.groupBy("batch").agg(F.count_distinct(F.size("texts")).alias("arities"))
    filled = capacity.join(members.groupBy("batch", "dataset").agg(F.count(F.lit(1)).alias("n")), ["batch", "dataset"], "full")
    filled = filled.select("batch", "dataset", F.coalesce("places", F.lit(0)).alias("places"), F.coalesce("n", F.lit(0)).alias("n"))
    sizes = filled.groupBy("batch").agg(F.sum("places").alias("places"), F.sum(F.greatest(F.col("n") - F.col("places"), F.lit(0))).alias("over"))
    # Samples that wait for the dataset of a short batch, less those that share a text with it.
    short = filled.filter("n < places").select("batch", "dataset")
    wait = short.join(waiting.groupBy("dataset").agg(F.count(F.lit(1)).alias("wait")), "dataset").groupBy("batch").agg(F.sum("wait").alias("wait"))
    there = marks.select("batch", "mark").distinct().join(short, "batch")
    shared = _marks(waiting, "use", "dataset").join(there, ["dataset", "mark"]).groupBy("batch").agg(F.count_distinct("use").alias("shared"))
    out = sizes.join(arities, "batch", "left").join(repeats, "batch", "left").join(wait, "batch", "left").join(shared, "batch", "left")
    whole = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("places", "over", "arities", "repeats")]
    fitting = (F.coalesce("wait", F.lit(0)) - F.coalesce("shared", F.lit(0))).cast("bigint").alias("fitting")
    return out.select("batch", *whole, fitting)


def use_faults(batches: DataFrame, samples: DataFrame, id_col: str, capacity: DataFrame) -> DataFrame:
    """(use, dataset, id, repeats, fitting): for each use its texts that its batch holds twice and, if it has no batch, the
    batches that have a free place for its dataset and share no text with it.

    The same check as :func:`batch_faults`, use by use: a use that is lost is missed here.
    """
    rows = write_and_read(batches.join(samples.select("dataset", id_col, "texts"), ["dataset", id_col], "left"), "uses-checked")
    members, waiting = rows.filter("batch IS NOT NULL"), rows.filter("batch IS NULL")
    marks = write_and_read(_marks(members, "batch", "use"), "uses-marks")
    twice = marks.groupBy("batch", "mark").count().filter("count > 1").select("batch", "mark")
    repeats = marks.join(twice, ["batch", "mark"]).groupBy("use").agg(F.count(F.lit(1)).alias("repeats"))
    filled = capacity.join(members.groupBy("batch", "dataset").agg(F.count(F.lit(1)).alias("n")), ["batch", "dataset"], "left")
    short = filled.filter(F.coalesce("n", F.lit(0)) < F.col("places")).select("batch", "dataset")
    free = short.groupBy("dataset").agg(F.count(F.lit(1)).alias("free"))  # one row per dataset
    there = marks.select("batch", "mark").distinct().join(short, "batch")
    shared = _marks(waiting, "use", "dataset").join(there, ["dataset", "mark"]).groupBy("use").agg(F.count_distinct("batch").alias("shared"))
    out = rows.join(F.broadcast(free), "dataset", "left").join(shared, "use", "left").join(repeats, "use", "left")
    fits = F.when(F.col("batch").isNull(), F.coalesce("free", F.lit(0)) - F.coalesce("shared", F.lit(0))).otherwise(0)
    return out.select(F.col("use").cast("bigint").alias("use"), "dataset", id_col, F.coalesce("repeats", F.lit(0)).cast("bigint").alias("repeats"),
                      fits.cast("bigint").alias("fitting"))
