"""Mixing sources to target weights by pivotal dependent rounding.

Every source wants a number of words; its documents start with the same fractional number of
copies. The whole part is taken as it is. The fractions are rounded in pairs: words move between
two documents at random, without bias, until one of them is integral, so that a source's words
stay what they were. Documents are dealt by source and hash into small groups; each group leaves at
most one fraction, and the fractions combine through a reduction tree, until one document per
source is left to be rounded alone. A source's words thus miss its target by less than one document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import discard, free_name, materialise, python_batches, table

#: Maximal copies, weights by place of the source in order, and the contract's notion of a word.
MOST_COPIES, WEIGHTS, WORD = 3.0, (5.0, 2.0, 1.0), r"[^\x20\x09-\x0D]+"
#: Documents of all sources per hash bucket, and children of a node of the tree.
GROUP_ROWS, FAN_IN = 256, 64


def water_fill(sizes: Sequence[int], weights: Sequence[float], most: float = MOST_COPIES) -> list[float]:
    """Shares of the sum of sizes by weight; a share stops at most times its size, and the excess goes to the others by weight."""
    targets, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > most * sizes[i]]
        for i in over or free:
            targets[i] = most * sizes[i] if over else unit * weights[i]
        left -= sum(targets[i] for i in over)
        free = free.difference(over) if over else set()
    return targets


def _uniform(*parts: int) -> float:
    """A number in [0, 1) that depends on the parts only."""
    x, mask = 0x243F6A8885A308D3, (1 << 64) - 1
    for p in parts:
        x = (x ^ (p & mask)) * 0x9E3779B97F4A7C15 & mask
        x ^= x >> 29
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 32
    return (x >> 11) / (1 << 53)


def pivot(rows: list[list], seed: int, last: bool) -> None:
    """Round the fractions p of rows [key, mass, p] in place, in pairs; all but at most one become 0 or 1, with last all.

    The sum of mass * p stays; every p keeps its expectation.
    """
    held = None
    for row in rows:
        if row[1] <= 0:
            row[2] = 0.0
        if not 0.0 < row[2] < 1.0:
            continue
        if held is None:
            held = row
            continue
        (k, a, p), (j, b, q) = held, row
        gain, loss = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
        if _uniform(seed, k, j) * (gain + loss) < loss:
            p, q = (1.0 if gain == (1 - p) * a else p + gain / a), (0.0 if gain == q * b else q - gain / b)
        else:
            p, q = (0.0 if loss == p * a else p - loss / a), (1.0 if loss == (1 - q) * b else q + loss / b)
        held[2], row[2] = (round(x) if abs(x - round(x)) < 1e-12 else x for x in (p, q))
        if not 0.0 < held[2] < 1.0:
            held = row if 0.0 < row[2] < 1.0 else None
    if last and held is not None:
        held[2] = float(_uniform(seed, held[0]) < held[2])


def _round_groups(df: DataFrame, seed: int, last: bool) -> DataFrame:
    """Pivot within each run of equal (rank, node); df has rank, node, key, mass, p and others, dealt and sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def rounded() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            work = [list(x) for x in zip(*(rows.column(c).to_pylist() for c in ("key", "mass", "p")), strict=True)]
            pivot(work, seed, last)
            at = rows.schema.get_field_index("p")
            return rows.set_column(at, "p", pa.array([float(x[2]) for x in work], pa.float64())).combine_chunks().to_batches()[0]

        for batch in batches:
            marks = list(zip(batch.column("rank").to_pylist(), batch.column("node").to_pylist(), strict=True))
            start = 0
            for i, mark in enumerate(marks):
                if mark != now:
                    if start < i:
                        held.append(batch.slice(start, i - start))
                    if held:
                        yield rounded()
                    held, now, start = [], mark, i
            if start < len(marks):
                held.append(batch.slice(start))
        if held:
            yield rounded()

    return df.repartition("rank", "node").sortWithinPartitions("rank", "node", F.desc("mass"), "key").mapInArrow(run, df.schema)


def targets_of(sources: DataFrame) -> DataFrame:
    """For sources (source, size): also rank (by code point, null last), weight and target; see water_fill. Only sums and counts reach the driver.

    A share is unit * weight; the unit rises from round to round, as sources stop at their bound. So a round needs one number of the one before it.
    """
    spark = sources.sparkSession
    row = F.monotonically_increasing_id()
    ordered = materialise(sources.withColumn("late", F.col("source").isNull()).orderBy("late", "source").withColumn("row", row), "sources")
    part = F.shiftright("row", 33)
    starts, total = [], 0
    for p, n in sorted(tuple(r) for r in ordered.groupBy(part.alias("part")).agg(F.count("*")).collect()):  # a row per task of the sort
        starts.append((p, total))
        total += n
    starts = spark.createDataFrame(starts, "part long, start long")
    rank = (F.col("start") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank")
    ranked = ordered.withColumn("part", part).join(F.broadcast(starts), "part").select("source", "size", rank)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int")))
    unit, stopped = 0.0, -1
    over = lambda u: F.lit(u) * F.col("weight") > MOST_COPIES * F.col("size")
    while True:
        size, free, held, n = ranked.agg(F.sum("size"), F.sum(F.when(~over(unit), F.col("weight"))), F.sum(F.when(over(unit), MOST_COPIES * F.col("size"))), F.count_if(over(unit))).first()
        if n == stopped or not free:
            break
        unit, stopped = ((size or 0) - (held or 0.0)) / free, n
    return ranked.withColumn("target", F.when(over(unit), MOST_COPIES * F.col("size")).otherwise(F.lit(unit) * F.col("weight")).cast("double"))


def _marks(doc_id: str, source: str, text: str | None) -> list[F.Column]:
    """128 bits of a hash of what tells rows apart."""
    known = [F.col(c) for c in (doc_id, source, text) if c]
    known += [c.isNull() for c in known]
    return [F.xxhash64(F.lit(i), *known) for i in (1, 2)]


def mix(docs: DataFrame, doc_id: str, source: str, size: F.Column, text: str | None = None, seed: int = 1) -> DataFrame:
    """Copies of each document so that the sources come to their targets.

    docs: any columns; size: an expression for a row's words. Sources in code point order (null
    last) weigh 5, 2, 1 and so on. Rows need no key: those alike in id, source, size (and text, if it is named) are one decision
    about a number of copies of all of them, which is rounded as a single row's is. A size of 0 gets no extra copy; an
    empty table gives no rows. Returns one row per decision: h1, h2 (its hash), doc_id, source, size, n_rows, source_size, target,
    copies (of its n_rows rows together; each gets as many as another, or one more).
    """
    spark = docs.sparkSession
    python_batches(spark)
    h1, h2 = _marks(doc_id, source, text)
    units = docs.select(h1.alias("h1"), h2.alias("h2"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    units = materialise(units.groupBy("h1", "h2", "doc_id", "source", "size").agg(F.count("*").alias("n_rows")), "units")
    plan = materialise(targets_of(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("size"))).select(F.col("source").alias("s"), "rank", F.col("size").alias("source_size"), "target"), "plan")
    nodes = max(1, -(-units.count() // GROUP_ROWS))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(MOST_COPIES), F.col("target") / F.col("source_size"))).otherwise(0.0)
    df = units.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("want", rate * F.col("n_rows"))
    df = df.withColumns({"whole": F.floor("want").cast("long"), "p": F.col("want") - F.floor("want"), "key": F.xxhash64("h1", "size"), "mass": F.col("size").cast("double")}).drop("want")
    df = df.withColumn("node", F.pmod("key", F.lit(nodes)))
    out, level, open_one = None, 0, (F.col("p") > 0) & (F.col("p") < 1)
    while True:
        done = materialise(_round_groups(df, seed + level, nodes == 1), f"mix{level}")
        settled = done if nodes == 1 else done.where(~open_one)
        out = settled if out is None else out.unionByName(settled)
        if nodes == 1:
            break
        df, nodes, level = done.where(open_one).withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long")), -(-nodes // FAN_IN), level + 1
    discard(units, plan)
    return out.select("h1", "h2", "doc_id", "source", "size", "n_rows", "source_size", "target", (F.col("whole") + F.col("p").cast("long")).alias("copies"))


def mixed(docs: DataFrame, doc_id: str, source: str, text: str, seed: int = 1) -> DataFrame:
    """The rows of docs, each as often as mix() says. Columns stay; their names may be any."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    a, b, i = (free_name(docs, n) for n in ("mark_a", "mark_b", "copy"))
    h1, h2 = _marks(doc_id, source, text)
    chosen = mix(docs, doc_id, source, size, text, seed).where("copies > 0").select(F.col("h1").alias(a), F.col("h2").alias(b), F.struct("copies", "n_rows").alias(i))
    kept = docs.withColumns({a: h1, b: h2}).hint("merge").join(chosen, [a, b])
    # rows alike lie together after the join, so that their numbers need no further shuffle
    number = F.row_number().over(Window.partitionBy(a, b).orderBy(a))
    share = F.floor(F.col(f"{i}.copies") / F.col(f"{i}.n_rows")).cast("long") + (number <= F.col(f"{i}.copies") % F.col(f"{i}.n_rows")).cast("long")
    kept = kept.withColumn(i, share).where(F.col(i) > 0)
    return kept.withColumn(i, F.explode(F.sequence(F.lit(1).cast("long"), F.col(i)))).select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    found = mix(docs, "doc_id", "source", F.regexp_count(F.col("text"), F.lit(WORD)))
    rows = found.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    share = F.floor(F.col("copies") / F.col("n_rows")) + (F.col("row") <= F.col("copies") % F.col("n_rows")).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * share).cast("long").alias("taken"))
