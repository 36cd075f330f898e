"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACE_CLASS, fresh_name, materialize, running_total

#: Weights of the sources in code point order, over and over.
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_repeats: int = 3
) -> DataFrame:
    """Targets of sources from (source, source_size): `share` of all words, dealt by
    weight, none above `max_repeats` times its source's size; what lies above is dealt
    again among the others. That ends at one level per unit of weight: sources are
    capped in the order of cap / weight as long as the level reaches theirs.

    A source without words has the target 0; sources tie only as equals. One row per
    source is all that this handles.
    """
    w = Window.orderBy(F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8"))
    turn = F.pmod(F.row_number().over(w) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double")
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(after)
    # The first source whose level is not above its cap sets the level of all after it.
    s = s.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    final = F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return s.select(
        "source", "source_size", F.coalesce(final * F.col("weight"), F.col("cap")).alias("target")
    )


#: Rows of a range that is sorted in one task, about.
RANGE_ROWS = 8192


def _range_of(key: Column, ranges: int) -> Column:
    """Equal ranges of a hexadecimal key, in its order."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) * F.lit(ranges))


def _finish_range(finish: Column, ranges: int) -> Column:
    """Ranges of finish times, in their order: equal ones up to 2, where nearly all turns
    are that can be taken, and ever wider ones after that."""
    return F.when(finish < 2, F.floor(finish * ranges)).otherwise(2 * ranges + F.floor(F.log2(finish / 2) * ranges))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.0,
    max_repeats: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many words of each document the mix takes.

    Documents of a source are shuffled by a digest of seed and id, and go round up to
    `max_repeats` times. The virtual finish time of a document's turn is the source's
    words up to its end over the source's target. All turns are sorted by finish time
    and taken until the words reach the budget, the sum of targets. Finish times are
    dealt into ranges, as many as the rows ask for, whose sums place
    each range before its rows are sorted: no task holds a source or the whole order.

    Returns id, size, source_size, target, taken (size times turns taken), source per row.
    Null text has size 0, null source is one source, the last. Documents without words
    and sources without a target are taken no times. A null id takes its place of the
    shuffle by its text, repeated rows follow each other. Empty tables give no rows.
    """
    out = _mixed(docs, weights, share, max_repeats, seed, id_col, text_col, source_col)
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("turns")).alias("taken"), F.col("source").alias(source_col)
    )


def _mixed(docs, weights, share, max_repeats, seed, id_col, text_col, source_col) -> DataFrame:
    """(id, t1, source, size, source_size, target, turns) of every row; t1 is a hash of the text."""
    name = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))
    rows = materialize(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
        .select("id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("t1"), F.md5(F.concat(F.lit(f"{seed}:"), name)).alias("key")),
        "sizes",
    )
    sizes = materialize(
        rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("size").alias("largest"), F.count(F.lit(1)).alias("rows")), "sources"
    )
    targets = materialize(source_targets(sizes, weights, share, max_repeats), "targets")
    total = sizes.agg(F.sum("rows").alias("rows"), F.sum("largest").alias("slack")).first()
    ranges = max(64, -(-(total["rows"] or 0) // RANGE_ROWS))
    placed = running_total(rows, "size", _range_of(F.col("key"), ranges), ["key", "id", "size", "t1"], "upto", ["source"])
    t = targets.withColumnRenamed("source", "s")
    placed = materialize(
        placed.join(t, placed["source"].eqNullSafe(t["s"])).drop("s", "key"), "placed"
    )
    # When a turn ends, every other source has had its target but for a document, or more;
    # so a turn that ends that many words beyond its own target is beyond the budget.
    spent = F.col("turn") * F.col("source_size") + F.col("upto")
    turns = (
        placed.filter("size > 0 and target > 0")
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
        .filter(spent <= F.col("target") + float((total["slack"] or 0) + 1))
        .withColumn("finish", spent / F.col("target"))
        .select("id", "t1", "source", "size", "finish", "turn", "upto")
    )
    timed = running_total(
        turns, "size", _finish_range(F.col("finish"), ranges), ["finish", "source", "upto", "id", "turn"], "words",
    )
    budget = targets.agg(F.sum("target").alias("budget"))
    taken = (
        timed.crossJoin(F.broadcast(budget))
        .filter(F.col("words") <= F.col("budget") + 0.5)
        .groupBy("id", "t1", "source", "size", "upto")
        .agg(F.count(F.lit(1)).alias("turns"))
    )
    a, b = placed.alias("a"), taken.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("id", "t1", "source", "size", "upto")]
    joined = a.join(b, same[0] & same[1] & same[2] & same[3] & same[4], "left")
    return joined.select("a.id", "a.t1", "a.source", "a.size", "a.source_size", "a.target", F.coalesce("b.turns", F.lit(0)).alias("turns"))


def mixed_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.0,
    max_repeats: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The documents of the mix, each as often as its turns, with all their columns.

    Texts of a null or repeated id have turns of their own; rows that repeat an id, a
    source and a text have the mean of theirs, rounded.
    """
    key, own, origin, times, turn = (fresh_name(docs, n) for n in ("_mix_id", "_mix_text", "_mix_source", "_turns", "_turn"))
    plan = _mixed(docs, weights, share, max_repeats, seed, id_col, text_col, source_col)
    plan = plan.groupBy(F.col("id").alias(key), F.col("t1").alias(own), F.col("source").alias(origin)).agg(F.round(F.avg("turns")).cast("int").alias(times))
    plan = plan.filter(F.col(times) > 0)
    same = docs[id_col].eqNullSafe(plan[key]) & (F.xxhash64(docs[text_col]) == plan[own]) & docs[source_col].eqNullSafe(plan[origin])
    joined = docs.join(plan, same)
    return joined.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[docs[c] for c in docs.columns])


#: The same mix for DuckDB: md5 order, finish times, one global running sum.
MIX_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1 AS k
  FROM rows GROUP BY source),
caps AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 3.0::DOUBLE AS cap
  FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.0::DOUBLE - coalesce(sum(cap) OVER (
              ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (
              ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM caps),
lowest AS (
  SELECT arg_min(level, cap / weight) AS level, min(cap / weight) AS from_ratio FROM levels WHERE level * weight <= cap),
targets AS (
  SELECT l.source, l.source_size,
         CASE WHEN l.cap / l.weight >= w.from_ratio THEN w.level * l.weight ELSE l.cap END AS target
  FROM levels l LEFT JOIN lowest w ON true),
placed AS (
  SELECT r.*, t.source_size, t.target,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
turns AS (
  SELECT p.*, turn, (turn * source_size + upto) / target AS finish
  FROM placed p, range(3) AS x(turn) WHERE size > 0 AND target > 0),
timed AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source, upto, doc_id, turn ROWS UNBOUNDED PRECEDING) AS words FROM turns),
taken AS (
  SELECT doc_id, source, upto, count(*) AS turns FROM timed
  WHERE words <= (SELECT sum(target) FROM targets) + 0.5 GROUP BY ALL)
SELECT p.doc_id, p.size, p.source_size, round(p.target, 6) AS target,
       CAST(p.size * coalesce(t.turns, 0) AS BIGINT) AS taken, p.source
FROM placed p LEFT JOIN taken t ON p.doc_id IS NOT DISTINCT FROM t.doc_id
  AND p.source IS NOT DISTINCT FROM t.source AND p.upto = t.upto
"""
