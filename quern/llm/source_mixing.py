"""Mixing sources to target weights by temperature, realised as budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import text_of, written

#: ASCII white space separates words.
WORD = r"[^ \t\n\x0B\f\r]+"
KEY_HEX = 15  # hexadecimal digits of a row's place in a permutation: 60 bits
STEPS = 50


@dataclass
class Mix:
    """exponent: of the token shares; turns: how often each source is used, in epochs of its own rows."""

    exponent: float
    weights: dict[str | None, float]
    turns: dict[str | None, float]


def temper(tokens: dict[str | None, int], repetition: float | None = 2.0, entropy: float | None = None) -> Mix:
    """Weights proportional to token share ** exponent; exponent 1 keeps the shares, 0 makes all sources equal.

    The exponent is found by bisection as the flattest mix that keeps to both limits given: no source is used more
    than `repetition` times as often as the least used one, which is used once; and the entropy of the weights, as a part of that of
    equal weights, is at most `entropy`. Sources without tokens are used once and have weight 0.
    """
    known = sorted(((s, n) for s, n in tokens.items() if n > 0), key=lambda x: (x[0] is not None, x[0] or ""))
    total = sum(n for _, n in known)
    logs = {s: math.log(n / total) for s, n in known}

    def weights(exponent: float) -> dict[str | None, float]:
        raw = {s: math.exp(exponent * x) for s, x in logs.items()}
        whole = sum(raw.values())
        return {s: x / whole for s, x in raw.items()}

    def fits(exponent: float) -> bool:
        spread = math.exp((1 - exponent) * (max(logs.values()) - min(logs.values())))
        w = weights(exponent)
        even = -sum(x * math.log(x) for x in w.values() if x > 0) / math.log(len(w)) if len(w) > 1 else 0.0
        return (repetition is None or spread <= repetition) and (entropy is None or even <= entropy)

    low, high = 0.0, 1.0
    if known and not fits(low):
        for _ in range(STEPS):
            middle = (low + high) / 2
            low, high = (low, middle) if fits(middle) else (middle, high)
        low = high
    exponent = round(low, 9) if known else 1.0
    mixed = weights(exponent) if known else {}
    most = max(logs.values(), default=0.0)
    turns = {s: round(math.exp((exponent - 1) * (x - most)), 6) for s, x in logs.items()}
    return Mix(exponent, {s: mixed.get(s, 0.0) for s in tokens}, {s: turns.get(s, 1.0) for s in tokens})


def key_of(doc_id: Column, epoch: Column) -> Column:
    """A row's place in its source's permutation of an epoch: leading bits of a digest of its id and the epoch."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), epoch.cast("string")).cast("binary")), 1, KEY_HEX), 16, 10).cast("long")


def mix(
    docs: DataFrame, repetition: float | None = 2.0, entropy: float | None = None, block_tokens: int = 1 << 20, most_sources: int = 100_000,
    mixed_blocks: int = 64, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Every use of every row: row (a struct of all columns of docs), n_tokens, epoch, mix_block, weight.

    Token counts (words) of all rows give the shares, temper() the weights. The budget of a source is its turns times
    its tokens: whole epochs, then part of one more. An epoch is a permutation of the source's rows by a keyed digest;
    the last one is cut where its budget ends. To find the cut, tokens are summed by blocks of consecutive keys (about
    block_tokens each), then row by row in the one block where the budget ends, so no source is ever gathered in one
    task. The cut is one key a source, so texts are not shuffled: they meet only the table of sources, which is
    broadcast and has most_sources rows at most (beyond that a ValueError says so). Every row is used at least once.
    mix_block deals the uses of every source evenly over mixed_blocks blocks, so that each block has the target mix.

    A null source is a source of its own; null texts have no tokens; null ids share one key. Rows with equal keys are
    taken or left together, so repeated rows are used equally often.
    """
    spark = docs.sparkSession
    whole = docs.select(
        F.struct("*").alias("row"), F.col(source_col).alias("source"), F.col(id_col).cast("string").alias("id"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("n_tokens"),
    )
    counted = written(whole.select("source", "id", "n_tokens"), "mix-tokens")
    totals = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).limit(most_sources + 1).collect()
    if len(totals) > most_sources:
        raise ValueError(f"more than {most_sources} sources: give a coarser source column")
    plan = temper({r.source: r.tokens for r in totals}, repetition, entropy)
    span = 16**KEY_HEX
    lines = []
    for r in totals:
        epochs = int(plan.turns[r.source])
        part = math.floor((plan.turns[r.source] - epochs) * r.tokens)
        lines.append((r.source, plan.weights[r.source], plan.turns[r.source], epochs, part, span // max(1, -(-r.tokens // block_tokens)) + 1))
    sources = spark.createDataFrame(lines, "name string, weight double, turns double, epochs int, part long, block_keys long")
    keyed = (
        counted.join(F.broadcast(sources.filter("part > 0")), F.col("source").eqNullSafe(F.col("name")))
        .withColumn("key", key_of(F.col("id"), F.col("epochs")))
        .withColumn("block", F.expr("key div block_keys"))
    )
    run = Window.partitionBy("name").orderBy("block")
    ends = keyed.groupBy("name", "block", "part").agg(F.sum("n_tokens").alias("tokens")).withColumn("until", F.sum("tokens").over(run))
    last = ends.filter("until - tokens <= part AND until > part").select(
        F.col("name").alias("last_name"), F.col("block").alias("last_block"), (F.col("until") - F.col("tokens")).alias("before")
    )
    inside = keyed.join(F.broadcast(last), F.col("name").eqNullSafe(F.col("last_name")) & (F.col("block") == F.col("last_block")))
    by_key = inside.groupBy("name", "part", "before", "key").agg(F.sum("n_tokens").alias("tokens"))
    until = F.col("before") + F.sum("tokens").over(Window.partitionBy("name").orderBy("key"))
    cuts = by_key.withColumn("until", until).filter("until > part").groupBy(F.col("name").alias("cut_name")).agg(F.min("key").alias("cut"))
    cut_sources = sources.join(F.broadcast(cuts), F.col("name").eqNullSafe(F.col("cut_name")), "left")

    chosen = whole.join(F.broadcast(cut_sources), F.col("source").eqNullSafe(F.col("name")), "left")
    more = F.coalesce((key_of(F.col("id"), F.col("epochs")) < F.col("cut")).cast("int"), F.lit(0))
    uses = chosen.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.coalesce("epochs", F.lit(1)) + more - 1)))
    place = (F.col("epoch") + key_of(F.col("id"), F.col("epoch")) / F.lit(float(span))) / F.col("turns")
    block = F.least(F.floor(place * mixed_blocks), F.lit(mixed_blocks - 1)).cast("int")
    return uses.select("row", "n_tokens", "epoch", block.alias("mix_block"), F.round("weight", 6).alias("weight"))


ORACLE = f"""
WITH counted AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS n_tokens FROM documents),
totals AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM counted GROUP BY 1),
shares AS (SELECT source, tokens, ln(tokens::DOUBLE / sum(tokens) OVER ()) AS x FROM totals WHERE tokens > 0),
tempered AS (SELECT *, CASE WHEN max(x) OVER () > min(x) OVER () THEN round(greatest(0, 1 - ln(2::DOUBLE) / (max(x) OVER () - min(x) OVER ())), 9) ELSE 0 END AS a, max(x) OVER () AS most FROM shares),
weighed AS (SELECT source, tokens, round(exp((a - 1) * (x - most)), 6) AS turns, exp(a * x) / sum(exp(a * x)) OVER () AS weight FROM tempered),
sources AS (
  SELECT source, tokens, coalesce(turns, 1) AS turns, coalesce(weight, 0) AS weight, floor(coalesce(turns, 1))::INT AS epochs,
         floor((coalesce(turns, 1) - floor(coalesce(turns, 1))) * tokens)::BIGINT AS part
  FROM totals LEFT JOIN weighed USING (source, tokens)),
keyed AS (SELECT c.*, s.turns, s.weight, s.epochs, s.part, ('0x' || md5(doc_id || ':' || s.epochs)[:{KEY_HEX}])::BIGINT AS key FROM counted c JOIN sources s USING (source)),
until AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY key) AS u FROM keyed),
uses AS (SELECT *, unnest(range(epochs + CASE WHEN u <= part THEN 1 ELSE 0 END)) AS epoch FROM until)
SELECT doc_id, source, n_tokens, epoch::INT AS epoch, round(weight, 6) AS weight,
       least(floor((epoch + ('0x' || md5(doc_id || ':' || epoch)[:{KEY_HEX}])::BIGINT / {float(16**KEY_HEX)}::DOUBLE) / turns * 64), 63)::INT AS mix_block
FROM uses
"""
