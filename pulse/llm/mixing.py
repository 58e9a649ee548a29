"""Temperature mixing of sources by budgeted block permutations (operator 3).

Source i with share p_i of all tokens gets weight p_i ** a, normalised. The exponent a
is bisected: as flat a mixture as the repetition limit allows, but no flatter than a
target entropy asks for. The budget is the least one at which no source loses a
document, unless one is given. A source's budget is then spent on whole passes over its
documents and one pass that ends early: the source is cut into hashed blocks, the
blocks are put in random order, and documents are taken from them until the budget is met.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.llm.ordered import numbered
from pulse.llm.tokens import token_ids
from pulse.session import new_folder

#: Rows that a block has on average.
ROWS = 2048
#: Values of the exponent that one pass over the sources tries at once.
GRID = 32
MAX_BROADCAST_ROWS = 200_000


def _bisect(sources: DataFrame, meets, rounds: int = 3) -> float:
    """The least exponent of 0 to 1 for which the aggregate `meets(exponent)` holds; it must hold for all greater ones."""
    low, high = 0.0, 1.0
    for _ in range(rounds):
        grid = [low + (high - low) * k / GRID for k in range(GRID + 1)]
        met = sources.agg(*(meets(a).alias(f"m{k}") for k, a in enumerate(grid))).first()
        first = next((k for k in range(GRID + 1) if met[k]), GRID)
        low, high = grid[max(0, first - 1)], grid[first]
        if first == 0:
            return grid[0]
    return high


def mixture(sizes: DataFrame, max_repeats: float, target_entropy: float | None = None, budget: float | None = None) -> tuple[DataFrame, float, float]:
    """Sources (source, tokens, rows) with their weight and repeats; the exponent; the budget in tokens."""
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    sources = sizes.filter("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    scale: Column = F.col("share")

    def entropy(a: float) -> Column:
        # -sum(w log w) with w = p^a / Z is log Z - a * sum(p^a log p) / Z.
        z = F.sum(F.pow(scale, F.lit(a)))
        return F.log(z) - a * F.sum(F.pow(scale, F.lit(a)) * F.log(scale)) / z

    def within(a: float) -> Column:
        if budget is None:
            return F.pow(F.max(scale) / F.min(scale), F.lit(1 - a)) <= max_repeats
        return F.lit(budget / max(total, 1)) * F.max(F.pow(scale, F.lit(a - 1))) / F.sum(F.pow(scale, F.lit(a))) <= max_repeats

    exponent = _bisect(sources, within)
    if target_entropy is not None:
        # Entropy falls with the exponent: go on to the greatest one that still has the target.
        falls = _bisect(sources, lambda a: entropy(a) < target_entropy)
        exponent = max(exponent, falls)
    z, least = sources.agg(F.sum(F.pow(scale, F.lit(exponent))), F.max(F.pow(scale, F.lit(1 - exponent)))).first()
    if budget is None:
        budget = total * (least or 0.0) * (z or 0.0)
    weight = F.pow(scale, F.lit(exponent)) / F.lit(z or 1.0)
    mixed = sources.withColumn("weight", weight).withColumn("repeats", weight * F.lit(float(budget)) / F.col("tokens"))
    return mixed, exponent, float(budget)


def stored(df: DataFrame, name: str) -> DataFrame:
    folder = new_folder(df.sparkSession, f"mixing-{name}")
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def sized_join(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a stored table to the rows: broadcast up to a counted bound, by shuffle beyond."""
    return rows.join(F.broadcast(table) if table.count() <= MAX_BROADCAST_ROWS else table, on, how)


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, longer by underscores until `docs` has no such column."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def counted(docs: DataFrame, column: str, vocabulary: str = "word_bpe_49k.json", end: int = 1, keep: list[str] | None = None) -> DataFrame:
    """`docs` (all columns, or those of `keep`), stored, with the number of ids of `text` and its end id as `column`. A null text is the end id alone."""
    names = docs.columns if keep is None else keep

    def count(batches):
        for batch in batches:
            _, ends = token_ids(batch.column("text"), vocabulary, end)
            sizes = pa.array(ends[1:] - ends[:-1], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), sizes], [*names, column])

    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(column, T.LongType())])
    return stored(docs.mapInArrow(count, schema), "counted")


def mix(
    docs: DataFrame,
    tokens: str,
    key: str = "doc_id",
    source: str = "source",
    max_repeats: float = 1.5,
    target_entropy: float | None = None,
    budget: float | None = None,
    seed: int = 11,
    columns: tuple[str, ...] = ("_slot", "_pass"),
) -> DataFrame:
    """`docs`, each row as often as its source's budget asks, with all columns and those that `columns` names.

    `tokens` names the column of a row's size; rows of size 0 or null come once a pass
    at no cost. A null source is a source of its own. Ascending slot (0 to 1) deals all
    sources out evenly in random order; pass counts 1, 2, ...; a third name gets the source's
    weight, null for a source without tokens. Rows are told apart by `key` and, where keys are equal or null, by a hash
    of all their columns; rows that are equal throughout share a place. Without a budget every
    row comes at least once. An empty table gives none. Names of `docs` clash with nothing,
    but a name of `columns` that `docs` has is refused.
    """
    clash = set(columns) & set(docs.columns)
    if clash:
        raise ValueError(f"columns that the table has already: {sorted(clash)}")
    size = F.coalesce(F.col(tokens).cast("long"), F.lit(0))
    whole_row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    maps = any(field.dataType.typeName() == "map" for field in docs.schema)  # these have no hash
    hashed = F.to_json(whole_row) if maps else whole_row
    # The row travels as one column, so that its names clash with none of ours.
    rows = docs.select(
        F.to_json(F.struct(F.col(source).alias("s"))).alias("of"),  # a null source differs from every string
        size.alias("size"),
        F.xxhash64(F.lit(seed), F.col(key), hashed).alias("place"),
        whole_row.alias("row"),
    )
    sources = rows.groupBy("of").agg(F.count("*").alias("rows"), F.sum("size").alias("tokens"))
    sizes = stored(sources, "sources").select(F.col("of").alias("source"), "tokens", "rows")
    # As many blocks as keep about ROWS rows each, whatever the source's size.
    blocks_of = sizes.select(F.col("source").alias("of"), F.ceil(F.col("rows") / ROWS).cast("long").alias("blocks"))
    rows = sized_join(rows, blocks_of, ["of"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "place"), "blocks"))
    blocks = stored(rows.groupBy("of", "block").agg(F.sum("size").alias("in_block"), F.count("*").alias("n")), "blocks")
    weights, _, _ = mixture(sizes, max_repeats, target_entropy, budget)
    weights = sizes.select(F.col("source").alias("of"), F.col("tokens").alias("all_tokens")).join(
        weights.select(F.col("source").alias("of"), "repeats", "weight"), "of", "left"
    )
    weights = weights.withColumn("repeats", F.coalesce("repeats", F.lit(1.0)))
    # Blocks in random order, with the tokens before each: running totals of sorted ranges of blocks.
    spread = F.xxhash64(F.lit(seed + 2), "of", "block")
    group = F.xxhash64(F.lit(seed + 4), "of").alias("source_hash")
    plan = numbered(blocks.select(group, spread.alias("spread"), "of", "block", F.col("in_block").alias("upto")), "source_hash", [F.col("spread"), F.col("of"), F.col("block")], sums=("upto",))
    plan = plan.select("of", "block", F.col("upto_before").alias("before"), (F.col("upto") - F.col("upto_before")).alias("in_block"))
    plan = plan.join(weights, "of")
    whole = F.floor(F.col("repeats") + 1e-9)
    left = F.greatest(F.col("repeats") - whole, F.lit(0.0)) * F.col("all_tokens") - F.col("before")
    plan = plan.select("of", "block", "in_block", "repeats", "weight", whole.cast("int").alias("whole"), left.alias("left"))
    placed = sized_join(rows, stored(plan, "plan"), ["of", "block"])
    # Only the block in which a source's budget ends, about ROWS rows, is gone through row by row.
    cut = (F.col("left") > 0) & (F.col("left") < F.col("in_block"))
    inside = Window.partitionBy("of").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = placed.filter(cut).select("of", "block", "place", "size", "left")
    ends = ends.withColumn("upto", F.sum("size").over(inside)).filter("upto <= left")
    ends = ends.groupBy("of", "block").agg(F.max("place").alias("last"))
    placed = sized_join(placed, stored(ends, "cut"), ["of", "block"], "left")
    more = F.when(F.col("left") >= F.col("in_block"), F.lit(1)).when(F.col("left") <= 0, F.lit(0))
    more = more.otherwise(F.coalesce((F.col("place") <= F.col("last")).cast("int"), F.lit(0)))
    copies = placed.withColumn("copies", F.col("whole") + more).filter("copies > 0")
    passes = copies.withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    # A pass takes the place that its part of the source's budget has; within it, places are random.
    spot = F.pmod(F.xxhash64(F.lit(seed + 3), "pass", "place"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    part = F.least(F.lit(1.0), F.greatest(F.col("repeats") - F.col("pass") + 1, F.lit(1e-6)))
    slot = (F.col("pass") - 1 + spot * part) / F.greatest(F.col("repeats"), F.lit(1e-6))
    own = [c.alias(name) for name, c in zip(columns, (slot, F.col("pass"), F.col("weight")))]
    return passes.select(*(F.col("row")[c].alias(c) for c in docs.columns), *own)
