"""Table rows as self-describing lines, and chunks of such lines that never split a row.

A table is one page however long it is, and greedy packing runs from its first line to its last. To keep one long table
from becoming one task, lines are numbered and cut into blocks. The only thing a block needs from the past is where the
open buffer starts, and that is one of a few hundred lines before it. So every block first works out, for each possible
start, where it would leave the buffer: a step function with few steps. These compose, so that a run of blocks has a step
function too: blocks are composed by the fan, their compositions again, until a table has one run; on the way back each
run's first block gets its start from above. Then all blocks pack at once. No task sees more than a fan of blocks, and the
result is exactly that of packing in one go.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusflow.functions.text import only_present, strip
from corpusflow.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, MIN_CHARS, next_flush
from corpusflow.operators.ordinals import running_total, running_total_of_runs
from corpusflow.session import scratch_path, truncate_lineage

# Lines a block holds at most, unless the chunk settings ask for more, characters they have on average, and blocks whose
# step functions meet in a task.
BLOCK_LINES = 20_000
BLOCK_CHARS = 4 << 20
BLOCK_FAN = 256


def row_line(columns: dict[str, Column]) -> Column:
    """``name: value`` parts joined by `` | ``; null or blank values are left out.

    Give decimals or strings for amounts: Spark prints large doubles in E notation.
    """
    parts = [F.concat(F.lit(f"{n}: "), F.nullif(strip(c.cast("string")), F.lit(""))) for n, c in columns.items()]
    return F.concat_ws(" | ", *parts)


def serialise_rows(df: DataFrame, columns: dict[str, Column], keep: list[str], out: str = "line") -> DataFrame:
    """``keep`` columns and the row's line; rows without any value are dropped."""
    return df.select(*keep, only_present(F.nullif(row_line(columns), F.lit(""))).alias(out))


def chunk_lines(
    lines: DataFrame,
    groups: list[str],
    position: str = "pos",
    line: str = "line",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    block_lines: int = BLOCK_LINES,
    fan: int = BLOCK_FAN,
    runs: str | None = None,
) -> DataFrame:
    """Chunks of tables given as rows of lines: ``groups``, ``chunk_index``, ``text``, ``char_count``.

    ``position`` is an integer that orders the rows of a group and is unique in it. A cell with newlines makes its
    row several lines. Rows of one group column that come in runs of neighbouring positions need not move to be numbered:
    ``runs`` then is a scratch folder for them, to be removed when the chunks have been written.
    """
    # The most lines an open buffer can hold: one-character lines up to the size, or the overlap and one more.
    reach = max((size + 1) // 2, overlap + 1)
    several = F.filter(F.transform(F.split(F.col(line), "\n"), strip), lambda x: x != "")
    one = strip(F.col(line))
    parts = (
        F.when(F.contains(line, F.lit("\n")), several)
        .when(one != "", F.array(one))
        .otherwise(F.array().cast("array<string>"))
    )
    source = lines.select(*groups, F.col(position).alias("_pos"), parts.alias("_parts"))
    sized = source.withColumn("_size", F.size("_parts").cast("long"))
    if runs:
        placed = running_total_of_runs(sized, *groups, "_pos", "_size", "_first", runs)
    else:
        first = running_total(sized.drop("_parts"), groups, "_pos", "_size", "_first").select(*groups, "_pos", "_first")
        placed = source.join(first, [*groups, "_pos"])
    numbered = placed.select(*groups, "_first", F.posexplode("_parts").alias("_at", "_line")).select(
        *groups, (F.col("_first") + F.col("_at")).alias("_n"), "_line"
    )
    # Read by both passes: stored once, rather than numbered again for the second.
    numbered = numbered if runs else _stored(numbered)
    mean = numbered.agg(F.avg(F.length("_line") + 1)).first()[0] or 1
    block = max(min(block_lines, int(BLOCK_CHARS / mean)), 2 * reach)
    # A block also gets the lines before it that an open buffer can reach back to.
    own = F.floor(F.col("_n") / block)
    copies = F.when(F.col("_n") % block >= block - reach, F.array(own, own + 1)).otherwise(F.array(own))
    blocks = numbered.select(*groups, "_n", "_line", F.explode(copies).alias("_block"))

    keys = [lines.schema[g] for g in groups]
    entries = _entries(_explore(blocks, groups, keys, block, size, overlap), groups, keys, fan)

    def pack(key, pdf):
        pdf = pdf.sort_values("_n")
        base, texts = int(pdf["_n"].iloc[0]), pdf["_line"].tolist()
        begin = int(key[-1]) * block - base
        ends = list(accumulate(len(t) + 1 for t in texts))
        start, last = int(pdf["_entry"].iloc[0]) - base, max(begin - 1, 0)
        out = []
        while (stop := next_flush(ends, start, last, size)) < len(texts):
            out.append("\n".join(texts[start:stop]))
            start, last = _after_flush(start, stop, overlap)
        if pdf["_is_last"].iloc[0]:
            out.append("\n".join(texts[start:]))
        kept = [t for t in out if len(t) > MIN_CHARS]
        index = range(int(pdf["_index"].iloc[0]), int(pdf["_index"].iloc[0]) + len(kept))
        columns = {f.name: [key[i]] * len(kept) for i, f in enumerate(keys)}
        columns |= {"chunk_index": index, "text": kept, "char_count": [len(t) for t in kept]}
        return pd.DataFrame(columns, dtype=object)

    schema = T.StructType(
        keys
        + [
            T.StructField("chunk_index", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("char_count", T.IntegerType()),
        ]
    )
    return blocks.join(entries, [*groups, "_block"]).groupBy(*groups, "_block").applyInPandas(pack, schema)


def _stored(rows: DataFrame) -> DataFrame:
    path = scratch_path(rows.sparkSession, "lines")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _after_flush(start: int, stop: int, overlap: int) -> tuple[int, int]:
    """The buffer once line ``stop`` has closed the one from ``start``: its first and last line."""
    return (max(start, stop - overlap) if overlap > 0 else stop), stop


def _explore(blocks, groups, keys, block, size, overlap) -> DataFrame:
    """Per block, for each possible first line of the open buffer on entry, that on leaving and the chunks kept.

    Works on line lengths alone. Neighbouring entries mostly leave alike, so runs of equal answers are stored once:
    ``_from`` holds the first entry of each run.
    """
    longs = T.ArrayType(T.LongType())
    answer = T.StructType(
        keys
        + [T.StructField("_block", T.LongType())]
        + [T.StructField(c, longs) for c in ("_from", "_leave", "_kept")]
    )

    def explore(key, pdf):
        pdf = pdf.sort_values("_n")
        base = int(pdf["_n"].iloc[0])
        begin = int(key[-1]) * block - base
        if begin >= len(pdf):  # copies only: the table ended with the block before
            return pd.DataFrame(columns=answer.names)
        ends = list(accumulate(int(n) + 1 for n in pdf["_length"]))
        memo: dict[tuple[int, int], tuple[int, int]] = {}

        def leave(state):
            trail = []
            while state not in memo:
                start, last = state
                stop = next_flush(ends, start, last, size)
                if stop >= len(ends):
                    memo[state] = (start + base, 0)
                    break
                chars = ends[stop - 1] - (ends[start - 1] if start else 0) - 1
                trail.append((state, int(chars > MIN_CHARS)))
                state = _after_flush(start, stop, overlap)
            result, kept = memo[state]
            for passed, counts in reversed(trail):
                kept += counts
                memo[passed] = (result, kept)
            return result, kept

        runs = []
        for entry in range(begin) if begin else (0,):
            found = leave((entry, max(begin - 1, 0)))
            if not runs or runs[-1][1:] != found:
                runs.append((entry + base, *found))
        row = [*key, *(list(column) for column in zip(*runs))]
        return pd.DataFrame([row], columns=answer.names)

    lengths = blocks.select(*groups, "_block", "_n", F.length("_line").alias("_length"))
    return lengths.groupBy(*groups, "_block").applyInPandas(explore, answer)


def _entries(answers: DataFrame, groups, keys, fan: int) -> DataFrame:
    """Per block, the first line of the open buffer on entry, the first chunk index, and whether it is the last."""
    levels = [truncate_lineage(answers)]
    last = levels[0].groupBy(*groups).agg(F.max("_block").alias("_last"))
    top = last.agg(F.max("_last")).first()[0] or 0
    while top >= fan:
        levels.append(truncate_lineage(_compose(levels[-1], groups, fan)))
        top //= fan
    over = F.floor(F.col("_block") / fan).alias("_over")
    entries = _walk(levels.pop().withColumns({"_over": F.lit(0), "_start": F.lit(0), "_first": F.lit(0)}), groups, keys)
    while levels:
        above = entries.select(
            *groups, F.col("_block").alias("_over"), F.col("_entry").alias("_start"), F.col("_index").alias("_first")
        )
        entries = _walk(levels.pop().withColumn("_over", over).join(above, [*groups, "_over"]), groups, keys)
    return entries.join(last, groups).select(
        *groups, "_block", "_entry", "_index", (F.col("_block") == F.col("_last")).alias("_is_last")
    )


def _step(froms, leaves, kept, entry: int) -> tuple[int, int]:
    """Where a block entered with a buffer from line ``entry`` leaves it, and the chunks it keeps."""
    run = bisect_right(froms, entry) - 1
    return int(leaves[run]), int(kept[run])


def _compose(answers: DataFrame, groups, fan: int) -> DataFrame:
    """The step functions of runs of ``fan`` blocks: the first's steps, taken through the others."""
    schema = answers.schema

    def compose(key, pdf):
        rows = pdf.sort_values("_block")[["_from", "_leave", "_kept"]].itertuples(index=False, name=None)
        froms, leaves, kept = (x.tolist() for x in next(rows))
        for step in rows:
            step = [x.tolist() for x in step]
            onward = [_step(*step, leave) for leave in leaves]
            leaves, kept = [leave for leave, _ in onward], [a + b for a, (_, b) in zip(kept, onward)]
            changed = [i for i in range(len(froms)) if not i or (leaves[i], kept[i]) != (leaves[i - 1], kept[i - 1])]
            froms, leaves, kept = ([column[i] for i in changed] for column in (froms, leaves, kept))
        return pd.DataFrame([[*key, froms, leaves, kept]], columns=schema.names)

    over = F.floor(F.col("_block") / fan).alias("_block_over")
    return answers.groupBy(*groups, over).applyInPandas(compose, schema)


def _walk(answers: DataFrame, groups, keys) -> DataFrame:
    """``_entry`` and ``_index`` of each block of a run, from those of the run (``_over``): ``_start`` and ``_first``."""
    schema = T.StructType(keys + [T.StructField(c, T.LongType()) for c in ("_block", "_entry", "_index")])

    def walk(key, pdf):
        pdf = pdf.sort_values("_block")
        entry, index, out = int(pdf["_start"].iloc[0]), int(pdf["_first"].iloc[0]), []
        for block, *step in pdf[["_block", "_from", "_leave", "_kept"]].itertuples(index=False, name=None):
            out.append([*key[:-1], block, entry, index])
            entry, kept = _step(*(x.tolist() for x in step), entry)
            index += kept
        return pd.DataFrame(out, columns=schema.names, dtype=object)

    return answers.groupBy(*groups, "_over").applyInPandas(walk, schema)
