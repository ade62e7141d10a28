"""Multi-party chat formatting: every participant in turn becomes the assistant."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quarry.llm.common import cut, importable

#: How a turn opens and closes; roles that set the scene and are no participants.
OPEN, CLOSE, SCENE = "<|im_start|>", "<|im_end|>\n", ("system",)
#: Characters after which a rendered dialogue goes on in its next segment.
SEGMENT = 32_768


def name_of(speaker: str) -> str:
    """A speaker's name as it stands in a header: on one line, without markup."""
    return " ".join(speaker.replace(OPEN, " ").replace(CLOSE.strip(), " ").split())


def header(speaker: str | None, me: str | None, scene: tuple[str, ...] = SCENE) -> str:
    """How a turn opens, seen by me: assistant, a scene role as it is, or a named user."""
    if speaker is None:
        return f"{OPEN}user\n"
    if speaker in scene:
        return f"{OPEN}{speaker}\n"
    return f"{OPEN}assistant\n" if speaker == me else f"{OPEN}user name={name_of(speaker)}\n"


def render(turns: list[tuple[str | None, str | None]], me: str, scene: tuple[str, ...] = SCENE) -> tuple[str, list[tuple[int, int]]]:
    """(text, spans): the turns as me sees them, and the characters that me is to learn.

    A span covers what me says and the mark that ends it, but not the header before it.
    """
    parts, spans, at = [], [], 0
    for speaker, said in turns:
        head, body = header(speaker, me, scene), (said or "") + CLOSE
        parts += [head, body]
        if speaker == me:
            spans.append((at + len(head), at + len(head) + len(body) - 1))  # without the line's end
        at += len(head) + len(body)
    return "".join(parts), spans


def ordered(rows: DataFrame) -> DataFrame:
    """A written table of rows (conv, turn, speaker, said, size) with begin: size of what the conversation has before.

    A conversation may be of any length: rows are dealt by range, so that it can span many
    tasks, and begin is a two-pass prefix sum over tasks' totals.
    """
    sort = ["conv", "turn", "speaker", "said", "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort)
    dealt = cut(dealt.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()).drop("tie"), "turns")
    chunks = dealt.groupBy("part", "conv").agg(F.sum("size").alias("size"))
    bases = chunks.withColumn("base", F.sum("size").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    bases = bases.select(F.col("part").alias("p"), F.col("conv").alias("c"), F.coalesce("base", F.lit(0)).alias("base"))
    within = F.sum("size").over(Window.partitionBy("part", "conv").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    summed = dealt.withColumn("within", F.coalesce(within, F.lit(0)))
    return summed.join(bases, (F.col("part") == F.col("p")) & F.col("conv").eqNullSafe(F.col("c"))).withColumn("begin", F.col("base") + F.col("within")).drop("p", "c", "base", "within")


def perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", scene: tuple[str, ...] = SCENE, segment: int = SEGMENT
) -> DataFrame:
    """(conv_id, speaker, segment, n_turns, text, spans) for each participant of each conversation.

    Each participant's rows render the whole dialogue, with that speaker as assistant, the
    others as users by name, and scene roles as they are. spans are the characters of text to
    be learnt (first, and one past the last): the speaker's own words. A dialogue of more than
    ``segment`` characters goes on in further segments, always between turns and at the same
    turns for all participants, so that no row outgrows a segment and its last turn.

    Turns go by turn (nulls first), then speaker, then text. A null speaker is a user without a
    name and no participant, a null text is an empty turn, and rows with a null conversation
    form one. Repeated rows are turns of their own. A conversation without participants, or an
    empty table, gives no rows. Other columns are not looked at.
    """
    importable(turns.sparkSession)
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(speaker_col).cast("string").alias("speaker"), F.col(text_col).alias("said"))
    conv_type = rows.schema["conv"].dataType.simpleString()
    size = F.length(F.coalesce("said", F.lit(""))) + F.length(F.coalesce("speaker", F.lit(""))) + len(OPEN + "user name=\n" + CLOSE)
    placed = ordered(rows.withColumn("size", size.cast("long")))
    lots = placed.groupBy("conv", F.floor(F.col("begin") / segment).alias("lot")).agg(F.sort_array(F.collect_list(F.struct("part", "seq", "speaker", "said"))).alias("turns"))
    who = placed.filter(F.col("speaker").isNotNull() & ~F.col("speaker").isin(*scene)).select(F.col("conv").alias("c"), F.col("speaker").alias("me")).distinct()
    seen = lots.join(who, F.col("conv").eqNullSafe(F.col("c"))).select("conv", "me", "lot", "turns.speaker", "turns.said")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                some = b.slice(i, 64)
                made = [render(list(zip(*x)), me, scene) for me, *x in zip(*(some.column(j).to_pylist() for j in (1, 3, 4)))]
                spans = [[{"first": a, "end": z} for a, z in s] for _, s in made]
                n = [len(x) for x in some.column(3).to_pylist()]
                out = [some.column(0), some.column(1), some.column(2), pa.array(n, pa.int64()), pa.array([x[0] for x in made], pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))]
                yield pa.RecordBatch.from_arrays(out, ["conv_id", "speaker", "segment", "n_turns", "text", "spans"])

    return seen.mapInArrow(run, f"conv_id {conv_type}, speaker string, segment long, n_turns long, text string, spans array<struct<first:long,end:long>>")
