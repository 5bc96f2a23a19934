"""Chat formatting: conversations become windows of whole turns within a token budget, with a mask of what a model learns from."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, written
from .token_counts import token_counts

#: A turn is OPEN, its role, a line end, its text, CLOSE. Neither mark overlaps itself, so no text's end can be taken for a part of one.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Strings that templates use for control: `<|name|>`, `<s>`, `</s>`, `[INST]`, `[/INST]`, `<<SYS>>`, `<</SYS>>`. Inside texts each gets a
#: backslash after its first sign, one more if it has some there already; reading takes one away.
_REST = r"(/?s>|</?SYS>>|/?INST\]|\|[A-Za-z0-9_]+\|>)"
CONTROL, ESCAPED = rf"([<\[])(\\*){_REST}", re.compile(rf"([<\[])\\(\\*){_REST}")
TURN = re.compile(rf"{re.escape(OPEN)}(.*?)\n(.*?){re.escape(CLOSE)}", re.DOTALL)
#: Turns of a conversation whose numbers share a thousand are summed up together.
CHUNK = 1024


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def escaped_role(role: Column) -> Column:
    """A role on one line: backslashes are doubled, line ends become \\n."""
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: str) -> str:
    return unescaped(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.DOTALL))


def spans(tokens: Sequence[int], since: int, room: int, history: int) -> Iterator[tuple[int, int, int]]:
    """(first repeated, first new, end) of the windows over turns from `since` on, by prefix sums of their tokens.

    A window repeats the turns before its first new one as far as `history` tokens go and leave room for that one; then it takes as many
    turns as fit into the room. A turn larger than the room has a window of its own.
    """
    sums = [0, *accumulate(tokens)]
    i = since
    while i < len(tokens):
        h = min(i, bisect_left(sums, sums[i] - max(0, min(history, room - tokens[i]))))
        end = max(i + 1, bisect_right(sums, sums[h] + room) - 1)
        yield h, i, end
        i = end


def format_chats(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = 1024, history: int = 256,
    targets: Sequence[str] = ("assistant",), system: str = "system", vocabulary: str = "byte_bpe_50k.json", segment: int = 64) -> DataFrame:
    """Windows of conversations: id_col, first_turn (of its new turns, from 0), n_repeated, n_turns, n_tokens, text, loss (spans in code points, end exclusive).

    A window holds whole turns, `budget` tokens at most (a larger turn, with its system turn, stands alone beyond that): the
    conversation's system turn (the first one, if its role is `system`), up to `history` tokens of the turns before, and new turns. loss covers
    the escaped texts of new turns whose role is in `targets`; repeated turns are masked, so each target counts once. Windows begin
    anew at every `segment` budgets of a conversation's tokens, so that a conversation of any length is spread over tasks.

    Turns are ordered by turn_col (null first), then role and text; turns equal in all of these are told apart by nothing and each kept. A null id is a
    conversation of its own; null roles and texts are empty. Whole texts; an empty table gives no rows; other columns aren't read.
    """
    if not 0 <= history < budget or segment < 2:
        raise ValueError("history must be less than the budget, and a segment two budgets or more")
    bounded_batches(turns.sparkSession)
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(
        F.col(id_col).alias("conv"), F.floor(F.col(turn_col) / CHUNK).alias("chunk"), F.col(turn_col).alias("turn"), F.concat(F.lit(OPEN), escaped_role(role), F.lit("\n")).alias("head"), escaped(text).alias("body"),
        role.isin(list(targets)).alias("target"), (role == system).alias("system"))
    rows = rows.select("conv", "chunk", "turn", F.length("head").alias("begin"), "target", "system", F.concat("head", "body", F.lit(CLOSE)).alias("formatted"))
    rows = written(token_counts(rows, "formatted", vocabulary, out_col="tokens"), "turns")

    # Offsets in two levels: sums of chunks run over a conversation, sums of turns over a chunk.
    first = F.struct("turn", "formatted", "system", "tokens")
    chunks = rows.groupBy("conv", "chunk").agg(F.sum("tokens").alias("sum"), F.count("*").alias("n"), F.min(first).alias("first"))
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    lead = F.min("first").over(Window.partitionBy("conv").orderBy("chunk"))
    chunks = chunks.select("conv", "chunk", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_n"), lead.alias("lead"))
    sides = chunks.select(
        F.col("conv").alias("conv_"), F.col("chunk").alias("chunk_"), "base", "base_n", F.when(F.col("lead.system"), F.struct(F.col("lead.formatted").alias("text"), F.col("lead.tokens").alias("tokens"))).alias("system_turn"))
    placed = rows.join(sides, F.col("conv").eqNullSafe(F.col("conv_")) & F.col("chunk").eqNullSafe(F.col("chunk_")))
    order = Window.partitionBy("conv", "chunk").orderBy("turn", "formatted")
    run = order.rowsBetween(Window.unboundedPreceding, -1)
    size = segment * budget
    placed = placed.withColumns({"at": F.col("base") + F.coalesce(F.sum("tokens").over(run), F.lit(0)), "seq": F.col("base_n") + F.row_number().over(order) - 1, "last": F.lag("tokens").over(order)})
    part = F.floor(F.col("at") / size)
    starts = F.col("last").isNull() | (part != F.floor((F.col("at") - F.col("last")) / size))
    placed = placed.withColumns({"own": part, "system_turn": F.when(starts, F.col("system_turn")), "system": F.col("system") & (F.col("seq") == 0)})
    again = ~F.col("system") & (F.col("at") >= (F.col("own") + 1) * size - history)
    placed = placed.withColumn("part", F.explode(F.when(again, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))
    turn = F.struct("seq", (F.col("part") != F.col("own")).alias("again"), "tokens", "begin", "target", "system", "formatted")
    groups = placed.groupBy("conv", "part").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.max(F.when(F.col("part") == F.col("own"), F.col("system_turn"))).alias("system_turn"))
    id_field = groups.schema["conv"]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "first_turn", "n_repeated", "n_turns", "n_tokens", "text", "loss"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))]
        for batch in batches:
            for k in range(batch.num_rows):
                turns, system = batch.column("turns")[k].as_py(), batch.column("system_turn")[k].as_py()
                out = list(_windows(turns, system, budget, history))
                if out:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column("conv").slice(k, 1)] * len(out)), *columns], names=names)

    kind = id_field.dataType.simpleString()
    found = groups.select("conv", "turns", "system_turn").mapInArrow(windows, f"conv {kind}, first_turn long, n_repeated int, n_turns int, n_tokens long, text string, loss array<struct<begin:int,end:int>>")
    return found.withColumnRenamed("conv", id_col)


def _windows(turns: list[dict], system: dict | None, budget: int, history: int) -> Iterator[tuple]:
    """Windows of one segment; turns marked `again` stand before it and may only be repeated."""
    own_system = [t for t in turns if t["system"]]
    rest = [t for t in turns if not t["system"]]
    since = next((i for i, t in enumerate(rest) if not t["again"]), len(rest))
    if own_system and not rest[since:]:
        yield own_system[0]["seq"], 0, 1, own_system[0]["tokens"], own_system[0]["formatted"], []
        return
    room = budget - (system["tokens"] if system else 0)
    for h, i, end in spans([t["tokens"] for t in rest], since, room, history):
        first = bool(own_system) and i == since  # the first window has the system turn as a new one
        texts, at, loss = [system["text"]] if system else [], len(system["text"]) if system else 0, []
        for k, t in enumerate(rest[h:end], h):
            texts.append(t["formatted"])
            if k >= i and t["target"]:
                loss.append({"begin": at + t["begin"], "end": at + len(t["formatted"]) - len(CLOSE)})
            at += len(t["formatted"])
        repeated = i - h + (1 if system and not first else 0)
        yield rest[i]["seq"] - first, repeated, len(texts), sum(t["tokens"] for t in rest[h:end]) + (system["tokens"] if system else 0), "".join(texts), loss


def turns_of(text: str, n_repeated: int) -> list[tuple[str, str]]:
    """(role, text) of a window's new turns, read back from its text."""
    return [(unescaped_role(m[1]), unescaped(m[2])) for k, m in enumerate(TURN.finditer(text)) if k >= n_repeated]


def conversation_digests(windows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Conversations read back from their windows: id_col, n_turns, turns_sha256 (of role, line end, text, line end for each turn), loss_chars and
    loss_sha256 (of all text under the mask, unescaped), formatted_chars (of all windows, code points).

    A conversation's windows are sorted and streamed through one task, which a running digest needs; it holds one window at a
    time. A null id is a conversation of its own; an empty table gives no rows.
    """
    kind = windows.schema[id_col].dataType.simpleString()
    dealt = windows.select(F.col(id_col).alias("conv"), "first_turn", "n_repeated", "text", "loss").repartition("conv").sortWithinPartitions("conv", "first_turn")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        ids: list[pa.Array] = []
        done: list[tuple] = []
        now = None

        def closed() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
            out = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *columns], names=names)
            ids.clear()
            done.clear()
            return out

        def finished(state: list) -> None:
            ids.append(state[0])
            done.append((state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        for batch in blocks(batches, "text"):
            repeated, text, loss = (batch.column(c).to_pylist() for c in ("n_repeated", "text", "loss"))
            conv = batch.column("conv")
            for k, window in enumerate(text):
                if now is None or now[0][0] != conv[k]:
                    if now is not None:
                        finished(now)
                    now = [conv.slice(k, 1), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in turns_of(window, repeated[k]):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for span in loss[k]:
                    target = unescaped(window[span["begin"] : span["end"]])
                    now[3] += len(target)
                    now[4].update(target.encode())
                now[5] += len(window)
            if done:
                yield closed()
        if now is not None:
            finished(now)
            yield closed()

    return dealt.mapInArrow(digest, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("conv", id_col)
