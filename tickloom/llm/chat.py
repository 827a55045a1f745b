"""Roles of raw chat transcripts by a hidden Markov model, and canonical rendering.

States are a role's first line and its further lines. A line's signs are its speaker marker,
whether the marker stands alone, whether a blank line goes before, its length and ending, and whether
it is indented. The model's probabilities are smoothed counts over transcripts whose roles are
known; Viterbi finds the likeliest roles of a whole conversation's lines. A marker is taken off
only where its line is a first line; within a turn blank lines and indentation stay.

A long conversation is cut into blocks of whole turns. For each block the best score from
each state before it to each state at its end is a small matrix; the matrices of a
conversation, a few numbers for a block, give the states between the blocks, and each block then
finds its own path between them. So the result is that of one Viterbi over the whole conversation.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .shared import Scratch

#: Roles; all but the first three are one: "other".
ROLES = ("system", "user", "assistant", "other")
#: Turn numbers of one block, and rows beyond which each turn number has blocks of its own.
BLOCK_TURNS, BLOCK_ROWS = 512, 4_096
#: Conversations of several blocks up to which their ids are broadcast.
BROADCAST_ROWS = 100_000

# Words that mark a speaker.
SPEAKERS = {
    "system": ("system", "sys", "context"),
    "user": ("user", "human", "q", "question", "customer", "instruction", "prompter", "you", "me"),
    "assistant": ("assistant", "ai", "a", "answer", "bot", "agent", "response", "model", "gpt"),
    "other": ("other", "tool", "function", "observation"),
}
MARKER_OF = {word: role for role, words in SPEAKERS.items() for word in words}
MARKER = re.compile(
    r"^[ \t]*(?:<\|(?:im_start\|>)?[ \t]*(?P<tag>[A-Za-z]+)(?:\|>)?|\#{1,6}[ \t]*(?P<head>[A-Za-z]+)[ \t]*:?(?=\s*$)|\[(?P<box>[A-Za-z]+)\][ \t]*:?|\*{0,2}(?P<name>[A-Za-z]{1,12})\*{0,2}[ \t]*:\*{0,2}(?=\s|$))[ \t]?"
)
STATES = 2 * len(ROLES)
#: Numbers of values of the three independent signs: marker with its surroundings, ending and length, indentation.
SIZES = (4 * (len(ROLES) + 2), 6, 2)
#: Counts before any is seen: of each sign and step; of a first line under its own role's marker; of a turn of another role, and such
#: a turn without its marker (transcripts to learn from may have none); of first and further lines that are indented.
PRIOR, OWN_MARKER, OTHER_TURN, OTHER_UNMARKED = 0.5, 5.0, 1.0, 0.001
INDENTED_FIRST, INDENTED_FURTHER = 0.02, 1.0


def marker_of(line: str) -> tuple[int, str]:
    """Which role a line's marker names (0: no marker, the last number: no known speaker), and the line without it."""
    m = MARKER.match(line)
    if not m:
        return 0, line
    role = MARKER_OF.get((m["tag"] or m["head"] or m["box"] or m["name"]).lower())
    return (1 + ROLES.index(role), line[m.end() :]) if role else (1 + len(ROLES), line)


def signs(text: str) -> list[tuple[tuple[int, int, int], int]]:
    """Signs and place of each line that isn't blank; the first line counts as one after a blank line."""
    out, blank = [], True
    for place, line in enumerate(text.split("\n")):
        if not line.strip():
            blank = True
            continue
        marker, rest = marker_of(line)
        known = 0 < marker <= len(ROLES)
        alone = known and not rest.strip()
        body = rest if known else line
        size = 0 if len(body) < 40 else 1 if len(body) < 400 else 2
        out.append(((4 * marker + 2 * alone + blank, 3 * body.rstrip().endswith("?") + size, int(body[:1] in (" ", "\t"))), place))
        blank = False
    return out


def counts_of(turns: list[tuple[str | None, str]]) -> list[tuple[str, int, int]]:
    """Transitions ("t", from, to) and signs ("0" to "2", state, value) of a transcript with known roles; turns of no role are left out."""
    out, before = [], STATES
    for role, text in turns:
        if role is None:
            continue
        own = 2 * ROLES.index(role if role in ROLES else "other")
        for i, (seen, _) in enumerate(signs(text)):
            state = own + (i > 0)
            out += [("t", before, state), *((str(k), state, v) for k, v in enumerate(seen))]
            before = state
    return out


def fit(turns: DataFrame) -> dict:
    """Model from rows (turns array<struct<role, text>>) of whole transcripts or blocks.

    Counts are summed on the executors; what reaches the driver is a table of fixed size.
    Without rows all probabilities are even.
    """

    def run(batches):
        for batch in batches:
            tally: dict[tuple, int] = {}
            for row in batch.column(0).to_pylist():
                for key in counts_of([(t["role"], t["text"] or "") for t in row or []]):
                    tally[key] = tally.get(key, 0) + 1
            keys = [*tally]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[i] for k in keys], pa.int32()) for i in (1, 2)), pa.array([*tally.values()], pa.int64())], ["kind", "a", "b", "n"])

    rows = turns.select("turns").mapInArrow(shared.tidy(run), "kind string, a int, b int, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    other = 2 * ROLES.index("other")
    step = [[OTHER_TURN if s == other else PRIOR for s in range(STATES)] for _ in range(STATES + 1)]
    seen = [[[PRIOR if k else 0.1] * size for _ in range(STATES)] for k, size in enumerate(SIZES)]
    for state in range(STATES):
        seen[2][state] = [1.0, INDENTED_FURTHER if state % 2 else INDENTED_FIRST]
        if state % 2 == 0:
            rare = OTHER_UNMARKED if state == other else 0.1
            seen[0][state] = [OWN_MARKER if v // 4 == 1 + state // 2 else rare for v in range(SIZES[0])]
    for r in rows:
        (step[r["a"]] if r["kind"] == "t" else seen[int(r["kind"])][r["a"]])[r["b"]] += r["n"]
    # lines of other roles look like those of all roles, but for the marker
    for k, kind in enumerate(seen):
        for further in (0, 1):
            if k or further:
                kind[other + further] = [sum(column) for column in zip(*kind[further::2], strict=True)]
    for state in range(STATES + 1):  # a further line follows a line of its own role only
        for role in range(len(ROLES)):
            if state // 2 != role or state == STATES:
                step[state][2 * role + 1] = 0.0
    log = lambda row: [math.log(x / sum(row)) if x else -math.inf for x in row]
    return {"step": [log(r) for r in step], "sign": [[log(r) for r in kind] for kind in seen]}


def _walk(model: dict, score: list[float], observed: list[tuple[int, int, int]]) -> tuple[list[float], list[list[int]]]:
    """Scores after the lines from scores before them (of each state, and of the start), and the best states before each line."""
    step, (one, two, three) = model["step"], model["sign"]
    back = []
    for a, b, c in observed:
        now, best = [], []
        for s in range(STATES):
            # a further line comes from its own role's lines, a first line from any
            p = max((s - 1, s) if s % 2 else range(len(score)), key=lambda p: score[p] + step[p][s])
            best.append(p)
            now.append(score[p] + step[p][s] + one[s][a] + two[s][b] + three[s][c])
        score = now
        back.append(best)
    return score, back


def _entry(state: int) -> list[float]:
    """Scores that allow one state; number STATES is the start."""
    return [0.0 if s == state else -math.inf for s in range(STATES + 1)]


def transfer(model: dict, observed: list[tuple[int, int, int]]) -> list[list[float]]:
    """Best score from each state before the lines (the start last) to each state after them."""
    if not observed:
        return [_entry(s)[:STATES] for s in range(STATES + 1)]
    return [_walk(model, _entry(s), observed)[0] for s in range(STATES + 1)]


def viterbi(model: dict, observed: list[tuple[int, int, int]], before: int = STATES, after: int | None = None) -> list[int]:
    """The likeliest states, from a state before the lines (the start if not given) and up to one at the last line."""
    if not observed:
        return []
    score, back = _walk(model, _entry(before), observed)
    path = [max(range(STATES), key=score.__getitem__) if after is None else after]
    for best in back[:0:-1]:
        path.append(best[path[-1]])
    return path[::-1]


def chain(blocks: list[list[list[float]]]) -> list[tuple[int, int]]:
    """States (before, at the end) of each block on the best path through the blocks' transfer matrices; STATES before the first line."""
    score, back = [*([-math.inf] * STATES), 0.0], []
    for matrix in blocks:
        best = [max(range(STATES + 1), key=lambda p, s=s: score[p] + matrix[p][s]) for s in range(STATES)]
        # without any line so far the start goes on
        still = score[STATES] if all(x == (0.0 if i == j else -math.inf) for i, row in enumerate(matrix) for j, x in enumerate(row)) else -math.inf
        score = [*(score[best[s]] + matrix[best[s]][s] for s in range(STATES)), still]
        back.append([*best, STATES])
    state = max(range(STATES + 1), key=score.__getitem__)
    out = []
    for best in reversed(back):
        out.append((best[state], state))
        state = best[state]
    return out[::-1]


def turns_of(model: dict, text: str, before: int = STATES, after: int | None = None) -> list[tuple[str, str, bool]]:
    """Role and text of the turns, and whether the first goes on from what was before.

    Blank lines at a turn's ends go, all else stays. A marker without text is an empty turn.
    """
    found = signs(text)
    path = viterbi(model, [s for s, _ in found], before, after)
    lines = text.split("\n")
    heads = [i for i, state in enumerate(path) if i == 0 or state % 2 == 0]
    out = []
    for i, j in zip(heads, [*heads[1:], len(path)], strict=False):
        own = lines[found[i][1] : found[j][1] if j < len(path) else len(lines)]
        first = path[i] % 2 == 0
        if first and 0 < marker_of(own[0])[0] <= len(ROLES):
            own[0] = marker_of(own[0])[1]
        while own and not own[0].strip():
            own.pop(0)
        while own and not own[-1].strip():
            own.pop()
        out.append((ROLES[path[i] // 2], "\n".join(own), not first))
    return out


def render(role: Column, text: Column) -> Column:
    """A turn in canonical form."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


def parse(blocks: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """One row for each recovered turn: conv_id, turn_no (from 0), role, text, rendered.

    ``blocks`` has conv_id, part (array, in whose order the blocks of a conversation follow each other) and the raw
    text. Null and blank transcripts have no turns; a null conv_id is a conversation of its own. Other columns are not read;
    an empty table gives no rows.
    """
    scratch = Scratch(blocks.sparkSession)
    kind = blocks.schema["conv_id"].dataType.simpleString()
    rows = blocks.select("conv_id", "part", F.coalesce(text_col, F.lit("")).alias("text"))
    long = scratch.keep(rows.groupBy("conv_id").count().filter("count > 1").select(F.col("conv_id").alias("c")))
    long = F.broadcast(long) if long.count() <= BROADCAST_ROWS else long

    def matrices(batches):
        for batch in batches:
            made = [[x for row in transfer(model, [s for s, _ in signs(text)]) for x in row] for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.float64()))], ["conv_id", "part", "m"])

    def states(part: pa.Table) -> pa.Table:
        order = sorted(range(len(part)), key=lambda i: tuple(part.column("part")[i].as_py()))
        part = part.take(pa.array(order, pa.int64()))
        ends = chain([[m[i : i + STATES] for i in range(0, len(m), STATES)] for m in part.column("m").to_pylist()])
        return pa.table({"conv_id": part.column("conv_id"), "part": part.column("part"), "before": pa.array([a for a, _ in ends], pa.int32()), "after": pa.array([b for _, b in ends], pa.int32())})

    tail = "part array<bigint>"
    known = rows.join(long, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c").mapInArrow(shared.tidy(matrices), f"conv_id {kind}, {tail}, m array<double>")
    known = known.groupBy("conv_id").applyInArrow(states, f"conv_id {kind}, {tail}, before int, after int").toDF("c", "p", "before", "after")
    rows = rows.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left").select("conv_id", "part", "text", "before", "after")

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                at, numbers, roles, texts, goes_on = [], [], [], [], []
                for k, (text, before, after) in enumerate(zip(*(part.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                    found = turns_of(model, text, STATES if before is None else before, None if after is None or after == STATES else after)
                    offset = 1 if found and found[0][2] else 0
                    for number, (role, body, on) in enumerate(found):
                        at.append(k)
                        numbers.append(number - offset)
                        roles.append(role)
                        texts.append(body)
                        goes_on.append(on)
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(numbers, pa.int32()), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(goes_on, pa.bool_())], ["conv_id", "part", "no", "role", "text", "goes_on"])

    turns = scratch.keep(rows.mapInArrow(shared.tidy(run), f"conv_id {kind}, {tail}, no int, role string, text string, goes_on boolean"))
    # turns of the blocks before each block of a long conversation; a block that goes on continues the last of them
    sizes = turns.join(long, F.col("conv_id").eqNullSafe(F.col("c"))).groupBy("conv_id", "part").agg(F.count(F.when(~F.col("goes_on"), 1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.sum("n").over(before).alias("start"))
    numbered = turns.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    numbered = numbered.select("conv_id", "part", (F.coalesce("start", F.lit(0)) + F.col("no")).alias("turn_no"), "role", "text", "goes_on")
    whole = numbered.join(long, F.col("conv_id").eqNullSafe(F.col("c")), "left_anti").select("conv_id", "turn_no", "role", "text")
    pieces = numbered.join(long, F.col("conv_id").eqNullSafe(F.col("c"))).groupBy("conv_id", "turn_no").agg(F.array_sort(F.collect_list(F.struct("part", "role", "text"))).alias("l"))
    joined = pieces.select("conv_id", "turn_no", F.col("l")[0]["role"].alias("role"), F.array_join(F.transform("l", lambda x: x["text"]), "\n\n").alias("text"))
    return whole.unionByName(joined).withColumn("rendered", render(F.col("role"), F.col("text")))


def raw_turn(conv: Column, turn: Column, role: Column, text: Column) -> Column:
    """A turn as raw transcripts have it: one of several marker styles for a conversation; one turn in ten, and those of no role, have none."""
    style, lost = F.pmod(F.xxhash64(conv), F.lit(5)), F.pmod(F.xxhash64(conv, turn), F.lit(10)) == 0
    names = [
        {"system": "System: ", "user": "User: ", "assistant": "Assistant: ", "other": "Tool: "},
        {"system": "Context: ", "user": "Human: ", "assistant": "AI: ", "other": "Function: "},
        {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n", "other": "<|tool|>\n"},
        {"system": "### System:\n", "user": "### Instruction:\n", "assistant": "### Response:\n", "other": "### Tool:\n"},
        {"system": "[system] ", "user": "Q: ", "assistant": "A: ", "other": "[tool] "},
    ]
    known = F.when(role.isin(*ROLES[:3]), role).when(role.isNotNull(), "other")
    marker = F.lit("")
    for k, by_role in enumerate(names):
        for name, sign in by_role.items():
            marker = F.when((style == k) & (known == name), F.lit(sign)).otherwise(marker)
    return F.concat(F.when(lost, F.lit("")).otherwise(marker), F.coalesce(text, F.lit("")))


def blocks_of(turns: DataFrame) -> DataFrame:
    """Blocks (conv_id, part, turns) of conversations, in order of turn, of a hash of the text, and of the text; nulls first.

    Equal rows count once. A block holds ``BLOCK_TURNS`` turn numbers. Where they have more than ``BLOCK_ROWS`` rows each turn number has
    blocks of its own, and one with more rows is cut along the hash, so that a conversation of any length and any ties spreads over tasks
    and the blocks keep its order.
    """
    rows = turns.select("conv_id", "turn", "role", "text").distinct().withColumns({"t": F.coalesce(F.col("turn").cast("bigint"), F.lit(-1)), "h": F.xxhash64("text")})
    rows = rows.withColumn("b", F.floor(F.col("t") / BLOCK_TURNS))
    sizes = rows.groupBy("conv_id", "b", "t").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.groupBy("conv_id", "b").agg(F.sum("n").alias("all"), F.collect_list(F.struct("t", "n")).alias("l")).filter(F.col("all") > BLOCK_ROWS)
    large = large.select(F.col("conv_id").alias("c"), F.col("b").alias("lb"), F.explode("l").alias("x")).select("c", "lb", F.col("x.t").alias("lt"), F.ceil(F.col("x.n") / BLOCK_ROWS).alias("parts"))
    rows = rows.join(large, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("b") == F.col("lb")) & (F.col("t") == F.col("lt")), "left")
    # the hash's place between its least and largest value, in as many parts
    place = F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * F.col("parts"))
    part = F.when(F.col("parts").isNull(), F.array(F.col("b"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))).otherwise(F.array(F.col("b"), F.col("t"), F.least(F.greatest(place, F.lit(0)), F.col("parts") - 1)))
    raw = raw_turn(F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"))
    one = F.struct("t", "h", F.col("text").alias("order"), "role", raw.alias("text"))
    return rows.withColumn("part", part).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(one)).alias("turns"))


def transcripts_of(blocks: DataFrame) -> DataFrame:
    """The raw text of each block: its turns with a blank line between them."""
    return blocks.withColumn("text", F.array_join(F.transform("turns", lambda t: t["text"]), "\n\n"))
