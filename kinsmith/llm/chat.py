"""Chat formatting: raw transcripts to canonical turns, by a hidden Markov model over lines.

A state is a role and whether the line begins a turn. A line shows its speaker marker, if any, its length, and whether it
follows a blank line. Transition and emission probabilities are counted on labelled transcripts; Viterbi's most likely
states then say which lines begin a turn of whom, also where markers are missing. Markers go, and every turn is rendered
with the same one.

A transcript is any number of segments (rows), numbered in order. Lines of SEGMENTS neighbouring segments are decoded
together; for longer transcripts each such piece is first summed up as a matrix of best scores by state before and state at
its end, pieces of pieces likewise, and the states at the pieces' ends are then decided from the top down. Whether the line
before a piece is blank is told to it first, from the last segment of the piece before. That is Viterbi's result exactly,
and no task ever holds more than SEGMENTS segments of a transcript, however many rows share a place in it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsmith.llm.common import materialize, require, small_batches
from kinsmith.sources.tables import with_rank

ROLES = ("system", "user", "assistant")
#: States: role r begins at 2r and goes on at 2r + 1; the last one is before the first line.
STATES = 2 * len(ROLES)
START = STATES
SEGMENTS = 256
#: Speaker names by role.
NAMES = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "q", "question"),
    "assistant": ("assistant", "ai", "bot", "model", "a", "answer", "agent"),
}
_ROLE = {name: r for r, role in enumerate(ROLES) for name in NAMES[role]}
_NAME = "|".join(sorted(_ROLE, key=lambda n: (-len(n), n)))
_MARKER = re.compile(rf"^[ \t]*(?:<\|(?P<a>{_NAME})\|>|\[(?P<b>{_NAME})\]|(?:\#\#\# ?|\*\*|> ?)?(?P<c>{_NAME})(?:\*\*)? ?:)[ \t]?", re.IGNORECASE | re.ASCII)
_LENGTHS = (1, 20, 60, 150, 400, 1200)
#: What a line shows: 4 kinds of marker, 7 lengths, after a blank line or not.
SYMBOLS = 4 * 7 * 2
#: Marker styles of raw transcripts for the query, by role.
STYLES = (("System: ", "User: ", "Assistant: "), ("### Instruction: ", "### Human: ", "### Assistant: "), ("Context: ", "Q: ", "A: "), ("<|system|>", "<|user|>", "<|assistant|>"), ("[SYSTEM] ", "[USER] ", "[BOT] "))


def observe(text: str | None, after_blank: bool = False) -> list[tuple[int, str]]:
    """(symbol, line without its marker) of each line; an empty or null text is one empty line."""
    out = []
    for line in (text or "").split("\n"):
        kind, m = 0, _MARKER.match(line)
        if m:
            kind = 1 + _ROLE[(m["a"] or m["b"] or m["c"]).lower()]
            line = line[m.end() :]
        size = sum(len(line) >= n for n in _LENGTHS)
        out.append(((kind * 7 + size) * 2 + after_blank, line))
        after_blank = not line.strip()
    return out


class Hmm:
    """Log probabilities: steps[i, j] from state i (START included) to j, and shows[j, symbol]."""

    def __init__(self, steps: np.ndarray, shows: np.ndarray):
        steps = steps + 0.1
        steps[START, 1::2] = 1e-9  # the first line begins a turn
        for r in range(len(ROLES)):  # only a turn's own lines go on with it
            for i in range(STATES + 1):
                if i // 2 != r or i == START:
                    steps[i, 2 * r + 1] = 1e-9
        self.steps = np.log(steps / steps.sum(1, keepdims=True))
        # marker, length and blank line are independent given the state, so that unseen combinations are judged by parts
        grid, self.shows = shows.reshape(-1, 4, 7, 2), np.zeros((len(shows), 4, 7, 2))
        for axes in ((2, 3), (1, 3), (1, 2)):
            part = grid.sum(axes, keepdims=True) + 0.1
            self.shows += np.log(part / part.sum((1, 2, 3), keepdims=True))
        self.shows = self.shows.reshape(shows.shape)

    def matrix(self, symbol: int) -> np.ndarray:
        return self.steps + self.shows[:, symbol]


class Matrices(dict):
    """symbol -> matrix, so that the lines of a long text share few."""

    def __init__(self, hmm: Hmm):
        super().__init__()
        self.hmm = hmm

    def __missing__(self, symbol: int) -> np.ndarray:
        self[symbol] = m = self.hmm.matrix(symbol)
        return m


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """Best scores by state before the first and state at the last."""
    total = matrices[0]
    for m in matrices[1:]:
        total = (total[:, :, None] + m[None, :STATES, :]).max(1)
    return total


def chain(matrices: list[np.ndarray], enter: int, leave: int | None) -> list[int]:
    """The best states at each step after `enter`; the last one is `leave` if given. Ties go to the lower state."""
    score, back = matrices[0][enter], np.empty((len(matrices) - 1, STATES), np.int8)
    for i, m in enumerate(matrices[1:]):
        every = score[:, None] + m[:STATES]
        back[i] = every.argmax(0)
        score = every.max(0)
    state = int(score.argmax()) if leave is None else leave
    states = [state]
    for b in back[::-1]:
        states.append(state := int(b[state]))
    return states[::-1]


def _streamed(df: DataFrame, keys: list[str], order: list[str], f: Callable, schema: str) -> DataFrame:
    """f(list of rows) -> list of rows, for each group of keys in order; groups have SEGMENTS rows at most, tasks stream over many."""
    names = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for frame in frames for r in frame.itertuples(index=False, name="Row"))
        out: list[tuple] = []
        fields = [x.split()[0] for x in schema.split(", ")]
        for _, group in groupby(rows, key=lambda r: tuple(None if pd.isna(v) else v for v in (getattr(r, k) for k in keys))):
            out += f(list(group))
            if len(out) > 2000:
                yield pd.DataFrame(out, columns=fields)
                out = []
        yield pd.DataFrame(out, columns=fields)

    assert all(k in names for k in keys)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def fit_hmm(labelled: DataFrame) -> Hmm:
    """From labelled(conv_id, seq, role, text), a turn for each row, its marker still in the text.

    What lines show is counted where they are; which turn follows which comes from a join on neighbouring turns, in which
    rows that repeat a turn count once. Rows with another or no role, or without a seq, are left out; a null text is an empty
    line; texts of any length are taken whole; rows of a null conv_id have no neighbours. Other columns are ignored. An empty
    table gives a model in which all states are alike.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[tuple[int, int]] = Counter()
        for frame in frames:
            for role, text in zip(frame["role"], frame["text"], strict=True):
                for k, (symbol, _) in enumerate(observe(text)):
                    seen[2 * ROLES.index(role) + (k > 0), symbol] += 1
        yield pd.DataFrame([(s, x, n) for (s, x), n in seen.items()], columns=["state", "symbol", "n"])

    known = labelled.where(F.col("role").isin(*ROLES) & F.col("seq").isNotNull())
    shows, steps = np.zeros((STATES, SYMBOLS)), np.zeros((STATES + 1, STATES))
    for r in known.select("role", "text").mapInPandas(count, "state int, symbol int, n long").groupBy("state", "symbol").agg(F.sum("n").alias("n")).collect():
        shows[r["state"], r["symbol"]] = r["n"]
    turns = known.select("conv_id", F.col("seq").cast("long").alias("seq"), "role").distinct()
    after = turns.select("conv_id", (F.col("seq") - 1).alias("seq"), F.col("role").alias("then"))
    lines = shows.sum(1)
    for r in turns.join(after, ["conv_id", "seq"]).groupBy("role", "then").count().collect():
        a, b = ROLES.index(r["role"]), ROLES.index(r["then"])
        more = lines[2 * a + 1] / max(1.0, lines[2 * a])  # lines beyond the first, for each turn
        single = math.exp(-more)
        steps[2 * a, 2 * b] += r["count"] * single
        steps[2 * a + 1, 2 * b] += r["count"] * (1 - single)
    for r in range(len(ROLES)):
        first = lines[2 * r] * (1 - math.exp(-lines[2 * r + 1] / max(1.0, lines[2 * r])))
        steps[2 * r, 2 * r + 1] += first
        steps[2 * r + 1, 2 * r + 1] += max(0.0, lines[2 * r + 1] - first)
    for r in turns.where("seq = 0").groupBy("role").count().collect():
        steps[START, 2 * ROLES.index(r["role"])] += r["count"]
    return Hmm(steps, shows)


def _ends(pieces: DataFrame) -> DataFrame:
    """pieces(conv_id, at, m) -> (conv_id, at, enter, leave): the states before and at the end of each piece."""
    up = pieces.withColumn("up", F.floor(F.col("at") / max(2, SEGMENTS)).cast("long"))
    as_matrix = lambda r: np.array(r.m).reshape(STATES + 1, STATES)

    def decide(rows: list) -> list[tuple]:
        enter, leave = (START, None) if not hasattr(rows[0], "enter") else (int(rows[0].enter), int(rows[0].leave))
        states = chain([as_matrix(r) for r in rows], enter, leave)
        return [(r.conv_id, r.at, e, s) for r, e, s in zip(rows, [enter, *states], states, strict=False)]

    fields = "conv_id string, at long, enter int, leave int"
    low, high = up.agg(F.min("up"), F.max("up")).first()
    if low == high:
        return _streamed(up, ["conv_id"], ["at"], decide, fields)
    whole = materialize(_streamed(up, ["conv_id", "up"], ["at"], lambda rows: [(rows[0].conv_id, rows[0].up, product([as_matrix(r) for r in rows]).ravel().tolist())], "conv_id string, at long, m array<double>"), "pieces")
    known = _ends(whole).withColumnRenamed("at", "up")
    joined = up.join(known, up["conv_id"].eqNullSafe(known["conv_id"]) & (up["up"] == known["up"])).select(up["conv_id"], up["at"], up["m"], up["up"], "enter", "leave")
    return _streamed(joined, ["conv_id", "up"], ["at"], decide, fields)


def format_transcripts(segments: DataFrame, hmm: Hmm) -> DataFrame:
    """segments(conv_id, seq, text) -> (conv_id, seq, role, n_lines, n_turns, rendered), a row for each row.

    Lines are in order of seq and of place in the text; where segments end says nothing. `role` is that of the segment's
    first line, n_turns the number of turns that begin in it, and `rendered` the segment with markers as <|role|> lines,
    so a transcript's rendered segments in order are its canonical form. A null text is an empty line; segments without a
    seq come first, as seq 0; segments of a null conv_id are one transcript; rows that repeat a seq are in order of text. A
    text of any length is one row's work, any number of rows of a transcript are many tasks'. Other columns are ignored; an
    empty table gives no rows.
    """
    require(segments, "conv_id", "seq", "text")
    rows = small_batches(segments).select(F.col("conv_id").cast("long").cast("string").alias("conv_id"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    long = sizes.where(F.col("n") > SEGMENTS)
    matrices = Matrices(hmm)

    def observed(group: list) -> list[list[tuple[int, str]]]:
        out, blank = [], bool(getattr(group[0], "blank", False))
        for r in group:
            out.append(observe(r.text, blank))
            blank = not out[-1][-1][1].strip()
        return out

    def decode(group: list) -> list[tuple]:
        enter, leave = (START, None) if not hasattr(group[0], "enter") else (int(group[0].enter), int(group[0].leave))
        lines = observed(group)
        states, at, out = chain([matrices[s] for seg in lines for s, _ in seg], enter, leave), 0, []
        for r, seg in zip(group, lines, strict=True):
            own = states[at : at + len(seg)]
            at += len(seg)
            text = "\n".join(f"<|{ROLES[s // 2]}|>\n{line}" if s % 2 == 0 else line for s, (_, line) in zip(own, seg, strict=True))
            out.append((r.conv_id, r.seq, ROLES[own[0] // 2], len(seg), sum(s % 2 == 0 for s in own), text))
        return out

    def ends_blank(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            blank = [not observe(t.rsplit("\n", 1)[-1])[0][1].strip() for t in frame["text"]]
            yield pd.DataFrame({"conv_id": frame["conv_id"], "at": frame["at"] + 1, "blank": blank})

    # as text, the ids pass through pandas unharmed beside nulls
    fields = "conv_id string, seq long, role string, n_lines long, n_turns long, rendered string"
    named = lambda df: df.withColumn("conv_id", F.col("conv_id").cast("long"))
    long = materialize(long.select(F.col("conv_id").alias("c")), "long")  # at most one for each SEGMENTS rows
    of_long = F.col("conv_id").eqNullSafe(F.col("c"))
    short = _streamed(rows.join(long, of_long, "left_anti"), ["conv_id"], ["seq", "text"], decode, fields)
    if long.limit(1).count() == 0:
        return named(short)
    rows = rows.join(long, of_long, "left_semi")
    # rows get their place within the transcript, so that pieces have SEGMENTS rows whatever seq says
    # equal rows differ by a number, so that any number of them spread over tasks
    placed = with_rank(rows.withColumn("tie", F.monotonically_increasing_id()), "place", ["seq", "text", "tie"], ["conv_id"]).withColumn("at", F.floor(F.col("place") / SEGMENTS).cast("long"))
    placed = materialize(placed, "placed")
    last = placed.where(F.col("place") % SEGMENTS == SEGMENTS - 1).select("conv_id", "at", "text")
    before = last.mapInPandas(ends_blank, "conv_id string, at long, blank boolean").select(F.col("conv_id").alias("c"), F.col("at").alias("a"), "blank")
    placed = placed.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") == F.col("a")), "left").select("conv_id", "at", "place", "seq", "text", F.coalesce("blank", F.lit(False)).alias("blank"))
    parts = _streamed(placed, ["conv_id", "at"], ["place"], lambda g: [(g[0].conv_id, g[0].at, product([matrices[s] for seg in observed(g) for s, _ in seg]).ravel().tolist())], "conv_id string, at long, m array<double>")
    known = _ends(materialize(parts, "pieces")).select(F.col("conv_id").alias("c"), F.col("at").alias("a"), "enter", "leave")
    joined = placed.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") == F.col("a"))).drop("c", "a")
    return named(short.unionByName(_streamed(joined, ["conv_id", "at"], ["place"], decode, fields)))


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """Raw transcripts of labelled conversations(conv_id, turn, role, text): (conv_id, seq, role, text).

    Every conversation has one style of markers; about every ninth turn after the first has none. A null text is empty but
    for its marker; rows with another or no role have no marker; null ids, repeated rows and texts of any length stay; other
    columns are left out; an empty table gives no rows.
    """
    require(conversations, "conv_id", "turn", "role", "text")
    style = F.coalesce(F.pmod(F.xxhash64("conv_id", F.lit(3)), F.lit(len(STYLES))), F.lit(0))
    marker = F.lit("")
    for i, marks in enumerate(STYLES):
        for role, mark in zip(ROLES, marks, strict=True):
            marker = F.when((style == i) & (F.col("role") == role), mark).otherwise(marker)
    bare = (F.col("turn") > 0) & (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(9)) == 0)
    text = F.concat(F.when(bare, "").otherwise(marker), F.coalesce("text", F.lit("")))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), "role", text.alias("text"))
