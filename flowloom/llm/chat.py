"""Transcript parsing by a hidden Markov model.

States are (role, first line of a turn or a later one). A line is seen as a few features: the role
that a speaker marker at its head names, the marker's form, the line before being blank, a question
mark at the end, its length. A transcript's own markers are of the form that its first marker has,
with the first name that stands for each role in that form; any other marker is content. Transition
and emission tables are counts over labelled transcripts of the training fold, added up by Spark.
Viterbi finds the states of a transcript; turns are rendered in one canonical form. A marker is
taken off only where a turn begins and its role is the one found; all other text stays as it is.

A transcript is cut into segments of SEGMENT lines. A long one gets a max-plus transfer matrix for
each segment; the matrices (36 numbers each) fix the states at the segment ends, and then every
segment is decoded by itself, so no task holds a whole long transcript. The result is that of one
Viterbi pass over the transcript.

Defined cases: null text is an empty line; rows with a null conversation id or line number are
dropped from parsing, for they have no place; equal line numbers are ordered by text; repeated rows
count as lines of their own (in `transcripts`, a repeated turn follows after the block of 64 turns
that holds its first copy, and joins the turn before if it has no marker); a turn of nothing but a
marker has empty text; without labels the tables are uniform but for the markers' own evidence; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold, python_batches, stored, table

ROLES = ("system", "user", "assistant")
#: State 2 * role: a turn's first line; 2 * role + 1: a later line.
STATES = 2 * len(ROLES)
SEGMENT = 2000
#: Names that speaker markers use for each role.
NAMES = {
    "system": ("system", "sys", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "me", "prompt", "visitor", "speaker 1"),
    "assistant": ("assistant", "ai", "bot", "model", "answer", "a", "agent", "helper", "speaker 2"),
}
ROLE_OF = {n: r for r, names in enumerate(NAMES.values()) for n in names}
_NAME = "|".join(sorted(map(re.escape, ROLE_OF), key=len, reverse=True))
#: Marker forms: <|name|>, ### name, [name] or **name**:, name: or name>.
MARKER = re.compile(
    rf"^\s*(?:<\|(?P<a>{_NAME})\|>|\#{{1,4}}\s*(?P<b>{_NAME})\s*:?\s*$|\[(?P<c>{_NAME})\]:?|\*\*(?P<d>{_NAME}):?\*\*:?|(?P<e>{_NAME})\s*[:>])[ \t]?", re.I
)
FORMS = "abcde"
#: Sizes of the features: named role (last: none), form (last: none; a share among markers), blank before, question, length class.
SIZES = (len(ROLES) + 1, len(FORMS) + 1, 2, 2, 4)


#: What a blank line holds.
BLANK = " \t\r\n\x0b\x0c"


def marker(line: str) -> tuple[int, str, int] | None:
    """Role of the speaker marker at a line's head, its form and name as in "0user", and where it ends."""
    m = MARKER.match(line)
    if not m:
        return None
    name = m[m.lastgroup].lower()
    return ROLE_OF[name], f"{FORMS.index(m.lastgroup)}{name}", m.end()


def own_marker(line: str, own: Sequence[str | None]) -> tuple[int, str, int] | None:
    """The marker at a line's head if it is one of the transcript's own. own: each role's form and name."""
    m = marker(line)
    return m if m and own[m[0]] == m[1] else None


def look(line: str, after_blank: bool, own: Sequence[str | None]) -> tuple[int, ...]:
    m = own_marker(line, own)
    body = line[m[2] :] if m else line
    return (m[0] if m else len(ROLES), int(m[1][0]) if m else len(FORMS), int(after_blank), int(body.rstrip().endswith("?")), min(3, len(body) // 80))


def body_of(line: str, role: int, own: Sequence[str | None]) -> str | None:
    """A turn's first line without its marker, None if there is nothing else; lines whose marker names another role stay whole."""
    m = own_marker(line, own)
    return line[m[2] :] or None if m and m[0] == role else line


class Hmm:
    """Log tables from counts, with add-one smoothing."""

    def __init__(self, starts: np.ndarray, moves: np.ndarray, emits: list[np.ndarray]) -> None:
        self.start = np.log(starts + 1.0) - np.log((starts + 1.0).sum())
        self.start[1::2] = -1e9  # a transcript begins with a turn
        self.move = np.log(moves + 1.0) - np.log((moves + 1.0).sum(1, keepdims=True))
        for s in range(STATES):
            for t in range(1, STATES, 2):
                if t // 2 != s // 2:
                    self.move[s, t] = -1e9  # a later line has its turn's role
        self.emit = [np.log(e + 1.0) - np.log((e + 1.0).sum(1, keepdims=True)) for e in emits]
        # there is a form where a role is named and only there: its share is among markers
        forms = emits[1][:, : len(FORMS)] + 1.0
        self.emit[1] = np.hstack([np.log(forms) - np.log(forms.sum(1, keepdims=True)), np.zeros((STATES, 1))])

    def scores(self, seen: np.ndarray) -> np.ndarray:
        """lines x states: log probability of what is seen."""
        return sum(e[:, seen[:, k]].T for k, e in enumerate(self.emit))

    def transfer(self, scores: np.ndarray, opens: bool) -> np.ndarray:
        """Best score from each state before the lines (opens: of the first line) to each state of the last line."""
        m = np.full((STATES, STATES), -np.inf)
        np.fill_diagonal(m, self.start + scores[0] if opens else 0)
        for row in scores[1:] if opens else scores:
            m = (m[:, :, None] + self.move[None]).max(1) + row
        return m

    def decode(self, scores: np.ndarray, before: int | None, last: int | None) -> list[int]:
        """Viterbi; before: the state of the line before (None: the transcript begins); last: the last line's state, if it is fixed."""
        v = (self.start if before is None else self.move[before]) + scores[0]
        back = np.zeros((len(scores), STATES), np.int8)
        for k in range(1, len(scores)):
            each = v[:, None] + self.move
            back[k] = each.argmax(0)
            v = each.max(0) + scores[k]
        states = [int(v.argmax()) if last is None else last]
        for k in range(len(scores) - 1, 0, -1):
            states.append(int(back[k, states[-1]]))
        return states[::-1]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows sorted by their first two columns, conversation and segment, as one list for each pair."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[:2] != rows[0][:2]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _dealt(rows: DataFrame, *more: str) -> DataFrame:
    """Rows of a segment together and in order.

    Dealt by a hash of the keys, not by the keys: Spark drops a repartition by keys that a join below has
    dealt by already, and adaptive execution may then turn that join into a broadcast join that reads the
    left side's shuffle as it lies on each machine. mapInArrow asks for no distribution, so nothing would
    bring a segment's rows together again.
    """
    key = F.xxhash64("conv_id", "seg")
    return rows.select("conv_id", "seg", "line_no", "line", *more).repartition(key).sortWithinPartitions("conv_id", "seg", "line_no", "line")


def _placed(lines: DataFrame) -> DataFrame:
    """Lines that have a place, with their segment."""
    seg = F.col("seg") if "seg" in lines.columns else F.floor(F.col("line_no") / SEGMENT)
    more = [c for c in ("role", "first") if c in lines.columns]
    return lines.where(F.col("conv_id").isNotNull() & F.col("line_no").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        seg.cast("bigint").alias("seg"),
        F.col("line_no").cast("bigint").alias("line_no"),
        F.coalesce("line", F.lit("")).alias("line"),
        *more,
    )


def own_markers(lines: DataFrame) -> DataFrame:
    """conv_id, own: for each role the form and name of the transcript's own marker. lines: placed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, tuple] = {}
            for *place, line in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seg", "line_no", "line")), strict=True):
                if m := marker(line):
                    key = (place[0], *m[:2])
                    found[key] = min(found.get(key, (place[1], place[2])), (place[1], place[2]))
            yield pa.RecordBatch.from_pydict(
                {
                    "conv_id": [k[0] for k in found],
                    "role": [k[1] for k in found],
                    "style": [k[2] for k in found],
                    "seg": [v[0] for v in found.values()],
                    "line_no": [v[1] for v in found.values()],
                },
                schema=pa.schema([("conv_id", pa.int64()), ("role", pa.int32()), ("style", pa.string()), ("seg", pa.int64()), ("line_no", pa.int64())]),
            )

    found = lines.select("conv_id", "seg", "line_no", "line").mapInArrow(run, "conv_id bigint, role int, style string, seg bigint, line_no bigint")
    first = found.groupBy("conv_id", "role", "style").agg(F.min(F.struct("seg", "line_no")).alias("at"))
    # at most one row for each form and name
    each = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "style", "role"))).alias("all"))
    form = F.substring(F.get("all", F.lit(0))["style"], 1, 1)
    mine = each.select("conv_id", F.filter("all", lambda m: F.substring(m["style"], 1, 1) == form).alias("mine"))

    def first_of(role: int) -> Column:
        return F.get(F.filter("mine", lambda m: m["role"] == role), F.lit(0))["style"]

    return mine.select("conv_id", F.array(*map(first_of, range(len(ROLES)))).alias("own"))


def _ready(lines: DataFrame) -> DataFrame:
    """Placed lines with their transcript's own markers and, for each segment, whether it comes after a blank line, opens the transcript, and is one of many."""
    rows = _placed(lines)
    blank = F.col("line").rlike("^[ \\t\\r\\n\\x0B\\f]*$")
    edges = rows.groupBy("conv_id", "seg").agg(F.max_by(blank, F.struct("line_no", "line")).alias("blank"))
    w = Window.partitionBy("conv_id").orderBy("seg")  # one row a segment
    edges = edges.select(
        "conv_id",
        "seg",
        F.coalesce(F.lag("blank").over(w), F.lit(False)).alias("after_blank"),
        (F.row_number().over(w) == 1).alias("opens"),
        (F.count("*").over(Window.partitionBy("conv_id")) > 1).alias("long"),
    )
    none = F.array(*[F.lit(None).cast("string")] * len(ROLES))
    edges = edges.join(own_markers(rows), "conv_id", "left").withColumn("own", F.coalesce("own", none))
    return rows.join(stored(edges, "segments"), ["conv_id", "seg"])


def _seen(part: list[tuple]) -> list[tuple[int, ...]]:
    """Features of a segment's lines. Columns: conv_id, seg, line_no, line, own, after_blank, ..."""
    after = [part[0][5], *(not r[3].strip(BLANK) for r in part[:-1])]
    return [look(r[3], a, r[4]) for r, a in zip(part, after, strict=True)]


def fit(labelled: DataFrame) -> Hmm:
    """labelled: conv_id, line_no, line, role, first (and seg). Counts of starts, moves and features; moves between segments are left out."""
    python_batches(labelled.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for rows in _segments(batches):
            prior = None
            for (*_, opens, role, first), seen in zip(rows, _seen(rows), strict=True):
                if role in ROLES:
                    state = 2 * ROLES.index(role) + (not first)
                    if prior is not None or opens:
                        counts[(-1, -1 if prior is None else prior, state)] += 1
                    counts.update((f, state, v) for f, v in enumerate(seen))
                    prior = state
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k[i] for k in keys], pa.int32()) for i in range(3)), pa.array([counts[k] for k in keys], pa.int64())], names=["f", "a", "b", "n"]
        )

    starts, moves, emits = np.zeros(STATES), np.zeros((STATES, STATES)), [np.zeros((STATES, s)) for s in SIZES]
    counted = _dealt(_ready(labelled), "own", "after_blank", "opens", "role", "first").mapInArrow(count, "f int, a int, b int, n bigint")
    for r in counted.groupBy("f", "a", "b").agg(F.sum("n").alias("n")).collect():  # under 200 rows
        if r.f >= 0:
            emits[r.f][r.a, r.b] += r.n
        elif r.a < 0:
            starts[r.b] += r.n
        else:
            moves[r.a, r.b] += r.n
    for s in range(STATES):
        if s % 2 == 0:  # a marker speaks for its role even where no transcript was labelled
            emits[0][s, s // 2] += 3.0
        else:  # a later line may begin like a marker
            emits[0][s, : len(ROLES)] += 0.01 * emits[0][s].sum()
        emits[0][s, len(ROLES)] += 3.0
    return Hmm(starts, moves, emits)


def parse(lines: DataFrame, model: Hmm) -> DataFrame:
    """lines: conv_id, line_no, line (and seg, which grows with line_no).

    Returns conv_id, seg, line_no, line without its marker (null: it was nothing else), role, first, turn.
    """
    python_batches(lines.sparkSession)
    rows = stored(_ready(lines), "transcript")

    def scores(part: list[tuple]) -> np.ndarray:
        return model.scores(np.array(_seen(part)))

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _segments(batches):
            m = model.transfer(scores(part), part[0][6])
            yield pa.RecordBatch.from_pydict(
                {"conv_id": [part[0][0]], "seg": [part[0][1]], "m": [m.ravel().tolist()]},
                schema=pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("m", pa.list_(pa.float64()))]),
            )

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        """The states at the segment ends of one conversation, from one matrix for each segment."""
        pdf = pdf.sort_values("seg")
        v, back = np.zeros(STATES), []
        for m in (np.array(x).reshape(STATES, STATES) for x in pdf["m"]):
            each = v[:, None] + m
            back.append(each.argmax(0))
            v = each.max(0)
        last = [int(v.argmax())]
        for b in back[:0:-1]:
            last.append(int(b[last[-1]]))
        last = last[::-1]
        return pd.DataFrame({"conv_id": pdf["conv_id"], "seg": pdf["seg"], "state_before": pd.array([None, *last[:-1]], "Int32"), "state_last": last})

    cuts = (
        _dealt(rows.where("long"), "own", "after_blank", "opens")
        .mapInArrow(transfers, "conv_id bigint, seg bigint, m array<double>")
        .groupBy("conv_id")
        .applyInPandas(ends, "conv_id bigint, seg bigint, state_before int, state_last int")
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _segments(batches):
            states = np.array(model.decode(scores(part), part[0][6], part[0][7]))
            first = states % 2 == 0
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in part], pa.int64()) for k in range(3)] + [
                    pa.array([body_of(r[3], s // 2, r[4]) if s % 2 == 0 else r[3] for r, s in zip(part, states.tolist(), strict=True)], pa.string()),
                    pa.array([ROLES[s // 2] for s in states], pa.string()),
                    pa.array(first),
                    pa.array(first.cumsum(), pa.int64()),
                ],
                names=["conv_id", "seg", "line_no", "line", "role", "first", "nth"],
            )

    dealt = _dealt(rows.join(cuts, ["conv_id", "seg"], "left"), "own", "after_blank", "state_before", "state_last")
    found = stored(dealt.mapInArrow(decode, "conv_id bigint, seg bigint, line_no bigint, line string, role string, first boolean, nth bigint"), "states")
    opened = found.groupBy("conv_id", "seg").agg(F.max("nth").alias("n"))
    w = Window.partitionBy("conv_id").orderBy("seg")
    offset = opened.select("conv_id", "seg", (F.sum("n").over(w) - F.col("n")).alias("offset"))
    return found.join(offset, ["conv_id", "seg"]).select(
        "conv_id", "seg", "line_no", "line", "role", "first", (F.col("offset") + F.col("nth") - 1).alias("turn")
    )


def render(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, role, n_lines, rendered: each turn as <|role|>, its text, <|end|>."""
    turns = parsed.groupBy("conv_id", "turn").agg(
        F.first("role").alias("role"), F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("seg", "line_no", "line"))).alias("rows")
    )
    text = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")  # without the nulls
    return turns.select("conv_id", "turn", "role", "n_lines", F.concat(F.lit("<|"), "role", F.lit("|>\n"), text, F.lit("\n<|end|>")).alias("rendered"))


def transcripts(conversations: DataFrame) -> DataFrame:
    """Raw transcripts of a table of turns, as people paste them: conv_id, seg, line_no, line, role, first.

    A conversation has one of five marker forms and one name for each role; an eighth of the turns lack the marker.
    """
    turns = conversations.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")
    )
    copy = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")) - 1
    turns = turns.withColumn("seg", (F.floor(F.col("turn") / 64) * F.lit(1 << 24) + copy).cast("bigint"))
    form, pick = F.pmod(F.xxhash64("conv_id"), F.lit(5)), F.pmod(F.xxhash64("conv_id", F.lit(1)), F.lit(4)).cast("int")
    name = F.initcap(F.coalesce(*(F.when(F.col("role") == r, F.element_at(F.array(*map(F.lit, NAMES[r][:4])), pick + 1)) for r in ROLES)))
    marker = F.when(form == 0, F.concat(name, F.lit(": "))).when(form == 1, F.concat(F.lit("### "), name, F.lit("\n"))).when(form == 2, F.concat(F.lit("["), name, F.lit("] "))).when(
        form == 3, F.concat(F.lit("<|"), F.lower(name), F.lit("|>\n"))
    ).otherwise(F.concat(F.lit("**"), name, F.lit("**: ")))
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0
    whole = F.when(bare | name.isNull(), F.col("text")).otherwise(F.concat(marker, F.col("text")))
    return turns.select("conv_id", "seg", "turn", "role", F.posexplode(F.split(whole, "\n"))).select(
        "conv_id",
        "seg",
        (F.col("turn") * F.lit(1 << 24) + F.col("pos")).alias("line_no"),
        F.col("col").alias("line"),
        "role",
        (F.col("pos") == 0).alias("first"),
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = transcripts(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    model = fit(raw.where(fold("conv_id", 5) != 0))
    parsed = parse(raw.select("conv_id", "seg", "line_no", "line"), model)
    return render(parsed).select("conv_id", "turn", "role", "n_lines", F.sha2("rendered", 256).alias("rendered_sha256"))
