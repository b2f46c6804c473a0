"""Roles of transcript lines by a hidden Markov model, and canonical turns.

A hidden state is the role that speaks a line. What is seen of a line: a speaker marker at its start, whether it begins a turn, its
length, and whether it asks. Emissions, the roles' order and how far markers can be trusted are counted over labelled turns; which
names stand for which role is fixed. The most likely roles of a conversation come from Viterbi's recursion.

Lines that look like markers are common in texts that have none: options, answers, quotes. So markers speak only in conversations that
use them, where most turns that say something begin with one and at least two roles are named; elsewhere they are text. A marker is
taken off where the decoded role is the marker's and a turn or another role begins there. All else stays as it is, byte for byte.

A conversation may be of any length. Lines are dealt by ranges of (conversation, turn, line) into pieces of bounded size. A piece
that a conversation runs through is one max-plus matrix from the role before it to the role after it; the matrices of the
pieces' ends, a few numbers a piece, are chained, after which every piece knows where it starts and ends and is decoded by itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

ROLES = ("system", "user", "assistant")
#: Names that stand for the roles, in markers and in role columns.
NAMES = {
    "system": ("system", "instruction", "instructions", "developer"),
    "user": ("user", "human", "customer", "client", "question", "you", "me", "q", "prompter"),
    "assistant": ("assistant", "ai", "bot", "agent", "model", "gpt", "answer", "support", "a", "chatbot"),
}
#: How often a marker names the role that speaks before any has been counted, as of so many; how likely a line within a turn, without a
#: marker, has the role of the one before it.
MARKED, MARKED_OF, STAYS = 0.97, 100, 0.995
#: Conversations with markers that are broadcast at most.
BROADCAST_ROWS = 4_000_000
LENGTHS = 10
PIECE_ROWS = 50_000

_BY_NAME = {n: r for r, names in enumerate(NAMES.values()) for n in names}
_NAME = r"([A-Za-z]{1,14})(?:[ ]?\d{1,3})?"
#: A special token, a heading, bold, in brackets, before a colon or an angle, or alone on its line; one space after it is the marker's.
_FORMS = (r"<\|im_start\|>[ ]?NAME[ ]*\r?\Z", r"<\|NAME\|>[ ]?", r"#{1,6}[ ]*NAME[ ]*(?::[ ]?|\r?\Z)", r"\*{1,2}NAME[ ]*(?::[ ]*\*{1,2}|\*{1,2}[ ]*:?)[ ]?", r"\[NAME\][ ]*:?[ ]?", r"NAME[ ]*[:>][ ]?", r"NAME[ ]*\r?\Z")
_MARKER = re.compile(r"[ \t]*(?:" + "|".join(f.replace("NAME", _NAME) for f in _FORMS) + ")", re.I)


def role_index(name: str | None) -> int | None:
    return _BY_NAME.get((name or "").strip().lower())


def marker(line: str) -> tuple[int | None, str]:
    """The role that a line's start names, and the line without that."""
    m = _MARKER.match(line)
    if m and (role := role_index(next(g for g in m.groups() if g))) is not None:
        return role, line[m.end() :]
    return None, line


def seen(line: str, begins: bool) -> tuple[int, int]:
    """(marker + 1 or 0, symbol of the other features)."""
    role, rest = marker(line)
    length = min(LENGTHS - 1, int(math.log2(len(rest) + 1)))
    return (0 if role is None else role + 1), (length * 2 + rest.rstrip().endswith("?")) * 2 + begins


SYMBOLS = LENGTHS * 4
_LINES = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("row", pa.int64()), ("line", pa.int64()), ("text", pa.string()), ("known", pa.int32()), ("mark", pa.int32()), ("symbol", pa.int32()), ("begins", pa.bool_())])
_LINES_SQL = "conv_id long, turn long, row long, line long, text string, known int, mark int, symbol int, begins boolean"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, turn, row, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "row", "role", "text"))):
            for i, line in enumerate((text or "").split("\n")):
                mark, symbol = seen(line, i == 0)
                rows.append((conv, turn, row, i, line, role_index(role), mark, symbol, i == 0))
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LINES)], schema=_LINES)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LINES)], schema=_LINES)


def lines(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str | None = "role", text_col: str = "text") -> DataFrame:
    """A row for each line of each turn, with what is seen of it, dealt into ordered pieces. Null texts are one empty line."""
    role = F.col(role_col).cast("string") if role_col else F.lit(None).cast("string")
    plain = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), F.col(text_col).cast("string").alias("text"))
    # a row keeps its lines together; its number settles the order of equal (conversation, turn)
    cut = stored(plain.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_cut, _LINES_SQL), "chat-lines")
    pieces = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), cut.count() // PIECE_ROWS + 1)
    dealt = stored(cut.repartitionByRange(pieces, "conv_id", "turn", "row").withColumn("piece", F.spark_partition_id()), "chat-pieces")
    discard(cut)
    return _with_markers(dealt)


def _with_markers(dealt: DataFrame) -> DataFrame:
    """dealt, with mark 0 in conversations that don't use markers. Texts stay where they are as far as BROADCAST_ROWS conversations do."""
    says = F.col("begins") & ((F.col("mark") > 0) | (F.length(F.trim("text")) > 0))
    use = dealt.groupBy("conv_id").agg(F.count_if(says).alias("turns"), F.count_if(F.col("begins") & (F.col("mark") > 0)).alias("marked"), F.count_distinct(F.when(F.col("mark") > 0, F.col("mark"))).alias("roles"))
    using = stored(use.filter("2 * marked > turns AND roles > 1").select(F.col("conv_id").alias("using"), F.lit(True).alias("uses")), "chat-using")
    small = using.count() <= BROADCAST_ROWS
    met = dealt.join(F.broadcast(using) if small else using, F.col("conv_id").eqNullSafe(F.col("using")), "left")
    return met.withColumn("mark", F.when(F.col("uses"), F.col("mark")).otherwise(0)).drop("using", "uses")


def _ordered(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The rows of a piece in order, and where its conversations start."""
    keys = [("conv_id", "ascending"), ("turn", "ascending"), ("row", "ascending"), ("line", "ascending")]
    t = t.take(pc.sort_indices(t, sort_keys=keys, null_placement="at_start"))
    ids = t.column("conv_id").to_pylist()
    return t, np.array([i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]])


class Model:
    def __init__(self, start: np.ndarray, turn: np.ndarray, emit: np.ndarray, marked: float = MARKED):
        n = len(ROLES)
        self.start, self.turn, self.emit = np.log(start), np.log(turn), np.log(emit)
        self.stay = np.log(np.where(np.eye(n, dtype=bool), STAYS, (1 - STAYS) / (n - 1)))
        marks = np.full((n, n + 1), (1 - marked) / n)
        marks[np.arange(n), np.arange(n) + 1] = marked
        marks[:, 0] = 1.0  # no marker says nothing
        self.marks = np.log(marks)

    def steps(self, begins: np.ndarray, mark: np.ndarray, symbol: np.ndarray) -> Iterator[np.ndarray]:
        """For each line the scores of (role before, role now). A marker inside a turn opens one as well."""
        seen = self.marks[:, mark].T + self.emit[:, symbol].T
        for b, m, e in zip(begins, mark, seen):
            yield (self.turn if b or m else self.stay) + e[None, :]

    def first(self, mark: int, symbol: int) -> np.ndarray:
        return self.start + self.marks[:, mark] + self.emit[:, symbol]


_COUNTED = "kind int, i int, j int, n long, piece int, first long, last long, one boolean"
#: Kinds of counted rows, and what a piece's edge may be besides a role: a line of unknown role, or nothing that tells.
EMITS, FOLLOWS, STARTS, MARKS, EDGES = range(5)
UNKNOWN, NOTHING = -1, -2


def _counted(t: pa.Table) -> pa.Table:
    """Counts of a piece, and a row for its edges: what the first conversation first tells (i), the role that the last one ends
    with (j), and whether the piece's first line is a known turn's start (n)."""
    n = len(ROLES)
    t, starts = _ordered(t)
    known, begins, symbol, mark = (t.column(c).to_pylist() for c in ("known", "begins", "symbol", "mark"))
    told = [(k == m - 1, 1) for k, m in zip(known, mark) if k is not None and m]
    emit, turn, start = np.zeros((n, SYMBOLS), int), np.zeros((n, n), int), np.zeros(n, int)
    opens, last, head = set(starts.tolist()), NOTHING, NOTHING
    for i, (k, b, s) in enumerate(zip(known, begins, symbol)):
        if i in opens:
            last = NOTHING
        in_first = len(starts) == 1 or i < starts[1]
        if k is None:
            last = UNKNOWN
        else:
            emit[k, s] += 1
            if not b:
                continue
            if last >= 0:
                turn[last, k] += 1
            elif i in opens and i > 0:  # the first of a piece may continue a conversation, which its edge settles
                start[k] += 1
            last = k
        if in_first and head == NOTHING:
            head = last
    rows = [(EMITS, i, j, int(emit[i, j])) for i in range(n) for j in range(SYMBOLS) if emit[i, j]]
    rows += [(FOLLOWS, i, j, int(turn[i, j])) for i in range(n) for j in range(n) if turn[i, j]] + [(STARTS, i, 0, int(start[i])) for i in range(n) if start[i]]
    rows += [(MARKS, right, 0, n) for right, n in ((1, sum(r for r, _ in told)), (0, sum(not r for r, _ in told))) if n]
    rows.append((EDGES, head, last, int(known[0] is not None and bool(begins[0]))))
    ids = t.column("conv_id")
    columns = [*zip(*rows), [t.column("piece")[0].as_py()] * len(rows), [ids[0].as_py()] * len(rows), [ids[-1].as_py()] * len(rows), [len(starts) == 1] * len(rows)]
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip((("kind", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("piece", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("one", pa.bool_())), columns)})


def train(lined: DataFrame) -> Model:
    """Counts over all lines whose role is known, and over the order of roles, within pieces and over their ends. However the lines
    are dealt into pieces, the counts are the same. Only lines' features move, not their texts."""
    n = len(ROLES)
    narrow = lined.select("piece", "conv_id", "turn", "row", "line", "known", "begins", "mark", "symbol")
    counted = stored(narrow.groupBy("piece").applyInArrow(_counted, _COUNTED), "chat-counts")
    counts = counted.filter(F.col("kind") < EDGES).groupBy("kind", "i", "j").agg(F.sum("n").alias("n")).collect()  # kinds times symbols
    emit, turn, start = np.ones((n, SYMBOLS)), np.ones((n, n)), np.ones(n)
    right, told = MARKED * MARKED_OF, MARKED_OF
    for kind, i, j, c in counts:
        if kind == EMITS:
            emit[i, j] += c
        elif kind == FOLLOWS:
            turn[i, j] += c
        elif kind == MARKS:
            right, told = right + i * c, told + c
        else:
            start[i] += c
    before, held = object(), NOTHING
    for r in counted.filter(F.col("kind") == EDGES).orderBy("piece").toLocalIterator():  # one row a piece
        runs_on = before == r["first"]
        if r["i"] >= 0:
            if runs_on and held >= 0:
                turn[held, r["i"]] += 1
            elif not runs_on and r["n"]:
                start[r["i"]] += 1
        if not (r["one"] and runs_on and r["j"] == NOTHING):  # else the piece is all of one turn, which goes on
            held = r["j"]
        before = r["last"]
    return Model(start / start.sum(), turn / turn.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True), right / told)


_FLOATS = pa.list_(pa.float64())


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(1)


def _ends(lined: DataFrame, model: Model) -> dict[int, tuple]:
    """For each piece what its first and last conversation need of other pieces: (role distribution before it, scores after it).

    The summaries, a few numbers a piece, are chained on the driver.
    """
    schema = "piece int, first long, last long, one boolean, tail array<double>, head array<double>"
    n = len(ROLES)

    def summarise(t: pa.Table) -> pa.Table:
        t, starts = _ordered(t)
        ids = t.column("conv_id")
        begins, mark, symbol = (np.array(t.column(c).to_pylist()) for c in ("begins", "mark", "symbol"))
        edges = [*starts.tolist(), t.num_rows]

        def matrix(a: int, b: int) -> np.ndarray:
            out = None
            for step in model.steps(begins[a:b], mark[a:b], symbol[a:b]):
                out = step if out is None else _product(out, step)
            return out

        head = matrix(edges[0], edges[1])  # the first conversation, if it runs on from before
        tail = model.first(mark[edges[-2]], symbol[edges[-2]])  # the last conversation, if it begins here
        for step in model.steps(begins[edges[-2] + 1 :], mark[edges[-2] + 1 :], symbol[edges[-2] + 1 :]):
            tail = (tail[:, None] + step).max(0)
        one = len(starts) == 1
        return pa.table({"piece": pa.array([t.column("piece")[0].as_py()], pa.int32()), "first": pa.array([ids[0].as_py()], pa.int64()), "last": pa.array([ids[-1].as_py()], pa.int64()), "one": pa.array([one], pa.bool_()), "tail": pa.array([tail.tolist()], _FLOATS), "head": pa.array([head.ravel().tolist()], _FLOATS)})

    narrow = lined.select("piece", "conv_id", "turn", "row", "line", "begins", "mark", "symbol")
    rows = sorted(narrow.groupBy("piece").applyInArrow(summarise, schema).collect(), key=lambda r: r["piece"])  # one row a piece
    before: dict[int, np.ndarray | None] = {}
    carried, carried_id = None, object()
    for r in rows:
        before[r["piece"]] = carried if r["first"] == carried_id else None
        head = np.array(r["head"]).reshape(n, n)
        if r["one"] and before[r["piece"]] is not None:
            carried = (before[r["piece"]][:, None] + head).max(0)
        else:
            carried = np.array(r["tail"])
        carried_id = r["last"]
    after: dict[int, np.ndarray | None] = {}
    following, following_id = None, object()
    for r in reversed(rows):
        after[r["piece"]] = following if r["last"] == following_id else None
        head = np.array(r["head"]).reshape(n, n)
        follows = after[r["piece"]] if r["one"] else None
        following = (head + (follows[None, :] if follows is not None else 0)).max(1)
        following_id = r["first"]
    return {p: (before[p], after[p]) for p in before}


def _viterbi(model: Model, begins: np.ndarray, mark: np.ndarray, symbol: np.ndarray, before: np.ndarray | None, after: np.ndarray | None) -> list[int]:
    scores = None
    back = []
    for i, step in enumerate(model.steps(begins, mark, symbol)):
        if i == 0 and before is None:
            scores = model.first(mark[0], symbol[0])
            back.append(None)
            continue
        paths = (before if i == 0 else scores)[:, None] + step
        back.append(paths.argmax(0))
        scores = paths.max(0)
    role = int((scores + (after if after is not None else 0)).argmax())
    roles = [role]
    for b in reversed(back[1:]):
        role = int(b[role])
        roles.append(role)
    return roles[::-1]


def _rendered(t: pa.Table, roles: list[int]) -> pa.Table:
    """A row for each run of a turn's lines that one role speaks; t is in order. A marker goes where its role begins to speak, and a line
    that is nothing but such a marker goes with it."""
    out: list[list] = []
    at = None
    for conv, turn, row, text, known, mark, role in zip(*(t.column(c).to_pylist() for c in ("conv_id", "turn", "row", "text", "known", "mark")), roles):
        goes_on = row == at and out[-1][3] == role
        taken = mark == role + 1 and not goes_on
        body = marker(text)[1] if taken else text
        kept = [] if taken and not body.strip() else [body]
        if goes_on:
            out[-1][5] += 1
            out[-1][6] += kept
        else:
            out.append([conv, turn, out[-1][2] + 1 if row == at else 0, role, known, 1, kept])
        at = row
    columns = list(zip(*out))
    texts = [f"<|{ROLES[r[3]]}|>\n" + "\n".join(r[6]) + "\n<|end|>" for r in out]
    return pa.table({
        "conv_id": pa.array(columns[0], pa.int64()), "turn": pa.array(columns[1], pa.int64()), "part": pa.array(columns[2], pa.int64()), "role": [ROLES[r] for r in columns[3]],
        "known_role": pa.array([None if k is None else ROLES[k] for k in columns[4]], pa.string()), "n_lines": pa.array(columns[5], pa.int64()), "rendered": texts,
    })


def recover(lined: DataFrame, model: Model) -> DataFrame:
    """(conv_id, turn, part, role, known_role, n_lines, rendered) from lines(): each turn with its role and canonical text.

    A turn row is mostly one part; where a marker hands over inside it, the parts are numbered from 0.
    """
    held = lined.sparkSession.sparkContext.broadcast((model, _ends(lined, model)))  # two short vectors a piece

    def decode(t: pa.Table) -> pa.Table:
        model, ends = held.value
        t, starts = _ordered(t)
        before, after = ends[t.column("piece")[0].as_py()]
        begins, mark, symbol = (np.array(t.column(c).to_pylist()) for c in ("begins", "mark", "symbol"))
        edges, roles = [*starts.tolist(), t.num_rows], []
        for a, b in zip(edges, edges[1:]):
            roles += _viterbi(model, begins[a:b], mark[a:b], symbol[a:b], before if a == 0 else None, after if b == t.num_rows else None)
        return _rendered(t, roles)

    return lined.groupBy("piece").applyInArrow(decode, "conv_id long, turn long, part long, role string, known_role string, n_lines long, rendered string")


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str | None = "role", text_col: str = "text") -> DataFrame:
    """recover() of conversations: (conv_id, turn, part, role, known_role, n_lines, rendered).

    Roles are learned from all labelled turns and recovered from the lines alone; known_role is given for comparison. A null
    text is one empty line; lines end at \\n only, and what isn't a marker of a conversation that uses markers is rendered as it is;
    rows of null ids are one conversation, the first, in order of null turns, turns and rows; equal
    (conv_id, turn) rows follow one another; unknown roles teach nothing. Without labelled turns only markers and turn starts
    speak. An empty table gives no rows; other columns play no part.
    """
    lined = lines(conversations, conv_col, turn_col, role_col, text_col)
    return recover(lined, train(lined))
