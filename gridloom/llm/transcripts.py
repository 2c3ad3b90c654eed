"""Transcript parsing: roles of a plain transcript's lines by a hidden Markov model, then canonical rendering.

States are the four roles (system, user, assistant, other), each as the first line of a
turn or a later one. A transcript's marker style, a shape such as "Name: " or "[Name] "
with a naming such as user and assistant, is a hidden variable of its own: the style that
explains most marker-like lines is taken, the first listed at a tie. A line is observed as
a marker of that style (of which role), as one of other styles, or as none, and by
line features (an end in a question mark, its length class, a blank line before).
Viterbi reads roles off whole transcripts. Only what is a marker in the transcript's own
style is taken off a turn's text, so an answer that begins "Answer: " keeps its words.

The model's counts come from a bounded, documented sample of conversations outside the
held-out fold, written as transcripts in the styles FIT_STYLES with some markers left
out. The query writes every conversation in a style that none of its own lines looks
like, held-out styles among them, and parses it back.

A conversation of more than PART_ROWS turns is never gathered: its rows are sorted and cut
into parts, each part gives the best score from every state before it to every state at
its end, one scan a conversation over these small matrices fixes the states at the
borders, and each part is decoded between them. The path is the one that Viterbi finds
on the whole.

Defined results: null and empty texts are one empty line; null and unknown roles are
the role other; rows of one conversation are ordered by turn, role and text, null turns last; null
conversations form a group; repeated rows are turns of their own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .tables import ensure_checkpoint_dir, partitions_for

ROLES = ("system", "user", "assistant", "other")
N = len(ROLES)
#: Shapes of markers, as they are written and as they are recognized; a shape whose marker fills its line ends in a line break.
SHAPES = {"colon": ("{}: ", r"({}):(?: |$)"), "heading": ("### {}\n", r"### ({})$"), "bracket": ("[{}] ", r"\[({})\](?: |$)"), "angle": ("{}> ", r"({})>(?: |$)"), "pipes": ("<|{}|>\n", r"<\|({})\|>$"), "stars": ("**{}:** ", r"\*\*({}):\*\*(?: |$)")}
#: Names of user and assistant that go together.
NAMINGS = (("user", "assistant"), ("human", "assistant"), ("human", "ai"), ("q", "a"), ("question", "answer"), ("customer", "agent"), ("user", "bot"), ("user", "model"))
OTHERS = ("other", "tool", "function", "narrator", "unknown")
STYLES = [(shape, naming) for shape in SHAPES for naming in NAMINGS]
#: Styles that the model is fitted on; the rest are held out.
FIT_STYLES = [k for k, (shape, naming) in enumerate(STYLES) if shape not in ("angle", "stars") and naming not in (("customer", "agent"), ("user", "model"))]
NAMES = sorted({"system", *OTHERS, *(x for naming in NAMINGS for x in naming)})
MARKERS = [(shape, re.compile(rule.format("|".join(NAMES)), re.I)) for shape, (_, rule) in SHAPES.items()]
FOREIGN, NONE = N, N + 1
PART_ROWS = 512
#: Conversations that the model is fitted on at most, and turns of each; one fold in FOLDS is held out.
SAMPLE, SAMPLE_TURNS, FOLDS = 2_000, 64, 5
#: Lines of padded transcripts decoded together.
CELLS = 1 << 16
#: One marker in so many is left out where a transcript is written.
SILENT = 6


def role_place(role: str | None) -> int:
    return ROLES.index(role) if role in ROLES else N - 1


def role_of(name: str, naming: tuple[str, str]) -> int | None:
    """The place of the role that a lower-case name has in a naming."""
    return 0 if name == "system" else N - 1 if name in OTHERS else 1 + naming.index(name) if name in naming else None


def marked(line: str) -> tuple[str, str, int] | None:
    """(shape, lower-case name, end of the marker) of a line that looks like one of any style."""
    if line.startswith(("#", "[", "<", "*")) or (line[:1].isalpha() and re.match(r"[A-Za-z]{1,9}[:>]", line)):
        for shape, rule in MARKERS:
            if found := rule.match(line):
                return shape, found[1].lower(), found.end()
    return None


def fitting(line: str) -> list[int]:
    """The styles that a line is a marker of."""
    found = marked(line)
    return [k for k, (shape, naming) in enumerate(STYLES) if found and shape == found[0] and role_of(found[1], naming) is not None]


def style_counts(lines: list[str]) -> np.ndarray:
    out = np.zeros(len(STYLES), np.int64)
    for line in lines:
        out[fitting(line)] += 1
    return out


def chosen_style(counts: np.ndarray) -> int:
    """The style that explains most marker-like lines; -1 where there are none."""
    return int(counts.argmax()) if counts.any() else -1


def writing_style(taken: np.ndarray, salt: int) -> int:
    """The first style from salt on that is not taken: a line of the texts looks like it."""
    order = (np.arange(len(STYLES)) + salt) % len(STYLES)
    free = order[~taken[order]]
    return int(free[0] if len(free) else order[0])


def written(turns: list[tuple], style: int, salt: int) -> list[tuple[str, int, bool]]:
    """Lines of a transcript, each with its turn's place and whether it begins the turn; a blank line ends every turn."""
    shape, naming = STYLES[style]
    names, out = ("System", naming[0].capitalize(), naming[1].capitalize(), "Other"), []
    for k, (turn, role, text) in enumerate(turns):
        mark = SHAPES[shape][0].format(names[role_place(role)])
        if zlib.crc32(f"{salt}/{turn}/{role}/{len(text or '')}".encode()) % SILENT == 0:
            mark = ""
        out += [(line, k, j == 0) for j, line in enumerate((mark + (text or "")).split("\n"))]
        out.append(("", k, False))
    return out


def observed(lines: list[str], style: int) -> np.ndarray:
    """Marker class, ending, length class, blank before: one row a line."""
    out, blank = np.zeros((len(lines), 4), np.int64), 1
    for k, line in enumerate(lines):
        found = marked(line)
        role = found and style >= 0 and found[0] == STYLES[style][0] and role_of(found[1], STYLES[style][1])
        kind = NONE if found is None else FOREIGN if role is None or role is False else role
        out[k] = kind, line.rstrip().endswith("?"), min(4, len(line).bit_length() // 2), blank
        blank = int(not line.strip())
    return out


class RoleModel:
    """Counts of first states, transitions and observations, as logarithms. States: a role's place, plus N for lines that do not begin a turn."""

    sizes = (N + 2, 2, 5, 2)

    def __init__(self):
        self.first, self.step = np.full(2 * N, 0.5), np.full((2 * N, 2 * N), 0.1)
        self.seen = [np.full((2 * N, n), 0.2) for n in self.sizes]
        # Before any count: a turn's first line has its own marker or none, a later line has none.
        self.seen[0][:] = 0.02
        self.seen[0][np.arange(N), np.arange(N)] = 5
        self.seen[0][:N, NONE], self.seen[0][N:, NONE] = 1, 5

    def count(self, states: np.ndarray, features: np.ndarray) -> None:
        self.first[states[0]] += 1
        np.add.at(self.step, (states[:-1], states[1:]), 1)
        for table, column in zip(self.seen, features.T, strict=True):
            np.add.at(table, (states, column), 1)

    def ready(self) -> RoleModel:
        # The sample's texts hold hardly any line that looks like a marker of another style: such lines get a fixed share.
        self.seen[0][N:, FOREIGN] += 0.01 * self.seen[0][N:].sum(axis=1)
        self.seen[0][:N, FOREIGN] += 0.0005 * self.seen[0][:N].sum(axis=1)
        first = np.log(self.first / self.first.sum())
        self.first = np.where(np.arange(2 * N) < N, first, -1e9)  # the first line begins a turn
        allowed = np.array([[b < N or a % N == b - N for b in range(2 * N)] for a in range(2 * N)])  # a later line keeps its role
        self.step = np.where(allowed, np.log(self.step / self.step.sum(axis=1, keepdims=True)), -1e9)
        self.seen = [np.log(t / t.sum(axis=1, keepdims=True)) for t in self.seen]
        return self

    def emitted(self, features: np.ndarray) -> np.ndarray:
        return sum(table[:, column].T for table, column in zip(self.seen, features.T, strict=True))

    def viterbi(self, features: list[np.ndarray], starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> list[np.ndarray]:
        """The likeliest states of each transcript; starts are the states before each (-1: none), ends those of the last lines (-1: free)."""
        free = np.full(len(features), -1)
        starts, ends = free if starts is None else starts, free if ends is None else ends
        length = np.array([len(x) for x in features], np.int64)
        order, out, at = np.argsort(-length, kind="stable"), [None] * len(features), 0
        while at < len(order):  # transcripts of about one length together, the longest first
            part = order[at : at + max(1, CELLS // int(length[order[at]]))]
            for k, states in zip(part, self._viterbi([features[k] for k in part], length[part], starts[part], ends[part]), strict=True):
                out[k] = states
            at += len(part)
        return out

    def _viterbi(self, features: list[np.ndarray], length: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """The same for transcripts of falling length in one padded array."""
        emit = np.zeros((len(features), length[0], 2 * N))
        for row, x in enumerate(features):
            emit[row, : length[row]] = self.emitted(x)
        score = np.where(starts[:, None] < 0, self.first, self.step[starts]) + emit[:, 0]
        back = np.zeros((emit.shape[1], len(features), 2 * N), np.int8)
        for k in range(1, emit.shape[1]):
            live = int((length > k).sum())
            paths = score[:live, :, None] + self.step
            back[k, :live] = paths.argmax(axis=1)
            score[:live] = paths.max(axis=1) + emit[:live, k]
        last = np.where(ends >= 0, ends, score.argmax(axis=1))
        out = []
        for row, n in enumerate(length.tolist()):
            states = np.zeros(n, np.int64)
            states[-1] = last[row]
            for at in range(n - 1, 0, -1):
                states[at - 1] = back[at, row, states[at]]
            out.append(states)
        return out

    def transfer(self, features: np.ndarray) -> np.ndarray:
        """Rows: the best score of every last state, from each state before the part, and in the last row from the beginning of a conversation."""
        emit = self.emitted(features)
        score = np.concatenate([self.step, self.first[None]]) + emit[0]
        for row in emit[1:]:
            score = (score[:, :, None] + self.step).max(axis=1) + row
        return score


def borders(transfers: list[np.ndarray]) -> list[tuple[int, int]]:
    """(state before, last state) of each part on the best path through a conversation's parts."""
    score, back = transfers[0][-1], []
    for matrix in transfers[1:]:
        paths = score[:, None] + matrix[:-1]
        back.append(paths.argmax(axis=0))
        score = paths.max(axis=0)
    ends = [int(score.argmax())]
    for pointers in reversed(back):
        ends.append(int(pointers[ends[-1]]))
    ends.reverse()
    return list(zip([-1, *ends[:-1]], ends, strict=True))


def in_order(turns) -> list[tuple]:
    return sorted(((t["turn"], t["role"], t["text"]) for t in turns), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[2] or ""))


def learn(conversations: DataFrame) -> RoleModel:
    """Counts over the first SAMPLE_TURNS turns or less of the SAMPLE conversations outside the held-out fold least by a hash of their id."""
    named = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").where(F.col("conv_id").isNotNull() & ~held_out())
    chosen = named.select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(SAMPLE)
    rows = named.join(F.broadcast(chosen), "conv_id", "left_semi").where(F.col("turn").between(0, SAMPLE_TURNS - 1))
    least = rows.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("x")).select("conv_id", "turn", "x.role", "x.text")
    sample = least.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns")).orderBy("conv_id").limit(SAMPLE).collect()
    model = RoleModel()
    for at, row in enumerate(sample):
        turns = in_order(row["turns"])
        for k in range(4):
            style = FIT_STYLES[(4 * at + k) % len(FIT_STYLES)]
            lines = written(turns, style, row["conv_id"])
            states = np.array([role_place(turns[j][1]) + (0 if begins else N) for _, j, begins in lines])
            model.count(states, observed([x for x, _, _ in lines], style))
    return model.ready()


def held_out():
    return F.crc32(F.col("conv_id").cast("string")) % FOLDS == 0


def turns_of(lines: list[str], states: np.ndarray, style: int) -> list[tuple[str, str, bool]]:
    """(role, text, continued) of the turns that the states make of lines, markers of the style taken off.

    Where a blank line stands before every turn but the first, it is a separator and goes.
    """
    starts = [k for k in range(len(lines)) if states[k] < N]
    separated = all(k == 0 or lines[k - 1] == "" for k in starts)
    bounds = sorted({0, *starts, len(lines)}) if lines else []
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        held = lines[a:b]
        if separated and b < len(lines) and len(held) > 1 and held[-1] == "":
            held = held[:-1]
        found = marked(held[0]) if style >= 0 and states[a] < N else None
        if found and found[0] == STYLES[style][0] and role_of(found[1], STYLES[style][1]) is not None:
            own_line = SHAPES[found[0]][0].endswith("\n")
            held = held[1:] if own_line else [held[0][found[2] :], *held[1:]]
        out.append((ROLES[states[a] % N], "\n".join(held), bool(states[a] >= N)))
    return out


def rendered(turns: list[tuple[str, str, bool]]) -> str:
    """The canonical form of turns; one that continues the part before has no head."""
    return "".join(("" if continued else f"<|{role}|>\n") + f"{text}\n<|end|>\n" for role, text, continued in turns)


def parse(transcripts: list[str], model: RoleModel) -> list[tuple[int, list[tuple[str, str, bool]]]]:
    """(style, turns) of each raw transcript."""
    lines = [t.split("\n") for t in transcripts]
    styles = [chosen_style(style_counts(x)) for x in lines]
    states = model.viterbi([observed(x, s) for x, s in zip(lines, styles, strict=True)]) if lines else []
    return [(s, turns_of(x, y, s)) for x, y, s in zip(lines, states, styles, strict=True)]


TURNS = "array<struct<role:string,text:string>>"


def parse_transcripts(transcripts: DataFrame, model: RoleModel, key: str = "id", text: str = "text") -> DataFrame:
    """(key, text) of raw transcripts to (key, style, turns, rendered); null texts have no turns."""
    ship(transcripts.sparkSession)
    kind = transcripts.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = iter(parse([t for t in texts if t is not None], model))
            rows = [next(found) if t is not None else (-1, []) for t in texts]
            styles = ["{} {}/{}".format(STYLES[s][0], *STYLES[s][1]) if s >= 0 else None for s, _ in rows]
            turns = pa.array([[{"role": r, "text": x} for r, x, _ in y] for _, y in rows], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(styles, pa.string()), turns, pa.array([rendered(y) for _, y in rows], pa.string())], names=[key, "style", "turns", "rendered"])

    return transcripts.select(key, text).mapInArrow(run, f"{key} {kind}, style string, turns {TURNS}, rendered string")


REPORT = "conv_id long, part long, n_turns long, n_recovered long, n_lines long, n_lines_right long, n_exact long, style_written int, style_found int, continued boolean, rendered string"


def report(conv, part: int, turns: list[tuple], lines: list[tuple], states: np.ndarray, style: int, found: int) -> tuple:
    """A row of REPORT: lines whose role is recovered are right, turns that come out with their role and text exact."""
    right = sum(s % N == role_place(turns[k][1]) for s, (_, k, _) in zip(states, lines, strict=True))
    texts = turns_of([x for x, _, _ in lines], states, found)
    if texts and texts[-1][1].endswith("\n"):  # the blank line after the last turn
        texts[-1] = (texts[-1][0], texts[-1][1][:-1], texts[-1][2])
    exact = sum(x == (ROLES[role_place(r)], t or "", False) for x, (_, r, t) in zip(texts, turns, strict=False)) if len(texts) == len(turns) else 0
    return conv, part, len(turns), len(texts), len(lines), int(right), exact, style, found, bool(texts and texts[0][2]), rendered(texts)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in REPORT.split(", ")])


def taken_styles(turns: list[tuple]) -> np.ndarray:
    return style_counts([line for _, _, t in turns for line in (t or "").split("\n")]) > 0


def parse_conversations(conversations: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Writes each conversation as a plain transcript, recovers its turns and renders them: the columns of REPORT."""
    ship(conversations.sparkSession)
    ensure_checkpoint_dir(conversations.sparkSession)
    model = learn(conversations)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").withColumn("conv", F.coalesce("conv_id", F.lit(-(2**63) + 1)))
    large = rows.groupBy("conv").count().where(F.col("count") > part_rows).select("conv").checkpoint()
    gathered = rows.join(large, "conv", "left_anti").groupBy("conv", "conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))  # part_rows at most

    def whole(batches):
        for batch in batches:
            held, lines, styles = [], [], []
            for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
                held.append((conv, in_order(turns)))
                styles.append(writing_style(taken_styles(held[-1][1]), conv or 0))
                lines.append(written(held[-1][1], styles[-1], conv or 0))
            if held:
                found = [chosen_style(style_counts([x for x, _, _ in own])) for own in lines]
                states = model.viterbi([observed([x for x, _, _ in own], f) for own, f in zip(lines, found, strict=True)])
                yield batch_of([report(c, 0, t, own, s, k, f) for (c, t), own, s, k, f in zip(held, lines, states, styles, found, strict=True)])

    out = gathered.select("conv_id", "turns").mapInArrow(whole, REPORT)
    if large.isEmpty():
        return out
    return out.union(parse_large(rows.join(large, "conv", "left_semi"), model, part_rows))


def parse_large(rows: DataFrame, model: RoleModel, part_rows: int) -> DataFrame:
    """The same for the rows (conv, conv_id, turn, role, text) of conversations that are cut into parts."""
    order = ["conv", F.col("turn").asc_nulls_last(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    ordered = rows.repartitionByRange(partitions_for(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).checkpoint()
    item = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))

    def cut(batches):
        conv, held = None, []

        def part():
            return pa.RecordBatch.from_arrays([pa.array([conv[0]], pa.int64()), pa.array([conv[1]], pa.int64()), pa.array([held[0]["at"]], pa.int64()), pa.array([[{k: x[k] for k in ("turn", "role", "text")} for x in held]], item)], names=["conv", "conv_id", "part", "turns"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and (conv != (row["conv"], row["conv_id"]) or len(held) >= part_rows):
                    yield part()
                    held = []
                conv = row["conv"], row["conv_id"]
                held.append(row)
        if held:
            yield part()

    parts = ordered.mapInArrow(cut, "conv long, conv_id long, part long, turns array<struct<turn:long,role:string,text:string>>")
    plain = lambda turns: [(t["turn"], t["role"], t["text"]) for t in turns]

    def counted(of):
        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    n = of(row)
                    yield pa.RecordBatch.from_arrays([pa.array([row["conv"]] * len(n), pa.int64()), pa.array(range(len(n)), pa.int32()), pa.array(n, pa.int64())], names=["conv", "style", "n"])

        return run

    def lines_of(row) -> list[tuple]:
        return written(plain(row["turns"]), row["style"], row["conv_id"] or 0)

    own_lines = parts.mapInArrow(counted(lambda row: style_counts([x for t in row["turns"] for x in (t["text"] or "").split("\n")])), "conv long, style int, n long")
    salt = F.when(F.col("conv") == -(2**63) + 1, F.lit(0)).otherwise(F.col("conv"))
    place = F.pmod(F.col("style") - F.pmod(salt, F.lit(len(STYLES))), F.lit(len(STYLES)))
    free = own_lines.groupBy("conv", "style").agg(F.sum("n").alias("n")).groupBy("conv").agg(F.min_by("style", F.struct(F.col("n") > 0, place)).alias("style"))
    styled = parts.join(free, "conv")
    explained = styled.mapInArrow(counted(lambda row: style_counts([x for x, _, _ in lines_of(row)])), "conv long, style int, n long")
    best = explained.groupBy("conv", "style").agg(F.sum("n").alias("n")).groupBy("conv").agg(F.min_by(F.when(F.col("n") > 0, F.col("style")).otherwise(-1), F.struct(-F.col("n"), "style")).alias("found"))
    known = styled.join(best, "conv").checkpoint()

    def transfers(batches):
        for batch in batches:
            for row in batch.to_pylist():
                matrix = model.transfer(observed([x for x, _, _ in lines_of(row)], row["found"]))
                yield pa.RecordBatch.from_arrays([pa.array([row["conv"]], pa.int64()), pa.array([row["part"]], pa.int64()), pa.array([matrix.ravel().tolist()], pa.list_(pa.float64()))], names=["conv", "part", "matrix"])

    def scanned(batches):
        for batch in batches:
            for row in batch.to_pylist():
                held = sorted(row["ms"], key=lambda x: x["part"])
                found = borders([np.array(x["matrix"]).reshape(-1, 2 * N) for x in held])
                columns = [pa.array([row["conv"]] * len(held), pa.int64()), pa.array([x["part"] for x in held], pa.int64()), pa.array([a for a, _ in found], pa.int32()), pa.array([b for _, b in found], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["conv", "part", "before", "last"])

    # A conversation's scan holds one matrix of (2 N + 1) * 2 N numbers for part_rows turns.
    scores = known.mapInArrow(transfers, "conv long, part long, matrix array<double>").groupBy("conv").agg(F.collect_list(F.struct("part", "matrix")).alias("ms"))
    fixed = known.join(scores.mapInArrow(scanned, "conv long, part long, before int, last int"), ["conv", "part"])

    def decoded(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                lines = lines_of(row)
                states = model.viterbi([observed([x for x, _, _ in lines], row["found"])], np.array([row["before"]]), np.array([row["last"]]))[0]
                out.append(report(row["conv_id"], row["part"], plain(row["turns"]), lines, states, row["style"], row["found"]))
            if out:
                yield batch_of(out)

    return fixed.mapInArrow(decoded, REPORT)
