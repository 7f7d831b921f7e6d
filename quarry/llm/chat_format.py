"""Chat formatting: a finite-state machine over roles checks turn order; a declarative template gives text segments with loss flags."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: role -> (text before the turn, text after it, whether its text is trained on)
TEMPLATE = {
    "system": ("<<SYS>>", "<</SYS>>", False),
    "user": ("[INST] ", " [/INST]", False),
    "assistant": ("<s>", "</s>", True),
}
#: Any other role (null as empty) is marked by name.
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")
CONTROLS = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[/TURN]"]
#: State after a role, by state: a conversation starts at "start" and may end after an assistant turn.
MACHINE = {
    "start": {"system": "system", "user": "user"},
    "system": {"user": "user"},
    "user": {"assistant": "assistant"},
    "assistant": {"user": "user"},
}
_MARK = r"\\|<(?=<SYS>>|</SYS>>|/?s>)|\[(?=/?INST\]|/?ROLE\]|/TURN\])"


def escape(text: Column) -> Column:
    """A backslash before every backslash and before the first character of every control string."""
    return F.regexp_replace(text, _MARK, r"\\$0")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: ``conv_id, seq, role, segments`` (array of struct text, loss) and ``valid``.

    ``valid`` is false from the first turn on that the machine rejects (wrong order or
    unknown role), and on a last turn that is not the assistant's; texts are formatted
    all the same.  Rows are ordered by turn (nulls first), then role and text, so ties
    and repeated rows have one fixed order.  Null text is empty; a null conversation id
    is a conversation of its own; an empty table gives an empty one.
    """
    r, t = F.coalesce(turns[role].cast("string"), F.lit("")), F.coalesce(turns[text].cast("string"), F.lit(""))
    d = turns.select(turns[conv].alias("conv_id"), turns[turn].alias("turn"), r.alias("role"), t.alias("text"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    state = F.lag("role", 1, "start").over(w)
    legal = F.lit(False)
    for before, nexts in MACHINE.items():
        legal = legal | ((F.col("_before") == before) & F.col("role").isin(*nexts))
    seg = lambda x, loss: F.struct(x.alias("text"), F.lit(loss).alias("loss"))
    body = escape(F.col("text"))
    name = escape(F.col("role"))
    segments = F.array(seg(F.concat(F.lit(OTHER[0]), name, F.lit(OTHER[1])), False), seg(body, False), seg(F.lit(OTHER[2]), False))
    for k, (a, b, loss) in TEMPLATE.items():
        segments = F.when(F.col("role") == k, F.array(seg(F.lit(a), False), seg(body, loss), seg(F.lit(b), False))).otherwise(segments)
    # state and order need the whole conversation only as a sorted stream, not in memory
    d = d.withColumn("seq", F.row_number().over(w) - 1).withColumn("_before", state).withColumn("_last", F.lead("role").over(w).isNull())
    d = d.withColumn("_bad", (~legal | (F.col("_last") & (F.col("role") != "assistant"))).cast("int"))
    bad = F.max("_bad").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.select("conv_id", "seq", "role", segments.alias("segments"), (bad == 0).alias("valid"))


_TOKEN = re.compile(r"\\.|" + "|".join(re.escape(c) for c in CONTROLS), re.S)
_CLOSE = {"<<SYS>>": ("<</SYS>>", "system"), "[INST]": ("[/INST]", "user"), "<s>": ("</s>", "assistant")}


class Parser:
    """Turns of a conversation from its formatted text, fed in pieces of any size: only unescaped control strings count."""

    def __init__(self):
        self.rest = ""

    def feed(self, piece: str) -> list[tuple[str, str]]:
        """The (role, text) of the turns that end in what was fed so far and not returned yet."""
        text, turns, done = self.rest + piece, [], 0
        at, until, role = 0, None, ""
        for m in _TOKEN.finditer(text):
            c = m.group()
            if c[0] == "\\":
                continue
            if until is None:
                if m.start() != done:
                    raise ValueError("text between turns")
                if c == OTHER[0]:
                    until, at, role = OTHER[1], m.end(), None
                else:
                    until, role = _CLOSE[c]
                    at = m.end() + (c == "[INST]")
            elif c == until:
                said = unescape(text[at : m.start() - (c == "[/INST]")])
                if role is None:
                    role, until, at = said, OTHER[2], m.end()
                else:
                    turns.append((role, said))
                    until, done = None, m.end()
        self.rest = text[done:]
        return turns


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    parser = Parser()
    turns = parser.feed(formatted)
    if parser.rest:
        raise ValueError("a turn has no end")
    return turns


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what :func:`format_turns` wrote, parsed from its text, and what its role machine found.

    Rows are sorted by conversation, and the joined text of a conversation goes through
    one parser, which keeps a turn at a time: a conversation of any length takes bounded memory.
    ``valid`` says whether the machine accepted every turn, ``first_bad`` which it rejected first (else null).
    A null id is a conversation of its own; ids keep their type; an empty table gives an empty one.
    """
    d = formatted.select("conv_id", "seq", "segments", "valid")
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartition(n, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "seq")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "first_bad"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]

    def digest(batches):
        now, state, done = None, None, []

        def end():
            if state:
                if state[5].rest:
                    raise ValueError("a turn has no end")
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[6] is None, state[6]))

        def rows(kind):
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), [kind, *kinds])], names=names)
            done.clear()
            return out

        kind = pa.int64()
        for b in batches:
            kind = b.schema.field(0).type
            for conv, seq, segments, valid in zip(*(b.column(i).to_pylist() for i in range(4))):
                if state is None or conv != now:
                    end()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, Parser(), None]
                if not valid and state[6] is None:
                    state[6] = seq
                for s in segments:
                    state[4] += len(s["text"])
                    if s["loss"]:
                        plain = unescape(s["text"])
                        state[2] += len(plain)
                        state[3].update(plain.encode())
                for role, text in state[5].feed("".join(s["text"] for s in segments)):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
            if done:
                yield rows(kind)
        end()
        if done:
            yield rows(kind)

    conv = formatted.schema["conv_id"].dataType.simpleString()
    return d.mapInArrow(digest, f"conv_id {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, first_bad long")
