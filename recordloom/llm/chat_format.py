"""Chat formatting by event-sourced reconstruction of conversations."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


#: Marks of the template.
TURN, END, ASK, ASKED = "<s>", "</s>", "[INST] ", " [/INST]"
#: A control string with any number of backslashes after its first character; escaping adds one, unescaping takes one.
_CONTROL = re.compile(r"(<|\[)(\\*)(/?s>|/?INST\])")
_ESCAPED = re.compile(r"(<|\[)\\(\\*)(/?s>|/?INST\])")
#: What each event does to the messages of its turn; of events with one sequence number, in this order.
KINDS = ("message", "regenerate", "edit", "delta")
ASSISTANT = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def fold(events: list[tuple]) -> list[tuple[str, str]]:
    """Final (role, text) messages of one turn, from (kind, role, text) in order.

    message: begins a message. delta: adds to the last one. edit: replaces its text. regenerate: empties it, for deltas to
    follow. The last three begin a message where there is none; a role they carry replaces the message's.
    """
    made: list[list] = []
    for kind, role, text in events:
        if kind == "message" or not made:
            made.append([role or "", [] if kind == "regenerate" else [text or ""]])
            continue
        if role is not None:
            made[-1][0] = role
        if kind == "delta":
            made[-1][1].append(text or "")
        else:
            made[-1][1] = [text or ""] if kind == "edit" else []
    return [(role, "".join(parts)) for role, parts in made]


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and start and length of the text in it (code points)."""
    body = escape(text)
    head = f"{TURN}{escape_role(role)}\n{ASK if role == 'user' else ''}"
    return f"{head}{body}{ASKED if role == 'user' else ''}{END}", len(head), len(body)


def parse(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    role, _, body = formatted[len(TURN) : -len(END)].partition("\n")
    role = unescape_role(role)
    return role, unescape(body[len(ASK) : -len(ASKED)] if role == "user" else body)


def from_messages(messages: DataFrame) -> DataFrame:
    """An event log of whole messages (conv_id, turn, role, text): each turn's sequence number is the turn."""
    return messages.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def streamed(messages: DataFrame, piece: int = 48) -> DataFrame:
    """An event log as a chat client leaves it, from whole messages (conv_id, turn, role, text), whose fold gives them back.

    By a hash of the message, it comes whole; or begins empty and is streamed in deltas of piece characters; or is a draft that an
    edit replaces; or a draft that is regenerated and streamed anew; or is streamed, edited to a part, and goes on in deltas.
    Messages that share a turn follow each other by role and text. A null text is empty, as in the fold.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    nth = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy(role, text))
    d = messages.select("conv_id", "turn", role.alias("role"), text.alias("text"), nth.alias("nth"), F.pmod(F.xxhash64("conv_id", "turn", "role", "text"), F.lit(5)).alias("way"))
    event = lambda kind, x, who=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if who is None else who).alias("role"), x.alias("text"))
    none = F.lit(None).cast("string")
    deltas = lambda x: F.transform(F.regexp_extract_all(x, F.lit(rf"(?s).{{1,{piece}}}"), 0), lambda p: event("delta", p))
    half = F.expr("char_length(text) div 2")
    first, rest, draft, me = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.char_length("text")), F.reverse("text"), F.col("role")
    log = (F.when(F.col("way") == 0, F.array(event("message", F.col("text"), me)))
           .when(F.col("way") == 1, F.concat(F.array(event("message", F.lit(""), me)), deltas(F.col("text"))))
           .when(F.col("way") == 2, F.array(event("message", draft, F.lit("draft")), event("edit", F.col("text"), me)))
           .when(F.col("way") == 3, F.concat(F.array(event("message", draft, me), event("regenerate", none)), deltas(F.col("text"))))
           .otherwise(F.concat(F.array(event("message", F.lit(""), me)), deltas(draft), F.array(event("edit", first)), deltas(rest))))
    each = d.select("conv_id", "turn", "nth", F.posexplode(log).alias("at", "e"))
    seq = F.col("nth").cast("long") * F.lit(1 << 32) + F.col("at")
    return each.select("conv_id", "turn", seq.alias("seq"), "e.kind", "e.role", "e.text")


def _groups(cols: dict, keys: tuple[str, ...], state: list) -> Iterator[tuple]:
    """Rows gathered by keys over batches that come sorted; the last group stays in state."""
    names = list(cols)
    for row in zip(*cols.values()):
        r = dict(zip(names, row))
        k = tuple(r[x] for x in keys)
        if state and state[0] != k:
            yield tuple(state)
            state.clear()
        if not state:
            state[:] = [k, []]
        state[1].append(r)


def format_chats(events: DataFrame) -> DataFrame:
    """Events (conv_id, turn, seq, kind, role, text) to one row per final message: conv_id, turn, place, role, formatted,
    loss_start, loss_length (code points of the text in formatted; null unless the role is assistant).

    Events are dealt by conversation and turn, so that one long conversation is no task's alone, sorted by seq and folded;
    a conversation's output is its rows' formatted strings by (turn, place). Events that share a seq go by kind, role, text.
    Null ids and turns are values of their own, first; a null role or text counts as empty; an unknown kind raises; repeated
    events each count; an empty log gives no rows; texts of any length are kept whole; further columns are ignored.
    """
    kind_rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    ranked = events.select("conv_id", "turn", "seq", F.when(F.coalesce(kind_rank, F.lit(0)) > 0, kind_rank).otherwise(F.raise_error(F.lit("unknown kind of event")).cast("long")).alias("rank"), "kind", "role", "text")
    dealt = ranked.repartition("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "seq", "rank", "role", "text").drop("rank", "seq")

    def run(batches):
        import pyarrow as pa

        state: list = []
        names = ["conv_id", "turn", "place", "role", "formatted", "loss_start", "loss_length"]

        def rows_of(group):
            (conv, turn), rows = group
            for place, (role, text) in enumerate(fold([(r["kind"], r["role"], r["text"]) for r in rows])):
                formatted, start, length = render(role, text)
                loss = role == ASSISTANT
                yield conv, turn, place, role, formatted, start if loss else None, length if loss else None

        def batch(rows):
            cols = list(zip(*rows)) if rows else [()] * len(names)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for b in batches:
            out = [x for g in _groups({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}, ("conv_id", "turn"), state) for x in rows_of(g)]
            yield batch(out)
        if state:
            yield batch(list(rows_of(state)))

    cast = dealt.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "kind", "role", "text")
    return cast.mapInArrow(run, "conv_id bigint, turn bigint, place int, role string, formatted string, loss_start bigint, loss_length bigint")


def digests(formatted: DataFrame) -> DataFrame:
    """Read back from formatted output, a row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. A conversation's rows stream through one task in order, as its digests need; only their state is held."""
    dealt = formatted.select("conv_id", "turn", "place", "formatted", "loss_start", "loss_length").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "place")

    def run(batches):
        import pyarrow as pa

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, key = None, object()

        def done(s):
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        for b in batches:
            out = []
            for conv, _, _, text, start, length in zip(*(b.column(i).to_pylist() for i in range(6))):
                if now is None or key != conv:
                    if now:
                        out.append(done(now))
                    now, key = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], conv
                role, body = parse(text)
                now[1] += 1
                now[2].update(f"{role}\n{body}\n".encode())
                if start is not None:
                    learned = unescape(text[start : start + length])
                    now[3] += len(learned)
                    now[4].update(learned.encode())
                now[5] += len(text)
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(done(now), kinds)], names=names)

    return dealt.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
