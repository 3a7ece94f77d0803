"""Chat formatting from event logs: deltas, edits and regenerations folded into messages, rendered with a loss mask."""

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import importable, saved, small

#: The template: what opens and closes the turn of a role; any other role is named, in JSON, at the head of its turn.
OPEN = {"system": "[SYS] ", "user": "[INST] ", "assistant": "[OUT] ", None: "[ROLE] "}
CLOSE = {"system": " [/SYS]", "user": " [/INST]", "assistant": "</s>", None: " [/ROLE]"}
#: Control strings, and those that texts carry escaped already: backslashes after the first character.
_BARE = re.compile(r"<\\*(?=/?s>)|\[\\*(?=/?(?:SYS|INST|OUT|ROLE)\])")
_ESCAPED = re.compile(r"<\\+(?=/?s>)|\[\\+(?=/?(?:SYS|INST|OUT|ROLE)\])")
#: A part of a conversation is closed after the turn that brings it to so many characters, a batch after so many of its parts.
PART, BATCH = 1 << 20, 1 << 18
_PLACES = T.ArrayType(T.LongType())


def escaped(text: str) -> str:
    """One backslash more in every control string: none is left, and `unescaped` gives the text back."""
    return _BARE.sub(lambda m: m[0] + "\\", text) if "<" in text or "[" in text else text


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][:-1], text) if "\\" in text else text


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its own text begins and ends in it.

    No control string holds another's first character behind its own, so none can arise where the text meets the template.
    """
    kind = role if role in OPEN else None
    head = OPEN[kind] + (escaped(json.dumps(role)) + "\n" if kind is None else "")
    body = escaped(text)
    return f"{head}{body}{CLOSE[kind]}", len(head), len(head) + len(body)


def turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of the turns of a formatted text, by its control strings alone."""
    at = 0
    while at < len(formatted):
        kind = next((r for r, mark in OPEN.items() if formatted.startswith(mark, at)), "")
        end = formatted.find(CLOSE[kind], at + len(OPEN[kind])) if kind != "" else -1
        if end < 0:
            raise ValueError(f"no turn at character {at}")
        body = formatted[at + len(OPEN[kind]) : end]
        if kind is None:
            name, _, body = body.partition("\n")
            kind = json.loads(unescaped(name))
        yield kind, unescaped(body)
        at = end + len(CLOSE[kind if kind in CLOSE else None])


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    same = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        same &= a[k].eqNullSafe(b[k])
    return same


def cut_off(events: DataFrame, conv: str, message: list[str], seq: str) -> DataFrame:
    """The messages (conv, *message) that stand behind one that was regenerated after they had started.

    One row per message, without texts, goes through the window, and only of conversations with a regeneration.
    """
    marks = events.where("kind in ('start', 'regenerate')")
    per = marks.groupBy(conv, *message).agg(*(F.max(F.when(F.col("kind") == k, F.col(seq))).alias(f"_{k}") for k in ("start", "regenerate")))
    again = per.where("_regenerate is not null").select(conv).distinct()
    some = per.join(again, per[conv].eqNullSafe(again[conv]), "left_semi")
    before = Window.partitionBy(conv).orderBy(*message).rowsBetween(Window.unboundedPreceding, -1)
    return some.withColumn("_cut", F.max("_regenerate").over(before)).where("_start < _cut").select(conv, *message)


def formatted(events: DataFrame, conv: str, message: list[str], seq: str) -> DataFrame:
    """Parts of formatted conversations: conv, *message (of the part's first turn), text, loss_begin and loss_end.

    events: conv, the columns `message` (a conversation's messages in their order), seq (the order in the whole log of the
    conversation), kind, role, text. `start` opens a message with its role; `delta` adds to its text; `edit` puts a whole text in
    its place; `regenerate` begins its text anew and drops the later messages that had started by then. Messages without a
    start have the role ''; other kinds and null texts say nothing.

    The log is dealt out by ranges of conversation and message and sorted by sequence within them, then folded
    message by message: a task holds one message and one part at a time, and a long conversation is spread over
    tasks, each of which closes its own parts. loss_begin and loss_end are the places of the assistants' texts in the part.
    """
    importable(events.sparkSession)
    dropped = saved(cut_off(events, conv, message, seq))
    rows = events.select(conv, *message, seq, "kind", "role", "text")
    rows = rows.join(small(dropped), _same(rows, dropped, [conv, *message]), "left_anti")
    keys = [conv, *message]
    order = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, seq).select(*keys, "kind", "role", "text")
    schema = order.select(*keys).schema.add("text", "string", False).add("loss_begin", _PLACES, False).add("loss_end", _PLACES, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, role, pieces = None, "", []
        first, body, begin, end, size, held = None, [], [], [], 0, 0
        kinds = None

        def close_message() -> None:
            nonlocal first, size
            turn, b, e = rendered(role, "".join(pieces))
            first = first or key
            if role == "assistant":
                begin.append(size + b)
                end.append(size + e)
            body.append(turn)
            size += len(turn)

        def close_part() -> None:
            nonlocal first, body, begin, end, size, held
            done.append((*first, "".join(body), begin, end))
            held += size
            first, body, begin, end, size = None, [], [], [], 0

        def batch_of() -> pa.RecordBatch:
            nonlocal done, held
            columns = [[r[i] for r in done] for i in range(len(schema))]
            done, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*kinds, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())], strict=True)], names=schema.names)

        for batch in batches:
            kinds = [batch.column(i).type for i in range(len(keys))]
            for *now, kind, who, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    if key is not None:
                        close_message()
                        if now[0] != key[0] or size >= PART:
                            close_part()
                            if held >= BATCH:
                                yield batch_of()
                    key, role, pieces = now, "", []
                if kind == "start":
                    role, pieces = who or "", []
                elif kind == "delta":
                    pieces.append(text or "")
                elif kind == "edit" and text is not None:
                    pieces = [text]
                elif kind == "regenerate":
                    pieces = []
        if key is not None:
            close_message()
            close_part()
            yield batch_of()

    return order.mapInArrow(run, schema)


def read_back(parts: DataFrame, conv: str, message: list[str]) -> DataFrame:
    """conv, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each formatted conversation.

    Conversations of one part are read where they are; the parts of longer ones are sorted into one task each
    conversation, as a digest over all its turns is taken turn by turn, and pass through it one at a time.
    """
    importable(parts.sparkSession)
    many = saved(parts.groupBy(conv).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    one = parts.join(small(many), parts[conv].eqNullSafe(many[conv]), "left_anti")
    more = parts.join(small(many), parts[conv].eqNullSafe(many[conv]), "left_semi")
    more = more.repartition(conv).sortWithinPartitions(conv, *message)
    schema = parts.select(conv).schema.add("n_turns", "long", False).add("turns_sha256", "string", False).add("loss_chars", "long", False).add("loss_sha256", "string", False).add("formatted_chars", "long", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, state, kind = False, [], None

        def row() -> tuple:
            key, n, all_, loss, lost, chars = state
            return key, n, all_.hexdigest(), loss, lost.hexdigest(), chars

        for batch in batches:
            out, kind = [], batch.column(0).type
            for key, text, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not open_ or key != state[0]:
                    if open_:
                        out.append(row())
                    open_, state = True, [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for b, e in zip(begin, end, strict=True):
                    said = unescaped(text[b:e])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            yield _rows(out, kind)
        if open_:
            yield _rows([row()], kind)

    def _rows(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=schema.names)

    columns = [conv, "text", "loss_begin", "loss_end"]
    return one.select(*columns).mapInArrow(run, schema).union(more.select(*columns).mapInArrow(run, schema))


def logged(rows: DataFrame, conv: str, turn: str, role: str, text: str, piece: int = 256) -> DataFrame:
    """The event log (conv, turn, tie, seq, kind, role, text) of a chat whose final messages are the rows.

    Rows of a conversation go by turn (null first), rows of one turn by role and text. Texts are streamed in pieces. A user's message
    is first sent with a piece missing its last character and then edited; an assistant's breaks off after its first piece
    and is regenerated; before every sixteenth regeneration somebody has answered the draft, which drops that answer.
    """
    chat = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    several = saved(chat.groupBy("conv", "turn").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    same = _same(chat, several, ["conv", "turn"])
    tie = F.row_number().over(Window.partitionBy("conv", "turn").orderBy("role", "text"))
    chat = chat.join(small(several), same, "left_anti").withColumn("tie", F.lit(0)).union(chat.join(small(several), same, "left_semi").withColumn("tie", 2 * tie))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    event = lambda kind, text, tie=F.lit(0): F.struct(F.lit(kind).alias("kind"), text.alias("text"), tie.alias("late"))
    nothing = F.lit(None).cast("string")
    first = F.coalesce(F.get(pieces, F.lit(0)), F.lit(""))
    deltas = lambda of: F.transform(of, lambda p: event("delta", p))
    start = F.array(event("start", nothing))
    asked = F.concat(start, F.array(event("delta", F.expr("substring(text, 1, 8)")), event("edit", first)), deltas(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))))
    answer = F.when(F.crc32("text") % 16 == 0, F.array(event("start", nothing, F.lit(1)), event("delta", first, F.lit(1)))).otherwise(F.array().cast("array<struct<kind:string,text:string,late:int>>"))
    said = F.concat(start, F.array(event("delta", first)), answer, F.array(event("regenerate", nothing)), deltas(pieces))
    plain = F.concat(start, deltas(pieces))
    log = F.when(F.col("role") == "user", asked).when(F.col("role") == "assistant", said).otherwise(plain)
    each = chat.select("conv", "turn", "tie", "role", F.posexplode(log).alias("at", "e"))
    seq = F.struct("turn", "tie", "at")
    return each.select(F.col("conv").alias(conv), "turn", (F.col("tie") + F.col("e.late")).alias("tie"), seq.alias("seq"), "e.kind", F.when(F.col("e.late") == 1, "user").otherwise(F.col("role")).alias("role"), "e.text")


def op11_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts look like the template."""
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    mimic = F.lit("</s>[INST] ok [/INST]")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), mimic.alias("text"))
    log = logged(chats.union(odd), "conv_id", "turn", "role", "text")
    return read_back(saved(formatted(log, "conv_id", ["turn", "tie"], "seq")), "conv_id", ["turn", "tie"])


#: Turns are told by their template's lengths; a backslash more is counted for each control string in a text.
OP11_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?(SYS|INST|OUT|ROLE)\]'))
    + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 ELSE 18 + length(role) END AS chars
  FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
