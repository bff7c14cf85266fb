"""Chat formatting with linked tool calls.

Messages become events: plain messages, tool calls and tool results
(``parsed`` reads them from logged JSON, ``dialogue`` views a plain dialogue as
requests and replies).  Calls and results are joined by hash on conversation
and identifier.  The events of a conversation are then ordered topologically,
without gathering it: a result comes after its call, and a call after the
results of the calls that its arguments name (a string ``${identifier}``), else
the logged turns hold.  The order is a sort key of each event:

* ``order_turn``: its turn, or a later one of what it must follow;
* ``order_depth`` (if the events have ``needs``): the longest chain of calls
  that a call or result stands on; null for calls on a cycle, or behind one,
  which come last in their turn, with their results;
* ``order_kind``: 0, or 1 for a result; then ``turn``, then ``position`` (the text beside tool
  calls is a message of its own before them, and the calls of one message keep
  their order).

Chains are resolved round by round, as many rounds as the longest has calls.
Arguments are validated against the function's schema, whose keywords must all
be known, and every event is serialised as canonical JSON: sorted keys, no
blanks, non-ASCII as it is, a lone surrogate as U+FFFD.  NaN and infinities are
not JSON: a message with them stays text, such arguments are invalid.

Of calls that share a conversation and identifier the one of the first turn is
answered, the others stay unlinked; several results may answer a call.  A null
identifier links with nothing; a null conversation is one of its own for each
row.  Text that is not a JSON object is a plain message.  Null text is the
JSON null.  Repeated rows stay repeated; extra columns are ignored.  An empty
table gives an empty one.  A very long text is one row of work.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks, written

EVENT = "conv_id long, turn long, kind string, role string, call_id string, name string, arguments string, content string, position long, needs array<string>"

#: What a request of a plain dialogue must look like.
REPLY = {
    "type": "object",
    "properties": {"request": {"type": "string", "minLength": 1, "maxLength": 4000}, "turn": {"type": "integer", "minimum": 0}},
    "required": ["request", "turn"],
    "additionalProperties": False,
}


def _finite(number: str) -> float:
    value = float(number)
    if not math.isfinite(value):
        raise ValueError(f"{number} is beyond JSON numbers here")
    return value


def _reject(name: str):
    raise ValueError(f"{name} is not JSON")


def read(text: str):
    """The value of a JSON text; ValueError for anything else, NaN and infinities included."""
    return json.loads(text, parse_float=_finite, parse_constant=_reject)


def whole(text: str) -> str:
    """``text`` with lone surrogates, which UTF-8 can't hold, as U+FFFD."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def canonical(value) -> str:
    return whole(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "integer": lambda v: isinstance(v, int | float) and not isinstance(v, bool) and v == v // 1,
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
}


KEYWORDS = {"type", "enum", "const", "minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems", "items", "properties", "required", "additionalProperties"}
#: Keywords that only describe.
REMARKS = {"title", "description", "default", "examples", "$schema", "$id", "$comment"}


def checked(schema: dict) -> dict:
    """The schema, if this module knows all its keywords and types; ValueError otherwise."""
    if unknown := set(schema) - KEYWORDS - REMARKS:
        raise ValueError(f"unknown schema keywords: {sorted(unknown)}")
    kinds = schema.get("type", [])
    if unknown := {*([kinds] if isinstance(kinds, str) else kinds)} - set(_TYPES):
        raise ValueError(f"unknown types: {sorted(unknown)}")
    for part in (schema.get("items"), schema.get("additionalProperties"), *schema.get("properties", {}).values()):
        if isinstance(part, dict):
            checked(part)
    return schema


def same(a, b) -> bool:
    """Equality of JSON values: 1 and 1.0 are equal, 1 and true are not."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    return a == b


def valid(value, schema: dict) -> bool:
    """JSON Schema: type, enum, const, bounds of numbers, lengths, items, properties, required, additionalProperties."""
    kind = schema.get("type")
    if kind is not None and not any(_TYPES[k](value) for k in ([kind] if isinstance(kind, str) else kind)):
        return False
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]) or "const" in schema and not same(value, schema["const"]):
        return False
    if _TYPES["number"](value):
        return schema.get("minimum", value) <= value <= schema.get("maximum", value)
    if isinstance(value, str):
        return schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value))
    if isinstance(value, list):
        return schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)) and all(valid(v, schema.get("items", {})) for v in value)
    if isinstance(value, dict):
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        if any(k not in value for k in schema.get("required", ())):
            return False
        return all(valid(v, known[k]) if k in known else more if isinstance(more, bool) else valid(v, more) for k, v in value.items())
    return True


def _needs(value) -> set[str]:
    """The identifiers that a call's arguments name as ``${identifier}``."""
    found, open_ = set(), [value]
    while open_:
        v = open_.pop()
        if isinstance(v, str) and v.startswith("${") and v.endswith("}"):
            found.add(whole(v[2:-1]))
        elif isinstance(v, list):
            open_ += v
        elif isinstance(v, dict):
            open_ += v.values()
    return found


def _text_of(value) -> str | None:
    return None if value is None else whole(value if isinstance(value, str) else canonical(value))


def _rows(conv, turn, role, text) -> list[tuple]:
    """The events of one message."""
    try:
        said = read(text) if text and text.lstrip()[:1] == "{" else None
        calls = said.get("tool_calls") if isinstance(said, dict) else None
        if role == "assistant" and isinstance(calls, list) and calls and all(isinstance(c, dict) for c in calls):
            out = []
            if said.get("content") is not None:
                out.append((conv, turn, "message", role, None, None, None, _text_of(said["content"]), 0, None))
            for k, c in enumerate(calls, 1):
                args = c.get("arguments")
                try:
                    needs = sorted(_needs(read(args) if isinstance(args, str) else args))
                except ValueError:
                    needs = []  # names nothing, and will not be valid
                out.append((conv, turn, "call", role, _text_of(c.get("id")), _text_of(c.get("name")), whole(args) if isinstance(args, str) else canonical(args), None, k, needs))
            return out
        if role == "tool" and isinstance(said, dict) and "tool_call_id" in said:
            return [(conv, turn, "result", role, _text_of(said["tool_call_id"]), None, None, _text_of(said.get("content")), 0, None)]
    except (ValueError, RecursionError):
        pass  # not JSON, or nested too deeply: a plain message
    return [(conv, turn, "message", role, None, None, None, text, 0, None)]


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), *((n, pa.string()) for n in ("kind", "role", "call_id", "name", "arguments", "content")), ("position", pa.int64()), ("needs", pa.list_(pa.string()))])
    for batch in chunks(batches, "text"):
        rows = [r for message in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True) for r in _rows(*message)]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)


def parsed(messages: DataFrame) -> DataFrame:
    """Events of logged messages (conv_id, turn, role, text): ``{"tool_calls": [{"id", "name", "arguments"}]}`` and ``{"tool_call_id", "content"}``."""
    cols = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")]
    return arrow_map(messages.select(*cols), _events, EVENT)


def dialogue(messages: DataFrame) -> DataFrame:
    """Events of a plain dialogue: each user turn calls ``reply``, the assistant's next turn is the result."""
    user, other = F.col("role") == "user", F.col("role") == "assistant"
    asked = F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - F.when(other, 1).otherwise(0)).cast("string"))
    arguments = F.to_json(F.struct(F.col("text").alias("request"), F.col("turn").alias("turn")), {"ignoreNullFields": "false"})
    return messages.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.when(user, "call").when(other, "result").otherwise("message").alias("kind"),
        F.when(user, "assistant").when(other, "tool").otherwise(F.col("role")).alias("role"),
        F.when(user | other, asked).alias("call_id"), F.when(user, "reply").alias("name"),
        F.when(user, arguments).alias("arguments"), F.when(~F.coalesce(user, F.lit(False)), F.col("text")).alias("content"),
    )


KEYS = ["conv_id", "call_id"]


def _dealt(events: DataFrame) -> DataFrame:
    """Adds ``deal``: rows that can link with nothing don't all meet in one task of a join."""
    alone = F.col("conv_id").isNull() | F.col("call_id").isNull()
    return events.withColumn("deal", F.when(alone, F.xxhash64("turn", "kind", "content")).otherwise(F.lit(0).cast("long")))


def chains(calls: DataFrame, results: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, at, depth) of the calls that need others: earliest turn and length of the chain; depth null on or behind a cycle.

    ``calls`` has (conv_id, call_id, call_turn), ``results`` (conv_id, call_id, last_turn) and
    ``needs`` (conv_id, call_id, need); needs of calls that aren't there ask nothing.
    A round settles the calls all of whose needs are settled.
    """
    after = calls.join(results, KEYS, "left").select("conv_id", F.col("call_id").alias("need"), F.coalesce(F.greatest("call_turn", "last_turn"), "call_turn").alias("after"))
    left = needs.distinct().join(calls, KEYS).join(after, ["conv_id", "need"])
    left = written(left.select(*KEYS, "need", "call_turn", "after"), "needs")
    done, level = left.select(*KEYS, F.col("call_turn").alias("at"), F.lit(0).cast("long").alias("depth")).where("false"), 0
    while not left.isEmpty():
        waiting = left.select("conv_id", F.col("call_id").alias("need")).distinct().withColumn("waits", F.lit(True))
        settled = done.select("conv_id", F.col("call_id").alias("need"), "at")
        known = left.join(waiting, ["conv_id", "need"], "left").join(settled, ["conv_id", "need"], "left")
        ready = known.groupBy(*KEYS).agg(F.max(F.coalesce("waits", F.lit(False))).alias("waits"), F.greatest(F.max("call_turn"), F.max("after"), F.max("at")).alias("at"))
        level += 1
        now = written(ready.where("not waits").select(*KEYS, "at", F.lit(level).cast("long").alias("depth")), "settled")
        if now.isEmpty():
            return done.union(left.groupBy(*KEYS).agg(F.max("call_turn").alias("at")).withColumn("depth", F.lit(None).cast("long")))
        done = done.union(now)
        left = written(left.join(now.select(*KEYS), KEYS, "left_anti"), "needs")
    return done


def linked(events: DataFrame) -> DataFrame:
    """Adds linked, order_turn, order_kind (and order_depth if there are ``needs``): calls to their results and results to their calls, by conversation and identifier."""
    known = events.where("conv_id is not null and call_id is not null")
    calls = known.where("kind = 'call'").groupBy(*KEYS).agg(F.min("turn").alias("call_turn"))
    results = known.where("kind = 'result'").groupBy(*KEYS).agg(F.max("turn").alias("last_turn"))
    links = calls.join(results.withColumn("answered", F.lit(True)).hint("shuffle_hash"), KEYS, "left")
    chained = "needs" in events.columns
    if chained:
        first = known.where("kind = 'call'").join(calls.hint("shuffle_hash"), KEYS).where("turn = call_turn")
        depths = chains(calls, results, first.select(*KEYS, F.explode("needs").alias("need")))
        links = links.join(depths.withColumn("chained", F.lit(True)).hint("shuffle_hash"), KEYS, "left")
    out = _dealt(events).join(links.withColumn("deal", F.lit(0).cast("long")).hint("shuffle_hash"), [*KEYS, "deal"], "left")
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    here = call & F.coalesce(F.col("turn") == F.col("call_turn"), F.lit(False))  # the call that its results answer
    is_linked = F.when(call, here & F.coalesce("answered", F.lit(False))).when(result, F.col("call_turn").isNotNull()).otherwise(False)
    follows = F.coalesce("at", "call_turn") if chained else F.col("call_turn")
    moved = F.when(result | here, F.greatest("turn", follows)).otherwise(F.col("turn"))
    depth = F.when(result | here, F.when(F.coalesce("chained", F.lit(False)), F.col("depth")).otherwise(0)).otherwise(0).cast("long").alias("order_depth") if chained else None
    return out.select(*events.columns, is_linked.alias("linked"), moved.alias("order_turn"), F.when(result, F.lit(1)).otherwise(F.lit(0)).alias("order_kind"), *([depth] if chained else []))


def formatted(events: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, turn, kind, call_id, linked, valid (null but for calls), order_turn, order_kind and canonical JSON of each event; position and order_depth too if the events have position and needs."""
    schemas = {name: checked(x) for name, x in schemas.items()}
    place = [c for c, given in (("position", "position"), ("order_depth", "needs")) if given in events.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @functools.lru_cache(maxsize=1024)
        def schema(name):
            return schemas.get(name)

        for batch in batches:
            fine, text = [], []
            for kind, role, call, name, args, content in zip(*(batch.column(c).to_pylist() for c in ("kind", "role", "call_id", "name", "arguments", "content")), strict=True):
                if kind != "call":
                    fine.append(None)
                    text.append(canonical({"content": content, "role": role} | ({"tool_call_id": call} if kind == "result" else {})))
                    continue
                say = lambda x: canonical({"role": role, "tool_calls": [{"arguments": x, "id": call, "name": name}]})  # noqa: B023, E731
                try:
                    value = read(args) if args is not None else None
                    said = (schema(name) is not None and valid(value, schema(name)), say(value))
                except (ValueError, RecursionError):  # no JSON: kept as it is
                    said = (False, say(args))
                fine.append(said[0])
                text.append(said[1])
            keep = ["conv_id", "turn", "kind", "call_id", "linked", "order_turn", "order_kind"]
            cols = {c: batch.column(c) for c in keep}
            yield pa.RecordBatch.from_arrays([*(cols[c] for c in keep[:5]), pa.array(fine, pa.bool_()), cols["order_turn"], cols["order_kind"], pa.array(text), *(batch.column(c) for c in place)], names=[*keep[:5], "valid", *keep[5:], "json", *place])

    return arrow_map(linked(events), run, "conv_id long, turn long, kind string, call_id string, linked boolean, valid boolean, order_turn long, order_kind int, json string" + "".join(f", {c} long" for c in place))
