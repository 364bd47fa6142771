"""Chat formatting: tool calls and results linked by identifier, put in topological order, validated, serialised."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import Scratch


def canonical(value) -> str:
    """JSON with sorted keys, no blanks and no needless escapes; an infinite number is refused, as JSON has none."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _reject(name: str):
    raise ValueError(name)


def parse_json(text: str):
    """The JSON object in the text, or None: not JSON, not an object, not a finite number inside, too deep, or with a
    lone surrogate, which is no character."""
    if not text.lstrip().startswith("{"):
        return None
    try:
        value = json.loads(text, parse_constant=_reject)
        canonical(value).encode()
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
}


_WORDS = {"type", "enum", "const", "required", "properties", "additionalProperties", "items", "minimum", "maximum", "minLength", "maxLength"}
_NOTES = {"title", "description", "default", "examples", "$schema", "$id"}


def check_schema(schema: dict) -> None:
    """Refuses a schema with a word that ``schema_error`` does not know, instead of passing over it."""
    if unknown := sorted(schema.keys() - _WORDS - _NOTES):
        raise ValueError(f"schema words not supported: {', '.join(unknown)}")
    kinds = schema.get("type", [])
    if unknown := sorted({kinds} - _TYPES.keys() if isinstance(kinds, str) else set(kinds) - _TYPES.keys()):
        raise ValueError(f"types not supported: {', '.join(unknown)}")
    if not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError("additionalProperties must be true or false")
    for part in [*schema.get("properties", {}).values(), *([schema["items"]] if "items" in schema else [])]:
        check_schema(part)


def schema_error(value, schema: dict, at: str = "$") -> str | None:
    """The first offence against the schema (type, enum, const, required, properties, additionalProperties, items,
    minimum, maximum, minLength, maxLength), in document order; None if there is none."""
    if at != "$" and isinstance(value, dict) and value.keys() == {"$result"} and isinstance(value["$result"], str):
        return None  # stands for a call's result, which is not known here
    kinds = schema.get("type")
    if kinds and not any(_TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{at}: not of type {kinds if isinstance(kinds, str) else '|'.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not in enum"
    if "const" in schema and value != schema["const"]:
        return f"{at}: not the constant"
    if isinstance(value, dict):
        for name in schema.get("required", ()):
            if name not in value:
                return f"{at}.{name}: missing"
        known = schema.get("properties", {})
        for name in sorted(value):
            if name in known:
                if found := schema_error(value[name], known[name], f"{at}.{name}"):
                    return found
            elif schema.get("additionalProperties") is False:
                return f"{at}.{name}: not allowed"
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            if found := schema_error(item, schema["items"], f"{at}[{i}]"):
                return found
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            return f"{at}: below minimum"
        if "maximum" in schema and value > schema["maximum"]:
            return f"{at}: above maximum"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            return f"{at}: too short"
        if "maxLength" in schema and len(value) > schema["maxLength"]:
            return f"{at}: too long"
    return None


def references(value) -> list[str]:
    """Identifiers of results that arguments refer to, as ``{"$result": "<call id>"}``."""
    found, open_ = [], [value]
    while open_:
        v = open_.pop()
        if isinstance(v, dict):
            if isinstance(v.get("$result"), str):
                found.append(v["$result"])
            open_ += v.values()
        elif isinstance(v, list):
            open_ += v
    return sorted(set(found))


def _extra(body: dict, known: set[str]) -> str | None:
    extra = sorted(body.keys() - known)
    return f"unknown key {extra[0]}" if extra else None


def read_message(role: str | None, text: str | None, schemas: dict[str, dict]) -> dict:
    """Canonical JSON of a message, its calls (identifiers), the call it answers, the results it waits for, its error.

    Only an assistant calls and only a tool answers: the same JSON from others is plain text. Keys that have no place in
    the canonical form are an error."""
    body = parse_json(text) if text else None
    message: dict = {"role": role, "content": text}
    calls, answers, waits, error = [], None, [], None
    if body is not None and role == "assistant" and isinstance(body.get("tool_calls"), list):
        error = _extra(body, {"role", "content", "tool_calls"})
        message = {"role": role, "content": body.get("content"), "tool_calls": []}
        for call in body["tool_calls"]:
            call = call if isinstance(call, dict) else {}
            function = call.get("function") if isinstance(call.get("function"), dict) else call
            name, arguments = function.get("name"), function.get("arguments", {})
            if isinstance(arguments, str):
                parsed = parse_json(arguments)
                error = error or (None if parsed is not None else "arguments: not a JSON object")
                arguments = parsed if parsed is not None else arguments
            if not isinstance(call.get("id"), str):
                error = error or "call without id"
            else:
                calls.append(call["id"])
            if not isinstance(name, str) or name not in schemas:
                error = error or f"unknown tool {canonical(name)}"
            else:
                error = error or schema_error(arguments, schemas[name])
            waits += references(arguments)
            message["tool_calls"].append({"id": call.get("id"), "type": "function", "function": {"name": name, "arguments": canonical(arguments)}})
    elif body is not None and role == "tool" and isinstance(body.get("tool_call_id"), str):
        error = _extra(body, {"role", "content", "tool_call_id"})
        answers = body["tool_call_id"]
        content = body.get("content")
        message = {"role": role, "tool_call_id": answers, "content": content if isinstance(content, str) or content is None else canonical(content)}
    elif role == "tool":
        error = "result without call id"
    return {"json": canonical(message), "calls": calls, "answers": answers, "waits": sorted(set(waits)), "error": error}


_PARSED = "json string, calls array<string>, answers string, waits array<string>, error string"


def format_chats(messages: DataFrame, schemas: dict[str, dict] | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", name: str = "chat") -> DataFrame:
    """One row for each message: conversation, turn, role, its place (``order_turn``, ``order_depth``), ``call_turn``
    (the turn whose call a result answers), ``json`` (canonical, one line) and ``error`` (null: none).

    Sorted by place, then turn, then JSON, a conversation's lines are its canonical form, in which a result never comes
    before its call and a call never before a result that its arguments refer to; otherwise turns keep their order. A
    message that must wait takes the place of the turn it waits for, one deeper than it. Messages in or behind a ring of
    waits keep their own turn and have the error ``cycle``; results without a call have the error ``no such call``; of
    several calls with one identifier the earliest is meant. A reference to a call that the conversation does not have is
    the error ``refers to no call``.

    A message is its conversation and turn, so repeated rows have the same place and are all returned. A null
    conversation is one conversation, a null turn comes last, null role and text are JSON null; an empty table gives an
    empty result; other columns are not read. ``schemas`` maps tool names to JSON schemas (a configuration, not data).

    Calls and results meet by a hash join on conversation and identifier. A conversation is never gathered: places are
    carried from message to message by joins over those links that are out of order, in as many rounds as the longest
    chain of such links; usually there are none.
    """
    for tool in (schemas or {}).values():
        check_schema(tool)
    spark = messages.sparkSession
    scratch = Scratch(spark, name)
    picked = messages.select(F.col(conv).alias("c"), F.col(turn).cast("long").alias("t"), F.col(role).alias("role"), F.col(text).alias("_text"))
    kind = picked.schema["c"].dataType
    schema = StructType().add("c", kind).add("t", "long").add("role", "string")
    for field in StructType.fromDDL(_PARSED):
        schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(schema)
        for batch in batches:
            if not batch.num_rows:
                continue
            read = [read_message(r.as_py(), t.as_py(), schemas or {}) for r, t in zip(batch.column("role"), batch.column("_text"), strict=True)]
            columns = [batch.column(i).cast(wanted.field(i).type) for i in range(3)]
            columns += [pa.array([x[f.name] for x in read], f.type) for f in list(wanted)[3:]]
            yield pa.RecordBatch.from_arrays(columns, schema=wanted)

    parsed = picked.mapInArrow(run, schema).withColumns({"k": F.coalesce(F.col("c").cast("string"), F.lit("\0")), "n": F.coalesce("t", F.lit(2**63 - 1))})
    parsed = scratch.save(parsed)
    calls = parsed.select("k", "n", F.explode("calls").alias("id")).groupBy("k", "id").agg(F.min("n").alias("call"))
    answers = parsed.where("answers is not null").select("k", F.col("answers").alias("id"), "n").distinct()
    linked = scratch.save(answers.join(calls, ["k", "id"], "left"))
    results = linked.where("call is not null").groupBy("k", "id").agg(F.min("n").alias("result"))
    asked = parsed.select("k", "n", F.explode("waits").alias("id")).distinct()
    waits = asked.join(results, ["k", "id"])
    unknown = asked.join(calls, ["k", "id"], "left_anti").select("k", "n").distinct().withColumn("unknown", F.lit(True))
    edges = linked.where("call is not null").select("k", F.col("call").alias("p"), F.col("n").alias("s"))
    edges = scratch.save(edges.unionByName(waits.select("k", F.col("result").alias("p"), F.col("n").alias("s"))).distinct())
    places = _places(edges, scratch)
    call = linked.select("k", "n", F.col("id").alias("answers"), "call").distinct()
    out = parsed.join(call, ["k", "n", "answers"], "left").join(unknown, ["k", "n"], "left")
    if places is not None:
        out = out.join(places, ["k", "n"], "left")
    else:
        out = out.withColumns({"place": F.lit(None).cast("long"), "depth": F.lit(None).cast("integer"), "cycle": F.lit(None).cast("boolean")})
    last = F.lit(2**63 - 1)
    error = F.coalesce("error", F.when(F.col("answers").isNotNull() & F.col("call").isNull(), "no such call"), F.when(F.col("unknown"), "refers to no call"), F.when(F.col("cycle"), "cycle"))
    return out.select(
        F.col("c").alias(conv),
        F.col("t").alias(turn),
        "role",
        F.nullif(F.coalesce("place", "n"), last).alias("order_turn"),
        F.coalesce("depth", F.lit(0)).alias("order_depth"),
        F.nullif(F.col("call"), last).alias("call_turn"),
        "json",
        error.alias("error"),
    )


def _places(edges: DataFrame, scratch: Scratch) -> DataFrame | None:
    """``(k, n, place, depth, cycle)`` of the messages that do not simply stand at their turn; None if all do."""
    if not edges.where("p >= s").limit(1).count():
        return None
    # only conversations with a link that is out of order
    late = edges.where("p >= s").select("k").distinct()
    edges = scratch.save(edges.join(late, "k", "left_semi"))
    nodes = edges.select("k", F.explode(F.array("p", "s")).alias("n")).distinct()
    size = nodes.groupBy("k").agg(F.count("*").alias("size"))
    state = scratch.save(nodes.join(size, "k").select("k", "n", "size", F.col("n").alias("place"), F.lit(0).alias("depth"), F.lit(False).alias("cycle")))
    while True:
        # places settle when no link asks for more; a chain deeper than its conversation has messages is a ring
        before = state.select("k", F.col("n").alias("p"), F.struct("place", (F.col("depth") + 1).alias("deeper")).alias("ask"), F.col("cycle").alias("ring"))
        asks = edges.join(before, ["k", "p"]).groupBy("k", F.col("s").alias("n")).agg(F.max(F.when(~F.col("ring"), F.col("ask"))).alias("ask"), F.max("ring").alias("ring"))
        joined = state.join(asks, ["k", "n"], "left")
        more = F.col("ask").isNotNull() & ~F.col("cycle") & ((F.col("ask.place") > F.col("place")) | ((F.col("ask.place") == F.col("place")) & (F.col("ask.deeper") > F.col("depth"))))
        cycle = F.col("cycle") | F.coalesce("ring", F.lit(False)) | (more & (F.col("ask.deeper") > F.col("size")))
        new = joined.select(
            "k",
            "n",
            "size",
            F.when(cycle, F.col("n")).when(more, F.col("ask.place")).otherwise(F.col("place")).alias("place"),
            F.when(cycle, 0).when(more, F.col("ask.deeper")).otherwise(F.col("depth")).alias("depth"),
            cycle.alias("cycle"),
            ((more & ~cycle) | (cycle != F.col("cycle"))).alias("moved"),
        )
        new = scratch.save(new)
        scratch.drop(state)
        state = new
        if not new.where("moved").limit(1).count():
            return state.select("k", "n", "place", "depth", "cycle")


def digest_chats(formatted: DataFrame) -> DataFrame:
    """The rows of ``format_chats`` with the JSON's SHA-256 in its place."""
    return formatted.withColumn("json_sha256", F.sha2("json", 256)).drop("json")


def derive_calls(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)``: conversations that hold no calls, with a call and its result made from each of
    their user messages by a fixed rule. Message t moves to turn 3t; a user's is looked up by the tool ``search`` at turn
    3t + 1, with its first twenty characters as the query; the result comes at turn 3t + 2, but for even t at 3t - 1,
    before its call."""
    t = F.col("turn").cast("long")
    users = messages.where("role = 'user' and turn is not null")
    ident = F.concat(F.lit("q"), t)
    arguments = F.struct(F.substring(F.coalesce("text", F.lit("")), 1, 20).alias("query"))
    call = F.to_json(F.struct(F.array(F.struct(ident.alias("id"), F.lit("search").alias("name"), arguments.alias("arguments"))).alias("tool_calls")))
    answer = F.to_json(F.struct(ident.alias("tool_call_id"), F.lit("found").alias("content")))
    made = F.explode(
        F.array(
            F.struct((3 * t + 1).alias("turn"), F.lit("assistant").alias("role"), call.alias("text")),
            F.struct(F.when(t % 2 == 0, 3 * t - 1).otherwise(3 * t + 2).alias("turn"), F.lit("tool").alias("role"), answer.alias("text")),
        )
    )
    return messages.select("conv_id", (3 * t).alias("turn"), "role", "text").unionByName(users.select("conv_id", made.alias("m")).select("conv_id", "m.*"))
