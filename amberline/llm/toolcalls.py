"""Tool-call linking for chat formatting (operator 3).

Calls and results are hash-joined by identifier, calls are ordered topologically by
their dependencies (chains by pointer doubling, see ``levels``), arguments are validated
against schemas, and each call is serialised with its result as canonical JSON (keys
sorted, no spaces, UTF-8 kept). Nothing is gathered by conversation, so one conversation
may hold any share of the rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberline.llm.scratch import Scratch

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def violations(value: object, schema: dict, at: str = "$") -> list[str]:
    """What of ``value`` breaks the JSON schema (type, enum, required, properties, additionalProperties, items, bounds)."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        if not any(isinstance(value, _TYPES[k]) and (k == "boolean" or not isinstance(value, bool)) for k in kinds):
            return [f"{at}: not {'/'.join(kinds)}"]
    out = [f"{at}: not in enum"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        out += [x for i, v in enumerate(value) for x in violations(v, schema["items"], f"{at}[{i}]")]
    if isinstance(value, str):
        out += [f"{at}: too short"] if len(value) < schema.get("minLength", 0) else []
        out += [f"{at}: too long"] if len(value) > schema.get("maxLength", len(value)) else []
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: too small"] if value < schema.get("minimum", value) else []
        out += [f"{at}: too large"] if value > schema.get("maximum", value) else []
    return out


def _serialise(batches: Iterator[pa.RecordBatch], schemas: dict[str, dict]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        status, errors, lines = [], [], []
        for r in batch.to_pylist():
            try:
                arguments, wrong = json.loads(r["arguments"]), []
            except (TypeError, ValueError):
                arguments, wrong = r["arguments"], ["$: not JSON"]
            if not wrong:
                wrong = violations(arguments, schemas[r["name"]]) if r["name"] in schemas else [f"no tool {r['name']}"]
            if r["level"] is None:
                status.append("cyclic")
            elif wrong:
                status.append("invalid")
            else:
                status.append("linked" if r["n_results"] else "unanswered")
            errors.append("; ".join(wrong))
            lines.append(canonical({"arguments": arguments, "depends_on": r["depends_on"], "id": r["call_id"], "level": r["level"], "name": r["name"], "result": r["content"]}))
        keep = batch.select(["conv_id", "turn", "call_id", "n_calls", "n_results", "n_missing", "level"])
        yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(status, pa.string()), pa.array(errors, pa.string()), pa.array(lines, pa.string())], [*keep.schema.names, "status", "errors", "json"])


def levels(calls: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(call_id, level): 0 for calls that wait for none, else 1 more than the deepest they wait for; calls on or behind a cycle are left out.

    A call that waits for at most one other has the level max(base, level of ``to`` + w).
    Such functions compose, so a chain of them is resolved by pointer doubling, in log2
    of its length rounds. Calls that wait for several are then rewritten to wait for the
    ends of their chains, and the next pass takes those that are left with one or none:
    passes grow only with how deep calls that still wait for several lie behind each other.
    """
    nodes = calls.select("call_id", F.lit(0).cast("long").alias("base"))
    edges = edges.select("call_id", "dep", F.lit(1).cast("long").alias("w"))
    done, several = None, None
    while True:
        waits = edges.groupBy("call_id").agg(F.count("*").alias("k"), F.min("dep").alias("to"), F.max("w").alias("w"))
        state = scratch.save(nodes.join(waits, "call_id", "left").withColumn("k", F.coalesce("k", F.lit(0))))
        chains = state.where("k < 2").select("call_id", "to", F.coalesce("w", F.lit(0)).alias("w"), "base", F.expr("k = 0").alias("ended"))
        chains = scratch.save(chains)
        reach, most = 1, chains.count()
        while reach < 2 * most and not chains.where("not ended").isEmpty():  # what has not ended by then is on or behind a cycle
            via = chains.select(F.col("call_id").alias("to"), F.col("to").alias("to2"), F.col("w").alias("w2"), F.col("base").alias("base2"), F.col("ended").alias("ended2"))
            step = chains.where("not ended").join(via, "to", "left")
            step = step.select(
                "call_id", F.expr("if(ended2 is null, to, to2)").alias("to"), F.expr("w + coalesce(w2, 0)").alias("w"),
                F.expr("greatest(base, w + base2)").alias("base"), F.coalesce("ended2", F.lit(True)).alias("ended"),
            )
            chains, old = scratch.save(chains.where("ended").unionAll(step)), chains
            scratch.drop(old)
            reach *= 2
        got = chains.where("ended and to is null").select("call_id", F.col("base").cast("int").alias("level"))
        done = got if done is None else done.unionAll(got)
        left = state.where("k > 1").count()
        if not left or left == several:  # without a cycle behind it, some call of each pass gets its level
            return done
        several = left
        # calls behind those with several wait on; edges to calls with a level go into the base
        held = chains.where("ended and to is not null")
        ends = chains.where("ended").select(F.col("call_id").alias("dep"), "to", F.col("w").alias("w2"), F.col("base").alias("base2"), F.lit(True).alias("known"))
        moved = edges.join(state.where("k > 1").select("call_id"), "call_id", "left_semi").join(ends, "dep", "left")
        moved = scratch.save(moved.select("call_id", F.expr("if(known, to, dep)").alias("dep"), F.expr("w + coalesce(w2, 0)").alias("w"), F.expr("w + base2").alias("least")))
        least = moved.groupBy("call_id").agg(F.max("least").alias("least"))
        nodes = state.where("k > 1").select("call_id", "base").join(least, "call_id").select("call_id", F.greatest("base", "least").alias("base"))
        nodes = nodes.unionAll(held.select("call_id", "base"))
        edges = moved.where("dep is not null").groupBy("call_id", "dep").agg(F.max("w").alias("w")).unionAll(held.select("call_id", F.col("to").alias("dep"), "w"))
        edges = scratch.save(edges)


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], scratch: Scratch) -> DataFrame:
    """One row per call: (conv_id, turn, call_id, n_calls, n_results, n_missing, level, status, errors, json).

    calls: (conv_id, turn, call_id, name, arguments, depends_on); results: (conv_id,
    turn, call_id, content). Identifiers are of the whole table. Of calls that share an
    identifier the one of least (turn, conv_id, arguments) stands and ``n_calls`` tells how many there are; likewise
    of results. Dependencies that no call has are counted in ``n_missing`` and wait for
    nothing. Status: cyclic (no level), invalid (arguments are no JSON, break the
    schema, or the tool is unknown), unanswered (no result) or linked. Results without a
    call come as rows of status orphan, their call fields null. Rows without a call_id are
    ignored; (level, turn) orders a conversation. Empty tables give no rows.
    """
    call = F.struct("turn", "conv_id", "arguments", "name", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    own = scratch.save(calls.where("call_id is not null").groupBy("call_id").agg(F.min(call).alias("c"), F.count("*").alias("n_calls")).select("call_id", "c.*", "n_calls"))
    got = results.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("turn", "content", "conv_id")).alias("r"), F.count("*").alias("n_results"))
    got = scratch.save(got.select("call_id", F.col("r.conv_id").alias("r_conv"), F.col("r.turn").alias("r_turn"), F.col("r.content").alias("content"), "n_results"))
    named = own.select("call_id", F.explode(F.array_distinct("depends_on")).alias("dep"))
    edges = scratch.save(named.join(own.select(F.col("call_id").alias("dep")), "dep", "left_semi"))
    missing = named.join(own.select(F.col("call_id").alias("dep")), "dep", "left_anti").groupBy("call_id").agg(F.count("*").alias("n_missing"))
    full = own.join(got.drop("r_conv", "r_turn"), "call_id", "left").join(levels(own, edges, scratch), "call_id", "left").join(missing, "call_id", "left")
    full = full.withColumns({"n_results": F.coalesce("n_results", F.lit(0)), "n_missing": F.coalesce("n_missing", F.lit(0))})
    full = full.mapInArrow(
        partial(_serialise, schemas=schemas),
        "conv_id long, turn long, call_id string, n_calls long, n_results long, n_missing long, level int, status string, errors string, json string",
    )
    orphan = got.join(own.select("call_id"), "call_id", "left_anti").select(
        F.col("r_conv").alias("conv_id"), F.col("r_turn").alias("turn"), "call_id", F.lit(0).cast("long").alias("n_calls"), "n_results", F.lit(0).cast("long").alias("n_missing"),
        F.lit(None).cast("int").alias("level"), F.lit("orphan").alias("status"), F.lit("").alias("errors"), F.lit(None).cast("string").alias("json"),
    )
    return full.unionAll(orphan)


#: The tool that turns of a plain conversation are calls of.
REPLY = {
    "reply": {
        "type": "object",
        "required": ["prompt", "turn"],
        "properties": {"prompt": {"type": "string", "minLength": 20}, "turn": {"type": "integer", "minimum": 0}},
        "additionalProperties": False,
    }
}


def conversation_calls(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a plain conversation table (conv_id, turn, role, text).

    A user's turn calls the tool ``reply`` and waits for the user's turn two before; an
    assistant's turn is the result of the call of the turn before it. Rows of null
    conv_id or turn are ignored; turns of other roles (system) are neither a call nor a
    result and give no row.
    """
    rows = rows.where("conv_id is not null and turn is not null")
    name = lambda back: F.concat_ws(":", "conv_id", F.col("turn") - back)
    calls = rows.where("role = 'user'").select(
        "conv_id", "turn", name(0).alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), "turn"), {"ignoreNullFields": "false"}).alias("arguments"), F.array(name(2)).alias("depends_on"),
    )
    return calls, rows.where("role = 'assistant'").select("conv_id", "turn", name(1).alias("call_id"), F.col("text").alias("content"))
