"""Chat formatting: tool calls are linked with results, ordered, validated and serialised as canonical JSON.

Calls and results are folded by (conv_id, call_id) and hash-joined on it. Arguments may refer to other calls'
results as {"$ref": "<call_id>"}; the level of a call is 0 without references to calls of its conversation and else one more than the
greatest level among them, and (conv_id, level, turn, call_id) is a topological
order. Arguments are checked against the tool's schema.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.llm.common import materialize

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    """Keys sorted, no white space, characters as they are; a whole float below 2**53 is written as an integer."""

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 2**53 else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def references(value) -> Iterator[str]:
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            yield value["$ref"]
        else:
            for v in value.values():
                yield from references(v)
    elif isinstance(value, list):
        for v in value:
            yield from references(v)


def errors(value, schema: dict, at: str = "$") -> Iterator[str]:
    """What is wrong with a value under a schema of type, enum, minimum, maximum, required, properties, additionalProperties, items.

    A reference stands for a value that is not known yet and fits everywhere.
    """
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return
    kind = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    fits = {None: True, "number": number, "integer": number and float(value).is_integer()}.get(kind)
    if not (isinstance(value, _TYPES[kind]) if fits is None else fits):
        yield f"{at}: not {kind}"
        return
    if "enum" in schema and value not in schema["enum"]:
        yield f"{at}: not in enum"
    if number and value < schema.get("minimum", value):
        yield f"{at}: under minimum"
    if number and value > schema.get("maximum", value):
        yield f"{at}: over maximum"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        yield from (f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value)
        for k in sorted(value):
            if k in known:
                yield from errors(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                yield f"{at}.{k}: unknown"
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            yield from errors(v, schema["items"], f"{at}[{i}]")


def _parse(text: str | None):
    def refuse(name):
        raise ValueError(name)

    try:
        value = json.loads(text or "", parse_constant=refuse)
        canonical(value).encode()
        return value, None
    except (ValueError, RecursionError):
        return None, "$: not JSON"


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of all calls that are not part of, or behind, a circle of references.

    Calls with one reference form chains, which pointer jumping shortens in a logarithmic number of rounds to their end: a call
    without references or with several. Only the latter are then released round by round.
    """
    keys = ["conv_id", "call_id"]
    pairs = calls.select(*keys, F.explode(F.array_distinct("refs")).alias("dep"))
    pairs = materialize(pairs.join(calls.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"]), "pairs")
    done = materialize(calls.select(*keys).join(pairs, keys, "left_anti").withColumn("level", F.lit(0).cast("long")), "level")
    chain = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.min("dep").alias("dep")).filter("n = 1").select(*keys, "dep", F.lit(1).cast("long").alias("steps"))
    chain = materialize(chain, "chain")
    several = materialize(pairs.join(chain.select(*keys), keys, "left_anti"), "several")
    for _ in range(chain.count().bit_length() + 1):
        ahead = chain.select("conv_id", F.col("call_id").alias("dep"), F.col("dep").alias("_to"), F.col("steps").alias("_more"))
        if chain.join(ahead, ["conv_id", "dep"], "left_semi").isEmpty():
            break
        chain = chain.join(ahead, ["conv_id", "dep"], "left").select(*keys, F.coalesce("_to", "dep").alias("dep"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"))
        chain = materialize(chain, "chain")
    through = chain.select("conv_id", F.col("call_id").alias("dep"), F.col("dep").alias("_to"), "steps")
    wait = several.join(through, ["conv_id", "dep"], "left").select(*keys, F.coalesce("_to", "dep").alias("dep"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    wait = materialize(wait, "wait")
    while not wait.isEmpty():
        told = wait.join(done.select("conv_id", F.col("call_id").alias("dep"), "level"), ["conv_id", "dep"], "left")
        new = told.groupBy(*keys).agg(F.max(F.col("level") + F.col("steps")).alias("level"), F.count(F.when(F.col("level").isNull(), 1)).alias("open"))
        new = materialize(new.filter("open = 0").select(*keys, "level"), "level")
        if new.isEmpty():
            break
        done = materialize(done.unionByName(new), "level")
        wait = materialize(wait.join(new, keys, "left_anti"), "wait")
    ends = done.select("conv_id", F.col("call_id").alias("dep"), "level")
    return done.unionByName(chain.join(ends, ["conv_id", "dep"]).select(*keys, (F.col("level") + F.col("steps")).alias("level")))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call or lone result: conv_id, call_id, turn, level, n_calls, n_results, status, valid, message.

    calls: conv_id, call_id, turn, name, arguments (JSON text). results: conv_id, call_id, turn, content. Of repeated
    calls or results with one identifier the earliest turn counts (then the smallest text); n_calls and n_results
    tell how many there were. status is linked, unanswered (no result), orphan (no call) or circular (level null).
    Arguments that are no JSON, an unknown tool and an unknown reference are errors like those of the schema; the message holds
    sorted errors, and the arguments as null where they could not be read. Rows with a null conv_id or call_id are left out.
    """
    keys = ["conv_id", "call_id"]
    calls = calls.dropna(subset=keys).groupBy(keys).agg(F.min(F.struct("turn", "name", "arguments")).alias("c"), F.count("*").alias("n_calls")).select(*keys, "c.*", "n_calls")
    results = results.dropna(subset=keys).groupBy(keys).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))

    def parse(batches):
        for pdf in batches:
            refs = []
            for text in pdf["arguments"]:
                value, _ = _parse(text)
                refs.append(sorted(set(references(value))))
            yield pdf.assign(refs=refs)

    parsed = materialize(calls.mapInPandas(parse, "conv_id long, call_id string, turn long, name string, arguments string, n_calls long, refs array<string>"), "calls")
    known = parsed.select("conv_id", "call_id", F.explode("refs").alias("dep")).join(parsed.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_anti")
    lost = known.groupBy(keys).agg(F.sort_array(F.collect_set("dep")).alias("lost"))
    both = parsed.drop("refs").join(_levels(parsed), keys, "left").join(lost, keys, "left").join(results, keys, "full")

    def form(batches):
        for pdf in batches:
            rows = []
            for x in pdf.itertuples(index=False):
                call, result = not pd.isna(x.n_calls), not pd.isna(x.n_results)
                level = None if pd.isna(x.level) else int(x.level)
                found = []
                value, wrong = _parse(x.arguments) if call else (None, None)
                if call:
                    schema = schemas.get(x.name)
                    found = [wrong] if wrong else ["$: unknown tool"] if schema is None else list(errors(value, schema))
                    found += [f"$ref {r}: unknown" for r in (x.lost if x.lost is not None else [])]
                status = "orphan" if not call else "circular" if level is None else "linked" if result else "unanswered"
                body = {"arguments": value, "errors": sorted(found), "id": x.call_id, "level": level, "name": x.name if call else None, "result": x.r["content"] if result else None, "status": status}
                turn = x.turn if call else x.r["turn"]
                rows.append((x.conv_id, x.call_id, None if pd.isna(turn) else int(turn), level, int(x.n_calls) if call else 0, int(x.n_results) if result else 0, status, call and not found and status != "circular", canonical(body)))
            out = pd.DataFrame(rows, columns=["conv_id", "call_id", "turn", "level", "n_calls", "n_results", "status", "valid", "message"])
            yield out.astype({"turn": "Int64", "level": "Int32"})

    return both.mapInPandas(form, "conv_id long, call_id string, turn long, level int, n_calls long, n_results long, status string, valid boolean, message string")


#: Tools of the calls derived from conversations.
TOOLS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False, "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}, "after": {"type": "string"}}},
}


def derive(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each user turn as a search call that refers to the user turn before it, and each assistant turn as the result of the turn before."""
    call = lambda c: F.concat(F.lit("call_"), c.cast("string"))
    rows = conversations.filter("turn is not null")
    after = F.when(F.col("turn") >= 2, F.create_map(F.lit("$ref"), call(F.col("turn") - 2)))
    arguments = F.to_json(F.struct(after.alias("after"), (F.length(F.coalesce("text", F.lit(""))) % 60).alias("limit"), F.col("text").alias("query")))
    calls = rows.filter("role = 'user'").select("conv_id", call(F.col("turn")).alias("call_id"), "turn", F.lit("search").alias("name"), arguments.alias("arguments"))
    results = rows.filter("role = 'assistant'").select("conv_id", call(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
