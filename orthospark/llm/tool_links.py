"""Tool-call linking.

Calls and results meet by a hash join on the call's identifier.  A call may name calls whose results it continues from:
one in its row, more in a table of parents.  Its level is the length of the longest way to it.  Calls with one parent
are followed up to the next one that has none or several by pointer doubling, for all calls at once, so a chain of any
length takes a logarithm of rounds.  What is left are calls with several parents and the edges between them and those heads; a
component of them that has at most `ordered` edges is put in topological order in one task, whatever its depth, and a larger one in rounds over
tables, one for each such call that stands on one way, so that no unbounded group is ever gathered.  Arguments are parsed, checked against the tool's schema and serialised as canonical JSON:
sorted keys, no white space, no escapes but the needed ones.

Order within a conversation: level, then identifier; every call stands after what it continues from.

Defined cases, each a status: "unparsed" (arguments are no JSON object, nested too deeply, with equal keys in an object,
a number that is not finite or text that UTF-8 cannot hold), "unknown tool", "invalid" (the error says which
field), "cycle" (level null), "missing parent" (a parent is not among the calls), "no result", else "linked";
results without a call are "orphan" rows.  Of several results to a call the least in order of content is taken and
n_results says how many there were; repeated calls with one identifier count as one (the least arguments), null
identifiers are dropped from calls and are orphans among results; empty tables give an empty result; other columns are
not read; very long arguments are worked on alone.
"""

from __future__ import annotations

import json
import math
import re
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_chunks, written
from .components import components

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}
#: Deepest nesting of arguments that is parsed, unless link() is given another.
DEEPEST = 100
#: Most edges of a component that one task orders.
ORDERED = 1 << 17


def is_type(own, name: str) -> bool:
    """Whether a value is of a JSON type; a name that isn't one excludes nothing."""
    kind = _TYPES.get(name)
    return kind is None or isinstance(own, kind) and not (isinstance(own, bool) and name in ("integer", "number"))


def equal(a, b) -> bool:
    """JSON equality: true is not 1, and 1 is 1.0."""
    if isinstance(a, bool) != isinstance(b, bool):
        return False
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equal(x, b[k]) for k, x in a.items())
    return a == b


def referred(rule: dict, root: dict) -> dict:
    """The rule that `$ref` leads to, a place in the same schema; a ring of references or an unknown place is an error of the schema."""
    seen = set()
    while "$ref" in rule:
        ref = rule["$ref"]
        if ref in seen or not ref.startswith("#"):
            raise ValueError(f"schema: {ref} leads nowhere")
        seen.add(ref)
        rule = root
        for part in ref[1:].split("/")[1:]:
            rule = rule[part.replace("~1", "/").replace("~0", "~")]
    return rule


def rule_error(path: str, own, rule: dict, root: dict) -> str | None:
    """The first breach of a value's rule: type, alternatives, const, enum, length, pattern, bounds, then its items or fields."""
    rule = referred(rule, root)
    if "type" in rule:
        kinds = rule["type"] if isinstance(rule["type"], list) else [rule["type"]]
        if not any(is_type(own, x) for x in kinds):
            return f"{path}: not {' or '.join(kinds)}"
    fits = lambda rules: sum(rule_error(path, own, x, root) is None for x in rules)
    if "anyOf" in rule and not fits(rule["anyOf"]):
        return f"{path}: none of anyOf"
    if "oneOf" in rule and fits(rule["oneOf"]) != 1:
        return f"{path}: not one of oneOf"
    if error := next((e for x in rule.get("allOf", []) if (e := rule_error(path, own, x, root))), None):
        return error
    if "const" in rule and not equal(own, rule["const"]):
        return f"{path}: not const"
    if isinstance(own, str) and not rule.get("minLength", 0) <= len(own) <= rule.get("maxLength", math.inf):
        return f"{path}: length"
    if "enum" in rule and not any(equal(own, x) for x in rule["enum"]):
        return f"{path}: not in enum"
    if isinstance(own, str) and "pattern" in rule and not re.search(rule["pattern"], own):
        return f"{path}: pattern"
    if isinstance(own, (int, float)) and not isinstance(own, bool) and not rule.get("minimum", -math.inf) <= own <= rule.get("maximum", math.inf):
        return f"{path}: bounds"
    if isinstance(own, list):
        if not rule.get("minItems", 0) <= len(own) <= rule.get("maxItems", math.inf):
            return f"{path}: items"
        return next((e for i, x in enumerate(own) if "items" in rule and (e := rule_error(f"{path}[{i}]", x, rule["items"], root))), None)
    if isinstance(own, dict) and ("properties" in rule or "required" in rule):
        return schema_error(own, rule, f"{path}.", root)
    return None


def schema_error(value: dict, schema: dict, prefix: str = "", root: dict | None = None) -> str | None:
    """The first breach, in the order of field names: required, the field's own rule; unknown fields unless additionalProperties."""
    root = schema if root is None else root
    schema = referred(schema, root)
    fields, others = schema.get("properties", {}), schema.get("additionalProperties", False)
    for name in sorted({*schema.get("required", []), *fields, *value}):
        if name not in value:
            if name in schema.get("required", []):
                return f"{prefix}{name}: missing"
        elif name in fields:
            if error := rule_error(f"{prefix}{name}", value[name], fields[name], root):
                return error
        elif isinstance(others, dict):
            if error := rule_error(f"{prefix}{name}", value[name], others, root):
                return error
        elif not others:
            return f"{prefix}{name}: unknown"
    return None


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def depth(text: str) -> int:
    """How deeply brackets outside of strings nest."""
    deepest = now = 0
    for c in re.findall(r'"(?:[^"\\]|\\.)*+"?|[\[{]|[\]}]', text, re.S):
        now += (c in "[{") - (c in "]}")
        deepest = max(deepest, now)
    return deepest


def parsed(text: str | None, deepest: int = DEEPEST) -> dict | None:
    """A JSON object whose canonical form is JSON again; None for anything else, and for one nested more deeply."""

    def fields(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("equal keys")
        return dict(pairs)

    try:
        if not text or depth(text) > deepest:
            return None
        value = json.loads(text, object_pairs_hook=fields)
        canonical_json(value).encode()
    except (ValueError, RecursionError):  # UnicodeEncodeError is a ValueError
        return None
    return value if isinstance(value, dict) else None


def ordered_levels(edges: pd.DataFrame) -> pd.DataFrame:
    """(call_id, level) of a component's calls, by Kahn's algorithm; edges: call_id, head, way, known (the head is at level 0).  Calls on and after a cycle are left out."""
    codes, names = pd.factorize(pd.concat([edges["call_id"], edges["head"]], ignore_index=True))
    n, calls = len(edges), codes[: len(edges)].tolist()
    heads, ways, known = codes[n:].tolist(), edges["way"].tolist(), edges["known"].tolist()
    level, open_, after = [0] * len(names), [0] * len(names), {}
    for c, h, w in zip(calls, heads, ways):
        open_[c] += 1
        after.setdefault(h, []).append((c, w))
    ready, out = list({h for h, k in zip(heads, known) if k}), []
    while ready:
        h = ready.pop()
        for c, w in after.get(h, ()):
            level[c] = max(level[c], level[h] + w + 1)
            open_[c] -= 1
            if not open_[c]:
                out.append(c)
                ready.append(c)
    return pd.DataFrame({"call_id": names[out], "level": pd.array([level[c] for c in out], dtype="int64")})


def levels(calls: DataFrame, edges: DataFrame, ordered: int = ORDERED) -> DataFrame:
    """(call_id, level, missing_parent) of unique calls and their distinct edges (call_id, parent_id, neither null); level is null on and after a cycle."""
    known = calls.select(F.col("call_id").alias("parent_id"))
    lost = written(edges.join(known, "parent_id", "left_anti").select("call_id").distinct().withColumn("missing_parent", F.lit(True)), "lost")
    edges = written(edges.join(known, "parent_id").select("call_id", "parent_id"), "edges")
    several = edges.groupBy("call_id").agg(F.count("*").alias("n"), F.min("parent_id").alias("up"))
    several = written(several, "parents")

    # Calls with one parent follow it up to a call with none or several, its head.
    moving = written(several.where("n = 1").select("call_id", "up", F.lit(1).cast("long").alias("way")), "moving")
    ended: list[DataFrame] = []
    moved = [moving]
    for _ in range(math.ceil(math.log2(moving.count() + 1)) + 1):
        if moving.isEmpty():
            break
        table = moving.select("call_id", "up", "way", F.lit(False).alias("over"))
        for x in ended:
            table = table.union(x.withColumn("over", F.lit(True)))
        above = table.select(F.col("call_id").alias("up"), F.col("up").alias("upper"), F.col("way").alias("more"), "over")
        step = written(moving.join(above, "up", "left").select("call_id", F.coalesce("upper", "up").alias("up"), (F.col("way") + F.coalesce("more", F.lit(0))).alias("way"), F.coalesce("over", F.lit(True)).alias("over")), "moving")
        moved.append(step)
        ended.append(step.where("over").drop("over"))
        moving = step.where("not over").drop("over")
    follows = reduce(DataFrame.union, ended).select("call_id", F.col("up").alias("head"), "way") if ended else calls.select("call_id", F.col("call_id").alias("head"), F.lit(0).cast("long").alias("way")).limit(0)

    # Heads without a parent are at level 0; the others follow when all their parents' heads have a level.
    heads = written(calls.join(several.select("call_id"), "call_id", "left_anti").select("call_id", F.lit(0).cast("long").alias("level")), "heads")
    more, tables, found = several.where("n > 1").select("call_id"), [edges, several, *moved], [heads]
    if not more.isEmpty():
        waiting = edges.join(more, "call_id").join(follows.select(F.col("call_id").alias("parent_id"), "head", "way"), "parent_id", "left")
        waiting = waiting.select("call_id", F.coalesce("head", "parent_id").alias("head"), F.coalesce("way", F.lit(0)).cast("long").alias("way"))
        waiting = written(waiting.join(heads.select(F.col("call_id").alias("head"), F.lit(True).alias("known")), "head", "left").select("call_id", "head", "way", F.coalesce("known", F.lit(False)).alias("known")), "waiting")
        # A head without parents is shared, but joins no two components: it needs no order.
        inner = waiting.where("not known")
        roots = components(inner.select(F.col("call_id").alias("a"), F.col("head").alias("b")))
        rooted = written(waiting.join(roots.select(F.col("node").alias("call_id"), "root"), "call_id", "left").select("call_id", "head", "way", "known", F.coalesce("root", "call_id").alias("root")), "rooted")
        large = written(rooted.groupBy("root").agg(F.count("*").alias("edges")).where(F.col("edges") > ordered).select("root"), "large")
        kind = calls.schema["call_id"].dataType.simpleString()
        one_by_one = rooted.join(large, "root", "left_anti").groupBy("root").applyInPandas(ordered_levels, f"call_id {kind}, level long")
        found.append(written(one_by_one, "levels"))
        left = rooted.join(large, "root", "left_semi").select("call_id", "head", "way")
        tables += [waiting, rooted, large, found[-1]]
        if not large.isEmpty():
            left, reached = written(left, "waiting"), heads
            tables.append(left)
            while True:
                seen = left.join(reached.select(F.col("call_id").alias("head"), "level"), "head", "left").groupBy("call_id").agg(F.count_if(F.col("level").isNull()).alias("open"), F.max(F.col("level") + F.col("way") + 1).alias("level"))
                new = written(seen.where("open = 0").select("call_id", "level"), "heads")
                tables.append(new)
                if new.isEmpty():
                    break
                found.append(new)
                reached, left = reached.union(new), written(left.join(new.select("call_id"), "call_id", "left_anti"), "waiting")
                tables.append(left)
    settled = reduce(DataFrame.union, found)
    followers = follows.join(settled.select(F.col("call_id").alias("head"), "level"), "head").select("call_id", (F.col("level") + F.col("way")).alias("level"))
    result = written(settled.union(followers), "levels")
    for old in [*tables, heads]:
        dropped(old)
    return calls.select("call_id").join(result, "call_id", "left").join(lost, "call_id", "left").select("call_id", "level", F.coalesce("missing_parent", F.lit(False)).alias("missing_parent"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], parents: DataFrame | None = None, deepest: int = DEEPEST, ordered: int = ORDERED) -> DataFrame:
    """calls: conv_id, call_id, parent_id, name, arguments (JSON text); results: call_id, content; parents: call_id, parent_id of further parents."""
    columns = ["conv_id", "parent_id", "name", "arguments"]
    calls = calls.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("arguments", "name", "parent_id", "conv_id")).alias("c")).select("call_id", *[f"c.{x}" for x in columns])
    answers = results.groupBy("call_id").agg(F.min("content").alias("content"), F.count("*").alias("n_results"))
    calls = written(calls, "calls")
    edges = calls.select("call_id", "parent_id") if parents is None else calls.select("call_id", "parent_id").union(parents.select("call_id", "parent_id").join(calls.select("call_id"), "call_id", "left_semi"))
    ranks = levels(calls.select("call_id"), edges.where("parent_id is not null").distinct(), ordered)
    joined = calls.withColumn("called", F.lit(True)).join(answers, "call_id", "full").join(ranks, "call_id", "left")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        status, error, lines = [], [], []
        for r in batch.to_pylist():
            value = problem = None
            if not r["called"]:
                state = "orphan"
            else:
                value = parsed(r["arguments"], deepest)
                if value is None:
                    state = "unparsed"
                elif r["name"] not in schemas:
                    state = "unknown tool"
                elif problem := schema_error(value, schemas[r["name"]]):
                    state = "invalid"
                elif r["level"] is None:
                    state = "cycle"
                elif r["missing_parent"]:
                    state = "missing parent"
                else:
                    state = "no result" if r["n_results"] is None else "linked"
            status.append(state)
            error.append(problem)
            lines.append(canonical_json({"arguments": value, "id": r["call_id"], "name": r["name"], "parent": r["parent_id"], "result": r["content"]}))
        return pa.RecordBatch.from_pydict({k: batch.column(k) for k in ("conv_id", "call_id", "parent_id", "name", "level")} | {"n_results": pa.array([x or 0 for x in batch.column("n_results").to_pylist()], pa.int64()), "status": pa.array(status), "error": pa.array(error, pa.string()), "canonical": pa.array(lines)})

    kind = {f.name: f.dataType.simpleString() for f in calls.schema}
    schema = f"conv_id {kind['conv_id']}, call_id string, parent_id string, name string, level long, n_results long, status string, error string, canonical string"
    rows = joined.select("conv_id", "call_id", "parent_id", "name", "arguments", "called", "content", "n_results", "level", "missing_parent")
    return map_chunks(rows, "arguments", work, schema)


#: The tools that the turns of a conversation stand for.
SCHEMAS = {
    "reply": {"properties": {"text": {"type": "string", "minLength": 20, "maxLength": 2000}}, "required": ["text"]},
    "configure": {"properties": {"instructions": {"type": "string", "minLength": 1}}, "required": ["instructions"]},
}


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results): a user's turn calls "reply" and continues from the turn before last, a system turn calls "configure"; an assistant's turn is the result of the turn before it."""
    name = lambda n: F.concat_ws(":", F.col("conv_id").cast("string"), n.cast("string"))
    turn = F.col("turn")
    asks = turns.where(F.col("role").isin("user", "system"))
    reply = F.col("role") == "user"
    arguments = F.when(reply, F.to_json(F.struct(F.col("text")))).otherwise(F.to_json(F.struct(F.col("text").alias("instructions"))))
    calls = asks.select("conv_id", name(turn).alias("call_id"), F.when(turn >= 2, name(turn - 2)).alias("parent_id"), F.when(reply, "reply").otherwise("configure").alias("name"), arguments.alias("arguments"))
    results = turns.where(F.col("role") == "assistant").select(name(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


ORACLE_SQL = """with recursive calls as (
  select conv_id, concat(conv_id, ':', turn) as call_id, case when turn >= 2 then concat(conv_id, ':', turn - 2) end as parent_id, case when role = 'user' then 'reply' else 'configure' end as name,
    text, case when role = 'user' then 'text' else 'instructions' end as field from conversations where role in ('user', 'system')),
results as (select concat(conv_id, ':', turn - 1) as call_id, text as content from conversations where role = 'assistant'),
chain(call_id, level) as (
  select call_id, cast(0 as bigint) from calls where parent_id is null or parent_id not in (select call_id from calls)
  union all select c.call_id, h.level + 1 from calls c join chain h on c.parent_id = h.call_id)
select c.conv_id, coalesce(c.call_id, r.call_id) as call_id, c.parent_id, c.name, h.level, cast(r.call_id is not null as bigint) as n_results,
  case when c.call_id is null then 'orphan' when c.name = 'reply' and (length(c.text) < 20 or length(c.text) > 2000) or c.name = 'configure' and length(c.text) < 1 then 'invalid'
    when c.parent_id is not null and h.level = 0 then 'missing parent' when r.call_id is null then 'no result' else 'linked' end as status,
  case when c.name = 'reply' and (length(c.text) < 20 or length(c.text) > 2000) then 'text: length' when c.name = 'configure' and length(c.text) < 1 then 'instructions: length' end as error,
  concat('{"arguments":', case when c.call_id is null then 'null' else concat('{"', c.field, '":', cast(to_json(c.text) as varchar), '}') end, ',"id":', cast(to_json(coalesce(c.call_id, r.call_id)) as varchar), ',"name":',
    coalesce(cast(to_json(c.name) as varchar), 'null'), ',"parent":', coalesce(cast(to_json(c.parent_id) as varchar), 'null'), ',"result":', coalesce(cast(to_json(r.content) as varchar), 'null'), '}') as canonical
from calls c full join results r using (call_id) left join chain h on h.call_id = c.call_id"""
