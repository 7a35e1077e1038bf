"""Nested layout payloads flattened to text, layout entries and key/value pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.structs import pinned
from ..functions.text import strip

NODE_TYPE = "struct<open:boolean,raw:string,node:variant>"
ENTRY_TYPE = "struct<text:string,score:double,bbox:string,box:string,type:string,label:string>"


def nesting_depth(payload: Column) -> Column:
    """Deepest bracket nesting of a JSON text, brackets inside strings left out."""
    bare = F.regexp_replace(payload, r'"(?:[^"\\]|\\.)*+"', "")
    steps = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda acc, s: F.struct(
            (acc["now"] + F.when(s.isin("[", "{"), 1).when(s.isin("]", "}"), -1).otherwise(0)).alias("now"),
            F.greatest(
                acc["top"], acc["now"] + F.when(s.isin("[", "{"), 1).otherwise(0)
            ).alias("top"),
        ),
    )
    return walked["top"]


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _node(raw: Column, node: Column, opened: bool) -> Column:
    return F.struct(F.lit(opened).alias("open"), raw.alias("raw"), node.alias("node"))


def _children(n: Column) -> Column:
    """Direct children in document order. A VARIANT object sorts its keys, so order is read from the raw text."""
    keys = F.json_object_keys(n["raw"])
    raws = F.from_json(n["raw"], "map<string,string>")
    nodes = F.try_variant_get(n["node"], "$", "map<string,variant>")
    members = F.transform(
        keys, lambda k: _node(F.try_element_at(raws, k), F.try_element_at(nodes, k), True)
    )
    raw_items = F.from_json(n["raw"], "array<string>")
    items = F.transform(
        F.try_variant_get(n["node"], "$", "array<variant>"),
        lambda v, i: _node(F.get(raw_items, i), v, True),
    )
    return (
        F.when(F.startswith(_kind(n["node"]), F.lit("OBJECT")), members)
        .when(F.startswith(_kind(n["node"]), F.lit("ARRAY")), items)
        .otherwise(F.array().cast(f"array<{NODE_TYPE}>"))
    )


def _string(v: Column) -> Column:
    """Value of a JSON string, null for any other kind."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _member(n: Column, name: str) -> Column:
    return F.try_variant_get(n, f"$.{name}", "variant")


def _truthy(v: Column) -> Column:
    kind = _kind(v)
    size = F.size(F.try_variant_get(v, "$", "array<variant>"))
    return (
        v.isNotNull()
        & (kind != "VOID")
        & ~F.coalesce((kind == "STRING") & (F.try_variant_get(v, "$", "string") == ""), F.lit(False))
        & ~F.coalesce((kind == "BOOLEAN") & ~F.try_variant_get(v, "$", "boolean"), F.lit(False))
        & ~F.coalesce(kind.isin("BIGINT", "DOUBLE") & (F.try_variant_get(v, "$", "double") == 0), F.lit(False))
        & ~F.coalesce(F.startswith(kind, F.lit("ARRAY")) & (size == 0), F.lit(False))
        & (kind != "OBJECT<>")
    )


def _first_truthy(n: Column, names: list[str]) -> Column:
    """String value of the first member that is set; null when that member is no string."""
    out = None
    for name in names:
        v = _member(n, name)
        out = F.when(_truthy(v), _string(v)) if out is None else out.when(_truthy(v), _string(v))
    return out


def _number(v: Column) -> Column:
    kind = _kind(v)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))
    flag = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("double"))
    return F.when(number, F.try_variant_get(v, "$", "double")).otherwise(flag)


def _json(v: Column) -> Column:
    return F.when(v.isNotNull(), F.to_json(v))


def _entry(text: Column, **known: Column) -> Column:
    blank = F.lit(None).cast("string")
    return F.struct(
        text.alias("text"),
        known.get("score", F.lit(None).cast("double")).alias("score"),
        *[known.get(k, blank).alias(k) for k in ("bbox", "box", "type", "label")],
    )


def nodes_of(payload: Column) -> Column:
    """All nodes of a JSON text in pre-order, whatever its nesting; null if the text is no JSON.

    The tree is opened inside the row, one level at a time and as often as its own brackets are nested: every open node
    is replaced in place by itself, closed, and its children. No other row's depth matters and nothing is cut off.
    """
    root = F.array(_node(payload, F.try_parse_json(payload), True)).cast(f"array<{NODE_TYPE}>")

    def opened(nodes: Column, _: Column) -> Column:
        inside = lambda n: F.concat(F.array(_node(n["raw"], n["node"], False)), _children(n))
        return F.flatten(F.transform(nodes, lambda n: F.when(n["open"], inside(n)).otherwise(F.array(n)))).cast(f"array<{NODE_TYPE}>")

    levels = F.sequence(F.lit(1), F.greatest(nesting_depth(payload), F.lit(1)))
    return F.aggregate(levels, root, opened)


def flatten_layout(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``text``, ``layout``, ``kv`` and ``confidence`` read from a JSON payload of any nesting.

    Row by row, on tables and streams alike: nothing is measured first, exploded or shuffled. ``complete`` is false
    for a payload that is null or no JSON; it gives an empty text, no entries and no pairs.
    """
    out = pinned(df, {"_nodes": nodes_of(F.col(payload))})

    def facts(n: Column) -> Column:
        node = n["node"]
        is_object = F.startswith(_kind(node), F.lit("OBJECT"))
        named = strip(_first_truthy(node, ["text", "transcription", "label"]))
        titled = is_object & (named != "")
        parts = F.try_variant_get(node, "$", "array<variant>")
        second = strip(_string(F.get(parts, 1)))
        leaf = strip(_string(node))
        key = _first_truthy(node, ["key", "field", "name"])
        value = _member(node, "value")
        score = _number(F.get(parts, 2))
        return F.struct(
            F.when(titled, named).when(second.isNotNull(), second).when(leaf != "", leaf).alias("text"),
            F.when(
                titled,
                _entry(
                    named, score=_number(_member(node, "score")), bbox=_json(_member(node, "bbox")),
                    box=_json(_member(node, "box")), type=_string(_member(node, "type")),
                    label=_string(_member(node, "label")),
                ),
            )
            .when(second.isNotNull(), _entry(second, score=score, box=_json(F.get(parts, 0))))
            .alias("entry"),
            F.when(
                is_object & key.isNotNull() & ~key.isin("text", "label") & value.isNotNull() & (_kind(value) != "VOID"),
                F.struct(key.alias("key"), F.coalesce(_string(value), F.to_json(value)).alias("value")),
            ).alias("pair"),
        )

    out = pinned(out, {"_facts": F.transform("_nodes", facts)})
    facts_col = F.col("_facts")
    layout = F.filter(F.transform(facts_col, lambda f: f["entry"]), lambda e: e.isNotNull())
    pairs = F.filter(F.transform(facts_col, lambda f: f["pair"]), lambda p: p.isNotNull())
    texts = F.filter(F.transform(facts_col, lambda f: f["text"]), lambda t: t.isNotNull() & (t != ""))
    # The last pair written for a key wins; keys keep the order they first appear in.
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    kv = F.map_from_entries(
        F.transform(
            keys,
            lambda k: F.struct(k, F.try_element_at(F.filter(pairs, lambda p: p["key"] == k), F.lit(-1))["value"]),
        )
    )
    scored = F.filter(F.transform(layout, lambda e: e["score"]), lambda s: s.isNotNull())
    total = F.aggregate(scored, F.lit(0.0), lambda acc, s: acc + s)
    return (
        out.withColumn("text", strip(F.array_join(texts, "\n")))
        .withColumn("layout", layout)
        .withColumn("kv", kv)
        .withColumn("confidence", F.when(F.size(scored) > 0, total / F.size(scored)).otherwise(F.lit(0.0)))
        .withColumn("complete", F.coalesce(F.get("_nodes", 0)["node"].isNotNull(), F.lit(False)))
        .drop("_nodes", "_facts")
    )
