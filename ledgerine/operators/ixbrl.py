"""Inline XBRL over node tables: tagged facts, contexts, the context join, and first or all matches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CONTEXT
from . import html

KINDS = {"ix:nonfraction": "NonFraction", "ix:nonnumeric": "NonNumeric", "ix:fraction": "Fraction", "xbrli:context": "Context", "xbrli:unit": "Unit"}


def tagged(nodes: DataFrame) -> DataFrame:
    """Every element with a namespace in its tag; ``type`` is null for those that are not decoded. One of a known type that cannot be read as XML goes, with all inside it."""
    known = F.lit(None).cast("string")
    for k, v in KINDS.items():
        known = F.when(F.col("tag") == k, F.lit(v)).otherwise(known)
    return nodes.where("kind = 'element' and contains(tag, ':') and not lost").withColumn("type", known)


def facts(nodes: DataFrame, keys: list[str]) -> DataFrame:
    attr = lambda name: F.coalesce(F.col("attrs")[name], F.lit(""))
    own = tagged(nodes).where("type in ('NonFraction', 'NonNumeric', 'Fraction')")
    return own.select(*keys, "node_id", "type", *[attr(v).alias(k) for k, v in ATTRIBUTES.items()], F.coalesce("content", F.lit("")).alias("content"))


def contexts(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node_id, id, context). What stands inside a context is found by interval, within a document."""
    outer = nodes.where("tag = 'xbrli:context' and not lost").select(*keys, F.col("node_id").alias("c"), F.col("subtree_end").alias("e"), F.coalesce(F.col("attrs")["id"], F.lit("")).alias("id"))
    tags = ("xbrli:identifier", "xbrldi:explicitmember", "xbrldi:typedmember", "xbrli:startdate", "xbrli:enddate", "xbrli:instant")
    inner = nodes.where(F.col("tag").isin(*tags)).select(*keys, "node_id", "tag", F.coalesce("content", F.lit("")).alias("content"), F.col("attrs")["scheme"].alias("scheme"), F.coalesce(F.col("attrs")["dimension"], F.lit("")).alias("dimension"))
    both = outer.join(inner, keys, "left").where("node_id is null or (node_id > c and node_id <= e)")
    one = lambda tag: F.coalesce(F.max_by(F.when(F.col("tag") == tag, F.col("content")), F.when(F.col("tag") == tag, F.col("node_id"))), F.lit(""))
    many = lambda tag: F.transform(F.array_sort(F.collect_list(F.when(F.col("tag") == tag, F.struct("node_id", "dimension", "content")))), lambda x: F.struct(x["dimension"].alias("dimension"), x["content"].alias("content")))
    found = both.groupBy(*keys, "c", "id").agg(
        F.coalesce(F.max_by(F.when(F.col("tag") == "xbrli:identifier", F.coalesce("scheme", F.lit(""))), F.when(F.col("tag") == "xbrli:identifier", F.col("node_id"))), F.lit("")).alias("scheme"), one("xbrli:identifier").alias("identifier"), many("xbrldi:explicitmember").alias("explicit_members"),
        many("xbrldi:typedmember").alias("typed_members"), one("xbrli:startdate").alias("start_date"), one("xbrli:instant").alias("instant"), one("xbrli:enddate").alias("end_date"),
    )
    found = outer.select(*keys, "c", "id").join(found, [*keys, "c", "id"], "left")
    empty = lambda n: F.coalesce(n, F.lit(""))
    context = F.struct(
        F.col("id"),
        F.struct(F.struct(empty("scheme").alias("scheme"), empty("identifier").alias("content")).alias("identifier"), F.struct("explicit_members", "typed_members").alias("segment")).alias("entity"),
        F.struct(empty("start_date").alias("start_date"), empty("instant").alias("instant"), empty("end_date").alias("end_date")).alias("period"),
    )
    return found.select(*keys, F.col("c").alias("node_id"), "id", context.alias("context"))


ATTRIBUTES = {"unit_ref": "unitref", "decimals": "decimals", "name": "name", "format": "format", "scale": "scale", "id": "id", "context_ref": "contextref", "sign": "sign"}
_MEMBERS = pa.list_(pa.struct([("dimension", pa.string()), ("content", pa.string())]))
_CONTEXT = pa.struct([
    ("id", pa.string()), ("entity", pa.struct([("identifier", pa.struct([("scheme", pa.string()), ("content", pa.string())])), ("segment", pa.struct([("explicit_members", _MEMBERS), ("typed_members", _MEMBERS)]))])),
    ("period", pa.struct([("start_date", pa.string()), ("instant", pa.string()), ("end_date", pa.string())])),
])


FACT_TYPES = {"node_id": pa.int32(), "type": pa.string(), **dict.fromkeys(ATTRIBUTES, pa.string()), "content": pa.string(), "context": _CONTEXT}


def facts_of(source: str | None, names: frozenset[str] | None = None) -> list[dict]:
    """The facts of one document in its order (of the concepts ``names``, if given), each with its context: of contexts that share an id the last, None where there is none."""
    return facts_in(*html.layout(source), names)


def facts_in(own: html.Layout, values: list[str] | None, names: frozenset[str] | None = None) -> list[dict]:
    """The same from a layout and the texts of its slots. Contexts are read for the facts that are wanted alone."""
    found, contexts = _found(own, values, names)
    return [{"node_id": i, "type": kind, **dict(zip(ATTRIBUTES, attrs, strict=True)), "content": content, "context": None if at is None else _context(contexts[at])} for i, kind, attrs, content, at in found]


def _plan(own: html.Layout, names: frozenset[str] | None) -> tuple[list, list]:
    """Where a layout has facts and the contexts that they refer to: all but the texts."""
    texts = dict(own.contents)
    found = [(i, x[1], x[6], x[7], texts[i]) for i, x in enumerate(own.fixed) if x[5] == "element" and ":" in x[6] and not own.lost[i]]
    wanted = [(i, KINDS[tag], attrs, at) for i, _, tag, attrs, at in found if KINDS.get(tag) in ("NonFraction", "NonNumeric", "Fraction") and (names is None or attrs.get("name", "") in names)]
    asked, contexts = {attrs.get("contextref", "") for _, _, attrs, _ in wanted}, {}
    for k, (_, end, tag, attrs, _) in enumerate(found):
        if tag == "xbrli:context" and attrs.get("id", "") in asked:
            inner: dict[str, list[tuple[dict, list[int]]]] = {}
            for j, _, t, a, at in found[k + 1 :]:
                if j > end:
                    break
                inner.setdefault(t, []).append((a, at))
            last = lambda t: inner[t][-1][1] if t in inner else []  # noqa: E731, B023
            many = lambda t: [(a.get("dimension", ""), at) for a, at in inner.get(t, ())]  # noqa: E731, B023
            scheme = inner["xbrli:identifier"][-1][0].get("scheme", "") if "xbrli:identifier" in inner else ""
            contexts[attrs.get("id", "")] = (attrs.get("id", ""), scheme, last("xbrli:identifier"), many("xbrldi:explicitmember"), many("xbrldi:typedmember"), last("xbrli:startdate"), last("xbrli:instant"), last("xbrli:enddate"))
    order = {ref: n for n, ref in enumerate(contexts)}
    return [(i, kind, tuple(attrs.get(v, "") for v in ATTRIBUTES.values()), at, order.get(attrs.get("contextref", ""))) for i, kind, attrs, at in wanted], list(contexts.values())


def _found(own: html.Layout, values: list[str] | None, names: frozenset[str] | None) -> tuple[list[tuple], list[tuple]]:
    """Facts (node_id, type, attributes, content, place of the context) and contexts (id, scheme, identifier, explicit, typed, start, instant, end)."""
    if ("facts", names) not in own.plans:
        own.plans["facts", names] = _plan(own, names)
    facts, contexts = own.plans["facts", names]
    texts = own.data(values) if facts else []
    text = lambda at: texts[at[0]] if len(at) == 1 else "".join([texts[c] for c in at])
    many = lambda all_: [{"dimension": d, "content": text(at)} for d, at in all_]
    return (
        [(i, kind, attrs, text(at), c) for i, kind, attrs, at, c in facts],
        [(id_, scheme, text(who), many(explicit), many(typed), text(start), text(instant), text(end)) for id_, scheme, who, explicit, typed, start, instant, end in contexts],
    )


def _context(x: tuple) -> dict:
    id_, scheme, who, explicit, typed, start, instant, end = x
    return {"id": id_, "entity": {"identifier": {"scheme": scheme, "content": who}, "segment": {"explicit_members": explicit, "typed_members": typed}}, "period": {"start_date": start, "instant": instant, "end_date": end}}


def _contexts(rows: list[tuple]) -> pa.StructArray:
    """The same as a column."""
    id_, scheme, who, explicit, typed, start, instant, end = zip(*rows, strict=True) if rows else [()] * 8
    text = lambda x: pa.array(x, pa.string())
    struct = lambda **of: pa.StructArray.from_arrays(list(of.values()), list(of))
    segment = struct(explicit_members=pa.array(explicit, _MEMBERS), typed_members=pa.array(typed, _MEMBERS))
    entity = struct(identifier=struct(scheme=text(scheme), content=text(who)), segment=segment)
    return struct(id=text(id_), entity=entity, period=struct(start_date=text(start), instant=text(instant), end_date=text(end)))


def parsed_facts(docs: DataFrame, keys: list[str], html_col: str, names: frozenset[str] | None = None, tasks: int | None = None) -> DataFrame:
    """The facts of documents with their contexts, like ``with_context(facts(..), contexts(..))``, in one parse and without an exchange, but for dealing documents out to ``tasks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, contexts = [], [], []
            for i, raw in enumerate(batch.column(len(keys)).to_pylist()):
                facts, own = _found(*html.layout(raw.decode(errors="replace") if isinstance(raw, bytes) else raw), names)
                at += [i] * len(facts)
                found += [(*x[:4], None if x[4] is None else x[4] + len(contexts)) for x in facts]
                contexts += own
            heads = [c.take(pa.array(at, pa.int64())) for c in batch.columns[: len(keys)]]
            node, kind, attrs, content, place = zip(*found, strict=True) if found else [()] * 5
            attrs = zip(*attrs, strict=True) if found else [()] * len(ATTRIBUTES)
            own = [pa.array(node, pa.int32()), pa.array(kind, pa.string()), *(pa.array(x, pa.string()) for x in attrs), pa.array(content, pa.string()), _contexts(contexts).take(pa.array(place, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*heads, *own], [*keys, *FACT_TYPES])

    given = docs.select(*keys, html_col)
    given = given.repartition(tasks) if tasks else given
    own = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys), "node_id int, type string", *(f"{k} string" for k in ATTRIBUTES), f"content string, context {CONTEXT}"])
    return given.mapInArrow(run, own)


def with_context(found: DataFrame, ctx: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on the reference; of contexts that share an id the last in the document counts."""
    last = ctx.groupBy(*keys, F.col("id").alias("context_ref")).agg(F.max_by("context", "node_id").alias("context"))
    return found.join(last, [*keys, "context_ref"], "left")


def units(nodes: DataFrame, keys: list[str]) -> DataFrame:
    outer = nodes.where("tag = 'xbrli:unit' and not lost").select(*keys, F.col("node_id").alias("u"), F.col("subtree_end").alias("e"), F.coalesce(F.col("attrs")["id"], F.lit("")).alias("id"))
    inner = nodes.where("tag = 'xbrli:measure'").select(*keys, "node_id", "content")
    return outer.join(inner, keys).where("node_id > u and node_id <= e").groupBy(*keys, "u", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "content"))), lambda x: x["content"]).alias("measures")).drop("u")


def all_where(found: DataFrame, kind: str, predicate: Column) -> DataFrame:
    return found.where((F.col("type") == kind) & predicate)


def any_where(found: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """What fits the predicate of its kind, for several kinds in one pass: a union of ``all_where`` would parse each document once for each."""
    fits = F.lit(False)
    for kind, predicate in predicates.items():
        fits = F.when(F.col("type") == kind, predicate).otherwise(fits)
    return found.where(fits)


def first_where(found: DataFrame, keys: list[str], kind: str, predicate: Column, no_segment: bool = False) -> DataFrame:
    """The first match of each document. Facts with dimensions count unless ``no_segment``."""
    out = all_where(found, kind, predicate)
    if no_segment:
        out = out.where("context is null or (size(context.entity.segment.explicit_members) = 0 and size(context.entity.segment.typed_members) = 0)")
    return out.groupBy(*keys).agg(F.min_by(F.struct("*"), "node_id").alias("fact"))
