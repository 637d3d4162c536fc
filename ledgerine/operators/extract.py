"""All that a plan wants of a document in one parse: tagged facts, leaves, text behind anchors, tables, markup.

A row a document comes back, so nothing has to be joined or gathered by document again. Predicates say in Python what is worth
sending; numbers are read from the texts by expressions, as everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ..schemas import CONTEXT
from . import html, ixbrl

#: White space by Unicode's property, as ``functions.formatting.trimmed`` takes it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
Test = Callable[[str], bool]


@dataclass(frozen=True)
class Wanted:
    """``facts``: names of concepts, None for all, empty for none. ``leaf``, ``anchor``, ``table``: which texts of leaves, leaves with following
    text (of ``budget`` bytes) and tables are sent; None: none. ``markup``: tags of elements whose markup is sent."""

    facts: frozenset[str] | None = frozenset()
    leaf: Test | None = None
    anchor: Test | None = None
    budget: int = 700
    table: Test | None = None
    markup: frozenset[str] = frozenset()


def following(rows: list[tuple], at: int, budget: int) -> str:
    """Text of the leaves behind node ``at``, as far up as its parent's parent, until ``budget`` bytes are reached."""
    least, text = rows[at][3] - 2, ""
    for i in range(rows[at][1] + 1, len(rows)):
        row = rows[i]
        if row[10] and row[12] and row[3] >= least and not (row[11] and row[3] - 1 >= least):
            if 4 * len(text) >= budget and len(text.strip(WHITE).encode()) >= budget:  # a character has four bytes at most
                break
            text += row[12]
    return text.strip(WHITE)


def of_document(source: str | None, wanted: Wanted) -> tuple[list[dict], list[dict], list[dict], list[dict], list[dict]]:
    """(facts, leaves, anchors, tables, markup), each in document order."""
    own, values = html.layout(source)
    facts = [] if wanted.facts is not None and not wanted.facts else ixbrl.facts_in(own, values, wanted.facts)
    rows = own.rows(values, wanted.markup | html.TABLES) if wanted.leaf or wanted.anchor or wanted.table or wanted.markup else []
    leaves, anchors, tables = [], [], []
    for row in rows:
        if row[10] and not row[11] and row[12] and (text := row[12].strip(WHITE)):
            if wanted.leaf and wanted.leaf(text):
                leaves.append({"node_id": row[0], "text": text})
            if wanted.anchor and wanted.anchor(text):
                anchors.append({"node_id": row[0], "text": following(rows, row[0], wanted.budget)})
        if wanted.table and row[5] == "element" and row[6] == "table" and (text := row[12].strip(WHITE)) and wanted.table(text):
            tables.append({"node_id": row[0], "text": text, "outer_html": row[13]})
    return facts, leaves, anchors, tables, [{"node_id": row[0], "tag": row[6], "outer_html": row[13]} for row in rows if row[6] in wanted.markup]


_TEXT = [("node_id", pa.int32()), ("text", pa.string())]
_KINDS = {
    "facts": pa.list_(pa.struct(list(ixbrl.FACT_TYPES.items()))), "leaves": pa.list_(pa.struct(_TEXT)), "anchors": pa.list_(pa.struct(_TEXT)),
    "tables": pa.list_(pa.struct([*_TEXT, ("outer_html", pa.string())])), "markup": pa.list_(pa.struct([("node_id", pa.int32()), ("tag", pa.string()), ("outer_html", pa.string())])),
}
_DDL = f"facts array<struct<node_id:int,type:string,{','.join(f'{k}:string' for k in ixbrl.ATTRIBUTES)},content:string,context:{CONTEXT}>>, leaves array<struct<node_id:int,text:string>>, anchors array<struct<node_id:int,text:string>>, tables array<struct<node_id:int,text:string,outer_html:string>>, markup array<struct<node_id:int,tag:string,outer_html:string>>"


def extracts(docs: DataFrame, keys: list[str], html_col: str, wanted: Wanted, tasks: int | None = None) -> DataFrame:
    """``keys``, facts, leaves, anchors, tables and markup: a row for each document. ``tasks``: documents are dealt out first, where they come in few partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):  # what is found in a document may be large
                part = batch.slice(lo, 64)
                found = [of_document(raw.decode(errors="replace") if isinstance(raw, bytes) else raw, wanted) for raw in part.column(len(keys)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *(pa.array([x[i] for x in found], t) for i, t in enumerate(_KINDS.values()))], [*keys, *_KINDS])

    given = docs.select(*keys, html_col)
    given = given.repartition(tasks) if tasks else given
    return given.mapInArrow(run, ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys), _DDL]))
