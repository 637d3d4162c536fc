"""The elements that returns have, gathered from the returns themselves: paths, types, whether they repeat.

A schema that is handed to ``from_xml`` reads what it names and is silent about a name that no return has. The catalogue tells: fields
are named by path alone, or by a pattern, and get their type from it; a name that nothing fits is an error. It has a row for each
path of the corpus, some thousands, whatever the number of returns.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import return_schema

#: Kinds of values from the narrow to the wide; a path has the widest of its values'.
KINDS = ("bigint", "double", "string")
WHOLE, REAL = re.compile(r"[+-]?\d{1,18}"), re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
#: Names of elements whose digits are no amounts: a leading zero counts, or they are dates and codes.
TEXTS = re.compile(r"(Dt|Cd|Txt|Nm|Num|EIN|SSN|Id|ZIPCd|Ts)$")


def kind_of(name: str, text: str) -> int:
    """Index of the narrowest kind that holds a value."""
    if TEXTS.search(name) or not text:
        return 2 if text else 0
    return 0 if WHOLE.fullmatch(text) and not (len(text) > 1 and text[0] == "0") else 1 if REAL.fullmatch(text) and not re.match(r"0\d", text) else 2


def paths_of(xml: str | None) -> dict[str, list[int]]:
    """Path to (values, most of them in one parent, kind, whether it is a leaf) of one return; nothing for one that is no XML. Names lose their namespace."""
    found: dict[str, list[int]] = {}
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return found
    stack = [(root, "")]
    while stack:
        node, path = stack.pop()
        counts: dict[str, int] = {}
        for child in node:
            name = child.tag.rsplit("}", 1)[-1]
            counts[name] = counts.get(name, 0) + 1
            own = f"{path}.{name}" if path else name
            at = found.setdefault(own, [0, 0, 0, 0])
            at[0] += 1
            at[1] = max(at[1], counts[name])
            if len(child):
                stack.append((child, own))
            else:
                at[2], at[3] = max(at[2], kind_of(name, (child.text or "").strip())), 1
                if child.attrib:
                    value = found.setdefault(f"{own}._VALUE", [0, 1, 0, 1])
                    value[0], value[2] = value[0] + 1, max(value[2], at[2])
            for key in child.attrib:
                at = found.setdefault(f"{own}._{key.rsplit('}', 1)[-1]}", [0, 1, 2, 1])
                at[0] += 1
    return found


def catalogue(returns: DataFrame, xml_col: str = "xml") -> DataFrame:
    """(path, returns, values, repeated, kind): every element and attribute below the root of all returns. ``kind`` is null where an element holds only others.

    A task counts its returns by path, so what is exchanged is a row for each path and task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = {}
        for batch in batches:
            for xml in batch.column(0).to_pylist():
                for path, (n, most, kind, leaf) in paths_of(xml).items():
                    at = total.setdefault(path, [0, 0, 0, 0, 0])
                    total[path] = [at[0] + 1, at[1] + n, max(at[2], most), max(at[3], kind), max(at[4], leaf)]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *(pa.array([v[i] for v in total.values()], pa.int64()) for i in range(5))], ["path", "returns", "values", "most", "kind", "leaf"])

    found = returns.select(F.col(xml_col).cast("string").alias("xml")).mapInArrow(run, "path string, returns long, values long, most long, kind long, leaf long")
    per = found.groupBy("path").agg(F.sum("returns").alias("returns"), F.sum("values").alias("values"), F.max("most").alias("most"), F.max("kind").alias("kind"), F.max("leaf").alias("leaf"))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("kind") + 1).cast("int"))
    return per.select("path", "returns", "values", (F.col("most") > 1).alias("repeated"), F.when(F.col("leaf") == 1, kind).alias("kind"))


class Catalogue:
    """The rows of ``catalogue`` on the driver, to resolve names."""

    def __init__(self, rows: Iterable):
        self.kinds = {r["path"]: r["kind"] for r in rows}
        self.repeated = {r["path"] for r in rows if r["repeated"]}
        self.parents = {p.rsplit(".", 1)[0] for p in self.kinds if "." in p}

    def marked(self, path: str) -> str:
        """The path with ``[]`` behind what repeats."""
        names = path.split(".")
        return ".".join(n + ("[]" if ".".join(names[: i + 1]) in self.repeated else "") for i, n in enumerate(names))

    def resolve(self, *patterns: str) -> list[str]:
        """Fields for ``return_schema``. A pattern is a path below ``ReturnData`` or from the header on; ``*`` stands for one name or part of it, ``**`` for any number of them.

        Patterns take what holds a value. One that fits nothing is an error that names what is near.
        """
        out: dict[str, None] = {}
        for pattern in patterns:
            whole = pattern if pattern.startswith("ReturnHeader") else f"ReturnData.{pattern}"
            parts = [r".*" if n == "**" else "[^.]*".join(map(re.escape, n.split("*"))) for n in whole.split(".")]
            fits = re.compile(r"\.".join(parts))
            found = [p for p, kind in self.kinds.items() if kind is not None and p not in self.parents and fits.fullmatch(p)]
            if not found:
                near = difflib.get_close_matches(whole, self.kinds, 3, 0.5)
                raise ValueError(f"no return has {pattern!r}" + (f"; near are {', '.join(near)}" if near else ""))
            out |= dict.fromkeys(f"{self.marked(p).removeprefix('ReturnData.')} {self.kinds[p]}" for p in sorted(found))
        return list(out)

    def schema(self, *patterns: str) -> str:
        """DDL of a return with what the plans read and what the patterns name."""
        return return_schema(self.resolve(*patterns))
