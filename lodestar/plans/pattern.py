"""A small pattern language over records and edges, compiled to DataFrame plans.

    MATCH (a)-[:relation*1..3]->(b)
    WHERE a.id = "x" AND b.size >= 3 OR b.kind != "draft"
    RETURN b, b.title, a.id ORDER BY b.size DESC LIMIT 10

Text -> tokens -> AST (frozen dataclasses) -> checks -> DataFrame.  Conditions are an
OR of ANDs.  What the grammar doesn't have raises PatternError, wherever it stands.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metadata import as_text, kind_of, raw_value
from ..operators.adjacency import reach, steps
from ..session import written


class PatternError(ValueError):
    """A query that isn't in the language."""


_TOKEN = re.compile(
    r"""\s*(?:(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>-?\d+(?:\.(?!\.)\d+)?)|(?P<word>[^\W\d]\w*)|(?P<sign>->|\.\.|!=|>=|<=|[-()\[\]:*.=<>,]))"""
)
_OPERATORS = ("=", "!=", ">", "<", ">=", "<=")


@dataclass(frozen=True)
class Condition:
    variable: str
    field: str
    operator: str
    value: str


@dataclass(frozen=True)
class Item:
    variable: str
    field: str | None

    @property
    def name(self) -> str:
        return self.variable if self.field is None else f"{self.variable}.{self.field}"


@dataclass(frozen=True)
class Pattern:
    left: str
    right: str
    relation: str | None
    least: int
    most: int
    any_of: tuple[tuple[Condition, ...], ...]
    items: tuple[Item, ...]
    order: Item | None
    descending: bool
    limit: int | None


class _Reader:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise PatternError(f"can't read {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self, value: str | None = None, kind: str | None = None) -> bool:
        if self.at >= len(self.tokens):
            return False
        k, v = self.tokens[self.at]
        return (kind is None or k == kind) and (value is None or (v == value if k == "sign" else k == "word" and v.upper() == value))

    def accept(self, value: str | None = None, kind: str | None = None) -> str | None:
        if self.peek(value, kind):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def expect(self, value: str | None = None, kind: str | None = None) -> str:
        got = self.accept(value, kind)
        if got is None:
            found = self.tokens[self.at][1] if self.at < len(self.tokens) else "the end"
            raise PatternError(f"expected {value or kind}, found {found!r}")
        return got


_RESERVED = {"MATCH", "WHERE", "RETURN", "ORDER", "BY", "LIMIT", "AND", "OR", "ASC", "DESC"}


def parse(text: str) -> Pattern:
    """The AST of a query; PatternError if it isn't one."""
    r = _Reader(text)
    r.expect("MATCH")
    left = _node(r)
    r.expect("-")
    relation, least, most = _edge(r)
    r.expect("->")
    right = _node(r)
    if left == right:
        raise PatternError("the two ends of a pattern need different names")
    known = (left, right)
    any_of: list[tuple[Condition, ...]] = []
    if r.accept("WHERE"):
        while True:
            group = [_condition(r, known)]
            while r.accept("AND"):
                group.append(_condition(r, known))
            any_of.append(tuple(group))
            if not r.accept("OR"):
                break
    r.expect("RETURN")
    items = [_item(r, known)]
    while r.accept(","):
        items.append(_item(r, known))
    order, descending, limit = None, False, None
    if r.accept("ORDER"):
        r.expect("BY")
        order = _item(r, known)
        if order.field is None:
            raise PatternError("ORDER BY needs a field")
        descending = bool(r.accept("DESC"))
        if not descending:
            r.accept("ASC")
    if r.accept("LIMIT"):
        number = r.expect(kind="number")
        if not number.isdigit():
            raise PatternError("LIMIT needs a whole number")
        limit = int(number)
    if r.at < len(r.tokens):
        raise PatternError(f"unexpected {r.tokens[r.at][1]!r}")
    return Pattern(left, right, relation, least, most, tuple(any_of), tuple(dict.fromkeys(items)), order, descending, limit)


def _name(r: _Reader) -> str:
    name = r.expect(kind="word")
    if name.upper() in _RESERVED:
        raise PatternError(f"unexpected {name!r}")
    return name


def _node(r: _Reader) -> str:
    r.expect("(")
    name = _name(r)
    r.expect(")")
    return name


def _edge(r: _Reader) -> tuple[str | None, int, int]:
    r.expect("[")
    relation, least, most = None, 1, 1
    r.accept(":")
    if r.peek(kind="word"):
        relation = r.expect(kind="word")
    if r.accept("*"):
        least = most = _count(r)
        if r.accept(".."):
            most = _count(r)
        if most < least:
            raise PatternError("a range of steps must not fall")
    r.expect("]")
    return relation, least, most


def _count(r: _Reader) -> int:
    number = r.expect(kind="number")
    if not number.isdigit():
        raise PatternError(f"no number of steps: {number}")
    return int(number)


def _condition(r: _Reader, known: tuple[str, str]) -> Condition:
    item = _item(r, known)
    if item.field is None:
        raise PatternError(f"{item.variable} needs a field")
    operator = r.expect(kind="sign")
    if operator not in _OPERATORS:
        raise PatternError(f"unknown operator {operator!r}")
    if (text := r.accept(kind="string")) is not None:
        value = re.sub(r"\\(.)", r"\1", text[1:-1])
    elif (text := r.accept(kind="number")) is not None:
        value = text
    else:
        word = r.expect(kind="word")
        if word.upper() in _RESERVED:
            raise PatternError(f"unexpected {word!r}")
        value = word
    return Condition(item.variable, item.field, operator, value)


def _item(r: _Reader, known: tuple[str, str]) -> Item:
    variable = _name(r)
    if variable not in known:
        raise PatternError(f"unknown variable {variable!r}")
    field = r.expect(kind="word") if r.accept(".") else None
    return Item(variable, field)


def _condition_column(c: Condition) -> Column:
    """False where the field is absent, whatever the operator; = and != compare strings, the others numbers if both are."""
    actual = F.col(f"{c.variable}_id") if c.field == "id" else as_text(F.col(f"{c.variable}_metadata"), c.field)
    if c.operator in ("=", "!="):
        out = actual == F.lit(c.value) if c.operator == "=" else actual != F.lit(c.value)
    else:
        compare = {">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__}[c.operator]
        out = compare(actual, F.lit(c.value))
        try:
            number = float(c.value)
        except ValueError:
            pass
        else:
            cast = actual.try_cast("double")
            out = F.when(cast.isNotNull(), compare(cast, F.lit(number))).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _anchors(pattern: Pattern) -> list[str] | None:
    """Ids one of which the left end must have, if every group of conditions names one."""
    found: list[str] = []
    for group in pattern.any_of:
        own = [c.value for c in group if (c.variable, c.field, c.operator) == (pattern.left, "id", "=")]
        if not own:
            return None
        found.append(own[0])
    return list(dict.fromkeys(found)) or None


def _starts(records: DataFrame, p: Pattern) -> DataFrame:
    """(id) of what the left end may be."""
    anchors = _anchors(p)
    if anchors is not None:
        return records.sparkSession.createDataFrame([(a,) for a in anchors], "id string")
    conditions = [reduce(and_, [_condition_column(c) for c in g if c.variable == p.left], F.lit(True)) for g in p.any_of]
    if not conditions:
        return records.select("id")
    # groups' own conditions on the left end, before anything is walked
    return records.select(F.col("id").alias(f"{p.left}_id"), F.col("metadata").alias(f"{p.left}_metadata")).where(reduce(or_, conditions)).select(F.col(f"{p.left}_id").alias("id"))


def run(records: DataFrame, edges: DataFrame, query: str | Pattern, *, max_nodes: int | None = None, local_edges: int | None = None) -> DataFrame:
    """The rows of a query; columns are named as its RETURN items, with "_" for ".".

    The left end is any live record, or what a condition on its id names (which needs
    no record).  A pair of ends is a row once, by the fewest steps between them along
    the edges' direction; the right end needs no record, but has no fields then.  An
    item without a field is a struct (id, metadata).  Rows without the ORDER BY field
    come last; ties go by the ids.  max_nodes: of each start only so many of the nodes
    it reaches are looked at, itself first, then by depth and id.
    """
    p = parse(query) if isinstance(query, str) else query
    return _rows(records, _pairs(records, edges, p, max_nodes, local_edges), p)


def _pairs(records: DataFrame, edges: DataFrame, p: Pattern, max_nodes: int | None, local_edges: int | None = None) -> DataFrame:
    """(start, node): the ends of what the pattern finds, before conditions."""
    starts = _starts(records, p)
    adjacency = steps(edges, p.relation, "out")
    if (p.least, p.most) == (1, 1) and max_nodes is None:
        # a single step is a join
        pairs = starts.join(adjacency, F.col("id") == F.col("src")).where("src <> dst").select(F.col("src").alias("start"), F.col("dst").alias("node")).distinct()
    else:
        pairs = reach(adjacency, starts, p.most, local_edges=local_edges)
        if max_nodes is not None:
            nearest = Window.partitionBy("start").orderBy("depth", "node")
            pairs = pairs.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= max_nodes)
        pairs = pairs.where((F.col("depth") >= p.least) & (F.col("depth") <= p.most))
        if p.least > 0:
            pairs = pairs.where("start <> node")
    return pairs


def _rows(records: DataFrame, pairs: DataFrame, p: Pattern) -> DataFrame:
    ends = {p.left: "start", p.right: "node"}
    bound = pairs.select(*[F.col(c).alias(f"{v}_id") for v, c in ends.items()])
    used = {c.variable for g in p.any_of for c in g if c.field != "id"} | {i.variable for i in p.items if i.field != "id"}
    if p.order is not None and p.order.field != "id":
        used.add(p.order.variable)
    for v in ends:
        if v in used:
            bound = bound.join(records.select(F.col("id").alias(f"{v}_id"), F.col("metadata").alias(f"{v}_metadata")), f"{v}_id", "left")
    if p.any_of:
        bound = bound.where(reduce(or_, [reduce(and_, [_condition_column(c) for c in g]) for g in p.any_of]))
    if p.order is not None:
        bound = bound.orderBy(*_order(p), f"{p.left}_id", f"{p.right}_id")
    if p.limit is not None:
        if p.order is None:
            bound = bound.orderBy(f"{p.left}_id", f"{p.right}_id")
        bound = bound.limit(p.limit)
    return bound.select(*[_returned(i) for i in p.items])


def _order(p: Pattern) -> list[Column]:
    """Numbers by value, then other values as text; rows without the field last."""
    field = p.order.field
    if field == "id":
        keys = [F.col(f"{p.order.variable}_id")]
    else:
        metadata = F.col(f"{p.order.variable}_metadata")
        number = F.when(kind_of(metadata, field) != "STRING", raw_value(metadata, field).try_cast("double"))
        keys = [number, as_text(metadata, field)]
    return [k.desc_nulls_last() if p.descending else k.asc_nulls_last() for k in keys]


def _returned(item: Item) -> Column:
    if item.field is None:
        return F.struct(F.col(f"{item.variable}_id").alias("id"), F.col(f"{item.variable}_metadata").alias("metadata")).alias(item.variable)
    value = F.col(f"{item.variable}_id") if item.field == "id" else raw_value(F.col(f"{item.variable}_metadata"), item.field)
    return value.alias(item.name.replace(".", "_"))


@dataclass
class Found:
    """rows of a query; truncated: whether some start reaches more nodes than were asked for."""

    rows: DataFrame
    truncated: bool


def run_capped(records: DataFrame, edges: DataFrame, query: str | Pattern, max_nodes: int = 1000) -> Found:
    """As run(), of each start with the max_nodes nearest of the nodes it reaches, itself counted, by depth and id."""
    p = parse(query) if isinstance(query, str) else query
    if (p.least, p.most) == (1, 1) and max_nodes > 0:
        # one step: neighbours are sorted where they are, and the last of max_nodes tells whether there are too many
        near = steps(edges, p.relation, "out").where("src <> dst").join(_starts(records, p), F.col("src") == F.col("id"), "left_semi")
        near = near.repartition("src").distinct().withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("place") <= max_nodes)
        near = written(near, "near")
        pairs = near.where(F.col("place") < max_nodes).select(F.col("src").alias("start"), F.col("dst").alias("node"))
        return Found(_rows(records, pairs, p), not near.where(F.col("place") == max_nodes).isEmpty())
    return Found(run(records, edges, query, max_nodes=max_nodes), truncated(records, edges, query, max_nodes))


def truncated(records: DataFrame, edges: DataFrame, query: str | Pattern, max_nodes: int = 1000) -> bool:
    """Whether some start of the query reaches more than max_nodes nodes."""
    p = parse(query) if isinstance(query, str) else query
    counts = reach(steps(edges, p.relation, "out"), _starts(records, p), p.most).groupBy("start").count()
    return not counts.where(F.col("count") > max_nodes).isEmpty()


def explain(query: str) -> str:
    """The AST of a query as JSON."""
    return json.dumps(parse(query), default=vars)
