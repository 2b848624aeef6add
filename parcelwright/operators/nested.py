"""Deeply nested records as related flat tables.

A record (JSON text) is read once, from left to right, as a stream of triples: path, ordinals, value. No tree of the
record is built and nothing recurses, so depth, length and wrapping have no limit but memory for one record's triples.
Paths that share the same repeated ancestor form a group, and each instance of the group becomes one row that keeps its
place, its parent's place and its members. All triples of a record come from one row, so grouping and pivoting need no
shuffle. Records that already are nested columns are written as JSON and go through the same operator.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from json.decoder import scanstring
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pandas as pd

PARTS = "record_id long, entity string, pos int, parent string, parent_pos int, child_pos int, members map<string,string>"
PATHS_HELD = 50_000  # paths that a task remembers; between records it forgets them beyond that, which changes no result

_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_S = r"[ \t\n\r]*"
_SIMPLE = r'(?:"([^"\\]*)"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|-?Infinity|NaN)|(true|false|null))'
_BLANK = re.compile(_S)
_COLON = re.compile(f"{_S}:{_S}")
_VALUE = re.compile(_SIMPLE)
_MEMBER = re.compile(f'"([^"\\\\]*)"{_S}:{_S}{_SIMPLE}{_S}([,}}]){_S}')  # a member with a simple value, and what follows it
_ELEMENT = re.compile(rf"{_SIMPLE}{_S}([,\]]){_S}")
_WORDS = {"true": "true", "false": "false", "null": None}
_OPEN, _PERHAPS = object(), object()  # in place of a value: an object begins here; it does if its holder is a list by name


@dataclass(frozen=True)
class Layout:
    """What repeats in a family of records.

    ``lists``: canonical key of a repeated member, and the name of the entity its elements are. A single object in
    place of the list is its one element. ``keyed``: entities whose list may also be an object of objects by name;
    ``own``: members by which such an entity is told from that; the name goes to the member ``key_member``.
    """

    lists: dict[str, str]
    keyed: dict[str, str] = field(default_factory=dict)
    own: frozenset[str] = frozenset()


@lru_cache(maxsize=1 << 14)
def canonical(key: str) -> str:
    """One spelling of a member's name: lower case with underscores."""
    return _CAMEL.sub("_", key).replace("-", "_").lower()


class Path:
    """A path in a family of records: its steps from the root, a repeated one ending with ``[]`` and having an ordinal.

    ``group`` is the nearest repeated path, this one included, ``owner`` the one above that; ``entity`` is what a
    repeated path's objects are.
    """

    __slots__ = ("parent", "key", "step", "entity", "group", "owner", "kids", "layout", "renamed", "_column")

    def __init__(self, parent: Path | None, key: str | int, layout: Layout):
        self.parent, self.key, self.layout, self.kids, self.renamed, self._column = parent, key, layout, {}, {}, None
        name = canonical(key) if isinstance(key, str) else str(key)
        self.entity = layout.lists.get(name) if isinstance(key, str) and parent else None
        self.step = name if self.entity is None else f"{name}[]"
        above = parent.group if parent else None
        self.group, self.owner = (self, above) if self.entity else (above, parent.owner if parent else None)

    def at(self, key: str | int) -> Path:
        """The path of a member, or of an element of a list that isn't a repeated member."""
        found = self.kids.get(key)
        if found is None:
            found = self.kids[key] = Path(self, key, self.layout)
        return found

    def steps(self, above: Path | None = None) -> list[str]:
        """The steps from ``above`` (else the root) to here."""
        out, path = [], self
        while path is not above and path.parent is not None:
            out.append(path.step)
            path = path.parent
        return out[::-1]

    @property
    def column(self) -> str:
        """The steps below the group, with dots between them."""
        if self._column is None:
            self._column = ".".join(self.steps(self.group))
        return self._column

    def without_name(self, top: Path) -> tuple[Path, str | int, bool]:
        """(the same path where the members of ``top`` are elements by name, that name, whether the name is one of a repeated member)."""
        chain = [self]
        while chain[-1].parent is not top and top not in chain[-1].renamed:
            chain.append(chain[-1].parent)
        if chain[-1].parent is top:
            branch = chain.pop()
            branch.renamed[top] = (top, branch.key, branch.entity is not None)
            found = branch.renamed[top]
        else:
            found = chain.pop().renamed[top]
        for path in reversed(chain):
            found = path.renamed[top] = (found[0].at(path.key), *found[1:])
        return found


def paths(layout: Layout) -> Path:
    """The root of a family's paths."""
    return Path(None, "", layout)


class _Holder:
    """An object or list that is being read: its path and ordinals, where it begins among the triples, what its elements are."""

    __slots__ = ("path", "places", "begin", "count", "is_list", "repeats", "names", "inner")

    def __init__(self, path: Path, places: tuple[int, ...], begin: int, is_list: bool, repeats: bool = False, names: dict | None = None):
        self.path, self.places, self.begin, self.is_list, self.repeats, self.names = path, places, begin, is_list, repeats, names
        self.count, self.inner = 0, None


def triples(text: str, top: Path) -> Iterator[tuple[Path, tuple[int, ...], object]]:
    """(path, ordinals, value) of the leaves in the document that ``text`` begins with, in order of appearance.

    Ordinals count the repeated steps. An object that is an element opens with a triple of its own. Values are texts as
    they were written; true and false are words, null is None. Leaves outside all repeated members are left out. Of
    members of one name in one object the last counts. Raises ValueError where the text begins no whole object or list.
    """
    out: list = []
    emit, blank, element_at, member_at = out.append, _BLANK.match, _ELEMENT.match, _MEMBER.match
    stack: list[_Holder] = []
    path, places, repeated, at = top, (), False, blank(text).end()  # repeated: a repeated member begins, not one of its elements
    if text[at : at + 1] not in ("{", "["):
        raise ValueError("no document")
    while True:
        sign = text[at : at + 1]
        holder = None
        if sign == "{":
            if path.entity is not None and (repeated or (stack and stack[-1].repeats)):
                inside = (*places, 0) if repeated else places
                by_name = repeated and path.entity in path.layout.keyed
                holder = _Holder(path, inside, len(out), False, names={} if by_name else None)
                emit((path, inside, _OPEN))
            else:
                holder = _Holder(path, places, len(out), False)
        elif sign == "[":
            holder = _Holder(path, places, len(out), True, repeated)
        elif sign == '"':
            value, at = scanstring(text, at + 1, False)
        elif found := _VALUE.match(text, at):
            value, at = found[2] if found[2] is not None else _WORDS[found[3]], found.end()
        else:
            raise ValueError("no value")
        if holder is not None:
            at = blank(text, at + 1).end()
            if text[at : at + 1] == ("]" if holder.is_list else "}"):
                at += 1
                if holder.names is not None:
                    out[holder.begin] = None  # an empty list by name
            else:
                stack.append(holder)
                path = None  # its first element or member comes next
        elif path.entity is None and path.group is not None:
            emit((path, places, value))
        while stack:
            holder = stack[-1]
            over = False
            if path is not None:  # a value ended: it goes on, or the holder ends
                at = blank(text, at).end()
                sign, at = text[at : at + 1], blank(text, at + 1).end()
                if sign != ",":
                    if sign != ("]" if holder.is_list else "}"):
                        raise ValueError("not closed")
                    over = True
            path, places = holder.path, holder.places
            if holder.is_list:
                step = path.at if not holder.repeats else None
                while not over and (found := element_at(text, at)):
                    if step is not None and path.group is not None:
                        emit((step(holder.count), places, found[1] if found[1] is not None else found[2] if found[2] is not None else _WORDS[found[3]]))
                    holder.count += 1
                    over, at = found[4] == "]", found.end()
                    if not over and text[at : at + 1] == "]":
                        raise ValueError("no element")
                if not over:
                    if holder.repeats:
                        places, repeated = (*places, holder.count), False
                    else:
                        path, repeated = path.at(holder.count), False
                    holder.count += 1
                    break
            else:
                while not over and (found := member_at(text, at)):
                    key = found[1]
                    leaf = path.at(key)
                    if holder.inner and key in holder.inner:
                        _forget(out, holder.inner.pop(key))
                    if holder.names is not None:
                        holder.names.setdefault(key, len(holder.names))
                    if leaf.entity is None and leaf.group is not None:
                        emit((leaf, places, found[2] if found[2] is not None else found[3] if found[3] is not None else _WORDS[found[4]]))
                    over, at = found[5] == "}", found.end()
                if not over:
                    if text[at : at + 1] != '"':
                        raise ValueError("no member")
                    key, at = scanstring(text, at + 1, False)
                    found = _COLON.match(text, at)
                    if not found:
                        raise ValueError("no value")
                    at = found.end()
                    if holder.inner is None:
                        holder.inner = {}
                    elif key in holder.inner:
                        _forget(out, holder.inner.pop(key))
                    holder.inner[key] = [len(out), None]
                    if holder.names is not None:
                        holder.names.setdefault(key, len(holder.names))
                        if text[at : at + 1] == "{":
                            emit((path.at(key), places, _PERHAPS))
                    path = path.at(key)
                    repeated = path.entity is not None
                    break
            stack.pop()
            if holder.names is not None and not any(canonical(k) in path.layout.own for k in holder.names):
                _by_name(out, holder)
            if stack and stack[-1].inner:
                next(reversed(stack[-1].inner.values()))[1] = len(out)
        if not stack:
            return (t for t in out if t is not None)


def _forget(out: list, span: list[int]) -> None:
    """Takes back the triples of a member whose name comes again."""
    begin, end = span
    if end is not None:
        out[begin:end] = [None] * (end - begin)


def _by_name(out: list, holder: _Holder) -> None:
    """Rewrites what was read as one element: its members are the elements of a list by name."""
    top, depth = holder.path, len(holder.places) - 1
    label = top.at(top.layout.keyed[top.entity])
    kept = []
    for triple in out[holder.begin + 1 :]:
        if triple is None:
            continue
        path, places, value = triple
        path, name, twice = path.without_name(top)
        places = (*places[:depth], holder.names[name], *places[depth + 1 + (twice and len(places) > depth + 1) :])
        if value is _PERHAPS and path is top:
            kept += [(top, places, _OPEN), (label, places, name)]
        elif path is not top or value is _OPEN:
            kept.append((path, places, value))
    out[holder.begin :] = kept


def document_text(body: str | None) -> str | None:
    """The text that begins with the document of ``body``, or None.

    A document may be preceded by white space or a byte order mark, followed by other text, or wrapped in a JSON
    string, however often. A text that doesn't begin an object or list holds none; whether it is whole, reading tells.
    """
    while body is not None:
        body = body.lstrip("\ufeff \t\r\n")
        if body[:1] in ("{", "["):
            return body
        if body[:1] != '"':
            return None
        try:
            body = scanstring(body, 1, False)[0]
        except ValueError:
            return None
    return None


def instances(body: str | None, top: Path) -> list[tuple[str, int, str | None, int | None, int, dict[str, str | None]]]:
    """(entity, pos, parent, parent_pos, child_pos, members): the triples of a record grouped by their repeated ancestor and pivoted.

    ``pos`` counts an entity's objects over the whole document, ``child_pos`` is the place in the list. A body that
    holds no whole document has none.
    """
    text = document_text(body)
    if text is None:
        return []
    rows: dict[tuple, tuple] = {}
    counts: dict[str, int] = {}
    try:
        read = triples(text, top)
    except ValueError:
        return []
    for path, places, value in read:
        group = path.group
        if value is _OPEN:
            if (group, places) not in rows:
                owner = rows.get((group.owner, places[:-1])) if group.owner is not None else None
                rows[group, places] = (group.entity, counts.get(group.entity, 0), owner and owner[0], owner and owner[1], places[-1], {})
                counts[group.entity] = counts.get(group.entity, 0) + 1
        elif value is not _PERHAPS:
            row = rows.get((group, places))
            if row is not None:
                row[5][path.column] = value
    return list(rows.values())


def json_parts(records: DataFrame, layout: Layout) -> DataFrame:
    """Flat rows of ``records`` (record_id long, body string): one for each object of each repeated member.

    Result: record_id, entity, pos (the object's place among its kind in the whole record), parent and parent_pos
    (the enclosing object), child_pos (place in its list from 0), members (map of the object's own leaves by dotted
    path, as strings). A null element keeps its place without a row; a body that holds no whole document (null,
    empty, damaged) has no rows; a record delivered again gives its rows again; numbers keep their spelling. Other
    columns of ``records`` are ignored; a null record_id is kept. An empty table gives no rows.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["record_id", "entity", "pos", "parent", "parent_pos", "child_pos", "members"]  # as in PARTS
        top, read = paths(layout), 0
        for frame in frames:
            out: list[tuple] = []
            for record, body in zip(frame["record_id"], frame["body"]):
                record = None if record is None or record != record else int(record)
                out.extend((record, *row) for row in instances(body, top))
                read += 1
                if read % 64 == 0 and _many(top, PATHS_HELD):
                    top = paths(layout)
                if len(out) > 20_000:
                    yield _frame(out, names)
                    out = []
            if out:
                yield _frame(out, names)

    def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
        import pandas as pd

        made = pd.DataFrame(rows, columns=names)
        for name in ("record_id", "pos", "parent_pos", "child_pos"):
            made[name] = made[name].astype("Int64")
        return made

    return records.select(F.col("record_id").cast("long").alias("record_id"), F.col("body").cast("string").alias("body")).where("body IS NOT NULL").mapInPandas(parse, PARTS)


def _many(top: Path, limit: int) -> bool:
    """Whether there are more paths than ``limit``."""
    waiting, seen = [top], 0
    while waiting and seen <= limit:
        kids = list(waiting.pop().kids.values())
        seen += len(kids)
        waiting += kids
    return seen > limit


def as_bodies(records: DataFrame, record_id: str, members: list[str], lists: str) -> DataFrame:
    """record_id, body: nested columns as the JSON of a record with one element of the repeated member ``lists``."""
    return records.select(F.col(record_id).cast("long").alias("record_id"), F.to_json(F.struct(F.array(F.struct(*members)).alias(lists)), {"ignoreNullFields": "false"}).alias("body"))


def pivot_part(parts: DataFrame, entity: str, members: list[str]) -> DataFrame:
    """The flat table of one entity: its keys, and a column for each of ``members`` (null where an object lacks it)."""
    return parts.where(F.col("entity") == entity).select("record_id", "pos", "parent", "parent_pos", "child_pos", *[F.col("members")[m].alias(m.replace(".", "_")) for m in members])


def listed(members: Column, name: str) -> Column:
    """The elements of a list member, in order, as array<string>; empty if there are none. A single value is one element."""
    places = F.filter(F.map_keys(members), lambda k: k.rlike(rf"^{re.escape(name)}\.[0-9]+$"))
    ordered = F.array_sort(F.transform(places, lambda k: F.struct(F.substring_index(k, ".", -1).cast("int").alias("at"), k.alias("k"))))
    return F.when(members[name].isNotNull(), F.array(members[name])).otherwise(F.transform(ordered, lambda e: members[e["k"]]))


def position(members: Column, name: str) -> Column:
    """A position as array<double>, written as a list, as an object of x and y, or as a text like "1.0,2.0"; null if there is none."""
    number = lambda c: F.trim(c).try_cast("double")
    text = F.transform(F.split(F.trim(F.regexp_replace(members[name], r"[\[\]()]", "")), r"\s*[,;]\s*|\s+"), number)
    both = F.array(number(members[f"{name}.x"]), number(members[f"{name}.y"]))
    found = F.when(members[name].isNotNull(), text).when(members[f"{name}.x"].isNotNull() | members[f"{name}.y"].isNotNull(), both).otherwise(F.transform(listed(members, name), number))
    return F.when(F.exists(found, lambda v: v.isNotNull()), found)
