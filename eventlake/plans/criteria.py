"""Criteria as Catalyst predicates.

A criterion matches an event that has all its tags and, if it lists names, one of them; a condition matches where any of
its criteria does. A criterion without tags and names matches everything, a condition without criteria nothing, unless
empty_means_all is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bytes(x: str | bytes) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


@dataclass(frozen=True)
class Tag:
    key: bytes
    value: bytes

    @classmethod
    def of(cls, key: str | bytes, value: str | bytes) -> Tag:
        return cls(_bytes(key), _bytes(value))

    @property
    def fkey(self) -> str:
        return f"{self.key.hex().upper()}={self.value.hex().upper()}"


def name_key(name: str) -> str:
    """A name's key in the postings; no tag's key begins with a letter after F."""
    return f"name:{name}"


@dataclass(frozen=True)
class Criterion:
    names: tuple[str, ...] = ()
    tags: tuple[Tag, ...] = ()

    @classmethod
    def of(cls, names=(), **tags: str) -> Criterion:
        return cls(tuple(names), tuple(Tag.of(k, v) for k, v in tags.items()))

    def column(self) -> Column:
        terms = [has_tag(t) for t in dict.fromkeys(self.tags)]
        if self.names:
            terms.append(F.col("name").isin(list(self.names)))
        return reduce(and_, terms) if terms else F.lit(True)


@dataclass(frozen=True)
class Condition:
    criteria: tuple[Criterion, ...] = field(default=())
    empty_means_all: bool = False

    @classmethod
    def of(cls, *criteria: Criterion) -> Condition:
        return cls(tuple(criteria))

    def column(self) -> Column:
        if not self.criteria:
            return F.lit(self.empty_means_all)
        return reduce(or_, (c.column() for c in self.criteria))


def has_tag(tag: Tag) -> Column:
    key, value = F.lit(bytearray(tag.key)), F.lit(bytearray(tag.value))
    return F.exists("tags", lambda t: (t["key"] == key) & (t["value"] == value))


def parse_filter(name: str = "", tags: str = "") -> Condition:
    """The console's filter: an exact name and comma-separated key=value pairs; what isn't a pair is dropped, and with
    nothing left everything matches."""
    found = []
    for pair in tags.split(","):
        key, eq, value = pair.partition("=")
        if eq and key.strip():
            found.append(Tag.of(key.strip(), value.strip()))
    return Condition.of(Criterion((name.strip(),) if name.strip() else (), tuple(found)))


def tag_column(**tags: Column) -> Column:
    """An array of tags from columns; the key is bytes of the name."""
    return F.array(*[F.struct(F.lit(bytearray(k.encode())).alias("key"), F.encode(v.cast("string"), "UTF-8").alias("value")) for k, v in tags.items()])
