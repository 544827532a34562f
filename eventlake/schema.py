"""Schemas of the engine's tables."""

from __future__ import annotations

EVENT = "position long, identifier string, name string, version string, timestamp long, payload binary, metadata map<string,string>, tags array<struct<key:binary,value:binary>>, context string"
INPUT = EVENT.replace("position long, ", "").replace(", context string", "")
SNAPSHOT = "context string, key binary, sequence long, name string, version string, payload binary, timestamp long, metadata map<string,string>"
#: Positions of a segment, the unit of pruning and of the postings.
SEGMENT = 1 << 20
