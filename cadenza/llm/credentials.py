"""Secret scans with multipart linking.

Three kinds are found by themselves, leftmost and without overlap within a kind: ``assign`` (a
credential's name, an assignment sign and a value of six characters or more), ``access`` (access
identifiers of twenty characters or more) and ``hex`` (runs of 24 hexadecimal digits or more).

Weak candidates say nothing alone: a token of mixed letters and digits, a URL or host with a port, an
access identifier of another form (a known prefix, or a value with a digit that is named as an id).
They are reported only where the parts complement each other. Each access identifier, weak ones too,
opens a scope, its span widened by ``SCOPE`` code points to either side; candidates are interval-joined
to the scopes they overlap, however far they reach out of them. A weak token in the scope of an access
identifier is reported as ``part_secret``; an endpoint in the scope of an access identifier that
also has a secret part (an assignment, a long hex run or a weak token) is reported as
``part_endpoint``, a weak identifier with a secret part in its own scope as ``part_access``.
Weak candidates that overlap what the first three kinds found are left to those.

Only rows with an access identifier, weak ones too, are searched for weak candidates, as no other row can link.
Null and empty texts have no spans. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrow

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "part_secret", "part_endpoint", "part_access")
SCOPE = 300
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_NAMES = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_OTHER = re.compile(
    rb"""(?<![A-Za-z0-9])(?:(?:ASIA|AIDA|AROA|AGPA)[A-Z0-9]{12,}|LTAI[A-Za-z0-9]{12,}|AIza[A-Za-z0-9_-]{30,}|GOOG1?[A-Z0-9]{16,})"""
    rb"""|(?:access[_-]?key(?:[_-]?id)?|access[_-]?id|key[_-]?id|client[_-]?id|account[_-]?(?:id|key)|app[_-]?id)["']?\x20*[:=]\x20*["']?(?=[A-Za-z_.-]*[0-9])[A-Za-z0-9_.-]{6,}""",
    re.IGNORECASE,
)
_HINTS = (b"asia", b"aida", b"aroa", b"agpa", b"ltai", b"aiza", b"goog", b"access", b"client", b"account", b"key", b"app")
_WEAK = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
_ENDPOINT = re.compile(rb"""https?://[^\s"'<>]+|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+:[0-9]{2,5}""")
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def hex_runs(data: np.ndarray, at: np.ndarray, least: int = 24) -> dict[int, list[tuple[int, int]]]:
    """For each row with any: the maximal runs of lower-case hexadecimal digits, as byte offsets in the row."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _HEX[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    found: dict[int, list[tuple[int, int]]] = {}
    for k in np.flatnonzero(ends - starts >= least):
        row = int(np.searchsorted(at, starts[k], side="right")) - 1
        s = int(starts[k])
        while s < ends[k]:  # a run ends where its row ends
            stop = min(int(at[row + 1]), int(ends[k]))
            if stop - s >= least:
                found.setdefault(row, []).append((s - int(at[row]), stop - int(at[row])))
            s, row = stop, row + 1
    return found


def overlaps(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether any of the sorted disjoint spans meets [start, end)."""
    i = bisect_left(spans, (end, -1))
    return i > 0 and spans[i - 1][1] > start


def within(scopes: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Interval join: (scope, span) for each scope and span that overlap. Scopes are sorted and disjoint, spans sorted by start; they may nest."""
    out, first = [], 0
    for span in spans:
        while first < len(scopes) and scopes[first][1] <= span[0]:  # ends before this span's and all later starts
            first += 1
        i = first
        while i < len(scopes) and scopes[i][0] < span[1]:
            out.append((scopes[i], span))
            i += 1
    return out


def widened(raw: bytes, spans: list[tuple[int, int]], scope: int) -> list[tuple[int, int]]:
    """The spans with ``scope`` code points more at either side, within the text."""
    begins = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    out = []
    for s, e in spans:
        low, high = max(int(np.searchsorted(begins, s)) - scope, 0), int(np.searchsorted(begins, e)) + scope
        out.append((int(begins[low]), int(begins[high]) if high < len(begins) else len(raw)))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def scan(raw: bytes, hexes: list[tuple[int, int]], scope: int = SCOPE) -> list[tuple[str, int, int]]:
    """All spans of one text, as bytes, sorted by start and then by kind."""
    low = raw.lower()
    assigns = [m.span() for m in _ASSIGN.finditer(raw) if len(m[2]) >= 6] if any(n in low for n in _NAMES) else []
    access = [m.span() for m in _ACCESS.finditer(raw) if len(m[0]) >= 20] if b"AKIA" in raw else []
    found = [("assign", *x) for x in assigns] + [("access", *x) for x in access] + [("hex", *x) for x in hexes]
    base = merged([*assigns, *access, *hexes]) if access or any(h in low for h in _HINTS) else []
    others = [m.span() for m in _OTHER.finditer(raw) if not overlaps(base, *m.span())] if access or any(h in low for h in _HINTS) else []
    if access or others:
        scopes = merged(widened(raw, [*access, *others], scope))
        endpoints = [m.span() for m in _ENDPOINT.finditer(raw)]
        taken = merged(endpoints)
        weak = [
            m.span()
            for m in _WEAK.finditer(raw)
            if re.search(rb"[0-9]", m[0]) and re.search(rb"[A-Za-z]", m[0]) and not overlaps(base, *m.span()) and not overlaps(taken, *m.span()) and not overlaps(others, *m.span())
        ]
        linked = sorted({span for _, span in within(scopes, weak)})
        found += [("part_secret", *x) for x in linked]
        armed = {where for where, _ in within(scopes, sorted([*assigns, *hexes, *linked]))}
        found += [("part_endpoint", *x) for x in sorted({x for where, x in within(scopes, endpoints) if where in armed}) if not overlaps(base, *x)]
        secrets = merged([*assigns, *hexes, *linked])
        found += [("part_access", *x) for x, around in zip(others, widened(raw, others, scope), strict=True) if overlaps(secrets, *around)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(df: DataFrame, text: str = "text", spans: str = "spans", scope: int = SCOPE) -> DataFrame:
    """``df`` with the array of (kind, start, end) of each whole text, by start and then as ``KINDS`` lists them."""

    def make():
        def work(part: pa.RecordBatch) -> list:
            data, at = arrow.text_bytes(part.column(part.schema.get_field_index(text)))
            hexes = hex_runs(data, at)
            rows: list[list[dict]] = []
            for i in range(part.num_rows):
                row = data[at[i] : at[i + 1]]
                found = scan(row.tobytes(), hexes.get(i, []), scope)
                if found:
                    points = np.concatenate([[0], np.cumsum((row & 0xC0) != 0x80)])
                    rows.append([{"kind": k, "start": int(points[s]), "end": int(points[e])} for k, s, e in found])
                else:
                    rows.append([])
            return [pa.array(rows, kind)]

        return work

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    struct = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    return arrow.with_columns(df, text, [T.StructField(spans, T.ArrayType(struct))], make)


def redact(df: DataFrame, text: str = "text", length: str | None = None, scope: int = SCOPE) -> DataFrame:
    """``df`` with each span of a secret replaced by ``[KIND]``; overlapping spans are one, of the first kind.

    A column named ``length`` gets the new texts' code points; null texts stay null, and texts without a
    secret stay as they are.
    """

    def make():
        def work(part: pa.RecordBatch) -> list:
            column = part.column(part.schema.get_field_index(text))
            data, at = arrow.text_bytes(column)
            hexes = hex_runs(data, at)
            out, sizes = [], []
            for i in range(part.num_rows):
                raw = data[at[i] : at[i + 1]].tobytes()
                end, pieces = 0, []
                for kind, s, e in scan(raw, hexes.get(i, []), scope):
                    if s >= end:
                        pieces += [raw[end:s], b"[" + kind.upper().encode() + b"]"]
                    end = max(end, e)
                whole = (b"".join([*pieces, raw[end:]]) if pieces else raw).decode("utf-8", "replace")
                missing = not column[i].is_valid
                out.append(None if missing else whole)
                sizes.append(None if missing else len(whole))
            return [pa.array(out, pa.string()), *([pa.array(sizes, pa.int64())] if length else [])]

        return work

    whole = [f.name for f in df.schema.fields]
    fields = [T.StructField(text, T.StringType()), *([T.StructField(length, T.LongType())] if length else [])]
    return arrow.with_columns(df, text, fields, make).select(*[F.col(f"`{c}`") for c in whole])
