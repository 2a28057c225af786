"""Loading delimited lines: valid rows on one side, rejected lines with a reason on the other."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klangsieb.operators.ordered import only
from klangsieb.session import bound_batches

# The layouts of the three kinds of lines.
LISTING_FIELDS = ("wav_filename", "transcript")
PIPE_FIELDS = ("wav_filename", "duration", "transcript", "client_id", "levenshtein")
TSV_FIELDS = ("client_id", "path", "sentence", "up_votes", "down_votes")

_WAV = re.compile(r"wavs/\S+\.wav")
_NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+)?")
_DIGITS = re.compile(r"[0-9]+")
_BAD = re.compile("[\x00-\x08\x0a-\x1f\ufffd]")

SCHEMA = (
    "line_id bigint, file_kind string, reason string, wav_rel string, text string, duration double, "
    "client_id string, levenshtein double, up_votes bigint, down_votes bigint, line string"
)
_ARROW = pa.schema(
    [
        ("line_id", pa.int64()), ("file_kind", pa.string()), ("reason", pa.string()), ("wav_rel", pa.string()), ("text", pa.string()),
        ("duration", pa.float64()), ("client_id", pa.string()), ("levenshtein", pa.float64()), ("up_votes", pa.int64()), ("down_votes", pa.int64()), ("line", pa.string()),
    ]
)


def blank(text: str) -> bool:
    """Nothing but white space, once entities are resolved."""
    return not (html.unescape(text) if "&" in text else text).strip()


class Structure:
    """Where the fields of many lines begin and end, found over all lines at once.

    The lines lie in one byte buffer. A quote opens a field only where the
    field begins; each line hops from one such quote to the next (all lines
    together), the closing quote being the end of the first odd run of quotes.
    Opening and closing quotes set marks, the parity of the marks' prefix sum
    tells inside from outside, and delimiters outside are structural.
    """

    def __init__(self, lines: list[bytes], delimiter: int, quoting: bool) -> None:
        self.lines = lines
        size = np.fromiter(map(len, lines), np.int64, len(lines))
        self.end = np.cumsum(size + 1) - 1  # one byte after each line
        self.start = self.end - size
        self.buf = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
        self.unclosed = np.zeros(len(lines), bool)
        marks = np.zeros(len(self.buf) + 1, np.int8)
        if quoting and len(lines):
            self._quotes(delimiter, marks)
        inside = np.cumsum(marks[:-1]) & 1
        is_cut = (self.buf == delimiter) & (inside == 0)
        self.cuts = np.flatnonzero(is_cut)
        self.first = np.searchsorted(self.cuts, self.start)
        self.fields = np.searchsorted(self.cuts, self.end) - self.first + 1

    def _quotes(self, delimiter: int, marks: np.ndarray) -> None:
        buf = self.buf
        quote = np.flatnonzero(buf == 34)
        if not len(quote):
            return
        at_start = np.zeros(len(buf), bool)
        at_start[self.start[self.start < self.end]] = True
        opens = quote[at_start[quote] | (buf[quote - 1] == delimiter)]
        new_run = np.r_[True, np.diff(quote) > 1]
        run_start = quote[new_run]
        run_end = np.r_[quote[:-1][new_run[1:]], quote[-1]]
        odd_end = run_end[(run_end - run_start) % 2 == 0]
        row = np.flatnonzero(self.start < self.end)
        here = self.start[row]
        while len(row):
            k = np.searchsorted(opens, here)
            ok = k < len(opens)
            row, here, k = row[ok], here[ok], k[ok]
            p = opens[k]
            ok = p < self.end[row]
            row, p = row[ok], p[ok]
            if not len(row):
                return
            own = run_end[np.searchsorted(run_end, p)]  # the end of the run that p lies in
            later = np.searchsorted(odd_end, own, side="right")
            after = np.where(later < len(odd_end), odd_end[np.minimum(later, len(odd_end) - 1)], len(buf)) if len(odd_end) else np.full(len(p), len(buf))
            close = np.where((own - p) % 2 == 1, own, after)
            fails = close >= self.end[row]
            nxt = np.minimum(close + 1, len(buf) - 1)
            fails |= ~fails & (nxt < self.end[row]) & (buf[nxt] != delimiter)
            self.unclosed[row[fails]] = True
            good = ~fails
            marks[p[good]] += 1
            marks[close[good] + 1] += 1
            row, here = row[good], close[good] + 1

    def row(self, i: int) -> list[bytes]:
        base, line = int(self.start[i]), self.lines[i]
        cuts = self.cuts[self.first[i] : self.first[i] + self.fields[i] - 1] - base
        out, a = [], 0
        for c in cuts.tolist():
            out.append(line[a:c])
            a = c + 1
        out.append(line[a:])
        return out


def _unquote(field: bytes) -> str:
    if field[:1] == b'"':
        field = field[1:-1].replace(b'""', b'"')
    return field.decode("utf-8")


def _listing(line: str) -> tuple[str | None, dict]:
    path, cut, text = line.partition("==")
    if not cut:
        return "columns", {}
    if not _WAV.fullmatch(path) or blank(text) or _BAD.search(line):
        return "value", {}
    return None, {"wav_rel": path, "text": text}


def _pipe(fields: list[str], line: str) -> tuple[str | None, dict]:
    path, duration, text, client, agree = fields
    good = not (blank(path) or blank(text) or blank(client)) and _NUMBER.fullmatch(duration) and float(duration) > 0
    good = good and (not agree or (_NUMBER.fullmatch(agree) and float(agree) <= 1)) and not _BAD.search(line)
    if not good:
        return "value", {}
    return None, {"wav_rel": path, "text": text, "duration": float(duration), "client_id": client, "levenshtein": float(agree) if agree else None}


def _tsv(fields: list[str], line: str) -> tuple[str | None, dict]:
    client, path, text, plus, minus = fields
    good = not (blank(client) or blank(path) or blank(text)) and _DIGITS.fullmatch(plus) and _DIGITS.fullmatch(minus) and not _BAD.search(line)
    if not good:
        return "value", {}
    votes = [int(v) if len(v.lstrip("0")) < 19 else 2**63 - 1 for v in (plus.lstrip("0") or "0", minus.lstrip("0") or "0")]
    return None, {"wav_rel": path, "text": text, "client_id": client, "up_votes": votes[0], "down_votes": votes[1]}


def parse_lines(ids: list, kinds: list, lines: list) -> pa.RecordBatch:
    """Every line that isn't blank, as a valid row (reason null) or a reject (reason set, no values)."""
    put: list[tuple[int, str | None, dict]] = []
    clean: list[str] = []
    groups: dict[str | None, list[int]] = {}
    for i, line in enumerate(lines):
        line = "" if line is None else line.removeprefix("\ufeff").strip(" \r")
        clean.append(line)
        if line.strip():
            groups.setdefault(kinds[i] if kinds[i] in ("listing", "pipe", "tsv") else None, []).append(i)
    for i in groups.get(None, []):
        put.append((i, "columns", {}))
    for i in groups.get("listing", []):
        put.append((i, *_listing(clean[i])))
    for kind, delimiter, width, check in (("pipe", 124, len(PIPE_FIELDS), _pipe), ("tsv", 9, len(TSV_FIELDS), _tsv)):
        rows = groups.get(kind, [])
        s = Structure([clean[i].encode("utf-8", "surrogatepass") for i in rows], delimiter, kind == "pipe")
        for k, i in enumerate(rows):
            if s.unclosed[k]:
                put.append((i, "quoting", {}))
            elif s.fields[k] != width:
                put.append((i, "columns", {}))
            else:
                fields = [_unquote(f) if kind == "pipe" else f.decode("utf-8") for f in s.row(k)]
                put.append((i, *check(fields, clean[i])))
    put.sort(key=lambda x: x[0])
    columns = {"line_id": [ids[i] for i, _, _ in put], "file_kind": [kinds[i] for i, _, _ in put], "reason": [r for _, r, _ in put], "line": [lines[i] for i, _, _ in put]}
    for name in _ARROW.names:
        if name not in columns:
            columns[name] = [v.get(name) for _, _, v in put]
    return pa.RecordBatch.from_pydict({n: columns[n] for n in _ARROW.names}, schema=_ARROW)


def load_lines(df: DataFrame, line_id: str = "line_id", kind: str = "file_kind", line: str = "line") -> DataFrame:
    """Turn raw lines into typed rows; lines that can't be loaded come out with a ``reason``.

    Reasons, the first that applies: ``quoting`` (pipe only: a quoted field
    isn't closed, or is followed by something else than a delimiter),
    ``columns`` (wrong count of fields; also a kind of file that is null or
    unknown), ``value`` (a field of the wrong type, a control character or
    U+FFFD). Accepted rows have a null reason.

    A leading byte-order mark, then blanks and carriage returns at both ends
    are dropped. Null, empty and white-space lines give no row at all. Repeated
    lines each give their row; a null id stays null; other columns are
    ignored. Lines are independent, so there is no shuffle, and the cost of a
    line grows with its length only (hops from quoted field to quoted field,
    all lines of a batch together).
    """
    src = only(bound_batches(df), line_id, kind, line).select(F.col(line_id).cast("bigint").alias("line_id"), F.col(kind).cast("string").alias("file_kind"), F.col(line).cast("string").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kinds, lines = (b.column(i).to_pylist() for i in range(3))
            for part in _parts(lines):
                yield parse_lines(ids[part], kinds[part], lines[part])

    return src.mapInArrow(run, SCHEMA)


def _parts(lines: list, most: int = 16 << 20) -> Iterator[slice]:
    """Slices of at most about ``most`` characters, so that long lines don't pile up in one buffer."""
    a = held = 0
    for i, x in enumerate(lines):
        held += len(x or "")
        if held > most:
            yield slice(a, i + 1)
            a, held = i + 1, 0
    if a < len(lines):
        yield slice(a, len(lines))


def rejects(loaded: DataFrame) -> DataFrame:
    """The rejected lines of ``load_lines`` with their reason and the line as it came."""
    return loaded.where(F.col("reason").isNotNull()).select("line_id", "file_kind", "reason", "line")


def accepted(loaded: DataFrame) -> DataFrame:
    """The valid rows of ``load_lines``."""
    return loaded.where(F.col("reason").isNull()).drop("reason", "line")
