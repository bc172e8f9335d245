"""The exact scanner of delimited text with quotes: one pass, four states, and its distributed form.

A block of lines is a function from "inside quotes at its start or not" to the same at its end. A first pass takes both
values of that function for each file block; their composition, in block order, gives every block's true start. The
second pass reads each block from there. Only a record cut by a block's edge comes to the driver, in two pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from ..errors import CsvError


class Scanner:
    """Feed text, get records. `inside` starts within quotes: what comes before the first record's end is then a head."""

    def __init__(self, delimiter: str):
        self.delimiter = delimiter
        self.state, self.field, self.fields, self.any = "start", [], [], False

    def feed(self, text: str) -> Iterator[list[str]]:
        d, state, field, fields = self.delimiter, self.state, self.field, self.fields
        for c in text:
            self.any = True
            if state == "quoted":
                if c == '"':
                    state = "closing"
                else:
                    field.append(c)
            elif c == d:
                fields.append("".join(field))
                field.clear()
                state = "start"
            elif c == "\n":
                fields.append("".join(field))
                field.clear()
                yield fields[:]
                fields.clear()
                state, self.any = "start", False
            elif c == "\r":
                pass
            elif c == '"' and state == "start":
                state = "quoted"
            elif c == '"' and state == "closing":
                field.append('"')
                state = "quoted"
            else:
                field.append(c)
                state = "open"
        self.state = state

    def finish(self) -> Iterator[list[str]]:
        if self.state == "quoted":
            raise CsvError("unterminated quoted field")
        if self.any:
            yield [*self.fields, "".join(self.field)]


def records(text: str, delimiter: str = ",") -> Iterator[list[str]]:
    """All records of a text; an error names the record's number."""
    s, n = Scanner(delimiter), 0
    for r in s.feed(text):
        n += 1
        yield r
    try:
        yield from s.finish()
    except CsvError:
        raise CsvError(f"row {n + 1}: unterminated quoted field") from None


@lru_cache(16)
def _line(delimiter: str) -> tuple[re.Pattern, re.Pattern]:
    """A line of whole fields, and one field with the delimiter before it: a quoted run and what follows it, or plain text."""
    d = re.escape(delimiter)
    quoted, plain = '"(?:[^"]|"")*+"(?!")', f'(?!")[^{d}]*+'
    return re.compile(f"(?:{quoted}[^{d}]*+|{plain})(?:{d}(?:{quoted}[^{d}]*+|{plain}))*+"), re.compile(f'(?:^|{d})(?:"((?:[^"]|"")*+)"([^{d}]*+)|({plain}))')


def whole_line(line: str, delimiter: str) -> list[str] | None:
    """The fields of a line that begins and ends outside of quotes, as the scanner has them; None if it does not, or has a rare form."""
    if line.endswith("\r"):
        line = line[:-1]
    if '"' not in line:
        return line.replace("\r", "").split(delimiter)
    if "\r" in line or delimiter == '"':
        return None
    whole, field = _line(delimiter)
    if not whole.fullmatch(line):
        return None
    return [p if p or not (q or t) else q.replace('""', '"') + t for q, t, p in field.findall(line)]


def ends_inside(lines: list[str], delimiter: str, inside: bool) -> bool:
    """Whether the scanner is within quotes after these lines."""
    for line in lines:
        if '"' not in line:
            continue
        if "\r" not in line and delimiter != '"':
            # within quotes a line reads as if a quote stood before it
            inside = not _line(delimiter)[0].fullmatch(f'"{line}' if inside else line)
            continue
        s = Scanner(delimiter)
        s.state = "quoted" if inside else "start"
        for _ in s.feed(line + "\n"):
            pass
        inside = s.state == "quoted"
    return inside


def ends_both(lines: list[str], delimiter: str) -> tuple[bool, bool]:
    """Whether the scanner is within quotes after these lines, from outside and from within; most often one line makes it the same."""
    a, b = False, True
    for i, line in enumerate(lines):
        if '"' in line:
            a, b = ends_inside([line], delimiter, a), ends_inside([line], delimiter, b)
            if a == b:
                a = ends_inside(lines[i + 1 :], delimiter, a)
                return a, a
    return a, b


def block_records(lines: list[str], delimiter: str, inside: bool) -> tuple[str | None, list[list[str]], str | None]:
    """(text that completes the record begun before, whole records, text of a record left open)."""
    head, start = None, 0
    if inside:
        s = Scanner(delimiter)
        s.state = "quoted"
        for i, line in enumerate(lines):
            if '"' not in line:
                continue  # nothing ends within it
            if any(True for _ in s.feed(line + "\n")):
                head, start = "\n".join(lines[: i + 1]) + "\n", i + 1
                break
        else:
            return "\n".join(lines) + "\n", [], None
    out, i = [], start
    while i < len(lines):
        fields = whole_line(lines[i], delimiter)
        if fields is not None:
            out.append(fields)
            i += 1
            continue
        s, since = Scanner(delimiter), i  # a record with line breaks in it, or a rare form
        found = None
        while i < len(lines) and found is None:
            line = lines[i]
            if s.state == "quoted" and '"' not in line:
                s.field.append(line + "\n")
            else:
                found = next(iter(list(s.feed(line + "\n"))), None)
            i += 1
        if found is None:
            return head, out, "\n".join(lines[since:]) + "\n"
        out.append(found)
    return head, out, None
