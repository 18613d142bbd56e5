"""What a stateful operator keeps of a key, and trailing windows whose cost doesn't depend on how many rows they hold.

Rows of the longest window lie in a map by their number. A window has running sums and a
cursor at its first row: when a later row reads it, the cursor moves past the rows that
have left and takes them out of the sums. A row so enters and leaves each window once,
however busy its key is. Distinct counts keep how often each value is inside. Rows that
every cursor has passed are removed; for a key that is silent a timer does it.

In the state store the entries of a key lie in pages (:class:`Paged`), as an access costs far more than what it reads.

Sums are exact: numbers are added as whole multiples of 2 to the -128, so taking them out
again leaves nothing behind, and deviations don't suffer from cancellation.
"""

from __future__ import annotations

import base64
import itertools
import json
import math
import zlib
from array import array
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

BITS = 128


def whole(x: float | None) -> int:
    return 0 if x is None else int(math.ldexp(x, BITS))


def mean_of(total: int, n: int) -> float:
    return total / (n << BITS)


def deviation(n: int, total: int, squares: int) -> float:
    """Of the population; ``squares`` is a sum of squares of whole numbers."""
    return math.sqrt((n * squares - total * total) / (n * n << 2 * BITS))


@dataclass(frozen=True)
class Trailing:
    """Rows of the last ``width`` microseconds; ``kind``: the partner whose values, and first sights, are counted; ``sums``: whether amounts are added up."""

    width: int
    open_left: bool = False
    kind: str | None = None
    sums: bool = False

    @cached_property
    def name(self) -> str:
        return f"{self.width}{'(' if self.open_left else '['}{self.kind or ''}{'+' if self.sums else ''}"


MAPS = ("partners", "kinds", "log", "windows", "inside", "waiting", "leaving")
HEAD = "n long, first long, last long, x string, y string, yy string, mode_n long, mode_day long, next long, oldest long, purge long"
START = (0, None, None, "0", "0", "0", 0, 0, 0, 0, 0)
# name -> key and value of the maps in the state store. Sums are decimal texts, as they have more than 64 bits.
STORED = {
    "head": ("of string", f"{HEAD}, entries long, pages long, page string"),
    "page": ("of string, page long", "entries string"),
    "waiting": ("at long", "rows string"),
    "leaving": ("at long", "keys string"),
}
PAGE = 256  # entries of a page of the state


class Held:
    """The state in plain dictionaries; ``touched`` counts reads and writes."""

    def __init__(self) -> None:
        self.head, self.maps, self.touched, self.others = None, {n: {} for n in MAPS}, 0, {}

    def of(self, key: str | None) -> Held:
        """What is held of one key of a group; without a key the group is one."""
        return self if key is None else self.others.setdefault(key, Held())

    def flush(self) -> None:
        """Writes what has changed."""

    def get_head(self) -> tuple:
        return self.head or START

    def set_head(self, value: tuple) -> None:
        self.head = value

    def get(self, name: str, *key):
        self.touched += 1
        return self.maps[name].get(key)

    def keys(self, name: str) -> list[tuple]:
        self.touched += 1
        return list(self.maps[name])

    def put(self, name: str, key: tuple, value: tuple | None) -> None:
        self.touched += 1
        if value is None:
            self.maps[name].pop(key, None)
        else:
            self.maps[name][key] = value


class Stored(Held):
    """The state of a group of keys in the state store of an operator."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.maps = {n: handle.getMapState(n, key, value) for n, (key, value) in STORED.items()}

    def of(self, key: str | None) -> Held:
        return Paged(self, key or "")

    def get(self, name: str, *key):
        found = self.maps[name].getValue(key)
        return None if found is None else tuple(found)

    def keys(self, name: str) -> list[tuple]:
        return [tuple(k) for k in self.maps[name].keys()]

    def put(self, name: str, key: tuple, value: tuple | None) -> None:
        if value is None:
            self.maps[name].removeKey(key)
        else:
            self.maps[name].updateValue(key, value)


class Paged(Held):
    """The entries of a key, dealt by a hash into pages of about ``PAGE`` that are read and written whole.

    Most keys have one page; it lies beside the head, so that reading or writing all of their state is one access of the state
    store. Rows of the log lie together by their numbers. A key that outgrows its pages gets four times as many, or more.
    """

    def __init__(self, group: Held, key: str) -> None:
        self.group, self.key = group, key
        found = group.get("head", key)
        self.head, (self.entries, self.pages, page) = (None, (0, 1, None)) if found is None else (found[:-3], found[-3:])
        self.read: dict[int, dict[tuple, tuple]] = {0: _entries(page)} if self.pages == 1 else {}
        self.changed: set[int] = set()

    def _at(self, name: str, key: tuple, pages: int) -> int:
        if pages == 1:
            return 0
        part = str(key[0] // PAGE) if name == "log" else "\0".join(key)
        return zlib.crc32(f"{name}\0{part}".encode()) % pages

    def _page(self, at: int) -> dict[tuple, tuple]:
        if at not in self.read:
            found = self.group.get("page", self.key, at)
            self.read[at] = _entries(found[0] if found else None)
        return self.read[at]

    def get(self, name: str, *key):
        return self._page(self._at(name, key, self.pages)).get((name, *key))

    def put(self, name: str, key: tuple, value: tuple | None) -> None:
        at = self._at(name, key, self.pages)
        page, entry = self._page(at), (name, *key)
        if value is not None:
            self.entries += entry not in page
            page[entry] = value
        elif page.pop(entry, None) is not None:
            self.entries -= 1
        else:
            return
        self.changed.add(at)

    def _write(self, at: int, page: dict[tuple, tuple]) -> None:
        self.group.put("page", (self.key, at), (_text(page),) if page else None)

    def flush(self) -> None:
        pages = self.pages
        while self.entries > PAGE * pages:
            pages *= 4
        if pages > self.pages:  # page by page: the entries of a page go to pages of the same remainder
            for at in range(self.pages):
                page = self._page(at)
                parts: dict[int, dict] = {k: {} for k in range(at, pages, self.pages)}
                for entry, value in page.items():
                    parts[self._at(entry[0], entry[1:], pages)][entry] = value
                for k, part in parts.items():
                    if part or k == at and self.pages > 1:
                        self._write(k, part)
                del self.read[at]
            self.pages, self.read = pages, {}
        elif pages > 1:
            for at in self.changed:
                self._write(at, self.read[at])
        self.changed = set()
        self.group.put("head", (self.key,), (*self.get_head(), self.entries, self.pages, _text(self.read[0]) if self.pages == 1 else None))


def _text(page: dict[tuple, tuple]) -> str:
    return json.dumps(list(page.items()), separators=(",", ":"))


def _entries(text: str | None) -> dict[tuple, tuple]:
    return {tuple(k): tuple(v) for k, v in json.loads(text)} if text else {}


class Log:
    """Recent rows of a key and the windows over them."""

    def __init__(self, held: Held, windows: Sequence[Trailing], following: int, oldest: int):
        self.held, self.windows, self.next, self.oldest = held, list(windows), following, oldest
        self.written = following  # rows from this number on aren't in the state yet
        self.records: dict[str, list] = {}
        self.counts: dict[tuple[str, str], int] = {}
        self.rows: dict[int, tuple] = {}
        self.changed: set[str] = set()
        self.counted: set[tuple[str, str]] = set()

    def _record(self, w: Trailing) -> list:
        if w.name not in self.records:
            tail, n, x, y, fresh, kinds = self.held.get("windows", w.name) or (self.oldest, 0, "0", "0", 0, 0)
            self.records[w.name] = [tail, n, int(x), int(y), fresh, kinds]
        return self.records[w.name]

    def _row(self, number: int) -> tuple:
        if number not in self.rows:
            self.rows[number] = self.held.get("log", number)
        return self.rows[number]

    def _inside(self, w: Trailing, value: str) -> int:
        key = (w.name, value)
        if key not in self.counts:
            found = self.held.get("inside", *key)
            self.counts[key] = found[0] if found else 0
        return self.counts[key]

    def _shift(self, w: Trailing, row: tuple, by: int) -> None:
        r = self._record(w)
        self.changed.add(w.name)
        r[1] += by
        if w.sums:
            r[2] += by * whole(row[1])
            r[3] += by * whole(row[2])
        if w.kind:
            value = row[3] if w.kind == "_c" else row[4]
            if row[5]:
                r[4] += by * (w.kind in row[5].split(","))
            before = self._inside(w, value)
            r[5] += (before + by > 0) - (before > 0)
            self.counts[w.name, value] = before + by
            self.counted.add((w.name, value))

    def until(self, w: Trailing, t: int) -> list:
        """Sums of the window's rows before time ``t``: first row, rows, x, y, first sights, distinct partners."""
        r, low = self.records.get(w.name) or self._record(w), t - w.width + w.open_left
        while r[0] < self.next:
            row = self.rows.get(r[0]) or self._row(r[0])
            if row[0] >= low:
                break
            self._shift(w, row, -1)
            r[0] += 1
        return r

    def holds(self, w: Trailing, t: int, value: str) -> bool:
        self.until(w, t)
        return self._inside(w, value) > 0

    def append(self, us: int, x: float | None, y: float | None, c: str, m: str, fresh: Sequence[str]) -> None:
        row = (us, x, y, c, m, ",".join(fresh))
        for w in self.windows:
            self.until(w, us)
        self.rows[self.next] = row
        for w in self.windows:
            self._shift(w, row, 1)
        self.next += 1

    def passed(self, t: int) -> None:
        """All later rows are at ``t`` or after: what no window reaches any more is forgotten."""
        for w in self.windows:
            self.until(w, t)

    def save(self) -> None:
        first = min([self._record(w)[0] for w in self.windows], default=self.next)
        while self.oldest < first:
            if self.oldest < self.written:
                self.held.put("log", (self.oldest,), None)
            self.rows.pop(self.oldest, None)
            self.oldest += 1
        for number in range(max(self.written, self.oldest), self.next):
            self.held.put("log", (number,), self.rows[number])
        self.written = self.next
        for name in self.changed:
            tail, n, x, y, fresh, kinds = self.records[name]
            self.held.put("windows", (name,), (tail, n, str(x), str(y), fresh, kinds))
        for key in self.counted:
            self.held.put("inside", key, (self.counts[key],) if self.counts[key] else None)
        self.changed, self.counted = set(), set()


def packed(rows: Sequence[dict]) -> str:
    """Rows as text, column by column: numbers with fractions as their bytes, the rest compressed. What a row doesn't have is None when it comes back; no number is NaN."""
    real: dict[str, str] = {}
    rest: dict[str, list] = {}
    for name in dict.fromkeys(itertools.chain.from_iterable(rows)):
        values = [r.get(name) for r in rows]
        if float in (kinds := set(map(type, values))) and kinds <= {float, type(None)}:
            real[name] = _ascii(array("d", [math.nan if v is None else v for v in values]).tobytes())
        else:
            rest[name] = values
    return json.dumps([_ascii(zlib.compress(json.dumps(rest, separators=(",", ":")).encode(), 1)), real])


def unpacked(text: str) -> list[dict]:
    rest, real = json.loads(text)
    columns = json.loads(zlib.decompress(base64.b64decode(rest)))
    for name, values in real.items():
        columns[name] = [None if v != v else v for v in array("d", base64.b64decode(values))]
    return [dict(zip(columns, row, strict=True)) for row in zip(*columns.values(), strict=True)]


def _ascii(content: bytes) -> str:
    return base64.b64encode(content).decode()


def loaded(held: Held, rows) -> list[int]:
    """Entries of a snapshot put back; the times at which something is to be done."""
    due = []
    for name, key, value in rows:
        key, value = tuple(json.loads(key)), tuple(json.loads(value))
        held.put(name, key, value)
        if name in ("waiting", "leaving"):
            due.append(key[0])
    return due
