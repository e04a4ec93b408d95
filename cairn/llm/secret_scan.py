"""Secrets in text: fixed token shapes, and credential values that are hard to guess.

The base kinds are matched by pattern, leftmost and non-overlapping within a kind. Beyond them, any
value in a credential context (``passphrase: ...``, ``client_secret => ...``) is priced by the
cheapest way to guess it: a dynamic programme over all segmentations into dictionary words, dates,
repeats of up to 8 characters, keyboard or alphabet runs (both of any length) and brute force. Values that cost at least ``10**MIN_COST`` guesses
become ``cred`` spans unless a base ``assign`` span holds them; cheap ones (placeholders, ordinary words) do not. Base
spans always stay; how many of them hold a cheap value is reported beside them.

The dictionary is ``WORDS``, and after them the words of the table itself: those in at least ``MIN_DOCS`` texts,
commonest first (ties in code point order), counted over all rows and whole texts. The ``VOCABULARY`` commonest are
kept, which bounds what the driver and the tasks hold; a rarer word is priced by its parts, never dropped from the scan.

Whole texts are read, in time that grows with their length; positions are code points, ends exclusive. Null texts
count as empty and have no spans. Repeated rows give repeated results and count as so many texts of the
vocabulary; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import freeze

# The base patterns and the shortest match of each.
BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
KINDS = ("assign", "access", "hex", "cred")
CONTEXT = (
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|(?:access|private|secret|auth)[_-]key|client[_-]?secret|credentials?|bearer)"""
    r"""["']?[\x20\t]{0,8}(?::=|=>|[:=])[\x20\t]{0,8}(?:"([^"\r\n]{6,})"|'([^'\r\n]{6,})'|([^\s"'<>,;(){}\[\]]{6,}))"""
)
MIN_COST = 8.0
VOCABULARY = 20_000
MIN_DOCS = 5
# A word of the table: 3 to 16 letters with neither letter nor digit beside them.
TABLE_WORD = r"(?<![\p{L}\p{N}_])\p{L}{3,16}(?![\p{L}\p{N}_])"

# Common passwords and words, commonest first.
WORDS = """password 123456 qwerty letmein admin welcome monkey dragon master login abc iloveyou football baseball sunshine princess
shadow superman batman trustno secret changeme default guest root test user pass token key example sample dummy placeholder your
my the here insert todo none null true false redacted hidden value string secure private public access api server database data
service client account email name home work office company love money summer winter spring autumn january february march april
may june july august september october november december monday tuesday friday sunday hello world computer internet flower
mustang ginger pepper cookie cheese orange apple banana purple silver golden diamond tiger eagle falcon lucky star power magic
freedom whatever matrix hunter ranger soccer hockey jordan michael jennifer thomas daniel andrew joshua charlie george robert
passw pass word dev prod stage demo temp new old""".split()
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz")
SWAPS = str.maketrans("@4831!05$7", "aabeiiosst")



class Dictionary:
    """Words by rank, commonest first; a word stands where it comes first."""

    def __init__(self, words: Sequence[str]):
        self.rank = {w: i + 1 for i, w in reversed(list(enumerate(words)))}
        self.longest = max(map(len, words))


COMMON = Dictionary(WORDS)
_NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:])}
_NEXT |= {(b, a) for a, b in _NEXT}
_DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d)")
_UNIT = 8
_LOOK = 64
_SEGMENT = math.log10(2)
_LOG = {n: math.log10(n) for n in range(1, 4096)}


def char_cost(c: str) -> float:
    """Log of the number of characters of the same kind as ``c``."""
    if c.isdigit():
        return 1.0
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return _LOG[26]
    return _LOG[33] if c < "\x80" else _LOG[100]


def word_cost(piece: str, words: Dictionary = COMMON) -> float | None:
    """Log of the guesses for a dictionary word, its capitals and its letter swaps."""
    low = piece.lower()
    plain = low if low in words.rank else low.translate(SWAPS)
    if plain not in words.rank:
        return None
    upper = sum(c.isupper() for c in piece)
    case = 0.0 if upper == 0 else _LOG[2] if upper == len(piece) or piece[0].isupper() and upper == 1 else upper * _LOG[3]
    return math.log10(words.rank[plain]) + case + sum(_LOG[2] for a, b in zip(low, plain) if a != b)


def pieces(value: str, at: int, words: Dictionary = COMMON) -> Iterator[tuple[int, float]]:
    """``(end, log guesses)`` of every word and date that starts at ``at``."""
    for size in range(3, min(words.longest, len(value) - at) + 1):
        cost = word_cost(value[at : at + size], words)
        if cost is not None:
            yield at + size, cost
    if value[at].isdigit():
        date = _DATE.match(value, at)
        if date:
            yield date.end(), _LOG[150] + (_LOG[365] + _LOG[4] if date.end() - at > 4 else 0.0)
            if date.end() - at > 4 and _DATE.fullmatch(value, at, at + 4):
                yield at + 4, _LOG[150]


def _unit_cost(unit: str, words: Dictionary) -> float:
    word = word_cost(unit, words) if len(unit) > 2 else None
    return min(sum(map(char_cost, unit)), math.inf if word is None else word)


def _repeat_edge(value: str, at: int, unit: int) -> int:
    """The first place from ``at`` whose character does not come again ``unit`` later."""
    while at + unit < len(value) and value[at] == value[at + unit]:
        at += 1
    return at


def _walk(low: list[str], at: int) -> tuple[int, list[int]]:
    """The end of the keyboard or alphabet run from ``at``, and the turns up to each of its characters."""
    turns, end = [0], at + 1
    while end < len(low) and (low[end - 1], low[end]) in _NEXT:
        turn = end - at > 1 and (low[end] > low[end - 1]) != (low[end - 1] > low[end - 2]) and not low[end].isalpha()
        turns.append(turns[-1] + turn)
        end += 1
    return end, turns


def segments(value: str, at: int, words: Dictionary = COMMON) -> Iterator[tuple[int, float]]:
    """``(end, log guesses)`` of every known piece that starts at ``at``, brute force of one character apart."""
    yield from pieces(value, at, words)
    for unit in range(1, _UNIT + 1):
        for times in range(3 if unit == 1 else 2, (_repeat_edge(value, at, unit) - at) // unit + 2):
            yield at + times * unit, _unit_cost(value[at : at + unit], words) + math.log10(times)
    end, turns = _walk([c.lower() for c in value], at)
    for size in range(3, end - at + 1):
        yield at + size, _LOG[47] + math.log10(size) + turns[size - 1] * _LOG[5]


class _Run:
    """The cheapest beginning of a keyboard run, as the run grows.

    A run from place ``at`` whose beginning is worth ``base`` costs ``base + log10(end - at)``. Of two beginnings the
    later one can only be the cheaper one until some end and never again, so those that still can win form a stack
    with the present winner on top, each with the end at which the one below overtakes it.
    """

    def __init__(self):
        self.stack: list[tuple[int, float, float]] = []

    def _settle(self, end: int) -> None:
        while self.stack and self.stack[-1][2] <= end:
            self.stack.pop()

    def add(self, at: int, base: float, end: int) -> None:
        """Admit the beginning ``at``; ``end`` is the shortest run from it."""
        self._settle(end)
        if self.stack and self.cost(end) <= base + math.log10(end - at):
            return
        until = math.inf
        while self.stack:
            before, worth, overtaken = self.stack[-1]
            if worth < base:
                # Beyond 10^15 places no run reaches.
                ratio = 10 ** min(base - worth, 15.0)
                until = (ratio * at - before) / (ratio - 1) if ratio > 1 else math.inf
                if until < overtaken:
                    break
            self.stack.pop()
            until = math.inf
        self.stack.append((at, base, until))

    def cost(self, end: int) -> float:
        self._settle(end)
        return self.stack[-1][1] + math.log10(end - self.stack[-1][0]) if self.stack else math.inf


def guess_cost(value: str, enough: float = math.inf, words: Dictionary = COMMON) -> float:
    """Log10 of the fewest guesses that any segmentation of ``value`` into ``segments`` needs.

    Adjacent brute-force characters are one segment. A repeat of any length is laid out once from its first place, and
    again from a later one only where that can come out cheaper; keyboard runs keep the beginnings that can still win.
    Stops early with a lower bound of at least ``enough`` once no segmentation can come out cheaper.
    """
    n = len(value)
    known, brute = [math.inf] * (n + 1), [math.inf] * (n + 1)
    known[0] = 0.0
    low = [c.lower() for c in value]
    edges, origins = [-1] * (_UNIT + 1), [{} for _ in range(_UNIT + 1)]
    walk, walk_from, turns, run = 0, 0, [0], _Run()
    worth = [0.0] * n
    furthest, check = 0, _LOOK
    for i in range(n + 1):
        if i <= walk and i - walk_from >= 3:
            run.add(i - 3, worth[i - 3], i)
            known[i] = min(known[i], run.cost(i) + turns[i - 1 - walk_from] * _LOG[5])
        if i == n:
            break
        if i >= walk:
            walk_from, run = i, _Run()
            walk, turns = _walk(low, i)
        start = min(known[i], brute[i])
        begun = start + (_SEGMENT if i else 0.0)
        # The first turn of a run needs three characters, so the one met at its second character is not its own.
        worth[i] = begun + _LOG[47] - turns[min(i + 1, walk - 1) - walk_from] * _LOG[5]
        brute[i + 1] = min(brute[i], known[i] + (_SEGMENT if i else 0.0)) + char_cost(value[i])
        for end, cost in pieces(value, i, words):
            known[end] = min(known[end], begun + cost)
            furthest = max(furthest, end)
        for unit in range(1, _UNIT + 1):
            if edges[unit] < i:
                edges[unit], origins[unit] = _repeat_edge(value, i, unit), {}
            times, least = (edges[unit] - i) // unit + 1, 3 if unit == 1 else 2
            if times < least:
                continue
            # From an earlier place of the same run k more times cost log((k + m) / k) more at most.
            before = origins[unit].get(i % unit)
            if before and begun - before[1] >= math.log10(1 + (i - before[0]) / unit / least):
                continue
            origins[unit][i % unit] = i, begun
            once = begun + _unit_cost(value[i : i + unit], words)
            for k in range(least, times + 1):
                known[i + k * unit] = min(known[i + k * unit], once + math.log10(k))
            furthest = max(furthest, i + times * unit)
        if i >= check:
            least = min(min(known[i + 1 : max(furthest, i + 1) + 1]), brute[i + 1])
            # A run that is still open ends beyond i, after at least three characters.
            if walk > i + 1:
                open_ = [worth[k] + _LOG[3] for k in range(max(walk_from, i - 2), i + 1)]
                least = min(least, min([run.cost(i + 1), *open_]) + turns[i - walk_from] * _LOG[5])
            if least >= enough:
                return least
            check = i + max(16, (furthest - i) // 4)
    return min(known[n], brute[n])


_BASE = [(kind, re.compile(p, re.ASCII | (re.IGNORECASE if kind == "assign" else 0)), group, least) for kind, p, group, least in BASE]
_CONTEXT = re.compile(CONTEXT, re.ASCII | re.IGNORECASE)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def scan(text: str, min_cost: float = MIN_COST, words: Dictionary = COMMON) -> dict:
    """Counts, spans and weakest base value of one text."""
    base, cheap = [], 0
    for kind, pattern, group, least in _BASE:
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                base.append((kind, m.start(), m.end()))
                cheap += kind == "assign" and guess_cost(m[group], min_cost, words) < min_cost
    held = [(a, b) for kind, a, b in base if kind == "assign"]
    cred = []
    for m in _CONTEXT.finditer(text):
        a, b = m.span(m.lastindex)
        if not any(x < b and a < y for x, y in held) and guess_cost(m[m.lastindex], min_cost, words) >= min_cost:
            cred.append(("cred", a, b))
    count = lambda kind: sum(s[0] == kind for s in base)
    return {
        "n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"), "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(),
        "spans": joined(base + cred), "n_cred": len(cred), "n_cheap": cheap,
    }


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cred long, n_cheap long"


def vocabulary(docs: DataFrame, text_col: str = "text", most: int = VOCABULARY, least: int = MIN_DOCS) -> list[str]:
    """The ``most`` words in the most texts of ``docs``, commonest first; words in fewer than ``least`` texts are left out."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(TABLE_WORD), F.lit(0)))
    counted = docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("texts")).filter(F.col("texts") >= least)
    counted = freeze(counted.withColumn("step", F.floor(F.log2("texts") * 8)))
    # One row for each step of an eighth of a doubling: at most some hundreds.
    steps = sorted(counted.groupBy("step").count().collect(), reverse=True)
    upto = itertools.accumulate(r["count"] for r in steps)
    low = next((r["step"] for r, n in zip(steps, upto) if n >= most), 0)
    # Frozen before it is collected, so the driver gets the words and not the commonest of each partition.
    top = freeze(counted.filter(F.col("step") >= low).orderBy(F.col("texts").desc(), "word").limit(most))
    return [r.word for r in sorted(top.collect(), key=lambda r: (-r.texts, r.word))]


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_cost: float = MIN_COST, words: Sequence[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id and the fields of ``scan``.

    ``words`` follow the common passwords in the dictionary; without them the table's own ``vocabulary`` does.
    """
    names = [f.split()[0] for f in FOUND.split(", ")]
    kinds = [pa.string() if f.endswith("string") else pa.int64() for f in FOUND.split(", ")]
    ranked = Dictionary([*WORDS, *(vocabulary(docs, text_col) if words is None else words)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py() or "", min_cost, ranked) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[n] for f in found], k) for n, k in zip(names, kinds)]], names=["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id long, {FOUND}")
