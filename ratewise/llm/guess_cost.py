"""Secrets in texts, and the cost of guessing a value.

Fixed patterns find assignments, access keys and hexadecimal runs.  Beyond them,
every value in a credential context (after a word such as password, pwd, token or
bearer and a separator) is given the least cost of guessing it: a dynamic program
over its characters takes the cheapest segmentation into dictionary words, dates,
repeats, keyboard walks and spans tried by brute force.  Costs are log10 of the
number of guesses and add up over segments.  A value at or over ``THRESHOLD`` is
reported as kind ``guess``; words, dates and walks in such places, as in prose or
in placeholders, cost less.

The dictionary is the vocabulary file of a word tokenizer (whole words in the order
of its ids, frequent ones first), given by its path, behind a few fixed common
passwords.

Spans are places in code points, the end exclusive: the whole match for the fixed
patterns, the value alone for ``guess``.  No shuffle: one pass over the texts.

Defined cases: NULL texts are empty; texts and values of any length are searched
whole (the program stops where the cost can't fall below the threshold any more);
repeated rows and ids get a row each, NULL ids stay NULL; extra columns are
ignored; an empty table gives no rows.  A value of letters alone in one case, or
with only its first letter in upper case, is a word of some language and isn't
reported as ``guess``.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from datetime import date
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.llm.common import identified, restored, schema

# The patterns of the base kinds, which results depend on.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 12
#: The runs that these find are those of the patterns ``AKIA[A-Z0-9]+`` and ``[0-9a-f]+`` with 18 and 16 characters.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "guess")

#: Words that announce a credential, then a separator and a value.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|(?:access|private)[_-]?key|credentials?|bearer)["']?"""
    r"""\x20{0,4}(?:[:=]>?|\x20is\x20|\x20)\x20{0,4}["']?([^\s"'<>,;]+)""", re.IGNORECASE | re.ASCII)
#: log10 of the guesses from which a value in a credential context counts as a secret.
THRESHOLD = 10.0

# Common passwords that no dictionary of words has.
COMMON = ("password", "123456", "qwerty", "letmein", "admin", "welcome", "changeme", "iloveyou", "dragon", "monkey",
          "passw0rd", "secret", "root", "default", "example", "placeholder", "dummy", "sample", "test", "guest",
          "your", "xxx", "todo", "null", "none", "undefined", "foobar", "abc123", "trustno1", "master", "login")
# The rows of a keyboard, plain and shifted, each a key right of the one before.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = ("~!@#$%^&*()_+", "QWERTYUIOP{}|", 'ASDFGHJKL:"', "ZXCVBNM<>?")
# Characters that stand for letters.
LEET = str.maketrans("4@831!0$57+", "aabeiiosstt")

LONGEST_WORD = 24
LONGEST_PERIOD = 16
_DATE = re.compile(r"(?:(\d{1,2})([-/._]?)(\d{1,2})\2(\d{4}|\d{2})|(\d{4})([-/._]?)(\d{1,2})\6(\d{1,2})|((?:19|20)\d\d))", re.ASCII)
_LONGEST_DATE = 10


def _neighbours() -> dict[str, set[str]]:
    """Keys next to each key: beside it, and below or above it on the slanted board."""
    plain = {c: (r, k) for r, row in enumerate(KEY_ROWS) for k, c in enumerate(row)}
    out: dict[str, set[str]] = {}
    for c, (r, k) in plain.items():
        # the second row starts half a key right of where it would stand, under the second key of the first
        shift = 1 if r == 0 else 0
        near = [(r, k - 1), (r, k + 1), (r + 1, k - 1 - shift), (r + 1, k - shift),
                (r - 1, k + (1 if r == 1 else 0)), (r - 1, k + (2 if r == 1 else 1))]
        out[c] = {d for d, place in plain.items() if place in near}
    return out


_NEAR = _neighbours()
_UNSHIFT = {s: p for rows in zip(SHIFTED, KEY_ROWS) for s, p in zip(*rows)}
_DEGREE = sum(map(len, _NEAR.values())) / len(_NEAR)


def default_words() -> str:
    """The installed public word vocabulary."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def dictionary(path: str) -> dict[str, int]:
    """Rank of each word of three letters or more: the common passwords, then whole words in the order of their ids."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = [t[:-4] for t in sorted(vocab, key=vocab.get) if t.endswith("</w>")]
    words = [w for w in words if 3 <= len(w) <= LONGEST_WORD and w.isalpha() and w.isascii()]
    return {w: k for k, w in reversed(list(enumerate([*COMMON, *words], 1)))}


def kind_size(c: str) -> int:
    """How many characters a guesser tries in the place of ``c``: those of its kind."""
    if c.isascii():
        return 10 if c.isdigit() else 26 if c.isalpha() else 33
    return 100


def word_cost(span: str, ranks: dict[str, int]) -> float | None:
    """Rank of a dictionary word, its upper case and its replaced letters tried as well."""
    low = span.lower()
    plain = ranks.get(low)
    swapped = low.translate(LEET)
    rank = plain or ranks.get(swapped)
    if not rank:
        return None
    cost = math.log10(rank + 1)
    upper = sum(c.isupper() for c in span)
    if upper:
        regular = upper == len(span) or upper == 1 and (span[0].isupper() or span[-1].isupper())
        cost += math.log10(2) if regular else math.log10(sum(math.comb(len(span), k) for k in range(1, upper + 1)))
    if not plain:
        cost += math.log10(2) * sum(a != b for a, b in zip(low, swapped))
    return cost


def date_cost(span: str) -> float | None:
    """A day of the calendar in a usual order, or a year: days within the years that must be tried."""
    m = _DATE.fullmatch(span)
    if not m:
        return None
    if m[9]:
        return math.log10(max(abs(int(m[9]) - 2000), 20))
    x, y = (int(m[1]), int(m[3])) if m[1] else (int(m[7]), int(m[8]))
    year = int(m[4] or m[5])
    if len(m[4] or m[5]) == 2:
        year += 2000 if year < 50 else 1900
    orders = [(x, y), (y, x)] if m[1] else [(y, x)]
    if not 1000 <= year <= 2999 or not any(_is_day(year, month, day) for day, month in orders):
        return None
    return math.log10(365 * max(abs(year - 2000), 20)) + (math.log10(4) if m[2] or m[6] else 0)


def _is_day(year: int, month: int, day: int) -> bool:
    try:
        date(year, month, day)
    except ValueError:
        return False
    return True


def _step(a: str, b: str) -> str | None:
    """How b follows a on a walk: up or down the alphabet or the digits, or to a next key."""
    if a.isascii() and b.isascii() and (a.isdigit() and b.isdigit() or a.isalpha() and b.isalpha()):
        if ord(b) - ord(a) in (1, -1):
            return "up" if b > a else "down"
    a, b = (_UNSHIFT.get(c, c) for c in (a, b))
    return "key" if b in _NEAR.get(a, ()) else None


def walk_cost(span: str) -> float | None:
    """Three keys or more, each next to the one before, or a run up or down: start, length and turns."""
    steps = [_step(a, b) for a, b in zip(span, span[1:])]
    if len(span) < 3 or None in steps:
        return None
    if len(set(steps)) == 1 and steps[0] != "key":
        return math.log10(kind_size(span[0])) + math.log10(len(span))
    turns = sum(a != b for a, b in zip(span[1:], span[2:]))
    return math.log10(len(_NEAR)) + math.log10(len(span)) + min(turns, len(span) - 1) * math.log10(_DEGREE) / 2


def brute_cost(span: str) -> float:
    return sum(math.log10(kind_size(c)) for c in span)


def guess_cost(value: str, ranks: dict[str, int], stop: float = math.inf) -> float:
    """log10 of the guesses of the cheapest segmentation.

    At or over ``stop`` the result is a lower bound: no segmentation costs less
    than the cheapest place that an open segment can have started at.
    """
    n = len(value)
    least = [0.0] + [math.inf] * n
    walk_start = 0            # start of the run of steps that ends here
    period_start = [0] * (LONGEST_PERIOD + 1)  # start of the run that repeats itself at each distance
    for end in range(1, n + 1):
        c = value[end - 1]
        best = least[end - 1] + math.log10(kind_size(c))
        for start in range(max(0, end - LONGEST_WORD), end - 2):
            if least[start] < best:
                cost = word_cost(value[start:end], ranks)
                if cost is not None:
                    best = min(best, least[start] + cost)
        if c.isdigit():
            for start in range(max(0, end - _LONGEST_DATE), end - 3):
                cost = date_cost(value[start:end])
                if cost is not None:
                    best = min(best, least[start] + cost)
        if end > 1 and _step(value[end - 2], c) is None:
            walk_start = end - 1
        for start in range(max(walk_start, end - LONGEST_WORD), end - 2):
            cost = walk_cost(value[start:end])
            if cost is not None:
                best = min(best, least[start] + cost)
        open_runs = [end]
        for period in range(1, LONGEST_PERIOD + 1):
            if end <= period or value[end - 1 - period] != c:
                period_start[period] = max(0, end - period)
                continue
            start = period_start[period]
            open_runs.append(start)
            times, rest = divmod(end - start, period)
            if times >= 2 and not rest:
                block = value[start:start + period]
                cost = min(brute_cost(block), word_cost(block, ranks) or math.inf) + math.log10(times)
                best = min(best, least[start] + cost)
        least[end] = best
        floor = min(min(least[max(0, end - LONGEST_WORD):end + 1]), *(least[s] for s in open_runs))
        if floor >= stop:
            return floor
    return least[n]


def is_word(value: str) -> bool:
    """Letters alone, in one case or with a first capital."""
    return value.isalpha() and (value[1:].islower() or value.isupper() or len(value) == 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, kind, end) of the fixed patterns."""
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    return found + [(*m.span(), "hex") for m in HEX.finditer(text)]


def guess_spans(text: str, ranks: dict[str, int], threshold: float) -> list[tuple[int, int, str]]:
    """Values in credential contexts that cost ``threshold`` or more to guess."""
    out = []
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".!?):]}")
        if value and not is_word(value) and guess_cost(value, ranks, threshold) >= threshold:
            out.append((m.start(1), m.start(1) + len(value), "guess"))
    return out


def written(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then by the order of the kinds."""
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in
                    sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


_OUT = ("doc_id long, no_id boolean, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
        "n_guess long")


def find_secrets(docs: DataFrame, words: str | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Secrets of every text: the fixed patterns' counts and digest, and all spans."""
    path = words or default_words()
    columns = [f.name for f in schema(_OUT)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = dictionary(path)
        for batch in batches:
            out = []
            for doc_id, no_id, text in zip(batch.doc_id, batch.no_id, batch.text):
                text = text or ""
                base, more = base_spans(text), guess_spans(text, ranks, threshold)
                kinds = [s[2] for s in base]
                out.append((doc_id, no_id, *(kinds.count(k) for k in KINDS[:3]),
                            hashlib.sha256(written(base).encode()).hexdigest(), written(base + more), len(more)))
            yield pd.DataFrame(out, columns=columns)

    return restored(identified(docs, id_col, text_col).mapInPandas(run, schema(_OUT)))


def redact(docs: DataFrame, mark: str = "[secret]", words: str | None = None, threshold: float = THRESHOLD,
           text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark`` (overlapping spans by one)."""
    from ratewise.llm.common import col, ship
    ship(docs.sparkSession)
    path = words or default_words()

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        ranks = dictionary(path)

        def one(text: str | None) -> str | None:
            if not text:
                return text
            parts, at = [], 0
            for start, end, _ in sorted(base_spans(text) + guess_spans(text, ranks, threshold)):
                if start >= at:
                    parts += [text[at:start], mark]
                at = max(at, end)
            return "".join(parts) + text[at:]
        return texts.map(one)

    return docs.withColumn(text_col, cleaned(col(text_col)))
