"""Secrets in texts: fixed patterns, and values that would be dear to guess.

Three patterns find what looks like a secret. Beyond them, values that stand in a
credential context (``password is ...``, ``<secret>...``, ``--token ...``, ``Bearer
...``, the user part of a URL, a private key block) are judged by the price of
guessing them: the cheapest way to cut the value into words, dates, repeats,
keyboard walks and spans of brute force, by dynamic programming over its
characters. A value dearer than ``min_bits`` is a secret; ``changeme123`` is not.

Words are known ones by their rank, and, at the price of a large dictionary, whatever
reads like a word of some language; several such words with blanks between are prose,
which has one price. So ``the password is incorrect`` holds no secret.

Defined cases: a null or empty text has no spans; whole texts are read whatever
their length; rows repeat as they come; extra columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "guess")

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Linear on any text: a value is read up to the next quote or line end, where the next one starts.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|bearer|auth|(?:api|access|private)[_-]?key)"""
    r"""["'\]]?[\x20\t]*+(?:=>|:=|[:=>]|(?<=\x20)is\x20)[\x20\t]*+"""
    r"""(?:"([^"\n]++)"|'([^'\n]++)'|([^\s"'<>]+))""",
    re.ASCII | re.IGNORECASE,
)
#: What follows an option of a command, a bearer's word, or a user name in a URL.
OPTION = re.compile(
    r"""(?<![\w-])--?(?:pass(?:word|wd|phrase)?|pwd|token|secret|(?:api|access|private|secret)[_-]?key|auth[_-]?token)"""
    r"""(?:=|[\x20\t]++)(?:"([^"\n]++)"|'([^'\n]++)'|([^\s"'<>-][^\s"'<>]*+))""",
    re.ASCII | re.IGNORECASE,
)
BEARER = re.compile(r"(?<![a-z])bearer[\x20\t]++([a-z0-9._~+/=-]++)", re.ASCII | re.IGNORECASE)
USER = re.compile(r"://[^\s:/@\"'<>]*+:([^\s@/\"'<>]++)@")
KEY_BEGIN = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
KEY_END = re.compile(r"-----END [A-Z ]{0,40}PRIVATE KEY-----")
#: A text without any of these (in lower case) has no credential context.
HINTS = ("pass", "pwd", "secret", "token", "credential", "bearer", "auth", "api", "access", "private", "://")

#: Common words of passwords and placeholders, the commonest first.
WORDS = (
    "password pass admin user login qwerty welcome letmein secret master dragon monkey test guest root default "
    "changeme change me example sample demo dummy hello love super star sun shine princess football baseball "
    "soccer hockey summer winter spring autumn january february march april may june july august september "
    "october november december monday tuesday wednesday thursday friday saturday sunday michael jordan thomas "
    "daniel robert jessica ashley charlie maria peter anna freedom whatever trust no one computer internet "
    "server client local host data base token key api value string none null true false your my the this is "
    "not here insert enter replace with place holder redacted hidden removed config setting service account "
    "system manager office company home house dog cat tiger lion eagle blue red green black white silver gold "
    "orange purple coffee pizza cookie banana apple shadow killer hunter ranger batman iron man magic money "
    "happy lucky crazy angel flower family friend mother father brother sister baby secure safe private public "
    "access open close new old temp first last name number one two three four five six seven eight nine zero"
).split()
LEET = str.maketrans("4@301!5$7", "aaeoiisst")
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = str.maketrans('!@#$%^&*()_+{}:"<>?', "1234567890-=[];',./")
KEYS = {key: (row, col) for row, keys in enumerate(ROWS) for col, key in enumerate(keys)}
SEGMENT_BITS = 2.0  # which kind of segment comes next
WORD_MAX = 16
UNIT_MAX = 16
YEARS = 150
#: Bits of a word of some language, and of a sentence, and the letters a word has.
ANY_WORD_BITS, PROSE_BITS, ANY_WORD = 17.0, 30.0, (4, 22)
_LETTERS = re.compile(r"[^\W\d_]++")
_PROSE = re.compile(r"[^\W\d_]++(?:[,;:]?\x20[^\W\d_]++){2,}+[.!?]?")
_CLUSTER = re.compile(r"[^aeiouy]{5}|[aeiouy]{4}")

DATE = re.compile(
    r"(?=(?P<ymd>(?:19|20)\d\d(?P<s>[-/._]?)(?:0[1-9]|1[0-2])(?P=s)(?:0[1-9]|[12]\d|3[01]))?)"
    r"(?=(?P<dmy>(?:0[1-9]|[12]\d|3[01])(?P<t>[-/._]?)(?:0[1-9]|1[0-2])(?P=t)(?:19|20)\d\d)?)"
    r"(?=(?P<mdy>(?:0[1-9]|1[0-2])(?P<u>[-/._]?)(?:0[1-9]|[12]\d|3[01])(?P=u)(?:19|20)\d\d)?)"
    r"(?=(?P<year>(?:19|20)\d\d)?)",
    re.ASCII,
)


def char_bits(char: str) -> float:
    """Bits to guess one character by brute force."""
    if "0" <= char <= "9":
        return math.log2(10)
    if "a" <= char <= "z" or "A" <= char <= "Z":
        return math.log2(26)
    return math.log2(33) if char < "\x7f" else math.log2(100)


def word_bits(word: str, ranks: dict[str, int]) -> float | None:
    """Bits of a known word, its capitals and its digits for letters."""
    low = word.lower()
    for plain, extra in ((low, 0.0), (low.translate(LEET), 1.0)):
        rank = ranks.get(plain)
        if rank:
            cased = 0.0 if word == low else 1.0 if word in (low.capitalize(), low.upper()) else float(len(word))
            return math.log2(rank) + cased + extra
    return None


def reads_like_a_word(letters: str) -> bool:
    """Whether letters can be said: of one case, with vowels, and no long run without or of them."""
    if not (letters.islower() or letters.isupper() or letters.istitle()):
        return not letters[:1].isascii() and letters.isalpha()  # scripts without case
    plain = "".join(c for c in unicodedata.normalize("NFD", letters.lower()) if not unicodedata.combining(c))
    vowels = sum(c in "aeiouy" for c in plain)
    return not plain.isascii() or (5 * vowels >= len(plain) and not _CLUSTER.search(plain))


def prose(value: str) -> Iterator[tuple[int, int, float]]:
    """Words of some language between other characters, and rows of three and more of them."""
    for m in _LETTERS.finditer(value):
        if ANY_WORD[0] <= len(m[0]) <= ANY_WORD[1] and reads_like_a_word(m[0]):
            yield m.start(), m.end(), ANY_WORD_BITS
    for m in _PROSE.finditer(value):
        if all(len(w) <= ANY_WORD[1] and (len(w) < ANY_WORD[0] or reads_like_a_word(w)) for w in _LETTERS.findall(m[0])):
            yield m.start(), m.end(), PROSE_BITS


def walks(value: str) -> Iterator[tuple[int, int, float]]:
    """From each start, the longest run of neighbouring keys, if over three."""
    low = value.lower().translate(SHIFTED) if value.isascii() else ""
    steps: list[tuple[int, int] | None] = []
    for a, b in zip(low, low[1:]):
        if a in KEYS and b in KEYS:
            (r0, c0), (r1, c1) = KEYS[a], KEYS[b]
            move = (r1 - r0, c1 - c0)
            near = move in ((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1))
            steps.append(move if near else None)
        else:
            steps.append(None)
    end, turns = len(steps), 0
    # from the right, so that each start costs one step
    for start in range(len(steps) - 1, -1, -1):
        if steps[start] is None:
            end, turns = start, 0
            continue
        if start + 1 < end and steps[start] != steps[start + 1]:
            turns += 1
        length = end - start + 1
        if length > 3:
            yield start, end + 1, math.log2(len(KEYS)) + math.log2(length) + (turns + 1) * math.log2(6)


def repeats(value: str, ranks: dict[str, int]) -> Iterator[tuple[int, int, float]]:
    """From each start and for each unit length, the longest row of one unit."""
    for size in range(1, min(UNIT_MAX, len(value) // 2) + 1):
        same = 0  # how far value[i:] equals value[i + size:]
        for start in range(len(value) - size - 1, -1, -1):
            same = same + 1 if value[start] == value[start + size] else 0
            times = same // size + 1
            if times > (2 if size == 1 else 1):
                unit = value[start : start + size]
                known = word_bits(unit, ranks)
                plain = sum(map(char_bits, unit))
                yield start, start + times * size, min(plain, plain if known is None else known) + math.log2(times)


def segments(value: str, ranks: dict[str, int]) -> Iterator[tuple[int, int, float]]:
    """All cheap segments: start, end, bits."""
    for start in range(len(value)):
        for end in range(start + 2, min(len(value), start + WORD_MAX) + 1):
            bits = word_bits(value[start:end], ranks)
            if bits is not None:
                yield start, end, bits
    for found in DATE.finditer(value):
        for form in ("ymd", "dmy", "mdy", "year"):
            text = found[form]
            if text:
                days = 1 if form == "year" else 366
                sep = 2.0 if not text.isdigit() else 0.0
                yield found.start(), found.start() + len(text), math.log2(YEARS * days) + sep
    yield from repeats(value, ranks)
    yield from walks(value)
    yield from prose(value)


def guess_bits(value: str, ranks: dict[str, int]) -> float:
    """Bits of the cheapest way to guess ``value``: a minimum over all ways to cut it."""
    ending: list[list[tuple[int, float]]] = [[] for _ in range(len(value) + 1)]
    for start, end, bits in segments(value, ranks):
        ending[end].append((start, bits))
    best, brute = [0.0], math.inf
    for end in range(1, len(value) + 1):
        brute = min(brute, best[end - 1] + SEGMENT_BITS) + char_bits(value[end - 1])
        best.append(min([brute, *(best[start] + SEGMENT_BITS + bits for start, bits in ending[end])]))
    return best[-1]


@lru_cache(maxsize=4)
def word_ranks(words: tuple[str, ...]) -> dict[str, int]:
    ranks: dict[str, int] = {}
    for word in words:
        if len(word) > 1:
            ranks.setdefault(word.lower(), len(ranks) + 1)
    return ranks


def contexts(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of all values in a credential context; some may come twice."""
    for pattern in (CONTEXT, OPTION):
        for m in pattern.finditer(text):
            group = m.lastindex
            value = m[group] if group < 3 else m[group].rstrip(",;.)]}")
            yield m.start(group), m.start(group) + len(value)
    for m in BEARER.finditer(text):
        yield m.start(1), m.start(1) + len(m[1].rstrip("."))
    for m in USER.finditer(text):
        yield m.span(1)
    at = 0
    while begin := KEY_BEGIN.search(text, at):
        end = KEY_END.search(text, begin.end())
        if end is None:
            break
        yield begin.start(), end.end()
        at = end.end()


def find_spans(text: str, min_bits: float, ranks: dict[str, int]) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order; code points, end exclusive."""
    spans = []
    low = text.lower()
    if any(hint in low for hint in HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        reach = 0  # a value within one that is a secret is part of it
        for start, end in sorted(set(contexts(text)), key=lambda x: (x[0], -x[1])):
            if max(start, reach) < end and guess_bits(text[start:end], ranks) >= min_bits:
                spans.append((start, 3, end))
                reach = end
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _named(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


FOUND = T.StructType(
    [
        T.StructField("n_assign", T.LongType()),
        T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()),
        T.StructField("n_guess", T.LongType()),
        T.StructField("base", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)


def secret_spans(text: Column, min_bits: float = 40.0, words: Sequence[str] = WORDS) -> Column:
    """A struct: counts by kind, ``base`` (spans of the fixed patterns) and ``spans`` (all).

    A span is ``kind:start:end``; spans are ordered by start, then as in ``KINDS``.
    ``words`` are the known words, the commonest first.
    """
    ranked_words = tuple(words)

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        ranks = word_ranks(ranked_words)
        columns: list[list] = [[] for _ in FOUND]
        for value in texts:
            spans = find_spans(value.as_py() or "", min_bits, ranks)
            for kind in range(4):
                columns[kind].append(sum(s[1] == kind for s in spans))
            columns[4].append(_named([s for s in spans if s[1] < 3]))
            columns[5].append(_named(spans))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=FOUND.names)

    return find(text)


def redact(text: Column, mark: str = "[SECRET]", min_bits: float = 40.0, words: Sequence[str] = WORDS) -> Column:
    """``text`` with each span (overlapping ones as one) replaced by ``mark``; null stays null."""
    ranked_words = tuple(words)

    @F.arrow_udf(T.StringType())
    def replace(texts: pa.Array) -> pa.Array:
        ranks = word_ranks(ranked_words)
        out = []
        for value in texts:
            plain = value.as_py()
            spans = find_spans(plain, min_bits, ranks) if plain else []
            if spans:
                pieces, at = [], 0
                for start, _, end in spans:
                    if start >= at:
                        pieces += [plain[at:start], mark]
                    at = max(at, end)
                plain = "".join([*pieces, plain[at:]])
            out.append(plain)
        return pa.array(out, pa.string())

    return replace(text)


def scan_secrets(docs: DataFrame, min_bits: float = 40.0) -> DataFrame:
    """``doc_id``, counts by kind, ``base`` and ``spans`` of each document."""
    return docs.select("doc_id", secret_spans(F.col("text"), min_bits).alias("_found")).select("doc_id", "_found.*")
