"""URL rules as glob patterns, all tried at once by a bit-parallel automaton.

Every pattern is a chain of states in a row of 64-bit words: one bit per literal
byte and one for its start. A step shifts the whole row by one, carries between
words, and masks with the states that the next byte may enter (Shift-And); a
state before a ``*`` also keeps itself. One pass over a URL so tells which of
all patterns fit the whole of it. A batch of URLs steps together.

A URL is brought to the form ``.host#path`` first: neither part can hold ``#``,
and the dot in front lets ``*.net#/*`` mean a host and all its subdomains.

Defined cases: null, or no ``://``: host and path empty, no rule; a very long
URL takes as many steps as it has bytes, alone; rows repeat as they come.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storefront.llm.common import map_batches, text_bytes

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class HostRule:
    """A verdict for a host with its subdomains, and paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}#{self.path}*"


@dataclass(frozen=True)
class GlobRule:
    """A verdict for URLs in the form ``.host#path`` that fit a glob (``*``: any run)."""

    verdict: str
    glob: str


#: The rules of the query.
HOST_RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)
#: What decides where no host rule fits; the first that fits wins, else ``allow``.
GLOB_RULES = (
    GlobRule("block", "*#*/login*"),
    GlobRule("block", "*#*/admin/*"),
    GlobRule("block", "*#*.exe"),
    GlobRule("block", "*#*.zip"),
    GlobRule("block", ".ads.*#*"),
    GlobRule("block", "*.doubleclick.*#*"),
    GlobRule("block", "*#*/tag/*/page/*"),
)


class ShiftAnd:
    """Masks of all patterns, and their simulation over byte strings."""

    def __init__(self, globs: Sequence[str]) -> None:
        literals, loops, starts, ends = [], set(), [], []
        for glob in globs:
            starts.append(len(literals))
            literals.append(None)
            for byte in glob.encode():
                if byte == 0x2A:
                    loops.add(len(literals) - 1)
                else:
                    literals.append(byte)
            ends.append(len(literals) - 1)
        self.words = max(1, -(-len(literals) // 64))
        self.enter = np.zeros((256, self.words), np.uint64)
        self.stay, self.first = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        for bit, byte in enumerate(literals):
            if byte is not None:
                self.enter[byte, bit >> 6] |= np.uint64(1 << (bit & 63))
        for bits, mask in ((loops, self.stay), (starts, self.first)):
            for bit in bits:
                mask[bit >> 6] |= np.uint64(1 << (bit & 63))
        self.ends = np.array(ends, np.int64)

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """For each text and pattern, whether the pattern fits the whole text."""
        n = len(texts)
        lengths = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(texts), np.uint8)
        begins = (np.cumsum(lengths) - lengths)[order]
        falling = -lengths[order]
        state = np.repeat(self.first[None, :], n, axis=0)
        one, top = np.uint64(1), np.uint64(63)
        for step in range(int(-falling[0]) if n else 0):
            live = int(np.searchsorted(falling, -step, side="left"))  # texts longer than step
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.enter[data[begins[:live] + step]]) | (now & self.stay)
        fits = np.zeros((n, len(self.ends)), bool)
        fits[order] = (state[:, self.ends >> 6] >> (self.ends & 63).astype(np.uint64)) & one != 0
        return fits


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, in lower case."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def judge_urls(
    pages: DataFrame,
    host_rules: Sequence[HostRule] = HOST_RULES,
    glob_rules: Sequence[GlobRule] = GLOB_RULES,
    default: str = "allow",
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each page; the longest host rule wins."""
    ranked_rules = sorted(host_rules, key=lambda r: (-len(r.name), r.name))
    rules = [*ranked_rules, *glob_rules]
    automaton = ShiftAnd([r.glob for r in rules])
    names = [r.name for r in ranked_rules] + [None] * (len(glob_rules) + 1)
    verdicts = [r.verdict for r in rules] + [default]
    globs = [None] * len(ranked_rules) + [r.glob for r in glob_rules] + [None]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, paths = text_bytes(batch.column("host")), text_bytes(batch.column("path"))
        fits = automaton.match([b"." + h + b"#" + p for h, p in zip(hosts, paths)])
        first = np.where(fits.any(axis=1), fits.argmax(axis=1), len(rules))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"),
                batch.column("host"),
                batch.column("path"),
                pa.array([names[i] for i in first], pa.string()),
                pa.array([verdicts[i] for i in first], pa.string()),
                pa.array([globs[i] for i in first], pa.string()),
            ],
            ["page_id", "host", "path", "rule", "verdict", "glob"],
        )

    parsed = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
    )
    # a null url gives null columns above
    parsed = parsed.fillna("", ["host", "path"])
    return map_batches(
        parsed, work, "page_id long, host string, path string, rule string, verdict string, glob string"
    )
