"""Operator 2: URL filters by a bit-parallel wildcard automaton (multiword Shift-And).

Every rule is a glob over the canonical URL ``"." + host + path``: a literal byte,
``?`` (one byte but "/"), ``*`` (any bytes but "/") or ``**`` (any bytes).  All globs
are packed into one vector of 64-bit words, a bit per matched literal.  One step
reads one byte of every URL of a batch at once:

    D = ((D << 1) & move[byte]) | (D & stay[byte])

``move`` has the literals a byte continues, ``stay`` the wildcards it may repeat.

Edge cases: a null URL or one without "://" has empty host and path and fits no
rule; very long URLs cost one vector step per byte, and rows that ended drop out of the
step; repeated rows are judged each; no rules or an empty table are fine.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.llm.common import ascii_lower

#: The production rules: (host + path prefix, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block"))
DEFAULT_VERDICT = "allow"
STATE_WORDS = 1 << 20   # words of state a batch may hold; longer batches are cut


def rule_globs(rule: str) -> list[str]:
    """The globs of a host-and-path rule: its host and all subdomains, paths that start with its path."""
    return [f"*.{rule}**"] if "/" in rule else [f"*.{rule}", f"*.{rule}/**"]


class WildcardAutomaton:
    """All globs as one Shift-And automaton over bytes."""

    def __init__(self, globs: list[str]):
        literals: list[int | None] = []         # per bit: the byte that moves into it (None: ?)
        starts, finals, loops = [], [], {}      # loops: bit -> True if it may repeat "/" too
        for glob in globs:
            bit = len(literals)
            starts.append(bit)
            literals.append(-1)                 # no byte moves into a start
            data, i = glob.encode(), 0
            while i < len(data):
                if data[i:i + 2] == b"**":
                    loops[len(literals) - 1] = True
                    i += 2
                    continue
                if data[i] == 42:
                    loops.setdefault(len(literals) - 1, False)
                else:
                    literals.append(None if data[i] == 63 else data[i])
                i += 1
            finals.append(len(literals) - 1)
        self.words = max(1, -(-len(literals) // 64))
        self.start = self._mask(starts)
        self.finals = finals
        self.move = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        for byte in range(256):
            self.move[byte] = self._mask([b for b, c in enumerate(literals)
                                          if c == byte or (c is None and byte != 47)])
            self.stay[byte] = self._mask([b for b, slash in loops.items() if slash or byte != 47])

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b >> 6] |= np.uint64(1 << (b & 63))
        return out

    def run(self, texts: list[bytes]) -> np.ndarray:
        """The final state of every text: an array (texts, words)."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(texts), np.uint8)
        at = (np.cumsum(lengths) - lengths)[order]
        state = np.tile(self.start, (len(texts), 1))
        # how many (longest first) texts still have a byte at each position
        alive = len(texts) - np.searchsorted(np.sort(lengths), np.arange(1, lengths.max(initial=0) + 1))
        one, top = np.uint64(1), np.uint64(63)
        for step, n in enumerate(alive):
            byte = data[at[:n] + step]
            now = state[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:n] = (moved & self.move[byte]) | (now & self.stay[byte])
        back = np.empty_like(state)
        back[order] = state
        return back

    def best(self, texts: list[bytes], rank: np.ndarray, none: int) -> np.ndarray:
        """Per text the smallest ``rank`` of the globs that accept it, or ``none``."""
        per_bit = np.full(self.words * 64, none, np.int64)
        per_bit[self.finals] = rank
        accepts = self._mask(self.finals)
        out = np.full(len(texts), none, np.int64)
        rows = max(1, STATE_WORDS // self.words)
        for lo in range(0, len(texts), rows):
            state = self.run(texts[lo:lo + rows]) & accepts
            for w in np.flatnonzero(state.any(axis=0)):
                hit = np.flatnonzero(state[:, w])
                bits = np.unpackbits(state[hit, w].astype("<u8").view(np.uint8).reshape(-1, 8),
                                     axis=1, bitorder="little").astype(bool)
                ranks = np.where(bits, per_bit[w * 64:w * 64 + 64], none).min(axis=1)
                out[lo + hit] = np.minimum(out[lo + hit], ranks)
        return out


def host_of(url: Column) -> Column:
    """After the first "://" up to /, ?, # or the end; A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_judge(rules, default: str):
    """An Arrow-batched function: canonical URL -> (rule or null, verdict).

    The longest rule wins; of equally long ones a blocking rule, then the smallest by code point.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[1] != "block", r[0]))
    globs = [(g, k) for k, (rule, _) in enumerate(ordered) for g in rule_globs(rule)]
    automaton = WildcardAutomaton([g for g, _ in globs])
    rank = np.array([k for _, k in globs], np.int64)
    none = max([k for _, k in globs], default=-1) + 1
    names = np.array([r for r, _ in ordered] + [None], object)
    says = np.array([v for _, v in ordered] + [default], object)

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            best = automaton.best([u.encode("utf-8", "surrogatepass") for u in urls], rank, none)
            yield pd.DataFrame({"rule": names[best], "verdict": says[best]})

    return judge


def judge_urls(pages: DataFrame, rules=RULES, default: str = DEFAULT_VERDICT, *,
               id_col="page_id", url_col="url") -> DataFrame:
    """Per page: its id, host, path, rule (null: none fits) and verdict (then the default)."""
    judge = rule_judge(rules, default)
    split = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
                         path_of(F.col(url_col)).alias("path"))
    found = split.withColumn("found", judge(F.concat(F.lit("."), "host", "path")))
    return found.select("page_id", "host", "path", "found.rule", "found.verdict")
