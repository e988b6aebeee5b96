"""URL filters: glob rules as one bit-parallel wildcard automaton.

Every rule is a glob over the canonical URL, which is a dot, the host, a mark, and the path. The rule (host, path) becomes the
pattern ``*.host``, mark, ``path*``; its first star does not cross the mark, so the rule fits the host itself and all its
subdomains. A star or question mark within a rule's own host or path is a wildcard too.

Shift-And: each pattern element is a bit, all patterns lie side by side in one row of 64-bit words, and one step for the
byte c is ``D = (D << 1 & B[c]) | (D & S[c])`` with carries between words. B[c] has the elements that c fits, S[c] the
stars that c keeps alive. All patterns advance together, and the URLs of a batch advance together, byte by byte. Of the
rules that are at their end the longest one decides, of equally long ones the first given.

Defined cases: a null URL, or one without ``://``, has an empty host and path; a path is compared as it is, only A-Z in hosts are
lower-cased; a URL that no rule fits gets the default verdict and a null rule; repeated rows are separate; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.shared import ship

MARK = 0xFF  # a byte that UTF-8 text doesn't have
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@dataclass
class Automaton:
    fits: np.ndarray  # (256, words): elements that a byte fits
    stays: np.ndarray  # (256, words): stars that a byte keeps alive
    start: np.ndarray
    ends: list[tuple[int, int]]  # word and bit of each rule's last element


def automaton(rules) -> Automaton:
    """Elements of a pattern: a start that stays on host bytes, one per literal byte or question mark, stars as stays of the element before."""
    elements: list[tuple[object, object]] = []  # (bytes fitted, bytes that keep it alive)
    starts, ends = [], []
    host_bytes, all_bytes = [c for c in range(256) if c != MARK], list(range(256))
    for host, path, _ in rules:
        starts.append(len(elements))
        elements.append(([], host_bytes))
        for text, own in ((f".{host}", host_bytes), (path + "*", all_bytes)):
            if own is all_bytes:
                elements.append(([MARK], []))
            for byte in text.encode():
                if byte == ord("*"):
                    fitted, _ = elements[-1]
                    elements[-1] = (fitted, own)
                else:
                    elements.append((own if byte == ord("?") else [byte], []))
        ends.append(len(elements) - 1)
    words = -(-max(1, len(elements)) // 64)
    out = Automaton(np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64), np.zeros(words, np.uint64), [(e // 64, e % 64) for e in ends])
    for k, (fitted, alive) in enumerate(elements):
        out.fits[fitted, k // 64] |= np.uint64(1 << k % 64)
        out.stays[alive, k // 64] |= np.uint64(1 << k % 64)
    for k in starts:
        out.start[k // 64] |= np.uint64(1 << k % 64)
    return out


def matches(machine: Automaton, urls: list[bytes]) -> np.ndarray:
    """(urls, rules): which rules fit each canonical URL."""
    lengths = np.array([len(u) for u in urls])
    order = np.argsort(-lengths, kind="stable")
    flat = np.frombuffer(b"".join(urls), np.uint8)
    begins = (np.cumsum(lengths) - lengths)[order]
    lengths = lengths[order]
    state = np.tile(machine.start, (len(urls), 1))
    active = len(urls)
    for t in range(int(lengths.max(initial=0))):
        while lengths[active - 1] <= t:
            active -= 1
        byte = flat[begins[:active] + t]
        now = state[:active]
        shifted = now << np.uint64(1)
        shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
        state[:active] = (shifted & machine.fits[byte]) | (now & machine.stays[byte])
    out = np.zeros((len(urls), len(machine.ends)), bool)
    for k, (word, bit) in enumerate(machine.ends):
        out[order, k] = (state[:, word] >> np.uint64(bit)) & np.uint64(1)
    return out


def url_verdicts(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of page_id, url."""
    ship(pages.sparkSession)
    rules = list(rules)
    ranked = sorted(range(len(rules)), key=lambda k: (-len(rules[k][0]) - len(rules[k][1]), k))
    at = F.instr(F.coalesce("url", F.lit("")), "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), rest.alias("rest"))
    parts = parts.withColumn("raw_host", F.regexp_extract("rest", "^[^/?#]*", 0))
    parts = parts.select(
        "page_id", F.translate("raw_host", UPPER, LOWER).alias("host"),
        F.regexp_extract(F.expr("substring(rest, length(raw_host) + 1)"), "^[^?#]*", 0).alias("path"),
    )

    def run(batches):
        machine = automaton(rules)
        for batch in batches:
            rule = np.full(len(batch), None, object)
            verdict = np.full(len(batch), default, object)
            for low in range(0, len(batch), 4096):
                some = batch.iloc[low:low + 4096]
                urls = [b"." + h.encode() + bytes([MARK]) + p.encode() for h, p in zip(some["host"], some["path"], strict=True)]
                found = matches(machine, urls)
                free = np.ones(len(some), bool)
                for k in ranked:
                    hit = np.flatnonzero(free & found[:, k])
                    rule[low + hit], verdict[low + hit] = rules[k][0] + rules[k][1], rules[k][2]
                    free[hit] = False
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "host": batch["host"], "path": batch["path"], "rule": rule, "verdict": verdict})

    return parts.mapInPandas(run, "page_id long, host string, path string, rule string, verdict string")
