"""Secret scanning: keyword automaton, anchored patterns near its hits, embedded checksums."""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from verdant.llm.common import whole_text

# The base kinds in their listed order, then the kinds that the method adds, each with
# the keywords that announce it, its pattern, the group that is measured and that group's least length.
KINDS = ("assign", "access", "hex", "checked")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LENGTH = 8
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_KEYWORDS = ("akia",)
ACCESS_LENGTH = 16
HEX_LENGTH = 32
HEX = r"[0-9a-f]{%d,}" % HEX_LENGTH
# Tokens whose last six characters are the CRC-32 of the thirty before them, in base 62.
CHECKED = r"(?:ghp|gho|ghu|ghs|ghr|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"
CHECKED_KEYWORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(width, BASE62[0])


def checksum_ok(m: re.Match) -> bool:
    return base62(zlib.crc32(m[1].encode()), 6) == m[2]


class Scanner:
    """Spans (start, kind number, end) of the secrets in a text, in code points, end exclusive."""

    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        for kind, words in ((0, ASSIGN_KEYWORDS), (1, ACCESS_KEYWORDS), (3, CHECKED_KEYWORDS)):
            for w in words:
                self.automaton.add_word(w, (kind, len(w)))
        self.automaton.make_automaton()
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        self.access = re.compile(ACCESS, re.ASCII)
        self.checked = re.compile(CHECKED, re.ASCII)
        self.hex = re.compile(HEX, re.ASCII)
        self.upper = {c: c + 32 for c in range(65, 91)}

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        low = text.lower()
        if len(low) != len(text):  # some capitals lower to two characters, which would shift the hits
            low = text.translate(self.upper)
        hits = sorted((end - n + 1, kind) for end, (kind, n) in self.automaton.iter(low))
        found, after = [], [0, 0, 0, 0]
        for at, kind in hits:
            if at < after[kind]:
                continue  # inside the match before, which the pattern would have passed over
            if kind == 0:
                m = self.assign.match(text, at)
                ok = m and len(m[2]) >= ASSIGN_LENGTH
            elif kind == 1:
                m = self.access.match(text, at)
                ok = m and m.end() - at >= ACCESS_LENGTH
            else:
                m = self.checked.match(text, at)
                ok = m and checksum_ok(m)
            if m:
                after[kind] = m.end()
                if ok:
                    found.append((at, kind, m.end()))
        # runs of hexadecimal digits have no keyword: a run is its own hit
        found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        return sorted(found)


def written(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string")


def _scan(frames):
    scanner = Scanner()
    for pdf in frames:
        out = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            spans = scanner.spans(text)
            counts = [sum(1 for s in spans if s[1] == k) for k in range(4)]
            base = written([s for s in spans if s[1] < 3])
            out.append((doc_id, *counts, hashlib.sha256(base.encode()).hexdigest(), written(spans)))
        yield pd.DataFrame(out, columns=["key", "n_assign", "n_access", "n_hex", "n_checked", "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the number of spans of each kind, the digest of the base
    spans and all spans as ``kind:start:end`` in order of start, then kind.

    One pass over the whole texts with no shuffle. The automaton finds every keyword in either case, and
    a pattern is tried only where one starts, which are the only places where it can match; a kind's
    matches do not overlap, leftmost first, and a match that fails its length or checksum still hides
    what it covers. Null counts as the empty text, which has no spans; repeated rows get equal answers,
    a null doc_id stays null, and other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), whole_text().alias("text"))
    found = rows.mapInPandas(_scan, SCHEMA.replace("doc_id long", "key string"))
    return found.select(F.col("key").cast("long").alias("doc_id"), *[c.split()[0] for c in SCHEMA.split(", ")[1:]])


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """(doc_id, text): the texts with every span replaced by ``mark``; overlapping spans become one."""
    def cut(frames):
        scanner = Scanner()
        for pdf in frames:
            texts = []
            for text in pdf["text"]:
                parts, at = [], 0
                for start, _, end in scanner.spans(text):
                    if start >= at:
                        parts += [text[at:start], mark]
                    at = max(at, end)
                texts.append("".join(parts) + text[at:])
            yield pd.DataFrame({"key": pdf["doc_id"], "text": texts})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInPandas(cut, "key string, text string").select(F.col("key").cast("long").alias("doc_id"), "text")
