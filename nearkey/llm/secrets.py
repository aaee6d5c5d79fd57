"""Secret scans: a trigram index per segment of rows narrows the texts that each rule verifies.

From every rule's regular expression a Boolean trigram query is derived: clauses that must all
hold, each an alternative of strings whose trigrams must all occur. A segment (a slice of an Arrow
batch) inverts its texts over the trigrams that the rules ask for, the queries intersect and unite
the postings, and only the surviving texts meet the regular expression. A rule without a mandatory
trigram scans every text. The index is partitioned by document, so there is no shuffle at all.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from re import _parser as sre

from nearkey.llm.shared import documents, in_tasks, text_chunks


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The three base rules, whose spans are counted, in their listed order.
BASE_RULES = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2, True),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]{32,}", 32),  # a greedy run of 32 or more is the maximal run
)
#: Further rules, whose spans are only listed.
MORE_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("live", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("maps", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES
_MOST = 64  # strings of an alternative; beyond, it is given up as unselective


def _strings(node: tuple) -> set[str] | None:
    """All strings a parsed item can match, if they are few and plain."""
    op, value = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(value)}
    if op == "IN":
        chars = [chr(c) for k, v in value for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1) if str(k) == "RANGE" else [])]
        plain = all(str(k) in ("LITERAL", "RANGE") for k, _ in value)
        return set(chars) if plain and len(chars) <= 8 else None
    if op == "SUBPATTERN":
        return _sequence(list(value[3]))
    if op == "BRANCH":
        parts = [_sequence(list(x)) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if op == "MAX_REPEAT" and value[0] in (0, 1) and value[1] == 1:
        inner = _sequence(list(value[2]))
        return None if inner is None else inner | ({""} if not value[0] else set())
    return None


def _sequence(nodes: list) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > _MOST:
            return None
        out = {a + b for a in out for b in more}
    return out


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3].lower() for i in range(len(text) - 2))


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """A conjunction of alternatives of trigram sets (lower case); empty: nothing is mandatory.

    Runs of items that stand for few plain strings make the clauses; an optional or open-ended
    item ends a run.
    """
    clauses: list[list[frozenset[str]]] = []
    run = {""}

    def close() -> None:
        nonlocal run
        if all(len(x) >= 3 and x.isascii() for x in run):
            clauses.append([_trigrams(x) for x in sorted(run)])
        run = {""}

    for node in list(sre.parse(pattern)):
        more = _strings(node)
        if more is None or "" in more and len(run) * len(more) > 8:
            close()
        elif len(run) * len(more) > _MOST:
            close()
            run = more
        else:
            run = {a + b for a in run for b in more}
    close()
    return clauses


class SegmentIndex:
    """Postings of the rules' trigrams over the texts of one segment."""

    def __init__(self, grams: list[str], buffer: np.ndarray, offsets: np.ndarray):
        self.n = len(offsets) - 1
        wanted = np.array([int.from_bytes(g.encode(), "big") for g in grams], np.uint32)
        order = np.argsort(wanted)
        low = buffer + ((buffer >= 65) & (buffer <= 90)).astype(np.uint8) * np.uint8(32)
        firsts = np.zeros(256, bool)
        firsts[[ord(g[0]) for g in grams]] = True
        seconds = np.zeros(256, bool)
        seconds[[ord(g[1]) for g in grams]] = True
        at = np.flatnonzero(firsts[low[:-2]] & seconds[low[1:-1]]) if len(low) > 2 else np.zeros(0, np.int64)
        code = (low[at].astype(np.uint32) << 16) | (low[at + 1].astype(np.uint32) << 8) | low[at + 2]
        slot = np.minimum(np.searchsorted(wanted[order], code), len(grams) - 1)
        row = np.searchsorted(offsets, at, "right") - 1
        good = (wanted[order][slot] == code) & (at + 3 <= offsets[row + 1])
        pair = np.unique(slot[good] * np.int64(self.n) + row[good])
        gram, row = pair // max(self.n, 1), pair % max(self.n, 1)
        self.postings = {grams[order[g]]: row[gram == g] for g in np.unique(gram)}

    def candidates(self, query: list[list[frozenset[str]]]) -> np.ndarray:
        rows = np.arange(self.n)
        for alternatives in query:
            some = np.zeros(0, np.int64)
            for grams in alternatives:
                both = rows
                for g in grams:
                    both = np.intersect1d(both, self.postings.get(g, some[:0]), assume_unique=True)
                some = np.union1d(some, both)
            rows = some.astype(np.int64)
        return rows


def find_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carry: tuple[str, ...] = ("doc_id",), redact: str | None = None, name: str = "found") -> DataFrame:
    """``carry`` columns and ``name array<struct<kind, start, end>>`` per row of ``docs``.

    Spans are in code points, end exclusive, ordered by start and then by the rules' order. With
    ``redact``, a ``text`` column follows in which each span (overlapping ones united) is replaced
    by that string. Null or empty texts have no spans; a null text stays null. No rows in, no rows out. Rows that repeat have each
    their spans; columns not in ``carry`` are ignored, and ``name`` and ``text`` must not be in it.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({g for q in queries for c in q for s in c for g in s})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [r.compiled() for r in rules]
        for batch in batches:
            for part, buffer, offsets in text_chunks(batch, "_text"):
                index = SegmentIndex(grams, buffer, offsets) if grams else None
                texts = part.column("_text").to_pylist()
                found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                for k, (rule, query, pattern) in enumerate(zip(rules, queries, compiled)):
                    for i in index.candidates(query) if query else range(len(texts)):
                        for m in pattern.finditer(texts[i] or ""):
                            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                                found[i].append((m.start(), k, m.end()))
                kind = [r.kind for r in rules]
                spans = [[{"kind": kind[k], "start": a, "end": b} for a, k, b in sorted(x)] for x in found]
                columns = [part.column(c) for c in carry] + [pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]
                if redact is not None:
                    columns.append(pa.array([_redacted(t, x, redact) if x else t for t, x in zip(texts, found)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*carry, name] + ["text"] * (redact is not None))

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + f", `{name}` array<struct<kind:string,start:long,end:long>>" + (", text string" if redact is not None else "")
    return in_tasks(docs.select(*carry, F.col("text").cast("string").alias("_text")), run, schema)


def _redacted(text: str, spans: list[tuple[int, int, int]], by: str) -> str:
    out, done = [], 0
    for start, _, end in sorted(spans):
        if start >= done:
            out += [text[done:start], by]
        done = max(done, end)
    return "".join(out) + text[done:]


def digest(found: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """The report of :func:`find_spans`: counts of the base kinds, their digest and all spans."""
    base = F.filter("found", lambda x: x["kind"].isin([r.kind for r in rules]))
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    is_kind = lambda kind: lambda x: x["kind"] == kind
    counts = [F.size(F.filter("found", is_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in rules]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    return digest(find_spans(documents(spark, sf_dir)))
