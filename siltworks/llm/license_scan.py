"""Licence detection by ordered signature rules.

One Aho-Corasick pass over a text's lower-cased form finds which rules' keywords occur; only those rules' regular expressions
run, over the whole text. Detections are then taken by priority, length, place and rule order. One is suppressed if its
interval lies within that of a taken one, or overlaps that of a taken one of higher priority; others stay, so that
several licences in a text, and the same one in several places, are all reported.

A tag that names its licence by an SPDX expression is reported as that expression, in lower case.

Defined cases: null and empty texts have no detections; repeated rows report alike; equal intervals of equal priority
go to the earlier rule; places are those of the text itself (a sign whose lower case is longer than one sign is left as it is);
very long texts are scanned whole; an empty table gives no rows; extra columns don't matter; ids may be of any type.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kind_of, pick
from .license_rules import RULES


def compiled(rules=RULES) -> list[tuple[int, int, str, str, re.Pattern]]:
    """Rules with their expressions compiled: blanks outside of classes match any white space."""
    out = []
    for n, priority, name, word, rule in rules:
        loose = re.sub(r"(\[[^\]]*\])|( \?)|( )", lambda m: m[1] or (r"\s*" if m[2] else r"\s+"), rule)
        out.append((n, priority, name, word, re.compile(loose, re.MULTILINE)))
    return out


def resolve(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(priority, rule, start, end) that stay, by place."""
    taken: list[tuple[int, int, int, int]] = []
    for x in sorted(found, key=lambda f: (-f[0], f[2] - f[3], f[2], f[1])):
        p, _, a, b = x
        if not any((c <= a and b <= d) or (q > p and a < d and c < b) for q, _, c, d in taken):
            taken.append(x)
    return sorted(taken, key=lambda f: (f[2], f[3], f[1]))


def lowered(text: str) -> str:
    """Lower case, sign by sign, so that places are kept."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def named(licence: str, matched: str) -> str:
    """What a detection is reported as: its rule's licence, or the expression that a tag holds."""
    return " ".join(matched.lower().split(":", 1)[1].strip(" \t\r\n()").split()) if licence == "spdx-tag" else licence


class Scanner:
    def __init__(self, rules=RULES):
        import ahocorasick

        self.rules = compiled(rules)
        words: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            for w in r[3].split(";"):
                words.setdefault(" ".join(w.split()), []).append(i)
        self.machine = ahocorasick.Automaton()
        # a keyword's first word, since white space within it may vary
        heads: dict[str, list[tuple[str, list[int]]]] = {}
        for w, where in words.items():
            heads.setdefault(max(w.split(), key=len), []).append((w, where))
        for head, entries in heads.items():
            self.machine.add_word(head, entries)
        self.machine.make_automaton()

    def scan(self, text: str) -> list[tuple[int, int, int, int]]:
        low = lowered(text)
        heads = {id(e): e for _, e in self.machine.iter(low)}
        if not heads:
            return []
        flat = " ".join(low.split())
        found = []
        for i in sorted({i for e in heads.values() for w, where in e if w in flat for i in where}):
            n, priority, _, _, rule = self.rules[i]
            found += [(priority, n, m.start(), m.end()) for m in rule.finditer(low) if m.end() > m.start()]
        return resolve(found) if found else []


_SCANNER: Scanner | None = None


def _run(batches):
    global _SCANNER
    if _SCANNER is None:
        _SCANNER = Scanner()
    names = [r[2] for r in _SCANNER.rules]
    for batch in batches:
        ids, rows = batch.column(0), ([], [], [], [], [], [])
        for i, text in enumerate(batch.column("text")):
            value = text.as_py()
            if value:
                for _, n, a, b in _SCANNER.scan(value):
                    for column, x in zip(rows, (i, n, a, b, value[a:b], named(names[n], value[a:b]))):
                        column.append(x)
        at, rule, start, end, part, licence = rows
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(licence, pa.string()), pa.array(rule, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(part, pa.string())], ["doc_id", "license", "rule", "start", "end", "matched"])


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, license, rule, start, end, matched): every detection that stays."""
    light = pick(docs, "doc_id", "text")
    return light.mapInArrow(_run, f"doc_id {kind_of(light, 'doc_id')}, license string, rule int, start int, end int, matched string")
