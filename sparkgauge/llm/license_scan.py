"""Licence scan: an Aho-Corasick automaton finds tags and phrases, a shunting-yard parser evaluates expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
#: Phrase and label of the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases and the licence each names.
NOTICES = {
    "apache license version 2 0": "apache-2.0", "mit license": "mit", "bsd license": "bsd", "mozilla public license": "mpl",
    "lesser general public license": "lgpl", "affero general public license": "agpl", "gnu general public license version 3": "gpl-3.0",
    "gnu general public license version 2": "gpl-2.0", "cc by 4 0": "cc-by-4.0", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd", "cc0": "cc0", "public domain": "public-domain", "unlicense": "unlicense", "isc license": "isc",
}
TAGS = ("spdx license identifier", "license identifier")
#: How freely text under a licence may be used, by prefix of its id; the longest prefix counts, unknown ids get UNKNOWN.
FREEDOM = {
    "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "mit": 1.0, "isc": 1.0, "bsd": 1.0, "apache": 1.0, "cc-by": 0.9, "mpl": 0.6,
    "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nc": 0.1, "cc-by-nd": 0.1, "reserved": 0.0, "proprietary": 0.0,
}
UNKNOWN, EXCEPTION = 0.2, 0.2
#: Further families of licence ids; of their freedom nothing is said.
FAMILIES = (*FREEDOM, "0bsd", "afl", "artistic", "bsl", "cddl", "cecill", "epl", "eupl", "gfdl", "ncsa", "odbl", "ofl", "openssl", "postgresql", "psf", "python", "unicode", "wtfpl", "x11", "zlib")
#: A licence id: a known family, also with versions and the usual endings.
ID = re.compile(rf"(?:{'|'.join(map(re.escape, sorted(FAMILIES, key=len, reverse=True)))})(?:-(?:v?[0-9][0-9.]*|only|or|later|clause|new|sa|nc|nd|igo|no|invariants|patent|lbnl|shortened|attribution|license))*\+?")
#: Any other name that ends in a version may be an operand, of unknown freedom, but is no label.
OTHER = re.compile(r"[a-z][a-z0-9]*(?:-[a-z0-9]+)*-v?[0-9]+(?:\.[0-9]+)*(?:-only|-or-later|\+)?")
EXCEPTION_ID = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*-exception(?:-[0-9.]+)?")
TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+\-]*)")
AFTER_TAG = re.compile(r"[\s]*[:=]?[\s]*")
RANK = {"or": 1, "and": 2, "with": 3}


def freedom(name: str) -> float:
    known = [p for p in FREEDOM if re.match(rf"{re.escape(p)}(?![a-z0-9])", name)]
    return FREEDOM[max(known, key=len)] if known else UNKNOWN


def operand_of(token: str, exception: bool) -> str | None:
    """The licence id, other versioned name or, after with, exception that a token is, without a full stop after it; None if it is none."""
    name = token.rstrip(".")
    kinds = (EXCEPTION_ID,) if exception else (ID, OTHER)
    return name if any(k.fullmatch(name) for k in kinds) else None


def parse(text: str, at: int = 0) -> tuple[float | None, list[str], int]:
    """The longest valid licence expression at a place of text: its value, its licence ids, its end.

    Operands are ids and names with a version (see `operand_of`), so prose after a tag is no expression; only ids of
    known families are labels.

    Shunting-yard with precedence with > and > or: or takes the freest choice, and the strictest,
    with adds an exception to what stands before it. No valid expression: (None, [], 0). The stacks are
    kept from token to token, and outside parentheses at most three operators wait, so a long
    expression takes time in proportion to its length.
    """
    value, known, stop = None, 0, 0
    values: list[float] = []
    names: list[str] = []
    ops: list[str] = []
    opened, want, last = 0, True, ""
    while m := TOKEN.match(text, at):
        t = m[1].lower()
        operand = t not in RANK and t not in "()"
        if (operand or t == "(") != want or t == ")" and not opened or last == "with" and t == "(":
            break
        if operand and (t := operand_of(t, last == "with")) is None:
            break
        if t in RANK:
            while ops and ops[-1] != "(" and RANK[ops[-1]] >= RANK[t]:
                apply(ops, values)
            ops.append(t)
        elif t == "(":
            ops.append(t)
        elif t == ")":
            while ops[-1] != "(":
                apply(ops, values)
            ops.pop()
        else:
            values.append(freedom(t))
            if last != "with" and ID.fullmatch(t):
                names.append(t)
        opened += (t == "(") - (t == ")")
        want, last = t == "(" or t in RANK, t
        at = m.end()
        if not want and not opened:
            waiting, rest = ops.copy(), values.copy()
            while waiting:
                apply(waiting, rest)
            value, known, stop = rest[0], len(names), at
    return value, names[:known], stop


def apply(ops: list[str], values: list[float]) -> None:
    op, b, a = ops.pop(), values.pop(), values.pop()
    values.append(max(a, b) if op == "or" else min(a, b) if op == "and" else min(1.0, a + EXCEPTION))


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
        for p, label in phrases.items():
            key = f" {p} "
            a.add_word(key, [*a.get(key, []), (kind, p, label)])
    a.make_automaton()
    return a


def scan(text: str | None, a) -> tuple[int, int, int | None, int | None, str, str, float]:
    low = (text or "").translate(LOWER)
    words = WORD.findall(low)
    line = " " + " ".join(words) + " "
    starts, base, labels, value, tags = [], set(), set(), None, []
    at = n = 0  # words begin after blanks: the n-th word begins at `at`
    for end, found in a.iter(line):
        for kind, phrase, label in found:
            start = end - len(phrase) - 1
            n += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
            at = start
            if kind == "base":
                starts.append(n)
                base.add(label)
            if kind == "tag":
                tags.append(n + phrase.count(" "))
            else:
                labels.add(label)
    if labels:
        # A notice that names a licence more closely speaks for the family's own label.
        named = [x for x in labels if not any(y != x and y.startswith(f"{x}-") for y in labels)]
        value = min(freedom(x) for x in named)
    if tags:
        last = set(tags)
        for k, m in enumerate(WORD.finditer(low)):
            if k in last:
                v, names, _ = parse(low, AFTER_TAG.match(low, m.end()).end())
                if v is not None:
                    labels |= set(names)
                    value = v if value is None else min(value, v)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 0.0 if value is None else value


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_all(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    a = automaton()
    for texts in batches:
        out = pd.DataFrame([scan(t, a) for t in texts], columns=[f.split()[0] for f in FIELDS.split(", ")])
        yield out.astype({"first_word": "Int64", "last_word": "Int64"})


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its licence phrases, labels and how freely it may be used.

    A null or empty text has no words and no labels, score 0; repeated and null ids give a row each; other
    columns are not carried; an empty table gives no rows. Word positions count from 0. The automaton
    finds phrases and tags; an expression is read where a tag ends, of any length. Its labels are its
    licence ids, lower-case; words that are none end it. score: value of the expression or, of several
    notices, the strictest; 0 where nothing was found. Map-only: no shuffle, one automaton per task.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), F.pandas_udf(scan_all, FIELDS)(F.col(text_col)).alias("f"))
    return found.select("doc_id", "f.*")
