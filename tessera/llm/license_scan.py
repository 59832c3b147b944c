"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser evaluates tag expressions."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import texts

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "apache license version 2 0": "apache-2.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "creative commons attribution": "cc",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: Identifiers whose use carries no share-alike or non-commercial duty; a prefix ends at a character other than a letter.
PERMISSIVE = ("mit", "apache", "bsd", "isc", "zlib", "unlicense", "cc0", "cc-by-4.0", "boost", "bsl", "python")

#: Identifiers that a tag may name, without a version's "-only", "-or-later" or "+"; "licenseref-" and "documentref-" open any name.
IDENTIFIERS = frozenset(
    """0bsd afl-3.0 agpl-1.0 agpl-3.0 apache-1.1 apache-2.0 artistic-1.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-3-clause bsd-4-clause
    bsl-1.0 busl-1.1 cc-by-3.0 cc-by-4.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1
    cecill-2.1 cpl-1.0 ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 isc lgpl-2.0 lgpl-2.1 lgpl-3.0 lppl-1.3c mit mit-0 mpl-1.1 mpl-2.0
    ms-pl ms-rl mulanpsl-2.0 ncsa ofl-1.1 openssl osl-3.0 postgresql psf-2.0 python-2.0 ruby sleepycat unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1""".split()
)

WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_EXPRESSION = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+:-]*)")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def is_identifier(word: str, identifiers: frozenset[str] = IDENTIFIERS) -> bool:
    """Whether a lower-cased word names a licence, or an exception."""
    return word.startswith(("licenseref-", "documentref-")) or "-exception" in word or word.removesuffix("+").removesuffix("-only").removesuffix("-or-later") in identifiers


def parse_expression(text: str, identifiers: frozenset[str] = IDENTIFIERS) -> list[str] | None:
    """Reverse Polish form of a lower-cased licence expression by the shunting-yard method; None if it is malformed.

    ``with`` binds closest, then ``and``, then ``or``, all from the left. Text after the expression (a comment's end, prose from the first
    word that is no identifier, with an operator before it) is dropped.
    """
    out: list[str] = []
    stack: list[str] = []
    at, operand = 0, True  # whether an operand is due
    while m := _TOKEN.match(text, at):
        token = m[1]
        if token == "(":
            if not operand:
                break
            stack.append(token)
        elif token == ")":
            if operand or "(" not in stack:
                break
            while (top := stack.pop()) != "(":
                out.append(top)
        elif token in PRECEDENCE:
            if operand:
                return None
            while stack and PRECEDENCE.get(stack[-1], 0) >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        else:
            if not operand:
                break
            if not is_identifier(token, identifiers):
                if stack and stack[-1] in PRECEDENCE and out:
                    stack.pop()
                    operand = False
                break
            out.append(token)
            operand = False
        at = m.end()
    if operand or "(" in stack:
        return None
    out += reversed(stack)
    depth = 0
    for x in out:  # an exception must be a name: "a with (b or c)" is refused
        depth += -1 if x in PRECEDENCE else 1
    return out if depth == 1 and not _compound_exception(out) else None


def _compound_exception(rpn: list[str]) -> bool:
    sizes: list[int] = []
    for x in rpn:
        if x in PRECEDENCE:
            right, left = sizes.pop(), sizes.pop()
            if x == "with" and (right > 1 or left > 1):
                return True
            sizes.append(left + right + 1)
        else:
            sizes.append(1)
    return False


def evaluate(rpn: list[str]) -> tuple[bool, set[str]]:
    """Whether a permissive choice satisfies the expression (``and``: both, ``or``: either, ``with``: the licence), and its licence names."""
    stack: list[tuple[bool, set[str]]] = []
    for x in rpn:
        if x in PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            stack.append({"and": (left[0] and right[0], left[1] | right[1]), "or": (left[0] or right[0], left[1] | right[1]), "with": left}[x])
        else:
            stack.append((any(x == p or x.startswith(p) and not x[len(p)].isalpha() for p in PERMISSIVE), {x}))
    return stack[0]


def _automaton(notices: dict[str, str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    found: dict[str, list[tuple[str, str]]] = {}
    for kind, phrases in (("base", BASE), ("notice", notices), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            found.setdefault(f" {phrase} ", []).append((kind, label))
    for phrase, what in found.items():
        a.add_word(phrase, (len(phrase), what))
    a.make_automaton()
    return a


def scan_text(text: bytes, automaton: ahocorasick.Automaton, identifiers: frozenset[str] = IDENTIFIERS) -> tuple:
    words = text.translate(WORDS).split()
    line = " " + b" ".join(words).decode("latin-1") + " "
    n_base, first, last, base, labels, evidence, tagged = 0, None, None, set(), set(), 0, False
    at = word = 0
    for end, (length, what) in automaton.iter(line):
        for kind, label in what:
            if kind == "base":
                start = end - length + 1
                if start >= at:
                    word, at = word + line.count(" ", at, start), start
                    index = word
                else:  # a longer phrase ended later than it
                    index = word - line.count(" ", start, at)
                first, last = index if first is None else min(first, index), index if last is None else max(last, index)
                n_base += 1
                base.add(label)
                evidence += 1
            elif kind == "notice":
                labels.add(label)
                evidence += 1
            else:
                tagged = True
    expressions, permissive = [], None
    if tagged:
        for m in _EXPRESSION.finditer(text.lower()):
            if rpn := parse_expression(m[1].decode(errors="replace"), identifiers):
                yes, names = evaluate(rpn)
                permissive = yes if permissive is None else permissive and yes
                labels |= names
                expressions.append(" ".join(rpn))
                evidence += 2
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), 1 - 0.5**evidence, ";".join(expressions) or None, permissive


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, permissive boolean"


def scan_licenses(docs: DataFrame, notices: dict[str, str] = NOTICES, identifiers: frozenset[str] = IDENTIFIERS) -> DataFrame:
    """One row of ``SCHEMA`` for every row of ``docs(doc_id, text)``; nothing moves between tasks.

    ``n_base`` counts all places of base phrases, overlapping ones too; ``labels`` adds notices and the licences that
    identifier tags name; ``score`` is 1 - 0.5 ** evidence, a place counting one and a tag two; ``expressions``: the tags in
    reverse Polish form; ``permissive``: all tags can be met by permissive licences, null without tags. Null and empty
    texts: no words, score 0. Malformed tags, and those that name no identifier: ignored. ``notices``: phrases (words of a-z, 0-9, one space apart)
    and their labels; ``identifiers``: what tags may name. Repeated rows and null ids are kept; other columns are ignored.
    """
    fields = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "permissive"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.bool_()]

    def run(batches):
        automaton = _automaton(notices)
        for batch in batches:
            rows = [scan_text(t, automaton, identifiers) for t in texts(batch["text"])]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True))], names=fields)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, SCHEMA)
