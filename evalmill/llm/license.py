"""License scan: Aho-Corasick over words, and a shunting-yard parser for licence expressions.

One automaton holds every notice phrase and the identifier tag.  It runs over the words of the
whole text, so a phrase is found however its words are spaced or broken over lines.  Where it finds
the tag ``SPDX-License-Identifier:``, the rest of that line is parsed as an expression of ``AND``,
``OR``, ``WITH`` and parentheses, and evaluated.

Null and empty texts have no words and no labels.  Repeated rows each get their own result.
Columns of the input other than the id and the text are not read, so names cannot clash.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalmill.llm.common import over_batches

# The base phrases, whose every place counts, and the phrases the method adds.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
MORE_PHRASES = {
    "affero general public license": "agpl",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0 1 0 universal": "cc0",
    "released into the public domain": "public-domain",
    "dedicated to the public domain": "public-domain",
    "this is free and unencumbered software": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
TAG_PHRASE = "spdx license identifier"
TAG = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)
EXPRESSION_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
FAMILIES = {
    "mit": "mit", "mit-0": "mit", "apache": "apache", "gpl": "gpl", "agpl": "agpl", "lgpl": "lgpl",
    "mpl": "mpl", "epl": "epl", "cddl": "cddl", "eupl": "eupl", "bsl": "bsl", "bsd": "bsd",
    "0bsd": "bsd", "isc": "isc", "zlib": "zlib", "cc0": "cc0", "unlicense": "unlicense",
    "cc-by": "cc-by", "artistic": "artistic",
}
PERMISSIVE = {"mit", "apache", "bsd", "bsl", "isc", "zlib", "cc0", "unlicense", "public-domain", "cc-by"}

# Letters A-Z to lower case; what is neither a letter, a digit nor outside ASCII ends a word.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)

RESULT = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double, phrases array<struct<label:string,word:bigint,base:boolean>>, "
    "expressions array<struct<expression:string,labels:array<string>,permissive:boolean,exceptions:array<string>>>"
)


def family(identifier: str) -> str:
    """The label of a licence identifier: its family, else the identifier in lower case."""
    name = identifier.lower().rstrip("+")
    parts = name.split("-")
    for size in range(len(parts), 0, -1):
        if (label := FAMILIES.get("-".join(parts[:size]))) is not None:
            return label
    return name


def identifies(token: str) -> bool:
    """Whether a token can stand for a licence: a known family, one of its own, or a name with a version.

    Prose behind a tag has none of these.
    """
    low = token.lower()
    return family(token) in PERMISSIVE | set(FAMILIES.values()) or low.startswith("licenseref-") or any(map(str.isdigit, low))


def postfix(text: str) -> list[str]:
    """Shunting yard: the expression at the start of ``text`` in postfix order, [] if there is none.

    Reading stops where the expression cannot go on, so a comment's end or prose after it is left
    alone.  An operator without a right side and a group without an end count as absent.
    """
    output: list[str] = []
    stack: list[str] = []
    done: list[str] = []
    operand = True
    for token in EXPRESSION_TOKEN.findall(text):
        low = token.lower()
        if token == "(":
            if not operand:
                break
            stack.append("(")
        elif token == ")":
            if operand or "(" not in stack:
                break
            while stack[-1] != "(":
                output.append(stack.pop())
            stack.pop()
        elif low in PRECEDENCE:
            if operand:
                break
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[low]:
                output.append(stack.pop())
            stack.append(low)
            operand = True
            continue
        else:
            exception = bool(stack) and stack[-1] == "with"
            if not operand or not (exception or identifies(token)):
                break
            output.append(token)
            operand = False
        if not operand and "(" not in stack:
            done = output + stack[::-1]
    return done


def evaluate(expression: str) -> tuple[list[str], bool] | None:
    """Labels of an expression, and whether a choice exists that asks for permissive terms only.

    ``OR`` leaves the choice, ``AND`` needs both sides, ``WITH`` adds an exception to its licence.
    """
    stack: list[tuple[frozenset[str], bool]] = []
    for token in postfix(expression):
        if token.lower() not in PRECEDENCE:
            label = family(token)
            stack.append((frozenset([label]), label in PERMISSIVE))
            continue
        (left, left_free), (right, right_free) = stack[-2:]
        del stack[-2:]
        if token == "with":
            stack.append((left, left_free))
        elif token == "and":
            stack.append((left | right, left_free and right_free))
        else:
            stack.append((left | right, left_free or right_free))
    if not stack:
        return None
    labels, free = stack[-1]
    return sorted(labels), free


def exceptions(expression: str) -> list[str]:
    """What ``WITH`` adds to licences of an expression, in lower case."""
    tokens = postfix(expression)
    return [name.lower() for name, operator in zip(tokens, tokens[1:]) if operator == "with"]


@functools.cache
def _automaton():
    """Built once in a worker."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    phrases = [(p, label, True) for p, label in BASE_PHRASES.items()]
    phrases += [(p, label, False) for p, label in MORE_PHRASES.items()]
    phrases += [(TAG_PHRASE, "", False)]
    for phrase, label, base in phrases:
        automaton.add_word(f" {phrase} ", (len(phrase) + 1, label, base))
    automaton.make_automaton()
    return automaton


def scan_text(text: str | None, automaton) -> dict:
    words = (text or "").encode("utf-8", "replace").translate(_FOLD).split()
    line = f" {b' '.join(words).decode('utf-8', 'replace')} "
    found: list[tuple[int, str, bool]] = []
    expressions: list[dict] = []
    spaces = None
    for end, (size, label, base) in automaton.iter(line):
        if label:
            if spaces is None:
                spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
            found.append((int(np.searchsorted(spaces, end - size)), label, base))
        elif not expressions:
            for tag in TAG.finditer(text or ""):
                if (value := evaluate(tag[1])) is not None:
                    expressions.append(
                        {
                            "expression": tag[1].strip(), "labels": value[0], "permissive": value[1],
                            "exceptions": exceptions(tag[1]),
                        }
                    )
    base = sorted(word for word, _, is_base in found if is_base)
    labels = {label for _, label, _ in found} | {x for e in expressions for x in e["labels"]}
    # Each notice and each tag halves the doubt; a tag says more than a notice.
    doubt = 0.5 ** len(found) * 0.1 ** len(expressions)
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": base[0] if base else None,
        "last_word": base[-1] if base else None,
        "base_labels": ",".join(sorted({label for _, label, is_base in found if is_base})),
        "labels": ",".join(sorted(labels)),
        "score": 1.0 - doubt,
        "phrases": [{"label": label, "word": word, "base": is_base} for word, label, is_base in sorted(found)],
        "expressions": expressions,
    }


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: counts, labels, and every phrase and expression found."""
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    result = StructType.fromDDL(RESULT).fields
    names = [f.name for f in result]

    def work(batch: pa.RecordBatch) -> dict:
        automaton = _automaton()
        rows = [scan_text(text, automaton) for text in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), **{n: [r[n] for r in rows] for n in names}}

    return over_batches(source, work, StructType([source.schema["doc_id"], *result]))


def op4_license_scan(docs: DataFrame) -> DataFrame:
    scanned = scan_licenses(docs)
    return scanned.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )
