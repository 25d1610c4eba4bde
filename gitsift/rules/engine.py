"""Content rules over added text, compiled to Columns.

A rule is data: named strings (text or regular expression), a condition over them, a severity and the
paths it applies to. All rules become one projection, so the text of a file is read once; there
is no join of files with rules.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCAN_BYTES = 200_000  # of the added text of a file, the part that is scanned
# Fixed value: directories whose files are not scanned.
EXCLUDED_DIRS = ["helm", ".idea", "venv", "test", "tests", ".env", "dist", "build", "migrations", ".github"]
SEVERITIES = ("critical", "high", "medium", "low")


@dataclass(frozen=True)
class Text:
    """One string of a rule, matched on the bytes of the text.

    kind: ``text``; ``regex`` (dot excludes only the line feed, ^ and $ are the ends of the data, word characters are ASCII, \\x80
    to \\xff are bytes of UTF-8); ``hex`` (bytes in hexadecimal, ?? for any, [2-12] for a gap); ``unicode`` (Java's regular expression on the
    decoded characters, in ``any``, ``all`` and ``of`` only).
    """

    pattern: str
    kind: str = "regex"
    nocase: bool = False

    def body(self) -> str:
        if self.kind == "text":
            return re.escape(as_bytes(self.pattern))
        return hex_regex(self.pattern) if self.kind == "hex" else to_java(as_bytes(self.pattern))

    def flags(self) -> str:
        return "(?is)" if self.nocase and self.kind == "hex" else "(?i)(?d)" if self.nocase else "(?s)" if self.kind == "hex" else "(?d)"

    def found(self, text: Column) -> Column:
        if self.kind == "text":
            p = as_bytes(self.pattern)
            # lower() would also change bytes beyond ASCII, so only the letters A to Z are folded
            return F.translate(text, UPPER, UPPER.lower()).contains(p.translate(FOLD)) if self.nocase else text.contains(p)
        if self.kind == "unicode":  # a cast does not fail on a character that the byte limit cuts
            return text.rlike(r"[\x80-\xff]") & F.encode(text, "ISO-8859-1").cast("string").rlike(("(?iu)" if self.nocase else "") + self.pattern)
        matched = text.rlike(self.flags() + self.body())
        part = self.literal()
        return text.contains(part) & matched if part else matched

    def literal(self) -> str:
        """Characters that stand in every match, to be looked for first, as that is much cheaper; empty if there are none for sure."""
        return needed_part(as_bytes(self.pattern)) if self.kind == "regex" and not self.nocase else ""

    def count(self, text: Column) -> Column:
        """Matches at every start, overlapping ones too."""
        if self.kind == "unicode":
            raise ValueError("strings of kind unicode are not counted")
        part = as_bytes(self.pattern) if self.kind == "text" and not self.nocase else self.literal()
        n = F.regexp_count(text, F.lit(f"{self.flags()}(?=(?:{self.body()}))"))
        return F.when(text.contains(part), n).otherwise(0) if part else n


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLD = str.maketrans(UPPER, UPPER.lower())


def as_bytes(pattern: str) -> str:
    """The UTF-8 bytes of a pattern, one character each."""
    return pattern.encode("utf-8").decode("latin-1")


def hex_regex(pattern: str) -> str:
    out = []
    for part in re.findall(r"\[[^\]]*\]|[0-9A-Fa-f?]{2}|[()|]", pattern):
        if part[0] == "[":
            low, dash, high = part[1:-1].partition("-")
            out.append(f"[\\s\\S]{{{low.strip() or 0},{high.strip()}}}" if dash else f"[\\s\\S]{{{low.strip()}}}")
        elif part in ("(", "|", ")"):
            out.append("(?:" if part == "(" else part)
        elif part == "??":
            out.append(r"[\s\S]")
        elif "?" in part:
            digits = [part.replace("?", d) for d in "0123456789abcdef"]
            out.append("[" + "".join(rf"\x{d}" for d in digits) + "]")
        else:
            out.append(rf"\x{part}")
    return "".join(out)


def needed_part(pattern: str) -> str:
    """The longest run of plain characters outside groups, classes and repetitions: each match of the pattern holds it."""
    runs, i, n = [""], 0, len(pattern)

    def past_class(j: int) -> int:
        j += 1 + pattern.startswith("^", j + 1)
        j += pattern.startswith("]", j)
        while j < n and pattern[j] != "]":
            j += 2 if pattern[j] == "\\" else 1
        return j + 1

    while i < n:
        c, plain, j = pattern[i], "", i + 1
        if c == "|":
            return ""
        if c == "(":
            depth = 1
            while j < n and depth:
                if pattern[j] == "[":
                    j = past_class(j)
                    continue
                depth += (pattern[j] == "(") - (pattern[j] == ")")
                j += 2 if pattern[j] == "\\" else 1
        elif c == "[":
            j = past_class(i)
        elif c == "\\" and i + 1 < n:
            j = i + 2
            plain = "" if pattern[i + 1].isalnum() else pattern[i + 1]
            if pattern[i + 1] == "x":
                j = i + 4
        elif c not in "^$.":
            plain = c
        repeated = j < n and pattern[j] in "?*{"
        if plain and not repeated:
            runs[-1] += plain
        if not plain or j < n and pattern[j] in "?*{+":
            runs.append("")
            while j < n and pattern[j] in "?*+{":
                j = pattern.index("}", j) + 1 if pattern[j] == "{" else j + 1
        i = j
    return max(runs, key=len)


def to_java(pattern: str) -> str:
    """The pattern in Java's dialect: ASCII word borders by look-around, $ only at the very end."""
    out, i, in_class = [], 0, False
    word = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    inner = r"(?:(?<=[A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<![A-Za-z0-9_])(?![A-Za-z0-9_]))"
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            two = pattern[i : i + 2]
            if two == r"\b" and not in_class:
                # beside a letter that is always there, one side of the border is known
                before, after = out[-1] if out else "", pattern[i + 2 : i + 4]
                if re.match(r"[A-Za-z0-9_](?![?*{])", after):
                    two = "(?<![A-Za-z0-9_])"
                elif re.fullmatch(r"[A-Za-z0-9_]", before):
                    two = "(?![A-Za-z0-9_])"
                else:
                    two = word
            elif two == r"\B" and not in_class:
                two = inner
            out.append(two)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "[" and in_class:  # a literal bracket inside a class
            c = r"\["
        elif c == "]" and in_class:
            in_class = False
        elif c == "$" and not in_class:
            c = r"\z"
        elif c == "^" and not in_class:
            c = r"\A"
        elif c == "&" and in_class:  # && would be an intersection
            c = r"\&"
        out.append(c)
        i += 1
    return "".join(out)


@dataclass(frozen=True)
class Rule:
    """``condition`` is a nested list, the operator first:

    ["any", name...], ["all", name...], ["of", n, name...]: how many of the strings are found. A name that
    ends in * stands for all strings that begin so; no name for all strings.
    ["count", name...]: number of matches, for ["ge" | "gt" | "le" | "lt", x, y] with numbers, counts or ["add", ...] of them.
    ["and", ...], ["or", ...], ["not", x]; ["rule", id]: another rule's condition.
    """

    id: str
    condition: list
    strings: dict[str, Text] = field(default_factory=dict)
    description: str | None = None
    severity: str = "medium"
    include: tuple[str, ...] = ()
    private: bool = False

    def names(self, picks: Sequence[str]) -> list[str]:
        if not picks:
            return list(self.strings)
        out = [n for p in picks for n in self.strings if n == p or p.endswith("*") and n.startswith(p[:-1])]
        if not out:
            raise ValueError(f"rule {self.id}: no string named {picks}")
        return out


def number(rule: Rule, x, text: Column) -> Column:
    """Column of a number, count or sum of a condition over ``text``."""
    if isinstance(x, int):
        return F.lit(x)
    op, *args = x
    if op == "count":
        return reduce(lambda a, b: a + b, [rule.strings[n].count(text) for n in rule.names(args)])
    if op == "add":
        return reduce(lambda a, b: a + b, [number(rule, a, text) for a in args])
    raise ValueError(f"rule {rule.id}: {op} gives no number")


def truth(rule: Rule, x, text: Column, rules: dict[str, Rule], seen: tuple[str, ...] = ()) -> Column:
    """Column of the truth of a condition over ``text``; ``rules`` are those it may refer to."""
    op, *args = x
    found = lambda picks: [rule.strings[n].found(text) for n in rule.names(picks)]
    if op == "any":
        return reduce(lambda a, b: a | b, found(args))
    if op == "all":
        return reduce(lambda a, b: a & b, found(args))
    if op == "of":
        return reduce(lambda a, b: a + b, [f.cast("int") for f in found(args[1:])]) >= args[0]
    if op in ("and", "or"):
        parts = [truth(rule, a, text, rules, seen) for a in args]
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), parts)
    if op == "not":
        return ~truth(rule, args[0], text, rules, seen)
    if op == "rule":
        if args[0] in seen:
            raise ValueError(f"rules refer to each other: {args[0]}")
        other = rules[args[0]]
        return truth(other, other.condition, text, rules, (*seen, args[0]))
    if op in ("ge", "gt", "le", "lt"):
        a, b = (number(rule, v, text) for v in args)
        return {"ge": a >= b, "gt": a > b, "le": a <= b, "lt": a < b}[op]
    raise ValueError(f"rule {rule.id}: unknown operator {op}")


def glob_regex(glob: str) -> str:
    """A shell pattern as an anchored regular expression: ``*`` also crosses slashes, ``[abc]``, ``[a-c]`` and ``[!abc]`` are classes of
    characters; a bracket that is never closed stands for itself."""
    out = []
    for part in re.findall(r"\[!?\]?[^\]]*\]|.", glob.strip(), re.S):
        if len(part) > 2 and part[0] == "[":
            negated = part[1] == "!"
            inner = re.sub(r"([\\\[\]&^])", r"\\\1", part[2:-1] if negated else part[1:-1])
            out.append(f"[{'^' if negated else ''}{inner}]")
        else:
            out.append(".*" if part == "*" else "." if part == "?" else re.escape(part))
    return r"(?s)\A" + "".join(out) + r"\z"


def path_matches(path: Column, globs: Sequence[str]) -> Column:
    """Whether the whole path or its base name matches one of the globs; no globs: always."""
    if not globs:
        return F.lit(True)
    base = F.substring_index(path, "/", -1)
    any_of = "|".join(f"(?:{glob_regex(g)})" for g in globs)
    return path.rlike(any_of) | base.rlike(any_of)


def path_excluded(path: Column) -> Column:
    """Whether a directory of the path (not the file itself) is one of those not scanned, in any case."""
    parts = F.split(F.lower(path), "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in EXCLUDED_DIRS]))


def scanned_part(text: Column, max_bytes: int | None = SCAN_BYTES) -> Column:
    """The first ``max_bytes`` bytes (None: all) of the text in UTF-8, one character for each byte, as rules match bytes."""
    data = F.encode(text, "utf-8")
    return F.decode(data if max_bytes is None else F.substring(data, 1, max_bytes), "ISO-8859-1")


def scan(files: DataFrame, rules: Sequence[Rule], path: str = "path", text: str = "text", max_bytes: int | None = SCAN_BYTES) -> DataFrame:
    """Add ``yara_hits``: array of (path, rule_id, description, severity) in rule order.

    Files in excluded directories, and null or empty paths and texts, have an empty array. A rule without a description is
    described by its id. Private rules only serve others. Of each text the first ``max_bytes`` bytes are scanned, None: all.
    """
    by_id = {r.id: r for r in rules}
    p, t = F.col(path), F.col("_scan")
    eligible = F.coalesce((p != "") & (F.length(text) > 0) & ~path_excluded(p), F.lit(False))
    hit = lambda r: F.struct(p.alias("path"), F.lit(r.id).alias("rule_id"), F.lit(r.description or r.id).alias("description"), F.lit(r.severity).alias("severity"))
    # the path is tested first: the costly patterns run only where the rule applies
    hits = [F.when(F.when(path_matches(p, r.include), truth(r, r.condition, t, by_id)).otherwise(False), hit(r)) for r in rules if not r.private]
    found = F.filter(F.array(*hits), lambda h: h.isNotNull())
    shaped = "array<struct<path:string,rule_id:string,description:string,severity:string>>"
    return files.withColumn("_scan", scanned_part(F.col(text), max_bytes)).withColumn("yara_hits", F.when(eligible, found).otherwise(F.array().cast(shaped))).drop("_scan")


def load_rules(folder: str) -> list[Rule]:
    """Rules from the ``*.json`` files of a folder, files in name order; a file holds a list of rules.

    Keys as in :class:`Rule`; ``strings`` maps a name to {"pattern", "kind", "nocase"}.
    """
    out = []
    for f in sorted(Path(folder).glob("*.json")):
        for r in json.loads(f.read_text()):
            strings = {k: Text(**v) for k, v in r.pop("strings", {}).items()}
            out.append(Rule(strings=strings, include=tuple(r.pop("include", ())), **r))
    return out
