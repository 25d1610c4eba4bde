"""Rules from text files in the usual pattern-rule notation (``rule x { meta: strings: condition: }``).

Read are text strings (nocase), regular expressions (flags i, s and nocase), hex strings, includes, private
rules, and conditions of and / or / not, parentheses, strings, counts with + and -, comparisons, ``any | all | n of them``
or of a list of strings, and other rules' names. Anything else is an error that names the rule.
"""

from __future__ import annotations

import re
from pathlib import Path

from gitsift.rules.engine import Rule, Text

TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>"(?:\\.|[^"\\])*")|(?P<regex>/(?![/*])(?:\\.|\[(?:\\.|[^\]\\])*\]|[^/\\\n])+/[is]*)"""
    r"""|(?P<word>[$#]?[A-Za-z_]\w*\*?|\$\*?|\d+)|(?P<op>>=|<=|==|!=|[{}()\[\]:=,<>+*?|-])""",
    re.S,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


def unquote(token: str) -> str:
    return re.sub(r"\\(x[0-9A-Fa-f]{2}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "x" and len(m[1]) == 3 else ESCAPES[m[1]], token[1:-1])


class Reader:
    """One pass over the tokens of a file."""

    def __init__(self, text: str, name: str) -> None:
        self.text, self.name, self.at, self.rule = text, name, 0, ""
        self.kind, self.value = "", ""
        self.next()

    def fail(self, what: str) -> None:
        raise ValueError(f"{self.name}, rule {self.rule or '(none)'}: {what} near {self.text[max(0, self.at - 20) : self.at + 20]!r}")

    def next(self) -> str:
        """Move on; returns the token left behind."""
        old = self.value
        while True:
            if self.at >= len(self.text):
                self.kind, self.value = "end", ""
                return old
            m = TOKEN.match(self.text, self.at)
            if not m:
                self.fail("unknown sign")
            self.at = m.end()
            if m.lastgroup != "skip":
                self.kind, self.value = m.lastgroup, m.group()
                return old

    def take(self, value: str) -> bool:
        if self.value == value and self.kind in ("word", "op"):
            self.next()
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            self.fail(f"expected {value}")

    def file(self) -> tuple[list[str], list[Rule]]:
        includes, rules = [], []
        while self.kind != "end":
            if self.take("include"):
                includes.append(unquote(self.next()))
            else:
                private = self.take("private")
                self.need("rule")
                rules.append(self.one(private))
        return includes, rules

    def one(self, private: bool) -> Rule:
        self.rule = self.next()
        if self.take(":"):  # tags
            while self.kind == "word":
                self.next()
        self.need("{")
        meta: dict[str, str] = {}
        strings: dict[str, Text] = {}
        if self.take("meta"):
            self.need(":")
            while self.value not in ("strings", "condition"):
                key = self.next()
                self.need("=")
                meta[key] = unquote(self.value) if self.kind == "text" else self.value
                self.next()
        if self.take("strings"):
            self.need(":")
            while self.value != "condition":
                name = self.next()[1:]
                self.need("=")
                strings[name] = self.string()
        self.need("condition")
        self.need(":")
        condition = self.either()
        self.need("}")
        include = tuple(g.strip() for g in meta.get("path_include", "").split(",") if g.strip())
        return Rule(self.rule, condition, strings, meta.get("description") or None, meta.get("severity", "medium"), include, private)

    def string(self) -> Text:
        if self.kind == "op" and self.value == "{":
            end = self.text.index("}", self.at)
            body, self.at = self.text[self.at : end], end + 1
            self.next()
            return Text(re.sub(r"//[^\n]*", "", body), "hex")
        kind, raw, flags = self.kind, self.next(), ""
        if kind == "regex":
            body, _, flags = raw[1:].rpartition("/")
            body = body.replace(r"\/", "/")
        elif kind == "text":
            body = unquote(raw)
        else:
            self.fail("expected a string")
        nocase = "i" in flags
        while self.value in ("nocase", "ascii"):
            nocase |= self.next() == "nocase"
        if "s" in flags:
            body = f"(?s:{body})"
        return Text(body, kind, nocase)

    def either(self) -> list:
        parts = [self.both()]
        while self.take("or"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else ["or", *parts]

    def both(self) -> list:
        parts = [self.simple()]
        while self.take("and"):
            parts.append(self.simple())
        return parts[0] if len(parts) == 1 else ["and", *parts]

    def simple(self) -> list:
        if self.take("not"):
            return ["not", self.simple()]
        if self.kind == "op" and self.value == "(":
            back = self.at, self.kind, self.value
            try:  # a condition, or else the start of a sum
                self.next()
                inner = self.either()
                self.need(")")
                return inner
            except ValueError:
                self.at, self.kind, self.value = back
                if not re.match(r"[\s(]*[#\d]", self.text[self.at :]):
                    raise
        if self.value in ("any", "all") or self.value.isdigit() and re.match(r"\s+of\b", self.text[self.at :]):
            how = self.next()
            self.need("of")
            names = self.names()
            return [how, *names] if how in ("any", "all") else ["of", int(how), *names]
        if self.value[:1] == "$":
            return ["any", self.next()[1:]]
        if self.value[:1] == "#" or self.value.isdigit() or self.value == "(":
            a, op, b = self.total(), self.next(), self.total()
            compare = {">=": "ge", ">": "gt", "<=": "le", "<": "lt"}
            if op == "==":
                return ["and", ["ge", a, b], ["le", a, b]]
            if op not in compare:
                self.fail(f"unknown comparison {op}")
            return [compare[op], a, b]
        if self.kind == "word":
            return ["rule", self.next()]
        self.fail("expected a condition")

    def names(self) -> list[str]:
        if self.take("them"):
            return []
        self.need("(")
        out = [self.next()[1:]]
        while self.take(","):
            out.append(self.next()[1:])
        self.need(")")
        return out

    def total(self) -> list | int:
        parts = [self.amount()]
        while self.take("+"):
            parts.append(self.amount())
        return parts[0] if len(parts) == 1 else ["add", *parts]

    def amount(self) -> list | int:
        if self.take("("):
            inner = self.total()
            self.need(")")
            return inner
        token = self.next()
        return int(token) if token.isdigit() else ["count", token[1:]] if token[:1] == "#" else self.fail("expected a number")


def parse_rules(text: str, name: str = "rules") -> list[Rule]:
    """Rules of one text without includes."""
    includes, rules = Reader(text, name).file()
    if includes:
        raise ValueError(f"{name}: a text by itself cannot include files")
    return rules


def read_rules(folder: str, suffix: str = ".yar") -> list[Rule]:
    """All rules of the folder's files in name order, each included file once, before the file that includes it first."""
    out: list[Rule] = []
    seen: set[Path] = set()

    def read(path: Path) -> None:
        if path in seen:
            return
        seen.add(path)
        includes, rules = Reader(path.read_text(encoding="utf-8"), path.name).file()
        for name in includes:
            read((path.parent / name).resolve())
        out.extend(rules)

    for path in sorted(Path(folder).resolve().glob(f"*{suffix}")):
        read(path)
    if len({r.id for r in out}) < len(out):
        raise ValueError("two rules have one name")
    return out
