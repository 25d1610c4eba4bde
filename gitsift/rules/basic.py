"""A small set of rules that shows every kind of condition; larger sets are loaded with ``load_rules``."""

from __future__ import annotations

from gitsift.rules.engine import Rule, Text

PY = ("*.py", "*.pyx", "*.pyi")
JS = ("*.js", "*.ts", "*.mjs", "*.cjs", "*.jsx", "*.tsx")


def _t(*patterns: str, nocase: bool = False, prefix: str = "s") -> dict[str, Text]:
    return {f"{prefix}{i}": Text(p, nocase=nocase) for i, p in enumerate(patterns)}


BASIC = [
    Rule("spawns_process", ["any"], _t(r"\bsubprocess\.(?:run|call|Popen)\b", r"\bos\.system\s*\(", r"\bchild_process\b", r"\bexecSync\s*\("), private=True),
    Rule("downloads", ["any"], _t(r"\burllib\.request\b", r"\brequests\.get\s*\(", r"\bfetch\s*\(", r"\b(?:curl|wget)\s+-?"), description=None),
    Rule("download_and_run", ["and", ["rule", "spawns_process"], ["rule", "downloads"]], description="Runs what it downloads", severity="high", include=(*PY, *JS)),
    Rule("deletes_files", ["any"], _t(r"\bshutil\.rmtree\s*\(", r"\bfs\.rmSync\s*\(", r"\brm\s+-rf\s"), description="Deletes files or folders", severity="low", include=(*PY, *JS, "*.sh")),
    Rule("reads_secrets", ["any"], {"a": Text(".ssh/id_rsa", "text"), "b": Text(".aws/credentials", "text"), "c": Text(r"(?:secret|token)_?key", nocase=True)}, description="Reads keys or tokens", severity="high"),
    Rule("enumerates_host", ["of", 2], _t(r"\bgetpass\.getuser\b", r"\bplatform\.node\b", r"\bsocket\.gethostname\b", r"\bos\.uname\b"), description="Asks for several facts about the host", severity="medium", include=PY),
    Rule("install_hook", ["any"], _t(r'"(?:pre|post)install"\s*:\s*"[^"]+"'), description="Runs a script on installation", severity="high", include=("*/package.json", "package.json")),
    Rule(
        "many_http_specs",
        ["gt", ["count", "http*"], ["add", ["count", "known*"], 1]],
        {**_t(r'":\s*"https?://', prefix="http"), **_t(r'":\s*"https?://registry\.', prefix="known")},
        description="Dependencies by direct address",
        severity="high",
        include=("*/package.json", "package.json"),
    ),
    Rule("hex_escapes", ["ge", ["count", "s0"], 20], _t(r"\\x[0-9a-fA-F]{2}"), description="Long runs of escaped bytes", severity="medium", include=(*PY, *JS)),
    Rule("string_glue", ["or", ["ge", ["count", "s0"], 20], ["and", ["any", "s1"], ["not", ["any", "s2"]]]], _t(r'"\s*\+\s*"', r"\beval\s*\(", r"\bast\.literal_eval\b"), description="Code put together from strings", severity="low", include=(*PY, *JS)),
    Rule(
        "mixed_scripts",
        ["any"],
        {f"{a}_{b}": Text(rf"\p{{Is{a}}}\p{{Is{b}}}", "unicode") for a, b in (("Latin", "Cyrillic"), ("Cyrillic", "Latin"), ("Latin", "Greek"), ("Greek", "Latin"))},
        description="Letters of two scripts side by side",
        severity="medium",
    ),
    Rule("raises_errors", ["ge", ["count"], 2], _t(r"\braise\s+\w+Error\("), description="Raises several errors", severity="low"),
    Rule("versions_pinned", ["of", 2], {"a": Text(r'"\^\d+\.\d+\.\d+"'), "b": Text("+++ b/", "text"), "c": Text(r"^@@ -\d+")}, description="Touches pinned versions", severity="low"),
]
