"""Column functions on source code in messages, test logs and model output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Fixed value: a fenced block.
FENCED = r"(?s)```[\w+#.-]*[ \t]*\n.*?```"
#: What tells languages apart, first match wins.
LANGUAGES = (
    ("C++", r"#include\s*<|\bstd::|\busing\s+namespace\s+std\b|(?m:^\s*(?:public|private|protected):\s*$)|\bvector\s*<|\bstring\s+\w+\s*\("),
    ("Java", r"\bpublic\s+(?:static\s+)?class\b|\bSystem\.out\.|\bimport\s+java\."),
    ("Python", r"(?m:^\s*(?:async\s+)?def\s+\w+\s*\()|(?m:^\s*(?:from\s+\w+\s+)?import\s+)"),
    ("Rust", r"\bfn\s+\w+\s*\(|\blet\s+mut\b|\bimpl\s+\w+"),
    ("TypeScript", r"\binterface\s+\w+|:\s*(?:string|number|boolean)\b|\btype\s+\w+\s*="),
    ("JavaScript", r"\b(?:const|let|var)\s+\w+\s*=|\bfunction\s+\w+\s*\(|=>"),
    ("Go", r"\bpackage\s+main\b|\bfunc\s+\w+\s*\("),
)
#: Names of languages behind a fence.
NAMES = {"cpp": "C++", "c++": "C++", "cc": "C++", "java": "Java", "py": "Python", "python": "Python", "rs": "Rust", "rust": "Rust", "ts": "TypeScript", "typescript": "TypeScript", "js": "JavaScript", "javascript": "JavaScript", "go": "Go", "golang": "Go"}
#: Fixed value: a line that starts code.
CODE_START = r"(?i)^\s*(?:#include\b|using\s+namespace\b|class\s+\w+|public:|private:|protected:|def\s+\w+\s*\(|async\s+def\s+\w+\s*\(|fn\s+\w+\s*\(|function\s+\w+\s*\(|(?:const|let|var)\s+\w+\s*=|package\s+[\w.]+\s*;|import\s+[\w.]+\s*;)"


def detect_language(code: Column) -> Column:
    out = F
    for name, pattern in LANGUAGES:
        out = out.when(code.rlike(pattern), name)
    return out.otherwise(F.lit(None).cast("string"))


def normalize_language(name: Column) -> Column:
    """A known name's language, else the name itself; null if blank."""
    plain = T.strip(name)
    out = F
    for k, v in NAMES.items():
        out = out.when(F.lower(plain) == k, v)
    return out.otherwise(F.nullif(plain, F.lit("")))


#: A Python function, an indented line; signals of code that count up to twice, and once.
PYTHON_FUNCTION, INDENTED = r"(?m)^\s*(?:async\s+)?def\s+\w+\s*\(", r"^\s{2,}\S"
TWICE, ONCE = (r"\{", r"\}", ";"), (r"\b(?:for|while|if|return|class|def|fn|function)\b", r"(?:\+\+|--|==|->|::|\[\w*\])")


def looks_like_code(text: Column) -> Column:
    """A Python function with two indented lines, or four signals of code, each kind capped."""
    lines = F.split(text, r"\n")
    indented = F.size(F.filter(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda s: s.rlike(INDENTED)))
    python = text.rlike(PYTHON_FUNCTION) & (indented >= 2)
    signals = sum([F.least(F.regexp_count(text, F.lit(p)), F.lit(2)) for p in TWICE] + [text.rlike(p).cast("int") for p in ONCE])
    return python | (signals >= 4)


def code_artifact(message: Column) -> Column:
    """struct(code, language, instruction): the longest fenced block (the first of several), else what starts at the first line
    that looks like code; null without any."""

    def fenced(blocks: Column) -> Column:
        parts = F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, r"^```([\w+#.-]*)", 1).alias("tag"), F.regexp_extract(b, r"(?s)^```[\w+#.-]*[ \t]*\n(.*?)```$", 1).alias("code")))
        longest = F.reduce(parts, F.get(parts, F.lit(0)), lambda best, p: F.when(F.length(p["code"]) > F.length(best["code"]), p).otherwise(best))
        return _bind(longest, lambda p: _bind(T.strip(p["code"]), lambda code: F.struct(code.alias("code"), F.coalesce(normalize_language(p["tag"]), detect_language(code)).alias("language"), T.strip(F.regexp_replace(message, FENCED, " ")).alias("instruction"))))

    def bare(lines: Column) -> Column:
        start = F.array_position(F.transform(lines, lambda s: s.rlike(CODE_START)), True)
        tail = T.strip(F.array_join(F.slice(lines, F.greatest(start, F.lit(1)).cast("int"), F.size(lines)), "\n"))
        head = T.strip(F.array_join(F.slice(lines, F.lit(1), F.greatest(start - 1, F.lit(0)).cast("int")), "\n"))
        return F.when(start > 0, _bind(tail, lambda code: F.when(looks_like_code(code), F.struct(code.alias("code"), detect_language(code).alias("language"), head.alias("instruction")))))

    return _bind(F.regexp_extract_all(message, F.lit(FENCED), F.lit(0)), lambda blocks: F.when(F.size(blocks) > 0, fenced(blocks)).otherwise(_bind(F.split(T.strip(message), r"\n"), bare)))


def _bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def test_report(log: Column, planned: Column, accepted: Column) -> Column:
    """struct(status, passed, total) of a test run's output."""
    number = lambda p, i: F.nullif(F.regexp_extract(log, p, i), F.lit("")).cast("long")
    good, bad = r"ALL_TESTS_PASSED\s+([0-9]+)/([0-9]+)", r"TESTS_FAILED\s+([0-9]+)/([0-9]+)"
    passed = F.coalesce(accepted & (number(good, 1) == planned) & (number(good, 2) == planned), F.lit(False))
    failed = number(bad, 1)
    return F.struct(
        F.when(passed, "passed").otherwise("failed").alias("status"),
        F.when(failed.isNotNull(), F.least(failed, planned)).when(passed, planned).otherwise(F.lit(0)).cast("long").alias("passed"),
        F.when(failed.isNotNull(), F.greatest(number(bad, 2), planned)).otherwise(planned).cast("long").alias("total"),
    )


def model_json(text: Column) -> Column:
    """The object in a model's answer: from the first brace to the last."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
