"""Complexity of Python snippets from the standard syntax tree.

A snippet that does not parse is taken apart by its indentation: blocks that
parse count as they are; of others the first line is mended (a missing colon
or closing bracket) and what is indented below it is measured in the same way,
one level deeper.  Of a line that cannot be mended its keywords count.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
import warnings
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEEPER = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.Try, ast.TryStar, ast.With, ast.AsyncWith, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
PLAIN = (ast.While, ast.For, ast.AsyncFor, ast.IfExp, ast.ListComp, ast.DictComp, ast.SetComp, ast.GeneratorExp)
SCHEMA = "struct<ast_cyclomatic:int,ast_nesting_depth:int,ast_function_count:int,ast_class_count:int>"


def _is_elif(node: ast.AST, lines: list[str]) -> bool:
    return isinstance(node, ast.If) and lines[node.lineno - 1].encode()[node.col_offset :].startswith(b"elif")


def measured(code: str) -> tuple[int, int, int, int]:
    """(cyclomatic complexity, nesting depth, functions, classes)."""
    return _measured_once(code) if len(code or "") <= KEPT_LENGTH else _measured(code)


def _measured(code: str) -> tuple[int, int, int, int]:
    if not code:
        return 1, 0, 0, 0
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # of odd escapes and comparisons in snippets
        found = whole(code)
        branches, *rest = recovered(code.replace("\0", " ").expandtabs().splitlines(), 0) if found is None else found
    return 1 + branches, *rest


# what is remembered of texts seen before, in each Python worker; longer ones are measured anew
KEPT, KEPT_LENGTH = 8_192, 2_000
_measured_once = lru_cache(KEPT)(_measured)


def whole(code: str) -> tuple[int, int, int, int] | None:
    """Counts of code that parses, at depth 0, else none."""
    return _whole_once(code) if len(code) <= KEPT_LENGTH else _whole(code)


def _whole(code: str) -> tuple[int, int, int, int] | None:
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return None
    return counted(tree, code, 0)


_whole_once = lru_cache(KEPT)(_whole)


def lower(found: tuple[int, int, int, int], depth: int) -> tuple[int, int, int, int]:
    """Counts of what stands at depth 0, moved to another depth."""
    return found[0], found[1] + depth, *found[2:]


def counted(tree: ast.Module, code: str, depth: int) -> tuple[int, int, int, int]:
    """(branches, deepest level, functions, classes) of a tree that stands at a depth."""
    lines = code.split("\n")
    branches, deepest, functions, classes = 0, depth, 0, 0
    todo: list[tuple[ast.AST, int, bool]] = [(tree, depth, False)]
    while todo:
        node, depth, star = todo.pop()
        elif_ = _is_elif(node, lines)
        if isinstance(node, PLAIN) or (isinstance(node, ast.If) and not elif_):
            branches += 1
        elif isinstance(node, ast.BoolOp):
            branches += len(node.values) - 1
        elif isinstance(node, ast.ExceptHandler) and not star:
            branches += 1
        functions += isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef)
        classes += isinstance(node, ast.ClassDef)
        inner = depth + (isinstance(node, DEEPER) and not elif_)
        deepest = max(deepest, inner)
        todo += [(child, inner, isinstance(node, ast.TryStar)) for child in ast.iter_child_nodes(node)]
    return branches, deepest, functions, classes


OPENERS = ("if", "while", "for", "try", "with", "def", "class", "async")
GOES_ON = ("elif", "else", "except", "finally")
WORD = re.compile(r"\s*([A-Za-z_]\w*)?")
DEEPEST = 100  # levels of recovery; what lies deeper counts by its keywords
PAIRS = {"(": ")", "[": "]", "{": "}"}


def indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def first_word(line: str) -> str:
    return WORD.match(line).group(1) or ""


def added(a: tuple[int, int, int, int], b: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    return a[0] + b[0], max(a[1], b[1]), a[2] + b[2], a[3] + b[3]


def recovered(lines: list[str], depth: int) -> tuple[int, int, int, int]:
    """Counts of lines that do not parse together, block by block."""
    lines = [line for line in lines if line.strip() and not line.lstrip().startswith("#")]
    out = (0, depth, 0, 0)
    if depth > DEEPEST:
        return added(out, (sum(by_keywords(line)[0] for line in lines), depth, 0, 0))
    at = 0
    while at < len(lines):
        base, end = indent(lines[at]), at + 1
        # a block: a line, what is indented below it, and the clauses that go on with it
        while end < len(lines) and (indent(lines[end]) > base or (indent(lines[end]) == base and (first_word(lines[end]) in GOES_ON or lines[end].lstrip()[0] in ")]}" or lines[end - 1].lstrip().startswith("@")))):
            end += 1
        out = added(out, block([line[base:] for line in lines[at:end]], depth))
        at = end
    return out


def block(lines: list[str], depth: int) -> tuple[int, int, int, int]:
    """Counts of one block whose first line is not indented."""
    found = whole("\n".join(lines))
    if found is not None:
        return lower(found, depth)
    out, at = (0, depth, 0, 0), 0
    while at < len(lines):
        end = at + 1
        while end < len(lines) and indent(lines[end]) > 0:
            end += 1
        word = first_word(lines[at])
        out = added(out, lower(header(lines[at]), depth))
        if end > at + 1:
            inner = depth + (word in OPENERS or word in GOES_ON)
            out = added(out, recovered(lines[at + 1 : end], inner))
        at = end
    return out


def header(line: str) -> tuple[int, int, int, int]:
    """Counts at depth 0 of a line without what is below it, mended if that helps."""
    return _header_once(line) if len(line) <= KEPT_LENGTH else _header(line)


def _header(line: str) -> tuple[int, int, int, int]:
    word, text = first_word(line), line.rstrip()
    if word in GOES_ON:
        text = {"elif": "if" + text[4:], "except": "try:\n    pass\n" + text}.get(word, "")
    opens = word in OPENERS or word in ("elif", "except")
    for own in (text, closed(text)):
        for code in (own + "\n    pass", own.rstrip(":") + ":\n    pass") if opens else (own,):
            code += "\nfinally:\n    pass" if word == "try" else ""
            if (found := whole(code)) is not None:
                return (found[0] - (word == "elif"), *found[1:])  # elif is no branch of its own
    keywords, functions, classes = by_keywords(line)
    return keywords, int(word in OPENERS), functions, classes


_header_once = lru_cache(KEPT)(_header)


def closed(text: str) -> str:
    """A line with the brackets closed that it leaves open, before a colon at its end."""
    open_: list[str] = []
    for c in text:
        if c in PAIRS:
            open_.append(PAIRS[c])
        elif open_ and c == open_[-1]:
            open_.pop()
    colon = ":" if text.endswith(":") else ""
    return text.removesuffix(":") + "".join(reversed(open_)) + colon


def by_keywords(line: str) -> tuple[int, int, int]:
    """(branches, functions, classes) by the keywords of a line; a ``for`` in brackets and the ``if`` after it are one."""
    words, level = [], 0
    try:
        for t in tokenize.generate_tokens(io.StringIO(line.strip()).readline):
            level += (t.string in PAIRS) - (t.string in PAIRS.values())
            if t.type == tokenize.NAME and not (t.string == "if" and level > 0 and "for" in words):
                words.append(t.string)
    except (tokenize.TokenError, SyntaxError):
        pass
    return sum(w in ("if", "while", "for", "except", "and", "or") for w in words), words.count("def"), words.count("class")


def _metrics(code: Column) -> Column:
    def run(values: pd.Series) -> pd.DataFrame:
        rows = [measured(c) if c else (None,) * 4 for c in values]
        return pd.DataFrame(rows, columns=["ast_cyclomatic", "ast_nesting_depth", "ast_function_count", "ast_class_count"]).astype("Int32")

    run.__annotations__ = {"values": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, SCHEMA)(code)


def code_metrics(code: Column) -> Column:
    """Struct of the four metrics; the defaults for empty code."""
    empty = F.struct(F.lit(1).alias("ast_cyclomatic"), F.lit(0).alias("ast_nesting_depth"), F.lit(0).alias("ast_function_count"), F.lit(0).alias("ast_class_count"))
    return F.when(F.coalesce(code, F.lit("")) == "", empty).otherwise(_metrics(code))


def gated_code_metrics(code: Column, lang: Column) -> Column:
    """Metrics of non-empty Python snippets only, else null."""
    fit = F.coalesce((lang == "python") & (code != ""), F.lit(False))
    return F.when(fit, _metrics(F.when(fit, code)))
