"""Newick text to trees and back, as Arrow-batched functions."""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from ..operators.forest import Forest

_TREE = T.StructType([T.StructField("ptree", T.ArrayType(T.IntegerType())), T.StructField("age", T.ArrayType(T.DoubleType())), T.StructField("names", T.ArrayType(T.StringType()))])

#: Behind a node: its label, then branch lengths and notes in brackets.
_TAIL, _PART = re.compile(r"([^,():;\[]*)((?::[^,();\[]*|\[[^\]]*\])*)"), re.compile(r":([^,();\[]*)|\[([^\]]*)\]")


def parse(text: str) -> tuple[list[int], list[float], list[str]]:
    """ptree, age, names of one tree: leaves first in the order of the text, then the others, each behind its children.

    A node's age is its [&&NHX:age=...] if given, else a child's age and branch
    length, and 0 for a leaf.
    """
    stack: list[list[int]] = [[]]
    parent, age, length, name, leaf = [], [], [], [], []
    i, n = 0, len(text)

    def finish(children: list[int], is_leaf: bool) -> int:
        nonlocal i
        tail = _TAIL.match(text, i)
        label, branch, own_age, i = tail[1].strip(), None, None, tail.end()
        if text[i : i + 1] == "[":
            raise ValueError("a bracket is not closed")
        for part in _PART.finditer(tail[2]):
            if part[2] is None:
                branch = float(part[1])
                continue
            for entry in part[2].split(":"):
                key, _, value = entry.partition("=")
                if key == "age":
                    own_age = float(value)
        if own_age is None:
            own_age = max((age[c] + (length[c] or 0.0) for c in children), default=0.0)
        for c in children:
            parent[c] = len(parent)
        parent.append(-1)
        age.append(own_age)
        length.append(branch)
        name.append(label)
        leaf.append(is_leaf)
        return len(parent) - 1

    while i < n and text[i] != ";":
        c = text[i]
        if c == "(":
            stack.append([])
            i += 1
        elif c == ",":
            i += 1
        elif c == ")":
            i += 1
            children = stack.pop()
            stack[-1].append(finish(children, False))
        elif c.isspace():
            i += 1
        else:
            stack[-1].append(finish([], True))
    order = [x for x in range(len(parent)) if leaf[x]] + [x for x in range(len(parent)) if not leaf[x]]
    place = {x: k for k, x in enumerate(order)}
    return [place[parent[x]] if parent[x] >= 0 else -1 for x in order], [age[x] for x in order], [name[x] for x in order]


def render(ptree: list[int], age: list[float], names: list[str], decimals: int = 6, nhx: bool = True) -> str:
    """Children by the smallest leaf number below them; branch lengths with `decimals`, ages as NHX."""
    children: dict[int, list[int]] = {}
    for x, up in enumerate(ptree):
        children.setdefault(up, []).append(x)
    text: dict[int, tuple[int, str]] = {}
    todo = [(children[-1][0], False)]
    while todo:
        x, ready = todo.pop()
        below = children.get(x, [])
        if below and not ready:
            todo.append((x, True))
            todo.extend((y, False) for y in below)
            continue
        parts = sorted(text[y] for y in below)
        inner = f"({','.join(t for _, t in parts)})" if parts else ""
        branch = f":{age[ptree[x]] - age[x]:.{decimals}f}" if ptree[x] >= 0 else ""
        mark = f"[&&NHX:age={age[x]:.{decimals}f}]" if nhx else ""
        text[x] = (parts[0][0] if parts else x, f"{inner}{names[x]}{branch}{mark}")
    return text[children[-1][0]][1] + ";"


@F.pandas_udf(_TREE)
def parse_newick(texts: pd.Series) -> pd.DataFrame:
    rows = [parse(t) if t else (None, None, None) for t in texts]
    return pd.DataFrame(rows, columns=["ptree", "age", "names"])


def rendered(f: Forest, names: list[str], decimals: int = 6) -> list[str]:
    """render() of all trees of a forest, node by node from the deepest level up."""
    inner = np.flatnonzero(f.parent >= 0)
    childless = np.flatnonzero(np.bincount(f.parent[inner], minlength=len(f.parent)) == 0)
    least, own, up = np.full(len(f.parent), np.iinfo(np.int64).max), f.place[childless], childless
    while len(up):
        np.minimum.at(least, up, own)
        own, up = own[f.parent[up] >= 0], f.parent[up]
        up = up[up >= 0]
    number = f"%.{decimals}f".__mod__
    branch = [""] * len(f.parent)
    for x, length in zip(inner.tolist(), map(number, (f.age[f.parent[inner]] - f.age[inner]).tolist())):
        branch[x] = ":" + length
    mark, parent = list(map(number, f.age.tolist())), f.parent.tolist()
    below, text = [""] * len(parent), [""] * len(parent)
    for x in np.lexsort((least, -f.depth())).tolist():
        text[x] = f"{'(' + below[x] + ')' if below[x] else ''}{names[x]}{branch[x]}[&&NHX:age={mark[x]}]"
        if (up := parent[x]) >= 0:
            below[up] = f"{below[up]},{text[x]}" if below[up] else text[x]
    roots = np.flatnonzero(f.parent < 0)
    trees, at = np.unique(f.tree[roots], return_index=True)
    out = [None] * len(f.sizes)
    for tree, x in zip(trees.tolist(), roots[at].tolist()):
        out[tree] = text[x] + ";"
    return out


@F.arrow_udf(T.StringType())
def format_newick(ptree: pa.Array, age: pa.Array, names: pa.Array) -> pa.Array:
    return pa.array(rendered(Forest(ptree, age), names.flatten().to_pylist()), pa.string())
