"""Syntax-tree bags: subtree hashes of node tables, and a light bracket parser that makes such tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simforge.functions.hashing import subtree_hash
from simforge.operators.pairs import bag_dice
from simforge.operators.storage import saved

# Leaf types whose label is marked, so that names and literal values don't count.
LEAVES = ("identifier", "number_literal", "string_literal", "char_literal", "float_literal", "true", "false")
BAGS = "problem string, file string, key string, w long"
#: Rows of an Arrow batch, more or less: the files of one batch are not cut.
BATCH = 1 << 14
NODES = "problem string, file string, node_id long, parent_id long, depth int, type string"


def brackets(code: str) -> Iterator[tuple[int, int | None, int, str]]:
    """(node, parent, depth, type) of a nesting of (), [] and {} with identifiers, numbers and marks as leaves."""
    import re

    names = {"(": "list", "[": "subscript", "{": "block"}
    ends = {")": "list", "]": "subscript", "}": "block"}
    yield 0, None, 0, "unit"
    stack, n, kinds = [(0, "unit")], 1, {}
    for t in re.findall(r"//[^\n]*|/\*.*?\*/|\"[^\"]*\"|'[^']*'|[A-Za-z_]\w*|\d+(?:\.\d+)?|\S", code, re.S):
        if t in ends:
            if any(kind == ends[t] for _, kind in stack[1:]):
                while stack.pop()[1] != ends[t]:
                    pass
            continue
        kind = kinds.get(t)
        if kind is None:
            kind = kinds[t] = names.get(t) or ("comment" if t[:2] in ("//", "/*") else "string_literal" if t[0] == '"' and len(t) > 1 else "char_literal" if t[0] == "'" and len(t) > 1 else "identifier" if t[0].isalpha() or t[0] == "_" else "number_literal" if t[0].isdigit() else t)
        yield n, stack[-1][0], len(stack), kind
        if t in names:
            stack.append((n, kind))
        n += 1


def _batch(columns: list[list], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    names, types = zip(*(x.split() for x in ddl.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(columns, types)], names=list(names))


def parse(files: DataFrame, parser: Callable[[str], Iterator] = brackets) -> DataFrame:
    """Node table of files (problem, file, code); parser gives (node, parent, depth, type) of a text."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for p, f, c in zip(*(batch.column(x).to_pylist() for x in ("problem", "file", "code"))):
                for row in parser(c or ""):
                    for column, x in zip(out, (p, f, *row)):
                        column.append(x)
                if len(out[0]) >= BATCH:
                    yield _batch(out, NODES)
                    out = [[] for _ in range(6)]
            yield _batch(out, NODES)

    return files.select("problem", "file", "code").mapInArrow(run, NODES)


def subtree_bags(nodes: DataFrame) -> DataFrame:
    """(problem, file, key, w): how often each subtree occurs; order of siblings does not count.

    Level by level from the deepest: a level's hashes are grouped under their parents and joined to the level above, so
    that the number of rounds is the height of the tallest tree and no tree is held in one place.
    """
    keys = ["problem", "file", "node_id"]
    label = F.when(F.col("type").isin(*LEAVES), F.concat(F.lit("LEAF_"), F.col("type"))).otherwise(F.col("type"))
    top = nodes.agg(F.max("depth")).first()[0]
    done, below = [], None
    for depth in range(top if top is not None else -1, -1, -1):
        level = nodes.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("h", subtree_hash(label, F.array().cast("array<string>")))
        else:
            level = level.join(below, keys, "left").withColumn("h", F.when(F.col("kids").isNull(), subtree_hash(label, F.array().cast("array<string>"))).otherwise(subtree_hash(F.col("type"), F.coalesce("kids", F.array().cast("array<string>")))))
        level = level.select("problem", "file", "node_id", "parent_id", "h")
        if depth % 4 == 3:
            level = saved(level)
        done.append(level.select("problem", "file", "h"))
        below = level.where("parent_id is not null").groupBy("problem", "file", F.col("parent_id").alias("node_id")).agg(F.collect_list("h").alias("kids"))
    if not done:
        return nodes.select("problem", "file", F.lit("").alias("key"), F.lit(0).cast("long").alias("w")).limit(0)
    out = done[0]
    for level in done[1:]:
        out = out.union(level)
    return out.groupBy("problem", "file", F.col("h").alias("key")).agg(F.count(F.lit(1)).alias("w"))


def tree_bags(files: DataFrame, parser: Callable[[str], Iterator] = brackets) -> DataFrame:
    """subtree_bags of files' trees, file by file: parsing and hashing need nothing of other files, so no shuffle is made."""
    import hashlib
    from collections import Counter

    def bag(code: str) -> dict[str, int]:
        rows = list(parser(code or ""))
        kids: dict[int, list[int]] = {}
        # trees of one name with equal subtrees are hashed once; number of each, by name and its subtrees' numbers
        numbers: dict[str | tuple, int] = {}
        hashes: list[str] = []
        out: list[int] = []
        for node, parent, _, kind in reversed(rows):  # children come after their parents
            mine = kids.pop(node, ())
            of = (kind, *sorted(mine)) if mine else kind
            h = numbers.get(of)
            if h is None:
                h = numbers[of] = len(hashes)
                name = "LEAF_" + kind if not mine and kind in LEAVES else kind
                hashes.append(hashlib.md5((name + "_" + "_".join(sorted(hashes[i] for i in mine))).encode()).hexdigest())
            out.append(h)
            if parent in kids:
                kids[parent].append(h)
            elif parent is not None:
                kids[parent] = [h]
        counts: Counter = Counter()
        for h, n in Counter(out).items():
            counts[hashes[h]] += n
        return counts

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for p, f, c in zip(*(batch.column(x).to_pylist() for x in ("problem", "file", "code"))):
                b = bag(c)
                for column, x in zip(out, ([p] * len(b), [f] * len(b), b.keys(), b.values())):
                    column.extend(x)
                if len(out[0]) >= BATCH:
                    yield _batch(out, BAGS)
                    out = [[] for _ in range(4)]
            yield _batch(out, BAGS)

    return files.select("problem", "file", "code").mapInArrow(run, BAGS)


def similarity(bags: DataFrame, name: str = "S_AST", files: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """Multiset Dice of all pairs of files with a bag, or of all of files."""
    return bag_dice(bags, name, files, digits=digits)
